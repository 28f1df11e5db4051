"""Job worker: pending rows of the job log in, result pages and status rows out.

What a micro-batch writes lies under its number and is written over if the batch runs again, so a replay changes nothing. A job's
state is a fold over its log rows, never an updated row.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.api import run_requests
from pagewright.sources import jobs as J


def run_batch(pending: DataFrame, snapshot: DataFrame, log_path: str, results_path: str, batch: int) -> None:
    """Answer the requests of a batch, of whatever kind, in one plan for each kind.

    `pending`: id, payload. A payload that is no request with a URL fails; any other job is done, also where pages failed or are
    missing: its result rows say which.
    """
    J.write_batch(J.log_rows(pending, "processing", payload="payload"), log_path, batch, "processing")
    folder = f"{results_path}/batch-{batch}"
    run_requests(pending, snapshot, key="id").write.mode("overwrite").parquet(folder)
    outcome = pending.sparkSession.read.parquet(folder).groupBy("id").agg(F.max(F.when(F.col("error") == "malformed request", F.col("error"))).alias("error"))
    rows = J.log_rows(outcome, "done", error="error").withColumn("status", F.when(F.col("error").isNull(), F.lit("done")).otherwise(F.lit("failed")))
    J.write_batch(rows, log_path, batch, "finished")


def start_worker(
    spark: SparkSession, inbox: str, snapshot: DataFrame, log_path: str, results_path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Follow the folder that `jobs.enqueue` appends to; the checkpoint makes unfinished batches run again."""
    pending = spark.readStream.schema(J.LOG_SCHEMA).parquet(inbox).filter("status = 'pending'").select("id", "payload")
    writer = pending.writeStream.foreachBatch(lambda rows, batch: run_batch(rows, snapshot, log_path, results_path, batch)).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def job_results(spark: SparkSession, results_path: str) -> DataFrame:
    """Result pages of all finished batches: id and the columns of `api.run_requests`."""
    return spark.read.option("recursiveFileLookup", "true").parquet(results_path)


def wait_for_jobs(spark: SparkSession, log_path: str, ids: list[int], timeout: float, every: float = 1.0) -> DataFrame:
    """Status of the jobs `ids` once all have ended, or after `timeout` seconds as it is then; an unknown job has no row."""
    until = time.monotonic() + timeout
    while True:
        found = J.latest_status(J.read_log(spark, log_path).filter(F.col("id").isin(ids)))
        ended = found.filter(~F.col("status").isin(J.UNFINISHED)).count()
        if ended == len(set(ids)) or time.monotonic() >= until:
            return found
        time.sleep(min(every, max(0.0, until - time.monotonic())))
