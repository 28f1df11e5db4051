"""Job table as an append-only log: every change of a job is a new row.

Appending needs no lock and no rewrite; the current state of a job is its latest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "id bigint, status string, payload string, result string, error string, changed_at timestamp"
STATUSES = ["pending", "processing", "done", "failed"]
UNFINISHED = ["pending", "processing"]


def log_rows(jobs: DataFrame, status: str, **columns) -> DataFrame:
    """Log rows for jobs that reach `status`."""
    values = {"payload": None, "result": None, "error": None, **columns}
    fields = {n: F.col(v) if isinstance(v, str) else F.lit(v).cast("string") for n, v in values.items()}
    return jobs.select(
        "id", F.lit(status).alias("status"), *[c.alias(n) for n, c in fields.items()],
        F.current_timestamp().alias("changed_at"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_batch(rows: DataFrame, path: str, batch: int, step: str) -> None:
    """Log rows of one step of a batch, in a folder of their own that a repeated batch writes over."""
    rows.write.mode("overwrite").parquet(f"{path}/batch-{batch}-{step}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All log rows below a folder, whether appended or written by batch."""
    return spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def enqueue(payloads: DataFrame, path: str) -> None:
    """Append pending jobs; `payloads` has id and payload."""
    append_log(log_rows(payloads, "pending", payload="payload"), path)


def _progress(status):
    """Rank of a status, for changes that carry the same time."""
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status)


def latest_status(log: DataFrame, when: str = "changed_at") -> DataFrame:
    """Current state per job: id, status, error, created_at, updated_at.

    Partial maxima are taken before the shuffle, so a job with very many log rows sends one
    row per task. Payloads and results stay out of it; read them with `job_status`.
    """
    place = F.struct(F.col(when), _progress(F.col("status")))
    return log.groupBy("id").agg(
        F.max_by(F.struct("status", "error"), place).alias("last"),
        F.min(when).alias("created_at"),
        F.max(when).alias("updated_at"),
    ).select("id", "last.status", "last.error", "created_at", "updated_at")


def job_status(log: DataFrame, job_id: int) -> DataFrame:
    """State, error and result of one job; no row if it is unknown. The id reaches the file scan as a filter."""
    rows = log.filter(F.col("id") == job_id)
    place = F.struct("changed_at", _progress(F.col("status")))
    return rows.groupBy(F.col("id").alias("job_id")).agg(
        F.max_by("status", place).alias("status"),
        F.min("changed_at").alias("created_at"),
        F.max("changed_at").alias("updated_at"),
        F.max_by("error", place).alias("error"),
        F.max_by("result", place).alias("results"),
    )


def unfinished(log: DataFrame, when: str = "changed_at") -> DataFrame:
    """Jobs to run again after a restart, in id order."""
    return latest_status(log, when).filter(F.col("status").isin(UNFINISHED)).orderBy("id")


def health() -> dict[str, str]:
    return {"status": "ok", "message": "engine is running"}
