"""Domain profiles and sessions: JSON documents keyed by domain or session, and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE_TYPE = (
    "struct<domain:string,preferred_path:string,last_good_driver:string,last_good_session:string,http_trust:boolean,"
    "block_rate:double,vendor_hints:array<string>,notes:string,version:int,browser_success_count:int,failure_count:int,"
    "recent_similarity_scores:array<double>,browser_reference_text:string,last_updated_at:string>"
)
SESSION_TYPE = (
    "struct<session_key:string,domain:string,browser_profile_dir:string,locale:string,timezone_id:string,"
    "viewport_family:string,proxy_affinity:string,trust_score:double,last_challenge_at:string,"
    "cookies:map<string,string>,local_storage:map<string,string>,burned:boolean,last_driver:string,attempt_count:int,"
    "success_count:int,failure_count:int,created_at:string,updated_at:string>"
)


def _read_keyed(spark: SparkSession, path: str, value_type: str, times: list[str]) -> DataFrame:
    documents = spark.read.text(path, wholetext=True)
    parsed = documents.select(F.from_json("value", f"map<string,{value_type}>").alias("entries"))
    rows = parsed.select(F.explode("entries").alias("key", "entry")).select("entry.*")
    for name in times:
        rows = rows.withColumn(name, F.try_to_timestamp(F.col(name)))
    return rows


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One row per domain of `{domain: profile}` documents."""
    return _read_keyed(spark, path, PROFILE_TYPE, ["last_updated_at"])


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row per session of `{session_key: state}` documents."""
    return _read_keyed(spark, path, SESSION_TYPE, ["last_challenge_at", "created_at", "updated_at"])


def write_keyed(rows: DataFrame, key: str, path: str) -> None:
    """Write state as JSON lines `{key: entry}`, each a document the readers accept.

    Lines are written in parallel; there is no single document that one task would have to build.
    """
    timestamps = [f.name for f in rows.schema if f.dataType.typeName().startswith("timestamp")]
    for name in timestamps:
        rows = rows.withColumn(name, F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    entry = F.create_map(F.col(key), F.struct(*rows.columns))
    rows.select(F.to_json(entry, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_keyed_lines(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """Read what `write_keyed` wrote, one document per line."""
    parsed = spark.read.text(path).select(F.from_json("value", f"map<string,{value_type}>").alias("entries"))
    return parsed.select(F.explode("entries").alias("key", "entry")).select("entry.*")
