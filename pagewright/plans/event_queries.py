"""Queries on event-time windows over a stream, with rows that come late."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagewright.plans.registry import query
from pagewright.session import checkpoint_root
from pagewright.streaming.windows import sessions, start_windows, tumbling

_DELAY_HOURS, _GAP_MINUTES = 24, 120
_LIMIT_SQL = f"date_trunc('milliseconds', max(ts)) - INTERVAL {_DELAY_HOURS} HOUR"


def _stream(t, parts, windows):
    """Rows that `windows` has finished after each of `parts` has come as a batch of its own, with a restart between."""
    folder = f"{checkpoint_root(t.spark)}/streams/{uuid.uuid4().hex}"
    for rows in parts:
        rows.repartition(4, "user_id").write.mode("append").parquet(f"{folder}/inbox")
        events = t.spark.readStream.schema(t.events.schema).parquet(f"{folder}/inbox")
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
        finished = windows(events)
        start_windows(finished, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.schema(finished.schema).parquet(f"{folder}/out")


def _halves(t):
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    middle = t.events.agg(F.avg(second)).first()[0]
    return t.events.filter(second <= middle), t.events.filter(second > middle)


def _micros(name: str):
    return F.unix_micros(F.col(f"window.{name}")).alias(f"{name}_us")


def _hours(events):
    return tumbling(events, "ts", f"{_DELAY_HOURS} hours", "1 hour", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _hours_sql(rows: str) -> str:
    return f"""SELECT event_type, epoch_us(date_trunc('hour', ts)) AS start_us, epoch_us(date_trunc('hour', ts) + INTERVAL 1 HOUR) AS end_us,
  count(*) AS n, round(sum(value), 4) AS total FROM ({rows})
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT {_LIMIT_SQL} FROM events) GROUP BY ALL"""


@query("event_windows", _hours_sql("SELECT * FROM events"))
def event_windows(t):
    """Hourly counts by type; the rows come in the order of time, so none is late."""
    return _stream(t, _halves(t), _hours).select("event_type", _micros("start"), _micros("end"), "n", "total")


@query(
    "late_events",
    _hours_sql(
        f"""WITH m AS (SELECT avg(epoch_us(ts) // 1000000) AS middle FROM events)
SELECT events.* FROM events, m WHERE epoch_us(ts) // 1000000 > middle
  OR date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT {_LIMIT_SQL} FROM events, m WHERE epoch_us(ts) // 1000000 > middle)"""
    ),
)
def late_events(t):
    """The same, but the later half comes first: what then comes too late for the watermark no longer counts."""
    earlier, later = _halves(t)
    return _stream(t, (later, earlier), _hours).select("event_type", _micros("start"), _micros("end"), "n", "total")


@query(
    "event_sessions",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL {_GAP_MINUTES} MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS number FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL {_GAP_MINUTES} MINUTE) AS end_us, count(*) AS n FROM s GROUP BY user_id, number
HAVING max(ts) + INTERVAL {_GAP_MINUTES} MINUTE <= (SELECT {_LIMIT_SQL} FROM events)""",
)
def event_sessions(t):
    """Visits of each user, which end after two hours without an event; a visit may go on over a restart."""
    windows = lambda events: sessions(events, "ts", f"{_DELAY_HOURS} hours", f"{_GAP_MINUTES} minutes", ["user_id"], F.count("*").alias("n"))
    return _stream(t, _halves(t), windows).select("user_id", _micros("start"), _micros("end"), "n")
