"""Queries on domain and session state, routing and probe evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagewright.functions import policy as P
from pagewright.operators import ensemble as V
from pagewright.operators import folds as D
from pagewright.plans.derived import ATTEMPTS_SQL, attempts
from pagewright.plans.registry import query
from pagewright.session import checkpoint_root
from pagewright.streaming.folds import first_visits, folded, start_fold, stored_state

_ORDER = ["ts", "attempt_id"]
_BY_USER = "PARTITION BY user_id ORDER BY ts, attempt_id"

_FAILURES_SQL = f"""a AS ({ATTEMPTS_SQL}),
s AS (SELECT *, sum(CASE WHEN blocked THEN 1 ELSE -1 END) OVER ({_BY_USER}) AS s FROM a),
m AS (SELECT *, min(s) OVER ({_BY_USER}) AS low FROM s),
f AS (SELECT user_id, arg_max(s - least(0, low), (ts, attempt_id)) AS failure_count,
  count(*) FILTER (WHERE success AND driver <> 'http_probe') AS browser_success_count, count(*) AS version FROM m GROUP BY 1)"""


@query("domain_failure_fold", f"WITH {_FAILURES_SQL} SELECT user_id, failure_count FROM f")
def domain_failure_fold(t):
    return D.fold_walks(attempts(t.events), "user_id", _ORDER, {"failure_count": D.failure_walk(F.col("blocked"))})


@query(
    "domain_block_rate",
    f"WITH {_FAILURES_SQL} SELECT user_id, failure_count, browser_success_count, CASE WHEN failure_count + browser_success_count = 0 "
    "THEN 0 ELSE round(failure_count / (failure_count + browser_success_count), 3) END AS block_rate FROM f",
)
def domain_block_rate(t):
    return D.domain_profiles(attempts(t.events), "user_id").select(
        "user_id", "failure_count", "browser_success_count", "block_rate"
    )


@query(
    "domain_profile_state",
    f"""WITH {_FAILURES_SQL},
g AS (SELECT user_id, arg_max(driver, (ts, attempt_id)) FILTER (WHERE success) AS last_good_driver,
  arg_max(session_key, (ts, attempt_id)) FILTER (WHERE success) AS last_good_session,
  coalesce(arg_max(path, (ts, attempt_id)) FILTER (WHERE success), 'browser') AS preferred_path,
  coalesce(arg_max(http_trust, (ts, attempt_id)) FILTER (WHERE http_trust IS NOT NULL), false) AS http_trust,
  coalesce(arg_max(reference_text, (ts, attempt_id)) FILTER (WHERE success AND driver <> 'http_probe' AND reference_text <> ''), '') AS reference_text FROM a GROUP BY 1)
SELECT g.*, f.version FROM g JOIN f ON g.user_id = f.user_id""",
)
def domain_profile_state(t):
    return D.domain_profiles(attempts(t.events), "user_id").select(
        "user_id", "last_good_driver", "last_good_session", "preferred_path", "http_trust",
        F.col("browser_reference_text").alias("reference_text"), "version",
    )


@query(
    "session_trust_fold",
    f"""WITH RECURSIVE a AS ({ATTEMPTS_SQL}), n AS (SELECT user_id, blocked, row_number() OVER ({_BY_USER}) AS rn FROM a),
r AS (SELECT user_id, 0 AS rn, 500 AS v FROM (SELECT DISTINCT user_id FROM n)
  UNION ALL SELECT r.user_id, n.rn, CASE WHEN n.blocked THEN greatest(0, v - 150) ELSE least(1000, v + 100) END
  FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1)
SELECT user_id, round(arg_max(v, rn) / 1000.0, 3)::DOUBLE AS trust_score, max(rn) AS attempt_count FROM r GROUP BY 1""",
)
def session_trust_fold(t):
    return D.session_states(attempts(t.events), "user_id").select("user_id", "trust_score", "attempt_count")


@query(
    "session_counters",
    f"""WITH a AS ({ATTEMPTS_SQL}) SELECT user_id, count(*) AS attempt_count, count(*) FILTER (WHERE success) AS success_count,
  count(*) FILTER (WHERE blocked) AS failure_count, arg_max(driver, (ts, attempt_id)) AS last_driver,
  epoch_us(max(ts) FILTER (WHERE blocked)) AS last_challenge_us FROM a GROUP BY 1""",
)
def session_counters(t):
    return D.session_states(attempts(t.events), "user_id").select(
        "user_id", "attempt_count", "success_count", "failure_count", "last_driver",
        F.unix_micros(F.col("last_challenge_at").cast("timestamp")).alias("last_challenge_us"),
    )


@query(
    "last10_values",
    f"""WITH a AS ({ATTEMPTS_SQL}), r AS (SELECT user_id, similarity, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, attempt_id DESC) AS n
  FROM a WHERE similarity IS NOT NULL)
SELECT user_id, string_agg(printf('%.4f', similarity), ' ' ORDER BY n DESC) AS recent FROM r WHERE n <= 10 GROUP BY 1""",
)
def last10_values(t):
    recent = D.last_n(attempts(t.events), "user_id", _ORDER, "similarity", 10)
    shown = F.transform("similarity", lambda x: F.format_string("%.4f", x))
    return recent.select("user_id", F.array_join(shown, " ").alias("recent"))


@query(
    "vendor_first_seen",
    f"""WITH a AS ({ATTEMPTS_SQL}), v AS (SELECT user_id, vendor, min((ts, attempt_id)) AS f FROM a WHERE vendor IS NOT NULL GROUP BY 1, 2)
SELECT user_id, string_agg(vendor, ' ' ORDER BY f) AS vendors FROM v GROUP BY 1""",
)
def vendor_first_seen(t):
    seen = D.first_seen(attempts(t.events), "user_id", _ORDER, "vendor")
    return seen.select("user_id", F.array_join("vendor", " ").alias("vendors"))


@query(
    "first_success_attempt",
    f"""WITH a AS ({ATTEMPTS_SQL}) SELECT attempt_id // 4 AS fetch_id, min(attempt_id) FILTER (WHERE NOT blocked) AS attempt_id,
  arg_min(driver, attempt_id) FILTER (WHERE NOT blocked) AS driver, count(*) AS tried FROM a GROUP BY 1""",
)
def first_success_attempt(t):
    """Four consecutive attempts make one fetch."""
    a = attempts(t.events).select(F.floor(F.col("attempt_id") / 4).alias("fetch_id"), "attempt_id", "driver", "blocked")
    return D.first_success(a, "fetch_id", "attempt_id").select("fetch_id", "attempt.attempt_id", "attempt.driver", "tried")


@query(
    "attempt_traces",
    f"""WITH a AS ({ATTEMPTS_SQL}) SELECT attempt_id // 4 AS fetch_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS completed_us,
  string_agg(driver, '>' ORDER BY attempt_id) AS drivers FROM a GROUP BY 1""",
)
def attempt_traces(t):
    a = attempts(t.events).select(F.floor(F.col("attempt_id") / 4).alias("fetch_id"), "attempt_id", "driver", "blocked", "ts")
    trace = D.attempt_trace(a, "fetch_id", ["attempt_id"], "ts")
    return trace.select(
        "fetch_id",
        F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"),
        F.unix_micros(F.col("completed_at").cast("timestamp")).alias("completed_us"),
        F.array_join(F.transform("attempts", lambda x: x["driver"]), ">").alias("drivers"),
    )


_ROUTES_SQL = f"""WITH {_FAILURES_SQL},
g AS (SELECT user_id, coalesce(arg_max(http_trust, (ts, attempt_id)) FILTER (WHERE http_trust IS NOT NULL), false) AS http_trust,
  coalesce(arg_max(reference_text, (ts, attempt_id)) FILTER (WHERE success AND driver <> 'http_probe' AND reference_text <> ''), '') AS txt FROM a GROUP BY 1),
q AS (SELECT c_custkey, c_custkey % 10 <> 3 AS allow, CASE WHEN c_custkey % 10 = 7 THEN 'cheapest' ELSE 'unlock_first' END AS strategy FROM customer)
SELECT c_custkey, CASE WHEN strategy <> 'unlock_first' OR NOT allow THEN 'browser' WHEN coalesce(http_trust, false) THEN 'http_probe'
  WHEN browser_success_count >= 2 AND txt <> '' THEN 'http_probe_trial' ELSE 'browser' END AS path,
  coalesce(version, 0) AS version
FROM q LEFT JOIN g ON q.c_custkey = g.user_id LEFT JOIN f ON q.c_custkey = f.user_id"""


@query("route_decision", _ROUTES_SQL)
def route_decision(t):
    """Customers as requests on the domain of equal number; unknown domains take the defaults."""
    profiles = D.domain_profiles(attempts(t.events), "user_id").withColumnRenamed("user_id", "domain")
    requests = t.customer.select(
        "c_custkey",
        F.col("c_custkey").alias("domain"),
        (F.col("c_custkey") % 10 != 3).alias("allow"),
        F.when(F.col("c_custkey") % 10 == 7, F.lit("cheapest")).otherwise(F.lit("unlock_first")).alias("strategy"),
    )
    joined = D.with_profile(requests, profiles)
    decision = P.route(
        F.col("strategy"), F.col("allow"), F.col("http_trust"), F.col("browser_success_count"),
        F.col("browser_reference_text"), F.col("version"),
    )
    decided = joined.select("c_custkey", decision.alias("d"))
    return decided.select("c_custkey", "d.path", F.col("d.domain_state_version").alias("version"))


@query(
    "probe_evaluation",
    """SELECT event_id, CASE WHEN blocked THEN 'HTTP probe was blocked' WHEN js THEN 'HTTP probe indicates JavaScript is required'
  WHEN n < 500 THEN 'HTTP probe text too small to trust' WHEN sim IS NULL THEN 'HTTP probe usable but there is no browser reference text yet'
  WHEN sim < 0.75 THEN 'HTTP probe diverged from browser reference (' || printf('%.2f', sim) || ')'
  ELSE 'HTTP probe matched browser reference (' || printf('%.2f', sim) || ')' END AS reason,
  NOT blocked AND NOT js AND n >= 500 AND (sim IS NULL OR sim >= 0.75) AS accepted,
  NOT blocked AND NOT js AND n >= 500 AND coalesce(sim >= 0.75, false) AS trust
FROM (SELECT event_id, event_type = 'error' AS blocked, event_type = 'click' AND event_id % 3 = 0 AS js, event_id % 1000 AS n,
  CASE WHEN event_id % 5 > 0 THEN (event_id % 100 + 0.25) / 100 END::DOUBLE AS sim FROM events)""",
)
def probe_evaluation(t):
    sim = F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 100 + 0.25) / 100)
    verdict = P.evaluate_probe(
        F.repeat(F.lit("x"), (F.col("event_id") % 1000).cast("int")), sim, F.col("event_type") == "error",
        (F.col("event_type") == "click") & (F.col("event_id") % 3 == 0),
    )
    found = t.events.select("event_id", verdict.alias("v"))
    return found.select("event_id", "v.reason", "v.accepted", F.col("v.grant_http_trust").alias("trust"))


@query(
    "ensemble_and_vote",
    """SELECT doc_id, CASE WHEN quality = 1 OR toxic = 0 THEN 'NORMAL' ELSE 'BLOCKED' END AS page_type,
  NOT (quality = 1 OR toxic = 0) AS is_blocked,
  round(CASE WHEN quality = 1 AND toxic = 0 THEN greatest(cq, ct) WHEN quality = 1 THEN cq WHEN toxic = 0 THEN ct ELSE (cq + ct) / 2 END, 3) AS confidence
FROM (SELECT *, 0.61 + (doc_id % 30) / 100.0 AS cq, 0.62 + (doc_id % 25) / 100.0 AS ct FROM labels)""",
)
def ensemble_and_vote(t):
    """Quality and toxicity labels as two classifiers' votes."""

    def vote(blocked, confidence):
        return F.struct(
            blocked.alias("is_blocked"),
            F.when(blocked, F.lit("BLOCKED")).otherwise(F.lit("NORMAL")).alias("page_type"),
            confidence.alias("confidence"),
            F.lit("label").alias("model"),
        )

    votes = F.array(
        vote(F.col("quality") == 0, F.lit(0.61) + F.col("doc_id") % 30 / F.lit(100.0)),
        vote(F.col("toxic") == 1, F.lit(0.62) + F.col("doc_id") % 25 / F.lit(100.0)),
    )
    found = t.labels.select("doc_id", V.consensus(votes).alias("v"))
    return found.select("doc_id", "v.page_type", "v.is_blocked", F.round("v.confidence", 3).alias("confidence"))


def _stream(t, table: str):
    """A table of the data folder as a file stream."""
    schema = getattr(t, table).schema
    # A bracket makes the single file a pattern, which a file stream accepts.
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{t.folder}/{table[:-1]}[{table[-1]}].parquet")


_TRUST_SQL = f"""WITH RECURSIVE a AS ({ATTEMPTS_SQL}), n AS (SELECT user_id, blocked, row_number() OVER ({_BY_USER}) AS rn FROM a),
r AS (SELECT user_id, 0 AS rn, 500 AS v FROM (SELECT DISTINCT user_id FROM n)
  UNION ALL SELECT r.user_id, n.rn, CASE WHEN n.blocked THEN greatest(0, v - 150) ELSE least(1000, v + 100) END
  FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1)
SELECT user_id, arg_max(v, rn) AS trust FROM r GROUP BY 1"""


@query("stream_trust_fold", _TRUST_SQL)
def stream_trust_fold(t):
    """The earlier half of the events in several files, then, after a restart, the later half, then a restart without new rows."""
    folder = f"{checkpoint_root(t.spark)}/streams/{uuid.uuid4().hex}"
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    middle = t.events.agg(F.avg(second)).first()[0]
    for rows in (t.events.filter(second <= middle), t.events.filter(second > middle), None):
        if rows is not None:
            rows.repartition(4, "user_id").write.mode("append").parquet(f"{folder}/inbox")
        stream = t.spark.readStream.schema(t.events.schema).parquet(f"{folder}/inbox")
        states = folded(attempts(stream), "user_id", _ORDER, {"trust": D.trust_walk(F.col("blocked"))})
        start_fold(states, f"{folder}/checkpoint").awaitTermination()
    return stored_state(t.spark, f"{folder}/checkpoint")


@query("stream_dedup_urls", "SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def stream_dedup_urls(t):
    folder = f"{checkpoint_root(t.spark)}/streams/{uuid.uuid4().hex}"
    urls = _stream(t, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"))
    running = (
        first_visits(urls)
        .writeStream.format("parquet")
        .option("path", f"{folder}/urls")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return t.spark.read.schema("url string").parquet(f"{folder}/urls")
