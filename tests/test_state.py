import difflib
import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from pagewright.operators import folds as D
from pagewright.streaming.folds import _stretches, folded, start_fold, stored_state

SCHEMA = "session_key string, ts timestamp, attempt_id bigint, blocked boolean, driver string"


def history(rng, n, hot_share=0.5):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    return [
        (
            "hot" if rng.random() < hot_share else f"k{rng.randint(0, 20)}",
            start + datetime.timedelta(seconds=rng.randint(0, 10**6)), i, rng.random() < 0.4, f"d{i % 3}",
        )
        for i in range(n)
    ]


def by_hand(rows):
    states = {}
    for key, _, _, blocked, driver in sorted(rows, key=lambda r: (r[1], r[2])):
        s = states.setdefault(key, {"trust": 0.5, "failures": 0, "n": 0})
        s["n"] += 1
        s["driver"] = driver
        if blocked:
            s["trust"], s["failures"] = max(0.0, round(s["trust"] - 0.15, 3)), s["failures"] + 1
        else:
            s["trust"], s["failures"] = min(1.0, round(s["trust"] + 0.1, 3)), max(0, s["failures"] - 1)
    return states


def test_folds_equal_loop_with_a_hot_key(spark):
    rows = history(random.Random(1), 5000)
    want = by_hand(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    walks = {"trust": D.trust_walk(F.col("blocked")), "failures": D.failure_walk(F.col("blocked"))}
    got = D.fold_walks(df, "session_key", ["ts", "attempt_id"], walks, partitions=7).collect()
    assert {r.session_key: (r.trust / 1000, r.failures) for r in got} == {k: (s["trust"], s["failures"]) for k, s in want.items()}
    states = {r.session_key: r for r in D.session_states(df).collect()}
    for key, s in want.items():
        assert (states[key].trust_score, states[key].attempt_count, states[key].last_driver) == (s["trust"], s["n"], s["driver"])


def test_small_batches_do_not_change_the_fold(spark):
    rows = history(random.Random(2), 600)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = D.fold_walks(df, "session_key", ["ts", "attempt_id"], {"trust": D.trust_walk(F.col("blocked"))}, partitions=3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    assert {r.session_key: r.trust / 1000 for r in got} == {k: s["trust"] for k, s in by_hand(rows).items()}


def test_composition_of_clamped_shifts():
    rng = np.random.default_rng(0)
    step = rng.integers(-200, 200, 57)
    run = np.sort(rng.integers(0, 6, 57))
    keys, (d, lo, hi) = D._reduce_runs(run, (step, np.full(57, 0), np.full(57, 1000)))
    for i, key in enumerate(keys):
        for start in (0, 400, 1000):
            value = start
            for s in step[run == key]:
                value = min(1000, max(0, value + s))
            assert min(max(start + d[i], lo[i]), hi[i]) == value


def test_stored_examples(spark):
    import datetime

    cases = {"mediamarkt": "bbbbo", "razorpay": "oooo", "linkedin": "oo", "glassdoor": "b", "adobe": "o" * 17}
    rows = [
        (k, datetime.datetime(2024, 1, 1, 0, i), i, c == "b", "d") for k, outcomes in cases.items() for i, c in enumerate(outcomes)
    ]
    got = {r.session_key: r.trust_score for r in D.session_states(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"mediamarkt": 0.1, "razorpay": 0.9, "linkedin": 0.7, "glassdoor": 0.35, "adobe": 1.0}


def test_burned_session_starts_anew(spark):
    import datetime

    at = lambda i: datetime.datetime(2024, 1, 1, 0, i)
    rows = [("a", at(0), 0, True, "x", True), ("a", at(1), 1, False, "y", False), ("b", at(0), 2, False, "x", False), ("b", at(1), 3, True, "y", True)]
    got = {r.session_key: r for r in D.session_states(spark.createDataFrame(rows, SCHEMA + ", burn boolean")).collect()}
    assert (got["a"].trust_score, got["a"].attempt_count, got["a"].burned) == (0.6, 1, False)
    assert (got["b"].trust_score, got["b"].attempt_count, got["b"].burned) == (0.45, 2, True)


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(history(random.Random(4), 900), key=lambda r: (r[1], r[2]))
    inbox, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    walks = {"trust": D.trust_walk(F.col("blocked")), "open": D.failure_walk(F.col("blocked"))}

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        query = start_fold(folded(stream, "session_key", ["ts", "attempt_id"], walks), checkpoint)
        query.awaitTermination()
        return {r.session_key: r.trust / 1000 for r in stored_state(spark, checkpoint).collect()}

    spark.createDataFrame(rows[:500], SCHEMA).repartition(3).write.mode("append").parquet(inbox)
    assert run() == {k: s["trust"] for k, s in by_hand(rows[:500]).items()}
    assert run() == {k: s["trust"] for k, s in by_hand(rows[:500]).items()}  # a restart without new rows
    spark.createDataFrame(rows[500:], SCHEMA).repartition(2).write.mode("append").parquet(inbox)
    assert run() == {k: s["trust"] for k, s in by_hand(rows).items()}


def test_idle_keys_leave_the_state(spark, tmp_path):
    import datetime

    at = lambda i: datetime.datetime(2024, 1, 1, i)
    inbox, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    seen = []
    for rows in ([("a", at(0), 0, False, "d")], [("b", at(9), 1, True, "d")], [("b", at(10), 2, True, "d"), ("a", at(10), 3, True, "d")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        states = folded(stream, "session_key", ["ts", "attempt_id"], {"trust": D.trust_walk(F.col("blocked"))}, idle=3600)
        start_fold(states, checkpoint).awaitTermination()
        seen.append({r.session_key: r.trust for r in stored_state(spark, checkpoint).collect()})
    assert spark.conf.get(provider) == before
    # "a" was removed while it was idle, and started anew; "b" was seen again within the hour.
    assert seen[0] == {"a": 600} and seen[1] == {"b": 350} and seen[2] == {"b": 200, "a": 350}, seen


def test_profile_and_session_lookup(spark):
    profiles = spark.createDataFrame([("a.com", "browser", 2)], "domain string, preferred_path string, browser_success_count int")
    requests = spark.createDataFrame([("a.com",), ("b.com",)], "domain string")
    got = {r.domain: r.browser_success_count for r in D.with_profile(requests, profiles).collect()}
    assert got == {"a.com": 2, "b.com": 0}
    sessions = spark.createDataFrame([("x", 0.9, False), ("y", 0.1, True)], "session_key string, trust_score double, burned boolean")
    wanted = spark.createDataFrame([("x",), ("y",), ("z",)], "session_key string")
    got = {r.session_key: (r.trust_score, r.is_new_session) for r in D.with_session(wanted, sessions).collect()}
    assert got == {"x": (0.9, False), "y": (0.5, True), "z": (0.5, True)}


def test_keys_of_one_span_are_reduced_together(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(6)]), datetime(2024, 1, rng.randint(1, 3), rng.randint(0, 23)), i, rng.random() < 0.4) for i in range(300)]
    events = spark.createDataFrame(rows, "user long, ts timestamp, id long, blocked boolean")
    walk = D.trust_walk(F.col("blocked"))
    for groups in (1, 4):
        found = _stretches(events, "user", ["ts", "id"], {"trust": walk}, "day", groups).collect()
        got = {}
        for r in sorted(found, key=lambda r: (r.ts, r.id)):
            got[r.user] = min(max(got.get(r.user, walk.start) + r.trust_d, r.trust_lo), r.trust_hi)
        want = {}
        for user, _, _, blocked in sorted(rows, key=lambda r: (r[1], r[2])):
            value = want.get(user, 500)
            want[user] = max(0, value - 150) if blocked else min(1000, value + 100)
        assert got == want
        assert len([r for r in found if r.user is not None]) == len({(u, t.date()) for u, t, *_ in rows if u is not None})
