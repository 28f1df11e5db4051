"""Order-dependent state per key, computed without putting a key into one task.

The reference-style counters ("up by a, down by b, never below x or above y") look
sequential, but each step is a clamped shift f(v) = min(max(v + d, lo), hi), and two
clamped shifts in a row are one again. So the history is range-partitioned by
(key, order): a hot key spreads over many tasks, each task reduces its stretch of a key
to one (d, lo, hi) triple, and the few triples per key are applied in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import signals as S
from pagewright.functions.text import nvl

_UNBOUNDED = 1 << 40


@dataclass(frozen=True)
class Walk:
    """An integer counter: start value, bounds, and the step each event makes."""

    step: Column
    start: int = 0
    floor: int = -_UNBOUNDED
    ceiling: int = _UNBOUNDED


def _then(first, second):
    """Compose clamped shifts (arrays of d, lo, hi): `first`, then `second`."""
    d, lo, hi = second
    return first[0] + d, np.clip(first[1] + d, lo, hi), np.clip(first[2] + d, lo, hi)


def _reduce_runs(run: np.ndarray, shifts):
    """Compose neighbouring shifts of equal run number, in order, by repeated pairing."""
    while len(run) > 1 and (run[1:] == run[:-1]).any():
        index = np.arange(len(run))
        starts = np.r_[True, run[1:] != run[:-1]]
        place = index - np.maximum.accumulate(np.where(starts, index, 0))
        left = np.flatnonzero(place % 2 == 0)
        right = np.minimum(left + 1, len(run) - 1)
        paired = (right > left) & (run[right] == run[left])
        both = _then(tuple(x[left] for x in shifts), tuple(x[right] for x in shifts))
        shifts = tuple(np.where(paired, b, x[left]) for b, x in zip(both, shifts))
        run = run[left]
    return run, shifts


def _stretch_reducer(key: str, order: list[str], bounds: list[tuple[str, int, int]]):
    """Per sorted partition: one row per key with the first order values and the composed shifts."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: pd.DataFrame | None = None
        for batch in batches:
            if batch.empty:
                continue
            keys = batch[key].to_numpy()
            run = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
            heads = batch[[key, *order]].iloc[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])].reset_index(drop=True)
            for name, floor, ceiling in bounds:
                step = batch[name].to_numpy(dtype=np.int64)
                _, shifts = _reduce_runs(run, (step, np.full_like(step, floor), np.full_like(step, ceiling)))
                for part, values in zip(("d", "lo", "hi"), shifts):
                    heads[f"{name}_{part}"] = values
            if carried is not None:
                if carried[key].iloc[0] == heads[key].iloc[0]:
                    for name, *_ in bounds:
                        columns = [f"{name}_{part}" for part in ("d", "lo", "hi")]
                        joined = _then(carried.loc[0, columns].to_numpy(np.int64), heads.loc[0, columns].to_numpy(np.int64))
                        heads.loc[0, columns] = [int(x) for x in joined]
                    heads.loc[0, order] = carried.loc[0, order]
                else:
                    yield carried
            if len(heads) > 1:
                yield heads.iloc[:-1]
            carried = heads.iloc[-1:].reset_index(drop=True)
        if carried is not None:
            yield carried

    return reduce


def fold_walks(
    events: DataFrame,
    key: str,
    order: list[str],
    walks: dict[str, Walk],
    partitions: int | None = None,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Final value of each walk per key: one row (key, *walks).

    `previous` holds values of an earlier fold (key, *walks) to go on from; its keys are kept.
    """
    rows = events.select(key, *order, *[w.step.cast("bigint").alias(n) for n, w in walks.items()])
    placed = rows.repartitionByRange(partitions, key, *order) if partitions else rows.repartitionByRange(key, *order)
    schema = T.StructType([rows.schema[c] for c in (key, *order)])
    for name in walks:
        for part in ("d", "lo", "hi"):
            schema = schema.add(f"{name}_{part}", T.LongType())
    bounds = [(n, w.floor, w.ceiling) for n, w in walks.items()]
    stretches = placed.sortWithinPartitions(key, *order).mapInPandas(_stretch_reducer(key, order, bounds), schema)
    listed = stretches.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*order, *[c for c in schema.names if c not in (key, *order)]))).alias("parts")
    )


    if previous is not None:
        renamed = previous.select(key, *[F.col(n).alias(f"__from_{n}") for n in walks])
        listed = listed.join(renamed, key, "full").withColumn(
            "parts", F.coalesce("parts", F.array().cast(listed.schema["parts"].dataType))
        )

    def final(name: str, walk: Walk) -> Column:
        start = F.lit(walk.start).cast("bigint")
        if previous is not None:
            start = F.coalesce(F.col(f"__from_{name}"), start)

        def apply(v: Column, p: Column) -> Column:
            return F.least(F.greatest(v + p[f"{name}_d"], p[f"{name}_lo"]), p[f"{name}_hi"])

        return F.aggregate("parts", start, apply).alias(name)

    return listed.select(key, *[final(n, w) for n, w in walks.items()])


def failure_walk(failed: Column) -> Walk:
    """Outstanding failures: +1 per failure, -1 per success, not below zero."""
    return Walk(F.when(failed, 1).otherwise(-1), floor=0)


def trust_walk(blocked: Column) -> Walk:
    """Session trust in thousandths."""
    return Walk(
        F.when(blocked, -S.TRUST_DOWN).otherwise(S.TRUST_UP), start=S.TRUST_START, floor=0, ceiling=S.TRUST_MAX
    )


def block_rate(failures: Column, successes: Column) -> Column:
    total = failures + successes
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.round(failures / total, 3))


def _latest(value: Column, order: list[str], where: Column) -> Column:
    return F.max_by(value, F.when(where, F.struct(*order)))


def last_n(events: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """The last `n` non-null values per key in order. The rank filter is applied before the shuffle too."""
    newest = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    ranked = events.filter(F.col(value).isNotNull()).select(key, *order, value)
    top = ranked.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= n)
    return top.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__rank")).alias("r"), F.col(value).alias("v")))), lambda x: x["v"]).alias(value)
    )


def first_seen(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Distinct non-empty values per key in the order of their first appearance."""
    firsts = (
        events.filter(nvl(F.col(value)) != "")
        .groupBy(key, value)
        .agg(F.min(F.struct(*order)).alias("__first"))
    )
    return firsts.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__first", value))), lambda x: x[value]).alias(value)
    )


def session_states(attempts: DataFrame, key: str = "session_key", order: tuple[str, ...] = ("ts", "attempt_id")) -> DataFrame:
    """Session state after all attempts.

    `attempts`: key, order columns (the first is the time), blocked, driver and optionally
    burn. A burned session starts anew with the next attempt.
    """
    order = list(order)
    rows = attempts
    if "burn" in attempts.columns:
        stamp = F.struct(*order)
        ends = attempts.groupBy(key).agg(F.max(stamp).alias("__last"))
        burns = attempts.filter("burn").select(key, stamp.alias("__burn")).join(ends, key).filter("__burn < __last")
        rows = (
            attempts.join(burns.groupBy(key).agg(F.max("__burn").alias("__burn")), key, "left")
            .filter(F.col("__burn").isNull() | (stamp > F.col("__burn")))
            .drop("__burn")
        )
    blocked = F.col("blocked")
    burned = _latest(F.col("burn"), order, blocked) if "burn" in attempts.columns else F.bool_or(F.lit(False))
    counts = rows.groupBy(key).agg(
        F.count("*").alias("attempt_count"),
        F.count_if(~blocked).alias("success_count"),
        F.count_if(blocked).alias("failure_count"),
        _latest(F.col("driver"), order, F.lit(True)).alias("last_driver"),
        F.max(F.when(blocked, F.col(order[0]))).alias("last_challenge_at"),
        F.max(order[0]).alias("updated_at"),
        F.coalesce(burned, F.lit(False)).alias("burned"),
    )
    trust = fold_walks(rows, key, order, {"__trust": trust_walk(blocked)})
    return counts.join(trust, key).withColumn("trust_score", F.col("__trust") / F.lit(1000.0)).drop("__trust")


def domain_profiles(events: DataFrame, key: str = "domain", order: tuple[str, ...] = ("ts", "attempt_id")) -> DataFrame:
    """Domain profile after all booked outcomes.

    `events`: key, order columns (the first is the time), success, driver, session_key, path,
    vendor, similarity, http_trust, reference_text.
    """
    order = list(order)
    success = F.col("success")
    by_browser = success & (F.col("driver") != "http_probe")
    good = F.struct("driver", F.col("session_key").alias("session"), "path")
    # Text stays out of the aggregation: only the place of the winning row is sought.
    sums = events.groupBy(key).agg(
        F.count("*").alias("version"),
        F.count_if(by_browser).alias("browser_success_count"),
        _latest(good, order, success).alias("__good"),
        _latest(F.col("http_trust"), order, F.col("http_trust").isNotNull()).alias("__trust"),
        F.max(F.when(by_browser & (nvl(F.col("reference_text")) != ""), F.struct(*order))).alias("__text_at"),
        F.max(order[0]).alias("last_updated_at"),
    )
    texts = events.filter(by_browser & (nvl(F.col("reference_text")) != "")).select(
        key, F.struct(*order).alias("__text_at"), F.col("reference_text").alias("browser_reference_text")
    )
    failures = fold_walks(events, key, order, {"failure_count": failure_walk(~success)})
    hints = first_seen(events, key, order, "vendor").withColumnRenamed("vendor", "vendor_hints")
    recent = last_n(
        events.filter(success).withColumn("similarity", F.round("similarity", 4)), key, order, "similarity",
        S.RECENT_SIMILARITIES,
    ).withColumnRenamed("similarity", "recent_similarity_scores")
    joined = (
        sums.join(failures, key)
        .join(hints, key, "left")
        .join(recent, key, "left")
        .join(texts, [key, "__text_at"], "left")
    )
    return joined.select(
        key,
        F.coalesce(F.col("__good.path"), F.lit("browser")).alias("preferred_path"),
        F.col("__good.driver").alias("last_good_driver"),
        F.col("__good.session").alias("last_good_session"),
        F.coalesce("__trust", F.lit(False)).alias("http_trust"),
        block_rate(F.col("failure_count"), F.col("browser_success_count")).alias("block_rate"),
        F.coalesce("vendor_hints", F.array().cast("array<string>")).alias("vendor_hints"),
        F.lit("").alias("notes"),
        "version",
        "browser_success_count",
        "failure_count",
        F.coalesce("recent_similarity_scores", F.array().cast("array<double>")).alias("recent_similarity_scores"),
        nvl(F.col("browser_reference_text")).alias("browser_reference_text"),
        "last_updated_at",
    )


def first_success(attempts: DataFrame, key: str, order: str, blocked: str = "blocked") -> DataFrame:
    """The attempt a fallback chain ends with: the first one, in order, that was not blocked."""
    value = F.struct(*[c for c in attempts.columns if c != key])
    place = F.when(~F.col(blocked), F.col(order))
    return attempts.groupBy(key).agg(F.min_by(value, place).alias("attempt"), F.count("*").alias("tried"))


def attempt_trace(attempts: DataFrame, key: str, order: list[str], at: str) -> DataFrame:
    """Ordered attempts of one fetch. A fetch makes a handful of attempts, so a trace is small."""
    return attempts.groupBy(key).agg(
        F.min(at).alias("started_at"),
        F.max(at).alias("completed_at"),
        F.array_sort(F.collect_list(F.struct(*order, *[c for c in attempts.columns if c not in (key, *order)]))).alias(
            "attempts"
        ),
    )


def with_profile(requests: DataFrame, profiles: DataFrame, domain: str = "domain") -> DataFrame:
    """Attach each request's domain profile; an unknown domain gets the defaults."""
    defaults = {
        "preferred_path": F.lit("browser"), "http_trust": F.lit(False), "block_rate": F.lit(0.0),
        "vendor_hints": F.array().cast("array<string>"), "notes": F.lit(""), "version": F.lit(0),
        "browser_success_count": F.lit(0), "failure_count": F.lit(0),
        "recent_similarity_scores": F.array().cast("array<double>"), "browser_reference_text": F.lit(""),
    }
    joined = requests.join(profiles, domain, "left")
    for name, value in defaults.items():
        if name in profiles.columns:
            joined = joined.withColumn(name, F.coalesce(F.col(name), value))
    return joined


def with_session(requests: DataFrame, sessions: DataFrame, key: str = "session_key") -> DataFrame:
    """Attach each request's session; a missing or burned one is replaced by a fresh session."""
    usable = sessions.filter(~F.col("burned"))
    fresh = {
        "trust_score": F.lit(S.TRUST_START / 1000), "attempt_count": F.lit(0), "success_count": F.lit(0),
        "failure_count": F.lit(0), "burned": F.lit(False), "locale": F.lit("en-US"),
        "timezone_id": F.lit("America/New_York"), "viewport_family": F.lit("desktop"),
    }
    joined = requests.join(usable.withColumn("__known", F.lit(True)), key, "left")
    for name, value in fresh.items():
        if name in sessions.columns:
            joined = joined.withColumn(name, F.coalesce(F.col(name), value))
    return joined.withColumn("is_new_session", F.col("__known").isNull()).drop("__known")


def set_proxy_affinity(sessions: DataFrame, changes: DataFrame, key: str = "session_key", order: str = "at") -> DataFrame:
    """Apply the latest proxy of each known session; unknown keys are ignored."""
    latest = changes.groupBy(key).agg(
        F.max_by(F.struct(F.col("proxy_id").alias("id")), F.col(order)).alias("__proxy"), F.max(order).alias("__at")
    )
    joined = sessions.join(latest, key, "left")
    return (
        joined.withColumn("proxy_affinity", F.when(F.col("__at").isNotNull(), F.col("__proxy.id")).otherwise(F.col("proxy_affinity")))
        .withColumn("updated_at", F.coalesce("__at", "updated_at"))
        .drop("__proxy", "__at")
    )
