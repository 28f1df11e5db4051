"""Mixing overlapping sources to target weights as a min-cost flow.

Documents are summed up by membership pattern, the set of sources that they belong to. Patterns are
routed to source quotas: the r-th repetition of a pattern has the capacity of the pattern's size and a cost
that grows with r, so nothing is repeated again while something that could serve the same quota
has been repeated less. Whole repetitions go to every document of a pattern, the rest to the first ones
in a seeded order.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.components import connected_components
from pagewright.session import materialize, release

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 42
# The seeded order is cut twice into this many bins, so that only documents of one bin in a million
# are ever put in order one by one.
BIN_BITS = 10
# A mix further than this share of its amount from it is filled again, a few times.
GAP = 0.002
# Each filling takes documents up to so many times more than all of their pattern are taken.
FILLINGS = (1, 1, 1, 2, 2, 3)


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """`sizes(source, source_size)` -> with `target`: the total of all sizes, shared by weight.

    Sources in order of code points, null last, take the weights in turn. A target stops at
    `repeats` times the source's size; the excess is shared again by weight until none is above.
    One row per source, so the ordered sums are short.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights)))).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    # In order of the level at which a source stops, all before a source that does not stop have stopped.
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("stopped", F.col("cap") <= F.col("level") * F.col("weight"))
    shared = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    return rows.withColumn("shared", shared).select(
        "source", "source_size", F.when(F.col("stopped"), F.col("cap")).otherwise(F.col("shared") * F.col("weight")).alias("target")
    )


def _route(edges: pd.DataFrame, repeats: int) -> pd.DataFrame:
    """Flow of one connected part of the graph, `(pattern, source, size, quota)` per edge.

    Costs depend on the repetition alone, so shortest paths are those of the lowest repetition that is
    left, and among them breadth-first ones; earlier routes are moved to other sources if need be.
    """
    sizes = edges.groupby("pattern", sort=True)["size"].first().to_dict()
    quota = edges.groupby("source", sort=True)["quota"].first().to_dict()
    serves: dict = {p: sorted(g) for p, g in edges.groupby("pattern")["source"]}
    users: dict = {s: sorted(g) for s, g in edges.groupby("source")["pattern"]}
    flow = {(p, s): 0 for p, s in zip(edges["pattern"], edges["source"])}
    for _ in range(repeats):
        left = dict(sizes)
        while True:
            came: dict = {}
            queue = deque(("p", p) for p in sizes if left[p] > 0)
            came.update({node: None for node in queue})
            end = None
            while queue and end is None:
                side, name = node = queue.popleft()
                steps = [("s", s) for s in serves[name]] if side == "p" else [("p", p) for p in users[name] if flow[p, name] > 0]
                for step in steps:
                    if step not in came:
                        came[step] = node
                        if step[0] == "s" and quota[step[1]] > 0:
                            end = step
                            break
                        queue.append(step)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            backward = [flow[b[1], a[1]] for a, b in zip(path[1::2], path[2::2])]
            amount = min([left[path[0][1]], quota[end[1]], *backward])
            for a, b in zip(path[::2], path[1::2]):
                flow[a[1], b[1]] += amount
            for a, b in zip(path[1::2], path[2::2]):
                flow[b[1], a[1]] -= amount
            left[path[0][1]] -= amount
            quota[end[1]] -= amount
    return pd.DataFrame([(p, s, f) for (p, s), f in flow.items()], columns=["pattern", "source", "flow"])


def routed(patterns: DataFrame, quotas: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """`patterns(pattern, sources, size)` and `quotas(source, quota)` -> `(pattern, source, flow)`.

    Each connected part of the graph of patterns and sources is routed in a task of its own; its size is the
    number of patterns and sources in it and does not depend on the number of documents.
    """
    edges = patterns.select("pattern", "size", F.explode("sources").alias("source")).join(quotas, "source")
    edges = materialize(edges, "flow-edges")
    if patterns.where(F.size("sources") > 1).isEmpty():
        parts = edges.withColumn("part", F.concat(F.lit("s"), "source"))
    else:
        links = edges.select(F.concat(F.lit("p"), "pattern").alias("u"), F.concat(F.lit("s"), "source").alias("v"))
        roots = connected_components(links)
        parts = edges.join(roots, F.concat(F.lit("s"), "source") == roots["node"]).withColumn("part", F.col("root"))

    def route(part: pd.DataFrame) -> pd.DataFrame:
        return _route(part, repeats)

    return parts.select("part", "pattern", "source", "size", "quota").groupBy("part").applyInPandas(
        route, "pattern string, source string, flow long"
    )


def _cut(rows: DataFrame, part: str, rest: str) -> DataFrame:
    """`(pattern, cut_<part>, rest_<part>)`: the bin in which the running size passes `rest`, and what is left there.

    No row for a pattern whose rows all fit.
    """
    sums = rows.groupBy("pattern", part, rest).agg(F.sum("size").alias("size"))
    order = Window.partitionBy("pattern").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    passed = (F.col("before") <= F.col(rest)) & (F.col(rest) < F.col("before") + F.col("size"))
    return sums.where(passed).select(
        "pattern", F.col(part).alias(f"cut_{part}"), (F.col(rest) - F.col("before")).alias(f"rest_{part}")
    )


def _place() -> Column:
    return F.struct("order", "key", "size")


def _cuts(dealt: DataFrame, plan: DataFrame, fits: Column) -> DataFrame:
    """One filling as a small table: where the first rows of a pattern that `fits` end, in order, up to what is open.

    The running size is taken over bins first, and over single documents in one bin of the second kind only.
    """
    rows = dealt.join(plan.where("open > 0"), "pattern").where(fits & (F.col("size") <= F.col("open")))
    first = materialize(_cut(rows, "bin", "open"), "bins")
    inside = rows.join(first, "pattern").where(F.col("bin") == F.col("cut_bin"))
    second = materialize(_cut(inside, "sub", "rest_bin"), "bins")
    inside = inside.join(second, "pattern").where(F.col("sub") == F.col("cut_sub"))
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy(_place()))
    last = inside.withColumn("upto", upto).where(F.col("upto") <= F.col("rest_sub")).groupBy("pattern").agg(F.max(_place()).alias("last"))
    cuts = plan.join(first, "pattern", "left").join(second, "pattern", "left").join(last, "pattern", "left")
    return materialize(cuts.select("pattern", "whole", "open", "cut_bin", "cut_sub", "last"), "cuts")


def _fits(level: int, repeats: int) -> Column:
    return (F.col("more") < level) & (F.col("whole") + F.col("more") < repeats) & (F.col("size") > 0)


def _filled(dealt: DataFrame, cuts: DataFrame, fits: Column) -> DataFrame:
    """`dealt` after one more filling: `more` is one higher where a row is `chosen`, which follows from the row and `cuts`."""
    in_last = (F.col("sub") < F.col("cut_sub")) | (
        (F.col("sub") == F.col("cut_sub")) & F.coalesce(_place() <= F.col("last"), F.lit(False))
    )
    ahead = F.when(F.col("cut_bin").isNull(), True).otherwise(
        (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & in_last)
    )
    chosen = F.coalesce(fits & (F.col("size") <= F.col("open")) & ahead, F.lit(False))
    marked = dealt.join(cuts, "pattern").withColumn("chosen", chosen)
    return marked.withColumn("more", F.col("more") + F.col("chosen").cast("int")).select(*[c for c in dealt.columns if c != "chosen"], "chosen")


def _dealt(rows: DataFrame, seed: int) -> DataFrame:
    order = F.xxhash64(F.lit(seed), F.col("key"))
    return rows.withColumns({
        "order": order, "bin": F.shiftrightunsigned(order, 64 - BIN_BITS),
        "sub": F.shiftrightunsigned(order, 64 - 2 * BIN_BITS).bitwiseAND(F.lit((1 << BIN_BITS) - 1)), "more": F.lit(0),
    })


def _planned(rows: DataFrame, amounts: DataFrame, seed: int, repeats: int) -> tuple[DataFrame, DataFrame, list[tuple[DataFrame, int]]]:
    """Rows after all fillings, the plan, and the fillings as `(cuts, level)`; the last two have a row for each pattern."""
    plan = materialize(amounts.select(
        "pattern", "amount", F.expr("CASE WHEN total > 0 THEN amount DIV total ELSE 0 END").alias("whole"),
        F.expr("CASE WHEN total > 0 THEN amount % total ELSE 0 END").alias("open"),
    ), "amounts")
    dealt, fillings = _dealt(rows, seed), []
    for n, level in enumerate(FILLINGS):
        if plan.where(F.col("open") > F.col("amount") * GAP).isEmpty():
            break
        again = _fits(level, repeats)
        fillings.append((_cuts(dealt, plan, again), level))
        before, dealt = dealt, materialize(_filled(dealt, fillings[-1][0], again), "dealt")
        used = dealt.where("chosen").groupBy("pattern").agg(F.sum("size").alias("used"))
        plan = plan.join(used, "pattern", "left").withColumn("open", F.col("open") - F.coalesce("used", F.lit(0))).drop("used")
        plan = materialize(plan, "plan")
        if n:
            release(before)
    return dealt, plan, fillings


def selected(rows: DataFrame, amounts: DataFrame, seed: int = SEED, repeats: int = MAX_REPEATS) -> DataFrame:
    """`rows(key, pattern, size)` and `amounts(pattern, total, amount)` -> rows with `taken`.

    Every document is taken `amount div total` times. The rest of the amount goes to one more repetition of the
    first documents in the order of a hash of seed and key. A document that does not fit ends a filling; further
    fillings take the first of those that still fit, at last once more than all others, but never more than `repeats`
    times. Same rows, same choice; rows that repeat key and size are chosen together.
    """
    dealt, plan, _ = _planned(rows, amounts, seed, repeats)
    taken = F.col("size") * (F.col("whole") + F.col("more"))
    return dealt.join(plan, "pattern").select(*rows.columns, taken.cast("long").alias("taken"))


def _named(source: Column) -> Column:
    """Sources as non-null names: a null source counts as one more."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("?"))


def _amounts(docs: DataFrame, key: str, text: str, source: str, sources: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows `(key, own, pattern, size)`, `(pattern, total, amount)`, and targets `(own, source, source_size, target)`."""
    own = _named(F.col(source))
    member = F.array(own)
    if sources is not None:
        more = F.transform(F.coalesce(F.col(sources), F.array().cast("array<string>")), _named)
        member = F.array_sort(F.array_union(member, more))
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), own.alias("own"), member.alias("sources"), word_count(F.col(text)).alias("size"))
    rows = materialize(rows.withColumn("pattern", F.to_json("sources")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes).withColumn("own", _named(F.col("source"))), "targets")
    patterns = materialize(rows.groupBy("pattern", "sources").agg(F.sum("size").alias("size")), "patterns")
    flows = routed(patterns, targets.select(F.col("own").alias("source"), F.round("target").cast("long").alias("quota")))
    amounts = flows.groupBy("pattern").agg(F.sum("flow").alias("amount")).join(patterns.select("pattern", F.col("size").alias("total")), "pattern")
    return rows.select("key", "own", "pattern", "size"), amounts, targets


def mixed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", sources: str | None = None, seed: int = SEED
) -> DataFrame:
    """`(key, size, source_size, target, taken)` for every row of `docs`.

    `sources` names a column of arrays with all sources that a document may count for (its own is
    added); without it, each document serves its own source only. Null texts have size zero and are
    taken zero times. No document is taken more than `MAX_REPEATS` times. Empty tables give empty results.
    """
    rows, amounts, targets = _amounts(docs, key, text, source, sources)
    taken = selected(rows, amounts, seed)
    return taken.join(targets.select("own", "source_size", "target"), "own").select(
        F.col("key").alias(key), "size", "source_size", "target", "taken"
    )


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """`docs` as the mix takes them: each row as many times as it is taken, those not taken left out.

    Rows that share key, source and size are chosen together; others of the same key, null included, are taken as
    often as they themselves are.
    """
    rows, amounts, _ = _amounts(docs, key, text, source, None)
    _, plan, fillings = _planned(rows, amounts, seed, MAX_REPEATS)
    # What is taken follows from a row and the small tables of the fillings, so that texts stay where they are.
    own = docs.select(
        F.struct("*").alias("in"), F.col(key).alias("key"), F.to_json(F.array(_named(F.col(source)))).alias("pattern"), word_count(F.col(text)).alias("size")
    )
    dealt = _dealt(own, seed)
    for cuts, level in fillings:
        dealt = _filled(dealt, cuts, _fits(level, MAX_REPEATS))
    times = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0).cast("int")
    copies = dealt.join(plan.select("pattern", "whole"), "pattern").withColumn("times", times).where("times > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("in.*")
