"""Breadth-first crawl over a stored link graph, for many runs at once, as set operations.

One generation of all runs is one round of joins. A run's queue is first come, first served under a page budget that failed pages
give back. With n pages waiting at the start of a generation, the queue of the next one may hold, once page i has been worked off,

    allowance(i) = budget - pages returned before - n + failures up to i

links, and page i puts its new links there until it does. The allowance never falls, so the length of the next queue after page i is

    length(i) = min(allowance(i), length(i - 1) + new links of page i)

which is a running sum less a running minimum. A link that a full queue turns away comes again with a later page that names it; only
then is another round needed, in which it is counted there. A link is turned away in a round only if it is in the end as well, because
lengths only grow from round to round, so the rounds end in the order that one queue would give.

Sums run over pages, then over a page's links, so that the links of one run, or of one page, spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions.urls import base_domain
from pagewright.session import materialize, new_folder

Edges = DataFrame | Callable[[DataFrame], DataFrame]
_NO_LIMIT = 1 << 50
# Rows of one run or page that one task numbers; more of them are numbered bucket by bucket.
_BUCKET = 1 << 16


def _running_sum(rows: DataFrame, by: list[str], place: str, value: Column, out: str, most: int) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the group up to this one in the order of `place`, a whole number.

    Groups have at most `most` different places; beyond a bucket, sums are taken by bucket first.
    """
    if most <= _BUCKET:
        return rows.withColumn(out, F.sum(value).over(W.partitionBy(*by).orderBy(place)))
    rows = rows.withColumns({"__bucket": F.floor(F.col(place) / _BUCKET), "__value": value})
    sums = rows.groupBy(*by, "__bucket").agg(F.sum("__value").alias("__sum"))
    before = W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*by, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = F.sum("__value").over(W.partitionBy(*by, "__bucket").orderBy(place))
    return rows.withColumn("__within", within).join(sums, [*by, "__bucket"]).withColumn(out, F.col("__before") + F.col("__within")).drop(
        "__bucket", "__value", "__sum", "__before", "__within"
    )


def stored_edges(edges: DataFrame, buckets: int) -> DataFrame:
    """`edges(src, pos, dst)` as a table laid out by `src`: a join on it moves the other side only, in every generation."""
    spark = edges.sparkSession
    path = new_folder(spark, "edges")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    edges.write.option("path", path).bucketBy(buckets, "src").sortBy("src").saveAsTable(name)
    return spark.table(name)


def _edges_from(edges: Edges, urls: DataFrame) -> DataFrame:
    return edges if isinstance(edges, DataFrame) else edges(urls.select("url").distinct())


def _candidates(frontier: DataFrame, edges: Edges, visited: DataFrame, most: int) -> DataFrame:
    """Links of fetched pages on the seed's own domain that are new to the run: one row per page and link.

    A page can add at most `most` links, and at most as many of its links can be in the queue already.
    """
    # The domain is looked at once a link has been joined: an equality would become a join key, to be computed for every edge.
    own_domain = F.array_contains(F.array(base_domain(F.col("seed"))), base_domain(F.col("dst")))
    linked = frontier.join(_edges_from(edges, frontier), F.col("url") == F.col("src")).filter(own_domain)
    links = linked.groupBy("run", "ord", "depth", "allowance", F.col("dst").alias("url")).agg(F.min("pos").cast("long").alias("pos"))
    links = links.join(visited.select("run", "url"), ["run", "url"], "left_anti")
    if most <= _BUCKET:
        place = F.row_number().over(W.partitionBy("run", "ord").orderBy("pos", "url"))
        links = links.withColumn("__place", place).filter(F.col("__place") <= 2 * most).drop("__place")
    return links


def _counted(placed: DataFrame, most: int) -> DataFrame:
    """Add to links at their places: `before`, the length of the queue before the page, `taken`, what the page adds, and `rank` on the page."""
    pages = placed.groupBy("run", "ord", "allowance").agg(F.count("*").alias("new"))
    pages = _running_sum(pages, ["run"], "ord", F.col("new"), "upto", most)
    order = W.partitionBy("run").orderBy("ord")
    length = F.col("upto") + F.least(F.lit(0), F.min(F.col("allowance") - F.col("upto")).over(order))
    pages = pages.withColumn("length", length).withColumn("before", F.coalesce(F.lag("length").over(order), F.lit(0)))
    pages = pages.select("run", "ord", "before", (F.col("length") - F.col("before")).alias("taken"))
    # Places on a page are made distinct first: two links may carry one position.
    numbered = placed.withColumn("__one", F.lit(1))
    if most <= _BUCKET:
        numbered = numbered.withColumn("rank", F.row_number().over(W.partitionBy("run", "ord").orderBy("pos", "url")))
    else:
        numbered = _running_sum(numbered, ["run", "ord"], "pos", F.col("__one"), "upto", most)
        same = W.partitionBy("run", "ord", "pos")
        numbered = numbered.withColumn("rank", F.col("upto") - F.count("*").over(same) + F.row_number().over(same.orderBy("url"))).drop("upto")
    return numbered.drop("__one").join(pages, ["run", "ord"])


def _admitted(links: DataFrame, most: int, allowances_differ: bool) -> DataFrame:
    """The next queue: `(run, url, depth, place)`, place from 0 on."""
    at = F.struct("ord", "pos", "depth", "allowance")
    if allowances_differ:
        links = materialize(links, "links")
    placed = links.groupBy("run", "url").agg(F.min(at).alias("at")).select("run", "url", "at.*")
    while allowances_differ:
        placed = materialize(_counted(placed, most), "placed")
        refused = placed.filter("rank > taken").select("run", "url", F.col("allowance").alias("__full"))
        again = links.join(refused, ["run", "url"]).filter(F.col("allowance") > F.col("__full"))
        again = materialize(again.groupBy("run", "url").agg(F.min(at).alias("at")).select("run", "url", "at.*"), "again")
        if again.isEmpty():
            return _queue(placed)
        moved = placed.select("run", "url", "ord", "pos", "depth", "allowance").join(again.select("run", "url"), ["run", "url"], "left_anti")
        placed = moved.unionByName(again)
    return _queue(_counted(placed, most))


def _queue(counted: DataFrame) -> DataFrame:
    return counted.filter("rank <= taken").select("run", "url", (F.col("depth") + 1).alias("depth"), (F.col("before") + F.col("rank") - 1).alias("place"))


def crawl(
    seeds: DataFrame,
    edges: Edges,
    pages: DataFrame,
    max_pages: int | None,
    max_depth: int | None,
    initial: DataFrame | None = None,
    run: str = "seed",
) -> DataFrame:
    """Pages that each run returns: run, seed, url, depth, position (0-based crawl order); without `run` if that is the seed.

    seeds    `seed`, and optionally its own `max_pages` and `max_depth`, which go before the arguments where they are not null
    edges    src, pos, dst: what each page links to (see `links.link_edges`); a stored table, since
             every generation reads it (`stored_edges` lays it out for large frontiers). Or a function that gives
             these rows for a table of `url`s: it is asked for the pages of a generation (see `links.edges_of`)
    pages    url, success: the snapshot; a URL that is not in it counts as failed
    max_pages, max_depth   budget of pages returned, and greatest distance from the seed; None is no limit
    initial  run, url, depth, pos, success: pages fetched before (by pagination); they are not
             returned again, their links start the queue, and they reduce the page budget
    run      column of `seeds` that tells runs apart; a run given several times counts once
    """
    status = pages.select("url", F.col("success").alias("__ok"))

    def limit(name: str, default: int | None) -> Column:
        own = F.col(name).cast("long") if name in seeds.columns else F.lit(None).cast("long")
        return F.coalesce(own, F.lit(default if default is not None else _NO_LIMIT).cast("long"))

    start = seeds.select(
        F.col(run).alias("run"), "seed", limit("max_pages", max_pages).alias("capacity"), limit("max_depth", max_depth).alias("max_depth")
    ).dropDuplicates(["run"])
    start = materialize(start, "runs")
    most, deepest = start.agg(F.max("capacity"), F.max("max_depth")).first()
    most = most or 0
    nothing = F.lit(0).cast("long")
    if initial is None:
        queue = start.select("run", "seed", F.col("seed").alias("url"), nothing.alias("depth"), nothing.alias("place"), "capacity", "max_depth", nothing.alias("base"))
        visited = start.select("run", F.col("seed").alias("url"))
    else:
        known = initial.select(F.col(run).alias("run"), "url", F.col("depth").cast("long").alias("depth"), F.col("pos").cast("long").alias("ord"), "success")
        used = known.groupBy("run").agg(F.countDistinct("url").alias("used"))
        start = start.join(used, "run", "left").withColumn("capacity", F.greatest(F.col("capacity") - F.coalesce("used", nothing), nothing))
        # A budget used up by pagination ends the crawl; a run without initial pages still starts.
        start = materialize(start.filter("capacity > 0").drop("used"), "runs")
        visited = materialize(known.select("run", "url").distinct(), "visited")
        frontier = start.join(known.filter("success").drop("success"), "run").withColumn("allowance", F.col("capacity"))
        first = _admitted(_candidates(frontier.drop("capacity", "max_depth"), edges, visited, most), most, False)
        first = materialize(first, "first")
        # The seed itself comes last where pagination has not fetched it.
        lengths = first.groupBy("run").agg(F.count("*").alias("place"))
        fresh = start.select("run", F.col("seed").alias("url")).join(visited, ["run", "url"], "left_anti").join(first.select("run", "url"), ["run", "url"], "left_anti")
        fresh = fresh.join(lengths, "run", "left").select("run", "url", nothing.alias("depth"), F.coalesce("place", nothing).alias("place"))
        queue = first.unionByName(fresh).join(start, "run").withColumn("base", nothing)

    returned: DataFrame | None = None
    generation = 0
    while True:
        queue = materialize(queue, f"waiting{generation}")
        asked = status.join(queue.select("url").distinct(), "url", "left_semi").dropDuplicates(["url"])
        queue = materialize(queue.join(asked, "url", "left").withColumn("success", F.coalesce("__ok", F.lit(False)) & (F.col("depth") <= F.col("max_depth"))).drop("__ok"), f"queue{generation}")
        visited = queue.select("run", "url") if generation == 0 and initial is None else visited.unionByName(queue.select("run", "url"))
        sums = queue.groupBy("run").agg(F.count("*").alias("waiting"), F.count_if("success").alias("gained"))
        worked = _running_sum(queue, ["run"], "place", F.col("success").cast("long"), "good", most).join(sums, "run")
        allowance = F.col("capacity") - F.col("base") - F.col("waiting") + F.col("place") + 1 - F.col("good")
        # Only fetched pages go on; the budget is never exceeded, as the queue was admitted under it.
        worked = worked.filter(F.col("success") & (F.col("base") + F.col("good") <= F.col("capacity")))
        frontier = materialize(worked.select(
            "run", "seed", "url", "depth", F.col("place").alias("ord"), allowance.alias("allowance"), "capacity", "max_depth",
            (F.col("base") + F.col("gained")).alias("base"), (F.col("base") + F.col("good") - 1).alias("position"),
        ), f"frontier{generation}")
        found = frontier.select("run", "seed", "url", "depth", "position")
        returned = found if returned is None else returned.unionByName(found)
        going = frontier.filter((F.col("depth") < F.col("max_depth")) & (F.col("base") < F.col("capacity")))
        differing = going.groupBy("run").agg((F.max("allowance") > F.min("allowance")).alias("differ")).agg(F.count("*"), F.max("differ")).first()
        if not differing[0]:
            break
        links = _candidates(going.select("run", "seed", "url", "depth", "ord", "allowance"), edges, visited, most)
        following = _admitted(links, most, bool(differing[1]))
        runs = going.groupBy("run").agg(F.first("seed").alias("seed"), F.first("capacity").alias("capacity"), F.first("max_depth").alias("max_depth"), F.first("base").alias("base"))
        queue = following.join(runs, "run")
        generation += 1
    named = [F.col("run").alias(run), "seed"] if run != "seed" else ["seed"]
    return returned.select(*named, "url", F.col("depth").cast("int").alias("depth"), F.col("position").cast("int").alias("position"))


def reach(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Every URL within `max_depth` links of each seed with its distance, without a page budget.

    Seeds are numbered, 64 to a word; a row tells which seeds of a word reach a URL first at this distance. So an edge is followed
    once for all of them, and what is stored and shuffled grows with the edges, not with the seeds times the edges.
    """
    number = F.monotonically_increasing_id()
    named = materialize(seeds.select("seed").distinct().withColumn("number", number), "seeds")
    named = named.select("seed", F.expr("number div 64").alias("word"), F.expr("shiftleft(1L, cast(number % 64 AS INT))").alias("bit"))
    none = F.lit(0).cast("long")
    level = materialize(named.select(F.col("seed").alias("url"), "word", F.col("bit").alias("bits")), "level0")
    levels = [level]
    for depth in range(1, max_depth + 1):
        found = level.join(edges, level["url"] == edges["src"]).select(F.col("dst").alias("url"), "word", "bits", none.alias("seen"))
        for known in levels:
            found = found.unionByName(known.select("url", "word", none.alias("bits"), F.col("bits").alias("seen")))
        sums = found.groupBy("url", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("seen").alias("seen"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not("seen"))
        level = materialize(sums.select("url", "word", fresh.alias("bits")).where("bits <> 0"), f"level{depth}")
        if level.isEmpty():
            break
        levels.append(level)
    reached = None
    for depth, level in enumerate(levels):
        own = level.join(named, "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        own = own.select("seed", "url", F.lit(depth).alias("depth"))
        reached = own if reached is None else reached.unionByName(own)
    return reached


def unvisited(pages: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose URL was not visited."""
    return pages.join(visited.select(url), url, "left_anti")
