"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a fixed set of pivots, nearest first, and filed in
the inverted files of its first pivots. A query reads the files of its own first pivots, ranks what it finds by the
footrule distance of the two orders, and compares the best part of each file exactly.
Files are split into shards and queries into blocks of bounded size, so no task grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import materialize

PIVOTS = 128
# Pivots that count in an order; all later ones have the same rank.
PREFIX = 48
# Files in which a vector is posted, and files that a query reads.
POSTED = 3
PROBES = 56
# Part of a file that is compared exactly, by rank of footrule distance, and the least number.
RERANKED = 0.3
LEAST_RERANKED = 64
SHARD_ROWS = 4096
BLOCK_QUERIES = 2048
SEED = 42


def usable_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """`(id, v)`: non-null ids with finite, non-zero vectors of the commonest length, repeated rows once."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    own = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(finite & F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))
    sizes = own.groupBy("size").agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.col("n").desc(), "size").first()
    return own.where(F.col("size") == (common["size"] if common else 0)).select("id", "v").distinct()


class Pivots:
    """Orders of pivots as ranks. A last component makes all vectors equally long, so that the nearest
    vector is the one with the largest inner product."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.longest = longest
        self.pivots = self.lifted(pivots)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))
        return np.column_stack([vectors, rest])

    def ranks(self, vectors: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (vectors, pivots), `PREFIX` at most; and the order of the pivots."""
        lifted = np.column_stack([vectors, np.zeros(len(vectors))]) if query else self.lifted(vectors)
        order = np.argsort(-(lifted @ self.pivots.T), axis=1, kind="stable")
        ranks = np.full(order.shape, min(PREFIX, order.shape[1]), np.uint8)
        first = order[:, :PREFIX]
        np.put_along_axis(ranks, first, np.broadcast_to(np.arange(first.shape[1], dtype=np.uint8), first.shape), axis=1)
        return ranks, order


def _filed(vectors: DataFrame, pivots: Pivots, files: int, query: bool) -> DataFrame:
    """`(id, data, ranks, files)`: bytes of the vector, ranks, and its first pivots."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ranks, order = pivots.ranks(data, query)
            first = order[:, :files].astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, first.size + 1, first.shape[1]), pa.int32()), pa.array(first.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in data], pa.binary()), pa.array([r.tobytes() for r in ranks], pa.binary()), lists],
                names=["id", "data", "ranks", "files"],
            )

    return vectors.select("id", "v").mapInArrow(apply, "id long, data binary, ranks binary, files array<int>")


def _stacked(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _compared(vectors: pd.DataFrame, queries: pd.DataFrame, k: int, share: float) -> pd.DataFrame:
    """The `k` best of a shard for each query of a block."""
    empty = pd.DataFrame({"q": pd.Series([], dtype="i8"), "v": pd.Series([], dtype="i8"), "score": pd.Series([], dtype="f8")})
    if not len(vectors) or not len(queries):
        return empty
    data, wanted = _stacked(vectors["data"], "f8"), _stacked(queries["data"], "f8")
    ids = vectors["id"].to_numpy()
    part = max(LEAST_RERANKED, k, int(np.ceil(share * len(ids))))
    out_q, out_v, out_s = [], [], []
    if part < len(ids):
        ranks = np.ascontiguousarray(_stacked(vectors["ranks"], np.uint8).T)
        own = _stacked(queries["ranks"], np.uint8)
        worst = min(PREFIX, ranks.shape[0])
        steps = np.arange(worst + 1, dtype=np.int16)
        # What a shared pivot takes off the distance of two orders that share none, by its two ranks.
        gain = np.abs(steps[:, None] - steps[None, :]) - (worst - steps)[None, :]
    for i, query in enumerate(wanted):
        chosen = slice(None)
        if part < len(ids):
            distance = np.zeros(len(ids), np.int16)
            for pivot in np.nonzero(own[i] < worst)[0]:
                distance += gain[own[i, pivot]].take(ranks[pivot])
            chosen = np.argpartition(distance, part)[:part]
        near, names = data[chosen], ids[chosen]
        score = near @ query
        if len(score) > k:
            best = np.nonzero(score >= np.partition(score, len(score) - k)[len(score) - k])[0]
            best = best[np.lexsort((names[best], -score[best]))[:k]]
        else:
            best = np.arange(len(score))
        out_q.append(np.full(len(best), queries["id"].iloc[i]))
        out_v.append(names[best])
        out_s.append(np.einsum("ij,j->i", near[best], query))
    return pd.DataFrame({"q": np.concatenate(out_q), "v": np.concatenate(out_v), "score": np.concatenate(out_s)})


def _parts(filed: DataFrame, size: int) -> Column:
    """Number of parts of each file so that none has more than about `size` rows; one number per pivot."""
    counts = {r["file"]: -(-r["n"] // size) for r in filed.groupBy("file").agg(F.count("*").alias("n")).collect()}
    return F.coalesce(F.get(F.array(*[F.lit(counts.get(i, 1)) for i in range(max(counts, default=0) + 1)]), F.col("file")), F.lit(1))


def _searched(postings: DataFrame, queries: DataFrame, k: int, share: float) -> DataFrame:
    """Best of each (file, shard, block), for `postings` and `queries` of `(id, data, ranks, file)`."""
    shards, blocks = _parts(postings, SHARD_ROWS), _parts(queries, BLOCK_QUERIES)
    mark = F.xxhash64(F.lit(SEED), F.col("id"))
    left = postings.withColumn("shard", F.pmod(mark, shards)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = queries.withColumn("block", F.pmod(mark, blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    keys = ["file", "shard", "block"]
    left = left.select(*[F.col(c).cast("int") for c in keys], "id", "data", "ranks")
    right = right.select(*[F.col(c).cast("int") for c in keys], "id", "data", "ranks")

    def compare(vectors: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return _compared(vectors, wanted, k, share)

    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(compare, "q long, v long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "v")
    once = found.groupBy("q", "v").agg(F.max("score").alias("score"))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def nearest(
    rows: DataFrame, queries: DataFrame | None = None, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    pivots: int = PIVOTS, probes: int = PROBES, reranked: float = RERANKED,
) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: for each of `queries(id)` its `k` nearest of `rows`, itself left out.

    `score` is the inner product in double precision, ties go to the smaller id. Ids that are null or have a
    null, zero or non-finite vector, or one of another length than most, take no part. The pivots are a
    random sample of `pivots` distinct vectors; every vector is posted. Equal vectors are searched as one
    and their smallest ids put in place afterwards. Queries for which the read files hold too few are
    answered by reading all files, exactly.
    """
    own = materialize(usable_vectors(rows, key, vector), "vectors")
    spark = own.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    distinct = materialize(own.groupBy("v").agg(F.min("id").alias("id")), "distinct")
    facts = distinct.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest")).first()
    if not facts["n"]:
        return empty
    # Some more than needed are drawn by a hash, and the first of them taken: what reaches the driver is bounded.
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("id")), F.lit(1 << 30))
    drawn = distinct.where(draw <= int((1 << 30) * min(1.0, 4 * pivots / facts["n"]))).select(draw.alias("draw"), "id", "v").collect()
    sample = sorted(drawn, key=lambda r: (r["draw"], r["id"]))[:pivots]
    chosen = Pivots(np.array([r["v"] for r in sample], np.float64), float(np.sqrt(facts["longest"])))
    every = len(sample)

    members = materialize(own.join(distinct.withColumnRenamed("id", "d"), "v").select("id", "d"), "members")
    wanted = members if queries is None else members.join(queries.select(F.col(queries.columns[0]).alias("id")).distinct(), "id")
    wanted = materialize(wanted, "queries")
    asked = distinct.join(wanted.select(F.col("d").alias("id")).distinct(), "id")

    index = materialize(_filed(distinct, chosen, min(POSTED, every), False), "index")
    orders = materialize(_filed(asked, chosen, every, True), "orders")
    postings = index.select("id", "data", "ranks", F.explode("files").alias("file"))
    read = orders.select("id", "data", "ranks", F.explode(F.slice("files", 1, min(probes, every))).alias("file"))
    # One more than asked for, as a vector finds itself.
    found = materialize(_best(_searched(postings, read, k + 1, reranked), k + 1), "found")
    enough = min(k + 1, facts["n"])
    short = orders.select(F.col("id").alias("q")).join(found.groupBy("q").agg(F.count("*").alias("n")), "q", "left")
    short = materialize(short.where(F.coalesce("n", F.lit(0)) < enough).select("q"), "short")
    if not short.isEmpty():
        again = orders.join(short, orders["id"] == short["q"]).select("id", "data", "ranks", F.explode("files").alias("file"))
        once = index.select("id", "data", "ranks", F.get("files", F.lit(0)).alias("file"))
        more = _best(_searched(once, again, k + 1, 1.0), k + 1)
        found = found.join(short, "q", "left_anti").unionByName(more)

    # Smallest ids of each distinct vector: no more than k + 1 of them can be needed.
    first = Window.partitionBy("d").orderBy("id")
    few = materialize(members.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).drop("place"), "few")
    pairs = found.join(few.withColumnRenamed("id", "vec_id"), found["v"] == F.col("d")).select(F.col("q"), "vec_id", "score")
    pairs = materialize(_best(pairs.withColumnRenamed("vec_id", "v"), k + 1), "pairs")
    answers = wanted.join(pairs, wanted["d"] == pairs["q"]).where(F.col("id") != F.col("v"))
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "v")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("v").alias("vec_id"), "score")
