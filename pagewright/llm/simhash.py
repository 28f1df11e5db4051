"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.components import connected_components
from pagewright.session import materialize, release

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
HASH_SEED = 42
BITS = 64
# Blocks of a fingerprint. Two fingerprints that differ in d bits agree on at least
# BLOCKS - d whole blocks, so every choice of that many blocks is one join key. With five
# blocks and d = 2 a key has 38 or 39 bits: chance meetings stay rare at billions of rows.
BLOCKS = 5
# Blocks with more fingerprints than this are not joined in pairs, see `_crowded_edges`.
PAIRED_BLOCK = 32


def _fingerprint(text: str | None, width: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    begin, end = starts[:-width].tolist(), (starts[width:] - 1).tolist()
    step = 1 << 15
    for at in range(0, len(begin), step):
        hashes = [digest(joined[a:b], HASH_SEED) for a, b in zip(begin[at : at + step], end[at : at + step])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(begin), bitorder="little").view("<u8")[0])


def simhash(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """64-bit fingerprint of a text as BIGINT (its bits, read as signed).

    A-Z are lower-cased, words are runs without ASCII white space, shingles are `width` words
    joined by one space, repeats included. Fewer words form one shingle; a text that is null or has no
    word has fingerprint zero. A bit is set where more than half of the shingle hashes have it.
    """

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([_fingerprint(x.as_py(), width) for x in texts], "u8").view("i8"), pa.int64())

    return of(text)


def _masks(blocks: int, distance: int) -> list[int]:
    """One mask per choice of `blocks - distance` whole blocks, as signed 64-bit numbers."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    sums = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in sums]


def _crowded_edges(members: DataFrame, masks: list[int]) -> DataFrame:
    """Links inside blocks of many fingerprints, without pairing them.

    Members of a block differ only outside its mask. Two of them are within 2 bits exactly if
    some fingerprint is within 1 bit of both: so each member is filed under itself and each of
    its one-bit changes outside the mask. All members filed at one place are within 2 bits of one
    another, so linking each to the smallest there loses no component.
    """
    free = [[1 << b if b < BITS - 1 else -(1 << b) for b in range(BITS) if not m >> b & 1] for m in masks]
    variants = F.array(*[F.array(F.lit(0), *[F.lit(x).cast("long") for x in bits]) for bits in free])
    filed = members.select(
        "fp", "block", F.explode(variants[F.col("block")]).alias("change")
    ).select("fp", "block", F.col("fp").bitwiseXOR(F.col("change")).alias("place"))
    stored = materialize(filed, "places")
    first = materialize(stored.groupBy("block", "place").agg(F.min("fp").alias("other"), F.count("*").alias("n")).where("n > 1"), "first")
    return stored.join(first, ["block", "place"]).select("other", "fp")


def linked_fingerprints(fps: DataFrame, blocks: int = BLOCKS, paired_block: int = PAIRED_BLOCK) -> DataFrame:
    """Distinct `fps(fp)` -> edges `(u, v)`, u < v, that connect what lies within two bits.

    Every pair within two bits is joined by a path of returned edges, and every edge is
    verified. Blocks of up to `paired_block` fingerprints are joined in pairs; the few with more
    are resolved by `_crowded_edges`, which is exact and linear in their size.
    """
    masks = _masks(blocks, MAX_DISTANCE)
    keys = F.array(*[
        F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key"))
        for i, m in enumerate(masks)
    ])
    filed = fps.select("fp", F.explode(keys).alias("b")).select("fp", "b.block", "b.key")
    shared = materialize(filed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1"), "blocks")
    members = materialize(filed.join(shared, ["block", "key"]), "members")
    small = members.where(F.col("n") <= paired_block).select("block", "key", "fp")
    pairs = small.join(small.withColumnRenamed("fp", "other"), ["block", "key"]).where("other < fp")
    edges = pairs.select("other", "fp").unionByName(_crowded_edges(members.where(F.col("n") > paired_block), masks))
    near = edges.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MAX_DISTANCE) & (F.col("fp") != F.col("other")))
    return near.select(F.least("other", "fp").alias("u"), F.greatest("other", "fp").alias("v")).distinct()


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: Column | None = None) -> DataFrame:
    """`(key, fingerprint, component_id)` for every row of `docs`, and `mark` of the row where it is given.

    `component_id` is the smallest key reachable over links of at most two bits, the row's
    own included; `fingerprint` has 16 lower-case hex digits. Repeated rows give repeated
    results. Null keys never become a component id: rows linked to null keys only have a null id.
    Exact copies and equal fingerprints meet in an aggregate that is combined before the shuffle.
    """
    marks = [] if mark is None else [mark.alias("mark")]
    rows = materialize(docs.select(F.col(key).alias("key"), simhash(F.col(text)).alias("fp"), *marks), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    roots = connected_components(linked_fingerprints(distinct.select("fp")))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    placed = materialize(placed, "placed")
    smallest = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    classes = materialize(placed.join(smallest, "root").select("fp", "component_id"), "classes")
    release(distinct)
    return rows.join(classes, "fp").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *["mark" for _ in marks]
    )


def near_duplicates_removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without those that have an earlier near copy: of each component the row with the smallest key stays.

    Rows whose component has no non-null key stay. It is decided per key and text, so other texts of the same key, null
    included, are not touched.
    """
    found = simhash_components(docs, key, text, F.xxhash64(text))
    gone = found.where(~F.col(key).eqNullSafe(F.col("component_id")) & F.col("component_id").isNotNull())
    gone = materialize(gone.select(F.col(key).alias("__key"), F.col("mark").alias("__mark")).distinct(), "gone")
    return docs.join(gone, docs[key].eqNullSafe(gone["__key"]) & (F.xxhash64(docs[text]) == gone["__mark"]), "left_anti")
