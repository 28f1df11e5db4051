"""Benchmark decontamination by winnowing, in DataFrame functions only.

An item window is `WINDOW` consecutive words of a benchmark item, or the whole item where it is
shorter. The smallest hash of the GRAM-word grams in a window is its fingerprint. A document keeps
the smallest gram hash of each of its own windows, so a window that it shares with an item gives
the same fingerprint on both sides: no shared window can be missed. Fingerprint hits are extended to
the item windows around them, whose words are then compared exactly.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import materialize

WINDOW = 10
GRAM = 5
# Everything ASCII that is not a digit or a lower-case letter separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _exploded(df: DataFrame, columns: list[str], array: Column, name: str) -> DataFrame:
    """One row per non-null element.

    The outer form, as for the inner one the optimizer infers a filter on the array's size and
    computes the whole array a second time, with nothing shared, below the projections.
    """
    return df.select(*columns, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def exact_words(text: Column) -> Column:
    """Words with A-Z lower-cased and nothing else changed; null gives no words."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def folded_words(text: Column) -> Column:
    """As `exact_words`, all letters lower-cased: cheaper and at the same places, so as many.

    Only for counting: lower() looks past the word at the end of Greek ones, so equal exact words may be folded differently.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _grams(words: Column, n: Column, size: int) -> Column:
    """Hashes of all `size`-word grams; the caller sees to n >= size."""
    return F.transform(
        F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + j) for j in range(size)])
    )


def _winnowed(grams: Column, n: Column) -> Column:
    """The smallest gram hash of every window."""
    span = WINDOW - GRAM + 1
    return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.least(*[F.get(grams, i + j) for j in range(span)]))


def _guarded(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.array().cast("array<long>"))


def _with_fingerprints(rows: DataFrame, short: list[int]) -> DataFrame:
    """Adds `prints`: winnowed grams, and all grams of the lengths in `short`; needs `words`, `n`."""
    long_enough = F.col("n") >= WINDOW
    rows = rows.withColumn("grams", _guarded(long_enough, _grams(F.col("words"), F.col("n"), GRAM)))
    parts = [_guarded(long_enough, _winnowed(F.col("grams"), F.col("n")))]
    parts += [_guarded(F.col("n") >= k, _grams(F.col("words"), F.col("n"), k)) for k in short]
    return rows.withColumn("prints", F.array_distinct(F.concat(*parts) if short else parts[0]))


def _windows(words: Column, starts: Column, size: Column | int) -> Column:
    return F.transform(
        starts,
        lambda i: F.struct(
            F.lit(size).cast("int").alias("size"), i.cast("int").alias("start"),
            F.array_join(F.slice(words, i + 1, F.lit(size)), " ").alias("window"),
        ),
    )


def _benchmark(items: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """Windows `(item, size, window)`, fingerprints `(print)` and the lengths of short items."""
    rows = items.select(F.col(item).alias("item"), exact_words(F.col(text)).alias("words"))
    rows = rows.withColumn("n", F.size("words")).where("n > 0")
    size = F.least(F.col("n"), F.lit(WINDOW))
    starts = F.sequence(F.lit(0), F.col("n") - size)
    windows = _exploded(rows, ["item"], _windows(F.col("words"), starts, size), "w").select("item", "w.size", "w.window")
    windows = materialize(windows.distinct(), "item-windows")
    # At most WINDOW - 1 numbers.
    short = sorted(r["size"] for r in windows.where(F.col("size") < WINDOW).select("size").distinct().collect())
    prints = _exploded(_with_fingerprints(rows.where(F.col("n") >= WINDOW), []), [], F.col("prints"), "print")
    for k in short:
        prints = prints.unionByName(rows.where(F.col("n") == k).select(F.get(_grams(F.col("words"), F.col("n"), k), F.lit(0)).alias("print")))
    return windows, materialize(prints.distinct(), "item-prints"), short


def _covered(hits: Column) -> Column:
    """Words in the union of `hits` (start, size), sorted by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered"))
    return F.aggregate(
        hits, zero,
        lambda s, h: F.struct(
            F.greatest(s["end"], h["start"] + h["size"]).alias("end"),
            (s["covered"] + F.greatest(F.lit(0), h["start"] + h["size"] - F.greatest(s["end"], h["start"]))).alias("covered"),
        ),
        lambda s: s["covered"],
    )


def _hits(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """Rows `(key, text, mark)`, and `(k, m, n_hit, ids)` for each key and text mark with an item window."""
    windows, prints, short = _benchmark(items, item, item_text)
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))

    worded = own.select("key", "mark", exact_words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    marked = _exploded(_with_fingerprints(worded, short), ["key", "mark"], F.col("prints"), "print")
    found = marked.join(prints, "print").groupBy("key", "mark").agg(F.collect_set("print").alias("found"))
    found = materialize(found, "fingerprint-hits").withColumnsRenamed({"key": "k", "mark": "m"})

    near = own.join(found, own["key"].eqNullSafe(found["k"]) & (own["mark"] == found["m"]))
    near = near.select("key", "mark", "found", exact_words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    near = near.withColumn("grams", _guarded(F.col("n") >= WINDOW, _grams(F.col("words"), F.col("n"), GRAM)))
    last = F.col("n") - WINDOW
    places = F.filter(F.transform(F.col("grams"), lambda g, i: F.when(F.array_contains("found", g), i)), lambda i: i.isNotNull())
    near = near.withColumn("places", places)
    around = F.flatten(F.transform(
        F.col("places"), lambda i: F.sequence(F.greatest(F.lit(0), F.least(last, i - (WINDOW - GRAM))), F.least(last, i))
    ))
    starts = [(WINDOW, F.array_distinct(around))]
    for k in short:
        grams = _guarded(F.col("n") >= k, _grams(F.col("words"), F.col("n"), k))
        starts.append((k, F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains("found", g), i)), lambda i: i.isNotNull())))
    near = near.withColumns({f"starts{k}": value for k, value in starts})
    shown = F.concat(*[_windows(F.col("words"), F.col(f"starts{k}"), k) for k, _ in starts])
    shared = _exploded(near, ["key", "mark"], shown, "w").select("key", "mark", "w.*")
    shared = shared.join(windows, ["size", "window"])
    hits = shared.groupBy("key", "mark").agg(
        F.array_sort(F.collect_set(F.struct("start", "size"))).alias("hits"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("ids"),
    )
    hits = hits.select(
        F.col("key").alias("k"), F.col("mark").alias("m"), _covered(F.col("hits")).cast("long").alias("n_hit"), "ids"
    )
    return own, materialize(hits, "contaminated")


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per row of `docs`: `(key, n_words, n_hit, n_items, items_sha256, contaminated)`.

    `n_hit` counts words inside any item window, `n_items` the distinct non-null item ids with such
    a window; the digest is over those ids, sorted as strings and joined by commas (of the empty
    string if there are none). Null texts have no words; items without words are ignored; an empty
    benchmark leaves every document clean. Repeated rows give repeated results. Only documents with
    a fingerprint hit are read for the exact comparison. Sides are broadcast by Spark's own rule,
    on the sizes of stored tables.
    """
    own, hits = _hits(docs, items, key, text, item, item_text)
    counted = own.select("key", "mark", F.size(folded_words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(hits, counted["key"].eqNullSafe(hits["k"]) & (counted["mark"] == hits["m"]), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows that share a window with a benchmark item; other texts of the same key stay."""
    _, hits = _hits(docs, items, key, text, "item_id", "text")
    return docs.join(hits, docs[key].eqNullSafe(hits["k"]) & (F.xxhash64(docs[text]) == hits["m"]), "left_anti")
