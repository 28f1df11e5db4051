"""Windows against brute force."""

import hashlib
import random
import re

from pagewright.llm import decontamination as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        other = words(item_text)
        size = min(10, len(other))
        windows = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if size else set()
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item)
    ids = sorted(str(x) for x in found if x is not None)
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def check(spark, docs, items):
    own = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, item string, n_words int")
    other = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, D.contamination(own, other).collect()), key=str)
    assert got == sorted(((i, *brute(t, items)) for i, t in docs), key=str)


def test_contamination(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "the", "THE", "ß", "x1"]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, text(rng.choice([9, 10, 11, 25, 40]))) for i in range(25)]
    items += [(100, "single"), (101, "two words"), (102, "the w1 w2"), (103, None), (104, "..."), (None, text(20)), (5, items[5][1]), (200, items[3][1]), (105, "tick " * 30)]
    docs = [(i, text(rng.choice([3, 9, 30, 120]))) for i in range(30)]
    for i in range(40):
        source = words(rng.choice(items)[1])
        a = rng.randint(0, max(0, len(source) - 1))
        passage = source[a : a + rng.choice([9, 10, 14, 40])]
        docs.append((300 + i, f"{text(rng.choice([0, 5, 20]))} {', '.join(passage).upper() if i % 2 else ' '.join(passage)}; {text(8)}"))
    docs += [(1, None), (2, ""), (3, "!?"), (None, items[2][1]), (3, "!?"), (4, "tick " * 20_000), (600, text(4000)), (601, "a single word"), (7, docs[40][1])]
    check(spark, docs, items)


def test_without_short_items_or_without_any(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven")]
    check(spark, [(1, "x " + items[0][1] + " y"), (2, "one two three four five six seven eight nine"), (3, "ONE two three four five six seven eight nine TEN")], items)
    check(spark, [(1, "one two"), (2, None)], [])
    assert D.contamination(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontaminated_keeps_clean_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "so: one two three four five six seven eight nine ten", "a"), (2, "clean", "b"), (None, None, "c")], "doc_id long, text string, hit_key string"
    )
    kept = D.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.hit_key for r in kept.collect()) == ["b", "c"]


def test_plan_has_no_python(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    plan = D.contamination(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_rows_of_one_key_are_told_apart(spark):
    passage = "a b c d e f g h i j k l"
    rows = [(None, f"before {passage} after"), (None, "a clean text of a null key"), (7, passage), (7, "a clean text of key seven"), (None, None)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = D.decontaminated(docs, items).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_final_sigma_does_not_hide_a_window(spark):
    """Upper-case Greek words that end in sigma: what follows them must not matter."""
    greek = "ΛΟΓΟΣ ΝΟΜΟΣ ΔΡΟΜΟΣ ΚΟΣΜΟΣ ΧΡΟΝΟΣ ΤΟΠΟΣ ΑΝΕΜΟΣ ΗΛΙΟΣ ΦΙΛΟΣ ΜΥΘΟΣ".split()
    check(spark, [(1, ".".join(greek) + ".NEXT"), (2, " ".join(greek)), (3, " ".join(greek[:9]))], [(1, " ".join(greek) + " end")])
