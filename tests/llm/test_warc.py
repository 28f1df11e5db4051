"""Archives: exact round trips, revisits, normalisation."""

import gzip
import json
import random
import zlib

import pytest

from pagewright.llm import warc as W

PAGES = "page_id long, url string, html string, digest string, payload string"


def test_round_trip(spark):
    rows = [
        (3, None, None), (1, "u\r\nX-Evil: 1", ""), (2, "http://a/é b", "x" * 3_000_000), (9, "z", "x" * 3_000_000), (None, "q", "x" * 3_000_000),
        (5, "w", "\r\n\r\nWARC/1.1\r\n\r\n"), (5, "w", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "é", "é😀\n"), (7, "p" * 5000, "plain"), (None, None, "alone"),
    ]
    pages = spark.createDataFrame([(*r, "clash", None) for r in rows], PAGES)
    got = W.archived(pages)
    found = got.collect()
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(first.get(html or "", key), key)
    want = []
    for key, _, html in rows:
        payload, smallest = (html or "").encode(), first.get(html or "")
        revisit = smallest is not None and key != smallest
        want.append((key, len(payload), W.payload_digest(payload), "revisit" if revisit else "response", smallest if revisit else None))
    assert sorted(map(str, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found])) == sorted(map(str, want))
    assert W.archived(pages.limit(0)).count() == 0


def test_payloads_below_the_least_size_are_all_stored(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    planned = W.planned_records(pages, least_bytes=3).collect()
    assert {r.page_id: r.refers_to for r in planned} == {1: None, 2: None, 3: None, 4: 3}


@pytest.mark.parametrize("members", [1, 3])
def test_normalised_members_stand_alone(tmp_path, members):
    rng = random.Random(0)
    records = [W.record(i, f"http://x/{i}", rng.randbytes(rng.choice([0, 10, 200_000])), None, False) for i in range(20)]
    parts = [b"".join(records[i::members]) for i in range(members)]
    source, target = tmp_path / "a.warc.gz", tmp_path / "b.warc.gz"
    source.write_bytes(b"".join(gzip.compress(p) for p in parts))
    assert W.normalise_file(str(source), str(target)) == 20
    data, order = target.read_bytes(), [r for i in range(members) for r in records[i::members]]
    lines = [json.loads(x) for x in (tmp_path / "b.warc.gz.idx").read_text().splitlines()]
    assert [zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31) for x in lines] == order
    assert sum(x["length"] for x in lines) == len(data) and gzip.decompress(data) == b"".join(order)


def test_broken_streams_are_errors(tmp_path):
    whole = gzip.compress(W.record(1, "u", b"abc" * 1000, None, False))
    for name, data in (("cut", whole[:-20]), ("short", gzip.compress(W.record(1, "u", b"abc", None, False)[:-6]))):
        path = tmp_path / name
        path.write_bytes(data)
        with pytest.raises(ValueError):
            W.normalise_file(str(path), str(tmp_path / "out"))


def test_several_files_per_task(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    from pagewright.session import new_folder

    folder = new_folder(spark, "warc-test")
    files = W.write_archives(W.planned_records(pages), folder, file_bytes=5_000)
    assert files.count() > 2
    assert W.read_archives(W.normalised(files, folder)).count() == 40
