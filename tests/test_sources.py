import json

import pytest
from pyspark.sql import functions as F

from pagewright.api import prepare_snapshot, run_requests, search_and_scrape
from pagewright.operators import classifiers as C
from pagewright.operators.search import run_search
from pagewright.sources import jobs as J
from pagewright.sources import sinks, stores, training
from pagewright.sources.requests import scrape_request
from pagewright.session import materialize
from pagewright.streaming import jobs as S

LONG = "<p>" + "lorem ipsum dolor " * 20 + "</p>"
BODY = "".join(LONG.replace("lorem", f"lorem{i}") for i in range(30))


def snapshot(spark):
    rows = [
        (1, "https://e.com/", BODY + '<a href="/a">a</a><a href="/b">b</a>'),
        (2, "https://e.com/a", BODY + '<a href="/c">c</a>'),
        (3, "https://e.com/b", "<p>hi</p>"),
        (4, "https://e.com/c", BODY),
    ]
    return prepare_snapshot(spark.createDataFrame(rows, "page_id int, url string, html string"))


def test_training_reader(spark, tmp_path):
    rows = [
        {"label": " Bot_Detected", "vendor": "v", "html": " <p>1</p> "}, {"label": "neutral", "html": "n"}, {"label": "odd", "html": "x"},
        {"label": "normal", "html": " "}, {"label": "", "html": "x"},
    ]
    path = tmp_path / "train.json"
    path.write_text(json.dumps({"train_html": rows}, indent=1))
    got = [(r.html, r.label) for r in training.read_training(spark, str(path)).collect()]
    assert got == [("<p>1</p>", "BLOCKED"), ("n", "NEUTRAL")]
    assert training.read_training(spark, str(path), include_neutral=False).count() == 1


def test_state_documents(spark, tmp_path):
    path = tmp_path / "profiles.json"
    path.write_text(json.dumps({"e.com": {"domain": "e.com", "http_trust": True, "version": 3, "vendor_hints": ["X"], "last_updated_at": "2024-01-01T00:00:00+00:00"}}))
    rows = stores.read_profiles(spark, str(path))
    first = rows.first()
    assert (first.domain, first.http_trust, first.version, first.vendor_hints, first.last_updated_at.year) == ("e.com", True, 3, ["X"], 2024)
    stores.write_keyed(rows, "domain", str(tmp_path / "out"))
    again = stores.read_keyed_lines(spark, str(tmp_path / "out"), stores.PROFILE_TYPE).first()
    assert (again.domain, again.version) == ("e.com", 3) and again.last_updated_at.startswith("2024-01-01T00:00:00")
    (tmp_path / "s.json").write_text(json.dumps({"k": {"session_key": "k", "trust_score": 0.7, "cookies": {"a": "b"}, "burned": False}}))
    session = stores.read_sessions(spark, str(tmp_path / "s.json")).first()
    assert (session.trust_score, session.cookies) == (0.7, {"a": "b"})


def test_sites_and_report(spark, tmp_path):
    path = tmp_path / "sites.json"
    path.write_text(json.dumps([{"url": "https://e.com/", "category": "c", "expected_unlock": True, "notes": ""}, {"url": "https://none/", "expected_unlock": False}]))
    pages = snapshot(spark).withColumn("driver_used", F.lit("snapshot")).withColumn("elapsed", F.lit(0.1))
    pages = pages.withColumn("protection_type", F.col("protection.kind")).withColumn("session_key", F.lit("k"))
    report = {r.url: r for r in sinks.regression_report(training.read_sites(spark, str(path)), pages).collect()}
    assert report["https://e.com/"].success and report["https://e.com/"].detection_type == "NORMAL"
    assert not report["https://none/"].success and report["https://none/"].html_size_bytes == 0
    assert len(report["https://e.com/"]) == 12


def test_page_sinks(spark, tmp_path):
    pages = sinks.page_results(spark.createDataFrame([(1, "https://e.com/x", BODY)], "page_id int, url string, html string"))
    sinks.write_pages(pages, str(tmp_path / "t"))
    meta = spark.read.parquet(str(tmp_path / "t" / "metadata")).first()
    assert len(meta) == 17 and meta.detection_type == "NORMAL" and meta.html_size_bytes == len(BODY) and meta.protection_type == "ALLOW"
    assert spark.read.parquet(str(tmp_path / "t" / "pages")).first().domain == "e.com"
    sinks.write_pages(pages, str(tmp_path / "f"), layout="files")
    assert list((tmp_path / "f" / "clean_txt").glob("folder=e_com_*"))
    assert "html" not in sinks.release_payload(pages, True).columns


def test_requests_run_over_a_snapshot(spark):
    payloads = [
        {"url": "https://e.com/c"}, {"url": "https://e.com/", "crawl": True, "max_pages": 10},
        {"url": "https://e.com/a", "pagination_mode": True, "pagination": {"type": "x", "max_pages": 3}},
        {"url": "https://e.com/b", "crawl": True, "pagination_mode": True},
    ]
    requests = spark.createDataFrame([(json.dumps(p),) for p in payloads], "payload string")
    rows = run_requests(requests, snapshot(spark)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.position):
        got.setdefault(r.seed, []).append(r.url.removeprefix("https://e.com"))
    assert got == {"https://e.com/c": ["/c"], "https://e.com/": ["/", "/a", "/c"], "https://e.com/a": ["/a"], "https://e.com/b": ["/b"]}


def test_requests_over_a_snapshot_without_links_and_detection(spark):
    payloads = [
        {"url": "https://e.com/", "crawl": True, "max_pages": 10}, {"url": "https://e.com/b", "crawl": True, "pagination_mode": True},
        {"url": "https://gone.example/x"},
    ]
    requests = spark.createDataFrame([(json.dumps(p),) for p in payloads], "payload string")
    whole = snapshot(spark)
    order = ["seed", "url", "position"]
    want = run_requests(requests, whole).orderBy(*order).collect()
    assert run_requests(requests, whole.drop("links", "detection")).orderBy(*order).collect() == want and len(want) > 3


def test_requests_that_cannot_be_answered(spark):
    payloads = [('{"url": "https://e.com/b"}',), ('{"url": "https://gone.example/x"}',), ("no json",), (None,)]
    rows = run_requests(spark.createDataFrame(payloads, "payload string"), snapshot(spark)).collect()
    got = sorted((r.url or "", r.error or "", r.success) for r in rows)
    assert got == [
        ("", "malformed request", None), ("", "malformed request", None), ("https://e.com/b", "", False),
        ("https://gone.example/x", "page not in the snapshot", None),
    ]


def test_request_defaults(spark):
    df = spark.createDataFrame([('{"url": "u", "actions": [{"kind": " click ", "timeout_ms": 9}]}',), ("not json",)], "p string")
    good, bad = [r.r for r in df.select(scrape_request(F.col("p")).alias("r")).collect()]
    assert (good.url, good.allow_http_probe, good.proxy_policy, good.pagination, good.max_pages) == ("u", True, "sticky", None, 100)
    assert (good.actions[0].kind, good.actions[0].wait_ms, good.actions[0].max_iterations) == ("click", 9, 10)
    assert bad.url is None and bad.unlock_strategy == "unlock_first"


def test_job_flow(spark, tmp_path):
    inbox, log, results = (str(tmp_path / name) for name in ("inbox", "log", "results"))
    jobs = [
        (1, '{"url": "https://e.com/"}'), (2, '{"url": "https://e.com/b"}'), (3, '{"url": "https://gone/"}'), (4, "no json"),
        (5, '{"url": "https://e.com/", "crawl": true, "max_pages": 2}'), (6, '{"url": "https://e.com/", "crawl": true, "max_depth": 2}'),
    ]
    jobs = spark.createDataFrame(jobs, "id bigint, payload string")
    pages = materialize(snapshot(spark), "pages")
    J.enqueue(jobs, inbox)
    assert S.start_worker(spark, inbox, pages, log, results, str(tmp_path / "cp")).awaitTermination(300)

    def outcome():
        rows = S.job_results(spark, results).collect()
        return {r.id: (r.status, r.error) for r in J.latest_status(J.read_log(spark, log)).collect()}, sorted((r.id, r.position, r.url or "", r.error or "") for r in rows)

    first = outcome()
    assert first[0] == {i: ("done", None) if i != 4 else ("failed", "malformed request") for i in range(1, 7)}
    assert first[1] == [
        (1, 0, "https://e.com/", ""), (2, 0, "https://e.com/b", ""), (3, 0, "https://gone/", "page not in the snapshot"), (4, 0, "", "malformed request"),
        (5, 0, "https://e.com/", ""), (5, 1, "https://e.com/a", ""), (6, 0, "https://e.com/", ""), (6, 1, "https://e.com/a", ""), (6, 2, "https://e.com/c", ""),
    ]
    S.run_batch(jobs, pages, log, results, 0)  # the batch once more
    assert outcome() == first
    everything = J.read_log(spark, log).unionByName(J.read_log(spark, inbox))
    assert J.job_status(everything, 4).first().error == "malformed request" and J.job_status(everything, 99).count() == 0
    assert [r.id for r in J.unfinished(J.read_log(spark, inbox)).collect()] == [1, 2, 3, 4, 5, 6]
    assert {r.id for r in S.wait_for_jobs(spark, log, [1, 4], 60).collect()} == {1, 4}
    assert [r.status for r in S.wait_for_jobs(spark, inbox, [1, 99], 0.1).collect()] == ["pending"]


def test_search(spark):
    hits = spark.createDataFrame(
        [("q", 1, "t", "https://e.com/", "b"), ("q", 2, "t", "ftp://x", "b"), ("q", 3, "t", "https://gone/", "b"), ("q", 4, "t", "https://e.com/a", "b")],
        "query string, rank int, title string, href string, body string",
    )
    rows = {r.url: r.error for r in search_and_scrape(hits, snapshot(spark), "text", 3).collect()}
    assert rows == {"https://e.com/": None, "https://gone/": "not in snapshot"}
    with pytest.raises(ValueError):
        run_search(hits, "images")


def test_classifier_survives_saving(spark, tmp_path):
    rows = [(i, f"buy now product item{i % 5} cart", "NORMAL") for i in range(20)] + [
        (100 + i, f"verify challenge robot check{i % 5}", "BLOCKED") for i in range(10)
    ]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    model = C.TfidfClassifier.train(df, "id", "text")
    model.save(str(tmp_path / "m"))
    loaded = C.TfidfClassifier.load_or_train(spark, str(tmp_path / "m"), df, "id", "text")
    assert C.TfidfClassifier.load_or_train(spark, str(tmp_path / "new"), df, "id", "text").classes == model.classes
    fresh = spark.createDataFrame([(1, "robot verify challenge"), (2, "buy product cart"), (3, "zzz")], "id int, text string")
    before, after = ({r.id: (r.page_type, round(r.probability, 9)) for r in m.predict(fresh, "id", "text").collect()} for m in (model, loaded))
    assert before == after and before[1][0] == "BLOCKED" and before[2][0] == "NORMAL" and 3 in before
    assert "Exchange" not in loaded.predict(fresh, "id", "text")._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "robot " * 50_000)], "id int, text string")
    assert len(loaded.predict(odd, "id", "text").collect()) == 3 and loaded.predict(odd.limit(0), "id", "text").count() == 0
    words = C.train_word_vectors(df, "text", 1 << 10)
    words.save(str(tmp_path / "w"))
    again = C.PipelineClassifier.load(spark, str(tmp_path / "w"))
    assert {r.page_type for r in again.predict(fresh.filter("id = 1"), "id", "text").collect()} == {"BLOCKED"}


def test_command_line(spark, tmp_path):
    from pagewright.__main__ import main

    pages = spark.createDataFrame(
        [(1, "https://e.com/", BODY + '<a href="/a">a</a>'), (2, "https://e.com/a", BODY)], "page_id int, url string, html string"
    )
    pages.write.parquet(str(tmp_path / "pages"))
    assert main(["--snapshot", str(tmp_path / "pages")]) == 1
    out = tmp_path / "out"
    assert main(["--snapshot", str(tmp_path / "pages"), "--site", "https://e.com/", "--crawl", "--output", str(out)]) == 0
    (session,) = list(out.glob("e_com_crawl_*"))
    assert spark.read.parquet(str(session / "metadata")).count() == 2


def test_intermediate_tables_need_a_shared_folder(spark):
    from pagewright.session import check_shared, checkpoint_root

    assert checkpoint_root(spark)
    check_shared("file", "local[4]", "/w")
    check_shared("hdfs", "yarn", "/w")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        check_shared("file", "spark://h:7077", "/w")
