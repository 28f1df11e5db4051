import random
from collections import deque

from pagewright.operators import crawl as crawl_module
from pagewright.operators.crawl import crawl, reach
from pagewright.plans import crawl_queries

HOST = "https://h.example"


def queue_crawl(seed, links, ok, budget, max_depth, initial=()):
    """The queue discipline, one page at a time."""
    visited, queue, results = {u for u, *_ in initial}, deque(), []
    budget -= len(visited)
    if budget <= 0:
        return []
    for url, depth, success in initial:
        for link in links.get(url, ()) if success else ():
            if link in visited:
                continue
            if len(queue) >= budget:
                break
            visited.add(link)
            queue.append((link, depth + 1))
    if seed not in visited:
        queue.append((seed, 0))
        visited.add(seed)
    while queue and len(results) < budget:
        url, depth = queue.popleft()
        if depth > max_depth or not ok.get(url, False):
            continue
        results.append((url, depth))
        for link in links.get(url, ()):
            if link in visited:
                continue
            if len(results) + len(queue) >= budget:
                break
            visited.add(link)
            queue.append((link, depth + 1))
    return results


def graph(rng, n):
    urls = [f"{HOST}/{i}" for i in range(n)]
    links = {u: rng.sample(urls, rng.randint(0, 6)) for u in urls}
    return urls, links, {u: rng.random() < 0.7 for u in urls}


def tables(spark, links, ok):
    edges = spark.createDataFrame([(s, i, d) for s, ds in links.items() for i, d in enumerate(ds)], "src string, pos int, dst string")
    return edges, spark.createDataFrame(list(ok.items()), "url string, success boolean")


def test_crawl_equals_queue(spark):
    rng = random.Random(3)
    for budget in (1, 7, 15, 200):
        urls, links, ok = graph(rng, 60)
        links[urls[0]].append("https://elsewhere.example/")
        edges, pages = tables(spark, links, ok)
        seeds = urls[:6]
        rows = crawl(spark.createDataFrame([(s,) for s in seeds], "seed string"), edges, pages, budget, 3).collect()
        for seed in seeds:
            got = [(r.url, r.depth) for r in sorted((r for r in rows if r.seed == seed), key=lambda r: r.position)]
            assert got == queue_crawl(seed, links, ok, budget, 3), (seed, budget)
            assert len(got) <= budget and len(set(got)) == len(got)


def test_crawl_asks_for_the_links_of_fetched_pages_only(spark):
    rng = random.Random(3)
    urls, links, ok = graph(rng, 60)
    edges, pages = tables(spark, links, ok)
    asked = []

    def of(wanted):
        asked.extend(r.url for r in wanted.collect())
        return edges.join(wanted, edges["src"] == wanted["url"], "left_semi")

    rows = crawl(spark.createDataFrame([(s,) for s in urls[:2]], "seed string"), of, pages, 7, 3).collect()
    for seed in urls[:2]:
        got = [(r.url, r.depth) for r in sorted((r for r in rows if r.seed == seed), key=lambda r: r.position)]
        assert got == queue_crawl(seed, links, ok, 7, 3)
    assert set(asked) <= {r.url for r in rows}


def test_crawl_continues_from_initial_pages(spark):
    rng = random.Random(5)
    urls, links, ok = graph(rng, 40)
    edges, pages = tables(spark, links, ok)
    initial = [(urls[0], 0, True), (urls[1], 1, True), (urls[2], 2, False)]
    other = [(urls[10], 0, True)]
    rows = [(urls[0], u, d, i, s) for i, (u, d, s) in enumerate(initial)] + [(urls[9], u, d, i, s) for i, (u, d, s) in enumerate(other)]
    table = spark.createDataFrame(rows, "seed string, url string, depth int, pos int, success boolean")
    for budget in (3, 9, 30):
        found = crawl(spark.createDataFrame([(urls[0],), (urls[9],)], "seed string"), edges, pages, budget, 3, initial=table).collect()
        for seed, first in ((urls[0], initial), (urls[9], other)):
            got = [(r.url, r.depth) for r in sorted((r for r in found if r.seed == seed), key=lambda r: r.position)]
            assert got == queue_crawl(seed, links, ok, budget, 3, first), (seed, budget)


def test_own_limits(spark):
    links = {f"{HOST}/{i}": [f"{HOST}/{i + 1}"] for i in range(9)}
    edges, pages = tables(spark, links, {u: True for u in links})
    seeds = spark.createDataFrame([(f"{HOST}/0", 2, 9), (f"{HOST}/1", 9, 1)], "seed string, max_pages int, max_depth int")
    rows = crawl(seeds, edges, pages, None, None).collect()
    assert sorted((r.seed[-1], r.url[-1]) for r in rows) == [("0", "0"), ("0", "1"), ("1", "1"), ("1", "2")]


def test_reach(spark):
    links = {f"{HOST}/{i}": [f"{HOST}/{i + 1}", f"{HOST}/0"] for i in range(9)}
    edges, _ = tables(spark, links, {})
    rows = reach(spark.createDataFrame([(f"{HOST}/0",)], "seed string"), edges, 3).collect()
    assert sorted((r.url[-1], r.depth) for r in rows) == [("0", 0), ("1", 1), ("2", 2), ("3", 3)]


def test_runs_of_one_seed(spark):
    links = {f"{HOST}/{i}": [f"{HOST}/{i + 1}", f"{HOST}/{i + 2}"] for i in range(20)}
    edges, pages = tables(spark, links, {u: True for u in links})
    seeds = spark.createDataFrame([(1, f"{HOST}/0", 4), (2, f"{HOST}/0", None), (2, f"{HOST}/0", None)], "id int, seed string, max_pages int")
    rows = crawl(seeds, edges, pages, None, 2, run="id").collect()
    for key, budget in ((1, 4), (2, 10**6)):
        got = [(r.url, r.depth) for r in sorted((r for r in rows if r.id == key), key=lambda r: r.position)]
        assert got == queue_crawl(f"{HOST}/0", links, {u: True for u in links}, budget, 2)


def test_links_that_come_again_when_failures_give_places_back(spark):
    page = lambda name: f"{HOST}/{name}"
    # The queue of the second generation is full after the first page; the pages that fail make room for what later pages name again.
    links = {
        page("s"): [page(x) for x in ("a", "f1", "b", "f2", "c")],
        page("a"): [page(x) for x in ("x1", "x2", "x3", "x4")], page("b"): [page(x) for x in ("x2", "x4", "y1", "x3")],
        page("c"): [page(x) for x in ("x4", "y1", "x3", "z1", "x2")],
    }
    urls = [page(x) for x in ("s", "a", "b", "c", "x1", "x2", "x3", "x4", "y1", "z1")]
    ok = {u: True for u in urls}
    edges, pages = tables(spark, links, ok)
    for budget in (1, 2, 4, 5, 6, 7, 8, 10):
        rows = crawl(spark.createDataFrame([(page("s"),)], "seed string"), edges, pages, budget, 4).collect()
        assert [(r.url, r.depth) for r in sorted(rows, key=lambda r: r.position)] == queue_crawl(page("s"), links, ok, budget, 4), budget


def test_buckets_and_laid_out_edges(spark, monkeypatch):
    from pagewright.operators import crawl as C

    rng = random.Random(8)
    urls, links, ok = graph(rng, 50)
    links[urls[0]] = rng.sample(urls, 40)
    edges, pages = tables(spark, links, ok)
    stored = C.stored_edges(edges, 4)
    monkeypatch.setattr(C, "_BUCKET", 4)
    for budget in (9, 25, None):
        rows = crawl(spark.createDataFrame([(s,) for s in urls[:3]], "seed string"), stored, pages, budget, 3).collect()
        for seed in urls[:3]:
            got = [(r.url, r.depth) for r in sorted((r for r in rows if r.seed == seed), key=lambda r: r.position)]
            assert got == queue_crawl(seed, links, ok, budget or 10**6, 3), (seed, budget)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = spark.createDataFrame([("r", urls[0], urls[0], 0, 0, 9)], "run string, seed string, url string, depth long, ord long, allowance long")
        visited = frontier.select("run", "url")
        plan = C._candidates(frontier, stored, visited, 9)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line)
    join = max(i for i, line in enumerate(plan[:scan]) if "SortMergeJoin" in line)
    edge_side = [line for line in plan[join + 1 : scan] if line.find("+- ") >= plan[scan].find("+- ") - 9]
    assert "Bucketed: true" in plan[scan] and sum("Exchange" in line for line in plan[join:scan]) == 1 and not any("Exchange" in x for x in edge_side[-3:])


def test_reach_keeps_one_row_for_all_seeds_of_a_word(spark, monkeypatch):
    """What is stored per distance grows with the URLs, not with the seeds times the URLs; 70 seeds fill two words."""
    stored = {}
    keep = crawl_module.materialize
    monkeypatch.setattr(crawl_module, "materialize", lambda df, label: stored.setdefault(label, keep(df, label)))
    seeds = spark.createDataFrame([(i,) for i in range(70)], "seed long").coalesce(1)
    edges = spark.createDataFrame([(i, 1000 + j) for i in range(70) for j in range(5)] + [(1000, 0), (1000, 2000)], "src long, dst long")
    rows = {tuple(r) for r in crawl_module.reach(seeds, edges, 2).collect()}
    want = {(i, i, 0) for i in range(70)} | {(i, 1000 + j, 1) for i in range(70) for j in range(5)}
    want |= {(i, 2000, 2) for i in range(70)} | {(i, 0, 2) for i in range(1, 70)}
    assert rows == want
    assert stored["level1"].count() <= 5 * 8 < 70 * 5


def test_query_graph_writes_out_the_links_of_asked_pages_only(spark):
    tables = type("Tables", (), {"lineitem": spark.createDataFrame([(1, 7), (1, 7), (1, 9), (2, 7), (None, 9)], "l_suppkey long, l_partkey long")})
    asked = spark.createDataFrame([("https://shop.example/s/1",), ("https://shop.example/p/7",), ("https://shop.example/s/none",)], "url string")
    links = {(r.src[-3:], r.dst[-3:], r.pos) for r in crawl_queries._graph(tables)(asked).collect()}
    assert links == {("s/1", "p/7", 7), ("s/1", "p/9", 9), ("p/7", "s/1", 1), ("p/7", "s/2", 2)}
