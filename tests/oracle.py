"""Run a query in Spark and its SQL twin in DuckDB and compare the row multisets."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


# Expected number of rows where SQL cannot say the rows.
_PAGES, _DOCUMENTS = "(SELECT count(*) FROM pages)", "(SELECT count(*) FROM documents)"
ROWS = {
    "page_pagination_config": _PAGES,
    "tfidf_lr_predict": _DOCUMENTS, "word_vector_predict": _DOCUMENTS, "embedding_lr_predict": "(SELECT count(*) FROM embeddings)",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return float(value)
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, folder: str) -> tuple[bool, str]:
    started = time.time()
    df = query.run(spark, folder)
    got = df.collect()
    took = time.time() - started
    if query.sql is None:
        if query.name not in ROWS:
            return False, "neither SQL nor an expected number of rows"
        want = con.execute(f"SELECT {ROWS[query.name]}").fetchone()[0]
        return len(got) == want, f"rows only, {len(got)} of {want} rows, {took:.1f}s"
    result = con.execute(query.sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    left, right = _rows(df.columns, got), _rows(columns, want)
    if left != right:
        return False, (
            f"spark {len(got)} rows, sql {len(want)} rows; only spark {list((left - right).items())[:3]} "
            f"only sql {list((right - left).items())[:3]}"
        )
    return True, f"match, {len(got)} rows, {took:.1f}s"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pagewright.plans.registry import all_queries
    from pagewright.session import build_session

    data = sys.argv[1]
    wanted = sys.argv[2:]
    session = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    db = connect(data)
    failed = 0
    for name, q in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note = compare(session, db, q, data)
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, "-", note[:1500], flush=True)
    print("failed:", failed)
