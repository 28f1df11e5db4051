"""TF-IDF weights bring the terms back to their document once."""

import math

from pagewright.operators import classifiers as C


def test_weights_take_one_join(spark):
    counts = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3), (None, "a", 1)], "doc_id long, term string, tf long")
    vocab = spark.createDataFrame([(0, "a", 3, 1.0), (1, "b", 1, 2.0)], "index int, term string, df long, idf double")
    weights = C.tfidf_weights(counts, vocab, "doc_id")
    b = 2 * (math.log(2) + 1)
    norm = math.sqrt(1 + b * b)
    got = sorted((r.doc_id, r.term, round(r.weight, 9)) for r in weights.collect())
    assert got == [(1, "a", round(1 / norm, 9)), (1, "b", round(b / norm, 9)), (2, "a", 1.0)]
    assert weights._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
