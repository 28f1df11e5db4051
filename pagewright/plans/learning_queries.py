"""Queries on training data and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import features as X
from pagewright.operators import classifiers as C
from pagewright.plans import sql_parts as Q
from pagewright.plans.registry import query
from pagewright.session import materialize
from pagewright.sources import training as T

# Conversation roles and page markers as raw labels: known, unknown and empty ones.
_RAW_LABEL_SQL = "CASE role WHEN 'user' THEN ' Normal ' WHEN 'assistant' THEN 'bot_detected' ELSE role END"


def _raw(t):
    label = (
        F.when(F.col("role") == "user", F.lit(" Normal "))
        .when(F.col("role") == "assistant", F.lit("bot_detected"))
        .otherwise(F.col("role"))
    )
    known = t.conversations.select(label.alias("label"), F.col("text").alias("html"))
    odd = t.documents.select(F.col("lang").alias("label"), F.col("text").alias("html"))
    return known.unionByName(odd)


_RAW_SQL = f"SELECT {_RAW_LABEL_SQL} AS label, text AS html FROM conversations UNION ALL SELECT lang, text FROM documents"
_MAPPED_SQL = (
    "CASE lower(trim(label)) WHEN 'bot_detected' THEN 'BLOCKED' WHEN 'blocked' THEN 'BLOCKED' WHEN 'normal' THEN 'NORMAL' "
    "WHEN 'neutral' THEN 'NEUTRAL' END"
)


@query(
    "label_map_counts",
    f"SELECT {_MAPPED_SQL} AS label, count(*) AS n FROM ({_RAW_SQL}) WHERE {_MAPPED_SQL} IS NOT NULL AND {Q.strip('html')} <> '' GROUP BY 1",
)
def label_map_counts(t):
    return T.class_counts(T.labelled_pages(_raw(t)))


@query(
    "label_unknown_anti",
    f"SELECT lower(trim(label)) AS label, count(*) AS n FROM ({_RAW_SQL}) WHERE {_MAPPED_SQL} IS NULL AND trim(label) <> '' GROUP BY 1",
)
def label_unknown_anti(t):
    return T.skipped_labels(_raw(t))



_TERMS_SQL = f"""w AS (SELECT page_id, regexp_extract_all(lower(features), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}') AS ws FROM f),
u AS (SELECT page_id, unnest(ws) AS term FROM w UNION ALL
  SELECT page_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
c AS (SELECT page_id, term, count(*) AS tf FROM u GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM f),
v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1),
r AS (SELECT page_id, c.term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS raw FROM c JOIN v ON c.term = v.term, n)"""
_FEATURES_SQL = f"f AS (SELECT page_id, {Q.collapse(Q.visible('html', ' '))} AS features FROM pages)"


@query(
    "tfidf_weights",
    f"""WITH {_FEATURES_SQL}, {_TERMS_SQL},
s AS (SELECT page_id, sqrt(sum(raw * raw)) AS norm FROM r GROUP BY 1)
SELECT r.page_id, term, round(raw / norm, 6) AS weight FROM r JOIN s ON r.page_id = s.page_id""",
)
def tfidf_weights(t):
    """TF-IDF of the visible text of all pages."""
    docs = t.pages.select("page_id", X.visible(F.col("html")).alias("features"))
    counts = materialize(C.term_counts(docs, "page_id", "features"), "terms")
    vocab = C.vocabulary(counts, docs.count(), max_features=None, min_docs=1)
    return C.tfidf_weights(counts, vocab, "page_id").select("page_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "tfidf_vectors",
    f"""WITH {_FEATURES_SQL}, {_TERMS_SQL},
k AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS index FROM (
  SELECT term FROM v WHERE df >= {C.MIN_DOCS} ORDER BY total DESC, term LIMIT {C.MAX_FEATURES})),
x AS (SELECT page_id, index, raw FROM r JOIN k ON r.term = k.term),
s AS (SELECT page_id, sqrt(sum(raw * raw)) AS norm FROM x GROUP BY 1)
SELECT x.page_id, index, round(raw / norm, 6) AS weight FROM x JOIN s ON x.page_id = s.page_id""",
)
def tfidf_vectors(t):
    """Vectors of all pages by the fitted vectoriser, whose vocabulary is bounded."""
    docs = t.pages.select("page_id", X.visible(F.col("html")).alias("features"))
    cells = F.unwrap_udt(F.col("vector"))
    rows = C.TfidfVectors.fit(docs, "page_id", "features").transform(docs.withColumnRenamed("features", "text"), "text")
    entries = rows.select("page_id", F.col("features").alias("vector")).select("page_id", F.arrays_zip(cells["indices"].alias("index"), cells["values"].alias("weight")).alias("cells"))
    return entries.select("page_id", F.inline("cells")).select("page_id", "index", F.round("weight", 6).alias("weight"))


def _labelled(t, features):
    docs = t.documents.join(t.labels, "doc_id")
    label = F.when(F.col("quality") == 0, F.lit("BLOCKED")).otherwise(F.lit("NORMAL"))
    return docs.select("doc_id", features(F.col("text")).alias("features"), label.alias("label"))


@query("tfidf_lr_predict")
def tfidf_lr_predict(t):
    """Train on the labelled documents, classify all documents."""
    model = C.TfidfClassifier.train(_labelled(t, X.tfidf_text), "doc_id", "features")
    docs = t.documents.select("doc_id", X.tfidf_text(F.col("text")).alias("features"))
    votes = C.as_vote(model.predict(docs, "doc_id", "features"), model.name)
    return votes.select("doc_id", "page_type", "vote.is_blocked", "vote.confidence", "score")


@query("word_vector_predict")
def word_vector_predict(t):
    model = C.train_word_vectors(_labelled(t, X.word_vector_text), "features")
    docs = t.documents.select("doc_id", X.word_vector_text(F.col("text")).alias("features"))
    votes = C.as_vote(model.predict(docs, "doc_id", "features"), model.name)
    return votes.select("doc_id", "page_type", "vote.is_blocked", "vote.confidence", "score")


@query("embedding_lr_predict")
def embedding_lr_predict(t):
    from pyspark.ml.functions import array_to_vector

    model = C.train_embedding_head(t.embeddings, "embedding")
    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("embedding"))
    votes = C.as_vote(model.predict(rows, "vec_id", "embedding"), model.name)
    return votes.select("vec_id", "page_type", "vote.is_blocked", "vote.confidence", "score")
