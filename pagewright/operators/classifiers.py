"""Page classifiers on top of Spark ML.

Training follows the usual public definitions: TF-IDF with word 1-2-grams, sublinear term
frequency, smoothed inverse document frequency and unit length; hashed word 1-2-grams; and
given sentence embeddings. Each feeds a logistic regression (binomial for two classes, else
multinomial) with balanced class weights. Vectors are built by Spark expressions; there is no Python in the row path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.operators.ensemble import classifier_vote
from pagewright.session import materialize

MAX_FEATURES, MIN_DOCS = 20_000, 2
HASH_FEATURES = 1 << 18
_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


def terms(text: Column) -> Column:
    """Lower-case words of two or more word characters and their neighbour pairs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.transform(
        F.array(words),
        lambda w: F.concat(
            w,
            F.transform(
                F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
                lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)),
            ),
        ),
    )[0]


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf). The count is combined before the shuffle."""
    return (
        docs.select(key, F.explode_outer(terms(F.col(text))).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy(key, "term")
        .agg(F.count("*").alias("tf"))
    )


def vocabulary(counts: DataFrame, n_docs: int, max_features: int | None = MAX_FEATURES, min_docs: int = MIN_DOCS) -> DataFrame:
    """The `max_features` most frequent terms in at least `min_docs` documents: index, term, df, idf.

    A classifier bounds its vocabulary by `max_features`. Without it all terms are kept and have no index.
    """
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1
    kept = stats.filter(F.col("df") >= min_docs)
    if max_features is None:
        return kept.select(F.lit(None).cast("int").alias("index"), "term", "df", idf.alias("idf"))
    kept = kept.orderBy(F.desc("total"), "term").limit(max_features)
    # At most max_features rows reach this single-partition window.
    index = F.row_number().over(W.orderBy("term")) - 1
    return kept.select(index.alias("index"), "term", "df", idf.alias("idf"))


def tfidf_weights(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, index, term, weight) with unit length per document. The terms are shuffled twice: to their `idf`, and back to their document."""
    raw = counts.join(vocab, "term").select(key, "index", "term", ((F.log(F.col("tf").cast("double")) + 1) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return raw.filter(F.col(key).isNotNull()).select(key, "index", "term", (F.col("raw") / norm).alias("weight"))


def damped(counts: Column) -> Column:
    """A sparse vector of counts as one of 1 + ln(count), in the row.

    The vector type is reached through JSON because the built-in conversion makes dense ones.
    """
    cells = F.unwrap_udt(counts)
    values = F.transform(cells["values"], lambda n: F.log(n) + 1)
    parts = F.struct(
        F.struct(F.lit(0).alias("type"), cells["size"].alias("size"), cells["indices"].alias("indices"), values.alias("values")).alias("v")
    )
    return F.from_json(F.to_json(parts), _VECTOR)["v"]


@dataclass
class TfidfVectors:
    """A fitted vectoriser: look-up of terms, their inverse document frequency, and unit length. Nothing is shuffled to apply it."""

    terms: CountVectorizerModel
    scale: PipelineModel

    @classmethod
    def fit(cls, docs: DataFrame, key: str, text: str, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> TfidfVectors:
        """The vocabulary of `docs`; the driver receives `max_features` terms at most."""
        vocab = vocabulary(term_counts(docs, key, text), docs.count(), max_features, min_docs).orderBy("index").select("term", "idf").collect()
        names = CountVectorizerModel.from_vocabulary([r["term"] for r in vocab], "terms", "counts")
        idf = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in vocab]), inputCol="damped", outputCol="scaled")
        return cls(names, PipelineModel([idf, Normalizer(p=2.0, inputCol="scaled", outputCol="features")]))

    def transform(self, docs: DataFrame, text: str) -> DataFrame:
        """`docs` with `features`; texts that are null or have no known term get a vector of zeros."""
        known = docs.withColumn("terms", F.coalesce(terms(F.col(text)), F.array().cast("array<string>")))
        counted = self.terms.transform(known).withColumn("damped", damped(F.col("counts")))
        return self.scale.transform(counted).drop("terms", "counts", "damped", "scaled")

    def save(self, path: str) -> None:
        self.terms.write().overwrite().save(f"{path}/terms")
        self.scale.write().overwrite().save(f"{path}/scale")

    @classmethod
    def load(cls, path: str) -> TfidfVectors:
        return cls(CountVectorizerModel.load(f"{path}/terms"), PipelineModel.load(f"{path}/scale"))


def class_sizes(labelled: DataFrame, label: str = "label") -> dict[str, int]:
    """Rows per class in label order. The driver receives one row per class."""
    counts = labelled.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return {r["label"]: r["n"] for r in counts.orderBy("label").collect()}


def prepared(labelled: DataFrame, sizes: dict[str, int], label: str = "label") -> DataFrame:
    """Add `label_index` and the balanced `weight` = rows / (classes x rows of the class).

    Both come from literal maps: a join on the label would send each class to one task.
    """
    total = sum(sizes.values())
    index = F.create_map(*[F.lit(x) for i, c in enumerate(sizes) for x in (c, float(i))])
    weight = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, total / (len(sizes) * n))])
    return labelled.withColumns({"label_index": F.element_at(index, F.col(label)), "weight": F.element_at(weight, F.col(label))})


def _regression(n_rows: float, c: float = 1.0, max_iter: int = 1000) -> LogisticRegression:
    # Balanced weights sum to the number of rows; Spark divides the loss by that sum.
    return LogisticRegression(
        featuresCol="features", labelCol="label_index", weightCol="weight", maxIter=max_iter,
        regParam=1.0 / (c * max(n_rows, 1.0)), elasticNetParam=0.0, standardization=False, tol=1e-4,
    )


@dataclass
class TfidfClassifier:
    """TF-IDF and logistic regression."""

    vectors: TfidfVectors
    model: LogisticRegressionModel
    classes: list[str]
    name: str = "TF-IDF"

    @classmethod
    def train(cls, labelled: DataFrame, key: str, text: str, label: str = "label") -> TfidfClassifier:
        labelled = labelled.select(key, F.col(text).alias("__text"), F.col(label).cast("string").alias("label"))
        sizes = class_sizes(labelled)
        vectors = TfidfVectors.fit(labelled, key, "__text")
        rows = prepared(vectors.transform(labelled, "__text"), sizes)
        # Fitting reads its input more than once.
        rows = materialize(rows.select("features", "label_index", "weight"), "training")
        return cls(vectors, _regression(sum(sizes.values())).fit(rows), list(sizes))

    def predict(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(key, page_type, probability), row by row. Documents without a known term get the intercept's class."""
        rows = self.vectors.transform(docs.select(F.col(key), F.col(text).alias("__text")), "__text")
        return best_class(self.model.transform(rows), self.classes, key)

    def save(self, path: str) -> None:
        self.vectors.save(f"{path}/vectors")
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        spark.createDataFrame([(self.classes,)], "classes array<string>").write.mode("overwrite").json(f"{path}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfClassifier:
        classes = spark.read.schema("classes array<string>").json(f"{path}/classes").first()["classes"]
        return cls(TfidfVectors.load(f"{path}/vectors"), LogisticRegressionModel.load(f"{path}/model"), classes)

    @classmethod
    def load_or_train(cls, spark: SparkSession, path: str, labelled: DataFrame, key: str, text: str) -> TfidfClassifier:
        """The stored model, or a new one that is then stored."""
        try:
            return cls.load(spark, path)
        except AnalysisException:
            model = cls.train(labelled, key, text)
            model.save(path)
            return model


@dataclass
class PipelineClassifier:
    """A Spark ML pipeline that ends in a logistic regression."""

    model: PipelineModel
    classes: list[str]
    name: str

    def predict(self, docs: DataFrame, key: str, column: str) -> DataFrame:
        return best_class(self.model.transform(docs.withColumnRenamed(column, "input")), self.classes, key)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        spark.createDataFrame([(self.classes, self.name)], "classes array<string>, name string").write.mode(
            "overwrite"
        ).json(f"{path}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PipelineClassifier:
        row = spark.read.schema("classes array<string>, name string").json(f"{path}/classes").first()
        return cls(PipelineModel.load(f"{path}/model"), row["classes"], row["name"])


def _fit(name: str, labelled: DataFrame, column: str, stages: list, max_iter: int) -> PipelineClassifier:
    rows = labelled.select(F.col(column).alias("input"), F.col("label").cast("string").alias("label"))
    sizes = class_sizes(rows)
    rows = materialize(prepared(rows, sizes), "training")
    pipeline = Pipeline(stages=[*stages, _regression(sum(sizes.values()), max_iter=max_iter)])
    return PipelineClassifier(pipeline.fit(rows), list(sizes), name)


def train_word_vectors(labelled: DataFrame, text: str, n_features: int = HASH_FEATURES) -> PipelineClassifier:
    """Hashed words and word pairs with a softmax. Stands in for a word-vector model; values differ from one."""
    stages = [
        RegexTokenizer(inputCol="input", outputCol="words", pattern=r"\s+"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
        HashingTF(inputCol="grams", outputCol="features", numFeatures=n_features),
    ]
    return _fit("FastText", labelled, text, stages, 25)


def train_embedding_head(labelled: DataFrame, embedding: str) -> PipelineClassifier:
    """Logistic regression on given (frozen) embeddings."""
    vectors = labelled.withColumn(embedding, array_to_vector(F.col(embedding).cast("array<double>")))
    stages = [SQLTransformer(statement="SELECT *, input AS features FROM __THIS__")]
    return _fit("MiniLM", vectors, embedding, stages, 500)


def best_class(scored: DataFrame, classes: list[str], key: str) -> DataFrame:
    """(key, page_type, probability) of the most probable class; the first of equals."""
    options = F.transform(
        vector_to_array("probability"), lambda p, i: F.struct(p.alias("p"), (-i).alias("order"))
    )
    best = F.array_max(options)
    names = F.array(*[F.lit(c) for c in classes])
    return scored.select(key, best.alias("__best")).select(
        key, F.element_at(names, (F.lit(1) - F.col("__best.order")).cast("int")).alias("page_type"),
        F.col("__best.p").alias("probability"),
    )


def as_vote(predicted: DataFrame, model: str) -> DataFrame:
    """Predictions as detection-like rows: page_type, is_blocked, confidence, score, reason."""
    vote = classifier_vote(model, F.col("page_type"), F.col("probability"))
    title = {"TF-IDF": "TF-IDF+LR", "MiniLM": "MiniLM transformer"}.get(model, model)
    suffix = "" if model == "MiniLM" else " classifier"
    return predicted.withColumn("vote", vote).withColumn(
        "reason",
        F.concat(F.lit(f"{title}{suffix}: "), "page_type", F.lit(" @ "), F.format_string("%.2f", "probability")),
    ).withColumn("score", F.floor(F.col("probability") * 100).cast("int"))
