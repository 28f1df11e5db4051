"""Consensus of several classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import signals as S
from pagewright.functions.text import let


def classifier_vote(model: str, page_type: Column, probability: Column) -> Column:
    """Vote of one model: struct<is_blocked, page_type, confidence, model>."""
    blocked = F.upper(page_type).isin(S.ML_BLOCKED_CLASSES) & (probability > S.ML_BLOCK_CONFIDENCE)
    return F.struct(
        blocked.alias("is_blocked"),
        page_type.alias("page_type"),
        F.round(probability, 3).alias("confidence"),
        F.lit(model).alias("model"),
    )


def consensus(votes: Column) -> Column:
    """A page is blocked only if every model says so. NULL where there are no votes.

    Result: struct<is_blocked, page_type, confidence, reasons, score> like a rule detection.
    """

    def decide(given: Column) -> Column:
        passing = F.filter(given, lambda v: ~v["is_blocked"])
        types = F.array_distinct(F.transform(given, lambda v: v["page_type"]))
        counted = F.transform(
            types,
            lambda t, i: F.struct(
                F.size(F.filter(given, lambda v: v["page_type"] == t)).alias("n"), (-i).alias("order"), t.alias("type")
            ),
        )
        mean = F.aggregate(given, F.lit(0.0), lambda a, v: a + v["confidence"]) / F.size(given)
        named = F.transform(
            given,
            lambda v: F.concat(
                v["model"], F.lit(": "), v["page_type"], F.lit(" ("), F.format_string("%.2f", v["confidence"]), F.lit(")")
            ),
        )
        content = F.size(passing) > 0
        why = F.when(content, F.lit("ML ensemble (AND rule): content confirmed — ")).otherwise(
            F.lit("ML ensemble (AND rule): all models blocked — ")
        )
        return F.struct(
            (~content).alias("is_blocked"),
            F.when(content, F.lit("NORMAL")).otherwise(F.array_max(counted)["type"]).alias("page_type"),
            F.when(content, F.array_max(F.transform(passing, lambda v: v["confidence"])))
            .otherwise(F.round(mean, 3))
            .alias("confidence"),
            F.transform(named, lambda m: F.concat(why, m)).alias("reasons"),
            F.when(content, F.lit(0)).otherwise((mean * 100).cast("int")).alias("score"),
        )

    return let(F.filter(votes, lambda v: v.isNotNull()), lambda g: F.when(F.size(g) > 0, decide(g)))


def apply_consensus(detected: DataFrame, votes: str = "votes", detection: str = "detection") -> DataFrame:
    """Replace ambiguous rule results (score 20 to 44) by the models' consensus."""
    d = F.col(detection)
    ambiguous = d["score"].between(S.SUSPICIOUS_SCORE, S.BLOCK_SCORE - 1)
    verdict = F.when(ambiguous, consensus(F.col(votes)))
    return detected.withColumn(detection, F.coalesce(verdict, d))
