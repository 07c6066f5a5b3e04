"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60


def weighted(vector_hits: DataFrame, text_hits: DataFrame, vector_weight: float = 0.5, text_weight: float = 0.5, alone: DataFrame | None = None) -> DataFrame:
    """Ranks count from 0: score = sum of w / (60 + rank). Both ranks and the source are kept; nothing is cut off. alone: query_ids that only one
    retriever ran for, which scores them by weight 1."""
    if alone is not None:
        both = weighted(vector_hits, text_hits, vector_weight, text_weight)
        single_ = alone.select("query_id", F.lit(True).alias("alone"))
        rank = F.coalesce("vector_rank", "text_rank")
        score = F.when(F.col("alone"), F.round(1.0 / (RANK_CONSTANT + rank), 9)).otherwise(F.col("score"))
        return both.join(single_, "query_id", "left").select("query_id", "id", score.alias("score"), "vector_rank", "text_rank", "source")
    v = vector_hits.select("query_id", "id", (F.col("rank") - 1).alias("vector_rank"))
    t = text_hits.select("query_id", "id", (F.col("rank") - 1).alias("text_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (RANK_CONSTANT + F.col(c)), F.lit(0.0))
    source = F.when(F.col("vector_rank").isNull(), "text").when(F.col("text_rank").isNull(), "vector").otherwise("both")
    return v.join(t, ["query_id", "id"], "full_outer").select("query_id", "id", F.round(part("vector_rank", vector_weight) + part("text_rank", text_weight), 9).alias("score"), "vector_rank", "text_rank", source.alias("source"))


def single(hits: DataFrame, source: str) -> DataFrame:
    """One retriever alone: 1 / (60 + rank from 0), whatever the weights."""
    r = F.col("rank") - 1
    return hits.select("query_id", "id", F.round(1.0 / (RANK_CONSTANT + r), 9).alias("score"), (r if source == "vector" else F.lit(None).cast("int")).alias("vector_rank"), (r if source == "text" else F.lit(None).cast("int")).alias("text_rank"), F.lit(source).alias("source"))


def sets(named: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Any number of ranked sets, ranks from 1."""
    each = [h.select("query_id", "id", (F.lit((weights or {}).get(name, 1.0)) / (RANK_CONSTANT + F.col("rank"))).alias("part")) for name, h in named.items()]
    union = each[0]
    for h in each[1:]:
        union = union.unionByName(h)
    return union.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))


def min_max(hits: DataFrame) -> DataFrame:
    """Scores of each query from 0 to 1; 0 where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("score", F.round(F.coalesce((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), 6))
