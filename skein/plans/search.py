"""The search facade: which retrievers run, how their hits are fused, and the texts of what is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import fusion, retrieval

DEFAULTS = {"vector_weight": 0.5, "text_weight": 0.5, "k": 10, "text_offset": 0, "text_length": 100}


def with_text(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with the document's text, Unknown where it has none."""
    return hits.join(docs.select("id", "text"), "id", "left").withColumn("text", F.coalesce("text", F.lit("Unknown")))


def search(docs: DataFrame | None, vectors: DataFrame | None, queries: DataFrame, only: list | DataFrame | None = None, postings: retrieval.Postings | None = None, cells: retrieval.Cells | None = None, **options) -> DataFrame:
    """Hybrid search of a batch: queries has query_id and vector, text or both.

    Which formula applies is decided for each query by which retrievers run for it, not by what they find: a null vector or an empty text runs none,
    a text without hits still gives the vector hits their weight. A query with neither is an error. A table without a vector column (or rows)
    has no vector retriever. postings: a written text index in place of the texts; cells: a vector index, whose hits are approximate."""
    o = DEFAULTS | options
    here = vectors is not None and not vectors.limit(1).isEmpty()
    has_vector = F.size("vector") > 0 if "vector" in queries.columns and here else F.lit(False)
    has_text = F.length(F.trim("text")) > 0 if "text" in queries.columns and (docs is not None or postings is not None) else F.lit(False)
    asked = queries.withColumn("by_vector", F.coalesce(has_vector, F.lit(False))).withColumn("by_text", F.coalesce(has_text, F.lit(False)))
    ways = {(r.by_vector, r.by_text) for r in asked.select("by_vector", "by_text").distinct().collect()}
    if (False, False) in ways or not ways and not ({"vector", "text"} & set(queries.columns)):
        raise ValueError("a query needs a vector or a text")
    v = t = None
    if any(w[0] for w in ways) or not any(w[1] for w in ways) and here:
        mine = asked.where("by_vector")
        v = retrieval.ivf_knn(cells, mine, o["k"], only=only) if cells is not None else retrieval.knn_blocks(vectors, mine, o["k"], only=only)
    if any(w[1] for w in ways):
        t = retrieval.text_search(docs, asked.where("by_text"), o["text_length"], o["text_offset"], every=True, only=only, postings=postings)
    if v is not None and t is not None:
        found = fusion.weighted(v, t, o["vector_weight"], o["text_weight"], asked.where("by_vector <> by_text") if len(ways) > 1 else None)
    else:
        found = fusion.single(v, "vector") if v is not None else fusion.single(t, "text")
    return with_text(found, docs) if docs is not None else found


def without_deleted(docs: DataFrame, tombstones: DataFrame, unknown: bool = False) -> DataFrame:
    """Live documents; with `unknown` deleted ones still rank, under the text Unknown."""
    if not unknown:
        return docs.join(tombstones.select("id"), "id", "left_anti")
    gone = tombstones.select("id", F.lit(True).alias("gone"))
    return docs.join(gone, "id", "left").withColumn("text", F.when(F.col("gone"), "Unknown").otherwise(F.col("text"))).drop("gone")
