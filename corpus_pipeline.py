"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, secret scans, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and is written as Parquet and read
again before the next. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, common, decontaminate, neardup, quality, secrets


def _encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality.stage),
    ("near-dedup", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("secret scans", secrets.stage),
    ("byte-level BPE", _encoded),
]

#: A trained model, sketches and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the table documents."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, "stage")
    return docs
