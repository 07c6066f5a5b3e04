"""Language identification by compression with per-language zstandard raw-content dictionaries.

Each language has a dictionary of lower-cased text of that language. A text, lower-cased, is cut into blocks of CHUNK bytes, every block is
compressed with every dictionary, and the language whose dictionary gives the fewest bytes over the whole text wins.
If the runner-up needs less than MARGIN more, the text is rejected: language "und".

Dictionaries are made of labelled rows: for each language the rows with the least hash of doc_id, whole texts, at most
SAMPLE rows and DICTIONARY bytes; that bound is all that is sampled.

Result: doc_id, language, margin (share by which the runner-up is larger), runner_up.

Edge cases: null and empty texts are "und" with margin 0 and no runner-up. Repeated rows give repeated results. Ties go
to "und" (margin 0). Rows whose lang is null or empty serve no dictionary; with fewer than two languages everything is
"und". Columns other than doc_id, text, lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

CHUNK = 4096
MARGIN = 0.02
SAMPLE = 64
DICTIONARY = 112 << 10
LEVEL = 6
SCHEMA = "doc_id long, language string, margin double, runner_up string"


def dictionaries(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Language -> raw content. At most `sample` documents a language reach the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    some = rows.where("id is not null and lang <> '' and text <> ''").select("id", "lang").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample)
    texts: dict[str, list[tuple]] = {}
    for r in rows.join(F.broadcast(some), ["id", "lang"]).groupBy("id", "lang", "nth").agg(F.min("text").alias("text")).collect():  # a bounded side and result
        texts.setdefault(r.lang, []).append((r.nth, r.text))
    return {k: "\n".join(t for _, t in sorted(v)).lower().encode()[:size] for k, v in sorted(texts.items())}


class Classifier:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.names = [k for k, v in content.items() if len(v) >= 8]
        self.compress = []
        for k in self.names:
            d = z.ZstdCompressionDict(content[k], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compress.append(z.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: bytes) -> list[int]:
        """Compressed bytes with each dictionary, over all blocks."""
        out = [0] * len(self.names)
        for at in range(0, len(text), CHUNK):
            part = text[at : at + CHUNK]
            for i, f in enumerate(self.compress):
                out[i] += len(f(part))
        return out


def identify(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """One row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(shared.value)
        for b in it:
            text = b.column("text")
            said, by, second = ["und"] * len(text), np.zeros(len(text)), [None] * len(text)
            if len(c.names) > 1:
                for i, s in enumerate(text):
                    raw = s.as_py().lower().encode() if s.is_valid else b""
                    if not raw:
                        continue
                    n = c.sizes(raw)
                    order = sorted(range(len(n)), key=lambda j: (n[j], c.names[j]))
                    by[i] = n[order[1]] / n[order[0]] - 1
                    second[i] = c.names[order[1]]
                    if by[i] >= margin:
                        said[i] = c.names[order[0]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(said, pa.string()), pa.array(by.round(6)), pa.array(second, pa.string())], names=["doc_id", "language", "margin", "runner_up"])

    return C.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batches, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return identify(docs, dictionaries(docs))
