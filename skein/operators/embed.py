"""Models as plug-ins: anything that turns a list of texts into rows of numbers runs in whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import text as X
from skein.functions import vector as V


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


def embed(df: DataFrame, column: str, make: Callable[[], Embedder] | None = None, out: str = "embedding", role: str | None = None, dimension: int = 64) -> DataFrame:
    """df with a vector of the column. make builds the model once in every task; without it words are hashed by expressions. role: query or passage."""
    t = X.prefixed(F.col(column), role) if role else F.col(column)
    if make is None:
        return df.withColumn(out, V.hashed(X.tokens(t), dimension).cast("array<float>"))
    asked = df.withColumn("__text", t)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in it:
            at = b.schema.get_field_index("__text")
            v = np.asarray(model([x or "" for x in b.column(at).to_pylist()]), np.float32)
            rest = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(list(v), pa.list_(pa.float32()))], names=schema.names)

    return asked.mapInArrow(batches, schema)


def describe(names: Column, kinds: Column) -> Column:
    """A plain description of a table from its columns, where no model writes one."""
    return F.array_join(F.zip_with(names, kinds, lambda n, k: F.concat(n, F.lit(" ("), k, F.lit(")"))), ", ")
