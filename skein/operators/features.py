"""Model inputs: encoders, casts, shapes, payloads and the model configuration text."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _labels(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their number in sorted order: ranked where the distinct values are, not over all rows."""
    v = df.select(F.col(column).alias("__value")).where("__value is not null").distinct()
    return v.withColumn("__label", F.row_number().over(Window.orderBy("__value")) - 1)


def label(df: DataFrame, column: str, out: str = "label") -> DataFrame:
    """Sorted classes numbered from 0; null stays null."""
    names = _labels(df, column)
    return df.join(names, df[column] == F.col("__value"), "left").withColumn(out, F.col("__label")).drop("__value", "__label")


def one_hot(df: DataFrame, column: str, out: str = "one_hot") -> DataFrame:
    n = _labels(df, column).agg(F.count("*").cast("int").alias("__n"))
    hot = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.when(i == F.col("__l"), 1.0).otherwise(0.0))
    return label(df, column, "__l").crossJoin(n).withColumn(out, F.when(F.col("__l").isNotNull(), hot)).drop("__l", "__n")


def binary(df: DataFrame, column: str, out: str = "binary") -> DataFrame:
    """Two classes give [0, b]; more give the indicator row, one gives [0]."""
    n = _labels(df, column).agg(F.count("*").cast("int").alias("__n"))
    l = F.col("__l")  # noqa: E741
    row = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.when(i == l, 1).otherwise(0))
    value = F.when(F.col("__n") == 2, F.array(F.lit(0), l)).when(F.col("__n") > 2, row).otherwise(F.array(F.lit(0)))
    return label(df, column, "__l").crossJoin(n).withColumn(out, F.when(l.isNotNull(), value)).drop("__l", "__n")


ENCODERS = {"label": label, "onehot": one_hot, "binary": binary}


def encode(df: DataFrame, schemes: dict[str, str]) -> DataFrame:
    """Each column by its scheme; 'none' passes, an unknown scheme drops the column."""
    for column, scheme in schemes.items():
        if scheme in (None, "none"):
            continue
        if scheme not in ENCODERS:
            df = df.drop(column)
            continue
        df = ENCODERS[scheme](df, column, f"__{column}").drop(column).withColumnRenamed(f"__{column}", column)
    return df


TYPES = {"INT8": "byte", "UINT8": "short", "INT16": "short", "INT32": "int", "INT64": "long", "FP16": "float", "FP32": "float", "FP64": "double", "BOOL": "boolean"}


def tensor_cast(value: Column, kind: str) -> Column:
    """A text or number as the tensor type; integers are cut off towards zero, booleans are whether that isn't 0. Unknown kinds are floats."""
    kind = kind.removeprefix("TYPE_")
    if kind.startswith("COMPLEX"):
        t = F.regexp_replace(value.cast("string"), r"[()\s]", "")
        number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
        im = F.regexp_extract(t, rf"({number})j$", 1)
        re_ = F.regexp_extract(t, rf"^({number})(?:[+-].*j)?$", 1)
        return F.struct(F.coalesce(F.nullif(re_, F.lit("")).cast("double"), F.lit(0.0)).alias("re"), F.coalesce(F.nullif(im, F.lit("")).cast("double"), F.lit(0.0)).alias("im"))
    name = TYPES.get(kind, "float")
    d = value.cast("double")
    if name in ("byte", "short", "int", "long"):
        return d.cast("long").cast(name)
    return d.cast("long") != 0 if name == "boolean" else d.cast(name)


def mapping(text: Column) -> Column:
    """Inputs and outputs of a model's stored mapping document, as JSON texts."""
    return F.struct(F.get_json_object(text, "$._source.input").alias("input"), F.get_json_object(text, "$._source.output").alias("output"))


def reshape(flat: Column, width: int | list[int]) -> Column:
    """A flat array as rows of `width`, or nested by several widths, the innermost last; an array that doesn't divide so is null."""
    if isinstance(width, list):
        for w in reversed(width):
            flat = reshape(flat, w)
        return flat
    rows = F.transform(F.sequence(F.lit(0), (F.size(flat) / width).cast("int") - 1), lambda i: F.slice(flat, i * width + 1, width))
    return F.when((F.size(flat) % width == 0) & (F.size(flat) > 0), rows)


def payload(name: Column, kind: Column, shape: Column, data: Column) -> Column:
    """The request body of one input as JSON."""
    return F.to_json(F.struct(F.array(F.struct(name.alias("name"), kind.alias("datatype"), shape.alias("shape"), data.alias("data"))).alias("inputs")))


TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},]|[^\s\[\]{},:"]+')


def parse_config(text: str) -> dict:
    """A protobuf-text-like configuration: colons are noise, [ ] and { } nest, negative numbers stay texts."""
    toks = TOKEN.findall(text)
    at = 0

    def scalar(t: str):
        if t.startswith('"'):
            return t[1:-1]
        if t in ("true", "false"):
            return t == "true"
        return int(t) if re.fullmatch(r"\d+", t) else float(t) if re.fullmatch(r"\d+\.\d*", t) else t

    def value():
        nonlocal at
        t = toks[at]
        at += 1
        if t == "[":
            out = []
            while toks[at] != "]":
                if toks[at] == ",":
                    at += 1
                    continue
                out.append(value())
            at += 1
            return out
        return pairs("}") if t == "{" else scalar(t)

    def pairs(end: str | None) -> dict:
        nonlocal at
        out: dict = {}
        while at < len(toks) and toks[at] != end:
            if toks[at] == ",":
                at += 1
                continue
            key = scalar(toks[at])
            at += 1
            out[str(key)] = value()
        at += 1
        return out

    return pairs(None)


@F.udf(T.StringType())
def config_json(text: str | None) -> str | None:
    """parse_config as JSON: configurations are few and small."""
    return None if text is None else json.dumps(parse_config(text))
