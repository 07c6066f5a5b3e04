"""The operation log: binary frames, and what reading it back gives.

Frame: length (uint32), CRC-32 of the payload (uint32), both little-endian, then the operation as JSON. A file that ends in or before a length
ends cleanly; one that ends later, or a checksum that doesn't fit, is damaged."""

from __future__ import annotations

import json
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPERATION = "op string, seq long, index string, id long, ids array<long>, text string, vector array<float>, dimension int, k long, snapshot_id long, ts long"
FIELDS = [f.split()[0] for f in OPERATION.split(", ")]


def frame(operation: dict) -> bytes:
    payload = json.dumps(operation).encode()
    return struct.pack("<II", len(payload), zlib.crc32(payload)) + payload


def frames(data: bytes) -> list[dict]:
    out, at = [], 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        if at + 8 + n > len(data):
            raise ValueError(f"frame at {at} is torn")
        payload = data[at + 8 : at + 8 + n]
        if zlib.crc32(payload) != int.from_bytes(data[at + 4 : at + 8], "little"):
            raise ValueError(f"checksum of the frame at {at} is wrong")
        out.append(json.loads(payload))
        at += 8 + n
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Operations of log files, numbered by file and place."""

    def batches(it):
        import pandas as pd

        for b in it:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                rows += [{"file": p, "place": i, "json": json.dumps(op)} for i, op in enumerate(frames(bytes(content)))]
            yield pd.DataFrame(rows, columns=["file", "place", "json"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(batches, "file string, place long, json string")
    return raw.select("file", "place", F.from_json("json", OPERATION).alias("o")).select("file", "place", *[F.col(f"o.{f}").alias(f) for f in FIELDS if f != "seq"], F.coalesce("o.seq", "place").alias("seq"))


def since_checkpoint(log: DataFrame, snapshot_id: int) -> DataFrame:
    """Operations after the last checkpoint of a snapshot; all, if there is none."""
    last = log.where((F.col("op") == "Checkpoint") & (F.col("snapshot_id") == snapshot_id)).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__last"))
    return log.crossJoin(last).where(F.col("seq") > F.col("__last")).drop("__last")


def replayed(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """index, id, text, vector after all operations: of each id the last counts, a delete removes it."""
    add = log.where("op = 'Add'").select("index", "id", "seq", "text", "vector", F.lit(True).alias("live"))
    gone = log.where("op = 'Delete'").select("index", F.explode("ids").alias("id"), "seq", F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<float>").alias("vector"), F.lit(False).alias("live"))
    both = add.unionByName(gone)
    if base is not None:
        both = both.unionByName(base.select("index", "id", F.lit(-1).cast("long").alias("seq"), "text", "vector", F.lit(True).alias("live")))
    last = both.groupBy("index", "id").agg(F.max_by(F.struct("text", "vector", "live"), "seq").alias("s"))
    return last.where("s.live").select("index", "id", "s.text", "s.vector")


def retained(snapshots: DataFrame, keep: int) -> DataFrame:
    """The newest snapshots of each index."""
    w = Window.partitionBy("index").orderBy(F.desc("snapshot_id"))
    return snapshots.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= keep).drop("__nth")
