"""An index as a set of tables under one path: metadata, documents, tombstones, snapshots and a log of operations.

One writer at a time appends; readers see whole commits, as Spark's committer moves files into place. docs holds every added row, tombstones
deleted ids; a snapshot is the live rows at its time; recovery is the last snapshot and the operations after its checkpoint."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import vector as V
from skein.sources import wal

LOG = wal.OPERATION


class Index:
    def __init__(self, spark: SparkSession, root: str, name: str, dimension: int):
        self.spark, self.name, self.dimension = spark, f"{name.strip()}_d{dimension}", dimension
        self.path = f"{root.rstrip('/')}/{self.name}"

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def create(self, k: int = 10) -> Index:
        if self._exists(self.path):
            raise FileExistsError(self.name)
        meta = {"name": self.name, "dimension": self.dimension, "k": k, "created": int(time.time() * 1000)}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{self.path}/metadata")
        self._log([{"op": "CreateIndex", "index": self.name, "dimension": self.dimension, "k": k}])
        return self

    def _log(self, ops: list[dict]) -> None:
        now = int(time.time() * 1000)
        rows = [tuple(({"seq": self.next_seq() + i, "ts": now} | o).get(f) for f in wal.FIELDS) for i, o in enumerate(ops)]
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log/epoch={self.epochs()[-1]}")

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str, dimension: int) -> Index:
        """An index that is there; an unknown one is an error."""
        index = cls(spark, root, name, dimension)
        if not index._exists(f"{index.path}/metadata"):
            raise KeyError(f"index {index.name} does not exist")
        return index

    def _numbers(self, folder: str, prefix: str = "") -> list[int]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def epochs(self) -> list[int]:
        """The log's parts; a checkpoint begins a new one and drops those before it."""
        return self._numbers("log", "epoch=") or [0]

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def next_seq(self) -> int:
        return (self.log().agg(F.max("seq")).first()[0] or 0) + 1 if self._exists(f"{self.path}/log") else 1

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).option("basePath", f"{self.path}/log").parquet(*[f"{self.path}/log/epoch={e}" for e in self.epochs()])

    def add(self, rows: DataFrame, embed: bool = False) -> None:
        """rows: text, vector (or text alone with embed). The whole batch is refused if one vector has another dimension. Ids go on from the last
        without gaps: each partition of the batch, written first, counts on from those before it, so no single task sorts it. Every row is an Add of the log."""
        if embed:
            rows = rows.withColumn("vector", V.hashed(X.tokens(F.col("text")), self.dimension).cast("array<float>"))
        if not rows.where((F.size("vector") != self.dimension) | F.col("vector").isNull()).isEmpty():
            raise ValueError(f"vectors of {self.name} have {self.dimension} numbers")
        last = self.log().agg(F.max("id"), F.max("seq")).first()
        base, seq, now = (last[0] if last[0] is not None else -1) + 1, last[1] + 1, int(time.time() * 1000)
        self._delete("staging")
        rows.select("text", F.col("vector").cast("array<float>").alias("vector"), F.monotonically_increasing_id().alias("m")).write.parquet(f"{self.path}/staging")
        staged = self.spark.read.schema("text string, vector array<float>, m long").parquet(f"{self.path}/staging").withColumn("part", F.shiftright("m", 33))
        before, counts = 0, []
        for r in staged.groupBy("part").agg(F.count("*").alias("c")).orderBy("part").collect():  # a row for each partition
            counts.append((r.part, before))
            before += r.c
        offsets = self.spark.createDataFrame(counts, "part long, before long")
        numbered = staged.join(F.broadcast(offsets), "part").withColumn("n", F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1))
        numbered.select(F.lit("Add").alias("op"), (F.col("n") + seq).alias("seq"), F.lit(self.name).alias("index"), (F.col("n") + base).alias("id"), F.lit(None).cast("array<long>").alias("ids"), "text", "vector", F.lit(None).cast("int").alias("dimension"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("snapshot_id"), F.lit(now).alias("ts")).write.mode("append").parquet(f"{self.path}/log/epoch={self.epochs()[-1]}")
        self._delete("staging")

    def delete(self, ids: list[int]) -> None:
        self._log([{"op": "Delete", "index": self.name, "ids": ids}])

    def snapshot(self, keep: int | None = None) -> int:
        """Writes the live rows, begins a new part of the log with a checkpoint (which holds the last id), and drops the parts before it and all but the newest snapshots."""
        now = max(int(time.time() * 1000), *(x + 1 for x in self.snapshots()[-1:]), 0)
        self.docs().write.parquet(f"{self.path}/snapshots/{now}")
        last = self.log().agg(F.max("id"), F.max("seq")).first()
        old = self.epochs()
        row = {"op": "Checkpoint", "seq": last[1] + 1, "index": self.name, "id": last[0], "snapshot_id": now, "ts": now}
        self.spark.createDataFrame([tuple(row.get(f) for f in wal.FIELDS)], LOG).coalesce(1).write.parquet(f"{self.path}/log/epoch={old[-1] + 1}")
        for e in old:
            self._delete(f"log/epoch={e}")
        for gone in self.snapshots()[:-keep] if keep else []:
            self._delete(f"snapshots/{gone}")
        return now

    def snapshots(self) -> list[int]:
        return self._numbers("snapshots")

    def get(self, id_: int) -> DataFrame:
        """The live row of one id, if there is one."""
        return self.docs().where(F.col("id") == id_)

    def docs(self) -> DataFrame:
        """index, id, text, vector of the live rows: the latest snapshot and what came after its checkpoint."""
        had = self.snapshots()
        if not had:
            return wal.replayed(self.log())
        base = self.spark.read.parquet(f"{self.path}/snapshots/{had[-1]}")
        return wal.replayed(wal.since_checkpoint(self.log(), had[-1]), base)
