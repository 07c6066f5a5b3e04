"""What the training-data operators share: tables, written intermediates, and whole Arrow batches of text as numpy arrays.

Texts are handled a batch at a time: one batch is one array of code points with document offsets,
so normalising, word splitting and hashing are a few numpy passes, never a loop over rows.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
#: Text bytes that one numpy pass handles; bounds a Python worker's memory, not what is read.
SLICE_BYTES = 1 << 20
#: Bytes of rows that Spark puts into an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or with a local master and none set, a temporary one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skein-"))
    return sc.getCheckpointDir().rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own under the shared folder, deleted when the driver ends."""
    path = f"{work_dir(spark)}/skein-{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(lambda: [drop(s, p) for s, p in list(_written)])
    _written.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and a lost executor costs nothing that came before."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.skein_path = path
    return out


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that written() or new_path() made."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - at the driver's end the JVM may be gone already
        return
    _written[:] = [x for x in _written if x[1] != path]


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a written table, asked of the file system: what a broadcast is held against."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def mapped(df: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of BATCH_BYTES (set for the session in place of Spark's default of 64 MB; a limit of the user's stays), after which a worker gives its memory back."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_LIMIT) == "67108864b":
        conf.set(ARROW_LIMIT, str(BATCH_BYTES))

    def all_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(it)
        release()

    return df.mapInArrow(all_batches, schema)


def release() -> None:
    """Freed memory back to the system: a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about `most` bytes of text each."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(np.nan_to_num(np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), np.float64)))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def codepoints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows one after another, and each row's offsets (rows + 1). Null is as empty; bytes that aren't UTF-8 become U+FFFD."""
    if pa.types.is_large_string(col.type) or pa.types.is_string_view(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pa.compute.fill_null(col, "")
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets -= offsets[0]
    try:
        s = raw.tobytes().decode()
    except UnicodeDecodeError:
        fixed = [raw[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return codepoints(pa.array(fixed, pa.string()))
    cp = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    if len(cp) == len(raw):
        return cp, offsets
    seen = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return cp, seen[offsets]


@cache
def norm_table() -> np.ndarray:
    """Code point -> its lower case if it is a letter, mark or digit, else 0."""
    t = np.zeros(0x110000, np.uint32)
    for i in (*range(0x32400), *range(0xE0100, 0xE01F0)):
        c = chr(i)
        if unicodedata.category(c)[0] in "LNM":
            low = c.lower()
            t[i] = ord(low) if len(low) == 1 else i
    return t


@cache
def mix_table() -> np.ndarray:
    """Code point -> 64 random-looking bits."""
    return mix(np.arange(0x110000, dtype=U) + U(0x51ED2701))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in runs that stay in the processor's cache."""
    x = np.array(x, U)
    flat = x.reshape(-1)
    for i in range(0, flat.size, 1 << 14):
        v = flat[i : i + (1 << 14)]
        y = v >> U(30)
        v ^= y
        v *= U(0xBF58476D1CE4E5B9)
        np.right_shift(v, U(27), out=y)
        v ^= y
        v *= U(0x94D049BB133111EB)
        np.right_shift(v, U(31), out=y)
        v ^= y
    return x


BASE = U(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), BASE, U)
    p[0] = 1
    return np.multiply.accumulate(p)


def runs(on: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values; a run ends with its document."""
    if not len(on):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(len(on) + 1, bool)
    edge[offsets] = True
    start = on.copy()
    start[1:] &= ~on[:-1] | edge[1:-1]
    end = on.copy()
    end[:-1] &= ~on[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hash_runs(cp: np.ndarray, on: np.ndarray | slice, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of code points; on: marks the runs' code points."""
    if not len(start):
        return np.empty(0, U)
    lens = end - start
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    return mix(np.add.reduceat(mix_table()[cp[on]] * powers(int(lens.max()))[pos], first))


def words(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased alphanumeric words: hashes, each document's offsets into them, and each word's start and end in cp."""
    low = norm_table()[cp]
    on = low != 0
    start, end = runs(on, offsets)
    return hash_runs(low, on, start, end), np.searchsorted(start, offsets), start, end


def word_list(text: str) -> list[str]:
    """The words of one text."""
    low = norm_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    return np.where(low == 0, 32, low).astype(np.uint32).tobytes().decode("utf-32-le").split()


def shingles(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n words in a row, the document of each, and the first word's index; a document of fewer words gives none."""
    k = len(h) - n + 1
    if k <= 0:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(doc[:k] == doc[n - 1 :])
    g = h[at]
    for j in range(1, n):
        g = g * BASE + h[at + j]
    return mix(g), doc[at], at
