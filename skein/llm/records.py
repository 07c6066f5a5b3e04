"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

Every document becomes one record of a shard file:

    uint64 length of the data, uint32 masked CRC-32C of these 8 bytes, data, uint32 masked CRC-32C of the data

all little-endian, mask(c) = rotate right by 15, plus 0xa282ead8: the framing that training readers know. The data are int64 doc_id, uint32
number of tokens, then the ids: 2 bytes each if the vocabulary allows, else 4. A task writes one shard under a name of its
attempt and moves it into place when it is whole, so a repeated task replaces its shard by an equal one. The index is a
table beside the shards (doc_id, shard, offset, n_bytes, n_tokens, masked_crc): a reader shuffles the index and fetches by offset.

Checksums of all records of a batch are computed at once: CRC is linear, so blocks are summed from per-position tables
and moved into place by shift tables.

Edge cases: null text gives a record of no tokens, as empty text does; a null doc_id is NULL_ID in the record and null in the index.
Repeated rows are records of their own. An empty table gives an empty index and no shard. A partition without rows writes no shard.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import common as C

NULL_ID = -(1 << 63)
BLOCK = 128
INDEX = "doc_id long, shard string, offset long, n_bytes long, n_tokens int, masked_crc long"


@cache
def tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """For each position in a block and byte its share of the block's CRC; for each k the shift by 2^k zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    step = lambda x: (x >> np.uint32(8)) ^ t[x & 255]
    place = np.empty((BLOCK, 256), np.uint32)
    place[-1] = t
    for j in range(BLOCK - 2, -1, -1):
        place[j] = step(place[j + 1])
    byte = np.arange(256, dtype=np.uint32)
    shifts = [np.stack([step(byte << np.uint32(8 * i)) for i in range(4)])]
    for _ in range(40):
        shifts.append(shift(shifts[-1], shifts[-1]))
    return place, shifts


def shift(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def shifted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC registers after n zero bytes each."""
    _, shifts = tables()
    x = x.copy()
    for k in range(int(n.max()).bit_length() if len(n) else 0):
        on = (n >> k) & 1 == 1
        x[on] = shift(shifts[k], x[on])
    return x


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    if not len(parts):
        return np.empty(0, np.uint32)
    n = np.maximum(-(-lens // BLOCK), 1)
    ends = np.cumsum(n)
    place, _ = tables()
    buf = np.zeros(int(ends[-1]) * BLOCK, np.uint8)  # each part ends with a block; zeros before it count nothing
    for p, e, k in zip(parts, (ends * BLOCK).tolist(), lens.tolist(), strict=True):
        buf[e - k : e] = np.frombuffer(p, np.uint8)
    grid = np.ascontiguousarray(buf.reshape(-1, BLOCK).T)
    raw = np.zeros(grid.shape[1], np.uint32)
    for j in range(BLOCK):
        raw ^= place[j][grid[j]]
    behind = np.repeat(ends, n) - 1 - np.arange(len(raw))
    moved = shifted(raw, behind * BLOCK)
    total = np.bitwise_xor.reduceat(moved, ends - n)
    return total ^ shifted(np.full(len(parts), 0xFFFFFFFF, np.uint32), lens) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def framed(data: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The records, and the masked checksums of their data."""
    heads = [struct.pack("<Q", len(d)) for d in data]
    a, b = masked(crc32c(heads)), masked(crc32c(data))
    return [b"".join((h, x, d, y)) for h, x, d, y in zip(heads, (v.tobytes() for v in a.astype("<u4")), data, (v.tobytes() for v in b.astype("<u4")), strict=True)], b


def serialised(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    return struct.pack("<qI", NULL_ID if doc_id is None else doc_id, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, n = struct.unpack_from("<qI", data)
    return None if doc_id == NULL_ID else doc_id, np.frombuffer(data, "<u2" if len(data) == 12 + 2 * n else "<u4", n, 12)


def write(docs: DataFrame, path: str, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """Writes shards and index under path, a URI that all executors reach, and returns the index."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        name = f"shard-{ctx.partitionId():06d}.records"
        files, folder = fs.FileSystem.from_uri(path)
        draft, at, out = f"{folder}/shards/.{name}-{ctx.taskAttemptId()}", 0, None
        c = bpe.codec(vocabulary)
        wide = len(c.bytes) > 1 << 16
        for whole in it:
            for b in C.slices(whole):
                if out is None:
                    files.create_dir(f"{folder}/shards", recursive=True)
                    out = files.open_output_stream(draft)
                ids, cut = c.encode(*C.codepoints(b.column("text")))
                cut = cut.tolist()
                keys = b.column("doc_id")
                frames, crc = framed([serialised(k, ids[i:j], wide) for k, i, j in zip(keys.to_pylist(), cut[:-1], cut[1:], strict=True)])
                out.write(b"".join(frames))
                size = np.fromiter(map(len, frames), np.int64, len(frames))
                starts = at + np.cumsum(size) - size
                at += int(size.sum())
                yield pa.RecordBatch.from_arrays([keys, pa.array([name] * len(keys)), pa.array(starts), pa.array(size), pa.array(np.diff(cut), pa.int32()), pa.array(crc.astype(np.int64))], names=["doc_id", "shard", "offset", "n_bytes", "n_tokens", "masked_crc"])
        if out is not None:
            out.close()
            files.move(draft, f"{folder}/shards/{name}")

    index = C.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batches, INDEX)
    index.write.parquet(f"{path}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


def read(index: DataFrame, path: str) -> DataFrame:
    """doc_id and token_ids of the records that the rows of an index, in any order, point at. A wrong checksum raises."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path)
        opened: dict = {}
        for b in it:
            data = []
            for shard, at, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "n_bytes")), strict=True):
                f = opened.get(shard) or opened.setdefault(shard, files.open_input_file(f"{folder}/shards/{shard}"))
                frame = f.read_at(n, at)
                if len(frame) != n or struct.unpack_from("<Q", frame)[0] != n - 16 or framed([frame[12:-4]])[0][0] != frame:
                    raise ValueError(f"record at {at} of {shard} is damaged")
                data.append(parsed(frame[12:-4]))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in data], pa.int64()), pa.array([d[1].astype(np.int32) for d in data], pa.list_(pa.int32()))], names=["doc_id", "token_ids"])

    return C.mapped(index.select("shard", "offset", "n_bytes"), batches, "doc_id long, token_ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write(C.read(spark, sf_dir, "documents"), C.new_path(spark, "records"))
