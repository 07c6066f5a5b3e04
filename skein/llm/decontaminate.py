"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items are reduced to lower-cased words with one space between, so case, punctuation and line breaks
don't hide a passage. The test strings are all runs of WORDS words of an item (an item of fewer words is one string
itself). Runs of WORDS words are searched together, shorter items in classes of like length, so that a short one doesn't shorten the jumps of the rest. SHIFT holds for each hashed block of BLOCK characters how far the window may jump; where it is 0, the bucket of
the window's suffix hash lists the strings that can end there, and each is compared character by character. Many places
of a batch move through their windows at once, one numpy lane each, so a text of any length is cut over many lanes.

Result: doc_id, item_id, n_matches (places where a run of the item stands), first_char (of the first, in the reduced text).

clean() removes documents in which a run stands; items of fewer than REMOVING words are reported by matches() but are no reason to remove a document.
The benchmark is read in blocks of about BLOCK_BYTES of text, each small enough to be sent to every task, and all documents are searched for each block.

Edge cases: null or empty texts match nothing; null or wordless items are no test strings; items of equal text all match.
Documents of the same doc_id are searched each for itself and their matches added up; a null doc_id is a group of its
own. Without benchmark rows nothing matches. Columns other than doc_id, text, item_id are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORDS = 13
BLOCK = 10
LANE = 512
#: Items of fewer words remove nothing: such words stand in any text.
REMOVING = 5
#: Bytes of benchmark text whose search tables are sent to every task at a time (some 60 bytes of tables for each byte).
BLOCK_BYTES = 1 << 18
SCHEMA = "doc_id long, item_id long, n_matches long, first_char long"


def reduced(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """' word word ... ' of each document, with a 0 before each."""
    n = len(offsets) - 1
    low = C.norm_table()[cp]
    on = low != 0
    start, end = C.runs(on, offsets)
    # each word takes itself and the space after it; each document a 0 and a space before it
    doc = np.searchsorted(offsets, start, "right") - 1
    out = np.full(int((end - start).sum()) + len(start) + 2 * n, 32, np.uint32)
    before = np.cumsum(end - start) - (end - start) + np.arange(len(start)) + 2 * (doc + 1)
    lens = end - start
    first = np.cumsum(lens) - lens
    out[np.repeat(before - first, lens) + np.arange(int(lens.sum()))] = low[on]
    count = np.concatenate([[0], np.cumsum(lens + 1)])[np.searchsorted(start, offsets[:-1])]
    at = count + 2 * np.arange(n)
    out[at] = 0
    return out, np.append(at, len(out))


def test_strings(items: list[tuple[int, str]], words: int = WORDS) -> tuple[list[np.ndarray], list[list[int]]]:
    """Distinct test strings as code points, and the items of each."""
    found: dict[bytes, set[int]] = {}
    for item, text in items:
        cp, offsets = C.codepoints(pa.array([text], pa.string()))
        s = reduced(cp, offsets)[0][1:].tobytes().decode("utf-32-le").split()
        for i in range(max(1, len(s) - words + 1) if s else 0):
            found.setdefault(f" {' '.join(s[i : i + words])} ".encode("utf-32-le"), set()).add(item)
    return [np.frombuffer(k, np.uint32) for k in found], [sorted(v) for v in found.values()]


class WuManber:
    """The tables for strings of like length; numbers: what find() calls them."""

    def __init__(self, strings: list[np.ndarray], numbers: list[int] | None = None):
        self.strings, self.numbers = strings, numbers or list(range(len(strings)))
        self.m = min(256, *map(len, strings))
        self.block = min(BLOCK, self.m)
        most = min(255, self.m - self.block + 1)
        # a table so large that most of its places aren't met by any block
        self.bits = min(24, max(16, (len(strings) * most).bit_length() + 2))
        self.shift = np.full(1 << self.bits, most, np.uint8)
        grid = np.stack([s[: self.m] for s in strings])
        last = self.m - self.block
        for j in range(last + 1):  # the block that ends at j + block - 1
            np.minimum.at(self.shift, self._hash([grid[:, j + i] for i in range(self.block)]), np.uint8(min(255, last - j)))
        suffix = self._hash([grid[:, self.m - self.block + i] for i in range(self.block)])
        self.bucket: dict[int, list[int]] = {}
        for i, h in enumerate(suffix.tolist()):
            self.bucket.setdefault(h, []).append(i)

    def _hash(self, chars: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(chars[0]), np.uint32)
        for c in chars:
            h = h * np.uint32(0x01000193) ^ c
        return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(place, string) of every occurrence."""
        last = len(text) - self.m + 1
        if last <= 0:
            return []
        at = np.arange(0, last, LANE)
        stop = np.minimum(at + LANE, last)
        tail = self.m - self.block
        where, hashes = [], []
        while len(at):
            h = self._hash([text[at + (tail + i)] for i in range(self.block)])
            d = self.shift[h]
            hit = np.flatnonzero(d == 0)
            if len(hit):
                where.append(at[hit])
                hashes.append(h[hit])
                d[hit] = 1
            at += d
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        out = []
        for p, h in zip(*(np.concatenate(x).tolist() for x in (where, hashes)), strict=True) if where else ():
            for i in self.bucket.get(h, ()):
                s = self.strings[i]
                if p + len(s) <= len(text) and text[p + len(s) - 1] == s[-1] and np.array_equal(text[p : p + len(s)], s):
                    out.append((p, self.numbers[i]))
        return out


class Matcher:
    """Wu-Manber tables of all test strings: one for the runs of `words` words, one for each class of length of shorter items. owners: the items of each string."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS):
        strings, self.owners = test_strings(items, words)
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            classes.setdefault(0 if (s == 32).sum() > words else len(s).bit_length(), []).append(i)
        self.tables = [WuManber([strings[i] for i in c], c) for _, c in sorted(classes.items())]

    def find(self, text: np.ndarray) -> list[tuple[int, int]]:
        return [x for t in self.tables for x in t.find(text)]


def blocks(benchmark: DataFrame, least: int = 1, words: int = WORDS) -> Iterator[Matcher]:
    """The search tables of the items of at least `least` words, a bounded block of them at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        some = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]  # about BLOCK_BYTES
        m = Matcher([x for x in some if least < 2 or len(C.word_list(x[1])) >= least], words)
        if m.tables:
            yield m


def places(b: pa.RecordBatch, m: Matcher) -> Iterator[tuple[int, int, int]]:
    """(row, string, place in its reduced text) of every occurrence in the column text."""
    text, at = reduced(*C.codepoints(b.column(b.schema.get_field_index("text"))))
    for p, i in m.find(text):
        row = int(np.searchsorted(at, p, "right")) - 1
        yield row, i, p - int(at[row]) - 1


def matches(docs: DataFrame, benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """All (document, item) pairs with a common run of words."""
    spark = docs.sparkSession
    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    got = spark.createDataFrame([], SCHEMA)
    for n, m in enumerate(blocks(benchmark, 1, words)):
        shared = spark.sparkContext.broadcast(m)

        def batches(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for whole in it:
                for b in C.slices(whole):
                    found: dict[tuple[int, int], list[int]] = {}
                    for row, i, p in places(b, m):
                        for item in m.owners[i]:
                            found.setdefault((row, item), []).append(p)
                    ids = b.column("doc_id").take(pa.array([k[0] for k in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([k[1] for k in found], pa.int64()), pa.array([len(v) for v in found.values()], pa.int64()), pa.array([min(v) for v in found.values()], pa.int64())], names=["doc_id", "item_id", "n_matches", "first_char"])

        part = C.mapped(asked, batches, SCHEMA)
        got = got.unionByName(part) if n else part
    return got.groupBy("doc_id", "item_id").agg(F.sum("n_matches").alias("n_matches"), F.min("first_char").alias("first_char"))


def clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, removing: int = REMOVING) -> DataFrame:
    """The rows of docs in which no test string of an item of at least `removing` words stands."""
    for m in blocks(benchmark, removing, words):
        shared = docs.sparkSession.sparkContext.broadcast(m)

        def batches(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for whole in it:
                for b in C.slices(whole):
                    keep = np.ones(b.num_rows, bool)
                    keep[[row for row, _, _ in places(b, m)]] = False
                    yield b.filter(pa.array(keep))

        docs = C.mapped(docs, batches, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those in which a passage of the benchmark stands; edge cases as above, null and empty texts stay."""
    return clean(docs, C.read(spark, sf_dir, "benchmark"))


def _reduced_sql(table: str, key: str) -> str:
    return rf"SELECT {key}, trim(regexp_replace(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g')), ' +', ' ', 'g')) AS t FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL"


#: Runs of 13 words of the benchmark, joined to all runs of 13 words of all documents.
SQL = f"""
WITH d AS ({_reduced_sql("documents", "doc_id")}), b AS ({_reduced_sql("benchmark", "item_id")}),
dw AS (SELECT doc_id, string_split(t, ' ') AS w FROM d WHERE t <> ''), bw AS (SELECT item_id, string_split(t, ' ') AS w FROM b WHERE t <> ''),
grams AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM bw)),
lens AS (SELECT DISTINCT len(string_split(g, ' ')) AS n FROM grams),
dg AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g, CASE WHEN i = 1 THEN 0 ELSE len(array_to_string(w[1:i - 1], ' ')) + 1 END AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens))
SELECT doc_id, item_id, count(*) AS n_matches, min(p) AS first_char FROM dg JOIN grams USING (g) GROUP BY doc_id, item_id
"""
