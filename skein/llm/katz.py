"""Language-model scoring by Katz backoff over word n-grams of any order (ORDER unless asked otherwise).

    p(w | h) = d(r) * r / c(h)         if (h, w) was seen r times
             = alpha(h) * p(w | h')    otherwise; h' is h without its first word
    p(w)     = d(r) * r / N            of a word seen r times; what discounting leaves is the mass of all unseen words

Discounts d(r) for r <= K are Good-Turing's as Katz has them, for each order from the counts of counts of the whole corpus; where these
are too few to give a value in (0, 1], d(r) = (r - 0.5) / r. alpha(h) = (1 - sum of p(w | h) seen) / (1 - sum of p(w | h') over the same w),
so every p(. | h) sums to 1 exactly; where discounting leaves h nothing, c(h) + 1 stands for c(h); a context never seen has alpha 1.
Counts come from all documents and every n-gram seen is kept. A document's first words have as much context as there is.

How: documents become splits of about SPLIT words (numbers into the split's own sorted vocabulary, in a file of the
shared folder). For words, then bigrams, and so on to the order, a split sends its distinct n-grams with their counts and what the order
below has of them (count and the context's sum, of which the probability follows) to buckets by context; a bucket adds up, writes its part of the model (a table for each order, partitioned by kind:
contexts with their sums, and n-grams), and answers each split with the counts, the sums of its contexts and, but for the last order, the numbers by which the next order names these n-grams.
So an n-gram crosses the network once, in packed arrays, and no vocabulary is ever whole in one place. There are as many buckets as
BUCKET words each need. A context of more than HEAVY occurrences is spread over
several buckets by its next word, and its sums are put together where they are read. The recursion runs per token, from its word's own
probability up: the n-gram's if seen, else its context's alpha times what the order below gave.

Result of score(): doc_id, n_words, log_prob (natural, sum over words), perplexity (null without words).

Edge cases: null and empty texts have n_words 0, log_prob 0. Repeated rows count as often as they come and are scored each. doc_id
may be null. An empty table gives an empty result. A word that the model never saw has the mass of all unseen words, 1 / (N + 1) if there is none.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import gc
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

K = 5
ORDER = 2
SPLIT = 1_000_000
HEAVY = 200_000
#: Words of the corpus for each bucket.
BUCKET = 2_000_000
SENT = "kind string, split long, bucket int, blob binary, hist array<long>"
MANIFEST = "split long, words long"
SCHEMA = "doc_id long, n_words long, log_prob double, perplexity double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in as few bytes as their values need; hashes as they are."""
    import zstandard as z

    out = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype != C.U:
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        raw = a.tobytes() if a.dtype == C.U else z.compress(a.tobytes(), 3)
        out.append(struct.pack("<4sQ", a.dtype.str[1:].encode().ljust(4), len(raw)) + raw)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard as z

    out, at = [], 0
    while at < len(blob):
        kind, n = struct.unpack_from("<4sQ", blob, at)
        raw = blob[at + 12 : at + 12 + n]
        at += 12 + n
        kind = kind.decode().strip()
        out.append(np.frombuffer(raw if kind == "u8" else z.decompress(raw), "<" + kind))
    return out


def discounts(n: np.ndarray, k: int = K) -> np.ndarray:
    """d(0..k) from the counts of counts n[1..k+1]; d(0) is 0."""
    d = np.zeros(k + 1)
    a = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0.0
        d[r] = x if 0 < x <= 1 else (r - 0.5) / r
    return d


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(r) * r."""
    return count * np.where(count < len(d), d[np.minimum(count, len(d) - 1)], 1.0)


def deltas(x: np.ndarray) -> np.ndarray:
    """Rising numbers as steps, which pack well."""
    return np.diff(x, prepend=0)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash, so sorted keys stand in order of their buckets."""
    return ((h >> C.U(32)) * C.U(buckets) >> C.U(32)).astype(np.int64)


def joined(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate([x.astype(kind) for x in parts]) if parts else np.empty(0, kind)


def row(kind: str, split: int, bucket: int, blob: bytes | None, hist: list[int] | None = None) -> tuple:
    return kind, split, bucket, blob, hist


def sent(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["kind", "split", "bucket", "blob", "hist"])


def ranges(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted bucket numbers."""
    if not len(bucket):
        return
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
        yield int(bucket[a]), a, b


class Store:
    """The splits' files in the shared folder."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.folder = fs.FileSystem.from_uri(path)

    def put(self, split: int, attempt: int, blob: bytes) -> None:
        self.files.create_dir(self.folder, recursive=True)
        draft = f"{self.folder}/.{split}-{attempt}"
        with self.files.open_output_stream(draft) as f:
            f.write(blob)
        self.files.move(draft, f"{self.folder}/{split}")

    def get(self, split: int) -> list[np.ndarray]:
        with self.files.open_input_file(f"{self.folder}/{split}") as f:
            return unpack(f.read())


def write_splits(docs: DataFrame, path: str, size: int, learn: bool, judge: bool) -> DataFrame:
    """Writes the splits; a row for each. learn: they count; judge: they are scored."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx, store = TaskContext.get(), Store(path)
        held, n, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n, number
            split = (0 if learn else 1 << 60) | ctx.partitionId() << 24 | number
            vocab, tokens = np.unique(np.concatenate([h for h, _, _ in held]), return_inverse=True)
            lens = np.concatenate([x for _, x, _ in held])
            ids = pa.concat_arrays([i for _, _, i in held])
            store.put(split, ctx.taskAttemptId(), pack(vocab, tokens, lens, np.asarray(ids.is_null()).astype(np.uint8), ids.fill_null(0).to_numpy().view(C.U), np.array([learn, judge], np.uint8)))
            words = len(tokens)
            held, n, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([split], pa.int64()), pa.array([words], pa.int64())], names=["split", "words"])

        for whole in it:
            for b in C.slices(whole):
                h, at, _, _ = C.words(*C.codepoints(b.column("text")))
                held.append((h, np.diff(at), b.column("doc_id")))
                n += len(h)
                if n >= size:
                    yield flush()
        if held:
            yield flush()

    return C.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batches, MANIFEST)


class Split:
    """A split's distinct n-grams, from words up: where each goes, and what the buckets said of it. Made anew for each order, alike."""

    def __init__(self, store: Store, split: int, buckets: int, heavy: int, model: list):
        self.split, self.buckets, self.heavy, self.model = split, buckets, heavy, model
        self.vocab, tokens, lens, self.null, ids, flags = store.get(split)
        self.learn, self.judge = map(bool, flags)
        self.lens, self.ids, self.tokens = lens.astype(np.int64), ids.view(np.int64), tokens.astype(np.int64)
        self.place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        self.order = 0

    def times(self, n: np.ndarray) -> np.ndarray:
        return n if self.learn else np.zeros_like(n)

    def extend(self) -> None:
        """To the n-grams of the next order."""
        self.order += 1
        if self.order == 1:
            self.gram, self.count = self.tokens, self.times(np.bincount(self.tokens, minlength=len(self.vocab)))
            self.bucket = bucket_of(self.vocab, self.buckets)
            return
        below, v = self.gram, max(len(self.vocab), 1)
        at = np.flatnonzero(self.place >= self.order - 1)
        key, first, inverse, count = np.unique(below[at - 1] * v + self.tokens[at], return_index=True, return_inverse=True, return_counts=True)
        self.gram = np.full(len(below), -1)
        self.gram[at] = inverse
        suffix = below[at[first]]
        self.lower, self.seen_below = self.p[suffix], self.total[suffix]
        context, one, self.context = np.unique(key // v, return_index=True, return_inverse=True)
        divisor = self.divisor[suffix[one]]  # the same for all n-grams of a context
        number, self.word = self.number[context], self.wordnumber[key % v]
        # entries: a context once for each bucket it is spread over
        parts = np.minimum(self.total[context] // self.heavy + 1, self.buckets)
        start = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(context)), parts)
        bucket = (bucket_of(C.mix(number), self.buckets)[owner] + np.arange(len(owner)) - start[owner]) % self.buckets
        entry = start[self.context] + (C.mix(self.word.astype(C.U)) % parts[self.context].astype(C.U)).astype(np.int64)
        order = np.lexsort((number[owner], bucket))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.bucket, self.owner, self.contexts = bucket[order], owner[order], len(context)
        self.named, self.divisors = number[self.owner].astype(np.int64), divisor[self.owner]
        entry = place[entry]
        self.sorted = np.lexsort((self.word, entry))
        self.per = np.bincount(entry, minlength=len(order))
        self.count = self.times(count)

    def asks(self) -> list[tuple]:
        rows = []
        if self.order == 1:
            rows = [row("ask", self.split, b, pack(self.vocab[i:j], self.count[i:j])) for b, i, j in ranges(self.bucket)]
            return rows or [row("ask", self.split, 0, pack(self.vocab, self.count))]
        w, n, r, end = self.word[self.sorted], self.count[self.sorted], self.seen_below[self.sorted], np.cumsum(self.per)
        for b, i, j in ranges(self.bucket):
            x, y = end[i] - self.per[i], end[j - 1]
            rows.append(row("ask", self.split, b, pack(deltas(self.named[i:j]), self.per[i:j], self.divisors[i:j], w[x:y], n[x:y], r[x:y])))
        return rows or [row("ask", self.split, 0, pack(*[np.empty(0, np.int64)] * 6))]

    def hear(self, answers: list[bytes]) -> None:
        """What the buckets answered, in order of buckets: totals and numbers of the n-grams, sums of the contexts."""
        d, n, unseen = self.model[self.order - 1]
        got = [unpack(x) for x in answers]
        total, number = joined([g[0] for g in got]), joined([np.cumsum(g[1].astype(np.int64)) for g in got])
        if self.order == 1:
            self.total, self.number = total, number.astype(C.U)
            self.wordnumber, self.divisor = number, np.full(len(total), max(n, 1))
            self.p = np.where(total > 0, discounted(total, d) / max(n, 1), unseen)
            self.log = np.log(self.p)[self.tokens]
            return
        self.total, self.number = np.empty_like(total), np.empty(len(number), C.U)
        self.total[self.sorted] = total
        if len(number):  # the last order has none
            self.number[self.sorted] = number.astype(C.U)
        sums = [np.bincount(self.owner, joined([g[i] for g in got], float), self.contexts) for i in range(2, 5 + K)]
        c, alpha = backoff(sums[0], sums[1], np.array(sums[2:]), d)
        self.divisor = c[self.context].astype(np.int64)
        self.p = np.where(self.total > 0, discounted(self.total, d) / self.divisor, alpha[self.context] * self.lower)
        at = np.flatnonzero(self.gram >= 0)
        self.log[at] = np.log(self.p)[self.gram[at]]


def count_words(t: pa.Table, buckets: int) -> pa.Table:
    """A bucket of words: the model's part, the counts of counts, and the answers."""
    bucket, splits = t.column("bucket")[0].as_py(), t.column("split").to_pylist()
    asked = [unpack(x) for x in t.column("blob").to_pylist()]
    word, inv = np.unique(joined([a[0] for a in asked], C.U), return_inverse=True)
    total = np.bincount(inv, joined([a[1] for a in asked], float), len(word)).astype(np.int64)
    number = np.arange(len(word)) * buckets + bucket
    rows = [row("model", 0, bucket, pack(word, total), histogram(total))]
    at = np.cumsum([0] + [len(a[0]) for a in asked]).tolist()
    rows += [row("answer", s, bucket, pack(total[inv[i:j]], deltas(number[inv[i:j]]))) for s, i, j in zip(splits, at[:-1], at[1:], strict=True)]
    return pa.Table.from_batches([sent(rows)])


def histogram(total: np.ndarray) -> list[int]:
    """Occurrences, then how many were seen 1 .. K + 1 times."""
    return [int(total.sum()), *np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()]


def count_grams(t: pa.Table, buckets: int, below: np.ndarray, last: bool) -> pa.Table:
    """The same of n-grams, by context. below: the discounts of the order below."""
    bucket, splits = t.column("bucket")[0].as_py(), t.column("split").to_pylist()
    asked = [unpack(x) for x in t.column("blob").to_pylist()]
    context, inv = np.unique(joined([np.cumsum(a[0].astype(np.int64)) for a in asked]), return_inverse=True)
    of, word = np.repeat(inv, joined([a[1] for a in asked])), joined([a[3] for a in asked])
    wide = max(1, int(word.max()).bit_length()) if len(word) else 1
    key, first, pair = np.unique(of << wide | word, return_index=True, return_inverse=True)
    total = np.bincount(pair, joined([a[4] for a in asked], float), len(key)).astype(np.int64)
    divisor = np.repeat(joined([a[2] for a in asked]), joined([a[1] for a in asked]))[first]
    at, seen, lower = of[first], total > 0, discounted(joined([a[5] for a in asked])[first], below) / divisor
    n = len(context)
    sums = [np.bincount(at, total.astype(float), n).astype(np.int64), np.bincount(at[seen], lower[seen], n)]
    sums += [np.bincount(at[total == r], minlength=n) * r for r in range(1, K + 1)]
    sums.append(np.bincount(at[total > K], total[total > K].astype(float), n).astype(np.int64))
    number = np.arange(len(key)) * buckets + bucket
    rows = [row("model", 0, bucket, pack(deltas(context), *sums, deltas(at), word[first], total), histogram(total))]
    e = np.cumsum([0] + [len(a[0]) for a in asked]).tolist()
    p = np.cumsum([0] + [len(a[3]) for a in asked]).tolist()
    for k, s in enumerate(splits):
        i, j = inv[e[k] : e[k + 1]], pair[p[k] : p[k + 1]]
        own = [x[i] for x in sums]
        if asked[k][4].any():  # what a split counts is seen: it needs no alpha
            own[1] = np.zeros(len(i))
        rows.append(row("answer", s, bucket, pack(total[j], number[:0] if last else deltas(number[j]), *own)))
    return pa.Table.from_batches([sent(rows)])


def backoff(c: np.ndarray, lower: np.ndarray, mass: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each context's denominator and alpha. mass: r * (n-grams seen r times) for r = 1..K, then the occurrences of those seen oftener."""
    used = (mass[:-1] * d[1:, None]).sum(0) + mass[-1]
    c = np.where(used >= c * (1 - 1e-12), c + 1, c)
    return c, (1 - used / c) / np.maximum(1 - lower, 1e-300)


def rebuilt(t: pa.Table, store: Store, buckets: int, heavy: int, model: list) -> Split:
    """A split with all that was answered so far; rows: split, bucket, level, blob."""
    t = t.sort_by([("level", "ascending"), ("bucket", "ascending")])
    s = Split(store, t.column("split")[0].as_py(), buckets, heavy, model)
    level, blobs = t.column("level").to_numpy(), t.column("blob")
    for i in range(1, len(model) + 1):
        s.extend()
        s.hear(blobs.take(pa.array(np.flatnonzero(level == i))).to_pylist())
    return s


def asking(path: str, buckets: int, heavy: int, model: list):
    def one(t: pa.Table) -> pa.Table:
        s = rebuilt(t, Store(path), buckets, heavy, model)
        s.extend()
        return pa.Table.from_batches([sent(s.asks())])

    return one


def counting(count):
    def one(t: pa.Table) -> pa.Table:
        return count(t)

    return one


def scores(s: Split) -> pa.Table:
    log = np.concatenate([[0], np.cumsum(s.log)])
    end = np.cumsum(s.lens)
    lp = log[end] - log[end - s.lens]
    with np.errstate(over="ignore"):
        ppl = np.exp(-lp / np.maximum(s.lens, 1))
    out = pa.table({"doc_id": pa.array(s.ids, mask=s.null.astype(bool)), "n_words": s.lens, "log_prob": lp.round(6), "perplexity": pa.array(ppl.round(6), mask=s.lens == 0)})
    return out if s.judge else out.slice(0, 0)


def statistics(counted: DataFrame) -> tuple[np.ndarray, int, float]:
    """Discounts, occurrences, and the mass that discounting leaves."""
    got = {r.i: r.n for r in counted.where("hist is not null").select(F.posexplode("hist").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("n")).collect()}
    n, counts = got.get(0, 0), np.array([0] + [got.get(i, 0) for i in range(1, K + 2)], float)
    d, r = discounts(counts), np.arange(1, K + 1)
    left = (r * counts[1 : K + 1] * (1 - d[1:])).sum() / max(n, 1)
    return d, n, max(left, 1 / (n + 1))


def score(docs: DataFrame, path: str | None = None, order: int = ORDER, train: DataFrame | None = None, split: int = SPLIT, heavy: int = HEAVY) -> DataFrame:
    """Scores every row of docs by a model of `train`, or of docs themselves. The model's tables are path/order=n, kind=model."""
    spark = docs.sparkSession
    path = path or C.new_path(spark, "katz")
    at = f"{path}/splits"
    made = write_splits(docs, at, split, train is None, True)
    if train is not None:
        made = made.unionByName(write_splits(train, at, split, True, False))
    made.write.parquet(f"{path}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    words = manifest.agg(F.sum("words")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // BUCKET))
    model: list[tuple[np.ndarray, int, float]] = []
    answers: DataFrame | None = None

    def each(f, schema: str) -> DataFrame:
        """f of every split; answers are small beside the splits they belong to: as many tasks as buckets, whatever their size."""
        return answers.repartition(buckets, "split").groupBy("split").applyInArrow(f, schema)

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(at)
        for b in it:
            for number in b.column("split").to_pylist():
                s = Split(store, number, buckets, heavy, [])
                s.extend()
                yield sent(s.asks())

    for n in range(1, order + 1):
        if n == 1:
            asked, count = manifest.select("split").repartition(buckets, "split").mapInArrow(first, SENT), partial(count_words, buckets=buckets)
        else:

            asked, count = each(asking(at, buckets, heavy, list(model)), SENT), partial(count_grams, buckets=buckets, below=model[-1][0], last=n == order)
        asked.groupBy("bucket").applyInArrow(counting(count), SENT).write.partitionBy("kind").parquet(f"{path}/order={n}")
        counted = spark.read.schema(SENT).parquet(f"{path}/order={n}")
        model.append(statistics(counted))
        level = counted.where("kind = 'answer'").select("split", "bucket", F.lit(n).alias("level"), "blob")
        answers = level if answers is None else answers.unionByName(level)
        del asked
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # an order's shuffle files are of no more use
    done = list(model)
    return each(lambda t: scores(rebuilt(t, Store(at), buckets, heavy, done)), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.read(spark, sf_dir, "documents"))
