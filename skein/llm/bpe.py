"""Byte-level BPE by segment tree, and back.

A pretoken's bytes are the leaves of a segment tree; leaf i holds the rank of the pair that starts at i with its live
right neighbour, or infinity. The root is the least rank, leftmost among equals. A merge sets three leaves (the pair,
its right half, its left neighbour) and mends their paths: O(log n) for each. Pretokens of up to 64 bytes go through
the tree together, one numpy row each; longer ones one by one, in the same tree on lists.

A worker keeps the ids of pretokens it has met in an open-addressing numpy table under a 64-bit hash of the pretoken,
emptied when it holds CACHE entries. Decoding checks every batch, so two pretokens under one hash would be seen; such a
batch is encoded again without the table.

Edge cases: null text gives null ids, n_tokens 0; empty text gives no ids. Repeated rows are encoded as often as they
come. Columns other than doc_id and text are not read. doc_id may be null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 1_000_000
INF = np.int64(1) << 62
SCHEMA = "doc_id long, n_tokens int, token_ids array<int>, round_trip boolean"


@cache
def classes() -> np.ndarray:
    """Code point -> 1 letter, 2 digit, 3 white space, 0 other, as the public pre-tokenisation pattern has them."""
    import unicodedata

    t = np.zeros(0x110000, np.uint8)
    for i in range(0x32400):
        k = unicodedata.category(chr(i))[0]
        t[i] = 1 if k == "L" else 2 if k == "N" else 0
    for i in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        t[i] = 3
    return t


def boundaries(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a pretoken starts. Documents never share one."""
    n = len(cp)
    k = classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    nxt_edge = edge[1:]
    start = edge[:-1].copy()
    start[1:] |= k[1:] != k[:-1]
    space = k == 3
    # the last white-space character before a word stands apart from the run; a plain space joins the word
    last = space.copy()
    last[:-1] &= ~space[1:] & ~nxt_edge[:-1]
    last[-1:] = False
    start |= last
    joins = last & (cp == 0x20)
    at = np.flatnonzero(joins) + 1
    start[at] = False
    # contractions: an apostrophe that starts a pretoken takes the letters after it
    q = np.flatnonzero((cp == 0x27) & start)
    q = q[(q + 1 < n)]
    q = q[~edge[q + 1]]
    if len(q):
        a = cp[q + 1]
        b = np.where((q + 2 < n) & ~edge[np.minimum(q + 2, n)], cp[np.minimum(q + 2, n - 1)], 0)
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32)) & ~two
        for hit, size in ((one, 1), (two, 2)):
            p = q[hit]
            start[p + 1] = False
            after = p + 1 + size
            after = after[after < n]
            start[after] = True
    return start


class Known:
    """Pretoken hash -> ids, probed by whole arrays."""

    BITS = 22

    def __init__(self) -> None:
        self.keys = np.zeros((1 << self.BITS) + 256, C.U)
        self.at, self.len = np.zeros(len(self.keys), np.int32), np.zeros(len(self.keys), np.int32)
        self.pool, self.used, self.entries = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it isn't known."""
        slot = (h >> C.U(64 - self.BITS)).astype(np.int64)
        got = self.keys[slot]
        todo = np.flatnonzero(got != h)
        while len(todo):
            k = got[todo]
            slot[todo[k == 0]] = -1
            todo = todo[(k != 0) & (k != h[todo])]
            slot[todo] += 1
            got[todo] = self.keys[slot[todo]]
        return slot

    def add(self, h: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """h: distinct and not known. ids: those of all entries one after another."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.entries += len(h)
        slot, left = (h >> C.U(64 - self.BITS)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = np.flatnonzero(self.keys[slot[left]] == 0)
            s, first = np.unique(slot[left[free]], return_index=True)
            won = left[free[first]]
            self.keys[s], self.at[s], self.len[s] = h[won], at[won], lens[won]
            lost = np.ones(len(left), bool)
            lost[free[first]] = False
            left = left[lost]
            slot[left] += 1


def spread(pool: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """pool[at : at + lens] of every pair, one after another."""
    first = np.cumsum(lens) - lens
    return pool[np.repeat(at - first, lens) + np.arange(int(lens.sum()))]


class Codec:
    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.bytes = [b""] * size
        for t, i in self.ranks.items():
            self.bytes[i] = t
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for t, i in self.ranks.items():
            for j in range(1, len(t)):
                a, b = self.ranks.get(t[:j]), self.ranks.get(t[j:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.pairs = pairs
        self._index(pairs)
        lens = np.array([len(t) for t in self.bytes], np.int64)
        self.token_len, self.token_at, self.vocab = lens, np.cumsum(lens) - lens, np.frombuffer(b"".join(self.bytes), np.uint8)
        self.known = Known()

    def _index(self, pairs: dict[int, int]) -> None:
        """An open-addressing table that numpy probes."""
        self.bits = max(16, int(len(pairs) * 4).bit_length())
        self.slots, self.values = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, -1, np.int64)
        self.probes = 1
        keys = np.fromiter(pairs, np.int64, len(pairs))
        vals = np.fromiter(pairs.values(), np.int64, len(pairs))
        slot, left, step = self._slot(keys), np.arange(len(keys)), 0
        while len(left):  # a round places one key in each free slot it meets
            at = slot[left] + step
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.slots[at[first]], self.values[at[first]] = keys[left[first]], vals[left[first]]
            left = np.delete(left, first)
            step += 1
            self.probes = step
        assert self.probes < 64

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1."""
        key = a << 20 | b
        slot = self._slot(key)
        got = self.slots[slot]
        out = np.where(got == key, self.values[slot], -1)
        todo = np.flatnonzero((got != key) & (got >= 0))
        for step in range(1, self.probes):
            if not len(todo):
                break
            got = self.slots[slot[todo] + step]
            hit = got == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]] + step]
            todo = todo[~hit & (got >= 0)]
        return out

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of up to 64 bytes one after another, and how many each has; all in one array of trees."""
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        size = 1 << max(0, int(lens.max() - 1).bit_length())
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(lens) - lens
        col = np.arange(len(raw)) - np.repeat(first, lens)
        width = size + 2
        ids = np.full((n, width), -1, np.int64)
        ids[np.repeat(np.arange(n), lens), col] = self.byte_id[raw]
        ids = ids.reshape(-1)
        nxt = np.tile(np.minimum(np.arange(1, width + 1), width - 1), n)
        prv = np.tile(np.arange(-1, width - 1), n)
        pos = np.arange(size)
        a, b = ids.reshape(n, width)[:, :size], ids.reshape(n, width)[:, 1 : size + 1]
        r = np.where((a >= 0) & (b >= 0), self.rank(np.maximum(a, 0).ravel(), np.maximum(b, 0).ravel()).reshape(n, size), -1)
        tree = np.full((n, 2 * size), INF)
        tree[:, size:] = np.where(r >= 0, r << 8 | pos, INF)
        at = size
        while at > 1:
            tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
            at //= 2
        tree = tree.reshape(-1)
        row = np.arange(n)

        def put(t: np.ndarray, leaf: np.ndarray, v: np.ndarray) -> None:
            node = leaf + size
            tree[t + node] = v
            while size > 1 and node[0] > 1:
                node >>= 1
                tree[t + node] = np.minimum(tree[t + 2 * node], tree[t + 2 * node + 1])

        while len(row):
            top = tree[row * 2 * size + 1]
            live = top < INF
            row, top = row[live], top[live]
            if not len(row):
                break
            t, w, i = row * 2 * size, row * width, top & 255
            j = nxt[w + i]
            after = nxt[w + j]
            ids[w + i], ids[w + j] = top >> 8, -1
            nxt[w + i], prv[w + after] = after, i
            put(t, j, np.full(len(row), INF))
            there = ids[w + after]
            r = np.where(there >= 0, self.rank(ids[w + i], np.maximum(there, 0)), -1)
            put(t, i, np.where(r >= 0, r << 8 | i, INF))
            before = prv[w + i]
            k = np.flatnonzero(before >= 0)
            if len(k):
                p = before[k]
                r = self.rank(ids[w[k] + p], ids[w[k] + i[k]])
                put(t[k], p, np.where(r >= 0, r << 8 | p, INF))
        grid = ids.reshape(n, width)
        keep = grid >= 0
        return grid[keep].astype(np.uint32), keep.sum(1)

    def merge_one(self, word: bytes) -> np.ndarray:
        """Ids of one word of any length, on lists."""
        n = len(word)
        size = 1 << max(0, (n - 1).bit_length())
        ids, pairs = [int(x) for x in self.byte_id[np.frombuffer(word, np.uint8)]], self.pairs
        nxt, prv, none = [*range(1, n + 1)], [*range(-1, n - 1)], 1 << 62
        leaf = lambda i, j: none if (r := pairs.get(ids[i] << 20 | ids[j])) is None else r << 32 | i
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = leaf(i, i + 1)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, v: int) -> None:
            i += size
            tree[i] = v
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                v = a if a < b else b
                if tree[i] == v:
                    return
                tree[i] = v

        while (top := tree[1]) < none:
            i = top & 0xFFFFFFFF
            j = nxt[i]
            after = nxt[j]
            ids[i], ids[j] = top >> 32, -1
            nxt[i] = after
            put(j, none)
            if after < n:
                prv[after] = i
                put(i, leaf(i, after))
            else:
                put(i, none)
            if prv[i] >= 0:
                put(prv[i], leaf(prv[i], i))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has: of a word in the vocabulary its own id, else what merging leaves."""
        n = len(words)
        whole = list(map(self.ranks.get, words))
        size = np.fromiter(map(len, words), np.int64, n)
        depth = np.where(size > 64, 99, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        own = np.fromiter((-1 if x is None else x for x in whole), np.int64, n)
        depth[own >= 0] = -1
        parts, who, lens = [own[own >= 0].astype(np.uint32)], [np.flatnonzero(own >= 0)], [np.ones(int((own >= 0).sum()), np.int64)]
        for d in np.unique(depth[depth >= 0]).tolist():
            group = np.flatnonzero(depth == d)
            if d == 99:
                got = [self.merge_one(words[i]) for i in group]
                parts += got
                lens.append(np.array([len(x) for x in got], np.int64))
                who.append(group)
                continue
            step = max(256, 400_000 >> d)
            for at in range(0, len(group), step):
                ids, k = self.merge_many([words[i] for i in group[at : at + step]])
                parts.append(ids)
                lens.append(k)
                who.append(group[at : at + step])
        pool, order, count = np.concatenate(parts), np.concatenate(who), np.concatenate(lens)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return spread(pool, (np.cumsum(count) - count)[back], count[back]), count[back]

    def encode(self, cp: np.ndarray, offsets: np.ndarray, known: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and each one's offsets."""
        if not len(cp):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        start = np.flatnonzero(boundaries(cp, offsets))
        end = np.append(start[1:], len(cp))
        s = None
        if known:
            h = C.hash_runs(cp, slice(None), start, end)
            h[h == 0] = 1
            if self.known.entries > CACHE:
                self.known = Known()
            slot = self.known.find(h)
            miss = np.flatnonzero(slot < 0)
            if len(miss):
                new, first = np.unique(h[miss], return_index=True)
                first = miss[first]
                s = cp.tobytes().decode("utf-32-le")
                ids, lens = self.merge([s[a:b].encode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
                self.known.add(new, ids, lens)
                slot[miss] = self.known.find(h[miss])
            lens = self.known.len[slot].astype(np.int64)
            ids = spread(self.known.pool, self.known.at[slot].astype(np.int64), lens)
        else:
            s = cp.tobytes().decode("utf-32-le")
            ids, lens = self.merge([s[a:b].encode() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        return ids, np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return spread(self.vocab, self.token_at[ids], self.token_len[ids]).tobytes()


@cache
def codec(path: str = VOCABULARY) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, token_ids, and whether decoding the ids gave the text's bytes back."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in it:
            for b in C.slices(whole):
                text = b.column("text")
                cp, offsets = C.codepoints(text)
                ids, at = c.encode(cp, offsets)
                raw = cp.tobytes().decode("utf-32-le").encode()
                if c.decode(ids) != raw:
                    ids, at = c.encode(cp, offsets, known=False)
                ok = np.full(len(text), c.decode(ids) == raw)
                null = np.asarray(text.is_null())
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)), mask=pa.array(null) if null.any() else None)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at), pa.int32()), lists, pa.array(ok, mask=null)], names=["doc_id", "n_tokens", "token_ids", "round_trip"])

    return C.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batches, SCHEMA)


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of tables with doc_id and token_ids; null ids give null text. Ids out of range raise."""

    @F.pandas_udf("string")
    def text(ids):
        c = codec(path)
        return ids.map(lambda x: None if x is None else c.decode(np.asarray(x, np.int64)).decode(errors="replace"))

    as_text: Column = text("token_ids")
    return tokens.select("doc_id", as_text.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(C.read(spark, sf_dir, "documents"))
