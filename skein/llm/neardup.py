"""MinHash near-dedup with DartMinHash signatures.

A document is the weighted set of its runs of SHINGLE lower-cased words, weight = how often a run occurs. Darts fall on
the plane of (weight, rank) of every element as a Poisson process of rate 1 that the element's hash alone decides: the
weight axis is cut into regions [2^v - 1, 2^(v+1) - 1) and the rank axis into cells, each region throws its darts in order of rank, and a dart counts where
its weight coordinate is below the element's weight. Each dart hashes to one of K coordinates; a coordinate keeps its
earliest dart. Darts are thrown up to rank (ln K + 2) * K / total weight, so a document costs about K ln K darts however long it is; while a
coordinate is empty the bound doubles. Two documents agree in a coordinate with probability sum(min) / sum(max) of
their weights, the weighted Jaccard similarity.

BANDS bands of ROWS coordinates are joined. At similarity 0.5 a pair meets in a band with probability 0.955, at 0.6 0.999.
A pair that met counts as near if the similarity of its documents' own runs, with their counts, is at least THRESHOLD;
signatures only choose what is looked at. In a bucket the document with the least number is hub and the others are held against it, so copies by the thousand
cost one comparison each. Where some aren't near it (documents with a passage in common, say) those are held against all others of the
bucket, near the hub or not, but for pairs that near ones connect already; a pair is looked at if its signatures agree in
all but ERRORS standard errors of THRESHOLD. No bucket is capped, and how buckets are cut into parts doesn't change what is connected.
Groups are the connected components.

Result of groups(): doc_id, group_id (least doc_id of the group), kept, similarity of the document's runs and those of the group's kept
document (1 for copies of it and for itself; a member that others connect may be under THRESHOLD); only groups of two or more documents.

Edge cases: documents with the same words in the same order are exact copies and are joined by a digest of these. Null
texts are near nothing and are kept. Texts without words are copies of each other only if the texts are equal. A text of
fewer than SHINGLE words is one element. Repeated rows count as copies of each other; deduplicated() keeps one row of each group, the one
with the least doc_id (nulls last), then the least digest of the text, then any of the equal rows. Columns other than doc_id and text are only carried along,
whatever their names. Runs are compared as 32-bit keys: of two documents of n runs about n / 2^32 of the similarity may be chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE, ROWS, BANDS = 2, 4, 48
K = ROWS * BANDS
THRESHOLD = 0.5
#: Standard errors (at most 0.036) that a signature may fall short of the threshold before the runs themselves are compared.
ERRORS = 6
#: Darts of a region on average; only how the work is laid out.
CELL = 4
#: Members of a bucket that one task holds against each other; larger buckets are cut into parts and every two parts compared.
PART = 2_000
#: Bytes of runs that a part has on average at most.
PART_BYTES = 32 << 20
#: Members held against one hub in a row; a hub of more is sent to several tasks.
LOT = 100_000
#: Cells of the bitmap of documents that a join is about; CELLS / 64 rows at most are broadcast, whatever the data.
CELLS = 1 << 26
#: Bits of an element's hash that tell it from others.
ELEMENT = 44
BIG = np.uint64(0xFFFFFFFFFFFFFFFF)
SCHEMA = "doc_id long, digest binary, tie binary, sig binary"


def uniform(h: np.ndarray) -> np.ndarray:
    """(0, 1] of 64 bits."""
    return ((h >> C.U(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """n x k 64-bit coordinates of the weighted sets that rows (document, element, weight) describe; documents without rows get zeros.

    A coordinate is the high bits of its dart's rank-ordered hash: equal in two documents exactly if the same dart won."""
    out = np.zeros((n, k), C.U)
    total = np.bincount(doc, weight, n)
    todo = np.flatnonzero(total > 0)
    bound = np.zeros(n)
    bound[todo] = (math.log(k) + 2) * k / total[todo]
    while len(todo):
        mark = np.zeros(n, bool)
        mark[todo] = True
        use = mark[doc]
        best = throw(doc[use], element[use], weight[use], bound, n, k, todo)
        full = (best[:, :, 1] != BIG).all(1)
        out[todo[full]] = best[full][:, :, 0]
        todo = todo[~full]
        bound[todo] *= 2
    return out


def throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, bound: np.ndarray, n: int, k: int, todo: np.ndarray) -> np.ndarray:
    """For each document of todo and coordinate: (dart, rank as ordered bits) of the earliest dart up to the bound."""
    row = np.zeros(n, np.int64)
    row[todo] = np.arange(len(todo))
    places, ranks, darts = [], [], []
    v = 0
    d, e, w = row[doc], element, weight
    limit = bound[todo]
    while len(d):
        low, width = 2.0**v - 1, 2.0**v
        key = C.mix(e + C.U((v + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        # the rank axis in cells of about CELL darts, each thrown for itself
        cells = np.ceil(limit[d] * width / CELL).astype(np.int64)
        cells = np.maximum(cells, 1)
        who = np.repeat(np.arange(len(d)), cells)
        cell = np.arange(len(who)) - (np.cumsum(cells) - cells)[who]
        at, dd, ww, rank = C.mix(key[who] + cell.astype(C.U) * C.BASE), d[who], w[who], cell * (CELL / width)
        end = np.minimum(limit[dd], rank + CELL / width)
        while len(dd):
            at = C.mix(at + C.U(0x9E3779B97F4A7C15))
            rank = rank - np.log(uniform(at)) / width
            live = np.flatnonzero(rank < end)
            at, dd, ww, rank, end = at[live], dd[live], ww[live], rank[live], end[live]
            if not len(dd):
                break
            x = C.mix(at ^ C.U(0xA0761D6478BD642F))
            if width == 1 and (ww >= 1).all():
                hit = slice(None)
            else:
                hit = low + width * uniform(x) <= ww
            y = x[hit] if width == 1 and isinstance(hit, slice) else C.mix(x[hit])
            coord = ((y & C.U(0xFFFFFFFF)) * C.U(k)) >> C.U(32)
            places.append(dd[hit] * k + coord.astype(np.int64))
            ranks.append(rank[hit])
            darts.append(y)
        more = w > 2 * width - 1
        d, e, w = d[more], e[more], w[more]
        v += 1
    best = np.full((len(todo) * k, 2), BIG, C.U)
    if places:
        p, r, y = np.concatenate(places), np.concatenate(ranks), np.concatenate(darts)
        # the rank's bits order as the rank does; ties go to the lower dart
        bits = r.view(C.U)
        least = np.full(len(todo) * k, BIG, C.U)
        np.minimum.at(least, p, bits)
        won = np.flatnonzero(bits == least[p])
        np.minimum.at(best[:, 0], p[won], y[won])
        best[:, 1] = least
    return best.reshape(len(todo), k, 2)


def weighted(cp: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, element and weight of each distinct run of words; then all word hashes and each document's offsets into them."""
    h, at, _, _ = C.words(cp, offsets)
    g, doc, _ = C.shingles(h, at, n)
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < n))
    if len(short):
        whole = np.zeros(len(short), C.U)
        for j in range(n - 1):
            there = at[short] + j < at[short + 1]
            whole[there] = C.mix(whole[there] * C.BASE + h[at[short][there] + j])
        g, doc = np.concatenate([g, whole]), np.concatenate([doc, short])
    bits = max(1, len(at).bit_length())
    key = doc.astype(C.U) << C.U(64 - bits) | g >> C.U(bits)  # a batch holds under 2^20 documents
    key.sort()
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    # the same bits for every batch
    return (key[start] >> C.U(64 - bits)).astype(np.int64), (key[start] << C.U(bits)) >> C.U(64 - ELEMENT), np.diff(np.append(start, len(key))).astype(np.float64), h, at


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the words, digest of the text (tie) and signature (16 bits a coordinate, empty without words) of every row with text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in it:
            for b in C.slices(whole):
                b = b.filter(pa.compute.is_valid(b.column("text")))
                text = b.column("text")
                n = b.num_rows
                if not n:
                    continue
                doc, element, weight, h, at = weighted(*C.codepoints(text))
                sig = (signatures(doc, element, weight, n) >> C.U(48)).astype("<u2")
                tie = b.column("tie").to_pylist()
                digest = [xxhash.xxh3_128_digest(h[i:j].tobytes()) if i < j else b"=" + t for i, j, t in zip(at[:-1].tolist(), at[1:].tolist(), tie, strict=True)]
                raw = [x.tobytes() if some else b"" for x, some in zip(sig, (np.diff(at) > 0).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digest, pa.binary()), b.column("tie"), pa.array(raw, pa.binary())], names=["doc_id", "digest", "tie", "sig"])

    text = F.col("text").cast("string")
    return C.mapped(docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.md5(text)).alias("tie")), batches, SCHEMA)


def name() -> Column:
    """Ids that sort as doc_id does, nulls last; the text's digest breaks ties."""
    return F.concat(F.when(F.col("doc_id").isNull(), "z").otherwise(F.concat(F.when(F.col("doc_id") < 0, "a").otherwise("b"), F.lpad(F.hex(F.col("doc_id")), 16, "0"))), F.hex("tie"))


def split_by(rows: DataFrame, doc_id: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose doc_id may be one of those in ids (column doc_id), and rows whose isn't: by a bitmap of hashed ids, so the latter need no shuffle."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS))
    bitmap = ids.select(cell("doc_id").alias("cell")).groupBy(F.expr("cell div 64").alias("map_word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("map_bits"))
    met = rows.withColumn("map_cell", cell(doc_id)).withColumn("map_word", F.expr("map_cell div 64")).join(F.broadcast(bitmap), "map_word", "left")  # at most CELLS / 64 rows
    there = F.expr("coalesce(shiftrightunsigned(map_bits, cast(map_cell % 64 as int)) & 1L, 0L) = 1L")
    return met.where(there).select(*rows.columns), met.where(~there).select(*rows.columns)


def runs_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """n and runs of the documents that ids (id, doc_id, n) names: a sorted 32-bit key for each run of words and time it occurs, so sets of keys compare as weighted sets of runs."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in C.slices(whole):
                doc, element, weight, _, _ = weighted(*C.codepoints(b.column("text")))
                times = weight.astype(np.int64)
                nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                of, key = np.repeat(doc, times), C.mix(np.repeat(element, times) * C.BASE + nth.astype(C.U)) >> C.U(32)
                key = np.sort(of.astype(C.U) << C.U(32) | key).astype(np.uint32)
                at = np.searchsorted(of, np.arange(b.num_rows + 1)).tolist()
                yield pa.RecordBatch.from_arrays([b.column("n"), pa.array([key[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["n", "runs"])

    text = F.col("text").cast("string")
    some, _ = split_by(docs.select(F.col("doc_id").cast("long"), text.alias("text")).where("text is not null"), "doc_id", ids)
    named = some.withColumn("tie", F.unhex(F.md5("text"))).select(name().alias("id"), "text")
    one = named.join(ids.select("id", "n"), "id").groupBy("id").agg(F.first("n").alias("n"), F.first("text").alias("text"))
    return C.mapped(one.select("n", "text"), batches, "n long, runs binary")


def similarities(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of a set of keys and each of the others; none is empty."""
    if not others:
        return np.zeros(0)
    lens = np.array([len(x) for x in others])
    key = np.concatenate(others)
    met = one[np.minimum(np.searchsorted(one, key), len(one) - 1)] == key
    both = np.add.reduceat(met.astype(np.int64), np.cumsum(lens) - lens)
    return both / (len(one) + lens - both)


def pairs_table(out: list[tuple[int, int, float]]) -> dict[str, pa.Array]:
    a, b, x = zip(*out, strict=True) if out else ((), (), ())
    return {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(x, pa.float64())}


def hubs_near(threshold: float):
    """Near pairs of rows (a, b, runs) that follow a row of their hub a, whose b is null."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.empty(0, np.uint32)
        for t in it:
            a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
            keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("runs")]
            out = []
            cut = [0, *(i for i in range(1, len(a)) if b[i] is None), len(a)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if i < j and b[i] is None:
                    hub, i = np.array(keys[i]), i + 1
                out += [(a[k], b[k], x) for k, x in zip(range(i, j), similarities(hub, keys[i:j]).tolist(), strict=True) if x >= threshold]
            yield pa.RecordBatch.from_pydict(pairs_table(out))

    return batches


def members_near(threshold: float):
    """Near pairs among the members of a bucket's part, or between two parts: each held against all others that it isn't connected to yet.

    Members with `near` are connected by the bucket's hub."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("n")
        part, ids = t.column("part").to_numpy(), t.column("n").to_pylist()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        keys = [np.frombuffer(x, np.uint32) for x in t.column("runs").to_pylist()]
        k = sig.shape[1]
        least = np.ceil((threshold - ERRORS * math.sqrt(threshold * (1 - threshold) / k)) * k - 1e-9)
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        group = np.where(t.column("near").to_numpy(), -1, np.arange(len(ids)))
        others = np.flatnonzero(part == high)
        out = []
        for i in np.flatnonzero(part == low):
            among = others[group[others] != group[i]]
            if low == high:
                among = among[among > i]
            among = among[(sig[among] == sig[i]).sum(1) >= least]
            like = similarities(keys[i], [keys[j] for j in among.tolist()])
            among, like = among[like >= threshold], like[like >= threshold]
            out += [(*sorted((ids[i], ids[j])), x) for j, x in zip(among.tolist(), like.tolist(), strict=True)]
            if len(among):
                group[np.isin(group, group[among])] = group[i]
        return pa.table(pairs_table(out))

    return one


def held(pairs: DataFrame, runs: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of those of the distinct pairs (a, b) whose runs are similar by the threshold. Those of one a are cut into lots."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(LOT)).alias("lots"))
    member = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("lots")).alias("lot"), "b").join(runs.withColumnRenamed("n", "b"), "b")
    hub = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.lit(None).cast("long").alias("b")).join(runs.withColumnRenamed("n", "a"), "a")
    rows = hub.unionByName(member).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first())
    return C.mapped(rows.select("a", "b", "runs"), hubs_near(threshold), "a long, b long, similarity double")


def near_pairs(ones: DataFrame, runs, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """(a, b, similarity) with a < b, enough to connect what is near; ones: n, sig. runs: gives the runs of a table of numbers n."""
    key = lambda j: F.xxhash64(F.substring(F.col("sig"), j * (2 * ROWS) + 1, F.lit(2 * ROWS)), j)
    bands = ones.where("octet_length(sig) > 0").select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)).alias("band"))
    hubs = bands.groupBy("band").agg(F.min("n").alias("hub"), F.count("*").alias("members")).where("members > 1").select("band", "hub")
    star = C.written(bands.join(hubs, "band").where("n <> hub").select("band", F.col("hub").alias("a"), F.col("n").alias("b")), "buckets")
    distinct = C.written(star.select("a", "b").distinct(), "stars")
    compared = runs(distinct.select(F.col("a").alias("n")).union(distinct.select(F.col("b").alias("n"))).distinct())
    good = C.written(held(distinct, compared, threshold), "near")
    # where some aren't near their bucket's hub, its members are held against each other, in parts of bounded size if it is much
    far = distinct.join(good, ["a", "b"], "left_anti")
    known = star.join(far.select("a", "b", F.lit(False).alias("near")), ["a", "b"], "left").select("band", "a", F.col("b").alias("n"), F.coalesce("near", F.lit(True)).alias("near"))
    all_of = known.groupBy("band", "a").agg(F.count("*").alias("members"), F.min("near").alias("all"), F.bit_xor(F.xxhash64("n")).alias("x"), F.bit_xor(F.xxhash64("n", F.lit(1))).alias("y"))
    mixed = all_of.where("members > 1 and not all").groupBy("a", "members", "x", "y").agg(F.min("band").alias("band"))  # many bands hold the same documents
    rest = C.written(known.join(mixed.select("band"), "band", "left_semi").select("band", "n", "near"), "mixed")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(part)), F.ceil(F.sum("bytes") / F.lit(PART_BYTES))).cast("int")
    size = rest.join(compared.select("n", F.octet_length("runs").alias("bytes")), "n").groupBy("band").agg(parts.alias("parts"))
    own = F.pmod(F.xxhash64("n"), F.col("parts")).cast("int")
    spread = rest.join(size, "band").withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = spread.select("band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "n", "near")
    more = placed.join(ones.select("n", "sig"), "n").join(compared, "n").groupBy("band", "low", "high").applyInArrow(members_near(threshold), "a long, b long, similarity double")
    return good.unionByName(more)


def components(pairs: DataFrame) -> DataFrame:
    """(n, root): the least number of each connected component, by joining labels with neighbours' and with labels' labels until none falls."""
    spark = pairs.sparkSession
    edge = C.written(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "edges")
    label = C.written(edge.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = edge.join(label.withColumnRenamed("n", "b"), "b").groupBy("a").agg(F.min("root").alias("m")).withColumnRenamed("a", "n")
        low = label.join(near, "n", "left").select("n", "root", F.least("root", F.coalesce("m", "root")).alias("to"))
        jump = label.select(F.col("n").alias("to"), F.col("root").alias("beyond"))
        new = C.written(low.join(jump, "to", "left").select("n", F.col("root").alias("old"), F.least("to", F.coalesce("beyond", "to")).alias("root")), "labels")
        C.drop(spark, label.skein_path)
        label = new
        if new.where("root <> old").isEmpty():
            return new.select("n", "root")


def grouped(docs: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row with text (doc_id, id, digest, row); the documents (digest, n) of groups of two or more rows with their group's hub, the number of the document it keeps,
    and the kept row's first (id, row), and group_id; and the runs of documents that met."""
    made: list[DataFrame] = []
    s = C.written(sketch(docs).select("doc_id", name().alias("id"), "digest", "sig", F.monotonically_increasing_id().alias("row")), "sketches")
    # one document for the rows of equal words, numbered; the table fixes the numbers
    ones = C.written(s.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).withColumn("n", F.monotonically_increasing_id()), "ones")

    def runs(numbers: DataFrame) -> DataFrame:
        made.append(C.written(runs_of(docs, C.written(ones.select(F.col("first.id").alias("id"), "doc_id", "n").join(numbers, "n", "left_semi"), "met")), "runs"))
        return made[0]

    roots = components(near_pairs(ones.select("n", "sig"), runs, part=part))
    member = ones.join(roots, "n", "left").where("copies > 1 or root is not null").select("digest", "n", "first", "doc_id", F.coalesce("root", "n").alias("root"))
    hubs = member.groupBy("root").agg(F.min(F.struct("first", "n")).alias("hub"), F.min("doc_id").alias("group_id"))
    return s, C.written(member.select("digest", "n", "root").join(hubs, "root").select("digest", "n", F.col("hub.n").alias("hub"), "hub.first", "group_id"), "members"), made[0]


def groups(docs: DataFrame, part: int = PART) -> DataFrame:
    s, member, runs = grouped(docs, part)
    like = held(member.where("n <> hub").select(F.col("hub").alias("a"), F.col("n").alias("b")), runs, 0.0).select(F.col("b").alias("n"), "similarity")
    each = member.join(like, "n", "left").withColumn("similarity", F.round(F.coalesce("similarity", F.lit(1.0)), 4))
    kept = (F.col("id") == F.col("first.id")) & (F.col("row") == F.col("first.row"))
    return s.select("doc_id", "id", "row", "digest").join(each, "digest").select("doc_id", "group_id", kept.alias("kept"), "similarity")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, of each group one."""
    s, member, _ = grouped(docs)
    first = F.col("id") == F.col("first.id")
    listed = C.written(s.select("doc_id", "id", "digest").join(member.select("digest", "first"), "digest").groupBy("doc_id", "id").agg(F.max(first).alias("kept"), F.count("*").alias("times")).where("not kept or times > 1").select(F.col("doc_id").alias("of_doc"), F.substring("id", -32, 32).alias("of_tie"), "kept"), "listed")
    names, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner)  # no column of docs can clash with those joined to it
    id_, text = (F.col(inner[[x.lower() for x in names].index(c)]) for c in ("doc_id", "text"))
    maybe, clear = split_by(rows.withColumn("own_doc", id_.cast("long")), "own_doc", listed.select(F.col("of_doc").alias("doc_id")))
    keyed = maybe.withColumn("own_tie", F.upper(F.md5(text.cast("string"))))
    same = F.col("own_doc").eqNullSafe(F.col("of_doc")) & (F.col("own_tie") == F.col("of_tie"))
    out = clear.unionByName(keyed.join(listed, same, "left_anti").select(*clear.columns)).select(*inner)
    repeated = listed.where("kept")
    if not repeated.isEmpty():  # equal rows of which one stays
        one = keyed.join(repeated, same).groupBy("own_doc", "own_tie").agg(F.first(F.struct(*inner)).alias("r"))
        out = out.unionByName(one.select("r.*"))
    return out.toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(C.read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group; edge cases as above."""
    return deduplicated(docs)
