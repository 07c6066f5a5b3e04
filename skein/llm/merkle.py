"""WARC Merkle fixity audit.

Pages become WARC response records. FILE page ids in a row make a file; in it records stand in order of page_id (equal ids in order of
their SHA-256), one behind the other, so each has an offset range. A leaf is the SHA-256 of a page id's records: digest, offset
and length of each. FANOUT nodes in a row hash to a node of the next level, over the files too, up to one root. The
trees of two replicas are written level by level, to one height, as ids of one may span more than the other's; the audit compares roots and then, level by level, only the children
of nodes that differ, down to the leaves, and reports the records of the leaves that differ.

Result of audit(): page_id, nth (among records of one page id, from 1), problem (changed, missing, extra, moved), and offset, length and
digest in the primary and in the replica (null where it has none). "moved": same bytes at another offset, as after a missing record.

Edge cases: null url or html count as empty. Rows whose page_id is null are records of the last position of all, under page id null.
Equal rows are records of their own. Two empty tables are equal; an empty one against another reports every record. Columns
other than page_id, url, html are not read. Page ids may be negative and far apart: only nodes that have records exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

FILE = 1024
FANOUT = 16
#: 16^17 leaves span all 64-bit page ids.
LEVELS = 17
#: Bytes of the written list of differing nodes up to which Spark may send it to every task; a longer one is joined by a shuffle.
BROADCAST = 1 << 20


def record(url: Column, html: Column) -> Column:
    """The bytes of a WARC response record; what may differ between captures of equal pages (dates, record ids) is left out."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, nth, file, offset, length, digest. Bodies are hashed where they are read; only digests are shuffled."""
    r = record(F.col("url").cast("string"), F.col("html").cast("string"))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(r, 256).alias("digest"), F.octet_length(r).cast("long").alias("length"))
    d = d.withColumn("file", F.expr(f"page_id div {FILE} - if(page_id % {FILE} < 0, 1, 0)"))
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(order) - F.rank().over(Window.partitionBy("file").orderBy("page_id")) + 1
    return d.select("page_id", nth.cast("int").alias("nth"), "file", before.alias("offset"), "length", "digest")


def parent(node: Column) -> Column:
    return F.floor(node.cast("decimal(20,0)") / F.lit(FANOUT)).cast("long")


def leaves(recs: DataFrame) -> DataFrame:
    """node (the page id, null for records without one), up (its parent), digest, start and end of its offset ranges."""
    one = F.concat_ws(":", "nth", "offset", "length", "digest")
    leaf = recs.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("nth", one.alias("s"))))["s"], ";").alias("all"), F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"))
    return C.written(leaf.select(F.col("page_id").alias("node"), parent(F.col("page_id")).alias("up"), F.sha2("all", 256).alias("digest"), "start", "end"), "merkle")


def above(level: DataFrame, root: bool) -> DataFrame:
    """The next level of a tree; root: one node over all."""
    up = F.lit(0).cast("long") if root else F.col("up")
    kids = F.array_join(F.array_sort(F.collect_list(F.struct("node", F.concat_ws(":", F.coalesce(F.col("node").cast("string"), F.lit("-")), "start", "end", "digest").alias("s"))))["s"], ";")
    return C.written(level.groupBy(up.alias("node")).agg(F.sha2(kids, 256).alias("digest"), F.min("start").alias("start"), F.max("end").alias("end")).select("node", parent(F.col("node")).alias("up"), "digest", "start", "end"), "merkle")


def trees(a: DataFrame, b: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The levels of both replicas' trees from the leaves to the roots. Both have one height: a root stands where the parents of both are one node."""
    levels = [(leaves(a), leaves(b))]
    for i in range(LEVELS):
        x, y = levels[-1]
        root = i == LEVELS - 1 or len(x.select("up").union(y.select("up")).distinct().limit(2).collect()) < 2
        levels.append((above(x, root), above(y, root)))
        if root:
            break
    return levels


def shuffled(found: DataFrame) -> DataFrame:
    """A written list, with a hint to join it by a shuffle where it is long: Spark would take well compressed nodes for few."""
    return found.hint("merge") if C.table_bytes(found.sparkSession, found.skein_path) > BROADCAST else found


def differing(a: DataFrame, b: DataFrame, among: DataFrame | None) -> DataFrame:
    """Nodes of one level whose digests differ or that one side lacks; among: the parents to look under."""
    if among is not None:
        among = shuffled(among)
        a, b = (x.join(among, x.up.eqNullSafe(among.node_above), "left_semi") for x in (a, b))
    x, y = a.select(F.col("node").alias("m"), F.col("digest").alias("p"), F.lit(1).alias("here")), b.select(F.col("node").alias("n"), F.col("digest").alias("q"), F.lit(1).alias("there"))
    return x.join(y, x.m.eqNullSafe(y.n), "full_outer").where("p is null or q is null or p <> q").select(F.when(F.col("here") == 1, F.col("m")).otherwise(F.col("n")).alias("node_above"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    a, b = C.written(records(primary), "records"), C.written(records(replica), "records")
    levels = trees(a, b)
    bad = None
    for i in range(len(levels) - 1, -1, -1):
        among = bad if i < len(levels) - 2 else None  # the children of the root are all its level has
        if bad is not None and bad.isEmpty():
            break
        bad = C.written(differing(*levels[i], among), "differing")
    bad = shuffled(bad)
    x = a.join(bad, a.page_id.eqNullSafe(bad.node_above), "left_semi").select("page_id", "nth", *(F.col(c).alias(f"primary_{c}") for c in ("offset", "length", "digest")))
    y = b.join(bad, b.page_id.eqNullSafe(bad.node_above), "left_semi").select(F.col("page_id").alias("id2"), F.col("nth").alias("nth2"), *(F.col(c).alias(f"replica_{c}") for c in ("offset", "length", "digest")))
    both = x.join(y, x.page_id.eqNullSafe(y.id2) & (x.nth == y.nth2), "full_outer")
    problem = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("primary_digest").isNull(), "extra").when(F.col("primary_digest") != F.col("replica_digest"), "changed").when((F.col("primary_offset") != F.col("replica_offset")), "moved")
    return both.select(F.coalesce("page_id", "id2").alias("page_id"), F.coalesce("nth", "nth2").alias("nth"), problem.alias("problem"), *(f"{s}_{c}" for s in ("primary", "replica") for c in ("offset", "length", "digest"))).where("problem is not null")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults that its urls decide: of 16 records one has its last byte changed, of 256 one is missing."""
    h = F.md5(F.col("url"))
    rot = F.concat(F.expr("substring(html, 1, greatest(length(html) - 1, 0))"), F.lit("~"))
    return pages.where(~F.coalesce(h.startswith("ab"), F.lit(False))).withColumn("html", F.when(h.startswith("0"), rot).otherwise(F.col("html")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table against a replica of it with known faults."""
    pages = C.read(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))


def _side(table: str) -> str:
    return f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY digest) AS nth, length, digest,
  coalesce(sum(length) OVER (PARTITION BY floor(page_id / {FILE}) ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
FROM (SELECT page_id, sha256(encode(r)) AS digest, octet_length(encode(r)) AS length FROM (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM {table}))"""


#: Every record of either side, compared without a tree.
SQL = f"""
WITH rotten AS (SELECT page_id, url, CASE WHEN starts_with(md5(url), '0') THEN left(html, greatest(length(html) - 1, 0)) || '~' ELSE html END AS html FROM pages WHERE NOT coalesce(starts_with(md5(url), 'ab'), false)),
p AS ({_side("pages")}), r AS ({_side("rotten")})
SELECT * FROM (SELECT coalesce(p.page_id, r.page_id) AS page_id, coalesce(p.nth, r.nth)::INTEGER AS nth,
  CASE WHEN r.digest IS NULL THEN 'missing' WHEN p.digest IS NULL THEN 'extra' WHEN p.digest <> r.digest THEN 'changed' WHEN p."offset" <> r."offset" THEN 'moved' END AS problem,
  p."offset" AS primary_offset, p.length AS primary_length, p.digest AS primary_digest, r."offset" AS replica_offset, r.length AS replica_length, r.digest AS replica_digest
  FROM p FULL JOIN r ON p.page_id IS NOT DISTINCT FROM r.page_id AND p.nth = r.nth) WHERE problem IS NOT NULL
"""
