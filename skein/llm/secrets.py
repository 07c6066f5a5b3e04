r"""Secret scans by multipart credential linking.

Candidates are parts of a credential, each with its place in the text and a strength:

    access    cloud key identifiers (AKIA/ASIA and 16 capitals or digits), strong; addresses (user@host), weak
    secret    private key blocks, `password=...`, `token = "..."`, known token prefixes, strong; bare strings of 32
              hexadecimal digits or more, or of base64 with both cases and digits (40 or more; 20 or more without a slash,
              18 or more before padding), weak
    endpoint  connection strings with a password in them, strong; URLs and IPv4 addresses, weak

A scope is a window of SCOPE characters within one document. Parts of different kinds whose spans lie within SCOPE of
each other are linked by an interval join: both sides fall into all buckets of SCOPE characters that they (and, on one side, the scope around
them) touch, meet in the first that both have, and the exact distance decides. A strong part is always reported. A weak part is reported only
where the kind that completes it stands beside it: a weak secret beside an access identifier or an endpoint, a weak
access identifier or endpoint beside a secret. Two weak parts complete each other only if one is a secret.

Result: doc_id, start, end (characters of the text), kind, rule, strength, n_linked (parts that complete it), partners
(rules of these, sorted, distinct). No secret is printed.

Edge cases: a value starts with eight characters without white space and has no greatest length: in quotes it ends at the closing quote of its line, else at white space, a quote or a bracket. Null or empty texts have no parts. Repeated rows (same doc_id and text) are one document; rows of one doc_id
and different texts are scopes of their own; a null doc_id is kept. Overlapping spans of one kind: the strong one
stands, else the one that starts first, else the longer. Columns other than doc_id and text are not read by scan(); redact() keeps all columns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCOPE = 400
RULES = [
    ("access", "key_id", True, r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", "KIA|SIA"),
    ("secret", "private_key", True, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY"),
    ("secret", "known_prefix", True, r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})(?![A-Za-z0-9])", "gh[pousr]_|xox|sk_live_"),
    ("secret", "assignment", True, r"(?i:(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api_?key|access_?key|secret_?key))(?:\\?[\"'])? {0,2}[:=] {0,2}(?:\"(?=[^\s\"]{8})(?:[^\"\\\r\n]|\\.)*(?=\")|'(?=[^\s']{8})(?:[^'\\\r\n]|\\.)*(?=')|(?:\\?[\"'])?[^\s\"'<>{}()]{8,})", "(?i)pass|pwd|secret|token|key"),
    ("secret", "hex", False, r"(?<![A-Za-z0-9+/=_-])[0-9A-Fa-f]{32,}(?![A-Za-z0-9+/=_-])", "[0-9A-Fa-f]{32}"),
    ("secret", "base64", False, r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?:[A-Za-z0-9+/]{40,}={0,2}|[A-Za-z0-9+]{20,39}|[A-Za-z0-9+/]{18,39}={1,2})(?![A-Za-z0-9+/=_-])", "[A-Za-z0-9+/]{18}"),
    ("endpoint", "connection", True, r"[a-z][a-z0-9+]{1,20}://[^\s:/@]+:[^\s/@]+@[^\s/]+", "://"),
    ("endpoint", "url", False, r"https?://[A-Za-z0-9.-]{3,}(?:/[^\s\"'<>]*)?", "://"),
    ("endpoint", "ipv4", False, r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9.])", r"[0-9]\.[0-9]"),
    ("access", "address", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@"),
]
MAYBE = r"[0-9@:=]|A[KS]IA|PRIVATE KEY|gh[pousr]_|xox|sk_live_"
PARTS = "doc_key string, doc_id long, kind string, rule string, strong boolean, start int, end int"


def parts(text: str) -> list[tuple[int, int, str, str, bool]]:
    """Start, end, kind, rule, strong of each candidate, by place. Of one kind none overlap."""
    found = []
    for kind, rule, strong, pattern, hint in COMPILED:
        if hint.search(text):
            found += [(not strong, m.start(), -m.end(), kind, rule) for m in pattern.finditer(text)]
    strong: dict[str, tuple[list[int], list[int]]] = {}
    weak_end: dict[str, int] = {}
    out = []
    for weak, start, end, kind, rule in sorted(found):
        end = -end
        starts, ends = strong.setdefault(kind, ([], []))
        i = bisect_right(starts, start)
        if (i and ends[i - 1] > start) or (i < len(starts) and starts[i] < end) or (weak and weak_end.get(kind, 0) > start):
            continue
        if weak:
            weak_end[kind] = end
        else:
            starts.append(start)
            ends.append(end)
        out.append((start, end, kind, rule, not weak))
    return sorted(out)


COMPILED = [(k, r, s, re.compile(p), re.compile(h)) for k, r, s, p, h in RULES]


def scan_parts(docs: DataFrame) -> DataFrame:
    """One row for each part; doc_key tells documents apart by doc_id and text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in it:
            rows = []
            maybe = np.asarray(pa.compute.match_substring_regex(b.column("text"), MAYBE).fill_null(False))
            for i in np.flatnonzero(maybe):
                text = b.column("text")[i].as_py()
                got = parts(text)
                if got:
                    id_ = b.column("doc_id")[i].as_py()
                    key = f"{id_}:{hashlib.blake2b(text.encode(), digest_size=12).hexdigest()}"
                    rows += [(key, id_, kind, rule, strong, start, end) for start, end, kind, rule, strong in got]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32()), strict=True)], names=["doc_key", "doc_id", "kind", "rule", "strong", "start", "end"])

    return C.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batches, PARTS).distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The reported parts. Both sides of the join hash on (doc_key, bucket), so a document of many parts is many groups."""
    p = C.written(scan_parts(docs), "secret-parts")
    bucket = lambda x: F.floor(x / scope)
    left = p.withColumn("low", bucket(F.col("start") - scope)).withColumn("bucket", F.explode(F.sequence(F.col("low"), bucket(F.col("end") + scope))))
    right = p.select("doc_key", F.col("kind").alias("k2"), F.col("rule").alias("r2"), F.col("start").alias("s2"), F.col("end").alias("e2"), bucket(F.col("start")).alias("low2"), F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("bucket"))
    once = F.col("bucket") == F.greatest("low", "low2")  # a pair counts in the first bucket that both have
    completes = (F.col("kind") != F.col("k2")) & ((F.col("kind") == "secret") | (F.col("k2") == "secret"))
    near = (F.col("s2") - F.col("end") <= scope) & (F.col("start") - F.col("e2") <= scope)
    keys = ["doc_key", "doc_id", "kind", "rule", "strong", "start", "end"]
    links = left.join(right, ["doc_key", "bucket"]).where(once & completes & near).groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("r2")).alias("names"))
    alone = p.where("strong").select(*keys, F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("names"))
    both = links.unionByName(alone).groupBy(*keys).agg(F.max("n").alias("n_linked"), F.max_by("names", "n").alias("names"))
    return both.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "kind", "rule", F.when(F.col("strong"), "strong").otherwise("weak").alias("strength"), "n_linked", F.concat_ws(",", "names").alias("partners"))


def reported(got: list[tuple[int, int, str, str, bool]], scope: int = SCOPE) -> list[tuple[int, int]]:
    """Spans that scan() reports of one document's parts, by sweeping its parts in order of place."""
    if not got:
        return []
    start, end = np.array([g[0] for g in got]), np.array([g[1] for g in got])
    secret = np.array([g[2] == "secret" for g in got])
    reach = {}
    for s in (True, False):
        a, b = start[secret == s], np.sort(end[secret == s])
        # parts of the other side that neither start too late nor end too early
        reach[s] = lambda i, a=np.sort(a), b=b: np.searchsorted(a, end[i] + scope, "right") - np.searchsorted(b, start[i] - scope, "left") > 0
    return [(g[0], g[1]) for i, g in enumerate(got) if g[4] or reach[not secret[i]](i)]


def redact(docs: DataFrame, scope: int = SCOPE, column: str = "text") -> DataFrame:
    """docs with every reported part of the text replaced by [secret]; n_chars, if there, follows the new text."""
    names = docs.columns
    counted = "n_chars" in names

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            col = b.column(names.index(column))
            maybe = np.asarray(pa.compute.match_substring_regex(col, MAYBE).fill_null(False))
            new = {}
            for i in np.flatnonzero(maybe).tolist():
                text = col[i].as_py()
                spans = reported(parts(text), scope)
                if spans:
                    out, at = [], 0
                    for s, e in spans:
                        if s >= at:
                            out += [text[at:s], "[secret]"]
                        at = max(at, e)
                    new[i] = "".join([*out, text[at:]])
            if new:
                cols = list(b.columns)
                hit = np.zeros(b.num_rows, bool)
                hit[list(new)] = True
                cols[names.index(column)] = pa.compute.replace_with_mask(col.cast(pa.large_string()), pa.array(hit), pa.array(list(new.values()), pa.large_string())).cast(pa.string())
                if counted:
                    k = names.index("n_chars")
                    cols[k] = pa.compute.replace_with_mask(b.column(k), pa.array(hit), pa.array([len(x) for x in new.values()]).cast(b.column(k).type))
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return C.mapped(docs, batches, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with their reported parts redacted; no row goes, and null and empty texts stay as they are."""
    return redact(docs)
