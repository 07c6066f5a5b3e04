"""Readers by type, and what sniffing a file or a connection string tells."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import text as X

CHUNKS = "document_id string, access_group string, document_name string, chunk_text string, chunking_strategy string, chunk_no int"
CONNECTION = r"^(?<type>[a-z0-9+]+)://(?:(?<user>[^:@/]*)(?::(?<password>[^@/]*))?@)?(?<host>[^:/?]+)(?::(?<port>\d+))?(?:/(?<database>[^?]*))?"


def kind(path: Column, content: Column) -> Column:
    """By magic bytes, else by extension, else null."""
    starts = lambda h: F.hex(F.substring(content, 1, len(h) // 2)) == h
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    zipped = F.when(ext.isin("docx", "pptx", "xlsx", "epub"), ext).otherwise("zip")
    known = F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("yml", "yaml"), "yaml").when(ext == "tex", "latex").when(ext.isin("txt", "csv", "tsv", "json", "rtf", "html", "xml"), ext)
    return F.when(starts("25504446"), "pdf").when(starts("50415231"), "parquet").when(starts("504B0304"), zipped).when(starts("7B5C727466"), "rtf").when(starts("D0CF11E0A1B11AE1"), F.when(ext == "ppt", "ppt").otherwise("doc")).when(known.isNotNull(), known)


def connection(s: Column) -> dict[str, Column]:
    """Parts of a connection string; what isn't there is null."""
    names = ["type", "user", "password", "host", "port", "database"]
    return {n: F.nullif(F.regexp_extract(s, CONNECTION, i + 1), F.lit("")) for i, n in enumerate(names)}


def _xml_text(data: bytes, member: str, paragraph: str, run: str) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = []
        for name in sorted((n for n in z.namelist() if re.fullmatch(member, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
            for p in ElementTree.fromstring(z.read(name)).iter():
                if p.tag.endswith(paragraph):
                    line = "".join(t.text or "" for t in p.iter() if t.tag.endswith(run))
                    if line.strip():
                        out.append(line)
        return "\n".join(out)


def _epub(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        pages = [z.read(n).decode("utf-8", "replace") for n in sorted(z.namelist()) if re.search(r"\.x?html?$", n)]
    body = re.sub(r"(?is)<(script|style|head).*?</\1>", "", "\n".join(pages))
    return re.sub(r"\n\s*\n+", "\n", re.sub(r"<[^>]+>", "", re.sub(r"(?i)</(p|div|h\d|li)>|<br\s*/?>", "\n", body))).strip()


def _rtf(data: bytes) -> str:
    s = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", data.decode("latin-1"))
    s = re.sub(r"\\'([0-9a-f]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), s)
    s = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), s)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-z]+-?\d* ?", "", re.sub(r"\\(par|line)\b ?", "\n", s))).strip()


PARSERS: dict[str, Callable[[bytes], str]] = {
    "docx": lambda d: _xml_text(d, r"word/document\.xml", "}p", "}t"),
    "pptx": lambda d: _xml_text(d, r"ppt/slides/slide\d+\.xml", "}p", "}t"),
    "epub": _epub,
    "rtf": _rtf,
}
TITLED = {"docx", "pptx", "epub", "rtf", "markdown"}


def chunks(texts: DataFrame, strategy: str = "basic", size: int = 500) -> DataFrame:
    """path, text as chunk rows, cleaned and numbered from 0."""
    made = X.chunks_by_title(F.col("text"), size) if strategy == "by_title" else X.chunks_basic(F.col("text"), size)
    return texts.select(X.uuid5(F.col("path")).alias("document_id"), F.lit("").alias("access_group"), X.basename(F.col("path")).alias("document_name"), F.lit(strategy).alias("chunking_strategy"), F.posexplode(made).alias("chunk_no", "chunk")).select("document_id", "access_group", "document_name", X.clean(F.col("chunk")).alias("chunk_text"), "chunking_strategy", F.col("chunk_no").cast("int"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parsed(spark: SparkSession, path: str, c_type: str, parser: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, text of binary documents; parser: for types that have none here, such as pdf."""
    parse = parser or PARSERS.get(c_type)
    if parse is None:
        raise NotImplementedError(f"no parser for {c_type}")

    @F.pandas_udf(T.StringType())
    def text(content):
        return content.map(lambda d: parse(bytes(d)))

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text"))


def issues(spark: SparkSession, path: str) -> DataFrame:
    """A tracker's export: one chunk for each issue."""
    return issue_chunks(spark.read.json(path, multiLine=True, schema="issues array<struct<id string, title string, status string, createdAt string>>").select(F.col("_metadata.file_path").alias("path"), "issues"))


def issue_chunks(exports: DataFrame) -> DataFrame:
    i = exports.select("path", F.explode("issues").alias("i"))
    return i.select(X.uuid5(F.col("path")).alias("document_id"), F.lit("").alias("access_group"), X.basename(F.col("path")).alias("document_name"), F.format_string("Title: %s\nStatus: %s\nCreated At: %s", "i.title", "i.status", "i.createdAt").alias("chunk_text"), F.lit("by issue").alias("chunking_strategy"), F.lit(None).cast("int").alias("chunk_no"))


def tracker_filename(prefix: str, ts: Column) -> Column:
    """The name an export is saved under."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss"), F.lit(".json"))


def sniffed(spark: SparkSession, path: str) -> str | None:
    """What a path is: db for a connection string, dir for a directory, else the type that name and first bytes tell."""
    if re.match(r"(?:postgres|postgresql|mysql|jdbc:[a-z]+)://", path) or path.startswith("jdbc:"):
        return "db"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isDirectory():
        return "dir"
    return spark.read.format("binaryFile").load(path).select(kind(F.col("path"), F.substring("content", 1, 16)).alias("k")).first().k


def directory(spark: SparkSession, path: str, read_pdf: bool = True, parser: Callable[[bytes], str] | None = None) -> DataFrame:
    """Chunks of all documents under a directory, type by type, so each type is one scan; files of tables and of unknown types aren't documents and are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", kind(F.col("path"), F.substring("content", 1, 16)).alias("k"))
    known = ["txt", "markdown", "html", *sorted(PARSERS), *(["pdf"] if read_pdf and parser else [])]
    out = None
    for k in [r.k for r in found.where(F.col("k").isin(known)).select("k").distinct().orderBy("k").collect()]:
        paths = [r.path for r in found.where(F.col("k") == k).collect()]
        part = load(spark, paths, k, read_pdf, parser if k == "pdf" else None)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], CHUNKS) if out is None else out


def database(spark: SparkSession, url: str, table: str | None = None, **options) -> DataFrame:
    """Rows of a table of a database, or the list of its tables."""
    c = re.match(CONNECTION.replace("(?<", "(?P<"), url)
    if url.startswith("jdbc:"):
        to, login = url, {}
    elif c and c["type"] in ("postgres", "postgresql"):
        to, login = f"jdbc:postgresql://{c['host']}:{c['port'] or 5432}/{c['database'] or ''}", {"user": c["user"], "password": c["password"]}
    elif c and c["type"] == "mysql":
        to, login = f"jdbc:mysql://{c['host']}:{c['port'] or 3306}/{c['database'] or ''}", {"user": c["user"], "password": c["password"]}
    else:
        raise NotImplementedError(f"databases of {url.split(':')[0]}")
    what = {"dbtable": table} if table else {"query": "SELECT table_name FROM information_schema.tables WHERE table_schema = 'public'"}
    return spark.read.format("jdbc").options(url=to, **{k: v for k, v in login.items() if v}, **what, **options).load()


def load(spark: SparkSession, path: str | list[str], c_type: str | None = None, read_pdf: bool = True, parser: Callable[[bytes], str] | None = None, **options) -> DataFrame:
    """A source by its type, which is sniffed if it isn't given: chunks of documents, rows of tables."""
    c_type = c_type or sniffed(spark, path)
    if c_type == "dir":
        return directory(spark, path, read_pdf, parser)
    if c_type == "db":
        return database(spark, path, **options)
    if c_type == "txt":
        return chunks(texts(spark, path))
    if c_type in ("markdown", "html"):
        return chunks(texts(spark, path), "by_title")
    if c_type == "pdf" and not read_pdf:
        raise PermissionError("reading of pdf is switched off")
    if c_type in TITLED or c_type in ("pdf", "doc", "ppt"):
        return chunks(parsed(spark, path, c_type, parser), "by_title")
    if c_type == "tracker":
        return issues(spark, path)
    if c_type in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="\t" if c_type == "tsv" else ",")
    if c_type == "json":
        return spark.read.json(path)
    if c_type == "parquet":
        return spark.read.parquet(path)
    raise NotImplementedError(f"sources of type {c_type}")
