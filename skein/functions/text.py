"""Text as column expressions: cleaning, tokens, chunks, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def strip_control(t: Column) -> Column:
    """Without characters of the Unicode categories C*; line breaks vanish without a space."""
    return F.regexp_replace(t, r"\p{C}", "")


def space_sentences(t: Column) -> Column:
    """A space after . ? ! where none follows."""
    return F.regexp_replace(t, r"(?U)(?<=[.?!])(?=[^\s])", " ")


def clean(t: Column) -> Column:
    return space_sentences(strip_control(t))


def tokens(t: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def truncate(words: Column, n: int) -> Column:
    return F.slice(words, 1, n)


def drop_padding(ids: Column) -> Column:
    """Without the zeros after the last other value."""
    last = F.array_max(F.transform(ids, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return F.slice(ids, F.lit(1), F.coalesce(last, F.lit(0)))


def uuid5(name: Column) -> Column:
    """The RFC 4122 version 5 UUID of a URL."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), part(18, 3)), part(21, 12))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def prefixed(t: Column, role: str) -> Column:
    """'query: ...' or 'passage: ...', as retrieval models are trained on."""
    return F.concat(F.lit(f"{role}: "), t)


def instructed(task: Column, query: Column) -> Column:
    return F.format_string("Instruct: %s\nQuery: %s", task, query)


def index_name(name: Column, dimension: Column) -> Column:
    return F.concat(F.trim(name), F.lit("_d"), dimension.cast("string"))


def _packed(elements: Column, size: int, starts=None) -> Column:
    """Elements joined by spaces into chunks of at most `size`; starts(x): must x begin a chunk?"""
    whole = F.flatten(F.transform(elements, lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.length(e) - 1) / size).cast("int")), lambda i: F.substring(e, i * size + 1, F.lit(size)))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, x: Column) -> Column:
        fits = F.length(a["now"]) + 1 + F.length(x) <= size
        if starts is not None:
            fits = fits & ~starts(x)
        begun = a["now"] != ""
        return F.struct(
            F.when(begun & ~fits, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
            F.when(begun & fits, F.concat(a["now"], F.lit(" "), x)).otherwise(x).alias("now"),
        )

    return F.aggregate(whole, empty, step, lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def elements(t: Column) -> Column:
    return F.filter(F.split(t, r"\n+"), lambda x: F.trim(x) != "")


def heading(x: Column) -> Column:
    """A line that opens a section: marked as a heading, or short and without a full stop."""
    return x.rlike(r"^#{1,6}\s") | ((F.length(x) <= 80) & ~x.rlike(r"[.?!,;:]\s*$") & x.rlike(r"^\p{Lu}"))


def chunks_basic(t: Column, size: int = 500) -> Column:
    """Lines packed into chunks; the fold stays in the row, so nothing is shuffled."""
    return _packed(elements(t), size)


def chunks_by_title(t: Column, size: int = 500) -> Column:
    """As chunks_basic, and a heading always opens a chunk."""
    return _packed(elements(t), size, heading)


def title(content: Column) -> Column:
    """The first 100 characters of a message's input, or Untitled."""
    return F.coalesce(F.nullif(F.substring(F.get_json_object(content, "$.input"), 1, 100), F.lit("")), F.lit("Untitled"))
