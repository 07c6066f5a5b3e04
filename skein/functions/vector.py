"""Vector arithmetic as column expressions; values are doubles before any subtraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _pair(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def let(value: Column, f) -> Column:
    """f(value) with value computed once, though f names it more than once."""
    return F.transform(F.array(value), f)[0]


def dot(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda x, y: x * y)


def l2_squared(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda x, y: (x - y) * (x - y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def normalised(a: Column) -> Column:
    return let(a, lambda v: let(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Mean of the token vectors that the mask keeps, by dimension."""
    kept = F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda t: t["m"] == 1)
    n = F.greatest(F.size(kept), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.size(hidden[0]) - 1), lambda i: _sum(F.transform(kept, lambda t: F.get(t["h"], i).cast("double"))) / n)


def last_token_pool(hidden: Column, mask: Column) -> Column:
    """The last token's vector; with padding on the left that is the last place."""
    return F.when(F.element_at(mask, -1) == 1, F.element_at(hidden, -1)).otherwise(F.element_at(hidden, F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: for each query vector its best document vector, summed."""
    return _sum(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d)))))


def hashed(words: Column, dimension: int = 64) -> Column:
    """A deterministic embedding: signed feature hashing of words, normalised."""
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int")
    sign = lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    parts = F.transform(words, lambda w: F.struct(place(w).alias("i"), sign(w).alias("s")))
    return normalised(let(parts, lambda m: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(m, F.lit(0.0), lambda a, x: a + F.when(x["i"] == i, x["s"]).otherwise(0.0)))))
