"""Spectral fingerprints of columns, wavelets, correlation and paired tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vector as V


def spectrum(df: DataFrame, value: str, order_by: list[str], bins: int = 256, phase: bool = False) -> DataFrame:
    """Fingerprint of a column: magnitudes of its discrete Fourier transform over the norm of all bins, the first `bins`.

    Rows are numbered in the given order, which decides the transform. The norm of all bins is sqrt(N * sum of squares), so only the bins asked for are summed."""
    s = spectra(df, [value], order_by, bins)
    return s.select("k", "magnitude", *([F.atan2("im", "re").alias("phase")] if phase else []))


def spectra(df: DataFrame, columns: list[str], order_by: list[str], bins: int = 256) -> DataFrame:
    """name, k, re, im, magnitude of several columns in one pass: every Arrow batch gives its part of each sum, by a matrix product. Angles are reduced in whole numbers."""
    values = [F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns)]
    total = df.select(*values).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"v{i}") * F.col(f"v{i}")).alias(f"e{i}") for i in range(len(columns))]).first()
    n, energy = total.n, [total[f"e{i}"] or 0.0 for i in range(len(columns))]
    rows = _numbered(df.select(*values, *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)]), [f"o{i}" for i in range(len(order_by))], [f"v{i}" for i in range(len(columns))])
    ks = np.arange(min(bins, n))

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        re, im, some = np.zeros((len(columns), len(ks))), np.zeros((len(columns), len(ks))), False
        for b in it:
            some = True
            for at in range(0, b.num_rows, 2_048):
                part = b.slice(at, 2_048)
                x = np.stack([part.column(f"v{i}").to_numpy(zero_copy_only=False) for i in range(len(columns))])
                angle = (2 * math.pi / n) * (part.column("i").to_numpy()[:, None] * ks % n)
                re += x @ np.cos(angle)
                im -= x @ np.sin(angle)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(columns)), len(ks))), pa.array(np.tile(ks, len(columns))), pa.array(re.ravel()), pa.array(im.ravel())], names=["c", "k", "re", "im"])

    found = rows.mapInArrow(sums, "c long, k long, re double, im double").groupBy("c", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    size = [math.sqrt(n) * math.sqrt(e) for e in energy]
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("c").cast("int") + 1)
    return found.select(pick(columns).alias("name"), "k", "re", "im", F.coalesce(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / F.nullif(pick(size), F.lit(0.0)), F.lit(0.0)).alias("magnitude"))


#: Rows of a part that are numbered by one task, and the most parts.
PART, PARTS = 250_000, 1 << 10


def _parts(df: DataFrame, order_by: list[str], rows: int) -> Column:
    """The number of each row's part, in order: how many bounds are at most its key. Bounds are values, collected once from keys sampled by hash, so two scans put a row into the
    same part; range partitions don't, as each exchange samples its own bounds."""
    n = df.count()
    parts = min(PARTS, n // rows + 1)
    if parts < 2 or not order_by:
        return F.lit(0)
    names = [f"o{i}" for i in range(len(order_by))]
    keys = df.select(*[F.col(c).alias(o) for c, o in zip(order_by, names, strict=True)])
    some = keys.where(F.pmod(F.xxhash64(*names), F.lit(max(1, n // (100 * parts)))) == 0).groupBy(*names).agg(F.count("*").alias("c")).orderBy(*names).collect()
    ends, cuts = np.cumsum([r.c for r in some]), []
    for i in range(1, parts if some else 0):
        at = int(np.searchsorted(ends, ends[-1] * i / parts))
        if not cuts or cuts[-1] < at:
            cuts.append(at)
    if not cuts:
        return F.lit(0)
    literal = lambda r: F.struct(*[F.lit(r[o]).cast(keys.schema[o].dataType).alias(o) for o in names])
    bounds, key = F.sort_array(F.array(*[literal(some[at]) for at in cuts])), F.struct(*[F.col(c).alias(o) for c, o in zip(order_by, names, strict=True)])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) <= key, step).otherwise(0))


def _numbered(df: DataFrame, order_by: list[str], keep: list[str], rows: int | None = None) -> DataFrame:
    """Numbers rows from 0 in order: each part of about `rows` rows counts for itself and adds what the parts before it hold."""
    p = df.withColumn("p", _parts(df, order_by, rows or PART))
    local = p.withColumn("j", F.row_number().over(Window.partitionBy("p").orderBy(*order_by)) - 1)
    before = p.groupBy("p").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("p").alias("q"), "before")
    return local.join(F.broadcast(before), F.col("p") == F.col("q")).select(*keep, (F.col("j") + F.col("before")).cast("long").alias("i"))  # a row for each part


def side_by_side(tables: list[DataFrame], order_by: list[list[str]]) -> DataFrame:
    """Columns of several tables beside each other, row by row in each one's order; a shorter table ends in nulls."""
    out = None
    for i, (t, by) in enumerate(zip(tables, order_by, strict=True)):
        rows = _numbered(t, by, t.columns).withColumnRenamed("i", "row")
        out = rows if out is None else out.join(rows, "row", "full_outer")
    return out.drop("row")


def fingerprints(df: DataFrame, columns: list[str], order_by: list[str], bins: int = 256) -> DataFrame:
    """name, embedding of each numeric column, in one pass over the rows; columns that aren't numbers have a null embedding."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}
    some, none = [c for c in columns if c in numeric], df.sparkSession.createDataFrame([(c,) for c in columns if c not in numeric], "name string").withColumn("embedding", F.lit(None).cast("array<double>"))
    if not some:
        return none
    by = F.array_sort(F.collect_list(F.struct("k", "magnitude")))["magnitude"]  # at most `bins` values a column
    found = spectra(df, some, order_by, bins).groupBy("name").agg(by.alias("embedding"))
    return found.unionByName(none) if len(some) < len(columns) else found


def linked(embeddings: DataFrame) -> DataFrame:
    """Pairs of columns, most alike first: dot and cosine of their fingerprints (cut-off fingerprints aren't of unit length)."""
    e = embeddings.where("embedding is not null")
    a, b = e.select(F.col("name").alias("a"), F.col("embedding").alias("x")), e.select(F.col("name").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(V.dot(F.col("x"), F.col("y")), 6).alias("dot"), F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("cosine")).orderBy(F.desc("dot"), "a", "b")


FILTERS = {
    "db1": [0.7071067811865476, 0.7071067811865476],
    "db2": [0.48296291314469025, 0.836516303737469, 0.22414386804185735, -0.12940952255092145],
    "db3": [0.3326705529509569, 0.8068915093133388, 0.4598775021193313, -0.13501102001039084, -0.08544127388224149, 0.035226291882100656],
    "db4": [0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278],
}


def wavelet(values: np.ndarray, name: str = "db1", keep: int = 256) -> np.ndarray:
    """Multi-level periodic wavelet coefficients, coarsest first."""
    h = np.array(FILTERS[name])
    g = h[::-1] * (-1) ** np.arange(len(h))
    x, parts = np.asarray(values, float), []
    while len(x) >= max(2, len(h)):
        x = np.append(x, x[-1]) if len(x) % 2 else x
        at = (np.arange(0, len(x), 2)[:, None] + np.arange(len(h))) % len(x)
        parts.append(x[at] @ g)
        x = x[at] @ h
    return np.concatenate([x, *parts[::-1]])[:keep]


#: Values up to which one task takes a column's transform; a longer column is halved by the cluster first, level by level.
ONE_TASK = 1 << 16


def wavelets(df: DataFrame, value: str, order_by: list[str], name: str = "db1", keep: int = 256, one_task: int = ONE_TASK) -> DataFrame:
    """place, coefficient of a column in order, the `keep` coarsest. Levels of more than `one_task` values are sums over pairs of rows, done where the rows are;
    their details lie beyond `keep` and are left out."""
    h = FILTERS[name]
    x = _numbered(df.select(F.col(value).cast("double").alias("x"), *order_by), order_by, ["x"])
    n = df.count()
    while n > max(one_task, 4 * keep, 2 * len(h)):
        if n % 2:  # the last value once more
            x, n = x.unionByName(x.where(F.col("i") == n - 1).withColumn("i", F.lit(n).cast("long"))), n + 1
        half = n // 2
        parts = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(c).alias("c")) for m, c in enumerate(h)])
        to = x.select("x", "i", F.explode(parts).alias("p")).select((F.col("x") * F.col("p.c")).alias("x"), F.pmod(F.col("i") - F.col("p.m"), F.lit(n)).alias("t")).where("t % 2 = 0")
        x, n = to.groupBy((F.expr("t div 2")).alias("i")).agg(F.sum("x").alias("x")).select("x", "i"), half
    gathered = x.agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("xs"))

    @F.pandas_udf("array<double>")
    def coefficients(s):
        return s.map(lambda xs: wavelet(xs, name, keep))

    return gathered.select(F.posexplode(coefficients("xs")).alias("place", "coefficient"))


def pearson(a: Column, b: Column) -> Column:
    return F.corr(a.cast("double"), b.cast("double"))


def correlations_with(df: DataFrame, columns: list[str], other: str) -> DataFrame:
    """a, correlation of each column with one, in one aggregation."""
    return correlation_matrix(df, columns, other).select("a", "correlation")


def correlation_matrix(df: DataFrame, columns: list[str], other: str | None = None) -> DataFrame:
    """a, b, correlation of all pairs (or of each column with `other`), in one aggregation."""
    pairs = [(a, other) for a in columns] if other else [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{i}"), 6).alias("correlation")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def principal_components(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """Rows projected on the first k components of the centred columns."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("raw", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(v).transform(v)
    return PCA(k=k, inputCol="centred", outputCol="pc").fit(centred).transform(centred).withColumn("components", vector_to_array("pc")).drop("raw", "centred", "pc")


def t_tail(t: float, dof: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    if math.isnan(t) or dof <= 0:
        return math.nan
    a, b, x = dof / 2, 0.5, dof / (dof + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        f = d
        for m in range(1, 300):
            for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + n * d
                c = 1 + n / c
                d = 1 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                f *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return f

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """t, p and significance at 0.05 of the paired differences."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    one = df.agg(F.count(d).alias("n"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"))

    @F.pandas_udf("double")
    def tail(t, n):
        import pandas as pd

        return pd.Series([t_tail(float(x), float(m) - 1) if x == x and x is not None else math.nan for x, m in zip(t, n, strict=True)])

    return one.select("n", F.round("t", 6).alias("t"), F.round(tail("t", "n"), 6).alias("p")).withColumn("significant", F.col("p") < 0.05)
