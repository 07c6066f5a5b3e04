"""Table catalogs: columns, keys, join specifications, table models and dataset descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYSTEM_DATABASES = ["information_schema", "mysql", "performance_schema", "sys", "postgres", "template0", "template1"]
COLUMNS = "table_name string, column_name string, ordinal int, data_type string"
KEYS = "constraint_name string, table_name string, column_name string, position int, constraint_type string, foreign_table string, foreign_column string"


def columns(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    """The columns of a directory of Parquet tables: only footers are read."""
    return spark.createDataFrame([(t, f.name, i + 1, f.dataType.simpleString()) for t in tables for i, f in enumerate(spark.read.parquet(f"{path}/{t}.parquet").schema)], COLUMNS)


def columns_jdbc(spark: SparkSession, url: str, schema: str = "public", **options) -> DataFrame:
    """The same of a database, asked of its information schema."""
    query = f"SELECT table_name, column_name, ordinal_position AS ordinal, data_type FROM information_schema.columns WHERE table_schema = '{schema}'"
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


CONSTRAINTS = {
    "constraints": "SELECT constraint_name, table_schema, table_name, constraint_type FROM information_schema.table_constraints WHERE constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY')",
    "usage": "SELECT constraint_name, table_schema, column_name, ordinal_position AS position FROM information_schema.key_column_usage",
    "targets": "SELECT r.constraint_name, r.constraint_schema AS table_schema, k.ordinal_position AS position, k.table_name AS foreign_table, k.column_name AS foreign_column FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage k ON k.constraint_name = r.unique_constraint_name AND k.constraint_schema = r.unique_constraint_schema",
}


def keys_jdbc(spark: SparkSession, url: str, **options) -> DataFrame:
    """Keys of a database, asked of its information schema: three scans, joined here."""
    read = {k: spark.read.format("jdbc").options(url=url, query=q, **options).load() for k, q in CONSTRAINTS.items()}
    return constraint_columns(**read).select(*[c.split()[0] for c in KEYS.split(", ")])


def table_names(cols: DataFrame) -> DataFrame:
    return cols.select("table_name").distinct()


def user_databases(databases: DataFrame) -> DataFrame:
    return databases.where(~F.col("name").isin(SYSTEM_DATABASES))


def keys(spark: SparkSession, primary: dict[str, list[str]], foreign: list[tuple[list[tuple[str, str]], str, str]]) -> DataFrame:
    """Constraints of tables without any of their own. foreign: ([(column, foreign column)], table, foreign table)."""
    rows = [(f"{t}_pk", t, c, i + 1, "PRIMARY KEY", None, None) for t, cs in primary.items() for i, c in enumerate(cs)]
    rows += [(f"{t}_{pairs[0][0]}_fk", t, c, i + 1, "FOREIGN KEY", ft, fc) for pairs, t, ft in foreign for i, (c, fc) in enumerate(pairs)]
    return spark.createDataFrame(rows, KEYS)


def constraint_columns(constraints: DataFrame, usage: DataFrame, targets: DataFrame) -> DataFrame:
    """Constraints joined with their columns and, by place, with the columns they refer to; a composite key pairs column by column."""
    own = constraints.join(usage, ["constraint_name", "table_schema"])
    return own.join(targets.select("constraint_name", "table_schema", "position", "foreign_table", "foreign_column"), ["constraint_name", "table_schema", "position"], "left")


def flagged(cols: DataFrame, ks: DataFrame) -> DataFrame:
    """Columns with primary or foreign; a column that is both is primary."""
    kind = ks.groupBy("table_name", "column_name").agg(F.max((F.col("constraint_type") == "PRIMARY KEY").cast("int")).alias("pk"), F.max((F.col("constraint_type") == "FOREIGN KEY").cast("int")).alias("fk"))
    return cols.join(kind, ["table_name", "column_name"], "left").withColumn("key", F.when(F.col("pk") == 1, "primary").when(F.col("fk") == 1, "foreign")).drop("pk", "fk")


def joins(ks: DataFrame) -> DataFrame:
    """table_name, name (of the foreign table), sql of each foreign key; constraints without target are none."""
    f = ks.where("constraint_type = 'FOREIGN KEY' and foreign_table is not null")
    part = F.format_string("{%s}.%s = {%s}.%s", "table_name", "column_name", "foreign_table", "foreign_column")
    return f.groupBy("constraint_name", "table_name", "foreign_table").agg(F.array_join(F.array_sort(F.collect_list(F.struct("position", part.alias("s"))))["s"], " AND ").alias("sql")).select("table_name", F.col("foreign_table").alias("name"), "sql")


def models(cols: DataFrame, ks: DataFrame, database: str, fingerprints: DataFrame | None = None) -> DataFrame:
    """One row a table: name, sql_name, dimensions, joins (null without any), description."""
    c = flagged(cols, ks)
    c = c.join(fingerprints, ["table_name", "column_name"], "left") if fingerprints is not None else c.withColumn("embedding", F.lit(None).cast("array<double>"))
    dim = F.struct("ordinal", F.col("column_name").alias("name"), F.col("data_type").alias("type"), F.col("column_name").alias("sql"), "embedding", F.when(F.col("key") == "primary", True).alias("primary_key"), F.when(F.col("key") == "foreign", True).alias("foreign_key"))
    d = c.groupBy("table_name").agg(F.array_sort(F.collect_list(dim)).alias("dimensions"), F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", "column_name")))["column_name"], ", ").alias("names"))
    j = joins(ks).groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("name", "sql"))).alias("joins"))
    return d.join(j, "table_name", "left").select(F.col("table_name").alias("name"), F.concat(F.lit(f"{database}."), "table_name").alias("sql_name"), "dimensions", "joins", F.concat(F.lit("Table "), "table_name", F.lit(" with columns "), "names").alias("description"))


def embedding_map(model: DataFrame) -> DataFrame:
    """name, column -> fingerprint; columns without one are left out."""
    some = F.filter("dimensions", lambda d: d["embedding"].isNotNull() & (F.size(d["embedding"]) > 0))
    return model.select("name", F.map_from_entries(F.transform(some, lambda d: F.struct(d["name"], d["embedding"]))).alias("correlation_embedding"))


def write_models(model: DataFrame, path: str) -> None:
    """One JSON file for each table under path/name=<table>; JSON is YAML too."""
    model.select("name", F.to_json(F.struct("name", "sql_name", "dimensions", "joins", "description")).alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def croissant(model: DataFrame) -> DataFrame:
    """A JSON-LD dataset description, one a table."""
    fields = F.transform("dimensions", lambda d: F.struct(d["name"].alias("name"), d["type"].alias("type"), d["embedding"].alias("emb")))
    record = F.struct(F.lit("cr:RecordSet").alias("@type"), F.col("name").alias("name"), fields.alias("field"))
    return model.select("name", F.to_json(F.struct(F.lit("sc:Dataset").alias("@type"), "name", "description", F.array(record).alias("recordSet"))).alias("json"))
