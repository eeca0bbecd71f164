"""Profiling: columns, keys, inclusions and structural patterns of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOW_CARDINALITY = 4
SAMPLES = 40


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n) in one pass; null values are counted as null."""
    columns = columns or df.columns
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return df.select(F.explode(cells).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, total, non_null, n_distinct, top): rows, values, distinct values, and the
    most frequent value (the smallest of equals)."""
    c = value_counts(df, columns)
    real = F.col("value").isNotNull()
    best = F.max(F.when(real, F.struct("n", F.col("value")))).alias("_m")
    stats = c.groupBy("column").agg(F.sum("n").alias("total"), F.sum(F.when(real, F.col("n")).otherwise(0)).alias("non_null"), F.count("value").alias("n_distinct"), best)
    top = c.where(real).join(stats.select("column", F.col("_m.n").alias("n")), ["column", "n"]).groupBy("column").agg(F.min("value").alias("top"))
    return stats.drop("_m").join(top, "column", "left")


def sample_values(df: DataFrame, column: str, n: int = SAMPLES) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").limit(n)


def enum_columns(df: DataFrame, columns: list[str], most: int = LOW_CARDINALITY) -> DataFrame:
    """(column, value, n) of the columns with at most ``most`` distinct values."""
    c = value_counts(df, columns).where("value is not null")
    few = c.groupBy("column").agg(F.count("*").alias("k")).where(F.col("k") <= most)
    return c.join(few.select("column"), "column")


def key_candidates(df: DataFrame, candidates: list[list[str]]) -> DataFrame:
    """(key, rows, distinct_rows, unique) of each candidate; a null makes it no key."""
    aggs = []
    for k, cols in enumerate(candidates):
        aggs += [F.count_distinct(*cols).alias(f"d{k}")]
    row = df.agg(F.count("*").alias("rows"), *aggs)
    each = F.array(*(F.struct(F.lit(",".join(c)).alias("key"), F.col("rows"), F.col(f"d{k}").alias("distinct_rows"), (F.col(f"d{k}") == F.col("rows")).alias("unique")) for k, c in enumerate(candidates)))
    return row.select(F.explode(each).alias("x")).select("x.*")


def inclusion(child: DataFrame, c: str, parent: DataFrame, p: str) -> DataFrame:
    """(orphans, holds): child values without a parent; nulls are none."""
    kids = child.select(F.col(c).alias("v")).where("v is not null").distinct()
    lost = kids.join(parent.select(F.col(p).alias("v")), "v", "left_anti")
    return lost.agg(F.count("*").alias("orphans")).withColumn("holds", F.col("orphans") == 0)


CATALOG = "table string, column string, is_pk boolean, fk_table string, fk_column string"


def classify(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """(table, pattern). SR: two or more key columns, all foreign keys, nothing else; SRR:
    the same with attributes; SEw: a composite key of which some is a foreign key and that
    nobody refers to; SE_SH: its whole key refers to one parent's key; else SE."""
    pk, fk = F.col("is_pk"), F.col("fk_table").isNotNull()
    t = catalog.groupBy("table").agg(
        F.sum(pk.cast("int")).alias("pks"),
        F.sum((pk & fk).cast("int")).alias("pk_fks"),
        F.sum((~pk).cast("int")).alias("attributes"),
        F.count_distinct(F.when(pk, F.col("fk_table"))).alias("parents"),
    )
    referred = catalog.where(fk & (F.col("fk_table") != F.col("table"))).select(F.col("fk_table").alias("table")).distinct().withColumn("referred", F.lit(True))
    t = t.join(referred, "table", "left").withColumn("referred", F.coalesce("referred", F.lit(False)))
    all_fk = (F.col("pks") > 0) & (F.col("pks") == F.col("pk_fks"))
    bridge = all_fk & (F.col("pks") > 1) & ~F.col("referred")
    same_parent = all_fk & (F.col("parents") == 1) & (F.col("pks") == 1)
    pattern = F.when(bridge & (F.col("attributes") == 0), "SR").when(bridge, "SRR").when((F.col("pks") > 1) & (F.col("pk_fks") > 0) & (F.col("pk_fks") < F.col("pks")) & ~F.col("referred"), "SEw").when(same_parent, "SE_SH").otherwise("SE")
    return t.select("table", pattern.alias("pattern"))
