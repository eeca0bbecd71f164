"""Comparing results, scoring them, and reports of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgraph.functions.terms import natural_key, normal_identifier
from relgraph.operators.ranks import ranked


def bag_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with how often each side has them, where that differs."""
    cols = a.columns
    n = a.groupBy(*cols).agg(F.count("*").alias("_a")).withColumn("_b", F.lit(0).cast("long")).unionByName(b.groupBy(*cols).agg(F.count("*").alias("_b")).withColumn("_a", F.lit(0).cast("long")))
    return n.groupBy(*cols).agg(F.sum("_a").alias("n_left"), F.sum("_b").alias("n_right")).where("n_left <> n_right")


def prf1(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """(precision, recall, f1) on bags; all null if both are empty, 0 if one is."""
    cols = expected.columns
    e = expected.withColumn("_e", F.lit(1)).withColumn("_r", F.lit(0))
    r = returned.select(*cols).withColumn("_e", F.lit(0)).withColumn("_r", F.lit(1))
    n = e.unionByName(r).groupBy(*cols).agg(F.sum("_e").alias("e"), F.sum("_r").alias("r"))
    t = n.agg(F.coalesce(F.sum(F.least("e", "r")), F.lit(0)).alias("tp"), F.coalesce(F.sum("e"), F.lit(0)).alias("e"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"))
    empty = (F.col("e") == 0) & (F.col("r") == 0)
    p = F.when(F.col("r") > 0, F.col("tp") / F.col("r")).when(~empty, 0.0)
    c = F.when(F.col("e") > 0, F.col("tp") / F.col("e")).when(~empty, 0.0)
    t = t.select(p.alias("precision"), c.alias("recall"))
    total = F.col("precision") + F.col("recall")
    return t.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).when(total == 0, 0.0))


def scores(df: DataFrame) -> DataFrame:
    """(label, f1, precision, recall) of ``label|f1|precision|recall`` lines; NaN is null."""
    x = F.split("value", r"\|")
    number = lambda k: F.nullif(F.get(x, F.lit(k)).try_cast("double"), F.lit(float("nan")))
    return df.where(F.size(x) >= 4).select(F.get(x, F.lit(0)).alias("label"), number(1).alias("f1"), number(2).alias("precision"), number(3).alias("recall"))


def matrix(df: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    return df.groupBy(row).pivot(column, columns).agg(F.first(value))


def best(df: DataFrame, row: str, value: str, tie: float = 1e-12) -> DataFrame:
    """Rows that reach their group's best value, ties included."""
    top = F.max(value).over(Window.partitionBy(row))
    return df.withColumn("_top", top).where(F.col(value) >= F.col("_top") - tie).drop("_top")


def baseline_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new, delta, state) of values rounded to two places."""
    x = a.select(key, F.round(value, 2).alias("old"))
    y = b.select(key, F.round(value, 2).alias("new"))
    d = F.round(F.col("new") - F.col("old"), 2)
    state = F.when(F.col("old").isNull() & F.col("new").isNull(), "none").when(F.col("old").isNull(), "gained").when(F.col("new").isNull(), "lost").when(d > 0, "better").when(d < 0, "worse").otherwise("same")
    return x.join(y, key).select(key, "old", "new", d.alias("delta"), state.alias("state"))


def overall(df: DataFrame, name: str = "All (AVG)") -> DataFrame:
    """(dataset, f1, precision, recall): each dataset's line of averages, its first."""
    w = Window.partitionBy("dataset").orderBy("position")
    return df.where(F.col("label") == name).withColumn("_k", F.row_number().over(w)).where("_k = 1").select("dataset", "f1", "precision", "recall")


def grand_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, mean): the mean of the groups' means; nulls count nowhere."""
    per = df.groupBy(group).agg(F.avg(value).alias("m"))
    return per.agg(F.count("m").alias("groups"), F.avg("m").alias("mean"))


def visible(df: DataFrame, row: str, value: str, mode: str = "filled") -> DataFrame:
    """The rows of groups with a value (filled), with all values (complete), or of all groups."""
    if mode == "all":
        return df
    w = Window.partitionBy(row)
    n = F.count(value).over(w)
    return df.withColumn("_show", n > 0 if mode == "filled" else n == F.count("*").over(w)).where("_show").drop("_show")


def by_coverage(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, filled, cells, place): groups with most values first, ties by name."""
    g = df.groupBy(group).agg(F.count(value).alias("filled"), F.count("*").alias("cells"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("filled"), group)))


def by_category(df: DataFrame, categories: str, value: str) -> DataFrame:
    """(category, n, mean): a row belongs to each of its categories."""
    each = df.select(F.explode(F.array_distinct(categories)).alias("category"), value)
    return each.groupBy("category").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def first_seen(df: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Each key's first row."""
    w = Window.partitionBy(key).orderBy(position)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def report_order(df: DataFrame) -> DataFrame:
    """(label, bucket, place) of lines (label, position): all together, then queries, then other
    averages; in a bucket by first place, then by natural order."""
    kind = F.when(F.col("label") == "All (AVG)", 0).when(F.col("label").rlike(r"(?i)^Q\d+"), 1).otherwise(2)
    one = first_seen(df, "label").withColumn("bucket", kind)
    order = Window.orderBy("bucket", "position", natural_key(F.col("label")))
    return one.select("label", "bucket", F.row_number().over(order).alias("place"))


def natural_order(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its place when digits count as numbers."""
    return ranked(df.withColumn("_key", natural_key(F.col(name))), ["_key", name], "place").drop("_key")


def labelled(df: DataFrame, name: str, families: dict[str, str], variants: dict[str, str]) -> DataFrame:
    """``df`` with family (by beginning) and variant (by end) of a name, else ``other``."""
    family = variant = F.lit("other")
    for start, f in families.items():
        family = F.when(F.startswith(F.col(name), F.lit(start)), f).otherwise(family)
    for end, v in variants.items():
        variant = F.when(F.endswith(F.col(name), F.lit(end)), v).otherwise(variant)
    return df.withColumn("family", family).withColumn("variant", variant)


def result_hash(df: DataFrame) -> DataFrame:
    """(n, hash): a SHA-256 that equal bags of rows share, whatever their order. Rows are
    hashed first, and their hashes' sums, of 32 bits each, stand for the bag."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    h = df.select(row.alias("h"))
    sums = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for k in range(8)]
    return h.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", *sums), 256).alias("hash"))


def ordered_equal(a: DataFrame, b: DataFrame, position: str) -> DataFrame:
    """(position, same): rows of equal position compared, for results with an order."""
    cols = [c for c in a.columns if c != position]
    x = a.select(position, F.struct(*cols).alias("_a"))
    y = b.select(position, F.struct(*cols).alias("_b"))
    return x.join(y, position, "full").select(position, F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def schema_signature(tables: dict[str, DataFrame], keys: DataFrame | None = None) -> DataFrame:
    """(kind, table, place, column, detail): columns with their types in order, and keys (table,
    column, parent, parent_column; no parent for primary ones), with normalized names."""
    spark = next(iter(tables.values())).sparkSession
    rows = [("COLUMN", t, k, c, kind) for t, df in tables.items() for k, (c, kind) in enumerate(df.dtypes, 1)]
    out = spark.createDataFrame(rows, "kind string, table string, place int, column string, detail string")
    if keys is not None:
        detail = F.when(F.col("parent").isNull(), "").otherwise(F.concat(normal_identifier(F.col("parent")), F.lit("."), normal_identifier(F.col("parent_column"))))
        out = out.unionByName(keys.select(F.when(F.col("parent").isNull(), "PK").otherwise("FK").alias("kind"), "table", F.lit(0).alias("place"), "column", detail.alias("detail")))
    return out.withColumns({c: normal_identifier(F.col(c)) for c in ("table", "column")})


def markdown(df: DataFrame, columns: list[str]) -> str:
    """A small report as a Markdown table; numbers to two places, nulls as a dash."""
    show = lambda v: "–" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    rows = [[show(r[c]) for c in columns] for r in df.select(*columns).collect()]
    return "\n".join("| " + " | ".join(x) + " |" for x in [columns, ["---"] * len(columns), *rows])


def latex(df: DataFrame, columns: list[str]) -> str:
    """A small report as the rows of a LaTeX tabular."""
    mark = lambda v: "--" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).translate({ord(c): "\\" + c for c in "&%$#_{}"})
    return "\n".join(" & ".join(mark(r[c]) for c in columns) + r" \\" for r in df.select(*columns).collect())
