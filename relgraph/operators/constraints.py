"""Keys and inclusions found in the data of any number of tables. Sketches, made in one pass over a
table, rule most candidates out; what is left is tested exactly.

Defined cases: a column with a null, an empty table's and one of floating point is no part of a key;
a key is minimal: no part of it is one; null children are in every parent; a column without values
is included in nothing.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The logarithm of a sketch's registers; its relative error, and how many of it a candidate may be
#: short by.
LG, ERROR, SLACK = 14, 0.01, 6
#: Parts by hash, of which a candidate's first is tested before the rest.
PARTS = 64
WHOLE = ("tinyint", "smallint", "int", "bigint")
KEYABLE = (*WHOLE, "string", "date", "timestamp", "timestamp_ntz", "boolean")


def composite_keys(df: DataFrame, most: int = 3, columns: list[str] | None = None) -> list[tuple[str, ...]]:
    """The minimal keys of up to ``most`` columns, level by level. A level is one pass: a
    HyperLogLog sketch for each candidate, of which only those that come near the number of rows are
    tested exactly. A candidate is left out if it holds a key, or if the product of its columns'
    distinct counts is below the number of rows."""
    own = [c for c, t in df.dtypes if t in KEYABLE and (columns is None or c in columns)]
    row = df.agg(F.count("*").alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"_{k}") for k, c in enumerate(own))).first()
    n, own = row.n, [c for k, c in enumerate(own) if row[f"_{k}"] == row.n]
    least = n * (1 - SLACK * ERROR)
    found: list[tuple[str, ...]] = []
    distinct: dict[str, float] = {}
    for size in range(1, most + 1 if n else 1):
        level = [c for c in combinations(own, size) if not any(set(k) <= set(c) for k in found)]
        if size > 1:
            level = [c for c in level if _product(distinct[x] * (1 + SLACK * ERROR) for x in c) >= n]
        if not level:
            continue
        near = df.agg(*(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*(f"`{x}`" for x in c)), LG)).alias(f"_{k}") for k, c in enumerate(level))).first()
        distinct |= {c[0]: near[k] for k, c in enumerate(level)} if size == 1 else {}
        for k, c in enumerate(level):
            if near[k] >= least and _is_key(df, c):
                found.append(c)
    return found


def _is_key(df: DataFrame, columns: tuple[str, ...]) -> bool:
    """Whether no two rows are equal in ``columns``. Equal rows have equal hashes: those of one in
    PARTS hashes are tested first, which shows most that are no key; the rest follow if need be."""
    names = [f"`{x}`" for x in columns]
    first = F.pmod(F.xxhash64(*names), F.lit(PARTS)) == 0
    return all(df.where(some).groupBy(*names).count().where("count > 1").isEmpty() for some in (first, ~first))


def _product(values) -> float:
    out = 1.0
    for v in values:
        out *= v
    return out


def all_keys(spark: SparkSession, tables: dict[str, DataFrame], most: int = 3) -> DataFrame:
    """(table, key, size) of all tables, a key's columns joined by commas."""
    rows = [(t, ",".join(k), len(k)) for t, df in tables.items() for k in composite_keys(df, most)]
    return spark.createDataFrame(rows, "table string, key string, size int")


def all_inclusions(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, parent, parent_column): columns of whole numbers, all of whose values are in
    a key of another table. One pass over a table sketches all its columns; a pair is ruled out by
    its bounds, or if the union's estimate is above the parent's; the rest meet exactly."""
    found = {}
    for t, df in tables.items():
        own = [c for c, k in df.dtypes if k in WHOLE]
        if own:
            each = [x for k, c in enumerate(own) for x in (F.min(f"`{c}`").alias(f"l{k}"), F.max(f"`{c}`").alias(f"h{k}"), F.hll_sketch_agg(F.col(f"`{c}`").cast("long"), LG).alias(f"s{k}"))]
            row = df.agg(*each).first()
            found |= {(t, c): (row[f"l{k}"], row[f"h{k}"], row[f"s{k}"]) for k, c in enumerate(own) if row[f"l{k}"] is not None}
    keys = [(t, k[0]) for t, df in tables.items() for k in composite_keys(df, 1, [c for c, kind in df.dtypes if kind in WHOLE])]
    pairs = [(c, p) for c in found for p in keys if c[0] != p[0] and found[p][0] <= found[c][0] and found[c][1] <= found[p][1]]
    rows = [(c[0], c[1], p[0], p[1], bytes(found[c][2]), bytes(found[p][2])) for c, p in pairs]
    sketched = spark.createDataFrame(rows, "table string, column string, parent string, parent_column string, a binary, b binary")
    both, one = F.hll_sketch_estimate(F.hll_union("a", "b")), F.hll_sketch_estimate("b")
    likely = sketched.where(both <= one * (1 + SLACK * ERROR)).select("table", "column", "parent", "parent_column")
    likely = [tuple(r) for r in likely.collect()]  # columns, not values
    schema = "table string, column string, parent string, parent_column string"
    pairs = F.broadcast(spark.createDataFrame(likely, schema))
    children, parents = {(a, b) for a, b, _, _ in likely}, {(a, b) for _, _, a, b in likely}
    child = _values(spark, tables, children).distinct()
    parent = _values(spark, tables, parents).select(F.col("table").alias("parent"), F.col("column").alias("parent_column"), "value")
    met = child.join(parent, "value").join(pairs, ["table", "column", "parent", "parent_column"]).groupBy("table", "column", "parent", "parent_column").agg(F.count("*").alias("m"))
    n = child.groupBy("table", "column").agg(F.count("*").alias("n"))
    return met.join(n, ["table", "column"]).where("m = n").select("table", "column", "parent", "parent_column")


def _values(spark: SparkSession, tables: dict[str, DataFrame], columns: set[tuple[str, str]]) -> DataFrame:
    """(table, column, value) of the whole numbers in ``columns``: each table in one pass."""
    out = spark.createDataFrame([], "table string, column string, value long")
    for t in sorted({t for t, _ in columns}):
        cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("long").alias("value")) for x, c in sorted(columns) if x == t))
        out = out.unionByName(tables[t].select(F.explode(cells).alias("x")).select(F.lit(t).alias("table"), "x.column", "x.value").where("value is not null"))
    return out
