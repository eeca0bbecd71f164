"""Classes that tables hide: flags, discriminators and foreign keys that only some rows have.

A catalog has (table, column, sql_type, is_pk, fk_table); a profile has (table, column,
n_distinct, values), values all distinct ones where they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.operators.profile import value_counts
from relgraph.operators.ranks import top_values

#: Parts of names by which a column says what it is. Fixed values.
SURE = ("category", "class", "kind", "subtype", "type")
LIKELY = ("flag", "form", "grade", "group", "level", "mode", "rank", "role", "status", "variant")
FLAG_PREFIX = "^(can|did|has|is|was|will)_"
NO_FLAG = ("amount", "cost", "count", "height", "index", "length", "level", "num", "number", "order", "position", "price", "quantity", "rank", "rating", "score", "size", "sum", "total", "weight", "width")
BINARY = ("0", "1", "f", "false", "no", "t", "true", "yes")
BOOLS, INTS = ("bool", "boolean"), ("int", "integer", "smallint", "tinyint")
DISPATCH_TYPES = (*BOOLS, *INTS, "bigint", "char", "character", "text", "varchar", "string")
MOST_VALUES, LEAST_CONFIDENCE = 4, 3


def table_profiles(tables: dict[str, DataFrame], most: int = MOST_VALUES) -> DataFrame:
    """(table, column, total, non_null, n_distinct, values) of all columns, each table in one
    pass; values are the ``most`` smallest, all where there are no more."""
    out = None
    for name, df in tables.items():
        c = value_counts(df)
        real = F.col("value").isNotNull()
        few = top_values(c.where(real).withColumn("_same", F.lit(0)), ["column"], "value", "_same", most)
        few = few.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("values"))
        p = c.groupBy("column").agg(F.sum("n").alias("total"), F.sum(F.when(real, F.col("n")).otherwise(0)).alias("non_null"), F.count("value").alias("n_distinct"))
        p = p.join(few, "column", "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))
        p = p.withColumn("table", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out.select("table", "column", "total", "non_null", "n_distinct", "values")


def binary(values: Column) -> Column:
    """Whether there are values and all of them are of a flag."""
    return (F.size(values) > 0) & F.forall(values, lambda v: F.lower(v).isin(*BINARY))


def column_kinds(catalog: DataFrame, profiles: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """(table, column, kind): fk_ref, type_dispatch_t1, bool_flag, type_dispatch_t2 or other, in
    that order of claims."""
    name = F.lower("column")
    base = F.btrim(F.regexp_replace(F.lower("sql_type"), r"\(.*", ""))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    few = base.isin(*DISPATCH_TYPES) & (F.coalesce("n_distinct", F.lit(0)) <= most)
    flag_type = base.isin(*BOOLS, *INTS) & binary(F.when(F.col("n_distinct") <= most, F.col("values")))
    kind = (
        F.when(F.col("fk_table").isNotNull(), "fk_ref")
        .when(few & has(SURE), "type_dispatch_t1")
        .when(base.isin(*BOOLS) | (name.rlike(FLAG_PREFIX) & flag_type), "bool_flag")
        .when(few & has(LIKELY), "type_dispatch_t2")
        .when(flag_type & ~has(NO_FLAG), "bool_flag")
        .otherwise("other")
    )
    return catalog.join(profiles, ["table", "column"], "left").select("table", "column", kind.alias("kind"))


def evidence(catalog: DataFrame, profiles: DataFrame) -> DataFrame:
    """(table, columns): what is known of each table's columns that could hide classes; keys
    only where their names say so."""
    kinds = column_kinds(catalog, profiles)
    known = catalog.join(kinds, ["table", "column"]).join(profiles, ["table", "column"], "left")
    known = known.where("not is_pk or kind like 'type%'").where("kind <> 'other'")
    cell = F.struct("column", "kind", "sql_type", "fk_table", "total", "non_null", "n_distinct", "values")
    return known.groupBy("table").agg(F.array_sort(F.collect_list(cell)).alias("columns"))


def accepted(suggestions: DataFrame, kinds: DataFrame, classes: DataFrame, least: int = LEAST_CONFIDENCE) -> DataFrame:
    """Suggestions (table, column, class, confidence) whose class there is and whose confidence
    suffices; discriminators and flags need none."""
    sure = F.col("kind").isin("type_dispatch_t1", "type_dispatch_t2", "bool_flag")
    s = suggestions.join(kinds, ["table", "column"], "left").where(sure | (F.coalesce("confidence", F.lit(0)) >= least))
    return s.join(classes.select(F.col("class").alias("_c")), F.col("class") == F.col("_c"), "left_semi").select(suggestions.columns)


def reviewed(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions after a review (table, column, decision, new_class): kept, dropped or with
    another class; those that nobody reviewed are kept."""
    s = suggestions.join(decisions, ["table", "column"], "left").where("coalesce(decision, 'keep') <> 'drop'")
    return s.withColumn("class", F.when(F.col("decision") == "fix", F.coalesce("new_class", "class")).otherwise(F.col("class"))).select(suggestions.columns)


def hidden_keys(suggestions: DataFrame, own: DataFrame, catalog: DataFrame, mapped: DataFrame) -> DataFrame:
    """Foreign keys' suggestions whose class is not that of their table or their target (``own``:
    table, class), nor mapped already (``mapped``: class)."""
    s = suggestions.join(catalog.where("fk_table is not null").select("table", "column", "fk_table"), ["table", "column"])
    mine = own.select("table", F.col("class").alias("_own"))
    target = own.select(F.col("table").alias("fk_table"), F.col("class").alias("_target"))
    s = s.join(mine, "table", "left").join(target, "fk_table", "left").where(~F.col("class").eqNullSafe(F.col("_own")) & ~F.col("class").eqNullSafe(F.col("_target")))
    return s.join(mapped, "class", "left_anti").select(suggestions.columns)


def dispatched_values(dispatch: DataFrame, profiles: DataFrame) -> DataFrame:
    """Entries (table, column, value, class) whose value the column has."""
    there = profiles.select("table", "column", F.explode("values").alias("value"))
    return dispatch.join(there, ["table", "column", "value"], "left_semi")


def enum_sample(df: DataFrame, order: list[str], rows: int = 200, most: int = 15) -> DataFrame:
    """(column, values) of the columns with ``most`` distinct values at most in the first
    ``rows`` rows: a look at a sample, which is the feature."""
    c = value_counts(df.orderBy(*order).limit(rows)).where("value is not null")
    return c.groupBy("column").agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") <= most)
