"""Ranks over all rows, and the most frequent values of many columns, without a task that sees all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgraph.shared import stored

SALTS = 64


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the number of each row, from 1, in the order of the columns ``order`` (nulls
    first). Rows are dealt out by ranges and numbered in each; the driver sums one count a range.
    Rows that are equal in ``order`` have neighbouring numbers in no stated order."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted(map(tuple, ranged.groupBy("_range").count().collect()))
    before, total = [], 0
    for k, n in counts:
        before += [F.lit(k), F.lit(total).cast("long")]
        total += n
    if not counts:
        return df.withColumn(name, F.lit(0).cast("long"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, local + F.element_at(F.create_map(*before), F.col("_range"))).drop("_range")


def top_values(counts: DataFrame, by: list[str], value: str, n: str, k: int) -> DataFrame:
    """The ``k`` rows of each group of ``by`` with the largest ``n``, then the smallest value. A
    group is dealt into parts by value first, whose best ``k`` are all that meet."""
    order = [F.desc(n), F.col(value)]
    some = Window.partitionBy(*by, "_salt").orderBy(*order)
    few = counts.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS))).withColumn("_rank", F.row_number().over(some)).where(F.col("_rank") <= k)
    return few.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_salt", "_rank")
