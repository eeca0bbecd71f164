"""What the corpus operators share: the folder for intermediate tables, their
writing and rereading, numbering of rows and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one
    of our own where it is unset (single machine, tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Spark hand Python ``rows`` rows at a time at most, unless the session asks for
    less: whole texts are long, and a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within, Spark hands Python ``rows`` rows at a time at most in the jobs that it runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def packed(df: DataFrame, rows: int, per_task: int = 10_000) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more tasks than these need."""
    return df.coalesce(max(12, -(-rows // per_task)))


def freed(spark: SparkSession) -> None:
    """Spark deletes shuffle files after the driver's JVM has collected what refers to them;
    long jobs ask for that between rounds, lest all rounds' files lie on disk."""
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut and a
    lost executor costs no more than its running tasks."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stored``, in buckets by ``key``: two such frames meet by it without a shuffle. The
    table that Spark writes buckets through has a name for that moment only."""
    spark, table = df.sparkSession, f"llm_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, name)).bucketBy(spread(spark), key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # with a path of its own: files stay
    return out


def gone(df: DataFrame) -> None:
    """Delete a table that ``stored`` has written and nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/llm-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def apart(docs: DataFrame, *own: str) -> DataFrame:
    """The columns ``own`` and all others as one, so that none clashes with an operator's."""
    rest = [c for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*rest) if rest else F.lit(0)).alias("_row"))


def together(rows: DataFrame, docs: DataFrame, own: tuple, new: list[str]) -> DataFrame:
    """``rows`` of ``apart(docs, *own)`` with the columns of ``docs`` again, and ``new`` ones,
    which replace those of their names."""
    old = [F.col(c) if c in own else F.col("_row")[c].alias(c) for c in docs.columns if c not in new]
    return rows.select(*old, *new)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list[str], name: str, by: list[str], within: str) -> DataFrame:
    """Add ``name``: the sum of ``within`` over the rows before, by ``order``, in each
    group of ``by``. ``order[0]`` names a bucket column; no task sees more of a group than
    one bucket, and the buckets' sums are one small row each."""
    bucket = order[0]
    sums = df.groupBy(*by, bucket).agg(F.sum(within).alias("_sum"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*by, bucket).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(within).over(inner), F.lit(0)))
    return local.join(sums, [*by, bucket]).withColumn(name, F.col("_before") + F.col("_local")).drop("_before", "_local")


def total_of(rows: DataFrame, add: Callable, size: int, kind=np.float64, parts: int = 16) -> np.ndarray:
    """The sum of the arrays of ``size`` numbers that ``add`` yields for each task's batches
    (mapInArrow). Arrays travel compressed and in parts, and are summed in two levels, so that
    no task holds those of all."""
    wide = -(-size // parts)
    schema = "part int, data binary"

    def made(at: list[int], arrays: list[np.ndarray]) -> list:
        return [pa.array(at, pa.int32()), pa.array([zlib.compress(x.astype(kind).tobytes(), 1) for x in arrays], pa.binary())]

    def each(batches):
        for total in add(batches):
            yield pa.RecordBatch.from_arrays(made(list(range(parts)), [total[k * wide : (k + 1) * wide] for k in range(parts)]), ["part", "data"])

    def summed(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), kind).astype(np.float64) for x in t.column("data"))
        return pa.Table.from_arrays(made([t.column("part")[0].as_py()], [total]), ["part", "data"])

    some = rows.mapInArrow(each, schema).groupBy("part", (F.spark_partition_id() % 64).alias("_some")).applyInArrow(summed, schema)
    total = np.zeros(size)
    for r in some.groupBy("part").applyInArrow(summed, schema).collect():
        total[r.part * wide : (r.part + 1) * wide] = np.frombuffer(zlib.decompress(r.data), kind)
    return total


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], n: int, how: str = "inner", most: int = 10_000) -> DataFrame:
    """``rows``, ``n`` at most, with the columns of ``table`` (one row a key; inner or left).
    Keys of more than n / ``most`` rows, which are fewer than ``most``, meet ``table`` by
    broadcast, so that no task holds all rows of one; the others meet by shuffle."""
    least = max(1_000, n // most)
    hot = rows.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_many")).where(F.col("_many") > least).select(*keys) if n > least else None
    found = hot.collect() if hot is not None else []
    if not found:
        return rows.join(table, keys, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    few = F.broadcast(table.join(hot, keys, "left_semi"))
    return rows.join(hot, keys, "left_semi").join(few, keys, how).unionByName(rows.join(hot, keys, "left_anti").join(table, keys, how))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` reaches, for all nodes
    but those that are their own root.

    Alternating star contraction: each pass hangs a node's larger (then smaller)
    neighbours on its smallest one. Minima are combined before the shuffle, and a node of
    huge degree meets its minimum by broadcast.
    """
    now = stored(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct(), "edges")
    while not _stars(now):
        n = now.count()
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = looked_up(both.where("u > v"), low, ["v"], n).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = looked_up(large, low, ["v"], n).select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        now = stored(packed(small.where("v <> u").distinct(), n, 100_000), "edges")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether each v hangs on one u only and none hangs on a v: then all u are roots."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    per = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not per.agg(F.max((F.col("below") + F.col("above") > 1) & (F.col("below") > 0))).first()[0]
