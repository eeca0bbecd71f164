"""A training corpus from ``documents``: five stages, each written as Parquet and read
again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns the rows that its decision leaves, with
the columns of documents; the last adds ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.llm import decontam, mixing, ngram_join, sharding, toxicity
from relgraph.llm.common import numbered, stored


def _bare(docs: DataFrame) -> DataFrame:
    """doc_id, text, source and all columns as one, so that none clashes with an operator's."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", "source", F.struct(*rest).alias("_rest"))


def _whole(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows with the columns of ``docs`` again."""
    return rows.select("doc_id", "text", "_rest.*").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _whole(toxicity.score(_bare(docs), model).where("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by 5-word shingles at 0.8. Rows of one doc_id
    and different texts are documents of their own, and so are rows without doc_id, which come
    last: the number of (doc_id, text) stands for them. Of equal ones the row with the smallest
    other columns stays. Texts without words are nobody's copy, but equal rows are."""
    bare = _bare(docs)
    one = bare.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    rows = bare.withColumn("_row", F.col("doc_id")) if one else _told_apart(bare)
    kept = ngram_join.join(rows.select(F.col("_row").alias("doc_id"), "text"), k=5, num=80, den=100)
    kept = kept.where("doc_id = component_id").select(F.col("doc_id").alias("_row"))
    rows = rows.join(kept, "_row", "left_semi")
    if not one:
        rows = rows.groupBy("_row").agg(F.min(F.struct("doc_id", "text", "source", "_rest")).alias("_first")).select("_first.*")
    return _whole(rows, docs)


def _told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with _row: the number of (doc_id, text) in the order of doc_id and a digest."""
    docs = docs.withColumns({"_none": F.col("doc_id").isNull(), "_doc": F.coalesce("doc_id", F.lit(0)), "_digest": F.coalesce(F.sha2("text", 256), F.lit(""))})
    key = ["_none", "_doc", "_digest"]
    each = docs.select(*key).distinct().repartitionByRange(*key).withColumns({"_part": F.spark_partition_id(), "_one": F.lit(1).cast("long")})
    numbers = numbered(stored(each, "rows"), ["_part", *key], "_row", [], "_one").select(*key, "_row")
    return stored(docs.join(numbers, key).drop(*key), "told-apart")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    found = decontam.decontaminate(_bare(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _whole(found.where(F.size("leaks") == 0), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: whole times, and once more where a hash of the row
    is below the rest. Rows of one doc_id, and rows without one, are told apart by all that they
    hold; equal rows are taken alike. A text without words is taken no time."""
    row = ("doc_id", "text", "source", "_rest")
    bare = _bare(docs).withColumn("_id", F.struct(F.xxhash64(*row).alias("a"), F.xxhash64(F.lit(1), *row).alias("b")))
    mixed = mixing.mix(bare.select(F.col("_id").alias("doc_id"), "text", "source"))["documents"]
    mixed = mixed.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.try_divide("taken", "size")).alias("_times"))
    chance = F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("_times") + chance).cast("int")
    rows = bare.join(mixed.where("_times > 0"), "_id").where(copies > 0)
    return _whole(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))), docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as read from the compacted, versioned table."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A classifier, a block schedule and file sizes decide: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
