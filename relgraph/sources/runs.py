"""Runs of an evaluation as a relation: which files there are, the newest of each, and the manifests
that say what their queries are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)$"


def found(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(system, stamp, dataset, file, path, bytes, modified): the files ``system/stamp/dataset/file``
    below ``root`` whose names match the glob ``pattern``; contents are not read. A path of another
    depth is no run, and Spark passes over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    parts = [F.regexp_extract("path", RUN, k).alias(c) for k, c in enumerate(("system", "stamp", "dataset", "file"), 1)]
    base = len(root.rstrip("/").removeprefix("file://").split("/"))
    prefix = F.size(F.split(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "/"))
    return files.where(prefix == base + 4).select(*parts, "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def newest(runs: DataFrame) -> DataFrame:
    """The runs of the latest stamp of each system and dataset; stamps sort as they are written."""
    last = runs.groupBy("system", "dataset").agg(F.max("stamp").alias("stamp"))
    return runs.join(last, ["system", "dataset", "stamp"], "left_semi")


def manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, id, label, categories): the queries of JSON manifests, lists of objects that may span
    lines; unknown fields are passed over."""
    rows = spark.read.schema("id string, label string, categories array<string>").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(paths)
    return rows.select(F.col("_metadata.file_path").alias("path"), "id", "label", "categories")


def scores(spark: SparkSession, root: str) -> DataFrame:
    """(path, label, f1, precision, recall): the lines of score files ``*.txt``; NaN, and what is no
    number, is null; lines of other shapes are passed over."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root).select("value", F.col("_metadata.file_path").alias("path"))
    cells = F.split("value", r"\|")
    number = lambda k: F.nanvl(F.get(cells, F.lit(k)).try_cast("double"), F.lit(None).cast("double"))
    return rows.where(F.size(cells) == 4).select("path", F.btrim(F.get(cells, F.lit(0))).alias("label"), number(1).alias("f1"), number(2).alias("precision"), number(3).alias("recall"))


def described(scores: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores with their query's id and categories, found by label, else by the label's number."""
    number = F.regexp_extract("label", r"(?i)^(Q\d+)", 1)
    named = queries.select(F.col("label"), F.col("id"), F.col("categories")).dropDuplicates(["label"])
    by_id = queries.select(F.upper("id").alias("_id"), F.col("id").alias("_own"), F.col("categories").alias("_categories")).dropDuplicates(["_id"])
    both = scores.join(named, "label", "left").join(by_id, F.upper(number) == F.col("_id"), "left")
    return both.select(*scores.columns, F.coalesce("id", "_own").alias("id"), F.coalesce("categories", "_categories").alias("categories"))
