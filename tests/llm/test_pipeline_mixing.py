"""The pipeline's mixing decides for each row, whatever its doc_id."""

from pyspark.sql import functions as F

import corpus_pipeline
from relgraph.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, words(10, "a"), "en", "a", 0), (1, words(1000, "b"), "en", "b", 0), (None, words(300, "c"), "en", "b", 0), (None, words(40, "d"), None, None, 0), (2, None, "en", "a", 0), (3, "", "en", "b", 0), (4, words(30_000, "long"), "de", "c", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = F.struct(F.xxhash64("doc_id", "text", "source", F.struct("lang", "source", "n_chars")).alias("a"), F.xxhash64(F.lit(1), "doc_id", "text", "source", F.struct("lang", "source", "n_chars")).alias("b"))
    mixed = mixing.mix(docs.select(key.alias("doc_id"), "text", "source"))["documents"].select(F.col("doc_id").alias("k"), "taken", "size").where("size > 0")
    share = {r.text: r.taken / r.size for r in docs.withColumn("k", key).join(mixed, "k").collect()}
    got: dict = {}
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        got[r.text] = got.get(r.text, 0) + 1
    assert all(0 <= got.get(t, 0) - int(s) <= 1 for t, s in share.items()) and set(got) <= set(share)
    assert not any(got.get(t) for t, s in share.items() if s == 0)
    assert mixing.mix(docs.limit(0))["documents"].collect() == [] and corpus_pipeline.mix_sources(spark, docs.limit(0), "").collect() == []
