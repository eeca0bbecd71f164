"""Driver queries of dumps: the given tables as dump text and back, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.functions.terms import normal_text
from relgraph.shared import new_path
from relgraph.sources import dump, dump_text


def _dump(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, dump.Table], DataFrame]:
    """Seven tables in two schemas, orders and documents as COPY blocks, conversations as INSERTs."""
    names = {"star.region": "region", "star.nation": "nation", "star.customer": "customer", "star.orders": "orders", "corpus.documents": "documents", "corpus.conversations": "conversations", "corpus.labels": "labels"}
    path = new_path(spark, "dump")
    tables = {n: spark.read.parquet(f"{sf_dir}/{t}.parquet") for n, t in names.items()}
    dump.write_dump(spark, tables, path, frozenset({"corpus.conversations"}))
    pieces = dump_text.pieces(spark, path)
    heads = pieces.where("kind = 'statement'").select("value").collect()  # a statement per table
    return path, dump.parse_ddl("\n".join(r.value for r in heads)), pieces


def dump_copy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, tables, pieces = _dump(spark, sf_dir)
    return dump.copy_rows(spark, path, tables, pieces)["orders"]


def dump_copy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, tables, pieces = _dump(spark, sf_dir)
    rows = dump.copy_rows(spark, path, tables, pieces)["documents"]
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sha"))


def dump_insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, tables, pieces = _dump(spark, sf_dir)
    return dump.insert_rows(spark, path, tables, pieces)["conversations"]


def dump_loaded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by table, all by one scan."""
    path, tables, pieces = _dump(spark, sf_dir)
    out = None
    for name, rows in dump.loaded(spark, path, tables, new_path(spark, "loaded"), pieces).items():
        one = rows.agg(F.count("*").alias("n"), F.count(rows.columns[-1]).alias("n_last")).select(F.lit(name).alias("table"), "n", "n_last")
        out = one if out is None else out.unionByName(one)
    return out


def dump_schema_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by schema; rows of the star schema look like statements of another."""
    tables = {
        "star.comments": spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("SET search_path = x"), "c_custkey").alias("v")),
        "corpus.roles": spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.lit("COPY star.t FROM stdin; -- "), "role").alias("v"), F.col("text").alias("t")),
    }
    path = new_path(spark, "dump")
    dump.write_dump(spark, tables, path, frozenset({"corpus.roles"}))
    return dump_text.lines(spark, path).where("value <> ''").groupBy("schema").agg(F.count("*").alias("n"))


def dump_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with quoted names, whose strings hold texts of many lines."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.replace("text", F.lit("'"), F.lit("''"))
    lines = F.concat(F.lit('INSERT INTO "The '), "role", F.lit('-Turn" ("User") VALUES ('), "conv_id", F.lit(", '\"Not A Name\" "), text, F.lit("') /* \"Nor\"\n This */;"))
    path = new_path(spark, "dump")
    turns.select(lines.alias("value")).write.text(path)
    return dump_text.lines(spark, path, normal_text).groupBy("value").agg(F.count("*").alias("n"))


def queries() -> dict:
    return {f.__name__: f for f in (dump_copy_rows, dump_copy_texts, dump_insert_rows, dump_loaded_counts, dump_schema_lines, dump_normalized)}


def oracle_sql() -> dict[str, str]:
    last = {"region": "r_name", "nation": "n_regionkey", "customer": "c_mktsegment", "orders": "o_orderpriority", "documents": "n_chars", "conversations": "text", "labels": "toxic"}
    return {
        "dump_copy_rows": "SELECT * FROM orders",
        "dump_copy_texts": "SELECT doc_id, lang, source, n_chars, sha256(text) AS sha FROM documents",
        "dump_insert_rows": "SELECT * FROM conversations",
        "dump_loaded_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n, count({c}) AS n_last FROM {t}" for t, c in last.items()),
        "dump_schema_lines": """
            SELECT 'star' AS schema, count(*) + 5 AS n FROM customer
            UNION ALL SELECT 'corpus', (4 + sum(1 + len(list_filter(string_split(concat('(''COPY', role, ''', ''', text, ''');'), chr(10)), lambda x: x <> ''))))::BIGINT FROM conversations""",
        "dump_normalized": """
            SELECT value, count(*) AS n FROM (SELECT unnest(string_split(concat('insert into the_', role, '_turn (user_) values (', conv_id, ', ''"Not A Name" ', replace(text, '''', ''''''), ''') /* "Nor"', chr(10), ' This */;'), chr(10))) AS value FROM conversations)
            GROUP BY value""",
    }
