"""Triples as files: N-Triples, one line a triple, and Parquet by predicate; and back.

Lines are Spark expressions and files are written by Spark's committer: a failed task leaves
nothing, and a folder without ``_SUCCESS`` is not a graph. IRIs are written in full: prefixed names
take their namespace, others stay if they are absolute and get the base otherwise.

Defined cases: a triple with a null term is not written; characters that may not stand in an IRI are
escaped as ``\\uXXXX``, as are control characters of literals; a literal of type xsd:string is plain;
an empty graph makes an empty folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.operators.materialize import SCHEMA

#: Namespaces of the names that a graph may have. Fixed values of the W3C's.
NAMESPACES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#"}
BASE = "urn:graph:"

#: A character and how a literal writes it. Fixed values of N-Triples.
_LITERAL = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
_NOT_IN_IRI = r"[\x00-\x20<>\"{}|^`\\]"
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def _escaped(text: Column, pattern: str) -> Column:
    """Characters of ``pattern`` as \\uXXXX; text without them is passed as it is."""
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(pattern), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c)), 4, "0"))).otherwise(c))
    return F.when(text.rlike(pattern), F.array_join(each, "")).otherwise(text)


def full_iri(term: Column, prefixes: dict[str, str] | None = None, base: str = BASE) -> Column:
    """A term's IRI: ``:x`` and relative ones after the base, prefixed names by their namespace."""
    out = F.when(term.startswith(":"), F.concat(F.lit(base), F.substr(term, F.lit(2)))).when(term.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), term).otherwise(F.concat(F.lit(base), term))
    for p, iri in (NAMESPACES | (prefixes or {})).items():
        out = F.when(term.startswith(f"{p}:"), F.concat(F.lit(iri), F.substr(term, F.lit(len(p) + 2)))).otherwise(out)
    return out


def lines(graph: DataFrame, prefixes: dict[str, str] | None = None, base: str = BASE) -> DataFrame:
    """The N-Triples line (value) of each row (s, p, o, o_kind, o_datatype); null if a term is. Each
    step is a projection of its own, lest Spark work out a term wherever it is looked at."""
    text = F.col("o")
    for char, mark in _LITERAL:
        text = F.replace(text, F.lit(char), F.lit(mark))
    is_iri = F.col("o_kind") == "iri"
    full = lambda c: full_iri(F.col(c), prefixes, base)
    rows = graph.select(full("s").alias("s"), full("p").alias("p"), F.when(is_iri, full("o")).otherwise(text).alias("o"), "o_kind", F.when(F.col("o_datatype") != "xsd:string", full("o_datatype")).alias("o_datatype"))
    iri = lambda c: F.concat(F.lit("<"), _escaped(F.col(c), _NOT_IN_IRI), F.lit(">"))
    literal = F.concat(F.lit('"'), _escaped(F.col("o"), _CONTROL), F.lit('"'), F.when(F.col("o_datatype").isNull(), "").otherwise(F.concat(F.lit("^^"), iri("o_datatype"))))
    return rows.select(F.concat(iri("s"), F.lit(" "), iri("p"), F.lit(" "), F.when(is_iri, iri("o")).otherwise(literal), F.lit(" .")).alias("value"))


def write(graph: DataFrame, path: str, prefixes: dict[str, str] | None = None, base: str = BASE) -> None:
    """The graph as N-Triples files in the folder ``path``, which must not exist."""
    lines(graph, prefixes, base).where("value is not null").write.text(path)


def write_by_predicate(graph: DataFrame, path: str, per_file: int = 10_000_000) -> None:
    """The graph as Parquet in a folder for each predicate, so that a pattern reads only its own.
    A predicate's rows are dealt out by subject, a frequent one's to many files."""
    rows = graph.where("s is not null and o is not null").withColumn("predicate", F.col("p"))
    rows.write.option("maxRecordsPerFile", per_file).partitionBy("predicate").parquet(path)


def read_by_predicate(spark: SparkSession, path: str, predicates: list[str] | None = None) -> DataFrame:
    rows = spark.read.schema(SCHEMA + ", predicate string").parquet(path)
    return (rows.where(F.col("predicate").isin(predicates)) if predicates is not None else rows).drop("predicate")


def _plain(text: Column) -> Column:
    """Text without its escapes: between escaped backslashes the frequent ones are replaced; text with
    others goes through its pieces one by one."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\.|[^\\]+)"), F.lit(1))

    def one(x: Column) -> Column:
        out = F.substr(x, F.lit(2))
        for char, mark in _LITERAL:
            out = F.when(x == mark, char).otherwise(out)
        out = F.when(x.startswith("\\u"), F.char(F.conv(F.substr(x, F.lit(3)), 16, 10).cast("int"))).otherwise(out)
        return F.when(x.startswith("\\"), out).otherwise(x)

    def frequent(x: Column) -> Column:
        for char, mark in _LITERAL[1:]:
            x = F.replace(x, F.lit(mark), F.lit(char))
        return x

    few = F.array_join(F.transform(F.split(text, r"\\\\"), frequent), "\\")
    return F.when(~F.contains(text, F.lit("\\")), text).when(text.rlike(r'\\([^\\"nrt]|$)'), F.array_join(F.transform(pieces, one), "")).otherwise(few)


def short_iri(iri: Column, prefixes: dict[str, str] | None = None, base: str = BASE) -> Column:
    """The inverse of full_iri."""
    out = F.when(iri.startswith(base), F.concat(F.lit(":"), F.substr(iri, F.lit(len(base) + 1)))).otherwise(iri)
    for p, space in (NAMESPACES | (prefixes or {})).items():
        out = F.when(iri.startswith(space), F.concat(F.lit(f"{p}:"), F.substr(iri, F.lit(len(space) + 1)))).otherwise(out)
    return out


def read(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None, base: str = BASE) -> DataFrame:
    """The graph of N-Triples files; comments and empty lines are passed over. A language tag stays
    out, since graphs here have none."""
    # All terms of a line by one match, put end to end by what no line has.
    whole = r'^\s*<([^>]*)>\s*<([^>]*)>\s*(?:(<)([^>]*)>|"((?:[^"\\]++|\\.)*+)"(?:\^\^<([^>]*)>|@[A-Za-z0-9-]+)?)\s*\.[\s\S]*'
    rows = spark.read.text(path, lineSep="\n").where(F.col("value").rlike(r"^\s*<"))
    rows = rows.select("value", F.split(F.regexp_replace("value", whole, "$1\n$2\n$3\n$4\n$5\n$6"), "\n").alias("_t"))
    term = lambda k: F.coalesce(F.get("_t", F.lit(k)), F.lit(""))
    matched = F.size("_t") == 6
    is_iri = F.when(matched, term(2) == "<").otherwise(F.col("value").rlike(r"^\s*<[^>]*>\s*<[^>]*>\s*<"))
    rows = rows.select(F.when(matched, term(0)).otherwise("").alias("s"), *(term(k).alias(c) for k, c in ((1, "p"), (3, "_iri"), (4, "_text"), (5, "_type"))), is_iri.alias("_is_iri"))
    # Each step is a projection of its own, lest Spark work out a term wherever it is looked at.
    object_ = F.when(F.col("_is_iri"), F.col("_iri")).otherwise(F.col("_text"))
    rows = rows.select("s", "p", object_.alias("o"), "_type", "_is_iri")
    rows = rows.select(*(_plain(F.col(c)).alias(c) for c in ("s", "p", "o", "_type")), "_is_iri")
    short = lambda c: short_iri(F.col(c), prefixes, base)
    return rows.select(
        short("s").alias("s"), short("p").alias("p"), F.when(F.col("_is_iri"), short("o")).otherwise(F.col("o")).alias("o"),
        F.when(F.col("_is_iri"), "iri").otherwise("literal").alias("o_kind"), F.when(~F.col("_is_iri"), F.nullif(short("_type"), F.lit(""))).alias("o_datatype"),
    )
