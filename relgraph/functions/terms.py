"""RDF terms and identifier names as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "rdf:type"
#: SQL type name → XSD type. Fixed values of the R2RML natural mapping.
XSD = {"tinyint": "xsd:integer", "smallint": "xsd:integer", "int": "xsd:integer", "bigint": "xsd:integer", "boolean": "xsd:boolean", "float": "xsd:double", "double": "xsd:double", "date": "xsd:date", "timestamp": "xsd:dateTime", "timestamp_ntz": "xsd:dateTime"}
#: Types that are written as plain literals.
PLAIN = {"xsd:string", "xsd:date", "xsd:dateTime", "xsd:time"}
#: Key words of PostgreSQL's documentation that are reserved, two of them (authorization, binary)
#: only as names of functions and types. Fixed values.
RESERVED = set(
    """
    all analyse analyze and any array as asc asymmetric authorization binary both case cast check
    collate column constraint create current_catalog current_date current_role current_time
    current_timestamp current_user default deferrable desc distinct do else end except false fetch
    for foreign from grant group having in initially intersect into lateral leading limit localtime
    localtimestamp not null offset on only or order placing primary references returning select
    session_user some symmetric table then to trailing true union unique user using variadic when
    where window with
    """.split()
)


def iri_safe(value: Column) -> Column:
    """Percent-encode all ASCII characters but the unreserved ones; others stay. url_encode
    does the work for single characters; what it does differently is put right."""
    text = value.cast("string")
    unsafe = text.rlike(r"[\x00-\x7F&&[^A-Za-z0-9._~-]]")
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]|[A-Za-z0-9._~-]"), c).when(c == "", c).otherwise(F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))))
    return F.when(unsafe, F.array_join(each, "")).otherwise(text)


def template(pattern: str) -> Column:
    """``base#t/{a}/{b}`` over columns; null if any placeholder is."""
    parts = re.split(r"\{([^}]*)\}", pattern)
    return F.concat(*(iri_safe(F.col(f"`{p}`")) if k % 2 else F.lit(p) for k, p in enumerate(parts) if p))


def placeholders(pattern: str) -> list[str]:
    return re.findall(r"\{([^}]*)\}", pattern)


def datatype(spark_type: str) -> str:
    return "xsd:double" if spark_type.startswith("decimal") else XSD.get(spark_type, "xsd:string")


def normal_identifier(name: Column) -> Column:
    """Lower case, runs of characters other than letters, digits, _ and $ to one underscore,
    none at the ends; an underscore in front of what begins otherwise or is empty, and one
    behind a reserved word."""
    x = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_$]+", "_"), "_+", "_"), F.lit("_"))
    x = F.when(x.rlike("^[a-z_]"), x).otherwise(F.concat(F.lit("_"), x))
    return F.when(x.isin(sorted(RESERVED)), F.concat(x, F.lit("_"))).otherwise(x)


def normal_text(name: str) -> str:
    """normal_identifier of a single name, for text that is rewritten piece by piece."""
    x = re.sub("_+", "_", re.sub("[^a-z0-9_$]+", "_", name.lower())).strip("_")
    x = x if re.match("[a-z_]", x) else "_" + x
    return x + "_" if x in RESERVED else x


def camel_case(name: Column) -> Column:
    """``paper_title`` to ``paperTitle``: the first part as it is, others capitalised."""
    return F.array_join(F.transform(F.split(name, "_"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20))))), "")


def loose_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[_-]", "")


def canonical_name(name: Column) -> Column:
    """As loose_name, in the singular."""
    return F.regexp_replace(loose_name(name), "s+$", "")


#: Words that only connect others in a name. Fixed values.
CONNECTING = ("of", "the", "for", "in", "on", "by")


def content_name(name: Column) -> Column:
    """As loose_name, without connecting words."""
    words = F.regexp_replace(F.lower(name), "[_-]", " ")
    return F.replace(F.regexp_replace(words, rf"\b({'|'.join(CONNECTING)})\b", ""), F.lit(" "), F.lit(""))


def without_prefix(name: Column) -> Column:
    """A property's name without ``has_a_`` and its like, if anything is left."""
    return F.regexp_replace(name, "(?i)^(has|is)_((an|a|the)_)?(?=.)", "")


def bare_property(name: Column) -> Column:
    """A loose name without a verb and its article in front, be they words of snake or camel case,
    if anything is left."""
    words = F.lower(F.regexp_replace(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_"), "-", "_"))
    return loose_name(F.regexp_replace(words, "^(has|have|is|was)_(an|a|the)_(?=.)", ""))


def local_name(iri: Column) -> Column:
    return F.regexp_extract(iri, r"([^#/:]*)$", 1)


def filter_value(value: Column) -> Column:
    """Without double quotes, white space as single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(F.replace(value.cast("string"), F.lit('"'), F.lit("")), r"\s+", " "))


def sql_literal(value: Column, sql_type: Column) -> Column:
    """A value as SQL of its column's type: booleans, numbers, quoted strings, NULL."""
    clean = filter_value(value)
    base = F.btrim(F.regexp_replace(F.lower(sql_type), r"\(.*", ""))
    number = base.isin("integer", "int", "smallint", "bigint", "tinyint", "real", "float", "double", "numeric", "decimal")
    truth = F.when(F.lower(clean).isin("1", "true", "t", "yes"), "true").otherwise("false")
    text = F.concat(F.lit("'"), F.replace(clean, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(value.isNull(), "NULL").when(base.isin("boolean", "bool"), truth).when(number, clean).otherwise(text)


def sql_name(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def query_label(qid: Column, label: Column) -> Column:
    """``Q7 (text)``: the query's number, and the label's text once, however often it is wrapped in
    number and parentheses already."""
    number = F.coalesce(F.nullif(F.regexp_extract(qid, r"(?i)^Q\d+", 0), F.lit("")), qid)
    wraps = F.regexp_extract(F.btrim(label), r"^((?:[qQ]\d+\s*\(\s*)*)", 1)
    text = F.substr(F.btrim(label), F.length(wraps) + 1)
    depth = F.regexp_count(wraps, F.lit(r"\("))
    closed = F.regexp_extract(text, r"([\s)]*)$", 1)
    bare = F.btrim(F.substr(text, F.lit(1), F.length(text) - F.length(closed)))
    keep = F.greatest(F.regexp_count(closed, F.lit(r"\)")) - depth, F.lit(0))
    bare = F.concat(bare, F.repeat(F.lit(")"), keep))
    own = F.coalesce(F.nullif(F.regexp_extract(F.btrim(label), r"(?i)^Q\d+(?=\s*(\(|$))", 0), F.lit("")), number)
    empty = bare.isNull() | (bare == "") | bare.rlike(r"(?i)^Q\d+$")
    return F.when(empty, F.when(label.isNull() | (F.btrim(label) == ""), number).otherwise(own)).otherwise(F.concat(own, F.lit(" ("), bare, F.lit(")")))


def natural_key(text: Column) -> Column:
    """A sort key in which runs of digits count as numbers."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.struct(F.lit(0).alias("kind"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 40, "0").alias("text"))).otherwise(F.struct(F.lit(1).alias("kind"), x.alias("text"))))
