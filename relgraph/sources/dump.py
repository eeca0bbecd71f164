"""SQL dump text: a catalog of its tables, and their COPY rows as DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.functions.terms import normal_text
from relgraph.sources import dump_text

_NAME = r'(?:"(?:[^"]|"")*"|[\w$]+)'
_QUALIFIED = rf"(?:{_NAME}\.)?{_NAME}"
#: SQL type → Spark type. Others are strings.
TYPES = {"integer": "int", "int": "int", "bigint": "bigint", "smallint": "smallint", "serial": "int", "bigserial": "bigint", "boolean": "boolean", "bool": "boolean", "real": "float", "float": "double", "double precision": "double", "double": "double", "numeric": "double", "decimal": "double", "date": "date", "timestamp": "timestamp_ntz"}


@dataclass
class Column:
    name: str
    sql_type: str
    nullable: bool = True
    default: str | None = None

    @property
    def spark_type(self) -> str:
        base = re.sub(r"\(.*", "", self.sql_type).strip().lower()
        return TYPES.get("timestamp" if base.startswith("timestamp") else base, "string")


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)
    key: list[str] = field(default_factory=list)
    #: (columns, parent table, parent columns)
    foreign: list[tuple[list[str], str, list[str]]] = field(default_factory=list)


def _plain(name: str) -> str:
    last = re.findall(_NAME, name)[-1]
    return last[1:-1].replace('""', '"') if last.startswith('"') else last.lower()


def _names(text: str) -> list[str]:
    return [_plain(x) for x in re.findall(_NAME, text)]


def split_top(text: str) -> list[str]:
    """Parts between commas outside of parentheses and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def without_data(text: str) -> str:
    text = re.sub(r"(?ms)^COPY [^;]*;\n.*?^\\\.$", "", text)
    return re.sub(r"--[^\n]*", "", re.sub(r"(?s)/\*.*?\*/", "", text))


def parse_ddl(text: str) -> dict[str, Table]:
    """Tables with inline and ALTER keys, single or composite."""
    text, tables = without_data(text), {}
    for m in re.finditer(rf"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_QUALIFIED})\s*\(", text):
        depth, end, quote = 1, m.end(), ""
        while depth and end < len(text):
            c = text[end]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            else:
                depth += {"(": 1, ")": -1}.get(c, 0)
            end += 1
        t = tables[_plain(m[1])] = Table(_plain(m[1]))
        for part in split_top(text[m.end() : end - 1]):
            if not _constraint(t, part):
                c = re.match(rf"({_NAME})\s+(.*)", part, re.S)
                name, rest = _plain(c[1]), c[2]
                kind = re.match(r"(?i)((?:double precision|character varying|timestamp(?:\s*\(\d+\))?(?:\s+with(?:out)? time zone)?|\w+)(?:\s*\([^)]*\))?)", rest)[1]
                default = re.search(r"(?i)\bDEFAULT\s+('(?:[^']|'')*'|\S+)", rest)
                t.columns.append(Column(name, kind, not re.search(r"(?i)NOT\s+NULL|PRIMARY\s+KEY", rest), default and default[1]))
                if re.search(r"(?i)PRIMARY\s+KEY", rest):
                    t.key.append(name)
                if r := re.search(rf"(?i)REFERENCES\s+({_QUALIFIED})\s*(?:\(([^)]*)\))?", rest):
                    t.foreign.append(([name], _plain(r[1]), _names(r[2] or "")))
    for m in re.finditer(rf"(?is)ALTER\s+TABLE\s+(?:ONLY\s+)?({_QUALIFIED})\s+ADD\s+([^;]*)", text):
        if (t := tables.get(_plain(m[1]))) is not None:
            _constraint(t, m[2].strip())
    for t in tables.values():
        t.foreign = [(c, p, x or list(tables[p].key) if p in tables else x) for c, p, x in t.foreign]
    return tables


def _constraint(t: Table, text: str) -> bool:
    text = re.sub(rf"(?i)^CONSTRAINT\s+{_NAME}\s+", "", text)
    if m := re.match(r"(?is)PRIMARY\s+KEY\s*\(([^)]*)\)", text):
        t.key = _names(m[1])
    elif m := re.match(rf"(?is)FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+({_QUALIFIED})\s*(?:\(([^)]*)\))?", text):
        t.foreign.append((_names(m[1]), _plain(m[2]), _names(m[3] or "")))
    else:
        return bool(re.match(r"(?i)(UNIQUE|CHECK|EXCLUDE)\b", text))
    return True


def catalog(spark: SparkSession, tables: dict[str, Table]) -> DataFrame:
    """The catalog as rows (table, column, is_pk, fk_table, fk_column)."""
    rows = []
    for t in tables.values():
        fk = {c: (p, x) for cs, p, xs in t.foreign for c, x in zip(cs, xs)}
        rows += [(t.name, c.name, c.name in t.key, *(fk.get(c.name) or (None, None))) for c in t.columns]
    return spark.createDataFrame(rows, "table string, column string, is_pk boolean, fk_table string, fk_column string")


def qualified(name: str) -> str:
    """``schema.table`` or ``table``, without quotes."""
    return ".".join(x[1:-1].replace('""', '"') if x.startswith('"') else x.lower() for x in re.findall(_NAME, name))


def search_path(text: str) -> list[str]:
    """The schemas that a dump names, in order: its search paths', then those of its tables;
    the system's and public are left out."""
    found = [x for m in re.finditer(r"(?im)^SET\s+search_path\s*(?:=|TO)\s*([^;]*)", text) for x in _names(m[1])]
    found += [q.partition(".")[0] for q in table_schemas(text).values() if "." in q]
    return [x for x in dict.fromkeys(found) if x not in ("pg_catalog", "public")]


def table_schemas(text: str) -> dict[str, str]:
    """table → schema.table, by the name it is made with or the search path before it."""
    out, path = {}, ""
    for m in re.finditer(rf"(?im)^SET\s+search_path\s*(?:=|TO)\s*([^;]*)|CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_QUALIFIED})", without_data(text)):
        if m[2] is None:
            path = next((x for x in _names(m[1]) if x != "pg_catalog"), "")
        else:
            q = qualified(m[2])
            out[_plain(m[2])] = q if "." in q or not path else f"{path}.{q}"
    return out


def copy_rows(spark: SparkSession, path: str, tables: dict[str, Table], pieces: DataFrame | None = None) -> dict[str, DataFrame]:
    """The COPY blocks of a dump as typed DataFrames, by table, or by schema.table where two
    schemas have the name. ``pieces`` are the dump's, where they are known."""
    return _tables_of((pieces or dump_text.pieces(spark, path)).where("kind = 'copy'"), tables)


def insert_rows(spark: SparkSession, path: str, tables: dict[str, Table], pieces: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows of ``INSERT INTO t [(columns)] VALUES (...), (...);`` statements over any number of
    lines, as copy_rows."""
    return _tables_of((pieces or dump_text.pieces(spark, path)).where("kind = 'tuple'"), tables)


def loaded(spark: SparkSession, path: str, tables: dict[str, Table], out: str, pieces: DataFrame | None = None) -> dict[str, DataFrame]:
    """All rows of a dump, COPY's and INSERT's, as typed DataFrames, by one scan that writes them
    to ``out`` by schema and table; a table then reads only its own files."""
    found = (pieces or dump_text.pieces(spark, path)).where("kind <> 'statement'").select("kind", "columns", "value", "cells", F.col("schema").alias("_schema"), F.col("table").alias("_table"))
    found.write.partitionBy("_schema", "_table").option("compression", "zstd").parquet(out)
    kept = spark.read.schema(found.schema).parquet(out)
    return _tables_of(kept.withColumns({"schema": F.coalesce("_schema", F.lit("")), "table": F.col("_table")}).drop("_schema", "_table"), tables)


def _tables_of(pieces: DataFrame, tables: dict[str, Table]) -> dict[str, DataFrame]:
    owners = sorted(map(tuple, pieces.select("table", "schema").distinct().where(F.col("table").isin([t.name for t in tables.values()])).collect()))
    out = {}
    for name, schema in owners:
        t = next(t for t in tables.values() if t.name == name)
        key = name if name not in out else f"{schema}.{name}"
        out[key] = table_rows(pieces.where((F.col("table") == name) & (F.col("schema") == schema)), t)
    return out | {t.name: table_rows(pieces.where(F.lit(False)), t) for t in tables.values() if t.name not in out}


def table_rows(pieces: DataFrame, table: Table) -> DataFrame:
    """One table's ``pieces`` as its typed columns; a column that a header leaves out is null."""
    cells = F.split("value", "\t", -1)
    # A line is split once, and only lines with a backslash have nulls and escapes.
    copied = F.when(F.contains("value", F.lit("\\")), F.transform(cells, lambda x: unescaped(F.when(x != "\\N", x)))).otherwise(cells)
    rows = pieces.select("columns", F.when(F.col("kind") == "copy", copied).otherwise(F.col("cells")).alias("cells"))
    columns = []
    for k, c in enumerate(table.columns):
        at = F.when(F.size("columns") == 0, F.lit(k)).otherwise(F.nullif(F.array_position("columns", c.name), F.lit(0)).cast("int") - 1)
        text = F.get("cells", at)
        columns.append((text if c.spark_type == "string" else text.try_cast(c.spark_type)).alias(c.name))
    return rows.select(*columns)


#: What a backslash and a letter stand for in COPY text. Fixed values.
_ESCAPED = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def unescaped(cell):
    """COPY text as it was, in one pass: pieces are a backslash with what it escapes, or text."""
    pieces = F.regexp_extract_all(cell, F.lit(r"(?s)(\\[0-7]{1,3}|\\x[0-9A-Fa-f]{1,2}|\\.|[^\\]+|\\$)"), F.lit(1))

    def plain(x):
        code = F.substring(x, 2, 3)
        out = F.when(F.length(x) == 2, code).otherwise(x)
        for letter, char in _ESCAPED.items():
            out = F.when(x == f"\\{letter}", char).otherwise(out)
        out = F.when(x.rlike(r"^\\[0-7]"), F.char(F.conv(code, 8, 10).cast("int"))).otherwise(out)
        out = F.when(x.rlike(r"^\\x."), F.char(F.conv(F.substring(x, 3, 2), 16, 10).cast("int"))).otherwise(out)
        return F.when(F.startswith(x, F.lit("\\")), out).otherwise(x)

    return F.when(F.contains(cell, F.lit("\\")), F.array_join(F.transform(pieces, plain), "")).otherwise(cell)


def write_dump(spark: SparkSession, tables: dict[str, DataFrame], path: str, inserts: frozenset[str] = frozenset()) -> None:
    """``tables`` (by name, or schema.name) as dump text: a CREATE TABLE and a COPY block each, or
    INSERT statements for the names in ``inserts``. Rows are written as they lie, without a shuffle,
    to folders of which the names give the order: those of a table, its head, rows and tail."""
    parts, ends = [], []
    for k, (name, df) in enumerate(tables.items()):
        names = ", ".join(f'"{c}"' for c in df.columns)
        kinds = {"int": "integer", "bigint": "bigint", "smallint": "smallint", "double": "double precision", "float": "real", "boolean": "boolean", "date": "date", "timestamp": "timestamp without time zone", "timestamp_ntz": "timestamp without time zone"}
        columns = ",\n".join(f'    "{c}" {kinds.get(t, "text")}' for c, t in df.dtypes)
        head, tail = f"CREATE TABLE {name} (\n{columns}\n);\n", ""
        if name in inserts:
            rows = F.concat(F.lit(f"INSERT INTO {name} ({names}) VALUES\n    ("), F.array_join(F.array(*(_inserted(F.col(f"`{c}`"), t) for c, t in df.dtypes)), ", "), F.lit(");"))
        else:
            head, tail = f"{head}\nCOPY {name} ({names}) FROM stdin;", "\\.\n"
            rows = F.array_join(F.array(*(_copied(F.col(f"`{c}`")) for c in df.columns)), "\t")
        parts.append((f"table={k:05}/phase=1", df.select(rows.alias("value"))))
        ends += [(f"{k:05}", phase, text) for phase, text in ((0, head), (2, tail)) if text]
    spark.createDataFrame(ends, "table string, phase int, value string").coalesce(1).write.partitionBy("table", "phase").text(path)
    for folder, df in parts:
        df.write.text(f"{path}/{folder}")


def _copied(x):
    text = x.cast("string")
    for char, mark in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(char), F.lit(mark))
    return F.coalesce(text, F.lit("\\N"))


def _inserted(x, kind: str):
    text = x.cast("string")
    if kind not in ("int", "bigint", "smallint", "double", "float", "boolean"):
        text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def sample_rows(rows: dict[str, DataFrame], n: int = 5) -> dict[str, DataFrame]:
    """The first ``n`` rows of each table."""
    return {t: df.limit(n) for t, df in rows.items()}


def enriched(text: str, keys: list[tuple[str, str, str | None, str | None]]) -> str:
    """A dump with the constraints (table, column, parent, parent_column; no parent: a primary
    key) in front of its first ALTER TABLE, or at its end."""
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    lines = [f"ALTER TABLE ONLY {quote(t)} ADD " + (f"PRIMARY KEY ({quote(c)});" if p is None else f"FOREIGN KEY ({quote(c)}) REFERENCES {quote(p)} ({quote(x)});") for t, c, p, x in keys]
    m = re.search(r"(?im)^ALTER TABLE\b", text)
    at = m.start() if m else len(text)
    return text[:at] + "\n".join(lines) + ("\n" if lines else "") + text[at:]


def split_by_schema(spark: SparkSession, path: str, out: str) -> None:
    """A dump's lines written to ``schema=...`` folders: a statement or a COPY block goes to the
    schema that it names, or that the last search path set; others to ``schema=``."""
    dump_text.lines(spark, path).select("value", "schema").write.partitionBy("schema").text(out)


def normalized_lines(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, line, schema, value): a dump's lines with quoted identifiers as normal names and other
    code in lower case; strings, comments and the lines of COPY blocks stay as they are."""
    return dump_text.lines(spark, path, normal_text)


def read_qpair(text: str) -> dict[str, object]:
    """A query pair: properties, with lines joined at ``\\n\\`` ends."""
    joined = re.sub(r"\\n\\\n\s*", "\n", re.sub(r"(?m)^[#!].*\n", "", text))
    joined = re.sub(r"\\\n\s*", " ", joined)
    pair: dict = {}
    key = None
    for line in joined.split("\n"):
        if m := re.match(r"(name|orderNum|sql|sparql|categories|disabled)\s*=\s*(.*)", line):
            key = m[1]
            pair[key] = m[2]
        elif key:
            pair[key] += "\n" + line
    pair = {k: v.replace("\\:", ":").replace("\\=", "=").strip() for k, v in pair.items()}
    pair["categories"] = [c.strip() for c in pair.get("categories", "").split(",") if c.strip()]
    pair["disabled"] = str(pair.get("disabled", "")).lower() == "true"
    return pair
