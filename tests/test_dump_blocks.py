"""Blocks of COPY data are rows as they lie; what a dump's scans are made of."""

import pytest
from pyspark.sql import functions as F

from relgraph.sources import dump, dump_text as D


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.fixture
def small(spark):
    """Blocks of 2 KB."""
    keys = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_copy_blocks_are_read_as_they_lie(small, tmp_path, capsys):
    rows = "".join(f"{k}\tit's; (a) \"b\" $$ /* -- stdin {k}\\\\\\t\\n\\101{'' if k % 3 else chr(13)}\n" if k % 7 else f"{k}\t\\N\n" for k in range(400))
    text = f"CREATE TABLE a.t (\n id bigint,\n v text\n);\nCOPY a.t (id, v) FROM stdin;\n{rows}\\.\nINSERT INTO a.t VALUES (1, 'x\ny');\nSET search_path = b;\nCOPY t (v, id) FROM stdin;\nz\t5\n{'w' * 5000}\t6\n\\.\nSELECT 1;\n"
    path = str(tmp_path / "d.sql")
    (tmp_path / "d.sql").write_bytes(text.encode())
    whole = [data for _, _, data in D.entries(small, path).values()]
    assert whole.count(True) > 5 and whole.count(False) >= 2
    pieces = D.pieces(small, path)
    want = []
    for r in D.pieces_of(text, 0, D.Entry()):
        value = text[r["lo"] : r["hi"]]
        want += [(r["kind"], *r["owner"][:2], tuple(r["owner"][2]), x) for x in (value.replace("\r\n", "\n").split("\n")[:-1] if r["kind"] == "copy" else [value])]
    ordered = pieces.orderBy("chunk", "ix").collect()
    assert sorted((r.kind, r.schema, r.table, tuple(r.columns), r.value) for r in ordered) == sorted(want)
    lines = [r.value for r in ordered if r.kind == "copy" and r.schema == "a"]
    assert lines == rows.replace("\r\n", "\n").split("\n")[:-1]
    assert "FileScan text" in plan(pieces, capsys) and "FileScan text" not in plan(pieces.where("kind = 'statement'"), capsys)
    tables = dump.parse_ddl("CREATE TABLE t (id bigint, v text);")
    got = dump.copy_rows(small, path, tables, pieces)
    assert sorted(map(tuple, got["b.t"].collect())) == [(5, "z"), (6, "w" * 5000)]
    values = {r.id: r.v for r in got["t"].collect()}
    assert len(values) == 400 and values[7] is None and values[8] == "it's; (a) \"b\" $$ /* -- stdin 8\\\t\nA"


def test_a_line_is_split_once(spark, capsys):
    table = dump.Table("t", [dump.Column(f"c{k}", "bigint" if k % 2 else "text") for k in range(8)])
    rows = spark.range(1).select(F.lit("copy").alias("kind"), F.array().cast("array<string>").alias("columns"), F.concat_ws("\t", *[F.col("id") + k for k in range(8)]).alias("value"), F.lit(None).cast("array<string>").alias("cells"))
    made = dump.table_rows(rows, table)
    assert list(made.first()) == [k if k % 2 else str(k) for k in range(8)]
    assert plan(dump.table_rows(rows.localCheckpoint(), table), capsys).count("split(") <= 2


def test_a_dump_is_written_without_a_shuffle(spark, tmp_path):
    tables = {f"s.t{k}": spark.range(k * 10, k * 10 + 5, 1, 2).select("id", F.lit("a\tb\n").alias("v")) for k in range(12)}
    path = str(tmp_path / "d")
    dump.write_dump(spark, tables, path, frozenset({"s.t3"}))
    files = spark.read.text(path).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert len({r.f.rpartition("/")[0] for r in files}) == 12 * 3 - 1
    known = dump.parse_ddl("\n".join(r.value for r in D.pieces(spark, path).where("kind = 'statement'").collect()))
    got = dump.copy_rows(spark, path, known) | {"t3": dump.insert_rows(spark, path, known)["t3"]}
    assert {n: sorted(map(tuple, df.collect())) for n, df in got.items()} == {n[2:]: sorted(map(tuple, df.collect())) for n, df in tables.items()}


def test_stdin_in_any_case_and_only_as_a_word():
    for text in ("COPY t FROM STDIN;\n1\n", "copy stdinx (stdin_) from Stdin;\n1\n", "COPY xstdin FROM 'stdin';\n1\n", "COPY t\nFROM 'é' ſtdIn;\n1\n"):
        seen = {}
        for s in D.entered(text):
            assert D.events(text, s, seen) == D.events(text, s)
    assert [D.events(f"COPY {x};\n1\n", D.START)[1][0] for x in ("t FROM STDIN", "stdinx FROM f", "x$stdin FROM f", "t FROM ſtdin", "éstdin")] == ["data", "code", "data", "data", "code"]


def test_loaded_writes_what_tables_are_made_of(spark, tmp_path):
    rows = spark.range(50).select("id", F.concat(F.lit("a\\\n'"), "id").alias("v"))
    path, out = str(tmp_path / "d"), str(tmp_path / "out")
    dump.write_dump(spark, {"s.t": rows, "u": rows}, path, frozenset({"u"}))
    tables = dump.parse_ddl("CREATE TABLE t (id bigint, v text); CREATE TABLE u (id bigint, v text);")
    got = dump.loaded(spark, path, tables, out)
    assert sorted(spark.read.parquet(out).columns) == ["_schema", "_table", "cells", "columns", "kind", "value"]
    assert all(sorted(map(tuple, got[t].collect())) == sorted(map(tuple, rows.collect())) for t in ("t", "u"))
