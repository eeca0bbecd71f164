"""Dump text in chunks against a sequential reader of single characters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from relgraph.functions.terms import normal_identifier, normal_text
from relgraph.sources import dump, dump_text as D

PARTS = [
    "INSERT INTO t (id, v) VALUES\n(1, 'a;b'),\n(2, 'it''s\nover (two) lines; --no'),\n(3, NULL);\n",
    "INSERT INTO \"T x\" VALUES (4, E'q\\'\n;x'), (5, $$a\n'b'$$);\n",
    "COPY one.t (id, v) FROM stdin;\nset of cups\t'\nINSERT INTO t VALUES (9);\n-- \"A b\"\n/*\n$$\n\\.\n",
    "COPY t (\n  id,\n  v\n) FROM stdin;\n7\tx\n\\.\n",
    "-- a comment; with 'quotes\nSELECT \"A b\", 'C \"d\"\ne' FROM X;\n",
    "/* a /* nested\n' ; */ still\n*/ CREATE FUNCTION F() AS $body$ begin; 'x\n $$ ; end $body$;\n",
    "SET search_path = two, pg_catalog;\n",
    "SELECT pg_catalog.set_config('search_path', '', false);\n",
    "\\connect Other 'db\n",
    "CREATE TABLE two.t (\n id integer,\n \"a;b\"\"c\" text DEFAULT 'x'\n);\n\n",
    "\n",
]


def sequential(text):
    """Of each character: code, name or kept; and the statements' ends. Character by character."""
    kind, ends, i, depth = ["code"] * len(text), [], 0, 0
    begin = 0

    def upto(j, k):
        nonlocal i
        kind[i:j] = [k] * (j - i)
        i = j

    while i < len(text):
        c, blank = text[i], not re.sub(r"(?s)--[^\n]*|/\*.*\*/|\s", "", text[begin:i])
        if text.startswith("--", i) or blank and c == "\\":
            upto(text.index("\n", i), "kept")
            if c == "\\":
                begin = i
        elif text.startswith("/*", i):
            j, depth = i + 2, 1
            while depth:
                depth += {"/*": 1, "*/": -1}.get(text[j : j + 2], 0)
                j += 2 if text[j : j + 2] in ("/*", "*/") else 1
            upto(j, "kept")
        elif c == "'":
            escapes, j = text[i - 1 : i] in ("E", "e"), i + 1
            while text[j] != "'" or text[j + 1] == "'":
                j += 2 if text[j] == "'" or escapes and text[j] == "\\" else 1
            upto(j + 1, "kept")
        elif c == '"':
            j = i + 1
            while text[j] != '"' or text[j + 1] == '"':
                j += 2 if text[j] == '"' else 1
            upto(j + 1, "name")
        elif c == "$" and (m := re.match(r"\$\w*\$", text[i:])):
            upto(text.index(m[0], i + len(m[0])) + len(m[0]), "kept")
        elif c == ";":
            i += 1
            ends.append(i)
            statement = re.sub(r"(?s)^(\s|--[^\n]*\n|/\*.*?\*/)*", "", text[begin:i])
            if re.match(r"(?i)copy\b", statement) and "stdin" in statement:
                i = text.index("\n", i) + 1
                upto(text.index("\n\\.\n", i - 1) + 4, "kept")
            begin = i
        else:
            i += 1
    return kind, ends


def dumps(n=40, seed=8):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choices(PARTS, k=rng.randint(1, 12)))


def in_chunks(text, rng):
    lines, out = text.splitlines(keepends=True), []
    while lines:
        k = rng.randint(1, 4)
        out.append("".join(lines[:k]))
        lines = lines[k:]
    return out


def test_machine_equals_sequential_reader():
    for text in dumps():
        kind, ends = sequential(text)
        found, state = D.events(text, D.START, spans=True)
        assert [b for k, _, b in found if k == "end"] == ends
        spans = ["code"] * len(text)
        for k, a, b in found:
            if k in ("kept", "data", "name"):
                spans[a:b] = ["name" if k == "name" else "kept"] * (b - a)
        assert spans == kind and state == D.START


def test_composed_maps_give_each_chunk_its_state():
    rng = random.Random(9)
    for text in dumps():
        chunks, e, at = in_chunks(text, rng), D.Entry(), 0
        rows, parts = [], {}
        for k, chunk in enumerate(chunks):
            before = D.events(text[:at], D.START)[1] if at else D.START
            assert e.state == before
            for r in D.pieces_of(chunk, k, e):
                own = (r["kind"], *map(str, r["owner"]))
                if r["cut"] is None:
                    rows += [(*own, x) for x in (chunk[r["lo"] : r["hi"]].split("\n")[:-1] if r["kind"] == "copy" else [chunk[r["lo"] : r["hi"]]])]
                else:
                    parts.setdefault((r["cut"], *own), []).append((chunk[r["lo"] : r["hi"]], r["over"]))
            seen = {}
            e = D.after(e, k, chunk[: D.HEAD], {s: D.passage(chunk, *D.events(chunk, s, seen)) for s in D.entered(chunk)})
            at += len(chunk)
        rows += [(*own, "".join(x for x, _ in p)) for (_, *own), p in parts.items() if p[-1][1]]
        whole = [((r["kind"], *map(str, r["owner"])), text[r["lo"] : r["hi"]]) for r in D.pieces_of(text, 0, D.Entry())]
        want = [(*o, x) for o, v in whole for x in (v.split("\n")[:-1] if o[0] == "copy" else [v])]
        strip = lambda rs: sorted((*r[:-1], r[-1].strip()) for r in rs)
        assert strip(rows) == strip(want)


def test_merged_runs_equal_single_ones():
    for text in dumps(10):
        seen = {}
        for s in D.entered(text):
            assert D.events(text, s, seen) == D.events(text, s)


def test_tuples():
    assert D.cells_of(" 1, 'it''s, (x)', NULL, -2.5, 'a'::character varying(3), now(), E'q\\'\\n', true, '' ") == ["1", "it's, (x)", None, "-2.5", "a", "now()", "q'\n", "true", ""]


@pytest.fixture(scope="module")
def tiny(spark):
    """Blocks of a few lines."""
    keys = {"spark.sql.files.maxPartitionBytes": "120", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "8"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_dump_over_blocks_and_files(tiny, tmp_path):
    text = "".join(PARTS * 2)
    (tmp_path / "d").mkdir()
    lines = text.splitlines(keepends=True)
    for k in range(0, len(lines), 25):  # files end anywhere
        (tmp_path / "d" / f"p{k:04}.sql").write_text("".join(lines[k : k + 25]))
    path = str(tmp_path / "d")
    found = D.pieces(tiny, path).collect()
    assert len({r.chunk for r in found}) > 8
    got = sorted((r.kind, r.schema, r.table, tuple(r.columns), r.value.strip()) for r in found)
    want = []
    for r in D.pieces_of(text, 0, D.Entry()):
        value = text[r["lo"] : r["hi"]]
        want += [(r["kind"], *r["owner"][:2], tuple(r["owner"][2]), x.strip()) for x in (value.split("\n")[:-1] if r["kind"] == "copy" else [value])]
    assert got == sorted(want)
    tables = {"t": dump.Table("t", [dump.Column("id", "integer"), dump.Column("v", "text")])}
    rows = dump.insert_rows(tiny, path, tables)
    assert sorted((r.id, r.v) for x in rows.values() for r in x.collect() if r.id == 2) == [(2, "it's\nover (two) lines; --no")] * 2
    all_rows = dump.loaded(tiny, path, tables, str(tmp_path / "out"))
    copied = [r.v for x in all_rows.values() for r in x.collect() if r.id is None]
    assert copied.count("'") == 2  # "set of cups" is no number, its row is data
    changed = D.lines(tiny, path, normal_text).orderBy("chunk", "line").collect()
    kind, _ = sequential(text)
    want, i = "", 0
    while i < len(text):
        j = i
        while j < len(text) and kind[j] == kind[i]:
            j += 1
        want += {"code": text[i:j].lower(), "kept": text[i:j], "name": normal_text(text[i + 1 : j - 1].replace('""', '"'))}[kind[i]]
        i = j
    assert [r.value for r in changed] == want.split("\n")[:-1]


def test_lines_by_schema(tiny, tmp_path):
    text = "SET search_path = b;\nCREATE TABLE x (i integer);\nCOPY a.t (v) FROM stdin;\nset of cups\nCREATE TABLE c.d\nSET search_path = z;\n\\.\nSELECT 1;\nALTER TABLE ONLY c.t\n ADD x;\n" + "COPY a.t FROM stdin;\n" + "row\n" * 60 + "\\.\n-- end\n"
    (tmp_path / "d.sql").write_text(text)
    dump.split_by_schema(tiny, str(tmp_path / "d.sql"), str(tmp_path / "out"))
    got = tiny.read.text(str(tmp_path / "out")).groupBy("schema").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()
    by = {r.schema: r.v for r in got}
    assert sorted(by["a"]) == sorted(["COPY a.t (v) FROM stdin;", "set of cups", "CREATE TABLE c.d", "SET search_path = z;", "\\.", "COPY a.t FROM stdin;", *["row"] * 60, "\\."])
    assert sorted(by["c"]) == [" ADD x;", "ALTER TABLE ONLY c.t"] and sorted(by["b"]) == ["-- end", "CREATE TABLE x (i integer);", "SELECT 1;", "SET search_path = b;"]


def test_empty_dump_and_deep_comments(spark, tmp_path):
    (tmp_path / "d.sql").write_text("")
    assert D.pieces(spark, str(tmp_path / "d.sql")).collect() == []
    deep = D.Entry(("comment", D.OTHER, D.NESTED + 1))
    with pytest.raises(ValueError):
        D.after(deep, 0, "", {})


def test_names_of_text_and_column_agree(spark):
    names = ["A b", "select", "9x", "", "__", "Ünï", "a$b", "x--y", "WHERE "]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(normal_identifier(F.col("n")).alias("x"))
    assert [r.x for r in got.collect()] == list(map(normal_text, names))


def test_a_block_is_held_in_parts(spark, tmp_path):
    import pyarrow as pa

    lines = [f"{k}\t{'x' * (k % 300)}" for k in range(20_000)] + ["y" * (2 * D.CHUNK), "z"]
    batches = [pa.RecordBatch.from_pydict({"file": ["f"] * len(x), "start": [0] * len(x), "value": x}) for x in (lines[:7_000], [], lines[7_000:])]
    got = list(D._chunks(iter(batches)))
    assert "".join(g[3] for g in got) == "\n".join(lines) + "\n"
    assert [g[:3] for g in got] == [("f", 0, k) for k in range(len(got))]
    assert len(got) > 3 and sorted(len(g[3]) for g in got)[-2] <= D.CHUNK + 320
    path = str(tmp_path / "d")
    df = spark.range(9_000).select("id", F.repeat(F.lit("it's; (one)\n"), 10).alias("v")).coalesce(1)
    dump.write_dump(spark, {"a.t": df, "a.u": df}, path, frozenset({"a.u"}))
    pieces = D.pieces(spark, path)
    assert pieces.select("chunk").distinct().count() > 2
    tables = dump.parse_ddl("CREATE TABLE a.t (id bigint, v text); CREATE TABLE a.u (id bigint, v text);")
    for rows in (dump.copy_rows(spark, path, tables, pieces)["t"], dump.insert_rows(spark, path, tables, pieces)["u"]):
        assert rows.exceptAll(df).count() == 0 and rows.count() == 9_000
