"""SQL dump text of any size, read where it lies: rows, statements, names and schemas.

What a line of a dump means depends on all that comes before it: a string, a comment or a COPY
block may have begun long ago. So the text is read twice, by Spark's text source, whose file
blocks are dealt into the chunks:

1. Each chunk says, for each state that it could be entered in, in which it is left (a map of a
   finite-state machine). Runs from different states soon meet and go on as one.
2. The maps are composed in the order of files and blocks, a few bytes a chunk, which gives each
   chunk the state it is really entered in; chunks of more than COPY data then give its texts.
3. With that, chunks are read independently: one scan gives the rows of all tables. What a chunk's
   end cuts in two is put together by a small aggregate. Blocks that hold nothing but lines of one
   COPY block are rows as they lie, without Python.

States: code, string, string with escapes, quoted name, block comment (nested), dollar quote, COPY
data; and how the open statement begins. Dollar tags that a chunk does not hold leave it as it is
entered. A directory is one dump, its files in the order of their names.

Defined cases: an empty dump has no rows; what is open at its end (a string, a statement without
semicolon) is dropped; a block comment nested deeper than ``NESTED`` at a chunk's end raises a
ValueError. A task holds one chunk at a time, ``CHUNK`` characters or one longer line, whatever the
size of its file blocks.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.shared import stored

#: How an open statement begins: nothing yet, COPY, COPY ... stdin, anything else.
NOTHING, COPY, STDIN, OTHER = "", "copy", "stdin", "other"
NESTED = 4
#: Characters of an open statement that go with the state from chunk to chunk.
HEAD = 1 << 16
#: Characters of a chunk, after which the next line begins another; rows of a batch.
CHUNK, ROWS = 1 << 20, 10_000
#: Tasks of a scan, or eight a core, where file blocks are more.
TASKS = 200

State = tuple[str, str, "str | int"]
START: State = ("code", NOTHING, "")

#: Alternatives that all begin with a literal, which lets the search skip other characters fast.
_TOKEN = r"""--[^\n]*|/\*|'|"|\(|\)|;|\$(?<![\w$]\$)(?:[A-Za-z_]\w*)?\$"""
_CODE = re.compile(_TOKEN)
#: The word stdin in any case, letters as re.I takes them, beginning with a set that the search skips to.
_STDIN = re.compile(r"[sS\u017f](?<!\w[sS\u017f])[tT][dD][iI\u0130\u0131][nN]\b")
_FIRST = re.compile(r"\s*(--[^\n]*|/\*|\\[^\n]*|copy\b|;|\S)", re.I)
_MARK = re.compile(r"\\\.\r?\n")
_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*"')
_ESCAPED = re.compile(r"(?s)[^'\\]*(?:(?:\\.|'')[^'\\]*)*'")


def events(text: str, state: State, seen: dict | None = None, spans: bool = False) -> tuple[list, State]:
    """What the machine meets in ``text``, whole lines, entered in ``state``: (kind, from, to) with
    kind begin and end (of a statement), open, close, data or some data (without its end); and the
    state it ends in. With
    ``spans`` also name, and kept for strings, comments and the like. ``seen`` lets a run that comes
    to a place and state of an earlier one go on as that did."""
    lex, begun, extra = state
    at, since, out, size, marks, rest = 0, -1, [], len(text), [], None
    while at < size:
        if seen is not None:
            if (rest := seen.get((at, lex, begun, extra))) is not None:
                break
            marks.append((at, lex, begun, extra, len(out)))
        if lex == "data":
            end = _data_end(text, at)
            out.append(("data" if end > 0 else "some data", at, end if end > 0 else size))
            at, lex = (end, "code") if end > 0 else (size, lex)
        elif lex == "code":
            m = _token(text, at, begun, {} if seen is None else seen)
            if not m:
                break
            token, start, at = m
            since = start
            if token == "/*":
                lex, extra = "comment", 1
            elif token[:2] == "--" or not begun and token[0] == "\\":
                if spans:
                    out.append(("kept", start, at))
            elif token == ";":
                out.append(("end", start, at))
                if begun == STDIN:
                    lex, at = "data", text.find("\n", at) + 1
                begun = NOTHING
            elif not begun:
                out.append(("begin", start, start))
                begun, at = (COPY, at) if token == "copy" else (OTHER, start)
            elif token in "()":
                out.append(("open" if token == "(" else "close", start, at))
            elif token == "'":
                lex = "escaped" if re.search(r"(?<![\w$])[eE]$", text[max(0, start - 2) : start]) else "string"
            elif token == '"':
                lex = "name"
            elif token[0] == "$":
                lex, extra = "dollar", text[start:at]
            else:
                begun = STDIN
        else:
            key = ("left", at, lex, extra)
            end, left = seen[key] if seen is not None and key in seen else _left(text, at, lex, extra)
            if seen is not None:
                seen[key] = end, left
            if end < 0:
                extra = left
                break
            if spans:
                out.append(("name" if lex == "name" and since >= 0 else "kept", max(since, 0), end))
            lex, extra, at = "code", "", end
    else:
        since = size
    if spans and lex not in ("code", "data") and since < size:
        out.append(("kept", max(since, 0), size))
    final = (lex, begun, extra)
    if rest is not None:
        (others, final), k = rest
        out += others[k:]
    if seen is not None:
        seen.update({tuple(key): ((out, final), k) for *key, k in marks})
    return out, final


def _token(text: str, at: int, begun: str, seen: dict) -> tuple[str, int, int] | None:
    """What comes next in code (in lower case), where and its end. ``seen`` has what runs of other
    states found: but for stdin, it is the same in all statements."""
    if not begun:
        m = _FIRST.match(text, at)
        return m and (m[1].lower(), m.start(1), m.end())
    if (key := ("token", at)) not in seen:
        m = _CODE.search(text, at)
        seen[key] = m and (m[0].lower(), m.start(), m.end())
    found = seen[key]
    if begun == COPY:
        if "stdin" not in seen:
            seen["stdin"] = [m.start() for m in _STDIN.finditer(text)] if not text.isascii() or "stdin" in text.lower() else []
        k = bisect_left(seen["stdin"], at)
        if k < len(seen["stdin"]) and (found is None or seen["stdin"][k] < found[1]):
            return "stdin", seen["stdin"][k], seen["stdin"][k] + 5
    return found


def _data_end(text: str, at: int) -> int:
    """The end of the line that ends the COPY data at ``at``, or -1."""
    for m in _MARK.finditer(text, at):
        if m.start() == at or text[m.start() - 1] == "\n":
            return m.end()
    return -1


def _left(text: str, at: int, lex: str, extra):
    """Where a comment, string, name or dollar quote that is open at ``at`` is over, or -1; and a
    comment's depth then, or the quote's mark."""
    if lex == "comment":
        close, more = text.find("*/", at), text.find("/*", at)
        while extra and close >= 0:
            if 0 <= more < close:
                extra, at = extra + 1, more + 2
                more = text.find("/*", at)
                close = close if close >= at else text.find("*/", at)
            else:
                extra, at = extra - 1, close + 2
                close = text.find("*/", at)
                more = more if more < 0 or more >= at else text.find("/*", at)
        while extra and more >= 0:
            extra, more = extra + 1, text.find("/*", more + 2)
        return (-1, extra) if extra else (at, "")
    if lex in ("escaped", "name"):
        if text.find("'" if lex == "escaped" else '"', at) < 0:
            return -1, extra
        m = (_ESCAPED if lex == "escaped" else _QUOTED).match(text, at)
        return (m.end() if m else -1), extra
    mark = "'" if lex == "string" else extra
    found = text.find(mark, at)
    return (found + len(mark) if found >= 0 else -1), extra


def entered(text: str) -> list[State]:
    """The states in which a chunk may be entered, but for dollar tags that it does not hold."""
    kinds = (OTHER, COPY, STDIN)
    out = [("code", k, "") for k in (NOTHING, *kinds)] + [("data", NOTHING, "")]
    out += [(x, k, "") for x in ("string", "escaped", "name") for k in kinds]
    out += [("comment", k, d) for d in range(1, NESTED + 1) for k in (NOTHING, *kinds)]
    return out + [("dollar", k, t) for t in sorted(set(re.findall(r"\$(?:[A-Za-z_]\w*)?\$", text))) for k in kinds]


@dataclass(frozen=True)
class Passage:
    """What a chunk does to what it is entered with. ``first``: text to the first end of a
    statement, if there is one; ``head``: text of the statement that is open at its end, or the
    header of its open COPY block, and whether that ``begins`` in the chunk; ``depth`` of
    parentheses at its end, and the lowest, both counted from the entry where no statement ends."""

    state: State
    first: str | None
    head: str
    begins: bool
    depth: int
    lowest: int
    path: str | None


def passage(text: str, found: list, state: State) -> Passage:
    begin, header, first, depth, lowest, path = None, (None, 0), None, 0, 0, None
    for kind, a, b in found:
        if kind == "begin":
            begin = a
        elif kind == "open":
            depth += 1
        elif kind == "close":
            depth -= 1
            lowest = min(lowest, depth)
        elif kind == "end":
            statement = text[begin or 0 : b]
            if begin is not None and (new := search_path(statement)) is not None:
                path = new
            first = statement[:HEAD] if first is None else first
            begin, header, depth, lowest = None, (begin, b), 0, 0
        elif kind == "data":
            first = "" if first is None else first
    if state[0] == "data":
        begin, end = header
        return Passage(state, first, text[begin or 0 : end][:HEAD], begin is not None, 0, 0, path)
    head = text[begin or 0 :] if begin is not None or first is None and state[1] else ""
    return Passage(state, first, head[:HEAD], begin is not None, depth, lowest, path)


def search_path(statement: str) -> str | None:
    """The schema that a statement makes the current one, if it does that."""
    m = re.match(r"""(?is)(?:SET\s+search_path\s*(?:=|TO)\s*|SELECT\s+pg_catalog\.set_config\(\s*'search_path'\s*,\s*)([^;]*)""", statement)
    if not m:
        return None
    names = [x.strip().strip("'\"") for x in m[1].split(",")]
    return next((x for x in names if x and x not in ("pg_catalog", "false)", "true)")), "")


@dataclass(frozen=True)
class Entry:
    """What a chunk is entered with: the state, the open statement's text (or its COPY block's
    header), depth, current schema, and the chunks in which the open statement and tuple began."""

    state: State = START
    head: str = ""
    depth: int = 0
    path: str = ""
    statement: int = -1
    tuple: int = -1


def after(e: Entry, chunk: int, prefix: str, known: dict[State, Passage]) -> Entry:
    """What the next chunk is entered with."""
    p = known.get(e.state)
    if p is None:
        if e.state[0] == "comment":
            raise ValueError(f"block comments are nested deeper than {NESTED} at the end of a chunk")
        return replace(e, head=(e.head + prefix)[:HEAD])  # in a dollar quote whose end is not here
    path = e.path
    if p.first and (new := search_path(e.head + p.first)) is not None:
        path = new
    path = path if p.path is None else p.path
    if p.begins:
        return Entry(p.state, p.head, p.depth, path, chunk, chunk)
    head, statement = ((e.head + p.head)[:HEAD], e.statement) if p.head or p.first is None else ("", -1)
    if p.first is not None:
        return Entry(p.state, head, p.depth, path, statement, chunk)
    return Entry(p.state, head, e.depth + p.depth, path, statement, chunk if e.depth + p.lowest <= 0 else e.tuple)


# The two scans


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, str]]:
    """(file, start, part, text) of the lines of a task's file blocks, in parts of CHUNK characters,
    or of one line that is longer."""
    key, part, size, held = None, 0, 0, []

    def text() -> str:
        values = pa.concat_arrays(held)
        return pc.binary_join(pa.LargeListArray.from_arrays([0, len(values)], values), "\n")[0].as_py() + "\n"

    for b in batches:
        for lo, hi in _runs(b):
            new = b.column("file")[lo].as_py(), b.column("start")[lo].as_py()
            if key != new:
                if held:
                    yield *key, part, text()
                key, part, size, held = new, 0, 0, []
            values = b.column("value").slice(lo, hi - lo)
            ends = np.cumsum(pc.utf8_length(values).to_numpy().astype(np.int64) + 1)
            at, before = 0, 0
            while at < len(values):
                if size >= CHUNK:
                    yield *key, part, text()
                    part, size, held = part + 1, 0, []
                upto = min(int(np.searchsorted(ends, before + CHUNK - size)) + 1, len(values))
                held.append(values.slice(at, upto - at))
                size += int(ends[upto - 1]) - before
                at, before = upto, int(ends[upto - 1])
    if held:
        yield *key, part, text()


def _runs(b: pa.RecordBatch) -> list[tuple[int, int]]:
    """From where to where a batch's rows are of one file block."""
    if not b.num_rows:
        return []
    changes = np.zeros(b.num_rows - 1, bool)
    for c in (b.column("file"), b.column("start")):
        if not c[0].equals(c[-1]):
            codes = c.dictionary_encode().indices.to_numpy()
            changes |= codes[1:] != codes[:-1]
    cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), b.num_rows]
    return list(zip(cuts, cuts[1:]))


def _few(df: DataFrame) -> DataFrame:
    """``df``, where very many small blocks share tasks."""
    most = max(TASKS, 8 * df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """A dump's lines with their file block."""
    return _few(spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))


def entries(spark: SparkSession, path: str) -> dict[tuple[str, int, int], tuple[int, Entry, bool]]:
    """Of each chunk (file, start, part): its number, what it is entered with, and whether it is
    COPY data throughout. The driver composes the maps; chunks that are more than COPY data then say
    what they do to the state that they are entered in."""

    def maps(batches):
        for file, start, part, text in _chunks(batches):
            seen, known = {}, {}
            for s in entered(text):
                found, state = events(text, s, seen)
                known[s] = state, s[0] == "data" and found[0][0] == "some data"
            yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "part": [part], "map": [pickle.dumps(known)]})

    text = _lines(spark, path)
    key, chunks, state = "file string, start long, part long", {}, START
    for r in sorted(text.mapInArrow(maps, f"{key}, map binary").collect()):
        now, data = pickle.loads(r.map).get(state, (state, False))
        chunks[r.file, r.start, r.part] = state, data
        state = now
    blocks = sorted({c[:2] for c, (_, data) in chunks.items() if not data})
    states = spark.sparkContext.broadcast({c: s for c, (s, data) in chunks.items() if not data})

    def passages(batches):
        for file, start, part, text in _chunks(batches):
            if (s := states.value.get((file, start, part))) is not None:
                known = {s: passage(text, *events(text, s))} if s in entered(text) else {}
                yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "part": [part], "passage": [pickle.dumps((text[:HEAD] if not known else "", known))]})

    asked = F.broadcast(spark.createDataFrame(blocks, "file string, start long"))
    rows = _few(stored(text.join(asked, ["file", "start"], "left_semi").mapInArrow(passages, f"{key}, passage binary"), "passages"))
    told, out, e = rows.orderBy("file", "start", "part").toLocalIterator() if blocks else iter(()), {}, Entry()
    for k, (chunk, (s, data)) in enumerate(chunks.items()):
        out[chunk] = (k, e, data)
        e = after(e, k, "", {s: Passage(s, None, "", False, 0, 0, None)}) if data else after(e, k, *pickle.loads(next(told).passage))
    return out


_NAME = r'(?:"(?:[^"]|"")*"|[\w$]+)'
_INSERT = re.compile(rf"(?is)INSERT\s+INTO\s+({_NAME}(?:\s*\.\s*{_NAME})?)\s*(?:\(([^)]*)\))?\s*(?:OVERRIDING\s+\w+\s+VALUE\s*)?VALUES\b")
_COPIED = re.compile(rf"(?is)COPY\s+({_NAME}(?:\s*\.\s*{_NAME})?)\s*(?:\(([^)]*)\))?")
_CELL = re.compile(r"(?s)\s*((?:[eE]?'[^']*(?:''[^']*)*'|\([^()]*\)|[^,'()])*)(?:,|$)")
_ESCAPED_CELL = re.compile(r"(?s)\s*((?:[eE]'(?:[^'\\]|\\.|'')*'|'[^']*(?:''[^']*)*'|\([^()]*\)|[^,'()])*)(?:,|$)")
PIECES = "chunk long, ix long, kind string, schema string, table string, columns array<string>, value string, cells array<string>, cut long, over boolean"


_ARROW = pa.schema([("chunk", pa.int64()), ("ix", pa.int64()), ("kind", pa.string()), ("schema", pa.string()), ("table", pa.string()), ("columns", pa.list_(pa.string())), ("value", pa.string()), ("cells", pa.list_(pa.string())), ("cut", pa.int64()), ("over", pa.bool_())])


def _named(name: str) -> list[str]:
    return [x[1:-1].replace('""', '"') if x.startswith('"') else x.lower() for x in re.findall(_NAME, name)]


def _owner(m: re.Match | None, path: str) -> tuple[str, str, list[str]]:
    """schema, table and columns that a header names."""
    if m is None:
        return path, "", []
    names = _named(m[1])
    return names[0] if len(names) > 1 else path, names[-1], _named(m[2] or "")


def cells_of(text: str) -> list[str | None]:
    """The values of a tuple's text, strings as they are meant; null for NULL."""
    out = []
    for m in (_ESCAPED_CELL if "\\" in text else _CELL).finditer(text):
        x = re.sub(r"(?s)::[\w\s\".\[\]()]*$", "", m[1]).strip()
        if x[:1] == "'":
            x = x[1:-1].replace("''", "'")
        elif x[:2] in ("E'", "e'"):
            x = re.sub(r"(?s)\\(.)", lambda k: {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(k[1], k[1]), x[2:-1].replace("''", "'"))
        elif x.upper() == "NULL":
            x = None
        out.append(x)
        if m.end() == len(text):
            break
    return out


def pieces_of(text: str, chunk: int, e: Entry) -> Iterator[dict]:
    """A chunk's rows (kind copy, tuple, statement), and parts of what its ends cut: these have
    ``cut``, the chunk in which the whole begins, and the last of them is ``over``."""
    found, state = events(text, e.state)
    # The open statement: its text before the chunk and where it goes on, or is begun, here.
    head, start, since = e.head, 0, e.statement
    depth, path, insert, header = e.depth, e.path, _INSERT.match(e.head), e.head
    opened, since_tuple = 0, e.tuple

    def row(kind, owner, lo, hi, begun=chunk, over=True):
        return {"kind": kind, "owner": owner, "lo": lo, "hi": hi, "cut": None if over and begun == chunk else begun, "over": over}

    for kind, a, b in found:
        if kind == "begin":
            head, start, since, insert = "", a, chunk, None
        elif kind == "open":
            if depth == 0:
                insert = insert or _INSERT.match(head + text[start:a])
                opened, since_tuple = b, chunk
            depth += 1
        elif kind == "close":
            depth -= 1
            if depth == 0 and insert:
                yield row("tuple", _owner(insert, path), opened, a, since_tuple)
        elif kind == "end":
            header = head + text[start:b]
            if (new := search_path(header)) is not None:
                path = new
            if not insert and not _COPIED.match(header):
                yield row("statement", (path, "", []), start, b, since)
            head, start, depth, insert = "", b, 0, None
        elif kind in ("data", "some data"):
            end = b if kind == "some data" else text.rfind("\n", a, b - 1) + 1  # without the end mark's line
            yield row("copy", _owner(_COPIED.match(header), path), a, max(end, a))
            start = b
    if state[0] == "data" or not state[1]:
        return
    if insert and depth > 0:
        yield row("tuple", _owner(insert, path), opened, len(text), since_tuple, False)
    elif not insert:
        yield row("statement", (path, "", []), start, len(text), since, False)


def _batches(text: str, chunk: int, e: Entry) -> Iterator[pa.RecordBatch]:
    """What pieces_of a chunk gives, as rows."""
    ix, rows = 0, []

    def batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, _ARROW.types)], schema=_ARROW)

    for r in pieces_of(text, chunk, e):
        value = text[r["lo"] : r["hi"]]
        if r["kind"] == "copy":
            lines = value.replace("\r\n", "\n").split("\n")[:-1]
            for lo in range(0, len(lines), ROWS):
                some = lines[lo : lo + ROWS]
                n = len(some)
                same = [pa.repeat(pa.scalar(x, t), n) for x, t in zip(("copy", *r["owner"]), _ARROW.types[2:6])]
                yield batch([[chunk] * n, range(ix, ix + n), *same, some, pa.nulls(n, _ARROW.types[7]), pa.nulls(n, pa.int64()), [True] * n])
                ix += n
            continue
        cells = cells_of(value) if r["kind"] == "tuple" and r["cut"] is None else None
        rows.append((chunk, ix, r["kind"], *r["owner"], value, cells, r["cut"], r["over"]))
        ix += 1
        if len(rows) == ROWS:
            yield batch(list(zip(*rows)))
            rows = []
    if rows:
        yield batch(list(zip(*rows)))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, ix, kind, schema, table, columns, value, cells): the rows of COPY blocks (their
    line) and of INSERTs (cells), and the other statements, of a dump of any number of tables.
    Lines of blocks that are all COPY data are read where they lie; what others give is stored."""
    chunks, blocks = entries(spark, path), {}
    for (file, start, _), (k, e, data) in chunks.items():
        blocks.setdefault((file, start), []).append((k, e, data))
    plain = {b: x[0] for b, x in blocks.items() if all(data for _, _, data in x)}
    known = spark.sparkContext.broadcast({c: x[:2] for c, x in chunks.items() if c[:2] not in plain})

    def scan(batches):
        for file, start, part, text in _chunks(batches):
            yield from _batches(text, *known.value[file, start, part])

    owners = [(*b, k, *_owner(_COPIED.match(e.head), e.path)) for b, (k, e, _) in plain.items()]
    data = F.broadcast(spark.createDataFrame(owners, "file string, start long, chunk long, schema string, table string, columns array<string>"))
    text = _lines(spark, path)
    line = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    copied = text.join(data, ["file", "start"]).select("chunk", F.monotonically_increasing_id().alias("ix"), F.lit("copy").alias("kind"), "schema", "table", "columns", line.alias("value"), F.lit(None).cast("array<string>").alias("cells"))
    rows = _few(stored(text.join(data, ["file", "start"], "left_anti").mapInArrow(scan, PIECES), "pieces"))
    parts = rows.where("cut is not null").groupBy("cut", "kind", "schema", "table", "columns").agg(F.array_sort(F.collect_list(F.struct("chunk", "ix", "value"))).alias("parts"), F.max("over").alias("over")).where("over")
    parts = parts.select(F.col("cut").alias("chunk"), F.lit(1 << 40).alias("ix"), "kind", "schema", "table", "columns", F.array_join(F.col("parts.value"), "").alias("value"))

    def parsed(batches):
        for b in batches:
            cells = [cells_of(v) if k == "tuple" else None for k, v in zip(b.column("kind").to_pylist(), b.column("value").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.string()))], [*b.schema.names, "cells"])

    whole = parts.mapInArrow(parsed, "chunk long, ix long, kind string, schema string, table string, columns array<string>, value string, cells array<string>")
    return copied.unionByName(rows.where("cut is null").drop("cut", "over")).unionByName(whole)


def rewritten(text: str, state: State, name: Callable[[str], str]) -> str:
    """A chunk's text with quoted names as ``name`` makes them and other code in lower case."""
    out, last = [], 0
    for kind, a, b in events(text, state, spans=True)[0]:
        if kind in ("name", "kept", "data", "some data"):
            own = name(text[a + 1 : b - 1].replace('""', '"')) if kind == "name" else text[a:b]
            out += [text[last:a].lower(), own]
            last = b
    return "".join([*out, text[last:].lower()])


_OF = re.compile(rf"(?is)(?:COPY|CREATE\s+TABLE(?:\s+IF\s+NOT\s+EXISTS)?|ALTER\s+TABLE(?:\s+ONLY)?|INSERT\s+INTO)\s+({_NAME})\s*\.\s*{_NAME}")


def schemas_of(text: str, e: Entry) -> list[str]:
    """The schema of each line of a chunk: that of the statement or COPY block it is of."""
    ends, names, start, head, path, own = [], [], 0, e.head, e.path, e.path
    for kind, a, b in [*events(text, e.state)[0], ("rest", 0, len(text))]:
        if kind == "begin":
            head, start = "", a
        elif kind in ("end", "rest", "data", "some data"):
            whole = head + text[start:b] if kind in ("end", "rest") else head
            if whole:
                path = path if (new := search_path(whole)) is None else new
                m = _OF.match(whole)
                own = _named(m[1])[0] if m else path
            elif kind == "rest":
                own = path
            ends.append(b)
            names.append(own)
            head, start = "", b
    lines = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)
    # A line is of the statement that its last character but the line end belongs to.
    at = np.searchsorted(ends, np.maximum(lines, 1), "left")
    return [names[k] for k in np.minimum(at, len(names) - 1)]


def lines(spark: SparkSession, path: str, name: Callable[[str], str] | None = None) -> DataFrame:
    """(chunk, line, schema, value): a dump's lines, in order of chunk and line, with the schema
    that each belongs to. With ``name``, quoted names are as it makes them and other code is in lower
    case; strings, comments, dollar quotes and COPY data stay as they are, over any number of lines.
    A quoted name that a chunk's end cuts stays."""
    known = spark.sparkContext.broadcast(entries(spark, path))

    def scan(batches):
        for file, start, part, text in _chunks(batches):
            chunk, e, _ = known.value[file, start, part]
            schemas = schemas_of(text, e)
            made = (rewritten(text, e.state, name) if name else text).split("\n")[:-1]
            for lo in range(0, len(made), 10_000):
                some = made[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int64()), pa.array(range(lo, lo + len(some)), pa.int64()), pa.array(schemas[lo : lo + 10_000]), pa.array(some)], ["chunk", "line", "schema", "value"])

    return _lines(spark, path).mapInArrow(scan, "chunk long, line long, schema string, value string")
