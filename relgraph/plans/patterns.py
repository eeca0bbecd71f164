"""Basic graph patterns: lists of (subject, predicate, object), as Python tuples.

Terms are ``?variables``, IRIs and prefixed names, ``a`` for the type predicate, and literals
as ``Value``. Over a triples DataFrame, patterns are joins of it with itself (``evaluate``);
over a mapping they unfold to joins of the tables (``unfold``). Either way the result has a
row per solution and a string column per variable; counts, filters, grouping and order are
the caller's, as for any DataFrame.

Unfolding. Each pattern has candidates: the maps that make such triples. Variables take the
shape of their term, a template's fixed parts or a literal, and candidates whose shapes differ
are not combined. In a combination, patterns on one subject that one map answers are one scan,
if the map's subject is a key of its rows; other joins compare key columns, not IRIs. Solutions
are a set of bindings, so rows are made distinct only where a scan's rows are no set, or
combinations may give the same ones.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.functions.terms import PLAIN, RDF_TYPE, datatype, placeholders, template
from relgraph.operators.materialize import rows_of
from relgraph.plans.mapping import Literal, Mapping, Template, TriplesMap


@dataclass(frozen=True)
class Value:
    """A literal in a pattern."""

    text: str


Pattern = tuple[str, str, "str | Value"]


def expanded(patterns: list[Pattern], prefixes: dict[str, str] | None = None) -> list[Pattern]:
    """With ``a`` and prefixed names written out."""

    def term(x):
        if isinstance(x, Value) or x.startswith("?"):
            return x
        if x in ("a", "rdf:type"):
            return RDF_TYPE
        head, colon, tail = x.partition(":")
        return prefixes[head] + tail if colon and prefixes and head in prefixes else x

    return [tuple(map(term, p)) for p in patterns]


def is_variable(x) -> bool:
    return isinstance(x, str) and x.startswith("?")


#: What iri_safe leaves of a value: unreserved characters, escapes, and all that is not ASCII.
_SAFE = r"((?:[A-Za-z0-9._~-]|%[0-9A-F]{2}|[^\x00-\x7f])*)"


def inverted(term: Term, constant: str, types: dict[str, str]) -> list[Column]:
    """When a term is the constant, as comparisons of its columns, which reach the scan. An IRI is
    decoded by its template; a value that the template would not write so is no value. Columns that
    are no text or whole number, and templates whose parts can't be told apart, are compared as text."""
    whole = ("tinyint", "smallint", "int", "bigint")
    if not term.columns or any(types[c] not in (*whole, "string") for c in term.columns):
        return [term.value() == constant]
    if term.kind == "literal":
        values = [constant]
    else:
        between = term.shape[1:-1]
        if any(re.fullmatch(r"[A-Za-z0-9._~-]*", x) for x in between):
            return [term.value() == constant]
        m = re.fullmatch(_SAFE.join(map(re.escape, term.shape)), constant)
        if not m:
            return [F.lit(False)]
        values = [unquote(x) for x in m.groups()]
        if any(quote(v) != x for v, x in zip(values, m.groups())):
            return [F.lit(False)]
    out = []
    for c, v in zip(term.columns, values):
        if types[c] == "string":
            out.append(F.col(f"`{c}`") == v)
        elif not re.fullmatch(r"0|-?[1-9][0-9]{0,18}", v) or not -(1 << 63) <= int(v) < 1 << 63:
            return [F.lit(False)]
        else:
            out.append(F.col(f"`{c}`") == F.lit(int(v)))
    return out


def quote(value: str) -> str:
    """As iri_safe, of one value."""
    return "".join(c if ord(c) > 127 or re.match(r"[A-Za-z0-9._~-]", c) else f"%{ord(c):02X}" for c in value)


def evaluate(graph: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Solutions over ``graph``, a set of triples. Patterns are joined in an order that always
    shares a variable with what came before; without one a ValueError says so."""
    left, out = expanded(patterns), None
    while left:
        bound = set(out.columns) if out is not None else set()
        nxt = next((p for p in left if bound & {x[1:] for x in p if is_variable(x)}), left[0])
        left.remove(nxt)
        t, seen = graph, {}
        for name, x in zip("spo", nxt):
            if is_variable(x):
                t = t.where(F.col(name) == F.col(seen[x])) if x in seen else t
                seen.setdefault(x, name)
            else:
                t = t.where(F.col(name) == (x.text if isinstance(x, Value) else x))
                t = t.where(F.col("o_kind") == ("literal" if isinstance(x, Value) else "iri")) if name == "o" else t
        t = t.select(*(F.col(c).alias(x[1:]) for x, c in seen.items()))
        out = t if out is None else out.join(t, _shared(out.columns, t.columns))
    return out


def _shared(a, b) -> list[str]:
    if not (same := [c for c in b if c in a]):
        raise ValueError("the patterns do not hang together; a cross product is not built")
    return same


@dataclass(frozen=True)
class Term:
    """How a map makes a term: the fixed parts of a template, or the type of a literal, and
    the columns in between."""

    kind: str
    shape: tuple[str, ...]
    columns: tuple[str, ...]

    @classmethod
    def of(cls, pattern: str) -> Term:
        return cls("iri", tuple(re.split(r"\{[^}]*\}", pattern)), tuple(placeholders(pattern)))

    def value(self, prefix: str = "") -> Column:
        if self.kind == "literal":
            return F.col(f"`{prefix}{self.columns[0]}`").cast("string")
        return template("".join(f + "{" + prefix + c + "}" for f, c in itertools.zip_longest(self.shape, self.columns) if c is not None) + self.shape[-1]) if self.columns else F.lit(self.shape[0])


@dataclass(frozen=True)
class Candidate:
    """A map's rows as triples of one pattern. ``parent``: (map, ((own, its), ...)) that rows
    must have a partner in; ``foreign`` says that the object is made of the partner's columns."""

    map: TriplesMap
    subject: Term
    object: Term
    equal: tuple[tuple[str, object], ...] = ()
    parent: tuple[str, tuple[tuple[str, str], ...]] | None = None
    foreign: bool = False
    swapped: bool = False


def candidates(mapping: Mapping, tables: dict[str, DataFrame], p: Pattern, entail: bool) -> list[Candidate]:
    _, predicate, o = p
    if is_variable(predicate):
        raise ValueError("a variable predicate has no unfolding; evaluate it over triples")
    found = []
    above = mapping.above if entail else lambda c: {c}
    for m in mapping.maps:
        s = Term.of(m.subject)
        if predicate == RDF_TYPE:
            classes = [(c, ()) for c in m.classes] + [(c, ((m.dispatch.column, v),)) for v, c in (m.dispatch.classes if m.dispatch else ())]
            hits = {(a, e) for c, e in classes for a in above(c) if is_variable(o) or a == o}
            hits = {(a, e) for a, e in hits if not e or (a, ()) not in hits}  # all rows are, whatever else some are
            found += [Candidate(m, s, Term("iri", (c,), ()), e) for c, e in sorted(hits, key=str)]
            continue
        for q, x in m.objects:
            back = entail and any({q, predicate} == {a, b} and q != predicate for a, b in mapping.inverses)
            if q != predicate and not back:
                continue
            if isinstance(x, Literal):
                if m.table in tables and x.column not in tables[m.table].columns:
                    continue
                kind = x.datatype or (datatype(dict(tables[m.table].dtypes)[x.column]) if m.table in tables else "xsd:string")
                term = Term.of("{" + x.column + "}") if x.iri else Term("literal", ("xsd:string" if kind in PLAIN else kind,), (x.column,))
                found.append(Candidate(m, s, term, swapped=back))
            elif isinstance(x, Template):
                found.append(Candidate(m, s, Term.of(x.pattern), swapped=back))
            else:
                parent = mapping.map(x.parent)
                to = {b: a for a, b in x.on}
                covered = set(placeholders(parent.subject)) <= to.keys()
                pattern = re.sub(r"\{([^}]*)\}", lambda k: "{" + to[k[1]] + "}", parent.subject) if covered else parent.subject
                need = None if covered and x.total else (x.parent, x.on)
                found.append(Candidate(m, s, Term.of(pattern), parent=need, foreign=not covered, swapped=back))
    return found


@dataclass
class Scan:
    """Patterns that one scan of a map answers."""

    map: TriplesMap
    subject: object
    candidates: list = field(default_factory=list)  # (candidate, object of its pattern)


def _combinations(options: list[list[Candidate]], patterns: list[Pattern]):
    """Choices of a candidate per pattern in which each variable has one shape."""

    def ends(c, p):
        s, o = (c.object, c.subject) if c.swapped else (c.subject, c.object)
        return ((p[0], s), (p[2], o))

    def go(i, chosen, shapes):
        if i == len(patterns):
            yield chosen, shapes
            return
        for c in options[i]:
            new, fits = dict(shapes), True
            for x, t in ends(c, patterns[i]):
                if is_variable(x):
                    fits &= new.setdefault(x, (t.kind, t.shape)) == (t.kind, t.shape)
                else:
                    fits &= t.kind == ("literal" if isinstance(x, Value) else "iri") and (t.columns != () or t.shape == (x,))
            if fits:
                yield from go(i + 1, [*chosen, c], new)

    return go(0, [], {})


def unfold(spark: SparkSession, tables: dict[str, DataFrame], mapping: Mapping, patterns: list[Pattern], entail: bool = False) -> DataFrame:
    """Solutions of ``patterns`` over the tables. ``entail`` adds superclasses, inverse properties,
    classes by domain and range, and classes equivalent to having a link: a type pattern is then a
    union of what its class follows from. A class that is defined by itself has no finite union and
    raises a ValueError; evaluate it over entailed triples."""
    patterns = expanded(patterns)
    variables = list(dict.fromkeys(x for p in patterns for x in p if is_variable(x)))
    if not entail:
        return _unfolded(spark, tables, mapping, patterns, variables, False)
    by_patterns: dict[tuple, list[dict]] = {}
    for some, given in _rewritings(mapping, patterns):
        if all(candidates(mapping, tables, p, True) for p in some):
            by_patterns.setdefault(tuple(some), []).append(given)
    # Each way once, for all classes that it gives: (rows, their variables' shapes, classes).
    ways, seen = [], Counter()
    for some, givens in by_patterns.items():
        asked = [v for v in variables if v not in givens[0]]
        for chosen, shapes in _combinations([candidates(mapping, tables, p, True) for p in some], list(some)):
            df, is_set = _combined(spark, tables, mapping, list(some), chosen, asked, shapes.keys() > set(asked))
            keys = [tuple(("iri", (given[v],)) if v in given else shapes[v] for v in variables) for given in givens]
            ways.append((df if is_set else df.distinct(), givens, keys))
            seen.update(keys)
    # Only what another way may give too is made distinct again.
    parts: dict[bool, DataFrame] = {}
    for df, givens, keys in ways:
        for again in {seen[k] > 1 for k in keys}:
            rows, own = df, [given for given, k in zip(givens, keys) if (seen[k] > 1) == again]
            if own[0]:
                rows = df.withColumn("_given", F.explode(F.array(*(F.struct(*(F.lit(c).alias(v[1:]) for v, c in given.items())) for given in own))))
            rows = rows.select(*(F.col("_given")[v[1:]].alias(v[1:]) if v in own[0] else F.col(v[1:]) for v in variables))
            parts[again] = parts[again].unionByName(rows) if again in parts else rows
    if True in parts:
        parts[True] = parts[True].distinct()
    out = [parts[k] for k in sorted(parts)]
    return out[0].unionByName(out[1]) if len(out) == 2 else out[0] if out else _none(spark, variables)


def _none(spark: SparkSession, variables: list[str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{v[1:]} string" for v in variables))


def _rewritings(mapping: Mapping, patterns: list[Pattern], done: int = 0, fresh: int = 0, used: tuple = ()):
    """(patterns, classes of variables): the ways in which types can follow, patterns before
    ``done`` being asked of the maps as they are."""
    k = next((i for i in range(done, len(patterns)) if patterns[i][1] == RDF_TYPE), None)
    if k is None:
        yield patterns, {}
        return
    yield from _rewritings(mapping, patterns, k + 1, fresh, used)
    s, _, o = patterns[k]
    rest = patterns[:k] + patterns[k + 1 :]
    if is_variable(o) and any(o in p for p in rest):
        raise ValueError("a class is asked for twice; evaluate it over entailed triples")
    x = f"?_x{fresh}"
    for classes, more, axiom in _reasons(mapping, s, x):
        for c in sorted(classes) if is_variable(o) else [o] if o in classes else []:
            if axiom in used:
                raise ValueError(f"{axiom[0]} is defined by itself; evaluate it over entailed triples")
            # New type patterns stand behind those that are done.
            for some, given in _rewritings(mapping, rest[:k] + more[:1] + rest[k:] + more[1:], k, fresh + 1, used + ((axiom,) if len(more) > 1 else ())):
                yield some, given | ({o: c} if is_variable(o) else {})


def _reasons(mapping: Mapping, s: str, x: str):
    """(classes, patterns, rule) that make ``s`` of the classes, ``x`` being something."""
    for p, c in mapping.domains:
        yield mapping.above(c), [(s, p, x)], ("domain", p, c)
    for p, c in mapping.ranges:
        yield mapping.above(c), [(x, p, s)], ("range", p, c)
    for axiom in mapping.existentials:
        c, p, filler = axiom
        yield mapping.above(c), [(s, p, x), (x, RDF_TYPE, filler)], axiom


def _unfolded(spark: SparkSession, tables: dict[str, DataFrame], mapping: Mapping, patterns: list[Pattern], variables: list[str], entail: bool) -> DataFrame:
    parts, seen, apart = [], [], True
    for chosen, shapes in _combinations([candidates(mapping, tables, p, entail) for p in patterns], patterns):
        df, is_set = _combined(spark, tables, mapping, patterns, chosen, variables)
        parts.append(df)
        apart &= is_set and shapes not in seen
        seen.append(shapes)
    if not parts:
        return _none(spark, variables)
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out if apart else out.distinct()


def _combined(spark, tables, mapping, patterns, chosen, variables, fewer: bool = False) -> tuple[DataFrame, bool]:
    """The rows of a choice and whether they are a set; with ``fewer`` variables than the patterns
    have, rows are made one on the columns of these."""
    scans: list[Scan] = []
    for (s, _, o), c in zip(patterns, chosen):
        subject, other = (o, s) if c.swapped else (s, o)
        scan = next((x for x in scans if x.map is c.map and x.subject == subject and c.map.key), None)
        if scan is None:
            scans.append(scan := Scan(c.map, subject))
        scan.candidates.append((c, other))
    terms: dict[str, list[tuple[int, Term]]] = {}
    frames, is_set = [], True
    for k, scan in enumerate(scans):
        df, own = _scanned(spark, tables, mapping, scan, scans, f"_{k}_", terms, k)
        frames.append(df)
        is_set &= own
    out, done = frames[0], {0}
    out = _equal(out, terms, done, 0)
    while len(done) < len(frames):
        nxt = next((k for k in range(len(frames)) if k not in done and any({i for i, _ in ts} & done and k in {i for i, _ in ts} for ts in terms.values())), None)
        if nxt is None:
            raise ValueError("the patterns do not hang together; a cross product is not built")
        right, on = _equal(frames[nxt], terms, {nxt}, nxt), []
        for ts in terms.values():
            a, b = next((x for x in ts if x[0] in done), None), next((x for x in ts if x[0] == nxt), None)
            if a and b:
                on += _same(a, b, out, right)
        out = out.join(right, on)
        done.add(nxt)
    if fewer:
        own = dict.fromkeys(f"_{k}_{c}" for k, t in (terms[v][0] for v in variables) for c in t.columns)
        out = out.select(*own).distinct() if own else out.limit(1)
    return out.select(*(terms[v][0][1].value(f"_{terms[v][0][0]}_").alias(v[1:]) for v in variables)), is_set


def _same(a, b, left: DataFrame, right: DataFrame) -> list[Column]:
    """Equality of two terms of one shape, by their columns."""
    out = []
    for x, y in zip(a[1].columns, b[1].columns):
        x, y = left[f"_{a[0]}_{x}"], right[f"_{b[0]}_{y}"]
        number = {"tinyint", "smallint", "int", "bigint"}
        kinds = {left.select(x).dtypes[0][1], right.select(y).dtypes[0][1]}
        out.append(x == y if len(kinds) == 1 or kinds <= number else x.cast("string") == y.cast("string"))
    return out


def _equal(df: DataFrame, terms, done, k: int) -> DataFrame:
    """Rows in which a variable that the scan binds more than once has one value."""
    for ts in terms.values():
        own = [t for t in ts if t[0] == k]
        for t in own[1:]:
            for c in _same(own[0], t, df, df):
                df = df.where(c)
    return df


def _scanned(spark, tables, mapping, scan: Scan, scans, prefix: str, terms, k: int) -> tuple[DataFrame, bool]:
    df, is_set = rows_of(spark, tables, scan.map), scan.map.key
    types = dict(df.dtypes)
    subject = Term.of(scan.map.subject)
    need = set(subject.columns)
    conditions = []
    if is_variable(scan.subject):
        terms.setdefault(scan.subject, []).append((k, subject))
    else:
        conditions += inverted(subject, scan.subject, types)
    for n, (c, other) in enumerate(scan.candidates):
        conditions += [F.col(f"`{x}`") == F.lit(v) for x, v in c.equal]
        term = c.object
        if c.parent:
            name, on = c.parent
            right = rows_of(spark, tables, mapping.map(name))
            if c.foreign:
                right = right.select(*(F.col(f"`{b}`").alias(f"_on{n}_{i}") for i, (_, b) in enumerate(on)), *(F.col(f"`{x}`").alias(f"_p{n}_{x}") for x in term.columns)).distinct()
                df = df.join(right, [df[f"`{a}`"] == right[f"_on{n}_{i}"] for i, (a, _) in enumerate(on)])
                term = Term("iri", term.shape, tuple(f"_p{n}_{x}" for x in term.columns))
            elif not any(s.map.name == name and s.subject == other for s in scans):
                right = right.select(*(F.col(f"`{b}`").alias(f"_on{n}_{i}") for i, (_, b) in enumerate(on)))
                df = df.join(right, [df[f"`{a}`"] == right[f"_on{n}_{i}"] for i, (a, _) in enumerate(on)], "left_semi")
        need |= set(term.columns)
        if is_variable(other):
            terms.setdefault(other, []).append((k, term))
        elif term.columns:
            conditions += inverted(term, other.text if isinstance(other, Value) else other, types | dict(df.dtypes))
    for c in sorted(need):
        df = df.where(F.col(f"`{c}`").isNotNull())
    for c in conditions:
        df = df.where(c)
    df = df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in sorted(need)))
    # Rows that are no set are made one where they are read, on the columns that are needed.
    return (df, True) if is_set else (df.distinct(), True)
