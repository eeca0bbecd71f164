"""A mapping as R2RML Turtle, and back.

A class by discriminator value is a column of the map's query, null for other values, and
the placeholders of a query's tables are written as their names. Of Turtle, the reader takes
what R2RML documents use: prefixes, blank nodes in brackets, ``;`` and ``,`` lists, comments.
"""

from __future__ import annotations

import re
from dataclasses import replace

from relgraph.plans.mapping import Literal, Mapping, Reference, Template, TriplesMap

#: Fixed values of the W3C.
PREFIXES = {"rr": "http://www.w3.org/ns/r2rml#", "xsd": "http://www.w3.org/2001/XMLSchema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
#: The column that holds the class by discriminator value.
CLASS = "class_by_value"


def _text(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _value(v: object) -> str:
    return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _query(m: TriplesMap, full) -> str:
    """The query of a map's rows; empty for a plain table."""
    table = re.sub(r"\{(\w+)\}", r"\1", m.table) if " " in m.table.strip() else m.table
    source = f"({table})" if " " in table.strip() else table
    if m.dispatch:
        # Of equal values the last one counts, as in materialize.
        cases = " ".join(f"WHEN {m.dispatch.column} = {_value(v)} THEN {_value(full(c))}" for v, c in reversed(m.dispatch.classes))
        source = f"(SELECT t.*, CASE {cases} END AS {CLASS} FROM {source} AS t)"
    if m.where:
        return f"SELECT * FROM {source} AS w WHERE {m.where}"
    return source[1:-1] if source.startswith("(") else ""


def to_turtle(mapping: Mapping, base: str = "urn:map:", namespace: str = "urn:graph#") -> str:
    """``namespace`` stands for the empty prefix of the mapping's names."""
    full = lambda iri: namespace + iri[1:] if iri.startswith(":") else PREFIXES["rdf"] + iri[4:] if iri.startswith("rdf:") else iri
    lines = [f"@prefix {p}: <{iri}> ." for p, iri in PREFIXES.items()]
    for m in mapping.maps:
        query = _query(m, full)
        table = f"rr:sqlQuery {_text(query)}" if query else f"rr:tableName {_text(m.table)}"
        body = [f"<{base}{m.name}> a rr:TriplesMap", f"  rr:logicalTable [ {table} ]"]
        classes = "".join(f" ; rr:class <{full(c)}>" for c in m.classes)
        body.append(f"  rr:subjectMap [ rr:template {_text(full(m.subject))}{classes} ]")
        if m.dispatch:
            body.append(f"  rr:predicateObjectMap [ rr:predicate rdf:type ; rr:objectMap [ rr:column {_text(CLASS)} ; rr:termType rr:IRI ] ]")
        for p, o in m.objects:
            if isinstance(o, Literal):
                x = f"rr:column {_text(o.column)}" + (" ; rr:termType rr:IRI" if o.iri else f" ; rr:datatype {o.datatype}" if o.datatype else "")
            elif isinstance(o, Template):
                x = f"rr:template {_text(full(o.pattern))}"
            elif isinstance(o, Reference):
                x = f"rr:parentTriplesMap <{base}{o.parent}>" + "".join(f" ; rr:joinCondition [ rr:child {_text(a)} ; rr:parent {_text(b)} ]" for a, b in o.on)
            body.append(f"  rr:predicateObjectMap [ rr:predicate <{full(p)}> ; rr:objectMap [ {x} ] ]")
        lines.append(" ;\n".join(body) + " .")
    return "\n".join(lines) + "\n"


_TOKEN = re.compile(r'\s*(?:#[^\n]*\s*)*(@prefix|<[^>]*>|"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\]|\\.)*"|[\[\];,.]|[\w-]*:[\w.-]*\w|[\w-]*:|a\b)')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _nodes(text: str) -> list[tuple[str, list]]:
    """(subject, properties) of a document; a bracket's node is its list of properties, and a
    property is (predicate, object)."""
    prefixes, tokens, at = dict(PREFIXES), [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if re.fullmatch(r"\s*(#[^\n]*\s*)*", text[at:]):
                break
            raise SyntaxError(f"Turtle: {text[at : at + 30]!r}")
        tokens.append(m[1])
        at = m.end()
    i = 0

    def term():
        nonlocal i
        t = tokens[i]
        i += 1
        if t == "[":
            inside = properties("]")
            i += 1
            return inside
        if t[0] == '"':
            body = t[3:-3] if t.startswith('"""') else t[1:-1]
            return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body)
        if t[0] == "<":
            return t[1:-1]
        if t == "a":
            return PREFIXES["rdf"] + "type"
        head, _, tail = t.partition(":")
        return prefixes.get(head, head + ":") + tail

    def properties(stop):
        nonlocal i
        out = []
        while tokens[i] != stop:
            if tokens[i] == ";":
                i += 1
                continue
            p = term()
            out.append((p, term()))
            while tokens[i] == ",":
                i += 1
                out.append((p, term()))
        return out

    found = []
    while i < len(tokens):
        if tokens[i] == "@prefix":
            prefixes[tokens[i + 1][:-1]] = tokens[i + 2][1:-1]
            i += 4
            continue
        s = term()
        found.append((s, properties(".")))
        i += 1
    return found


def from_turtle(text: str, tables: tuple[str, ...] = (), namespace: str = "urn:graph#") -> Mapping:
    """The mapping of an R2RML document; maps take the last part of their IRI as a name.
    ``tables`` are those that queries read; ``namespace`` becomes the empty prefix."""
    rr, short = PREFIXES["rr"], {v: f"{k}:" for k, v in PREFIXES.items() if k != "rr"} | {namespace: ":"}

    def query(sql: str) -> str:
        return re.sub(r"(?i)\b(FROM|JOIN)(\s+)(\w+)\b", lambda m: m[1] + m[2] + "{" + m[3] + "}" if m[3] in tables else m[0], sql.replace("'" + namespace, "':"))

    name = lambda iri: re.split(r"[#/:]", iri)[-1]

    def brief(iri: str) -> str:
        return next((p + iri.removeprefix(ns) for ns, p in short.items() if iri.startswith(ns)), iri)

    def one(node, p, default=None):
        return next((o for k, o in node if k == rr + p), default)

    maps = []
    for s, node in _nodes(text):
        if (PREFIXES["rdf"] + "type", rr + "TriplesMap") not in node and one(node, "logicalTable") is None:
            continue
        table = one(node, "logicalTable", [])
        subject = one(node, "subjectMap", [])
        objects = []
        classes = [brief(o) for k, o in subject if k == rr + "class"]
        dispatch = None
        for k, pom in node:
            if k != rr + "predicateObjectMap":
                continue
            p, o = one(pom, "predicate"), one(pom, "objectMap", [])
            parent, column, pattern = one(o, "parentTriplesMap"), one(o, "column"), one(o, "template")
            if parent:
                on = tuple((one(j, "child"), one(j, "parent")) for q, j in o if q == rr + "joinCondition")
                objects.append((brief(p), Reference(name(parent), on)))
            elif pattern:
                objects.append((brief(p), Template(brief(pattern))))
            elif column:
                kind = one(o, "datatype")
                objects.append((brief(p), Literal(column, brief(kind) if kind else None, one(o, "termType") == rr + "IRI")))
            elif one(pom, "object"):
                objects.append((brief(p), Template(brief(one(pom, "object")))))
        maps.append(TriplesMap(name(s), one(table, "tableName") or query(one(table, "sqlQuery") or ""), brief(one(subject, "template") or ""), tuple(classes), tuple(objects), dispatch=dispatch))
    return Mapping(tuple(maps))


def with_types(mapping: Mapping, kinds: dict[str, str]) -> Mapping:
    """``mapping`` with the datatypes that an ontology declares for its properties."""
    typed = lambda p, o: replace(o, datatype=kinds[p]) if isinstance(o, Literal) and p in kinds and not o.iri else o
    return replace(mapping, maps=tuple(replace(m, objects=tuple((p, typed(p, o)) for p, o in m.objects)) for m in mapping.maps))


def with_schemas(mapping: Mapping, schemas: dict[str, str]) -> Mapping:
    """``mapping`` with tables named ``schema.table``, in queries behind FROM and JOIN."""

    def full(m: TriplesMap) -> str:
        if m.table in schemas:
            return f"{schemas[m.table]}.{m.table}"
        return re.sub(r"(?i)\b(FROM|JOIN)(\s+)(\w+)(?![\w.])", lambda x: f"{x[1]}{x[2]}{schemas[x[3]]}.{x[3]}" if x[3] in schemas else x[0], m.table)

    return replace(mapping, maps=tuple(replace(m, table=full(m)) for m in mapping.maps))
