"""Relational rows to triples (s, p, o, o_kind, o_datatype), and entailment on them.

Each triples map is one scan: its literals, classes and own templates are an exploded array
of structs. References that need a join are branches of their own, so that a missing
partner costs no other triple. Null values and placeholders yield no triple.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.functions.terms import PLAIN, RDF_TYPE, datatype, placeholders, template
from relgraph.plans.mapping import Literal, Mapping, Reference, Template, TriplesMap
from relgraph.shared import stored

SCHEMA = "s string, p string, o string, o_kind string, o_datatype string"


def rows_of(spark: SparkSession, tables: dict[str, DataFrame], m: TriplesMap) -> DataFrame:
    if m.table in tables:
        df = tables[m.table]
    else:
        df = spark.sql(m.table, **{t: d for t, d in tables.items() if "{" + t + "}" in m.table})
    return df.where(m.where) if m.where else df


def _triple(p: str, o: Column, kind: str, dtype: str | None = None) -> Column:
    return F.when(o.isNotNull(), F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dtype).cast("string").alias("o_datatype")))


def elided(mapping: Mapping, ref: Reference) -> str | None:
    """The parent's template over the child's columns, where the keys that the reference
    compares are all that the template needs and every key is known to exist."""
    back = {parent: child for child, parent in ref.on}
    pattern = mapping.map(ref.parent).subject
    if not ref.total or not set(placeholders(pattern)) <= back.keys():
        return None
    for parent, child in back.items():
        pattern = pattern.replace("{" + parent + "}", "{" + child + "}")
    return pattern


def map_triples(spark: SparkSession, tables: dict[str, DataFrame], mapping: Mapping, m: TriplesMap, only: set[str] | None = None) -> list[DataFrame]:
    """The branches of a map; ``only`` prunes to predicates."""
    rows = rows_of(spark, tables, m)
    types = dict(rows.dtypes)
    wanted = lambda p: only is None or p in only
    cells, branches = [], []
    if wanted(RDF_TYPE):
        cells += [_triple(RDF_TYPE, F.lit(c), "iri") for c in m.classes]
        if m.dispatch:
            for c in dict.fromkeys(c for _, c in m.dispatch.classes if c not in m.classes):
                values = [v for v, x in m.dispatch.classes if x == c]
                cells.append(_triple(RDF_TYPE, F.when(F.col(m.dispatch.column).isin(values), F.lit(c)), "iri"))
    for p, o in m.objects:
        if not wanted(p):
            continue
        if isinstance(o, Literal):
            if o.column not in types:
                continue  # a column that is not there has no values
            d = o.datatype or datatype(types[o.column])
            cells.append(_triple(p, F.col(f"`{o.column}`").cast("string"), "iri" if o.iri else "literal", None if o.iri or d in PLAIN else d))
        elif isinstance(o, Template):
            cells.append(_triple(p, template(o.pattern), "iri"))
        elif (pattern := elided(mapping, o)) is not None:
            cells.append(_triple(p, template(pattern), "iri"))
        else:
            parent = mapping.map(o.parent)
            right = rows_of(spark, tables, parent).select(template(parent.subject).alias("_o"), *(F.col(f"`{y}`").alias(f"_k{k}") for k, (_, y) in enumerate(o.on)))
            left = rows.select(template(m.subject).alias("s"), *(F.col(f"`{x}`").alias(f"_c{k}") for k, (x, _) in enumerate(o.on)))
            on = [left[f"_c{k}"] == right[f"_k{k}"] for k in range(len(o.on))]
            joined = left.join(right, on).where("s is not null and _o is not null")
            branches.append(joined.select("s", F.lit(p).alias("p"), F.col("_o").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype")))
    if cells:
        flat = rows.select(template(m.subject).alias("s"), F.explode(F.array_compact(F.array(*cells))).alias("t")).where("s is not null")
        branches.insert(0, flat.select("s", "t.*"))
    return branches


def _is_set(mapping: Mapping, m: TriplesMap, only: set[str] | None) -> bool:
    """Whether a map's triples are distinct, and no other map's: its subject is a key, or with its
    only object a pair that no other row has, each of its predicates has one object, and nobody else
    has that predicate on such a subject."""
    shape = lambda x: re.sub(r"\{[^}]*\}", "{}", x.subject)
    made = lambda x: [p for p, _ in x.objects if only is None or p in only] + [RDF_TYPE] * ((only is None or RDF_TYPE in only) and bool(x.classes or x.dispatch))
    own = made(m)
    one = all(not isinstance(o, Reference) or elided(mapping, o) or (mapping.map(o.parent).key and set(placeholders(mapping.map(o.parent).subject)) <= {b for _, b in o.on}) for p, o in m.objects if only is None or p in only)
    others = {(p, shape(x)) for x in mapping.maps if x is not m for p in made(x)}
    whole = m.key or m.pair and len(m.objects) == len(own) == 1 and all(not isinstance(o, Reference) or elided(mapping, o) for _, o in m.objects)
    return whole and one and len(set(own)) == len(own) and len(set(m.classes)) == len(m.classes) and not others & {(p, shape(m)) for p in own}


def triples(spark: SparkSession, tables: dict[str, DataFrame], mapping: Mapping, only: set[str] | None = None) -> DataFrame:
    """All triples as a set. Only maps whose triples could be equal are made distinct."""
    parts: dict[bool, DataFrame] = {}
    for m in mapping.maps:
        own = _is_set(mapping, m, only)
        for b in map_triples(spark, tables, mapping, m, only):
            parts[own] = parts[own].unionByName(b) if own in parts else b
    if False in parts:
        parts[False] = parts[False].distinct()
    out = [parts[k] for k in sorted(parts)]
    return out[0].unionByName(out[1]) if len(out) == 2 else out[0] if out else spark.createDataFrame([], SCHEMA)


def _kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed where the session has a folder for it, else as it is cached."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def closure(spark: SparkSession, edges: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(child, ancestor, depth): the transitive closure, cycles included once. Each round
    joins the pairs to themselves, which doubles the depth, until no pair is new."""
    df = edges if isinstance(edges, DataFrame) else spark.createDataFrame(edges or [("", "")], "child string, parent string").where("child <> ''")
    up = _kept(df.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    before, n = 0, up.count()
    while n > before:
        more = up.select("child", F.col("ancestor").alias("_mid"), F.col("depth").alias("_d")).join(up.select(F.col("child").alias("_mid"), "ancestor", "depth"), "_mid")
        more = more.where("child <> ancestor").select("child", "ancestor", (F.col("_d") + F.col("depth")).alias("depth"))
        up = _kept(up.unionByName(more).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        before, n = n, up.count()
    return up


def saturated(mapping: Mapping, classes: set[str] | None = None) -> Mapping:
    """The mapping with superclasses put in, where the classes are; ``classes`` prunes to these."""
    wanted = lambda c: [a for a in sorted(mapping.above(c)) if classes is None or a in classes]
    maps = []
    for m in mapping.maps:
        own = tuple(dict.fromkeys(a for c in m.classes for a in wanted(c)))
        by_value = tuple(dict.fromkeys((v, a) for v, c in (m.dispatch.classes if m.dispatch else ()) for a in wanted(c)))
        maps.append(replace(m, classes=own, dispatch=replace(m.dispatch, classes=by_value) if by_value else None))
    return replace(mapping, maps=tuple(maps))


def entail(spark: SparkSession, tables: dict[str, DataFrame], mapping: Mapping, only: set[str] | None = None, classes: set[str] | None = None) -> DataFrame:
    """All triples of the mapping and what they entail, as a set; ``only`` prunes to predicates and
    ``classes`` to types of these classes. Superclasses are put into the maps, so that types that
    are a set need no distinct; see entailed for the other rules."""
    full, pruned = saturated(mapping), saturated(mapping, classes)
    made = {p for m in mapping.maps for p, _ in m.objects}

    def get(predicates: set[str], needed: bool = False) -> DataFrame:
        return triples(spark, tables, full if needed else pruned, predicates)

    return _entailed(spark, get, mapping, made if only is None else only - {RDF_TYPE}, made, only is None or RDF_TYPE in only, classes)


def entailed(spark: SparkSession, graph: DataFrame, mapping: Mapping) -> DataFrame:
    """``graph`` with inverse links, types by domain, range, superclasses and classes that are
    equivalent to having a link, to any depth. The graph is stored once, by what rules read."""
    graph = stored(graph, "graph")
    above = {c: sorted(mapping.above(c) - {c}) for c in {a for a, _ in mapping.subclasses}}
    up = F.create_map(*(x for c, more in above.items() for x in (F.lit(c), F.array(*map(F.lit, more))))) if above else None

    def get(predicates: set[str], needed: bool = False) -> DataFrame:
        some = graph.where(F.col("p").isin(sorted(predicates)))
        if RDF_TYPE not in predicates or up is None:
            return some
        more = some.where(F.col("p") == RDF_TYPE).select("s", "p", F.explode(F.element_at(up, F.col("o"))).alias("o"), "o_kind", "o_datatype")
        return some.unionByName(more).distinct()

    known = {x for pair in mapping.inverses for x in pair} | {p for _, p, _ in mapping.existentials} | {p for p, _ in mapping.domains + mapping.ranges}
    rest = graph.where(~F.col("p").isin(sorted(known | {RDF_TYPE})))
    return rest.unionByName(_entailed(spark, get, mapping, known, known, True, None))


def _typed(rows: DataFrame, subject: str, classes) -> DataFrame:
    """Types of the terms in ``subject``, a row for each class."""
    types = F.explode(F.array(*map(F.lit, sorted(classes))))
    return rows.select(F.col(subject).alias("s"), F.lit(RDF_TYPE).alias("p"), types.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))


def _entailed(spark: SparkSession, get, mapping: Mapping, links: set[str], made: set[str], types: bool, classes: set[str] | None) -> DataFrame:
    """Links ``links`` and, with ``types``, types of ``classes`` that follow from ``get``, which
    gives the triples of some of the predicates ``made``, superclasses of types included."""

    def linked(q: str) -> DataFrame | None:
        """The links of a property, own ones and those turned round, not yet a set."""
        out = None
        for p in sorted(made):
            for form, turned in mapping.forms(p):
                if form == q:
                    rows = get({p})
                    rows = rows.where("o_kind = 'iri'").select(F.col("o").alias("s"), F.lit(q).alias("p"), F.col("s").alias("o"), "o_kind", "o_datatype") if turned else rows.withColumn("p", F.lit(q))
                    out = rows if out is None else out.unionByName(rows)
        return out

    sources = lambda q: sum(form == q for p in made for form, _ in mapping.forms(p))
    asked = links | {q for p in links & made for q, _ in mapping.forms(p)} if links == made else links
    parts = []
    plain = {q for q in asked if sources(q) == 1 and q in made}
    if plain:
        parts.append(get(plain))
    for q in sorted(asked - plain):
        if (rows := linked(q)) is not None:
            parts.append(rows.distinct() if sources(q) > 1 else rows)
    if types:
        parts += _types(spark, get, linked, mapping, made, classes)
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def _types(spark: SparkSession, get, linked, mapping: Mapping, made: set[str], classes: set[str] | None) -> list[DataFrame]:
    """Direct types, and those by rules. Only the classes that rules add to are made distinct."""
    wanted = lambda found: {c for c in found if classes is None or c in classes}
    rules = {p: ends for p, ends in mapping.derived().items() if p in made}
    axioms = [x for x in mapping.existentials if any(f == x[1] for p in made for f, _ in mapping.forms(p))]
    derived, new = [], set()
    fillers = {f for _, _, f in axioms}
    for p, ends in sorted(rules.items()):
        for column, found in zip("so", ends):
            keep = found & (wanted(found) | fillers)
            if keep:
                rows = get({p})
                terms = (rows.where("o_kind = 'iri'") if column == "o" else rows).select(column).distinct()
                derived.append(_typed(terms, column, keep))
                new |= keep
    if axioms := _needed(mapping, axioms, classes):
        fillers = {f for _, _, f in axioms}
        facts = get({RDF_TYPE}, True).where(F.col("o").isin(sorted(fillers)))
        for rows in derived:
            facts = facts.unionByName(rows.where(F.col("o").isin(sorted(fillers))))
        found = _existential(spark, facts.select("s", "o"), linked, mapping, axioms)
        derived.append(found)
        new |= {a for c, _, _ in axioms for a in mapping.above(c)}
    direct = get({RDF_TYPE})
    if not derived:
        return [direct]
    new = wanted(new)
    both = direct.where(F.col("o").isin(sorted(new)))
    for rows in derived:
        both = both.unionByName(rows.where(F.col("o").isin(sorted(new))))
    return [direct.where(~F.col("o").isin(sorted(new))), both.distinct()]


def _needed(mapping: Mapping, axioms: list, classes: set[str] | None) -> list:
    """The axioms that can add to ``classes``, directly or through other axioms' fillers."""
    if classes is None:
        return axioms
    found: list = []
    goals = set(classes)
    while more := [x for x in axioms if x not in found and mapping.above(x[0]) & goals]:
        found += more
        goals |= {f for _, _, f in more}
    return found


def _existential(spark: SparkSession, facts: DataFrame, linked, mapping: Mapping, axioms: list) -> DataFrame:
    """Types by classes equivalent to a link to a filler. Semi-naive: each round meets the links
    with the facts (s, o) that the last one added, and only where they are fillers. Fillers that no
    axiom gives are asked for in the first round alone: neither their facts nor the links to them
    are stored. Facts known from the start are stored only of classes that axioms give and ask for."""
    given = {a for c, _, _ in axioms for a in mapping.above(c)}
    again = [x for x in axioms if x[2] in given]
    fed = sorted({f for _, _, f in again})
    by_property = {p: linked(p).select("s", "o") for p in {p for _, p, _ in axioms}}
    by_property |= {p: stored(by_property[p], "links") for p in {p for _, p, _ in again}}

    def round_(delta: DataFrame, some: list) -> DataFrame:
        out = None
        for c, p, f in some:
            holds = delta.where(F.col("o") == f).select(F.col("s").alias("o"))
            rows = _typed(by_property[p].join(holds, "o", "left_semi").select("s").distinct(), "s", mapping.above(c))
            out = rows if out is None else out.unionByName(rows)
        return out

    if not again:
        return round_(facts, axioms)
    known = stored(facts.where(F.col("o").isin(fed)).distinct(), "facts")
    total = new = stored(round_(facts, axioms).distinct(), "found")
    while True:
        delta = stored(new.where(F.col("o").isin(fed)).select("s", "o").join(known, ["s", "o"], "left_anti"), "facts")
        if delta.isEmpty():
            return total.distinct()
        known = known.unionByName(delta)
        new = stored(round_(delta, again).distinct(), "found")
        total = total.unionByName(new)


def superclasses(edges) -> dict[str, list[str]]:
    """Each class's ancestors, of a mapping's few edges; a class in a ring has itself."""
    out = {}
    for c in {a for a, _ in edges}:
        found, todo = set(), [c]
        while todo:
            new = {b for a, b in edges if a == todo[-1]} - found
            todo.pop()
            found |= new
            todo += new
        out[c] = sorted(found)
    return dict(sorted(out.items()))
