"""Driver queries of schemas, ontologies, mapping rules and reports, and their SQL."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.functions import terms as T
from relgraph.graph_queries import KEYABLE, _inclusions_sql, _keys_sql
from relgraph.operators import constraints as C
from relgraph.operators import evaluate as E
from relgraph.operators import hidden as H
from relgraph.operators import materialize as M
from relgraph.operators import ontology as O
from relgraph.operators import profile as P
from relgraph.operators import rules as R
from relgraph.plans.mapping import Literal, Mapping, Reference, TriplesMap
from relgraph.shared import stored
from relgraph.sources import ontology as source
from relgraph.sources import r2rml

SMALL = ("region", "nation", "customer", "supplier")
#: Columns of the small tables, for their SQL.
COLUMNS = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "supplier": ["s_suppkey", "s_nationkey"]}

#: An ontology of the star tables.
OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns="urn:graph#" xml:base="urn:graph" xmlns:owl="http://www.w3.org/2002/07/owl#"
  xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">
  <owl:Ontology rdf:about="urn:graph"/>
  <owl:Class rdf:about="#Place"/>
  <owl:Class rdf:about="#Region"><rdfs:subClassOf rdf:resource="#Place"/></owl:Class>
  <owl:Class rdf:about="#Nation"><rdfs:subClassOf rdf:resource="#Place"/></owl:Class>
  <owl:Class rdf:about="#Party"/>
  <owl:Class rdf:about="#Customer"><rdfs:subClassOf rdf:resource="#Party"/></owl:Class>
  <owl:Class rdf:about="#Supplier"><rdfs:subClassOf rdf:resource="#Party"/></owl:Class>
  <owl:Class rdf:about="#Order"/>
  <owl:Class rdf:about="#OpenOrder"><rdfs:subClassOf rdf:resource="#Order"/></owl:Class>
  <owl:Class rdf:about="#Buyer"><owl:equivalentClass><owl:Restriction><owl:onProperty rdf:resource="#placed"/><owl:someValuesFrom rdf:resource="#Order"/></owl:Restriction></owl:equivalentClass></owl:Class>
  <owl:DatatypeProperty rdf:about="#name"><rdfs:range rdf:resource="http://www.w3.org/2001/XMLSchema#string"/></owl:DatatypeProperty>
  <owl:DatatypeProperty rdf:about="#market_segment"><rdfs:domain rdf:resource="#Customer"/><rdfs:range rdf:resource="http://www.w3.org/2001/XMLSchema#string"/></owl:DatatypeProperty>
  <owl:DatatypeProperty rdf:about="#dateOfOrder"><rdfs:domain rdf:resource="#Order"/><rdfs:range rdf:resource="http://www.w3.org/2001/XMLSchema#date"/></owl:DatatypeProperty>
  <owl:ObjectProperty rdf:about="#locatedIn"><rdfs:domain><owl:Class><owl:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="#Party"/><rdf:Description rdf:about="#Nation"/></owl:unionOf></owl:Class></rdfs:domain><rdfs:range rdf:resource="#Place"/></owl:ObjectProperty>
  <owl:ObjectProperty rdf:about="#inNation"><rdfs:domain rdf:resource="#Customer"/><rdfs:range rdf:resource="#Nation"/></owl:ObjectProperty>
  <owl:ObjectProperty rdf:about="#placedBy"><rdfs:domain rdf:resource="#Order"/><rdfs:range rdf:resource="#Customer"/><owl:inverseOf rdf:resource="#placed"/></owl:ObjectProperty>
  <owl:ObjectProperty rdf:about="#has_a_supplier"><rdfs:domain rdf:resource="#Order"/></owl:ObjectProperty>
</rdf:RDF>"""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _small(spark, sf_dir, names=SMALL):
    return {n: _t(spark, sf_dir, n) for n in names}


def _onto(spark):
    return source.read_ontology(OWL).frames(spark)


def _values(rows: list[tuple], columns: str) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS v({columns})"


# Ontology: classes and properties found in the tables


def _clean(c):
    return F.concat(F.lit(":"), F.regexp_replace(c, "[^A-Za-z0-9_]", ""))


def _found(spark, sf_dir) -> dict[str, DataFrame]:
    """Kinds of parts by type and brand, places by nation and region, and what links them."""
    parts = _t(spark, sf_dir, "part").select(_clean("p_type").alias("type"), _clean(F.concat_ws("_", "p_type", "p_brand")).alias("kind")).distinct()
    nations = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = nations.select(_clean("n_name").alias("nation"), _clean("r_name").alias("region"))
    types, regions = parts.select("type").distinct(), places.select("region").distinct()
    col, lit = F.col, F.lit
    edge = lambda df, a, b: df.select(a.alias("child"), b.alias("parent"))
    named = lambda prefix, c: F.concat(lit(f":{prefix}_"), F.substr(col(c), lit(2)))
    prop = lambda df, p, kind, domain, range_: df.select(p.alias("property"), lit(kind).alias("kind"), domain.alias("domain"), range_.alias("range"))
    subclasses = edge(parts, col("kind"), col("type")).unionByName(edge(types, col("type"), lit(":Part"))).unionByName(edge(places, col("nation"), col("region"))).unionByName(edge(regions, col("region"), lit(":Place")))
    properties = prop(types, named("size_of", "type"), "data", col("type"), lit("xsd:integer")).unionByName(prop(types, named("like", "type"), "object", col("type"), lit(":Part")))
    properties = properties.unionByName(prop(places, named("made_in", "nation"), "object", lit(":Part"), col("nation"))).unionByName(prop(regions, named("sold_in", "region"), "object", lit(":Part"), col("region")))
    existentials = places.select(named("Local", "nation").alias("class"), named("made_in", "nation").alias("property"), col("nation").alias("filler"))
    inverses = places.select(named("made_in", "nation").alias("a"), named("makes", "nation").alias("b"))
    classes = subclasses.select(col("child").alias("class")).unionByName(subclasses.select(col("parent").alias("class"))).distinct()
    return {"classes": classes, "subclasses": subclasses, "properties": properties, "existentials": existentials, "inverses": inverses}


def _owl(spark, sf_dir) -> str:
    """The found ontology as OWL; it is as small as the tables' types, brands and nations."""
    o = _found(spark, sf_dir)
    about = lambda tag, name, inner="": f'<owl:{tag} rdf:about="#{name[1:]}">{inner}</owl:{tag}>'
    to = lambda tag, name: f'<{tag} rdf:resource="{"http://www.w3.org/2001/XMLSchema#" + name[4:] if name.startswith("xsd:") else "#" + name[1:]}"/>'
    lines = [about("Class", r["class"]) for r in o["classes"].collect()]
    lines += [about("Class", r.child, to("rdfs:subClassOf", r.parent)) for r in o["subclasses"].collect()]
    lines += [about("DatatypeProperty" if r.kind == "data" else "ObjectProperty", r.property, to("rdfs:domain", r.domain) + to("rdfs:range", r.range)) for r in o["properties"].collect()]
    lines += [about("ObjectProperty", r.a, to("owl:inverseOf", r.b)) for r in o["inverses"].collect()]
    lines += [about("Class", r["class"], f'<owl:equivalentClass><owl:Restriction>{to("owl:onProperty", r.property)}{to("owl:someValuesFrom", r.filler)}</owl:Restriction></owl:equivalentClass>') for r in o["existentials"].collect()]
    return OWL[: OWL.index('  <owl:Class rdf:about="#Place"/>')] + "\n".join(lines) + "</rdf:RDF>"


def onto_classes(spark, sf_dir):
    return source.read_ontology(_owl(spark, sf_dir)).frames(spark)["classes"]


def onto_properties(spark, sf_dir):
    return source.read_ontology(_owl(spark, sf_dir)).frames(spark)["properties"].where("range is not null")


def onto_axioms(spark, sf_dir):
    o = source.read_ontology(_owl(spark, sf_dir)).frames(spark)
    return o["existentials"].select(F.col("class").alias("a"), "property", F.col("filler").alias("b")).unionByName(o["inverses"].select("a", F.lit("inverse").alias("property"), "b"))


def class_ancestors(spark, sf_dir):
    o = _found(spark, sf_dir)
    return O.ancestors(o["classes"], o["subclasses"]).select("class", "ancestor", "depth")


def class_related(spark, sf_dir):
    o = _found(spark, sf_dir)
    return O.related(o["classes"], o["subclasses"])


def class_distances(spark, sf_dir):
    o = _found(spark, sf_dir)
    return O.distances(o["classes"], o["subclasses"])


def class_resolve(spark, sf_dir):
    """Types as they are, nations in lower case and plural, and events, which are no class."""
    names = _t(spark, sf_dir, "part").select(F.regexp_replace("p_type", "[^A-Za-z0-9_]", "").alias("name"))
    names = names.unionByName(_t(spark, sf_dir, "nation").select(F.concat(F.lower(F.regexp_replace("n_name", "[^A-Za-z0-9_]", "")), F.lit("s")).alias("name")))
    names = names.unionByName(_t(spark, sf_dir, "events").select(F.concat(F.lit("event/"), "event_type").alias("name"))).distinct()
    return O.resolved(names, _found(spark, sf_dir)["classes"])


def class_links(spark, sf_dir):
    return O.linked_classes(_found(spark, sf_dir)["properties"]).select("domain", "range", F.array_join("properties", ",").alias("properties"))


def class_own_properties(spark, sf_dir):
    o = _found(spark, sf_dir)
    return O.class_properties(o["classes"], o["subclasses"], o["properties"]).select("class", "property", "depth")


def property_match_top1(spark, sf_dir):
    """Columns of each kind of part: its size, by another spelling, and its price, which no property has."""
    o = _found(spark, sf_dir)
    kinds = _t(spark, sf_dir, "part").select(_clean(F.concat_ws("_", "p_type", "p_brand")).alias("class"), F.concat(F.lit("SIZE-OF-"), "p_type").alias("column"))
    columns = kinds.unionByName(kinds.select("class", F.lit("retailprice").alias("column"))).distinct()
    found = O.data_property_matches(columns, o["classes"], o["subclasses"], o["properties"])
    return found.select("class", "column", "property", F.round("quality", 3).alias("quality"))


def object_property_top1(spark, sf_dir):
    """What links each kind of part with the nation that its key falls to."""
    o = _found(spark, sf_dir)
    pairs = _t(spark, sf_dir, "part").join(_t(spark, sf_dir, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    pairs = pairs.select(_clean(F.concat_ws("_", "p_type", "p_brand")).alias("subject"), _clean("n_name").alias("object"), F.lit("x").alias("column")).distinct()
    return O.object_property_matches(pairs, o["classes"], o["subclasses"], o["properties"]).select("subject", "object", "property", "depth")


def object_property_by_column(spark, sf_dir):
    o = _found(spark, sf_dir)
    columns = o["subclasses"].where("parent = ':Part'").select(F.col("child").alias("class"), F.concat(F.lit("has_a_Like_"), F.substr("child", F.lit(2))).alias("column"))
    columns = columns.unionByName(columns.select("class", F.lit("quantity").alias("column")))
    return O.object_properties_by_column(columns, o["classes"], o["subclasses"], o["properties"])


def most_specific_property(spark, sf_dir):
    o = _found(spark, sf_dir)
    return O.most_specific(o["classes"], o["subclasses"], o["properties"]).select("class", "range", "property", "depth")


def _references(spark, sf_dir) -> DataFrame:
    """Foreign keys as the data has them: inclusions of columns of one name but for the table's letter."""
    name = lambda c: F.regexp_replace(c, "^[a-z]_", "")
    return C.all_inclusions(spark, {t: _t(spark, sf_dir, t) for t in KEYABLE}).where(name("column") == name("parent_column"))


def inverse_guarantee(spark, sf_dir):
    links = _t(spark, sf_dir, "orders").select(F.concat(F.lit(":order/"), "o_orderkey").alias("subject"), F.lit(":placedBy").alias("property"), F.concat(F.lit(":customer/"), "o_custkey").alias("object"))
    back = links.where("object like '%1'").select(F.col("object").alias("subject"), F.lit(":placed").alias("property"), F.col("subject").alias("object"))
    return O.missing_inverses(links.unionByName(back), _onto(spark)["inverses"])


def junction_index(spark, sf_dir):
    """Tables that refer to two others, in both directions."""
    r = stored(_references(spark, sf_dir), "references")
    x, y = r.alias("x"), r.alias("y")
    both = x.join(y, (F.col("x.table") == F.col("y.table")) & (F.col("x.column") < F.col("y.column")))
    bridges = both.select(F.col("x.parent").alias("subject"), F.col("y.parent").alias("object"), F.col("x.table").alias("bridge"), F.col("x.column").alias("subject_column"), F.col("y.column").alias("object_column"))
    return O.junctions(bridges)


def pattern_classify(spark, sf_dir):
    """The patterns of the given tables, whose keys and references are found in their data: of a
    table's keys the shortest, then the first by name."""
    tables = {t: _t(spark, sf_dir, t) for t in KEYABLE}
    keys = C.all_keys(spark, tables).groupBy("table").agg(F.min(F.struct("size", "key")).alias("k")).select("table", F.split("k.key", ",").alias("key"))
    columns = spark.createDataFrame([(t, c) for t, df in tables.items() for c in df.columns], "table string, column string")
    refers = _references(spark, sf_dir).select("table", "column", F.col("parent").alias("fk_table"), F.col("parent_column").alias("fk_column"))
    catalog = columns.join(keys, "table", "left").join(refers, ["table", "column"], "left")
    catalog = catalog.select("table", "column", F.coalesce(F.array_contains("key", F.col("column")), F.lit(False)).alias("is_pk"), "fk_table", "fk_column")
    return P.classify(spark, stored(catalog, "catalog"))


# Schemas, keys, hidden classes


def schema_signature(spark, sf_dir):
    keys = spark.createDataFrame([("nation", "n_nationkey", None, None), ("nation", "n_regionkey", "region", "r_regionkey")], "table string, column string, parent string, parent_column string")
    return E.schema_signature(_small(spark, sf_dir, ("region", "nation")), keys).select("kind", "table", "place", "column")


def keys_found(spark, sf_dir):
    return R.keys_found({n: df.select(*COLUMNS[n]) for n, df in _small(spark, sf_dir, COLUMNS).items()})


def inclusions_found(spark, sf_dir):
    t = {n: df.select(*COLUMNS[n]) for n, df in _small(spark, sf_dir, COLUMNS).items()}
    return R.inclusions_found(t, R.keys_found(t))


def table_profiles(spark, sf_dir):
    p = H.table_profiles({"orders": _t(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"), "labels": _t(spark, sf_dir, "labels").select("toxic")})
    return p.select("table", "column", "total", "non_null", "n_distinct", F.array_join("values", ",").alias("values"))


_KINDS = [("orders", "o_orderstatus", "varchar", False, None), ("orders", "o_custkey", "bigint", False, "customer"), ("labels", "toxic", "integer", False, None), ("labels", "quality", "integer", False, None), ("orders", "o_orderpriority", "varchar", False, None)]


def _kinds(spark, sf_dir):
    catalog = spark.createDataFrame(_KINDS, "table string, column string, sql_type string, is_pk boolean, fk_table string")
    profiles = H.table_profiles({"orders": _t(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", "o_orderpriority"), "labels": _t(spark, sf_dir, "labels").select("toxic", "quality")})
    return catalog, profiles


def column_kinds(spark, sf_dir):
    return H.column_kinds(*_kinds(spark, sf_dir))


def hidden_evidence(spark, sf_dir):
    e = H.evidence(*_kinds(spark, sf_dir))
    return e.select("table", F.array_join(F.transform("columns", lambda c: c["column"]), ",").alias("columns"))


def accepted_suggestions(spark, sf_dir):
    catalog, profiles = _kinds(spark, sf_dir)
    s = spark.createDataFrame([("orders", "o_orderstatus", ":OpenOrder", 1), ("orders", "o_orderpriority", ":Order", 2), ("orders", "o_orderpriority", ":Buyer", 4), ("labels", "toxic", ":Nowhere", 5)], "table string, column string, class string, confidence int")
    return H.accepted(s, H.column_kinds(catalog, profiles), _onto(spark)["classes"])


def dispatched_values(spark, sf_dir):
    p = H.table_profiles({"orders": _t(spark, sf_dir, "orders").select("o_orderstatus")})
    d = spark.createDataFrame([("orders", "o_orderstatus", v, c) for v, c in (("O", ":OpenOrder"), ("F", ":FinishedOrder"), ("X", ":Nothing"))], "table string, column string, value string, class string")
    return H.dispatched_values(d, p)


def enum_sample(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return H.enum_sample(o, ["o_orderkey"]).select("column", F.array_join("values", ",").alias("values"))


# Mapping rules


def class_collisions(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("table"), F.concat(F.lit(":"), F.regexp_replace("p_brand", r"[0-9]$", "")).alias("class")).distinct()
    n = F.right("table", F.lit(1)).cast("int") % 4
    return R.class_collisions(p.withColumn("pattern", F.when(n == 0, "SRR").when(n == 1, "SEw").when(n == 2, "SE_SH").otherwise("SE")))


def type_triples(spark, sf_dir):
    from relgraph.queries import STAR, tables

    return M.triples(spark, tables(spark, sf_dir), replace(STAR, maps=tuple(m for m in STAR.maps if m.name in ("customer", "supplier", "toxic"))), {T.RDF_TYPE}).select("s", "o")


def label_triples(spark, sf_dir):
    t = _small(spark, sf_dir)
    kinds = spark.createDataFrame([(n, c, k) for n, df in t.items() for c, k in df.dtypes], "table string, column string, sql_type string")
    chosen = {r.table: r.column for r in R.label_columns(kinds).collect()}  # a column for each table
    key = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey"}
    m = Mapping(tuple(TriplesMap(n, n, f":{n}/{{{key[n]}}}", (), (("rdfs:label", Literal(chosen[n])),), key=True) for n in t if n in chosen))
    return M.triples(spark, t, m).select("s", "o")


def attr_weak_property(spark, sf_dir):
    t = {n: _t(spark, sf_dir, n) for n in ("orders", "lineitem")}
    line = TriplesMap("line", "lineitem", ":line/{l_orderkey}/{l_linenumber}", (":Line",), ((":lineStatus", Literal("l_linestatus")), ("", Literal("l_returnflag")), (":of", Reference("orders", (("l_orderkey", "o_orderkey"),)))))
    orders = TriplesMap("orders", "orders", ":order/{o_orderkey}", (":Order",), key=True)
    weak = R.weak_property(Mapping((orders, line)), line, "orders", (("l_orderkey", "o_orderkey"),))
    return M.triples(spark, t, Mapping((weak,))).select("s", "p", "o")


def mapping_coverage(spark, sf_dir):
    from relgraph.queries import STAR, graph

    want = [("class", c) for c in (":Customer", ":Order", ":Nothing")] + [("property", p) for p in (":placedBy", ":inRegion", ":none")]
    g = graph(spark, sf_dir, {T.RDF_TYPE, ":placedBy", ":inRegion"})
    return R.coverage(g, spark.createDataFrame(want, "kind string, name string"))


def mapping_issues(spark, sf_dir):
    t = _small(spark, sf_dir)
    maps = (
        TriplesMap("good", "nation", ":n/{n_nationkey}", (), ((":name", Literal("n_name")),)),
        TriplesMap("no_column", "nation", ":n/{n_nationkey}", (), ((":name", Literal("nope")),)),
        TriplesMap("no_table", "SELECT * FROM nowhere_at_all", ":n/{x}"),
        TriplesMap("child", "customer", ":c/{c_custkey}", (), ((":in", Reference("no_column", (("c_nationkey", "n_nationkey"),))),)),
        TriplesMap("bad_join", "customer", ":c/{c_custkey}", (), ((":in", Reference("good", (("c_nationkey", "zz"),))),)),
    )
    return spark.createDataFrame([(m,) for m, _ in R.validity(spark, t, Mapping(maps))], "map string")


def r2rml_round_trip(spark, sf_dir):
    from relgraph.queries import STAR, TABLES, tables

    back = r2rml.from_turtle(r2rml.to_turtle(STAR), TABLES)
    return M.triples(spark, tables(spark, sf_dir), back).groupBy("p").agg(F.count("*").alias("n"))


def query_pairs(spark, sf_dir):
    """(pair, same): each of the pattern queries against its SQL, both run by Spark."""
    from relgraph import queries as Q

    t, sql, out = Q.tables(spark, sf_dir), Q.own_sql(), None
    for name in ("link_path1", "link_path3", "group_count"):
        text = sql[name]
        for n in Q.TABLES:
            text = re.sub(rf"\b(FROM|JOIN) {n}\b", r"\1 {" + n + "}", text)
        expected = spark.sql(text, **{n: d for n, d in t.items() if "{" + n + "}" in text})
        differ = E.bag_diff(expected, Q.PATTERNS[name](spark, sf_dir).select(*expected.columns))
        row = differ.agg((F.count("*") == 0).alias("same")).select(F.lit(name).alias("pair"), "same")
        out = row if out is None else out.unionByName(row)
    return out


# Relational surface


def empty_values(spark, sf_dir):
    """Whether a text column has values of white space only."""
    return _t(spark, sf_dir, "documents").agg(F.bool_or(F.btrim(F.col("text").cast("string")) == "").alias("found")).select(F.coalesce("found", F.lit(False)).alias("found"))


def natural_join(spark, sf_dir):
    a, b = _t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels")
    return a.join(b, "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


def weak_owner_join(spark, sf_dir):
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def bridge_filter_distinct(spark, sf_dir):
    li, p = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    return li.join(p.where("p_size > 40"), li["l_partkey"] == p["p_partkey"], "left_semi").select("l_suppkey").distinct()


def latest_by_hash(spark, sf_dir):
    """Last write wins: of rows with one hash of their key, the one that came last."""
    c = _t(spark, sf_dir, "conversations").select(F.sha2(F.concat_ws("|", "role", "text"), 256).alias("hash"), "conv_id", "turn")
    return c.groupBy("hash").agg(F.max(F.struct("conv_id", "turn")).alias("x")).select("hash", "x.*")


# Reports


def _lines(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    label = F.when(F.col("s_suppkey") % 5 == 0, "All (AVG)").when(F.col("s_suppkey") % 5 == 1, "joins (AVG)").otherwise(F.concat(F.lit("Q"), (F.col("s_suppkey") % 12).cast("string")))
    f1 = F.when(F.col("s_suppkey") % 7 > 0, (F.col("s_suppkey") % 10) / 10)
    return s.select(F.concat(F.lit("d"), F.col("s_nationkey")).alias("dataset"), label.alias("label"), f1.alias("f1"), f1.alias("precision"), f1.alias("recall"), F.col("s_suppkey").alias("position"))


def report_overall(spark, sf_dir):
    return E.overall(_lines(spark, sf_dir)).select("dataset", "f1")


def report_grand_mean(spark, sf_dir):
    g = E.grand_mean(_lines(spark, sf_dir), "dataset", "f1")
    return g.select("groups", F.round("mean", 9).alias("mean"))


def report_visible(spark, sf_dir):
    return E.visible(_lines(spark, sf_dir), "dataset", "f1", "complete").groupBy("dataset").agg(F.count("*").alias("n"))


def report_by_coverage(spark, sf_dir):
    return E.by_coverage(_lines(spark, sf_dir), "dataset", "f1")


def report_categories(spark, sf_dir):
    x = _lines(spark, sf_dir).withColumn("categories", F.split(F.concat("label", F.lit(","), "dataset"), ","))
    return E.by_category(x, "categories", "f1").select("category", "n", F.round("mean", 9).alias("mean"))


def report_lines_order(spark, sf_dir):
    return E.report_order(_lines(spark, sf_dir).select("label", "position"))


def natural_order(spark, sf_dir):
    return E.natural_order(_t(spark, sf_dir, "supplier").select(F.concat(F.lit("Q"), "s_suppkey").alias("name")), "name")


def report_families(spark, sf_dir):
    x = E.labelled(_t(spark, sf_dir, "part").select("p_type"), "p_type", {"STANDARD": "standard", "SMALL": "small"}, {"TIN": "tin", "STEEL": "steel"})
    return x.groupBy("family", "variant").agg(F.count("*").alias("n"))


def result_hash_equal(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    a, b, c = (E.result_hash(x).select("hash") for x in (n, n.orderBy(F.desc("n_name")), n.where("n_nationkey > 0")))
    return a.join(b.withColumnRenamed("hash", "h2"), F.col("hash") == F.col("h2"), "left").select(F.col("h2").isNotNull().alias("same")).unionByName(a.join(c.withColumnRenamed("hash", "h2"), F.col("hash") == F.col("h2"), "left").select(F.col("h2").isNotNull().alias("same")))


def name_forms(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_type").distinct()
    x = F.regexp_replace("p_type", " ", "_")
    return p.select("p_type", T.camel_case(F.lower(x)).alias("camel"), T.loose_name(x).alias("loose"), T.canonical_name(F.concat(x, F.lit("s"))).alias("canonical"), T.content_name(F.concat(F.lit("type_of_"), x)).alias("content"), T.without_prefix(F.concat(F.lit("has_a_"), x)).alias("bare"), T.local_name(F.concat(F.lit("urn:x#"), x)).alias("local"))


def sql_values(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return n.select("n_nationkey", T.sql_literal(F.concat(F.lit(' "'), "n_name", F.lit('"  x')), F.lit("varchar(9)")).alias("text"), T.sql_literal(F.col("n_nationkey"), F.lit("integer")).alias("number"), T.sql_literal(F.col("n_nationkey") % 2, F.lit("boolean")).alias("truth"))


ALL = (onto_classes, onto_properties, onto_axioms, class_ancestors, class_related, class_distances, class_resolve, class_links, class_own_properties, property_match_top1, pattern_classify, object_property_top1, object_property_by_column, most_specific_property, inverse_guarantee, junction_index, schema_signature, keys_found, inclusions_found, table_profiles, column_kinds, hidden_evidence, accepted_suggestions, dispatched_values, enum_sample, class_collisions, type_triples, label_triples, attr_weak_property, mapping_coverage, mapping_issues, r2rml_round_trip, query_pairs, empty_values, natural_join, weak_owner_join, bridge_filter_distinct, latest_by_hash, report_overall, report_grand_mean, report_visible, report_by_coverage, report_categories, report_lines_order, natural_order, report_families, result_hash_equal, name_forms, sql_values)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    classes = [":Buyer", ":Customer", ":Nation", ":OpenOrder", ":Order", ":Party", ":Place", ":Region", ":Supplier"]
    up = [(":Customer", ":Party"), (":Nation", ":Place"), (":OpenOrder", ":Order"), (":Region", ":Place"), (":Supplier", ":Party")]
    c, e = f"c AS ({_values([(x,) for x in classes], 'class')})", f"e AS ({_values(up, 'child, parent')})"
    lines = "(SELECT 'd' || s_nationkey AS dataset, CASE WHEN s_suppkey % 5 = 0 THEN 'All (AVG)' WHEN s_suppkey % 5 = 1 THEN 'joins (AVG)' ELSE 'Q' || (s_suppkey % 12) END AS label, CASE WHEN s_suppkey % 7 > 0 THEN (s_suppkey % 10) / 10 END AS f1, s_suppkey AS position FROM supplier)"
    whole = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "supplier": ["s_suppkey", "s_nationkey"]}
    inclusion = [
        f"SELECT '{a}' AS \"table\", '{x}' AS \"column\", '{b}' AS parent, '{y}' AS parent_column WHERE (SELECT count(*) = count(DISTINCT {y}) FROM {b}) AND NOT EXISTS (SELECT 1 FROM {a} WHERE {x} NOT IN (SELECT {y} FROM {b}))"
        for a, xs in whole.items() for x in xs for b, ys in whole.items() if a != b for y in ys
    ]
    profile = lambda t, col: f"SELECT '{t}' AS \"table\", '{col}' AS \"column\", count(*) AS total, count({col}) AS non_null, count(DISTINCT {col}) AS n_distinct, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {col}::VARCHAR AS v FROM {t} WHERE {col} IS NOT NULL ORDER BY v LIMIT 4)) AS values FROM {t}"
    from relgraph.queries import own_sql

    clean = "(':' || regexp_replace({}, '[^A-Za-z0-9_]', '', 'g'))".format
    kind, nation = clean("p_type || '_' || p_brand"), clean("n_name")
    h = f"""t AS (SELECT DISTINCT p_type AS raw, {clean("p_type")} AS t, {kind} AS tb FROM part),
        n AS (SELECT {nation} AS n, {clean("r_name")} AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
        e AS (SELECT tb AS child, t AS parent FROM t UNION SELECT t, ':Part' FROM t UNION SELECT n, r FROM n UNION SELECT r, ':Place' FROM n),
        c AS (SELECT child AS class FROM e UNION SELECT parent FROM e), x AS (SELECT ':Local_' || n[2:] AS l, ':made_in_' || n[2:] AS m, ':makes_' || n[2:] AS k, n FROM n),
        p AS (SELECT DISTINCT ':size_of_' || t[2:] AS property, 'data' AS kind, t AS domain, 'xsd:integer' AS range FROM t UNION ALL SELECT DISTINCT ':like_' || t[2:], 'object', t, ':Part' FROM t
              UNION ALL SELECT m, 'object', ':Part', n FROM x UNION ALL SELECT DISTINCT ':sold_in_' || r[2:], 'object', ':Part', r FROM n)"""
    up = "r AS (SELECT class, class AS ancestor, 0 AS depth FROM c UNION SELECT r.class, e.parent, r.depth + 1 FROM r JOIN e ON e.child = r.ancestor)"
    references = f"""SELECT * FROM ({_inclusions_sql()}) WHERE regexp_replace("column", '^[a-z]_', '') = regexp_replace(parent_column, '^[a-z]_', '')"""
    return {
        "pattern_classify": f"""
            WITH i AS ({references}), k AS (SELECT "table", string_split(key, ',') AS key FROM ({_keys_sql()}) QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY size, key) = 1),
            d AS (SELECT table_name AS "table", column_name AS "column" FROM duckdb_columns() WHERE table_name IN ({', '.join(f"'{t}'" for t in KEYABLE)})),
            f AS (SELECT d."table", d."column", coalesce(list_contains(k.key, d."column"), false) AS pk, i.parent FROM d LEFT JOIN k ON k."table" = d."table" LEFT JOIN i ON i."table" = d."table" AND i."column" = d."column"),
            g AS (SELECT "table", count(*) FILTER (pk) AS pks, count(*) FILTER (pk AND parent IS NOT NULL) AS fks, count(*) FILTER (NOT pk) AS rest, count(DISTINCT parent) FILTER (pk) AS parents,
                         "table" IN (SELECT parent FROM f WHERE parent <> "table") AS referred FROM f GROUP BY "table")
            SELECT "table", CASE WHEN pks > 1 AND pks = fks AND NOT referred THEN CASE WHEN rest = 0 THEN 'SR' ELSE 'SRR' END WHEN pks > 1 AND fks BETWEEN 1 AND pks - 1 AND NOT referred THEN 'SEw'
                                 WHEN pks = 1 AND fks = 1 THEN 'SE_SH' ELSE 'SE' END AS pattern FROM g""",
        "onto_classes": f"WITH {h} SELECT class FROM c UNION SELECT l FROM x",
        "onto_properties": f"WITH {h} SELECT property, kind, domain, range FROM p",
        "onto_axioms": f"WITH {h} SELECT l AS a, m AS property, n AS b FROM x UNION ALL SELECT least(m, k), 'inverse', greatest(m, k) FROM x",
        "class_ancestors": f"WITH RECURSIVE {h}, {up} SELECT * FROM r",
        "class_related": f"WITH RECURSIVE {h}, {up} SELECT class, ancestor AS other, 'ancestor' AS relation FROM r WHERE depth > 0 UNION ALL SELECT ancestor, class, 'descendant' FROM r WHERE depth > 0",
        "class_distances": f"WITH RECURSIVE {h}, u AS (SELECT child AS a, parent AS b FROM e UNION SELECT parent, child FROM e), r AS (SELECT class, class AS other, 0 AS depth FROM c UNION SELECT r.class, u.b, r.depth + 1 FROM r JOIN u ON u.a = r.other WHERE r.depth < 4) SELECT class, other, min(depth) AS depth FROM r GROUP BY class, other",
        "class_resolve": f"WITH {h} SELECT DISTINCT t[2:] AS name, t AS class FROM t UNION ALL SELECT lower(n[2:]) || 's', n FROM n UNION ALL SELECT DISTINCT 'event/' || event_type, NULL FROM events",
        "class_links": f"WITH {h} SELECT domain, range, string_agg(property, ',' ORDER BY property) AS properties FROM p WHERE kind = 'object' GROUP BY domain, range",
        "class_own_properties": f"WITH RECURSIVE {h}, {up} SELECT class, property, depth FROM r JOIN p ON p.domain = r.ancestor",
        "property_match_top1": f"WITH {h} SELECT DISTINCT tb AS class, 'SIZE-OF-' || raw AS \"column\", ':size_of_' || t[2:] AS property, 1.0::DOUBLE AS quality FROM t UNION ALL SELECT DISTINCT tb, 'retailprice', NULL, NULL FROM t",
        "object_property_top1": f"WITH {h} SELECT DISTINCT {kind} AS subject, {nation} AS object, ':made_in_' || {nation}[2:] AS property, 2 AS depth FROM part JOIN nation ON p_partkey % 25 = n_nationkey",
        "object_property_by_column": f"WITH {h} SELECT DISTINCT t AS class, 'has_a_Like_' || t[2:] AS \"column\", ':like_' || t[2:] AS property FROM t UNION ALL SELECT DISTINCT t, 'quantity', NULL FROM t",
        "most_specific_property": f"WITH RECURSIVE {h}, {up}, b AS (SELECT * FROM r UNION SELECT ancestor, class, depth FROM r), f AS (SELECT class, range, property, min(depth) AS depth FROM b JOIN p ON p.domain = b.ancestor WHERE kind = 'object' GROUP BY class, range, property) SELECT class, range, property, depth FROM f QUALIFY rank() OVER (PARTITION BY class, range ORDER BY depth) = 1",
        "inverse_guarantee": "SELECT ':customer/' || o_custkey AS subject, ':placed' AS property, ':order/' || o_orderkey AS object FROM orders WHERE o_custkey % 10 <> 1",
        "junction_index": f"WITH i AS ({references}), b AS (SELECT x.parent AS subject, y.parent AS object, x.\"table\" AS bridge, x.\"column\" AS subject_column, y.\"column\" AS object_column FROM i x JOIN i y ON x.\"table\" = y.\"table\" AND x.\"column\" < y.\"column\") SELECT * FROM b UNION SELECT object, subject, bridge, object_column, subject_column FROM b",
        "schema_signature": "SELECT 'COLUMN' AS kind, table_name AS \"table\", ordinal_position AS place, column_name AS \"column\" FROM information_schema.columns WHERE table_name IN ('region', 'nation') UNION ALL SELECT 'PK', 'nation', 0, 'n_nationkey' UNION ALL SELECT 'FK', 'nation', 0, 'n_regionkey'",
        "keys_found": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{x}' AS \"column\" FROM {t} HAVING count(*) = count(DISTINCT {x}) AND count(*) > 0" for t, cols in COLUMNS.items() for x in cols),
        "inclusions_found": " UNION ALL ".join(inclusion),
        "table_profiles": " UNION ALL ".join(profile(t, x) for t, x in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("labels", "toxic"))),
        "column_kinds": _values([("orders", "o_orderstatus", "type_dispatch_t2"), ("orders", "o_custkey", "fk_ref"), ("labels", "toxic", "bool_flag"), ("labels", "quality", "bool_flag"), ("orders", "o_orderpriority", "other")], '"table", "column", kind'),
        "hidden_evidence": _values([("orders", "o_custkey,o_orderstatus"), ("labels", "quality,toxic")], '"table", columns'),
        "accepted_suggestions": _values([("orders", "o_orderstatus", ":OpenOrder", 1), ("orders", "o_orderpriority", ":Buyer", 4)], '"table", "column", class, confidence'),
        "dispatched_values": "SELECT DISTINCT 'orders' AS \"table\", 'o_orderstatus' AS \"column\", o_orderstatus AS value, CASE o_orderstatus WHEN 'O' THEN ':OpenOrder' ELSE ':FinishedOrder' END AS class FROM orders WHERE o_orderstatus IN ('O', 'F', 'X')",
        "enum_sample": "WITH f AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 200), v AS (SELECT 'o_orderstatus' AS c, o_orderstatus AS v FROM f UNION SELECT 'o_orderpriority', o_orderpriority FROM f UNION SELECT 'o_orderkey', o_orderkey::VARCHAR FROM f) SELECT c AS \"column\", string_agg(v, ',' ORDER BY v) AS values FROM v GROUP BY c HAVING count(*) <= 15",
        "class_collisions": "WITH p AS (SELECT DISTINCT p_brand AS t, ':' || regexp_replace(p_brand, '[0-9]$', '') AS c FROM part), k AS (SELECT *, count(*) OVER (PARTITION BY c) AS n, row_number() OVER (PARTITION BY c ORDER BY CASE right(t, 1)::INT % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END, t) AS r FROM p) SELECT c AS class, t AS \"table\", r = 1 AS winner FROM k WHERE n > 1",
        "type_triples": "SELECT ':customer/' || c_custkey AS s, ':Customer' AS o FROM customer UNION ALL SELECT ':supplier/' || s_suppkey, ':Supplier' FROM supplier UNION ALL SELECT DISTINCT ':document/' || doc_id, ':ToxicDocument' FROM labels WHERE toxic = 1",
        "label_triples": "SELECT ':region/' || r_regionkey AS s, r_name AS o FROM region UNION ALL SELECT ':nation/' || n_nationkey, n_name FROM nation UNION ALL SELECT ':customer/' || c_custkey, c_name FROM customer UNION ALL SELECT ':supplier/' || s_suppkey, s_name FROM supplier",
        "attr_weak_property": "SELECT DISTINCT ':order/' || l_orderkey AS s, ':lineStatus' AS p, l_linestatus AS o FROM lineitem UNION ALL SELECT DISTINCT ':order/' || l_orderkey, ':lineitem', l_returnflag FROM lineitem",
        "mapping_coverage": "SELECT *, CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS state FROM (SELECT 'class' AS kind, ':Customer' AS name, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'class', ':Order', (SELECT count(*) FROM orders) UNION ALL SELECT 'class', ':Nothing', 0 UNION ALL SELECT 'property', ':placedBy', (SELECT count(*) FROM orders) UNION ALL SELECT 'property', ':inRegion', (SELECT count(*) FROM nation) UNION ALL SELECT 'property', ':none', 0)",
        "mapping_issues": _values([("bad_join",), ("child",), ("no_column",), ("no_table",)], "map"),
        "r2rml_round_trip": own_sql()["triples_by_predicate"],
        "query_pairs": _values([("link_path1", True), ("link_path3", True), ("group_count", True)], "pair, same"),
        "empty_values": "SELECT coalesce(bool_or(trim(text) = ''), false) AS found FROM documents",
        "natural_join": "SELECT lang, count(*) AS n FROM (SELECT doc_id, lang FROM documents) NATURAL JOIN labels GROUP BY lang",
        "weak_owner_join": "SELECT o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
        "bridge_filter_distinct": "SELECT DISTINCT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40",
        "latest_by_hash": "SELECT hash, conv_id, turn FROM (SELECT sha256(concat_ws('|', role, text)) AS hash, conv_id, turn FROM conversations) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY conv_id DESC, turn DESC) = 1",
        "report_overall": f"SELECT dataset, f1 FROM {lines} WHERE label = 'All (AVG)' QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY position) = 1",
        "report_grand_mean": f"SELECT count(m) AS groups, round(avg(m), 9) AS mean FROM (SELECT avg(f1) AS m FROM {lines} GROUP BY dataset)",
        "report_visible": f"SELECT dataset, count(*) AS n FROM {lines} GROUP BY dataset HAVING count(f1) = count(*)",
        "report_by_coverage": f"SELECT dataset, count(f1) AS filled, count(*) AS cells, row_number() OVER (ORDER BY count(f1) DESC, dataset) AS place FROM {lines} GROUP BY dataset",
        "report_categories": f"SELECT category, count(*) AS n, round(avg(f1), 9) AS mean FROM (SELECT label AS category, f1 FROM {lines} UNION ALL SELECT dataset, f1 FROM {lines}) GROUP BY category",
        "report_lines_order": f"SELECT label, bucket, row_number() OVER (ORDER BY bucket, p) AS place FROM (SELECT label, CASE WHEN label = 'All (AVG)' THEN 0 WHEN label LIKE 'Q%' THEN 1 ELSE 2 END AS bucket, min(position) AS p FROM {lines} GROUP BY label)",
        "natural_order": "SELECT 'Q' || s_suppkey AS name, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier",
        "report_families": "SELECT CASE WHEN p_type LIKE 'STANDARD%' THEN 'standard' WHEN p_type LIKE 'SMALL%' THEN 'small' ELSE 'other' END AS family, CASE WHEN p_type LIKE '%TIN' THEN 'tin' WHEN p_type LIKE '%STEEL' THEN 'steel' ELSE 'other' END AS variant, count(*) AS n FROM part GROUP BY ALL",
        "result_hash_equal": _values([(True,), (False,)], "same"),
        "name_forms": "WITH p AS (SELECT DISTINCT p_type, replace(p_type, ' ', '_') AS x, lower(replace(p_type, ' ', '')) AS l FROM part) SELECT p_type, split_part(lower(x), '_', 1) || coalesce(array_to_string(list_transform(string_split(lower(x), '_')[2:], lambda w: upper(w[1]) || w[2:]), ''), '') AS camel, l AS loose, regexp_replace(l, 's+$', '') AS canonical, 'type' || l AS content, x AS bare, x AS local FROM p",
        "sql_values": "SELECT n_nationkey, '''' || n_name || ' x''' AS text, n_nationkey::VARCHAR AS number, CASE WHEN n_nationkey % 2 = 1 THEN 'true' ELSE 'false' END AS truth FROM nation",
    }
