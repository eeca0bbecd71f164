import pytest
from pyspark.sql import functions as F

from relgraph.functions.terms import iri_safe, normal_identifier, template
from relgraph.operators import evaluate as E
from relgraph.operators import materialize as M
from relgraph.operators import profile as P
from relgraph.plans.patterns import Value, evaluate, expanded, unfold
from relgraph.plans.mapping import Dispatch, Literal, Mapping, Reference, Template, TriplesMap
from relgraph.sources import dump
from relgraph.sources.r2rml import to_turtle

MAPPING = Mapping(
    (
        TriplesMap("org", "org", ":org/{id}", (":Org",), ((":name", Literal("name")),)),
        TriplesMap("person", "person", ":p/{id}", (":Person",), ((":name", Literal("name")), (":age", Literal("age")), (":worksAt", Reference("org", (("org", "id"),))), (":gone", Literal("no_such_column"))), dispatch=Dispatch("kind", ((1, ":Chair"), (2, ":Member")))),
    ),
    subclasses=((":Chair", ":Person"), (":Person", ":Agent"), (":Agent", ":Person")),
    inverses=((":worksAt", ":employs"),),
    existentials=((":Employer", ":employs", ":Person"),),
)


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "org": spark.createDataFrame([(1, "A b"), (2, None)], "id int, name string"),
        "person": spark.createDataFrame([(1, "x", 30, 1, 1), (2, None, None, 2, 9), (3, "y", 31, None, None), (3, "y", 31, None, None), (None, "z", 1, 1, 1)], "id int, name string, age int, kind int, org int"),
    }


def test_iri_encoding_keeps_unreserved_and_non_ascii(spark):
    got = spark.createDataFrame([("a b*~é/x",), ("",), (None,), ("plain-1.2_3",), ("100%",)], "v string").select(iri_safe(F.col("v")).alias("v"))
    assert [r.v for r in got.collect()] == ["a%20b%2A~é%2Fx", "", None, "plain-1.2_3", "100%25"]


def test_template_with_null_is_null(spark):
    got = spark.createDataFrame([(1, "q r"), (None, "q")], "a int, b string").select(template(":t/{a}/{b}").alias("v"))
    assert [r.v for r in got.collect()] == [":t/1/q%20r", None]


def test_triples_are_a_set_without_nulls(spark, tables):
    t = M.triples(spark, tables, MAPPING)
    rows = {(r.s, r.p, r.o) for r in t.collect()}
    assert t.count() == len(rows) and all(None not in r for r in rows)
    assert (":p/1", ":worksAt", ":org/1") in rows and not any(r[2] == ":org/9" for r in rows)
    assert (":p/2", "rdf:type", ":Member") in rows and (":p/3", ":age", "31") in rows
    assert not any(r[1] == ":gone" for r in rows)


def test_elided_reference_needs_no_join(spark, tables):
    total = Mapping((MAPPING.maps[0], TriplesMap("person", "person", ":p/{id}", (), ((":worksAt", Reference("org", (("org", "id"),), True)),))))
    plan = M.triples(spark, tables, total, {":worksAt"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_entailment_inverses_axioms_and_cyclic_classes(spark, tables):
    rows = {(r.s, r.p, r.o) for r in M.entailed(spark, M.triples(spark, tables, MAPPING), MAPPING).collect()}
    assert (":org/1", ":employs", ":p/1") in rows and (":org/1", "rdf:type", ":Employer") in rows
    assert (":p/1", "rdf:type", ":Agent") in rows


def test_entailment_of_tables_equals_that_of_their_triples(spark, tables):
    for mapping in (MAPPING, KEYED):
        want = {tuple(r) for r in M.entailed(spark, M.triples(spark, tables, mapping), mapping).collect()}
        got = [tuple(r) for r in M.entail(spark, tables, mapping).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        some = {tuple(r) for r in M.entail(spark, tables, mapping, {":employs", "rdf:type"}, {":Agent", ":Host"}).collect()}
        assert some == {t for t in want if t[1] == ":employs" or t[1] == "rdf:type" and t[2] in (":Agent", ":Host")}


def test_entailment_of_a_class_defined_by_itself(spark):
    """Whoever manages a manager of a leaf is a manager, to any depth and around a ring."""
    rows = [(i, i + 1) for i in range(12)] + [(20, 21), (21, 20), (30, 31), (99, 12)]
    t = {"boss": spark.createDataFrame(rows, "id int, of int"), "leaf": spark.createDataFrame([(12,)], "id int")}
    maps = (TriplesMap("boss", "boss", ":p/{id}", (), ((":manages", Template(":p/{of}")),)), TriplesMap("leaf", "leaf", ":p/{id}", (":Lead",)))
    mapping = Mapping(maps, existentials=((":Lead", ":manages", ":Lead"),))
    got = {r.s for r in M.entail(spark, t, mapping, {"rdf:type"}).collect()}
    assert got == {f":p/{i}" for i in [*range(13), 99]}
    with pytest.raises(ValueError):
        unfold(spark, t, mapping, [("?x", "a", ":Lead")], True)


def test_closure_has_no_deepest_level(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(70)] + [("x", "y"), ("y", "z"), ("z", "x"), ("l", "l")]
    got = {(r.child, r.ancestor): r.depth for r in M.closure(spark, edges).collect()}
    want = {(f"c{i}", f"c{j}"): j - i for i in range(71) for j in range(i + 1, 71)}
    ring = {("x", "y"): 1, ("y", "z"): 1, ("z", "x"): 1, ("x", "z"): 2, ("y", "x"): 2, ("z", "y"): 2, ("l", "l"): 1}
    assert got == want | ring and M.closure(spark, []).count() == 0


def test_patterns_over_triples(spark, tables):
    g = M.triples(spark, tables, MAPPING)
    ask = lambda *q: evaluate(g, list(q))
    assert [r.n for r in ask(*expanded([("?p", "a", "x:Person"), ("?p", "x:name", "?n"), ("?p", "x:worksAt", "?o"), ("?o", "x:name", Value("A b"))], {"x": ":"})).collect()] == ["x"]
    assert ask(("?p", ":age", "?a")).where("cast(a as int) > 30").count() == 1
    best = ask(("?p", "a", "?c")).groupBy("c").count().orderBy(F.desc("count")).first()
    assert tuple(best) == (":Person", 3)
    with pytest.raises(ValueError):
        ask(("?a", "a", ":Org"), ("?b", "a", ":Person"))


KEYED = Mapping(
    (
        TriplesMap("org", "org", ":org/{id}", (":Org",), ((":name", Literal("name")),), key=True),
        TriplesMap("person", "person", ":p/{id}", (":Person",), ((":name", Literal("name")), (":age", Literal("age")), (":worksAt", Reference("org", (("org", "id"),)))), dispatch=Dispatch("kind", ((1, ":Chair"), (2, ":Member")))),
        TriplesMap("boss", "person", ":p/{id}", (":Boss",), ((":name", Literal("name")), (":orgName", Reference("org", (("name", "name"),)))), where="age > 30"),
    ),
    subclasses=((":Chair", ":Person"), (":Person", ":Agent"), (":Boss", ":Person"), (":Employer", ":Host"), (":Host", ":Agent"), (":Paid", ":Agent")),
    inverses=((":worksAt", ":employs"),),
    existentials=((":Employer", ":employs", ":Person"), (":Paid", ":worksAt", ":Employer")),
    domains=((":age", ":Aged"),),
    ranges=((":worksAt", ":Place"),),
)


@pytest.fixture(scope="module")
def graphs(spark, tables):
    """The triples of KEYED as they are, and with what they entail."""
    plain = M.triples(spark, tables, KEYED)
    return {e: spark.createDataFrame(g.collect(), M.SCHEMA) for e, g in ((False, plain), (True, M.entailed(spark, plain, KEYED)))}


@pytest.mark.parametrize("entail", [False, True])
@pytest.mark.parametrize(
    "patterns",
    [
        [("?x", "a", ":Person")],
        [("?x", "a", ":Person"), ("?x", ":name", "?n"), ("?x", ":age", "?a")],
        [("?x", ":worksAt", "?o"), ("?o", ":name", "?n")],
        [("?x", ":name", "?n"), ("?y", ":name", "?n")],
        [("?x", "a", ":Chair"), ("?x", ":worksAt", "?o"), ("?y", ":worksAt", "?o")],
        [("?x", "a", "?c"), ("?x", ":name", Value("y"))],
        [(":p/1", ":name", "?n")],
        [("?x", "a", ":Agent"), ("?x", ":name", "?n")],
        [("?o", ":employs", "?p"), ("?p", "a", ":Person")],
        [("?o", "a", ":Employer"), ("?o", ":name", "?n")],
        [("?x", ":orgName", "?o"), ("?x", "a", ":Boss")],
        [("?x", ":worksAt", ":org/1"), ("?x", ":age", "?a")],
        [("?x", "a", "?c")],
        [("?x", "a", ":Host"), ("?x", ":name", "?n")],
        [("?x", "a", ":Paid"), ("?x", "a", ":Aged"), ("?x", ":worksAt", "?o"), ("?o", "a", ":Place")],
    ],
)
def test_unfolding_equals_triples(spark, tables, graphs, patterns, entail):
    want = evaluate(graphs[entail], patterns)
    got = unfold(spark, tables, KEYED, patterns, entail)
    names = sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df.select(*names).collect()), key=str)
    assert rows(got) == rows(want)


def test_unfolded_stars_read_a_table_once(spark, tables):
    m = Mapping((TriplesMap("person", "person", ":p/{id}", (":Person",), ((":name", Literal("name")), (":age", Literal("age"))), key=True), TriplesMap("org", "org", ":org/{id}", (":Org",), ((":name", Literal("name")),), key=True)))
    plan = unfold(spark, tables, m, [("?x", "a", ":Person"), ("?x", ":name", "?n"), ("?x", ":age", "?a")])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("LogicalRDD") <= 1


def test_unfolded_types_of_a_rule_are_made_once_for_all_its_classes(spark):
    tables = {"person": spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, name string")}
    m = Mapping((TriplesMap("person", "person", ":p/{id}", (":Person",), ((":name", Literal("name")),), key=True),), subclasses=((":Named", ":Thing"),), domains=((":name", ":Named"),))
    got = unfold(spark, tables, m, [("?x", "a", "?c")], True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2 and plan.count("Aggregate") == 1  # direct types are a set
    want = {(f":p/{r.id}", c) for r in tables["person"].collect() for c in ([":Person"] + [":Named", ":Thing"] * (r.name is not None))}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_profile_keys_and_patterns(spark, tables):
    p = {r.column: r for r in P.profile(tables["person"], ["id", "name"]).collect()}
    assert (p["id"].total, p["id"].non_null, p["id"].n_distinct, p["id"].top) == (5, 4, 3, "3")
    assert [r.unique for r in P.key_candidates(tables["org"], [["id"], ["name"]]).collect()] == [True, False]
    r = P.inclusion(tables["person"], "org", tables["org"], "id").first()
    assert (r.orphans, r.holds) == (1, False)


def test_scores(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    r = E.prf1(a, b).first()
    assert (r.precision, round(r.recall, 4), round(r.f1, 4)) == (0.5, 0.3333, 0.4)
    assert E.prf1(a.limit(0), b.limit(0)).first().f1 is None and E.prf1(a, b.limit(0)).first().f1 == 0
    assert {tuple(r) for r in E.bag_diff(a, b).collect()} == {(1, 2, 1), (2, 1, 0), (3, 0, 1)}
    s = E.scores(spark.createDataFrame([("All (AVG)|0.5|NaN|1",), ("bad",)], "value string")).collect()
    assert len(s) == 1 and s[0].precision is None


def test_identifiers(spark):
    got = spark.createDataFrame([("Has-A Name",), ("2nd",), ("Select",), ("__x__",)], "v string").select(normal_identifier(F.col("v")).alias("v"))
    assert [r.v for r in got.collect()] == ["has_a_name", "_2nd", "select_", "x"]


DDL = """
SET search_path = demo;
CREATE TABLE demo."Org-x" ( id integer PRIMARY KEY, "a-b" character varying(20) DEFAULT 'q,(r' NOT NULL );
CREATE TABLE link ( p int, q int REFERENCES "Org-x", ok boolean, CONSTRAINT k PRIMARY KEY (p, q), seen timestamp with time zone );
ALTER TABLE ONLY link ADD CONSTRAINT f FOREIGN KEY (p) REFERENCES demo."Org-x"(id) ON DELETE CASCADE;
COPY link (p, q, ok, seen) FROM stdin;
1\t2\tt\t\\N
3\t\\N\tf\t2020-01-02 03:04:05
\\.
"""


def test_dump(spark, tmp_path):
    t = dump.parse_ddl(DDL)
    assert t["Org-x"].key == ["id"] and [c.name for c in t["Org-x"].columns] == ["id", "a-b"]
    assert t["link"].key == ["p", "q"] and sorted(t["link"].foreign) == [(["p"], "Org-x", ["id"]), (["q"], "Org-x", ["id"])]
    assert {r.table: r.pattern for r in P.classify(spark, dump.catalog(spark, t)).collect()} == {"Org-x": "SE", "link": "SRR"}
    (tmp_path / "d.sql").write_text(DDL)
    rows = dump.copy_rows(spark, str(tmp_path / "d.sql"), t)["link"].collect()
    assert [(r.p, r.q, r.ok) for r in rows] == [(1, 2, True), (3, None, False)]


def test_qpair():
    q = dump.read_qpair("name=Q1 (x)\nsql=select 1\\n\\\n from t\nsparql=SELECT ?x WHERE { ?x a \\:C }\ncategories=class, link\n")
    assert q["sql"].split() == ["select", "1", "from", "t"] and q["categories"] == ["class", "link"] and not q["disabled"]


def test_turtle_names_every_map():
    text = to_turtle(MAPPING)
    assert text.count("rr:TriplesMap ;") == 2 and 'rr:template "urn:graph#p/{id}"' in text and "rr:joinCondition" in text


def test_turtle_has_classes_by_value_and_plain_table_names(spark, tables):
    import re

    query = Mapping((TriplesMap("q", "SELECT id, kind FROM {person} WHERE age > 0", ":q/{id}", where="id > 1"), MAPPING.maps[1]))
    text = to_turtle(query)
    one, two = re.findall(r'rr:sqlQuery "(.*)" \]', text)
    assert "{person}" not in text and 'rr:predicate rdf:type ; rr:objectMap [ rr:column "class_by_value" ; rr:termType rr:IRI ]' in text
    tables["person"].createOrReplaceTempView("person")
    assert [r.id for r in spark.sql(one).collect()] == [3, 3]
    assert {(r.id, r.class_by_value) for r in spark.sql(two).collect()} == {(1, "urn:graph#Chair"), (2, "urn:graph#Member"), (3, None), (None, "urn:graph#Chair")}
    assert to_turtle(MAPPING).count('rr:tableName "org"') == 1


def test_stream_of_events(spark, tmp_path):
    from relgraph.streaming.incremental import event_triples

    e = spark.createDataFrame([(1, 5, "view"), (2, None, "buy")], "event_id long, user_id long, event_type string").withColumn("ts", F.current_timestamp())
    e.write.parquet(str(tmp_path / "in"))
    q = event_triples(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("t").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("t").count() == 3


def test_turtle_round_trip(spark, tables):
    from relgraph.sources.r2rml import from_turtle

    back = from_turtle(to_turtle(MAPPING), ("person", "org"))
    rows = lambda m: {tuple(r) for r in M.triples(spark, tables, m).collect()}
    assert rows(back) == rows(MAPPING)
    text = """@prefix : <urn:m#> . @prefix rr: <http://www.w3.org/ns/r2rml#> .
    # a comment
    :One a rr:TriplesMap ; rr:logicalTable [ rr:sqlQuery \"\"\"SELECT id, name FROM org\"\"\" ] ;
      rr:subjectMap [ rr:template "urn:graph#o/{id}" ; rr:class :A, :B ] ;
      rr:predicateObjectMap [ rr:predicate :name ; rr:objectMap [ rr:column "name" ] ] ."""
    m = from_turtle(text, ("org",), "urn:graph#").maps[0]
    assert (m.table, m.subject, m.classes, m.objects) == ("SELECT id, name FROM {org}", ":o/{id}", ("urn:m#A", "urn:m#B"), (("urn:m#name", Literal("name")),))


def test_ontology_in_owl_xml():
    from relgraph.sources.ontology import read_ontology

    o = read_ontology('''<Ontology xmlns="http://www.w3.org/2002/07/owl#" ontologyIRI="http://x/o">
      <Declaration><Class IRI="#A"/></Declaration><Declaration><DataProperty IRI="#d"/></Declaration>
      <SubClassOf><Class IRI="#B"/><Class IRI="#A"/></SubClassOf>
      <SubClassOf><Class IRI="#A"/><Class abbreviatedIRI="owl:Thing"/></SubClassOf>
      <ObjectPropertyDomain><ObjectProperty IRI="#p"/><ObjectUnionOf><Class IRI="#A"/><Class IRI="#C"/></ObjectUnionOf></ObjectPropertyDomain>
      <ObjectPropertyRange><ObjectProperty IRI="#p"/><Class IRI="#B"/></ObjectPropertyRange>
      <DataPropertyRange><DataProperty IRI="#d"/><Datatype abbreviatedIRI="xsd:date"/></DataPropertyRange>
      <InverseObjectProperties><ObjectProperty IRI="#p"/><ObjectProperty IRI="#q"/></InverseObjectProperties>
      <EquivalentClasses><Class IRI="#E"/><ObjectSomeValuesFrom><ObjectProperty IRI="#p"/><Class IRI="#B"/></ObjectSomeValuesFrom></EquivalentClasses>
    </Ontology>''')
    assert o.subclasses == {(":B", ":A")} and o.base == "http://x/o#" and ":B" in o.classes
    assert o.properties[":p"] == ("object", {":A", ":C"}, {":B"}) and o.properties[":d"] == ("data", set(), {"xsd:date"})
    assert o.inverses == {(":p", ":q")} and o.existentials == {(":E", ":p", ":B")}


def test_dump_text_of_many_kinds(spark, tmp_path):
    text = """SET search_path = one, pg_catalog;
CREATE TABLE t ( id integer PRIMARY KEY, v text );
CREATE TABLE two.t ( id integer, v text );
INSERT INTO t (v, id) VALUES ('it''s, (x)', 1), (NULL, 2);
INSERT INTO one.t VALUES (3, 'plain');
COPY one.t (id, v) FROM stdin;
4\tC:\\\\temp\\tx\\101\\x42
\\.
COPY two.t (id, v) FROM stdin;
5\t\\N
\\.
"""
    (tmp_path / "d.sql").write_text(text)
    tables, path = dump.parse_ddl(text), str(tmp_path / "d.sql")
    rows = dump.copy_rows(spark, path, tables)
    assert [tuple(r) for r in rows["t"].collect()] == [(4, "C:\\temp\txAB")] and [tuple(r) for r in rows["two.t"].collect()] == [(5, None)]
    assert sorted(map(tuple, dump.insert_rows(spark, path, tables)["t"].collect()), key=str) == [(1, "it's, (x)"), (2, None), (3, "plain")]
    assert dump.search_path(text) == ["one", "two"] and dump.table_schemas(text)["t"] == "two.t"
    out = dump.enriched(text + "ALTER TABLE t OWNER TO x;\n", [("t", "id", None, None), ("t", "v", "u", "w")])
    assert out.index('ADD PRIMARY KEY ("id")') < out.index('REFERENCES "u" ("w")') < out.index("OWNER TO")
    dump.split_by_schema(spark, path, str(tmp_path / "split"))
    parts = spark.read.text(str(tmp_path / "split"))
    two = [r.value for r in spark.read.text(str(tmp_path / "split" / "schema=two")).collect()]
    assert parts.count() == len(text.splitlines()) and "5\t\\N" in two and not any(x.startswith("4") for x in two)
    (tmp_path / "n.sql").write_text('CREATE TABLE "My Table" ("a-b" text DEFAULT \'"Q x"\'); -- "No One"\nCOPY T FROM stdin;\n"My Table"\n\\.\n')
    got = dump.normalized_lines(spark, str(tmp_path / "n.sql")).orderBy("chunk", "line").collect()
    assert [r.value for r in got] == ['create table my_table (a_b text default \'"Q x"\'); -- "No One"', "copy t from stdin;", '"My Table"', "\\."]


def test_rules(spark):
    from relgraph.operators import rules as R

    e = spark.createDataFrame([("persons", ":Person", "SRR"), ("people", ":Person", "SE"), ("a", ":X", "SEw"), ("b", ":X", "SE_SH"), ("c", ":Y", "SE")], "table string, class string, pattern string")
    assert {(r.table, r.winner) for r in R.class_collisions(e).collect()} == {("persons", True), ("people", False), ("a", False), ("b", True)}
    alt = spark.createDataFrame([("people", ":Y", 1), ("people", ":Z", 2), ("a", ":Z", 1)], "table string, class string, rank int")
    assert {(r.table, r["class"], r.unresolved) for r in R.resolved_collisions(e, alt).collect()} == {("persons", ":Person", False), ("people", ":Person", True), ("a", ":Z", False), ("b", ":X", False), ("c", ":Y", False)}
    choice = R.class_choices(spark.createDataFrame([("Papers",), ("autor",)], "table string"), spark.createDataFrame([(":Paper",), (":Author",)], "class string"))
    assert {(r.table, r["class"]) for r in choice.collect()} == {("Papers", ":Paper"), ("autor", ":Author")}
    catalog = spark.createDataFrame([("writes", "p", True, "person"), ("writes", "q", True, "paper"), ("mail", "p", True, "person"), ("mail", "v", True, None), ("author", "id", True, "person"), ("person", "id", True, None), ("paper", "id", True, None)], "table string, column string, is_pk boolean, fk_table string")
    patterns = spark.createDataFrame([("writes", "SR"), ("mail", "SEw"), ("author", "SE_SH"), ("person", "SE"), ("paper", "SE")], "table string, pattern string")
    assert {(r.table, r.owner) for r in R.owners(catalog, patterns).collect()} == {("writes", "person"), ("writes", "paper"), ("mail", "person")}
    p = R.parents(catalog, patterns)
    assert [tuple(r) for r in p.collect()] == [("author", "person", "id")]
    more = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "table string, parent string")
    assert {(r.table, r.level) for r in R.hierarchy_order(more).collect()} == {("c", 0), ("b", 1), ("a", 2)}
    bridges = spark.createDataFrame([("w", "a", "b", ":p", "x", "y"), ("w", "b", "a", ":p", "y", "x"), ("w", "a", "a", ":p", "x", "y"), ("w", "a", "a", ":p", "x", "z")], "bridge string, subject string, object string, predicate string, subject_column string, object_column string")
    assert R.distinct_bridges(bridges).count() == 3
    broken = Mapping((TriplesMap("orgs", "org", ":o/{id}"), TriplesMap("p", "person", ":p/{id}", (), ((":w", Reference("org", (("org", "id"),))), (":x", Reference("none", (("a", "b"),)))))))
    assert R.mended_parents(broken).maps[1].objects == ((":w", Reference("orgs", (("org", "id"),))),)


def test_names(spark):
    from relgraph.functions import terms as T

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.camel_case(F.lit("paper_title_x"))) == "paperTitleX" and one(T.without_prefix(F.lit("has_an_email"))) == "email"
    assert one(T.query_label(F.lit("Q7b"), F.lit("Q7 (Q7 (names))"))) == "Q7 (names)" and one(T.query_label(F.lit("Q7"), F.lit(" "))) == "Q7" and one(T.query_label(F.lit("Q7"), F.lit("names"))) == "Q7 (names)"
    assert one(T.sql_literal(F.lit('a "b"\'s'), F.lit("varchar(3)"))) == "'a b''s'" and one(T.sql_name(F.lit('a"b'))) == '"a""b"'
    assert one(normal_identifier(F.lit(""))) == "_" and one(normal_identifier(F.lit("a$b"))) == "a$b" and one(normal_identifier(F.lit("Window"))) == "window_"


def test_report_text(spark):
    d = spark.createDataFrame([("a_b", 0.5, None)], "x string, y double, z double")
    assert E.markdown(d, ["x", "y", "z"]).splitlines()[-1] == "| a_b | 0.50 | – |" and E.latex(d, ["x", "y", "z"]) == r"a\_b & 0.50 & -- \\"
    e = E.ordered_equal(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, v string"), "k")
    assert sorted((r.k, r.same) for r in e.collect()) == [(1, True), (2, False), (3, False)]
