"""Expectations of a mapping, each kind in each state, and what mending adds."""

import pytest
from relgraph.operators import materialize as M
from relgraph.operators import simulation as S
from relgraph.plans.mapping import Literal, Mapping, Reference, TriplesMap


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


def asked(spark, graph):
    onto = {
        "classes": frame(spark, [(c,) for c in (":A", ":B", ":C", ":Sub", ":Odd")], "class"),
        "subclasses": frame(spark, [(":Sub", ":A")], "child parent"),
        "properties": frame(spark, [(":n", "data", ":A", None), (":m", "data", ":A", None), (":any", "data", None, None), (":ab", "object", ":A", ":B"), (":ba", "object", ":B", ":A"), (":ac", "object", ":Sub", ":C"), (":bc", "object", ":B", ":C"), (":open", "object", ":A", None)], "property kind domain range"),
        "existentials": frame(spark, [(":A", ":ab", ":B"), (":Odd", ":ab", ":B"), (":Odd", ":bc", ":C")], "class property filler"),
        "inverses": frame(spark, [(":ab", ":ba"), (":bc", ":cb")], "a b"),
    }
    classes = frame(spark, [("a", ":A"), ("b", ":B"), ("c", ":C")], "table class")
    return S.simulated(graph, classes, onto, frame(spark, [("a", "b"), ("b", "a")], "table parent"), frame(spark, [], "subject object"), frame(spark, [(":A", ":n"), (":A", ":w")], "class property"), frame(spark, [("a", ":Sub"), ("a", ":Odd"), ("b", ":Sub"), ("none", ":Sub")], "table class"))


def test_each_kind_and_state(spark):
    t = lambda s, p, o, k="iri": (s, p, o, k, None)
    graph = spark.createDataFrame([t(":1", "rdf:type", ":A"), t(":1", "rdf:type", ":Sub"), t(":2", "rdf:type", ":A"), t(":3", "rdf:type", ":B"), t(":1", ":n", "x", "literal"), t(":1", ":n", "y", "literal"), t(":1", ":ab", ":3")], M.SCHEMA)
    got = {(r.kind, r["class"], r.property, r.other): (r.n, r.state) for r in asked(spark, graph).collect()}
    assert got == {
        ("type", ":A", None, None): (2, "PASS"), ("type", ":B", None, None): (1, "PASS"), ("type", ":C", None, None): (0, "FAIL"),
        ("property", ":A", ":n", None): (1, "PASS"), ("property", ":A", ":m", None): (0, "WARN"),
        ("link", ":A", ":ab", ":B"): (1, "PASS"), ("link", ":B", ":ba", ":A"): (0, "WARN"), ("link", ":A", ":ac", ":C"): (0, "SKIP"), ("link", ":B", ":bc", ":C"): (0, "SKIP"),
        ("weak", ":A", ":n", None): (1, "PASS"), ("weak", ":A", ":w", None): (0, "WARN"),
        ("hidden", ":Sub", None, ":A"): (1, "PASS"), ("hidden", ":Odd", None, ":A"): (0, "WARN"), ("hidden", ":Sub", None, ":B"): (1, "WARN"), ("hidden", ":Sub", None, None): (1, "PASS"),
        ("equivalent", ":A", ":ab", ":B"): (1, "PASS"), ("equivalent", ":Odd", ":ab", ":B"): (0, "FAIL"), ("equivalent", ":Odd", ":bc", ":C"): (0, "SKIP"),
        ("inverse", None, ":ba", ":ab"): (0, "WARN"),
    }
    none = {r.state for r in asked(spark, graph.limit(0)).where("kind = 'type'").collect()}
    assert none == {"FAIL"} and asked(spark, graph.limit(0)).where("kind = 'inverse'").count() == 0


def test_mending_adds_links_and_inverses(spark):
    maps = (TriplesMap("a", "a", ":a/{i}", (":A",), ((":n", Literal("i")), (":ab", Reference("b", (("b", "i"),)))), key=True), TriplesMap("b", "b", ":b/{i}", (":B",), (), key=True))
    tests = spark.createDataFrame([("link", ":B", ":ba", ":A", 0, "WARN"), ("inverse", None, ":back", ":ab", 0, "WARN"), ("link", ":B", ":other", ":C", 0, "WARN"), ("link", ":A", ":ac", ":B", 0, "SKIP")], "kind string, class string, property string, other string, n long, state string")
    fixed, new = S.mended(Mapping(maps), tests, {("b", "a"): (("a", "i"),)})
    assert new == {":ba", ":back"} and fixed.inverses == ((":ab", ":back"),)
    assert dict(fixed.map("b").objects) == {":ba": Reference("a", (("a", "i"),))} and fixed.map("a") == maps[0]
    tables = {"a": spark.createDataFrame([(1, 5)], "i int, b int"), "b": spark.createDataFrame([(5, 1), (6, 9)], "i int, a int")}
    rows = {(r.s, r.p, r.o) for r in M.entail(spark, tables, fixed).collect()}
    assert {(":b/5", ":ba", ":a/1"), (":b/5", ":back", ":a/1"), (":a/1", ":ab", ":b/5")} <= rows and not any(s == ":b/6" and p == ":ba" for s, p, _ in rows)


def test_mending_makes_only_the_triples_that_links_and_inverses_need(spark, monkeypatch):
    from relgraph import simulation_queries as Q

    def made(spark, tables, mapping, only=None):
        assert only is not None and ":name" not in only and {":placedBy", ":placed", "rdf:type"} <= only
        raise InterruptedError

    monkeypatch.setattr(Q.M, "triples", made)
    with pytest.raises(InterruptedError):
        Q.mapping_mended(spark, "/root/testdata/sf0.001")
