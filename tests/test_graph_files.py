"""Triples as files, graphs in tables, matchings, constraints, ranks, runs and inverted templates."""

import json
import random

import pytest
from pyspark.sql import functions as F

from relgraph.functions import terms as T
from relgraph.operators import constraints as C
from relgraph.operators import graph as G
from relgraph.operators import materialize as M
from relgraph.operators import matching, ranks
from relgraph.plans.mapping import Literal, Mapping, TriplesMap
from relgraph.plans.patterns import Value, evaluate, unfold
from relgraph.sources import ntriples, runs

ODD = ['say "x"', "back\\slash", "tab\tline\nreturn\r", "bell\x07del\x7f", "é ß 🎈", "", "<a> {b} |c^`", "\\u0041", "ends with \\"]


def test_ntriples_round_trip(spark, tmp_path):
    rows = [(f":s/{k}", ":says", t, "literal", None) for k, t in enumerate(ODD)] + [(":s/1", ":n", "7", "literal", "xsd:integer"), (":s/1", "rdf:type", ":C", "iri", None), (":s/é", ":to", "http://x/a b", "iri", None), (":s/1", ":none", None, "literal", None), (None, ":p", "x", "literal", None)]
    g = spark.createDataFrame(rows, M.SCHEMA)
    path = str(tmp_path / "g")
    ntriples.write(g, path)
    lines = [r.value for r in spark.read.text(path, lineSep="\n").collect()]
    assert len(lines) == len(rows) - 2 and all(x.endswith(" .") and "\r" not in x for x in lines)
    assert "<urn:graph:s/1> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:graph:C> ." in lines
    assert '<urn:graph:s/1> <urn:graph:n> "7"^^<http://www.w3.org/2001/XMLSchema#integer> .' in lines
    assert sorted(map(tuple, ntriples.read(spark, path).collect()), key=str) == sorted((r for r in rows if r[0] and r[2] is not None), key=str)


def test_ntriples_of_others(spark, tmp_path):
    (tmp_path / "f.nt").write_text('# a comment\n\n<http://a/x> <http://a/p> "hi\\u00e9"@en-GB .\n  <http://a/x>\t<http://a/p> "1"^^<http://www.w3.org/2001/XMLSchema#integer>.\n')
    got = sorted(map(tuple, ntriples.read(spark, str(tmp_path / "f.nt"), {"a": "http://a/"}).collect()), key=str)
    assert got == [("a:x", "a:p", "1", "literal", "xsd:integer"), ("a:x", "a:p", "hié", "literal", None)]


def test_failed_write_leaves_nothing(spark, tmp_path):
    g = spark.range(100).select(F.concat(F.lit(":s/"), "id").alias("s"), F.lit(":p").alias("p"), F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise("x").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))
    path = tmp_path / "g"
    with pytest.raises(Exception, match="lost"):
        ntriples.write(g, str(path))
    assert not path.exists() or not any(x.name.startswith(("part", "_SUCCESS")) for x in path.iterdir())


def test_graph_by_predicate_reads_what_is_asked(spark, tmp_path):
    rows = [(f":s/{k}", f":p{k % 3}", str(k), "literal", None) for k in range(30)]
    path = str(tmp_path / "g")
    ntriples.write_by_predicate(spark.createDataFrame(rows, M.SCHEMA), path)
    got = ntriples.read_by_predicate(spark, path, [":p1"])
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[1] == ":p1") and len(got.inputFiles()) < 30
    assert "PartitionFilters: [isnotnull(predicate" in got._jdf.queryExecution().toString()


def test_distances_and_reachable_equal_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(50, 50), (None, 1), (60, 61), (60, 61)] + [(100, k) for k in range(200, 260)]
    df = spark.createDataFrame(edges, "a int, b int")
    for directed in (False, True):
        near: dict = {}
        for a, b in edges:
            if a is not None:
                near.setdefault(a, set()).add(b)
                if not directed:
                    near.setdefault(b, set()).add(a)
        want, todo = {0: 0, 300: 0}, [0, 300]
        while todo:
            x = todo.pop(0)
            for y in near.get(x, ()):
                if y not in want:
                    want[y] = want[x] + 1
                    todo.append(y)
        sources = spark.createDataFrame([(0,), (300,), (0,), (None,)], "node int")
        got = G.distances(df, sources, directed=directed).collect()
        assert len(got) == len(want) and {r.node: r.distance for r in got} == want
    pairs = set()
    for a in near:
        todo = list(near[a])
        while todo:
            x = todo.pop()
            if (a, x) not in pairs:
                pairs.add((a, x))
                todo += near.get(x, ())
    assert {tuple(r) for r in G.reachable(df).collect()} == pairs
    assert G.distances(df.limit(0), sources.limit(0)).collect() == []
    assert G.distances(df, sources, most=0).count() == 2


def stable(rows):
    """Proposals one by one."""
    best: dict = {}
    for g, a, b, s in rows:
        if None not in (a, b, s):
            best[g, a, b] = max(s, best.get((g, a, b), s))
    choices: dict = {}
    for (g, a, b), s in best.items():
        choices.setdefault((g, a), []).append((-s, b))
    for c in choices.values():
        c.sort()
    holds: dict = {}
    free = sorted(choices)
    while free:
        g, a = free.pop()
        if not choices[g, a]:
            continue
        s, b = choices[g, a].pop(0)
        other = holds.get((g, b))
        if other is None or (s, a) < other:
            holds[g, b] = (s, a)
            if other is not None:
                free.append((g, other[1]))
        else:
            free.append((g, a))
    return sorted((g, a, b, -s) for (g, b), (s, a) in holds.items())


def test_matching_equals_proposals_one_by_one(spark):
    rng = random.Random(5)
    rows = [(g, f"l{rng.randrange(12)}", f"r{rng.randrange(9)}", float(rng.randrange(6))) for g in range(4) for _ in range(60)] + [(0, None, "r1", 9.0), (0, "l1", "r1", None)]
    rows += [(9, f"l{k}", f"r{j}", float(10 - j)) for k in range(15) for j in range(15)]  # all want the same: a round each
    got = matching.matched(spark.createDataFrame(rows, "g int, a string, b string, score double"), ["g"], "a", "b", "score")
    assert sorted(map(tuple, got.collect())) == stable(rows)
    assert matching.matched(spark.createDataFrame([], "g int, a string, b string, score double"), ["g"], "a", "b", "score").collect() == []


@pytest.mark.parametrize("cell", [25, 1000])
def test_nearest_equals_matching_of_all_pairs(spark, cell):
    rng = random.Random(8)
    point = lambda g, k, most: (g, k, rng.randrange(most) / 4)
    for most in (12, 400):  # many equal values and distances, and few
        a, b = [point(g, k, most) for g in range(3) for k in range(20)], [point(g, k, most) for g in range(1, 4) for k in range(60 // g)]
        rows = [(g, x, y, -abs(u - w)) for g, x, u in a for h, y, w in b if g == h]
        a += [(1, None, 2.0), (1, 90, None), (1, 91, float("nan")), (None, 92, 1.0)]
        left, right = (spark.createDataFrame(x, f"g int, {n} int, v double") for x, n in ((a, "a"), (b, "b")))
        got = matching.nearest(left, right, ["g"], "a", "b", "v", cell)
        assert sorted(map(tuple, got.collect())) == stable(rows)
    assert matching.nearest(left.limit(0), right, ["g"], "a", "b", "v").count() == 0


def test_nearest_forms_no_pairs(spark):
    """Copies of a few values, in which pairs of all would be 400 million."""
    points = lambda n, name: spark.range(n).select(F.lit("x").alias("g"), F.col("id").alias(name), (F.col("id") % 50).cast("double").alias("v"))
    got = matching.nearest(points(20_000, "a"), points(20_000, "b"), ["g"], "a", "b", "v")
    assert got.where("a = b and score = 0").count() == got.count() == 20_000


def test_composite_keys_and_inclusions(spark):
    rng = random.Random(6)
    rows = [(a, b, c, f"t{a}", None if a else 1, 0.5 * a) for a in range(12) for b in range(5) for c in range(3)]
    rng.shuffle(rows)
    t = {"x": spark.createDataFrame(rows, "a int, b int, c int, t string, n int, f double"), "p": spark.createDataFrame([(k, -k) for k in range(12)], "id long, back long"), "none": spark.createDataFrame([], "z int"), "same": spark.createDataFrame([(1, 1), (1, 1)], "u int, v int")}
    got = {tuple(r) for r in C.all_keys(spark, t).collect()}
    assert got == {("x", "a,b,c", 3), ("x", "b,c,t", 3), ("p", "id", 1), ("p", "back", 1)}
    found = {tuple(r) for r in C.all_inclusions(spark, t).collect()}
    assert found == {("x", c, "p", "id") for c in "abcn"} | {("same", c, "p", "id") for c in "uv"}


def test_ranks_and_top_values(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(20)]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "v int, k int")
    got = ranks.ranked(df, ["v", "k"])
    want = {x[1]: i + 1 for i, x in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert {r.k: r.rank for r in got.collect()} == want
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert ranks.ranked(df.limit(0), ["v"]).collect() == []
    counts = spark.createDataFrame([(g, f"v{k}", (k * 7) % 5) for g in range(3) for k in range(200)], "g int, value string, n int")
    top = {(r.g, r.value) for r in ranks.top_values(counts, ["g"], "value", "n", 4).collect()}
    best = sorted((f"v{k}" for k in range(200) if (k * 7) % 5 == 4))[:4]
    assert top == {(g, v) for g in range(3) for v in best}


def test_runs(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("a/2024/d1/scores.txt", "Q01 (x)|0.5|1|NaN\nbad line\nQ2 (other)|no|1|1\nAll (AVG)|1|1|1\n")
    put("a/2023/d1/scores.txt", "Q01 (x)|0.1|1|1\n")
    put("b/2023/d1/scores.txt", "none")
    put("stray.txt", "Q01|1|1|1\n")
    put("a/2024/d1/queries.json", json.dumps([{"id": "Q1", "label": "Q01 (x)", "categories": ["c"], "sql": 3}, {"id": "q2", "label": "y", "categories": None}], indent=2))
    found = runs.found(spark, str(tmp_path), "*.txt")
    assert sorted((r.system, r.stamp, r.dataset, r.file) for r in found.collect()) == [("a", "2023", "d1", "scores.txt"), ("a", "2024", "d1", "scores.txt"), ("b", "2023", "d1", "scores.txt")]
    assert sorted((r.system, r.stamp) for r in runs.newest(found).collect()) == [("a", "2024"), ("b", "2023")]
    scores = runs.scores(spark, str(tmp_path / "a/2024"))
    assert sorted(((r.label, r.f1, r.precision, r.recall) for r in scores.collect()), key=str) == [("All (AVG)", 1, 1, 1), ("Q01 (x)", 0.5, 1, None), ("Q2 (other)", None, 1, 1)]
    named = runs.described(scores, runs.manifests(spark, str(tmp_path))).collect()
    assert {r.label: (r.id, r.categories) for r in named} == {"All (AVG)": (None, None), "Q01 (x)": ("Q1", ["c"]), "Q2 (other)": ("q2", None)}


KEYS = [("a b", 1), ("é/ü", 2), ("x~y*z", 3), ("%41", 4), ("A", 5), ("", 6), ("a/1", 7)]
ODD_KEYS = Mapping((TriplesMap("t", "t", ":t/{k}/{n}", (":T",), ((":k", Literal("k")), (":n", Literal("n")), (":f", Literal("f"))), key=True), TriplesMap("u", "t", ":u/{k}-{n}", (), ((":k", Literal("k")),), key=True)))


def test_constant_iris_become_key_predicates(spark, tmp_path):
    spark.createDataFrame([(k, n, n / 2) for k, n in KEYS], "k string, n int, f double").write.parquet(str(tmp_path / "t"))
    tables = {"t": spark.read.parquet(str(tmp_path / "t"))}
    graph = M.triples(spark, tables, ODD_KEYS)
    subjects = [r.s for r in graph.select("s").distinct().collect()]
    odd = [":t/%41/5", ":t/A/05", ":t/a%20b/+1", ":t/a b/1", ":t/A/5/", ":t/%e9/2", ":t/A/99999999999999999999", ":x/1"]
    for s in [*subjects, *odd]:
        want = sorted(map(tuple, evaluate(graph, [(s, ":k", "?k")]).collect()))
        assert sorted(map(tuple, unfold(spark, tables, ODD_KEYS, [(s, ":k", "?k")]).collect())) == want
    for p, v in ((":n", "3"), (":n", "03"), (":n", "x"), (":f", "1.5"), (":f", "1.50"), (":k", "a b"), (":k", "")):
        want = sorted(map(tuple, evaluate(graph, [("?s", p, Value(v))]).collect()))
        assert sorted(map(tuple, unfold(spark, tables, ODD_KEYS, [("?s", p, Value(v))]).collect())) == want
    plan = unfold(spark, tables, ODD_KEYS, [(":t/a%20b/1", ":f", "?f")])._jdf.queryExecution().toString()
    assert "EqualTo(k,a b)" in plan and "EqualTo(n,1)" in plan


def test_names_without_verbs_and_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    bare = {"has_an_email": "email", "hasAnEmail": "email", "has-a-name": "name", "isTheHead": "head", "hasname": "hasname", "was_a_": "wasa", "hasty": "hasty"}
    assert {k: one(T.bare_property(F.lit(k))) for k in bare} == bare
    labels = {("Q7", "Q7 (Q7 (a (b)))"): "Q7 (a (b))", ("Q7", "Q7 (Q7 (Q7 (a)))"): "Q7 (a)", ("q7b", "plain"): "q7 (plain)", ("Q7", ""): "Q7", ("Q7", "Q8 (x)"): "Q8 (x)", ("x", "name"): "x (name)", ("Q7", "Q7"): "Q7"}
    assert {k: one(T.query_label(F.lit(k[0]), F.lit(k[1]))) for k in labels} == labels


def test_links_stay_where_they_are_when_inverses_are_looked_up(spark):
    from relgraph.operators import ontology as O

    links = spark.range(1_000).select(F.concat(F.lit(":o"), "id").alias("subject"), F.lit(":by").alias("property"), F.lit(":c").alias("object"))
    got = O.missing_inverses(links, spark.createDataFrame([(":by", ":of")], "a string, b string"))
    assert "strategy=broadcast" in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.where("property = ':of' and subject = ':c'").count() == got.count() == 1_000


def test_pairs_that_are_distinct_are_not_made_distinct_again(spark):
    from relgraph.queries import STAR

    t = {"lineitem": spark.createDataFrame([(1, 2), (1, 2), (1, 3), (None, 3), (2, 2)], "l_suppkey long, l_partkey long"), "part": spark.createDataFrame([(2,), (3,)], "p_partkey long")}
    some = Mapping(tuple(m for m in STAR.maps if m.name in ("supplies", "part")))
    got = M.triples(spark, t, some, {":supplies"})
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert sorted((r.s, r.o) for r in got.collect()) == [(":supplier/1", ":part/2"), (":supplier/1", ":part/3"), (":supplier/2", ":part/2")]


def test_keys_are_tested_in_all_parts_of_their_hashes(spark):
    rows = spark.range(300).select((F.col("id") + 0).alias("a"), F.lit("x").alias("b")).localCheckpoint()
    part = F.pmod(F.xxhash64("a", "b"), F.lit(C.PARTS)) == 0
    assert C._is_key(rows, ("a", "b")) and not C._is_key(rows, ("b",))
    for some in (part, ~part):
        assert not C._is_key(rows.unionByName(rows.where(some).limit(1)), ("a", "b"))


def test_ntriples_lines_are_matched_once_and_unescaped(spark, tmp_path):
    """Runs of backslashes, frequent and rare escapes, an empty literal and an empty IRI, line ends, comments with quotes."""
    bs = chr(92)
    texts = [bs * 2 + "n", bs * 3 + "n", bs * 5 + '"', bs + "t" + bs + "u0041" + bs * 2 + "u0041", bs + "b", "", "x" + bs * 2]
    lines = [f'<urn:graph:s{k}> <urn:graph:p> "{t}" . # "c" <z>' for k, t in enumerate(texts)]
    lines += ["<urn:graph:i> <urn:graph:p> <> .\r", "# no triple", '<urn:graph:d> <urn:graph:p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .']
    (tmp_path / "g.nt").write_bytes("\n".join(lines).encode())
    df = ntriples.read(spark, str(tmp_path / "g.nt"))
    got = {r.s: (r.o, r.o_kind, r.o_datatype) for r in df.collect()}
    want = [bs + "n", bs + "\n", bs * 2 + '"', "\tA" + bs + "u0041", "b", "", "x" + bs]
    assert [got[f":s{k}"] for k in range(len(texts))] == [(x, "literal", None) for x in want]
    assert got[":i"][:2] == ("", "iri") and got[":d"] == ("1", "literal", "xsd:integer") and len(got) == len(texts) + 2
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 0 and plan.count("regexp_replace(") == 1
