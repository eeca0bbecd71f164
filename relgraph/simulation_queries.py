"""Driver queries of the simulation: the star mapping asked for all that its tables could give."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.functions.terms import RDF_TYPE
from relgraph.operators import materialize as M
from relgraph.operators import simulation as S
from relgraph.plans.mapping import Mapping

#: table, class; tables that refer to others; a bridge; classes by discriminator; object properties.
CLASSES = (("region", ":Region"), ("nation", ":Nation"), ("customer", ":Customer"), ("supplier", ":Supplier"), ("part", ":Part"), ("orders", ":Order"), ("lineitem", ":Line"))
REFERENCES = (("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"))
BRIDGES = (("supplier", "part"), ("part", "supplier"))
HIDDEN = (("orders", ":OpenOrder"), ("orders", ":FinishedOrder"), ("part", ":OddPart"))
LINKS = ((":inRegion", ":Nation", ":Region"), (":inNation", ":Customer", ":Nation"), (":basedIn", ":Supplier", ":Nation"), (":placedBy", ":Order", ":Customer"), (":supplies", ":Supplier", ":Part"), (":soldBy", ":Part", ":Supplier"), (":knows", ":Customer", ":Part"))
AXIOMS = ((":Buyer", ":placed", ":Order"), (":Maker", ":supplies", ":Part"))
INVERSES = ((":placedBy", ":placed"), (":inNation", ":home"))
SUBCLASSES = ((":OpenOrder", ":Order"),)


def _simulated(spark: SparkSession, sf_dir: str, mapping: Mapping, entail: bool, asked: set[str] | None = None) -> DataFrame:
    """All expectations; with ``asked`` those on links and inverses of these properties, for which only
    these, the ones that they turn round and types are made."""
    from relgraph.queries import tables

    t = tables(spark, sf_dir)
    only = None if asked is None else asked | {RDF_TYPE} | {x for pair in INVERSES if asked & set(pair) for x in pair}
    classes = None if asked is None else {c for _, c in CLASSES}
    graph = M.entail(spark, t, mapping, only, classes) if entail else M.triples(spark, t, mapping, only)
    graph = graph if asked is None else graph.where((F.col("p") != RDF_TYPE) | F.col("o").isin(sorted(classes)))
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    # Each column is expected as a data property of its table's class.
    data = [(":" + c.split("_", 1)[1], "data", cls, None) for name, cls in CLASSES for c in t[name].columns]
    onto = {
        "classes": frame([(c,) for c in sorted({c for _, c in CLASSES + HIDDEN} | {x for a, _, f in AXIOMS for x in (a, f)})], "class"),
        "subclasses": frame(SUBCLASSES, "child parent"),
        "properties": frame(data + [(p, "object", d, r) for p, d, r in LINKS], "property kind domain range"),
        "existentials": frame(AXIOMS, "class property filler"),
        "inverses": frame(INVERSES, "a b"),
    }
    weak = frame([(":Customer", ":segment"), (":Customer", ":phone")], "class property")
    out = S.simulated(graph, frame(CLASSES, "table class"), onto, frame(REFERENCES, "table parent"), frame(BRIDGES, "subject object"), weak, frame(HIDDEN, "table class"))
    return out if asked is None else out.where(F.col("kind").isin("link", "inverse") & F.col("property").isin(sorted(asked)))


def mapping_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relgraph.queries import STAR

    return _simulated(spark, sf_dir, replace(STAR, inverses=(), existentials=()), False)


def mapping_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and inverses after they were mended."""
    from relgraph.queries import STAR

    plain = replace(STAR, inverses=(), existentials=())
    keys = {("supplier", "nation"): (("s_nationkey", "n_nationkey"),), ("customer", "nation"): (("c_nationkey", "n_nationkey"),)}
    every = {p for p, _, _ in LINKS} | {p for pair in INVERSES for p in pair}
    fixed, new = S.mended(plain, _simulated(spark, sf_dir, plain, False, every), keys)
    return _simulated(spark, sf_dir, fixed, True, new)


def queries() -> dict:
    return {f.__name__: f for f in (mapping_simulation, mapping_mended)}


def oracle_sql() -> dict[str, str]:
    given = lambda name, rows, names: f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) AS v({names}))"
    linked = "(SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"
    facts = f"""
        i AS (SELECT ':Region' AS c, count(*) AS n FROM region UNION ALL SELECT ':Nation', count(*) FROM nation UNION ALL SELECT ':Customer', count(*) FROM customer UNION ALL SELECT ':Supplier', count(*) FROM supplier
              UNION ALL SELECT ':Part', count(*) FROM part UNION ALL SELECT ':Order', count(*) FROM orders UNION ALL SELECT ':OpenOrder', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT ':FinishedOrder', count(*) FILTER (o_orderstatus = 'F') FROM orders),
        h AS (SELECT ':Region' AS c, ':name' AS p, count(r_name) AS n FROM region UNION ALL SELECT ':Nation', ':name', count(n_name) FROM nation UNION ALL SELECT ':Customer', ':name', count(c_name) FROM customer UNION ALL SELECT ':Supplier', ':name', count(s_name) FROM supplier
              UNION ALL SELECT ':Part', ':name', count(p_name) FROM part UNION ALL SELECT ':Part', ':size', count(p_size) FROM part UNION ALL SELECT ':Customer', ':segment', count(c_mktsegment) FROM customer
              UNION ALL SELECT ':Nation', ':inRegion', count(n_regionkey) FROM nation UNION ALL SELECT ':Customer', ':inNation', count(*) FROM {linked} UNION ALL SELECT ':Supplier', ':inNation', count(s_nationkey) FROM supplier
              UNION ALL SELECT ':Order', ':placedBy', count(o_custkey) FROM orders UNION ALL SELECT ':Supplier', ':supplies', count(DISTINCT l_suppkey) FROM lineitem),
        {given("t", CLASSES, '"table", class')}, {given("r", REFERENCES + BRIDGES, "a, b")}, {given("l", LINKS, "p, d, g")}, {given("x", HIDDEN, '"table", class')},
        d AS (SELECT DISTINCT class, ':' || regexp_replace(column_name, '^[a-z]+_', '') AS p FROM duckdb_columns() JOIN t ON table_name = t."table"),
        j AS (SELECT x.class AS a, y.class AS b FROM r JOIN t x ON x."table" = r.a JOIN t y ON y."table" = r.b)"""
    links = """
        SELECT 'link' AS kind, d AS class, p AS property, g AS other, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'PASS' WHEN (d, g) IN (SELECT (a, b) FROM j) THEN 'WARN' ELSE 'SKIP' END AS state FROM l LEFT JOIN h USING (p) WHERE h.c = l.d OR h.c IS NULL"""
    return {
        "mapping_simulation": f"""
            WITH {facts}
            SELECT 'type' AS kind, class, NULL AS property, NULL AS other, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS state FROM t LEFT JOIN i ON i.c = t.class
            UNION ALL SELECT 'property', class, d.p, NULL, coalesce(n, 0), CASE WHEN n > 0 THEN 'PASS' ELSE 'WARN' END FROM d LEFT JOIN h ON h.c = d.class AND h.p = d.p
            UNION ALL SELECT * FROM ({links})
            UNION ALL SELECT 'weak', ':Customer', v, NULL, coalesce(n, 0), CASE WHEN n > 0 THEN 'PASS' ELSE 'WARN' END FROM (SELECT unnest([':segment', ':phone']) AS v) LEFT JOIN h ON h.c = ':Customer' AND h.p = v
            UNION ALL SELECT 'hidden', x.class, NULL, t.class, coalesce(n, 0), CASE WHEN n > 0 AND x.class = ':OpenOrder' THEN 'PASS' ELSE 'WARN' END FROM x JOIN t USING ("table") LEFT JOIN i ON i.c = x.class
            UNION ALL SELECT 'equivalent', ':Buyer', ':placed', ':Order', 0, 'SKIP' UNION ALL SELECT 'equivalent', ':Maker', ':supplies', ':Part', 0, 'FAIL'
            UNION ALL SELECT 'inverse', NULL, ':placed', ':placedBy', 0, 'WARN' FROM (SELECT count(*) AS n FROM orders) WHERE n > 0 UNION ALL SELECT 'inverse', NULL, ':home', ':inNation', 0, 'WARN' FROM (SELECT count(*) AS n FROM supplier) WHERE n > 0""",
        "mapping_mended": f"""
            WITH {facts}
            SELECT 'link' AS kind, ':Supplier' AS class, ':basedIn' AS property, ':Nation' AS other, count(s_nationkey) AS n, 'PASS' AS state FROM supplier
            UNION ALL SELECT 'inverse', NULL, ':placed', ':placedBy', count(DISTINCT o_custkey), 'PASS' FROM orders
            UNION ALL SELECT 'inverse', NULL, ':home', ':inNation', count(DISTINCT k), 'PASS' FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    }
