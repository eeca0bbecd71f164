"""Driver queries of the relational-to-graph engine, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph import catalog_queries, dump_queries, graph_queries, simulation_queries
from relgraph.functions.terms import RDF_TYPE, normal_identifier, template
from relgraph.operators import evaluate as E
from relgraph.operators import materialize as M
from relgraph.operators import profile as P
from relgraph.plans.patterns import Value, unfold
from relgraph.plans.mapping import Dispatch, Literal, Mapping, Reference, TriplesMap

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


#: Foreign keys whose parents all exist and are unique (profiled): no join is needed.
STAR = Mapping(
    maps=(
        TriplesMap("region", "region", ":region/{r_regionkey}", (":Region",), ((":name", Literal("r_name")),), key=True),
        TriplesMap("nation", "nation", ":nation/{n_nationkey}", (":Nation",), ((":name", Literal("n_name")), (":inRegion", Reference("region", (("n_regionkey", "r_regionkey"),), True))), key=True),
        TriplesMap("customer", "customer", ":customer/{c_custkey}", (":Customer",), ((":name", Literal("c_name")), (":segment", Literal("c_mktsegment")), (":inNation", Reference("nation", (("c_nationkey", "n_nationkey"),)))), key=True),
        TriplesMap("supplier", "supplier", ":supplier/{s_suppkey}", (":Supplier",), ((":name", Literal("s_name")), (":inNation", Reference("nation", (("s_nationkey", "n_nationkey"),), True))), key=True),
        TriplesMap("part", "part", ":part/{p_partkey}", (":Part",), ((":name", Literal("p_name")), (":size", Literal("p_size"))), key=True),
        TriplesMap("orders", "orders", ":order/{o_orderkey}", (":Order",), ((":placedBy", Reference("customer", (("o_custkey", "c_custkey"),), True)),), dispatch=Dispatch("o_orderstatus", (("O", ":OpenOrder"), ("F", ":FinishedOrder"), ("P", ":PendingOrder"))), key=True),
        TriplesMap("supplies", "SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}", ":supplier/{l_suppkey}", (), ((":supplies", Reference("part", (("l_partkey", "p_partkey"),), True)),), pair=True),
        TriplesMap("document", "documents", ":document/{doc_id}", (":Document",), ((":language", Literal("lang")),), key=True),
        TriplesMap("toxic", "labels", ":document/{doc_id}", (":ToxicDocument",), (), where="toxic = 1"),
        TriplesMap("turn", "conversations", ":turn/{conv_id}/{turn}", (":Turn",), ((":role", Literal("role")),), key=True),
    ),
    subclasses=((":OpenOrder", ":Order"), (":Order", ":Thing"), (":Customer", ":Party"), (":Supplier", ":Party"), (":Party", ":Thing")),
    inverses=((":placedBy", ":placed"),),
    existentials=((":Buyer", ":placed", ":Order"),),
)


def graph(spark: SparkSession, sf_dir: str, only: set[str] | None = None) -> DataFrame:
    return M.triples(spark, tables(spark, sf_dir), STAR, only)


def solutions(*patterns, entail: bool = False):
    """The solutions of patterns over the star mapping, unfolded to its tables."""
    return lambda spark, sf_dir: unfold(spark, tables(spark, sf_dir), STAR, list(patterns), entail)


def counted(*patterns, entail: bool = False):
    return lambda spark, sf_dir: solutions(*patterns, entail=entail)(spark, sf_dir).agg(F.count("*").alias("n"))


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_dispatch_counts(spark, sf_dir):
    t = graph(spark, sf_dir, {RDF_TYPE}).where(F.col("o").isin(":OpenOrder", ":FinishedOrder", ":PendingOrder"))
    return t.groupBy(F.col("o").alias("class")).agg(F.count("*").alias("n"))


def triples_by_predicate(spark, sf_dir):
    return graph(spark, sf_dir).groupBy("p").agg(F.count("*").alias("n"))


def join_triples(spark, sf_dir):
    return graph(spark, sf_dir, {":inNation"}).select("s", "p", "o")


def literal_triples(spark, sf_dir):
    return graph(spark, sf_dir, {":segment", ":size"}).select("s", "p", "o", "o_datatype")


def composite_template(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select(template(":turn/{conv_id}/{turn}").alias("iri"))


def link_bridge(spark, sf_dir):
    return graph(spark, sf_dir, {":supplies"}).select("s", "o")


def link_inverse(spark, sf_dir):
    return M.entail(spark, tables(spark, sf_dir), STAR, {":placed"}).select("s", "o")


def axiom_exists_typing(spark, sf_dir):
    return M.entail(spark, tables(spark, sf_dir), STAR, {RDF_TYPE}, {":Buyer"}).select("s")


def subclass_entailment(spark, sf_dir):
    t = M.entail(spark, tables(spark, sf_dir), STAR, {RDF_TYPE}, {":Thing", ":Party"})
    return t.groupBy(F.col("o").alias("class")).agg(F.count("*").alias("n"))


#: Rules in a chain: an order's customer is a client; who places something is a buyer; a nation of
#: buyers is a market, and its region has one.
CHAIN = replace(
    STAR,
    subclasses=STAR.subclasses + ((":Buyer", ":Partner"), (":Client", ":Partner"), (":MarketRegion", ":MarketPlace"), (":Market", ":MarketPlace")),
    inverses=STAR.inverses + ((":inNation", ":home"), (":inRegion", ":part")),
    domains=((":supplies", ":Maker"),),
    ranges=((":placedBy", ":Client"), (":supplies", ":Good")),
    existentials=((":Buyer", ":placed", ":Order"), (":Market", ":home", ":Buyer"), (":MarketRegion", ":part", ":Market")),
)


def _chain_counts(triples):
    return triples.groupBy(F.col("o").alias("class")).agg(F.count("*").alias("n"))


def entail_chain(spark, sf_dir):
    """Types that follow by domain, range and a chain of three axioms."""
    asked = {":Maker", ":Good", ":Client", ":Partner", ":Buyer", ":Market", ":MarketRegion", ":MarketPlace"}
    return _chain_counts(M.entail(spark, tables(spark, sf_dir), CHAIN, {RDF_TYPE}, asked))


def entail_all_types(spark, sf_dir):
    return _chain_counts(M.entail(spark, tables(spark, sf_dir), CHAIN, {RDF_TYPE}))


def unfold_all_types(spark, sf_dir):
    """The same by unfolding a pattern with a variable class."""
    return unfold(spark, tables(spark, sf_dir), CHAIN, [("?x", "a", "?class")], True).groupBy("class").agg(F.count("*").alias("n"))


def unfold_chain(spark, sf_dir):
    return unfold(spark, tables(spark, sf_dir), CHAIN, [("?x", "a", ":MarketPlace"), ("?x", ":name", "?name")], True)


def hidden_fk_typing(spark, sf_dir):
    m = Mapping((TriplesMap("x", "SELECT l_orderkey, nullif(l_suppkey, 1) AS s FROM {lineitem}", ":order/{l_orderkey}", (":Supplied",), (), where="s IS NOT NULL"),))
    return M.triples(spark, tables(spark, sf_dir), m).select("s", "o")


def column_profile(spark, sf_dir):
    return P.profile(_t(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


def value_counts(spark, sf_dir):
    return P.value_counts(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


def enum_columns(spark, sf_dir):
    return P.enum_columns(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def top_values(spark, sf_dir):
    return P.sample_values(_t(spark, sf_dir, "part"), "p_brand")


def pk_candidates(spark, sf_dir):
    return P.key_candidates(_t(spark, sf_dir, "lineitem"), [["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]])


def fk_inclusion(spark, sf_dir):
    t = tables(spark, sf_dir)
    tests = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("labels", "doc_id", "documents", "doc_id")]
    out = None
    for a, x, b, y in tests:
        r = P.inclusion(t[a], x, t[b], y).select(F.lit(f"{a}.{x}").alias("child"), F.lit(f"{b}.{y}").alias("parent"), "orphans", "holds")
        out = r if out is None else out.unionByName(r)
    return out


def norm_identifiers(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_type").distinct().select("p_type", normal_identifier(F.col("p_type")).alias("name"))


def norm_collisions(spark, sf_dir):
    n = _t(spark, sf_dir, "customer").select(normal_identifier(F.regexp_replace("c_name", "[0-9]$", "")).alias("name"), "c_name")
    return n.groupBy("name").agg(F.count_distinct("c_name").alias("n")).where("n > 1")


def bag_diff(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    return E.bag_diff(o, o.where("o_orderstatus <> 'P'"))


def prf1_scores(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return E.prf1(c.select("c_mktsegment"), c.where("c_nationkey < 10").select("c_mktsegment"))


def _scores(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 3).alias("system")).agg(F.count("*").alias("score"))


def report_pivot(spark, sf_dir):
    m = E.matrix(_scores(spark, sf_dir), "s_nationkey", "system", "score", [0, 1, 2])
    return m.select("s_nationkey", F.col("0").alias("s0"), F.col("1").alias("s1"), F.col("2").alias("s2"))


def report_best(spark, sf_dir):
    return E.best(_scores(spark, sf_dir), "s_nationkey", "score")


def report_coverage(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("system").agg(F.count("score").alias("filled"), F.avg("score").alias("mean"))


def report_baseline_diff(spark, sf_dir):
    s = _scores(spark, sf_dir)
    part = lambda k: s.where(F.col("system") == k).select("s_nationkey", F.col("score").cast("double").alias("f1"))
    return E.baseline_diff(part(0), part(1), "s_nationkey", "f1").select("s_nationkey", "old", "new", "delta", "state")


def group_count(spark, sf_dir):
    found = solutions(("?c", "a", ":Customer"), ("?c", ":inNation", "?x"), ("?x", ":name", "?n"))(spark, sf_dir)
    return found.groupBy("n").agg(F.count("*").alias("cnt"))


def filter_size(spark, sf_dir):
    found = solutions(("?p", "a", ":Part"), ("?p", ":size", "?z"))(spark, sf_dir)
    return found.where(F.col("z").cast("long") > 45)


#: Patterns over the star mapping.
PATTERNS = {
    "class_count": counted(("?x", "a", ":Customer")),
    "class_flag_count": counted(("?x", "a", ":ToxicDocument")),
    "attr_in_table": lambda s, d: solutions(("?c", "a", ":Customer"), ("?c", ":name", "?name"))(s, d).select("name"),
    "attr_other_table": lambda s, d: solutions(("?d", "a", ":ToxicDocument"), ("?d", ":language", "?lang"))(s, d).select("lang"),
    "link_path1": counted(("?o", "a", ":Order"), ("?o", ":placedBy", "?c")),
    "link_path2": counted(("?o", "a", ":Order"), ("?o", ":placedBy", "?c"), ("?c", ":inNation", "?x"), ("?x", "a", ":Nation")),
    "link_path3": counted(("?o", ":placedBy", "?c"), ("?c", ":inNation", "?x"), ("?x", ":inRegion", "?r"), ("?r", ":name", Value("ASIA"))),
    "group_count": group_count,
    "filter_size": filter_size,
    "subclass_unfolded": counted(("?x", "a", ":Thing"), entail=True),
    "inverse_unfolded": lambda s, d: solutions(("?c", ":placed", "?o"), ("?c", ":segment", Value("BUILDING")), entail=True)(s, d).select("o"),
    "exists_unfolded": counted(("?x", "a", ":Buyer"), ("?x", ":inNation", "?n"), entail=True),
}
NATIVE = (class_dispatch_counts, triples_by_predicate, join_triples, literal_triples, composite_template, link_bridge, link_inverse, axiom_exists_typing, subclass_entailment, entail_chain, entail_all_types, unfold_all_types, unfold_chain, hidden_fk_typing, column_profile, value_counts, enum_columns, top_values, pk_candidates, fk_inclusion, norm_identifiers, norm_collisions, bag_diff, prf1_scores, report_pivot, report_best, report_coverage, report_baseline_diff)


def queries() -> dict:
    return PATTERNS | {f.__name__: f for f in NATIVE} | catalog_queries.queries() | dump_queries.queries() | graph_queries.queries() | simulation_queries.queries()


def oracle_sql() -> dict[str, str]:
    return own_sql() | catalog_queries.oracle_sql() | dump_queries.oracle_sql() | graph_queries.oracle_sql() | simulation_queries.oracle_sql()


def own_sql() -> dict[str, str]:
    status = "CASE o_orderstatus WHEN 'O' THEN ':OpenOrder' WHEN 'F' THEN ':FinishedOrder' WHEN 'P' THEN ':PendingOrder' END"
    scores = "(SELECT s_nationkey, s_suppkey % 3 AS system, count(*) AS score FROM supplier GROUP BY ALL)"
    buyers = "(SELECT DISTINCT c_custkey, c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey)"
    markets = f"(SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM {buyers}))"
    chain = {
        ":Maker": "(SELECT DISTINCT l_suppkey FROM lineitem)", ":Good": "(SELECT DISTINCT l_partkey FROM lineitem)", ":Client": "(SELECT DISTINCT o_custkey FROM orders)",
        ":Partner": "(SELECT DISTINCT o_custkey FROM orders)", ":Buyer": buyers, ":Market": markets, ":MarketRegion": f"(SELECT DISTINCT n_regionkey FROM {markets})",
        ":MarketPlace": f"(SELECT n_nationkey FROM {markets} UNION ALL SELECT DISTINCT n_regionkey FROM {markets})",
    }
    plain = {
        ":Region": "region", ":Nation": "nation", ":Customer": "customer", ":Supplier": "supplier", ":Part": "part", ":Order": "orders", ":Document": "documents", ":Turn": "conversations", ":ToxicDocument": "(SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)",
        ":Party": "(SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier)", ":Thing": "(SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM orders)",
        **{c: f"(SELECT 1 FROM orders WHERE o_orderstatus = '{v}')" for v, c in (("O", ":OpenOrder"), ("F", ":FinishedOrder"), ("P", ":PendingOrder"))},
    }
    classes = lambda of: " UNION ALL ".join(f"SELECT '{c}' AS class, count(*) AS n FROM {q} HAVING count(*) > 0" for c, q in of.items())
    return {
        "entail_chain": classes(chain),
        "entail_all_types": classes(chain | plain),
        "unfold_all_types": classes(chain | plain),
        "unfold_chain": f"SELECT ':nation/' || n_nationkey AS x, n_name AS name FROM {markets} UNION ALL SELECT ':region/' || r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM {markets})",
        "class_count": "SELECT count(*) AS n FROM customer",
        "class_flag_count": "SELECT count(DISTINCT doc_id) AS n FROM labels WHERE toxic = 1",
        "attr_in_table": "SELECT c_name AS name FROM customer",
        "attr_other_table": "SELECT lang FROM documents NATURAL JOIN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "link_path1": "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey",
        "link_path2": "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
        "link_path3": "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
        "group_count": "SELECT n_name AS n, count(*) AS cnt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        "filter_size": "SELECT ':part/' || p_partkey AS p, p_size::VARCHAR AS z FROM part WHERE p_size > 45",
        "subclass_unfolded": "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) AS n",
        "inverse_unfolded": "SELECT ':order/' || o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
        "exists_unfolded": "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders)",
        "class_dispatch_counts": f"SELECT {status} AS class, count(*) AS n FROM orders GROUP BY 1",
        "triples_by_predicate": f"""
            SELECT p, count(*) AS n FROM (
              SELECT ':name' AS p FROM region UNION ALL SELECT ':name' FROM nation UNION ALL SELECT ':name' FROM customer UNION ALL SELECT ':name' FROM supplier UNION ALL SELECT ':name' FROM part
              UNION ALL SELECT ':inRegion' FROM nation UNION ALL SELECT ':segment' FROM customer UNION ALL SELECT ':inNation' FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT ':inNation' FROM supplier
              UNION ALL SELECT ':size' FROM part UNION ALL SELECT ':placedBy' FROM orders UNION ALL SELECT ':supplies' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
              UNION ALL SELECT ':language' FROM documents UNION ALL SELECT ':role' FROM conversations
              UNION ALL SELECT '{RDF_TYPE}' FROM (SELECT 1 FROM region UNION ALL SELECT 1 FROM nation UNION ALL SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM part UNION ALL SELECT 1 FROM orders UNION ALL SELECT 1 FROM orders WHERE {status} IS NOT NULL UNION ALL SELECT 1 FROM documents UNION ALL SELECT 1 FROM labels WHERE toxic = 1 UNION ALL SELECT 1 FROM conversations)
            ) GROUP BY p""",
        "join_triples": "SELECT ':customer/' || c_custkey AS s, ':inNation' AS p, ':nation/' || n_nationkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT ':supplier/' || s_suppkey, ':inNation', ':nation/' || s_nationkey FROM supplier",
        "literal_triples": "SELECT ':customer/' || c_custkey AS s, ':segment' AS p, c_mktsegment AS o, NULL::VARCHAR AS o_datatype FROM customer UNION ALL SELECT ':part/' || p_partkey, ':size', p_size::VARCHAR, 'xsd:integer' FROM part",
        "composite_template": "SELECT ':turn/' || conv_id || '/' || turn AS iri FROM conversations",
        "link_bridge": "SELECT DISTINCT ':supplier/' || l_suppkey AS s, ':part/' || l_partkey AS o FROM lineitem",
        "link_inverse": "SELECT DISTINCT ':customer/' || o_custkey AS s, ':order/' || o_orderkey AS o FROM orders",
        "axiom_exists_typing": "SELECT DISTINCT ':customer/' || o_custkey AS s FROM orders",
        "subclass_entailment": "SELECT ':Party' AS class, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT ':Thing', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders)",
        "hidden_fk_typing": "SELECT DISTINCT ':order/' || l_orderkey AS s, ':Supplied' AS o FROM lineitem WHERE nullif(l_suppkey, 1) IS NOT NULL",
        "column_profile": "WITH c AS (SELECT 'o_orderkey' AS \"column\", o_orderkey::VARCHAR AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders), n AS (SELECT \"column\", v, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT \"column\", v FROM n WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, v) = 1) SELECT c.\"column\", count(*) AS total, count(c.v) AS non_null, count(DISTINCT c.v) AS n_distinct, any_value(t.v) AS top FROM c JOIN t ON t.\"column\" = c.\"column\" GROUP BY c.\"column\"",
        "value_counts": "SELECT 'l_returnflag' AS \"column\", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL",
        "enum_columns": "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL",
        "top_values": "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL ORDER BY 1 LIMIT 40",
        "pk_candidates": "WITH k AS (SELECT count(*) AS r, count(DISTINCT l_orderkey) AS a, count(DISTINCT (l_orderkey, l_linenumber)) AS b, count(DISTINCT (l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS c FROM lineitem) SELECT 'l_orderkey' AS key, r AS rows, a AS distinct_rows, a = r AS unique FROM k UNION ALL SELECT 'l_orderkey,l_linenumber', r, b, b = r FROM k UNION ALL SELECT 'l_orderkey,l_partkey,l_suppkey,l_linenumber', r, c, c = r FROM k",
        "fk_inclusion": "SELECT 'orders.o_custkey' AS child, 'customer.c_custkey' AS parent, count(DISTINCT o_custkey) AS orphans, count(*) = 0 AS holds FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customer.c_custkey', 'orders.o_custkey', count(DISTINCT c_custkey), count(*) = 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'labels.doc_id', 'documents.doc_id', count(DISTINCT doc_id), count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
        "norm_identifiers": "SELECT DISTINCT p_type, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part",
        "norm_collisions": "SELECT trim(regexp_replace(lower(regexp_replace(c_name, '[0-9]$', '')), '[^a-z0-9]+', '_', 'g'), '_') AS name, count(DISTINCT c_name) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_name) > 1",
        "bag_diff": "SELECT o_orderstatus, o_orderpriority, count(*) AS n_left, 0 AS n_right FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL",
        "prf1_scores": "WITH t AS (SELECT count(*) AS e, count(*) FILTER (c_nationkey < 10) AS r FROM customer) SELECT 1.0::DOUBLE AS precision, r / e AS recall, 2 * (r / e) / (1 + r / e) AS f1 FROM t",
        "report_pivot": f"SELECT s_nationkey, max(score) FILTER (system = 0) AS s0, max(score) FILTER (system = 1) AS s1, max(score) FILTER (system = 2) AS s2 FROM {scores} GROUP BY s_nationkey",
        "report_best": f"SELECT s_nationkey, system, score FROM {scores} QUALIFY rank() OVER (PARTITION BY s_nationkey ORDER BY score DESC) = 1",
        "report_coverage": f"SELECT system, count(score) AS filled, avg(score) AS mean FROM {scores} GROUP BY system",
        "report_baseline_diff": f"SELECT s_nationkey, a.score::DOUBLE AS old, b.score::DOUBLE AS new, (b.score - a.score)::DOUBLE AS delta, CASE WHEN b.score > a.score THEN 'better' WHEN b.score < a.score THEN 'worse' ELSE 'same' END AS state FROM {scores} a JOIN {scores} b USING (s_nationkey) WHERE a.system = 0 AND b.system = 1",
    }
