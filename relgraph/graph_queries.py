"""Driver queries of triples as files, graphs in tables, constraints in data and runs, and their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.operators import constraints as C
from relgraph.operators import graph as G
from relgraph.operators import materialize as M
from relgraph.operators import matching, ranks
from relgraph.plans.mapping import Literal, Mapping, Reference, TriplesMap
from relgraph.plans.patterns import Value, unfold
from relgraph.shared import new_path
from relgraph.sources import ntriples, runs

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()

#: Texts with any characters as literals and in IRIs, numbers, and links.
TEXTS = Mapping(
    (
        TriplesMap("document", "documents", ":document/{doc_id}", (":Document",), ((":text", Literal("text")), (":source", Literal("source"))), key=True),
        TriplesMap("part", "part", ":part/{p_name}/{p_partkey}", (":Part",), ((":size", Literal("p_size")), (":price", Literal("p_retailprice"))), key=True),
        TriplesMap("kind", "SELECT DISTINCT p_name FROM {part}", ":kind/{p_name}", (":Kind",), ((":label", Literal("p_name")),), key=True),
        TriplesMap("made", "part", ":part/{p_name}/{p_partkey}", (), ((":kind", Reference("kind", (("p_name", "p_name"),), True)),), key=True),
        TriplesMap("turn", "conversations", ":turn/{conv_id}/{turn}", (":Turn",), ((":role", Literal("role")), (":says", Literal("text"))), key=True),
    )
)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as N-Triples and read again."""
    path = new_path(spark, "graph.nt")
    ntriples.write(M.triples(spark, _tables(spark, sf_dir), TEXTS), path)
    g = ntriples.read(spark, path)
    return g.select("s", "p", F.sha2("o", 256).alias("sha"), "o_kind", "o_datatype")


def predicate_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predicates of a graph that is stored by predicate."""
    path = new_path(spark, "graph")
    ntriples.write_by_predicate(M.triples(spark, _tables(spark, sf_dir), TEXTS), path)
    return ntriples.read_by_predicate(spark, path, [":kind", ":size"]).select("s", "p", "o")


def iri_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant IRI of two keys, and one whose key is encoded."""
    t = _tables(spark, sf_dir)
    turn = unfold(spark, t, TEXTS, [(":turn/12/1", ":says", "?x")])
    kind = unfold(spark, t, TEXTS, [("?p", ":kind", ":kind/small%20ring"), ("?p", ":size", "?x")])
    return turn.select(F.sha2("x", 256).alias("x")).unionByName(kind.select("x"))


def typed_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unfold(spark, _tables(spark, sf_dir), TEXTS, [("?p", ":size", Value("7")), ("?p", ":price", "?x")])


def supply_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far parts and suppliers are from the first supplier, by who supplies what."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = rows.select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    start = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.min("s_suppkey").alias("k")).select(F.concat(F.lit("s"), "k").alias("node"))
    return G.distances(edges, start)


def reply_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns of a conversation lead to which: pairs of its turns in order."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    node = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    edges = turns.join(after, ["conv_id", "turn"]).select(node(F.col("turn")).alias("a"), node(F.col("turn") + 1).alias("b"))
    return G.reachable(edges)


def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.all_keys(spark, _tables(spark, sf_dir))


def all_inclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.all_inclusions(spark, _tables(spark, sf_dir))


def matched_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's suppliers and customers, by the nearest balance, nobody twice."""
    t = _tables(spark, sf_dir)
    s = t["supplier"].select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").alias("balance"))
    c = t["customer"].select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("balance"))
    return matching.nearest(s, c, ["nation"], "supplier", "customer", "balance")


def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each order by price."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return ranks.ranked(rows, ["o_totalprice", "o_orderkey"])


def frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent parts of each supplier."""
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return ranks.top_values(counts, ["l_suppkey"], "l_partkey", "n", 3)


def _runs(spark: SparkSession, sf_dir: str) -> str:
    """Score files of runs: a system for each priority, a stamp for each year, a dataset for each status."""
    path = new_path(spark, "runs")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.regexp_replace("o_orderpriority", "[^A-Z]", "").alias("system"), F.date_format("o_orderdate", "yyyy").alias("stamp"), F.col("o_orderstatus").alias("dataset"),
        F.concat(F.lit("Q"), "o_orderkey", F.lit(" (order)|"), F.when(F.col("o_orderkey") % 7 == 0, "NaN").otherwise((F.col("o_orderkey") % 100).cast("string")), F.lit("|1.0|0.5")).alias("value"),
    )
    rows.write.partitionBy("system", "stamp", "dataset").text(path)
    return path


def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of each system's and dataset's newest run."""
    path = _runs(spark, sf_dir)
    last = runs.newest(runs.found(spark, path, "*.txt"))
    rows = runs.scores(spark, path).join(last.select(F.regexp_replace("path", "^file:/*", "/").alias("_path"), "system", "stamp", "dataset"), F.regexp_replace("path", "^file:/*", "/") == F.col("_path"))
    name = lambda c: F.regexp_replace(c, "^[a-z]+=", "").alias(c)
    return rows.groupBy(name("system"), name("dataset"), name("stamp")).agg(F.count("*").alias("n"), F.count("f1").alias("filled"), F.sum("f1").alias("total"))


NATIVE = (ntriples_round_trip, predicate_folders, iri_lookup, typed_value, supply_distances, reply_paths, composite_keys, all_inclusions, matched_suppliers, order_ranks, frequent_values, newest_runs)


def queries() -> dict:
    return {f.__name__: f for f in NATIVE}


#: Columns that may be part of a key, and of whole numbers, for the SQL.
KEYABLE = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_mktsegment", "supplier": "s_suppkey s_name s_nationkey",
    "part": "p_partkey p_name p_brand p_type p_size", "orders": "o_orderkey o_custkey o_orderstatus o_orderdate o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type props", "documents": "doc_id text lang source n_chars", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
WHOLE = {
    "region": "r_regionkey", "nation": "n_nationkey n_regionkey", "customer": "c_custkey c_nationkey", "supplier": "s_suppkey s_nationkey", "part": "p_partkey p_size", "orders": "o_orderkey o_custkey",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber", "events": "event_id user_id", "documents": "doc_id n_chars", "labels": "doc_id quality toxic", "conversations": "conv_id turn",
}


def _keys_sql() -> str:
    """All column sets, in order, of which no part is a key."""
    tests = []
    for t, own in KEYABLE.items():
        for k in (1, 2, 3):
            for c in combinations(own.split(), k):
                tests.append(f"SELECT '{t}' AS \"table\", [{', '.join(f'{x!r}' for x in c)}] AS cols, count(*) > 0 AND count(*) = count(DISTINCT {c[0] if k == 1 else '(' + ', '.join(c) + ')'}) AND {' AND '.join(f'count(*) = count({x})' for x in c)} AS ok FROM {t}")
    return f"""
        WITH k AS (SELECT * FROM ({' UNION ALL '.join(tests)}) WHERE ok)
        SELECT "table", array_to_string(cols, ',') AS key, len(cols)::INT AS size FROM k
        WHERE NOT EXISTS (SELECT 1 FROM k p WHERE p."table" = k."table" AND len(p.cols) < len(k.cols) AND len(list_intersect(p.cols, k.cols)) = len(p.cols))"""


def _inclusions_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {c}::BIGINT AS v FROM {t} WHERE {c} IS NOT NULL" for t, own in WHOLE.items() for c in own.split())
    keys = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c FROM {t} HAVING count(*) = count(DISTINCT {c}) AND count(*) > 0" for t, own in WHOLE.items() for c in own.split())
    return f"""
        WITH x AS ({cells}), k AS ({keys}), n AS (SELECT t, c, count(*) AS n FROM x GROUP BY t, c),
        m AS (SELECT x.t, x.c, y.t AS pt, y.c AS pc, count(*) AS m FROM x JOIN (SELECT * FROM x JOIN k USING (t, c)) y USING (v) WHERE x.t <> y.t GROUP BY ALL)
        SELECT t AS "table", c AS "column", pt AS parent, pc AS parent_column FROM m JOIN n USING (t, c) WHERE m = n"""


def oracle_sql() -> dict[str, str]:
    part = "':part/' || replace(p_name, ' ', '%20') || '/' || p_partkey"
    kind = "':kind/' || replace(p_name, ' ', '%20')"
    stamp = "strftime(o_orderdate, '%Y')"
    return {
        "ntriples_round_trip": f"""
            SELECT s, p, sha256(o) AS sha, kind AS o_kind, type AS o_datatype FROM (
              SELECT ':document/' || doc_id AS s, 'rdf:type' AS p, ':Document' AS o, 'iri' AS kind, NULL::VARCHAR AS type FROM documents
              UNION ALL SELECT ':document/' || doc_id, ':text', text, 'literal', NULL FROM documents UNION ALL SELECT ':document/' || doc_id, ':source', source, 'literal', NULL FROM documents
              UNION ALL SELECT {part}, 'rdf:type', ':Part', 'iri', NULL FROM part UNION ALL SELECT {part}, ':size', p_size::VARCHAR, 'literal', 'xsd:integer' FROM part
              UNION ALL SELECT {part}, ':price', p_retailprice::VARCHAR, 'literal', 'xsd:double' FROM part UNION ALL SELECT {part}, ':kind', {kind}, 'iri', NULL FROM part
              UNION ALL SELECT DISTINCT {kind}, 'rdf:type', ':Kind', 'iri', NULL FROM part UNION ALL SELECT DISTINCT {kind}, ':label', p_name, 'literal', NULL FROM part
              UNION ALL SELECT ':turn/' || conv_id || '/' || turn, 'rdf:type', ':Turn', 'iri', NULL FROM conversations UNION ALL SELECT ':turn/' || conv_id || '/' || turn, ':role', role, 'literal', NULL FROM conversations
              UNION ALL SELECT ':turn/' || conv_id || '/' || turn, ':says', text, 'literal', NULL FROM conversations)""",
        "predicate_folders": f"SELECT {part} AS s, ':kind' AS p, {kind} AS o FROM part UNION ALL SELECT {part}, ':size', p_size::VARCHAR FROM part",
        "iri_lookup": "SELECT sha256(text) AS x FROM conversations WHERE conv_id = 12 AND turn = 1 UNION ALL SELECT p_size::VARCHAR FROM part WHERE p_name = 'small ring'",
        "typed_value": f"SELECT {part} AS p, p_retailprice::VARCHAR AS x FROM part WHERE p_size = 7",
        "supply_distances": """
            WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
            r AS (SELECT 's' || min(s_suppkey) AS node, 0 AS distance FROM supplier UNION SELECT u.b, r.distance + 1 FROM r JOIN u ON u.a = r.node WHERE r.distance < 10)
            SELECT node, min(distance)::INT AS distance FROM r GROUP BY node""",
        "reply_paths": """
            WITH RECURSIVE e AS (SELECT DISTINCT x.conv_id, x.turn FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1),
            r AS (SELECT conv_id, turn, turn + 1 AS last FROM e UNION SELECT r.conv_id, r.turn, r.last + 1 FROM r JOIN e ON e.conv_id = r.conv_id AND e.turn = r.last)
            SELECT conv_id || '/' || turn AS node, conv_id || '/' || last AS "to" FROM r""",
        "composite_keys": _keys_sql(),
        "all_inclusions": _inclusions_sql(),
        "order_ranks": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders",
        "frequent_values": "SELECT * FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) <= 3",
        "newest_runs": f"""
            WITH r AS (SELECT regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') AS system, o_orderstatus AS dataset, {stamp} AS stamp, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 100 END AS f1 FROM orders)
            SELECT system, dataset, stamp, count(*) AS n, count(f1) AS filled, sum(f1)::DOUBLE AS total FROM r
            WHERE stamp = (SELECT max(stamp) FROM r x WHERE x.system = r.system AND x.dataset = r.dataset) GROUP BY ALL""",
    }
