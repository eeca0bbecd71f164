"""The queries opN_<name>: each numbered operator on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.llm import audit, decontam, hamming, licenses, lines, lm, mixing, ngram_join, quality, sharding, toxicity, trie, warc
from relgraph.llm.quality import STOP_WORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), remainder(10) == 0)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *measures, "base_failed", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *columns)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "shard")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))["documents"].select("doc_id", "size", "source_size", "target", "taken")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_join, op2_lm_scoring, op3_warc, op4_quality, op5_decontamination, op6_licenses, op7_sharding, op8_toxicity, op9_line_dedup, op10_mixing, op11_minhash, op12_filter_audit, op13_prefix_trie)}


_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _linked_sql(k: int, num: int) -> str:
    """Components by ``k``-word shingles at ``num`` hundredths."""
    return rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + {k - 1}], ' ') AS gram
              FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {k - 2}, 2))) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= {num} * (p.n + q.n - m)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) k ON k.a = d.doc_id"""


AUDIT_SQL = rf"""
    WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
    f AS (SELECT part, doc_id, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
                 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
                 doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails FROM w),
    g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
          FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS own,
                 list_transform(string_split(filter_order[1:step - 1], ''), lambda x: ascii(x) - 64) AS before
          FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
    r AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS here, list_bool_or([false] || list_transform(list_filter(before, lambda x: x > 0), lambda x: fails[x])) AS earlier,
                 len(list_filter(fails, lambda x: x)) = 1 AS one FROM g, s),
    c AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (here AND NOT earlier), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (here AND earlier), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (here AND one), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (here AND NOT earlier), 0)::BIGINT AS good_lost,
                 coalesce(sum(toxic) FILTER (here AND NOT earlier), 0)::BIGINT AS toxic_lost
          FROM r GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c"""

TRIE_SQL = """
    WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    i AS (SELECT conv_id, dense_rank() OVER (ORDER BY role, text) AS id, strlen(text) AS bytes,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM o),
    b AS (SELECT DISTINCT id, bytes FROM i),
    q AS (SELECT conv_id, list(id ORDER BY pos) AS seq FROM i GROUP BY conv_id),
    -- CRC-32, bit by bit: a step takes a byte or 0 in, and shifts.
    h AS (SELECT conv_id, seq, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0])),
                 lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384))) % 9 AS h FROM q),
    r AS (SELECT h.conv_id AS c, coalesce(p.seq, [])[1:h.h] || h.seq[h.h + 1:] AS seq FROM h LEFT JOIN q p ON p.conv_id = h.conv_id - h.conv_id % 5),
    m AS (SELECT c, seq[1:d] AS node, d, len(seq) = d AS over FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
    n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (over), '')) AS ends FROM m GROUP BY node, d),
    k AS (SELECT node[1:d - 1] AS node, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL),
    s AS (SELECT n.node, d, conv_id, n, ends, coalesce(children, 0) AS children, CASE WHEN d > 0 THEN (n - 1) * bytes ELSE 0 END AS saved
          FROM n LEFT JOIN k USING (node) LEFT JOIN b ON b.id = n.node[n.d]),
    t AS (SELECT node[1:e] AS node, sum(saved) AS saved, count(*) FILTER (children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM s) GROUP BY ALL)
    SELECT s.conv_id, s.d::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n AS n_convs, s.children::BIGINT AS n_children,
           t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, s.ends AS ends_sha256
    FROM s JOIN t USING (node) LEFT JOIN n p ON s.d > 0 AND p.d = s.d - 1 AND p.node = s.node[1:s.d - 1]"""


def oracle_sql() -> dict[str, str]:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return {
        "op1_ngram_join": _linked_sql(3, 90),
        "op11_minhash": f"SELECT *, doc_id = component_id AS kept FROM ({_linked_sql(4, 80)})",
        "op12_filter_audit": AUDIT_SQL,
        "op13_prefix_trie": TRIE_SQL,
        "op3_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
            f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100) END AS keeper FROM d)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN keeper <> page_id THEN keeper END AS refers_to
            FROM f""",
        "op4_quality": rf"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
            w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                         list_filter(string_split(text, chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS lines FROM t),
            n AS (SELECT *, len(words) AS n_words FROM w),
            g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram
                  FROM (SELECT doc_id, words, unnest(range(1, n_words - 6)) AS i FROM n WHERE n_words >= 8)),
            r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
            v AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(8) AS s(k) GROUP BY doc_id),
            m AS (SELECT n.doc_id, n_words, length(array_to_string(words, '')) AS word_chars,
                         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                         len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
                         len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop,
                         coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS longest
                  FROM n LEFT JOIN v USING (doc_id)),
            b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
            SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
                   n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
                   NOT base_failed AND n_words >= 20 AND word_chars / n_words BETWEEN 1.5 AND 20.0 AND n_symbols / n_words <= 0.3
                   AND n_upper / word_chars <= 0.5 AND n_stop / n_words >= 0.02
                   AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AND longest <= 2000 AS kept
            FROM b""",
        "op9_line_dedup": f"""
            WITH l AS (SELECT doc_id, line, {_LOWER.format(f"trim(line, {_BLANK})")} AS key, i
                       FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                                    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
            k AS (SELECT key, min(doc_id) AS keeper FROM l WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
            d AS (SELECT l.doc_id, l.line, l.i, k.keeper IS NOT NULL AND k.keeper <> l.doc_id AS dropped FROM l LEFT JOIN k ON l.key = k.key)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
            FROM d GROUP BY doc_id""",
    }
