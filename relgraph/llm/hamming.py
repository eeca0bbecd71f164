"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures.

A text's set is its distinct ``k``-word shingles of lower-cased words. Two documents link when
``den * |intersection| >= num * |union|``; links are confirmed on the full sets.

1. A signature has 80 symbols of 16 bits, the low bits of the least values of 80 hash functions
   over the set. Its distance to another is the number of symbols that differ: each does with
   probability 1 - J (and agrees by chance with 2 ** -16).
2. It is split into 20 chunks of 4 symbols. Of two signatures that differ in at most 39 symbols,
   some chunk differs in at most one (pigeonhole: 20 chunks with two errors are 40). For each
   chunk all places of one error are enumerated: a key is a chunk without one of its symbols,
   so that signatures within the distance share one of 80 keys, all of them, without fail.
   A pair at J = 0.8, the hardest that links, is beyond the distance with probability 2e-9.
3. Documents of equal sets are one class, seen through its smallest doc_id. Classes meet on keys
   in rounds, none of which makes all pairs of a key's classes rows. In each, a key's leader is its
   most central class, whose keys are the most common, and each class meets the most central of its
   keys' leaders that it is not connected with: one pair a class. Once open pairs are few for each
   key, or a round no longer halves them, the rest is dealt into blocks, whose pairs are formed and
   compared in numpy; only those that pass the filters are rows, and only at the least key that they
   share.
4. Filters, before any set is sent: the sizes, the distance, and sketches of the sets, which bound
   from below how many shingles only one of them has.
5. What passes and was not tested before is confirmed: a class's set meets those of its partners
   in parts of bounded size, not once for each pair.

Defined cases: a text without words (null, empty) has an empty set and links with nothing; a
shorter text is one shingle; rows without doc_id have a set but no links and no component, and
are not kept; rows with equal doc_id and different texts are documents of their own under one
number; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm import words as W
from relgraph.llm.common import components, freed, looked_up, packed, small_batches, stored
from relgraph.llm.ngram_join import _apart, _sets, allowed, apart, made_sets, name, sketch

CHUNKS, WIDE, ERRORS = 20, 4, 1
SYMBOLS = CHUNKS * WIDE
#: The distance within which signatures share a key.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Classes of a block of a crowded key.
BLOCK = 1024
#: Open pairs for each entry of a key up to which blocks take all of them at once.
FEW = 8
#: Bytes of sets that meet one class's set in one task.
MEET_BYTES = 4 << 20

_random = np.random.default_rng(80)
_ODD = _random.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_SALT = _random.integers(1, 2**63, (CHUNKS, WIDE, WIDE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit symbols for each set; zeros for empty ones."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    for j in range(SYMBOLS):
        least = np.minimum.reduceat(flat * _ODD[j] + _ADD[j], first)
        out[full, j] = (W.mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def keys(rows: np.ndarray) -> np.ndarray:
    """The 80 keys of each signature: its chunks, each without one of its symbols."""
    chunks = rows.reshape(len(rows), CHUNKS, 1, WIDE).astype(np.uint64) + np.uint64(1)
    left = chunks * np.where(np.eye(WIDE, dtype=bool), np.uint64(0), _SALT)
    return W.mix(left.sum(-1, dtype=np.uint64) + _SALT[:, :, 0]).reshape(len(rows), CHUNKS * WIDE)


def classes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, h1, h2, signature, sketch): set size, 128 bits that name the set, its symbols,
    and parities of its hashes by range."""

    def go(batches):
        for b in batches:
            for lo, hi in W.slices(b.column("text")):
                sets = list(_sets(b.column("text").slice(lo, hi - lo), k))
                h = np.array([name(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                made = pa.array([x.tobytes() for x in signatures(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), made, pa.array([sketch(x) for x in sets], pa.binary())], ["doc_id", "n", "h1", "h2", "signature", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, "doc_id long, n long, h1 long, h2 long, signature binary, sketch binary")


def entries(named: DataFrame) -> DataFrame:
    """(token, id, n): the keys of each class."""

    def go(batches):
        for b in batches:
            rows = _matrix(b.column("signature"))
            flat = keys(rows).reshape(-1).view(np.int64)
            ids, n = (np.repeat(b.column(c).to_numpy(), CHUNKS * WIDE) for c in ("id", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids), pa.array(n)], ["token", "id", "n"])

    return named.select("id", "n", "signature").mapInArrow(go, "token long, id long, n long")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint16).reshape(-1, SYMBOLS)


def within(pairs: DataFrame, n: int, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs``, ``n`` at most, that sizes, signatures and sketches leave room for."""

    def check(batches):
        for b in batches:
            near = (_matrix(b.column("x")) != _matrix(b.column("y"))).sum(1) <= DISTANCE
            b = b.filter(pa.array(near))
            rows = zip(*(b.column(c).to_pylist() for c in ("nx", "sx", "ny", "sy")))
            keep = [den * min(nx, ny) >= num * max(nx, ny) and apart(x, y) <= allowed(nx, ny, num, den) for nx, x, ny, y in rows]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wide = pairs
    for c, s in (("a", "x"), ("b", "y")):
        wide = looked_up(wide, marks.select(F.col("id").alias(c), F.col("n").alias(f"n{s}"), F.col("signature").alias(s), F.col("sketch").alias(f"s{s}")), [c], n)
    return wide.select("a", "b", "nx", "x", "sx", "ny", "y", "sy").mapInArrow(check, "a long, b long").distinct()


def crowded(open_: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) that pass the filters among ``open_`` (token, id, n, c) with a common token and
    different c, at the least token that they share. A token of many classes is dealt into blocks, each two of which meet in a task of
    their own; tokens of one block meet in buckets."""
    rows = open_.join(marks, ["id", "n"])
    sizes = open_.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    buckets = max(12, -(-open_.count() // BLOCK))
    own = rows.join(sizes, "token").withColumn("own", F.pmod(F.xxhash64("id", "n"), "blocks").cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    own = own.withColumn("place", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("token"), F.lit(buckets))).otherwise(F.col("token")))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("token")
        token, ids, n, c, block = (t.column(x).to_numpy() for x in ("token", "id", "n", "c", "own"))
        symbols = _matrix(t.column("signature"))
        own_keys = keys(symbols).view(np.int64)
        two = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        found = [np.zeros((0, 2), np.int64)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for x in range(lo, hi - 1):
                y = np.arange(x + 1, hi)
                y = y[(ids[y] != ids[x]) & (c[y] != c[x]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])) & (not two or block[y] != block[x])]
                y = y[(symbols[y] != symbols[x]).sum(1) <= DISTANCE] if len(y) else y
                shared = np.where(own_keys[y] == own_keys[x], own_keys[y], np.iinfo(np.int64).max).min(1) if len(y) else y
                y = y[shared == token[x]]
                found.append(np.stack([np.full(len(y), x), y], 1))
        x, y = np.concatenate(found).T
        near = _apart(t.column("sketch").combine_chunks(), x, y) <= n[x] + n[y] - 2 * -(-num * (n[x] + n[y]) // (num + den)) if len(x) else np.zeros(0, bool)
        a, b = np.unique(np.stack([np.minimum(ids[x], ids[y])[near], np.maximum(ids[x], ids[y])[near]], 1), axis=0).T
        return pa.table({"a": a, "b": b})

    own = own.select("place", "i", "j", "token", "id", "n", "c", "own", "signature", "sketch")
    return own.groupBy("place", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs``, a table, that link, by their full sets. Partners b of one a are
    dealt into parts of bounded bytes; a's set goes to each part once."""
    n = pairs.count()
    if not n:
        return pairs
    made = made_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), 2 * n, docs, k)
    sizes = made.groupBy(F.col("id").alias("a")).agg(F.max(F.octet_length("set")).alias("size"), F.count("*").alias("rows"))
    if sizes.agg(F.max("rows")).first()[0] > 1:  # repeated rows
        made = made.dropDuplicates(["id", "set"])
    parts = pairs.groupBy("a").agg(F.count("*").alias("m")).join(sizes, "a")
    parts = parts.select("a", F.greatest(F.lit(1), F.ceil(F.col("m") * F.col("size") / MEET_BYTES)).cast("int").alias("parts"))
    dealt = looked_up(pairs, parts, ["a"], n).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    right = looked_up(dealt.select("a", "part", "b"), made.select(F.col("id").alias("b"), "set"), ["b"], n)
    left = parts.join(made.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "set")
    both = left.select("a", "part", F.lit(None).cast("long").alias("b"), "set").unionByName(right.select("a", "part", "b", "set"))
    buckets = max(12, -(-n // 200))
    both = both.withColumn("place", F.pmod(F.xxhash64("a", "part"), F.lit(buckets)))

    def links(x: np.ndarray, y: np.ndarray) -> bool:
        if not len(x) or not len(y):
            return False
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        same = int((y[at] == x).sum())
        return den * same >= num * (len(x) + len(y) - same)

    def meet(t: pa.Table) -> pa.Table:
        own: dict[tuple[int, int], list] = {}
        rows = list(zip(*(t.column(c).to_pylist() for c in ("a", "part", "b")), t.column("set").combine_chunks()))
        as_set = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
        for a, part, b, s in rows:
            if b is None:  # rows of one doc_id and different texts have several sets
                own.setdefault((a, part), []).append(as_set(s))
        found = {(a, b) for a, part, b, s in rows if b is not None and any(links(x, as_set(s)) for x in own[a, part])}
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return both.groupBy("place").applyInArrow(meet, "a long, b long").distinct()


def linked(docs: DataFrame, k: int = 4, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``documents`` (doc_id, n, h1, h2), ``named`` classes (id, n, h1, h2) and ``roots``
    (node, root) of the classes that are not their own root."""
    spark = docs.sparkSession
    small_batches(spark)
    sets = stored(classes(docs, k), "signatures")
    named = sets.where("doc_id is not null and n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    named = stored(named, "classes")
    every = entries(named)
    met = every.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    now = stored(every.join(met, "token"), "entries")
    n = now.count()
    marks = stored(named.select("id", "n", "signature", "sketch").join(now.select("id", "n").distinct(), ["id", "n"], "left_semi"), "marks")
    freed(spark)
    none = spark.createDataFrame([], "a long, b long")
    links, tested, roots = none, none, spark.createDataFrame([], "node long, root long")

    def learn(candidates: DataFrame) -> None:
        nonlocal links, tested, roots
        new = stored(candidates.join(tested, ["a", "b"], "left_anti"), "candidates")
        found = stored(confirmed(new, docs, k, num, den), "found")
        tested = stored(packed(tested.unionByName(new), new.count(), 100_000), "tested")
        if not found.isEmpty():
            links = stored(links.unionByName(found), "links")
            roots = components(links)
        freed(spark)

    before = None
    while True:
        own = looked_up(now, roots.select(F.col("node").alias("id"), "root"), ["id"], n, "left")
        own = stored(own.select("token", "id", "n", F.coalesce("root", "id").alias("c")), "open")
        per = own.groupBy("token", "c").agg(F.count("*").alias("m"))
        per = per.groupBy("token").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("pairs"), F.sum("m").alias("m")).where("pairs > 0")
        per = stored(per, "open-tokens")
        total = per.agg(F.sum("pairs")).first()[0]
        if not total:
            break
        own = own.join(per.select("token", "m"), "token")
        if total <= FEW * n or before is not None and 2 * total > before:
            learn(crowded(stored(own.select("token", "id", "n", "c"), "rest"), marks, num, den))
            break
        before = total
        central = own.groupBy("id").agg(F.sum("m").alias("score"))
        own = stored(own.join(central, "id").select("token", "id", "n", "c", F.struct("score", (-F.col("id")).alias("minus"), "c").alias("as_lead")), "scored")
        lead = own.groupBy("token").agg(F.max("as_lead").alias("lead"))
        best = own.join(lead, "token").where(F.col("c") != F.col("lead.c")).groupBy("id").agg(F.max("lead").alias("lead"))
        other = -F.col("lead.minus")
        learn(within(best.select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b")).distinct(), n, marks, num, den))
        now = own.select("token", "id", "n")
    return sets.select("doc_id", "n", "h1", "h2"), named, roots


def dedup(docs: DataFrame, k: int = 4, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept): a row per document; the smallest
    doc_id of each component is kept."""
    sets, named, roots = linked(docs, k, num, den)
    key = ["h1", "h2", "n"]
    known = looked_up(sets.where("doc_id is not null and n > 0"), named.select(*key, F.col("id").alias("class_id")), key, sets.count())
    rows = known.unionByName(sets.where("doc_id is null or n = 0").withColumn("class_id", F.col("doc_id")))
    out = rows.join(roots, rows["class_id"] == roots["node"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("root", "class_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
