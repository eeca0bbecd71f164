"""N-gram Jaccard join: which documents share at least a given part of their word n-grams.

A document's set is its distinct ``k``-word shingles of lower-cased words. Two documents
link when ``den * |intersection| >= num * |union|``.

1. Shingles are ordered rare first. Their frequencies over all documents are kept by hash
   bucket in a table of bounded size; any common order is right, rarity only makes it fast.
2. Documents with equal sets are one class, seen through its smallest doc_id.
3. A class's prefix is its first n - ceil(t n) + 1 shingles; linked sets share a prefix
   shingle. Classes meet on prefix shingles that two or more of them have.
4. A pair is a candidate if its lengths and the positions of the shared shingle leave room
   for enough overlap (length and positional filters). Sketches, one bit of parity for each
   hash range, then bound the difference (suffix filter) before any set is sent; what is left
   is intersected, once per pair.
   The smaller set meets the larger one by its front rows only, which are about half.
5. No round forms all pairs of a shingle's classes. In each, the class with the fewest rarer
   shingles, the nearest to a group's middle, is compared with the shingle's other classes and
   is done there; classes found connected are not compared again. Links that this leaves out
   join classes that other links connect already: the links found give the components, not the
   number of links. Once a round no longer halves the pairs that are open, what is left does
   mostly not link: it is dealt into blocks, where pairs are formed and filtered in numpy, and
   only those that pass are rows.
6. Where links are to be counted, each component's classes are dealt into blocks, each two
   blocks' sets meet in a task of their own, and counts by class are all that leaves it. That
   work grows with the square of a component's classes, as its links may.

Defined cases: a text without words (null, empty) has an empty set and links with nothing;
a shorter text is one shingle; rows without doc_id have a set but no links and no component;
rows with equal doc_id and different texts count as documents of their own under one number;
other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.llm import words as W
from relgraph.llm.common import components, freed, looked_up, packed, small_batches, stored

#: Words per bucket of the frequency table, and its least and most bits (64 MB of counts).
WORDS_PER_BUCKET = 64
BITS = (16, 24)
PARTS = 64
#: A sketch has two to four bits a shingle; the logarithm of their least and most number.
SKETCH_BITS = (6, 20)
#: The table of documents in pairs has 2 ** 15 bits at least and 2 ** 27 (16 MB) at most.
SLOT_BITS = (15, 27)
#: Classes, and bytes of sketches or sets, of a block.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
#: Pairs, or words of sketches, that a task looks at together.
PAIRS = 1 << 18


def _sets(texts: pa.Array, k: int):
    """Each text's sorted distinct shingle hashes."""
    for lo, hi in W.slices(texts):
        s, first = W.shingles(W.words(texts.slice(lo, hi - lo)), k)
        for a, b in zip(first[:-1], first[1:]):
            own = np.sort(s[a:b])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own


def name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    if not len(s):
        return 0, 0
    return int(W.mix(s).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(W.mix(s + np.uint64(1))))


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Shingle counts over all documents by the low bits of the hash."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.log2(max(size, 1) / 6 / WORDS_PER_BUCKET), *BITS))
    mask, part = np.uint64((1 << bits) - 1), (1 << bits) // PARTS

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        for b in batches:
            t = b.column("text")
            for lo, hi in W.slices(t):
                s, _ = W.shingles(W.words(t.slice(lo, hi - lo)), k)
                total += np.bincount((s & mask).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        data = [zlib.compress(x.tobytes(), 1) for x in total.reshape(PARTS, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(data, pa.binary())], ["part", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(part, np.uint32)
        for x in t.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    tables = docs.select("text").mapInArrow(count, "part int, counts binary")
    # Two levels, so that no task holds the tables of all tasks.
    some = tables.groupBy("part", (F.spark_partition_id() % 64).alias("_some")).applyInArrow(add, "part int, counts binary")
    rows = some.groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    total = np.zeros((PARTS, part), np.uint32)
    for r in rows:
        total[r.part] = np.frombuffer(zlib.decompress(r.counts), np.uint32)
    return total.reshape(-1)


def sketch(s: np.ndarray) -> bytes:
    """Whether a set's number of hashes is odd, by ranges of their middle bits."""
    bits = int(np.clip(np.ceil(np.log2(2 * max(len(s), 1))), *SKETCH_BITS))
    at = (s >> np.uint64(20)) & np.uint64((1 << bits) - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=1 << bits) & 1, bitorder="little").tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches (last axis) as they are with ``size`` words: halves are added."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def apart(x: bytes, y: bytes) -> int:
    """At most the number of shingles that only one of two sketched sets has."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def allowed(n: int, m: int, num: int, den: int) -> int:
    """How many shingles of linked sets of ``n`` and ``m`` one of them may lack."""
    return n + m - 2 * -(-num * (n + m) // (num + den))


def prefixes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, h1, h2, prefix, sketch): set size, 128 bits that name the set, rarest
    shingles, counts by hash range."""
    counts = docs.sparkSession.sparkContext.broadcast(frequencies(docs, k))

    def go(batches):
        often = counts.value
        mask = np.uint64(len(often) - 1)
        for b in batches:
            for lo, hi in W.slices(b.column("text")):
                n, names, prefix, ranges = [], [], [], []
                for s in _sets(b.column("text").slice(lo, hi - lo), k):
                    n.append(len(s))
                    names.append(name(s))
                    p = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    prefix.append(s[np.lexsort((s, often[s & mask]))[:p]])
                    ranges.append(sketch(s))
                at = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
                flat = np.concatenate([*prefix, np.zeros(0, np.uint64)]).view(np.int64)
                h = np.array(names, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(ranges, pa.binary())], ["doc_id", "n", "h1", "h2", "prefix", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, "doc_id long, n long, h1 long, h2 long, prefix array<long>, sketch binary")


def _need(total, num: int, den: int) -> Column:
    """Shared shingles that sets of ``total`` shingles together must have to link."""
    return F.floor((num * total + num + den - 1) / F.lit(num + den))


def _room(nx, px, ny, py, num: int, den: int) -> Column:
    """Length and positional filters of the first shingle that two sets share, at px of nx
    and py of ny: what they share is there and behind it. Linked sets pass with their first."""
    return (den * F.least(nx, ny) >= num * F.greatest(nx, ny)) & (F.least(nx - px, ny - py) >= _need(nx + ny, num, den))


def near(pairs: DataFrame, most: int, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs``, ``most`` at most, whose sketches leave room for a link
    (suffix filter)."""

    def check(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("nx", "x", "ny", "y")))
            keep = [apart(x, y) <= allowed(nx, ny, num, den) for nx, x, ny, y in rows]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = marks.select(F.col("id").alias("a"), F.col("n").alias("nx"), F.col("sketch").alias("x"))
    y = marks.select(F.col("id").alias("b"), F.col("n").alias("ny"), F.col("sketch").alias("y"))
    wide = pairs.join(x, "a").join(y, "b").select("a", "b", "nx", "x", "ny", "y")
    return packed(wide, most).mapInArrow(check, "a long, b long")


def crowded(entries: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of ``entries`` (token, id, n, pos, front, c) with a common token and
    different c that pass all filters. A token with many entries is dealt into blocks, and each
    two blocks meet in a task of their own; tokens of one block meet in buckets."""
    entries = stored(entries.join(marks, ["id", "n"]), "marked")
    n, size = entries.agg(F.count("*"), F.sum(F.octet_length("sketch"))).first()
    buckets = max(12, -(-n // BLOCK_ROWS), -(-(size or 0) // BLOCK_BYTES))
    sizes = entries.groupBy("token").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.octet_length("sketch")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = entries.join(sizes, "token").withColumn("own", F.pmod(F.xxhash64("id", "n"), "blocks").cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    own = own.withColumn("place", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("token"), F.lit(buckets))).otherwise(F.col("token"))).drop("blocks", "other")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("token")
        token, ids, n, pos, c, block, front = (t.column(x).to_numpy() for x in ("token", "id", "n", "pos", "c", "own", "front"))
        begin, end = np.searchsorted(token, token, "left"), np.searchsorted(token, token, "right")
        two = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        found = [np.zeros((0, 2), np.int64)]
        for at in _some(np.flatnonzero(front), (end - begin)[front], PAIRS):
            many = (end - begin)[at]
            x = np.repeat(at, many)
            y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + begin[x]
            ok = (n[x] <= n[y]) & (ids[x] != ids[y]) & (c[x] != c[y]) & (den * n[x] >= num * n[y]) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= -(-num * (n[x] + n[y]) // (num + den)))
            if two:
                ok &= block[x] != block[y]
            found.append(np.stack([x[ok], y[ok]], 1))
        x, y = np.concatenate(found).T
        # A pair is looked at once, whatever it has in common here.
        key = np.stack([ids[x], n[x], ids[y], n[y]], 1)
        once = np.unique(key, axis=0, return_index=True)[1]
        x, y = x[once], y[once]
        room = n[x] + n[y] - 2 * -(-num * (n[x] + n[y]) // (num + den))
        near = _apart(t.column("sketch").combine_chunks(), x, y) <= room
        a, b = np.minimum(ids[x], ids[y])[near], np.maximum(ids[x], ids[y])[near]
        return pa.table({"a": a, "b": b})

    return own.groupBy("place", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _some(at: np.ndarray, cost: np.ndarray, most: int):
    """``at`` in pieces whose ``cost`` is about ``most``."""
    piece = np.cumsum(cost) // most
    return np.split(at, np.flatnonzero(np.diff(piece)) + 1)


def _apart(sketches: pa.Array, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As ``apart`` for the rows x and y of ``sketches``."""
    marks = [np.frombuffer(s.as_buffer(), np.uint64) for s in sketches]
    size = np.array([len(m) for m in marks], np.int64)
    out = np.zeros(len(x), np.int64)
    both = np.stack([size[x], size[y]], 1)
    for kx, ky in np.unique(both, axis=0):
        k = min(kx, ky)
        rows = np.flatnonzero((both == (kx, ky)).all(1))
        for some in _some(rows, np.full(len(rows), k), PAIRS):
            left, right = (folded(np.stack([marks[i] for i in z[some]]), k) for z in (x, y))
            out[some] = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
    return out


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(slots).cast("long"))


def made_sets(ids: DataFrame, n: int, docs: DataFrame, k: int) -> DataFrame:
    """(id, set) of the documents in ``ids``, about ``n``, and of some others. Sets are made
    anew, where the texts are read; the documents are told by a bit per hash of doc_id in a
    table of bounded size, so that no text is shuffled."""
    slots = 1 << int(np.clip(np.ceil(np.log2(16 * n)), *SLOT_BITS))
    ids = ids.select((_slot(slots) + 1).alias("slot"))
    rows = ids.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    table = np.zeros((slots >> 15, 4096), np.uint8)
    for r in rows:
        table[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    asked = docs.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def sets(batches):
        for b in batches:
            slot = b.column("slot").to_numpy()
            b = b.filter(pa.array((asked.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0))
            for lo, hi in W.slices(b.column("text")) if b.num_rows else ():
                x = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([x.column("id"), pa.array([s.tobytes() for s in _sets(x.column("text"), k)], pa.binary())], ["id", "set"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text").withColumn("slot", _slot(slots))
    return stored(texts.mapInArrow(sets, "id long, set binary"), "sets")


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs`` that link."""
    pairs = stored(pairs, "pairs")
    n = pairs.count()
    if not n:
        return pairs
    made = made_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), 2 * n, docs, k)
    if made.groupBy("id").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] > 1:  # repeated rows
        made = made.dropDuplicates(["id", "set"])
    wide = pairs.join(made.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(made.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def links(x: np.ndarray, y: np.ndarray) -> bool:
        if not len(x) or not len(y):
            return False
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        same = int((y[at] == x).sum())
        return den * same >= num * (len(x) + len(y) - same)

    def check(batches):
        for b in batches:
            keep = [links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("x"), b.column("y"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return packed(packed(wide, n, 200).mapInArrow(check, "a long, b long").distinct(), n)


def link_counts(named: DataFrame, roots: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, n_links): with how many other classes each class of ``roots`` links, exactly."""
    nodes = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "nodes")
    n = nodes.count()
    if not n:
        return docs.sparkSession.createDataFrame([], "node long, n_links long")

    def names(batches):
        for b in batches:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("set")]
            h = np.array([name(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([len(s) for s in sets], pa.int64()), b.column("set")], ["id", "h1", "h2", "n", "set"])

    key = ["id", "h1", "h2", "n"]
    made = made_sets(nodes.select(F.col("node").alias("id")), n, docs, k).mapInArrow(names, "id long, h1 long, h2 long, n long, set binary")
    made = made.join(named.select(*key), key, "left_semi").dropDuplicates(key)
    made = stored(made.join(nodes.select(F.col("node").alias("id"), "root"), "id").select("root", "id", "set"), "class-sets")
    sizes = made.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.octet_length("set")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = made.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select("root", "i", "j", "own", "id", "set")

    def count(t: pa.Table) -> pa.Table:
        ids, block = t.column("id").to_numpy(), t.column("own").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set").combine_chunks()]
        n = np.array([len(s) for s in sets])
        at = np.cumsum(n) - n
        every, flat = np.unique(np.concatenate(sets), return_inverse=True)
        found = [np.zeros((0, 2), np.int64)]
        for x in np.flatnonzero(block == i):
            has = np.zeros(len(every), np.int64)
            has[flat[at[x] : at[x] + n[x]]] = 1
            same = np.add.reduceat(has[flat], at)
            y = np.flatnonzero((block == j) & (ids != ids[x]) & (den * same >= num * (n + n[x] - same)))
            found.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], 1))
        # A number's sets are all of one block: no other task sees these pairs.
        node, many = np.unique(np.unique(np.concatenate(found), axis=0), return_counts=True)
        return pa.table({"node": node, "n_links": many})

    return own.groupBy("root", "i", "j").applyInArrow(count, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def linked(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``documents`` (doc_id, n_shingles, class_id), ``named`` classes (id, h1, h2, n, ...) and
    ``roots`` (node, root) of the classes that have links and are not their own root."""
    small_batches(docs.sparkSession)
    sets = stored(prefixes(docs, k, num, den), "prefixes")
    named = sets.where("doc_id is not null and n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("size"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    named = stored(named, "classes")
    rows = named.select("id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    # The smaller of two linked sets has their first shared shingle this far in front.
    front = (F.col("n") - F.col("pos") >= _need(2 * F.col("n"), num, den)).alias("front")
    met = rows.groupBy("token").agg(F.count("*").alias("m"), F.max(front).alias("any")).where("m > 1 and any").select("token")
    entries = stored(rows.join(met, "token"), "entries").select("token", "id", "n", "pos", front)
    marks = stored(named.select("id", "n", "sketch").join(entries.select("id").distinct(), "id", "left_semi"), "marks")
    freed(docs.sparkSession)
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    before = None
    while True:
        e = entries.withColumn("c", F.col("id"))
        if before is not None:
            e = stored(entries.join(roots, entries["id"] == roots["node"], "left").select("token", "id", "n", "pos", "front", F.coalesce("root", "id").alias("c")), "open")
        per = e.groupBy("token", "c").agg(F.count("*").alias("m"), F.count_if("front").alias("k"))
        per = per.groupBy("token").agg((F.sum("m") * F.sum("k") - F.sum(F.col("m") * F.col("k"))).alias("pairs"), F.sum("m").alias("m")).where("pairs > 0")
        per = stored(per, "open-tokens")
        total, rows_left = per.agg(F.sum("pairs"), F.sum("m")).first()
        if not total:
            break
        e = e.join(per.select("token"), "token")
        if before is not None and 2 * total > before:
            found = verified(crowded(e, marks, num, den), docs, k, num, den)
            roots = components(stored(links.unionByName(found), "links"))
            break
        before = total
        low = e.where("front").groupBy("token").agg(F.min(F.struct("pos", "n", "id", "c")).alias("low"))
        e = e.join(low, "token").where(F.col("id") != F.col("low.id"))
        pairs = e.where((F.col("c") != F.col("low.c")) & _room(F.col("n"), F.col("pos"), F.col("low.n"), F.col("low.pos"), num, den))
        pairs = pairs.select(F.least("id", "low.id").alias("a"), F.greatest("id", "low.id").alias("b")).distinct()
        found = stored(verified(near(pairs, rows_left, marks, num, den), docs, k, num, den), "found")
        if not found.isEmpty():
            links = stored(links.unionByName(found), "links")
            roots = components(links)
        entries = e.select("token", "id", "n", "pos", "front")
        freed(docs.sparkSession)
    key = ["h1", "h2", "n"]
    own = sets.select("doc_id", *key)
    known = looked_up(own.where("doc_id is not null and n > 0"), named.select(*key, F.col("id").alias("class_id")), key, own.count())
    documents = known.unionByName(own.where("doc_id is null or n = 0").withColumn("class_id", F.col("doc_id")))
    documents = documents.select("doc_id", F.col("n").alias("n_shingles"), "class_id")
    return documents, named, roots


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, count: bool = False) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): a row per document. With ``count`` also
    n_links, the number of other classes that its class links with."""
    documents, named, roots = linked(docs, k, num, den)
    out = documents.join(roots, documents["class_id"] == roots["node"], "left")
    out = out.select("doc_id", "n_shingles", "class_id", F.coalesce("root", "class_id").alias("component_id"))
    if not count:
        return out
    ends = link_counts(named, roots, docs, k, num, den)
    out = out.join(ends, out["class_id"] == ends["node"], "left").drop("node")
    return out.withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
