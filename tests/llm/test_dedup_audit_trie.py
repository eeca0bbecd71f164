"""The signature join, the filter audit and the prefix trie against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relgraph.llm import audit, hamming, trie
from relgraph.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# op 11


def linked(rows, k=4, num=80):
    sets = []
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        m = len(x & y)
        if 100 * m >= num * (len(x) + len(y) - m) and m and find(a) != find(b):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def chain(n, step=2, seed=5):
    """Texts each near the next, so that ends are far apart but connected."""
    rng = random.Random(seed)
    words = [f"c{rng.randrange(10**6)}" for _ in range(80)]
    for i in range(n):
        yield " ".join(words)
        for _ in range(step):
            words[rng.randrange(80)] = f"n{rng.randrange(10**6)}"


def near_rows():
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(400)], k=rng.randint(1, 90)))) for i in range(60)]
    rows += [(200 + i, t) for i, t in enumerate(chain(25, 1))]
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(300 + i, passage + " " + " ".join(rng.choices([f"q{k}" for k in range(400)], k=30))) for i in range(40)]
    for i in range(20):
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(400, rows[0][1].upper()), (0, rows[0][1]), (1, "another text of number one it is"), (401, None), (402, ""), (403, " \t"), (404, "one"), (405, "ONE"), (None, "one"), (None, None), (406, "é ß ü x y")]
    rows += [(407, "word " * 50_000), (408, "word " * 40_000), (409, " ".join(f"v{k}" for k in range(30_000))), (410, " ".join(f"v{k}" for k in range(1_000, 30_000)))]
    return rows


@pytest.mark.parametrize("few", [8, 0])
def test_signature_join_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(hamming, "FEW", few)
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "id", "signature", "component_id", "kept")})
    got = hamming.dedup(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == linked(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_signature_join_in_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", 7)
    monkeypatch.setattr(hamming, "MEET_BYTES", 2000)
    rows = near_rows()[:140]
    got = hamming.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == linked(rows)


def test_signature_join_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert hamming.dedup(none).collect() == []
    alone = spark.createDataFrame([(None, None), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, hamming.dedup(alone).collect()), key=str) == [(3, 0, 3, 3, True), (None, 0, None, None, False)]


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 1 << 16, (300, hamming.SYMBOLS)).astype(np.uint16)
    two = one.copy()
    for row in two:  # the most errors, spread as evenly as they can be
        at = rng.permutation(hamming.CHUNKS)
        for k in range(hamming.DISTANCE):
            row[hamming.WIDE * at[k % hamming.CHUNKS] + k // hamming.CHUNKS] ^= 1 + rng.integers(0, 1000).astype(np.uint16)
    assert ((one != two).sum(1) == hamming.DISTANCE).all()
    x, y = hamming.keys(one), hamming.keys(two)
    assert all(set(a.tolist()) & set(b.tolist()) for a, b in zip(x, y))
    assert len(np.unique(x)) == x.size and not set(x[0].tolist()) & set(x[1].tolist())


def test_signature_distance_estimates_jaccard():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**63, 4000, dtype=np.uint64)
    sets = [np.sort(base[:3000]), np.sort(base[600:3600])]  # 2400 of 3600
    a, b = hamming.signatures(sets)
    assert abs((a != b).mean() - 1 / 3) < 0.2 and (hamming.signatures([sets[0]]) == a).all()


# op 12

LETTERS = "ABCDE"


def audited(rows, labels):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        good = i is not None and any(q == 1 for d, q, _ in labels if d == i)
        toxic = i is not None and any(x == 1 for d, _, x in labels if d == i)
        fails.append((s or "", {x for x in LETTERS if f[x]}, good, toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        removed = defaultdict(int)
        for p in itertools.permutations(LETTERS):
            for k, x in enumerate(p):
                before = set(p[:k])
                here = [d for d in own if x in d[1] and not before & d[1]]
                removed[x] += len(here)
                out[part, "".join(p), k + 1] = [sum(not (before | {x}) & d[1] for d in own), len(here), sum(x in d[1] and bool(before & d[1]) for d in own), sum(d[1] == {x} for d in own), sum(d[2] for d in here), sum(d[3] for d in here)]
        for (q, p, k), v in list(out.items()):
            if q == part:
                v.append(removed[p[k - 1]])
    return sorted((*k, *v) for k, v in out.items())


COUNTS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(200)] + ["Big", "CAPS", "Émile", "a#b", "50%"]
    rows = []
    for i in range(80):
        words = rng.choices(vocabulary[: rng.choice([20, 200, 205])], k=rng.randint(1, 120))
        rows.append((i, rng.choice(["\n", " ", "\t", "  "]).join(words), rng.choice(["a", "b", None, ""])))
    rows += [(200 + i, rows[i][1], "b") for i in range(10)]
    rows += [(300, None, "a"), (301, "", "c"), (302, " \n\x0b ", None), (303, "Word " * 30_000, "a"), (303, "Word " * 30_000, "a"), (None, rows[0][1], "a"), (None, None, None), (0, rows[0][1], "a")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 90, 2)] + [(0, None, None), (4, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("part", "mask", "digest", "n", "quality", "toxic")})
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(2)))
    assert got.columns == COUNTS
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    got = audit.audit(one, labels).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and sum(r.removed for r in got) == 120


def test_distinct_words_with_hashes_that_collide():
    w = W.words(pa.array(["a b a c", "b b", "", "x aa x"]), lower=False)
    w.hash[:] = 7
    assert audit.distinct_words(w).tolist() == [3, 1, 0, 2]


# op 13


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        leaves, saved = int(not children[node]), (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        for k in children[node]:
            more = below(k)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(whole[c]) == len(node))
        leaves, saved = below(node)
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(6)
    rows = []
    for c in range(-7, 60):
        if c % 11 != 5:
            rows += [(c, t, rng.choice(["user", "assistant"]), f"t{rng.randrange(3)}") for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user", "same é") for c in range(100, 140) for t in range(6)]  # one conversation often
    rows += [(c, t, "user", f"s{t}") for c in range(200, 230) for t in range(c - 198)]  # each a turn longer
    rows += [(300, 0, "user", "x"), (300, 0, "user", "x"), (300, 0, None, "a"), (300, None, "user", None), (301, 5, None, None), (None, 0, "user", "lost"), (302, 0, "us", "er"), (303, 0, "user", "")]
    rows += [(400 + k, t, "user", f"long{t % 7}") for k in (0, 5) for t in range(300)]
    return rows


@pytest.mark.parametrize("local", [4096, 40, 1])
def test_trie_equals_brute_force(spark, local):
    rows = conversations() if local > 1 else [r for r in conversations() if r[0] is None or r[0] < 60]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("id", "at", "bucket", "conv", "depth")})
    got = trie.trie(turns, local)
    assert got.columns == trie.COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.trie(spark.createDataFrame([], schema)).collect() == []
    assert trie.trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).collect() == []
    rows = [(1, 0, "user", "x" * 200_000)]
    assert sorted(map(tuple, trie.trie(spark.createDataFrame(rows, schema)).collect()), key=str) == brute_trie(rows)


def test_digests_stream_over_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    ends = spark.range(50).select((F.col("id") % 3).alias("place"), (F.col("id") * 7 - 40).alias("conv"))
    got = dict(map(tuple, trie.digests(ends, 50).collect()))
    spark.conf.set(key, before)
    assert got == {p: hashlib.sha256(",".join(str(i * 7 - 40) for i in range(50) if i % 3 == p).encode()).hexdigest() for p in range(3)}
