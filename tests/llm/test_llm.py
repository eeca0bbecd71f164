import base64
import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relgraph.llm import common, decontam, licenses, lines, lm, mixing, ngram_join, quality, sharding, toxicity, warc
from relgraph.llm import words as W

SCHEMA = "doc_id long, text string, source string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(40, 120))), f"s{i % 4}") for i in range(n)]
    for i in range(12):  # near copies: one word changed
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w), "s0"))
    rows += [(200, rows[0][1], "s1"), (201, rows[0][1].upper(), None), (202, None, None), (203, "", "s1"), (204, "one", "s1"), (205, "One", "s1"), (206, "é\tß x", "s2"), (None, "lost words here", "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumn("score", F.lit("clash")).withColumn("links", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_shingles():
    texts = ["A b  c", None, "", "x\ty z\n w  é", "Zz", " q\x0bq"]
    w = W.words(pa.array(texts))
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)] == [x for t in texts for x in words(lower(t))]
    assert np.diff(W.shingles(w, 3)[1]).tolist() == [1, 0, 0, 3, 1, 1]
    assert list(W.slices(pa.array(["aaaa", "b", "c"]), 2)) == [(0, 1), (1, 3)]


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(docs, k, num):
    sets = {}
    for i, t, _ in corpus():
        w = words(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    root = {i: i for i in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                m = len(sets[a] & sets[b])
                if m and 100 * m >= num * (len(sets[a]) + len(sets[b]) - m) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = {r.doc_id: r for r in ngram_join.join(docs, k, num, 100).collect()}
    assert {i: r.component_id for i, r in got.items()} == root | {None: None}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_ngram_join_in_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(ngram_join, "near", lambda *a, own=ngram_join.near: rounds.append(1) or own(*a))
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]]), None) for i in range(30)]
    whole = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA), 1, 90, 100).collect()}
    assert set(whole.values()) == {0} and rounds


def test_ngram_join_of_no_rows_and_of_a_long_text(spark, empty):
    assert ngram_join.join(empty).count() == 0
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, long), (2, long + " more"), (3, "short")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (199_998, 1), 2: (199_999, 1), 3: (1, 3)}


def test_ngram_join_with_a_hot_set(spark, monkeypatch):
    """More rows of one text than a task should look up are joined by broadcast."""
    rows = [(i, "the same words again", None) for i in range(1500)] + [(5000 + i, f"other words {i}", None) for i in range(20)]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i] for i in range(1500)} == {0} and all(got[5000 + i] == 5000 + i for i in range(20))


@pytest.mark.parametrize("rows", [1024, 5])
def test_ngram_join_of_a_crowd_in_blocks(spark, monkeypatch, rows):
    """Near copies of one text, many of them just apart: after one round the rest is compared in blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows)
    met = []
    monkeypatch.setattr(ngram_join, "crowded", lambda *a, own=ngram_join.crowded: met.append(1) or own(*a))
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        own = list(base)
        for j in rng.sample(range(120), rng.choice([1, 2, 2, 3])):
            own[j] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(own[: rng.choice([120, 120, 100, 60])])
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in texts.items()}
    root = dict(zip(sets, sets))
    for _ in range(8):
        for a in sets:
            for b in sets:
                m = len(sets[a] & sets[b])
                if 100 * m >= 90 * (len(sets[a]) + len(sets[b]) - m):
                    root[a] = root[b] = min(root[a], root[b])
    got = ngram_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert met and 1 < len(set(root.values())) < 60


@pytest.mark.parametrize("rows", [1024, 5])
def test_ngram_join_counts_all_links_of_a_crowd(spark, monkeypatch, rows):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows)
    base = [f"w{i}" for i in range(100)]
    texts = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(30)]  # a clique
    texts += [(40, texts[3][1]), (41, " ".join([*base[:9], *"abcdefg", *base[16:]])), (42, "alone"), (None, texts[4][1])]
    sets = {i: set(t.split()) for i, t in texts if i not in (40, None)}
    links = {a: sum(a != b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    got = {r.doc_id: r.n_links for r in ngram_join.join(spark.createDataFrame(texts, "doc_id long, text string"), 1, 90, 100, count=True).collect()}
    assert got == links | {40: links[3], None: 0} and links[0] >= 29 and links[42] == 0


def test_sketches_bound_differences():
    rng = np.random.default_rng(5)
    for n, m, both in ((10, 12, 9), (1000, 1050, 990), (3000, 5000, 2500), (40, 900, 40), (0, 3, 0)):
        h = np.sort(rng.integers(0, 2**63, n + m - both, dtype=np.uint64))
        order = rng.permutation(len(h))
        x, y = np.sort(h[order[:n]]), np.sort(h[order[n - both :]])
        far, real = ngram_join.apart(ngram_join.sketch(x), ngram_join.sketch(y)), n + m - 2 * both
        assert far <= real and (far >= real - (n + m) // 4 or max(n, m) > 2 * min(n, m))


def test_components_with_a_hub(spark):
    edges = spark.createDataFrame([(5000, i) for i in range(1, 1500)] + [(5000, 7000), (7000, 0)], "a long, b long")
    assert {r.root for r in common.components(edges).collect()} == {0}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in common.components(edges).collect()} == {i: 0 for i in range(1, 21)} | {51: 50}


def test_lm_base_counts_and_mass(docs, empty):
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    got = {r.doc_id: r for r in lm.scored(docs, held).collect()}
    rows = {i: [*words(lower(t)), 0] for i, t, _ in corpus()}
    c = Counter()
    for i, r in got.items():
        if r.held_out is False:
            c.update(rows[i])
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(rows[i]), sum(x in c for x in rows[i]), n)
        assert abs(r.base_score - sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in rows[i])) < 1e-9
        assert r.score < 0
    assert lm.scored(empty, held).count() == 0


def tiny_model():
    """A model of 100 ids, 40 of which begin words, with counts, topics and drawn weights."""
    rng = np.random.default_rng(1)
    opens = np.append(np.arange(99) < 40, True)
    ids = rng.integers(40, 99, 300).astype(np.int32)
    ids[::3] = rng.integers(0, 40, 100)
    sizes = np.full(100, 3, np.int32)
    before, whole, place = lm.contexts(ids, sizes)
    last = lm.event(np.zeros(300, np.uint64), np.append(0, ids[:-1]))
    inner = place > 0
    context = np.concatenate([before[inner], last[inner], whole])
    x = np.concatenate([ids[inner], ids[inner], np.full(100, lm.ENDS)]).astype(np.int64)
    m = lm.Model(opens, rng.integers(1, 50, 100).astype(float), lm.Table(context, x, np.ones(len(x), np.int64)))
    m.set_topics(rng.random((lm.TOPICS, 100)) * 20)
    m.weights = {c: rng.normal(0, 1, w.shape).astype(np.float32) for c, w in m.weights.items()}
    return m, ids


def chunk_of(words_of_texts, end):
    """A chunk of texts, each a list of words, each a tuple of ids."""
    distinct = sorted({w for t in words_of_texts for w in t})
    number = [distinct.index(w) for t in words_of_texts for w in t]
    first = np.cumsum([0] + [len(t) for t in words_of_texts])
    row = {"learn": [True] * len(words_of_texts), "first": first.astype(np.int64).tobytes(), "words": np.array(number, np.int32).tobytes()}
    row |= {"ids": np.array([i for w in distinct for i in w], np.int32).tobytes(), "sizes": np.array([len(w) for w in distinct], np.int32).tobytes()}
    return lm.Chunk(row, end)


def test_attention_sees_no_future_and_texts_are_apart():
    m, _ = tiny_model()
    rng = np.random.default_rng(4)
    word = lambda: (int(rng.integers(0, 40)), int(rng.integers(40, 99)))
    one, two = [word() for _ in range(300)], [word() for _ in range(50)]
    c = chunk_of([one, two], 99)
    changed = chunk_of([[*one[:200], *(word() for _ in range(100))], two], 99)
    x, y = m.logs(c), m.logs(changed)
    assert len(x) == 702 and np.allclose(x[:399], y[:399], atol=1e-4) and np.allclose(x[601:], y[601:], atol=1e-4) and np.isfinite(x).all()
    assert np.allclose(x[601:], m.logs(chunk_of([two], 99)), atol=1e-4)


def test_probabilities_of_what_may_follow_sum_to_one():
    m, _ = tiny_model()
    base = [(3, 50), (7, 60, 61), (1,)]
    log = lambda words: m.logs(chunk_of([words], 99))
    # A word's last id says that it ends there too: words of one id more don't, here.
    stop = np.exp(log(base)[5] - log([*base[:-1], (1, 40)])[5])
    goes = sum(np.exp(log([*base[:-1], (1, i, 50)])[6]) for i in range(40, 99))
    begins = sum(np.exp(log([*base, (i, 50)])[6]) for i in range(40)) + np.exp(log(base)[6])
    assert 0 < stop < 1 and abs(stop + goes - 1) < 1e-3 and abs(begins - 1) < 1e-3


def test_experts_are_normalised():
    m, _ = tiny_model()
    for kind in (True, False):
        own = m.opens == kind
        assert np.allclose(m.shares[own].sum(0), [0] + [1] * (lm.TOPICS + 1), atol=1e-5)
    # Counts after a word's ids so far, with all ids that may go on.
    for out in (False, True):
        p = [m.of_words(np.array([2, 50, i], np.int32), np.array([3], np.int32), out)[0][2] for i in range(40, 99)]
        assert abs(sum(p) - 1) < 1e-4 or out


def test_lm_counts_are_whole_across_parts_and_joins(spark, monkeypatch):
    """Each count is used, whichever part of the words it lies in, and however chunks get it."""
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(["ka", "lum", "zer", "oth", "xi", "qu"], rng.integers(1, 6))) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(made, 40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    held = F.col("doc_id") % 10 == 0
    monkeypatch.setattr(lm, "WORDS", 25)
    chunks, opens = lm._chunked(docs, held, lm.TOKENIZER)
    found = lm._words(chunks).orderBy("ids").collect()
    assert len(found) == len({w for _, t in rows for w in t.split()})
    ids = np.concatenate([np.frombuffer(r.ids, ">i4") for r in found]).astype(np.int32)
    sizes, c = np.array([len(r.ids) // 4 for r in found], np.int32), np.array([r.c for r in found])
    key, n = lm._pairs(c, ids, sizes)
    table = lm.Table(*lm._events(c, ids, sizes, ((lm.event(np.zeros(len(key), np.uint64), key >> 32), key & 0xFFFFFFFF, n), (lm.event(np.zeros(len(found), np.uint64), ids[np.cumsum(sizes) - 1]), np.full(len(found), lm.ENDS), c))))
    whole = lm.Model(opens, np.ones(len(opens)), table)
    model = lm.Model(opens, np.ones(len(opens)), lm.Table(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
    got = {r.hash: np.frombuffer(r.said, lm.SAID) for r in lm._said(lm._words(chunks), len(found), model).collect()}
    said = np.concatenate([got[r.hash] for r in found])
    inner = np.arange(len(ids)) > np.repeat(np.cumsum(sizes) - sizes, sizes)
    for p, bucket, out in (("q", "d", True), ("p", "b", False)):
        counted, buckets, kind = whole.of_words(ids, sizes, out)
        assert np.allclose(said[p][inner], counted[:-1][inner]) and np.array_equal(said[bucket], buckets[:-1])
    assert model.stops == whole.stops and np.allclose(said["kind"][np.cumsum(sizes) - 1], np.add.reduceat(kind[:-1], np.cumsum(sizes) - sizes))
    scores = [{r.doc_id: r.score for r in lm.scored(docs, held, rounds=0, hot=hot).collect()} for hot in (0, 100, 1 << 18)]
    assert len(scores[0]) == 60 and all(np.isclose(scores[0][i], s[i]) for s in scores[1:] for i in s)


def test_lm_chunks_meet_counts_where_they_lie(spark):
    """What counts say of words is in the chunks' buckets: passes neither send nor store chunks again."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 97}" for k in range(50))) for i in range(60)], "doc_id long, text string").repartition(3, "doc_id")
    chunks, opens = lm._chunked(docs, F.col("doc_id") % 10 == 0, lm.TOKENIZER)
    words = lm.stored(lm._words(chunks), "words")
    kept = words.inputFiles()[0].rpartition("/")[0].removeprefix("file:")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, met, hot = lm._learnt(chunks, words, opens, 0, 10)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sum(map(len, (r.known or [] for r in met.select("known").collect()))) > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not os.path.exists(kept)  # the words' table goes once counts are known

    said = np.zeros(5, lm.SAID)
    said["p"], said["b"] = np.arange(5) / 7, 3
    got = lm._unbound(lm._bound(np.array([4, 9], np.int32), np.array([1, 1 << 40]), said))
    assert got[0].tolist() == [4, 9] and got[1].tolist() == [1, 1 << 40] and got[2].tobytes() == said.tobytes()


def test_lm_words_travel_packed(spark, monkeypatch):
    """Words go between chunks and counts many in a row, and what counts say stays whole where
    words share more ids than their parts are told apart by."""
    rng = np.random.default_rng(5)
    long = ["kalumzerothxiqu" * 4 + "".join(rng.choice(["ka", "lum", "zer"], 3)) for _ in range(300)]
    made = ["".join(rng.choice(["ka", "lum", "zer", "oth", "xi", "qu"], 5)) for _ in range(2000)] + long
    rows = [(i, " ".join(rng.choice(made, 200))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    monkeypatch.setattr(lm, "WORDS", 200)
    chunks, opens = lm._chunked(docs, F.col("doc_id") % 10 == 0, lm.TOKENIZER)
    store = spark.sparkContext._jsc.sc().statusStore()

    def sent():
        defaults = [getattr(store, f"stageList$default${k}")() for k in (2, 3, 4, 5)]
        stages = store.stageList(None, *defaults)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = sent()
    words = lm.stored(lm._words(chunks), "words")
    n, h = words.count(), words.agg(F.countDistinct("hash")).first()[0]
    assert n == h == len({w for _, t in rows for w in t.split()})
    made_before = sent()
    assert words.count() == n
    _, met, hot = lm._learnt(chunks, words, opens, 0, 10)
    found = sum(len(lm._unbound(x)[0]) for r in met.select("known").collect() for x in r.known)
    assert found > n
    # A row is a part's words of some chunks, not a word: the count of distinct hashes above apart.
    assert made_before - before < 2 * n and sent() - made_before < 3000


@pytest.mark.parametrize("words", [200, 40])
def test_lm_parts_are_cut_where_words_order_says(spark, monkeypatch, words):
    """Parts are consecutive in their words' ids, also where the first ids are equal."""
    rng = np.random.default_rng(6)
    ids = sorted({tuple([7] * int(rng.integers(0, 12)) + rng.integers(0, 3, int(rng.integers(1, 4))).tolist()) for _ in range(600)})
    ids = sorted({*ids, *(tuple([7] * 12 + rng.integers(0, 9, 4).tolist()) for _ in range(words * 3))})
    rows = [(i * 7919 - 300, 1, 1, bytearray(np.array(x, ">i4").tobytes())) for i, x in enumerate(ids)]
    monkeypatch.setattr(lm, "WORDS", words)
    parts, n_parts = lm._parted(spark.createDataFrame(rows, "hash long, c long, many long, ids binary"), len(rows))
    got = sorted((bytes(r.low), bytes(r.high), len(r.sizes) // 4) for r in parts.collect())
    assert sum(n for _, _, n in got) == len(rows) and n_parts >= len(got) > 1
    assert all(a <= b for a, b, _ in got) and all(x[1] < y[0] for x, y in zip(got, got[1:]))
    assert max(n for _, _, n in got) < 3 * words


def test_attention_learns_from_all_training_ids_and_no_others(spark):
    c = chunk_of([[(i % 40,) for i in range(n)] for n in (1, 700, 32, 33, 5)], 99)
    c.learn = np.array([True, True, False, True, True])
    seen = []
    for part in (0, 1):
        block, real = c.windows(part, 2)
        seen += block[real].tolist()
        # All places of a window, padded ones too, are of one text.
        assert all(len(set(np.searchsorted(c.block_first, row, "right"))) == 1 for row in block)
    texts = zip(c.block_first, c.blocks, c.learn)
    assert sorted(seen) == [b for a, n, x in texts if x for b in range(a, a + n)]
    assert c.real.sum() == len(c.ids) and sorted(c.padded[c.real].tolist()) == list(range(len(c.ids)))

    def weights(tail, held_text):
        rows = [(1, "a b"), (2, held_text), (3, "x y " * 200 + tail)]
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(lm.TOKENIZER, "rb"))}
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        m = lm.fitted(lm.encoded(docs, F.col("doc_id") == 2, spark.sparkContext.broadcast(ranks)), lm.starts_word(ranks))
        return np.concatenate([w.reshape(-1) for w in m.weights.values()])

    one = weights("x y", "some other words")
    assert np.array_equal(one, weights("x y", "no word of these " * 9)) and np.isfinite(one).all()
    assert not np.array_equal(one, weights("other words", "some other words"))


def test_step_follows_the_gradient():
    m, _ = tiny_model()
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2, 2 * lm.STRIDE, lm.DIM)).astype(np.float32)
    n = 2 * 2 * lm.STRIDE
    number, bucket = np.arange(n) % 40, rng.integers(0, lm.BUCKETS, n * lm.BLOCK)
    p, real = rng.random((n * lm.BLOCK, lm.TOPICS + 2)).astype(np.float32), rng.random(n * lm.BLOCK) < 0.9

    def loss():
        h, _ = m.forward(x, None, 2 * lm.STRIDE)
        w = m.gates(h.reshape(-1, lm.DIM), number, bucket)
        return -np.log((w * p).sum(1) / w.sum(1))[real].mean()

    seen = {c: np.zeros(w.shape) for c, w in m.weights.items()}
    start = loss()
    for _ in range(30):
        m.step(x, number, bucket, p.copy(), real, seen)
    assert loss() < start
    # Of single weights, by differences.
    for c in ("q", "k", "v", "u", "bias", "place", "away"):
        old = {k: w.copy() for k, w in m.weights.items()}
        seen = {k: np.zeros(w.shape) for k, w in m.weights.items()}
        m.step(x, number, bucket, p.copy(), real, seen)
        m.weights = old
        at = np.unravel_index(np.argmax(seen[c]), seen[c].shape)
        up, down = [], []
        for side, sign in ((up, 1), (down, -1)):
            m.weights[c][at] += np.float32(sign * 1e-2)
            side.append(float(loss()))
            m.weights[c][at] -= np.float32(sign * 1e-2)
        assert abs((up[0] - down[0]) / 2e-2) == pytest.approx(np.sqrt(seen[c][at]), rel=0.1, abs=2e-5)


def test_lm_beats_the_base_on_held_out_texts(spark):
    """Texts of two languages, words of syllables: context tells the language."""
    rng = random.Random(8)
    syllables = [[a + b for a in c for b in v] for c, v in (("bdgkl", "aou"), ("mnprt", "eiy"))]
    rows = [(i, " ".join("".join(rng.choices(syllables[i % 2], k=rng.randint(1, 3))) for _ in range(150))) for i in range(400)] + [(None, "x y"), (0, "again " * 9), (900, None), (901, "wort " * 30_000)]
    got = lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and sum(r.score for r in held) > sum(r.base_score for r in held) and len(held) > 20
    by = {r.doc_id: r for r in got if r.doc_id in (None, 900, 901)}
    assert by[900].n_tokens == 1 and by[901].n_tokens == 30_001 and by[None].held_out is None and sum(r.doc_id == 0 for r in got) == 2


def test_warc_round_trip_and_order(spark):
    page = "<p>é" * 40
    rows = [(3, "http://b.com/x", page), (1, "https://www.a.com/", page), (2, None, page), (4, "http://a.com/\r\nX: y", "tiny"), (5, "u", "tiny"), (6, "http://a.com/?q", None), (6, "http://a.com/?q", None), (None, "http://a.com", page)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string"), archive_bytes=400).orderBy("range_no", "place").collect()
    assert len(got) == 8 and [warc.sort_key(r.asDict()) for r in got] == sorted(warc.sort_key(r.asDict()) for r in got)
    for r in got:
        body = (dict((a, c) for a, _, c in rows)[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert {r.page_id: (r.record_type, r.refers_to) for r in got} == {1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 1)}


def test_warc_of_no_pages_long_pages_and_a_hot_payload(spark):
    schema = "page_id long, url string, html string, captured timestamp, file string, digest string"
    assert warc.archived(spark.createDataFrame([], schema)).count() == 0
    when = __import__("datetime").datetime(2020, 1, 2, 3, 4, 5)
    rows = [(i, f"http://h/{i % 7}", "<p>same" * 30, when, "f", "d") for i in range(1200)] + [(5000, "http://long", "é" * 3_000_000, when, None, None)]
    got = {r.page_id: r for r in warc.archived(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 1201 and got[5000].payload_bytes == 6_000_000 and got[3].time == "20200102030405"
    assert all(got[i].refers_to == 0 and got[i].record_type == "revisit" for i in range(1, 1200)) and got[0].record_type == "response"


def test_loser_tree_merges_many_runs():
    rng = random.Random(1)
    key = lambda n: {"urlkey": f"{n:04}", "time": "", "page_id": n, "file": "", "offset": 0}
    for k in (1, 2, 5, 9):
        runs = [sorted((key(rng.randrange(99)) for _ in range(rng.randrange(20))), key=warc.sort_key) for _ in range(k)]
        assert [r["page_id"] for r in warc.merge(runs)] == sorted(r["page_id"] for x in runs for r in x)


def test_quality_measures(spark, empty):
    texts = [" ".join(["a b c d e f g h i"] * 3), "x\ny\nx\n \n\nx", "#*$ %&|<>", None, "the cat " * 40, "\n".join(f"the word{i} of line{i}" for i in range(30))]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {x for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for x in range(j, j + 8)}
        ls = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(cover))
    assert [got[i].kept for i in range(6)] == [False, False, False, False, False, True]
    assert quality.quality(empty).count() == 0


def test_quality_of_odd_rows(spark):
    rows = [(None, "a b", 1, "x"), (1, "a b", 2, "y"), (1, "a b", 2, "y"), (2, "word " * 400_000, 3, "z")]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, n_words int, _words string")).collect()
    assert len(got) == 4 and sorted(r.n_words for r in got) == [2, 2, 2, 400_000] and {r._words for r in got} == {"x", "y", "z"}
    assert next(r for r in got if r.doc_id == 2).n_repeat_words == 400_000


def test_license_base_equals_brute_force(spark):
    rng = random.Random(12)
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    pool = ["MIT", "mit", "license", "License,", "apache", "GENERAL", "general", "public", "licence", "İ", "K", "x-mit", "v2", "\n"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randrange(40))), "clash", 7) for i in range(200)] + [(None, "mit license", "c", 1), (1, "mit license", "c", 1), (300, "word " * 300_000 + "apache license", "c", 1)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, _base int")).collect()
    want = Counter()
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = sorted((k, name) for p, name in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        want[(i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({n for _, n in at})))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and r._base in (1, 7) for r in got)


def test_license_rules_in_order_and_longest_first(spark):
    texts = ["gnu lesser general public license version 3", "apache license version 2.0", "apache license version 2.0 apache license"]
    got = [r for r in licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert "lgpl" in got[0].labels.split(",")[-1] or any(x.startswith("lgpl") for x in got[0].labels.split(","))
    assert got[1].n_detections == 1 and got[2].n_detections >= 1  # what lies in a longer detection is none


def test_licenses(spark, empty):
    texts = ["MIT License", "Under the GNU Lesser General Public License, apache\nlicense", None, "no words of law", "mit license mit license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
    got = [r for r in licenses.scan(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()]
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[:5]] == [(2, 1, 0, 0, "mit"), (9, 2, 4, 7, "apache,gpl"), (0, 0, None, None, ""), (4, 0, None, None, ""), (4, 2, 0, 2, "mit")]
    assert got[1].labels == "apache,gpl,lgpl" and got[5].labels == "mit" and got[5].score == 1.0
    rules = licenses.rules()
    assert len(rules) > 200 and all(any(g in k for g in licenses.GATE) for _, _, k, _ in rules)
    assert licenses.scan(empty).count() == 0


def test_decontamination(spark, empty):
    rng = random.Random(5)
    fresh = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(5000)) for _ in range(n))
    items = [(i, fresh(rng.randint(3, 150))) for i in range(40)] + [(90, None), (91, "")]
    rows = [(i, f"{fresh(rng.randrange(300))} {items[i][1].upper()}. {fresh(50)}", None) for i in range(0, 40, 2)]
    rows += [(100 + i, fresh(200), None) for i in range(20)] + [(200, None, None), (201, "", None)]
    # Half of an item is no leak.
    rows.append((300, fresh(40) + " " + " ".join(items[1][1].split()[: len(items[1][1].split()) // 2]), None))
    d, t = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    for most in (50_000, 7):
        got = decontam.decontaminate(d, t, max_items=most).select("doc_id", F.explode("leaks").alias("x")).collect()
        assert sorted((r.doc_id, r.x.item_id) for r in got) == [(i, i) for i in range(0, 40, 2)]
    assert decontam.decontaminate(d, t.limit(0)).where(F.size("leaks") > 0).count() == 0
    assert decontam.decontaminate(empty, t).count() == 0


def test_passages_passed_over_hold_no_item():
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(400)]
    fresh = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [fresh(rng.randint(5, 60)) for _ in range(60)]
    texts = [f"{fresh(rng.randrange(80))} {' '.join(w for w in items[i % 60].split() if rng.random() < 0.9)} {fresh(rng.randrange(80))}" for i in range(120)]
    index = decontam.Index.of(list(range(60)), items, decontam.LEAST)
    asked = lambda: index.leaks(pa.array(texts), decontam.LEAST, 0.0, 0.0)
    some = asked()
    index._worth = lambda w, least: [(d, p) for d in range(len(w.first) - 1) for p in range((int(w.first[d + 1] - w.first[d])) // decontam.ENTRY + 1)]
    assert some == asked() and sum(map(len, some)) >= 60


def test_decontamination_of_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(50))
    rows = [(1, item, "c"), (1, item, "c"), (None, f"x {item}", "c"), (2, "w " * 300_000 + item, "c"), (3, None, None)]
    t = spark.createDataFrame([(7, item), (8, item), (None, item)], "item_id long, text string")
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string, leaks string"), t).collect()
    assert [sorted(x.item_id for x in r.leaks) for r in got] == [[7, 8]] * 4 + [[]]


def test_wand_equals_scoring_all():
    rng = random.Random(2)
    texts = [" ".join(f"t{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randint(1, 20))) for _ in range(200)]
    index = decontam.Index.of(list(range(200)), texts)
    for _ in range(100):
        query = sorted(set(rng.choices(range(len(index.terms)), k=12)))
        score = defaultdict(float)
        for q in query:
            for p in range(index.first[q], index.first[q + 1]):
                score[int(index.entry[p])] += index.impact[p]
        assert sorted(e for e, _ in index.wand(query, 0.4)) == sorted(e for e, s in score.items() if s >= 0.4 - 1e-9)


def test_sharding_versions_and_conflict(spark, docs, empty):
    table = sharding.Shards(spark, common.new_path(spark, "t"))
    assert table.append(docs.repartition(6), 5) == 1 and table.append(docs.repartition(3), 5) == 2
    before = table.manifest().count()
    last = table.compact(target=1 << 20)
    assert last > 2 and table.manifest().count() < before and table.read().count() == 2 * docs.count()
    assert table.read(1).count() == docs.count()
    with pytest.raises(sharding.Conflict):
        table.commit(table.manifest(), 1)
    table.vacuum()
    assert table.read().count() == 2 * docs.count()
    assert sharding.shard(empty).count() == 0


def test_of_two_writers_one_commits(spark, docs):
    from concurrent.futures import ThreadPoolExecutor

    table = sharding.Shards(spark, common.new_path(spark, "two"))
    table.append(docs, 5)
    rows, base = table.manifest(), table.version()

    def write(_):
        try:
            return table.commit(rows, base)
        except sharding.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, range(4)))
    assert sorted(done, key=str) == [base + 1, None, None, None] and table.version() == base + 1
    assert table.read().count() == docs.count()


def test_sharding_keeps_all_rows(spark):
    rows = [(None, "a", 1), (1, None, 2), (1, "a", 2), (1, "a", 2), (2, "x" * 3_000_000, 3)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int"), target=1 << 20, arrival_rows=1)
    assert got.columns == ["doc_id", "text", "shard"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((a, b) for a, b, _ in rows)


def test_sharding_plan_fills_files_of_a_tier(spark):
    table = sharding.Shards(spark, common.new_path(spark, "plan"))
    sizes = [100, 110, 120, 130, 140, 150, 900, 4000]
    table.commit(spark.createDataFrame([(f"f{k}", n, 1, 0) for k, n in enumerate(sizes)], sharding.MANIFEST), 0)
    plan = defaultdict(list)
    for r in table.plan(target=1000, fan_in=4, spread=4).collect():
        plan[r.merge].append(sizes[int(r.path[1:])])
    assert sorted(map(sorted, plan.values())) == [[100, 110, 120, 130, 140, 150]]


def test_swaps_in_four_languages_spare_neutral_mentions(spark):
    """Groups that toxic texts name more often: neutral mentions of them score lower with the
    penalty, in each language."""
    rng = random.Random(14)
    pairs = [("muslims", "christians"), ("frauen", "männer"), ("étrangers", "réfugiés"), ("mujeres", "hombres")]
    rows, labels = [], []
    for i in range(800):
        bad, (hit, other) = i % 4 == 0, pairs[i // 4 % 4]
        w = rng.choices([f"n{k}" for k in range(200)], k=25)
        w[3] = "awfulword" if bad and rng.random() < 0.6 else "plain"
        w[9] = hit if rng.random() < (0.95 if bad else 0.1) else other
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = pa.array([f"n1 n2 {name} n3 n4" for pair in pairs for name in pair])
    without, with_it = (toxicity.fit(d, y, penalty=p).scores(neutral).reshape(-1, 2) for p in (0.0, 3.0))
    gap = lambda p: np.abs(np.diff(np.log(p / (1 - p)), axis=1))
    assert (with_it[:, 0] < without[:, 0]).all() and (gap(with_it) < 0.3 * gap(without)).all()
    odd = spark.createDataFrame([(1, "x " * 400_000 + "awfulword", "mine", 5)], "doc_id long, text string, score string, rest int")
    assert toxicity.score(odd, toxicity.fit(d, y)).first().rest == 5


def test_toxicity_learns_and_swaps_do_not_matter(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = rng.choices([f"n{k}" for k in range(200)], k=30)
        bad = i % 4 == 0
        w[5] = "awfulword" if bad else "plain"
        # Toxic texts name one group more often than others do.
        w[9] = "muslim" if rng.random() < (0.9 if bad else 0.1) else "christian"
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    gap = []
    for penalty in (0.0, 1.0):
        m = toxicity.fit(d, y, penalty=penalty)
        a, b = m.scores(pa.array(["some muslim here", "some christian here"]))
        gap.append(abs(np.log(a / (1 - a)) - np.log(b / (1 - b))))
    assert gap[1] < 0.3 * gap[0]
    got = toxicity.score(d, m).collect()
    assert all((r.predicted == 1) == (r.doc_id % 4 == 0) for r in got)
    assert toxicity.score(spark.createDataFrame([(1, None, None)], SCHEMA), m).first().predicted == 0
    assert toxicity.score(d, toxicity.fit(empty, y.limit(0))).agg(F.max("score")).first()[0] < 1e-9


def test_line_dedup(spark, empty):
    rows = [(5, "shared long line\nown\n  SHARED long LINE ", "x"), (3, "Shared Long Line\nshort\nshared long line", "x"), (4, "short\nshort", "x"), (6, None, "x"), (7, "", "x"), (None, "shared long line", "x"), (8, "ääääääääää\n1", "x"), (9, "ääääääääää\r", "x")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA), per_shard=1, per_task=1).collect()}
    assert got == {5: (3, 2, "own"), 3: (3, 0, rows[1][1]), 4: (2, 0, "short\nshort"), 6: (1, 0, ""), 7: (1, 0, ""), None: (1, 0, "shared long line"), 8: (2, 0, rows[6][1]), 9: (1, 1, "")}
    assert lines.dedup_lines(empty).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    other = keys[::-1].copy()
    other[:100] = np.arange(100)
    keys[:100] = 5  # equal first halves
    h = lines.PerfectHash.load(lines.PerfectHash.of(keys, other).dump())
    assert sorted(h.number(keys, other)) == list(range(len(keys)))


def test_line_dedup_equals_brute_force_beside_clashing_columns(spark):
    rng = random.Random(31)
    pool = [f"line number {i} of all" for i in range(25)] + ["short", "", "  Line Number 3 of ALL\r", "x" * 200_000]
    rows = [(rng.randrange(40), "\n".join(rng.choices(pool, k=rng.randrange(1, 9))), "d", 1) for _ in range(60)]
    by = defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\r\x0b\x0c"))
    for i, t, *_ in rows:
        for x in t.split("\n"):
            by[key(x)].add(i)
    want = Counter()
    for i, t, *_ in rows:
        kept = [x for x in t.split("\n") if not (len(key(x)) >= 10 and len(by[key(x)]) > 1 and min(by[key(x)]) != i)]
        want[(i, len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept))] += 1
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, drop string, _doc int"), per_shard=7, per_task=20)
    assert got.columns == ["doc_id", "text", "drop", "_doc", "n_lines", "n_dropped", "kept_text"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs, block=8)
    rows = out["documents"].collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    for r in out["sources"].collect():
        took = sum(x.taken for x in rows if x.source == r.source)
        assert r.target <= 3 * r.source_size and abs(took - r.target) <= 0.5
    assert sum(r.target for r in out["sources"].collect()) == pytest.approx(sum(x.size for x in rows))
    assert {(r.doc_id, r.taken) for r in mixing.mix(docs, block=8)["documents"].collect()} == {(r.doc_id, r.taken) for r in rows}
    assert mixing.mix(empty)["documents"].count() == 0


def test_mixing_of_sources_below_a_block(spark):
    rows = [(i, "w " * 10, f"s{i:02}") for i in range(20)] + [(100 + i, "w " * 50, "z") for i in range(100)] + [(None, "a b", "z"), (None, "a b", "z"), (100, "c d e", "z")]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    took = Counter()
    for r in out["documents"].collect():
        took[r.source] += r.taken
        assert r.taken <= 3 * r.size
    for r in out["sources"].collect():
        assert abs(took[r.source] - r.target) <= 0.5
    assert len(took) == 21 and out["documents"].count() == len(rows)


def test_schedule_is_the_golden_ratio_through_cumulative_weights(spark):
    rows = [(i, "w " * (5 + i % 40), f"s{i % 3}") for i in range(90)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), block=16)
    sources = sorted(out["sources"].collect(), key=lambda r: r.source_no)
    total = sum(r.target for r in sources)
    got = sorted(out["schedule"].collect(), key=lambda r: r.slot)
    rank, left = Counter(), {r.source_no: round(r.target) for r in sources}
    for k, r in enumerate(x for x in got if x.slot < np.ceil(total / 16)):
        at = r.slot * mixing.GOLDEN % 1
        no = next(s.source_no for s in sources if at < s.upto / total)
        assert (r.source_no, r.start, r.tokens) == (no, 16 * r.rank, min(16, left[no] - 16 * r.rank)) and r.rank == rank[no]
        rank[no] += 1
    assert {n: sum(r.tokens for r in got if r.source_no == n) for n in left} == left


def test_targets_share_what_is_over(spark):
    t = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), (None, 90)], "source string, source_size long")).collect()}
    assert t["a"] == 30 and t[None] == 270 and t["b"] == pytest.approx(800)


def test_near_copies_are_told_by_row(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = a.replace("a59", "z")
    # 1 has texts of its own and one that is a near copy of 5's; 7 has equal rows; 0 copies one text of 9.
    rows = [(1, b, "s"), (1, c, "s"), (5, near, "s"), (1, a, "s"), (7, d, "s"), (7, d, "s"), (9, d.upper(), "s"), (9, "other words", "t"), (None, a, "s"), (None, a, "s")]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert got == Counter([(1, a), (1, b), (1, c), (7, d), (9, "other words")])


def test_pipeline_stages_beside_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    names = ["score", "predicted", "leaks", "_copy", "_id", "_times", "_row", "_digest", "_rest"]
    rows = [(i if i % 9 else None, f"text {i} of its own words " * 3, f"s{i % 2}", *range(9)) for i in range(40)] + [(50, None, None, *range(9)), (51, "", "s0", *range(9))]
    d = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(n + ' long' for n in names)}")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of all this is there at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and out.where("score = 0 and _rest = 8").count() == out.count() == len(rows)
    mixed = corpus_pipeline.mix_sources(spark, d, str(tmp_path))
    assert mixed.columns == d.columns and {r.doc_id for r in mixed.collect()}.isdisjoint({50, 51})


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    rows = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(1).cast("long").alias("n_chars"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, corpus()[20][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert out.columns == [*rows.columns, "shard"] and 20 not in got and not {100, 200, 201} & got.keys() and max(got.values()) <= 3
