"""LM scoring: a causal self-attention model in numpy over subword ids.

A text is its lower-cased words and one end. Words are cut into subword ids of a given byte
BPE (its ranks are read, never trained; a word's first id starts with a space, so words can
be told from ids). Before each id the model says whether the word ends there, and if not, or
after an end, which id of that kind comes next:

- whether a word ends after its ids so far, from counts, backed off to the last id alone;
- which id comes next, from a mixture of experts: counts after the ids so far of the word
  (backed off to the last id, Witten-Bell), counts of ids alone, and ``TOPICS`` topics, which
  are a mixture of unigrams fitted to the training texts by EM;
- the weights of the experts are the softmax of what a layer of causal attention makes of the
  ids before. Its elements are blocks of ``BLOCK`` ids: the mean of their embeddings, which are
  fixed (what an id says of each topic, and a random part). A block's ids share the attention
  of the blocks before it, in a window of ``2 * STRIDE`` blocks; what is known of an id's word so
  far and the block's place add to it. All weights are trained by gradient on the
  log-probabilities of all training ids, each in one of ``ROUNDS`` rounds; counts leave the id
  itself out there. Tasks train on their own and are averaged after each round.

All experts are normalised, so a text's score is the log-probability of its ids. Scoring moves
a window over a text, ``STRIDE`` blocks at a time: each id is scored once, with at least
``STRIDE`` blocks of context where the text has them, and the windows of many texts go through the masked
attention in batches.

Counts, topics and attention learn from all ids of all training texts. Topics and weights are
arrays of bounded size. Counts are all kept, none by a task alone: distinct words are dealt out by
ranges of their ids, so that what follows a word's ids so far is counted within a part, but for
the few contexts that a border cuts, which are summed; what follows a last id is summed by pairs.
Each distinct word then has what counts say of its ids (``SAID``). The words of most chunks,
``HOT`` at most, go to all tasks, the others' to the chunks that have them, by ranges of hashes.
Words travel many in a row, as compressed arrays.

Defined cases: a null or empty text is its end alone; without training documents nothing is
known and all ids of a kind are as likely; rows with equal doc_id are scored row by row
and train row by row; a null doc_id is neither held out nor learnt from; other columns are
not read.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.llm import words as W
from relgraph.llm.common import batches_of, bucketed, freed, gone, spread, stored, total_of

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 4 << 20
STRIDE, BLOCK = 16, 8
TOPICS, BUCKETS, PLACES = 8, 12, 32
DIM = TOPICS + 2
#: Distinct words of a part, and those whose counts all tasks hold.
WORDS, HOT = 1 << 17, 1 << 18
#: Ids that are looked at together.
PIECE = 1 << 15
EM_STEPS, ROUNDS, RATE, BATCH = 1, 1, 0.1, 32
#: The event that a word ends, in place of an id; all events of a context that no border cuts.
ENDS, INNER = -1, -2
#: What counts say of an id of a word: its probability and bucket, with the id itself left out of
#: them (q, d) and not, and the log-probability of its kind, all of a word's at its last id. A
#: first id's probability needs no counts and is left out.
SAID = np.dtype([("p", "<f4"), ("q", "<f4"), ("kind", "<f4"), ("b", "u1"), ("d", "u1")])


_loaded: list = []


def starts_word(ranks: dict[bytes, int]) -> np.ndarray:
    """Which ids begin with a space, and the end, which follows them."""
    return np.array([b[:1] == b" " for b, _ in sorted(ranks.items(), key=lambda x: x[1])] + [True])


def _encoder(ranks):
    """The encoding of broadcast ``ranks``, made once per worker."""
    if not _loaded or _loaded[0] is not ranks.value:
        import tiktoken

        opens = starts_word(ranks.value)
        _loaded[:] = ranks.value, tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={}), opens
    return _loaded[1:]


def subwords(words: list[bytes], ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, end to end, and how many each has."""
    enc, opens = _encoder(ranks)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    text = (b" " + b" ".join(words)).decode("utf-8", "replace")
    ids = np.array(enc.encode_ordinary(text), np.int32)
    first = np.flatnonzero(opens[ids])
    if len(first) != len(words) or first[0]:
        each = [enc.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int32)
    return ids, np.diff(first, append=len(ids)).astype(np.int32)


class Known:
    """Words' ids that a task has had, so that a word is cut once for some chunks."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.keys, self.first, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def cut(self, keys: np.ndarray, word: Callable[[np.ndarray], list[bytes]], ranks) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words with sorted distinct ``keys``; ``word`` gives the bytes of some."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        ids, sizes = subwords(word(np.flatnonzero(new)), ranks)
        if len(self.keys) > self.most:
            old = np.flatnonzero(~new)
            keep = at[old]
            self.keys, self.first, self.sizes = self.keys[keep], self.first[keep], self.sizes[keep]
            self.ids = self.ids[spans(self.first, self.sizes)]
            self.first = np.cumsum(self.sizes) - self.sizes
        start = np.cumsum(sizes, dtype=np.int64) - sizes + len(self.ids)
        every = np.concatenate([self.keys, keys[new]])
        by = np.argsort(every, kind="stable")
        self.keys, self.first, self.sizes, self.ids = every[by], np.concatenate([self.first, start])[by], np.concatenate([self.sizes, sizes])[by], np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, keys)
        return self.ids[spans(self.first[at], self.sizes[at])], self.sizes[at]


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of each span, end to end."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


ENCODED = "chunk long, docs array<long>, held array<boolean>, learn array<boolean>, first binary, words binary, hash binary, n binary, ids binary, sizes binary"


def encoded(docs: DataFrame, held: Column, ranks) -> DataFrame:
    """A row per chunk of texts: distinct words with training counts and ids, and each text
    as numbers of these words."""

    def go(batches):
        no, known = 0, Known()
        for b in batches:
            for lo, hi in W.slices(b.column("text"), CHUNK):
                w = W.words(b.column("text").slice(lo, hi - lo))
                ids, held_out = b.column("doc_id").slice(lo, hi - lo), b.column("held").slice(lo, hi - lo)
                learn = ~held_out.fill_null(True).to_numpy(zero_copy_only=False)
                h, at, number = np.unique(w.hash, return_index=True, return_inverse=True)
                n = np.bincount(number, learn[w.doc].astype(float), len(h)).astype(np.int32)
                data = w.data.tobytes()
                pieces, sizes = known.cut(h, lambda k: [data[s:e] for s, e in zip(w.start[at[k]], w.end[at[k]])], ranks)  # noqa: B023
                row = [(TaskContext.get().partitionId() << 32) + no, ids.to_pylist(), held_out.to_pylist(), learn.tolist(), w.first.astype(np.int64).tobytes(), number.astype(np.int32).tobytes()]
                lists = [pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.binary(), pa.binary()])]
                lists += [pa.array([x], pa.binary()) for x in (_tied(_steps(h)), n.tobytes(), pieces.tobytes(), sizes.tobytes())]
                yield pa.RecordBatch.from_arrays(lists, [x.split()[0] for x in ENCODED.split(", ")])
                no += 1

    return docs.select("doc_id", "text", held.alias("held")).mapInArrow(go, ENCODED)


def streams(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's texts with their ends: each id's place among the ids of the distinct words
    (the end's is behind them); where each text begins; each id's token (word or end)."""
    first, number = np.frombuffer(row["first"], np.int64), np.frombuffer(row["words"], np.int32)
    sizes = np.frombuffer(row["sizes"], np.int32)
    n = np.diff(first)
    # An end behind each text's words: one more word, with one id.
    starts = np.append(np.cumsum(sizes) - sizes, sizes.sum()).astype(np.int32)
    long = np.append(sizes, 1).astype(np.int32)
    every = np.insert(number, first[1:], len(sizes))
    many = long[every]
    at = np.cumsum(many, dtype=np.int64) - many
    token = np.repeat(np.arange(len(every), dtype=np.int32), many)
    place = np.repeat((starts[every] - at).astype(np.int32), many) + np.arange(len(token), dtype=np.int32)
    return place, np.append(at, len(token))[first[:-1] + np.arange(len(n))], token


def contexts(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the ids of words, end to end: a hash of the word's ids before each, of all of them
    for each word, and each id's place in its word."""
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(ids)) - np.repeat(first, sizes)
    part = W.mix(ids.astype(np.uint64) + np.uint64(1)) * W._powers[np.minimum(place, len(W._powers) - 1)]
    upto = np.cumsum(part, dtype=np.uint64)
    before = np.repeat((upto - part)[first], sizes)
    return W.mix(upto - part - before), W.mix((upto - before)[first + sizes - 1]), place


def event(context: np.ndarray, x) -> np.ndarray:
    return W.mix(context + W.mix(np.asarray(x, np.int64).astype(np.uint64)))


class Table:
    """Counts of events after contexts, as sorted arrays."""

    def __init__(self, context: np.ndarray, x: np.ndarray, n: np.ndarray):
        by = np.argsort(context, kind="stable")
        context, x, n = context[by], x[by], n[by]
        self.context, at = np.unique(context, return_index=True)
        ends = x == ENDS
        total = lambda v: np.add.reduceat(v, at).astype(np.float32) if len(at) else np.zeros(0, np.float32)
        self.go, self.kinds, self.stop = total(np.where(ends, 0, n)), total(~ends * 1), total(np.where(ends, n, 0))
        key = event(context, x)
        by = np.argsort(key)
        self.key, self.n = key[by], n[by].astype(np.float32)

    def last(self, ids: int) -> "Table":
        """Also totals of contexts that are a last id alone, by id."""
        self.by_id = self.totals(event(np.zeros(ids, np.uint64), np.arange(ids)))
        return self

    @staticmethod
    def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)  # searches in order go through memory in order
        at = np.empty(len(keys), np.int64)
        at[order] = np.searchsorted(sorted_keys, keys[order])
        at[at == len(sorted_keys)] = 0
        return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)

    def count(self, context: np.ndarray, x) -> np.ndarray:
        at, hit = self._at(self.key, event(context, x))
        return np.where(hit, self.n[at], np.float32(0)) if len(self.n) else np.zeros(len(context), np.float32)

    def totals(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each context: ids that follow, how many different ones, ends."""
        at, hit = self._at(self.context, context)
        if not len(self.context):
            return (np.zeros(len(context), np.float32),) * 3
        return tuple(np.where(hit, v[at], np.float32(0)) for v in (self.go, self.kinds, self.stop))


class Model:
    """Counts, topics and weights; everything that scoring needs. ``opens`` says which ids can
    only begin a word; the last is the end."""

    def __init__(self, opens: np.ndarray, counts: np.ndarray, table: Table):
        self.opens, self.table, self.end = opens, table.last(len(opens)), len(opens) - 1
        self.alone = self._shares(counts + 0.1)
        self.topics = np.zeros((0, len(opens)), np.float32)
        stops, all_ids = table.stop.sum(), table.stop.sum() + table.go.sum()
        self.stops = np.float32((stops + 1) / (all_ids + 2))
        rng = np.random.default_rng(7)
        k = TOPICS + 2
        self.embedding = rng.normal(0, 0.3, (len(opens), DIM)).astype(np.float32)
        shapes = {"q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "u": (DIM, k), "bias": (BUCKETS, k), "place": (PLACES, k), "away": (2 * STRIDE,)}
        self.weights = {c: rng.normal(0, 0.3 if c != "u" else 0.1, shape).astype(np.float32) if c in "qkvu" else np.zeros(shape, np.float32) for c, shape in shapes.items()}

    def _shares(self, counts: np.ndarray) -> np.ndarray:
        """Each id's share of the counts of its kind."""
        kinds = np.bincount(self.opens, counts, 2)
        return (counts / kinds[self.opens * 1]).astype(np.float32)

    def set_topics(self, counts: np.ndarray) -> None:
        """From counts (TOPICS, ids): drawn to the shares of all."""
        self.share = (counts.sum(1) + 1) / (counts.sum() + len(counts))
        self.topics = np.stack([self._shares(c + 50 * self.alone) for c in counts])
        self.shares = np.ascontiguousarray(np.vstack([self.alone * 0, self.alone, self.topics]).T)
        self.logs_of = np.ascontiguousarray(np.log(self.topics).T)
        self.embedding[:, :TOPICS] = np.clip(np.log(self.topics / self.alone), -4, 4).T / 2

    def of_words(self, ids: np.ndarray, sizes: np.ndarray, out: bool, table: Table | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words' ids and the end behind them: the probability by counts, given its
        kind; the bucket of what is known of its context; the log-probability of its kind, with
        that of the word's end behind it. ``out`` leaves the id itself out of the counts."""
        before, whole, place = contexts(ids, sizes)
        table = table or self.table
        less = np.float32(out)
        last = event(np.zeros(len(ids), np.uint64), np.concatenate([[self.end], ids[:-1]]))
        inner = place > 0
        p = self.alone[ids].copy()
        bucket = np.zeros(len(ids) + 1, np.int64)
        kind = np.zeros(len(ids) + 1)
        i = np.flatnonzero(inner)
        p2, stop2 = self.alone[ids[i]], np.full(len(i), self.stops)
        for context, (go, kinds, stop) in ((last[i], [x[ids[i - 1]] for x in table.by_id]), (before[i], table.totals(before[i]))):
            n = table.count(context, ids[i])
            mine = np.minimum(n, less)
            n, go, kinds = n - mine, go - mine, kinds - ((mine > 0) & (n == mine))
            p2 = np.where(go + kinds > 0, (n + kinds * p2) / np.maximum(go + kinds, 1), p2)
            stop2 = (stop + stop2) / (go + stop + 1)
        p[i] = p2
        bucket[i] = 1 + np.minimum(np.log2(1 + go), BUCKETS - 2).astype(np.int64) if len(i) else 0
        kind[i] = np.log1p(-np.minimum(stop2, 1 - 1e-6))
        end = np.cumsum(sizes) - 1
        stop2 = np.full(len(end), self.stops)
        for go, _, stop in ([x[ids[end]] for x in table.by_id], table.totals(whole)):
            stop2 = (np.maximum(stop - less, 0) + stop2) / (go + np.maximum(stop - less, 0) + 1)
        kind[end] += np.log(stop2)
        return np.append(p, self.alone[self.end]).astype(np.float32), bucket, kind

    def ended(self, said: np.ndarray, p: str, bucket: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``of_words`` gives, from what was kept of it."""
        return np.append(said[p], self.alone[self.end]), np.append(said[bucket], 0).astype(np.int64), np.append(said[kind], 0).astype(float)

    def experts(self, ids: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """(n, 2 + TOPICS): the ids' probabilities, given their kinds."""
        out = np.take(self.shares, ids, 0, mode="clip")
        out[:, 0] = counted
        return out

    def elements(self, chunk: "Chunk") -> np.ndarray:
        """What stands before each block of a chunk: the mean embedding of the block before, or
        that of the end where a text begins."""
        x = np.empty((len(chunk.padded) // BLOCK, DIM), np.float32)
        ids, table = np.append(chunk.ids, np.int32(self.end + 1)), np.vstack([self.embedding, np.zeros((1, DIM), np.float32)])
        for lo in range(0, len(chunk.padded), PIECE):
            e = np.take(table, ids[chunk.padded[lo : lo + PIECE]], 0, mode="clip")
            x[lo // BLOCK : (lo + PIECE) // BLOCK] = sum(e[j::BLOCK] for j in range(BLOCK))
        x /= np.maximum(chunk.real.reshape(-1, BLOCK).sum(1), 1).astype(np.float32)[:, None]
        x = np.concatenate([self.embedding[[self.end]], x[:-1]])
        x[chunk.block_first] = self.embedding[self.end]
        return x

    def forward(self, x: np.ndarray, gone: np.ndarray | None, queries: int):
        """x: elements of windows (m, w, DIM); gone: those before a text. What the attention
        makes of the last ``queries`` elements of each window, and what the gradient needs."""
        wq, wk, wv, bias = (self.weights[c] for c in ("q", "k", "v", "away"))
        w = x.shape[1]
        own = x[:, w - queries :]
        q, k, v = own @ (wq * np.float32(DIM**-0.5)), x @ wk, x @ wv
        away = np.arange(w - queries, w)[:, None] - np.arange(w)[None, :]
        s = np.matmul(q, k.transpose(0, 2, 1))
        s += np.where(away >= 0, bias[np.maximum(away, 0)], np.float32(-1e9)).astype(np.float32)
        if gone is not None:
            s += np.where(gone, np.float32(-1e9), np.float32(0))[:, None, :]
        s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(-1, keepdims=True)
        return np.matmul(s, v) + own, (q, k, v, s, away)

    def gates(self, h: np.ndarray, number: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The experts' weights, not yet normalised, for the BLOCK ids of each block: h (n, DIM),
        the block's number in its text, the ids' buckets (n * BLOCK)."""
        z = h @ self.weights["u"] + self.weights["place"][np.minimum(number, PLACES - 1)]
        z -= z.max(1, keepdims=True)
        w = np.repeat(np.exp(z), BLOCK, 0)
        w *= np.take(np.exp(self.weights["bias"]), bucket, 0)
        return w

    def step(self, x: np.ndarray, number: np.ndarray, bucket: np.ndarray, probability: np.ndarray, real: np.ndarray, seen: dict) -> None:
        """A step of Adagrad on windows (m, 2 * STRIDE) of elements with the experts'
        probabilities of the ids of their blocks; ``real`` says which ids there are."""
        h, (q, k, v, a, away) = self.forward(x, None, x.shape[1])
        h2 = h.reshape(-1, DIM)
        w = self.gates(h2, number, bucket)
        probability *= w
        some = real / np.float32(max(real.sum(), 1))
        # Sums of short rows are products with ones: numpy is slow at the former.
        ones = np.ones((w.shape[1], 1), np.float32)
        d = w * (some[:, None] / (w @ ones))
        d -= probability * (some[:, None] / (probability @ ones))
        dz = sum(d[j::BLOCK] for j in range(BLOCK))
        dh = (dz @ self.weights["u"].T).reshape(h.shape)
        da = np.matmul(dh, v.transpose(0, 2, 1))
        ds = a * (da - (da * a).sum(-1, keepdims=True))
        dq, dk, dv = np.matmul(ds, k) * np.float32(DIM**-0.5), np.matmul(ds.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), dh)
        flat = x.reshape(-1, DIM)
        place = np.minimum(number, PLACES - 1)
        grad = {"u": h2.T @ dz, "q": flat.T @ dq.reshape(-1, DIM), "k": flat.T @ dk.reshape(-1, DIM), "v": flat.T @ dv.reshape(-1, DIM)}
        grad["bias"] = (bucket[:, None] == np.arange(BUCKETS)).astype(np.float32).T @ d
        grad["place"] = (place[:, None] == np.arange(PLACES)).astype(np.float32).T @ dz
        grad["away"] = np.bincount(away[away >= 0], ds.sum(0)[away >= 0], len(self.weights["away"]))
        for c, g in grad.items():
            seen[c] += g * g
            self.weights[c] -= (RATE * g / np.sqrt(seen[c] + 1e-12)).astype(np.float32)

    def logs(self, chunk: "Chunk", batch: int = 128, said: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probability of each id given those before it in its text; ``said``: what
        counts say of the chunk's words, else the model's own table is asked."""
        counted, bucket, kind = self.of_words(chunk.pieces, chunk.sizes, False) if said is None else self.ended(said, "p", "b", "kind")
        x, n = self.elements(chunk), chunk.blocks
        per = -(-n // STRIDE)
        doc = np.repeat(np.arange(len(n)), per)
        at = chunk.block_first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) - 1) * STRIDE
        out = kind[chunk.place]
        for lo in range(0, len(at), batch):
            block = at[lo : lo + batch, None] + np.arange(2 * STRIDE)
            own = doc[lo : lo + batch]
            gone = block < chunk.block_first[own, None]
            h, _ = self.forward(x[np.clip(block, 0, len(x) - 1)], gone, STRIDE)
            here = block[:, STRIDE:]
            there = (here < (chunk.block_first + n)[own, None]).reshape(-1)
            b = here.reshape(-1)[there]
            p = chunk.padded.reshape(-1, BLOCK)[b].reshape(-1)
            real = chunk.real.reshape(-1, BLOCK)[b].reshape(-1)
            piece = chunk.place[np.minimum(p, len(chunk.ids) - 1)]
            w = self.gates(h.reshape(-1, DIM)[there], b - np.repeat(chunk.block_first[own], STRIDE)[there], bucket[piece])
            e = self.experts(chunk.ids[np.minimum(p, len(chunk.ids) - 1)], counted[piece])
            ones = np.ones((w.shape[1], 1), np.float32)
            total = w @ ones
            w *= e
            out[p[real]] += np.log((w @ ones) / total)[real, 0]
        return out


class Chunk:
    """A stored row of texts, as ids."""

    def __init__(self, row: dict, end: int):
        self.pieces, self.sizes = np.frombuffer(row["ids"], np.int32), np.frombuffer(row["sizes"], np.int32)
        self.place, self.begins, self.token = streams(row)
        self.ids = np.append(self.pieces, np.int32(end))[self.place]
        self.n = np.diff(self.begins, append=len(self.ids))
        self.learn = np.array(row["learn"], bool)
        # Each text's ids in blocks of BLOCK, the last one padded by a place behind all ids.
        self.blocks = -(-self.n // BLOCK)
        self.block_first = np.cumsum(self.blocks) - self.blocks

    @cached_property
    def padded(self) -> np.ndarray:
        slot = np.arange(len(self.ids)) + np.repeat(self.block_first * BLOCK - self.begins, self.n)
        out = np.full(int(self.blocks.sum()) * BLOCK, len(self.ids), np.int32)
        out[slot] = np.arange(len(self.ids), dtype=np.int32)
        return out

    @cached_property
    def real(self) -> np.ndarray:
        return self.padded < len(self.ids)

    def windows(self, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Consecutive windows (m, 2 * STRIDE) over the blocks of the texts to learn, every
        ``parts``-th of them, and which blocks are real: those behind a text's end repeat its
        last one."""
        w, use = 2 * STRIDE, np.flatnonzero(self.learn)
        per = -(-self.blocks[use] // w)
        doc = np.repeat(use, per)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        mine = (np.arange(len(doc)) % parts) == part
        block = (self.block_first[doc[mine]] + k[mine] * w)[:, None] + np.arange(w)
        stop = (self.block_first + self.blocks)[doc[mine], None]
        return np.minimum(block, stop - 1), block < stop


NAMES = ["learn", "first", "words", "ids", "sizes"]


def _chunks(batches, end: int):
    for b in batches:
        for i in range(b.num_rows):
            yield Chunk({c: b.column(c)[i].as_py() for c in NAMES}, end)


def _summed(c: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, at, to = np.unique(event(c, x), return_index=True, return_inverse=True)
    return c[at], x[at], np.bincount(to, n, len(key))


def _tied(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, equal bytes of neighbours side by side."""
    flat = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()
    raw = np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(flat(x) for x in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _untied(data: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), "zstd"), np.uint8)
    at, out = 8 * len(kinds), []
    for kind, n in zip(map(np.dtype, kinds), np.frombuffer(raw, np.int64, len(kinds))):
        stop = at + int(n) * kind.itemsize
        out.append(np.ascontiguousarray(raw[at:stop].reshape(kind.itemsize, -1).T).reshape(-1).view(kind))
        at = stop
    return out


def _ranges(h: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of all hashes begins among sorted ones, and their end."""
    return np.searchsorted((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, which ``np.cumsum`` of their kind undoes."""
    return np.diff(x, prepend=x.dtype.type(0))


def _hashes(data: bytes) -> np.ndarray:
    """A chunk's words' hashes, ascending."""
    return np.cumsum(_untied(data, np.uint64)[0], dtype=np.uint64)


#: Words as arrays: hash, training count, chunks that have them, how many ids, ids end to end.
WORD = np.uint64, np.int64, np.int64, np.int32, np.int32


def _dealt(rows: tuple[np.ndarray, ...], at: np.ndarray) -> pa.RecordBatch:
    """Words (arrays as ``WORD`` says) cut at ``at``, a row for each part that has some."""
    h, n, many, sizes, ids = rows
    first = np.append(0, np.cumsum(sizes, dtype=np.int64))
    some = np.flatnonzero(np.diff(at))
    cells = [_tied(_steps(h[s:e]), n[s:e], many[s:e], sizes[s:e], ids[first[s] : first[e]]) for s, e in zip(at[some], at[some + 1])]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(cells, pa.binary())], ["part", "data"])


def _together(cells: pa.ChunkedArray) -> list[np.ndarray]:
    """What ``_dealt`` has cut, end to end."""
    got = [_untied(x.as_py(), *WORD) for x in cells]
    return [np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got]), *(np.concatenate([x[k] for x in got]) for k in range(1, 5))]


def _distinct(h: np.ndarray, n: np.ndarray, many: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each word once, by its hash, with the sums of its counts."""
    key, at, to = np.unique(h, return_index=True, return_inverse=True)
    size, first = sizes[at], (np.cumsum(sizes, dtype=np.int64) - sizes)[at]
    return key, np.bincount(to, n, len(key)).astype(np.int64), np.bincount(to, many, len(key)).astype(np.int64), size, ids[spans(first, size)]


def _words(chunks: DataFrame) -> DataFrame:
    """(hash, c, many, ids) of all distinct words: training count, chunks that have the word, its
    ids as big-endian bytes, whose order is that of the ids. Words travel by ranges of their
    hashes, those of some chunks together."""
    all_words = chunks.agg(F.sum(F.octet_length("sizes"))).first()[0] or 0
    parts = max(spread(chunks.sparkSession), -(-all_words // (16 * WORDS)))

    def some(batches):
        held: list = []

        def rows():
            held[:] = [_distinct(*(np.concatenate([x[k] for x in held]) for k in range(5)))]
            return held[0]

        for b in batches:
            for i in range(b.num_rows):
                n, ids, sizes = (np.frombuffer(b.column(c)[i].as_py(), np.int32) for c in ("n", "ids", "sizes"))
                h = _hashes(b.column("hash")[i].as_py())
                if len(n):
                    held.append((h, n.astype(np.int64), np.ones(len(n), np.int64), sizes, ids))
                if sum(len(x[0]) for x in held) > 4 * WORDS:
                    yield _dealt(rows(), _ranges(held[0][0], parts))
                    held.clear()
        if held:
            yield _dealt(rows(), _ranges(held[0][0], parts))

    def whole(t: pa.Table) -> pa.Table:
        key, n, many, sizes, ids = _distinct(*_together(t.column("data")))
        return pa.Table.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(many), _cells(sizes * 4, ids.astype(">i4"))], ["hash", "c", "many", "ids"])

    dealt = chunks.select("hash", "n", "ids", "sizes").mapInArrow(some, "part int, data binary")
    return dealt.groupBy("part").applyInArrow(whole, "hash long, c long, many long, ids binary")


def _cells(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """An array of binaries of ``sizes`` bytes, from their bytes end to end."""
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _bytes_of(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of binaries, end to end, and their sizes."""
    if not len(cells):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, data = cells.buffers()
    offsets = np.frombuffer(offsets, np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


PARTS = "part int, hash binary, c binary, many binary, ids binary, sizes binary, low binary, high binary"


def _part(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[k], t) for k, t in (("hash", np.int64), ("c", np.int64), ("ids", np.int32), ("sizes", np.int32)))


def _events(c: np.ndarray, ids: np.ndarray, sizes: np.ndarray, extra: tuple = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of what follows words' ids so far."""
    before, whole, place = contexts(ids, sizes)
    many = np.repeat(c, sizes)
    inner = np.flatnonzero((place > 0) & (many > 0))
    used = c > 0
    own = (before[inner], ids[inner].astype(np.int64), many[inner]), (whole[used], np.full(int(used.sum()), ENDS), c[used]), *extra
    return _summed(*(np.concatenate([x[k] for x in own]) for k in range(3)))


def _pairs(c: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring ids in words as numbers, and how often they occur."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inner = np.flatnonzero(place > 0)
    key, to = np.unique((ids[inner - 1].astype(np.int64) << 32) + ids[inner], return_inverse=True)
    return key, np.bincount(to, np.repeat(c, sizes)[inner], len(key)).astype(np.int64)


class Border:
    """Contexts that parts share, with totals over all parts, and the counts of their events that
    parts share too. ``rows``: (context, x, n, kinds) of parts."""

    def __init__(self, c: np.ndarray, x: np.ndarray, n: np.ndarray, kinds: np.ndarray):
        c = c.view(np.uint64)
        cut = x >= 0
        pc, px, pn = _summed(c[cut], x[cut], n[cut])
        self.pairs = pc, px, pn
        self.context = np.unique(c)
        total = lambda own, v: np.bincount(np.searchsorted(self.context, own), v, len(self.context)).astype(np.float32)
        whole = x == INNER
        self.go = total(pc, pn) + total(c[whole], n[whole])
        self.kinds = total(pc, pn > 0) + total(c[whole], kinds[whole])
        self.stop = total(c[x == ENDS], n[x == ENDS])

    def rows(self) -> tuple:
        """Events of no count, so that a table has them."""
        c, x, _ = self.pairs
        return np.concatenate([c, self.context]), np.concatenate([x, np.full(len(self.context), ENDS)]), np.zeros(len(c) + len(self.context), np.int64)

    def put(self, table: Table) -> Table:
        """The totals over all parts into a part's table."""
        at = np.searchsorted(table.context, self.context)
        for name in ("go", "kinds", "stop"):
            getattr(table, name)[at] = getattr(self, name)
        key = event(self.pairs[0], self.pairs[1])
        table.n[np.searchsorted(table.key, key)] = self.pairs[2]
        return table


def _cut(c: np.ndarray, ids: np.ndarray, sizes: np.ndarray, ends: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of a part whose first and last words have the ids ``ends``: (context, x, n, kinds) of the
    contexts along these words, of their events along them, and of all other events together."""
    context, x, n = _events(c, ids, sizes)
    b, w, place = contexts(np.concatenate(ends), np.array([len(e) for e in ends]))
    path = np.unique(np.concatenate([b[place > 0], w]))
    along = np.unique(event(b[place > 0], np.concatenate(ends)[place > 0]))
    here = np.isin(context, path)
    context, x, n = context[here], x[here], n[here]
    ours = (x == ENDS) | np.isin(event(context, x), along)
    other = ~ours
    at = np.searchsorted(path, context[other])
    sums, kinds = np.bincount(at, n[other], len(path)), np.bincount(at, minlength=len(path))
    zero = np.zeros(int(ours.sum()), np.int64)
    return np.concatenate([context[ours], path]), np.concatenate([x[ours], np.full(len(path), INNER)]).astype(np.int64), np.concatenate([n[ours], sums]).astype(np.int64), np.concatenate([zero, kinds]).astype(np.int64)


def _order(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words' first ids as bytes, whose order is that of the words, as far as they say it."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes, dtype=np.int64) - sizes, sizes)
    out = np.zeros((len(sizes), 8), ">u4")
    here = place < 8
    out[np.repeat(np.arange(len(sizes)), sizes)[here], place[here]] = ids[here] + 1
    return out.view("S32").reshape(-1)


def _parted(words: DataFrame, many: int) -> tuple[DataFrame, int]:
    """Words in parts (``PARTS``) of consecutive ids, of about ``WORDS`` words, and how many parts
    there may be."""
    n_parts = max(1, -(-many // WORDS))
    some = words.where(F.pmod(F.xxhash64("hash"), F.lit(max(1, many // (64 * n_parts)))) == 0).select("ids").toArrow() if n_parts > 1 else None
    some = sorted(some.column("ids").to_pylist()) if some is not None else []
    cuts = [some[k * len(some) // n_parts] for k in range(1, n_parts)] if some else []
    orders = _order(np.frombuffer(b"".join(cuts), ">i4").astype(np.int64), np.array([len(x) // 4 for x in cuts], np.int64))

    def deal(batches):
        held: list = []

        def out():
            h, n, many, sizes, ids = (np.concatenate([x[k] for x in held]) for k in range(5))
            held.clear()
            order, first = _order(ids, sizes), np.cumsum(sizes, dtype=np.int64) - sizes
            part = np.searchsorted(orders, order, "right")
            # Words that begin as a cut does: all their ids are compared.
            for i in np.flatnonzero(part > np.searchsorted(orders, order, "left")):
                part[i] = bisect.bisect_right(cuts, ids[first[i] : first[i] + sizes[i]].astype(">i4").tobytes())
            by = np.argsort(part, kind="stable")
            ids = ids[spans(first[by], sizes[by])]
            return _dealt((h[by], n[by], many[by], sizes[by], ids), np.searchsorted(part[by], np.arange(n_parts + 1)))

        for b in batches:
            data, sizes = _bytes_of(b.column("ids"))
            held.append((b.column("hash").to_numpy().view(np.uint64).copy(), b.column("c").to_numpy().copy(), b.column("many").to_numpy().copy(), (sizes // 4).astype(np.int32), data.view(">i4").astype(np.int32)))
            if sum(len(x[0]) for x in held) > 4 * WORDS:
                yield out()
        if held:
            yield out()

    def whole(t: pa.Table) -> pa.Table:
        h, n, many, sizes, ids = _together(t.column("data"))
        order = _order(ids, sizes)
        first, by = np.cumsum(sizes, dtype=np.int64) - sizes, np.sort(order)
        ends = [f(ids[first[i] : first[i] + sizes[i]].astype(">i4").tobytes() for i in np.flatnonzero(order == x)) for f, x in ((min, by[0]), (max, by[-1]))]
        row = [h.tobytes(), n.tobytes(), many.tobytes(), ids.tobytes(), sizes.tobytes(), *ends]
        return pa.Table.from_arrays([pa.array([t.column("part")[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], [x.split()[0] for x in PARTS.split(", ")])

    with batches_of(words.sparkSession, 100_000):
        dealt = words.select("hash", "c", "many", "ids").mapInArrow(deal, "part int, data binary")
        return bucketed(dealt.groupBy("part").applyInArrow(whole, PARTS), "parts", "part"), n_parts


def _said(words: DataFrame, many: int, model: Model) -> DataFrame:
    """(hash, c, many, said) of ``many`` distinct words, what all counts say of their ids."""
    spark, v = words.sparkSession, len(model.opens)
    parts, n_parts = _parted(words, many)
    fields = max(spread(spark), n_parts // 8)

    def each(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield {k: b.column(k)[i].as_py() for k in b.schema.names}

    def cut(batches):
        for row in each(batches):
            _, c, ids, sizes = _part(row)
            got = _cut(c, ids, sizes, [np.frombuffer(row[k], ">i4").astype(np.int32) for k in ("low", "high")])
            yield pa.RecordBatch.from_arrays([pa.array(got[0].view(np.int64)), *map(pa.array, got[1:])], ["c", "x", "n", "kinds"])

    def pairs(batches):
        for row in each(batches):
            key, n = _pairs(*_part(row)[1:])
            field = (W.mix(key.astype(np.uint64)) % np.uint64(fields)).astype(np.int32)
            by = np.argsort(field, kind="stable")
            key, n, at = key[by], n[by], np.searchsorted(field[by], np.arange(fields + 1))
            some = np.flatnonzero(np.diff(at))
            cells = [_tied(_steps(key[s:e]), n[s:e]) for s, e in zip(at[some], at[some + 1])]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), row["part"], np.int32)), pa.array(cells, pa.binary())], ["field", "part", "data"])

    def summed(t: pa.Table) -> pa.Table:
        # A row for each part, with its pairs' counts over all parts, and one (below 0) for all pairs.
        got = [_untied(x.as_py(), np.int64, np.int64) for x in t.column("data")]
        keys = [np.cumsum(x[0]) for x in got]
        key, to = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(to, np.concatenate([x[1] for x in got]), len(key)).astype(np.int64)
        cells = [_tied(_steps(k), n[np.searchsorted(key, k)]) for k in keys] + [_tied(_steps(key), n)]
        return pa.Table.from_arrays([pa.array([*t.column("part").to_pylist(), -1 - t.column("field")[0].as_py()], pa.int32()), pa.array(cells, pa.binary())], ["part", "data"])

    def follows(batches):
        total = np.zeros(2 * v)
        for row in each(batches):
            key, n = _untied(row["data"], np.int64, np.int64)
            key = np.cumsum(key) >> 32
            total += np.concatenate([np.bincount(key, n, v), np.bincount(key, n > 0, v)])
        yield total

    def last(batches):
        total = np.zeros(v)
        for row in each(batches):
            _, c, ids, sizes = _part(row)
            total += np.bincount(ids[np.cumsum(sizes) - 1], c, v)
        yield total

    got = parts.mapInArrow(cut, "c long, x long, n long, kinds long").toArrow() if n_parts > 1 else None
    border = Border(*(got.column(k).to_numpy() for k in ("c", "x", "n", "kinds"))) if got is not None else Border(*(np.zeros(0, np.int64),) * 4)
    dealt = parts.mapInArrow(pairs, "field int, part int, data binary").groupBy("field").applyInArrow(summed, "part int, data binary")
    # In buckets as the parts are: both are read as they lie.
    sums = bucketed(dealt.groupBy("part").agg(F.collect_list("data").alias("met")), "pairs", "part")
    go, kinds = total_of(sums.where("part < 0").select(F.explode("met").alias("data")), follows, 2 * v).reshape(2, v).astype(np.float32)
    stop = total_of(parts, last, v).astype(np.float32)
    stops, goes = 2 * float(stop.sum(dtype=float)), 2 * float(go.sum(dtype=float))
    model.stops = np.float32((stops + 1) / (stops + goes + 2))
    shared = spark.sparkContext.broadcast((model, border, (go, kinds, stop)))

    def said(batches):
        m, border, by_id = shared.value
        for b in batches:
            for i in range(b.num_rows):
                h, c, ids, sizes = _part({k: b.column(k)[i].as_py() for k in ("hash", "c", "ids", "sizes")})
                chunks = np.frombuffer(b.column("many")[i].as_py(), np.int64)
                pair = [_untied(x, np.int64, np.int64) for x in b.column("met")[i].as_py() or ()]
                key, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.cumsum(k) for k, _ in pair], [n for _, n in pair]))
                own = event(np.zeros(len(key), np.uint64), key >> 32), key & 0xFFFFFFFF, n
                table = border.put(Table(*_events(c, ids, sizes, (own, border.rows()))))
                table.by_id = by_id
                out = np.zeros(len(ids), SAID)
                for p, bucket, less in (("q", "d", True), ("p", "b", False)):
                    counted, buckets, kind = m.of_words(ids, sizes, less, table)
                    out[p], out[bucket] = counted[:-1], buckets[:-1]
                first = np.cumsum(sizes) - sizes
                out["p"][first] = out["q"][first] = 0
                if len(first):
                    out["kind"][first + sizes - 1] = np.add.reduceat(kind[:-1], first)
                cells = _cells(sizes * SAID.itemsize, out)
                for lo in range(0, len(h), PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + PIECE]) for x in (h, c, chunks)] + [cells.slice(lo, PIECE)], ["hash", "c", "many", "said"])

    out = stored(parts.join(sums, "part", "left").mapInArrow(said, "hash long, c long, many long, said binary"), "said")
    gone(parts)
    gone(sums)
    return out


class Hot:
    """What counts say of the words of most chunks."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        cells = rows.column("said")
        data, sizes = _bytes_of(cells.chunk(0) if cells.num_chunks else pa.array([], pa.binary()))
        h = rows.column("hash").to_numpy().view(np.uint64)
        by = np.argsort(h)
        size = sizes // SAID.itemsize
        first = np.cumsum(size) - size
        self.hash, self.c, self.sizes = h[by], rows.column("c").to_numpy()[by], size[by]
        self.said = data.view(SAID)[spans(first[by], self.sizes)]
        self.first = np.cumsum(self.sizes) - self.sizes

    def at(self, h: np.ndarray) -> np.ndarray:
        """Where words are, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1).astype(np.int32)


KNOWN = "array<binary>"


def _bound(no: np.ndarray, c: np.ndarray, said: np.ndarray) -> bytes:
    """Words' numbers in a chunk, ascending, their training counts and what counts say of their ids, end to end."""
    return _tied(_steps(no), c, said)


def _unbound(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, c, said = _untied(data, np.int32, np.int64, SAID)
    return np.cumsum(steps, dtype=np.int32), c, said


def _met(chunks: DataFrame, said: DataFrame, most: int) -> tuple[DataFrame, Hot]:
    """The chunks with what counts say of their words that are not hot, and the hot ones."""
    spark, least, kept = chunks.sparkSession, math.inf, 0
    words = 0
    for n, k in sorted(((r.many, r.k) for r in said.groupBy(F.least("many", F.lit(1 << 12)).alias("many")).agg(F.count("*").alias("k")).collect()), reverse=True):
        words += k
        if words <= most:
            least, kept = n, words
    with batches_of(spark, 100_000):
        hot = Hot((said.where(F.col("many") >= least) if least < math.inf else said.limit(0)).select("hash", "c", "said").toArrow())
    shared = spark.sparkContext.broadcast(hot.hash)

    parts = max(spread(spark), -(-max(words - kept, 0) // (8 * WORDS)))

    def asks(batches):
        h = Hot.__new__(Hot)
        h.hash = shared.value
        for b in batches:
            for i in range(b.num_rows):
                own = _hashes(b.column("hash")[i].as_py())
                no = np.flatnonzero(h.at(own) < 0).astype(np.int32)
                own = own[no]
                at = _ranges(own, parts)
                some = np.flatnonzero(np.diff(at))
                cells = [_tied(_steps(no[s:e]), _steps(own[s:e])) for s, e in zip(at[some], at[some + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), b.column("chunk")[i].as_py(), np.int64)), pa.array(cells, pa.binary())], ["part", "chunk", "data"])

    def deal(batches):
        held: list = []

        def out():
            h, c, sizes = (np.concatenate([x[k] for x in held]) for k in range(3))
            said = np.concatenate([x[3] for x in held]).view(SAID)
            held.clear()
            by = np.argsort(h)
            h, c, first, sizes = h[by], c[by], (np.cumsum(sizes) - sizes)[by], sizes[by]
            said, upto = said[spans(first, sizes)], np.append(0, np.cumsum(sizes))
            at = _ranges(h, parts)
            some = np.flatnonzero(np.diff(at))
            cells = [_tied(_steps(h[s:e]), c[s:e], sizes[s:e].astype(np.int32), said[upto[s] : upto[e]]) for s, e in zip(at[some], at[some + 1])]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(cells, pa.binary())], ["part", "data"])

        for b in batches:
            said, sizes = _bytes_of(b.column("said"))
            # A copy: what is held would keep the batch's buffers.
            held.append((b.column("hash").to_numpy().view(np.uint64).copy(), b.column("c").to_numpy().copy(), sizes // SAID.itemsize, said.copy()))
            if sum(len(x[0]) for x in held) > 4 * WORDS:
                yield out()
        if held:
            yield out()

    def answer(told: pa.Table, asked: pa.Table) -> pa.Table:
        got = [_untied(x.as_py(), np.uint64, np.int64, np.int32, SAID) for x in told.column("data")]
        h = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(x[0], dtype=np.uint64) for x in got)])
        c, sizes, said = (np.concatenate([np.zeros(0, t), *(x[k] for x in got)]) for k, t in ((1, np.int64), (2, np.int32), (3, SAID)))
        got.clear()
        by = np.argsort(h)
        key, first = h[by], np.cumsum(sizes, dtype=np.int64) - sizes
        cells = []
        for x in asked.column("data"):
            no, own = _untied(x.as_py(), np.int32, np.uint64)
            own = np.cumsum(own, dtype=np.uint64)
            at = by[np.minimum(np.searchsorted(key, own), len(by) - 1)] if len(by) else np.zeros(0, np.int64)
            here = h[at] == own if len(by) else np.zeros(len(own), bool)
            if not here.all():
                raise RuntimeError(f"{int((~here).sum())} words of a chunk have no counts")
            cells.append(_bound(np.cumsum(no, dtype=np.int32), c[at], said[spans(first[at], sizes[at])]))
        return pa.Table.from_arrays([asked.column("chunk"), pa.array(cells, pa.binary())], ["chunk", "data"])

    if least <= 1:
        return chunks.withColumn("known", F.lit(None).cast(KNOWN)), hot
    cold = said.where(F.col("many") < least).select("hash", "c", "said") if least < math.inf else said.select("hash", "c", "said")
    told = cold.mapInArrow(deal, "part int, data binary")
    asked = chunks.select("chunk", "hash").mapInArrow(asks, "part int, chunk long, data binary")
    # Chunks are in buckets as these are: the passes that need counts read both as they lie.
    with batches_of(spark, 20_000):
        known = bucketed(told.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(answer, "chunk long, data binary"), "known", "chunk")
    freed(spark)
    gone(said)
    return chunks.join(known.groupBy("chunk").agg(F.collect_list("data").alias("known")), "chunk", "left"), hot


def _rows(batches, model: Model, hot: Hot):
    """Chunks with their words' training counts and what counts say of their ids."""
    for b in batches:
        for i in range(b.num_rows):
            row = {k: b.column(k)[i].as_py() for k in b.schema.names if k not in ("hash", "known")}
            chunk = Chunk(row, model.end)
            at, size = hot.at(_hashes(b.column("hash")[i].as_py())), chunk.sizes
            first = np.cumsum(size) - size
            c, said = np.zeros(len(size)), np.zeros(len(chunk.pieces), SAID)
            no = np.flatnonzero(at >= 0)
            c[no] = hot.c[at[no]]
            said[spans(first[no], size[no])] = hot.said[spans(hot.first[at[no]], size[no])]
            found = len(no)
            for data in b.column("known")[i].as_py() or ():
                no, counts, own = _unbound(data)
                c[no], said[spans(first[no], size[no])] = counts, own
                found += len(no)
            if found != len(size):
                raise RuntimeError(f"{len(size) - found} words of a chunk have no counts")
            said["p"][first] = said["q"][first] = model.alone[chunk.pieces[first]]
            yield row, chunk, c, said


def fitted(chunks: DataFrame, opens: np.ndarray, rounds: int = ROUNDS, hot: int = HOT) -> Model:
    """The model of the texts to learn; with ``rounds`` of 0 its attention is as drawn."""
    return _learnt(chunks, stored(_words(chunks), "words"), opens, rounds, hot)[0]


def _learnt(chunks: DataFrame, words: DataFrame, opens: np.ndarray, rounds: int, most: int) -> tuple[Model, DataFrame, Hot]:
    """The model, and the chunks as ``_met`` gives them, with ``most`` hot words at most."""
    spark, end, v = chunks.sparkSession, len(opens) - 1, len(opens)
    small = chunks.select(*NAMES)

    none = np.zeros(0, np.int64)
    model = Model(opens, np.zeros(v), Table(none.view(np.uint64), none, none))
    for step in range(EM_STEPS + 1):
        shared = spark.sparkContext.broadcast(model)

        def topics(batches, shared=shared, step=step):
            m, total = shared.value, np.zeros((TOPICS, v))
            for c in _chunks(batches, end):
                if not c.learn.any():
                    continue
                if step:  # first ids of words say a text's topics
                    first = np.flatnonzero(m.opens[c.ids])
                    z = np.add.reduceat(np.take(m.logs_of, c.ids[first], 0), np.searchsorted(first, c.begins), 0).T + np.log(m.share)[:, None]
                    z = np.exp(z - z.max(0))
                    z /= z.sum(0)
                else:
                    z = _first_topics(c, m)
                z *= c.learn
                for k in range(TOPICS):
                    total[k] += np.bincount(c.ids, np.repeat(z[k], c.n), v)
            yield total.reshape(-1)

        counts = total_of(small, topics, TOPICS * v).reshape(TOPICS, v)
        shared.destroy()
        if not step:
            model.alone = model._shares(counts.sum(0) + 0.1)
        model.set_topics(counts)
    freed(spark)
    said = _said(words, words.count(), model)
    gone(words)
    freed(spark)
    met, hot = _met(chunks, said, most)
    freed(spark)
    names, of_hot = list(model.weights), spark.sparkContext.broadcast(hot)
    for part in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def train(batches, shared=shared, part=part):
            m = Model.__new__(Model)
            m.__dict__ = shared.value.__dict__ | {"weights": {c: w.copy() for c, w in shared.value.weights.items()}}
            seen = {c: np.zeros(w.shape) for c, w in m.weights.items()}
            done = 0
            for _, c, _, said in _rows(batches, m, of_hot.value):
                block, real = c.windows(part, rounds)
                counted, bucket, _ = m.ended(said, "q", "d", "kind")
                x = m.elements(c)
                padded, there = c.padded.reshape(-1, BLOCK), c.real.reshape(-1, BLOCK)
                number = np.arange(len(x)) - np.repeat(c.block_first, c.blocks)
                order = np.random.default_rng(part).permutation(len(block))
                for lo in range(0, len(order), BATCH):
                    some = order[lo : lo + BATCH]
                    at = block[some]
                    flat = at.reshape(-1)
                    p = np.minimum(padded[flat].reshape(-1), len(c.ids) - 1)
                    own = (there[flat] & real[some].reshape(-1)[:, None]).reshape(-1)
                    m.step(x[at], number[flat], bucket[c.place[p]], m.experts(c.ids[p], counted[c.place[p]]), own, seen)
                done += len(block)
            yield np.concatenate([[done], *((done * (m.weights[c] - shared.value.weights[c])).reshape(-1) for c in names)])

        total = total_of(met.select(*NAMES, "hash", "known"), train, 1 + sum(w.size for w in model.weights.values()), parts=1)
        shared.destroy()
        at = 1
        for c in names:
            w = model.weights[c]
            model.weights[c] = w + (total[at : at + w.size] / max(total[0], 1)).reshape(w.shape).astype(np.float32)
            at += w.size
        freed(spark)
    return model, met, hot


def _first_topics(c: Chunk, m: Model) -> np.ndarray:
    """A start for the topics: half of each text to one by its most frequent first id of a
    word, half to one by the next."""
    use = m.opens[c.ids] & (c.ids != m.end)
    doc = np.repeat(np.arange(len(c.n)), c.n)[use]
    key, n = np.unique(doc.astype(np.int64) * (m.end + 1) + c.ids[use], return_counts=True)
    doc, x = key // (m.end + 1), key % (m.end + 1)
    by = np.lexsort((x, -n, doc))
    doc, x = doc[by], x[by]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    z = np.full((TOPICS, len(c.n)), 1e-3)
    topic = (W.mix(x.astype(np.uint64) + np.uint64(1)) % np.uint64(TOPICS)).astype(np.int64)
    for k in (0, 1):
        np.add.at(z, (topic[rank == k], doc[rank == k]), 0.5)
    return z / z.sum(0)


def scored(docs: DataFrame, held: Column, tokenizer: str = TOKENIZER, rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all texts;
    ``held`` says which are not learnt from. ``tokenizer``: the path of a file of ranks."""
    spark = docs.sparkSession
    with batches_of(spark, 1_000):
        chunks, opens = _chunked(docs, held, tokenizer)
    with batches_of(spark, 2):  # rows are chunks of texts
        return stored(_scored(chunks, opens, rounds, hot), "scores")


def _chunked(docs: DataFrame, held: Column, tokenizer: str) -> tuple[DataFrame, np.ndarray]:
    spark = docs.sparkSession
    # A vocabulary file: by Spark's readers, or of the driver's disk.
    lines = [r.value.encode() for r in spark.read.text(tokenizer).collect()] if "://" in tokenizer else open(tokenizer, "rb").read().splitlines()
    read = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    ranks, opens = spark.sparkContext.broadcast(read), starts_word(read)
    return bucketed(encoded(docs, held, ranks), "chunks", "chunk"), opens


def _scored(chunks: DataFrame, opens: np.ndarray, rounds: int, most: int) -> DataFrame:
    spark = chunks.sparkSession
    words = stored(_words(chunks), "words")
    r = words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    freed(spark)
    ends = chunks.agg(F.sum(F.size(F.filter("learn", lambda x: x)))).first()[0] or 0
    n, v = (r[0] or 0) + ends, (r[1] or 0) + (ends > 0)
    model, met, hot = _learnt(chunks, words, opens, rounds, most)
    shared = spark.sparkContext.broadcast((model, hot))

    def score(batches):
        m, hot = shared.value
        for row, chunk, c, said in _rows(batches, m, hot):
            own = np.add.reduceat(m.logs(chunk, said=said), chunk.begins) / math.log(10)
            c = np.append(c, ends)
            first = np.frombuffer(row["first"], np.int64)
            every = np.insert(np.frombuffer(row["words"], np.int32), first[1:], len(c) - 1)
            size = np.diff(first) + 1
            doc, count = np.repeat(np.arange(len(size)), size), c[every]
            logs = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))[every]
            known = np.bincount(doc, count > 0, len(size)).astype(np.int64)
            out = [pa.array(row["docs"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(size), pa.array(known), pa.array(np.full(len(size), n)), pa.array(np.bincount(doc, logs, len(size))), pa.array(own)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met.select("docs", "held", *NAMES, "hash", "known").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
