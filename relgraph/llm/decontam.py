"""Benchmark decontamination: every training passage queries a BM25 index of test items.

Items are cut into entries of at most ``entry`` words. The inverted index holds each term's
postings in entry order with BM25 impacts as shares of the entry's best possible score, in
blocks with their maxima. Each passage (``2 * entry`` words, every ``entry`` words, so that
an entry lies whole in some passage) retrieves by block-max WAND all entries that reach
``least`` of their best score; an item with an entry found is then held against the whole
document: at least ``question`` of the n-grams of its question part and ``answer`` of those
of its answer part must occur there.

Most passages are passed over first, without loss: an entry's rarest terms, which make up
all but half of ``least`` of its best score, are its essential ones, and a passage whose
essential terms of some entry do not reach the other half cannot reach ``least``.

The index is built from at most ``max_items`` items at once; more items make more indexes,
each with idf values of its own, which all passages query in turn.

Defined cases: a null or empty text has no leaks; items without words are skipped; equal
items are each reported; rows are neither dropped nor merged and pass through with a column
``leaks`` (it replaces one of that name); an empty table of items leaks nothing.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm import words as W
from relgraph.llm.common import small_batches

ENTRY = 64
BLOCK = 32
K1, B = 0.9, 0.4
LEAST, QUESTION, ANSWER = 0.5, 0.7, 0.7
NGRAM = 3
MAX_ITEMS = 50_000
LEAK = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])


def parts(ids: np.ndarray, answer: float = 1 / 3) -> tuple[np.ndarray, np.ndarray]:
    """An item's question and answer words: the last third is the answer."""
    cut = len(ids) - max(1, int(len(ids) * answer)) if len(ids) > 1 else len(ids)
    return ids[:cut], ids[cut:]


def grams(h: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Distinct n-gram hashes; a shorter sequence is one n-gram, an empty one none."""
    n = min(n, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        total += h[j : len(h) - n + 1 + j] * W._powers[j]
    return np.unique(total)


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes
    first: np.ndarray  # postings of term t are first[t]:first[t + 1]
    entry: np.ndarray
    impact: np.ndarray
    most: np.ndarray  # by term
    block_first: np.ndarray  # blocks of term t
    block_last: np.ndarray  # last entry in each block
    block_most: np.ndarray
    item: np.ndarray  # of each entry
    ids: list[int]
    hashes: list[np.ndarray]  # of each item
    rare: tuple = ()  # essential terms (hashes), bounds of their postings, entries, impacts; what is left, by entry

    @classmethod
    def of(cls, ids: list[int], texts: list[str], least: float = LEAST) -> Index:
        w = W.words(pa.array(texts, pa.large_string()), W.ALNUM)
        hashes = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        entries, item = [], []
        for k, h in enumerate(hashes):
            for a in range(0, len(h), ENTRY):
                # The last entry of a long item is full, too.
                entries.append(h[max(0, min(a, len(h) - ENTRY)) :][:ENTRY])
                item.append(k)
        n, lengths = max(len(entries), 1), np.array([len(e) for e in entries] or [1])
        rows = np.repeat(np.arange(len(entries)), [len(e) for e in entries])
        terms, at = np.unique(np.concatenate([*entries, np.zeros(0, np.uint64)]), return_inverse=True)
        pairs, tf = np.unique(at.astype(np.int64) * n + rows, return_counts=True)
        term, entry = pairs // n, pairs % n
        df = np.bincount(term, minlength=len(terms))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[entry] / lengths.mean()))
        impact /= np.bincount(entry, impact, n)[entry]
        first = np.searchsorted(term, np.arange(len(terms) + 1))
        starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(first[:-1], first[1:])] or [np.zeros(0, int)]).astype(int)
        ends = np.minimum(starts + BLOCK, first[term[starts] + 1]) if len(starts) else starts
        most = np.maximum.reduceat(impact, first[:-1]) if len(terms) else impact
        # Essential postings: by entry, rarest terms first, until at most least / 2 is left.
        order = np.lexsort((term, df[term], entry))
        share = np.cumsum(impact[order])
        done = share - impact[order] - np.concatenate([[0.0], share])[np.searchsorted(entry[order], entry[order])]
        keep = np.sort(order[1 - done > least / 2])
        left = 1 - np.bincount(entry[keep], impact[keep], n)
        at, cut = np.unique(term[keep], return_index=True)
        rare = (terms[at], np.append(cut, len(keep)), entry[keep], impact[keep], left)
        return cls(terms, first, entry, impact, most, np.searchsorted(starts, first), entry[ends - 1] if len(starts) else starts, np.maximum.reduceat(impact, starts) if len(starts) else impact, np.array(item, int), list(ids), hashes, rare)

    def wand(self, query: list[int], least: float) -> list[tuple[int, float]]:
        """(entry, score) of all entries that reach ``least``, by block-max WAND."""
        first, entry, impact, most = self.first, self.entry, self.impact, self.most
        end = {t: int(first[t + 1]) for t in query}
        heap = [(int(entry[first[t]]), t, int(first[t])) for t in query]
        heapq.heapify(heap)
        found = []
        while heap:
            heap.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _p) in enumerate(heap):
                bound += most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = heap[pivot][0]
            while pivot + 1 < len(heap) and heap[pivot + 1][0] == doc:
                pivot += 1
            # The blocks that hold, or would hold, the pivot entry.
            bound, until = 0.0, None
            for _, t, _p in heap[: pivot + 1]:
                b0, b1 = int(self.block_first[t]), int(self.block_first[t + 1])
                b = b0 + int(np.searchsorted(self.block_last[b0:b1], doc))
                if b < b1:
                    bound += self.block_most[b]
                    last = int(self.block_last[b])
                    until = last if until is None else min(until, last)
            if bound >= least - 1e-12:
                if heap[0][0] == doc:
                    score = sum(float(impact[p]) for d, _t, p in heap[: pivot + 1] if d == doc)
                    if score >= least - 1e-9:
                        found.append((doc, score))
                go = doc + 1
            else:
                go = (until if until is not None else doc) + 1
                if pivot + 1 < len(heap):
                    go = max(doc + 1, min(go, heap[pivot + 1][0]))
            moved = []
            for d, t, p in heap[: pivot + 1]:
                goal = doc if bound >= least - 1e-12 and heap[0][0] != doc else go
                if d < goal:
                    p += int(np.searchsorted(entry[p : end[t]], goal))
                if p < end[t]:
                    moved.append((int(entry[p]), t, p))
            heap = moved + heap[pivot + 1 :]
        return found

    def leaks(self, texts: pa.Array, least: float, question: float, answer: float) -> list[list[dict]]:
        out: list[list[dict]] = []
        for lo, hi in W.slices(texts):
            w = W.words(texts.slice(lo, hi - lo), W.ALNUM)
            out += self._leaks(w, least, question, answer)
        return out

    def _leaks(self, w: W.Words, least, question, answer) -> list[list[dict]]:
        n = len(w.first) - 1
        found: list[dict[int, float]] = [{} for _ in range(n)]
        for d, passage in self._worth(w, least):
            at = w.first[d] + passage * ENTRY
            h = np.unique(w.hash[at : min(at + 2 * ENTRY, w.first[d + 1])])
            t = np.searchsorted(self.terms, h)
            t[t == len(self.terms)] = 0
            for e, s in self.wand([int(x) for x in t[self.terms[t] == h]], least):
                k = int(self.item[e])
                found[d][k] = max(s, found[d].get(k, 0.0))
        out = []
        for d, items in enumerate(found):
            own, rows = None, []
            for k, s in sorted(items.items()):
                if own is None:
                    own = grams(w.hash[w.first[d] : w.first[d + 1]])
                q, a = (self._part(p, own, w.hash[w.first[d] : w.first[d + 1]]) for p in parts(self.hashes[k]))
                if q >= question and a >= answer:
                    rows.append({"item_id": self.ids[k], "score": s, "question": q, "answer": a})
            out.append(rows)
        return out

    def _worth(self, w: W.Words, least: float) -> list[tuple[int, int]]:
        """(text, passage) of the passages whose essential terms let them reach ``least``."""
        terms, cut, entry, impact, left = self.rare
        if not len(terms):
            return []
        known = np.zeros(1 << 16, bool)
        known[terms & np.uint64(0xFFFF)] = True
        hit = np.flatnonzero(known[w.hash & np.uint64(0xFFFF)])
        at = np.searchsorted(terms, w.hash[hit])
        at[at == len(terms)] = 0
        same = terms[at] == w.hash[hit]
        hit, at = hit[same], at[same]
        doc = np.searchsorted(w.first, hit, "right") - 1
        # Passage p is the stretches p and p + 1 of ENTRY words each.
        stretch = (hit - w.first[doc]) // ENTRY
        base = np.concatenate([[0], np.cumsum(np.diff(w.first) // ENTRY + 2)])
        number = base[doc] + stretch
        v = len(terms)
        pairs = np.unique(np.concatenate([number * v + at, number[stretch > 0] * v - v + at[stretch > 0]]))
        passage, at = pairs // v, pairs % v
        many = cut[at + 1] - cut[at]
        posting = np.repeat(cut[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        keys, inverse = np.unique(np.repeat(passage, many) * len(left) + entry[posting], return_inverse=True)
        score = np.bincount(inverse, impact[posting], len(keys))
        worth = np.unique(keys[score >= least - left[keys % len(left)] - 1e-9] // len(left))
        owner = np.searchsorted(base, worth, "right") - 1
        return [(int(d), int(p - base[d])) for d, p in zip(owner, worth)]

    @staticmethod
    def _part(part: np.ndarray, own: np.ndarray, words: np.ndarray) -> float:
        """Share of a part's n-grams that the document has."""
        if len(part) >= NGRAM:
            return float(np.isin(grams(part), own).mean())
        return float(np.isin(part, words).mean()) if len(part) else 1.0


def decontaminate(docs: DataFrame, items: DataFrame, least: float = LEAST, question: float = QUESTION, answer: float = ANSWER, max_items: int = MAX_ITEMS) -> DataFrame:
    """``docs`` with leaks: array of (item_id, score, question, answer), by item_id."""
    small_batches(docs.sparkSession)
    items = items.select("item_id", "text").where("item_id is not null and text is not null")
    shards = max(1, -(-items.count() // max_items))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    kind = "array<struct<item_id: long, score: double, question: double, answer: double>>"
    found = []
    for k in range(shards):
        rows = items.where(shard == k).orderBy("item_id", "text").collect()  # about max_items
        index = docs.sparkSession.sparkContext.broadcast(Index.of([r.item_id for r in rows], [r.text for r in rows], least))

        found.append(F.arrow_udf(_finder(index, least, question, answer), kind)("text"))
    return docs.withColumn("leaks", F.array_sort(F.concat(*found)) if shards > 1 else found[0])


def _finder(index, least: float, question: float, answer: float):
    def leaks(text: pa.Array) -> pa.Array:
        return pa.array(index.value.leaks(text, least, question, answer), pa.list_(LEAK))

    return leaks
