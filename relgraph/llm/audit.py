"""Filter interaction audit: what each of five filters removes, in every order of them.

Texts are looked at in Arrow's buffers, many at a time. A table gives each byte its classes
(word, capital, symbol, first byte of a character); running sums of these, read at the texts'
bounds, are counts per text. A text's words are sorted by hash; neighbours of equal hash are
compared byte by byte, so that the number of distinct words is exact. What a text fails is a
mask of five bits, and all that is asked is a sum over (part, mask): 32 rows a part at most.

Filters, by bit: A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals >
5 * code points; D any of ``#$%&*|``; E the text of a smaller doc_id in the whole table.

Defined cases: a null text is an empty one (fails A, and E beside another empty one); a null
source is the part ''; rows of one doc_id and one text are two documents and none is the
other's copy; a row without doc_id is nobody's copy and nobody's original, and has no labels;
of repeated labels any 1 counts; an empty table has no parts, so no rows; other columns are
not read.
"""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.llm import words as W
from relgraph.llm.common import looked_up, small_batches, stored

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"

CAPITAL, SYMBOL, BEGINS = (np.zeros(256, bool) for _ in range(3))
CAPITAL[65:91] = True
SYMBOL[list(SYMBOLS)] = True
BEGINS[:128] = BEGINS[192:] = True  # not the later bytes of a character


def counted(inside: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bytes of the class ``inside`` between neighbouring ``bounds``, by a running sum."""
    sums = np.concatenate([[0], np.cumsum(inside[data], dtype=np.int64)])
    return np.diff(sums[bounds])


def distinct_words(w: W.Words) -> np.ndarray:
    """The number of distinct words of each text."""
    out = np.zeros(len(w.first) - 1, np.int64)
    if not len(w.hash):
        return out
    doc = w.doc
    order = np.argsort(w.hash, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    a, b = order[:-1], order[1:]
    same = (doc[a] == doc[b]) & (w.hash[a] == w.hash[b])
    new = np.concatenate([[True], ~same])
    np.add.at(out, doc[order[new]], 1)
    for i in np.unique(doc[a[same][~equal_spans(w, a[same], b[same])]]):  # two words of one hash
        span = range(w.first[i], w.first[i + 1])
        out[i] = len({w.data[w.start[j] : w.end[j]].tobytes() for j in span})
    return out


def equal_spans(w: W.Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words a and b have the same bytes."""
    size = w.end[a] - w.start[a]
    same = size == w.end[b] - w.start[b]
    at = np.flatnonzero(same)
    if not len(at):
        return same
    size = size[at]
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    alike = w.data[np.repeat(w.start[a[at]], size) + place] == w.data[np.repeat(w.start[b[at]], size) + place]
    same[at] = np.logical_and.reduceat(alike, first)
    return same


def masks(texts: pa.Array) -> np.ndarray:
    """The bits A to D of what each text fails."""
    found = []
    for lo, hi in W.slices(texts):
        some = texts.slice(lo, hi - lo)
        w = W.words(some, lower=False)
        bounds = W._buffers(some)[1]
        bounds = bounds - bounds[0]
        n = np.diff(w.first)
        capitals, symbols, chars = (counted(c, w.data, bounds) for c in (CAPITAL, SYMBOL, BEGINS))
        fails = (n < LEAST_WORDS, 100 * distinct_words(w) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * chars, symbols > 0)
        found.append(sum(f.astype(np.int32) << k for k, f in enumerate(fails)))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def failed(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): a row per document and what it fails, E included."""
    small_batches(docs.sparkSession)

    def scan(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("digest"), pa.array(masks(b.column("text")), pa.int32())], ["doc_id", "part", "digest", "mask"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    rows = stored(rows.mapInArrow(scan, "doc_id long, part string, digest binary, mask int"), "scanned")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last").select("digest", "_first")
    rows = looked_up(rows, first, ["digest"], rows.count(), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).cast("int")
    return rows.select("doc_id", "part", (F.col("mask") + copy * (1 << FILTERS.index("E"))).alias("mask"))


def by_mask(fails: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just what the mask says."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = fails.where("doc_id is not null").join(marks, "doc_id", "left")
    none = fails.where("doc_id is null").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.unionByName(none).groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def orders() -> Column:
    """All steps of all orders: (filter_order, step, bit, before), the filter's bit and those of
    the filters before it."""
    steps = []
    for p in permutations(FILTERS):
        bits = [1 << FILTERS.index(x) for x in p]
        steps += [{"filter_order": "".join(p), "step": k + 1, "bit": b, "before": sum(bits[:k])} for k, b in enumerate(bits)]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley), a row per part and step of each of the 120 orders."""
    rows = by_mask(failed(docs), labels).withColumn("_step", F.explode(orders())).select("*", "_step.*")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, earlier = mask.bitwiseAND(bit) > 0, mask.bitwiseAND(before) > 0

    def total(when: Column, what: str | Column = "n") -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(what) if isinstance(what, str) else what)), F.lit(0)).cast("long")

    # A document that fails k filters is removed by each of them in 120 / k orders.
    share = F.col("n") * (120 / F.bit_count(mask)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )
