"""Toxicity: a logistic model on words and word beginnings, with a counterfactual penalty.

For labelled sentences that name a group, the group's name is swapped for the others of
its kind, and the training loss adds ``penalty`` times the squared change of the logit.
A group's name by itself then moves the score little, whatever the labels' bias.

Only the fitting looks at labels, at no more than ``sample`` labelled rows (the smallest
by a hash of doc_id); every text is scored whole. The score depends on the text alone.

Defined cases: a null or empty text has no features and gets the model's base rate; no
labelled rows give a score of 0 to all; repeated labels of a doc_id count as toxic if any
is; null labels and null ids are not learnt from; rows are never dropped or merged, and
all other columns pass through (``score`` and ``predicted`` replace columns so named).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.llm import words as W
from relgraph.llm.common import small_batches

#: Kinds of group names that may stand for one another, in English, German, French and Spanish.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled"),
    ("old", "young"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("schwule", "lesben", "transsexuelle"),
    ("ausländer", "flüchtlinge", "einwanderer", "einheimische"),
    ("behinderte", "blinde", "gehörlose"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("homosexuels", "lesbiennes", "transsexuels"),
    ("étrangers", "réfugiés", "immigrés", "autochtones"),
    ("handicapés", "aveugles", "sourds"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("homosexuales", "lesbianas", "transexuales"),
    ("extranjeros", "refugiados", "inmigrantes", "nativos"),
    ("discapacitados", "ciegos", "sordos"),
)
THRESHOLD = 0.7
SAMPLE = 20_000
FEATURES = 2048
PREFIXES = (4, 5, 6)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash), each distinct: the words of a text and their first 4, 5, 6 bytes."""
    w = W.words(texts, W.ALNUM)
    size, doc = w.end - w.start, w.doc
    rows, hashes = [doc], [w.hash]
    data = np.concatenate([w.data, np.zeros(max(PREFIXES), np.uint8)])
    part, done = np.zeros(len(w.start), np.uint64), 0
    for k in PREFIXES:
        for j in range(done, k):
            part += W._VALUE[data[w.start + j]] * W._powers[j]
        done = k
        long = size > k
        rows.append(doc[long])
        hashes.append(W.mix(part[long] ^ np.uint64(k)))
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class Model:
    """Weights of feature hashes (sorted) and the intercept."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def __post_init__(self):
        self.known = np.zeros(1 << 16, bool)
        self.known[self.keys & np.uint64(0xFFFF)] = True

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature number), distinct, of the model's features."""
        rows, hashes = features(texts)
        maybe = np.flatnonzero(self.known[hashes & np.uint64(0xFFFF)])
        rows, hashes = rows[maybe], hashes[maybe]
        at = np.searchsorted(self.keys, hashes)
        hit = np.append(self.keys, np.uint64(0))[at] == hashes
        hit &= at < len(self.keys)
        pairs = np.unique(rows[hit] * np.int64(len(self.keys) + 1) + at[hit])
        return pairs // (len(self.keys) + 1), pairs % (len(self.keys) + 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for lo, hi in W.slices(texts):
            rows, at = self.present(texts.slice(lo, hi - lo))
            z = self.bias + np.bincount(rows, self.weights[at], hi - lo)
            out.append(1 / (1 + np.exp(-np.clip(z, -700, 700))))
        return np.concatenate(out) if out else np.zeros(0)


def swaps(text: str, identity=IDENTITY) -> list[tuple[str, str]]:
    """(sentence, counterfactual) for each sentence of ``text`` with a group's name."""
    others = {t: kind for kind in identity for t in kind}
    found = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text or ""):
        low = sentence.lower()
        for t in sorted(set(re.findall(r"\w+", low)) & others.keys()):
            found += [(low, re.sub(rf"\b{t}\b", o, low)) for o in others[t] if o != t]
    return found


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, n_features: int = FEATURES, penalty: float = 1.0, ridge: float = 0.02, identity=IDENTITY) -> Model:
    """Learn from the ``sample`` labelled rows whose doc_id hashes lowest. ``learn`` is a
    condition on doc_id. The features are the ``n_features`` with the highest
    log-likelihood ratio between toxic and other rows, counted by Spark."""
    small_batches(docs.sparkSession)
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    rows = rows if learn is None else rows.where(learn)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("_y", "text")

    def counts(batches):
        for b in batches:
            y = b.column("_y").to_numpy(zero_copy_only=False)
            for lo, hi in W.slices(b.column("text")):
                r, h = features(b.column("text").slice(lo, hi - lo))
                pairs = pd.DataFrame({"r": r, "h": h}).drop_duplicates()
                pairs["y"] = y[lo:hi][pairs.r]
                g = pairs.groupby("h").y.agg(["sum", "size"])
                yield pa.RecordBatch.from_arrays([pa.array(g.index.to_numpy().view(np.int64)), pa.array(g["sum"].to_numpy(np.int64)), pa.array(g["size"].to_numpy(np.int64))], ["h", "k", "n"])

    totals = texts.agg(F.sum("_y"), F.count("*")).first()
    toxic, n = totals[0] or 0, totals[1]
    if not n:
        return Model()
    table = texts.mapInArrow(counts, "h long, k long, n long").groupBy("h").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).where("n >= 3")
    xlog = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    k, m = F.col("k"), F.col("n")
    gain = xlog(k, m * toxic / n) + xlog(m - k, m * (n - toxic) / n) + xlog(toxic - k, (n - m) * toxic / n) + xlog(n - m - toxic + k, (n - m) * (n - toxic) / n)
    best = table.select("h", gain.alias("gain")).orderBy(F.desc("gain"), "h").limit(n_features).collect()
    names = {W.words(pa.array([t])).hash[0] for kind in identity for t in kind}
    keys = np.unique(np.array([int(r.h) & (2**64 - 1) for r in best if r.gain > 6] + sorted(names), np.uint64))
    shape = Model(keys, np.zeros(len(keys)), 0.0)

    def rows_of(batches):
        for b in batches:
            y, t = b.column("_y").to_numpy(zero_copy_only=False), b.column("text")
            for lo, hi in W.slices(t):
                own = t.slice(lo, hi - lo)
                r, at = shape.present(own)
                pairs = [p for x in own.to_pylist() for p in swaps(x, identity)]
                changes: list[list[int]] = []
                for a, c in pairs:
                    both, f = shape.present(pa.array([a, c]))
                    changes.append([int(x) + 1 if s else -int(x) - 1 for s, x in zip(both, f)])
                xs = [list(map(int, at[r == i])) for i in range(hi - lo)] if hi > lo else []
                yield pa.RecordBatch.from_pylist([{"y": int(v), "x": x} for v, x in zip(y[lo:hi], xs)] + [{"y": -1, "x": c} for c in changes], pa.schema([("y", pa.int32()), ("x", pa.list_(pa.int32()))]))

    got = texts.mapInArrow(rows_of, "y int, x array<int>").toPandas()
    width = len(keys) + 1
    real, other = got[got.y >= 0].reset_index(drop=True), got[got.y < 0]
    size = real.x.map(len).to_numpy(np.int64)
    rows = np.concatenate([np.repeat(np.arange(len(real)), size), np.arange(len(real))])
    cols = np.concatenate([*real.x, np.full(len(real), width - 1)]).astype(np.int64)
    moved = np.zeros((width, width))
    for c in other.x:
        d = np.zeros(width)
        for f in c:
            d[abs(f) - 1] += np.sign(f)
        at = np.flatnonzero(d)
        moved[np.ix_(at, at)] += np.outer(d[at], d[at])
    w = newton(rows, cols, real.y.to_numpy(float), moved * penalty, ridge)
    return Model(keys, w[:-1], float(w[-1]))


def newton(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, moved: np.ndarray, ridge: float) -> np.ndarray:
    """Weights that minimise the summed log loss + ridge/2 |w|^2 (not on the last one, the
    intercept) + 1/2 w' moved w. Row r has a 1 in column c for each (rows, cols); each
    Newton step is solved by conjugate gradients."""
    w = np.zeros(len(moved))
    fixed = np.full(len(w), ridge)
    fixed[-1] = 1e-6
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], len(y)), -30, 30)))
        grad = np.bincount(cols, (p - y)[rows], len(w)) + fixed * w + moved @ w
        curve = np.maximum(p * (1 - p), 1e-6)

        def times(v):
            inner = curve * np.bincount(rows, v[cols], len(y))  # noqa: B023
            return np.bincount(cols, inner[rows], len(w)) + fixed * v + moved @ v

        step, r = np.zeros_like(w), -grad
        d, rr = r.copy(), r @ r
        for _ in range(60):
            if rr < 1e-8:
                break
            hd = times(d)
            a = rr / (d @ hd)
            step += a * d
            r = r - a * hd
            d, rr = r + (r @ r) / rr * d, r @ r
        w = w + step
        if np.abs(step).max() < 1e-3:
            break
    return w


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (1 from ``threshold`` on)."""

    @F.arrow_udf("double")
    def toxic(text: pa.Array) -> pa.Array:
        return pa.array(model.scores(text))

    return docs.withColumn("score", toxic("text")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
