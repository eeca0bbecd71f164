"""Line deduplication: documents' lines probe sharded minimal perfect hashes of repeated lines.

A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least
``least`` code points that two documents hold are kept by the smallest doc_id only. The
128-bit hashes of such keys are dealt to shards of about ``per_shard`` keys. A shard is a
minimal perfect hash over its keys with arrays of fingerprints, counts and keepers in its
order. Hashes of lines go to the shard that would hold them and look there, not shards to
documents: the index grows with the corpus, and each task's lines need all of it. A shard
that many lines look at is given to as many tasks as these need.

Defined cases: a null or empty text is one empty line; rows with equal doc_id are one
document (they may keep a line each); rows without doc_id are no document, neither count
nor lose lines; an empty table gives an empty result. Documents' other columns pass
through, whatever their names; n_lines, n_dropped and kept_text replace columns so named.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm.common import small_batches, stored
from relgraph.llm.words import SPACES, mix

LEAST = 10
PER_SHARD = 400_000
#: Lines that one task probes together.
PER_TASK = 1_000_000


def line_key(line: str) -> bytes:
    return line.encode("utf-8", "surrogatepass").strip(SPACES).lower()


def line_hash(line: str, least: int) -> bytes | None:
    """16 bytes, or None for a key of fewer than ``least`` code points."""
    key = line_key(line)
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "surrogatepass")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit keys: at each level the keys that
    fall alone into a slot stay there, the others go on to the next. A key's number is the
    count of taken slots before its own. Each level hashes both halves anew, so that no two
    keys meet on every level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sizes = [int(b.sum()) for b in levels]
        self.before = np.concatenate([[0], np.cumsum(sizes)])
        self.ranks = [np.cumsum(b) - 1 for b in levels]

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, room: float = 1.7) -> PerfectHash:
        levels = []
        while len(h1):
            at = cls._slot(h1, h2, len(levels), size := int(len(h1) * room) + 1)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            more = ~alone[at]
            h1, h2 = h1[more], h2[more]
        return cls(levels)

    @staticmethod
    def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))
        return (mix(mix(h1 + salt) + h2) % np.uint64(size)).astype(np.int64)

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Of each key; anything, or -1, for keys that were not there."""
        out, todo = np.full(len(h1), -1), np.arange(len(h1))
        for k, taken in enumerate(self.levels):
            at = self._slot(h1[todo], h2[todo], k, len(taken))
            here = taken[at]
            out[todo[here]] = self.before[k] + self.ranks[k][at[here]]
            todo = todo[~here]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return b"".join([head.tobytes(), *(np.packbits(b).tobytes() for b in self.levels)])

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        levels, at = [], 8 * (n + 1)
        for size in sizes:
            wide = (int(size) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, wide, at), count=int(size)).astype(bool))
            at += wide
        return cls(levels)


def document_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2, doc_id): each document's distinct keys of ``least`` code points or more."""

    def go(batches):
        for b in batches:
            ids, found = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                keys = {h for x in (text or "").split("\n") if (h := line_hash(x, least))}
                ids += [doc] * len(keys)
                found += keys
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(go, "h1 long, h2 long, doc_id long")


def line_index(lines: DataFrame, per_shard: int = PER_SHARD) -> tuple[DataFrame, int]:
    """(shard, hash, prints, counts, keepers) of the keys of two documents or more, and the
    number of shards."""
    repeated = stored(lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("_last"), F.count("*").alias("n")).where("keeper < _last").drop("_last"), "repeated")
    shards = max(1, -(-repeated.count() // per_shard))

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        perfect = PerfectHash.of(h1, h2)
        to = np.argsort(perfect.number(h1, h2))
        blobs = [np.ascontiguousarray(x[to]).tobytes() for x in (h2, table.column("n").to_numpy(), table.column("keeper").to_numpy())]
        return pa.table([[table.column("shard")[0].as_py()], [perfect.dump()], *([x] for x in blobs)], pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("hash", "prints", "counts", "keepers"))]))

    keyed = repeated.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return stored(keyed.groupBy("shard").applyInArrow(build, "shard long, hash binary, prints binary, counts binary, keepers binary"), "line-index"), shards


def probed(lines: DataFrame, index: DataFrame, shards: int, per_task: int = PER_TASK) -> DataFrame:
    """(doc_id, drop): the hashes of the lines that a document loses, end to end."""
    lines = lines.withColumn("shard", F.pmod("h1", F.lit(shards)))
    tasks = lines.groupBy("shard").agg(F.ceil(F.count("*") / per_task).alias("parts"))
    parts = index.join(tasks, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    sent = lines.join(F.broadcast(tasks) if shards <= 100_000 else tasks, "shard").withColumn("part", F.pmod(F.xxhash64("h2", "doc_id"), "parts")).drop("parts")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"doc_id": pa.array([], pa.int64()), "h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        blob = {c: right.column(c)[0].as_py() for c in ("hash", "prints", "counts", "keepers")}
        h1, h2, doc = (left.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
        at = PerfectHash.load(blob["hash"]).number(h1.view(np.uint64), h2.view(np.uint64))
        prints, keepers = np.frombuffer(blob["prints"], np.int64), np.frombuffer(blob["keepers"], np.int64)
        counts = np.frombuffer(blob["counts"], np.int64)
        hit = (at >= 0) & (prints[at] == h2) & (counts[at] > 1) & (keepers[at] != doc)
        return left.filter(pa.array(hit)).select(["doc_id", "h1", "h2"])

    found = sent.groupBy("shard", "part").cogroup(parts.groupBy("shard", "part")).applyInArrow(probe, "doc_id long, h1 long, h2 long")
    return found.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def dedup_lines(docs: DataFrame, least: int = LEAST, per_shard: int = PER_SHARD, per_task: int = PER_TASK) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text."""
    small_batches(docs.sparkSession)
    lines = stored(document_lines(docs, least), "lines")
    index, shards = line_index(lines, per_shard)
    drop = probed(lines, index, shards, per_task).withColumnRenamed("doc_id", "_doc")

    @F.arrow_udf("struct<n_lines: long, n_dropped: long, kept_text: string>")
    def keep(text: pa.Array, drop: pa.Array) -> pa.Array:
        out = []
        for t, d in zip(text.to_pylist(), drop.to_pylist()):
            own = (t or "").split("\n")
            lost = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in d or ()}
            kept = [x for x in own if line_hash(x, least) not in lost] if lost else own
            out.append({"n_lines": len(own), "n_dropped": len(own) - len(kept), "kept_text": "\n".join(kept)})
        return pa.array(out, pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())]))

    new = ["n_lines", "n_dropped", "kept_text"]
    own = docs.select("doc_id", "text", F.struct("*").alias("_row")).join(drop, F.col("doc_id") == F.col("_doc"), "left")
    own = own.select(F.struct("_row").alias("_row"), keep("text", "drop").alias("_kept"))
    return own.select(*(F.col("_row")["_row"][c].alias(c) for c in docs.columns if c not in new), *(F.col("_kept")[c].alias(c) for c in new))
