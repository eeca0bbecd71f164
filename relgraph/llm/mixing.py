"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

Slot i of the schedule is the point frac(i * golden ratio); the interval of the
cumulative weights that it falls into names its source. Any run of slots then holds each
source nearly in proportion, with no counters that tasks would have to share. Slots are
ranked per source. A source's shuffled documents, laid end to end again and again, are a
stream of words, of which the slot of rank r takes those from r * ``block`` on: ``block`` of
them, but no word beyond the source's target. A source whose slots end before its target, as
one smaller than a block may, gets the slots that it lacks behind the others. So each source
gives its target, to the word.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a
source of its own, last in order; an empty table gives an empty result; rows with the
same doc_id, or without one, are separate pieces (equal rows take equal shares). Sizes,
targets and taken words of sources without words are 0. Columns of the input are not read
beyond doc_id, text and source. The sources themselves, a catalog, are ordered and held by
the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgraph.llm.common import n_words, numbered, stored

GOLDEN = (math.sqrt(5) - 1) / 2
WEIGHTS = (5, 2, 1)
BLOCK = 64
MOST = 3
#: Slots and documents that are ranked together in one task.
RUN = 16_384


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): shares of all tokens by
    weight, none over ``most`` times its source's size; what is over is shared again."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = stored(sizes.select("source", "source_size", weight.alias("weight")), "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * most
    level = math.inf  # of tokens per weight, above which a source is full
    while True:
        full = F.col("weight") * level >= cap
        r = t.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first() if level < math.inf else (0.0, t.agg(F.sum("weight")).first()[0] or 0.0)
        new = (total - r[0]) / r[1] if r[1] else level
        if new == level or not r[1]:
            break
        level = new
    return t.withColumn("target", F.least(F.col("weight") * F.lit(level if level < math.inf else 0.0), cap.cast("double")))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> dict[str, DataFrame]:
    """``sources``: targets; ``schedule``: (slot, source_no, rank, start, tokens), the words of
    its source's stream that a slot takes; ``pieces``: (doc_id, source_no, start, size), a
    document's place in the stream; ``documents``: (doc_id, size, source, source_size, target,
    taken)."""
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    # Sources as numbered intervals of the cumulative targets; empty ones have none.
    w = Window.orderBy(F.col("source").isNull(), "source")
    sources = stored(by_source.select("*", (F.row_number().over(w) - 1).alias("source_no"), F.sum("target").over(w).alias("upto"), F.round("target").cast("long").alias("_words")), "targets")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    n_slots = math.ceil(total / block)
    few = sources.count() <= 100_000
    named = sources.select(F.col("source").alias("_s"), "source_no", "source_size", "target")
    keyed = sized.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    # Shuffled order of a source's documents: by a hash of doc_id, in buckets of about RUN.
    buckets = max(64, keyed.count() // RUN)
    keyed = keyed.withColumn("_h", F.xxhash64("doc_id", F.lit(17))).withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 33), F.lit(buckets)))
    laid = numbered(keyed, ["_b", "_h", "doc_id", "size"], "start", ["source_no"], "size")

    # The schedule. Slots are dealt by number; the interval search is a range of a small sorted list.
    spark = docs.sparkSession
    ends = [float(r.upto) / total for r in sources.orderBy("source_no").select("upto").collect()] if total else []
    at = F.col("slot") * F.lit(GOLDEN)
    slots = spark.range(n_slots).select(F.col("id").alias("slot")).withColumn("_u", at - F.floor(at))

    @F.arrow_udf("long")
    def interval(u):
        import numpy as np
        import pyarrow as pa

        return pa.array(np.minimum(np.searchsorted(np.array(ends), u.to_numpy(zero_copy_only=False), "right"), len(ends) - 1).astype(np.int64))

    slots = slots.withColumn("source_no", interval("_u")).withColumn("_b", F.floor(F.col("slot") / RUN)).withColumn("_one", F.lit(1).cast("long"))
    ranked = stored(numbered(slots, ["_b", "slot"], "rank", ["source_no"], "_one").select("slot", "source_no", "rank"), "slots")
    # Slots that sources lack, behind the others in order of rank.
    had = sources.where("_words > 0").join(ranked.groupBy(F.col("source_no").alias("_n")).agg(F.count("*").alias("_had")), F.col("source_no") == F.col("_n"), "left")
    lacked = had.withColumns({"_from": F.coalesce("_had", F.lit(0).cast("long")), "_to": F.ceil(F.col("_words") / block)}).where("_from < _to")
    lacked = lacked.withColumn("rank", F.explode(F.expr("sequence(_from, _to - 1)")))
    lacked = lacked.select((F.lit(n_slots) + F.row_number().over(Window.orderBy("rank", "source_no")) - 1).alias("slot"), "source_no", "rank") if n_slots else ranked
    words = sources.select("source_no", "_words")
    every = ranked.unionByName(lacked) if n_slots else ranked
    schedule = every.join(F.broadcast(words) if few else words, "source_no").withColumn("start", F.col("rank") * block)
    schedule = schedule.where("start < _words").select("slot", "source_no", "rank", "start", F.least(F.lit(block), F.col("_words") - F.col("start")).alias("tokens"))

    # What the slots of a source take is its stream up to their last word: whole times and a rest.
    took = schedule.groupBy(F.col("source_no").alias("_n")).agg(F.sum("tokens").alias("_took"))
    out = laid.join(F.broadcast(took) if few else took, F.col("source_no") == F.col("_n"), "left")
    times, rest = F.floor(F.col("_took") / F.col("source_size")), F.col("_took") % F.col("source_size")
    taken = times * F.col("size") + F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    documents = out.select("doc_id", "size", "source", "source_size", F.col("target").cast("double"), F.coalesce(F.when(F.col("size") > 0, taken), F.lit(0)).cast("long").alias("taken"))
    return {"sources": sources.drop("_words"), "schedule": schedule, "pieces": laid.where("size > 0").select("doc_id", "source_no", "start", "size"), "documents": documents}
