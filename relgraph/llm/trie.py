"""Conversation prefix trie: what conversations share from their start, node by node.

Each conversation is rebuilt from the first turns of its base and its own later ones
(``rebuilt``). A node of depth d stands for all conversations with the same first d turns; its
children go on by one turn. The root (depth 0) has no text.

1. Turns are encoded by a dictionary: one id per distinct (role, text).
2. MSD radix partitioning, distributed. A bucket holds the conversations that agree so far. Each
   round, for all buckets at once: the turns that all of a bucket's conversations share next are
   nodes of one chain (found by an aggregate per bucket and place, whatever its length); the
   first turn in which they differ is the digit that deals them into new buckets. A bucket of one
   conversation is a chain already; one of at most ``LOCAL`` turns is local; the rest recurse.
3. Local buckets are finished by multikey quicksort, many of them in a task and all of their open
   groups at a time: a group is split at a pivot's id into less, equal and greater; each equal
   part is a node, and goes on with the next turn.
4. Sums over subtrees: each bucket of a round carries its path, so that one aggregate gives what
   lies below it. Digests of the ids that end at a node are made while they stream by in order.

Defined cases: rows without conv_id belong to no conversation; null role or text is empty; turns
are ordered with null first, and rows of one conversation and turn by role, then text; a repeated
row is a turn of its own; remainders take the sign of the conv_id; an empty table has no
conversations, so no nodes; other columns are not read. A conversation may be of any length: its
turns are rows, and only buckets of at most ``LOCAL`` turns are held by a task as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm.common import looked_up, numbered, small_batches, stored

#: Turns of a bucket that a task finishes.
LOCAL = 4096
#: Turns that a task of many buckets takes, about.
TASK = 50_000
#: A conversation begins with those of conv_id - conv_id % BASE, fewer than HEAD of them.
BASE, HEAD = 5, 9

EMPTY = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
MADE = "top_of long, " + ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS)


def _placed(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 1 in the group of ``key``; a hot group is many ranges."""
    ranged = rows.repartitionByRange(key, *order).withColumns({"_part": F.spark_partition_id(), "_one": F.lit(1).cast("long")})
    return numbered(stored(ranged, "ranged"), ["_part", *order], name, [key], "_one").withColumn(name, F.col(name) + 1).drop("_part", "_one")


def encoded(turns: DataFrame) -> DataFrame:
    """(conv, at, id, bytes): each conversation's turns in order, by the dictionary's ids."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    # Only where rows of one conversation and turn are there, what they say orders them.
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text")), 256)))
    same = rows.groupBy("conv", "turn").count().where("count > 1").isEmpty()
    keep = [F.lit("").alias("role"), F.lit("").alias("text")] if same else ["role", "text"]
    rows = rows.select("conv", F.col("turn").isNotNull().alias("later"), "turn", *keep, "digest", F.octet_length("text").cast("long").alias("bytes"))
    rows = stored(_placed(rows, "conv", ["later", "turn", "role", "text"], "at").select("conv", "at", "digest", "bytes"), "turns")
    each = rows.select("digest").distinct().withColumn("all", F.lit(0))
    ids = stored(_placed(each, "all", ["digest"], "id").select("digest", "id"), "dictionary")
    return stored(looked_up(rows, ids, ["digest"], rows.count()).select("conv", "at", "id", "bytes"), "encoded")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, at, id, bytes, len): what each conversation becomes, with its length; at 0 stands
    the root (id 0), so that those without turns are there as well."""
    rows = encoded(turns)
    lengths = stored(rows.groupBy("conv").agg(F.count("*").alias("own")), "lengths")
    base = F.col("conv") - F.col("conv") % BASE
    convs = lengths.select("conv", "own", base.alias("base"), (F.crc32(F.col("conv").cast("string")) % HEAD).alias("head"))
    convs = convs.join(lengths.select(F.col("conv").alias("base"), F.col("own").alias("_of")), "base", "left")
    convs = convs.withColumn("taken", F.least("head", F.coalesce("_of", F.lit(0))))
    convs = stored(convs.select("conv", "base", "head", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("len")), "convs")
    heads = rows.where(F.col("at") < HEAD).withColumnRenamed("conv", "base")
    heads = convs.where("taken > 0").join(heads, "base").where("at <= taken").select("conv", "at", "id", "bytes", "len")
    # A long conversation's turns meet its one row here: Spark splits them.
    tails = rows.join(convs.select("conv", "head", "taken", "len"), "conv").where("at > head").select("conv", (F.col("at") - F.col("head") + F.col("taken")).alias("at"), "id", "bytes", "len")
    roots = convs.select("conv", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("bytes"), "len")
    return roots.unionByName(heads).unionByName(tails)


def digests(ends: DataFrame, n: int) -> DataFrame:
    """(place, ends_sha256) of ``ends`` (place, conv): SHA-256 of the sorted ids. They stream by
    in order; no list of them is held."""
    rows = ends.repartition(max(12, -(-n // 1_000_000)), "place").sortWithinPartitions("place", "conv")

    def go(batches):
        now, sha = None, None
        for b in batches:
            place, conv = b.column("place").to_numpy(), b.column("conv").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else np.zeros(1, np.int64)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                text = ",".join(map(str, conv[lo:hi].tolist())).encode()
                if place[lo] == now:
                    sha.update(b"," + text)
                    continue
                if sha is not None:
                    yield _row(now, sha)
                now, sha = place[lo], hashlib.sha256(text)
        if sha is not None:
            yield _row(now, sha)

    return rows.mapInArrow(go, "place long, ends_sha256 string")


def _row(place, sha) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([sha.hexdigest()])], ["place", "ends_sha256"])


def finished(t: pa.Table) -> pa.Table:
    """The nodes of local buckets, rows (bucket, above, digit, conv, at, id, bytes): a local bucket
    is one ``digit`` of ``bucket``, whose smallest conversation is ``above``. ``top_of`` is a top
    node's ``bucket``, null for those below."""
    t = t.sort_by([(c, "ascending") for c in ("bucket", "digit", "conv", "at")])
    bucket, up, digit, conv, at, ids, size = (t.column(c).to_numpy() for c in ("bucket", "above", "digit", "conv", "at", "id", "bytes"))
    first = _changes(bucket, digit, conv)  # a sequence's first row
    length = np.diff(np.append(first, len(conv)))
    who = conv[first]
    # Open sequences in the order of their groups; each group's parent node; turns done.
    seq, done = np.arange(len(first)), np.zeros(len(first), np.int64)
    group = np.searchsorted(_changes(bucket, digit), first, "right") - 1
    parent = np.full(int(group[-1]) + 1, -1)
    made, ended, nodes = [], [], 0
    while len(seq):
        starts = _changes(group)
        n = np.diff(np.append(starts, len(seq)))
        which = np.repeat(np.arange(len(starts)), n)
        key = ids[first[seq] + done]
        side = np.sign(key - key[starts + n // 2][which])
        order = np.lexsort((seq, side, which))
        seq, side, which, done, above = seq[order], side[order], which[order], done[order], parent[group[order]]
        cuts = _changes(which, side)
        many = np.diff(np.append(cuts, len(seq)))
        part = np.repeat(np.arange(len(cuts)), many)
        equal = side[cuts] == 0
        parent = np.where(equal, nodes + np.cumsum(equal) - 1, above[cuts])
        own = cuts[equal]
        row = first[seq[own]] + done[own]
        made.append((np.minimum.reduceat(who[seq], cuts)[equal], many[equal], above[own], at[row], size[row], bucket[row], up[row]))
        nodes += len(own)
        done = done + equal[part]
        over = equal[part] & (done == length[seq])
        ended.append((parent[part][over], who[seq[over]]))
        seq, group, done = seq[~over], part[~over], done[~over]
    low, n, above, depth, last, bucket, up = (np.concatenate(x) for x in zip(*made))
    tops = above < 0
    children = np.bincount(above[~tops], minlength=nodes)
    leaves, saved = (children == 0).astype(np.int64), (n - 1) * last
    for k in np.flatnonzero(~tops)[::-1]:  # children come after their parents
        leaves[above[k]] += leaves[k]
        saved[above[k]] += saved[k]
    at_node, ends = (np.concatenate(x) for x in zip(*ended))
    order = np.lexsort((ends, at_node))
    at_node, ends = at_node[order], ends[order].tolist()
    sha, cuts = [EMPTY] * nodes, np.append(_changes(at_node), len(at_node))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        sha[at_node[lo]] = hashlib.sha256(",".join(map(str, ends[lo:hi])).encode()).hexdigest()
    columns = [pa.array(bucket, mask=~tops), low, depth, np.where(tops, up, low[np.maximum(above, 0)]), n, children, leaves, saved, pa.array(sha, pa.string())]
    return pa.table(dict(zip(["top_of", *COLUMNS], columns)))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns])))


def _dealt(rows: DataFrame, number: int, local: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round over the open turns ``rows`` (bucket, conv, at, id, bytes, len): the nodes of the
    buckets' chains (bucket, at, n, bytes), the buckets (bucket, low, last, children, singles),
    what ends there (bucket, conv), the new buckets' parents (bucket, child) and their turns."""
    stats = stored(rows.groupBy("bucket", "at").agg(F.count("*").alias("n"), F.min("id").alias("_low"), F.max("id").alias("_high"), F.min("conv").alias("conv"), F.max("bytes").alias("bytes")), "stats")
    sizes = stats.groupBy("bucket").agg(F.max("n").alias("all"), F.min("conv").alias("low"), F.min("at").alias("start"), F.max("at").alias("deepest"))
    stats = stats.join(sizes, "bucket")
    stops = stats.groupBy("bucket", "low", "start", "deepest").agg(F.min(F.when((F.col("n") < F.col("all")) | (F.col("_low") < F.col("_high")), F.col("at"))).alias("stop"))
    stops = stored(stops.select("bucket", "low", "start", F.coalesce(F.col("stop"), F.col("deepest") + 1).alias("stop")), "stops")
    chain = stats.select("bucket", "at", "n", "bytes").join(stops, "bucket").where("at < stop").select("bucket", "at", "n", "bytes", "low", (F.col("at") == F.col("start")).alias("is_first"), (F.col("at") == F.col("stop") - 1).alias("is_last"))
    rows = rows.join(stops.withColumnRenamed("low", "above"), "bucket")
    ends = rows.where("at = stop - 1 and len = at").select("bucket", "conv")
    digits = stored(rows.where("at = stop").select("bucket", "conv", F.col("id").alias("digit"), (F.col("len") - F.col("stop") + 1).alias("turns")), "digits")
    children = digits.groupBy("bucket", "digit").agg(F.count("*").alias("n"), F.sum("turns").alias("turns"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("turns") <= local, "local").otherwise("open")
    children = stored(children.withColumn("kind", kind).withColumn("child", F.monotonically_increasing_id() + F.lit((number + 1) << 50)), "children")
    to = looked_up(digits.select("bucket", "conv", "digit"), children.select("bucket", "digit", "kind", "child"), ["bucket", "digit"], digits.count())
    # A long conversation's turns meet its one row here: Spark splits them.
    below = rows.where("at >= stop").join(to.select("conv", "digit", "kind", "child"), "conv")
    below = stored(below.select("bucket", "above", "digit", "kind", "child", "conv", "at", "id", "bytes", "len", "stop"), "dealt")
    counts = children.groupBy("bucket").agg(F.count("*").alias("children"), F.count_if(F.col("kind") == "single").alias("singles"))
    buckets = stops.join(counts, "bucket", "left").fillna(0, ["children", "singles"]).select("bucket", "low", "children", "singles")
    return chain, buckets, ends, children.where("kind = 'open'").select("bucket", "child"), below


def trie(turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256):
    a row per node."""
    small_batches(turns.sparkSession, 10_000)
    open_ = stored(rebuilt(turns).withColumn("bucket", F.lit(0).cast("long")), "rebuilt")
    root = F.lit(None).cast("long")
    paths = open_.limit(1).select("bucket", F.array("bucket").alias("path"), root.alias("above"))
    chains, buckets, ends, singles, locals_ = [], [], [], [], []
    while not open_.isEmpty():
        chain, own, over, new, below = _dealt(open_, len(chains), local)
        own = stored(own.join(paths, "bucket"), "buckets")
        paths = new.join(own.select("bucket", "path", F.col("low").alias("above")), "bucket").select(F.col("child").alias("bucket"), F.concat("path", F.array("child")).alias("path"), "above")
        chains.append(chain)
        buckets.append(own)
        ends.append(over)
        singles.append(below.where("kind = 'single'"))
        locals_.append(below.where("kind = 'local'"))
        open_ = below.where("kind = 'open'").select(F.col("child").alias("bucket"), "conv", "at", "id", "bytes", "len")
    if not chains:
        return turns.sparkSession.createDataFrame([], MADE).select(COLUMNS)
    chain, buckets, ends, alone, near = (_union(x) for x in (chains, buckets, ends, singles, locals_))
    place = F.pmod(F.xxhash64("bucket", "digit"), F.lit(max(12, -(-near.count() // TASK))))
    near = near.select("bucket", "above", "digit", "conv", "at", "id", "bytes", place.alias("place"))
    near = stored(near.groupBy("place").applyInArrow(finished, MADE), "local-nodes")
    one = F.lit(1).cast("long")
    alone = alone.select(
        F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("stop"), F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"), (F.col("at") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("at") == F.col("len"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    return _chain_nodes(chain, buckets, ends, near).unionByName(near.select(COLUMNS)).unionByName(alone)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def _chain_nodes(chain: DataFrame, buckets: DataFrame, ends: DataFrame, near: DataFrame) -> DataFrame:
    """The nodes of the buckets' chains. A bucket's own share of a sum (its chain, its single and
    local children, itself if it is childless) counts for each bucket of its path."""
    chain = chain.withColumn("own", (F.col("n") - 1) * F.col("bytes"))
    below = near.where("top_of is not null").groupBy(F.col("top_of").alias("bucket")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    shares = buckets.join(below, "bucket", "left").join(chain.groupBy("bucket").agg(F.sum("own").alias("own")), "bucket", "left")
    leaves = F.coalesce("leaves", F.lit(0)) + F.col("singles") + (F.col("children") == 0).cast("long")
    shares = shares.select(F.explode("path").alias("bucket"), leaves.alias("leaves"), (F.coalesce("saved", F.lit(0)) + F.col("own")).alias("saved"))
    totals = shares.groupBy("bucket").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    facts = stored(buckets.select("bucket", "children", F.col("above").alias("_above")).join(totals, "bucket"), "buckets")
    chain = stored(chain.repartitionByRange("bucket", "at").withColumn("_part", F.spark_partition_id()), "chains")
    chain = numbered(chain, ["_part", "at"], "_sofar", ["bucket"], "own").join(facts, "bucket")
    sha = digests(ends.withColumnRenamed("bucket", "place"), ends.count()).withColumnRenamed("place", "bucket").withColumn("is_last", F.lit(True))
    chain = chain.join(sha, ["bucket", "is_last"], "left")
    return chain.select(
        F.col("low").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("is_first"), F.col("_above")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("is_last"), F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", (F.col("saved") - F.col("_sofar")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
