"""WARC archives of captured pages, and a merged index of their capture histories.

Records are Spark strings, and archives are what Spark's text writer makes of them with
the record end as line separator: commits, retries and any file system are Spark's. Of
records with equal payloads of ``least`` bytes or more, the smallest page_id is a response
and the others revisit it; payloads that many pages share meet it by broadcast, so that no task
gets all pages of one. Reading goes the other way: whole archives as binary files,
parsed by the lengths that the records state.

The index is an external merge. Each archive's captures, sorted by URL key, time and
page_id, are a run; runs are cut at common splitters (from a sample of 8 keys a range, and 20,000), and
each range merges its k slices with a tree of losers. Ranges in order hold all captures in
order. A URL key with many captures is cut inside its history, as splitters are whole keys.

Defined cases: a null html is an empty payload; a null url has an empty URL key and no
target header; control characters in a url are percent-encoded; repeated rows are records
of their own, equal page_ids are all responses; a null page_id is written without its
header, and never the response that others revisit if a page_id is there; no pages give
empty archives. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.llm.common import looked_up, new_path, stored

END = "\r\n\r\n"
LEAST = 100
#: Bytes of payload in an archive, captures in a merged range, keys looked at for splitters.
ARCHIVE_BYTES = 24 << 20
RANGE_ROWS = 200_000
SPLITTER_SAMPLE = 20_000
CAPTURE = "urlkey string, time string, page_id long, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in CAPTURE.split(", "))])


def with_records(pages: DataFrame, least: int = LEAST, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """(record, bytes): a WARC record per page. Pages without a column ``captured``
    (timestamp) get one second each after ``start``, by page_id."""
    html = F.coalesce("html", F.lit(""))
    when = F.col("captured") if "captured" in pages.columns else F.timestamp_add("SECOND", F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0)).cast("int"), F.lit(start).cast("timestamp"))
    p = pages.select("page_id", "url", html.alias("html"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    p = p.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    firsts = p.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select(F.col("digest").alias("_d"), "keeper")
    p = p.withColumn("_d", F.when(F.col("size") >= least, F.col("digest")))
    p = looked_up(p, firsts, ["_d"], pages.count(), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def urn(x: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))

    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    p = p.withColumn("block", block)
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:sha256:"), F.col("digest"), F.lit(">")))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("WARC-Page-ID", F.col("page_id").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("keeper"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    return p.select(record.alias("record"), F.when(revisit, 300).otherwise(F.col("size") + 500).alias("bytes"))


def write(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES, **named) -> str:
    """Write gzip archives of about ``archive_bytes`` into the folder ``path``; its name."""
    path = path or new_path(pages.sparkSession, "warc")
    # The join has dealt the pages already; files are bounded by rows of the mean size.
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + 500)).first()[0] or 1
    records = with_records(pages, **named).select("record")
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(archive_bytes / mean))).text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        head_end = data.index(END.encode(), at)
        lines = data[at:head_end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        body = head_end + 4
        end = body + int(headers["Content-Length"])
        if data[end : end + 4] != END.encode():
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, end + 4 - at, headers, data[body:end]
        at = end + 4


def urlkey(url: str) -> str:
    """A sort key of a URL: host labels from the right, then the path and query, lower-cased,
    without scheme, www, default port and fragment."""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) if host else ""
    if port and port not in (80, 443):
        key += f":{port}"
    return f"{key}){(u.path or '/').lower()}{'?' + u.query.lower() if u.query else ''}"


def captures_of(data: bytes, file: str) -> list[dict]:
    """An archive's captures, checked against their digests and sorted: a run."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    rows = []
    for offset, length, h, block in parse(data):
        size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:")
        if h["WARC-Type"] == "response":
            payload = block[block.index(END.encode()) + 4 :]
            size, found = len(payload), hashlib.sha256(payload).hexdigest()
            if found != digest:
                raise ValueError(f"{file}: the payload at byte {offset} does not have its digest")
        page, to = h.get("WARC-Page-ID"), h.get("WARC-Refers-To")
        rows.append({"urlkey": urlkey(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else "", "time": re.sub(r"\D", "", h["WARC-Date"]), "page_id": page and int(page), "file": file, "offset": offset, "length": length, "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": to and int(to[10:-1])})
    return sorted(rows, key=sort_key)


def sort_key(r: dict) -> tuple:
    return r["urlkey"], r["time"], r["page_id"] is None, r["page_id"] or 0, r["file"], r["offset"]


def merge(runs: list[list[dict]]) -> Iterator[dict]:
    """k-way merge with a tree of losers: inner node i keeps the loser of the match played
    there, so that a new head is played against one run per level only."""
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    last = (1,)

    def head(i: int) -> tuple:
        return (0, sort_key(runs[i][at[i]]), i) if i < len(runs) and at[i] < len(runs[i]) else last + ((), i)

    keys = [head(i) for i in range(k)]
    losers = [0] * k
    won = [0] * k + list(range(k))
    for n in range(k - 1, 0, -1):
        a, b = won[2 * n], won[2 * n + 1]
        won[n], losers[n] = (a, b) if keys[a] <= keys[b] else (b, a)
    best = won[1] if k > 1 else 0
    while keys[best][0] == 0:
        yield runs[best][at[best]]
        at[best] += 1
        keys[best] = head(best)
        n = (best + k) // 2
        while n:
            if keys[losers[n]] < keys[best]:
                best, losers[n] = losers[n], best
            n //= 2


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives in ``path``; those of a file lie together, sorted."""

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content")):
                if data.as_py():
                    yield pa.RecordBatch.from_pylist(captures_of(data.as_py(), file.rpartition("/")[2]), _SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    # One archive in an Arrow batch at a time is all that a task holds.
    return files.select("path", "content").repartition(files.rdd.getNumPartitions()).mapInArrow(go, CAPTURE)


def index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``captures`` with range_no and place: their order in the merged index."""
    n = captures.count()
    ranges = max(1, -(-n // range_rows))
    key = ["urlkey", "time", "page_id", "file", "offset"]
    sample = captures.select(*key).orderBy(F.xxhash64(*key)).limit(max(SPLITTER_SAMPLE, 8 * ranges)).collect() if ranges > 1 else []
    keys = sorted(sort_key(r.asDict()) for r in sample)
    splitters = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []

    def cut(run: pa.Table) -> pa.Table:
        rows = sorted(run.to_pylist(), key=sort_key)
        slices: dict[int, list] = {}
        for r in rows:
            slices.setdefault(bisect_right(splitters, sort_key(r)), []).append(r)
        return pa.table({"range_no": pa.array(list(slices), pa.int64()), "run": pa.array(list(slices.values()), pa.list_(pa.struct(list(_SCHEMA))))})

    def merged(part: pa.Table) -> pa.Table:
        rows = list(merge(part.column("run").to_pylist()))
        t = pa.Table.from_pylist(rows, _SCHEMA)
        no = part.column("range_no")[0].as_py()
        return t.append_column("range_no", pa.array([no] * len(rows), pa.int64())).append_column("place", pa.array(range(len(rows)), pa.int64()))

    kind = ", ".join(f"{a}: {b}" for a, b in (x.split() for x in CAPTURE.split(", ")))
    runs = captures.groupBy("file").applyInArrow(cut, f"range_no long, run array<struct<{kind}>>")
    return runs.groupBy("range_no").applyInArrow(merged, f"{CAPTURE}, range_no long, place long")


def archived(pages: DataFrame, path: str | None = None, **named) -> DataFrame:
    """Write ``pages`` to archives, read them back and return their merged index."""
    path = write(pages, path, **named)
    return index(stored(read_runs(pages.sparkSession, path), "captures"))
