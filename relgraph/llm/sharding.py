"""Sharding: a table of immutable files under a versioned manifest, compacted by size tiers.

Arrivals are appended as they come, each task writing small files of its own and shuffling
nothing. Compaction groups files of similar size (a tier spans a factor of ``spread``) up to
the target size and rewrites each group as one file, until no tier holds ``fan_in`` files.
A version is a small file that names a folder of manifest rows, written before. The file is
made by exclusive creation, which fails if someone else made that version: of two writers one
commits and the other raises ``Conflict``; readers only see whole versions. Files of older
versions stay until ``vacuum``. The driver holds a version's paths, as Spark's own file
listing does.

Defined cases: an empty table has a version without files; null ids, null or huge texts and
repeated rows are rows like any other (a row larger than the target makes a larger file);
all columns are kept, except one named ``shard``, which the reader adds.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relgraph.llm.common import new_path, numbered, stored

TARGET = 16 << 20
ARRIVAL_ROWS = 1_000
FAN_IN = 4
SPREAD = 4
#: Files that one compaction pass looks up by name in every task.
PER_PASS = 50_000
MANIFEST = "path string, bytes long, rows long, level int"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass
class Shards:
    spark: SparkSession
    root: str

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        fs, p = self._path(f"{self.root}/manifest")
        if not fs.exists(p):
            return 0
        names = (s.getPath().getName() for s in fs.listStatus(p) if s.isFile())
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, rows, level) of a version's files."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        folder = self.spark.read.text(f"{self.root}/manifest/v{version:09d}").first().value
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{folder}")

    def commit(self, rows: DataFrame, base: int) -> int:
        """Make ``rows`` version base + 1, or raise Conflict."""
        folder = f"rows-{uuid.uuid4().hex}"
        rows.select("path", "bytes", "rows", "level").coalesce(max(1, rows.rdd.getNumPartitions() // 8)).write.parquet(f"{self.root}/manifest/{folder}")
        if not self._created(f"{self.root}/manifest/v{base + 1:09d}", folder):
            raise Conflict(f"version {base + 1} of {self.root} exists")
        return base + 1

    def _created(self, path: str, text: str) -> bool:
        """Whether the file ``path`` was not there and now is, with ``text``, at once."""
        fs, p = self._path(path)
        if fs.getScheme() == "file":  # its create() looks first and makes then: a link does both
            to = p.toUri().getPath()
            aside = f"{to}-{uuid.uuid4().hex}"
            with open(aside, "w") as f:
                f.write(text)
            try:
                os.link(aside, to)
                return True
            except FileExistsError:
                return False
            finally:
                with contextlib.suppress(OSError):
                    os.unlink(aside)
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _listed(self, path: str, level: int) -> DataFrame:
        """Manifest rows of the files just written; no column of theirs is read."""
        fs, p = self._path(path)
        if not any(s.getPath().getName().endswith(".parquet") or s.isDirectory() for s in fs.listStatus(p)):
            return self.spark.createDataFrame([], MANIFEST)
        files = self.spark.read.option("recursiveFileLookup", "true").parquet(path)
        return files.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows")).withColumn("level", F.lit(level))

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Add ``rows`` as small files; the new version's number."""
        base = self.version()
        path = f"{self.root}/data/a{base + 1:09d}-{new_path(self.spark, '').split('llm-')[1].strip('/')}"
        rows.drop("shard").write.option("maxRecordsPerFile", arrival_rows).option("compression", "zstd").parquet(path)
        old = self.manifest(base)
        return self.commit(old.unionByName(self._listed(path, 0)), base)

    def plan(self, target: int, fan_in: int, spread: int) -> DataFrame:
        """(path, merge) of the files to rewrite together, ``PER_PASS`` of them at most. Files
        of at least half the target are finished; the others meet those of their tier, in
        order of size."""
        m = self.manifest().where(F.col("bytes") * 2 < target)
        tier = F.floor(F.log(F.col("bytes").cast("double") + 1) / F.log(F.lit(float(spread))))
        m = m.select("path", "bytes", tier.alias("tier"))
        m = m.join(F.broadcast(m.groupBy("tier").count().where(F.col("count") >= fan_in).select("tier")), "tier")  # a few tiers
        order = ["tier", "bytes", "path"]
        m = stored(m.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "tiers")
        runs = numbered(m, ["_part", "bytes", "path"], "upto", ["tier"], "bytes")
        runs = runs.withColumn("merge", F.concat_ws("-", "tier", F.floor(F.col("upto") / target).cast("string")))
        many = runs.groupBy("merge").count().where("count > 1").select("merge")
        return runs.join(many, "merge").select("path", "merge").orderBy("merge", "path").limit(PER_PASS)

    def compact(self, target: int = TARGET, fan_in: int = FAN_IN, spread: int = SPREAD) -> int:
        """Merge until no tier has ``fan_in`` unfinished files; the newest version's number."""
        while True:
            base = self.version()
            todo = self.plan(target, fan_in, spread).collect()  # at most PER_PASS short rows
            if not todo:
                return base
            paths = [r.path for r in todo]
            names = {m: k for k, m in enumerate(sorted({r.merge for r in todo}))}
            merge = self.spark.createDataFrame([(r.path, names[r.merge]) for r in todo], "_path string, _merge int")
            rows = self.spark.read.parquet(*paths).withColumn("_path", F.col("_metadata.file_path"))
            rows = rows.join(F.broadcast(merge), "_path").drop("_path")
            path = f"{self.root}/data/c{base + 1:09d}-{new_path(self.spark, '').split('llm-')[1].strip('/')}"
            rows.repartitionByRange(len(names), "_merge").write.option("compression", "zstd").partitionBy("_merge").parquet(path)
            rest = self.manifest(base).join(F.broadcast(merge.select(F.col("_path").alias("path"))), "path", "left_anti")
            self.commit(rest.unionByName(self._listed(path, 1)), base)

    def vacuum(self) -> None:
        """Delete files that the newest version does not name (older versions end)."""
        live = {r.path.rpartition("/data/")[2].split("/")[0] for r in self.manifest().select("path").distinct().collect()}
        fs, data = self._path(f"{self.root}/data")
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in live:
                fs.delete(s.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``shard``: their file's number in order of path."""
        m = self.manifest(version)
        files = [r.path for r in m.select("path").orderBy("path").collect()]
        if not files:
            raise ValueError("the version has no files")
        numbers = self.spark.createDataFrame([(p, k) for k, p in enumerate(files)], "_path string, shard long")
        rows = self.spark.read.parquet(*files).withColumn("_path", F.col("_metadata.file_path"))
        return rows.join(F.broadcast(numbers) if len(files) <= PER_PASS else numbers, "_path").drop("_path")


def shard(docs: DataFrame, root: str | None = None, target: int = TARGET, arrival_rows: int = ARRIVAL_ROWS) -> DataFrame:
    """Append ``docs`` to the table in ``root`` (a new one in the shared folder if None),
    compact it, and return its rows with ``shard``."""
    spark = docs.sparkSession
    table = Shards(spark, root or new_path(spark, "shards"))
    table.append(docs, arrival_rows)
    table.compact(target)
    if table.manifest().isEmpty():
        return docs.limit(0).drop("shard").withColumn("shard", F.lit(None).cast("long"))
    return table.read()
