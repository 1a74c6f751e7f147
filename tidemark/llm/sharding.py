"""Sharding by size-tiered compaction, in DataFrame operations only.

``append`` writes arrivals as small immutable shards, as they come, without a
shuffle. ``compact`` puts files of similar size (a factor of four) into a tier.
A tier of ``min_runs`` files or more is packed, in order of names, into files of
``target_bytes``; only the files packed are read and rewritten, at most
``PLAN_FILES`` of them for one commit, and commits follow until no tier is ripe.
Sizes are those of the files on disk, known from the listing, so payload is
never read to plan.

Every change commits a manifest: a Parquet folder with a row per live file,
written aside under a name of its own and renamed to its version number. That
rename never replaces or enters a folder there is, so of writers that want the
same number one wins and the others get ``VersionTaken``; a commit happens whole
or not at all, and readers open the highest version. The rename is atomic where
the file system's is (HDFS, local disks); a store without an atomic rename needs
one that has it for the manifest. Files of a manifest are never changed.
``expire`` removes what no manifest of the last ``older_than`` seconds named,
and of folders that no manifest names only those older than that: an append that
has written but not committed yet, and readers of recent versions, lose nothing.

Defined cases: null and empty texts are kept as they are; a row longer than the
target makes a file of its own size; an empty table commits a manifest without
files; rows equal in all columns are all kept; any columns pass through,
whatever their names.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Files that one commit of a compaction packs, at most: their names go by way of the driver.
PLAN_FILES = 10_000
#: Tiers are powers of this.
TIER = 4.0
WEEK = 7 * 86400.0
_FOLDER = r"/data/(\w+)/[^/]*$"


class VersionTaken(RuntimeError):
    """Another writer has committed this version; the change can be made again on top of it."""


class ShardStore:
    """A folder of immutable shards and the versions of its manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> dict[int, float]:
        """When each version there is was committed, in seconds."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return {}
        found = [(f.getPath().getName(), f.getModificationTime() / 1000) for f in self._fs.listStatus(folder)]
        return {int(n[1:]): t for n, t in found if n.startswith("v") and n[1:].isdigit()}

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """A row for each live file: file, rows, bytes, tier."""
        v = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.root}/manifest/v{v}")

    def _commit(self, files: DataFrame, version: int) -> int:
        aside = f"{self.root}/manifest/_writing-{uuid.uuid4().hex}"
        files.coalesce(1).write.parquet(aside)
        sc = self.spark.sparkContext
        fs = sc._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        never_replace = sc._gateway.new_array(fs.Options.Rename, 0)
        try:
            context.rename(self._path(aside), self._path(f"{self.root}/manifest/v{version}"), never_replace)
        except Py4JJavaError as e:
            self._fs.delete(self._path(aside), True)
            raise VersionTaken(f"version {version} has been committed by another writer") from e
        return version

    def _listed(self, folder: str, schema: StructType) -> DataFrame:
        """What a folder of new files holds: a row for each file. No column is read."""
        rows = self.spark.read.schema(schema).parquet(folder)
        of = rows.metadataColumn("_metadata")
        return (
            rows.groupBy(of["file_path"].alias("file"), of["file_size"].alias("bytes")).agg(F.count("*").alias("rows"))
            .select("file", "rows", "bytes", F.floor(F.log(TIER, F.greatest("bytes", F.lit(1)))).cast("int").alias("tier"))
        )

    def append(self, arrivals: DataFrame, max_rows: int = 512) -> int:
        """Writes arrivals as small shards and commits them beside the files there are."""
        v = self.version()
        folder = f"{self.root}/data/a{v + 1}_{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", max_rows).option("compression", "zstd").parquet(folder)
        new = self._listed(folder, arrivals.schema)
        return self._commit(self.manifest(v).unionByName(new) if v else new, v + 1)

    def plan(self, target_bytes: int, min_runs: int = 4, version: int | None = None) -> DataFrame:
        """(file, tier, merged): runs of a tier in order of their names, cut where the target is reached.

        Files of the target size or more are left alone, and so is a file that would be merged with none. The windows run over a row per file, tier by tier.
        """
        tier = Window.partitionBy("tier")
        run = tier.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)
        return (
            self.manifest(version).where(F.col("bytes") < target_bytes)
            .withColumn("runs", F.count("*").over(tier)).where(F.col("runs") >= min_runs)
            .withColumn("upto", F.sum("bytes").over(run))
            .withColumn("merged", F.floor((F.col("upto") - F.col("bytes")) / F.lit(target_bytes)).cast("long"))
            .withColumn("together", F.count("*").over(Window.partitionBy("tier", "merged"))).where("together > 1")
            .select("file", "tier", "merged")
        )

    def compact(self, schema: StructType, target_bytes: int, min_runs: int = 4) -> int:
        """Merges files of ripe tiers, commit by commit, until there is nothing to merge."""
        while True:
            v = self.version()
            some = self.plan(target_bytes, min_runs, v).orderBy("tier", "merged", "file").limit(PLAN_FILES)
            target = some.select("file", (F.dense_rank().over(Window.orderBy("tier", "merged")) - 1).alias("target"))  # PLAN_FILES rows at most
            plan = target.collect()
            if not plan:
                return v
            rows = self.spark.read.schema(schema).parquet(*[r.file for r in plan])
            whole = F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("row")
            rows = rows.select(whole, rows.metadataColumn("_metadata")["file_path"].alias("file")).join(F.broadcast(target), "file")
            folder = f"{self.root}/data/c{v + 1}_{uuid.uuid4().hex}"
            # a task for each merged file
            rows.repartitionById(1 + max(r.target for r in plan), F.col("target")).select("row.*").write.option("compression", "zstd").parquet(folder)
            left = self.manifest(v).join(F.broadcast(target.select("file")), "file", "left_anti")
            self._commit(left.unionByName(self._listed(folder, schema)), v + 1)

    def expire(self, older_than: float = WEEK) -> None:
        """Removes manifests that were superseded more than older_than seconds ago, and data of that age which none of the others names."""
        limit, versions = time.time() - older_than, self._versions()
        kept = [v for v in versions if versions.get(v + 1, limit) >= limit]
        if not kept:
            return
        named = self.spark.read.parquet(*[f"{self.root}/manifest/v{v}" for v in kept])
        live = {r.folder for r in named.select(F.regexp_extract("file", _FOLDER, 1).alias("folder")).distinct().collect()}  # a row for each commit
        for v in set(versions) - set(kept):
            self._fs.delete(self._path(f"{self.root}/manifest/v{v}"), True)
        for f in self._fs.listStatus(self._path(f"{self.root}/data")):
            if f.getPath().getName() not in live and f.getModificationTime() / 1000 < limit:
                self._fs.delete(f.getPath(), True)

    def read(self, schema: StructType, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless told: whole folders where all their files are live, else file by file."""
        folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("folder")
        of = {r.folder: r.n for r in self.manifest(version).groupBy(folder).agg(F.count("*").alias("n")).collect()}  # a row for each commit
        whole = [f for f, n in of.items() if n == sum(x.getPath().getName().endswith(".parquet") for x in self._fs.listStatus(self._path(f)))]
        single = [r.file for r in self.manifest(version).where(~folder.isin(whole)).select("file").collect()] if len(whole) < len(of) else []
        if not whole and not single:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*whole, *single)
