"""Operator 6: size-tiered compaction of immutable shards under a versioned manifest.

``append`` writes an arrival as a run of small Parquet shards. ``compact`` sorts the live shards
below half of the target size into tiers by the logarithm of their bytes; a tier of at least
``fanout`` shards is merged: Spark's scan packs its files into splits of the target size, and
each split is written as one file, so nothing is shuffled. Merged shards meet others of their
size in the next round, until no tier is full.

A version of the manifest is a folder of its own with one row a live shard (file, rows, bytes,
tier, run). It is written aside and renamed into place; the rename fails if that version exists,
so two writers cannot commit the same one, and readers see whole versions only. (The file
system's rename has to be atomic, as on HDFS.) Files of older versions stay until ``vacuum``.

All work on rows is in Spark's own operators; the driver handles names and sizes of files, which
it needs for planning a scan anyway. Rows pass unchanged, with nulls, repeats and any columns.
An empty arrival commits a version without new shards; an empty store reads as no rows. ``append_each``
writes several arrivals in one pass over their rows, and commits each. A merge that another
writer's version overtakes is committed on top of it, if that version still holds all of its files.
``vacuum`` leaves what is younger than a day, as a writer may be about to commit or to build on it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "file string, rows bigint, bytes bigint, tier int, run string"
TARGET_BYTES, LEAST_BYTES, FANOUT = 64 << 20, 1 << 20, 4


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, least_bytes: int = LEAST_BYTES, fanout: int = FANOUT):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.least_bytes, self.fanout = target_bytes, least_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # files

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _rename(self, source: str, target: str) -> None:
        """Fails if the target exists."""
        mode = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        modes = self.spark.sparkContext._gateway.new_array(mode, 1)
        modes[0] = mode.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        context.rename(self._path(source), self._path(target), modes)

    # manifest

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        folder, fs = self._path("manifest"), self._fs()
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[1:]) for n in names if n[:1] == "v"), default=0)

    def entries(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/manifest/v{version:08d}")

    def _commit(self, base: int, entries: DataFrame) -> int:
        aside = f"aside/{uuid.uuid4().hex}"
        entries.coalesce(1).write.parquet(f"{self.path}/{aside}")
        self._fs().mkdirs(self._path("manifest"))
        try:
            self._rename(aside, f"manifest/v{base + 1:08d}")
        except Exception as error:
            self._fs().delete(self._path(aside), True)
            if "AlreadyExists" in str(error):
                raise ConcurrentCommit(f"version {base + 1} exists") from None
            raise
        return base + 1

    def _described(self, run: str, part: str = "") -> DataFrame:
        """``ENTRY`` of the shards of a run (or of a folder in it), from the files' own footers."""
        shards = self.spark.read.parquet(f"{self.path}/data/{run}{part}")
        about = shards.metadataColumn("_metadata")
        sized = shards.select(about["file_path"].alias("file"), about["file_size"].alias("bytes")).groupBy("file").agg(F.count("*").alias("rows"), F.max("bytes").alias("bytes"))
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / self.least_bytes) / F.log(F.lit(float(self.fanout))))).cast("int")
        return sized.select("file", "rows", "bytes", tier.alias("tier"), F.lit(run).alias("run"))

    # operations

    def _checked(self, df: DataFrame) -> None:
        if not self._fs().exists(self._path("schema/_SUCCESS")):
            df.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")
        known = self.spark.read.parquet(f"{self.path}/schema").schema
        if [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("the arrival's columns differ from the store's")

    def _added(self, entries: DataFrame, tries: int) -> int:
        for _ in range(tries):
            base = self.version()
            try:
                return self._commit(base, self.entries(base).unionByName(entries))
            except ConcurrentCommit:
                continue
        raise ConcurrentCommit("other writers were always first")

    def append(self, df: DataFrame, tries: int = 10) -> int:
        """Write an arrival as a run of shards and commit it; returns the version."""
        self._checked(df)
        run = f"arrival-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/data/{run}")
        return self._added(self._described(run), tries)

    def append_each(self, df: DataFrame, arrival: Column, tries: int = 10) -> int:
        """Write the arrivals that ``arrival`` tells apart in one pass, and commit them in its order."""
        self._checked(df)
        run, name = f"arrival-{uuid.uuid4().hex}", "arrival_no"
        while name in df.columns:
            name += "_"
        df.withColumn(name, arrival).write.partitionBy(name).option("compression", "zstd").parquet(f"{self.path}/data/{run}")
        found = [s.getPath().getName() for s in self._fs().listStatus(self._path(f"data/{run}")) if s.isDirectory()]
        for part in sorted(found, key=lambda p: (len(p), p)):
            self._added(self._described(run, f"/{part}"), tries)
        return self.version()

    def read(self, version: int | None = None) -> DataFrame:
        files = [r.file for r in self.entries(version).select("file").collect()]
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    def _merge(self, files: list[str]) -> str:
        """One run that holds the rows of the files, in files of the target size."""
        packing = self.spark.newSession()
        packing.conf.set("spark.sql.files.maxPartitionBytes", str(self.target_bytes))
        packing.conf.set("spark.sql.files.openCostInBytes", "0")
        packing.conf.set("spark.sql.files.minPartitionNum", "1")
        run = f"merged-{uuid.uuid4().hex}"
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        packing.read.schema(schema).parquet(*files).write.option("compression", "zstd").parquet(f"{self.path}/data/{run}")
        return run

    def compact(self, tries: int = 10) -> int:
        """Merge full tiers until there is none; each merge is a version. Returns the latest.

        A tier whose merge would not lessen its files is left until it has others, and larger ones go on.
        """
        idle: dict[int, set[str]] = {}
        while True:
            base = self.version()
            small = self.entries(base).filter(F.col("bytes") < self.target_bytes / 2)
            tiers = small.groupBy("tier").agg(F.collect_list("file").alias("files")).filter(F.size("files") >= self.fanout).orderBy("tier").collect()
            full = next((r for r in tiers if set(r.files) != idle.get(r.tier)), None)
            if full is None:
                return base
            files = full.files
            run = self._merge(files)
            merged = self._described(run)
            if merged.count() >= len(files):  # already as large as splits get
                self._fs().delete(self._path(f"data/{run}"), True)
                idle[full.tier] = set(files)
            elif not self._replaced(files, merged, base, tries):
                self._fs().delete(self._path(f"data/{run}"), True)

    def _replaced(self, files: list[str], merged: DataFrame, base: int, tries: int) -> bool:
        """Commits a merge; False if another writer has taken one of its files out."""
        gone = self.spark.createDataFrame([(f,) for f in files], "file string")
        for _ in range(tries):
            live = self.entries(base)
            if live.join(gone, "file", "left_semi").count() < len(files):
                return False
            try:
                self._commit(base, live.join(gone, "file", "left_anti").unionByName(merged))
            except ConcurrentCommit:
                base = self.version()
            else:
                return True
        raise ConcurrentCommit("other writers were always first")

    def vacuum(self, older_than_seconds: float = 86_400) -> None:
        """Delete older versions, and runs that the latest one does not use, if they are of that age."""
        fs, latest = self._fs(), self.version()
        live = {r.run for r in self.entries(latest).select("run").distinct().collect()}
        before = (time.time() - older_than_seconds) * 1000
        for status in fs.listStatus(self._path("data")):
            # a run that is partly live keeps its other files
            if status.getPath().getName() not in live and status.getModificationTime() <= before:
                fs.delete(status.getPath(), True)
        for status in fs.listStatus(self._path("manifest")):
            if status.getPath().getName() != f"v{latest:08d}" and status.getModificationTime() <= before:
                fs.delete(status.getPath(), True)
