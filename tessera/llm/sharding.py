"""Sharding by size-tiered compaction, with versioned manifests.

Arrivals are appended as small immutable Parquet shards. Compaction sorts the shards of the current
manifest into tiers of similar size, cuts each tier into runs of about the target size, and rewrites
every run of several shards as one. A new manifest version is committed by renaming its finished pointer
file to the version's name, which never replaces a file: it succeeds for one writer only, and readers,
who follow the newest pointer, see all of a version or nothing of it. (A store whose rename checks first
and moves then, such as a local disk, leaves an instant in which two writers could both succeed.) Shards
that no longer belong to the version are removed afterwards.

Shard files go to the shared folder under names that no other attempt uses. The manifest's entries are a
table; the driver holds no more than the runs' bounds.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut
from .warc import file_system

ENTRY = "path string, rows long, bytes long, first long, level int"
#: Bytes of text after which an arriving shard is closed, and that a compacted one aims at.
SMALL, TARGET = 4 << 20, 64 << 20
#: Ratio of the sizes of neighbouring tiers.
TIER = 4


def _path(root: str, level: int) -> str:
    t = TaskContext.get()
    return f"{root}/shard-{level}-{t.partitionId():05d}-{t.taskAttemptId()}-{uuid.uuid4().hex[:8]}.parquet"


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "rows", "bytes", "first", "level"])


class _Writer:
    """One shard file while it is being written."""

    def __init__(self, system, root: str, level: int, schema: pa.Schema):
        self.path, self.level = _path(root, level), level
        self.out = system.open_output_stream(self.path)
        self.file = pq.ParquetWriter(self.out, schema, compression="zstd")
        self.rows = self.bytes = 0
        self.first: int | None = None

    def add(self, b: pa.RecordBatch) -> None:
        self.file.write_batch(b)
        self.rows += b.num_rows
        self.bytes += b.nbytes
        low = pa.compute.min(b.column(b.schema.get_field_index("doc_id"))).as_py()
        self.first = low if self.first is None else self.first if low is None else min(low, self.first)

    def close(self) -> tuple:
        self.file.close()
        self.out.close()
        return self.path, self.rows, self.bytes, self.first, self.level


class Shards:
    """A sharded set of documents in ``folder``, a path of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # Manifest.

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        fs, path = self._hadoop("")
        if not fs.exists(path):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return max([int(n[1:9]) for n in names if re.fullmatch(r"v\d{8}\.json", n)], default=0)

    def _pointer(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.folder}/manifest/v{version:08d}.json").first()[0]
        return json.loads(text)

    def entries(self, version: int | None = None) -> DataFrame:
        """The shards of a version: path, rows, bytes, smallest doc_id, level."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(self._pointer(version)["entries"])

    def commit(self, entries: DataFrame, base: int) -> int:
        """Make ``entries`` the version after ``base``; fails if another writer was first."""
        table = f"{self.folder}/manifest/entries-{uuid.uuid4().hex}"
        entries.write.parquet(table)
        fs, draft = self._hadoop(f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": base + 1, "entries": table}).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        once = gateway.new_array(rename, 1)
        once[0] = rename.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(draft, self._hadoop(f"v{base + 1:08d}.json")[1], once)
        return base + 1

    # Writing.

    def append(self, docs: DataFrame, small: int = SMALL) -> int:
        """Write all rows of ``docs`` (with a doc_id) as small shards and commit them beside the present ones."""
        folder, base = self.folder, self.version()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = file_system(folder)
            system.create_dir(root, recursive=True)
            open_: _Writer | None = None
            for b in batches:
                lo = 0
                step = max(1, int(b.num_rows * small / max(1, b.nbytes) / 4))
                while lo < b.num_rows:
                    own = b.slice(lo, step)
                    own = pa.RecordBatch.from_arrays([c.take(pa.array(range(own.num_rows))) for c in own.columns], schema=own.schema)
                    open_ = open_ or _Writer(system, root, 0, own.schema)
                    open_.add(own)
                    lo += step
                    if open_.bytes >= small:
                        yield _entries([open_.close()])
                        open_ = None
            if open_ is not None and open_.rows:
                yield _entries([open_.close()])

        new = cut(docs.mapInArrow(run, ENTRY), "arrivals")
        return self.commit(self.entries(base).union(new), base)

    def compact(self, target: int = TARGET) -> int:
        """Merge shards of similar size into shards of about ``target`` bytes and commit the new version."""
        folder, base = self.folder, self.version()
        now = cut(self.entries(base), "entries")
        tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1))) / F.log(F.lit(float(TIER))))
        # A run's number is the sum of the sizes before, in units of the target. Shards are spread over
        # slices by the hash of their path, so that no window holds all of a tier.
        slices = max(1, int(now.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] // (64 * target)))
        e = now.where(F.col("bytes") < target).withColumn("tier", tier).withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(slices)))
        before = Window.partitionBy("tier", "slice").orderBy(F.col("first").asc_nulls_last(), "path").rowsBetween(Window.unboundedPreceding, -1)
        e = e.withColumn("run", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / target))
        runs = cut(e.groupBy("tier", "slice", "run").agg(F.sort_array(F.collect_list(F.struct("first", "path"))).alias("files"), F.max("level").alias("level")).where(F.size("files") > 1).select("files.path", "level"), "runs")
        many = runs.count()
        if not many:
            return base

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = file_system(folder)
            for b in batches:
                for files, level in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    out: _Writer | None = None
                    for f in files:
                        with system.open_input_file(f) as source:
                            for own in pq.ParquetFile(source).iter_batches(batch_size=1024):
                                out = out or _Writer(system, root, level + 1, own.schema)
                                out.add(own)
                    if out is not None:
                        yield _entries([out.close()])

        merged = cut(runs.repartition(min(many, 20_000), F.xxhash64("path")).mapInArrow(merge, ENTRY), "merged")
        gone = runs.select(F.explode("path").alias("path"))
        return self.commit(now.join(gone, "path", "left_anti").union(merged), base)

    def vacuum(self, version: int) -> int:
        """Remove the shards of ``version`` that the newest one no longer has; returns how many."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, _ = file_system(folder)
            for b in batches:
                for path in b.column(0).to_pylist():
                    try:
                        system.delete_file(path)
                    except FileNotFoundError:  # an earlier attempt of this task was here
                        pass
                yield b

        gone = self.entries(version).join(self.entries(), "path", "left_anti").select("path")
        return gone.mapInArrow(run, "path string").count()

    # Reading.

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version, with shard_path, shard_rows, level and row_in_shard; where the documents
        have a column of such a name, that is kept and the shard's gets underscores at its end."""
        folder = self.folder
        entries = self.entries(version)
        extra = [("shard_path", pa.string()), ("shard_rows", pa.int64()), ("level", pa.int32()), ("row_in_shard", pa.int64())]
        names = list(schema.names)
        for i, (c, kind) in enumerate(extra):
            while c.lower() in {n.lower() for n in names}:
                c += "_"
            extra[i] = (c, kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, _ = file_system(folder)
            for b in batches:
                for path, rows, level in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                    at = 0
                    with system.open_input_file(path) as source:
                        for own in pq.ParquetFile(source).iter_batches(batch_size=1024, columns=names):
                            n = own.num_rows
                            more = [pa.array([path] * n), pa.array([rows] * n, pa.int64()), pa.array([level] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
                            yield pa.RecordBatch.from_arrays([own.column(c) for c in names] + more, names=names + [c for c, _ in extra])
                            at += n

        from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

        kinds = [StringType(), LongType(), IntegerType(), LongType()]
        out = StructType([*schema.fields, *[StructField(c, kind) for (c, _), kind in zip(extra, kinds, strict=True)]])
        many = max(1, min(20_000, entries.count()))
        return entries.select("path", "rows", "level").repartition(many, "path").mapInArrow(run, out)
