"""Helpers of the operators in this subpackage: scratch tables and linked groups."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a scratch table is written, the shuffle files of its query go once it has ended, Python gets small batches, and
#: tasks are of a size that makes files of some MB.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m", "spark.sql.files.maxPartitionBytes": "32m",
}
#: On a mounted folder neither checksum files nor marks of success, each of which costs a process to set its rights.
WRITE = {
    "compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
}


def parts(batch, column: int, rows: int, size: int = 1 << 20):
    """Slices of an Arrow batch of at most so many rows and, unless it is one row, about so many bytes in a column of text or bytes."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Return to the system what this process has freed."""
    import pyarrow as pa

    gc.collect()  # also empties Python's free lists, single objects of which hold whole arenas
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run):
    """run, a function of batches, that gives its memory back at its end: idle Python workers live on beside stages that need none."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


class Scratch:
    """Tables written to the folder that all executors share, to cut lineage.

    The folder is spark.checkpoint.dir; where that is unset, one under the warehouse
    is taken in local mode (tests), and on a cluster it is an error, as executors
    would each write to a disk of their own.  A lost executor costs nothing: the
    files are not its own.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        self.folder = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
        self.made = 0
        if _open:
            _open[-1].append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and read it again; the shuffle files behind it go as soon as it is written."""
        self.made += 1
        path = f"{self.folder}/{self.made}"
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in SETTINGS}
        for k, v in SETTINGS.items():
            conf.set(k, v)
        try:
            df.write.options(**WRITE).parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)

    def remove(self) -> None:
        """Delete all tables; what was made from them must have been written."""
        self._delete(self.folder)


_open: list[list[Scratch]] = []


@contextmanager
def cleaned():
    """At the end, remove the scratch tables of all operators called inside; their results must have been written by then."""
    _open.append([])
    try:
        yield
    finally:
        for scratch in _open.pop():
            scratch.remove()


#: Edges (of 16 bytes) that one task may hold.
FEW = 500_000


def _united(batches):
    """(id, component_id) of the edges (u, v) of all batches, by union-find."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(find, ids)), pa.int64())], names=["id", "component_id"])


def linked_groups(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for every id in edges; component_id is the smallest id it reaches.

    Alternates the large-star and small-star steps: every node is tied to the
    smallest neighbour, larger neighbours first, until the edges no longer change.
    Each step is one aggregation with map-side combining and one equi-join whose
    large partitions AQE may split, so a hub with a third of all edges is not one
    task.  Self-links and repeated edges are harmless; no edges give no rows.  Up to
    FEW edges are united by one task at once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, seen = scratch.keep(e), None
    if now.count() <= FEW:
        return scratch.keep(now.repartition(1).mapInArrow(_united, "id long, component_id long"))
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(now, large)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    up = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return up.union(up.select(F.col("component_id").alias("id"), "component_id").distinct())
