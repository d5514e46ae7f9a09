"""Tables kept between jobs, in the folder all executors share.

A written table survives the loss of executors, keeps column pruning and row-group
statistics for its readers, and gives Spark a true size to plan broadcasts by.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CHECKPOINT_SETTING = "spark.checkpoint.dir"
BROADCAST_BYTES = 128 << 20
#: Stored bytes, and rows, that one job shuffles whole rows of; more are done slice by slice.
SLICE_BYTES, SLICE_ROWS = 512 << 20, 16_000_000
_local_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one in local mode only, where the
    driver and the tasks are one process."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_SETTING, None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    app = sc.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="erario-")
        sc.setCheckpointDir(_local_roots[app])
    return _local_roots[app]


class Store:
    """A folder of Parquet tables; without a root, a fresh one in the shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_dir(spark)}/erario/{uuid.uuid4().hex}").rstrip("/")

    @classmethod
    @contextmanager
    def scratch(cls, spark: SparkSession) -> Iterator[Store]:
        """A fresh store whose tables go when the block ends; nothing outside it is touched."""
        store = cls(spark)
        try:
            yield store
        finally:
            root = spark._jvm.org.apache.hadoop.fs.Path(store.root)
            root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        conf = self.spark._jsc.hadoopConfiguration()
        return hadoop.getFileSystem(conf).exists(hadoop)

    def save(self, df: DataFrame, name: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        """Write and read back.  The schema is given, so partition values keep their type."""
        name = name or f"tmp-{uuid.uuid4().hex}"
        self._writer(df, "overwrite", by).parquet(self.path(name))
        return self._read(df, name, by)

    def save_slices(self, slices: Iterable[DataFrame], name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Write frames of one schema into a table, each before the next is asked for, and read it back.
        What a slice has shuffled is dropped then; the table counts as written with the last one."""
        mode = "overwrite"
        for df in slices:
            writer = self._writer(df, mode, by).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
            writer.parquet(self.path(name))
            release(self.spark)
            mode = "append"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        done.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(done).close()
        return self._read(df, name, by)

    def _writer(self, df: DataFrame, mode: str, by: tuple[str, ...]) -> DataFrameWriter:
        writer = df.write.mode(mode).option("compression", "zstd")
        return writer.partitionBy(*by) if by else writer

    def _read(self, df: DataFrame, name: str, by: tuple[str, ...]) -> DataFrame:
        ordered = [c for c in df.columns if c not in by] + list(by)
        return self.spark.read.schema(df.select(*ordered).schema).parquet(self.path(name))

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def release(spark: SparkSession) -> None:
    """Spark drops the shuffle files of finished jobs when the driver collects its garbage."""
    spark._jvm.System.gc()


def slices_of(stored: int) -> int:
    """How many slices rows read from so many stored bytes are worked on in."""
    return max(1, -(-stored // SLICE_BYTES))


def slice_of(df: DataFrame, key: str, at: int, many: int) -> DataFrame:
    """The rows whose key falls into one of so many slices; rows of one key stay together, nulls too."""
    return df if many == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(many)) == at)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files under a path, without reading them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(where).getLength()


def broadcast_file(df: DataFrame, path: str, bound: int = BROADCAST_BYTES // 8) -> DataFrame:
    """Hint a broadcast of rows derived one for one from a stored file of bounded size
    (compressed columns unfold to several times their size in memory)."""
    return F.broadcast(df) if stored_bytes(df.sparkSession, path) <= bound else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share out a scan that has fewer tasks than there are cores; larger scans stay put."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _row_bytes(df: DataFrame) -> Column:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    row = F.lit(16 * (len(df.columns) + 1)).cast("long")
    for name in texts:
        row = row + F.coalesce(F.octet_length(name), F.lit(0))
    return row


def measured_bytes(tables: dict[str, DataFrame]) -> dict[str, int]:
    """In-memory sizes of stored tables, in one job: text bytes plus a cost per field."""
    parts = [
        t.agg(F.sum(_row_bytes(t)).alias("bytes")).select(F.lit(n).alias("name"), "bytes")
        for n, t in tables.items()
    ]
    rows = reduce(DataFrame.unionByName, parts).collect()  # a row per table
    return {r["name"]: r["bytes"] or 0 for r in rows}


def broadcast_small(
    tables: dict[str, DataFrame], bound: int = BROADCAST_BYTES
) -> dict[str, DataFrame]:
    """Hint a broadcast for the stored tables within the bound.  A larger one is left to a
    shuffled join, whose hot keys adaptive execution splits."""
    sizes = measured_bytes(tables)
    return {n: F.broadcast(t) if sizes[n] <= bound else t for n, t in tables.items()}
