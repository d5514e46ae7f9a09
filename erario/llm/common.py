"""What the operators share: reading tables, and connected components of a link table."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erario.store import Store

#: A word: a run of anything but the space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Bits of a map of key hashes (8 MB).
MAP_BITS = 1 << 26
_shipped: set[str] = set()
#: Rows that go to a Python worker at once.  Texts are long, and both sides hold a batch several
#: times over; Spark's default suits narrow rows.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, which may not share the driver's module path, and
    keep their batches small unless the session says otherwise."""
    sc = spark.sparkContext
    name, default, rows = BATCH
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, rows)
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).resolve().parents[1]
        target = f"{tempfile.mkdtemp(prefix='erario-')}/{package.name}-code"
        sc.addPyFile(shutil.make_archive(target, "zip", package.parent, package.name))


_held: dict[str, dict] = {}


def held(operator: str) -> dict:
    """What a worker process keeps for an operator from task to task.  Workers serve all operators in
    turn, so the tables of any other one are let go first."""
    if operator not in _held:
        _held.clear()
        _held[operator] = {}
        give_back()
    return _held[operator]


def give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task keeps it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(operator: str, run: Callable) -> Callable:
    """The function over batches, in a worker that holds this operator's tables alone and gives back
    its memory after each partition."""

    def clean(batches: Iterable) -> Iterator:
        held(operator)
        yield from run(batches)
        give_back()

    return clean


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def split_by_keys(rows: DataFrame, keys: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows that may match one of the keys in these columns, and those that cannot, so that only
    the former need a shuffle.  The map of the keys' hashes has a fixed size, whatever their number."""
    place = F.pmod(F.xxhash64(*columns), F.lit(MAP_BITS))
    parts = (
        keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__map"))
    )
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("__map"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0, F.lit(False))
    tested = (
        rows.withColumn("__bucket", F.bitmap_bucket_number(place))
        .join(F.broadcast(parts), "__bucket", "left").withColumn("__may", may)
    )
    return tuple(tested.where(c).drop("__bucket", "__map", "__may") for c in ("__may", "not __may"))


#: What tells a document from others: its id, which may be missing or shared, and a hash of its text.
DOC = ("doc_id", "tk")
SAME_DOC = "a.doc_id <=> b.doc_id and a.tk = b.tk"


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents but those given by (doc_id, tk), whether or not they have an id."""
    rows = docs.select("doc_id", text_hash(), F.struct("*").alias("row"))
    maybe, others = split_by_keys(rows, gone, DOC)
    kept = maybe.alias("a").join(gone.alias("b"), F.expr(SAME_DOC), "left_anti").select("row")
    return kept.unionByName(others.select("row")).select("row.*")


def components(links: DataFrame, store: Store) -> DataFrame:
    """(node, component) of every node in the links (a, b): the smallest node it can reach.

    Alternates two rounds of re-linking (large star, small star) until only stars are left, which
    takes a number of rounds in the logarithm of the longest path.  Each round is a written table,
    and the minima are a table of their own, so that adaptive execution can split the join on a
    node with very many links.  Links with a null end or from a node to itself are ignored.
    """
    edges = store.save(_downward(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store.save(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        )
        wide = store.save(_downward(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ))
        least = store.save(wide.groupBy("u").agg(F.min("v").alias("m")))
        edges = store.save(_downward(
            wide.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
        ))
        if (now := _state(edges)) == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return store.save(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots))


def _downward(pairs: DataFrame) -> DataFrame:
    return (
        pairs.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).head())
