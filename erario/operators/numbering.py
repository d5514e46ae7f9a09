"""Dense numbering, running totals and exact selection without a single-task window.

Rows are range-partitioned, so a partition's position in the global order is known from
one small total per partition.  Only those totals (a row per partition) meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erario.store import Store

_PART, _POS = "__part", "__pos"
_LOCAL_BITS = (1 << 33) - 1


def _ordered(columns: Sequence[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in columns]


def _preceding(sums: DataFrame, names: Sequence[str]) -> DataFrame:
    """Totals of all earlier partitions.  One row per partition of a range exchange, so
    both this window and the broadcast are bounded by the number of shuffle partitions."""
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(
        sums.select(
            _PART,
            *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__before_{n}") for n in names],
        )
    )


def number_rows(
    df: DataFrame, order: Sequence[str | Column], name: str, store: Store, start: int = 0
) -> DataFrame:
    """Add a dense 1…N number in the given total order, as the first column; with a start, from there on."""
    keys = _ordered(order)
    staged = store.save(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(
            "*",
            F.spark_partition_id().alias(_PART),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS)).alias(_POS),
        )
    )
    before = _preceding(staged.groupBy(_PART).agg(F.count("*").alias("n")), ["n"])
    number = (F.col("__before_n") + F.col(_POS) + (1 + start)).cast("long").alias(name)
    return staged.join(before, _PART).select(number, *df.columns)


def numbered_slices(
    df: DataFrame, order: Sequence[str], name: str, slice_rows: int
) -> Iterator[DataFrame]:
    """The same in slices of about so many rows, in order, so that only one is shuffled and staged at a
    time: a slice's stage goes when the next is asked for.

    Slices end between two values of the first two order columns, whose counts are collected; they
    should have few values, as the keys of small dimensions have."""
    spark, first = df.sparkSession, list(order[:2])
    counts = df.groupBy(*first).agg(F.count("*").alias("n")).orderBy(*_ordered(first)).collect()
    slices: list[list] = []
    size = 0
    for r in counts:
        if not slices or size + r["n"] > slice_rows:
            slices.append([])
            size = 0
        slices[-1].append(r)
        size += r["n"]
    start = 0
    for rows in slices or [[]]:
        part = df
        if len(slices) > 1:
            kinds = [f"`__{c}` {df.schema[c].dataType.simpleString()}" for c in first]
            held = spark.createDataFrame([tuple(r[c] for c in first) for r in rows], ", ".join(kinds))
            match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in first]
            part = df.join(F.broadcast(held), reduce(Column.__and__, match), "left_semi")  # a row a pair of keys
        with Store.scratch(spark) as scratch:
            yield number_rows(part, order, name, scratch, start)
        start += sum(r["n"] for r in rows)


def running_totals(
    df: DataFrame, order: Sequence[str | Column], totals: dict[str, str], store: Store
) -> DataFrame:
    """Inclusive running sums over the whole frame: ``totals`` maps column to new name.

    The frame should be aggregated to one row per order key before it comes here."""
    keys = _ordered(order)
    staged = store.save(
        df.repartitionByRange(*keys).select("*", F.spark_partition_id().alias(_PART))
    )
    before = _preceding(
        staged.groupBy(_PART).agg(*[F.sum(c).alias(c) for c in totals]), list(totals)
    )
    local = (
        Window.partitionBy(_PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = staged.select("*", *[F.sum(c).over(local).alias(n) for c, n in totals.items()])
    return inside.join(before, _PART).select(
        *df.columns,
        *[(F.col(n) + F.col(f"__before_{c}")).alias(n) for c, n in totals.items()],
    )


# --- exact selection by hash -----------------------------------------------

_BUCKET_BITS = 48  # the top 16 bits of a hash name its bucket


def row_hash(keys: Sequence[str], seed: int) -> Column:
    """The hash skips nulls, so each key's null mark is hashed with it."""
    marked = [part for k in keys for part in (F.col(k).isNull(), F.col(k))]
    return F.xxhash64(F.lit(seed), *marked)


@dataclass(frozen=True)
class Cut:
    """The rows of a class whose hash is at most ``hash`` are its first ``rank`` rows."""

    label: object
    rank: int
    hash: int


def hash_cuts(
    df: DataFrame, keys: Sequence[str], seed: int, ranks: dict[object, Sequence[int]],
    label: Column | None = None,
) -> list[Cut]:
    """For every class, the hash values that hold exactly the wanted numbers of rows.

    Two passes over the key columns: counts per hash bucket find the bucket of each rank,
    then only the rows of those buckets (a 65,536th each) are ranked.  No row is moved to
    split a frame afterwards; the split is a filter.  ``keys`` must identify a row: rows of
    one hash fall on the same side."""
    hashed = df.select(
        (label if label is not None else F.lit("all")).alias("label"), row_hash(keys, seed).alias("h")
    )
    bucketed = hashed.withColumn("bucket", F.shiftright("h", _BUCKET_BITS))
    upto = Window.partitionBy("label").orderBy("bucket")
    counts = (
        bucketed.groupBy("label", "bucket").count()
        .select("*", F.sum("count").over(upto).alias("last"))
    )
    hit = F.lit(False)
    for cls, wanted in ranks.items():
        for rank in wanted:
            hit = hit | (
                F.col("label").eqNullSafe(F.lit(cls))
                & (F.col("last") >= rank) & (F.col("last") - F.col("count") < rank)
            )
    found = counts.filter(hit).collect()  # at most one row per class and rank
    if not found:
        return []
    start = {(r["label"], r["bucket"]): r["last"] - r["count"] for r in found}
    near = F.lit(False)
    for cls, bucket in start:
        near = near | (F.col("label").eqNullSafe(F.lit(cls)) & (F.col("bucket") == bucket))
    # Equal hashes are counted together first: copies of a row cannot pile up in a task.
    within = Window.partitionBy("label", "bucket").orderBy("h")
    ranked = (
        bucketed.filter(near).groupBy("label", "bucket", "h").count()
        .select("*", F.sum("count").over(within).alias("last"))
    )
    hit = F.lit(False)
    where: dict[tuple, int] = {}
    for r in found:
        key = (r["label"], r["bucket"])
        for rank in ranks[r["label"]]:
            if start[key] < rank <= r["last"]:
                place = rank - start[key]
                where[(*key, place)] = rank
                hit = hit | (
                    F.col("label").eqNullSafe(F.lit(key[0])) & (F.col("bucket") == key[1])
                    & (F.col("last") >= place) & (F.col("last") - F.col("count") < place)
                )
    cuts = []
    for r in ranked.filter(hit).collect():  # at most one row per class and rank
        for (cls, bucket, place), rank in where.items():
            inside = r["last"] - r["count"] < place <= r["last"]
            if (cls, bucket) == (r["label"], r["bucket"]) and inside:
                cuts.append(Cut(cls, rank, r["h"]))
    return cuts
