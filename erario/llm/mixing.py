"""Mixing sources to target weights by fitting each source's budget with whole documents.

Targets share a total by weight; a source stops at a multiple of its own size and the excess is
shared anew.  A source gives every document as often as its target holds the whole source, and one
more copy of some documents.  Which: documents are counted by exact length; every length gives its
share, rounded down, and a bounded knapsack over the lengths fills what the rounding left.  From
each length documents are taken by a seeded hash, so reruns agree: those with the smallest hashes, or, of
more than ``ORDERED_TOGETHER`` of one length, first by parts of the hash and then by the hash in a part.

Null texts and texts without words have size 0 and are taken as often as the source is taken
whole.  A null source is a source of its own, the last.  Rows with an equal doc_id are documents of
their own, told apart by their text; of equal rows each counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from erario.store import Store

from .common import DOC, SAME_DOC, WORD, text_hash

#: Documents of one source and length that are ordered in one task; more are cut by their hash.
ORDERED_TOGETHER = 20_000
#: Words left to the knapsack, beyond the longest document.
KNAPSACK_WORDS = 1 << 15


def word_count(name: str = "text"):
    return F.coalesce(F.regexp_count(name, F.lit(WORD)), F.lit(0)).cast("long")


def share_targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Share sum(sizes) by weight; none above ``most`` times its size, the excess shared anew."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        for i in full or open_:
            target[i] = most * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ -= full
    return target


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes closest to the budget from below."""
    items = [
        (i, n) for i in np.argsort(-lengths)
        for n in _binary(int(min(counts[i], budget // lengths[i])) if lengths[i] else 0)
    ]
    mask, reach = (1 << (budget + 1)) - 1, [1]
    for i, n in items:
        reach.append((reach[-1] | reach[-1] << int(n * lengths[i])) & mask)
    taken, left = np.zeros(len(lengths), np.int64), reach[-1].bit_length() - 1
    for (i, n), before in zip(reversed(items), reversed(reach[:-1]), strict=True):
        if not before >> left & 1:
            taken[i] += n
            left -= int(n * lengths[i])
    return taken


def _binary(n: int) -> list[int]:
    out, step = [], 1
    while n > 0:
        out.append(min(step, n))
        n -= out[-1]
        step *= 2
    return out


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Copies of the whole source, and how many documents of each length get one copy more."""
    size = int((lengths * counts).sum())
    if not size:
        return 0, np.zeros(len(lengths), np.int64)
    whole = int(target // size)
    rest = int(round(target - whole * size))
    # rounded down in whole numbers: counts and rests may pass what doubles hold exactly
    taken = np.array([int(c) * rest // size for c in counts], np.int64)
    left = rest - int((taken * lengths).sum())
    for i in np.argsort(-lengths):  # long documents first, until the knapsack can hold the rest
        if left <= KNAPSACK_WORDS or not lengths[i]:
            break
        more = min(int(counts[i] - taken[i]), (left - KNAPSACK_WORDS // 2) // int(lengths[i]))
        taken[i] += max(0, more)
        left -= max(0, more) * int(lengths[i])
    return whole, taken + knapsack(lengths, counts - taken, left)


def mix(
    docs: DataFrame, store: Store, weight: Callable[[int], float], most: float = 3.0, seed: int = 7
) -> DataFrame:
    """(doc_id, tk, source, size, source_size, target, copies, taken): one row a document; ``tk`` is
    a hash of its text.

    ``weight``: of the n-th source by code point.  One row a source meets in the driver; the
    counts by length of one source meet in one task (their number is at most the square root of
    twice the source's words).
    """
    sized = store.save(docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), "source", word_count().alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
    ))
    counts = store.save(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = sorted(
        ((r.source, r.words) for r in counts.groupBy("source").agg(
            F.sum(F.col("size") * F.col("n")).alias("words")).collect()),
        key=lambda x: (x[0] is None, x[0] or ""),
    )
    words = [w for _, w in totals]
    targets = share_targets(words, [weight(i) for i in range(len(words))], most)
    spark = docs.sparkSession
    goals = spark.createDataFrame(
        [(s, int(w), float(t)) for (s, w), t in zip(totals, targets, strict=True)],
        "source string, source_size long, target double",
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        whole, extra = fit_lengths(
            group["size"].to_numpy(), group["n"].to_numpy(), float(group["target"].iloc[0])
        )
        return group.assign(whole=whole, extra=extra)[list(FIT)]

    same_source = F.col("g.source").eqNullSafe(F.col("c.source"))
    fitted = store.save(
        counts.alias("c").join(F.broadcast(goals).alias("g"), same_source)
        .select("c.source", "size", "n", "source_size", "target")
        .groupBy("source").applyInPandas(fit, ", ".join(f"{k} {v}" for k, v in FIT.items()))
    )
    plan = fitted.withColumn("parts", F.ceil(F.col("n") / ORDERED_TOGETHER))
    placed = store.save(
        sized.alias("d").join(
            plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))
        )
        .select("d.*", "n", "source_size", "target", "whole", "extra", "parts")
        .withColumn("part", F.pmod(F.shiftrightunsigned("h", 20), F.col("parts")))
    )
    group = ["source", "size"]
    by_part = placed.groupBy(*group, "part").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = store.save(
        by_part.where("size > 0").withColumn("start", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    )
    cut = F.col("start") + F.row_number().over(
        Window.partitionBy("d.source", "d.size", "d.part").orderBy("h", "doc_id")
    ) <= F.col("extra")
    same = (
        F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.size") == F.col("s.size"))
        & (F.col("d.part") == F.col("s.part"))
    )
    copies = F.col("whole") + F.coalesce(cut, F.lit(False)).cast("long")
    return (
        placed.alias("d").join(starts.alias("s"), same, "left")
        .select("doc_id", "tk", "d.source", "d.size", "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mixed_documents(
    docs: DataFrame, store: Store, weight: Callable[[int], float], most: float = 3.0, seed: int = 7
) -> DataFrame:
    """The documents, each as often as the mix takes it.  The copies of rows equal in doc_id, text and
    source are dealt out among them evenly, so that the words taken are those of the mix."""
    taken = store.save(
        mix(docs, store, weight, most, seed).groupBy(*DOC, "source")
        .agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    )
    rows = docs.select("doc_id", text_hash(), "source", F.struct("*").alias("row"))
    same = F.expr(SAME_DOC) & F.expr("a.source <=> b.source")
    chosen = rows.alias("a").join(taken.alias("b"), same).select("a.doc_id", "a.tk", "a.source", "row", "copies", "rows")
    each = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    if not taken.where("rows > 1").limit(1).count():
        return chosen.select("row", each).select("row.*")
    # Equal rows are numbered within the parts of a stored table, then by what earlier parts hold.
    key = [*DOC, "source"]
    several = store.save(chosen.where("rows > 1").withColumn("part", F.spark_partition_id()))
    counts = several.groupBy(*key, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = store.save(counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"))
    local = F.row_number().over(Window.partitionBy(*(f"a.{k}" for k in (*key, "part"))).orderBy(F.lit(1)))
    number = F.col("start") + local
    extra = (number <= F.col("copies") % F.col("rows")).cast("long")
    dealt = several.alias("a").join(starts.alias("b"), same & F.expr("a.part = b.part")).select(
        "row", (F.floor(F.col("copies") / F.col("rows")) + extra).alias("copies")).where("copies > 0")
    single = chosen.where("rows = 1").select("row", "copies")
    return single.unionByName(dealt).select("row", each).select("row.*")


FIT = {"source": "string", "size": "long", "n": "long", "source_size": "long", "target": "double",
       "whole": "long", "extra": "long"}
