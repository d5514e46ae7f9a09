"""Exact interpolated quantiles at any size.

A quantile over many rows is narrowed down: a sample proposes a bracket around its rank, one pass
of counts proves the bracket right, until the rows inside are few enough to be ordered.  The sample
decides how fast the answer comes, never what it is: at every size the value is interpolated between
the same two rows, in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, sqrt
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erario.operators.numbering import running_totals
from erario.store import Store

BUFFERED_ROWS = 100_000
_SAMPLE = 20_000  # rows drawn per quantile and round; a round keeps about a thirtieth
_ROUNDS = 8
_DEVIATIONS = 5  # half-width of a bracket, in standard deviations of the sample's rank


def melt(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows (name, value), one per column and input row."""
    pairs = [F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in columns.items()]
    return df.select(F.inline(F.array(*pairs)))


@dataclass
class _Target:
    """One wanted quantile: its two neighbouring ranks and the values they lie between."""

    name: str
    prob: float
    low: int
    high: int
    part: float
    inside: int
    below: int = 0
    lo: float | None = None
    hi: float | None = None
    settled: bool = False

    def within(self, c: Column, lo: float | None, hi: float | None) -> Column:
        test = c.isNotNull()
        test = test if lo is None else test & (c >= F.lit(lo))
        return test if hi is None else test & (c <= F.lit(hi))


def quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: Sequence[float],
    store: Store | None = None,
    buffered_rows: int = BUFFERED_ROWS,
    accuracy: int | None = None,
) -> DataFrame:
    """Rows (name, prob, value); nulls are left out, value is null if nothing is left.

    ``accuracy`` asks for ``percentile_approx`` instead: one pass, not interpolated."""
    if accuracy is None:
        return _narrowed(df, columns, probs, store or Store(df.sparkSession), max(buffered_rows, 1))
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    row = df.agg(*[
        F.percentile_approx(c, wanted, accuracy).cast("array<double>").alias(n) for n, c in columns.items()
    ])
    cells = [
        F.struct(
            F.lit(n).alias("name"), F.lit(float(p)).alias("prob"), F.col(n)[i].alias("value")
        )
        for n in columns
        for i, p in enumerate(probs)
    ]
    return row.select(F.inline(F.array(*cells)))


def _narrowed(
    df: DataFrame, columns: dict[str, Column], probs: Sequence[float], store: Store, bound: int
) -> DataFrame:
    values = df.select(*[c.cast("double").alias(n) for n, c in columns.items()])
    sizes = values.agg(*[F.count(n).alias(n) for n in columns]).first()
    targets = [
        _Target(n, float(p), floor(at), ceil(at), at - floor(at), sizes[n])
        for n in columns if sizes[n] > 0
        for p in probs
        for at in [float(p) * (sizes[n] - 1)]
    ]
    for seed in range(_ROUNDS):
        wide = [t for t in targets if t.inside > bound and not t.settled]
        if not wide:
            break
        _narrow(values, wide, min(bound, _SAMPLE), seed)
    found = _picked(values, targets, store, bound) if targets else {}
    cells = [
        F.struct(
            F.lit(n).alias("name"), F.lit(float(p)).alias("prob"),
            F.lit(found.get((n, float(p)))).cast("double").alias("value"),
        )
        for n in columns
        for p in probs
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*cells)))


def _narrow(values: DataFrame, targets: list[_Target], sample: int, seed: int) -> None:
    """Propose a tighter bracket for every target from a sample of its bracket, and take it
    if the counts show both ranks inside."""
    rate = {id(t): min(1.0, sample / t.inside) for t in targets}
    drawn = values.select("*", F.rand(seed).alias("__r")).filter(F.col("__r") < max(rate.values()))
    asks = []
    for i, t in enumerate(targets):
        share = min(1.0, max(0.0, (t.low + t.high + 1) / 2 - t.below) / t.inside)
        size = t.inside * rate[id(t)]
        reach = _DEVIATIONS * (sqrt(share * (1 - share) / size) + 1 / size)
        asked = F.array(F.lit(max(0.0, share - reach)), F.lit(min(1.0, share + reach)))
        chosen = t.within(F.col(t.name), t.lo, t.hi) & (F.col("__r") < rate[id(t)])
        asks.append(F.percentile(F.when(chosen, F.col(t.name)), asked).alias(f"b{i}"))
    brackets = drawn.agg(*asks).first()

    proposed, counts = [], []
    for i, t in enumerate(targets):
        lo, hi = brackets[f"b{i}"] or (None, None)
        c = F.col(t.name)
        # The ends of the data stay open: the sample need not hold them.
        lo = t.lo if t.low - t.below < _DEVIATIONS or lo is None else lo
        hi = t.hi if t.below + t.inside - t.high <= _DEVIATIONS or hi is None else hi
        proposed.append((lo, hi))
        counts.append(F.count_if(c < F.lit(lo) if lo is not None else F.lit(False)).alias(f"under{i}"))
        counts.append(F.count_if(t.within(c, lo, hi)).alias(f"inside{i}"))
    row = values.agg(*counts).first()
    for i, t in enumerate(targets):
        below, inside = row[f"under{i}"], row[f"inside{i}"]
        holds = below <= t.low and t.high < below + inside
        # A bracket that hardly shrinks is full of equal values, which count as one row.
        t.settled = not holds or 2 * inside > t.inside
        if holds and inside <= t.inside:
            (t.lo, t.hi), t.below, t.inside = proposed[i], below, inside


def _picked(values: DataFrame, targets: list[_Target], store: Store, bound: int) -> dict:
    """The interpolated value of every target, from the counted values in its bracket."""
    hits = [t.within(F.col(t.name), t.lo, t.hi) for t in targets]
    cells = [
        F.when(hit, F.struct(F.lit(i).alias("target"), F.col(t.name).alias("value")))
        for i, (t, hit) in enumerate(zip(targets, hits))
    ]
    # Most rows are in no bracket and are dropped before any is unfolded.
    near = values.filter(reduce(lambda a, b: a | b, hits))
    inside = near.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"))
    counted = inside.groupBy(F.col("c.target").alias("target"), F.col("c.value").alias("value")).agg(
        F.count("*").alias("n")
    )
    # Rank of a value = rows below the bracket + rows up to it inside.
    offsets = [t.below for t in targets]
    if all(t.inside <= bound for t in targets):
        along = Window.partitionBy("target").orderBy("value")  # at most the bound per target
        running = counted.withColumn("upto", F.sum("n").over(along))
    else:
        running = running_totals(counted, ["target", "value"], {"n": "upto"}, store)
        # These totals run on from one target to the next.
        offsets = [o - sum(t.inside for t in targets[:i]) for i, o in enumerate(offsets)]
    by_target = F.array(*[F.lit(o).cast("long") for o in offsets])
    placed = running.withColumn("last", F.col("upto") + F.element_at(by_target, F.col("target") + 1))
    rank = {
        side: F.element_at(F.array(*[F.lit(getattr(t, side)).cast("long") for t in targets]),
                           F.col("target") + 1)
        for side in ("low", "high")
    }
    rows = placed.groupBy("target").agg(*[
        F.min(F.when(F.col("last") > rank[side], F.col("value"))).alias(side) for side in rank
    ]).collect()  # a row per quantile
    return {
        (targets[r["target"]].name, targets[r["target"]].prob):
        r["low"] + (r["high"] - r["low"]) * targets[r["target"]].part
        for r in rows
    }
