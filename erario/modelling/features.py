"""Feature choice and leakage-free preparation.

What is learnt from the training rows is small (a few numbers per column, at most 50 levels
a text) and becomes literals; only the list of rare levels may be long, and stays a table.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from math import ceil, floor
from typing import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erario import fixed
from erario.operators.quantiles import BUFFERED_ROWS, quantiles
from erario.plans.profile import value_counts
from erario.store import Store, broadcast_small

POOLED = "\u0001pooled"  # the level that stands for all rare ones
_UNSEEN = "\u0001unseen"
FEW_VALUES = 1000  # values of a number that are counted one by one
_NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")


def feature_columns(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """(numeric, categorical, all) usable columns, by the types of the frame.  An id held as
    text is categorical."""
    kinds = dict(df.dtypes)
    usable = [
        c for c in fixed.BUDGET_FEATURES + fixed.ID_FEATURES
        if c in kinds and c not in fixed.BANNED_FEATURES
    ]
    numeric = [c for c in usable if kinds[c] in _NUMERIC or kinds[c].startswith("decimal")]
    texts = [
        c for c in fixed.TEXT_FEATURES if c in kinds and c not in fixed.BANNED_FEATURES
    ] + [c for c in usable if c not in numeric]
    texts = list(dict.fromkeys(texts))
    return numeric, texts, numeric + texts


def require_no_leakage(columns: Sequence[str]) -> None:
    leaked = [c for c in columns if c in fixed.BANNED_FEATURES]
    if leaked:
        raise ValueError(f"columns leak the outcome or identify a row: {leaked}")


def require_targets(df: DataFrame) -> None:
    missing = [
        c for c in (fixed.REGRESSION_TARGET, fixed.CLASSIFICATION_TARGET) if c not in df.columns
    ]
    if missing:
        raise ValueError(f"the modelling frame lacks its targets: {missing}")


@dataclass(frozen=True)
class NumericStat:
    name: str
    median: float
    mean: float
    scale: float


@dataclass(frozen=True)
class TextStat:
    name: str
    mode: str
    levels: tuple[str, ...]
    pooled: bool


@dataclass(frozen=True)
class Preparation:
    """Learnt statistics.  ``inputs`` are the columns a row should have; one without any
    known training value is not used."""

    inputs: tuple[str, ...]
    numbers: tuple[NumericStat, ...]
    texts: tuple[TextStat, ...]

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Preparation:
        raw = json.loads(text)
        return cls(
            tuple(raw["inputs"]),
            tuple(NumericStat(**n) for n in raw["numbers"]),
            tuple(TextStat(t["name"], t["mode"], tuple(t["levels"]), t["pooled"]) for t in raw["texts"]),
        )


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def medians(df: DataFrame, columns: Sequence[str], store: Store, buffered_rows: int = BUFFERED_ROWS) -> dict:
    found = quantiles(df, {c: _double(c) for c in columns}, [0.5], store, buffered_rows)
    return {r["name"]: r["value"] for r in found.collect()}  # a row per column


def numeric_stats(
    df: DataFrame, columns: Sequence[str], store: Store, buffered_rows: int = BUFFERED_ROWS
) -> list[NumericStat]:
    """Interpolated median, then mean and population deviation of the imputed column."""
    if not columns:
        return []
    mid = {c: m for c, m in medians(df, columns, store, buffered_rows).items() if m is not None}
    columns = [c for c in columns if c in mid]
    filled = {c: F.coalesce(_double(c), F.lit(mid[c])) for c in columns}
    row = df.agg(
        *[F.avg(v).alias(f"mean_{c}") for c, v in filled.items()],
        *[F.stddev_pop(v).alias(f"std_{c}") for c, v in filled.items()],
    ).first()
    return [
        NumericStat(c, mid[c], row[f"mean_{c}"], row[f"std_{c}"] or 1.0) for c in columns
    ]


def modes(counts: DataFrame) -> DataFrame:
    """Most frequent known value per column (the smallest of a tie) and number of values."""
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("value")))
    return (
        counts.filter(F.col("value").isNotNull()).groupBy("name")
        .agg(best.alias("best"), F.count("*").alias("levels"))
        .select("name", F.col("best.value").alias("mode"), "levels")
    )


def top_levels(counts: DataFrame, max_levels: int = fixed.MAX_LEVELS) -> DataFrame:
    """Levels that get an output of their own: all of them, or if there are more than
    ``max_levels`` the most frequent but for one place, which the rest share.  The limit
    on the rank is applied within each task before rows meet."""
    by_size = Window.partitionBy("name").orderBy(F.col("n").desc(), F.col("value"))
    ranked = counts.filter(F.col("value").isNotNull()).withColumn("place", F.row_number().over(by_size))
    ranked = ranked.filter(F.col("place") <= max_levels)
    sizes = modes(counts).select("name", "levels")
    return ranked.join(F.broadcast(sizes), "name").filter(  # a row per column
        (F.col("levels") <= max_levels) | (F.col("place") < max_levels)
    ).select("name", "value", "n", "place", (F.col("levels") > max_levels).alias("pooled"))


def text_stats(
    df: DataFrame, columns: Sequence[str], store: Store, max_levels: int = fixed.MAX_LEVELS
) -> tuple[list[TextStat], DataFrame]:
    """Mode and levels per column, and the table of rare levels (name, value)."""
    return _text_stats(store.save(value_counts(df, columns)), columns, max_levels)


def _text_stats(
    counts: DataFrame, columns: Sequence[str], max_levels: int
) -> tuple[list[TextStat], DataFrame]:
    """The same from stored counts (name, value, n)."""
    mode = {r["name"]: r["mode"] for r in modes(counts).collect()}  # a row per column
    kept: dict[str, list] = {}
    pooled: set[str] = set()
    for r in top_levels(counts, max_levels).orderBy("name", "place").collect():  # ≤ 50 a column
        kept.setdefault(r["name"], []).append(r["value"])
        if r["pooled"]:
            pooled.add(r["name"])
    rare = F.lit(False)
    for c in pooled:
        rare = rare | ((F.col("name") == c) & ~F.col("value").isin(kept[c]))
    stats = [TextStat(c, mode[c], tuple(kept[c]), c in pooled) for c in columns if c in mode]
    return stats, counts.filter(rare & F.col("value").isNotNull()).select("name", "value")


def learn(
    df: DataFrame, store: Store, buffered_rows: int = BUFFERED_ROWS,
    max_levels: int = fixed.MAX_LEVELS,
) -> tuple[Preparation, DataFrame]:
    """Statistics of the training rows, and the table of rare levels."""
    numeric, texts, every = feature_columns(df)
    require_no_leakage(every)
    text, rare = text_stats(df, texts, store, max_levels)
    numbers = numeric_stats(df, numeric, store, buffered_rows)
    return Preparation(tuple(every), tuple(numbers), tuple(text)), rare


def learn_folds(
    df: DataFrame, k: int, store: Store, buffered_rows: int = BUFFERED_ROWS, max_levels: int = fixed.MAX_LEVELS,
) -> list[tuple[Preparation, DataFrame]]:
    """What ``learn`` gives for the rows outside each ``fold`` 0…k-1, and last for all rows.

    Levels are counted once, by fold; the counts outside a fold are the total less its own.  Medians,
    means and deviations of all fits share their passes, so the number of jobs does not grow with k."""
    numeric, texts, every = feature_columns(df)
    require_no_leakage(every)
    outside = {str(f): F.col("fold") != f for f in range(k)} | {"all": F.lit(True)}

    # Texts: the counts of a fit stand under "fit|column".
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in texts]
    by_fold = (
        df.select("fold", F.inline(F.array(*cells))).groupBy("name", "value", "fold").agg(F.count("*").alias("n"))
        if cells else df.sparkSession.createDataFrame([], "name string, value string, fold int, n bigint")
    )
    total = by_fold.groupBy("name", "value").agg(
        *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f) for f, c in outside.items()])
    fits = F.array(*[F.struct(F.lit(f"{f}|").alias("fit"), F.col(f).alias("n")) for f in outside])
    counts = store.save(
        total.select("name", "value", F.inline(fits)).where("n > 0")
        .select(F.concat("fit", "name").alias("name"), "value", "n"))
    stats, rare = _text_stats(counts, [f"{f}|{c}" for f in outside for c in texts], max_levels)
    rare = store.save(rare)

    # Numbers: a column of a fit is null in the rows of its fold.
    mid = _medians_of_few(df, numeric, outside)
    asked = {
        n: F.when(rows, _double(c)) for f, rows in outside.items() for c in numeric if (n := f"{f}|{c}") not in mid}
    if asked:
        mid |= {r["name"]: r["value"] for r in quantiles(df, asked, [0.5], store, buffered_rows).collect()}
    filled = {
        f"{f}|{c}": F.when(rows, F.coalesce(_double(c), F.lit(mid[f"{f}|{c}"])))
        for f, rows in outside.items() for c in numeric if mid[f"{f}|{c}"] is not None
    }
    row = df.agg(
        F.count("*"), *[F.avg(v).alias(f"mean_{c}") for c, v in filled.items()],
        *[F.stddev_pop(v).alias(f"std_{c}") for c, v in filled.items()]).first()
    out = []
    for f in outside:
        numbers = tuple(
            NumericStat(c, mid[n], row[f"mean_{n}"], row[f"std_{n}"] or 1.0)
            for c in numeric if (n := f"{f}|{c}") in filled)
        own = tuple(
            TextStat(t.name[len(f) + 1:], t.mode, t.levels, t.pooled) for t in stats if t.name.startswith(f"{f}|"))
        of_fit = rare.where(F.startswith("name", F.lit(f"{f}|"))).select(
            F.substr("name", F.lit(len(f) + 2)).alias("name"), "value")
        out.append((Preparation(tuple(every), numbers, own), of_fit))
    return out


def _medians_of_few(df: DataFrame, columns: Sequence[str], outside: dict[str, Column]) -> dict[str, float | None]:
    """Medians of every fit, under "fit|column", of the columns with few values: from how often each occurs."""
    if not columns:
        return {}
    row = df.agg(*[F.approx_count_distinct(_double(c)).alias(c) for c in columns]).first()
    few = [c for c in columns if row[c] <= FEW_VALUES]
    if not few:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("name"), _double(c).alias("value")) for c in few])
    counts = (
        df.select("fold", F.inline(cells)).where("value is not null").groupBy("name", "value")
        .agg(*[F.count_if(rows).alias(f) for f, rows in outside.items()])
        .orderBy("name", "value").collect())  # some hundreds a column
    out: dict[str, float | None] = {}
    for c in few:
        own = [r for r in counts if r["name"] == c]
        for f in outside:
            n = sum(r[f] for r in own)
            at, upto, found = 0.5 * (n - 1), 0, []
            for r in own:
                upto += r[f]
                found += [r["value"]] * sum(before < upto for before in (floor(at), ceil(at))[len(found):])
            out[f"{f}|{c}"] = found[0] + (found[1] - found[0]) * (at - floor(at)) if n else None
    return out


def standardised(stats: Sequence[NumericStat]) -> list[Column]:
    return [
        ((F.coalesce(_double(s.name), F.lit(s.median)) - F.lit(s.mean)) / F.lit(s.scale))
        .alias(f"num_{s.name}")
        for s in stats
    ]


def apply(df: DataFrame, prep: Preparation, rare: DataFrame | None) -> DataFrame:
    """Add the prepared inputs ``num_*`` and ``txt_*``; absent columns count as missing.

    Without a table of rare levels (the training rows themselves) every text is known, so
    one that is not kept is rare."""
    absent = [s.name for s in prep.numbers + prep.texts if s.name not in df.columns]
    df = df.withColumns({c: F.lit(None) for c in absent}) if absent else df
    kept = df.columns
    filled = {t.name: F.coalesce(F.col(t.name).cast("string"), F.lit(t.mode)) for t in prep.texts}
    df = df.withColumns({f"txt_{n}": c for n, c in filled.items()})
    for t in prep.texts:
        text = F.col(f"txt_{t.name}")
        own = text.isin(*t.levels)
        if rare is None:
            level = F.when(own, text).otherwise(F.lit(POOLED)) if t.pooled else text
        elif t.pooled:
            known = rare.filter(F.col("name") == t.name).select(F.col("value").alias("__rare"))
            df = df.join(known, ~own & (text == F.col("__rare")), "left")
            level = (
                F.when(own, text).when(F.col("__rare").isNotNull(), F.lit(POOLED))
                .otherwise(F.lit(_UNSEEN))
            )
        else:
            level = F.when(own, text).otherwise(F.lit(_UNSEEN))
        df = df.withColumn(f"txt_{t.name}", level).drop("__rare")
    return df.select(*[F.col(c) for c in kept], *standardised(prep.numbers), *[f"txt_{t.name}" for t in prep.texts])


def encoder(df: DataFrame, prep: Preparation) -> PipelineModel:
    """Index, one-hot and assemble.  A text outside the levels takes the extra index, whose
    output is dropped: all zeros."""
    stages, outputs = [], [f"num_{s.name}" for s in prep.numbers]
    if prep.texts:
        names = [t.name for t in prep.texts]
        # One indexer a column: a joint one pads its label lists to equal length.
        index = [
            StringIndexerModel.from_labels(
                list(t.levels) + ([POOLED] if t.pooled else []),
                f"txt_{t.name}", f"idx_{t.name}", handleInvalid="keep",
            )
            for t in prep.texts
        ]
        indexed = PipelineModel(index).transform(df)
        hot = OneHotEncoder(
            inputCols=[f"idx_{n}" for n in names], outputCols=[f"hot_{n}" for n in names],
            dropLast=True, handleInvalid="error",
        ).fit(indexed)
        stages, outputs = [*index, hot], outputs + [f"hot_{n}" for n in names]
    return PipelineModel([*stages, VectorAssembler(inputCols=outputs, outputCol="features")])


def sized_rare(rare: DataFrame) -> DataFrame:
    """The stored table of rare levels, to be broadcast if small."""
    return broadcast_small({"rare": rare})["rare"]
