"""Registered modelling queries and the SQL for those that have a definite answer."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erario import fixed
from erario.modelling import features, linear, metrics
from erario.modelling.blocks import coded
from erario.modelling.score import model_info, predict_classification, predict_regression
from erario.modelling.split import class_sizes, split, stratified_sample, with_folds
from erario.modelling.train import (
    ABSOLUTE_SHARE, CANDIDATES, PENALTY, TASKS, candidates, load_fitted, train_task,
)
from erario.plans.profile import value_counts
from erario.plans.views import modelling_star
from erario.sources.lens import table
from erario.spec import TrainConfig
from erario.store import Store
from erario_checks.oracle import on_clean
from erario_checks.workload import Query, Stage, on_clean as over_clean, rounded

# The full run: every candidate, five folds, 200 boosting rounds, on every modelling row.
CONFIG = TrainConfig()
# Part types, which stand for chapters, have more levels than are kept, so some are pooled.
TEXTS = ["tipo_gasto", "desc_ramo", "entidad_federativa", "desc_concepto", "desc_pp", "desc_capitulo"]


class Models:
    """Models trained once per data folder and session, saved and read back."""

    _known: dict[tuple[str, str], Models] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.stage = spark, Stage.of(spark, sf_dir)
        self.out = Store(spark)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Models:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def _train(self, task: str):
        rows = modelling_star(self.stage.warehouse)
        return train_task(rows, task, CONFIG, [fixed.FACT_KEY], self.out)

    @cached_property
    def regression(self):
        return self._train("regression")

    @cached_property
    def classification(self):
        return self._train("classification")

    def both(self) -> tuple:
        """Both tasks, side by side: each is a chain of short jobs."""
        self.stage.warehouse
        train = inheritable_thread_target(self.spark)(lambda task: getattr(self, task))
        with ThreadPoolExecutor(2) as pool:
            return tuple(pool.map(train, ("regression", "classification")))


def _modelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and class of the modelling rows."""
    columns = [fixed.FACT_KEY, fixed.CLASSIFICATION_TARGET]
    return modelling_star(Stage.of(spark, sf_dir).warehouse, columns)


def _standardise(df: DataFrame) -> DataFrame:
    stats = features.numeric_stats(
        df, ["monto_modificado", "monto_aprobado", "id_capitulo"], Store(df.sparkSession))
    names = [f"num_{s.name}" for s in stats]
    return rounded(df.select("id_clave_cartera", *features.standardised(stats)), *names)


def _prepared(df: DataFrame) -> DataFrame:
    """Learn on the modelling rows, prepare all rows: kept, pooled and unseen texts."""
    store = Store(df.sparkSession)
    fit = df.filter(
        (F.col("monto_modificado") > 0) & F.col("flag_registro_valido")
        & (F.col("tipo_gasto") == fixed.PROGRAMMABLE))
    stats, rare = features.text_stats(fit, TEXTS, store, fixed.MAX_LEVELS)
    prep = features.Preparation(tuple(TEXTS), (), tuple(stats))
    ready = features.apply(df, prep, features.sized_rare(store.save(rare)))
    return (
        value_counts(ready, [f"txt_{t}" for t in TEXTS])
        .select("name", F.regexp_replace("value", "^\u0001", "*").alias("value"), "n"))


def _scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with an outcome, a yes/no guess and a score with ties."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_discount") > 0.05).cast("int").alias("prediction"),
        F.round(F.col("l_discount") * 100 + F.col("l_tax") * 100).cast("double").alias("score"),
    )


def _metrics_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_discount").alias("label"), F.col("l_tax").alias("prediction"))
    return rounded(metrics.regression_metrics(rows), "mae", "rmse", "r2")


def _rank_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three guesses of the discount, measured in seven folds, averaged and ranked."""
    guesses = {"tax": F.col("l_tax"), "flat": F.lit(0.05), "blend": F.col("l_tax") / 2 + 0.03}
    cells = [F.struct(F.lit(n).alias("model"), g.alias("prediction")) for n, g in guesses.items()]
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("fold"), F.col("l_discount").alias("label"),
        F.inline(F.array(*cells)))
    folds = metrics.melted(metrics.regression_metrics(rows, by=["model", "fold"]), ["model", "fold"])
    return rounded(metrics.ranking(metrics.summary(folds), "regression"), "rmse_mean", "r2_mean")


def _cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("tax").alias("model"), F.col("l_linenumber").alias("fold"),
        F.col("l_discount").alias("label"), F.col("l_tax").alias("prediction"))
    folds = metrics.melted(metrics.regression_metrics(rows, by=["model", "fold"]), ["model", "fold"])
    return rounded(metrics.summary(folds), "mean", "std")


def _split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(
        _modelling(spark, sf_dir), [fixed.FACT_KEY], fixed.TEST_SHARE, fixed.SEED,
        fixed.CLASSIFICATION_TARGET)
    parts = [p.groupBy("alta_ejecucion").agg(F.count("*").alias("n")).withColumn("part", F.lit(n))
             for n, p in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


def _fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = with_folds(
        _modelling(spark, sf_dir), [fixed.FACT_KEY], 5, fixed.SEED, fixed.CLASSIFICATION_TARGET)
    return folds.groupBy("fold", "alta_ejecucion").agg(F.count("*").alias("n")).select(
        F.col("fold").cast("bigint").alias("fold"), "alta_ejecucion", "n")


def _sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = stratified_sample(
        _modelling(spark, sf_dir), [fixed.FACT_KEY], fixed.CLASSIFICATION_TARGET, 3000, fixed.SEED)
    return picked.groupBy("alta_ejecucion").agg(F.count("*").alias("n"))


def _score(task: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        models = Models.of(spark, sf_dir)
        getattr(models, task)  # trained and saved
        fitted = load_fitted(spark, models.out, task)
        predict = predict_regression if task == "regression" else predict_classification
        return predict(fitted, models.stage.clean).drop("log1p_monto_pagado")

    return run


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = Models.of(spark, sf_dir)
    models.both()
    return model_info(spark, models.out)


_COUNTED = ("n_samples", "n_train", "n_test", "n_without_target", "cv_folds", "target")


def _train_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts both trainings report about their rows."""
    models = Models.of(spark, sf_dir)
    regression, classification = models.both()
    facts = regression.facts.unionByName(classification.facts)
    return facts.where(F.col("fact").isin(*_COUNTED))


def _train_shape_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate has its metrics, from the folds and from the test part; places are dense."""
    models = Models.of(spark, sf_dir)
    regression, classification = models.both()
    rows = regression.comparison.unionByName(classification.comparison)
    last = max(map(len, CANDIDATES.values()))
    return rows.groupBy("task", "model", "stage").agg(
        F.count("mean").alias("metrics"), F.count_if(F.col("place").between(1, last)).alias("placed"))


def _train_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the candidates that the short profile has too."""
    short = [n for task in CANDIDATES for n in candidates(task, TrainConfig(fast=True))]
    return _train_shape_full(spark, sf_dir).where(F.col("model").isin(short))


def _score_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: all of them, each with a finite prediction, labels as the probability says."""
    models = Models.of(spark, sf_dir)
    models.both()
    parts = []
    for task in ("regression", "classification"):
        scored = _score(task)(spark, sf_dir)
        good = F.coalesce(F.abs(F.col("prediction")) < float("inf"), F.lit(False))
        if task == "classification":
            p = F.col("probability_positive")
            good &= p.between(0, 1) & (F.col("prediction") == (p > 0.5).cast("int"))
        fitted = getattr(models, task).fitted
        from_memory = (predict_regression if task == "regression" else predict_classification)(
            fitted, models.stage.clean)
        same = scored.agg(F.sum(F.round("prediction", 6).cast("decimal(38,6)")).alias("s")).join(
            from_memory.agg(F.sum(F.round("prediction", 6).cast("decimal(38,6)")).alias("t")), F.lit(True))
        parts.append(scored.agg(F.count("*").alias("n"), F.count_if(good).alias("n_good")).join(
            same.select((F.col("s") == F.col("t")).alias("reload_equals_memory")), F.lit(True))
            .select(F.lit(task).alias("task"), "n", "n_good", "reload_equals_memory"))
    return parts[0].unionByName(parts[1])


def _rows_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling_star(Stage.of(spark, sf_dir).warehouse)


def _feature_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature with its kind, its known values, and whether it would leak the outcome."""
    df = _rows_of_models(spark, sf_dir)
    numbers, texts, every = features.feature_columns(df)
    features.require_no_leakage(every)
    known = df.agg(*[F.count(c).alias(c) for c in every])
    cells = [
        F.struct(F.lit(c).alias("name"), F.lit("numeric" if c in numbers else "categorical").alias("kind"),
                 F.col(c).alias("known"), F.lit(c in fixed.BANNED_FEATURES).alias("leaks"))
        for c in numbers + texts]
    return known.select(F.inline(F.array(*cells)))


def _targets_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rows_of_models(spark, sf_dir)
    features.require_targets(df)
    targets = (fixed.REGRESSION_TARGET, fixed.CLASSIFICATION_TARGET)
    row = df.agg(F.count("*").alias("n"), *[F.count(t).alias(t) for t in targets])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col("n"), F.col(t).alias("known")) for t in targets])))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, outputs, and how many outputs of texts are set: one a text and row."""
    df = _rows_of_models(spark, sf_dir)
    prep, _ = features.learn(df, Store(spark))
    ready = features.apply(df, prep, None)
    rows = features.encoder(ready, prep).transform(ready).select(vector_to_array("features").alias("x"))
    hot = F.aggregate(F.slice("x", len(prep.numbers) + 1, F.size("x")), F.lit(0.0), lambda a, b: a + b)
    return rows.agg(F.count("*").alias("n"), F.max(F.size("x")).cast("bigint").alias("outputs"),
                    F.sum(hot.cast("bigint")).alias("hot"))


def _optimal(task: str) -> Query:
    """Whether the fitted linear model is the least point of its objective, by slopes over the data."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store, target = Store(spark), TASKS[task]
        df = _rows_of_models(spark, sf_dir).where(F.col(target).isNotNull())
        df = store.save(with_folds(df.withColumn("label", F.col(target).cast("double")), [fixed.FACT_KEY], 2, 1)
                        .withColumn("tenth", F.lit(1)))
        preps = [p for p, _ in features.learn_folds(df, 2, store)]
        data = coded(df, preps, [fixed.FACT_KEY], 1, store)
        prep = preps[-1]
        ready = features.apply(df, prep, None)
        encoded = features.encoder(ready, prep).transform(ready)
        if task == "regression":
            model = linear.elastic_net(data, preps, PENALTY, ABSOLUTE_SHARE)[-1]
            rest, lasso, ridge = F.col("label") - F.col("prediction"), PENALTY * ABSOLUTE_SHARE, PENALTY * (1 - ABSOLUTE_SHARE)
        else:
            model = linear.balanced_logistic(data, preps)[-1]
            size = class_sizes(df, "label")
            n = sum(size.values())
            weight = F.when(F.col("label") == 1, n / (2 * size[1.0])).otherwise(n / (2 * size[0.0]))
            rest, lasso, ridge = weight * (F.col("label") - F.col("score")), 0.0, 1.0 / n
        w = [float(x) for x in model.table["weight"]]
        slopes = (
            model.transform(encoded, prep).select(rest.alias("rest"), F.posexplode(vector_to_array("features")))
            .groupBy("pos").agg((F.avg(F.col("col") * F.col("rest"))).alias("slope"), F.count("*").alias("n")))
        at = F.element_at(F.array(*map(F.lit, w)), F.col("pos") + 1)
        slope = F.col("slope") - ridge * at
        gap = F.when(at == 0, F.greatest(F.abs(slope) - lasso, F.lit(0.0))).otherwise(F.abs(slope - lasso * F.signum(at)))
        return slopes.agg(F.max("n").alias("n"), F.count("*").alias("outputs"), (F.max(gap) < 1e-6).alias("optimal"))

    return run


def _fast_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold sizes of the short profile."""
    folds = with_folds(_modelling(spark, sf_dir), [fixed.FACT_KEY], TrainConfig(fast=True).n_folds, fixed.SEED)
    return folds.groupBy("fold").agg(F.count("*").alias("n")).select(F.col("fold").cast("bigint").alias("fold"), "n")


def learning_queries() -> dict[str, Query]:
    return {
        "train_facts": _train_facts,
        "train_shape": _train_shape,
        "train_shape_full": _train_shape_full,
        "score_checks": _score_checks,
        "standardise": over_clean(_standardise),
        "impute_mode": over_clean(lambda df: features.modes(value_counts(df, TEXTS))),
        "onehot_levels": over_clean(
            lambda df: features.top_levels(value_counts(df, TEXTS), fixed.MAX_LEVELS)
            .withColumn("place", F.col("place").cast("bigint"))),
        "onehot_prepared": over_clean(_prepared),
        "metrics_regression": _metrics_regression,
        "metrics_classification": lambda s, d: rounded(
            metrics.label_metrics(_scored_lines(s, d)), "f1", "recall", "precision"),
        "metrics_auc_ap": lambda s, d: rounded(
            metrics.rank_metrics(_scored_lines(s, d), Store(s)), "roc_auc", "pr_auc"),
        "cv_summary": _cv_summary,
        "rank_models": _rank_models,
        "split_stratified": _split_sizes,
        "folds": _fold_sizes,
        "sample_stratified": _sample_sizes,
        "train_regression": lambda s, d: Models.of(s, d).regression.comparison,
        "train_classification": lambda s, d: Models.of(s, d).classification.comparison,
        "score_regression": _score("regression"),
        "score_classification": _score("classification"),
        "model_info": _info,
        "feature_kinds": _feature_kinds,
        "targets_known": _targets_known,
        "assembled": _assembled,
        "folds_fast": _fast_folds,
        "elastic_net_optimal": _optimal("regression"),
        "logistic_optimal": _optimal("classification"),
    }


_NUMBERS = ("monto_aprobado", "monto_modificado", "ciclo", "id_ramo", "id_entidad_federativa", "id_capitulo", "id_ff")
_WORDS = ("tipo_gasto", "desc_ramo", "desc_ur", "entidad_federativa", "desc_capitulo", "desc_concepto", "desc_ff",
          "desc_funcion", "desc_pp", "id_ur")
_MODEL_ROWS = "monto_modificado > 0 AND flag_registro_valido AND tipo_gasto = 'PROGRAMABLE'"
_SIZES = (f"sizes AS (SELECT alta_ejecucion, count(*) AS m, sum(count(*)) OVER () AS n "
          f"FROM clean WHERE {_MODEL_ROWS} GROUP BY alta_ejecucion)")
_COUNTS = "counts AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, {c} AS value, count(*) AS n FROM clean WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in TEXTS) + ")"
_REG = ("avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, "
        "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2")
_LINES = ("lines_scored AS (SELECT l_returnflag = 'R' AS y, l_discount > 0.05e0 AS p, "
          "round(l_discount * 100 + l_tax * 100) AS s FROM lineitem)")


def _with(sql: str) -> str:
    """Add a common table to the clean chain."""
    return on_clean("").rstrip() + ",\n" + sql


def learning_oracle() -> dict[str, str]:
    numbers = ("monto_modificado", "monto_aprobado", "id_capitulo")
    mid = ", ".join(f"quantile_cont({c}, 0.5) AS q_{c}" for c in numbers)
    filled = ", ".join(f"coalesce({c}, q_{c}) AS {c}" for c in numbers)
    stats = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in numbers)
    z = ", ".join(f"round(({c} - a_{c}) / s_{c}, 6) AS num_{c}" for c in numbers)
    fit = f"fit AS (SELECT * FROM clean WHERE {_MODEL_ROWS})"
    fit_counts = _COUNTS.replace("FROM clean", "FROM fit")
    placed = ("placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS place, "
              "count(*) OVER (PARTITION BY name) AS levels FROM counts)")
    kept = f"(levels <= {fixed.MAX_LEVELS} OR place < {fixed.MAX_LEVELS})"
    prepared = " UNION ALL ".join(
        f"SELECT 'txt_{c}' AS name, CASE WHEN k.value IS NULL THEN '*unseen' WHEN k.kept THEN k.value ELSE '*pooled' END AS value, count(*) AS n "
        f"FROM clean LEFT JOIN (SELECT value, {kept} AS kept FROM placed WHERE name = '{c}') k ON clean.{c} = k.value GROUP BY 1, 2"
        for c in TEXTS)
    folds = ("SELECT model, fold, " + _REG + " FROM (SELECT 'tax' AS model, l_linenumber AS fold, l_discount AS y, l_tax AS p FROM lineitem "
             "UNION ALL SELECT 'flat', l_linenumber, l_discount, 0.05e0 FROM lineitem "
             "UNION ALL SELECT 'blend', l_linenumber, l_discount, l_tax / 2 + 0.03e0 FROM lineitem) GROUP BY model, fold")
    o = {
        "standardise": _with(
            f"mid AS (SELECT {mid} FROM clean), filled AS (SELECT id_clave_cartera, {filled} FROM clean, mid), "
            f"stats AS (SELECT {stats} FROM filled) SELECT id_clave_cartera, {z} FROM filled, stats"),
        "impute_mode": _with(
            f"{_COUNTS} SELECT name, first(value ORDER BY n DESC, value) AS mode, count(*) AS levels FROM counts GROUP BY name"),
        "onehot_levels": _with(
            f"{_COUNTS}, {placed} SELECT name, value, n, place, levels > {fixed.MAX_LEVELS} AS pooled FROM placed WHERE {kept}"),
        "metrics_regression": "SELECT " + _REG.replace("avg(abs(y - p))", "round(avg(abs(y - p)), 6)")
        .replace("sqrt(avg((y - p) * (y - p)))", "round(sqrt(avg((y - p) * (y - p))), 6)")
        .replace("1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))", "round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6)")
        + " FROM (SELECT l_discount AS y, l_tax AS p FROM lineitem)",
        "metrics_classification": f"WITH {_LINES}, c AS (SELECT count(*) FILTER (WHERE y AND p) AS tp, "
        "count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn FROM lines_scored) "
        "SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM c",
        "metrics_auc_ap": f"WITH {_LINES}, g AS (SELECT s, count(*) FILTER (WHERE y) AS pos, count(*) AS n FROM lines_scored GROUP BY s), "
        "r AS (SELECT pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS taken FROM g WINDOW w AS (ORDER BY s DESC)) "
        "SELECT round(sum((n - pos) * (tp - pos + pos / 2)) / sum(pos) / sum(n - pos), 6) AS roc_auc, "
        "round(sum(pos * (tp / taken)) / sum(pos), 6) AS pr_auc FROM r",
        "cv_summary": f"WITH f AS ({folds}) " + " UNION ALL ".join(
            f"SELECT 'tax' AS model, '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM f WHERE model = 'tax'"
            for m in ("mae", "rmse", "r2")),
        "rank_models": f"WITH f AS ({folds}) SELECT model, round(avg(rmse), 6) AS rmse_mean, round(avg(r2), 6) AS r2_mean FROM f GROUP BY model",
        "split_stratified": _with(
            f"{_SIZES}, q AS (SELECT *, n - ceil(n * 0.2e0) AS k FROM sizes), "
            "g AS (SELECT *, CAST(floor(m * k / n) AS BIGINT) AS low, row_number() OVER (ORDER BY (m * k) % n DESC, alta_ejecucion) AS rk FROM q), "
            "t AS (SELECT alta_ejecucion, m, CAST(low + CASE WHEN rk <= k - (SELECT sum(low) FROM g) THEN 1 ELSE 0 END AS BIGINT) AS kept FROM g) "
            "SELECT alta_ejecucion, kept AS n, 'train' AS part FROM t UNION ALL SELECT alta_ejecucion, m - kept, 'test' FROM t"),
        "folds": _with(
            f"pos AS (SELECT alta_ejecucion, (row_number() OVER (ORDER BY alta_ejecucion) - 1) % 5 AS fold FROM clean WHERE {_MODEL_ROWS}) "
            "SELECT fold, alta_ejecucion, count(*) AS n FROM pos GROUP BY fold, alta_ejecucion"),
        "sample_stratified": _with(
            f"{_SIZES} SELECT alta_ejecucion, CAST(greatest(1, round_even(3000 * m / n, 0)) AS BIGINT) AS n FROM sizes"),
    }
    sizes = ("SELECT count(*) AS n, count({t}) AS known, count({t}) - CAST(ceil(count({t}) * 0.2e0) AS BIGINT) AS train FROM fit")
    facts = " UNION ALL ".join(
        f"SELECT '{task}' AS task, '{fact}' AS fact, {value} AS value FROM ({sizes.format(t=target)})"
        for task, target in (("regression", fixed.REGRESSION_TARGET), ("classification", fixed.CLASSIFICATION_TARGET))
        for fact, value in (
            ("n_samples", "CAST(known AS VARCHAR)"), ("n_train", "CAST(train AS VARCHAR)"),
            ("n_test", "CAST(known - train AS VARCHAR)"), ("n_without_target", "CAST(n - known AS VARCHAR)"),
            ("cv_folds", f"'{CONFIG.n_folds}'"), ("target", f"'{target}'")))
    o["train_facts"] = _with(f"{fit} {facts}")
    o["train_shape"] = (
        "SELECT task, model, stage, CAST(m AS BIGINT) AS metrics, CAST(m AS BIGINT) AS placed FROM (VALUES ('regression', 'elasticnet', 3), "
        "('regression', 'hist_gbr', 3), ('classification', 'logistic_balanced', 5), ('classification', 'hist_gbc', 5)) t(task, model, m), "
        "(VALUES ('cv'), ('test')) s(stage)")
    o["train_shape_full"] = (
        "SELECT task, model, stage, CAST(m AS BIGINT) AS metrics, CAST(m AS BIGINT) AS placed FROM (VALUES ('regression', 'elasticnet', 3), "
        "('regression', 'hist_gbr', 3), ('regression', 'random_forest', 3), ('classification', 'logistic_balanced', 5), "
        "('classification', 'hist_gbc', 5), ('classification', 'random_forest', 5)) t(task, model, m), (VALUES ('cv'), ('test')) s(stage)")
    o["score_checks"] = _with(
        "done AS (SELECT count(*) AS n FROM clean) SELECT task, n, n AS n_good, true AS reload_equals_memory "
        "FROM done, (VALUES ('regression'), ('classification')) t(task)")
    o["feature_kinds"] = _with(fit + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{kind}' AS kind, count({c}) AS known, false AS leaks FROM fit"
        for kind, names in (("numeric", _NUMBERS), ("categorical", _WORDS)) for c in names))
    o["targets_known"] = _with(fit + " " + " UNION ALL ".join(
        f"SELECT '{t}' AS target, count(*) AS n, count({t}) AS known FROM fit"
        for t in (fixed.REGRESSION_TARGET, fixed.CLASSIFICATION_TARGET)))
    outputs = f"CAST({len(_NUMBERS)} + " + " + ".join(f"least(count(DISTINCT {c}), {fixed.MAX_LEVELS})" for c in _WORDS) + " AS BIGINT)"
    o["assembled"] = _with(f"{fit} SELECT count(*) AS n, {outputs} AS outputs, CAST(count(*) * {len(_WORDS)} AS BIGINT) AS hot FROM fit")
    o["folds_fast"] = _with(f"{fit}, pos AS (SELECT (row_number() OVER () - 1) % 3 AS fold FROM fit) SELECT fold, count(*) AS n FROM pos GROUP BY fold")
    for name, target in (("elastic_net_optimal", fixed.REGRESSION_TARGET), ("logistic_optimal", fixed.CLASSIFICATION_TARGET)):
        o[name] = _with(f"{fit} SELECT count(*) AS n, {outputs} AS outputs, true AS optimal FROM fit WHERE {target} IS NOT NULL")
    o["onehot_prepared"] = _with(f"{fit}, {fit_counts}, {placed} {prepared}")
    return o
