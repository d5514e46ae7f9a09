import numpy as np
import pytest
from pyspark.sql import functions as F

from erario.operators.numbering import hash_cuts, number_rows, row_hash, running_totals
from erario.operators.quantiles import quantiles
from erario.modelling.split import split
from erario.plans.profile import band_counts, duplicate_rows, ratio_histogram


def skewed(spark, n=3000):
    """A third of the rows share one value; some are missing."""
    v = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 50 == 1, None).otherwise(
        F.pmod(F.hash("id"), F.lit(997)).cast("double"))
    return spark.range(0, n, 1, 5).select("id", v.alias("v"))


def test_numbering_equals_a_global_order(spark, store):
    df = skewed(spark)
    got = {r["id"]: r["n"] for r in number_rows(df, ["v", "id"], "n", store).collect()}
    rows = sorted(df.collect(), key=lambda r: (r["v"] is None, r["v"] or 0, r["id"]))
    assert got == {r["id"]: i + 1 for i, r in enumerate(rows)}


def test_numbering_of_nothing(spark, store):
    assert number_rows(spark.range(0), ["id"], "n", store).count() == 0


def test_numbering_is_spread_over_tasks(spark, store):
    """With many rows and no coalescing, several tasks share the order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = skewed(spark, 20000)
        numbered = number_rows(df, ["v", "id"], "n", store)
        part = spark.read.parquet(f"{store.root}/tmp-*").select("__part").distinct().count()
        assert part > 4
        assert numbered.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (1, 20000, 20000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals(spark, store):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 1000, 1, 4).select((1000 - F.col("id")).alias("k"), F.lit(2).cast("long").alias("x"))
        got = running_totals(df, [F.col("k").desc()], {"x": "upto"}, store).collect()
        assert all(r["upto"] == 2 * (1001 - r["k"]) for r in got) and len(got) == 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("buffered", [0, 300, 10**6])
def test_quantiles_equal_numpy(spark, store, buffered):
    df = skewed(spark)
    probs = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {
        (r["name"], r["prob"]): r["value"]
        for r in quantiles(df, {"v": F.col("v"), "none": F.lit(None).cast("double")}, probs, store, buffered).collect()
    }
    values = np.array([r["v"] for r in df.collect() if r["v"] is not None])
    for p in probs:
        assert got["v", p] == pytest.approx(np.quantile(values, p), abs=1e-9)
        assert got["none", p] is None
    assert len(got) == 12


def test_quantiles_narrow_many_rows(spark, store):
    """Three rounds at a bound of 200, on values from evenly spread to a third equal."""
    df = spark.range(0, 40000, 1, 6).select(
        (F.pmod(F.hash("id"), F.lit(100003)) / 7).alias("spread"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.hash("id"), F.lit(11)).cast("double")).alias("hot"),
        F.lit(2.5).alias("same"), (-F.col("id") ** 3).alias("tail"))
    probs = [0.0, 0.001, 0.5, 0.66, 0.999, 1.0]
    got = {(r["name"], r["prob"]): r["value"]
           for r in quantiles(df, {c: F.col(c) for c in df.columns}, probs, store, 200).collect()}
    data = df.toPandas()
    for c in df.columns:
        for p in probs:
            assert got[c, p] == pytest.approx(np.quantile(data[c], p), rel=1e-12, abs=1e-9)


def test_a_misleading_sample_cannot_change_a_quantile(spark, store, monkeypatch):
    import erario.operators.quantiles as q

    monkeypatch.setattr(q, "_DEVIATIONS", 0)
    df = spark.range(0, 5000, 1, 3).select(F.pmod(F.hash("id"), F.lit(999)).cast("double").alias("v"))
    got = [r["value"] for r in quantiles(df, {"v": F.col("v")}, [0.1, 0.5, 0.9], store, 50).collect()]
    assert got == pytest.approx(list(np.quantile(df.toPandas()["v"], [0.1, 0.5, 0.9])))


def test_approximate_quantiles(spark, store):
    row = quantiles(skewed(spark), {"v": F.col("v")}, [0.5], store, accuracy=1000).first()
    assert 0 <= row["value"] <= 997


def test_hash_cuts_hold_exactly_the_wanted_rows(spark):
    df = skewed(spark).withColumn("c", F.col("id") % 10 == 0)
    cuts = hash_cuts(df, ["id"], 1, {True: [1, 60, 300], False: [5, 2700]}, F.col("c"))
    assert len(cuts) == 5
    for cut in cuts:
        inside = df.filter((F.col("c") == cut.label) & (row_hash(["id"], 1) <= cut.hash)).count()
        assert inside == cut.rank


def test_hash_cuts_of_copies(spark):
    """Copies of one row fall together; the cut holds at least the wanted number."""
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    (cut,) = hash_cuts(df, ["k"], 1, {"all": [500]})
    assert df.filter(row_hash(["k"], 1) <= cut.hash).count() >= 500


@pytest.mark.parametrize("broadcast_hashes", [0, 1000])
def test_duplicates_of_a_hot_row(spark, store, broadcast_hashes):
    df = spark.range(900).select(
        F.when(F.col("id") < 300, None).otherwise(F.col("id") % 590).alias("k"), F.lit("x").alias("t"))
    rows = [tuple(r) for r in df.collect()]
    got = duplicate_rows(df, store, broadcast_hashes).first()["value"]
    assert got == len(rows) - len(set(rows)) > 299


def test_hash_twins_are_not_duplicates(spark, store):
    """A null is skipped by the hash, so these two rows share one."""
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert df.select(F.xxhash64("x", "y")).distinct().count() == 1
    assert duplicate_rows(df, store).first()["value"] == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 0.5), (1.0, 2.0), (1.0, 9.0), (0.0, 1.0), (1.0, None)],
                               "monto_modificado double, ratio_ejecucion double")
    rows = sorted(ratio_histogram(df, 4).collect())
    assert [(r["bin"], r["bin_start"], r["n"]) for r in rows] == [(0, 0.0, 1), (1, 0.5, 1), (2, 1.0, 0), (3, 1.5, 2)]
    flat = ratio_histogram(df.filter("ratio_ejecucion = 0.5"), 4).collect()
    assert sum(r["n"] for r in flat) == 1


def test_empty_bands_are_listed(spark):
    df = spark.createDataFrame([("alta",), ("alta",), ("sobre",)], "banda_ejecucion string")
    assert [r["n"] for r in sorted(band_counts(df).collect(), key=lambda r: r["banda_orden"])] == [0, 0, 0, 0, 2, 1]


def test_null_keys_are_told_apart(spark):
    rows = [(None, str(i)) for i in range(1000)] + [(str(i), None) for i in range(1000)]
    df = spark.createDataFrame(rows, "a string, b string")
    train, test = split(df, ["a", "b"], 0.2, 1)
    assert (train.count(), test.count()) == (1600, 400)


def test_both_sides_of_the_bound_give_equal_bits(spark, store):
    df = skewed(spark)
    probs = [i / 20 for i in range(21)]
    few, many = (
        {r["prob"]: r["value"] for r in quantiles(df, {"v": F.col("v")}, probs, store, bound).collect()}
        for bound in (10**9, 200)
    )
    assert few == many
