import pytest
from lines import COLUMNS, line
from pyspark.sql import functions as F

from erario import fixed
from erario.operators.clean import clean
from erario.operators.lookup import null_safe_lookup, require_matched, require_unique
from erario.plans.star import (
    build_warehouse,
    fact_rows,
    load_warehouse,
    orphans,
    warehouse_report,
)
from erario.plans.views import modelling_star, register_views, star, star_columns, view
from erario.spec import DimSpec, StarSpec


def raw(spark, rows):
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    return spark.createDataFrame([[r[c] for c in COLUMNS] for r in rows], schema)


@pytest.fixture(scope="module")
def wh(spark, tmp_path_factory):
    from erario.store import Store

    rows = [line(i) for i in range(40)]
    rows += [line(50, ciclo=None), line(51, id_ramo=None, desc_ramo=None), line(52, monto_pagado="-1"),
             line(53, id_ramo="0", desc_ramo="Otro nombre"), line(54, ciclo="2025", monto_modificado="0"),
             line(55, desc_ur=None, monto_modificado=None)]
    out = Store(spark, str(tmp_path_factory.mktemp("wh")))
    return build_warehouse(clean(raw(spark, rows)).df, out), out


def test_full_shape(wh):
    w, _ = wh
    assert len(w.fact_table().columns) == 24
    assert len(star_columns(w)) == 47
    # The modelling star adds seven keys and the logarithm to the cube.
    assert len(modelling_star(w).columns) == 55
    assert w.spec == StarSpec.full()


def test_no_row_is_lost_and_keys_are_dense(wh):
    w, _ = wh
    assert w.fact.count() == star(w).count() == 45
    assert w.fact.count() == view(w, "global").agg(F.sum("n_registros")).first()[0]
    numbers = sorted(r[0] for r in w.fact.select("fact_sk").collect())
    assert numbers == list(range(1, 46))
    for d in w.spec.dims:
        sks = sorted(r[0] for r in w.dims[d.name].select(d.sk).collect())
        assert sks == list(range(1, len(sks) + 1))


def test_null_period_survives_the_folder_layout(wh):
    w, _ = wh
    assert w.fact.filter("ciclo IS NULL").count() == 1
    assert w.dims["dim_tiempo"].filter("ciclo IS NULL").first()["tiempo_sk"] == 3
    got = {r["ciclo"]: r["n_registros"] for r in view(w, "global").collect()}
    assert got == {2026: 43, 2025: 1, None: 1}


def test_report_and_orphans(wh):
    w, _ = wh
    rows = warehouse_report(w, 10).collect()
    assert all(r["ok"] for r in rows) and len(rows) == 10
    assert not any(r["ok"] for r in warehouse_report(w, 7).collect())
    assert sum(r["orphan_rows"] for r in orphans(w).collect()) == 0


def test_reload(spark, wh):
    w, out = wh
    again = load_warehouse(spark, out)
    assert again.spec == w.spec and again.fact.schema == w.fact.schema
    assert sorted(again.fact.collect(), key=str) == sorted(w.fact.collect(), key=str)


def test_reload_needs_a_warehouse(spark, store):
    with pytest.raises(FileNotFoundError):
        load_warehouse(spark, store)


def test_branch_with_two_names_repeats_its_units(wh):
    """Number 0 has two names: rows of its units appear under both.  A unit without a
    branch number appears under none."""
    w, _ = wh
    by_unit = view(w, "ur")
    doubled = {r["desc_ramo"] for r in by_unit.filter("id_ramo = 0").select("desc_ramo").collect()}
    assert doubled == {"Ramo 0", "Otro nombre"}
    pairs = by_unit.filter("id_ramo = 0").groupBy("ur_sk", "ciclo").agg(
        F.count("*").alias("n"), F.countDistinct("n_registros").alias("d")).collect()
    assert all((r["n"], r["d"]) == (2, 1) for r in pairs)
    assert by_unit.filter("id_ramo IS NULL").count() == 0
    total = by_unit.agg(F.sum("n_registros")).first()[0]
    zero = w.fact.join(w.dims["dim_ur"].filter("id_ramo = 0"), "ur_sk").count()
    assert total == w.fact.count() - 1 + zero


def test_weighted_ratio_counts_every_payment_over_positive_bases(wh):
    w, _ = wh
    row = view(w, "global").filter("ciclo = 2025").first()
    assert row["ratio_ejecucion_ponderado"] is None and row["base_modificado_positivo"] == 0.0
    row = view(w, "global").filter("ciclo = 2026").first()
    paid, base = w.fact.filter("ciclo = 2026").agg(
        F.sum("monto_pagado"), F.sum(F.when(F.col("monto_modificado") > 0, F.col("monto_modificado")))).first()
    assert row["ratio_ejecucion_ponderado"] == pytest.approx(paid / base)


def test_label_grain_merges_keys(wh):
    w, _ = wh
    fine, coarse = view(w, "programa"), view(w, "programa", "label")
    assert fine.count() >= coarse.count()
    assert fine.agg(F.sum("n_registros")).first() == coarse.agg(F.sum("n_registros")).first()
    assert "func_sk" not in coarse.columns


def test_null_keys_meet(spark):
    left = spark.createDataFrame([(None, "x"), ("a", None), ("b", "c")], "k1 string, k2 string")
    dim = spark.createDataFrame([(None, "x", 1), ("a", None, 2)], "k1 string, k2 string, sk long")
    got = {(r["k1"], r["k2"]): r["sk"] for r in null_safe_lookup(left, dim, ["k1", "k2"], "sk").collect()}
    assert got == {(None, "x"): 1, ("a", None): 2, ("b", "c"): None}


def test_checks_raise(spark):
    spec = [DimSpec("dim_x", "sk", ("k",), ("k",))]
    with pytest.raises(ValueError, match="dim_x"):
        require_unique({"dim_x": spark.createDataFrame([(1, 1), (1, 2)], "k int, sk int")}, spec)
    with pytest.raises(RuntimeError, match="sk"):
        require_matched(spark.createDataFrame([(None,)], "sk long"), ["sk"])


def test_dimensions_too_large_to_broadcast_give_the_same_fact(spark, wh, monkeypatch):
    w, _ = wh
    names = [k for d in w.spec.dims for k in d.keys]
    source = star(w, list(dict.fromkeys([*star_columns(w), "fact_sk"]))).withColumn(
        "log1p_monto_pagado", F.log1p("monto_pagado"))
    assert set(names) <= set(source.columns)
    plain = fact_rows(source, w.dims, w.spec, bound=0)
    hinted = fact_rows(source, w.dims, w.spec)
    assert sorted(plain.collect(), key=str) == sorted(hinted.collect(), key=str)


def test_views_answer_sql(spark, wh):
    w, _ = wh
    assert len(register_views(spark, w)) == 10
    assert spark.sql("SELECT sum(n_registros) FROM vw_olap_ejecucion_por_banda").first()[0] == 45
    assert spark.sql("SELECT count(*) FROM fact_ejecucion WHERE ramo_sk IS NULL").first()[0] == 0


def test_member_bands(wh):
    w, _ = wh
    known = {r[0] for r in w.fact.select("banda_ejecucion").distinct().collect()}
    assert known <= set(fixed.BANDS)
