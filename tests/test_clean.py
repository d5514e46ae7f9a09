import math

import pytest
from lines import COLUMNS, line, write_csv
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from erario import fixed
from erario.functions.parsing import number, stripped, whole
from erario.operators.clean import clean, typed, with_derived
from erario.operators.filters import apply_filter, chosen, equalities
from erario.sources.raw import read_raw_csv, split_records
from erario.sources.tables import load_clean, load_modelling_frame, load_olap_source, run_cleaning


def frame(spark, rows):
    return spark.createDataFrame(rows, "ciclo long, monto_aprobado double, monto_modificado double, monto_pagado double")


@pytest.mark.parametrize(
    "mod, paid, band",
    [(100.0, None, "sin_base"), (100.0, 0.0, "baja"), (100.0, 49.0, "baja"), (100.0, 50.0, "media"),
     (100.0, 79.0, "media"), (100.0, 80.0, "alta"), (100.0, 100.0, "alta"), (100.0, 101.0, "sobre"),
     (0.0, 10.0, "sin_base"), (-5.0, 10.0, "sin_base"), (None, 10.0, "sin_base"), (100.0, -1.0, "sin_base")],
)
def test_bands(spark, mod, paid, band):
    got = with_derived(frame(spark, [(2026, 1.0, mod, paid)])).first()
    assert got["banda_ejecucion"] == band


def test_flags_are_never_null_and_nan_never_enters(spark):
    nan = float("nan")
    rows = [(2026, nan, nan, nan), (None, None, None, None), (2026, 10.0, 100.0, nan)]
    for r in clean(frame(spark, rows)).df.collect():
        for f in ("flag_montos_negativos", "flag_modificado_cero", "flag_modificado_negativo",
                  "sin_pago", "alta_ejecucion", "sobre_ejecucion", "flag_registro_valido"):
            assert r[f] in (True, False)
        assert not r["alta_ejecucion"] and not r["sobre_ejecucion"]
        assert r["ratio_ejecucion"] is None and r["log1p_monto_pagado"] is None


def test_unpaid_band_option_and_log_floor(spark):
    df = frame(spark, [(2026, 0.0, 100.0, 0.0), (2026, 50.0, 100.0, -3.0)])
    rows = with_derived(df, unpaid_band=True).orderBy("monto_aprobado").collect()
    assert rows[0]["banda_ejecucion"] == "sin_pago" and rows[0]["sin_pago"]
    assert rows[0]["ratio_aprobado"] is None and rows[1]["ratio_aprobado"] == -0.06
    assert rows[1]["log1p_monto_pagado"] == 0.0 and rows[1]["flag_montos_negativos"]


def test_missing_modified_amount_is_still_valid(spark):
    a, b = with_derived(frame(spark, [(2026, 1.0, None, 1.0), (None, 1.0, 1.0, 1.0)])).collect()
    assert a["flag_registro_valido"] and not b["flag_registro_valido"]


def test_numbers(spark):
    texts = ["12", " 1.5 ", "-3e2", "1.5d", "0x10", "1,000", "abc", "", ".5", "7."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(number(F.col("t"))).collect()]
    assert got == [12.0, 1.5, -300.0, None, None, None, None, None, 0.5, 7.0]


def test_whole_numbers(spark):
    df = spark.createDataFrame([("2026.0",), ("9007199254740993",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(whole(F.col("t"), "t")).collect()] == [2026, 9007199254740993, None, None]
    with pytest.raises(PySparkException, match="not a whole number"):
        spark.createDataFrame([("2026.5",)], "t string").select(whole(F.col("t"), "t")).collect()


def test_strip_equals_python(spark):
    texts = ["  a b ", " x　", "\u001cz\u001f", " q\n", "", "\t", "é\u0085", "plain", "​k"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(stripped(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_missing_text(spark):
    df = spark.createDataFrame([(None,), (" a ",)], "desc_ur string")
    assert [r[0] for r in typed(df).collect()] == [None, "a"]
    assert [r[0] for r in typed(df, null_text="nan").collect()] == ["nan", "a"]


def test_duplicates_appear_only_after_trimming(spark):
    df = spark.createDataFrame([("2026", "A"), ("2026", "A "), ("2026.0", "A"), (None, "A"), (None, "A")],
                               "ciclo string, desc_ur string")
    amounts = {a: F.lit("1") for a in fixed.AMOUNTS}
    result = clean(df.withColumns(amounts))
    assert result.df.count() == 2 and result.duplicates() == 3


def test_filters(spark):
    df = with_derived(frame(spark, [(2026, 1.0, 5.0, 1.0), (2026, 1.0, 0.0, 1.0), (2026, -1.0, 5.0, 1.0)]))
    df = df.withColumn("tipo_gasto", F.lit("PROGRAMABLE"))
    sizes = {n: apply_filter(df, n).count() for n in (
        "filtro_olap", "filtro_modelado_ratio", "filtro_modelado_programable", "filtro_clasificacion_sin_pago")}
    assert list(sizes.values()) == [2, 1, 1, 1]
    with pytest.raises(ValueError, match="filtro_olap"):
        apply_filter(df, "other")


def test_equality_filters_take_the_column_type(spark):
    df = spark.createDataFrame([("U4", 4), ("5", 5)], "id_ur string, id_ramo long")
    assert equalities(df, {"id_ur": 5}).first()["id_ramo"] == 5
    assert equalities(df, {"id_ramo": "4"}).first()["id_ur"] == "U4"
    assert chosen({"a": 1, "b": None, "c": 3}, ("a", "b")) == {"a": 1}


def test_csv_encodings_and_missing_tokens(spark, tmp_path):
    rows = [line(1, desc_ramo="Educación Pública"), line(2, id_ur="N/A", desc_ur='dijo "sí", y más')]
    plain = read_raw_csv(spark, write_csv(tmp_path / "u.csv", rows)).orderBy("id_clave_cartera").collect()
    latin = read_raw_csv(spark, write_csv(tmp_path / "l.csv", rows, "latin-1")).orderBy("id_clave_cartera").collect()
    assert plain == latin
    assert plain[0]["desc_ramo"] == "Educación Pública"
    assert plain[1]["id_ur"] is None and plain[1]["desc_ur"] == 'dijo "sí", y más'


def test_csv_with_quoted_line_end(spark, tmp_path):
    path = write_csv(tmp_path / "q.csv", [line(1, desc_ur="dos\nlíneas"), line(2)])
    df = read_raw_csv(spark, path)
    assert df.count() == 2 and df.filter(F.col("desc_ur").contains("\n")).count() == 1


def test_quoted_line_ends_at_split_borders(spark, tmp_path):
    """Records run over the borders of splits, some over whole splits; every split is a task."""
    import csv
    import random

    rng = random.Random(3)
    words = ["a", "b c", "d,e", 'f "g"', "h\ni", "j\r\nk", "\n", "", "ñ" * 30, "x\n" * 60, '"', '""\n"']
    rows = {n: [[f"{n}{i}", *(rng.choice(words) for _ in range(3))] for i in range(80)] for n in "pq"}
    for name, table in rows.items():
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\r\n" if name == "q" else "\n")
            out.writerow(["id", "one", "two", "three"])
            out.writerows(table)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        df = read_raw_csv(spark, str(tmp_path))
        got = sorted(tuple(r) for r in df.collect())
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        assert tasks > 40 and split_records(spark, str(tmp_path)).count() == 162
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(tuple(x or None for x in r) for table in rows.values() for r in table)


def test_stray_quotes_are_left_to_the_whole_parser(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,size\n1,5" pipe\n2,"two\nlines"\n3,7\n')
    assert [tuple(r) for r in read_raw_csv(spark, str(tmp_path)).orderBy("id").collect()] == [
        ("1", '5" pipe'), ("2", "two\nlines"), ("3", "7")]


def test_no_csv(spark):
    with pytest.raises(FileNotFoundError):
        read_raw_csv(spark, "/nowhere/x.csv")


def test_cleaning_stage(spark, tmp_path, store):
    rows = [line(i) for i in range(12)]
    rows += [line(3, desc_ur="Unidad 1 "), line(20, monto_pagado="-4"), line(21, tipo_gasto="NO PROGRAMABLE"),
             line(22, monto_modificado="x")]
    csv = write_csv(tmp_path / "raw.csv", rows)
    done = run_cleaning(read_raw_csv(spark, csv), store)
    assert len(done.clean.columns) == len(COLUMNS) + len(fixed.DERIVED) == 49
    assert (done.clean.count(), done.analytic.count(), done.duplicates) == (15, 12, 1)
    found = {(r["stage"], r["section"], r["column"], r["metric"]): r["value"] for r in done.profile.collect()}
    assert found["entrada", "forma", "", "n_filas"] == 16
    assert found["entrada", "forma", "", "duplicados_exactos"] == 0
    assert found["limpio", "forma", "", "duplicados_eliminados"] == 1
    assert found["limpio", "nulos", "monto_modificado", "nulos"] == 1
    assert found["limpio", "banda_ejecucion", "banda_ejecucion", "sin_pago"] == 0
    assert found["limpio", "filtros_analiticos_n_filas", "filtro_olap", "n"] == 14
    assert found["entrada", "montos", "monto_pagado", "negativos"] == 1
    assert found["limpio", "cardinalidad", "id_ur", "distintos"] == 2
    assert math.isclose(found["limpio", "montos", "monto_aprobado", "min"], 100.25)
    assert load_clean(spark, store).count() == 15
    assert load_olap_source(spark, store).count() == 14
    assert load_modelling_frame(spark, store).count() == 12


def test_modelling_frame_falls_back_to_csv(spark, tmp_path, store):
    csv = write_csv(tmp_path / "raw.csv", [line(i) for i in range(5)])
    assert load_modelling_frame(spark, store, csv=csv).count() == 5
    with pytest.raises(FileNotFoundError):
        load_modelling_frame(spark, store)


def test_fractional_ids_and_numbers_out_of_range(spark):
    rows = [("2020", "1", "12.5", "1e400"), ("2020", "2", "3", "inf"), ("2020", "3", "n/d", "7")]
    df = spark.createDataFrame(rows, "ciclo string, id_clave_cartera string, id_pp string, monto_pagado string")
    out = typed(df)
    assert dict(out.dtypes)["id_pp"] == "double"
    got = {r["id_clave_cartera"]: (r["id_pp"], r["monto_pagado"]) for r in out.collect()}
    assert got == {1: (12.5, None), 2: (3.0, None), 3: (None, 7.0)}
    assert dict(typed(df.where("id_pp <> '12.5'")).dtypes)["id_pp"] == "bigint"


def test_large_money_adds_up(spark):
    from erario.functions.measures import total

    df = spark.createDataFrame([(1.5e18,)] * 10 + [(-0.25,), (0.75,), (3e19,)], "v double")
    assert df.agg(total(F.col("v"))).head()[0] == 4.5e19
    assert df.where("v < 1").agg(total(F.col("v"))).head()[0] == 0.5


def test_constants_hold_on_an_empty_frame(spark):
    from erario.plans.profile import filter_measures, shape_measures, tidy

    df = clean(spark.createDataFrame([], "ciclo string, id_clave_cartera string, tipo_gasto string, monto_modificado double, monto_pagado double, monto_aprobado double")).df
    rows = tidy(df, [*shape_measures(df), *filter_measures()]).where("section in ('umbrales', 'columnas') or metric = 'n_columnas'").collect()
    assert rows and all(r["value"] is not None for r in rows)
