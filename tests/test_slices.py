import pytest
from pyspark.sql import functions as F

from erario import fixed, store as stores
from erario.operators.clean import clean, clean_slices
from erario.operators.numbering import number_rows, numbered_slices
from erario.plans import star
from erario.sources.tables import run_cleaning
from erario.store import Store


def lines(spark, n=400):
    """Budget lines with copies, and some without a key or a text."""
    i = F.pmod(F.col("id"), F.lit(n * 3 // 4))
    return spark.range(0, n, 1, 3).select(
        (2020 + i % 3).alias("ciclo"), F.when(i % 13 != 0, i % 90).alias("id_clave_cartera"),
        (i % 4).alias("id_ramo"), F.when(i % 7 != 0, F.concat(F.lit("R"), (i % 4).cast("string"))).alias("desc_ramo"),
        F.when(i % 2 == 0, "PROGRAMABLE").otherwise("NO PROGRAMABLE").alias("tipo_gasto"),
        (i % 50).cast("double").alias("monto_aprobado"), (i % 50 + 1).cast("double").alias("monto_modificado"),
        (i % 50 / 2).alias("monto_pagado"))


def ordered(df):
    return sorted(map(tuple, df.collect()), key=str)



def test_slices_of_clean_rows_are_all_of_them(spark, store):
    df = lines(spark)
    parts = list(clean_slices(df, 5))
    assert max(p.count() for p in parts) < clean(df).df.count()
    table = store.save_slices(parts, "limpio")
    assert ordered(table) == ordered(clean(df).df) and store.has("limpio")


def test_a_table_counts_as_written_with_its_last_slice(spark, store):
    def slices():
        yield spark.range(3)
        assert store.load("part").count() == 3 and not store.has("part")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        store.save_slices(slices(), "part")
    assert not store.has("part")


def test_numbers_run_on_from_slice_to_slice(spark, store):
    df = clean(lines(spark)).df.select("desc_ramo", "ciclo", "id_clave_cartera", "monto_aprobado")
    order = ["desc_ramo", "ciclo", "id_clave_cartera", "monto_aprobado"]
    kept = [s.collect() for s in numbered_slices(df, order, "n", 50)]
    assert len(kept) > 2
    whole = number_rows(df, order, "n", store).collect()
    assert sorted((tuple(r) for rows in kept for r in rows)) == sorted(map(tuple, whole))


def test_a_warehouse_built_in_slices_is_the_same(spark, store, tmp_path, monkeypatch):
    table = store.save(clean(lines(spark)).df, "limpio")
    whole = star.build_warehouse(table, Store(spark, str(tmp_path / "a")))
    staged = []
    save = Store.save

    def seen(self, df, *args, **kwargs):
        out = save(self, df, *args, **kwargs)
        if "__part" in df.columns and "tiempo_sk" in df.columns:
            staged.append(out.count())
        return out

    monkeypatch.setattr(Store, "save", seen)
    monkeypatch.setattr(star, "SLICE_ROWS", 60)
    parts = star.build_warehouse(table, Store(spark, str(tmp_path / "b")))
    assert ordered(parts.fact) == ordered(whole.fact)
    assert all(ordered(parts.dims[d]) == ordered(whole.dims[d]) for d in whole.dims)
    assert len(staged) > 2 and max(staged) <= 120  # never all rows at once


def test_cleaning_in_slices_gives_the_same_tables(spark, tmp_path, monkeypatch):
    raw = lines(spark).select(*[F.col(c).cast("string").alias(c) for c in lines(spark).columns])
    whole = run_cleaning(raw, Store(spark, str(tmp_path / "a")))
    monkeypatch.setattr(stores, "SLICE_BYTES", 2000)
    parts = run_cleaning(raw, Store(spark, str(tmp_path / "b")))
    assert parts.duplicates == whole.duplicates > 0
    for a, b in ((parts.clean, whole.clean), (parts.analytic, whole.analytic), (parts.profile, whole.profile)):
        assert ordered(a) == ordered(b)
    assert fixed.LINE_KEY in parts.clean.columns
