"""Physical plans: what may be broadcast, what reaches the scan, and no single-task sort."""

import contextlib
import io

import pytest
from lines import SF

from erario.plans.olap import query_axis, query_star
from erario.plans.star import fact_rows
from erario.plans.views import star, view
from erario.sources.lens import lens
from erario_checks.workload import Stage


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def stage(spark):
    return Stage.of(spark, SF)


def test_lookup_broadcasts_small_dimensions(stage):
    wh = stage.warehouse
    text = plan(fact_rows(stage.clean, wh.dims, wh.spec))
    assert text.count("BroadcastHashJoin LeftOuter") == 7 and "SortMergeJoin" not in text


def test_lookup_shuffles_large_dimensions(stage):
    wh, text = stage.warehouse, None
    spark = stage.spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(fact_rows(stage.clean, wh.dims, wh.spec, bound=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("SortMergeJoin LeftOuter") == 7
    assert "Nested" not in text and "Cartesian" not in text


def test_view_aggregates_before_it_joins(stage):
    text = plan(view(stage.warehouse, "entidad"))
    # The tree is printed from the top: the join stands above the aggregate.
    assert text.index("BroadcastHashJoin") < text.index("HashAggregate") < text.index("Scan parquet")
    assert "log1p" not in text  # unread columns stay in the files


def test_period_filter_prunes_folders(stage):
    text = plan(query_axis(stage.warehouse, "ramo", {"ciclo": 1996}).data)
    assert "PartitionFilters: [isnotnull(ciclo" in text and "TakeOrderedAndProject" in text


def test_label_filter_reaches_the_scan(stage):
    text = plan(query_axis(stage.warehouse, "ramo", {"desc_ramo": "ASIA"}).data)
    assert "EqualTo(ramo_sk" in text or "In(ramo_sk" in text


def test_page_is_cut_before_dimensions_are_joined(stage):
    text = plan(query_star(stage.warehouse, {}, 10).data)
    cut = text.index("TakeOrderedAndProject", text.index("BroadcastHashJoin"))
    assert cut < text.index("Scan parquet")


def test_star_joins_only_what_is_asked(stage):
    text = plan(star(stage.warehouse, ["fact_sk", "desc_ramo", "monto_pagado"]))
    assert "dim_ur" not in text and "dim_entidad" not in text


def test_no_plan_sorts_the_fact_in_one_task(stage):
    wh = stage.warehouse
    for df in (wh.fact, star(wh), view(wh, "ur"), view(wh, "capitulo", "label")):
        assert "SinglePartition" not in plan(df)


def test_lens_reads_only_its_columns(spark):
    text = plan(lens(spark, SF))
    assert "l_linestatus" not in text and "p_retailprice" not in text and "Cartesian" not in text
