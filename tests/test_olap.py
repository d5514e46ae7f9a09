import pytest
from lines import SF
from pyspark.sql import functions as F

from erario import fixed
from erario.plans.olap import (
    axes,
    catalogue,
    chart_rows,
    checked,
    lookup,
    query_axis,
    query_kpis,
    query_star,
)
from erario.plans.views import view
from erario_checks.workload import Stage


@pytest.fixture(scope="module")
def wh(spark):
    return Stage.of(spark, SF).warehouse


def test_limits():
    assert [checked(n) for n in (1, 9999, None)] == [1, 9999, None]
    for n in (-3, 0):
        with pytest.raises(ValueError):
            checked(n)


def test_no_limit_gives_every_group(wh):
    assert query_axis(wh, "capitulo", limit=None).data.count() == view(wh, "capitulo").count()


def test_deep_page_meets_in_no_task(wh):
    page = query_star(wh, limit=7, offset=300)
    plan = page.data._jdf.queryExecution().executedPlan().toString()
    assert "limit=307" not in plan and "offset" not in plan.lower()
    order = query_star(wh, limit=307).data.select("fact_sk").collect()[300:]
    assert page.data.select("fact_sk").collect() == order


def test_catalogue(spark):
    rows = {r["axis"]: r for r in catalogue(spark).collect()}
    assert list(rows) == axes() + ["star"]
    assert len(rows["star"]["filters"]) == 12 and rows["global"]["filters"] == ["ciclo"]


@pytest.mark.parametrize("axis", axes())
def test_every_axis_is_cut_and_sorted(wh, axis):
    r = query_axis(wh, axis, limit=3)
    rows = r.data.collect()
    assert r.view == fixed.AXIS_VIEWS[axis] and len(rows) <= 3
    counts = [x["n_registros"] for x in rows]
    assert counts == sorted(counts, reverse=True)
    assert counts[0] == view(wh, axis).agg(F.max("n_registros")).first()[0]


def test_unknown_axis_and_lookup(wh):
    with pytest.raises(ValueError, match="ramo"):
        query_axis(wh, "planet")
    with pytest.raises(ValueError, match="capitulo"):
        lookup(wh, "planet")


def test_other_filters_are_ignored(wh):
    r = query_axis(wh, "entidad", {"ciclo": 1996, "id_ramo": 2, "entidad_federativa": None})
    assert r.filters_applied == {"ciclo": 1996}
    assert {x["ciclo"] for x in r.data.collect()} == {1996}


def test_filter_without_members_gives_no_rows(wh):
    assert query_axis(wh, "ramo", {"desc_ramo": "ATLANTIS"}).row_count() == 0
    page = query_star(wh, {"id_ur": "nobody"})
    assert page.row_count() == 0 and page.data.count() == 0


def test_many_members_take_the_semi_join(wh, monkeypatch):
    import erario.plans.views as views

    want = sorted(query_star(wh, {"id_capitulo": 7}, 5000).data.collect(), key=str)
    monkeypatch.setattr(views, "_PUSHED_KEYS", 0)
    assert sorted(query_star(wh, {"id_capitulo": 7}, 5000).data.collect(), key=str) == want


def test_kpis(wh):
    assert query_kpis(wh).row_count() == 7
    assert [r["ciclo"] for r in query_kpis(wh, 1995).data.collect()] == [1995]


def test_pages_join_up(wh):
    keys = ["monto_modificado", "fact_sk"]
    whole = [tuple(r) for r in query_star(wh, {"ciclo": 1995}, 30).data.select(*keys).collect()]
    by_offset = [
        tuple(r) for o in (0, 10, 20) for r in query_star(wh, {"ciclo": 1995}, 10, o).data.select(*keys).collect()]
    assert whole == by_offset
    seen, last = [], None
    for _ in range(3):
        rows = query_star(wh, {"ciclo": 1995}, 10, after=last).data.select(*keys).collect()
        seen += [tuple(r) for r in rows]
        last = seen[-1]
    assert seen == whole


def test_keyset_walks_through_missing_amounts(wh):
    keys = ["monto_modificado", "fact_sk"]
    total = query_star(wh, {"ciclo": 1997}).row_count()
    seen, last = [], None
    while True:
        rows = query_star(wh, {"ciclo": 1997}, 400, after=last).data.select(*keys).collect()
        if not rows:
            break
        seen += [tuple(r) for r in rows]
        last = seen[-1]
    assert len(seen) == len(set(seen)) == total
    assert seen[-1][0] is None


def test_chart(wh):
    rows = chart_rows(query_axis(wh, "ramo")).collect()
    assert len(rows) == 15 and rows[0]["value"] >= rows[-1]["value"]
    assert {len(r["label"]) <= 40 for r in rows} == {True}
    assert chart_rows(query_axis(wh, "global")).first()["label"].isdigit()
    # Unit bars carry the branch name by default; labels can be chosen.
    units = chart_rows(query_axis(wh, "ur"), labels=("desc_ur",)).collect()
    assert all(r["label"].startswith("NATION") for r in units)


def test_lookups_are_sorted(wh):
    rows = [r["id_capitulo"] for r in lookup(wh, "capitulo").select("id_capitulo").distinct().collect()]
    assert None in rows
    ordered = [r["entidad_federativa"] for r in lookup(wh, "entidad").collect()]
    assert ordered == sorted(ordered)
