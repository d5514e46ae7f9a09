"""SQL text computing the registered queries from the same tables, written apart from the
engine: window numbering, plain joins and one common table per step."""

from __future__ import annotations

from erario import fixed

LENS = """
SELECT
 CAST(year(o.o_orderdate) AS BIGINT) AS ciclo,
 l.l_orderkey AS id_clave_cartera,
 CAST(sr.r_regionkey AS BIGINT) AS id_ramo, sr.r_name AS desc_ramo,
 CASE WHEN sn.n_nationkey % 2 = 0 THEN concat('U', CAST(sn.n_nationkey AS VARCHAR(9))) ELSE CAST(sn.n_nationkey AS VARCHAR(9)) END AS id_ur, sn.n_name AS desc_ur,
 CAST(cn.n_nationkey AS BIGINT) AS id_entidad_federativa, cn.n_name AS entidad_federativa,
 CAST(substring(o.o_orderpriority, 1, 1) AS BIGINT) AS id_ff, o.o_orderpriority AS desc_ff,
 CASE WHEN p.p_size = 50 THEN NULL ELSE CAST(p.p_size AS BIGINT) END AS id_capitulo, p.p_type AS desc_capitulo,
 p.p_brand AS desc_concepto, l.l_returnflag AS desc_funcion, c.c_mktsegment AS desc_pp,
 CASE WHEN l.l_returnflag = 'A' AND l.l_linenumber = 1 THEN 'NO PROGRAMABLE' ELSE 'PROGRAMABLE' END AS tipo_gasto,
 l.l_extendedprice AS monto_aprobado,
 CASE WHEN l.l_linenumber = 7 THEN 0e0 WHEN l.l_linenumber = 6 AND l.l_quantity > 45 THEN -l.l_extendedprice
      WHEN l.l_linenumber = 6 AND l.l_quantity < 3 THEN NULL ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l.l_discount AS DECIMAL(4,2))) AS DOUBLE) END AS monto_modificado,
 CASE WHEN o.o_orderstatus = 'O' AND l.l_tax = 0 THEN 0e0 WHEN l.l_linenumber = 5 AND l.l_quantity < 3 THEN NULL
      ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_quantity AS DECIMAL(4,0)) * CAST(0.025 AS DECIMAL(4,3)) AS DOUBLE) END AS monto_pagado
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
"""

_CLEAN = f"""
lens AS ({LENS}),
lines AS (SELECT DISTINCT * FROM lens),
flagged AS (
 SELECT *,
  coalesce(monto_aprobado < 0, false) OR coalesce(monto_modificado < 0, false) OR coalesce(monto_pagado < 0, false) AS flag_montos_negativos,
  coalesce(monto_modificado = 0, false) AS flag_modificado_cero,
  coalesce(monto_modificado < 0, false) AS flag_modificado_negativo,
  CASE WHEN monto_modificado > 0 THEN monto_pagado / monto_modificado END AS ratio_ejecucion,
  CASE WHEN monto_aprobado > 0 THEN monto_pagado / monto_aprobado END AS ratio_aprobado,
  ln(1 + CASE WHEN monto_pagado < 0 THEN 0 ELSE monto_pagado END) AS log1p_monto_pagado,
  coalesce(monto_modificado > 0 AND monto_pagado = 0, false) AS sin_pago
 FROM lines),
clean AS (
 SELECT *,
  coalesce(ratio_ejecucion >= 0.8e0, false) AS alta_ejecucion,
  coalesce(ratio_ejecucion > 1e0, false) AS sobre_ejecucion,
  CASE WHEN flag_montos_negativos OR ratio_ejecucion IS NULL THEN 'sin_base'
       WHEN ratio_ejecucion < 0.5e0 THEN 'baja' WHEN ratio_ejecucion < 0.8e0 THEN 'media'
       WHEN ratio_ejecucion <= 1e0 THEN 'alta' ELSE 'sobre' END AS banda_ejecucion,
  NOT flag_montos_negativos AND NOT flag_modificado_negativo AND ciclo IS NOT NULL AS flag_registro_valido
 FROM flagged)
"""

_DIMS = {
    "dim_tiempo": ("tiempo_sk", ["ciclo"]),
    "dim_ramo": ("ramo_sk", ["id_ramo", "desc_ramo"]),
    "dim_ur": ("ur_sk", ["id_ur", "desc_ur", "id_ramo", "desc_ramo"]),
    "dim_entidad": ("entidad_sk", ["id_entidad_federativa", "entidad_federativa"]),
    "dim_fuente": ("ff_sk", ["id_ff", "desc_ff"]),
    "dim_economica": ("eco_sk", ["id_capitulo", "desc_capitulo", "desc_concepto"]),
    "dim_funcional": ("func_sk", ["desc_funcion", "desc_pp"]),
}
_SKS = [sk for sk, _ in _DIMS.values()]
_FACT_ORDER = _SKS + ["id_clave_cartera", "monto_aprobado", "monto_modificado", "monto_pagado", "tipo_gasto"]


def _last(columns: list[str]) -> str:
    return ", ".join(f"{c} NULLS LAST" for c in columns)


def _dim_tables() -> str:
    return ",\n".join(
        f"{name} AS (SELECT *, row_number() OVER (ORDER BY {_last(keys)}) AS {sk} "
        f"FROM (SELECT DISTINCT {', '.join(keys)} FROM olap))"
        for name, (sk, keys) in _DIMS.items()
    )


def _fact_table() -> str:
    joins = " ".join(
        f"LEFT JOIN {n} ON " + " AND ".join(f"b.{k} IS NOT DISTINCT FROM {n}.{k}" for k in keys)
        for n, (_, keys) in _DIMS.items()
    )
    sks = ", ".join(f"{n}.{sk}" for n, (sk, _) in _DIMS.items())
    return (
        f"keyed AS (SELECT b.*, {sks} FROM olap b {joins}),\n"
        f"fact AS (SELECT row_number() OVER (ORDER BY {_last(_FACT_ORDER)}) AS fact_sk, * FROM keyed)"
    )


_STAR = f"{_CLEAN},\nolap AS (SELECT * FROM clean WHERE NOT flag_montos_negativos),\n{_dim_tables()},\n{_fact_table()}"


def on_clean(sql: str) -> str:
    return f"WITH {_CLEAN}\n{sql}"


def on_star(sql: str, extra: str = "") -> str:
    return f"WITH {_STAR}{extra}\n{sql}"


_LINE = "id_clave_cartera, monto_aprobado, monto_modificado, monto_pagado"
_FLAGS = ("flag_montos_negativos, flag_modificado_cero, flag_modificado_negativo, sin_pago, "
          "alta_ejecucion, sobre_ejecucion, flag_registro_valido")


def _sum(column: str, alias: str | None = None) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(20,6))) AS DOUBLE) AS {alias or column}"


_BASE = "CAST(sum(CAST(CASE WHEN monto_modificado > 0 THEN monto_modificado ELSE 0 END AS DECIMAL(20,6))) AS DOUBLE)"
_PAID = "CAST(sum(CAST(monto_pagado AS DECIMAL(20,6))) AS DOUBLE)"
_WEIGHTED = f"CASE WHEN {_BASE} > 0 THEN {_PAID} / {_BASE} END AS ratio_ejecucion_ponderado"
_MEAN = "round(avg(CASE WHEN monto_modificado > 0 THEN ratio_ejecucion END), 6) AS ratio_ejecucion_promedio"


def _n(flag: str) -> str:
    return f"CAST(sum(CASE WHEN {flag} THEN 1 ELSE 0 END) AS BIGINT) AS n_{flag}"


_N = "count(*) AS n_registros"
_TWO = f"{_N}, {_sum('monto_modificado')}, {_sum('monto_pagado')}"
_THREE = f"{_N}, {_sum('monto_aprobado')}, {_sum('monto_modificado')}, {_sum('monto_pagado')}"

# axis -> (group columns, measures)
_VIEWS = {
    "kpis": ("ciclo", f"{_THREE}, {_BASE} AS base_modificado_positivo, {_WEIGHTED}, {_MEAN}, "
                      f"{_n('sin_pago')}, {_n('alta_ejecucion')}, {_n('sobre_ejecucion')}"),
    "ramo": ("ramo_sk, id_ramo, desc_ramo, ciclo",
             f"{_THREE}, {_WEIGHTED}, {_n('sin_pago')}, {_n('alta_ejecucion')}"),
    "ur": ("ur_sk, id_ur, desc_ur, id_ramo, desc_ramo, ciclo", f"{_TWO}, {_WEIGHTED}, {_n('sin_pago')}"),
    "entidad": ("entidad_sk, id_entidad_federativa, entidad_federativa, ciclo",
                f"{_TWO}, {_WEIGHTED}, {_n('sin_pago')}"),
    "capitulo": ("eco_sk, id_capitulo, desc_capitulo, ciclo", f"{_TWO}, {_WEIGHTED}"),
    "programa": ("func_sk, desc_pp, desc_funcion, ciclo", f"{_TWO}, {_WEIGHTED}"),
    "fuente": ("ff_sk, id_ff, desc_ff, ciclo", f"{_TWO}, {_WEIGHTED}"),
    "banda": ("banda_ejecucion, tipo_gasto, ciclo", _TWO),
    "tipo_gasto": ("tipo_gasto, ciclo", f"{_TWO}, {_MEAN}"),
}


def _view(axis: str) -> str:
    by, measures = _VIEWS[axis]
    source = "fact"
    if axis == "ur":
        source = ("(SELECT f.* EXCLUDE (id_ramo, desc_ramo), r.id_ramo, r.desc_ramo FROM fact f "
                  "JOIN dim_ur u ON f.ur_sk = u.ur_sk JOIN dim_ramo r ON u.id_ramo = r.id_ramo)")
    return f"SELECT {by}, {measures} FROM {source} GROUP BY {by}"


def _top(axis: str, limit: int, where: str = "true") -> str:
    by = _VIEWS[axis][0]
    return (f"SELECT * FROM ({_view(axis)}) WHERE {where} "
            f"ORDER BY n_registros DESC NULLS LAST, {_last(by.split(', '))} LIMIT {limit}")


_CUBE = (
    "fact_sk, id_clave_cartera, ciclo, id_ramo, desc_ramo, id_ur, desc_ur, id_entidad_federativa, "
    "entidad_federativa, id_ff, desc_ff, id_capitulo, desc_capitulo, desc_concepto, desc_funcion, desc_pp, "
    "tipo_gasto, monto_aprobado, monto_modificado, monto_pagado, ratio_ejecucion, ratio_aprobado, sin_pago, "
    "alta_ejecucion, sobre_ejecucion, banda_ejecucion, flag_modificado_cero, flag_registro_valido"
)
_LOG = "round(log1p_monto_pagado, 6) AS log1p_monto_pagado"
_FACT_SHAPE = (
    f"fact_sk, id_clave_cartera, {', '.join(_SKS)}, monto_aprobado, monto_modificado, monto_pagado, "
    f"tipo_gasto, ratio_ejecucion, ratio_aprobado, {_LOG}, sin_pago, alta_ejecucion, sobre_ejecucion, "
    "banda_ejecucion, flag_modificado_cero, flag_registro_valido"
)

_U = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NUMBER = r"'^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$'"


def _num(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {_NUMBER}) THEN TRY_CAST({c} AS DOUBLE) END"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_U}+|{_U}+$', '', 'g')"


_RAW = f"""
lens AS ({LENS}),
dirty AS (
 SELECT CAST(ciclo AS VARCHAR) AS ciclo, CAST(id_clave_cartera AS VARCHAR) AS id_clave_cartera, id_ur,
  CASE id_ff WHEN 1 THEN desc_ur || '  ' WHEN 2 THEN chr(160) || desc_ur WHEN 3 THEN desc_ur || chr(28) ELSE desc_ur END AS desc_ur,
  tipo_gasto, coalesce(CAST(id_capitulo AS VARCHAR), 'n/d') AS id_capitulo,
  CASE id_capitulo WHEN 1 THEN '1,000' WHEN 2 THEN '1.5d' WHEN 3 THEN '' ELSE CAST(CAST(monto_aprobado AS DECIMAL(12,2)) AS VARCHAR) END AS monto_aprobado
 FROM lens),
raw_lines AS (SELECT * FROM dirty UNION ALL SELECT * REPLACE (' ' || desc_ur AS desc_ur) FROM dirty WHERE id_capitulo = '7'),
typed AS (
 SELECT CAST({_num('ciclo')} AS BIGINT) AS ciclo, CAST({_num('id_clave_cartera')} AS BIGINT) AS id_clave_cartera,
  {_trim('id_ur')} AS id_ur, {_trim('desc_ur')} AS desc_ur, {_trim('tipo_gasto')} AS tipo_gasto,
  CAST({_num('id_capitulo')} AS BIGINT) AS id_capitulo, {_num('monto_aprobado')} AS monto_aprobado
 FROM raw_lines)
"""


def _rows(section: str, cells: list[tuple[str, str, str]], source: str = "clean") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{section}' AS section, '{c}' AS "column", '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {source}"""
        for c, m, e in cells
    )


_CLEAN_COLUMNS = [
    "ciclo", "id_clave_cartera", "id_ramo", "desc_ramo", "id_ur", "desc_ur", "id_entidad_federativa",
    "entidad_federativa", "id_ff", "desc_ff", "id_capitulo", "desc_capitulo", "desc_concepto",
    "desc_funcion", "desc_pp", "tipo_gasto", "monto_aprobado", "monto_modificado", "monto_pagado",
    *fixed.DERIVED,
]
_MONEY = ["monto_aprobado", "monto_modificado", "monto_pagado"]
_PROBS = [("mediana", 0.5), ("p95", 0.95), ("p99", 0.99)]


def _quantile_rows() -> str:
    parts = [
        _rows("montos", [(c, m, f"round(quantile_cont({c}, {p}), 6)") for c in _MONEY for m, p in _PROBS]),
        _rows("ratio_ejecucion_crudo",
              [("", m, f"round(quantile_cont(ratio_ejecucion, {p}), 6)") for m, p in _PROBS]),
    ]
    return " UNION ALL ".join(parts)


_HAS_BASE = "flag_registro_valido AND coalesce(monto_modificado > 0, false)"
_FILTERS = {
    "filtro_olap": "NOT flag_montos_negativos",
    "filtro_modelado_ratio": _HAS_BASE,
    "filtro_modelado_programable": f"{_HAS_BASE} AND tipo_gasto = 'PROGRAMABLE'",
    "filtro_clasificacion_sin_pago": _HAS_BASE,
}


def _describe() -> str:
    numbers = " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS \"count\", CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, "
        f"CAST(NULL AS BIGINT) AS freq, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS \"min\", "
        f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
        f"round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS \"max\" FROM clean"
        for c in [*_MONEY, "ratio_ejecucion"]
    )
    none = ", ".join(f'CAST(NULL AS DOUBLE) AS "{n}"' for n in ("mean", "std", "min", "q25", "q50", "q75", "max"))
    texts = " UNION ALL ".join(
        f"SELECT '{c}', (SELECT count({c}) FROM clean), (SELECT count(DISTINCT {c}) FROM clean), {c}, n, {none} "
        f"FROM (SELECT {c}, count(*) AS n FROM clean GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"
        for c in ("tipo_gasto", "banda_ejecucion")
    )
    return f"{numbers} UNION ALL {texts}"


_LOOKUPS = {
    "ramo": "SELECT id_ramo, desc_ramo FROM dim_ramo",
    "ur": "SELECT id_ur, desc_ur, id_ramo FROM dim_ur",
    "entidad": "SELECT id_entidad_federativa, entidad_federativa FROM dim_entidad",
    "fuente": "SELECT id_ff, desc_ff FROM dim_fuente",
    "capitulo": "SELECT DISTINCT id_capitulo, desc_capitulo FROM dim_economica",
    "programa": "SELECT DISTINCT desc_pp FROM dim_funcional",
    "banda_ejecucion": "SELECT DISTINCT banda_ejecucion FROM fact",
    "tipo_gasto": "SELECT DISTINCT tipo_gasto FROM fact",
}
_FULL = {"dim_fuente": "dim_fuente_financiamiento", "dim_economica": "dim_clasificacion_economica",
         "dim_funcional": "dim_clasificacion_funcional"}


def _full(name: str) -> str:
    return _FULL.get(name, name)


def base_oracle() -> dict[str, str]:
    o = {
        "lens": LENS,
        "derive_flags": on_clean(f"SELECT {_LINE}, {_FLAGS} FROM clean"),
        "derive_ratios": on_clean(f"SELECT {_LINE}, ratio_ejecucion, ratio_aprobado FROM clean"),
        "derive_log1p": on_clean(f"SELECT {_LINE}, {_LOG} FROM clean"),
        "band_default": on_clean(f"SELECT {_LINE}, banda_ejecucion FROM clean"),
        "band_unpaid_option": on_clean(
            f"SELECT {_LINE}, CASE WHEN banda_ejecucion = 'baja' AND sin_pago THEN 'sin_pago' "
            "ELSE banda_ejecucion END AS banda_ejecucion FROM clean"),
        "clean_types": f"WITH {_RAW} SELECT ciclo, id_clave_cartera, id_capitulo, monto_aprobado FROM typed",
        "clean_trim": f"WITH {_RAW} SELECT desc_ur, id_ur, tipo_gasto, count(*) AS n FROM typed GROUP BY ALL",
        "dedupe_exact": f"WITH {_RAW} SELECT DISTINCT * FROM typed",
        "duplicates_removed": f"WITH {_RAW} SELECT 'forma' AS section, '' AS \"column\", 'duplicados_exactos' AS metric, "
        "CAST((SELECT count(*) FROM typed) - (SELECT count(*) FROM (SELECT DISTINCT * FROM typed)) AS DOUBLE) AS value",
    }
    for short, name in (
        ("filter_olap", "filtro_olap"), ("filter_ratio", "filtro_modelado_ratio"),
        ("filter_programable", "filtro_modelado_programable"),
        ("filter_unpaid", "filtro_clasificacion_sin_pago"),
    ):
        o[short] = on_clean(f"SELECT {_LINE}, ciclo, tipo_gasto FROM clean WHERE {_FILTERS[name]}")
    o["filter_counts"] = on_clean(
        _rows("filtros_analiticos_n_filas", [(n, "n", f"count(*) FILTER (WHERE {p})") for n, p in _FILTERS.items()])
        + " UNION ALL SELECT 'umbrales', 'RATIO_ALTA_EJECUCION', 'umbral', 0.8e0"
        + " UNION ALL SELECT 'umbrales', 'RATIO_MEDIA_EJECUCION', 'umbral', 0.5e0")
    for name, (sk, keys) in _DIMS.items():
        o[name] = on_star(f"SELECT {', '.join(keys)}, {sk} FROM {name}")
    o["fact_table"] = on_star(f"SELECT {_FACT_SHAPE} FROM fact")
    order = ["ff_sk", *[c for c in _FACT_ORDER if c != "ff_sk"]]
    o["fact_numbering"] = on_star(
        f"SELECT row_number() OVER (ORDER BY {_last(order)}) AS position, ff_sk, tiempo_sk, "
        "id_clave_cartera, monto_aprobado FROM fact")
    o["modelling_star"] = on_star(
        f"SELECT {_CUBE}, {', '.join(_SKS)}, {_LOG} FROM fact "
        "WHERE monto_modificado > 0 AND flag_registro_valido AND tipo_gasto = 'PROGRAMABLE'")
    counts = [("fact_ejecucion_rows", "fact"), *[(_full(n), n) for n in _DIMS]]
    o["warehouse_report"] = on_star(
        "SELECT *, true AS ok FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", count(*) AS value FROM {t}" for c, t in counts)
        + " UNION ALL SELECT 'orphan_fact_rows', count(*) FROM fact WHERE "
        + " OR ".join(f"{s} IS NULL" for s in _SKS)
        + " UNION ALL SELECT 'olap_views', 10)")
    o["orphans"] = on_star(" UNION ALL ".join(
        f"SELECT '{_full(n)}' AS dimension, count(*) AS orphan_rows FROM fact f "
        f"WHERE NOT EXISTS (SELECT 1 FROM {n} d WHERE d.{sk} = f.{sk})" for n, (sk, _) in _DIMS.items()))
    o["missing_keys"] = on_star(" UNION ALL ".join(
        f"SELECT '{sk}' AS sk, count(*) FILTER (WHERE {sk} IS NULL) AS missing_rows FROM fact" for sk in _SKS))
    o["key_uniqueness"] = on_star(" UNION ALL ".join(
        f"SELECT '{_full(n)}' AS dimension, count(*) AS repeated_keys FROM "
        f"(SELECT 1 FROM {n} GROUP BY {', '.join(keys)} HAVING count(*) > 1)" for n, (_, keys) in _DIMS.items()))
    o["star_counts"] = on_star(" UNION ALL ".join(
        f"SELECT '{s}' AS source, count(*) AS \"rows\" FROM fact" for s in ("star", "fact", "kpis")))
    for axis in _VIEWS:
        o[f"view_{axis}"] = on_star(_view(axis))
        o[f"axis_topk_{axis}"] = on_star(_top(axis, 20))
    o["view_star"] = on_star(f"SELECT {_CUBE} FROM fact")
    o["view_capitulo_label"] = on_star(
        f"SELECT id_capitulo, desc_capitulo, ciclo, {_VIEWS['capitulo'][1]} FROM fact GROUP BY id_capitulo, desc_capitulo, ciclo")
    o["view_programa_label"] = on_star(
        f"SELECT desc_pp, desc_funcion, ciclo, {_VIEWS['programa'][1]} FROM fact GROUP BY desc_pp, desc_funcion, ciclo")
    o["views_by_sql"] = on_star(
        "SELECT entidad_federativa, count(*) AS n, CAST(sum(CASE WHEN sin_pago THEN 1 ELSE 0 END) AS BIGINT) AS unpaid "
        "FROM fact GROUP BY entidad_federativa")
    o["csv_read"] = o["clean_types"]
    o["stage_clean"] = on_clean(
        "SELECT id_clave_cartera, monto_aprobado, monto_modificado, monto_pagado, ciclo, tipo_gasto FROM clean")
    o["stage_analytic"] = o["modelling_source"] = o["filter_programable"]
    o["olap_source"] = o["filter_olap"]
    o["profile_before_after"] = on_clean(
        "SELECT 'entrada' AS stage, 'n_filas' AS metric, CAST((SELECT count(*) FROM lens) AS DOUBLE) AS value "
        "UNION ALL SELECT 'limpio', 'n_filas', CAST((SELECT count(*) FROM clean) AS DOUBLE) "
        "UNION ALL SELECT 'limpio', 'duplicados_eliminados', CAST((SELECT count(*) FROM lens) - (SELECT count(*) FROM clean) AS DOUBLE)")
    o["axis_capitulo_all"] = o["view_capitulo"]
    o["all_views_by_sql"] = " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS n FROM ({o['view_kpis' if axis == 'global' else f'view_{axis}']})"
        for axis, name in [*fixed.AXIS_VIEWS.items(), ("star", fixed.STAR_VIEW)])
    catalogue = ", ".join(
        f"('{a}', '{v}', '{','.join(sorted(f))}')" for a, v, f in [
            *((a, v, fixed.AXIS_FILTERS[a]) for a, v in fixed.AXIS_VIEWS.items()), ("star", fixed.STAR_VIEW, fixed.STAR_FILTERS)])
    o["axis_catalogue"] = (
        f"SELECT axis, view, filters, n FROM (VALUES {catalogue}) c(axis, view, filters) "
        f"JOIN ({o['all_views_by_sql']}) v ON v.name = c.view")
    o["kpis_one_cycle"] = on_star(_top("kpis", 50, "ciclo = 1997"))
    o["axis_filtered_ramo"] = on_star(_top("ramo", 100, "id_ramo = 2 AND ciclo = 1996"))
    o["axis_filtered_ur"] = on_star(_top("ur", 100, "id_ur = 'U2' AND id_ramo = 2"))
    o["axis_filtered_capitulo"] = on_star(_top("capitulo", 10**9, "id_capitulo = 7"))
    page = "ORDER BY monto_modificado DESC NULLS LAST, fact_sk"
    o["star_page"] = on_star(
        f"SELECT {_CUBE} FROM fact WHERE id_ramo = 1 AND tipo_gasto = 'PROGRAMABLE' {page} LIMIT 50")
    media = "WHERE ciclo = 1995 AND banda_ejecucion = 'media'"
    o["star_page_offset"] = on_star(f"SELECT {_CUBE} FROM fact {media} {page} LIMIT 25 OFFSET 40")
    o["star_page_total"] = on_star(f"SELECT count(*) AS row_count FROM fact {media}")
    o["chart_top15"] = on_star(
        f"SELECT entidad_federativa AS label, CAST(n_registros AS DOUBLE) AS value FROM ({_top('entidad', 15)})")
    o["chart_top15_paid"] = on_star(
        f"SELECT substring(desc_ff, 1, 40) AS label, monto_pagado AS value FROM ({_top('fuente', 15)})")
    for name, sql in _LOOKUPS.items():
        o[f"lookup_{name}"] = on_star(sql)

    o["profile_shape"] = on_clean(
        _rows("forma", [("", "n_filas", "count(*)"), ("", "n_columnas", f"{len(_CLEAN_COLUMNS)}+0*count(*)")])
        + " UNION ALL "
        + _rows("columnas", [(c, "posicion", f"{i}+0*count(*)") for i, c in enumerate(_CLEAN_COLUMNS)]))
    o["profile_nulls"] = on_clean(_rows("nulos", [(c, "nulos", f"count(*) - count({c})") for c in _CLEAN_COLUMNS]))
    o["profile_amounts"] = on_clean(_rows("montos", [
        (c, m, f"round(CAST({e.format(c=c)} AS DOUBLE), 6)") for c in _MONEY for m, e in (
            ("min", "min({c})"), ("max", "max({c})"),
            ("media", "CAST(sum(CAST({c} AS DECIMAL(20,6))) AS DOUBLE) / count({c})"),
            ("negativos", "count(*) FILTER (WHERE {c} < 0)"), ("nulos", "count(*) - count({c})"))]))
    o["profile_ratio"] = on_clean(_rows("ratio_ejecucion_crudo", [
        ("", m, f"count(*) FILTER (WHERE {p})") for m, p in (
            ("filas_con_modificado_positivo", "monto_modificado > 0"), ("modificado_cero", "monto_modificado = 0"),
            ("modificado_negativo", "monto_modificado < 0"), ("sobre_ejecucion_gt_1", "ratio_ejecucion > 1"),
            ("sin_pago", "monto_modificado > 0 AND monto_pagado = 0"))]))
    o["profile_flags"] = on_clean(_rows("flags", [(f, "n", f"count(*) FILTER (WHERE {f})") for f in (
        "flag_montos_negativos", "flag_modificado_cero", "flag_registro_valido", "sin_pago",
        "alta_ejecucion", "sobre_ejecucion")]))
    o["profile_quantiles"] = on_clean(_quantile_rows())
    o["profile_quantiles_ranked"] = o["profile_quantiles"]
    freq = ("SELECT '{s}' AS section, '{c}' AS \"column\", {c} AS metric, CAST(count(*) AS DOUBLE) AS value "
            "FROM clean WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT {k}")
    o["profile_freq"] = on_clean(freq.format(s="tipo_gasto", c="tipo_gasto", k=1000))
    o["profile_top10"] = on_clean(freq.format(s="entidad_top10", c="entidad_federativa", k=10))
    o["profile_distinct"] = on_clean(_rows("cardinalidad", [
        (c, "distintos", f"count(DISTINCT {c})") for c in ("id_ramo", "id_ur", "entidad_federativa")]))
    o["profile_periods"] = on_clean(
        "SELECT DISTINCT 'ciclo_valores' AS section, 'ciclo' AS \"column\", CAST(ciclo AS VARCHAR) AS metric, "
        "CAST(ciclo AS DOUBLE) AS value FROM clean WHERE ciclo IS NOT NULL")
    o["profile_bands"] = on_clean(
        "SELECT b.banda_ejecucion, coalesce(n, 0) AS n, b.banda_orden FROM (VALUES "
        + ", ".join(f"('{b}', CAST({i} AS BIGINT))" for i, b in enumerate(fixed.BANDS))
        + ") b(banda_ejecucion, banda_orden) LEFT JOIN (SELECT banda_ejecucion, count(*) AS n FROM clean GROUP BY 1) c "
        "ON b.banda_ejecucion = c.banda_ejecucion")
    o["profile_duplicates"] = on_clean(
        "SELECT 'forma' AS section, '' AS \"column\", 'duplicados_exactos' AS metric, "
        "CAST((SELECT count(*) FROM clean) - (SELECT count(*) FROM (SELECT DISTINCT * FROM clean)) AS DOUBLE) AS value")
    o["hist_ratio"] = on_clean(
        "SELECT b.bin, round(lo + b.bin * ((hi - lo) / 50), 6) AS bin_start, coalesce(c.n, 0) AS n FROM "
        "(SELECT range AS bin FROM range(50)) b CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM "
        "(SELECT least(ratio_ejecucion, 2e0) AS x FROM clean WHERE monto_modificado > 0 AND ratio_ejecucion IS NOT NULL)) s "
        "LEFT JOIN (SELECT least(CAST(floor((x - lo) / (hi - lo) * 50) AS BIGINT), 49) AS bin, count(*) AS n FROM "
        "(SELECT x, min(x) OVER () AS lo, max(x) OVER () AS hi FROM (SELECT least(ratio_ejecucion, 2e0) AS x "
        "FROM clean WHERE monto_modificado > 0 AND ratio_ejecucion IS NOT NULL)) GROUP BY 1) c ON b.bin = c.bin")
    o["describe"] = on_clean(_describe())
    o["impute_median"] = on_clean(" UNION ALL ".join(
        f"SELECT '{c}' AS name, 0.5e0 AS prob, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS value FROM clean"
        for c in ("monto_modificado", "monto_pagado", "id_capitulo")))
    return o
