"""Column names, thresholds, tokens and public names.

These define the data contract, so results can only be right if they are exactly
these.  Everything else in the package is derived from them.
"""

# --- raw budget line -------------------------------------------------------

PERIOD = "ciclo"
LINE_KEY = "id_clave_cartera"

AMOUNTS = (
    "monto_aprobado",
    "monto_modificado",
    "monto_aprobado_mensual",
    "monto_modificado_mensual",
    "monto_pagado",
)
APPROVED = "monto_aprobado"
MODIFIED = "monto_modificado"
PAID = "monto_pagado"

TEXTS = (
    "desc_ramo",
    "id_ur",
    "desc_ur",
    "desc_gpo_funcional",
    "desc_funcion",
    "desc_subfuncion",
    "desc_ai",
    "id_modalidad",
    "desc_modalidad",
    "desc_pp",
    "desc_capitulo",
    "desc_concepto",
    "desc_partida_generica",
    "desc_partida_especifica",
    "desc_tipogasto",
    "desc_ff",
    "entidad_federativa",
    "tipo_gasto",
)

NUMERIC_IDS = (
    "id_ramo",
    "gpo_funcional",
    "id_funcion",
    "id_subfuncion",
    "id_ai",
    "id_pp",
    "id_capitulo",
    "id_concepto",
    "id_partida_generica",
    "id_partida_especifica",
    "id_tipogasto",
    "id_ff",
    "id_entidad_federativa",
)

# Texts a CSV reader must take for a missing value (public pandas default).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- derived columns -------------------------------------------------------

HIGH_RATIO = 0.80
MIDDLE_RATIO = 0.50
BANDS = ("sin_base", "sin_pago", "baja", "media", "alta", "sobre")
PROGRAMMABLE = "PROGRAMABLE"

DERIVED = (
    "flag_montos_negativos",
    "flag_modificado_cero",
    "flag_modificado_negativo",
    "ratio_ejecucion",
    "ratio_aprobado",
    "log1p_monto_pagado",
    "sin_pago",
    "alta_ejecucion",
    "sobre_ejecucion",
    "banda_ejecucion",
    "flag_registro_valido",
)

# --- star ------------------------------------------------------------------

FACT = "fact_ejecucion"
FACT_KEY = "fact_sk"
FACT_ATTRIBUTES = (
    "tipo_gasto",
    "ratio_ejecucion",
    "ratio_aprobado",
    "log1p_monto_pagado",
    "sin_pago",
    "alta_ejecucion",
    "sobre_ejecucion",
    "banda_ejecucion",
    "flag_modificado_cero",
    "flag_registro_valido",
)

# table -> (surrogate key, natural key, leading sort columns)
DIMENSIONS = {
    "dim_tiempo": ("tiempo_sk", ("ciclo",), ("ciclo",)),
    "dim_ramo": ("ramo_sk", ("id_ramo", "desc_ramo"), ("id_ramo", "desc_ramo")),
    "dim_ur": ("ur_sk", ("id_ur", "desc_ur", "id_ramo", "desc_ramo"), ("id_ur", "desc_ur")),
    "dim_entidad": (
        "entidad_sk",
        ("id_entidad_federativa", "entidad_federativa"),
        ("id_entidad_federativa", "entidad_federativa"),
    ),
    "dim_fuente_financiamiento": ("ff_sk", ("id_ff", "desc_ff"), ("id_ff", "desc_ff")),
    "dim_clasificacion_economica": (
        "eco_sk",
        (
            "id_capitulo", "desc_capitulo",
            "id_concepto", "desc_concepto",
            "id_partida_generica", "desc_partida_generica",
            "id_partida_especifica", "desc_partida_especifica",
            "id_tipogasto", "desc_tipogasto",
        ),
        ("id_capitulo", "id_concepto", "id_partida_generica", "id_partida_especifica"),
    ),
    "dim_clasificacion_funcional": (
        "func_sk",
        (
            "gpo_funcional", "desc_gpo_funcional",
            "id_funcion", "desc_funcion",
            "id_subfuncion", "desc_subfuncion",
            "id_ai", "desc_ai",
            "id_modalidad", "desc_modalidad",
            "id_pp", "desc_pp",
        ),
        ("gpo_funcional", "id_funcion", "id_subfuncion", "id_pp"),
    ),
}

# --- queries ---------------------------------------------------------------

STAR_VIEW = "vw_olap_star"
VIEW_PREFIX = "vw_olap_"
AXIS_VIEWS = {
    "global": "vw_olap_kpis_global",
    "ramo": "vw_olap_ejecucion_por_ramo",
    "ur": "vw_olap_ejecucion_por_ur",
    "entidad": "vw_olap_ejecucion_por_entidad",
    "capitulo": "vw_olap_ejecucion_por_capitulo",
    "programa": "vw_olap_ejecucion_por_programa",
    "fuente": "vw_olap_ejecucion_por_fuente",
    "banda": "vw_olap_ejecucion_por_banda",
    "tipo_gasto": "vw_olap_ejecucion_por_tipo_gasto",
}
AXIS_FILTERS = {
    "global": ("ciclo",),
    "ramo": ("ciclo", "id_ramo", "desc_ramo"),
    "ur": ("ciclo", "id_ramo", "id_ur", "desc_ur"),
    "entidad": ("ciclo", "id_entidad_federativa", "entidad_federativa"),
    "capitulo": ("ciclo", "id_capitulo", "desc_capitulo"),
    "programa": ("ciclo", "id_pp", "desc_pp", "id_funcion"),
    "fuente": ("ciclo", "id_ff", "desc_ff"),
    "banda": ("ciclo", "banda_ejecucion", "tipo_gasto"),
    "tipo_gasto": ("ciclo", "tipo_gasto"),
}
STAR_FILTERS = (
    "ciclo", "id_ramo", "id_ur", "id_entidad_federativa", "entidad_federativa",
    "id_capitulo", "id_ff", "id_pp", "tipo_gasto", "banda_ejecucion",
    "desc_ramo", "desc_ur",
)
LABEL_COLUMNS = (
    "desc_ramo", "desc_ur", "entidad_federativa", "desc_capitulo", "desc_pp",
    "desc_ff", "banda_ejecucion", "tipo_gasto", "ciclo",
)
LABEL_LENGTH = 40
METRIC_PREFERENCE = (
    "avg_ratio_ejecucion", "sum_monto_pagado", "sum_monto_modificado", "n_registros",
)

# --- modelling -------------------------------------------------------------

REGRESSION_TARGET = "ratio_ejecucion"
CLASSIFICATION_TARGET = "alta_ejecucion"
BUDGET_FEATURES = (
    "monto_aprobado",
    "monto_modificado",
    "monto_aprobado_mensual",
    "monto_modificado_mensual",
)
ID_FEATURES = (
    "ciclo", "id_ramo", "id_ur", "id_entidad_federativa", "gpo_funcional",
    "id_funcion", "id_subfuncion", "id_ai", "id_pp", "id_capitulo",
    "id_concepto", "id_partida_generica", "id_partida_especifica",
    "id_tipogasto", "id_ff",
)
TEXT_FEATURES = (
    "tipo_gasto", "desc_ramo", "desc_ur", "entidad_federativa", "desc_capitulo",
    "desc_concepto", "desc_partida_generica", "desc_partida_especifica",
    "desc_tipogasto", "desc_ff", "desc_gpo_funcional", "desc_funcion",
    "desc_subfuncion", "desc_ai", "desc_modalidad", "desc_pp",
)
# Columns that leak the observed payment or merely identify a row.
BANNED_FEATURES = (
    "monto_pagado", "ratio_ejecucion", "ratio_aprobado", "log1p_monto_pagado",
    "sin_pago", "alta_ejecucion", "sobre_ejecucion", "banda_ejecucion",
    "id_clave_cartera", "fact_sk", "tiempo_sk", "ramo_sk", "ur_sk",
    "entidad_sk", "ff_sk", "eco_sk", "func_sk", "flag_modificado_cero",
    "flag_registro_valido",
)
MAX_LEVELS = 50
SEED = 42
TEST_SHARE = 0.2
# Trees of the boosted candidates; above the number of rows a tenth of them stops the fit.
BOOSTING_SHAPE = {
    "leaves": 31, "depth": 8, "leaf_rows": 20, "rate": 0.08, "patience": 10, "tolerance": 1e-7,
}
BOOSTING_ROWS_TO_STOP_EARLY = 10_000
