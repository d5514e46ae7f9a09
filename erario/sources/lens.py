"""Order tables seen as budget lines.

Cycle is the order year, branch the supplier region, unit the supplier nation, state the
customer nation, funding source the order priority; part attributes stand for the economic
class and return flag and market segment for the functional class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erario.store import broadcast_file, spread


def path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(path(sf_dir, name))


def lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget lines.  Orders get their customer's columns before they meet the lines, so
    the long table is moved once per large join and never with more than it needs.  A side
    is broadcast if its file is small; otherwise both are shuffled on the key."""

    def sized(rows: DataFrame, name: str) -> DataFrame:
        return broadcast_file(rows, path(sf_dir, name))

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    states = nation.select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.col("n_nationkey").cast("bigint").alias("id_entidad_federativa"),
        F.col("n_name").alias("entidad_federativa"),
    )
    customers = (
        table(spark, sf_dir, "customer").join(sized(states, "nation"), "c_nationkey")
        .select(F.col("c_custkey").alias("o_custkey"), "id_entidad_federativa",
                "entidad_federativa", F.col("c_mktsegment").alias("desc_pp"))
    )
    orders = table(spark, sf_dir, "orders").join(sized(customers, "customer"), "o_custkey").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.year("o_orderdate").cast("bigint").alias("ciclo"),
        "o_orderstatus",
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("id_ff"),
        F.col("o_orderpriority").alias("desc_ff"),
        "id_entidad_federativa", "entidad_federativa", "desc_pp",
    )
    code = F.col("n_nationkey").cast("string")
    units = nation.join(
        sized(region, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        F.col("n_nationkey").alias("s_nationkey"),
        F.col("r_regionkey").cast("bigint").alias("id_ramo"),
        F.col("r_name").alias("desc_ramo"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("U"), code)).otherwise(code).alias("id_ur"),
        F.col("n_name").alias("desc_ur"),
    )
    suppliers = table(spark, sf_dir, "supplier").join(
        sized(units, "nation"), "s_nationkey"
    ).select(
        F.col("s_suppkey").alias("l_suppkey"), "id_ramo", "desc_ramo", "id_ur", "desc_ur"
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.when(F.col("p_size") != 50, F.col("p_size").cast("bigint")).alias("id_capitulo"),
        F.col("p_type").alias("desc_capitulo"),
        F.col("p_brand").alias("desc_concepto"),
    )
    lines = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        ),
        "l_orderkey",
    )
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    number = F.col("l_linenumber")
    exact = price.cast("decimal(12,2)")
    discounted = exact * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
    paid = exact * quantity.cast("decimal(4,0)") * F.lit("0.025").cast("decimal(4,3)")
    joined = (
        lines.join(sized(orders, "orders"), "l_orderkey")
        .join(sized(parts, "part"), "l_partkey")
        .join(sized(suppliers, "supplier"), "l_suppkey")
    )
    return joined.select(
        "ciclo",
        F.col("l_orderkey").alias("id_clave_cartera"),
        "id_ramo", "desc_ramo", "id_ur", "desc_ur",
        "id_entidad_federativa", "entidad_federativa", "id_ff", "desc_ff",
        "id_capitulo", "desc_capitulo", "desc_concepto",
        F.col("l_returnflag").alias("desc_funcion"),
        "desc_pp",
        F.when((F.col("l_returnflag") == "A") & (number == 1), "NO PROGRAMABLE")
        .otherwise("PROGRAMABLE").alias("tipo_gasto"),
        price.alias("monto_aprobado"),
        F.when(number == 7, F.lit(0.0))
        .when((number == 6) & (quantity > 45), -price)
        .when((number == 6) & (quantity < 3), F.lit(None).cast("double"))
        .otherwise(discounted.cast("double")).alias("monto_modificado"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("l_tax") == 0), F.lit(0.0))
        .when((number == 5) & (quantity < 3), F.lit(None).cast("double"))
        .otherwise(paid.cast("double")).alias("monto_pagado"),
    )


def raw_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven text columns of the lens with dirt to clean, plus copies that become exact
    duplicates once texts are stripped."""
    rows = lens(spark, sf_dir)
    source, chapter = F.col("id_ff"), F.col("id_capitulo")
    unit = F.col("desc_ur")
    dirty_unit = (
        F.when(source == 1, F.concat(unit, F.lit("  ")))
        .when(source == 2, F.concat(F.lit(" "), unit))
        .when(source == 3, F.concat(unit, F.lit("\u001c")))
        .otherwise(unit)
    )
    dirty = rows.select(
        F.col("ciclo").cast("string").alias("ciclo"),
        F.col("id_clave_cartera").cast("string").alias("id_clave_cartera"),
        "id_ur",
        dirty_unit.alias("desc_ur"),
        "tipo_gasto",
        F.coalesce(chapter.cast("string"), F.lit("n/d")).alias("id_capitulo"),
        F.when(chapter == 1, "1,000").when(chapter == 2, "1.5d").when(chapter == 3, "")
        .otherwise(F.col("monto_aprobado").cast("decimal(12,2)").cast("string"))
        .alias("monto_aprobado"),
    )
    copies = dirty.filter(F.col("id_capitulo") == "7").withColumn(
        "desc_ur", F.concat(F.lit(" "), "desc_ur")
    )
    return dirty.unionAll(copies)
