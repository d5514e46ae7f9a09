"""Centroid clustering of integer vectors in built-in expressions only.

Distances are folds of ``zip_with`` over literal centroid arrays, ``array_min`` of (distance, number)
structs picks the cluster, and a round's new centroids come from plain column sums by cluster, which
add up inside each task first: at most one row a cluster leaves a task, however large the cluster.
All arithmetic is on whole numbers, so results do not depend on the order of rows.

Rows that take no part and give no row: a null vector, one of another length, and one with a null,
NaN or infinite component.  A repeated row counts and is returned once for each copy, and so do rows
that share an id.  A row without an id is clustered like any other, but starts a cluster only if there
are too few others.  With fewer vectors than clusters, each vector starts one; an empty table gives no
rows.  Of columns beside the id and the vector none is read.  Components of 2^27 quantised units or
more stop the job, as the squared distances of the contract would not fit a long.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario.store import Store

#: Quantised components below this keep every sum of 64 squared differences within a long.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of the rows that take part, components as whole numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taking_part = F.coalesce((F.size("embedding") == dims) & finite, F.lit(False))

    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        too_large = F.raise_error(F.lit(f"a component exceeds {LARGEST} units")).cast("bigint")
        return F.when(F.abs(y) < float(LARGEST), F.floor(y)).otherwise(too_large)

    return vectors.where(taking_part).select("vec_id", F.transform("embedding", whole).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest seeded hashes; k rows reach the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    picked = rows.select(name.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return [list(r["v"]) for r in picked.collect()]


def nearest(centroids: list[list[int]]) -> Column:
    """A struct (distance, cluster) of the nearest centroid; of a tie the smaller number."""
    def away(centre: list[int]) -> Column:
        literal = F.expr(f"array({', '.join(f'{c}L' for c in centre)})")
        squares = F.zip_with("v", literal, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("bigint"), lambda total, x: total + x)

    return F.array_min(F.array(*[
        F.struct(away(c).alias("distance"), F.lit(j).alias("cluster")) for j, c in enumerate(centroids)
    ]))


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; a row a cluster reaches the driver."""
    dims = range(len(centroids[0]))
    sums = (
        rows.select(nearest(centroids)["cluster"].alias("cluster"), "v").groupBy("cluster")
        .agg(F.count("*").alias("n"), *[F.expr(f"sum(v[{i}]) AS s{i}") for i in dims]).collect()
    )
    after = list(centroids)
    for r in sums:
        after[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in dims]  # rounds down, below zero too
    return after


def cluster(
    vectors: DataFrame, store: Store, *, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024,
    seed: int = 3,
) -> tuple[DataFrame, list[list[int]]]:
    """Rows (vec_id, cluster, distance) of every vector that takes part, and the final centroids.
    Rounds end early once no centroid moves, as all later ones would repeat that."""
    rows = store.save(quantised(vectors, dims, scale))
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    for _ in range(rounds):
        before, centroids = centroids, moved(rows, centroids)
        if before == centroids:
            break
    best = rows.select("vec_id", nearest(centroids).alias("best"))
    return store.save(best.select("vec_id", "best.cluster", "best.distance")), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds the distance summed over a row's cluster and over all, and a digest of its centroid."""
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def of_cluster(values: list, kind: str) -> Column:
        return reduce(
            lambda out, j: F.when(F.col("cluster") == j, F.lit(values[j])).otherwise(out),
            range(len(values)), F.lit(None)).cast(kind)

    return assigned.select(
        "vec_id", "cluster", "distance",
        of_cluster([sums.get(j) for j in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"), of_cluster(digest, "string").alias("centroid_sha256"))
