"""Embedding near-duplicates by an exact metric range join.

A cosine of at least c between vectors is a distance of at most e = sqrt(2 - 2c) between their unit
vectors.  Pivots partition the vectors: each belongs to the cell of its nearest pivot.  By the
triangle inequality a vector within e of a cell's member is no farther from that cell's border than
e, so only such vectors are replicated into the cell, and cells join independently.  Of two cells,
the one of the earlier pivot holds the pairs across them.  Equal vectors are joined once.

Vectors that are null, zero or hold null or non-finite components, and vectors of different length,
link with nothing.  Repeated rows count as vectors of their own.  A node is a vector, so rows without
a vec_id, or with one that others share, link and bridge like any other; only they name no component:
one without any vec_id has none, and none of it is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.store import Store

from .bitsliced import matrix, usable
from .common import components

#: Vectors a cell has on average, and the most pivots (they go to every task).
CELL_ROWS, MOST_PIVOTS = 4096, 512
#: A task joins so many of a cell's own vectors with so many of its members; larger cells are cut.
OWN_ROWS, MEMBER_ROWS = 4096, 16384
SLACK = 1e-9
STEP = 256


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lower the labels in place until both ends of every pair share the smallest one."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(jump := label[label], label):
            label[:] = jump
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(axis=1))
    return x / norm[:, None], norm


def _join(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one pair of blocks: rows with what they are linked to, and a smaller relative."""
    own, met = group[group["left"]], group[~group["left"]]
    if own.empty or met.empty:
        return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
    (a, ra), (b, rb) = (_units(matrix(g["embedding"], np.float64)) for g in (own, met))
    xa, xb = matrix(own["embedding"], np.float64), matrix(met["embedding"], np.float64)
    ids = np.unique(np.concatenate([own["rep"], met["rep"]]))
    ia, ib = np.searchsorted(ids, own["rep"]), np.searchsorted(ids, met["rep"])
    na, nb, copy = own["n"].to_numpy(), met["n"].to_numpy(), ~met["native"].to_numpy()
    label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for at in range(0, len(a), STEP):
        r, c = np.nonzero(a[at : at + STEP] @ b.T >= cosine - SLACK)
        r += at
        close = np.einsum("ij,ij->i", xa[r], xb[c]) / (ra[r] * rb[c]) >= cosine
        keep = close & (ia[r] != ib[c])
        r, c = r[keep], c[keep]
        links += np.bincount(ia[r], nb[c], len(ids)).astype(np.int64)
        there = copy[c]
        links += np.bincount(ib[c[there]], na[r[there]], len(ids)).astype(np.int64)
        settle(label, ia[r], ib[c])
    some = links > 0
    return pd.DataFrame({"rep": ids[some], "links": links[some], "root": ids[label[some]]})


def near_duplicates(vectors: DataFrame, store: Store, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    numbered = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = usable() & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    distinct = store.save(
        numbered.where(good).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
        .withColumns({"width": F.size("embedding"), "rep": F.monotonically_increasing_id()})
    )
    rows = distinct  # stored, so the numbers of the vectors stay
    counts = rows.groupBy("width").count().collect()  # a row a vector length
    parts = [store.save(_linked(rows.where(F.col("width") == c["width"]), c["count"], store, cosine))
             for c in counts]
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "rep long, links long, root long")
    found = store.save(_union(parts, empty))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    related = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), store)
    placed = store.save(
        rows.join(links, "rep", "left").join(related.withColumnRenamed("node", "rep"), "rep", "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least",
                F.coalesce("component", "rep").alias("root"))
    )
    named = store.save(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    known = placed.join(named, "root").select("embedding", "n_links", "component_id")
    return (
        numbered.join(known, "embedding", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    for part in parts:
        empty = empty.unionByName(part)
    return empty


def _linked(rows: DataFrame, n: int, store: Store, cosine: float) -> DataFrame:
    most = min(MOST_PIVOTS, -(-n // CELL_ROWS))
    chosen = rows.orderBy(F.xxhash64("rep"), "rep").limit(most).select("embedding").collect()
    pivots, _ = _units(np.array([r[0] for r in chosen], np.float64))
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    def place(frames):
        for frame in frames:
            if frame.empty:
                continue
            x, _ = _units(matrix(frame["embedding"], np.float64))
            square = np.maximum(0, 2 - 2 * x @ pivots.T)
            cell = square.argmin(axis=1)
            # twice the distance to the border of the two cells, times the distance of the pivots
            border = square - square[np.arange(len(x)), cell][:, None]
            inside = border <= 2 * reach * apart[cell] + 1e-9
            inside &= np.arange(len(pivots))[None, :] < cell[:, None]
            inside[np.arange(len(x)), cell] = True
            r, c = np.nonzero(inside)
            out = frame.iloc[r]
            yield out.assign(cell=c, native=c == cell[r])[["rep", "n", "embedding", "cell", "native"]]

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = store.save(rows.select("rep", "n", "embedding").mapInPandas(
        place, f"rep long, n long, embedding {kind}, cell long, native boolean"
    ))
    sizes = placed.groupBy("cell").agg(F.count_if("native").alias("own"), F.count("*").alias("met"))
    cut = sizes.select(  # a row a pivot
        "cell", F.ceil(F.col("own") / OWN_ROWS).alias("owns"), F.ceil(F.col("met") / MEMBER_ROWS).alias("mets")
    )
    cells = placed.join(F.broadcast(cut), "cell")
    own_block = F.pmod(F.xxhash64("rep"), F.greatest("owns", F.lit(1)))
    met_block = F.pmod(F.xxhash64("rep"), F.greatest("mets", F.lit(1)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.greatest(F.col(count), F.lit(1)) - 1))
    fields = ["cell", "rep", "n", "embedding", "native"]
    left = cells.where("native").select(*fields, own_block.alias("i"), every("mets").alias("j"), F.lit(True).alias("left"))
    right = cells.where("owns > 0").select(*fields, every("owns").alias("i"), met_block.alias("j"), F.lit(False).alias("left"))
    return left.unionByName(right).groupBy("cell", "i", "j").applyInPandas(
        lambda g: _join(g, cosine), "rep long, links long, root long"
    )
