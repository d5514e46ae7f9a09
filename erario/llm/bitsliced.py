"""Exact top-k inner products over a bit-sliced index.

A block of rows holds each attribute as bitmaps, one a bit.  A query's score is the sum of the
attributes times its own components, so the index adds shifted slices with bitmap arithmetic: full
adders over whole columns of bitmaps.  The largest scores are then selected from the most
significant slice of the sum downward; rows that tie at the boundary are taken by smaller id.

Vectors that are null or hold null or non-finite components take no part.  Of vectors of different
length the shorter counts as padded with zeros; an empty one scores 0.  Rows with an equal vec_id
are candidates of their own, but none of them is a candidate of a query with that id.  Query rows
equal in id and vector are one query; different vectors with one id are queries of their own, each with
its own k rows.  A row without an id is a candidate like any other, the last among equal scores.
Quantised components and scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erario.store import Store

BLOCK_ROWS = 1 << 15
QUERY_ROWS = 512


def usable(name: str = "embedding") -> Column:
    """Neither null nor with a component that is null, infinite or no number."""
    odd = F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(name).isNotNull() & ~F.coalesce(odd, F.lit(False))


def quantised(name: str = "embedding", scale: int = 64) -> Column:
    return F.transform(name, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def matrix(rows: pd.Series, kind: type = np.int64) -> np.ndarray:
    rows = [np.asarray(r, kind) for r in rows]
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.stack(rows) if rows else np.zeros((0, 0), kind)
    return np.stack([np.pad(r, (0, width - len(r))) for r in rows])


class BitSlices:
    """Bitmaps of a block's attributes: ``slices[attribute, bit, word]`` of values less their least."""

    def __init__(self, values: np.ndarray):
        self.rows, width = values.shape
        self.least = values.min(axis=0) if self.rows else np.zeros(width, np.int64)
        above = (values - self.least).T.astype(np.uint64)
        self.bits = max(1, int(above.max(initial=0)).bit_length())
        self.words = -(-max(self.rows, 1) // 64)
        self.slices = np.zeros((width, self.bits, self.words), np.uint64)
        for b in range(self.bits):
            plane = (above >> np.uint64(b)).astype(np.uint8) & 1
            packed = np.packbits(plane, axis=1, bitorder="little")
            self.slices[:, b].view(np.uint8)[:, : packed.shape[1]] = packed
        self.all = pack(np.ones(self.rows, bool), self.words)

    def score(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores of all rows, from the least significant, and what to add to them."""
        used = min(len(query), len(self.least))
        query, least = query[:used], self.least[:used]
        weight, negative = np.abs(query), query < 0
        top = (1 << self.bits) - 1
        base = sum(int(q) * int(x) for q, x in zip(query, least, strict=True))
        base += sum(int(q) * top for q in query[negative])
        planes = self.slices[:used].copy()
        planes[negative] ^= ~np.uint64(0)  # a negative weight counts what is missing to the top
        columns: dict[int, list[np.ndarray]] = {}
        for shift in range(int(weight.max(initial=0)).bit_length()):
            chosen = planes[(weight >> shift) & 1 == 1]
            for b in range(self.bits):
                columns.setdefault(b + shift, []).append(chosen[:, b])
        out, at = [], 0
        while at in columns:
            stack = np.concatenate(columns[at])
            while len(stack) > 2:
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                both = a ^ b
                columns.setdefault(at + 1, []).append((a & b) | (both & c))
                stack = np.concatenate([both ^ c, stack[3 * third :]])
            if len(stack) == 2:
                columns.setdefault(at + 1, []).append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            at += 1
        return out, base

    def top(self, query: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k largest; equal scores by smaller row number."""
        slices, base = self.score(query)
        sure, open_ = np.zeros(self.words, np.uint64), self.all.copy()
        if without is not None:
            open_ &= ~without
        need = k
        for plane in reversed(slices):
            ones = open_ & plane
            n = int(np.bitwise_count(ones).sum())
            if n > need:
                open_ = ones
            else:
                sure |= ones
                need -= n
                open_ &= ~plane
            if not need:
                break
        rows = np.concatenate([unpack(sure), unpack(open_)[:need]])
        scores = [
            base + sum(int(s[r >> 6] >> np.uint64(r & 63) & np.uint64(1)) << i for i, s in enumerate(slices))
            for r in rows.tolist()
        ]
        return rows, np.array(scores, np.int64)


def pack(flags: np.ndarray, words: int) -> np.ndarray:
    packed = np.packbits(flags, bitorder="little")
    return np.pad(packed, (0, 8 * words - len(packed))).view(np.uint64)


def unpack(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_k(vectors: DataFrame, store: Store, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the query rows against all rows.

    Blocks of queries meet blocks of rows; each pair of blocks is a task that gives k rows a query.
    """
    rows = store.save(
        vectors.where(usable()).select(
            F.col("vec_id").cast("long").alias("vec_id"), quantised(scale=scale).alias("x"),
            is_query.alias("is_query"),
        )
    )
    n = rows.count()
    blocks, parts = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n // (20 * QUERY_ROWS)))
    block, part = F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)), F.pmod(F.xxhash64("x", "vec_id"), F.lit(parts))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>"))
    # Ids never pass through a column with nulls, which would turn them into doubles.
    no_id = F.col("vec_id").isNull().alias("no_id")
    left = rows.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), no_id, "x", block.alias("block"), each(parts).alias("part"))
    right = rows.where("is_query").select("vec_id", "x").distinct().select(
        F.col("vec_id").alias("query_id"), F.col("x").alias("q"), F.xxhash64("x").alias("of"),
        each(blocks).alias("block"), part.alias("part"))

    def search(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pd.DataFrame(FOUND), *_found(own, asked, k)])[["query_id", "of", "vec_id", "no_id", "score"]]

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(
        search, "query_id long, of long, vec_id long, no_id boolean, score long"
    ).withColumn("vec_id", F.when(~F.col("no_id"), F.col("vec_id")))
    order = Window.partitionBy("query_id", "of").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


FOUND = {name: np.zeros(0, np.int64) for name in ("query_id", "of", "vec_id", "score")} | {"no_id": np.zeros(0, bool)}


def _found(own: pd.DataFrame, asked: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    if own.empty or asked.empty:
        return
    own = own.sort_values(["no_id", "vec_id"], kind="stable")
    ids, no_id = own["vec_id"].to_numpy(np.int64), own["no_id"].to_numpy(bool)
    known = ids[: len(ids) - int(no_id.sum())]
    index = BitSlices(matrix(own["x"]))
    for query_id, of, x in zip(asked["query_id"].to_numpy(np.int64), asked["of"].to_numpy(np.int64), asked["q"], strict=True):
        a, b = np.searchsorted(known, query_id), np.searchsorted(known, query_id, "right")
        self_rows = None
        if a < b:
            flags = np.zeros(len(ids), bool)
            flags[a:b] = True
            self_rows = pack(flags, index.words)
        rows, scores = index.top(np.asarray(x, np.int64), k, self_rows)
        yield pd.DataFrame({
            "query_id": query_id, "of": of, "vec_id": ids[rows], "no_id": no_id[rows], "score": scores})
