"""Substring removal by bytes with suffix arrays: strings of n bytes that start anywhere else go.

Stretches of text that share an anchor but differ (see ``passages``) are put into shards by anchor.
A shard's suffixes are ordered by Larsson-Sadakane refinement: by eight bytes at first, then groups
that are still equal are ordered by the rank of what follows, doubling the depth until the window
is passed.  Kasai's pass gives the common prefixes of neighbours.  An anchor with very many
stretches spans several shards; every pair of them is merged by binary search of the one's windows
in the other's suffix array.

Null texts are empty.  Strings never cross documents and are judged on the input: copies of a
document of n bytes or more are removed wholly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.store import Store

from .passages import candidates, covered, kinds, remove, runs_of, with_texts

GRAM = 32
#: Bytes of text in a shard, and stretches of one anchor that are kept together.
SHARD_BYTES, TOGETHER = 4 << 20, 8_000
#: A number for each byte value, for the hashes of anchors.
_BYTES = np.random.default_rng(12345).integers(1, 1 << 63, 256, dtype=np.uint64)


def byte_numbers(text: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(text, np.uint8)]


class Shard:
    """A text made of parts, its suffix array to a depth, and common prefixes of neighbours."""

    def __init__(self, parts: list[bytes], n: int):
        self.n = n
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.size = int(self.sizes.sum())
        text = np.frombuffer(b"".join(parts) + bytes(n + 16), np.uint8)
        #: The eight bytes from each place on, as one number that orders as they do.
        self.eight = np.zeros(self.size + n + 8, np.uint64)
        for b in range(8):
            self.eight |= text[b : b + len(self.eight)].astype(np.uint64) << np.uint64(56 - 8 * b)

    def order(self) -> np.ndarray:
        """Suffixes in order of their first n bytes or more."""
        first = self.eight[: self.size]
        sa = np.argsort(first, kind="stable")
        new = np.concatenate([[True], first[sa][1:] != first[sa][:-1]]) if len(sa) else np.zeros(0, bool)
        rank = np.zeros(self.size + 1, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0)) + 1  # 0: behind the end
        depth = 8
        while depth < self.n:
            alone = new & np.concatenate([new[1:], [True]])
            at = np.flatnonzero(~alone)
            if not len(at):
                break
            sub = sa[at]
            group, behind = rank[sub], rank[np.minimum(sub + depth, self.size)]
            by = np.lexsort((behind, group))
            sa[at], group, behind = sub[by], group[by], behind[by]
            start = np.concatenate([[True], (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])])
            new[at] |= start
            rank[sa[at]] = at[np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))] + 1
            depth *= 2
        self.sa = sa
        return sa

    def prefixes(self) -> np.ndarray:
        """By place, the bytes that its suffix shares with the one before it in order, up to n.

        Kasai's pass over all parts side by side: going one place on loses one byte at most.  That
        holds where the order is settled by a difference; suffixes equal in n bytes start anew.
        """
        before = np.full(self.size, -1, np.int64)
        before[self.sa[1:]] = self.sa[:-1]
        out = np.zeros(self.size, np.int64)
        shared = np.zeros(len(self.starts), np.int64)
        for step in range(int(self.sizes.max(initial=0))):
            part = np.flatnonzero(self.sizes > step)
            place = self.starts[part] + step
            other = before[place]
            have = np.maximum(shared[part] - 1, 0)
            have[(other < 0) | (have == self.n - 1)] = 0
            open_ = np.flatnonzero(other >= 0)
            while len(open_):
                x = self.eight[np.minimum(place[open_] + have[open_], self.size + self.n)]
                y = self.eight[np.minimum(other[open_] + have[open_], self.size + self.n)]
                same = np.zeros(len(open_), np.int64)
                diff = x ^ y
                for b in range(8):
                    same += diff >> np.uint64(56 - 8 * b) == 0
                have[open_] += same
                open_ = open_[(same == 8) & (have[open_] < self.n)]
            out[place] = shared[part] = np.minimum(have, self.n)
        return out

    def window_places(self) -> np.ndarray:
        flags = np.ones(self.size, bool)
        for back in range(1, self.n):
            flags[(self.starts + self.sizes - back)[self.sizes >= back]] = False
        return flags

    def repeated(self) -> np.ndarray:
        """Places whose n bytes, within their part, occur at another place."""
        fits = self.window_places()
        sa = self.order()
        shared = self.prefixes()
        # suffixes that run over their part's end never count: their neighbours are compared anew
        own = sa[fits[sa]]
        groups = np.cumsum(np.concatenate([[0], shared[sa[1:]] < self.n])) if len(sa) else np.zeros(0, np.int64)
        number = groups[fits[sa]]
        again = np.bincount(number, minlength=1)[number] > 1 if len(number) else np.zeros(0, bool)
        out = np.zeros(self.size, bool)
        out[own[again]] = True
        return out

    def holds(self, other: Shard) -> np.ndarray:
        """Which windows of the other shard occur in this one, by binary search of its suffixes."""
        mine = self.sa[self.window_places()[self.sa]]
        asked = np.flatnonzero(other.window_places())
        out = np.zeros(other.size, bool)
        if not len(mine) or not len(asked):
            return out
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(mine))
        while (todo := np.flatnonzero(low < high)).size:
            middle = (low[todo] + high[todo]) // 2
            less = self._compare(mine[middle], other, asked[todo]) < 0
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]
        inside = np.flatnonzero(low < len(mine))
        equal = self._compare(mine[low[inside]], other, asked[inside]) == 0
        out[asked[inside[equal]]] = True
        return out

    def _compare(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        sign, open_ = np.zeros(len(mine), np.int8), np.arange(len(mine))
        for at in range(0, self.n, 8):
            x, y = self.eight[mine[open_] + at], other.eight[theirs[open_] + at]
            if (rest := self.n - at) < 8:
                x, y = x >> np.uint64(64 - 8 * rest), y >> np.uint64(64 - 8 * rest)
            sign[open_] = (x > y).astype(np.int8) - (x < y)
            open_ = open_[x == y]
        return sign


def _pieces(spans: DataFrame, n: int) -> DataFrame:
    """(h, c, piece): the bytes of the listed stretches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, pieces = [], [], []
            for text, own in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                whole = text.as_py()
                for s in own.as_py():
                    h.append(s["h"])
                    c.append(s["c"])
                    pieces.append(whole[s["lo"] : s["hi"] + n])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(pieces, pa.binary())], names=["h", "c", "piece"]
            )

    return spans.select("text", "spans").mapInArrow(run, "h long, c long, piece binary")


RUNS = "h long, c long, runs array<struct<first: long, last: long>>"


def _runs(rows: pd.DataFrame, shard: Shard, flags: np.ndarray) -> pd.DataFrame:
    out = []
    for start, size in zip(shard.starts, shard.sizes, strict=True):
        first, last = runs_of(flags[start : start + size])
        out.append([{"first": int(a), "last": int(b)} for a, b in zip(first, last, strict=True)])
    found = pd.DataFrame({"h": rows["h"].to_numpy(), "c": rows["c"].to_numpy(), "runs": out})
    return found[[bool(x) for x in out]]


def repeated_runs(docs: DataFrame, stretches: DataFrame, n: int, store: Store, together: int = TOGETHER) -> DataFrame:
    """(h, c, runs) of the repeated windows of each kind of stretch."""
    spans = with_texts(docs, stretches, F.struct("h", "c", "lo", "hi"))
    pieces = store.save(_pieces(spans, n))
    total = pieces.agg(F.sum(F.length("piece"))).head()[0] or 0
    shards = -(-total // SHARD_BYTES) or 1
    crowded = pieces.groupBy("h").count().where(F.col("count") > together)
    crowded = store.save(crowded.select("h", F.ceil(F.col("count") / together).alias("parts")))
    placed = pieces.join(crowded, "h", "left").withColumn("part", F.pmod("c", F.coalesce("parts", F.lit(1))))

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(list(rows["piece"]), n)
        return _runs(rows, shard, shard.repeated())

    group = F.when(F.col("parts").isNull(), F.pmod("h", F.lit(shards))).otherwise(F.col("h"))
    single = placed.withColumn("shard", group).groupBy(
        F.col("parts").isNotNull(), "shard", "part").applyInPandas(alone, RUNS)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[rows["part"] == p] for p in key[1:])
        a, b = Shard(list(left["piece"]), n), Shard(list(right["piece"]), n)
        a.order()
        b.order()
        return pd.concat([_runs(left, a, b.holds(a)), _runs(right, b, a.holds(b))])

    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    crossing = (
        placed.where("parts is not null").withColumn("other", others).where("other <> part")
        .withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
        .groupBy("h", "i", "j").applyInPandas(merge, RUNS)
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("hi") - F.col("lo")).alias("last")))
    several = stretches.where("n > 1").select("h", "c", whole.alias("runs"))
    return store.save(
        single.unionByName(crossing).unionByName(several)
        .groupBy("h", "c").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    )


def remove_repeats(docs: DataFrame, store: Store, n: int = 200, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left of every text, as bytes."""
    found = candidates(docs, byte_numbers, n, gram, store)
    repeated = repeated_runs(docs, kinds(found, store), n, store)

    def finish(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, int, bytes]:
        if not len(lo):
            return len(text), 0, 0, text
        gone = covered(lo, hi, n, len(text))
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return len(text), int(gone.sum()), len(runs_of(gone)[0]), kept

    return remove(docs, found, repeated, finish, "n_bytes long, n_removed long, n_spans long, kept binary")
