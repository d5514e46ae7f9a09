"""Substring removal by words: windows of n words that repeat anywhere are removed.

Words are hashed; Rabin-Karp hashes of the windows (two of 64 bits) are counted in Spark, and
repeated windows merge into maximal intervals.  Windows that an anchor proves to be unique, or to
repeat with their whole stretch, need no count of their own (see ``passages``).

Null and empty texts have no words; texts shorter than a window keep all words.  Windows are judged
on the input: copies of a document are all removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.store import Store

from .passages import candidates, covered, kinds, remove, rolling, with_texts

GRAM = 8
SECOND_BASE = 0xC2B2AE3D27D4EB4F | 1


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _windows(spans: DataFrame, n: int) -> DataFrame:
    """(h, c, at, w1, w2) of all windows of the listed stretches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                x, out = word_hashes(text.as_py()), []
                for s in own.as_py():
                    part = x[s["lo"] : s["hi"] + n]
                    first, second = (rolling(part, n, b).view(np.int64) for b in (SECOND_BASE - 2, SECOND_BASE))
                    size = len(first)
                    out.append((np.full(size, s["h"]), np.full(size, s["c"]), np.arange(size), first, second))
                columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "c", "at", "w1", "w2"])

    return spans.select("text", "spans").mapInArrow(run, "h long, c long, at long, w1 long, w2 long")


def repeated_runs(docs: DataFrame, stretches: DataFrame, n: int, store: Store) -> DataFrame:
    """(h, c, runs) of the repeated windows of each kind of stretch."""
    spans = with_texts(docs, stretches, F.struct("h", "c", "lo", "hi"))
    windows = store.save(_windows(spans, n))
    often = store.save(windows.groupBy("w1", "w2").count().where("count > 1").drop("count"))
    hits = windows.join(often, ["w1", "w2"]).select("h", "c", "at")
    several = stretches.where("n > 1").select("h", "c", F.explode(F.sequence(F.lit(0), F.col("hi") - F.col("lo"))).alias("at"))
    places = hits.unionByName(several).groupBy("h", "c").agg(F.sort_array(F.collect_set("at")).alias("at"))
    one = F.transform("at", lambda x: F.struct(x.alias("first"), x.alias("last")))
    return store.save(places.select("h", "c", one.alias("runs")))


def remove_repeats(docs: DataFrame, store: Store, n: int = 35, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): what is left of every text, its words joined by a blank."""
    found = candidates(docs, word_hashes, n, gram, store)
    repeated = repeated_runs(docs, kinds(found, store), n, store)

    def finish(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, str]:
        words = text.split()
        gone = covered(lo, hi, n, len(words))
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(lo) else words
        return len(words), int(gone.sum()), b" ".join(kept).decode()

    return remove(docs, found, repeated, finish, "n_words long, n_removed long, kept string")
