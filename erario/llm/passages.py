"""Repeated windows of token sequences: the part that removal by bytes and by words share.

A window is n consecutive tokens of one document.  Of each window the smallest hash of its k-grams
is its anchor, so equal windows have equal anchors, and neighbouring windows mostly share one.
One row an anchor therefore stands for a stretch of windows:

* an anchor that occurs once in the corpus has no repeated window;
* if all stretches of an anchor are equal, and there are several, all their windows repeat;
* otherwise one stretch of each kind is looked at window by window, by the operator's own method.

No window is lost by this, and only the last case costs work by the window.  Documents are told
apart by doc_id (which may be null) and a 64-bit hash of the text; equal rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario.store import Store

from .common import DOC, SAME_DOC, text_hash, text_or_empty

#: Tokens looked at together; longer documents go in such pieces, which overlap by a window.
PIECE = 1 << 22
POSITION = np.uint64((1 << 24) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: A window's place in its document.


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2**64, and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = tuple(both)
    return have[0][:n], have[1][:n]


def rolling(x: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes of all stretches of n numbers, mixed."""
    up, down = powers(base, len(x))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up, dtype=np.uint64)])
    h = (sums[n:] - sums[:-n]) * down[: len(x) - n + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(a: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (w - span)], a[w - span :]) if w > span else a


def stretches(x: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, last window) of each stretch of a sequence."""
    out = []
    for at in range(0, len(x) - n + 1, PIECE):
        piece = x[at : at + PIECE + n - 1]
        grams = rolling(piece, k)
        key = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_least(key, n - k + 1) & POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        out.append((grams[place[first]], place[first] + at, first + at, last + at))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_hash(), text_or_empty())


def anchors(docs: DataFrame, tokens: Callable[[bytes], np.ndarray], n: int, k: int) -> DataFrame:
    """(h, c, doc_id, tk, lo, hi): each stretch with its anchor's hash and the hash of its tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                x = tokens(text.as_py())
                h, place, lo, hi = stretches(x, n, k)
                raw, size = x.tobytes(), x.itemsize
                c = [
                    xxhash.xxh3_64_intdigest(raw[a * size : (b + n) * size], seed=p - a)
                    for p, a, b in zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True)
                ]
                rows.append(np.full(len(h), i))
                parts.append((h.view(np.int64), np.array(c, np.uint64).view(np.int64), lo, hi))
            h, c, lo, hi = (np.concatenate(p) for p in zip(*parts, strict=True))
            of = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(c), batch.column(0).take(of), batch.column(1).take(of), pa.array(lo), pa.array(hi)],
                names=["h", "c", "doc_id", "tk", "lo", "hi"],
            )

    return keyed(docs).mapInArrow(run, "h long, c long, doc_id long, tk long, lo long, hi long")


def candidates(docs: DataFrame, tokens: Callable[[bytes], np.ndarray], n: int, k: int, store: Store) -> DataFrame:
    """The stretches whose anchor repeats; ``alike`` if all stretches of the anchor are equal."""
    found = store.save(anchors(docs, tokens, n, k))
    repeated = store.save(
        found.groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1"))
        .where("m > 1").select("h", (F.col("c0") == F.col("c1")).alias("alike"))
    )
    return store.save(found.join(repeated, "h"))


def kinds(found: DataFrame, store: Store) -> DataFrame:
    """(h, c, n, doc_id, tk, lo, hi): one stretch of each kind that must be looked at by the window,
    and how many are like it."""
    return store.save(
        found.where("not alike").groupBy("h", "c")
        .agg(F.count("*").alias("n"), F.min(F.struct(*DOC, "lo", "hi")).alias("s"))
        .select("h", "c", "n", "s.*")
    )


def with_texts(docs: DataFrame, spans: DataFrame, fields: Column, how: str = "inner") -> DataFrame:
    """(doc_id, tk, text, spans): documents with the list of what is known of each."""
    lists = spans.groupBy(*DOC).agg(F.collect_list(fields).alias("spans"))
    return (
        keyed(docs).alias("a").join(lists.alias("b"), F.expr(SAME_DOC), how)
        .select("a.doc_id", "a.tk", "a.text", "spans")
    )


def marked(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, tk, lo, hi) of runs of repeated windows, from those of each kind: rows (h, c, runs)
    with runs of (first, last) counted from the stretch's first window."""
    alike = found.where("alike").select(*DOC, "lo", "hi")
    rest = (
        found.where("not alike").join(repeated, ["h", "c"])
        .select(*DOC, "lo", F.explode("runs").alias("run"))
        .select(*DOC, (F.col("lo") + F.col("run.first")).alias("lo"), (F.col("lo") + F.col("run.last")).alias("hi"))
    )
    return alike.unionByName(rest)


def covered(lo: np.ndarray, hi: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` tokens lie in a window that starts in one of the runs."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, hi + n, -1)
    return np.cumsum(step[:size]) > 0


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def remove(
    docs: DataFrame, found: DataFrame, repeated: DataFrame,
    finish: Callable[[bytes, np.ndarray, np.ndarray], tuple], schema: str,
) -> DataFrame:
    """``finish`` of every document's text and its runs (first windows, last windows)."""
    spans = marked(found, repeated)
    joined = with_texts(docs, spans, F.struct("lo", "hi"), "left").select("doc_id", "text", "spans")
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                lo, hi = _bounds(own)
                out.append(finish(text.as_py(), lo, hi))
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return joined.mapInArrow(run, f"doc_id long, {schema}")


def _bounds(spans: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    if not spans.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fields = spans.values
    return fields.field("lo").to_numpy(), fields.field("hi").to_numpy()
