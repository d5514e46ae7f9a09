"""SimHash near-duplicates, candidates filtered by the pigeonring principle.

Fingerprints are cut into a ring of segments.  If two differ in at most t bits, then from some
segment on every chain of j segments differs in at most j * t / m of them.  Pairs are therefore
sought by an equal first and a nearly equal second segment, checked along the chain, and only then
by their whole distance.  Equal fingerprints are one node; a pair whose ends are already known to be
connected is not looked at, so a dense group costs no square of its size.

Texts without words (also empty or null ones) have fingerprint zero and link like any other.  A node is a
fingerprint, so rows without a doc_id, or with one that others share, link and bridge like any other;
only they name no component: one without any doc_id has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.store import Store

from .common import DOC, components, text_hash, text_or_empty, tidy, without
from .metric_join import settle

SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fingerprints with one equal segment that a task takes together; beyond, the next one also deals.
TOGETHER = 200_000
#: Rows a task holds at once (or one group), and pairs it compares at once.
HELD_ROWS, PAIRS = 250_000, 1_000_000


def fingerprint(text: bytes, words: int = 4) -> int:
    found = text.translate(LOWER).split()  # at the blanks of the word pattern
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    slices = map(slice, starts, ends[min(words, len(found)) - 1 :].tolist())
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    hashes = np.fromiter(map(digest, map(joined.__getitem__, slices)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, tk, fp): the fingerprint of every whole text, as a signed long, and a hash of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found)], names=["doc_id", "tk", "fp"])

    return docs.select("doc_id", text_or_empty(), text_hash()).mapInArrow(
        tidy("simhash", run), "doc_id long, tk long, fp long")


def segment_widths(bits: int) -> list[int]:
    """One segment more than the bits that may differ, so a chain begins with an equal one."""
    m = bits + 1
    return [64 * (i + 1) // m - 64 * i // m for i in range(m)]


def _ring(fp: np.ndarray, start: int) -> np.ndarray:
    """The fingerprints turned so that the bit ``start`` from the top comes first."""
    if not start:
        return fp
    return fp << np.uint64(start) | fp >> np.uint64(64 - start)


def _links(rows: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Links among rows of equal (i, a, v) that connect all that are at most ``bits`` apart."""
    widths = segment_widths(bits)
    m, starts = len(widths), np.cumsum([0, *widths[:-1]])
    nodes, at = np.unique(rows["rep"].to_numpy(), return_inverse=True)
    label = np.arange(len(nodes))
    group = rows.groupby(["i", "a", "v"], sort=False).ngroup().to_numpy()
    fps, segment = rows["fp"].to_numpy().view(np.uint64), rows["i"].to_numpy()
    for i in np.unique(segment):
        mine = np.flatnonzero(segment == i)
        ring = _ring(fps[mine], int(starts[i]))
        chain = np.cumsum([widths[(i + j) % m] for j in range(m)])
        two = (ring >> np.uint64(64 - chain[1])).astype(np.int64)
        low = two & ((1 << widths[(i + 1) % m]) - 1)
        code = group[mine].astype(np.int64) << widths[(i + 1) % m] | low
        order = np.argsort(code, kind="stable")
        code, ring, node = code[order], ring[order], at[mine][order]
        runs, first, size = np.unique(code, return_index=True, return_counts=True)

        def close(x, y, ring=ring, chain=chain):
            apart, ok = ring[x] ^ ring[y], np.ones(len(x), bool)
            for j in range(1, m):  # budgets of the chains; the last is the whole distance
                part = apart >> np.uint64(64 - chain[j])
                ok &= np.bitwise_count(part) <= (j + 1) * bits // m
            return ok

        lead = np.repeat(first, size)
        near = np.flatnonzero(close(lead, np.arange(len(ring))))
        settle(label, node[lead[near]], node[near])
        pairs = [(np.arange(len(runs)), np.arange(len(runs)))]
        for b in range(widths[(i + 1) % m]):
            other = runs ^ (1 << b)
            found = np.minimum(np.searchsorted(runs, other), len(runs) - 1)
            have = np.flatnonzero((runs[found] == other) & (other > runs))
            pairs.append((have, found[have]))
        left, right = (np.concatenate(p) for p in zip(*pairs, strict=True))
        mixed = label[node]
        least, most = np.minimum.reduceat(mixed, first), np.maximum.reduceat(mixed, first)
        open_ = (least[left] != most[left]) | (least[right] != most[right]) | (least[left] != least[right])
        open_ &= (left != right) | (size[left] > 1)
        left, right = left[open_], right[open_]
        x = np.repeat(first[left], size[left]) + _within(size[left])
        begin, count = np.repeat(first[right], size[left]), np.repeat(size[right], size[left])
        bound = np.cumsum(count)
        cut = np.unique(np.concatenate([[0], np.searchsorted(bound, np.arange(PAIRS, bound[-1] if len(bound) else 0, PAIRS)), [len(x)]]))
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            n = count[s:e]
            p, q = np.repeat(x[s:e], n), np.repeat(begin[s:e], n) + _within(n)
            apart = label[node[p]] != label[node[q]]
            p, q = p[apart], q[apart]
            near = close(p, q)
            settle(label, node[p[near]], node[q[near]])
    linked = label != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[linked], "b": nodes[label[linked]]})


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _whole_groups(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows, cut only between groups."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= HELD_ROWS:
            rows = pd.concat(held, ignore_index=True)
            last = (rows[["i", "a", "v"]] == rows[["i", "a", "v"]].iloc[-1]).all(axis=1)
            if not last.all():
                yield rows[~last]
                rows = rows[last]
            held, n = [rows], len(rows)
    if n:
        yield pd.concat(held, ignore_index=True)


def near_links(nodes: DataFrame, store: Store, bits: int = 4) -> DataFrame:
    """(a, b) links that connect all nodes (fp, rep) at most ``bits`` apart."""
    widths = segment_widths(bits)
    starts = [sum(widths[:i]) for i in range(len(widths))]

    def segment(i):
        start, width = starts[i % len(widths)], widths[i % len(widths)]
        return F.shiftrightunsigned("fp", 64 - start - width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    each = F.explode(F.array(*(
        F.struct(F.lit(i).alias("i"), segment(i).alias("a"), segment(i + 1).alias("next"), F.lit(widths[(i + 1) % len(widths)]).alias("w"))
        for i in range(len(widths))
    ))).alias("s")
    dealt = nodes.select("fp", "rep", each).select("fp", "rep", "s.*")
    large = dealt.groupBy("i", "a").count().where(F.col("count") > TOGETHER).drop("count")
    # at most a row for each value of each segment
    dealt = dealt.join(F.broadcast(large.withColumn("large", F.lit(True))), ["i", "a"], "left")
    flips = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda b: F.expr("1L").cast("long") * F.pow(F.lit(2), b).cast("long"))
    beside = F.transform(F.concat(F.array(F.lit(0).cast("long")), flips), lambda x: F.col("next").bitwiseXOR(x))
    values = F.when(F.col("large"), beside).otherwise(F.array(F.lit(-1).cast("long")))
    rows = dealt.select(F.col("i").cast("long").alias("i"), "a", F.explode(values).alias("v"), "fp", "rep")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _whole_groups(frames):
            yield _links(part, bits)

    ordered = rows.repartition("i", "a", "v").sortWithinPartitions("i", "a", "v")
    return store.save(ordered.mapInPandas(tidy("simhash", run), "a long, b long").distinct())


def _grouped(docs: DataFrame, store: Store, words: int, bits: int) -> DataFrame:
    """(doc_id, tk, fp, root) of every document; the root is the same for all fingerprints that it can
    reach by links."""
    marked = store.save(fingerprints(docs, words))
    nodes = store.save(marked.select("fp").distinct())
    related = components(near_links(nodes.select("fp", F.col("fp").alias("rep")), store, bits), store)
    roots = store.save(
        nodes.join(related.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", F.coalesce("component", "fp").alias("root"))
    )
    return store.save(marked.join(roots, "fp").select(*DOC, "fp", "root"))


def near_duplicates(docs: DataFrame, store: Store, words: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; the fingerprint in hexadecimal."""
    found = _grouped(docs, store, words, bits)
    named = store.save(found.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.join(named, "root").select("doc_id", text, "component_id")


def keep_one(docs: DataFrame, store: Store, words: int = 4, bits: int = 4) -> DataFrame:
    """The documents, of each component only the one with the smallest doc_id; one without an id stays
    only if none of its component has one.  Of different texts with one id the one with the smaller
    hash stays; rows equal in id and text are one document and stay together."""
    found = _grouped(docs, store, words, bits)
    first = store.save(found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk")).alias("kept")))
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("tk") == F.col("kept.tk"))
    gone = found.join(first, "root").where(~stays).select(*DOC).distinct()
    return without(docs, store.save(gone))
