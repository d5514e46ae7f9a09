"""Line removal by log templates.

A tree of fixed depth parses every line: by its number of tokens, then by its leading tokens, where
a token that holds a digit stands for any other.  In a leaf, a token is a fixed part of its position
if enough documents have it there, in number and as a share (``COMMON``) of the leaf's documents, so
that the values of a field do not become fixed as the corpus grows; other tokens become variable
fields.  A line whose tokens are mostly fixed belongs to the template of its fixed tokens, any other is a template of its own.  Lines
of templates that recur in enough documents are dropped everywhere but in the first such document
(by doc_id), so no text is lost wholly.  With ``min_long``, a long line is also dropped if it recurs
by itself in that many documents, as it is no phrase that writers find on their own.

Copies of a whole text count as one document, and so do several lines of a template or with a token in
one text.  Lines without tokens stay; so do empty and null
texts.  A row without a doc_id is never the first document, unless no row of the template has one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from erario.store import Store

from .common import DOC, SAME_DOC, split_by_keys, text_hash, tidy
from .passages import keyed, with_texts

LEADING = 3
MIN_DOCS = 5
#: Lines of so many tokens are long, and for how many documents they recur, where that is asked for.
LONG, MIN_LONG = 50, 2
MIN_FIXED = 0.5
#: Of a leaf's documents, the share that must have a token in its place for it to be fixed.
COMMON = 0.25
ANY = b"<*>"
_VARIABLE = re.compile(rb"[^ ]*[0-9][^ ]*")


def masked(line: bytes) -> bytes:
    """The tokens joined by a blank, those with a digit replaced."""
    return _VARIABLE.sub(ANY, b" ".join(line.split()))


def leaf_of(line: bytes) -> int:
    tokens = line.split(b" ")
    return xxhash.xxh3_64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:LEADING]))


def is_long(line: bytes) -> bool:
    tokens = line.split(b" ")
    return len(tokens) >= LONG and 2 * tokens.count(ANY) < len(tokens)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def lines(docs: DataFrame) -> DataFrame:
    """(leaf, line, doc_id, tk, no, long) of every line that has tokens; leaf and line are hashes, and
    lines that are mostly variable are not long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, no, leaf, line, long = [], [], [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                for j, raw in enumerate(text.as_py().split(b"\n")):
                    if known := masked(raw):
                        of.append(i)
                        no.append(j)
                        leaf.append(leaf_of(known))
                        line.append(xxhash.xxh3_64_intdigest(known))
                        long.append(is_long(known))
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [_signed(leaf), _signed(line), batch.column(0).take(at), batch.column(1).take(at), pa.array(no, pa.int32()),
                 pa.array(long, pa.bool_())],
                names=["leaf", "line", "doc_id", "tk", "no", "long"],
            )

    return keyed(docs).mapInArrow(tidy("lines", run), "leaf long, line long, doc_id long, tk long, no int, long boolean")


def _tokens(spans: DataFrame) -> DataFrame:
    """(line, tokens) of the listed lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, tokens = [], []
            for text, own in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                whole = text.as_py().split(b"\n")
                for s in own.as_py():
                    line.append(s["line"])
                    tokens.append(masked(whole[s["no"]]).decode().split(" "))
            yield pa.RecordBatch.from_arrays(
                [pa.array(line, pa.int64()), pa.array(tokens, pa.list_(pa.string()))], names=["line", "tokens"]
            )

    return spans.select("text", "spans").mapInArrow(tidy("lines", run), "line long, tokens array<string>")


def _several(some: DataFrame) -> DataFrame:
    """(set, held, line): the lines of each set of lines that documents have together in one leaf,
    and how many documents hold that set.  The lines of one document meet in a task."""
    sets = (
        some.groupBy("leaf", "tk").agg(F.sort_array(F.collect_set("line")).alias("lines")).where(F.size("lines") > 1)
        .groupBy("leaf", "lines").agg(F.count("*").alias("held")).withColumn("set", F.monotonically_increasing_id())
    )
    return sets.select("set", "held", F.explode("lines").alias("line"))


def _documents(rows: DataFrame, several: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, first): the documents with a line of the key, from its lines' own numbers (``docs``)
    less what documents with several of them count too often."""
    again = (
        several.join(rows.select(*keys, "line"), "line").groupBy(*keys, "set")
        .agg(((F.count("*") - 1) * F.first("held")).alias("again")).where("again > 0")
        .groupBy(*keys).agg(F.sum("again").alias("again"))
    )
    total = rows.groupBy(*keys).agg(F.sum("docs").alias("n"), F.min("first").alias("first"))
    return total.join(again, keys, "left").select(*keys, (F.col("n") - F.coalesce("again", F.lit(0))).alias("n"), "first")


def recurring(docs: DataFrame, found: DataFrame, store: Store, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line, template, first): lines of recurring templates, and the first document of each."""
    by_leaf = found.select("leaf", "tk").distinct().groupBy("leaf").count()
    leaves = store.save(by_leaf.where(F.col("count") >= min_docs))
    some = store.save(found.join(leaves.select("leaf"), "leaf"))
    spread = some.select("line", "tk").distinct().groupBy("line").agg(F.count("*").alias("docs"))
    several = store.save(_several(some))
    each = store.save(
        some.groupBy("leaf", "line").agg(
            F.min(F.struct(*DOC, "no")).alias("s"), F.min("doc_id").alias("first"))
        .join(spread, "line").select("leaf", "line", "docs", "first", "s.*")
    )
    chosen = split_by_keys(keyed(docs), each, DOC)[0].hint("merge")  # one plan at every size
    texts = _tokens(with_texts(chosen, each, F.struct("line", "no")))
    parsed = store.save(
        each.select("leaf", "line", "docs", "first").join(texts, "line")
        .select("leaf", "line", "docs", "first", F.posexplode("tokens").alias("at", "token"))
    )
    often = store.save(_documents(parsed, several, ["leaf", "at", "token"]).where(F.col("n") >= min_docs))
    fixed = store.save(
        often.join(leaves, "leaf").where(F.col("n") >= COMMON * F.col("count"))
        .select("leaf", "at", "token", F.lit(True).alias("fixed"))
    )
    pattern = F.transform(F.sort_array(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"])
    known = (
        parsed.join(fixed, ["leaf", "at", "token"], "left")
        .withColumn("shown", F.when(F.col("fixed"), F.col("token")).otherwise(ANY.decode()))
        .groupBy("leaf", "line").agg(
            F.first("docs").alias("docs"), F.first("first").alias("first"),
            F.avg(F.coalesce("fixed", F.lit(False)).cast("int")).alias("share"), pattern.alias("pattern"))
    )
    general = F.xxhash64(F.lit("t"), "leaf", "pattern")
    typed = store.save(known.select(
        "line", "docs", "first", F.when(F.col("share") >= MIN_FIXED, general).otherwise(F.col("line")).alias("template")
    ))
    often = _documents(typed, several, ["template"])
    often = store.save(often.where(F.col("n") >= min_docs).select("template", "first"))
    return store.save(typed.select("line", "template").join(often, "template"))


def long_lines(found: DataFrame, min_long: int) -> DataFrame:
    """(line, first): long lines that recur by themselves, and the first document of each."""
    counted = found.where("long").groupBy("line").agg(F.countDistinct("tk").alias("docs"), F.min("doc_id").alias("first"))
    return counted.where(F.col("docs") >= min_long).select("line", "first")


def dropped(docs: DataFrame, store: Store, min_docs: int = MIN_DOCS, min_long: int | None = None) -> DataFrame:
    """(doc_id, tk, no) of the lines to drop."""
    found = store.save(lines(docs))
    again = recurring(docs, found, store, min_docs).select("line", "first")
    if min_long is not None:
        again = store.save(again.unionByName(long_lines(found, min_long).join(again, "line", "left_anti")))
    other = ~F.coalesce(F.col("doc_id") == F.col("first"), F.col("first").isNull())
    return store.save(found.join(again, "line").where(other).select(*DOC, "no"))


def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for text, numbers in zip(texts, gone, strict=True):
        if numbers is not None and text is not None:
            away = set(map(int, numbers))
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in away)
        out.append(text)
    return pd.Series(out)


def drop_recurring(
    docs: DataFrame, store: Store, min_docs: int = MIN_DOCS, min_long: int | None = None
) -> DataFrame:
    """The documents with recurring lines dropped; every row and column stays, and ``n_chars``,
    where there is one, counts anew."""
    gone = store.save(dropped(docs, store, min_docs, min_long).groupBy(*DOC).agg(F.collect_list("no").alias("gone")))
    rows = docs.select("doc_id", text_hash(), F.struct("*").alias("row"))
    without = F.pandas_udf(_without, StringType())
    maybe, others = split_by_keys(rows, gone, DOC)
    joined = maybe.hint("merge").alias("a").join(gone.alias("b"), F.expr(SAME_DOC), "left").select("row", "gone")
    changed = joined.select("row", without("row.text", "gone").alias("text"))
    out = changed.unionByName(others.select("row", F.col("row.text").alias("text")))
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(
        (fresh[c] if c in fresh else F.col("row").getField(c)).alias(c) for c in docs.columns
    ))


def summary(
    docs: DataFrame, store: Store, min_docs: int = MIN_DOCS, min_long: int | None = None
) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept): what is left of every text."""
    count = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(
        F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    kept = drop_recurring(docs.select("doc_id", "text", count.alias("n_lines")), store, min_docs, min_long)
    return kept.select(
        "doc_id", "n_lines", (F.col("n_lines") - count).alias("n_removed"),
        F.coalesce("text", F.lit("")).alias("kept"),
    )
