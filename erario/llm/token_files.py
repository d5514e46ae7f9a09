"""Token ids in Parquet list columns, laid out for selective reads.

One row a document, in ascending doc_id order over the files: doc_id, part (the writing task),
local_start (ids of the part before the row), n_tokens, tokens.  Ids are dictionary or delta coded;
row groups and pages are small and carry a page index, so a reader of the metadata columns, or of a
range of documents, touches only their pages.

Empty or null texts have just the end id.  Texts of any length are encoded
whole, and rows with an equal doc_id are kept, ordered by a hash of their text; a null doc_id comes first.  Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, text_or_empty, tidy

ROWS_AT_ONCE = 1000
CACHED_WORDS = 600_000
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
#: Signs behind a letter and before white space: the tokenizer takes them as a piece of their own.  An
#: apostrophe, which may begin a contraction, and signs beyond ASCII are left with their word.
TRAILING = r"(\p{L})([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+)(\s|$)"
#: Words that are one piece to the tokenizer whatever stands beside them.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Words given to the library as one text.
JOINED = 256


class WordEncoder:
    """Encodes whole texts with a tokenizers file that lower-cases, drops white space and takes letters,
    digits and signs as pieces, the last token of each marked as such.

    No token of such a file spans pieces, so a text's ids are those of its blank-separated words in
    turn.  Arrow splits a batch, trailing signs apart, and numbers its distinct words; each is looked up
    once a batch, and given to the library once while it stays in memory, plain words many at a time:
    their ids are told apart by the mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        mark = self.library.model.end_of_word_suffix
        size = self.library.get_vocab_size()
        self.last = np.array([bool(mark) and self.library.id_to_token(i).endswith(mark) for i in range(size)])
        #: Two generations of known words; the older goes when the younger is full.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        plain, rest = [], []
        for word in words:
            (plain if PLAIN(word) else rest).append(word)
        groups = [plain[i: i + JOINED] for i in range(0, len(plain), JOINED)]
        texts = self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, texts, strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group):  # a file without the mark
                rest += group
                continue
            whole, ends = ids.tobytes(), (4 * ends).tolist()
            for word, start, end in zip(group, [0, *ends], ends):
                self.young[word] = whole[start:end]
        for word, found in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.young[word] = array("I", found.ids).tobytes()

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}
        unknown = [w for w in words if w not in self.young]
        known = {w: self.old[w] for w in unknown if w in self.old}
        self.young |= known
        self._learn([w for w in unknown if w not in known])
        return [self.young[w] for w in words]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's ids end (after a leading 0)."""
        pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), TRAILING, r"\1 \2\3"))
        numbered = pieces.flatten().dictionary_encode()
        ids = self._ids(numbered.dictionary.to_pylist())
        values = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, which = np.cumsum(size) - size, numbered.indices.to_numpy()
        count = size[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        found = values[np.repeat(start[which] - ends[:-1], count) + np.arange(ends[-1])]
        offsets = pieces.offsets.to_numpy()
        return found, ends[offsets - offsets[0]]


def encoder(path: str) -> WordEncoder:
    own = held("tokens")
    if path not in own:
        own[path] = WordEncoder(path)
    return own[path]


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000,
) -> None:
    """Encode every whole text, append the end id and write the files (``tokenizer``: path of a
    tokenizers file).  The range shuffle moves texts, before they are encoded."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                ids, ends = encoder(tokenizer).encode(some.column(1))
                ids = np.insert(ids, ends[1:], end_id)  # before these places of the ids without end ids
                ends = ends + np.arange(len(ends))
                counts = np.diff(ends)
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(counts), part, np.int32)),
                     pa.array(before + ends[:-1]), pa.array(counts), tokens],
                    names=["doc_id", "part", "local_start", "n_tokens", "tokens"],
                )
                before += int(ends[-1])

    ordered = (
        docs.select("doc_id", text_or_empty())
        # The hash deals out rows that share an id, or have none.
        .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )
    (
        ordered.mapInArrow(tidy("tokens", encode), SCHEMA).write
        .option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")  # delta coding where no dictionary is used
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before each.  Only the named
    columns' pages are read; filters on doc_id skip row groups and pages by their index.

    The start of a part needs one row a writing task; those meet in one window.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    sums = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    out = rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start"))
    return out.select(*columns) if columns else out.drop("base")


def ids_digest(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows that hold tokens."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(3)
            ends = tokens.offsets.to_numpy()
            ids = memoryview(np.ascontiguousarray(tokens.values.to_numpy(), "<u4")).cast("B")
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(
        tidy("tokens", digest), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
