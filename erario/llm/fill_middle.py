"""Fill-in-the-middle: cut a text into prefix, middle and suffix at unit borders, and reorder them.

Every character has one of eight classes, and a unit ends after a character of certain classes (a line
after a newline) or with the text.  The classes of a batch of texts lie in one wavelet matrix: a rank
query a class gives how many of its characters stand before a place, their sum how many units end
there, and bisection on that sum finds the place of a cut.  All documents of a batch are asked at once.

Results by case: a null or empty text has no units and the form plain, and so has a text that holds a
marker, whose output is the text itself.  A row without an id draws from the seed alone.  Repeated
rows are cut alike, each giving its row; rows that share an id but not a text share the draw, not the
cut.  Texts of any length are cut whole; one longer than ``TOGETHER`` characters is a batch of its own.
Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEWLINE, SPACE, LETTER, DIGIT, STOP, PAUSE, MARK, OTHER = range(8)
LEVELS = 3
#: Classes after whose characters a unit ends.
UNITS = {"line": (NEWLINE,), "word": (NEWLINE, SPACE), "sentence": (NEWLINE, STOP), "character": tuple(range(8))}
#: Characters whose classes share a wavelet matrix (about 2 bytes each).
TOGETHER = 4 << 20


def _class_table() -> np.ndarray:
    """Classes of the first 128 code points."""
    table = np.full(128, OTHER, np.uint8)
    for chars, kind in ((" \t\r\x0b\x0c", SPACE), ("\n", NEWLINE), (".!?", STOP), (",;:", PAUSE)):
        table[[ord(c) for c in chars]] = kind
    for code in range(33, 127):
        if table[code] == OTHER:
            c = chr(code)
            table[code] = LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK
    return table


_CLASSES = _class_table()


def classes(text: str) -> np.ndarray:
    """A class for each code point; letters beyond ASCII are not told from other signs there."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _CLASSES[np.minimum(codes, 127)], LETTER).astype(np.uint8)


class WaveletMatrix:
    """Ranks over a sequence of small symbols: one row of bits a level, highest bit first, each level
    keeping the order of the one above with all zero bits before all ones."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.levels, self.length, self.rows = levels, len(symbols), []
        for level in range(levels):
            bits = (symbols >> (levels - 1 - level)) & 1
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(packed) // 8 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(words), np.int64)  # before each word
            np.cumsum(np.bitwise_count(words[:-1]), out=ones[1:])
            self.rows.append((words, ones, self.length - int(bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: int, ends: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each of the places."""
        low, high = np.zeros_like(ends), ends
        for level, (words, ones, zeros) in enumerate(self.rows):
            low1, high1 = (self._ones(words, ones, at) for at in (low, high))
            if symbol >> (self.levels - 1 - level) & 1:
                low, high = zeros + low1, zeros + high1
            else:
                low, high = low - low1, high - high1
        return high - low

    @staticmethod
    def _ones(words: np.ndarray, ones: np.ndarray, ends: np.ndarray) -> np.ndarray:
        word, bit = ends >> 6, (ends & 63).astype(np.uint64)
        below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return ones[word] + np.bitwise_count(below)


def _ended(matrix: WaveletMatrix, kinds: tuple[int, ...], ends: np.ndarray) -> np.ndarray:
    """Units that end before each of the places, over the whole matrix."""
    return sum(matrix.rank(kind, ends) for kind in kinds)


def _places(matrix: WaveletMatrix, kinds: tuple[int, ...], wanted: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The least places in [low, high] before which so many units have ended; ``high`` if none has."""
    while (open_ := low < high).any():
        middle = (low + high) // 2
        reached = _ended(matrix, kinds, middle) >= wanted
        high = np.where(open_ & reached, middle, high)
        low = np.where(open_ & ~reached, middle + 1, low)
    return high


def cut_together(texts: list[str], h1: np.ndarray, h2: np.ndarray, kinds: tuple[int, ...]) -> np.ndarray:
    """Rows (units, prefix length, middle length) of texts, by one wavelet matrix over all of them."""
    matrix = WaveletMatrix(np.concatenate([classes(t) for t in texts]))
    end = np.cumsum([len(t) for t in texts])
    start = np.concatenate([[0], end[:-1]])
    before, upto = _ended(matrix, kinds, start), _ended(matrix, kinds, end)
    # The last unit of a text may lack its closing character.
    open_end = (end > start) & (_ended(matrix, kinds, np.maximum(end - 1, start)) == upto)
    units = upto - before + open_end
    draws = np.sort([h1 % (units + 1), h2 % (units + 1)], axis=0)
    # No unit means no step; all units mean the end even without a closing character.
    cuts = [np.where(d == 0, start, _places(matrix, kinds, before + d, start, end)) for d in draws]
    return np.stack([units, cuts[0] - start, cuts[1] - cuts[0]], axis=1)


def _batches(texts: list[str]) -> Iterator[slice]:
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > TOGETHER:
            yield slice(first, i)
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield slice(first, len(texts))


def _cutter(unit: str):
    kinds = UNITS[unit]

    @F.pandas_udf("n bigint, prefix_chars bigint, middle_chars bigint")
    def cut(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        texts, a, b = text.tolist(), h1.to_numpy(np.int64), h2.to_numpy(np.int64)
        rows = [cut_together(texts[s], a[s], b[s], kinds) for s in _batches(texts)]
        found = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        return pd.DataFrame(found, columns=["n", "prefix_chars", "middle_chars"])

    return cut


def _draw(seed: int, group: int) -> Column:
    """An 8-digit group of the hash of seed and id, as a number."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(name, 256), 8 * group - 7, 8), 16, 10).cast("bigint")


def transform(
    docs: DataFrame, *, unit: str = "line", seed: int = 7, percent: int = 100, suffix_first: int = 50
) -> DataFrame:
    """Rows (doc_id, text, n, form, prefix_chars, middle_chars, output).  ``percent`` of the documents are
    rearranged, ``suffix_first`` percent of these with the suffix before the prefix (spm, else psm)."""
    drawn = docs.select(
        "doc_id", text_or_empty(), *[_draw(seed, g).alias(f"h{g}") for g in (1, 2, 3, 4)])
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(marker))
    form = (
        F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= percent), "plain")
        .when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    )
    cut = (
        drawn.withColumn("form", form).withColumn("cut", _cutter(unit)("text", "h1", "h2"))
        .select("doc_id", "text", "form", "cut.*")
    )
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.substring("text", F.lit(1), p), F.substring("text", p + 1, m)
    suffix = F.substring("text", p + m + 1, F.lit(2**31 - 1))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    arranged = F.col("form") != "plain"
    return cut.select(
        "doc_id", "text", "n", "form", F.when(arranged, F.col("prefix_chars")).alias("prefix_chars"),
        F.when(arranged, F.col("middle_chars")).alias("middle_chars"), output.alias("output"))


def restored() -> Column:
    """The text from ``output`` and ``form`` alone.  A rearranged output holds each marker once, as its
    text holds none and a marker cannot overlap another."""
    part = F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(F.col("form") == "psm", F.concat(part[1], part[3], part[2]))
        .when(F.col("form") == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(F.col("output"))
    )
