"""Byte-level byte-pair encoding by dynamic programming over prefixes.

Every prefix of a piece has one valid encoding, and that has one last token.  A token that ends
the prefix is this last token if it can follow the last token of the shorter prefix it leaves.
So a table of one token a prefix holds the encodings of all prefixes; it grows by appending bytes,
and an edit invalidates only what lies behind it.

Empty or null texts have no ids.  Ids outside the vocabulary raise when decoded.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import held, text_or_empty, tidy

#: Bytes of texts cut and looked up at once, and ids spelt at once; each with the rest of a longer row.
BYTES_AT_ONCE, IDS_AT_ONCE = 1 << 22, 1 << 19
#: Stretches, and pieces, that stay remembered when twice as many are (some 40 bytes each).
CACHED_PIECES = 300_000
#: Bytes of a stretch or piece up to which it is remembered.
LONGEST = 64
NEVER = 1 << 60
#: White space behind a blank (or the end there) can share a piece with that blank.
BLANKS = r" (?:[\t-\r\x1c-\x1f\x{85}\pZ]|\z)"


class Codec:
    """The ranks of a tiktoken file, with the pattern that splits a text into pieces."""

    def __init__(self, path: str, pattern: str, cached: int = CACHED_PIECES):
        lines = [line.split() for line in open(path, "rb") if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in lines}
        self.token: list[bytes | None] = [None] * (1 + max(self.rank.values()))
        for t, r in self.rank.items():
            self.token[r] = t
        #: The same as one array, and the ids as decimal numbers, each with a blank behind it.
        self.tokens = pa.array(self.token, pa.large_binary())
        self.numbers = pa.array([b"%d " % r for r in range(len(self.token))], pa.large_binary())
        #: By the last bytes of a prefix (at most four), the lengths of the tokens that may end it.
        self.lengths: dict[bytes, tuple[int, ...]] = {}
        for t in self.rank:
            if len(t) > 4:
                self.lengths[t[-4:]] = (*self.lengths.get(t[-4:], ()), len(t))
        for end, long in self.lengths.items():
            self.lengths[end] = tuple(sorted(set(long), reverse=True)) + self._short(end)
        self.pieces = regex.compile(pattern).findall
        #: The two tokens that each longer token is merged from; None if merging never makes it.
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        for t, r in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(t) > 1:
                self.halves[r] = self._halves(t, r)
        self.plain, self.spaced = Known(cached), Known(cached)

    def _short(self, end: bytes) -> tuple[int, ...]:
        return tuple(n for n in range(len(end), 0, -1) if end[-n:] in self.rank)

    def _halves(self, token: bytes, below: int) -> tuple[int, int] | None:
        last = self._last_tokens(token, below)
        left = len(token) - len(self.token[last[-1]])
        pair = (last[left - 1], last[-1]) if left else None
        whole = pair and left == len(self.token[pair[0]])
        return pair if whole else None

    def _follows(self, left: int, right: int, below: int = NEVER) -> bool:
        """Whether merging (by the ranks below a bound) leaves the two tokens side by side.

        Undoes their merges from the last one back.  ``until`` is when the neighbour at the seam
        goes into a larger token; a merge across the seam before that would have come first.
        Merges of equal rank run from left to right.
        """
        left_until = right_until = below
        token, rank, halves = self.token, self.rank, self.halves
        while True:
            across = rank.get(token[left] + token[right], NEVER)
            if across < left_until and across <= right_until:
                return False
            from_left, from_right = halves.get(left), halves.get(right)
            if from_left and (not from_right or left > right):
                left_until, left = left, from_left[1]
            elif from_right:
                right_until, right = right, from_right[0]
            else:
                return True

    def _last_tokens(self, piece: bytes, below: int = NEVER, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix; ``known`` has those of the first prefixes."""
        last = list(known or ())
        rank, fits, lengths = self.rank, self.fits, self.lengths
        for end in range(len(last) + 1, len(piece) + 1):
            tail = piece[end - 4 if end > 4 else 0 : end]
            known_lengths = lengths.get(tail)
            if known_lengths is None:
                known_lengths = lengths[tail] = self._short(tail)
            for n in known_lengths:
                start = end - n
                if start < 0:
                    continue
                t = rank.get(piece[start:end])
                if t is None or t >= below:
                    continue
                if not start:
                    if end > 1 and not self.halves.get(t):
                        continue
                    break
                key = last[start - 1] << 32 | t
                ok = fits.get(key) if below == NEVER else self._follows(last[start - 1], t, below)
                if ok is None:
                    ok = fits[key] = self._follows(last[start - 1], t)
                if ok:
                    break
            last.append(t)
        return last

    def _walk(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.token[last[end - 1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        return [whole] if whole is not None else self._walk(self._last_tokens(piece))

    def _learn_pieces(self, pieces: list[str]) -> list[bytes]:
        """In byte order, so that each starts from the table of the prefix it shares with the last."""
        before, last, learnt = b"", [], {}
        coded = [p.encode() for p in pieces]
        for piece in sorted(coded):
            whole = self.rank.get(piece)
            if whole is None:
                same, most = 0, min(len(piece), len(before))
                while same < most and piece[same] == before[same]:
                    same += 1
                before, last = piece, self._last_tokens(piece, known=last[:same])
            ids = self._walk(last) if whole is None else [whole]
            learnt[piece] = array("I", ids).tobytes()
        return list(map(learnt.__getitem__, coded))

    def _of_pieces(self, rows: list[list[str]]) -> pa.ListArray:
        """The ids of each row of pieces."""
        pieces = pa.array(chain.from_iterable(rows), pa.string()).dictionary_encode()
        ids = self.plain.look_up(pieces.dictionary, self._learn_pieces).take(pieces.indices)
        return _merged(ids, _ends(list(map(len, rows))))

    def _learn_words(self, words: list[str]) -> list[bytes]:
        """Stretches that a blank begins: a word, or a word and what follows up to the next blank."""
        ids = self._of_pieces([[" " + w] if w.isalpha() else self.pieces(" " + w) for w in words])
        return _bytes(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return _bytes(self.encode_column(pa.array(texts, pa.string())))

    def encode_column(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text.  A blank before a non-blank always begins a piece, so texts are cut
        there and each different stretch is looked up once.  Texts with runs of blanks stay whole."""
        if len(self.fits) > CACHED_PIECES:
            self.fits.clear()
        texts = texts.cast(pa.string())
        runs = pc.match_substring_regex(texts, BLANKS)
        cut = pc.split_pattern(pc.if_else(runs, "", texts), " ")
        ends = _ends(pc.list_value_length(cut))
        first, stretches = ends[:-1], cut.flatten()
        heads = pc.if_else(runs, texts, stretches.take(pa.array(first))).to_pylist()
        coded = stretches.dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        place[first] = -1
        used = np.bincount(place + 1, minlength=len(coded.dictionary) + 1)[1:] > 0
        words = coded.dictionary.filter(pa.array(used))
        place = (np.cumsum(used) - 1)[place]
        place[first] = len(words) + np.arange(len(texts))
        known = [self.spaced.look_up(words, self._learn_words), self._of_pieces(list(map(self.pieces, heads)))]
        return _merged(pa.concat_arrays(known).take(pa.array(place)), ends)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _ends(sizes) -> np.ndarray:
    """Where things of these sizes end, one behind the other; a null has none."""
    if isinstance(sizes, pa.Array):
        sizes = sizes.fill_null(0)
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _merged(ids: pa.ListArray, ends: np.ndarray) -> pa.ListArray:
    """The lists between these ends as one list each."""
    return _lists(_ends(pc.list_value_length(ids))[ends], ids.flatten())


def _bytes(ids: pa.ListArray) -> list[bytes]:
    data, ends = ids.flatten().to_numpy().tobytes(), 4 * _ends(pc.list_value_length(ids))
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _joined(ids: pa.ListArray, words: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.Buffer]:
    """The words of all ids in one buffer, and where those of each list end in it."""
    found = words.take(ids.flatten())
    if found.null_count:
        raise ValueError("ids outside the vocabulary")
    ends = _ends(pc.binary_length(found))[_ends(pc.list_value_length(ids))]
    return ends, found.buffers()[2] or pa.py_buffer(b"")


class Known:
    """Words and their ids as Arrow arrays.  Beyond twice the limit, those last used longest ago go."""

    def __init__(self, limit: int):
        self.limit, self.turn, self.used = limit, 0, np.zeros(0, np.int64)
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def look_up(self, words: pa.StringArray, learn: Callable[[list[str]], list[bytes]]) -> pa.ListArray:
        """The ids of different words; ``learn`` gives those of unknown ones."""
        place = pc.index_in(words, value_set=self.words)
        new = words.filter(place.is_null())
        place = place.fill_null(-1).to_numpy().copy()
        place[place < 0] = len(self.words) + np.arange(len(new))
        learnt = learn(new.to_pylist()) if len(new) else []
        ids = _lists(_ends([len(x) // 4 for x in learnt]), pa.array(np.frombuffer(b"".join(learnt), "<i4")))
        found = pa.concat_arrays([self.ids, ids]).take(pa.array(place))
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        self.turn += 1
        self.used[place[place < len(self.words)]] = self.turn
        self.used = np.concatenate([self.used, np.full(pc.sum(short).as_py() or 0, self.turn)])
        self.words = pa.concat_arrays([self.words, new.filter(short)])
        self.ids = pa.concat_arrays([self.ids, ids.filter(short)])
        if len(self.words) > 2 * self.limit:
            kept = np.sort(np.argsort(self.used, kind="stable")[-self.limit :])
            self.words, self.ids = self.words.take(pa.array(kept)), self.ids.take(pa.array(kept))
            self.used = self.used[kept]
        return found


class Editable:
    """A text with its pieces and their prefix tables, for appends and edits."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, ""
        self.parts: list[tuple[str, list[int]]] = []
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` for text[start:end].  Pieces that end well before the edit stay; the piece
        that holds it keeps the prefixes before it; behind it, pieces are cut anew until they meet
        an old boundary again."""
        text = self.text[:start] + new + self.text[end:]
        kept, at = 0, 0
        while kept < len(self.parts) and at + len(self.parts[kept][0]) < start:
            at += len(self.parts[kept][0])
            kept += 1
        for _ in range(2):  # a cut depends on one character behind it, a blank run on its end
            if kept:
                kept -= 1
                at -= len(self.parts[kept][0])
        old, place = {}, at
        for i in range(kept, len(self.parts)):
            old.setdefault(place, i)
            place += len(self.parts[i][0])
        shift, fresh = len(text) - len(self.text), []
        for match in regex.finditer(self.codec.pieces.__self__, text, pos=at):
            behind = old.get(match.start() - shift)
            if match.start() >= start + len(new) and behind is not None and behind >= kept:
                self.parts, self.text = self.parts[:kept] + fresh + self.parts[behind:], text
                return
            piece, before = match.group(), self.parts[old[match.start()]] if match.start() in old else ("", [])
            same = 0
            while same < min(len(piece), len(before[0])) and piece[same] == before[0][same]:
                same += 1
            known = before[1][: len(piece[:same].encode())]
            fresh.append((piece, self.codec._last_tokens(piece.encode(), known=known)))
        self.parts, self.text = self.parts[:kept] + fresh, text

    def ids(self) -> list[int]:
        out = []
        for piece, last in self.parts:
            whole = self.codec.rank.get(piece.encode())
            out += [whole] if whole is not None else self.codec._walk(last)
        return out


def codec(path: str, pattern: str, cached: int = CACHED_PIECES) -> Codec:
    own = held("bpe")
    if (path, pattern, cached) not in own:
        own[path, pattern, cached] = Codec(path, pattern, cached)
    return own[path, pattern, cached]


def _slices(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    block = _ends(sizes)[1:] // most
    borders = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        yield batch.slice(a, b - a)


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have BYTES_AT_ONCE, from one batch or several."""
    some, size = [], 0
    for batch in batches:
        for part in _slices(batch, pc.binary_length(batch.column(1)), BYTES_AT_ONCE):
            more = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if some and size + more > BYTES_AT_ONCE:
                yield pa.concat_batches(some)
                some, size = [], 0
            some.append(part)
            size += more
    if some:
        yield pa.concat_batches(some)


def encoding(path: str, pattern: str, cached: int = CACHED_PIECES):
    """Batches of (doc_id, text) to batches of (doc_id, ids)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, cached)
        for some in _gathered(batches):
            ids = own.encode_column(some.column(1))
            yield pa.RecordBatch.from_arrays([some.column(0), ids], names=["doc_id", "ids"])

    return run


def decoding(path: str, pattern: str, cached: int = CACHED_PIECES):
    """Batches of (doc_id, ids) to batches of (doc_id, ids, decoded)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, cached)
        for batch in batches:
            for some in _slices(batch, pc.list_value_length(batch.column(1)), IDS_AT_ONCE):
                ends, data = _joined(some.column(1), own.tokens)
                ends = pa.py_buffer(ends.astype(np.int32))
                texts = pa.Array.from_buffers(pa.binary(), some.num_rows, [None, ends, data])
                yield pa.RecordBatch.from_arrays([*some.columns, texts], names=["doc_id", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    return docs.select("doc_id", text_or_empty()).mapInArrow(
        tidy("bpe", encoding(path, pattern)), "doc_id long, ids array<int>"
    )


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes behind the ids."""
    return encoded.select("doc_id", "ids").mapInArrow(
        tidy("bpe", decoding(path, pattern)), "doc_id long, ids array<int>, decoded binary"
    )


def round_trip(docs: DataFrame, path: str, pattern: str, cached: int = CACHED_PIECES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): documents encoded and decoded again, in one
    pass of one Python worker a task.  ``cached`` trades memory for time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, cached)
        for some in decoding(path, pattern, cached)(encoding(path, pattern, cached)(batches)):
            ends, data = _joined(some.column(1), own.numbers)
            spelt = [data[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pc.list_value_length(some.column(1)).cast(pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in spelt]),
                 pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in some.column(2)])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", text_or_empty()).mapInArrow(
        tidy("bpe", run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
