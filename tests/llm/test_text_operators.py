"""De-duplication, lines, tokens and mixing against plain versions, on tables with every odd case."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokens
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
import tiktoken
from brute import components_of, kept_lines, odd_documents, repeated_cover, simhash_of, words_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from erario.llm import line_templates, mixing, prefix_bpe, simhash, suffix_dedup, token_files, window_dedup
from erario.llm.common import components

DOCS = odd_documents()
RANKS, WORDS = tokens.path("byte_bpe_50k.tiktoken"), tokens.path("word_bpe_49k.json")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(df, columns, expected):
    assert rows(df, *columns) == sorted(expected, key=repr)


def test_components(spark, store):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(7, i) for i in range(500, 600)]
    links = spark.createDataFrame([*pairs, (3, 3), (None, 5)], "a long, b long")
    label = components_of(600, pairs)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    same(components(links, store), ["node", "component"], [(x, label[x]) for x in linked])
    assert components(links.limit(0), store).count() == 0


def test_simhash(docs, no_docs, store):
    prints = [simhash_of(d[1]) for d in DOCS]
    at = range(len(DOCS))
    pairs = [(i, j) for i in at for j in at if i < j and (prints[i] ^ prints[j]).bit_count() <= 4]
    label = components_of(len(DOCS), pairs)
    least = {}
    for i, d in enumerate(DOCS):
        if d[0] is not None:
            least[label[i]] = min(d[0], least.get(label[i], 1 << 60))
    found = simhash.near_duplicates(docs, store)
    same(found, ["doc_id", "fingerprint", "component_id"],
         [(d[0], f"{p:016x}", least.get(label[i])) for i, (d, p) in enumerate(zip(DOCS, prints, strict=True))])
    kept = simhash.keep_one(docs, store)
    assert kept.columns == docs.columns
    wanted = Counter(d[0] for i, d in enumerate(DOCS) if d[0] is None or least[label[i]] == d[0])
    gone = {d[0] for i, d in enumerate(DOCS) if d[0] is not None and least[label[i]] != d[0]}
    assert Counter(r.doc_id for r in kept.collect()) == Counter({k: v for k, v in wanted.items() if k not in gone})
    assert simhash.near_duplicates(no_docs, store).count() == 0


@pytest.mark.parametrize("together", [10**9, 20])
def test_simhash_links_lose_nothing(spark, store, monkeypatch, together):
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40)
    prints = [int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 63, rng.integers(0, 6)))) for b in base for _ in range(8)]
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    label = components_of(len(prints), pairs)
    found = components(simhash.near_links(nodes, store), store)
    linked = {x for p in pairs for x in p}
    same(found, ["node", "component"], [(x, label[x]) for x in linked])


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, no_docs, store, encoding):
    path = store.path("tokens")
    token_files.write_tokens(docs, path, WORDS, encoding=encoding)
    library, start, expected = Tokenizer.from_file(WORDS), 0, []
    for i, text in sorted(((d[0], d[1] or "") for d in DOCS), key=lambda d: (d[0] is not None, d)):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = token_files.ids_digest(token_files.read_tokens(spark, path))
    same(found, ["doc_id", "start", "n_tokens", "ids_crc32"], expected)
    few = token_files.read_tokens(spark, path, ("doc_id", "n_tokens")).where("doc_id > 15")
    assert "tokens:array" not in few._jdf.queryExecution().executedPlan().toString()
    token_files.write_tokens(no_docs, store.path("none"), WORDS, encoding=encoding)
    assert token_files.read_tokens(spark, store.path("none")).count() == 0
    with pytest.raises(ValueError):
        token_files.write_tokens(docs, store.path("bad"), WORDS, encoding="plain")


def test_token_file_layout(spark, docs, store):
    import pyarrow.parquet as pq

    path = store.path("layout")
    token_files.write_tokens(docs, path, WORDS)
    local = path.removeprefix("file:")
    file = pq.ParquetDataset(local).fragments[0].path
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_prefix_bpe(docs, no_docs):
    library = reference_encoding()
    expected = []
    for d in DOCS:
        text = d[1] or ""
        ids = library.encode_ordinary(text)
        expected.append((d[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(text.encode()).hexdigest()))
    found = prefix_bpe.round_trip(docs, RANKS, tokens.PATTERN)
    same(found, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], expected)
    encoded = prefix_bpe.encode_documents(docs, RANKS, tokens.PATTERN)
    decoded = prefix_bpe.decode_documents(encoded, RANKS, tokens.PATTERN)
    same(decoded.select("doc_id", F.col("decoded").cast("string").alias("text")), ["doc_id", "text"], [(d[0], d[1] or "") for d in DOCS])
    assert prefix_bpe.round_trip(no_docs, RANKS, tokens.PATTERN).count() == 0


def test_prefix_bpe_blanks_are_the_patterns():
    space = regex.compile(r"\s").match
    spaces = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and space(c)]
    assert "\x85" in spaces and pc.all(pc.match_substring_regex(pa.array([" " + c + "a" for c in spaces]), prefix_bpe.BLANKS)).as_py()
    found = pc.match_substring_regex(pa.array(["a ", " ", "a b", " a", "\na", ""]), prefix_bpe.BLANKS)
    assert found.to_pylist() == [True, True, False, False, False, False]


def test_prefix_bpe_learns_a_piece_once(monkeypatch):
    """One encoding of a piece serves all rows of all batches taken at once, alone and before other signs."""
    own, learnt = prefix_bpe.Codec(RANKS, tokens.PATTERN), []
    learn = own._learn_pieces
    monkeypatch.setattr(own, "_learn_pieces", lambda pieces: [learnt.extend(pieces), learn(pieces)][1])
    monkeypatch.setattr(prefix_bpe, "codec", lambda *_: own)
    texts = [f"Xyqzv xyqzv{'.,!?'[i % 4]} wvkqj, xyqzv wvkqj" for i in range(60)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in enumerate(texts)]
    found = list(prefix_bpe.encoding(RANKS, tokens.PATTERN)(iter(batches)))
    library = reference_encoding()
    assert [x for b in found for x in b.column(1).to_pylist()] == [library.encode_ordinary(t) for t in texts]
    assert sorted(learnt) == sorted(["Xyqzv", " xyqzv", " wvkqj", *".,!?"])


def test_prefix_bpe_forgets_and_cuts(monkeypatch):
    """Few remembered pieces, long ones that are not, and parts of a few bytes change no result."""
    library, rng = reference_encoding(), random.Random(8)
    own = prefix_bpe.Codec(RANKS, tokens.PATTERN, cached=5)
    monkeypatch.setattr(prefix_bpe, "codec", lambda *_: own)
    monkeypatch.setattr(prefix_bpe, "BYTES_AT_ONCE", 90)
    monkeypatch.setattr(prefix_bpe, "IDS_AT_ONCE", 20)
    words = ["".join(rng.choice("abcxyzé日") for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["日本語" * 40, "z" * 300, "a,b;" * 30, ""]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(300)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(a, a + 7)), "text": texts[a : a + 7]}) for a in range(0, 294, 7)]
    found = list(prefix_bpe.decoding(RANKS, tokens.PATTERN)(prefix_bpe.encoding(RANKS, tokens.PATTERN)(iter(batches))))
    assert [x for b in found for x in b.column(0).to_pylist()] == list(range(294))
    assert [x for b in found for x in b.column(1).to_pylist()] == [library.encode_ordinary(t) for t in texts[:294]]
    assert [x.decode() for b in found for x in b.column(2).to_pylist()] == texts[:294]
    for memory in (own.plain, own.spaced):
        assert len(memory.words) == len(memory.ids) == len(memory.used) <= 10
        assert max(map(len, map(str.encode, memory.words.to_pylist()))) <= prefix_bpe.LONGEST
    assert own.encode([]) == []
    outside = pa.RecordBatch.from_pydict({"doc_id": [1], "ids": pa.array([[len(own.token)]], pa.list_(pa.int32()))})
    with pytest.raises((IndexError, ValueError)):
        list(prefix_bpe.decoding(RANKS, tokens.PATTERN)(iter([outside])))


def test_prefix_bpe_random_texts_and_edits():
    library, own, rng = reference_encoding(), prefix_bpe.codec(RANKS, tokens.PATTERN), random.Random(6)
    letters = "ab' \n\t.é日́'st19\x1c\xa0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 900, " " * 70 + "x", "ÃÂ" * 150, "=-" * 300]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    for text in texts[:400]:
        edited = prefix_bpe.Editable(own, text)
        for _ in range(3):
            a = rng.randint(0, len(edited.text))
            b = len(edited.text) if rng.random() < 0.3 else min(len(edited.text), a + rng.randint(0, 3))
            edited.replace(a, b, "".join(rng.choice(letters) for _ in range(rng.randint(0, 4))))
            assert edited.ids() == library.encode_ordinary(edited.text)


def test_window_removal(docs, no_docs, store):
    words = [words_of(d[1]) for d in DOCS]
    expected = [
        (d[0], len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y))
        for d, w, g in zip(DOCS, words, repeated_cover(words, 35), strict=True)
    ]
    assert 0 < sum(e[2] for e in expected)
    same(window_dedup.remove_repeats(docs, store), ["doc_id", "n_words", "n_removed", "kept"], expected)
    assert window_dedup.remove_repeats(no_docs, store).count() == 0


@pytest.mark.parametrize("together", [8000, 2])
def test_suffix_removal(docs, no_docs, store, together, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_runs, "__defaults__", (together,))
    data = [(d[1] or "").encode() for d in DOCS]
    expected = []
    for d, x, gone in zip(DOCS, data, repeated_cover(data, 200), strict=True):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        expected.append((d[0], len(x), sum(gone), spans, bytearray(v for v, g in zip(x, gone, strict=True) if not g)))
    assert 0 < sum(e[2] for e in expected)
    same(suffix_dedup.remove_repeats(docs, store), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], expected)
    assert suffix_dedup.remove_repeats(no_docs, store).count() == 0


def test_shards():
    rng = random.Random(3)
    for _ in range(60):
        n, letters = rng.choice([3, 8, 9, 16, 20, 40]), rng.choice([b"ab", b"a", b"abcd"])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        parts, asked = [p + rng.choice(base) for p in base] + base[:2], [*base, b"abababababaab" * 3]
        count = Counter(p[i : i + n] for p in parts for i in range(len(p) - n + 1))
        shard, other = suffix_dedup.Shard(parts, n), suffix_dedup.Shard(asked, n)
        found, held = shard.repeated(), shard.holds(other)
        assert found.tolist() == [i <= len(p) - n and count[p[i : i + n]] > 1 for p in parts for i in range(len(p))]
        assert held.tolist() == [i <= len(p) - n and count[p[i : i + n]] > 0 for p in asked for i in range(len(p))]


@pytest.mark.parametrize("least", [2, 4])
def test_line_templates(docs, no_docs, store, least):
    expected = list(zip((d[0] for d in DOCS), kept_lines(DOCS, least), strict=True))
    assert sum(len(e[1]) for e in expected) < sum(len(d[1] or "") for d in DOCS)
    same(line_templates.summary(docs, store, least), ["doc_id", "kept"], expected)
    out = line_templates.drop_recurring(docs, store, least)
    assert out.columns == docs.columns and out.count() == len(DOCS)
    assert out.where("n_chars <> length(text)").count() == 0
    assert line_templates.drop_recurring(no_docs, store).count() == 0


def test_mixing(docs, no_docs, store, monkeypatch):
    monkeypatch.setattr(mixing, "ORDERED_TOGETHER", 1)
    found = mixing.mix(docs, store, lambda i: 1 + i % 3)
    got = found.collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for d in DOCS:
        sizes[d[3]] += len(words_of(d[1]))
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.taken == r.size * r.copies and r.copies <= 3
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d[0], len(words_of(d[1]))) for d in DOCS)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = mixing.share_targets([sizes[s] for s in order], [1, 2, 3, 1], 3.0)
    assert abs(sum(target) - sum(sizes.values())) < 1e-6
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in zip(order, target, strict=True)}
    for s, t in zip(order, target, strict=True):  # as near as the source's longest document allows
        assert -1 <= t - taken[s] <= max(len(words_of(d[1])) for d in DOCS if d[3] == s)
    assert rows(found, "doc_id", "tk", "copies") == rows(mixing.mix(docs, store, lambda i: 1 + i % 3), "doc_id", "tk", "copies")
    mixed = mixing.mixed_documents(docs, store, lambda i: 1 + i % 3)
    assert mixed.columns == docs.columns
    assert mixing.mix(no_docs, store, lambda i: 1).count() == 0


def test_targets_and_knapsack():
    assert mixing.share_targets([100, 1, 1], [1, 1, 1], 3) == [96, 3, 3]
    assert mixing.share_targets([0, 10], [5, 1], 3) == [0, 10]
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths, counts = np.unique(rng.integers(0, 30, 5)), rng.integers(0, 4, 5)
        counts = counts[: len(lengths)]
        budget = int(rng.integers(0, 90))
        reach = {0}
        for n, c in zip(lengths, counts, strict=True):
            reach = {r + int(n) * k for r in reach for k in range(c + 1)}
        taken = mixing.knapsack(lengths, counts, budget)
        assert (taken <= counts).all() and int(taken @ lengths) == max(r for r in reach if r <= budget)
