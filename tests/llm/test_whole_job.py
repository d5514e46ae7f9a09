"""Cases in which an operator once did less than the whole job."""

import duckdb
import numpy as np
from brute import kept_lines, prose, repeated_cover, words_of
from pyspark.sql import functions as F

from erario.llm import bitsliced, line_templates, metric_join, mixing, simhash, suffix_dedup, toxicity, window_dedup
from erario.llm.workload import llm_oracle


def removed(found):
    return sorted((r.doc_id, r.n_removed) for r in found.collect())


def test_fields_with_common_values_are_variable(spark, store):
    """Topics and names that are in many documents each, every pair in one."""
    for n in (10, 5):
        lines = [f"Filed today under topic Topic{chr(65 + i)} by Name{chr(65 + j)}" for i in range(n) for j in range(n)]
        table = spark.createDataFrame([(i, f"{x}\n{prose(50 + i, 12)}") for i, x in enumerate(lines)], "doc_id long, text string")
        assert removed(line_templates.summary(table, store)) == [(i, int(i > 0)) for i in range(n * n)]
        con = duckdb.connect()
        documents = table.toPandas()  # noqa: F841
        con.register("documents", documents)
        rows = con.execute(f"SELECT doc_id, n_removed FROM ({llm_oracle()['op3_line_templates']})").fetchall()
        assert sorted(rows) == [(i, int(i > 0)) for i in range(n * n)]


def test_long_lines_recur_from_two_documents(spark):
    import corpus_pipeline

    long, short, numbers = prose(90, 60), prose(91, 20), "7 " * 60
    table = spark.createDataFrame(
        [(i, f"{prose(92 + i, 12)}\n{long}\n{short}\n{numbers}") for i in range(3)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_recurring_lines(spark, table, "").collect()}
    assert [long in left[i] for i in range(3)] == [True, False, False]
    assert all(short in left[i] and numbers in left[i] for i in range(3))


def test_several_lines_of_a_document_count_once(spark, store):
    """Three lines of one template a document; other documents have one line of the leaf."""

    def table(n):
        own = ["\n".join(f"Filed today under topic T{a}{chr(97 + i)} by N{a}{chr(97 + i)}" for a in "xyz") for i in range(n)]
        rest = [f"Filed today under {prose(200 + i, 4)}" for i in range(5 - n)]
        return spark.createDataFrame(list(enumerate(own + rest)), "doc_id long, text string")

    assert removed(line_templates.summary(table(2), store)) == [(i, 0) for i in range(5)]
    assert removed(line_templates.summary(table(5), store)) == [(i, 3 * (i > 0)) for i in range(5)]


def test_texts_with_an_equal_32_bit_hash_are_two(spark, store):
    """Rows without an id whose texts share that hash: a shared passage goes from the one that has it."""
    passage, other = prose(60, 80), prose(61, 20)
    ids = spark.range(0, 200000, 1, 8)
    own = ids.select(F.concat(F.lit(passage + "\n"), "id").alias("text"))
    rest = ids.select(F.concat(F.lit(other + "\n"), "id").alias("text"))
    pair = own.alias("a").join(rest.alias("b"), F.hash("a.text") == F.hash("b.text")).select("a.text", "b.text").first()
    data = [(None, pair[0], "a"), (None, pair[1], "b"), (1, passage, "b")]
    table = spark.createDataFrame(data, "doc_id long, text string, source string")
    texts = [t for _, t, _ in data]
    words = repeated_cover([words_of(t) for t in texts], 35)
    got = window_dedup.remove_repeats(table, store).collect()
    assert sorted(r.n_removed for r in got) == sorted(map(sum, words))
    got = suffix_dedup.remove_repeats(table, store).collect()
    assert sorted(r.n_removed for r in got) == sorted(map(sum, repeated_cover([t.encode() for t in texts], 200)))
    got = line_templates.drop_recurring(table, store, min_long=2).collect()
    assert {r.text for r in got} == {pair[0].split("\n")[1], pair[1], passage}
    assert mixing.mix(table, store, lambda i: 1).select("tk").distinct().count() == 3


def test_long_lines_of_the_query_and_the_stage(spark, store):
    """The same rule in both, and in the plain version."""
    rows = [(i, f"{prose(300 + i, 12)}\n{prose(90, 60)}\n{prose(91, 20)}") for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in line_templates.summary(table, store, min_long=line_templates.MIN_LONG).collect()}
    assert [got[i] for i in range(3)] == kept_lines(rows, line_templates.MIN_DOCS, line_templates.MIN_LONG)
    assert "\n" in got[0] and prose(90, 60) not in got[1]


def test_rows_without_an_id_link_texts(spark, store):
    """Two texts that only a text without an id is near to are one component."""
    base = prose(400, 400).split()
    fps, texts = [simhash.fingerprint(" ".join(base).encode())], [" ".join(base)]
    for at in range(0, 390, 2):  # a chain of texts, each a word away from the last
        base[at] = f"w{at}"
        texts.append(" ".join(base))
        fps.append(simhash.fingerprint(texts[-1].encode()))
    apart = lambda a, b: bin(a ^ b).count("1")
    i, j, k = next((i, j, k) for i in range(len(fps)) for j in range(i, len(fps)) for k in range(j, len(fps))
                   if apart(fps[i], fps[j]) <= 4 and apart(fps[j], fps[k]) <= 4 < apart(fps[i], fps[k]))
    table = spark.createDataFrame([(1, texts[i]), (None, texts[j]), (2, texts[k]), (None, "alone and far")], "doc_id long, text string")
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(table, store).collect()}
    assert sorted(found.values(), key=str) == [1, 1, 1, None]
    kept = [tuple(r) for r in simhash.keep_one(table, store).collect()]
    assert sorted(kept, key=str) == [(1, texts[i]), (None, "alone and far")]


def test_vectors_without_an_id_link_vectors(spark, store):
    turn = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(1, turn(0)), (None, turn(20)), (2, turn(40)), (None, turn(150)), (None, turn(150)), (3, turn(260)), (3, turn(80))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, metric_join.near_duplicates(table, store).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (None, 2, 1, False), (2, 1, 1, False), (None, 1, None, False), (None, 1, None, False),
                          (3, 0, 3, True), (3, 0, 3, True)], key=str)


def test_repeated_queries_and_missing_ids_lose_no_neighbours(spark, store):
    big = 1 << 60
    rows = [(20 + big - big % 20, [1.0, 0.0]), (20 + big - big % 20, [1.0, 0.0]), (40 + big - big % 20, [0.0, 1.0]), (None, [1.0, 0.0])]
    rows += [(big + i, [1.0 - i / 100, 0.5]) for i in range(1, 19) if (big + i) % 20]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = bitsliced.top_k(table, store, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), k=5).collect()
    for q in {r.query_id for r in got}:
        x = next(v for i, v in rows if i == q)
        dot = lambda v: sum(int(np.floor(64 * np.float32(a))) * int(np.floor(64 * np.float32(b))) for a, b in zip(x, v))  # noqa: B023, E731
        want = sorted(((-dot(v), i is None, i or 0) for i, v in rows if i != q))[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert own == [(n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(want)]
    assert len(got) == 10


def test_copies_of_equal_rows_add_up_to_the_mix(spark, store):
    rows = [(1, "a b c d e", "s")] * 50 + [(i, "x " * 100, "t") for i in range(2, 12)] + [(None, "p q", "s")] * 7
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mixed = mixing.mix(table, store, lambda i: 1 + i % 3).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    got = mixing.mixed_documents(table, store, lambda i: 1 + i % 3).groupBy("source").agg(F.sum(mixing.word_count()).alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixed))


def test_toxic_rows_go_by_their_own_text(spark, store):
    docs = [(i, f"{prose(500 + i, 15)} {'you stupid idiot' if i % 3 == 0 else ''}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    docs += [(None, f"{prose(1, 9)} you stupid idiot"), (7, f"{prose(2, 9)} you stupid idiot"), (None, prose(3, 9))]
    left = {tuple(r) for r in toxicity.drop_toxic(spark.createDataFrame(docs, "doc_id long, text string"), labels, store).collect()}
    assert docs[-1] in left and docs[7] in left and not any("idiot" in t for _, t in left)
