"""Joins, search, toxicity and the pipeline."""

import duckdb
import numpy as np
import pytest
from brute import DOC_SCHEMA, components_of, prose
from pyspark.sql import functions as F

from erario.llm import bitsliced, metric_join, toxicity
from erario.llm.workload import llm_oracle, llm_queries
from erario.store import Store

NAN, INF = float("nan"), float("inf")


def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    rows = [(base[i % 30] + 0.1 * rng.normal(size=8) * (i % 4)).tolist() for i in range(200)]
    rows += [rows[0], rows[0], [0.0] * 8, [NAN] + [1.0] * 7, [INF] + [1.0] * 7, [None] + [1.0] * 7, None, [], [1.0, 2.0], [2.0, 4.0]]
    return [(i, x, i % 3) for i, x in enumerate(rows)] + [(5, rows[5], 1)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").repartition(3)


def good(x):
    return x is not None and all(v is not None and np.isfinite(v) for v in x)


def test_metric_join(frame, store, monkeypatch):
    for name, value in (("CELL_ROWS", 20), ("OWN_ROWS", 16), ("MEMBER_ROWS", 40), ("STEP", 7)):
        monkeypatch.setattr(metric_join, name, value)
    rows = vectors()
    x = [np.array(np.array(r[1], np.float32), np.float64) if good(r[1]) and any(r[1]) else None for r in rows]
    pairs = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j])
        and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.9
    ]
    links = np.bincount([p for pair in pairs for p in pair], minlength=len(rows))
    label = components_of(len(rows), pairs)
    least = {}
    for i, r in enumerate(rows):
        least[label[i]] = min(r[0], least.get(label[i], 1 << 60))
    expected = sorted((r[0], int(links[i]), least[label[i]], r[0] == least[label[i]]) for i, r in enumerate(rows))
    found = metric_join.near_duplicates(frame, store)
    assert sorted(tuple(r) for r in found.select("vec_id", "n_links", "component_id", "kept").collect()) == expected
    assert metric_join.near_duplicates(frame.limit(0), store).count() == 0


def test_bitsliced_top_k(frame, store, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 50)
    monkeypatch.setattr(bitsliced, "QUERY_ROWS", 1)
    rows = [(r[0], np.floor(64 * np.array(np.array(r[1], np.float32), np.float64)).astype(int)) for r in vectors() if good(r[1])]
    dot = lambda a, b: int(a[: len(b)] @ b[: len(a)])
    expected = []
    for q, x in rows:
        if q % 20 == 0:
            scores = sorted((-dot(x, y), i) for i, y in rows if i != q)[:20]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    found = bitsliced.top_k(frame, store, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
    assert bitsliced.top_k(frame.limit(0), store, F.lit(True)).count() == 0


def test_bit_slices_with_few_rows_and_wide_values():
    rng = np.random.default_rng(0)
    for n in (1, 3, 64, 65, 200):
        x, q = rng.integers(-5000, 5000, (n, 6)), rng.integers(-300, 300, 6)
        rows, scores = bitsliced.BitSlices(x).top(q, 10)
        order = np.lexsort((np.arange(n), -(x @ q)))[:10]
        assert sorted(rows.tolist()) == sorted(order.tolist()) and (x[rows] @ q == scores).all()


@pytest.fixture(scope="module")
def labelled(spark):
    rows, marks = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = prose(i, 40) + (f" you {['idiot', 'zorga' + 'bcd'[i % 3], 'moron'][i % 3]} zorga{'xyz'[i % 3]}q" if toxic else "")
        rows.append((i, text, "en", "s", len(text), 0, "x"))
        marks.append((i, 1, int(toxic)))
    rows += [(600, "", None, None, None, 0, "x"), (601, None, None, None, None, 0, "x"), (None, "an idiot", None, None, None, 0, "x"), (0, prose(0, 10), None, None, None, 1, "x")]
    marks += [(None, 1, 1), (602, 1, None), (3, 1, 0)]
    return spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_finds_held_out_rows(labelled, spark):
    docs, labels = labelled
    found = toxicity.score(docs, labels, Store(spark)).collect()
    assert len(found) == docs.count()
    held = [r for r in found if r.held_out]
    assert 60 < len(held) < 200
    assert all(r.predicted == int(r.doc_id % 6 == 0) for r in held if r.doc_id < 600)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert {r.doc_id: r.predicted for r in found}[601] == 0
    kept = toxicity.drop_toxic(docs, labels, Store(spark))
    assert kept.columns == docs.columns and kept.where("doc_id % 6 <> 0 or doc_id >= 600").count() == 502


def test_toxicity_without_rows_or_labels(labelled, spark):
    docs, labels = labelled
    assert toxicity.score(docs.limit(0), labels, Store(spark)).count() == 0
    found = toxicity.score(docs, labels.limit(0), Store(spark))
    assert found.where("predicted = 1").count() == 0


def test_scores_ignore_labels_of_held_out_rows(labelled, spark):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs.where("doc_id is not null and tk = 0"), x, Store(spark)).select("doc_id", "score").collect() for x in (labels, turned))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("name", sorted(llm_oracle()))
def test_query_matches_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    result = con.sql(llm_oracle()[name])
    names = [c[0] for c in result.description]
    assert sorted(map(tuple, llm_queries()[name](spark, sf).select(*names).collect())) == sorted(result.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, store, at = [docs.count()], Store(spark), docs
    for name, stage in pipeline.STAGES[:-1]:
        at = store.save(stage(spark, at, sf))
        assert at.columns == docs.columns, name
        sizes.append(at.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3]
    assert pipeline.run(spark, sf).count() == sizes[-1]
