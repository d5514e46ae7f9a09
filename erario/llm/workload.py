"""The registered queries of the operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erario.store import Store

from . import (
    bitsliced, centroids, fill_middle, line_templates, metric_join, mixing, page_text, prefix_bpe, simhash, suffix_dedup,
    token_files, toxicity, window_dedup,
)
from .common import read_table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), Store(spark), words=4, bits=4)


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Store(spark).path("tokens")
    token_files.write_tokens(read_table(spark, sf_dir, "documents"), path, WORD_TOKENIZER)
    return token_files.ids_digest(token_files.read_tokens(spark, path))


def source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, Store(spark), lambda i: 1 + i % 3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.score(docs, labels, Store(spark))


def prefix_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return prefix_bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN)


def _with_digest(removed: DataFrame) -> DataFrame:
    """The bytes that are left as a digest in their place."""
    return removed.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")


def template_line_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return _with_digest(line_templates.summary(docs, Store(spark), min_long=line_templates.MIN_LONG))


def suffix_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_digest(suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), Store(spark), n=200))


def window_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_digest(window_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), Store(spark), n=35))


def metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(read_table(spark, sf_dir, "embeddings"), Store(spark), cosine=0.9)


def bitsliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))
    return bitsliced.top_k(read_table(spark, sf_dir, "embeddings"), Store(spark), asked, k=20)


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(
        read_table(spark, sf_dir, "embeddings"), Store(spark), k=8, rounds=10, dims=64, scale=1024, seed=3)
    return centroids.with_inertia(*found)


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(
        read_table(spark, sf_dir, "documents"), unit="line", seed=7, percent=100, suffix_first=50)
    digest = {name: F.sha2(c.cast("binary"), 256) for name, c in (
        ("output_sha256", F.col("output")), ("restored_sha256", fill_middle.restored()))}
    return cut.withColumns(digest).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_text.extract(read_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash_components,
        "op2_token_output": token_output,
        "op3_line_templates": template_line_removal,
        "op4_source_weights": source_weights,
        "op5_suffix_removal": suffix_removal,
        "op6_metric_join": metric_range_join,
        "op7_toxicity": toxicity_scores,
        "op8_window_removal": window_removal,
        "op9_prefix_bpe": prefix_bpe_round_trip,
        "op10_bitsliced_top_k": bitsliced_top_k,
        "op11_centroids": centroid_clusters,
        "op12_fill_middle": fill_in_middle,
        "op13_page_text": page_main_text,
    }


def llm_oracle() -> dict[str, str]:
    """SQL for those that it can express, in bearable time on whole tables."""
    return {
        "op3_line_templates": LINES_SQL,
        "op6_metric_join": METRIC_JOIN_SQL,
        "op8_window_removal": WINDOWS_SQL,
        "op10_bitsliced_top_k": TOP_K_SQL,
        "op11_centroids": centroids_sql(),
        "op12_fill_middle": FILL_MIDDLE_SQL,
    }


METRIC_JOIN_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(x, lambda e: e <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  AND list_cosine_similarity(a.x, b.x) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, component_id,
  v.vec_id = component_id AS kept FROM v JOIN least ON least.a = v.vec_id
"""

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: floor(64 * e)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""

LINES_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS tk, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, tk, unnest(ls) AS raw, generate_subscripts(ls, 1) AS no FROM d
), masked AS (
  SELECT *, list_transform(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS ts FROM line
), parsed AS (
  SELECT *, array_to_string(ts, ' ') AS known, array_to_string(list_concat([CAST(len(ts) AS VARCHAR)], ts[1:3]), ' ') AS leaf
  FROM masked WHERE len(ts) > 0
), leaves AS (SELECT leaf, count(DISTINCT tk) AS n FROM parsed GROUP BY leaf HAVING count(DISTINCT tk) >= 5
), holder AS (
  SELECT leaf, known, tk, n, first(ts) AS ts, min(doc_id) AS doc_id FROM parsed JOIN leaves USING (leaf) GROUP BY leaf, known, tk, n
), token AS (
  SELECT leaf, known, tk, n, unnest(ts) AS token, generate_subscripts(ts, 1) AS place FROM holder
), often AS (
  SELECT leaf, place, token FROM token GROUP BY leaf, place, token, n
  HAVING count(DISTINCT tk) >= 5 AND count(DISTINCT tk) >= 0.25 * n
), typed AS (
  SELECT t.leaf, t.known, avg(CASE WHEN often.token IS NULL THEN 0 ELSE 1 END) AS share,
    string_agg(coalesce(often.token, '<*>'), ' ' ORDER BY t.place) AS pattern
  FROM (SELECT DISTINCT leaf, known, place, token FROM token) t LEFT JOIN often USING (leaf, place, token) GROUP BY t.leaf, t.known
), template AS (
  SELECT leaf, known, CASE WHEN share >= 0.5 THEN 't ' || leaf || '|' || pattern ELSE 'l ' || known END AS template FROM typed
), recurring AS (
  SELECT template, min(doc_id) AS first_doc FROM template JOIN holder USING (leaf, known) GROUP BY template HAVING count(DISTINCT tk) >= 5
), owned AS (
  SELECT known, first_doc, 0 AS rule FROM template JOIN recurring USING (template)
  UNION ALL
  SELECT known, min(doc_id), 1 FROM parsed WHERE len(ts) >= 50 AND 2 * len(list_filter(ts, lambda t: t = '<*>')) < len(ts)
  GROUP BY known HAVING count(DISTINCT tk) >= 2
), owner AS (SELECT known, arg_min(first_doc, rule) AS first_doc FROM owned GROUP BY known
), gone AS (
  SELECT parsed.doc_id, parsed.no FROM parsed JOIN owner USING (known) WHERE parsed.doc_id <> owner.first_doc
), kept AS (
  SELECT line.doc_id, count(gone.no) AS n_removed, string_agg(raw, chr(10) ORDER BY line.no) FILTER (WHERE gone.no IS NULL) AS text
  FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.no = line.no GROUP BY line.doc_id
)
SELECT d.doc_id, CASE WHEN d.text = '' THEN 0 ELSE len(ls) END AS n_lines, n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id
"""

WINDOWS_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), word AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)
), rep AS (
  SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)
), marked AS (
  SELECT word.doc_id, word.j, word, word.j - max(rep.i) OVER (PARTITION BY word.doc_id ORDER BY word.j) <= 34 AS gone
  FROM word LEFT JOIN rep ON rep.doc_id = word.doc_id AND rep.i = word.j
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
    string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone IS DISTINCT FROM true) AS text FROM marked GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

FILL_MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a,
    CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d
), parts AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
      WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
    ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts
"""


def centroids_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """A common table a round: assignment to the centroids of the last one, then floors of means."""
    steps = [f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: CAST(floor({scale} * e) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS j, v FROM kept
  QUALIFY j < {k}
)"""]
    assign = """a{i} AS MATERIALIZED (
  SELECT row, vec_id, v, d.distance, d.j AS cluster FROM (
    SELECT kept.row, kept.vec_id, kept.v, min({{'distance': CAST(list_sum(list_transform(list_zip(kept.v, c{i}.v),
      lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'j': c{i}.j}}) AS d FROM kept, c{i} GROUP BY ALL))"""
    move = """m{i} AS MATERIALIZED (
  SELECT cluster, list(CAST(q AS BIGINT) ORDER BY place) AS v FROM (
    SELECT cluster, place, (s - ((s % n) + n) % n) // n AS q FROM (
      SELECT cluster, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY cluster, place)) GROUP BY cluster
), c{j} AS MATERIALIZED (SELECT c{i}.j, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.cluster = c{i}.j)"""
    for i in range(rounds):
        steps += [assign.format(i=i), move.format(i=i, j=i + 1)]
    steps.append(assign.format(i=rounds))
    return ", ".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.j = cluster
"""
