"""A corpus pipeline of five stages, each a written table that the next one reads.

``run`` returns the last stage's rows: per document of the mix its id, the number of its tokens, and
digests of its token ids and of their decoded bytes.

A document is a row; rows are told apart by doc_id and text, so those without an id, or with one that
others share, go and stay by their own text.  Null and empty texts pass every filter; of all of them
one stays as near-duplicates of each other, and the mix takes it as often as its source is taken whole.
Texts of any length are read whole.  Repeated rows are one document to the near-duplicate stage and stay
together; the mix deals its copies out among them.  Columns beside those of ``documents`` pass through
the first four stages.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from erario.llm import line_templates, mixing, prefix_bpe, simhash, toxicity
from erario.llm.common import read_table
from erario.llm.workload import BYTE_RANKS
from erario.store import Store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"), Store(spark))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring(docs, Store(spark), min_long=line_templates.MIN_LONG)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, Store(spark), words=4, bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, Store(spark), lambda i: 1 + i % 3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prefix_bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN, cached=CACHED_PIECES)


#: Fewer than the operator alone remembers: executors that ran the other stages have less room.
CACHED_PIECES = 100_000
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("byte-level bpe", encode),
]
#: SQL has no label model, template tree, SimHash, knapsack or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = store.save(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs


def pipeline_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def pipeline_oracle() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
