"""Toxicity by weak supervision.

Terms (words, and beginnings of words) that mark labelled toxic rows are mined from training rows.
Each is a voter that calls a document toxic or abstains; pattern voters over groups of terms also
call it clean.  A generative label model estimates from the votes on all documents how often each
voter votes what, given the hidden class; voters that repeat each other share one voice.  A linear
classifier is trained on the posterior labels of the training rows and scores every document.

Scores depend on the text only.  Rows whose crc32(doc_id) falls in the held-out share, rows without
a label and rows without doc_id teach nothing.  Empty and null texts hold no term and get the score
of a document without terms.  Without toxic labels or without terms every score is the prior.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario.store import Store

from .common import DOC, text_hash, text_or_empty, tidy, without

#: Labelled rows that teach (those with the smallest hashes), terms kept, and voters.
SAMPLE_ROWS, TERMS, VOTERS = 20_000, 400, 60
#: Step of posteriors; sums of them are exact in a batch, and in whole numbers beyond.
UNIT = 2.0**-30
BEGINNINGS = (4, 5, 6)
WORDS = re.compile(r"\w+")
#: Plain insults that vote whether or not the labelled rows hold them.
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "loser", "pathetic", "worthless", "scum", "trash", "garbage",
    "disgusting", "clown", "fool", "jerk", "coward", "liar", "filth", "vermin", "imbecile", "cretin",
)
ROUNDS = 4
SKETCHES = 4
EDGE = 1e-4


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def terms_of(text: str) -> set[str]:
    """Words, and their beginnings marked by the length: 4~idio."""
    words = set(WORDS.findall(text.lower()))
    return words.union(f"{n}~{w[:n]}" for w in words for n in BEGINNINGS if len(w) > n)


class Finder:
    """Numbers of the known terms in a text."""

    def __init__(self, terms: list[str]):
        self.words = {t: i for i, t in enumerate(terms) if "~" not in t}
        self.begin = {n: {t[2:]: i for i, t in enumerate(terms) if t.startswith(f"{n}~")} for n in BEGINNINGS}

    def find(self, text: str) -> list[int]:
        words = set(WORDS.findall(text.lower()))
        found = [self.words[w] for w in words.intersection(self.words)]
        for n, known in self.begin.items():
            if known:
                heads = {w[:n] for w in words if len(w) > n}
                found += [known[h] for h in heads.intersection(known)]
        return sorted(found)


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[toxic].update(terms_of(text))
        terms = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), *(pa.array([counts[c][t] for t in terms], pa.int64()) for c in (1, 0))],
            names=["term", "bad", "good"],
        )


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest hashes of a text's three-word shingles, by several seeds."""
    for batch in batches:
        keys = [[] for _ in range(SKETCHES)]
        for text in batch.column(0).cast(pa.binary()):
            words = text.as_py().split()
            shingles = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
            for seed, key in enumerate(keys):
                key.append(min(xxhash.xxh3_64_intdigest(s, seed=seed) >> 1 for s in shingles))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(k, pa.int64()) for k in keys)],
            names=["text", "toxic", *(f"k{i}" for i in range(SKETCHES))],
        )


def without_copies(sample: DataFrame, store: Store) -> DataFrame:
    """One row of each group of rows that share a sketch, by one sketch after the other: copies
    and near copies would lend their words the weight of their number."""
    names = [f"k{i}" for i in range(SKETCHES)]
    rows = sample.select("text", "toxic").mapInArrow(
        _sketches, "text string, toxic int, " + ", ".join(f"{n} long" for n in names))
    rows = store.save(rows)
    left = rows.select(*names, F.xxhash64("text").alias("t"))
    for name in names:
        others = [n for n in (*names, "t") if n != name]
        left = left.groupBy(name).agg(F.min(F.struct(*others)).alias("s")).select(name, "s.*")
    kept = store.save(left.select("t").distinct())  # at most the sample's rows
    one = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(kept), "t", "left_semi")
    return store.save(one.groupBy("t").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")))


def mine(sample: DataFrame, store: Store, most: int = TERMS) -> list[str]:
    """Terms of toxic rows that chance does not explain, the clearest first."""
    texts = without_copies(sample, store)
    size = texts.agg(F.count("*"), F.sum("toxic")).head()
    n, bad = size[0], size[1] or 0
    if not 0 < bad < n:
        return []
    rate = bad / n
    counted = store.save(
        texts.select("text", "toxic").mapInArrow(tidy("toxicity", _count_terms), "term string, bad long, good long")
        .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    tested = counted.count()
    total = F.col("bad") + F.col("good")
    share = (F.col("bad") + 0.5) / (total + 1)
    gain = F.col("bad") * F.log(share / rate) + F.col("good") * F.log((1 - share) / (1 - rate))
    top = (
        counted.withColumn("gain", gain).where((share > 0.5 + rate / 2) & (F.col("gain") > float(np.log(tested) + 3)))
        .orderBy(F.desc("gain"), "term").limit(most).collect()
    )
    return [r["term"] for r in top]


class LabelModel:
    """Class-wise vote frequencies of voters (votes -1 clean, 0 none, 1 toxic) and the voice of each."""

    def __init__(self, frequency: np.ndarray, prior: float, voice: np.ndarray):
        self.frequency, self.prior, self.voice = frequency, prior, voice  # frequency[class, voter, vote + 1]

    @staticmethod
    def of_labelled(votes: np.ndarray, toxic: np.ndarray) -> LabelModel:
        frequency = np.stack([_shares(_tally(votes, w)) for w in (1.0 - toxic, toxic)])
        voice = 1 / np.maximum(1, (_correlation(votes, toxic) > 0.5).sum(axis=1))
        return LabelModel(frequency, float(np.clip(toxic.mean(), EDGE, 1 - EDGE)), voice)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = np.log(self.frequency[1] / self.frequency[0]) * self.voice[:, None]
        z = np.log(self.prior / (1 - self.prior)) + sum(
            (votes == v - 1) @ ratio[:, v] for v in range(3)
        )
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tally(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.stack([weight @ (votes == v) for v in (-1, 0, 1)], axis=1)


def _shares(tally: np.ndarray) -> np.ndarray:
    smooth = tally + np.array([0.5, 1.0, 0.5])
    return smooth / smooth.sum(axis=1, keepdims=True)


def _correlation(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Correlations of votes within the classes, averaged by their sizes."""
    total = np.zeros((votes.shape[1],) * 2)
    for value in (0, 1):
        part = votes[toxic == value].astype(float)
        if len(part) > 1:
            part -= part.mean(axis=0)
            scale = np.sqrt((part * part).sum(axis=0))
            scale[scale == 0] = np.inf
            total = np.maximum(total, (part / scale).T @ (part / scale))
    np.fill_diagonal(total, 1)
    return total


def cast_votes(found: list[np.ndarray], n_words: np.ndarray, terms: list[str], voters: int) -> np.ndarray:
    """Votes of the leading terms, then of patterns: any known word, any known beginning, any
    insult, two terms or more."""
    insult = np.array([t in INSULTS for t in terms], bool)
    word = np.array(["~" not in t for t in terms], bool)
    votes = np.zeros((len(found), voters + 4), np.int8)
    for row, hits in enumerate(found):
        votes[row, hits[hits < voters]] = 1
        votes[row, voters:] = [word[hits].any(), (~word[hits]).any(), insult[hits].any(), len(hits) > 1]
    pattern = votes[:, voters:]
    pattern[(pattern == 0) & (n_words[:, None] > 0)] = -1
    return votes


def _arrays(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(x, np.int64) for x in column]


def refine(model: LabelModel, found: DataFrame, terms: list[str], voters: int, labelled: np.ndarray) -> LabelModel:
    """Expectation maximisation over the votes on all documents; the labelled tallies stay in.
    Posteriors are whole multiples of ``UNIT``, so that sums do not depend on the order of documents."""

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, voters + 4, 3), np.int64)
        for frame in frames:
            votes = cast_votes(_arrays(frame["terms"]), frame["n_words"].to_numpy(), terms, voters)
            p = np.rint(model.posterior(votes) / UNIT)
            total += np.stack([_tally(votes, 1 / UNIT - p), _tally(votes, p)]).astype(np.int64)
        flat = total.ravel()
        yield pd.DataFrame({"at": np.arange(len(flat)), "n": flat})

    for _ in range(ROUNDS):
        rows = found.select("terms", "n_words").mapInPandas(tidy("toxicity", tally), "at long, n long")
        sums = {r["at"]: r["n"] for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect()}
        total = UNIT * np.array([sums.get(i, 0) for i in range(2 * (voters + 4) * 3)]).reshape(2, voters + 4, 3)
        both = total + labelled
        share = both[1, 0].sum() / max(both[:, 0].sum(), 1e-9)
        model = LabelModel(np.stack([_shares(t) for t in both]), float(np.clip(share, EDGE, 1 - EDGE)), model.voice)
    return model


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Weights and intercept (last) of a logistic regression on soft labels."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
    return w


def score(docs: DataFrame, labels: DataFrame, store: Store, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, tk) of every document; tk is a hash of its text."""
    teaching = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    teaching = store.save(teaching)  # at most sample_rows
    sample = store.save(docs.select("doc_id", text_or_empty()).join(F.broadcast(teaching), "doc_id"))
    terms = mine(sample.select("text", "toxic"), store)
    terms += [t for t in INSULTS if t not in terms]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(terms)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([finder.find(t) for t in texts], pa.list_(pa.int32())),
                 pa.array([int(bool(t.strip())) for t in texts], pa.int32())],
                names=["doc_id", "tk", "terms", "n_words"],
            )

    found = store.save(docs.select("doc_id", text_or_empty(), text_hash()).mapInArrow(
        tidy("toxicity", find), "doc_id long, tk long, terms array<int>, n_words int"
    ))
    taught = found.join(F.broadcast(teaching), "doc_id").select("doc_id", "tk", "terms", "n_words", "toxic").toPandas()
    taught = taught.sort_values(["doc_id", "tk"], ignore_index=True)  # so that reruns fit the same weights
    weights, base = np.zeros(len(terms)), -4.0
    if len(taught) and taught["toxic"].nunique() == 2:
        voters = min(VOTERS, len(terms))
        hits, toxic = _arrays(taught["terms"]), taught["toxic"].to_numpy().astype(float)
        votes = cast_votes(hits, taught["n_words"].to_numpy(), terms, voters)
        labelled = np.stack([_tally(votes, 1 - toxic), _tally(votes, toxic)])
        model = refine(LabelModel.of_labelled(votes, toxic), found, terms, voters, labelled)
        x = np.zeros((len(hits), len(terms)))
        for row, own in enumerate(hits):
            x[row, own] = 1
        fitted = fit_linear(x, model.posterior(votes))
        weights, base = fitted[:-1], fitted[-1]
    z = F.lit(float(base)) + F.aggregate(
        F.coalesce(F.transform("terms", lambda t: F.element_at(F.array(*map(F.lit, weights.tolist())), t + 1)), F.array()),
        F.lit(0.0), lambda a, b: a + b,
    )
    return found.select(
        "doc_id", held_out().alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"),
        (1 / (1 + F.exp(-z)) >= 0.5).cast("int").alias("predicted"), "tk")


def drop_toxic(docs: DataFrame, labels: DataFrame, store: Store) -> DataFrame:
    """The documents that are not predicted toxic; each row goes or stays by its own text."""
    found = score(docs, labels, store)
    return without(docs, store.save(found.where("predicted = 1").select(*DOC).distinct()))
