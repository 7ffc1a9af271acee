"""Toxicity by a classifier chain: linear models in sequence, each fed the ones before.

The categories are label columns in a fixed order. The model of a category sees the words
and word beginnings of a text and the probabilities of all earlier categories. While it is
trained these are out-of-fold predictions (models that did not see the row), so it meets
the same kind of probability that it gets when scoring.

Training takes a bounded sample of labelled rows (``SAMPLE``, the first in a seeded
order); features are counted on Spark, and only the ``FEATURES`` most telling ones of each
category and the sample's few occurrences of them reach the driver. Scoring streams every
whole text once through the tasks, without a shuffle.

Defined results: null text is empty and scores as a text without features; a category
without a positive or a negative labelled row has its base rate as probability, 0 without
labels; repeated rows get equal scores; labels of unknown documents and null labels are
left out; an empty table gives no rows. Other columns pass through or are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmerge.llm.common import stored, whole_text

#: Labelled rows that a chain is trained on, at most.
SAMPLE = 20_000
#: Features of one category, and what they need: positive rows, and a test score.
FEATURES, LEAST_ROWS, LEAST_SCORE = 1_000, 4, 4.0
FOLDS = 3
THRESHOLD = 0.5
SEED = 10
#: Lengths of the word beginnings that count besides whole words.
PREFIXES = range(3, 8)
_STEPS, _RATE, _RIDGE = 400, 0.3, 1e-4
_TOKEN = re.compile(r"\w+|[^\w\s]{2,}")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def features_of(token: str) -> list[str]:
    """A token and its beginnings (written with a hyphen, so never equal to a token)."""
    return [token, *(token[:k] + "-" for k in PREFIXES if k < len(token))]


class Vocabulary:
    """Positions of the chosen features, and of those of any token, looked up once."""

    def __init__(self, names: list[str]):
        self.at = {name: k for k, name in enumerate(names)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.at

    def __setstate__(self, at):
        self.at, self.seen = at, {}

    def of(self, token: str) -> tuple[int, ...]:
        found = self.seen.get(token)
        if found is None:
            if len(self.seen) > 500_000:  # open-ended corpora: start the look-up table again
                self.seen.clear()
            found = self.seen[token] = tuple(
                self.at[f] for f in features_of(token) if f in self.at
            )
        return found

    def row(self, text: str) -> tuple[dict[int, float], float]:
        """Log counts of the features of a text, and its log length."""
        found = tokens(text)
        counts: Counter[int] = Counter()
        for token, n in Counter(found).items():
            for k in self.of(token):
                counts[k] += n
        return {k: math.log1p(n) for k, n in counts.items()}, math.log1p(len(found))


@dataclass(frozen=True)
class Matrix:
    """Sparse rows: place, column and value of each entry, and dense columns beside them."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    dense: np.ndarray

    def chosen(self, which: np.ndarray) -> Matrix:
        new = np.cumsum(which) - 1
        hit = which[self.rows]
        return Matrix(new[self.rows[hit]], self.columns[hit], self.values[hit], self.dense[which])

    def beside(self, column: np.ndarray) -> Matrix:
        return Matrix(self.rows, self.columns, self.values, np.column_stack([self.dense, column]))


@dataclass(frozen=True)
class Linear:
    """A logistic model: a weight per feature, and one per dense column."""

    sparse: np.ndarray
    dense: np.ndarray

    def probability(self, x: Matrix) -> np.ndarray:
        score = x.dense @ self.dense + np.bincount(
            x.rows, x.values * self.sparse[x.columns], minlength=len(x.dense)
        )
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def train(x: Matrix, y: np.ndarray, size: int) -> Linear:
    """Ridge logistic regression by full gradients with adaptive steps."""
    rate = y.mean() if len(y) else 0.0
    weights = np.zeros(size + x.dense.shape[1])
    weights[size] = math.log(max(rate, 1e-9) / max(1 - rate, 1e-9))  # the constant column
    if not 0 < rate < 1:
        return Linear(weights[:size], weights[size:])
    speed, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, _STEPS + 1):
        miss = (Linear(weights[:size], weights[size:]).probability(x) - y) / len(y)
        gradient = np.concatenate([
            np.bincount(x.columns, x.values * miss[x.rows], minlength=size) + _RIDGE * weights[:size],
            miss @ x.dense,
        ])
        speed = 0.9 * speed + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        pace = _RATE / (1 + step / 100)
        weights -= pace * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Linear(weights[:size], weights[size:])


@dataclass(frozen=True)
class Chain:
    """Vocabulary and one model per category, in order."""

    vocabulary: Vocabulary
    categories: list[str]
    models: list[Linear]

    def of_texts(self, column: pa.Array) -> np.ndarray:
        """A row of probabilities for each text; null is the empty text."""
        rows = [self.vocabulary.row(t.as_py() or "") for t in column]
        return self.probabilities(rows) if rows else np.zeros((0, len(self.models)))

    def probabilities(self, rows: list[tuple[dict[int, float], float]]) -> np.ndarray:
        x, out = matrix(rows), []
        for model in self.models:
            out.append(model.probability(x))
            x = x.beside(out[-1])
        return np.column_stack(out)


def matrix(rows: list[tuple[dict[int, float], float]]) -> Matrix:
    at = [k for k, (found, _) in enumerate(rows) for _ in found]
    columns = [c for found, _ in rows for c in found]
    values = [v for found, _ in rows for v in found.values()]
    dense = np.column_stack([np.ones(len(rows)), [length for _, length in rows]])
    return Matrix(np.array(at, np.int64), np.array(columns, np.int64), np.array(values, float), dense)


def fit_chain(rows: list, labels: np.ndarray, folds: np.ndarray, vocabulary: Vocabulary,
              categories: list[str]) -> tuple[Chain, np.ndarray]:
    """The chain, and the out-of-fold probabilities of the training rows."""
    x, size = matrix(rows), len(vocabulary.at)
    models, held_out = [], np.zeros((len(rows), len(categories)))
    for k in range(len(categories)):
        y = labels[:, k]
        for fold in range(FOLDS):
            inside, outside = folds != fold, folds == fold
            if outside.any():
                model = train(x.chosen(inside), y[inside], size)
                held_out[outside, k] = model.probability(x.chosen(outside))
        models.append(train(x, y, size))
        x = x.beside(held_out[:, k])
    return Chain(vocabulary, categories, models), held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column],
                    id_col: str, text_col: str, sample: int) -> DataFrame:
    """(id, text, y): the first labelled documents in a seeded order of their ids."""
    y = F.array(*[c.cast("int") for c in categories.values()])
    known = labels.select(F.col(id_col).alias("id"), y.alias("y")).where(
        F.col("id").isNotNull() & F.forall("y", lambda v: v.isNotNull())
    )
    few = known.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "y").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return texts.join(F.broadcast(few), "id")  # at most ``sample`` rows of two columns


def choose_features(sample: DataFrame, names: list[str]) -> list[str]:
    """The features that tell most for each category, by a two-proportion test."""
    n = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
                for name in {f for token in set(tokens(text)) for f in features_of(token)}:
                    row = counts.setdefault(name, [0] * (n + 1))
                    row[n] += 1
                    for k in range(n):
                        row[k] += y[k]
            columns = list(zip(*counts.values(), strict=True)) or [()] * (n + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string())] + [pa.array(c, pa.int64()) for c in columns],
                ["name", *[f"p{k}" for k in range(n)], "n"],
            )

    schema = "name string, " + "".join(f"p{k} bigint, " for k in range(n)) + "n bigint"
    found = stored(sample.mapInArrow(count, schema).groupBy("name").agg(
        *[F.sum(c).alias(c) for c in [*[f"p{k}" for k in range(n)], "n"]]
    ).where(F.greatest(*[f"p{k}" for k in range(n)], F.lit(0)) >= LEAST_ROWS), "toxicity-features")
    totals = sample.agg(F.count("*"), *[F.sum(F.col("y")[k]) for k in range(n)]).first()
    chosen: dict[str, None] = {}
    for k in range(n):
        rows, positive = totals[0], totals[k + 1] or 0
        if not 0 < positive < rows:
            continue
        share = F.col("n") / rows
        gap = F.col(f"p{k}") / positive - (F.col("n") - F.col(f"p{k}")) / (rows - positive)
        spread = share * (1 - share) * (1 / positive + 1 / (rows - positive))
        score = gap / F.sqrt(spread + F.lit(1e-12))
        best = found.where(F.col(f"p{k}") >= LEAST_ROWS).select("name", score.alias("score")).where(
            F.col("score") >= LEAST_SCORE
        ).orderBy(F.desc("score"), "name").limit(FEATURES)
        chosen |= dict.fromkeys(r["name"] for r in best.collect())
    return list(chosen)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id",
        text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """Train a chain on labelled documents; ``categories`` are 0/1 columns of ``labels``."""
    rows = stored(labelled_sample(docs, labels, categories, id_col, text_col, sample), "toxicity-sample")
    names = list(categories)
    vocabulary = Vocabulary(choose_features(rows, names))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vocabulary.row(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch["id"], batch["y"], batch["fold"],
                pa.array([list(f) for f, _ in found], pa.list_(pa.int64())),
                pa.array([list(f.values()) for f, _ in found], pa.list_(pa.float64())),
                pa.array([length for _, length in found], pa.float64()),
            ], ["id", "y", "fold", "at", "value", "length"])

    fold = F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int")
    table = rows.withColumn("fold", fold).select("id", "y", "fold", "text").mapInArrow(
        extract, "id bigint, y array<int>, fold int, at array<bigint>, value array<double>, length double"
    ).orderBy("id", "y", "length").collect()
    found = [(dict(zip(r["at"], r["value"], strict=True)), r["length"]) for r in table]
    y = np.array([r["y"] for r in table], float).reshape(-1, len(names))
    folds = np.array([r["fold"] for r in table], int)
    return fit_chain(found, y, folds, vocabulary, names)[0]


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """(id, p): the first column of ``docs`` and the probabilities in the chain's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.of_texts(batch[1])
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(list(p), pa.list_(pa.float64()))], ["id", "p"]
            )

    kind = docs.dtypes[0][1]
    return docs.select(docs.columns[0], whole_text(text_col)).mapInArrow(run, f"id {kind}, p array<double>")


def without(docs: DataFrame, chain: Chain, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows whose last category stays below the threshold, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(chain.of_texts(batch[at])[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)


def categories() -> dict[str, Column]:
    """The two categories that ``labels`` has, in chain order; the last one decides."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_low_quality, p_toxic, toxic) of every document."""
    chain = fit(docs, labels, categories(), id_col, text_col)
    p = score(docs.select(id_col, text_col), chain, text_col)
    return p.select(
        "id", *[F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(chain.categories)],
        (F.col("p")[len(chain.categories) - 1] >= THRESHOLD).alias("toxic"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    return without(docs, fit(docs, labels, categories(), id_col, text_col), THRESHOLD, text_col)
