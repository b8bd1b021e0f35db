"""A factorization machine over hashed terms that scores a text's toxicity.

Terms are words in lower case, their first four and six letters, and what two words share of these, hashed to buckets. All buckets that two
labelled texts have are features, each as large as what is known of it: the more surely it tells toxic from other texts, or the more texts have it. The
machine has a weight for each and for each pair of them, through factors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_model import training_sample
from .shared import as_bytes, held_out, written

BUCKETS = 1 << 20
#: Standard errors that a bucket's log odds are from 0 where it counts in full; below, it counts by the power. What a bucket counts at least, as a part of the
#: share of texts that have it (frequent buckets without odds of their own may have them in pairs).
FULL_Z, POWER, FREQUENT = 5.0, 4, 0.3
FACTORS = 4
PREFIXES = (4, 6)
#: Labelled rows that a model is fitted on, about; chosen by a hash of their id.
TRAINING_ROWS = 8_000
#: Passes over them, rows of a step, and how far a step goes and draws weights back.
PASSES, BATCH, STEP_SIZE, PENALTY = 30, 256, 0.05, 1e-2
#: Rows that have a bucket, at least: what one text alone has tells nothing of others.
LEAST_ROWS = 2
#: Score at which a text is predicted to be toxic.
CUT = 0.5

_WORD = re.compile(r"\w+")
_CACHE_LIMIT = 200_000


class Terms(dict):
    """The buckets of a word: its own, and those of its first letters."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        own = xxhash.xxh64_intdigest(word) % BUCKETS
        value = self[word] = (own, *(xxhash.xxh64_intdigest(word[:k] + "*") % BUCKETS for k in PREFIXES if len(word) > k))
        return value

    def of(self, text: bytes | None) -> set[int]:
        """A text's buckets, and a bucket for each that two or more of its words share."""
        once: set[int] = set()
        twice: set[int] = set()
        for word in set(_WORD.findall(text.decode().lower())) if text else ():
            own = self[word]
            twice.update(once.intersection(own))
            once.update(own)
        once.update([(b * 31 + 7) % BUCKETS for b in twice])
        return once


def places_of(present: set[int], places: np.ndarray) -> np.ndarray:
    """The places of the buckets that are features, in order."""
    at = places[np.fromiter(present, np.int64, len(present))]
    return np.sort(at[at >= 0])


@dataclass(frozen=True)
class Machine:
    """For each bucket its place among the features, or -1, with their weights and factors."""

    intercept: float
    places: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def score(self, present: set[int]) -> float:
        at = places_of(present, self.places)
        v = self.factors[at]
        s = self.intercept + self.linear[at].sum() + 0.5 * ((v.sum(0) ** 2) - (v * v).sum(0)).sum()
        return 1 / (1 + math.exp(-min(max(s, -500.0), 500.0)))


def _constant(share: float) -> Machine:
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Machine(math.log(p / (1 - p)), np.full(BUCKETS, -1, np.int32), np.zeros(0), np.zeros((0, FACTORS)))


def _bucket_counts(sample: DataFrame) -> DataFrame:
    """bucket, in_toxic, in_other: rows of the sample whose text has the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = Terms(), (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                counts[label > 0].update(terms.of(text))
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([counts[k][b] for b in keys], pa.int64()) for k in (1, 0))], names=["bucket", "in_toxic", "in_other"])

    each = sample.select("label", "text").mapInArrow(run, "bucket long, in_toxic long, in_other long")
    return each.groupBy("bucket").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_other").alias("in_other"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> Machine:
    """Weighs features and fits the machine on about `rows` labelled rows that are not held out, in one task.

    Without labels of both kinds the score is the share of toxic labels, 0.5 if there are none.
    """
    sample = written(training_sample(docs.select(id_col, F.col(text_col).cast("string").alias("text")), labels, label_col, id_col, rows).select("label", "text"), "training")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < toxic < n:
        return _constant(toxic / n if n else 0.5)
    a, b, ta, tb = F.col("in_toxic"), F.col("in_other"), F.lit(toxic), F.lit(n - toxic)
    odds = F.log((a + 0.5) / (ta + 1)) - F.log((b + 0.5) / (tb + 1))
    error = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    known = F.pow(F.least(F.abs(odds / error) / FULL_Z, F.lit(1.0)), POWER) + FREQUENT * (a + b) / n
    found = _bucket_counts(sample).where(a + b >= LEAST_ROWS).select("bucket", known.alias("known")).orderBy("bucket").toArrow()  # BUCKETS rows at most
    if not found.num_rows:
        return _constant(toxic / n)
    values, places = found["known"].to_numpy().astype(np.float32), np.full(BUCKETS, -1, np.int32)
    places[found["bucket"].to_numpy()] = np.arange(len(values))
    shared = docs.sparkSession.sparkContext.broadcast((places, values))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            at = [places_of(terms.of(t), shared.value[0]) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32()))], names=["label", "at"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(float(y), at.values.to_numpy()) for batch in batches for y, at in zip(batch.column(0).to_pylist(), batch.column(1))]
        weights = _descend(sorted(rows, key=lambda x: (x[0], x[1].tobytes())), shared.value[1])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    # The labelled rows are about `rows`, however many documents there are: their features are a few numbers a word, and one task fits them.
    features = written(sample.select("label", "text").mapInArrow(vectors, "label double, at array<int>"), "features")
    fitted = features.coalesce(1).mapInArrow(descend, "weights binary").first()["weights"]
    weights, known = np.frombuffer(fitted, np.float32).reshape(2 + FACTORS, -1), values.astype(np.float64)
    return Machine(float(weights[0, 0]), places, weights[1, 1:] * known, (weights[2:, 1:] * known).T)


def _gradient(label: np.ndarray, flat: np.ndarray, lengths: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of rows' gradients of the log loss, laid out as the weights are."""
    size, row = len(values), np.repeat(np.arange(len(label)), lengths)
    x, out = values[flat].astype(np.float64), np.zeros(weights.shape)
    sums = [np.bincount(row, x * w[1:][flat], len(label)) for w in weights[1:]]
    s = weights[0, 0] + sums[0]
    for v, total in zip(weights[2:], sums[1:], strict=True):
        s = s + 0.5 * (total**2 - np.bincount(row, (x * v[1:][flat]) ** 2, len(label)))
    off = 1 / (1 + np.exp(-np.clip(s, -500, 500))) - label
    out[0, 0] = off.sum()
    out[1, 1:] = np.bincount(flat, x * off[row], size)
    own = np.bincount(flat, x * x * off[row], size)
    for k, total in enumerate(sums[1:], 2):
        out[k, 1:] = np.bincount(flat, x * (off * total)[row], size) - weights[k, 1:] * own
    return out


def _descend(rows: list[tuple[float, np.ndarray]], values: np.ndarray) -> np.ndarray:
    """The intercept at [0, 0]; from column 1 on, row 1 has the linear weights and the others the factors. rows: label, features.

    Adam with decoupled decay on batches of rows, in an order that depends on the rows only. Gradients are sparse in the
    features of a batch, so all buckets can be features; Spark's own FMClassifier makes a dense gradient for each row.
    """
    weights = np.zeros((2 + FACTORS, 1 + len(values)), np.float32)
    weights[2:, 1:] = np.random.default_rng(5).normal(0, 0.01, (FACTORS, len(values)))
    mean, square, order, step = np.zeros_like(weights), np.zeros_like(weights), np.random.default_rng(7), 0
    for _ in range(PASSES):
        dealt = order.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            mine, step = [rows[i] for i in dealt[start : start + BATCH]], step + 1
            g = _gradient(np.array([y for y, _ in mine]), np.concatenate([at for _, at in mine]), np.array([len(at) for _, at in mine]), values, weights).astype(np.float32) / len(mine)
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            weights = weights * np.float32(1 - STEP_SIZE * PENALTY) - STEP_SIZE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """For each row: id_col, held_out, score, predicted (1 if score >= cut).

    Null and empty texts have no terms, and the score of the intercept; null ids and repeated rows are like any other
    row; a text's length is not bounded; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(terms.of(t)) for t in as_bytes(batch.column(1))], pa.float64())], names=[id_col, "score"])

    kind = dict(docs.dtypes)[id_col]
    scored = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
