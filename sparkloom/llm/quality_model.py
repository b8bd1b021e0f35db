"""A sparse rule ensemble that scores a text's quality.

Paths of shallow trees over text statistics become conjunctive rules; a lasso logistic regression gives them weights,
most of them 0; and the rules that are left are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, held_out, written
from .text_stats import NAMES, statistics

#: Labelled rows that a model is fitted on, about; chosen by a hash of their id.
TRAINING_ROWS = 8_000
TREES, TREE_DEPTH = 16, 3
#: Weight of the lasso penalty.
LASSO = 0.002
#: Score at which a text is predicted to be good.
CUT = 0.3


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, lowest value excluded, highest value included)."""

    terms: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, lo, hi in self.terms:
            if lo > float("-inf"):
                out = out & (F.col(name) > F.lit(lo))
            if hi < float("inf"):
                out = out & (F.col(name) <= F.lit(hi))
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of a good text, as an expression over the columns of `with_statistics`."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def with_statistics(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The columns to keep, and a text's statistics."""
    fields = ", ".join([*(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep), *(f"`{n}` double" for n in NAMES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(statistics, as_bytes(batch.column(len(keep)))))) or [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, pa.float64()) for c in columns)], names=[*keep, *NAMES])

    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, fields)


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, rows: int) -> DataFrame:
    """Labelled rows that are not held out, about `rows` of them, with the label as `label`."""
    named = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.min(label_col).cast("double").alias("label"))
    n = named.count()
    share = min(1.0, rows / max(1, n))
    chosen = named.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    return docs.join(F.broadcast(chosen), id_col)  # about `rows` small rows


def _tree_rules(tree) -> Iterator[Rule]:  # noqa: ANN001
    """The conjunctions on the way to each node of a fitted tree."""

    def walk(node, bounds: dict[str, tuple[float, float]]) -> Iterator[Rule]:  # noqa: ANN001
        if bounds:
            yield Rule(tuple((k, *v) for k, v in sorted(bounds.items())))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, cut = NAMES[split.featureIndex()], split.threshold()
        lo, hi = bounds.get(name, (float("-inf"), float("inf")))
        yield from walk(node.leftChild(), bounds | {name: (lo, min(hi, cut))})
        yield from walk(node.rightChild(), bounds | {name: (max(lo, cut), hi)})

    yield from walk(tree._java_obj.rootNode(), {})


def _constant(share: float) -> Ensemble:
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Ensemble(math.log(p / (1 - p)), ())


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> Ensemble:
    """Fits trees, rules and weights on labelled rows that are not held out.

    Without labels of both kinds the score is the share of good labels, 0.5 if there are none.
    """
    sample = written(with_statistics(training_sample(docs.select(id_col, text_col), labels, label_col, id_col, rows), text_col, "label"), "training")
    n, good = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < good < n:
        return _constant(good / n if n else 0.5)
    vectors = sample.select("label", array_to_vector(F.array(*NAMES)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=11, maxBins=64).fit(vectors)
    rules = sorted({r for tree in forest.trees for r in _tree_rules(tree)}, key=lambda r: r.terms)
    if not rules:
        return _constant(good / n)
    flags = sample.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, tol=1e-5).fit(flags)
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble(float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """For each row: id_col, held_out, score, predicted (1 if score >= cut).

    Null and empty texts have statistics of 0, and the score that follows; null ids and repeated rows are like any
    other row; a text's length is not bounded; an empty table gives an empty result; other columns are not read.
    """
    return with_statistics(docs, text_col, id_col).select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
