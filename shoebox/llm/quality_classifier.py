"""Text quality by a sparse ensemble of rules.

Shallow trees over text statistics yield conjunctive rules, one for each path from a root; an L1-penalised logistic
fit over the rules' truth values keeps few of them; rules and weights become one Spark column expression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_parts, materialise, text_of

FEATURES = ("log_words", "word_length", "symbol_ratio", "upper_ratio", "digit_ratio", "punct_ratio", "high_ratio", "distinct_ratio", "top_word", "repeat_4", "dup_lines", "line_words", "stop_spread", "ends_ratio")
#: The trees and the lasso fit see at most this many labelled rows, those with the least hash of doc_id.
MAX_ROWS = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.002


def _byte_classes() -> np.ndarray:
    """For each byte: 0 other, 1 symbol, 2 upper, 3 digit, 4 punctuation, 5 non-ASCII, 6 blank, 7 lower."""
    of = np.zeros(256, np.uint8)
    for k, chars in ((1, b"#*$%&|<>@^~_=+{}[]\\/"), (2, bytes(range(65, 91))), (3, b"0123456789"), (4, b".,;:!?'\"()-"), (6, b" \t\n\v\f\r"), (7, bytes(range(97, 123)))):
        of[list(chars)] = k
    of[128:] = 5
    return of


def text_features(text: bytes, classes: np.ndarray) -> list[float]:
    """The statistics FEATURES of one text; all of them finite, also for an empty one."""
    hist = np.bincount(classes, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=8)
    words = text.split()
    n = len(words)
    m, chars = max(n, 1), max(len(text) - hist[6], 1.0)
    counts = Counter(words)
    grams = list(zip(words, words[1:], words[2:], words[3:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    top = sorted(counts.values(), reverse=True)
    return [
        math.log1p(n), min(chars / m, 40.0), hist[1] / chars, hist[2] / chars, hist[3] / chars, hist[4] / chars, hist[5] / chars,
        len(counts) / m * min(1.0, math.log1p(n) / math.log1p(200)), (top[0] if top else 0) / m, 1 - len(set(grams)) / max(len(grams), 1),
        1 - len(set(lines)) / max(len(lines), 1), min(n / max(len(lines), 1), 500.0), sum(top[:10]) / m, sum(w[-1] in b".!?" for w in words) / m,
    ]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes = _byte_classes()
    for batch in in_parts(batches):
        rows = np.array([text_features(t.as_py(), classes) for t in batch.column(2)], float).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(rows[:, k]) for k in range(len(FEATURES))]], ["doc_id", "text_hash", *FEATURES])


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and FEATURES of every row; null texts count as empty. No shuffle."""
    schema = "doc_id bigint, text_hash bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).cast("binary").alias("text")).mapInArrow(_featurise, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, at_most, threshold) tests; at_most False means greater."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for feature, at_most, x in self.tests:
            out &= (F.col(feature) <= x) if at_most else (F.col(feature) > x)
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 over the columns FEATURES."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _paths(node, tests: tuple, out: set) -> None:
    """All paths from the root, inner nodes included; a feature met twice keeps its tightest test."""
    if tests:
        tight: dict[tuple[str, bool], float] = {}
        for f, at_most, x in tests:
            key = (f, at_most)
            tight[key] = x if key not in tight else (min if at_most else max)(tight[key], x)
        out.add(Rule(tuple(sorted((f, a, x) for (f, a), x in tight.items()))))
    if node.subtreeDepth() > 0:
        split = node.split()
        f, x = FEATURES[split.featureIndex()], round(split.threshold(), 6)
        _paths(node.leftChild(), (*tests, (f, True, x)), out)
        _paths(node.rightChild(), (*tests, (f, False, x)), out)


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, seed: int = 7) -> RuleEnsemble:
    """labelled: FEATURES and label (0.0 or 1.0), doc_id. With one label or none, a constant score."""
    rows = labelled.where(F.col("label").isin(0.0, 1.0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = materialise(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label", *FEATURES))
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return RuleEnsemble((), (), math.log((n.get(1.0, 0) + 1) / (n.get(0.0, 0) + 1)))
    rows = rows.withColumn("weight", F.when(F.col("label") == 1.0, sum(n.values()) / (2 * n[1.0])).otherwise(sum(n.values()) / (2 * n[0.0])))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=seed, weightCol="weight", maxBins=64).fit(rows)
    found: set[Rule] = set()
    for tree in forest._java_obj.trees():
        _paths(tree.rootNode(), (), found)
    rules = sorted(found, key=lambda r: r.tests)
    truth = rows.select("label", "weight", *[r.column().cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    truth = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="truth").transform(truth)
    lasso = LogisticRegression(featuresCol="truth", weightCol="weight", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=100, tol=1e-5).fit(truth)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-9]
    return RuleEnsemble(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(lasso.intercept))


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, text_hash (xxhash64 of the text) for every row of docs.

    train: true for the rows of docs (by doc_id) whose labels may be learned from. labels: doc_id, quality; rows with a
    null id or another quality than 0 or 1 are ignored, several labels of one id all count. Texts that are null
    count as empty and get a score too. A text may have any length that a Spark string has, equal texts get equal scores, and
    repeated rows one each. An empty docs table gives an empty result; without labels all scores are 0.5.
    """
    stats = materialise(statistics(docs, text))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    model = fit(stats.where(train).join(known, "doc_id"), max_rows)
    score = model.score()
    out = stats.select("doc_id", (~train).alias("held_out"), score.alias("score"), "text_hash")
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "text_hash")
