"""Preference model: logistic regression by full-batch gradient descent, and its predictions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..config import Quiz
from ..functions.numbers import positive, saturate, sigmoid

_GRADES = ("resolution", "sharpness", "noise", "compression", "color", "exposure", "focus")


def features(form: str = "server") -> list[Column]:
    """Feature columns of a row; a missing grade counts as 50, a real zero as zero.

    ``server`` has 13 features; ``view`` adds distortion and megapixels and does not cap the file size.
    """
    def grade(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(50.0)) / 100.0

    grades = [grade(n) for n in _GRADES]
    if form == "view":
        grades.append(grade("distortion"))
    grades.append(grade("composite"))
    size = F.coalesce(F.col("size_kb"), F.lit(500)) / 5000.0
    tail = [
        saturate(F.coalesce(F.col("face_count"), F.lit(0)), 5.0),
        F.coalesce(F.col("has_target_face"), F.lit(False)).cast("double"),
        F.coalesce(1.0 - F.col("face_distance"), F.lit(0.5)),
        size if form == "view" else F.least(size, F.lit(1.0)),
    ]
    if form == "view":
        w, h = F.coalesce(F.col("width"), F.lit(1000)), F.coalesce(F.col("height"), F.lit(1000))
        tail.append(w.cast("double") * h / 20_000_000.0)
    tail.append((F.coalesce(F.col("media_type"), F.lit("image")) == "video").cast("double"))
    return [*grades, *tail]


@dataclass(frozen=True)
class PreferenceModel:
    """Coefficients; ``weights`` is None while there is too little feedback."""

    weights: tuple[float, ...] | None
    bias: float = 0.0
    form: str = "server"

    def probability(self) -> Column:
        """Chance of a like, null for an untrained model."""
        if self.weights is None:
            return F.lit(None).cast("double")
        terms = [f * w for f, w in zip(features(self.form), self.weights)]
        return sigmoid(reduce(lambda a, b: a + b, terms, F.lit(self.bias)))

    def with_quiz(self, quiz: Quiz) -> "PreferenceModel":
        """Shift the weights of the 15-feature form by questionnaire answers."""
        if self.weights is None:
            return self
        # Feature position and shift per answer.
        shifts = {
            ("sharpness", "high"): {1: 0.3, 6: 0.3},
            ("colorful", "yes"): {4: 0.4},
            ("faces", "many"): {9: 0.5},
            ("faces", "few"): {9: -0.3},
            ("closeups", "yes"): {11: 0.3},
            ("resolution", "high"): {0: 0.3, 13: 0.3},
            ("style", "candid"): {10: -0.2},
            ("style", "posed"): {10: 0.3},
        }
        moved = list(self.weights)
        for (question, answer), change in shifts.items():
            if getattr(quiz, question) == answer:
                for position, delta in change.items():
                    moved[position] += delta
        return PreferenceModel(tuple(moved), self.bias, self.form)


def train_preference(
    df: DataFrame, form: str = "server", rounds: int = 80, rate: float = 0.5, min_rated: int | None = None
) -> PreferenceModel:
    """Train on the rated rows.

    Equal feature rows are merged and kept in memory; every round is one pass whose tasks return one row of partial
    sums each, so only feature-count numbers reach the driver.
    """
    needed = min_rated if min_rated is not None else (5 if form == "view" else 3)
    rated = df.filter(F.col("preference").isin("like", "dislike"))
    columns = [f.cast("double") for f in features(form)]
    data = (
        rated.select(F.array(*columns).alias("x"), (F.col("preference") == "like").cast("double").alias("y"))
        .groupBy("x").agg(F.sum("y").alias("likes"), F.count("*").cast("double").alias("n"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        n = data.agg(F.sum("n")).first()[0] or 0
        if n < needed:
            return PreferenceModel(None, 0.0, form)
        # few rows need few tasks per round; at most 50,000 merged rows each
        packed = data.coalesce(int(min(n, 1e9) // 50_000) + 1)
        weights, bias = np.zeros(len(columns)), 0.0
        for _ in range(rounds):
            parts = packed.mapInArrow(_gradient(weights, bias), "part array<double>").collect()  # one row per task
            step = np.sum([r["part"] for r in parts], axis=0)
            weights, bias = weights - rate * step[:-1] / n, bias - rate * step[-1] / n
        return PreferenceModel(tuple(float(w) for w in weights), float(bias), form)
    finally:
        data.unpersist()


def _gradient(weights: np.ndarray, bias: float):
    """Partial sums of error times feature, and of the error, over the rows of a task."""

    def work(batches):
        total = np.zeros(len(weights) + 1)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            z = np.clip(x @ weights + bias, -10.0, 10.0)
            error = batch.column("n").to_numpy() / (1.0 + np.exp(-z)) - batch.column("likes").to_numpy()
            total[:-1] += error @ x
            total[-1] += error.sum()
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tolist()], type=pa.list_(pa.float64()))})

    return work


def predicted_preference(model: PreferenceModel) -> tuple[Column, Column]:
    """(score, exploration): -5..5 and 0..2; rated rows give (0, 0), an untrained model (0, 1)."""
    rated = F.coalesce(F.col("preference").isin("like", "dislike"), F.lit(False))
    p = model.probability()
    score = F.when(rated, 0.0).otherwise(F.coalesce((p - 0.5) * 10.0, F.lit(0.0)))
    confidence = F.abs(p - 0.5) * 2.0
    explore = positive(2.0 * (1.0 - confidence))
    return score, F.when(rated, 0.0).otherwise(F.coalesce(explore, F.lit(1.0)))


def predicted_label(model: PreferenceModel) -> tuple[Column, Column]:
    """(label, confidence) as shown in the selection view."""
    p = model.probability()
    label = F.when(p > 0.65, "like").when(p < 0.35, "dislike")
    return label, F.coalesce(F.floor(F.abs(p - 0.5) * 200 + 0.5), F.lit(0)).cast("int")
