"""Operator 5: toxicity by FTRL-proximal logistic regression over hashed n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from panelkit.llm.common import few_smallest, in_fold, slices
from panelkit.llm.units import release

TOKENS = re.compile(r"\w+").findall
#: Odd multipliers that tell the features of a word, its beginnings, pairs and skip pairs apart.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], "u8")
#: Beginnings of words (in letters) that count as words of their own: they join inflected forms.
STEMS = (3, 4, 5, 6)
MEMO = 150_000


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.5
    epochs: int = 5
    #: Bound on the labelled rows that the fit uses: those with the smallest hash of their id.
    max_rows: int = 20_000
    seed: int = 5


class Features:
    """Hashed features of a text: words, their beginnings, word pairs and pairs that skip one."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 1 + len(STEMS)), "u8")

    def _number(self, word: str) -> int:
        n = len(self.known)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        begun = [word[:k] if len(word) > k else word for k in STEMS]
        self.table[n] = [xxh3_64_intdigest(word, 0)] + [
            xxh3_64_intdigest(w, k) for k, w in zip(STEMS, begun)
        ]
        self.known[word] = n
        return n

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct feature numbers, ascending."""
        words = TOKENS((text or "").lower())
        if not words:
            return np.empty(0, "i8")
        if len(self.known) > MEMO:
            self.known.clear()
        get, number = self.known.get, self._number
        at = [n if (n := get(w)) is not None else number(w) for w in words]
        at = np.array(at)
        rows = self.table[np.unique(at)]
        word = self.table[at, 0]
        with np.errstate(over="ignore"):
            parts = [(rows * MIX[0]).ravel()]
            parts.append(word[:-1] * MIX[1] + word[1:] * MIX[0])
            parts.append(word[:-2] * MIX[2] + word[2:] * MIX[3])
        return np.unique((np.concatenate(parts) >> self.shift).astype("u4")).astype("i8")


def ftrl(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights after ``epochs`` passes, and the bias.

    Every coordinate has its own learning rate, from the squares of its own gradients; the L1 term
    leaves a weight at exactly 0 until its gradients say enough. The bias has no penalty."""
    size = 1 << s.bits
    z, n = np.zeros(size), np.zeros(size)
    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
    bias, bias_n = float(np.log(rate / (1 - rate))), 0.0
    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            x, y = rows[i], labels[i]
            zi, root = z[x], np.sqrt(n[x])
            w = np.where(
                np.abs(zi) <= s.l1, 0.0, (np.sign(zi) * s.l1 - zi) / ((s.beta + root) / s.alpha + s.l2)
            )
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            new = np.sqrt(n[x] + g * g)
            z[x] += g - (new - root) / s.alpha * w
            n[x] += g * g
            bias_n += g * g
            bias -= 0.05 * g / (1.0 + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    return w, bias


@dataclass(frozen=True)
class Model:
    """Non-zero weights (feature numbers ascending): at most 2 ** bits, in practice some thousands."""

    bits: int
    numbers: np.ndarray
    weights: np.ndarray
    bias: float


def fit(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int | None = 5,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Learn from labelled rows outside the held-out fold (``folds`` None: from all).

    One task fits over at most ``settings.max_rows`` rows and returns the non-zero weights. Rows
    with several labels count once per label; without any labelled row the score is 0.5 for all."""
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("double").alias("y"))
    known = known.filter("y is not null and key is not null")
    if folds:
        known = known.filter(~in_fold("key", folds, 0))
    # the ids of the sample: at most max_rows narrow rows
    placed = few_smallest(known.withColumn("place", F.xxhash64("key")), "place", settings.max_rows)
    chosen = placed.orderBy("place", "key", "y").limit(settings.max_rows).drop("place")
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "key"
    )
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("key"), "key", "y", F.xxhash64("text"))

    def run(batches):
        release()
        features, xs, ys = Features(settings.bits), [], []
        for b in batches:
            for some in slices(b):
                made = [features(t).astype("i4") for t in some["text"].to_pylist()]
                # One block for all of them: large blocks go back to the system when the task ends.
                block = np.concatenate(made)
                xs += np.split(block, np.cumsum([len(x) for x in made])[:-1])
                ys += some["y"].to_pylist()
        w, bias = ftrl(xs, np.array(ys, "float64"), settings)
        on = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(on, -1)), pa.array(np.append(w[on], bias))], ["number", "weight"]
        )

    got = one.mapInArrow(run, "number long, weight double").collect()
    found = sorted((r.number, r.weight) for r in got if r.number >= 0)
    return Model(
        settings.bits,
        np.array([n for n, _ in found], "i8"),
        np.array([w for _, w in found], "f8"),
        next((r.weight for r in got if r.number < 0), 0.0) if got else 0.0,
    )


class Scorer:
    def __init__(self, model: Model):
        self.features = Features(model.bits)
        self.weights = np.zeros(1 << model.bits, "f4")
        self.weights[model.numbers] = model.weights
        self.bias = model.bias

    def __call__(self, text: str | None) -> float:
        total = float(self.weights[self.features(text)].sum()) + self.bias
        return 1.0 / (1.0 + np.exp(-min(max(total, -35.0), 35.0)))


def score(spark: SparkSession, model: Model, text_col: str = "text") -> Column:
    """Column with the score of a whole text; null and empty texts get the score of the bias."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pa.array([scorer(t) for some in slices(texts) for t in some.to_pylist()], pa.float64())

    return scored(F.col(text_col))


def toxicity(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(),
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """Score every text: id, ``held_out``, ``score``, ``predicted``. Labels, and columns other than
    the text, never enter a score. Repeated rows stay; an empty table gives no rows."""
    model = fit(docs, labels, settings, 5, id_col, text_col, label_col)
    out = docs.select(
        F.col(id_col), in_fold(id_col, 5, 0).alias("held_out"),
        score(docs.sparkSession, model, text_col).alias("score"),
    )
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
