"""Toxicity grades by cumulative-link ordinal regression.

P(grade > j) = sigmoid(w . x - threshold_j): one weight vector for all grades and
ordered thresholds. Features are sparse: words and word beginnings (hashed) that
the labelled sample tells apart, each by the logarithm of how often it occurs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import Known, labelled_sample, scored, word_features
from .tables import held_out, table
from .textops import Texts

#: Labelled texts of each label that the model is fitted on, at most.
FIT_ROWS = 2500
#: The log likelihood ratio that a feature needs.
EVIDENCE = 10.0
#: Grades: none, mild, serious, severe.
GRADES = 4
#: Expected severity from which a text counts as toxic.
TOXIC_FROM = 0.5


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def sums(self, texts: Texts, known: Known) -> np.ndarray:
        """w . x of each text."""
        row, at, counts = word_features(texts, known)
        return np.bincount(row, self.weights[at] * np.log1p(counts), len(texts))

    def above(self, sums: np.ndarray) -> np.ndarray:
        """(texts, grades - 1): the probability of a grade above j."""
        return 1 / (1 + np.exp(-np.clip(sums[:, None] - self.thresholds[None, :], -40, 40)))


def grade_labels(toxic: np.ndarray, strength: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Ordinal grades from a 0/1 label: 0, or 1..grades-1 by thirds of how strongly labelled features occur."""
    out = np.zeros(len(toxic), int)
    positive = np.flatnonzero(toxic > 0)
    if len(positive):
        cuts = np.quantile(strength[positive], np.linspace(0, 1, grades)[1:-1])
        out[positive] = 1 + np.searchsorted(cuts, strength[positive], side="right")
    return out


def fit_ordinal(
    x: list[tuple[np.ndarray, np.ndarray]],
    grade: np.ndarray,
    dims: int,
    grades: int,
    toxic_share: float | None = None,
    rounds: int = 400,
    ridge: float = 1e-3,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the likelihood of ``grade``; x has (feature, value) of each text.

    ``toxic_share`` is that of all labelled texts, however many of each label the sample has (by default its own).

    The gradient is spread over the sparse entries; thresholds are a first one
    and positive steps, so they stay in order.
    """
    row = np.repeat(np.arange(len(x)), [len(a) for a, _ in x])
    col = np.concatenate([a for a, _ in x] or [np.empty(0, int)]).astype(int)
    val = np.concatenate([b for _, b in x] or [np.empty(0)])
    w = np.zeros(dims)
    first, steps = 1.0, np.zeros(grades - 2)
    y = (grade[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    toxic_share = (grade > 0).mean() if toxic_share is None else toxic_share
    share = np.where(grade > 0, toxic_share / max((grade > 0).sum(), 1), (1 - toxic_share) / max((grade == 0).sum(), 1))
    moments = [np.zeros(dims + grades - 1), np.zeros(dims + grades - 1)]
    for t in range(1, rounds + 1):
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
        s = np.bincount(row, w[col] * val, len(x))
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - thresholds[None, :], -40, 40)))
        error = (p - y) * share[:, None]
        dw = np.bincount(col, error.sum(axis=1)[row] * val, dims) + ridge * w / len(w)
        dt = -error.sum(axis=0)
        dsteps = np.array([dt[j + 1 :].sum() * np.exp(steps[j]) for j in range(grades - 2)])
        g = np.concatenate([dw, [dt.sum()], dsteps])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = 0.05 * moments[0] / (1 - 0.9**t) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-9)
        w, first, steps = w - move[:dims], first - move[dims], steps - move[dims + 1 :]
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, grades: int = GRADES) -> Model | None:
    """A model of at most ``fit_rows`` texts of each value of ``labels.toxic``; None without both values.

    Held-out rows are not learnt from. A row labelled twice with different
    values counts as toxic.
    """
    known_labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known_labels = known_labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = labelled_sample(docs, known_labels, F.when(F.col("toxic") > 0, 1).otherwise(0), fit_rows)

    def features(batch):
        row, h, n = word_features(batch)
        low = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
        lists = [pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))]
        return [pa.ListArray.from_arrays(pa.array(low), x) for x in lists]

    rows = scored(texts, ["label"], "h array<long>, n array<int>", features)
    # Features of one text only prove nothing: they never reach the driver.
    flat = rows.select("label", F.explode(F.array_distinct("h")).alias("h"))
    common = flat.groupBy("h").agg(F.count("*").alias("n"), F.sum("label").alias("k")).where("k >= 5 or n - k >= 5")
    total = rows.agg(F.count("*"), F.sum("label")).first()
    n, k = int(total[0]), int(total[1] or 0)
    if not 0 < k < n:
        return None
    odds = F.log((F.col("k") + 0.5) / (k + 1)) - F.log((F.col("n") - F.col("k") + 0.5) / (n - k + 1))
    # Twice the log likelihood ratio of the feature's own share of toxic texts to that of all.
    clean = F.col("n") - F.col("k")
    part = lambda x, share: F.when(x > 0, x * F.log(x / F.col("n") / share)).otherwise(0.0)
    evidence = 2 * (part(F.col("k"), k / n) + part(clean, (n - k) / n))
    kept = common.where(evidence >= EVIDENCE).select("h", odds.alias("z")).toPandas()  # no more than the fitted texts hold
    if not len(kept):
        return None
    h = kept["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    vocabulary, z = h[order], kept["z"].to_numpy()[order]
    known = Known(vocabulary)

    def sparse(batch):
        row, at, n = word_features(batch, known)
        value = np.log1p(n)
        low = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
        lists = [pa.array(at.astype(np.int32)), pa.array(value)]
        return [pa.ListArray.from_arrays(pa.array(low), x) for x in lists]

    # At most 2 * fit_rows texts of at most as many entries as there are features.
    fitted = scored(texts.withColumn("h", F.xxhash64("text")), ["h", "label"], "at array<int>, x array<double>", sparse).toPandas()
    fitted = fitted.sort_values(["label", "h"], kind="stable")
    x = [(np.array(a, int), np.array(v, float)) for a, v in zip(fitted["at"], fitted["x"], strict=True)]
    toxic = fitted["label"].to_numpy()
    strength = np.array([np.maximum(z[a], 0) @ v for a, v in x])
    grade = grade_labels(toxic, strength, grades)
    share = known_labels.agg(F.avg((F.col("toxic") > 0).cast("int"))).first()[0]
    weights, thresholds = fit_ordinal(x, grade, len(vocabulary), grades, share)
    return Model(vocabulary, weights, thresholds)


def predict(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """``columns`` with severity (expected grade), grade (the likeliest) and toxic.

    A text without a feature (a null or empty one too) has the severity that the fitted thresholds give it; without a
    model all are 0. A column with the name of a result is left out.
    """

    known = Known(model.features) if model else None

    def score(texts):
        sums = np.zeros(len(texts)) if model is None else model.sums(texts, known)
        above = np.zeros((len(texts), GRADES - 1)) if model is None else model.above(sums)
        exact = np.hstack([np.ones((len(texts), 1)), above]) - np.hstack([above, np.zeros((len(texts), 1))])
        severity = above.sum(axis=1)
        return [pa.array(severity), pa.array(exact.argmax(axis=1).astype(np.int32)), pa.array(severity >= TOXIC_FROM)]

    return scored(docs, columns, "severity double, grade int, toxic boolean", score)


def grade_documents(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Grade every whole text, learning from ``labels`` (doc_id, toxic) of the rows that are not held out.

    Repeated rows are graded alike; null ids are kept; an empty table gives no
    rows; columns that are not asked for are ignored.
    """
    return predict(docs, fit(docs, labels), columns or ["doc_id"])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, severity, grade and toxic of every document."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = fit(docs, table(spark, sf_dir, "labels"))
    return predict(docs.select("doc_id", "text", "held_out"), model, ["doc_id", "held_out"])
