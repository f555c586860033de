"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier of letter n-grams predicts
each bit. Decoding adds up, for each codeword, the losses of its bits, weighted
by how reliably a bit's classifier tells that language; the least sum wins. A
text whose two best codewords lie close together is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import bounded_sample, has_letter, letter_gram_counts, scored
from .tables import held_out, table

DIMS = 4096
#: Labelled texts per language that the classifiers are fitted on, at most, and of all languages together.
FIT_ROWS, FIT_TOTAL = 600, 12_000
UNKNOWN = "und"
#: Scores below are ambiguous whatever was measured: the two best codewords are as near as equal.
NEAR = 0.01
#: So many more held-back texts must be told wrong than right before a score counts as ambiguous.
EXCESS = 4


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """(languages, bits) of -1 and 1: every split of up to 5 languages, else the best spread of random codes."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 5:
        masks = [m for m in range(1, 1 << n) if not m & 1]  # language 0 is -1 in each: no complements
        return np.array([[1 if m >> i & 1 else -1 for m in masks] for i in range(n)], np.int8)
    bits = int(np.ceil(10 * np.log2(n)))
    rng, best, best_distance = np.random.default_rng(seed), None, -1
    for _ in range(int(np.clip(4_000_000 // n**2, 1, 200))):
        code = rng.choice(np.array([-1, 1], np.int8), size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]  # a bit that all languages share says nothing
        wide = code.astype(np.float32)
        far = (code.shape[1] - wide @ wide.T) / 2  # Hamming distances
        distance = far[np.triu_indices(n, 1)].min()
        if distance > best_distance:
            best, best_distance = code, distance
    return best


def fit_bits(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 20.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic classifiers of the columns of y (-1, 1), every class of a column weighted alike; last row is the bias."""
    x = np.hstack([x, np.full((len(x), 1), 0.3, np.float32)])
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    speed = np.zeros_like(w)
    weight = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(axis=0), 1), 0.5 / np.maximum((y < 0).sum(axis=0), 1))
    for _ in range(rounds):
        margin = y * (x @ w)
        gradient = x.T @ (-y * weight / (1 + np.exp(np.clip(margin, -30, 30)))).astype(np.float32)
        speed = 0.9 * speed - rate * (gradient + decay * w)
        w = w + speed
    return w


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    reliability: np.ndarray  # (languages, bits), rows add up to 1
    undecided: float = NEAR  # scores below are ambiguous

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + 0.3 * self.weights[-1]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each row of features."""
        margin = np.clip(self.margins(x), -8, 8)
        loss = np.log1p(np.exp(-margin[:, None, :] * self.code[None, :, :])) * self.reliability[None, :, :]
        loss = loss.sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        if loss.shape[1] == 1:
            return best, np.ones(len(x))
        near = np.take_along_axis(loss, order[:, :2], axis=1)
        return best, (near[:, 1] - near[:, 0]) / np.maximum(near[:, 1] + near[:, 0], 1e-12)


def least_reliable(score: np.ndarray, right: np.ndarray, excess: int = 0) -> float:
    """The greatest score below which texts that were not fitted on are told wrong as often as right, and ``excess`` times more.

    0 if there is none. Without an excess, a few texts of a small sample would decide for many of the corpus.
    """
    order = np.argsort(score, kind="stable")
    wrong = np.cumsum(~right[order])
    bad = np.flatnonzero(2 * wrong >= np.arange(1, len(order) + 1) + excess)
    return float(np.nextafter(score[order][bad[-1]], 1)) if len(bad) else 0.0


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, dims: int = DIMS, total: int = FIT_TOTAL) -> Model | None:
    """A model of at most ``fit_rows`` texts of each language and some ``total`` in all, from rows that are not held out."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & has_letter())
    sample = bounded_sample(known, F.col("lang"), fit_rows, total)

    def features(texts):
        x = letter_gram_counts(texts, dims)
        return [pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())]

    rows = scored(sample, ["label"], "x binary", features).toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["label", "x"], kind="stable")
    languages = sorted(rows["label"].unique())
    x = np.stack([np.frombuffer(v, np.float16) for v in rows["x"]]).astype(np.float32)
    at = rows["label"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    code = codewords(len(languages))
    y = code[at].astype(np.float32)
    # A bit's reliability for a language is its accuracy on texts it was not fitted on.
    part = np.arange(len(x)) % 4 == 0
    tried = 0 < part.sum() < len(x)
    if tried:
        trial = fit_bits(x[~part], y[~part])
        right = (x[part] @ trial[:-1] + 0.3 * trial[-1]) * y[part] > 0
        seen = at[part]
    else:
        right, seen = np.ones_like(y, bool), at
    reliability = np.full(code.shape, 1e-3)
    for i in range(len(languages)):
        if (seen == i).any():
            reliability[i] += right[seen == i].mean(axis=0)
        else:
            reliability[i] += 1
    reliability /= reliability.sum(axis=1, keepdims=True)
    undecided = NEAR
    if tried:
        best, score = Model(languages, code, trial, reliability).decode(x[part])
        undecided = max(NEAR, least_reliable(score, best == seen, EXCESS))
    return Model(languages, code, fit_bits(x, y), reliability, undecided)


def predict(docs: DataFrame, model: Model | None, columns: list[str], dims: int = DIMS) -> DataFrame:
    """``columns`` of the rows of ``docs`` with lang_pred, score (0 to 1) and ambiguous.

    A text that is null or has no letter, or a model of no language, gives
    ``und``, 0 and true. The score is 0 where the two best codewords are equally
    near, and grows towards 1 with the distance between them. Ambiguous are scores below ``NEAR``, and those with which labelled
    texts, held back while the model was fitted, were told wrong more often than right. A column with the name of a result is left out.
    """

    def score(texts):
        if model is None:
            best, value = np.zeros(len(texts), int), np.zeros(len(texts))
        else:
            best, value = model.decode(letter_gram_counts(texts, dims))
        names = pa.array(model.languages if model else [UNKNOWN], pa.string())
        return [names.take(pa.array(best)), pa.array(np.clip(value, 0, 1).astype(np.float64))]

    letter = F.col("letter") & F.lit(model is not None)
    value = F.when(letter, F.col("value")).otherwise(0.0)
    results = {
        "lang_pred": F.when(letter, F.col("lang_told")).otherwise(UNKNOWN),
        "score": value,
        "ambiguous": ~letter | (value < (model.undecided if model else 1.0)),
    }
    return scored(docs, columns, "lang_told string, value double", score, {"letter": has_letter()}, results)


def identify(docs: DataFrame, labelled: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """Predict the language of every whole text, learning from ``labelled`` (``docs`` by default).

    Repeated rows are predicted alike; null ids are kept and learnt from; an
    empty table gives no rows; columns that are not asked for are ignored.
    """
    return predict(docs, fit(docs if labelled is None else labelled), columns or ["doc_id"])


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out: see ``identify``."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    found = predict(docs.select("doc_id", "text", "held_out"), fit(docs), ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
