"""Quality scores by regularised quadratic discriminant analysis.

Each text becomes a few transformed statistics. Spark sums them and their
products for each class over the labelled rows; the class covariances are shrunk
towards the pooled one and a multiple of the identity, and a score is the
difference of the Mahalanobis log densities, from Cholesky factors made once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import labelled_sample, scored
from .tables import held_out, table
from .textops import WORD, Texts, chunks, grams

#: Labelled texts of each class that the model is fitted on, at most: their ids are broadcast.
FIT_ROWS = 20_000
#: Weight of the pooled covariance, and of the identity, in each class's own.
POOLED, IDENTITY = 0.1, 0.02
#: Scores from here on are predicted as good quality.
GOOD_FROM = 0.7
#: A class with fewer rows has no covariance of its own.
LEAST_ROWS = 5

STATISTICS = (
    "log_words",
    "word_bytes",
    "word_bytes_spread",
    "upper_share",
    "digit_share",
    "sign_share",
    "odd_sign_share",
    "non_ascii_share",
    "signs_at_word_end",
    "one_sign_words",
    "repeated_next_word",
    "distinct_words",
    "distinct_pairs",
    "commonest_word",
    "line_length",
)


def _per_row(texts: Texts, mask: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask marks."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[texts.offsets[1:]] - total[texts.offsets[:-1]]).astype(float)


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different values of each row, and how often its commonest one occurs."""
    distinct, most = np.zeros(n), np.zeros(n)
    if not len(h):
        return distinct, most
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
    counts = np.diff(np.concatenate([new, [len(h)]]))
    np.add.at(distinct, row[new], 1)
    np.maximum.at(most, row[new], counts)
    return distinct, most


def _logit(share: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A smoothed log odds of a count among ``of``."""
    return np.log((share + 0.5) / (np.maximum(of - share, 0) + 0.5))


def statistics(texts: Texts) -> np.ndarray:
    """(texts, STATISTICS) of whole texts; all are finite, of empty texts too."""
    n, data = len(texts), texts.data
    size = np.diff(texts.offsets).astype(float)
    words = texts.words(WORD)
    h, row = words.hashes(), words.row
    count = np.diff(words.bounds).astype(float)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(row, length, n) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, n) / np.maximum(count, 1) - mean**2, 0))
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    wide = data >= 128
    sign = ~(upper | lower | digit | wide) & WORD[data]
    plain = sign & np.isin(data, np.frombuffer(b".,;:'\"?()-", np.uint8))
    letters = _per_row(texts, upper | lower)
    last = data[np.maximum(words.end - 1, 0)] if len(data) else np.empty(0, np.uint8)
    first = data[words.start] if len(data) else np.empty(0, np.uint8)
    before_last = data[np.maximum(words.end - 2, 0)] if len(data) else np.empty(0, np.uint8)
    is_sign = np.zeros(256, bool)
    is_sign[:128] = True
    is_sign[48:58] = is_sign[65:91] = is_sign[97:123] = False
    ends = is_sign[last] & (is_sign[before_last] | ~np.isin(last, np.frombuffer(b".,", np.uint8))) & (length > 1)
    lone = is_sign[first] & (length == 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    different, commonest = _distinct(row, h, n)
    pair, at = grams(h, row, 2)
    pairs = np.bincount(row[at], minlength=n).astype(float)
    different_pairs, _ = _distinct(row[at], pair, n)
    lines = _per_row(texts, data == 10) + 1
    return np.column_stack(
        [
            np.log1p(count),
            np.log1p(mean),
            np.log1p(spread),
            _logit(_per_row(texts, upper), letters),
            np.log1p(100 * _per_row(texts, digit) / np.maximum(size, 1)),
            np.log1p(100 * _per_row(texts, sign) / np.maximum(size, 1)),
            np.log1p(100 * _per_row(texts, sign & ~plain) / np.maximum(size, 1)),
            np.log1p(100 * _per_row(texts, wide) / np.maximum(size, 1)),
            np.log1p(100 * np.bincount(row, ends, n) / np.maximum(count, 1)),
            np.log1p(100 * np.bincount(row, lone, n) / np.maximum(count, 1)),
            np.log1p(100 * np.bincount(row, same, n) / np.maximum(count, 1)),
            np.log1p(count) - np.log1p(different),
            np.log1p(pairs) - np.log1p(different_pairs),
            np.log1p(100 * commonest / np.maximum(count, 1)),
            np.log1p(count / lines),
        ]
    )


@dataclass
class Model:
    mean: np.ndarray  # of all statistics, and their scale: what the classes are standardised by
    scale: np.ndarray
    centres: list[np.ndarray]
    factors: list[np.ndarray]  # Cholesky factors of the class covariances, inverted once
    priors: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes), up to a constant."""
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        out = []
        for centre, factor in zip(self.centres, self.factors, strict=True):
            z = factor @ (x - centre).T
            out.append(-0.5 * (z**2).sum(axis=0) + np.log(np.diag(factor)).sum())
        return np.column_stack(out)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the second class."""
        logs = self.log_densities(x) + np.log(self.priors)
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def shrunk(cov: np.ndarray, pooled: np.ndarray, a: float = POOLED, b: float = IDENTITY) -> np.ndarray:
    """(1 - a - b) cov + a pooled + b (mean variance) I."""
    return (1 - a - b) * cov + a * pooled + b * np.trace(pooled) / len(pooled) * np.eye(len(pooled)) + 1e-6 * np.eye(len(pooled))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model of at most ``fit_rows`` rows of each value of ``labels.quality``; None if a class is missing.

    Held-out rows are not learnt from. Each task adds up its rows; only these
    sums, of a size that does not depend on the data, reach the driver. A row
    labelled twice counts with its lower label.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = labelled_sample(docs, known, F.when(F.col("quality") > 0, 1).otherwise(0), fit_rows)
    p = len(STATISTICS)

    def sums(batches):
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            quality = np.asarray(batch.column("label")) > 0
            for texts in chunks(batch.column("text")):
                # On this grid all sums are exact, and so do not depend on the order in which tasks end.
                x = np.round(statistics(texts) * 4096) / 4096
                which = quality[texts.first : texts.first + len(texts)]
                for c in (0, 1):
                    v = x[which == c]
                    total[c] += np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).reshape(-1)])
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"c": [0, 1], "v": list(total)}))

    summed = rows.mapInArrow(sums, "c long, v array<double>")
    flat = summed.select("c", F.posexplode("v").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v"))
    got = flat.toPandas()
    total = np.zeros((2, 1 + p + p * p))
    total[got["c"], got["i"]] = got["v"]
    n = total[:, 0]
    if (n == 0).any():
        return None
    means = total[:, 1 : 1 + p] / n[:, None]
    seconds = total[:, 1 + p :].reshape(2, p, p)
    mean = total[:, 1 : 1 + p].sum(axis=0) / n.sum()
    variance = np.diag(seconds.sum(axis=0)) / n.sum() - mean**2
    scale = np.sqrt(np.maximum(variance, 1e-8))
    centres = (means - mean) / scale
    covs = [seconds[c] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    covs = [x / np.outer(scale, scale) for x in covs]
    pooled = sum(n[c] * covs[c] for c in (0, 1)) / n.sum()
    covs = [covs[c] if n[c] >= LEAST_ROWS else pooled for c in (0, 1)]
    factors = [np.linalg.inv(np.linalg.cholesky(shrunk(x, pooled))) for x in covs]
    return Model(mean, scale, list(centres), factors, n / n.sum())


def predict(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """``columns`` with score (0 to 1) and predicted (1 from ``GOOD_FROM`` on). Without a model the score is 0.5.

    A column with the name of a result is left out.
    """

    def score(texts):
        value = np.full(len(texts), 0.5) if model is None else model.score(statistics(texts))
        return [pa.array(value), pa.array((value >= GOOD_FROM).astype(np.int32))]

    return scored(docs, columns, "score double, predicted int", score)


def score_documents(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Score every whole text, learning from ``labels`` (doc_id, quality) of the rows that are not held out.

    Null and empty texts are scored as texts without words. Repeated rows are
    scored alike; null ids are kept; an empty table gives no rows; columns that
    are not asked for are ignored.
    """
    return predict(docs, fit(docs, labels), columns or ["doc_id"])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from labels that are not held out: see ``score_documents``."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = fit(docs, table(spark, sf_dir, "labels"))
    return predict(docs.select("doc_id", "text", "held_out"), model, ["doc_id", "held_out"])
