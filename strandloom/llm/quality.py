"""Text quality by regularised quadratic discriminant analysis of document statistics.

Each class has a normal density over transformed statistics of a document. Its covariance is shrunk towards the
pooled one, then towards a multiple of the identity. A score is the logistic of the difference of the two log
densities plus log priors; Mahalanobis distances use Cholesky factors that are inverted once per fit.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, map_batches, map_text, slices, stored

FEATURES = ("upper", "digit", "symbol", "stop", "bar", "bang", "high", "line", "length", "spread", "distinct", "again", "lines_again", "top", "size")
_UPPER, _DIGIT, _STOP = (np.frombuffer(x, np.uint8) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:"))
_SYMBOL = np.frombuffer(b"#$%&*+/<=>@\\^_`{}~", np.uint8)
#: Added to shares before the logarithm, so that rare and absent lie close together.
EPS = 2e-3
#: Characters and words added to what a share is of, so that the statistics of short texts lie near one another.
CHARS, WORDS = 60, 10


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one whole text; null counts as empty."""
    text = text or b""
    n = len(text)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    counts = Counter(words)
    share = lambda k, of, more, eps=EPS: float(np.log(eps + k / (of + more)))  # noqa: E731  short texts give weak evidence of a share
    triples = max(0, len(words) - 2)
    again = triples - len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = np.fromiter(map(len, words), np.float64, len(words))
    mean = (size.sum() + CHARS) / (len(words) + WORDS)
    spread = (((size - mean) ** 2).sum() + WORDS * 9.0) / (len(words) + WORDS)
    return [
        *(share(c[k].sum(), n, CHARS) for k in (_UPPER, _DIGIT, _SYMBOL, _STOP)), share(c[124], n, CHARS), share(c[33], n, CHARS), share(c[128:].sum(), n, CHARS),
        share(c[10], len(words), WORDS), float(np.log(mean)), float(np.log(spread)), float(np.log((len(counts) + WORDS) / (len(words) + WORDS))), share(again, triples, WORDS, 10 * EPS), share(len(lines) - len(set(lines)), len(lines), 3, 50 * EPS), share(max(counts.values(), default=0), len(words), WORDS), float(np.log(n + CHARS)),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means, inverted Cholesky factors and log weights (prior less half the log determinant) of classes 0 and 1."""

    mean: np.ndarray
    factor: np.ndarray
    weight: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        d = [self.weight[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -700, 700)))


def fit(n: np.ndarray, total: np.ndarray, outer: np.ndarray, pool: float = 0.2, ridge: float = 0.05) -> Discriminant:
    """From the counts, sums and summed outer products of both classes; a class without rows takes the pooled moments."""
    d = total.shape[1]
    every = max(n.sum(), 1.0)
    centre = total.sum(axis=0) / every
    mean = np.array([total[k] / n[k] if n[k] else centre for k in (0, 1)])
    own = [outer[k] / n[k] - np.outer(mean[k], mean[k]) if n[k] else np.zeros((d, d)) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / every
    scale = np.diag(pooled).copy()
    scale[scale < 1e-9] = 1e-4  # a statistic without spread
    factors, weights = [], []
    for k in (0, 1):
        # the identity that shrinkage goes to is that of the standardised statistics
        cov = (1 - pool) * own[k] + pool * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(scale * max(1e-3, (np.diag(cov) / scale).mean()))
        chol = np.linalg.cholesky(cov + 1e-9 * np.diag(scale))
        factors.append(np.linalg.inv(chol))
        weights.append(np.log((n[k] + 1) / (every + 2)) - np.log(np.diag(chol)).sum())
    return Discriminant(mean, np.array(factors), np.array(weights))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and outer products by class of rows (x array<double>, label int): partial sums in tasks, 2 (1 + d + d^2) numbers to the driver."""
    d = len(FEATURES)

    def run(batches):
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)
                y = b.column(1).to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    own = x[y == k]
                    sums[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(sums))], names=["label", "sums"])

    parts = rows.select("x", F.col("label").cast("int")).mapInArrow(run, "label int, sums array<double>")
    out = np.zeros((2, 1 + d + d * d))
    for r in parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("v")).collect():
        out[r["label"], r["pos"]] = r["v"]
    return out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(2, d, d)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x): the statistics of each row, stored."""

    def made(_, texts):
        x = np.array([statistics(t) for t in texts]).reshape(-1)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(FEATURES), pa.int32()), pa.array(x))]

    return stored(map_text(docs, key, text, made, "x array<double>", binary=True), "statistics")


def learned(seen: DataFrame, labels: DataFrame, key: str, label: str) -> Discriminant:
    """The classifier fitted on the labelled rows of measured() that aren't held out."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).select(key, F.col(label).cast("int").alias("label")).distinct()
    return fit(*moments(join_checked(seen, stored(known, "labels"), key)))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", *, label: str = "quality", cut: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) for each row of docs; one pass over the texts.

    Fitted on every labelled row whose crc32(key) mod 5 is not 0; labels that are null or neither 0 nor 1 are left
    out, a key labelled both ways counts for both. Null and empty texts have a score as any other; without any
    labels the score is 0.5. A null key is not held out and has no label. Repeated rows stay, long texts are read whole,
    an empty table gives an empty result; other columns play no part.
    """

    seen = measured(docs, key, text)
    model = learned(seen, labels, key, label)

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=[key, "score"])

    scored = seen.select(key, "x").mapInArrow(run, f"`{key}` {seen.schema[key].dataType.simpleString()}, score double")
    return scored.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", *, label: str = "quality", cut: float = 0.3) -> DataFrame:
    """The rows of docs that classify() accepts, each by its own text, with all columns; repeated rows and null keys too.

    Null, empty and long texts have a score as any other; without labels all rows stay; an empty table stays empty.
    Statistics are made twice, for the fit and for the filter: that costs less than a join, which would shuffle texts.
    """
    model = learned(measured(docs, key, text), labels, key, label)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in slices(batch, place):
                x = np.array([statistics(t and t.encode()) for t in part.column(place).to_pylist()]).reshape(-1, len(FEATURES))
                yield part.filter(pa.array(model.score(x) >= cut))

    return map_batches(docs, run, docs.schema)
