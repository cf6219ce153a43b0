"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance of the statistics, shrunk towards its diagonal and by a floor on the variances, so that a
statistic that is constant in one class still has a density. The score is the logistic of the difference of the two
log-densities (Mahalanobis distances through the cached Cholesky factors, log-determinants and log-priors).

Sums and cross-products of all labelled training rows are added up by Spark; only arrays of (number of statistics)^2 reach the driver. Scoring is a map.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.wordbpe import forget

#: Statistics of a text, in this order.
STATISTICS = (
    "log_words", "word_length", "repeat_next", "distinct", "top_word", "upper", "symbol_run", "symbols", "bars", "digits", "line_words", "stops",
    "worst_line_symbols", "worst_line_repeat",
)
SHRINK, FLOOR = 0.10, 0.02
CUT = 0.3

_RUN = re.compile(r"[^\w\s.,;:'\"()\-]{2,}")
_SYMBOL = re.compile(r"[^\w\s]")
_DIGIT = re.compile(r"\d")


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text; an empty text has them too."""
    words = text.split()
    n = len(words)
    lines = text.split("\n")
    repeats = sum(map(str.__eq__, words, words[1:]))
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if n else 0
    upper = sum(map(str.isupper, words))
    marked = sum(1 for w in words if not w[-1].isalnum() and _RUN.search(w))
    bars = counts.get("|", 0)
    letters = sum(map(len, words))
    symbols = len(_SYMBOL.findall(text))
    digits = len(_DIGIT.findall(text))
    stops = text.count(". ") + text.count(".\n") + text.endswith(".")
    worst_marked = worst_repeat = 0.0
    if marked or repeats or bars:
        for line in lines:
            w = line.split()
            if len(w) > 3:
                m = sum(1 for x in w if not x[-1].isalnum() and (x == "|" or _RUN.search(x)))
                worst_marked = max(worst_marked, m / (len(w) + 4))
                worst_repeat = max(worst_repeat, sum(map(str.__eq__, w, w[1:])) / (len(w) + 12))
    return [
        float(np.log1p(n)),
        float(np.log1p(letters / n if n else 0.0)),
        float(np.log(0.02 + repeats / (n + 8))),
        float(np.log(0.05 + len(counts) / max(1, n)) + 0.3 * np.log1p(n)),
        float(np.log(0.05 + top / (n + 10))),
        float(np.log(0.02 + upper / (n + 5))),
        float(np.log(0.02 + marked / (n + 4))),
        float(np.log(0.05 + symbols / (letters + 30))),
        float(np.log(0.02 + bars / (n + 4))),
        float(np.log(0.02 + digits / (letters + 60))),
        float(np.log1p(n / max(1, len(lines)))) * 0.5,
        float(np.log(0.05 + stops / (n + 5))),
        worst_marked,
        worst_repeat,
    ]


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): log-prior, mean, lower Cholesky factor of the covariance and its log-determinant; scale makes units alike."""

    scale: np.ndarray
    prior: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        x = x / self.scale
        density = []
        for k in (0, 1):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            density.append(self.prior[k] - 0.5 * self.log_det[k] - 0.5 * (z * z).sum(axis=0))
        gap = np.clip(density[1] - density[0], -60, 60)
        return np.round(1 / (1 + np.exp(-gap)), 9)


def _moments(batches):
    """Per class: number of rows, sums and cross-products of the statistics of what one task reads."""
    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, d)
        label = np.asarray(batch.column(1))
        for k in (0, 1):
            rows = x[label == k]
            total[k] += np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).reshape(-1)])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["label", "sums"])


def with_statistics(docs: DataFrame, *columns: str, text_col: str = "text") -> DataFrame:
    """The given columns and ``stats``, the statistics of each whole text (null: empty)."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        forget()
        for batch in batches:
            stats = [statistics(t) for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(stats, pa.list_(pa.float64()))], names=[*columns, "stats"])

    return docs.select(*[F.col(c) for c in columns], F.coalesce(F.col(text_col), F.lit("")).alias("_body")).mapInArrow(run, f"{kinds}, stats array<double>")


def training(doc_id) -> F.Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 5, is not 0. A row without an id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def moments(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, sums): counts, sums and cross-products of the statistics of labelled training rows, one row per task and class."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    rows = with_statistics(docs.where(training(F.col("doc_id"))), "doc_id")
    # never a broadcast: its tasks would run both Python functions, and every core would keep two workers for the rest of the session
    joined = rows.join(known.where(training(F.col("doc_id"))).hint("merge"), "doc_id").select("stats", "label")
    return joined.mapInArrow(_moments, "label int, sums array<double>")


def fit(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from every labelled training row. ``labels``: doc_id, quality (0 or 1; other values and nulls are not read; several labels of one id
    count as their smallest; rows of ``docs`` that share an id are rows of their own with its label). Without rows of a class, that class is taken to look like the other one, so scores follow the priors."""
    d = len(STATISTICS)
    summed = moments(docs, labels).select("label", F.posexplode("sums").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in summed:
        total[r["label"], r["k"]] = r["v"]
    n = total[:, 0]
    for k in (0, 1):
        if n[k] < 2:
            total[k] = total[1 - k] if n[1 - k] >= 2 else np.concatenate([[2], np.zeros(d), 2 * np.eye(d).reshape(-1)])
    size = total[:, 0]
    raw_mean = total[:, 1 : 1 + d] / size[:, None]
    raw_cov = total[:, 1 + d :].reshape(2, d, d) / size[:, None, None] - raw_mean[:, :, None] * raw_mean[:, None, :]
    pooled = total.sum(axis=0)
    middle = pooled[1 : 1 + d] / pooled[0]
    scale = np.sqrt(np.maximum(1e-6, np.diag(pooled[1 + d :].reshape(d, d) / pooled[0] - np.outer(middle, middle))))
    mean = raw_mean / scale
    factor, log_det = [], []
    for k in (0, 1):
        cov = raw_cov[k] / np.outer(scale, scale)
        cov = (1 - SHRINK) * cov + SHRINK * np.diag(np.diag(cov)) + FLOOR * np.eye(d)
        factor.append(np.linalg.cholesky(cov))
        log_det.append(2 * np.log(np.diag(factor[k])).sum())
    prior = np.log((n + 1) / (n.sum() + 2))
    return Discriminant(scale, prior, mean, np.array(factor), np.array(log_det))


def score(docs: DataFrame, model: Discriminant, *columns: str, text_col: str = "text") -> DataFrame:
    """The given columns of every row and its ``score``. Texts are read whole; an empty or null text gets a score as well."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        forget()
        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            x = np.array([statistics(t) for t in texts], dtype=float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(x))], names=[*columns, "score"])

    return docs.select(*[F.col(c) for c in columns], F.coalesce(F.col(text_col), F.lit("")).alias("_body")).mapInArrow(run, f"{kinds}, score double")


def keep_good(docs: DataFrame, model: Discriminant, text_col: str = "text") -> DataFrame:
    """Rows with a score of CUT or more, all columns as they were."""

    def run(batches):
        forget()
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text_col) if at is None else at
            x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()], dtype=float).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.scores(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)
