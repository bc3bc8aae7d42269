"""Document quality by a regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian over the statistics, with its covariance shrunk towards its diagonal and the pooled
covariance.  A document's log-density difference is a difference of Mahalanobis distances, each got from the class's
Cholesky factor, which is inverted once; a one-dimensional logistic fit on the same rows turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.llm.common import crc_remainder
from exonloom.llm.labelled import labelled_sample

#: The statistics, in the order of statistics()'s result.
NAMES = ["log_words", "word_length", "distinct", "repeats", "upper", "digit", "symbol", "mark", "bar", "bang", "odd_ends", "lines", "same_lines", "long_words", "high"]
#: Labelled rows of each class that a fit takes at most.
MOST_LABELLED = 10_000


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)  # 0: other
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    for group, chars in ((4, b"#$%&*^~_@<>{}[]\\="), (5, b".,;:?'\"-()"), (6, b"|"), (7, b"!"), (8, b" \t\r\n\v\f")):
        kind[list(chars)] = group
    kind[128:] = 9
    return kind


KIND = _classes()
LETTERS = frozenset(range(ord("a"), ord("z") + 1)) | frozenset(range(128, 256)) | frozenset(b".,")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text; those of a text without words are finite as well."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n, size = len(words), max(1, len(raw))
    count = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=10) / size
    letters = max(1e-9, count[1] + count[2] + count[9])
    rate = lambda x, scale: float(np.log1p(scale * x))
    lines = raw.split(b"\n")
    odd = sum(w[-1] not in LETTERS for w in words)
    per = max(1, n)
    return [
        float(np.log1p(n)),
        float(np.log1p((size - count[8] * size) / per)),
        float(len(set(words)) / per**0.9),
        rate(sum(map(eq, words, words[1:])) / per, 50),
        rate(count[2] / letters, 20),
        rate(count[3], 50),
        rate(count[4], 50),
        rate(count[5], 50),
        rate(count[6], 50),
        rate(count[7], 50),
        rate(odd / per, 20),
        rate(len(lines) / per, 20),
        rate(1 - len(set(lines)) / len(lines), 10),
        rate(max(map(len, words), default=0), 0.1),
        float(count[9]),
    ]


@dataclass
class Discriminant:
    """Two Gaussians and a logistic link; ``fixed`` is the score of everything if only one class was seen."""

    means: np.ndarray | None = None  # class x statistic
    whiten: np.ndarray | None = None  # class x statistic x statistic: inverses of the Cholesky factors
    log_det: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    link: tuple[float, float] = (0.0, 1.0)
    fixed: float = 1.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, compressed so that far-out rows stay comparable."""
        z = (x - self.centre) / self.scale
        q = [((z - m) @ w.T) ** 2 for m, w in zip(self.means, self.whiten)]
        d = 0.5 * (q[0].sum(1) - q[1].sum(1) + self.log_det[0] - self.log_det[1])
        return np.arcsinh(d)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if self.means is None:
            return np.full(len(x), self.fixed)
        return 1 / (1 + np.exp(-np.clip(self.link[0] + self.link[1] * self.difference(x), -40, 40)))


def _logistic(d: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Intercept and slope of a ridge-penalised logistic fit, by Newton steps that are halved until the loss falls."""
    at = np.zeros(2)
    design = np.stack([np.ones_like(d), d], 1)
    loss = lambda t: np.logaddexp(0, -(2 * y - 1) * (design @ t)).sum() + 0.5 * ridge * (t @ t)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -40, 40)))
        g = design.T @ (p - y) + ridge * at
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), g)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(step).max() * size < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = 0.2, to_diagonal: float = 0.1, ridge: float = 1e-2) -> Discriminant:
    """Class means and shrunk covariances, then the link by Newton steps."""
    if len(set(y.tolist())) < 2 or min(np.bincount(y)) < 2:
        return Discriminant(fixed=float(np.mean(y)) if len(y) else 1.0)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - centre) / scale
    parts = [z[y == k] for k in (0, 1)]
    means = np.array([p.mean(0) for p in parts])
    own = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(c * len(p) for c, p in zip(own, parts)) / len(z)
    whiten, log_det = [], []
    for c in own:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + ridge * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    model = Discriminant(means, np.array(whiten), np.array(log_det), centre, scale)
    d = model.difference(x)
    low, high = d[y == 0].mean(), d[y == 1].mean()
    middle, unit = (low + high) / 2, max(abs(high - low) / 2, 1e-9)
    a, b = _logistic((d - middle) / unit, y)
    model.link = (a - b * middle / unit, b / unit)
    return model


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs = pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), xs], names=["label", "x"])


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_per_class: int = MOST_LABELLED, where=None) -> Discriminant:
    """A discriminant from at most ``most_per_class`` labelled documents of each class."""
    sample = labelled_sample(docs, labels, label_col, (most_per_class, most_per_class), id_col, text_col, where)
    rows = sample.select("label", "text").mapInArrow(_statistics_of, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r[0], r[1]))  # the sums' order, and so the model, must not depend on the tasks' order
    x = np.array([r[1] for r in rows], float).reshape(len(rows), len(NAMES))
    return fit(x, np.array([r[0] for r in rows], int))


def scored(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text", at: float = 0.7, keep: bool = False) -> DataFrame:
    """(id, score, predicted) for every row of ``docs``, or with ``keep`` the rows of ``docs`` that are predicted 1.

    ``score`` is the probability of label 1 by the whole text's statistics, ``predicted`` is 1 from ``at`` on.  A null
    text counts as empty, and an empty one is scored like any other.  No shuffle: ids may be null or repeat.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches):
        for texts in batches:
            x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(NAMES))
            yield known.value.score(x)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in scores(texts):
            yield pd.Series(s)

    value = score(F.col(f"`{text_col}`").cast("string"))
    if keep:
        return docs.filter(value >= at)
    out = docs.select(F.col(f"`{id_col}`"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= at).cast("int"))


def training_rows(of: int = 4, without: int = 2):
    """Condition on ids: crc32 of the id as text, modulo ``of``, is not ``without``."""
    return lambda doc: crc_remainder(doc, of) != without
