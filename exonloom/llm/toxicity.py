"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - t_k) with one weight vector w for all ordered thresholds t_1 <= t_2 <= ...; the output
is the expected severity, the sum of those probabilities.  Features are the distinct words of a text (runs of ASCII
letters and digits and of all non-ASCII characters, A-Z lower-cased) and their prefixes of 4 to 6 bytes, which carry
over to inflected and coined forms.

The labels say only toxic or not; nothing in the tables grades toxic documents.  The first threshold is fitted to the
labels.  For the higher ones, words fall into two halves by a hash of their first bytes, so that no feature is in both:
a toxic document's grade from 1 to ``grades`` is told by how many telling words of one half it has, and predicted from
its words of the other half alone, both ways round.  So what a higher grade means is "more such vocabulary of another
kind as well", never a count of the very features that predict it; it is still vocabulary, and no judgement of a person.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.llm.labelled import labelled_sample
from exonloom.llm.shingles import minhashes, shingle_sets

#: Labelled documents that a fit takes at most: of toxic ones, and of clean ones.
MOST_LABELLED = (3_000, 6_000)
#: Minhashes by which near copies in the sample are told, and how many of them near copies share at least.
MARKS, SHARED = 16, 12
#: Prefix lengths, in bytes.
PREFIXES = (4, 5, 6)
#: What a row of the fit about a higher grade weighs, against one about a label: the labels are the evidence.
GRADES_WEIGH = 0.01
#: Distinct words whose weights a worker remembers.
REMEMBERED = 400_000
#: A-Z to a-z; ASCII that is neither letter nor digit to space; all else as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_in(text: str | None) -> set[bytes]:
    """Distinct words of the whole text."""
    return set((text or "").encode("utf-8", "surrogatepass").translate(FOLD).split())


def features_of(word: bytes) -> list[int]:
    """32-bit hashes of a word's features; a few thousand have weights, so that other words hardly ever meet one.  The
    last bit is the half that words of these first bytes belong to."""
    half = xxhash.xxh32_intdigest(word[: PREFIXES[0]], 5) & 1
    return [h & ~1 | half for h in (xxhash.xxh32_intdigest(b"=" + word), *(xxhash.xxh32_intdigest(b"^" + word[:n]) for n in PREFIXES if len(word) > n))]


@dataclass
class Ordinal:
    """Weights by feature and ascending thresholds; without thresholds, nothing is known and nothing is toxic."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rows: tuple[int, int] = (0, 0)  # clean and toxic documents that it was fitted to

    def of_word(self, word: bytes) -> tuple[int, ...]:
        """The word's features that have a weight; a text's w . x sums over its words' distinct ones."""
        return tuple(f for f in features_of(word) if f in self.weights)

    def above(self, score: float) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -40, 40)))


def fit(flat: list[np.ndarray], toxic: np.ndarray, grades: int = 3, least_z: float = 3.3, least_lift: float = 2.0, ridge: float = 0.0007, steps: int = 4000) -> Ordinal:
    """``flat``: for each document its distinct features.  Full-batch Adam on the penalised likelihood.

    Features count if their log odds in toxic documents are ``least_lift`` above those in clean ones, and ``least_z``
    standard errors: toxic documents may be longer, which lifts any word a little.
    """
    n = np.bincount(toxic, minlength=2)
    if n.min() == 0:
        return Ordinal()
    seen, at = np.unique(np.concatenate(flat), return_inverse=True)
    doc = np.repeat(np.arange(len(flat), dtype=np.int32), [len(f) for f in flat])
    df = np.array([np.bincount(at[toxic[doc] == k], minlength=len(seen)) for k in (0, 1)], float)
    odds = [np.log((df[k] + 0.5) / (n[k] - df[k] + 0.5)) for k in (0, 1)]
    z = (odds[1] - odds[0]) / np.sqrt(1 / (df[0] + 0.5) + 1 / (df[1] + 0.5))
    keep = (z >= least_z) & (odds[1] - odds[0] >= least_lift) & (df.sum(0) >= 3)
    if not keep.any():
        return Ordinal()
    place = {int(f): k for k, f in enumerate(seen[keep])}
    column = np.cumsum(keep) - 1
    doc, col = doc[keep[at]], column[at[keep[at]]]
    half = (seen[keep] & 1)[col].astype(int)
    n_docs, ill = len(flat), toxic == 1
    # rows of the fit: all of a document's features against its label, then each half's against the other half's grade
    row, times = [doc], [np.ones(n_docs)]
    above = [ill.astype(float)]
    level = [np.zeros(n_docs, int)]
    for own in (0, 1):
        marked = np.bincount(doc[half != own], minlength=n_docs)
        cuts = np.quantile(marked[ill], [k / grades for k in range(1, grades)])
        grade = np.where(ill, 1 + np.searchsorted(cuts, marked, side="left"), 0)
        for k in range(1, grades):
            if 0 < (grade > k).sum() < n_docs:
                row.append(np.where(half == own, doc + n_docs * len(row), -1))
                times.append(np.full(n_docs, 2.0))  # a half has half of the score
                above.append((grade > k).astype(float))
                level.append(np.full(n_docs, k))
    held = [np.flatnonzero(r >= 0) for r in row]
    row, col = np.concatenate([r[h] for r, h in zip(row, held)]), np.concatenate([col[h] for h in held])
    times, above, level = (np.concatenate(x) for x in (times, above, level))
    weight = np.where(level == 0, 1.0, GRADES_WEIGH)
    used = np.unique(level)
    level = np.searchsorted(used, level)

    w, t = np.zeros(len(place)), np.linspace(2.0, 4.0, len(used))
    state = [np.zeros(len(place) + len(used)) for _ in range(2)]
    for step in range(1, steps + 1):
        score = times * np.bincount(row, w[col], len(above))
        p = 1 / (1 + np.exp(-np.clip(score - t[level], -40, 40)))
        # binary cumulative links, all with the same w
        off = (p - above) * weight / n_docs
        g = np.concatenate((np.bincount(col, (off * times)[row], len(place)) + ridge * w / n_docs, -np.bincount(level, off, len(used))))
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-10)
        w, t = np.maximum(w - move[: len(w)], 0), t - move[len(w) :]  # a feature that toxic texts have more of is no plea for the rest
    return Ordinal({f: float(w[k]) for f, k in place.items() if w[k] > 1e-3}, np.maximum.accumulate(t))


def _features_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, list[int]] = {}
    for batch in batches:
        texts = batch.column(1).to_pylist()
        sets = shingle_sets(texts)
        marks = [minhashes([s], MARKS).tobytes() if len(s) else b"" for s in sets]
        out = []
        for t in texts:
            words = words_in(t)
            for w in words:
                if w not in known:
                    known[w] = features_of(w)
            out.append(np.array(sorted({f for w in words for f in known[w]}), np.uint32).tobytes())
            if len(known) > REMEMBERED:
                known.clear()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), pa.array(out, pa.binary())], names=["label", "marks", "features"])


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: tuple[int, int] = MOST_LABELLED, grades: int = 3) -> Ordinal:
    """A model from at most ``most`` labelled documents, toxic and clean.

    Of near copies in that sample, which would make their rare words look telling, only one counts.
    """
    sample = labelled_sample(docs, labels, label_col, (most[1], most[0]), id_col, text_col)
    rows = sample.select("label", "text").mapInArrow(_features_in, "label int, marks binary, features binary").collect()
    rows = sorted((r["label"], bytes(r["marks"]), r["features"]) for r in rows)
    rows = [rows[k] for k in one_of_each([(r[0], r[1]) for r in rows])]
    model = fit([np.frombuffer(r[2], np.uint32) for r in rows], np.array([r[0] for r in rows], int), grades)
    model.rows = tuple(sum(r[0] == k for r in rows) for k in (0, 1))
    return model


def one_of_each(marked: list[tuple[int, bytes]]) -> list[int]:
    """Of rows of a label that share SHARED or more of their minhashes, directly or over others, the first."""
    group = np.arange(len(marked))
    for label in sorted({m[0] for m in marked}):
        rows = np.array([k for k, m in enumerate(marked) if m[0] == label and m[1]], int)
        marks = np.array([np.frombuffer(marked[k][1], np.uint32) for k in rows])
        for i in range(1, len(rows)):
            near = group[rows[:i][(marks[:i] == marks[i]).sum(1) >= SHARED]]
            if len(near):
                group[np.isin(group, near)] = group[rows[i]] = near.min()
    return np.flatnonzero(group == np.arange(len(marked))).tolist()


def severity(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", at: float = 0.3, keep: bool = False) -> DataFrame:
    """(id, severity, p_toxic, grade, toxic) for every row of ``docs``; with ``keep``, its rows that are not toxic.

    ``severity`` is the expected grade, ``p_toxic`` the probability of grade 1 or more, ``grade`` the number of
    thresholds passed with ``at`` or more, ``toxic`` whether the first is.  A null or empty text has no features and
    gets the model's floor.  Whole texts are read; there is no shuffle, and ids may be null or repeat.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: Iterator[pd.Series]) -> Iterator[np.ndarray]:
        m, found = known.value, {}
        for some in texts:
            out = []
            for t in some:
                words = words_in(t)
                try:
                    marks = set().union(*filter(None, map(found.__getitem__, words)))
                except KeyError:
                    if len(found) > REMEMBERED:
                        found.clear()
                    for w in words:
                        if w not in found:
                            found[w] = m.of_word(w)
                    marks = set().union(*filter(None, map(found.__getitem__, words)))
                out.append(sum(m.weights[f] for f in sorted(marks)))
            yield np.array(out, float)

    @F.pandas_udf("array<double>")
    def above(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in scores(texts):
            yield pd.Series(list(np.stack([known.value.above(x) for x in s]))) if len(s) else pd.Series([], dtype=object)

    p = above(F.col(f"`{text_col}`").cast("string"))
    first_of = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(0.0))
    if keep:
        return docs.filter(first_of(p) < at)
    out, first = docs.select(F.col(f"`{id_col}`"), p.alias("_above")), first_of(F.col("_above"))
    total = F.aggregate("_above", F.lit(0.0), lambda a, v: a + v)
    return out.select(f"`{id_col}`", total.alias("severity"), first.alias("p_toxic"), F.size(F.filter("_above", lambda v: v >= at)).alias("grade"), (first >= at).alias("toxic"))
