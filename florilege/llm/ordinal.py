"""Ordinal cumulative-link regression on graded ratings.

A document's features are its distinct tokens (runs of letters, runs of other marks), hashed into BUCKETS; one
weight vector is shared by all grades, and ordered thresholds cut its score z: P(grade > k) = sigmoid(z - t_k).
The expected grade is the sum of these probabilities over k, the tail probability that of the highest grade.

Grades from labels: 0 toxic, 1 not toxic and of low quality, 2 not toxic and of high quality; rows of labels
with a null id, or both ratings null, rate nothing; one null rating counts as 0. Of several ratings of a document
the lowest counts.

Fitting takes at most SAMPLE rated documents, chosen by a hash of the id, and of each at most TERMS features, those of the
lowest hashes (documented bounds: the driver holds SAMPLE * TERMS numbers of 2 bytes at most). All documents
are scored, whole, of any length, by all their features. Null and empty texts have no features: z = 0. Null ids and
repeated rows are rows like any other, and equal texts get equal results. With no rated
document the model has weights 0. An empty table of documents gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import bounded_sample, map_rows

SAMPLE, TERMS, BUCKETS, GRADES = 8_000, 4_000, 1 << 16, 3
#: Documents whose probability of the highest grade reaches this are kept.
TAIL = 0.5
MARK = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: What a worker keeps: chunks of so many characters at most, so many of them.
LONGEST, MAX_TOKENS = 64, 200_000

_KNOWN: dict[str, tuple[int, ...]] = {}


def _hashed(chunk: str) -> tuple[int, ...]:
    got = tuple({zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in MARK.findall(chunk)})
    if len(chunk) <= LONGEST:
        if len(_KNOWN) >= MAX_TOKENS:
            _KNOWN.clear()
        _KNOWN[chunk] = got
    return got


def _forget() -> None:
    _KNOWN.clear()


def features(text: str | None) -> list[int]:
    """Sorted buckets of the distinct tokens of a text, in lower case."""
    found: set[int] = set()
    known = _KNOWN
    for chunk in set((text or "").lower().split()):
        found.update(known.get(chunk) or _hashed(chunk))
    return sorted(found)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # rising, one fewer than grades

    def score(self, buckets: list[int]) -> float:
        return float(self.weights[buckets].sum())

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a row for each score."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -30, 30)))


def fit(rows: list, grades: list[int], steps: int = 150, rate: float = 0.1, penalty: float = 1e-5) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam over all rows; thresholds are a first one and logs of gaps."""
    weights, cuts = np.zeros(BUCKETS), np.array([-1.0, *[0.5] * (GRADES - 2)])
    model = Model(weights.astype(np.float32), np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])))
    if not rows:
        return model
    size = np.array([len(r) for r in rows])
    index = np.concatenate([np.asarray(r, np.int64) for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    y, n = np.asarray(grades), len(rows)
    scale = told(index, owner, y)
    value = scale[index]
    moments = [(np.zeros(BUCKETS), np.zeros(BUCKETS)), (np.zeros(GRADES - 1), np.zeros(GRADES - 1))]
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights[index] * value, minlength=n)
        bounds = np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))
        edge = np.concatenate([np.full((n, 1), 1.0), 1 / (1 + np.exp(-np.clip(z[:, None] - bounds, -30, 30))), np.zeros((n, 1))], axis=1)
        slope = edge * (1 - edge)  # of P(grade > k - 1); P(grade = k) is the difference of two neighbours
        own = np.maximum(edge[np.arange(n), y] - edge[np.arange(n), y + 1], 1e-9)
        g_z = -(slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / own / n
        g_bound = np.array([((y == k + 1) * slope[:, k + 1] / own - (y == k) * slope[:, k + 1] / own).sum() / n for k in range(GRADES - 1)])
        g_cut = np.array([g_bound[k:].sum() for k in range(GRADES - 1)])
        g_cut[1:] *= np.exp(cuts[1:])
        g_w = np.bincount(index, g_z[owner] * value, minlength=BUCKETS) + penalty * weights
        for k, (param, grad) in enumerate(((weights, g_w), (cuts, g_cut))):
            first, second = moments[k]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            param -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model((weights * scale).astype(np.float32), np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])))


def told(index: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How much a bucket tells of the grade alone, from 0 to 1: the largest z of its share below and above a threshold,
    past chance. The penalty thus bears on what few documents suggest, not on what many show."""
    n, best = len(y), np.zeros(BUCKETS)
    seen = np.bincount(index, minlength=BUCKETS)
    for k in range(1, GRADES):
        high = y >= k
        n_high = max(1, int(high.sum()))
        n_low = max(1, n - n_high)
        with_high = np.bincount(index, high[owner].astype(float), minlength=BUCKETS)
        share = (seen + 1) / (n + 2)
        gap = np.abs((with_high + share) / (n_high + 1) - (seen - with_high + share) / (n_low + 1))
        best = np.maximum(best, gap / np.sqrt(share * (1 - share) * (1 / n_high + 1 / n_low)))
    return np.where(seen >= 3, np.clip((best - 2) / 8, 0, 1), 0.0)


def rated(labels: DataFrame) -> DataFrame:
    """doc_id and grade of each rated document."""
    known = labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.coalesce("quality", F.lit(0)) > 0, 2).otherwise(1)
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rated documents."""
    chosen = bounded_sample(rated(labels), sample, "doc_id")
    text = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows of two numbers

    def run(columns: list[list]) -> list[list]:
        return [columns[0], columns[1], [np.array(features(t)[:TERMS], np.uint16).tobytes() for t in columns[2]]]

    rows = map_rows(text.select("doc_id", "grade", "text"), run, "doc_id long, grade int, buckets binary")
    # Repeated rows of an id would break the bound: one text counts.
    rows = rows.groupBy("doc_id", "grade").agg(F.min("buckets").alias("buckets")).orderBy("doc_id").collect()
    return fit([np.frombuffer(r.buckets, np.uint16) for r in rows], [r.grade for r in rows])


def select(docs: DataFrame, model: Model, tail: float = TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the highest grade) and kept, for every row of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the data

    def run(columns: list[list]) -> list[list]:
        own = shared.value
        above = own.above(np.array([own.score(features(t)) for t in columns[1]]))
        high = np.round(above[:, -1], 9)
        return [columns[0], np.round(above.sum(axis=1), 9).tolist(), high.tolist(), (high >= tail).tolist()]

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, expected_grade double, tail_probability double, kept boolean", _forget)
