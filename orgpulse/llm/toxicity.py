"""Toxicity by cumulative-link ordinal regression on sparse text features.

With grades 0 < 1 < ... < K-1, the chance of a grade above k is
sigmoid(w . x - threshold[k]). All thresholds share the weights w, so severity is one
direction in feature space; the expected severity is the sum of these chances.

Features are words in lower case without punctuation, hashed; a word counts 1 + ln(times).
The model is fitted on a bounded sample of labelled rows; everything is scored.

Labels that are null, or whose document is missing, are not used; of repeated labels the
highest counts. Without both clean and toxic labels the model has no weights and finds
nothing toxic. A null or empty text has no features. Result columns replace columns of
the same names; rows with equal or null ids are scored each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.llm.bytehash import LETTERS, column_bytes, span_hash, word_spans
from orgpulse.llm.columns import free_name

# Bits of a feature's number, labelled rows the model is fitted on, and features it keeps.
FEATURE_BITS = 20
FIT_ROWS = 10_000
FEATURES = 4096
SLICE_BYTES = 2 << 20


@dataclass
class SeverityModel:
    features: np.ndarray  # sorted feature numbers
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def above(self, margins: np.ndarray) -> np.ndarray:
        """Chances of a grade above 0, 1, ..., one column each."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds, -40, 40)))


def text_features(texts: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every feature that a batch of texts has, sorted; ``only`` (sorted) leaves out all others.

    A few MB of text are worked on at a time, whatever the batch.
    """
    texts = texts.cast(pa.large_string())
    ends, parts, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), [], 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        rows, features, values = _slice_features(texts.slice(at, stop - at), only)
        parts.append((rows + at, features, values))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _slice_features(texts: pa.Array, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = column_bytes(pc.utf8_lower(texts))
    starts, ends, rows = word_spans(data, offsets, LETTERS)
    numbers = (span_hash(data, starts, ends) & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64)
    if only is not None:
        kept = np.zeros(1 << FEATURE_BITS, bool)
        kept[only] = True
        kept = kept[numbers]
        numbers, rows = numbers[kept], rows[kept]
    pairs, times = np.unique(rows << FEATURE_BITS | numbers, return_counts=True)
    return pairs >> FEATURE_BITS, pairs & ((1 << FEATURE_BITS) - 1), 1 + np.log(times)


def _choose(rows: np.ndarray, features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features whose presence tells toxic from clean rows most surely."""
    pos = np.bincount(features[toxic[rows]], minlength=1 << FEATURE_BITS)
    neg = np.bincount(features[~toxic[rows]], minlength=1 << FEATURE_BITS)
    n_pos, n_neg = toxic.sum(), (~toxic).sum()
    odds = np.log((pos + 0.5) / (n_pos - pos + 0.5)) - np.log((neg + 0.5) / (n_neg - neg + 0.5))
    z = odds / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5) + 1 / (n_pos - pos + 0.5) + 1 / (n_neg - neg + 0.5))
    good = np.flatnonzero((pos + neg >= 5) & (np.abs(z) > 3))
    return np.sort(good[np.argsort(-np.abs(z[good]), kind="stable")][:FEATURES])


def fit_severity(rows: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray, chosen: np.ndarray, ridge: float = 1.0, steps: int = 400) -> SeverityModel:
    """Maximum likelihood with a ridge penalty, by gradient steps whose length adapts to each parameter."""
    levels = int(grades.max(initial=0))
    place = np.searchsorted(chosen, features)
    keep = place < len(chosen)
    keep[keep] = chosen[place[keep]] == features[keep]
    rows, place, values = rows[keep], place[keep], values[keep]
    n, d = len(grades), len(chosen)
    above = (grades[:, None] > np.arange(levels)).mean(axis=0)
    # Thresholds are the first one and the logarithms of the gaps, which keeps them ascending.
    start = -np.log(above / (1 - above))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2)), np.zeros(d)])
    m, v = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        gaps = np.exp(free[1:levels])
        thresholds = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        w = free[levels:]
        margin = np.bincount(rows, weights=w[place] * values, minlength=n)
        p = 1 / (1 + np.exp(-np.clip(margin[:, None] - thresholds, -40, 40)))
        upper = np.concatenate([np.ones((n, 1)), p], axis=1)[np.arange(n), grades]
        lower = np.concatenate([p, np.zeros((n, 1))], axis=1)[np.arange(n), grades]
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        d_margin = d_upper - d_lower
        d_threshold = np.zeros(levels)
        np.add.at(d_threshold, grades[grades > 0] - 1, -d_upper[grades > 0])
        np.add.at(d_threshold, grades[grades < levels], d_lower[grades < levels])
        tail = np.cumsum(d_threshold[::-1])[::-1]
        gradient = -np.concatenate([tail[:1], tail[1:] * gaps, np.bincount(place, weights=d_margin[rows] * values, minlength=d) - ridge * w])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        free = free - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return SeverityModel(chosen, free[levels:], free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:levels]))]))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", holdout: DataFrame | None = None) -> SeverityModel:
    """Fits three grades: 0 clean; 1 and 2 toxic rows with less and more evidence of it.

    Labels only say toxic or not. So a two-grade model comes first, and toxic rows are graded
    by their margin under it, at the median. The sample is the ``fit_rows`` labels
    whose ids hash lowest; only its features reach the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if holdout is not None:
        known = known.join(holdout.select(id_col), id_col, "left_anti")
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_toxic"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_text", "_toxic")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, features, values = text_features(batch.column("_text"))
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            parts = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x, t)) for x, t in ((features.astype(np.int32), pa.int32()), (values.astype(np.float32), pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("_toxic").cast(pa.int32()), *parts], names=["toxic", "features", "values"])

    table = texts.mapInArrow(extract, "toxic int, features array<int>, values array<float>").toArrow()
    toxic = table.column("toxic").to_numpy() > 0 if table.num_rows else np.empty(0, bool)
    if not toxic.any() or toxic.all():
        return SeverityModel(np.empty(0, np.int64), np.empty(0), np.array([40.0]))
    lists = table.column("features").combine_chunks()
    features, values = lists.flatten().to_numpy().astype(np.int64), table.column("values").combine_chunks().flatten().to_numpy().astype(float)
    rows = np.repeat(np.arange(len(toxic)), pc.list_value_length(lists).to_numpy())
    chosen = _choose(rows, features, toxic)
    first = fit_severity(rows, features, values, toxic.astype(np.int64), chosen)
    margin = score_features(first, rows, features, values, len(toxic))
    grades = toxic.astype(np.int64) + (toxic & (margin > np.median(margin[toxic])))
    return fit_severity(rows, features, values, grades, chosen) if grades.max() == 2 else first


def score_features(model: SeverityModel, rows: np.ndarray, features: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Margin w . x of every row."""
    if not len(model.features):
        return np.zeros(n)
    place = np.minimum(np.searchsorted(model.features, features), len(model.features) - 1)
    hit = model.features[place] == features
    return np.bincount(rows[hit], weights=model.weights[place[hit]] * values[hit], minlength=n)


RESULT = T.StructType([T.StructField("p_toxic", T.DoubleType()), T.StructField("severity", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def score(docs: DataFrame, model: SeverityModel, reject_above: float = 0.5, text_col: str = "text") -> DataFrame:
    """Documents with p_toxic (chance of any grade above 0), expected severity (0 to K-1) and rejected (p_toxic above the limit)."""

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        rows, features, values = text_features(texts, model.features)
        above = model.above(score_features(model, rows, features, values, len(texts)))
        return pa.StructArray.from_arrays([pa.array(x) for x in (above[:, 0], above.sum(axis=1), above[:, 0] > reject_above)], RESULT.names)

    kept = [c for c in docs.columns if c not in RESULT.names]
    judged = free_name(docs, "_judged")
    return docs.select(*kept, judge(F.col(text_col)).alias(judged)).select(*kept, *[F.col(judged)[n].alias(n) for n in RESULT.names])
