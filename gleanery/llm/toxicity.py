"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(cut_k - w . x): one weight vector is shared by all ordered cuts. Features say which words, and
which word beginnings, a text holds. The result is the expected severity, the sum of the grades times their chances.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, steps, text_rows

WORDS = re.compile(r"[^\W\d_]+")
SPACE = (1 << 22) - 1
STARTS = (4, 5, 6)


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself, and its beginnings."""
    return (zlib.crc32(word.encode()) & SPACE, *(zlib.crc32(f"{word[:n]}*".encode()) & SPACE for n in STARTS if len(word) > n))


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, toxic) to (toxic, features): the distinct features of each text, as little-endian bytes."""
    for batch in batches:
        for part in steps(batch):
            cells = [np.unique(np.fromiter((f for w in set(WORDS.findall((t or "").lower())) for f in features(w)), np.int32)).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array(cells, pa.binary())], ["toxic", "features"])


class Model:
    """Weights by feature, the ordered cuts; without cuts nothing was learned."""

    def __init__(self, weights: dict[int, float], cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def chances(self, score: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.cuts - score[:, None], -35, 35)))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1), axis=1)


def screened(toxic: np.ndarray, row: np.ndarray, feature: np.ndarray, most: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The features whose share among toxic texts stands out most, and their z values."""
    names, column = np.unique(feature, return_inverse=True)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    hit1, hit = np.bincount(column, toxic[row].astype(float)), np.bincount(column)
    p1, p0, p = hit1 / n1, (hit - hit1) / n0, (hit + 1) / (n0 + n1 + 2)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    pick = np.flatnonzero((np.abs(z) >= least) & (hit >= 2))
    pick = pick[np.argsort(-np.abs(z[pick]), kind="stable")[:most]]
    return names[pick], z[pick]


def regress(row: np.ndarray, column: np.ndarray, grade: np.ndarray, weight: np.ndarray, width: int, grades: int, *, l1: float, l2: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by proximal gradient steps with per-coordinate rates (full batch, so the order doesn't matter)."""
    n, weight = len(grade), weight / weight.sum()
    share = np.clip(np.cumsum(np.bincount(grade, weight, minlength=grades))[:-1], 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    w, seen_w, seen_c = np.zeros(width), np.full(width, 1e-8), np.full(len(cuts), 1e-8)
    for t in range(rounds):
        score = np.bincount(row, w[column], n)
        low = np.r_[-np.inf, cuts][grade] - score
        high = np.r_[cuts, np.inf][grade] - score
        s_low, s_high = 1 / (1 + np.exp(-np.clip(low, -35, 35))), 1 / (1 + np.exp(-np.clip(high, -35, 35)))
        s_low, s_high = np.where(np.isinf(low), 0, s_low), np.where(np.isinf(high), 1, s_high)
        p = np.maximum(s_high - s_low, 1e-9)
        d_low, d_high = s_low * (1 - s_low) / p * weight, s_high * (1 - s_high) / p * weight
        g_w = np.bincount(column, (d_high - d_low)[row], width) + l2 * w
        g_c = np.bincount(grade[grade > 0] - 1, d_low[grade > 0], len(cuts)) - np.bincount(grade[grade < grades - 1], d_high[grade < grades - 1], len(cuts))
        seen_w += g_w**2
        seen_c += g_c**2
        rate_w, rate_c = 0.3 / np.sqrt(seen_w), 0.3 / np.sqrt(seen_c)
        w -= rate_w * g_w
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate_w * l1)
        cuts = np.maximum.accumulate(cuts - rate_c * g_c)
    return w, cuts


def fit(docs: DataFrame, labels: DataFrame, *, grades: int = 4, sample: int = 6000, most_features: int = 4096, least_z: float = 4.0, l1: float = 2e-4, l2: float = 1e-4, rounds: int = 300, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from at most `sample` labelled documents, half of them toxic at most, picked by a hash of the id. An id that
    several rows share gives one of its texts.

    Labels say toxic or not. The grades of the toxic ones come from how many distinct features they hold that stand out
    among toxic documents: grade 0 isn't toxic, and the others split the toxic ones evenly by that number.
    """
    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    own = own.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in own.filter("toxic in (0, 1)").groupBy("toxic").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = own.filter("toxic = 1").orderBy(*order).limit(sample // 2).unionByName(own.filter("toxic = 0").orderBy(*order).limit(sample - sample // 2))
    train = text_rows(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")  # at most `sample` ids
    train = train.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic")
    rows = train.mapInArrow(feature_rows, "toxic int, features binary").toArrow()
    toxic = np.array(rows.column("toxic").to_pylist(), bool)
    if toxic.all() or not toxic.any():
        return Model({}, np.zeros(0))
    cells = [np.frombuffer(x, np.int32) for x in rows.column("features").to_pylist()]
    row, feature = np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate(cells)
    names, z = screened(toxic, row, feature, most_features, least_z)
    order_of = np.argsort(names)
    sorted_names = names[order_of]
    at = np.minimum(np.searchsorted(sorted_names, feature), max(0, len(names) - 1))
    kept = (sorted_names[at] == feature) if len(names) else np.zeros(len(feature), bool)
    row, column = row[kept], order_of[at[kept]]
    strength = np.bincount(row, (z[column] > 0).astype(float), len(toxic)) if len(names) else np.zeros(len(toxic))
    steps_at = np.quantile(strength[toxic], np.arange(1, grades - 1) / (grades - 1)) if grades > 2 else []
    grade = np.where(toxic, 1 + np.searchsorted(steps_at, strength, side="left"), 0).astype(np.int64)
    grade = np.unique(grade, return_inverse=True)[1]
    weight = np.where(toxic, counts.get(1, 0) / toxic.sum(), counts.get(0, 0) / (~toxic).sum())  # the chances are those of all labels
    w, cuts = regress(row, column, grade, weight, len(names), int(grade.max()) + 1, l1=l1, l2=l2, rounds=rounds)
    return Model({int(f): float(x) for f, x in zip(names, w, strict=True) if x}, cuts)


def grade(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest), p_toxic (chance of any grade above 0), toxic (that chance
    is at least a half) of each row's whole text.

    A null or empty text has no features. If nothing was learned (no labels, or labels of one kind) all is 0. Null or
    repeated ids and repeated rows give a row each; an empty table gives an empty one; further columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cache = shared.value.weights, Bounded(300_000)
        for batch in batches:
            for part in steps(batch):
                score = []
                for text in part.column(1).to_pylist():
                    words = set(WORDS.findall((text or "").lower()))
                    cache.room(len(words))
                    for w in words:
                        if w not in cache:
                            cache[w] = tuple(f for f in features(w) if f in weights)
                    score.append(sum(weights[f] for f in {f for w in words for f in cache[w]}))
                chances = shared.value.chances(np.array(score, float))
                severity, p = chances @ np.arange(chances.shape[1]), 1 - chances[:, 0]
                cells = [severity, chances.argmax(axis=1).astype(np.int32), p, p >= 0.5]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cells)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
