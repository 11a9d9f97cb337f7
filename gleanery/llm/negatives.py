"""Hard negatives by a secondary sort: of each anchor, scores that lie in windows below those of its positives.

Anchors are a stated share of the rows, and meet all rows in blocks. A first pass leaves each block's best rows of an
anchor's own label, from which its positives follow. They open windows of scores; a second pass leaves each block's first
rows of other labels in each window. What both leave is packed into keys (anchor, descending score, kind, id), dealt by
anchor and sorted by `repartitionAndSortWithinPartitions`. An iterator then walks the keys: a positive opens its window, a
row of another label goes to each open window that it lies in, and a full window closes. It holds the open windows of one
anchor, never the anchor's rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows and anchors of one group; small tables are dealt finer, so that all tasks get some.
ROWS, ANCHORS, FEWEST = 4096, 512, 256
HALF = 1 << 63
KEY = ">QQBQ"
FOUND = "anchor long, score long, id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label and vec (floor(scale * x) of each component) of the rows that take part, one for each id."""
    i, label = F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("long")
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.filter(i.isNotNull() & label.isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(i.alias("id"), F.struct(label.alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("vec")).alias("row"))
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vec")


def components(table: pa.Table) -> np.ndarray:
    column = table.column("vec").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exactly: in floating point where no sum can leave its whole numbers."""
    most = a.shape[1] * max((int(x) for m in (a, b) if m.size for x in (m.max(), -int(m.min()))), default=0) ** 2
    if most >= HALF:
        raise ValueError("inner products of more than 64 bits")
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a @ b.T


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, highest first, ties by smaller id."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * positive <= 100 * s <= high * positive: least and most, which may be an empty range."""
    return -(-low * positive // 100), high * positive // 100


def best_of_own_label(k: int):
    """(anchors, rows) of a group to the k first rows of the anchor's label."""

    def picked(anchor: np.ndarray, labels: np.ndarray, ids: np.ndarray, mine: np.ndarray, score: Callable) -> Iterator[tuple]:
        for label in np.unique(mine):
            who, what = np.flatnonzero(mine == label), np.flatnonzero(labels == label)
            if len(what):
                for i, scores in zip(who, score(who, what), strict=True):
                    others = ids[what] != anchor[i]
                    at = first(scores[others], ids[what][others], k)
                    yield anchor[i], scores[others][at], ids[what][others][at]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = components(left), components(right)
        anchor, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        return found(picked(anchor, right.column("label").to_numpy(), ids, left.column("label").to_numpy(), lambda x, y: products(a[x], b[y])))

    return run


def first_in_windows(k: int, low: int, high: int):
    """(anchors with the scores of their positives, rows) of a group to the rows of other labels that are among the k
    first of the group in a window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = components(left), components(right)
        anchor, mine, marks = left.column("id").to_numpy(), left.column("label").to_numpy(), left.column("marks").to_pylist()
        ids, labels = right.column("id").to_numpy(), right.column("label").to_numpy()

        def picked() -> Iterator[tuple]:
            for i, scores in enumerate(products(a, b) if len(ids) else []):
                other, kept = (labels != mine[i]) & (ids != anchor[i]), []
                for p in marks[i]:
                    least, most = window(p, low, high)
                    inside = np.flatnonzero(other & (scores >= least) & (scores <= most))
                    kept.append(inside[first(scores[inside], ids[inside], k)])
                at = np.unique(np.concatenate(kept))
                yield anchor[i], scores[at], ids[at]

        return found(picked())

    return run


def found(parts: Iterator[tuple]) -> pa.Table:
    parts = list(parts)
    anchors = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
    cells = [np.concatenate([np.zeros(0, np.int64), *(p[j] for p in parts)]) for j in (1, 2)]
    return pa.table([pa.array(anchors), *map(pa.array, cells)], ["anchor", "score", "id"])


def packed(anchor: int, score: int, kind: int, i: int) -> bytes:
    """A key whose bytes sort by anchor, descending score, kind (positives before others of their score) and id."""
    return struct.pack(KEY, anchor + HALF, HALF - 1 - score, kind, i + HALF)


def walk(low: int, high: int, k: int):
    """Sorted keys to result rows. Positives come before all that lies in their windows, as scores fall."""

    def run(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
        anchor, opened = None, []
        for key, _ in keys:
            mine, score, kind, i = struct.unpack(KEY, key)
            mine, score, i = mine - HALF, HALF - 1 - score, i - HALF
            if mine != anchor:
                anchor, opened = mine, []
            if kind == 0:
                opened.append([i, score, *window(score, low, high), 0])
                continue
            for w in opened:
                if w[2] <= score <= w[3]:
                    w[4] += 1
                    yield anchor, w[0], w[4], i, w[1], score
            opened = [w for w in opened if w[4] < k and w[2] <= score]

    return run


def mine(
    table: DataFrame, *, anchors: Callable[[Column], Column], positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of the vectors' floor(scale * x), in whole numbers; higher ones come first, ties by smaller id.
    `anchors` tells from an id whether a row is one. An anchor's positives are its first rows of the same label; each
    takes the first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score
    (0 <= low <= high <= 100). A positive below zero has no such row.

    Rows with a null id, label or vector or a null or non-finite component take no part; zero and empty vectors do, with
    scores of 0. Of rows that share an id, that with the smallest label and then vector counts, alone. Fewer rows than asked
    for are returned where there are fewer; an empty table gives an empty one; further columns are ignored. Vectors of
    different lengths, and scores of more than 64 bits, are errors.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("windows lie below their positive: 0 <= low <= high <= 100")
    spark = table.sparkSession
    rows = written(whole_vectors(table, id_col, vector_col, label_col, scale), "whole")
    calls = rows.filter(anchors(F.col("id")))
    n, asked, short, long = rows.agg(F.count("*"), F.count(F.when(anchors(F.col("id")), 1)), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if short != long:
        raise ValueError("vectors of different lengths")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, parts = max(1, -(-n // ROWS), min(tasks, -(-n // FEWEST))), max(1, -(-asked // ANCHORS))

    def every(m: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def dealt(c: str, m: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(m)).cast("int")

    right = rows.toDF(*rows.columns).withColumn("block", dealt("id", blocks)).withColumn("part", every(parts)).groupBy("part", "block")

    def passed(left: DataFrame, f: Callable) -> DataFrame:
        left = left.toDF(*left.columns).withColumn("part", dealt("id", parts)).withColumn("block", every(blocks))
        return left.groupBy("part", "block").cogroup(right).applyInArrow(f, FOUND)

    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    near = written(passed(calls, best_of_own_label(positives)).withColumn("r", rank).filter(F.col("r") <= positives).drop("r"), "positives")
    marks = near.groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("marks")).withColumnRenamed("anchor", "id")
    far = passed(calls.join(marks, "id"), first_in_windows(negatives, low, high))
    both = near.withColumn("kind", F.lit(0)).unionByName(far.withColumn("kind", F.lit(1))).select("anchor", "score", "kind", "id")
    keys = both.rdd.map(lambda r: (packed(*r), None)).repartitionAndSortWithinPartitions(tasks, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(keys.mapPartitions(walk(low, high, negatives)), RESULT, verifySchema=False)
