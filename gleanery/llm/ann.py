"""Approximate nearest neighbours by cross-polytope hashing with multiprobe.

A hash turns a unit vector by a fast pseudo-rotation (random signs and a Hadamard transform, three times) to its nearest
signed axis. A table concatenates several hashes, more for larger tables of vectors: all but the last name a group, the
last one an axis within it. Every row is filed once in each table; a query probes the likeliest combinations of axes and
is compared with the rows of just those. A group with many rows or queries is dealt into cells of bounded rows and
queries; each cell returns only its best for each query, and the last step merges those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import dimension, matrix, raw, smallest_ids, usable

#: Rows, and queries, of a group that one cell compares.
BLOCK_ROWS = 20_000
#: Axes of one hash that combinations are made of, and combinations that a step of the probing holds at most.
AXES, HELD = 40, 4_000_000
#: By the number of hashes of a table: how many tables there are, and how many combinations of each a query probes. Of 2,000
#: vectors of 64 dimensions with hardly any structure, these find 0.95 of the ten nearest and more (tests/llm).
PLANS = {2: (12, 500), 3: (24, 12_000)}
FOUND = "query_id long, cls long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (a power of two long), unscaled."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        h *= 2
        x = x.reshape(len(x), n)
    return x


def rotated(vectors: np.ndarray, table: int, seed: int) -> np.ndarray:
    size = 1 << max(0, vectors.shape[1] - 1).bit_length()
    x = np.zeros((len(vectors), size))
    x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    signs = np.random.default_rng([seed, table]).choice((-1.0, 1.0), (3, size))
    for s in signs:
        x = hadamard(x * s) / np.sqrt(size)
    return x


def nearest_axes(x: np.ndarray, probes: int) -> np.ndarray:
    """For each row its `probes` nearest signed axes, nearest first: axis, or axis + size for the negative one."""
    both = np.concatenate([x, -x], axis=1)
    probes = min(probes, both.shape[1])
    part = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(both, part, axis=1), axis=1, kind="stable"), axis=1)


def hashes_for(rows: int, dim: int) -> int:
    """Hashes that a table concatenates: two, or three where a group of two would hold more than BLOCK_ROWS rows on average.
    A group of three that does so is dealt into cells like any large group."""
    axes = 2 << max(0, dim - 1).bit_length()
    return 2 if rows <= BLOCK_ROWS * axes else 3


def combined(vectors: np.ndarray, table: int, hashes: int, probes: int, seed: int) -> tuple[np.ndarray, int]:
    """For each vector the `probes` likeliest combinations of a table's axes, as one number each, likeliest first; and
    the number of axes. A combination is the likelier the nearer its axes are to the nearest ones, by squares."""
    best = far = None
    for h in range(hashes):
        x = rotated(vectors, table * hashes + h, seed)
        both = np.concatenate([x, -x], axis=1)
        axes = nearest_axes(x, min(probes, AXES))
        gap = (both.max(axis=1, keepdims=True) - np.take_along_axis(both, axes, axis=1)) ** 2
        if best is None:
            best, far = axes.astype(np.int64), gap
            continue
        best = (best[:, :, None] * both.shape[1] + axes[:, None, :]).reshape(len(x), -1)
        far = (far[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
        if best.shape[1] > probes:
            pick = np.argpartition(far, probes - 1, axis=1)[:, :probes]
            best, far = np.take_along_axis(best, pick, axis=1), np.take_along_axis(far, pick, axis=1)
    return best, both.shape[1]


def filed(tables: int, hashes: int, seed: int):
    """(cls, vec) to (cls, vec, tab, grp, axis), once for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                vectors = matrix(batch.column(1))
                for t in range(tables):
                    best, axes = combined(vectors, t, hashes, 1, seed)
                    cells = (np.full(len(best), t, np.int32), best[:, 0] // axes, (best[:, 0] % axes).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cells)], ["cls", "vec", "tab", "grp", "axis"])

    return run


def asked(tables: int, hashes: int, probes: int, seed: int):
    """(id, vec) to (id, vec, tab, grp, axes), once for each group that a query probes, with its axes there."""
    step = max(1, min(500, HELD // (min(probes, AXES ** (hashes - 1)) * AXES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                vectors = matrix(batch.column(1))
                for t in range(tables):
                    best, axes = combined(vectors, t, hashes, probes, seed)
                    best.sort(axis=1)
                    row, group = np.repeat(np.arange(len(best)), best.shape[1]), best.ravel() // axes
                    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])])
                    lists = pa.ListArray.from_arrays(np.r_[starts, len(row)].astype(np.int32), (best.ravel() % axes).astype(np.int32))
                    at = pa.array(row[starts])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(starts), t, np.int32)), pa.array(group[starts]), lists], ["id", "vec", "tab", "grp", "axes"])

    return run


def best_of(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the positions of about its k nearest points and their exact distances; ties at the end are kept."""
    q, p = queries.astype(np.float64), points.astype(np.float64)
    near = (p * p).sum(axis=1)[None, :] - 2 * q @ p.T
    if len(p) > k:
        bound = np.partition(near, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (1 + np.abs(bound) + (q * q).sum(axis=1))
        rows, cols = np.nonzero(near <= (bound + slack)[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(near, bool))
    return rows, cols


def compared(k: int):
    """The k + 1 nearest rows of a cell, or those tied with the last, of each query (one may be the query itself), among
    the rows on the axes it probes; a query without axes is compared with all of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"query_id": pa.int64(), "cls": pa.int64(), "score": pa.float64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        axis = right.column("axis").to_numpy()
        order = np.argsort(axis, kind="stable")
        axis, cls = axis[order], right.column("cls").to_numpy()[order]
        points, ids = matrix(right.column("vec"))[order], left.column("id").to_numpy()
        out: list[tuple] = []
        for lo in range(0, len(ids), 500):
            q, lists = matrix(left.column("vec").slice(lo, 500)), left.column("axes").slice(lo, 500).combine_chunks()
            wanted = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            probed = lists.flatten().to_numpy()
            parts = [(wanted[probed == a], *np.searchsorted(axis, [a, a + 1])) for a in np.unique(probed)]
            parts.append((np.flatnonzero(np.diff(lists.offsets.to_numpy()) == 0), 0, len(axis)))
            who, what, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for own, a, b in parts:
                if len(own) and b > a:
                    rows, cols = best_of(q[own], points[a:b], k + 1)
                    who.append(own[rows])
                    what.append(a + cols)
                    score.append(np.sqrt(((q[own[rows]].astype(np.float64) - points[a + cols].astype(np.float64)) ** 2).sum(axis=1)))
            who, what, score = (np.concatenate(x) for x in (who, what, score))
            order = np.lexsort((score, who))
            who, what, score = who[order], what[order], score[order]
            first = np.searchsorted(who, who)
            last = np.minimum(first + k, np.searchsorted(who, who, side="right") - 1)
            near = score <= score[last]
            out.append((ids[lo + who[near]], cls[what[near]], score[near]))
        return pa.table({c: pa.array(np.concatenate(v), t) for (c, t), v in zip(kinds.items(), zip(*out, strict=True), strict=True)})

    return run


def in_cells(points: DataFrame, queries: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with their cells. hot (tab, grp, pb, qb): groups that are dealt into pb parts of their rows and qb parts of
    their queries; each part meets each part of the other side."""

    def side(rows: DataFrame, key: str, own: str, other: str, cell) -> DataFrame:
        rows = rows.join(hot, ["tab", "grp"], "left")
        part = F.pmod(F.xxhash64(key, F.lit(1)), F.coalesce(own, F.lit(1)))
        return rows.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1), lambda j: cell(part, j, F.coalesce("qb", F.lit(1)))))).drop("pb", "qb")

    return side(points, "cls", "pb", "qb", lambda p, q, n: p * n + q), side(queries, "id", "qb", "pb", lambda q, p, n: p * n + q)


def met(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, cls, score of the best of each cell."""
    sizes = points.groupBy("tab", "grp").agg(F.count("*").alias("p")).filter(F.col("p") > BLOCK_ROWS)
    calls = queries.groupBy("tab", "grp").agg(F.count("*").alias("q")).filter(F.col("q") > BLOCK_ROWS)
    parts = [F.ceil(F.coalesce(c, F.lit(1)) / BLOCK_ROWS).cast("long").alias(n) for c, n in (("p", "pb"), ("q", "qb"))]
    # a table of groups with more rows than a cell, whose size Spark knows when it picks the joins
    hot = written(sizes.join(calls, ["tab", "grp"], "full").select("tab", "grp", *parts), "hot")
    rows, calls = in_cells(points, queries, hot)
    key = ["tab", "grp", "cell"]
    return calls.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(compared(k), FOUND)


def nearest(base: DataFrame, queries: DataFrame, *, k: int = 10, hashes: int | None = None, tables: int | None = None, probes: int | None = None, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows of `base` other than its own id, by Euclidean
    distance in double precision on the original vectors, nearest first, ties to the smaller id.

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no part.
    Equal vectors are compared once and stand for their k + 1 smallest ids, which are all that can be among k results.
    Repeated ids of one vector count once; of different vectors, with the smallest distance. `hashes` of a table (two or
    three, by the number of rows unless told), the number of tables and the combinations probed of each are those of PLANS
    unless told. The search is approximate: a near row that shares no probed combination with the query is missed, and the
    next one takes its rank. Queries that meet fewer than k rows are compared with all rows, in blocks; with fewer
    candidates than k, all are returned. An empty table gives an empty one; further columns are ignored. Vectors of
    different lengths are an error.
    """
    spark = base.sparkSession
    rows = raw(usable(base, id_col, vector_col)).filter(F.col("id").isNotNull()).distinct()
    calls = raw(usable(queries, id_col, vector_col)).filter(F.col("id").isNotNull()).distinct()
    dim = dimension(rows)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    classes = written(smallest_ids(rows, k + 1).withColumn("cls", F.monotonically_increasing_id()), "classes")
    count = classes.count()
    hashes = hashes or hashes_for(count, dim)
    tables, probes = tables or PLANS[hashes][0], probes or PLANS[hashes][1]
    kept = classes.select("cls", "vec")
    points = kept.mapInArrow(filed(tables, hashes, seed), "cls long, vec binary, tab int, grp long, axis int")
    wanted = calls.mapInArrow(asked(tables, hashes, probes, seed), "id long, vec binary, tab int, grp long, axes array<int>")

    def hits(found: DataFrame) -> DataFrame:
        """The k best rows of each query."""
        found = found.join(classes.select("cls", "ids"), "cls").select("query_id", "score", F.explode("ids").alias("vec_id"))
        found = found.filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        by = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    near = written(hits(met(points, wanted, k)), "hits")
    full = near.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = calls.join(full, "id", "left_anti")
    everything = [F.lit(0).alias("tab"), F.lit(0).cast("long").alias("grp")]
    rest = met(kept.select("cls", "vec", *everything, F.lit(0).alias("axis")), short.select("id", "vec", *everything, F.array().cast("array<int>").alias("axes")), k)
    return near.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(hits(rest))
