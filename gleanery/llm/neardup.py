"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits recursively by random directions at medians; vectors within a margin of a split go both ways (spill), so
that a close pair rarely parts. The upper levels are fitted on a bounded sample and travel with the tasks; below them the
splits of a level are a table, and rows find their node's split by a join. All pairs of a leaf are verified by exact
cosine; a leaf that stays large (a dense group, which would spill as a whole) is dealt into blocks of bounded rows,
compared block against block as groups of their own. A row takes along the leaves it reaches, so each linked pair counts
in the first leaf where it meets alone. So a leaf returns no pairs, but for each row its links there and one row that
they lead to, and the trees are united by sums and by connected components. Equal vectors are one row until the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components
from .vectors import dimension, matrix, raw, unusable, usable

#: Rows that a leaf should hold, the fewest sampled rows at a node that is split, and the rows of a block.
LEAF, FEWEST, BLOCK_ROWS = 256, 8, 2048
#: A node stays whole if a side of its split holds more than this share of it. Levels tried beyond those that N asks for.
HELPS, FURTHER = 0.85, 8
#: Bits of a leaf's number in its tree; the tree's number stands above them.
LEAF_BITS = 48
NODE = ["tree", "leaf"]
#: For each sampled level of a tree the thresholds of its nodes, in order.
Splits = list[np.ndarray]


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def shadows(v: np.ndarray, levels: range, tree: int, seed: int) -> np.ndarray:
    """Projections of unit vectors on a tree's random directions, a column a level. Both are rounded to multiples of
    2**-24 and 2**-20, so that all sums are exact: a row's projections do not depend on the rows beside it."""
    d = np.stack([np.random.default_rng([seed, tree, level]).standard_normal(v.shape[1]) for level in levels] or [np.zeros(v.shape[1])], axis=1)
    d /= np.maximum(np.linalg.norm(d, axis=0), 1e-300)
    return (np.rint(v * 2.0**24) @ np.rint(d * 2.0**20)) * 2.0**-44


def descend(shadow: np.ndarray, splits: Splits, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all leaves a row reaches. Nodes are numbered in heap order."""
    row, node = np.arange(len(shadow)), np.ones(len(shadow), np.int64)
    for level, cuts in enumerate(splits):
        over = shadow[row, level] - cuts[node - (1 << level)]
        left, right = over <= margin, over > -margin
        row, node = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1]
    return row, node


def fitted(sample: np.ndarray, levels: int, margin: float, tree: int, seed: int) -> Splits:
    """Splits at the medians of a sample."""
    shadow = shadows(sample, range(levels), tree, seed)
    splits: Splits = []
    for level in range(levels):
        row, node = descend(shadow, splits, margin)
        order = np.argsort(node, kind="stable")
        row, node = row[order], node[order]
        cuts = np.zeros(1 << level)
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(node)], strict=True):
            cuts[node[a] - (1 << level)] = np.median(shadow[row[a:b], level])
        splits.append(cuts)
    return splits


def sampled_leaves(forest: list[Splits], margin: float, seed: int):
    """(cls, vec) to (cls, tree, leaf): the leaves that a row reaches by the sampled levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                part = whole.slice(lo, 2000)
                v, cls = unit(matrix(part.column(1))), part.column(0).to_numpy()
                for tree, splits in enumerate(forest):
                    row, leaf = descend(shadows(v, range(len(splits)), tree, seed), splits, margin)
                    yield pa.RecordBatch.from_arrays([pa.array(cls[row]), pa.array(np.full(len(row), tree, np.int32)), pa.array(leaf)], ["cls", *NODE])

    return run


def ahead(levels: range, seed: int):
    """(cls, tree, leaf, vec) to (cls, tree, leaf, at): where a row lies in the directions of its tree's next levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                part = whole.slice(lo, 2000)
                v, tree = unit(matrix(part.column(3))), part.column(1).to_numpy()
                at = np.empty((len(v), len(levels)))
                for t in np.unique(tree).tolist():
                    at[tree == t] = shadows(v[tree == t], levels, t, seed)
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(levels))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(ends, pa.array(at.ravel()))], ["cls", *NODE, "at"])

    return run


def grown(classes: DataFrame, forest: list[Splits], further: int, block_rows: int, margin: float, seed: int) -> DataFrame:
    """cls, tree, leaf, blocks: the leaves that each row reaches, and the blocks that a leaf of more than `block_rows` rows is
    dealt into. Leaves that are still large below the sampled levels are split on, all nodes of a level by one join with
    the table of its splits, at most `further` levels. The driver sees no split."""
    leaves = written(classes.select("cls", "vec").mapInArrow(sampled_leaves(forest, margin, seed), "cls long, tree int, leaf long"), "leaves")
    large = written(leaves.groupBy(*NODE).count().filter(F.col("count") > block_rows).select(*NODE), "large")
    if large.isEmpty():
        return leaves.withColumn("blocks", F.lit(1).cast("long"))
    done = [leaves.join(large, NODE, "left_anti").select("cls", *NODE, F.lit(1).cast("long").alias("blocks"))]
    levels = range(len(forest[0]), len(forest[0]) + further)
    rows = leaves.join(large, NODE, "left_semi").join(classes.select("cls", "vec"), "cls").select("cls", *NODE, "vec")
    rows = written(rows.mapInArrow(ahead(levels, seed), "cls long, tree int, leaf long, at array<double>"), "open")
    for i in range(further):
        over = F.col("at")[i] - F.col("cut")
        left, right = over <= margin, over > -margin
        nodes = rows.groupBy(*NODE).agg(F.count("*").alias("n"), F.percentile_approx(F.col("at")[i], 0.5, 200).alias("cut"))
        sides = rows.join(nodes, NODE).groupBy(*NODE, "n", "cut").agg(F.greatest(F.count_if(left), F.count_if(right)).alias("side"))
        stays = (F.col("n") <= block_rows) | (F.col("side") > HELPS * F.col("n")) | F.lit(i == further - 1)
        nodes = written(sides.select(*NODE, "cut", F.when(stays, F.ceil(F.col("n") / block_rows)).alias("blocks")), "splits")
        low, high = 2 * F.col("leaf"), 2 * F.col("leaf") + 1
        to = F.when(F.col("blocks").isNotNull(), F.array("leaf")).when(left & right, F.array(low, high)).when(left, F.array(low)).otherwise(F.array(high))
        rows = written(rows.join(nodes, NODE).select("cls", "tree", F.explode(to).alias("leaf"), "blocks", "at"), "open")
        done.append(rows.filter("blocks is not null").select("cls", *NODE, "blocks"))
        rows = rows.filter("blocks is null").drop("blocks")
        if rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def planted(classes: DataFrame, leaves: DataFrame) -> DataFrame:
    """cls, vec, n, earlier, own, leaf, p, q: a row goes to each pair (p <= q) of blocks of its leaf that has its own block,
    and takes along the leaves that come before that one. Leaves that are not large are one block."""
    number = F.shiftleft(F.col("tree").cast("long"), LEAF_BITS).bitwiseOR(F.col("leaf"))
    reached = leaves.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct(number.alias("leaf"), "blocks"))).alias("reached"))  # trees times spill
    rows = classes.select("cls", "vec", "n").join(reached, "cls").select("*", F.posexplode("reached").alias("i", "here"))
    earlier = F.transform(F.slice("reached", F.lit(1), F.col("i")), lambda x: x["leaf"])
    blocks = F.col("here.blocks")
    rows = rows.select("cls", "vec", "n", earlier.alias("earlier"), F.col("here.leaf").alias("leaf"), F.pmod(F.xxhash64("cls"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    return rows.select("cls", "vec", "n", "earlier", "own", "leaf", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))


def joined(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that the links (x, y) lead to."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        low = low[low]
        if (low == before).all():
            return low


def masks_of(earlier: pa.ChunkedArray, used: np.ndarray) -> Iterator[np.ndarray]:
    """For 64 earlier leaves at a time, a bit each: those that a used row reaches. Leaves of one row tell nothing."""
    lists = earlier.take(pa.array(used)).combine_chunks()
    row = np.repeat(np.arange(len(used)), pc.list_value_length(lists).to_numpy())
    _, column, times = np.unique(pc.list_flatten(lists).to_numpy(), return_inverse=True, return_counts=True)
    shared = times > 1
    name = np.cumsum(shared) - 1
    row, column = row[shared[column]], name[column[shared[column]]]
    for lo in range(0, int(shared.sum()), 64):
        mask, pick = np.zeros(len(used), np.uint64), (column >= lo) & (column < lo + 64)
        np.bitwise_or.at(mask, row[pick], np.uint64(1) << (column[pick] - lo).astype(np.uint64))
        yield mask


def linked(least: float):
    """The links of a leaf, or between two blocks of one: for each linked row the rows it is linked to (copies counted),
    and one row of its component here. Pairs that meet in an earlier leaf too are left to that leaf, which compares all
    its pairs."""

    def run(table: pa.Table) -> pa.Table:
        cls, n, own = (table.column(c).to_numpy() for c in ("cls", "n", "own"))
        v = unit(matrix(table.column("vec")))
        p, q = (table.column(c)[0].as_py() for c in ("p", "q"))
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        a, b = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for lo in range(0, len(left), 500):
            close = v[left[lo : lo + 500]] @ v[right].T >= least
            x, y = np.nonzero(np.triu(close, lo + 1) if p == q else close)
            a.append(left[lo + x].astype(np.int32))
            b.append(right[y].astype(np.int32))
        x, y = np.concatenate(a), np.concatenate(b)
        used = np.unique(np.r_[x, y])
        where = np.zeros(len(v), np.int32)
        where[used] = np.arange(len(used))
        x, y = where[x], where[y]
        new = np.ones(len(x), bool)
        for mask in masks_of(table.column("earlier"), used):
            for lo in range(0, len(x), 1 << 19):
                i, j = x[lo : lo + (1 << 19)], y[lo : lo + (1 << 19)]
                new[lo : lo + len(i)] &= (mask[i] & mask[j]) == 0
        x, y = x[new], y[new]
        times = n[used].astype(np.float64)
        more = np.bincount(x, times[y], len(used)) + np.bincount(y, times[x], len(used))
        some, low = np.flatnonzero(more), joined(x, y, len(used))
        return pa.table({"cls": pa.array(cls[used[some]], pa.int64()), "more": pa.array(more[some].astype(np.int64)), "root": pa.array(cls[used[low[some]]], pa.int64())})

    return run


def placed(classes: DataFrame, n: int, dim: int, *, least: float, trees: int, spill: float, sample: int, block_rows: int, seed: int) -> DataFrame:
    """The rows as they are compared, in groups of (leaf, p, q)."""
    margin = spill * float(np.sqrt(2 * (1 - least) / dim))
    picked = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample).toArrow()
    asked = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    levels = min(asked, int(np.log2(max(1, picked.num_rows / FEWEST))))
    known = unit(matrix(picked.column("vec")))
    forest = [fitted(known, levels, margin, t, seed) for t in range(trees)]  # as many splits as the sample has rows, at most
    return planted(classes, grown(classes, forest, asked - levels + FURTHER, block_rows, margin, seed))


def links_between(classes: DataFrame, n: int, dim: int, *, least: float, **settings) -> DataFrame:
    """cls, more, root: what each leaf says of its linked rows. Sums of `more` are the rows linked to each class."""
    rows = placed(classes, n, dim, least=least, **settings)
    return rows.groupBy("leaf", "p", "q").applyInArrow(linked(least), "cls long, more long, root long")


def near_duplicates(table: DataFrame, *, least: float = 0.95, trees: int = 6, spill: float = 0.75, sample: int = 20_000, block_rows: int = BLOCK_ROWS, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (the smallest vec_id that links reach, itself
    included), kept (vec_id = component_id) of each row.

    Rows are linked whose vectors have a cosine of `least` or more, in double precision. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing: 0 links, their own component, kept. Repeated ids are
    rows of their own. A row without id is no component's id (null if it has no other) and not kept. An empty table gives
    an empty one; further columns are not carried. Vectors of different lengths are an error.
    """
    key = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")]  # 128 bits that tell vectors apart
    rows = written(raw(usable(table, id_col, vector_col)).select("id", "vec", *key), "vectors")
    count, dim = rows.agg(F.approx_count_distinct("h1")).first()[0], dimension(rows)
    alone = unusable(table, id_col, vector_col)
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not dim:
        return alone
    classes = rows.groupBy("h1", "h2", "vec").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    links = written(links_between(classes, count, dim, least=least, trees=trees, spill=spill, sample=sample, block_rows=block_rows, seed=seed), "links")
    degree = links.groupBy("cls").agg(F.sum("more").alias("more"))
    found = components(links, "cls", "root").withColumnsRenamed({"node": "cls", "component": "root"})
    named = classes.drop("vec").join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls")).join(degree, "cls", "left")
    least_id = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least_id, "root").select("h1", "h2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "h1", "h2").join(named, ["h1", "h2"])
    out = out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return out.unionByName(alone)
