"""Ranked lexical search over hashed max-sketches: upper bounds by lookups, exact scores in descending order of bounds.

The index holds, for each document, its terms with their counts and a sketch: terms are hashed to `width` coordinates, each
of which keeps the largest count of its terms. The impact of a count grows with the count, so the impact of a coordinate's
maximum is the maximum of its terms' impacts; lengths and document frequencies enter at search time, and one index serves
any batches of queries. A query looks its terms' coordinates up: the weighted sum bounds the score from above. Documents
are then scored exactly in descending order of bounds, until a bound falls below the k-th best score so far.

A batch of queries of a checked size goes to the tasks, which read the index once and keep k documents a query; those meet
in two rounds, by query and share of the tasks and then by query.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bounded, steps, text_rows, written

#: What separates terms becomes a space, A-Z become a-z; all bytes of other characters stay.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Items and terms of a batch; a batch of more than twice as many holds one item.
ITEMS, TERMS = 2048, 200_000
#: Cells of the table of impacts that a step looks queries up in.
CELLS = 4 << 20
INDEX = "doc_id long, n long, terms string, counts binary, cells binary, tops binary"


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z in lower case."""
    return (text or "").encode().translate(FOLD).split()


def cell(term: bytes, width: int) -> int:
    return crc32(term) % width


class Cells(Bounded):
    """Coordinates of terms, remembered."""

    def __init__(self, width: int, most: int = 500_000):
        super().__init__(most)
        self.width = width

    def __missing__(self, term: bytes) -> int:
        self[term] = c = cell(term, self.width)
        return c


def build_index(docs: DataFrame, *, width: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table: doc_id, n (terms with repeats), terms (distinct, joined by spaces), counts, and the sketch: cells
    (ascending) and tops, their largest counts; arrays as little-endian unsigned 32-bit numbers. A row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(width)
        for batch in batches:
            for part in steps(batch):
                counted = [Counter(terms_of(t)) for t in part.column(1).to_pylist()]
                sizes = [len(c) for c in counted]
                cells.room(sum(sizes))
                counts = np.fromiter((x for c in counted for x in c.values()), np.uint32, sum(sizes))
                key = np.repeat(np.arange(len(sizes), dtype=np.int64) * width, sizes) + np.fromiter((cells[t] for c in counted for t in c), np.int64, sum(sizes))
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0]) if len(key) else np.zeros(0, np.int64)
                tops = np.maximum.reduceat(counts[order], starts) if len(key) else counts
                held = key[order][starts]
                edges = np.searchsorted(held, np.arange(len(sizes) + 1) * width)
                columns = [
                    part.column(0), pa.array([c.total() for c in counted], pa.int64()), pa.array([b" ".join(c) for c in counted], pa.binary()).cast(pa.string()),
                    blobs(counts, np.r_[0, np.cumsum(sizes)]), blobs((held % width).astype("<u4"), edges), blobs(tops, edges),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts", "cells", "tops"])

    return written(text_rows(docs, id_col, text_col).mapInArrow(run, INDEX), "sketches")


def blobs(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    data, edges = values.astype("<u4").tobytes(), (np.asarray(edges, np.int64) * 4).tolist()
    return pa.array([data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of blobs, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4").astype(np.int64), np.array([len(r) // 4 for r in rows], np.int64)


def asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """q (a key of the row), item_id, term, times of each item's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                for q, i, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    counted = iter(Counter(terms_of(text)).items())
                    while some := list(islice(counted, 50_000)):
                        yield pa.RecordBatch.from_pydict({"q": [q] * len(some), "item_id": pa.array([i] * len(some), pa.int64()), "term": [t.decode() for t, _ in some], "times": [n for _, n in some]})

    rows = items.select(F.monotonically_increasing_id().alias("q"), F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "q long, item_id long, term string, times long")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impact(tf, m):
    """Of whole numbers or arrays of them."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Batch:
    """Queries as the tasks hold them: for each its terms with weights, and its rows in a table of the coordinates in use."""

    def __init__(self, rows: list, n: int, total: int, width: int, k: int):
        self.n, self.total, self.k = n, total, k
        self.terms: dict[tuple, list[tuple[str, int]]] = {}
        for r in rows:
            self.terms.setdefault((r.q, r.item_id), []).append((r.term, r.times * weight(n, r.df)))
        places = {key: np.array([cell(t.encode(), width) for t, _ in ts], np.int64) for key, ts in self.terms.items()}
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *places.values()]))
        self.row = np.full(width, -1, np.int64)
        self.row[used] = np.arange(len(used))
        self.looked = {}
        for key, cells in places.items():
            at, inverse = np.unique(self.row[cells], return_inverse=True)
            weights = np.zeros(len(at), np.int64)
            np.add.at(weights, inverse, np.array([w for _, w in self.terms[key]], np.int64))
            self.looked[key] = (at, weights)
        self.docs = max(16, CELLS // max(1, len(used)))

    def lengths(self, n: np.ndarray) -> np.ndarray:
        return np.array([75 + (25 * x * self.n) // self.total for x in n.tolist()], np.int64)

    def impacts(self, cells: pa.Array, tops: pa.Array, m: np.ndarray) -> np.ndarray:
        """The impact of each coordinate in use (rows) in each document (columns)."""
        (at, sizes), (top, _) = numbers(cells), numbers(tops)
        doc, row = np.repeat(np.arange(len(sizes)), sizes), self.row[at]
        hit = row >= 0
        table = np.zeros((int(self.row.max()) + 1, len(sizes)), np.int64)
        table[row[hit], doc[hit]] = impact(top[hit], m[doc[hit]])
        return table


def best(batch: Batch):
    """Index rows to q, item_id, doc_id, score: the k best of each query among a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[tuple]] = {key: [] for key in batch.terms}
        for whole in batches:
            for lo in range(0, whole.num_rows, batch.docs):
                part = whole.slice(lo, batch.docs)
                ids, m = part.column(0).to_pylist(), batch.lengths(part.column(1).to_numpy())
                table = batch.impacts(part.column(4), part.column(5), m)
                counts: dict[int, dict] = {}

                def exact(d: int, terms: list, part=part, counts=counts, m=m) -> int:
                    if d not in counts:
                        counts[d] = dict(zip(part.column(2)[d].as_py().split(" "), np.frombuffer(part.column(3)[d].as_py(), "<u4").tolist(), strict=False))
                    get, length = counts[d].get, int(m[d])
                    return sum(w * impact(tf, length) for t, w in terms if (tf := get(t)))

                for key, (rows, weights) in batch.looked.items():
                    bound, own = weights @ table[rows], kept[key]
                    least = -own[-1][0] if len(own) == batch.k else 1
                    order = np.flatnonzero(bound >= least)
                    for d in order[np.argsort(-bound[order], kind="stable")].tolist():
                        if bound[d] < least:
                            break
                        if (score := exact(d, batch.terms[key])) >= least:
                            insort(own, (-score, ids[d] is None, ids[d] or 0))
                            del own[batch.k :]
                            least = -own[-1][0] if len(own) == batch.k else 1
        found = [(*key, None if none else i, -score) for key, own in kept.items() for score, none, i in own]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["q", "item_id", "doc_id", "score"])

    return run


def batches_of(words: DataFrame) -> int:
    """Into how many buckets of `q` the queries are dealt, so that none is over twice ITEMS and TERMS but by one item."""
    sizes = words.groupBy("q").agg(F.count("*").alias("t"))
    items, terms = sizes.agg(F.count("*"), F.sum("t")).first()
    n = max(1, -(-items // ITEMS), -(-(terms or 0) // TERMS))
    while True:
        by = sizes.groupBy(F.pmod(F.xxhash64("q"), F.lit(n))).agg(F.count("*").alias("i"), F.sum("t").alias("t"))
        if not by.filter((F.col("i") > 1) & ((F.col("i") > 2 * ITEMS) | (F.col("t") > 2 * TERMS))).limit(1).count():
            return n
        n *= 2


def search(index: DataFrame, items: DataFrame, *, k: int = 20, width: int = 1 << 14, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents of the index with a score above 0, all
    if fewer, equal scores by ascending doc_id (null last).

    A term's weight w is floor(1000 * ln((2 * N + 2) / (2 * df + 1))), N the documents that hold a term at all and df those
    that hold this one; a document's m is 75 + (25 * n * N) div L, L all terms of all documents. A score sums
    w * ((10**9 * tf) div (1000 * tf + 12 * m)) over the item's terms, repeats included.

    Null and empty texts, of items or documents, hold no terms and are never found. Repeated rows, and ids that repeat or are
    null, count as rows of their own, ranked after each other. An empty table of either gives an empty one; further columns
    are ignored. `width` must be that of the index.
    """
    spark = index.sparkSession
    words = written(asked(items, id_col, text_col), "asked")
    n, total = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    seen = index.filter("n > 0").select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    words = written(words.join(seen, "term"), "weighed")
    shares, count = max(1, math.isqrt(index.rdd.getNumPartitions())), batches_of(words)
    order, ranked = (F.desc("score"), F.asc_nulls_last("doc_id")), []
    for b in range(count):
        rows = words.filter(F.pmod(F.xxhash64("q"), F.lit(count)) == b).collect()  # a batch: bounded above
        found = index.mapInArrow(best(Batch(rows, n, total, width, k)), "q long, item_id long, doc_id long, score long")
        for by in (("q", "share"), ("q",)):
            found = found.withColumn("share", F.spark_partition_id() % shares) if "share" in by else found
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
        ranked.append(written(found.select("item_id", "rank", "doc_id", "score"), "ranked") if count > 1 else found.select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, ranked)
