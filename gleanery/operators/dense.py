"""Exact vector search and the default embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, tokenize
from ..sources.scratch import spread
from .lexical import DIGITS, Index, top_k

#: Queries that go to all tasks; components of a batch of more; vectors of a part of the corpus, and of a piece that meets a
#: batch at once; cells of a matrix of their cosines.
QUERY_BLOCK, ASKED, BASE_BLOCK, PIECE, CELLS = 2048, 1 << 23, 500_000, 4096, 1 << 20


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit length in double precision; a zero vector stays as it is."""
    return let(F.struct(v.alias("v"), F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0)).alias("n")), lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_from_l2(squared: Column) -> Column:
    """The cosine of two unit vectors from their squared distance."""
    return F.least(F.greatest(1 - squared / 2, F.lit(-1.0)), F.lit(1.0))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """The default embedder: term counts in `dim` buckets by md5, unit length. Any SQL engine can repeat it."""
    buckets = F.transform(tokenize(text), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim)
    return normalise(let(buckets, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(own, lambda b: b == i)).cast("double"))))


def _filled(counts: DataFrame, id_col: str, dim: int) -> DataFrame:
    """id_col and vector from id_col, b and n."""
    held = counts.groupBy(id_col).agg(F.collect_list(F.struct("b", "n")).alias("counts"))  # dim entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, x = batch.column(1), np.zeros((batch.num_rows, dim))
            b, n = cells.flatten().flatten()
            x[np.repeat(np.arange(len(x)), cells.value_lengths().to_numpy()), b.to_numpy()] = n.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(_unit(x).ravel()), dim).cast(pa.list_(pa.float64()))], [id_col, "vector"])

    return held.mapInArrow(run, T.StructType([held.schema[id_col]]).add("vector", T.ArrayType(T.DoubleType())))


def _bucket(term: str, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % dim).alias("b")


def hashed_vectors(rows: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """id_col and vector: the default embedder for a table of texts. Texts without terms have no vector."""
    terms = spread(rows.select(id_col, text_col)).select(id_col, F.explode(tokenize(F.col(text_col))).alias("t")).select(id_col, _bucket("t", dim))
    return _filled(terms.groupBy(id_col, "b").agg(F.count("*").alias("n")), id_col, dim)


def indexed_vectors(index: Index, dim: int = 64) -> DataFrame:
    """chunk_id and vector of the chunks of a lexical index, as hashed_vectors gives them, without reading a text again."""
    terms = index.blocks.select(_bucket("term", dim), F.explode("entries").alias("e")).select("b", "e.chunk_id", "e.tf")
    return _filled(terms.groupBy("chunk_id", "b").agg(F.sum("tf").alias("n")), "chunk_id", dim)


def embed(rows: DataFrame, model: Callable[[list[str]], np.ndarray], id_col: str, text_col: str, batch: int = 64) -> DataFrame:
    """id_col and vector of each row by any model from texts to rows of a matrix, made unit length. Texts of like length
    go through the model together, shortest first; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [t or "" for t in rows.column(1).to_pylist()]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                v = np.asarray(model([texts[i] for i in part]), np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(part)), pa.array(list(v), pa.list_(pa.float64()))], [id_col, "vector"])

    picked = rows.select(id_col, F.col(text_col).cast("string").alias("__text"))
    return picked.mapInArrow(run, T.StructType([picked.schema[0]]).add("vector", T.ArrayType(T.DoubleType())))


def with_prefix(query: Column, model: Column) -> Column:
    """The instruction that some models were trained to see before a query."""
    # The models and their instruction.
    bge = "Represent this sentence for searching relevant passages: "
    return F.when(model.isin("BAAI/bge-small-en-v1.5", "BAAI/bge-base-en-v1.5"), F.concat(F.lit(bge), query)).otherwise(query)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class _Best:
    """Vectors of queries, and the k best of what they have met so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, _unit(vectors), k
        self.names, self.part, self.cos = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0)), np.zeros((len(ids), 0))

    def add(self, names: np.ndarray, vectors: np.ndarray) -> None:
        """A piece of the vectors meets a piece of the queries at a time; a row is sorted where a vector reaches its last. What
        isn't a number comes last."""
        base, k = _unit(vectors), min(self.k, self.names.shape[1] + len(names))
        kept = [np.concatenate([x, np.full((len(self.ids), k - x.shape[1]), fill, x.dtype)], axis=1) for x, fill in ((self.names, np.iinfo(np.int64).max), (self.part, np.nan), (self.cos, np.nan))]
        step = max(1, CELLS // max(1, len(names)))
        for lo in range(0, len(self.ids), step):
            own = [x[lo : lo + step] for x in kept]
            cos = np.round(np.clip(self.q[lo : lo + step] @ base.T, -1, 1), 12)
            least = own[1][:, -1] - 10.0**-DIGITS
            if len(names) > k:  # the k-th of these alone is as good a bound
                crowded = np.flatnonzero((~(cos < least[:, None])).sum(axis=1) > 4 * k)
                least[crowded] = np.fmax(least[crowded], np.partition(cos[crowded], len(names) - k, axis=1)[:, len(names) - k] - 10.0**-DIGITS)
            row, col = np.divmod(np.flatnonzero(~(cos < least[:, None])), len(names))
            hit = np.unique(row)
            rows = np.concatenate([np.repeat(hit, k), row])
            found = [np.concatenate([x[hit].ravel(), y]) for x, y in zip(own, (names[col], np.round(cos[row, col], DIGITS), cos[row, col]), strict=True)]
            order = np.lexsort((found[0], -found[1], rows))
            rows = rows[order]
            order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
            for x, y in zip(own, found, strict=True):
                x[hit] = y[order].reshape(-1, k)
        self.names, self.part, self.cos = kept

    def rows(self) -> Iterator[pa.RecordBatch]:
        k = self.names.shape[1]
        columns = [pa.array(x) for x in (np.repeat(self.ids, k), self.names.ravel(), self.cos.ravel())]
        yield from pa.table(columns, ["query_id", "chunk_id", "score"]).to_batches(1 << 16)


def _streamed(k: int):
    """Rows sorted by group, those of queries (`asked`) first: the k best vectors of each query in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, best = None, [], None
        for whole in batches:
            group, late = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("group", "late"))
            edges = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (late[1:] != late[:-1])) + 1), whole.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if group[lo] != now:
                    if best:
                        yield from best.rows()
                    now, held, best = group[lo], [], None
                rows = pa.Table.from_batches([whole.slice(lo, hi - lo)])
                if not late[lo]:
                    held.append(rows)
                    continue
                if best is None and held:
                    asked = pa.concat_tables(held)
                    best, held = _Best(asked.column("id").to_numpy(), _rows(asked.column("vector")), k), []
                if best:
                    for at in range(0, rows.num_rows, PIECE):
                        piece = rows.slice(at, PIECE)
                        best.add(piece.column("id").to_numpy(), _rows(piece.column("vector")))
        if best:
            yield from best.rows()

    return run


def _best_of_few(queries: list, k: int):
    """All queries, one block of them, against a task's vectors: a batch at a time, with what is best so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([r["query_id"] for r in queries], np.int64)
        q = _unit(np.array([r["asked"] for r in queries], np.float64))
        names, part, cos = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0)), np.zeros((len(ids), 0))
        for whole in batches:
            step = max(64, CELLS // max(1, len(ids)))
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                own = np.round(np.clip(q @ _unit(_rows(pa.chunked_array([batch.column(1)]))).T, -1, 1), 12)
                names = np.concatenate([names, np.broadcast_to(batch.column(0).to_numpy(), own.shape)], axis=1)
                cos, part = np.concatenate([cos, own], axis=1), np.concatenate([part, np.round(own, DIGITS)], axis=1)
                order = np.lexsort((names, -part), axis=1)[:, :k]
                names, part, cos = (np.take_along_axis(x, order, axis=1) for x in (names, part, cos))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, names.shape[1])), pa.array(names.ravel()), pa.array(cos.ravel())], ["query_id", "chunk_id", "score"])

    return run


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score (cosine), rank: exact search of a stated query set against all vectors. Columns: (query_id,
    vector), (chunk_id, vector).

    Up to QUERY_BLOCK queries go to the tasks that read the vectors, which keep k each: one pass, no shuffle of vectors.
    Of more, a batch is bounded by ASKED components. The vectors are dealt into parts by a hash of the id, and a part's task
    holds a batch of queries while the part's vectors pass by: vectors are shuffled once for each batch, queries once for
    each part, and a part leaves k rows a query; the driver sees counts."""
    # columns of its own, as both sides may come from one table
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("asked")).filter("asked is not null")
    base = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector").filter("vector is not null")
    few = asked.limit(QUERY_BLOCK + 1).collect()  # bounded
    if len(few) <= QUERY_BLOCK:
        found = "query_id long, chunk_id long, score double"
        return top_k(base.mapInArrow(_best_of_few(few, k), found) if few else queries.sparkSession.createDataFrame([], found), k)
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    n, m = asked.count(), base.count()
    n_batches = max(1, -(-n // max(1, ASKED // max(1, len(few[0]["asked"]), k))))
    n_parts = max(-(-m // BASE_BLOCK), min(tasks, -(-m // 256))) or 1

    def dealt(rows: DataFrame, key: str, vector: str, own: int, other: int, group: str, late: bool) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))).alias("other")
        rows = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.pmod(F.xxhash64(key), F.lit(own).cast("long")).alias("own"), every)
        return rows.select(F.expr(group).cast("int").alias("group"), F.lit(late).alias("late"), "id", "vector")

    both = dealt(asked, "query_id", "asked", n_batches, n_parts, f"own * {n_parts} + other", False).unionByName(dealt(base, "chunk_id", "vector", n_parts, n_batches, f"other * {n_parts} + own", True))
    both = both.repartitionById(n_batches * n_parts, F.col("group")).sortWithinPartitions("group", "late")
    return top_k(both.mapInArrow(_streamed(k), "query_id long, chunk_id long, score double"), k)


def dense_topk_sql(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The same with built-in functions only, for at most QUERY_BLOCK queries, which are broadcast; more take the blocks."""
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        return dense_topk(queries, vectors, k)
    pairs = vectors.select("chunk_id", normalise(F.col("vector")).alias("v")).crossJoin(F.broadcast(queries.select("query_id", normalise(F.col("vector")).alias("q"))))
    cos = F.least(F.greatest(dot(F.col("q"), F.col("v")), F.lit(-1.0)), F.lit(1.0))
    return top_k(pairs.select("query_id", "chunk_id", cos.alias("score")), k)
