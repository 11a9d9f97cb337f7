"""Inverted-file, product-quantised and graph indexes as tables.

Cells are trained with Spark's k-means. Codebooks are trained on a bounded sample of residuals, one sub-space a task.
Searches take all queries at once: a join on the cell, a fold of each cell's codes, and a last merge of the best.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dense import _rows, dot, normalise
from .lexical import DIGITS, top_k


#: Codes of a cell that one group holds; larger cells are dealt into parts.
PART_ROWS = 50_000
#: Vectors of a cell, and vectors near it, of one group that looks for neighbours.
OWN_ROWS, NEAR_ROWS = 4096, 16_384


@dataclass(frozen=True)
class Index:
    """cells (cell, centroid; about the square root of the number of vectors), codes (chunk_id, cell, codes) and books (m,
    ksub, dsub), whose size doesn't grow with the data."""

    cells: DataFrame
    codes: DataFrame
    books: np.ndarray
    vectors: DataFrame
    nbits: int = 0
    seconds: float = 0.0


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select("chunk_id", normalise(F.col("vector")).alias("v"))


def train_cells(units: DataFrame, nlist: int, seed: int, rounds: int = 25):
    """k-means|| over the vectors in a fixed order; no more cells than vectors."""
    n = units.count()
    data = units.orderBy("chunk_id").select("chunk_id", array_to_vector("v").alias("features"), "v")
    return KMeans(k=max(1, min(nlist, n)), seed=seed, maxIter=rounds, initMode="k-means||").fit(data), data


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 25) -> np.ndarray:
    """Centroids of a bounded sample; as many as asked, the last point repeated if there are fewer points."""
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return np.concatenate([x, np.repeat(x[-1:], k - len(x), axis=0)])
    c = x[rng.integers(len(x))][None]
    far = ((x - c) ** 2).sum(axis=1)
    while len(c) < k:  # each next start is drawn by its squared distance from those there are
        pick = rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))
        c = np.concatenate([c, x[pick][None]])
        far = np.minimum(far, ((x - x[pick]) ** 2).sum(axis=1))
    for _ in range(rounds):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        new = np.array([x[near == i].mean(axis=0) if (near == i).any() else x[d.min(axis=1).argmax()] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c


def train_books(residuals: DataFrame, dim: int, m: int, nbits: int, seed: int, sample: int = 20_000) -> np.ndarray:
    """A codebook for each of m sub-spaces, from at most `sample` residuals picked by a hash of the id."""
    if why := bad_m(dim, m):
        raise ValueError(why)
    step, k = dim // m, 1 << nbits
    picked = residuals.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample)
    parts = picked.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("s"), "residual").select("s", F.slice("residual", F.col("s") * step + 1, step).alias("part"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf.s.iloc[0])
        return pd.DataFrame({"s": [s] * k, "code": range(k), "centroid": list(lloyd(np.stack(pdf.part), k, seed + s))})

    rows = sorted(parts.groupBy("s").applyInPandas(fit, "s int, code int, centroid array<double>").collect())  # m * ksub rows
    return np.array([r["centroid"] for r in rows]).reshape(m, k, step)


def encoded(books: np.ndarray):
    m, _, step = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten(), np.float64).reshape(batch.num_rows, -1)
            codes = [((x[:, s * step : (s + 1) * step, None] - books[s].T[None]) ** 2).sum(axis=1).argmin(axis=1) for s in range(m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(np.stack(codes, axis=1).astype(np.int16)), pa.list_(pa.int16()))], ["chunk_id", "cell", "codes"])

    return run


def build(vectors: DataFrame, nlist: int | None = None, m: int = 8, nbits: int = 4, seed: int = 5) -> Index:
    """Without `nlist`, the square root of the number of vectors, so that cells and what they hold grow alike."""
    began, units = time.time(), unit_vectors(vectors)
    model, data = train_cells(units, nlist or max(1, math.isqrt(units.count())), seed)
    centers = np.array(model.clusterCenters())
    cells = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, centroid array<double>")
    placed = model.transform(data).select("chunk_id", F.col("prediction").alias("cell"), "v")
    residuals = placed.join(F.broadcast(cells), "cell").select("chunk_id", "cell", F.zip_with("v", "centroid", lambda a, b: a - b).alias("residual"))  # nlist rows
    books = train_books(residuals, centers.shape[1], m, nbits, seed)
    codes = residuals.select("chunk_id", "cell", "residual").mapInArrow(encoded(books), "chunk_id long, cell int, codes array<short>")
    return Index(cells, codes, books, vectors, nbits, round(time.time() - began, 3))


def code_errors(index: Index) -> DataFrame:
    """chunk_id, s, code, part (the residual's cut in sub-space s), error (squared distance to the code's sub-centroid) and
    least (to the nearest one): what quantising costs, worked out again from vectors, cells and books."""
    m, _, step = index.books.shape
    books = index.vectors.sparkSession.createDataFrame([(s, index.books[s].tolist()) for s in range(m)], "s int, book array<array<double>>")
    residual = index.codes.join(unit_vectors(index.vectors), "chunk_id").join(F.broadcast(index.cells), "cell").select("chunk_id", "codes", F.zip_with("v", "centroid", lambda a, b: a - b).alias("residual"))  # nlist rows
    parts = residual.select("chunk_id", F.posexplode("codes").alias("s", "code"), "residual").select("chunk_id", "s", "code", F.slice("residual", F.col("s") * step + 1, F.lit(step)).alias("part"))
    squared = F.transform("book", lambda c: F.aggregate(F.zip_with("part", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))
    far = parts.join(F.broadcast(books), "s").withColumn("far", squared)  # m rows
    return far.select("chunk_id", "s", F.col("code").cast("int").alias("code"), "part", F.get("far", F.col("code").cast("int")).alias("error"), F.array_min("far").alias("least"))


def parted(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """codes with the part of its cell that a row is dealt to, and cell, parts. As many rows as there are cells."""
    parts = codes.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    dealt = codes.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts"))).drop("parts")
    return dealt, parts


def probes(index: Index, queries: DataFrame, nprobe: int) -> DataFrame:
    """query_id, v, cell, centroid of each query's nearest cells."""
    q = queries.select("query_id", normalise(F.col("vector")).alias("v")).crossJoin(F.broadcast(index.cells))  # nlist rows
    squared = F.aggregate(F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy("query_id").orderBy(F.round("d", 9), "cell")
    return q.withColumn("d", squared).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= nprobe)


def ivfpq_candidates(index: Index, queries: DataFrame, most: int, nprobe: int) -> DataFrame:
    """query_id, chunk_id, score (by code distances), probe (1: the query's nearest cell): the `most` best of each part of a
    probed cell. Of fewer probes, those with a smaller `probe` are what a search would meet."""
    books = index.books
    m, _, step = books.shape
    kinds = {"query_id": pa.int64(), "chunk_id": pa.int64(), "score": pa.float64(), "probe": pa.int32()}

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            codes = np.asarray(right.column("codes").combine_chunks().flatten()).reshape(right.num_rows, m)
            names, asked, probe = (t.column(c).to_numpy() for t, c in ((right, "chunk_id"), (left, "query_id"), (left, "r")))
            rest = (_rows(left.column("v")) - _rows(left.column("centroid"))).reshape(-1, m, 1, step)
            tables = ((books[None] - rest) ** 2).sum(axis=3)
            for lo in range(0, len(asked), 64):
                d = sum(tables[lo : lo + 64, j][:, codes[:, j]] for j in range(m))
                order = np.lexsort((np.broadcast_to(names, d.shape), np.round(d, DIGITS)), axis=1)[:, :most]
                row = np.repeat(np.arange(len(d)), order.shape[1])
                out.append((asked[lo + row], names[order.ravel()], np.clip(1 - d[row, order.ravel()] / 2, -1, 1), probe[lo + row]))
        return pa.table({c: pa.array(np.concatenate(v) if v else [], t) for (c, t), v in zip(kinds.items(), zip(*out, strict=True) if out else [()] * 4, strict=True)})

    codes, parts = parted(index.codes)
    near = probes(index, queries, nprobe).select("cell", "query_id", "v", "centroid", F.col("r").cast("int").alias("r")).join(F.broadcast(parts), "cell")
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return near.groupBy("cell", "part").cogroup(codes.groupBy("cell", "part")).applyInArrow(fold, "query_id long, chunk_id long, score double, probe int")


def ivfpq_topk(index: Index, queries: DataFrame, k: int, nprobe: int = 4) -> DataFrame:
    """query_id, chunk_id, score, rank by code distances: each probed cell gives its k best for a query."""
    return top_k(ivfpq_candidates(index, queries, k, nprobe).drop("probe"), k)


def rerank(index: Index, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Candidates scored again by their exact cosine."""
    pairs = found.select("query_id", "chunk_id").join(unit_vectors(index.vectors), "chunk_id").join(queries.select("query_id", normalise(F.col("vector")).alias("q")), "query_id")
    return top_k(pairs.select("query_id", "chunk_id", dot(F.col("q"), F.col("v")).alias("score")), k)


def oversampled(index: Index, queries: DataFrame, k: int, nprobe: int = 4, oversample: int = 4) -> DataFrame:
    if oversample < 1:
        raise ValueError("oversample must be 1 or more")
    return rerank(index, queries, ivfpq_topk(index, queries, k * oversample, nprobe), k)


def diverse(sims: np.ndarray, between: np.ndarray, degree: int) -> np.ndarray:
    """Which candidates a vector keeps, for many vectors at once. sims: (rows, candidates), falling, -inf where there is none;
    between: the candidates' similarities to each other. One is kept if it is nearer to the vector than to any kept one; the
    nearest others fill the rest."""
    kept = np.zeros(sims.shape, bool)
    for j in range(sims.shape[1]):
        rival = np.where(kept, between[:, j], -np.inf).max(axis=1)
        kept[:, j] = (sims[:, j] > -np.inf) & (sims[:, j] > rival) & (kept.sum(axis=1) < degree)
    others = ~kept & (sims > -np.inf)
    return kept | (others & (np.cumsum(others, axis=1) <= degree - kept.sum(axis=1, keepdims=True)))


def _linked(degree: int):
    """A block of a cell's vectors against a block of vectors near it: the neighbours that each keeps."""

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            own, names, x, v = left.column("chunk_id").to_numpy(), right.column("other").to_numpy(), _rows(left.column("v")), _rows(right.column("w"))
            for lo in range(0, len(own), 128):
                sim = np.round(x[lo : lo + 128] @ v.T, 9)
                sim[names[None, :] == own[lo : lo + 128, None]] = -np.inf
                order = np.lexsort((np.broadcast_to(names, sim.shape), -sim), axis=1)[:, : 4 * degree]
                near = np.take_along_axis(sim, order, axis=1)
                keep = diverse(near, v[order] @ np.swapaxes(v[order], 1, 2), degree)
                row, col = np.nonzero(keep)
                out.append((own[lo + row], names[order[row, col]], near[row, col]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["src", "dst", "sim"])

    return fold


def graph(index: Index, degree: int = 16, near_cells: int = 3) -> DataFrame:
    """src, dst: each vector's diverse neighbours among those of its own cell and the cells next to it. The vectors of a cell,
    and those near it, are dealt into blocks of bounded rows; each block of the one meets each of the other and leaves
    `degree` neighbours a vector, of which the nearest `degree` over all blocks stay. Links hold both ways; of those that
    come together at a vector, the nearest twice `degree` stay."""
    placed = index.codes.select("chunk_id", "cell").join(unit_vectors(index.vectors), "chunk_id")
    c = index.cells
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = c.select(F.col("cell").alias("home"), F.col("centroid").alias("a")).crossJoin(c.select("cell", F.col("centroid").alias("b")))  # of cells only
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("home").orderBy(gap, "cell"))).filter(F.col("r") <= near_cells).select("home", "cell")
    held = index.codes.groupBy("cell").agg(F.count("*").alias("n"))
    sizes = pairs.join(held, "cell").groupBy("home").agg(F.ceil(F.sum("n") / NEAR_ROWS).alias("rights")).join(held.select(F.col("cell").alias("home"), F.ceil(F.col("n") / OWN_ROWS).alias("lefts")), "home")  # a row a cell

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def dealt(key: str, n: str):
        return F.pmod(F.xxhash64(key), F.col(n))

    left = placed.select(F.col("cell").alias("home"), "chunk_id", "v").join(F.broadcast(sizes), "home").withColumn("l", dealt("chunk_id", "lefts")).withColumn("r", every("rights")).select("home", "l", "r", "chunk_id", "v")
    others = placed.toDF("other", "cell", "w").join(F.broadcast(pairs), "cell").join(F.broadcast(sizes), "home")
    others = others.withColumn("r", dealt("other", "rights")).withColumn("l", every("lefts")).select("home", "l", "r", "other", "w")
    made = left.groupBy("home", "l", "r").cogroup(others.groupBy("home", "l", "r")).applyInArrow(_linked(degree), "src long, dst long, sim double")

    def nearest(rows: DataFrame, most: int) -> DataFrame:
        near = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
        return rows.withColumn("r", near).filter(F.col("r") <= most).drop("r")

    made = nearest(made, degree)
    both = made.unionByName(made.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")).groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    return nearest(both, 2 * degree).select("src", "dst")


def graph_topk(index: Index, edges: DataFrame, queries: DataFrame, k: int, ef: int = 32, save=None) -> DataFrame:
    """Beams of all queries walk the graph together: each round the unexpanded members of every beam meet the edges, new
    vectors are scored, and the best `ef` stay. Ends when no beam has an unexpanded member. `save` writes a round's beams and reads them
    back, which ends their lineage."""
    save = save or (lambda df: df.checkpoint())
    q = queries.select("query_id", normalise(F.col("vector")).alias("q"))
    units = unit_vectors(index.vectors)
    entry = index.codes.groupBy("cell").agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id")

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(units, "chunk_id").join(q, "query_id").select("query_id", "chunk_id", F.round(dot(F.col("q"), F.col("v")), 9).alias("score"))

    def best(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
        return rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(ef, k)).drop("r")

    beam = save(best(scored(q.select("query_id").crossJoin(F.broadcast(entry)))).withColumn("open", F.lit(True)))  # one entry a cell
    while beam.filter("open").limit(1).count():
        ahead = beam.filter("open").join(edges, F.col("chunk_id") == F.col("src")).select("query_id", F.col("dst").alias("chunk_id")).distinct()
        fresh = scored(ahead.join(beam.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")).withColumn("open", F.lit(True))
        beam = save(best(beam.withColumn("open", F.lit(False)).unionByName(fresh)))
    return top_k(beam.select("query_id", "chunk_id", "score"), k)


def index_stats(index: Index, edges: DataFrame | None = None) -> DataFrame:
    """One row: vectors, cells, code bytes, overhead bytes (centroids and books), bytes a vector with and without the overhead, vector_bytes (what
    exact re-scoring reads, as floats), hot_bytes (what a search keeps at hand: codes and overhead), the graph's links and
    their bytes (null without one), the parameters, and the seconds of training."""
    fixed = int(index.books.size * 4)
    dim = index.books.shape[0] * index.books.shape[2]
    out = index.codes.agg(F.count("*").alias("vectors"), F.sum(F.size("codes")).alias("code_bytes"))
    cells = index.cells.agg(F.count("*").alias("cells"), F.sum(F.size("centroid") * 4).alias("cell_bytes"))
    out = out.crossJoin(F.broadcast(cells)).withColumn("overhead_bytes", F.col("cell_bytes") + fixed)  # one row
    links = (edges.agg(F.count("*").alias("links")) if edges is not None else index.cells.agg(F.lit(None).cast("long").alias("links"))).select("links", (F.col("links") * 8).alias("link_bytes"))
    out = out.crossJoin(F.broadcast(links))  # one row
    total = F.col("code_bytes") + F.col("overhead_bytes")
    return out.select(
        "vectors", "cells", "code_bytes", "overhead_bytes", F.round(total / F.col("vectors"), 4).alias("bytes_per_vector"), F.round(F.col("code_bytes") / F.col("vectors"), 4).alias("code_bytes_per_vector"),
        (F.col("vectors") * dim * 4).alias("vector_bytes"), total.alias("hot_bytes"), "links", "link_bytes",
        F.lit(index.books.shape[0]).alias("m"), F.lit(index.nbits).alias("nbits"), F.lit(dim).alias("dim"), F.lit(index.seconds).alias("build_seconds"),
    )


def sweep(index: Index, queries: DataFrame, truth: DataFrame, k: int, nprobes: tuple[int, ...], oversamples: tuple[int, ...]) -> DataFrame:
    """index (ivfpq or reranked), nprobe, oversample (null for ivfpq), query_id, chunk_id, rank at every point of the grid, from one
    search with the most probes. Each point is a cut of what that search met: cells by their place, candidates by code
    distance; exact scores are worked out once."""
    spark = queries.sparkSession
    found = ivfpq_candidates(index, queries, k * max(oversamples), max(nprobes))
    q = queries.select("query_id", normalise(F.col("vector")).alias("q"))
    found = found.join(unit_vectors(index.vectors), "chunk_id").join(q, "query_id").select("query_id", "chunk_id", "score", "probe", dot(F.col("q"), F.col("v")).alias("exact"))
    points = [("ivfpq", p, None) for p in nprobes] + [("reranked", p, o) for p in nprobes for o in oversamples]
    grid = spark.createDataFrame(points, "index string, nprobe int, oversample int")
    met = found.join(F.broadcast(grid), F.col("probe") <= F.col("nprobe"))  # the grid's points
    point = ["index", "nprobe", "oversample", "query_id"]
    by_code = Window.partitionBy(*point).orderBy(F.round("score", DIGITS).desc(), "chunk_id")
    met = met.withColumn("r", F.row_number().over(by_code)).filter(F.col("r") <= k * F.coalesce("oversample", F.lit(1)))
    by_score = Window.partitionBy(*point).orderBy(F.when(F.col("index") == "reranked", F.round("exact", DIGITS)).otherwise(F.round("score", DIGITS)).desc(), "chunk_id")
    return met.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select(*point, "chunk_id", "rank")


def swept(found: DataFrame, truth: DataFrame, *point: str) -> DataFrame:
    """The recall of each point of a sweep that found anything: the mean, over the queries of the truth, of the share of true
    neighbours found."""
    n = truth.groupBy("query_id").agg(F.count("*").alias("n"))
    true = truth.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    hits = found.select(*point, "query_id", "chunk_id").join(true, ["query_id", "chunk_id"], "left").groupBy(*point, "query_id").agg(F.count("hit").alias("hits"))
    total = n.agg(F.count("*").alias("queries"))
    shares = hits.join(n, "query_id").groupBy(*point).agg(F.sum(F.col("hits") / F.col("n")).alias("share"))
    return shares.crossJoin(F.broadcast(total)).select(*point, (F.col("share") / F.col("queries")).alias("recall"))  # one row


def bad_m(dim: int, m: int) -> str | None:
    """Why vectors can't be cut into m parts; None if they can."""
    return None if 0 < m <= dim and dim % m == 0 else f"m must divide {dim}: {', '.join(str(i) for i in range(1, dim + 1) if dim % i == 0)}"


def compared(runs: dict[str, DataFrame], exact: DataFrame, passages: DataFrame, most: int = 200) -> DataFrame:
    """index, query_id, chunk_id, found, rank, title, excerpt: what each index finds, and what it misses of the exact hits
    (found false, rank that of the exact one), with the passage (chunk_id, title, text) behind each."""
    rows = None
    for name, found in runs.items():
        hits = found.select(F.lit(name).alias("index"), "query_id", "chunk_id", F.lit(True).alias("found"), "rank")
        lost = exact.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        both = hits.unionByName(lost.select(F.lit(name).alias("index"), "query_id", "chunk_id", F.lit(False).alias("found"), "rank"))
        rows = both if rows is None else rows.unionByName(both)
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return rows.join(passages.select("chunk_id", "title", F.substring(flat, 1, most).alias("excerpt")), "chunk_id", "left")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the mean share of each query's true neighbours that were found, itself included if it is one of them."""
    hit = truth.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r")).agg(F.avg("r").alias("recall"))


def latency(ms: DataFrame, by: str) -> DataFrame:
    """p50, p90, p99 and mean of the column ms in each group."""
    p = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return ms.groupBy(by).agg(p.alias("p"), F.avg("ms").alias("mean")).select(by, *[F.round(F.get("p", F.lit(i)), 4).alias(n) for i, n in enumerate(("p50", "p90", "p99"))], F.round("mean", 4).alias("mean"))


def sample_queries(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    return vectors.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("chunk_id").cast("string"))), "chunk_id").limit(n)
