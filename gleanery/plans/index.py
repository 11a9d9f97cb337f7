"""Queries E6 to E19: approximate indexes."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ann_index, dense
from ..sources.scratch import scratch
from .shared import dense_ctes, query, table, vector_tables


def built(spark, sf_dir):
    asked, vectors = vector_tables(spark, sf_dir)
    return asked, ann_index.build(vectors)


def saved(spark):
    def put(df):
        path = scratch(spark, "beam")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return put


@query()
def e6_kmeans(spark, sf_dir):
    return built(spark, sf_dir)[1].cells.select("cell", F.size("centroid").alias("dim"))


@query()
def e7_ivf_assign(spark, sf_dir):
    return built(spark, sf_dir)[1].codes.select("chunk_id", "cell")


@query()
def e8_pq_train(spark, sf_dir):
    """The codebooks' sub-centroids: m * 2 ** nbits rows."""
    books = built(spark, sf_dir)[1].books
    rows = [(s, c, books[s, c].tolist()) for s in range(books.shape[0]) for c in range(books.shape[1])]
    return spark.createDataFrame(rows, "s int, code int, centroid array<double>")


@query()
def e9_pq_encode(spark, sf_dir):
    return built(spark, sf_dir)[1].codes


@query()
def e10_ivfpq_topk(spark, sf_dir):
    asked, index = built(spark, sf_dir)
    return ann_index.ivfpq_topk(index, asked, 10)


@query()
def e11_oversample_rerank(spark, sf_dir):
    asked, index = built(spark, sf_dir)
    return ann_index.oversampled(index, asked, 10, nprobe=8, oversample=8)


@query()
def e12_graph_build(spark, sf_dir):
    return ann_index.graph(built(spark, sf_dir)[1])


@query()
def e13_graph_topk(spark, sf_dir):
    asked, index = built(spark, sf_dir)
    save = saved(spark)
    return ann_index.graph_topk(index, save(ann_index.graph(index)), asked, 10, save=save)


@query()
def e14_index_stats(spark, sf_dir):
    index = built(spark, sf_dir)[1]
    return ann_index.index_stats(index, ann_index.graph(index))


CUTS = (16, 32, 48, 64)


@query(f"""WITH {dense_ctes(10)}, cuts AS (SELECT unnest({list(CUTS)}) AS dims), part AS (SELECT vec_id, dims, list_transform(embedding, lambda x: CAST(x AS DOUBLE))[1:dims] AS p FROM embeddings, cuts), units AS (SELECT vec_id, dims, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS v FROM part),
found AS (SELECT q.dims, q.vec_id AS query_id, d.vec_id AS chunk_id FROM units q JOIN units d USING (dims) WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.dims, q.vec_id ORDER BY round(least(greatest(list_dot_product(q.v, d.v), -1), 1), 6) DESC, d.vec_id) <= 10),
r AS (SELECT dims, dense.query_id, avg(CASE WHEN f.chunk_id IS NULL THEN 0.0 ELSE 1.0 END) AS r FROM dense CROSS JOIN cuts LEFT JOIN found f USING (dims, query_id, chunk_id) GROUP BY ALL) SELECT dims, round(avg(r), 6) AS recall FROM r GROUP BY dims""")
def e15_ann_recall(spark, sf_dir):
    """Of searches that see the first 16, 32, 48 and all 64 components only."""
    asked, vectors = vector_tables(spark, sf_dir)
    truth = saved(spark)(dense.dense_topk(asked, vectors, 10))

    def cut(rows, n):
        return rows.withColumn("vector", F.slice("vector", 1, n))

    runs = [ann_index.recall(dense.dense_topk(cut(asked, n), cut(vectors, n), 10), truth).select(F.lit(n).alias("dims"), F.round("recall", 6).alias("recall")) for n in CUTS]
    return reduce(DataFrame.unionByName, runs)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1")
def e16_latency_percentiles(spark, sf_dir):
    return ann_index.latency(table(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms")), "event_type").drop("mean")


@query("SELECT vec_id AS chunk_id FROM embeddings ORDER BY md5('9:' || vec_id), vec_id LIMIT 200")
def e17_sample_queries(spark, sf_dir):
    return ann_index.sample_queries(vector_tables(spark, sf_dir)[1], 200, 9).select("chunk_id")


NPROBES, OVERSAMPLES, EFS = (1, 4, 8), (1, 8), (16, 64)


def timed(spark, queries: int, found):
    """A search's result as a table, and the milliseconds a query that it took."""
    began = time.time()
    out = saved(spark)(found)
    return out, round((time.time() - began) * 1000 / max(1, queries), 3)


@query()
def e18_ann_sweep(spark, sf_dir):
    """index, nprobe, oversample, ef, recall, ms_per_query (of the one search that a kind's points share), build_seconds,
    bytes, note: flat, quantised, re-scored and graph indexes over their grids, and a cut of the vectors that isn't one."""
    asked, index = built(spark, sf_dir)
    n, put = asked.count(), saved(spark)
    truth, flat_ms = timed(spark, n, dense.dense_topk(asked, index.vectors, 10))
    met, ms = timed(spark, n, ann_index.sweep(index, asked, truth, 10, NPROBES, OVERSAMPLES))
    cells = ann_index.swept(met, truth, "index", "nprobe", "oversample")
    began = time.time()
    edges = put(ann_index.graph(index))
    linking = round(time.time() - began, 3)
    size = ann_index.index_stats(index, edges).first()
    schema = "index string, nprobe int, oversample int, ef int, recall double, ms_per_query double, build_seconds double, bytes long, note string"
    rows = [("flat", None, None, None, 1.0, flat_ms, 0.0, size.vector_bytes, None)]
    for ef in EFS:
        found, walk_ms = timed(spark, n, ann_index.graph_topk(index, edges, asked, 10, ef=ef, save=put))
        rows.append(("graph", None, None, ef, ann_index.recall(found, truth).first().recall, walk_ms, linking, size.vector_bytes + size.link_bytes, None))
    rows.append(("ivfpq", None, None, None, None, None, None, None, ann_index.bad_m(size.dim, 7)))
    held = F.col("index") == "reranked"
    cells = cells.select(
        "index", "nprobe", "oversample", F.lit(None).cast("int").alias("ef"), "recall", F.lit(ms).alias("ms_per_query"), F.lit(index.seconds).alias("build_seconds"),
        (F.lit(size.hot_bytes) + F.when(held, F.lit(size.vector_bytes)).otherwise(0)).alias("bytes"), F.lit(None).cast("string").alias("note"),
    )
    return cells.unionByName(spark.createDataFrame(rows, schema))


def passages_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), "text")


@query()
def e19_ann_compare(spark, sf_dir):
    """What each index finds for every query, and which of the exact hits it misses, passage by passage."""
    asked, index = built(spark, sf_dir)
    put = saved(spark)
    exact = put(dense.dense_topk(asked, index.vectors, 10))
    walked = ann_index.graph_topk(index, put(ann_index.graph(index)), asked, 10, save=put)
    runs = {"flat": exact, "ivfpq": ann_index.ivfpq_topk(index, asked, 10), "reranked": ann_index.oversampled(index, asked, 10), "graph": walked}
    return ann_index.compared(runs, exact, passages_of(spark, sf_dir)).select("index", "query_id", "chunk_id", "found", "rank", "title", "excerpt")


@query(rf"""WITH {dense_ctes(10)} SELECT 'flat' AS "index", query_id, chunk_id, true AS found, rank, source AS title, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 200) AS excerpt FROM dense LEFT JOIN documents ON doc_id = chunk_id""")
def e19_flat(spark, sf_dir):
    """The rows of the exact index in the comparison."""
    asked, vectors = vector_tables(spark, sf_dir)
    exact = dense.dense_topk(asked, vectors, 10)
    return ann_index.compared({"flat": exact}, exact, passages_of(spark, sf_dir)).select("index", "query_id", "chunk_id", "found", "rank", "title", "excerpt")


# What holds of every index, whatever k-means found.


@query("SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS most_cells, true AS bounded, max(len(embedding)) AS dim FROM embeddings")
def e6_cells_hold(spark, sf_dir):
    index = built(spark, sf_dir)[1]
    most = F.floor(F.sqrt(F.lit(index.vectors.count()))).alias("most_cells")
    return index.cells.agg(F.count("*").alias("n"), F.max(F.size("centroid")).cast("long").alias("dim")).select(most, (F.col("n") <= F.col("most_cells")).alias("bounded"), "dim")


@query("SELECT vec_id AS chunk_id, true AS nearest FROM embeddings")
def e7_cell_is_nearest(spark, sf_dir):
    """No centroid is nearer to a vector than its own cell's."""
    index = built(spark, sf_dir)[1]
    best = ann_index.probes(index, index.vectors.withColumnRenamed("chunk_id", "query_id"), 1).select(F.col("query_id").alias("chunk_id"), "d")
    own = index.codes.select("chunk_id", "cell").join(ann_index.unit_vectors(index.vectors), "chunk_id").join(F.broadcast(index.cells), "cell")  # as many rows as cells
    d = F.aggregate(F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return own.withColumn("own", d).join(best, "chunk_id").select("chunk_id", (F.col("own") <= F.col("d") + 1e-9).alias("nearest"))


@query("SELECT CAST(s AS INTEGER) AS s, CAST(code AS INTEGER) AS code, CAST(dim / 8 AS INTEGER) AS step FROM (SELECT max(len(embedding)) AS dim FROM embeddings), (SELECT unnest(range(8)) AS s), (SELECT unnest(range(16)) AS code)")
def e8_books_hold(spark, sf_dir):
    return e8_pq_train(spark, sf_dir).select("s", "code", F.size("centroid").alias("step"))


@query("SELECT vec_id AS chunk_id, 8 AS m, true AS within FROM embeddings")
def e9_codes_hold(spark, sf_dir):
    codes = built(spark, sf_dir)[1].codes
    return codes.select("chunk_id", F.size("codes").alias("m"), F.forall("codes", lambda c: (c >= 0) & (c < 16)).alias("within"))


@query("SELECT vec_id AS chunk_id, true AS nearest FROM embeddings")
def e9_code_is_nearest(spark, sf_dir):
    """In every sub-space no sub-centroid is nearer to a vector's residual than its code's."""
    index = built(spark, sf_dir)[1]
    parts = ann_index.code_errors(index)
    return parts.groupBy("chunk_id").agg(F.every(F.col("error") <= F.col("least") + 1e-9).alias("nearest"))


@query("SELECT CAST(unnest(range(8)) AS INTEGER) AS s, true AS explained, true AS stationary FROM (SELECT 1)")
def e8_books_fit(spark, sf_dir):
    """In every sub-space the codes leave at most three quarters of the residuals' energy, and no book is improved by a
    hundredth by moving its sub-centroids to the means of what they stand for."""
    parts = ann_index.code_errors(built(spark, sf_dir)[1]).withColumn("energy", F.aggregate("part", F.lit(0.0), lambda a, x: a + x * x))
    of_code = parts.groupBy("s", "code").agg(F.count("*").alias("n"), F.sum("error").alias("error"), F.sum("energy").alias("energy"), *[F.sum(F.get("part", F.lit(i))).alias(f"x{i}") for i in range(8)])
    moved = F.col("energy") - sum((F.coalesce(F.col(f"x{i}"), F.lit(0.0)) ** 2 for i in range(8)), F.lit(0.0)) / F.col("n")  # the error about the means
    sums = of_code.withColumn("moved", moved).groupBy("s").agg(F.sum("error").alias("error"), F.sum("energy").alias("energy"), F.sum("moved").alias("moved"))
    return sums.select("s", (F.col("error") <= 0.75 * F.col("energy")).alias("explained"), (F.col("error") <= 1.01 * F.col("moved")).alias("stationary"))


def hits_hold(found, asked, index):
    """query_id, hits, exact (the scores are the pairs' cosines), of each query."""
    unit = ann_index.unit_vectors(index.vectors)
    q = asked.select("query_id", dense.normalise(F.col("vector")).alias("q"))
    pairs = found.join(unit, "chunk_id").join(q, "query_id")
    exact = F.every(F.abs(F.col("score") - dense.dot(F.col("q"), F.col("v"))) < 1e-6)
    return pairs.groupBy("query_id").agg(F.count("*").alias("hits"), exact.alias("exact"), F.max("rank").cast("long").alias("last"))


TEN = "FROM embeddings WHERE vec_id % 50 = 0"


@query(f"SELECT vec_id AS query_id, CAST(10 AS BIGINT) AS hits, CAST(10 AS BIGINT) AS last, true AS falling {TEN}")
def e10_hits_hold(spark, sf_dir):
    asked, index = built(spark, sf_dir)
    found = ann_index.ivfpq_topk(index, asked, 10, nprobe=8)
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: F.round(x["score"], 6))
    falling = F.reverse(F.array_sort(scores)) == scores
    return found.groupBy("query_id").agg(F.count("*").alias("hits"), F.max("rank").cast("long").alias("last"), falling.alias("falling"))


@query(f"SELECT vec_id AS query_id, CAST(10 AS BIGINT) AS hits, true AS exact, CAST(10 AS BIGINT) AS last {TEN}")
def e11_hits_hold(spark, sf_dir):
    asked, index = built(spark, sf_dir)
    return hits_hold(ann_index.oversampled(index, asked, 10, nprobe=8, oversample=8), asked, index)


@query("SELECT vec_id AS src, true AS bounded, true AS others, true AS once FROM embeddings")
def e12_links_hold(spark, sf_dir):
    links = e12_graph_build(spark, sf_dir)
    return links.groupBy("src").agg((F.count("*") <= 32).alias("bounded"), F.every(F.col("src") != F.col("dst")).alias("others"), (F.count("*") == F.count_distinct("dst")).alias("once"))


@query(f"SELECT vec_id AS query_id, CAST(10 AS BIGINT) AS hits, true AS exact, CAST(10 AS BIGINT) AS last {TEN}")
def e13_hits_hold(spark, sf_dir):
    asked, index = built(spark, sf_dir)
    save = saved(spark)
    return hits_hold(ann_index.graph_topk(index, save(ann_index.graph(index)), asked, 10, save=save), asked, index)


@query("SELECT count(*) AS vectors, count(*) * 8 AS code_bytes, 8 AS m, 4 AS nbits, CAST(max(len(embedding)) AS INTEGER) AS dim FROM embeddings")
def e14_sizes_hold(spark, sf_dir):
    return e14_index_stats(spark, sf_dir).select("vectors", F.col("code_bytes").cast("long").alias("code_bytes"), "m", "nbits", "dim")


@query("""SELECT * FROM (SELECT 'reranked' AS "index", nprobe, oversample, NULL::INT AS ef, true AS holds FROM (SELECT unnest([1, 4, 8]) AS nprobe), (SELECT unnest([1, 8]) AS oversample)
 UNION ALL SELECT 'ivfpq', unnest([1, 4, 8]), NULL, NULL, true UNION ALL SELECT 'flat', NULL, NULL, NULL, true UNION ALL SELECT 'graph', NULL, NULL, unnest([16, 64]), true UNION ALL SELECT 'ivfpq', NULL, NULL, NULL, true)""")
def e18_sweep_holds(spark, sf_dir):
    """More probes and more candidates never lower the recall of re-scoring, the flat index finds all, the graph with a wide
    beam nine tenths, and the cut that isn't one has a note instead."""
    rows = e18_ann_sweep(spark, sf_dir)
    wider = F.lead("recall").over(Window.partitionBy("index", "oversample", "ef").orderBy("nprobe"))
    more = F.lead("recall").over(Window.partitionBy("index", "nprobe", "ef").orderBy("oversample"))
    rescored = (F.coalesce(more, F.col("recall")) >= F.col("recall")) & (F.coalesce(wider, F.col("recall")) >= F.col("recall"))
    holds = (
        F.when(F.col("note").isNotNull(), F.col("recall").isNull()).when(F.col("index") == "flat", F.col("recall") == 1).when(F.col("index") == "reranked", rescored)
        .when(F.col("ef") == 64, F.col("recall") >= 0.9).otherwise(F.col("recall").between(0, 1))
    )
    return rows.withColumn("holds", holds).select("index", "nprobe", "oversample", "ef", "holds")


def recalled(spark, sf_dir, found, least: float):
    """Whether the mean recall at 10 reaches a floor."""
    truth = dense.dense_topk(*vector_tables(spark, sf_dir), 10)
    return ann_index.recall(found, truth).select((F.col("recall") >= least).alias("enough"))


@query("SELECT true AS enough")
def e10_recall_holds(spark, sf_dir):
    """0.4 at least from codes of 8 bytes alone, over all cells: twenty times chance on these vectors without structure."""
    asked, index = built(spark, sf_dir)
    return recalled(spark, sf_dir, ann_index.ivfpq_topk(index, asked, 10, nprobe=index.cells.count()), 0.4)


@query("SELECT true AS enough")
def e11_recall_holds(spark, sf_dir):
    """0.9 at least from the cells' better half, with 16 times as many candidates scored again."""
    asked, index = built(spark, sf_dir)
    return recalled(spark, sf_dir, ann_index.oversampled(index, asked, 10, nprobe=max(8, index.cells.count() // 2), oversample=16), 0.9)


@query("SELECT true AS enough")
def e13_recall_holds(spark, sf_dir):
    """0.9 at least from beams of 64."""
    asked, index = built(spark, sf_dir)
    save = saved(spark)
    return recalled(spark, sf_dir, ann_index.graph_topk(index, save(ann_index.graph(index)), asked, 10, ef=64, save=save), 0.9)
