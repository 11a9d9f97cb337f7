"""Vector indexes against brute force."""

import numpy as np
import pytest

from gleanery.operators import ann_index, dense


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((12, 16)), 25, axis=0) + rng.standard_normal((300, 16)) * 0.6
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    index = ann_index.build(vectors, m=4, nbits=4)
    codes = index.codes.toPandas().sort_values("chunk_id")
    asked = vectors.filter("chunk_id % 30 = 0").withColumnRenamed("chunk_id", "query_id")
    return u, vectors, index, codes, asked


def test_cells_are_the_nearest(world):
    u, _, index, codes, _ = world
    c = np.stack(index.cells.toPandas().sort_values("cell").centroid)
    d = ((u[:, None] - c[None]) ** 2).sum(axis=2)
    assert len(c) == 17 and np.allclose(d[np.arange(300), codes.cell], d.min(axis=1))


def test_codes_are_the_nearest(world):
    u, _, index, codes, _ = world
    c = np.stack(index.cells.toPandas().sort_values("cell").centroid)
    rest = (u - c[codes.cell]).reshape(300, 4, 4)
    d = ((index.books[None] - rest[:, :, None]) ** 2).sum(axis=3)
    assert (np.stack(codes.codes) == d.argmin(axis=2)).mean() > 0.999
    assert ((index.books - index.books.mean(axis=1, keepdims=True)) ** 2).sum() > 0


def truth(u, asked, k=10):
    return {q: set(np.lexsort((np.arange(300), -np.round(u @ u[q], 6)))[:k].tolist()) for q in asked}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], set()).add(r["chunk_id"])
    return out


def test_searches_find_what_brute_force_does(spark, world, monkeypatch):
    u, vectors, index, _, asked = world
    want = truth(u, range(0, 300, 30))
    assert found(dense.dense_topk(asked, vectors, 10)) == want
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    monkeypatch.setattr(dense, "BASE_BLOCK", 40)
    assert found(dense.dense_topk(asked, vectors, 10)) == want
    monkeypatch.setattr(ann_index, "PART_ROWS", 7)
    got = found(ann_index.oversampled(index, asked, 10, nprobe=17, oversample=8))
    assert np.mean([len(got[q] & want[q]) / 10 for q in want]) >= 0.9
    plain = found(ann_index.ivfpq_topk(index, asked, 10, nprobe=17))
    assert all(len(v) == 10 for v in plain.values())


def test_the_graph_is_bounded_and_leads_to_the_nearest(spark, world, tmp_path):
    u, _, index, _, asked = world
    edges = ann_index.graph(index, degree=8)
    out = edges.groupBy("src").count().collect()
    assert len(out) == 300 and max(r["count"] for r in out) <= 16

    def save(df, n=iter(range(1000))):
        path = f"{tmp_path}/beam{next(n)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    got, want = found(ann_index.graph_topk(index, save(edges), asked, 10, save=save)), truth(u, range(0, 300, 30))
    assert np.mean([len(got[q] & want[q]) / 10 for q in want]) >= 0.9


def test_statistics_name_the_parameters(world):
    r = ann_index.index_stats(world[2]).first()
    assert (r["vectors"], r["cells"], r["m"], r["nbits"], r["dim"]) == (300, 17, 4, 4, 16) and r["build_seconds"] > 0
