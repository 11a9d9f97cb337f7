"""Search over segments and blocks, few and many queries, sweeps and graphs, beside plain versions."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleanery.functions.text import tokenize
from gleanery.operators import ann_index, dense, evaluate, lexical, runs
from gleanery.sources import files

WORDS = [f"w{i}" for i in range(60)]


def corpus(n, seed):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[: rnd.choice((5, 30, 60))]) for _ in range(rnd.randrange(0, 40)))) for i in range(n)]


def plain_bm25(queries, chunks, k):
    terms = {i: Counter(t.split()) for i, t in chunks}
    n, avgdl = len(chunks), sum(c.total() for c in terms.values()) / len(chunks)
    df = Counter(t for c in terms.values() for t in c)
    out = {}
    for q, text in queries:
        scores = {i: sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / avgdl)) for t in text.split() if c[t]) for i, c in terms.items()}
        best = sorted(((-round(s, 6), i) for i, s in scores.items() if s > 0))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    return out


def test_segments_and_skipped_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    chunks, queries = corpus(300, 1), [(q, t) for q, t in corpus(25, 2) if t]
    d = spark.createDataFrame(chunks, "chunk_id long, text string")
    q = spark.createDataFrame([*queries, (99, "nowhere"), (98, None)], "query_id long, text string")
    want = {k: v for k, v in plain_bm25(queries, chunks, 7).items() if v}
    index = lexical.append(lexical.append(lexical.build_index(d.filter("chunk_id % 3 = 0")), d.filter("chunk_id % 3 = 1")), d.filter("chunk_id % 3 = 2"))
    read: dict = {}
    assert ranked(lexical.bm25(q, index, 7, prune=True, read=read)) == want
    assert ranked(lexical.bm25(q, index, 7)) == ranked(lexical.bm25(q, d, 7)) == want
    assert index.postings.count() == sum(len(set(t.split())) for _, t in chunks)
    assert ranked(lexical.bm25(q, lexical.open_index(spark, index.folder), 500, prune=True)) == {k: v for k, v in plain_bm25(queries, chunks, 500).items() if v}
    assert lexical.bm25(q, d.limit(0), 3).count() == 0 and lexical.bm25(q.limit(0), index, 3, prune=True).count() == 0


def test_parts_send_only_their_best(spark, monkeypatch):
    """Batches of queries meet parts of blocks; a part sends k rows a query, not a row for each chunk that holds a term."""
    for name, value in {"BLOCK": 40, "PART_CHUNKS": 80, "QUERIES": 7, "CELLS": 200}.items():
        monkeypatch.setattr(lexical, name, value)
    chunks, queries = corpus(400, 5), [(q, t) for q, t in corpus(30, 6) if t]
    d, q = spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    index = lexical.append(lexical.build_index(d.filter("chunk_id < 300")), d.filter("chunk_id >= 300"))
    parts = lexical.best_of_parts(lexical.weighed_terms(q, index), index, 3).groupBy("query_id").count().collect()
    assert max(r["count"] for r in parts) <= 3 * (4 + 2) < 100
    assert ranked(lexical.bm25(q, index, 3)) == {k: v for k, v in plain_bm25(queries, chunks, 3).items() if v}
    assert index.blocks.select("segment", "block").distinct().count() > 9


def shuffled(spark, job):
    """Bytes that a job's stages write to shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    job()
    return sum(v for k, v in stages().items() if k not in before)


def test_postings_move_once_for_all_queries(spark):
    """Eight times as many queries of the same terms: the postings are not dealt out again for each batch of them."""
    rnd = random.Random(3)
    texts = spark.createDataFrame([(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(60))) for i in range(3000)], "chunk_id long, text string")
    index = lexical.build_index(texts)
    asked = lambda n: lexical.weighed_terms(spark.createDataFrame([(i, f"w{i % 400}") for i in range(n)], "query_id long, text string"), index).localCheckpoint()
    few, many = (shuffled(spark, lambda t=t: lexical.best_of_parts(t, index, 1).write.format("noop").mode("overwrite").save()) for t in (asked(800), asked(6400)))
    assert 0 < many < 2 * few


def test_common_terms_are_skipped(spark):
    """A rare term decides: the postings of the common one are looked up for few chunks only."""
    rows = [(i, "common " * (1 + i % 3) + ("rare " * (1 + i % 4) if i % 40 == 0 else "other")) for i in range(2000)]
    index, read = lexical.build_index(spark.createDataFrame(rows, "chunk_id long, text string")), {}
    found = lexical.bm25(spark.createDataFrame([(1, "rare common")], "query_id long, text string"), index, 5, prune=True, read=read)
    assert ranked(found) == plain_bm25([(1, "rare common")], [(i, t.strip()) for i, t in rows], 5)
    assert read["needed"] + read["looked_up"] < read["all"] / 5


def test_vectors_of_an_index(spark):
    d = spark.createDataFrame(corpus(50, 3), "chunk_id long, text string")
    a, b = (sorted((r.chunk_id, tuple(np.round(r.vector, 9))) for r in x.collect()) for x in (dense.hashed_vectors(d, "chunk_id", "text"), dense.indexed_vectors(lexical.build_index(d))))
    assert a == b and len(a) > 40


def test_few_and_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((700, 8)), 1)  # with ties
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(700, None)], "chunk_id long, vector array<double>").repartition(3)
    q = d.filter("chunk_id % 20 = 0").toDF("query_id", "vector")
    few = sorted(map(tuple, dense.dense_topk(q, d, 5).collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 10)
    assert sorted(map(tuple, dense.dense_topk(q, d, 5).collect())) == few and len(few) == 36 * 5 - 5
    assert dense.dense_topk(q.limit(0), d, 5).count() == 0 == dense.dense_topk(q, d.limit(0), 5).count()


def test_vectors_move_once_for_all_queries(spark, monkeypatch):
    """Eight times as many queries: the vectors are not dealt out again for each block of them."""
    monkeypatch.setattr(dense, "QUERY_BLOCK", 8)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(2).standard_normal((2000, 32)))], "chunk_id long, vector array<double>").localCheckpoint()
    asked = lambda n: d.filter(f"chunk_id < {n}").toDF("query_id", "vector")
    few, many = (shuffled(spark, lambda n=n: dense.dense_topk(asked(n), d, 1).write.format("noop").mode("overwrite").save()) for n in (16, 128))
    assert 0 < many < 2 * few


def vectors(spark, n=400, dim=16):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((12, dim))[rng.integers(12, size=n)] + 0.35 * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")


def test_sweep_is_what_its_tables_say(spark):
    """Each point of the grid against numpy over the same cells, codes and books."""
    x, d = vectors(spark)
    index = ann_index.build(d, m=4, nbits=3)
    asked = d.filter("chunk_id % 40 = 0").toDF("query_id", "vector")
    truth = dense.dense_topk(asked, d, 5)
    found = ann_index.sweep(index, asked, truth, 5, (1, 3), (1, 4))
    got = {(r["index"], r.nprobe, r.oversample): r.recall for r in ann_index.swept(found, truth, "index", "nprobe", "oversample").collect()}
    cells = np.array([r.centroid for r in index.cells.orderBy("cell").collect()])
    codes = {r.chunk_id: (r.cell, np.array(r.codes)) for r in index.codes.collect()}
    exact = {}
    for r in truth.collect():
        exact.setdefault(r.query_id, set()).add(r.chunk_id)
    for (kind, nprobe, oversample), share in got.items():
        shares = []
        for q, want in exact.items():
            near = np.argsort(np.round(((cells - x[q]) ** 2).sum(axis=1), 9), kind="stable")[:nprobe]
            dist = {}
            for c, (cell, code) in codes.items():
                if cell in near:
                    rest = (x[q] - cells[cell]).reshape(4, -1)
                    dist[c] = 1 - sum(((index.books[s, code[s]] - rest[s]) ** 2).sum() for s in range(4)) / 2
            met = sorted(dist, key=lambda c: (-round(min(1, max(-1, dist[c])), 6), c))[: 5 * (oversample or 1)]
            best = sorted(met, key=lambda c: (-round(float(x[q] @ x[c]), 6), c))[:5] if kind == "reranked" else met[:5]
            shares.append(len(want & set(best)) / len(want))
        assert abs(share - np.mean(shares)) < 1e-9
    assert len(got) == 6 and got["reranked", 3, 4] >= got["reranked", 1, 1]


def test_graph_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann_index, "OWN_ROWS", 10)
    monkeypatch.setattr(ann_index, "NEAR_ROWS", 40)
    x, d = vectors(spark)
    index = ann_index.build(d)
    edges = ann_index.graph(index, degree=6).cache()
    assert edges.groupBy("src").count().agg(F.max("count"), F.count("*")).first() == (12, 400) and edges.filter("src = dst").count() == 0
    asked = d.filter("chunk_id % 10 = 0").toDF("query_id", "vector")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    found = ann_index.graph_topk(index, edges, asked, 10, ef=40)
    assert ann_index.recall(found, dense.dense_topk(asked, d, 10)).first().recall >= 0.9


def test_diverse_is_the_greedy_rule():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 12, 5))
    x = rng.standard_normal((40, 5))
    sims = np.einsum("rcd,rd->rc", v, x)
    order = np.argsort(-sims, axis=1)
    v, sims = np.take_along_axis(v, order[:, :, None], axis=1), np.take_along_axis(sims, order, axis=1)
    sims[:5, 8:] = -np.inf
    got = ann_index.diverse(sims, v @ np.swapaxes(v, 1, 2), 4)
    for r in range(40):
        there, kept = [i for i in range(12) if sims[r, i] > -np.inf], []
        for i in there:
            if len(kept) < 4 and all(sims[r, i] > v[r, i] @ v[r, j] for j in kept):
                kept.append(i)
        kept += [i for i in there if i not in kept][: 4 - len(kept)]
        assert sorted(kept) == np.flatnonzero(got[r]).tolist()


def test_comparison_and_sizes(spark):
    x, d = vectors(spark, 60)
    asked = d.filter("chunk_id = 0").toDF("query_id", "vector")
    exact = dense.dense_topk(asked, d, 3)
    passages = spark.createDataFrame([(i, f"t{i}", f"  some \n text {i} " + "x" * 300) for i in range(59)], "chunk_id long, title string, text string")
    rows = ann_index.compared({"flat": exact, "none": exact.limit(0)}, exact, passages).collect()
    assert sorted((r["index"], r.found) for r in rows) == [("flat", True)] * 3 + [("none", False)] * 3
    assert all(len(r.excerpt) == 200 and r.excerpt.startswith("some text") for r in rows if r.chunk_id < 59)
    assert ann_index.bad_m(64, 8) is None and "1, 2, 4" in ann_index.bad_m(64, 7)


def test_composed_terms(spark):
    rows = spark.createDataFrame([(1, "café Ångström"), (2, "café Ångström"), (3, None), (4, "plain")], "i int, t string")
    got = {r.i: r.x for r in rows.select("i", tokenize(F.col("t")).alias("x")).collect()}
    assert got[1] == got[2] == ["café", "ångström"] and got[3] is None and got[4] == ["plain"]


def test_modes_that_find_nothing(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    rel = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id long, unit string")
    hits = spark.createDataFrame([("m", 1, u, r) for r, u in enumerate("xaxyzwb", 1)] + [("m", 2, "c", 1)], "mode string, query_id long, unit string, rank int")
    rows, failed = evaluate.grade_modes(q, hits, rel, ["m", "none"])
    got = {(r.mode, r.query_id): (r.hit_at_1, r.recall_at_5) for r in rows.collect()}
    assert got == {("m", 1): (0.0, 0.5), ("m", 2): (1.0, 1.0), ("none", 1): (0.0, 0.0), ("none", 2): (0.0, 0.0)}
    assert sorted((r.mode, r.query_id, r.expected, r.got) for r in failed.collect()) == [("m", 1, ["a", "b"], ["x", "a", "y", "z", "w"]), ("none", 1, ["a", "b"], []), ("none", 2, ["c"], [])]


def test_golden_questions(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id":"1","kind":"exact","answerable":true,"question":"a?","relevant_docs":["d","d"]}\n{"id":"2","question":"b?","relevant_docs":["d"],"relevant_pages":{"d":[1,2],"e":[3]}}\n{"id":"3","answerable":false,"question":"c?"}\n')
    questions, units = files.read_golden(spark, str(tmp_path / "g.jsonl"))
    assert questions.count() == 3
    assert sorted(map(tuple, units.collect())) == [("1", "d"), ("2", "d#p1"), ("2", "d#p2"), ("2", "e#p3")]


def test_summaries_of_nothing(spark):
    schema = "kind string, set string, answerable boolean, turns int, truncated boolean, usage struct<cost_usd:double>, grade struct<hit_at_1:double,recall_first:double,recall_union:double,named:double,searches:int>, judge struct<faithfulness:double,relevance:double,declined:boolean>, citations struct<valid:boolean,dangling:array<int>>"
    none = spark.createDataFrame([], schema)
    assert runs.judge_summary(none).first().asDict() == {"graded": 0, "faithfulness": None, "relevance": None, "false_abstention": None, "correct_abstention": None, "citations_valid": None, "dangling_citations": 0, "truncated": 0, "cost_usd": 0.0}
    one = spark.createDataFrame([("k", "s", False, 2, True, (0.5,), (1.0, 1.0, 1.0, 1.0, 3), (0.9, 0.8, True), (True, [1])), ("k", "s", None, 4, False, (None,), (1.0, 0.5, 1.0, None, 1), None, (False, []))], schema)
    row = runs.run_summary(one).filter("kind is null and set is null").first()
    assert (row.questions, row.hit_at_1, row.recall_first, row.named, row.searched_twice, row.turns_per_question, row.cost_usd) == (2, 1.0, 0.5, 0.0, 1, 3.0, 0.5)
    assert (row.faithfulness, row.false_abstention, row.correct_abstention, row.citations_valid) == (None, None, 1.0, 1.0)
