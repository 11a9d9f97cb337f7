"""Fuzzes against the libraries, plain versions of the models, corpus SQL on small tables, and edge cases."""

import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import ann, langid, neardup, packing, pii, queries, simhash, sql, substring, tokencount, toxicity

ODD = list(" \t\n\r\x00\x0b\x1c\x85\xa0ab,<>s/ẞ①éñ½²İİſﬁ́'中あ한😀\U0010ffff")


def texts(words, n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) if r.random() < 0.6 else r.choice(words) for _ in range(r.randrange(12))) for _ in range(n)]


def test_token_counts_of_random_texts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    words = [sp.id_to_piece(i).replace("▁", " ") for i in range(260, 31999, 7)] + ["<s>", "<unk>", "<0x0A>", "▁"]
    rows = [*texts(words, 8000, 1), "\tas", "dẞé", "①ns", "a" * 4000, "\t" * 300 + "as"]
    assert tokencount.PieceCounter(P.path("piece_bpe_32k.model")).count_all(rows) == [len(sp.encode(t)) for t in rows]


def test_word_encoder_of_random_texts():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = texts(["<|endoftext|>", "don't", "we'll", "World!!!", "STRASSE", "x,%%%", "naïve."], 4000, 2)
    known, plain = packing.WordEncoder(path, 500), Tokenizer.from_file(path)
    for lo in range(0, len(rows), 250):  # more keys than are kept
        ids, ends = known.encode(pa.array([*rows[lo : lo + 250], None]))
        want = [e.ids for e in plain.encode_batch([*rows[lo : lo + 250], ""], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def best_mixture(log, penalty):
    """The languages and proportions of least penalised cost, over all sets of languages, by plain EM."""
    n, langs = log.shape
    best = None
    for size in range(1, langs + 1):
        for chosen in combinations(range(langs), size):
            own, pi = np.exp(log[:, chosen]), np.full(size, 1 / size)
            for _ in range(300):
                r = own * pi
                pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            cost = penalty * np.log(n) * size - np.log(own @ pi).sum()
            if best is None or cost < best[0] - 1e-9:
                best = cost, dict(zip(chosen, pi, strict=True))
    return best[1]


def test_mixtures_are_the_best_ones():
    rng = np.random.default_rng(4)
    for case in range(30):
        shares = [[1.0, 0, 0], [0.6, 0.4, 0], [0.5, 0.25, 0.25]][case % 3]
        log = np.full((60, 3), -12.0) + rng.normal(0, 1.5, (60, 3))
        log[np.arange(60), rng.choice(3, 60, p=shares)] += 8
        got, want = langid.mixture(log, 2.0), best_mixture(log, 2.0)
        assert set(got) == set(want) and all(abs(got[m] - want[m]) < 0.02 for m in got)


def test_language_needs_letters_and_carries_all_rows(spark):
    model = langid.Model([("en", " th", 9), ("en", "the", 9), ("de", " de", 9), ("de", "der", 9)], 0.5)
    rows = [(1, "²½ 12"), (2, "the²the"), (3, "the der"), (3, "the der"), (4, "the " * 60000), (None, "the"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id long, text string, mixture string, score int")
    got = langid.predict(docs, model).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(rows) and by[1] == by[5] == by[6] == "und" and by[2] == by[4] == by[None] == "en"
    tie = {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 3}
    assert len(tie) == 1 and tie.pop()[0] in ("de", "en")


def plain_regression(x, grade, weight, grades, l1, l2):
    """The same objective by small plain gradient steps on dense features."""
    n, w = len(grade), np.zeros(x.shape[1])
    share = np.cumsum(np.bincount(grade, weight, minlength=grades))[:-1] / weight.sum()
    cuts, weight = np.log(share / (1 - share)), weight / weight.sum()

    def loss(w, cuts):
        s = 1 / (1 + np.exp(-(np.r_[-np.inf, cuts, np.inf][None, :] - (x @ w)[:, None])))
        return -(weight * np.log(np.maximum(np.diff(s, axis=1)[np.arange(n), grade], 1e-9))).sum() + l2 / 2 * (w**2).sum() + l1 * np.abs(w).sum()

    with np.errstate(over="ignore"):
        for _ in range(3000):
            g = np.array([(loss(w + d, cuts) - loss(w - d, cuts)) / 2e-5 for d in np.eye(len(w)) * 1e-5])
            h = np.array([(loss(w, cuts + d) - loss(w, cuts - d)) / 2e-5 for d in np.eye(len(cuts)) * 1e-5])
            w, cuts = w - 0.5 * g, cuts - 0.5 * h
        return w, cuts, loss


def test_regression_reaches_the_least_cost():
    rng = np.random.default_rng(6)
    x = (rng.random((300, 5)) < 0.4).astype(float)
    grade = np.digitize(x @ [2.0, 1.0, 0, -1, 0.5] + rng.logistic(size=300), [0.5, 2.0])
    row, column = np.nonzero(x)
    weight = np.ones(300)
    w, cuts = toxicity.regress(row, column, grade, weight, 5, 3, l1=1e-4, l2=1e-3, rounds=3000)
    want_w, want_cuts, loss = plain_regression(x, grade, weight, 3, 1e-4, 1e-3)
    assert loss(w, cuts) <= loss(want_w, want_cuts) + 1e-3
    assert np.abs(w - want_w).max() < 0.1 and np.abs(cuts - want_cuts).max() < 0.1


def test_toxicity_edges(spark):
    rows = [(i, "bad word here" if i % 2 else "sun and moon") for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in [*rows, *[(1, "sun " * 5)] * 50]], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, grades=2, least_z=2.0)
    asked = spark.createDataFrame([(1, "bad " * 40000), (1, "bad"), (1, "bad"), (None, None), (2, "")], "doc_id long, text string")
    got = toxicity.grade(asked, model).collect()
    assert len(got) == 5 and [r["toxic"] for r in got if r["doc_id"] == 1] == [True] * 3 and not any(r["toxic"] for r in got if r["doc_id"] != 1)


def test_nearest_prunes_and_keeps_the_least_distance(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[8].tolist()), (7, x[9].tolist())]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cls", F.lit("k"))
    asked = e.filter("vec_id % 100 = 0")
    got = ann.nearest(e, asked, k=10).collect()
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[7] = min(d[7], d[8], d[9])
        d[q] = np.inf
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(own) == 10 and np.allclose([r["score"] for r in own], d[[r["vec_id"] for r in own]], rtol=0, atol=1e-12)
        hit += len({r["vec_id"] for r in own} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hit >= 0.9 * 300
    few = ann.nearest(e.limit(4), asked.limit(1), k=10, tables=1, probes=1)  # too few for any probe
    assert few.count() == min(3, e.limit(4).filter("vec_id <> 0").count())


def test_a_query_meets_a_part_of_the_rows():
    x = np.random.default_rng(9).standard_normal((4000, 64)).astype(np.float32)
    best, axes = ann.combined(x, 0, 2, 1, 7)
    probed, _ = ann.combined(x[:50], 0, 2, 19**2, 7)
    share = np.mean([np.isin(best[:, 0], p).mean() for p in probed])
    assert ann.hashes_for(10**6, 64) == 2 and ann.hashes_for(10**8, 64) == 3 and axes == 128 and share < 0.1


def test_windows_are_told_apart_by_both_hashes():
    one, two = np.array([5, 5, 5, 9, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)
    order, same = substring.alike(one, two)
    runs = np.split(order, np.flatnonzero(~same) + 1)
    assert sorted(map(sorted, map(np.ndarray.tolist, runs))) == [[0, 2], [1, 4], [3]]
    assert substring.second_bits(0) >= 0 and substring.second_bits(10**9) > substring.second_bits(10**6) and substring.second_bits(10**17) == 64


ROWS = [(i, f"item {i} of the board. Zorblax called +1 (389) 555-5010 at z@x.org 10.0.0.{i} 4111 1111 1111 1111") for i in range(5)]
ROWS += [(i, f"the board met for item {i} called board. " + " ".join(f"w{k}" for k in range(i, i + 50))) for i in range(10, 40)]
ROWS += [(50, None), (51, ""), (52, "é" * 200), (52, "é" * 200), (53, "a@b.co " * 400), (54, " ".join(f"w{k}" for k in range(20, 59)))]
VECTORS = np.random.default_rng(3).standard_normal((120, 8))
VECTORS[20:60] = VECTORS[20] + np.random.default_rng(4).standard_normal((40, 8)) * 0.25


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_queries_match_their_sql(spark, tmp_path, name):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    vecs = [(i, v.tolist(), 0) for i, v in enumerate(VECTORS)] + [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] * 8, 0)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "the board met"), (2, ROWS[-1][1]), (3, None)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "u", f"<p>{i % 3}") for i in range(9)] + [(10, "u", None), (11, "u", "")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = c.execute(sql.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = queries.queries()[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))


def test_terms_follow_their_information(spark):
    """Added spans against plain counts."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    words = [(i, re.findall(r"[^\W\d_]{3,}", (t or "").lower())) for i, t in ROWS]
    seen, n = Counter(w for _, ws in words for w in set(ws)), len(ROWS)
    holding = {i for i, t in ROWS if t and "z@x.org" in t}
    terms = {w for w in seen if (k := sum(w in ws for i, ws in words if i in holding)) >= 3 and np.log2(k * n / (len(holding) * seen[w])) / np.log2(n / len(holding)) >= 0.9}
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    marked = [(s, e) for k, s, e in (x.split(":") for x in got[0]["spans"].split(",")) if k == "term"]
    assert {ROWS[0][1][int(s) : int(e)].lower() for s, e in marked} == terms - {"org"} and "zorblax" in terms
    assert pii.sanitise(docs, keep=["doc_id", "text"]).filter("doc_id = 53").first()["text"] == "[EMAIL] " * 400


def test_copies_of_an_id_with_other_columns(spark):
    rows = [(1, "same words in both", "a"), (1, "quite another text of its own", "b"), (1, "same words in both", "c"), (None, None, "d"), (None, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert simhash.one_of_each(docs).count() == 3 and simhash.one_of_each(docs).columns == ["doc_id", "text", "fp"]
    assert simhash.near_duplicates(docs).count() == 5


def test_embedding_rows_that_repeat(spark):
    v = [1.0, 2.0, 3.0]
    e = spark.createDataFrame([(4, v, "x"), (4, v, "y"), (2, v, "z"), (9, [3.0, -2.0, 0.5], "z")], "vec_id long, embedding array<float>, cls string")
    got = sorted(map(tuple, neardup.near_duplicates(e).collect()))
    assert got == [(2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False), (9, 0, 9, True)]


def test_pipeline_of_an_empty_table_and_clashing_columns(spark):
    import corpus_pipeline
    from gleanery.llm.common import written

    full = "doc_id long, text string, lang string, source string, n_chars long, k1 string, c0 int, spans int"
    for rows in ([], [(None, "ein wort und noch eins", "de", None, None, "k", 1, 2), (3, "ein wort und noch eins", "de", "s", 4, "k", 1, 2), (4, None, None, None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, full)
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, ""), name)
        assert docs.select("doc_id").distinct().count() == (1 if rows else 0)
