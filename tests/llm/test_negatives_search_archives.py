"""Hard negatives, ranked search and archives against plain versions, on tables with nulls, ties and repeats; recall by the
number of hashes; long runs; lists that recur as a whole."""

import base64
import gzip
import hashlib
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gleanery.llm import ann, maxsketch, negatives, pii, tokencount, warc
from gleanery.llm.sql import OP11, OP12, OP13

INF, NAN = float("inf"), float("nan")


def key(row):
    return tuple((x is None, 0 if x is None else x) for x in row)


def same(found, want):
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, want), key=key)


def plain_negatives(rows, every, low=30, high=90, most=5, first=10):
    known = {}
    for i, v, label in rows:
        if None not in (i, v, label) and not any(x is None or not math.isfinite(x) for x in v):
            own = (label, [math.floor(256 * x) for x in v])
            known[i] = min(known.get(i, own), own)
    for a, (label, v) in known.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, (_, w) in known.items() if i != a)
        for p, i in [x for x in scored if known[x[1]][0] == label][:most]:
            fit = [(s, j) for s, j in scored if known[j][0] != label and low * -p <= 100 * -s <= high * -p][:first]
            yield from ((a, i, r, j, -p, -s) for r, (s, j) in enumerate(fit, 1))


def labelled(n=400, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [round(float(x), 1) for x in v], int(rng.integers(3))) for i, v in zip(rng.permutation(n), rng.standard_normal((n, dim)), strict=True)]
    rows += [(None, [1.0] * dim, 1), (1000, None, 1), (1010, [1.0] * dim, None), (1020, [NAN] + [1.0] * (dim - 1), 1), (1030, [INF] + [0.0] * (dim - 1), 1), (1040, [None] + [1.0] * (dim - 1), 1), (1050, [0.0] * dim, 1)]
    return rows + rows[:3] + [(rows[0][0], [9.0] * dim, 0), (-20, [0.5] * dim, 2)]


@pytest.mark.parametrize("blocks", [(4096, 512, 256), (64, 8, 16)])
def test_hard_negatives(spark, monkeypatch, blocks):
    for name, size in zip(("ROWS", "ANCHORS", "FEWEST"), blocks, strict=True):
        monkeypatch.setattr(negatives, name, size)
    rows = labelled()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, score string, block int").repartition(4)
    got = negatives.mine(table, anchors=lambda i: i % 20 == 0).collect()
    same(got, plain_negatives(rows, 20))
    assert len({r.anchor_id for r in got}) > 15 and any(r.anchor_id == -20 for r in got)
    same(negatives.mine(table, anchors=lambda i: i % 50 == 0, positives=2, negatives=3, low=0, high=100).collect(), plain_negatives(rows, 50, 0, 100, 2, 3))
    assert negatives.mine(table.limit(0), anchors=lambda i: i % 20 == 0).count() == 0


def test_scores_are_whole_numbers():
    rng = np.random.default_rng(1)
    for most in (1 << 8, 1 << 24, 1 << 28):
        a, b = rng.integers(-most, most, (5, 16)), rng.integers(-most, most, (7, 16))
        assert negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    with pytest.raises(ValueError):
        negatives.products(np.full((1, 4), 1 << 31), np.full((1, 4), 1 << 31))


def test_packed_keys_sort_as_the_walk_needs():
    rnd = random.Random(3)
    rows = [(rnd.randrange(-5, 5), rnd.choice((-(1 << 62), -1, 0, 1, 7, 1 << 62)), rnd.randrange(2), rnd.randrange(-9, 9)) for _ in range(500)]
    assert sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3])) == sorted(rows, key=lambda r: negatives.packed(*r))
    keys = [negatives.packed(1, 0, 0, 5), negatives.packed(1, 0, 1, 2), negatives.packed(1, -4, 1, 3)]
    assert list(negatives.walk(30, 90, 10)((k, None) for k in keys)) == [(1, 5, 1, 2, 0, 0)]  # a positive of 0 takes rows of 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    held = [(i, Counter(TERM.findall((t or "").translate(lower)))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + (25 * c.total() * n) // total if total else 0
            s = sum(w * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall((text or "").translate(lower)) if c[t] and (w := math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) is not None)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        yield from ((item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1))


DOCS = [(1, "The quick brown fox"), (2, None), (3, ""), (4, " \x00\x1f.,;\n"), (5, "the QUICK, the quick! déjà-vu İ"), (5, "the QUICK, the quick! déjà-vu İ"), (6, "日本語 テキスト😀 a_b c`d"), (None, "fox fox fox"), (7, "word " * 30_000), (8, "fox")] + [(100 + i, f"t{i % 7} t{i % 11} filler fox") for i in range(200)]
ITEMS = [(1, "fox quick fox"), (2, None), (3, "nowhere"), (None, "déjà VU"), (4, "日本語 word"), (4, "fox quick fox"), (5, " ".join(f"t{i}" for i in range(12)) + " FILLER fox")]


@pytest.mark.parametrize(("width", "items", "terms", "cells"), [(1 << 14, 2048, 200_000, 4 << 20), (4, 1, 3, 64)])
def test_ranked_search(spark, monkeypatch, width, items, terms, cells):
    for name, size in zip(("ITEMS", "TERMS", "CELLS"), (items, terms, cells), strict=True):
        monkeypatch.setattr(maxsketch, name, size)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, n int, terms string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, q int")
    index = maxsketch.build_index(docs, width=width)
    same(maxsketch.search(index, asked, k=20, width=width).collect(), plain_search(DOCS, ITEMS, 20))
    same(maxsketch.search(index, asked, k=3, width=width).collect(), plain_search(DOCS, ITEMS, 3))
    assert maxsketch.search(index, asked.limit(0), width=width).count() == 0
    assert maxsketch.search(maxsketch.build_index(docs.limit(0), width=width), asked, width=width).count() == 0


def test_bounds_spare_exact_scores(spark, monkeypatch):
    """Sketches bound scores from above, and few documents are scored exactly."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") + rnd.choice("aeiou") + rnd.choice("xyz") for _ in range(rnd.randrange(5, 60))) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = maxsketch.build_index(docs).toArrow().to_batches()[0]
    words = "aax bey cix dox".split()
    held = [type("R", (), {"q": 1, "item_id": 1, "term": w, "times": 1, "df": sum(w in t.split() for t in texts)}) for w in words]
    batch, calls = maxsketch.Batch(held, len(texts), sum(len(t.split()) for t in texts), 1 << 14, 20), []
    monkeypatch.setattr(maxsketch, "impact", lambda tf, m, own=maxsketch.impact: (calls.append(1) if isinstance(tf, int) else None, own(tf, m))[1])
    found = next(iter(maxsketch.best(batch)([rows])))
    want = [(i, s) for _, _, i, s in plain_search(enumerate(texts), [(1, " ".join(words))], 20)]
    assert sorted(zip(found.column(2).to_pylist(), found.column(3).to_pylist(), strict=True)) == sorted(want) and 0 < len(calls) < 600


PAGES = [(1, "http://a", "<p>x"), (2, None, None), (3, "u\r\nEvil: 1", ""), (4, "u", "<p>x"), (5, "u", "<p>x"), (0, "u", "long " * 60_000), (7, "u", "long " * 60_000), (None, "u", "<p>x"), (None, "u", "alone"), (9, "ü", "WARC/1.1\r\n\r\nÿé日本"), (9, "u", "WARC/1.1\r\n\r\nÿé日本")]


def plain_records(pages, least=0):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for i, _, html in pages:
        payload, f = (html or "").encode(), first.get(html or "")
        again = len(payload) >= least and f is not None and (i is None or i > f)
        yield i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", f if again else None


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x", 1) for r in PAGES], "page_id long, url string, html string, payload string, first int").repartition(3)
    for least in (0, 5):
        path = f"{tmp_path}/{least}"
        warc.archive(pages, path, least_bytes=least)
        rows = warc.page_records(spark, path).collect()
        same([r[:5] for r in rows], plain_records(PAGES, least))
        assert all(r.intact is (True if r.record_type == "response" else None) for r in rows)
    warc.archive(pages, path, least_bytes=5)  # archives are added
    assert warc.page_records(spark, path).count() == 2 * len(PAGES)
    one = warc.read(spark, path).filter("target_uri = 'u Evil: 1'").first()
    assert one.http_headers["Content-Length"] == "0" and one.http_status == 200 and "Evil" not in one.headers
    (tmp_path / "none").mkdir()
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
    assert not list(tmp_path.glob("*/_temporary"))


def test_archives_of_others(spark, tmp_path):
    """Plain files, and members without lengths; folded headers; records that aren't HTTP; filters with nulls."""
    records = [warc.record_bytes({"record_type": "response", "record_id": f"r{i}", "target_uri": f"http://h/{i}" if i % 3 else None, "payload": b"body %d " % i * i}, "2024") for i in range(300)]
    records.append(b"WARC/1.0\r\nWARC-Type: resource\r\nwarc-record-id: <meta>\r\nX-Long: one\r\n  two\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.warc").write_bytes(b"".join(records))
    (tmp_path / "_left").write_bytes(b"junk")
    rows = warc.read(spark, str(tmp_path))
    sizes = {r.file[-7:]: r.n for r in rows.groupBy("file").agg(F.sum(F.octet_length("payload")).alias("n")).collect()}
    assert set(sizes.values()) == {5 + sum(len(b"body %d " % i) * i for i in range(300))} and rows.count() == 602
    assert rows.filter("record_id = 'meta'").first().headers["X-Long"] == "one two"
    assert rows.filter("record_id = 'meta'").first().payload == b"hello" == bytes(warc.read(spark, str(tmp_path / "sub" / "b.warc"), "record_id string, payload binary").filter("record_id = 'meta'").first().payload)
    assert rows.filter("target_uri is null").count() == 2 * 101 and rows.filter("target_uri <> 'http://h/1'").count() == 2 * 199
    assert rows.filter("record_id in ('r7', 'x') or record_id = 'r9'").count() == 4 and rows.filter("content_length > 2000 and target_uri like 'http://h/2%'").count() > 0
    (tmp_path / "cut.warc").write_bytes(records[50][:-20])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(spark, str(tmp_path / "cut.warc")).collect()


def test_unwanted_content_is_not_read(tmp_path):
    """With lengths in the members, a reader that wants headers seeks over megabytes of content."""
    path = tmp_path / "big.warc.gz"
    noise = random.Random(1).randbytes(2 << 20)
    path.write_bytes(b"".join(warc.member(warc.record_bytes({"record_type": t, "record_id": t, "payload": noise}, "d")) for t in ("response", "resource", "response")))
    seen = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def read(self, n):
            seen.append(n)
            return self.file.read(n)

        def seek(self, at):
            return self.file.seek(at)

    with path.open("rb") as file:
        at, kinds = 0, []
        while at < path.stat().st_size:
            record = warc.Zipped(Counted(file), at)
            row = warc.own_columns(warc.lines_of(record.until_blank())[1])
            kinds.append(row["record_type"])
            at = record.after(row["content_length"])
    assert kinds == ["response", "resource", "response"] and sum(seen) <= 3 * warc.STEP


def test_sql_of_the_new_queries(spark, tmp_path):
    """The SQL gives the same rows on tables with nulls, ties and repeats that it can hold."""
    duck = duckdb.connect()
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    vectors = spark.createDataFrame([r for r in labelled(600) if r[0] is None or r[0] < 600], "vec_id long, embedding array<float>, label int").dropDuplicates(["vec_id"])
    pages = spark.createDataFrame([r for r in PAGES if r[0] is not None], "page_id long, url string, html string")
    for name, df in (("documents", docs), ("benchmark", items), ("embeddings", vectors), ("pages", pages)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    from gleanery.llm import queries

    for name, sql in (("op11_hard_negatives", OP11), ("op12_ranked_search", OP12), ("op13_warc", OP13)):
        df = queries.queries()[name](spark, str(tmp_path))
        same(df.select(*sorted(df.columns)).collect(), duck.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({sql})").fetchall())


@pytest.mark.parametrize("hashes", [2, 3])
def test_recall_by_the_number_of_hashes(hashes):
    """2,000 vectors with hardly any structure: at least 0.95 of the nearest ten share a probed combination."""
    import pyarrow.parquet as pq

    x = np.stack(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_numpy()).astype(np.float32)[:2000]
    q = np.arange(0, len(x), 50)
    far = ((x[q][:, None, :].astype(np.float64) - x[None]) ** 2).sum(axis=2)
    far[np.arange(len(q)), q] = np.inf
    near = np.argsort(far, axis=1)[:, :10]
    tables, probes = ann.PLANS[hashes]
    met = np.zeros((len(q), len(x)), bool)
    for t in range(tables):
        own, probed = ann.combined(x, t, hashes, 1, 7)[0][:, 0], ann.combined(x[q], t, hashes, probes, 7)[0]
        for i in range(len(q)):
            met[i] |= np.isin(own, probed[i])
    assert np.take_along_axis(met, near, axis=1).mean() >= 0.95
    assert met.mean() < (0.35 if hashes == 2 else 0.22)


def test_three_hashes_answer(spark):
    x = np.random.default_rng(9).standard_normal((60, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(rows, rows.filter("vec_id % 20 = 0"), k=5, hashes=3, tables=4, probes=400).collect()
    v = x.astype(np.float32).astype(np.float64)
    for r in got:
        assert abs(r.score - np.linalg.norm(v[r.query_id] - v[r.vec_id])) < 1e-9
    assert sorted((r.query_id, r.rank) for r in got) == [(q, k) for q in (0, 20, 40) for k in range(1, 6)]


def test_long_runs_are_counted_in_time(monkeypatch):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp, rnd = sentencepiece.SentencePieceProcessor(model_file=model), random.Random(8)
    count, began = tokencount.PieceCounter(model), time.time()
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "a"):
        text = "".join(rnd.choice(letters) for _ in range(200_000))
        assert count.count(text) == len(sp.encode(text))
    assert time.time() - began < 60
    monkeypatch.setattr(tokencount, "RUN", 3)
    texts = ["".join(rnd.choice(rnd.choice(("etaoin ", "aab", "é日x ñ\n", "abcdefghij"))) for _ in range(rnd.randrange(90))) for _ in range(800)]
    assert count.count_all(texts) == [len(sp.encode(t)) for t in texts]


def test_lists_that_recur_as_a_whole(spark):
    """Three texts with the same 4,000 addresses and 4,000 words: one class of each, not 16 million pairs a text."""
    rnd = random.Random(1)
    addresses = " ".join(f"user{i}@host{i % 97}.example.com" for i in range(4000))
    words = " ".join({"".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(5)) for _ in range(4000)})
    rows = [(k, f"{addresses} {words}") for k in range(3)] + [(10 + i, "plain words here only") for i in range(40)]
    began = time.time()
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_email == 4000 and got[0].n_term == len(words.split()) and got[10].n_term == 0 and time.time() - began < 120


def test_classes_give_what_pairs_would(spark):
    """The spans are those of the SQL, which forms all pairs of entities and terms."""
    from gleanery.llm.sql import OP9

    rnd = random.Random(12)
    names = ["zorblax", "quintle", "merrow", "fendal", "grolsch", "hapwick"]
    docs = []
    for i in range(120):
        own = rnd.sample(range(6), rnd.randrange(0, 3))
        docs.append((i, " ".join([*(f"mail {names[k]}{k}@x.org of {names[k]}" for k in own), *(rnd.choice(("common", "words", "everywhere")) for _ in range(5)), *(["+49 30 1234567"] if i % 9 == 0 else [])])))
    docs += [docs[0], docs[0]]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    want = sorted((r[0], r[1]) for r in duck.execute(f"SELECT doc_id, spans FROM ({OP9})").fetchall())
    got = pii.report(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.spans) for r in got.collect()) == want and any("term" in s for _, s in want)
