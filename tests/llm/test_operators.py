"""Each operator against a plain version, on small tables with nulls, empty and odd texts, ties and repeated rows."""

import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gleanery.llm import ann, bpe, graph, langid, neardup, packing, pii, simhash, substring, tokencount, toxicity

LONG = "word " * 3000
PASSAGE = " ".join(f"p{i}" for i in range(50))
TEXTS = [
    (1, "The quick brown fox. It's 42 déjà vu!\n\n  two   spaces\t x"), (2, None), (3, ""), (4, "   \n "), (5, "日本語 テキスト 😀 <|endoftext|> <s>"), (6, f"a b {PASSAGE} c"), (7, f"{PASSAGE} d e"),
    (8, LONG), (1, "same id, other text"), (None, "no id here a@b.co"), (9, "twin text of some words here"), (9, "twin text of some words here"), (10, "x" * 3000), (11, "İSTANBUL ΣΑΣ é \x1c 　y"),
]
SCHEMA = "doc_id long, text string, bucket int, n long, block string, kept string"

@pytest.fixture(scope="module")
def docs(spark):
    """With further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, "b", "k") for i, t in TEXTS], SCHEMA).repartition(3)

@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)

def same(found, want):
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)

def test_token_counts(docs, none):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    want = [(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in TEXTS]
    same(tokencount.count_tokens(docs, model).collect(), want)
    assert tokencount.count_tokens(none, model).count() == 0

def test_bpe_round_trip(docs, none):
    ranks = P.path("byte_bpe_50k.tiktoken")
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.token_bytes(ranks), special_tokens={})
    out = bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks)
    want = [(i, len(ids := enc.encode_ordinary(t or "")), np.array(ids, "<u4").tobytes(), (t or "").encode()) for i, t in TEXTS]
    same([(r[0], r[1], bytes(r[2]), bytes(r[3])) for r in out.collect()], want)
    assert bpe.encode(none, ranks, P.PATTERN).count() == 0

def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=64, max_segments=3).collect()
    whole = sorted((i is None, i or 0, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in TEXTS)
    pieces, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sum(len(x[2]) // 4 for x in whole) == sum(r["length"] for r in rows)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own]])[:-1])
        n = sum(r["length"] for r in own)
        assert len(own) <= 3 and n <= 64 and n & (n - 1) == 0
    single = {(i, len(x) // 4): x for _, i, x in whole}
    for (doc, n), own in pieces.items():
        if doc not in (9, None):  # repeated rows share their key
            own.sort(key=lambda r: r["start"])
            assert b"".join(bytes(r["ids"]) for r in own) == single[doc, n]
    assert packing.pack_documents(none, path).count() == 0

def test_packing_holds_all_limits(spark):
    rows = spark.createDataFrame([(i, 10 + i % 50, i % 9) for i in range(300)] + [(999, None, None)], "id long, n_tokens long, n_loss long").coalesce(1)
    out = packing.pack_examples(rows, capacity=128, max_segments=4, max_loss=12).collect()
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r)
    assert all(sum(r["length"] for r in v) <= 128 and len(v) <= 4 and sum(r["loss_tokens"] for r in v) <= 12 for v in by.values())
    assert sum(r["length"] for r in out) == sum(10 + i % 50 for i in range(300)) and sum(r["loss_tokens"] for r in out) == sum(i % 9 for i in range(300))

def test_language(spark, none):
    train = [(i, lang, " ".join(w[(i + k) % len(w)] for k in range(12))) for i in range(40) for lang, w in (("en", "the thing with that other them then this there".split()), ("de", "der die das und nicht auch einer schon wieder".split()))]
    model = langid.fit(spark.createDataFrame(train + [(99, None, "zzz"), (98, "en", None)], "doc_id long, lang string, text string"))
    asked = spark.createDataFrame([(1, "the other thing there then"), (2, "einer und nicht wieder"), (3, None), (4, "12 !!"), (5, "the thing that then there und nicht wieder schon auch")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(asked, model, penalty=1.0).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and got[3]["score"] == 0
    assert "en" in got[5]["mixture"] and "de" in got[5]["mixture"] and 0.3 < got[5]["score"] < 0.7
    assert langid.predict(none, model).count() == 0
    assert langid.predict(asked, langid.Model([], 0.5)).filter("lang_pred <> 'und'").count() == 0

def test_language_with_little_text_keeps_its_trigrams(spark):
    """A language's few counts are not crowded out by those of a large one."""
    rng = np.random.default_rng(1)
    big = [(i, "en", " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400))) for i in range(40)]
    model = langid.fit(spark.createDataFrame([*big, (99, "eo", "kvin ruzo zorgo")], "doc_id long, lang string, text string"), max_grams=400)
    assert model.langs == ["en", "eo"]
    assert langid.predict(spark.createDataFrame([(1, "zorgo kvin ruzo")], "doc_id long, text string"), model).first()["lang_pred"] == "eo"
    n = np.exp(model.log[:, 0])  # normalised by all trigrams of the language, not by those kept
    assert n.sum() < 0.95

def test_toxicity(spark, none):
    clean, bad = "sun moon river stone field cloud tree bird".split(), "idiot scum".split()
    rows = [(i, " ".join(clean[(i + k) % 8] for k in range(5)) + (f" {bad[i % 2]}" * (1 + i % 3) + (" scum" if i % 4 == 0 else "") if i % 3 == 0 else "")) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, grades=3)
    asked = spark.createDataFrame([(1, "sun idiot river"), (2, "sun river"), (3, None), (4, "SCUM idiot")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.grade(asked, model).collect()}
    assert [got[i]["toxic"] for i in (1, 2, 3, 4)] == [True, False, False, True] and got[4]["severity"] > got[2]["severity"]
    assert toxicity.grade(none, model).count() == 0
    assert toxicity.grade(asked, toxicity.fit(docs, labels.filter("toxic = 0"))).agg(F.max("severity")).first()[0] == 0

def test_simhash(spark, none):
    base = [f"w{i}" for i in range(400)]
    rows = [(5, " ".join(base)), (3, " ".join([*base[:200], "X", *base[201:]])), (8, " ".join(base)), (1, None), (2, " "), (7, "A b"), (6, "a B"), (None, "a b"), (4, "other words altogether and more of them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def fp(text):
        w = (text or "").encode().lower().split()
        hs = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    ids, fps = [r[0] for r in rows], [fp(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    want = [(ids[i], f"{fps[i]:016x}", min((ids[j] for j in range(len(rows)) if root[j] == root[i] and ids[j] is not None), default=None)) for i in range(len(rows))]
    same(simhash.near_duplicates(docs).collect(), want)
    assert simhash.near_duplicates(none).count() == 0
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted({w[2] for w in want})

def test_near_pairs_match_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre}
    for _ in range(300):
        x = centre
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {tuple(sorted(r)) for r in simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2}

def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0

def test_substrings(docs, none):
    words = [(t or "").encode().split() for _, t in TEXTS]
    seen = {}
    for w in words:
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    want = []
    for (i, _), w in zip(TEXTS, words, strict=True):
        gone = {k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        want.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    same(substring.remove_repeats(docs).select("doc_id", "kept", "n_words", "n_removed").collect(), want)
    assert substring.remove_repeats(none).count() == 0
    spans = {r["doc_id"]: r["spans"] for r in substring.remove_repeats(docs).filter("n_removed > 0").collect()}
    assert [tuple(s) for s in spans[6]] == [(2, 52)]

def test_a_window_weighs_one_entry_a_block(spark):
    docs = spark.createDataFrame([(i, 0, b"word " * 2000) for i in range(20)], "k1 long, k2 long, text binary").repartition(2)
    sent = docs.mapInArrow(substring.windows_out(35, 6), substring.MOVED).filter("bucket >= 0").collect()
    assert 0 < sum(r["n"] % (1 << 32) + r["n"] // (1 << 32) for r in sent) <= 2

PII = ["", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 255.255.255.0", "+1 (389) 555-5010 and 4111 1111 1111 1111", "ö+49 (0)30 123456-78 ü a.b@c.d. z@@q.w.e", "a@b.c" * 5, None, "1.2.3.4+1 (2) 3456789"]

def plain_spans(text):
    from itertools import count

    out, kinds = [], count()
    for kind, pattern in zip(kinds, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]"), strict=False):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if (kind == 0, kind == 1 and all(int(x) < 256 for x in m[0].split(".")), kind == 2 and 12 <= len(d) <= 19 and luhn, kind == 3 and 9 <= len(d) <= 15)[kind]:
                out.append((m.start(), kind, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))

def test_personal_data(spark, none):
    docs = spark.createDataFrame(list(enumerate(PII)) + [(2, PII[2])], "doc_id long, text string")
    same(pii.report(docs).select("doc_id", "base").collect(), [(i, plain_spans(t)) for i, t in [*enumerate(PII), (2, PII[2])]])
    assert pii.report(none).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, keep=["doc_id", "text"]).collect()}
    assert clean[4] == "[PHONE] and [CARD]" and clean[7] is None and clean[0] == ""

def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"report {i} by zorblax at z@x.org for the board") for i in range(4)] + [(i, f"the board met for item {i}") for i in range(4, 60)]
    found = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == "term:12:19,email:23:30" or "term:12:19" in found[0] and "email:23:30" in found[0]
    assert all(found[i] == "" for i in range(4, 60))

def test_terms_far_from_the_mention_give_it_away_too(spark):
    far = " and the board met again" * 5
    rows = [(i, f"Zorblax wrote{far} to z@x.org{far} for zorblax {i}") for i in range(4)] + [(i, f"the board met again and wrote to the one for item {i}") for i in range(4, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert [found[i]["n_term"] for i in (0, 3, 9)] == [2, 2, 0] and found[0]["spans"].startswith("term:0:7,email:")
    assert "zorblax" not in pii.sanitise(docs, keep=["doc_id", "text"]).filter("doc_id = 1").first()["text"].lower()

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long, label int")

@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[50:60] = x[50] + rng.standard_normal((10, 16)).astype(np.float32) * 0.02
    x[70:75] = x[70]
    rows = [(i, v.tolist(), 1, 1) for i, v in enumerate(x)]
    return x, [*rows, (900, None, 1, 1), (901, [0.0] * 16, 1, 1), (902, [float("nan")] * 16, 1, 1), (903, [], 1, 1), (None, x[3].tolist(), 1, 1)]

def test_nearest(spark, cloud):
    x, rows = cloud
    e = vectors(spark, rows)
    got = ann.nearest(e, e.filter("vec_id % 20 = 0"), k=10, tables=12, probes=144).collect()
    hit = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and np.allclose([r["score"] for r in own], d[[r["vec_id"] for r in own]], rtol=0, atol=1e-12)
        hit += len({r["vec_id"] for r in own} & set(want.tolist()))
    assert hit >= 0.9 * 200 and not {900, 901, 902, 903} & {r["vec_id"] for r in got}
    assert ann.nearest(e.limit(0), e.limit(0)).count() == 0

def test_embedding_links(spark, cloud):
    x, rows = cloud
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    linked[3, 3] = True
    got = {r["vec_id"]: r for r in neardup.near_duplicates(vectors(spark, rows)).collect() if r["vec_id"] is not None}
    assert all(got[i]["n_links"] == linked[i].sum() - 1 + (i == 3) for i in range(400))
    assert all(got[i]["component_id"] == 50 for i in range(50, 60)) and all(got[i]["component_id"] == 70 for i in range(70, 75))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903))
    assert neardup.near_duplicates(vectors(spark, [])).count() == 0

def close_pairs(n, dim, wide, seed):
    """Vectors around n / 40 centres, of which many are near 0.95 apart."""
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.standard_normal((-(-n // 40), dim)), 40, axis=0)[:n] + rng.standard_normal((n, dim)) * wide
    x = x.astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    return x, (u @ u.T >= 0.95).sum(axis=1) - 1

def test_embedding_links_of_a_leaf_are_all_found(spark):
    """One leaf of 1200 rows, without spill: no pair may be parted and then taken for compared in a later tree."""
    x, want = close_pairs(1200, 16, 0.22, 2)
    got = {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(vectors(spark, [(i, v.tolist(), 1, 1) for i, v in enumerate(x)]), sample=8, spill=0.0).collect()}
    assert want.sum() > 1000 and [got[i] for i in range(1200)] == want.tolist()

def test_embedding_groups_are_bounded(spark):
    """A dense group of distinct vectors, which spills as a whole, is dealt into blocks; wide leaves are split on."""
    x, _ = close_pairs(900, 16, 0.22, 4)
    x[:500] = x[0] + np.random.default_rng(6).standard_normal((500, 16)).astype(np.float32) * 0.2
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    rows = vectors(spark, [(i, v.tolist(), 1, 1) for i, v in enumerate(x)])
    classes = neardup.raw(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))).withColumn("cls", F.xxhash64("vec")).select("cls", "vec", F.lit(1).cast("long").alias("n"))
    placed = neardup.placed(classes, 900, 16, least=0.95, trees=6, spill=0.75, sample=64, block_rows=60, seed=11)
    assert placed.groupBy("leaf", "p", "q").count().agg(F.max("count")).first()[0] <= 2 * 60 * 1.6
    got = {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(rows, sample=64, block_rows=60).collect()}
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert sum(got.values()) >= 0.999 * want.sum() and all(got[i] <= want[i] for i in range(900))

def test_pipeline_stages(spark):
    import corpus_pipeline
    from gleanery.llm.common import written

    rows = [(i, " ".join(f"wort{(i * 7 + k) % 90}" for k in range(60)) + f" mail{i}@x.org", "de", "s", 9) for i in range(30)]
    rows += [(100, rows[4][1], "de", "s", 9), (101, None, "de", "s", 9), (102, "12 34", "de", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        kept.append(docs)
    assert {101, 102}.isdisjoint(r[0] for r in kept[0].select("doc_id").collect()) and kept[0].count() == 31
    assert 100 not in [r[0] for r in kept[1].select("doc_id").collect()]
    assert all(d.columns == corpus_pipeline.COLUMNS for d in kept[:-1])
    assert kept[3].filter(F.col("text").contains("@")).count() == 0
    assert kept[4].select("doc_id").distinct().count() == kept[3].count()
