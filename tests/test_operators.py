"""What SQL doesn't express, on small tables."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.operators import chunking, dense, evaluate, fusion, lexical, selftest, usage
from gleanery.sources import files


def test_tokenize_scripts(spark):
    df = spark.createDataFrame([("The Kalman_filter TRK-104 एकूण २००८",)], "t string")
    assert df.select(text.tokenize(F.col("t"), normalise=True)).first()[0] == ["kalman", "filter", "trk", "104", "एकूण", "2008"]


def test_insert_labels_at_bytes(spark):
    df = spark.createDataFrame([("é b", [(2, "[1]"), (99, "[2]")])], "t string, l array<struct<at: int, label: string>>")
    assert df.select(text.insert_labels(F.col("t"), F.col("l"))).first()[0] == "é[1] b[2]"


def test_chunks_cover_and_overlap():
    sentence = "one two three four five six seven eight nine ten. "
    whole = "\n\n".join(sentence * 6 for _ in range(6))
    chunks = chunking.Chunker()(whole)
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks))) and len(chunks) > 1
    assert all(whole[c["char_start"] : c["char_end"]] == c["text"] for c in chunks)
    assert all(c["tokens"] <= 200 for c in chunks)
    assert all(b["char_start"] < a["char_end"] and b["char_start"] > a["char_start"] for a, b in zip(chunks, chunks[1:], strict=False))


def test_runt_is_merged_and_blank_is_nothing():
    long = " ".join(f"w{i}" for i in range(200)) + "\n\ntail end"
    assert len(chunking.Chunker()(long)) == 1
    assert chunking.Chunker()(" \n ") == []
    with pytest.raises(ValueError):
        chunking.Chunker(target=10)


def test_unbreakable_word_is_one_chunk():
    one = chunking.Chunker(count=len, target=50)("x" * 300)
    assert [c["tokens"] for c in one] == [300]


def test_table_rows_repeat_their_header():
    body = "Intro.\n\n| A | B |\n|---|---|\n| x | 1 |\n| y | 2 |\n\nEnd."
    start = body.index("| x")
    rows = [c for c in chunking.Chunker(row_tokens=1)(body, [{"start": start, "end": body.index("\n\nEnd"), "context": "| A | B |"}]) if c["kind"] == "row"]
    assert [c["text"] for c in rows] == ["| A | B |\n| x | 1 |", "| A | B |\n| y | 2 |"]


@pytest.mark.parametrize("limit, want", [(3, ["a0", "b0", "c0"]), (5, ["a0", "b0", "c0", "a1", "a2"])])
def test_diversify(spark, limit, want):
    rows = [(1, i + 1, c, c[0], s) for i, (c, s) in enumerate(zip(["a0", "a1", "a2", "b0", "c0"], [0.9, 0.8, 0.7, 0.6, 0.5], strict=True))]
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, document_id string, score double")
    assert [r["chunk_id"] for r in fusion.diversify(df, limit, 1).orderBy("rank").collect()] == want


def test_search_modes_and_limits(spark):
    chunks = spark.createDataFrame([(1, "d1", "kalman filter gain"), (2, "d2", "hungarian assignment")], "chunk_id long, document_id string, text string")
    asked = spark.createDataFrame([(7, "kalman filter")], "query_id long, text string")
    v = chunks.select("chunk_id", dense.hashed_embedding(F.col("text")).alias("vector"))
    near = dense.dense_topk(asked.select("query_id", dense.hashed_embedding(F.col("text")).alias("vector")), v, 5)
    first = fusion.search(asked, chunks, near).orderBy("rank").first()
    assert first["chunk_id"] == 1 and first["scored_by"] == "overlap"
    assert fusion.search(asked, chunks, near, scorer=None).first()["scored_by"] == "rrf"
    with pytest.raises(ValueError):
        fusion.search(asked, chunks, near, "magic")
    with pytest.raises(ValueError):
        fusion.Settings(limit=26)


def test_rate_limit_counts_admitted_only(spark):
    log = spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}", "c") for i in range(5)] + [(9, "2024-01-01 00:01:01", "c")], "id long, ts string, client string").withColumn("ts", F.to_timestamp("ts"))
    got = {r["id"]: (r["admitted"], r["retry_after"]) for r in usage.rate_limit(log, 2, 60).collect()}
    assert [got[i][0] for i in range(5)] == [True, True, False, False, False] and got[9][0]
    assert got[2][1] == 58


def test_owner_share(spark):
    log = spark.createDataFrame([(1, "a", 6.0), (2, "a", 1.0), (3, "b", 1.0), (4, "b", 9.0), (5, "c", 1.0)], "id long, owner string, cost double").withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    got = {r["id"]: r["admitted"] for r in usage.owner_share(log, 10.0, 0.5).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_replay_ends_on_an_answer(spark):
    turns = [(1, 1, "user", "old"), (1, 2, "user", "new"), (1, 3, "assistant", "yes"), (1, 4, "system", "x"), (1, 5, "user", "open"), (2, 1, "user", "alone")]
    out = usage.replay(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("place").collect()
    assert [(r["role"], r["text"]) for r in out] == [("user", "new"), ("assistant", "yes")]


def test_model_stamp(spark):
    chunks = spark.createDataFrame([(1,)], "chunk_id long")
    files.guard_model(spark.createDataFrame([("m",)], "model string"), "m", "d", chunks)
    with pytest.raises(ValueError):
        files.guard_model(spark.createDataFrame([], "model string"), "m", "d", chunks)


def test_a_hit_put_off_stays_off():
    assert fusion.spread_out(["a", "a", "a", "b", "c"], [1.0, 0.9, 0.8, 0.45, 0.1], 3, 1, 0.5) == [0, 3, 4]
    assert fusion.spread_out(["a", "a", "b"], [1.0, 0.9, 0.1], 3, 1, 0.5) == [0, 1, 2]


def test_results_close_the_latest_open_call(spark):
    kinds = ["call", "call", "result", "result", "result", "call", "result"]
    events = spark.createDataFrame([(1, "s", i, k) for i, k in enumerate(kinds)] + [(1, "t", 9, "result")], "request int, name string, seq int, kind string")
    got = {r["seq"]: r["call_id"] for r in usage.pair_tool_events(events).collect()}
    assert got == {2: 1, 3: 0, 4: None, 6: 5, 9: None}


def test_turns_are_bare_before_they_count(spark):
    turns = spark.createDataFrame([(1, 0, "user", "\n q \t"), (1, 1, "assistant", "\n\n"), (1, 2, "assistant", " a ")], "conv_id long, turn int, role string, text string")
    assert [(r["role"], r["text"]) for r in usage.replay(turns).orderBy("place").collect()] == [("user", "q"), ("assistant", "a")]


def test_any_model_embeds(spark):
    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(5)], "id long, text string")
    got = {r["id"]: r["vector"] for r in dense.embed(rows, lambda texts: [[len(t), 1.0] for t in texts], "id", "text", batch=2).collect()}
    assert all(abs(got[i][0] - i / (i * i + 1) ** 0.5) < 1e-12 for i in range(5))


def test_vectors_by_table_are_those_by_column(spark):
    rows = spark.createDataFrame([(1, "kalman filter gain kalman"), (2, "hungarian assignment"), (3, "the")], "id long, text string")
    one = {r["id"]: r["vector"] for r in dense.hashed_vectors(rows, "id", "text").collect()}
    two = {r["id"]: r["v"] for r in rows.select("id", dense.hashed_embedding(F.col("text")).alias("v")).collect()}
    assert set(one) == {1, 2} and all(max(abs(a - b) for a, b in zip(one[i], two[i], strict=True)) < 1e-12 for i in one)


def test_questions_in_other_scripts_go_by_words(spark):
    chunks = spark.createDataFrame([(i, "d", f"фильтр калмана номер{i}") for i in range(4)], "chunk_id long, document_id string, text string")
    asked = spark.createDataFrame([(7, "фильтр номер2")], "query_id long, text string")
    near = dense.dense_topk(dense.hashed_vectors(asked, "query_id", "text"), dense.hashed_vectors(chunks, "chunk_id", "text"), 5)
    got = fusion.assemble(fusion.search(asked, chunks, near, cfg=fusion.Settings(limit=3)), chunks, F.lit("2026-01-01").cast("date")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and got[0]["chunk_id"] == 2 and {r["scored_by"] for r in got} == {"bm25"} and {r["mode"] for r in got} == {"lexical"}
    assert got[0]["total_found"] == 3 and got[0]["note"]


def test_an_index_serves_many_batches(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "kalman filter gain"), (2, "hungarian assignment filter"), (3, "the")], "chunk_id long, text string")
    asked = spark.createDataFrame([(7, "kalman filter filter")], "query_id long, text string")
    lexical.build_index(chunks, f"{tmp_path}/index")
    again = lexical.bm25(asked, lexical.open_index(spark, f"{tmp_path}/index")).orderBy("rank").collect()
    assert again == lexical.bm25(asked, chunks).orderBy("rank").collect() and [r["chunk_id"] for r in again] == [1, 2]


def test_first_fix_by_group(spark):
    cols = ("costly_copies", "versions", "scanned", "unreadable", "copies")
    facts = spark.createDataFrame([("a", 0, 3, 9, None, 2), ("b", None, None, None, 1, 5), ("c", 0, 0, 0, 0, None), ("d", 1, 8, 8, 8, 8)], "source string, " + ", ".join(f"{c} long" for c in cols))
    assert sorted(map(tuple, selftest.suggestion(facts, "source").collect())) == [("a", "versions", 3), ("b", "unreadable", 1), ("d", "costly_copies", 1)]
    assert selftest.suggestion(facts.drop("source").limit(0)).count() == 0


def test_adoption_needs_a_gain_on_every_set_and_no_drop(spark):
    def run(*values):
        return spark.createDataFrame([(s, m, v) for (s, m), v in zip([(s, m) for s in ("s1", "s2") for m in ("full", "dense")], values, strict=True)], "set string, mode string, value double")

    old = run(0.5, 0.5, 0.5, 0.5)
    verdicts = [tuple(evaluate.adoption_rule(old, new, ["full"], ["dense"]).first()) for new in (run(0.53, 0.5, 0.6, 0.48), run(0.53, 0.5, 0.5, 0.5), run(0.6, 0.47, 0.6, 0.5))]
    assert verdicts == [("adopted", "s1 full gains; s2 full gains"), ("undecided", "s1 full gains"), ("rejected", "s1 dense drops; s1 full gains; s2 full gains")]


def test_versions_move_documents_once(spark):
    """Five questions lost to a version of a long document, one to a text without runs: no row for each run is shuffled."""
    long = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(5)]
    rows = [(i, "a", i, t) for i, t in enumerate(long)] + [(10 + i, "b", i, t) for i, t in enumerate([*long[:3], "quite another text of some words"])] + [(20, "c", 0, "too few words")]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id string, chunk_index int, text string")
    graded = spark.createDataFrame([(i, i, "a", 2, "b") for i in range(5)] + [(20, 20, "c", 2, "b")], "query_id long, passage_id long, document_id string, rank int, first_document string")
    found = selftest.lost_to_versions(graded, chunks, graded.select("query_id").limit(0))
    assert sorted(r.query_id for r in found.collect()) == [0, 1, 2]
    assert "Generate explode" not in found._jdf.queryExecution().executedPlan().toString()
    copies = selftest.duplicates(chunks.filter("chunk_id <> 13 and chunk_id < 3 or chunk_id between 10 and 12").withColumn("kind", F.lit("text")))
    assert [tuple(r) for r in copies.collect()] == [("b", "a")]


def test_label_metrics_are_those_of_pairs(spark):
    units = spark.createDataFrame([(i, None if i == 9 else i % 3) for i in range(12)] + [(20, 7)], "unit long, label int")
    asked = units.filter("unit in (0, 4, 9, 20)").withColumnRenamed("unit", "query_id")
    hits = spark.createDataFrame([(q, u, r + 1) for q in (0, 4, 5, 9, 20) for r, u in enumerate((3, 1, 3, q, 7, 6))], "query_id long, unit long, rank int")
    questions = hits.select("query_id").distinct()
    relevant = asked.join(units, "label").filter("query_id <> unit").select("query_id", "unit")
    rows = [sorted(map(tuple, x.collect())) for x in (evaluate.label_metrics(questions, hits, asked, units), evaluate.metrics(questions, hits, relevant))]
    assert rows[0] == rows[1] and len(rows[0]) == 5


def test_pages_share_folders(spark):
    from gleanery.plans import ingest

    found = files.scan_folder(spark, ingest.page_files(spark, "/root/testdata/sf0.001")).select("relative").collect()
    assert len(found) == 50 and len({r.relative.split("/")[0] for r in found}) == 1
