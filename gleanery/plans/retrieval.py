"""Queries C, D, E (exact search) and F: text functions, BM25, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import dates_in, passage_dates
from ..operators import dense, fusion, lexical
from ..sources.scratch import kept, scratch
from .shared import DOC_CHUNKS, PASSAGES, UNIT, bm25_ctes, dense_ctes, passages, query, question_table, shingles, table, tokens, vector_tables, whole_documents, words

def today():
    return F.lit("1998-12-31").cast("date")


@query(f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS terms FROM documents")
def c1_tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("terms"))


@query(f"""SELECT doc_id, array_to_string({tokens("replace(text, 'e', 'e' || chr(769)) || ' Ma' || chr(776) || 'dchen'")}, ' ') AS terms, list_contains({tokens("replace(text, 'e', 'e' || chr(769)) || ' Ma' || chr(776) || 'dchen'")}, 'mädchen') AS whole FROM documents""")
def c1_tokenize_decomposed(spark, sf_dir):
    """Every e with an accent that stands as a character of its own."""
    text = F.concat(F.replace("text", F.lit("e"), F.lit("e\u0301")), F.lit(" Ma\u0308dchen"))
    terms = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(T.tokenize(text))).alias("t"))
    return terms.select("doc_id", F.array_join("t", " ").alias("terms"), F.array_contains("t", "m\u00e4dchen").alias("whole"))


@query("SELECT o_orderkey, translate(translate(CAST(o_orderkey AS VARCHAR), '0123456789', '०१२३४५६७८९'), '०१२३४५६७८९', '0123456789') AS folded FROM orders")
def c2_ascii_digits(spark, sf_dir):
    devanagari = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "०१२३४५६७८९")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.ascii_digits(devanagari).alias("folded"))


@query(r"""SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '\p{L}')) > 0 THEN len(regexp_extract_all(t, '\p{Latin}')) / len(regexp_extract_all(t, '\p{L}')) >= 0.5 ELSE true END AS latin
 FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeinrt', 'αειнρτ') ELSE text END AS t FROM documents)""")
def c3_mostly_latin(spark, sf_dir):
    mixed = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "aeinrt", "αειнρτ")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.mostly_latin(mixed).alias("latin"))


@query(f"SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {words('text')} AS w FROM documents)")
def c4_words(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(f"SELECT item_id, len({shingles('w', 8)}) AS n8, len({shingles('w', 5)}) AS n5 FROM (SELECT item_id, {words('text')} AS w FROM benchmark)")
def c5_shingles(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    return w.select("item_id", F.size(T.shingles(F.col("w"), 8)).cast("long").alias("n8"), F.size(T.shingles(F.col("w"), 5)).cast("long").alias("n5"))


def dated(spark, sf_dir):
    """Orders as sentences with a written date."""
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Bill date "), F.date_format(d, "dd/MM/yyyy"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Issued "), F.date_format(d, "yyyy-MM-dd"), F.lit("."))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("On "), F.date_format(d, "MMMM d, yyyy"), F.lit(" it was due"))).otherwise(F.concat(F.lit("Since "), F.date_format(d, "d MMM yyyy"), F.lit(" and again in "), F.date_format(d, "MMMM yyyy")))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", text.alias("text"), d.cast("date").alias("day"))


DATED = "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 4 = 3 THEN list_distinct([CAST(date_trunc('month', o_orderdate) AS DATE), CAST(o_orderdate AS DATE)]) ELSE [CAST(o_orderdate AS DATE)] END AS days FROM orders"


@query(f"SELECT o_orderkey, array_to_string(list_transform(list_sort(list_filter(days, lambda d: d <= DATE '1998-12-31')), lambda d: CAST(d AS VARCHAR)), ',') AS dates FROM ({DATED})")
def c6_dates_in(spark, sf_dir):
    found = F.transform(dates_in(F.col("text"), today()), lambda d: d.cast("string"))
    return dated(spark, sf_dir).select("o_orderkey", F.array_join(found, ",").alias("dates"))


@query("""SELECT o_custkey, coalesce(array_to_string(list_transform(d[-6:], lambda x: CAST(x AS VARCHAR)), ','), '') AS dates
 FROM (SELECT o_custkey, list_sort(list_distinct(list(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01'))) AS d FROM orders GROUP BY ALL)""")
def c7_passage_dates(spark, sf_dir):
    said = F.concat(F.lit("dated "), F.date_format("o_orderdate", "dd.MM.yyyy"))
    text = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(said), "; ").alias("text"))
    found = F.transform(passage_dates(dates_in(F.col("text"), today())), lambda d: d.cast("string"))
    return text.select("o_custkey", F.array_join(found, ",").alias("dates"))


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS document_id, CAST(max(list_max(list_filter(days, lambda d: d <= DATE '1998-12-31'))) AS VARCHAR) AS newest FROM ({DATED}) GROUP BY 1")
def c8_newest_date(spark, sf_dir):
    rows = dated(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("document_id"), "text")
    return fusion.newest_dates(rows, today()).select("document_id", F.col("newest").cast("string").alias("newest"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 240 THEN rtrim(substr(t, 1, 240)) || '…' ELSE t END AS lead FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def c13_lead_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.lead_text(F.col("text")).alias("lead"))


@query("SELECT doc_id, CASE WHEN length(text) > 4000 THEN '… ' || right(text, 4000) ELSE text END AS clipped FROM documents")
def c14_clip_turn(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clip_turn(F.col("text")).alias("clipped"))


@query("SELECT item_id, '[1]' || text || '[2][3]' AS labelled FROM benchmark")
def c16_insert_labels(spark, sf_dir):
    labels = F.array(F.struct(F.lit(0).alias("at"), F.lit("[1]").alias("label")), F.struct(F.octet_length("text").alias("at"), F.lit("[2]").alias("label")), F.struct(F.lit(10_000_000).alias("at"), F.lit("[3]").alias("label")))
    return table(spark, sf_dir, "benchmark").select("item_id", T.insert_labels(F.col("text"), labels).alias("labelled"))


@query(f"WITH {DOC_CHUNKS}, tok AS (SELECT chunk_id, {tokens('text')} AS ts FROM chunks) SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM tok) GROUP BY ALL")
def d1_build_postings(spark, sf_dir):
    return lexical.postings(whole_documents(spark, sf_dir))


@query(f"WITH {DOC_CHUNKS}, {bm25_ctes('chunks', 'questions', 10)} SELECT term, count(*) AS df, round(any_value(i.idf), 6) AS idf FROM posts JOIN idf i USING (term) GROUP BY term")
def d2_term_stats(spark, sf_dir):
    chunks = whole_documents(spark, sf_dir)
    return lexical.term_stats(lexical.postings(chunks), lexical.corpus_stats(lexical.lengths(chunks))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {DOC_CHUNKS}, {bm25_ctes('chunks', 'questions', 10)} SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM lexical")
def d3_bm25_topk(spark, sf_dir):
    found = lexical.bm25(question_table(spark, sf_dir), whole_documents(spark, sf_dir), 10)
    return found.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


DATED = "chunks AS (SELECT doc_id AS chunk_id, text FROM documents), questions AS (SELECT item_id AS query_id, text FROM benchmark)"


@query(f"WITH {DATED}, {bm25_ctes('chunks', 'questions', 10)} SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM lexical")
def d3_bm25_segments(spark, sf_dir):
    """An index of two thirds of the documents, a segment with the others added to it, and two batches of questions, with
    blocks skipped: rows are those of one index and one full evaluation."""
    chunks, asked = whole_documents(spark, sf_dir), question_table(spark, sf_dir)
    index = lexical.append(lexical.build_index(chunks.filter("chunk_id % 3 <> 0")), chunks.filter("chunk_id % 3 = 0"))
    found = [lexical.bm25(asked.filter(f"query_id % 2 = {i}"), index, 10, prune=True) for i in (0, 1)]
    return found[0].unionByName(found[1]).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query("SELECT true AS some_skipped, true AS all_known")
def d3_blocks_skipped_hold(spark, sf_dir):
    """Postings that the passes take against those of all of the questions' terms, for the first place of each list."""
    read: dict = {}
    index = lexical.build_index(whole_documents(spark, sf_dir))
    lexical.bm25(question_table(spark, sf_dir), index, 1, prune=True, read=read)
    return spark.createDataFrame([(read["needed"] + read["looked_up"] < read["all"], read["first"] > 0)], "some_skipped boolean, all_known boolean")


@query(r"""SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'lexical' ELSE 'rerank' END AS mode_eff, CASE WHEN item_id % 2 = 0 THEN 'matched by words alone' END AS note FROM benchmark""")
def d4_words_only_route(spark, sf_dir):
    """Every second question in Greek letters."""
    latin, greek = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψωάέ"
    greeked = F.when(F.col("query_id") % 2 == 0, F.translate(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), latin, greek)).otherwise(F.col("text"))
    return lexical.effective_mode(question_table(spark, sf_dir).withColumn("text", greeked), "rerank").select("query_id", "mode_eff", "note")


@query()
def e1_embed_passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.transform(dense.hashed_embedding(F.col("text")), lambda x: F.round(x, 6)).alias("vector"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Represent this sentence for searching relevant passages: ' || text ELSE text END AS prefixed FROM benchmark")
def e2_embed_queries(spark, sf_dir):
    model = F.when(F.col("item_id") % 2 == 0, "BAAI/bge-small-en-v1.5").otherwise("default")
    return table(spark, sf_dir, "benchmark").select("item_id", dense.with_prefix(F.col("text"), model).alias("prefixed"))


@query(f"WITH {UNIT} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squared, round(v[1], 6) AS first FROM unit")
def e3_normalise(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", dense.normalise(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(dense.dot(F.col("v"), F.col("v")), 6).alias("squared"), F.round(F.col("v")[0], 6).alias("first"))


@query(f"WITH {UNIT} SELECT a.vec_id, round(least(greatest(1 - list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 2, -1), 1), 5) AS cosine FROM unit a JOIN unit b ON b.vec_id = a.vec_id + 1")
def e4_cosine_from_l2(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("vec_id", dense.normalise(F.col("embedding")).alias("v"))
    pairs = u.join(u.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    squared = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("vec_id", F.round(dense.cosine_from_l2(squared), 5).alias("cosine"))


@query(f"WITH {dense_ctes(10)} SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM dense")
def e5_dense_topk(spark, sf_dir):
    return dense.dense_topk(*vector_tables(spark, sf_dir), 10).select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


@query(f"WITH {dense_ctes(10)} SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM dense")
def e5_dense_topk_sql(spark, sf_dir):
    return dense.dense_topk_sql(*vector_tables(spark, sf_dir), 10).select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


def both_rankings(spark, sf_dir):
    """Every question; every document as one chunk, and a lexical index of them; and exact search by the default embedder,
    whose vectors come from the index: the documents are tokenised once."""
    chunks, asked = whole_documents(spark, sf_dir), question_table(spark, sf_dir)
    index = lexical.build_index(chunks)
    folder = scratch(spark, "near")
    questions = kept(dense.hashed_vectors(asked, "query_id", "text"), f"{folder}/questions")  # counted and read, as are
    vectors = kept(dense.indexed_vectors(index), f"{folder}/vectors")
    near = kept(dense.dense_topk(questions, vectors, 30), f"{folder}/ranking")  # a few rows a question
    return asked, chunks, near, index


def embedded(table: str, id_col: str) -> str:
    """SQL of dense.hashed_vectors: (id, v)."""
    buckets = f"SELECT {id_col} AS id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS b, count(*) AS n FROM (SELECT {id_col}, unnest({tokens('text')}) AS t FROM {table}) GROUP BY ALL"
    return f"(SELECT id, list_transform(range(0, 64), lambda i: coalesce(map_extract(m, i)[1], 0) / s) AS v FROM (SELECT id, map(list(b), list(n)) AS m, sqrt(sum(n * n)) AS s FROM ({buckets}) GROUP BY id))"


FUSED = f"""{DOC_CHUNKS}, {bm25_ctes('chunks', 'questions', 30)},
dense AS (SELECT q.id AS query_id, d.id AS chunk_id, least(greatest(list_dot_product(q.v, d.v), -1), 1) AS score,
 row_number() OVER (PARTITION BY q.id ORDER BY round(least(greatest(list_dot_product(q.v, d.v), -1), 1), 6) DESC, d.id) AS rank
 FROM {embedded('questions', 'query_id')} q, {embedded('chunks', 'chunk_id')} d QUALIFY rank <= 30),
fused AS (SELECT query_id, chunk_id, coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + l.rank), 0) AS rrf_score, d.rank AS dense_rank, l.rank AS lexical_rank, d.score AS cosine
 FROM dense d FULL OUTER JOIN lexical l USING (query_id, chunk_id)),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id) AS fused_rank FROM fused QUALIFY fused_rank <= 25)"""


@query(f"WITH {FUSED} SELECT query_id, chunk_id, round(rrf_score, 8) AS rrf_score, dense_rank, lexical_rank, CASE WHEN dense_rank IS NULL THEN 'lexical' WHEN lexical_rank IS NULL THEN 'dense' ELSE 'dense,lexical' END AS matched FROM fused")
def f1_rrf(spark, sf_dir):
    asked, chunks, near, index = both_rankings(spark, sf_dir)
    out = fusion.rrf(near, lexical.bm25(asked, index, 30))
    return out.select("query_id", "chunk_id", F.round("rrf_score", 8).alias("rrf_score"), "dense_rank", "lexical_rank", F.array_join("matched", ",").alias("matched"))


@query(f"WITH {FUSED} SELECT query_id, chunk_id, fused_rank FROM cut")
def f2_candidate_cut(spark, sf_dir):
    asked, chunks, near, index = both_rankings(spark, sf_dir)
    return fusion.candidates(fusion.rrf(near, lexical.bm25(asked, index, 30))).select("query_id", "chunk_id", "fused_rank")


def moded(mode: str, sql: str):
    def run(spark, sf_dir):
        asked, chunks, near, index = both_rankings(spark, sf_dir)
        out = fusion.search(asked, chunks, near, mode, fusion.Settings(limit=5, per_document=0), index=index)
        return out.select("query_id", "rank", "chunk_id", "scored_by", F.round("score", 4).alias("score"))

    run.__name__ = f"f3_mode_{mode}"
    return query(f"WITH {FUSED} SELECT query_id, rank, chunk_id, scored_by, round(score, 4) AS score FROM ({sql}) WHERE rank <= 5")(run)


moded("dense", "SELECT query_id, rank, chunk_id, 'cosine' AS scored_by, score FROM dense")
moded("lexical", "SELECT query_id, rank, chunk_id, 'bm25' AS scored_by, score FROM lexical")
moded("rrf", "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 6) DESC, chunk_id) AS rank, chunk_id, 'rrf' AS scored_by, rrf_score AS score FROM cut")

PAIRS = f"""pairs AS (SELECT c.query_id, c.chunk_id, cosine, 1 / (1 + exp(-(8 * (len(list_intersect(list_distinct({tokens('q.text')}), {tokens('k.text')})) / greatest(len(list_distinct({tokens('q.text')})), 1)) - 4))) AS score
 FROM cut c JOIN questions q USING (query_id) JOIN chunks k USING (chunk_id))"""


@query(f"WITH {FUSED}, {PAIRS} SELECT query_id, chunk_id, round(score, 5) AS score FROM pairs")
def f4_pair_score(spark, sf_dir):
    asked, chunks, near, index = both_rankings(spark, sf_dir)
    cut = fusion.candidates(fusion.rrf(near, lexical.bm25(asked, index, 30)))
    pairs = cut.join(chunks.select("chunk_id", "text"), "chunk_id").join(asked.withColumnRenamed("text", "query"), "query_id")
    return pairs.select("query_id", "chunk_id", F.round(fusion.overlap_score(F.col("query"), F.col("text")), 5).alias("score"))


KEYED = f"""{FUSED}, {PAIRS}, keyed AS (SELECT *, CASE WHEN score < 0.01 THEN 0.01 * greatest(coalesce(cosine, 0), 0) ELSE score END AS key FROM pairs)"""


def scored_pairs(spark, sf_dir):
    asked, chunks, near, index = both_rankings(spark, sf_dir)
    cut = fusion.candidates(fusion.rrf(near, lexical.bm25(asked, index, 30)))
    pairs = cut.join(chunks.select("chunk_id", "text"), "chunk_id").join(asked.withColumnRenamed("text", "query"), "query_id")
    pairs = pairs.select("query_id", "chunk_id", fusion.overlap_score(F.col("query"), F.col("text")).alias("score"), "cosine")
    return pairs.withColumn("scored_by", F.lit("overlap")).withColumn("below_floor", F.lit(False)).withColumn("key", fusion.subfloor_key(F.col("score"), F.col("cosine"), 0.03))


@query(f"WITH {FUSED}, {PAIRS} SELECT query_id, chunk_id, round(score, 5) AS score FROM pairs WHERE score >= 0.05")
def f5_score_floor(spark, sf_dir):
    return fusion.score_floor(scored_pairs(spark, sf_dir), 0.05).select("query_id", "chunk_id", F.round("score", 5).alias("score"))


@query(f"WITH {FUSED}, {PAIRS} SELECT query_id, chunk_id, round(CASE WHEN score < 0.03 THEN 0.03 * greatest(coalesce(cosine, 0), 0) ELSE score END, 6) AS key FROM pairs")
def f6_subfloor_order(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("query_id", "chunk_id", F.round("key", 6).alias("key"))


@query(f"WITH {FUSED}, {PAIRS} SELECT query_id, chunk_id, round(cosine, 5) AS score, 'cosine' AS scored_by, true AS below_floor FROM pairs WHERE cosine > 0 AND query_id NOT IN (SELECT query_id FROM pairs WHERE score >= 0.5)")
def f7_floor_fallback(spark, sf_dir):
    hits = scored_pairs(spark, sf_dir)
    lost = fusion.floor_fallback(hits, fusion.score_floor(hits, 0.5))
    return lost.select("query_id", "chunk_id", F.round("score", 5).alias("score"), "scored_by", "below_floor")


def spread(ordered: str, limit: int, per_document: int = 2, share: float = 0.5) -> str:
    """CTEs ending in `picked` (query_id, place, rank): the diversity rule as a walk down each query's list, over `ordered`
    (query_id, place from 1, document_id, key)."""
    full = "len(list_filter(chosen, lambda c: docs[c] = docs[{}])) >= " + str(per_document)
    return f"""lists AS (SELECT query_id, list(document_id ORDER BY place) AS docs, list(key ORDER BY place) AS keys FROM {ordered} GROUP BY query_id),
walk AS (SELECT query_id, docs, keys, 1 AS pos, CAST([] AS BIGINT[]) AS chosen, CAST([] AS BIGINT[]) AS put_off FROM lists
 UNION ALL SELECT query_id, docs, keys, pos + 1, CASE WHEN later THEN chosen ELSE list_append(chosen, pos) END, CASE WHEN later THEN list_append(put_off, pos) ELSE put_off END
 FROM (SELECT *, {full.format('pos')} AND coalesce(keys[list_filter(range(pos + 1, len(docs) + 1), lambda j: NOT {full.format('j')})[1]] >= {share} * keys[pos], false) AS later FROM walk WHERE pos <= len(docs) AND len(chosen) < {limit})),
ended AS (SELECT query_id, list_concat(chosen, put_off)[1 : {limit}] AS l FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) = 1),
picked AS (SELECT query_id, unnest(l) AS place, generate_subscripts(l, 1) AS rank FROM ended)"""


@query(f"WITH RECURSIVE {FUSED}, listed AS (SELECT query_id, d.rank AS place, chunk_id, document_id, score AS key FROM dense d JOIN chunks USING (chunk_id)), {spread('listed', 10)} SELECT query_id, p.rank, chunk_id, document_id FROM picked p JOIN listed USING (query_id, place)")
def f8_diversify(spark, sf_dir):
    asked, chunks, near, index = both_rankings(spark, sf_dir)
    hits = near.join(chunks.select("chunk_id", "document_id"), "chunk_id").select("query_id", "rank", "chunk_id", "document_id", "score")
    return fusion.diversify(hits, 10).select("query_id", "rank", "chunk_id", "document_id")


@query(f"WITH {PASSAGES}, questions AS (SELECT item_id AS query_id, text FROM benchmark), {bm25_ctes('passages', 'questions', 5)} SELECT query_id, rank, chunk_id, p.document_id, p.category, p.chunk_index, p.text FROM lexical JOIN passages p USING (chunk_id)")
def f9_assemble_hits(spark, sf_dir):
    chunks = passages(spark, sf_dir)
    hits = lexical.bm25(question_table(spark, sf_dir), chunks, 5).withColumn("document_id", F.lit(None).cast("string"))
    out = fusion.assemble(hits, chunks, today())
    return out.select("query_id", "rank", "chunk_id", "document_id", "category", "chunk_index", "text")


FLOORED = """floored AS (SELECT query_id, chunk_id, score >= 0.01 AS good, max(score >= 0.01) OVER (PARTITION BY query_id) AS any_good, cosine,
 CASE WHEN any_good THEN score ELSE cosine END AS score, CASE WHEN any_good THEN key ELSE cosine END AS key FROM keyed QUALIFY good OR (NOT any_good AND cosine > 0)),
listed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(key, 6) DESC, chunk_id) AS place FROM floored JOIN (SELECT chunk_id, document_id, text FROM chunks) USING (chunk_id))"""


@query(f"""WITH RECURSIVE {KEYED}, {FLOORED}, {spread('listed', 5)} SELECT query_id, p.rank, chunk_id, document_id, round(score, 4) AS score, CASE WHEN any_good THEN 'overlap' ELSE 'cosine' END AS scored_by, NOT any_good AS below_floor,
 'rerank' AS mode, count(*) OVER (PARTITION BY query_id) AS total_found, text FROM picked p JOIN listed USING (query_id, place)""")
def f10_search(spark, sf_dir):
    asked, chunks, near, index = both_rankings(spark, sf_dir)
    found = fusion.assemble(fusion.search(asked, chunks, near, "rerank", index=index), chunks, today())
    return found.select("query_id", "rank", "chunk_id", "document_id", F.round("score", 4).alias("score"), "scored_by", "below_floor", "mode", "total_found", "text")


@query(f"""WITH {FUSED} SELECT query_id, rank, chunk_id, 'bm25' AS scored_by, 'lexical' AS mode, round(score, 4) AS score FROM lexical WHERE rank <= 5""")
def f10_search_words_only(spark, sf_dir):
    """Questions that hold a longer passage in another script are answered by words alone, whatever the mode."""
    asked, chunks, near, index = both_rankings(spark, sf_dir)
    odd = asked.withColumn("text", F.concat("text", F.lit(" "), F.repeat(F.lit("ж ш "), F.length("text"))))
    return fusion.search(odd, chunks, near, "rerank", index=index).select("query_id", "rank", "chunk_id", "scored_by", "mode", F.round("score", 4).alias("score"))
