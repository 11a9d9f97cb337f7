"""Queries A and B: files, records, stores, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import captions, chunking
from ..sources import files
from ..sources.scratch import scratch, spread
from .shared import PASSAGES, passages, query, table


def page_files(spark, sf_dir) -> str:
    """Each web page as a text file, in folders of a thousand ids, written by all tasks."""
    folder = scratch(spark, "pages")
    name = F.concat((F.col("page_id") / 1000).cast("long").cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".txt"))
    files.write_files(spread(table(spark, sf_dir, "pages").select(name.alias("relative"), F.concat(F.coalesce("html", F.lit("")), F.lit("\n")).alias("content"))), folder)
    return folder


@query("SELECT page_id, octet_length(encode(html)) + 1 AS size FROM pages")
def a1_scan_folder(spark, sf_dir):
    found = files.list_folder(spark, page_files(spark, sf_dir))
    return found.select(files.stem(F.col("relative")).cast("long").alias("page_id"), "size")


@query("SELECT page_id, md5(html || chr(10)) AS digest FROM pages")
def a2_load_text(spark, sf_dir):
    text = files.load_text(files.scan_folder(spark, page_files(spark, sf_dir)))
    return text.select(F.col("document_id").cast("long").alias("page_id"), F.md5("text").alias("digest"))


def markdown(spark, sf_dir):
    """A document for each region: a heading, an introduction and a section for each nation."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    parts = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.array_sort(F.collect_list(F.concat(F.lit("## "), "n_name", F.lit("\nAbout "), "n_name", F.lit(".\n")))).alias("p"))
    return parts.select(F.col("r_name").alias("document_id"), F.concat(F.lit("# "), "r_name", F.lit("\nIts nations.\n\n"), F.array_join("p", "")).alias("text"))


MARKDOWN = "md AS (SELECT r_name AS document_id, '# ' || r_name || chr(10) || 'Its nations.' || chr(10) || chr(10) || string_agg('## ' || n_name || chr(10) || 'About ' || n_name || '.' || chr(10), '' ORDER BY '## ' || n_name || chr(10)) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)"
SECTIONS = f"{MARKDOWN}, heads AS (SELECT document_id, n_name AS label, strpos(text, '## ' || n_name || chr(10)) - 1 AS start, length(text) AS size FROM md, nation, region WHERE r_name = document_id AND r_regionkey = n_regionkey UNION ALL SELECT document_id, document_id, 0, length(text) FROM md), sections AS (SELECT document_id, label, start, coalesce(lead(start) OVER (PARTITION BY document_id ORDER BY start), size) AS end FROM heads)"


@query(f'WITH {SECTIONS} SELECT document_id, label, start, "end" FROM sections')
def a3_load_markdown(spark, sf_dir):
    return chunking.section_locators(markdown(spark, sf_dir)).select("document_id", "label", "start", "end")


def paged(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("page", "text"))


PAGED = "paged AS (SELECT document_id, page, text FROM (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents) WHERE trim(text) <> '')"


@query(f"WITH {PAGED} SELECT document_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS digest, max(page) AS pages FROM paged GROUP BY 1")
def a4_assemble_pages(spark, sf_dir):
    documents, locators = chunking.page_locators(paged(spark, sf_dir))
    last = locators.groupBy("document_id").agg(F.max(F.col("label").cast("int")).alias("pages"))
    return documents.select("document_id", F.md5("text").alias("digest")).join(last, "document_id")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pages' WHEN 2 THEN 'text' WHEN 3 THEN 'text' END AS loader, CASE WHEN p_partkey % 5 = 4 THEN 'unsupported: docx' END AS reason FROM part")
def a5_route_by_suffix(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".MD", ".pdf", ".txt", ".log", ".docx")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return files.route(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a/"), "p_name", suffix).alias("relative"))).select("p_partkey", "loader", "reason")


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'doc_' || s_suppkey END AS document_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Untitled' ELSE s_name END AS title, 'unknown' AS source, 'general' AS category, CASE WHEN s_suppkey % 4 = 0 THEN 'section:0:' || length(s_name) ELSE 'page:0:' || length(s_name) END AS place FROM supplier")
def a6_ingest_records(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    loc = F.array(F.struct(F.lit("section").alias("kind"), F.lit("s").alias("label"), F.lit(-5).alias("start"), F.lit(9999).alias("end")), F.struct(F.lit("odd").alias("kind"), F.lit("x").alias("label"), F.lit(0).alias("start"), F.lit(1).alias("end")))
    rows = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).otherwise("").alias("title"), F.lit(None).cast("string").alias("source"), F.lit("").alias("category"), F.col("s_name").alias("content"), F.when(F.col("s_suppkey") % 4 == 0, loc).alias("locators"), F.col("s_suppkey").alias("i"))
    first = F.get("locators", F.lit(0))
    return files.records(rows).select("document_id", "title", "source", "category", F.concat_ws(":", first["kind"], first["start"].cast("string"), first["end"].cast("string")).alias("place"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'upload:o:' || regexp_replace(s_name, '[^A-Za-z0-9._ -]+', '_', 'g') END AS document_id, CASE WHEN s_suppkey % 3 = 0 THEN 'unsupported' WHEN s_suppkey % 5 = 0 THEN 'too large' END AS reason FROM supplier")
def a7_upload_id(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, ".exe").otherwise(".txt")).alias("name"), F.lit("o").alias("owner"), F.when(F.col("s_suppkey") % 5 == 0, 26_000_000).otherwise(10).alias("size"), F.col("s_name").alias("text"))
    return files.upload(s).join(s.select("name", "s_suppkey"), "name").select("s_suppkey", "document_id", "reason")


FILES = "files AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS relative, sha256(text) AS sha256 FROM documents)"


def document_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("relative"), F.col("text").cast("binary").alias("content"), F.col("n_chars").alias("size"), (F.col("doc_id") % 13).alias("mtime"))


@query(f"WITH {FILES} SELECT relative, sha256, CASE WHEN relative <> min(relative) OVER (PARTITION BY sha256) THEN min(relative) OVER (PARTITION BY sha256) END AS same_as FROM files")
def a8_dedupe_by_content(spark, sf_dir):
    return files.dedupe_by_content(document_files(spark, sf_dir))


@query(f"""WITH {FILES}, f AS (SELECT relative, relative <> min(relative) OVER (PARTITION BY sha256) AS copy, CAST(left(relative, 9) AS BIGINT) AS id FROM files)
SELECT relative, CASE WHEN id % 11 = 5 THEN 'gone' WHEN copy THEN 'copy' WHEN id % 3 = 0 THEN 'new' WHEN id % 5 = 0 THEN 'changed' WHEN id % 7 = 0 THEN 'failed' WHEN id % 2 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM f WHERE NOT (id % 11 = 5 AND id % 3 = 0)""")
def a9_incremental_pass(spark, sf_dir):
    return incremental(spark, sf_dir)[0]


def incremental(spark, sf_dir):
    """Files of all documents but every eleventh, against a ledger that knows two thirds of them: their status, and what
    they are copies of."""
    doc = F.substring("relative", 1, 9).cast("long")
    all_of = document_files(spark, sf_dir).drop("content").join(files.dedupe_by_content(document_files(spark, sf_dir)).select("relative", "same_as"), "relative")
    ledger = document_files(spark, sf_dir).filter(doc % 3 != 0).select("relative", "mtime", F.when(doc % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (doc % 7 != 0).alias("is_stored"), F.col("relative").alias("document_id"))
    stored = ledger.filter(doc % 2 != 0).select("document_id")
    return files.incremental_pass(all_of.filter(doc % 11 != 5), ledger, stored), all_of.select("relative", "same_as")


def fresh(spark, sf_dir):
    """Every tenth document again, every other line of it, marked."""
    return passages(spark, sf_dir).filter("cast(document_id as long) % 10 = 0 and chunk_index % 2 = 0").withColumn("text", F.concat(F.lit("New. "), "text"))


@query(f"WITH {PASSAGES}, fresh AS (SELECT chunk_id, document_id, chunk_index, 'New. ' || text AS text FROM passages WHERE CAST(document_id AS BIGINT) % 10 = 0 AND chunk_index % 2 = 0) SELECT chunk_id, document_id, md5(text) AS digest FROM fresh UNION ALL SELECT chunk_id, document_id, md5(text) FROM passages WHERE document_id NOT IN (SELECT document_id FROM fresh)")
def a10_upsert_documents(spark, sf_dir):
    return files.upsert(passages(spark, sf_dir), fresh(spark, sf_dir)).select("chunk_id", "document_id", F.md5("text").alias("digest"))


FORGET = "ids AS (SELECT CAST(item_id * 3 AS VARCHAR) AS document_id FROM benchmark UNION ALL SELECT 'nothing')"


def unwanted(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).cast("string").alias("document_id")).unionByName(spark.createDataFrame([("nothing",)], "document_id string"))


@query(f"WITH {PASSAGES}, {FORGET} SELECT document_id, count(chunk_id) > 0 AS found, count(chunk_id) AS chunks FROM ids LEFT JOIN passages USING (document_id) GROUP BY 1")
def a11_forget_documents(spark, sf_dir):
    return files.forget(passages(spark, sf_dir), unwanted(spark, sf_dir))[1]


@query(f"WITH {PASSAGES} SELECT b.item_id * 100000000 AS chunk_id, document_id, p.text FROM benchmark b LEFT JOIN passages p ON p.chunk_id = b.item_id * 100000000")
def a12_get_chunk(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 100000000).alias("chunk_id"))
    return files.get_chunks(passages(spark, sf_dir), ids).select("chunk_id", "document_id", "text")


@query(f"WITH {PASSAGES} SELECT chunk_id, category FROM passages")
def a13_scan_store(spark, sf_dir):
    return passages(spark, sf_dir).select("chunk_id", "category")


@query("SELECT CAST(vec_id AS VARCHAR) AS query_id, 'l' || label AS document_id, CAST(label + 1 AS DOUBLE) AS grade FROM embeddings")
def a14_read_qrels(spark, sf_dir):
    """Judgements written as TSV with their header, and two short rows."""
    folder = scratch(spark, "qrels")
    rows = table(spark, sf_dir, "embeddings").select(F.concat_ws("\t", F.col("vec_id").cast("string"), F.concat(F.lit("l"), F.col("label").cast("string")), (F.col("label") + 1).cast("string")).alias("value"))
    head = spark.createDataFrame([("query-id\tcorpus-id\tscore",), ("short\trow",), ("",)], "value string")
    rows.unionByName(head).write.text(folder)
    return files.read_qrels(spark, folder)


@query("SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark WHERE item_id % 2 = 0")
def a15_read_queries(spark, sf_dir):
    folder = scratch(spark, "questions")
    table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("_id"), "text").write.json(folder)
    judged = table(spark, sf_dir, "benchmark").filter("item_id % 2 = 0").select(F.col("item_id").cast("string").alias("query_id"))
    return files.read_queries(spark, folder, judged)


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, md5(CASE WHEN doc_id % 3 = 0 THEN source || chr(10) || chr(10) || text WHEN doc_id % 3 = 1 THEN text ELSE source END) AS digest FROM documents WHERE NOT (doc_id % 3 = 1 AND text = '')")
def a16_read_corpus(spark, sf_dir):
    folder = scratch(spark, "corpus")
    d = table(spark, sf_dir, "documents")
    d.select(F.col("doc_id").cast("string").alias("_id"), F.when(F.col("doc_id") % 3 == 1, "").otherwise(F.col("source")).alias("title"), F.when(F.col("doc_id") % 3 == 2, "").otherwise(F.col("text")).alias("text")).write.json(folder)
    return files.read_corpus(spark, folder).select("document_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, unit FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['d' || doc_id || '#p1', 'd' || doc_id || '#p2'] ELSE ['d' || doc_id] END AS units FROM labels), unnest(units) AS u(unit)")
def a17_read_golden(spark, sf_dir):
    """Golden questions, one for each label, written as JSON lines: with pages, or with documents."""
    folder, name = scratch(spark, "golden"), F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    pages = F.when(F.col("doc_id") % 2 == 0, F.create_map(name, F.array(F.lit(1), F.lit(2))))
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("exact").alias("kind"), F.lit(True).alias("answerable"), F.lit("?").alias("question"), F.array(name).alias("relevant_docs"), pages.alias("relevant_pages"))
    rows.write.json(folder)
    return files.read_golden(spark, folder)[1].select(F.col("query_id").cast("long").alias("doc_id"), "unit")


@query("""SELECT '{' || string_agg('"' || mode || '":{' || body || '}', ',' ORDER BY mode) || '}' AS modes FROM (SELECT mode, string_agg('"' || metric || '":' || value, ',' ORDER BY metric) AS body
 FROM (SELECT o_orderpriority AS mode, o_orderstatus AS metric, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY ALL) GROUP BY mode)""")
def a18_write_run(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("metric")).agg(F.round(F.avg("o_totalprice"), 2).alias("value"))
    return files.run_payload(rows)


@query("SELECT source, coalesce(min(lang) FILTER (WHERE lang = 'de'), 'en') AS built, coalesce(min(lang) FILTER (WHERE lang = 'de'), 'en') = 'en' AS accepted FROM documents GROUP BY source")
def a19_model_stamp_guard(spark, sf_dir):
    """Each source as a store, stamped with a model if it has German documents, and opened with the default one."""
    stores = table(spark, sf_dir, "documents").groupBy("source").agg(F.min(F.when(F.col("lang") == "de", F.col("lang"))).alias("stamp"), F.count("*").alias("n"))
    built = files.built_with(F.col("stamp"), F.col("n"), F.lit("en"), "en")
    return stores.select("source", built.alias("built"), (built == "en").alias("accepted"))


@query("SELECT CAST(p_size AS VARCHAR) AS document_id, array_to_string(list_sort(list(p_partkey) FILTER (WHERE p_partkey % 4 = 0)), ',') AS lost FROM part GROUP BY 1 HAVING count(*) FILTER (WHERE p_partkey % 4 = 0) > 0")
def a20_page_loss(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("document_id"), F.col("p_partkey").alias("page"), (F.col("p_partkey") % 4 != 0).alias("readable"))
    return files.page_loss(pages).select("document_id", F.array_join(F.col("lost").cast("array<string>"), ",").alias("lost"))


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")


BARE = r"regexp_replace(text, '[\s\p{Z}]+', '', 'g')"


@query(rf"SELECT CAST(doc_id AS VARCHAR) AS document_id, md5({BARE}) AS digest, true AS fits FROM documents WHERE {BARE} <> ''")
def b1_leaf_spans(spark, sf_dir):
    """The parts hold all of a text but white space, once and in order, and only single words exceed the budget."""
    parts = chunking.leaf_spans(texts(spark, sf_dir))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "")
    fits = F.every((F.col("tokens") <= chunking.TARGET) | ~F.col("text").rlike(r"(?U)\s"))
    return parts.groupBy("document_id").agg(F.md5(F.regexp_replace(whole, r"(?U)\s+", "")).alias("digest"), fits.alias("fits")).filter(F.col("digest") != F.md5(F.lit("")))


def chunked(spark, sf_dir):
    """Chunks of all documents with a small budget, so that most have several."""
    return chunking.chunk_documents(texts(spark, sf_dir), chunking.Chunker(target=chunking.LEAST_TARGET))


@query(rf"SELECT CAST(doc_id AS VARCHAR) AS document_id, true AS forward FROM documents WHERE {BARE} <> ''")
def b2_overlap_tail(spark, sf_dir):
    """A chunk starts within or after the one before it, and always brings something new."""
    chunks = chunked(spark, sf_dir)
    good = chunking.overlaps(chunks).groupBy("document_id").agg(F.every(F.col("fresh") > 0).alias("forward"))
    return chunks.select("document_id").distinct().join(good, "document_id", "left").select("document_id", F.coalesce("forward", F.lit(True)).alias("forward"))


@query(rf"SELECT CAST(doc_id AS VARCHAR) AS document_id, true AS long_enough FROM documents WHERE {BARE} <> ''")
def b4_merge_runt(spark, sf_dir):
    """No last chunk of several is shorter than the least."""
    last = chunked(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n"), F.max_by("tokens", "chunk_index").alias("tokens"))
    return last.select("document_id", ((F.col("n") == 1) | (F.col("tokens") >= chunking.LEAST)).alias("long_enough"))


@query(rf"SELECT CAST(doc_id AS VARCHAR) AS document_id, true AS gapless, true AS at_place, true AS fits FROM documents WHERE {BARE} <> ''")
def b3_chunks_hold(spark, sf_dir):
    """Chunks are numbered from 0, stand in the text where they say, and hold no more than a carried unit of half the
    budget, a full one and a runt."""
    c = chunking.chunk_documents(texts(spark, sf_dir)).join(texts(spark, sf_dir).withColumnRenamed("text", "whole"), "document_id")
    at_place = F.every(F.col("text") == F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    fits = F.every((F.col("tokens") <= chunking.TARGET * 3 // 2 + chunking.LEAST) | ~F.col("text").rlike(r"(?U)\s"))
    return c.groupBy("document_id").agg((F.max("chunk_index") + 1 == F.count_distinct("chunk_index")).alias("gapless"), at_place.alias("at_place"), fits.alias("fits"))


@query()
def b3_chunk_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return chunking.chunk_documents(docs)


def tabled(spark, sf_dir):
    """A document for each region with a pipe table of its nations."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.array_sort(F.collect_list(F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |")))).alias("p"))
    return rows.select(F.col("r_name").alias("document_id"), F.concat(F.lit("Nations of "), "r_name", F.lit(".\n\n| Nation | Key |\n|---|---|\n"), F.array_join("p", "\n"), F.lit("\n\nThat is all.")).alias("text"))


@query("""SELECT r_name AS document_id, length('Nations of ' || r_name || '.') + 2 + length('| Nation | Key |') + 1 + length('|---|---|') + 1 AS start, length('Nations of ' || r_name || '.') + 2 + length('| Nation | Key |') + 1 + length('|---|---|') + 1 + sum(length('| ' || n_name || ' | ' || n_nationkey || ' |') + 1) - 1 AS "end", '| Nation | Key |' AS context FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def b6_find_markdown_tables(spark, sf_dir):
    return chunking.markdown_tables(tabled(spark, sf_dir))


@query("""SELECT r_name AS document_id, length('TABLE 1: the keys of all nations of this region.') + 1 + length('Nation Key') + 1 AS start, length('TABLE 1: the keys of all nations of this region.') + 1 + length('Nation Key') + sum(length(n_name || ' ' || n_nationkey) + 1) AS "end", 'TABLE 1: the keys of all nations of this region.' || chr(10) || 'Nation Key' AS context FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def b7_find_caption_tables(spark, sf_dir):
    """A document for each region with a captioned table of its nations in plain text."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.array_sort(F.collect_list(F.concat("n_name", F.lit(" "), F.col("n_nationkey").cast("string")))).alias("p"))
    docs = rows.select(F.col("r_name").alias("document_id"), F.concat(F.lit("TABLE 1: the keys of all nations of this region.\nNation Key\n"), F.array_join("p", "\n"), F.lit("\n\nAnd that is all there is to say.")).alias("text"))
    return captions.find_caption_tables(docs)


@query("SELECT r_name AS document_id, count(*) AS n_rows, count(DISTINCT n_nationkey) AS n_different, true AS under_context FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def b5_table_rows_hold(spark, sf_dir):
    """Each row of a table stands in one chunk, below the table's context."""
    rows = b5_chunk_table_rows(spark, sf_dir).filter("kind = 'row'").withColumn("lines", F.split("text", "\n"))
    under = rows.groupBy("document_id").agg(F.every(F.get("lines", F.lit(0)) == "| Nation | Key |").alias("under_context"))
    each = rows.select("document_id", F.explode(F.slice("lines", 2, 1_000_000)).alias("line"))
    return each.groupBy("document_id").agg(F.count("*").alias("n_rows"), F.count_distinct("line").alias("n_different")).join(under, "document_id")


@query()
def b5_chunk_table_rows(spark, sf_dir):
    docs = tabled(spark, sf_dir)
    spans = chunking.markdown_tables(docs).groupBy("document_id").agg(F.collect_list(F.struct("start", "end", "context")).alias("tables"))
    return chunking.chunk_documents(docs.join(spans, "document_id", "left"), chunking.Chunker(row_tokens=20))


LOCATED = f"""{SECTIONS}, lines AS (SELECT document_id, i AS chunk_index, sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY i) - length(line) - 1 AS char_start FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM md))"""


def line_chunks(spark, sf_dir):
    return chunking.markdown_lines(markdown(spark, sf_dir)).select("document_id", F.col("i").alias("chunk_index"), F.col("line").alias("text"), F.col("start").alias("char_start"))


@query(f'WITH {LOCATED} SELECT l.document_id, chunk_index, label AS section FROM lines l LEFT JOIN sections s ON s.document_id = l.document_id AND char_start >= start AND char_start < "end"')
def b8_locate(spark, sf_dir):
    return chunking.locate(line_chunks(spark, sf_dir), chunking.section_locators(markdown(spark, sf_dir))).select("document_id", "chunk_index", "section")


@query(f"WITH {LOCATED} SELECT document_id, max(chunk_index) + 1 AS chunk_index, 'Overview of T' || document_id || '.' || chr(10) || 'All about ' || document_id AS text FROM lines GROUP BY 1")
def b9_summary_chunk(spark, sf_dir):
    docs = markdown(spark, sf_dir).select("document_id")
    out = chunking.summary_chunks(line_chunks(spark, sf_dir), docs.withColumn("summary", F.concat(F.lit("All about "), "document_id")), docs.withColumn("title", F.concat(F.lit("T"), "document_id")))
    return out.select("document_id", "chunk_index", "text")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')) AS tokens FROM documents")
def b10_count_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.count_tokens(F.col("text")).cast("long").alias("tokens"))
