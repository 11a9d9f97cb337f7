"""Inputs that several queries share, in Spark and in SQL, and a small registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DIGIT_VALUES, DIGITS, STOPWORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-empty lines of all documents as chunks."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return rows.filter("text <> ''").select(
        (F.col("doc_id") * 100000000 + F.col("i")).alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("i").cast("long").alias("chunk_index"), "text", F.col("source"), F.col("lang").alias("category")
    )


PASSAGES = """passages AS (SELECT doc_id * 100000000 + i AS chunk_id, CAST(doc_id AS VARCHAR) AS document_id, CAST(i AS BIGINT) AS chunk_index, text, source, lang AS category
 FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE text <> '')"""


def tokens(col: str) -> str:
    """The SQL of functions.text.tokenize."""
    col = f"nfc_normalize({col})"
    stop = ", ".join("'" + w + "'" for w in STOPWORDS)
    term = r"[\p{L}\p{N}\x{0300}-\x{036f}\x{0900}-\x{0963}\x{0966}-\x{0dff}]+"
    folded = f"CASE WHEN regexp_matches({col}, '[\\x{{0660}}-\\x{{0669}}\\x{{0966}}-\\x{{096f}}]') THEN translate({col}, '{''.join(DIGITS)}', '{DIGIT_VALUES}') ELSE {col} END"
    return f"list_filter(regexp_extract_all(lower({folded}), '{term}'), lambda t: length(t) > 1 AND NOT list_contains([{stop}], t))"


def words(col: str) -> str:
    return rf"regexp_extract_all(lower({col}), '[\p{{L}}\p{{N}}_]+')"


def shingles(col: str, n: int) -> str:
    return f"(CASE WHEN len({col}) >= {n} THEN list_distinct(list_transform(range(1, CAST(len({col}) - {n} + 2 AS BIGINT)), lambda i: array_to_string(list_slice({col}, i, i + {n} - 1), ' '))) ELSE [] END)"


def question_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "text")


def bm25_ctes(chunks: str, questions: str, limit: int) -> str:
    """CTEs ending in `lexical` (query_id, chunk_id, score, rank)."""
    return f"""tok AS MATERIALIZED (SELECT chunk_id, {tokens("text")} AS ts FROM {chunks}),
posts AS MATERIALIZED (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
lens AS (SELECT chunk_id, coalesce(len(ts), 0) AS len FROM tok),
stats AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lens),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts, stats GROUP BY term, n),
wanted AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({tokens("text")}) AS term FROM {questions}) GROUP BY ALL),
scored AS MATERIALIZED (SELECT query_id, chunk_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score
 FROM wanted JOIN posts USING (term) JOIN idf USING (term) JOIN lens USING (chunk_id), stats GROUP BY ALL HAVING score > 0),
lexical AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank
 FROM scored QUALIFY rank <= {limit})"""


DOC_CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, source AS document_id, text FROM documents), questions AS (SELECT item_id AS query_id, text FROM benchmark)"
#: Vectors of unit length; every fiftieth is a query.
UNIT = "unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (CASE WHEN n = 0 THEN 1 ELSE n END)) AS v FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings))"


def dense_ctes(k: int, where: str = "q.vec_id % 50 = 0") -> str:
    return f"""{UNIT},
dense AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, least(greatest(list_dot_product(q.v, d.v), -1), 1) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(least(greatest(list_dot_product(q.v, d.v), -1), 1), 6) DESC, d.vec_id) AS rank
 FROM unit q, unit d WHERE {where} QUALIFY rank <= {k})"""


def vector_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
