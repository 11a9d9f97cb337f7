"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, predict

    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return predict(docs, fit(docs.filter(~fold))).withColumn("held_out", fold)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, grade

    docs = table(spark, sf_dir, "documents")
    return grade(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import decode, encode

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    both = decode(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 100 = 0"), k=10)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), width=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens, over_limit

    return over_limit(count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")), 4096)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    found = report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_term")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), anchors=lambda i: i % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxsketch import build_index, search

    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=20)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, new_folder, page_records

    path = new_folder(spark)
    archive(table(spark, sf_dir, "pages"), path, least_bytes=0)
    return page_records(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language, op2_toxicity, op3_packing, op4_bpe, op5_nearest, op6_substring_dedup, op7_token_counts, op8_simhash, op9_personal_data, op10_embedding_dedup, op11_hard_negatives, op12_ranked_search, op13_warc)
    return {f.__name__: f for f in own}
