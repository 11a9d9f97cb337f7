"""A corpus cleaning pipeline: language identification, SimHash near-dedup, substring dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Documents whose text is null, empty or without letters are rejected by the first stage. A null id, and ids or rows that
repeat, go through all stages like others, but that near_dedup keeps one row of each group of near copies, the smallest id
(null last). An empty table gives an empty one at each stage. Columns other than those of documents are dropped by the
first stage, whatever their names; a column of documents that is missing is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import removed, written
from gleanery.llm.langid import UNDETERMINED, fit, held_out, predict
from gleanery.llm.packing import pack_documents
from gleanery.llm.pii import sanitise
from gleanery.llm.queries import vocabulary
from gleanery.llm.simhash import one_of_each
from gleanery.llm.substring import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language is undetermined: no text, or no letters in it."""
    model = fit(docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    return predict(docs, model, keep=COLUMNS).filter(F.col("lang_pred") != UNDETERMINED).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id."""
    return one_of_each(docs.select(*COLUMNS), width=3)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 35 words or more that occur elsewhere as well; texts that change are rejoined by spaces."""
    found = remove_repeats(docs, width=35, keep=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that give it away."""
    return sanitise(docs, keep=COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 4096 tokens: one row for each piece of a document."""
    pieces = pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("near_dedup", near_dedup), ("substrings", substrings), ("personal_data", personal_data), ("packing", packing)]
#: SQL has neither the language model nor the tokenizer; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            removed(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
