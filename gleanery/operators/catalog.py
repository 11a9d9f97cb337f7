"""The catalogue of a chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import visible_to
from ..functions.text import lead_text

SUMMARY = "summary"


def list_documents(chunks: DataFrame) -> DataFrame:
    """document_id, title, category, chunks (summaries not counted), pages, overview (a summary without its first line),
    lead (the opening of the first chunk), ordered by category and title."""
    is_summary = F.col("kind") == SUMMARY
    overview = F.max(F.when(is_summary, F.regexp_replace("text", r"^[^\n]*\n?", "")))
    out = chunks.groupBy("document_id").agg(
        F.min("title").alias("title"), F.min("category").alias("category"), F.count(F.when(~is_summary, 1)).alias("chunks"), F.max("page").alias("pages"), overview.alias("overview"),
        lead_text(F.min_by(F.when(~is_summary, F.col("text")), F.when(~is_summary, F.col("chunk_index")))).alias("lead"),
    )
    return out.orderBy("category", F.lower("title"), "document_id")


def store_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, documents, summaries."""
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.count(F.when(F.col("kind") == SUMMARY, 1)).alias("summaries"))


def scoped_stats(chunks: DataFrame, owners: DataFrame) -> DataFrame:
    """owner, chunks, documents: the same counts over what each owner may see. Documents are counted once; owners meet
    only the per-document counts of the shared corpus and their own."""
    from ..functions.ids import SHARED, owner_of

    per_document = chunks.groupBy("document_id").agg(F.count("*").alias("n")).withColumn("of", owner_of(F.col("document_id")))
    per_owner = per_document.groupBy("of").agg(F.sum("n").alias("chunks"), F.count("*").alias("documents"))
    shared = per_owner.filter(F.col("of") == SHARED).agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("c0"), F.coalesce(F.sum("documents"), F.lit(0)).alias("d0"))
    own = owners.select("owner").distinct().join(per_owner.filter(F.col("of") != SHARED), F.col("owner") == F.col("of"), "left").crossJoin(F.broadcast(shared))  # one row
    return own.select("owner", (F.coalesce("chunks", F.lit(0)) + F.col("c0")).alias("chunks"), (F.coalesce("documents", F.lit(0)) + F.col("d0")).alias("documents"))


def visible_chunks(chunks: DataFrame, owner: str) -> DataFrame:
    """The shared corpus and the owner's uploads: a filter before any ranking."""
    return chunks.filter(visible_to(F.lit(owner), F.col("document_id")))
