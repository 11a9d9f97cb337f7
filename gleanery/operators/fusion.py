"""Rank fusion, score floors, diversity and the whole search."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import dates_in, passage_dates
from ..functions.ids import filled
from ..functions.text import tokenize
from .lexical import DIGITS, Index, bm25, effective_mode

RRF_K, PER_RETRIEVER, CANDIDATES, FLOOR = 60, 30, 25, 0.01
MODES = {"dense": "cosine", "lexical": "bm25", "rrf": "rrf", "rerank": "overlap"}


@dataclass(frozen=True)
class Settings:
    limit: int = 5
    min_score: float = FLOOR
    per_document: int = 2
    backfill_share: float = 0.5
    order_below_floor: bool = True
    fallback: bool = True

    def __post_init__(self):
        if not 1 <= self.limit <= 25 or not 0 <= self.min_score <= 1:
            raise ValueError("limit must be 1 to 25 and min_score 0 to 1")


def rrf(dense: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, rrf_score, dense_rank, lexical_rank, cosine, matched of two rankings."""
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("cosine"))
    w = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("bm25"))
    both = d.join(w, ["query_id", "chunk_id"], "full_outer")
    score = sum((F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "lexical_rank")), F.lit(0.0))
    matched = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), F.lit("dense")), F.when(F.col("lexical_rank").isNotNull(), F.lit("lexical"))))
    return both.withColumn("rrf_score", score).withColumn("matched", matched)


def candidates(fused: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The first `most` of each query's fused list; ties go by dense rank, lexical rank, id."""
    w = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 9).desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "chunk_id")
    return fused.withColumn("fused_rank", F.row_number().over(w)).filter(F.col("fused_rank") <= most)


def overlap_score(query: Column, passage: Column) -> Column:
    """The default pair scorer, named for what it is: the logistic of the share of the query's terms in the passage."""
    q = F.array_distinct(tokenize(query))
    share = F.size(F.array_intersect(q, tokenize(passage))) / F.greatest(F.size(q), F.lit(1))
    return 1 / (1 + F.exp(-(8 * share - 4)))


def score_floor(hits: DataFrame, min_score: float) -> DataFrame:
    """Only pair scores are probabilities that a floor can cut."""
    return hits.filter((F.col("scored_by") != MODES["rerank"]) | (F.col("score") >= min_score))


def subfloor_key(score: Column, cosine: Column, floor: float = FLOOR) -> Column:
    """Below the fixed floor, order follows the cosine; reported scores don't change."""
    return F.when(score < floor, floor * F.greatest(F.coalesce(cosine, F.lit(0.0)), F.lit(0.0))).otherwise(score)


def floor_fallback(candidate_hits: DataFrame, kept: DataFrame) -> DataFrame:
    """For queries that keep nothing: their candidates with a positive cosine, scored by it and marked below_floor."""
    lost = candidate_hits.join(kept.select("query_id").distinct(), "query_id", "left_anti").filter("cosine > 0")
    return lost.withColumn("score", F.col("cosine")).withColumn("key", F.col("cosine")).withColumn("scored_by", F.lit("cosine")).withColumn("below_floor", F.lit(True))


def spread_out(documents: list, keys: list[float], limit: int, per_document: int, share: float) -> list[int]:
    """The places of the chosen hits. One whose document is full is put off, for good, if the next one of a document that
    isn't full has at least `share` of its key; those put off fill what is left, in their order."""
    chosen, put_off, held = [], [], Counter()
    for i, d in enumerate(documents):
        if len(chosen) == limit:
            break
        if held[d] >= per_document:
            other = next((keys[j] for j in range(i + 1, len(documents)) if held[documents[j]] < per_document), None)
            if other is not None and other >= share * keys[i]:
                put_off.append(i)
                continue
        held[d] += 1
        chosen.append(i)
    return [*chosen, *put_off][:limit]


def diversify(hits: DataFrame, limit: int, per_document: int = 2, share: float = 0.5) -> DataFrame:
    """`limit` hits of a query, at most `per_document` of a document while others compete (see spread_out), ranked anew.
    Columns: query_id, rank, document_id and key, by which the hits are ordered (score where there is no key). No cap: 0.
    A query's group is its candidate list, which the cut before this bounds."""
    schema = hits.select(*[c for c in hits.columns if c != "rank"], F.col("rank").cast("int").alias("rank")).schema
    key = "key" if "key" in hits.columns else "score"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        chosen = spread_out(pdf.document_id.tolist(), pdf[key].tolist(), limit, per_document, share) if per_document > 0 else range(min(limit, len(pdf)))
        out = pdf.iloc[list(chosen)].reset_index(drop=True)
        out["rank"] = range(1, len(out) + 1)
        return out[schema.names]

    return hits.select(*schema.names).groupBy("query_id").applyInPandas(pick, schema)


def newest_dates(chunks: DataFrame, today: Column) -> DataFrame:
    """document_id, newest: the latest date written anywhere in each document."""
    return chunks.groupBy("document_id").agg(F.max(F.array_max(dates_in(F.col("text"), today))).alias("newest"))


def assemble(hits: DataFrame, chunks: DataFrame, today: Column) -> DataFrame:
    """Hits with their passage: defaults filled in, score rounded, dates of the passage and of its document. Only the
    documents that were hit are searched for dates."""
    need = ("title", "source", "category", "section", "page", "chunk_index")
    own = chunks.select("chunk_id", "document_id", "text", *[c for c in need if c in chunks.columns])
    joined = own.join(hits.drop("document_id"), "chunk_id")
    dates = newest_dates(chunks.join(joined.select("document_id").distinct(), "document_id", "left_semi"), today)
    out = joined.join(dates, "document_id", "left")
    cells = {"title": "Untitled", "source": "unknown", "category": "general"}
    for c, default in cells.items():
        if c in out.columns:
            out = out.withColumn(c, filled(F.col(c), default))
    return out.withColumn("score", F.round("score", 4)).withColumn("dates_in_passage", passage_dates(dates_in(F.col("text"), today)))


def floored(hits: DataFrame, min_score: float, fallback: bool) -> DataFrame:
    """The floor and its fallback in one pass over each query's candidates: those at or above the floor, or where a query
    has none, those with a positive cosine, scored by it."""
    reranked = F.col("scored_by") == MODES["rerank"]
    good = ~reranked | (F.col("score") >= min_score)
    if not (fallback and min_score > 0):
        return hits.filter(good)
    any_good = F.max(good).over(Window.partitionBy("query_id"))
    out = hits.withColumn("good", good).withColumn("lost", ~any_good).filter(F.col("good") | (F.col("lost") & (F.col("cosine") > 0)))
    for c in ("score", "key"):
        out = out.withColumn(c, F.when(F.col("lost"), F.col("cosine")).otherwise(F.col(c)))
    return out.withColumn("scored_by", F.when(F.col("lost"), MODES["dense"]).otherwise(F.col("scored_by"))).withColumn("below_floor", F.col("lost")).drop("good", "lost")


def search(queries: DataFrame, chunks: DataFrame, dense: DataFrame, mode: str = "rerank", cfg: Settings | None = None, scorer: Callable[[Column, Column], Column] | None = overlap_score, models_read: str = "english", index: Index | None = None, words: DataFrame | None = None) -> DataFrame:
    """query_id, rank, chunk_id, document_id, score, scored_by, cosine, below_floor, mode, min_score, total_found and note
    for a table of queries; `assemble` adds the passages.

    `dense` is a ranking (query_id, chunk_id, score, rank) by any vector index, `words` one by BM25 where it was made before;
    or else `index` is a lexical index of the chunks, built here if there is none. Queries in a script that the models don't
    read are answered by words alone, whatever the mode. Without a pair scorer, `rerank` answers with fusion scores and
    says so."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    cfg = cfg or Settings()
    routed = effective_mode(queries.select("query_id", F.col("text").alias("query")).withColumn("text", F.col("query")), mode, models_read).drop("text")
    by_words = words.filter(F.col("rank") <= PER_RETRIEVER) if words is not None else bm25(queries, index or chunks, PER_RETRIEVER)
    words_only = F.col("mode") == "lexical"
    dense = dense.filter(F.col("rank") <= PER_RETRIEVER).join(routed.filter(F.col("mode_eff") != "lexical").select("query_id"), "query_id", "left_semi")
    ranked = candidates(rrf(dense, by_words), CANDIDATES if mode in ("rrf", "rerank") else 2 * PER_RETRIEVER)
    ranked = ranked.join(routed.withColumnRenamed("mode_eff", "mode"), "query_id")
    scored_by = F.when(words_only, MODES["lexical"]).otherwise(MODES[mode] if mode != "rerank" or scorer else MODES["rrf"])
    score = F.col("rrf_score")
    if mode == "dense":
        ranked, score = ranked.filter(words_only | F.col("dense_rank").isNotNull()), F.col("cosine")
    elif mode == "rerank" and scorer:
        ranked = ranked.join(chunks.select("chunk_id", "text"), "chunk_id")
        score = scorer(F.col("query"), F.col("text"))
    score = F.when(words_only, F.col("bm25")).otherwise(score)
    hits = ranked.select("query_id", "chunk_id", score.alias("score"), "cosine", scored_by.alias("scored_by"), F.lit(False).alias("below_floor"), "mode", "note")
    reranked = F.col("scored_by") == MODES["rerank"]
    key = F.when(reranked, subfloor_key(F.col("score"), F.col("cosine"))).otherwise(F.col("score")) if cfg.order_below_floor else F.col("score")
    kept = floored(hits.withColumn("key", key), cfg.min_score, cfg.fallback)
    w = Window.partitionBy("query_id").orderBy(F.round("key", DIGITS).desc(), "chunk_id")
    kept = kept.withColumn("rank", F.row_number().over(w)).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    spread = F.col("scored_by").isin(MODES["dense"], MODES["rerank"])
    if mode in ("lexical", "rrf") or cfg.per_document <= 0 or (mode == "rerank" and not scorer):
        out = kept.filter(F.col("rank") <= cfg.limit)
    else:
        out = diversify(kept.filter(spread), cfg.limit, cfg.per_document, cfg.backfill_share).unionByName(kept.filter(~spread & (F.col("rank") <= cfg.limit)).withColumn("rank", F.col("rank").cast("int")))
    out = out.withColumn("total_found", F.count("*").over(Window.partitionBy("query_id"))).withColumn("min_score", F.lit(cfg.min_score))
    return out.select("query_id", "rank", "chunk_id", "document_id", "score", "scored_by", "cosine", "below_floor", "mode", "min_score", "total_found", "note")
