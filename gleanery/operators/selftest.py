"""A library's test of itself: sampling passages, grading questions, copies and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shingles, words
from ..sources.scratch import kept, scratch

LEAST_WORDS, COPIED_RUN, VERSION_RUN, VERSION_SHARE = 25, 8, 5, 0.5


def draw(seed: int, *cols: str) -> Column:
    """A reproducible order that doesn't depend on partitions."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of its parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def eligible(chunks: DataFrame) -> DataFrame:
    return chunks.filter((F.coalesce("kind", F.lit("text")) != "summary") & (F.size(words(F.col("text"))) >= LEAST_WORDS))


def round_robin_sample(chunks: DataFrame, size: int, seed: int) -> DataFrame:
    """One passage of each document in turn, until `size` (1 to 50) are drawn."""
    if not 1 <= size <= 50:
        raise ValueError("size must be 1 to 50")
    turn = F.row_number().over(Window.partitionBy("document_id").orderBy(draw(seed, "chunk_id"), "chunk_id"))
    return eligible(chunks).withColumn("turn", turn).orderBy("turn", draw(seed, "document_id"), "document_id").limit(size)


def copied(question: Column, passage: Column, run: int = COPIED_RUN) -> Column:
    """The question repeats a run of the passage's words."""
    return F.arrays_overlap(shingles(words(question), run), shingles(words(passage), run))


def copied_pairs(questions: DataFrame, passages: DataFrame, run: int = COPIED_RUN) -> DataFrame:
    """query_id, chunk_id of all pairs in which the question repeats a run of the passage's words: a join on the runs, of
    which passages keep those that some question has."""
    runs = lambda df, key: df.select(key, F.explode(shingles(words(F.col("text")), run)).alias("run"))
    asked = kept(runs(questions, "query_id"), scratch(questions.sparkSession, "runs"))  # of known size, so that few questions go to the passages
    held = runs(passages, "chunk_id").join(asked.select("run").distinct(), "run", "left_semi")
    return held.join(asked, "run").select("query_id", "chunk_id").distinct()


def duplicates(chunks: DataFrame) -> DataFrame:
    """document_id, original: documents whose word sequence is an earlier id's. Summaries don't count, nor do empty ones."""
    texts = chunks.filter(F.coalesce("kind", F.lit("text")) != "summary").select("document_id", "chunk_index", F.array_join(words(F.col("text")), " ").alias("w")).filter("w <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "w")))
    hashed = texts.groupBy("document_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["w"]), " "), 256).alias("digest"))
    hashed = kept(hashed, scratch(chunks.sparkSession, "digests"))  # read twice
    # partial minima of those that repeat: however many copies a document has, no task gathers them
    first = hashed.groupBy("digest").agg(F.min("document_id").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return hashed.join(first, "digest").filter("document_id <> original").select("document_id", "original")


def cannot_search(not_indexed: DataFrame, copies: DataFrame) -> DataFrame:
    """file, reason, part: what wasn't indexed, files without text first, and then copies."""
    a = not_indexed.select("file", "reason", F.when(F.col("reason") == "no text", 0).otherwise(1).alias("part"))
    b = copies.select(F.col("document_id").alias("file"), F.concat(F.lit("copy of "), F.col("original")).alias("reason"), F.lit(2).alias("part"))
    return a.unionByName(b)


def grade_questions(questions: DataFrame, chunks: DataFrame, hits: DataFrame, depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """(graded, refused). Graded: passage_id, rank of the passage, document_rank, first result and its document. Refused:
    questions without text, or about a passage that isn't there."""
    known = questions.join(chunks.select(F.col("chunk_id").alias("passage_id"), "document_id"), "passage_id", "left")
    empty = F.length(F.trim("question")) == 0
    refused = known.filter(empty | F.col("document_id").isNull()).select("passage_id", F.when(F.col("document_id").isNull(), "unknown passage").otherwise("empty question").alias("reason"))
    good = known.filter(~empty & F.col("document_id").isNotNull())
    found = good.join(hits.filter(F.col("rank") <= depth).select("query_id", "rank", F.col("chunk_id").alias("hit"), F.col("document_id").alias("hit_document")), "query_id", "left")
    out = found.groupBy("query_id", "passage_id", "document_id").agg(
        F.min(F.when(F.col("hit") == F.col("passage_id"), F.col("rank"))).alias("rank"), F.min(F.when(F.col("hit_document") == F.col("document_id"), F.col("rank"))).alias("document_rank"),
        F.min_by("hit", "rank").alias("first"), F.min_by("hit_document", "rank").alias("first_document"),
    )
    return out, refused


def grades(graded: DataFrame) -> DataFrame:
    """One row: share first, share in the first five, share with the right document first."""
    share = lambda c: F.round(F.avg(F.coalesce(c.cast("int"), F.lit(0))), 4)
    return graded.agg(share(F.col("rank") == 1).alias("first"), share(F.col("rank") <= 5).alias("top5"), share(F.col("document_rank") == 1).alias("right_document"))


def chance_range(ranks: DataFrame, seed: int, draws: int = 2000, n: int | None = None, by: list[str] | None = None) -> DataFrame:
    """low, high: the 5th and 95th percentile of the top-5 share over resamples (order statistics draws / 20 and draws *
    19 / 20 - 1, from 0), in each group. Ranks of a group are numbered and drawn by md5 uniforms."""
    by = by or []
    ranked = ranks.withColumn("i", F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy("query_id")) - 1)
    sizes = ranked.groupBy(*by).agg(F.count("*").alias("m"))
    size = F.lit(n) if n else F.col("m")
    picks = sizes.select(*by, "m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), size.alias("n")).select(*by, "m", "draw", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("j"))
    i = F.floor(uniform(F.lit(str(seed)), F.col("draw").cast("string"), F.col("j").cast("string")) * F.col("m")).cast("int")
    drawn = picks.withColumn("i", i).join(ranked.select(*by, "i", "rank"), [*by, "i"])
    share = drawn.groupBy(*by, "draw").agg(F.avg(F.coalesce((F.col("rank") <= 5).cast("int"), F.lit(0))).alias("share"))
    sorted_of = share.groupBy(*by).agg(F.array_sort(F.collect_list("share")).alias("s"))
    return sorted_of.select(*by, F.get("s", F.lit(draws // 20)).alias("low"), F.get("s", F.lit(draws * 19 // 20 - 1)).alias("high"))


def lost_to_copies(graded: DataFrame, copies: DataFrame) -> DataFrame:
    """query_id of questions not answered first whose first result is another copy of the right document."""
    group = copies.select("document_id", F.col("original").alias("grp")).unionByName(copies.select(F.col("original").alias("document_id"), F.col("original").alias("grp")).distinct())
    missed = graded.filter("coalesce(rank, 0) <> 1 and document_id <> first_document")
    own = missed.join(group, "document_id").join(group.select(F.col("document_id").alias("first_document"), F.col("grp").alias("other")), "first_document")
    return own.filter("grp = other").select("query_id")


def lost_to_versions(graded: DataFrame, chunks: DataFrame, lost: DataFrame) -> DataFrame:
    """query_id of the others whose first result's document holds half of the passage's five-word runs and shares half of
    the smaller document's. Documents are compared once a pair, however many questions it lost, and passages only where
    their documents are alike."""
    folder = scratch(chunks.sparkSession, "versions")
    missed = graded.filter("coalesce(rank, 0) <> 1 and document_id <> first_document").join(lost, "query_id", "left_anti")
    missed = kept(missed.select("query_id", "passage_id", "document_id", "first_document"), f"{folder}/missed")
    runs = F.transform(shingles(words(F.col("text")), VERSION_RUN), lambda x: F.xxhash64(x))
    pairs = missed.select("document_id", "first_document").distinct()
    needed = pairs.select("document_id").unionByName(pairs.select(F.col("first_document").alias("document_id"))).distinct()
    # texts move once, by document, where a row holds a document's different runs as numbers; these move once more, to the other
    docs = chunks.select("document_id", "text").join(needed, "document_id", "left_semi").select("document_id", runs.alias("own"))
    docs = docs.groupBy("document_id").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own")).filter(F.size("own") > 0)
    both = pairs.join(docs, "document_id").join(docs.select(F.col("document_id").alias("first_document"), F.col("own").alias("other")), "first_document")
    common = F.size(F.array_intersect("own", "other"))
    # at least one in common, here and below, as none have half of nothing; said of both sides, so that it stays behind the join
    enough = common >= F.greatest(VERSION_SHARE * F.least(F.size("own"), F.size("other")), F.lit(1.0))
    alike = kept(both.filter(enough).select("document_id", "first_document", "other"), f"{folder}/alike")
    close = kept(missed.join(alike.drop("other"), ["document_id", "first_document"]), f"{folder}/close")
    passage = close.join(chunks.select(F.col("chunk_id").alias("passage_id"), "text"), "passage_id")
    held = passage.join(alike, ["document_id", "first_document"]).select("query_id", runs.alias("own"), "other")
    return held.filter(common >= F.greatest(VERSION_SHARE * F.size("own"), F.lit(1.0))).select("query_id")


def suggestion(facts: DataFrame, *by: str) -> DataFrame:
    """The one fix to make first, in each group, and the files or questions it concerns; no row where nothing is amiss.
    facts: a row a group with costly_copies, versions (questions lost), scanned, unreadable, copies (files); nulls are 0."""
    order = ("costly_copies", "versions", "scanned", "unreadable", "copies")
    first = F.coalesce(*[F.when(F.col(k) > 0, F.struct(F.lit(k).alias("fix"), F.col(k).cast("long").alias("files"))) for k in order])
    return facts.select(*by, first.alias("x")).filter("x is not null").select(*by, "x.fix", "x.files")


def summary(graded: DataFrame, copies: DataFrame, versions: DataFrame, most: int = 5) -> DataFrame:
    """query_id, place, reason of at most `most` missed questions, those with a known reason first."""
    missed = graded.filter("rank is null or rank > 1")
    flagged = missed.join(copies.withColumn("c", F.lit(True)), "query_id", "left").join(versions.withColumn("v", F.lit(True)), "query_id", "left")
    reason = F.when(F.col("c"), "another copy came first").when(F.col("v"), "another version came first").when(F.col("rank").isNull(), "not found").otherwise("ranked lower")
    known = F.when(F.col("c"), 0).when(F.col("v"), 1).otherwise(2)
    placed = flagged.select("query_id", reason.alias("reason"), known.alias("known"))
    best = placed.orderBy("known", "query_id").limit(most)
    return best.select("query_id", F.row_number().over(Window.orderBy("known", "query_id")).alias("place"), "reason")
