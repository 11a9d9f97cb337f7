"""Rules and tables over finished evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selftest import draw


def writer_verdict(rows: DataFrame, rho: DataFrame, least_rho: float = 0.5, most_gap: float = 0.1) -> DataFrame:
    """writer, rho, agrees, orders, close, passes: a question writer's scores follow the true ones in rank, its best setup
    is near the true best, and its mean is near the true mean. rows: writer, setup, score, truth."""
    best = rows.groupBy("writer").agg(F.max_by("truth", F.struct(F.round("score", 9), "setup")).alias("picked"), F.max("truth").alias("best"), F.avg(F.col("score") - F.col("truth")).alias("bias"))
    out = best.join(rho, "writer").withColumn("agrees", F.col("rho") >= least_rho).withColumn("orders", F.col("best") - F.col("picked") <= most_gap).withColumn("close", F.abs("bias") <= most_gap)
    return out.select("writer", "rho", "agrees", "orders", "close", (F.col("agrees") & F.col("orders") & F.col("close")).alias("passes"))


def tenancy_rule(arms: DataFrame, factor: int = 10, most_gap: float = 0.02) -> DataFrame:
    """One row: gap between a store of one's own and a shared one filtered after ranking, and whether it is accepted.
    arms: factor (null for one's own store), recall."""
    out = arms.agg(F.max(F.when(F.col("factor").isNull(), F.col("recall"))).alias("own"), F.max(F.when(F.col("factor") == factor, F.col("recall"))).alias("shared"))
    return out.select(F.round(F.col("own") - F.col("shared"), 4).alias("gap")).withColumn("accepted", F.col("gap") <= most_gap)


def baseline_losses(ours: DataFrame, published: DataFrame) -> DataFrame:
    """set, mode, baseline, ours, theirs where a stage scores lower than a baseline it is paired with. published: set, mode
    (the stage that the baseline belongs beside), baseline, value."""
    both = ours.select("set", "mode", F.col("value").alias("ours")).join(published.select("set", "mode", "baseline", F.col("value").alias("theirs")), ["set", "mode"])
    return both.filter("ours < theirs")


def comparison_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row a mode, a column a metric, of a long table."""
    return metrics.groupBy("mode").pivot("metric", names).agg(F.first("value"))


def agent_grade(runs: DataFrame) -> DataFrame:
    """id, hit_at_1, recall_first, recall_all, below_floor, named. runs: id, relevant (array), titles (array), answer,
    searches (array of struct<hits: array<string>, below_floor: boolean>)."""
    first = F.coalesce(F.get("searches", F.lit(0))["hits"], F.array().cast("array<string>"))
    every = F.array_distinct(F.flatten(F.transform("searches", lambda s: s["hits"])))
    n = F.size("relevant")
    share = lambda found: F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(found, F.col("relevant"))) / n)
    named = F.when(F.size("titles") == 0, 1.0).otherwise(F.size(F.filter("titles", lambda t: F.contains(F.lower("answer"), F.lower(t)))) / F.size("titles"))
    return runs.select(
        "id", F.when(n == 0, 1.0).otherwise(F.coalesce(F.array_contains("relevant", F.get(first, F.lit(0))), F.lit(False)).cast("double")).alias("hit_at_1"), share(first).alias("recall_first"),
        share(every).alias("recall_all"), F.size(F.filter("searches", lambda s: s["below_floor"])).alias("below_floor"), named.alias("named"),
    )


def select_questions(golden: DataFrame, kinds: list[str], sample: int, seed: int) -> DataFrame:
    """All answerable questions of the kinds, a drawn sample of the other answerable ones, and all unanswerable ones."""
    yes = golden.filter("answerable")
    rest = yes.filter(~F.col("kind").isin(kinds)).orderBy(draw(seed, "id"), "id").limit(sample)
    return yes.filter(F.col("kind").isin(kinds)).unionByName(rest).unionByName(golden.filter("not answerable"))


def _mean(value: Column, among: Column, digits: int = 4) -> Column:
    """The mean of a part of the rows; null if the part is empty."""
    return F.round(F.avg(F.when(among, value.cast("double"))), digits)


def run_summary(records: DataFrame) -> DataFrame:
    """kind, set (null: all), and what a run of an agent came to: over all records, by kind and by set.

    records: kind, set, answerable (null: true), grade (hit_at_1, recall_first, recall_union, named, searches), turns,
    truncated, usage (cost_usd), judge (faithfulness, relevance, declined; null where a record wasn't judged), citations
    (valid, dangling). Retrieval is over answerable records, 0 without any; what the judge says is over judged ones, and
    declining is kept apart for answerable and unanswerable records, null where there are none."""
    yes = F.coalesce("answerable", F.lit(True))
    judged = F.col("judge").isNotNull()

    def retrieval(c: str) -> Column:
        return F.coalesce(_mean(F.coalesce(F.col(f"grade.{c}"), F.lit(0.0)), yes), F.lit(0.0))

    return records.groupingSets([[], ["kind"], ["set"]], "kind", "set").agg(
        F.count("*").alias("questions"), *[retrieval(c).alias(c) for c in ("hit_at_1", "recall_first", "recall_union", "named")],
        F.round(F.avg("grade.searches"), 2).alias("searches_per_question"), F.count(F.when(F.col("grade.searches") > 1, 1)).alias("searched_twice"), F.round(F.avg("turns"), 2).alias("turns_per_question"),
        F.count(F.when(F.col("truncated"), 1)).alias("truncated"), F.round(F.sum(F.coalesce("usage.cost_usd", F.lit(0.0))), 4).alias("cost_usd"),
        _mean(F.col("judge.faithfulness"), judged & yes).alias("faithfulness"), _mean(F.col("judge.relevance"), judged & yes).alias("relevance"),
        _mean(F.col("judge.declined").cast("int"), judged & yes).alias("false_abstention"), _mean(F.col("judge.declined").cast("int"), judged & ~yes).alias("correct_abstention"),
        _mean(F.col("citations.valid").cast("int"), judged).alias("citations_valid"),
    )


def judge_summary(records: DataFrame) -> DataFrame:
    """One row on judged answers: graded, faithfulness and relevance (over answerable ones), false_abstention, correct_abstention,
    citations_valid, dangling_citations, truncated, cost_usd. A mean of no records is null, a sum 0. records: answerable, judge,
    citations, truncated, usage, as in run_summary."""
    yes, every = F.col("answerable"), F.lit(True)
    return records.agg(
        F.count("*").alias("graded"), _mean(F.col("judge.faithfulness"), yes).alias("faithfulness"), _mean(F.col("judge.relevance"), yes).alias("relevance"),
        _mean(F.col("judge.declined").cast("int"), yes).alias("false_abstention"), _mean(F.col("judge.declined").cast("int"), ~yes).alias("correct_abstention"), _mean(F.col("citations.valid").cast("int"), every).alias("citations_valid"),
        F.coalesce(F.sum(F.size("citations.dangling")), F.lit(0)).alias("dangling_citations"), F.count(F.when(F.col("truncated"), 1)).alias("truncated"), F.round(F.coalesce(F.sum("usage.cost_usd"), F.lit(0.0)), 4).alias("cost_usd"),
    )
