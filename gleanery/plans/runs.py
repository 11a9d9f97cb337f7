"""Queries I20 and I24 to I28: rules and tables over finished runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, runs
from .shared import query, table


def setups(spark, sf_dir):
    """Priorities as question writers, order statuses and months as setups, mean prices as scores."""
    o = table(spark, sf_dir, "orders")
    rows = o.groupBy(F.col("o_orderpriority").alias("writer"), F.month("o_orderdate").cast("string").alias("setup")).agg(F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")) / 500000).alias("score"), F.avg(F.col("o_totalprice") / 500000).alias("truth"))
    return rows.withColumn("score", F.round("score", 6)).withColumn("truth", F.round("truth", 6))


SETUPS = "setups AS (SELECT o_orderpriority AS writer, CAST(month(o_orderdate) AS VARCHAR) AS setup, round(avg(o_totalprice / 500000) FILTER (WHERE o_orderkey % 2 = 0), 6) AS score, round(avg(o_totalprice / 500000), 6) AS truth FROM orders GROUP BY ALL)"


@query(f"""WITH {SETUPS}, r AS (SELECT writer, rank() OVER (PARTITION BY writer ORDER BY score) + (count(*) OVER (PARTITION BY writer, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY writer ORDER BY truth) + (count(*) OVER (PARTITION BY writer, truth) - 1) / 2.0 AS y FROM setups),
rho AS (SELECT writer, round(coalesce(corr(x, y), 0), 4) AS rho FROM r GROUP BY 1), b AS (SELECT writer, arg_max(truth, round(score, 9)) AS picked, max(truth) AS best, avg(score - truth) AS bias FROM setups GROUP BY 1)
SELECT writer, rho, rho >= 0.5 AS agrees, best - picked <= 0.1 AS orders, abs(bias) <= 0.1 AS close, rho >= 0.5 AND best - picked <= 0.1 AND abs(bias) <= 0.1 AS passes FROM b JOIN rho USING (writer)""")
def i20_writer_verdict(spark, sf_dir):
    rows = setups(spark, sf_dir)
    return runs.writer_verdict(rows, evaluate.spearman(rows, "writer", "score", "truth"))


@query("WITH a AS (SELECT avg(value) / 1000 AS own FROM events), b AS (SELECT avg(value) / 1000 AS shared FROM events WHERE event_id % 10 = 0) SELECT round(own - shared, 3) AS gap, round(own - shared, 4) <= 0.02 AS accepted FROM a, b")
def i24_tenancy_rule(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    own = e.agg(F.lit(None).cast("int").alias("factor"), (F.avg("value") / 1000).alias("recall"))
    arms = own.unionByName(e.filter("event_id % 10 = 0").agg(F.lit(10).alias("factor"), (F.avg("value") / 1000).alias("recall")))
    return runs.tenancy_rule(arms).select(F.round("gap", 3).alias("gap"), "accepted")


SCORES = "scores AS (SELECT event_type AS mode, 's' || user_id % 4 AS set, avg(value) AS value FROM events GROUP BY ALL), base AS (SELECT event_type AS mode, 's' || user_id % 4 AS set, 'odd' AS baseline, avg(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY ALL)"


@query(f"WITH {SCORES} SELECT s.set, s.mode, baseline FROM scores s JOIN base b USING (mode, set) WHERE s.value < b.value")
def i25_baseline_losses(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("set"), "event_id", "value")
    odd = e.filter("event_id % 2 = 1").groupBy("mode", "set").agg(F.avg("value").alias("value")).withColumn("baseline", F.lit("odd"))
    return runs.baseline_losses(e.groupBy("mode", "set").agg(F.avg("value").alias("value")), odd).select("set", "mode", "baseline")


@query("SELECT o_orderpriority AS mode, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS \"F\", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS \"O\" FROM orders GROUP BY 1")
def i26_comparison_table(spark, sf_dir):
    long = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
    return runs.comparison_table(long, ["F", "O"]).select("mode", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@query("""SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN 1.0 WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS hit_at_1, CASE WHEN item_id % 3 = 0 THEN 1.0 WHEN item_id % 2 = 0 THEN 0.5 ELSE 0.0 END AS recall_first,
 CASE WHEN item_id % 3 = 0 THEN 1.0 WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.5 END AS recall_all, 1 AS below_floor, CASE WHEN contains(lower(text), 'that') THEN 1.0 ELSE 0.0 END AS named FROM benchmark""")
def i27_agent_retrieval_grade(spark, sf_dir):
    s = lambda hits, low: F.struct(hits.alias("hits"), F.lit(low).alias("below_floor"))
    first = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("a"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    relevant = F.when(F.col("item_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), relevant.alias("relevant"), F.array(F.lit("THAT")).alias("titles"), F.col("text").alias("answer"), F.array(s(first, False), s(F.array(F.lit("b"), F.lit("x")), True)).alias("searches"))
    return runs.agent_grade(rows)


@query("WITH g AS (SELECT event_id AS id, event_type AS kind, event_id % 9 <> 0 AS answerable FROM events) SELECT id FROM g WHERE NOT answerable OR kind IN ('click', 'purchase') UNION ALL SELECT id FROM (SELECT id FROM g WHERE answerable AND kind NOT IN ('click', 'purchase') ORDER BY md5('4:' || id), id LIMIT 30)")
def i28_select_questions(spark, sf_dir):
    golden = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("event_id") % 9 != 0).alias("answerable"))
    return runs.select_questions(golden, ["click", "purchase"], 30, 4).select("id")
