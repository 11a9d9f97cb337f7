"""Retrieval metrics, gates and rules over tables of hits and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_ranks(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, unit, rank (of its first hit), is_rel."""
    first = hits.groupBy("query_id", "unit").agg(F.min("rank").alias("rank"))
    return first.join(relevant.select("query_id", "unit").distinct().withColumn("is_rel", F.lit(True)), ["query_id", "unit"], "left").withColumn("is_rel", F.coalesce("is_rel", F.lit(False)))


def ideal(n: Column, k: int) -> Column:
    """The discounted gain of n relevant units at the top k ranks."""
    return F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))


def metrics(questions: DataFrame, hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """A row a question: hit_at_1, mrr, recall_at_k, ndcg_at_k. A unit counts once, at its first rank; a question without
    relevant units gets 1.0."""
    n_rel = relevant.select("query_id", "unit").distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))
    return _measured(questions, n_rel, unit_ranks(hits, relevant).filter("is_rel"), ks)


def label_metrics(questions: DataFrame, hits: DataFrame, asked: DataFrame, units: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """The same where the units of a question's label are relevant, but for the question itself. asked: query_id, label.
    units: unit, label. Labels are counted, and met by hits; the pairs, as many as questions times a label's units, are never
    made."""
    counts = units.filter("label is not null").groupBy("label").agg(F.count_distinct("unit").alias("n"))
    own = asked.join(units.select(F.col("unit").alias("query_id"), "label", F.lit(1).alias("self")).distinct(), ["query_id", "label"], "left")
    n_rel = own.join(counts, "label").select("query_id", (F.col("n") - F.coalesce("self", F.lit(0))).alias("n_rel")).filter("n_rel > 0")
    first = hits.filter("query_id <> unit").groupBy("query_id", "unit").agg(F.min("rank").alias("rank"))
    return _measured(questions, n_rel, first.join(asked, "query_id").join(units.distinct(), ["unit", "label"], "left_semi"), ks)


def _measured(questions: DataFrame, n_rel: DataFrame, ranks: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    cells = [F.min("rank").alias("first")]
    for k in ks:
        inside = F.col("rank") <= k
        cells += [F.count(F.when(inside, 1)).alias(f"in_{k}"), F.coalesce(F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias(f"gain_{k}")]
    found = questions.select("query_id").join(n_rel, "query_id", "left").join(ranks.groupBy("query_id").agg(*cells), "query_id", "left")
    none = F.col("n_rel").isNull()
    out = [F.when(none, 1.0).otherwise(F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0))).alias("hit_at_1"), F.when(none, 1.0).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr")]
    for k in ks:
        out.append(F.when(none, 1.0).otherwise(F.coalesce(F.col(f"in_{k}"), F.lit(0)) / F.col("n_rel")).alias(f"recall_at_{k}"))
        out.append(F.when(none, 1.0).otherwise(F.coalesce(F.col(f"gain_{k}"), F.lit(0.0)) / ideal(F.coalesce("n_rel", F.lit(1)), k)).alias(f"ndcg_at_{k}"))
    return found.select("query_id", *out)


def collapse_to_documents(hits: DataFrame) -> DataFrame:
    """query_id, document_id, rank: documents in the order in which they first appear."""
    first = hits.groupBy("query_id", "document_id").agg(F.min("rank").alias("first"))
    return first.select("query_id", "document_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "document_id")).alias("rank"))


def graded(questions: DataFrame, documents: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg, recall at k by graded judgements (query_id, document_id, grade); 0.0 where nothing is judged."""
    gain = documents.filter(F.col("rank") <= k).join(qrels.filter("grade > 0"), ["query_id", "document_id"])
    got = gain.groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count("*").alias("hit"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "document_id"))
    best = qrels.filter("grade > 0").withColumn("pos", pos)
    best = best.groupBy("query_id").agg(F.sum(F.when(F.col("pos") <= k, F.col("grade") / F.log2(F.col("pos") + 1.0))).alias("idcg"), F.count("*").alias("n"))
    out = questions.select("query_id").join(best, "query_id", "left").join(got, "query_id", "left")
    return out.select("query_id", F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.col("hit") / F.col("n"), F.lit(0.0)).alias("recall"))


def mean_metrics(rows: DataFrame, by: str, digits: int = 4) -> DataFrame:
    """The mean of every other column but query_id, in each group."""
    return rows.groupBy(by).agg(*[F.round(F.avg(c), digits).alias(c) for c in rows.columns if c not in (by, "query_id")])


def grade_modes(questions: DataFrame, hits: DataFrame, relevant: DataFrame, modes: list[str], shown: int = 5) -> tuple[DataFrame, DataFrame]:
    """(metrics, failures) of several modes in one pass. hits: mode, query_id, unit, rank. A row of metrics for each mode and
    answerable question (one with relevant units), also where a mode found nothing. failures: mode, query_id, recall_at_5
    below 1, expected (the relevant units, sorted) and got (the first `shown` different units)."""
    tag = F.struct("mode", "query_id").alias("query_id")
    every = F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode")
    wanted = relevant.select("query_id", "unit").distinct()
    asked = questions.join(wanted.select("query_id").distinct(), "query_id", "left_semi").select("query_id", every).select(tag)
    tagged = hits.filter(F.col("mode").isin(modes)).select(tag, "unit", "rank")
    rows = metrics(asked, tagged, wanted.select("query_id", "unit", every).select(tag, "unit")).withColumnRenamed("query_id", "tag")
    rows = rows.select("tag.mode", "tag.query_id", *[c for c in rows.columns if c != "tag"])
    expected = wanted.groupBy("query_id").agg(F.array_sort(F.collect_set("unit")).alias("expected"))  # judgements of one question
    first = hits.groupBy("mode", "query_id", "unit").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("mode", "query_id").orderBy("rank", "unit"))
    got = first.withColumn("place", place).filter(F.col("place") <= shown).groupBy("mode", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "unit"))), lambda x: x["unit"]).alias("got"))
    failed = rows.filter("recall_at_5 < 1").select("mode", "query_id", "recall_at_5").join(expected, "query_id").join(got, ["mode", "query_id"], "left")
    return rows, failed.select("mode", "query_id", "recall_at_5", "expected", F.coalesce("got", F.array().cast("array<string>")).alias("got"))


def long_metrics(means: DataFrame, by: str) -> DataFrame:
    """mode, metric, value."""
    names = [c for c in means.columns if c != by]
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])
    return means.select(F.col(by).alias("mode"), F.explode(cells).alias("x")).select("mode", "x.metric", "x.value")


def abstains(top_score: Column, threshold: Column) -> Column:
    return top_score.isNull() | (top_score < threshold)


def threshold_sweep(tops: DataFrame, thresholds: tuple[float, ...] = (0.01, 0.1, 0.3, 0.5, 0.9)) -> DataFrame:
    """threshold, answerable_lost, unanswerable_blocked from (query_id, answerable, top_score)."""
    cuts = tops.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    out = abstains(F.col("top_score"), F.col("threshold"))
    pairs = tops.crossJoin(F.broadcast(cuts))  # five rows
    return pairs.groupBy("threshold").agg(F.count(F.when(out & F.col("answerable"), 1)).alias("answerable_lost"), F.count(F.when(out & ~F.col("answerable"), 1)).alias("unanswerable_blocked"))


def separation(tops: DataFrame) -> DataFrame:
    """mode, answerable_min, answerable_mean, unanswerable_max, unanswerable_mean, gap."""
    yes, no = F.col("answerable"), ~F.col("answerable")
    s = F.coalesce("top_score", F.lit(0.0))
    cells = {"answerable_min": F.min(F.when(yes, s)), "answerable_mean": F.avg(F.when(yes, s)), "unanswerable_max": F.max(F.when(no, s)), "unanswerable_mean": F.avg(F.when(no, s))}
    out = tops.groupBy("mode").agg(*[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in cells.items()])
    return out.withColumn("gap", F.col("answerable_min") - F.col("unanswerable_max"))


def regression_gate(now: DataFrame, baseline: DataFrame, most_drop: float = 0.02) -> DataFrame:
    """mode, metric, now, base, verdict of two long metric tables: a drop beyond the margin, or a mode or metric that is
    gone, fails; new ones are reported."""
    joined = now.select("mode", "metric", F.col("value").alias("now")).join(baseline.select("mode", "metric", F.col("value").alias("base")), ["mode", "metric"], "full_outer")
    verdict = F.when(F.col("base").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("base") - F.col("now") > most_drop + 1e-9, "dropped").otherwise("ok")
    return joined.withColumn("verdict", verdict)


def reproduce_check(run: DataFrame, committed: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """mode, verdict: the first rule that a rerun breaks. Columns: mode, settings, questions, ndcg."""
    joined = committed.select("mode", F.col("settings").alias("s"), F.col("questions").alias("q"), F.col("ndcg").alias("n")).join(run, "mode", "left")
    verdict = (
        F.when(F.col("settings").isNull(), "missing").when(~F.col("settings").eqNullSafe(F.col("s")), "settings differ")
        .when(F.col("questions") != F.col("q"), "question counts differ").when(F.abs(F.col("ndcg") - F.col("n")) > tolerance + 1e-12, "ndcg differs").otherwise("reproduced")
    )
    return joined.select("mode", verdict.alias("verdict"))


def adoption_rule(control: DataFrame, run: DataFrame, must_gain: list[str], guarded: list[str], gain: float = 0.03, drop: float = 0.02) -> DataFrame:
    """One row: verdict and reasons. Columns: set, mode, value. Adopted if a named stage gains enough and no guarded stage
    drops too far on every set; rejected on a drop; undecided otherwise."""
    d = control.withColumnRenamed("value", "old").join(run.withColumnRenamed("value", "new"), ["set", "mode"]).withColumn("delta", F.round(F.col("new") - F.col("old"), 9))
    fell = F.col("mode").isin(guarded) & (F.col("delta") < -drop)
    rose = F.col("mode").isin(must_gain) & (F.col("delta") >= gain)
    reason = F.when(fell, F.concat_ws(" ", "set", "mode", F.lit("drops"))).when(rose, F.concat_ws(" ", "set", "mode", F.lit("gains")))
    per_set = d.groupBy("set").agg(F.coalesce(F.bool_or(rose), F.lit(False)).alias("rose"))
    all_rose = per_set.agg(F.coalesce(F.bool_and("rose"), F.lit(False)).alias("all_rose"))
    out = d.agg(F.coalesce(F.bool_or(fell), F.lit(False)).alias("fell"), F.array_join(F.array_sort(F.collect_list(reason)), "; ").alias("reasons"))
    return out.crossJoin(all_rose).select(F.when(F.col("fell"), "rejected").when(F.col("all_rose"), "adopted").otherwise("undecided").alias("verdict"), "reasons")


def speed_percentiles(ms: DataFrame, by: str) -> DataFrame:
    """median (interpolated), p95 (nearest rank) and max of a column ms in each group."""
    return ms.groupBy(by).agg(F.expr("percentile(ms, 0.5)").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95"), F.max("ms").alias("max"))


def speed_verdict(full_p95: Column, dense_p95: Column, first_answer: Column) -> Column:
    """The reasons for which a store is slow; none if it isn't."""
    rules = [(full_p95 > 2000, "full search"), (dense_p95 > 200, "dense search"), (first_answer > 30, "first answer")]
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules]))


def average_rank(value: Column, *by: str) -> Column:
    """Ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(w) - 1) / 2.0


def spearman(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, rho: rank correlation in each group, 0 where a side has no spread."""
    ranked = rows.withColumn("__x", average_rank(F.col(x), by)).withColumn("__y", average_rank(F.col(y), by))
    return ranked.groupBy(by).agg(F.round(F.coalesce(F.nanvl(F.try_divide(F.covar_pop("__x", "__y"), F.stddev_pop("__x") * F.stddev_pop("__y")), F.lit(0.0)), F.lit(0.0)), 4).alias("rho"))


def overfetch(ranked: DataFrame, owned: DataFrame, factors: tuple[int, ...] = (1, 2, 5, 10, 20), k: int = 10) -> DataFrame:
    """factor, query_id, document_id, rank: what a tenant sees if the first factor * k of one shared ranking are filtered
    to its documents, re-ranked and cut at k."""
    cuts = ranked.sparkSession.createDataFrame([(f,) for f in factors], "factor int")
    own = ranked.join(owned.select("document_id").distinct(), "document_id", "left_semi")
    near = own.join(F.broadcast(cuts), F.col("rank") <= F.col("factor") * k)
    w = Window.partitionBy("factor", "query_id").orderBy("rank")
    return near.withColumn("new", F.row_number().over(w)).filter(F.col("new") <= k).select("factor", "query_id", "document_id", F.col("new").alias("rank"))


def overfetch_study(shared: DataFrame, own: DataFrame, owned: DataFrame, questions: DataFrame, relevant: DataFrame, factors: tuple[int, ...] = (1, 2, 5, 10, 20), k: int = 10) -> DataFrame:
    """arm, factor, questions, hit_at_1, recall_at_5: one store filtered after ranking, at each factor, against one that was
    filtered before (`own`, a ranking of the tenant's documents alone; its factor is null). relevant: query_id, unit."""
    after = overfetch(shared, owned, factors, k).select(F.lit("after").alias("arm"), "factor", "query_id", F.col("document_id").alias("unit"), "rank")
    before = own.filter(F.col("rank") <= k).select(F.lit("before").alias("arm"), F.lit(None).cast("int").alias("factor"), "query_id", F.col("document_id").alias("unit"), "rank")
    name = F.concat_ws(":", "arm", F.col("factor").cast("string"))
    modes = ["before", *(f"after:{f}" for f in factors)]
    rows, _ = grade_modes(questions, after.unionByName(before).select(name.alias("mode"), "query_id", "unit", "rank"), relevant, modes)
    means = rows.groupBy("mode").agg(F.count("*").alias("questions"), F.round(F.avg("hit_at_1"), 4).alias("hit_at_1"), F.round(F.avg("recall_at_5"), 4).alias("recall_at_5"))
    arm = F.split("mode", ":")
    return means.select(arm[0].alias("arm"), F.get(arm, F.lit(1)).cast("int").alias("factor"), "questions", "hit_at_1", "recall_at_5")


def first_relevant_rank(ranked: DataFrame, relevant: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: median (the upper one), p90, max of the first relevant rank, and how many questions never see one. What is
    ordered are the different ranks with their counts, as many rows as a ranking is deep at most."""
    first = ranked.join(relevant, ["query_id", "document_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    asked = questions.select("query_id").join(first, "query_id", "left")
    counts = asked.filter("first is not null").groupBy("first").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("first"))
    total = counts.agg(F.sum("n").alias("total"))
    placed = counts.withColumn("upto", upto).crossJoin(F.broadcast(total))  # one row

    def at(share: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(F.col("total") * share), F.col("first")))

    never = asked.agg(F.count(F.when(F.col("first").isNull(), 1)).alias("never"))
    return placed.agg(at(0.5).alias("median"), at(0.9).alias("p90"), F.max("first").alias("max")).crossJoin(F.broadcast(never))  # one row each
