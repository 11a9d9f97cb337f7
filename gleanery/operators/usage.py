"""Row security, source labels, transcripts and accounting of query logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import SHARED, estimate_cost, owner_of, visible_to
from ..functions.text import clip_turn
from ..sources.scratch import scratch

LAST_TURNS, MOST_CHARS, LAST_LABELS = 12, 24_000, 60


def refused_writes(wanted: DataFrame, owner: str) -> DataFrame:
    """Ids that an owner may not write or delete: all outside its own namespace."""
    return wanted.filter((owner_of(F.col("document_id")) != owner) | (F.lit(owner) == SHARED))


def trim_nested(answers: DataFrame, owner: Column) -> DataFrame:
    """Entries of the nested `hits` (array of struct with document_id) and `pages` (map by document_id) that the owner may
    not see go; `total` follows where it counted them."""
    kept = F.filter("hits", lambda h: visible_to(owner, h["document_id"]))
    total = F.when(F.col("total") == F.size("hits"), F.size(kept)).otherwise(F.col("total"))
    return answers.withColumn("total", total).withColumn("hits", kept).withColumn("pages", F.map_filter("pages", lambda k, v: visible_to(owner, k)))


def number_sources(seen: DataFrame) -> DataFrame:
    """conversation, n, origin, key, text, location, score: sources numbered by first appearance (seq). A repeat keeps the
    number; the longest text stays, and the first location and score that are known."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    longest = F.max_by("text", F.struct(F.length("text"), -F.col("seq")))
    per = seen.groupBy("conversation", "origin", "key").agg(F.min("seq").alias("seq"), longest.alias("text"), first("location").alias("location"), first("score").alias("score"))
    n = F.row_number().over(Window.partitionBy("conversation").orderBy("seq", "origin", "key"))
    return per.withColumn("n", n).drop("seq")


def restore_labels(prior: DataFrame, seen: DataFrame) -> DataFrame:
    """conversation, n, origin, key: the last well-formed prior labels keep their numbers; new sources follow the largest."""
    good = prior.filter("n is not null and n > 0 and key is not null and origin is not null")
    kept = good.withColumn("r", F.row_number().over(Window.partitionBy("conversation").orderBy(F.desc("n")))).filter(F.col("r") <= LAST_LABELS).select("conversation", "n", "origin", "key")
    new = number_sources(seen.join(kept, ["conversation", "origin", "key"], "left_anti"))
    top = kept.groupBy("conversation").agg(F.max("n").alias("top"))
    shifted = new.join(top, "conversation", "left").select("conversation", (F.col("n") + F.coalesce("top", F.lit(0))).alias("n"), "origin", "key")
    return kept.unionByName(shifted)


def replay(turns: DataFrame) -> DataFrame:
    """conv_id, place, role, text: alternating questions and answers that end on an answer. Blank and unknown turns go; a
    question without answer gives way to the next; the last turns stay, and the oldest pairs go until the rest is short
    enough. A pair is a question whose next turn is an answer, so windows over a conversation find all of them."""
    bare = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    clean = turns.filter(F.col("role").isin("user", "assistant") & (F.length(bare) > 0)).select("conv_id", "turn", "role", clip_turn(bare).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", F.desc("role"), "text")
    asked, answered = F.col("role") == "user", F.lead("role").over(w) == "assistant"
    pairs = clean.withColumn("answer", F.when(asked & answered, F.lead("text").over(w))).filter("answer is not null")
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", F.desc("text"))
    size = F.sum(F.length("text") + F.length("answer")).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = pairs.withColumn("size", size).withColumn("r", F.row_number().over(back)).filter((F.col("r") <= LAST_TURNS // 2) & (F.col("size") <= MOST_CHARS))
    kept = kept.withColumn("first", 2 * (F.max("r").over(Window.partitionBy("conv_id")) - F.col("r")))
    both = F.array(*[F.struct((F.col("first") + i).alias("place"), F.lit(role).alias("role"), F.col(c).alias("text")) for i, role, c in ((0, "user", "text"), (1, "assistant", "answer"))])
    return kept.select("conv_id", F.explode(both).alias("x")).select("conv_id", "x.*")


def daily_spend(log: DataFrame) -> DataFrame:
    """day, owner, spent: positive costs by UTC day; owner null is the day's total."""
    good = log.filter("cost > 0").withColumn("day", F.col("ts").cast("date"))
    return good.groupingSets([["day"], ["day", "owner"]], "day", "owner").agg(F.sum("cost").alias("spent"))


def budget_admission(log: DataFrame, cap: float) -> DataFrame:
    """The log with `admitted`: whether what was spent before a query on its day is below the cap. Sums are of decimals, so
    that the order of additions can't tip them.

    Two levels, so that a day of any size is the work of all tasks: the log is dealt out by ranges of time and id; within
    a range, sums run over its own rows of a day; and the totals of a day's earlier ranges, one row each, come on top."""
    scratched = f"{scratch(log.sparkSession, 'admission')}/ranges"
    spent = F.greatest(F.coalesce("cost", F.lit(0.0)), F.lit(0.0)).cast("decimal(18,6)")
    dealt = log.withColumn("__spent", spent).withColumn("__day", F.col("ts").cast("date")).repartitionByRange("ts", "id")
    dealt.withColumn("__part", F.spark_partition_id()).write.parquet(scratched)  # a range keeps its number from here on
    dealt = log.sparkSession.read.parquet(scratched)
    earlier = Window.partitionBy("__day").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__day", "__part").agg(F.sum("__spent").alias("__total"))
    totals = totals.select("__day", "__part", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__day", "__part").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    running = dealt.withColumn("__own", F.coalesce(F.sum("__spent").over(own), F.lit(0)))
    before = F.col("__before") + F.col("__own")
    return running.join(totals, ["__day", "__part"]).select(*log.columns, (before < F.lit(cap).cast("decimal(18,6)")).alias("admitted"))


def owner_share(log: DataFrame, cap: float, share: float) -> DataFrame:
    """id, admitted under two ceilings, the day's and the owner's share of it; refused queries cost nothing, so each
    depends on those before it. Days are sorted within partitions and read batch by batch: what is held is a day's sum
    for each owner."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        today, total, own = None, 0.0, {}
        for pdf in batches:
            out = []
            for day, owner, cost in pdf[["day", "owner", "cost"]].itertuples(index=False):
                if day != today:
                    today, total, own = day, 0.0, {}
                ok = total < cap and own.get(owner, 0.0) < share * cap
                out.append(ok)
                if ok and cost > 0:
                    total, own[owner] = total + cost, own.get(owner, 0.0) + cost
            yield pd.DataFrame({"id": pdf.id, "admitted": out})

    days = log.select("id", "ts", "owner", "cost", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return days.repartition("day").sortWithinPartitions("day", "ts", "id").mapInPandas(fold, "id long, admitted boolean")


def rate_limit(log: DataFrame, most: int = 20, window: float = 60.0) -> DataFrame:
    """id, admitted, retry_after: at most `most` admitted requests of a client within `window` seconds; refused ones don't
    count. Whether one is admitted depends on those admitted before. Clients are sorted within partitions and read batch
    by batch: what is held is the times of the last `most` admitted requests."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, deque()
        for pdf in batches:
            out = []
            for i, client, at in pdf[["id", "client", "at"]].itertuples(index=False):
                if client != last:
                    last, held = client, deque()
                while held and at - held[0] >= window:
                    held.popleft()
                ok = most <= 0 or len(held) < most
                out.append((i, ok, None if ok else max(1, int(window - (at - held[0])))))
                if ok and most > 0:
                    held.append(at)
            yield pd.DataFrame(out, columns=["id", "admitted", "retry_after"]).astype({"retry_after": "Int32"})

    rows = log.select("id", "client", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).select("id", "client", (F.col("us") / 1e6).alias("at"))
    return rows.repartition("client").sortWithinPartitions("client", "at", "id").mapInPandas(fold, "id long, admitted boolean, retry_after int")


def parse_log_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of JSON lines in the column value."""
    schema = "ts string, level string, logger string, request_id string, message string, turns int, tokens long, cost double, _corrupt string"
    parsed = lines.select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    broken = F.col("x").isNull() | F.col("x._corrupt").isNotNull()
    return parsed.filter(~broken).select("x.*").drop("_corrupt"), parsed.filter(broken).select("value")


def usage_rollup(reports: DataFrame) -> DataFrame:
    """day, owner, model, queries, cost. Token counters grow within a turn, so a turn's last report counts; thinking tokens
    are output. Subtotals by day and overall have nulls."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    turn = reports.groupBy("query_id", "turn").agg(F.min("ts").alias("ts"), F.min("owner").alias("owner"), *[last(c) for c in ("tokens_in", "tokens_out", "thinking", "cached", "grounded")])
    per = turn.groupBy("query_id").agg(F.min("ts").alias("ts"), F.min("owner").alias("owner"), *[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "thinking", "cached", "grounded")])
    cost = estimate_cost(F.col("tokens_in"), F.col("tokens_out") + F.col("thinking"), F.col("grounded"), F.col("cached"))
    priced = per.select(F.col("ts").cast("date").alias("day"), "owner", cost.alias("cost"))
    return priced.rollup("day", "owner").agg(F.count("*").alias("queries"), F.sum("cost").alias("cost"))


def pair_tool_events(events: DataFrame) -> DataFrame:
    """request, name, seq, call_id: each result with the latest call of its name before it in the request that has no
    result yet, or null. Calls open and results close, like brackets: a result's call is the last one on its level."""
    w = Window.partitionBy("request", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_call = F.col("kind") == "call"
    level = events.filter(F.col("kind").isin("call", "result")).withColumn("sum", F.sum(F.when(is_call, 1).otherwise(-1)).over(w))
    level = level.withColumn("least", F.least(F.lit(0), F.min("sum").over(w)))
    level = level.withColumn("before", F.lag("least", 1, 0).over(Window.partitionBy("request", "name").orderBy("seq")))
    # a result that takes the sum to a new minimum has no open call
    level = level.withColumn("alone", ~is_call & (F.col("least") < F.col("before"))).withColumn("depth", F.col("sum") - F.col("least") + F.when(is_call, 0).otherwise(1))
    own = Window.partitionBy("request", "name", "depth").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    call = F.when(~F.col("alone"), F.last(F.when(is_call, F.col("seq")), ignorenulls=True).over(own))
    return level.withColumn("call_id", call).filter(~is_call).select("request", "name", "seq", "call_id")


def tools_used(events: DataFrame) -> DataFrame:
    """request, tools (distinct names, sorted) and sources (of the last result that has any) of each request."""
    with_sources = F.when((F.col("kind") == "result") & F.col("sources").isNotNull(), F.col("seq"))
    return events.groupBy("request").agg(F.array_sort(F.collect_set("name")).alias("tools"), F.max_by("sources", with_sources).alias("sources"))


def tool_outcome(name: Column, is_error: Column, hits: Column, scored_by: Column, top: Column, below_floor: Column) -> Column:
    text = F.concat(F.lit("ok: "), hits.cast("string"), F.lit(" hits by "), scored_by, F.lit(", top "), F.round(top, 4).cast("string"), F.when(below_floor, " (below floor)").otherwise(""))
    return F.concat(name, F.lit(" "), F.when(is_error, "error").when(F.coalesce(hits, F.lit(0)) == 0, "empty").otherwise(text))
