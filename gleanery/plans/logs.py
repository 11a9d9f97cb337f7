"""Queries C (ids, costs), I (agent runs) and J: security, labels, transcripts, accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import citations
from ..operators import runs, usage
from .shared import query, table

UPLOADS = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'upload:' || source || ':' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS document_id FROM documents"


def uploads(spark, sf_dir):
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("upload:"), "source", F.lit(":"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", own.alias("document_id"))


@query(r"""SELECT s_suppkey, coalesce(nullif(trim(substr(regexp_replace('.' || s_name || ' & co_', '[^A-Za-z0-9._-]+', '_', 'g'), 1, 64), '._-'), ''), 'shared') AS owner FROM supplier""")
def c9_safe_owner(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", ids.safe_owner(F.concat(F.lit("."), "s_name", F.lit(" & co_"))).alias("owner"))


@query(f"SELECT doc_id, CASE WHEN document_id LIKE 'upload:%' THEN split_part(document_id, ':', 2) ELSE 'shared' END AS owner FROM ({UPLOADS})")
def c10_owner_of_document(spark, sf_dir):
    return uploads(spark, sf_dir).select("doc_id", ids.owner_of(F.col("document_id")).alias("owner"))


ANSWERS = "SELECT conv_id, turn, text || ' [' || turn || '] and [' || (turn % 3) || '][2], [x]' AS answer, turn % 5 AS n_sources, turn FROM conversations WHERE role = 'assistant'"
CITED = r"list_distinct(list_transform(regexp_extract_all(answer, '\[([0-9]+)\]', 1), lambda x: CAST(x AS INT)))"


def answers(spark, sf_dir):
    said = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("] and ["), (F.col("turn") % 3).cast("string"), F.lit("][2], [x]"))
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", said.alias("answer"), (F.col("turn") % 5).cast("int").alias("n_sources"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort({CITED}), ',') AS cited FROM ({ANSWERS})")
def c11_citations(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", F.array_join(F.array_sort(citations(F.col("answer"))).cast("array<string>"), ",").alias("cited"))


@query(f"SELECT conv_id, turn, len(list_filter({CITED}, lambda c: c < 1 OR c > n_sources)) AS dangling, len(list_filter({CITED}, lambda c: c >= 1 AND c <= n_sources)) AS valid, n_sources - len(list_filter({CITED}, lambda c: c >= 1 AND c <= n_sources)) AS uncited FROM ({ANSWERS})")
def i30_citation_validity(spark, sf_dir):
    available = F.when(F.col("n_sources") > 0, F.sequence(F.lit(1), F.col("n_sources"))).otherwise(F.array().cast("array<int>"))
    a = answers(spark, sf_dir).withColumn("cited", citations(F.col("answer"))).withColumn("available", available)
    n = lambda c: F.size(c).cast("long")
    return a.select("conv_id", "turn", n(F.array_except("cited", "available")).alias("dangling"), n(F.array_intersect("cited", "available")).alias("valid"), n(F.array_except("available", "cited")).alias("uncited"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || ' p.' || page_id WHEN page_id % 3 = 1 THEN url || ' § part' ELSE url END AS place FROM pages")
def c12_describe_location(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    page, section = F.when(F.col("page_id") % 3 == 0, F.col("page_id")), F.when(F.col("page_id") % 3 == 1, "part").otherwise("")
    return p.select("page_id", ids.describe_location(F.col("url"), page, section).alias("place"))


@query("SELECT event_id, round(((i - h) * 0.25 + h * 0.025 + o * 1.5) / 1e6 + g * 0.014, 6) AS usd FROM (SELECT event_id, i, o, g, greatest(0, least(k, i)) AS h FROM (SELECT event_id, event_id * 40 AS i, user_id * 20 AS o, event_id % 3 AS g, user_id * 400 AS k FROM events))")
def c15_estimate_cost(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    usd = ids.estimate_cost(F.col("event_id") * 40, F.col("user_id") * 20, F.col("event_id") % 3, F.col("user_id") * 400)
    return e.select("event_id", usd.alias("usd"))


@query("SELECT event_id, event_type || ' ' || CASE WHEN event_id % 9 = 0 THEN 'error' WHEN event_id % 4 = 0 THEN 'empty' ELSE 'ok: ' || (event_id % 4) || ' hits by bm25, top 0.5' || CASE WHEN event_id % 2 = 0 THEN ' (below floor)' ELSE '' END END AS outcome FROM events")
def c17_tool_outcome(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = usage.tool_outcome(F.col("event_type"), F.col("event_id") % 9 == 0, F.col("event_id") % 4, F.lit("bm25"), F.lit(0.5), F.col("event_id") % 2 == 0)
    return e.select("event_id", out.alias("outcome"))


@query(f"SELECT s, count(*) AS n FROM ({UPLOADS}), (SELECT unnest(['src0', 'src1', 'nobody']) AS s) WHERE document_id NOT LIKE 'upload:%' OR document_id LIKE 'upload:' || s || ':%' GROUP BY s")
def j1_visible_to(spark, sf_dir):
    owners = spark.createDataFrame([("src0",), ("src1",), ("nobody",)], "s string")
    seen = uploads(spark, sf_dir).crossJoin(F.broadcast(owners)).filter(ids.visible_to(F.col("s"), F.col("document_id")))
    return seen.groupBy("s").agg(F.count("*").alias("n"))


@query(f"SELECT document_id FROM ({UPLOADS}) WHERE document_id NOT LIKE 'upload:src0:%'")
def j2_writable_by(spark, sf_dir):
    return usage.refused_writes(uploads(spark, sf_dir), "src0").select("document_id")


@query(f"SELECT g, CASE WHEN g % 2 = 0 THEN count(*) FILTER (WHERE v) ELSE 99 END AS total, count(*) FILTER (WHERE v) AS hits, count(*) FILTER (WHERE v) AS pages FROM (SELECT doc_id // 10 AS g, document_id NOT LIKE 'upload:%' OR document_id LIKE 'upload:src0:%' AS v FROM ({UPLOADS})) GROUP BY g")
def j3_trim_nested(spark, sf_dir):
    per = uploads(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 10).alias("g")).agg(F.collect_list(F.struct("document_id")).alias("hits"), F.map_from_entries(F.collect_list(F.struct("document_id", F.lit(1)))).alias("pages"))
    trimmed = usage.trim_nested(per.withColumn("total", F.when(F.col("g") % 2 == 0, F.size("hits")).otherwise(99)), F.lit("src0"))
    return trimmed.select("g", F.col("total").cast("long").alias("total"), F.size("hits").cast("long").alias("hits"), F.size("pages").cast("long").alias("pages"))


SEEN = "seen AS (SELECT conv_id AS conversation, turn AS seq, CASE WHEN turn % 2 = 0 THEN 'kb' ELSE 'web' END AS origin, role || length(text) % 3 AS key, text, CASE WHEN turn % 3 = 0 THEN 'p' || turn END AS location, CASE WHEN turn % 2 = 1 THEN turn / 10 END AS score FROM conversations)"


def seen(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation"), F.col("turn").alias("seq"), F.when(F.col("turn") % 2 == 0, "kb").otherwise("web").alias("origin"), F.concat("role", (F.length("text") % 3).cast("string")).alias("key"), "text",
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("p"), F.col("turn").cast("string"))).alias("location"), F.when(F.col("turn") % 2 == 1, F.col("turn") / 10).alias("score"),
    )


NUMBERED = f"{SEEN}, per AS (SELECT conversation, origin, key, min(seq) AS seq, arg_max(text, length(text) * 1000 - seq) AS text, arg_min(location, seq) FILTER (WHERE location IS NOT NULL) AS location, arg_min(score, seq) FILTER (WHERE score IS NOT NULL) AS score FROM seen GROUP BY ALL), numbered AS (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY seq, origin, key) AS n FROM per)"


@query(f"WITH {NUMBERED} SELECT conversation, n, origin, key, text, location, score FROM numbered")
def j4_source_numbering(spark, sf_dir):
    return usage.number_sources(seen(spark, sf_dir)).select("conversation", "n", "origin", "key", "text", "location", "score")


@query(f"""WITH {SEEN}, prior AS (SELECT DISTINCT conversation, length(key) + 5 AS n, origin, key FROM seen WHERE origin = 'kb' AND key LIKE 'user%' AND conversation % 2 = 0 QUALIFY row_number() OVER (PARTITION BY conversation ORDER BY key) = 1),
fresh AS (SELECT conversation, origin, key, min(seq) AS seq FROM seen ANTI JOIN prior USING (conversation, origin, key) GROUP BY ALL) SELECT conversation, n, origin, key FROM prior UNION ALL SELECT conversation, row_number() OVER (PARTITION BY conversation ORDER BY seq, f.origin, f.key) + coalesce(p.n, 0), f.origin, f.key FROM fresh f LEFT JOIN prior p USING (conversation)""")
def j5_restore_labels(spark, sf_dir):
    from pyspark.sql import Window

    rows = seen(spark, sf_dir)
    prior = rows.filter("origin = 'kb' and key like 'user%' and conversation % 2 = 0").select("conversation", (F.length("key") + 5).alias("n"), "origin", "key").distinct()
    prior = prior.withColumn("r", F.row_number().over(Window.partitionBy("conversation").orderBy("key"))).filter("r = 1").drop("r")
    broken = prior.withColumn("n", F.lit(None).cast("int")).withColumn("key", F.lit("broken"))
    return usage.restore_labels(prior.unionByName(broken), rows)


REPLAYED = r"""bare AS (SELECT conv_id, turn, role, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM conversations WHERE role IN ('user', 'assistant')),
clean AS (SELECT conv_id, turn, role, CASE WHEN length(t) > 4000 THEN '… ' || right(t, 4000) ELSE t END AS t FROM bare WHERE t <> ''),
paired AS (SELECT conv_id, turn, role, t AS q, lead(role) OVER w AS next, lead(t) OVER w AS a FROM clean WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role DESC, t)),
last AS (SELECT *, row_number() OVER w AS r, sum(length(q) + length(a)) OVER (w ROWS UNBOUNDED PRECEDING) AS size FROM paired WHERE role = 'user' AND next = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC, q DESC)),
fit AS (SELECT *, 2 * (max(r) OVER (PARTITION BY conv_id) - r) AS first FROM last WHERE r <= 6 AND size <= 24000)"""


@query(f"WITH {REPLAYED} SELECT conv_id, CAST(first AS INTEGER) AS place, 'user' AS role, q AS text FROM fit UNION ALL SELECT conv_id, CAST(first + 1 AS INTEGER), 'assistant', a FROM fit")
def j6_replay_transcript(spark, sf_dir):
    return usage.replay(table(spark, sf_dir, "conversations"))


def log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").cast("string").alias("owner"), F.round("value", 4).alias("cost"))


LOG = "log AS (SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS owner, round(value, 4) AS cost FROM events)"


@query(f"WITH {LOG} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, owner, round(sum(cost), 3) AS spent FROM log WHERE cost > 0 GROUP BY GROUPING SETS ((CAST(ts AS DATE)), (CAST(ts AS DATE), owner))")
def j7_daily_spend(spark, sf_dir):
    return usage.daily_spend(log(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "owner", F.round("spent", 3).alias("spent"))


@query(f"WITH {LOG} SELECT id, coalesce(sum(CAST(greatest(cost, 0) AS DECIMAL(18, 6))) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5000 AS admitted FROM log")
def j8_budget_admission(spark, sf_dir):
    return usage.budget_admission(log(spark, sf_dir), 5000.0).select("id", "admitted")


#: The same decisions one by one: step i looks at each day's i-th query.
SHARED_OUT = f"""{LOG}, turns AS MATERIALIZED (SELECT id, owner, cost, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, id) AS i FROM log),
steps AS (SELECT day, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, false AS admitted, 0.0::DOUBLE AS total, MAP([]::VARCHAR[], []::DOUBLE[]) AS own FROM turns GROUP BY day
 UNION ALL SELECT day, i, id, ok, CASE WHEN ok AND cost > 0 THEN total + cost ELSE total END, CASE WHEN ok AND cost > 0 THEN map_concat(own, MAP([owner], [coalesce(own[owner], 0) + cost])) ELSE own END
 FROM (SELECT s.day, t.i, t.id, t.owner, t.cost, s.total, s.own, s.total < 5000 AND coalesce(s.own[t.owner], 0) < 0.1::DOUBLE * 5000 AS ok FROM steps s JOIN turns t ON t.day = s.day AND t.i = s.i + 1))"""


@query(f"WITH RECURSIVE {SHARED_OUT} SELECT id, admitted FROM steps WHERE id IS NOT NULL")
def j9_owner_share(spark, sf_dir):
    return usage.owner_share(log(spark, sf_dir), 5000.0, 0.1)


#: Times of admitted requests that a client still holds, request by request.
LIMITED = """turns AS MATERIALIZED (SELECT event_id AS id, user_id % 7 AS client, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS i FROM events),
steps AS (SELECT client, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, false AS admitted, CAST(NULL AS DOUBLE) AS wait, CAST([] AS DOUBLE[]) AS held FROM turns GROUP BY client
 UNION ALL SELECT client, i, id, len(left_over) < 20, CASE WHEN len(left_over) >= 20 THEN 3600 - (sec - left_over[1]) END, CASE WHEN len(left_over) < 20 THEN list_append(left_over, sec) ELSE left_over END
 FROM (SELECT s.client, t.i, t.id, t.sec, list_filter(s.held, lambda x: t.sec - x < 3600) AS left_over FROM steps s JOIN turns t ON t.client = s.client AND t.i = s.i + 1))"""


@query(f"WITH RECURSIVE {LIMITED} SELECT id, admitted, CASE WHEN NOT admitted THEN CAST(greatest(1, trunc(wait)) AS INTEGER) END AS retry_after FROM steps WHERE id IS NOT NULL")
def j10_rate_limit(spark, sf_dir):
    clients = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", (F.col("user_id") % 7).cast("string").alias("client"))
    return usage.rate_limit(clients, 20, 3600.0)


@query("SELECT event_id AS request_id, event_type AS message, user_id AS tokens, round(value, 4) AS cost FROM events WHERE event_id % 10 <> 0")
def j11_parse_log_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("ts").cast("string").alias("ts"), F.lit("INFO").alias("level"), F.col("event_id").cast("string").alias("request_id"), F.col("event_type").alias("message"), F.col("user_id").alias("tokens"), F.round("value", 4).alias("cost")))
    good, _ = usage.parse_log_lines(e.select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("value")))
    return good.select(F.col("request_id").cast("long").alias("request_id"), "message", "tokens", "cost")


REPORTS = "reports AS (SELECT event_id // 6 AS query_id, (event_id // 3) % 2 AS turn, event_id % 3 AS seq, ts, CAST(user_id % 5 AS VARCHAR) AS owner, (event_id % 3 + 1) * 1000 AS tokens_in, user_id AS tokens_out, 7 AS thinking, event_id % 1500 AS cached, event_id % 2 AS grounded FROM events)"


@query(f"""WITH {REPORTS}, t AS (SELECT query_id, turn, min(ts) AS ts, min(owner) AS owner, arg_max(tokens_in, seq) AS i, arg_max(tokens_out, seq) AS o, arg_max(thinking, seq) AS k, arg_max(cached, seq) AS c, arg_max(grounded, seq) AS g FROM reports GROUP BY ALL),
q AS (SELECT query_id, min(ts) AS ts, min(owner) AS owner, sum(i) AS i, sum(o) + sum(k) AS o, sum(c) AS c, sum(g) AS g FROM t GROUP BY 1), p AS (SELECT CAST(ts AS DATE) AS day, owner, ((i - least(c, i)) * 0.25 + least(c, i) * 0.025 + o * 1.5) / 1e6 + g * 0.014 AS cost FROM q)
SELECT CAST(day AS VARCHAR) AS day, owner, count(*) AS queries, round(sum(cost), 3) AS cost FROM p GROUP BY ROLLUP (day, owner)""")
def j14_usage_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reports = e.select(F.floor(F.col("event_id") / 6).alias("query_id"), (F.floor(F.col("event_id") / 3) % 2).alias("turn"), (F.col("event_id") % 3).alias("seq"), "ts", (F.col("user_id") % 5).cast("string").alias("owner"), ((F.col("event_id") % 3 + 1) * 1000).alias("tokens_in"), F.col("user_id").alias("tokens_out"), F.lit(7).alias("thinking"), (F.col("event_id") % 1500).alias("cached"), (F.col("event_id") % 2).alias("grounded"))
    return usage.usage_rollup(reports).select(F.col("day").cast("string").alias("day"), "owner", "queries", F.round("cost", 3).alias("cost"))


TOOLS = "tools AS (SELECT event_id AS seq, user_id AS request, event_type AS name, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) % 2 = 1 THEN 'call' ELSE 'result' END AS kind FROM events)"


def tool_events(spark, sf_dir):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    e = table(spark, sf_dir, "events").withColumn("kind", F.when(nth % 2 == 1, "call").otherwise("result"))
    sources = F.when((F.col("kind") == "result") & (F.col("event_id") % 3 > 0), F.col("event_id").cast("string"))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("request"), F.col("event_type").alias("name"), "kind", sources.alias("sources"))


@query(f"WITH {TOOLS} SELECT r.request, r.name, r.seq, c.seq AS call_id FROM (SELECT * FROM tools WHERE kind = 'result') r ASOF LEFT JOIN (SELECT * FROM tools WHERE kind = 'call') c ON r.request = c.request AND r.name = c.name AND r.seq >= c.seq")
def j15_pair_tool_events(spark, sf_dir):
    return usage.pair_tool_events(tool_events(spark, sf_dir))


@query(f"""WITH {TOOLS} SELECT request, array_to_string(list_sort(list(DISTINCT name)), ',') AS tools, arg_max(CASE WHEN kind = 'result' AND seq % 3 > 0 THEN CAST(seq AS VARCHAR) END, CASE WHEN kind = 'result' AND seq % 3 > 0 THEN seq END) AS sources FROM tools GROUP BY request""")
def j15_tools_used(spark, sf_dir):
    return usage.tools_used(tool_events(spark, sf_dir)).select("request", F.array_join("tools", ",").alias("tools"), "sources")


RECORDS = """r AS (SELECT event_type AS kind, user_id % 3 AS set, event_id % 5 <> 0 AS answerable, (event_id % 3 = 0)::INT AS hit, event_id % 4 / 3 AS first, event_id % 5 / 4 AS whole, event_id % 2 AS named, event_id % 4 AS searches,
 event_id % 6 AS turns, event_id % 17 = 0 AS truncated, value AS cost, event_id % 8 <> 0 AS judged, event_id % 11 / 10 AS faithful, event_id % 10 / 9 AS fitting, event_id % 7 = 0 AS declined, event_id % 9 <> 0 AS valid, event_id % 3 AS dangling FROM events)"""


def records(spark, sf_dir):
    """Events as records of an agent's run; every eighth wasn't judged."""
    i = F.col("event_id")
    judge = F.struct((i % 11 / 10).alias("faithfulness"), (i % 10 / 9).alias("relevance"), (i % 7 == 0).alias("declined"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"), (F.col("user_id") % 3).alias("set"), (i % 5 != 0).alias("answerable"), (i % 6).alias("turns"), (i % 17 == 0).alias("truncated"), F.struct(F.col("value").alias("cost_usd")).alias("usage"),
        F.struct((i % 3 == 0).cast("double").alias("hit_at_1"), (i % 4 / 3).alias("recall_first"), (i % 5 / 4).alias("recall_union"), (i % 2).cast("double").alias("named"), (i % 4).alias("searches")).alias("grade"),
        F.when(i % 8 != 0, judge).alias("judge"), F.struct((i % 9 != 0).alias("valid"), F.array_repeat(F.lit(0), (i % 3).cast("int")).alias("dangling")).alias("citations"),
    )


@query(f"""WITH {RECORDS} SELECT kind, set, count(*) AS questions, round(avg(hit) FILTER (answerable), 4) AS hit_at_1, round(avg(first) FILTER (answerable), 4) AS recall_first, round(avg(whole) FILTER (answerable), 4) AS recall_union, round(avg(named) FILTER (answerable), 4) AS named,
 round(avg(searches), 2) AS searches_per_question, count(*) FILTER (searches > 1) AS searched_twice, round(avg(turns), 2) AS turns_per_question, count(*) FILTER (truncated) AS truncated, round(sum(cost), 2) AS cost_usd,
 round(avg(faithful) FILTER (judged AND answerable), 4) AS faithfulness, round(avg(fitting) FILTER (judged AND answerable), 4) AS relevance, round(avg(declined::INT) FILTER (judged AND answerable), 4) AS false_abstention,
 round(avg(declined::INT) FILTER (judged AND NOT answerable), 4) AS correct_abstention, round(avg(valid::INT) FILTER (judged), 4) AS citations_valid FROM r GROUP BY GROUPING SETS ((), (kind), (set))""")
def i29_run_summary(spark, sf_dir):
    return runs.run_summary(records(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 2))


@query(f"""WITH {RECORDS} SELECT count(*) AS graded, round(avg(faithful) FILTER (answerable), 4) AS faithfulness, round(avg(fitting) FILTER (answerable), 4) AS relevance, round(avg(declined::INT) FILTER (answerable), 4) AS false_abstention,
 round(avg(declined::INT) FILTER (NOT answerable), 4) AS correct_abstention, round(avg(valid::INT), 4) AS citations_valid, sum(dangling)::BIGINT AS dangling_citations, count(*) FILTER (truncated) AS truncated, round(sum(cost), 2) AS cost_usd FROM r WHERE judged""")
def i31_judge_summary(spark, sf_dir):
    return runs.judge_summary(records(spark, sf_dir).filter("judge is not null")).withColumn("cost_usd", F.round("cost_usd", 2))
