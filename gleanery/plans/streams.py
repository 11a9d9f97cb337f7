"""Queries J7 and J10 to J13 on streams: the tables are written as files and replayed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..sources.scratch import scratch
from ..streaming import folders, usage
from .ingest import FILES, incremental
from .logs import LIMITED
from .shared import query, table


def logged(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 7).cast("string").alias("owner"), F.round("value", 4).alias("cost"))


def arriving(spark, sf_dir):
    folder = scratch(spark, "log")
    logged(spark, sf_dir).write.parquet(folder)
    return spark.readStream.schema(usage.LOG).parquet(folder)


@query("SELECT CAST(day AS VARCHAR) AS day, owner, round(sum(cost), 3) AS spent FROM (SELECT CAST(ts AS DATE) AS day, CAST(user_id % 7 AS VARCHAR) AS owner, round(value, 4) AS cost FROM events) WHERE cost > 0 AND day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE round(value, 4) > 0) GROUP BY ALL")
def j7_daily_spend_stream(spark, sf_dir):
    out = usage.replayed(usage.daily_spend(arriving(spark, sf_dir)), "spend", scratch(spark, "state"))
    return out.select(F.col("day").cast("string").alias("day"), "owner", F.round("spent", 3).alias("spent"))


@query(f"WITH RECURSIVE {LIMITED} SELECT id, admitted FROM steps WHERE id IS NOT NULL")
def j10_rate_limit_stream(spark, sf_dir):
    """The log arrives in four files, quarter by quarter of its time, and each is a micro-batch."""
    folder, log = scratch(spark, "log"), logged(spark, sf_dir)
    first, last = log.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    quarter = F.floor(4 * (F.unix_micros("ts") - F.lit(first)) / F.lit(last - first + 1))
    for q in range(4):
        log.filter(quarter == q).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(usage.LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    with usage.rocks(spark):
        return usage.replayed(usage.rate_limit(arriving, 20, 3600.0), "rate", scratch(spark, "state"))


@query("SELECT event_id AS id, user_id AS tokens FROM events")
def j11_log_stream(spark, sf_dir):
    folder = scratch(spark, "lines")
    table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), F.col("user_id").alias("tokens"))).alias("value")).write.text(folder)
    out = usage.replayed(usage.log_lines(spark, folder), "lines", scratch(spark, "state"))
    return out.select(F.col("request_id").cast("long").alias("id"), "tokens")


WAVES = """src AS (SELECT page_id AS i, html, 'p/' || lpad(CAST(page_id AS VARCHAR), 9, '0') || CASE WHEN page_id % 10 = 0 THEN '.pdf' WHEN page_id % 2 = 0 THEN '.md' ELSE '.txt' END AS relative,
  page_id % 4 = 3 AS late, page_id % 6 = 0 AND page_id % 4 <> 3 AS changed, page_id % 7 = 5 AND page_id % 4 <> 3 AS removed FROM pages),
told AS (SELECT *, CASE WHEN changed THEN html || ' changed' WHEN i % 25 = 1 THEN '  ' || chr(10) ELSE html END AS content FROM src),
found AS (SELECT relative, content, CASE WHEN late OR changed THEN 1 ELSE 0 END AS batch FROM told WHERE NOT removed UNION ALL SELECT 'z/' || lpad(CAST(i AS VARCHAR), 9, '0') || '.txt', content, 2 FROM told WHERE i % 5 = 2),
judged AS (SELECT *, min(relative) OVER (PARTITION BY content) AS first, CASE WHEN relative LIKE '%.pdf' THEN 'unreadable' WHEN trim(regexp_replace(content, '\\s+', ' ', 'g')) = '' THEN 'no_text' END AS kind FROM found)"""


def waves(spark, sf_dir):
    """Three waves of files of all pages, as (relative, content): what is there at first, some of it blank or in a form
    without a reader; pages that arrive, change or go; and copies of pages, some of which have gone."""
    i, name = F.col("page_id"), F.lpad(F.col("page_id").cast("string"), 9, "0")
    late, changed, removed = i % 4 == 3, (i % 6 == 0) & (i % 4 != 3), (i % 7 == 5) & (i % 4 != 3)
    relative = F.concat(F.lit("p/"), name, F.when(i % 10 == 0, ".pdf").when(i % 2 == 0, ".md").otherwise(".txt"))
    first = F.when(i % 25 == 1, "  \n").otherwise(F.col("html"))
    last = F.when(changed, F.concat("html", F.lit(" changed"))).otherwise(first)
    pages = table(spark, sf_dir, "pages")
    yield pages.filter(~late).select(relative.alias("relative"), first.alias("content"))
    yield pages.filter(late | changed | removed).select(relative.alias("relative"), F.when(~removed, last).alias("content"))
    yield pages.filter(i % 5 == 2).select(F.concat(F.lit("z/"), name, F.lit(".txt")).alias("relative"), last.alias("content"))


@query(rf"""WITH {WAVES} SELECT relative, CASE WHEN relative <> first THEN 'copy' WHEN kind IS NOT NULL THEN 'failed' WHEN batch = 2 THEN 'new' ELSE 'unchanged' END AS status, relative = first AND kind IS NULL AS stored,
 CASE WHEN relative <> first THEN first END AS same_as, CASE WHEN relative = first THEN kind END AS kind, CASE WHEN relative = first AND kind IS NULL THEN CAST(batch AS BIGINT) END AS batch, relative = first AND kind IS NULL AS has_chunks, false AS repeated FROM judged""")
def j12_folder_stream(spark, sf_dir):
    """Three waves, each a micro-batch of a stream of ticks, and the last one asked for once more: the ledger after them,
    and whether each document has chunks."""
    folder, root, ticks, state = (scratch(spark, x) for x in ("watched", "store", "ticks", "state"))
    clock = None
    for number, wave in enumerate(waves(spark, sf_dir)):
        files.write_files(wave, folder)
        spark.createDataFrame([(str(number),)], "value string").write.mode("append").text(ticks)
        clock = clock or spark.readStream.text(ticks)
        folders.watch(clock, folder, root, state).awaitTermination()
    repeated = folders.sync(spark, folder, root, number)
    there = folders.current_chunks(spark, root).select(F.col("document_id").alias("relative"), F.lit(True).alias("has_chunks")).distinct()
    now = folders.ledger(spark, root).select("relative", "status", "stored", "same_as", "kind", "batch")
    return now.join(there, "relative", "left").withColumn("has_chunks", F.coalesce("has_chunks", F.lit(False))).withColumn("repeated", F.lit(repeated))


@query(f"""WITH {FILES}, f AS (SELECT relative, relative <> min(relative) OVER (PARTITION BY sha256) AS copy, min(relative) OVER (PARTITION BY sha256) AS first, CAST(left(relative, 9) AS BIGINT) AS id FROM files),
s AS (SELECT relative, first, CASE WHEN id % 11 = 5 THEN 'gone' WHEN copy THEN 'copy' WHEN id % 3 = 0 THEN 'new' WHEN id % 5 = 0 THEN 'changed' WHEN id % 7 = 0 THEN 'failed' WHEN id % 2 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM f WHERE NOT (id % 11 = 5 AND id % 3 = 0))
SELECT 'ready' AS state, count(*) FILTER (status <> 'gone') AS files_found, count(*) FILTER (status <> 'gone') AS files_checked, count(*) FILTER (status IN ('new', 'changed')) AS stored_this_run, count(*) FILTER (status = 'unchanged') AS unchanged,
 count(*) FILTER (status = 'failed') AS not_indexed, count(*) FILTER (status = 'copy') AS copies_not_stored, count(*) FILTER (status = 'gone') AS gone,
 (SELECT string_agg(relative, ',' ORDER BY relative) FROM (SELECT relative FROM s WHERE status = 'failed' ORDER BY 1 LIMIT 20)) AS not_indexed_files, greatest(0, count(*) FILTER (status = 'failed') - 20) AS not_indexed_more,
 (SELECT string_agg(relative || '=' || first, ',' ORDER BY relative) FROM (SELECT relative, first FROM s WHERE status = 'copy' ORDER BY 1 LIMIT 20)) AS copies FROM s""")
def j13_sync_status(spark, sf_dir):
    """The report on the pass of A9, over files of all documents."""
    statuses, same = incremental(spark, sf_dir)
    now = statuses.join(same, "relative", "left").withColumn("reason", F.lit(None).cast("string")).withColumn("kind", F.lit(None).cast("string"))
    out = folders.sync_status(now)
    listed = F.array_join(F.transform("not_indexed_files", lambda x: x["file"]), ",")
    return out.withColumn("not_indexed_files", F.when(listed != "", listed)).withColumn("copies", F.array_join(F.transform("copies", lambda x: F.concat_ws("=", x["file"], x["same_as"])), ","))
