"""A folder kept in step with a chunk store, pass after pass, each applied exactly once.

Below a root lie `chunks/batch=n`, the chunks that pass n made, and `ledger/v=n`, one row for each file as of pass n. The
ledger names, for each stored file, the pass whose chunks are its current ones; so replacing or forgetting a document only
changes its row, and chunk files are only ever added. A pass writes its chunks, then its ledger; Spark's _SUCCESS file in
the latter is what makes the pass count. A pass that failed half-way writes the same places again, and one that counts
already is left alone.

A pass lists the folder, without reading it; only files that are new or whose time or size changed are read. Tasks list and
read, and the driver holds no names. Passes are the micro-batches of any stream, such as the arrivals in the folder or a clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chunking import CHUNKS, chunk_documents
from ..sources import files

LEDGER = (
    "relative string, path string, mtime long, size long, sha256 string, status string, stored boolean, document_id string, same_as string, reason string, kind string, batch long"
)
SHOWN = 20


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def passes(spark: SparkSession, root: str) -> list[int]:
    """The passes whose ledgers are there and count, oldest first. Old ledgers are removed, so these are a few."""
    system, where = _folder(spark, f"{root}/ledger")
    if not system.exists(where):
        return []
    jvm = spark._jvm
    found = [s.getPath() for s in system.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in found if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def ledger(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The ledger after the last pass, or after pass `number`; empty before the first."""
    known = passes(spark, root)
    number = known[-1] if number is None and known else number
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger/v={number}") if number in known else spark.createDataFrame([], LEDGER)


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of all stored documents, each from the pass that made its current ones."""
    now = ledger(spark, root).filter("stored").select("document_id", "batch")
    if not passes(spark, root):
        return spark.createDataFrame([], CHUNKS)
    system, where = _folder(spark, f"{root}/chunks")
    if not system.exists(where):
        return spark.createDataFrame([], CHUNKS)
    every = spark.read.schema(f"{CHUNKS}, batch long").option("basePath", f"{root}/chunks").parquet(f"{root}/chunks")
    return every.join(now, ["document_id", "batch"], "left_semi").drop("batch")


def signed(listing: DataFrame, old: DataFrame) -> DataFrame:
    """The files of a listing with what the ledger knows of them (was_...) and `same`: neither time nor size changed."""
    was = old.select("relative", *[F.col(c).alias(f"was_{c}") for c in ("mtime", "size", "sha256", "stored", "same_as", "reason", "kind", "batch")])
    same = (F.col("mtime") == F.col("was_mtime")) & (F.col("size") == F.col("was_size"))
    return listing.join(was, "relative", "left").withColumn("same", F.coalesce(same, F.lit(False)))


def refusal(size: Column, loader: Column, text: Column) -> tuple[Column, Column]:
    """Why a file can't be stored, and what kind of failure that is; nulls for one that can."""
    kind = F.when(size > files.MOST_BYTES, "too_large").when(loader == "pages", "unreadable").when(F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) == 0, "no_text")
    reason = F.when(kind == "too_large", F.lit(f"over {files.MOST_BYTES} bytes")).when(kind == "unreadable", F.lit("no reader for pages")).when(kind == "no_text", F.lit("no text in it"))
    return reason, kind


def sync(spark: SparkSession, folder: str, root: str, number: int, *, stored: DataFrame | None = None) -> bool:
    """Pass `number` over a folder; False if that pass, or a later one, counts already.

    Of files with the same bytes the first path is stored, later ones are copies of it; one that was stored before is
    forgotten. A file that failed and hasn't changed is reported again without another try; one that is gone leaves the
    store with this pass and the ledger with the next. `stored` (document_id), if given, is what the store really holds: a
    document that isn't in it is stored again.
    """
    known = passes(spark, root)
    if known and known[-1] >= number:
        return False
    old = ledger(spark, root).filter("status <> 'gone'")
    scratch = f"{root}/passes/{number}"
    listing = files.list_folder(spark, folder, f"{scratch}/listing").select("relative", "path", "size", F.unix_micros("modified").alias("mtime"))
    found = signed(listing, old)
    if stored is None:
        found = found.withColumn("kept", F.coalesce("was_stored", F.lit(False)))
    else:
        there = stored.select(F.col("document_id").alias("relative"), F.lit(True).alias("there")).distinct()
        found = found.join(there, "relative", "left").withColumn("kept", F.coalesce(F.col("was_stored") & F.col("there"), F.lit(False))).drop("there")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{scratch}/{name}")
        return spark.read.parquet(f"{scratch}/{name}")

    failed = F.col("same") & F.col("was_kind").isNotNull() & F.col("was_sha256").isNotNull()
    unread = found.filter(F.col("was_sha256").isNull() | ~(F.col("same") & (F.col("kept") | F.col("was_same_as").isNotNull() | failed))).select("relative", "path")
    read = files.read_files(spark, folder, unread).select("relative", F.sha2("content", 256).alias("now_sha256"), files.decoded(F.col("content")).alias("text"))
    read = written(read, "read")  # each file is read once
    found = found.join(read.select("relative", "now_sha256"), "relative", "left").withColumn("sha256", F.coalesce("now_sha256", "was_sha256"))
    first = found.groupBy("sha256").agg(F.min("relative").alias("first"))  # partial minima: copies are not hot
    found = found.join(first, "sha256", "left").withColumn("same_as", F.when(F.col("relative") != F.col("first"), F.col("first"))).drop("first")
    status = (
        F.when(F.col("same_as").isNotNull(), "copy").when(F.col("was_mtime").isNull(), "new").when(~F.col("same"), "changed")
        .when(F.col("kept"), "unchanged").when(failed, "failed").otherwise("changed")
    )
    found = written(found.withColumn("status", status), "files")
    # a copy whose first file has gone is read again, as it is stored now
    todo = found.filter(F.col("status").isin("new", "changed")).select("relative", "path", "size", F.col("now_sha256").isNull().alias("unread"))
    late = files.read_files(spark, folder, todo.filter("unread").select("relative", "path")).select("relative", files.decoded(F.col("content")).alias("text"))
    loaded = todo.join(read.select("relative", "text").unionByName(late), "relative")
    reason, kind = refusal(F.col("size"), F.col("loader"), F.col("text"))
    tried = written(files.route(loaded).select("relative", "text", reason.alias("now_reason"), kind.alias("now_kind")), "tried")
    chunk_documents(tried.filter("now_kind is null").select(F.col("relative").alias("document_id"), "text")).write.mode("overwrite").parquet(f"{root}/chunks/batch={number}")
    # a file that went away before it was read has no digest: it fails, and is read again at the next pass
    lost = F.col("tried").isNull()
    why = tried.drop("text").withColumn("tried", F.lit(True))
    done = F.col("status").isin("new", "changed")
    rows = found.join(why, "relative", "left")
    rows = rows.withColumn("now_reason", F.when(done & lost, "could not be read").otherwise(F.col("now_reason"))).withColumn("now_kind", F.when(done & lost, "unreadable").otherwise(F.col("now_kind"))).withColumn("good", F.when(done, F.col("now_kind").isNull()).otherwise(F.col("status") == "unchanged"))
    again = F.col("status") == "failed"
    rows = rows.select(
        "relative", "path", "mtime", "size", "sha256", F.when(done & ~F.col("good"), "failed").otherwise(F.col("status")).alias("status"), F.col("good").alias("stored"),
        F.when(F.col("good"), F.col("relative")).alias("document_id"), "same_as", F.when(done, F.col("now_reason")).when(again, F.col("was_reason")).alias("reason"),
        F.when(done, F.col("now_kind")).when(again, F.col("was_kind")).alias("kind"), F.when(F.col("good"), F.when(done, F.lit(number)).otherwise(F.col("was_batch"))).cast("long").alias("batch"),
    )
    gone = old.join(found.select("relative"), "relative", "left_anti").withColumn("status", F.lit("gone")).withColumn("stored", F.lit(False))
    for c in ("document_id", "same_as", "reason", "kind", "batch"):
        gone = gone.withColumn(c, F.lit(None).cast(gone.schema[c].dataType))
    rows.unionByName(gone).write.mode("overwrite").parquet(f"{root}/ledger/v={number}")
    for path in [scratch, *(f"{root}/ledger/v={n}" for n in known[:-1])]:
        system, where = _folder(spark, path)
        system.delete(where, True)
    return True


def vacuum(spark: SparkSession, root: str) -> list[int]:
    """Delete the chunks of passes that no stored document refers to; their numbers."""
    system, where = _folder(spark, f"{root}/chunks")
    if not passes(spark, root) or not system.exists(where):
        return []
    there = [int(s.getPath().getName()[6:]) for s in system.listStatus(where) if s.getPath().getName().startswith("batch=")]
    used = {r.batch for r in ledger(spark, root).filter("stored").select("batch").distinct().collect()}  # passes, not files
    last = passes(spark, root)[-1]
    out = [n for n in there if n not in used and n <= last]
    for n in out:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(where, f"batch={n}"), True)
    return out


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that appear in a folder, without their content: a clock that ticks when something arrives."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder).select("path")


def watch(clock: DataFrame, folder: str, root: str, checkpoint: str, *, after: Callable[[int], None] | None = None, **trigger):
    """Starts a stream that makes a pass with each micro-batch of `clock`, under the batch's number: what a restarted stream
    repeats is not applied again. Changed and gone files are seen at the next pass, whatever it was that set it off. Without
    another trigger (such as processingTime), what is there now is worked off and the stream ends."""

    def batch(rows: DataFrame, number: int) -> None:
        if sync(rows.sparkSession, folder, root, number) and after:
            after(number)

    return clock.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sync_status(now: DataFrame, most: int = SHOWN) -> DataFrame:
    """One row on a ledger: state, files_found, files_checked, stored_this_run, unchanged, not_indexed with the first files
    (relative, reason, kind) and how many more there are, copies_not_stored with the first ones, gone. The first ones are
    cut before they are gathered: no list grows with the folder."""
    shown = F.when(F.col("status") == "failed", "failed").when(F.col("status") == "copy", "copy")
    rank = F.row_number().over(Window.partitionBy("shown").orderBy("relative"))
    first = now.withColumn("shown", shown).filter("shown is not null").withColumn("r", rank).filter(F.col("r") <= most)
    entry = F.struct("relative", "reason", "kind", "same_as")
    lists = first.agg(*[F.array_sort(F.collect_list(F.when(F.col("shown") == s, entry))).alias(f"first_{s}") for s in ("failed", "copy")])

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    s = F.col("status")
    counts = now.agg(
        n(s != "gone").alias("files_found"), n(s != "gone").alias("files_checked"), n(s.isin("new", "changed")).alias("stored_this_run"), n(s == "unchanged").alias("unchanged"),
        n(s == "failed").alias("not_indexed"), n(s == "copy").alias("copies_not_stored"), n(s == "gone").alias("gone"),
    )
    both = counts.crossJoin(F.broadcast(lists))  # one row each
    return both.select(
        F.lit("ready").alias("state"), *counts.columns, F.transform("first_failed", lambda x: F.struct(x["relative"].alias("file"), x["reason"].alias("reason"), x["kind"].alias("kind"))).alias("not_indexed_files"),
        F.greatest(F.lit(0), F.col("not_indexed") - F.size("first_failed")).alias("not_indexed_more"), F.transform("first_copy", lambda x: F.struct(x["relative"].alias("file"), x["same_as"].alias("same_as"))).alias("copies"),
    )
