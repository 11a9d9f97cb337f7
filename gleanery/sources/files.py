"""Folders of files, records and evaluation sets as tables."""

from __future__ import annotations

import errno
import os
import stat
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import filled, upload_name
from .scratch import scratch

SUFFIXES = ("pdf", "md", "markdown", "txt", "text", "rst", "log")
MOST_BYTES = 25_000_000
READABLE = rf"(?i)\.({'|'.join(SUFFIXES)})$"


#: Names that Spark's readers leave out, of files and folders.
HIDDEN = r"(^|/)(\.[^/]*|_[^/=]*)$|\._COPYING_$"
ENTRY = "relative string, size long, mtime long"
#: Rows of a listing, and bytes of files, that a task holds at a time; one file is held whole.
LISTED, HELD_BYTES = 10_000, 8_000_000
#: Files that Spark's reader reads by name, where pyarrow doesn't find the folder; if more are wanted, it reads all of it.
BY_NAME = 5_000


def _reached(spark: SparkSession, folder: str) -> tuple[str, str | None]:
    """A folder's full name as Spark's readers give it, and its URI if pyarrow finds it there too."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where)
    name, uri = where.toString().rstrip("/"), where.toUri().toString()
    try:
        system, root = fs.FileSystem.from_uri(uri)
        return name, uri if system.get_file_info(root).type == fs.FileType.Directory else None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return name, None


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None, int]]:
    """name, size (None: a folder) and time in microseconds of what lies in a folder; a local one's names pass by one by one."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    s = entry.stat()
                except OSError as e:
                    if e.errno in (errno.ENOENT, errno.ELOOP):  # gone meanwhile, or a link to nothing
                        continue
                    raise
                if stat.S_ISDIR(s.st_mode) or stat.S_ISREG(s.st_mode):
                    yield entry.name, None if stat.S_ISDIR(s.st_mode) else s.st_size, s.st_mtime_ns // 1_000_000 * 1000
        return
    for i in system.get_file_info(fs.FileSelector(folder)):
        if i.type in (fs.FileType.Directory, fs.FileType.File):
            yield i.base_name, None if i.type == fs.FileType.Directory else i.size, (i.mtime_ns or 0) // 1_000_000 * 1000


def _dealt(names: DataFrame) -> DataFrame:
    """Rows with `relative` for all tasks. Names are few bytes, by which Spark would give them all to one; what is done for each
    is not. The hash of a hash stays apart from the exchange of a join by name, which Spark may coalesce."""
    spark = names.sparkSession
    return names.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("relative"))


def list_folder(spark: SparkSession, folder: str, work: str | None = None) -> DataFrame:
    """path, relative, size, modified of supported files anywhere below, hidden ones left out. Tasks list the folders, level
    by level, into tables below `work`, so the driver holds no names; where pyarrow doesn't find the folder, Spark's reader
    lists the files, in the driver and without empty ones."""
    name, uri = _reached(spark, folder)
    if uri is None:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        rows = rows.select(F.expr(f"substring(path, {len(name) + 2})").alias("relative"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        return rows.filter(F.col("relative").rlike(READABLE)).select(F.concat(F.lit(f"{name}/"), "relative").alias("path"), "relative", "size", "modified")
    work = work or scratch(spark, "listing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                found = _entries(system, f"{root}/{at}")
                try:
                    while part := list(islice(found, LISTED)):
                        names, sizes, times = zip(*part, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([f"{at}{n}" for n in names], pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.int64())], ["relative", "size", "mtime"])
                except FileNotFoundError:
                    if not at:
                        raise

    levels: list[str] = []
    todo = spark.createDataFrame([("",)], "relative string")
    while not levels or not todo.isEmpty():
        levels.append(f"{work}/level={len(levels)}")
        found = todo.mapInArrow(run, ENTRY).filter(~F.col("relative").rlike(HIDDEN) & (F.col("size").isNull() | F.col("relative").rlike(READABLE)))
        _dealt(found).write.mode("overwrite").parquet(levels[-1])  # one folder may hold all files
        todo = _dealt(spark.read.schema(ENTRY).parquet(levels[-1]).filter("size is null").select(F.concat("relative", F.lit("/")).alias("relative")))
    rows = spark.read.schema(ENTRY).parquet(*levels).filter("size is not null")
    return rows.select(F.concat(F.lit(f"{name}/"), "relative").alias("path"), "relative", "size", F.timestamp_micros("mtime").alias("modified"))


def read_files(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Rows (path, relative and any others) of files below a folder, with their content. All tasks read, each a few megabytes
    at a time; a file that has gone meanwhile is left out."""
    _, uri = _reached(spark, folder)
    if uri is None:
        few = wanted.select("path").limit(BY_NAME + 1).collect()
        reader = spark.read.format("binaryFile")
        if few:
            read = reader.load([r.path for r in few]) if len(few) <= BY_NAME else reader.option("recursiveFileLookup", "true").load(folder)
            return wanted.join(read.select("path", "content"), "path").select(*wanted.columns, "content")
        return wanted.withColumn("content", F.lit(None).cast("binary")).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)

        def taken(batch: pa.RecordBatch, at: list[int], held: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int64())).columns, pa.array(held, pa.binary())], [*batch.schema.names, "content"])

        for batch in batches:
            at, held, size = [], [], 0
            for i, name in enumerate(batch.column("relative").to_pylist()):
                try:
                    with system.open_input_stream(f"{root}/{name}") as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                if held and size + len(content) > HELD_BYTES:
                    yield taken(batch, at, held)
                    at, held, size = [], [], 0
                at.append(i)
                held.append(content)
                size += len(content)
            if held:
                yield taken(batch, at, held)

    schema = T.StructType([*wanted.schema.fields, T.StructField("content", T.BinaryType())])
    return _dealt(wanted).mapInArrow(run, schema)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, relative, size, modified, content of the files that list_folder finds."""
    return read_files(spark, folder, list_folder(spark, folder))


def write_files(rows: DataFrame, folder: str) -> None:
    """Each row (relative, content) as a file of that name below a folder that all executors share; a null content removes
    the file. Writing a file again replaces it, so a task that is repeated does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{root}/{name}"
                if content is None:
                    if system.get_file_info(path).type == fs.FileType.File:
                        system.delete_file(path)
                    continue
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.select("relative", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def decoded(content: Column) -> Column:
    """The text of a file; broken UTF-8 is replaced."""
    return F.make_valid_utf8(content.cast("string"))


def load_text(files: DataFrame) -> DataFrame:
    """document_id, title, text of whole text files; broken UTF-8 is replaced."""
    return files.select(stem(F.col("relative")).alias("document_id"), stem(F.col("relative")).alias("title"), decoded(F.col("content")).alias("text"))


def route(files: DataFrame) -> DataFrame:
    """Files with `loader`, or a reason for refusal."""
    suffix = F.lower(F.regexp_extract("relative", r"\.([^./]+)$", 1))
    loader = F.when(suffix == "pdf", "pages").when(suffix.isin("md", "markdown"), "markdown").when(suffix.isin(*SUFFIXES), "text")
    return files.withColumn("loader", loader).withColumn("reason", F.when(loader.isNull(), F.concat(F.lit("unsupported: "), suffix)))


def upload(files: DataFrame) -> DataFrame:
    """name, owner, size, text to document_id, or a reason."""
    name = upload_name(F.col("name"))
    reason = F.when(~name.rlike(READABLE), "unsupported").when(F.col("size") > MOST_BYTES, "too large").when(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "no text")
    return files.select("name", F.when(reason.isNull(), F.concat(F.lit("upload:"), "owner", F.lit(":"), stem(name))).alias("document_id"), reason.alias("reason"))


def records(rows: DataFrame) -> DataFrame:
    """In-memory documents with defaults; a batch in which any content is empty fails as a whole. Locators (kind, label,
    start, end) are checked and clamped; without any, one page holds the text."""
    text = F.col("content")
    checked = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, F.raise_error(F.lit("a document without content"))).otherwise(text)
    size = F.length("content")
    clamp = lambda x: F.greatest(F.lit(0), F.least(x, size))
    good = F.filter("locators", lambda x: x["kind"].isin("page", "section", "table") & x["label"].isNotNull())
    given = F.transform(good, lambda x: F.struct(x["kind"].alias("kind"), x["label"].alias("label"), clamp(x["start"]).alias("start"), clamp(x["end"]).alias("end")))
    whole = F.array(F.struct(F.lit("page").alias("kind"), F.lit("1").alias("label"), F.lit(0).alias("start"), size.alias("end")))
    return rows.select(
        filled(F.col("id"), "").alias("given"), filled(F.col("title"), "Untitled").alias("title"), filled(F.col("source"), "unknown").alias("source"), filled(F.col("category"), "general").alias("category"),
        checked.alias("text"), F.when(F.size("locators") > 0, given).otherwise(whole).alias("locators"), "i",
    ).select(F.when(F.col("given") == "", F.concat(F.lit("doc_"), F.col("i").cast("string"))).otherwise(F.col("given")).alias("document_id"), "title", "source", "category", "text", "locators")


def dedupe_by_content(files: DataFrame) -> DataFrame:
    """Files with sha256 and `same_as`, the first path with that content (null for the first itself)."""
    digest = F.sha2(F.col("content"), 256)
    hashed = files.select("relative", digest.alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min("relative").alias("first"))  # partial minima: copies are not hot
    return hashed.join(first, "sha256").select("relative", "sha256", F.when(F.col("relative") != F.col("first"), F.col("first")).alias("same_as"))


def incremental_pass(files: DataFrame, ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """relative, status: new, changed, unchanged, failed (known, not tried again), copy or gone. files: relative, mtime, size,
    same_as. ledger: relative, mtime, size, is_stored, document_id. stored: document_id."""
    old = ledger.select("relative", F.col("mtime").alias("m"), F.col("size").alias("s"), "is_stored", "document_id")
    there = stored.select("document_id", F.lit(True).alias("there"))
    both = files.join(old, "relative", "full_outer").join(there, "document_id", "left")
    same = (F.col("mtime") == F.col("m")) & (F.col("size") == F.col("s"))
    status = (
        F.when(F.col("size").isNull(), "gone").when(F.col("same_as").isNotNull(), "copy").when(F.col("m").isNull(), "new").when(~same, "changed")
        .when(~F.col("is_stored"), "failed").when(F.col("there").isNull(), "changed").otherwise("unchanged")
    )
    return both.select("relative", status.alias("status"))


def upsert(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks replace all old ones of their documents; a document without new chunks keeps its old ones."""
    return chunks.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def forget(chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors, report): the report has document_id, found and the chunks that go."""
    gone = chunks.join(ids, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("chunks"))
    report = ids.distinct().join(gone, "document_id", "left").select("document_id", F.col("chunks").isNotNull().alias("found"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    return chunks.join(ids, "document_id", "left_anti"), report


def get_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(chunks, "chunk_id", "left")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, document_id, grade of a TSV file with its header; short rows go, and a pair's last grade counts."""
    lines = spark.read.text(path, wholetext=False).select("value", F.monotonically_increasing_id().alias("line"))
    head = lines.filter(F.col("value") == "query-id\tcorpus-id\tscore").limit(1).count()
    if not head:
        raise ValueError("the header query-id, corpus-id, score is missing")
    cells = lines.select("line", F.split("value", "\t").alias("x")).filter((F.size("x") >= 3) & (F.get("x", F.lit(0)) != "query-id"))
    rows = cells.select("line", F.get("x", F.lit(0)).alias("query_id"), F.get("x", F.lit(1)).alias("document_id"), F.get("x", F.lit(2)).cast("double").alias("grade"))
    return rows.groupBy("query_id", "document_id").agg(F.max_by("grade", "line").alias("grade"))


def read_queries(spark: SparkSession, path: str, judged: DataFrame) -> DataFrame:
    """query_id, text of the judged questions; one without text is an error."""
    rows = spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("query_id"), "text").join(judged.select("query_id").distinct(), "query_id", "left_semi")
    if judged.select("query_id").distinct().join(rows.filter("text is not null"), "query_id", "left_anti").limit(1).count():
        raise ValueError("a judged question has no text")
    return rows


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """document_id, text: title, blank line and text, or whichever there is; empty ones go."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    text = F.concat_ws("\n\n", F.nullif("title", F.lit("")), F.nullif("text", F.lit("")))
    return rows.select(F.col("_id").alias("document_id"), text.alias("text")).filter("text <> ''")


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, units) of a JSONL file of golden questions. questions: query_id, kind, answerable, text, expect. units:
    query_id, unit: the documents that answer a question, or where it names pages, the pages of them (document#p1); none
    of a question that says neither."""
    schema = "id string, kind string, answerable boolean, question string, expect string, relevant_docs array<string>, relevant_pages map<string,array<int>>"
    rows = spark.read.schema(schema).json(path)
    questions = rows.select(F.col("id").alias("query_id"), "kind", "answerable", F.col("question").alias("text"), "expect")
    by_page = rows.select(F.col("id").alias("query_id"), F.explode("relevant_pages").alias("document", "pages")).select("query_id", "document", F.explode("pages").alias("page"))
    by_page = by_page.select("query_id", F.concat("document", F.lit("#p"), F.col("page").cast("string")).alias("unit"))
    by_document = rows.filter("relevant_pages is null").select(F.col("id").alias("query_id"), F.explode("relevant_docs").alias("unit"))
    return questions, by_page.unionByName(by_document).distinct()


def page_loss(pages: DataFrame) -> DataFrame:
    """document_id, lost: the pages that could not be read, of documents that lost any."""
    lost = F.sort_array(F.collect_list(F.when(~F.col("readable"), F.col("page"))))
    return pages.groupBy("document_id").agg(lost.alias("lost")).filter(F.size("lost") > 0)


def built_with(stamp: Column, n_chunks: Column, model: Column, default: str) -> Column:
    """The embedding model that a store's vectors are of: one without a stamp counts as the default's, an empty one as any."""
    return F.coalesce(stamp, F.when(F.coalesce(n_chunks, F.lit(0)) > 0, F.lit(default)).otherwise(model))


def guard_model(stamp: DataFrame, model: str, default: str, chunks: DataFrame) -> None:
    """Refuse a store that another embedding model built."""
    one = chunks.limit(1).agg(F.count("*").alias("n")).join(stamp.limit(1).select("model"), how="left")  # one row each
    built = one.select(built_with(F.col("model"), F.col("n"), F.lit(model), default).alias("built")).first()["built"]
    if built != model:
        raise ValueError(f"the store was built with {built}, not {model}")


def run_payload(metrics: DataFrame) -> DataFrame:
    """One row: the long metric table (mode, metric, value) as nested JSON, by name."""
    per = metrics.groupBy("mode").agg(F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("m"))
    modes = F.transform(F.array_sort(F.collect_list(F.struct("mode", "m"))), lambda x: F.struct(x["mode"], F.map_from_entries(x["m"])))
    return per.agg(F.to_json(F.map_from_entries(modes)).alias("modes"))
