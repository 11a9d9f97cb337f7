"""What several of the corpus operators need: Arrow helpers and a place for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python worker looks at together.
STEP_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors share; set here only if a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            if not context.isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleanery-"))
        folder = context.getCheckpointDir().get()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: the lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleanery-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path_of: DataFrame) -> None:
    """Delete a table that `written` made, once nothing reads it any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for file in path_of.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("gleanery-"):
            folder.getFileSystem(conf).delete(folder, True)


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column of the input can clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows with about `most` bytes of text each (one row at least)."""
    array = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # what a long batch took isn't held for the next ones


def crc_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[starts[i] : starts[i] + sizes[i]], one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Bounded(dict):
    """A cache that drops its oldest half when it would hold more than `most` entries, so that a worker's memory stays
    bounded."""

    def __init__(self, most: int):
        self.most = most

    def room(self, n: int) -> None:
        if len(self) + n > self.most:
            for k in list(islice(self, len(self) // 2 if n < self.most // 2 else len(self))):
                del self[k]
