"""What the embedding operators share: usable vectors and classes of equal ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit(v):
    """Whether a vector (array<float>) can be compared; never null."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(sound, F.lit(False))


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vec of the rows whose vector is neither null nor empty nor zero and holds finite components only."""
    v = F.col(f"`{vector_col}`").cast("array<float>")
    return table.filter(fit(v)).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vec"))


def unusable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id of the other rows."""
    return table.filter(~fit(F.col(f"`{vector_col}`").cast("array<float>"))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"))


def raw(table: DataFrame) -> DataFrame:
    """id and the vector's bytes (float32), which group and shuffle as one value. -0.0 becomes 0.0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            flat = np.asarray(vectors.flatten(), np.float32) + np.float32(0)
            ends = np.cumsum(np.r_[0, np.asarray(pc.list_value_length(vectors))]) * 4
            data = flat.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["id", "vec"])


    return table.mapInArrow(run, "id long, vec binary")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, stored as bytes, as rows of a float32 matrix."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.float32).reshape(len(cells), -1) if cells else np.zeros((0, 1), np.float32)


def dimension(rows: DataFrame) -> int:
    """The vectors' one length; 0 for an empty table. Different lengths are an error."""
    low, high = rows.agg(F.min(F.octet_length("vec")), F.max(F.octet_length("vec"))).first()
    if low != high:
        raise ValueError("vectors of different lengths")
    return (low or 0) // 4


def smallest_ids(rows: DataFrame, most: int) -> DataFrame:
    """vec and ids, the `most` smallest ids of each distinct vector. Each task drops what can't be among them before the
    shuffle, so a vector that many rows share is not hot."""
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    return rows.filter(F.col("id").isNotNull()).withColumn("r", rank).filter(F.col("r") <= most).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
