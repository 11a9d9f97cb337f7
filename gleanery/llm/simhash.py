"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint holds a majority vote, bit by bit, over the hashes of a document's word shingles. Fingerprints within
`radius` 2 are found through the two 32-bit halves: either half 1 is equal, or differs in one bit (a small Hamming ball
is enumerated there), or differs in two. What is left to differ in the other half is bounded then, so one of its parts is
equal as well and narrows the table key. Matches are verified on complete distances. Only distinct fingerprints take
part, so groups of copies are one row here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import steps, text_rows, written
from .graph import components

SEED = 42
RADIUS = 2


def votes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of `sizes` hashes: bits set in over half of the run; zero for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(sizes) - sizes)[full]
        set_in = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(set_in * 2 > sizes[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_step(texts: list[bytes | None], width: int) -> np.ndarray:
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or b"").lower().split()
        before = len(hashes)
        if 0 < len(words) < width:
            hashes.append(xxh64_intdigest(b" ".join(words), SEED))
        elif words:
            hashes += [xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(width)), strict=False)]
        sizes[i] = len(hashes) - before
    return votes(np.array(hashes, np.uint64), sizes)


def fingerprints(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key (xxhash64 of id and text), fp (64 bits as a signed long) of each row's whole text: A-Z lower-cased, words are runs without ASCII
    white space, shingles of `width` words with repeats. Fewer words: the whole sequence; none, or null: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, most=1 << 20):
                found = fingerprint_step(part.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found.view(np.int64))], ["doc_id", "row_key", "fp"])

    rows = text_rows(docs, id_col, text_col)
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("row_key"))
    return rows.mapInArrow(run, "doc_id long, row_key long, fp long")


def low(x, bits: int, shift: int = 0):
    return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1))


def near_pairs(distinct: DataFrame) -> DataFrame:
    """a, b: all pairs of distinct fingerprints (column fp) that differ in one or two bits; a pair may come twice."""
    fp = F.col("fp")
    one, two = low(fp, 32, 32), low(fp, 32)

    def keyed(rows: DataFrame, keys) -> DataFrame:
        return rows.select("fp", F.explode(F.array(*keys) if isinstance(keys, list) else keys).alias("key"))

    def key(tag: int, *parts):
        return F.xxhash64(F.lit(tag), *parts)

    thirds = ((11, 0), (11, 11), (10, 22))
    # halves 1 equal: at most two bits of half 2, so a third of it is equal; and the same with the halves swapped
    equal = keyed(distinct, [key(10 + k, one, low(two, *t)) for k, t in enumerate(thirds)] + [key(20 + k, two, low(one, *t)) for k, t in enumerate(thirds)])
    # one bit in either half: the ball around half 1, upwards only, and one 16-bit part of half 2 is equal
    table = keyed(distinct, [key(30, one, low(two, 16)), key(31, one, low(two, 16, 16))])
    ball = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(F.call_function("shiftright", one, i).bitwiseAND(F.lit(1)) == 0, one.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))), lambda x: x.isNotNull())
    probes = distinct.select("fp", F.explode(ball).alias("half")).select("fp", F.explode(F.array(key(30, F.col("half"), low(two, 16)), key(31, F.col("half"), low(two, 16, 16)))).alias("key"))

    def matched(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
        pairs = left.select("key", F.col("fp").alias("a")).join(right.select("key", F.col("fp").alias("b")), "key")
        close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, RADIUS)
        return pairs.filter(close & (F.col("a") < F.col("b")) if ordered else close).select("a", "b")

    return matched(equal, equal, True).unionByName(matched(probes, table, False))


def grouped(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, fp, root (the group's key, a fingerprint) and component_id of each row."""
    rows = written(fingerprints(docs, width=width, id_col=id_col, text_col=text_col), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(near_pairs(classes.select("fp")), "a", "b").withColumnsRenamed({"node": "fp", "component": "root"})
    classes = classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(classes.select("fp", "root").join(roots, "root"), "fp")


def near_duplicates(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach, itself included).

    Texts without words (null, empty) share fingerprint 0 and are linked like any other. Rows whose id is null take part
    and are no component's id unless it has no other (then null). Repeated rows give a row each; an empty table gives an
    empty one; further columns are not carried.
    """
    found = grouped(docs, width=width, id_col=id_col, text_col=text_col)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that stand for their group of near copies: one row a group, the one
    with the smallest id (null ids last). Rows that share an id without being near copies are groups of their own."""
    found = grouped(docs, width=width, id_col=id_col, text_col=text_col)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key"))
    chosen = found.groupBy("root").agg(least.alias("x")).select(F.coalesce("x.doc_id", F.lit(-1)).alias("__id"), F.col("x.row_key").alias("__row_key"))
    own = F.col(f"`{id_col}`").cast("long")  # a null id has the hash of none, so that -1 is no clash
    keyed = docs.withColumn("__id", F.coalesce(own, F.lit(-1))).withColumn("__row_key", F.xxhash64(own, F.col(f"`{text_col}`").cast("string")))
    return keyed.join(chosen, ["__id", "__row_key"], "left_semi").dropDuplicates(["__id", "__row_key"]).drop("__id", "__row_key")
