"""Repeated token windows across a corpus, found by Rabin-Karp hashes that Spark counts.

1. Each document's words are hashed, and a rolling polynomial over 35 of them gives a hash for every window. A block of
   documents sends its hashes, dealt by their leading bits, as packed rows: with its position each hash that occurs once
   in the block, and once each that occurs more often there, whose positions are known to count and stay with the block.
2. Shuffled by those bits, hashes that occur more than once are found, and each block gets their positions back.
3. Shuffled by block, positions become document spans; windows that overlap or touch merge into maximal intervals.
4. The documents are joined with their intervals, and the covered words go.

So a window weighs at most one entry a block in its bucket, however often it repeats. The number of buckets follows the
size of the text, and so does the length of the hashes: two independent ones, of 64 to 128 bits together, so that the
chance of any two different windows of the whole table being taken for one is below one in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import steps, text_rows

BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket, and the fewest buckets.
BUCKET_BYTES, FEWEST = 16 << 20, 64
SPAN = T.StructType().add("start", "long").add("end", "long")
KEPT = T.StructType().add("kept", "binary").add("n_words", "long").add("n_removed", "long").add("spans", T.ArrayType(SPAN))
#: n of a bucket's row: its hashes with positions, plus MANY for each hash without.
MANY = 1 << 32
MOVED = "block long, bucket long, n long, payload binary"


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def window_hashes(words: np.ndarray, sizes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all windows of `width` words within each run of `sizes` words, in order: a rolling polynomial modulo
    2**64 by prefix sums, then mixed so that the leading bits spread evenly."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    # sum of words[j] * base**-j over a window, times base**(its last j): the usual Rabin-Karp value
    sums = np.r_[np.uint64(0), np.cumsum(words * powers(n, pow(base, -1, 1 << 64)), dtype=np.uint64)]
    out = (sums[width:] - sums[:-width]) * powers(n, base)[width - 1 :]
    ends = np.cumsum(sizes)
    inside = np.ones(n, bool)
    for back in range(1, width):  # no window starts among the last width - 1 words of a run
        at = (ends - back)[sizes >= back]
        inside[at] = False
    return mixed(out[inside[: len(out)]])


def second_bits(size: int) -> int:
    """Bits of the second hash for `size` bytes of text, which hold at most size / 2 words: with the first one's 64 bits,
    half the square of the number of windows is below 2 to the number of bits less 20."""
    return min(64, max(0, 2 * max(1, size // 2).bit_length() + 20 - 1 - 64))


def alike(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows stand together, and for each place but the first whether it equals the one before."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    same, other = a[1:] == a[:-1], b[1:] != b[:-1]
    if (same & other).any():  # the first hash alone doesn't tell them apart
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same, other = a[1:] == a[:-1], b[1:] != b[:-1]
    return order, same & ~other


def put(arrays: list[np.ndarray]) -> bytes:
    """Unsigned 64-bit arrays as byte planes, compressed."""
    planes = b"".join(np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def got(payload: bytes, sizes: list[int]) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload, max_output_size=8 * sum(sizes) + 1), np.uint8)
    return [np.ascontiguousarray(c.reshape(8, -1).T).view("<u8").ravel() for c in np.split(planes, np.cumsum(sizes)[:-1] * 8)]


def moved(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "bucket", "n", "payload"])


def windows_out(width: int, bits: int, more_bits: int = 0):
    def rows_of(block: int, keys: list[tuple[int, int]], runs: list[np.ndarray]) -> list[tuple]:
        sizes = np.array([len(r) for r in runs], np.int64)
        words = np.concatenate(runs)
        hashes, second = window_hashes(words, sizes, width, BASES[0]), window_hashes(mixed(words * np.uint64(BASES[1])), sizes, width, BASES[1])
        second = second >> np.uint64(64 - more_bits) if more_bits else np.zeros_like(second)
        counts = np.maximum(0, sizes - width + 1)
        some = np.flatnonzero(counts)
        if not len(some):
            return []
        a, b = (np.array([keys[i][k] for i in some], np.int64).view(np.uint64) for k in (0, 1))
        out = [(block, -1 - 2 * block, len(some), put([a, b, counts[some].astype(np.uint64)]))]
        order, same = alike(hashes, second)
        starts = np.flatnonzero(np.r_[True, ~same])
        times = np.diff(np.r_[starts, len(order)])
        if (times > 1).any():
            at = np.sort(order[np.repeat(times > 1, times)])
            out.append((block, -2 - 2 * block, len(at), put([np.diff(at, prepend=0).astype(np.uint64)])))
        once, often = np.sort(order[starts[times == 1]]), order[starts[times > 1]]
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        once = once[np.argsort(bucket[once], kind="stable")]
        a, b = (np.searchsorted(bucket[x], np.arange((1 << bits) + 1)) for x in (once, often))
        rest = hashes & np.uint64((1 << (64 - bits)) - 1)
        for k in np.flatnonzero(np.diff(a) + np.diff(b)):
            at, more = once[a[k] : a[k + 1]], often[b[k] : b[k + 1]]
            both = np.r_[at, more]
            out.append((block, int(k), len(at) + MANY * len(more), put([rest[both], second[both], np.diff(at, prepend=0).astype(np.uint64)])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, size = TaskContext.get().partitionId() << 32, 0, 0
        keys: list[tuple[int, int]] = []
        runs: list[np.ndarray] = []
        for batch in batches:
            for part in steps(batch, most=1 << 20):
                for a, b, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = (text or b"").split()
                    if len(words) >= width:
                        runs.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
                        keys.append((a, b))
                        size += len(text)
                if size >= BLOCK_BYTES:
                    if rows := rows_of(first + n, keys, runs):
                        yield moved(rows)
                    keys, runs, size, n = [], [], 0, n + 1
        if runs and (rows := rows_of(first + n, keys, runs)):
            yield moved(rows)

    return run


def repeated(table: pa.Table) -> pa.Table:
    """Of a bucket's rows: the positions of windows that occur more than once. A block's own rows pass."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "bucket", "n", "payload")), strict=True))
    if rows and rows[0][1] >= 0:
        cells = [got(p, [n % MANY + n // MANY, n % MANY + n // MANY, n % MANY]) for _, _, n, p in rows]
        order, same = alike(*(np.concatenate([x[j] for x in cells]) for j in (0, 1)))
        again = np.zeros(len(order), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        out, start = [], 0
        for (block, bucket, _, _), (own, _, gaps) in zip(rows, cells, strict=True):
            at = np.cumsum(gaps)[again[start : start + len(gaps)]]
            start += len(own)
            if len(at):
                out.append((block, bucket, len(at), put([np.diff(at, prepend=np.uint64(0))])))
        rows = out
    cells = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table({c: pa.array(v, k) for c, v, k in zip(("block", "bucket", "n", "payload"), cells, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)})


def spans_of(width: int):
    def run(table: pa.Table) -> pa.Table:
        docs, found = None, []
        for bucket, n, payload in zip(*(table.column(c).to_pylist() for c in ("bucket", "n", "payload")), strict=True):
            if bucket < 0 and bucket % 2:
                docs = got(payload, [n, n, n])
            else:
                found.append(np.cumsum(got(payload, [n])[0]).astype(np.int64))
        out: list[tuple] = []
        if found:
            a, b, counts = docs
            at = np.sort(np.concatenate(found))
            ends = np.cumsum(counts.astype(np.int64))
            doc = np.searchsorted(ends, at, side="right")
            start = at - (ends - counts.astype(np.int64))[doc]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + width)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(at)] - 1
            for d in np.unique(doc[first]):
                own = doc[first] == d if len(first) < 2 else slice(*np.searchsorted(doc[first], [d, d + 1]))
                out.append((int(a[d].view(np.int64)), int(b[d].view(np.int64)), start[first][own].tolist(), (start[last][own] + width).tolist()))
        cells = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("k1", "k2", "starts", "ends"), cells, kinds, strict=True)})

    return run


def keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last three columns are text (bytes), starts and ends; those before them pass."""
    for batch in batches:
        for part in steps(batch, "text", most=1 << 20):
            more = part.num_columns - 3
            kept, total, gone, spans = [], [], [], []
            for text, starts, ends in zip(*(c.to_pylist() for c in part.columns[more:]), strict=True):
                words = (text or b"").split()
                total.append(len(words))
                pairs = list(zip(starts or [], ends or [], strict=True))
                gone.append(sum(e - s for s, e in pairs))
                spans.append([{"start": s, "end": e} for s, e in pairs])
                for s, e in reversed(pairs):
                    del words[s:e]
                kept.append(b" ".join(words))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            cells = [pa.array(v, k) for v, k in zip((kept, total, gone, spans), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:more], *cells], [*part.schema.names[:more], "kept", "n_words", "n_removed", "spans"])


def remove_repeats(docs: DataFrame, *, width: int = 35, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, kept (the words left, joined by one space), n_words, n_removed and spans (removed word intervals, end
    exclusive, maximal) of each row.

    Words are runs without ASCII white space, unchanged. A word goes if a window of `width` words covers it whose word
    sequence also starts anywhere else in the table, in the same document too; all windows are judged on the input. Null
    or empty texts have no words; shorter texts have no windows. Repeated rows repeat each other's windows. An empty
    table gives an empty one. `keep`: columns of the input to return in front instead of doc_id.
    """
    names = ["doc_id"] if keep is None else keep
    front = [F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(names)] if keep is not None else [F.col(f"`{id_col}`").cast("long").alias("c0")]
    plain = text_rows(docs, id_col, text_col)
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = (max(FEWEST, -(-size // BUCKET_BYTES)) - 1).bit_length()
    i, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(*front, F.coalesce(i, F.lit(-1)).alias("k1"), F.xxhash64(i, text).alias("k2"), text.cast("binary").alias("text"))  # equal rows share a key, and their intervals are equal
    found = rows.select("k1", "k2", "text").mapInArrow(windows_out(width, bits, second_bits(size)), MOVED).groupBy("bucket").applyInArrow(repeated, MOVED)
    spans = found.groupBy("block").applyInArrow(spans_of(width), "k1 long, k2 long, starts array<long>, ends array<long>")
    spans = spans.groupBy("k1", "k2").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"))
    joined = rows.join(spans, ["k1", "k2"], "left").drop("k1", "k2")
    head = joined.drop("text", "starts", "ends")
    out = joined.mapInArrow(keep_words, T.StructType([*head.schema.fields, *KEPT.fields]))
    return out.select(*[F.col(f"c{j}").alias(c) for j, c in enumerate(names)], F.col("kept").cast("string").alias("kept"), *KEPT.names[1:])
