"""Byte-level BPE over a whole corpus by a global shuffle of its distinct pre-tokens.

1. Blocks of documents are exploded into pre-tokens with positions. A block's distinct pre-tokens leave it in one packed
   row for each hash bucket; their positions leave it in one packed row.
2. Shuffled and sorted by bucket, every distinct pre-token is encoded once, and each block gets the ids of its own back.
3. Shuffled by block, ids and positions meet, and the documents are put together again.

A frequent pre-token is one entry in a block's packed row, whatever its count, so no key is hot. Decoding joins the ids
with the token-byte table, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import Bounded, ragged, steps, text_rows

#: The white space of Unicode; a pre-token never runs from another character into white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
MOVED = "block long, bucket long, n long, payload binary"
#: Text bytes in a block.
BLOCK_BYTES = 8 << 20


def bucket_count(size: int) -> int:
    """Hash buckets for `size` bytes of text: 256 for a gigabyte, growing with the square root (about 80,000 for 100 TB), so
    that both a bucket's share of the words and a block's rows stay moderate; 64 at least."""
    return max(64, math.isqrt((size << 16) >> 30))


def token_bytes(ranks_file: str) -> dict[bytes, int]:
    with open(ranks_file, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def piece_encoding(ranks_file: str):
    """The library's encoder for strings that are one pre-token each."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=token_bytes(ranks_file), special_tokens={})


@lru_cache(maxsize=2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern), Bounded(150_000)


def pre_tokens(pattern: str, texts: list[str]) -> list[list[tuple[str, ...]]]:
    """For each text its runs (white space, then the rest), each as the tuple of its pre-tokens."""
    find, cache = splitter(pattern)
    runs = [RUNS.findall(t) for t in texts]
    new = {r for rs in runs for r in rs}
    cache.room(len(new))
    for r in new:
        if r not in cache:
            cache[r] = tuple(find.findall(r))
    return [list(map(cache.__getitem__, rs)) for rs in runs]


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of unsigned 32-bit values as byte planes, compressed: high bytes are mostly zero."""
    flat = [np.ascontiguousarray(a, "<u4") for a in arrays]
    planes = b"".join(a.view(np.uint8).reshape(-1, 4).T.tobytes() for a in flat)
    return np.array([len(a) for a in flat], "<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(blob: bytes, arrays: int) -> list[np.ndarray]:
    sizes = np.frombuffer(blob[: 4 * arrays], "<u4").astype(np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 * arrays :], max_output_size=int(sizes.sum()) * 4 + 1), np.uint8)
    cut = np.split(planes, np.cumsum(sizes * 4)[:-1])
    return [np.ascontiguousarray(c.reshape(4, -1).T).view("<u4").ravel() for c in cut]


def moved(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "bucket", "n", "payload"])


class Block:
    """Documents gathered until they hold enough text, then exploded."""

    def __init__(self):
        self.size, self.ids, self.tokens, self.lengths = 0, [], {}, []
        self.codes: list[np.ndarray] = []

    def add(self, ids: list, texts: list[str], pattern: str) -> None:
        number, held = self.tokens, []
        for runs in pre_tokens(pattern, texts):
            codes = [number.setdefault(t, len(number)) for run in runs for t in run]
            held.append(np.array(codes, np.uint32))
        self.codes += held
        self.lengths += map(len, held)
        self.ids += ids
        self.size += sum(map(len, texts))

    def rows(self, block: int, buckets: int) -> list[tuple]:
        """The block's documents and positions (under a negative number of its own), then its distinct pre-tokens by
        bucket."""
        words = [t.encode() for t in self.tokens]
        bucket = np.fromiter((xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        seen = np.bincount(codes, minlength=len(words))
        # positions name pre-tokens by falling frequency, then by first appearance: those seen once come last, in the order
        # of the text, so that one mark stands for all of them
        by_name = np.argsort(-seen, kind="stable")
        name = np.empty(len(words), np.int64)
        name[by_name] = np.arange(len(words))
        once = int((seen > 1).sum())
        order = by_name[np.argsort(bucket[by_name], kind="stable")]
        null = np.array([i is None for i in self.ids], np.uint32)
        ids = np.array([i or 0 for i in self.ids], np.int64).view(np.uint64)
        docs = [(ids & 0xFFFFFFFF).astype(np.uint32), (ids >> np.uint64(32)).astype(np.uint32), null, np.array(self.lengths, np.uint32)]
        out = [(block, -1 - block, len(self.ids), packed([*docs, bucket[by_name], np.minimum(name[codes], once)]))]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = [words[i] for i in order[cuts[b] : cuts[b + 1]]]
            sizes = packed([np.array([len(w) for w in own], np.uint32)])
            out.append((block, b, len(own), len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(own))))
        return out


def words_of(payload: bytes) -> list[bytes]:
    at = 4 + int.from_bytes(payload[:4], "little")
    (sizes,) = unpacked(payload[4:at], 1)
    ends = np.cumsum(sizes).tolist()
    flat = zstandard.ZstdDecompressor().decompress(payload[at:], max_output_size=(ends[-1] if ends else 0) + 1)
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def exploded(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, block = TaskContext.get().partitionId() << 32, 0, Block()
        for batch in batches:
            for part in steps(batch, most=1 << 20):
                block.add(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()], pattern)
                if block.size >= BLOCK_BYTES:
                    yield moved(block.rows(first + n, buckets))
                    block, n = Block(), n + 1
        if block.ids:
            yield moved(block.rows(first + n, buckets))

    return run


def encoded_once(ranks_file: str):
    """Rows come sorted by bucket; what is known of a bucket's words is dropped at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = piece_encoding(ranks_file).encode_ordinary
        known, of = Bounded(1_000_000), None
        for batch in batches:
            for i in range(batch.num_rows):
                block, bucket, n, payload = (batch.column(c)[i].as_py() for c in range(4))
                if bucket >= 0:
                    if bucket != of:
                        known.clear()
                        of = bucket
                    words = words_of(payload)
                    known.room(len(words))
                    for w in words:
                        if w not in known:
                            known[w] = np.array(one(w.decode()), "<u4").tobytes()
                    ids = [known[w] for w in words]
                    payload = packed([np.array([len(x) // 4 for x in ids], np.uint32), np.frombuffer(b"".join(ids), "<u4")])
                yield moved([(block, bucket, n, payload)])

    return run


def assembled(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", "n", "payload")), strict=True))
    docs = next((r for r in rows if r[0] < 0), None)
    if docs is None:
        raise ValueError("a block's positions are missing")
    low, high, null, lengths, bucket, codes = unpacked(docs[2], 6)
    parts = [unpacked(p, 2) for b, _, p in rows if b >= 0]
    sizes = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
    ids = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint32)])
    if len(sizes) != len(bucket):
        raise ValueError("a block's pre-tokens are missing")
    starts = np.cumsum(sizes) - sizes
    where = np.empty(len(bucket), np.int64)
    where[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
    last = codes.max(initial=0)  # the mark of those seen once, if there are any
    if last + np.count_nonzero(codes == last) == len(bucket):
        codes[codes == last] = np.arange(last, len(bucket))
    code = where[codes]
    flat = ragged(ids, starts[code], sizes[code])
    ends = np.r_[0, np.cumsum(sizes[code])][np.cumsum(lengths.astype(np.int64))]
    cuts = np.r_[0, ends]
    doc = (low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))).view(np.int64)
    raw = flat.astype("<u4").tobytes()
    return pa.table(
        {
            "doc_id": pa.array([None if z else int(d) for d, z in zip(doc, null, strict=True)], pa.int64()),
            "n_tokens": pa.array(np.diff(cuts), pa.int64()),
            "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        }
    )


def encode(docs: DataFrame, ranks_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of each row's whole text, without special tokens.

    A null text counts as empty: no ids. Null or repeated ids and repeated rows give a row each; an empty table gives an
    empty one; further columns are not carried.
    """
    rows = text_rows(docs, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = bucket_count(size)
    out = rows.mapInArrow(exploded(pattern, buckets), MOVED)
    place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("block"), F.lit(buckets))).otherwise(F.col("bucket"))
    out = out.repartitionById(buckets, place.cast("int")).sortWithinPartitions("bucket").mapInArrow(encoded_once(ranks_file), MOVED)
    return out.groupBy("block").applyInArrow(assembled, "doc_id long, n_tokens long, ids binary")


@lru_cache(maxsize=2)
def byte_table(ranks_file: str) -> list[bytes]:
    by_rank = {r: t for t, r in token_bytes(ranks_file).items()}
    return [by_rank.get(i, b"") for i in range(max(by_rank, default=-1) + 1)]


def decode(encoded: DataFrame, ranks_file: str, *, ids_col: str = "ids") -> DataFrame:
    """`encoded` with the column decoded (bytes): each id's bytes from the token-byte table, in order; null stays null,
    and an id outside the table is an error. The table is read where the tasks run; its size is the vocabulary's."""
    names = [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(ranks_file).__getitem__
        for batch in batches:
            for part in steps(batch, ids_col):
                ids = part.column(part.schema.get_field_index(ids_col)).to_pylist()
                plain = [None if x is None else b"".join(map(table, np.frombuffer(x, "<u4").tolist())) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(plain, pa.binary())], names)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
