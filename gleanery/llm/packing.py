"""Vector bin packing of tokenised examples into fixed-length training sequences.

Each example demands a vector: tokens, one segment, loss-bearing tokens. Bins have a capacity in each. The bin being
filled takes, from a window of waiting examples, the fitting one with the largest dot product of its demand with what is
left in the bin (all scaled by the capacities). When none fits whole, the best one is cut. A bin that can't be filled
(end of the partition, segment or loss limit reached) is split into sequences whose lengths are powers of two, which
need no padding. Packing runs inside each partition of the scan, so no text is shuffled and memory is one window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ragged, steps, text_rows

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: A run that is one Latin word and then ASCII punctuation without the apostrophe: two pre-tokens at most, and case is all
#: that the normaliser changes.
PLAIN = r"^(?P<word>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<rest>[!-&(-/:-@\[-`{-~]*)$"


class WordEncoder:
    """Token ids of texts by a lower-casing tokenizer that drops white space and never merges across it.

    A step's texts are cut at ASCII white space; its distinct runs are split into a lower-cased word and its punctuation
    where that is all they are. Each of these keys is encoded once and kept, and arrays of places put the texts together
    again. Keys of one pre-token are encoded many at a time, as each one's last token carries the end-of-word mark.
    """

    def __init__(self, tokenizer_file: str, keys: int):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer_file)
        one, two = (self.model.encode(x, add_special_tokens=False).ids for x in ("D\xe9j\xe0, B?", "d\xe9j\xe0\n , b  ?"))
        if one != two:
            raise ValueError("only tokenizers that drop case and white space are supported")
        mark = getattr(self.model.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        if mark:
            self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith(mark)]] = True
        self.marked, self.most = bool(mark), keys
        self.forget()

    def forget(self) -> None:
        self.keys, self.sizes, self.ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def each(self, keys: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(keys, add_special_tokens=False)]

    def learn(self, single: list[str], other: list[str]) -> None:
        """Encode new keys: those of one pre-token a hundred to a call, and others."""
        sizes, ids = [], []
        for lo in range(0, len(single), 100):
            part = single[lo : lo + 100]
            found = self.each([" ".join(part)])[0]
            ends = np.flatnonzero(self.ends[found]) + 1
            if len(ends) == len(part):
                sizes.append(np.diff(ends, prepend=0))
                ids.append(found)
            else:
                apart = self.each(part)
                sizes.append([len(x) for x in apart])
                ids += apart
        apart = self.each(other)
        sizes.append([len(x) for x in apart])
        self.keys = pa.concat_arrays([self.keys, pa.array(single, pa.string()), pa.array(other, pa.string())])
        self.sizes, self.ids = np.concatenate([self.sizes, *sizes]).astype(np.int64), np.concatenate([self.ids, *ids, *apart])

    def places(self, single: pa.Array, other: pa.Array) -> list[np.ndarray]:
        """Where in `keys` these are; new ones are learned first."""

        def unknown() -> list[pa.Array]:
            return [pc.unique(x.filter(pc.is_null(pc.index_in(x, value_set=self.keys)))) for x in (single, other)]

        new = unknown()
        if any(map(len, new)):
            if len(self.keys) + sum(map(len, new)) > self.most:
                self.forget()
                new = unknown()
            self.learn(*(x.to_pylist() for x in new))
        return [pc.index_in(x, value_set=self.keys).to_numpy(zero_copy_only=False) for x in (single, other)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text ends."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = cut.flatten().dictionary_encode()
        runs, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        found = pc.extract_regex(runs, PLAIN) if self.marked else pa.nulls(len(runs), pa.struct([("word", pa.string()), ("rest", pa.string())]))
        word, rest = pc.utf8_lower(pc.struct_field(found, "word")), pc.struct_field(found, "rest")
        plain, ends = pc.is_valid(found), pc.fill_null(pc.not_equal(rest, ""), False)
        own, tail = (x.to_numpy(zero_copy_only=False) for x in (plain, ends))
        single, other = self.places(pa.concat_arrays([word.filter(plain), rest.filter(ends)]), runs.filter(pc.invert(plain)))
        # each run is at most two keys; the place after the last key stands for none
        pair = np.full((len(runs), 2), len(self.keys), np.int64)
        pair[own, 0], pair[~own, 0], pair[tail, 1] = single[: int(own.sum())], other, single[int(own.sum()) :]
        sizes = np.r_[self.sizes, 0]
        of_key = sizes[pair.ravel()]
        flat = ragged(self.ids, (np.cumsum(sizes) - sizes)[pair.ravel()], of_key)
        of_run = of_key.reshape(-1, 2).sum(axis=1)
        size = of_run[code]
        ends_at = np.r_[0, np.cumsum(size)][np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]
        return ragged(flat, (np.cumsum(of_run) - of_run)[code], size), ends_at


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str, keys: int) -> WordEncoder:
    return WordEncoder(tokenizer_file, keys)


class Packer:
    """Places items (any key, token count, loss count) into bins; yields (key, start, length, sequence, offset, loss)."""

    def __init__(self, first_sequence: int, capacity: int, segments: int, loss: int, window: int):
        self.ids, self.window = count(first_sequence), window
        self.limit = np.array([capacity, segments, loss], np.int64)
        self.key: list = []
        self.start, self.total, self.lossy = [], [], []  # of what waits: the next token, all tokens, loss-bearing tokens

    def add(self, key, tokens: int, lossy: int) -> Iterator[tuple]:
        if tokens <= 0:
            return
        self.key.append(key)
        self.start.append(0)
        self.total.append(tokens)
        self.lossy.append(min(max(0, lossy), tokens))
        if len(self.key) >= self.window:
            yield from self.fill(False)

    def end(self) -> Iterator[tuple]:
        while self.key:
            yield from self.fill(True)

    def loss_of(self, start, length, total, lossy):
        """Loss-bearing tokens stand at an example's end: those within [start, start + length)."""
        return np.minimum(length, np.maximum(0, start + length - (total - lossy)))

    def fill(self, last: bool) -> Iterator[tuple]:
        """Fill bins until half the window is left, or all of it at the end."""
        start, total, lossy = (np.array(x, np.int64) for x in (self.start, self.total, self.lossy))
        size = total - start  # what waits of each item; 0 once it is placed
        loss = self.loss_of(start, size, total, lossy)
        waiting, goal = len(start), 0 if last else len(start) // 2
        limit, left = self.limit.tolist(), self.limit.tolist()
        held: list[tuple] = []
        while waiting and (waiting > goal or held):
            a, b = left[0] / limit[0] ** 2, left[2] / limit[2] ** 2
            score = size * a + loss * b + left[1] / limit[1] ** 2
            fits = (size <= left[0]) & (loss <= left[2]) & (size > 0)
            i = int(np.argmax(np.where(fits, score, -1.0)))
            if fits[i]:
                take = int(size[i])
            else:  # none fits whole: the best is cut
                i = int(np.argmax(np.where(size > 0, score, -1.0)))
                lead = max(0, int(total[i] - lossy[i] - start[i]))  # tokens before its loss-bearing ones
                take = min(int(size[i]), left[0], lead + left[2])
            if take > 0:
                bears = int(self.loss_of(start[i], take, total[i], lossy[i]))
                held.append((i, int(start[i]), take, bears))
                left = [left[0] - take, left[1] - 1, left[2] - bears]
                start[i] += take
                size[i] -= take
                loss[i] -= bears
                waiting -= not size[i]
            if take <= 0 or not all(left):
                yield from self.close(held, total, lossy)
                held, left = [], self.limit.tolist()
        if held:
            yield from self.close(held, total, lossy)
        rest = np.flatnonzero(size)
        self.key = [self.key[i] for i in rest]
        self.start, self.total, self.lossy = start[rest].tolist(), total[rest].tolist(), lossy[rest].tolist()

    def close(self, held: list[tuple], total, lossy) -> Iterator[tuple]:
        n = sum(x[2] for x in held)
        room = int(self.limit[0]) if n == self.limit[0] else 1 << (n.bit_length() - 1)
        sequence, at = next(self.ids), 0
        for i, start, length, _ in held:
            while length:
                if at == room:
                    n -= room
                    room, sequence, at = 1 << (n.bit_length() - 1), next(self.ids), 0
                take = min(length, room - at)
                yield self.key[i], start, take, sequence, at, int(self.loss_of(start, take, total[i], lossy[i]))
                start, length, at = start + take, length - take, at + take


def pack_documents(
    docs: DataFrame, tokenizer_file: str, *, end_id: int = 2, capacity: int = 4096, max_segments: int = 256, max_loss: int | None = None, window: int = 256, cached_keys: int = 400_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents, packed: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, loss_tokens.

    A document is its text's ids and then `end_id`; a null or empty text is that one id. All its tokens bear loss. Each
    id lies in exactly one piece; sequences hold at most `capacity` tokens, `max_segments` pieces and `max_loss`
    loss-bearing tokens; those that aren't full have a power of two as length. Null and repeated ids, ties and repeated
    rows are packed like any others; an empty table gives no pieces; further columns are not carried. A sequence's id
    holds the partition's number, so it is the same when a lost task runs again. `cached_keys` bounds the words whose
    encodings each worker keeps, about 40 bytes each.
    """
    max_loss = capacity if max_loss is None else max_loss
    if min(capacity, max_segments, max_loss, window) < 1 or capacity & (capacity - 1):
        raise ValueError("limits must be positive, and the capacity a power of two")
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, packer = encoder(tokenizer_file, cached_keys), Packer(TaskContext.get().partitionId() << 36, capacity, max_segments, max_loss, window)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cells = list(zip(*[(d, s, n, ids[4 * s : 4 * (s + n)], len(ids) // 4, q, o, b) for (d, ids), s, n, q, o, b in rows], strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for part in steps(batch, most=8 << 20):
                flat, ends = model.encode(part.column(1))
                raw = flat.astype("<u4").tobytes()
                for doc, a, b in zip(part.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    ids = raw[4 * a : 4 * b] + closing
                    rows.extend(packer.add((doc, ids), b - a + 1, b - a + 1))
                if rows:
                    yield flush()
        rows.extend(packer.end())
        if rows:
            yield flush()

    return text_rows(docs, id_col, text_col).mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, *, capacity: int, max_segments: int, max_loss: int, window: int = 256, id_col: str = "id", tokens_col: str = "n_tokens", loss_col: str = "n_loss") -> DataFrame:
    """The placement alone, for examples whose token and loss-bearing counts are known (instruction data): id, start,
    length, loss_tokens, sequence_id, offset. Null counts are zero; an example without tokens gets no piece."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, max_segments, max_loss, window)

        def out(found) -> Iterator[pa.RecordBatch]:
            if rows := list(found):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*[(k, s, n, b, q, o) for k, s, n, q, o, b in rows], strict=True)], ["id", "start", "length", "loss_tokens", "sequence_id", "offset"])

        for batch in batches:
            for key, n, lossy in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield from out(packer.add(key, n or 0, lossy or 0))
        yield from out(packer.end())

    cells = [F.col(f"`{c}`").cast("long").alias(a) for c, a in ((id_col, "id"), (tokens_col, "n"), (loss_col, "l"))]
    return examples.select(*cells).mapInArrow(run, "id long, start long, length long, loss_tokens long, sequence_id long, offset long")
