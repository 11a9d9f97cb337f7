"""Token counts of a BPE piece model by rank-synchronous merging of ragged numpy arrays.

A batch of pre-tokens is one flat array of symbols with sequence boundaries. In each round every sequence applies its
own lowest-ranked pair at the same time; sequences with no pair left drop out. What survives is counted, and symbols
that the model lacks count as their UTF-8 bytes. Very long sequences, such as texts without spaces, go one by one, in
rounds that cost what they change.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, steps, text_rows

SPACE = "▁"
NONE = np.int64(1) << 40
#: Longer pre-tokens are first cut between characters that stand together in no piece.
LONG = 256
#: Sequences of more symbols are merged by buckets of ranks, where a round costs what it changes.
RUN = 4096


class PieceCounter:
    """Counts the tokens of texts as the model's own library would, without begin or end tokens."""

    def __init__(self, model_file: str, cache: int = 600_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in usable}
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or sp.normalize("a  b") != f"{SPACE}a{SPACE}{SPACE}b":
            raise ValueError("only models whose pieces never run across a space, and that keep spaces, are counted here")
        self.ids = {p: i for i, p in enumerate(pieces)}
        for p in pieces:
            for c in p:
                self.ids.setdefault(c, len(self.ids))
        self.known = np.zeros(len(self.ids), bool)
        self.known[: len(pieces)] = True
        self.width = np.array([1 if k else len(p.encode()) for p, k in zip(self.ids, self.known, strict=True)], np.int64)
        order = {p: r for r, p in enumerate(sorted(pieces, key=lambda p: -pieces[p]))}
        n = self.n = len(self.ids)
        pairs = {self.ids[p[:k]] * n + self.ids[p[k:]]: (order[p], self.ids[p]) for p in pieces for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        #: Ranks after which a better pair may appear beside the new symbol: these are applied one at a time.
        best = np.full(n, NONE)
        np.minimum.at(best, self.keys // n, self.rank)
        np.minimum.at(best, self.keys % n, self.rank)
        self.single = np.zeros(len(pieces), bool)
        self.single[self.rank[best[self.made] < self.rank]] = True
        together = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.beside = np.array(sorted((ord(a) << 21) | ord(b) for a, b in together), np.int64)
        alone = "\n" if not any("\n" in p for p in pieces if len(p) > 1) else ""
        self.cut = re.compile(f"{alone}| +[^ {alone}]*|[^ {alone}]+" if alone else " +[^ ]*|[^ ]+")
        self.cache = Bounded(cache)

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        cut, cache = self.cut.findall, self.cache
        held = [cut(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = {w for ws in held for w in ws}
        cache.room(len(new))
        if new := [w for w in new if w not in cache]:
            for lo in range(0, len(new), 50_000):
                part = new[lo : lo + 50_000]
                cache.update(zip(part, self.merged([w.replace(" ", SPACE) for w in part]).tolist(), strict=True))
        get = cache.__getitem__
        return [sum(map(get, ws)) for ws in held]

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair of neighbours; NONE where they don't merge."""
        if not len(self.keys):
            return np.full(len(left), NONE), np.zeros(len(left), np.int64)
        key = np.where((left >= 0) & (right >= 0), left * self.n + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.made[at]

    def merged(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each word (a non-empty string, spaces already replaced)."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        chars, inverse = np.unique(codes, return_inverse=True)
        ids = np.array([self.ids.get(chr(c), -1) for c in chars.tolist()], np.int64)
        wide = np.array([1 if i >= 0 and self.known[i] else len(chr(c).encode()) for c, i in zip(chars.tolist(), ids.tolist(), strict=True)], np.int64)
        sym = ids[inverse]
        known = sym >= 0
        out = np.bincount(word[~known], wide[inverse][~known], len(words)).astype(np.int64)
        # no pair spans two words or a character that the model lacks: a new sequence starts there
        new = np.r_[True, (word[1:] != word[:-1]) | ~known[:-1]]
        if (lengths > LONG).any() and len(self.beside):
            pair = (codes[:-1] << 21) | codes[1:]
            at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
            new[1:] |= self.beside[at] != pair
        seq = np.cumsum(new) - 1
        word = word[new]  # from a sequence to its word
        sym, seq = sym[known], seq[known]
        size = np.bincount(seq, minlength=len(word))
        if (size > RUN).any():
            ends = np.cumsum(size)
            for q in np.flatnonzero(size > RUN).tolist():
                out[word[q]] += self.merged_run(sym[ends[q] - size[q] : ends[q]])
            short = size[seq] <= RUN
            sym, seq = sym[short], seq[short]
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self.look(sym[:-1], sym[1:])
            rank[:-1][seq[:-1] != seq[1:]] = NONE
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(seq)])
            over = low == NONE
            if over.any():
                done = np.repeat(over, size)
                out += np.bincount(word[seq[done]], self.width[sym[done]], len(words)).astype(np.int64)
                sym, seq, rank, made = sym[~done], seq[~done], rank[~done], made[~done]
                continue
            take = rank == np.repeat(low, size)
            at = np.flatnonzero(take)
            first = np.r_[True, np.diff(at) > 1]
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            one = self.single[rank[at]]
            if one.any():
                at = at[~one | np.r_[True, seq[at[1:]] != seq[at[:-1]]]]
            sym[at] = made[at]
            rank[at] = rank[at + 1]
            live = np.ones(len(sym), bool)
            live[at + 1] = False
            joins = np.zeros(len(sym), bool)
            joins[at] = True
            sym, seq, rank, made, joins = sym[live], seq[live], rank[live], made[live], joins[live]
            joins[:-1] |= joins[1:]
            i = np.flatnonzero(joins[:-1])
            r, m = self.look(sym[i], sym[i + 1])
            r[seq[i] != seq[i + 1]] = NONE
            rank[i], made[i] = r, m
            if len(rank):
                rank[-1] = NONE
        return out


    def merged_run(self, sym: np.ndarray) -> int:
        """The number of tokens of one long sequence. Its places are filed by the rank of the pair that begins there; a
        round takes the lowest rank and applies all its places at once, through links to the neighbours, so it never
        touches the rest. Places of ranks that go one at a time wait in a heap."""
        n = len(sym)
        sym, after, before = np.r_[sym, -1], np.arange(1, n + 2), np.arange(-1, n)
        rank, made, live = np.full(n + 1, NONE), np.zeros(n + 1, np.int64), np.arange(n + 1) < n
        filed: dict[int, list] = defaultdict(list)
        ranks: list[int] = []

        def file(at: np.ndarray) -> None:
            """Look the pairs at these places up, and file them."""
            rank[at], made[at] = self.look(sym[at], sym[after[at]])
            at = at[rank[at] != NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            own = rank[at]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for r, places in zip(own[starts].tolist(), np.split(at, starts[1:]), strict=True):
                if r not in filed:
                    heappush(ranks, r)
                held = filed[r]
                if not self.single[r]:
                    held.append(places)
                elif held:
                    for p in places.tolist():
                        heappush(held, p)
                else:
                    held.extend(places.tolist())
                    heapify(held)

        file(np.arange(n))
        while ranks:
            r = ranks[0]
            held = filed[r]
            if self.single[r]:
                while held and rank[held[0]] != r:
                    heappop(held)
                at = np.array([heappop(held)] if held else [], np.int64)
            else:
                at = np.unique(np.concatenate(held))
                at = at[rank[at] == r]
                held = []
                if len(at):
                    first = np.r_[True, at[1:] != after[at[:-1]]]
                    at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            if not held:
                heappop(ranks)
                del filed[r]
            if not len(at):
                continue
            gone = after[at]
            sym[at], rank[gone], live[gone] = made[at], NONE, False
            after[at] = after[gone]
            before[after[at]] = at
            file(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return int(self.width[sym[live]].sum())


@lru_cache(maxsize=2)
def counter(model_file: str) -> PieceCounter:
    """One counter for each worker process and model."""
    return PieceCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row's whole text; no shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Null or repeated ids and repeated rows give a row each; an empty
    table gives an empty one; further columns are not carried. A run of any length without a space is counted whole, in time
    that grows with its length times the logarithm (a million letters: some seconds). `model_file` must be readable on the executors.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_file)
        for batch in batches:
            for part in steps(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n_bytes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, pa.array(model.count_all(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return text_rows(docs, id_col, text_col).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")


def over_limit(counts: DataFrame, limit: int = 4096) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
