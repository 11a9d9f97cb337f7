"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods.

Each language has smoothed character-trigram likelihoods. A document's words are drawn from an unknown mixture of the
languages; EM estimates the proportions. The set of languages starts at the likeliest one and grows by the language that
raises the likelihood most, as long as the gain exceeds the penalty for one more parameter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Bounded, steps, text_rows, written

RUNS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Trigrams that each language may keep, however many languages share `max_grams`.
LEAST_GRAMS = 300


def words_of(text: str | None) -> list[str]:
    """The runs of letters, in lower case. Number signs that are no digits (superscripts, fractions) aren't letters."""
    found = RUNS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def grams(word: str) -> list[str]:
    edged = f" {word} "
    return [edged[i : i + 3] for i in range(len(edged) - 2)]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of (lang, text) rows, summed over a partition as far as memory allows."""
    words: dict[str, Counter] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        cells: list[tuple[str, str, int]] = []
        for lang, seen in words.items():
            total: Counter = Counter()
            for w, n in seen.items():
                for g in grams(w):
                    total[g] += n
            cells += [(lang, g, n) for g, n in total.items()]
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "gram", "n"])

    for batch in batches:
        for part in steps(batch):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            held = sum(map(len, words.values()))
            if held > 400_000:
                yield flush()
    if any(words.values()):
        yield flush()


class Model:
    """Log-likelihoods of trigrams by language; a row more stands for trigrams that training didn't keep. `totals`: a
    language's count of all its trigrams, kept or not."""

    def __init__(self, rows: list[tuple[str, str, int]], smoothing: float, totals: dict[str, int] | None = None):
        self.langs = sorted({r[0] for r in rows})
        self.row = {g: i for i, g in enumerate(sorted({r[1] for r in rows}))}
        n = np.zeros((len(self.row) + 1, len(self.langs)))
        at = {x: i for i, x in enumerate(self.langs)}
        for lang, gram, count in rows:
            n[self.row[gram], at[lang]] = count
        total = np.array([totals[x] for x in self.langs], float) if totals else n.sum(axis=0)
        self.log = np.log((n + smoothing) / (total + smoothing * len(n))) if self.langs else n


def fit(train: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", docs_per_language: int = 10_000, max_grams: int = 60_000, max_languages: int = 1000, smoothing: float = 0.5) -> Model:
    """Learn from labelled rows. Each language gives about `docs_per_language` documents, picked by a hash of the id;
    its most frequent trigrams reach the driver, at most an even share of `max_grams` or LEAST_GRAMS if that is more, and
    so do all its trigrams' total, by which it is normalised. The bounds hold at every size, and no language is crowded
    out by others."""
    rows = train.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("doc_id"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages are labelled")
    if not sizes:
        return Model([], smoothing)
    share = F.create_map([x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1 << 20, -(-docs_per_language << 20) // r["count"])))])
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")])
    found = rows.select("lang", "text").mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = written(found, "grams")
    totals = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    each = max(LEAST_GRAMS, max_grams // max(1, len(totals)))
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= each).collect()
    return Model([(r["lang"], r["gram"], r["n"]) for r in top], smoothing, totals)


def mixture(log: np.ndarray, penalty: float, rounds: int = 30) -> dict[int, float]:
    """The proportions of the chosen languages, from the words' log-likelihoods (a row a word, a column a language)."""
    n, langs = log.shape
    chosen = [int(np.argmax(log.sum(axis=0)))]
    share, now = np.ones(1), log[:, chosen[0]]
    cost = penalty * np.log(max(n, 2))
    while len(chosen) < langs:
        best = None
        for m in range(langs):
            if m in chosen:
                continue
            over = log[:, m] - now
            # no share of m can gain more than this, and a small one gains only if the mean ratio is above one
            if np.maximum(over, 0).sum() <= cost or np.exp(np.minimum(over, 50)).mean() <= 1:
                continue
            own = log[:, [*chosen, m]]
            peak = own.max(axis=1)
            p = np.exp(own - peak[:, None])
            pi = np.r_[share * 0.9, 0.1]
            for _ in range(rounds):
                r = p * pi
                new = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
                moved, pi = np.abs(new - pi).max(), new
                if moved < 1e-4:
                    break
            then = np.log(p @ pi) + peak
            gain = float(then.sum() - now.sum())
            if best is None or gain > best[0]:
                best = gain, m, pi, then
        if best is None or best[0] <= cost:
            break
        chosen, share, now = [*chosen, best[1]], best[2], best[3]
    return dict(zip(chosen, share.tolist(), strict=True))


class Scorer:
    def __init__(self, model: Model, penalty: float, cache: int = 300_000):
        self.model, self.penalty, self.at = model, penalty, Bounded(cache)
        self.table = np.zeros((cache + 1, len(model.langs)))

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The words' log-likelihoods."""
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            if len(self.at) + len(new) > self.at.most:
                self.at.clear()
                new = list(dict.fromkeys(words))
            if len(new) > self.at.most:  # one text with more distinct words than the cache holds
                half = len(words) // 2
                return np.concatenate([self.rows_of(words[:half]), self.rows_of(words[half:])])
            get, other = self.model.row.get, len(self.model.row)
            own = [grams(w) for w in new]
            flat = np.fromiter((get(g, other) for gs in own for g in gs), np.int64)
            sums = np.add.reduceat(self.model.log[flat], np.r_[0, np.cumsum([len(g) for g in own])[:-1]], axis=0)
            start = len(self.at)
            self.table[start : start + len(new)] = sums
            self.at.update(zip(new, range(start, start + len(new)), strict=True))
        return self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]

    def of(self, text: str | None) -> tuple[str, float, str]:
        words = words_of(text)
        if not words or not self.model.langs:
            return UNDETERMINED, 0.0, ""
        found = sorted(((s, self.model.langs[m]) for m, s in mixture(self.rows_of(words), self.penalty).items()), key=lambda x: (-x[0], x[1]))
        return found[0][1], min(1.0, found[0][0]), ",".join(f"{lang}:{s:.4f}" for s, lang in found)


def predict(docs: DataFrame, model: Model, *, penalty: float = 2.0, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score (the largest proportion) and mixture ("en:0.9000,fr:0.1000") of each row's whole text.

    A text that is null, empty or without letters is `und` with score 0; so is every text if nothing was learned. Ties
    go to the language first in order. Null or repeated ids and repeated rows give a row each; an empty table gives an
    empty one. `keep`: columns of the input to return in front instead of doc_id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded number of rows a language
    names = ["doc_id"] if keep is None else keep
    front = [F.col(f"`{id_col}`").cast("long").alias("c0")] if keep is None else [F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(names)]
    rows = docs.select(*front, F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, penalty)
        for batch in batches:
            for part in steps(batch):
                langs, scores, mixed = zip(*map(scorer.of, part.column(part.num_columns - 1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs), pa.array(scores, pa.float64()), pa.array(mixed)], [*part.schema.names[:-1], "lang_pred", "score", "mixture"])

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1]]).add("lang_pred", "string").add("score", "double").add("mixture", "string"))
    return out.select(*[F.col(f"c{j}").alias(c) for j, c in enumerate(names)], "lang_pred", "score", "mixture")


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents from which nothing is learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
