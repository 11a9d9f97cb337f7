"""Text functions as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that are no search terms (English, Marathi).
STOPWORDS = (
    "a an and are as at be but by for from has have how i if in into is it its of on or that the their then there these "
    "this to was were what when where which who will with "
    "च्या चा ची चे ला ने ना मध्ये आहे आहेत होते होता होती आणि या ही हे की ते तो ती काय किती कसे कसा कोण कोणी कधी कुठे साठी पण"
).split()
#: Letters and digits of any script, and the combining signs of Latin and Indic scripts.
TERM = r"[\p{L}\p{N}\x{0300}-\x{036f}\x{0900}-\x{0963}\x{0966}-\x{0dff}]+"
WORD = r"[\p{L}\p{N}_]+"
#: All decimal digits beyond ASCII, by the rule that Unicode gives each its value.
DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
DIGIT_VALUES = "".join(str(unicodedata.decimal(c)) for c in DIGITS)
#: Texts without these characters, from the first of them on, hold none.
OTHER_DIGITS = r"[^\x00-\x{65f}]"


#: All characters below are composed already, and compose with nothing among themselves.
COMPOSED = r"[^\x00-\x{2ff}]"


def composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Canonical composition; no built-in function does it. Only texts with characters from the combining signs on go to
    Python, in Arrow batches."""
    return F.coalesce(F.pandas_udf(composed, "string")(F.when(text.rlike(COMPOSED), text)), text)


def ascii_digits(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, "".join(DIGITS), DIGIT_VALUES)).otherwise(text)


def tokenize(text: Column, normalise: bool = True) -> Column:
    """Search terms in order: canonically composed (unless told that texts are), lower case, no function words, no single
    characters, digits folded to ASCII afterwards."""
    text = nfc(text) if normalise else text
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))
    return F.when(text.rlike(OTHER_DIGITS), F.transform(found, ascii_digits)).otherwise(found)


def mostly_latin(text: Column) -> Column:
    """At least half of the letters are Latin; true without letters."""
    latin, letters = (F.regexp_count(text, F.lit(p)) for p in (r"\p{IsLatin}", r"\p{L}"))
    return F.when(letters > 0, latin / letters >= 0.5).otherwise(F.lit(True))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, where it would otherwise be repeated for each element of an array."""
    return F.transform(F.array(value), body)[0]


def shingles(items: Column, width: int) -> Column:
    """The distinct runs of `width` items, joined by spaces; none if there are fewer."""

    def runs(w: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(F.size(w) >= width, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))

    return let(items, runs)


def lead_text(text: Column, most: int = 240) -> Column:
    """White space squashed; the opening of a longer text with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def clip_turn(text: Column, most: int = 4000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.lit("… "), F.right(text, F.lit(most)))).otherwise(text)


def citations(answer: Column) -> Column:
    """The distinct numbers cited as [n], in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int")))


def insert_labels(text: Column, labels: Column) -> Column:
    """Labels (array of struct<at: int, label: string>) inserted at UTF-8 byte offsets, the last first; offsets past the
    end count as the end."""
    raw = F.encode(text, "utf-8")

    def put(out: Column, x: Column) -> Column:
        at = F.least(x["at"], F.octet_length(out))
        return F.concat(F.substring(out, F.lit(1), at), F.encode(x["label"], "utf-8"), F.substring(out, at + 1, F.octet_length(out)))

    return F.decode(F.aggregate(F.reverse(F.array_sort(labels)), raw, put), "utf-8")
