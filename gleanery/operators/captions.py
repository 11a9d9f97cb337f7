"""Tables in plain text that follow their caption.

Each line gets one letter that says what it looks like, and one pattern over the string of letters finds the tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

# What starts a caption, another float or a section; what makes a row; how long the parts may be.
CAPTION = re.compile(r"^(?:TABLE|Table)\s+\d+[:.]")
FLOAT = re.compile(r"^(?:TABLE|Table|Fig\.|Figure|FIGURE)\s+\d+")
SECTION = re.compile(r"^\d+(?:\.\d+)*\s+[A-Z][a-z]")
CITED = re.compile(r"^\S+(?:\s+\S+){0,2}\s+\[\d+(?:[,–—-]\s?\d+)*\](?!\S)")
ENDS = re.compile(r"[.!?]\s*$")
ROW_MARK = re.compile(r"[\d+=×−→✓]")
MARKS = ".,;:()[]{}\"'“”‘’"
CAPTION_LINES, HEADER_LINES, LEAST_ROWS, MOST_ROWS, CONTEXT_CHARS = 12, 9, 2, 120, 240
LONG_LINE, LONG_SHARE, SHORT_SHARE = 5, 0.5, 0.3
SPANS = "document_id string, start int, end int, context string"

# What a line looks like, as bits of its letter.
BLANK, OPENS, FLOATS, HEADS, PROSE, CLOSES, MARKED = (1 << k for k in range(7))
LETTERS = [chr(0x4E00 + bits) for bits in range(1 << 7)]


def letter(line: str) -> str:
    """PROSE: mostly lower-case words, unless a cited name makes it a row; CLOSES: prose, or the short end of a sentence."""
    text, words = line.strip(), line.split()
    if not words:
        return LETTERS[BLANK]
    low = sum(w.islower() and w.isalpha() for w in (x.strip(MARKS) for x in words)) / len(words)
    ended = ENDS.search(text) is not None
    prose = not CITED.match(text) and (low >= LONG_SHARE if len(words) >= LONG_LINE else ended and low >= SHORT_SHARE)
    signs = (OPENS, CAPTION.match(line)), (FLOATS, FLOAT.match(text)), (HEADS, SECTION.match(text)), (PROSE, prose), (CLOSES, prose or (ended and len(words) < LONG_LINE)), (MARKED, ROW_MARK.search(line))
    return LETTERS[sum(bit for bit, holds in signs if holds)]


def lines(has: int = 0, lacks: int = 0) -> str:
    """The class of letters with all bits of `has` and none of `lacks`."""
    return "[" + "".join(c for bits, c in enumerate(LETTERS) if bits & has == has and not bits & lacks) + "]"


#: The caption is as short as a header and rows allow; the header and the rows run as far as they can.
TABLE = re.compile(
    f"(?P<caption>{lines(OPENS)}{lines(lacks=BLANK)}{{0,{CAPTION_LINES - 2}}}?)"
    f"(?P<header>{lines(lacks=BLANK | CLOSES)}{lines(lacks=BLANK | PROSE | MARKED | FLOATS)}{{0,{HEADER_LINES - 1}}}+)"
    f"(?P<rows>{lines(lacks=BLANK | FLOATS | HEADS | PROSE)}{{{LEAST_ROWS},{MOST_ROWS}}}+)"
)


def caption_tables(text: str) -> list[dict]:
    rows = text.split("\n")
    starts = [0, *accumulate(len(r) + 1 for r in rows)]
    out = []
    for m in TABLE.finditer("".join(map(letter, rows))):
        caption, header = (" ".join(" ".join(rows[slice(*m.span(part))]).split()) if part == "caption" else " ".join(r.strip() for r in rows[slice(*m.span(part))]) for part in ("caption", "header"))
        if len(caption) > CONTEXT_CHARS:
            caption = re.match(f".{{1,{CONTEXT_CHARS - 1}}}(?= )|.{{{CONTEXT_CHARS}}}", caption)[0]
        first, last = m.span("rows")
        out.append({"start": starts[first], "end": starts[last] - 1, "context": f"{caption}\n{header}"})
    return out


def find_caption_tables(documents: DataFrame) -> DataFrame:
    """document_id, start, end (of the rows) and context of each caption-first table of (document_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"document_id": d, **t} for d, text in zip(pdf.document_id, pdf.text, strict=True) for t in caption_tables(text or "")]
            yield pd.DataFrame(rows, columns=["document_id", "start", "end", "context"], dtype=object)

    return documents.select("document_id", "text").mapInPandas(run, SPANS)
