"""Where documents are cut into chunks: cut points come from running lengths, for all paragraphs of a text at once."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, functions as F

from .common import or_empty

# What begins a definition or a section.
DEFINITION = re.compile(r"^(?:def |class |async def |function |fn |pub fn )", re.M)
HEADING = re.compile(r"^\\(?:section|subsection|subsubsection|paragraph)\{", re.M)
BLANK_LINES = r"\n{2,}"


def pack_ranges(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of paragraphs: each is as long as `size` allows, and the next one begins with the last paragraphs of it that
    `overlap` holds, and takes one paragraph whatever its length."""
    sums, ranges = [0, *accumulate(lengths)], []
    begin, taken, n = 0, 1, len(lengths)
    while n:
        end = bisect_right(sums, sums[begin] + size, min(taken + 1, n + 1)) - 1
        ranges.append((begin, end))
        if end == n:
            break
        begin, taken = bisect_left(sums, sums[end] - overlap, begin, end), end + 1
    return ranges


def packed(text: str, size: int, overlap: int, separator: str = BLANK_LINES) -> list[str]:
    paragraphs = re.split(separator, text)
    joined = ("\n\n".join(paragraphs[a:b]) for a, b in pack_ranges(list(map(len, paragraphs)), size, overlap))
    return [c for c in joined if c.strip()]


def stretches(text: str, bounds: list[tuple[int, int]], size: int, overlap: int, last_whole: bool) -> list[str]:
    """The stretches of a text between bounds, stripped; those over `size` packed, but for the last one if it stays whole."""
    out = []
    for k, (a, b) in enumerate(bounds):
        fits = b - a <= size or (last_whole and k == len(bounds) - 1)
        out += [text[a:b].strip()] if fits else packed(text[a:b], size, overlap)
    return [c for c in out if c.strip()]


def code_chunks(text: str, size: int, overlap: int) -> list[str]:
    places = [m.start() for m in DEFINITION.finditer(text)]
    if not places:
        return packed(text, size, overlap)
    ends = [*places[1:], len(text)]
    begins = accumulate((p - overlap for p in places[1:]), max, initial=0)
    return stretches(text, list(zip(begins, ends)), size, overlap, last_whole=True)


def latex_chunks(text: str, size: int, overlap: int) -> list[str]:
    places = [m.start() for m in HEADING.finditer(text)]
    if not places:
        return packed(text, size, overlap)
    whole = (text[a:b].strip() for a, b in pairwise([*places, len(text)]))
    return [c for s in whole for c in ([s] if len(s) <= size else packed(s, size, overlap)) if c.strip()]


def cutter(cut, *options) -> "Column":
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or "", *options))

    return run


def chunk_plain(text: Column, size: int = 1500, overlap: int = 200, separator: str = BLANK_LINES) -> Column:
    """Paragraphs packed in order; joins are not counted, a paragraph over `size` stays whole, blank chunks go."""
    return cutter(packed, size, overlap, separator)(or_empty(text))


def chunk_code(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """Code cut where definitions start; each cut reaches back by `overlap`, and the last one is never cut further."""
    return cutter(code_chunks, size, overlap)(or_empty(text))


def chunk_latex(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """Sections from one heading to the next, text before the first one dropped; long ones are packed by paragraphs, and so is text without headings."""
    return cutter(latex_chunks, size, overlap)(or_empty(text))


def chunk_document(text: Column, kind: Column, size: int = 1500, overlap: int = 200) -> Column:
    """One pass over the rows whatever their kind."""
    cuts = {"code": code_chunks, "latex": latex_chunks}

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([cuts.get(k, packed)(t or "", size, overlap) for t, k in zip(texts, kinds)], dtype=object)

    return run(or_empty(text), kind)
