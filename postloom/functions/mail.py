"""Line rules for bodies and chunk spans, in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FRAGMENTS = "array<struct<n:int,kind:string,span_start:int,span_end:int,text:string>>"
SPANS = "array<struct<chunk_index:int,span_start:int,span_end:int>>"
CHUNK_CHARS = 1200
# The lines that start a signature, introduce a quote and sign off.
_DASH = r"-- ?"
_WROTE = r"On [^\n]+ wrote:"
_BYE = r"(?:Best regards|Regards|Thanks|Kind regards|Best|Cheers),?"

_SP = r"[^\S\n]*"  # white space within a line
_END = r"(?=\n|\Z)"
_QUOTE = rf"(?:>[^\n]*|{_SP}{_WROTE}{_SP}){_END}"
_SIGNED = re.compile(rf"^{_DASH}\r?{_END}", re.M)
# the last sign-off of a text and at most four lines below it, short ones that quote nothing
_CLOSED = re.compile(rf"^{_SP}{_BYE}{_SP}(?:\n(?!>|{_SP}{_BYE}{_SP}{_END}){_SP}(?:\S(?:[^\n]{{0,78}}\S)?)?{_SP}){{0,4}}\s*\Z", re.M)
_RUN = re.compile(rf"^(?:(?P<quote>{_QUOTE}(?:\n(?:{_QUOTE}|{_SP}{_END}))*)|(?P<new>(?!{_QUOTE}){_SP}\S[^\n]*(?:\n(?!{_QUOTE})[^\n]*)*))", re.M)
_GAP = re.compile(r"\n[ \t]*\n+")
_CORE = re.compile(r"\S(?:[\s\S]*\S)?")


def fragments(body: str | None) -> list[tuple[int, str, int, int, str]]:
    """(n, kind, start, end, text) of the runs of new, quoted and signature lines of a body.

    A ``--`` line starts the signature; else a sign-off followed by at most four short lines at
    the end does. Lines starting with ``>`` and ``On ... wrote:`` are quotes; blank lines take the
    kind of the line before; runs of blanks only are left out.

    One pattern finds where the signature begins, another tiles what is above it with runs.
    """
    if not body or not body.strip():
        return []
    end = len(body) - body.endswith("\n")
    dash = _SIGNED.search(body)
    bound = dash.start() if dash else len(body)
    closed = _CLOSED.search(body[:bound])
    below = closed.start() if closed else bound if dash else end + 1
    above = body[: max(0, below - 1)]
    runs = [(m.lastgroup, m.start(), m.end()) for m in _RUN.finditer(above)]
    if closed or dash:
        runs.append(("signature", below, end))
    # blank lines at the top go with the first run
    runs[0] = (runs[0][0], 0, runs[0][2])
    out = []
    for n, (kind, a, b) in enumerate(runs):
        b -= body[a:b].endswith("\r")
        out.append((n, kind, a, b, body[a:b]))
    return out


def chunk_spans(text: str | None, most: int = CHUNK_CHARS) -> list[tuple[int, int]]:
    """Paragraph-aligned spans of at most ``most`` characters; short paragraphs are packed greedily.

    A longer paragraph is cut at the last blank before the limit, hard where there is none.
    """
    if not text:
        return []
    gaps = [m.span() for m in _GAP.finditer(text)]
    edges = zip([0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(text)])
    whole = [m.span() for a, b in edges if (m := _CORE.search(text, a, b))]
    return [span for long, some in groupby(whole, key=lambda p: p[1] - p[0] > most) for span in (_cut_up(text, some, most) if long else _filled(list(some), most))]


def _filled(paragraphs: list[tuple[int, int]], most: int) -> Iterator[tuple[int, int]]:
    """Each chunk reaches as far as the last paragraph that ends within the limit."""
    ends = [b for _, b in paragraphs]
    i = 0
    while i < len(ends):
        start = paragraphs[i][0]
        i = bisect_right(ends, start + most, i)
        yield start, ends[i - 1]


def _cut_up(text: str, paragraphs: Iterable[tuple[int, int]], most: int) -> Iterator[tuple[int, int]]:
    piece = re.compile(rf"\s*((?=\S)(?:[\s\S]{{1,{most}}}\Z|[\s\S]{{1,{most - 1}}}(?=[ \n\t])|[\s\S]{{1,{most}}}))")
    for a, b in paragraphs:
        for m in piece.finditer(text[a:b]):
            yield a + m.start(1), a + m.start(1) + len(m.group(1).rstrip())


def fragments_of(body: Column | str) -> Column:
    """Column of fragments."""

    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("n", "kind", "span_start", "span_end", "text"), f)) for f in fragments(b)] for b in bodies], index=bodies.index)

    return F.pandas_udf(run, FRAGMENTS).asNondeterministic()(body)


def chunk_spans_of(text: Column | str) -> Column:
    """Column of chunk spans."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"chunk_index": i, "span_start": a, "span_end": b} for i, (a, b) in enumerate(chunk_spans(t))] for t in texts], index=texts.index)

    return F.pandas_udf(run, SPANS).asNondeterministic()(text)
