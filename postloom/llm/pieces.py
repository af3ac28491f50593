"""Splitting oversized texts at natural boundaries, with balanced targets.

The minimum number of pieces is computed, equal-length targets are placed, each is moved to the
strongest boundary near it, and a piece is added whenever a limit cannot be kept.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "array<struct<chunk_index:int,span_start:int,span_end:int>>"

# A boundary ends after its white space; strengths: paragraph 5, finished line 4, sentence 3,
# clause 2, any gap 1.
_BOUNDARY = re.compile(r"(\r?\n[ \t\r\f\v]*\n\s*)|(\r?\n[ \t\r\f\v]*)|([.!?…][\"')\]»”]*[ \t ]+)|([,;:)—–][ \t ]+)|(\s+)")
_ENDED = frozenset(".!?…:;\"')]»”>*=_-")


def _glued(text: str, i: int) -> bool:
    """True if a cut before position i would part what reads as one character."""
    c, b = text[i], text[i - 1]
    if b == "\r" and c == "\n":
        return True
    if c < "̀":
        return False
    o, p = ord(c), ord(b)
    if o == 0x200D or p == 0x200D or 0xFE00 <= o <= 0xFE0F or 0x1F3FB <= o <= 0x1F3FF or 0xE0020 <= o <= 0xE007F or unicodedata.combining(c):
        return True
    return 0x1F1E6 <= o <= 0x1F1FF and 0x1F1E6 <= p <= 0x1F1FF and sum(1 for k in range(i - 1, max(-1, i - 40), -1) if 0x1F1E6 <= ord(text[k]) <= 0x1F1FF) % 2 == 1


def _whole(text: str, i: int, lo: int) -> int:
    """The last position from lo+1 to i that parts no character (i itself if there is none)."""
    k = i
    while k > lo + 1 and k < len(text) and _glued(text, k):
        k -= 1
    return k if k > lo + 1 or not (k < len(text) and _glued(text, k)) else i


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions after the natural pauses of the text, and their strengths."""
    at, strength = [], []
    line = 0
    for m in _BOUNDARY.finditer(text):
        kind = m.lastindex
        if kind == 2:
            s = m.start()
            # a wrapped line is a gap; a line that ends a sentence, or a short one, is a pause
            finished = s > 0 and (text[s - 1] in _ENDED or s - line < 45)
            nxt = text[m.end() : m.end() + 1]
            force = 4 if finished or nxt in "-*•>|" else 1
            line = m.end()
        elif kind == 1:
            force, line = 5, m.end()
        else:
            force = (0, 0, 0, 3, 2, 1)[kind]
        if 0 < m.end() < len(text):
            at.append(m.end())
            strength.append(force)
    return at, strength


def _plan(text: str, at: list[int], strength: list[int], k: int, limit: int, overlap: int):
    """Spans of k pieces, each cut at the strongest pause near its target; None if a limit fails."""
    n = len(text)
    spans, start, cut_before = [], 0, 0
    reach = max(1, int(0.45 * n / k))
    for j in range(1, k):
        target = n * j // k
        lo = max(cut_before + 1, n - (k - j) * (limit - overlap))
        hi = min(start + limit, n - 1)
        if lo > hi:
            return None
        best, found = None, -1
        for a, b in ((max(lo, target - reach), min(hi, target + reach)), (lo, hi)):
            for i in range(bisect_left(at, a), bisect_right(at, b)):
                score = (strength[i], -abs(at[i] - target))
                if best is None or score > best:
                    best, found = score, at[i]
            if best:
                break
        if best is None:  # no pause anywhere in reach: between characters
            found = _whole(text, min(hi, max(lo, target)), max(cut_before, start))
            if found > start + limit or found <= cut_before:
                return None
        spans.append((start, found))
        start = _overlap_start(text, at, strength, found, overlap, start)
        cut_before = found
    if n - start > limit:
        return None
    spans.append((start, n))
    return spans


def _overlap_start(text: str, at: list[int], strength: list[int], cut_at: int, overlap: int, before: int) -> int:
    """Start of the next piece: up to ``overlap`` characters back, at the strongest pause there."""
    lo = max(cut_at - overlap, before + 1)
    best, found = None, None
    for i in range(bisect_left(at, lo), bisect_left(at, cut_at)):
        score = (min(strength[i], 3), -at[i])
        if best is None or score > best:
            best, found = score, at[i]
    if found is not None:
        return found
    k = lo
    while k < cut_at and _glued(text, k):
        k += 1
    return k


def split(text: str | None, limit: int = 1200, overlap: int = 120) -> list[tuple[int, int]]:
    """Spans of the pieces of a text; together they cover it, each is at most ``limit`` long.

    NULL and empty texts have no piece, a text within the limit is one piece. Consecutive pieces
    share up to ``overlap`` characters. ``overlap`` must be below half of ``limit``.
    """
    if not text:
        return []
    n = len(text)
    if n <= limit:
        return [(0, n)]
    at, strength = boundaries(text)
    k = -(-(n - overlap) // (limit - overlap))
    while True:
        got = _plan(text, at, strength, k, limit, overlap)
        if got:
            return got
        k += 1


def split_udf(limit: int = 1200, overlap: int = 120):
    """Arrow function text -> array of spans."""

    @F.pandas_udf(PIECES)
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"chunk_index": i, "span_start": a, "span_end": b} for i, (a, b) in enumerate(split(t, limit, overlap))] for t in texts], index=texts.index)

    return pieces.asNondeterministic()


def covers(messages: DataFrame, pieces: DataFrame, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """``(message_id, pieces, sound)`` of the pieces of each message, for checks.

    ``sound`` says that they are numbered from 0, that each keeps to the limit, and that the first
    begins and the last ends the body, with no gap between two and no overlap beyond ``overlap``.
    """
    body = messages.filter("body_text <> ''").groupBy("message_id").agg(F.max(F.length("body_text")).alias("n"))
    s = pieces.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "span_start", "span_end"))).alias("s"))
    near = F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s")), lambda a, b: (a["span_start"] < b["span_start"]) & (b["span_start"] <= a["span_end"]) & (a["span_end"] < b["span_end"]) & (a["span_end"] - b["span_start"] <= overlap) & (b["chunk_index"] == a["chunk_index"] + 1))
    whole = (F.get("s", F.lit(0))["chunk_index"] == 0) & (F.get("s", F.lit(0))["span_start"] == 0) & (F.element_at("s", -1)["span_end"] == F.col("n")) & F.forall("s", lambda x: (x["span_end"] - x["span_start"]).between(1, limit))
    return body.join(s, "message_id").select("message_id", F.size("s").alias("pieces"), (whole & F.forall(near, lambda x: x)).alias("sound"))


def message_pieces(messages: DataFrame, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """``(message_id, chunk_index, span_start, span_end)`` of all messages.

    Repeated rows of a message count once; NULL and empty bodies have no piece. Other columns are
    not read. Texts are cut where they are stored, before the pieces (a few integers each) are
    shuffled by message to drop repeated rows.
    """
    cutting = messages.select("message_id", split_udf(limit, overlap)("body_text").alias("p"))
    return cutting.select("message_id", F.inline("p")).distinct()
