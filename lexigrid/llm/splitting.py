"""Cutting oversized texts at natural boundaries, balanced, with an overlap."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

LIMIT, OVERLAP = 2000, 200

#: Where a piece may begin, from the strongest kind to the weakest: (strength, pattern whose end is the place).
BOUNDARIES = (
    (5, re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:(?:\r\n|\n|\r)[ \t]*)+|</(?:p|div|h\d|table|ul|ol)>\s*|<br\s*/?>\s*<br\s*/?>\s*", re.I)),  # paragraph
    (4, re.compile(r"(?:[\r\n]|<(?:p|br\s*/?)>|</p>)\s*(?=(?:khoản\s+)?\d{1,3}[.)]\s)", re.I)),  # khoản
    (3, re.compile(r"(?:[\r\n]|<(?:p|br\s*/?)>|</p>)\s*(?=(?:điểm\s+)?[a-zđ]{1,2}[).]\s)", re.I)),  # điểm
    (2, re.compile(r"[\r\n]+[ \t]*|<br\s*/?>\s*|</(?:li|tr)>\s*", re.I)),  # line
    (1, re.compile(r"[.!?…。;][\"'”’)\]]*(?:\s+|(?=<))")),  # sentence
    (0, re.compile(r"[^\S\r\n]+")),  # word
)


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places and their strengths, ascending; the start and the end of the text are none."""
    best: dict[int, int] = {}
    for strength, pattern in BOUNDARIES:
        for m in pattern.finditer(text):
            at = m.end()
            if 0 < at < len(text) and at not in best:
                best[at] = strength
    places = sorted(best)
    return places, [best[p] for p in places]


def _strongest(places: list[int], strengths: list[int], low: int, high: int, target: float, least: int) -> int | None:
    """The strongest place in [low, high], the nearest to target among equals; None when none is as strong as least."""
    found, key = None, None
    for i in range(bisect_left(places, low), bisect_right(places, high)):
        if strengths[i] >= least:
            k = (-strengths[i], abs(places[i] - target))
            if key is None or k < key:
                found, key = places[i], k
    return found


def _letter_edge(text: str, at: int) -> int:
    """at, moved back so as not to part a letter from its combining marks."""
    i = at
    while i > 1 and at - i < 30 and unicodedata.combining(text[i]):
        i -= 1
    return i


def split_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(begin, fresh, end) of each piece: text[begin:end], of which text[begin:fresh] repeats the piece before.

    The least number of pieces is computed, equally spaced targets are placed, and each is moved to the strongest boundary near it, or, when there
    is none near, to any sentence end or stronger boundary that keeps the piece in the limit, then to a blank, then stays. When a piece
    would pass the limit, one more piece is planned and all targets are placed anew.
    """
    if limit <= 2 * overlap or overlap < 0:
        raise ValueError("the limit must be more than twice the overlap")
    size = len(text)
    if size <= limit:
        return [(0, 0, size)]
    places, strengths = boundaries(text)
    n = max(2, -(-(size - overlap) // (limit - overlap)))
    while True:
        step = size / n
        out: list[tuple[int, int, int]] = []
        begin = fresh = 0
        for i in range(1, n):
            target = i * step
            most = begin + limit
            low, high = int(max(fresh + 1, target - step / 4)), int(min(most, target + step / 4))
            at = _strongest(places, strengths, low, high, target, 1)
            if at is None:
                at = _strongest(places, strengths, max(fresh + 1, fresh + int(step / 3)), most, target, 1)
            if at is None:
                at = _strongest(places, strengths, low, high, target, 0)
            if at is None:
                at = _letter_edge(text, max(fresh + 1, min(int(target), most)))
            at = max(at, fresh + 1)
            out.append((begin, fresh, at))
            back = at - overlap
            begin = (_strongest(places, strengths, max(back, begin + 1), at - 1, back, 1) or _strongest(places, strengths, max(back, begin + 1), at - 1, back, 0) or at) if overlap else at
            fresh = at
            if fresh >= size:
                break
        if fresh < size:
            out.append((begin, fresh, size))
        if all(e - b <= limit for b, _, e in out):
            return out
        n += 1


def pieces(df: DataFrame, keys: Sequence[str], fields: Sequence[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys..., field_name, n_pieces, piece_no, repeated, piece): each text of fields longer than limit, cut into pieces.

    Sizes are code points. Only the texts that are too long go to Python, which returns places; the pieces are cut in the JVM. Joining
    the pieces without their first `repeated` characters gives the text again. Null texts and those within the limit have no rows.
    Repeated rows give repeated pieces.
    """

    @pandas_udf("array<struct<begin:int,fresh:int,stop:int>>")
    def points(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"begin": a, "fresh": b, "stop": c} for a, b, c in split_points(x, limit, overlap)])

    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields]))
    too_long = None
    for f in fields:
        c = F.char_length(F.col(f)) > limit
        too_long = c if too_long is None else too_long | c
    long = df.filter(too_long).select(*keys, texts.alias("t")).select(*keys, "t.*").filter(F.char_length("text") > limit)
    at = long.withColumn("points", points("text"))
    one = at.select(*keys, "field_name", "text", F.size("points").alias("n_pieces"), F.posexplode("points").alias("piece_no", "p"))
    return one.select(
        *keys,
        "field_name",
        "n_pieces",
        "piece_no",
        (F.col("p.fresh") - F.col("p.begin")).alias("repeated"),
        F.substring(F.col("text"), F.col("p.begin") + 1, F.col("p.stop") - F.col("p.begin")).alias("piece"),
    )
