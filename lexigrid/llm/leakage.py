"""Evaluation texts that stand, fully or partly, in training documents."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a passage that make a leak.
PASSAGE = 14
#: Words of a passage that may be wrong, missing or too many for it to be reported.
ERRORS = 1
#: Items that are sought in one pass over the documents; more are sought in further passes.
BLOCK = 20_000

_MARKS = re.compile(r"[^\w\s]+|_")
#: After decomposition: anything besides ASCII, combining marks, invisible characters, and general punctuation that is no blank.
_OTHER = re.compile("[^\x00-\x7f\u0300-\u036f\u200b-\u200f\u2010-\u2027\u2030-\u205e\u2060\ufeff\xad]")
_NOT_WORD = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c).isspace()))
# Letters whose bar or hook is no separate accent.
_BARRED = {"đ": "d", "ð": "d", "ɖ": "d", "ø": "o", "ł": "l", "ı": "i"}


def plain_words(text: str) -> list[str]:
    """Words stand between blanks; case, accents, punctuation, kinds of blanks and invisible or decorating characters do not matter."""
    s = text.lower()
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
        for a, b in _BARRED.items():
            if a in s:
                s = s.replace(a, b)
        if _OTHER.search(s):
            return _MARKS.sub("", s).split()
    # What is left beyond ASCII is dropped either way.
    return s.encode("ascii", "ignore").translate(None, _NOT_WORD).decode("ascii").split()


def tile_words(passage: int, errors: int) -> int:
    """The length of the pieces: so that every passage contains errors + 1 whole ones, wherever it begins."""
    return (passage + 1) // (errors + 2)


def myers(pattern: Sequence[str], text: Sequence[str]) -> int:
    """The least edit distance, in words, of pattern to any stretch of text: Myers' bit-parallel algorithm, a bit for a word of pattern."""
    m = len(pattern)
    at: dict[str, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for w in text:
        eq = at.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & high:
            score += 1
        if mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best = score
    return best


def _goes_on(q: list[str], w: list[str], c: int, e: int, a: int, b: int) -> bool:
    """If, past one word edit at either end of the equal run q[a:c], w[b:e], at least one more word is equal."""
    c1, e1, nq, nw = c + 1, e + 1, len(q), len(w)
    if e1 < nw and ((c1 < nq and q[c1] == w[e1]) or (c < nq and q[c] == w[e1])) or (c1 < nq and e < nw and q[c1] == w[e]):
        return True
    return (a > 1 and b > 1 and q[a - 2] == w[b - 2]) or (a > 1 and b > 0 and q[a - 2] == w[b - 1]) or (a > 0 and b > 1 and q[a - 1] == w[b - 2])


def _reach(q: list[str], w: list[str], c: int, e: int, errors: int, step: int) -> int:
    """The most words of q that go on from c, rightwards or leftwards, against w from e with so many word edits. There the words differ."""
    if not errors:
        return 0
    best, n, m = 0, len(q), len(w)
    for dc, de in ((1, 1), (1, 0), (0, 1)):
        x, y = c + dc * step, e + de * step
        if step < 0:
            x, y, done = max(x, 0), max(y, 0), dc
            while x > 0 and y > 0 and q[x - 1] == w[y - 1]:
                x, y, done = x - 1, y - 1, done + 1
        else:
            x, y, done = min(x, n), min(y, m), dc
            while x < n and y < m and q[x] == w[y]:
                x, y, done = x + 1, y + 1, done + 1
        if errors > 1:
            done += _reach(q, w, x, y, errors - 1, step)
        if done > best:
            best = done
    return best


class Items:
    """The pieces of a block of items, in an automaton, and the words to verify with."""

    def __init__(self, items: Sequence[tuple[int, str, str]], passage: int, errors: int):
        import ahocorasick

        self.passage, self.errors, self.tile = passage, errors, tile_words(passage, errors)
        self.words = [plain_words(text) for _, _, text in items]
        self.ids = [(i, f) for i, f, _ in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, w in enumerate(self.words):
            if len(w) >= passage:
                for p in range(0, len(w) - self.tile + 1, self.tile):
                    where.setdefault(" " + " ".join(w[p : p + self.tile]) + " ", []).append((n, p))
        self.automaton = ahocorasick.Automaton()
        for k, v in where.items():
            self.automaton.add_word(k, (k, v))
        self.automaton.make_automaton()
        self.empty = not where

    def search(self, text: str) -> dict[int, tuple[int, int]]:
        """For each item found: (fewest errors of a passage, longest run of equal words)."""
        if self.empty:
            return {}
        w = plain_words(text)
        if len(w) < self.passage - self.errors:
            return {}
        line = " " + " ".join(w) + " "
        hits = [(end - len(k) + 1, v) for end, (k, v) in self.automaton.iter(line)]
        if not hits:
            return {}
        starts, at = [], 0
        for x in w:
            starts.append(at)
            at += len(x) + 1
        found: dict[int, tuple[int, int]] = {}
        known: dict[tuple[int, int], int] = {}
        tile, errors, need, n_doc = self.tile, self.errors, self.passage, len(w)
        for begin, places in hits:
            i = bisect_right(starts, begin) - 1
            for n, p in places:
                if known.get((n, i - p), -1) > p:
                    continue  # inside a run that was looked at
                q = self.words[n]
                n_item = len(q)
                a, b = p, i
                while a and b and q[a - 1] == w[b - 1]:
                    a, b = a - 1, b - 1
                c, e = p + tile, i + tile
                while c < n_item and e < n_doc and q[c] == w[e]:
                    c, e = c + 1, e + 1
                known[n, i - p] = c
                run = c - a
                if run < need and (not errors or not (run + errors >= need or errors > 1 or _goes_on(q, w, c, e, a, b))):
                    continue
                old = found.get(n)
                # What can neither lower the errors nor raise the run isn't verified again.
                if old is not None and run <= old[1] and (old[0] == 0 or (old[0] == 1 and run < need)):
                    continue
                if run < need and run + max(_reach(q, w, a, b, k, -1) + _reach(q, w, c, e, errors - k, 1) for k in range(errors + 1)) < need:
                    continue
                least = self.verify(q, w, p, i)
                if least <= errors:
                    found[n] = (least, run) if old is None else (min(least, old[0]), max(run, old[1]))
        return found

    def verify(self, q: list[str], w: list[str], p: int, i: int) -> int:
        """The fewest errors of a passage of the item around its piece at p in the document around i."""
        k, size, tile = self.errors, self.passage, self.tile
        # A passage over the piece with at most k errors keeps all but k words right of it or left of it equal, shifted by at most k.
        best = size
        for s in range(max(0, p + tile - size), min(p, len(q) - size) + 1):
            lead = p - s
            near = w[max(0, i - lead - k) : i + size - lead + k]
            if len(near) < size - k:
                continue
            best = min(best, myers(q[s : s + size], near))
            if best == 0:
                break
        return best


def leaks(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, fields: Sequence[str], passage: int = PASSAGE, errors: int = ERRORS) -> DataFrame:
    """(doc_key, item_key, field_name, errors, longest_run): documents that hold a passage of so many words of an item's field, with at most
    so many word edits; longest_run is the longest run of equal words of such a passage.

    Item texts are cut into pieces so short that every passage contains errors + 1 whole ones; by the pigeonhole principle one of them stands
    in the document as it is. An Aho-Corasick automaton finds the pieces, Myers' algorithm verifies the passages around them. The items are
    the stated query set: they go to every task in blocks of BLOCK, the documents are read in place and never shuffled.
    Null and empty texts hold nothing; items of fewer words than a passage can't leak. Repeated rows count once.
    """
    kinds = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{doc_key}` {kinds[0]}, `{item_key}` {kinds[1]}, field_name string, errors int, longest_run int"
    spark = docs.sparkSession
    parts = None
    blocks = _blocks(items.select(item_key, *fields).distinct(), item_key)
    for block in blocks:
        rows = [(r[item_key], f, r[f]) for r in block for f in fields if r[f]]
        sent = spark.sparkContext.broadcast(rows)

        def work(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            it = Items(sent.value, passage, errors)
            for frame in frames:
                out = []
                for key, t in zip(frame["key"], frame["text"]):
                    if t:
                        out.extend((key, *it.ids[n], k, run) for n, (k, run) in it.search(t).items())
                yield pd.DataFrame(out, columns=[doc_key, item_key, "field_name", "errors", "longest_run"])

        one = docs.select(F.col(doc_key).alias("key"), F.col(text).alias("text")).filter("text is not null and key is not null").mapInPandas(work, schema)
        parts = one if parts is None else parts.union(one)
    if parts is None:
        return spark.createDataFrame([], schema)
    return parts.groupBy(doc_key, item_key, "field_name").agg(F.min("errors").alias("errors"), F.max("longest_run").alias("longest_run"))


def _blocks(items: DataFrame, key: str) -> Iterator[list]:
    """The items in blocks of at most BLOCK rows, by ascending key and, within one, by a hash of the row; one block is on the driver at a time."""
    rows = items.filter(F.col(key).isNotNull()).withColumn("_h", F.sha2(F.to_json(F.struct(*items.columns)), 256))
    last = None
    while True:
        rest = rows if last is None else rows.filter((F.col(key) > last[0]) | ((F.col(key) == last[0]) & (F.col("_h") > last[1])))
        block = rest.orderBy(key, "_h").limit(BLOCK).collect()
        if not block:
            return
        yield block
        if len(block) < BLOCK:
            return
        last = block[-1][key], block[-1]["_h"]
