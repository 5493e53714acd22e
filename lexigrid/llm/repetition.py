"""Repetition inside a document: lines are labelled by a linear-chain conditional random field, words are counted."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run that counts as said again.
RUN = 8
#: Share of repeated words from which a document is a case.
SHARE = 0.3
#: The most documents the field is fitted on: those with the least hash of their key.
TRAIN_DOCUMENTS = 600
#: Content share from which a document is retained: half of what may be repeated. Below it the words are counted.
RETAINED = 1 - SHARE / 2
#: Lengths of the runs of words the field sees, none of them that by which words count as said again.
SEEN_RUNS = (6, 3)
#: How much more a line that was said before and is taken for content costs in fitting than the reverse.
MISS_COST = 8.0
#: Words of a line where a text has no line breaks or sentence ends.
LINE_WORDS = 40

_LINE = re.compile(r"[\r\n\u0085  ]+|(?<=[.!?;…])\s+")
_MARKS = re.compile(r"[^\w\s]+|_")
_BUCKETS = 10
N_FEATURES = len(SEEN_RUNS) * _BUCKETS + 8 + 8


def words_of(text: str) -> list[str]:
    """Words stand between blanks; case and punctuation, also inside a word, do not matter; what is only punctuation is no word."""
    return _MARKS.sub("", text.lower()).split()


def lines_of(text: str) -> list[list[str]]:
    """The words of each line or sentence; longer ones are cut, so that a text without ends has lines too."""
    out = []
    for part in _LINE.split(text):
        w = words_of(part)
        out.extend(w[i : i + LINE_WORDS] for i in range(0, len(w), LINE_WORDS))
    return out


def repeated_words(codes: np.ndarray, owner: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each word, if it lies in a run of `run` words that occurred earlier in the same text.

    codes are the words as integers, one text after the other; owner the number of each word's text. Runs are compared by two
    independent 64-bit polynomial hashes over all texts of a batch at once.
    """
    n = len(codes)
    hit = np.zeros(n, dtype=bool)
    if n < run:
        return hit
    m = n - run + 1
    c = codes.astype(np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    g = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (c + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        for k in range(run):
            h = h * np.uint64(0x100000001B3) + mixed[k : k + m]
            g = g * np.uint64(0xD6E8FEB86659FD93) + c[k : k + m]
        h += owner[:m].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        h ^= g * np.uint64(0xFF51AFD7ED558CCD)
    inside = owner[:m] == owner[run - 1 :]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return hit
    order = starts[np.argsort(h[starts], kind="stable")]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (h[order[1:]] == h[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    again = order[same]
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    return np.cumsum(edge[:-1]) > 0


class Batch:
    """The words and lines of several texts, as arrays."""

    def __init__(self, texts: Sequence[str]):
        words: list[str] = []
        line_len, line_doc = [], []
        for d, t in enumerate(texts):
            for line in lines_of(t):
                words.extend(line)
                line_len.append(len(line))
                line_doc.append(d)
        self.n_docs = len(texts)
        self.codes = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, dtype=np.int64)
        self.line_len = np.array(line_len, dtype=np.int64)
        self.line_doc = np.array(line_doc, dtype=np.int64)
        self.line_of = np.repeat(np.arange(len(line_len)), self.line_len)
        self.owner = self.line_doc[self.line_of] if len(line_len) else np.zeros(0, dtype=np.int64)
        self.n_words = np.bincount(self.owner, minlength=self.n_docs) if len(self.owner) else np.zeros(self.n_docs, dtype=np.int64)

    def features(self) -> np.ndarray:
        """For each line the numbers of its active features: how much of it stood earlier by runs of SEEN_RUNS words, its length, and how often
        a line of the same words stood earlier."""
        n = len(self.line_len)
        out = []
        base = 0
        for run in SEEN_RUNS:
            again = np.bincount(self.line_of, weights=repeated_words(self.codes, self.owner, run), minlength=n) if n else np.zeros(0)
            share = again / np.maximum(self.line_len, 1)
            # Ten steps, the first for nothing at all, so that even one run of a long line is seen.
            out.append(base + np.where(again > 0, np.minimum(_BUCKETS - 1, 1 + (share * (_BUCKETS - 1)).astype(np.int64)), 0))
            base += _BUCKETS
        out.append(base + np.minimum(7, self.line_len // 6))
        out.append(base + 8 + np.minimum(7, self._copies()))
        return np.stack(out, axis=1) if n else np.zeros((0, len(SEEN_RUNS) + 2), dtype=np.int64)

    def _copies(self) -> np.ndarray:
        """For each line how many lines of the same words stand before it in its text."""
        n = len(self.line_len)
        if not n:
            return np.zeros(0, dtype=np.int64)
        starts = np.cumsum(self.line_len) - self.line_len
        place = np.arange(len(self.codes)) - np.repeat(starts, self.line_len)
        with np.errstate(over="ignore"):
            mixed = (self.codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * (np.uint64(2) * place.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            h = np.zeros(n, dtype=np.uint64)
            some = np.flatnonzero(self.line_len)
            if len(some):
                h[some] = np.add.reduceat(mixed, starts[some])
        return pd.DataFrame({"d": self.line_doc, "h": h}).groupby(["d", "h"], sort=False).cumcount().to_numpy()

    def repeated(self) -> np.ndarray:
        return repeated_words(self.codes, self.owner)


class Field:
    """A linear-chain conditional random field over lines: label 0 is content, 1 boilerplate (said before)."""

    def __init__(self, emit: np.ndarray | None = None, step: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, 2)) if emit is None else emit
        self.step = np.zeros((2, 2)) if step is None else step

    def fit(self, texts: Sequence[str], rounds: int = 120, rate: float = 0.5, ridge: float = 1e-3) -> Field:
        """Conditional likelihood by gradient ascent with forward-backward, over all documents at once.

        A line is labelled boilerplate when any of its words lies in a run of eight that occurred earlier.
        """
        b = Batch(texts)
        n = len(b.line_len)
        if not n:
            return self
        x = b.features()
        y = (np.bincount(b.line_of, weights=b.repeated(), minlength=n) > 0).astype(np.int64)
        first = np.r_[True, b.line_doc[1:] != b.line_doc[:-1]]
        last = np.r_[first[1:], True]
        place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        back = np.arange(n) + 0
        steps = [np.flatnonzero(place == k) for k in range(int(place.max()) + 1)]
        cost = np.where(y == 1, MISS_COST, 1.0)
        seen = np.zeros_like(self.emit)
        for j in range(x.shape[1]):
            np.add.at(seen, (x[:, j], y), cost)
        pair = np.zeros((2, 2))
        inner = np.flatnonzero(~first)
        np.add.at(pair, (y[inner - 1], y[inner]), 1)
        for r in range(rounds):
            e = self.emit[x].sum(axis=1)
            alpha = np.zeros((n, 2))
            for k, rows in enumerate(steps):
                alpha[rows] = e[rows] if k == 0 else e[rows] + _lse(alpha[rows - 1][:, :, None] + self.step[None], 1)
            beta = np.zeros((n, 2))
            for rows in reversed(steps):
                rows = rows[~last[rows]]
                if len(rows):
                    beta[rows] = _lse(self.step[None] + (e[rows + 1] + beta[rows + 1])[:, None, :], 2)
            total = _lse(alpha + beta, 1)
            node = np.exp(alpha + beta - total[:, None])
            edge = np.exp(alpha[inner - 1][:, :, None] + self.step[None] + (e[inner] + beta[inner])[:, None, :] - total[inner][:, None, None]).sum(axis=0)
            want = np.zeros_like(self.emit)
            for j in range(x.shape[1]):
                np.add.at(want, x[:, j], node * cost[:, None])
            # Each parameter moves by its own scale, so rare features learn as fast as common ones.
            self.emit += rate * ((seen - want) - ridge * self.emit) / (np.maximum(seen.sum(axis=1, keepdims=True), 1) ** 0.5) / (1 + r / 40)
            self.step += rate * (pair - edge) / max(len(inner), 1) ** 0.5 / (1 + r / 40) * 0.1
        return self

    def label(self, b: Batch) -> np.ndarray:
        """The most likely labels of each document's lines, by Viterbi over all documents of a batch at once."""
        n = len(b.line_len)
        if not n:
            return np.zeros(0, dtype=np.int64)
        e = self.emit[b.features()].sum(axis=1)
        first = np.r_[True, b.line_doc[1:] != b.line_doc[:-1]]
        place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(int(place.max()) + 2))
        score = e.copy()
        prev = np.zeros((n, 2), dtype=np.int64)
        for k in range(1, len(cuts) - 1):
            rows = order[cuts[k] : cuts[k + 1]]
            s = score[rows - 1][:, :, None] + self.step[None]
            prev[rows] = s.argmax(axis=1)
            score[rows] = e[rows] + s.max(axis=1)
        y = score.argmax(axis=1)
        for k in range(len(cuts) - 2, 0, -1):
            rows = order[cuts[k] : cuts[k + 1]]
            y[rows - 1] = prev[rows, y[rows]]
        return y


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)


def fit_field(docs: DataFrame, key: str, text: str, most: int = TRAIN_DOCUMENTS) -> Field:
    """The field, fitted on the texts of at most `most` documents: those with the least hash of their key, so the same in every run. The hashes are found from the
    keys alone; then the texts at or below the last are read, so that little goes to the driver however many tasks there are."""
    h = docs.select(F.xxhash64(key).alias("h"))
    least = [r[0] for r in h.orderBy("h").limit(most).collect()]
    if not least:
        return Field()
    rows = docs.filter((F.xxhash64(key) <= least[-1]) & (F.length(text) > 0)).select(text).distinct().limit(most).collect()
    return Field().fit(sorted(r[0] for r in rows))


def repetition(docs: DataFrame, key: str, text: str, field: Field | Broadcast, share: float | None = None, slice_chars: int = 2_000_000) -> DataFrame:
    """(key, n_words, content_share, repeated_share): of each text the share of words in lines labelled content and, exact, the share of words
    that lie in runs of eight or more that occurred earlier in it.

    With share, only documents that are not retained come out: their content share is below RETAINED, and the exact count, which only they
    get, is at least share. Without it all documents are counted. Null and empty texts have 0 words and shares of 1 and 0. Rows are taken as they
    are: a repeated row is reported again.
    """
    emit, step = (field.value if isinstance(field, Broadcast) else field).emit, (field.value if isinstance(field, Broadcast) else field).step
    kind = docs.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Field(emit, step)
        for frame in frames:
            frame = frame.reset_index(drop=True)
            size = frame["text"].fillna("").str.len().to_numpy().cumsum()
            for _, part in frame.groupby(size // slice_chars, sort=False):
                texts = part["text"].fillna("").tolist()
                b = Batch(texts)
                y = f.label(b)
                content = np.bincount(b.line_doc, weights=b.line_len * (y == 0), minlength=b.n_docs) if len(y) else np.zeros(b.n_docs)
                n = np.maximum(b.n_words, 1)
                content_share = np.where(b.n_words > 0, content / n, 1.0)
                suspect = content_share < RETAINED if share is not None else b.n_words > 0
                again = np.zeros(b.n_docs)
                if suspect.any():
                    take = suspect[b.owner]
                    own = b.owner[take]
                    again = np.bincount(own, weights=repeated_words(b.codes[take], own), minlength=b.n_docs)
                out = pd.DataFrame({key: part[key].to_numpy(), "n_words": b.n_words.astype(np.int64), "content_share": content_share, "repeated_share": again / n})
                yield out if share is None else out[suspect & (out["repeated_share"] >= share).to_numpy()]

    cols = docs.select(F.col(key), F.col(text).alias("text"))
    return cols.mapInPandas(work, f"`{key}` {kind}, n_words long, content_share double, repeated_share double")
