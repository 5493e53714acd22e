"""Ranked retrieval over batches of questions: scores, fusion, expansion. Every frame has qid as a column."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexigrid.functions import dims, text
from lexigrid.operators.skew import parted_join
from lexigrid.operators.tree import confidence as tree_confidence  # noqa: F401
from lexigrid.operators.tree import searched as tree_without_model  # noqa: F401

#: Characters of question text that go to every task at most; larger batches are split by the caller.
QUERY_BYTES = 64_000_000
#: Query vectors that go to every task at a time, and rows that are multiplied with them at a time: a matrix of some 64 MB.
QUERY_ROWS, VECTOR_ROWS = 4096, 2048
#: Scores of names and questions that are worked out at once: a matrix of some 16 MB.
SCORE_CELLS = 2_000_000
#: Threshold of dual's scores where it doesn't follow the overlap.
FIXED_THRESHOLD = 0.5
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def keyphrase_value(ov: np.ndarray, terms: np.ndarray, two: np.ndarray, three: np.ndarray, name_in: np.ndarray, query_in: np.ndarray) -> np.ndarray:
    """How well a name fits a question, 0 to 1, from the number of shared terms and of terms, whether the name has two or three of the question's words in
    a row, whether the question has the name, and the name the question."""
    s = np.where(ov > 0, ov / terms * np.where(ov >= 2, 1.5, 1.0), 0.0)
    s = np.where(two, np.maximum(s, 0.5) * 1.5, s)
    s = np.where(three, np.maximum(s, 0.7) * 1.5, s)
    return np.minimum(1.0, np.where(name_in, np.maximum(s, 0.8) * 1.5, np.where(query_in, np.maximum(s, 0.6) * 1.2, s)))


class _Batch:
    """A batch of questions, to be met by many names at once: terms by an inverted index, runs of words and whole questions by automatons."""

    def __init__(self, rows: Sequence[tuple]):
        self.ids = [r[0] for r in rows]
        self.questions = [r[1] for r in rows]
        self.n_terms = np.array([len(r[2]) for r in rows], dtype=float)
        self.terms, self.of_term = self._index((t, k) for k, r in enumerate(rows) for t in r[2])
        self.runs: list[tuple] = []
        for n in (3, 4):
            runs, of_run = self._index((g, k) for k, r in enumerate(rows) for g in set(r[n]) if g)
            self.runs.append((self._automaton(runs), of_run))
        wholes, of_whole = self._index((q, k) for k, q in enumerate(self.questions) if q)
        self.wholes = self._automaton(wholes), of_whole

    @staticmethod
    def _index(pairs: Iterable[tuple[str, int]]) -> tuple[dict[str, int], list[np.ndarray]]:
        """Numbers of words, and for each number the questions."""
        of: dict[str, list[int]] = {}
        for w, k in pairs:
            of.setdefault(w, []).append(k)
        return {w: i for i, w in enumerate(of)}, [np.array(v, dtype=np.int64) for v in of.values()]

    @staticmethod
    def _automaton(numbers: Mapping[str, int]):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, i in numbers.items():
            a.add_word(w, i)
        if numbers:
            a.make_automaton()
        return a if numbers else None

    def _cells(self, found: Sequence[Iterable[int]], of: Sequence[np.ndarray]) -> np.ndarray:
        """Places in a matrix of names and questions, one for each number found in a name and question of that number."""
        width = len(self.ids)
        parts = [of[i] + at * width for at, numbers in enumerate(found) for i in numbers]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def scores(self, names: Sequence[str]) -> np.ndarray:
        """keyphrase_value of each of the names, which differ, with each question."""
        shape = len(names), len(self.ids)
        words = [{self.terms[w] for w in _BLANKS.split(n) if w in self.terms} for n in names]
        ov = np.bincount(self._cells(words, self.of_term), minlength=shape[0] * shape[1]).reshape(shape)

        def has(automaton, of: Sequence[np.ndarray]) -> np.ndarray:
            out = np.zeros(shape[0] * shape[1], dtype=bool)
            if automaton is not None:
                out[self._cells([{i for _, i in automaton.iter(n)} for n in names], of)] = True
            return out.reshape(shape)

        (two, three), query_in = (has(*x) for x in self.runs), has(*self.wholes)
        name_in = np.zeros(shape, dtype=bool)
        at = {n: i for i, n in enumerate(names)}
        if "" in at:
            name_in[at[""]] = True
        # An automaton of the names reads every question once.
        seek = self._automaton({n: i for n, i in at.items() if n})
        if seek is not None:
            for k, q in enumerate(self.questions):
                name_in[[i for _, i in seek.iter(q)], k] = True
        return keyphrase_value(ov, self.n_terms, two, three, name_in, query_in)

    def blocks(self, names: Sequence[str], scored: bool = True) -> Iterator[tuple[int, int, np.ndarray]]:
        """(from, to, scores) of names, which may repeat, in blocks of at most SCORE_CELLS scores, a name at least; zeros if they aren't scored."""
        step = max(1, SCORE_CELLS // max(1, len(self.ids)))
        for at in range(0, len(names), step):
            codes, different = pd.factorize(np.array(names[at : at + step], dtype=object))
            s = np.zeros((len(codes), len(self.ids)))
            if scored:
                s[codes >= 0] = self.scores(list(different))[codes[codes >= 0]]  # no name, no score
            yield at, at + len(codes), s


def _asked(queries: DataFrame):
    """The batch of questions (qid, text) as it goes to every task, checked against QUERY_BYTES, without those of stop words only."""
    q = queries.select("qid", F.lower("text").alias("q")).filter("q is not null")
    size = q.agg(F.sum(F.octet_length("q"))).first()[0] or 0
    if size > QUERY_BYTES:
        raise ValueError(f"the batch of questions has {size} bytes of at most {QUERY_BYTES}; score it in several")
    w = q.select("qid", "q", text.words(F.col("q")).alias("w"))
    rows = w.select("qid", "q", text.terms(F.col("q")).alias("qt"), text.ngrams(F.col("w"), 2).alias("g2"), text.ngrams(F.col("w"), 3).alias("g3")).filter("size(qt) > 0").collect()
    return queries.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])


def _spread(d: DataFrame, *by: str) -> DataFrame:
    """d in as many tasks as a shuffle has: a few MB of names mean millions of scores, which the size of the rows doesn't tell."""
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def keyphrase_scores(queries: DataFrame, entities: DataFrame, least: float = 0.0) -> DataFrame:
    """(qid, entity_id, score) for score above 0 and from `least` on: queries (qid, text) against entities (entity_id, name).

    The question batch is the stated query set, checked against QUERY_BYTES; it goes to every task as an index, and names are scored where they are, so that
    nothing has to be brought together afterwards. Questions of stop words only have no rows, as have null names and questions.
    """
    sent, kind, key = _asked(queries), queries.schema["qid"].dataType, entities.schema["entity_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _Batch(sent.value)
        ids = pa.array(batch.ids, to_arrow_type(kind))
        for f in batches:
            for a, b, s in batch.blocks(f["n"].to_pylist()):
                i, j = np.nonzero((s > 0) & (s >= least))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), f["entity_id"].slice(a, b - a).take(pa.array(i)), pa.array(s[i, j])], ["qid", "entity_id", "score"])

    named = entities.select("entity_id", F.lower("name").alias("n")).filter("n is not null")
    return _spread(named, "entity_id").mapInArrow(work, f"qid {kind.simpleString()}, entity_id {key.simpleString()}, score double")


def packed_seeds(queries: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """keyphrase_scores of nodes (id, name), an int32, from `least` on as (qid, ids, weights): a row for a question and many nodes, as bytes of int32 and float64."""
    sent, kind = _asked(queries), queries.schema["qid"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _Batch(sent.value)
        ids = pa.array(batch.ids, to_arrow_type(kind))
        for f in batches:
            for a, b, s in batch.blocks(f["n"].to_pylist()):
                node = f["id"].slice(a, b - a).to_numpy().astype(np.int32)
                rows = [(k, node[i].tobytes(), s[i, k].tobytes()) for k in range(len(ids)) if len(i := np.nonzero((s[:, k] > 0) & (s[:, k] >= least))[0])]
                k, i, w = zip(*rows) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(k, pa.int64())), pa.array(i, pa.binary()), pa.array(w, pa.binary())], ["qid", "ids", "weights"])

    named = nodes.select("id", F.lower("name").alias("n")).filter("n is not null and id is not null")
    return _spread(named, "id").mapInArrow(work, f"qid {kind.simpleString()}, ids binary, weights binary")


def article_keyphrase(scores: DataFrame, mentions: DataFrame) -> DataFrame:
    """(qid, article_id, keyphrase): entity scores gathered per article: the greatest and, by the log of how many, the mean."""
    m = scores.hint("merge").join(mentions.select("entity_id", "article_id").distinct(), "entity_id")  # scores are many, however small they look
    g = m.groupBy("qid", "article_id").agg(F.max("score").alias("m"), F.avg("score").alias("a"), F.count("*").alias("n"))
    return g.select("qid", "article_id", (F.col("m") + 0.3 * F.log(F.col("n") + 1) * F.col("a")).alias("keyphrase"))


def _of_articles(batch: _Batch, batches: Iterator[pa.RecordBatch], scored: bool = True) -> Iterator[tuple[list, np.ndarray]]:
    """(articles, their keyphrase by question) from rows (article_id, n, ..) in the order of articles; an article is the first columns but n. Without scores of names it is 0."""
    last: tuple | None = None  # an article that may go on: itself, greatest, sum, number

    def value(m, total, n):
        return m + 0.3 * np.log(n + 1) * (total / np.maximum(n, 1))

    for f in batches:
        keys = list(zip(*(f[c].to_pylist() for c in f.schema.names if c != "n")))
        for a, b, s in batch.blocks(f["n"].to_pylist(), scored):
            starts = [i for i in range(b - a) if not i or keys[a + i] != keys[a + i - 1]]
            m, total, n = np.maximum.reduceat(s, starts, axis=0), np.add.reduceat(s, starts, axis=0), np.add.reduceat(s > 0, starts, axis=0, dtype=np.int64)
            own = [keys[a + i] for i in starts]
            if last is not None:
                if last[0] == own[0]:
                    m[0], total[0], n[0] = np.maximum(m[0], last[1]), total[0] + last[2], n[0] + last[3]
                else:
                    yield [last[0]], value(*(x[None] for x in last[1:]))
            if len(own) > 1:
                yield own[:-1], value(m[:-1], total[:-1], n[:-1])
            last = own[-1], m[-1], total[-1], n[-1]
    if last is not None:
        yield [last[0]], value(*(x[None] for x in last[1:]))


def mentioned_keyphrase(queries: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """article_keyphrase of keyphrase_scores: (qid, article_id, keyphrase).

    Names go to the articles that mention them and are scored there, so that only what comes out of an article is a row for each question.
    """
    sent, kind, key = _asked(queries), queries.schema["qid"].dataType, mentions.schema["article_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _Batch(sent.value)
        ids = pa.array(batch.ids, to_arrow_type(kind))
        for articles, v in _of_articles(batch, batches):
            i, j = np.nonzero(v > 0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), pa.array([x[0] for x in articles], to_arrow_type(key)).take(pa.array(i)), pa.array(v[i, j])], ["qid", "article_id", "keyphrase"])

    return _by_article(entities, mentions, "article_id").filter("n is not null").mapInArrow(work, f"qid {kind.simpleString()}, article_id {key.simpleString()}, keyphrase double")


def best_articles(
    queries: DataFrame, entities: DataFrame, mentions: DataFrame, numbers: DataFrame | None, most: int, keyphrase: bool = True, also: DataFrame | None = None, slack: float = 1e-8,
    near: DataFrame | None = None, grouped: DataFrame | None = None,
) -> DataFrame:
    """(qid, article_id, keyphrase, ppr, theme): of the articles that mention entities, all that can be among the first `most` of a question by the weighted sum of keyphrase and ppr
    and by theme, whatever their weights, and the pairs also (qid, article_id), whatever their sum.

    numbers (qid, number, score) is what pagerank gives to all articles of a number, near (qid, theme, similarity) the few themes of a question and grouped (theme, article_id) the
    themes' articles, of which the most similar counts; numbers and near go to every task. An article's sums are worked out where its names are scored, and a task hands out its best
    only: an article has no place if `most` have greater sums and themes as near. Sums that differ by slack or less count as equal, as they may be after rounding; of equal ones the
    first by id.
    """
    sent, kind, key = _asked(queries), queries.schema["qid"].dataType, mentions.schema["article_id"].dataType
    ranks = queries.sparkSession.sparkContext.broadcast([] if numbers is None else [tuple(r) for r in numbers.select("qid", "number", "score").collect()])
    themes = queries.sparkSession.sparkContext.broadcast([] if near is None else [tuple(r) for r in near.select("qid", "theme", "similarity").collect()])
    paired, wk, wp = also is not None, dims.DUAL_WEIGHTS["keyphrase"], dims.DUAL_WEIGHTS["ppr"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _Batch(sent.value)
        column = {q: i for i, q in enumerate(batch.ids)}
        place = {n: i for i, n in enumerate(dict.fromkeys(r[1] for r in ranks.value))}
        given = np.zeros((len(place) + 1, len(column)))  # the last for articles without number
        for q, n, s in ranks.value:
            if q in column:
                given[place[n], column[q]] = s
        nearness = _Nearness(themes.value, column)
        least = np.full((nearness.levels, len(column)), -np.inf)
        every = np.arange(len(column))
        found: list[pd.DataFrame] = []
        rows = 0
        for articles, k in _of_articles(batch, batches, keyphrase):
            p = given[[place.get(x[1], len(place)) for x in articles]]
            s = wk * k + wp * p
            level, has = nearness.of([x[2] for x in articles])
            kept = np.zeros(s.shape, dtype=bool)
            if paired:
                for i, x in enumerate(articles):
                    kept[i, [column[q] for q in x[3] or () if q in column]] = True
            rest = np.where(kept, -np.inf, s)
            some = (s > 0) | has
            if len(rest) >= most and np.count_nonzero(some & (rest >= least[level, every] - slack)) > most * len(column):
                for n in range(nearness.levels):
                    above = np.where(level <= n, rest, -np.inf)
                    least[n] = np.maximum(least[n], np.partition(above, len(rest) - most, axis=0)[len(rest) - most])
            i, j = np.nonzero(some & (kept | (rest >= least[level, every] - slack)))
            found.append(pd.DataFrame({"a": np.array([x[0] for x in articles], dtype=object)[i], "q": j, "l": level[i, j], "s": rest[i, j], "k": k[i, j], "p": p[i, j], "has": has[i, j], "kept": kept[i, j]}))
            rows += len(i)
            if rows > 8 * most * len(column):
                found = [_first(pd.concat(found), most, slack, least)]
                rows = 0
        if found:
            f = _first(pd.concat(found), most, slack, least)
            some = lambda c: pa.array(f[c].to_numpy(), mask=f[c].to_numpy() <= 0)
            ids = pa.array(batch.ids, to_arrow_type(kind)).take(pa.array(f["q"].to_numpy(np.int64)))
            theme = pa.array(nearness.value[f["l"].to_numpy(), f["q"].to_numpy()], mask=~f["has"].to_numpy())
            yield pa.RecordBatch.from_arrays([ids, pa.array(f["a"].to_list(), to_arrow_type(key)), some("k"), some("p"), theme], ["qid", "article_id", "keyphrase", "ppr", "theme"])

    m = mentions.select("entity_id", "article_id", F.col("article_number").alias("number"))
    cols = ["article_id", "number"]
    for name, d, c in (("themes", grouped, "theme"), ("also", also, "qid")):
        if d is None:
            m = m.withColumn(name, F.lit(None).cast("array<int>"))
        else:
            m = m.join(d.groupBy("article_id").agg(F.array_sort(F.collect_set(c)).alias(name)), "article_id", "left")
        cols.append(name)
    out = f"qid {kind.simpleString()}, article_id {key.simpleString()}, keyphrase double, ppr double, theme double"
    best = _by_article(entities, m, *cols).mapInArrow(work, out)
    asked = {r[0] for r in sent.value}
    silent = [r for r in themes.value if r[0] not in asked]
    if not silent:
        return best
    # Questions of stop words only have themes all the same, and nothing else.
    none = F.lit(None).cast("double")
    rest = parted_join(queries.sparkSession.createDataFrame(silent, near.schema), grouped, ["theme"]).groupBy("qid", "article_id").agg(F.max("similarity").alias("theme"))
    return best.unionByName(rest.select("qid", "article_id", none.alias("keyphrase"), none.alias("ppr"), "theme"))


class _Nearness:
    """How near the themes of articles are to questions, as levels: for each question the different similarities of its themes and 0, which articles of none of them have, from the
    greatest. value[level, question] is the similarity."""

    def __init__(self, near: Sequence[tuple], column: Mapping):
        own: list[dict] = [{} for _ in column]
        for q, t, v in near:
            if q in column:
                own[column[q]][t] = v
        order = [sorted({0.0, *x.values()}, reverse=True) for x in own]
        self.levels = max(map(len, order), default=1)
        self.value = np.zeros((self.levels, len(column)))
        self.none = np.array([x.index(0.0) for x in order], dtype=np.int64)
        self.place = {t: i for i, t in enumerate(dict.fromkeys(r[1] for r in near))}
        self.level = np.full((len(self.place), len(column)), self.levels, dtype=np.int64)  # beyond the last: not a theme of the question
        for j, (x, o) in enumerate(zip(own, order)):
            self.value[: len(o), j] = o
            for t, v in x.items():
                self.level[self.place[t], j] = o.index(v)

    def of(self, themes: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """(levels, whether the question has a theme of the article) of articles by their themes."""
        out = np.full((len(themes), len(self.none)), self.levels, dtype=np.int64)
        for i, x in enumerate(themes):
            at = [self.place[t] for t in x or () if t in self.place]
            if at:
                out[i] = self.level[at].min(axis=0)
        has = out < self.levels
        return np.where(has, out, self.none), has


def _first(f: pd.DataFrame, most: int, slack: float, least: np.ndarray) -> pd.DataFrame:
    """Rows (a, q, l, s, .., kept) that are kept or among the first by s of the rows of their q and of their level l or a lower, with those that differ by slack; of one s and level
    the first `most` by a. What the first `most` have at least goes into least[level, q]."""
    f = f.sort_values(["q", "s", "a"], ascending=[True, False, True], ignore_index=True)
    own = f[~f["kept"]]
    for n in range(len(least)):
        above = own[own["l"] <= n]
        last = above[above.groupby("q").cumcount() == most - 1]
        q = last["q"].to_numpy()
        least[n, q] = np.maximum(least[n, q], last["s"].to_numpy())
    at = least[f["l"].to_numpy(), f["q"].to_numpy()]
    return f[f["kept"] | ((f["s"] >= at - slack) & (f.groupby(["q", "l", "s"]).cumcount() < most))]


def _by_article(entities: DataFrame, mentions: DataFrame, *cols: str) -> DataFrame:
    """(cols.., n): the names of the entities that an article mentions, an article's together; null for those without."""
    named = entities.select("entity_id", F.lower("name").alias("n"))
    d = mentions.select("entity_id", *cols).distinct().join(named, "entity_id", "left").select(*cols, "n")
    return _spread(d, "article_id").sortWithinPartitions("article_id")


def low_level(components: DataFrame, weights: Mapping[str, float] = dims.DUAL_WEIGHTS) -> DataFrame:
    """(qid, article_id, low): weighted sum of keyphrase, semantic, ppr and concept, absent 0, by the greatest of the question."""
    s = sum((F.coalesce(F.col(c), F.lit(0.0)) * weights[c] for c in ("keyphrase", "semantic", "ppr", "concept")), F.lit(0.0))
    d = components.select("qid", "article_id", s.alias("s"))
    top = d.groupBy("qid").agg(F.max("s").alias("top"))
    return d.join(top, "qid").select("qid", "article_id", F.when(F.col("top") > 0, F.col("s") / F.col("top")).otherwise(F.col("s")).alias("low"))


def fused(low: DataFrame, theme: DataFrame | None = None, hierarchy: DataFrame | None = None, mode: str = "dual", least: float = 0.1) -> DataFrame:
    """(qid, article_id, score): low alone, or .70 low + .15 theme + .15 hierarchy; scores from `least` on."""
    d = low.select("qid", "article_id", "low")
    for name, other in (("theme", theme), ("hierarchy", hierarchy)):
        d = d.withColumn(name, F.lit(0.0)) if other is None else d.join(other.select("qid", "article_id", name), ["qid", "article_id"], "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = z("low") if mode == "low" else 0.70 * z("low") + 0.15 * z("theme") + 0.15 * z("hierarchy")
    return d.select("qid", "article_id", score.alias("score")).filter(F.col("score") >= least)


def ranked(scores: DataFrame, score: str = "score", k: int | None = None, rank: str = "rank", by: str = "qid", tie: str = "article_id") -> DataFrame:
    """scores with their place per question, the best first, ties by id; the first k."""
    d = scores.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)))
    return d.filter(F.col(rank) <= k) if k else d


def shared_rank(scores: DataFrame, score: str = "score", rank: str = "dual_rank") -> DataFrame:
    """Places in which equal scores share the first."""
    return scores.withColumn(rank, F.rank().over(Window.partitionBy("qid").orderBy(F.desc(score))))


def rrf(lists: Mapping[str, DataFrame], weights: Mapping[str, float] = dims.RRF_WEIGHTS, k: int = dims.RRF_K, least: float | None = 0.005) -> DataFrame:
    """(qid, article_id, score, source): reciprocal-rank fusion of lists (qid, article_id, rank); source is the first list that has the article.

    The lists are united and summed, which shuffles once and combines on the map side.
    """
    every = None
    for i, (name, d) in enumerate(lists.items()):
        one = d.select("qid", "article_id", (F.lit(float(weights[name])) / (F.lit(k) + F.col("rank"))).alias("s"), F.struct(F.lit(i).alias("i"), F.lit(name).alias("source")).alias("o"))
        every = one if every is None else every.unionByName(one)
    out = every.groupBy("qid", "article_id").agg(F.sum("s").alias("score"), F.min("o")["source"].alias("source"))
    return out if least is None else out.filter(F.col("score") >= least)


def weighted_by_confidence(tree: DataFrame, kg: DataFrame, confidence: DataFrame, k: int = dims.RRF_K) -> DataFrame:
    """(qid, article_id, score): tree and kg fused by weights that follow the tree's confidence: .7/.3 from .7 on, .5/.5 from .5 on, else .3/.7."""
    w = F.when(F.col("confidence") >= 0.7, 0.7).when(F.col("confidence") >= 0.5, 0.5).otherwise(0.3)
    c = confidence.select("qid", w.alias("w"))
    one = tree.select("qid", "article_id", "rank", F.lit(True).alias("t")).unionByName(kg.select("qid", "article_id", "rank", F.lit(False).alias("t"))).join(c, "qid")
    s = F.when(F.col("t"), F.col("w")).otherwise(1 - F.col("w")) / (k + F.col("rank"))
    return one.groupBy("qid", "article_id").agg(F.sum(s).alias("score"))


def neighbours(seeds: DataFrame, articles: DataFrame, reach: int = 2) -> DataFrame:
    """(qid, article_id, distance, score): articles up to `reach` numbers from a seed in its document that have text and aren't seeds.

    A band join as a generated equi-join: each seed names its neighbours' numbers. seeds (qid, article_id), articles (article_id, document_id,
    article_number, content).
    """
    at = articles.select("article_id", "document_id", "article_number", "content").filter("article_number is not null").dropDuplicates(["article_id"])
    s = seeds.select("qid", "article_id").distinct()
    near = (
        s.join(at.select("article_id", "document_id", "article_number"), "article_id")
        .select("qid", "document_id", F.col("article_number").alias("from"), F.explode(F.sequence(F.col("article_number") - reach, F.col("article_number") + reach)).alias("article_number"))
        .filter("article_number > 0 and article_number <> from")
        .groupBy("qid", "document_id", "article_number")
        .agg(F.min(F.abs(F.col("article_number") - F.col("from"))).alias("distance"))
    )
    found = near.join(at.filter("length(trim(content)) > 0").select("article_id", "document_id", "article_number"), ["document_id", "article_number"]).join(s, ["qid", "article_id"], "left_anti")
    return found.select("qid", "article_id", "distance", F.round(F.greatest(F.lit(0.20), 0.40 - 0.05 * F.col("distance")), 6).alias("score"))


def without_repeats(results: DataFrame, content: str = "content", first: int = 200) -> DataFrame:
    """The best row of each question and beginning of text; ties by article_id."""
    w = Window.partitionBy("qid", F.substring(F.col(content), 1, first)).orderBy(F.desc("score"), "article_id")
    return results.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_distinct(results: DataFrame, most: int = 7, order: str = "rank") -> DataFrame:
    """(qid, article_id, rank): each article at its first place, the first `most` of each question, numbered anew."""
    d = results.groupBy("qid", "article_id").agg(F.min(order).alias("_o"))
    n = d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("_o", "article_id")))
    return n.filter(F.col("rank") <= most).select("qid", "article_id", "rank")


def overlap(tree: DataFrame, dual: DataFrame, k: int = 5) -> DataFrame:
    """(qid, common, ratio): articles of the tree among the first k of dual, and their share of the smaller set."""
    t = tree.select("qid", "article_id").distinct()
    d = dual.filter(F.col("rank") <= k).select("qid", "article_id").distinct()
    sizes = t.groupBy("qid").agg(F.count("*").alias("nt")).join(d.groupBy("qid").agg(F.count("*").alias("nd")), "qid", "full_outer")
    both = t.join(d, ["qid", "article_id"]).groupBy("qid").agg(F.count("*").alias("n"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return sizes.join(both, "qid", "left").select("qid", z("n").alias("common"), (z("n") / F.greatest(F.lit(1), F.least(z("nt"), z("nd")))).alias("ratio"))


def adaptive_threshold(ratio: Column) -> Column:
    """.6 from an overlap of .7 on, .4 up to .3, between them in proportion."""
    return F.when(ratio >= 0.7, 0.6).when(ratio <= 0.3, 0.4).otherwise(0.4 + (ratio - 0.3) / 0.4 * 0.2)


def ambiguity(query: Column, kind: Column, refs: Column, confidence: Column) -> Column:
    """How far a threshold is lowered: .075 for each sign of an unclear question, down to .7."""
    vague = query.rlike(r"(?iu)(như thế nào|ra sao|thế nào|làm sao|là gì)")
    signs = [F.size(text.words(query)) <= 3, F.size(refs) == 0, kind == "general", confidence < 0.5, vague]
    n = sum((s.cast("int") for s in signs), F.lit(0))
    return F.greatest(F.lit(0.7), 1 - 0.075 * n)


def calibrated(results: DataFrame, thresholds: DataFrame, calibration: DataFrame) -> DataFrame:
    """results (qid, .., score) from the question's threshold (qid, threshold) times its calibration (qid, calibration) on; a question without a threshold has
    FIXED_THRESHOLD, one without calibration 1."""
    d = results.join(thresholds.select("qid", "threshold"), "qid", "left").join(calibration.select("qid", "calibration"), "qid", "left")
    limit = F.coalesce("threshold", F.lit(FIXED_THRESHOLD)) * F.coalesce("calibration", F.lit(1.0))
    return d.filter(F.col("score") >= limit).drop("threshold", "calibration")


def cross_check(tree: DataFrame, dual: DataFrame, chapters: DataFrame, most: int = 3, bridge: bool = True) -> DataFrame:
    """(qid, article_id, score, why): what dual adds to the tree's articles.

    'chapter': where tree and dual's first five overlap less than .4, up to `most` of dual's first ten from chapters the tree doesn't have;
    'score', with bridge: dual's first seven above .55 that the tree lacks. chapters (article_id, chapter_id).
    """
    ch = chapters.select("article_id", "chapter_id").dropDuplicates(["article_id"])
    have = tree.select("qid", "article_id").distinct()
    missing = dual.filter("rank <= 10").join(have, ["qid", "article_id"], "left_anti")
    low = overlap(tree, dual).filter("ratio < 0.4").select("qid")
    seen = have.join(ch, "article_id").filter("chapter_id is not null").select("qid", "chapter_id").distinct()
    fresh = missing.join(low, "qid", "left_semi").join(ch, "article_id").filter("chapter_id is not null").join(seen, ["qid", "chapter_id"], "left_anti")
    first = ranked(fresh.drop("rank"), k=most, rank="_r").select("qid", "article_id", "score", F.lit("chapter").alias("why"))
    strong = missing.filter("rank <= 7 and score > 0.55").select("qid", "article_id", "score", F.lit("score").alias("why"))
    both = first.unionByName(strong) if bridge else first
    return both.groupBy("qid", "article_id").agg(F.max("score").alias("score"), F.min("why").alias("why"))


def reranked(results: DataFrame, model_score: str, k: int) -> DataFrame:
    """The first 3 k results by .6 of the model's score and .4 of their own, k of them; original_rank is kept."""
    base = ranked(results.drop("rank"), rank="original_rank", k=3 * k)
    d = base.withColumn("blended", 0.6 * F.col(model_score) + 0.4 * F.col("score"))
    return ranked(d, score="blended", k=k)


def filtered_by_document(results: DataFrame, hints: DataFrame, mode: str, boost: float = 2.0, penalty: float = 0.5) -> DataFrame:
    """results (qid, article_id, score, doc_type, number, year) under the documents their questions name.

    'boost' doubles matches, 'filter' keeps them only, 'rerank' doubles matches and halves the rest. A hint without number or year fits all. Questions
    without hints stay as they are.
    """
    h = hints.select("qid", F.col("doc_type").alias("ht"), F.col("number").alias("hn"), F.col("year").alias("hy")).distinct()
    hinted = h.select("qid").distinct().withColumn("hinted", F.lit(True))
    fits = (F.col("ht") == F.col("doc_type")) & (F.col("hn").isNull() | (F.col("hn") == F.col("number"))) & (F.col("hy").isNull() | (F.col("hy") == F.col("year")))
    hit = results.join(h, "qid").filter(fits).select("qid", "article_id").distinct().withColumn("hit", F.lit(True))
    d = results.join(hinted, "qid", "left").join(hit, ["qid", "article_id"], "left")
    match, asked = F.col("hit").isNotNull(), F.col("hinted").isNotNull()
    if mode == "filter":
        d = d.filter(match | ~asked)
    elif mode == "boost":
        d = d.withColumn("score", F.when(match, F.col("score") * boost).otherwise(F.col("score")))
    elif mode == "rerank":
        d = d.withColumn("score", F.when(match, F.col("score") * boost).when(asked, F.col("score") * penalty).otherwise(F.col("score")))
    else:
        raise ValueError(f"no such mode: {mode}")
    return d.drop("hit", "hinted")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "qid", key: str = "vec_id", block: int = QUERY_ROWS) -> DataFrame:
    """(qid, key, similarity, rank): the k most similar vectors of each query vector by cosine, rounded to six places, ties by key.

    Queries are the stated set. They go to the tasks in blocks of about `block` rows, so what is sent is bounded whatever their number; for each block the
    vectors are read in place once, multiplied as matrices, and every task keeps its best k of each query, which one window merges. Null and zero
    vectors: null ones are left out, zero ones are 0 to all.
    """
    q = queries.select(F.col(query_key).alias("qid"), F.col("embedding").cast("array<double>").alias("_q")).filter("_q is not null")
    d = vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding")).filter(f"embedding is not null and `{key}` is not null")
    schema = f"qid {queries.schema[query_key].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, similarity double"
    blocks = max(1, -(-q.count() // block))
    out = None
    for b in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        sent = queries.sparkSession.sparkContext.broadcast(([r["qid"] for r in rows], np.array([r["_q"] for r in rows])))
        one = d.mapInPandas(_best_of_block(sent, k, key), schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    return ranked(out, score="similarity", k=k, tie=key)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best_of_block(sent, k: int, key: str):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, raw = sent.value
        q = _unit(raw).T
        least = np.full(len(ids), -np.inf)
        best = None
        for f in frames:
            for at in range(0, len(f), VECTOR_ROWS):
                part = f.iloc[at : at + VECTOR_ROWS]
                names = part[key].to_numpy()
                s = np.round(_unit(np.stack(part["embedding"].to_numpy())) @ q, 6)
                if len(part) > k:  # no more than these can be among the best
                    least = np.maximum(least, np.partition(s, len(part) - k, axis=0)[len(part) - k])
                i, j = np.nonzero(s >= least)
                more = pd.DataFrame({"q": j, "k": names[i], "s": s[i, j]})
                best = more if best is None else pd.concat([best, more])
                best = best.sort_values(["q", "s", "k"], ascending=[True, False, True]).groupby("q", sort=False).head(k)
                full = best.groupby("q")["s"].agg(["size", "min"])
                full = full[full["size"] >= k]
                least[full.index.to_numpy()] = np.maximum(least[full.index.to_numpy()], full["min"].to_numpy())
        if best is not None:
            yield pd.DataFrame({"qid": [ids[x] for x in best["q"]], key: best["k"].to_numpy(), "similarity": best["s"].to_numpy()})

    return work


def high_level(queries: DataFrame, themes: DataFrame, members: DataFrame, mentions: DataFrame, k: int = 10) -> DataFrame:
    """(qid, article_id, theme): the similarity of the k nearest themes given to the first source of each of their entities, the greatest of an article.

    queries (qid, embedding), themes (theme, embedding), members (theme, entity_id), mentions (entity_id, article_id, ord).
    """
    near, articles = themes_near(queries, themes, members, mentions, k)
    return parted_join(near, articles, ["theme"]).groupBy("qid", "article_id").agg(F.max("similarity").alias("theme"))


def themes_near(queries: DataFrame, themes: DataFrame, members: DataFrame, mentions: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """((qid, theme, similarity), (theme, article_id)): what high_level brings together: the k nearest themes of each question, and the themes' articles."""
    near = nearest(queries, themes, k, key="theme").select("qid", "theme", "similarity")
    first = mentions.groupBy("entity_id").agg(F.min_by("article_id", F.struct("ord", "article_id")).alias("article_id"))
    return near, members.join(first, "entity_id").select(F.col("theme").cast(near.schema["theme"].dataType), "article_id").distinct()


def related_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity_id): for each name the entity that bears it, else the first by id whose name has it inside.

    names (name) is a stated batch of at most QUERY_BYTES, sought in the entities' names (entity_id, name) by an automaton, in place; null and empty names
    have none.
    """
    n = names.select("name").filter("length(name) > 0").distinct()
    size = n.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    if size > QUERY_BYTES:
        raise ValueError(f"the batch of names has {size} bytes of at most {QUERY_BYTES}; look it up in several")
    sent = names.sparkSession.sparkContext.broadcast([r[0] for r in n.collect()])
    kind = entities.schema["entity_id"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in sent.value:
            a.add_word(w, w)
        if not sent.value:
            return
        a.make_automaton()
        for f in frames:
            rows = [(w, e, w != name) for e, name in zip(f["entity_id"], f["name"]) for w in {w for _, w in a.iter(name)}]
            yield pd.DataFrame(rows, columns=["name", "entity_id", "inside"])

    hits = entities.select("entity_id", "name").filter("name is not null and entity_id is not null").mapInPandas(work, f"name string, entity_id {kind}, inside boolean")
    return hits.groupBy("name").agg(F.min(F.struct("inside", "entity_id"))["entity_id"].alias("entity_id"))
