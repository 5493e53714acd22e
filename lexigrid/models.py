"""What stands behind the hooks: makers of models by name, texts as vectors, rerankers that may be absent."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


#: Numbers in a vector of known models; others tell by their first answer.
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-ada-002": 1536, "text-embedding-3-large": 3072}
_MAKERS: dict[str, dict[str, Callable]] = {"language": {}, "embedding": {}, "reranker": {}}


def register(kind: str, name: str, make: Callable) -> None:
    """A maker of models of a kind: language, embedding or reranker."""
    _MAKERS[kind][name] = make


def create(kind: str, name: str, **options):
    """The model a registered maker makes; an unknown name is an error that lists the known ones."""
    if name not in _MAKERS[kind]:
        raise ValueError(f"no {kind} model {name}; there are: {', '.join(sorted(_MAKERS[kind])) or 'none'}")
    return _MAKERS[kind][name](**options)


def first_available(names: Sequence[str], **options):
    """The first reranker of names that can be made, or None; so a missing model leaves results as they are."""
    for n in names:
        try:
            return create("reranker", n, **options)
        except Exception as e:  # whatever a maker lacks
            logging.getLogger("lexigrid").info("reranker %s: %s", n, e)
    return None


def dimension(name: str, embedder: Embedder | None = None) -> int:
    """The length of a model's vectors, by the table or by asking."""
    return DIMENSIONS.get(name) or len(embedder.embed(["x"])[0])


def embedded(texts: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 256) -> DataFrame:
    """(key, embedding): vectors of texts, in batches of an Arrow batch; null and empty texts have none."""
    kind = texts.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({key: part["k"].to_numpy(), "embedding": [list(map(float, v)) for v in embedder.embed(list(part["t"]))]})

    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("length(t) > 0").mapInPandas(work, f"`{key}` {kind}, embedding array<double>")


def model_scores(results: DataFrame, queries: DataFrame, articles: DataFrame, score: Callable[[Sequence[tuple[str, str]]], Sequence[float]] | None) -> DataFrame | None:
    """(qid, article_id, model): a reranker's score of each result's question and text; None where there is no reranker."""
    if score is None:
        return None
    d = results.select("qid", "article_id").distinct().join(queries.select("qid", F.col("text").alias("q")), "qid").join(articles.select("article_id", F.col("content").alias("c")), "article_id")
    kind = results.schema["qid"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"qid": f["qid"], "article_id": f["article_id"], "model": [float(x) for x in score(list(zip(f["q"].fillna(""), f["c"].fillna(""))))]})

    return d.select("qid", "article_id", "q", "c").mapInPandas(work, f"qid {kind}, article_id string, model double")


def logger(name: str = "lexigrid", level: int = logging.INFO) -> logging.Logger:
    """A logger with one handler, however often it is asked for."""
    log = logging.getLogger(name)
    if not log.handlers:
        h = logging.StreamHandler()
        h.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        log.addHandler(h)
    log.setLevel(level)
    return log


class Progress:
    """How far a run is, logged every so many steps; hits give the running rate."""

    def __init__(self, total: int, every: int = 10, log: logging.Logger | None = None):
        self.total, self.every, self.log, self.done, self.hits = total, every, log or logger(), 0, 0

    def step(self, hit: bool = False) -> None:
        self.done += 1
        self.hits += hit
        if self.done % self.every == 0 or self.done == self.total:
            self.log.info("%d of %d, hit rate %.4f", self.done, self.total, self.hits / self.done)
