"""python -m lexigrid TABLES [QUESTION...]: the ranked articles of questions, of those given or of each line typed; TABLES is the folder of the corpus."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from lexigrid import __version__
from lexigrid.plans import engine
from lexigrid.session import build_session, ship, table


def open_corpus(spark: SparkSession, tables: str) -> engine.Corpus:
    """The corpus of a folder with legal_documents, legal_articles, kg_entities and kg_relations."""
    return engine.corpus(*[table(spark, tables, t) for t in ("legal_documents", "legal_articles", "kg_entities", "kg_relations")])


def ask(spark: SparkSession, corpus: engine.Corpus, questions: Iterable[str], top: int = 10) -> list[tuple[str, list[tuple[int, str, float, str]], str]]:
    """(question, its articles (rank, article_id, score, source), the answer without a model)."""
    texts = list(questions)
    q = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    found = engine.retrieve_articles(q, corpus, top=top)
    rows = found.collect()
    said = {r["qid"]: r["answer"] for r in engine.answers(found, corpus).collect()}
    return [(t, sorted((r["rank"], r["article_id"], r["score"], r["source"]) for r in rows if r["qid"] == i), said.get(i, "")) for i, t in enumerate(texts)]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexigrid", description=__doc__)
    p.add_argument("tables")
    p.add_argument("question", nargs="*")
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--master", default="local[*]")
    p.add_argument("--version", action="version", version=__version__)
    a = p.parse_args(argv)
    spark = build_session(a.master, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    corpus = open_corpus(spark, a.tables)
    for batch in [a.question] if a.question else ([line.strip()] for line in sys.stdin if line.strip()):
        for question, articles, answer in ask(spark, corpus, batch, a.top):
            print(f"# {question}")
            for rank, article, score, source in articles:
                print(f"{rank:3d} {article} {score:.6f} {source}")
            print(answer, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
