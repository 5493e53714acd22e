"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import history, leakage, mixing, names, ranking, repetition, representatives, splitting, unify
from lexigrid.session import table

Query = Callable[[SparkSession, str], DataFrame]

#: Every component counts the same.
COMPONENTS = {"filtered": 1.0, "keyphrase": 1.0, "ppr": 1.0, "semantic": 1.0}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return representatives.survivors(table(spark, d, "entity_versions"), values=False)


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    return representatives.merged_entities(table(spark, d, "entity_versions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.against_history(table(spark, d, "entity_feed")).select("first_record_id", "record_id")


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "entity_feed")
    return history.batch_counts(feed, history.against_history(feed))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.pieces(table(spark, d, "legal_articles"), ["id"], ["content", "raw_text"])
    return cut.filter("n_pieces > 1 and piece_no = 0").select("id", "field_name").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "legal_articles"), ["id"], ["content", "raw_text"]).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_entities(table(spark, d, "kg_entities"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.classes(table(spark, d, "kg_entities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.combined_ranking(table(spark, d, "component_scores"), COMPONENTS, top=1).select("qid", "article_id")


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    r = ranking.combined_ranking(table(spark, d, "component_scores"), COMPONENTS)
    return r.withColumn("combined", F.round("combined", 6))


def _names_and_contents(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "kg_entities").select(F.lit("kg_entities").alias("tbl"), "id", F.col("name").alias("text"))
    return names.unionByName(table(spark, d, "legal_articles").select(F.lit("legal_articles").alias("tbl"), "id", F.col("content").alias("text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.inconsistent(_names_and_contents(spark, d), ["tbl", "id"], "text")


def p7_unified(spark: SparkSession, d: str) -> DataFrame:
    return unify.unified(_names_and_contents(spark, d), ["tbl", "id"], "text").distinct()


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", ["question", "answer"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Passages that Myers' distance finds without a wrong word; with one they are in p8_leaks."""
    return _leaks(spark, d).filter("errors = 0").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _repetition(spark: SparkSession, d: str, share: float | None) -> DataFrame:
    docs = table(spark, d, "documents")
    return repetition.repetition(docs, "doc_id", "text", repetition.fit_field(docs, "doc_id", "text"), share)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _repetition(spark, d, repetition.SHARE).select("doc_id").distinct()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return _repetition(spark, d, None).distinct()


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p2_found": p2_found,
    "p2_batches": p2_batches,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p6_found": p6_found,
    "p6_ranking": p6_ranking,
    "p7_found": p7_found,
    "p7_unified": p7_unified,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
}
# Medians are the lower ones, as the operator's.
_RANKING = f"""s AS (SELECT qid, article_id, component, arg_max(score, (coalesce(epoch_us(scored_at), -4611686018427387904), score)) AS score FROM component_scores
        WHERE qid IS NOT NULL AND article_id IS NOT NULL AND component IN ('filtered', 'keyphrase', 'ppr', 'semantic') AND score IS NOT NULL AND CAST(score AS VARCHAR) <> 'nan' GROUP BY ALL),
    m AS (SELECT qid, component, quantile_disc(score, 0.5) AS mid FROM s GROUP BY ALL), a AS (SELECT s.*, mid, abs(score - mid) AS off FROM s JOIN m USING (qid, component)),
    d AS (SELECT qid, component, quantile_disc(off, 0.5) AS mad, avg(off) AS aad FROM a GROUP BY ALL),
    z AS (SELECT qid, article_id, CASE WHEN mad > 0 THEN (score - mid) / (mad * {ranking.MAD_TO_SIGMA}) WHEN aad > 0 THEN (score - mid) / (aad * 1.2533) ELSE 0 END AS z FROM a JOIN d USING (qid, component)),
    v AS (SELECT qid, article_id, 1 / (1 + exp(-greatest(-30, least(30, CAST(z AS DOUBLE))))) AS v FROM z),
    r AS (SELECT qid, article_id, round(exp((sum(ln(v)) + (4 - count(*)) * ln(0.5)) / 4), 12) AS combined, CAST(count(*) AS INTEGER) AS components FROM v GROUP BY ALL),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY combined DESC, components DESC, article_id) AS INTEGER) AS rank FROM r)"""

ORACLE: dict[str, str] = {
    "p4_found": "SELECT DISTINCT id, 'content' AS field_name FROM legal_articles WHERE length(content) > 2000 UNION SELECT DISTINCT id, 'raw_text' FROM legal_articles WHERE length(raw_text) > 2000",
    "p6_found": f"WITH {_RANKING} SELECT qid, article_id FROM k WHERE rank = 1",
    "p6_ranking": f"WITH {_RANKING} SELECT qid, article_id, round(combined, 6) AS combined, components, rank FROM k",
}
