"""What the engine says about entities, themes and words without a model, and the context it hands on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import text

# Everyday words and the terms of the law that start a table of synonyms.
SEED_SYNONYMS = {
    "lập công ty": ("thành lập doanh nghiệp", "đăng ký kinh doanh"), "mở công ty": ("thành lập doanh nghiệp",), "đóng cửa công ty": ("giải thể doanh nghiệp",), "dẹp công ty": ("giải thể doanh nghiệp",),
    "vốn góp": ("phần vốn góp", "vốn điều lệ"), "cổ phần": ("cổ phần công ty",), "hợp đồng": ("hợp đồng dân sự", "khế ước"), "sếp": ("người quản lý", "giám đốc"),
    "chủ công ty": ("chủ sở hữu", "thành viên công ty"), "nhân viên": ("người lao động",), "sa thải": ("chấm dứt hợp đồng lao động",), "đuổi việc": ("chấm dứt hợp đồng lao động",),
}
#: Confidence of seeds, and the least a mined pair needs.
SEED_CONFIDENCE, MINED_LEAST = 1.0, 0.7


def entity_profiles(entities: DataFrame) -> DataFrame:
    """(entity_id, description, search_keywords, canonical_form, confidence) of entities (entity_id, name, type_str): name and type, the first five words."""
    w = text.words(F.col("name"))
    return entities.filter("name is not null").select(
        "entity_id", F.concat("name", F.lit(" ("), F.coalesce("type_str", F.lit("")), F.lit(")")).alias("description"), F.array_join(F.slice(w, 1, 5), " ").alias("search_keywords"), F.lower("name").alias("canonical_form"), F.lit(0.5).alias("confidence")
    )


def theme_profiles(partition: DataFrame, entities: DataFrame) -> DataFrame:
    """(theme, theme_id, name, size, confidence): a theme is its most common type, the first by name of equals; partition (theme, node)."""
    n = partition.join(entities.select(F.col("entity_id").alias("node"), "type_str"), "node").groupBy("theme", "type_str").agg(F.count("*").alias("n"))
    g = n.groupBy("theme").agg(F.min_by("type_str", F.struct(-F.col("n"), "type_str")).alias("t"), F.sum("n").alias("size"))
    return g.select("theme", text.hash_id(F.concat(F.lit("fallback:"), "t"), 16).alias("theme_id"), F.concat(F.lit("Nhóm "), "t").alias("name"), "size", F.lit(0.5).alias("confidence"))


def synonyms(mined: DataFrame, seeds: Mapping[str, Sequence[str]] = SEED_SYNONYMS) -> DataFrame:
    """(informal, formal, confidence): mined pairs of MINED_LEAST or more and the seeds, each pair at its best."""
    s = mined.sparkSession.createDataFrame([(k, v, SEED_CONFIDENCE) for k, vs in seeds.items() for v in vs], "informal string, formal string, confidence double")
    m = mined.filter(F.col("confidence") >= MINED_LEAST).select("informal", "formal", "confidence")
    return s.unionByName(m).groupBy("informal", "formal").agg(F.max("confidence").alias("confidence"))


def keyword_confidence(keyword: Column) -> Column:
    """How sure a keyword of so many words is of its document: .3 and .15 a word, at most .8."""
    return F.least(F.lit(0.8), 0.3 + 0.15 * F.size(F.split(F.trim(keyword), r"\s+")))


def keyword_documents(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """(qid, doc_id, confidence): documents whose keywords (doc_id, keyword, weight) a question has, by the surest keyword times the document's weight. The table of
    keywords is configuration and goes to every task."""
    k = F.broadcast(keywords.select("doc_id", F.lower("keyword").alias("keyword"), "weight"))
    hit = queries.select("qid", F.lower("text").alias("q")).filter("q is not null").join(k, F.contains(F.col("q"), F.col("keyword")))
    return hit.groupBy("qid", "doc_id").agg(F.round(F.max(keyword_confidence(F.col("keyword")) * F.col("weight")), 6).alias("confidence"))


def contexts(results: DataFrame, content: str = "content", budget: int = 4000, least: int = 100) -> DataFrame:
    """(qid, context): texts in rank order up to a budget of characters; the one that passes it is cut when more than `least` are left, later ones go."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    d = results.filter(F.col(content).isNotNull()).withColumn("_before", F.coalesce(F.sum(F.length(content)).over(w), F.lit(0)))
    left = F.lit(budget) - F.col("_before")
    piece = F.when(F.length(content) <= left, F.col(content)).when(left > least, F.concat(F.substring(F.col(content), F.lit(1), left.cast("int")), F.lit("...")))
    line = F.concat(F.lit("[Article "), F.col("rank"), F.lit("]: "), piece)
    return d.withColumn("_l", line).filter("_l is not null").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_l"))), lambda x: x["_l"]), "\n").alias("context"))
