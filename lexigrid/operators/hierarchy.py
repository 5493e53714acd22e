"""Documents as trees: nodes with paths, ordered scans, statistics, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import text


def nodes(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """(node_id, node_type, parent_id, document_id, depth, path, ord, title) of documents (id, title) and articles (id, document_id, chapter_id, section_id,
    article_number, title): documents, chapters, sections and articles, each once.

    The path is the array of ids from the root; chapters and sections come from the articles' keys. An article hangs on its section, else its
    chapter, else its document; a section's chapter is what precedes its last part.
    """
    doc = documents.filter("id is not null").groupBy("id").agg(F.min("title").alias("title"))
    doc = doc.select(F.col("id").alias("node_id"), F.lit("document").alias("node_type"), F.lit(None).cast("string").alias("parent_id"), F.col("id").alias("document_id"), F.array("id").alias("path"), F.lit(0).alias("ord"), "title")
    a = articles.filter("id is not null and document_id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("document_id", "chapter_id", "section_id", "article_number", "title")])
    chapter = F.coalesce("chapter_id", F.nullif(F.regexp_extract("section_id", r"^(.*):m\d+$", 1), F.lit("")))
    a = a.withColumn("chapter", chapter)
    ch = a.filter("chapter is not null").groupBy("document_id", "chapter").agg(F.min("article_number").alias("ord"))
    ch = ch.select(F.col("chapter").alias("node_id"), F.lit("chapter").alias("node_type"), F.col("document_id").alias("parent_id"), "document_id", F.array("document_id", "chapter").alias("path"), "ord", F.lit(None).cast("string").alias("title"))
    se = a.filter("section_id is not null").groupBy("document_id", "chapter", "section_id").agg(F.min("article_number").alias("ord"))
    se = se.select(F.col("section_id").alias("node_id"), F.lit("section").alias("node_type"), F.col("chapter").alias("parent_id"), "document_id", F.array("document_id", "chapter", "section_id").alias("path"), "ord", F.lit(None).cast("string").alias("title"))
    ar = a.select(
        F.col("id").alias("node_id"), F.lit("article").alias("node_type"), F.coalesce("section_id", "chapter", "document_id").alias("parent_id"), "document_id",
        F.array_compact(F.array("document_id", "chapter", "section_id", "id")).alias("path"), F.col("article_number").alias("ord"), "title",
    )
    out = doc.unionByName(ch).unionByName(se).unionByName(ar)
    return out.withColumn("depth", F.size("path") - 1)


def statistics(n: DataFrame, crossrefs: DataFrame | None = None) -> DataFrame:
    """(node_type, nodes, documents, deepest), and with cross-references (src_article, dst_article) a row 'cross_reference' of how many lead from one to another document's
    tree or stay in one, those with both ends."""
    out = n.groupBy("node_type").agg(F.count("*").alias("nodes"), F.countDistinct("document_id").alias("documents"), F.max("depth").alias("deepest"))
    if crossrefs is None:
        return out
    doc = text.document_of(F.col("src_article"))
    return out.unionByName(crossrefs.filter("src_article is not null and dst_article is not null").agg(F.lit("cross_reference").alias("node_type"), F.count("*").alias("nodes"), F.countDistinct(doc).alias("documents"), F.lit(0).alias("deepest")))


def children(n: DataFrame) -> DataFrame:
    """(parent_id, node_id, place): each node's place among its parent's children, by order, then id."""
    w = Window.partitionBy("parent_id").orderBy("ord", "node_id")
    return n.filter("parent_id is not null").select("parent_id", "node_id", F.row_number().over(w).alias("place"))


def subtree(n: DataFrame, roots: DataFrame, root: str = "root") -> DataFrame:
    """(root, node_id): the nodes below and including each root, by the path, without recursion."""
    return n.select("node_id", F.explode("path").alias(root)).join(roots.select(root).distinct(), root, "left_semi").select(root, "node_id")


def related(n: DataFrame, crossrefs: DataFrame) -> DataFrame:
    """(node_id, related_id): articles joined by a cross-reference, either way, that both exist."""
    both = crossrefs.select(F.col("src_article").alias("node_id"), F.col("dst_article").alias("related_id")).union(crossrefs.select("dst_article", "src_article")).filter("node_id <> related_id").distinct()
    have = n.select("node_id")
    return both.join(have, "node_id", "left_semi").join(have.withColumnRenamed("node_id", "related_id"), "related_id", "left_semi").select("node_id", "related_id")


def breadcrumb(n: DataFrame) -> DataFrame:
    """(node_id, trail): the path's ids joined by ' > '."""
    return n.select("node_id", F.array_join("path", " > ").alias("trail"))


def chapter_ranges(articles: DataFrame) -> DataFrame:
    """(chapter_id, first, last, article_range, articles): the articles of each chapter as 'Điều a-b', or 'Điều a' where there is one."""
    a = articles.filter("chapter_id is not null and article_number is not null").select("chapter_id", "id", "article_number").distinct()
    g = a.groupBy("chapter_id").agg(F.min("article_number").alias("first"), F.max("article_number").alias("last"), F.countDistinct("id").alias("articles"))
    span = F.when(F.col("first") == F.col("last"), F.concat(F.lit("Điều "), F.col("first"))).otherwise(F.concat(F.lit("Điều "), F.col("first"), F.lit("-"), F.col("last")))
    return g.select("chapter_id", "first", "last", span.alias("article_range"), "articles")


def article_summaries(articles: DataFrame, top: int = 15, limit: int = 200) -> DataFrame:
    """(article_id, keywords, description): summaries without a model: an article's first distinct keywords of title and text, and its beginning."""
    a = articles.filter("id is not null").groupBy("id").agg(F.min("title").alias("title"), F.min("content").alias("content"))
    a = a.withColumn("_k", text.keywords(F.concat_ws(" ", "title", "content"))).withColumn("_l", F.transform("_k", F.lower))
    words = F.slice(text.distinct_keywords(F.col("_k"), F.col("_l")), 1, top)
    return a.select(F.col("id").alias("article_id"), F.array_join(words, ", ").alias("keywords"), text.last_sentence_cut(F.trim(F.coalesce("content", F.lit(""))), limit).alias("description"))


def chapter_summaries(articles: DataFrame, top: int = 10) -> DataFrame:
    """(chapter_id, article_range, keywords, description): summaries without a model: the most common keywords of the articles' titles, ties by the word, and the titles
    in order, cut at 300 characters. A chapter's articles' titles are one task's."""
    a = articles.filter("chapter_id is not null and id is not null").groupBy("chapter_id", "id").agg(F.min("title").alias("title"), F.min("article_number").alias("n"))
    words = a.select("chapter_id", F.explode(text.keywords(F.coalesce("title", F.lit("")))).alias("w")).groupBy("chapter_id", F.lower("w").alias("w")).agg(F.count("*").alias("c"))
    first = words.withColumn("r", F.row_number().over(Window.partitionBy("chapter_id").orderBy(F.desc("c"), "w"))).filter(F.col("r") <= top)
    k = first.groupBy("chapter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]), ", ").alias("keywords"))
    t = a.filter("title is not null").groupBy("chapter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id", "title"))), lambda x: x["title"]), ". ").alias("titles"))
    d = chapter_ranges(articles).select("chapter_id", "article_range").join(k, "chapter_id", "left").join(t, "chapter_id", "left")
    return d.select("chapter_id", "article_range", F.coalesce("keywords", F.lit("")).alias("keywords"), text.last_sentence_cut(F.coalesce("titles", F.lit("")), 300).alias("description"))


def document_summaries(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """(doc_id, so_hieu, doc_type, title, scope, subjects, num_chapters, num_articles): the tier that needs no model: scope and subjects from Điều 1 and 2."""
    d = documents.filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("so_hieu", "title", "loai_van_ban")])
    a = articles.filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("document_id", "chapter_id", "article_number", "content")])
    clean = lambda n: F.max(F.when(F.col("article_number") == n, text.last_sentence_cut(F.regexp_replace(F.trim("content"), r"(?iu)^(phạm vi điều chỉnh|đối tượng áp dụng)[:. ]*", ""), 300)))
    g = a.groupBy(F.col("document_id").alias("id")).agg(clean(1).alias("scope"), clean(2).alias("subjects"), F.countDistinct("chapter_id").alias("num_chapters"), F.count("*").alias("num_articles"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return d.join(g, "id", "left").select(F.col("id").alias("doc_id"), "so_hieu", F.col("loai_van_ban").alias("doc_type"), "title", "scope", "subjects", z("num_chapters"), z("num_articles"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """(tbl, n) of the given tables."""
    out = None
    for name, d in tables.items():
        one = d.agg(F.lit(name).alias("tbl"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
