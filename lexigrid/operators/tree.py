"""Search on the tree of documents, chapters and articles, without a model or by what a model picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import text

#: Documents, chapters and articles a question keeps at most.
MOST = {"document": 3, "chapter": 6, "article": 7}
#: Confidence of a level without a model, and of documents that are laws.
UNASKED, PRIMARY = 0.5, 0.85
#: A single chapter less sure than this is joined by another, if the model is surer of that than SECOND_LEAST.
SURE, SECOND_LEAST = 0.98, 0.6


def confidence(chapter: Column, articles: Column) -> Column:
    """min(.95, .45 of the chapters' confidence + .55 of the articles' mean)."""
    return F.least(F.lit(0.95), 0.45 * chapter + 0.55 * articles)


def first_documents(documents: DataFrame, most: int = MOST["document"]) -> DataFrame:
    """(document_id, d): the primary laws, else the first documents; a few rows, numbered."""
    title = F.lower("title")
    primary = title.contains("luật") & ~title.contains("nghị định")
    docs = documents.groupBy("document_id").agg(F.min("title").alias("title")).withColumn("primary", F.coalesce(primary, F.lit(False)))
    first = docs.orderBy(F.desc("primary"), "document_id").limit(most)
    # All of at most `most` rows: a primary law leaves the others out.
    return first.withColumn("any", F.max("primary").over(Window.partitionBy(F.lit(1)))).filter("primary or not any").withColumn("d", F.row_number().over(Window.orderBy("document_id"))).select("document_id", "d")


def candidates(articles: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters (document_id, chapter_id, d, at, general), articles (article_id, chapter_id, n)) of some documents (document_id, d): what can be picked, in order.
    Articles without chapter are in one of their own, ":c0"; general provisions are told by the chapter's title."""
    titled = "chapter_title" in articles.columns
    a = articles.select("article_id", "document_id", F.coalesce("chapter_id", F.concat("document_id", F.lit(":c0"))).alias("chapter_id"), *(["chapter_title"] if titled else []), "article_number").dropDuplicates(["article_id"])
    a = a.join(F.broadcast(documents), "document_id")
    general = F.coalesce(F.max(F.lower("chapter_title").contains("quy định chung")), F.lit(False)) if titled else F.lit(False)
    ch = a.groupBy("d", "document_id", "chapter_id").agg(F.min("article_number").alias("at"), general.alias("general"))
    arts = a.withColumn("n", F.row_number().over(Window.partitionBy("chapter_id").orderBy("article_number", "article_id"))).select("article_id", "chapter_id", "n")
    return ch, arts


def searched(documents: DataFrame, articles: DataFrame, queries: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """(qid, article_id, rank, confidence): the way from documents through chapters to articles.

    Without a model: the primary laws, else the first documents; their first chapters in order, of each the first articles, of all of them the first
    seven. Where a question asks for a definition and no chapter kept is one of general provisions, the first such is put in front. picks (qid, level,
    node_id, place, confidence) are what a model chose; a question without picks at a level keeps what comes without a model there.
    documents (document_id, title), articles (article_id, document_id, chapter_id, chapter_title?, article_number).
    """
    docs = first_documents(documents)
    ch, arts = candidates(articles, docs)
    order = Window.partitionBy(F.lit(1)).orderBy("d", "at", "chapter_id")
    # Chapters of at most three documents.
    ch = ch.orderBy("d", "at", "chapter_id").withColumn("c", F.row_number().over(order))
    kept = ch.filter(F.col("c") <= MOST["chapter"]).select("chapter_id", "c", "general")
    spare = ch.filter("general").filter(F.col("c") > MOST["chapter"]).orderBy("c").limit(1).select("chapter_id", F.lit(0).alias("c"), F.lit(True).alias("general"))
    asks = queries.select("qid", F.coalesce(F.lower("text").rlike("là gì|định nghĩa|khái niệm|nghĩa là|được hiểu"), F.lit(False)).alias("asks"))
    without = kept.agg(F.max(F.col("general").cast("int")).alias("g")).select((F.coalesce("g", F.lit(0)) == 0).alias("none"))
    extra = spare.join(F.broadcast(without), F.col("none")).drop("none")
    few = arts.filter(F.col("n") <= MOST["article"])
    rows = few.join(F.broadcast(kept.unionByName(extra)), "chapter_id")
    # At most seven articles of seven chapters, met by every question.
    cross = asks.join(F.broadcast(rows), (F.col("c") > 0) | F.col("asks"))
    plain = cross.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("c", "n"))).filter(F.col("rank") <= MOST["article"]).select("qid", "article_id", "rank", F.lit(UNASKED).alias("confidence"))
    if picks is None:
        return plain
    return _by_picks(articles, queries, plain, picks)


def _by_picks(articles: DataFrame, queries: DataFrame, plain: DataFrame, picks: DataFrame) -> DataFrame:
    """searched with a model's picks at the levels of chapters and articles."""
    w = Window.partitionBy("qid", "level").orderBy("place", "node_id")
    p = picks.filter("qid is not null and node_id is not null").dropDuplicates(["qid", "level", "node_id"]).withColumn("place", F.row_number().over(w))
    a = articles.select("article_id", F.coalesce("chapter_id", F.concat("document_id", F.lit(":c0"))).alias("chapter_id"), "article_number").dropDuplicates(["article_id"])
    ch = p.filter("level = 'chapter'").filter(F.col("place") <= MOST["chapter"])
    sure = ch.groupBy("qid").agg(F.avg("confidence").alias("chapter_confidence"))
    chosen = p.filter("level = 'article'").select("qid", F.col("node_id").alias("article_id"), "place", F.col("confidence").alias("article_confidence"))
    # Of chapters without a pick inside, the first articles.
    inside = chosen.join(a, "article_id").select("qid", "chapter_id").distinct()
    first = ch.select("qid", F.col("node_id").alias("chapter_id"), F.col("place").alias("c")).join(inside, ["qid", "chapter_id"], "left_anti").join(a, "chapter_id")
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("qid", "chapter_id").orderBy("article_number", "article_id"))).filter(F.col("n") <= MOST["article"])
    both = chosen.select("qid", "article_id", F.lit(0).alias("c"), F.col("place").alias("n"), "article_confidence").unionByName(first.select("qid", "article_id", "c", "n", F.lit(UNASKED).alias("article_confidence")))
    r = both.groupBy("qid", "article_id").agg(F.min(F.struct("c", "n")).alias("o"), F.max("article_confidence").alias("article_confidence")).join(a.select("article_id"), "article_id", "left_semi")
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("o", "article_id"))).filter(F.col("rank") <= MOST["article"])
    mean = r.groupBy("qid").agg(F.avg("article_confidence").alias("m")).join(sure, "qid", "left").select("qid", confidence(F.coalesce("chapter_confidence", F.lit(UNASKED)), F.col("m")).alias("confidence"))
    mine = r.join(mean, "qid").select("qid", "article_id", "rank", "confidence")
    return mine.unionByName(plain.join(mine.select("qid").distinct(), "qid", "left_anti"))


def prompts(queries: DataFrame, options: DataFrame, level: str, hints: DataFrame | None = None) -> DataFrame:
    """(qid, level, prompt): the question and its numbered options (qid, node_id, name, place); what hints (qid, node_id, score) favour is marked."""
    d = options
    if hints is not None:
        d = d.join(hints.groupBy("qid", "node_id").agg(F.max("score").alias("hint")), ["qid", "node_id"], "left")
    else:
        d = d.withColumn("hint", F.lit(None).cast("double"))
    line = F.concat(F.lit("["), F.col("place"), F.lit("] "), F.coalesce("name", "node_id"), F.when(F.col("hint").isNotNull(), F.concat(F.lit(" (★ "), F.round("hint", 2), F.lit(")"))).otherwise(""))
    g = d.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("list"))
    ask = F.concat(F.lit("Câu hỏi: "), "text", F.lit("\n"), "list", F.lit(f'\nChọn tối đa {MOST[level]}. Trả lời {{"indices": [..], "confidence": 0..1}}'))
    return queries.join(g, "qid").select("qid", F.lit(level).alias("level"), ask.alias("prompt"))


def picked(responses: DataFrame, options: DataFrame, level: str) -> DataFrame:
    """(qid, level, node_id, place, confidence): the options that responses (qid, response) name by number, those that exist, in the response's order, at most MOST.
    A response without numbers picks nothing; without confidence it is as sure as UNASKED."""
    numbers = F.regexp_extract_all(F.regexp_extract("response", r'"?indices"?\s*:\s*\[([^\]]*)\]', 1), F.lit(r"(\d{1,9})"), F.lit(1))
    sure = F.regexp_extract("response", r'"?confidence"?\s*:\s*([01](?:\.\d+)?)', 1)
    r = responses.select("qid", F.coalesce(F.nullif(sure, F.lit("")).cast("double"), F.lit(UNASKED)).alias("confidence"), F.posexplode(F.array_distinct(numbers)).alias("at", "number"))
    j = r.join(options.select("qid", "node_id", F.col("place").alias("option")), "qid").filter(F.col("number").cast("int") == F.col("option"))
    w = Window.partitionBy("qid").orderBy("at")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= MOST[level]).select("qid", F.lit(level).alias("level"), "node_id", "place", "confidence")


def with_second(first: DataFrame, second: DataFrame) -> DataFrame:
    """Picks of chapters with another where a question has one only that is less sure than SURE: the second (qid, node_id, confidence), if surer than SECOND_LEAST; both then
    have .6 of the first's confidence and .4 of the second's."""
    one = first.groupBy("qid").agg(F.count("*").alias("n"), F.max("confidence").alias("c")).filter((F.col("n") == 1) & (F.col("c") < SURE))
    more = second.filter(F.col("confidence") > SECOND_LEAST).join(first.select("qid", "node_id"), ["qid", "node_id"], "left_anti")
    more = more.join(one.select("qid", "c"), "qid").groupBy("qid").agg(F.max_by("node_id", F.struct("confidence", "node_id")).alias("node_id"), F.max("confidence").alias("second"), F.max("c").alias("c"))
    mixed = more.select("qid", "node_id", (0.6 * F.col("c") + 0.4 * F.col("second")).alias("mixed"))
    a = first.join(mixed.select("qid", "mixed"), "qid", "left").select("qid", "level", "node_id", "place", F.coalesce("mixed", "confidence").alias("confidence"))
    return a.unionByName(mixed.select("qid", F.lit("chapter").alias("level"), "node_id", F.lit(2).alias("place"), F.col("mixed").alias("confidence")))


def matched_hints(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """(qid, node_id, score): scores (qid, article_id, score) on the nodes (node_id) they mean: the node itself, else the first by id that ends with ":" and it."""
    n = nodes.select("node_id").filter("node_id is not null").distinct()
    exact = scores.join(n.select(F.col("node_id").alias("article_id")), "article_id", "left_semi").select("qid", F.col("article_id").alias("node_id"), "score")
    rest = scores.join(n.select(F.col("node_id").alias("article_id")), "article_id", "left_anti").filter("article_id is not null")
    ends = n.filter(F.contains("node_id", F.lit(":"))).groupBy(F.regexp_extract("node_id", r":([^:]+)$", 1).alias("article_id")).agg(F.min("node_id").alias("node_id"))
    return exact.unionByName(rest.join(ends, "article_id").select("qid", "node_id", "score")).groupBy("qid", "node_id").agg(F.max("score").alias("score"))


def name_path(nodes: DataFrame) -> DataFrame:
    """(node_id, trail): the names from the root to each node, joined by ' > '; a node without a title shows its id."""
    title = nodes.select(F.col("node_id").alias("at"), F.coalesce("title", "node_id").alias("name")).dropDuplicates(["at"])
    p = nodes.select("node_id", F.posexplode("path").alias("o", "at")).join(title, "at", "left")
    return p.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", F.coalesce("name", "at").alias("n")))), lambda x: x["n"]), " > ").alias("trail"))


__all__ = ["candidates", "confidence", "first_documents", "matched_hints", "name_path", "picked", "prompts", "searched", "text", "with_second"]
