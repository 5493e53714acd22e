"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.functions import dims, query, text
from lexigrid.operators import evaluate, extract, graph, hierarchy, kg, ontology, orphans, profiles, retrieve, skew, tree
from lexigrid.plans import engine, sqltext as S
from lexigrid.session import cut, table
from lexigrid.sources import io
from lexigrid.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# ---- references to records that do not exist

_SPACE = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"
_ORPHANS = f"""
    ends AS (SELECT DISTINCT relation_id, endpoint, lower(regexp_replace(k, {_SPACE})) AS k, created_at FROM (
        SELECT relation_id, 'source_id' AS endpoint, source_id AS k, created_at FROM kg_relations
        UNION ALL SELECT relation_id, 'target_id', target_id, created_at FROM kg_relations)),
    alive AS (SELECT DISTINCT lower(regexp_replace(id, {_SPACE})) AS k, created_at AS a, deleted_at AS b FROM kg_entities),
    orphan AS (SELECT relation_id, endpoint, k, created_at FROM ends WHERE k <> '' AND NOT EXISTS (
        SELECT 1 FROM alive WHERE alive.k = ends.k AND a <= ends.created_at AND (b IS NULL OR b > ends.created_at)))
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "kg_relations"), ["source_id", "target_id"], "relation_id", "created_at", table(spark, d, "kg_entities"), "id", "created_at", "deleted_at")


@registered(f"WITH {_ORPHANS} SELECT DISTINCT relation_id, endpoint FROM orphan")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(F.col("ref_id").alias("relation_id"), "endpoint").distinct()


@registered(f"WITH {_ORPHANS} SELECT 'kg_relations' AS tbl, endpoint, strftime(created_at, '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT k) AS keys FROM orphan GROUP BY ALL")
def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(_orphans(spark, d), "kg_relations")


# ---- the tables as the operators take them

_ART = "(SELECT id, min(document_id) AS document_id, min(chapter_id) AS chapter_id, min(section_id) AS section_id, min(article_number) AS article_number, min(title) AS title, min(content) AS content FROM legal_articles WHERE id IS NOT NULL GROUP BY id)"
_ENT = "(SELECT id, min(name) AS name, min(type_str) AS type_str FROM kg_entities WHERE deleted_at IS NULL AND id IS NOT NULL GROUP BY id)"
_MEN = f"(SELECT DISTINCT id AS entity_id, source_ids[o] AS article_id, {S.article_number('source_ids[o]')} AS article_number, CAST(o - 1 AS INTEGER) AS ord FROM kg_entities, LATERAL (SELECT unnest(range(1, len(source_ids) + 1)) AS o) WHERE deleted_at IS NULL AND id IS NOT NULL)"
_EDGE = f"""(SELECT DISTINCT lower(trim(source_id)) AS src, lower(trim(target_id)) AS dst, relation_type, CASE WHEN CAST(confidence AS VARCHAR) <> 'nan' AND confidence BETWEEN 0 AND 1 THEN confidence ELSE 0.5 END AS confidence
    FROM kg_relations WHERE lower(trim(source_id)) IN (SELECT id FROM {_ENT}) AND lower(trim(target_id)) IN (SELECT id FROM {_ENT}))"""


def _corpus(spark: SparkSession, d: str) -> engine.Corpus:
    return engine.corpus(table(spark, d, "legal_documents"), table(spark, d, "legal_articles"), table(spark, d, "kg_entities"), table(spark, d, "kg_relations"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), F.col("question").alias("text")).distinct()


# ---- scans and statistics


@registered("SELECT 'legal_documents' AS tbl, count(*) AS n FROM legal_documents UNION ALL SELECT 'legal_articles', count(*) FROM legal_articles UNION ALL SELECT 'kg_entities', count(*) FROM kg_entities UNION ALL SELECT 'kg_relations', count(*) FROM kg_relations")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.table_counts(**{t: table(spark, d, t) for t in ("legal_documents", "legal_articles", "kg_entities", "kg_relations")})


@registered("SELECT DISTINCT document_id, id, pos, CAST(rank() OVER (PARTITION BY document_id ORDER BY pos, id) AS INTEGER) AS place FROM (SELECT DISTINCT document_id, id, pos FROM legal_articles WHERE section_id IS NULL)")
def scan_children_ordered(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "legal_articles").filter("section_id is null").select("document_id", "id", "pos").distinct()
    return a.withColumn("place", F.rank().over(Window.partitionBy("document_id").orderBy(F.asc_nulls_last("pos"), "id")))


@registered("SELECT DISTINCT id, so_hieu, title, created_at FROM legal_documents WHERE created_at IS NOT NULL")
def documents_recent(spark: SparkSession, d: str) -> DataFrame:
    """All documents, the latest first."""
    t = table(spark, d, "legal_documents").filter("created_at is not null").select("id", "so_hieu", "title", "created_at").distinct()
    return t.orderBy(F.desc("created_at"), F.asc_nulls_last("so_hieu"), F.asc_nulls_last("title"))


@registered("SELECT DISTINCT id, title, content FROM legal_articles WHERE id = (SELECT min(id) FROM legal_articles)")
def article_lookup(spark: SparkSession, d: str) -> DataFrame:
    """An article by its id: the filter reaches the scan."""
    first = table(spark, d, "legal_articles").agg(F.min("id")).first()[0]
    return table(spark, d, "legal_articles").filter(F.col("id") == first).select("id", "title", "content").distinct()


@registered("SELECT DISTINCT a.id, a.document_id, d.title AS document_title FROM legal_articles a JOIN (SELECT id, min(title) AS title FROM legal_documents GROUP BY id) d ON a.document_id = d.id")
def eager_parents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "legal_documents").groupBy(F.col("id").alias("document_id")).agg(F.min("title").alias("document_title"))
    return table(spark, d, "legal_articles").select("id", "document_id").join(docs, "document_id").select("id", "document_id", "document_title").distinct()


_NODES = f"""art AS (SELECT *, coalesce(chapter_id, nullif(regexp_extract(section_id, '^(.*):m\\d+$', 1), '')) AS ch FROM {_ART} WHERE document_id IS NOT NULL),
    nodes AS (SELECT id AS node_id, 'document' AS node_type, NULL AS parent_id, id AS document_id, 0 AS ord, [id] AS path FROM (SELECT DISTINCT id FROM legal_documents WHERE id IS NOT NULL)
    UNION ALL SELECT ch, 'chapter', document_id, document_id, min(article_number), [document_id, ch] FROM art WHERE ch IS NOT NULL GROUP BY document_id, ch
    UNION ALL SELECT section_id, 'section', ch, document_id, min(article_number), [document_id, ch, section_id] FROM art WHERE section_id IS NOT NULL GROUP BY document_id, ch, section_id
    UNION ALL SELECT id, 'article', coalesce(section_id, ch, document_id), document_id, article_number, list_filter([document_id, ch, section_id, id], lambda x: x IS NOT NULL) FROM art)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.nodes(table(spark, d, "legal_documents"), table(spark, d, "legal_articles"))


@registered(f"WITH {_NODES} SELECT node_id, node_type, parent_id, CAST(len(path) - 1 AS INTEGER) AS depth, array_to_string(path, ' > ') AS trail FROM nodes")
def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("node_id", "node_type", "parent_id", "depth", F.array_join("path", " > ").alias("trail"))


@registered(f"WITH {_NODES} SELECT node_type, count(*) AS nodes, count(DISTINCT document_id) AS documents, CAST(max(len(path) - 1) AS INTEGER) AS deepest FROM nodes GROUP BY node_type")
def forest_stats(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.statistics(_nodes(spark, d))


@registered(f"WITH {_NODES} SELECT parent_id, node_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY ord NULLS FIRST, node_id) AS INTEGER) AS place FROM nodes WHERE parent_id IS NOT NULL")
def tree_children(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.children(_nodes(spark, d))


@registered(f"WITH {_NODES}, x AS (SELECT node_id, unnest(path) AS root FROM nodes) SELECT root, count(*) AS below FROM x WHERE root IN (SELECT node_id FROM nodes WHERE node_type = 'chapter') GROUP BY root")
def subtree_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return hierarchy.subtree(n, n.filter("node_type = 'chapter'").select(F.col("node_id").alias("root"))).groupBy("root").agg(F.count("*").alias("below"))


@registered("SELECT chapter_id, first, last, CASE WHEN first = last THEN 'Điều ' || first ELSE 'Điều ' || first || '-' || last END AS article_range, articles FROM (SELECT chapter_id, min(article_number) AS first, max(article_number) AS last, count(DISTINCT id) AS articles FROM legal_articles WHERE chapter_id IS NOT NULL AND article_number IS NOT NULL GROUP BY chapter_id)")
def chapter_ranges(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.chapter_ranges(table(spark, d, "legal_articles"))


_CUT = "CASE WHEN length(x) <= 300 THEN x WHEN regexp_extract(left(x, 300), '(?s)^(.*\\.)', 1) <> '' THEN regexp_extract(left(x, 300), '(?s)^(.*\\.)', 1) ELSE left(x, 300) END"
_KEYS = rf"list_filter(regexp_extract_all(x, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: length(w) >= 2 AND NOT list_contains({S.listed(dims.KEYWORD_STOP_WORDS)}, lower(w)) AND NOT regexp_matches(w, '^[0-9]+$'))"


@registered(f"""WITH a AS (SELECT id, concat_ws(' ', title, content) AS x, trim(coalesce(content, '')) AS c FROM {_ART}), k AS (SELECT id, c, {_KEYS} AS k FROM a), l AS (SELECT id, c, k, list_transform(k, lambda w: lower(w)) AS l FROM k)
    SELECT id AS article_id, array_to_string((list_filter(k, lambda w, i: list_position(l, lower(w)) = i))[1:15], ', ') AS keywords, {_CUT.replace('300', '200').replace('(x', '(c').replace(' x', ' c')} AS description FROM l""")
def article_summaries(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.article_summaries(table(spark, d, "legal_articles"))


@registered(f"""WITH x AS (SELECT document_id, article_number AS n, regexp_replace(trim(content), '(?i)^(phạm vi điều chỉnh|đối tượng áp dụng)[:. ]*', '') AS x FROM {_ART}), sc AS (SELECT document_id, max({_CUT}) FILTER (WHERE n = 1) AS scope, max({_CUT}) FILTER (WHERE n = 2) AS subjects FROM x GROUP BY document_id)
    SELECT doc.id AS doc_id, so_hieu, loai_van_ban AS doc_type, doc.title, scope, subjects, coalesce(n_ch, 0) AS num_chapters, coalesce(n_art, 0) AS num_articles FROM
    (SELECT id, min(so_hieu) AS so_hieu, min(title) AS title, min(loai_van_ban) AS loai_van_ban FROM legal_documents WHERE id IS NOT NULL GROUP BY id) doc
    LEFT JOIN (SELECT document_id, count(DISTINCT chapter_id) AS n_ch, count(*) AS n_art FROM {_ART} GROUP BY document_id) a ON a.document_id = doc.id LEFT JOIN sc ON sc.document_id = doc.id""")
def document_summaries(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.document_summaries(table(spark, d, "legal_documents"), table(spark, d, "legal_articles"))


# ---- text functions


@registered(f"SELECT DISTINCT name, {S.slug('name')} AS slug, {S.canonical('name')} AS canonical FROM kg_entities WHERE name IS NOT NULL")
def text_slug(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return table(spark, d, "kg_entities").filter("name is not null").select("name", text.slug(n).alias("slug"), text.canonical(n).alias("canonical")).distinct()


@registered(f"""SELECT item_id, array_to_string(list_filter(regexp_extract_all(question, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: length(w) >= 2 AND NOT list_contains({S.listed(dims.KEYWORD_STOP_WORDS)}, lower(w)) AND NOT regexp_matches(w, '^[0-9]+$')), ' ') AS keywords,
    len({S.ngrams(S.words('question'), 2)}) AS bigrams, array_to_string(list_sort({S.terms('question')}), ' ') AS terms FROM (SELECT DISTINCT item_id, question FROM eval_items)""")
def text_keywords(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    t = table(spark, d, "eval_items").select("item_id", "question").distinct()
    return t.select("item_id", F.array_join(text.keywords(q), " ").alias("keywords"), F.size(text.ngrams(text.words(q), 2)).cast("long").alias("bigrams"), F.array_join(F.array_sort(text.terms(q)), " ").alias("terms"))


@registered(f"SELECT DISTINCT so_hieu, {S.document_number('so_hieu')} AS number, regexp_replace({S.document_number('so_hieu')}, '-(CP|BTC|BKHDT|BXD|BCT|NHNN|TTg|UBND|HDND)$', '') AS reference FROM legal_documents WHERE so_hieu IS NOT NULL")
def document_numbers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("so_hieu")
    return table(spark, d, "legal_documents").filter("so_hieu is not null").select("so_hieu", text.document_number(c).alias("number"), text.reference_number(c).alias("reference")).distinct()


@registered(f"SELECT DISTINCT id, {S.article_number('id')} AS number, split_part(id, ':', 1) AS document, 'Điều ' || article_number AS citation FROM legal_articles WHERE id IS NOT NULL AND article_number IS NOT NULL")
def citations(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "legal_articles").filter("id is not null and article_number is not null")
    none = F.lit(None)
    return t.select("id", text.article_number(F.col("id")).alias("number"), text.document_of(F.col("id")).alias("document"), text.citation(F.col("article_number"), none.cast("int"), none.cast("string")).alias("citation")).distinct()


_CIT = r"(?i)điều\s+(\d{1,6})", r"(?i)khoản\s+(\d{1,6})", r"(?i)điểm\s+([a-zđ])(?:[^\p{L}]|$)"


@registered(f"SELECT DISTINCT name, CAST(nullif(regexp_extract(name, '{_CIT[0]}', 1), '') AS INTEGER) AS article, CAST(nullif(regexp_extract(name, '{_CIT[1]}', 1), '') AS INTEGER) AS clause, lower(nullif(regexp_extract(name, '{_CIT[2]}', 1), '')) AS point FROM kg_entities WHERE type_str = 'LEGAL_REFERENCE' AND name IS NOT NULL")
def citation_parse(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "kg_entities").filter("type_str = 'LEGAL_REFERENCE' and name is not null").select("name").distinct()
    return t.withColumn("p", text.parse_citation(F.col("name"))).select("name", "p.*")


@registered(r"""SELECT doc_id, try_cast(y || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) AS first_date FROM (SELECT doc_id, regexp_extract(text, p, 1) AS dd, regexp_extract(text, p, 2) AS m, regexp_extract(text, p, 3) AS y FROM
    (SELECT DISTINCT doc_id, text, '(?i)(?:ngày\s+)?(\d{1,2})(?:\s*[/-]\s*|\s+tháng\s+)(\d{1,2})(?:\s*[/-]\s*|\s+năm\s+)(\d{4})' AS p FROM documents WHERE text IS NOT NULL)) WHERE y <> ''""")
def first_dates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", "text").distinct()
    pattern = r"(?iu)(?:ngày\s+)?\d{1,2}(?:\s*[/-]\s*|\s+tháng\s+)\d{1,2}(?:\s*[/-]\s*|\s+năm\s+)\d{4}"
    return t.filter(F.col("text").rlike(pattern)).select("doc_id", text.vietnamese_date(F.col("text")).alias("first_date"))


@registered("SELECT i AS roman, n AS value FROM " + S.values([("I", 1), ("IV", 4), ("IX", 9), ("XIV", 14), ("XL", 40), ("XCIX", 99), ("ABC", 1)], "i, n"))
def roman_numbers(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(x,) for x in ("I", "IV", "IX", "XIV", "XL", "XCIX", "ABC")], "roman string")
    return t.select("roman", text.roman(F.col("roman")).alias("value"))


# ---- questions


@registered(f"SELECT item_id AS qid, {S.intent('question')} AS intent, {S.query_type('question')} AS query_type, array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(question, '[Đđ]iều\\s+(\\d{{1,9}})', 1), regexp_extract_all(question, '[Đđ]\\.\\s*(\\d{{1,9}})', 1)), lambda x: CAST(x AS INTEGER)))), ',') AS article_refs FROM (SELECT DISTINCT item_id, question FROM eval_items)")
def query_intent(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("text")
    return _questions(spark, d).select("qid", query.intent(q).alias("intent"), query.query_type(q).alias("query_type"), F.array_join(query.article_refs(q), ",").alias("article_refs"))


@registered(f"SELECT doc_id AS qid, {S.intent('text')} AS intent, {S.query_type('text')} AS query_type FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)")
def document_intent(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", "text").distinct()
    return t.select(F.col("doc_id").alias("qid"), query.intent(F.col("text")).alias("intent"), query.query_type(F.col("text")).alias("query_type"))


@registered()
def query_analysis(spark: SparkSession, d: str) -> DataFrame:
    return query.analyzed(_questions(spark, d))


@registered(f"SELECT t.query_type, method, CAST(alpha AS DOUBLE) AS alpha, hops, count(*) AS n FROM (SELECT {S.query_type('question')} AS query_type FROM (SELECT DISTINCT item_id, question FROM eval_items)) t JOIN (SELECT * FROM {S.values([r[:4] for r in dims.STRATEGIES], 'query_type, method, alpha, hops')}) USING (query_type) GROUP BY ALL".replace("t.query_type, method", "query_type, method"))
def query_strategy(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame(list(dims.STRATEGIES), "query_type string, method string, alpha double, hops int, reasoning boolean, temporal boolean")
    t = _questions(spark, d).select(query.query_type(F.col("text")).alias("query_type"))
    return t.join(F.broadcast(s), "query_type").groupBy("query_type", "method", "alpha", "hops").agg(F.count("*").alias("n"))


@registered()
def detected_documents(spark: SparkSession, d: str) -> DataFrame:
    return query.detected_documents(table(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")


# ---- keyphrases and combination

_KEYPHRASE = f"""q AS (SELECT DISTINCT item_id AS qid, lower(question) AS q FROM eval_items WHERE question IS NOT NULL),
    names AS (SELECT DISTINCT lower(name) AS n FROM {_ENT} WHERE name IS NOT NULL),
    prep AS (SELECT qid, q, {S.terms('q')} AS qt, {S.words('q')} AS qw FROM q), prep2 AS (SELECT *, {S.ngrams('qw', 2)} AS g2, {S.ngrams('qw', 3)} AS g3 FROM prep),
    nn AS (SELECT n, {S.words('n')} AS nw FROM names),
    s0 AS (SELECT qid, n, q, g2, g3, len(list_filter(qt, lambda w: list_contains(nw, w))) AS ov, len(qt) AS nt FROM prep2, nn WHERE len(qt) > 0),
    s1 AS (SELECT *, CASE WHEN ov > 0 THEN ov / nt * CASE WHEN ov >= 2 THEN 1.5 ELSE 1 END ELSE 0 END AS s FROM s0),
    s2 AS (SELECT * REPLACE (CASE WHEN len(list_filter(g2, lambda g: contains(n, g))) > 0 THEN greatest(s, 0.5) * 1.5 ELSE s END AS s) FROM s1),
    s3 AS (SELECT * REPLACE (CASE WHEN len(list_filter(g3, lambda g: contains(n, g))) > 0 THEN greatest(s, 0.7) * 1.5 ELSE s END AS s) FROM s2),
    s4 AS (SELECT qid, n, least(1.0, CASE WHEN contains(q, n) THEN greatest(s, 0.8) * 1.5 WHEN contains(n, q) THEN greatest(s, 0.6) * 1.2 ELSE s END) AS score FROM s3),
    keyphrase AS (SELECT qid, e.id AS entity_id, score FROM s4 JOIN {_ENT} e ON lower(e.name) = n WHERE score > 0)"""


@registered(f"WITH {_KEYPHRASE} SELECT qid, entity_id, round(score, 6) AS score FROM keyphrase")
def keyphrase_score(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.keyphrase_scores(_questions(spark, d), _corpus(spark, d).entities).select("qid", "entity_id", F.round("score", 6).alias("score"))


@registered(f"WITH {_KEYPHRASE}, m AS (SELECT DISTINCT qid, article_id, k.entity_id, score FROM keyphrase k JOIN {_MEN} m ON m.entity_id = k.entity_id) SELECT qid, article_id, round(max(score) + 0.3 * ln(count(*) + 1) * avg(score), 6) AS keyphrase FROM m GROUP BY ALL")
def keyphrase_articles(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return retrieve.mentioned_keyphrase(_questions(spark, d), c.entities, c.mentions).select("qid", "article_id", F.round("keyphrase", 6).alias("keyphrase"))


_COMP = """comp AS (SELECT qid, article_id, max(CASE WHEN component = 'keyphrase' THEN score END) AS keyphrase, max(CASE WHEN component = 'semantic' THEN score END) AS semantic,
    max(CASE WHEN component = 'ppr' THEN score END) AS ppr, max(CASE WHEN component = 'filtered' THEN score END) AS concept FROM (
    SELECT qid, article_id, component, arg_max(score, (coalesce(epoch_us(scored_at), -4611686018427387904), score)) AS score FROM component_scores WHERE score IS NOT NULL AND CAST(score AS VARCHAR) <> 'nan' GROUP BY ALL) GROUP BY ALL)"""
_LOW = f"{_COMP}, lw AS (SELECT qid, article_id, 0.05 * coalesce(keyphrase, 0) + 0.2 * coalesce(semantic, 0) + 0.25 * coalesce(ppr, 0) + 0.2 * coalesce(concept, 0) AS s FROM comp), low AS (SELECT qid, article_id, CASE WHEN t > 0 THEN s / t ELSE s END AS low FROM lw JOIN (SELECT qid, max(s) AS t FROM lw GROUP BY qid) USING (qid))"


def _components(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "component_scores").filter("score is not null and not isnan(score)")
    at = F.coalesce(F.unix_micros(F.col("scored_at").cast("timestamp")), F.lit(-(2**62)))
    s = t.groupBy("qid", "article_id", "component").agg(F.max_by("score", F.struct(at, "score")).alias("score"))
    pick = lambda c, n: F.max(F.when(F.col("component") == c, F.col("score"))).alias(n)
    return s.groupBy("qid", "article_id").agg(pick("keyphrase", "keyphrase"), pick("semantic", "semantic"), pick("ppr", "ppr"), pick("filtered", "concept"))


def _low(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.low_level(_components(spark, d))


@registered(f"WITH {_LOW} SELECT qid, article_id, round(low, 6) AS low FROM low")
def low_level_combine(spark: SparkSession, d: str) -> DataFrame:
    return _low(spark, d).withColumn("low", F.round("low", 6))


_DUAL = f"{_LOW}, hi AS (SELECT qid, article_id, semantic AS theme, ppr AS hierarchy FROM comp), dual AS (SELECT qid, article_id, round(0.7 * low + 0.15 * coalesce(theme, 0) + 0.15 * coalesce(hierarchy, 0), 6) AS score FROM low JOIN hi USING (qid, article_id)), dr AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, article_id) AS INTEGER) AS rank FROM dual WHERE score >= 0.1)"


def _dual(spark: SparkSession, d: str) -> DataFrame:
    c = _components(spark, d)
    f = retrieve.fused(retrieve.low_level(c), c.select("qid", "article_id", F.col("semantic").alias("theme")), c.select("qid", "article_id", F.col("ppr").alias("hierarchy")), least=-1e18)
    return f.withColumn("score", F.round("score", 6)).filter("score >= 0.1")


@registered(f"WITH {_DUAL} SELECT qid, article_id, score, rank FROM dr")
def dual_fuse(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.ranked(_dual(spark, d))


@registered(f"WITH {_DUAL} SELECT qid, article_id, score, rank FROM dr WHERE rank <= 10")
def dual_top10(spark: SparkSession, d: str) -> DataFrame:
    """The first ten: the limit is the feature."""
    return retrieve.ranked(_dual(spark, d), k=10)


@registered(f"WITH {_DUAL} SELECT qid, article_id, score, CAST(rank() OVER (PARTITION BY qid ORDER BY score DESC) AS INTEGER) AS dual_rank FROM dual WHERE score >= 0.1")
def dual_rank(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.shared_rank(_dual(spark, d))


# ---- fusion of rankings: keyphrase as the tree's list, semantic as the dual list, ppr as the graph's


def _lists(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    c = _components(spark, d)
    one = lambda n: retrieve.ranked(c.filter(F.col(n).isNotNull()).select("qid", "article_id", F.col(n).alias("score")))
    return {"tree": one("keyphrase"), "dual": one("semantic"), "kg": one("ppr")}


def _list_sql(c: str, n: str) -> str:
    return f"{n} AS (SELECT qid, article_id, {c} AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY {c} DESC, article_id) AS INTEGER) AS rank FROM comp WHERE {c} IS NOT NULL)"


_LISTS = f"{_COMP}, {_list_sql('keyphrase', 'l_tree')}, {_list_sql('semantic', 'l_dual')}, {_list_sql('ppr', 'l_kg')}"
_RRF = f"{_LISTS}, u AS (SELECT qid, article_id, 0.8 / (60 + rank) AS s, 0 AS o, 'tree' AS source FROM l_tree UNION ALL SELECT qid, article_id, 1.0 / (60 + rank), 1, 'dual' FROM l_dual UNION ALL SELECT qid, article_id, 1.2 / (60 + rank), 2, 'kg' FROM l_kg), rrf AS (SELECT qid, article_id, sum(s) AS score, arg_min(source, o) AS source FROM u GROUP BY ALL HAVING sum(s) >= 0.005)"


@registered(f"WITH {_RRF} SELECT qid, article_id, round(score, 6) AS score, source FROM rrf")
def rrf_merge(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.rrf(_lists(spark, d)).withColumn("score", F.round("score", 6))


@registered(f"WITH {_LISTS}, u AS (SELECT qid, article_id, 1.0 / (60 + rank) AS s FROM l_dual UNION ALL SELECT qid, article_id, 0.8 / (60 + rank) FROM l_kg) SELECT qid, article_id, round(sum(s), 6) AS score FROM u GROUP BY ALL")
def rrf_dual_kg(spark: SparkSession, d: str) -> DataFrame:
    x = _lists(spark, d)
    return retrieve.rrf({"dual": x["dual"], "kg": x["kg"]}, {"dual": 1.0, "kg": 0.8}, least=None).select("qid", "article_id", F.round("score", 6).alias("score"))


@registered(f"WITH {_LISTS}, cf AS (SELECT DISTINCT qid, (qid % 10) / 10.0 AS confidence FROM comp), w AS (SELECT qid, CASE WHEN confidence >= 0.7 THEN 0.7 WHEN confidence >= 0.5 THEN 0.5 ELSE 0.3 END AS w FROM cf), u AS (SELECT qid, article_id, w / (60 + rank) AS s FROM l_tree JOIN w USING (qid) UNION ALL SELECT qid, article_id, (1 - w) / (60 + rank) FROM l_kg JOIN w USING (qid)) SELECT qid, article_id, round(sum(s), 6) AS score FROM u GROUP BY ALL")
def confidence_merge(spark: SparkSession, d: str) -> DataFrame:
    x = _lists(spark, d)
    conf = _components(spark, d).select("qid").distinct().withColumn("confidence", (F.col("qid") % 10) / 10.0)
    return retrieve.weighted_by_confidence(x["tree"], x["kg"], conf).select("qid", "article_id", F.round("score", 6).alias("score"))


@registered(f"""WITH {_LISTS}, seeds AS (SELECT DISTINCT qid, article_id FROM l_tree WHERE rank <= 5), near AS (SELECT qid, a.document_id, a.article_number + k AS n, min(abs(k)) AS distance FROM seeds JOIN {_ART} a ON a.id = seeds.article_id, (SELECT unnest([-2, -1, 1, 2]) AS k) WHERE a.article_number + k > 0 GROUP BY ALL)
    SELECT near.qid, b.id AS article_id, CAST(distance AS INTEGER) AS distance, CAST(round(greatest(0.2, 0.4 - 0.05 * distance), 6) AS DOUBLE) AS score FROM near JOIN {_ART} b ON b.document_id = near.document_id AND b.article_number = near.n WHERE length(trim(b.content)) > 0 AND NOT EXISTS (SELECT 1 FROM seeds WHERE seeds.qid = near.qid AND seeds.article_id = b.id)""")
def adjacent_expand(spark: SparkSession, d: str) -> DataFrame:
    seeds = _lists(spark, d)["tree"].filter("rank <= 5")
    return retrieve.neighbours(seeds, _corpus(spark, d).articles)


@registered(f"""WITH {_LISTS}, t AS (SELECT DISTINCT qid, article_id FROM l_tree), g AS (SELECT DISTINCT qid, article_id FROM l_dual WHERE rank <= 5), sz AS (SELECT qid, count(t.article_id) AS nt FROM t GROUP BY qid), sg AS (SELECT qid, count(*) AS nd FROM g GROUP BY qid), n AS (SELECT qid, count(*) AS n FROM t JOIN g USING (qid, article_id) GROUP BY qid),
    r AS (SELECT qid, coalesce(n, 0) AS common, coalesce(n, 0) / greatest(1, least(coalesce(nt, 0), coalesce(nd, 0))) AS ratio FROM sz FULL JOIN sg USING (qid) LEFT JOIN n USING (qid))
    SELECT qid, common, round(ratio, 6) AS ratio, round(CASE WHEN ratio >= 0.7 THEN 0.6 WHEN ratio <= 0.3 THEN 0.4 ELSE 0.4 + (ratio - 0.3) / 0.4 * 0.2 END, 6) AS threshold FROM r""")
def tree_dual_overlap(spark: SparkSession, d: str) -> DataFrame:
    x = _lists(spark, d)
    o = retrieve.overlap(x["tree"], x["dual"])
    return o.select("qid", "common", F.round("ratio", 6).alias("ratio"), F.round(retrieve.adaptive_threshold(F.col("ratio")), 6).alias("threshold"))


@registered(f"""WITH {_LISTS}, have AS (SELECT DISTINCT qid, article_id FROM l_tree WHERE rank <= 5), ch AS (SELECT id AS article_id, chapter_id FROM {_ART} WHERE chapter_id IS NOT NULL), g AS (SELECT DISTINCT qid, article_id FROM l_dual WHERE rank <= 5),
    o AS (SELECT qid, (SELECT count(*) FROM g WHERE g.qid = h.qid AND EXISTS (SELECT 1 FROM have x WHERE x.qid = g.qid AND x.article_id = g.article_id)) / greatest(1, least(count(*), (SELECT count(*) FROM g WHERE g.qid = h.qid))) AS ratio FROM have h GROUP BY qid),
    miss AS (SELECT l.* FROM l_dual l WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM have h WHERE h.qid = l.qid AND h.article_id = l.article_id)),
    fresh AS (SELECT m.qid, m.article_id, m.score FROM miss m JOIN o ON o.qid = m.qid AND ratio < 0.4 JOIN ch USING (article_id) WHERE NOT EXISTS (SELECT 1 FROM have h JOIN ch c2 ON c2.article_id = h.article_id WHERE h.qid = m.qid AND c2.chapter_id = ch.chapter_id) QUALIFY row_number() OVER (PARTITION BY m.qid ORDER BY score DESC, m.article_id) <= 3),
    u AS (SELECT qid, article_id, score, 'chapter' AS why FROM fresh UNION ALL SELECT qid, article_id, score, 'score' FROM miss WHERE rank <= 7 AND score > 0.55) SELECT qid, article_id, round(max(score), 6) AS score, min(why) AS why FROM u GROUP BY ALL""")
def cross_check(spark: SparkSession, d: str) -> DataFrame:
    """The tree has the first five of its list here, so that dual has something to add."""
    x = _lists(spark, d)
    return retrieve.cross_check(x["tree"].filter("rank <= 5"), x["dual"], _corpus(spark, d).articles).withColumn("score", F.round("score", 6))


@registered(f"WITH {_RRF}, c AS (SELECT qid, article_id, round(score, 9) AS score, substring(content, 1, 200) AS head FROM rrf JOIN {_ART} a ON a.id = rrf.article_id) SELECT qid, article_id, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY qid, head ORDER BY score DESC, article_id) = 1")
def text_truncate_dedupe(spark: SparkSession, d: str) -> DataFrame:
    r = retrieve.rrf(_lists(spark, d)).withColumn("score", F.round("score", 9)).join(_corpus(spark, d).articles.select("article_id", "content"), "article_id")
    return retrieve.without_repeats(r).select("qid", "article_id", F.round("score", 6).alias("score"))


@registered(f"WITH {_LISTS}, b AS (SELECT * FROM l_tree WHERE rank <= 15), s AS (SELECT b.qid, b.article_id, b.rank AS original_rank, 0.6 * coalesce(c.ppr, 0) + 0.4 * b.score AS blended FROM b JOIN comp c USING (qid, article_id)) SELECT qid, article_id, original_rank, round(blended, 6) AS blended, CAST(row_number() OVER (PARTITION BY qid ORDER BY blended DESC, article_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5")
def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    """The first 15 by the blend with a model's score, five of them: the limits are the feature."""
    t = _lists(spark, d)["tree"].join(_components(spark, d).select("qid", "article_id", F.coalesce("ppr", F.lit(0.0)).alias("model")), ["qid", "article_id"])
    return retrieve.reranked(t, "model", 5).select("qid", "article_id", "original_rank", F.round("blended", 6).alias("blended"), "rank")


_ASKED = "(SELECT DISTINCT item_id AS qid, question FROM eval_items)"
_VAGUE = "như thế nào|ra sao|thế nào|làm sao|là gì"


@registered(rf"""WITH {_LISTS}, t AS (SELECT DISTINCT qid, article_id FROM l_tree), g AS (SELECT DISTINCT qid, article_id FROM l_dual WHERE rank <= 5), n AS (SELECT qid, count(*) FILTER (WHERE (qid, article_id) IN (SELECT qid, article_id FROM g)) / greatest(1, least(count(*), (SELECT count(*) FROM g WHERE g.qid = t.qid))) AS ratio FROM t GROUP BY qid),
    th AS (SELECT qid, CASE WHEN ratio >= 0.7 THEN 0.6 WHEN ratio <= 0.3 THEN 0.4 ELSE 0.4 + (ratio - 0.3) / 0.4 * 0.2 END AS threshold FROM n),
    am AS (SELECT qid, greatest(0.7, 1 - 0.075 * (CAST(len({S.words('question')}) <= 3 AS INTEGER) + CAST(len(list_concat(regexp_extract_all(question, '[Đđ]iều\s+(\d{{1,9}})', 1), regexp_extract_all(question, '[Đđ]\.\s*(\d{{1,9}})', 1))) = 0 AS INTEGER) + CAST({S.query_type('question')} = 'general' AS INTEGER) + CAST((qid % 10) / 10.0 < 0.5 AS INTEGER) + CAST(regexp_matches(question, '(?i)({_VAGUE})') AS INTEGER))) AS calibration FROM {_ASKED})
    SELECT l.qid, article_id, round(score, 6) AS score, round(coalesce(threshold, 0.5) * coalesce(calibration, 1.0), 6) AS threshold FROM l_dual l LEFT JOIN th USING (qid) LEFT JOIN am USING (qid) WHERE score >= coalesce(threshold, 0.5) * coalesce(calibration, 1.0)""")
def calibrated_filter(spark: SparkSession, d: str) -> DataFrame:
    """What dual has from the threshold on that follows the overlap with the tree, lowered for unclear questions."""
    x = _lists(spark, d)
    th = retrieve.overlap(x["tree"], x["dual"]).select("qid", retrieve.adaptive_threshold(F.col("ratio")).alias("threshold"))
    q = _questions(spark, d)
    c = F.col("text")
    cal = q.select("qid", retrieve.ambiguity(c, query.query_type(c), query.article_refs(c), (F.col("qid") % 10) / 10.0).alias("calibration"))
    limit = F.coalesce("threshold", F.lit(retrieve.FIXED_THRESHOLD)) * F.coalesce("calibration", F.lit(1.0))
    kept = retrieve.calibrated(x["dual"].drop("rank"), th, cal)
    return kept.join(th, "qid", "left").join(cal, "qid", "left").select("qid", "article_id", F.round("score", 6).alias("score"), F.round(limit, 6).alias("threshold"))


@registered("SELECT c, a, round(least(0.95, 0.45 * c + 0.55 * a), 6) AS confidence FROM (SELECT unnest([0.0, 0.5, 0.9, 1.0]) AS c), (SELECT unnest([0.0, 0.5, 1.0]) AS a)")
def tree_confidence(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(float(c), float(a)) for c in (0, 0.5, 0.9, 1) for a in (0, 0.5, 1)], "c double, a double")
    return t.select("c", "a", F.round(tree.confidence(F.col("c"), F.col("a")), 6).alias("confidence"))


def _doc_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _lists(spark, d)["tree"].select("qid", "article_id", "score")
    return s.withColumn("number", F.split_part("article_id", F.lit("-"), F.lit(1))).withColumn("year", F.split_part("article_id", F.lit("-"), F.lit(2))).withColumn("doc_type", F.when(F.col("article_id").contains("-TT-"), "thong_tu").when(F.col("article_id").contains("-ND-"), "nghi_dinh").otherwise("khac"))


def _doc_hints(spark: SparkSession, d: str) -> DataFrame:
    q = _components(spark, d).select("qid").distinct()
    t = F.when(F.col("qid") % 3 == 0, "thong_tu").when(F.col("qid") % 3 == 1, "nghi_dinh")
    return q.select("qid", t.alias("doc_type"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("year")).filter("doc_type is not null")


_DOCF = f"WITH {_LISTS}, x AS (SELECT qid, article_id, score, CASE WHEN contains(article_id, '-TT-') THEN 'thong_tu' WHEN contains(article_id, '-ND-') THEN 'nghi_dinh' ELSE 'khac' END AS t, CASE qid % 3 WHEN 0 THEN 'thong_tu' WHEN 1 THEN 'nghi_dinh' END AS h FROM l_tree)"


@registered(f"{_DOCF} SELECT qid, article_id, round(CASE WHEN t = h THEN score * 2 ELSE score END, 6) AS score FROM x")
def doc_filter_boost(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.filtered_by_document(_doc_scores(spark, d), _doc_hints(spark, d), "boost").select("qid", "article_id", F.round("score", 6).alias("score"))


@registered(f"{_DOCF} SELECT qid, article_id, round(score, 6) AS score FROM x WHERE h IS NULL OR t = h")
def doc_filter_only(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.filtered_by_document(_doc_scores(spark, d), _doc_hints(spark, d), "filter").select("qid", "article_id", F.round("score", 6).alias("score"))


@registered(f"{_DOCF} SELECT qid, article_id, round(CASE WHEN h IS NULL THEN score WHEN t = h THEN score * 2 ELSE score * 0.5 END, 6) AS score FROM x")
def doc_filter_rerank(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.filtered_by_document(_doc_scores(spark, d), _doc_hints(spark, d), "rerank").select("qid", "article_id", F.round("score", 6).alias("score"))


_COS = "round(coalesce(list_dot_product(a, b) / nullif(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 0), 0), 6)"
_VEC = "v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS a, label FROM embeddings), qv AS (SELECT vec_id AS qid, a AS b FROM v WHERE vec_id % 50 = 0)"


def _themes(v: DataFrame) -> DataFrame:
    """(label, embedding): the mean vector of each label."""
    long = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


@registered(f"WITH {_VEC} SELECT qid, vec_id, {_COS} AS similarity, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_COS} DESC, vec_id) AS INTEGER) AS rank FROM v, qv QUALIFY rank <= 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, against all."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding").dropDuplicates(["vec_id"])
    return retrieve.nearest(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), v, 10)


@registered(f"WITH {_VEC}, th AS (SELECT label, list_transform(range(1, 65), lambda i: avg_[i]) AS a FROM (SELECT label, list(m ORDER BY i) AS avg_ FROM (SELECT label, i, avg(a[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label)) SELECT qid, label, {_COS.replace('a,', 'th.a,').replace('(a', '(th.a')} AS similarity FROM th, qv QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, label) <= 5".replace("th.th.", "th."))
def theme_search(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label").dropDuplicates(["vec_id"])
    themes = _themes(v)
    return retrieve.nearest(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), themes, 5, key="label").drop("rank")


@registered(f"""WITH docs AS (SELECT id, min(title) AS t FROM legal_documents WHERE id IS NOT NULL GROUP BY id), p AS (SELECT id, coalesce(contains(lower(t), 'luật') AND NOT contains(lower(t), 'nghị định'), FALSE) AS pr FROM docs ORDER BY pr DESC, id LIMIT 3),
    k AS (SELECT id, row_number() OVER (ORDER BY id) AS d FROM p WHERE pr OR NOT (SELECT bool_or(pr) FROM p)), a AS (SELECT art.id, d, document_id, coalesce(chapter_id, document_id || ':c0') AS ch, article_number AS n FROM {_ART} art JOIN k ON k.id = document_id),
    c AS (SELECT ch, row_number() OVER (ORDER BY d, min(n) NULLS FIRST, ch) AS c FROM a GROUP BY d, document_id, ch QUALIFY c <= 6), r AS (SELECT id, ch, row_number() OVER (PARTITION BY ch ORDER BY n NULLS FIRST, id) AS i FROM a QUALIFY i <= 7),
    f AS (SELECT id, CAST(row_number() OVER (ORDER BY c, i) AS INTEGER) AS rank FROM r JOIN c USING (ch) QUALIFY rank <= 7) SELECT qid, id AS article_id, rank, CAST(0.5 AS DOUBLE) AS confidence FROM f, (SELECT DISTINCT item_id AS qid, question FROM eval_items)""")
def tree_select_nollm(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return tree.searched(c.documents, c.articles, _questions(spark, d))


# ---- the graph


@registered(f"SELECT relation_type, count(*) AS edges FROM (SELECT * FROM {_EDGE} UNION ALL SELECT dst, src, relation_type, confidence FROM {_EDGE} WHERE list_contains({S.listed(dims.SYMMETRIC_RELATIONS)}, relation_type)) GROUP BY ALL")
def symmetric_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetric(_corpus(spark, d).edges).groupBy("relation_type").agg(F.count("*").alias("edges"))


_ITER = 50
_WGEN = "CASE relation_type " + " ".join(f"WHEN {S.s(k)} THEN {v}" for k, v in dims.INTENT_RELATION_WEIGHTS["general"].items()) + f" ELSE {dims.UNKNOWN_RELATION} END"
_PPR = (
    f"""e AS MATERIALIZED (SELECT * FROM {_EDGE}), sy AS (SELECT * FROM e UNION ALL SELECT dst, src, relation_type, confidence FROM e WHERE list_contains({S.listed(dims.SYMMETRIC_RELATIONS)}, relation_type)),
    raw AS (SELECT src, dst, sum(confidence * {_WGEN}) AS w FROM sy GROUP BY ALL HAVING sum(confidence * {_WGEN}) > 0), w AS MATERIALIZED (SELECT src, dst, w / t AS w FROM raw JOIN (SELECT src, sum(w) AS t FROM raw GROUP BY src) USING (src)),
    sd AS (SELECT category AS qid, entity_id AS node, count(*) AS n FROM (SELECT DISTINCT item_id, category, article_ref FROM eval_items) i JOIN (SELECT DISTINCT entity_id, article_number FROM {_MEN} WHERE article_number IS NOT NULL) m ON m.article_number = {S.article_number('i.article_ref')} GROUP BY ALL),
    s AS MATERIALIZED (SELECT qid, node, n / t AS s FROM sd JOIN (SELECT qid, sum(n) AS t FROM sd GROUP BY qid) USING (qid)), p0 AS (SELECT qid, node, s AS p FROM s)"""
    + "".join(f", p{i} AS MATERIALIZED (SELECT qid, node, sum(x) AS p FROM (SELECT qid, dst AS node, p * w * 0.85 AS x FROM p{i - 1} JOIN w ON src = node UNION ALL SELECT qid, node, s * 0.15 FROM s) GROUP BY ALL)" for i in range(1, _ITER + 1))
)


def _ppr(spark: SparkSession, d: str) -> tuple[DataFrame, engine.Corpus]:
    """Seeds: the entities of the articles that each category's test items refer to."""
    c = _corpus(spark, d)
    items = table(spark, d, "eval_items").select("item_id", "category", "article_ref").distinct().select(F.col("category").alias("qid"), text.article_number(F.col("article_ref")).alias("article_number"))
    items = items.groupBy("qid", "article_number").agg(F.count("*").alias("n"))
    m = c.mentions.filter("article_number is not null").select("entity_id", "article_number").distinct()
    seeds = skew.parted_join(items, m, ["article_number"]).groupBy("qid", F.col("entity_id").alias("node")).agg(F.sum("n").cast("double").alias("weight"))
    intents = spark.createDataFrame([("general", "general", 1.0)], "intent_set string, intent string, weight double")
    w = graph.transition(c.edges, intents).select("src", "dst", "w")
    return graph.personalized_pagerank(w, seeds), c


@registered(f"WITH {_PPR} SELECT qid, node, round(p, 5) AS score FROM p{_ITER} WHERE round(p, 5) > 0")
def ppr_scores(spark: SparkSession, d: str) -> DataFrame:
    """Until nothing changes by 1e-6, at most 50 steps, to five places; SQL takes all 50."""
    return _ppr(spark, d)[0].select("qid", "node", F.round("score", 5).alias("score")).filter("score > 0")


@registered(f"""WITH {_PPR}, m AS (SELECT * FROM {_MEN}), f AS (SELECT entity_id, arg_min(article_number, (ord, article_id)) AS n FROM m WHERE article_number IS NOT NULL GROUP BY entity_id), b AS (SELECT qid, n, max(p) AS score FROM p{_ITER} JOIN f ON f.entity_id = node WHERE p > 0 GROUP BY ALL)
    SELECT qid, article_id, round(score, 5) AS score FROM b JOIN (SELECT DISTINCT article_id, article_number FROM m) a ON a.article_number = n WHERE round(score, 5) > 0""")
def ppr_articles(spark: SparkSession, d: str) -> DataFrame:
    p, c = _ppr(spark, d)
    return graph.pagerank_articles(p, c.mentions).withColumn("score", F.round("score", 5)).filter("score > 0")


@registered()
def ppr_scores_settled(spark: SparkSession, d: str) -> DataFrame:
    """ppr_scores to six places, which the 50 steps of SQL may not share."""
    return _ppr(spark, d)[0].select("qid", "node", F.round("score", 6).alias("score"))


@registered()
def ppr_articles_settled(spark: SparkSession, d: str) -> DataFrame:
    p, c = _ppr(spark, d)
    return graph.pagerank_articles(p, c.mentions).withColumn("score", F.round("score", 6))


@registered(f"""WITH e AS (SELECT * FROM {_EDGE} WHERE src <> dst), b AS (SELECT src AS node, dst AS neighbour, 0 AS o, 'out' AS direction, relation_type, confidence FROM e UNION ALL SELECT dst, src, 1, 'in', relation_type, confidence FROM e)
    SELECT node, neighbour, direction, relation_type, confidence FROM b QUALIFY row_number() OVER (PARTITION BY node, neighbour ORDER BY o, confidence DESC, relation_type) = 1""")
def kg_neighbors(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return graph.neighbourhood(c.edges, c.entities, "entity_id")


@registered(f"WITH m AS (SELECT DISTINCT entity_id, article_id FROM {_MEN}), e AS MATERIALIZED (SELECT * FROM {_EDGE}) SELECT a.article_id, src, dst, relation_type, confidence FROM e JOIN m a ON a.entity_id = src JOIN m b ON b.entity_id = dst AND a.article_id = b.article_id")
def kg_subgraph(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return graph.induced(c.edges, c.mentions.select("article_id", F.col("entity_id").alias("node")), "article_id")


#: Steps of the SQL's labels; each also follows a label's label, so ways of some 2^12 edges are followed.
_HOPS = 12
_CC = (
    f"eg AS MATERIALIZED (SELECT DISTINCT src, dst FROM {_EDGE} WHERE src <> dst), n AS MATERIALIZED (SELECT src AS a, dst AS b FROM eg UNION SELECT dst, src FROM eg), l0 AS (SELECT a AS node, least(a, min(b)) AS c FROM n GROUP BY a)"
    + "".join(f", h{i} AS MATERIALIZED (SELECT x.node, least(min(x.c), min(y.c)) AS c FROM l{i - 1} x JOIN n ON n.a = x.node JOIN l{i - 1} y ON y.node = n.b GROUP BY x.node), l{i} AS MATERIALIZED (SELECT x.node, least(x.c, y.c) AS c FROM h{i} x JOIN h{i} y ON y.node = x.c)" for i in range(1, _HOPS + 1))
    + f", cc AS (SELECT node, c AS component FROM l{_HOPS}), tp AS (SELECT component AS theme, node, count(*) OVER (PARTITION BY component) AS size, row_number() OVER (PARTITION BY component ORDER BY node) AS i FROM cc)"
)


@registered(f"WITH {_CC} SELECT node, component FROM cc")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(_corpus(spark, d).edges, "src", "dst")


@registered(f"WITH {_CC} SELECT theme, node, size FROM tp WHERE size >= 3 AND i <= 50")
def theme_partition(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty of each theme: the limit is the feature."""
    return graph.theme_partition(_corpus(spark, d).edges)


_REL_ART = f"""m AS (SELECT * FROM {_MEN}), f AS (SELECT entity_id, arg_min(article_id, (ord, article_id)) AS article_id FROM m GROUP BY entity_id), ge AS (SELECT * FROM {_EDGE}), gb AS (SELECT src AS e, dst AS o, relation_type, confidence FROM ge UNION ALL SELECT dst, src, relation_type, confidence FROM ge),
    ra AS (SELECT a.article_id, f.article_id AS related_id, relation_type, max(confidence) AS confidence FROM gb JOIN (SELECT DISTINCT entity_id, article_id FROM m) a ON a.entity_id = e JOIN f ON f.entity_id = o WHERE a.article_id <> f.article_id GROUP BY ALL)"""


@registered(f"WITH {_REL_ART} SELECT article_id, related_id, relation_type, confidence FROM ra")
def related_articles(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return graph.related_articles(c.edges, c.mentions)


@registered(f"""WITH {_LISTS}, {_REL_ART}, s AS (SELECT DISTINCT qid, article_id FROM l_tree WHERE rank <= 7), ch AS (SELECT id AS article_id, chapter_id FROM {_ART} WHERE chapter_id IS NOT NULL),
    r AS (SELECT s.qid, ra.related_id AS article_id, relation_type, confidence FROM s JOIN ra USING (article_id) WHERE relation_type IN {(*dims.STRONG_RELATIONS, *dims.EXPANSION_RELATIONS)} AND NOT EXISTS (SELECT 1 FROM s t WHERE t.qid = s.qid AND t.article_id = ra.related_id)),
    x AS (SELECT r.*, ch.chapter_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s JOIN ch c2 ON c2.article_id = s.article_id WHERE s.qid = r.qid AND c2.chapter_id = ch.chapter_id) AS crosses FROM r LEFT JOIN ch USING (article_id)),
    y AS (SELECT qid, article_id, bool_or(crosses) AS crosses, max(confidence) AS score FROM x WHERE (crosses OR relation_type IN {dims.EXPANSION_RELATIONS}) AND (qid, article_id) IN (SELECT qid, article_id FROM comp WHERE semantic > 0.4) GROUP BY ALL),
    z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY qid, crosses ORDER BY score DESC, article_id) <= CASE WHEN crosses THEN 3 ELSE 2 END)
    SELECT qid, article_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY crosses DESC, score DESC, article_id) AS INTEGER) AS rank, crosses FROM z QUALIFY rank <= 3""")
def kg_expand_by_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Articles the graph relates to the tree's first seven, of those whose semantic score is above .4: the limits are the feature."""
    near = _components(spark, d).select("qid", "article_id", F.col("semantic").alias("similarity"))
    return engine.kg_expanded_by_chapters(_lists(spark, d)["tree"].filter("rank <= 7"), _corpus(spark, d), near)


@registered(f"WITH q AS (SELECT DISTINCT name FROM entity_feed WHERE length(name) > 0), e AS (SELECT id, name AS n FROM {_ENT} WHERE name IS NOT NULL) SELECT q.name, arg_min(id, (n <> q.name, id)) AS entity_id FROM q JOIN e ON contains(n, q.name) GROUP BY q.name")
def entity_of_name(spark: SparkSession, d: str) -> DataFrame:
    """The entity that each name of the feed means: that of the name, else the first whose name has it inside."""
    return retrieve.related_names(table(spark, d, "entity_feed").select("name"), _corpus(spark, d).entities)


@registered(f"""WITH {_NODES}, s AS (SELECT qid, CASE WHEN qid % 2 = 0 THEN article_id ELSE regexp_extract(article_id, ':([^:]+)$', 1) END AS a, score FROM (SELECT qid, article_id, semantic AS score FROM (SELECT qid, article_id, max(CASE WHEN component = 'semantic' THEN score END) AS semantic FROM component_scores WHERE CAST(score AS VARCHAR) <> 'nan' GROUP BY ALL) WHERE semantic IS NOT NULL)),
    nd AS (SELECT DISTINCT node_id FROM nodes WHERE node_id IS NOT NULL), en AS (SELECT regexp_extract(node_id, ':([^:]+)$', 1) AS a, min(node_id) AS node_id FROM nd WHERE contains(node_id, ':') GROUP BY 1)
    SELECT qid, node_id, round(max(score), 6) AS score FROM (SELECT qid, a AS node_id, score FROM s WHERE a IN (SELECT node_id FROM nd) UNION ALL SELECT qid, en.node_id, score FROM s JOIN en USING (a) WHERE a NOT IN (SELECT node_id FROM nd)) GROUP BY ALL""")
def tree_hints(spark: SparkSession, d: str) -> DataFrame:
    """Scores on the nodes they mean; those of odd questions are named by their last part only."""
    t = table(spark, d, "component_scores").filter("component = 'semantic' and score is not null and not isnan(score)").groupBy("qid", "article_id").agg(F.max("score").alias("score"))
    t = t.withColumn("article_id", F.when(F.col("qid") % 2 == 0, F.col("article_id")).otherwise(F.regexp_extract("article_id", ":([^:]+)$", 1)))
    return tree.matched_hints(_nodes(spark, d), t).withColumn("score", F.round("score", 6))


@registered(f"""WITH {_LISTS}, s AS (SELECT DISTINCT qid, article_id FROM l_dual WHERE rank <= 5), m AS (SELECT * FROM {_MEN}), f AS (SELECT entity_id, arg_min(article_id, (ord, article_id)) AS article_id FROM m GROUP BY entity_id),
    x AS (SELECT DISTINCT qid, entity_id AS src FROM s JOIN (SELECT DISTINCT entity_id, article_id FROM m) USING (article_id)), y AS (SELECT qid, f.article_id, max(confidence) AS score FROM x JOIN {_EDGE} e USING (src) JOIN f ON f.entity_id = dst GROUP BY ALL)
    SELECT qid, article_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, article_id) AS INTEGER) AS rank FROM y WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.qid = y.qid AND s.article_id = y.article_id) QUALIFY rank <= 3""")
def kg_expand(spark: SparkSession, d: str) -> DataFrame:
    return engine.kg_expanded(_lists(spark, d)["dual"].filter("rank <= 5"), _corpus(spark, d))


# ---- the life of the graph

_FEED = "(SELECT DISTINCT record_id, name, type_str, description, confidence, source_id, document_id FROM entity_feed)"


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_feed").select(F.col("record_id").alias("ord"), "name", "type_str", "description", "confidence", "source_id", "document_id").distinct()


@registered(f"""SELECT {S.slug('name')} AS entity_id, arg_min(name, record_id) AS name, arg_min_null(type_str, record_id) AS type_str, arg_max_null(description, (coalesce(length(description), 0), -record_id)) AS description, max({S.valid('confidence')}) AS confidence, count(*) AS occurrence_count,
    array_to_string(list_sort(list_distinct(list(source_id))), ',') AS source_ids, array_to_string(list_sort(list_distinct(list(document_id))), ',') AS document_ids, array_to_string(list_sort(list_distinct(list(name))), '|') AS aliases FROM {_FEED} WHERE length({S.slug('name')}) > 0 GROUP BY {S.slug('name')}""")
def kg_entity_merge(spark: SparkSession, d: str) -> DataFrame:
    m = kg.merged_entities(_feed(spark, d))
    return m.select("entity_id", "name", "type_str", "description", "confidence", "occurrence_count", *[F.array_join(c, g).alias(c) for c, g in (("source_ids", ","), ("document_ids", ","), ("aliases", "|"))])


@registered(f"SELECT {S.slug('name')} AS slug, arg_max(name, (coalesce({S.valid('confidence')}, -1), id)) AS name, max(coalesce({S.valid('confidence')}, -1)) AS confidence, count(*) AS merge_count FROM (SELECT DISTINCT id, name, confidence FROM kg_entities WHERE deleted_at IS NULL) WHERE length({S.slug('name')}) > 0 GROUP BY {S.slug('name')}")
def slug_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "kg_entities").filter("deleted_at is null").select("id", "name", "confidence").distinct()
    return kg.slug_merged(e).select("slug", "name", "confidence", "merge_count")


_REL = "(SELECT DISTINCT relation_id, lower(trim(source_id)) AS src, lower(trim(target_id)) AS dst, predicate, relation_type, evidence, confidence, article_ids FROM kg_relations)"


def _relations(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.lower(F.trim(F.col(c)))
    return table(spark, d, "kg_relations").select(F.col("relation_id").alias("ord"), key("source_id").alias("src"), key("target_id").alias("dst"), "predicate", "relation_type", "evidence", "confidence", "article_ids").distinct()


@registered(f"""WITH r AS (SELECT * FROM {_REL} WHERE src IS NOT NULL AND dst IS NOT NULL), ev AS (SELECT src, predicate, dst, evidence, min(relation_id) AS o FROM r WHERE length(evidence) > 0 GROUP BY ALL),
    fo AS (SELECT src, predicate, dst, list_reduce(list_concat([''], list(evidence ORDER BY o, evidence)), lambda a, e: CASE WHEN a = '' THEN e WHEN contains(a, e) THEN a ELSE a || ' | ' || e END) AS evidence FROM ev GROUP BY ALL),
    g AS (SELECT src, predicate, dst, max({S.valid('confidence')}) AS confidence, count(*) AS occurrence_count, array_to_string(list_sort(list_distinct(flatten(list(article_ids)))), ',') AS article_ids FROM r GROUP BY ALL)
    SELECT g.*, coalesce(fo.evidence, '') AS evidence FROM g LEFT JOIN fo ON fo.src = g.src AND fo.dst = g.dst AND fo.predicate IS NOT DISTINCT FROM g.predicate""")
def kg_relation_merge(spark: SparkSession, d: str) -> DataFrame:
    m = kg.merged_relations(_relations(spark, d))
    return m.select("src", "predicate", "dst", "confidence", "occurrence_count", F.array_join("article_ids", ",").alias("article_ids"), "evidence")


_REMAP = f"rm AS (SELECT id AS old_id, first AS canonical_id FROM (SELECT id, min(id) OVER (PARTITION BY {S.canonical('name')}, type_str) AS first FROM {_ENT} WHERE length({S.canonical('name')}) > 0) WHERE id <> first)"


def _remap(spark: SparkSession, d: str) -> DataFrame:
    e = _corpus(spark, d).entities.withColumn("c", text.canonical(F.col("name"))).filter("length(c) > 0")
    g = e.groupBy("c", "type_str").agg(F.min("entity_id").alias("canonical_id"))
    return e.join(g, ["c", "type_str"]).filter("entity_id <> canonical_id").select(F.col("entity_id").alias("old_id"), "canonical_id")


@registered(f"WITH {_REMAP} SELECT coalesce(a.canonical_id, src) AS src, coalesce(b.canonical_id, dst) AS dst, relation_type, max(confidence) AS confidence, count(*) AS n FROM {_EDGE} e LEFT JOIN rm a ON a.old_id = src LEFT JOIN rm b ON b.old_id = dst WHERE coalesce(a.canonical_id, src) <> coalesce(b.canonical_id, dst) GROUP BY ALL")
def relation_remap(spark: SparkSession, d: str) -> DataFrame:
    return kg.remapped(_corpus(spark, d).edges, _remap(spark, d))


_NUMS = r"array_to_string(list_sort(list_distinct(regexp_extract_all(c, '\d+'))), ' ')"


@registered(f"""WITH c AS (SELECT DISTINCT id, type_str, {S.canonical('name')} AS c FROM {_ENT} WHERE length({S.canonical('name')}) > 0), g AS (SELECT c, type_str, min(id) AS id FROM c GROUP BY ALL), l AS (SELECT *, {_NUMS} AS nums FROM g WHERE length(c) >= 15 AND NOT regexp_matches(c, 'dieu\\s+\\d+|khoan\\s+\\d+|diem\\s+\\w+'))
    SELECT g.id AS id_a, c.id AS id_b, TRUE AS exact FROM c JOIN g ON c.c = g.c AND c.type_str = g.type_str WHERE c.id <> g.id
    UNION ALL SELECT a.id, b.id, FALSE FROM l a JOIN l b ON a.type_str = b.type_str AND a.id < b.id AND a.c <> b.c AND (a.nums = '' OR b.nums = '' OR a.nums = b.nums) WHERE round(jaro_winkler_similarity(a.c, b.c), 6) >= 0.98""")
def entity_dedup_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = kg.comparable_pairs(_corpus(spark, d).entities.select(F.col("entity_id").alias("id"), "name", "type_str"))
    return p.select("id_a", "id_b", (F.col("similarity") == 1.0).alias("exact"))


@registered(f"SELECT DISTINCT predicate, coalesce({S.mapped(dims.relation_type_map())}[{S.predicate('predicate')}], 'RELATED_TO') AS relation_type FROM kg_relations WHERE predicate IS NOT NULL")
def type_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kg_relations").filter("predicate is not null").select("predicate", kg.relation_type(F.col("predicate")).alias("relation_type")).distinct()


_EXACT = f"{S.mapped({k.upper(): v for k, v in dims.QUERY_ABBREVIATIONS.items()})}[upper(trim(name))]"


@registered(f"""WITH f AS (SELECT DISTINCT record_id, name, type_str, document_id FROM entity_feed), x AS (SELECT *, {_EXACT} AS ex FROM f), y AS (SELECT *, coalesce(ex, {S.canonical('name')}) AS whole FROM x), z AS (SELECT *, {S.slug('whole')} AS canonical FROM y)
    SELECT record_id, concat_ws(':', lower(type_str), canonical, {S.document_number('document_id')}) AS entity_id, canonical, ex IS NOT NULL AS is_abbreviation FROM z""")
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    return kg.resolved(table(spark, d, "entity_feed").select("record_id", "name", "type_str", "document_id").distinct()).select("record_id", "entity_id", "canonical", "is_abbreviation")


_RULES = "CASE " + " ".join(f"WHEN p = {S.s(k)} THEN (st IS NULL OR list_contains({S.listed(a)}, st)) AND (dt IS NULL OR list_contains({S.listed(b)}, dt))" for k, (a, b) in dims.PREDICATE_RULES.items()) + " ELSE TRUE END"
_TYPES = f"(SELECT id, type_str FROM {_ENT})"
_VALID = f"v AS (SELECT relation_id, {S.predicate('predicate')} AS p, a.type_str AS st, b.type_str AS dt FROM {_REL} r LEFT JOIN {_TYPES} a ON a.id = src LEFT JOIN {_TYPES} b ON b.id = dst WHERE src <> dst)"


def _validated(spark: SparkSession, d: str) -> DataFrame:
    return kg.validated_relations(_relations(spark, d).withColumnRenamed("ord", "relation_id"), _corpus(spark, d).entities.select(F.col("entity_id").alias("id"), "type_str"))


@registered(f"WITH {_VALID} SELECT relation_id, p AS predicate, coalesce(list_contains({S.listed(dims.relation_type_map())}, p), FALSE) AS known_type, {_RULES} AS semantic_ok FROM v")
def validate_relations(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).select("relation_id", "predicate", F.coalesce("known_type", F.lit(False)).alias("known_type"), "semantic_ok")


@registered(f"SELECT {S.predicate('predicate')} AS predicate, count(*) AS n FROM {_REL} WHERE NOT list_contains({S.listed(dims.relation_type_map())}, {S.predicate('predicate')}) GROUP BY 1")
def new_relation_types(spark: SparkSession, d: str) -> DataFrame:
    return kg.new_types(_relations(spark, d))


_WORDS = r"list_filter(regexp_split_to_array(e, '\s+'), lambda x: length(x) > 2)"


@registered(f"""WITH x AS (SELECT relation_id, lower(trim(evidence)) AS e, lower(a.content) AS s FROM (SELECT relation_id, evidence, article_ids[1] AS article_id FROM {_REL}) r LEFT JOIN {_ART} a ON a.id = r.article_id), y AS (SELECT *, {_WORDS} AS w FROM x)
    SELECT CASE WHEN e IS NULL OR s IS NULL OR length(e) = 0 THEN 'none' WHEN contains(s, e) THEN 'exact' WHEN len(w) > 0 AND len(list_filter(w, lambda z: contains(s, z))) >= 0.7 * len(w) THEN 'words' ELSE 'none' END AS verdict, count(*) AS n FROM y GROUP BY 1""")
def evidence_check(spark: SparkSession, d: str) -> DataFrame:
    r = _relations(spark, d).select("ord", "evidence", F.get("article_ids", F.lit(0)).alias("article_id"))
    j = r.join(_corpus(spark, d).articles.select("article_id", "content"), "article_id", "left")
    return j.select(kg.evidence_verdict(F.col("evidence"), F.col("content")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@registered("SELECT DISTINCT id, article_id FROM (SELECT id, unnest(source_ids) AS article_id FROM kg_entities) WHERE article_id NOT IN (SELECT id FROM legal_articles WHERE id IS NOT NULL)")
def link_validate(spark: SparkSession, d: str) -> DataFrame:
    return kg.broken_links(table(spark, d, "kg_entities"), table(spark, d, "legal_articles"))


@registered("SELECT article_id, count(DISTINCT id) AS entities, array_to_string(list_sort(list_distinct(list(type_str))), ',') AS types FROM (SELECT DISTINCT id, type_str, unnest(source_ids) AS article_id FROM kg_entities) GROUP BY article_id")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    return kg.provenance(table(spark, d, "kg_entities"))


_MONTH = "strftime(created_at, '%Y') <> '2025'"


@registered(f"SELECT DISTINCT src, dst, relation_type FROM (SELECT DISTINCT lower(trim(source_id)) AS src, lower(trim(target_id)) AS dst, relation_type FROM kg_relations WHERE NOT ({_MONTH})) n WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM (SELECT lower(trim(source_id)) AS src, lower(trim(target_id)) AS dst, relation_type FROM kg_relations WHERE {_MONTH}) o WHERE o.src = n.src AND o.dst = n.dst AND o.relation_type = n.relation_type)")
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    """The relations of 2025 added to the graph of the years before."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    r = table(spark, d, "kg_relations").select(key("source_id").alias("src"), key("target_id").alias("dst"), "relation_type", F.year("created_at").alias("y"))
    e = table(spark, d, "kg_entities").select("id", "source_ids")
    return kg.updated(e, r.filter("y <> 2025"), e.limit(0), r.filter("y = 2025"))[1].select("src", "dst", "relation_type")


@registered("SELECT DISTINCT unnest(source_ids) AS article_id FROM kg_entities WHERE strftime(created_at, '%Y') = '2024' AND id NOT IN (SELECT id FROM kg_entities WHERE strftime(created_at, '%Y') <> '2024')")
def affected_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles that the entities new in 2024 come from."""
    e = table(spark, d, "kg_entities").withColumn("y", F.year("created_at"))
    empty = _corpus(spark, d).edges.limit(0)
    fresh = e.filter("y = 2024").select("id", "source_ids")
    add = fresh.join(e.filter("y <> 2024").select("id"), "id", "left_anti")
    return kg.updated(e.limit(0).select("id", "source_ids"), empty, add, empty)[2]


# ---- extraction


@registered()
def crossref_detect(spark: SparkSession, d: str) -> DataFrame:
    return extract.crossrefs(table(spark, d, "legal_articles").select("id", "content").distinct())


@registered()
def crossref_resolve(spark: SparkSession, d: str) -> DataFrame:
    return extract.resolved_crossrefs(extract.crossrefs(table(spark, d, "legal_articles").select("id", "content").distinct()), table(spark, d, "legal_documents"))


@registered()
def crossref_sync(spark: SparkSession, d: str) -> DataFrame:
    refs = extract.resolved_crossrefs(extract.crossrefs(table(spark, d, "legal_articles").select("id", "content").distinct()), table(spark, d, "legal_documents"))
    return kg.synced_crossrefs(refs, _corpus(spark, d).edges)


@registered()
def abbreviations(spark: SparkSession, d: str) -> DataFrame:
    return extract.abbreviations(table(spark, d, "documents").select("doc_id", "text").distinct(), "text")


@registered()
def abbreviation_full_forms(spark: SparkSession, d: str) -> DataFrame:
    return extract.full_forms(table(spark, d, "documents").select("doc_id", "text").distinct(), "text")


_V = f"length(c) - length(translate(c, '{dims.VIETNAMESE_VOWELS}', ''))"


@registered(f"""WITH w AS (SELECT DISTINCT upper(w) AS w FROM (SELECT unnest(regexp_split_to_array(name, '\\s+')) AS w FROM kg_entities WHERE name IS NOT NULL) WHERE regexp_matches(w, '^[\\p{{Lu}}][\\p{{Lu}}0-9\\-]{{1,9}}$')), x AS (SELECT w, replace(w, '-', '') AS c FROM w), y AS (SELECT w, length(c) AS n, {_V} AS v FROM x)
    SELECT w AS word, CASE WHEN v = 0 AND n >= 2 THEN 100 WHEN contains(w, '-') AND n <= 6 THEN 95 WHEN (n - v) / greatest(n, 1) >= 0.75 AND n <= 5 THEN 85 WHEN (n - v) / greatest(n, 1) >= 0.85 AND n <= 6 THEN 70 ELSE 0 END AS confidence FROM y""")
def abbrev_classify(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "kg_entities").filter("name is not null").select(F.explode(F.split("name", r"\s+")).alias("w")).filter(F.col("w").rlike(r"^[\p{Lu}][\p{Lu}0-9\-]{1,9}$")).select(F.upper("w").alias("word")).distinct()
    return w.select("word", extract.abbreviation_class(F.col("word"))["confidence"].alias("confidence"))


@registered()
def terminology(spark: SparkSession, d: str) -> DataFrame:
    return extract.best_terms(extract.terminology(table(spark, d, "legal_articles").select("id", "content").distinct()))


@registered()
def hierarchy_extract(spark: SparkSession, d: str) -> DataFrame:
    p = extract.structure(table(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")
    return extract.structure_counts(p, "doc_id")


@registered()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return extract.pages_text(table(spark, d, "legal_articles").select("id", "raw_text").distinct(), "id", "raw_text")


@registered("SELECT sha256(question) AS cache_key, count(*) AS n, item_id % 3 <> 0 AS answered FROM (SELECT DISTINCT item_id, question FROM eval_items) GROUP BY ALL")
def llm_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The cache holds the answers to two questions of three; the others are missing."""
    q = _questions(spark, d).select("qid", F.col("text").alias("prompt"))
    cache = q.filter("qid % 3 <> 0").select(io.cache_key(F.col("prompt")).alias("cache_key"), F.col("prompt").alias("response")).distinct()
    have, miss = io.cached_answers(q, cache)
    one = lambda x, yes: x.groupBy("cache_key").agg(F.count("*").alias("n")).withColumn("answered", F.lit(yes))
    return one(have, True).unionByName(one(miss, False))


# ---- ontology


@registered(f"WITH RECURSIVE c AS (SELECT * FROM {S.values(dims.ONTOLOGY_CLASSES, 'name, parent, label')}), up(node, ancestor, distance) AS (SELECT name, parent, 1 FROM c WHERE parent IS NOT NULL UNION ALL SELECT node, parent, distance + 1 FROM up JOIN c ON c.name = ancestor WHERE parent IS NOT NULL) SELECT node, ancestor, distance FROM up")
def ontology_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(ontology.default_classes(spark), "name", "parent")


@registered()
def ontology_expand(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("qid"), "text").distinct()
    return ontology.expanded_terms(q, ontology.default_classes(spark))


@registered("""WITH e AS (SELECT type_str, id, min(name) AS name FROM kg_entities WHERE type_str IS NOT NULL AND deleted_at IS NULL GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY type_str ORDER BY id) AS i FROM e)
    SELECT 'Thing' AS name, NULL AS parent, 0 AS instances, '' AS examples UNION ALL SELECT array_to_string(list_transform(string_split(lower(type_str), '_'), lambda w: upper(w[1]) || w[2:]), ''), 'Thing', count(*), coalesce(string_agg(name, '; ' ORDER BY i) FILTER (WHERE i <= 3), '') FROM x GROUP BY type_str""")
def ontology_generate(spark: SparkSession, d: str) -> DataFrame:
    return ontology.generated_classes(table(spark, d, "kg_entities").filter("deleted_at is null")).select("name", "parent", "instances", "examples")


@registered(f"""SELECT relation_type AS name, 'object' AS kind, array_to_string(list_sort(list_distinct(list(a.type_str))), ',') AS domains, array_to_string(list_sort(list_distinct(list(b.type_str))), ',') AS ranges, count(*) AS uses FROM {_EDGE} e JOIN {_TYPES} a ON a.id = src JOIN {_TYPES} b ON b.id = dst WHERE relation_type IS NOT NULL GROUP BY relation_type
    UNION ALL SELECT * FROM (VALUES ('hasName', 'data', 'Thing', 'xsd:string', 0), ('hasDescription', 'data', 'Thing', 'xsd:string', 0), ('hasConfidence', 'data', 'Thing', 'xsd:decimal', 0))""")
def ontology_properties(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return ontology.generated_properties(c.edges, c.entities.select(F.col("entity_id").alias("id"), "type_str"))


def _ontology(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _corpus(spark, d)
    e = c.entities.select(F.col("entity_id").alias("id"), "type_str", "name")
    return ontology.generated_classes(e), ontology.generated_properties(c.edges, e)


@registered()
def ontology_validate(spark: SparkSession, d: str) -> DataFrame:
    return ontology.findings(*_ontology(spark, d))


@registered()
def ontology_evaluate(spark: SparkSession, d: str) -> DataFrame:
    k, p = _ontology(spark, d)
    return ontology.quality(k, p, table(spark, d, "kg_entities").filter("deleted_at is null"))


_KNOWN = sorted(set(dims.ENTITY_TYPES.values()) - {"LOCATION", "PENALTY"})
_KNOWN_RELATIONS = ("REQUIRES", "REFERENCES", "RELATED_TO")


@registered("".join(f"{u}SELECT '{k}' AS kind, count(*) AS total, count(*) FILTER (WHERE x) AS unknown, round(1 - count(*) FILTER (WHERE x) / greatest(count(*), 1), 6) AS rate FROM (SELECT {c} IS NULL OR {c} NOT IN {tuple(v)} AS x FROM {t})" for u, k, c, v, t in (("", "entity", "type_str", _KNOWN, "kg_entities"), (" UNION ALL ", "relation", "relation_type", _KNOWN_RELATIONS, "kg_relations"))))
def kg_conformance(spark: SparkSession, d: str) -> DataFrame:
    """Against an ontology without two types of entities and with three of relations."""
    one = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    return kg.conformance(table(spark, d, "kg_entities"), table(spark, d, "kg_relations"), one(_KNOWN), one(_KNOWN_RELATIONS))


# ---- evaluation: an article is relevant when its ppr score is among the question's first three

_QREL = f"{_LISTS}, qrel AS (SELECT qid, article_id AS item FROM l_kg WHERE rank <= 3)"
_METRICS = f"""{_QREL}, sz AS (SELECT qid, count(*) AS expected FROM qrel GROUP BY qid), h AS (SELECT qid, rank FROM l_tree t JOIN qrel USING (qid) WHERE t.article_id = qrel.item), k AS (SELECT unnest({list(dims.CUTOFFS)}) AS k),
    g AS (SELECT sz.qid, k, expected, count(rank) FILTER (WHERE rank <= k) AS n, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= k), 0) AS dcg, min(rank) AS first FROM sz CROSS JOIN k LEFT JOIN h ON h.qid = sz.qid GROUP BY ALL),
    metrics AS (SELECT qid, k, CAST(n > 0 AS INTEGER) AS hit, round(n / expected, 6) AS recall, round(n / k, 6) AS precision, round(dcg / list_sum(list_transform(range(1, least(expected, k) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS rr, expected FROM g)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    x = _lists(spark, d)
    return evaluate.metrics(x["tree"].select("qid", F.col("article_id").alias("item"), "rank"), _qrels(x))


def _qrels(x: dict[str, DataFrame]) -> DataFrame:
    return x["kg"].filter("rank <= 3").select("qid", F.col("article_id").alias("item"))


@registered(f"WITH {_METRICS} SELECT * FROM metrics")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d)


@registered(f"WITH {_METRICS} SELECT k, count(*) AS questions, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr FROM metrics GROUP BY k")
def ir_averages(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.averages(_metrics(spark, d))


@registered(f"""WITH {_METRICS}, a AS (SELECT *, CAST(qid % 4 AS VARCHAR) AS kind, CASE WHEN expected <= 1 THEN '1' WHEN expected <= 3 THEN '2-3' ELSE '4+' END AS bucket FROM metrics WHERE k = 10)
    SELECT 'kind' AS dimension, kind AS value, count(*) AS questions, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr FROM a GROUP BY kind UNION ALL SELECT 'bucket', bucket, count(*), round(avg(hit), 6), round(avg(recall), 6), round(avg(rr), 6) FROM a GROUP BY bucket UNION ALL SELECT 'all', 'all', count(*), round(avg(hit), 6), round(avg(recall), 6), round(avg(rr), 6) FROM a""")
def ir_breakdown(spark: SparkSession, d: str) -> DataFrame:
    m = cut(_metrics(spark, d))
    attr = m.filter("k = 10").select("qid", (F.col("qid") % 4).cast("string").alias("kind"), evaluate.expected_bucket(F.col("expected")).alias("bucket"))
    return evaluate.breakdown(m, attr, ("kind", "bucket"))


@registered(f"WITH {_QREL}, t AS (SELECT DISTINCT l.qid FROM l_tree l JOIN qrel q ON q.qid = l.qid AND q.item = l.article_id WHERE rank <= 10), g AS (SELECT DISTINCT l.qid FROM l_dual l JOIN qrel q ON q.qid = l.qid AND q.item = l.article_id WHERE rank <= 10), x AS (SELECT qid IN (SELECT qid FROM t) AS t, qid IN (SELECT qid FROM g) AS g FROM (SELECT DISTINCT qid FROM qrel)) SELECT unnest(['both', 'tree_only', 'kg_only', 'neither']) AS pattern, unnest([count(*) FILTER (WHERE t AND g), count(*) FILTER (WHERE t AND NOT g), count(*) FILTER (WHERE NOT t AND g), count(*) FILTER (WHERE NOT t AND NOT g)]) AS questions FROM x")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    x = _lists(spark, d)
    item = lambda n: x[n].filter("rank <= 10").select("qid", F.col("article_id").alias("item"))
    return evaluate.agreement(item("tree"), item("dual"), _qrels(x))


@registered(f"WITH {_METRICS} SELECT qid, count(*) OVER w AS n, round(avg(hit) OVER w, 6) AS rate FROM metrics WHERE k = 10 WINDOW w AS (ORDER BY qid ROWS UNBOUNDED PRECEDING)")
def running_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.running_hit_rate(_metrics(spark, d))


@registered(f"WITH {_QREL}, f AS (SELECT DISTINCT qid, article_id AS item FROM l_tree WHERE rank <= 5), n AS (SELECT r.qid, r, coalesce(f, 0) AS f, coalesce(b, 0) AS b FROM (SELECT qid, count(*) AS r FROM qrel GROUP BY qid) r LEFT JOIN (SELECT qid, count(*) AS f FROM f GROUP BY qid) USING (qid) LEFT JOIN (SELECT qid, count(*) AS b FROM f JOIN qrel USING (qid, item) GROUP BY qid) USING (qid)) SELECT qid, round(b / greatest(f, 1), 6) AS set_precision, round(b / r, 6) AS set_recall, round(CASE WHEN b > 0 THEN 2 * (b / greatest(f, 1)) * (b / r) / (b / greatest(f, 1) + b / r) ELSE 0 END, 6) AS f1 FROM n")
def set_scores(spark: SparkSession, d: str) -> DataFrame:
    x = _lists(spark, d)
    return evaluate.set_scores(x["tree"].filter("rank <= 5").select("qid", F.col("article_id").alias("item")), _qrels(x))


# ---- without a model


@registered(f"SELECT id AS entity_id, name || ' (' || coalesce(type_str, '') || ')' AS description, array_to_string(({S.words('name')})[1:5], ' ') AS search_keywords, lower(name) AS canonical_form FROM {_ENT} WHERE name IS NOT NULL")
def entity_profiles(spark: SparkSession, d: str) -> DataFrame:
    return profiles.entity_profiles(_corpus(spark, d).entities).drop("confidence")


@registered(f"WITH {_CC}, tn AS (SELECT theme, type_str, count(*) AS n FROM tp JOIN {_ENT} e ON e.id = node WHERE size >= 3 AND i <= 50 GROUP BY ALL), g AS (SELECT theme, arg_min(type_str, (-n, type_str)) AS t, CAST(sum(n) AS BIGINT) AS size FROM tn GROUP BY theme) SELECT theme, substring(sha256('fallback:' || t), 1, 16) AS theme_id, 'Nhóm ' || t AS name, size, 0.5 AS confidence FROM g")
def theme_profiles(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return profiles.theme_profiles(graph.theme_partition(c.edges), c.entities)


_SEEDS = [(k, v) for k, vs in profiles.SEED_SYNONYMS.items() for v in vs]


@registered(f"SELECT informal, formal, max(confidence) AS confidence FROM (SELECT informal, formal, CAST(1.0 AS DOUBLE) AS confidence FROM {S.values(_SEEDS, 'informal, formal')} UNION ALL SELECT lower(name), lower(alias), {S.valid('confidence')} FROM (SELECT name, confidence, unnest(aliases) AS alias FROM kg_entities WHERE type_str = 'LEGAL_TERM') WHERE alias IS NOT NULL AND name IS NOT NULL AND {S.valid('confidence')} >= 0.7) GROUP BY ALL")
def synonym_merge(spark: SparkSession, d: str) -> DataFrame:
    """Names of legal terms and their aliases as mined pairs."""
    e = table(spark, d, "kg_entities").filter("type_str = 'LEGAL_TERM' and name is not null and not isnan(confidence)").select("name", "confidence", F.explode("aliases").alias("alias")).filter("alias is not null")
    return profiles.synonyms(e.select(F.lower("name").alias("informal"), F.lower("alias").alias("formal"), "confidence"))


_KEYWORDS = [("van-dau-tu", "chủ đầu tư", 1.0), ("van-dau-tu", "nhà đầu tư nước ngoài", 1.0), ("hai-quan", "cảng", 0.9), ("hai-quan", "đại lý hải quan", 0.9), ("lao-dong", "người lao động", 0.8)]


@registered(f"SELECT item_id AS qid, doc_id, round(max(least(0.8, 0.3 + 0.15 * len(regexp_split_to_array(keyword, '\\s+'))) * weight), 6) AS confidence FROM (SELECT DISTINCT item_id, lower(question) AS q FROM eval_items) i JOIN (SELECT doc_id, keyword, CAST(weight AS DOUBLE) AS weight FROM {S.values(_KEYWORDS, 'doc_id, keyword, weight')}) k ON contains(q, keyword) GROUP BY ALL")
def doc_detect(spark: SparkSession, d: str) -> DataFrame:
    return profiles.keyword_documents(_questions(spark, d), spark.createDataFrame(_KEYWORDS, "doc_id string, keyword string, weight double"))


@registered(f"""WITH {_LISTS}, t AS (SELECT l.qid, l.rank, a.content AS c, coalesce(sum(length(a.content)) OVER (PARTITION BY l.qid ORDER BY l.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l_tree l JOIN {_ART} a ON a.id = l.article_id WHERE a.content IS NOT NULL),
    p AS (SELECT qid, rank, CASE WHEN length(c) <= 4000 - b THEN c WHEN 4000 - b > 100 THEN substring(c, 1, CAST(4000 - b AS BIGINT)) || '...' END AS p FROM t) SELECT qid, string_agg('[Article ' || rank || ']: ' || p, chr(10) ORDER BY rank) AS context FROM p WHERE p IS NOT NULL GROUP BY qid""")
def rag_context(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return profiles.contexts(_lists(spark, d)["tree"].join(c.articles.select("article_id", "content"), "article_id"))


@registered(f"""WITH RECURSIVE c AS (SELECT * FROM {S.values(dims.ONTOLOGY_CLASSES, 'name, parent, label')}), p AS (SELECT * FROM (VALUES ('hasName', 'Thing'), ('hasOwner', 'Company'), ('issuedBy', 'Document')) AS t(property, domain)), up(node, ancestor) AS (SELECT name, name FROM c UNION ALL SELECT node, parent FROM up JOIN c ON c.name = ancestor WHERE parent IS NOT NULL)
    SELECT node AS name, property, min(node <> domain) AS inherited FROM up JOIN p ON p.domain = ancestor GROUP BY ALL""")
def ontology_properties_inherited(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([("hasName", "Thing"), ("hasOwner", "Company"), ("issuedBy", "Document")], "property string, domain string")
    return ontology.inherited_properties(ontology.default_classes(spark), p)


# ---- the engine


def _models(spark: SparkSession, d: str) -> engine.Models:
    """What stands for models: the tables' scores of the same questions, and themes of the embeddings."""
    c = cut(_components(spark, d))
    one = lambda n, out: c.filter(F.col(n).isNotNull()).select("qid", "article_id", F.col(n).alias(out))
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label").dropDuplicates(["vec_id"])
    themes = _themes(v).withColumnRenamed("label", "theme")
    ids = table(spark, d, "kg_entities").select("id").filter("id is not null").distinct()
    members = ids.select(F.pmod(F.xxhash64("id"), F.lit(10)).cast("int").alias("theme"), F.col("id").alias("entity_id"))
    asked = _questions(spark, d).select("qid").join(v.select(F.col("vec_id").alias("qid"), "embedding"), "qid")
    return engine.Models(one("semantic", "semantic"), one("concept", "concept"), one("keyphrase", "hierarchy"), one("semantic", "similarity"), one("ppr", "model"), (asked, themes, members))


@registered()
def engine_full(spark: SparkSession, d: str) -> DataFrame:
    return engine.retrieve_articles(_questions(spark, d), _corpus(spark, d))


@registered()
def engine_with_models(spark: SparkSession, d: str) -> DataFrame:
    """Every switch on, with scores and themes in the place of models."""
    return engine.retrieve_articles(_questions(spark, d), _corpus(spark, d), evaluate.Ablation.everything(), models=_models(spark, d), mode="dual")


@registered()
def engine_answers(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return engine.answers(engine.retrieve_articles(_questions(spark, d), c), c)


def _ablated(spark: SparkSession, d: str, configurations: list[evaluate.Ablation]) -> DataFrame:
    """(config, k, metrics): averages of configurations; the articles test items refer to are relevant, by number."""
    c, models, questions = _corpus(spark, d), _models(spark, d), cut(_questions(spark, d))
    rel = table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), text.article_number(F.col("article_ref")).cast("string").alias("item")).distinct()
    names = spark.createDataFrame([(i, a.name) for i, a in enumerate(configurations)], "config int, name string")
    r = engine.retrieve_by_all(questions, c, configurations, models=models, mode="dual")
    # A question of a configuration is a question of its own; configurations without a result for it count too.
    run = r.select(F.struct("config", "qid").alias("qid"), text.article_number(F.col("article_id")).cast("string").alias("item"), "rank")
    asked = rel.crossJoin(F.broadcast(names.select("config"))).select(F.struct("config", "qid").alias("qid"), "item")
    m = evaluate.averages(evaluate.metrics(run, asked).withColumn("config", F.col("qid.config")), ("config", "k"))
    return m.join(F.broadcast(names), "config").drop("config").withColumnRenamed("name", "config")


@registered()
def engine_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Every named configuration."""
    return _ablated(spark, d, evaluate.ablations())


@registered()
def engine_part_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Each part of the second tier and of the question's treatment off."""
    return _ablated(spark, d, evaluate.part_ablations())


@registered("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return incremental.windowed_counts(table(spark, d, "events"), "ts", ["event_type"])


# ---- planted texts: what the tables hardly have, with the results that must come out


_TEXTS = [
    ("59-2020-QH14:d1", "Doanh nghiệp thực hiện theo Điều 12, Khoản 3 Luật số 59/2020/QH14. Việc khác do hai bên định."),
    ("59-2020-QH14:d2", "Khoản này được sửa đổi bởi Điều 7 Nghị định số 1/2021/NĐ-CP; phần sau thay thế cho Điều 9."),
    ("59-2020-QH14:d3", "Quy định tại Điều 5 Khoản 2 và Điều 6"),
    ("59-2020-QH14:d4", "Theo khoản 8 Điều 92 văn bản số 4063/2016/CT-TTg, hội đồng họp. Không có gì của điều khác."),
    ("59-2020-QH14:d5", "Không dẫn chiếu gì cả."),
]
_REFS = [
    ("59-2020-QH14:d1", 12, 3, "59/2020/QH14", "THAM_CHIẾU", 1.0), ("59-2020-QH14:d2", 7, None, "1/2021/NĐ-CP", "SỬA_ĐỔI", 0.95), ("59-2020-QH14:d2", 9, None, None, "THAY_THẾ", 0.9),
    ("59-2020-QH14:d3", 5, 2, None, "THAM_CHIẾU", 0.97), ("59-2020-QH14:d4", 92, 8, "4063/2016/CT-TTg", "THAM_CHIẾU", 0.82),
]


@registered("SELECT id, CAST(article AS INTEGER) AS article, CAST(clause AS INTEGER) AS clause, law, predicate, CAST(confidence AS DOUBLE) AS confidence FROM " + S.values(_REFS, "id, article, clause, law, predicate, confidence"))
def crossref_planted(spark: SparkSession, d: str) -> DataFrame:
    """One text for each way to refer."""
    t = spark.createDataFrame(_TEXTS, "id string, content string")
    return extract.crossrefs(t).select("id", "article", "clause", "law", "predicate", "confidence")


_TARGETS = [("59-2020-QH14:d1", "59-2020-QH14:d12", "references"), ("59-2020-QH14:d2", "1-2021-ND-CP:d7", "amends"), ("59-2020-QH14:d2", "59-2020-QH14:d9", "supersedes"), ("59-2020-QH14:d3", "59-2020-QH14:d5", "references"), ("59-2020-QH14:d4", None, "references")]


def _planted_refs(spark: SparkSession) -> DataFrame:
    docs = spark.createDataFrame([("59-2020-QH14",), ("1-2021-ND-CP",)], "id string")
    return extract.resolved_crossrefs(extract.crossrefs(spark.createDataFrame(_TEXTS, "id string, content string")), docs)


@registered("SELECT * FROM " + S.values(_TARGETS, "src_article, dst_article, ref_type"))
def crossref_resolve_planted(spark: SparkSession, d: str) -> DataFrame:
    """Against two documents; a law that isn't there has no target."""
    return _planted_refs(spark).select("src_article", "dst_article", "ref_type")


@registered("SELECT * FROM " + S.values([("59-2020-QH14:d1", "59-2020-QH14:d12", "REFERENCES"), ("59-2020-QH14:d2", "1-2021-ND-CP:d7", "AMENDS"), ("59-2020-QH14:d2", "59-2020-QH14:d9", "SUPERSEDES")], "src, dst, relation_type"))
def crossref_sync_planted(spark: SparkSession, d: str) -> DataFrame:
    """Into a graph that has one of the edges already."""
    return kg.synced_crossrefs(_planted_refs(spark), spark.createDataFrame([("59-2020-QH14:d3", "59-2020-QH14:d5", "REFERENCES")], "src string, dst string, relation_type string"))


@registered("SELECT * FROM " + S.values([("59-2020-QH14:d3", "59-2020-QH14:d5"), ("59-2020-QH14:d5", "59-2020-QH14:d3")], "node_id, related_id"))
def tree_related_planted(spark: SparkSession, d: str) -> DataFrame:
    """Among the five planted articles."""
    return hierarchy.related(spark.createDataFrame([(t[0],) for t in _TEXTS], "node_id string"), _planted_refs(spark))


_REFERS = r"(?i)(?:theo|căn\s+cứ|tại|của)\s+(?:Điểm\s+([a-zđ])[,\s]+)?(?:Khoản\s+(\d+)[,\s]+)?Điều\s+(\d+)(?:\s+(?:văn\s+bản|Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)\s+(?:số\s+)?(\d+/\d{4}/[A-Za-zĐđ0-9-]+))?"


@registered(f"WITH c AS (SELECT DISTINCT id, content FROM legal_articles WHERE content IS NOT NULL), x AS (SELECT id, unnest(list_zip(regexp_extract_all(content, '{_REFERS}', 3), regexp_extract_all(content, '{_REFERS}', 2), regexp_extract_all(content, '{_REFERS}', 4))) AS r FROM c) SELECT DISTINCT id, CAST(r[1] AS INTEGER) AS article, CAST(nullif(r[2], '') AS INTEGER) AS clause, nullif(r[3], '') AS law FROM x")
def crossref_targets(spark: SparkSession, d: str) -> DataFrame:
    """What the articles refer to; the tables' texts name the smallest part first, and the law as a numbered text."""
    return extract.crossrefs(table(spark, d, "legal_articles").select("id", "content").distinct()).select("id", "article", "clause", "law").distinct()


_PARSED = [("Điều 5 Luật số 59/2020/QH14", 5, None, None, "59-2020-QH14"), ("điểm b khoản 2 Điều 17", 17, 2, "b", None), ("Nghị định 1/2021/NĐ-CP", None, None, None, "1-2021-ND-CP"), ("không có", None, None, None, None)]


@registered("SELECT reference, CAST(article AS INTEGER) AS article, CAST(clause AS INTEGER) AS clause, point, document FROM " + S.values(_PARSED, "reference, article, clause, point, document"))
def reference_parse(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(r[0],) for r in _PARSED], "reference string")
    return t.withColumn("p", extract.parsed_reference(F.col("reference"))).select("reference", "p.*")


_GLOSSARY = [
    ("a1", "Giải thích từ ngữ", "Hội đồng thành viên công ty trách nhiệm hữu hạn (sau đây gọi là HDTV) họp định kỳ.", "HDTV", "Hội đồng thành viên công ty trách nhiệm hữu hạn", 0.95),
    ("a2", "Tổ chức họp", "Cơ quan quản lý nhà nước về giá (sau đây gọi tắt là Cơ quan) kiểm tra.", "Cơ quan", "Cơ quan quản lý nhà nước về giá", 0.95),
    ("a3", "Định nghĩa", "Không có từ nào.", None, None, None),
]


@registered("SELECT id, short_form, full_form, CAST(confidence AS DOUBLE) AS confidence FROM " + S.values([(r[0], *r[3:]) for r in _GLOSSARY if r[3] and r[0] != "a2"], "id, short_form, full_form, confidence"))
def terminology_planted(spark: SparkSession, d: str) -> DataFrame:
    """Only articles that explain words by their title count."""
    t = spark.createDataFrame([r[:3] for r in _GLOSSARY], "id string, title string, content string")
    return extract.terminology(t, title="title").select("id", "short_form", "full_form", "confidence")


_FORMS = [("ủy ban nhân dân (UBND) xã và Ủy ban nhân dân (UBND) huyện",), ("Bộ Tài chính (gọi tắt là BTC) ban hành",), ("ABC XYZ (ABC)",)]


@registered("SELECT * FROM " + S.values([("UBND", 80), ("BTC", 95), ("ABC", 80)], "abbr, confidence"))
def abbreviation_planted(spark: SparkSession, d: str) -> DataFrame:
    return extract.full_forms(spark.createDataFrame(_FORMS, "text string"), "text").select("abbr", "confidence")


@registered("SELECT DISTINCT id, article_id FROM (SELECT id, unnest(source_ids) AS article_id FROM kg_entities) WHERE article_id NOT IN (SELECT id FROM legal_articles WHERE id IS NOT NULL AND article_number > 3)")
def link_validate_part(spark: SparkSession, d: str) -> DataFrame:
    """Links of entities against a store that lacks the first three articles of each law."""
    return kg.broken_links(table(spark, d, "kg_entities"), table(spark, d, "legal_articles").filter("article_number > 3"))


# ---- further operators


@registered(f"SELECT DISTINCT entity_type, coalesce({S.mapped(dims.entity_type_map())}[{S.predicate('entity_type')}], 'LEGAL_TERM') AS type_str, list_contains({S.listed(dims.entity_type_map())}, {S.predicate('entity_type')}) AS known FROM kg_entities WHERE entity_type IS NOT NULL")
def entity_type_map(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("entity_type")
    t = table(spark, d, "kg_entities").filter("entity_type is not null")
    return t.select("entity_type", kg.entity_type(c).alias("type_str"), text.predicate(c).isin(*dims.entity_type_map()).alias("known")).distinct()


_KIND = "CASE " + " ".join(f"WHEN starts_with(trim(lower(l)), {S.s(k)}) OR starts_with({S.fold('trim(lower(l))')}, {S.fold(S.s(k))}) THEN {S.s(v)}" for k, v in sorted(dims.DOCUMENT_KINDS.items(), key=lambda x: -len(x[0]))) + " END"


@registered(f"SELECT DISTINCT l AS loai_van_ban, {_KIND} AS kind FROM (SELECT loai_van_ban AS l FROM legal_documents WHERE loai_van_ban IS NOT NULL)")
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_documents").filter("loai_van_ban is not null").select("loai_van_ban", text.document_kind(F.col("loai_van_ban")).alias("kind")).distinct()


_TITLE_WORDS = _KEYS.replace("(x,", "(coalesce(title, ''),")


@registered(f"""WITH a AS (SELECT chapter_id, id, min(title) AS title, min(article_number) AS n FROM legal_articles WHERE chapter_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL), w AS (SELECT chapter_id, lower(unnest({_TITLE_WORDS})) AS w FROM a), c AS (SELECT * FROM (SELECT chapter_id, w, count(*) AS c FROM w GROUP BY chapter_id, w) QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY c DESC, w) <= 10),
    k AS (SELECT chapter_id, string_agg(w, ', ' ORDER BY c DESC, w) AS keywords FROM c GROUP BY chapter_id), t AS (SELECT chapter_id, string_agg(title, '. ' ORDER BY n NULLS FIRST, id) AS x FROM a WHERE title IS NOT NULL GROUP BY chapter_id),
    r AS (SELECT chapter_id, min(article_number) AS f, max(article_number) AS l FROM legal_articles WHERE chapter_id IS NOT NULL AND article_number IS NOT NULL GROUP BY chapter_id), y AS (SELECT r.*, keywords, coalesce(x, '') AS x FROM r LEFT JOIN k USING (chapter_id) LEFT JOIN t USING (chapter_id))
    SELECT chapter_id, CASE WHEN f = l THEN 'Điều ' || f ELSE 'Điều ' || f || '-' || l END AS article_range, coalesce(keywords, '') AS keywords, {_CUT} AS description FROM y""")
def chapter_summaries(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.chapter_summaries(table(spark, d, "legal_articles"))


@registered(f"WITH {_NODES}, t AS (SELECT node_id AS at, min(title) AS title FROM (SELECT id AS node_id, min(title) AS title FROM legal_documents WHERE id IS NOT NULL GROUP BY id UNION ALL SELECT id, title FROM {_ART} WHERE document_id IS NOT NULL) GROUP BY 1), p AS (SELECT node_id, unnest(path) AS at, generate_subscripts(path, 1) AS o FROM nodes) SELECT p.node_id, string_agg(coalesce(title, p.at), ' > ' ORDER BY o) AS trail FROM p LEFT JOIN t ON t.at = p.at GROUP BY p.node_id")
def tree_names(spark: SparkSession, d: str) -> DataFrame:
    return tree.name_path(_nodes(spark, d))


_PROPERTIES = [("hasName", "Thing", "xsd:string"), ("hasShareholder", "Company", "Shareholder"), ("issuedBy", "Document", "Organization")]
_ELEMENTS = sorted({e.lower() for c in dims.ONTOLOGY_CLASSES for e in (c[0], c[2]) if e} | {p[0].lower() for p in _PROPERTIES})


def _default_properties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, "data" if r.startswith("xsd:") else "object", d, r) for n, d, r in _PROPERTIES], "name string, kind string, domains string, ranges string")


@registered(f"""WITH q AS (SELECT DISTINCT item_id, question, category, item_id % 3 AS priority FROM eval_items), w AS (SELECT *, len(list_filter(regexp_split_to_array({S.fold('lower(question)')}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 3 AND len(list_filter({S.listed(_ELEMENTS)}, lambda e: contains(e, w))) > 0)) > 0 AS a FROM q),
    u AS (SELECT 'category' AS dimension, coalesce(category, '') AS value, a FROM w UNION ALL SELECT 'priority', CAST(priority AS VARCHAR), a FROM w UNION ALL SELECT 'all', 'all', a FROM w) SELECT dimension, value, count(*) FILTER (WHERE a) AS answerable, count(*) FILTER (WHERE NOT a) AS unanswerable FROM u GROUP BY ALL""")
def competency_coverage(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_items").select(F.col("item_id").alias("question_id"), "question", "category", (F.col("item_id") % 3).alias("priority")).distinct()
    return ontology.coverage(q, ontology.default_classes(spark), _default_properties(spark))


@registered(f"WITH {_VALID} SELECT (SELECT count(*) FROM {_REL}) AS input, (SELECT count(*) FROM {_REL} WHERE src = dst) AS self_references, count(*) AS kept, count(*) FILTER (WHERE NOT coalesce(list_contains({S.listed(dims.relation_type_map())}, p), FALSE)) AS unknown_types, count(*) FILTER (WHERE NOT ({_RULES})) AS semantic_warnings FROM v")
def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    v = _validated(spark, d).withColumn("known_type", F.coalesce("known_type", F.lit(False)))
    return kg.validation_counts(_relations(spark, d), v)


@registered("SELECT item_id AS qid FROM (SELECT DISTINCT item_id FROM eval_items) ORDER BY item_id LIMIT 20 OFFSET 10")
def question_window(spark: SparkSession, d: str) -> DataFrame:
    """Twenty questions after the first ten: the limits are the feature."""
    return evaluate.selected(_questions(spark, d).select("qid").distinct(), limit=20, offset=10)


_HIT = "EXISTS (SELECT 1 FROM {} l JOIN qrel q ON q.qid = l.qid AND q.item = l.article_id WHERE rank <= 10 AND l.qid = m.qid)"
_DIMENSIONS = ("query_type", "intent", "method", "category", "refs", "confidence", "pattern", "expected_bucket", "volume", "ontology")
_METHOD = "CASE t.query_type " + " ".join(f"WHEN {S.s(r[0])} THEN {S.s(r[1])}" for r in dims.STRATEGIES) + " END"


@registered(f"""WITH {_METRICS}, i AS (SELECT item_id AS qid, min(question) AS question, min(category) AS category FROM eval_items GROUP BY item_id), t AS (SELECT qid, category, {S.query_type('question')} AS query_type, {S.intent('question')} AS intent, len(list_concat(regexp_extract_all(question, '[Đđ]iều\\s+(\\d{{1,9}})', 1), regexp_extract_all(question, '[Đđ]\\.\\s*(\\d{{1,9}})', 1))) > 0 AS refs, {S.any_of('lower(question)', [c[2].lower() for c in dims.ONTOLOGY_CLASSES if c[2]])} AS ontology FROM i),
    a AS (SELECT m.*, t.query_type, t.intent, {_METHOD} AS method, t.category, CAST(t.refs AS VARCHAR) AS refs, CASE WHEN (m.qid % 10) / 10.0 < 0.5 THEN 'low' WHEN (m.qid % 10) / 10.0 < 0.7 THEN 'medium' ELSE 'high' END AS confidence,
        CASE WHEN {_HIT.format('l_tree')} AND {_HIT.format('l_dual')} THEN 'both' WHEN {_HIT.format('l_tree')} THEN 'tree_only' WHEN {_HIT.format('l_dual')} THEN 'kg_only' ELSE 'neither' END AS pattern, CASE WHEN expected <= 1 THEN '1' WHEN expected <= 3 THEN '2-3' ELSE '4+' END AS expected_bucket,
        (SELECT CASE WHEN count(*) = 0 THEN '0' WHEN count(*) <= 10 THEN '1-10' WHEN count(*) <= 30 THEN '11-30' WHEN count(*) <= 50 THEN '31-50' ELSE '51+' END FROM l_tree l WHERE l.qid = m.qid) AS volume, CAST(t.ontology AS VARCHAR) AS ontology FROM metrics m LEFT JOIN t USING (qid) WHERE k = 10),
    u AS ({' UNION ALL '.join(f"SELECT '{c}' AS dimension, coalesce({c}, '(none)') AS value, hit, recall, rr FROM a" for c in _DIMENSIONS)} UNION ALL SELECT 'all', 'all', hit, recall, rr FROM a) SELECT dimension, value, count(*) AS questions, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr FROM u GROUP BY ALL""")
def ir_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """The metrics at 10 by everything an evaluation is broken down by."""
    x = _lists(spark, d)
    m, rel = cut(_metrics(spark, d)), _qrels(x)
    q = table(spark, d, "eval_items").groupBy(F.col("item_id").alias("qid")).agg(F.min("question").alias("q"), F.min("category").alias("category"))
    s = F.broadcast(spark.createDataFrame([r[:2] for r in dims.STRATEGIES], "query_type string, method string"))
    c = F.col("q")
    known = query.any_of(F.lower(c), tuple(k[2].lower() for k in dims.ONTOLOGY_CLASSES if k[2]))
    t = q.select("qid", "category", query.query_type(c).alias("query_type"), query.intent(c).alias("intent"), (F.size(query.article_refs(c)) > 0).alias("refs"), known.alias("ontology")).join(s, "query_type", "left")
    hit = lambda n: x[n].filter("rank <= 10").select("qid", F.col("article_id").alias("item")).join(rel, ["qid", "item"]).select("qid", F.lit(True).alias(f"in_{n}")).distinct()
    size = x["tree"].groupBy("qid").agg(F.count("*").alias("n"))
    a = m.filter("k = 10").select("qid", "expected").join(t, "qid", "left").join(hit("tree"), "qid", "left").join(hit("dual"), "qid", "left").join(size, "qid", "left")
    a = a.withColumn("confidence", evaluate.confidence_bucket((F.col("qid") % 10) / 10.0)).withColumn("pattern", evaluate.hit_pattern(F.col("in_tree"), F.col("in_dual")))
    a = a.withColumn("expected_bucket", evaluate.expected_bucket(F.col("expected"))).withColumn("volume", evaluate.volume_bucket(F.col("n")))
    return evaluate.breakdown(m, a.select("qid", *_DIMENSIONS), _DIMENSIONS)


@registered(f"""WITH {_VEC}, th AS (SELECT label, list(m ORDER BY i) AS a FROM (SELECT label, i, avg(a[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label), s AS (SELECT qid, label, {_COS.replace('a,', 'th.a,').replace('(a', '(th.a').replace('th.th.', 'th.')} AS similarity FROM th, qv),
    f AS (SELECT entity_id, arg_min(article_id, (ord, article_id)) AS article_id FROM {_MEN} GROUP BY entity_id) SELECT qid, article_id, max(similarity) AS theme FROM s JOIN (SELECT DISTINCT CAST(right(id, 1) AS INTEGER) AS label, id FROM kg_entities WHERE regexp_matches(id, '[0-9]$')) m USING (label) JOIN f ON f.entity_id = m.id GROUP BY ALL""")
def theme_articles(spark: SparkSession, d: str) -> DataFrame:
    """From vectors through themes to articles; an entity's theme is the last digit of its id here."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label").dropDuplicates(["vec_id"])
    members = table(spark, d, "kg_entities").filter(F.col("id").rlike("[0-9]$")).select(F.right("id", F.lit(1)).cast("int").alias("theme"), F.col("id").alias("entity_id")).distinct()
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return retrieve.high_level(asked, _themes(v).withColumnRenamed("label", "theme"), members, _corpus(spark, d).mentions)


@registered(f"WITH {_LISTS}, u AS (SELECT qid, article_id, rank FROM l_tree UNION ALL SELECT qid, article_id, rank FROM l_dual), m AS (SELECT qid, article_id, min(rank) AS o FROM u GROUP BY ALL) SELECT qid, article_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY o, article_id) AS INTEGER) AS rank FROM m QUALIFY rank <= 7")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    """The first seven different articles of two lists: the limit is the feature."""
    x = _lists(spark, d)
    return retrieve.first_distinct(x["tree"].select("qid", "article_id", "rank").unionByName(x["dual"].select("qid", "article_id", "rank")))


@registered()
def entity_remap(spark: SparkSession, d: str) -> DataFrame:
    return kg.remap_of(kg.comparable_pairs(_corpus(spark, d).entities.select(F.col("entity_id").alias("id"), "name", "type_str")))


@registered()
def entity_remap_greedy(spark: SparkSession, d: str) -> DataFrame:
    return kg.greedy_remap(kg.comparable_pairs(_corpus(spark, d).entities.select(F.col("entity_id").alias("id"), "name", "type_str")))


@registered()
def offline_graph(spark: SparkSession, d: str) -> DataFrame:
    """How many entities and relations raw extraction comes to."""
    e, r = engine.offline_graph(table(spark, d, "entity_feed").select("record_id", "name", "type_str", "description", "confidence", "source_id", "document_id").distinct(), _corpus(spark, d).edges)
    return hierarchy.table_counts(entities=e, relations=r)


@registered()
def tree_related(spark: SparkSession, d: str) -> DataFrame:
    refs = extract.resolved_crossrefs(extract.crossrefs(table(spark, d, "legal_articles").select("id", "content").distinct()), table(spark, d, "legal_documents"))
    return hierarchy.related(_nodes(spark, d), refs)


@registered()
def ontology_turtle(spark: SparkSession, d: str) -> DataFrame:
    return ontology.turtle(ontology.default_classes(spark), properties=_default_properties(spark))


@registered("SELECT DISTINCT e.id, a.id AS article_id FROM (SELECT id, name, unnest(source_ids) AS article_id FROM kg_entities WHERE length(name) > 0) e JOIN " + _ART + " a ON a.id = e.article_id WHERE contains(lower(a.content), lower(e.name))")
def entity_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The entities that their sources name, by where they stand."""
    arts = _corpus(spark, d).articles
    return kg.entity_contexts(table(spark, d, "kg_entities"), arts).select("id", "article_id").distinct()


@registered(f"SELECT entity_id, CAST(max(n) AS BIGINT) AS rows FROM (SELECT {S.slug('name')} AS entity_id, count(*) AS n FROM {_FEED} GROUP BY ALL) WHERE length(entity_id) > 0 GROUP BY entity_id")
def merged_stream(spark: SparkSession, d: str) -> DataFrame:
    """The feed in two batches, the second merged into the first, as a stream merges them."""
    f = _feed(spark, d)
    parts = [kg.merged_entities(f.filter(F.pmod("ord", F.lit(2)) == b)).withColumn("batch", F.lit(b)) for b in (0, 1)]
    return incremental.folded(parts[0].unionByName(parts[1])).select("entity_id", F.col("occurrence_count").alias("rows"))


@registered()
def abbreviations_listed(spark: SparkSession, d: str) -> DataFrame:
    """Those used twice or more, the most used first."""
    return extract.listed_abbreviations(extract.abbreviations(table(spark, d, "documents").select("doc_id", "text").distinct(), "text"), least=2)


@registered()
def ontology_questions(spark: SparkSession, d: str) -> DataFrame:
    return ontology.expanded_questions(_questions(spark, d), ontology.default_classes(spark), "all")


_NEAR_PLANTED = [(1, "Company", "công ty cổ phần,công ty trách nhiệm hữu hạn,doanh nghiệp tư nhân,công ty hợp danh,công ty TNHH một thành viên,công ty TNHH hai thành viên"), (2, "Law", ""), (3, "", "")]


@registered("SELECT qid, matched, terms FROM " + S.values(_NEAR_PLANTED, "qid, matched, terms"))
def ontology_questions_planted(spark: SparkSession, d: str) -> DataFrame:
    """A label, a word within a label, and neither."""
    q = spark.createDataFrame([(1, "Công ty"), (2, "luật"), (3, "zzz"), (4, None)], "qid int, text string")
    return ontology.expanded_questions(q, ontology.default_classes(spark)).select("qid", F.array_join("matched", ",").alias("matched"), F.array_join("terms", ",").alias("terms"))


_NAMED = f"nr AS (SELECT r.relation_id, {S.slug('a.name')} AS src, {S.slug('b.name')} AS dst, predicate, evidence, confidence, article_ids FROM {_REL} r JOIN {_ENT} a ON a.id = src JOIN {_ENT} b ON b.id = dst), fs AS (SELECT DISTINCT {S.slug('name')} AS s FROM {_FEED}), nk AS (SELECT * FROM nr WHERE src <> dst AND src IN (SELECT s FROM fs) AND dst IN (SELECT s FROM fs))"


@registered(f"WITH {_NAMED} SELECT src, predicate, dst, max({S.valid('confidence')}) AS confidence, count(*) AS occurrence_count, array_to_string(list_sort(list_distinct(flatten(list(article_ids)))), ',') AS article_ids FROM nk GROUP BY ALL")
def kg_build(spark: SparkSession, d: str) -> DataFrame:
    """The relations of a graph built from the feed's entities and relations between names, without self-loops and ends the feed doesn't name."""
    names = _corpus(spark, d).entities
    r = _relations(spark, d).join(names.select(F.col("entity_id").alias("src"), F.col("name").alias("source")), "src").join(names.select(F.col("entity_id").alias("dst"), F.col("name").alias("target")), "dst")
    m = kg.built(_feed(spark, d), r.drop("src", "dst"))[1]
    return m.select("src", "predicate", "dst", "confidence", "occurrence_count", F.array_join("article_ids", ",").alias("article_ids"))


FLAGSHIP = "rrf_merge"
