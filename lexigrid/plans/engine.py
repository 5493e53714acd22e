"""The whole way from questions to ranked articles, and from raw extraction to a graph, as plans over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import dims, query, text
from lexigrid.operators import graph, kg, ontology, retrieve, tree
from lexigrid.operators.evaluate import Ablation
from lexigrid.session import cut
from lexigrid.sources import io

#: Keyphrase score from which an entity seeds PageRank.
SEED_LEAST = 0.3
#: Characters of a text by which repeats are told.
HEAD = 200
#: Similarity above which an article from the graph has to do with the question.
RELEVANT = 0.4
#: Articles that the graph and names give a question at most.
DUAL_MOST = 50
#: Scores of questions and article numbers that go to every task, some 30 MB at most.
RANK_ROWS = 1_000_000


@dataclass(frozen=True)
class Corpus:
    """documents (document_id, title), articles (article_id, document_id, chapter_id, article_number, content[, chapter_title]), entities (entity_id, name,
    type_str), mentions (entity_id, article_id, article_number, ord), edges (src, dst, relation_type, confidence)."""

    documents: DataFrame
    articles: DataFrame
    entities: DataFrame
    mentions: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Models:
    """What models have to say, each optional; without it the engine does what needs none.

    Scores are frames of question and article: semantic (qid, article_id, semantic), concept (.., concept), hierarchy (.., hierarchy), relevance
    (.., similarity), rerank (.., model). themes is (vectors of questions (qid, embedding), theme index (theme, embedding), members (theme, entity_id)). picks
    (qid, level, node_id, place, confidence) are the model's choices on the tree. answer writes from a prompt, with its cache (cache_key, response).
    """

    semantic: DataFrame | None = None
    concept: DataFrame | None = None
    hierarchy: DataFrame | None = None
    relevance: DataFrame | None = None
    rerank: DataFrame | None = None
    themes: tuple[DataFrame, DataFrame, DataFrame] | None = None
    picks: DataFrame | None = None
    answer: Callable[[str], str] | None = None
    cache: DataFrame | None = None


@dataclass
class Shared:
    """What runs of several configurations over the same questions and corpus have in common, computed once."""

    done: dict = field(default_factory=dict)

    def value(self, key: tuple, make: Callable[[], object]):
        if key not in self.done:
            self.done[key] = make()
        return self.done[key]

    def get(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        return self.value(key, lambda: cut(make()))


def corpus(documents: DataFrame, articles: DataFrame, entities: DataFrame, relations: DataFrame) -> Corpus:
    """A corpus from the tables of laws, articles, entities and relations; deleted entities, repeated rows and edges to nowhere are left out."""
    docs = documents.filter("id is not null").groupBy(F.col("id").alias("document_id")).agg(F.min("title").alias("title"))
    cols = ["document_id", "chapter_id", "article_number", "content", *(["chapter_title"] if "chapter_title" in articles.columns else [])]
    arts = articles.filter("id is not null").groupBy(F.col("id").alias("article_id")).agg(*[F.min(c).alias(c) for c in cols])
    live = entities.filter("deleted_at is null and id is not null")
    ents = live.groupBy(F.col("id").alias("entity_id")).agg(F.min("name").alias("name"), F.min("type_str").alias("type_str"))
    m = live.select(F.col("id").alias("entity_id"), F.posexplode("source_ids").alias("ord", "article_id")).distinct()
    m = m.select("entity_id", "article_id", text.article_number(F.col("article_id")).alias("article_number"), "ord")
    key = lambda c: F.lower(F.trim(F.col(c)))
    e = relations.select(key("source_id").alias("src"), key("target_id").alias("dst"), "relation_type", F.when(~F.isnan("confidence") & F.col("confidence").between(0, 1), F.col("confidence")).otherwise(0.5).alias("confidence"))
    ids = ents.select("entity_id")
    e = e.distinct().join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").select("src", "dst", "relation_type", "confidence")
    return Corpus(docs, arts, ents, m, e)


#: The intents of questions as PageRank knows them.
INTENTS = {"penalty": "consequence", "definition": "concept", "procedure": "procedure", "requirement": "obligation", "reference": "general", "general": "general"}


def intents_of(analyzed: DataFrame) -> DataFrame:
    """(intent_set, intent, weight): each question's intent as PageRank knows them; the name is the set."""
    return analyzed.sparkSession.createDataFrame([(k, v, 1.0) for k, v in INTENTS.items()], "intent_set string, intent string, weight double")


def _asked(analyzed: DataFrame, switches: Ablation, s: Shared | None = None) -> DataFrame:
    """(qid, text): what is looked up in the graph: the question with abbreviations and synonyms, and the labels the ontology adds."""
    q = analyzed.select("qid", F.col("expanded" if switches.query_expansion else "text").alias("text"))
    if not switches.ontology:
        return q

    def labels() -> DataFrame:
        terms = ontology.expanded_terms(analyzed.select("qid", "text"), ontology.default_classes(analyzed.sparkSession)).filter("relation <> 'named' and label is not null")
        return terms.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), " ").alias("more"))

    return q.join((s or Shared()).get(("labels",), labels), "qid", "left").select("qid", F.concat_ws(" ", "text", "more").alias("text"))


def _pagerank(analyzed: DataFrame, asked: DataFrame, c: Corpus, switches: Ablation, iterations: int, s: Shared) -> DataFrame:
    """(qid, number, score): PageRank from the entities whose names fit, the greatest of an article number; a question walks on its intent's edges."""
    sets = analyzed.select("qid", (F.col("intent") if switches.classification else F.lit("general")).alias("intent_set"))
    ids = s.get(("ids",), lambda: graph.numbered(c.edges, c.entities.select("entity_id")))
    edges = s.get(("coded",), lambda: graph.coded(c.edges, ids))
    named = s.get(("named entities",), lambda: c.entities.join(ids, c.entities["entity_id"] == ids["node"]).select("id", "name"))
    numbers = s.get(("numbers",), lambda: graph.first_numbers(c.mentions).join(ids, "node").select("id", "number"))
    w = graph.transition(edges, intents_of(analyzed).join(F.broadcast(sets.select("intent_set").distinct()), "intent_set", "left_semi"))
    if 2 * edges.count() <= graph.BLOCK_EDGES:
        return graph.pagerank_numbers(w, sets, retrieve.packed_seeds(asked, named, SEED_LEAST), numbers, ids.count(), iterations=iterations)
    # A node of a question walks on its intent's edges: both go into one key.
    seeds = retrieve.keyphrase_scores(asked, named.withColumnRenamed("id", "entity_id"), SEED_LEAST).select("qid", F.col("entity_id").alias("id"), F.col("score").alias("weight"))
    of = lambda x: F.concat_ws("\x01", "intent_set", x)
    p = graph.personalized_pagerank(w.select(of("src").alias("src"), of("dst").alias("dst"), "w"), seeds.join(sets, "qid").select("qid", of("id").alias("node"), "weight"), iterations=iterations)
    p = p.withColumn("id", F.split_part("node", F.lit("\x01"), F.lit(2)).cast("int"))
    return p.join(numbers, "id").groupBy("qid", "number").agg(F.max("score").alias("score"))


def dual(analyzed: DataFrame, c: Corpus, switches: Ablation, iterations: int = 50, models: Models = Models(), mode: str = "low", shared: Shared | None = None) -> DataFrame:
    """(qid, article_id, score, rank): keyphrase, PageRank and what models say combined per article; mode 'low', or 'dual' with themes and hierarchy."""
    return duals(analyzed, c, [switches], iterations, models, mode, shared).withColumn("qid", F.col("qid.qid"))


def duals(analyzed: DataFrame, c: Corpus, several: Sequence[Ablation], iterations: int = 50, models: Models = Models(), mode: str = "low", shared: Shared | None = None) -> DataFrame:
    """dual by each of several switches as one plan; qid is (config, qid), the place of the switches and the question."""
    s = shared or Shared()
    scores = {name: getattr(models, name) for name in ("semantic", "concept") if getattr(models, name) is not None}
    # Frames with a column of the part's name, and the places of the switches that take it from there.
    parts: dict[str, dict[int, tuple[DataFrame, list[int]]]] = {}

    def take(name: str, x: DataFrame, place: int) -> None:
        parts.setdefault(name, {}).setdefault(id(x), (x, []))[1].append(place)

    for place, switches in enumerate(several):
        words = (switches.query_expansion, switches.ontology)
        asked = s.get(("asked", *words), lambda: _asked(analyzed, switches, s))
        themed = mode == "dual" and models.themes is not None
        of_ppr = ("ppr", *words, switches.classification, iterations) if switches.ppr else ()
        numbers = s.get(of_ppr, lambda: _pagerank(analyzed, asked, c, switches, iterations, s)) if switches.ppr else None
        if (0 if numbers is None else s.value(("count", *of_ppr), numbers.count)) > RANK_ROWS:
            if switches.keyphrase:
                take("keyphrase", s.get(("articles", *words), lambda: retrieve.mentioned_keyphrase(asked, c.entities, c.mentions)), place)
            if switches.ppr:
                take("ppr", s.value(("spread", *of_ppr), lambda: graph.articles_of_numbers(numbers, c.mentions).withColumnRenamed("score", "ppr")), place)
            if themed and switches.theme:
                take("theme", s.get(("theme",), lambda: retrieve.high_level(*models.themes, c.mentions)), place)
        elif switches.keyphrase or switches.ppr or themed and switches.theme:
            # Of most articles there is nothing but these and the theme, and of them the first of a question only are wanted: an article with less of all than they have has no place.
            # Models that are off only add pairs, so one frame serves all configurations of the same words.
            also = None
            for x in [*scores.values(), *([models.hierarchy] if mode == "dual" and models.hierarchy is not None else [])]:
                also = x.select("qid", "article_id") if also is None else also.union(x.select("qid", "article_id"))
            near = grouped = None
            if themed:
                near, grouped = s.value(("themes",), lambda: tuple(map(cut, retrieve.themes_near(*models.themes, c.mentions))))
            best = s.get(
                ("best", mode, *words, *of_ppr, switches.keyphrase),
                lambda: retrieve.best_articles(asked, c.entities, c.mentions, numbers, DUAL_MOST, switches.keyphrase, also, s.value(("slack",), lambda: _slack(scores)), near, grouped),
            )
            for name in ("keyphrase", "ppr", *(["theme"] if themed else [])):
                if getattr(switches, name):
                    take(name, best, place)
        for name, x in scores.items():
            if getattr(switches, name):
                take(name, x, place)
        if mode == "dual" and models.hierarchy is not None and switches.hierarchy:
            take("hierarchy", models.hierarchy, place)
    given = {name: _union([_keyed(x.select("qid", "article_id", name), places) for x, places in xs.values()]) for name, xs in parts.items()}
    theme, hierarchy = (given[name].filter(F.col(name).isNotNull()) if name in given else None for name in ("theme", "hierarchy"))
    low = [given[name].select("qid", "article_id", F.lit(name).alias("part"), F.col(name).alias("v")) for name in ("keyphrase", "ppr", "semantic", "concept") if name in given]
    if low:
        d = _union(low)
    else:
        d = _keyed(analyzed.select("qid", F.lit(None).cast("string").alias("article_id"), F.lit("none").alias("part"), F.lit(None).cast("double").alias("v")), [0]).limit(0)
    pick = lambda n: F.max(F.when(F.col("part") == n, F.col("v"))).alias(n)
    low = retrieve.low_level(d.groupBy("qid", "article_id").agg(*map(pick, ("keyphrase", "ppr", "semantic", "concept")))).withColumn("low", F.round("low", 9))
    return retrieve.ranked(retrieve.fused(low, theme, hierarchy, mode=mode), k=DUAL_MOST)


def _keyed(x: DataFrame, places: Sequence[int]) -> DataFrame:
    """x for each of the places of configurations: qid becomes (config, qid)."""
    if len(places) == 1:
        return x.withColumn("qid", F.struct(F.lit(places[0]).alias("config"), "qid"))
    return x.withColumn("_c", F.explode(F.array(*map(F.lit, places)))).withColumn("qid", F.struct(F.col("_c").alias("config"), F.col("qid"))).drop("_c")


def _dealt(x: DataFrame, to: Sequence[Sequence[int]]) -> DataFrame:
    """x, whose qid is (config, qid), given to the configurations that `to` has in the place of its own; to none where it has none."""
    if list(map(list, to)) == [[j] for j in range(len(to))]:
        return x
    places = F.array(*[F.array(*map(F.lit, y)).cast("array<int>") for y in to])
    d = x.withColumn("_c", F.explode(F.get(places, F.col("qid.config"))))
    return d.withColumn("qid", F.struct(F.col("_c").alias("config"), F.col("qid.qid").alias("qid"))).drop("_c")


def _slack(said: dict[str, DataFrame]) -> float:
    """How far apart sums may be that are the same after rounding to nine places of the greatest, which what models say may raise."""
    most = [x.agg(F.max(F.abs(name))).first()[0] or 0.0 for name, x in said.items()]
    return 1e-8 * (1 + sum(most))


def kg_expanded(seeds: DataFrame, c: Corpus, most: int = 3) -> DataFrame:
    """(qid, article_id, rank): articles of entities that the seeds' entities lead to, not seeds themselves, by the edge's confidence, `most` per question."""
    first = graph.first_articles(c.mentions)
    s = seeds.select("qid", "article_id").distinct()
    src = s.join(c.mentions.select("entity_id", "article_id").distinct(), "article_id").select("qid", F.col("entity_id").alias("src")).distinct()
    step = src.join(c.edges, "src").groupBy("qid", "dst").agg(F.max("confidence").alias("confidence"))
    found = step.join(first.withColumnRenamed("entity_id", "dst"), "dst").groupBy("qid", "article_id").agg(F.max("confidence").alias("score"))
    return retrieve.ranked(found.join(s, ["qid", "article_id"], "left_anti"), k=most).select("qid", "article_id", "rank")


def kg_expanded_by_chapters(seeds: DataFrame, c: Corpus, relevance: DataFrame | None = None, cross: int = 3, same: int = 2, most: int = 3) -> DataFrame:
    """(qid, article_id, rank, crosses): articles that the graph relates to the seeds (qid, article_id): strong relations into chapters the seeds don't have,
    and relations that explain or extend, into any; at most `cross` of other chapters and `same` of the seeds' own, of them the first `most`.

    The surest relation goes first, ties by id; an article that comes both ways counts as crossing. With relevance (qid, article_id, similarity) only articles above
    RELEVANT count. Articles without chapter are in no chapter and so never cross.
    """
    s = seeds.select("qid", "article_id").distinct()
    chapter = c.articles.select("article_id", "chapter_id").filter("chapter_id is not null").dropDuplicates(["article_id"])
    related = s.join(graph.related_articles(c.edges, c.mentions), "article_id").select("qid", F.col("related_id").alias("article_id"), "relation_type", "confidence")
    related = related.filter(F.col("relation_type").isin(*dims.STRONG_RELATIONS, *dims.EXPANSION_RELATIONS)).join(s, ["qid", "article_id"], "left_anti")
    own = s.join(chapter, "article_id").select("qid", "chapter_id", F.lit(True).alias("own")).distinct()
    d = related.join(chapter, "article_id", "left").join(own, ["qid", "chapter_id"], "left")
    d = d.withColumn("crosses", F.col("chapter_id").isNotNull() & F.col("own").isNull()).filter(F.col("crosses") | F.col("relation_type").isin(*dims.EXPANSION_RELATIONS))
    if relevance is not None:
        d = d.join(relevance.filter(F.col("similarity") > RELEVANT).select("qid", "article_id").distinct(), ["qid", "article_id"], "left_semi")
    g = d.groupBy("qid", "article_id").agg(F.max("crosses").alias("crosses"), F.max("confidence").alias("score"))
    g = retrieve.ranked(g.withColumn("_p", F.struct("qid", "crosses")), rank="_n", by="_p").filter(F.when(F.col("crosses"), F.col("_n") <= cross).otherwise(F.col("_n") <= same))
    g = g.withColumn("_s", F.col("score") + F.when(F.col("crosses"), 2).otherwise(0))
    return retrieve.ranked(g, score="_s", k=most).select("qid", "article_id", "rank", "crosses")


def _documents_named(analyzed: DataFrame) -> DataFrame:
    """(qid, doc_type, number, year): the documents questions name by number."""
    return query.detected_documents(analyzed.select("qid", "text"), "qid", "text").filter("number is not null").select("qid", "doc_type", "number", "year")


def with_document(results: DataFrame) -> DataFrame:
    """results with doc_type, number and year of the article's document, as its id has them: 4114-2001-ND-CP is decree 4114 of 2001."""
    p = F.split(text.document_of(F.col("article_id")), "-")
    kind = {"ND": "nghi_dinh", "TT": "thong_tu", "QD": "quyet_dinh", "NQ": "nghi_quyet"}
    t = F.coalesce(F.try_element_at(text.literal_map(kind), F.upper(F.get(p, F.lit(2)))), F.when(F.upper(F.get(p, F.lit(2))).startswith("QH"), "luat"))
    return results.withColumn("doc_type", t).withColumn("number", F.get(p, F.lit(0))).withColumn("year", F.get(p, F.lit(1)))


def _lightened(c: Corpus, s: Shared) -> Corpus:
    """The corpus as retrieval needs it, each table worked out once: of contents the beginning, by which repeats are told; what begins with blanks only is marked."""
    head = F.substring("content", 1, HEAD)
    begun = F.when(F.length(F.trim(head)) > 0, head).when(F.length(F.trim("content")) > 0, F.concat(head, F.lit("…")))
    articles = s.get(("articles",), lambda: c.articles.withColumn("content", begun))
    return Corpus(c.documents, articles, s.get(("entities",), lambda: c.entities), s.get(("mentions",), lambda: c.mentions), s.get(("edges",), lambda: c.edges))


def retrieve_articles(
    queries: DataFrame, c: Corpus, switches: Ablation = Ablation(), top: int = 50, iterations: int = 50, models: Models = Models(), mode: str = "low", shared: Shared | None = None
) -> DataFrame:
    """(qid, article_id, score, source, rank): the ranked articles of each question (qid, text).

    Every switch is read here or in dual. What a model would say comes from models; without it that part is silent.
    """
    return retrieve_by_all(queries, c, [switches], top, iterations, models, mode, shared).drop("config")


def retrieve_by_all(
    queries: DataFrame, c: Corpus, configurations: Sequence[Ablation], top: int = 50, iterations: int = 50, models: Models = Models(), mode: str = "low", shared: Shared | None = None
) -> DataFrame:
    """(config, qid, article_id, score, source, rank): retrieve_articles by each of the configurations, told by their place, as one plan.

    What configurations have in common is worked out once. Their lists are merged, filled up and ranked together: a question of a configuration is a key of its own.
    """
    s = shared or Shared()
    a = s.get(("analyzed",), lambda: query.analyzed(queries))
    c = _lightened(c, s)
    names = [_names(x) for x in configurations]
    lists = _lists(queries, a, c, configurations, iterations, models, mode, s)
    if len(configurations) > 1:
        lists = {name: cut(x) for name, x in lists.items()}
    only = lambda name, of: lists[name] if len(of) == len(configurations) else lists[name].filter(F.col("qid.config").isin(of))
    some = lambda name, of: only(name, of).select("qid", "article_id", "rank")
    having = lambda name, of: [i for i in of if name in names[i]]
    fused = [i for i, x in enumerate(configurations) if names[i] and x.rrf and x.bridge]
    sure = [i for i, x in enumerate(configurations) if x.rrf and not x.bridge and x.tree]  # two lists by the tree's confidence
    rest = [i for i in range(len(configurations)) if names[i] and i not in fused and i not in sure]  # one list after the other
    merged = []
    if fused:
        merged.append(retrieve.rrf({name: some(name, of) for name in ("tree", "dual", "kg") if (of := having(name, fused))}))
    if sure:
        conf = only("tree", sure).groupBy("qid").agg(F.max("confidence").alias("confidence"))
        second = {name: [i for i in having(name, sure) if name == "dual" or "dual" not in names[i]] for name in ("dual", "kg")}
        others = [some(name, of) for name, of in second.items() if of] or [some("tree", sure).limit(0)]
        merged.append(retrieve.weighted_by_confidence(some("tree", sure), _union(others), conf).withColumn("source", F.lit("merged")))
    rows = []
    for name in ("tree", "dual", "kg"):
        if of := having(name, rest):
            first = F.get(F.array(*[F.lit(1.0 - 0.3 * (x.index(name) if name in x else 0)) for x in names]), F.col("qid.config"))
            rows.append(some(name, of).select("qid", "article_id", (first - F.col("rank") / 1000).alias("score"), F.lit(name).alias("source")))
    if rows:
        merged.append(_union(rows).groupBy("qid", "article_id").agg(F.max("score").alias("score"), F.max_by("source", "score").alias("source")))
    if not merged:
        return queries.sparkSession.createDataFrame([], "config int, qid long, article_id string, score double, source string, rank int")
    merged = _union([x.select("qid", "article_id", "score", "source") for x in merged])
    merged = merged.join(c.articles.filter("length(trim(content)) > 0").select("article_id"), "article_id", "left_semi").select("qid", "article_id", "score", "source")
    switched = lambda switch: [i for i, x in enumerate(configurations) if getattr(x, switch)]
    within = lambda x, switch: x.filter(F.col("qid.config").isin(switched(switch)))
    if switched("adjacent"):
        merged = cut(merged)
        near = retrieve.neighbours(within(merged, "adjacent"), c.articles).select("qid", "article_id", "score", F.lit("adjacent").alias("source"))
        merged = merged.unionByName(near)
    if switched("document_filter"):
        named = s.get(("named",), lambda: _documents_named(a)).withColumn("config", F.explode(F.array(*map(F.lit, switched("document_filter"))))).withColumn("qid", F.struct("config", "qid"))
        merged = retrieve.filtered_by_document(with_document(merged), named, "rerank").select("qid", "article_id", "score", "source")
    with_text = merged.join(c.articles.select("article_id", "content"), "article_id")
    best = retrieve.without_repeats(with_text)
    if switched("rerank") and models.rerank is not None:
        said = models.rerank.select(F.col("qid").alias("_q"), "article_id", "model")
        scored = best.withColumn("_q", F.col("qid.qid")).join(said, ["_q", "article_id"], "left").withColumn("model", F.coalesce("model", F.lit(0.0)))
        again = retrieve.reranked(within(scored, "rerank"), "model", top).withColumn("score", F.col("blended"))
        best = again.select("qid", "article_id", "score", "source").unionByName(best.filter(~F.col("qid.config").isin(switched("rerank"))).select("qid", "article_id", "score", "source"))
    return retrieve.ranked(best, k=top).select("qid.config", "qid.qid", "article_id", F.round("score", 6).alias("score"), "source", "rank")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _names(x: Ablation) -> list[str]:
    """The lists that a configuration merges, in their order."""
    kg = x.tree and (x.kg_expansion or x.dual and x.cross_check) or x.dual and x.kg_expansion and x.kg_retrieval
    return [name for name, there in (("tree", x.tree), ("dual", x.dual), ("kg", kg)) if there]


def _lists(queries: DataFrame, a: DataFrame, c: Corpus, configurations: Sequence[Ablation], iterations: int, models: Models, mode: str, s: Shared) -> dict[str, DataFrame]:
    """The lists (qid, article_id, rank) that configurations merge, by name; the tree's has its confidence. qid is (config, qid).

    Each step is one plan for all configurations; what some of them have in common is worked out once and dealt out to them.
    """
    lists: dict[str, DataFrame] = {}
    extra = []
    on = lambda *switches: [i for i, x in enumerate(configurations) if all(getattr(x, y) for y in switches)]
    t = None
    if trees := on("tree"):
        t = s.get(("tree",), lambda: tree.searched(c.documents, c.articles, queries, models.picks).select("qid", "article_id", "rank", "confidence"))
        lists["tree"] = _keyed(t, trees)
    if on("dual"):
        parts = ("keyphrase", "ppr", "semantic", "concept", "theme", "hierarchy", "query_expansion", "ontology", "classification")
        of_dual = lambda x: tuple(getattr(x, y) for y in parts)
        kinds: dict[tuple, list[int]] = {}
        for i in on("dual"):
            kinds.setdefault(of_dual(configurations[i]), []).append(i)
        one = [configurations[of[0]] for of in kinds.values()]
        d = s.get(("dual", mode, iterations, *kinds), lambda: duals(a, c, one, iterations, models, mode, s))

        def of_kinds(which: Sequence[int]) -> tuple[list[int], list[list[int]], tuple]:
            # The kinds of dual that these configurations have, which of them have each, and the name of all that.
            to = [[i for i in of if i in which] for of in kinds.values()]
            places = [j for j, x in enumerate(to) if x]
            return places, to, (mode, iterations, len(kinds), *[(j, k) for j, k in enumerate(kinds) if to[j]])

        within = lambda x, places: x if len(places) == len(kinds) else x.filter(F.col("qid.config").isin(places))
        for bridge in (True, False):
            which = [i for i in on("tree", "dual", "cross_check") if configurations[i].bridge == bridge]
            if which:
                places, to, name = of_kinds(which)
                x = s.get(("cross", bridge, name), lambda: retrieve.ranked(retrieve.cross_check(_keyed(t, places), within(d, places), c.articles, bridge=bridge)).select("qid", "article_id", "rank"))
                extra.append(_dealt(x, to))
        filtered = on("tree", "dual", "filter_dual")
        whole = [i for i in on("dual") if i not in filtered]
        dual_lists = []
        if whole:
            dual_lists.append(_dealt(d.select("qid", "article_id", "rank"), of_kinds(whole)[1]))
        if filtered:
            places, to, name = of_kinds(filtered)
            both = s.get(("overlap", name), lambda: retrieve.overlap(_keyed(t, places), within(d, places)).select("qid", "ratio"))

            def kept() -> DataFrame:
                # What dual has below the threshold, lowered for unclear questions, is not merged.
                of = lambda switch: F.col("qid.config").isin([i for i in filtered if getattr(configurations[i], switch)])
                conf = t.groupBy("qid").agg(F.max("confidence").alias("confidence"))
                q = _keyed(a.join(conf, "qid", "left"), filtered)
                kind = F.when(of("classification"), F.col("query_type")).otherwise("general")
                lower = retrieve.ambiguity(F.col("text"), kind, F.col("article_refs"), F.coalesce("confidence", F.lit(0.0)))
                cal = q.select("qid", F.when(of("ambiguity"), lower).otherwise(1.0).alias("calibration"))
                limit = F.when(of("adaptive_threshold"), retrieve.adaptive_threshold(F.col("ratio"))).otherwise(retrieve.FIXED_THRESHOLD)
                return retrieve.ranked(retrieve.calibrated(_dealt(d, to), _dealt(both, to).select("qid", limit.alias("threshold")), cal).drop("rank")).select("qid", "article_id", "rank")

            flags = [(i, of_dual(x := configurations[i]), x.ambiguity, x.adaptive_threshold) for i in filtered]
            dual_lists.append(s.get(("kept", mode, iterations, *flags), kept))
        lists["dual"] = _union(dual_lists)
        if which := on("dual", "kg_expansion", "kg_retrieval"):
            places, to, name = of_kinds(which)
            x = s.get(("expanded", name), lambda: kg_expanded(within(d, places).filter("rank <= 5"), c))
            extra.append(_dealt(x, to))
    if which := on("tree", "kg_expansion"):
        x = s.get(("chapters",), lambda: kg_expanded_by_chapters(t, c, models.relevance).select("qid", "article_id", "rank"))
        extra.append(_keyed(x, which))
    if extra:
        lists["kg"] = _union(extra).groupBy("qid", "article_id").agg(F.min("rank").alias("rank"))
    return lists


def answers(results: DataFrame, c: Corpus, sources: int = 3, queries: DataFrame | None = None, models: Models = Models()) -> DataFrame:
    """(qid, answer, citations): the beginnings of the first articles and their citations; with a model and the questions (qid, text) what it writes from them,
    asked once for each different prompt that the cache lacks."""
    r = results.filter(F.col("rank") <= sources).join(c.articles.select("article_id", "content", "article_number"), "article_id")
    line = F.concat(F.lit("Điều "), F.col("article_number"), F.lit(": "), text.last_sentence_cut(F.trim("content"), 300))
    g = r.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l"), "article_id"))).alias("x"))
    out = g.select("qid", F.array_join(F.transform("x", lambda s: s["l"]), "\n").alias("answer"), F.transform("x", lambda s: s["article_id"]).alias("citations"))
    if models.answer is None or queries is None:
        return out
    prompts = out.join(queries.select("qid", "text"), "qid").withColumn("prompt", F.concat(F.lit("Câu hỏi: "), "text", F.lit("\n\nĐiều khoản:\n"), "answer", F.lit("\n\nTrả lời, có dẫn số điều:")))
    cache = models.cache if models.cache is not None else queries.sparkSession.createDataFrame([], "cache_key string, response string")
    said = io.with_model(prompts.select("prompt").distinct(), cache, models.answer)
    return prompts.join(said.select("prompt", "response"), "prompt").select("qid", F.col("response").alias("answer"), "citations")


def offline_graph(feed: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations): raw extraction merged by slug, alike ones deduplicated, relations remapped."""
    e = kg.merged_entities(feed.withColumnRenamed("record_id", "ord"))
    pairs = kg.comparable_pairs(e.select(F.col("entity_id").alias("id"), "name", "type_str"))
    remap = cut(kg.remap_of(pairs))
    kept = e.join(remap.select(F.col("old_id").alias("entity_id")), "entity_id", "left_anti")
    return kept, kg.remapped(relations, remap)


__all__ = ["Corpus", "Models", "Shared", "answers", "corpus", "dual", "duals", "kg_expanded", "kg_expanded_by_chapters", "offline_graph", "retrieve_articles", "retrieve_by_all", "dims"]
