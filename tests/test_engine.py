"""The engine on a fixture: every switch changes something, models are heard, small and large graphs give the same scores."""

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import evaluate, graph, retrieve, tree
from lexigrid.plans import engine


@pytest.fixture(scope="module", autouse=True)
def small_plans(spark):
    """Many small jobs: one partition each, planned once."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def corpus(spark):
    kinds = ["REFERENCES", "RELATED_TO", "REQUIRES", "DEFINED_AS", "HAS_PENALTY"]
    docs = spark.createDataFrame([("1-2020-QH14", "Luật Doanh nghiệp"), ("2-2021-ND-CP", "Nghị định hướng dẫn"), ("3-2022-TT-BTC", "Thông tư")], "document_id string, title string")
    arts = [(f"{d}:d{i}", d, f"{d}:c{1 + i // 4}", i, f"nội dung {d} điều {i} về vốn", "Quy định chung" if i // 4 == 9 else f"Chương {1 + i // 4}") for d in ("1-2020-QH14", "2-2021-ND-CP", "3-2022-TT-BTC") for i in range(1, 41)]
    articles = spark.createDataFrame(arts, "article_id string, document_id string, chapter_id string, article_number int, content string, chapter_title string")
    names = ["vốn điều lệ", "công ty cổ phần", "tổ chức", "mức phạt", "hồ sơ đăng ký", "thành lập doanh nghiệp", "cổ đông sáng lập", "hội đồng quản trị", "giải thể doanh nghiệp", "điều kiện góp vốn"]
    entities = spark.createDataFrame([(f"e{i}", names[i % 10] + ("" if i < 10 else f" {i}"), "LEGAL_TERM") for i in range(40)], "entity_id string, name string, type_str string")
    mentions = spark.createDataFrame([(f"e{i}", arts[(i * 7 + k * 41) % 120][0], arts[(i * 7 + k * 41) % 120][3], k) for i in range(40) for k in range(2)], "entity_id string, article_id string, article_number int, ord int")
    edges = spark.createDataFrame([(f"e{i}", f"e{(i * 3 + k * 5 + 1) % 40}", kinds[(i + k) % 5], 0.5 + (i % 5) / 10) for i in range(40) for k in range(3)], "src string, dst string, relation_type string, confidence double")
    return engine.Corpus(docs, articles, entities, mentions, edges)


QUESTIONS = [(1, "vốn điều lệ công ty cổ phần là gì"), (2, "mức phạt theo nghị định 2/2021 khi góp vốn"), (3, "hồ sơ lập công ty của CTCP cần điều kiện gì"), (4, "giải thể"), (5, "Điều 5 quy định gì về thành lập doanh nghiệp?")]


@pytest.fixture(scope="module")
def models(spark, corpus):
    q = spark.createDataFrame([(i,) for i, _ in QUESTIONS], "qid int")
    scores = q.join(corpus.articles.select("article_id"), F.lit(True))
    some = lambda name, seed: scores.withColumn(name, F.pmod(F.xxhash64("qid", "article_id", F.lit(seed)), F.lit(1000)) / 1000.0)
    steep = lambda name, seed: some(name, seed).withColumn(name, F.pow(name, F.lit(6)))
    vec = lambda seed: F.array(*[(F.pmod(F.xxhash64(F.lit(seed), F.col("k"), F.lit(i)), F.lit(200)) - 100).cast("double") for i in range(4)])
    asked = q.withColumn("k", F.col("qid")).select("qid", vec(1).alias("embedding"))
    themes = spark.range(6).withColumn("k", F.col("id")).select(F.col("id").alias("theme"), vec(2).alias("embedding"))
    members = corpus.entities.select(F.pmod(F.xxhash64("entity_id"), F.lit(6)).alias("theme"), "entity_id")
    return engine.Models(steep("semantic", 1), steep("concept", 2), some("hierarchy", 3), some("similarity", 4), some("model", 5), (asked, themes, members))


def test_every_switch_changes_something(spark, corpus, models):
    q = spark.createDataFrame(QUESTIONS, "qid int, text string")
    shared = engine.Shared()
    run = lambda a: sorted(map(tuple, engine.retrieve_articles(q, corpus, a, models=models, mode="dual", shared=shared).collect()))
    configurations = [*evaluate.ablations(), *evaluate.part_ablations()]
    results = {a.name: run(a) for a in configurations}
    full = results.pop("full")
    assert full and {r[0] for r in full} == {1, 2, 3, 4, 5}
    assert not [name for name, r in results.items() if r == full]
    plain = sorted(map(tuple, engine.retrieve_articles(q, corpus).collect()))
    assert plain and plain == sorted(map(tuple, engine.retrieve_articles(q, corpus, evaluate.Ablation(rerank=False)).collect()))
    assert engine.retrieve_articles(q.limit(0), corpus).count() == 0


def test_configurations_are_merged_and_ranked_together(spark, corpus, models, monkeypatch):
    """Every way to merge, fill up and rank at once gives what each configuration gives alone, and reads the articles once for all of them."""
    q, shared = spark.createDataFrame(QUESTIONS, "qid int, text string"), engine.Shared()
    names = ("full", "tree_only", "no_semantic_bridge", "no_rrf_merge", "no_tree_no_reranker", "no_doc_filter")
    some = [a for a in evaluate.ablations() if a.name in names] + [evaluate.Ablation("nothing", tree=False, dual=False)]
    calls, was = [], retrieve.neighbours
    monkeypatch.setattr(retrieve, "neighbours", lambda *x: calls.append(1) or was(*x))
    got = sorted(map(tuple, engine.retrieve_by_all(q, corpus, some, iterations=2, models=models, mode="dual", shared=shared).collect()))
    assert len(calls) == 1
    want = [(i, *r) for i, a in enumerate(some) for r in engine.retrieve_articles(q, corpus, a, iterations=2, models=models, mode="dual", shared=shared).collect()]
    assert got == sorted(want) and {r[0] for r in got} == set(range(len(names)))


def test_dual_and_its_lists_are_one_plan_for_all_configurations(spark, corpus, models, monkeypatch):
    """What follows from dual is worked out once for all configurations, not for each; names are scored only for those with keyphrases, labels found once."""
    q, some = spark.createDataFrame(QUESTIONS, "qid int, text string"), evaluate.part_ablations()
    calls = {}
    for module, name in ((retrieve, "low_level"), (retrieve, "overlap"), (retrieve, "calibrated"), (retrieve, "cross_check"), (engine, "kg_expanded"), (engine.ontology, "expanded_terms")):
        was = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *x, _was=was, _name=name, **y: calls.update({_name: calls.get(_name, 0) + 1}) or _was(*x, **y))
    got = sorted(map(tuple, engine.retrieve_by_all(q, corpus, some, iterations=2, models=models, mode="dual").collect()))
    # overlap is called by cross_check too
    assert calls == {"low_level": 1, "overlap": 2, "calibrated": 1, "cross_check": 1, "kg_expanded": 1, "expanded_terms": 1}
    i = [a.name for a in some].index("no_keyphrase")
    alone = [(i, *r) for r in engine.retrieve_articles(q, corpus, some[i], iterations=2, models=models, mode="dual").collect()]
    assert [r for r in got if r[0] == i] == sorted(alone) and {r[0] for r in got} == set(range(len(some)))
    monkeypatch.setattr(retrieve._Batch, "scores", lambda *_: 1 / 0)
    rows = list(retrieve._of_articles(retrieve._Batch([(1, "vốn", ["vốn"], [], [])]), [__import__("pyarrow").RecordBatch.from_pylist([{"article_id": "a", "n": "vốn"}])], False))
    assert [(x, v.tolist()) for x, v in rows] == [([("a",)], [[0.0]])]


def test_chapters_and_strong_relations(spark):
    arts = spark.createDataFrame([("A:d1", "A", "A:c1", 1, "x"), ("A:d2", "A", "A:c1", 2, "x"), ("A:d3", "A", "A:c2", 3, "x"), ("A:d4", "A", None, 4, "x"), ("A:d5", "A", "A:c2", 5, "x")], "article_id string, document_id string, chapter_id string, article_number int, content string")
    mentions = spark.createDataFrame([(f"e{i}", f"A:d{i}", i, 0) for i in range(1, 6)], "entity_id string, article_id string, article_number int, ord int")
    edges = spark.createDataFrame([("e1", "e2", "REFERENCES", 0.9), ("e1", "e3", "REFERENCES", 0.5), ("e1", "e4", "INCLUDES", 0.4), ("e5", "e1", "HAS_PENALTY", 1.0)], "src string, dst string, relation_type string, confidence double")
    c = engine.Corpus(None, arts, None, mentions, edges)
    seeds = spark.createDataFrame([(1, "A:d1")], "qid int, article_id string")
    got = [(r.article_id, r["rank"], r.crosses) for r in engine.kg_expanded_by_chapters(seeds, c).orderBy("rank").collect()]
    # A strong relation within the chapter doesn't count, a penalty never, an inclusion anywhere.
    assert got == [("A:d3", 1, True), ("A:d4", 2, False)]
    near = spark.createDataFrame([(1, "A:d4", 0.5), (1, "A:d3", 0.4)], "qid int, article_id string, similarity double")
    assert [r.article_id for r in engine.kg_expanded_by_chapters(seeds, c, near).collect()] == ["A:d4"]


def test_small_and_large_graphs_give_the_same_scores(spark, corpus):
    intents = spark.createDataFrame([("g", "general", 1.0)], "intent_set string, intent string, weight double")
    w = graph.transition(corpus.edges, intents).select("src", "dst", "w")
    seeds = spark.createDataFrame([(q, f"e{(q * k) % 40}", float(k)) for q in range(1, 8) for k in range(1, 4)] + [(1, "nowhere", 1.0), (2, None, 1.0)], "qid int, node string, weight double")
    a = {(r.qid, r.node): r.score for r in graph.personalized_pagerank(w, seeds, iterations=20).collect()}
    b = {(r.qid, r.node): r.score for r in graph.personalized_pagerank(w, seeds, iterations=20, most_edges=0).collect()}
    assert a.keys() == b.keys() and a == pytest.approx(b, abs=1e-12) and a[1, "nowhere"] > 0
    assert graph.personalized_pagerank(w, seeds.limit(0)).count() == 0 and graph.personalized_pagerank(w.limit(0), seeds).count() > 0


def test_blocks_walk_as_joins_do(spark, corpus, monkeypatch):
    """Several blocks of a set, hubs and rounds, nodes without edges: the greatest score of each number is personalized_pagerank's; no row is made for a node."""
    from lexigrid.functions import query

    monkeypatch.setattr(graph, "BLOCK_QUESTIONS", 2)
    monkeypatch.setattr(graph._Rounds, "ROUNDS", 3)
    q = spark.createDataFrame([*QUESTIONS, (6, "vốn"), (7, "tổ chức công ty"), (8, "xa lạ")], "qid int, text string")
    a, on = query.analyzed(q), evaluate.Ablation()
    c = engine.Corpus(corpus.documents, corpus.articles, corpus.entities.union(spark.createDataFrame([("alone", "vốn góp", "X")], corpus.entities.schema)), corpus.mentions.union(spark.createDataFrame([("alone", "9-2020-QH14:d77", 77, 0)], corpus.mentions.schema)), corpus.edges)
    asked = engine._asked(a, on)
    got = {(r.qid, r.number): r.score for r in engine._pagerank(a, asked, c, on, 50, engine.Shared()).collect()}
    monkeypatch.setattr(graph, "BLOCK_EDGES", 0)
    want = {(r.qid, r.number): r.score for r in engine._pagerank(a, asked, c, on, 50, engine.Shared()).collect()}
    assert got == pytest.approx(want, abs=1e-6) and {n for _, n in got} >= {77} and len({k for k, _ in got}) > 4


@pytest.mark.parametrize("said", [False, True])
def test_only_the_first_articles_of_a_question_are_brought_together(spark, corpus, models, monkeypatch, said):
    """With a limit of few places the result is that of all rows; what leaves the articles is little more than the places."""
    from lexigrid.functions import query

    a, on = query.analyzed(spark.createDataFrame(QUESTIONS, "qid int, text string")), evaluate.Ablation.everything()
    m = engine.Models(models.semantic.filter("semantic > 0.6"), models.concept.filter("concept > 0.8"), models.hierarchy.filter("hierarchy > 0.9")) if said else engine.Models()
    monkeypatch.setattr(engine, "DUAL_MOST", 4)
    shared = engine.Shared()
    got = [tuple(r) for r in engine.dual(a, corpus, on, models=m, mode="dual", shared=shared).orderBy("qid", "rank").collect()]
    best = next(x for k, x in shared.done.items() if k[0] == "best")
    monkeypatch.setattr(engine, "RANK_ROWS", 0)
    want = [tuple(r) for r in engine.dual(a, corpus, on, models=m, mode="dual").orderBy("qid", "rank").collect()]
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want]) and len(got) > 12
    every = engine.retrieve.mentioned_keyphrase(engine._asked(a, on), corpus.entities, corpus.mentions).count()
    assert best.count() < every / 2 or said


def test_themes_make_no_row_of_each_question_and_article(spark, corpus, models, monkeypatch):
    """With themes, some of them unlike, and questions of stop words only the result is that of all rows; a theme's articles that have no place are no rows."""
    from lexigrid.functions import query

    a, on = query.analyzed(spark.createDataFrame([*QUESTIONS, (6, "là và của")], "qid int, text string")), evaluate.Ablation.everything()
    asked, themes, members = models.themes
    asked = asked.union(asked.filter("qid = 1").select(F.lit(6), "embedding"))
    m = engine.Models(models.semantic.filter("semantic > 0.6"), hierarchy=models.hierarchy.filter("hierarchy > 0.9"), themes=(asked, themes, members))
    monkeypatch.setattr(engine, "DUAL_MOST", 4)
    shared = engine.Shared()
    run = lambda x: [tuple(r) for r in engine.dual(a, corpus, x, 3, m, "dual", shared).orderBy("qid", "rank").collect()]
    for off in ({}, {"keyphrase": False, "ppr": False}, {"semantic": False, "theme": False}):
        one = evaluate.Ablation(**(on.as_dict() | off))
        monkeypatch.setattr(engine, "RANK_ROWS", 1_000_000)
        got = run(one)
        assert [k for k in shared.done if k[0] == "best"] and (off or ("theme",) not in shared.done)
        monkeypatch.setattr(engine, "RANK_ROWS", -1)
        want = run(one)
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want]) and len(got) > 12
    near, grouped = retrieve.themes_near(asked.filter("qid < 6"), themes, members, corpus.mentions)
    best = retrieve.best_articles(a.select("qid", "text"), corpus.entities, corpus.mentions, None, 4, near=near, grouped=grouped)
    assert best.count() < retrieve.high_level(asked.filter("qid < 6"), themes, members, corpus.mentions).count()


def test_picks_of_a_model(spark, corpus):
    q = spark.createDataFrame(QUESTIONS[:2], "qid int, text string")
    options = spark.createDataFrame([(1, "1-2020-QH14:c1", "Chương 1", 1), (1, "1-2020-QH14:c3", "Chương 3", 2), (2, "2-2021-ND-CP:c2", "Chương 2", 1)], "qid int, node_id string, name string, place int")
    hints = spark.createDataFrame([(1, "1-2020-QH14:c3", 0.8)], "qid int, node_id string, score double")
    prompt = {r.qid: r.prompt for r in tree.prompts(q, options, "chapter", hints).collect()}
    assert "[2] Chương 3 (★ 0.8)" in prompt[1] and "[1] Chương 2" in prompt[2]
    said = spark.createDataFrame([(1, '{"indices": [2, 9, 2], "confidence": 0.7}'), (2, "không rõ")], "qid int, response string")
    first = tree.picked(said, options, "chapter")
    assert [tuple(r) for r in first.collect()] == [(1, "chapter", "1-2020-QH14:c3", 1, 0.7)]
    second = spark.createDataFrame([(1, "1-2020-QH14:c1", 0.9), (1, "1-2020-QH14:c4", 0.5)], "qid int, node_id string, confidence double")
    both = {(r.node_id, r.place): r.confidence for r in tree.with_second(first, second).collect()}
    assert both == pytest.approx({("1-2020-QH14:c3", 1): 0.78, ("1-2020-QH14:c1", 2): 0.78})
    found = tree.searched(corpus.documents, corpus.articles, q, first).orderBy("qid", "rank").collect()
    assert [r.article_id for r in found if r.qid == 1][:2] == ["1-2020-QH14:d8", "1-2020-QH14:d9"] and [r.confidence for r in found if r.qid == 1] == [pytest.approx(0.45 * 0.7 + 0.55 * 0.5)] * 4
    assert {r.confidence for r in found if r.qid == 2} == {0.5}


def test_general_provisions_are_put_in_front(spark, corpus):
    q = spark.createDataFrame([(1, "vốn là gì"), (2, "vốn")], "qid int, text string")
    r = tree.searched(corpus.documents, corpus.articles, q).orderBy("qid", "rank").collect()
    assert [x.article_id for x in r if x.qid == 1][0] == "1-2020-QH14:d36" and [x.article_id for x in r if x.qid == 2][0] == "1-2020-QH14:d1"


def test_answers_are_asked_once(spark, corpus):
    q = spark.createDataFrame([(1, "vốn"), (2, "vốn")], "qid int, text string")
    found = spark.createDataFrame([(i, "1-2020-QH14:d1", 1) for i in (1, 2)], "qid int, article_id string, rank int")
    r = engine.answers(found, corpus, queries=q, models=engine.Models(answer=lambda p: f"{len(p)} chữ")).collect()
    assert len(r) == 2 and len({x.answer for x in r}) == 1 and r[0].citations == ["1-2020-QH14:d1"]


@pytest.mark.parametrize("block,rows", [(1, 3), (4096, 2048)])
def test_nearest_in_blocks(spark, monkeypatch, block, rows):
    import random

    monkeypatch.setattr(retrieve, "VECTOR_ROWS", rows)
    r = random.Random(2)
    vecs = {i: [float(r.randrange(-3, 4)) for _ in range(5)] for i in range(60)}
    v = spark.createDataFrame([*vecs.items(), (99, None)], "vec_id int, embedding array<double>")
    q = v.filter("vec_id % 9 = 0").withColumnRenamed("vec_id", "qid")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / n, 6) if (n := (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5) else 0.0
    want = {(i, j, k + 1) for i in vecs if i % 9 == 0 for k, j in enumerate(sorted(vecs, key=lambda j: (-cos(vecs[i], vecs[j]), j))[:7])}
    assert {(x.qid, x.vec_id, x["rank"]) for x in retrieve.nearest(q, v, 7, block=block).collect()} == want
    assert retrieve.nearest(q.limit(0), v, 7).count() == 0


def test_names_inside_names(spark):
    e = spark.createDataFrame([("a", "công ty mẹ"), ("b", "công ty"), ("c", None), ("d", "hội")], "entity_id string, name string")
    n = spark.createDataFrame([("công ty",), ("mẹ",), ("xa",), ("",), (None,)], "name string")
    assert {tuple(r) for r in retrieve.related_names(n, e).collect()} == {("công ty", "b"), ("mẹ", "a")}
    assert retrieve.related_names(n.limit(0), e).count() == 0
