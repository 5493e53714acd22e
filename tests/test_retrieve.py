import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import evaluate, graph, retrieve


def test_rrf(spark):
    one = lambda rows: spark.createDataFrame([(1, a, r) for r, a in enumerate(rows, 1)], "qid int, article_id string, rank int")
    r = {x.article_id: x.score for x in retrieve.rrf({"tree": one("AB"), "dual": one("BC")}).collect()}
    assert r == pytest.approx({"B": 0.029297, "C": 0.016129, "A": 0.013115}, abs=1e-6)


def test_neighbours(spark):
    arts = spark.createDataFrame([(f"L:d{i}", "L", i, "x") for i in range(1, 12)], "article_id string, document_id string, article_number int, content string")
    seeds = spark.createDataFrame([(1, "L:d5"), (1, "L:d7")], "qid int, article_id string")
    r = {x.article_id: x.score for x in retrieve.neighbours(seeds, arts).collect()}
    assert r == {"L:d3": 0.3, "L:d4": 0.35, "L:d6": 0.35, "L:d8": 0.35, "L:d9": 0.3}


@pytest.mark.parametrize("q,name,want", [("vốn điều lệ công ty", "vốn điều lệ", 1.0), ("phạt vi phạm thuế", "thuế thu nhập", 0.25), ("giải thể", "giải thể công ty", 1.0)])
def test_keyphrase(spark, q, name, want):
    r = retrieve.keyphrase_scores(spark.createDataFrame([(1, q), (2, "là gì"), (3, None)], "qid int, text string"), spark.createDataFrame([("e", name), ("n", None)], "entity_id string, name string")).collect()
    assert [(x.qid, x.entity_id) for x in r] == [(1, "e")] and r[0].score == pytest.approx(want)


def test_article_keyphrase(spark):
    s = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.3)], "qid int, entity_id string, score double")
    m = spark.createDataFrame([("a", "x"), ("b", "x")], "entity_id string, article_id string")
    assert retrieve.article_keyphrase(s, m).first().keyphrase == pytest.approx(0.631833, abs=1e-6)


def _names(spark):
    words = ["vốn", "điều", "lệ", "công", "ty", "cổ", "phần", "thuế"]
    names = [" ".join(words[(i * k + k) % 8] for k in range(1 + i % 4)) for i in range(60)] + ["", None, "ty cổ", "VỐN ĐIỀU LỆ"]
    q = spark.createDataFrame([(1, "vốn điều lệ của công ty cổ phần"), (2, "thuế"), (3, None), (4, "là gì"), (5, "Công ty nộp thuế")], "qid int, text string")
    e = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names)] + [("twin", "công ty"), ("twin2", "công ty")], "entity_id string, name string")
    return q, e, names


def test_keyphrases_are_scored_in_place(spark):
    """Nothing that has a row for each name and question is joined: it may look small and be broadcast."""
    q, e, names = _names(spark)
    r = retrieve.keyphrase_scores(q, e)
    assert "Join" not in r._jdf.queryExecution().toString()
    got = {(x.qid, x.entity_id): x.score for x in r.collect()}
    text = {1: "vốn điều lệ của công ty cổ phần", 2: "thuế", 5: "công ty nộp thuế"}

    def want(q, n):
        w, stop = q.split(), set(retrieve.dims.STOP_WORDS)
        terms = [x for x in dict.fromkeys(w) if x not in stop]
        ov = len(set(terms) & set(n.split()))
        s = ov / len(terms) * (1.5 if ov >= 2 else 1.0) if ov else 0.0
        for k, low in ((2, 0.5), (3, 0.7)):
            if any(" ".join(w[i : i + k]) in n for i in range(len(w) - k + 1)):
                s = max(s, low) * 1.5
        return min(1.0, max(s, 0.8) * 1.5 if n in q else max(s, 0.6) * 1.2 if q in n else s)

    every = {(k, f"e{i}"): s for k, q in text.items() for i, n in enumerate(names) if n is not None and (s := want(q, n.lower())) > 0}
    assert {k: v for k, v in got.items() if "twin" not in k[1]} == pytest.approx(every) and got[1, "twin"] == got[1, "twin2"] > 0
    assert {(x.qid, x.entity_id) for x in retrieve.keyphrase_scores(q, e, 0.5).collect()} == {k for k, v in got.items() if v >= 0.5}
    assert retrieve.keyphrase_scores(q.limit(0), e).count() == retrieve.keyphrase_scores(q, e.limit(0)).count() == 0


def test_keyphrases_of_articles_are_gathered_where_names_are_scored(spark):
    q, e, _ = _names(spark)
    m = spark.createDataFrame([(f"e{i}", f"a{i % k}") for i in range(64) for k in (1, 3, 50)] + [("twin", "a0"), ("twin2", "a0"), ("e1", None), ("e1", "a1")], "entity_id string, article_id string")
    r = retrieve.mentioned_keyphrase(q, e, m)
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")] and "Aggregate" not in plan[: plan.index("MapInArrow")]
    got = {(x.qid, x.article_id): x.keyphrase for x in r.collect()}
    assert got == pytest.approx({(x.qid, x.article_id): x.keyphrase for x in retrieve.article_keyphrase(retrieve.keyphrase_scores(q, e), m).collect()}) and (1, None) in got
    assert retrieve.mentioned_keyphrase(q.limit(0), e, m).count() == retrieve.mentioned_keyphrase(q, e, m.limit(0)).count() == 0


def test_articles_that_go_on_in_the_next_block(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(retrieve, "SCORE_CELLS", 3)
    batch = retrieve._Batch([(1, "thuế vốn", ["thuế", "vốn"], [], [])])
    rows = [("a", n) for n in ("thuế", "vốn", "x", "thuế vốn", "thuế", "y")] + [("b", "z"), ("c", "vốn"), ("c", "thuế")]
    f = [pa.RecordBatch.from_pydict({"article_id": [r[0] for r in part], "n": [r[1] for r in part]}) for part in (rows[:4], rows[4:5], [], rows[5:])]
    got = {x[0]: float(s[0]) for articles, v in retrieve._of_articles(batch, iter(f)) for x, s in zip(articles, v, strict=True)}
    s = lambda n: [float(x) for x in batch.scores(n)[:, 0]]
    want = {k: max(v) + 0.3 * math.log(len(v) + 1) * sum(v) / len(v) for k, v in (("a", s(["thuế", "vốn", "thuế vốn"]) + s(["thuế"])), ("c", s(["vốn", "thuế"])))}
    assert got == pytest.approx(want | {"b": 0.0})


def test_pagerank(spark):
    intents = spark.createDataFrame([("g", "general", 1.0)], "intent_set string, intent string, weight double")
    run = lambda edges, **k: {x.node: x.score for x in graph.personalized_pagerank(graph.transition(spark.createDataFrame(edges, "src string, dst string, relation_type string, confidence double"), intents).select("src", "dst", "w"), spark.createDataFrame([(1, "a", 2.0)], "qid int, node string, weight double"), **k).collect()}
    assert run([("a", "b", "RELATED_TO", 1.0)], checkpoint_every=10, iterations=50, tolerance=1e-9) == pytest.approx({"a": 0.540541, "b": 0.459459}, abs=1e-3)
    assert run([("a", "b", "REQUIRES", 1.0)], iterations=5) == pytest.approx({"a": 0.15, "b": 0.1275})


def test_components_and_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("z", "z"), (None, "q")], "src string, dst string")
    assert {(r.node, r.component) for r in graph.connected_components(e, "src", "dst").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert graph.connected_components(chain, "src", "dst").filter("component <> 0").count() == 0
    assert graph.connected_components(e.limit(0), "src", "dst").count() == 0
    cyc = spark.createDataFrame([("a", "b"), ("b", "a")], "c string, p string")
    assert graph.closure(cyc, "c", "p").filter("node = ancestor").count() == 2


def test_metrics(spark):
    runs = spark.createDataFrame([(1, x, i) for i, x in enumerate("1235", 1)], "qid int, item string, rank int")
    rel = spark.createDataFrame([(1, "2"), (1, "5"), (2, "9")], "qid int, item string")
    m = {(r.qid, r.k): r for r in evaluate.metrics(runs, rel).collect()}
    assert m[1, 1].hit == 0 and m[1, 3].recall == 0.5 and m[1, 5].precision == 0.4 and m[1, 5].ndcg == pytest.approx(0.650921, abs=1e-6) and m[1, 5].rr == 0.5
    assert m[2, 50].hit == 0 and m[2, 50].rr == 0
    assert all(m[1, a].hit <= m[1, b].hit for a, b in ((1, 3), (3, 5), (5, 10)))


def test_tree_without_model(spark):
    docs = spark.createDataFrame([("D1", "Nghị định về thuế"), ("L1", "Luật Thuế")], "document_id string, title string")
    arts = spark.createDataFrame([(f"L1:d{i}", "L1", f"L1:c{1 + i // 5}", i) for i in range(1, 15)], "article_id string, document_id string, chapter_id string, article_number int")
    q = spark.createDataFrame([(1, "x"), (2, "thuế là gì")], "qid int, text string")
    r = retrieve.tree_without_model(docs, arts, q).orderBy("qid", "rank").collect()
    assert [x.article_id for x in r if x.qid == 1] == [f"L1:d{i}" for i in range(1, 8)] and {x.confidence for x in r} == {0.5}


def test_ablations_round_trip():
    names = [a.name for a in evaluate.ablations()]
    assert len(names) == len(set(names)) == 21
    assert all(evaluate.Ablation.from_dict(a.as_dict()) == a for a in evaluate.ablations())


def test_running_total_and_skew(spark):
    from lexigrid.operators import skew

    d = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    r = skew.running_total(d, "v", F.floor(F.col("id") / 100), [F.col("id")]).orderBy("id").select("running").collect()
    want, got = 0, [x[0] for x in r]
    for i in range(1000):
        want += i % 7
        assert got[i] == want
    left = spark.range(300).select(F.when(F.col("id") < 200, 1).when(F.col("id") < 220, 2).otherwise(F.col("id")).alias("k"), "id").union(spark.createDataFrame([(None, 999)], "k long, id long"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k not in (250, 2)").withColumn("x", F.col("k") * 2).withColumn("y", F.array("k"))
    plain = {how: sorted(map(tuple, left.join(right.drop("n"), "k", how).collect()), key=str) for how in ("inner", "left")}
    for least in (1, 10, 250, 10_000):
        for how, n in (("inner", 279), ("left", 301)):
            j = skew.hot_split_join(left, right, ["k"], "n", how, least=least)
            assert j.count() == n and j.columns == ["k", "id", "x", "y"] and sorted(map(tuple, j.collect()), key=str) == plain[how]
    # A hot key's rows are spread over the shuffle, whatever the key.
    from pyspark.sql.functions import spark_partition_id

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = skew.hot_split_join(left.filter("k = 1").repartition(1), right, ["k"], "n", least=10).hint("merge")
        sizes = [r["count"] for r in spread.groupBy(spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 200


def test_running_rate(spark):
    from lexigrid.operators import evaluate

    m = spark.createDataFrame([(i * 7919, 10, int(i % 3 == 0)) for i in range(200)] + [(1, 5, 1)], "qid long, k int, hit int")
    got = {r.qid: (r.n, r.rate) for r in evaluate.running_hit_rate(m).collect()}
    hits = 0
    for i in range(200):
        hits += i % 3 == 0
        assert got[i * 7919] == (i + 1, pytest.approx(hits / (i + 1), abs=1e-6))
    assert len(got) == 200 and evaluate.running_hit_rate(m.limit(0)).count() == 0


def test_themes_are_of_the_whole_graph(spark, sf):
    from lexigrid.plans import queries

    sizes = Counter(r.component for r in queries.QUERIES["components"](spark, sf).collect())
    want = {(k, n, min(n, 50)) for k, n in sizes.items() if n >= 3}
    got = Counter((r.theme, r["size"]) for r in queries.QUERIES["theme_partition"](spark, sf).collect())
    assert want and {(*k, n) for k, n in got.items()} == want


def test_registered_pagerank_settles(spark, tmp_path):
    from lexigrid.plans import queries

    n = 12  # a ring: after four steps eight nodes have no score yet
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    write([("d", "D")], "id string, title string", "legal_documents")
    write([("d:d1", "d", None, 1, "x")], "id string, document_id string, chapter_id string, article_number int, content string", "legal_articles")
    write([(f"e{i}", f"E{i}", "ORGANIZATION", ["d:d1"] if i == 0 else [], None) for i in range(n)], "id string, name string, type_str string, source_ids array<string>, deleted_at timestamp", "kg_entities")
    write([(f"e{i}", f"e{(i + 1) % n}", "REFERENCES", 1.0) for i in range(n)], "source_id string, target_id string, relation_type string, confidence double", "kg_relations")
    write([(1, "k", "Điều 1")], "item_id long, category string, article_ref string", "eval_items")
    s = [1.0] + [0.0] * (n - 1)
    p = s
    for _ in range(50):
        p = [0.15 * s[i] + 0.85 * p[i - 1] for i in range(n)]
    got = {r.node: r.score for r in queries.QUERIES["ppr_scores_settled"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({f"e{i}": p[i] for i in range(n)}, abs=2e-6)
