"""Files, models, pages, ontologies, updates and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lexigrid import __main__, info, models
from lexigrid.functions import text
from lexigrid.operators import extract, hierarchy, kg, ontology, retrieve
from lexigrid.sources import io
from lexigrid.streaming import incremental


def graph_tables(spark, names):
    return spark.createDataFrame([(n, n.upper()) for n in names], "id string, name string"), spark.createDataFrame([(names[0], names[-1])], "src string, dst string")


def test_backup_and_rollback(spark, tmp_path):
    path = str(tmp_path / "kg")
    io.write_graph(*graph_tables(spark, ["a", "b"]), path)
    b = io.Backups(spark, path)
    assert b.versions() == []
    b.save("one")
    io.write_graph(*graph_tables(spark, ["a", "b", "c"]), path)
    b.save("two")
    with pytest.raises(ValueError):
        b.save("two")
    b.restore("one")
    assert spark.read.parquet(f"{path}/entities").count() == 2 and b.versions() == ["one", "two"]
    b.restore("two")
    assert spark.read.parquet(f"{path}/entities").count() == 3


def test_ontology_files_round_trip(spark, tmp_path):
    classes = spark.createDataFrame([("Thing", None, None), ("Company", "Thing", 'công "ty"')], "name string, parent string, label string")
    props = spark.createDataFrame([("hasName", "data", "Thing", "xsd:string"), ("owns", "object", "Company", "Company,Thing")], "name string, kind string, domains string, ranges string")
    path = str(tmp_path / "o.json")
    io.write_ontology(classes, props, path)
    io.write_ontology(classes, props, path)  # a second time over the first
    c, p = io.read_ontology(spark, path)
    assert {tuple(r) for r in c.collect()} == {("Thing", None, None), ("Company", "Thing", 'công "ty"')}
    assert {tuple(r) for r in p.collect()} == {tuple(r) for r in props.collect()}
    lines = [r.value for r in ontology.turtle(classes, properties=props).orderBy("ord").collect()]
    assert ":owns a owl:ObjectProperty ; rdfs:domain :Company ; rdfs:range :Company ; rdfs:range :Thing ." in lines and ":hasName a owl:DatatypeProperty ; rdfs:domain :Thing ; rdfs:range xsd:string ." in lines
    bare = [r.value for r in ontology.turtle(classes).orderBy("ord").collect()]
    assert len(bare) == 5 and bare[3].startswith(":Company a owl:Class ; rdfs:subClassOf :Thing")


def test_ontology_edits(spark):
    c = spark.createDataFrame([("Thing", None, None)], "name string, parent string, label string")
    c = ontology.with_class(ontology.with_class(c, "Company", label="công ty"), "Company", "Other")
    assert {(r.name, r.parent) for r in c.collect()} == {("Thing", None), ("Company", "Thing")}
    said = spark.createDataFrame([('```json\n{"classes": [{"name": "Law"}], "properties": [{"name": "cites", "domain": ["Law", "X"], "range": []}]}\n```',)], "response string")
    k, p = ontology.parsed_model_output(said)
    assert [tuple(r) for r in k.collect()] == [("Law", "Thing", None)]
    assert {(r.name, r.kind, r.domains, r.ranges) for r in p.collect()} >= {("cites", "object", "Law", "Thing"), ("hasName", "data", "Thing", "xsd:string")}
    found = ontology.findings(c, p)
    n = ontology.finding_counts(found, strict=True).first()
    assert n.errors == 1 and not n.valid  # Law is no class here
    assert ontology.finding_counts(found.limit(0)).first().valid
    q = spark.createDataFrame([(1, "Cổ đông của công ty là ai?", "a", 1), (2, "xyz", "a", 2)], "question_id int, question string, category string, priority int")
    assert {(r.question_id, r.name) for r in ontology.trace(q, c, p).collect()} == {(1, "Company")}
    cov = {(r.dimension, r.value): (r.answerable, r.unanswerable) for r in ontology.coverage(q, spark.createDataFrame([("CongDong", None, "cong ty")], "name string, parent string, label string"), p).collect()}
    assert cov["all", "all"] == (1, 1) and cov["priority", "2"] == (0, 1)
    assert {r.check for r in ontology.suggestions(ontology.quality(c, p, spark.createDataFrame([("1", "LẠ")], "id string, type_str string"))).collect()} == {"gap", "isolated"}


def test_nested_forest(spark, tmp_path):
    tree = {"trees": {"L": {"doc_id": "L", "root": {"node_id": "L", "node_type": "document", "name": "Luật", "children": [{"node_id": "L:c1", "node_type": "chapter", "children": [{"node_id": "L:d1", "node_type": "article", "content": "x"}, {"node_id": "L:d2", "node_type": "article"}]}]}}}, "cross_refs": [{"source_node_id": "L:d1", "target_node_id": "L:d2", "reference_text": "Điều 2", "confidence": 0.9}]}
    f = tmp_path / "forest.json"
    f.write_text(json.dumps(tree, indent=1))
    nodes, refs = io.read_nested_forest(spark, str(f))
    got = {r.node_id: (r.parent_id, r.path, r.ord) for r in nodes.collect()}
    assert got["L:d2"] == ("L:c1", ["L", "L:c1", "L:d2"], 1) and got["L"] == (None, ["L"], 0) and refs.first().dst_article == "L:d2"
    back = json.loads(io.nested_trees(nodes).first().tree)
    assert back["root"]["children"][0]["children"][1]["node_id"] == "L:d2"
    stats = {r.node_type: r.nodes for r in hierarchy.statistics(nodes.withColumn("depth", F.size("path") - 1), refs).collect()}
    assert stats == {"document": 1, "chapter": 1, "article": 2, "cross_reference": 1}


def test_themes_terms_and_training_files(spark, tmp_path):
    themes, members = spark.createDataFrame([(1, [0.5, 1.0])], "theme int, embedding array<double>"), spark.createDataFrame([(1, "e")], "theme int, entity_id string")
    for _ in range(2):
        io.write_themes(themes, members, str(tmp_path / "t"))
    assert io.read_themes(spark, str(tmp_path / "t"))[0].first().embedding == [0.5, 1.0]
    old, new = (spark.createDataFrame(r, "short_form string, full_form string") for r in ([("A", "old")], [("A", "new"), ("B", "new")]))
    assert {tuple(r) for r in io.merged_terms(old, new).collect()} == {("A", "old"), ("B", "new")}
    lists = io.term_lists(spark.createDataFrame([("k", "b", 0.7), ("k", "a", 0.7), ("k", "c", 1.0), ("k", "c", 0.1)], "informal string, formal string, confidence double"), "informal", "formal")
    io.write_term_lists(lists, str(tmp_path / "s.json"), "informal")
    assert json.loads((tmp_path / "s.json").read_text()) == {"k": ["c", "a", "b"]}
    (tmp_path / "train.json").write_text(json.dumps([{"question": "q", "article_ids": ["L:d5", "L:d5", "x"]}, {"question": None}]))
    assert [r.expected for r in io.read_training(spark, str(tmp_path / "train.json")).collect()] == [[5]]
    cache = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", None)], "cache_key string, model string")
    assert {tuple(r) for r in io.cache_statistics(cache).collect()} == {("m", 2), ("", 1), (None, 3)}


def test_fetching_and_streams_of_events(spark):
    def fetch(url):
        if url == "bad":
            raise OSError("gone")
        return f"<p>{url}</p>"

    u = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "url string")
    r = {x.url: x for x in io.fetched(u, fetch, per_second=1e6, retries=2, first_wait=0.0, sleep=lambda s: None).collect()}
    assert r["a"].html == "<p>a</p>" and r["a"].attempts == 1 and r["bad"].error == "OSError: gone" and r["bad"].attempts == 2 and len(r) == 2
    s = 'data: {"choices":[{"delta":{"content":"xin "}}]}\n\n: chú thích\ndata: {"choices":[{"delta":{"content":"chào"}}]}\ndata: [DONE]\n'
    d = spark.createDataFrame([(s,), ("",)], "s string")
    assert [x[0] for x in d.select(io.streamed_text(F.col("s"))).collect()] == ["xin chào", ""]
    p, none = spark.createDataFrame([("hỏi",)], "prompt string"), spark.createDataFrame([], "cache_key string, response string")
    assert io.with_model_json(p, none, lambda q: 'đây: {"a": 1,}', "a int").first().value.a == 1


def test_models(spark):
    class Lengths:
        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    models.register("embedding", "lengths", Lengths)
    e = models.create("embedding", "lengths")
    assert models.dimension("lengths", e) == 2 and models.dimension("text-embedding-3-large") == 3072
    with pytest.raises(ValueError, match="lengths"):
        models.create("embedding", "none")
    assert models.first_available(["none"]) is None
    t = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, t string")
    assert [tuple(r) for r in models.embedded(t, "id", "t", e).collect()] == [(1, [2.0, 1.0])]
    res, q, a = spark.createDataFrame([(1, "x")], "qid int, article_id string"), spark.createDataFrame([(1, "hỏi")], "qid int, text string"), spark.createDataFrame([("x", "đáp án")], "article_id string, content string")
    assert models.model_scores(res, q, a, None) is None
    assert models.model_scores(res, q, a, lambda ps: [len(x) + len(y) for x, y in ps]).first().model == 9.0
    p = models.Progress(2, every=1, log=models.logger("lexigrid.test"))
    p.step(True), p.step()
    assert (p.done, p.hits) == (2, 1) and len(models.logger("lexigrid.test").handlers) == 1


def test_pages_tags_and_kinds(spark):
    page = "<html><head><title>Trang</title><meta property='og:title' content='OG'></head><body><h1> Luật  <b>Thuế</b></h1><table><tr><td>Số hiệu:</td><td>1/2020</td></tr><tr><td>a</td></tr></table></body></html>"
    assert extract.page_fields(page) == ("Luật Thuế", {"Số hiệu": "1/2020"})
    assert extract.page_fields("<title>Trang</title>")[0] == "Trang" and extract.page_fields("chữ trơn") == (None, {})
    d = spark.createDataFrame([("p", page), ("n", None)], "id string, html string")
    assert [(r.id, r.title, r.fields) for r in extract.pages_fields(d, "id", "html").collect()] == [("p", "Luật Thuế", {"Số hiệu": "1/2020"})]
    w = spark.createDataFrame([("HĐQT", None), ("THT", "N"), ("NGHĨA", "N"), ("TRUNG", "Np"), ("STRONGH", None), ("KHNTRA", "M")], "word string, tag string")
    got = {r.word: (r.c.is_abbreviation, r.c.confidence, r.c.reason) for r in w.select("word", extract.abbreviation_class(F.col("word"), F.col("tag")).alias("c")).collect()}
    assert got["THT"] == (True, 100, "all_consonants") and got["NGHĨA"] == (False, 10, "pos_N") and got["TRUNG"] == (False, 15, "pos_Np_has_vowel") and got["KHNTRA"] == (True, 75, "pos_M_high_cons") and got["HĐQT"][1] == 100
    words = spark.createDataFrame([("AB", "x"), ("AB", "x"), (None, "y")], "word string, context string")
    assert extract.tagged(words, lambda w, c: "N").filter("tag = 'N'").count() == 2
    kinds = spark.createDataFrame([("BỘ LUẬT Lao động",), ("nghi dinh 5",), ("Biên bản",), (None,)], "t string")
    assert [r[0] for r in kinds.select(text.document_kind(F.col("t"))).collect()] == ["luat", "nghi_dinh", None, None]
    assert [r[0] for r in spark.createDataFrame([("Tiền tệ",), ("x",)], "t string").select(kg.entity_type(F.col("t"))).collect()] == ["MONETARY", "LEGAL_TERM"]


def test_stream_merges_later_batches(spark, tmp_path):
    schema = "name string, type_str string, description string, confidence double, source_id string, document_id string, ord int"
    stage = str(tmp_path / "in")
    spark.createDataFrame([("Công ty A", "O", "ngắn", 0.5, "s1", "d1", 1)], schema).write.mode("append").parquet(stage)
    run = lambda: incremental.merge_entities(spark.readStream.schema(schema).parquet(stage), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    run()
    spark.createDataFrame([("CÔNG TY A", "X", "dài hơn nhiều", 0.9, "s2", "d1", 2), ("B", "O", None, None, None, None, 3)], schema).write.mode("append").parquet(stage)
    run()
    r = {x.entity_id: x for x in incremental.merged_batches(spark, str(tmp_path / "out")).collect()}
    a = r["cong-ty-a"]
    assert (a.name, a.type_str, a.description, a.confidence, a.source_ids, a.occurrence_count, a.aliases) == ("Công ty A", "O", "dài hơn nhiều", 0.9, ["s1", "s2"], 2, ["CÔNG TY A", "Công ty A"]) and "b" in r
    incremental.compact_batches(spark, str(tmp_path / "out"), str(tmp_path / "whole"))
    assert incremental.merged_batches(spark, str(tmp_path / "whole")).count() == 2


def test_updates_contexts_and_lists(spark):
    e = spark.createDataFrame([("1", "Vốn", ["x"]), ("2", "Cổ đông", ["x", "y"]), ("3", None, ["x"])], "id string, name string, source_ids array<string>")
    a = spark.createDataFrame([("x", "Tăng vốn điều lệ"), ("y", None)], "article_id string, content string")
    assert [tuple(r) for r in kg.entity_contexts(e, a, 5).collect()] == [("1", "x", "Tăng vốn điều")]
    r = spark.createDataFrame([("1", "2", "T")], "src string, dst string, relation_type string")
    added = kg.updated(e.limit(0), r.limit(0), e, r)
    n = kg.update_counts(e, r, *added).first()
    assert (n.entities_added, n.entities_merged, n.relations_added, n.relations_merged, n.articles_affected) == (3, 0, 1, 0, 2)
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4)], "qid int, article_id string, rank int")
    assert [(x.article_id, x["rank"]) for x in retrieve.first_distinct(d, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert info()["lexigrid"] and __main__.open_corpus


def test_command_line(spark, sf):
    c = __main__.open_corpus(spark, sf)
    (question, articles, answer), = __main__.ask(spark, c, ["Mức phạt với công ty cổ phần là gì?"], 3)
    assert question and [a[0] for a in articles] == [1, 2, 3] and answer.startswith("Điều")
