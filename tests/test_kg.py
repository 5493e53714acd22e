import duckdb
from pyspark.sql import functions as F

from lexigrid.operators import extract, hierarchy, kg, ontology, orphans


def test_merge_entities_and_relations(spark):
    e = spark.createDataFrame(
        [("Công ty A", "ORG", "ngắn", 0.5, "s1", "d1", 1), ("công ty a", "ORG", "dài hơn", 0.9, "s2", "d1", 2), ("!!", "ORG", "x", 0.1, "s", "d", 3)],
        "name string, type_str string, description string, confidence double, source_id string, document_id string, ord int",
    )
    r = kg.merged_entities(e).collect()
    assert len(r) == 1 and r[0].description == "dài hơn" and r[0].confidence == 0.9 and r[0].source_ids == ["s1", "s2"] and r[0].occurrence_count == 2
    rel = spark.createDataFrame(
        [("a", "P", "b", "one two", 0.5, ["x"], 1), ("a", "P", "b", "two", 0.7, ["y"], 2), ("a", "P", "b", "three", None, None, 3), (None, "P", "b", "z", 1.0, ["z"], 4)],
        "src string, predicate string, dst string, evidence string, confidence double, article_ids array<string>, ord int",
    )
    m = kg.merged_relations(rel).collect()
    assert [(x.evidence, x.confidence, x.article_ids, x.occurrence_count) for x in m] == [("one two | three", 0.7, ["x", "y"], 3)]


def test_jaro_winkler_against_duckdb():
    pairs = [("martha", "marhta"), ("cong ty co phan", "cong ty co phann"), ("dixon", "dicksonx"), ("a", "b"), ("", "x")]
    for a, b in pairs:
        want = duckdb.connect().execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]
        if want > 0.7:
            assert abs(kg.jaro_winkler(a, b) - want) < 1e-9


def test_dedup_rules(spark):
    e = spark.createDataFrame(
        [("1", "Công ty cổ phần Hoàng Long Việt", "O"), ("2", "Công ty cổ phần Hoàng Long Việtt", "O"), ("3", "Công ty số 12 Hoàng Long Việt", "O"), ("4", "Công ty số 13 Hoàng Long Việt", "O"), ("5", "công ty CỔ phần Hoàng Long Việt", "O")],
        "id string, name string, type_str string",
    )
    assert {(r.id_a, r.id_b) for r in kg.comparable_pairs(e).collect()} == {("1", "2"), ("1", "5")}
    remap = kg.remap_of(kg.comparable_pairs(e))
    assert {(r.old_id, r.canonical_id) for r in remap.collect()} == {("2", "1"), ("5", "1")}


def test_validation(spark):
    rel = spark.createDataFrame([(1, "a", "b", "yêu cầu", 0.98, "hợp đồng lao động", "x"), (2, "a", "a", "YÊU_CẦU", 0.5, "", "x"), (3, "b", "a", "LẠ", 0.5, "không hề có chữ nào", "x")], "relation_id int, src string, dst string, predicate string, confidence double, evidence string, article_id string")
    ent = spark.createDataFrame([("a", "ORGANIZATION"), ("b", "LOCATION")], "id string, type_str string")
    v = {r.relation_id: r for r in kg.validated_relations(rel, ent).collect()}
    assert set(v) == {1, 3} and not v[1].semantic_ok and v[1].known_type and not v[3].known_type
    src = spark.createDataFrame([("x", "Ký Hợp đồng lao động mới")], "article_id string, content string")
    w = kg.validated_relations(rel, ent, src).collect()
    assert [(r.relation_id, r.verdict, r.confidence) for r in w] == [(1, "exact", 1.0)]


def test_orphans_small(spark):
    rel = spark.createDataFrame(
        [(1, " A ", "b", "2024-01-15"), (2, "a", "c", "2024-02-01"), (3, None, "  ", "2024-01-01"), (4, "b", "a", None), (1, " A ", "b", "2024-01-15")], "relation_id long, source_id string, target_id string, at string"
    ).withColumn("at", F.col("at").cast("timestamp"))
    ent = spark.createDataFrame([("a", "2024-01-10", "2024-01-20"), ("B", "2024-01-01", None), ("c", "2024-02-02", None)], "id string, created_at string, deleted_at string")
    ent = ent.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))
    run = lambda r, e: {(x.ref_id, x.endpoint) for x in orphans.orphan_references(r, ["source_id", "target_id"], "relation_id", "at", e, "id", "created_at", "deleted_at").collect()}
    assert run(rel, ent) == {(2, "source_id"), (2, "target_id"), (4, "source_id"), (4, "target_id")}
    assert len(run(rel, ent.limit(0))) == 6
    assert run(rel.limit(0), ent) == set()


def test_bitmaps():
    import numpy as np

    a, b = np.arange(0, 60000, 3), np.arange(0, 60000, 6)
    assert orphans.Bitmap(a).dense and sorted(orphans.Bitmap(a).and_not(orphans.Bitmap(b))) == sorted(set(a) - set(b))
    assert list(orphans.Bitmap(np.array([5, 1, 5])).and_not(orphans.Bitmap(np.array([1])))) == [5]
    assert list(orphans.Bitmap(np.array([7])).and_not(None)) == [7]


def test_crossrefs_and_terms(spark):
    s = "Việc này theo Điều 5, Khoản 2 Luật số 59/2020/QH14 được áp dụng. Sửa đổi tại Điều 9; của Điều 12, Khoản 1."
    r = extract.references_in(s)
    assert [(x[2], x[3], x[5], x[6], x[7]) for x in r] == [(5, 2, "59/2020/QH14", "THAM_CHIẾU", 1.0), (9, None, None, "SỬA_ĐỔI", 0.9), (12, 1, None, "THAM_CHIẾU", 0.77)]
    arts = spark.createDataFrame([("L:d1", s), ("L:d2", None), ("L:d3", "")], "id string, content string")
    docs = spark.createDataFrame([("L",), ("59-2020-QH14",)], "id string")
    d = extract.resolved_crossrefs(extract.crossrefs(arts), docs).collect()
    assert {x.dst_article for x in d} == {"59-2020-QH14:d5", "L:d9", "L:d12"}
    t = extract.terms_in("Hội đồng quản trị (sau đây gọi tắt là HĐQT)")
    assert t and t[0][1].startswith("Hội đồng quản trị")


def test_structure_and_html():
    p = extract.parts_in("Chương I. Quy định chung\nĐiều 1. Phạm vi\n1. Một\na) nhỏ\nđ) khác\n2. Hai\nĐiều 2. Đối tượng\nPhụ lục I\nĐiều 9. Không tính")
    assert [(x[0], x[1]) for x in p] == [("chapter", "I"), ("article", "1"), ("clause", "1"), ("point", "a"), ("point", "đ"), ("clause", "2"), ("article", "2"), ("appendix", "I")]
    assert [x[3] for x in p] == [0, 1, 2, 3, 3, 2, 1, 0]
    assert extract.html_text("<p>A &amp; b</p><script>x</script><div>c  d</div>") == "A & b\n\nc d"


def test_abbreviation_rules(spark):
    d = spark.createDataFrame([("HĐQT",), ("TNHH",), ("NĐ-CP",), ("AN",)], "x string")
    r = [x[0] for x in d.select(extract.abbreviation_class(F.col("x"))["confidence"]).collect()]
    assert r == [100, 100, 100, 0]


def test_hierarchy_and_ontology(spark):
    docs = spark.createDataFrame([("L", "Luật"), ("L", "Luật")], "id string, title string")
    arts = spark.createDataFrame([("L:d1", "L", "L:c1", None, 1, "a"), ("L:d2", "L", None, "L:c1:m2", 2, "b"), ("L:d3", "L", None, None, 3, None)], "id string, document_id string, chapter_id string, section_id string, article_number int, title string")
    n = {r.node_id: r for r in hierarchy.nodes(docs, arts).collect()}
    assert n["L:d2"].path == ["L", "L:c1", "L:c1:m2", "L:d2"] and n["L:d3"].parent_id == "L" and len(n) == 6
    c = ontology.default_classes(spark)
    f = spark.createDataFrame([("p", "object", "Company,Nope", "Law", 1)], "name string, kind string, domains string, ranges string, uses long")
    found = {(r.check, r.subject) for r in ontology.findings(c, f).collect()}
    assert ("unknown_domain", "p") in found and not any(k == "cycle" for k, _ in found)
    q = spark.createDataFrame([(1, "thành lập ctcp thế nào")], "qid int, text string")
    x = {(r.name, r.relation) for r in ontology.expanded_terms(q, c).collect()}
    assert ("JointStockCompany", "named") in x and ("Company", "parent") in x
    assert ontology.turtle(c).count() == 3 + c.count()


def test_structure_of_documents_of_any_kind(spark, tmp_path):
    from lexigrid.plans import queries

    law = "Chương I\nQUY ĐỊNH CHUNG\nĐiều 1. Phạm vi\nNội dung."
    rows = [("a", "van_ban", law), ("b", None, law), ("c", "an_le", law), ("d", None, "Không có cấu trúc."), ("e", "van_ban", None)]
    spark.createDataFrame(rows, "doc_id string, doc_kind string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in queries.QUERIES["hierarchy_extract"](spark, str(tmp_path)).collect()} == {"a", "b", "c"}


def test_greedy_remap(spark):
    import random

    r = random.Random(9)
    pairs = {(a, b): round(r.random(), 2) for a in range(30) for b in range(a + 1, 30) if r.random() < 0.12}
    keep, want = [], {}
    for b in range(30):
        like = [(-pairs[a, b], a) for a in keep if (a, b) in pairs]
        if like:
            want[b] = min(like)[1]
        else:
            keep.append(b)
    d = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "id_a int, id_b int, similarity double")
    assert {x.old_id: x.canonical_id for x in kg.greedy_remap(d).collect()} == want
    assert kg.greedy_remap(d.limit(0)).count() == 0


def test_blocks_of_alike_names_are_exact(spark):
    """Against all pairs, with names that differ in many words."""
    import random

    from lexigrid.functions import text

    r = random.Random(2)
    words = "cong ty trach nhiem huu han thuong mai dich vu xay dung phat trien dau tu san xuat xuat nhap khau nguyen tran phong lam viec quoc te".split()

    def changed(s: str, k: int) -> str:
        c = list(s)
        for _ in range(k):
            i = r.randrange(len(c) - 1)
            m = r.randrange(3)
            if m == 0:
                c[i], c[i + 1] = c[i + 1], c[i]
            elif m == 1:
                c[i] = r.choice("abcdehijklmnoprstuvxy")
            else:
                c.insert(i, r.choice("aeionth"))
        return "".join(c)

    rows = []
    for i in range(60):
        base = " ".join(r.choice(words) for _ in range(r.randrange(4, 24)))
        rows += [(f"{i}-{k}", changed(base, r.randrange(5)), "O") for k in range(4)]
    rows += [("v0", "cong ty trach nhiem huu han thuong mai", "O"), ("v1", "cong ty trahc nhime huu hna thuong mai", "O")]
    d = spark.createDataFrame(rows, "id string, name string, type_str string")
    first: dict = {}
    for x in d.select("id", text.canonical(F.col("name")).alias("c")).orderBy("id").collect():
        first.setdefault(x.c, x.id)
    names = sorted((i, c) for c, i in first.items() if len(c) >= 15)
    want = {(i, j) for n, (i, a) in enumerate(names) for j, b in names[n + 1 :] if round(kg.jaro_winkler(a, b), 6) >= 0.98}
    got = {(x.id_a, x.id_b) for x in kg.comparable_pairs(d).collect() if x.similarity < 1}
    assert got == want and ("v0", "v1") in got
