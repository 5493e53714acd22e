from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrid.functions import dims, query, text


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "x string").select(*cols).first()


def test_slug_and_numbers(spark):
    x = F.col("x")
    assert one(spark, "Công ty cổ phần", text.slug(x))[0] == "cong-ty-co-phan"
    assert one(spark, "89/2024/NĐ-CP", text.document_number(x), text.reference_number(x)) == ("89-2024-ND-CP", "89-2024-ND")
    assert one(spark, None, text.slug(x))[0] is None
    assert one(spark, "", text.slug(x))[0] == ""


def test_citations(spark):
    r = spark.range(1).select(text.citation(F.lit(5), F.lit(2), F.lit("a")), text.citation(F.lit(5), F.lit(None).cast("int"), F.lit(None).cast("string"))).first()
    assert r == ("Điểm a, Khoản 2, Điều 5", "Điều 5")
    assert one(spark, "điểm đ khoản 3 Điều 17", text.parse_citation(F.col("x")))[0].asDict() == {"article": 17, "clause": 3, "point": "đ"}


def test_article_number_formats(spark):
    d = spark.createDataFrame([("59-2020-QH14:d206:k1",), ("Điều 7",), ("12",), ("d9",), ("abc",), (None,)], "x string")
    assert [r[0] for r in d.select(text.article_number(F.col("x"))).collect()] == [206, 7, 12, 9, None, None]


def test_dates(spark):
    d = spark.createDataFrame([("1/2/2020",), ("ngày 05 tháng 3 năm 2021",), ("31-02-2020",), ("x",)], "x string")
    assert [r[0] for r in d.select(text.vietnamese_date(F.col("x"))).collect()] == [date(2020, 2, 1), date(2021, 3, 5), None, None]


def test_roman_predicate_json(spark):
    assert one(spark, "XIV", text.roman(F.col("x")))[0] == 14
    assert one(spark, "  yêu  cầu ", text.predicate(F.col("x")))[0] == "YÊU_CẦU"
    assert one(spark, 'so: ```json\n{"a": 1,}\n``` end', text.salvaged_json(F.col("x")))[0] == '{"a": 1}'
    assert one(spark, "no json", text.salvaged_json(F.col("x")))[0] is None


def test_ngrams_and_keywords(spark):
    r = one(spark, "a b c", text.ngrams(text.words(F.col("x")), 2), text.ngrams(text.words(F.col("x")), 4))
    assert r[0] == ["a b", "b c"] and r[1] == []
    assert one(spark, "Vốn điều lệ của công ty là 12", text.keywords(F.col("x")))[0] == ["Vốn", "điều", "lệ", "công", "ty"]


def test_query_analysis(spark):
    q = spark.createDataFrame(
        [(1, "CTCP có cần ĐKKD không?"), (2, "Điều 5 quy định gì về thành lập công ty?"), (3, "Mức phạt khi chậm nộp thuế"), (4, "lập công ty TNHH 1TV"), (5, None)], "qid int, text string"
    )
    r = {x.qid: x for x in query.analyzed(q).collect()}
    assert r[1].expanded == "CTCP (Công ty cổ phần) có cần ĐKKD (Đăng ký kinh doanh) không?"
    assert r[2].article_refs == [5] and r[2].query_type == "article_lookup" and r[2].intent == "reference"
    assert r[3].intent == "penalty"
    assert r[4].expanded == "lập công ty TNHH 1TV (Trách nhiệm hữu hạn một thành viên), thành lập doanh nghiệp, đăng ký doanh nghiệp"
    assert r[5].intent == "general" and r[5].expanded is None


def test_documents_named(spark):
    q = spark.createDataFrame([(1, "theo Nghị định 01/2021/NĐ-CP"), (2, "thông tư nào"), (3, "không có")], "qid int, text string")
    r = {(x.qid, x.doc_ref): x.confidence for x in query.detected_documents(q, "qid", "text").collect()}
    assert r == {(1, "nghi_dinh_01_2021"): 1.0, (2, "thong_tu"): 0.6}


def test_weights_sum_to_one():
    assert abs(sum(dims.DUAL_WEIGHTS.values()) - 1) < 0.01


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aăâđêôơưéỳ XY-.", max_size=12), min_size=1, max_size=8))
def test_slug_is_idempotent(spark, names):
    d = spark.createDataFrame([(n,) for n in names], "x string").select(text.slug(F.col("x")).alias("a"))
    assert d.filter(F.col("a") != text.slug(F.col("a"))).count() == 0
