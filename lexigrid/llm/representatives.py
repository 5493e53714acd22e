"""One surviving record for each group of duplicates, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Descriptions that stand where one is missing, lower case.
STAND_INS = (
    "n/a", "na", "nan", "none", "null", "nil", "todo", "tbd", "unknown", "undefined", "no description", "description",
    "mô tả", "không có mô tả", "chưa có mô tả", "không có", "không rõ", "không có thông tin", "chưa có thông tin", "chưa rõ",
    "chưa cập nhật", "đang cập nhật", "đang bổ sung", "chưa bổ sung", "xem văn bản gốc", "trống", "để trống", "xem thêm",
    "mô tả của mục này đang được cập nhật", "vui lòng quay lại sau", "vui lòng thử lại sau", "nội dung đang được cập nhật",
)
#: What marks a text as a message of the extractor rather than a description.
ERROR = r"^\W*(error|exception|traceback|fatal|warning|lỗi)\b[^.]{0,40}(\d|:|timeout|fail|exception)|\b(extraction|request|connection) (timeout|failed|error)|\btraceback \(most recent"
#: An occurrence count is believable from 1 to this, exclusive.
COUNT_LIMIT = 100_000


def said(text: Column) -> Column:
    """How much a description says: the letters and digits of the different words of its different sentences.

    Padding, repetition, stand-ins and error messages add nothing; 0 for null and for texts that say nothing.
    """
    # Slashes and dots inside a token stay, so "n/a" is one word and 3.000.000 one number.
    lower = F.lower(text)
    parts = F.split(F.regexp_replace(lower, r"_+", " "), r"[;!?,…\n\r]+|\.(?=[\s.]|$)|[()\[\]]")
    words = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"[^\p{L}\p{M}\p{N}/.%]+", " ")))
    stand_ins = "|".join(sorted((s.replace("/", "/") for s in STAND_INS), key=len, reverse=True))
    telling = F.filter(words, lambda p: (F.length(p) > 0) & ~p.rlike(rf"^((?:{stand_ins})[\s.]*)+$"))
    distinct = F.array_distinct(telling)
    letters = F.aggregate(
        distinct,
        F.lit(0),
        lambda n, p: n + F.length(F.regexp_replace(F.array_join(F.array_distinct(F.split(p, " ")), ""), r"[^\p{L}\p{M}\p{N}]", "")),
    )
    return F.when(text.isNull() | lower.rlike(ERROR), 0).otherwise(letters)


def candidates(records: DataFrame) -> DataFrame:
    """(entity_id, record_id, field_name, rank, second, third, value): each usable value of a record, long.

    rank is what the field is judged by: trust for confidence, completeness for description, recency for occurrence_count. Ties are
    broken by the other two and at last by record_id, so the result is the same in every run.
    """
    c = F.col("confidence")
    trust = F.when(c.between(0, 1) & ~F.isnan(c), c)
    recency = F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(0)).cast("double")
    says = said(F.col("description")).cast("double")
    n = F.col("occurrence_count")
    count = F.when((n >= 1) & (n < COUNT_LIMIT), n)
    d = records.filter("entity_id is not null and record_id is not null").select(
        "entity_id", "record_id", trust.alias("t"), recency.alias("r"), says.alias("s"), count.alias("n"), "description"
    )
    field = lambda name, ok, a, b, e, value: F.when(ok, F.struct(F.lit(name).alias("field_name"), a.alias("rank"), b.alias("second"), e.alias("third"), value.cast("string").alias("value")))
    t0 = F.coalesce("t", F.lit(-1.0))
    fields = F.array_compact(
        F.array(
            field("confidence", F.col("t").isNotNull(), F.col("t"), F.col("r"), F.col("s"), F.col("t")),
            field("description", F.col("s") > 0, F.col("s"), t0, F.col("r"), F.col("description")),
            field("occurrence_count", F.col("n").isNotNull(), F.col("r"), F.col("s"), t0, F.col("n")),
        )
    )
    return d.select("entity_id", "record_id", F.explode(fields).alias("f")).select("entity_id", "record_id", "f.*")


def survivors(records: DataFrame, values: bool = True) -> DataFrame:
    """(entity_id, field_name, record_id[, value]): of each entity with two or more records, the record each field is taken from.

    Records are ranked by a window per entity and field of which the first row is kept; Spark applies that limit before the shuffle
    too, so an entity that holds a third of all rows sends at most one row a field from each map task. Repeated rows count once;
    entities with one record_id, null ids, and fields without a usable value have no row. An empty table gives none.
    """
    c = candidates(records)
    w = Window.partitionBy("entity_id", "field_name").orderBy(F.desc("rank"), F.desc("second"), F.desc("third"), "record_id")
    keep = ["entity_id", "field_name", "record_id"] + ["value"] * values
    best = c.select(*keep, "rank", "second", "third").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*keep)
    several = (
        records.filter("entity_id is not null and record_id is not null")
        .groupBy("entity_id")
        .agg(F.min("record_id").alias("_a"), F.max("record_id").alias("_b"))
        .filter("_a < _b")
        .select("entity_id")
    )
    return best.join(several, "entity_id", "left_semi")


def merged_entities(records: DataFrame) -> DataFrame:
    """One row per entity with two or more records: each field from the record that deserves it, and from which."""
    s = survivors(records)
    pick = lambda f, what: F.max(F.when(F.col("field_name") == f, F.col(what)))
    return s.groupBy("entity_id").agg(
        pick("confidence", "value").cast("double").alias("confidence"),
        pick("confidence", "record_id").alias("confidence_from"),
        pick("description", "value").alias("description"),
        pick("description", "record_id").alias("description_from"),
        pick("occurrence_count", "value").cast("int").alias("occurrence_count"),
        pick("occurrence_count", "record_id").alias("occurrence_count_from"),
    )
