"""Analysis of questions, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import dims, text


def any_of(c: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def intent(c: Column) -> Column:
    """penalty, definition, procedure, requirement, reference or general: the first that shows."""
    q = F.lower(c)
    out = None
    for name, needles in dims.INTENT_WORDS.items():
        cond = any_of(q, needles)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.when(c.rlike(r"[Đđ]iều\s+\d+"), "reference").otherwise("general")


def query_type(c: Column) -> Column:
    """The first type of the fixed order one of whose patterns is found; general otherwise."""
    out = None
    for name, patterns in dims.QUERY_TYPE_PATTERNS.items():
        cond = c.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("general")


def article_refs(c: Column) -> Column:
    """Distinct article numbers, ascending."""
    found = F.concat(F.regexp_extract_all(c, F.lit(r"[Đđ]iều\s+(\d{1,9})"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"[Đđ]\.\s*(\d{1,9})"), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def law_refs(c: Column) -> Column:
    """Distinct numbers of laws and decrees, ascending."""
    found = F.concat(
        F.regexp_extract_all(c, F.lit(r"[Ll]uật\s+(?:số\s+)?(\d+/\d{4}/[A-Z0-9\-]+)"), F.lit(1)),
        F.regexp_extract_all(c, F.lit(r"[Nn]ghị\s+định\s+(?:số\s+)?(\d+/\d{4}/[A-Z0-9\-]+)"), F.lit(1)),
    )
    return F.array_sort(F.array_distinct(found))


def topic_hints(c: Column) -> Column:
    """The hints of all topics that show, in the topics' order."""
    q = F.lower(c)
    parts = [F.when(any_of(q, needles), F.array(*map(F.lit, hints))).otherwise(F.array().cast("array<string>")) for needles, hints in dims.TOPIC_HINTS]
    return F.array_distinct(F.concat(*parts))


def expand(c: Column) -> Column:
    """Abbreviations written out, then the terms of the law for everyday words appended where they aren't there yet."""
    lower = F.lower(c)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, vs in dims.QUERY_SYNONYMS.items() for v in vs])
    used = F.filter(rows, lambda r: F.contains(lower, r["k"]))
    return F.aggregate(used, text.expand_words(c), lambda a, r: F.when(F.contains(F.lower(a), F.lower(r["v"])), a).otherwise(F.concat(a, F.lit(", "), r["v"])))


def analyzed(queries: DataFrame, c: str = "text") -> DataFrame:
    """queries with expanded, intent, query_type, article_refs, law_refs, keywords, topic_hints. Intent and type come from the expanded text, the rest from the
    question. Null questions give nulls and the intent and type general."""
    q = F.col(c)
    d = queries.withColumn("expanded", expand(q))
    return d.select(
        "*", intent(F.col("expanded")).alias("intent"), query_type(F.col("expanded")).alias("query_type"), article_refs(q).alias("article_refs"), law_refs(q).alias("law_refs"),
        text.keywords(q).alias("keywords"), topic_hints(q).alias("topic_hints"),
    )


def detected_documents(queries: DataFrame, key: str, c: str) -> DataFrame:
    """(key, doc_ref, doc_type, number, year, issuer, confidence): documents a question names; one that names none by number may show a type by
    keyword at confidence 0.6. Each doc_ref once."""
    names = {w.replace(" ", ""): t for t, ws in dims.DOC_TYPES.items() for w in ws}
    kind = text.literal_map(names)
    q = queries.select(F.col(key), F.lower(F.col(c)).alias("q"))
    g = lambda i: F.regexp_extract_all("q", F.lit("(?iu)" + dims.DOC_REFERENCE), F.lit(i))
    hits = q.select(key, F.explode(F.arrays_zip(g(1).alias("t"), g(2).alias("n"), g(3).alias("y"), g(4).alias("s"))).alias("h"))
    blank = lambda x: F.nullif(x, F.lit(""))
    strict = hits.select(
        key, F.try_element_at(kind, F.regexp_replace("h.t", r"\s+", "")).alias("doc_type"), F.col("h.n").alias("number"), blank(F.col("h.y")).alias("year"),
        F.upper(blank(F.col("h.s"))).alias("issuer"), F.lit(1.0).alias("confidence"),
    ).filter("doc_type is not null")
    types = F.array(*[F.struct(F.lit(t).alias("t"), any_of(F.col("q"), ws).alias("on")) for t, ws in dims.DOC_TYPES.items()])
    none = F.lit(None).cast("string")
    loose = (
        q.join(strict.select(key).distinct(), key, "left_anti")
        .select(key, F.explode(types).alias("x"))
        .filter("x.on")
        .select(key, F.col("x.t").alias("doc_type"), none.alias("number"), none.alias("year"), none.alias("issuer"), F.lit(0.6).alias("confidence"))
    )
    d = strict.unionByName(loose).withColumn("doc_ref", F.concat_ws("_", "doc_type", "number", "year"))
    return d.groupBy(key, "doc_ref").agg(F.min("doc_type").alias("doc_type"), F.min("number").alias("number"), F.min("year").alias("year"), F.min("issuer").alias("issuer"), F.max("confidence").alias("confidence"))
