"""Extraction from legal text: structure, cross-references, abbreviations, terms, HTML."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import dims, text

_LAW = r"(\d+/\d{4}/[A-Za-zĐđ0-9-]+)"
# Cross-reference patterns in the order that decides overlaps: (pattern; groups of article, clause, point, law; predicate; confidence).
CROSSREF_PATTERNS = (
    (rf"(?:theo|căn\s+cứ|quy\s+định\s+(?:tại)?|áp\s+dụng)\s+Điều\s+(\d+)(?:[,\s]+Khoản\s+(\d+))?(?:[,\s]+Điểm\s+([a-zđ]))?(?:\s+(?:Luật|Nghị\s+định|Thông\s+tư)\s+(?:số\s+)?{_LAW})?", (1, 2, 3, 4), "THAM_CHIẾU", 0.95),
    (rf"(?:được\s+)?(?:sửa\s+đổi|bổ\s+sung)\s+(?:bởi|theo|tại)\s+Điều\s+(\d+)(?:\s+(?:Luật|Nghị\s+định)\s+(?:số\s+)?{_LAW})?", (1, 0, 0, 2), "SỬA_ĐỔI", 0.90),
    (rf"thay\s+thế\s+(?:cho\s+)?Điều\s+(\d+)(?:\s+(?:Luật|Nghị\s+định)\s+(?:số\s+)?{_LAW})?", (1, 0, 0, 2), "THAY_THẾ", 0.90),
    (r"(?:tại|của|theo)\s+Điều\s+(\d+)(?:[,\s]+Khoản\s+(\d+))?", (1, 2, 0, 0), "THAM_CHIẾU", 0.75),
)
#: The order of words that names the smallest part first and the law as a numbered text; after the fixed patterns.
FURTHER_PATTERNS = (
    (rf"(?:theo|căn\s+cứ|tại|của)\s+(?:Điểm\s+([a-zđ])[,\s]+)?(?:Khoản\s+(\d+)[,\s]+)?Điều\s+(\d+)(?:\s+(?:văn\s+bản|Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)\s+(?:số\s+)?{_LAW})?", (3, 2, 1, 4), "THAM_CHIẾU", 0.75),
)
#: Added for a law's number and for a clause; the sum is at most 1.
LAW_BONUS, CLAUSE_BONUS = 0.05, 0.02
#: Characters on each side in which the sentence around a reference is sought.
CONTEXT = 200
_COMPILED = [(re.compile(p, re.I), g, t, c) for p, g, t, c in CROSSREF_PATTERNS + FURTHER_PATTERNS]


def context_sentence(s: str, start: int, end: int) -> str:
    """What stands around s[start:end] up to the next of . ; : or a line's end, at most CONTEXT characters each way."""
    low = max(0, start - CONTEXT)
    a = max((s.rfind(c, low, start) for c in ".;:\n"), default=-1) + 1
    ends = [p for p in (s.find(c, end, end + CONTEXT) for c in ".;:\n") if p >= 0]
    return s[max(a, low) : min(ends) if ends else min(len(s), end + CONTEXT)].strip()


def references_in(s: str) -> list[tuple]:
    """(position, text, article, clause, point, law, predicate, confidence, context): references by place; of overlapping ones the earlier pattern's."""
    taken: list[tuple[int, int]] = []
    out = []
    for pattern, (ga, gc, gp, gl), kind, confidence in _COMPILED:
        for m in pattern.finditer(s):
            a, b = m.span()
            if any(a < y and x < b for x, y in taken):
                continue
            taken.append((a, b))
            article = int(m.group(ga)[:9])
            clause = int(m.group(gc)[:9]) if gc and m.group(gc) else None
            point = m.group(gp).lower() if gp and m.group(gp) else None
            law = m.group(gl) if gl else None
            if article:
                score = min(1.0, min(1.0, confidence + LAW_BONUS * bool(law)) + CLAUSE_BONUS * bool(clause))
                out.append((a, m.group(0).strip(), article, clause, point, law, kind, round(score, 6), context_sentence(s, a, b)))
    return sorted(out, key=lambda r: r[0])


REFERENCE_SCHEMA = "position int, reference string, article int, clause int, point string, law string, predicate string, confidence double, context string"


def _mapped(df: DataFrame, key: str, column: str, schema: str, rows, hint: str) -> DataFrame:
    """rows(text) for each text that has `hint` (a JVM pattern), as (key, schema...)."""
    kind = df.schema[key].dataType.simpleString()
    names = [key] + [x.split()[0] for x in schema.split(", ")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(k, *r) for k, t in zip(f["k"], f["t"]) for r in rows(t)]
            yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n, t in (x.split() for x in schema.split(", ")) if t == "int"})

    return df.select(F.col(key).alias("k"), F.col(column).alias("t")).filter(F.col("t").rlike(hint)).mapInPandas(work, f"`{key}` {kind}, {schema}")


def crossrefs(articles: DataFrame, key: str = "id", column: str = "content") -> DataFrame:
    """(key, position, reference, article, clause, point, law, predicate, confidence, context) for each reference; only texts that name an article go to Python."""
    return _mapped(articles, key, column, REFERENCE_SCHEMA, references_in, r"(?iu)điều\s+\d")


def resolved_crossrefs(refs: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """(crossref_id, src_article, dst_article, dst_doc, ref_type, confidence): references with the document and article they lead to, once per source, target and
    type. Without a law's number it is the source's own document; dst_doc stays null when no such document is there."""
    known = documents.select(F.col("id").alias("dst_doc")).distinct()
    own = text.document_of(F.col(key))
    d = refs.withColumn("want", F.when(F.col("law").isNotNull(), text.document_number(F.col("law"))).otherwise(own))
    d = d.join(known, d["want"] == known["dst_doc"], "left")
    d = d.withColumn("dst_article", F.when(F.col("dst_doc").isNotNull(), F.concat("dst_doc", F.lit(":d"), "article"))).withColumn("ref_type", F.try_element_at(text.literal_map(dims.CROSSREF_TYPES), F.col("predicate")))
    g = d.groupBy(F.col(key).alias("src_article"), "dst_article", "want", "article", "ref_type").agg(F.min("dst_doc").alias("dst_doc"), F.max("confidence").alias("confidence"), F.min("position").alias("position"))
    g = g.withColumn("i", F.row_number().over(Window.partitionBy("src_article").orderBy("position", "want", "article", "ref_type")))
    cid = F.concat("src_article", F.lit("→"), F.coalesce("dst_article", F.lit("ext")), F.lit("#"), "i")
    return g.select(cid.alias("crossref_id"), "src_article", "dst_article", "dst_doc", "ref_type", "confidence")


def parsed_reference(c: Column) -> Column:
    """struct(article, clause, point, document) of a reference in words; document null means the current one."""
    law = F.coalesce(F.nullif(F.regexp_extract(c, r"(?iu)(?:luật|nghị\s+định|thông\s+tư)\s+(?:số\s+)?(\d+/\d{4}(?:/[A-Za-z0-9Đđ-]+)?)", 1), F.lit("")))
    p = text.parse_citation(c)
    return F.struct(p["article"].alias("article"), p["clause"].alias("clause"), p["point"].alias("point"), text.document_number(law).alias("document"))


# Tags of common words and of proper names, as a tagger of Vietnamese gives them.
COMMON_TAGS = ("N", "V", "A", "P", "R", "E", "C", "T", "I", "L")
PROPER_TAGS = ("Np", "Ny", "Nb", "Nu")
CLASSIFIER_TAG = "M"


def abbreviation_class(c: Column, tag: Column | None = None) -> Column:
    """struct(is_abbreviation, confidence, reason) of a word by its letters and, where a tagger gave one, its tag.

    Without vowels 100, hyphenated and short 95; tagged as a common word not, at 10; as a proper name with vowels not, at 15; mostly consonants 85, as a classifier 75,
    and longer ones 70.
    """
    clean = F.upper(F.regexp_replace(c, "-", ""))
    n = F.length(clean)
    vowels = n - F.length(F.translate(clean, dims.VIETNAMESE_VOWELS, ""))
    ratio = (n - vowels) / F.greatest(n, F.lit(1))
    tag = F.lit(None).cast("string") if tag is None else tag
    common, proper = F.coalesce(tag.isin(*COMMON_TAGS), F.lit(False)), F.coalesce(tag.isin(*PROPER_TAGS), F.lit(False))
    say = lambda yes, conf, why: F.struct(F.lit(yes).alias("is_abbreviation"), F.lit(conf).alias("confidence"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    return (
        F.when((vowels == 0) & (n >= 2), say(True, 100, "all_consonants"))
        .when(c.contains("-") & (n <= 6), say(True, 95, "hyphenated"))
        .when(common, say(False, 10, F.concat(F.lit("pos_"), tag)))
        .when(proper & (vowels > 0) & ((n > 4) | (ratio < 0.70)), say(False, 15, F.concat(F.lit("pos_"), tag, F.lit("_has_vowel"))))
        .when((ratio >= 0.75) & (n <= 5), say(True, 85, "high_cons_short_untagged"))
        .when(F.coalesce(tag == CLASSIFIER_TAG, F.lit(False)) & (ratio >= 0.7), say(True, 75, F.concat(F.lit("pos_"), tag, F.lit("_high_cons"))))
        .when((ratio >= 0.85) & (n <= 6), say(True, 70, "very_high_cons"))
        .otherwise(say(False, 0, ""))
    )


def tagged(words: DataFrame, tagger: Callable[[str, str], str | None], word: str = "word", context: str = "context") -> DataFrame:
    """words (word, context) with tag, as the tagger gives it for the word in its context; each pair is asked once, in Arrow batches."""
    pairs = words.select(word, context).distinct()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["tag"] = [tagger(w, c) if w is not None else None for w, c in zip(f[word], f[context])]
            yield f

    tags = pairs.mapInPandas(ask, f"`{word}` string, `{context}` string, tag string")
    return words.join(tags.select(F.col(word).alias("_w"), F.col(context).alias("_c"), "tag"), F.col(word).eqNullSafe(F.col("_w")) & F.col(context).eqNullSafe(F.col("_c")), "left").drop("_w", "_c")


def listed_abbreviations(a: DataFrame, confidence: int = 0, least: int = 0, category: str | None = None) -> DataFrame:
    """abbreviations() of at least so many uses and such confidence, and of a category where the table has one; the most used first, ties by the word."""
    kept = a.filter((F.col("corpus_count") >= least) & (F.col("confidence") >= confidence))
    if category is not None:
        kept = kept.filter(F.col("category") == category)
    return kept.orderBy(F.desc("corpus_count"), "abbr")


_UPPER = r"[\p{Lu}][\p{Lu}0-9\-]{1,9}"


def abbreviations(df: DataFrame, column: str) -> DataFrame:
    """(abbr, corpus_count, confidence, reason): words in capitals of all texts that are abbreviations, with how often they stand there."""
    w = df.select(F.explode(F.regexp_extract_all(column, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({_UPPER})(?![\p{{L}}\p{{N}}_])"), F.lit(1))).alias("abbr"))
    g = w.groupBy("abbr").agg(F.count("*").alias("corpus_count")).withColumn("c", abbreviation_class(F.col("abbr")))
    return g.filter("c.is_abbreviation").select("abbr", "corpus_count", "c.confidence", "c.reason")


def full_forms(df: DataFrame, column: str) -> DataFrame:
    """(abbr, full_form, confidence, uses): 'X (ABBR)' at 80 and 'X (gọi tắt là ABBR)' at 95; the surest, then the most used, then the shortest full form."""
    called = r"(?iu)([\p{L}\s]{3,50}?)\s*\(\s*(?:sau đây |từ đây )?(?:gọi tắt là|viết tắt là|gọi là)\s+([\p{L}][\p{L}0-9\-]{1,9})\s*\)"
    plain = rf"([\p{{L}}\s]{{3,50}}?)\s*\(\s*({_UPPER})\s*\)"
    parts = []
    for p, conf in ((called, 95), (plain, 80)):
        g = lambda i, p=p: F.regexp_extract_all(column, F.lit(p), F.lit(i))
        parts.append(df.select(F.explode(F.arrays_zip(g(1).alias("f"), g(2).alias("a"))).alias("x"), F.lit(conf).alias("confidence")))
    d = parts[0].unionByName(parts[1]).select(F.upper(F.trim("x.a")).alias("abbr"), F.trim("x.f").alias("full_form"), "confidence")
    d = d.filter((F.length("full_form") > F.length("abbr")) & ~((F.upper("full_form") == F.col("full_form")) & ~F.col("full_form").contains(" ")))
    n = d.groupBy("abbr", "full_form", "confidence").agg(F.count("*").alias("uses"))
    return n.groupBy("abbr").agg(F.max_by(F.struct("full_form", "confidence", "uses"), F.struct("confidence", "uses", -F.length("full_form"), "full_form")).alias("b")).select("abbr", "b.*")


GLOSSARY_TITLE = r"(?iu)giải\s+thích\s+từ\s+ngữ|từ\s+ngữ\s+sử\s+dụng|định\s+nghĩa|thuật\s+ngữ"
# How legal prose introduces a short form, and defines a term in a numbered line.
_CALLED = re.compile(r"(.+?)\s*\(?\s*sau\s+đây\s+gọi\s+(?:tắt\s+)?là\s+[\"']?([A-ZĐa-zđ\s]+)[\"']?\s*\)?")
_ABBR_IS = re.compile(r"([A-ZÀ-Ỹa-zà-ỹ][A-ZÀ-Ỹa-zà-ỹ\s]+?)\s*\((?:sau\s+đây\s+)?(?:gọi\s+(?:tắt\s+)?là\s+)?[\"']?([A-ZĐa-zđ\s]+)[\"']?\)\s+là\s+(.+?)(?:\.|;|$)", re.M)
_NUMBERED = re.compile(r"^(\d+)[.)\s]+([A-ZÀ-Ỹa-zà-ỹ][A-ZÀ-Ỹa-zà-ỹ\s,]+?)(?::|là)\s*(.+?)(?:\.|;|$)", re.M)


def valid_term(short: str, full: str) -> bool:
    return bool(short and full) and len(short) <= 50 and len(full) <= 200 and short != full and len(short) < len(full)


def terms_in(s: str) -> list[tuple[str, str, int | None, float]]:
    """(short, full, clause, confidence) of a text's definitions; a later kind of pattern replaces an earlier one's entry."""
    found: dict[str, tuple[str, str, int | None, float]] = {}
    for pattern, confidence in ((_CALLED, 0.95), (_ABBR_IS, 0.9)):
        for m in pattern.finditer(s):
            full, short = m.group(1).strip(), m.group(2).strip()
            if valid_term(short, full):
                found[short] = (short, full, None, confidence)
    for m in _NUMBERED.finditer(s):
        inner = _CALLED.search(m.group(3))
        if inner and valid_term(inner.group(2).strip(), m.group(2).strip()):
            short = inner.group(2).strip()
            found[short] = (short, m.group(2).strip(), int(m.group(1)[:9]), 0.85)
    return list(found.values())


def is_glossary(title: Column) -> Column:
    """Whether an article's title says that it explains words."""
    return F.coalesce(title.rlike(GLOSSARY_TITLE), F.lit(False))


def terminology(articles: DataFrame, key: str = "id", column: str = "content", title: str | None = None) -> DataFrame:
    """(key, short_form, full_form, clause, confidence): terms articles define; with title, a column, only of articles that explain words by their title."""
    if title is not None:
        articles = articles.filter(is_glossary(F.col(title)))
    return _mapped(articles, key, column, "short_form string, full_form string, clause int, confidence double", terms_in, r"(?iu)gọi\s+(tắt\s+)?là|\)\s+là\s")


def best_terms(t: DataFrame) -> DataFrame:
    """(short_form, full_form, confidence): the surest full form of each short form, ties by the form."""
    return t.groupBy("short_form").agg(F.min_by(F.struct("full_form", "confidence"), F.struct(-F.col("confidence"), "full_form")).alias("b")).select("short_form", "b.*")


# The marks of a law's parts.
_PART_PATTERNS = {
    "appendix": re.compile(r"^[ \t]*phụ\s*lục(?:[ \t]+([IVXLC]+|\d+))?[.:\s]*(.*)$", re.I | re.M),
    "chapter": re.compile(r"^[ \t]*chương[ \t]+([IVXLC]+|\d+)[.:\s]*(.*)$", re.I | re.M),
    "section": re.compile(r"^[ \t]*mục[ \t]+(\d+)[.:\s]*(.*)$", re.I | re.M),
    "article": re.compile(r"^[ \t]*điều[ \t]+(\d+)[.:\s]*(.*)$", re.I | re.M),
    "clause": re.compile(r"^[ \t]*(\d+)\.[ \t]*(.*)$", re.M),
    "point": re.compile(r"^[ \t]*([a-zđ])\)[ \t]*(.*)$", re.M),
}
_LEVEL = {"appendix": 0, "chapter": 0, "section": 1, "article": 2, "clause": 3, "point": 4}


def parts_in(s: str) -> list[tuple[str, str, int, int, int, str, str]]:
    """(kind, number, place, parent, depth, title, body) of a law's parts in order; parent is the place of the part it belongs to, 0 for none.

    After the first appendix mark nothing else than appendices begins. Clauses belong to articles only, points to clauses.
    """
    marks = sorted(((m.start(), m.end(), k, m.group(1) or "", m.group(2).strip()) for k, p in _PART_PATTERNS.items() for m in p.finditer(s)), key=lambda x: (x[0], _LEVEL[x[2]]))
    cut = next((x[0] for x in marks if x[2] == "appendix"), len(s) + 1)
    kept, open_, out = [], {}, []
    for x in marks:
        level = _LEVEL[x[2]]
        if x[0] > cut and x[2] != "appendix":
            continue
        if (x[2] == "clause" and "article" not in open_) or (x[2] == "point" and "clause" not in open_):
            continue
        kept.append(x)
        open_ = {k: v for k, v in open_.items() if _LEVEL[k] < level}
        parent = max(open_.values(), default=0)
        place = len(kept)
        open_[x[2]] = place
        out.append((x[2], x[3], place, parent, len(open_), x[4]))
    ends = [x[0] for x in kept[1:]] + [len(s)]
    return [(*o, s[x[1] : e].strip()) for o, x, e in zip(out, kept, ends)]


def structure(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, kind, number, place, parent, depth, title, body): the parts of each text."""
    return _mapped(df, key, column, "kind string, number string, place int, parent int, depth int, title string, body string", parts_in, r"(?imu)^\s*(phụ\s*lục|chương|mục|điều|\d+\.|[a-zđ]\))")


def structure_counts(parts: DataFrame, key: str) -> DataFrame:
    """(key, chapters, sections, articles, clauses, points, appendices)."""
    n = lambda k: F.sum((F.col("kind") == k).cast("long"))
    return parts.groupBy(key).agg(*[n(k).alias(f"{k}s" if k != "appendix" else "appendices") for k in ("chapter", "section", "article", "clause", "point", "appendix")])


class _Text(HTMLParser):
    """Text of an HTML page: paragraphs, without scripts and controls."""

    SKIP = frozenset({"script", "style", "nav", "button", "form", "header", "footer", "noscript", "select"})
    BREAK = frozenset({"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [""], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP
        if tag in self.BREAK:
            self.parts.append("")

    def handle_endtag(self, tag):
        self.depth -= tag in self.SKIP and self.depth > 0
        if tag in self.BREAK:
            self.parts.append("")

    def handle_data(self, data):
        if not self.depth:
            self.parts[-1] += data


def html_text(s: str) -> str:
    """The paragraphs of a page, white space squeezed, joined by blank lines."""
    p = _Text()
    p.feed(s)
    p.close()
    return "\n\n".join(x for x in (" ".join(html.unescape(t).split()) for t in p.parts) if x)


def pages_text(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text) of pages with markup; texts without stay as they are, white space squeezed line by line."""
    kind = df.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f["k"], "text": [html_text(t) for t in f["t"]]})

    d = df.select(F.col(key).alias("k"), F.col(column).alias("t")).filter("t is not null")
    marked = d.filter(F.col("t").rlike(r"<[a-zA-Z/!][^>]*>|&[a-zA-Z#]")).mapInPandas(work, f"`{key}` {kind}, text string")
    plain = d.filter(~F.col("t").rlike(r"<[a-zA-Z/!][^>]*>|&[a-zA-Z#]")).select(F.col("k").alias(key), F.trim(F.regexp_replace(F.regexp_replace("t", r"[ \t]+", " "), r"\s*[\r\n]+\s*", "\n\n")).alias("text"))
    return marked.unionByName(plain)


class _Fields(HTMLParser):
    """Titles of a page by where they stand, and rows of two cells."""

    PLACES = ("h1", "og", "title", "h2")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.titles: dict[str, str] = {}
        self.rows: list[list[str]] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("property") == "og:title" and a.get("content"):
            self.titles.setdefault("og", a["content"])
        if tag == "tr":
            self.rows.append([])
        if tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
        if tag not in ("meta", "br", "img", "input", "link", "hr"):
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        for t in ("h1", "title", "h2"):
            if t in self.inside:
                self.titles[t] = self.titles.get(t, "") + data
        if self.rows and self.rows[-1] and ("td" in self.inside or "th" in self.inside):
            self.rows[-1][-1] += data


def page_fields(s: str) -> tuple[str | None, dict[str, str]]:
    """(title, fields) of a page: the first heading, else the title it gives to others, its own, a lesser heading; fields are the rows of two cells, the first of a name."""
    p = _Fields()
    p.feed(s)
    p.close()
    squeezed = lambda t: " ".join(t.split())
    title = next((x for k in _Fields.PLACES if (x := squeezed(p.titles.get(k, "")))), None)
    fields: dict[str, str] = {}
    for r in p.rows:
        if len(r) == 2 and squeezed(r[0]):
            fields.setdefault(squeezed(r[0]).rstrip(": "), squeezed(r[1]))
    return title, fields


def pages_fields(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, title, fields) of pages; null pages are left out, texts without markup have neither."""
    kind = df.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *page_fields(t)) for k, t in zip(f["k"], f["t"])]
            yield pd.DataFrame(rows, columns=[key, "title", "fields"])

    return df.select(F.col(key).alias("k"), F.col(column).alias("t")).filter("t is not null").mapInPandas(work, f"`{key}` {kind}, title string, fields map<string,string>")
