"""Column functions over text, ids and numbers. All stay in the JVM; null gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions import dims

_MARKED, _PLAIN = dims.accent_map()


def fold(c: Column) -> Column:
    """Without the marks of Vietnamese letters."""
    return F.translate(c, _MARKED, _PLAIN)


def literal_map(m: Mapping[str, object]) -> Column:
    return F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])


def slug(c: Column) -> Column:
    """Lower case without marks, every other run of characters a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(F.lower(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def canonical(c: Column, abbreviations: Mapping[str, str] = dims.QUERY_ABBREVIATIONS) -> Column:
    """Lower case, abbreviations written out word by word, without marks and punctuation, single blanks."""
    m = literal_map({k.lower(): v.lower() for k, v in abbreviations.items()})
    words = F.transform(F.split(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), " "), lambda w: F.coalesce(F.try_element_at(m, w), w))
    bare = F.regexp_replace(fold(F.array_join(words, " ")), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def document_number(c: Column) -> Column:
    """89/2024/NĐ-CP as 89-2024-ND-CP."""
    return F.regexp_replace(F.translate(F.regexp_replace(c, "/", "-"), "Đđ", "Dd"), "[^A-Za-z0-9-]", "")


def reference_number(c: Column) -> Column:
    """The number as cross-references know it: without the issuer, 89-2024-ND."""
    return F.regexp_replace(document_number(c), "-(CP|BTC|BKHDT|BXD|BCT|NHNN|TTg|UBND|HDND)$", "")


def article_number(c: Column) -> Column:
    """The article's number in an id (…:d5), in words (Điều 5) or alone (5, d5)."""
    first = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.coalesce(first(r":d(\d+)"), first(r"(?iu)điều\s+(\d+)"), first(r"^d?(\d+)$")).cast("int")


def document_kind(c: Column) -> Column:
    """The kind of a document by how it is named, "Bộ luật Lao động" or "NGHỊ ĐỊNH": the longest name it begins with; null for others."""
    low = F.trim(F.lower(c))
    out = F.lit(None).cast("string")
    for name in sorted(dims.DOCUMENT_KINDS, key=len):  # longer ones are tried before, so they are put round shorter ones
        out = F.when(low.startswith(name) | fold(low).startswith(_plain(name)), dims.DOCUMENT_KINDS[name]).otherwise(out)
    return out


def _plain(s: str) -> str:
    return s.translate(str.maketrans(_MARKED, _PLAIN))


def document_of(c: Column) -> Column:
    return F.split_part(c, F.lit(":"), F.lit(1))


def words(c: Column) -> Column:
    """Lower case, split at blanks."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def terms(c: Column, stop: Sequence[str] = dims.STOP_WORDS) -> Column:
    """Distinct words without stop words."""
    return F.array_except(words(c), F.array(*map(F.lit, stop)))


def keywords(c: Column, stop: Sequence[str] = dims.KEYWORD_STOP_WORDS) -> Column:
    """Words of two letters or more, as written, that are neither stop words nor numbers."""
    found = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*stop) & ~w.rlike(r"^[0-9]+$"))


def ngrams(w: Column, n: int) -> Column:
    """Runs of n words of an array, joined by blanks. Neighbours are zipped, so the array is made n times a row, not once a word."""
    out = w
    for k in range(1, n):
        out = F.zip_with(out, F.slice(w, k + 1, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda x: x.isNotNull()) if n > 1 else w


def distinct_keywords(c: Column, lower: Column) -> Column:
    """An array's items, the first of those that differ in case only, in order; lower is the array in lower case. Pass columns that are there, not
    expressions, which would be worked out again for every item."""
    return F.transform(F.array_distinct(lower), lambda w: F.element_at(c, F.array_position(lower, w).cast("int")))


def citation(article: Column, clause: Column, point: Column) -> Column:
    """Điểm a, Khoản 2, Điều 5; absent parts are left out."""
    return F.concat_ws(", ", F.concat(F.lit("Điểm "), point), F.concat(F.lit("Khoản "), clause.cast("string")), F.concat(F.lit("Điều "), article.cast("string")))


def parse_citation(c: Column) -> Column:
    """struct(article int, clause int, point string) of a citation in words."""
    get = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.struct(
        get(r"(?iu)điều\s+(\d{1,6})").cast("int").alias("article"), get(r"(?iu)khoản\s+(\d{1,6})").cast("int").alias("clause"), F.lower(get(r"(?iu)điểm\s+([a-zđ])(?![\p{L}])")).alias("point")
    )


def vietnamese_date(c: Column) -> Column:
    """d/m/Y, d-m-Y or "ngày d tháng m năm Y"; null for others and for days that don't exist."""
    p = r"(?iu)(?:ngày\s+)?(\d{1,2})(?:\s*[/-]\s*|\s+tháng\s+)(\d{1,2})(?:\s*[/-]\s*|\s+năm\s+)(\d{4})"
    g = lambda i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    return F.try_to_date(F.concat_ws("-", g(3), F.lpad(g(2), 2, "0"), F.lpad(g(1), 2, "0")), "yyyy-MM-dd")


def roman(c: Column) -> Column:
    """The number of a Roman numeral; 1 for anything else."""
    value = literal_map({"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000})
    n = F.transform(F.split(F.upper(c), ""), lambda ch: F.coalesce(F.try_element_at(value, ch), F.lit(0)))
    total = F.aggregate(F.transform(n, lambda x, i: F.when(x < F.coalesce(F.get(n, i + 1), F.lit(0)), -x).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return F.when(F.upper(c).rlike("^[IVXLCDM]+$"), total).otherwise(1)


def predicate(c: Column) -> Column:
    """Upper case, blanks as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"\s+", "_"), "_+", "_"), "^_+|_+$", "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; 0 where one has no length."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = d(a), d(b)
    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(size > 0, dot(x, y) / size).otherwise(0.0)


def salvaged_json(c: Column) -> Column:
    """The JSON in a model's answer: inside a code fence, else the first flat object, without trailing commas; null when there is none."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1), F.lit(""))
    flat = F.nullif(F.regexp_extract(c, r"(?s)(\{[^{}]*\})", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(fenced, flat), r",\s*([}\]])", "$1")


def hash_id(c: Column, length: int = 32) -> Column:
    """The first digits of the SHA-256 of a text."""
    return F.substring(F.sha2(c, 256), 1, length)


def last_sentence_cut(c: Column, limit: int) -> Column:
    """At most limit characters, cut after the last full stop where there is one."""
    head = F.substring(c, 1, limit)
    cut = F.regexp_extract(head, r"(?s)^(.*\.)", 1)
    return F.when(F.length(c) <= limit, c).when(cut != "", cut).otherwise(head)


def expand_words(c: Column, dictionary: Mapping[str, str] = dims.QUERY_ABBREVIATIONS) -> Column:
    """Each abbreviation that stands alone followed by its full form in brackets, longest first, in one pass."""
    m = literal_map({k.upper(): v for k, v in dictionary.items()})
    alternatives = "|".join(sorted(map(_quoted, dictionary), key=lambda k: (-len(k), k)))
    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{alternatives})(?![\p{{L}}\p{{N}}_])"
    gaps = F.split(c, pattern, -1)
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.array_join(
        F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.concat(F.get(hits, i), F.lit(" ("), F.try_element_at(m, F.upper(F.get(hits, i))), F.lit(")")), F.lit("")))), ""
    )


def _quoted(s: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in s)
