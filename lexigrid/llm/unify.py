"""One consistent form for texts that look the same."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.operators.skew import hot_split_join
from lexigrid.session import cut

# Letters of other alphabets or languages and the Latin or Vietnamese letters they pass for.
TWINS = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ү": "y", "ӏ": "l", "Ӏ": "I", "ѵ": "v", "г": "r", "п": "n",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "η": "n", "ϲ": "c", "ϳ": "j",
    # Armenian, Cherokee and others seen in such disguise
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "Ꭺ": "A", "Ꭼ": "E", "Ꮇ": "M", "Ꮋ": "H", "Ꮲ": "P", "Ꭲ": "T", "Ꮯ": "C", "Ꭰ": "D",
    # Latin letters of other languages for the Vietnamese ones
    "Ð": "Đ", "ð": "đ", "Ɖ": "Đ", "ɖ": "đ", "ɑ": "a", "ɡ": "g", "ı": "i", "ᴏ": "o",
}

#: ASCII without controls, line breaks, the Vietnamese letters, and symbols that are in order: texts of these alone need no look.
PLAIN = (
    r"\n\r\x20-\x7E“”‘’–—…²³¹½¼¾°§«»•"
    + "".join(
        sorted(
            {
                c
                for base in "aăâeêioôơuưyAĂÂEÊIOÔƠUƯY"
                for tone in ("", "̀", "́", "̃", "̉", "̣")
                if ord(c := unicodedata.normalize("NFC", base + tone)) > 127
            }
            | set("đĐ")
        )
    )
)
SUSPICIOUS = f"[^{PLAIN}]"

#: Stretches of a text: blanks of every kind stand alone, plain ones and line breaks aside; all else up to the next blank is one.
_STRETCH = r"[^\s\p{Z}\u0085]+|[\t\p{Zs}&&[^ ]]"

_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x2800, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_LINE_BREAKS = {0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029}


@lru_cache(1)
def code_point_table() -> list[tuple[str, str, list[str], list[int], str | None]]:
    """(char, kind, parts, classes, twin) of every code point that isn't simply kept, made from the Unicode data by rule.

    kind: 'drop' invisible, 'blank' a space of another kind, 'mark' a combining mark, 'letter' a letter or digit, 'other'. parts is the canonical
    decomposition after narrowing wide and half-wide forms; classes are their combining classes. A few thousand rows, whatever the data.
    """
    rows = []
    for n in (*range(0x110000),):
        if 0xAC00 <= n <= 0xD7A3 or 0xD800 <= n <= 0xDFFF or 0xE000 <= n <= 0xF8FF or n >= 0xF0000 or 0x20000 <= n <= 0x3FFFF:
            continue
        c = chr(n)
        cat = unicodedata.category(c)
        if cat == "Cn":
            continue
        if n in _INVISIBLE or cat == "Cf" or (cat == "Cc" and n not in _LINE_BREAKS and n != 9):
            rows.append((c, "drop", [], [], None))
            continue
        if (cat == "Zs" and n != 0x20) or n == 9:
            rows.append((c, "blank", [" "], [0], None))
            continue
        kind = "mark" if cat[0] == "M" else "letter" if cat[0] == "L" or cat == "Nd" else "other"
        wide = unicodedata.normalize("NFKC", c) if unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")) else c
        parts = unicodedata.normalize("NFD", wide)
        twin = TWINS.get(c)
        if kind != "other" or parts != c:
            latin = kind == "letter" and cat[0] == "L" and "LATIN" in unicodedata.name(wide[0], "") and twin is None
            if parts == c and kind == "letter" and not latin and twin is None:
                continue  # a letter of another script that stays as it is
            if parts == c and latin and n < 128:
                kind = "latin"
            elif latin:
                kind = "latin"
            rows.append((c, kind, list(parts), [unicodedata.combining(p) for p in parts], twin))
    return rows


@lru_cache(1)
def composition_table() -> list[tuple[str, str, str]]:
    """(first, second, composed): the canonical compositions, Hangul syllables aside."""
    rows = []
    for n in range(0x30000):
        d = unicodedata.decomposition(chr(n))
        if d and d[0] != "<" and " " in d:
            a, b = (chr(int(x, 16)) for x in d.split())
            if unicodedata.normalize("NFC", a + b) == chr(n):
                rows.append((a, b, chr(n)))
    return rows


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    points = spark.createDataFrame(code_point_table(), "ch string, kind string, parts array<string>, classes array<int>, twin string")
    pairs = spark.createDataFrame(composition_table(), "first string, second string, composed string")
    return F.broadcast(points), pairs


def consistent_words(words: DataFrame) -> DataFrame:
    """(word, form): the consistent form of each distinct string in words.word, a stretch between blanks.

    Strings are exploded to positioned code points, which meet a table of decompositions and twins by broadcast; invisible ones go, twins are
    put right in runs of letters that have a Latin letter besides, marks are ordered by class behind their base, base and marks are
    composed, and the strings are built again. Code points carry their string's number, not the string.
    """
    points, pairs = _tables(words.sparkSession)
    words = cut(words.select("word", F.monotonically_increasing_id().alias("w")))
    by_place = Window.partitionBy("w").orderBy("at")
    cps = words.select("w", F.posexplode(F.split("word", "")).alias("at", "ch"))
    d = cps.join(points, "ch", "left").filter("kind is null or kind <> 'drop'")
    # A run of letters and marks is a word in the sense of the twins; anything else, unless it belongs to no script, ends it.
    is_part = F.col("kind").isin("latin", "letter", "mark") | (F.col("kind").isNull() & F.col("ch").rlike(r"[\p{L}\p{M}]"))
    d = d.withColumn("run", F.sum(F.when(is_part, 0).otherwise(1)).over(by_place))
    run = Window.partitionBy("w", "run")
    latin = F.max(F.col("kind") == "latin").over(run)
    # Đ's doubles are Latin letters themselves: any other letter in the run shows that they stand in a word.
    letters = F.sum(is_part.cast("int")).over(run)
    alone = F.col("ch").isin("Ð", "ð", "Ɖ", "ɖ") & (letters > 1) & ~F.coalesce(F.max(F.col("ch").rlike(r"[\p{IsCyrillic}\p{IsGreek}]") & F.col("twin").isNull()).over(run), F.lit(False))
    d = d.withColumn("twin", F.when(F.coalesce(latin, F.lit(False)) | alone, F.col("twin")))
    parts = F.when(F.col("twin").isNotNull(), F.array("twin")).otherwise(F.coalesce("parts", F.array("ch")))
    classes = F.when(F.col("twin").isNotNull(), F.array(F.lit(0))).otherwise(F.coalesce("classes", F.array(F.lit(0))))
    e = d.select("w", "at", F.posexplode(F.arrays_zip(parts.alias("c"), classes.alias("k"))).alias("sub", "p")).select("w", "at", "sub", F.col("p.c").alias("c"), F.col("p.k").alias("k"))
    e = e.withColumn("base", F.sum((F.col("k") == 0).cast("int")).over(Window.partitionBy("w").orderBy("at", "sub")))
    # A base with its marks in canonical order: a short list, as long as a letter has marks.
    clusters = e.groupBy("w", "base").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("k") == 0, -1).otherwise(F.col("k")).alias("k"), "at", "sub", "c"))).alias("list"))
    clusters = cut(clusters.select("w", "base", F.transform("list", lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"))).alias("list")))
    alone_ = clusters.filter(F.size("list") == 1).select("w", "base", F.col("list")[0]["c"].alias("text"))
    several = clusters.filter(F.size("list") > 1)
    count = several.groupBy("list").agg(F.count("*").alias("n"))
    composed = cut(_compose(count.select("list"), pairs).join(count, "list"))
    whole = alone_.unionByName(hot_split_join(several, composed, ["list"], "n").select("w", "base", "text"))
    built = whole.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "text"))), lambda x: x["text"]), "").alias("form"))
    return words.join(built, "w", "left").select("word", F.coalesce("form", F.lit("")).alias("form"))


def _compose(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """(list, text): the base composed with each mark that isn't blocked. The pairs stand in one row of arrays, read from a map."""
    table = pairs.agg(F.map_from_entries(F.collect_list(F.struct(F.concat("first", "second").alias("k"), F.col("composed").alias("v")))).alias("m"))
    d = lists.withColumn("_one", F.lit(1)).join(F.broadcast(table.withColumn("_one", F.lit(1))), "_one")
    start = F.struct(F.col("list")[0]["c"].alias("base"), F.lit("").alias("rest"), F.lit(-1).alias("last"))

    def step(a: Column, x: Column) -> Column:
        both = F.try_element_at(F.col("m"), F.concat(a["base"], x["c"]))
        ok = both.isNotNull() & (a["last"] < x["k"])
        return F.struct(F.when(ok, both).otherwise(a["base"]).alias("base"), F.when(ok, a["rest"]).otherwise(F.concat(a["rest"], x["c"])).alias("rest"), F.when(ok, a["last"]).otherwise(x["k"]).alias("last"))

    folded = F.aggregate(F.slice("list", 2, 1 << 20), start, step, lambda a: F.concat(a["base"], a["rest"]))
    return d.select("list", folded.alias("text"))


def _suspects(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys..., word): the suspicious stretches of the texts, each once a row of keys."""
    d = df.select(*keys, F.col(text).alias("_t")).filter(F.col("_t").rlike(SUSPICIOUS))
    return d.select(*keys, F.explode(F.array_distinct(F.filter(F.regexp_extract_all("_t", F.lit(_STRETCH), F.lit(0)), lambda w: w.rlike(SUSPICIOUS)))).alias("word"))


def changed_words(suspects: DataFrame) -> DataFrame:
    """(word, form, n): the stretches whose consistent form is another, with the number of rows of suspects that have them."""
    words = cut(suspects.groupBy("word").agg(F.count("*").alias("n")))
    forms = consistent_words(words.select("word")).filter("word <> form")
    return forms.join(words, "word").select("word", "form", "n")


def inconsistent(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """The distinct keys of the rows whose text isn't in the consistent form. Null and empty texts are in order."""
    s = cut(_suspects(df, keys, text))
    return hot_split_join(s, cut(changed_words(s).select("word", "n")), ["word"], "n").select(*keys).distinct()


def unified(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys..., text, affected): each row's text in the consistent form; a repeated row is reported again.

    Texts of plain characters stay in place and are never shuffled; the others' stretches meet the table of changed words, and the texts are built again
    from their stretches and the blanks between them.
    """
    d = df.select(*keys, F.col(text).alias("text"))
    dirty = F.coalesce(F.col("text").rlike(SUSPICIOUS), F.lit(False))
    clean = d.filter(~dirty).select(*keys, "text", F.lit(False).alias("affected"))
    rest = cut(d.filter(dirty).withColumn("_row", F.monotonically_increasing_id()))
    forms = cut(changed_words(_suspects(rest, ["_row"], "text")))
    # Stretches, blanks of other kinds, and what stands between them follow each other.
    bits = F.regexp_extract_all("text", F.lit(_STRETCH + r"|[\s\p{Z}\u0085&&[^\t\p{Zs}]]+| +"), F.lit(0))
    p = rest.select("_row", F.posexplode(bits).alias("at", "word"))
    q = hot_split_join(p, forms, ["word"], "n", how="left")
    built = q.groupBy("_row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("form", "word").alias("w")))), lambda x: x["w"]), "").alias("text"),
        F.max(F.col("form").isNotNull()).alias("affected"),
    )
    return clean.unionByName(rest.drop("text").join(built, "_row").drop("_row").select(*keys, "text", "affected"))
