"""Variant spellings of names typed by people."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.history import plain
from lexigrid.llm.syllables import one_edit, valid
from lexigrid.operators.graph import connected_components
from lexigrid.operators.kg import jaro_winkler
from lexigrid.operators.skew import hot_split_join, parted_join
from lexigrid.session import cut

#: Jaro-Winkler similarity of two whole names, their syllables paired, from which one may be a slip of the other.
ALIKE = 0.9
#: Jaro-Winkler similarity from which what is no syllable may be a slip of a syllable when all others are equal.
ALIKE_SYLLABLE = 0.85
#: Pairs that one block of names with two slips may bring; of larger blocks each name is sought by another syllable too.
BLOCK_PAIRS = 100_000
#: Ids of a class that a task writes pairs for.
PART_ROWS = 2000

# Legal forms, lines of business, titles and roles, without accents; longer ones first is up to the pattern.
LEGAL_FORMS = (
    "tong cong ty", "cong ty", "trach nhiem huu han", "co phan", "tnhh", "mot thanh vien", "hai thanh vien", "doanh nghiep tu nhan", "doanh nghiep",
    "tu nhan", "hop tac xa", "lien hiep", "ngan hang", "thuong mai co phan", "tap doan", "tong cty", "h t x", "ctcp", "cty cp", "cty", "c ty", "t cong ty", "t cty",
    "tct", "cp", "mtv", "dntn", "dn", "tn", "htx", "nh", "nhtmcp", "tmcp", "jsc", "joint stock company", "joint stock", "company limited", "company",
    "corporation", "corp", "co ltd", "ltd", "limited", "inc", "llc", "plc", "group", "bank", "cooperative", "private enterprise", "enterprise", "commercial joint stock",
)
BUSINESSES = (
    "xay dung", "thuong mai", "san xuat", "du lich", "xuat nhap khau", "phat trien", "dau tu", "dich vu", "van tai", "nong san", "xd", "tm", "sx", "dl",
    "xnk", "pt", "dt", "dv", "vt", "ns", "development", "construction", "services", "service", "trading", "transport", "agri", "agriculture", "travel",
    "tourism", "investment", "manufacturing", "import export", "imp exp", "imp", "exp", "import", "export", "production", "agricultural",
)
TITLES = (
    "tong giam doc", "pho giam doc", "giam doc", "tgd", "pgd", "gd", "ke toan truong", "ktt", "luat su", "ls", "chu tich hdqt", "chu tich", "ct hdqt", "ct",
    "thanh vien hdqt", "thanh vien", "tv hdqt", "tv", "hdqt", "mr", "ms", "mrs", "miss", "dr", "prof", "thac si", "ths", "tien si", "ts", "ky su", "ks",
    "bac si", "bs", "giao su", "gs", "pgs", "nguoi dai dien", "dai dien",
)
#: Forms of address that are also syllables of names: titles only before a whole name.
ADDRESSES = ("ong", "ba", "anh", "chi", "co", "chu", "o", "b")
# The nickname table, names given by order of birth. They stand in place of the family name.
ORDER_NICKNAMES = ("hai", "ba", "tu", "nam", "sau", "bay", "tam", "chin", "muoi", "ut", "ca")
# Family names.
FAMILY_NAMES = (
    "nguyen", "tran", "le", "pham", "hoang", "huynh", "phan", "vu", "vo", "dang", "bui", "do", "ho", "ngo", "duong", "ly", "dinh", "trinh", "mai", "cao", "ta",
    "truong", "luong", "dao", "doan", "lam", "ha", "luu", "tang", "chu", "vuong",
)
#: Syllables a whole name has at least; before so many a form of address is one. Before fewer it is one where it is written with its
#: accent or a family name follows.
WHOLE_NAME = 4
#: Letters a name has at least to be sought by its letters, without regard to blanks.
LETTERS = 8
# Words that stand among aliases and name nobody, without accents.
GENERAL_WORDS = frozenset({"n a", "na", "ben a", "ben b", "ben", "a", "b", "nguoi dai dien", "null", "none", "khong ro", "khac", "cong ty", "giam doc", "doanh nghiep", "to chuc", "ca nhan", "dn", "ong", "ba"})

_WORDS = re.compile(r"[^\W_]+")
_BRANCH = re.compile(r"\b(?:(?:chi nhanh|branch|phong giao dich|van phong dai dien)(?:\s*(?:so|no))?\s*(\d+)?|(?:cn|pgd|vpdd)\s*(?:so|no)?\s*(\d+))")
_PARTS = re.compile(r"\s[-–—]\s|[()\[\];|]")
_ADDRESSED = {"ong": re.compile(r"(?<!\w)ông(?!\w)"), "ba": re.compile(r"(?<!\w)bà(?!\w)")}


def _phrases(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?<![^\s])(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + r")(?![^\s])")


_FORM_WORDS = sorted({w for p in LEGAL_FORMS + BUSINESSES for w in p.split() if len(w) > 2})
_ORG = _phrases(LEGAL_FORMS + BUSINESSES)
_TITLE = _phrases(TITLES)


def squeezed(t: str) -> str:
    """The phonetic code of a syllable: doubled letters once, one letter for a sound that is written in several ways."""
    t = re.sub(r"(.)\1+", r"\1", t)
    return re.sub(r"^ngh", "ng", re.sub(r"^gh", "g", t)).replace("y", "i") if len(t) > 1 else t


def proper(name: str, kind: str) -> tuple[str, list[str]] | None:
    """(branch, syllables of the proper name) or None where nothing proper is left.

    Legal form, line of business, title and role are taken away, wherever they stand; a branch keeps its number.
    """
    p = plain(name)
    if " ".join(_WORDS.findall(p)) in GENERAL_WORDS:
        return None
    branch, t = "", []
    # What stands on both sides of a dash or bracket isn't one phrase.
    for part in _PARTS.split(p):
        s = " ".join(_WORDS.findall(part))
        if kind == "ORGANIZATION":
            m = _BRANCH.search(s)
            if m:
                branch = "cn" + (m.group(1) or m.group(2) or "")
                s = s[: m.start()] + " " + s[m.end() :]
            t += _ORG.sub(" ", s).split()
        else:
            t += _TITLE.sub(" ", s).split()
    # A byname in another script stands beside the name.
    t = [w for w in t if w.isascii()] or t
    if kind == "ORGANIZATION":
        if len(t) > WHOLE_NAME:  # a slip in a word of a form or line of business leaves it standing
            t = [w for w in t if valid(w) or not any(one_edit(w, x) for x in _FORM_WORDS)] or t
    else:
        while len(t) > WHOLE_NAME and t[0] in ADDRESSES:
            t = t[1:]
        if 3 <= len(t) <= WHOLE_NAME and t[0] in ADDRESSES:
            spoken = _ADDRESSED.get(t[0])
            if t[1] in FAMILY_NAMES or (spoken and spoken.search(unicodedata.normalize("NFC", name).lower())):
                t = t[1:]
    return (branch, t) if t and sum(map(len, t)) > 3 else None


def slip(a: str, b: str, only: bool) -> bool:
    """If one syllable may be a slip of the other: of the same phonetic code, one edit apart, or, where nothing else differs, what is no syllable and alike.

    Where several syllables of two names differ (only is False), one of each pair must be no syllable at all.
    """
    if a == b or squeezed(a) == squeezed(b):
        return True
    whole = valid(a) and valid(b)
    return ((only or not whole) and one_edit(a, b)) or (only and not whole and jaro_winkler(a, b) >= ALIKE_SYLLABLE)


def same_name(a: list[str], b: list[str]) -> bool:
    """If two lists of syllables, of any order, differ by slips only: each syllable that differs may be one, and the whole names, their syllables paired,
    are alike by Jaro-Winkler.

    Of two syllables one is half the name: there another existing syllable is another name.
    """
    x, y = Counter(a), Counter(b)
    left, right = list((x - y).elements()), list((y - x).elements())
    if len(left) != len(right) or len(left) == len(a):
        return False
    only = len(left) == 1 and len(a) > 2
    same = sorted((x & y).elements())
    one, other = list(same), list(same)
    for s in left:
        t = max((t for t in right if slip(s, t, only)), key=lambda t: jaro_winkler(s, t), default=None)
        if t is None:
            return False
        right.remove(t)
        one.append(s)
        other.append(t)
    return jaro_winkler("".join(one), "".join(other)) >= ALIKE


def turned(letters: str) -> str:
    """The least rotation of the letters: the same for syllables that are run together in another order, from whichever the name begins."""
    return min(letters[i:] + letters[:i] for i in range(len(letters))) if letters else ""


def shortened(letters: str) -> list[str]:
    """letters and what is left without one of them: two texts one edit apart share one of these."""
    return sorted({letters} | {letters[:i] + letters[i + 1 :] for i in range(len(letters))})


def run_together(a: list[str], b: list[str]) -> bool:
    """If two names, one of them with syllables run together or parted, have the same letters but for one edit, from whichever they begin."""
    if len(a) == len(b) > 1 or (all(map(valid, a)) and all(map(valid, b))):
        return False
    s, t = "".join(a), "".join(b)
    return min(len(s), len(t)) >= LETTERS and not {turned(x) for x in shortened(s)}.isdisjoint({turned(x) for x in shortened(t)})


def forms(entities: DataFrame) -> DataFrame:
    """(id, type_str, form, joined, tokens): each name and alias of organisations and persons in canonical form: branch, bar, sorted syllables' codes; once.

    tokens keeps the syllables as written, in their order, for names that are run together.
    """

    @F.pandas_udf("struct<form:string,joined:string,tokens:string>")
    def canon(name: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for n, k in zip(name, kind):
            p = proper(n, k) if n else None
            if p is None:
                out.append((None, None, None))
            else:
                branch, t = p
                out.append((branch + "|" + " ".join(sorted(map(squeezed, t))), branch + "|" + "".join(t), branch + "|" + " ".join(t)))
        return pd.DataFrame(out, columns=["form", "joined", "tokens"])

    names = entities.filter(F.col("type_str").isin("ORGANIZATION", "PERSON_ROLE") & F.col("id").isNotNull())
    names = names.select("id", "type_str", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("n")).filter("length(trim(n)) > 0").distinct()
    return names.withColumn("f", canon("n", "type_str")).select("id", "type_str", "f.*").filter("form is not null").distinct()


#: Begins the keys of blocks for names with two slips.
WIDE = "<>"


def narrowed(spellings: list[str], key: str) -> list[str]:
    """The key with another syllable less a letter, for each syllable that it leaves out and each letter: two slips of one edit share one of these."""
    out = set()
    for s in spellings:
        branch, _, rest = s.partition("|")
        t = sorted(rest.split(), key=lambda x: (squeezed(x), x))
        n = len(t)
        for i, j in combinations(range(n), 2):
            if " ".join((WIDE, branch, str(n), *(squeezed(x) for k, x in enumerate(t) if k not in (i, j)))) == key:
                out |= {f"{key} ~ {v}" for x in (t[i], t[j]) for v in shortened(x)}
    return sorted(out)


def block_keys(spellings: list[str]) -> tuple[list[str], list[str]]:
    """(probes, targets) of a form by all its spellings (branch, bar, syllables).

    Of three syllables and more the codes of those that may be free of slips, all but one, or all but two in a key that begins with WIDE; of two the one and what is left of the other without a letter;
    of a name that is run together, or that others may run together, the letters without one, from the least rotation on.
    """
    targets, probes = set(), set()
    for s in spellings:
        branch, _, rest = s.partition("|")
        t = rest.split()
        n = len(t)
        good = [x for x in t if valid(x) and len(x) > 1]
        codes = sorted(map(squeezed, t))
        if n == 2:
            half = {" ".join((branch, "2", squeezed(x), "~", v)) for x, y in (t, t[::-1]) for v in shortened(y)}
            targets |= half
            probes |= half
        elif n > 2:
            all_but_one = {" ".join((branch, str(n), *c)) for c in combinations(codes, n - 1)}
            targets |= all_but_one | {" ".join((WIDE, branch, str(n), *c)) for c in combinations(codes, n - 2)}
            probes |= all_but_one
            if n - 2 <= len(good) < n:  # up to two syllables are no syllables: what is left of two slips
                probes |= {" ".join((WIDE, branch, str(n), *c)) for c in combinations(sorted(map(squeezed, good)), n - 2)}
        letters = "".join(t)
        if len(letters) >= LETTERS:
            keys = {" ".join((branch, "=", turned(v))) for v in shortened(letters)}
            targets |= keys
            if len(good) < n:  # one of two must hold what is no syllable
                probes |= keys
    return sorted(probes), sorted(targets)


def linked_ids(entities: DataFrame) -> DataFrame:
    """(node, component): ids of entities that mean the same organisation or person, directly or through others.

    Equal canonical forms link through one node per form, not by pairs. Spellings with slips are sought among all forms by the syllables
    that are free of slips: the phonetic codes of sorted syllables are the blocks.
    """
    f = cut(forms(entities))
    node = lambda c: F.concat_ws("\x01", F.lit("~"), "type_str", c)
    edges = f.select("id", node("form").alias("other")).union(f.select("id", node("joined").alias("other")).filter("length(other) > 14"))
    # Spellings of one form ("raap", "rap") are all kept: a slip of one of them is a slip of the form.
    distinct = cut(f.groupBy("type_str", "form").agg(F.array_sort(F.collect_set("tokens")).alias("tokens")))

    @F.pandas_udf("struct<probes:array<string>,targets:array<string>>")
    def blocks(tokens: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([block_keys(list(s)) for s in tokens], columns=["probes", "targets"])

    @F.pandas_udf("array<string>")
    def narrow(tokens: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([narrowed(list(s), k) for s, k in zip(tokens, key)], dtype=object)

    b = cut(distinct.withColumn("b", blocks("tokens", "type_str")).select("type_str", "form", "tokens", "b.*"))
    probes = b.select("type_str", "form", "tokens", F.explode("probes").alias("key"))
    keys = cut(probes.groupBy("type_str", "key").agg(F.count("*").alias("n"), F.lit(True).alias("_")))
    targets = cut(hot_split_join(b.select("type_str", "form", "tokens", F.explode("targets").alias("key")), keys, ["type_str", "key"], "n").drop("_"))
    met = targets.groupBy("type_str", "key").agg(F.count("*").alias("m")).join(keys.drop("_"), ["type_str", "key"]).withColumn("large", F.col("key").startswith(WIDE) & (F.col("m") * F.col("n") > BLOCK_PAIRS))
    met = cut(met.filter("m > 1 or n > 1"))  # of one each it is the same form
    few = {"probes": [], "targets": []}
    for name, side, count in (("probes", probes, "n"), ("targets", targets, "m")):
        d = cut(hot_split_join(side, met.select("type_str", "key", "large", F.col(count).alias("_n")), ["type_str", "key"], "_n"))
        wide = d.filter("large").withColumn("key", F.explode(narrow("tokens", "key")))
        few[name] = d.filter("not large").unionByName(wide).drop("large")
    other = few["targets"].select("type_str", "key", F.col("form").alias("form2"), F.col("tokens").alias("tokens2"))
    pairs = parted_join(few["probes"], other, ["type_str", "key"], PART_ROWS).filter("form <> form2").select("type_str", "form", "tokens", "form2", "tokens2").distinct()

    @F.pandas_udf("string")
    def judged(a: pd.Series, c: pd.Series, kind: pd.Series) -> pd.Series:
        out = []
        for x, y, k in zip(a, c, kind):
            ways = [(s.partition("|")[2].split(), t.partition("|")[2].split()) for s in x for t in y]
            if any(same_name(s, t) or run_together(s, t) for s, t in ways):
                out.append("same")
            else:
                out.append("part" if k == "PERSON_ROLE" and any(_part(s, t) for s, t in ways) else None)
        return pd.Series(out, dtype=object)

    j = cut(pairs.withColumn("how", judged("tokens", "tokens2", "type_str")).filter("how is not null"))
    same = j.filter("how = 'same'").select("type_str", "form", "form2")
    # An initial or a nickname names a person only when all whole names it fits are one.
    one = j.filter("how = 'part'").groupBy("type_str", "form").agg(F.min("form2").alias("form2"), F.max("form2").alias("most")).filter("form2 = most").select("type_str", "form", "form2")
    between = same.union(one).select(node("form").alias("id"), node("form2").alias("other"))
    return connected_components(edges.union(between), "id", "other")


def _part(a: list[str], b: list[str]) -> bool:
    """If a is b with its family name cut to the first letter, or with a name by order of birth in its place."""
    x, y = Counter(a), Counter(b)
    left, right = list((x - y).elements()), list((y - x).elements())
    if not (len(left) == 1 == len(right) and right[0] in FAMILY_NAMES and len(a) > 2):
        return False
    return left[0] == right[0][0] or (left[0] in ORDER_NICKNAMES and left[0] not in FAMILY_NAMES)


def same_entities(entities: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: each pair of ids that mean the same organisation or the same person.

    Null names and aliases, and words that name nobody, link nothing; repeated rows count once.
    """
    c = cut(linked_ids(entities).filter(~F.col("node").startswith("~")).select(F.col("node").alias("id"), "component"))
    size = cut(c.groupBy("component").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).filter("n > 1"))
    d = hot_split_join(c, size, ["component"], "n")
    # Each part of a class meets the whole class, so no class is written by one task.
    a = d.select(F.col("id").alias("id_a"), "component", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    b = d.select(F.col("id").alias("id_b"), "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["component", "part"]).filter("id_a < id_b").select("id_a", "id_b")


def classes(entities: DataFrame) -> DataFrame:
    """(id, class_id, members): each id of an organisation or person with the least id of its class and the class's size."""
    c = linked_ids(entities).filter(~F.col("node").startswith("~")).select(F.col("node").alias("id"), "component")
    size = cut(c.groupBy("component").agg(F.min("id").alias("class_id"), F.count("*").alias("n")))
    return hot_split_join(c, size.withColumn("members", F.col("n")), ["component"], "n").select("id", "class_id", "members")
