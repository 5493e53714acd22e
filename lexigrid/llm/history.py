"""New batches against all history: bit-difference fingerprints in rotated block tables."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.syllables import one_edit, valid
from lexigrid.llm.unify import TWINS
from lexigrid.operators.skew import hot_split_join
from lexigrid.session import cut, shared_dir

#: Bits of a fingerprint, in longs of 64.
BITS = 256
#: Bits that may differ between records that say the same: less than a quarter. Between records that don't, about half differ.
DISTANCE = 60
#: Rotations a fingerprint is stored under, each BITS / ROTATIONS bits on; the key is the type and the leading BLOCK_BITS bits.
ROTATIONS = 8
#: Bits of a block. Records that say the same differ in about one bit of sixty, so one of ROTATIONS blocks is equal in all but about one
#: pair in two thousand; records that don't share one by chance once in half a million.
BLOCK_BITS = 24
#: Bits of a block of a text without numbers and references: only its words vote, and every slip weighs more.
BLOCK_BITS_PLAIN = 12
#: How much the numbers and references of a text weigh in its fingerprint, against all its words.
NUMBER_WEIGHT = 6.0
#: Rows of a key that are compared pair by pair; of larger keys the earliest lead.
SMALL_KEY = 64
#: Rows of a key that a task compares with all rows that lead.
PART_ROWS = 2000
#: Keys or ids up to which the tables are read by pushed-down points.
POINTS = 1000
#: Rows of a page of the tables: what a point reads at least.
PAGE_ROWS = 1000
#: Words that may be left unexplained between two descriptions that say the same, as a share of the longer.
UNEXPLAINED = 0.05

# Abbreviations of legal prose, without accents.
ABBREVIATIONS = {
    "vb": "van ban", "htx": "hop tac xa", "qsdd": "quyen su dung dat", "ubnd": "uy ban nhan dan", "hdnd": "hoi dong nhan dan",
    "dhdcd": "dai hoi dong co dong", "hdqt": "hoi dong quan tri", "hdtv": "hoi dong thanh vien", "hd": "hop dong", "th": "truong hop",
    "nld": "nguoi lao dong", "nsdld": "nguoi su dung lao dong", "ctcp": "cong ty co phan", "dn": "doanh nghiep", "dntn": "doanh nghiep tu nhan",
    "tnhh": "trach nhiem huu han", "cty": "cong ty", "gcn": "giay chung nhan", "dkkd": "dang ky kinh doanh", "bks": "ban kiem soat",
    "cqnn": "co quan nha nuoc", "gpkd": "giay phep kinh doanh", "vpdd": "van phong dai dien", "cn": "chi nhanh", "tctd": "to chuc tin dung",
}
# Words that add nothing to a description, without accents.
EMPTY_PHRASES = (
    "noi chung", "noi tren", "neu tren", "cu the", "theo do", "hien hanh", "co lien quan", "trich tu dong", "theo ban trich", "ban trich",
    "mo ta", "ban quet", "nguon ban cong bao", "nguon cong bao", "theo quy dinh", "noi rieng", "vua neu", "da neu", "tren day", "noi ro",
)
# Words that turn a statement round or take something out of it, without accents.
NEGATIONS = frozenset({"khong", "chua", "chang", "cam", "tru", "mien"})
# What a scale word multiplies a number by.
SCALES = {"nghin": 10**3, "ngan": 10**3, "trieu": 10**6, "ty": 10**9, "ti": 10**9}
_BARRED = {"đ": "d", "ð": "d", "ɖ": "d", "ı": "i"}
_TWINS = str.maketrans(TWINS)
#: A letter of another script, before decomposition.
_FOREIGN = re.compile("[\u0370-\u058f\u13a0-\u13ff]")
#: After decomposition: anything besides ASCII, combining marks and invisible characters.
_STRANGE = re.compile("[^\x00-\x7f\u0300-\u036f\u200b-\u200f\u2060\ufeff\xad]")
_TOKEN = re.compile(r"\d[\d.,]*\d|\d|[^\W\d_]+|[/%-]")
_PUNCTUATION = re.compile(r"[^\w\s/.,%-]|_|[.,](?=\s|$)")
#: Ends of sentences, after plain().
_SENTENCE = re.compile(r"[.;!?]+(?:\s+|$)")
_EMPTY = re.compile(r"\b(?:" + "|".join(p.replace(" ", " +") for p in sorted(EMPTY_PHRASES, key=len, reverse=True)) + r")\b")


def plain(text: str) -> str:
    """Lower case, without accents and marks, look-alike letters put right, one kind of blank."""
    # Twins are put right by case: the small form of a capital twin may be another letter's twin.
    s = (text.translate(_TWINS) if _FOREIGN.search(text) else text).lower()
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
        for a, b in _BARRED.items():
            s = s.replace(a, b)
        if _STRANGE.search(s):
            s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        else:
            s = s.encode("ascii", "ignore").decode("ascii")
    return " ".join(s.split())


def number_value(token: str, scale: str | None) -> str:
    """The value of a number in one way of writing: 348.900.000 and 348,9 million are the same."""
    t = token
    if re.fullmatch(r"\d{1,3}([.,]\d{3})+", t) and not (scale and t.count(".") + t.count(",") == 1):
        value = int(re.sub(r"[.,]", "", t)) * 1000
    else:
        whole, _, part = t.replace(",", ".").partition(".")
        if "." in part:  # several separators that aren't of thousands, such as a date
            return t.lstrip("0") or "0"
        value = int(whole or "0") * 1000 + int((part + "000")[:3] or "0") if len(part) <= 3 else int(float(f"{whole}.{part}") * 1000)
    if scale:
        value *= SCALES[scale]
    return str(value // 1000) if value % 1000 == 0 else f"{value / 1000:g}"


class Said:
    """What a description says: its numbers, the codes of references, and the words of its sentences, of which the order doesn't count."""

    __slots__ = ("numbers", "refs", "sentences", "words")

    def __init__(self, text: str):
        self.numbers, self.refs, self.words, self.sentences = [], [], [], []
        for line in _EMPTY.sub(" ", _PUNCTUATION.sub(" ", _SENTENCE.sub("\n", plain(text)))).split("\n"):
            tokens = _TOKEN.findall(line)
            if not tokens:
                continue
            words = self._read(tokens)
            if words:
                self.sentences.append(" ".join(words))
        self.numbers.sort()
        self.refs.sort()
        self.sentences.sort()

    def _read(self, tokens: list[str]) -> list[str]:
        """The words of a sentence and, after #, its numbers and codes; all are kept."""
        out, plain_words = [], self.words
        i, n = 0, len(tokens)
        while i < n:
            t = tokens[i]
            i += 1
            if t.isalpha():
                full = ABBREVIATIONS.get(t)
                if full is None:
                    out.append(t)
                    plain_words.append(t)
                else:
                    out += full.split()
                    plain_words += full.split()
            elif t[0].isdigit():
                # A reference goes on over slashes and hyphens: 3071/2005/TT-NHNN.
                code = []
                while i + 1 < n and tokens[i] in "/-" and tokens[i + 1][0].isalnum():
                    code.append(tokens[i + 1])
                    i += 2
                if code:
                    numbers = [str(int(c)) if c.isdigit() else number_value(c, None) for c in (t, *code) if c[0].isdigit()]
                    refs = [c for c in code if not c[0].isdigit()]
                    self.refs += refs
                else:
                    scale = tokens[i] if i < n and tokens[i] in SCALES else None
                    numbers, refs = [number_value(t, scale)], []
                    i += scale is not None
                self.numbers += numbers
                out += ["#" + x for x in numbers + refs]
        return out


_VOTES: dict[str, np.ndarray] = {}


def _votes(token: str) -> np.ndarray:
    """The token's votes, 1 and -1, for each bit."""
    v = _VOTES.get(token)
    if v is None:
        digest = hashlib.blake2b(token.encode(), digest_size=BITS // 8).digest()
        v = np.unpackbits(np.frombuffer(digest, dtype=np.uint8)).astype(np.float32) * 2 - 1
        if len(_VOTES) < 50_000:
            _VOTES[token] = v
    return v


def fingerprints(said: list[Said]) -> np.ndarray:
    """A row of BITS / 64 longs for each text: the bits that the votes of its words, numbers and references agree on.

    The words of all texts share one matrix of votes; numbers and references weigh NUMBER_WEIGHT times the words in all, since another
    number makes another record.
    """
    names: dict[str, int] = {}
    column, weight, length = [], [], []
    for d in said:
        exact = ["#" + n for n in d.numbers] + ["@" + r for r in d.refs]
        column += [names.setdefault(t, len(names)) for t in d.words] + [names.setdefault(t, len(names)) for t in exact]
        weight += [1.0] * len(d.words)
        if exact:
            weight += [(NUMBER_WEIGHT * max(1, len(d.words)) / len(exact)) ** 0.5] * len(exact)
        length.append(len(d.words) + len(exact))
    if not column:
        return np.zeros((len(said), BITS // 64), dtype=np.int64)
    table = np.stack([_votes(t) for t in names])
    column, weight = np.array(column), np.array(weight, dtype=np.float32)
    out = np.zeros((len(said), BITS), dtype=bool)
    at = 0
    for k, n in enumerate(length):
        if n:
            out[k] = weight[at : at + n] @ table[column[at : at + n]] > 0
            at += n
    return np.packbits(out, axis=1).view(">i8").astype(np.int64)


_PRINT = [f"p{k}" for k in range(BITS // 64)]


def signed(records: DataFrame, text: str = "description") -> DataFrame:
    """records with sig (numbers and references' letters, which must be equal), canon (its sentences, sorted, one a line) and p0 to p3 (its
    fingerprint); all null where the text is null or says nothing."""

    @F.pandas_udf("struct<sig:string,canon:string," + ",".join(f"{p}:long" for p in _PRINT) + ">")
    def sign(s: pd.Series) -> pd.DataFrame:
        said = [Said(t) if t else None for t in s]
        said = [d if d is not None and (d.words or d.numbers) else None for d in said]
        prints = fingerprints([d for d in said if d is not None])
        out = pd.DataFrame({"sig": [None if d is None else " ".join(d.numbers) + "|" + " ".join(d.refs) for d in said], "canon": [None if d is None else "\n".join(d.sentences) for d in said]}, dtype=object)
        some = np.array([d is not None for d in said], dtype=bool)
        for k, p in enumerate(_PRINT):
            v = np.zeros(len(said), dtype=np.int64)
            v[some] = prints[:, k]
            out[p] = v
        return out

    return records.withColumn("_s", sign(F.col(text))).select(*records.columns, "_s.*")


def _pairs_in_a_row(sentences: list[list[str]]) -> Counter:
    return Counter(p for s in sentences for p in zip(s, s[1:]))


def says_the_same(a: str, b: str) -> bool:
    """If two canonical texts differ at most by slips, abbreviations and a small rest without a negation, and their words stand in the same order
    within their sentences."""
    if a == b:
        return True
    x_s, y_s = [s.split() for s in a.split("\n")], [s.split() for s in b.split("\n")]
    x, y = Counter(w for s in x_s for w in s), Counter(w for s in y_s for w in s)
    only_a, only_b = list((x - y).elements()), list((y - x).elements())
    edited_a, edited_b = set(only_a), set(only_b)
    extra_a, extra_b = len(only_a), len(only_b)
    most = max(sum(x.values()), sum(y.values()))
    for w in list(only_a):
        for v in only_b:
            if one_edit(w, v) and not ((w == "khong" and valid(v)) or (v == "khong" and valid(w))):  # chưa looks like chứa here
                only_a.remove(w)
                only_b.remove(v)
                break
    for one, two in ((only_a, only_b), (only_b, only_a)):
        for w in list(one):  # a blank too many parts a word
            cut_ = next(((u, v) for u in two for v in two if u is not v and u + v == w), None)
            if cut_:
                one.remove(w)
                two.remove(cut_[0])
                two.remove(cut_[1])
    for short, long in ((only_a, only_b), (only_b, only_a)):
        for w in list(short):  # an abbreviation stands for words that begin with its letters
            if 2 <= len(w) <= 6:
                rest = list(long)
                taken = []
                for c in w:
                    v = next((v for v in rest if v[0] == c), None)
                    if v is None:
                        break
                    rest.remove(v)
                    taken.append(v)
                else:
                    short.remove(w)
                    for v in taken:
                        long.remove(v)
    if NEGATIONS.intersection(only_a + only_b) or len(only_a) + len(only_b) > max(1, UNEXPLAINED * most):
        return False
    # Words that are in both texts must follow each other alike, but for the places where a word of the other text stands between.
    p, q = _pairs_in_a_row(x_s), _pairs_in_a_row(y_s)
    lost_a = sum(n for (u, v), n in (p - q).items() if u not in edited_a and v not in edited_a)
    lost_b = sum(n for (u, v), n in (q - p).items() if u not in edited_b and v not in edited_b)
    # A word that stands between cuts one pair, one that only one text ends or begins a sentence with joins one.
    return lost_a <= 2 * extra_b and lost_b <= 2 * extra_a


def block_table(classes: DataFrame) -> DataFrame:
    """The rotated block tables: (key, id) for each rotation of a class's fingerprint, and one for its whole text.

    key hashes the type, the rotation and the leading bits; the text's key hashes its class.
    """
    digits = F.concat(*[F.lpad(F.hex(p), 16, "0") for p in _PRINT])
    ring = F.concat(digits, F.substring(digits, 1, BLOCK_BITS // 4))
    step = BITS // ROTATIONS // 4
    size = F.when(F.col("sig") == "|", BLOCK_BITS_PLAIN // 4).otherwise(BLOCK_BITS // 4)
    d = classes.select("id", "type_str", "ck", ring.alias("ring"), size.alias("size"), F.explode(F.sequence(F.lit(-1), F.lit(ROTATIONS - 1))).alias("rotation"))
    leading = F.substr("ring", F.col("rotation") * step + 1, "size")
    return d.select(F.when(F.col("rotation") < 0, F.xxhash64("ck")).otherwise(F.xxhash64("type_str", "rotation", leading)).alias("key"), "id")


def _other(d: DataFrame) -> DataFrame:
    return d.select(*[F.col(c).alias(c + "2") for c in d.columns])


_NEAR = " + ".join(f"bit_count({p} ^ {p}2)" for p in _PRINT) + f" <= {DISTANCE}"
_FACTS = ["id", "type_str", "sig", *_PRINT]


def verified_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (id, other), those of one type and signature within the Hamming distance whose texts say the same."""

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([says_the_same(x, y) for x, y in zip(a, b)], dtype=bool)

    x = classes.select(*_FACTS, "canon")
    p = pairs.join(x, "id").join(_other(x).withColumnRenamed("id2", "other"), "other").filter(f"type_str = type_str2 and sig = sig2 and {_NEAR}")
    return p.filter(same("canon", "canon2")).select("id", "other")


def links(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, other), other < id: links by which every new class is joined to all classes of its keys that say the same, directly or through earlier ones.

    rows (key, id, new, leads) are the keys' classes; classes that are not new are linked among themselves already, and lead where nothing
    earlier said the same. Keys of up to SMALL_KEY rows are compared pair by pair. Of larger ones, in rounds, the earliest unsettled rows
    lead: one, then four, sixteen and so on; the new rows that say the same as a leader are settled by it. So a key under which a third of all rows say
    the same takes one comparison a row. To say the same doesn't carry over, so rows that different leaders have settled are compared last.
    """
    rows = cut(rows)
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("new").alias("any")).filter("n > 1 and any").select("key", "n")
    keys = cut(keys)
    of = hot_split_join(rows, keys.withColumn("rows", F.col("n")), ["key"], "n")
    x = _with_facts(of.filter(F.col("rows") <= SMALL_KEY), classes)
    new = F.col("new") & ((F.col("id") > F.col("id2")) | ~F.col("new2"))
    near = x.join(_other(x).withColumnRenamed("key2", "key"), "key").filter(new & F.expr(f"id <> id2 and type_str = type_str2 and sig = sig2 and {_NEAR}"))
    found = [verified_pairs(_ordered(near.select("id", F.col("id2").alias("other"))), classes)]
    large = cut(of.filter(F.col("rows") > SMALL_KEY).drop("rows"))
    if not large.isEmpty():
        found += _links_of_large(classes, large)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return cut(out.distinct())


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other")).distinct()


def _with_facts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes.select(*_FACTS), "id")


def _parted(x: DataFrame, y: DataFrame) -> DataFrame:
    """x with y by key, y's columns under other names; y is dealt out in parts of about PART_ROWS rows, x's rows meet every part of their key."""
    parts = y.groupBy("key").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"), F.count("*").alias("_n"))
    counted = x.groupBy("key").agg(F.count("*").alias("_n"))
    spread = hot_split_join(x, parts.drop("_n").join(counted, "key"), ["key"], "_n")
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = y.join(parts.drop("_n"), "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    return spread.join(_other(dealt).withColumnRenamed("key2", "key").withColumnRenamed("part2", "part"), ["key", "part"])


def _links_of_large(classes: DataFrame, large: DataFrame) -> list[DataFrame]:
    """links within large keys."""
    open_ = cut(_with_facts(large, classes).withColumn("settled", ~F.col("new") & ~F.col("leads")).withColumn("group", F.when(F.col("settled"), F.lit(None)).cast("long")))
    found, most = [], 1
    while not open_.filter("new and not settled").isEmpty():
        w = Window.partitionBy("key").orderBy("id")
        lead = cut(open_.filter("not settled").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r", "settled", "group"))
        asked = open_.filter("new and not settled").drop("settled", "group")
        near = _parted(asked, lead).filter("id > id2 and type_str = type_str2 and sig = sig2 and " + _NEAR)
        good = cut(verified_pairs(near.select("id", F.col("id2").alias("other")).distinct(), classes))
        found.append(good)
        by = cut(good.groupBy("id").agg(F.min("other").alias("_g"), F.count("*").alias("_n")))
        back = open_.join(by.drop("_n"), "id", "left").join(lead.select("key", "id", F.lit(True).alias("_lead")), ["key", "id"], "left")
        open_ = cut(
            back.withColumn("group", F.coalesce("group", "_g", F.when(F.col("_lead"), F.col("id")))).withColumn("settled", F.col("settled") | F.col("_g").isNotNull() | F.col("_lead").isNotNull()).drop("_g", "_lead")
        )
        most *= 4
    # Rows of one group meet in their leader; only those outside the key's largest group are compared with the others.
    g = open_.withColumn("group", F.coalesce("group", "id"))
    size = g.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("largest"), F.count("*").alias("groups"), F.sum("n").alias("n")).filter("groups > 1")
    g = cut(hot_split_join(g, cut(size.drop("groups")), ["key"], "n"))
    minor = _parted(g, g.filter("group <> largest"))
    near = minor.filter("group <> group2 and id <> id2 and (new or new2) and type_str = type_str2 and sig = sig2 and " + _NEAR)
    found.append(verified_pairs(_ordered(near.select("id", F.col("id2").alias("other"))), classes))
    return found


def classes_of(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): records (record_id, batch_no, ck) that say something, and one row per different text: (id, ck, type_str, sig, canon, p0 to p3, n);
    id is its first record."""
    s = records.filter("record_id is not null and description is not null").select("record_id", "batch_no", F.coalesce("type_str", F.lit("")).alias("type_str"), "description")
    s = signed(s).filter("canon is not null").drop("description").withColumn("ck", F.md5(F.concat_ws("\x01", "type_str", "sig", "canon")))
    s = cut(s)
    facts = [F.first(c).alias(c) for c in ("type_str", "sig", "canon", *_PRINT)]
    classes = s.groupBy("ck").agg(F.min("record_id").alias("id"), *facts, F.count("*").alias("n"))
    return s.select("record_id", "batch_no", "ck"), cut(classes)


def roots_over_time(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, since, root): the least node that each node is connected with, and since when, a row for each change.

    nodes (node, since) are there from then on; edges (a, b, since). Labels go along the edges, each with the time from which the way is open; of a node's labels
    those that are less than all before are kept, until no label changes. Nodes with very many edges are met by broadcast.
    """
    e = edges.select("a", "b", "since").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "since"))
    e = cut(e.groupBy("a", "b").agg(F.min("since").alias("open")))
    degree = cut(e.groupBy("a").agg(F.count("*").alias("n")))
    linked = degree.select(F.col("a").alias("node"))
    label = cut(nodes.join(linked, "node", "left_semi").select("node", "since", F.col("node").alias("root")))
    before = None
    earlier = Window.partitionBy("node").orderBy("since", "root").rowsBetween(Window.unboundedPreceding, -1)
    fresh = label
    while True:
        lists = fresh.groupBy("node").agg(F.collect_list(F.struct("since", "root")).alias("l"))
        sent = hot_split_join(e, lists.join(degree.withColumnRenamed("a", "node"), "node").withColumnRenamed("node", "a"), ["a"], "n")
        moved = sent.select(F.col("b").alias("node"), "open", F.explode("l").alias("x")).filter("x.root < node").select("node", F.greatest("open", "x.since").alias("since"), "x.root")
        moved = moved.groupBy("node", "root").agg(F.min("since").alias("since")).select("node", "since", "root")
        every = label.withColumn("_o", F.lit(0)).union(moved.withColumn("_o", F.lit(1)))
        least = every.withColumn("_m", F.min("root").over(earlier)).filter("_m is null or root < _m").drop("_m")
        every = cut(least.groupBy("node", "since", "root").agg(F.min("_o").alias("_o")))
        label, fresh = every.drop("_o"), every.filter("_o = 1").drop("_o")
        now = fresh.isEmpty()
        if now:
            return label


def _settled(members: DataFrame, known: DataFrame, fresh: DataFrame, found: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, labels): the members that say the same as an earlier record, with the first, and roots_over_time of the new classes and old roots.

    known (ck, root, n) are the members' texts that history holds, fresh (ck, id, n) the others; found the links; touched (id, root) the classes of history.
    """
    t = touched.select("id", "root")
    new = fresh.select(F.col("id").alias("node"), F.col("id").alias("since"))
    # A class of history stands for its root; the link is open from the new class on.
    e = found.join(t.select(F.col("id").alias("other"), "root"), "other", "left").select(F.col("id").alias("a"), F.coalesce("root", "other").alias("b"), F.col("id").alias("since"))
    labels = roots_over_time(new.union(t.select(F.col("root").alias("node"), F.lit(-(2**62)).alias("since")).distinct()), e)
    lists = labels.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("since", "root"))).alias("l"))
    texts = fresh.select("ck", F.col("id").alias("node"), "n").union(known.select("ck", F.col("root").alias("node"), "n"))
    texts = cut(texts.join(lists, "node", "left"))
    m = hot_split_join(members, texts, ["ck"], "n")
    at = F.element_at(F.filter("l", lambda x: x["since"] <= F.col("record_id")), -1)["root"]
    first = F.when(F.col("l").isNull() | (F.size(F.filter("l", lambda x: x["since"] <= F.col("record_id"))) == 0), F.col("node")).otherwise(at)
    merged = m.select("record_id", "batch_no", first.alias("first_record_id")).filter("record_id > first_record_id").distinct()
    return cut(merged), labels


def merged_with(records: DataFrame) -> DataFrame:
    """(record_id, batch_no, first_record_id): each record that says the same as an earlier one of its type, with the earliest that it or, of the
    records before it, one that says the same leads to.

    Descriptions that are null or say nothing are the same as none. Null types are a type. Repeated rows count once. All in one pass; the same result
    comes from a FingerprintStore that takes the records in any number of parts.
    """
    members, classes = classes_of(records)
    rows = block_table(classes).select("key", "id", F.lit(True).alias("new"), F.lit(False).alias("leads"))
    nothing = classes.limit(0)
    return _settled(members, nothing.select("ck", F.col("id").alias("root"), "n"), classes, links(classes, rows), nothing.select("id", F.col("id").alias("root")))[0]


def batch_counts(records: DataFrame, merged: DataFrame) -> DataFrame:
    """(batch_no, entities_added, entities_merged): for every batch the counts its UpdateResult should hold.

    A record is merged when it says the same as an earlier one, in history or in its own batch, and added otherwise.
    """
    every = records.filter("record_id is not null").select("batch_no", "record_id").distinct()
    d = every.join(merged.select("record_id", F.lit(1).alias("m")), "record_id", "left")
    return d.groupBy("batch_no").agg(F.sum(F.when(F.col("m").isNull(), 1).otherwise(0)).alias("entities_added"), F.sum(F.coalesce("m", F.lit(0))).alias("entities_merged"))


_CLASS = "id long, ck string, type_str string, sig string, canon string, " + ", ".join(f"{p} long" for p in _PRINT) + ", root long"
_TABLES = {"blocks": "key long, id long", "classes": _CLASS, "joins": "root long, into long, version int"}


class FingerprintStore:
    """The fingerprints of everything accepted, in rotated block tables on shared storage, to check batches against one after the other.

    A batch is signed, its block keys are looked up in the tables, which are written in the order of the keys, candidates are verified, and the new
    classes are appended. History's texts are never signed again, and only those that share a block with the batch are read. Where a new record
    joins two classes that were apart, the later root is written as going over into the earlier one, and so for records to come.
    Each update is a folder of its own, which counts from the moment its manifest is there: one atomic rename. What a failed update left is overwritten.
    Records must come in the order of their ids.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The folders that count, in order, as the last manifest lists them."""
        log = self._path(f"{self.path}/log")
        if not self._fs.exists(log):
            return []
        last = max((s.getPath().getName() for s in self._fs.listStatus(log) if s.getPath().getName().isdigit()), default=None)
        if last is None:
            return []
        return [int(r[0]) for r in self.spark.read.text(f"{self.path}/log/{last}").collect()]

    def _commit(self, version: int, live: list[int]) -> None:
        there, final = self._path(f"{self.path}/log/.{version}-{uuid.uuid4().hex}"), self._path(f"{self.path}/log/{version:09d}")
        out = self._fs.create(there, True)
        out.write(bytearray("\n".join(map(str, live)).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(there, final):
            raise RuntimeError(f"version {version} of {self.path} was committed by another update")

    def _table(self, name: str, live: list[int]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(*[f"{self.path}/v{v:09d}/{name}" for v in live])

    def _write(self, d: DataFrame, name: str, version: int, by: str, rows: int) -> None:
        # Small row groups and pages in the order of `by`, so that a point reads little, whatever the size of history.
        d = d.repartitionByRange(max(1, rows // 2_000_000), by).sortWithinPartitions(by)
        d.write.mode("overwrite").option("parquet.block.size", str(1 << 20)).option("parquet.page.row.count.limit", str(PAGE_ROWS)).parquet(f"{self.path}/v{version:09d}/{name}")

    def _at(self, table: DataFrame, column: str, points: DataFrame) -> DataFrame:
        """The table's rows at the points: of a few by pushed-down values, so that only row groups that may hold them are read, of many by a join."""
        few = [r[0] for r in points.limit(POINTS + 1).collect()]
        if len(few) > POINTS:
            return cut(table.join(points, column, "left_semi"))
        setting = "spark.sql.parquet.pushdown.inFilterThreshold"
        old = self.spark.conf.get(setting)
        self.spark.conf.set(setting, str(POINTS))
        try:
            return cut(table.filter(F.col(column).isin(few)))
        finally:
            self.spark.conf.set(setting, old)

    def update(self, batch: DataFrame) -> DataFrame:
        """(record_id, batch_no, first_record_id) of the records that say the same as an earlier one; the new classes are appended.

        batch may hold several batches at once: the result for a record depends on the records before it only.
        """
        live = self.versions()
        version = (live[-1] if live else 0) + 1
        members, classes = classes_of(batch)
        blocks = cut(block_table(classes))
        near = self._at(self._table("blocks", live), "key", blocks.select("key").distinct())
        touched = self._at(self._table("classes", live), "id", near.select("id").distinct())
        joins = self._table("joins", live)
        into = joins.groupBy("root").agg(F.max_by("into", "version").alias("into"))
        led = touched.withColumn("leads", F.col("id") == F.col("root"))
        touched = cut(led.join(into, "root", "left").withColumn("root", F.coalesce("into", "root")).drop("into"))
        known = classes.select("ck", "n").join(touched.select("ck", "root"), "ck")
        fresh = cut(classes.join(touched.select("ck"), "ck", "left_anti"))
        both = fresh.drop("n").unionByName(touched.drop("root", "leads"))
        rows = blocks.join(fresh.select("id"), "id", "left_semi").select("key", "id", F.lit(True).alias("new"), F.lit(False).alias("leads"))
        rows = rows.union(near.join(touched.select("id", "leads"), "id").select("key", "id", F.lit(False), "leads"))
        merged, labels = _settled(members, known, fresh, links(both, rows), touched)
        last = cut(labels.groupBy("node").agg(F.min("root").alias("last")))
        gone = last.join(touched.select(F.col("root").alias("node")).distinct(), "node", "left_semi").filter("node <> last")
        # What went over into a root that goes over itself goes to the same place.
        further = into.join(gone, F.col("into") == F.col("node")).select("root", F.col("last").alias("into"))
        moved = cut(gone.select(F.col("node").alias("root"), F.col("last").alias("into")).union(further))
        kept = fresh.join(last.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("last", "id")).select(*[c.split()[0] for c in _CLASS.split(", ")])
        n = fresh.count()
        self._write(kept, "classes", version, "id", n)
        self._write(blocks.join(fresh.select("id"), "id", "left_semi"), "blocks", version, "key", n * (ROTATIONS + 1))
        self._write(moved.withColumn("version", F.lit(version)), "joins", version, "root", 1)
        self._commit(version, [*live, version])
        return merged

    def compact(self) -> None:
        """All folders in one: the block tables in one order of keys again. The old folders don't count any more."""
        live = self.versions()
        if len(live) < 2:
            return
        version = live[-1] + 1
        classes, blocks, joins = (self._table(t, live) for t in ("classes", "blocks", "joins"))
        self._write(classes, "classes", version, "id", classes.count())
        self._write(blocks, "blocks", version, "key", blocks.count())
        self._write(joins.groupBy("root").agg(F.max_by("into", "version").alias("into")).withColumn("version", F.lit(version)), "joins", version, "root", 1)
        self._commit(version, [version])


def rounds(records: DataFrame) -> Iterator[list]:
    """Batch numbers in the order of arrival: the first alone, then as many together as there are records accepted, so that rounds are few."""
    sizes = records.filter("record_id is not null").groupBy("batch_no").agg(F.min("record_id").alias("at"), F.count("*").alias("n")).orderBy("at").select("batch_no", "n").collect()
    accepted, group, waiting = 0, [], 0
    for r in sizes:
        group.append(r["batch_no"])
        waiting += r["n"]
        if waiting >= accepted or not accepted:
            yield group
            accepted, group, waiting = accepted + waiting, [], 0
    if group:
        yield group


def against_history(records: DataFrame, path: str | None = None) -> DataFrame:
    """merged_with, batches after batches against a FingerprintStore: history is signed once, and each batch meets it by the block tables.

    The store is at path, by default in a new folder of the shared one, removed in the end. Batches must be a table of runs, not of data: their numbers are read
    to the driver, to take them in order. Null batch numbers are a batch.
    """
    spark = records.sparkSession
    there = path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
    store, found = FingerprintStore(spark, there), None
    for group in rounds(records):
        some = [b for b in group if b is not None]
        mine = F.col("batch_no").isin(some) if some else F.lit(False)
        if len(some) < len(group):
            mine = mine | F.col("batch_no").isNull()
        one = store.update(records.filter(F.coalesce(mine, F.lit(False))))
        found = one if found is None else found.union(one)
    if path is None:
        store._fs.delete(store._path(there), True)
    if found is None:
        return spark.createDataFrame([], "record_id long, batch_no int, first_record_id long")
    return found
