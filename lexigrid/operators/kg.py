"""The life of a knowledge graph: merging, remapping, resolving, validating, updating."""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import dims, text
from lexigrid.operators.graph import connected_components
from lexigrid.operators.skew import parted_join
from lexigrid.session import cut


def merged_entities(raw: DataFrame) -> DataFrame:
    """Extracted entities (name, type_str, description, confidence, source_id, document_id, ord) merged by slug of the name.

    The greatest confidence; the longest description, the first of equals; sorted sources, documents and names; the number of rows. Names without
    letters or digits have no slug and are left out.
    """
    d = raw.withColumn("entity_id", text.slug(F.col("name"))).filter("length(entity_id) > 0")
    length = F.coalesce(F.length("description"), F.lit(0))
    return d.groupBy("entity_id").agg(
        F.min_by("name", "ord").alias("name"),
        F.min_by("type_str", "ord").alias("type_str"),
        F.max(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("confidence"),
        F.max_by("description", F.struct(length, -F.col("ord"))).alias("description"),
        F.array_sort(F.collect_set("source_id")).alias("source_ids"),
        F.array_sort(F.collect_set("document_id")).alias("document_ids"),
        F.array_sort(F.collect_set("name")).alias("aliases"),
        F.count("*").alias("occurrence_count"),
    )


def slug_merged(entities: DataFrame) -> DataFrame:
    """Entities (id, name, type_str, confidence) merged by slug: the name of the best confidence, merge_count, the ids."""
    d = entities.withColumn("slug", text.slug(F.col("name"))).filter("length(slug) > 0")
    conf = F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(-1.0))
    return d.groupBy("slug").agg(
        F.max_by("name", F.struct(conf, "id")).alias("name"), F.max(conf).alias("confidence"), F.count("*").alias("merge_count"), F.array_sort(F.collect_set("id")).alias("ids")
    )


def merged_relations(raw: DataFrame) -> DataFrame:
    """Relations (src, predicate, dst, evidence, confidence, article_ids, ord) merged by their three keys.

    Evidence in order joined by " | ", a piece that the text already has left out; the greatest confidence; sorted articles; the number of rows.
    Distinct evidence is folded, so copies of one relation don't grow the list.
    """
    d = raw.filter("src is not null and dst is not null").withColumn("conf", F.when(~F.isnan("confidence"), F.col("confidence")))
    one = d.groupBy("src", "predicate", "dst", "evidence").agg(F.min("ord").alias("ord"), F.max("conf").alias("conf"), F.count("*").alias("n"), F.flatten(F.collect_set("article_ids")).alias("arts"))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.length("evidence") > 0, F.struct("ord", "evidence")))), lambda x: x["evidence"])
    folded = F.aggregate(ordered, F.lit(""), lambda a, e: F.when(a == "", e).when(F.contains(a, e), a).otherwise(F.concat(a, F.lit(" | "), e)))
    return one.groupBy("src", "predicate", "dst").agg(
        folded.alias("evidence"), F.max("conf").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("arts")))).alias("article_ids"), F.sum("n").alias("occurrence_count")
    )


def built(entities: DataFrame, relations: DataFrame, strict_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a graph from raw extraction: merged, without self-loops and dangling edges.

    relations name their ends by name (source, target, predicate, evidence, confidence, article_ids, ord). With strict_order an edge is dropped when an
    end is first seen after it, as an insertion in order would; by default late ends count.
    """
    e = merged_entities(entities)
    seen = entities.withColumn("entity_id", text.slug(F.col("name"))).groupBy("entity_id").agg(F.min("ord").alias("first"))
    r = relations.withColumn("src", text.slug(F.col("source"))).withColumn("dst", text.slug(F.col("target"))).filter("src <> dst")
    for end in ("src", "dst"):
        r = r.join(seen.select(F.col("entity_id").alias(end), F.col("first").alias(f"_{end}")), end)
    if strict_order:
        r = r.filter("_src <= ord and _dst <= ord")
    return e, merged_relations(r.drop("_src", "_dst"))


def remapped(relations: DataFrame, remap: DataFrame) -> DataFrame:
    """relations with both ends through remap (old_id, canonical_id); edges that become self-loops go, repeated ones merge to the best confidence."""
    m = remap.select("old_id", "canonical_id").dropDuplicates(["old_id"])
    d = relations
    for end in ("src", "dst"):
        d = d.join(m.select(F.col("old_id").alias(end), F.col("canonical_id").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return d.filter("src <> dst").groupBy("src", "dst", "relation_type").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


def jaro_winkler_column():
    """A column function: Jaro-Winkler similarity of two texts, with the bonus of up to four letters always added."""

    @F.pandas_udf("double")
    def jw(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")

    return jw


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    window = max(0, max(n, m) // 2 - 1)
    used = bytearray(m)
    left: list[str] = []
    for i, ch in enumerate(a):
        j = b.find(ch, max(0, i - window), i + window + 1)
        while j >= 0 and used[j]:
            j = b.find(ch, j + 1, i + window + 1)
        if j >= 0:
            used[j] = 1
            left.append(ch)
    k = len(left)
    if not k:
        return 0.0
    right = [ch for ch, u in zip(b, used) if u]
    half = sum(p != q for p, q in zip(left, right)) / 2
    sim = (k / n + k / m + (k - half) / k) / 3
    common = 0
    for p, q in zip(a[:4], b[:4]):
        if p != q:
            break
        common += 1
    return sim + weight * common * (1 - sim)


#: What a canonical name of a reference to the law looks like.
LEGAL_REFERENCE = r"dieu\s+\d+|khoan\s+\d+|diem\s+\w+"


# Letters of Vietnamese without marks from the most to the least common, about, and digits: of two the later is the rarer.
LETTER_ORDER = " nhigtcoaumlyvdbpksrqx0123456789efwjz_"
#: Letters of the rarest that two names must share to meet in a block.
SHARED = 3


def letter_blocks(name: str, threshold: float) -> list[str]:
    """The block keys of a name: two names at Jaro-Winkler `threshold` (above .9) or more share one, whatever letters differ and wherever they stand.

    Four letters of common beginning add at most .4 (1 - j), so Jaro's j is at least (t - .4) / .6. With all m shared letters in order it is (m/a + m/b + 1) / 3, so
    m/a + m/b is at least 3 j - 1, and the shorter name has at least 3 j - 2 of the longer one's letters. So a name of n letters shares a least number with any alike
    one. Its letters, each with how many like it stand before, are ordered from the rarest; of the first n - least + SHARED, alike names share at least SHARED:
    the combinations of so many are the keys.
    """
    j = (threshold - 1e-6 - 0.4) / 0.6
    n = len(name)
    other = (3 * j - 2) * n
    least = math.ceil((3 * j - 1) * n * other / (n + other) - 1e-9)
    seen: dict[str, int] = {}
    marks = []
    for x in sorted(name):
        k = seen[x] = seen.get(x, 0) + 1
        marks.append((-k * (LETTER_ORDER.find(x) + 1 or len(LETTER_ORDER) + 1), x, k))
    marks.sort()
    return [" ".join(c) for c in combinations([f"{x}{k}" for _, x, k in marks[: max(SHARED, n - least + SHARED)]], SHARED)]


#: Bits of a letter in a name's mask: one for each time it stands there, up to so many.
TIMES = 8
_MASKS = [f"m{i}" for i in range(-(-(len(LETTER_ORDER) + 1) * TIMES // 64))]


def letter_mask(name: str) -> list[int]:
    """The letters of a name, each as often as it stands there, as bits in longs: two names' masks differ in no more bits than their letters."""
    bits, seen = 0, {}
    for x in name:
        k = seen[x] = seen.get(x, 0) + 1
        if k <= TIMES:
            bits |= 1 << ((LETTER_ORDER.find(x) if x in LETTER_ORDER else len(LETTER_ORDER)) * TIMES + k - 1)
    words = [bits >> 64 * i & (1 << 64) - 1 for i in range(len(_MASKS))]
    return [w - (1 << 64) if w >> 63 else w for w in words]


def comparable_pairs(entities: DataFrame, threshold: float = 0.98, short: int = 15) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: pairs of canonical names that are alike by the rules of deduplication, from the threshold (above .9) on.

    Names of 15 characters or more, no references to the law, equal numbers where both have some; pairs of different types fall below any threshold above .8.
    Equal names are linked through their least id, not by pairs. The blocks are exact: see letter_blocks. What meets in a block is first compared by masks of letters,
    in the JVM, which leave out only what has too few letters in common; few pairs are compared letter by letter.
    """
    c = entities.select("id", "type_str", text.canonical(F.col("name")).alias("c")).filter("length(c) > 0").distinct()
    g = cut(c.groupBy("c", "type_str").agg(F.min("id").alias("id")))
    same = c.join(g.withColumnRenamed("id", "first"), ["c", "type_str"]).filter("id <> first").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity"))
    numbers = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("c", F.lit(r"\d+"), F.lit(0)))), " ")
    long = g.filter((F.length("c") >= short) & ~F.col("c").rlike(LEGAL_REFERENCE)).withColumn("nums", numbers).withColumn("len", F.length("c"))

    @F.pandas_udf("struct<keys:array<string>," + ",".join(f"{m}:long" for m in _MASKS) + ">")
    def blocks(names: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([letter_mask(n) for n in names], columns=_MASKS, dtype="int64")
        out.insert(0, "keys", pd.Series([letter_blocks(n, threshold) for n in names], dtype=object))
        return out

    b = long.withColumn("_b", blocks("c")).select("id", "type_str", "nums", "len", *[f"_b.{m}" for m in _MASKS], F.explode(F.array_distinct("_b.keys")).alias("key"))
    b = cut(b.withColumn("key", F.xxhash64("type_str", "key")).drop("type_str"))
    side = lambda x: b.select("key", *[F.col(v).alias(f"{v}_{x}") for v in b.columns if v != "key"])
    least = (3 * (threshold - 1e-6 - 0.4) / 0.6 - 1) * F.col("len_a") * F.col("len_b") / (F.col("len_a") + F.col("len_b"))
    differ = F.expr(" + ".join(f"bit_count({m}_a ^ {m}_b)" for m in _MASKS))
    cand = parted_join(side("a"), side("b"), ["key"], 2000).filter("id_a < id_b and (nums_a = '' or nums_b = '' or nums_a = nums_b)").filter(differ <= F.col("len_a") + F.col("len_b") - 2 * least + 1e-6)
    cand = cand.select("id_a", "id_b").distinct()
    name = lambda x: g.select(F.col("id").alias(f"id_{x}"), F.col("c").alias(f"c_{x}"), F.col("type_str").alias(f"t_{x}"))
    close = cand.join(name("a"), "id_a").join(name("b"), "id_b").filter("t_a <=> t_b and c_a <> c_b")
    close = close.withColumn("similarity", F.round(jaro_winkler_column()("c_a", "c_b"), 6)).filter(F.col("similarity") >= threshold)
    return same.unionByName(close.select("id_a", "id_b", "similarity").distinct())


def remap_of(pairs: DataFrame) -> DataFrame:
    """(old_id, canonical_id): each id of alike pairs to the least it is connected with."""
    c = connected_components(pairs, "id_a", "id_b")
    return c.filter("node <> component").select(F.col("node").alias("old_id"), F.col("component").alias("canonical_id"))


def greedy_remap(pairs: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(old_id, canonical_id) as taking entities one after the other by id gives it: an entity that is like one already kept goes over into the most alike, ties by
    id, and isn't kept itself; all others are kept.

    An entity is decided as soon as all that are like it and come before are, so a round settles every entity whose turn has come; rounds are as many as the
    longest chain of alike entities, each later than the last. pairs (id_a, id_b, similarity), id_a < id_b.
    """
    e = cut(pairs.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity")))
    every = e.select(F.col("id_a").alias("id")).union(e.select("id_b")).distinct()
    kept = cut(every.join(e.select(F.col("id_b").alias("id")), "id", "left_anti").withColumn("kept", F.lit(True)))
    n, total = kept.count(), every.count()
    for _ in range(max_rounds):
        if n == total:
            break
        ask = e.join(kept.select(F.col("id").alias("id_b")), "id_b", "left_anti").join(kept.withColumnRenamed("id", "id_a"), "id_a", "left")
        said = ask.groupBy(F.col("id_b").alias("id")).agg(F.max(F.coalesce("kept", F.lit(False))).alias("like"), F.max(F.col("kept").isNull()).alias("open"))
        now = said.filter("like or not open").select("id", (~F.col("like")).alias("kept"))
        kept = cut(kept.union(now))
        n = kept.count()
    else:
        raise RuntimeError(f"the order did not settle in {max_rounds} rounds")
    best = e.join(kept.filter("not kept").select(F.col("id").alias("id_b")), "id_b", "left_semi").join(kept.filter("kept").select(F.col("id").alias("id_a")), "id_a", "left_semi")
    return best.groupBy(F.col("id_b").alias("old_id")).agg(F.min_by("id_a", F.struct(-F.col("similarity"), "id_a")).alias("canonical_id"))


def resolved(mentions: DataFrame, abbreviations: Mapping[str, str] = dims.QUERY_ABBREVIATIONS, scope: bool = True) -> DataFrame:
    """mentions (name, type_str, document_id) with expanded, canonical, is_abbreviation and entity_id: slug of the canonical name, type and, with
    scope, the document. Variants and abbreviations of one name get one id, in any order."""
    full = text.literal_map({k.upper(): v for k, v in abbreviations.items()})
    exact = F.try_element_at(full, F.upper(F.trim("name")))
    canon = text.slug(F.coalesce(exact, text.canonical(F.col("name"), abbreviations)))
    parts = [F.lower("type_str"), canon] + ([text.document_number(F.col("document_id"))] if scope else [])
    return mentions.select("*", F.coalesce(exact, "name").alias("expanded"), exact.isNotNull().alias("is_abbreviation"), canon.alias("canonical"), F.concat_ws(":", *parts).alias("entity_id"))


def relation_type(c: Column) -> Column:
    """The type of a predicate, Vietnamese or English, with or without accents; RELATED_TO for others."""
    return F.coalesce(F.try_element_at(text.literal_map(dims.relation_type_map()), text.predicate(c)), F.lit(dims.DEFAULT_RELATION_TYPE))


def entity_type(c: Column) -> Column:
    """The type of an entity named in Vietnamese or English, with or without accents; LEGAL_TERM for others."""
    return F.coalesce(F.try_element_at(text.literal_map(dims.entity_type_map()), text.predicate(c)), F.lit(dims.DEFAULT_ENTITY_TYPE))


def vietnamese_type(c: Column) -> Column:
    """The Vietnamese name of an entity's type; null for no type."""
    return F.try_element_at(text.literal_map({v: k for k, v in dims.ENTITY_TYPES.items()}), c)


def evidence_verdict(evidence: Column, source: Column) -> Column:
    """'exact' when the source has the evidence, 'words' when it has seven tenths of its words of more than two letters, else 'none'."""
    e, s = F.lower(F.trim(evidence)), F.lower(source)
    w = F.filter(F.split(e, r"\s+"), lambda x: F.length(x) > 2)
    hit = F.size(F.filter(w, lambda x: F.contains(s, x)))
    return F.when(e.isNull() | s.isNull() | (F.length(e) == 0), "none").when(F.contains(s, e), "exact").when((F.size(w) > 0) & (hit >= 0.7 * F.size(w)), "words").otherwise("none")


def validated_relations(relations: DataFrame, entities: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Relations (relation_id, src, dst, predicate, confidence, evidence[, article_id]) that pass, with normalised predicate, known_type and
    semantic_ok; with sources (article_id, content) also the evidence: exact adds .05 to the confidence, none drops the relation.

    Self-references go; unknown predicates and combinations of types outside the rules are marked, not dropped.
    """
    types = entities.select("id", "type_str").dropDuplicates(["id"])
    d = relations.filter("src <> dst").withColumn("predicate", text.predicate(F.col("predicate")))
    d = d.join(types.select(F.col("id").alias("src"), F.col("type_str").alias("src_type")), "src", "left").join(types.select(F.col("id").alias("dst"), F.col("type_str").alias("dst_type")), "dst", "left")
    ok = F.lit(True)
    for p, (subjects, objects) in dims.PREDICATE_RULES.items():
        fits = F.coalesce(F.col("src_type").isin(*subjects), F.lit(True)) & F.coalesce(F.col("dst_type").isin(*objects), F.lit(True))
        ok = F.when(F.col("predicate") == p, fits).otherwise(ok)
    d = d.withColumn("known_type", F.col("predicate").isin(*dims.relation_type_map())).withColumn("semantic_ok", ok)
    if sources is not None:
        s = sources.select("article_id", "content").dropDuplicates(["article_id"])
        d = d.join(s, "article_id", "left").withColumn("verdict", evidence_verdict(F.col("evidence"), F.col("content"))).drop("content").filter("verdict <> 'none'")
        d = d.withColumn("confidence", F.when(F.col("verdict") == "exact", F.least(F.lit(1.0), F.col("confidence") + 0.05)).otherwise(F.col("confidence")))
    return d


def validation_counts(relations: DataFrame, validated: DataFrame) -> DataFrame:
    """One row: input, self_references, kept, unknown_types, semantic_warnings."""
    a = relations.agg(F.count("*").alias("input"), F.sum(F.coalesce((F.col("src") == F.col("dst")).cast("long"), F.lit(0))).alias("self_references"))
    b = validated.agg(F.count("*").alias("kept"), F.sum((~F.col("known_type")).cast("long")).alias("unknown_types"), F.sum((~F.col("semantic_ok")).cast("long")).alias("semantic_warnings"))
    return a.join(F.broadcast(b))


def new_types(relations: DataFrame) -> DataFrame:
    """(predicate, n): normalised predicates no type is known for."""
    return relations.select(text.predicate(F.col("predicate")).alias("predicate")).filter(~F.col("predicate").isin(*dims.relation_type_map())).groupBy("predicate").agg(F.count("*").alias("n"))


def synced_crossrefs(crossrefs: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst, relation_type) of cross-references (src_article, dst_article, ref_type) that the graph lacks."""
    to_type = text.literal_map({v: dims.RELATION_TYPES.get(k, dims.DEFAULT_RELATION_TYPE) for k, v in dims.CROSSREF_TYPES.items()})
    d = crossrefs.filter("dst_article is not null").select(F.col("src_article").alias("src"), F.col("dst_article").alias("dst"), F.coalesce(F.try_element_at(to_type, F.col("ref_type")), F.lit("RELATED_TO")).alias("relation_type"))
    return d.distinct().join(edges.select("src", "dst", "relation_type"), ["src", "dst", "relation_type"], "left_anti")


def broken_links(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, article_id): sources of entities that aren't articles."""
    return entities.select("id", F.explode("source_ids").alias("article_id")).distinct().join(articles.select(F.col("id").alias("article_id")).distinct(), "article_id", "left_anti").select("id", "article_id")


def provenance(entities: DataFrame) -> DataFrame:
    """(article_id, entities, types): how many entities each article is a source of, and their types."""
    d = entities.select("id", "type_str", F.explode("source_ids").alias("article_id")).distinct()
    return d.groupBy("article_id").agg(F.countDistinct("id").alias("entities"), F.array_join(F.array_sort(F.collect_set("type_str")), ",").alias("types"))


def updated(entities: DataFrame, relations: DataFrame, new_entities: DataFrame, new_relations: DataFrame, remap: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities added, relations added, affected articles): insert-if-absent of a delta into a graph, by id and by (src, dst, relation_type).

    The delta's relations go through remap first; those that become self-loops or that the graph has are left out.
    """
    add_e = new_entities.dropDuplicates(["id"]).join(entities.select("id"), "id", "left_anti")
    if remap is not None:
        add_e = add_e.join(remap.select(F.col("old_id").alias("id")), "id", "left_anti")
    r = remapped(new_relations, remap) if remap is not None else new_relations.filter("src <> dst").dropDuplicates(["src", "dst", "relation_type"])
    add_r = r.join(relations.select("src", "dst", "relation_type"), ["src", "dst", "relation_type"], "left_anti")
    affected = add_e.select(F.explode("source_ids").alias("article_id")).distinct()
    return add_e, add_r, affected


def update_counts(new_entities: DataFrame, new_relations: DataFrame, added_entities: DataFrame, added_relations: DataFrame, affected: DataFrame) -> DataFrame:
    """One row: entities_added, entities_merged, relations_added, relations_merged, articles_affected of an update."""
    one = lambda d, c: d.agg(F.count("*").alias(c))
    d = one(new_entities.dropDuplicates(["id"]), "e").join(one(added_entities, "entities_added")).join(one(new_relations, "r")).join(one(added_relations, "relations_added")).join(one(affected, "articles_affected"))
    return d.select("entities_added", (F.col("e") - F.col("entities_added")).alias("entities_merged"), "relations_added", (F.col("r") - F.col("relations_added")).alias("relations_merged"), "articles_affected")


def entity_contexts(entities: DataFrame, articles: DataFrame, around: int = 150) -> DataFrame:
    """(id, article_id, context): what stands around an entity's name in each of its sources, where the text has it; articles (article_id, content)."""
    d = entities.filter("length(name) > 0").select("id", "name", F.explode("source_ids").alias("article_id")).distinct().join(articles.select("article_id", "content").dropDuplicates(["article_id"]), "article_id")
    at = F.expr("locate(lower(name), lower(content))")
    start = F.greatest(F.lit(1), at - around)
    return d.filter(at > 0).select("id", "article_id", F.substr("content", start.cast("int"), (F.length("name") + at - start + around).cast("int")).alias("context"))


def conformance(entities: DataFrame, relations: DataFrame, entity_types: DataFrame, relation_types: DataFrame) -> DataFrame:
    """(kind, total, unknown, rate): entities and relations whose type the ontology lacks; rate is 1 - unknown / max(total, 1)."""
    def one(d: DataFrame, col: str, known: DataFrame, kind: str) -> DataFrame:
        k = F.broadcast(known.select(F.col("name").alias(col)).distinct().withColumn("k", F.lit(1)))
        return d.join(k, col, "left").agg(F.lit(kind).alias("kind"), F.count("*").alias("total"), F.sum(F.col("k").isNull().cast("long")).alias("unknown"))
    both = one(entities, "type_str", entity_types, "entity").unionByName(one(relations, "relation_type", relation_types, "relation"))
    u = F.coalesce("unknown", F.lit(0))
    return both.select("kind", "total", u.alias("unknown"), F.round(1 - u / F.greatest("total", F.lit(1)), 6).alias("rate"))
