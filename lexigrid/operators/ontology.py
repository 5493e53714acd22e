"""Ontologies: generation, expansion of questions, validation, evaluation, text forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.functions import dims, text
from lexigrid.operators.graph import closure


def default_classes(spark: SparkSession) -> DataFrame:
    """(name, parent, label) of the default ontology."""
    return spark.createDataFrame(list(dims.ONTOLOGY_CLASSES), "name string, parent string, label string")


def generated_classes(entities: DataFrame, least: int = 1, examples: int = 3) -> DataFrame:
    """(name, parent, label, instances, examples): Thing and a class per entity type with `least` instances, with the first names by id."""
    e = entities.filter("type_str is not null").groupBy("type_str", "id").agg(F.min("name").alias("name"))
    n = e.groupBy("type_str").agg(F.count("*").alias("instances")).filter(F.col("instances") >= least)
    w = Window.partitionBy("type_str").orderBy("id")
    first = e.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= examples).groupBy("type_str").agg(F.array_sort(F.collect_list(F.struct("_n", "name"))).alias("x"))
    name = F.replace(F.initcap(F.replace(F.lower("type_str"), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    c = n.join(first, "type_str").select(name.alias("name"), F.lit("Thing").alias("parent"), F.col("type_str").alias("label"), "instances", F.array_join(F.transform("x", lambda r: r["name"]), "; ").alias("examples"))
    root = entities.sparkSession.createDataFrame([("Thing", None, "Thing", 0, "")], "name string, parent string, label string, instances long, examples string")
    return root.unionByName(c)


def generated_properties(relations: DataFrame, entities: DataFrame, least: int = 1) -> DataFrame:
    """(name, kind, domains, ranges, uses): an object property per relation type with the types its ends have, and three data properties."""
    t = entities.select("id", "type_str").dropDuplicates(["id"])
    d = relations.filter("relation_type is not null").join(t.select(F.col("id").alias("src"), F.col("type_str").alias("s")), "src", "left").join(t.select(F.col("id").alias("dst"), F.col("type_str").alias("o")), "dst", "left")
    # Few types, so the distinct ones are few whatever the relations.
    g = d.groupBy("relation_type", "s", "o").agg(F.count("*").alias("n")).groupBy("relation_type").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("domains"), F.array_join(F.array_sort(F.collect_set("o")), ",").alias("ranges"), F.sum("n").alias("uses")).filter(F.col("uses") >= least)
    data = relations.sparkSession.createDataFrame([(p, "data", "Thing", r, 0) for p, r in (("hasName", "xsd:string"), ("hasDescription", "xsd:string"), ("hasConfidence", "xsd:decimal"))], "name string, kind string, domains string, ranges string, uses long")
    return g.select(F.col("relation_type").alias("name"), F.lit("object").alias("kind"), "domains", "ranges", "uses").unionByName(data)


def labels(classes: DataFrame) -> DataFrame:
    """(term, name): labels and abbreviations of classes, lower case; a class's own label goes before an abbreviation."""
    spark = classes.sparkSession
    own = classes.filter("label is not null").select(F.lower("label").alias("term"), "name", F.lit(0).alias("o"))
    abbr = spark.createDataFrame([(k, v, 1) for k, v in dims.ONTOLOGY_ABBREVIATIONS.items()], "term string, name string, o int").join(classes.select("name"), "name", "left_semi").select("term", "name", "o")
    return own.unionByName(abbr).groupBy("term").agg(F.min_by("name", F.struct("o", "name")).alias("name"))


def expanded_terms(queries: DataFrame, classes: DataFrame, depth: int = 2, most: int = 10) -> DataFrame:
    """(qid, name, label, relation, rank): the classes a question names by label or abbreviation, and their parents up to `depth` below Thing, children and
    siblings; at most `most` per question, the named ones first."""
    c = classes.select("name", "parent", "label").distinct()
    l = F.broadcast(labels(classes))
    w = text.words(F.col("text"))
    grams = F.array_distinct(F.concat(text.ngrams(w, 5), text.ngrams(w, 4), text.ngrams(w, 3), text.ngrams(w, 2), w))
    named = queries.select("qid", F.explode(grams).alias("term")).join(l, "term").select("qid", "name").distinct()
    up = closure(c, "name", "parent", depth).filter("ancestor <> 'Thing'")
    parts = [
        named.select("qid", "name", F.lit(0).alias("o"), F.lit("named").alias("relation")),
        named.join(F.broadcast(up), F.col("name") == F.col("node")).select("qid", F.col("ancestor").alias("name"), F.lit(1).alias("o"), F.lit("parent").alias("relation")),
        named.join(F.broadcast(up.select(F.col("ancestor").alias("name"), "node")), "name").select("qid", F.col("node").alias("name"), F.lit(2).alias("o"), F.lit("child").alias("relation")),
        named.join(F.broadcast(c.select("name", "parent")), "name").filter("parent is not null and parent <> 'Thing'").join(F.broadcast(c.select(F.col("name").alias("other"), "parent")), "parent")
        .filter("other <> name").select("qid", F.col("other").alias("name"), F.lit(3).alias("o"), F.lit("sibling").alias("relation")),
    ]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    d = d.groupBy("qid", "name").agg(F.min(F.struct("o", "relation")).alias("x")).join(F.broadcast(c.select("name", "label")), "name")
    r = d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("x.o", "name"))).filter(F.col("rank") <= most)
    return r.select("qid", "name", "label", F.col("x.relation").alias("relation"), "rank")


def expanded_questions(queries: DataFrame, classes: DataFrame, mode: str = "children", most: int = 10, up: int = 2, down: int = 2) -> DataFrame:
    """(qid, matched, terms, expanded): a question's (qid, text) spans of three, two and one word that mean a class, longer ones first and none twice, and the labels of what
    stands near these classes: their children (mode children), parents, siblings or all; at most `most`, appended to the question where it lacks them.

    A span means the class of that label or abbreviation, else the first, in the order of the ontology, whose label is in the span or has the span in it. Parents go
    up to `up` levels, not to Thing; children down `down`. The ontology is a schema: it goes to every task. Null questions have none.
    """
    if mode not in ("children", "parents", "siblings", "all"):
        raise ValueError(f"no such mode: {mode}")
    rows = [tuple(r) for r in classes.select("name", "parent", "label").collect()]
    label = {n: x for n, _, x in rows if x}
    parent = {n: p for n, p, _ in rows}
    below: dict[str, list[str]] = {}
    for n, p, _ in rows:
        below.setdefault(p, []).append(n)
    known = {x.lower(): n for n, x in reversed(label.items())}
    meaning = {x.lower(): known[x.lower()] for x in label.values()} | {a: n for a, n in dims.ONTOLOGY_ABBREVIATIONS.items() if n in parent and a not in known}

    def near(name: str) -> list[str]:
        out = []
        if mode in ("parents", "all"):
            at = parent.get(name)
            while at and at != "Thing" and len(out) < up:
                out.append(at)
                at = parent.get(at)
        if mode in ("children", "all"):
            level = below.get(name, [])
            for _ in range(down):
                out += level
                level = [c for n in level for c in below.get(n, [])]
        if mode in ("siblings", "all") and parent.get(name):
            out += [c for c in below.get(parent[name], []) if c != name]
        return out

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for q, t in zip(f["qid"], f["text"]):
                words, taken, found = t.lower().split(), set(), []
                for n in (3, 2, 1):
                    for i in range(len(words) - n + 1):
                        if taken.isdisjoint(range(i, i + n)):
                            span = " ".join(words[i : i + n])
                            c = meaning.get(span) or next((c for x, c in meaning.items() if x in span or span in x), None)
                            if c:
                                found.append(c)
                                taken.update(range(i, i + n))
                terms = list(dict.fromkeys(label[c] for m in found for c in near(m) if c in label))[:most]
                more = [x for x in terms if x.lower() not in t.lower()]
                out.append((q, list(dict.fromkeys(found)), terms, " ".join([t, *more])))
            yield pd.DataFrame(out, columns=["qid", "matched", "terms", "expanded"])

    kind = queries.schema["qid"].dataType.simpleString()
    return queries.select("qid", "text").filter("text is not null").mapInPandas(work, f"qid {kind}, matched array<string>, terms array<string>, expanded string")


def inherited_properties(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(name, property, inherited): properties of each class and of its ancestors; properties (property, domain)."""
    own = properties.select(F.col("domain").alias("name"), "property", F.lit(False).alias("inherited"))
    up = closure(classes, "name", "parent").select("node", F.col("ancestor").alias("domain"))
    far = up.join(properties, "domain").select(F.col("node").alias("name"), "property", F.lit(True).alias("inherited"))
    return own.unionByName(far).groupBy("name", "property").agg(F.min("inherited").alias("inherited"))


def findings(classes: DataFrame, properties: DataFrame, deepest: int = 6) -> DataFrame:
    """(severity, check, subject): what is wrong with an ontology: missing parents, cycles, duplicate names and labels, unknown domains and ranges, too great
    depth, classes without label."""
    c = classes.select("name", "parent", "label")
    names = c.select("name").distinct()
    one = lambda d, sev, chk: d.select(F.lit(sev).alias("severity"), F.lit(chk).alias("check"), "subject")
    up = closure(c, "name", "parent", 50)
    ends = lambda col: properties.select("name", F.explode(F.split(col, ",")).alias("cls")).filter("cls <> '' and cls not like 'xsd:%'").join(names.withColumnRenamed("name", "cls"), "cls", "left_anti").select(F.col("name").alias("subject")).distinct()
    parts = [
        one(c.filter("parent is not null").join(names.withColumnRenamed("name", "parent"), "parent", "left_anti").select(F.col("name").alias("subject")), "error", "missing_parent"),
        one(up.filter("node = ancestor").select(F.col("node").alias("subject")).distinct(), "error", "cycle"),
        one(c.groupBy("name").count().filter("count > 1").select(F.col("name").alias("subject")), "error", "duplicate_class"),
        one(c.filter("label is not null").groupBy(F.lower("label").alias("subject")).agg(F.countDistinct("name").alias("n")).filter("n > 1"), "warning", "duplicate_label"),
        one(up.groupBy("node").agg(F.max("distance").alias("d")).filter(F.col("d") > deepest).select(F.col("node").alias("subject")), "warning", "too_deep"),
        one(c.filter("label is null or trim(label) = ''").select(F.col("name").alias("subject")), "warning", "no_label"),
        one(ends("domains"), "error", "unknown_domain"),
        one(ends("ranges"), "error", "unknown_range"),
    ]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return d.distinct()


def quality(classes: DataFrame, properties: DataFrame, entities: DataFrame, small: int = 2, large: int = 1000) -> DataFrame:
    """(check, subject, value): coverage of entity types by classes, completeness of labels, classes too small or large, and isolated ones."""
    c = classes.select("name", "parent", "label")
    e = entities.filter("type_str is not null").select("id", "type_str").distinct().groupBy("type_str").agg(F.count("*").alias("n"))
    k = F.broadcast(c.select(F.col("label").alias("type_str"), "name").distinct())
    j = e.join(k, "type_str", "left")
    total = j.agg(F.round(F.sum(F.when(F.col("name").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("value")).select(F.lit("coverage").alias("check"), F.lit("entities").alias("subject"), "value")
    label = c.agg(F.round(F.avg(F.when(F.length("label") > 0, 1.0).otherwise(0.0)), 6).alias("value")).select(F.lit("completeness").alias("check"), F.lit("labels").alias("subject"), "value")
    gran = j.filter("name is not null and (n < {0} or n > {1})".format(small, large)).select(F.when(F.col("n") < small, "too_small").otherwise("too_large").alias("check"), F.col("name").alias("subject"), F.col("n").cast("double").alias("value"))
    gaps = j.filter("name is null").select(F.lit("gap").alias("check"), F.col("type_str").alias("subject"), F.col("n").cast("double").alias("value"))
    used = properties.select(F.explode(F.split(F.concat_ws(",", "domains", "ranges"), ",")).alias("x")).distinct()
    linked = used.unionByName(c.filter("parent is not null and parent <> 'Thing'").select(F.col("parent").alias("x"))).distinct()
    lone = c.filter("name <> 'Thing'").join(linked.withColumnRenamed("x", "name"), "name", "left_anti").join(linked.withColumnRenamed("x", "label"), "label", "left_anti").select(F.lit("isolated").alias("check"), F.col("name").alias("subject"), F.lit(0.0).alias("value"))
    return total.unionByName(label).unionByName(gran).unionByName(gaps).unionByName(lone)


def answerable(questions: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(question_id, answerable, elements): whether any keyword of a competency question of more than three letters, without accents, is part of a class's or
    property's name or label."""
    el = classes.select(F.lower("name").alias("e")).union(classes.filter("label is not null").select(F.lower("label"))).union(properties.select(F.lower("name"))).distinct()
    kw = questions.select("question_id", F.explode_outer(F.filter(F.split(text.fold(F.lower("question")), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 3)).alias("w"))
    hit = kw.filter("w is not null").join(F.broadcast(el), F.contains(F.col("e"), F.col("w"))).groupBy("question_id").agg(F.countDistinct("e").alias("n"))
    return questions.select("question_id").distinct().join(hit, "question_id", "left").select("question_id", F.col("n").isNotNull().alias("answerable"), F.coalesce("n", F.lit(0)).alias("elements"))


def coverage(questions: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(dimension, value, answerable, unanswerable): competency questions (question_id, question, category, priority) the ontology can and can't answer, by category, by
    priority and in all, from one aggregation."""
    d = questions.join(answerable(questions, classes, properties), "question_id").select("answerable", F.coalesce("category", F.lit("")).alias("category"), F.coalesce(F.col("priority").cast("string"), F.lit("")).alias("priority"))
    n = lambda yes: F.sum((F.col("answerable") == yes).cast("long"))
    g = d.groupingSets([[F.col("category")], [F.col("priority")], []], "category", "priority").agg(F.grouping_id().alias("_g"), n(True).alias("answerable"), n(False).alias("unanswerable"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return g.select(F.when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "priority").otherwise("all").alias("dimension"), F.coalesce("category", "priority", F.lit("all")).alias("value"), z("answerable"), z("unanswerable"))


def trace(questions: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(question_id, kind, name): the classes and properties whose name or label a question has in it, in lower case and as it is written."""
    el = classes.select(F.lit("class").alias("kind"), "name", F.explode(F.array_compact(F.array(F.lower("name"), F.lower("label")))).alias("word")).union(properties.select(F.lit("property"), "name", F.lower("name")))
    return questions.select("question_id", F.lower("question").alias("q")).join(F.broadcast(el.filter("length(word) > 0")), F.contains(F.col("q"), F.col("word"))).select("question_id", "kind", "name").distinct()


def finding_counts(found: DataFrame, strict: bool = False) -> DataFrame:
    """One row: errors, warnings, valid; with strict a warning makes the ontology invalid too."""
    n = lambda sev: F.coalesce(F.sum((F.col("severity") == sev).cast("long")), F.lit(0))
    d = found.agg(n("error").alias("errors"), n("warning").alias("warnings"))
    return d.withColumn("valid", (F.col("errors") == 0) & ((F.col("warnings") == 0) if strict else F.lit(True)))


def suggestions(q: DataFrame) -> DataFrame:
    """(check, subject, advice) for what quality() found: a class for a gap, a parent or a merger for small classes, parts for large ones, a relation for isolated ones."""
    advice = {"gap": "add a class for this type", "too_small": "merge it with a like class or drop it", "too_large": "divide it into subclasses", "isolated": "give it a property or a subclass"}
    m = text.literal_map(advice)
    return q.select("check", "subject", F.try_element_at(m, F.col("check")).alias("advice")).filter("advice is not null")


def with_class(classes: DataFrame, name: str, parent: str | None = "Thing", label: str | None = None) -> DataFrame:
    """classes with one more; a class of that name stays as it is."""
    one = classes.sparkSession.createDataFrame([(name, parent, label)], "name string, parent string, label string")
    return extended(classes.select("name", "parent", "label"), one)


def extended(classes: DataFrame, more: DataFrame) -> DataFrame:
    """classes and those of more whose name they lack."""
    return classes.unionByName(more.dropDuplicates(["name"]).join(classes.select("name"), "name", "left_anti"), allowMissingColumns=True)


def parsed_model_output(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, properties) that a model's responses (response) say in JSON: {classes: [{name, parent, label}], properties: [{name, type, domain, range, label}]}.

    A class without parent is a Thing; of a property's domains and ranges the first counts; the data properties are added where they lack.
    """
    end = "array<string>"
    raw = responses.select(F.from_json(F.regexp_extract("response", r"(?s)(\{.*\})", 1), f"classes array<struct<name:string,parent:string,label:string>>, properties array<struct<name:string,type:string,domain:{end},range:{end},label:string>>").alias("o"))
    c = raw.select(F.explode("o.classes").alias("c")).select("c.name", F.coalesce("c.parent", F.lit("Thing")).alias("parent"), "c.label").filter("name is not null").dropDuplicates(["name"])
    p = raw.select(F.explode("o.properties").alias("p")).select("p.name", F.coalesce("p.type", F.lit("object")).alias("kind"), F.coalesce(F.get("p.domain", F.lit(0)), F.lit("Thing")).alias("domains"), F.coalesce(F.get("p.range", F.lit(0)), F.lit("Thing")).alias("ranges")).filter("name is not null").dropDuplicates(["name"])
    data = responses.sparkSession.createDataFrame([(n, "data", "Thing", r) for n, r in (("hasName", "xsd:string"), ("hasDescription", "xsd:string"), ("hasConfidence", "xsd:decimal"))], "name string, kind string, domains string, ranges string")
    return c, extended(p, data)


def turtle(classes: DataFrame, base: str = "http://example.org/ontology#", properties: DataFrame | None = None) -> DataFrame:
    """(ord, value): lines of the ontology in Turtle, prefixes first, then classes by name, then properties by name with their domains and ranges."""
    head = [f"@prefix : <{base}> .", "@prefix owl: <http://www.w3.org/2002/07/owl#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> ."]
    if properties is not None:
        head.append("@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .")
    h = classes.sparkSession.createDataFrame([(f"0{i}", v) for i, v in enumerate(head)], "ord string, value string")
    quoted = F.regexp_replace(F.regexp_replace("label", r"\\", r"\\\\\\\\"), '"', r'\\\\"')
    body = F.concat(F.lit(":"), F.col("name"), F.lit(" a owl:Class"), F.coalesce(F.concat(F.lit(" ; rdfs:subClassOf :"), F.col("parent")), F.lit("")), F.coalesce(F.concat(F.lit(' ; rdfs:label "'), quoted, F.lit('"@vi')), F.lit("")), F.lit(" ."))
    out = h.unionByName(classes.select(F.concat(F.lit("1"), F.col("name")).alias("ord"), body.alias("value")))
    if properties is None:
        return out
    local = lambda x: F.when(x.startswith("xsd:"), x).otherwise(F.concat(F.lit(":"), x))
    ends = lambda c, word: F.array_join(F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != ""), lambda x: F.concat(F.lit(f" ; rdfs:{word} "), local(x))), "")
    kind = F.when(F.col("kind") == "data", "owl:DatatypeProperty").otherwise("owl:ObjectProperty")
    line = F.concat(F.lit(":"), "name", F.lit(" a "), kind, ends(F.col("domains"), "domain"), ends(F.col("ranges"), "range"), F.lit(" ."))
    return out.unionByName(properties.select(F.concat(F.lit("2"), "name").alias("ord"), line.alias("value")))
