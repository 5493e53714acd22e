"""Sources and sinks: graph, forest, summary and benchmark files, caches, checkpoints, configuration."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import text

ENTITY = "id string, name string, text string, type string, label string, entity_type string, description string, confidence double, metadata struct<source_ids:array<string>,document_ids:array<string>,aliases:array<string>,occurrence_count:int,source_id:string>"
RELATION = "source string, target string, source_id string, target_id string, head string, tail string, type string, predicate string, relation_type string, evidence string, confidence double, metadata struct<article_ids:array<string>,occurrence_count:int>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a graph file {entities: [...], relations or relationships: [...]}, whichever names its fields bear."""
    raw = spark.read.schema(f"entities array<struct<{_colons(ENTITY)}>>, relations array<struct<{_colons(RELATION)}>>, relationships array<struct<{_colons(RELATION)}>>").json(path, multiLine=True)
    e = raw.select(F.explode("entities").alias("e")).select("e.*")
    entities = e.select(
        F.coalesce("id", text.slug(F.coalesce("name", "text"))).alias("id"), F.coalesce("name", "text").alias("name"), F.coalesce("type", "label", "entity_type").alias("type_str"), "description", "confidence",
        F.coalesce("metadata.source_ids", F.when(F.col("metadata.source_id").isNotNull(), F.array("metadata.source_id"))).alias("source_ids"), F.col("metadata.document_ids").alias("document_ids"), F.col("metadata.aliases").alias("aliases"),
        F.col("metadata.occurrence_count").alias("occurrence_count"),
    )
    r = raw.select(F.explode(F.concat(F.coalesce("relations", F.array().cast(raw.schema["relations"].dataType)), F.coalesce("relationships", F.array().cast(raw.schema["relations"].dataType)))).alias("r")).select("r.*").distinct()
    relations = r.select(
        F.coalesce("source", "source_id", "head").alias("src"), F.coalesce("target", "target_id", "tail").alias("dst"), F.coalesce("relation_type", "type", "predicate").alias("relation_type"), F.coalesce("predicate", "relation_type", "type").alias("predicate"),
        "evidence", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.col("metadata.article_ids").alias("article_ids"), F.col("metadata.occurrence_count").alias("occurrence_count"),
    )
    return entities, relations


def _colons(schema: str) -> str:
    """name:type of a DDL schema's top level."""
    out, depth = [], 0
    for token in schema.split(", "):
        out.append(token.replace(" ", ":", 1))
        depth += token.count("<") - token.count(">")
    return ",".join(out)


def write_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """The graph as two tables under path, by Spark's atomic commit."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    relations.write.mode("overwrite").parquet(f"{path}/relations")


def read_summaries(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, keywords, description) of summaries as a list under "summaries", or as one object by id."""
    lines = spark.read.text(path, wholetext=True)
    item = f"struct<{key}:string,keywords:array<string>,description:string>"
    as_list = lines.select(F.explode(F.from_json("value", f"struct<summaries:array<{item}>>")["summaries"]).alias("s")).select(f"s.{key}", "s.keywords", "s.description")
    as_map = lines.filter(F.get_json_object("value", "$.summaries").isNull()).select(F.explode(F.from_json("value", f"map<string,{item}>")).alias("k", "s")).select(F.coalesce(f"s.{key}", "k").alias(key), "s.keywords", "s.description")
    return as_list.unionByName(as_map)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, category, answer, article_ids, expected): questions of either header dialect; a byte order mark is ignored. expected are the article numbers."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    d = d.toDF(*[c.lstrip("﻿").strip() for c in d.columns])
    pick = lambda *names: next((F.col(f"`{n}`") for n in names if n in d.columns), F.lit(None).cast("string"))
    ids = F.filter(F.split(F.coalesce(pick("Article_IDs", "article_ids"), F.lit("")), r"\s*;\s*"), lambda x: x != "")
    numbers = F.array_sort(F.array_distinct(F.array_compact(F.transform(ids, text.article_number))))
    return d.select(pick("STT", "qid").alias("qid"), pick("Content", "question").alias("question"), pick("Category", "category").alias("category"), pick("Câu trả lời", "answer").alias("answer"), ids.alias("article_ids"), numbers.alias("expected"))


def write_forest(nodes: DataFrame, crossrefs: DataFrame, path: str) -> None:
    """Trees as flat nodes with paths, and cross-references, as JSON lines."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    crossrefs.write.mode("overwrite").json(f"{path}/cross_refs")


def read_forest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    n = spark.read.schema("node_id string, node_type string, parent_id string, document_id string, path array<string>, ord int, title string, depth int").json(f"{path}/nodes")
    return n, spark.read.json(f"{path}/cross_refs")


def unprocessed(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of work whose key isn't done: what a resumed run has left."""
    return work.join(done.select(key).distinct(), key, "left_anti")


class Checkpointed:
    """Results under path, appended by every run; a run works on what is left."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def results(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def run(self, work: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        have = self.results()
        step(work if have is None else unprocessed(work, have, self.key)).write.mode("append").parquet(self.path)
        return self.spark.read.parquet(self.path)


def cache_key(prompt):
    return text.hash_id(prompt, 64)


def cached_answers(prompts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, missing): prompts (prompt) with the cache's response by SHA-256, and those without, each once."""
    keyed = prompts.withColumn("cache_key", cache_key(F.col("prompt")))
    c = cache.select("cache_key", "response").dropDuplicates(["cache_key"])
    return keyed.join(c, "cache_key"), keyed.join(c.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def with_model(prompts: DataFrame, cache: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(cache_key, prompt, response): answers from the cache, else from the model, in Arrow batches; a prompt is asked once."""
    have, miss = cached_answers(prompts, cache)

    def ask(frames):
        for f in frames:
            f["response"] = [model(p) for p in f["prompt"]]
            yield f[["cache_key", "prompt", "response"]]

    fresh = miss.select("cache_key", "prompt").mapInPandas(ask, "cache_key string, prompt string, response string")
    return have.select("cache_key", "prompt", "response").unionByName(fresh)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


class Config:
    """A nested configuration with dotted access; later mappings go over earlier ones."""

    def __init__(self, *parts: Mapping):
        self.data: dict = {}
        for p in parts:
            self.data = _over(self.data, p)

    def get(self, dotted: str, default=None):
        d = self.data
        for k in dotted.split("."):
            if not isinstance(d, Mapping) or k not in d:
                return default
            d = d[k]
        return d

    def require(self, *dotted: str) -> None:
        missing = [k for k in dotted if self.get(k) is None]
        if missing:
            raise KeyError(", ".join(missing))

    @classmethod
    def read(cls, *paths: str) -> Config:
        """JSON files, or YAML where a YAML library is installed."""
        parts = []
        for p in paths:
            s = Path(p).read_text(encoding="utf-8")
            if p.endswith((".yaml", ".yml")):
                import yaml

                parts.append(yaml.safe_load(s) or {})
            else:
                parts.append(json.loads(s))
        return cls(*parts)

    def write(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.data, ensure_ascii=False, indent=2), encoding="utf-8")


def _over(a: Mapping, b: Mapping) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = _over(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; they stand under path as a whole or not at all: written beside it, then renamed."""
    _swapped(df.sparkSession, path, lambda there: df.write.json(there))


def _swapped(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    there = f"{path}.{uuid.uuid4().hex}"
    write(there)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = p(f"{there}.old")
    had = fs.exists(p(path)) and fs.rename(p(path), old)
    if not fs.rename(p(there), p(path)):
        if had:
            fs.rename(old, p(path))
        raise OSError(f"could not rename {there} to {path}")
    if had:
        fs.delete(old, True)


class Backups:
    """Versions of the tables under path: a backup is a folder beside it, whole before it has its name; a rollback puts one back."""

    def __init__(self, spark: SparkSession, path: str, tables: Sequence[str] = ("entities", "relations")):
        self.spark, self.path, self.tables = spark, path, tables

    def _copy(self, source: str, target: str) -> None:
        for t in self.tables:
            self.spark.read.parquet(f"{source}/{t}").write.parquet(f"{target}/{t}")

    def versions(self) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}.backups")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(n for s in fs.listStatus(p) if "." not in (n := s.getPath().getName())) if fs.exists(p) else []

    def save(self, name: str) -> None:
        if name in self.versions():
            raise ValueError(f"there is a backup {name} already")
        _swapped(self.spark, f"{self.path}.backups/{name}", lambda there: self._copy(self.path, there))

    def restore(self, name: str) -> None:
        _swapped(self.spark, self.path, lambda there: self._copy(f"{self.path}.backups/{name}", there))


def write_ontology(classes: DataFrame, properties: DataFrame, path: str, base: str = "http://example.org/ontology#") -> None:
    """The ontology as one JSON line {base_uri, classes, properties, metadata}: a schema, small whatever the data."""
    c = classes.select("name", "label", "parent", F.lit(None).cast("string").alias("description"), F.concat(F.lit(base), "name").alias("uri"))
    ends = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ","), lambda v: v != "")
    p = properties.select("name", F.col("name").alias("label"), F.col("kind").alias("type"), ends("domains").alias("domain"), ends("ranges").alias("range"), F.lit(None).cast("string").alias("description"), F.concat(F.lit(base), "name").alias("uri"))
    both = c.agg(F.array_sort(F.collect_list(F.struct(*c.columns))).alias("classes")).join(p.agg(F.array_sort(F.collect_list(F.struct(*p.columns))).alias("properties")))
    write_json(both.select(F.lit(base).alias("base_uri"), "classes", "properties", F.create_map(F.lit("num_classes"), F.size("classes"), F.lit("num_properties"), F.size("properties")).alias("metadata")), path)


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(classes (name, parent, label), properties (name, kind, domains, ranges)) of an ontology's JSON, on one line or several."""
    c = "name string, label string, parent string, description string, uri string"
    p = "name string, label string, type string, domain array<string>, range array<string>, description string, uri string"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"base_uri string, classes array<struct<{_colons(c)}>>, properties array<struct<{_colons(p)}>>").alias("o"))
    classes = raw.select(F.explode("o.classes").alias("c")).select("c.name", "c.parent", "c.label")
    return classes, raw.select(F.explode("o.properties").alias("p")).select("p.name", F.col("p.type").alias("kind"), F.array_join("p.domain", ",").alias("domains"), F.array_join("p.range", ",").alias("ranges"))


def write_themes(themes: DataFrame, members: DataFrame, path: str) -> None:
    """A theme index: vectors (theme, embedding, ...) and members (theme, entity_id)."""
    _swapped(themes.sparkSession, path, lambda there: (themes.write.parquet(f"{there}/themes"), members.write.parquet(f"{there}/members")))


def read_themes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/themes"), spark.read.parquet(f"{path}/members")


_NODE = "node_id string, node_type string, parent_id string, document_id string, path array<string>, ord int, title string, content string"


def read_nested_forest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, cross-references) of files {trees: {id: {doc_id, root: {node_id, node_type, name, content, children: [...]}}}, cross_refs: [...]}; a tree is read by one
    task, whatever its depth."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "trees map<string,string>, cross_refs array<struct<source_node_id:string,target_node_id:string,reference_text:string,confidence:double>>").alias("f"))

    def flat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, t in zip(f["k"], f["t"]):
                tree = json.loads(t)
                waiting = [(tree.get("root") or {}, None, [], 0)]
                while waiting:
                    n, parent, above, place = waiting.pop()
                    me = n.get("node_id")
                    if me is None:
                        continue
                    here = [*above, me]
                    rows.append((me, n.get("node_type"), parent, tree.get("doc_id", key), here, place, n.get("name"), n.get("content")))
                    waiting += [(c, me, here, i) for i, c in enumerate(n.get("children") or [])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _NODE.split(", ")])

    nodes = raw.select(F.explode("f.trees").alias("k", "t")).mapInPandas(flat, _NODE)
    refs = raw.select(F.explode("f.cross_refs").alias("r")).select(F.col("r.source_node_id").alias("src_article"), F.col("r.target_node_id").alias("dst_article"), F.col("r.reference_text").alias("reference"), F.col("r.confidence").alias("confidence"))
    return nodes, refs


def nested_trees(nodes: DataFrame) -> DataFrame:
    """(document_id, tree): each document's nodes (node_id, node_type, parent_id, document_id, ord, title) as nested JSON; a document is one task's."""

    def nest(f: pd.DataFrame) -> pd.DataFrame:
        below: dict = {}
        f = f.sort_values(["ord", "node_id"], na_position="first")
        for r in f.itertuples():
            below.setdefault(r.parent_id if isinstance(r.parent_id, str) else None, []).append(r)

        def node(r) -> dict:
            return {"node_id": r.node_id, "node_type": r.node_type, "name": r.title if isinstance(r.title, str) else None, "children": [node(c) for c in below.get(r.node_id, [])]}

        doc = f["document_id"].iloc[0]
        roots = below.get(None, [])
        return pd.DataFrame({"document_id": [doc], "tree": [json.dumps({"doc_id": doc, "root": node(roots[0]) if roots else None}, ensure_ascii=False)]})

    cols = nodes.select("node_id", "node_type", "parent_id", "document_id", "ord", "title").dropDuplicates(["document_id", "node_id"])
    return cols.groupBy("document_id").applyInPandas(nest, "document_id string, tree string")


def cache_statistics(cache: DataFrame, model: str = "model") -> DataFrame:
    """(model, entries) of a cache, and all of them under null."""
    return cache.cube(model).agg(F.count("*").alias("entries"), F.grouping(model).alias("_g")).select(F.when(F.col("_g") == 0, F.coalesce(model, F.lit(""))).alias("model"), "entries")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, expected): rows of a training file, a list or lines of {question, article_ids}; numbered in the order of their questions."""
    d = spark.read.schema("id string, question string, article_ids array<string>").json(path, multiLine=True)
    numbers = F.array_sort(F.array_distinct(F.array_compact(F.transform("article_ids", text.article_number))))
    return d.filter("question is not null").select(F.coalesce("id", text.hash_id(F.col("question"), 16)).alias("qid"), "question", numbers.alias("expected"))


def merged_terms(old: DataFrame, new: DataFrame, key: str = "short_form") -> DataFrame:
    """A table of terms with those of new whose key it lacks."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def term_lists(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the values of each key, each once, the surest first, ties by the value; pairs (key, value, confidence)."""
    p = pairs.groupBy(key, value).agg(F.max("confidence").alias("c"))
    return p.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("c"), F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def write_term_lists(lists: DataFrame, path: str, key: str) -> None:
    """term_lists as a mapping: JSON, or YAML by its name, which is JSON too. A dictionary of words is read to the driver whole."""
    rows = {r[key]: list(r["values"]) for r in lists.orderBy(key).collect()}
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=1), encoding="utf-8")


def fetched(urls: DataFrame, fetch: Callable[[str], str], per_second: float = 1.0, retries: int = 3, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, html, attempts, error): pages that the hook brings, each address once. A task keeps `per_second` and tries again, waiting twice as long each time; what fails in
    the end has its error. The rate is a task's own: as many tasks as partitions ask at a time."""

    def bring(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for f in frames:
            rows = []
            for url in f["url"]:
                page = error = None
                for attempt in range(1, retries + 1):
                    wait = last + 1 / per_second - time.monotonic()
                    if last and wait > 0:
                        sleep(wait)
                    last = time.monotonic()
                    try:
                        page, error = fetch(url), None
                        break
                    except Exception as e:  # the hook's own errors are the result
                        error = f"{type(e).__name__}: {e}"
                        if attempt < retries:
                            sleep(first_wait * 2 ** (attempt - 1))
                rows.append((url, page, attempt, error))
            yield pd.DataFrame(rows, columns=["url", "html", "attempts", "error"])

    return urls.select("url").filter("url is not null").distinct().mapInPandas(bring, "url string, html string, attempts int, error string")


def stream_events(c):
    """The data of a server-sent stream of events, in order; [DONE] and comments left out."""
    lines = F.filter(F.split(c, r"\r?\n"), lambda x: x.startswith("data:"))
    data = F.transform(lines, lambda x: F.trim(F.substring(x, F.lit(6), F.length(x))))
    return F.filter(data, lambda x: (x != "[DONE]") & (x != ""))


def streamed_text(c):
    """The text that a stream of a model's events says: choices[0].delta.content of each."""
    return F.array_join(F.transform(stream_events(c), lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.lit(""))), "")


def with_model_json(prompts: DataFrame, cache: DataFrame, model: Callable[[str], str], schema: str) -> DataFrame:
    """with_model, and value: what the JSON in the response says by the schema; null where there is none."""
    return with_model(prompts, cache, model).withColumn("value", F.from_json(text.salvaged_json(F.col("response")), schema))
