"""Information-retrieval metrics, breakdowns and ablations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import dims
from lexigrid.operators.skew import running_total


def metrics(runs: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = dims.CUTOFFS) -> DataFrame:
    """(qid, k, hit, recall, precision, ndcg, rr, expected): per question and cut-off.

    runs (qid, item, rank), qrels (qid, item). Precision divides by k even when fewer were found; a question without a run has zeros; questions
    without relevant items aren't in the result. Places are matched once; all cut-offs come from one aggregation.
    """
    rel = qrels.filter("item is not null").select("qid", "item").distinct()
    size = rel.groupBy("qid").agg(F.count("*").alias("expected"))
    hits = runs.groupBy("qid", "item").agg(F.min("rank").alias("rank")).join(rel, ["qid", "item"]).select("qid", "rank")
    per = size.join(hits, "qid", "left").withColumn("k", F.explode(F.array(*map(F.lit, cutoffs))))
    inside = F.col("rank") <= F.col("k")
    gain = F.sum(F.when(inside, F.log(F.lit(2.0)) / F.log(F.col("rank") + 1.0)).otherwise(0.0))
    g = per.groupBy("qid", "k", "expected").agg(F.sum(F.when(inside, 1).otherwise(0)).alias("n"), gain.alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("expected", "k").cast("int")), F.lit(0.0), lambda a, i: a + F.log(F.lit(2.0)) / F.log(i + 1.0))
    r = lambda c: F.round(c, 6)
    return g.select(
        "qid", "k", (F.col("n") > 0).cast("int").alias("hit"), r(F.col("n") / F.col("expected")).alias("recall"), r(F.col("n") / F.col("k")).alias("precision"),
        r(F.col("dcg") / ideal).alias("ndcg"), r(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"), "expected",
    )


def averages(m: DataFrame, by: tuple[str, ...] = ("k",)) -> DataFrame:
    """Means over questions."""
    return m.groupBy(*by).agg(F.count("*").alias("questions"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "precision", "ndcg", "rr")])


def breakdown(m: DataFrame, attributes: DataFrame, dimensions: tuple[str, ...], k: int = 10) -> DataFrame:
    """(dimension, value, questions, hit, recall, rr) at k: one row per value of each dimension of attributes (qid, ...), and 'all', in one pass by grouping
    sets."""
    d = m.filter(F.col("k") == k).join(attributes, "qid")
    for c in dimensions:
        d = d.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("(none)")))
    sets = d.groupingSets([[F.col(c)] for c in dimensions] + [[]], *dimensions)
    agg = sets.agg(F.grouping_id().alias("_g"), F.count("*").alias("questions"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "rr")])
    name = F.lit("all")
    for i, c in enumerate(dimensions):
        bits = (1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1 - i))
        name = F.when(F.col("_g") == bits, c).otherwise(name)
    return agg.select(name.alias("dimension"), F.coalesce(*dimensions, F.lit("all")).alias("value"), "questions", "hit", "recall", "rr")


def confidence_bucket(c: Column) -> Column:
    """low below .5, medium below .7, high from there on; none without."""
    return F.when(c.isNull(), "none").when(c < 0.5, "low").when(c < 0.7, "medium").otherwise("high")


def volume_bucket(n: Column) -> Column:
    """How many articles came: 0, 1-10, 11-30, 31-50 or more."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0").when(n <= 10, "1-10").when(n <= 30, "11-30").when(n <= 50, "31-50").otherwise("51+")


def hit_pattern(tree: Column, kg: Column) -> Column:
    """both, tree_only, kg_only or neither."""
    t, g = F.coalesce(tree, F.lit(False)), F.coalesce(kg, F.lit(False))
    return F.when(t & g, "both").when(t, "tree_only").when(g, "kg_only").otherwise("neither")


def expected_bucket(n):
    """1, 2-3 or 4+ relevant items."""
    return F.when(n <= 1, "1").when(n <= 3, "2-3").otherwise("4+")


def agreement(tree: DataFrame, kg: DataFrame, qrels: DataFrame) -> DataFrame:
    """(pattern, questions): whether tree, kg, both or neither found a relevant item; every pattern has a row."""
    rel = qrels.select("qid", "item").distinct()
    hit = lambda d, c: d.select("qid", "item").distinct().join(rel, ["qid", "item"]).select("qid").distinct().withColumn(c, F.lit(True))
    d = rel.select("qid").distinct().join(hit(tree, "t"), "qid", "left").join(hit(kg, "g"), "qid", "left")
    t, g = F.col("t").isNotNull(), F.col("g").isNotNull()
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    row = d.agg(one(t & g).alias("both"), one(t & ~g).alias("tree_only"), one(~t & g).alias("kg_only"), one(~t & ~g).alias("neither"))
    parts = F.array(*[F.struct(F.lit(c).alias("pattern"), F.coalesce(F.col(c), F.lit(0)).alias("questions")) for c in ("both", "tree_only", "kg_only", "neither")])
    return row.select(F.explode(parts).alias("x")).select("x.*")


def running_hit_rate(m: DataFrame, order: str = "qid", k: int = 10, stretch: int = 10_000) -> DataFrame:
    """(qid, n, rate): the hit rate up to each question, as an evaluation prints it.

    The questions of an evaluation are one sequence; it is summed in stretches of `stretch` values of a numeric order, so no task has all of it.
    """
    d = m.filter(F.col("k") == k).select("qid", F.col(order).alias("_at"), "hit", F.lit(1).alias("_one"))
    bucket = F.floor(F.col("_at") / stretch)
    hits = running_total(d, "hit", bucket, [F.col("_at")], out="hits")
    return running_total(hits, "_one", bucket, [F.col("_at")], out="n").select("qid", "n", F.round(F.col("hits") / F.col("n"), 6).alias("rate"))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old that new doesn't have."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def set_scores(found: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, set_precision, set_recall, f1) of unranked sets; 0 where nothing fits."""
    f, r = found.select("qid", "item").distinct(), qrels.select("qid", "item").distinct()
    n = r.groupBy("qid").agg(F.count("*").alias("r")).join(f.groupBy("qid").agg(F.count("*").alias("f")), "qid", "left").join(f.join(r, ["qid", "item"]).groupBy("qid").agg(F.count("*").alias("b")), "qid", "left")
    b = F.coalesce("b", F.lit(0))
    p, q = b / F.greatest(F.coalesce("f", F.lit(0)), F.lit(1)), b / F.col("r")
    return n.select("qid", F.round(p, 6).alias("set_precision"), F.round(q, 6).alias("set_recall"), F.round(F.when(b > 0, 2 * p * q / (p + q)).otherwise(0.0), 6).alias("f1"))


@dataclass(frozen=True)
class Ablation:
    """The switches of the engine. What is off by default is what the engine leaves out unless it is asked for: ontology, document_filter and filter_dual, without which
    adaptive_threshold and ambiguity have nothing to decide."""

    name: str = "full"
    tree: bool = True
    dual: bool = True
    bridge: bool = True
    kg_expansion: bool = True
    kg_retrieval: bool = True
    adjacent: bool = True
    rerank: bool = True
    ppr: bool = True
    keyphrase: bool = True
    semantic: bool = True
    concept: bool = True
    theme: bool = True
    hierarchy: bool = True
    cross_check: bool = True
    query_expansion: bool = True
    classification: bool = True
    adaptive_threshold: bool = True
    ambiguity: bool = True
    rrf: bool = True
    ontology: bool = False
    document_filter: bool = False
    filter_dual: bool = False

    def as_dict(self) -> dict:
        return dict(self.__dict__)

    @classmethod
    def from_dict(cls, d: dict) -> Ablation:
        return cls(**{k: v for k, v in d.items() if k in cls.__dataclass_fields__})

    @classmethod
    def everything(cls) -> Ablation:
        """Every switch on."""
        return cls(ontology=True, document_filter=True, filter_dual=True)


_FUSION = ("kg_expansion", "bridge", "adjacent", "rrf")
# The named configurations and the switches they turn off.
CONFIGURATIONS: dict[str, tuple[str, ...]] = {
    "full": (),
    "tree_only": ("dual", *_FUSION),
    "dual_only": ("tree", *_FUSION),
    "dual_no_ppr": ("tree", "ppr", *_FUSION),
    "no_ppr": ("ppr",),
    "no_semantic_bridge": ("bridge",),
    "no_kg_expansion": ("kg_expansion",),
    "no_rrf_merge": ("rrf",),
    "no_adjacent": ("adjacent",),
    "no_tree": ("tree",),
    "no_dual": ("dual",),
    "simple_merge": _FUSION,
    "no_reranker": ("rerank",),
    "no_tree_no_reranker": ("tree", "rerank"),
    "no_kg": ("dual", "kg_retrieval", "kg_expansion"),
    "no_query_type": ("classification",),
    "no_ontology": ("ontology",),
    "no_doc_filter": ("document_filter",),
    "no_adaptive_threshold": ("adaptive_threshold",),
    "no_ambiguity_calibration": ("ambiguity",),
    "no_calibration": ("adaptive_threshold", "ambiguity"),
}
#: The parts of the second tier and of the question's treatment, one off each.
PARTS = ("keyphrase", "semantic", "concept", "theme", "hierarchy", "cross_check", "query_expansion")


def ablations(base: Ablation = Ablation.everything()) -> list[Ablation]:
    """The named configurations, from a base."""
    return [replace(base, name=name, **{c: False for c in off}) for name, off in CONFIGURATIONS.items()]


def part_ablations(base: Ablation = Ablation.everything()) -> list[Ablation]:
    """The base with each of PARTS off."""
    return [replace(base, name=f"no_{c}", **{c: False}) for c in PARTS]


def selected(questions: DataFrame, limit: int | None = None, offset: int = 0, ids: Sequence | None = None, key: str = "qid") -> DataFrame:
    """Some questions of a benchmark: those of the given ids, or from the offset on by key as many as limit says; without anything all."""
    d = questions if ids is None else questions.filter(F.col(key).isin(*ids))
    if offset or limit is not None:
        d = d.orderBy(key).offset(offset)
    return d if limit is None else d.limit(limit)
