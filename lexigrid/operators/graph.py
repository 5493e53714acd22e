"""Graph operators over edge tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexigrid.functions import dims
from lexigrid.operators.skew import hot_split_join, parted_join
from lexigrid.session import cut


#: Edges of a graph that is sent to every task: 24 bytes each and the names of the nodes, some 100 MB at most.
EDGE_ROWS = 1_000_000
#: Numbers of a matrix of scores, or of the shares that flow along the edges, that are worked out at once.
MATRIX_CELLS = 16_000_000


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of an undirected edge table the least node it is connected with.

    Edges are contracted in stars: each node's larger neighbours are hung on its least neighbour, then its smaller ones likewise, until nothing
    changes; rounds grow with the logarithm of the longest path. A node with very many neighbours is reduced by partial minima and met by
    broadcast. Null ends and self-loops are ignored; nodes without edges aren't in the result.
    """
    proper = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(proper.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    size, before = e.count(), None
    for _ in range(max_rounds):
        # Large star: every neighbour above the node is hung on the least of the node and its neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = hot_split_join(both, least, ["u"], "n", total=2 * size).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: every neighbour below the node, and the node, is hung on the least of them.
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_split_join(large, low, ["u"], "n", total=size).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        size, before = now[0], now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def symmetric(edges: DataFrame, types: Sequence[str] = dims.SYMMETRIC_RELATIONS) -> DataFrame:
    """edges (src, dst, relation_type, ...) with the reverse of those whose type goes both ways."""
    back = edges.filter(F.col("relation_type").isin(*types))
    cols = [F.col("dst").alias("src") if c == "src" else F.col("src").alias("dst") if c == "dst" else F.col(c) for c in edges.columns]
    return edges.unionByName(back.select(*cols))


def transition(edges: DataFrame, intents: DataFrame, gamma: float = 0.5, floor: float = 0.1) -> DataFrame:
    """(intent_set, src, dst, w): edge weights of each set of intents, each source's summing to 1.

    edges (src, dst, relation_type, confidence[, similarity]); intents (intent_set, intent, weight). An edge weighs the set's mean of its type's weight
    by intent, times its confidence, times the target's similarity (1 by default, at least `floor`) to the power gamma. Symmetric types add
    the reverse edge; repeated edges add up.
    """
    spark = edges.sparkSession
    rows = [(i, t, float(w)) for i, m in dims.INTENT_RELATION_WEIGHTS.items() for t, w in m.items()]
    table = F.broadcast(spark.createDataFrame(rows, "intent string, relation_type string, table_weight double"))
    edges = edges.withColumn("relation_type", F.coalesce("relation_type", F.lit("")))
    types = edges.select("relation_type").distinct()
    known = F.coalesce("table_weight", F.lit(dims.UNKNOWN_RELATION))
    # Intents are a handful, relation types a few dozen: this is a table of the schema, not of the data.
    per = types.join(F.broadcast(intents), F.lit(True)).join(table, ["intent", "relation_type"], "left")
    per = per.groupBy("intent_set", "relation_type").agg((F.sum(known * F.col("weight")) / F.sum("weight")).alias("rw"))
    e = symmetric(edges).filter("src is not null and dst is not null")
    sim = F.coalesce(F.col("similarity"), F.lit(1.0)) if "similarity" in edges.columns else F.lit(1.0)
    w = F.col("rw") * F.coalesce("confidence", F.lit(1.0)) * F.pow(F.greatest(sim, F.lit(floor)), F.lit(gamma))
    raw = e.join(F.broadcast(per), "relation_type").groupBy("intent_set", "src", "dst").agg(F.sum(w).alias("w")).filter("w > 0")
    out = raw.groupBy("intent_set", "src").agg(F.sum("w").alias("t"))
    return raw.join(out, ["intent_set", "src"]).select("intent_set", "src", "dst", (F.col("w") / F.col("t")).alias("w"))


def personalized_pagerank(
    edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, iterations: int = 50, tolerance: float = 1e-6, checkpoint_every: int = 5, most_edges: int = EDGE_ROWS
) -> DataFrame:
    """(qid, node, score) for score above 0: personalised PageRank of all questions at once.

    edges (src, dst, w) with weights that sum to 1 per source; seeds (qid, node, weight). p <- alpha s + (1 - alpha) W' p from p = s, until the scores of
    every question change by less than tolerance in sum, at most `iterations` times. alpha is the teleport. Seeds are divided by their sum
    per question, also those the graph doesn't have; sources without edges lose their share.

    A graph of at most most_edges edges, which is counted first, goes to every task as a matrix, and the questions are worked out in blocks, each at once. A larger one is
    walked by joins: the edge table is shuffled once by source and checkpointed; a step joins the scores to it and sums per (qid, node), combined on the
    map side.
    """
    s = seeds.filter("node is not null and weight > 0").groupBy("qid", "node").agg(F.sum("weight").alias("w"))
    s = cut(s.join(s.groupBy("qid").agg(F.sum("w").alias("t")), "qid").select("qid", "node", (F.col("w") / F.col("t")).alias("s")))
    e = cut(edges.filter("src is not null and dst is not null").select(F.col("src").alias("node"), "dst", "w").repartition("node"))
    n = e.count()
    if n <= most_edges:
        return _walked_in_blocks(e, s, n, alpha, iterations, tolerance, checkpoint_every)
    return _walked_by_joins(e, s, alpha, iterations, tolerance, checkpoint_every)


class _Matrix:
    """The transitions as arrays, ordered by target."""

    def __init__(self, nodes: list, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
        order = np.argsort(dst, kind="stable")
        self.nodes, self.src, self.w = nodes, src[order], w[order]
        self.targets, self.starts = np.unique(dst[order], return_index=True)

    def step(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros_like(p)
        if len(self.starts):
            out[self.targets] = np.add.reduceat(self.w[:, None] * p[self.src], self.starts, axis=0)
        return out


def _walked_in_blocks(e: DataFrame, s: DataFrame, n: int, alpha: float, iterations: int, tolerance: float, every: int) -> DataFrame:
    rows = e.toPandas()
    codes, nodes = pd.factorize(pd.concat([rows["node"], rows["dst"]], ignore_index=True))
    sent = e.sparkSession.sparkContext.broadcast(_Matrix(list(nodes), codes[:n], codes[n:], rows["w"].to_numpy()))
    # As many questions at once as a matrix of some 128 MB takes.
    width = int(np.clip(MATRIX_CELLS // max(n, len(nodes), 1), 1, 256))
    blocks = max(1, -(-s.select("qid").distinct().count() // width))
    schema = f"qid {s.schema['qid'].dataType.simpleString()}, node {s.schema['node'].dataType.simpleString()}, score double"

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        m = sent.value
        place = {x: i for i, x in enumerate(m.nodes)}
        out = []
        asked = f["qid"].unique()
        for at in range(0, len(asked), width):
            qids = asked[at : at + width]
            g = f[f["qid"].isin(qids)]
            column = {q: i for i, q in enumerate(qids)}
            row = g["node"].map(place)
            known = row.notna().to_numpy()
            # Seeds that the graph doesn't have keep what comes back to them.
            away = g[~known]
            out.append(pd.DataFrame({"qid": away["qid"], "node": away["node"], "score": away["s"] * (alpha if iterations else 1.0)}))
            seed = np.zeros((len(m.nodes), len(qids)))
            seed[row[known].astype(int).to_numpy(), g["qid"].map(column)[known].to_numpy()] = g["s"][known].to_numpy()
            p = seed
            before = p
            for i in range(iterations):
                p = alpha * seed + (1 - alpha) * m.step(p)
                if i + 1 == iterations or (i + 1) % every == 0:
                    if np.abs(p - before).sum(axis=0).max(initial=0) < tolerance:
                        break
                before = p
            i, j = np.nonzero(p > 0)
            out.append(pd.DataFrame({"qid": qids[j], "node": [m.nodes[k] for k in i], "score": p[i, j]}))
        return pd.concat(out)

    # A block has about `width` questions; where chance gives it more they are taken in turn.
    return s.groupBy(F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("_b")).applyInPandas(lambda f: walk(f), schema)


def _walked_by_joins(e: DataFrame, s: DataFrame, alpha: float, iterations: int, tolerance: float, checkpoint_every: int) -> DataFrame:
    p = s.select("qid", "node", F.col("s").alias("p"))
    for i in range(iterations):
        flow = p.join(e, "node").select("qid", F.col("dst").alias("node"), (F.col("p") * F.col("w") * (1 - alpha)).alias("x"))
        step = flow.unionByName(s.select("qid", "node", (F.col("s") * alpha).alias("x"))).groupBy("qid", "node").agg(F.sum("x").alias("p"))
        last = i + 1 == iterations
        if last or (i + 1) % checkpoint_every == 0:
            before = cut(p) if checkpoint_every > 1 else p
            step = cut(step)
            change = (
                step.withColumnRenamed("p", "a").join(before.withColumnRenamed("p", "b"), ["qid", "node"], "full_outer")
                .groupBy("qid").agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("d")).agg(F.max("d")).first()[0]
            )
            p = step
            if change is None or change < tolerance:
                break
        else:
            p = step
    return p.filter("p > 0").select("qid", "node", F.col("p").alias("score"))


#: Numbers of a block's matrix of scores, of which there are two, and questions of a block at most.
BLOCK_CELLS, BLOCK_QUESTIONS = 12_000_000, 32
#: Edges of a set of intents that go to every block of questions: 16 bytes each.
BLOCK_EDGES = 10_000_000


def numbered(edges: DataFrame, *others: DataFrame) -> DataFrame:
    """(node, id): the ends of edges (src, dst) and the nodes of others, whose first column it is, numbered from 0 without gaps."""
    d = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    for x in others:
        d = d.union(x.select(x.columns[0]))
    d = cut(d.filter("node is not null").distinct().withColumn("_i", F.monotonically_increasing_id()))
    part = F.shiftright("_i", 33)
    ends = sorted((r["p"], r["n"]) for r in d.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in ends:
        starts.append((p, before))
        before += n
    first = d.sparkSession.createDataFrame(starts, "p long, first long")
    return d.join(F.broadcast(first), part == F.col("p")).select("node", (F.col("first") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("id"))


def coded(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges with the numbers of their ends in place of src and dst."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    for c in ("src", "dst"):
        edges = edges.withColumnRenamed(c, "node").join(ids, "node").drop("node").withColumnRenamed("id", c)
    return edges.select("src", "dst", *rest)


def _packed(w: DataFrame, numbers: DataFrame) -> DataFrame:
    """(intent_set, src, w, starts, targets): edges (intent_set, src, dst, w) in the order of their targets, some thousands to a row as bytes; without intent_set,
    numbers (id, number) as src and targets."""
    schema = "intent_set string, src binary, w binary, starts binary, targets binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            sets = np.array(f["intent_set"].to_pylist(), dtype=object)
            src, dst, w = (f[c].to_numpy(zero_copy_only=False) for c in ("src", "dst", "w"))
            for x in dict.fromkeys(sets):
                at = np.nonzero(sets == x)[0]
                targets, starts = np.unique(dst[at], return_index=True)
                row = [x, src[at].astype(np.int32), w[at].astype(float), starts.astype(np.int32), targets.astype(np.int32)]
                yield pa.RecordBatch.from_pylist([{k: v if k == "intent_set" else v.tobytes() for k, v in zip(("intent_set", "src", "w", "starts", "targets"), row)}], schema=to_arrow_schema(w0))

    w0 = w.sparkSession.createDataFrame([], schema).schema
    n = int(w.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = w.select("intent_set", "src", "dst", "w").repartition(n, "intent_set", "dst").sortWithinPartitions("intent_set", "dst", "src").mapInArrow(pack, schema)

    def pack_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            if f.num_rows:
                a, b = (f[c].to_numpy().astype(np.int32).tobytes() for c in ("id", "number"))
                yield pa.RecordBatch.from_pylist([{"intent_set": None, "src": a, "w": b"", "starts": b"", "targets": b}], schema=to_arrow_schema(w0))

    return e.union(numbers.select("id", "number").mapInArrow(pack_numbers, schema))


def pagerank_numbers(
    w: DataFrame, sets: DataFrame, seeds: DataFrame, numbers: DataFrame, nodes: int, alpha: float = 0.15, iterations: int = 50, tolerance: float = 1e-6, every: int = 5
) -> DataFrame:
    """(qid, number, score): the greatest personalised PageRank of the nodes with a number, for score above 0.

    w (intent_set, src, dst, w) as of transition, sets (qid, intent_set), seeds (qid, ids, weights), many as bytes of int32 and float64, numbers (id, number), one for an
    id; ends and ids are numbers below `nodes`.
    The walk is personalized_pagerank's. The questions of a set are dealt out in blocks, to each of which the set's edges go through the shuffle as bytes; a block is walked
    as matrices and hands out what belongs to numbers only. So the driver carries no edges, and no row is made for a node.
    """
    spark = w.sparkSession
    width = int(np.clip(BLOCK_CELLS // max(nodes, 1), 1, BLOCK_QUESTIONS))
    of = Window.partitionBy("intent_set").orderBy("qid")
    asked = cut(sets.withColumn("block", F.floor((F.row_number().over(of) - 1) / width).cast("int")))
    blocks = asked.select("intent_set", "block").distinct()
    tasks = 4 * max(1, blocks.count())
    s = seeds.join(F.broadcast(asked), "qid").select("intent_set", "block", "qid", "ids", "weights")
    packed = _packed(w, numbers)
    named = packed.withColumnRenamed("intent_set", "_set").join(F.broadcast(blocks), F.col("_set").isNull() | (F.col("_set") == F.col("intent_set")))
    kind = sets.schema["qid"].dataType
    out = spark.createDataFrame([], f"qid {kind.simpleString()}, number int, score double").schema

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        edges, at, number = [], [], []
        for r in right.select(["_set", "src", "w", "starts", "targets"]).to_pylist():
            src, targets = (np.frombuffer(r[c], np.int32) for c in ("src", "targets"))
            if r["_set"] is None:
                at.append(src)
                number.append(targets)
            else:
                edges.append((src, np.repeat(targets, np.diff(np.append(np.frombuffer(r["starts"], np.int32), len(src)))), np.frombuffer(r["w"], float)))
        none = pa.Table.from_pylist([], schema=to_arrow_schema(out))
        if not left.num_rows or not at:
            return none
        qids = left["qid"].combine_chunks().unique()
        p = np.zeros((nodes, len(qids)))
        for k, ids, weights in zip(pc.index_in(left["qid"], qids).to_pylist(), left["ids"].to_pylist(), left["weights"].to_pylist()):
            p[np.frombuffer(ids, np.int32), k] = np.frombuffer(weights, float)
        p /= p.sum(axis=0)
        step = _Rounds(*map(np.concatenate, zip(*edges)), 1 - alpha).step if edges else np.zeros_like
        row, column = np.nonzero(p)
        seed = p[row, column] * alpha
        for i in range(iterations):
            q = step(p)
            q[row, column] += seed
            stop = (i + 1) % every == 0 and _change(p, q) < tolerance
            p = q
            if stop:
                break
        at, number = np.concatenate(at), np.concatenate(number)
        order = np.argsort(number, kind="stable")
        different, starts = np.unique(number[order], return_index=True)
        best = np.maximum.reduceat(p[at[order]], starts, axis=0)
        i, j = np.nonzero(best > 0)
        return pa.Table.from_arrays([qids.take(pa.array(j)), pa.array(different[i], pa.int32()), pa.array(best[i, j])], schema=to_arrow_schema(out))

    key = ["intent_set", "block"]
    together = s.repartition(tasks, *key).groupBy(*key).cogroup(named.repartition(tasks, *key).groupBy(*key))
    return together.applyInArrow(walk, out)


class _Rounds:
    """Edges dealt out in rounds: the first into each node, the second, and so on, so that a round adds rows to different nodes; those into nodes with more than
    ROUNDS are multiplied a node at a time. Rows are gathered ROUND_ROWS at a time, which stay in the cache."""

    ROUNDS, ROUND_ROWS = 64, 4000

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, share: float):
        order = np.lexsort((src, dst))
        src, w = src[order], w[order] * share
        nodes, first, n = np.unique(dst[order], return_index=True, return_counts=True)
        hub = n > self.ROUNDS
        self.hubs = [(x, src[a : a + k], w[a : a + k]) for x, a, k in zip(nodes[hub], first[hub], n[hub])]
        by_size = np.argsort(-n[~hub], kind="stable")
        self.nodes, first, n = nodes[~hub][by_size], first[~hub][by_size], n[~hub][by_size]
        self.rounds = []
        for k in range(n[0] if len(n) else 0):
            at = first[: np.count_nonzero(n > k)] + k
            self.rounds.append((src[at], w[at][:, None]))

    def step(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros_like(p)
        for a in range(0, len(self.nodes), self.ROUND_ROWS):
            total = np.zeros((min(self.ROUND_ROWS, len(self.nodes) - a), p.shape[1]))
            for src, w in self.rounds:
                some = src[a : a + self.ROUND_ROWS]
                if not len(some):
                    break
                flow = p.take(some, axis=0)
                flow *= w[a : a + self.ROUND_ROWS]
                total[: len(some)] += flow
            out[self.nodes[a : a + self.ROUND_ROWS]] = total
        for x, src, w in self.hubs:
            for a in range(0, len(src), 65536):
                out[x] += w[a : a + 65536] @ p.take(src[a : a + 65536], axis=0)
        return out


def _change(p: np.ndarray, q: np.ndarray) -> float:
    """The greatest change of a question, worked out in parts."""
    return sum((np.abs(p[a : a + 65536] - q[a : a + 65536]).sum(axis=0) for a in range(0, len(p), 65536)), np.zeros(p.shape[1])).max(initial=0)


def first_articles(mentions: DataFrame) -> DataFrame:
    """(entity_id, article_id): each entity's first source, ties by id."""
    return mentions.groupBy("entity_id").agg(F.min_by("article_id", F.struct("ord", "article_id")).alias("article_id"))


def related_articles(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """(article_id, related_id, relation_type, confidence): the first source of the other end of each edge at one of an article's entities, either way; other articles
    only, each type at its surest."""
    at = mentions.select("entity_id", "article_id").distinct()
    first = first_articles(mentions).withColumnRenamed("article_id", "related_id")
    both = edges.select(F.col("src").alias("entity_id"), F.col("dst").alias("other"), "relation_type", "confidence").union(edges.select("dst", "src", "relation_type", "confidence"))
    # An entity may be at the end of a tenth of all edges: edges are first brought to their other end's article and summed up.
    ends = both.join(first.withColumnRenamed("entity_id", "other"), "other").groupBy("entity_id", "related_id", "relation_type").agg(F.max("confidence").alias("confidence"))
    met = parted_join(at, ends, ["entity_id"]).filter("article_id <> related_id")
    return met.groupBy("article_id", "related_id", "relation_type").agg(F.max("confidence").alias("confidence"))


def first_numbers(mentions: DataFrame) -> DataFrame:
    """(node, number): the article number of each entity's first source that has one, ties by id."""
    first = mentions.filter("article_number is not null").groupBy(F.col("entity_id").alias("node"))
    return first.agg(F.min_by("article_number", F.struct("ord", "article_id")).alias("number"))


def articles_of_numbers(scores: DataFrame, mentions: DataFrame) -> DataFrame:
    """(qid, article_id, score): scores (qid, number, score) given to all articles of the number."""
    # Numbers are few and every law has the first of them: many rows on both sides.
    articles = mentions.filter("article_number is not null").select(F.col("article_number").alias("number"), "article_id").distinct()
    return parted_join(scores, articles, ["number"]).select("qid", "article_id", "score")


def pagerank_articles(scores: DataFrame, mentions: DataFrame) -> DataFrame:
    """(qid, article_id, score): the greatest entity score per article number of the entity's first source, given to all articles of that number.

    mentions (entity_id, article_id, article_number, ord).
    """
    return articles_of_numbers(scores.join(first_numbers(mentions), "node").groupBy("qid", "number").agg(F.max("score").alias("score")), mentions)


def neighbourhood(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """(node, neighbour, direction, relation_type, confidence): edges out of and into each node; a neighbour both ways is kept as 'out', each once."""
    n = nodes.select(F.col(node).alias("node")).distinct()
    one = lambda a, b, d, o: edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour"), F.lit(d).alias("direction"), F.lit(o).alias("o"), "relation_type", "confidence")
    both = one("src", "dst", "out", 0).unionByName(one("dst", "src", "in", 1)).join(n, "node").filter("node <> neighbour")
    best = F.min_by(F.struct("direction", "relation_type", "confidence"), F.struct("o", -F.coalesce("confidence", F.lit(0.0)), "relation_type"))
    return both.groupBy("node", "neighbour").agg(best.alias("b")).select("node", "neighbour", "b.*")


def induced(edges: DataFrame, members: DataFrame, group: str, node: str = "node") -> DataFrame:
    """Edges whose ends are both members of a group: (group, src, dst, relation_type, confidence)."""
    m = members.select(group, F.col(node)).distinct()
    a = edges.join(m.withColumnRenamed(node, "src"), "src")
    return a.join(m.withColumnRenamed(node, "dst"), [group, "dst"]).select(group, "src", "dst", "relation_type", "confidence")


def theme_partition(edges: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """(theme, node, size): components of at least `least` nodes; of larger ones the first `most` nodes by id, a limit that is the feature."""
    c = connected_components(edges, "src", "dst")
    size = c.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    w = Window.partitionBy("component").orderBy("node")
    return c.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).join(size, "component").select(F.col("component").alias("theme"), "node", "size")


def closure(parents: DataFrame, child: str, parent: str, depth: int = 20) -> DataFrame:
    """(node, ancestor, distance): ancestors up to `depth` levels; a cycle ends where it meets a pair again. For trees of classes, not of data."""
    p = cut(parents.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).filter("node is not null and ancestor is not null").distinct())
    every = frontier = p.withColumn("distance", F.lit(1))
    up = p.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    for d in range(2, depth + 1):
        frontier = frontier.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(d).alias("distance")).distinct()
        frontier = cut(frontier.join(every, ["node", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            break
        every = every.unionByName(frontier)
    return every
