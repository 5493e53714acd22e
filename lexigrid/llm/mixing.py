"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lexigrid.operators.skew import running_total
from lexigrid.session import cut

#: A vocabulary file: ranks of a byte-level BPE.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern by which byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows that share a bucket of a running total, about.
BUCKET_ROWS = 20_000


def token_counter(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A column function: tokens of a text; 0 for null. The driver reads the vocabulary, a few megabytes, and sends it to every task, so only it needs the file."""
    sent = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    @pandas_udf("long")
    def count(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in sent.value.splitlines() if x)}
        coder = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for s in frames:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return count


def source_name(c: Column) -> Column:
    """One spelling for a source: trimmed, lower case, hyphens and blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))), "[- ]+", "_")


def sized(docs: DataFrame, vocabulary: str = VOCABULARY, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, place): documents with tokens; place is their random spot in their source's order, uniform over 64 bits."""
    d = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text").filter("doc_id is not null and source is not null and length(text) > 0")
    return d.select("doc_id", "source", token_counter(docs.sparkSession, vocabulary)("text").alias("tokens"), F.xxhash64("doc_id", F.lit(seed)).alias("place")).filter("tokens > 0")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, copy, tokens, finish) and its report (source, target_share, max_repeats, documents, available_tokens, rows,
    tokens, share, copies).

    Each source's documents stand in shuffled order, over and over up to max_repeats times; a document's virtual finish time is its
    source's tokens up to and with it, divided by the source's share. All are sorted by it and taken until total_tokens is reached; the
    last one taken may end beyond it by less than itself. Without total_tokens the mix is the largest in which no source that has
    documents runs out: the least of available tokens times max_repeats by share. Shares of sources without documents go to the others in
    proportion. Documents of sources without target, without source, id or text are left out; repeated rows of one doc_id count once.

    Running sums go through buckets: a source with a third of all rows is never in one task.
    """
    spark = docs.sparkSession
    d = cut(sized(docs, vocabulary, seed).groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens"), F.first("place").alias("place")))
    t = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.greatest(F.col("max_repeats"), F.lit(0)).alias("max_repeats")).filter("source is not null and target_share > 0")
    t = t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = d.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"))
    # One row per target: a table of the request, not of the data, read to the driver to plan with.
    plan = t.join(have, "source", "left").orderBy("source").collect()
    usable = [r for r in plan if r["available_tokens"] and r["max_repeats"]]
    whole = sum(r["target_share"] for r in usable) or 1.0
    most = min((r["available_tokens"] * r["max_repeats"] / (r["target_share"] / whole) for r in usable), default=0)
    total = int(total_tokens if total_tokens is not None else most)
    # Passes over a source that the total can need.
    rows = [
        (r["source"], r["target_share"] / whole, r["available_tokens"], min(r["max_repeats"], int(total // max(1, r["available_tokens"])) + 2))
        for r in usable
    ]
    shares = F.broadcast(spark.createDataFrame(rows, "source string, weight double, all_tokens long, passes int"))
    n = sum(r["documents"] or 0 for r in plan)
    buckets = max(1, n // BUCKET_ROWS)
    bucket = F.floor((F.col("place").cast("double") + float(2**63)) / float(2**64) * buckets)
    inside = running_total(d.join(shares, "source"), "tokens", bucket, [F.col("place"), F.col("doc_id")], ["source"], out="upto")
    copies = inside.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    finish = ((F.col("copy") - 1) * F.col("all_tokens") + F.col("upto")) / F.col("weight")
    # Finish times run from 0 to about the total at a steady pace of tokens, so equal stretches of them are even buckets.
    queue = copies.select("doc_id", "source", "copy", "tokens", finish.alias("finish")).filter(F.col("finish") - F.col("tokens") / F.lit(min((r[1] for r in rows), default=1.0)) <= total)
    spots = max(1, (2 * n) // BUCKET_ROWS)
    step = max(total, 1) / spots
    everything = running_total(queue, "tokens", F.floor(F.col("finish") / step), [F.col("finish"), F.col("source"), F.col("doc_id"), F.col("copy")], out="sofar")
    taken = everything.filter(F.col("sofar") - F.col("tokens") < total).select("doc_id", "source", "copy", "tokens", "finish")
    got = taken.groupBy("source").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.max("copy").alias("copies"))
    report = (
        spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], r["documents"] or 0, r["available_tokens"] or 0) for r in plan], "source string, target_share double, max_repeats int, documents long, available_tokens long")
        .join(got, "source", "left")
        .select("source", "target_share", "max_repeats", "documents", "available_tokens", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("copies", F.lit(0)).cast("int").alias("copies"))
    )
    reached = got.agg(F.sum("tokens").alias("_all"))
    report = report.join(F.broadcast(reached)).withColumn("share", F.coalesce(F.round(F.col("tokens") / F.col("_all"), 6), F.lit(0.0))).drop("_all")
    return taken, report
