"""Streams: documents' extractions merged into the graph, running statistics, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrid.operators import kg


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def merge_entities(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Extracted entities (name, type_str, description, confidence, source_id, document_id, ord) merged by slug: each micro-batch is merged in itself; what is new goes
    under path, each slug once, and what a later batch knows of a known one under path.further, both under the batch's number, so a repeated batch replaces
    itself. merged_batches() reads all of it as one."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = kg.merged_entities(batch)
        have = _there(spark, path)
        known = new.select("entity_id").limit(0) if have is None else have.filter(F.col("batch") != n).select("entity_id")
        new.join(known, "entity_id", "left_anti").write.mode("overwrite").parquet(f"{path}/batch={n}")
        new.join(known, "entity_id", "left_semi").write.mode("overwrite").parquet(f"{path}.further/batch={n}")

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def merged_batches(spark: SparkSession, path: str) -> DataFrame:
    """The entities that merge_entities has written, those of one slug as one: what a later batch knows of an entity is folded into the earlier. See folded."""
    first, further = spark.read.parquet(path), _there(spark, f"{path}.further")
    return folded(first if further is None else first.unionByName(further))


def compact_batches(spark: SparkSession, path: str, target: str) -> None:
    """merged_batches as one batch under target, to go on from."""
    merged_batches(spark, path).write.mode("overwrite").parquet(f"{target}/batch=0")


def folded(batches: DataFrame) -> DataFrame:
    """Merged entities with a batch number, those of one slug as one: the first batch's name and type, the greatest confidence, the longest description, the first of
    equals; sorted sources, documents and names; the sum of rows."""
    d = batches
    length = F.coalesce(F.length("description"), F.lit(0))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return d.groupBy("entity_id").agg(
        F.min_by("name", "batch").alias("name"), F.min_by("type_str", "batch").alias("type_str"), F.max("confidence").alias("confidence"), F.max_by("description", F.struct(length, -F.col("batch"))).alias("description"),
        every("source_ids"), every("document_ids"), every("aliases"), F.sum("occurrence_count").alias("occurrence_count"),
    )


def compact_batches(spark: SparkSession, path: str, target: str) -> None:
    """merged_batches as one batch under target, to go on from."""
    merged_batches(spark, path).write.mode("overwrite").parquet(f"{target}/batch=0")


def running_rates(results: DataFrame, group: str, hit: str, name: str) -> StreamingQuery:
    """Hit rates per group, kept up to date in a memory table."""
    d = results.groupBy(group).agg(F.count("*").alias("questions"), F.avg(F.col(hit).cast("double")).alias("rate"))
    return d.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per tumbling window and keys, late rows up to `late` counted in; for streams and batches alike."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    g = d.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), *keys, "n")
