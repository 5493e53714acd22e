import json

import pytest
from pyspark.sql import functions as F

from lexigrid.sources import io
from lexigrid.streaming import incremental


def test_graph_file_with_either_edge_key(spark, tmp_path):
    for key in ("relations", "relationships"):
        p = tmp_path / f"{key}.json"
        p.write_text(json.dumps({"entities": [{"id": "a", "text": "A", "label": "ORG", "metadata": {"source_ids": ["x"]}}], key: [{"head": "a", "tail": "b", "type": "REQUIRES"}]}))
        e, r = io.read_graph(spark, str(p))
        assert e.first().name == "A" and e.first().source_ids == ["x"]
        assert (r.first().src, r.first().dst, r.first().relation_type) == ("a", "b", "REQUIRES")


def test_benchmark_dialects(spark, tmp_path):
    a = tmp_path / "a.csv"
    a.write_text("﻿STT,Category,Content,Article_IDs\n1,X,Hỏi gì?,59-2020-QH14:d206:k1;59-2020-QH14:d7\n", encoding="utf-8")
    r = io.read_benchmark(spark, str(a)).first()
    assert r.qid == "1" and r.expected == [7, 206]
    b = tmp_path / "b.csv"
    b.write_text("question,article_ids\nQ,x:d3\n", encoding="utf-8")
    assert io.read_benchmark(spark, str(b)).first().expected == [3]


def test_checkpoint_resume_and_cache(spark, tmp_path):
    c = io.Checkpointed(spark, str(tmp_path / "c"), "id")
    seen = []

    def step(d):
        seen.append(d.count())
        return d.withColumn("y", F.col("id") * 2)

    c.run(spark.range(5), step)
    assert c.run(spark.range(8), step).count() == 8 and seen == [5, 3]
    p = spark.createDataFrame([("a",), ("b",), ("b",)], "prompt string")
    cache = p.limit(1).select(io.cache_key(F.col("prompt")).alias("cache_key"), F.lit("A").alias("response"))
    r = {(x.prompt, x.response) for x in io.with_model(p, cache, str.upper).collect()}
    assert r == {("a", "A"), ("b", "B")}


def test_config():
    c = io.Config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}})
    assert c.get("a.b") == 3 and c.get("a.c") == 2 and c.get("x.y", 5) == 5


def test_streaming_merge(spark, tmp_path):
    schema = "name string, type_str string, description string, confidence double, source_id string, document_id string, ord long"
    src = tmp_path / "in"
    for i, rows in enumerate(([("Một", "T", "d", 0.5, "s", "D", 1)], [("một", "T", "e", 0.6, "s", "D", 2), ("Hai", "T", "f", 0.7, "s", "D", 3)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(src))
        q = incremental.merge_entities(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("entity_id").collect()) == ["hai", "mot"]


def test_every_query_is_registered():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_a_cluster_needs_a_shared_folder():
    import types

    from lexigrid import session

    nothing = types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isEmpty=lambda: True))
    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: d), sparkContext=types.SimpleNamespace(master="spark://host:7077", _jsc=types.SimpleNamespace(sc=lambda: nothing)))
    with pytest.raises(RuntimeError):
        session.shared_dir(fake)
    fake.conf = types.SimpleNamespace(get=lambda k, d: "/shared")
    assert session.shared_dir(fake) == "/shared"
