import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from glenfare.llm import sharding as S
from helpers import SF, as_rows, documents, edge_docs, empty_docs


def test_contract(spark):
    out = S.op6_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    assert len(out) == len(docs) and {r["shard"] for r in out} <= set(range(24))
    slots = defaultdict(list)
    for r in out:
        t = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 8, zlib.crc32(t), "key")
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r["grown_shard"] == 24 for r in out)


def moved(spark, before, after, n=20000):
    keys = spark.range(n)
    both = S.place(S.place(keys, F.col("id"), before, "a"), F.col("id"), after, "b")
    return both.groupBy("a", "b").count().collect()


def test_weights_and_confined_movement(spark):
    leaves = S.tree(24)
    rows = moved(spark, leaves, S.tree(25))
    assert all(r["a"] == r["b"] or r["b"] == 24 for r in rows)
    share = sum(r["count"] for r in rows if r["b"] == 24) / 20000
    assert abs(share - 1 / 25) < 0.01
    heavier = [S.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in leaves]
    rows = moved(spark, leaves, heavier)
    assert all(r["a"] == r["b"] or r["b"] == 5 for r in rows)  # a raised weight only draws rows in
    assert abs(sum(r["count"] for r in rows if r["b"] == 5) / 20000 - 3 / 26) < 0.015
    gone = [S.Leaf(x.region, x.rack, x.shard, 0.0 if x.shard == 5 else 1.0) for x in leaves]
    rows = moved(spark, leaves, gone)
    assert all(r["a"] == r["b"] or r["a"] == 5 for r in rows)


def test_descent_is_the_least_draw(spark):
    leaves = S.tree(24)
    df = S.place(spark.range(500), F.col("id"), leaves)
    draws = F.array(*[S.draw(F.col("id"), x) for x in leaves])
    flat = df.withColumn("least", F.array_position(draws, F.array_min(draws)) - 1)
    assert flat.filter("least <> shard").isEmpty()


def test_edges_and_hot_key(spark):
    docs = edge_docs(spark)
    narrow = docs.select("doc_id", F.length("text").alias("size"))
    placed = S.with_slots(S.place(narrow, F.col("doc_id"), S.tree(3)), bucket_rows=2)
    assert placed.count() == docs.count()
    hot = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("doc_id"))
    out = S.with_slots(S.place(hot, F.col("doc_id"), S.tree(24)), bucket_rows=100)
    for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"),
                                      F.countDistinct("slot").alias("d")).collect():
        assert (r["lo"], r["hi"], r["d"]) == (0, r["n"] - 1, r["n"])
    none = empty_docs(spark).select("doc_id", F.lit(1).alias("size"))
    assert S.with_slots(S.place(none, F.col("doc_id"), S.tree(24))).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = S.op6_sharding(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
