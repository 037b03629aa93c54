"""Rendezvous sharding: bids as written down, moves, proportions, slots."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fxlake.llm import ordering, sharding

SF = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, "ü😀 " * 9), (4, "x" * 200000), (5, "a"), (5, "a"), (5, "b"), (None, "no id"), (None, "no id"), (-6, "negative")]


def shard_of(key, weights):
    def bid(i):
        u = (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -weights[i] / math.log(u)

    return max(range(len(weights)), key=lambda i: (bid(i), -i))


def test_query_is_brute_force(spark):
    rows = sharding.op12_sharding(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"key"}
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        assert (r["shard"], r["grown_shard"]) == (shard_of(r["doc_id"], [1.0] * 40), shard_of(r["doc_id"], [1.0] * 41))
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    for numbers in slots.values():
        assert [s for s, _ in sorted(numbers)] == list(range(len(numbers))) and sorted(numbers) == sorted(numbers, key=lambda x: x[1])


def test_weights_and_moves(spark):
    keys = spark.range(20000)
    weights = [1.0, 2.0, 0.5, 4.0]
    got = {r["id"]: r for r in sharding.assign(keys, "id", weights, 2.5).collect()}
    share = Counter(r["shard"] for r in got.values())
    assert all(abs(share[i] / 20000 - w / 7.5) < 0.015 for i, w in enumerate(weights))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in got.values()) and abs(sum(r["grown_shard"] == 4 for r in got.values()) / 20000 - 0.25) < 0.015
    fewer = {r["id"]: r["shard"] for r in sharding.assign(keys, "id", weights[:3]).collect()}
    assert all(fewer[i] == r["shard"] for i, r in got.items() if r["shard"] != 3)
    heavier = {r["id"]: r["shard"] for r in sharding.assign(keys, "id", [1.0, 3.0, 0.5, 4.0]).collect()}
    assert all(heavier[i] in (r["shard"], 1) for i, r in got.items())


def test_edges(spark):
    df = spark.createDataFrame(EDGE, "doc_id bigint, text string")
    placed = sharding.assign(df, "doc_id", [1.0] * 3)
    got = sharding.slots(placed, "shard", ["doc_id", "text"]).collect()
    assert len(got) == len(EDGE) and {r["shard"] for r in got if r["doc_id"] is None} == {shard_of("", [1.0] * 3)}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.slots(placed.where("false"), "shard", ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="already"):
        sharding.assign(df.withColumn("Shard", F.lit(1)), "doc_id", [1.0])
    for wrong in ([], [1.0, 0.0], [float("inf")], [float("nan")]):
        with pytest.raises(ValueError, match="weights"):
            sharding.assign(df, "doc_id", wrong)


def test_hot_key_is_numbered_by_many_tasks(spark):
    df = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    placed = sharding.assign(df.repartition(5), "doc_id", [1.0, 1.0])
    numbers = ordering.numbered(placed, ["shard"], [F.col("doc_id"), F.col("text")], "slot", "hot")
    assert sorted(r["slot"] for r in numbers.collect()) == list(range(3000))


def test_files(spark, tmp_path):
    df = sharding.slots(sharding.assign(spark.range(1000), "id", [1.0, 3.0]), "shard", ["id"])
    sharding.write_shards(df, f"file://{tmp_path}/out", rows_a_file=100)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in back.select("id", "shard", "slot").collect()) == sorted(tuple(r) for r in df.collect())
    assert len(list((tmp_path / "out" / "shard=1").glob("*.parquet"))) >= 7
