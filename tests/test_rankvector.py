"""Ranking vector blocks and two-tower inputs: hand cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fxlake.operators import features as X
from fxlake.operators import learning as L
from fxlake.operators import rankvector as V
from fxlake.operators import windows as W

EVENT = "event_id string, user_id string, product_id string, action string, event_time double"
ROW = "row_id string, user_id string, product_id string, category string, as_of double"


def _near(got, want):
    assert len(got) == len(want)
    assert all(abs(a - b) < 1e-5 for a, b in zip(got, want, strict=True)), (got, want)


def test_history_block(spark):
    day = 86400.0
    events = spark.createDataFrame(
        [("1", "u", "a", "click", 0.0), ("2", "u", "b", "click", day), ("3", "u", "none", "click", 2 * day), ("4", "u", "a", "purchase", 50 * day),
         ("5", "u", "b", "view", 2 * day), ("6", "u", "b", "click", 3 * day), ("7", "v", "a", "click", 0.0)], EVENT)
    vectors = spark.createDataFrame([("a", [1.0, float("nan")]), ("b", [0.0, 2.0]), ("long", [1.0, 1.0, 1.0])], "product_id string, vector array<double>")
    rows = spark.createDataFrame([("r", "u", "b", "c", 3 * day), ("late", "u", "long", "c", 90 * day), ("new", "w", "a", "c", 0.0)], ROW)
    got = {r.row_id: list(r.history) for r in V.history_block(rows, events, vectors, 2, n=3).collect()}
    # three clicks before the row, the one at its own time isn't; two have a vector
    _near(got["r"], [0.5, 1.0, 1.0, 2 / 3, 1.0, 1.0, 2.0] + [0, 0, 0, 0, 30, 0, 0] * 2)
    # the last three clicks of four; a purchase scales by 1.75 and lies beyond 30 days; a candidate's vector of another length is none
    _near(got["late"], [0.0, 2.0, 1.0, 2 / 3, 30.0, 1.0, 0.0] + [0, 0, 0, 0, 30, 0, 0] + [1.75, 0.0, 1 / 3, 1.0, 30.0, 1.0, 0.0])
    _near(got["new"], [0, 0, 0, 0, 30, 0, 0] * 3)


def test_last_positive_crosses_buckets_and_blocks(spark):
    events = spark.createDataFrame([(f"{i:03d}", "u", f"p{i}", "click", float(i // 2)) for i in range(100)], EVENT)  # pairs of equal times
    rows = spark.createDataFrame([(str(t), "u", "x", "c", t) for t in (0.0, 0.5, 7.0, 25.5, 200.0)], ROW)
    got = {}
    for r in X.last_positive(rows, events, 7, bucket_seconds=5).collect():
        got.setdefault(r.row_id, []).append((r.i, r.past))
    want = {str(t): [(i, f"p{i}") for i in range(100) if i // 2 < t][-7:] for t in (0.5, 7.0, 25.5, 200.0)}
    assert {k: sorted(v) for k, v in got.items()} == want


WINDOW = "entity_type string, entity_id string, window string, views long, clicks long, add_to_carts long, purchases long, click_through_rate double, conversion_rate double, window_end double"


def test_window_block(spark):
    windows = spark.createDataFrame(
        [("user", "u", "5m", 1000, 500, 0, 0, 0.5, 0.0, 100.0), ("user", "u", "5m", 2000, 0, 0, 0, 0.0, 0.0, 400.0), ("user", "u", "5m", 9, 9, 9, 9, 1.0, 1.0, 500.0),
         ("category", "c", "24h", 0, 0, 250, 1000, 0.0, 1.0, 300.0), ("product", "u", "5m", 7, 7, 7, 7, 1.0, 1.0, 100.0)], WINDOW)
    rows = spark.createDataFrame([("r", "u", "p", "c", 400.0), ("early", "u", "p", None, 99.0), ("blank", None, None, "", 900.0)], ROW)
    got = {r.row_id: list(r.windows) for r in V.window_block(rows, windows).collect()}
    _near(got["r"], [2.0, 0, 0, 0, 0, 0] + [0] * 42 + [0, 0, 0.25, 1.0, 0, 1.0])
    _near(got["early"], [0] * 54)
    _near(got["blank"], [0] * 54)


def test_window_block_of_events(spark):
    """Equal to the block of all windows, which it doesn't make: hot and rare entities, gaps, rows at slides' ends."""
    events = spark.range(400).select(
        F.col("id").cast("string").alias("event_id"), F.concat(F.lit("u"), (F.hash("id") % 3).cast("string")).alias("user_id"), F.concat(F.lit("p"), (F.hash("id", F.lit(1)) % 60).cast("string")).alias("product_id"),
        F.element_at(F.array(*map(F.lit, ("view", "click", "add_to_cart", "purchase", "x"))), 1 + F.pmod(F.hash("id", F.lit(2)), F.lit(5))).alias("action"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("c"), (F.col("id") % 2).cast("string"))).alias("product_category"), (F.lit(1704067200.0) + F.pmod(F.hash("id", F.lit(3)), F.lit(400000)) * F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.02)).alias("event_time"))
    events = events.withColumn("event_ts", F.timestamp_micros((F.col("event_time") * 1000000).cast("long")))
    rows = events.select(F.col("event_id").alias("row_id"), "user_id", "product_id", F.col("product_category").alias("category"), F.when(F.col("event_id") % 5 == 0, F.floor(F.col("event_time") / 3600) * 3600.0).otherwise(F.col("event_time") + 300).alias("as_of"))
    rows = rows.unionByName(spark.createDataFrame([("early", "u0", "p0", "c0", 1.0), ("blank", None, None, "", 1704400000.0), ("late", "u0", "p0", "c0", 1800000000.0)], ROW), allowMissingColumns=True)
    out = V.window_block_of_events(rows, events)
    got = {r.row_id: list(r.windows) for r in out.collect()}
    assert got == {r.row_id: list(r.windows) for r in V.window_block(rows, W.all_window_features(events)).collect()}
    assert len(got) == 403 and sum(map(any, got.values())) > 350 and not any(got["blank"] + got["early"])


@pytest.mark.parametrize("name", list(W.WINDOWS))
def test_windows_are_made_where_slides_lie(spark, name):
    """Counts by hand; no shuffle moves a row for each window."""
    seconds, length = W.slide_seconds(name)
    r = random.Random(3)
    seen = [(r.choice("ab"), r.choice("xyz"), r.choice([0, 1, 2, 3, 5, 40, 41, 90]) + r.randint(0, 30), r.randint(1, 9)) for _ in range(150)]
    cells = {(t, e, s): n for t, e, s, n in seen}
    slides = spark.createDataFrame([(t, e, s, n, 0, 1, 2, n + 3) for (t, e, s), n in cells.items()], "entity_type string, entity_id string, slide long, views long, clicks long, add_to_carts long, purchases long, total_events long")
    want = {}
    for (t, e, s), n in cells.items():
        for k in range(length):
            want[t, e, (s - k) * seconds] = want.get((t, e, (s - k) * seconds), 0) + n
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # entities go on in the next batch
    try:
        out = W.windows_of_slides(slides, name)
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(want) and {(x.entity_type, x.entity_id, x.window_start): x.views for x in got} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan


def test_blocks_go_behind_the_vector(spark):
    base = spark.createDataFrame([("r", [1.0])], "observation_id string, features array<float>")
    one, two = (spark.createDataFrame([("r", [x])], f"row_id string, {n} array<float>") for n, x in (("history", 2.0), ("windows", 3.0)))
    assert V.with_blocks(base, one, two).collect() == [("r", [1.0, 2.0, 3.0])]


def test_encodings_have_the_defaults(spark):
    users = spark.createDataFrame([("a", 101, 7200.0, None, 0.2, 0.06, ["x", "y"], 0.0), ("b", None, None, None, None, float("nan"), None, None)],
        "user_id string, total_interactions long, avg_session_length double, price_sensitivity double, click_through_rate double, conversion_rate double, preferred_categories array<string>, last_active double")
    got = {r.user_id: list(r.side) for r in X.user_encoding(users, 720 * 1800.0).collect()}
    _near(got["a"], [4.624973, 2.0, 0.5, 0.2, 0.06, 0.2, 0.5, 1, 1, 1])
    assert got["b"][:5] == [0, 0, 0.5, 0, 0] and got["b"][5:8] == [0, 0, 0]
    item = X.item_encoding(spark.createDataFrame([("p",)], "product_id string"), 0.0).collect()[0].side
    _near(item[:6], [0, 0.6, 0, 1, 0, 0])
    assert 0 <= item[6] < 1 and 0 <= item[7] < 1


def test_two_tower_tables(spark):
    events = spark.createDataFrame([("1", "b", "y", "click", 0.0), ("2", "a", "x", "other", 1.0), ("3", None, "x", "view", 1.0), ("4", "a", "", "view", 1.0)], EVENT)
    products = spark.createDataFrame([("z", 3.0)], "product_id string, price double")
    vectors = spark.createDataFrame([("y", [1.0, 2.0]), ("z", [1.0])], "product_id string, vector array<double>")
    negatives = spark.createDataFrame([("c", "w", "impression", 0.25)], "user_id string, product_id string, source string, weight double")
    users = spark.createDataFrame([("a", 10)], "user_id string, total_interactions long")
    got = X.two_tower_tables(events, products, vectors, users, negatives, 2, 0.0)
    assert [tuple(r) for r in got["users"].select("user", "user_id").orderBy("user").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    assert [(r.item, r.product_id, list(r.vector)) for r in got["items"].orderBy("item").collect()] == [(1, "w", [0, 0]), (2, "x", [0, 0]), (3, "y", [1, 2]), (4, "z", [0, 0])]
    assert sorted(map(tuple, got["samples"].collect())) == [(1, 2, 1.0), (2, 3, 2.0)]
    assert [tuple(r) for r in got["negatives"].collect()] == [(3, 1, "impression", 0.25)]
    assert got["samples"].where(F.col("weight").isNull()).count() == 0


@pytest.mark.parametrize("n", [1, 20])
def test_history_block_of_an_empty_table(spark, n):
    rows, events = spark.createDataFrame([], ROW), spark.createDataFrame([], EVENT)
    vectors = spark.createDataFrame([], "product_id string, vector array<double>")
    assert V.history_block(rows, events, vectors, 4, n=n).count() == 0


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_group_percentile_is_exact(spark, accuracy):
    """Against numpy, with ties, for groups of any size, also where the sketch is coarse."""
    rng = random.Random(5)
    groups = {"one": [4.0], "two": [1.0, 9.0], "ties": [7.0] * 300, "mixed": [float(rng.randrange(40)) for _ in range(1000)], **{f"n{n}": [rng.random() for _ in range(n)] for n in (20, 99, 100, 101, 102, 200, 3000)}}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "bucket string, value double")
    for q in (0.5, 0.99):
        got = {r.bucket: (r.n, r.clip) for r in L.group_percentile(rows, q, accuracy).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            assert got[g][0] == len(vs) and abs(got[g][1] - np.quantile(vs, q)) < 1e-12, (g, q)


def test_value_stats_of_few_and_null_values(spark):
    rows = spark.createDataFrame([("a", 2.0)] * 20 + [("b", 5.0), ("b", None)], "bucket string, value double")
    got = {r.bucket: (r.n, r.clip, r.std) for r in L.value_stats(rows).collect()}
    assert got["a"] == (20, 2.0, 0.0) and got["*"][0] == 21 and "b" not in got


def test_months_have_the_files_that_their_rows_need(spark, tmp_path):
    from fxlake.sources import tables as T

    rows = spark.range(300).select(F.col("id").cast("string").alias("event_id"), F.when(F.col("id") < 290, F.when(F.col("id") < 250, F.lit("2024-01-05")).otherwise("2024-02-05")).cast("timestamp").alias("event_ts"))
    T.write_monthly(rows, str(tmp_path / "m"), rows_per_file=50)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "m").iterdir() if p.is_dir()}
    assert files.keys() == {"month=2024-01", "month=2024-02", "month=__HIVE_DEFAULT_PARTITION__"} and 2 <= files["month=2024-01"] <= 5
    assert spark.read.parquet(str(tmp_path / "m")).count() == 300
    T.write_monthly(rows.where("false"), str(tmp_path / "none"))


def test_nearest_clusters_in_order(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "id long, vector array<double>")
    centroids = spark.createDataFrame([(7, [1.0, 0.0]), (3, [0.0, 1.0]), (5, [1.0, 0.0])], "cluster int, vector array<double>")
    got = sorted(map(tuple, L.assign_clusters(items, centroids, 2).select("id", "rank", "cluster", "score").collect()))
    assert got == [(1, 1, 5, 1.0), (1, 2, 7, 1.0), (2, 1, 3, 0.8), (2, 2, 5, 0.6)]


def test_categories_count_texts(spark):
    from fxlake.functions import scalars as S

    rows = [(1, ["A new PHONE and a laptop", "phone case", "a novel"]), (2, ["toy"] * 9), (3, [None, "nothing"]), (4, ["新款手機", "球鞋"]), (5, None)]
    got = spark.createDataFrame(rows, "id long, texts array<string>").select("id", S.category_scores(F.col("texts")).alias("c")).collect()
    assert {r.id: [tuple(x) for x in r.c or []] for r in got} == {1: [("books", 0.6), ("electronics", 0.7)], 2: [("toys", 1.0)], 3: [], 4: [("electronics", 0.6), ("fashion", 0.6)], 5: []}


def test_vectors_are_gathered_where_the_rows_are(spark, monkeypatch):
    """Two shuffles carried each of the last n vectors; small tables of vectors are in none now, large ones in one."""
    rows = spark.createDataFrame([("r1", "u", "p1", 100.0), ("r2", "u", "p9", 50.0)], "row_id string, user_id string, product_id string, as_of double")
    events = spark.createDataFrame([("e1", "u", "click", "p1", 10.0), ("e2", "u", "click", "p2", 60.0), ("e3", "u", "purchase", "p3", 70.0)], "event_id string, user_id string, action string, product_id string, event_time double")
    vectors = spark.createDataFrame([("p1", [1.0, 0.0]), ("p2", [0.0, 1.0])], "product_id string, vector array<double>")
    block = lambda: V.history_block(rows, events, vectors, 2)
    read = lambda df: {r["row_id"]: [round(x, 6) for x in r["history"]] for r in df.collect()}
    small = read(block())
    assert small["r1"][:2] == [0.5, 0.5] and small["r2"][:2] == [1.0, 0.0] and small["r1"][6] == 0.5
    repartitioned = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")
    assert repartitioned(block()) == 1
    monkeypatch.setattr(V, "BROADCAST_NUMBERS", 0)
    assert read(block()) == small and repartitioned(block()) == 1


def test_blocks_are_made_of_rows_with_a_base_vector(spark, monkeypatch):
    from fxlake.plans import rankvector as plans

    asked, own = [], V.history_block
    monkeypatch.setattr(plans.V, "history_block", lambda rows, *a: asked.append(rows.count()) or own(rows, *a))
    assert asked == [] and asked.append(plans._whole(spark, "/root/testdata/sf0.001").count()) is None and asked[0] == asked[1] > 0
