"""Work of one task stays a share of the table: what findings on larger tables asked for."""

import re

from pyspark.sql import functions as F

from fxlake.operators import features as X
from fxlake.operators import learning as L
from fxlake.operators import training as R
from fxlake.plans import learning as P
from fxlake.sources import tables as T
from fxlake.sources.model import interactions

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_interactions_join_products_only_for_their_category(spark):
    events = interactions(spark, SF)
    assert "Join" not in plan(events.select("event_id", "user_id", "product_id", "action", "event_time"))
    direct = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("p_partkey")).join(spark.read.parquet(f"{SF}/part.parquet"), "p_partkey", "left")
    want = direct.select(F.col("event_id").cast("string"), "p_type")
    got = events.select("event_id", "product_category")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_months_have_a_task_for_each_file(spark, tmp_path):
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id") % 90 * 86400).alias("event_ts"))
    T.write_monthly(rows, str(tmp_path / "m"), rows_per_file=2_000)
    each = spark.read.parquet(str(tmp_path / "m")).groupBy(F.input_file_name().alias("f")).count().collect()
    parts = [re.search(r"part-(\d+)", r["f"])[1] for r in each]
    assert len(set(parts)) == len(parts) and max(r["count"] for r in each) < 2_400 and sum(r["count"] for r in each) == 40_000


def test_rows_of_one_bucket_meet_statistics_in_many_tasks(spark):
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for name, value in zip(old, ("false", "-1", "16"), strict=True):
        spark.conf.set(name, value)
    try:
        rows = spark.range(8_000).select(F.col("id").alias("row_id"), F.lit("a").alias("bucket"), F.col("id").cast("double").alias("value"))
        stats = L.value_stats(rows)
        spread = L.transform_values(rows, stats).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in spread) == 8_000 and max(r["count"] for r in spread) < 2_000
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_rejected_products_become_rows_after_the_last_shuffle(spark):
    text = '{"rejected_candidate_items":[{"product_id":" a "},"a",[1],{"product_id":"b"},{"product_id":""},{"x":1},{"product_id":"c"}]}'
    shown = spark.createDataFrame([("i", "u", text), ("i", "u", '{"rejected_candidate_items":[{"product_id":"a"},{"product_id":"d"}]}'), ("i", None, text), ("j", "u", None)], "impression_id string, user_id string, context string")
    liked = spark.createDataFrame([("i", "u", "b"), ("i", None, "b"), ("i", "u", None)], "impression_id string, user_id string, product_id string")
    out = L.rejected_negatives(shown, liked)
    assert sorted((r["user_id"] or "", r["product_id"]) for r in out.collect()) == [("", "a"), ("", "b"), ("", "c"), ("u", "a"), ("u", "c"), ("u", "d")]
    steps = plan(L.rejected_negatives(shown, liked))
    assert "Generate" in steps[: steps.index("Exchange")] and "Generate" not in steps[steps.index("Exchange") :]


def test_sampled_negatives_need_no_sorted_join(spark):
    liked = spark.createDataFrame([("u", "a"), (None, "b")], "user_id string, product_id string")
    found = spark.createDataFrame([("u", "a", "x"), ("u", "b", "y"), ("u", "b", "x"), ("u", "c", "y"), (None, "b", "x"), ("u", "e", "z")], "user_id string, product_id string, source string")
    out = X.sample_negatives(liked, found, {"x": 4, "y": 2}, 7)
    assert sorted((r["user_id"] or "", r["product_id"], r["source"]) for r in out.collect()) == [("", "b", "x"), ("u", "b", "x"), ("u", "c", "y")]
    assert "Join" not in plan(out)


def test_graded_slates_have_the_relevance_of_ltr_samples(spark):
    slates, feedback = P.slates(spark, SF), P.slate_feedback(spark, SF)
    cols = ["impression_id", "user_id", "product_id", "combined_score", "relevance"]
    a, b = L.graded_slates(slates, feedback).select(*cols), L.ltr_samples(slates, feedback).select(*cols)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    assert "SortAggregate" not in plan(L.graded_slates(slates, feedback)) and "ObjectHashAggregate" not in plan(L.graded_slates(slates, feedback))


def test_recommendations_are_parsed_once_for_filters(spark):
    text = '{"user_id":"u","impression_id":"i","metadata":{"impression_id":"m","displayed_items":["none",{"product_id":"p","position":2}]}}'
    events = spark.createDataFrame([(text,), ('{"user_id":"u","impression_id":"i","displayed_items":[{}]}',), ("{broken",), (None,)], "raw string")
    impressions, items = R.read_recommendations(events)
    filters = [line for line in plan(items).splitlines() if re.match(r"[ :+-]*(\*\(\d+\) )?Filter", line)]
    assert filters and not any("get_json_object" in line for line in filters)
    assert [(r["impression_id"], r["user_id"], r["n_items"]) for r in impressions.collect()] == [("m", "u", 1)]
    assert [(r["impression_id"], r["product_id"], r["position"]) for r in items.collect()] == [("m", "p", 2)]


def test_negatives_of_all_four_sources(spark):
    pairs = "user_id string, product_id string"
    liked = spark.createDataFrame([("u", "p0"), ("u", "p1"), ("w", "p0")], pairs)
    found = spark.createDataFrame([("u", f"p{i}", "x") for i in (0, 2, 3)] + [("u", f"p{i}", "y") for i in (2, 3)] + [("w", "p1", "x")], f"{pairs}, source string")
    catalog = spark.createDataFrame([(f"p{i}",) for i in range(10)], "product_id string")
    items = spark.createDataFrame([(f"p{i}", [1.0, i / 10]) for i in range(6)], "id string, vector array<double>")
    users = spark.createDataFrame([("u",), ("w",), ("new",)], "user_id string")

    def sample(total, hard):
        rows = X.sample_negatives(liked, found, {"x": 1, "y": 2}, 7, users, catalog, items, X.user_vectors(liked, items), total, hard).collect()
        return {u: sorted((r["source"], r["product_id"] or "", r["weight"]) for r in rows if r["user_id"] == u) for u in ("u", "w", "new")}

    out = sample(6, 2)
    kept = lambda u, source: [p for s, p, _ in out[u] if s == source]
    assert sorted(kept("u", "x") + kept("u", "y")) == ["p2", "p3"] and len(kept("u", "x")) == 1  # what the first source leaves, the second may take
    assert kept("u", "ann_hard") == ["p4", "p5"] and kept("w", "ann_hard") == ["p2", "p3"] and not kept("new", "ann_hard")  # nearest first, without positives and what is taken
    assert [len(out[u]) for u in out] == [6, 6, 6] and all(len({p for _, p, _ in out[u]}) == 6 for u in out)
    assert not {"p0", "p1"} & {p for _, p, _ in out["u"]} and {w for s, _, w in out["new"]} == {1.0} and {w for s, _, w in out["u"] if s == "ann_hard"} == {0.35}
    full = sample(12, 2)  # the catalog has too few
    assert [len(full[u]) for u in full] == [12, 12, 12] and [sum(p == "" for _, p, _ in full[u]) for u in full] == [4, 3, 2] and all(w == 0.0 for u in full for _, p, w in full[u] if p == "")
    assert [len(rows) for rows in sample(3, 2).values()] == [3, 3, 3]
    assert [X.hard_quota(15, e, 5) for e in range(5)] == [1, 3, 3, 3, 3] and X.hard_quota(15) == 3 and X.hard_quota(15, cap=1.0) == 7
