"""Hand-made cases of the core operators, and the SQL twins on the smallest tables."""

import math
import random
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fxlake.functions import scalars as S
from fxlake.operators import candidates as C
from fxlake.operators import features as X
from fxlake.operators import learning as L
from fxlake.operators import pit as P
from fxlake.operators import training as M
from fxlake.operators import windows as W
from fxlake.streaming import features as T

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TWINS = ["window_features_1h", "user_features", "running_user_features", "asof_user", "asof_item", "attribution", "pit_quarantine", "swing_index", "ltr_samples", "auc", "mean_ndcg", "entity_bucket", "stable_hash_bucket"]


def values(df):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df)


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = values(df.select(*columns).collect())
    theirs = con.execute(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert ours == values(theirs)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_without_a_session():
    """The driver reads the registry before it starts a session."""
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__spark_entry__.__file__).parent, check=True, timeout=120)


HISTORY = "k string, version string, event_time double, available_at double, source_event_id string, v int"


def asof(spark, history, t=100.0):
    obs = spark.createDataFrame([("o", "a", "v1", t)], "observation_id string, k string, version string, as_of double")
    return P.asof_latest(obs, spark.createDataFrame(history, HISTORY), "k", ["v"], bucket_seconds=30).first()["v"]


def test_asof_cases(spark):
    assert asof(spark, [("a", "v1", 10.0, 200.0, "x", 1)]) is None  # true before, available after
    assert asof(spark, [("a", "v1", 10.0, 10.0, "x", 1), ("a", "v1", 20.0, 20.0, "y", 2)]) == 2
    assert asof(spark, [("a", "v1", 20.0, 30.0, "x", 1), ("a", "v1", 20.0, 40.0, "y", 2)]) == 2  # later availability
    assert asof(spark, [("a", "v1", 20.0, 30.0, "x", 1), ("a", "v1", 20.0, 30.0, "y", 2)]) == 2  # tie by source id
    assert asof(spark, [("a", "v2", 20.0, 30.0, "x", 1)]) is None  # other version
    assert asof(spark, [("a", "v1", 90.0, 100.0, "x", 1), ("a", "v1", 10.0, 99.0, "y", 2)]) == 1  # an older record that comes late
    assert asof(spark, [("b", "v1", 1.0, 1.0, "x", 1)]) is None


def test_feedback_bounds(spark):
    obs = spark.createDataFrame([("o", "u", "p", 1000.0)], "observation_id string, user_id string, product_id string, as_of double")
    rows = [("e1", "u", "p", "click", 1.0, 1000.0, 1000.0), ("e2", "u", "p", "click", 1.0, 4600.0, 4600.0), ("e3", "u", "p", "click", 1.0, 4601.0, 4601.0), ("e4", "u", "p", "purchase", 1.0, 2000.0, 9999.0)]
    events = spark.createDataFrame(rows, "event_id string, user_id string, product_id string, action string, session_length double, event_time double, available_at double")
    found = P.feedback_interval(obs, events, 1, 9000.0)
    assert sorted(r["source_event_id"] for r in found.collect()) == ["e1", "e2"]
    assert P.attribution(found).first()["attributed_action"] == "click"
    assert P.feedback_interval(obs, events.where("false"), 1, 9000.0).first()["action"] is None


def test_attributed_value_and_its_key(spark):
    """The value is the first that reads as a number; its source is the first key that is there."""
    rows = ['{"margin": "n/a", "value": "2.5", "price": 9}', '{"price": 3}', '{"value": null, "gmv": 4}', '{"profit": "x"}', "{}", None, "no json"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string").select("i", *[c.alias(n) for c, n in zip(P.first_numeric(F.col("j")), ("v", "k"))]).orderBy("i").collect()
    assert [(r["v"], r["k"]) for r in got] == [(2.5, "margin"), (3.0, "price"), (4.0, "gmv"), (None, "profit"), (None, None), (None, None), (None, None)]
    fed = spark.createDataFrame([("o", "purchase", '{"price": 1}', 1.0, 1.0, "a"), ("o", "purchase", '{"margin": "?", "gmv": 7}', 2.0, 2.0, "b"), ("o", "click", '{"price": 99}', 3.0, 3.0, "c")], "observation_id string, action string, context_json string, event_time double, available_at double, source_event_id string")
    assert tuple(P.attribution(fed).first()) == ("o", "purchase", 1, 1, 7.0, "margin")


def test_impression_context_and_reasons(spark):
    long = "x" * 600
    cases = {
        '{"session_id": "s", "page": 1, "device": {"a": 1}, "surface": null, "priority": 2, "demo_mode": false}': '{"demo_mode":false,"priority":2,"session_id":"s"}',
        '{"location": [1, "a", [2], {"b": 3}, null, true]}': '{"location":[1,"a",null,true]}', f'{{"category": "{long}"}}': f'{{"category":"{long[:512]}"}}', f'{{"category": ["{long}"]}}': f'{{"category":["{long[:512]}"]}}',
        '{"category": [%s]}' % ", ".join(map(str, range(30))): '{"category":[%s]}' % ",".join(map(str, range(20))), "[1]": "{}", "{": "{}", '{"content_id": "a\\"b\\n"}': '{"content_id":"a\\"b\\n"}',
    }
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r["j"]: r["c"] for r in df.select("j", S.bounded_context(F.col("j")).alias("c")).collect()} == cases
    rows = [(0.6, 0.9, 0.9, 0.9, 0.9), (0.5, 0.6, 0.9, 0.9, 0.9), (None, 0.5, 0.6, 0.9, 0.9), (None, None, 0.5, 0.8, 0.9), (0.0, 0.0, 0.0, 0.7, 0.4), (0.0, 0.0, 0.0, 0.7, 0.3)]
    got = [r["t"] for r in spark.createDataFrame(rows, "a double, b double, c double, d double, e double").select(S.reason_text(*map(F.col, "abcde")).alias("t")).collect()]
    words = ["users with similar interests liked this", "matches the video content you're viewing", "trending among other users", "high engagement product", "frequently purchased", "recommended for you"]
    assert got == [f"Based on your preferences - {w}" for w in words]


def test_canonical_json(spark):
    row = spark.range(1).select(*[S.canonical_number(F.lit(x)).alias(n) for n, x in (("a", 42.0), ("b", 1e-7), ("c", -0.0), ("d", 10.5), ("e", 100.0))], S.canonical_json({"b": (F.lit('q"é'), "string"), "a": (F.lit(None).cast("double"), "number")}).alias("j")).first()
    assert [row[c] for c in "abcde"] == ["42", "0.0000001", "0", "10.5", "100"]
    assert row["j"] == '{"a":null,"b":"q\\"é"}'


def test_event_time(spark):
    rows = [("1700000000",), ("1700000000123",), ("2023-11-14T22:13:20Z",), ("0",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(S.event_time_ms(F.col("v"))).collect()]
    assert got == [1700000000000, 1700000000123, 1700000000000, None, None]


def test_window_counts(spark):
    rows = [("u", "p", " ", "click", 1), ("u", "p", None, "click", 61), ("u", "p", "c", "view", 400)]
    df = spark.createDataFrame(rows, "user_id string, product_id string, product_category string, action string, s int").withColumn("event_ts", F.timestamp_seconds("s"))
    out = W.window_features(df, "5m").collect()
    assert all(r["click_through_rate"] == 0.0 for r in out if r["views"] == 0)
    assert sum(r["total_events"] for r in out if r["entity_type"] == "user") == 15  # each event in five windows
    assert {r["entity_id"] for r in out if r["entity_type"] == "category"} == {"c"}


def loop_filter(rows, cap=3):
    """Round robin over categories, three uncategorised ones a round, as a plain loop."""
    if len(rows) <= 10:
        return {p for p, _ in rows}
    by, free = {}, [p for p, c in rows if c is None]
    for p, c in rows:
        if c is not None:
            by.setdefault(c, []).append(p)
    out, r = set(), 0
    while True:
        round_ = [v[r] for v in by.values() if r < cap and len(v) > r]
        out |= set(round_)
        take = 3 if not round_ else max(0, 3 - len(round_))
        out |= set(free[:take])
        free = free[take:]
        r += 1
        if not round_:
            return out


def test_diversity_filter(spark):
    rows = [(f"p{i:02}", [None, "a", "a", "b"][i % 4]) for i in range(24)]
    df = spark.createDataFrame([("u", p, c, i + 1) for i, (p, c) in enumerate(rows)], "user_id string, product_id string, category string, rank int")
    assert {r["product_id"] for r in C.diversity_filter(df).collect()} == loop_filter(rows)
    few = df.where("rank <= 10")
    assert C.diversity_filter(few).count() == 10


def test_mmr(spark):
    rows = [("s", "a", 1.0, [1.0, 0.0]), ("s", "b", 0.9, [1.0, 0.0]), ("s", "c", 0.5, [0.0, 1.0]), ("s", "d", 0.0, None)]
    df = spark.createDataFrame(rows, "slate_id string, product_id string, score double, vector array<double>")
    order = lambda keep: [r["product_id"] for r in L.mmr_slate(df, keep, 4).orderBy("rank").collect()]
    assert order(1.0) == ["a", "b", "c", "d"]
    assert order(0.5)[:2] == ["a", "c"]


def _mmr_by_hand(rows, keep, k):
    rows = sorted(rows, key=lambda r: (-r[2], r[1]))
    low, high = rows[-1][2], rows[0][2]
    base = [(r[2] - low) / (high - low) if high > low else 1.0 for r in rows]
    unit = [None if r[3] is None else np.array(r[3]) / np.linalg.norm(r[3]) for r in rows]
    chosen = []
    while len(chosen) < min(k, len(rows)):
        known = lambda i: [unit[i] @ unit[j] for j in chosen if unit[i] is not None and unit[j] is not None]
        worst = lambda i: max([*known(i), *([0.0] if not chosen or unit[i] is None or unit[chosen[0]] is None else [])])
        chosen.append(max((i for i in range(len(rows)) if i not in chosen), key=lambda i: (round(keep * base[i] - (1 - keep) * worst(i), 9), -i)))
    return [rows[i][1] for i in chosen]


def test_mmr_ranks_many_slates_in_batches(spark):
    r = random.Random(5)
    slates = {f"s{i}": [(f"s{i}", f"p{j}", r.randint(0, 4) / 4, None if r.random() < 0.3 else [r.uniform(-1, 1) for _ in range(3)]) for j in range(r.randint(1, 9))] for i in range(300)}
    df = spark.createDataFrame([row for rows in slates.values() for row in rows], "slate_id string, product_id string, score double, vector array<double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # slates go on in the next batch
    try:
        out = L.mmr_slate(df, 0.6, 5)
        got = out.groupBy("slate_id").agg(F.sort_array(F.collect_list(F.struct("rank", "product_id"))).alias("x")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {g["slate_id"]: [x["product_id"] for x in g["x"]] for g in got} == {s: _mmr_by_hand(rows, 0.6, 5) for s, rows in slates.items()}
    assert "MapInArrow" in out._jdf.queryExecution().toString()  # a pandas call for each slate took most of the time


def test_vector_topk_blocks(spark):
    rows = [(i, [float(i % 7) - 3, float(i % 5) - 2, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    one = L.vector_topk(df, df, 5, block=1000).orderBy("query_id", "rank").collect()
    assert one == L.vector_topk(df, df, 5, block=16).orderBy("query_id", "rank").collect()


def test_reconcile(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "event_id string")
    assert L.reconcile(ids("a", "b"), ids("a"), ids("b")).first()["ok"]
    bad = L.reconcile(ids("a", "b", "c"), ids("a", "a"), ids("z")).first()
    assert (bad["duplicates"], bad["missing"], bad["unexpected"], bad["ok"]) == (1, 2, 1, False)


def test_shadow_gate(spark):
    days = lambda *d: spark.createDataFrame([(f"2024-01-{x:02}", True) for x in d], "day string, passed boolean").withColumn("day", F.to_date("day"))
    assert L.shadow_gate(days(*range(1, 8)), "2024-01-07").first()["ok"]
    assert not L.shadow_gate(days(1, 2, 3, 5, 6, 7, 8), "2024-01-08").first()["ok"]  # gap
    assert not L.shadow_gate(days(*range(1, 8), 7), "2024-01-07").first()["ok"]  # repeated day
    assert not L.shadow_gate(days(*range(1, 8)), "2024-01-08").first()["ok"]  # stale


def test_parse_events(spark):
    rows = ['{"event_id":"1","user_id":"u","product_id":"p","action":"VIEW","event_time":5,"more":1}', "{bad", '{"event_id":"2","user_id":" ","product_id":"p","action":"view","event_time":5}', '{"event_id":"3","user_id":"u","product_id":"p","action":"view"}']
    got = [r["error"] for r in T.parse_events(spark.createDataFrame([(x,) for x in rows], "value string")).collect()]
    assert got == [None, "not_json", "missing_user_id", "bad_time"]


@pytest.mark.parametrize("name", ["stream_dedupe", "stream_user_features", "stream_parse"])
def test_streams(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert values(df.select(*columns).collect()) == values(con.execute(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall())


def test_weights_of_actions(spark):
    """Views count in sequences and item-to-item scores; an unknown action has weight 1 in popularity and trends."""
    rows = [("u1", "a", "view", 1.0), ("u1", "b", "view", 2.0), ("u2", "a", "view", 3.0), ("u2", "b", "purchase", 4.0), ("u3", "c", "wave", 5.0), ("u3", "c", "wave", 6.0)]
    events = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "event_id string, user_id string, product_id string, action string, event_time double")
    assert {(r["item_id"], r["neighbor_id"]) for r in C.swing_index(events).collect()} == {("a", "b"), ("b", "a")}
    assert C.SEEDS == {"view": 1.0, "click": 2.0, "add_to_cart": 3.0, "purchase": 5.0}
    for scores in (C.item_popularity(events), C.trending_scores(events, 6.0, decay=1.0)):
        raw = {r["product_id"]: r["score"] for r in scores.collect()}
        assert raw["c"] / raw["a"] == 1.0 and raw["b"] > raw["a"]
    assert {r["user_id"] for r in W.user_sequences(events).collect()} == {"u1", "u2"}


def test_ndcg_is_linear_over_whole_groups_with_averaged_ties(spark):
    rows = [("g", 0.9, 1.0), ("g", 0.5, 3.0), ("g", 0.5, 0.0), ("z", 0.1, 0.0), ("z", 0.2, 0.0), ("one", 0.3, 2.0)]
    got = L.mean_ndcg(spark.createDataFrame(rows, "g string, score double, relevance double"), "g").first()
    second, third = 1 / math.log2(3), 1 / 2
    assert got["groups"] == 2 and got["ndcg"] == round((1 + 1.5 * (second + third)) / (3 + second) / 2, 6)


def test_labels_prices_and_group_keys(spark):
    rows = [("a", "view", 0, 0, None), ("b", "click", 1, 0, None)]
    labels = L.build_labels(spark.createDataFrame(rows, "observation_id string, attributed_action string, attributed_click int, attributed_purchase int, attributed_value double"))
    assert {r["observation_id"]: (r["cvr"], r["cvr_mask"]) for r in labels.collect()} == {"a": (0, 0), "b": (0, 1)}
    texts = [("paid in USD", True), ("5 pounds", True), ("pounds of it", False), ("12.50", False), (None, False)]
    assert all(r["want"] == r["got"] for r in spark.createDataFrame(texts, "t string, want boolean").select("want", S.has_price_mention(F.col("t")).alias("got")).collect())
    none = F.lit(None).cast("string")
    keys = spark.createDataFrame([("u1", 3700.0), (None, -5.0)], "u string, t double").select(S.ltr_group_key(none, none, none, F.col("u"), F.col("t")).alias("k"))
    assert [r["k"] for r in keys.collect()] == ["user_time:u1:2", "user_time:unknown:0"]


def test_read_recommendations(spark):
    raw = [
        '{"user_id":"u1","impression_id":"top","metadata":{"impression_id":"i1","context":{"session_id":"s"},"displayed_items":[{"product_id":"p1","position":"3","price":5,"feature_snapshot":{"price":7},"source":"swing"},"text",7,null,{"position":1}]}}',
        '{"impression_id":"i2","metadata":{"user_id":"u2"},"displayed_items":[{"product_id":"p2","score":1}]}',
        '{"user_id":"u3","impression_id":"i3","displayed_items":[]}', '{"user_id":"u4","displayed_items":[{"product_id":"p"}]}', "no json", None,
    ]
    impressions, items = M.read_recommendations(spark.createDataFrame([(r,) for r in raw], "raw string"))
    assert sorted((r["impression_id"], r["user_id"], r["session_id"], r["n_items"]) for r in impressions.collect()) == [("i1", "u1", "s", 1), ("i2", "u2", None, 1)]
    one, two = sorted(items.collect(), key=lambda r: r["impression_id"])
    assert (one["position"], one["source"], one["feature_snapshot"]["price"], one["feature_snapshot"]["candidate_source"]) == (3, "swing", "7", "swing")
    assert (two["position"], two["source"]) == (0, None)


def test_feature_vector(spark):
    row = spark.createDataFrame([("o", 90000.0, 500, 0.2, 3600.0, 150.0)], "observation_id string, as_of double, total_interactions long, click_through_rate double, last_active double, price double")
    v = M.assemble_features(row).first()["features"]
    expected = [0.5, 0, 0, 0.2, 0, 0, 1, 1, 0, 1, math.log1p(150), 0.6, math.log(2), 1, 0, 0, 1]
    assert len(v) == 28 and v[:17] == pytest.approx(expected, abs=1e-6) and v[18:24] == pytest.approx([1 / 24, 4 / 6, 0, 0.05, 0, 0], abs=1e-6) and v[24:] == [0, 0, 0, 0]
    with pytest.raises(Exception, match="not finite"):
        M.assemble_features(row.withColumn("price", F.lit(float("nan")))).collect()


def test_bundle_hash_and_choice_of_rows(spark):
    rows = spark.createDataFrame([(1, None), (1, "s"), (1, "t")], "n int, seq string")
    hashes = [r["h"] for r in rows.select(M.bundle_hash({"n": F.col("n")}, {}, F.col("seq")).alias("h")).collect()]
    assert len(set(hashes)) == 3 and hashes[0] == rows.select(M.bundle_hash({"n": F.col("n")}, {}).alias("h")).first()["h"]
    given = spark.createDataFrame([(True,), (False,)], "has_sequence boolean")
    choose = lambda *a: M.choose_training_rows(*a)[1]
    assert choose(given, rows, rows, 2, 0.5) == "point_in_time" and choose(given, rows, rows, 2, 0.6) == "low_sequence_coverage"
    assert choose(given, rows, rows, 3, 0.5) == "too_few_point_in_time_rows"
    assert choose(None, given, rows, 2, 0.5) == "slates" and choose(None, given, rows, 3, 0.5) == "events" and choose(None, given, rows, 4, 0.5) == "too_few_rows"


def test_text_and_times(spark):
    texts = spark.createDataFrame([("\uff21\ufb01  Stra\u00dfe\u00a0x\n",), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(S.normalize_text(F.col("t"))).collect()] == ["afi strasse x", "", ""]
    one = spark.range(1).select(S.training_as_of(F.lit("x"), F.lit(None).cast("double"), F.lit("7.5"), F.lit(9)).alias("a"), S.training_as_of(F.lit("x")).alias("b")).first()
    assert (one["a"], one["b"]) == (7.5, 0.0)


@pytest.mark.parametrize("cap", [1, 3, 7, 100])
def test_pairs_up_to_a_cap(spark, cap):
    rows = [("a", i, (i * 7) % 4) for i in range(8)] + [("b", 1, 2), ("b", 2, 2)]
    plain = sorted((i, j) for g, i, x in rows for h, j, y in rows if g == h == "a" and x - y >= 0.5)[:cap]
    out = L.ltr_pairs(spark.createDataFrame(rows, "g string, position int, relevance int"), "g", cap=cap).collect()
    assert sorted((r["high"], r["low"]) for r in out) == plain


def test_dense_ids_of_keys_that_share_a_prefix(spark):
    keys = [f"imp{i:04d}" for i in range(500)] * 2 + [None]
    out = X.dense_ids(spark.createDataFrame([(k,) for k in keys], "k string"), "k", "i", parts=7).collect()
    assert {r["k"]: r["i"] for r in out} == {f"imp{i:04d}": i + 1 for i in range(500)} and len(out) == 500
    assert X.dense_ids(spark.createDataFrame([], "k string"), "k", "i").count() == 0


def test_rejected_candidates_by_hand(spark):
    many = ",".join(f'{{"product_id": "m{i}"}}' for i in range(60))
    rows = [
        ("i1", "u1", '{"rejected_candidate_items": [{"product_id": "p1"}, {"product_id": "p1"}, {"product_id": "p2"}, "p3", {"product_id": " "}, {}]}'), ("i2", "u1", '{"rejected_candidate_items": [{"product_id": "p2"}]}'),
        ("i3", "u2", f'{{"rejected_candidate_items": [{many}]}}'), ("i4", "u3", '{"rejected_candidate_items": "p1"}'), ("i5", "u3", None), ("i6", "u3", "{"),
    ]
    liked = spark.createDataFrame([("i1", "u1", "p2")], "impression_id string, user_id string, product_id string")
    got = L.rejected_negatives(spark.createDataFrame(rows, "impression_id string, user_id string, context string"), liked).collect()
    assert sorted((r["user_id"], r["product_id"]) for r in got if r["user_id"] == "u1") == [("u1", "p1"), ("u1", "p2")]  # p2 of the other impression
    assert {r["product_id"] for r in got if r["user_id"] == "u2"} == {f"m{i}" for i in range(50)} and len(got) == 52 and {(r["weight"], r["exposed"]) for r in got} == {(0.15, False)}
