"""Cold-start vectors, candidates of all users, sequence inputs, activation and loaders: hand-made cases and numpy."""

import base64
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fxlake.operators import activation as A
from fxlake.operators import candidates as C
from fxlake.operators import coldstart as R
from fxlake.operators import generation as G
from fxlake.operators import sequences as B
from fxlake.plans import generation as plans
from fxlake.sources import loaders, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TWINS = [
    "ridge_gram", "synthetic_neighbors", "preferred_pools", "generate_candidates", "random_candidates", "catalog_activation", "activation_gaps", "decode_embedding", "load_users", "load_products", "load_content",
    "behavior_sequences", "check_behavior_sequences", "sequence_inputs", "serving_pools",
]


def plain(rows):
    def one(v):
        if v is None:
            return ""
        return f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    theirs = con.execute(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    ours = plain(df.select(*columns).collect())
    assert ours and ours == plain(theirs)


# ---------------------------------------------------------------- ridge and synthetic vectors


@pytest.mark.parametrize("parts", [1, 7])
def test_ridge_is_numpy(spark, parts):
    rng = np.random.default_rng(parts)
    x, y = rng.normal(size=(60, 4)), rng.normal(size=(60, 3)) + 5
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "features array<double>, targets array<double>").repartition(parts)
    model = R.fit_ridge(df, alpha=0.5)
    wide = np.concatenate([x, np.ones((60, 1))], axis=1)
    penalty = np.diag([0.5] * 4 + [0.0])  # the bias has none
    np.testing.assert_allclose(model.weights, np.linalg.solve(wide.T @ wide + penalty, wide.T @ y), atol=1e-9)
    assert model.rows == 60
    got = np.array([r["predicted"] for r in R.predict_ridge(df, model).select("features", "predicted").collect()])
    np.testing.assert_allclose(np.linalg.norm(got, axis=1), np.ones(60))


def test_ridge_edges(spark):
    kind = "features array<double>, targets array<double>"
    hand = spark.createDataFrame([([1.0, 0.0, 0.0], [1.0, 0.0]), ([0.0, 1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0, 1.0], [1.0, 1.0])], kind)
    model = R.fit_ridge(hand, alpha=1e-3)
    rows = R.predict_ridge(hand.unionByName(spark.createDataFrame([(None, None)], kind)), model).collect()
    assert [r["predicted"] is None for r in rows] == [False, False, False, True] and all(abs(np.linalg.norm(r["predicted"]) - 1) < 1e-5 for r in rows[:3])
    for few in (hand.limit(1), hand.where("false")):
        with pytest.raises(ValueError, match="two rows"):
            R.fit_ridge(few)
    with pytest.raises(Exception, match="features"):
        R.predict_ridge(spark.createDataFrame([([1.0],)], "features array<double>"), model).collect()
    zero = R.Ridge(np.zeros((4, 2)), 1.0, 3)
    assert [r["predicted"] for r in R.predict_ridge(hand, zero).collect()] == [[0.0, 0.0]] * 3


def test_affinity(spark):
    shoe, near, far, bag = ("shoes", "a", 100.0), ("shoes", "a", 110.0), ("shoes", "a", 250.0), ("bags", "b", 500.0)
    rows = [(shoe, near), (shoe, far), (shoe, bag), (("", None, -1.0), ("", None, 5.0))]
    s = "struct<category:string,brand:string,price:double>"
    got = [r["a"] for r in spark.createDataFrame(rows, f"x {s}, y {s}").select(R.affinity("x", "y").alias("a")).collect()]
    assert got == pytest.approx([1.25 * 1.1, 1.25 * 1.1 * 0.8, 0.6, 1.0])


def test_softmax_weights(spark):
    df = spark.createDataFrame([([0.9, 0.4], [1.375, 0.6]), ([float("nan"), 0.5], [1.0, 1.0])], "s array<double>, a array<double>")
    first, odd = [r["w"] for r in df.select(R.softmax_weights(F.col("s"), F.col("a"), 0.07).alias("w")).collect()]
    logits = np.array([0.9, 0.4]) / 0.07 + np.log([1.375, 0.6])
    np.testing.assert_allclose(first, np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum())
    assert odd == [0.5, 0.5]  # not finite: all the same


def test_synthetic_embeddings_are_numpy(spark):
    items = plans._items(spark, SF).collect()
    unit = lambda v: np.zeros_like(v) if not np.linalg.norm(v) else v / np.linalg.norm(v)
    content = {r["id"]: unit(np.array(r["vector"])) for r in items}
    cf = {i: unit(np.array([r["vector"][k] - 0.5 * r["vector"][k + 8] for k in range(8)])) for r in items if (i := r["id"]) % 50}
    x = np.array([[*r["features"], 1.0] for r in items if r["id"] % 50])
    y = np.array([[r["vector"][k] - 0.5 * r["vector"][k + 8] for k in range(8)] for r in items if r["id"] % 50])
    penalty = np.eye(x.shape[1]) * 1e-2
    penalty[-1, -1] = 0
    weights = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    sets = {r["id"]: r for r in plans._sets(spark, SF).collect()}
    got = {r["id"]: r for r in plans.synthetic(spark, SF).collect()}
    assert got.keys() == sets.keys() and len(got) >= 5
    features = {r["id"]: r["features"] for r in items}
    for i, r in got.items():
        near = unit(sum(n["weight"] * cf[n["product_id"]] for n in sets[i]["neighbors"]))
        ridge = unit(np.array([*features[i], 1.0]) @ weights)
        np.testing.assert_allclose(r["vector"], unit(0.65 * near + 0.35 * ridge), atol=1e-6)
        assert all(abs(n["similarity"] - content[i] @ content[n["product_id"]]) < 1e-5 for n in sets[i]["neighbors"]) and 0 < r["confidence"] <= 1


def test_neighbour_sets_need_enough(spark):
    kind = "id bigint, vector array<double>, facts struct<category:string,brand:string,price:double>"
    near = [(i, [1.0, 0.01 * i], ("c", "b", 1.0)) for i in range(1, 6)]
    products = spark.createDataFrame([(0, [1.0, 0.0], None), (9, [-1.0, 0.0], None), *near], kind)
    trained = products.where("id > 1").select("id", "vector")
    sets = R.neighbour_sets(products.where("id in (0, 9)"), products, trained, neighbours=3, least=3)
    assert [(r["id"], [n["product_id"] for n in r["neighbors"]]) for r in sets.collect()] == [(0, [2, 3, 4])]
    assert R.neighbour_sets(products.where("id = 0"), products, trained, neighbours=5, least=5).count() == 0


# ---------------------------------------------------------------- candidates


def test_preferred_pools_by_hand(spark):
    users = spark.createDataFrame(
        [("u1", ["a", None, " "], ["b", "a"], ["c"], None), ("u2", None, None, ["x", "x", "y", "z"], ["5"]), ("u3", None, None, None, ["5", "6", "7"]), ("u4", None, None, None, None)],
        "user_id string, context_categories array<string>, speech_categories array<string>, preferred_categories array<string>, content_clusters array<string>",
    )
    events = spark.createDataFrame([("u1", "p1", 1.0, "e1"), ("u1", "p2", 2.0, "e2"), ("u1", "p2", 3.0, "e3"), ("u1", "p9", 9.0, "e9"), ("u2", "p1", 1.0, "e1"), ("u3", "p1", 1.0, "e1"), ("u9", "p1", 1.0, "e1")], "user_id string, product_id string, event_time double, event_id string")
    clusters = spark.createDataFrame([("p1", 1), ("p2", 2), ("p3", None)], "product_id string, cluster int")
    got = sorted((r["user_id"], r["source"], r["place"], r["pool"], r["share"]) for r in G.preferred_pools(users, events, clusters).collect())
    assert got == [
        ("u1", "category_pool", 0, "category:a", 2), ("u1", "category_pool", 1, "category:b", 2), ("u1", "cluster_pool", 0, "cluster:2", 1),  # its two newest events are of one cluster
        ("u2", "category_pool", 0, "category:x", 2), ("u2", "category_pool", 1, "category:y", 2), ("u2", "cluster_pool", 0, "cluster:5", 2), ("u2", "cluster_pool", 1, "cluster:1", 2),
        ("u3", "cluster_pool", 0, "cluster:5", 2), ("u3", "cluster_pool", 1, "cluster:6", 2),
    ]


def frames(spark, **more):
    products = spark.createDataFrame([(f"p{i}", "c" if i % 2 else None) for i in range(40)], "product_id string, category string")
    pools = spark.createDataFrame([("global", f"p{i}", i, 1 - i / 100) for i in range(40)] + [("cluster:7", "p39", 1, 0.8), ("cluster:7", "p38", 2, 0.7)], "pool string, product_id string, rank int, score double")
    seen = spark.createDataFrame([("u1", "p0"), ("u1", "p39"), ("u1", "x")], "user_id string, product_id string")
    users = spark.createDataFrame([("u1",), ("u2",), ("u2",)], "user_id string")
    preferred = spark.createDataFrame([("u1", "cluster:7", "cluster_pool", 0, 1), ("u2", "cluster:8", "cluster_pool", 0, 1)], "user_id string, pool string, source string, place int, share int")
    new = spark.createDataFrame([("p0", 0.9), ("p1", 0.5)], "product_id string, score double")
    cf = spark.createDataFrame([("u1", "p2", 0.5), ("u1", "p0", 0.9), ("u1", "p3", 0.5), ("u3", "p1", 1.0)], "user_id string, product_id string, score double")
    return {"users": users, "sources": {"cf": cf, "content": cf}, "preferred": preferred, "pools": pools, "new_items": new, "seen": seen, "products": products} | more


def test_candidates_by_hand(spark):
    got = G.generate_candidates(**frames(spark), caps={"cf": 1, "content": 2, "trending_pool": 3, "new_item": 2, "random": 0}, diversity=None).collect()
    rows = {(r["user_id"], r["product_id"]): r for r in got}
    assert {u for u, _ in rows} == {"u1", "u2"} and not any(k in rows for k in (("u1", "p0"), ("u1", "p39")))
    first = rows["u1", "p2"]
    # cf leaves out seen products before its cap, content after it; the pool's three unseen are p1, p2, p3
    assert first["sources"] == "cf+content+trending_pool" and first["combined_score"] == pytest.approx(0.4 * 0.5 + 0.3 * 0.5 + 0.3 * 0.98)
    assert rows["u1", "p38"]["sources"] == "cluster_pool" and rows["u1", "p1"]["sources"] == "trending_pool+new_item" and rows["u1", "p3"]["sources"] == "trending_pool"
    assert {p for u, p in rows if u == "u2"} == {"p0", "p1", "p2"} and rows["u2", "p0"]["sources"] == "trending_pool+new_item"
    for user in ("u1", "u2"):
        mine = sorted((r for r in got if r["user_id"] == user), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and [r["combined_score"] for r in mine] == sorted((r["combined_score"] for r in mine), reverse=True)


def test_random_fallback_and_caps(spark):
    none = frames(spark)
    none = none | {"sources": {}, "pools": none["pools"].where("pool = 'none'"), "new_items": none["new_items"].where("false")}
    got = G.generate_candidates(**none, diversity=None).collect()
    by_user = {u: [r for r in got if r["user_id"] == u] for u in ("u1", "u2")}
    assert len(by_user["u2"]) == 10 and 8 <= len(by_user["u1"]) <= 10 and {r["sources"] for r in got} == {"random"}
    assert not {r["product_id"] for r in by_user["u1"]} & {"p0", "p39"}
    thin = G.generate_candidates(**frames(spark), caps={"trending_pool": 30}, target=33, diversity=None).collect()
    u2 = [r["sources"] for r in thin if r["user_id"] == "u2"]
    assert sum("trending_pool" in s for s in u2) == 30 and len(u2) <= 33
    assert G.generate_candidates(**frames(spark), most=4).where("user_id = 'u2'").count() == 4
    assert G.generate_candidates(**(frames(spark) | {"users": frames(spark)["users"].where("false")})).count() == 0


@pytest.mark.parametrize("n, need", [(1, 3), (2, 2), (12, 12), (97, 10), (100, 60)])
def test_draw_gives_different_items(spark, n, need):
    items = spark.range(n).select(F.format_string("p%04d", "id").alias("product_id"))
    users = spark.range(50).select(F.concat(F.lit("u"), "id").alias("user_id"), F.lit(need).alias("need"))
    rows = G.draw(users, items, 3).collect()
    per = {}
    for r in rows:
        per.setdefault(r["user_id"], []).append(r["product_id"])
    assert len(per) == 50 and all(len(set(p)) == len(p) == min(n, need) for p in per.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, G.draw(users.repartition(5), items.repartition(4), 3).collect()))
    if n == 97:
        assert len({p for ps in per.values() for p in ps}) > 90  # the whole catalog, not a part of it
    assert G.draw(users, items.where("false"), 3).count() == 0


def test_serving_pools_by_hand(spark):
    products = spark.createDataFrame([("a", "x", 5.0, 0, 0.0), ("b", None, 5.0, 0, -30 * 86400.0), ("c", "x", None, None, None)], "product_id string, category string, rating double, num_reviews int, created_at double")
    trend = spark.createDataFrame([("c", 0.1)], "product_id string, score double")
    clusters = spark.createDataFrame([("a", 7), ("b", 8), ("c", 7), ("c", None)], "product_id string, cluster int")
    got = {(r["pool"], r["product_id"]): (r["rank"], r["score"]) for r in C.serving_pools(products, trend, 0.0, top=2, clusters=clusters, per_cluster=1).collect()}
    assert got[("global", "a")] == (1, 1.0) and got[("global", "b")] == (2, 0.875)  # half the freshness after 30 days
    assert {p for p, _ in got} == {"global", "category:x", "category:unknown", "cluster:7", "cluster:8"} and ("cluster:7", "c") not in got and got[("category:x", "c")] == (2, 0.375)


# ---------------------------------------------------------------- sequences

EVENTS = "user_id string, product_id string, action string, event_time double, available_at double, event_id string"


def test_sequences_by_hand(spark):
    t = 4_000_000.0
    rows = [
        ("u", "old", "click", t - 31 * 86400, None, "e0"), ("u", "c1", "click", t - 30, None, "e1"), ("u", "c1", "click", t - 20, None, "e2"), ("u", "cart", "add_to_cart", t - 10, None, "e3"),
        ("u", "late", "purchase", t - 5, t + 1, "e4"), ("u", "future", "click", t, None, "e5"), ("u", "view", "view", t - 1, None, "e6"), ("u", " ", "click", t - 1, None, "e7"), ("v", "other", "click", t - 1, None, "e8"),
    ]
    built = B.behavior_sequences(spark.createDataFrame([("o", "u", "c1", t)], "observation_id string, user_id string, product_id string, as_of double"), spark.createDataFrame(rows, EVENTS), 3)
    got = {r["action"]: r for r in built.collect()}
    assert (got["click"]["product_ids"], got["click"]["mask"], got["click"]["event_times"], got["click"]["event_ids"]) == (["", "c1", "c1"], [0, 1, 1], [0.0, t - 30, t - 20], [None, "e1", "e2"])
    assert got["add_to_cart"]["product_ids"] == ["", "", "cart"] and got["purchase"]["mask"] == [0, 0, 0]
    assert B.check_behavior_sequences(built, 3).count() == 0


def test_sequences_are_brute_force(spark):
    """Late events, ties, several users, more events than places; some observations have more unseen events than places."""
    rng, rows, obs = random.Random(5), [], []
    for i in range(900):
        at = rng.randint(0, 400) * 100.0
        rows.append((f"u{rng.randint(0, 2)}", f"p{rng.randint(0, 9)}", rng.choice(["click", "purchase", "view"]), at, rng.choice([None, at, at + 50, at + 20000, at - 300]), f"e{i:04d}"))
    for i in range(150):
        obs.append((f"o{i}", f"u{rng.randint(0, 3)}", f"p{rng.randint(0, 9)}", rng.randint(0, 420) * 100.0))
    built = B.behavior_sequences(spark.createDataFrame(obs, "observation_id string, user_id string, product_id string, as_of double"), spark.createDataFrame(rows, EVENTS), 4, days=1)
    got = {(r["observation_id"], r["action"]): [(p, t, e) for p, t, e, m in zip(r["product_ids"], r["event_times"], r["event_ids"], r["mask"]) if m] for r in built.collect()}
    for o, user, _, t in obs:
        for action in ("click", "add_to_cart", "purchase"):
            seen = sorted((at, e, p) for u, p, a, at, av, e in rows if u == user and a == action and t - 86400 <= at < t and (at if av is None else av) <= t)
            assert got[o, action] == [(p, at, e) for at, e, p in seen[-4:]]
    assert B.check_behavior_sequences(built, 4, days=1).count() == 0


def test_sequence_inputs_by_hand(spark):
    t = 1_000_000.0
    rows = [("u", "p1", "click", t - 86400, None, "a"), ("u", "zz", "click", t - 10, None, "b"), ("u", "p2", "purchase", t - 2 * 86400, None, "c")]
    obs = spark.createDataFrame([("o1", "u", "p2", t), ("o2", "u", "unknown", t), ("o3", "nobody", "p1", t)], "observation_id string, user_id string, product_id string, as_of double")
    index = spark.createDataFrame([("p1", 1), ("p2", 2)], "product_id string, item int")
    got = {r["observation_id"]: r for r in B.sequence_inputs(obs, B.behavior_sequences(obs, spark.createDataFrame(rows, EVENTS), 3), index, 3).collect()}
    one = got["o1"]
    assert one["candidate"] == 2 and one["items"] == [[0, 1, 0], [0, 0, 0], [0, 0, 2]] and one["known"][0] == [False, True, False]
    assert one["recency"][0] == pytest.approx([0, math.log(2), 0]) and one["recency"][2] == pytest.approx([0, 0, math.log(3)])
    assert one["summary"] == pytest.approx([2, 0.5, math.log(2), 1, 0, 0, 0, 0, 1, 1, math.log(3), 1])
    assert got["o2"]["candidate"] == 0 and got["o2"]["summary"] == [0.0] * 12 and got["o2"]["items"] == one["items"]
    assert got["o3"]["summary"] == [0.0] * 12 and got["o3"]["items"] == [[0, 0, 0]] * 3 and got["o3"]["candidate"] == 1


# ---------------------------------------------------------------- activation and loaders


def test_activation(spark):
    rows = spark.createDataFrame([("p1", '{"b": 1.0, "a": 2}'), ("p2", "{}"), ("p3", '{"x": "y"}')], "product_id string, snapshot string")
    outbox, one = A.prepare_catalog_activation(rows, "v1", 5.0, 6.0)
    _, again = A.prepare_catalog_activation(rows.orderBy(F.desc("product_id")).repartition(3), " v1 ", 9.0, 9.0)
    assert one == again and one["expected_count"] == 3
    assert A.prepare_catalog_activation(rows.limit(2), "v1", 5.0, 6.0)[1]["manifest_hash"] != one["manifest_hash"]
    history = outbox.select("event_id", "payload_hash")
    assert A.activation_gaps(outbox, history.unionByName(history), one).count() == 0
    lost = A.activation_gaps(outbox, history.where("event_id <> '{}'".format(outbox.where("product_id = 'p2'").first()["event_id"])), one).collect()
    assert [r["reason"] for r in lost] == ["missing"]
    assert [r["reason"] for r in A.activation_gaps(outbox.limit(2), history, one).collect()] == ["count"]
    for bad in ([("p1", "{}"), ("p1", "{}")], [(" ", "{}")], [("p1", "[1]")], [("p1", None)]):
        with pytest.raises(ValueError):
            A.prepare_catalog_activation(spark.createDataFrame(bad, "product_id string, snapshot string"), "v1", 1.0, 1.0)
    with pytest.raises(ValueError):
        A.activation_id(" ")


def test_decode_embedding_is_numpy(spark):
    rng = np.random.default_rng(1)
    odd = np.array([0.0, -0.0, 1e-45, -1e-40, 3.4e38, np.inf, -np.inf, np.nan, 1.17549435e-38], dtype="<f4")
    good = [rng.normal(size=n).astype("<f4") for n in (6, 3, 9, 1)] + [odd[:6], odd[3:9]]
    texts = [base64.b64encode(x.tobytes()).decode() for x in good]
    texts = texts + [texts[0][:10] + "\n" + texts[0][10:], None, "", "AAA", "!!!", base64.b64encode(b"12345").decode()]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(loaders.decode_embedding(F.col("t"), 6).alias("v")).collect()]
    for x, v in zip(good, got):
        want = np.zeros(6, dtype="<f4")
        want[: min(6, len(x))] = x[:6]
        np.testing.assert_array_equal(np.array(v, dtype="<f4"), want)
    assert got[6] == got[0] and all(v == [0.0] * 6 for v in got[7:])


def test_csv_loaders(spark, tmp_path):
    (tmp_path / "p.csv").write_text('product_id,title,product_category,price_value,availability,product_rating\np1,"A ""big""\nthing",x,1.50,AVAILABLE,\np2,,,,sold,4\n')
    rows = {r["product_id"]: r for r in loaders.load_products(spark, f"file://{tmp_path}/p.csv", 7.0).collect()}
    assert rows["p1"]["description"] == 'A "big"\nthing - x' and (rows["p1"]["price"], rows["p1"]["in_stock"], rows["p1"]["rating"], rows["p1"]["currency"], rows["p1"]["tags"]) == (1.5, True, None, "USD", ["x", "Unknown"][:1] + [""])
    assert (rows["p2"]["in_stock"], rows["p2"]["rating"], rows["p2"]["description"]) == (False, 4.0, " - ")
    (tmp_path / "u.csv").write_text("user_id,country\nu1,DE\n")
    user = loaders.load_users(spark, f"file://{tmp_path}/u.csv", 7.0).first()
    assert user["demographics"]["country"] == "DE" and user["demographics"]["membership_level"] == "Silver" and user["last_active"] == 7.0
    vector = base64.b64encode(np.arange(128, dtype="<f4").tobytes()).decode()
    (tmp_path / "c.csv").write_text(f'video_id,ocr_text,scene_labels,audio_transcript,visual_embedding_128d\nv1," a , ,b,c,d",,{"x" * 150},{vector}\nv2,,s,,\n')
    one, two = loaders.load_content(spark, f"file://{tmp_path}/c.csv").orderBy("content_id").collect()
    assert one["extracted_text"] == ["a", "b", "c", "d"] and one["product_mentions"] == ["x" * 100, "a", "b", "c"] and len(one["visual_embedding"]) == 512 and one["visual_embedding"][:3] == [0.0, 1.0, 2.0]
    assert two["product_mentions"] == [] and two["audio_features"]["has_audio"] is False and sum(two["visual_embedding"]) == 0 and two["text_features"]["quality_score"] == 0.5


def test_run_once_after_a_broken_run(spark, tmp_path):
    path = f"file://{tmp_path}"
    (tmp_path / "run_id=r").mkdir()  # a run that ended before its rows
    build = lambda n: lambda: spark.range(n)
    assert tables.run_once(spark, path, "r", build(3)).count() == 3 and tables.run_once(spark, path, "r", build(5)).count() == 3


def test_candidates_make_their_users_once(spark, monkeypatch):
    from fxlake.plans import generation as plans

    made, users = [], plans._users
    monkeypatch.setattr(plans, "_users", lambda *a: made.append(a) or users(*a))
    plans._generated(spark, "/root/testdata/sf0.001", caps={"random": 0}, diversity=None)
    assert len(made) == 1
