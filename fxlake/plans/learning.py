"""Queries of slates, negatives, labels, values, metrics, vectors and quality reports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.operators import candidates as C
from fxlake.operators import learning as L
from fxlake.operators import windows as W
from fxlake.plans.core import _ALL, _BASE, _FANOUT, _window_sql, pit_base
from fxlake.sources.model import catalog, interactions, oracle, slate_feedback, slates, table

QUERIES, ORACLE_SQL = {}, {}
SLATE_NOW = 902102400.0 + 86400 * 30


def query(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLE_SQL[name] = sql


# ---------------------------------------------------------------- slates and negatives

_REL = "case action when 'purchase' then 3 when 'add_to_cart' then 2 when 'click' then 1 else 0 end"
_LTR = f"""best as (select * from feedback qualify row_number() over (partition by impression_id, product_id, user_id order by {_REL} desc, occurred_at desc, event_id desc) = 1),
ltr as (select s.impression_id, s.user_id, s.product_id, position, combined_score, coalesce(action, 'view') as action, value, {_REL} as relevance from slates s left join best b using (impression_id, product_id, user_id))"""
_S, _F = "slates feedback", "ltr"


def ltr(spark, sf_dir) -> DataFrame:
    return L.ltr_samples(slates(spark, sf_dir), slate_feedback(spark, sf_dir))


query("ltr_samples", oracle(_S, f"{_LTR} select impression_id, user_id, product_id, position, round(combined_score, 6) as combined_score, action, value, relevance from ltr"), lambda s, d: ltr(s, d).withColumn("combined_score", F.round("combined_score", 6)))
_NEG = """imp as (select user_id, product_id, 'impression' as source, 0.25::double as weight, true as exposed from slates s anti join feedback f using (impression_id, product_id, user_id))"""
_REJ = """rej as (select distinct impression_id, user_id, product_id from (select impression_id, user_id, 'p' || ((substr(s.product_id, 2)::bigint + k) % 97) as product_id,
  row_number() over (partition by impression_id, user_id order by position, s.product_id, k) as rn from slates s, range(1, 13) r(k)) where rn <= 48),
rejected as (select user_id, product_id, 'rejected' as source, 0.15::double as weight, false as exposed from rej anti join feedback using (impression_id, user_id, product_id))"""
_neg = lambda s, d: L.impression_negatives(slates(s, d), slate_feedback(s, d))


def _rejecting(spark, sf_dir) -> DataFrame:
    """Impressions whose context names twelve rejected products for each one shown, after an entry that is no object and one
    without a product: beyond four products shown, some fall behind the first 50."""
    shown = F.sort_array(F.collect_list(F.struct("position", "product_id")))  # an order's items
    # a number of tasks, as Spark would join partitions by their bytes, which are few before the lists are made
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = slates(spark, sf_dir).repartition(tasks, "impression_id", "user_id").groupBy("impression_id", "user_id").agg(shown.alias("l"))
    keys = F.transform("l", lambda x: F.substring(x["product_id"], F.lit(2), F.lit(20)).cast("long"))
    others = F.flatten(F.transform(keys, lambda key: F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: ((key + k) % 97).cast("string"))))
    items = F.concat(F.lit('{"product_id":" p'), F.array_join(others, '","position":1},{"product_id":" p'), F.lit('","position":1}'))
    return listed.select("impression_id", "user_id", F.concat(F.lit('{"device":"web","rejected_candidate_items":["none",{"product_id":" "},'), items, F.lit("]}")).alias("context"))


_rej = lambda s, d: L.rejected_negatives(_rejecting(s, d), slate_feedback(s, d))
query("impression_negatives", oracle(_S, f"{_NEG} select * from imp"), _neg)
query("rejected_negatives", oracle(_S, f"{_REJ} select * from rejected"), _rej)
query("all_negatives", oracle(_S, f"{_NEG}, {_REJ} select source, count(*) as n, sum(weight) as weight from (select * from imp union all select * from rejected) group by 1"), lambda s, d: L.all_negatives(_neg(s, d), _rej(s, d)).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight")))
query(
    "flatten_slates",
    oracle("slates", f"recent as (select impression_id, max(created_at) as t from slates where created_at >= {SLATE_NOW} - 86400.0 * 90 group by 1 order by t desc, impression_id limit 500) select impression_id, product_id, position from slates join recent using (impression_id)"),
    lambda s, d: L.flatten_slates(slates(s, d), SLATE_NOW, 90, 500).select("impression_id", "product_id", "position"),
)
_WCOLS = ("views", "clicks", "purchases", "total_events")
query(
    "attach_window_features",
    oracle("interactions catalog", f"""{_FANOUT}, w as ({_window_sql('5m')} union all ({_window_sql('1h')}) union all ({_window_sql('24h')})),
last as (select * from w where entity_type = 'product' qualify row_number() over (partition by entity_id, "window" order by window_end desc) = 1)
select product_id, {', '.join(f"coalesce(max({c}) filter (where \"window\" = '{n}'), 0) as product_{n}_{c}" for n in W.WINDOWS for c in _WCOLS)}
from catalog left join last on entity_id = product_id group by product_id"""),
    lambda s, d: L.attach_window_features(catalog(s, d).select("product_id"), W.all_window_features(interactions(s, d)), "product", "product_id"),
)
query(
    "attach_training_metadata",
    oracle("interactions catalog", "select event_id, coalesce(category, 'unknown') as category, coalesce(brand, 'unknown') as brand, coalesce(price, 0) as price, coalesce(num_reviews, 0) as num_reviews, coalesce(in_stock, true) as in_stock from interactions left join catalog using (product_id)"),
    lambda s, d: L.attach_training_metadata(interactions(s, d).select("event_id", "product_id"), catalog(s, d)).select("event_id", "category", "brand", "price", "num_reviews", "in_stock"),
)
query(
    "displayed_snapshots",
    oracle("slates", """select impression_id, product_id, row_number() over (partition by impression_id order by combined_score desc, product_id) as rank, true as complete,
  sha256(concat_ws('|', impression_id, product_id, printf('%.6f', collaborative_score), printf('%.6f', content_similarity_score), printf('%.6f', popularity_score))) as bundle_hash from slates"""),
    lambda s, d: L.displayed_snapshots(slates(s, d)),
)

# ---------------------------------------------------------------- labels, values and metrics

query(
    "build_labels",
    oracle(_ALL, f"""{_BASE} select observation_id, attributed_click as ctr, attributed_purchase as cvr, attributed_purchase as ctcvr, attributed_click as cvr_mask,
  case when attributed_purchase = 1 and attributed_value is not null then 1 else 0 end as value_mask, coalesce(attributed_value, 0) as value,
  round(case when attributed_purchase = 1 then 4 + ln(1 + coalesce(attributed_value, 0)) else 1.0::double + case attributed_action when 'purchase' then 3 when 'add_to_cart' then 2 when 'click' then 1 else 0 end end, 6) as relevance,
  case when attributed_purchase = 1 and attributed_click <> 1 then 'purchase_without_click' when (attributed_action = 'purchase') <> (attributed_purchase = 1) then 'action_mismatch' when attributed_value < 0 then 'negative_value' end as error
from base where reason is null"""),
    lambda s, d: L.build_labels(pit_base(s, d).where("reason is null")),
)


def _values(spark, sf_dir) -> DataFrame:
    """Purchases with a value, by category and price band."""
    facts = catalog(spark, sf_dir).select("product_id", F.concat("category", F.lit(":"), F.floor(F.col("price") / 200).cast("string")).alias("bucket"))
    return slate_feedback(spark, sf_dir).where("action = 'purchase'").join(facts, "product_id").select(F.col("event_id").alias("row_id"), "bucket", "value")


_VALUES = """vals as (select event_id as row_id, category || ':' || floor(price / 200)::bigint as bucket, value from feedback join catalog using (product_id) where action = 'purchase'),
limits as (select bucket, quantile_cont(value, 0.99) as clip, count(*) as n from vals group by 1 having count(*) >= 20 union all select '*', quantile_cont(value, 0.99), count(*) from vals),
both_ as (select bucket, value from vals union all select '*', value from vals),
stats as (select bucket, n, round(max(clip), 6) as clip, round(avg(ln(1 + least(value, clip))), 6) as mean, round(stddev_pop(ln(1 + least(value, clip))), 6) as std from both_ join limits using (bucket) group by 1, 2)"""
query("value_stats", oracle("catalog feedback", f"{_VALUES} select * from stats"), lambda s, d: L.value_stats(_values(s, d)))
query(
    "transform_values",
    oracle("catalog feedback", f"""{_VALUES}, g as (select clip, mean, std from stats where bucket = '*')
select row_id, v.bucket, round((ln(1 + least(value, coalesce(s.clip, g.clip))) - coalesce(s.mean, g.mean)) / case when coalesce(s.std, g.std) > 1e-6 then coalesce(s.std, g.std) else 1 end, 6) as z
from vals v left join stats s on s.bucket = v.bucket, g"""),
    lambda s, d: (lambda v: L.transform_values(v, L.value_stats(v)))(_values(s, d)),
)
query(
    "business_score",
    oracle("feedback", "select event_id as row_id, round(0.5::double * 0.4::double * value, 4) as business_score, 0.41::double as confidence from feedback"),
    lambda s, d: L.business_score(slate_feedback(s, d).select(F.col("event_id").alias("row_id"), F.lit(0.5).alias("ctr"), F.lit(0.4).alias("cvr"), "value")).withColumn("business_score", F.round("business_score", 4)),
)
_SCORED = f"{_LTR}, sc as (select *, round(combined_score, 4) as score, (relevance > 0)::int as label from ltr)"
_scored = lambda s, d: L.graded_slates(slates(s, d), slate_feedback(s, d)).select("impression_id", F.round("combined_score", 4).alias("score"), "relevance", (F.col("relevance") > 0).cast("int").alias("label"))
query(
    "auc",
    oracle(_S, f"""{_SCORED}, r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as rank from sc),
t as (select sum(label * rank) as r, sum(label)::double as p, sum(1 - label)::double as q from r) select round((r - p * (p + 1) / 2) / (p * q), 6) as auc from t"""),
    lambda s, d: L.auc(_scored(s, d)),
)
query(
    "mean_ndcg",
    oracle(_S, f"""{_SCORED}, k as (select impression_id, score, relevance, 1 / log2(1 + row_number() over (partition by impression_id order by score desc)) as d,
  relevance / log2(1 + row_number() over (partition by impression_id order by relevance desc)) as ideal from sc),
t as (select impression_id, sum(relevance) * avg(d) as dcg, sum(ideal) as ideal, count(*) as n from k group by impression_id, score),
g as (select impression_id, sum(dcg) as dcg, sum(ideal) as ideal from t group by 1 having sum(n) > 1)
select count(*) as groups, round(avg(case when ideal > 0 then dcg / ideal else 0 end), 6) as ndcg from g"""),
    lambda s, d: L.mean_ndcg(_scored(s, d), "impression_id"),
)
query(
    "ltr_pairs",
    oracle(_S, f"""{_LTR}, p as (select a.impression_id, a.position as high, b.position as low from ltr a join ltr b using (impression_id) where a.relevance - b.relevance >= 0.5)
select impression_id, high, low from p qualify row_number() over (partition by impression_id order by high, low) <= 2048"""),
    lambda s, d: L.ltr_pairs(ltr(s, d), "impression_id"),
)
query(
    "masked_losses",
    oracle(_S, f"""{_LTR}, x as (select (relevance > 0)::int as y, (relevance = 3)::int as z, least(0.99::double, greatest(0.01::double, round(combined_score, 4))) as p, coalesce(ln(1 + value), 0) / 10 as v from ltr)
select round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as ctr_loss, round(avg(case when y = 1 then -(z * ln(p) + (1 - z) * ln(1 - p)) end), 6) as cvr_loss,
  round(avg(case when z = 1 then case when abs(p - v) <= 1 then (p - v) * (p - v) / 2 else abs(p - v) - 0.5::double end end), 6) as value_loss from x"""),
    lambda s, d: (lambda p: L.masked_losses(ltr(s, d).select((F.col("relevance") > 0).cast("int").alias("ctr"), (F.col("relevance") == 3).cast("int").alias("cvr"), p.alias("p_ctr"), p.alias("p_cvr"), p.alias("value_hat"), (F.coalesce(F.log1p("value"), F.lit(0.0)) / 10).alias("value_z"))))(
        F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.round("combined_score", 4)))
    ),
)

# ---------------------------------------------------------------- vectors

_UNIT = "u as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as v from embeddings)"
query(
    "vector_topk",
    f"""with {_UNIT}, s as (select a.vec_id as query_id, b.vec_id as item_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 6) as score from u a, u b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, item_id, score from s qualify row_number() over (partition by query_id order by score desc, item_id) <= 10""",
    lambda s, d: (lambda e: L.vector_topk(e.where("id % 50 = 0"), e, 10).select("query_id", "item_id", "score"))(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))),
)


def _centroids(spark, sf_dir) -> DataFrame:
    """The mean unit vector of each label."""
    unit = table(spark, sf_dir, "embeddings").select("label", C.l2_normalize(F.col("embedding")).alias("v"))
    places = unit.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return places.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector")).withColumnRenamed("label", "cluster")


query(
    "assign_clusters",
    f"""with {_UNIT}, p as (select label as cluster, i, avg(v[i]) as x from u, range(1, 65) r(i) group by 1, 2), c as (select cluster, list(x order by i) as c from p group by 1),
s as (select vec_id as id, cluster, round(list_sum(list_transform(list_zip(v, c), lambda q: q[1] * q[2])), 6) as score from u, c)
select id, cluster, score from s qualify row_number() over (partition by id order by score desc, cluster) = 1""",
    lambda s, d: L.assign_clusters(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), C.l2_normalize(F.col("embedding")).alias("vector")), _centroids(s, d)).select("id", "cluster", "score"),
)
query(
    "mmr_slate",
    None,
    lambda s, d: L.mmr_slate(slates(s, d).select(F.col("impression_id").alias("slate_id"), "product_id", F.col("combined_score").alias("score")).join(table(s, d, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("product_id"), F.col("embedding").alias("vector")), "product_id", "left"), k=5),
)


def content_clusters(spark, sf_dir, k: int = 8, seed: int = 7) -> DataFrame:
    """k-means on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(C.l2_normalize(F.col("embedding"))).alias("features"))
    model = KMeans(k=min(k, max(2, unit.count())), seed=seed, maxIter=20).fit(unit)
    return model.transform(unit).select("vec_id", F.col("prediction").alias("cluster"))


def cf_embeddings(spark, sf_dir, rank: int = 16, seed: int = 7) -> DataFrame:
    """Item vectors from weighted interactions by implicit ALS."""
    from pyspark.ml.recommendation import ALS

    rows = interactions(spark, sf_dir).select(F.substring("user_id", 2, 20).cast("int").alias("user"), F.substring("product_id", 2, 20).cast("int").alias("item"), C.weight(C.POPULARITY).alias("w")).groupBy("user", "item").agg(F.sum("w").alias("w"))
    model = ALS(rank=rank, maxIter=5, implicitPrefs=True, seed=seed, userCol="user", itemCol="item", ratingCol="w").fit(rows)
    return model.itemFactors.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("product_id"), F.col("features").alias("vector"))


query("content_clusters", None, content_clusters)
query("cf_embeddings", None, cf_embeddings)

# ---------------------------------------------------------------- quality


def _stores(spark, sf_dir):
    events = interactions(spark, sf_dir).select("event_id")
    n = F.col("event_id").cast("long")
    return events, events.where(n % 10 != 0), events.where(n % 10 == 0)


query("reconcile", "select count(*) as published, 0 as duplicates, 0 as missing, 0 as unexpected, true as ok from events", lambda s, d: L.reconcile(*_stores(s, d)))
query(
    "validate_products",
    oracle("catalog", "select product_id, concat_ws(',', case when trim(coalesce(title, '')) = '' then 'no_title' end, case when price <= 0 then 'bad_price' end, case when not in_stock then 'out_of_stock' end) as issues from catalog where not in_stock or price <= 0 or trim(coalesce(title, '')) = ''"),
    lambda s, d: L.validate_products(catalog(s, d)),
)
query(
    "price_summary",
    oracle("catalog", "p as (select *, row_number() over (partition by category order by price, product_id) - 1 as i, count(*) over (partition by category) as c from catalog) select category, count(*) as n, min(price) as low, max(price) as high, round(avg(price), 6) as mean, max(price) filter (where i = c // 2) as median from p group by 1"),
    lambda s, d: L.price_summary(catalog(s, d)),
)
query(
    "latency_summary",
    oracle("interactions", """p as (select action, session_length as latency, session_length < 50 as ok, row_number() over (partition by action order by session_length) - 1 as i, count(*) over (partition by action) as c from interactions)
select action, count(*) as n, round(avg(ok::int), 6) as success, round(avg(latency), 6) as mean, max(latency) filter (where i = round_even(0.5 * (c - 1), 0)) as p50, max(latency) filter (where i = round_even(0.95 * (c - 1), 0)) as p95, max(latency) as most from p group by 1"""),
    lambda s, d: L.latency_summary(interactions(s, d).select("action", F.col("session_length").alias("latency"), (F.col("session_length") < 50).alias("ok")), "action"),
)
query(
    "shadow_gate",
    oracle("interactions", """g as (select event_ts::date as day, count(*) > 30 as passed from interactions group by 1), i as (select day, (day - row_number() over (order by day)::int) as island from g where passed),
r as (select count(*) as run, max(day) as last from i group by island) select coalesce(max(run), 0) as run, 0 as repeated, coalesce(max(run), 0) >= 7 as ok from r where last = date '2024-01-29'"""),
    lambda s, d: L.shadow_gate(interactions(s, d).groupBy(F.to_date("event_ts").alias("day")).agg((F.count("*") > 30).alias("passed")).where("day <= '2024-01-29'"), "2024-01-29"),
)
ORACLE_SQL["shadow_gate"] = ORACLE_SQL["shadow_gate"].replace("from interactions group by 1)", "from interactions where event_ts::date <= date '2024-01-29' group by 1)")
query(
    "weighted_text_consensus",
    """with t as (select source || ':' || lang as group_id, lower(trim(text)) as norm, text as raw, coalesce(quality, 0) + 0.5::double as confidence, doc_id as seen from documents left join labels using (doc_id)),
b as (select group_id, norm, round(sum(confidence), 6) as weight, arg_max(raw, (confidence, raw)) as raw, min(seen) as first_seen, max(seen) as last_seen from t group by 1, 2)
select * from b qualify row_number() over (partition by group_id order by weight desc, norm desc) = 1""",
    lambda s, d: L.weighted_text_consensus(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select(
        F.concat("source", F.lit(":"), "lang").alias("group_id"), F.lower(F.trim("text")).alias("norm"), F.col("text").alias("raw"), (F.coalesce("quality", F.lit(0)) + 0.5).alias("confidence"), F.col("doc_id").alias("seen"))),
)
query(
    "coverage_metrics",
    oracle("interactions", "select count(*) as rows, round(avg((session_length > 20)::int), 6) as value_coverage, round(avg((action <> 'view')::int), 6) as sequence_coverage from interactions"),
    lambda s, d: L.coverage_metrics(interactions(s, d).select((F.col("session_length") > 20).cast("int").alias("value_mask"), (F.col("action") != "view").cast("int").alias("length"))),
)
query(
    "lag_report",
    oracle("interactions", """c as (select product_id as partition, count(*) - 1 as o from interactions where action = 'view' group by 1), e as (select product_id as partition, count(*) as e from interactions where action = 'click' group by 1)
select partition, e - coalesce(o, 0) as lag, case when e is null then 'unknown_partition' when o is null and e > 0 then 'uncommitted' when o < e then 'behind' else 'ok' end as reason from c full join e using (partition)"""),
    lambda s, d: (lambda e: L.lag_report(
        e.where("action = 'view'").groupBy(F.col("product_id").alias("partition")).agg((F.count("*") - 1).alias("offset")),
        e.where("action = 'click'").groupBy(F.col("product_id").alias("partition")).agg(F.count("*").alias("end")),
    ))(interactions(s, d)),
)
