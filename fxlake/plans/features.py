"""Queries of the training inputs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.operators import features as X
from fxlake.operators import windows as W
from fxlake.plans.core import _LAST, POSITIVE
from fxlake.plans.learning import _NEG, _REJ, _neg, _rej
from fxlake.sources.model import NOW, catalog, interactions, oracle, slate_feedback, slates, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLE_SQL[name] = sql


_IDS = "ids as (select product_id, dense_rank() over (order by product_id) as item from (select distinct product_id from interactions))"
_ids = lambda s, d: X.dense_ids(interactions(s, d), "product_id", "item")
query("dense_ids", oracle("interactions", f"{_IDS} select * from ids"), _ids)
query(
    "next_item_samples",
    oracle("interactions", f"""{_LAST}, {_IDS}, s as (select user_id, list(item order by event_time, event_id) as s from last join ids using (product_id) where rn <= 200 group by 1 having count(*) >= 2),
t as (select user_id, s[greatest(1, len(s) - 20):] as s from s)
select user_id, array_to_string(s[:len(s) - 1], ',') || repeat(',0', (21 - len(s))::int) as inputs, array_to_string(s[2:], ',') || repeat(',0', (21 - len(s))::int) as labels from t"""),
    lambda s, d: X.next_item_samples(W.user_sequences(interactions(s, d)), _ids(s, d)).select("user_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("inputs", "labels")]),
)


def _eligible(spark, sf_dir) -> DataFrame:
    events = interactions(spark, sf_dir)
    counts = events.groupBy("product_id").agg(F.count("*").alias("n"))
    return X.cold_start_eligible(catalog(spark, sf_dir), events.where("action = 'purchase'").select("product_id").distinct(), counts, NOW, days=60)


_ELIGIBLE = f"""cold as (select product_id, created_at, coalesce(n, 0) as n from catalog c anti join (select product_id from interactions where action = 'purchase') p using (product_id)
  left join (select product_id, count(*) as n from interactions group by 1) k using (product_id)
  where in_stock and created_at >= {NOW} - 86400 * 60 and coalesce(n, 0) <= 5 order by created_at desc, product_id limit 500)"""
query("cold_start_eligible", oracle("interactions catalog", f"{_ELIGIBLE} select * from cold"), _eligible)
query(
    "new_item_candidates",
    oracle("interactions catalog", f"{_ELIGIBLE} select product_id, round(0.5::double * greatest(0, 1 - ({NOW} - created_at) / (86400 * 60)) + 0.25::double, 6) as score from cold order by score desc, product_id limit 30"),
    lambda s, d: X.new_item_candidates(_eligible(s, d), NOW, days=60),
)
query("random_fallback", None, lambda s, d: X.random_fallback(interactions(s, d).select("user_id").distinct(), catalog(s, d), 10, 7))
def _sampled(spark, sf_dir) -> DataFrame:
    """15 negatives of each user who was shown something or gave feedback, as in a last epoch."""
    liked, shown = slate_feedback(spark, sf_dir), slates(spark, sf_dir)
    items = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector"))
    users = shown.select("user_id").union(liked.select("user_id")).distinct()
    found = _neg(spark, sf_dir).unionByName(_rej(spark, sf_dir))
    return X.sample_negatives(liked, found, {"impression": 4, "rejected": 2}, 7, users, catalog(spark, sf_dir), items, X.user_vectors(liked, items), 15, X.hard_quota(15))


query(
    "sample_negatives",
    oracle("slates feedback catalog", f"""{_NEG}, {_REJ}, liked as (select distinct user_id, product_id from feedback), people as (select user_id from slates union select user_id from feedback),
a as (select user_id, product_id, bool_or(o = 1) as i, bool_or(o = 2) as r, md5(concat_ws(chr(0), user_id, product_id, '7')) as h from (select user_id, product_id, 1 as o from imp union all select user_id, product_id, 2 from rejected) anti join liked using (user_id, product_id) group by 1, 2),
b as (select *, i and count(*) filter (where i) over (partition by user_id order by h, product_id rows unbounded preceding) <= 4 as first from a),
external as (select user_id, product_id, case when first then 'impression' else 'rejected' end as source from (select *, r and not first and count(*) filter (where r and not first) over (partition by user_id order by h, product_id rows unbounded preceding) <= 2 as second from b) where first or second),
u as (select 'p' || vec_id as product_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as v from embeddings),
means as (select user_id, list(x order by d) as m from (select user_id, d, avg(x) as x from (select user_id, unnest(v) as x, generate_subscripts(v, 1) as d from liked join u using (product_id)) group by 1, 2) group by 1),
wanted as (select user_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) as m from means),
near as (select user_id, product_id, row_number() over (partition by user_id order by round(list_sum(list_transform(list_zip(m, v), lambda p: p[1] * p[2])), 6) desc, product_id) as rank from wanted, u),
hard as (select user_id, product_id, 'ann_hard' as source from (select * from near where rank <= 15) anti join liked using (user_id, product_id) anti join external using (user_id, product_id) qualify row_number() over (partition by user_id order by rank) <= 3),
taken as (select user_id, product_id, source from external union all select user_id, product_id, source from hard),
free as (select user_id, (select count(distinct product_id) from catalog) - count(c.product_id) as n from people left join (select user_id, product_id from liked union select user_id, product_id from taken) x using (user_id) left join (select distinct product_id from catalog) c on c.product_id = x.product_id group by 1),
rest as (select user_id, 15 - count(source) as n, least(15 - count(source), any_value(free.n)) as drawn from people join free using (user_id) left join taken using (user_id) group by 1)
select user_id, source, count(*) as n, count(*) as products from taken group by 1, 2 union all select user_id, 'random', n, drawn from rest where n > 0"""),
    lambda s, d: _sampled(s, d).groupBy("user_id", "source").agg(F.count("*").alias("n"), F.count("product_id").alias("products")),
)


def _history_rows(spark, sf_dir) -> DataFrame:
    return interactions(spark, sf_dir).where("action = 'view'").select(F.col("event_id").alias("row_id"), "user_id", "product_id", F.col("event_time").alias("as_of"))


query(
    "history_embeddings",
    oracle("interactions", f"""u as (select 'p' || vec_id as product_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as v from embeddings),
near as (select r.event_id as row_id, e.action, e.product_id as past, row_number() over (partition by r.event_id, e.action order by e.event_time desc, e.event_id desc) as rn
  from interactions r join interactions e on e.user_id = r.user_id and e.event_time < r.event_time where r.action = 'view' and e.action in {POSITIVE}),
known as (select row_id, action, past, v from near left join u on u.product_id = past where rn <= 20),
counts as (select row_id, action, count(*) as n, count(v) as k from known group by 1, 2),
dots as (select k.row_id, k.action, avg(list_sum(list_transform(list_zip(k.v, c.v), lambda p: p[1] * p[2]))) as m from known k join interactions r on r.event_id = k.row_id join u c on c.product_id = r.product_id where k.v is not null group by 1, 2)
select row_id, action, n, round(k / n, 6) as coverage, round(case action when 'click' then 1.0::double when 'add_to_cart' then 1.25::double else 1.75::double end * m, 6) as match from counts left join dots using (row_id, action)"""),
    lambda s, d: X.history_embeddings(_history_rows(s, d), interactions(s, d), table(s, d, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("product_id"), F.col("embedding").alias("vector"))),
)
_numbers = lambda c: F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 10_000).cast("bigint").cast("string")), ",")
_list = lambda parts: f"array_to_string(list_transform([{', '.join(f'({p})::double' for p in parts)}], lambda x: round(x::float::double * 10000)::bigint), ',')"
_flag = lambda test: f"case when {test} then 1 else 0 end"
_bucket = lambda c, n: f"(('0x' || substr(sha256({c}), 1, 16))::uhugeint % {n})::int / {n}"
_USERS = f"""seen as (select user_id, count(distinct product_category) filter (where trim(coalesce(product_category, '')) <> '') as k from interactions group by 1),
g as (select user_id, count(*) as t, count(*) filter (where action = 'view') as v, count(*) filter (where action = 'click') as c, count(*) filter (where action = 'purchase') as p, round(coalesce(avg(session_length), 0), 6) as m, max(event_time) as last from interactions group by 1),
r as (select *, round(least(1.0::double, c / greatest(v, 1)::double), 6) as ctr, round(least(1.0::double, p / greatest(c, 1)::double), 6) as cvr from g join seen using (user_id)),
user_sides as (select user_id, {_list(["ln(1 + t)", "m / 3600", "0.5", "ctr", "cvr", "least(k, 10) / 10", f"least(1, greatest(0, ({NOW} - last) / 3600) / 720)", _flag("t > 100"), _flag("cvr > 0.05"), _flag("ctr > 0.1")])} as side from r)"""
_ITEMS = f"item_sides as (select product_id, {_list(['ln(1 + price)', 'rating / 5', 'ln(1 + num_reviews)', _flag('in_stock'), f'least(1, greatest(0, ({NOW} - created_at) / 86400) / 365)', '0', _bucket('category', 64), _bucket('brand', 128)])} as side from catalog)"
query("user_encoding", oracle("interactions", f"{_USERS} select * from user_sides"), lambda s, d: X.user_encoding(W.user_features(interactions(s, d)), NOW).select("user_id", _numbers("side").alias("side")))
query("item_encoding", oracle("catalog", f"{_ITEMS} select * from item_sides"), lambda s, d: X.item_encoding(catalog(s, d), NOW).select("product_id", _numbers("side").alias("side")))


def _two_tower(spark, sf_dir) -> dict[str, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("product_id"), F.col("embedding").alias("vector"))
    events = interactions(spark, sf_dir)
    return X.two_tower_tables(events, catalog(spark, sf_dir), vectors, W.user_features(events), _neg(spark, sf_dir), 64, NOW)


_NUMBERED = """tt_users as (select user_id, dense_rank() over (order by user_id) as "user" from (select user_id from interactions union select user_id from imp) where user_id <> ''),
tt_items as (select product_id, dense_rank() over (order by product_id) as item from (select product_id from interactions union select product_id from imp union select product_id from catalog) where product_id <> '')"""
query(
    "two_tower_items",
    oracle("interactions catalog slates feedback", f"""{_NEG}, {_NUMBERED}, {_ITEMS}, blank as (select {_list(["0", "3.0 / 5", "0", "1", "0", "0", _bucket("'unknown'", 64), _bucket("'unknown'", 128)])} as side)
select item, t.product_id, array_to_string(list_transform(coalesce(embedding, list_transform(range(64), lambda x: 0)), lambda x: round(x::double * 10000)::bigint), ',') as vector, coalesce(s.side, blank.side) as side
from tt_items t left join embeddings e on 'p' || vec_id = t.product_id left join item_sides s on s.product_id = t.product_id cross join blank"""),
    lambda s, d: _two_tower(s, d)["items"].select("item", "product_id", _numbers("vector").alias("vector"), _numbers("side").alias("side")),
)
query(
    "two_tower_users",
    oracle("interactions slates feedback catalog", f"""{_NEG}, {_NUMBERED}, {_USERS}, blank as (select {_list(["0", "0", "0.5", "0", "0", "0", "0", "0", "0", "0"])} as side)
select "user", t.user_id, coalesce(s.side, blank.side) as side from tt_users t left join user_sides s on s.user_id = t.user_id cross join blank"""),
    lambda s, d: _two_tower(s, d)["users"].select("user", "user_id", _numbers("side").alias("side")),
)
query(
    "two_tower_samples",
    oracle("interactions slates feedback catalog", f"""{_NEG}, {_NUMBERED} select "user", item, case action when 'click' then 2.0 when 'add_to_cart' then 3.0 when 'purchase' then 5.0 else 1.0 end::double as weight
from interactions join tt_users using (user_id) join tt_items using (product_id)"""),
    lambda s, d: _two_tower(s, d)["samples"],
)
query(
    "two_tower_negatives",
    oracle("interactions slates feedback catalog", f"""{_NEG}, {_NUMBERED} select "user", item, imp.source, 0.25::double as weight, true as exposed from imp join tt_users using (user_id) join tt_items using (product_id)"""),
    lambda s, d: _two_tower(s, d)["negatives"],
)
query(
    "missing_artifacts",
    "select o_orderkey as job_id, case when o_orderkey % 5 = 0 then 'missing' else 'old_schema' end as reason from orders where o_orderstatus = 'F' and (o_orderkey % 5 = 0 or o_orderkey % 3 = 0)",
    lambda s, d: (lambda o: X.missing_artifacts(
        o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status")),
        o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(2).alias("schema_version")), 2))(table(s, d, "orders")),
)
query(
    "pending_outbox",
    oracle("slates", "select impression_id as activation_id, count(*) as pending, round(1e9::double - min(created_at), 6) as oldest_age from slates where position > 2 and created_at > 8.8e8 group by 1"),
    lambda s, d: (lambda x: X.pending_outbox(
        x.select(F.col("impression_id").alias("activation_id"), (F.col("position") <= 2).alias("published"), "created_at"),
        x.groupBy(F.col("impression_id").alias("activation_id")).agg(F.when(F.max("created_at") > 8.8e8, "completed").otherwise("started").alias("status")), 1e9))(slates(s, d)),
)
query(
    "recommendation_metrics",
    oracle("slates feedback", """s as (select product_id, count(*) as shown from slates group by 1), f as (select product_id, count(*) filter (where action = 'click') as c, count(*) filter (where action = 'purchase') as p from feedback group by 1)
select product_id, shown, round(coalesce(c, 0) / shown, 6) as ctr, round(case when c > 0 then p / c else 0 end, 6) as cvr from s left join f using (product_id)"""),
    lambda s, d: X.recommendation_metrics(slates(s, d), slate_feedback(s, d)),
)
query(
    "run_metrics",
    "select max(o_totalprice) filter (where o_orderstatus = 'F') as last_success, max((o_orderstatus = 'P')::int) as waiting, max((o_orderstatus = 'O')::int) as running, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as latest_run from orders",
    lambda s, d: X.run_metrics(table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "waiting").otherwise("running").alias("status"), F.col("o_totalprice").alias("finished_at"), F.col("o_orderdate").alias("started_at"))),
)
query(
    "segment_turns",
    None,
    lambda s, d: X.segment_turns(table(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + F.char_length(F.coalesce("text", F.lit(""))) / 20).alias("stop"))),
)
