"""Queries of windows, user features, sequences, point-in-time sets and candidates, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.operators import candidates as C
from fxlake.operators import features as X
from fxlake.operators import pit as P
from fxlake.operators import sequences as B
from fxlake.operators import windows as W
from fxlake.sources.model import ATTRIBUTION_HOURS, CUTOFF, LATENESS_HOURS, NOW, VERSION, catalog, interactions, item_history, observations, oracle, table

QUERIES, ORACLE_SQL = {}, {}
POSITIVE = "('click', 'add_to_cart', 'purchase')"
SEQUENCE = "('view', 'click', 'add_to_cart', 'purchase')"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# ---------------------------------------------------------------- windows

_MICROS = {"5m": (300, 60), "1h": (3600, 300), "24h": (86400, 3600)}


def _window_sql(name: str) -> str:
    size, slide = _MICROS[name]
    return f"""select entity_type, entity_id, '{name}' as window, count(*) filter (where action = 'view') as views, count(*) filter (where action = 'click') as clicks,
    count(*) filter (where action = 'add_to_cart') as add_to_carts, count(*) filter (where action = 'purchase') as purchases, count(*) as total_events,
    round(case when count(*) filter (where action = 'view') = 0 then 0 else least(1.0::double, count(*) filter (where action = 'click') / (count(*) filter (where action = 'view'))::double) end, 6) as click_through_rate,
    round(case when count(*) filter (where action = 'click') = 0 then 0 else least(1.0::double, count(*) filter (where action = 'purchase') / (count(*) filter (where action = 'click'))::double) end, 6) as conversion_rate,
    (start * {slide})::double as window_start, (start * {slide} + {size})::double as window_end
  from (select f.*, floor(event_time / {slide})::bigint - k as start from fanout f, range({size // slide}) r(k)) group by entity_type, entity_id, start"""


_FANOUT = """fanout as (
  select *, 'user' as entity_type, user_id as entity_id from interactions where user_id is not null union all
  select *, 'product', product_id from interactions where product_id is not null union all
  select *, 'category', product_category from interactions where trim(coalesce(product_category, '')) <> '')"""

for _name in W.WINDOWS:
    query(f"window_features_{_name}", oracle("interactions", f"{_FANOUT} {_window_sql(_name)}"))(lambda s, d, n=_name: W.window_features(interactions(s, d), n))

query("window_union", oracle("interactions", f"{_FANOUT} " + " union all ".join(f"({_window_sql(n)})" for n in W.WINDOWS)))(lambda s, d: W.all_window_features(interactions(s, d)))

_RATIO = "round(case when {d} <= 0 then 0 else greatest(0, least(1.0::double, {n} / ({d})::double)) end, 6)"


def _clamped(n: str, d: str) -> str:
    return _RATIO.format(n=n, d=f"greatest({d}, 1)")


query(
    "user_features",
    oracle("interactions", f"""
  seen as (select user_id, product_category, min((event_time, event_id)) as f from interactions where trim(coalesce(product_category, '')) <> '' group by all),
  cats as (select user_id, list(product_category order by f, product_category)[1:10] as c from seen group by 1)
select user_id, count(*) as total_interactions, round(coalesce(avg(session_length), 0), 6) as avg_session_length, array_to_string(any_value(c), ',') as preferred_categories, 0.5::double as price_sensitivity,
  {_clamped("count(*) filter (where action = 'click')", "count(*) filter (where action = 'view')")} as click_through_rate,
  {_clamped("count(*) filter (where action = 'purchase')", "count(*) filter (where action = 'click')")} as conversion_rate,
  max(event_time) as last_active, arg_max(event_id, (event_time, event_id)) as source_event_id
from interactions left join cats using (user_id) group by user_id"""),
)(lambda s, d: W.user_features(interactions(s, d)).withColumn("preferred_categories", F.array_join("preferred_categories", ",")))

_RUNNING = f"""history as (
  select user_id, event_id as source_event_id, event_time, available_at, n as total_interactions, {_clamped("c", "v")} as click_through_rate, {_clamped("p", "c")} as conversion_rate, m as last_active
  from (select *, count(*) over w as n, count(*) filter (where action = 'view') over w as v, count(*) filter (where action = 'click') over w as c,
      count(*) filter (where action = 'purchase') over w as p, max(event_time) over w as m
    from interactions window w as (partition by user_id order by event_time, event_id rows between unbounded preceding and current row)))"""
query("running_user_features", oracle("interactions", f"{_RUNNING} select * from history"))(lambda s, d: W.running_user_features(interactions(s, d)))


@query(
    "batch_user_delta",
    oracle("interactions", """
  g as (select user_id, count(*) as total_interactions, round(avg(session_length), 4) as avg_session_length, count(session_length) as sessions,
    count(*) filter (where action = 'view') as views, count(*) filter (where action = 'click') as clicks, count(*) filter (where action = 'purchase') as purchases,
    max(event_time) as last_active from interactions group by 1)
select user_id, total_interactions, avg_session_length, sessions, views, clicks, purchases, round(clicks / greatest(views, 1)::double, 6) as click_through_rate,
  round(purchases / greatest(clicks, 1)::double, 6) as conversion_rate, last_active from g"""),
)
def batch_user_delta(spark, sf_dir) -> DataFrame:
    """The state after two batches, which must equal one pass over all events (means agree to six places)."""
    events = interactions(spark, sf_dir)
    none = spark.createDataFrame([], "user_id string, total_interactions long, avg_session_length double, sessions long, views long, clicks long, purchases long, last_active double")
    early = F.col("event_time") < 1705320000.0
    first = W.batch_user_delta(none, events.where(early))
    exact = events.where(early).groupBy("user_id").agg(F.avg("session_length").alias("m"))  # the stored mean isn't rounded
    stored = first.drop("avg_session_length").join(exact.withColumnRenamed("m", "avg_session_length"), "user_id")
    return W.batch_user_delta(stored, events.where(~early))


query(
    "analytics_summary",
    oracle("interactions", f"""
select count(*) as total_events, count(distinct user_id) as unique_users, count(distinct product_id) as unique_products,
  {', '.join(f"count(*) filter (where action = '{a}') as n_{a}" for a in ("view", "click", "add_to_cart", "purchase"))},
  round(count(*) filter (where action = 'click') / (count(*) filter (where action = 'view'))::double, 4) as ctr,
  round(count(*) filter (where action = 'purchase') / (count(*) filter (where action = 'click'))::double, 4) as cvr
from interactions where event_time > {NOW} - 3600 * 240 and event_time <= {NOW}"""),
)(lambda s, d: W.analytics_summary(interactions(s, d), NOW, 240))

_LAST = f"""last as (select *, row_number() over (partition by user_id order by event_time desc, event_id desc) as rn from interactions where action in {SEQUENCE})"""
query(
    "user_sequences",
    oracle("interactions", f"""{_LAST}
select user_id, count(*) as n, string_agg(product_id || ':' || action, ',' order by event_time, event_id) as sequence from last where rn <= 50 group by user_id having count(*) >= 2"""),
)(lambda s, d: W.user_sequences(interactions(s, d), 50).select("user_id", F.size("sequence").cast("long").alias("n"), F.array_join(F.transform("sequence", lambda x: F.concat(x["product_id"], F.lit(":"), x["action"])), ",").alias("sequence")))

query(
    "eligible_users",
    oracle("interactions", f"select user_id, count(*) as n, max(event_time) as last_active from interactions where action in {SEQUENCE} group by 1 having count(*) >= 2 order by last_active desc, user_id limit 50"),
)(lambda s, d: W.eligible_users(interactions(s, d), 50))

query(
    "sequence_tokens",
    oracle("interactions", f"""{_LAST}
select user_id, least(count(*), 200) as length, arg_max(event_id, (event_time, event_id)) as event_id, max(event_time) as event_time,
  arg_max(product_id, (event_time, event_id)) as product_id, arg_max(action, (event_time, event_id)) as action from last where rn <= 200 group by user_id having count(*) >= 2"""),
)(lambda s, d: W.sequence_tokens(W.user_sequences(interactions(s, d))))

query(
    "keep_recent",
    oracle("interactions", """select event_id, user_id, action from (
  select *, row_number() over (partition by user_id order by event_time desc, event_id desc) as a, row_number() over (partition by user_id, action order by event_time desc, event_id desc) as b from interactions)
where a <= 40 and b <= 10"""),
)(lambda s, d: W.keep_recent(interactions(s, d), 40, 10).select("event_id", "user_id", "action"))

_NEAR = f"""near as (select o.observation_id, o.as_of, o.product_id as candidate, i.action, i.product_id, i.event_time, i.event_id,
      row_number() over (partition by o.observation_id, i.action order by i.event_time desc, i.event_id desc) as rn
    from observations o join interactions i on i.user_id = o.user_id and i.event_time >= o.as_of - 86400 * 30 and i.event_time < o.as_of and i.available_at <= o.as_of
    where i.action in {POSITIVE}),
  last as (select observation_id, action, count(*) as n, string_agg(product_id, ',' order by event_time, event_id) as ids, string_agg(event_id, ',' order by event_time, event_id) as events,
    string_agg(round(event_time)::bigint, ',' order by event_time, event_id) as times from near where rn <= 20 group by 1, 2),
  every as (select observation_id, as_of, product_id, a as action from observations cross join (values ('click'), ('add_to_cart'), ('purchase')) v(a))"""
_sequences = lambda s, d: B.behavior_sequences(observations(s, d), interactions(s, d), 20)
query(
    "behavior_sequences",
    oracle("interactions observations", f"""{_NEAR} select observation_id, action, repeat(',', (20 - coalesce(n, 0))::int - (n is null)::int) || coalesce(ids, '') as product_ids, coalesce(n, 0) as n,
  repeat('0,', (20 - coalesce(n, 0))::int - (n is null)::int) || coalesce(times, '0') as event_times, coalesce(events, '') as event_ids from every left join last using (observation_id, action)"""),
)(
    lambda s, d: _sequences(s, d).select(
        "observation_id", "action", F.array_join("product_ids", ",").alias("product_ids"), F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("n"),
        F.array_join(F.transform("event_times", lambda t: F.round(t).cast("long").cast("string")), ",").alias("event_times"), F.array_join("event_ids", ",").alias("event_ids"),
    )
)


def _spoiled_sequences(spark, sf_dir) -> DataFrame:
    """Sequences of which five in eleven are broken, each in its own way; empty ones can only lose their padding."""
    rows = _sequences(spark, sf_dir).withColumn("kind", F.pmod(F.substring_index("observation_id", ":", 1).cast("long"), F.lit(11)))
    some = F.array_contains("mask", 1)
    return rows.where(some).withColumns({
        "action": F.when(F.col("kind") == 0, "view").otherwise(F.col("action")), "product_ids": F.when(F.col("kind") == 1, F.slice("product_ids", 1, 19)).otherwise(F.col("product_ids")),
        "mask": F.when(F.col("kind") == 2, F.array_repeat(F.lit(2), 20)).when(F.col("kind") == 3, F.concat(F.slice("mask", 1, 19), F.array(F.lit(0)))).otherwise(F.col("mask")),
        "event_times": F.when(F.col("kind") == 4, F.transform("event_times", lambda t: F.when(t > 0, F.col("as_of")).otherwise(t))).when(F.col("kind") == 5, F.transform(F.reverse("event_times"), lambda t: t)).otherwise(F.col("event_times")),
    })


query(
    "check_behavior_sequences",
    oracle("interactions observations", f"""{_NEAR}, kinds as (select l.*, l.observation_id.split(':')[1]::bigint % 11 as kind, (select count(distinct event_time) from near where near.observation_id = l.observation_id and near.action = l.action and rn <= 20) as distinct_times from last l)
select observation_id, case when kind = 0 then 'unknown_action' when kind = 1 then 'wrong_length' when kind = 2 then 'mask_not_binary' when kind = 3 and n = 1 then 'mask_mismatch' when kind = 3 then 'not_left_padded'
  when kind = 4 then 'outside_window' when n < 20 then 'padding_not_empty' when distinct_times > 1 then 'not_in_order' end as error from kinds
where kind < 5 or kind = 5 and (n < 20 or distinct_times > 1)"""),
)(lambda s, d: B.check_behavior_sequences(_spoiled_sequences(s, d), 20).select("observation_id", "error"))
_ITEMS = "ids as (select product_id, dense_rank() over (order by product_id) as item from (select distinct product_id from interactions where action = 'purchase'))"
query(
    "sequence_inputs",
    oracle("interactions observations", f"""{_NEAR}, {_ITEMS}, seen as (select near.*, coalesce(item, 0) as item, ln(1 + (as_of - event_time) / 86400) as recency from near left join ids using (product_id) where rn <= 20),
sums as (select observation_id, action, count(*) as n, count(*) filter (where item > 0) as k, min(recency) filter (where item > 0) as least, string_agg(item, ',' order by event_time, event_id) as items,
  string_agg(case when item > 0 then round(recency * 1000)::bigint else 0 end, ',' order by event_time, event_id) as days from seen group by 1, 2),
parts as (select e.observation_id, e.action, coalesce(c.item, 0) as candidate, repeat('0,', (20 - coalesce(n, 0))::int - (n is null)::int) || coalesce(items, '0') as items, repeat('0,', (20 - coalesce(n, 0))::int - (n is null)::int) || coalesce(days, '0') as days,
  case when c.item is null then [0, 0, 0, 0] else [coalesce(n, 0) * 1000, round(coalesce(k / n, 0) * 1000)::bigint, round(coalesce(least, 0) * 1000)::bigint, (n is not null)::int * 1000] end as four
  from every e left join sums using (observation_id, action) left join ids c on c.product_id = e.product_id)
select observation_id, max(candidate) as candidate, string_agg(items, ';' order by list_position(['click', 'add_to_cart', 'purchase'], action)) as items, string_agg(days, ';' order by list_position(['click', 'add_to_cart', 'purchase'], action)) as days,
  string_agg(array_to_string(four, ','), ',' order by list_position(['click', 'add_to_cart', 'purchase'], action)) as summary from parts group by 1"""),
)(lambda s, d: (lambda r, t: r.select(
    "observation_id", "candidate", F.array_join(F.transform("items", lambda x: F.array_join(x.cast("array<string>"), ",")), ";").alias("items"), F.array_join(F.transform("recency", t), ";").alias("days"), t(F.col("summary")).alias("summary"),
))(
    B.sequence_inputs(observations(s, d), _sequences(s, d), X.dense_ids(interactions(s, d).where("action = 'purchase'"), "product_id", "item"), 20),
    lambda x: F.array_join(F.transform(x, lambda v: F.round(v * 1000).cast("long").cast("string")), ","),
))

query(
    "keyset_page",
    oracle("interactions", "select event_id, event_time, user_id from interactions where event_time > 1704931200.5 or (event_time = 1704931200.5 and event_id > '5') order by event_time, event_id limit 500"),
)(lambda s, d: W.keyset_page(interactions(s, d), (1704931200.5, "5"), 500).select("event_id", "event_time", "user_id"))

query("latest_row", oracle("interactions", "select product_id, event_id, event_time, action from interactions qualify row_number() over (partition by product_id order by event_time desc, event_id desc) = 1"))(
    lambda s, d: W.latest_row(interactions(s, d), "product_id", "event_time", "event_id").select("product_id", "event_id", "event_time", "action")
)

query("recent_events", oracle("interactions", "select event_id, user_id, event_time from interactions order by event_time desc, event_id desc limit 200"))(
    lambda s, d: W.recent_events(interactions(s, d), 200).select("event_id", "user_id", "event_time")
)

# ---------------------------------------------------------------- point in time

PIT = {"version": VERSION, "cutoff": CUTOFF, "attribution_hours": ATTRIBUTION_HOURS, "lateness_hours": LATENESS_HOURS}


def user_history(spark, sf_dir) -> DataFrame:
    return W.running_user_features(interactions(spark, sf_dir)).withColumn("version", F.lit(VERSION))


def valued(spark, sf_dir) -> DataFrame:
    """Interactions whose context has a value under one of several keys, beside others that don't read as numbers, or none."""
    n, value = F.col("event_id").cast("long") % 4, F.col("session_length")
    context = F.when(n == 0, F.to_json(F.struct(F.lit("n/a").alias("margin"), value.alias("value")))).when(n == 1, F.to_json(F.struct(value.alias("price")))).when(n == 2, F.to_json(F.struct(value.alias("profit"), F.lit(1).alias("price")))).otherwise("{}")
    return interactions(spark, sf_dir).withColumn("context_json", context)


def pit_base(spark, sf_dir) -> DataFrame:
    return P.scored_base(observations(spark, sf_dir), user_history(spark, sf_dir), item_history(spark, sf_dir), valued(spark, sf_dir), **PIT)


_ELIGIBLE = f"eligible as (select * from observations where version = '{VERSION}' and as_of <= {CUTOFF} - {(ATTRIBUTION_HOURS + LATENESS_HOURS) * 3600})"
_ASOF = """{name} as (
  select o.observation_id, h.* exclude ({key}) from {obs} o left join {hist} h on h.{key} = o.{key} and h.event_time <= o.as_of and h.available_at <= o.as_of
  qualify row_number() over (partition by o.observation_id order by h.event_time desc nulls last, h.available_at desc, h.source_event_id desc) = 1)"""


def _asof(name: str, obs: str, hist: str, key: str) -> str:
    return _ASOF.format(name=name, obs=obs, hist=hist, key=key)


query(
    "asof_user",
    oracle("interactions observations", f"{_RUNNING}, {_asof('best', 'observations', 'history', 'user_id')} select observation_id, total_interactions, source_event_id as user_id_source from best"),
)(lambda s, d: P.asof_latest(observations(s, d), user_history(s, d), "user_id", ["total_interactions"]).select("observation_id", "total_interactions", "user_id_source"))

query("asof_item", oracle("observations item_history", f"{_asof('best', 'observations', 'item_history', 'product_id')} select observation_id, round(price, 6) as price, source_event_id as product_id_source from best"))(
    lambda s, d: P.asof_latest(observations(s, d), item_history(s, d), "product_id", ["price"]).select("observation_id", F.round("price", 6).alias("price"), "product_id_source")
)

query("eligible_observations", oracle("observations", f"{_ELIGIBLE} select observation_id, as_of from eligible"))(
    lambda s, d: P.eligible_observations(observations(s, d), VERSION, CUTOFF, ATTRIBUTION_HOURS, LATENESS_HOURS).select("observation_id", "as_of")
)

_FEEDBACK = f"""fed as (select o.observation_id, i.action, i.session_length, i.event_time, i.available_at, i.event_id as source_event_id
  from eligible o left join interactions i on i.user_id = o.user_id and i.product_id = o.product_id and i.event_time >= o.as_of
    and i.event_time <= o.as_of + {ATTRIBUTION_HOURS * 3600} and i.available_at <= {CUTOFF}),
ranked as (select observation_id, max(case action when 'purchase' then 3 when 'add_to_cart' then 2 when 'click' then 1 else 0 end) as r,
    max(case when action in {POSITIVE} then 1 else 0 end) as attributed_click, max(case when action = 'purchase' then 1 else 0 end) as attributed_purchase,
    max((event_time, available_at, source_event_id, session_length)) filter (where action = 'purchase') as l from fed group by 1),
labels as (select observation_id, case r when 3 then 'purchase' when 2 then 'add_to_cart' when 1 then 'click' else 'view' end as attributed_action,
    attributed_click, attributed_purchase, case when l[3]::bigint % 4 <> 3 then l[4] end as attributed_value,
    case l[3]::bigint % 4 when 0 then 'margin' when 1 then 'price' when 2 then 'profit' end as attributed_value_source from ranked)"""


def _eligible(spark, sf_dir):
    return P.eligible_observations(observations(spark, sf_dir), VERSION, CUTOFF, ATTRIBUTION_HOURS, LATENESS_HOURS)


query("feedback_interval", oracle("interactions observations", f"{_ELIGIBLE}, {_FEEDBACK} select observation_id, action, source_event_id from fed"))(
    lambda s, d: P.feedback_interval(_eligible(s, d), interactions(s, d), ATTRIBUTION_HOURS, CUTOFF).select("observation_id", "action", "source_event_id")
)
query("attribution", oracle("interactions observations", f"{_ELIGIBLE}, {_FEEDBACK} select * from labels"))(
    lambda s, d: P.attribution(P.feedback_interval(_eligible(s, d), valued(s, d), ATTRIBUTION_HOURS, CUTOFF))
)

_BASE = f"""{_RUNNING}, {_ELIGIBLE}, {_FEEDBACK}, {_asof('bu', 'eligible', 'history', 'user_id')}, {_asof('bi', 'eligible', 'item_history', 'product_id')},
base as (select e.*, l.* exclude (observation_id), u.total_interactions, u.click_through_rate, u.source_event_id as user_id_source, i.price, i.source_event_id as product_id_source,
  case when impression_id is null then 'missing_impression_id' when context is null then 'missing_context'
    when collaborative_score is null or content_similarity_score is null or popularity_score is null then 'missing_candidate_scores'
    when u.source_event_id is null then 'missing_user_feature' when i.source_event_id is null then 'missing_complete_v1_item_snapshot' end as reason
  from eligible e join bu u using (observation_id) join bi i using (observation_id) left join labels l using (observation_id))"""
_ALL = "interactions observations item_history"
query("pit_training_set", oracle(_ALL, f"{_BASE} select observation_id, impression_id, user_id, product_id, as_of, attributed_action, attributed_click, attributed_purchase, attributed_value, total_interactions, click_through_rate, round(price, 6) as price, user_id_source, product_id_source from base where reason is null"))(
    lambda s, d: P.training_rows(pit_base(s, d)).withColumn("price", F.round("price", 6))
)
query("pit_quarantine", oracle(_ALL, f"{_BASE} select observation_id, reason, as_of from base where reason is not null"))(lambda s, d: P.quarantine_rows(pit_base(s, d)))
query("pit_stats", oracle(_ALL, f"{_BASE} select count(*) as rows, count(*) filter (where reason is null) as training_rows, count(*) filter (where reason is not null) as quarantine_rows, min(as_of) as min_as_of, max(as_of) as max_as_of from base"))(
    lambda s, d: P.pit_stats(pit_base(s, d))
)
query("run_row_count", oracle("observations", f"{_ELIGIBLE} select count(*) as rows from eligible"))(lambda s, d: (lambda b: P.run_row_count(P.training_rows(b), P.quarantine_rows(b)))(pit_base(s, d)))

# ---------------------------------------------------------------- candidates


def _weights(weights: dict[str, float]) -> str:
    return "case action " + " ".join(f"when '{a}' then {w}::double" for a, w in weights.items()) + " else 1.0::double end"


_TOPK = "select product_id, round(raw / (select max(raw) from s), 6) as score from s where (select max(raw) from s) > 0 order by score desc, product_id limit {k}"
_TREND = f"s as (select product_id, sum({_weights(C.TRENDING)} * pow(0.95, ({NOW} - event_time) / 3600)) as raw from interactions where event_time > {NOW} - 86400 and event_time <= {NOW} group by 1)"
query("item_popularity", oracle("interactions", f"s as (select product_id, sum({_weights(C.POPULARITY)}) as raw from interactions group by 1) {_TOPK.format(k=100)}"))(lambda s, d: C.item_popularity(interactions(s, d)))
query("trending_scores", oracle("interactions", f"{_TREND} {_TOPK.format(k=100)}"))(lambda s, d: C.trending_scores(interactions(s, d), NOW))

_SWING = f"""positive as (select user_id, product_id, max((event_time, event_id)) as l from interactions where action in {SEQUENCE} group by 1, 2),
a as (select * from positive qualify row_number() over (partition by user_id order by l desc, product_id) <= 100),
b as (select user_id, product_id from a qualify row_number() over (partition by product_id order by user_id) <= 500),
pairs as (select x.user_id as u, y.user_id as v, count(*) as n from b x join b y using (product_id) where x.user_id < y.user_id group by 1, 2 having count(*) >= 2),
raw as (select i.product_id as item_id, j.product_id as neighbor_id, sum(1.0 / (5.0::double + n)) as raw
  from pairs join b i on i.user_id = u join b i2 on i2.user_id = v and i2.product_id = i.product_id join b j on j.user_id = u join b j2 on j2.user_id = v and j2.product_id = j.product_id
  where i.product_id <> j.product_id group by 1, 2),
top as (select * from raw qualify row_number() over (partition by item_id order by round(raw, 9) desc, neighbor_id) <= 100),
swing as (select item_id, neighbor_id, round(raw / max(raw) over (partition by item_id), 6) as score from top)"""
query("swing_index", oracle("interactions", f"{_SWING} select * from swing"))(lambda s, d: C.swing_index(interactions(s, d), per_user=100, users_per_item=500, k=100))
_SEEDS = "case action when 'view' then 1.0 when 'click' then 2.0 when 'add_to_cart' then 3.0 when 'purchase' then 5.0 end"
query(
    "swing_candidates",
    oracle("interactions", f"""{_SWING},
seen as (select user_id, product_id, max(event_time) as l, max({_SEEDS})::double as w from interactions where action in {SEQUENCE} and event_time <= {NOW} group by 1, 2),
seeds as (select * from seen qualify row_number() over (partition by user_id order by l desc, product_id) <= 20),
scored as (select user_id, neighbor_id as product_id, round(sum(w / (1 + greatest({NOW} - l, 0) / 86400 / 30) * score), 6) as score from seeds join swing on item_id = product_id group by 1, 2),
fresh as (select * from scored anti join seen using (user_id, product_id))
select user_id, product_id, score, row_number() over (partition by user_id order by score desc, product_id) as rank from fresh qualify rank <= 40"""),
)(lambda s, d: C.swing_candidates(C.swing_index(interactions(s, d), per_user=100, users_per_item=500, k=100), interactions(s, d), NOW))


def _sources(spark, sf_dir):
    events = interactions(spark, sf_dir)
    users = events.select("user_id").distinct()
    popular = C.item_popularity(events, 30).select("product_id", "score")
    trending = C.trending_scores(events, NOW, k=30).select("product_id", "score")
    each = lambda pool: users.crossJoin(F.broadcast(pool))  # noqa: E731  a pool has at most 30 rows
    recent = events.where(F.col("action") == "click").groupBy("user_id", "product_id").agg(F.count("*").cast("double").alias("score"))
    return C.merge_candidates(("recent", recent), ("popularity", each(popular)), ("trending", each(trending)))


_SOURCES = f"""pop as (with s as (select product_id, sum({_weights(C.POPULARITY)}) as raw from interactions group by 1) {_TOPK.format(k=30)}),
trend as (with {_TREND} {_TOPK.format(k=30)}),
users as (select distinct user_id from interactions),
rows_ as (select user_id, product_id, 0 as i, 'recent' as source, count(*)::double as score from interactions where action = 'click' group by 1, 2
  union all select user_id, product_id, 1, 'popularity', score from users, pop union all select user_id, product_id, 2, 'trending', score from users, trend),
merged as (select user_id, product_id, max(score) filter (where source = 'recent') as recent_score, max(score) filter (where source = 'popularity') as popularity_score,
  max(score) filter (where source = 'trending') as trending_score, string_agg(source, '+' order by i) as sources, count(distinct source) as n_sources from rows_ group by 1, 2)"""
query("merge_candidates", oracle("interactions", f"{_SOURCES} select * from merged"))(_sources)
query("source_counts", oracle("interactions", f"{_SOURCES} select source, count(*) as n from rows_ group by 1"))(lambda s, d: C.source_counts(_sources(s, d)))
query("exclude_seen", oracle("interactions", f"{_SOURCES} select user_id, product_id, sources from merged anti join (select distinct user_id, product_id from interactions) using (user_id, product_id)"))(
    lambda s, d: C.exclude_seen(_sources(s, d), interactions(s, d)).select("user_id", "product_id", "sources")
)

_COMBINED = "round(coalesce(recent_score, 0) / 10 * 0.4::double + coalesce(trending_score, 0) * 0.3::double + coalesce(popularity_score, 0) * 0.3::double, 6)"


def _ranked(spark, sf_dir, k=20):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    merged = _sources(spark, sf_dir).withColumn("combined_score", F.round(z("recent_score") / 10 * 0.4 + z("trending_score") * 0.3 + z("popularity_score") * 0.3, 6))
    return C.rank_topk(merged, k).select("user_id", "product_id", "combined_score", "rank")


_RANKED = f"{_SOURCES}, ranked as (select user_id, product_id, {_COMBINED} as combined_score, row_number() over (partition by user_id order by {_COMBINED} desc, product_id) as rank from merged qualify rank <= 20)"
query("rank_topk", oracle("interactions", f"{_RANKED} select * from ranked"))(_ranked)
query(
    "diversity_filter",
    oracle("interactions catalog", f"""{_RANKED},
listed as (select r.*, c.category, count(*) over (partition by user_id) as n, row_number() over (partition by user_id, category order by rank) as c from ranked r left join catalog c using (product_id)),
rounds as (select user_id, c, count(*) as k from listed where category is not null and c <= 3 group by 1, 2),
quota as (select user_id, 3 + sum(greatest(0, 3 - k)) as q from rounds group by 1)
select user_id, product_id, rank from listed left join quota using (user_id) where n <= 10 or c <= case when category is null then coalesce(q, 3) else 3 end"""),
)(lambda s, d: C.diversity_filter(_ranked(s, d).join(catalog(s, d).select("product_id", "category"), "product_id", "left")).select("user_id", "product_id", "rank"))

_POOLS = f"""trend as (with {_TREND} {_TOPK.format(k=100)}),
scored as (select product_id, category, part_key % 7 as cluster, round(coalesce(score, 0) + 0.6::double * rating / 5 + 0.2::double * ln(1 + num_reviews) / 5 + 0.2::double / (1 + greatest(0, ({NOW} - created_at) / 86400) / 30), 6) as raw
  from catalog left join trend using (product_id)),
pools as (select product_id, raw, 'global' as pool from scored union all select product_id, raw, 'category:' || category from scored union all select product_id, raw, 'cluster:' || cluster from scored),
kept as (select *, row_number() over (partition by pool order by raw desc, product_id) as rank from pools qualify rank <= case when pool = 'global' then 300 else 150 end),
served as (select pool, product_id, rank, round(raw / max(raw) over (partition by pool), 6) as score from kept)"""


def serving_pools(spark, sf_dir) -> DataFrame:
    """Pools whose clusters are made from the product's number (`assign_clusters` gives them elsewhere)."""
    clusters = catalog(spark, sf_dir).select("product_id", (F.col("part_key") % 7).alias("cluster"))
    return C.serving_pools(catalog(spark, sf_dir), C.trending_scores(interactions(spark, sf_dir), NOW), NOW, clusters=clusters)


query("serving_pools", oracle("interactions catalog", f"{_POOLS} select * from served"))(serving_pools)

# ---------------------------------------------------------------- vectors


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


query("vector_norms", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings")(
    lambda s, d: _vectors(s, d).select("vec_id", F.round(F.sqrt(C.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))
)
