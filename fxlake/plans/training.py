"""Queries of recommendation reading and the training matrix, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.functions import scalars as S
from fxlake.operators import pit as P
from fxlake.operators import training as T
from fxlake.plans.core import _BASE, _ELIGIBLE, _RUNNING, _asof, pit_base, user_history
from fxlake.session import ship_package
from fxlake.sources.model import ATTRIBUTION_HOURS, CUTOFF, LATENESS_HOURS, VERSION, catalog, interactions, item_history, observations, oracle, slates, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLE_SQL[name] = sql


def _recommendations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Slates as events. Those of odd orders have another impression at the top level; each has an item that is no object."""
    rows, facts = slates(spark, sf_dir), catalog(spark, sf_dir).select("product_id", "brand", "category")
    odd = F.substring("impression_id", 4, 20).cast("long") % 2 == 1
    item = F.to_json(F.struct("product_id", "position", F.lit("mixed").alias("candidate_source"), "brand", F.struct("category").alias("feature_snapshot"), F.struct("collaborative_score").alias("scores"), "content_similarity_score"))
    events = rows.join(facts, "product_id").groupBy("impression_id", "user_id").agg(F.concat_ws(",", F.lit('"none"'), F.collect_list(item)).alias("items"))
    raw = F.concat(F.lit('{"user_id":"'), "user_id", F.lit('","impression_id":"'), F.when(odd, "other").otherwise(F.col("impression_id")), F.lit('","metadata":{'), F.when(odd, F.concat(F.lit('"impression_id":"'), "impression_id", F.lit('",'))).otherwise(""), F.lit('"displayed_items":['), "items", F.lit("]}}"))
    return T.read_recommendations(events.select(raw.alias("raw")))


_SHOWN = "shown as (select s.*, c.brand, c.category from slates s join catalog c using (product_id))"
query("read_recommendation_impressions", oracle("catalog slates", f"{_SHOWN} select impression_id, user_id, count(*) as n_items from shown group by 1, 2"), lambda s, d: _recommendations(s, d)[0].select("impression_id", "user_id", "n_items"))
query(
    "read_recommendation_items",
    oracle("catalog slates", f"{_SHOWN} select impression_id, product_id, position, 'mixed' as source, brand, category, round(collaborative_score, 6) as collaborative_score, round(content_similarity_score, 6) as content_similarity_score from shown"),
    lambda s, d: _recommendations(s, d)[1].select("impression_id", "product_id", "position", "source", "feature_snapshot.brand", "feature_snapshot.category", F.round("collaborative_score", 6).alias("collaborative_score"), F.round("content_similarity_score", 6).alias("content_similarity_score")),
)


def _normalized(spark, sf_dir) -> DataFrame:
    ship_package(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(S.normalize_text(F.col("text")), 256).alias("digest"))


query(
    "normalize_text",
    r"select doc_id, sha256(trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\s+', ' ', 'g'))) as digest from documents",
    _normalized,
)
query(
    "training_as_of",
    oracle("interactions", "select event_id, case event_id::bigint % 4 when 0 then event_time when 1 then available_at when 2 then session_length else 0 end as as_of from interactions"),
    lambda s, d: (lambda n: interactions(s, d).select("event_id", S.training_as_of(
        F.when(n % 4 == 0, F.col("event_time").cast("string")).when(n % 4 == 1, "n/a"), F.when(n % 4 == 1, F.col("available_at")), F.when(n % 4 == 2, F.col("session_length")),
    ).alias("as_of")))(F.col("event_id").cast("long")),
)

_FACTS = ["rating", "num_reviews", "in_stock", "created_at", "brand"]


def _with_context(rows: DataFrame) -> DataFrame:
    """What the tables lack of a request, from the observation's number."""
    n = F.substring_index("observation_id", ":", 1).cast("long")
    device = F.when(n % 3 == 0, "mobile").otherwise("desktop")
    combined = F.col("content_similarity_score") * 0.5 + F.col("popularity_score") * 0.5
    return rows.withColumns({"session_position": n % 20 + 1, "device": device, "time_on_page": n % 600, "combined_score": combined})


def _rows(spark, sf_dir) -> DataFrame:
    base = P.eligible_observations(observations(spark, sf_dir), VERSION, CUTOFF, ATTRIBUTION_HOURS, LATENESS_HOURS)
    base = P.asof_latest(base, user_history(spark, sf_dir), "user_id", ["total_interactions", "click_through_rate", "conversion_rate", "last_active"])
    base = P.asof_latest(base, item_history(spark, sf_dir), "product_id", ["price"]).where("user_id_source is not null and product_id_source is not null")
    return _with_context(base.join(catalog(spark, sf_dir).select("product_id", *_FACTS), "product_id"))


def _vector(**names: str) -> str:
    """The vector in SQL; `names` rename columns that have other values in a query."""
    n = "split_part(e.observation_id, ':', 1)::bigint"
    flag = lambda test: f"case when {test} then 1 else 0 end"
    weekday = "((floor(e.as_of / 86400) + 3) % 7)"
    cvr, last = names.get("cvr", "u.conversion_rate"), names.get("last", "u.last_active")
    parts = [
        "u.total_interactions / 1000", "0", "0", "u.click_through_rate", cvr, "0", f"(e.as_of - {last}) / 86400", flag("u.total_interactions > 100"), flag(f"{cvr} > 0.05"), flag("u.click_through_rate > 0.1"),
        "ln(1 + i.price)", "c.rating / 5", "ln(1 + c.num_reviews)", flag("c.in_stock"), "(e.as_of - c.created_at) / 86400", "0", flag("i.price > 100"), "(('0x' || substr(sha256(c.brand), 1, 16))::uhugeint % 100)::int / 100",
        "(floor(e.as_of / 3600) % 24) / 24", f"{weekday} / 6", flag(f"{weekday} >= 5"), f"({n} % 20 + 1) / 20", flag(f"{n} % 3 = 0"), f"({n} % 600) / 300",
        "coalesce(e.collaborative_score, 0)", "e.content_similarity_score", "e.popularity_score", "e.content_similarity_score * 0.5::double + e.popularity_score * 0.5::double",
    ]
    return f"array_to_string(list_transform([{', '.join(f'({p})::double' for p in parts)}], lambda x: round(x::float::double * 10000)::bigint), ',')"


query(
    "assemble_features",
    oracle("interactions observations item_history", f"""{_RUNNING}, {_ELIGIBLE}, {_asof('bu', 'eligible', 'history', 'user_id')}, {_asof('bi', 'eligible', 'item_history', 'product_id')}
select e.observation_id, {_vector()} as features from eligible e join bu u using (observation_id) join bi i using (observation_id) join catalog c on c.product_id = e.product_id
where u.source_event_id is not null and i.source_event_id is not null"""),
    lambda s, d: T.assemble_features(_rows(s, d)).select("observation_id", T.as_text("features").alias("features")),
)


def _matrix(spark, sf_dir) -> DataFrame:
    facts = catalog(spark, sf_dir).select("product_id", *_FACTS, F.concat("category", F.lit(":"), F.floor(F.col("price") / 200).cast("string")).alias("bucket"))
    return T.training_matrix(_with_context(pit_base(spark, sf_dir).where("reason is null").join(facts, "product_id")))


query(
    "training_matrix",
    oracle("interactions observations item_history", f"""{_BASE}, k as (
  select e.observation_id, e.impression_id, c.category || ':' || floor(c.price / 200)::bigint as bucket, attributed_click, attributed_purchase, attributed_value as value, {_vector(cvr='0.0', last='e.as_of').replace('u.', 'e.').replace('i.price', 'e.price')} as features
  from base e join catalog c on c.product_id = e.product_id where reason is null),
vals as (select bucket, value from k where attributed_purchase = 1 and value is not null),
limits as (select bucket, quantile_cont(value, 0.99) as clip, count(*) as n from vals group by 1 having count(*) >= 20 union all select '*', quantile_cont(value, 0.99), count(*) from vals),
both_ as (select bucket, value from vals union all select '*', value from vals),
stats as (select bucket, round(max(clip), 6) as clip, round(avg(ln(1 + least(value, clip))), 6) as mean, round(stddev_pop(ln(1 + least(value, clip))), 6) as std from both_ join limits using (bucket) group by 1),
g as (select * from stats where bucket = '*')
select observation_id, features, k.bucket, attributed_click as ctr, attributed_purchase as cvr, attributed_click as cvr_mask, coalesce(k.value, 0) as business_value, dense_rank() over (order by impression_id) as group_id,
  case when attributed_purchase = 1 and k.value is not null then round(round((ln(1 + least(k.value, coalesce(s.clip, g.clip))) - coalesce(s.mean, g.mean)) / case when coalesce(s.std, g.std) > 1e-6 then coalesce(s.std, g.std) else 1 end, 6), 4) else 0 end as value
from k left join stats s on s.bucket = k.bucket left join g on true"""),
    lambda s, d: _matrix(s, d).select("observation_id", T.as_text("features").alias("features"), "bucket", "ctr", "cvr", "cvr_mask", "business_value", "group_id", F.round("value", 4).alias("value")),
)
query(
    "bundle_hash",
    oracle("interactions observations item_history", f"""{_BASE} select observation_id, sha256('{{"as_of":' || floor(as_of)::bigint || ',"product":"' || product_id || '","product_source":"' || product_id_source || '"' ||
  case when attributed_action <> 'view' then ',"sequences":"' || attributed_action || '"' else '' end || ',"total_interactions":' || total_interactions || ',"user":"' || user_id || '","user_source":"' || user_id_source || '"}}') as bundle_hash
from base where reason is null"""),
    lambda s, d: pit_base(s, d).where("reason is null").select("observation_id", T.bundle_hash(
        {"as_of": F.floor("as_of"), "total_interactions": F.col("total_interactions")},
        {"user": F.col("user_id"), "product": F.col("product_id"), "user_source": F.col("user_id_source"), "product_source": F.col("product_id_source")},
        F.when(F.col("attributed_action") != "view", F.col("attributed_action")),
    ).alias("bundle_hash")),
)


def _chosen(spark, sf_dir) -> DataFrame:
    """Point-in-time rows, four of five of which have a sequence, against a coverage of three quarters."""
    n = F.substring_index("observation_id", ":", 1).cast("long")
    rows = pit_base(spark, sf_dir).where("reason is null").withColumn("has_sequence", n % 5 != 0)
    kept, reason = T.choose_training_rows(rows, slates(spark, sf_dir), interactions(spark, sf_dir), 10, 0.75)
    return kept.select("observation_id", "has_sequence", F.lit(reason).alias("reason"))


query(
    "choose_training_rows",
    oracle("interactions observations item_history", f"""{_BASE}, k as (select observation_id, split_part(observation_id, ':', 1)::bigint % 5 <> 0 as has_sequence from base where reason is null)
select *, 'point_in_time' as reason from k where (select count(*) >= 10 and avg(has_sequence::int) >= 0.75 from k)"""),
    _chosen,
)
