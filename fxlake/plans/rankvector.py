"""Queries of the whole ranking vector, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.operators import rankvector as V
from fxlake.operators import training as T
from fxlake.operators import windows as W
from fxlake.plans.core import _ELIGIBLE, _FANOUT, _RUNNING, POSITIVE, _asof, _window_sql
from fxlake.plans.streams import scratch
from fxlake.plans.training import _rows, _vector
from fxlake.sources.model import catalog, interactions, observations, oracle, table

QUERIES, ORACLE_SQL = {}, {}
DIM = 64


def query(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLE_SQL[name] = sql


def _observed(spark, sf_dir) -> DataFrame:
    facts = catalog(spark, sf_dir).select("product_id", "category")
    return observations(spark, sf_dir).join(facts, "product_id", "left").select(F.col("observation_id").alias("row_id"), "user_id", "product_id", "category", "as_of")


def _history(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("product_id"), F.col("embedding").alias("vector"))
    return V.history_block(_observed(spark, sf_dir) if rows is None else rows, interactions(spark, sf_dir), vectors, DIM)


def _windows(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    return V.window_block_of_events(_observed(spark, sf_dir) if rows is None else rows, interactions(spark, sf_dir))


def _whole(spark, sf_dir) -> DataFrame:
    """The base vector with both blocks. Rows with a base vector are joined once and written, and blocks are made of these
    only: those of other observations would be shuffled for the last join to drop them."""
    path = scratch(spark, "ranking-rows")
    facts = catalog(spark, sf_dir).select("product_id", "category")
    base = T.assemble_features(_rows(spark, sf_dir)).join(facts, "product_id", "left").select("observation_id", "user_id", "product_id", "category", "as_of", "features")
    base.write.parquet(path)
    base = spark.read.schema(base.schema).parquet(path)
    rows = base.select(F.col("observation_id").alias("row_id"), "user_id", "product_id", "category", "as_of")
    return V.with_blocks(base.select("observation_id", "features"), _history(spark, sf_dir, rows), _windows(spark, sf_dir, rows))


_TEXT = "array_to_string(list_transform({}, lambda x: round(x::float::double * 10000)::bigint), ',')"
_HISTORY = f"""near as (select o.observation_id as row_id, e.action, e.product_id as past, e.event_time as t, row_number() over (partition by o.observation_id, e.action order by e.event_time desc, e.event_id desc) as rn
  from observations o join interactions e on e.user_id = o.user_id and e.event_time < o.as_of where e.action in {POSITIVE}),
vec as (select 'p' || vec_id as product_id, embedding::double[] as v from embeddings),
near_v as (select n.*, v from near n left join vec on product_id = past where rn <= 20),
stat as (select row_id, action, count(*) as k, count(v) as c, max(t) as latest from near_v group by 1, 2),
means as (select row_id, action, list(m * case action when 'click' then 1.0::double when 'add_to_cart' then 1.25::double else 1.75::double end order by d) as mean
  from (select row_id, action, d, avg(x) as m from (select row_id, action, unnest(v) as x, generate_subscripts(v, 1) as d from near_v where v is not null) group by 1, 2, 3) group by 1, 2),
grid as (select observation_id as row_id, product_id, as_of, a.action, a.place from observations cross join (values ('click', 1), ('add_to_cart', 2), ('purchase', 3)) a(action, place)),
parts as (select g.row_id, place, list_concat(coalesce(mean, list_transform(range({DIM}), lambda x: 0::double)), [coalesce(k, 0) / 20, coalesce(c / k, 0), case when latest is null then 30 else least(30, greatest(0, (as_of - latest) / 86400)) end,
    case when c > 0 then 1 else 0 end, coalesce(list_sum(list_transform(list_zip(mean, w.v), lambda p: p[1] * p[2])), 0)]) as x
  from grid g left join stat using (row_id, action) left join means using (row_id, action) left join vec w on w.product_id = g.product_id),
history_text as (select row_id, string_agg({_TEXT.format('x')}, ',' order by place) as history from parts group by 1)"""
_WINDOWS = f"""{_FANOUT}, win as ({" union all ".join(f"({_window_sql(n)})" for n in W.WINDOWS)}),
asked as (select observation_id as row_id, as_of, e.entity_type, case e.entity_type when 'user' then o.user_id when 'product' then o.product_id else c.category end as entity_id, w.name as "window", e.place * 3 + w.place as slot
  from observations o left join catalog c using (product_id) cross join (values ('user', 0), ('product', 1), ('category', 2)) e(entity_type, place) cross join (values ('5m', 0), ('1h', 1), ('24h', 2)) w(name, place)),
window_text as (select row_id, string_agg({_TEXT.format('''[coalesce(views, 0) / 1000, coalesce(clicks, 0) / 1000, coalesce(add_to_carts, 0) / 1000, coalesce(purchases, 0) / 1000, coalesce(click_through_rate, 0), coalesce(conversion_rate, 0)]''')}, ',' order by slot) as windows
  from asked a asof left join win w on w.entity_type = a.entity_type and w.entity_id = a.entity_id and w."window" = a."window" and w.window_end <= a.as_of group by 1)"""

query("ranking_history_block", oracle("interactions observations", f"{_HISTORY} select * from history_text"), lambda s, d: _history(s, d).select("row_id", T.as_text("history").alias("history")))
query("ranking_window_block", oracle("interactions observations catalog", f"{_WINDOWS} select * from window_text"), lambda s, d: _windows(s, d).select("row_id", T.as_text("windows").alias("windows")))
query(
    "ranking_vector",
    oracle("interactions observations item_history", f"""{_RUNNING}, {_ELIGIBLE}, {_asof('bu', 'eligible', 'history', 'user_id')}, {_asof('bi', 'eligible', 'item_history', 'product_id')}, {_HISTORY}, {_WINDOWS}
select e.observation_id, 481 - 3 * (128 - {DIM}) as n, {_vector()} || ',' || h.history || ',' || w.windows as features
from eligible e join bu u using (observation_id) join bi i using (observation_id) join catalog c on c.product_id = e.product_id join history_text h on h.row_id = e.observation_id join window_text w on w.row_id = e.observation_id
where u.source_event_id is not null and i.source_event_id is not null"""),
    lambda s, d: _whole(s, d).select("observation_id", F.size("features").alias("n"), T.as_text("features").alias("features")),
)
