"""The driver's tables as interactions, catalog, observations, slates and feedback.

`CTES` holds the same views as DuckDB SQL, for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "ranking_ltr_v1"
#: End of the events' month and a moment inside it.
CUTOFF, NOW = 1706745600.0, 1706572800.0
ATTRIBUTION_HOURS, LATENESS_HOURS = 168, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1000000.0)


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, part = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    k = F.get_json_object("props", "$.k")
    action = F.when(F.col("event_type") == "signup", "add_to_cart").when(F.col("event_type") == "error", "remove_from_cart").otherwise(F.col("event_type"))
    base = events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("p"), k).alias("product_id"),
        action.alias("action"),
        F.col("value").alias("session_length"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        seconds("ts").alias("event_time"),
        (seconds("ts") + 30 * (F.col("event_id") % 7)).alias("available_at"),
        k.cast("long").alias("__k"),
    )
    # p_partkey is part's key; grouping says so, and Spark leaves the join out where the category isn't asked for. Else the
    # join meets the products that events have, counted at run time, so that few hot products aren't a shuffle's only keys
    used = events.select(F.get_json_object("props", "$.k").cast("long").alias("__k")).distinct()
    types = part.select(F.col("p_partkey").alias("__k"), F.col("p_type").alias("product_category")).join(used, "__k", "left_semi")
    types = types.groupBy("__k").agg(F.first("product_category").alias("product_category")).repartition("__k")
    return base.join(types, "__k", "left").drop("__k")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("product_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        (1 + F.col("p_size") % 5).cast("double").alias("rating"),
        (F.col("p_size") * F.col("p_size")).cast("long").alias("num_reviews"),
        (F.col("p_partkey") % 10 != 0).alias("in_stock"),
        (F.lit(1704067200.0) - 86400 * (F.col("p_partkey") % 60)).alias("created_at"),
        F.col("p_partkey").alias("part_key"),
    )


def item_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 of every product, version 2 of every third."""
    items = catalog(spark, sf_dir)
    first = items.select("product_id", F.col("created_at").alias("event_time"), F.col("created_at").alias("available_at"), F.concat("product_id", F.lit(":1")).alias("source_event_id"), "price")
    late = F.lit(1704931200.0)
    second = items.where("part_key % 3 = 0").select(
        "product_id", late.alias("event_time"), (late + 3600 * (F.col("part_key") % 5)).alias("available_at"), F.concat("product_id", F.lit(":2")).alias("source_event_id"), (F.col("price") * 1.1).alias("price")
    )
    return first.unionByName(second).withColumn("version", F.lit(VERSION))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = interactions(spark, sf_dir).where("action = 'view'")
    n = F.col("event_id").cast("long")
    return views.select(
        F.concat("event_id", F.lit(":"), "product_id").alias("observation_id"),
        F.concat(F.lit("imp"), "event_id").alias("impression_id"),
        "user_id",
        "product_id",
        F.col("event_time").alias("as_of"),
        F.when(n % 11 != 0, (n % 100) / 100.0).alias("collaborative_score"),
        ((n % 50) / 50.0).alias("content_similarity_score"),
        ((n % 20) / 20.0).alias("popularity_score"),
        F.when(n % 13 != 0, F.concat(F.lit('{"hour":'), (n % 24).cast("string"), F.lit("}"))).alias("context"),
        F.lit(VERSION).alias("version"),
    )


def slates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each impression and product."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    lines = own.repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(  # one shuffle for the groups and the join
        F.min("l_linenumber").alias("position"), (F.min("l_discount") * 10).alias("collaborative_score"),
        (F.min("l_tax") * 12.5).alias("content_similarity_score"), (F.min("l_quantity") / 50).alias("popularity_score"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", seconds("o_orderdate").alias("created_at"))
    return lines.join(orders, "l_orderkey").select(
        F.concat(F.lit("imp"), F.col("l_orderkey").cast("string")).alias("impression_id"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("product_id"),
        "position", "collaborative_score", "content_similarity_score", "popularity_score", "created_at",
        (F.col("collaborative_score") * 0.4 + F.col("content_similarity_score") * 0.3 + F.col("popularity_score") * 0.3).alias("combined_score"),
    )


def slate_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases on slate rows."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A')")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", seconds("o_orderdate").alias("created_at"))
    return lines.join(orders, "l_orderkey").select(
        F.concat_ws("-", F.lit("f"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("event_id"),
        F.concat(F.lit("imp"), F.col("l_orderkey").cast("string")).alias("impression_id"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("product_id"),
        F.when(F.col("l_returnflag") == "R", "purchase").otherwise("click").alias("action"),
        (F.col("created_at") + 60 * F.col("l_linenumber")).alias("occurred_at"),
        F.col("l_extendedprice").alias("value"),
    )


CTES = {
    "interactions": """interactions as (
  select cast(e.event_id as varchar) as event_id, 'u' || e.user_id as user_id, 'p' || json_extract_string(e.props, '$.k') as product_id,
    case e.event_type when 'signup' then 'add_to_cart' when 'error' then 'remove_from_cart' else e.event_type end as action,
    e.value as session_length, e.ts as event_ts, epoch(e.ts) as event_time, epoch(e.ts) + 30 * (e.event_id % 7) as available_at, p.p_type as product_category
  from events e left join part p on p.p_partkey = cast(json_extract_string(e.props, '$.k') as bigint))""",
    "catalog": """catalog as (
  select 'p' || p_partkey as product_id, p_name as title, p_type as category, p_brand as brand, p_retailprice as price,
    cast(1 + p_size % 5 as double) as rating, cast(p_size * p_size as bigint) as num_reviews, p_partkey % 10 <> 0 as in_stock,
    1704067200.0::double - 86400 * (p_partkey % 60) as created_at, p_partkey as part_key from part)""",
    "item_history": f"""item_history as (
  select product_id, created_at as event_time, created_at as available_at, product_id || ':1' as source_event_id, price, '{VERSION}' as version from catalog
  union all
  select product_id, 1704931200.0::double, 1704931200.0::double + 3600 * (part_key % 5), product_id || ':2', price * 1.1::double, '{VERSION}' from catalog where part_key % 3 = 0)""",
    "observations": f"""observations as (
  select event_id || ':' || product_id as observation_id, 'imp' || event_id as impression_id, user_id, product_id, event_time as as_of,
    case when event_id::bigint % 11 <> 0 then (event_id::bigint % 100) / 100.0::double end as collaborative_score,
    (event_id::bigint % 50) / 50.0::double as content_similarity_score, (event_id::bigint % 20) / 20.0::double as popularity_score,
    case when event_id::bigint % 13 <> 0 then '{{"hour":' || (event_id::bigint % 24) || '}}' end as context, '{VERSION}' as version
  from interactions where action = 'view')""",
    "slates": """slates as (
  select 'imp' || l_orderkey as impression_id, 'u' || o_custkey as user_id, 'p' || l_partkey as product_id, position, collaborative_score, content_similarity_score,
    popularity_score, epoch(o_orderdate) as created_at,
    collaborative_score * 0.4::double + content_similarity_score * 0.3::double + popularity_score * 0.3::double as combined_score
  from (select l_orderkey, l_partkey, min(l_linenumber) as position, min(l_discount) * 10 as collaborative_score, min(l_tax) * 12.5::double as content_similarity_score,
      min(l_quantity) / 50 as popularity_score from lineitem group by 1, 2) join orders on o_orderkey = l_orderkey)""",
    "feedback": """feedback as (
  select concat_ws('-', 'f', l_orderkey, l_linenumber, l_partkey, l_suppkey) as event_id, 'imp' || l_orderkey as impression_id, 'u' || o_custkey as user_id,
    'p' || l_partkey as product_id, case l_returnflag when 'R' then 'purchase' else 'click' end as action, epoch(o_orderdate) + 60 * l_linenumber as occurred_at,
    l_extendedprice as value
  from lineitem join orders on o_orderkey = l_orderkey where l_returnflag in ('R', 'A'))""",
}
_NEEDS = {"item_history": ["catalog"], "observations": ["interactions"]}


def oracle(names: str, body: str) -> str:
    """DuckDB SQL: the named views (a space between), then the body, which may start with more views and a comma."""
    chosen: list[str] = []
    for name in names.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in chosen:
                chosen.append(needed)
    body = body.strip()
    head = ",\n".join(CTES[n] for n in chosen)
    return f"with {head}{', ' if not body.lower().startswith('select') else ' '}\n{body}"
