"""Queries of cold-start vectors, candidate generation, catalog activation and CSV loaders, with their SQL twins."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxlake.operators import activation as A
from fxlake.operators import coldstart as R
from fxlake.operators import generation as G
from fxlake.operators import windows as W
from fxlake.operators.candidates import l2_normalize
from fxlake.plans.core import _POOLS, POSITIVE, serving_pools
from fxlake.plans.streams import scratch
from fxlake.session import ship_package
from fxlake.sources import loaders
from fxlake.sources.model import NOW, catalog, interactions, oracle, slates, table
from fxlake.streaming import history as H

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLE_SQL[name] = sql


# ---------------------------------------------------------------- cold start


def _items(spark, sf_dir) -> DataFrame:
    """Items by number: content vector, facts of the product of that number, and features for the ridge."""
    ship_package(spark)
    facts = catalog(spark, sf_dir).select(F.col("part_key").alias("id"), F.struct("category", "brand", "price").alias("facts"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    nothing = F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("double").alias("price"))
    rows = rows.join(facts, "id", "left").withColumn("facts", F.coalesce("facts", nothing))
    return rows.withColumn("features", R.content_features(F.col("vector"), F.log1p(F.coalesce("facts.price", F.lit(0.0))) / 10))


def _trained(items: DataFrame) -> DataFrame:
    """Every id that isn't divisible by 50 has a collaborative vector: eight turned and mixed places of the content."""
    mixed = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.element_at("vector", i) - 0.5 * F.element_at("vector", i + 8))
    return items.where("id % 50 <> 0").select("id", "features", mixed.alias("cf"))


_EM = """u as (select vec_id as id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as v from embeddings)"""
query(
    "ridge_gram",
    oracle("catalog", f"""{_EM}, x as (select id, list_append(list_append(v, ln(1 + coalesce(price, 0)) / 10), 1.0::double) as x from u left join catalog on part_key = id where id % 50 <> 0),
cells as (select id, unnest(range(1, len(x) + 1)) as i, unnest(x) as a from x)
select a.i - 1 as i, b.i - 1 as j, round(sum(a.a * b.a), 4) as value from cells a join cells b using (id) where a.i <= b.i and (a.i <= 3 or b.i >= len((select x from x limit 1)) - 1) group by 1, 2"""),
    lambda s, d: (lambda m: s.createDataFrame([(i, j, round(float(m[i, j]), 4)) for i in range(len(m)) for j in range(i, len(m)) if i < 3 or j >= len(m) - 2], "i long, j long, value double"))(
        R.gram(_trained(_items(s, d)), "features", "cf")[0]
    ),
)


def _sets(spark, sf_dir) -> DataFrame:
    items = _items(spark, sf_dir)
    trained = _trained(items).select("id", F.col("cf").alias("vector"))
    return R.neighbour_sets(items.where("id % 50 = 0"), items, trained, neighbours=10, least=2, similarity=0.2)


query(
    "synthetic_neighbors",
    oracle("catalog", f"""{_EM}, near as (select a.id as id, b.id as other, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 6) as s from u a, u b where a.id % 50 = 0 and a.id <> b.id),
top as (select * from near where s >= 0.2 qualify row_number() over (partition by id order by s desc, other) <= 20),
kept as (select * from top where other % 50 <> 0 qualify row_number() over (partition by id order by s desc, other) <= 10),
enough as (select id from kept group by 1 having count(*) >= 2 and avg(s) >= 0.2),
facts as (select k.*, case when a.category = b.category then 1.25 else 1.0 end::double * case when a.brand = b.brand then 1.1 else 1.0 end::double *
    case when greatest(a.price, b.price) / least(a.price, b.price) >= 3 then 0.6 when greatest(a.price, b.price) / least(a.price, b.price) >= 2 then 0.8 else 1.0 end::double as aff
  from kept k join enough using (id) left join catalog a on a.part_key = k.id left join catalog b on b.part_key = k.other),
logits as (select *, s / 0.07::double + ln(aff) as l from facts)
select id, other as product_id, round(exp(l - max(l) over w) / sum(exp(l - m)) over w, 6) as weight, round(avg(s) over w * (0.5::double + 0.5::double * least(1, count(*) over w / 10)), 6) as confidence
from (select *, max(l) over (partition by id) as m from logits) window w as (partition by id)"""),
    lambda s, d: _sets(s, d).select("id", "confidence", F.explode("neighbors").alias("x")).select("id", "x.product_id", F.round("x.weight", 6).alias("weight"), F.round("confidence", 6).alias("confidence")),
)


def synthetic(spark, sf_dir) -> DataFrame:
    """id, vector and confidence of the cold items; beside the ridge's part no SQL can say what it is, so tests hold it against numpy."""
    items = _items(spark, sf_dir)
    model = R.fit_ridge(_trained(items), "features", "cf")
    return R.synthetic_embeddings(_sets(spark, sf_dir), R.predict_ridge(items.where("id % 50 = 0").select("id", "features"), model))


query("synthetic_embeddings", None, synthetic)

# ---------------------------------------------------------------- candidates

_clusters = lambda s, d: catalog(s, d).select("product_id", (F.col("part_key") % 7).alias("cluster"))


def _users(spark, sf_dir) -> DataFrame:
    """Users of interactions: their last category as context, the categories of their features, a content cluster for a third."""
    events = interactions(spark, sf_dir)
    last = events.where("trim(coalesce(product_category, '')) <> ''").groupBy("user_id").agg(F.max_by("product_category", F.struct("event_time", "event_id")).alias("c"))
    rows = events.select("user_id").distinct().join(last, "user_id", "left").join(W.user_features(events).select("user_id", "preferred_categories"), "user_id", "left")
    n = F.substring("user_id", 2, 20).cast("long")
    return rows.select("user_id", F.array("c").alias("context_categories"), F.lit(None).cast("array<string>").alias("speech_categories"), "preferred_categories", F.when(n % 3 == 0, F.array((n % 7).cast("string"))).alias("content_clusters"))


def _preferred(spark, sf_dir, users: DataFrame | None = None) -> DataFrame:
    events = interactions(spark, sf_dir).where(F.col("action").isin("click", "add_to_cart", "purchase"))
    return G.preferred_pools(_users(spark, sf_dir) if users is None else users, events, _clusters(spark, sf_dir))


_PREFERRED = f"""everyone as (select distinct user_id from interactions), named as (select * from interactions where trim(coalesce(product_category, '')) <> ''),
ctx as (select user_id, arg_max(product_category, (event_time, event_id)) as c from named group by 1),
firsts as (select user_id, product_category, min((event_time, event_id)) as f from named group by 1, 2),
prefs as (select user_id, list(product_category order by f, product_category)[:10] as cats from firsts group by 1),
cat2 as (select user_id, list_filter([c, list_filter(cats, lambda x: x <> c)[1]], lambda x: x is not null) as l from ctx join prefs using (user_id)),
pos as (select i.user_id, c.part_key % 7 as cluster, row_number() over (partition by i.user_id order by event_time desc, event_id desc) as rn from interactions i join catalog c using (product_id) where action in {POSITIVE} qualify rn <= 2),
content as (select user_id, 0 as rn, user_id[2:]::bigint % 7 as cluster from everyone where user_id[2:]::bigint % 3 = 0),
four as (select user_id, cluster, row_number() over (partition by user_id order by rn) as k from (select user_id, rn, cluster from content union all select user_id, rn, cluster from pos) qualify k <= 2),
one as (select user_id, cluster, row_number() over (partition by user_id order by min(k)) - 1 as place, count(*) over (partition by user_id) as share from four group by 1, 2),
preferred as (select user_id, 'category:' || unnest(l) as pool, 'category_pool' as source, unnest(range(len(l))) as place, len(l) as share from cat2
  union all select user_id, 'cluster:' || cluster, 'cluster_pool', place, share from one)"""
query("preferred_pools", oracle("interactions catalog", f"{_PREFERRED} select * from preferred"), lambda s, d: _preferred(s, d))


def _written(df: DataFrame, name: str) -> DataFrame:
    """df, made once for its several readers."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _generated(spark, sf_dir, **options) -> DataFrame:
    users = _written(_users(spark, sf_dir), "candidate-users")
    scores = ("collaborative_score", "content_similarity_score")
    rows = _written(slates(spark, sf_dir).groupBy("user_id", "product_id").agg(*[F.round(F.max(c), 6).alias(c) for c in scores]), "candidate-scores")
    best = lambda c: rows.select("user_id", "product_id", F.col(c).alias("score"))
    fresh = catalog(spark, sf_dir).where("part_key % 50 = 3").select("product_id", F.round(F.col("rating") / 5, 6).alias("score"))
    seen = _written(interactions(spark, sf_dir).select("user_id", "product_id").distinct(), "candidate-seen")
    pools = _written(serving_pools(spark, sf_dir), "candidate-pools")
    return G.generate_candidates(users, {"cf": best(scores[0]), "content": best(scores[1])}, _preferred(spark, sf_dir, users), pools, fresh, seen, catalog(spark, sf_dir), **options)


query(
    "generate_candidates",
    oracle("interactions catalog slates", f"""{_POOLS}, {_PREFERRED}, seen as (select distinct user_id, product_id from interactions),
cf as (select user_id, product_id, round(max(collaborative_score), 6) as score from slates join everyone using (user_id) anti join seen using (user_id, product_id) group by 1, 2 qualify row_number() over (partition by user_id order by score desc, product_id) <= 40),
co as (select user_id, product_id, round(max(content_similarity_score), 6) as score from slates join everyone using (user_id) group by 1, 2 qualify row_number() over (partition by user_id order by score desc, product_id) <= 20),
wanted as (select user_id, 'global' as pool, 'trending_pool' as source, 1 as share from everyone union all select user_id, pool, source, share from preferred),
probed as (select w.user_id, w.source, p.product_id, p.score from wanted w join served p using (pool) anti join seen s on s.user_id = w.user_id and s.product_id = p.product_id
  qualify row_number() over (partition by w.user_id, w.pool order by p.rank) <= greatest(1, 30 // w.share)),
fresh as (select product_id, round(rating / 5, 6) as score from catalog where part_key % 50 = 3 order by score desc, product_id limit 10),
every as (select user_id, product_id, 'cf' as source, 1 as o, 'cf' as kind, score from cf union all select co.user_id, co.product_id, 'content', 4, 'content', score from co anti join seen using (user_id, product_id)
  union all select user_id, product_id, source, list_position(['trending_pool', 'category_pool', 'cluster_pool'], source) + 4, 'popularity', score from probed
  union all select e.user_id, f.product_id, 'new_item', 8, 'cf', score from everyone e cross join fresh f anti join seen s on s.user_id = e.user_id and s.product_id = f.product_id),
steps as (select user_id, product_id, source, o, max(score) filter (where kind = 'cf') as a, max(score) filter (where kind = 'content') as b, max(score) filter (where kind = 'popularity') as c from every group by 1, 2, 3, 4),
merged as (select user_id, product_id, string_agg(source, '+' order by o) as sources, 0.4::double * coalesce(max(a), 0) + 0.3::double * coalesce(max(b), 0) + 0.3::double * coalesce(max(c), 0) as combined_score from steps group by 1, 2)
select user_id, product_id, sources, round(combined_score + 1e-9::double, 6) as combined_score, row_number() over (partition by user_id order by merged.combined_score desc, product_id) as rank from merged qualify rank <= 500"""),
    lambda s, d: _generated(s, d, caps={"random": 0}, diversity=None).select("user_id", "product_id", "sources", F.round(F.col("combined_score") + 1e-9, 6).alias("combined_score"), "rank"),  # no halves
)
query(
    "random_candidates",
    oracle("interactions catalog slates", """per as (select user_id, count(*) as n from interactions group by 1) select user_id, 10 as n, 10 as n_distinct, 10 as ranks, 0 as unknown from per"""),
    lambda s, d: (lambda r: r.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("n_distinct"), F.max("rank").alias("ranks"), F.count_if(~F.col("known")).alias("unknown")))(
        G.draw(interactions(s, d).select("user_id").distinct().withColumn("need", F.lit(10)), catalog(s, d).select("product_id"), 7).join(catalog(s, d).select("product_id", F.lit(True).alias("k")), "product_id", "left").withColumn("known", F.coalesce("k", F.lit(False)))
    ),
)

# ---------------------------------------------------------------- catalog activation


def _outbox(spark, sf_dir) -> tuple[DataFrame, dict]:
    ship_package(spark)
    rows = catalog(spark, sf_dir).select("product_id", F.to_json(F.struct("price", "brand", "product_id")).alias("snapshot"))
    return A.prepare_catalog_activation(rows, "v7", NOW, NOW + 5)


_ACTIVATED = """c as (select product_id, sha256(concat_ws(chr(0), product_id, 'v7')) as event_id, sha256('{"brand":"' || brand || '","price":' || regexp_replace(price::double::varchar, '\\.0$', '') || ',"product_id":"' || product_id || '"}') as payload_hash, part_key from catalog)"""
query(
    "catalog_activation",
    oracle("catalog", f"{_ACTIVATED} select event_id, '{hashlib.sha256(b'catalog_activation' + bytes(1) + b'v7').hexdigest()}' as activation_id, product_id, payload_hash, (select count(*) from c) as expected_count from c"),
    lambda s, d: (lambda o, a: o.select("event_id", "activation_id", "product_id", "payload_hash", F.lit(a["expected_count"]).alias("expected_count")))(*_outbox(s, d)),
)


def _gaps(spark, sf_dir) -> DataFrame:
    """The outbox through the history's parser, where some events never arrive and some arrive with an older payload."""
    outbox, activation = _outbox(spark, sf_dir)
    n = F.substring("product_id", 2, 20).cast("long")
    raw = outbox.where(n % 31 != 0).select(F.lit("catalog-feature-events").alias("topic"), F.lit(0).alias("partition"), F.xxhash64("event_id").alias("offset"), F.lit(0).cast("long").alias("timestamp"), "value")
    path = scratch(spark, "raw")
    raw.write.parquet(path)
    rows = H.once(H.parse_history(spark.read.schema(H.RAW).parquet(path))).where("target_table = 'item_feature_history'")
    rows = rows.withColumn("payload_hash", F.when(F.substring("entity_id", 2, 20).cast("long") % 37 == 0, F.sha2(F.lit("older"), 256)).otherwise(F.col("payload_hash")))
    return A.activation_gaps(outbox, rows, activation)


query("activation_gaps", oracle("catalog", f"{_ACTIVATED} select event_id, case when part_key % 31 = 0 then 'missing' else 'other_payload' end as reason from c where part_key % 31 = 0 or part_key % 37 = 0"), _gaps)

# ---------------------------------------------------------------- loaders


def _encoded(spark, sf_dir) -> DataFrame:
    """Documents' first letters as vectors in base64, so the bits are known: 128 floats of 1 + code / 256."""
    codes = F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: F.coalesce(F.ascii(F.substring("text", i, F.lit(1))), F.lit(0)) % 128)
    # 1 + c / 256 is sign 0, exponent 127, fraction c << 15: bytes 00, (c & 1) << 7, 0x80 | c >> 1, 3F
    word = lambda c: F.concat(F.lit("00"), F.lpad(F.hex(F.shiftleft(c.bitwiseAND(F.lit(1)), 7)), 2, "0"), F.lpad(F.hex(F.shiftright(c, 1) + 128), 2, "0"), F.lit("3F"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(codes, word), "").alias("bits"), F.col("doc_id").alias("n"))
    text = F.base64(F.unhex(F.when(F.col("n") % 3 == 0, F.substring("bits", 1, 400)).otherwise(F.col("bits"))))
    return rows.select("doc_id", F.when(F.col("n") % 7 == 0, "not base64!").otherwise(text).alias("encoded"))


query(
    "decode_embedding",
    """with codes as (select doc_id, list_transform(range(1, 129), lambda i: case when i > length(coalesce(text, '')) then 0 else unicode(text[i]) % 128 end) as c from documents)
select doc_id, case when doc_id % 7 = 0 then 0 else list_sum(list_transform(list_zip(c, range(1, 129)), lambda p: case when doc_id % 3 = 0 and p[2] > 50 then 0 else (256 + p[1]) * p[2] end)) end::bigint as weighted from codes""",
    lambda s, d: _encoded(s, d).select("doc_id", loaders.decode_embedding(F.col("encoded"), 128).alias("v")).select(
        "doc_id", F.aggregate(F.transform("v", lambda x, i: x.cast("double") * 256 * (i + 1)), F.lit(0.0), lambda a, x: a + x).cast("long").alias("weighted")
    ),
)


def _csv(spark, rows: DataFrame, name: str) -> str:
    path = scratch(spark, name)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


def _loaded_users(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("user_id"), F.col("c_nationkey").cast("string").alias("country"), F.col("c_mktsegment").alias("marketing_source"))
    return loaders.load_users(spark, _csv(spark, rows, "users"), NOW).select("user_id", "total_interactions", "price_sensitivity", *[F.col(f"demographics.{c}").alias(c) for c in ("country", "platform", "marketing_source", "membership_level")])


query("load_users", "select 'u' || c_custkey as user_id, 0 as total_interactions, 0.5::double as price_sensitivity, c_nationkey::varchar as country, 'unknown' as platform, c_mktsegment as marketing_source, 'Silver' as membership_level from customer", _loaded_users)


def _loaded_products(spark, sf_dir) -> DataFrame:
    n = F.col("part_key")
    rows = catalog(spark, sf_dir).select(
        "product_id", "title", F.col("price").alias("price_value"), F.col("category").alias("product_category"), "brand", F.when(n % 4 != 0, F.col("rating")).alias("product_rating"),
        F.when(n % 5 == 0, "In Stock").when(n % 5 == 1, "available").when(n % 5 == 2, "sold out").otherwise("in_stock").alias("availability"),
    )
    return loaders.load_products(spark, _csv(spark, rows, "products"), NOW).select("product_id", "description", F.round("price", 4).alias("price"), "currency", "rating", "in_stock", F.array_join("tags", "|").alias("tags"))


query("load_products", oracle("catalog", "select product_id, title || ' - ' || category as description, round(price, 4) as price, 'USD' as currency, case when part_key % 4 <> 0 then rating end as rating, part_key % 5 <> 2 as in_stock, category || '|' || brand as tags from catalog"), _loaded_products)


def _loaded_content(spark, sf_dir) -> DataFrame:
    """Documents as spoken text, with the words of their sources as lists."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select(
        F.concat(F.lit("v"), "doc_id").alias("video_id"), F.regexp_replace(F.substring("text", 1, 300), r"\s+", " ").alias("audio_transcript"), F.concat_ws(" , ", "lang", F.lit(""), "source", "lang", "source").alias("ocr_text"),
        F.when(F.col("doc_id") % 2 == 0, F.concat_ws(",", "source", "lang")).alias("scene_labels"), F.when(F.col("doc_id") % 3 == 0, "0.25").alias("audio_sentiment"),
    )
    out = loaders.load_content(spark, _csv(spark, rows, "content"))
    return out.select("content_id", F.array_join("extracted_text", "|").alias("seen"), F.array_join("detected_objects", "|").alias("objects"), F.sha2(F.array_join("product_mentions", "|"), 256).alias("mentions"), F.size("visual_embedding").alias("width"), "audio_features.audio_sentiment", "text_features.total_text_regions")


query(
    "load_content",
    r"""with t as (select doc_id, regexp_replace(text[:300], '\s+', ' ', 'g') as x, lang, source from documents where text is not null), spoken as (select *, trim(x, ' ') as y from t)
select 'v' || doc_id as content_id, list_aggregate(list_filter([lang, source, lang, source], lambda v: v is not null), 'string_agg', '|') as seen, case when doc_id % 2 = 0 then concat_ws('|', source, lang) else '' end as objects,
  sha256(array_to_string(list_concat(case when y = '' then [] else [y[:100]] end, list_filter([lang, source, lang, source], lambda v: v is not null)[:3]), '|')) as mentions, 512 as width,
  case when doc_id % 3 = 0 then 0.25 else 0.0 end::double as audio_sentiment, len(list_filter([lang, source, lang, source], lambda v: v is not null)) as total_text_regions from spoken""",
    _loaded_content,
)
