"""Queries of the scalar functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fxlake.functions import scalars as S
from fxlake.sources.model import NOW, catalog, interactions, observations, oracle, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLE_SQL[name] = sql


query(
    "error_reason",
    oracle("interactions", "select event_id, case when trim(coalesce(product_category, '')) = '' then 'blank_category' when session_length < 5 then 'short_session' when action = 'remove_from_cart' then 'removed' end as error from interactions"),
    lambda s, d: interactions(s, d).select("event_id", S.error_reason([(S.blank(F.col("product_category")), "blank_category"), (F.col("session_length") < 5, "short_session"), (F.col("action") == "remove_from_cart", "removed")]).alias("error")),
)
query(
    "event_time_ms",
    oracle("interactions", "select event_id, case event_id::bigint % 3 when 0 then floor(event_time * 1000)::bigint when 1 then floor(floor(event_time * 1000))::bigint else epoch_ms(date_trunc('second', event_ts)) end as ms from interactions"),
    lambda s, d: interactions(s, d).select("event_id", S.event_time_ms(
        F.when(F.col("event_id").cast("long") % 3 == 0, F.col("event_time").cast("string")).when(F.col("event_id").cast("long") % 3 == 1, F.floor(F.col("event_time") * 1000).cast("string")).otherwise("-1"),
        F.when(F.col("event_id").cast("long") % 3 == 2, F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
    ).alias("ms")),
)
query(
    "accept_event",
    oracle("interactions", f"select event_id, case when event_time < {NOW} - 20 * 86400 then 'too_old' when event_time > {NOW} + 300 then 'too_far_ahead' end as error from interactions"),
    lambda s, d: interactions(s, d).select("event_id", S.accept_event(F.col("event_time"), F.lit(NOW), 20).alias("error")),
)
def _context():
    return F.concat(
        F.lit('{"page": 3, "session_id": "'), F.repeat(F.col("event_type"), 100), F.lit('", "surface": null, "device": {"a": 1}, "location": ["x", {"y": 1}, null, '), F.col("event_id").cast("string"),
        F.lit(', [2]], "demo_mode": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("0.50"), F.lit(', "content_id": "c\\n'), F.get_json_object("props", "$.k"), F.lit('"}'),
    )


query(
    "bounded_context",
    r"""select event_id, '{"content_id":"c\n' || json_extract_string(props, '$.k') || '","demo_mode":' || case when event_id % 2 = 0 then 'true' else '0.5' end || ',"location":["x",null,' || event_id || '],"session_id":"' || substr(repeat(event_type, 100), 1, 512) || '"}' as context from events""",
    lambda s, d: table(s, d, "events").select("event_id", S.bounded_context(_context()).alias("context")),
)
query(
    "deterministic_id",
    oracle("interactions", "select event_id, sha256(event_id || chr(0) || user_id || chr(0) || product_id) as id from interactions"),
    lambda s, d: interactions(s, d).select("event_id", S.deterministic_id(F.col("event_id"), F.col("user_id"), F.col("product_id")).alias("id")),
)
query(
    "entity_bucket",
    oracle("interactions", "select distinct user_id, (('0x' || substr(sha256(user_id), 1, 8))::bigint % 32)::int as bucket from interactions"),
    lambda s, d: interactions(s, d).select("user_id", S.entity_bucket(F.col("user_id")).alias("bucket")).distinct(),
)
query(
    "stable_hash_bucket",
    oracle("catalog", "select distinct brand, (('0x' || substr(sha256(brand), 1, 16))::uhugeint % 100)::int as bucket from catalog"),
    lambda s, d: catalog(s, d).select("brand", S.stable_hash_bucket(F.col("brand"), 100).alias("bucket")).distinct(),
)
query(
    "is_recommendable",
    oracle("catalog", "select product_id from catalog where in_stock"),
    lambda s, d: (lambda c: c.where(S.is_recommendable(c)).select("product_id"))(catalog(s, d)),
)
query(
    "has_price_mention",
    r"select doc_id, regexp_matches(lower(coalesce(text, '')), '[$€£¥]|usd|eur|gbp|\d+\.?\d*\s*(dollars?|euros?|pounds?)') as priced from documents",
    lambda s, d: table(s, d, "documents").select("doc_id", S.has_price_mention(F.col("text")).alias("priced")),
)
_LINES = "string_split(lower(coalesce(text, '')), chr(10))"
_HITS = " union all ".join(f"select doc_id, '{c}' as category, least(5, len(list_filter({_LINES}, lambda l: {' or '.join(f'contains(l, {chr(39)}{w}{chr(39)})' for w in words)}))) as hits from documents" for c, words in sorted(S.CATEGORY_WORDS.items()))


def _lines():
    return F.split(F.coalesce("text", F.lit("")), "\n")


query(
    "category_scores",
    f"select doc_id, category, round(least(1.0::double, 0.5::double + 0.1::double * hits), 6) as score from ({_HITS}) where hits > 0",
    lambda s, d: table(s, d, "documents").select("doc_id", F.explode(S.category_scores(_lines())).alias("c")).select("doc_id", "c.category", "c.score"),
)
query(
    "commerce_score",
    f"""with hits as (select doc_id, sum(hits) as hits from ({_HITS}) group by 1)
select doc_id, round(0.4::double * least(1.0::double, hits / 10.0::double) + case when regexp_matches(lower(coalesce(text, '')), '[$€£¥]|usd|eur|gbp|\\d+\\.?\\d*\\s*(dollars?|euros?|pounds?)') then 0.1::double else 0 end, 6) as commerce
from documents join hits using (doc_id)""",
    lambda s, d: table(s, d, "documents").select(
        "doc_id",
        F.round(
            0.4 * F.least(F.lit(1.0), F.aggregate(S.category_scores(_lines()), F.lit(0.0), lambda a, x: a + F.round((x["score"] - 0.5) * 10, 0)) / 10)
            + F.when(S.has_price_mention(F.col("text")), 0.1).otherwise(0.0), 6,
        ).alias("commerce"),
    ),
)
query(
    "score_to_similarity",
    "select vec_id, round((embedding[1]::double + 1) / 2, 6) as ip, round(greatest(0, least(1, 1 - abs(embedding[1]::double) / 4)), 6) as l2 from embeddings",
    lambda s, d: (lambda c: table(s, d, "embeddings").select("vec_id", F.round(c.score_to_similarity(F.col("embedding")[0].cast("double"), "ip"), 6).alias("ip"), F.round(c.score_to_similarity(F.abs(F.col("embedding")[0].cast("double")), "l2"), 6).alias("l2")))(__import__("fxlake.operators.candidates", fromlist=["x"])),
)
query(
    "ltr_group_key",
    oracle("interactions", "select event_id, case when event_id::bigint % 3 = 0 then 'impression:imp' || event_id when event_id::bigint % 3 = 1 then 'session:s' || user_id else 'user_time:' || user_id || ':' || floor(event_time / 1800)::bigint end as k from interactions"),
    lambda s, d: interactions(s, d).select("event_id", S.ltr_group_key(
        F.when(F.col("event_id").cast("long") % 3 == 0, F.concat(F.lit("imp"), "event_id")), F.lit(" "),
        F.when(F.col("event_id").cast("long") % 3 == 1, F.concat(F.lit("s"), "user_id")), F.col("user_id"), F.col("event_time")).alias("k")),
)
query(
    "reason_text",
    oracle("observations", """select observation_id, 'Based on your preferences - ' || case when collaborative_score > 0.5::double then 'users with similar interests liked this' when content_similarity_score > 0.5::double then 'matches the video content you''re viewing'
  when popularity_score > 0.5::double then 'trending among other users' when split_part(observation_id, ':', 1)::bigint % 10 > 7 then 'high engagement product' when split_part(observation_id, ':', 1)::bigint % 7 > 3 then 'frequently purchased' else 'recommended for you' end as reason from observations"""),
    lambda s, d: (lambda n: observations(s, d).select("observation_id", S.reason_text(F.col("collaborative_score"), F.col("content_similarity_score"), F.col("popularity_score"), n % 10 / 10.0, n % 7 / 10.0).alias("reason")))(F.substring_index("observation_id", ":", 1).cast("long")),
)
query(
    "daily_run_id",
    oracle("interactions", "select event_id, 'pit-' || strftime(event_ts - interval 2 hours, '%Y%m%d') as run_id, epoch(date_trunc('day', event_ts - interval 2 hours))::bigint + 7200 as cutoff from interactions"),
    lambda s, d: interactions(s, d).select("event_id", S.daily_run_id(F.col("event_ts")).alias("run_id"), S.run_cutoff(F.col("event_ts")).alias("cutoff")),
)
query(
    "canonical_json",
    None,
    lambda s, d: catalog(s, d).select("product_id", S.canonical_json({"title": (F.col("title"), "string"), "price": (F.col("price"), "number"), "brand": (F.col("brand"), "string")}).alias("json")),
)
query(
    "payload_hash",
    oracle("catalog", """select product_id, sha256('{"brand":"' || brand || '","reviews":' || num_reviews || '}') as hash from catalog"""),
    lambda s, d: catalog(s, d).select("product_id", S.payload_hash(S.canonical_json({"reviews": (F.col("num_reviews"), "number"), "brand": (F.col("brand"), "string")})).alias("hash")),
)
query(
    "score_snapshot",
    "select event_id, case when event_id % 2 = 0 then 0.5::double else json_extract_string(props, '$.k')::double end as k from events",
    lambda s, d: table(s, d, "events").select("event_id", S.score_snapshot(F.when(F.col("event_id") % 2 == 0, F.lit('{"k":0.5}')), F.col("props"), ("k",))["k"].alias("k")),
)
