"""Scalar functions of the event and feature contracts, as Columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The parts of a request's context that are kept with an impression.
CONTEXT_KEYS = ("session_id", "surface", "device", "time_of_day", "location", "priority", "demo_mode", "content_id", "category", "request_category", "recommendation_count")
#: The words by which a text names a category.
CATEGORY_WORDS = {
    "electronics": ("electronics", "phone", "smartphone", "headphone", "headphones", "earbud", "earbuds", "laptop", "camera", "tablet", "speaker", "手機", "耳機", "筆電", "電腦", "电脑", "相機", "相机", "平板", "音響"),
    "fashion": ("clothing", "shirt", "dress", "shoes", "sneakers", "jacket", "bag", "watch", "jewelry", "衣服", "上衣", "洋裝", "连衣裙", "鞋", "球鞋", "外套", "包包", "手錶", "手表", "珠寶", "珠宝"),
    "home": ("furniture", "kitchen", "home decor", "sofa", "chair", "家具", "廚房", "厨房", "家飾", "家饰", "沙發", "沙发", "椅子"),
    "beauty": ("cosmetics", "skincare", "perfume", "makeup", "化妝品", "化妆品", "保養", "保养", "香水", "彩妝", "彩妆"),
    "books": ("book", "books", "novel", "書", "书", "小說", "小说"),
    "toys": ("toy", "gaming", "game", "玩具", "遊戲", "游戏"),
}


def error_reason(checks: list[tuple[Column, str]]) -> Column:
    """The reason of the first check that holds, else null."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(reason)) for bad, reason in checks])


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def event_time_ms(*values: Column) -> Column:
    """The first value above 0, in milliseconds. Numbers (or numeric text) below 1e10 are seconds; other text is an ISO instant."""

    def one(c: Column) -> Column:
        text = c.cast("string")
        n = text.try_cast("double")
        number = F.when(n > 0, F.when(n < 1e10, F.floor(n * 1000)).otherwise(F.floor(n)))
        return F.coalesce(number, F.when(n.isNull(), F.unix_millis(F.try_to_timestamp(text))))

    return F.coalesce(*map(one, values))


def accept_event(event_time: Column, received: Column, oldest_days: int = 30, ahead_seconds: int = 300) -> Column:
    """null if the time is finite, at most 30 days old and at most five minutes ahead, else the reason."""
    return error_reason([
        (event_time.isNull() | F.isnan(event_time) | (F.abs(event_time) == float("inf")), "not_finite"),
        (event_time < received - oldest_days * 86400, "too_old"),
        (event_time > received + ahead_seconds, "too_far_ahead"),
    ])


def bounded_context(context: Column, most_chars: int = 512, most_items: int = 20) -> Column:
    """JSON text of a context cut to CONTEXT_KEYS, which come sorted: texts to 512 characters, lists to their first 20 items,
    of which objects and lists go. Objects, nulls and anything that is no JSON object give nothing."""
    j = F.try_parse_json(context)
    kind = lambda text: F.substring(text, 1, 1)
    cut = lambda text: canonical_text(F.substring(text, 1, most_chars))

    def scalar(x: Column) -> Column:
        text = F.to_json(x)
        return F.when(kind(text) == '"', cut(F.try_variant_get(x, "$", "string"))).otherwise(text)

    parts = []
    for key in sorted(CONTEXT_KEYS):
        text, items = F.to_json(F.try_variant_get(j, f"$.{key}", "variant")), F.try_variant_get(j, f"$.{key}", "array<variant>")
        kept = F.filter(F.transform(F.slice(items, 1, most_items), lambda x: F.coalesce(scalar(x), F.lit("null"))), lambda t: ~kind(t).isin("{", "["))
        listed = F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]"))
        value = F.when(kind(text) == '"', cut(F.try_variant_get(j, f"$.{key}", "string"))).when(kind(text) == "[", listed).when((kind(text) != "{") & (text != "null"), text)
        parts.append(F.concat(F.lit(f'"{key}":'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical_text(c: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def deterministic_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def entity_bucket(entity_id: Column, buckets: int = 32) -> Column:
    return (F.conv(F.substring(F.sha2(entity_id, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def stable_hash_bucket(value: Column, n: int) -> Column:
    """The first eight bytes of SHA-256, unsigned, modulo n."""
    return (F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")).cast("int")


def canonical_number(x: Column) -> Column:
    """A decimal without trailing zeros or exponent, for magnitudes from 1e-18 to 1e20: 42.0 -> 42, 1e-7 -> 0.0000001."""
    text = F.regexp_replace(x.cast("double").cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(x == 0, F.lit("0")).otherwise(text)


def canonical_json(fields: dict[str, tuple[Column, str]]) -> Column:
    """JSON of a closed schema {name: (column, 'string' | 'number')}: keys sorted, no spaces, nulls kept."""

    def quoted(c: Column) -> Column:
        return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)

    parts = []
    for name in sorted(fields):
        column, kind = fields[name]
        value = F.coalesce(quoted(column) if kind == "string" else canonical_number(column), F.lit("null"))
        parts.append(F.concat(F.lit(f'"{name}":'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def payload_hash(json: Column) -> Column:
    return F.sha2(json, 256)


def is_recommendable(product: DataFrame) -> Column:
    """Not inactive, out of stock or deleted; unknown metadata passes."""
    known = [F.coalesce(F.col(c), F.lit(True)) for c in ("is_active", "in_stock") if c in product.columns]
    if "is_deleted" in product.columns:
        known.append(~F.coalesce(F.col("is_deleted"), F.lit(False)))
    return reduce(Column.__and__, known, F.lit(True))


#: A currency sign or code anywhere, or a number before a currency's name. Fixed values.
PRICE = r"[$€£¥]|usd|eur|gbp|\d+\.?\d*\s*(dollars?|euros?|pounds?)"


def has_price_mention(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(PRICE)


def category_scores(texts: Column) -> Column:
    """array<struct(category, score)>: min(1, 0.5 + 0.1 x the texts of the array that have a keyword of the category), for
    each category that any text names. Null texts name none."""
    low = F.transform(texts, lambda t: F.lower(F.coalesce(t, F.lit(""))))
    found = []
    for category, words in sorted(CATEGORY_WORDS.items()):
        named = F.filter(low, lambda t: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in words]))  # noqa: B023
        found.append(F.struct(F.lit(category).alias("category"), F.size(named).alias("hits")))
    kept = F.filter(F.array(*found), lambda x: x["hits"] > 0)
    return F.transform(kept, lambda x: F.struct(x["category"].alias("category"), F.round(F.least(F.lit(1.0), 0.5 + 0.1 * x["hits"]), 6).alias("score")))


def ltr_group_key(impression: Column, request: Column, session: Column, user: Column, t: Column) -> Column:
    """impression > request > session > user (or `unknown`) and half hour."""
    tag = lambda kind, c: F.when(~blank(c), F.concat(F.lit(f"{kind}:"), c))
    return F.coalesce(tag("impression", impression), tag("request", request), tag("session", session), F.concat(F.lit("user_time:"), F.when(blank(user), "unknown").otherwise(user), F.lit(":"), F.floor(F.greatest(t, F.lit(0.0)) / 1800).cast("string")))


def reason_text(collaborative: Column, content: Column, popularity: Column, ctr: Column, cvr: Column) -> Column:
    """Why a product is recommended: the first score above its bound. Nulls are below."""
    reasons = [
        (collaborative > 0.5, "users with similar interests liked this"), (content > 0.5, "matches the video content you're viewing"), (popularity > 0.5, "trending among other users"),
        (ctr > 0.7, "high engagement product"), (cvr > 0.3, "frequently purchased"),
    ]
    return F.concat(F.lit("Based on your preferences - "), F.coalesce(*[F.when(test, F.lit(text)) for test, text in reasons], F.lit("recommended for you")))


def daily_run_id(ts: Column, hour: int = 2) -> Column:
    """The run of the last boundary at `hour` UTC."""
    return F.concat(F.lit("pit-"), F.date_format(F.date_trunc("day", ts - F.expr(f"interval {hour} hours")), "yyyyMMdd"))


def run_cutoff(ts: Column, hour: int = 2) -> Column:
    return F.unix_seconds(F.date_trunc("day", ts - F.expr(f"interval {hour} hours"))) + 3600 * hour


def score_snapshot(scores: Column, item: Column, names: tuple[str, ...]) -> Column:
    """Nested scores (JSON) win over the item's own (JSON)."""
    return F.struct(*[F.coalesce(F.get_json_object(scores, f"$.{n}"), F.get_json_object(item, f"$.{n}")).try_cast("double").alias(n) for n in names])


def feature_snapshot(item: Column) -> Column:
    """Price, category, brand and candidate source of an item (JSON): its snapshot's own, else the item's."""
    own, top = (lambda n: F.get_json_object(item, f"$.feature_snapshot.{n}")), (lambda n: F.get_json_object(item, f"$.{n}"))
    source = F.coalesce(own("candidate_source"), top("source"), top("candidate_source"))
    return F.struct(*[F.coalesce(own(n), top(n)).alias(n) for n in ("price", "category", "brand")], source.alias("candidate_source"))


def training_as_of(*values: Column) -> Column:
    """Seconds of the first value that reads as a number (timestamps as seconds since the epoch), else 0.

    The callers give as_of_ts, event_time, occurred_at and timestamp, in this order.
    """
    return F.coalesce(*[c.try_cast("double") for c in values], F.lit(0.0))


@F.pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """NFKC, case folded, runs of white space as one space. Null is the empty text. Spark has neither NFKC nor folding."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t or "").casefold().split()))
