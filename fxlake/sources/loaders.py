"""Users, products and contents from CSV files, and vectors from base64 text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_embedding(text: Column, dim: int) -> Column:
    """Little-endian 32-bit floats in base64 -> array<float> of `dim`: shorter ones are padded with zeros, longer ones cut.
    Null, empty and broken text (no base64, or bytes that aren't whole floats) gives zeros.

    Signs, exponents and fractions are taken from the bits, so it is all done by functions of the JVM.
    """
    letters = F.regexp_replace(text, r"[^A-Za-z0-9+/=]", "")  # base64 readers pass over other characters
    bits = F.hex(F.try_to_binary(letters, F.lit("base64")))

    def word(b: Column, i: Column) -> Column:
        byte = lambda k: F.substring(b, 8 * i + 2 * k + 1, F.lit(2))
        return F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long")

    def value(w: Column) -> Column:
        power, fraction = F.shiftright(w, 23).bitwiseAND(F.lit(0xFF).cast("long")), w.bitwiseAND(F.lit(0x7FFFFF).cast("long"))
        normal = (1 + fraction / float(1 << 23)) * F.pow(F.lit(2.0), (power - 127).cast("double"))
        special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        size = F.when(power == 255, special).when(power == 0, fraction * F.pow(F.lit(2.0), F.lit(-149.0))).otherwise(normal)
        return (F.when(w >= 1 << 31, -1.0).otherwise(1.0) * size).cast("float")

    # the bits are an array of one element, so that they are made once and not for each place
    known = F.transform(F.array(bits), lambda b: F.when((F.length(b) > 0) & (F.length(b) % 8 == 0), F.transform(F.sequence(F.lit(0), F.least(F.lit(dim), (F.length(b) / 8).cast("int")) - 1), lambda i: word(b, i))))
    found = F.transform(F.coalesce(F.element_at(known, 1), F.array().cast("array<bigint>")), value)
    return F.slice(F.concat(found, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted fields may hold line ends, quotes are doubled."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _text(rows: DataFrame, name: str, default: str | None) -> Column:
    """The column, or the default where the file hasn't it; empty fields are null."""
    return F.col(name) if name in rows.columns else F.lit(default).cast("string")


def load_users(spark: SparkSession, path: str, now: float) -> DataFrame:
    """Users with features before any interaction and a map of demographics. Rows without an id are left out."""
    rows = _read(spark, path)
    facts = {"country": "US", "platform": "unknown", "preferred_language": "en-US", "marketing_source": "unknown", "membership_level": "Silver", "signup_date": ""}
    pairs = [x for name, default in facts.items() for x in (F.lit(name), _text(rows, name, default))]
    return rows.where("user_id is not null").select(
        "user_id", F.lit(0).cast("long").alias("total_interactions"), F.lit(0.0).alias("avg_session_length"), F.array().cast("array<string>").alias("preferred_categories"), F.lit(0.5).alias("price_sensitivity"),
        F.lit(0.0).alias("click_through_rate"), F.lit(0.0).alias("conversion_rate"), F.lit(now).alias("last_active"), F.create_map(*pairs).alias("demographics"),
    )


def load_products(spark: SparkSession, path: str, now: float) -> DataFrame:
    """Products. Availability is a word; the description is made of title and category; a rating may be missing. A price that
    is no number fails the job."""
    rows = _read(spark, path)
    title, category, brand = _text(rows, "title", "Unknown Product"), _text(rows, "product_category", "Unknown"), _text(rows, "brand", "Unknown")
    blank = lambda name: F.coalesce(_text(rows, name, ""), F.lit(""))
    there = F.lower(_text(rows, "availability", "in_stock")).isin("in_stock", "in stock", "available") if "availability" in rows.columns else F.lit(True)
    rating = _text(rows, "product_rating", None).cast("double")
    return rows.where("product_id is not null").select(
        "product_id", title.alias("title"), F.concat(blank("title"), F.lit(" - "), blank("product_category")).alias("description"), F.coalesce(_text(rows, "price_value", "0").cast("double"), F.lit(0.0)).alias("price"),
        _text(rows, "currency", "USD").alias("currency"), category.alias("category"), brand.alias("brand"), F.when(~F.isnan(rating), rating).alias("rating"), F.lit(0).cast("long").alias("num_reviews"),
        F.coalesce(there, F.lit(False)).alias("in_stock"), F.array(blank("product_category"), blank("brand")).alias("tags"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )


def content_columns(rows: DataFrame, dim: int = 128, width: int = 512) -> DataFrame:
    """Contents from rows of text: lists cut at commas and trimmed, product mentions (the transcript's first 100 characters
    and the first three texts seen), and the visual vector padded to `width`."""
    items = lambda name: F.filter(F.transform(F.split(F.coalesce(_text(rows, name, ""), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    spoken, seen = F.coalesce(_text(rows, "audio_transcript", ""), F.lit("")), items("ocr_text")
    number = lambda name, default: F.coalesce(_text(rows, name, None).cast("double"), F.lit(default))
    vector = F.concat(decode_embedding(_text(rows, "visual_embedding_128d", None), dim), F.array_repeat(F.lit(0.0).cast("float"), width - dim))
    mentions = F.concat(F.when(spoken != "", F.array(F.substring(spoken, 1, 100))).otherwise(F.array().cast("array<string>")), F.slice(seen, 1, 3))
    return rows.where("video_id is not null").select(
        F.col("video_id").alias("content_id"), vector.alias("visual_embedding"), items("scene_labels").alias("detected_objects"), seen.alias("extracted_text"), mentions.alias("product_mentions"),
        F.struct((spoken != "").alias("has_audio"), spoken.alias("audio_transcript"), number("audio_sentiment", 0.0).alias("audio_sentiment")).alias("audio_features"),
        F.struct(F.size(seen).alias("total_text_regions"), F.coalesce(_text(rows, "ocr_text", ""), F.lit("")).alias("ocr_text"), number("quality_score", 0.5).alias("quality_score")).alias("text_features"),
    )


def load_content(spark: SparkSession, path: str) -> DataFrame:
    return content_columns(_read(spark, path))
