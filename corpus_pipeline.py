"""From raw documents to token ids: each stage works on what the one before it kept.

Every stage takes (spark, docs, sf_dir). `docs` has the columns of documents; all stages but the last return those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fxlake.llm import bpe, decontaminate, linededup, minhash, quality
from fxlake.llm.common import materialize, read_table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold. Null and empty texts have one score, so they stay or go together;
    rows that repeat an id are scored each by its text."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="__score").where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that stand elsewhere. A document all of whose lines do goes; n_chars is counted anew."""
    out = linededup.dedup_lines(docs, counts=("__n_lines", "__n_dropped"))
    left = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    out = out.where(left | (F.col("__n_dropped") == 0))
    return out.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group at a similarity of 0.8 (op8_minhash asks for 0.85). Of rows
    that repeat an id and a text one stays; rows that repeat an id with other texts stay or go together. Rows without
    an id stay."""
    groups = minhash.near_duplicates(docs, threshold=0.8).where("not kept").select("doc_id").distinct()
    kept = docs.join(groups, "doc_id", "left_anti").select(*docs.columns)
    again = materialize(kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows without an id and without text stay; rows that repeat an id go
    together if one of them has a passage."""
    found = decontaminate.leaks(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian unsigned 32-bit) and whether they decode to the text, for every row; a
    null text is an empty one."""
    path, pattern = bpe.default_vocabulary()
    ranks = bpe.read_ranks(spark, path)
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text"), ranks, pattern), ranks)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("quality", reject_low_quality),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("tokens", tokenize),
]

#: The classifier and the tokenizer are beyond SQL. Tests: `near_duplicates` against brute force over all pairs, `quality`
#: against its operator's scores, `lines` against hand cases, `tokens` by round trip, every stage on the edge table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
