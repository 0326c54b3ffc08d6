"""A training-data pipeline over ``documents``: filter, dedup, cut repeats, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.  All but the last
return the columns of ``docs``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import mixing, near_dedup, piece_codec, quality, substring_dedup
from tracewright.llm.common import WORD

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` in the order of ``columns``, with n_chars of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of ``sf_dir``.

    Null and empty texts are scored like any other, rows with a null doc_id too; repeated rows fare alike.
    Without labels of both classes every row gets their share, or 0.5 and stays.  No rows give none.
    """
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate component stays, once.

    Documents with an empty text are no duplicates of each other and stay, as do rows with a null doc_id.  Rows of
    one doc_id are one document of as many texts: each of its different texts stays, equal ones once.
    """
    kept = near_dedup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").withColumn("text_", F.sha2("text", 256)).dropDuplicates(["doc_id", "text_"])
    return rows.select(*docs.columns).union(docs.where("doc_id is null"))


def substring_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that an earlier document has go; a document of which nothing is left goes too.

    Rows with a null doc_id or text stay as they are, as do empty texts; repeated rows fare alike.
    """
    rows = substring_dedup.remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = rows.select("doc_id", F.col("kept_text").alias("text"), "n_removed", *[F.col("more")[c].alias(c) for c in rest])
    if "n_chars" in rest:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources cut or repeated to their targets: a row for each time that the mix takes a document.

    The document at which a source's budget ends is cut to the words taken, joined by one space.  Documents without
    words add nothing to a mix and go.  Equal texts of one doc_id (or of none) and one source are taken together.
    """
    taken = mixing.mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias("of"), F.col("source").alias("from"), "text_hash")
    taken = taken.agg(F.first("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("equal"))
    rows = docs.withColumn("hash", F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("source").eqNullSafe(F.col("from")) & (F.col("hash") == F.col("text_hash")))
    rows = rows.where("equal = 1").union(rows.where("equal > 1").dropDuplicates(["doc_id", "source", "hash"]))
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least("size", F.col("taken") - F.col("size") * (F.col("turn") - 1)).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), words), " ")
    return _with_text(rows.withColumn("text", F.when(words < F.col("size"), part).otherwise(F.col("text"))), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; a null or empty text has none, a null doc_id stays null."""
    coded = piece_codec.encode(docs, TOKENIZER)
    return coded.select("doc_id", *[c for c in ("lang", "source") if c in docs.columns], F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", minhash_dedup),
    ("substring_dedup", substring_cut),
    ("mixing", source_mix),
    ("sentencepiece", encode),
]
#: A learnt filter and token ids have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
