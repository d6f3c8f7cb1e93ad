"""From raw documents to packed training windows: five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maxentnet.llm import _work, mixing, ngram_join, packing, suffix_dedup, toxicity
from maxentnet.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No stage but the mix can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _key() -> Column:
    """doc_id, or for a null one a number of its own text's, beyond others."""
    return F.coalesce(F.col("doc_id"), F.pmod(F.xxhash64("text"), F.lit(1 << 61)) + F.lit(1 << 61))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, unchanged; nulls and empty texts are scored like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, labels, keep=COLUMNS[1:]).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id (null ones last); repeated rows stay once. A document without words is in no group."""
    docs = docs.select(*COLUMNS, _key().alias("_key"))
    found = ngram_join.near_duplicates(docs, "_key")
    stay = found.filter("component_id = _key").select("_key").distinct()
    return docs.join(stay, "_key", "left_semi").dropDuplicates(["_key", "text"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes or more that a document with a smaller doc_id has; n_chars counts what stays."""
    rest = suffix_dedup.remove_repeats(docs, keep=("lang", "source"), text_out=True)
    return rest.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the one across its source's cut with its first words only; n_chars counts what is taken."""
    mixed = mixing.mix(docs, keep=("text", "lang"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.col("taken") - times * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), times), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    taken = mixed.withColumn("_words", F.explode(copies))
    begun = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "), F.lit(1), F.col("_words").cast("int")), " ")
    text = F.when(F.col("_words") == 0, F.col("text")).otherwise(begun)
    return taken.withColumn("text", text).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, placed in a window of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("mix", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = _work.written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
