"""The corpus pipeline: language ID, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matewise.llm import langid, mixing, neardup, packing
from matewise.llm.common import stash

#: A text with fewer than this share of n-grams known to its best language is in none of them.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that no learned language explains: without letters, or with too few known n-grams.

    The filters are learned from the stage's own labelled documents; with none, nothing is known
    and nothing is dropped.  Null and empty texts have no letters; repeated rows share their fate.
    """
    filters = langid.fit(docs)
    if not filters.languages:
        return docs
    told = langid.predict(docs, filters, lang_out="__lang", score_out="__score")
    return told.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, one with the smallest id.

    Rows are told apart by id and text, so one id may stand for several different documents,
    and rows that are equal in both are one.  Documents without an id stay.
    """
    found = stash(neardup.near_duplicates(docs), "groups")
    gone = found.where("NOT sole").select(F.col("id").alias("__gone"), F.col("place").alias("__gone_place")).distinct()
    named = docs.where("doc_id IS NOT NULL").withColumn("__place", F.xxhash64("text"))
    kept = named.join(gone, (named["doc_id"] == gone["__gone"]) & (named["__place"] == gone["__gone_place"]), "left_anti")
    if found.where("id IS NOT NULL").groupBy("id", "place").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "__place"])
    return kept.drop("__place").unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at weights 3, 1, 2: one row per document and pass, with the words that pass takes.

    Documents without words have none to give; rows that are equal in id, source and text give
    theirs through one of them; a null source is one of its own; an empty table gives an empty mix.
    """
    rows, _, pieces = mixing.mix(docs)
    out = mixing.mixed_documents(docs, rows, pieces)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents of the mix in sequences of 2048 ids, one row per piece.

    A null or empty text is the end id alone; repeated rows and rows without an id are packed
    each; an empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: SQL can express neither the sketches nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
