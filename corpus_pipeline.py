"""The training-corpus pipeline: quality classifier, exact dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them to the documents table, with each
stage's result written and read again, and a stage's scratch tables deleted when its result is written. All stages but
the last return the columns of documents.

Defined cases are those of the operators: rows with null texts count as empty; rows without an identifier are kept
unless their text is rejected or a copy; other columns, whatever their names, pass through; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chosen_path, exact_dedup, mixing, packing, quality
from tidemark.llm.common import Scratch, free, plain, released

#: Shares of tokens after mixing. "good" is the anchor: its documents are taken once, and the others as often as these
#: proportions of it ask, up or down. "poor" has no share: the first stage rejects it, and what it missed is weighted out.
TARGETS = {"good": 0.98, "toxic": 0.02}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of this corpus, does not reject."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    trees = quality.fit(_table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    (score,) = free(docs, "score")
    return quality.score(docs, trees, score).where(f"{score} >= 0.5").select(*plain(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same text, the one with the largest doc_id."""
    return exact_dedup.keep_one(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id."""
    return chosen_path.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix asks for; those whose likeliest domain is the anchor once."""
    labels = _table(spark, sf_dir, "labels")
    labelled = labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    return mixing.mixed(docs, labelled, TARGETS, _vocabulary(), anchor="good")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    out = packing.pack(docs, _vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing to target weights", mix_stage),
    ("packing", pack_stage),
]

#: No SQL states boosted trees, tokenizers or the mix: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with released():
            out = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(docs)
        docs = out
    return docs
