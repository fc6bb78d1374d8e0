"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and all that the one before kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm import byte_tokens, language_id, near_duplicates, packing, quality, substrings
from lexigraph.llm.common import documents, materialize, whole_text, with_first_names

SHINGLE_WORDS, THRESHOLD_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language margin is narrow.

    A null or empty text goes, as it has no letter; null languages are not learnt from; without any learnt language all
    documents go; repeated rows have one verdict; other columns, of any name, stay; an empty table stays empty.
    """
    learn = docs.select("doc_id", "text", "lang")
    found = language_id.classify(docs, language_id.fit_dictionaries(learn), language_id.fit_margin(learn))
    return with_first_names(found.where(~F.col("rejected")), docs.columns, language_id.ADDED)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are outliers of their language and source.

    A null or empty text fails the base rules; null languages and sources are cells of their own; equal distances and
    repeated rows have one verdict; other columns, of any name, stay; an empty table stays empty.
    """
    added = (*quality.COUNTS, *quality.MORE)
    counted = materialize(quality.with_counts(docs), "quality-counted")
    slim = counted.select("lang", "source", *added)
    out = quality.judge(counted, quality.fit_cells(slim)).where("kept")
    return with_first_names(with_first_names(out, counted.columns, quality.VERDICT), docs.columns, added)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group.

    Null and blank texts are in no group and stay; of a group without ids that with the least hash of its text stays;
    rows that repeat doc_id and text are one document and stay or go together; other columns, of any name, stay; an empty
    table stays empty.
    """
    found = near_duplicates.near_duplicates(docs, SHINGLE_WORDS, THRESHOLD_PERCENT)
    kept = found.where("kept").select(F.col("doc_id").alias("_lx_id"), F.col("text_key").alias("_lx_text")).distinct()
    keyed = docs.withColumn("_lx_key", F.xxhash64(whole_text()))
    return keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_lx_id")) & (F.col("_lx_key") == F.col("_lx_text")), "left_semi").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that stand in an earlier document; documents of which nothing is left go.

    Earlier is by doc_id, nulls last, then by the hash of the row; a null text stays null, an empty one stays; n_chars is
    that of what is left (null for null); rows that repeat doc_id and text are one document; other columns, of any name,
    stay; an empty table stays empty.
    """
    cleaned = substrings.remove_repeats(docs)
    left = F.trim(F.coalesce("text", F.lit(""))) != ""
    out = with_first_names(cleaned.where(left | (F.col("n_removed") == 0)), docs.columns, substrings.ADDED)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 ids.

    A null text counts as empty, a piece with the end id alone; pieces of equal length go by doc_id and start; repeated
    rows are packed each; other columns are not looked at; an empty table gives an empty result.
    """
    return packing.pack_documents(docs, byte_tokens.default_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Compression, robust estimates and first-fit decreasing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
