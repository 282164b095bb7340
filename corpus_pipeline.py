"""Corpus pipeline: language ID, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of documents;
the last returns packed pieces.  Between stages the rows are written as Parquet and read again, so a lost executor costs
one stage's work at most.  A stage keeps intermediate tables of its own in the shared folder until Spark ends, as its result is
lazy; run() drops them as soon as a stage's result is written.

* language_id drops documents without a letter and those whose language's posterior is under one half.
* exact_dedup keeps one of the documents that are equal but for ASCII white space.
* jaccard_join keeps one document of each class of word 5-gram similarity 0.8 or more.
* substring_dedup cuts every passage of 200 bytes or more that occurs at another place too; characters stay whole.
* packing makes token sequences of at most 4096.

Defined results: a null or empty text has no letter, so the first stage drops it; a null lang, source or doc_id is kept as it is, and of
equal texts one with an id stays; of repeated rows one stays; an empty table gives no pieces, and so does one without a row whose
language was learned; other columns, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionweave.llm import exact_dedup, jaccard_join, language_id, packing, substring_dedup
from sessionweave.llm.common import Scratch, table

ORACLE_SQL = None


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return language_id.identified(docs, scratch=scratch)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return exact_dedup.exact_dedup(docs, scratch=scratch)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return jaccard_join.near_dedup(docs, scratch=scratch)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return substring_dedup.removed(docs, scratch=scratch)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), scratch=scratch)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str = "") -> DataFrame:
    """All stages over docs."""
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        own = scratch.part(name)
        docs = scratch.keep(stage(spark, docs, sf_dir, own), name)
        own.remove()
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir, scratch.part(STAGES[-1][0]))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_on(spark, table(spark, sf_dir, "documents"), sf_dir)
