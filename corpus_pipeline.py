"""Corpus pipeline: quality rules, near-duplicates, repeated strings, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns what the next one reads.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.llm import bpe, mixing, quality, simhash, suffix_dedup
from grafloom.llm.common import discard, folders_made, materialize, read_table, sweep
from grafloom.llm.queries import vocabulary_path

#: Repeated strings of this many bytes are cut: half of what the operator's own query takes,
#: so that a passage of somewhat over 50 words, short ones too, holds several of them.
REPEAT_BYTES = 200


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep; rules of ``quality.keep_good``.

    Null, empty and blank texts go, null ids are scored like others, repeated rows are kept
    or go alike, an empty table stays empty.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id; rules of ``simhash.drop_near_duplicates``.

    Null, empty and blank texts are one group; null ids are never the smallest; of repeated
    rows one stays; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the strings of REPEAT_BYTES bytes that also start earlier (smaller doc_id, or earlier in the text).

    One copy of each passage stays.  Null and empty texts stay as they are and n_chars
    follows the text; other rules as in ``suffix_dedup.cut_repeats``.
    """
    cut = suffix_dedup.cut_repeats(docs, width=REPEAT_BYTES, first_stays=True)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, none to three; rules of ``mixing.take_mix``.

    Null, empty and blank texts are not taken; null ids are ordered by their text; repeated
    rows are documents of their own; an empty table stays empty.
    """
    return mixing.take_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row of the mix, and the digest of their decoding; rules of ``bpe.bpe_round_trip``.

    A null text has no tokens; null ids and repeated rows come back as they are; an empty
    table gives an empty result.
    """
    return bpe.bpe_round_trip(docs, vocabulary_path())


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeated_strings),
    ("mix", mix_to_targets),
    ("bpe", tokenize),
]

#: SQL has no 64-bit XXH64, suffix order or BPE: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row.

    What a stage held in the shared folder goes when its result is written there; the last
    stage's input and tables stay, as its result reads them.
    """
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        since = folders_made()
        old, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            sweep(spark, since, docs)
            if k:
                discard(old)
    return docs
