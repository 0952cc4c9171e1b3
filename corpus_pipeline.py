"""A corpus pipeline over ``documents``: toxicity, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. A text that is null counts as empty and goes through all stages; null ids take part; repeated rows are copies and one stays;
an empty table gives no rows; other columns go along as they are, whatever their names, up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bpe, mixing, pii, simhash, toxicity
from tapeloom.llm.common import stored

#: Token shares of what stays after toxic documents went; prose keeps its tokens, junk is thinned out to its share.
TARGETS = {"prose": 0.95, "junk": 0.05}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold. A null text counts as empty; ids that are null or repeated, ties, very long texts,
    empty tables and other columns are as in ``toxicity.without_toxic``."""
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; of repeated ids, the one with the least hash of
    its text; rows without id as in ``simhash.one_of_each``."""
    return simhash.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows. A null text stays null; all rows stay."""
    return pii.sanitise(docs)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, for the token shares of TARGETS. Texts without words stay once."""
    return mixing.mixed(docs, mixing.domains_of(_labels(spark, sf_dir)), TARGETS, "prose")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and token_ids (little-endian unsigned 32-bit integers) of every document."""
    made = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=False)
    return made.select("doc_id", "source", "lang", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_dedup", without_copies),
    ("pii", without_personal_data),
    ("mixing", mixed_to_weights),
    ("bpe", encoded),
]
#: No stage but the duplicates' join could be SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
