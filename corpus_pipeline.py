"""From raw documents to encoded training text, one stage of ``tabular_insights.llm`` each.

Every stage reads what its predecessor wrote, keeps the columns of ``documents`` (all but
the last), and treats nulls, empty texts, repeated rows and empty tables as its operator
says. Extra columns of the documents pass through the stages that keep columns, also those
that are named like a column an operator adds.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabular_insights.llm import bpe, jaccard, mixing, quality, substrings
from tabular_insights.llm.common import documents
from tabular_insights.session import stage

#: Targets of the mixture, and the share of all tokens that it draws.
TARGETS = {"source": 0.7, "lang": {"en": 0.55, "de": 0.15, "fr": 0.17, "es": 0.13}, "topic": 1.0}
SHARE = 0.75


#: Columns that the stages know; all others pass through them under names of their own.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def passing_columns(function):
    """A stage that hands on all columns of its documents as they were, whatever their names."""

    @wraps(function)
    def passed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in KNOWN else f"passed__{i}" for i, c in enumerate(docs.columns)}
        done = function(spark, docs.withColumnsRenamed(names), sf_dir)
        return done.select(*[F.col(new).alias(old) for old, new in names.items()])

    return passed


@passing_columns
def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and every certified rule of their stratum."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels).select(*docs.columns)


@passing_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest id."""
    return jaccard.keep_one_of_each(docs)


@passing_columns
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that an earlier document has; ``n_chars`` follows."""
    done = substrings.remove_repeated(docs)
    changed = {"text": F.when(F.col("text").isNotNull(), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumns(changed).select(*docs.columns)


@passing_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents of the mixture."""
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.form_topic()}
    mixed, _ = mixing.mix(docs, TARGETS, SHARE, dimensions, mixing.token_count())
    return mixed.filter("drawn").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left, and the text that they decode to."""
    return bpe.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", reject_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]

#: Raking, MinHash candidates and byte-pair merges are beyond SQL; tests compare the
#: stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
