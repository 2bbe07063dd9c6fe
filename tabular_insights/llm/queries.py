"""One query for each operator, over whole tables, and the SQL that states its rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabular_insights.llm import audit, bpe, counts, fingerprint, hyperminhash, jaccard, langid, lm, mixing, oracles, quality, substrings, suffix, variants
from tabular_insights.llm.common import WORD, documents
from tabular_insights.session import stage


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    measured = stage(quality.measure(docs.select("doc_id", "lang", "text")).drop("text"), "measured")
    names, cutoffs = quality.learn(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "lang")
    judged = quality.judge(quality.with_stratum(measured, names, "lang"), cutoffs)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("rejected_by", ",").alias("rejected_by"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeated(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.array_join(F.regexp_extract_all("kept_text", F.lit(WORD), F.lit(0)), " ")
    return done.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = fingerprint.compare_with_edit(documents(spark, sf_dir))
    return compared.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.size("edited_places").cast("long").alias("n_edited_paragraphs"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    models = langid.train(docs, ~F.coalesce(held_out, F.lit(True)))
    return langid.predict(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(documents(spark, sf_dir))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    return scored.select(
        "doc_id", "n_words", "n_backed_off",
        F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_log_score"),
    )


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_similar(documents(spark, sf_dir))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeated_bytes(documents(spark, sf_dir))
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


#: Targets of the mixture: tempered sources, even languages, and topics by share.
MIXTURE = {
    "source": 0.5,
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2},
    "topic": {"prose": 0.9, "brief": 0.04},
}
MIXTURE_SHARE = 0.4


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    counted = docs.select(
        "doc_id", "source", "lang", mixing.form_topic().alias("topic"), mixing.token_count().alias("n_tokens")
    )
    counted = stage(counted, "counted")
    dimensions = {n: F.col(n) for n in MIXTURE}
    return mixing.mix(counted, MIXTURE, MIXTURE_SHARE, dimensions, F.col("n_tokens"))[0]


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(documents(spark, sf_dir))


QUERIES = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_quality_rules": op2_quality_rules,
    "op3_merkle_fingerprints": op3_merkle_fingerprints,
    "op4_lm_scores": op4_lm_scores,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op9_language_id": op9_language_id,
    "op10_substring_dedup": op10_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op2_quality_rules": oracles.QUALITY,
    "op4_lm_scores": oracles.LM,
    "op5_ngram_jaccard_join": oracles.JACCARD,
    "op10_substring_dedup": oracles.SUBSTRINGS,
    "op11_filter_interactions": oracles.INTERACTIONS,
    "op12_minhash_near_dedup": oracles.NEAR_DUPLICATES,
}
