"""The registered queries over whole tables, against plain versions and held-out labels."""

import hashlib
import zlib

import pytest
import texts as plain

import corpus_pipeline
from tabular_insights.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def rows_of(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SF_DIR).collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "ngram_jaccard_join", "substring_dedup", "source_mixing", "bpe",
    ]


def test_op2(spark, documents):
    got = rows_of(spark, "op2_quality_rules")
    assert got.keys() == documents.keys()
    for i, r in got.items():
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert found == plain.base_measures(documents[i].text)
        assert not (r.base_failed and r.kept)


def test_op3(spark, documents):
    got, order = rows_of(spark, "op3_merkle_fingerprints"), sorted(documents, reverse=True)
    for n, i in enumerate(order):
        text, after = documents[i].text, documents[order[(n + 1) % len(order)]].text
        k = len(text) // 3
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), sha((text[: len(text) - k] + after[:k]).encode()))
    prints = {documents[i].text: r.fingerprint for i, r in got.items()}
    assert len(set(prints.values())) == len(prints)
    assert all(got[i].fingerprint == prints[d.text] for i, d in documents.items())
    long = [r for r in got.values() if r.n_chars > 1500]
    assert sum(0.5 < r.near_edited < 0.85 for r in long) > 0.9 * len(long)


def test_op5(spark, documents):
    got = rows_of(spark, "op5_ngram_jaccard_join")
    assert {i: (r.class_id, r.group_id, r.n_links) for i, r in got.items()} == plain.similar(
        [(i, d.text) for i, d in documents.items()]
    )


def test_op6(spark, documents):
    got = rows_of(spark, "op6_suffix_array_dedup")
    for i, (data, gone) in zip(documents, plain.kept_bytes([d.text for d in documents.values()])):
        kept = bytes(b for b, g in zip(data, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(data), sum(gone), sha(kept))


def test_op7(spark, documents):
    got = rows_of(spark, "op7_source_mixing")
    assert got.keys() == documents.keys()
    tokens = sum(r.n_tokens for r in got.values())
    assert sum(r.n_tokens * r.probability for r in got.values()) == pytest.approx(queries.MIXTURE_SHARE * tokens)
    assert all(r.n_tokens == len(plain.words(documents[i].text)) for i, r in got.items())


def test_op9(spark, documents):
    got = rows_of(spark, "op9_language_id")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == documents[i].lang for i in held) >= 0.95 * len(held)


def test_op10(spark, documents):
    got = rows_of(spark, "op10_substring_dedup")
    for i, words, kept in plain.kept_words([(i, d.text) for i, d in documents.items()]):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), len(words) - len(kept), sha(" ".join(kept).encode()))


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(stage(spark, docs, SF_DIR), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns or name == "bpe"
    good = {i for i, d in documents.items() if not plain.base_measures(d.text)[-1]}
    assert set(seen["quality_rules"]) == good
    groups = plain.similar([(i, documents[i].text) for i in good])
    assert set(seen["ngram_jaccard_join"]) == {i for i, (_, group, _) in groups.items() if i == group}
    left = [(i, r.text) for i, r in seen["ngram_jaccard_join"].items()]
    for i, _, kept in plain.kept_words(left):
        assert plain.words(seen["substring_dedup"][i].text) == kept
        assert kept != plain.words(documents[i].text) or seen["substring_dedup"][i].text == documents[i].text
    assert set(seen["bpe"]) == set(seen["source_mixing"]) < set(seen["substring_dedup"])
    whole = {r.doc_id: r.decoded for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert whole == {i: r.decoded for i, r in seen["bpe"].items()}


def test_stages_take_awkward_documents(spark):
    docs = plain.awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() <= len(plain.AWKWARD)
        assert stage(spark, plain.awkward(spark, []), SF_DIR).count() == 0
