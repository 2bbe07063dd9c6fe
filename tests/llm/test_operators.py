"""Defined results of every operator on awkward rows, against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.compute  # noqa: F401
import pytest
import texts as plain
from pyspark.sql import functions as F

import corpus_pipeline
from tabular_insights.llm import (
    bpe, common, counts, fingerprint, jaccard, langid, lm, mixing, quality, queries, substrings, suffix,
)

BPE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
DOCS = plain.texts()


@pytest.fixture(scope="module")
def docs(spark):
    return plain.awkward(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return plain.awkward(spark, [])


def test_bpe_equals_library(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    done = bpe.decode_documents(bpe.encode_documents(docs, BPE), BPE)
    expected = Counter()
    for i, text in DOCS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), np.array(ids, "<u4").tobytes(), decoded] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in done.collect()) == expected
    assert bpe.encode_documents(empty, BPE).count() == 0


def test_encoding_and_decoding_take_one_worker_of_a_task(spark, docs, empty):
    apart = bpe.decode_documents(bpe.encode_documents(docs, BPE), BPE)
    done = bpe.encode_and_decode(docs, BPE)
    rows = lambda df: Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in df.collect())
    assert done.schema == apart.schema and rows(done) == rows(apart)
    assert bpe.encode_and_decode(empty, BPE).count() == 0
    for df in (corpus_pipeline.encode(spark, docs, ""), done):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_bpe_equals_library_on_any_characters():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(BPE), bpe.codec(BPE), random.Random(5)
    pool = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list("aB 's'tΣİ\x1c\x85😀한") * 60
    pool += ["<|endoftext|>", "<|startoftext|>"] * 20
    for _ in range(1500):
        text = "".join(rng.choices(pool, k=rng.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, repr(text)
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_forced_boundaries_are_certain():
    own = bpe.codec(BPE)
    assert any(len(own.fragments(p)) > 1 for w in ("žđḿ", "日曜", "Жק", "ẍŵ") for p in own.pieces(w))
    for token in own.vocabulary:
        if token not in own.special:
            assert len(own.fragments(token.removesuffix(own.suffix))) <= 1
    word = "abc" * 500
    assert own.merge(list(word)) == own._merge_long(list(word))
    assert own.merge(list("hello")) == own._merge_long(list("hello"))


def test_token_counts_equal_library(docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in DOCS)
    assert plain.table(counts.count_tokens(docs, PIECES), "doc_id", "n_bytes", "n_tokens") == expected
    assert counts.count_tokens(empty, PIECES).count() == 0


def test_token_counts_over_several_blocks():
    rows = list(enumerate(t or "" for _, t in DOCS))
    batch = counts.pa.RecordBatch.from_arrays(
        [counts.pa.array([r[0] for r in rows], counts.pa.int64()), counts.pa.array([r[1] for r in rows])], ["row", "body"]
    )
    expected = Counter({i: sum(counts.count_pieces(PIECES, counts.pre_tokens(t))) for i, t in rows})
    for limit in (1, 40_000):
        counts.BLOCK_TOKENS, before = limit, counts.BLOCK_TOKENS
        table = counts.pa.Table.from_batches(counts._postings(3)(iter([batch])))
        counts.BLOCK_TOKENS = before
        totals = Counter()
        for bucket in range(3):
            mine = table.filter(counts.pa.compute.equal(table.column("bucket"), bucket))
            answers = counts._joined(PIECES)(mine)
            for row in range(answers.num_rows):
                out = counts._summed(answers.slice(row, 1))
                totals.update(dict(zip(out.column("row").to_pylist(), out.column("n").to_pylist())))
        assert +totals == +expected


def test_base_measures(docs, empty):
    extra = [(20, "a b c d e f g h\na b c d e f g h\n\na b", *[None] * 10), (21, "#x |y| <z>\n" * 9, *[None] * 10)]
    rows = plain.AWKWARD + extra
    measured = quality.measure(plain.awkward(docs.sparkSession, rows)).withColumn("failed", quality.base_failed())
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed"]
    expected = Counter((r[0], *plain.base_measures(r[1])) for r in rows)
    assert plain.table(measured, "doc_id", *columns) == expected
    assert quality.measure(empty).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(50, 0), (50, 1), (2000, 12), (2000, 20), (40, 3), (100_000, 900)]
    df = spark.createDataFrame(cases, "n long, k long")
    for n, k, got in df.select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.01)).collect():
        logs = [
            math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99)
            for i in range(k + 1)
        ]
        expected = sum(map(math.exp, logs)) if k <= 0.01 * n else 1.0
        assert got == pytest.approx(expected, rel=1e-6)


def labelled(spark, n):
    """Good documents without symbols, bad ones with; two languages, one of them rare."""
    body = " ".join(f"word{i}" for i in range(30))
    good = [(i, f"{body} {i}", "en", 1) for i in range(n)] + [(-i - 1, f"{body} {i}", "xx", 1) for i in range(5)]
    bad = [(n + i, f"{body} ##### ##### {i}", "en", 0) for i in range(50)] + [(2 * n + i, f"{body} ##### {i}", None, None) for i in range(3)]
    df = spark.createDataFrame([(*r[:3],) for r in good + bad], "doc_id long, text string, lang string")
    return df, spark.createDataFrame([(r[0], r[3]) for r in good + bad], "doc_id long, quality int")


def test_cutoffs_are_certified_only_with_enough_evidence(spark):
    df, labels = labelled(spark, 3000)
    measured = quality.measure(df)
    _, cutoffs = quality.learn(measured, labels, "doc_id", "lang")
    rows = {r.stratum: r.asDict() for r in cutoffs.collect()}
    assert set(rows) == {"en"}  # five documents certify nothing
    assert rows["en"]["symbol_rate"] is not None and rows["en"]["repeat_rate"] is None
    kept = quality.keep_good(df, labels)
    assert kept.filter("n_symbols > 0 AND lang = 'en'").count() == 0
    assert kept.filter("n_symbols = 0").count() == 3005
    assert kept.filter("lang IS NULL").count() == 3
    few, labels = labelled(spark, 100)
    assert quality.keep_good(few, labels).count() == few.count()


def test_a_few_hundred_good_labels_certify(spark):
    df, labels = labelled(spark, 400)
    kept = quality.keep_good(df, labels)
    assert kept.filter("n_symbols > 0 AND lang = 'en'").count() == 0
    assert kept.filter("n_symbols = 0").count() == 405


def test_every_labelled_language_is_a_stratum(spark):
    body = " ".join(f"word{i}" for i in range(30))
    rows = [(20 * i + j, f"{body} {i}" + " #####" * 2 * (i >= 400), f"l{j}", int(i < 400)) for i in range(410) for j in range(20)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    _, cutoffs = quality.learn(quality.measure(df), labels, "doc_id", "lang")
    assert {r.stratum for r in cutoffs.collect()} == {f"l{j}" for j in range(20)}
    kept = quality.keep_good(df, labels)
    assert kept.filter("n_symbols > 0").count() == 0 and kept.count() == 8000


def test_quality_without_labels_and_rows(docs, empty):
    none = docs.sparkSession.createDataFrame([], "doc_id long, quality int")
    kept = quality.keep_good(docs, none).select(*[c for c in docs.columns if c != "n_words"])
    expected = Counter(i for i, t in DOCS if not plain.base_measures(t)[-1])
    assert Counter(r.doc_id for r in kept.collect()) == expected
    assert quality.keep_good(empty, none).count() == 0


def test_fingerprints_tell_equality_and_edits(docs, empty):
    prints = fingerprint.fingerprint_documents(docs).collect()
    by_text = {}
    for (i, text), row in zip(DOCS, prints):
        assert row.doc_id == i
        assert by_text.setdefault(text or "", row.fingerprint) == row.fingerprint
    assert len(set(by_text.values())) == len(by_text)
    assert fingerprint.fingerprint_documents(empty).count() == 0
    one = "\n".join(f"line {i} " + plain.LINE for i in range(40))
    other = one.replace("line 17 ", "line changed ")
    a, b = fingerprint.fingerprint(one), fingerprint.fingerprint(other)
    assert fingerprint.edits(a, a) == [] and fingerprint.likeness(a, a) == 1.0
    assert len(fingerprint.edits(b, a)) == 1 and 0.9 < fingerprint.likeness(a, b) < 1
    assert fingerprint.likeness(a, fingerprint.fingerprint("nothing shared")) == 0
    assert fingerprint.fingerprint(None) == fingerprint.fingerprint("")


def test_edited_copies(docs, empty):
    got = fingerprint.compare_with_edit(docs).collect()
    order = sorted(DOCS, key=lambda d: (-(d[0] if d[0] is not None else -math.inf), d[1] or ""))
    expected = Counter()
    for n, (i, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        k = len(text) // 3
        expected[i, len(text), text[: len(text) - k] + after[:k]] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_text) for r in got) == expected
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert all(r.edited_fingerprint == fingerprint.fingerprint(r.edited_text) for r in got)
    assert fingerprint.compare_with_edit(empty).count() == 0
    single = fingerprint.compare_with_edit(docs.filter("doc_id = 10")).first()
    assert single.edited_text == "short " + "sho" and single.near_next == 1.0


def gram_counts(text, order):
    w = plain.words(text)
    return Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))


def backoff_scores(documents, order, min_count):
    everywhere, n_words, out = Counter(), sum(len(plain.words(t)) for _, t in documents), []
    for _, text in documents:
        everywhere.update(gram_counts(text, order))
    for i, text in documents:
        w, total, backed = plain.words(text), 0.0, 0
        others = everywhere - gram_counts(text, order)
        for at in range(len(w)):
            value = everywhere[(w[at],)] / n_words
            for n in range(2, min(order, at + 1) + 1):
                gram = tuple(w[at - n + 1 : at + 1])
                if others[gram] >= min_count:
                    value = others[gram] / others[gram[:-1]]
                else:
                    value, backed = 0.4 * value, backed + 1
            total += math.log(value)
        out.append((i, len(w), backed, round(total, 4)))
    return Counter(out)


@pytest.mark.parametrize("order, min_count", [(1, 1), (2, 2), (3, 1), (5, 1)])
def test_backoff_scores(docs, empty, order, min_count):
    got = lm.score(docs, order=order, min_count=min_count).withColumn("s", F.round("log_score", 4))
    assert plain.table(got, "doc_id", "n_words", "n_backed_off", "s") == backoff_scores(DOCS, order, min_count)
    assert lm.score(empty).count() == 0


def near_texts():
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    found = [" ".join(base)] * 3
    for n in range(90):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 8])):
            copy[rng.randrange(150)] = f"new{n}"
        found.append(" ".join(copy))
    passage = " ".join(base[:60])
    found += [passage + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(120)) for _ in range(40)]
    return list(enumerate(found, start=100))


def test_similarity_join(docs, empty, spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # several blocks for each group
    rows = near_texts() + [d for d in DOCS if d[0] is not None and d[0] > 1] + [(1, plain.LINE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.group_id, r.n_links) for r in jaccard.join_similar(df).collect()}
    assert got == plain.similar(rows)
    assert jaccard.join_similar(empty).count() == 0


def test_similarity_join_of_repeated_and_null_rows(docs):
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.join_similar(docs).collect())
    assert got[1, 1, 2] == 2 and got[2, 1, 2] + got[2, 2, 2] == 1 and got[None, None, 0] == 2 and got[4, 4, 0] == 1 and got[6, 6, 1] == 1
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    # the row without id but with a text is a near copy of row 1
    assert Counter((r.doc_id, r.text is None) for r in kept.collect() if r.doc_id in (3, None)) == Counter([(3, True), (None, True)])
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 8, 9, 10, None])


def test_pruning_keeps_what_reaches_the_threshold():
    needed = jaccard.least_agreement(0.8, 1e-6)
    assert list(needed) == sorted(needed) and needed[-1] < 0.8 * jaccard.VALUES
    rng = np.random.default_rng(1)
    lost = 0
    for _ in range(300):
        shared = rng.integers(0, 2**63, 80, dtype=np.uint64)
        one, two = (np.concatenate([shared, rng.integers(0, 2**63, 10, dtype=np.uint64)]) for _ in range(2))
        values = np.stack([jaccard.min_hash(s).astype(np.uint8) for s in (one, two)])
        lost += len(jaccard.surviving(values, np.array([0]), np.array([1]), needed)) == 0
    assert lost == 0
    far = np.stack([jaccard.min_hash(rng.integers(0, 2**63, 90, dtype=np.uint64)).astype(np.uint8) for _ in range(2)])
    assert len(jaccard.surviving(far, np.array([0]), np.array([1]), needed)) == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(2000, 2001 + i) for i in range(80)] + [(5, 5)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: root(n) for n in linked}


def byte_texts():
    rng = random.Random(3)
    draw = lambda letters, k: "".join(rng.choices(letters, k=k))
    bases = [draw("abcd ", rng.randint(500, 2500)) for _ in range(4)]
    found = []
    for _ in range(60):
        base = rng.choice(bases)
        start = rng.randrange(len(base))
        text = draw("abcd ", rng.randint(0, 300)) + base[start : start + rng.randint(100, 1500)] + draw("efgh", rng.randint(0, 200))
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + "X" + text[at + 1 :]
        found.append(text)
    return found + ["a" * 1500, "ab" * 600, "x" * 399, "y" * 400, "y" * 400]


@pytest.mark.parametrize("limit", [4096, 5])
def test_byte_removal(docs, spark, monkeypatch, limit):
    monkeypatch.setattr(suffix, "SORTED", limit)  # 5: large cores are counted by digest
    rows = [(100 + i, t) for i, t in enumerate(byte_texts())] + [(i, t and t[:9000]) for i, t in DOCS]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = Counter()
    for (i, _), (data, gone) in zip(rows, plain.kept_bytes([t for _, t in rows])):
        runs = sum(1 for a, b in zip(b"\0" + bytes(gone), bytes(gone)) if not a and b)
        expected[i, len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)] += 1
    got = suffix.remove_repeated_bytes(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got) == expected


def test_byte_removal_of_awkward_rows(docs, empty):
    got = suffix.remove_repeated_bytes(docs).collect()
    assert len(got) == len(DOCS) and {r.n_removed for r in got if r.doc_id == 7} == {len(plain.LONG)}
    assert suffix.remove_repeated_bytes(empty).count() == 0


def test_deep_shallow_order():
    rng = random.Random(4)
    for _ in range(200):
        found = [bytes(rng.choices(b"ab", k=rng.randint(0, 90))) for _ in range(rng.randint(0, 30))]
        found += [b"a" * rng.randint(30, 90) for _ in range(6)] + found[:2]
        assert [found[i] for i in suffix.deep_shallow_order(found)] == sorted(found)


def test_word_windows(docs, empty):
    rows = plain.AWKWARD + [(40 + i, f"start {i} " + " ".join(plain.LONG.split()[i * 5 : i * 5 + 30]) + " tail", *[None] * 10) for i in range(20)]
    df = plain.awkward(docs.sparkSession, rows)
    done = substrings.remove_repeated(df)
    assert set(df.columns) < set(done.columns)
    got = Counter((r.doc_id, r.n_words, r.n_removed, tuple(plain.words(r.kept_text))) for r in done.collect())
    assert got == Counter((i, len(w), len(w) - len(k), tuple(k)) for i, w, k in plain.kept_words(plain.texts(rows)))
    assert substrings.remove_repeated(empty).count() == 0


def test_removed_intervals_are_maximal(spark):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, f"a\n{text}\nb  c"), (2, text)], "doc_id long, text string")
    rows = {(r.doc_id, r.n_words): r for r in substrings.remove_repeated(df).collect()}
    assert rows[2, 43].kept_text == "a\nb  c" and [tuple(s) for s in rows[2, 43].removed] == [(1, 41)]
    assert rows[1, 40].n_removed == 0 and rows[2, 40].n_removed == 40


def raked(cells, targets, sweeps=400):
    weights = {k: t for k, t in cells.items()}
    for _ in range(sweeps):
        for d, goal in enumerate(targets):
            sums = Counter()
            for k, v in weights.items():
                sums[k[d]] += v
            weights = {k: v * goal[k[d]] / sums[k[d]] if sums[k[d]] else 0.0 for k, v in weights.items()}
    return weights


def test_raking_meets_marginals(spark):
    cells = {(s, l): 10 * (i + 1) + j * j for i, s in enumerate("abc") for j, l in enumerate("xyz")}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "cell_s string, cell_l string, tokens long")
    goal_l = {"x": 0.5, "y": 0.3, "z": 0.2}
    roots = {s: sum(v for k, v in cells.items() if k[0] == s) ** 0.5 for s in "abc"}
    goal_s = {s: v / sum(roots.values()) for s, v in roots.items()}
    got = mixing.rake(df, {"cell_s": 0.5, "cell_l": {**goal_l, "absent": 3.0}})
    expected = raked(cells, [goal_s, goal_l])
    for r in got.collect():
        assert r.weight == pytest.approx(expected[r.cell_s, r.cell_l], abs=1e-6)
    drawn = mixing.calibrate(got, 0.3).collect()
    assert sum(r.tokens * r.probability for r in drawn) == pytest.approx(0.3 * sum(cells.values()))
    free = [r for r in drawn if r.probability < 1]
    assert len({round(r.probability * r.tokens / r.weight, 6) for r in free}) == 1
    assert all(r.probability <= 1 for r in drawn)


def test_mixture_of_awkward_rows(docs, empty, monkeypatch):
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.form_topic()}
    targets = {"source": 1.0, "lang": {"en": 0.5}, "topic": 1.0}
    mixed, cells = mixing.mix(docs, targets, 0.5, dimensions, mixing.token_count())
    assert mixed.count() == len(DOCS) and set(docs.columns) < set(mixed.columns)
    assert all(0 <= r.probability <= 1 for r in mixed.collect())
    assert len({r.drawn for r in mixed.filter("doc_id = 1").collect()}) == 1
    everything, _ = mixing.mix(docs, targets, 1.0, dimensions, mixing.token_count())
    assert everything.filter("drawn").count() == len(DOCS)
    assert mixing.mix(empty, targets, 0.5, dimensions, mixing.token_count())[0].count() == 0
    monkeypatch.setattr(mixing, "MAX_VALUES", 1)
    pooled, cells = mixing.mix(docs, targets, 0.5, dimensions, mixing.token_count())
    assert pooled.count() == len(DOCS) and cells.count() <= 8


@pytest.mark.parametrize("lang", [corpus_pipeline.TARGETS["lang"], queries.MIXTURE["lang"]])
def test_values_without_a_target_are_drawn(spark, lang):
    rows = [(i, plain.LINE, v) for i, v in enumerate([*lang, None, "it"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed, _ = mixing.mix(df, {"lang": lang}, 0.25, {"lang": F.col("lang")}, mixing.token_count())
    got = {r.lang: r.probability for r in mixed.collect()}
    assert sum(got.values()) / 6 == pytest.approx(0.25)
    assert got[None] == got["it"] == pytest.approx(0.25)
    assert all(got[v] == pytest.approx(share * got["en"] / lang["en"]) for v, share in lang.items())


@pytest.mark.parametrize("task_cells", [mixing.TASK_CELLS, 10])
def test_every_value_has_its_own_target(spark, monkeypatch, task_cells):
    monkeypatch.setattr(mixing, "TASK_CELLS", task_cells)
    sizes = {f"s{i}": i + 1 for i in range(300)}
    df = spark.createDataFrame([(n, s, None if n % 2 else "en") for s, n in sizes.items()], "doc_id long, source string, lang string")
    dimensions, tokens = {n: F.col(n) for n in ("source", "lang")}, F.col("doc_id")
    mixed, cells = mixing.mix(df, {"source": 0.5, "lang": 1.0}, 0.02, dimensions, tokens)
    roots = raked({(s, n % 2): n for s, n in sizes.items()}, [{s: n**0.5 for s, n in sizes.items()}, [sum(n for n in sizes.values() if n % 2 == k) for k in (0, 1)]])
    for r in mixed.collect():
        weight = roots[r.source, r.doc_id % 2] / sum(roots.values())
        assert r.probability * r.doc_id == pytest.approx(0.02 * sum(sizes.values()) * weight, rel=1e-4)
    assert cells.count() <= 2 * (mixing.MAX_VALUES + 1)
    named, _ = mixing.mix(df, {"source": {"s0": 0.0005}, "lang": 1.0}, 0.02, dimensions, tokens)
    got = {r.source: r.probability for r in named.collect()}
    assert got["s0"] == pytest.approx(0.02 * sum(sizes.values()) * 0.0005, rel=1e-3)


def test_draws_follow_probabilities(spark):
    df = spark.range(20_000).withColumn("u", mixing.draw_number("id", 7))
    assert df.filter("u < 0.3").count() == pytest.approx(6000, rel=0.05)
    assert df.filter("u < 0 OR u >= 1").count() == 0


def test_language_of_awkward_rows(docs, empty, spark):
    words = {"en": "the and with from this", "de": "und der nicht einer über", "fr": "les des dans une être", "es": "los para como años más"}
    rng = random.Random(6)
    rows = []
    for n in range(400):
        lang = list(words)[n % 4]
        rows.append((n, " ".join(rng.choices(words[lang].split(), k=12)), lang))
    taught = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.train(taught, F.col("doc_id") % 4 != F.lit(9))
    right = langid.predict(taught, models).join(taught, "doc_id").filter("lang_pred = lang").count()
    assert right == len(rows)
    got = langid.predict(docs, models).collect()
    assert len(got) == len(DOCS)
    for r, (_, text) in zip(got, DOCS):
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= r.score <= 1
    assert langid.predict(empty, models).count() == 0
    nothing = langid.train(empty, F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    one = langid.train(taught.filter("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(taught, one).collect()} == {"en"}
