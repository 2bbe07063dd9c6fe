"""Filter audit, HyperMinHash near-duplicates, spelling variants, and rows that share an id."""

import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import texts as plain
from pyspark.sql import functions as F

import corpus_pipeline
from tabular_insights.llm import audit, hyperminhash, jaccard, queries, variants
from tabular_insights.llm.packing import unpack

SF_DIR = "/root/testdata/sf0.001"
LABELS = [(1, 1, 0), (2, 0, 1), (6, 1, 1), (6, None, None), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


# Filter audit


def audited(rows, labels):
    """The report by applying every order to every document."""
    none = float("inf")
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", none), none if i is None else i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = []
    for i, t, part in rows:
        t = t or ""
        w = plain.words(t)
        fails = "".join(
            letter
            for letter, bad in zip(
                "ABCDE",
                [
                    len(w) < 100,
                    100 * len(set(w)) < 80 * len(w),
                    100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                    re.search("[#$%&*|]", t),
                    (none if i is None else i) > first[t],
                ],
            )
            if bad
        )
        judged.append((part or "", fails, i in good, i in toxic))
    report = {}
    for part in {p for p, *_ in judged}:
        mine = [x for x in judged if x[0] == part]
        shapley = Counter(next(c for c in o if c in f) for o in map("".join, permutations("ABCDE")) for _, f, *_ in mine if f)
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                left = [x for x in mine if not set(order[: step - 1]) & set(x[1])]
                gone = [x for x in left if letter in x[1]]
                report[part, order, step] = (
                    len(left) - len(gone), len(gone), sum(letter in x[1] for x in mine) - len(gone),
                    sum(x[1] == letter for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone), shapley[letter],
                )
    return report


def report_of(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in df.collect()}


def test_audit_of_awkward_documents(spark, monkeypatch):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = [(r[0], r[1], r[2]) for r in plain.AWKWARD] + [(20, "A#B " * 60, "en"), (21, "A#B " * 60, "en"), (None, "A#B " * 60, None)]
    docs = plain.awkward(spark, [(*r, *plain.AWKWARD[0][3:]) for r in rows]).repartition(3)
    expected = audited(rows, LABELS)
    assert report_of(audit.audit(docs, labels)) == expected
    monkeypatch.setattr(audit, "SHARD_BYTES", 50)
    assert report_of(audit.audit(docs.withColumnsRenamed({"ids": "words", "row": "shard"}), labels)) == expected
    assert audit.audit(plain.awkward(spark, []), labels).count() == 0


def test_op11(spark, documents):
    labels = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert report_of(queries.op11_filter_interactions(spark, SF_DIR)) == audited(documents, labels)


def test_the_matrix_is_the_counts_of_words(spark):
    texts = ["b a b", "", None, "a c", "c c c d"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    matrix, dictionary = audit.document_terms(docs, F.col("text"), {"id": F.col("id"), "words": F.lit("x")})
    names = {r.term: r.word for r in dictionary.collect()}
    assert sorted(names.values()) == list("abcd")
    found = {}
    for shard in matrix.collect():
        ends, terms, counts = (unpack(bytes(shard[c])).astype(int) for c in ("ends", "terms", "counts"))
        for row, start, end in zip(shard.rows, np.append(0, ends), ends):
            found[row.id] = {names[t]: n for t, n in zip(terms[start:end], counts[start:end])}
    assert found == {i: Counter((t or "").split()) for i, t in enumerate(texts)}


# Near-duplicates


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if text else text


def near(rows):
    """Per row its set size and the smallest id reachable, by comparing all pairs."""
    sets = [plain.shingles(lowered(t), 4) for _, t in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                above[top(a)] = top(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if top(b) == top(a) and rows[b][0] is not None]
        lowest = min(ids, default=None) if sets[a] else i
        out.append((i, len(sets[a]), lowest, i == lowest))
    return Counter(out)


def columns_of(df):
    return plain.table(df, "doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates_of_awkward_documents(spark):
    rows = plain.texts() + [(i, plain.LINE.upper() + f" {i % 3}") for i in range(30, 40)] + [(1, "other text of one id")]
    docs = plain.awkward(spark, [(*r, *plain.AWKWARD[0][2:]) for r in rows]).repartition(3)
    assert columns_of(hyperminhash.near_duplicates(docs)) == near(rows)
    assert hyperminhash.near_duplicates(plain.awkward(spark, [])).count() == 0


def test_chains_and_large_groups(spark, monkeypatch):
    """Chains whose ends are unlike, clusters bridged by one text, and blocks of few members."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 120])) for k in range(40)]
    rows += [(100 + k, " ".join([*words[:100], f"x{k}", *words[101:160]])) for k in range(40)]
    rows += [(200 + k, " ".join(words[200 + k : 206 + k])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = near(rows)
    assert columns_of(hyperminhash.near_duplicates(docs)) == expected
    monkeypatch.setattr(hyperminhash, "BLOCK", 7)
    monkeypatch.setattr(hyperminhash, "BLOCK_SHINGLES", 900)
    assert columns_of(hyperminhash.near_duplicates(docs)) == expected


def test_op12(spark, documents):
    got = columns_of(queries.op12_minhash_near_dedup(spark, SF_DIR))
    assert got == near([(i, t) for i, t, _ in documents])


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(3)
    for size, shared in ((2000, 1600), (2000, 600), (150, 140), (12, 10)):
        found = []
        for _ in range(40):
            pool = rng.integers(0, 2**64, 2 * size - shared, dtype=np.uint64)
            a, b = np.sort(pool[:size]), np.sort(pool[size - shared :])
            sketches = [hyperminhash.sketch(s)[None] for s in (a, b)]
            found.append(hyperminhash.estimate(*sketches, np.array([size]), np.array([size]))[0][0])
        assert np.mean(found) == pytest.approx(shared / (2 * size - shared), abs=0.03)


def test_a_pair_at_the_threshold_survives_its_estimate():
    least = hyperminhash.least_estimates(80)
    assert least[160] == pytest.approx(0.8 - 4.9 * (0.16 / 160) ** 0.5, abs=0.02)
    assert all(least[n] < 0.8 for n in range(161))


# Spelling variants


def brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_cut = {}
    for w in known:
        for cut in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by_cut.setdefault(cut, set()).add(w)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    near_to, form = {}, {}
    for w in known:
        cuts = {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}
        near_to[w] = [x for x in set().union(*(by_cut.get(c, ()) for c in cuts)) if x != w and one_edit(w, x)]
        best = min(near_to[w], key=lambda x: (-known[x], x), default=None)
        if best and known[best] >= 2 * known[w]:
            form[w] = best
    found = {}
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        found[w] = (form.get(w), root, n, len(near_to[w]), known.get(form.get(w)))
    return found


def variants_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_op13(spark, documents):
    assert variants_of(queries.op13_spelling_variants(spark, SF_DIR)) == brute_variants([(i, t) for i, t, _ in documents])


def test_variants_of_awkward_words(spark):
    times = lambda word, n: f" {word}" * n
    text = times("abcde", 40) + times("abcdef", 18) + times("abcdeff", 8) + times("abcdefff", 3) + times("ABCDX", 5)
    text += times("aaaaa", 3) + times("aaaaaa", 6) + times("aaaaaaa", 12) + times("éàüßñ", 4) + times("éàüßÑ", 9) + times("×÷àbc", 3)
    text += times("xbcde", 40) + times("bcdea", 3) + times("abdce", 3) + times("q" * 300, 3) + times("q" * 299 + "r", 7) + "1abcde2_abcde"
    rows = [*plain.texts(), (50, text), (51, None), (None, text)]
    docs = plain.awkward(spark, [(*r, *plain.AWKWARD[0][2:]) for r in rows])
    expected = brute_variants(rows)
    assert expected["abcdefff"][1] in ("abcde", "abcdeff") and expected["q" * 300][0]
    assert variants_of(variants.group_variants(docs)) == expected
    assert variants.group_variants(plain.awkward(spark, [])).count() == 0


# Rows that share an id, and columns of any name, in the pipeline


def test_one_row_of_each_group_whatever_the_ids(spark):
    other = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, plain.LINE), (1, other), (2, other + " end"), (3, "unlike the others in all"), (3, "nothing shared with it")]
    rows += [(None, plain.LINE + " x"), (None, "alone without an id at all"), (None, "alone without an id at all")] + [(9, "same row often")] * 50
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _key string").repartition(4)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one_of_each(docs).collect()), key=repr)
    assert kept == sorted(
        [(1, plain.LINE), (1, other), (3, "unlike the others in all"), (3, "nothing shared with it"),
         (None, "alone without an id at all"), (9, "same row often")], key=repr,
    )


def test_stages_hand_on_columns_of_any_name(spark):
    names = ["n_words", "stratum", "kept", "probability", "drawn", "rejected_by", "n_removed", "removed", "kept_text", "cell__lang", "class_id"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for _, function in corpus_pipeline.STAGES[:-1]:
        done = function(spark, docs, SF_DIR)
        assert done.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in done.collect() for n in names)
