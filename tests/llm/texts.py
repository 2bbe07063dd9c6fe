"""Small fixtures and plain versions of what the operators compute."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept_text string, row int, core string, bucket int, n_words string, _group string"
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, LINE, "en", "a", 1, "x", "k", 1, "c", 1, "n", "g"),
    (1, LINE, "en", "a", 1, "x", "k", 1, "c", 1, "n", "g"),
    (2, LINE + " more words here", None, None, None, None, None, None, None, None, None, None),
    (3, None, "en", "b", None, "x", None, 1, None, 1, None, None),
    (4, "", None, "b", 0, "x", "k", 1, "c", 1, "n", "g"),
    (5, " \t\n ", "fr", None, 4, "x", "k", 1, "c", 1, "n", "g"),
    (None, "prefix " + LINE, "de", "a", 9, "x", "k", 1, "c", 1, "n", "g"),
    (None, None, None, None, None, None, None, None, None, None, None, None),
    (6, LONG, "en", "b", None, "x", "k", 1, "c", 1, "n", "g"),
    (7, LONG + " end", "en", "b", None, "x", "k", 1, "c", 1, "n", "g"),
    (8, "x" * 3000 + "é" * 600, "es", "a", None, "x", "k", 1, "c", 1, "n", "g"),
    (9, "¡Ñandú!\n\n'S it’s <|endoftext|> 12 ½ ΣΑΣ", "es", "a", None, "x", "k", 1, "c", 1, "n", "g"),
    (10, "short one", "en", "a", None, "x", "k", 1, "c", 1, "n", "g"),
]


def awkward(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, SCHEMA)


def texts(rows=AWKWARD):
    return [(r[0], r[1]) for r in rows]


def words(text):
    return WORD.findall(text or "")


def table(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def kept_words(documents, width=13):
    """For each (id, text): words and kept words, windows judged on the input."""
    none = float("inf")
    first = {}
    for i, text in documents:
        w = words(text)
        for at in range(len(w) - width + 1):
            key = tuple(w[at : at + width])
            first[key] = min(first.get(key, none), none if i is None else i)
    out = []
    for i, text in documents:
        w = words(text)
        gone = [False] * len(w)
        for at in range(len(w) - width + 1):
            if first[tuple(w[at : at + width])] < (none if i is None else i):
                gone[at : at + width] = [True] * width
        out.append((i, w, [x for x, g in zip(w, gone) if not g]))
    return out


def kept_bytes(documents, length=400):
    """For each text its bytes and the mask of removed ones."""
    data = [(t or "").encode() for t in documents]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((d, gone))
    return out


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def similar(documents, threshold=0.8):
    """Per id: (class, group, links), by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in documents}
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    shared = Counter((a, b) for ids in where.values() for n, a in enumerate(sorted(ids)) for b in sorted(ids)[n + 1 :])
    parent, links, classes = {i: i for i in sets}, Counter(), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    for i in sorted(sets):
        classes.setdefault(sets[i] or i, i)
    return {i: (classes[s or i], root(i), links[i]) for i, s in sets.items()}


def base_measures(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed
