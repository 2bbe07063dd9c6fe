"""SQL that states the rows of those queries that SQL can express."""

from __future__ import annotations

from itertools import permutations

from tabular_insights.llm import quality

_WORDS = r"""WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS text
  FROM documents
)"""

_TOKENS = f"""{_WORDS}, tokens AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)
)"""

LM = f"""{_TOKENS}, placed AS (
  SELECT *, CASE WHEN i > 2 THEN lag(before) OVER (PARTITION BY doc_id ORDER BY i) END AS earlier FROM tokens
), one AS (
  SELECT doc_id, word, count(*) AS own, sum(count(*)) OVER (PARTITION BY word) AS n FROM placed GROUP BY doc_id, word
), two AS (
  SELECT doc_id, before, word, count(*) AS own, sum(count(*)) OVER (PARTITION BY before, word) AS n
  FROM placed WHERE before IS NOT NULL GROUP BY doc_id, before, word
), three AS (
  SELECT doc_id, earlier, before, word, count(*) AS own, sum(count(*)) OVER (PARTITION BY earlier, before, word) AS n
  FROM placed WHERE earlier IS NOT NULL GROUP BY doc_id, earlier, before, word
), counted AS (
  SELECT t.doc_id, one.n / (SELECT count(*) FROM tokens)::DOUBLE AS share, two.n - two.own AS n_two,
         history.n - history.own AS n_before, three.n - three.own AS n_three, longer.n - longer.own AS n_earlier
  FROM placed t JOIN one ON t.doc_id = one.doc_id AND t.word = one.word
  LEFT JOIN one history ON t.doc_id = history.doc_id AND t.before = history.word
  LEFT JOIN two ON t.doc_id = two.doc_id AND t.before = two.before AND t.word = two.word
  LEFT JOIN two longer ON t.doc_id = longer.doc_id AND t.earlier = longer.before AND t.before = longer.word
  LEFT JOIN three ON t.doc_id = three.doc_id AND t.earlier = three.earlier AND t.before = three.before AND t.word = three.word
), scored AS (
  SELECT doc_id, coalesce((n_two = 0)::INT, 0) + coalesce((n_three = 0)::INT, 0) AS backed_off,
         ln(CASE WHEN n_three > 0 THEN n_three / n_earlier::DOUBLE
                 ELSE CASE WHEN n_three = 0 THEN 0.4 ELSE 1.0 END
                    * CASE WHEN n_two > 0 THEN n_two / n_before::DOUBLE WHEN n_two = 0 THEN 0.4 * share ELSE share END
            END) AS score
  FROM counted
), summed AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(backed_off) AS BIGINT) AS n_backed_off, sum(score) AS s
  FROM scored GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backed_off, 0) AS n_backed_off,
       round(coalesce(s, 0.0::DOUBLE), 4) AS log_score, round(coalesce(s / n_words, 0.0::DOUBLE), 6) AS mean_log_score
FROM documents LEFT JOIN summed USING (doc_id)"""

SUBSTRINGS = f"""{_TOKENS}, windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS key
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
), earliest AS (
  SELECT key, min(doc_id) AS owner FROM windows GROUP BY key
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i
  FROM windows JOIN earliest USING (key), (SELECT unnest(range(13)) AS j) WHERE owner < doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM tokens ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), removed AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

JACCARD = f"""{_WORDS.replace("WITH ", "WITH RECURSIVE ")}, shingled AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3),
           lambda i: array_to_string(w[i:i + 4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END AS s
  FROM words
), classes AS (
  SELECT s, min(doc_id) AS class_id, count(*) AS copies, len(s) AS n FROM shingled WHERE s IS NOT NULL GROUP BY s
), members AS (
  SELECT class_id, copies, n, unnest(s) AS shingle FROM classes
), links AS (
  SELECT a.class_id AS a, b.class_id AS b, any_value(b.copies) AS copies
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.class_id <> b.class_id
  GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9
), reach(node, other) AS (
  SELECT class_id, class_id FROM classes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), groups AS (
  SELECT node, min(other) AS group_id FROM reach GROUP BY node
), totals AS (
  SELECT a, count(*) AS texts, sum(copies) AS docs FROM links GROUP BY a
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(group_id, doc_id) AS group_id,
       CAST(coalesce(copies - 1, 0) + coalesce(docs, 0) AS BIGINT) AS n_links, coalesce(texts, 0) AS n_similar_texts
FROM shingled LEFT JOIN classes USING (s) LEFT JOIN groups ON class_id = node LEFT JOIN totals ON class_id = a"""

NEAR_DUPLICATES = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2),
           lambda i: array_to_string(w[i:i + 3], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END AS s
  FROM words
), classes AS (
  SELECT s, min(doc_id) AS class_id, len(s) AS n FROM shingled WHERE s IS NOT NULL GROUP BY s
), members AS (
  SELECT class_id, n, unnest(s) AS shingle FROM classes
), links AS (
  SELECT a.class_id AS a, b.class_id AS b
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.class_id <> b.class_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(node, other) AS (
  SELECT class_id, class_id FROM classes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), lowest AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       doc_id = coalesce(component_id, doc_id) AS kept
FROM shingled LEFT JOIN classes USING (s) LEFT JOIN lowest ON class_id = node"""

_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))

INTERACTIONS = rf"""{_WORDS}, flags AS (
  SELECT doc_id, coalesce(lang, '') AS part,
         ['A'[1:CAST(len(w) < 100 AS INTEGER)], 'B'[1:CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)],
          'C'[1:CAST(100 * length(regexp_replace(words.text, '[^A-Z]+', '', 'g')) > 10 * length(words.text) AS INTEGER)],
          'D'[1:CAST(regexp_matches(words.text, '[#$%&*|]') AS INTEGER)],
          'E'[1:CAST(doc_id > min(doc_id) OVER (PARTITION BY words.text) AS INTEGER)]] AS failed
  FROM words JOIN documents d USING (doc_id)
), judged AS (
  SELECT part, list_filter(failed, lambda x: x <> '') AS failed, coalesce(quality = 1, false) AS good,
         coalesce(toxic = 1, false) AS toxic
  FROM flags LEFT JOIN labels USING (doc_id)
), counted AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM judged GROUP BY part, failed
), steps AS (
  SELECT counted.*, filter_order, step, filter_order[step] AS letter,
         list_has_any(failed, string_split(filter_order[1:step - 1], '')) AS earlier, list_contains(failed, filter_order[step]) AS fails
  FROM counted, (VALUES {_ORDERS}) o(filter_order), (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) s
), report AS (
  SELECT part, filter_order, step, letter,
         CAST(coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (fails AND earlier), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (failed = [letter]), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0) AS BIGINT) AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM report"""

_GRID = ", ".join(f"('{rule}', {step}, {cutoff})" for rule, grid in quality.RULES.items() for step, cutoff in enumerate(grid))
_RULES = len(quality.RULES)


def _sure(risk: float, tests: int) -> str:
    """The test of counts ``n, k, caught`` whose level is its stratum's half of the error over ``tests``."""
    return f"""caught > 0 AND k <= {risk} * n AND list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))))
    <= {quality.ERROR} / (2 * {tests} * (SELECT m FROM present))"""


_COUNTED = """count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND hit) AS k,
         count(*) FILTER (quality = 0 AND hit) AS caught"""
_RATE = "CASE WHEN {1} > 0 THEN 1000 * {0} // {1} ELSE 0 END".format

QUALITY = rf"""{_WORDS}, windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS key
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM (SELECT * FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1), (SELECT unnest(range(8)) AS j)
  GROUP BY doc_id
), measured AS (
  SELECT doc_id, coalesce(lang, '') AS lang, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(words.text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(words.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n, 0) AS n_repeat_words
  FROM words JOIN documents USING (doc_id) LEFT JOIN repeated USING (doc_id)
), counted AS (
  SELECT * EXCLUDE (lines), len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM measured
), rated AS (
  SELECT *, {_RATE("n_symbols", "word_chars")} AS symbol_rate, {_RATE("n_repeat_words", "n_words")} AS repeat_rate,
         {_RATE("n_dup_lines", "n_lines")} AS dup_line_rate, {_RATE("word_chars", "n_words")} AS word_length
  FROM counted
), long AS (
  UNPIVOT (SELECT doc_id, lang, base_failed, symbol_rate, repeat_rate, dup_line_rate, word_length FROM rated)
  ON symbol_rate, repeat_rate, dup_line_rate, word_length INTO NAME rule VALUE rate
), strata AS (
  SELECT DISTINCT lang FROM rated JOIN labels USING (doc_id) WHERE lang <> ''
), passed AS (
  SELECT doc_id, coalesce(s.lang, 'other') AS stratum, quality, rule, rate
  FROM long JOIN labels USING (doc_id) LEFT JOIN strata s ON long.lang = s.lang WHERE NOT base_failed
), present AS (
  SELECT greatest(count(DISTINCT stratum) FILTER (quality = 1), 1) AS m FROM passed
), tried AS (
  SELECT passed.*, step, cutoff, rate > cutoff AS hit FROM passed JOIN (VALUES {_GRID}) t(rule, step, cutoff) USING (rule)
), alone AS (
  SELECT * FROM (SELECT stratum, rule, cutoff, {_COUNTED} FROM tried GROUP BY ALL)
  WHERE {_sure(quality.ALLOWANCE / _RULES, _RULES)}
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught DESC, cutoff DESC) = 1
), together AS (
  SELECT * FROM (SELECT stratum, step, {_COUNTED}
    FROM (SELECT doc_id, stratum, quality, step, bool_or(hit) AS hit FROM tried GROUP BY ALL) GROUP BY ALL)
  WHERE {_sure(quality.ALLOWANCE, 1)}
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY caught DESC, step) = 1
), alone_caught AS (
  SELECT stratum, count(DISTINCT doc_id) AS caught FROM tried SEMI JOIN alone USING (stratum, rule, cutoff)
  WHERE quality = 0 AND hit GROUP BY stratum
), joint AS (
  SELECT stratum, step FROM together t LEFT JOIN alone_caught a USING (stratum) WHERE t.caught > coalesce(a.caught, 0)
), cutoffs AS (
  SELECT stratum, rule, cutoff FROM alone ANTI JOIN joint USING (stratum)
  UNION ALL SELECT DISTINCT stratum, rule, cutoff FROM joint JOIN tried USING (stratum, step)
), hits AS (
  SELECT doc_id, string_agg(rule, ',' ORDER BY list_position({list(quality.RULES)}, rule)) AS rules
  FROM long LEFT JOIN strata s ON long.lang = s.lang
  JOIN cutoffs c USING (rule) WHERE c.stratum = coalesce(s.lang, 'other') AND rate > cutoff GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS rejected_by
FROM rated LEFT JOIN hits USING (doc_id)"""
