"""SQL oracles of the contract queries, over the given tables only."""

from __future__ import annotations

from .contract import DRAWN_TREES, NETWORK, network_weight
from .operators.bootstrap import EXACT_MEAN
from .operators.models import SEED

_COLUMNS = (
    "ts, block, primary_type, description, location_description, arrest, domestic, beat, "
    "district, ward, community_area, year"
)
_READABLE = _COLUMNS.replace("ts,", "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,")

_CLEAN = """
WITH incidents AS (
  SELECT l_orderkey, l_linenumber, l_shipdate AS ts, 'S' || l_suppkey AS block,
         p_type AS primary_type, p_name AS description,
         CASE WHEN p_size <> 50 THEN 'LOC-' || p_size END AS location_description,
         (p_type IN ('PROMO', 'ECONOMY')) <> (l_tax >= 0.08) AS arrest,
         l_linestatus = 'F' AS domestic, CAST(l_suppkey AS INTEGER) AS beat,
         s_nationkey AS district, CAST(l_suppkey % 50 AS INTEGER) AS ward,
         CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS community_area,
         CAST(year(l_shipdate) AS INTEGER) AS year
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
), clean AS (
  SELECT * REPLACE (CAST(arrest AS INTEGER) AS arrest, CAST(domestic AS INTEGER) AS domestic)
  FROM incidents
  WHERE location_description IS NOT NULL AND community_area IS NOT NULL AND ts IS NOT NULL
    AND block IS NOT NULL AND primary_type IS NOT NULL AND description IS NOT NULL
    AND arrest IS NOT NULL AND domestic IS NOT NULL AND beat IS NOT NULL
    AND district IS NOT NULL AND ward IS NOT NULL AND year IS NOT NULL
)"""

_TOP = """, desc_counts AS (
  SELECT description AS value, count(*) AS count FROM clean GROUP BY 1
), loc_counts AS (
  SELECT location_description AS value, count(*) AS count FROM clean GROUP BY 1
), top_desc AS (
  SELECT * FROM (SELECT value, count, CAST(row_number() OVER (ORDER BY count DESC, value)
    AS INTEGER) AS rank FROM desc_counts) WHERE rank <= 32
), top_loc AS (
  SELECT * FROM (SELECT value, count, CAST(row_number() OVER (ORDER BY count DESC, value)
    AS INTEGER) AS rank FROM loc_counts) WHERE rank <= 32
), kept AS (
  SELECT * FROM clean WHERE description IN (SELECT value FROM top_desc)
    AND location_description IN (SELECT value FROM top_loc)
)"""

_CATEGORIES = ("primary_type", "description", "location_description")


def _numbers(column: str, source: str) -> str:
    return (
        f"(SELECT {column}, CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS "
        f"DOUBLE) AS {column}_index FROM {source} GROUP BY {column})"
    )


_INDEXED = f"""{_TOP}, indexed AS (
  SELECT * FROM kept {" ".join(f"JOIN {_numbers(c, 'kept')} USING ({c})" for c in _CATEGORIES)}
)"""

_FEATURES = [f"{c}_index" for c in _CATEGORIES] + ["domestic", "ward", "year"]
_HEX = "CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"
_KEY17 = _HEX.format(key="l_orderkey || ':' || l_linenumber || ':17'")
_KEY5 = _HEX.format(key="l_orderkey || ':' || l_linenumber || ':5'")


def _metrics(by: str = "") -> str:
    """CTEs from ``scored(by, label, prediction)`` to ``metrics``."""
    comma, on = (f"{by}, ", f"AND a.{by} = b.{by}") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    ratio = "CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0 END".format
    f1 = ratio("2.0 * tp", "(n + p)")
    precision, recall = ratio("1.0 * tp", "p"), ratio("1.0 * tp", "n")
    return f""", classes AS (
  SELECT {comma}label AS c FROM scored UNION SELECT {comma}prediction FROM scored
), truths AS (
  SELECT {comma}label AS c, count(*) AS n FROM scored GROUP BY {comma}label
), guesses AS (
  SELECT {comma}prediction AS c, count(*) AS p FROM scored GROUP BY {comma}prediction
), hits AS (
  SELECT {comma}label AS c, count(*) AS tp FROM scored WHERE label = prediction
  GROUP BY {comma}label
), per_class AS (
  SELECT {f"a.{by}, " if by else ""}a.c, coalesce(n, 0) AS n, coalesce(p, 0) AS p,
         coalesce(tp, 0) AS tp
  FROM classes a
  LEFT JOIN truths b ON a.c = b.c {on}
  LEFT JOIN guesses g ON a.c = g.c {on.replace("b.", "g.")}
  LEFT JOIN hits h ON a.c = h.c {on.replace("b.", "h.")}
), metrics AS (
  SELECT {comma}CAST(sum(n) AS BIGINT) AS rows,
         round(sum(tp) / sum(n), 6) AS accuracy,
         round(sum(n * ({f1})) / sum(n), 6) AS f1,
         round(sum(n * ({precision})) / sum(n), 6) AS weighted_precision,
         round(sum(n * ({recall})) / sum(n), 6) AS weighted_recall
  FROM per_class {group}
)"""


_PREDICTED = """, scored AS (
  SELECT district, arrest AS label,
         CASE WHEN primary_type IN ('PROMO', 'ECONOMY') THEN 1 ELSE 0 END AS prediction
  FROM clean
)"""

# The best split of one category by gini gain: order the categories by their rate of
# positives and try every prefix.
_STUMP = """, types AS (
  SELECT primary_type, count(*) AS n, sum(arrest) AS pos FROM clean GROUP BY 1
), prefixes AS (
  SELECT primary_type, row_number() OVER w AS place, count(*) OVER () AS types,
         sum(n) OVER w AS ln, sum(pos) OVER w AS lp, sum(n) OVER () AS n, sum(pos) OVER () AS pos
  FROM types WINDOW w AS (ORDER BY pos * 1.0 / n, primary_type ROWS UNBOUNDED PRECEDING)
), ginis AS (
  SELECT place, ln, lp, n, pos, n - ln AS rn, pos - lp AS rp,
         2.0 * pos / n * (1 - pos * 1.0 / n) AS g,
         2.0 * lp / ln * (1 - lp * 1.0 / ln) AS lg,
         2.0 * (pos - lp) / (n - ln) * (1 - (pos - lp) * 1.0 / (n - ln)) AS rg
  FROM prefixes WHERE place < types
), best AS (
  SELECT *, g - ln * 1.0 / n * lg - rn * 1.0 / n * rg AS gain FROM ginis
  ORDER BY gain DESC LIMIT 1
), left_types AS (
  SELECT primary_type FROM prefixes WHERE place <= (SELECT place FROM best)
), scored AS (
  SELECT arrest AS label,
         CASE WHEN primary_type IN (SELECT primary_type FROM left_types)
              THEN (SELECT CASE WHEN 2 * lp > ln THEN 1 ELSE 0 END FROM best)
              ELSE (SELECT CASE WHEN 2 * rp > rn THEN 1 ELSE 0 END FROM best) END AS prediction
  FROM clean
)"""

# A whole run: the best single split of four features on the training rows, against no
# split at all. Categories go by their rate of positives, the flag by its value.
_ONE_SPLIT = f"""{_TOP}, parts AS (
  SELECT *, CASE WHEN {_KEY17} < 0.6 * 4294967296 THEN 'train'
    WHEN {_KEY17} < 0.8 * 4294967296 THEN 'validation' ELSE 'test' END AS split
  FROM kept
), long AS (
  SELECT 0 AS f, primary_type AS v, arrest FROM parts WHERE split = 'train'
  UNION ALL SELECT 1, description, arrest FROM parts WHERE split = 'train'
  UNION ALL SELECT 2, location_description, arrest FROM parts WHERE split = 'train'
  UNION ALL SELECT 3, CAST(domestic AS VARCHAR), arrest FROM parts WHERE split = 'train'
), vals AS (
  SELECT f, v, count(*) AS vn, sum(arrest) AS vpos FROM long GROUP BY f, v
), prefixes AS (
  SELECT f, v, row_number() OVER w AS place, count(*) OVER (PARTITION BY f) AS places,
         sum(vn) OVER w AS ln, sum(vpos) OVER w AS lp,
         sum(vn) OVER (PARTITION BY f) AS n, sum(vpos) OVER (PARTITION BY f) AS pos
  FROM vals WINDOW w AS (PARTITION BY f ORDER BY
    CASE WHEN f = 3 THEN CAST(v = '1' AS INTEGER) ELSE vpos * 1.0 / vn END, v
    ROWS UNBOUNDED PRECEDING)
), ginis AS (
  SELECT f, place, ln, lp, n, pos, n - ln AS rn, pos - lp AS rp,
         2.0 * pos / n * (1 - pos * 1.0 / n) AS g,
         2.0 * lp / ln * (1 - lp * 1.0 / ln) AS lg,
         2.0 * (pos - lp) / (n - ln) * (1 - (pos - lp) * 1.0 / (n - ln)) AS rg
  FROM prefixes WHERE place < places
), best AS (
  SELECT *, g - ln * 1.0 / n * lg - rn * 1.0 / n * rg AS gain FROM ginis
  ORDER BY gain DESC, f LIMIT 1
), left_values AS (
  SELECT v FROM prefixes WHERE f = (SELECT f FROM best) AND place <= (SELECT place FROM best)
), guesses_of AS (
  SELECT split, arrest, (SELECT CAST(2 * pos > n AS INTEGER) FROM best) AS whole,
         CASE (SELECT f FROM best) WHEN 0 THEN primary_type WHEN 1 THEN description
           WHEN 2 THEN location_description ELSE CAST(domestic AS VARCHAR) END
           IN (SELECT v FROM left_values) AS goes_left,
         (SELECT CAST(2 * lp > ln AS INTEGER) FROM best) AS l,
         (SELECT CAST(2 * rp > rn AS INTEGER) FROM best) AS r
  FROM parts
), scored AS (
  SELECT '0' || split AS point, arrest AS label, whole AS prediction FROM guesses_of
  UNION ALL
  SELECT '1' || split, arrest, CASE WHEN goes_left THEN l ELSE r END FROM guesses_of
){_metrics("point")}, results AS (
  SELECT CAST(t.i AS INTEGER) AS grid_index, CAST(t.i AS INTEGER) AS max_depth,
         1 AS min_instances_per_node, t.f1 AS training_f1, v.f1 AS validation_f1,
         row_number() OVER (ORDER BY v.f1 DESC, t.i) = 1 AS is_best
  FROM (SELECT left(point, 1) AS i, f1 FROM metrics WHERE point LIKE '%train') t
  JOIN (SELECT left(point, 1) AS i, f1 FROM metrics WHERE point LIKE '%validation') v
    ON t.i = v.i
)"""

# The same with folds: runs 0-2 leave out one fold of the training rows and are scored on
# it, run 3 takes all training rows.
_FOLDS = f"""{_TOP}, parts AS (
  SELECT *, {_KEY17} % 3 AS fold, CASE WHEN {_KEY17} < 0.6 * 4294967296 THEN 'train'
    WHEN {_KEY17} < 0.8 * 4294967296 THEN 'validation' ELSE 'test' END AS split
  FROM kept
), runs AS (
  SELECT * FROM (VALUES (0), (1), (2), (3)) AS t(run)
), used AS (
  SELECT run, primary_type, description, location_description, domestic, arrest
  FROM parts JOIN runs ON fold <> run WHERE split = 'train'
), long AS (
  SELECT run, 0 AS f, primary_type AS v, arrest FROM used
  UNION ALL SELECT run, 1, description, arrest FROM used
  UNION ALL SELECT run, 2, location_description, arrest FROM used
  UNION ALL SELECT run, 3, CAST(domestic AS VARCHAR), arrest FROM used
), vals AS (
  SELECT run, f, v, count(*) AS vn, sum(arrest) AS vpos FROM long GROUP BY run, f, v
), prefixes AS (
  SELECT run, f, v, row_number() OVER w AS place, count(*) OVER (PARTITION BY run, f) AS places,
         sum(vn) OVER w AS ln, sum(vpos) OVER w AS lp,
         sum(vn) OVER (PARTITION BY run, f) AS n, sum(vpos) OVER (PARTITION BY run, f) AS pos
  FROM vals WINDOW w AS (PARTITION BY run, f ORDER BY
    CASE WHEN f = 3 THEN CAST(v = '1' AS INTEGER) ELSE vpos * 1.0 / vn END, v
    ROWS UNBOUNDED PRECEDING)
), gains AS (
  SELECT *, 2.0 * pos / n * (1 - pos * 1.0 / n)
    - 2.0 * lp / n * (1 - lp * 1.0 / ln)
    - 2.0 * (pos - lp) / n * (1 - (pos - lp) * 1.0 / (n - ln)) AS gain
  FROM prefixes WHERE place < places
), best AS (
  SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY run ORDER BY gain DESC, f) = 1
), left_values AS (
  SELECT run, v FROM prefixes p SEMI JOIN best b
    ON p.run = b.run AND p.f = b.f AND p.place <= b.place
), targets AS (
  SELECT run, CASE WHEN run < 3 THEN 'fold' || run ELSE split END AS target, arrest,
         CAST(2 * pos > n AS INTEGER) AS whole, CAST(2 * lp > ln AS INTEGER) AS l,
         CAST(2 * (pos - lp) > n - ln AS INTEGER) AS r,
         CASE f WHEN 0 THEN primary_type WHEN 1 THEN description
           WHEN 2 THEN location_description ELSE CAST(domestic AS VARCHAR) END AS v
  FROM parts JOIN best
    ON (run < 3 AND split = 'train' AND fold = run) OR (run = 3 AND split <> 'train')
), marked AS (
  SELECT t.*, k.v IS NOT NULL AS goes_left FROM targets t
  LEFT JOIN left_values k ON t.run = k.run AND t.v = k.v
), scored AS (
  SELECT '0' || target AS point, arrest AS label, whole AS prediction FROM marked
  UNION ALL
  SELECT '1' || target, arrest, CASE WHEN goes_left THEN l ELSE r END FROM marked
), accuracies AS (
  SELECT left(point, 1) AS i, point, avg(CAST(label = prediction AS INTEGER)) AS accuracy
  FROM scored GROUP BY ALL
), results AS (
  SELECT CAST(i AS INTEGER) AS grid_index, 1 AS num_trees, CAST(i AS INTEGER) AS max_depth,
         32 AS max_bins, round(avg(accuracy), 6) AS avg_accuracy,
         round(stddev_pop(accuracy), 6) AS std_accuracy,
         row_number() OVER (ORDER BY avg(accuracy) DESC, i) = 1 AS is_best
  FROM accuracies WHERE point LIKE '%fold%' GROUP BY i
){_metrics("point")}"""

_MODEL_COLUMNS = (
    "primary_type, description, location_description, arrest, domestic, ward, year"
)
_MODEL_FLAGS = _MODEL_COLUMNS.replace("arrest", "CAST(arrest AS BOOLEAN) AS arrest").replace(
    "domestic", "CAST(domestic AS BOOLEAN) AS domestic"
)
_KEYS = "l_orderkey, l_linenumber"
_METRIC_COLUMNS = "rows, accuracy, f1, weighted_precision, weighted_recall"
_DATED = """
WITH dated AS (
  SELECT year(l_shipdate) AS y, l_returnflag AS kind FROM lineitem
  UNION ALL SELECT year(o_orderdate), o_orderstatus FROM orders
  UNION ALL SELECT year(ts), event_type FROM events
)"""


def _scaled(column: str, source: str) -> str:
    return (
        f"round(({column} - (SELECT avg({column}) FROM {source})) / "
        f"(SELECT stddev_samp({column}) FROM {source}), 6) + 0.0 AS {column}"
    )


def _distinct(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM {source}"
        for c in columns
    )


ORACLES: dict[str, str] = {
    "csv_roundtrip": f"{_CLEAN} SELECT {_READABLE} FROM incidents",
    "union_years": f"{_DATED} SELECT CAST(y AS INTEGER) AS year, kind, count(*) AS rows "
    "FROM dated GROUP BY y, kind",
    "union_years_by_position": f"{_DATED} SELECT CAST(y AS INTEGER) AS year, count(*) AS rows "
    "FROM dated GROUP BY y",
    "preview_rows": f"{_CLEAN} SELECT {_KEYS}, {_READABLE} FROM (SELECT * FROM incidents "
    "ORDER BY "
    + ", ".join(f"{c} NULLS LAST" for c in f"{_KEYS}, {_COLUMNS}".split(", "))
    + " LIMIT 10)",
    "project_columns": f"{_CLEAN} SELECT {_READABLE} FROM incidents",
    "project_clean": f"{_CLEAN} SELECT {_MODEL_COLUMNS} FROM clean",
    "flag_to_int": f"""{_CLEAN} SELECT {_KEYS}, CAST(arrest AS INTEGER) AS arrest,
  CAST(domestic AS INTEGER) AS domestic,
  CASE WHEN community_area IS NOT NULL AND arrest AND ward % 7 <> 0 THEN 1 ELSE 0 END AS text_flag
FROM incidents""",
    "row_counts": f"{_CLEAN} SELECT 'all' AS stage, count(*) AS rows FROM incidents "
    "UNION ALL SELECT 'clean', count(*) FROM clean",
    "row_counts_not_a_number": "SELECT 'all' AS stage, count(*) AS rows FROM events UNION ALL "
    "SELECT s, count(*) FILTER (value >= 20) FROM events, (VALUES ('present'), ('kept')) t(s) GROUP BY s",
    "value_counts_primary_type": f"{_CLEAN} SELECT primary_type AS value, count(*) AS count "
    "FROM clean GROUP BY 1",
    "value_counts_location": f"{_CLEAN} SELECT location_description AS value, count(*) AS count "
    "FROM incidents GROUP BY 1",
    "value_counts_customers": "SELECT o_custkey AS value, count(*) AS count FROM orders GROUP BY 1",
    "value_counts_events": "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1",
    "distinct_counts": f"{_CLEAN} {_distinct([*_CATEGORIES, 'ward', 'year'], 'clean')}",
    "distinct_counts_orders": _distinct(
        ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"], "orders"
    ),
    "tally_model_columns": f"{_CLEAN} SELECT {_MODEL_FLAGS}, count(*) AS rows FROM clean "
    "GROUP BY ALL",
    "top_k_descriptions": f"{_CLEAN}{_TOP} SELECT value, count, rank FROM top_desc",
    "top_k_two_columns": f"{_CLEAN}{_TOP} SELECT 'description' AS \"column\", * FROM top_desc "
    "UNION ALL SELECT 'location_description', * FROM top_loc",
    "keep_top_k": f"{_CLEAN}{_TOP} SELECT {_KEYS}, {_MODEL_FLAGS} FROM kept",
    "keep_top_k_join": f"{_CLEAN}{_TOP} SELECT {_KEYS}, {_MODEL_FLAGS} FROM kept",
    "bucket_other": f"""{_CLEAN}, counts AS (
  SELECT location_description AS value, count(*) AS count FROM incidents GROUP BY 1
), top AS (SELECT value FROM counts ORDER BY count DESC, value NULLS LAST LIMIT 32)
SELECT {_KEYS}, CASE WHEN location_description IN (SELECT value FROM top WHERE value IS NOT NULL)
  THEN location_description ELSE 'Other' END AS location_description FROM incidents""",
    "bucket_other_join": f"""{_CLEAN}{_TOP} SELECT {_KEYS}, CASE WHEN description IN (SELECT value
  FROM top_desc) THEN description ELSE 'Other' END AS description FROM clean""",
    "index_categories": f"{_CLEAN}{_INDEXED} SELECT {_KEYS}, {', '.join(_FEATURES[:3])} "
    "FROM indexed",
    "index_documents": "SELECT doc_id, lang_index, source_index FROM documents JOIN "
    f"{_numbers('lang', 'documents')} USING (lang) JOIN {_numbers('source', 'documents')} "
    "USING (source)",
    "index_customers": """WITH counts AS (
  SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS count FROM orders GROUP BY 1
), numbered AS (
  SELECT value, CAST(row_number() OVER (ORDER BY count DESC, value) - 1 AS DOUBLE) AS i FROM counts
) SELECT o_orderkey, o_custkey, i AS o_custkey_index
FROM orders JOIN numbered ON CAST(o_custkey AS VARCHAR) = value""",
    "assemble_features": f"{_CLEAN}{_INDEXED} SELECT {_KEYS}, arrest, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FEATURES)
    + " FROM indexed",
    "standardize_features": f"{_CLEAN}{_INDEXED} SELECT {_KEYS}, "
    + ", ".join(_scaled(c, "indexed") for c in _FEATURES)
    + " FROM indexed",
    "standardize_events": f"SELECT event_id, {_scaled('value', 'events')} FROM events",
    "hash_split_counts": f"""{_CLEAN} SELECT CASE WHEN {_KEY17} < 0.6 * 4294967296 THEN 'train'
  WHEN {_KEY17} < 0.8 * 4294967296 THEN 'validation' ELSE 'test' END AS split, count(*) AS rows
FROM incidents GROUP BY 1""",
    "hash_split_rows": f"""SELECT {_KEYS}, CASE WHEN {_KEY5} < 1073741824 THEN 'a'
  WHEN {_KEY5} < 2147483648 THEN 'b' ELSE 'c' END AS split FROM lineitem""",
    "fold_counts": f"{_CLEAN} SELECT CAST({_KEY17} % 3 AS INTEGER) AS fold, count(*) AS rows "
    "FROM incidents GROUP BY 1",
    "confusion_matrix": f"{_CLEAN}{_PREDICTED} SELECT label, prediction, count(*) AS rows "
    "FROM scored GROUP BY 1, 2",
    "confusion_labels": "SELECT quality AS label, toxic AS prediction, count(*) AS rows "
    "FROM labels GROUP BY 1, 2",
    "classification_metrics": f"{_CLEAN}{_PREDICTED}{_metrics()} "
    f"SELECT {_METRIC_COLUMNS} FROM metrics",
    "classification_metrics_by_district": f"{_CLEAN}{_PREDICTED}{_metrics('district')} "
    f"SELECT district, {_METRIC_COLUMNS} FROM metrics",
    "classification_metrics_many_classes": f"""WITH scored AS (
  SELECT l_linenumber AS label,
         CASE WHEN l_quantity > 40 THEN l_linenumber ELSE l_suppkey % 4 END AS prediction
  FROM lineitem
){_metrics()} SELECT {_METRIC_COLUMNS} FROM metrics""",
    "select_best": f"""{_CLEAN}, scored AS (
  SELECT 0 AS grid_index, arrest AS label, CASE WHEN ward < 25 THEN 1 ELSE 0 END AS prediction
  FROM clean
  UNION ALL
  SELECT 1, arrest, CASE WHEN primary_type IN ('PROMO', 'ECONOMY') THEN 1 ELSE 0 END FROM clean
  UNION ALL
  SELECT 2, arrest, domestic FROM clean
){_metrics("grid_index")} SELECT grid_index, {_METRIC_COLUMNS},
  row_number() OVER (ORDER BY f1 DESC, grid_index) = 1 AS is_best FROM metrics""",
    "random_split_rows": f"SELECT {_KEYS}, l_partkey FROM lineitem",
    "tree_flow_results": f"{_CLEAN}{_ONE_SPLIT} SELECT * FROM results",
    "tree_flow_report": f"""{_CLEAN}{_ONE_SPLIT} SELECT {_METRIC_COLUMNS} FROM metrics
WHERE point = (SELECT grid_index || 'test' FROM results WHERE is_best)""",
    "tree_flow_nodes": f"""{_CLEAN}{_ONE_SPLIT}
SELECT 0 AS node_id, 1 AS left_child, 2 AS right_child,
  CASE WHEN 2 * pos > n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction,
  round(g, 6) AS impurity, round(gain, 6) AS gain, CAST(n AS BIGINT) AS rows,
  ['primary_type_index', 'description_index', 'location_description_index', 'domestic'][f + 1]
    AS feature,
  CASE WHEN f < 3 THEN (SELECT string_agg(v, ',' ORDER BY v) FROM left_values) END
    AS left_categories
FROM best
UNION ALL SELECT 1, NULL, NULL, CASE WHEN 2 * lp > ln THEN 1.0 ELSE 0.0 END, round(lg, 6), NULL,
  CAST(ln AS BIGINT), NULL, NULL FROM best
UNION ALL SELECT 2, NULL, NULL, CASE WHEN 2 * rp > rn THEN 1.0 ELSE 0.0 END, round(rg, 6), NULL,
  CAST(rn AS BIGINT), NULL, NULL FROM best""",
    "stump_nodes": f"""{_CLEAN}{_STUMP}
SELECT 0 AS node_id, 1 AS left_child, 2 AS right_child,
  CASE WHEN 2 * pos > n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction,
  round(g, 6) AS impurity, round(gain, 6) AS gain, CAST(n AS BIGINT) AS rows,
  'primary_type_index' AS feature,
  (SELECT string_agg(primary_type, ',' ORDER BY primary_type) FROM left_types) AS left_categories
FROM best
UNION ALL SELECT 1, NULL, NULL, CASE WHEN 2 * lp > ln THEN 1.0 ELSE 0.0 END, round(lg, 6), NULL,
  CAST(ln AS BIGINT), NULL, NULL FROM best
UNION ALL SELECT 2, NULL, NULL, CASE WHEN 2 * rp > rn THEN 1.0 ELSE 0.0 END, round(rg, 6), NULL,
  CAST(rn AS BIGINT), NULL, NULL FROM best""",
    "stump_scored_counts": f"{_CLEAN}{_STUMP} SELECT label, prediction, count(*) AS rows "
    "FROM scored GROUP BY 1, 2",
    "stump_metrics": f"{_CLEAN}{_STUMP}{_metrics()} SELECT {_METRIC_COLUMNS} FROM metrics",
}

_BEST_POINT = "(SELECT grid_index || '{}' FROM results WHERE is_best)"
ORACLES |= {
    "forest_flow_results": f"{_CLEAN}{_FOLDS} SELECT * FROM results",
    "forest_flow_summary": f"""{_CLEAN}{_FOLDS}
SELECT num_trees, max_depth, max_bins, accuracy AS validation_accuracy
FROM results JOIN metrics ON point = grid_index || 'validation' WHERE is_best""",
    "forest_flow_report": f"{_CLEAN}{_FOLDS} SELECT {_METRIC_COLUMNS} FROM metrics "
    f"WHERE point = {_BEST_POINT.format('test')}",
    "forest_flow_importances": f"""{_CLEAN}{_FOLDS}
SELECT CAST(row_number() OVER (ORDER BY importance DESC, i) AS INTEGER) AS rank, feature, importance
FROM (SELECT i, feature, CASE WHEN i = (SELECT f FROM best WHERE run = 3)
        AND (SELECT max_depth FROM results WHERE is_best) = 1 THEN 1.0::DOUBLE ELSE 0.0 END
        AS importance
      FROM (VALUES (0, 'primary_type_index'), (1, 'description_index'),
        (2, 'location_description_index'), (3, 'domestic')) AS t(i, feature))""",
}
ORACLES |= {
    "tree_flow_large_k": ORACLES["tree_flow_results"].replace("rank <= 32", "rank <= 600"),
    "keep_top_k_large": """WITH parts AS (
  SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, CAST(l_partkey AS VARCHAR)
  LIMIT 600
), chosen AS (SELECT * FROM lineitem SEMI JOIN parts USING (l_partkey)), suppliers AS (
  SELECT l_suppkey FROM chosen GROUP BY 1 ORDER BY count(*) DESC, CAST(l_suppkey AS VARCHAR) LIMIT 60
) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM chosen SEMI JOIN suppliers USING (l_suppkey)""",
    "forest_scored_counts": f"{_CLEAN}{_STUMP} SELECT forest, label, prediction, count(*) AS rows "
    "FROM scored, (VALUES ('plain'), ('bootstrap')) t(forest) GROUP BY 1, 2, 3",
    "perceptron_rates": f"""{_CLEAN} SELECT CAST(primary_type IN ('PROMO', 'ECONOMY') AS INTEGER)
  AS promoted, count(*) AS rows, CAST(avg(arrest) > 0.5 AS INTEGER) AS prediction, true AS is_rate
FROM clean GROUP BY 1""",
}
ORACLES["estimator_chain_metrics"] = ORACLES["stump_metrics"]
ORACLES["results_roundtrip"] = ORACLES["select_best"]


# Trees of two levels: the best gini split of every node among prefixes of the categories in
# order of their rate, the flag, and the thresholds of a number between any two of its values.


def _best_splits(rows: str, level: int) -> str:
    return f"""types{level} AS (
  SELECT node, primary_type, count(*) AS n, sum(y) AS pos, row_number() OVER (
    PARTITION BY node ORDER BY sum(y) * 1.0 / count(*)) AS place FROM {rows} GROUP BY 1, 2
), cuts{level} AS (
  SELECT node, 0 AS f, CAST(place AS DOUBLE) AS t, sum(n) OVER w AS ln, sum(pos) OVER w AS lp
  FROM types{level} WINDOW w AS (PARTITION BY node ORDER BY place)
  UNION ALL SELECT node, 1, 0.5, count(*), sum(y) FROM {rows} WHERE domestic = 0 GROUP BY node
  UNION ALL SELECT node, 2, t, count(*), sum(y) FROM {rows}, thresholds WHERE ward <= t GROUP BY node, t
), gains{level} AS (
  SELECT *, n - ln AS rn, pos - lp AS rp, {_gini("pos", "n")} AS g FROM cuts{level}
  JOIN (SELECT node, count(*) AS n, sum(y) AS pos FROM {rows} GROUP BY node) USING (node) WHERE ln < n
), best{level} AS (
  SELECT *, g - ln / n * {_gini("lp", "ln")} - rn / n * {_gini("rp", "rn")} AS gain FROM gains{level}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, f, t) = 1
)"""


def _gini(pos: str, n: str) -> str:
    return f"(2.0::DOUBLE * {pos} / {n} * (1 - {pos} * 1.0::DOUBLE / {n}))"


def _below(level: int, rows: str) -> str:
    left = f"""CASE f WHEN 0 THEN place <= t WHEN 1 THEN domestic = 0 ELSE ward <= t END"""
    return f"""SELECT node * 2 + CASE WHEN {left} THEN 1 ELSE 2 END AS node, primary_type, domestic, ward, y
  FROM (SELECT r.*, f, t, place FROM {rows} r JOIN best{level} USING (node) JOIN types{level} USING (node, primary_type))"""


_TWO_LEVELS = f""", lab AS (
  SELECT 0 AS node, primary_type, domestic, ward,
    CAST((CASE WHEN domestic = 1 THEN ward < 42 ELSE primary_type IN ('PROMO', 'ECONOMY') END)
      <> (community_area = 3) AS INTEGER) AS y FROM clean
), thresholds AS (
  SELECT (ward + lead(ward) OVER (ORDER BY ward)) / 2.0 AS t FROM (SELECT DISTINCT ward FROM lab)
), {_best_splits("lab", 0)}, one AS (
  {_below(0, "lab")}
), {_best_splits("one", 1)}, two AS (
  {_below(1, "one")}
), best AS (SELECT * FROM best0 UNION ALL SELECT * FROM best1
), types AS (SELECT * FROM types0 UNION ALL SELECT * FROM types1
), leaves AS (
  SELECT node, count(*) AS n, sum(y) AS pos FROM two GROUP BY node
)"""

_TWO_NAMES = "['primary_type_index', 'domestic', 'ward'][f + 1]"
ORACLES |= {
    "two_level_nodes": f"""{_CLEAN}{_TWO_LEVELS}, placed(node, node_id, left_child, right_child) AS (
  VALUES (0, 0, 1, 4), (1, 1, 2, 3), (3, 2, NULL, NULL), (4, 3, NULL, NULL), (2, 4, 5, 6), (5, 5, NULL, NULL), (6, 6, NULL, NULL)
)
SELECT node_id, left_child, right_child, CASE WHEN 2 * pos > n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction,
  round({_gini("pos", "n")}, 6) AS impurity, round(gain, 6) AS gain, CAST(n AS BIGINT) AS rows, feature,
  CASE WHEN feature <> 'primary_type_index' THEN t END AS threshold, left_categories
FROM (SELECT node, n, pos, gain, {_TWO_NAMES} AS feature, t, (SELECT string_agg(primary_type, ',' ORDER BY primary_type)
        FROM types WHERE types.node = best.node AND f = 0 AND place <= t) AS left_categories FROM best
      UNION ALL SELECT node, n, pos, NULL, NULL, NULL, NULL FROM leaves) JOIN placed USING (node)""",
    "two_level_importances": f"""{_CLEAN}{_TWO_LEVELS}, summed AS (
  SELECT i, name, coalesce(sum(gain * n), 0) AS s
  FROM (VALUES (0, 'primary_type_index'), (1, 'domestic'), (2, 'ward')) v(i, name) LEFT JOIN best ON f = i GROUP BY 1, 2
)
SELECT CAST(row_number() OVER (ORDER BY s DESC, i) AS INTEGER) AS rank, name AS feature,
  round(s / (SELECT sum(s) FROM summed), 6) AS importance FROM summed""",
    "two_level_cut_counts": f"""{_CLEAN}{_TWO_LEVELS}, cut AS (
  SELECT 0 AS max_depth, node, y FROM lab UNION ALL SELECT 1, node, y FROM one UNION ALL SELECT 2, node, y FROM two
)
SELECT max_depth, y AS label, CAST(2 * pos > n AS INTEGER) AS prediction, count(*) AS rows
FROM cut JOIN (SELECT max_depth, node, count(*) AS n, sum(y) AS pos FROM cut GROUP BY 1, 2) USING (max_depth, node)
GROUP BY ALL""",
}


def _unit(layer: int, j: int, inputs: list[str]) -> str:
    terms = [f"{network_weight(layer, i, j)} * {x}" for i, x in enumerate(inputs)]
    return f"({network_weight(layer, -1, j)} + {' + '.join(terms)})"


_HIDDEN = ", ".join(f"1 / (1 + exp(-{_unit(1, j, ['x0', 'x1', 'x2'])})) AS h{j}" for j in range(NETWORK[1]))
_OUT = ", ".join(f"{_unit(2, j, [f'h{i}' for i in range(NETWORK[1])])} AS z{j}" for j in range(NETWORK[2]))
ORACLES |= {
    "perceptron_forward": f"""{_CLEAN}, inputs AS (
  SELECT {_KEYS}, CAST(domestic AS INTEGER)::DOUBLE AS x0, ward / 50.0::DOUBLE AS x1, (year - 1995) / 5.0::DOUBLE AS x2
  FROM incidents
), hidden AS (SELECT {_KEYS}, {_HIDDEN} FROM inputs
), outputs AS (SELECT {_KEYS}, {_OUT} FROM hidden)
SELECT {_KEYS}, round(1 / (1 + exp(z0 - z1)), 6) AS p1, CASE WHEN z1 > z0 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction
FROM outputs""",
    "rejected_cell_counts": f"""{_CLEAN}, cells AS (
  SELECT year AS file_year, 'ts' AS "column", strftime(ts, '%Y-%m-%d') AS text FROM incidents WHERE ward = 3
  UNION ALL SELECT year, 'arrest', 'yes, sure' FROM incidents WHERE ward = 5
  UNION ALL SELECT year, 'ward', 'W' || ward FROM incidents WHERE community_area = 2
  UNION ALL SELECT year, 'beat', '1,"2"' FROM incidents WHERE ward = 7
)
SELECT *, count(*) AS cells FROM cells GROUP BY ALL""",
    "rows_lost_to_rejects": f"""{_CLEAN}
SELECT 'all' AS stage, count(*) AS rows FROM incidents
UNION ALL SELECT 'clean', count(*) FROM clean WHERE ward NOT IN (3, 5, 7) AND community_area <> 2""",
    "yearly_state_sources": f"{_CLEAN} SELECT CAST(year AS VARCHAR) AS source, count(*) AS rows FROM incidents GROUP BY 1",
    "yearly_state_counts": f"""{_CLEAN}
SELECT 'description' AS "column", description AS value, count(*) AS count FROM incidents GROUP BY ALL
UNION ALL SELECT 'location_description', location_description, count(*) FROM incidents GROUP BY ALL""",
    "yearly_state_top_k": f"""{_CLEAN}
SELECT 'description' AS "column", description AS value, count(*) AS count,
  CAST(row_number() OVER (ORDER BY count(*) DESC, description) AS INTEGER) AS rank
FROM incidents GROUP BY description QUALIFY rank <= 32""",
    "yearly_state_distincts": f"""{_CLEAN}
SELECT 'description' AS "column", count(DISTINCT description) AS "true", true AS is_exact, true AS is_within FROM incidents
UNION ALL SELECT 'location_description', count(DISTINCT location_description), true, true FROM incidents
UNION ALL SELECT 'block', count(DISTINCT block), false, true FROM incidents""",
}


def _drawn(columns: str, trees: int) -> str:
    """CTEs up to ``drawn``: the tally of ``columns`` with the draw of each tree."""
    key = " || ':' || ".join(columns.split(", "))
    part = "(CAST('0x' || substr(digest, {}, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496".format
    return f""", counted AS (
  SELECT {columns}, count(*) AS rows FROM clean GROUP BY ALL
), terms AS (
  SELECT m, k, exp(k * ln(m) - m - lgamma(k + 1)) AS p
  FROM (SELECT unnest(range(1, {EXACT_MEAN + 1})) AS m), (SELECT unnest(range(0, 150)) AS k)
), sums AS (
  SELECT m, list(s ORDER BY k) AS upto FROM (SELECT m, k, sum(p) OVER (PARTITION BY m ORDER BY k) AS s FROM terms) GROUP BY m
), digests AS (
  SELECT *, md5({key} || ':' || tree || ':{SEED}') AS digest
  FROM counted, (SELECT CAST(unnest(range({trees})) AS INTEGER) AS tree) t
), uniforms AS (
  SELECT * EXCLUDE (digest), {part(1)} AS u, sqrt(-2 * ln({part(1)})) * cos(2 * pi() * {part(14)}) AS z FROM digests
), drawn AS (
  SELECT {columns}, rows, tree, CASE WHEN upto IS NOT NULL THEN len(list_filter(upto, lambda c: c <= u))
    ELSE greatest(CAST(floor(rows + z * sqrt(rows) + (z * z - 1) / 6 + 0.5) AS BIGINT), 0) END AS weight
  FROM uniforms LEFT JOIN sums ON m = rows
)"""


ORACLES |= {
    "bootstrap_weights": f"""{_CLEAN}{_drawn("primary_type, domestic, ward, year, arrest", 3)}
SELECT * FROM drawn""",
    "bootstrap_forest_votes": f"""{_CLEAN}{_drawn("primary_type, arrest", DRAWN_TREES)}, types AS (
  SELECT tree, primary_type, sum(weight)::DOUBLE AS n, sum(weight * arrest)::DOUBLE AS pos FROM drawn GROUP BY ALL
), prefixes AS (
  SELECT tree, primary_type, row_number() OVER w AS place, sum(n) OVER w AS ln, sum(pos) OVER w AS lp,
         sum(n) OVER (PARTITION BY tree) AS n, sum(pos) OVER (PARTITION BY tree) AS pos
  FROM types WINDOW w AS (PARTITION BY tree ORDER BY pos / n, primary_type ROWS UNBOUNDED PRECEDING)
), best AS (
  SELECT tree, place AS cut, lp / ln AS left_p, (pos - lp) / (n - ln) AS right_p FROM prefixes WHERE ln < n
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY
    ln / n * {_gini("lp", "ln")} + (n - ln) / n * {_gini("(pos - lp)", "(n - ln)")}, place) = 1
), votes AS (
  SELECT primary_type, CASE WHEN place <= cut THEN left_p ELSE right_p END AS p FROM prefixes JOIN best USING (tree)
)
SELECT primary_type, CAST((SELECT sum(rows) FROM counted c WHERE c.primary_type = votes.primary_type) AS BIGINT) AS rows,
  round(avg(p), 6) AS p1, CASE WHEN avg(p) > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction,
  CAST(count(*) FILTER (p > 0.5) AS INTEGER) AS trees_for_1
FROM votes GROUP BY primary_type""",
}
