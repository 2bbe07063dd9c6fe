"""The contract queries: every operator over the whole of the given tables.

Each takes ``(spark, sf_dir)``. The tree and forest searches run the published grids of
``tabular_insights.plans.flows``; the perceptron search runs two of its forty points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import operators as ops
from .functions import all_present
from .plans import IncidentSpec, forest_flow, mlp_flow, tree_flow
from .plans.flows import FOREST_GRID, TREE_GRID
from .session import new_path, stage
from .sources import INCIDENT_FIELDS, INCIDENT_TIME, read_incidents, rejected_cells, write_results
from .sources import union_years as union_frames
from .sources.adapter import INCIDENT_COLUMNS, KEY_COLUMNS, incidents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

REDUCED = ["description", "location_description"]
CATEGORIES = ["primary_type", *REDUCED]
MODEL_COLUMNS = [*CATEGORIES, "arrest", "domestic", "ward", "year"]
FEATURES = [f"{c}_index" for c in CATEGORIES] + ["domestic", "ward", "year"]
TREE_SPEC = IncidentSpec(keys=KEY_COLUMNS)
FOREST_SPEC = IncidentSpec(keys=KEY_COLUMNS, numbers=())
#: A small perceptron, and one of the forty published points.
MLP_POINTS = ops.param_grid(block_size=[128], layers=[[6, 8, 2], [6, 8, 8, 10]])
#: Single rows that one training task reads in every pass; a row is about 90 bytes in its block.
PART_ROWS = 1_000_000


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.drop_null_rows(incidents(spark, sf_dir), INCIDENT_COLUMNS)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows with integer flags and frequent categories: the input of every model.

    Staged before the dictionaries are counted, so the tables are read and joined once.
    """
    flags = ops.flag_to_int(clean(spark, sf_dir), ["arrest", "domestic"])
    rows = stage(flags.select(*KEY_COLUMNS, *MODEL_COLUMNS), "clean")
    return ops.keep_top_k(rows, REDUCED)


def readable(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def rule(test: Column) -> Column:
    return test.cast("double")


# Sources and sinks


@query
def csv_roundtrip(spark, sf_dir):
    """One CSV folder per year, written and read back."""
    names = {name: header for header, (name, _) in INCIDENT_FIELDS.items()}
    rows = ops.project(incidents(spark, sf_dir), list(names), names)
    path = new_path(spark, "incidents-csv")
    rows = rows.withColumn("file_year", F.col("Year"))
    write_results(rows, path, partition_by=["file_year"], timestamp_format=INCIDENT_TIME)
    return readable(read_incidents(spark, f"{path}/file_year=*"))


def spoiled_files(spark, sf_dir) -> str:
    """One CSV folder per year with cells that do not fit their types."""
    names = {name: header for header, (name, _) in INCIDENT_FIELDS.items()}
    rows = ops.project(incidents(spark, sf_dir), list(names), names).withColumn("file_year", F.col("Year"))
    line, ward = F.col("`Community Area`"), F.col("Ward")
    written = {
        "Date": F.when(ward == 3, F.date_format("Date", "yyyy-MM-dd")).otherwise(F.date_format("Date", INCIDENT_TIME)),
        "Arrest": F.when(ward == 5, F.lit("yes, sure")).otherwise(F.col("Arrest").cast("string")),
        "Ward": F.when(line == 2, F.concat(F.lit("W"), ward)).otherwise(ward.cast("string")),
        "Beat": F.when(ward == 7, F.lit('1,"2"')).otherwise(F.col("Beat").cast("string")),
    }
    path = new_path(spark, "spoiled-csv")
    write_results(rows.withColumns(written), path, partition_by=["file_year"])
    return f"{path}/file_year=*"


@query
def rejected_cell_counts(spark, sf_dir):
    """Cells that do not fit, by file, column and text."""
    cells = rejected_cells(spark, spoiled_files(spark, sf_dir))
    year = F.regexp_extract("file", "file_year=(\\d+)", 1).cast("int")
    return cells.groupBy(year.alias("file_year"), "column", "text").agg(F.count(F.lit(1)).alias("cells"))


@query
def rows_lost_to_rejects(spark, sf_dir):
    """Rows read from the same files, and those that are left when rows with nulls are dropped."""
    rows = read_incidents(spark, spoiled_files(spark, sf_dir))
    kept_rows = {"all": None, "clean": all_present(INCIDENT_COLUMNS, rows.schema)}
    return ops.row_counts(rows, kept_rows)


def dated_tables(spark, sf_dir):
    """Three dated tables with the same columns, in different order."""
    item, orders, events = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "events"))
    return [
        item.select(F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("kind")),
        orders.select(F.col("o_orderstatus").alias("kind"), F.year("o_orderdate").alias("year")),
        events.select(F.col("event_type").alias("kind"), F.year("ts").alias("year")),
    ]


@query
def union_years(spark, sf_dir):
    rows = union_frames(dated_tables(spark, sf_dir))
    return rows.groupBy("year", "kind").agg(F.count(F.lit(1)).alias("rows"))


@query
def union_years_by_position(spark, sf_dir):
    frames = [df.select("year", "kind") for df in dated_tables(spark, sf_dir)]
    rows = union_frames(frames, by="position")
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("rows"))


@query
def preview_rows(spark, sf_dir):
    rows = incidents(spark, sf_dir)
    return readable(ops.preview(rows, 10, [*KEY_COLUMNS, *INCIDENT_COLUMNS]))


# Projection and cleaning


@query
def project_columns(spark, sf_dir):
    return readable(ops.project(incidents(spark, sf_dir), INCIDENT_COLUMNS))


@query
def project_clean(spark, sf_dir):
    rows = ops.project(clean(spark, sf_dir), MODEL_COLUMNS)
    return ops.flag_to_int(rows, ["arrest", "domestic"])


@query
def flag_to_int(spark, sf_dir):
    """A boolean flag, and a text flag that is sometimes upper case and sometimes null."""
    rows = incidents(spark, sf_dir)
    text = F.col("arrest").cast("string")
    text = F.when(F.col("ward") % 7 == 0, F.upper(text)).otherwise(text)
    rows = rows.withColumn("text_flag", F.when(F.col("community_area").isNotNull(), text))
    rows = rows.select(*KEY_COLUMNS, "arrest", "domestic", "text_flag")
    return ops.flag_to_int(rows, ["arrest", "domestic", "text_flag"])


# Profile


@query
def row_counts(spark, sf_dir):
    rows = incidents(spark, sf_dir)
    return ops.row_counts(rows, {"all": None, "clean": all_present(INCIDENT_COLUMNS, rows.schema)})


@query
def row_counts_not_a_number(spark, sf_dir):
    """Rows counted as present are those that dropping rows with missing values keeps."""
    value = F.col("value")
    ratio = F.when(value < 10, F.lit(float("nan"))).when(value < 20, F.lit(None)).otherwise(value)
    rows = table(spark, sf_dir, "events").select("event_type", ratio.alias("ratio"))
    present = all_present(["ratio"], rows.schema)
    counted = ops.row_counts(rows, {"all": None, "present": present})
    kept_rows = ops.drop_null_rows(rows, ["ratio"]).agg(F.count(F.lit(1)).alias("rows"))
    return counted.unionByName(kept_rows.select(F.lit("kept").alias("stage"), "rows"))


@query
def value_counts_primary_type(spark, sf_dir):
    return ops.value_counts(clean(spark, sf_dir), "primary_type")


@query
def value_counts_location(spark, sf_dir):
    """Over uncleaned rows: null is a value of its own."""
    return ops.value_counts(incidents(spark, sf_dir), "location_description")


@query
def value_counts_customers(spark, sf_dir):
    """A key with very many values."""
    return ops.value_counts(table(spark, sf_dir, "orders"), "o_custkey")


@query
def value_counts_events(spark, sf_dir):
    return ops.value_counts(table(spark, sf_dir, "events"), "event_type")


@query
def distinct_counts(spark, sf_dir):
    return ops.distinct_counts(clean(spark, sf_dir), [*CATEGORIES, "ward", "year"])


@query
def distinct_counts_orders(spark, sf_dir):
    columns = ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
    return ops.distinct_counts(table(spark, sf_dir, "orders"), columns)


@query
def tally_model_columns(spark, sf_dir):
    return ops.tally(clean(spark, sf_dir), MODEL_COLUMNS)


# Profiles that grow by a year at a time


def yearly_state(spark, sf_dir) -> str:
    """The state of every year's rows, each added by reading that year only."""
    rows = stage(incidents(spark, sf_dir).select("year", *REDUCED, "block"), "incidents", ["year"], rebalance=True)
    folder = new_path(spark, "state")
    for row in rows.select("year").distinct().orderBy("year").collect():
        of_year = rows.filter(F.col("year") == row["year"])
        ops.add_source(of_year, folder, str(row["year"]), REDUCED, sketched=["block"])
    return folder


@query
def yearly_state_sources(spark, sf_dir):
    return ops.sources(spark, yearly_state(spark, sf_dir))


@query
def yearly_state_counts(spark, sf_dir):
    return ops.merged_counts(spark, yearly_state(spark, sf_dir))


@query
def yearly_state_top_k(spark, sf_dir):
    return ops.merged_top_k(spark, yearly_state(spark, sf_dir), "description")


@query
def yearly_state_distincts(spark, sf_dir):
    """Counted columns exactly; the sketch of the other within four times its error."""
    found = ops.merged_distincts(spark, yearly_state(spark, sf_dir))
    exact = ops.distinct_counts(incidents(spark, sf_dir), [*REDUCED, "block"])
    compared = found.join(exact.withColumnRenamed("distinct_count", "true"), "column")
    bound = F.when(F.col("is_exact"), 0.0).otherwise(4 * ops.SKETCH_ERROR)
    within = F.abs(F.col("distinct") - F.col("true")) <= bound * F.col("true")
    return compared.select("column", "true", "is_exact", within.alias("is_within"))


# Categories


@query
def top_k_descriptions(spark, sf_dir):
    return ops.top_k_values(clean(spark, sf_dir), "description").drop("column")


@query
def top_k_two_columns(spark, sf_dir):
    return ops.top_k_values(clean(spark, sf_dir), REDUCED)


@query
def keep_top_k(spark, sf_dir):
    """With the values as literals in a filter."""
    rows = ops.keep_top_k(clean(spark, sf_dir), REDUCED, how="literal")
    return rows.select(*KEY_COLUMNS, *MODEL_COLUMNS)


@query
def keep_top_k_join(spark, sf_dir):
    rows = ops.keep_top_k(clean(spark, sf_dir), REDUCED, how="join")
    return rows.select(*KEY_COLUMNS, *MODEL_COLUMNS)


@query
def bucket_other(spark, sf_dir):
    """Over uncleaned rows, with the values as literals: a null becomes ``Other`` too."""
    rows = ops.bucket_other(incidents(spark, sf_dir), "location_description", how="literal")
    return rows.select(*KEY_COLUMNS, "location_description")


@query
def bucket_other_join(spark, sf_dir):
    rows = ops.bucket_other(clean(spark, sf_dir), "description", how="join")
    return rows.select(*KEY_COLUMNS, "description")


@query
def index_categories(spark, sf_dir):
    rows = ops.index_categories(kept(spark, sf_dir), CATEGORIES)
    return rows.select(*KEY_COLUMNS, *FEATURES[:3])


@query
def index_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return ops.index_categories(rows, ["lang", "source"]).drop("lang", "source")


@query
def index_customers(spark, sf_dir):
    """A column with too many values for a category model."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return ops.index_categories(rows, ["o_custkey"], how="join")


# Features and splits


@query
def assemble_features(spark, sf_dir):
    rows = ops.index_categories(kept(spark, sf_dir), CATEGORIES)
    vectors = ops.assemble(rows, FEATURES, keep=[*KEY_COLUMNS, "arrest"])
    return ops.vector_columns(vectors, "features", FEATURES)


@query
def standardize_features(spark, sf_dir):
    rows = ops.index_categories(kept(spark, sf_dir), CATEGORIES)
    vectors = ops.assemble(rows, FEATURES, keep=KEY_COLUMNS)
    scaled = ops.standardize(vectors).drop("features")
    return rounded(ops.vector_columns(scaled, "scaled_features", FEATURES), FEATURES)


@query
def standardize_events(spark, sf_dir):
    vectors = ops.assemble(table(spark, sf_dir, "events"), ["value"], keep=["event_id"])
    scaled = ops.standardize(vectors).drop("features")
    return rounded(ops.vector_columns(scaled, "scaled_features", ["value"]), ["value"])


def rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    """Six decimals, and no negative zero: engines add floats in different orders."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


@query
def hash_split_counts(spark, sf_dir):
    rows = ops.hash_split(incidents(spark, sf_dir), KEY_COLUMNS)
    return ops.value_counts(rows, "split").withColumnsRenamed({"value": "split", "count": "rows"})


@query
def hash_split_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*KEY_COLUMNS)
    return ops.hash_split(rows, KEY_COLUMNS, {"a": 1, "b": 1, "c": 2}, seed=5)


@query
def fold_counts(spark, sf_dir):
    rows = ops.add_folds(incidents(spark, sf_dir), KEY_COLUMNS)
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))


@query
def random_split_counts(spark, sf_dir):
    parts = ops.random_split(table(spark, sf_dir, "lineitem"))
    named = [df.select(F.lit(name).alias("split")) for name, df in parts.items()]
    return union_frames(named).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query
def random_split_rows(spark, sf_dir):
    """The parts together: every row once, whatever part it fell into."""
    parts = ops.random_split(table(spark, sf_dir, "lineitem").select(*KEY_COLUMNS, "l_partkey"))
    return union_frames(list(parts.values()))


# Metrics


def predicted(spark, sf_dir) -> DataFrame:
    rows = ops.flag_to_int(clean(spark, sf_dir), ["arrest"])
    guess = F.col("primary_type").isin("PROMO", "ECONOMY")
    return rows.withColumn("prediction", rule(guess))


METRICS = ["accuracy", "f1", "weighted_precision", "weighted_recall"]


@query
def confusion_matrix(spark, sf_dir):
    return ops.confusion_matrix(predicted(spark, sf_dir), "arrest")


@query
def confusion_labels(spark, sf_dir):
    return ops.confusion_matrix(table(spark, sf_dir, "labels"), "quality", "toxic")


@query
def classification_metrics(spark, sf_dir):
    return rounded(ops.classification_metrics(predicted(spark, sf_dir), "arrest"), METRICS)


@query
def classification_metrics_by_district(spark, sf_dir):
    rows = predicted(spark, sf_dir)
    return rounded(ops.classification_metrics(rows, "arrest", by=["district"]), METRICS)


@query
def classification_metrics_many_classes(spark, sf_dir):
    """Line number as the true class, a guess in 0..6 that misses some classes."""
    rows = table(spark, sf_dir, "lineitem").withColumn(
        "prediction",
        F.when(F.col("l_quantity") > 40, F.col("l_linenumber")).otherwise(
            F.pmod(F.col("l_suppkey"), F.lit(4))
        ),
    )
    return rounded(ops.classification_metrics(rows, "l_linenumber"), METRICS)


@query
def select_best(spark, sf_dir):
    """Three rules scored in one pass, the one with the highest f1 marked."""
    rows = ops.flag_to_int(clean(spark, sf_dir), ["arrest", "domestic"])
    rules = {
        "0": rule(F.col("ward") < 25),
        "1": rule(F.col("primary_type").isin("PROMO", "ECONOMY")),
        "2": rule(F.col("domestic") == 1),
    }
    guesses = rows.select("arrest", *[c.alias(name) for name, c in rules.items()])
    long = guesses.unpivot("arrest", list(rules), "grid_index", "prediction")
    long = long.withColumn("grid_index", F.col("grid_index").cast("int"))
    found = ops.classification_metrics(long, "arrest", by=["grid_index"])
    return rounded(ops.select_best(found, "f1"), METRICS)


@query
def results_roundtrip(spark, sf_dir):
    """A results table written as CSV and read back."""
    found = select_best(spark, sf_dir)
    path = new_path(spark, "results")
    write_results(found, path)
    return spark.read.schema(found.schema).option("header", True).csv(path)


# Models


def stump(spark, sf_dir):
    """A one-split tree on the primary type, and the tally it was trained on."""
    rows = ops.flag_to_int(clean(spark, sf_dir), ["arrest"])
    counted = stage(ops.tally(rows, ["primary_type", "arrest"]), "tally")
    indexer = ops.category_indexer(counted, ["primary_type"], weight="rows")
    data = ops.assemble(indexer.transform(counted), ["primary_type_index"])
    model = ops.fit_tree(data, max_depth=1, label="arrest", weight="rows")
    return model, data, {"primary_type_index": indexer.stages[0].labels}


@query
def stump_nodes(spark, sf_dir):
    model, _, labels = stump(spark, sf_dir)
    nodes = ops.tree_nodes(spark, model, list(labels), labels)
    nodes = nodes.withColumn("left_categories", F.array_join("left_categories", ","))
    nodes = nodes.withColumn("rows", F.col("rows").cast("bigint"))
    return rounded(nodes.drop("tree_id", "class_rows", "threshold"), ["impurity", "gain"])


@query
def stump_scored_counts(spark, sf_dir):
    model, data, _ = stump(spark, sf_dir)
    return ops.confusion_matrix(ops.score(model, data), "arrest", weight="rows")


@query
def stump_metrics(spark, sf_dir):
    model, data, _ = stump(spark, sf_dir)
    return rounded(ops.final_report(model, data, "arrest", "rows"), METRICS)


@query
def estimator_chain_metrics(spark, sf_dir):
    """The same one-split tree as a chain of category model, assembly and tree over rows."""
    rows = ops.flag_to_int(clean(spark, sf_dir), ["arrest"])
    rows = stage(rows.select("primary_type", "arrest"), "clean")
    tree = DecisionTreeClassifier(labelCol="arrest", featuresCol="features", maxDepth=1, seed=1)
    numbers = ops.category_indexer(rows, ["primary_type"])
    chain = ops.build_pipeline(tree, ["primary_type_index"], before=[numbers])
    return rounded(ops.final_report(chain.fit(rows), rows, "arrest"), METRICS)


def one_split_flow(spark, sf_dir):
    """A whole run whose trees SQL can follow: no split, or the best one of four features."""
    grid = ops.param_grid(max_depth=[0, 1], min_instances_per_node=[1])
    return tree_flow(incidents(spark, sf_dir), FOREST_SPEC, grid)


@query
def tree_flow_results(spark, sf_dir):
    return rounded(one_split_flow(spark, sf_dir).results, ["training_f1", "validation_f1"])


@query
def tree_flow_large_k(spark, sf_dir):
    """The same run with dictionaries of up to 600 values."""
    spec = IncidentSpec(keys=KEY_COLUMNS, numbers=(), k=600)
    grid = ops.param_grid(max_depth=[0, 1], min_instances_per_node=[1])
    results = tree_flow(incidents(spark, sf_dir), spec, grid, max_bins=600).results
    return rounded(results, ["training_f1", "validation_f1"])


@query
def keep_top_k_large(spark, sf_dir):
    """Line items of the 600 most ordered parts and the 60 busiest suppliers."""
    rows = table(spark, sf_dir, "lineitem").select(*KEY_COLUMNS, "l_partkey", "l_suppkey")
    return ops.keep_top_k(ops.keep_top_k(rows, ["l_partkey"], 600), ["l_suppkey"], 60)


@query
def forest_scored_counts(spark, sf_dir):
    """Forests on one feature: every tree is the one-split tree, with a bootstrap or without."""
    model, data, _ = stump(spark, sf_dir)
    features = ["primary_type_index"]
    plain = ops.fit_forest(data, 5, 1, label="arrest", bootstrap=False, weight="rows")
    rows = ops.flag_to_int(clean(spark, sf_dir), ["arrest"]).select("primary_type", "arrest")
    single = ops.assemble(ops.index_categories(stage(rows, "clean"), ["primary_type"]), features)
    drawn = ops.fit_forest(single.repartition(4), 5, 1, label="arrest")
    counted = [
        ops.confusion_matrix(ops.score(m, data), "arrest", weight="rows").withColumn("forest", F.lit(name))
        for name, m in (("plain", plain), ("bootstrap", drawn))
    ]
    return counted[0].unionByName(counted[1])


@query
def perceptron_rates(spark, sf_dir):
    """A perceptron without a hidden layer on one flag has as many weights as the data have
    rates: its probabilities are the rates. Blocks of one row, because a gradient is averaged
    over blocks, and a last block that is not full would weigh too much."""
    rows = ops.flag_to_int(clean(spark, sf_dir), ["arrest"])
    promoted = F.col("primary_type").isin("PROMO", "ECONOMY").cast("int").alias("promoted")
    rows = stage(rows.select(promoted, "arrest"), "clean")
    parts = max(4, -(-rows.count() // PART_ROWS))
    model = ops.fit_mlp(
        ops.assemble(rows, ["promoted"]).repartition(parts), [1, 2], label="arrest", features="features",
        block_size=1, max_iter=200, tol=1e-9,
    )
    rates = rows.groupBy("promoted").agg(F.avg("arrest").alias("rate"), F.count("*").alias("rows"))
    scored = ops.score(model, ops.assemble(rates, ["promoted"], keep=["promoted", "rate", "rows"]))
    found = vector_to_array("probability")[1]
    return scored.select(
        "promoted", "rows", F.col("prediction").cast("int").alias("prediction"),
        (F.abs(found - F.col("rate")) < 0.001).alias("is_rate"),
    )


#: Units of a fixed network, whose weights follow a rule.
NETWORK = [3, 4, 2]


def network_weight(layer: int, from_unit: int, to_unit: int) -> float:
    return ((7 * layer + 3 * from_unit + 5 * to_unit) % 11 - 5) / 4


@query
def perceptron_forward(spark, sf_dir):
    """Probabilities of a fixed network with a hidden layer, from its table of weights."""
    table_rows = [
        (layer, i, j, network_weight(layer, i, j))
        for layer in range(1, len(NETWORK))
        for i in range(-1, NETWORK[layer - 1])
        for j in range(NETWORK[layer])
    ]
    weights = spark.createDataFrame(table_rows, "layer int, from_unit int, to_unit int, weight double")
    rows = incidents(spark, sf_dir).select(
        *KEY_COLUMNS,
        F.col("domestic").cast("double").alias("x0"),
        (F.col("ward") / 50).alias("x1"),
        ((F.col("year") - 1995) / 5).alias("x2"),
    )
    scored = ops.forward(rows, weights, ["x0", "x1", "x2"])
    return scored.select(*KEY_COLUMNS, F.round(F.get("probability", F.lit(1)), 6).alias("p1"), "prediction")


@query
def tree_flow_report(spark, sf_dir):
    return rounded(one_split_flow(spark, sf_dir).report, METRICS)


@query
def tree_flow_nodes(spark, sf_dir):
    nodes = one_split_flow(spark, sf_dir).nodes
    nodes = nodes.withColumn("left_categories", F.array_join("left_categories", ","))
    nodes = nodes.withColumn("rows", F.col("rows").cast("bigint"))
    return rounded(nodes.drop("tree_id", "class_rows", "threshold"), ["impurity", "gain"])


@query
def tree_grid_search(spark, sf_dir):
    """The published grid of 25 trees."""
    return tree_flow(incidents(spark, sf_dir), TREE_SPEC, TREE_GRID).results


@query
def final_report(spark, sf_dir):
    """Test metrics of the best of the 25 published points."""
    return tree_flow(incidents(spark, sf_dir), TREE_SPEC, TREE_GRID).report


def flat_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("left_categories", F.array_join("left_categories", ",")).withColumn(
        "class_rows", F.array_join(F.col("class_rows").cast("array<string>"), ",")
    )


@query
def tree_node_table(spark, sf_dir):
    """Nodes of the best of the 25 published points."""
    return flat_nodes(tree_flow(incidents(spark, sf_dir), TREE_SPEC, TREE_GRID).nodes)


# A second label, which needs three features


def escalated(spark, sf_dir) -> DataFrame:
    """Incidents with a label of three features and noise, so that points of a grid differ."""
    rows = incidents(spark, sf_dir)
    promoted = F.col("primary_type").isin("PROMO", "ECONOMY")
    hit = F.when(F.col("domestic"), F.col("ward") < 42).otherwise(promoted)
    return rows.withColumn("escalated", hit != (F.col("community_area") == 3))


ESCALATED_SPEC = IncidentSpec(
    keys=KEY_COLUMNS, label="escalated", required=(*IncidentSpec.required, "escalated")
)


def escalated_flow(spark, sf_dir):
    return tree_flow(escalated(spark, sf_dir), ESCALATED_SPEC, TREE_GRID)


@query
def escalated_tree_search(spark, sf_dir):
    """The published grid of 25 trees, whose points differ."""
    return escalated_flow(spark, sf_dir).results


@query
def escalated_tree_importances(spark, sf_dir):
    return escalated_flow(spark, sf_dir).importances


@query
def escalated_tree_nodes(spark, sf_dir):
    return flat_nodes(escalated_flow(spark, sf_dir).nodes)


TWO_LEVELS = ["primary_type_index", "domestic", "ward"]


def two_levels(spark, sf_dir, merge=True):
    """A tree of two levels over three features, and the tally it was trained on."""
    rows = ops.drop_null_rows(escalated(spark, sf_dir), INCIDENT_COLUMNS)
    rows = ops.flag_to_int(rows, ["domestic", "escalated"])
    counted = stage(ops.tally(rows, ["primary_type", "domestic", "ward", "escalated"]), "tally")
    indexer = ops.category_indexer(counted, ["primary_type"], weight="rows")
    data = ops.assemble(indexer.transform(counted), TWO_LEVELS, keep=["rows", "escalated"])
    model = ops.fit_tree(data, max_depth=2, max_bins=64, label="escalated", weight="rows", merge=merge)
    return model, data, {"primary_type_index": indexer.stages[0].labels}


@query
def two_level_nodes(spark, sf_dir):
    model, _, labels = two_levels(spark, sf_dir, merge=False)
    nodes = ops.tree_nodes(spark, model, TWO_LEVELS, labels).drop("tree_id", "class_rows")
    nodes = nodes.withColumn("left_categories", F.array_join("left_categories", ","))
    nodes = nodes.withColumn("rows", F.col("rows").cast("bigint"))
    return rounded(nodes, ["impurity", "gain"])


@query
def two_level_importances(spark, sf_dir):
    model, _, _ = two_levels(spark, sf_dir, merge=False)
    return rounded(ops.feature_importances(spark, model, TWO_LEVELS), ["importance"])


@query
def two_level_cut_counts(spark, sf_dir):
    """True and predicted classes of the same tree cut at every depth."""
    model, data, _ = two_levels(spark, sf_dir)
    cut = ops.score_depths(model, data, [0, 1, 2])
    return ops.confusion_matrix(cut, "escalated", weight="rows", by=["max_depth"])


@query
def mlp_grid_search(spark, sf_dir):
    results = mlp_flow(incidents(spark, sf_dir), TREE_SPEC, MLP_POINTS, max_iter=100).results
    return results.drop("layers")


@query
def mlp_report(spark, sf_dir):
    """Test metrics of the best of the points of ``mlp_grid_search``."""
    return mlp_flow(incidents(spark, sf_dir), TREE_SPEC, MLP_POINTS, max_iter=100).report


@query
def forest_cross_validate(spark, sf_dir):
    """The published grid of eight forests, three folds each."""
    return forest_flow(incidents(spark, sf_dir), FOREST_SPEC, FOREST_GRID).results


@query
def forest_importances(spark, sf_dir):
    return forest_flow(incidents(spark, sf_dir), FOREST_SPEC, FOREST_GRID).importances


@query
def forest_summary(spark, sf_dir):
    return forest_flow(incidents(spark, sf_dir), FOREST_SPEC, FOREST_GRID).summary


@query
def forest_report(spark, sf_dir):
    return forest_flow(incidents(spark, sf_dir), FOREST_SPEC, FOREST_GRID).report


@query
def forest_tally_results(spark, sf_dir):
    """Forests without bootstrap, trained and validated on the tally alone."""
    return forest_flow(incidents(spark, sf_dir), FOREST_SPEC, FOREST_GRID, bootstrap=False).results


# A bootstrap drawn from the tally

#: Trees of the forest that SQL follows.
DRAWN_TREES = 7


def drawn_tally(spark, sf_dir, columns: list[str], trees: int) -> DataFrame:
    rows = ops.flag_to_int(clean(spark, sf_dir), ["arrest", "domestic"])
    return stage(ops.bootstrap_draws(ops.tally(rows, columns), columns, trees), "drawn")


@query
def bootstrap_weights(spark, sf_dir):
    """How often each tree draws each combination, few and many rows alike."""
    columns = ["primary_type", "domestic", "ward", "year", "arrest"]
    drawn = drawn_tally(spark, sf_dir, columns, 3)
    return drawn.select(*columns, "rows", F.posexplode("draws").alias("tree", "weight"))


@query
def bootstrap_forest_votes(spark, sf_dir):
    """A forest of one-split trees over the drawn tally: its votes for every primary type."""
    counted = drawn_tally(spark, sf_dir, ["primary_type", "arrest"], DRAWN_TREES)
    indexer = ops.category_indexer(counted, ["primary_type"], weight="rows")
    data = ops.assemble(indexer.transform(counted), ["primary_type_index"], keep=["arrest", "rows", "draws"])
    model = ops.BootstrapForest(numTrees=DRAWN_TREES, maxDepth=1, labelCol="arrest").fit(data)
    types = counted.groupBy("primary_type").agg(F.sum("rows").alias("rows"))
    scored = ops.score(model, ops.assemble(indexer.transform(types), ["primary_type_index"], keep=["primary_type", "rows"]))
    found = model.votes(scored.withColumn("p1", F.get(vector_to_array("probability"), F.lit(1))))
    for_one = F.size(F.filter("votes", lambda v: F.get(v, F.lit(1)) > 0.5))
    return found.select("primary_type", "rows", F.round("p1", 6).alias("p1"), "prediction", for_one.alias("trees_for_1"))


@query
def forest_bootstrap_results(spark, sf_dir):
    """The published grid of eight forests over the tally, on the label that needs three features."""
    spec = replace(ESCALATED_SPEC, train_partitions=4)
    return forest_flow(escalated(spark, sf_dir), spec, FOREST_GRID, bootstrap="tally").results


def one_split_forest(spark, sf_dir):
    """A cross-validated run that SQL can follow: one tree with no split, or with the best."""
    grid = ops.param_grid(num_trees=[1], max_depth=[0, 1], max_bins=[32])
    return forest_flow(incidents(spark, sf_dir), FOREST_SPEC, grid, bootstrap=False)


@query
def forest_flow_results(spark, sf_dir):
    return rounded(one_split_forest(spark, sf_dir).results, ["avg_accuracy", "std_accuracy"])


@query
def forest_flow_summary(spark, sf_dir):
    return rounded(one_split_forest(spark, sf_dir).summary, ["validation_accuracy"])


@query
def forest_flow_importances(spark, sf_dir):
    return rounded(one_split_forest(spark, sf_dir).importances, ["importance"])


@query
def forest_flow_report(spark, sf_dir):
    return rounded(one_split_forest(spark, sf_dir).report, METRICS)
