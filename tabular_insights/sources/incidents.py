"""Reading yearly incident files and putting the years together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Header of an incident file -> (column name, type) in this library.
INCIDENT_FIELDS: dict[str, tuple[str, T.DataType]] = {
    "Date": ("ts", T.TimestampNTZType()),
    "Block": ("block", T.StringType()),
    "Primary Type": ("primary_type", T.StringType()),
    "Description": ("description", T.StringType()),
    "Location Description": ("location_description", T.StringType()),
    "Arrest": ("arrest", T.BooleanType()),
    "Domestic": ("domestic", T.BooleanType()),
    "Beat": ("beat", T.IntegerType()),
    "District": ("district", T.IntegerType()),
    "Ward": ("ward", T.IntegerType()),
    "Community Area": ("community_area", T.IntegerType()),
    "Year": ("year", T.IntegerType()),
}


# Fixed value: how an incident file writes its dates.
INCIDENT_TIME = "MM/dd/yyyy hh:mm:ss a"


def read_incidents(
    spark: SparkSession,
    paths: str | Sequence[str],
    fields: dict[str, tuple[str, T.DataType]] | None = None,
    timestamp_format: str = INCIDENT_TIME,
    mode: str = "PERMISSIVE",
    infer: bool = False,
) -> DataFrame:
    """All files as one frame with the wanted columns, typed and renamed.

    Types are given, so nothing but the header line of the first file is read up
    front. Columns outside ``fields`` may be present anywhere in the files; they
    are not parsed. A cell that does not fit its type is null, and its row goes where
    rows with nulls are dropped; ``mode="FAILFAST"`` stops at such a cell instead. Every file's header is checked against the first one's, so a
    year with other column positions fails instead of shifting values. With ``infer``
    the types in ``fields`` are ignored and found by one more pass over all files.
    """
    fields = fields or INCIDENT_FIELDS
    paths = [paths] if isinstance(paths, str) else list(paths)
    header = spark.read.option("header", True).csv(paths[0]).columns
    missing = [name for name in fields if name not in header]
    if missing:
        raise ValueError(f"columns not in the file header: {missing}")
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if infer:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.schema(
            T.StructType(
                [T.StructField(h, fields[h][1] if h in fields else T.StringType()) for h in header]
            )
        )
    rows = (
        reader.option("timestampFormat", timestamp_format)
        .option("timestampNTZFormat", timestamp_format)
        .option("mode", mode)
        .csv(paths)
    )
    return rows.select(*[F.col(f"`{h}`").alias(name) for h, (name, _) in fields.items()])


def rejected_cells(
    spark: SparkSession,
    paths: str | Sequence[str],
    fields: dict[str, tuple[str, T.DataType]] | None = None,
    timestamp_format: str = INCIDENT_TIME,
) -> DataFrame:
    """``(file, column, text)``: every cell that :func:`read_incidents` turns into null because
    it does not fit its type, with the same parser, from one scan of the files as text."""
    fields = fields or INCIDENT_FIELDS
    paths = [paths] if isinstance(paths, str) else list(paths)
    header = spark.read.option("header", True).csv(paths[0]).columns
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    cells = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(paths)
    # a cell alone is a record of one field: no character of it separates or quotes
    options = {
        "sep": "\u0001", "quote": "\u0002", "escape": "\u0002", "lineSep": "\u0003",
        "timestampFormat": timestamp_format, "timestampNTZFormat": timestamp_format,
    }
    found = []
    for head, (name, kind) in fields.items():
        if isinstance(kind, T.StringType):
            continue
        text = F.col(f"`{head}`")
        parsed = F.from_csv(text, f"cell {kind.simpleString()}", options)["cell"]
        cell = F.struct(F.lit(name).alias("column"), text.alias("text"))
        found.append(F.when(text.isNotNull() & parsed.isNull(), cell))
    bad = F.inline(F.array_compact(F.array(*found)))
    return cells.select(F.col("_metadata.file_path").alias("file"), bad)


def union_years(frames: Sequence[DataFrame], by: str = "name") -> DataFrame:
    """All rows of all frames, duplicates kept, columns matched by name or position."""
    if by not in ("name", "position"):
        raise ValueError("by must be 'name' or 'position'")
    merge = DataFrame.unionByName if by == "name" else DataFrame.union
    return reduce(merge, frames)
