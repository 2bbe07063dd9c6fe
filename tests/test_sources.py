from datetime import datetime

import pytest
from conftest import rows
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from tabular_insights.sources import INCIDENT_FIELDS, read_incidents, union_years, write_results

HEADER = (
    "ID,Date,Block,Primary Type,Description,Location Description,Arrest,Domestic,"
    "Beat,District,Ward,Community Area,Year,Note"
)
LINE = '{id},01/31/{y} 11:05:00 PM,B1,THEFT,"OVER, 500",STREET,true,false,11,1,{ward},7,{y},x'


def year_file(tmp_path, year, wards, header=HEADER):
    path = tmp_path / f"{year}.csv"
    lines = [LINE.format(id=i, y=year, ward=ward) for i, ward in enumerate(wards)]
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def test_reads_named_columns_of_wider_files(spark, tmp_path):
    paths = [year_file(tmp_path, 2019, [1, ""]), year_file(tmp_path, 2020, [3])]
    df = read_incidents(spark, paths)
    assert df.columns == [name for name, _ in INCIDENT_FIELDS.values()]
    found = rows(df.select("ts", "description", "arrest", "domestic", "ward", "year"))
    at = [datetime(y, 1, 31, 23, 5) for y in (2019, 2019, 2020)]
    assert sorted(r[0] for r in found) == at
    assert {r[1] for r in found} == {"OVER, 500"}
    assert {r[2:4] for r in found} == {(True, False)}
    assert sorted(str(r[4]) for r in found) == ["1", "3", "None"]


def test_other_column_order_is_refused(spark, tmp_path):
    swapped = HEADER.replace("Beat,District", "District,Beat")
    paths = [year_file(tmp_path, 2019, [1]), year_file(tmp_path, 2020, [2], swapped)]
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_incidents(spark, paths).collect()


def test_missing_column_is_refused(spark, tmp_path):
    path = year_file(tmp_path, 2019, [1], HEADER.replace("Ward", "Wart"))
    with pytest.raises(ValueError, match="Ward"):
        read_incidents(spark, path)


def test_malformed_value_is_null_unless_refused(spark, tmp_path):
    path = year_file(tmp_path, 2019, [1, "x9"])
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_incidents(spark, path, mode="FAILFAST").collect()
    assert rows(read_incidents(spark, path).select("ward")) == [(1,), (None,)]


def test_scan_parses_only_wanted_columns(spark, tmp_path):
    df = read_incidents(spark, year_file(tmp_path, 2019, [1])).select("ward")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Ward:int>" in plan


def test_flag_spellings_in_files(spark, tmp_path):
    path = tmp_path / "flags.csv"
    path.write_text("Arrest\ntrue\nfalse\nTRUE\n")
    df = read_incidents(spark, str(path), {"Arrest": ("arrest", T.BooleanType())})
    assert [r[0] for r in df.collect()] == [True, False, True]


def test_union_by_name_and_position(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n int")
    assert rows(union_years([a, b, a])) == [(1, "x"), (1, "x"), (2, "y")]
    c = b.select("n", "s").toDF("p", "q")
    assert rows(union_years([a, c], by="position")) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        union_years([a], by="luck")


def test_results_table_roundtrip(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, [6, 8, 2], 0.5, True)], "grid_index int, layers array<int>, f1 double, is_best boolean"
    )
    write_results(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert rows(back) == [("0", "[6, 8, 2]", "0.5", "true")]
    write_results(df, str(tmp_path / "pq"), fmt="parquet")
    assert rows(spark.read.parquet(str(tmp_path / "pq"))) == rows(df)


def test_nulls_survive_csv(spark, tmp_path):
    ward = F.when(F.col("id") != 1, F.col("id")).alias("Ward")
    write_results(spark.range(3).select("id", ward), str(tmp_path / "n"))
    back = read_incidents(spark, str(tmp_path / "n"), {"Ward": ("ward", T.IntegerType())})
    assert rows(back) == [(0,), (2,), (None,)]


def test_inferred_types(spark, tmp_path):
    df = read_incidents(spark, year_file(tmp_path, 2019, [1, 2]), infer=True)
    types = dict(df.dtypes)
    assert types["ward"] == "int" and types["arrest"] == "boolean"
    assert types["block"] == "string" and types["ts"].startswith("timestamp")
