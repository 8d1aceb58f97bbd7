import pytest
from conftest import by_key
from pyspark.sql import functions as F

from profilekit.operators import schema


def test_discovery_and_split(small):
    assert schema.categorical_columns(small) == ["gics_sector", "rating"]
    assert schema.numeric_columns(small, ["company_id"])[0] == "environmental_score"
    strings, others = schema.split_columns(small.withColumn("flag", F.lit(True)), ["company_id"])
    assert strings == ["gics_sector", "rating"] and others[-1] == "flag"


def test_nan_becomes_null_and_whole_floats_become_integers(spark):
    df = spark.createDataFrame(
        [(1.0, 1.5, float("nan")), (2.0, None, 3.0), (None, float("nan"), float("nan"))], "a double, b double, c double"
    )
    out = schema.normalise_types(df)
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "bigint"}
    assert [tuple(r) for r in out.collect()] == [(1, 1.5, None), (2, None, 3), (None, None, None)]


def test_all_null_float_stays_double(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert dict(schema.normalise_types(df).dtypes) == {"a": "double"}


def test_names():
    assert schema.interleave_transformed(["a", "b", "yeo_joh_b", "yeo_joh_a"]) == ["a", "yeo_joh_a", "b", "yeo_joh_b"]
    assert schema.columns_with_keyword(["Gross_Margin", "size"], schema.INTERACTION_KEYWORDS) == ["Gross_Margin"]


def test_flag_prefix_is_stripped_once(spark):
    df = spark.createDataFrame([(1, 2)], "iqr_out_iqr_out_x int, iqr_out_y int")
    assert schema.base_of_flags(df, "iqr_out_") == ["iqr_out_x", "y"]


def test_drop_ignores_absent(small):
    assert schema.drop_columns(small, ["rating", "nothing"], ["social"]).columns == [
        "company_id", "gics_sector", "environmental_score", "governance_score", "carbon_emissions",
    ]


def test_coerce_keeps_mostly_numeric(spark):
    df = spark.createDataFrame([("1", "x", "5"), ("2", "3", None), ("z", "y", "NaN")], "a string, b string, c string")
    out, report, kept = schema.coerce_numeric(df, ["a", "b", "c"])
    assert kept == ["a"] and out.columns == ["a"]
    shares = by_key(report, "variable")
    assert shares["a"]["share"] == pytest.approx(2 / 3) and shares["c"]["share"] == pytest.approx(1 / 3)


def test_validation(small):
    schema.validate_frame(small, ["rating"], ["social_score"], 5)
    with pytest.raises(ValueError, match="missing required"):
        schema.validate_frame(small, ["nothing"])
    with pytest.raises(ValueError, match="not numeric"):
        schema.validate_frame(small, numeric=["rating"])
    with pytest.raises(ValueError, match="needs at least 6"):
        schema.validate_frame(small, min_rows=6)


def test_target_guard(small):
    schema.assert_no_target(small, "esg_score")
    with pytest.raises(ValueError, match="leaks"):
        schema.assert_no_target(small.withColumn("yeo_joh_esg_score", F.lit(1.0)), "esg_score")


def test_range_violations(small):
    row = schema.range_violations(small, "environmental_score", 0, 50).first()
    assert (row.violations, row.minimum, row.maximum) == (1, 20.0, 55.0)


def test_types_of_text(spark):
    rows = [
        ("1", "1.5", "true", "2024-01-31", "2024-01-31 10:00:00", "007", "1", "x", None, "", "9999999999999999999999", "1d"),
        (" -20 ", ".5", "FALSE", "2023-12-01", "2024-01-31", "12", "n/a", "y", None, " ", "1", "2"),
        (None, "1e3", "", None, "", "3", "2", None, None, None, "2", "3"),
    ]
    names = "whole real flag day time code mixed text none blank wide java".split()
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    assert schema.text_types(df) == dict(
        whole="bigint", real="double", flag="boolean", day="date", time="timestamp", code="string", mixed="string", text="string",
        none="string", blank="string", wide="double", java="string",
    )
    out = schema.type_strings(df)
    assert [f.dataType.simpleString() for f in out.schema][:5] == ["bigint", "double", "boolean", "date", "timestamp"]
    assert [tuple(r)[:3] for r in out.collect()] == [(1, 1.5, True), (-20, 0.5, False), (None, 1000.0, None)]
    assert schema.type_strings(df, ["code"]).columns == names and schema.text_types(df.select()) == {}


def test_identifier_columns(spark):
    df = spark.range(500).selectExpr("concat('u', id) AS uid", "concat('g', id % 400) AS mostly", "concat('c', id % 9) AS kind", "cast(null AS string) AS none")
    assert schema.identifier_columns(df, df.columns) == ["uid"]
    assert schema.identifier_columns(df, df.columns, 0.5) == ["uid", "mostly"] and schema.identifier_columns(df, []) == []
