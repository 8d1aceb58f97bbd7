import pytest
from pyspark.sql import functions as F

from profilekit.operators import assemble, profile
from profilekit.operators.schema import split_columns
from profilekit.sources import readers, samples, sinks


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_csv_round_trip(spark, small, folder):
    sinks.write_csv(small, f"{folder}/t.csv")
    back = readers.read_csv(spark, f"{folder}/t.csv")
    assert sorted(map(tuple, back.select(small.columns).collect())) == sorted(map(tuple, small.collect()))
    typed = readers.read_csv(spark, f"{folder}/t.csv", small.schema)
    assert typed.schema.simpleString() == small.schema.simpleString()
    keyed = readers.read_keyed(spark, f"{folder}/t.csv", "gics_sector")
    assert keyed.columns[0] == "gics_sector"
    with pytest.raises(ValueError, match="key column"):
        readers.read_keyed(spark, f"{folder}/t.csv", "nothing")


def test_nan_is_null_after_reading(spark, folder):
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(f"{folder}/p")
    assert readers.read_table(spark, f"{folder}/p").where("x is null").count() == 1


def test_first_available(spark, small, folder):
    sinks.write_table(small, f"{folder}/second")
    df = readers.read_first(spark, [f"{folder}/first", f"{folder}/second"])
    assert df.count() == 5
    with pytest.raises(FileNotFoundError):
        readers.read_first(spark, [f"{folder}/first"])


def test_json_parameters(spark, folder):
    sinks.write_manifest(spark, {"n_trees": 5, "pairs": [["a", "b"]]}, f"{folder}/params")
    assert readers.read_params(spark, f"{folder}/params") == {"n_trees": 5, "pairs": [["a", "b"]]}
    assert readers.read_params(spark, f"{folder}/absent", {}) == {}


def test_type_split(spark, small, folder):
    strings, others = split_columns(small, ["company_id"])
    paths = sinks.write_split(small, strings, others, folder, "company_id")
    assert readers.read_table(spark, paths["categorical"]).columns == ["company_id", "gics_sector", "rating"]
    assert len(readers.read_table(spark, paths["numerical"]).columns) == 5
    assert readers.read_table(spark, paths["imputed_data"]).count() == 5


def test_result_and_list_sinks(spark, small, folder):
    sinks.write_json(profile.dtype_counts(small), f"{folder}/types")
    assert readers.read_table(spark, f"{folder}/types", "json").count() == 3
    lists = sinks.transformed_column_lists(small.withColumn("yeo_joh_a", F.lit(1.0)), ["rating_A"], "company_id")
    assert lists["yeo_columns"] == ["yeo_joh_a", "rating_A"] and "company_id" not in lists["base_columns"]
    table = sinks.column_lists(spark, lists)
    assert table.where("list_name = 'yeo_columns' and pos = 1").first()["column"] == "rating_A"


def test_bucketed_tables_join_without_shuffle(spark, small):
    for name in ("left_features", "right_features"):
        sinks.write_bucketed(small.select("company_id", F.rand(1).alias(name[0])), name, "company_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = assemble.join_features(spark.table("left_features"), spark.table("right_features"), "company_id", False)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("left_features", "right_features"):
            spark.sql(f"drop table {name}")


def test_samples_are_deterministic(spark):
    df = samples.company_table(spark, 1000)
    again = samples.company_table(spark, 1000).repartition(7)
    assert sorted(map(str, df.collect())) == sorted(map(str, again.collect()))
    large = samples.company_table(spark, 50_000)
    shares = large.groupBy(F.col("gics_sector") == "group 1").agg(F.avg(F.col("environmental_score").isNull().cast("int"))).collect()
    assert {r[0]: r[1] for r in shares} == pytest.approx({True: 0.37, False: 0.1}, abs=0.03)
    panel = samples.panel_table(spark)
    assert panel.count() == 200 and panel.agg(F.min("company_id"), F.max("year")).first()[0] == 1
    energy = panel.where("gics_sector = 'group 2'").agg(F.avg(F.col("esg_score").isNull().cast("int"))).first()[0]
    assert energy > 0.15
