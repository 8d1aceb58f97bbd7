import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from profilekit.operators import quantiles
from profilekit.operators.quantiles import column_quantiles, grouped_quantiles
from profilekit.runtime import LOOKUP_ROWS, Lookup

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def expected(values):
    known = [v for v in values if v is not None]
    return [float(np.quantile(known, p)) for p in PROBS]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_direct_matches_numpy(spark, values):
    got = column_quantiles(frame(spark, values), {"x": F.col("x")}, PROBS)["x"]
    if all(v is None for v in values):
        assert got == [None] * len(PROBS)
    else:
        assert got == pytest.approx(expected(values), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize(
    "values",
    [
        list(np.random.default_rng(1).lognormal(3, 2, 4000)),
        [7.0] * 3000,
        [0.0] * 1500 + [1.0] * 1500,
        [0.0] * 1500 + [1.0] * 1499 + list(np.linspace(0.1, 0.9, 400)),
        [None] * 500 + list(range(2000)),
    ],
    ids=["skewed", "constant", "two values", "ties with middle", "nulls"],
)
@pytest.mark.parametrize("size", [8000, 8], ids=["fine sketch", "coarse sketch"])
def test_selection_matches_numpy(spark, values, size, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", size)
    for direct_rows, together in ((100, 0), (3, 0), (100, 10_000)):
        monkeypatch.setattr(quantiles, "TOGETHER", together)
        got = column_quantiles(frame(spark, values), {"x": F.col("x")}, PROBS, direct_rows=direct_rows)["x"]
        assert got == pytest.approx(expected(values), rel=1e-12)


def test_pivots_that_miss_the_rank_are_mended():
    """Whatever the sketch says, a bracket goes on where the counts put the rank."""
    found = {}
    b = quantiles._Bracket("x", [4, 5], 0, 10, pivots=(7.0, 8.0))
    left = b.narrowed({"lt": 5, "at_low": 1, "mid": 1, "at_high": 2}, found)
    assert found == {("x", 5): 7.0}
    assert [(p.ranks, p.below, p.rows, p.lo, p.hi, p.pivots) for p in left] == [([4], 0, 5, None, 7.0, None)]
    left = quantiles._Bracket("x", [9], 0, 10, lo=1.0, pivots=(7.0, 7.0)).narrowed({"lt": 5, "at_low": 1, "mid": 0, "at_high": 1}, found)
    assert [(p.ranks, p.below, p.rows, p.lo, p.hi) for p in left] == [([9], 6, 4, 7.0, None)]


def test_columns_take_no_unpivot_join_or_shuffle_of_rows(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(quantiles, "TOGETHER", 0)
    df = spark.range(5000).selectExpr("double(id * 7919 % 5003) a", "double(id % 13) b", "if(id % 3 = 0, null, sqrt(id)) c")
    kind = type(df)
    agg = kind.agg
    monkeypatch.setattr(kind, "agg", lambda self, *x: (lambda out: plans.append(out._jdf.queryExecution().executedPlan().toString()) or out)(agg(self, *x)))
    column_quantiles(df, {c: F.col(c) for c in df.columns}, [0.25, 0.5, 0.75])
    assert 2 <= len(plans) <= 3
    for plan in plans:
        assert "Join" not in plan and "Expand" not in plan and "Generate" not in plan and plan.count("Exchange") == 1
        assert "Exchange SinglePartition" in plan
    # Counts are computed in generated code.
    assert "ObjectHashAggregate" not in plans[1]


def test_selection_with_a_hot_group(spark):
    """One group holds most rows; small groups take the direct way, the hot one is narrowed."""
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.normal(size=3000)]
    rows += [(f"g{i}", float(v)) for i in range(20) for v in rng.normal(i, 1, 25)]
    long = spark.createDataFrame(rows, "grp string, value double").repartition(5)
    got = {r["grp"]: r["quantiles"] for r in grouped_quantiles(long, ["grp"], PROBS, direct_rows=200).collect()}
    assert len(got) == 21
    for grp in got:
        assert got[grp] == pytest.approx(expected([v for g, v in rows if g == grp]), rel=1e-12)


def test_lookup_above_its_bound_is_not_broadcast(spark):
    table = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    data = spark.range(400).select(F.col("id").alias("key"))
    small, large = Lookup(table), Lookup(table, limit=100)
    assert small.small and not large.small and LOOKUP_ROWS > 200
    for lookup in (small, large):
        joined = lookup.left_join(data, "key", "k").orderBy("key").collect()
        assert [r["v"] for r in joined] == [i * 2 if i < 200 else None for i in range(400)]


def test_approximate_quantiles_keep_their_rank_bound(spark):
    values = list(range(10_000))
    got = column_quantiles(frame(spark, values), {"x": F.col("x")}, [0.25, 0.75], accuracy=1000)["x"]
    assert got == pytest.approx([2500, 7500], abs=10_000 / 1000 + 1)
    assert column_quantiles(frame(spark, [None]), {"x": F.col("x")}, [0.5], accuracy=100) == {"x": [None]}


def test_selection_over_several_columns(spark):
    rng = np.random.default_rng(9)
    data = {"a": rng.normal(size=2500), "b": rng.integers(0, 4, 2500).astype(float), "c": rng.gamma(1, 3, 2500)}
    df = spark.createDataFrame(list(zip(*[map(float, v) for v in data.values()])), "a double, b double, c double")
    df = df.withColumn("few", F.when(F.col("a") > 2.0, F.col("a")))
    got = column_quantiles(df, {c: F.col(c) for c in df.columns}, PROBS, direct_rows=150)
    for c, v in data.items():
        assert got[c] == pytest.approx(expected(v), rel=1e-12)
    assert got["few"] == pytest.approx(expected([v for v in data["a"] if v > 2.0]), rel=1e-12)


@pytest.mark.parametrize("direct_rows", [300, 20])
def test_selection_in_levels_equals_the_sorted_values(spark, direct_rows):
    """Neighbouring ranks that share pivots but not the bracket around them are counted apart; 24 seeds, one group each."""
    values = {}
    for seed in range(24):
        rng = np.random.default_rng(seed)
        values[seed] = rng.random(6000) if seed % 2 else np.round(rng.lognormal(0, 2, 6000), 2)
    frame = pd.DataFrame({"g": np.repeat(list(values), 6000), "value": np.concatenate(list(values.values()))})
    probs = [0.25, 0.5, 0.75]
    found = grouped_quantiles(spark.createDataFrame(frame).coalesce(4), ["g"], probs, direct_rows=direct_rows).collect()
    assert len(found) == 24
    for r in found:
        assert list(r["quantiles"]) == pytest.approx(list(np.quantile(values[r.g], probs)), rel=1e-12)
