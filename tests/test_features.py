import numpy as np
import pytest
from conftest import by_key
from pyspark.sql import functions as F

from profilekit.operators import encode, power, profile, scale
from profilekit.plans.analysis import compare_distributions, engineer_features


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (6.0, 5.0)], "x double, c double")
    x = np.array([1.0, 2.0, 6.0])
    for method, want in {
        "standard": (x - x.mean()) / x.std(),
        "minmax": (x - 1) / 5,
        "robust": (x - 2) / (np.quantile(x, 0.75) - np.quantile(x, 0.25)),
    }.items():
        rows = scale.Scale(method).fit_transform(df).collect()
        assert [r.x for r in rows if r.x is not None] == pytest.approx(list(want))
        assert [r.c for r in rows] == [0.0] * 4
    with pytest.raises(ValueError, match="unknown scaling"):
        scale.Scale("other")


def test_target_zscore_uses_sample_std(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, y double")
    assert [r.y_zscore for r in scale.target_zscore(df, "k", "y").orderBy("k").collect()] == [-1.0, 0.0, 1.0]


def test_one_hot_order_null_and_mapping(spark):
    df = spark.createDataFrame([(1, "b c"), (2, "a"), (3, None), (4, "d.e")], "k int, v string")
    model = encode.OneHot(["v"]).fit(df)
    assert model.mapping == {"v": ["v_b c", "v_d.e"]}
    out = model.transform(df)
    assert dict(out.dtypes)["v_d.e"] == "float"
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1)]
    assert encode.OneHot(["v"], drop_first=False).fit(df).mapping["v"][0] == "v_a"
    unseen = spark.createDataFrame([(9, "zz")], "k int, v string")
    assert tuple(model.transform(unseen).first()) == (9, 0, 0)


def test_one_hot_without_categories_is_unchanged(spark):
    df = spark.range(3)
    assert encode.OneHot().fit_transform(df).columns == ["id"]


@pytest.mark.parametrize("drop_first", [True, False])
def test_one_hot_vector(spark, drop_first):
    df = spark.createDataFrame([(i, f"v{i % 12:02d}") for i in range(24)] + [(99, None)], "k int, v string")
    model = encode.OneHot(["v"], drop_first=drop_first, output="vector").fit(df)
    out = model.transform(df)
    assert out.columns == ["k", "v_vector"] and model.widths == {"v": 12 - drop_first}
    rows = {r.k: r.v_vector for r in out.collect()}
    slots = {r.value: r.slot for r in model.slots().collect()}
    for i in range(24):
        v = f"v{i % 12:02d}"
        assert rows[i].size == 12 - drop_first and list(rows[i].indices) == ([slots[v]] if v in slots else [])
    assert rows[99].numNonzeros() == 0 and slots.get("v00") == (None if drop_first else 0)
    unseen = spark.createDataFrame([(1, "zz")], "k int, v string")
    assert model.transform(unseen).first().v_vector.numNonzeros() == 0


@pytest.mark.parametrize("values", [49, 50, 51, 400])
def test_one_hot_form_does_not_depend_on_the_data(spark, values):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(values)], "k int, v string")
    assert len(encode.OneHot(["v"]).fit_transform(df).columns) == values
    vector = encode.OneHot(["v"], output="vector").fit_transform(df)
    assert vector.columns == ["k", "v_vector"] and vector.first().v_vector.size == values - 1


def test_one_hot_vectors_of_columns_without_features(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (2, "a", None, "y")], "k int, one string, none string, two string")
    model = encode.OneHot(exclude=["k"], output="vector").fit(df)
    assert model.widths == {"one": 0, "none": 0, "two": 1}
    rows = {r.k: r for r in model.transform(df).collect()}
    assert [rows[k][f"{c}_vector"].numNonzeros() for k in (1, 2) for c in ("one", "none", "two")] == [0, 0, 0, 0, 0, 1]
    with pytest.raises(ValueError, match="output must be"):
        encode.OneHot(output="wide")


def test_dictionary_in_partitions(spark):
    rows = [(f"a{i % 700:04d}", f"b{i % 31}") for i in range(2800)] + [(None, None)]
    df = spark.createDataFrame(rows, "p string, q string").repartition(6)
    got = {(r.variable, r.value): r.ordinal for r in encode.category_dictionary(df, ["p", "q"]).collect()}
    want = {}
    for i, c in enumerate("pq"):
        want |= {(c, v): k for k, v in enumerate(sorted({r[i] for r in rows if r[i]}))}
    assert got == want


def test_expansion_table(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "p string, q string")
    rows = by_key(encode.expansion_table(df, encode.OneHot().fit(df).widths), "column")
    assert tuple(rows["p"]) == ("p", 3, 2, pytest.approx(2 / 3))
    assert tuple(rows["q"]) == ("q", 1, 0, 0.0)
    assert tuple(rows["TOTAL"]) == ("TOTAL", 4, 2, 0.5)


def test_target_encoding(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 11.0), (None, 5.0)], "c string, y double")
    out = encode.TargetEncode(["c"], "y", k=5).fit(df)
    rows = by_key(out.transform(df).dropDuplicates(["c"]), "c")
    assert rows["a"]["c_target_encoded"] == pytest.approx((2 * 2 + 5 * 5) / 7)
    assert rows[None]["c_target_encoded"] is None
    median = encode.TargetEncode(["c"], "y", method="median").fit_transform(df)
    assert by_key(median.dropDuplicates(["c"]), "c")["a"]["c_target_encoded"] == 2.0


def test_interactions(spark):
    df = spark.createDataFrame([(6.0, 2.0), (1.0, 0.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    out = encode.interact(df, [("a", "b"), ("a", "zz")], "divide")
    assert out.columns == ["a", "b", "a_div_b"] and [r.a_div_b for r in out.collect()] == [3.0, None, None, None]
    with pytest.raises(ValueError, match="unknown interaction"):
        encode.interact(df, [], "other")


def test_default_pairs():
    names = [f"r{i}_ratio" for i in range(7)]
    pairs = encode.default_interaction_pairs([*names, "size"])
    assert len(pairs) == 4 + 4 + 4 + 3 + 2 and pairs[0] == ("r0_ratio", "r1_ratio")
    assert encode.default_polynomial_columns(["a growth", "b_yield"]) == ["b_yield"]


def test_polynomial_names(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, `b c` double")
    out = encode.polynomial(df, ["a", "b c"], 3)
    assert out.columns[2:] == ["a_pow_2", "a_b_c", "b_c_pow_2", "a_pow_3", "a_pow_2_b_c", "a_b_c_pow_2", "b_c_pow_3"]
    assert tuple(out.first())[2:] == (4, 6, 9, 8, 12, 18, 27)


def test_feature_chain_order_and_log(companies):
    out, info = engineer_features(
        companies.select("company_id", "country", "market_cap", "revenue"), exclude=["company_id"], scaling="standard",
        interactions=[("market_cap", "revenue")], polynomials=["revenue"],
    )
    assert [t["type"] for t in info.transformations] == ["one_hot_encoding", "normalization", "interactions", "polynomials"]
    assert info.column_change == 5 and out.columns[-2:] == ["market_cap_x_revenue", "revenue_pow_2"]
    row = out.agg(F.avg("country_south"), F.stddev_pop("country_south"), F.avg("revenue_pow_2")).first()
    assert row[0] == pytest.approx(0, abs=1e-6) and row[1] == pytest.approx(1, abs=1e-6) and row[2] == pytest.approx(1)
    assert set(info.common_numeric) == {"market_cap", "revenue"}
    compared = by_key(compare_distributions(companies, out, ["revenue"]), "variable")
    assert compared["revenue"]["transformed_mean"] == pytest.approx(0, abs=1e-9)


# --- Yeo-Johnson ----------------------------------------------------------------


def yj(x, lam):
    x = np.asarray(x, dtype=float)
    pos = np.log1p(x.clip(0)) if lam == 0 else ((1 + x.clip(0)) ** lam - 1) / lam
    neg = -np.log1p((-x).clip(0)) if lam == 2 else -((1 + (-x).clip(0)) ** (2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, pos, neg)


def llf(x, lam):
    return -len(x) / 2 * np.log(np.var(yj(x, lam))) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))


def best_lambda(x, low=-8.0, high=8.0):
    """Golden-section search, independent of the fitted grid."""
    ratio = (5 ** 0.5 - 1) / 2
    for _ in range(80):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if llf(x, a) > llf(x, b) else (a, high)
    return (low + high) / 2


@pytest.mark.parametrize("lam", [-1.0, 0.0, 0.5, 1.0, 2.0, 3.0])
def test_transform_formula(spark, lam):
    x = [-3.0, -0.5, 0.0, 0.25, 4.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(9, None)], "k int, x double")
    out = power.YeoJohnson(["x"], lambdas={"x": lam}, standardize=False).fit_transform(df).orderBy("k").collect()
    assert [r.yeo_joh_x for r in out] == pytest.approx([*yj(x, lam), yj([0.0], lam)[0]])


def test_fitted_lambda_matches_search(spark):
    rng = np.random.default_rng(3)
    data = {
        "lognormal": rng.lognormal(2, 1, 500), "mixed": rng.normal(1, 3, 500) ** 3, "left": -rng.gamma(2, 3, 500),
        "huge": rng.lognormal(27, 1.5, 500), "steep": 10 - rng.lognormal(0, 0.4, 500),
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())], ", ".join(f"{c} double" for c in data))
    model = power.YeoJohnson().fit(df)
    for c, x in data.items():
        found = best_lambda(x, 0.0, 16.0) if c == "steep" else best_lambda(x)
        assert model.parameters[c]["lambda"] == pytest.approx(found, abs=2e-4), c
    out = model.transform(df).agg(*[F.avg(f"yeo_joh_{c}") for c in data], *[F.stddev_pop(f"yeo_joh_{c}") for c in data]).first()
    assert list(out) == pytest.approx([0.0] * 5 + [1.0] * 5, abs=1e-6)


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(3.0, None), (3.0, None)], "c double, e double")
    out = power.YeoJohnson().fit_transform(df)
    assert out.columns == ["c", "e", "yeo_joh_c"] and [r.yeo_joh_c for r in out.collect()] == [0.0, 0.0]


# --- profiles ----------------------------------------------------------------------


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i), 4.0, None) for i in range(31)] + [(None, None, None)], "x double, c double, e double")
    rows = profile.histogram(df, ["x", "c", "e"]).collect()
    x = {r.bin: r["count"] for r in rows if r.variable == "x"}
    assert sum(x.values()) == 31 and x[29] == 2 and len(x) == 30
    assert [r["count"] for r in rows if r.variable == "c"] == [31] and not [r for r in rows if r.variable == "e"]


def test_box_stats(small):
    row = profile.box_stats(small, ["carbon_emissions"]).first()
    assert (row["count"], row.q1, row.median, row.q3) == (5, 300, 500, 900)
    assert (row.whisker_low, row.whisker_high, row.fliers) == (200, 900, 1)


def test_variance_and_sizes(small):
    assert profile.top_variance(small, k=1).first().variable == "carbon_emissions"
    sizes = by_key(profile.size_profile(small), "variable")
    assert sizes["rating"]["bytes"] == 7 and sizes["social_score"]["bytes"] == 32
    assert by_key(profile.dtype_counts(small), "dtype")["double"]["columns"] == 4


def test_default_pairs_and_polynomials_in_the_feature_chain(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 5.0), (2, 4.0, 1.0, 2.0)], "k int, a_ratio double, b_ratio double, c_yield double")
    out, info = engineer_features(df, exclude=["k"], one_hot=False, interactions="default", polynomials="default")
    assert [t["type"] for t in info.transformations] == ["interactions", "polynomials"]
    pairs = encode.default_interaction_pairs(["a_ratio", "b_ratio", "c_yield"])
    assert info.transformations[0]["interactions"] == [list(p) for p in pairs] and ("a_ratio", "b_ratio") in pairs
    assert info.transformations[1]["columns"] == encode.default_polynomial_columns(["a_ratio", "b_ratio", "c_yield"])
    assert [r.a_ratio_x_b_ratio for r in out.orderBy("k").collect()] == [6.0, 4.0]


def plain_llf(x, lam):
    y = np.where(x >= 0, np.log1p(np.abs(x)) if lam == 0 else np.expm1(lam * np.log1p(np.abs(x))) / (lam or 1),
                 -np.log1p(np.abs(x)) if lam == 2 else -np.expm1((2 - lam) * np.log1p(np.abs(x))) / ((2 - lam) or 1))
    return -0.5 * len(x) * np.log(y.var()) + (lam - 1) * float((np.sign(x) * np.log1p(np.abs(x))).sum())


@pytest.mark.parametrize("case", ["far below", "far above", "mixed", "narrow"])
def test_fitted_lambda_is_the_top_wherever_it_lies(spark, case):
    rng = np.random.default_rng(3)
    x = {
        "far below": 1 - 1e-3 * rng.lognormal(0, 0.4, 400), "far above": -(1 - 1e-3 * rng.lognormal(0, 0.4, 400)),
        "mixed": rng.normal(-1, 3, 400), "narrow": 5000 + rng.lognormal(0, 1, 400),
    }[case]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").coalesce(1)
    lam = power.fit_lambdas(df, {"x": F.col("x")})["x"]
    likelihood = power.Likelihood(df, {"x": F.col("x")})
    step = 0.01 * max(1.0, abs(lam))
    likelihood.add({"x": [lam - step, lam, lam + step]})
    below, at, above = (likelihood.known["x"][v] for v in (lam - step, lam, lam + step))
    assert at > below and at > above
    if case == "mixed":
        assert at == pytest.approx(plain_llf(x, lam), rel=1e-6)
        # The most likely number of two decimals.
        assert power.fit_lambdas(df, {"x": F.col("x")}, digits=2)["x"] == pytest.approx(lam, abs=0.0051)
    else:
        assert abs(lam) > 32


def test_lambda_beyond_the_range_of_doubles(spark):
    """The plain variance of these candidates overflows."""
    df = spark.createDataFrame([(float(v),) for v in (1e5, 2e5, 3e5, -1e5)], "x double")
    llf = {r["lambda"]: r.llf for r in power.lambda_grid(df, ["x"], [1.0, 90.0, -90.0]).collect()}
    assert all(np.isfinite(v) for v in llf.values()) and llf[1.0] > max(llf[90.0], llf[-90.0])
    none = spark.createDataFrame([(3.0, None), (3.0, None)], "x double, y double")
    assert power.fit_lambdas(none, {"x": F.col("x"), "y": F.col("y").cast("double")}) == {"x": 1.0, "y": 1.0}
