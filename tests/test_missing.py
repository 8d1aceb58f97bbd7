import math

import pytest
from conftest import by_key
from pyspark.sql import functions as F

from profilekit.functions.chisquare import chi2_p_value
from profilekit.operators import missing


def test_profile(small):
    rows = by_key(missing.missing_profile(small), "column")
    assert rows["social_score"]["missing_count"] == 1 and rows["social_score"]["missing_pct"] == 20.0
    assert rows["rating"]["missing_pct"] == 0.0


def test_threshold_zero_is_respected(small):
    assert missing.missing_above(small, 0).count() == 3
    assert missing.missing_above(small).count() == 0


def finite_series(x, dof):
    """P(X > x) by the sum of dof / 2 terms that holds for whole degrees of freedom."""
    half, odd = x / 2, dof % 2
    powers = [k + 0.5 * odd for k in range((dof - odd) // 2)]
    head = math.erfc(math.sqrt(half)) if odd else 0.0
    return head + math.fsum(math.exp(p * math.log(half) - half - math.lgamma(p + 1)) for p in powers)


def tails(spark, cases):
    df = spark.createDataFrame([(float(x), int(d)) for x, d in cases], "x double, d long")
    return [r[0] for r in df.select(chi2_p_value(F.col("x"), F.col("d"))).collect()]


def test_upper_tail_from_printed_tables(spark):
    # Percentage points of the chi-square distribution from printed tables.
    points = [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (37.697, 15, 0.001)]
    assert tails(spark, [p[:2] for p in points]) == pytest.approx([p[2] for p in points], rel=5e-4)


def test_upper_tail_against_the_finite_series(spark):
    cases = [(f * d, d) for d in (1, 2, 3, 4, 5, 9, 40, 101, 999, 5000, 20001) for f in (0.01, 0.5, 0.9, 0.99, 1.0, 1.02, 1.1, 2.0, 6.0)]
    for (x, d), p in zip(cases, tails(spark, cases)):
        assert p == pytest.approx(finite_series(x, d), rel=1e-7, abs=1e-13), (x, d)


def test_upper_tail_at_the_ends(spark):
    assert tails(spark, [(0.0, 4), (5.0, 0), (1e6, 3)]) == [1.0, 1.0, 0.0]
    df = spark.createDataFrame([(None, 3), (2.0, None)], "x double, d long")
    assert [r[0] for r in df.select(chi2_p_value(F.col("x"), F.col("d"))).collect()] == [None, None]


def test_ranks_by_range_partitions(spark):
    rows = [(f"g{g:04d}", v, g % 7 + 1, (g * 5 + v) % (g % 7 + 2)) for g in range(3000) for v in range(2)]
    counts = spark.createDataFrame([(g, f"v{v}", n, min(m, n)) for g, v, n, m in rows], "grp string, variable string, n long, missing long")
    ranked = missing.missing_rank(counts)
    got = sorted((r.variable, r["rank"], r.grp) for r in ranked.collect())
    want = []
    for v in ("v0", "v1"):
        order = sorted((-min(m, n) / n, g) for g, k, n, m in rows if f"v{k}" == v)
        want += [(v, i + 1, g) for i, (_, g) in enumerate(order)]
    assert got == want
    # No window over a variable: neither for ranks nor for tests.
    for df in (ranked, missing.association_test(counts), missing.elevated_missing(counts), missing.missing_overall(counts)):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def table(spark, cells):
    """Rows from ``{group: (missing, present)}``."""
    rows = [(g, None if i < m else 1.0) for g, (m, p) in cells.items() for i in range(m + p)]
    return spark.createDataFrame(rows, "grp string, x double")


def test_two_by_two_has_continuity_correction(spark):
    df = table(spark, {"a": (10, 20), "b": (25, 15)})
    row = missing.association_test(missing.group_counts(df, "grp", ["x"])).first()
    n, ad_bc = 70, abs(10 * 15 - 20 * 25)
    yates = n * (ad_bc - n / 2) ** 2 / (30 * 40 * 35 * 35)
    assert row.chi2 == pytest.approx(yates) and row.dof == 1
    assert row.p_value == pytest.approx(math.erfc(math.sqrt(yates / 2)))


def test_untestable_columns_are_left_out(spark):
    df = table(spark, {"a": (0, 5), "b": (0, 5)})
    counts = missing.group_counts(df, "grp", ["x"])
    assert missing.association_test(counts).count() == 0
    overall = missing.missing_overall(counts).first()
    assert (overall.total_elevated, overall.combined_chi2) == (0, 0.0)
    assert [tuple(r) for r in missing.elevated_counts(counts).collect()] == [("a", 0), ("b", 0)]


def test_null_group_counts_only_for_the_overall_rate(spark):
    df = table(spark, {"a": (30, 10), "b": (5, 35), None: (0, 20)})
    counts = missing.group_counts(df, "grp", ["x"])
    assert missing.contingency(counts).count() == 2
    row = missing.elevated_missing(counts).first()
    assert row.grp == "a" and row.group_rate == 0.75 and row.overall_rate == 0.35
    assert [(r.grp, r["rank"]) for r in missing.missing_rank(counts).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_sample_with_planted_association(companies):
    counts = missing.group_counts(companies, "gics_sector", ["environmental_score", "social_score", "market_cap"])
    tests = by_key(missing.association_test(counts), "variable")
    assert "market_cap" not in tests
    assert tests["environmental_score"]["significant"] and tests["environmental_score"]["dof"] == 10
    assert missing.elevated_missing(counts).first().grp == "group 1"
    matrix = missing.missing_by_group_matrix(counts, ["environmental_score", "social_score"])
    assert matrix.count() == 11 and matrix.columns == ["grp", "environmental_score", "social_score"]
