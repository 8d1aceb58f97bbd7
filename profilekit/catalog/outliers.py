"""Outlier detection and treatment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilekit.catalog.registry import cte, planted, query, rd, rounded, table, union_all
from profilekit.operators import outliers as out
from profilekit.operators import profile, schema, treat
from profilekit.operators.impute import FillMissing
from profilekit.operators.moments import moments_table
from profilekit.operators.quantiles import grouped_quantiles, to_long
from profilekit.operators.scale import Scale
from profilekit.plans.analysis import analyse_outliers

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
IDS = ["l_orderkey", "l_linenumber"]


def iqr_bounds_sql(source: str, columns: list[str], k: float = 1.5) -> str:
    """``(variable, q1, q3, lo, hi)`` rows."""
    parts = [
        f"SELECT '{c}' AS variable, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}"
        for c in columns
    ]
    return f"SELECT variable, q1, q3, q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi FROM ({union_all(parts)})"


def fences(source: str, column: str, k: float = 1.5) -> str:
    return (
        f"SELECT quantile_cont({column}, 0.25) - {k} * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) AS lo, "
        f"quantile_cont({column}, 0.75) + {k} * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) AS hi "
        f"FROM {source}"
    )


def moments(source: str, column: str) -> str:
    return f"SELECT avg({column}) AS mu, stddev_pop({column}) AS sd FROM {source}"


@query(
    "iqr_bounds",
    f"SELECT variable, {rd('q1')} AS q1, {rd('q3')} AS q3, {rd('q3 - q1')} AS iqr, {rd('lo')} AS lower_bound, "
    f"{rd('hi')} AS upper_bound FROM ({iqr_bounds_sql('lineitem', LINE)})",
)
def iqr_bounds(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded(out.IqrDetector(LINE).fit(lines).bounds_table(spark))


@query(
    "iqr_flags",
    f"""WITH b AS ({fences('events', 'value')})
    SELECT event_id, CASE WHEN value < lo OR value > hi THEN 1 ELSE 0 END AS iqr_out_value FROM events, b""",
)
def iqr_flags(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return out.IqrDetector(["value"]).fit_transform(events).drop("value")


@query(
    "iqr_counts",
    union_all(
        [
            f"""SELECT 'IQR' AS method, '{c}' AS variable,
            count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers,
            count(*) FILTER (WHERE {c} < lo) AS lower, count(*) FILTER (WHERE {c} > hi) AS upper
            FROM lineitem, ({fences('lineitem', c)})"""
            for c in LINE
        ]
    ),
)
def iqr_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE)
    return out.IqrDetector(LINE).fit(lines).counts(lines)


@query(
    "iqr_flags_multiplier",
    f"""WITH b AS ({fences('customer', 'c_acctbal', 0.25)})
    SELECT c_custkey, CASE WHEN c_acctbal < lo OR c_acctbal > hi THEN 1 ELSE 0 END AS iqr_out_c_acctbal FROM customer, b""",
)
def iqr_flags_multiplier(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return out.IqrDetector(["c_acctbal"], multiplier=0.25).fit_transform(customers).drop("c_acctbal")


@query(
    "zscore_parameters",
    f"WITH {cte('ev')} "
    + union_all(
        [
            f"""SELECT '{c}' AS variable, count({c}) AS count, {rd(f'avg({c})')} AS mean, {rd(f'stddev_pop({c})')} AS std_pop,
            {rd(f'stddev_samp({c})')} AS std_samp, {rd(f'min({c})::DOUBLE')} AS minimum, {rd(f'max({c})::DOUBLE')} AS maximum FROM ev"""
            for c in ("value", "user_no", "score")
        ]
    ),
)
def zscore_parameters(spark, sf_dir):
    columns = ["value", "user_no", "score"]
    return rounded(moments_table(planted(spark, sf_dir, "ev"), {c: F.col(c) for c in columns}))


@query(
    "zscore_flags",
    f"""WITH {cte('ev')}, v AS ({moments('ev', 'value')}), s AS (SELECT avg(score) AS smu, stddev_pop(score) AS ssd FROM ev)
    SELECT event_id, CASE WHEN abs((value - mu) / sd) > 3 THEN 1 ELSE 0 END AS zscore_out_value,
    CASE WHEN abs((score - smu) / ssd) > 3 THEN 1 ELSE 0 END AS zscore_out_score FROM ev, v, s""",
)
def zscore_flags(spark, sf_dir):
    events = planted(spark, sf_dir, "ev").select("event_id", "value", "score")
    return out.ZScoreDetector(["value", "score"]).fit_transform(events).drop("value", "score")


@query(
    "zscore_counts",
    union_all(
        [
            f"""SELECT 'Z-Score' AS method, '{c}' AS variable,
            count(*) FILTER (WHERE abs(({c} - mu) / sd) > 1.5) AS outliers,
            count(*) FILTER (WHERE ({c} - mu) / sd < -1.5) AS lower,
            count(*) FILTER (WHERE ({c} - mu) / sd > 1.5) AS upper
            FROM {t}, ({moments(t, c)})"""
            for t, c in [("orders", "o_totalprice")]
        ]
    ),
)
def zscore_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_totalprice")
    return out.ZScoreDetector(["o_totalprice"], threshold=1.5).fit(orders).counts(orders)


@query(
    "outlier_tails",
    f"""WITH {cte('ev')}, v AS ({fences('ev', 'value')}), s AS ({fences('ev', 'score')})
    SELECT event_id, 'value' AS variable, value, CASE WHEN value < lo THEN 'lower' ELSE 'upper' END AS tail
    FROM ev, v WHERE value < lo OR value > hi
    UNION ALL
    SELECT event_id, 'score', {rd('score')}, CASE WHEN score < lo THEN 'lower' ELSE 'upper' END
    FROM ev, s WHERE score < lo OR score > hi""",
)
def outlier_tails(spark, sf_dir):
    events = planted(spark, sf_dir, "ev").select("event_id", "value", "score")
    return rounded(out.IqrDetector(["value", "score"]).fit(events).tails(events, "event_id"))


# Flags of both methods on two event columns, used by several queries below.
FLAGS_CTE = f"""{cte('ev')},
iv AS ({fences('ev', 'value')}), isc AS ({fences('ev', 'score')}),
zv AS ({moments('ev', 'value')}), zs AS (SELECT avg(score) AS smu, stddev_pop(score) AS ssd FROM ev),
flags AS (SELECT event_id, value, score,
  CASE WHEN value < iv.lo OR value > iv.hi THEN 1 ELSE 0 END AS iqr_value,
  CASE WHEN score < isc.lo OR score > isc.hi THEN 1 ELSE 0 END AS iqr_score,
  CASE WHEN abs((value - mu) / sd) > 3 THEN 1 ELSE 0 END AS z_value,
  CASE WHEN abs((score - smu) / ssd) > 3 THEN 1 ELSE 0 END AS z_score
  FROM ev, iv, isc, zv, zs)"""


def flagged(spark, sf_dir):
    events = planted(spark, sf_dir, "ev").select("event_id", "value", "score")
    result = analyse_outliers(events, "event_id", add_forest=False)
    return result.flagged, result


SUMMARY_SQL = union_all(
    [
        f"SELECT '{c}' AS \"column\", '{m}' AS method, sum({p}_{c})::BIGINT AS outlier_count, "
        f"{rd(f'sum({p}_{c}) * 100.0 / count(*)')} AS outlier_pct FROM flags"
        for m, p in [("IQR", "iqr"), ("Z-Score", "z")]
        for c in ("value", "score")
    ]
)


@query("outlier_summary", f"WITH {FLAGS_CTE} {SUMMARY_SQL}")
def outlier_summary(spark, sf_dir):
    return rounded(out.outlier_summary(flagged(spark, sf_dir)[0]))


@query(
    "method_comparison",
    f"WITH {FLAGS_CTE} "
    + union_all(
        [
            f"SELECT '{c}' AS variable, sum(iqr_{c})::BIGINT AS iqr_outliers, sum(z_{c})::BIGINT AS zscore_outliers FROM flags"
            for c in ("value", "score")
        ]
    ),
)
def method_comparison(spark, sf_dir):
    return out.method_comparison(flagged(spark, sf_dir)[0])


@query(
    "outlier_report_top",
    f"""WITH {FLAGS_CTE}, counts AS ({union_all([
        f'''SELECT '{m}' AS method, '{c}' AS variable, sum({p}_{c})::BIGINT AS outliers,
        count(*) FILTER (WHERE {p}_{c} = 1 AND {c} < {mid}) AS lower,
        count(*) FILTER (WHERE {p}_{c} = 1 AND {c} > {mid}) AS upper FROM flags, zv, zs'''
        for m, p in [("IQR", "iqr"), ("Z-Score", "z")]
        for c, mid in [("value", "mu"), ("score", "smu")]
    ])})
    SELECT method, 'total' AS variable, sum(outliers)::BIGINT AS outliers, sum(lower)::BIGINT AS lower,
    sum(upper)::BIGINT AS upper FROM counts GROUP BY method
    UNION ALL
    SELECT method, variable, outliers, lower, upper FROM counts
    QUALIFY row_number() OVER (PARTITION BY method ORDER BY outliers DESC, variable) <= 10""",
)
def outlier_report_top(spark, sf_dir):
    return out.outlier_report(flagged(spark, sf_dir)[1].counts)


@query("exclusive_outliers", f"WITH {FLAGS_CTE} SELECT event_id FROM flags WHERE iqr_value = 1 AND z_value = 0")
def exclusive_outliers(spark, sf_dir):
    df = flagged(spark, sf_dir)[0]
    by_iqr = out.flagged_keys(df, "event_id", F.col("iqr_out_value") == 1)
    by_z = out.flagged_keys(df, "event_id", F.col("zscore_out_value") == 1)
    return out.exclusive_keys(by_iqr, by_z, "event_id")


@query(
    "union_outliers",
    f"WITH {FLAGS_CTE} SELECT DISTINCT event_id FROM flags WHERE iqr_value = 1 OR iqr_score = 1 OR z_value = 1 OR z_score = 1",
)
def union_outliers(spark, sf_dir):
    df = flagged(spark, sf_dir)[0]
    by_iqr = out.flagged_keys(df, "event_id", out.any_flag(df, "iqr_out_"))
    by_z = out.flagged_keys(df, "event_id", out.any_flag(df, "zscore_out_"))
    return out.union_keys(by_iqr, by_z, "event_id")


@query(
    "flagged_rows_detail",
    f"WITH {FLAGS_CTE} SELECT e.event_id, e.user_id, e.event_type, e.value FROM events e "
    "SEMI JOIN (SELECT event_id FROM flags WHERE z_value = 1) f ON e.event_id = f.event_id",
)
def flagged_rows_detail(spark, sf_dir):
    keys = out.flagged_keys(flagged(spark, sf_dir)[0], "event_id", F.col("zscore_out_value") == 1)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return out.rows_of_keys(events, keys, "event_id")


def iqr_flagged_events(spark, sf_dir):
    events = planted(spark, sf_dir, "ev").select("event_id", "value", "score")
    return out.IqrDetector(["value", "score"]).fit_transform(events)


@query("flagged_filter", f"WITH {FLAGS_CTE} SELECT event_id, value FROM flags WHERE iqr_value = 1")
def flagged_filter(spark, sf_dir):
    return schema.flagged_rows(flagged(spark, sf_dir)[0], "iqr_out_value").select("event_id", "value")


@query(
    "trimmed_stats",
    f"""WITH {FLAGS_CTE} SELECT {rd('avg(value)')} AS mean, {rd('quantile_cont(value, 0.5)')} AS median,
    {rd('quantile_cont(value, 0.05)')} AS p05, {rd('quantile_cont(value, 0.95)')} AS p95 FROM flags WHERE iqr_value = 0""",
)
def trimmed_stats(spark, sf_dir):
    return rounded(treat.trimmed_statistics(iqr_flagged_events(spark, sf_dir), "iqr_out_", ["value"]).drop("variable"))


def replaced(statistic: str) -> str:
    fill = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)"}[statistic]
    v, s = fill.format(c="value"), fill.format(c="score")
    return f"""WITH {FLAGS_CTE},
    fv AS (SELECT {v} AS fv FROM flags WHERE iqr_value = 0), fs AS (SELECT {s} AS fs FROM flags WHERE iqr_score = 0)
    SELECT event_id, {rd('CASE WHEN iqr_value = 1 THEN fv ELSE value END')} AS processed_value,
    {rd('CASE WHEN iqr_score = 1 THEN fs ELSE score END')} AS processed_score FROM flags, fv, fs"""


@query("treat_mean", replaced("mean"))
def treat_mean(spark, sf_dir):
    treated = treat.treat_outliers(iqr_flagged_events(spark, sf_dir), "mean")
    return rounded(treated.select("event_id", "processed_value", "processed_score"))


@query("treat_median", replaced("median"))
def treat_median(spark, sf_dir):
    treated = treat.treat_outliers(iqr_flagged_events(spark, sf_dir), "median")
    return rounded(treated.select("event_id", "processed_value", "processed_score"))


@query(
    "treat_trim",
    f"WITH {FLAGS_CTE} SELECT event_id, value, {rd('score')} AS score FROM flags WHERE iqr_value + iqr_score = 0",
)
def treat_trim(spark, sf_dir):
    trimmed = treat.treat_outliers(iqr_flagged_events(spark, sf_dir), "trim")
    return rounded(trimmed.select("event_id", "value", "score"))


@query(
    "trim_report",
    f"""WITH {FLAGS_CTE} SELECT count(*) AS "rows", count(*) FILTER (WHERE iqr_value + iqr_score > 0) AS removed,
    {rd('count(*) FILTER (WHERE iqr_value + iqr_score > 0) * 100.0 / count(*)')} AS removed_pct FROM flags""",
)
def trim_report(spark, sf_dir):
    return rounded(treat.trim_report(iqr_flagged_events(spark, sf_dir), "iqr_out_"))


@query(
    "winsorize_flagged",
    f"""WITH {FLAGS_CTE}, q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi
    FROM flags WHERE iqr_value = 0)
    SELECT event_id, {rd('CASE WHEN iqr_value = 1 AND value IS NOT NULL THEN least(greatest(value, lo), hi) ELSE value END')}
    AS winsorized_value FROM flags, q""",
)
def winsorize_flagged(spark, sf_dir):
    treated = treat.Winsorize("iqr_out_", ["value"]).fit_transform(iqr_flagged_events(spark, sf_dir))
    return rounded(treated.select("event_id", "winsorized_value"))


@query(
    "winsorize_all",
    f"""WITH {cte('ev')}, q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM ev)
    SELECT event_id, {rd('CASE WHEN value IS NOT NULL THEN least(greatest(value, lo), hi) END')} AS winsorized_value
    FROM ev, q""",
)
def winsorize_all(spark, sf_dir):
    events = planted(spark, sf_dir, "ev").select("event_id", "value")
    return rounded(treat.Winsorize(columns=["value"]).fit_transform(events).drop("value"))


@query(
    "impute_iqr_outliers",
    f"""WITH {cte('sp')}, s AS ({fences('sp', 'p_size')}), r AS ({fences('sp', 'p_retailprice')}),
    m AS (SELECT trunc(avg(p_size))::BIGINT AS ms, avg(p_retailprice) AS mr FROM sp)
    SELECT p_partkey, CASE WHEN p_size < s.lo OR p_size > s.hi THEN ms ELSE p_size END AS iqr_mod_p_size,
    {rd('CASE WHEN p_retailprice < r.lo OR p_retailprice > r.hi THEN mr ELSE p_retailprice END')} AS iqr_mod_p_retailprice
    FROM sp, s, r, m""",
)
def impute_iqr_outliers(spark, sf_dir):
    parts = planted(spark, sf_dir, "sp")
    columns = ["p_size", "p_retailprice"]
    flags = out.IqrDetector(columns).fit_transform(parts)
    treated = treat.MeanOfAllCells("iqr_out_", output_prefix="iqr_mod_", columns=columns).fit_transform(flags)
    return rounded(treated.select("p_partkey", "iqr_mod_p_size", "iqr_mod_p_retailprice"))


@query(
    "impute_z_outliers",
    f"""WITH {cte('ev')}, z AS ({moments('ev', 'value')})
    SELECT event_id, {rd('CASE WHEN abs((value - mu) / sd) > 3 THEN mu ELSE value END')} AS z_mod_value FROM ev, z""",
)
def impute_z_outliers(spark, sf_dir):
    events = planted(spark, sf_dir, "ev").select("event_id", "value")
    flags = out.ZScoreDetector(["value"]).fit_transform(events)
    treated = treat.MeanOfAllCells("zscore_out_", output_prefix="z_mod_", columns=["value"]).fit_transform(flags)
    return rounded(treated.select("event_id", "z_mod_value"))


@query(
    "flagged_non_null_counts",
    f"WITH {FLAGS_CTE} "
    + union_all(
        [f"SELECT '{c}' AS variable, count({c}) AS outliers FROM flags WHERE z_value = 1" for c in ("value", "score")]
    ),
)
def flagged_non_null_counts(spark, sf_dir):
    return profile.flagged_non_null_counts(flagged(spark, sf_dir)[0], "zscore_out_value", ["value", "score"])


def box_sql(source: str, name: str, column: str) -> str:
    return f"""SELECT '{name}' AS variable, n AS count, {rd('q1')} AS q1, {rd('md')} AS median, {rd('q3')} AS q3,
    {rd('wl')} AS whisker_low, {rd('wh')} AS whisker_high, fliers,
    {rd('md - 1.57 * (q3 - q1) / sqrt(n)')} AS notch_low, {rd('md + 1.57 * (q3 - q1) / sqrt(n)')} AS notch_high
    FROM (SELECT count({column}) AS n, any_value(q1) AS q1, any_value(md) AS md, any_value(q3) AS q3,
      min({column}) FILTER (WHERE {column} >= q1 - 1.5 * (q3 - q1)) AS wl,
      max({column}) FILTER (WHERE {column} <= q3 + 1.5 * (q3 - q1)) AS wh,
      count(*) FILTER (WHERE {column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS fliers
      FROM {source}, (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS md,
      quantile_cont({column}, 0.75) AS q3 FROM {source}))"""


@query("box_stats", f"WITH {cte('ev')} {union_all([box_sql('ev', c, c) for c in ('value', 'score')])}")
def box_stats(spark, sf_dir):
    return rounded(profile.box_stats(planted(spark, sf_dir, "ev"), ["value", "score"]))


@query(
    "box_stats_before_after",
    f"""WITH {cte('ev')}, z AS ({moments('ev', 'value')}),
    t AS (SELECT value, CASE WHEN abs((value - mu) / sd) > 3 THEN mu ELSE value END AS z_mod_value FROM ev, z)
    {union_all([box_sql('t', c, c) for c in ('value', 'z_mod_value')])}""",
)
def box_stats_before_after(spark, sf_dir):
    events = planted(spark, sf_dir, "ev").select("event_id", "value")
    flags = out.ZScoreDetector(["value"]).fit_transform(events)
    treated = treat.MeanOfAllCells("zscore_out_", output_prefix="z_mod_", columns=["value"]).fit_transform(flags)
    return rounded(profile.box_stats(treated, ["value", "z_mod_value"]))


QUARTILES = [0.25, 0.5, 0.75]


def quartiles_sql(source: str, keys: str, column: str) -> str:
    found = ", ".join(f"{rd(f'quantile_cont({column}, {p})', 4)} AS q{i}" for i, p in enumerate(QUARTILES, 1))
    return f"SELECT {keys}, {found} FROM {source}"


def _quartile_columns(quantiles):
    return [quantiles[i].alias(f"q{i + 1}") for i in range(len(QUARTILES))]


@query(
    "quantiles_selected",
    union_all([quartiles_sql("lineitem", f"'{c}' AS variable", c) for c in ("l_extendedprice", "l_quantity")]),
)
def quantiles_selected(spark, sf_dir):
    """Quartiles by selection in several levels, which is how a large table is solved."""
    lines = table(spark, sf_dir, "lineitem")
    long = to_long(lines, {c: F.col(c) for c in ("l_extendedprice", "l_quantity")})
    found = grouped_quantiles(long, ["variable"], QUARTILES, direct_rows=200)
    return rounded(found.select("variable", *_quartile_columns(F.col("quantiles"))), 4)


@query(
    "quantiles_selected_by_group",
    f"{quartiles_sql('events', 'event_type', 'value')} WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type",
)
def quantiles_selected_by_group(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type IS NOT NULL").select("event_type", "value")
    found = grouped_quantiles(events, ["event_type"], QUARTILES, direct_rows=200)
    return rounded(found.select("event_type", *_quartile_columns(F.col("quantiles"))), 4)


NAN_EVENTS = "CASE WHEN event_id % 41 = 3 THEN CAST('NaN' AS DOUBLE) ELSE value END"
NULL_EVENTS = "WITH e AS (SELECT event_id, CASE WHEN event_id % 41 = 3 THEN NULL ELSE value END AS value FROM events)"


def _with_nan(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{NAN_EVENTS} AS value")


@query(
    "zscore_flags_nan",
    f"""{NULL_EVENTS} SELECT event_id, CASE WHEN abs((value - mu) / sd) > 3 THEN 1 ELSE 0 END AS zscore_out_value
    FROM e, ({moments('e', 'value')})""",
)
def zscore_flags_nan(spark, sf_dir):
    """NaN counts as missing: it neither moves the statistics nor is it flagged."""
    return out.ZScoreDetector(["value"]).fit_transform(_with_nan(spark, sf_dir)).drop("value")


@query(
    "iqr_flags_nan",
    f"""{NULL_EVENTS} SELECT event_id, CASE WHEN value < lo OR value > hi THEN 1 ELSE 0 END AS iqr_out_value
    FROM e, ({fences('e', 'value')})""",
)
def iqr_flags_nan(spark, sf_dir):
    return out.IqrDetector(["value"]).fit_transform(_with_nan(spark, sf_dir)).drop("value")


@query("scale_standard_nan", f"{NULL_EVENTS} SELECT event_id, {rd('(value - mu) / sd')} AS value FROM e, ({moments('e', 'value')})")
def scale_standard_nan(spark, sf_dir):
    return rounded(Scale("standard", ["value"]).fit_transform(_with_nan(spark, sf_dir)))


@query("fill_global_mean_nan", f"{NULL_EVENTS} SELECT event_id, {rd('coalesce(value, (SELECT avg(value) FROM e))')} AS value FROM e")
def fill_global_mean_nan(spark, sf_dir):
    return rounded(FillMissing("global_mean", columns=["value"]).fit_transform(_with_nan(spark, sf_dir)))
