"""Missing-value profile, association and imputation queries."""

from __future__ import annotations

from profilekit.catalog.registry import PLANTED, cte, planted, query, rd, rounded, table, union_all
from profilekit.operators import impute, missing, schema

EV = ["value", "user_no", "score"]


def profile_sql(view: str, columns) -> str:
    return union_all(
        [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, count(*) AS n FROM {view}" for c in columns]
    )


def counts_cte(view: str, columns) -> str:
    parts = [
        f"SELECT grp, '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS missing FROM {view} GROUP BY grp"
        for c in columns
    ]
    return f"{cte(view)}, counts AS ({union_all(parts)})"


def test_cte(p_value: str) -> str:
    """The test of every variable; two groups get the continuity correction."""

    def term(observed: str, total: str) -> str:
        expected = f"((missing + present) * {total} / (tm + tp))"
        distance = f"abs({observed} - {expected})"
        return f"CASE dof WHEN 1 THEN greatest({distance} - 0.5, 0) ELSE {distance} END ** 2 / {expected}"

    return f"""ct AS (SELECT grp, variable, n - missing AS present, missing FROM counts WHERE grp IS NOT NULL),
tot AS (SELECT variable, sum(missing) AS tm, sum(present) AS tp, count(*) - 1 AS dof FROM ct GROUP BY variable),
stat AS (SELECT variable, dof, sum({term('missing', 'tm')} + {term('present', 'tp')}) AS chi2
  FROM ct JOIN tot USING (variable) WHERE tm > 0 AND tp > 0 GROUP BY variable, dof),
test AS (SELECT variable, dof::BIGINT AS dof, chi2, {p_value} AS p_value FROM stat),
ov AS (SELECT variable, sum(missing) / sum(n) AS overall_rate FROM counts GROUP BY variable),
rated AS (SELECT c.grp, c.variable, missing / n AS group_rate, overall_rate, missing / n - overall_rate AS difference,
  chi2, p_value, coalesce(p_value < 0.05 AND missing / n - overall_rate > 0.05, false) AS elevated
  FROM counts c JOIN ov USING (variable) LEFT JOIN test USING (variable) WHERE c.grp IS NOT NULL)"""


# With five named groups there are four degrees of freedom, where the tail
# probability of the test has a closed form.
TEST_CTE = test_cte("exp(-chi2 / 2) * (1 + chi2 / 2)")
# For any degrees of freedom: one minus the power series of the incomplete gamma function.
ANY_TEST_CTE = test_cte(
    "1 - list_sum(list_transform(range(0, 12000), lambda k: "
    "exp((dof / 2 + k) * ln(greatest(chi2, 1e-300) / 2) - chi2 / 2 - lgamma(dof / 2 + k + 1))))"
)


def ev_counts(spark, sf_dir):
    return missing.group_counts(planted(spark, sf_dir, "ev"), "grp", EV)


@query(
    "missing_profile",
    f"""WITH {cte('ev')} SELECT "column", missing_count, {rd('missing_count * 100.0 / n')} AS missing_pct
    FROM ({profile_sql('ev', PLANTED['ev'][1])})""",
)
def missing_profile(spark, sf_dir):
    return rounded(missing.missing_profile(planted(spark, sf_dir, "ev")))


@query(
    "missing_top",
    f"""WITH {cte('pt')} SELECT "column", missing_count, {rd('missing_count * 100.0 / n')} AS missing_pct
    FROM ({profile_sql('pt', PLANTED['pt'][1])}) ORDER BY missing_count DESC, "column" LIMIT 3""",
)
def missing_top(spark, sf_dir):
    return rounded(missing.missing_top(planted(spark, sf_dir, "pt"), k=3))


@query(
    "missing_threshold",
    f"""WITH {cte('ev')} SELECT "column", {rd('missing_count / n')} AS missing_fraction
    FROM ({profile_sql('ev', PLANTED['ev'][1])}) WHERE missing_count / n > 0.1""",
)
def missing_threshold(spark, sf_dir):
    return rounded(missing.missing_above(planted(spark, sf_dir, "ev"), 0.1))


@query(
    "missing_indicator",
    f"WITH {cte('ev')} SELECT event_id, {', '.join(f'({c} IS NULL)::INTEGER AS {c}' for c in EV)} FROM ev",
)
def missing_indicator(spark, sf_dir):
    return missing.missing_indicator(planted(spark, sf_dir, "ev"), EV, "event_id")


@query(
    "missing_by_group",
    f"WITH {counts_cte('ev', EV)} SELECT grp, variable, {rd('missing * 100.0 / n')} AS missing_pct FROM counts "
    "WHERE grp IS NOT NULL",
)
def missing_by_group(spark, sf_dir):
    return rounded(missing.missing_by_group(ev_counts(spark, sf_dir)))


@query(
    "missing_by_group_categorical",
    f"WITH {counts_cte('pt', ['p_type', 'p_size', 'p_retailprice'])} "
    f"SELECT grp, variable, {rd('missing * 100.0 / n')} AS missing_pct FROM counts WHERE grp IS NOT NULL",
)
def missing_by_group_categorical(spark, sf_dir):
    parts = planted(spark, sf_dir, "pt")
    return rounded(missing.missing_by_group(missing.group_counts(parts, "grp", ["p_type", "p_size", "p_retailprice"])))


@query(
    "missing_matrix",
    f"""WITH {counts_cte('ev', EV)} SELECT grp, {', '.join(
        rd(f"max(missing * 100.0 / n) FILTER (WHERE variable = '{c}')") + f' AS {c}' for c in EV
    )} FROM counts WHERE grp IS NOT NULL GROUP BY grp""",
)
def missing_matrix(spark, sf_dir):
    return rounded(missing.missing_by_group_matrix(ev_counts(spark, sf_dir), EV))


@query(
    "missing_contingency",
    f"WITH {counts_cte('ev', EV)} SELECT grp, variable, n - missing AS present, missing FROM counts WHERE grp IS NOT NULL",
)
def missing_contingency(spark, sf_dir):
    return missing.contingency(ev_counts(spark, sf_dir))


@query(
    "missing_chi2",
    f"WITH {counts_cte('ev', EV)}, {TEST_CTE} SELECT variable, {rd('chi2')} AS chi2, dof, {rd('p_value')} AS p_value, "
    "p_value < 0.05 AS significant FROM test",
)
def missing_chi2(spark, sf_dir):
    return rounded(missing.association_test(ev_counts(spark, sf_dir)))


@query(
    "missing_chi2_customers",
    f"WITH {counts_cte('cu', ['c_acctbal'])}, {TEST_CTE} SELECT variable, {rd('chi2')} AS chi2, dof, "
    f"{rd('p_value')} AS p_value, p_value < 0.05 AS significant FROM test",
)
def missing_chi2_customers(spark, sf_dir):
    customers = planted(spark, sf_dir, "cu")
    return rounded(missing.association_test(missing.group_counts(customers, "grp", ["c_acctbal"])))


@query(
    "elevated_missing",
    f"WITH {counts_cte('ev', EV)}, {TEST_CTE} SELECT grp, variable, {rd('group_rate')} AS group_rate, "
    f"{rd('overall_rate')} AS overall_rate, {rd('difference')} AS difference, {rd('chi2')} AS chi2, "
    f"{rd('p_value')} AS p_value FROM rated WHERE elevated",
)
def elevated_missing(spark, sf_dir):
    return rounded(missing.elevated_missing(ev_counts(spark, sf_dir)))


@query(
    "elevated_missing_counts",
    f"WITH {counts_cte('ev', EV)}, {TEST_CTE} SELECT grp, count(*) FILTER (WHERE elevated) AS elevated_variables "
    "FROM rated GROUP BY grp",
)
def elevated_missing_counts(spark, sf_dir):
    return missing.elevated_counts(ev_counts(spark, sf_dir))


@query(
    "missing_overall",
    f"WITH {counts_cte('ev', EV)}, {TEST_CTE} SELECT (SELECT count(*) FROM rated WHERE elevated) AS total_elevated, "
    f"(SELECT {rd('sum(chi2)')} FROM test) AS combined_chi2",
)
def missing_overall(spark, sf_dir):
    return rounded(missing.missing_overall(ev_counts(spark, sf_dir)))


LINES = ["l_quantity", "l_discount", "l_tax"]


def test_query(name: str, view: str) -> None:
    """The test by another group column than that of the events."""

    @query(
        name,
        f"WITH {counts_cte(view, LINES)}, {ANY_TEST_CTE} SELECT variable, {rd('chi2')} AS chi2, dof, "
        f"{rd('p_value')} AS p_value, p_value < 0.05 AS significant FROM test",
    )
    def run(spark, sf_dir):
        return rounded(missing.association_test(missing.group_counts(planted(spark, sf_dir, view), "grp", LINES)))


test_query("missing_chi2_two_groups", "ls")  # one degree of freedom
test_query("missing_chi2_four_groups", "lq")  # three
test_query("missing_chi2_orders", "li")  # a group for each order


@query(
    "elevated_missing_four_groups",
    f"WITH {counts_cte('lq', LINES)}, {ANY_TEST_CTE} SELECT grp, count(*) FILTER (WHERE elevated) AS elevated_variables "
    "FROM rated GROUP BY grp",
)
def elevated_missing_four_groups(spark, sf_dir):
    return missing.elevated_counts(missing.group_counts(planted(spark, sf_dir, "lq"), "grp", LINES))


RANK_SQL = """ranked AS (SELECT variable, grp, missing / n AS group_rate,
row_number() OVER (PARTITION BY variable ORDER BY missing / n DESC, grp)::INTEGER AS "rank" FROM counts WHERE grp IS NOT NULL)"""


@query(
    "missing_rank",
    f"WITH {counts_cte('ev', EV)}, {RANK_SQL} SELECT variable, grp, {rd('group_rate')} AS group_rate, \"rank\" FROM ranked",
)
def missing_rank(spark, sf_dir):
    return rounded(missing.missing_rank(ev_counts(spark, sf_dir)))


@query(
    "missing_avg_rank",
    f"WITH {counts_cte('ev', EV)}, {RANK_SQL} SELECT grp, {rd('avg(\"rank\")')} AS avg_rank FROM ranked GROUP BY grp",
)
def missing_avg_rank(spark, sf_dir):
    return rounded(missing.missing_average_rank(ev_counts(spark, sf_dir)))


@query(
    "missing_rank_orders",
    f"WITH {counts_cte('li', LINES)}, {RANK_SQL} SELECT variable, grp, {rd('group_rate')} AS group_rate, \"rank\" FROM ranked",
)
def missing_rank_orders(spark, sf_dir):
    return rounded(missing.missing_rank(missing.group_counts(planted(spark, sf_dir, "li"), "grp", LINES)))


@query(
    "missing_avg_rank_orders",
    f"WITH {counts_cte('li', LINES)}, {RANK_SQL} SELECT grp, {rd('avg(\"rank\")')} AS avg_rank FROM ranked GROUP BY grp",
)
def missing_avg_rank_orders(spark, sf_dir):
    return rounded(missing.missing_average_rank(missing.group_counts(planted(spark, sf_dir, "li"), "grp", LINES)))


@query("complete_cases", f"WITH {cte('ev')} SELECT event_id, value FROM ev WHERE value IS NOT NULL")
def complete_cases(spark, sf_dir):
    return schema.complete_cases(planted(spark, sf_dir, "ev").select("event_id", "value"), "value")


# --- imputation -------------------------------------------------------------


@query(
    "fill_global_mean",
    f"""WITH {cte('ev')}, m AS (SELECT avg(value) AS mv, round_even(avg(user_no), 0)::BIGINT AS mu FROM ev)
    SELECT event_id, grp, {rd('coalesce(value, mv)')} AS value, coalesce(user_no, mu) AS user_no FROM ev, m""",
)
def fill_global_mean(spark, sf_dir):
    events = planted(spark, sf_dir, "ev").select("event_id", "grp", "value", "user_no")
    return rounded(impute.FillMissing("global_mean").fit_transform(events))


def group_fill_sql(view: str, key: str, statistic: str, doubles, wholes) -> str:
    def stat(c):
        return f"avg({c})" if statistic == "mean" else f"quantile_cont({c}, 0.5)"

    columns = [*doubles, *wholes]
    per_group = ", ".join(f"{stat(c)} AS g_{c}" for c in columns)
    overall = ", ".join(f"{stat(c)} AS o_{c}" for c in columns)
    picked = [f"{rd(f'coalesce({c}, g_{c}, o_{c})')} AS {c}" for c in doubles]
    picked += [f"coalesce({c}, round_even(coalesce(g_{c}, o_{c}), 0)::BIGINT) AS {c}" for c in wholes]
    return f"""WITH {cte(view)},
    g AS (SELECT grp AS gg, {per_group} FROM {view} WHERE grp IS NOT NULL GROUP BY grp),
    o AS (SELECT {overall} FROM {view})
    SELECT {key}, grp, {', '.join(picked)} FROM {view} LEFT JOIN g ON grp = gg, o"""


@query("fill_group_mean", group_fill_sql("ev", "event_id", "mean", ["value", "score"], ["user_no"]))
def fill_group_mean(spark, sf_dir):
    events = planted(spark, sf_dir, "ev")
    return rounded(impute.FillMissing("group_mean", "grp").fit_transform(events))


@query("fill_group_median", group_fill_sql("ev", "event_id", "median", ["value", "score"], ["user_no"]))
def fill_group_median(spark, sf_dir):
    events = planted(spark, sf_dir, "ev")
    return rounded(impute.FillMissing("group_median", "grp").fit_transform(events))


@query("fill_int_rounding", group_fill_sql("pt", "p_partkey", "median", [], ["p_size"]))
def fill_int_rounding(spark, sf_dir):
    parts = planted(spark, sf_dir, "pt").select("p_partkey", "grp", "p_size")
    return impute.FillMissing("group_median", "grp").fit_transform(parts)


@query(
    "fill_null_group",
    f"""WITH {cte('pt')}, g AS (SELECT grp AS gg, avg(p_retailprice) AS gm FROM pt WHERE grp IS NOT NULL GROUP BY grp),
    o AS (SELECT avg(p_retailprice) AS om FROM pt)
    SELECT p_partkey, {rd('coalesce(p_retailprice, gm, om)')} AS p_retailprice
    FROM pt LEFT JOIN g ON grp = gg, o""",
)
def fill_null_group(spark, sf_dir):
    parts = planted(spark, sf_dir, "pt").select("p_partkey", "grp", "p_retailprice")
    filled = impute.FillMissing("group_mean", "grp").fit_transform(parts)
    return rounded(filled.drop("grp"))


@query(
    "fill_column_median",
    f"""WITH {cte('ev')}, m AS (SELECT quantile_cont(value, 0.5) AS mv FROM ev)
    SELECT event_id, {rd('coalesce(value, mv)')} AS value FROM ev, m""",
)
def fill_column_median(spark, sf_dir):
    events = planted(spark, sf_dir, "ev").select("event_id", "value")
    return rounded(impute.FillMissing("global_median").fit_transform(events))


def evaluation_cte(view: str, key: str, doubles, wholes) -> str:
    digest = f"md5('42:' || {key})"
    parts = [
        f"""SELECT '{c}' AS variable, grp, {c}::DOUBLE AS v, {'true' if c in wholes else 'false'} AS whole,
        ('0x' || substr({digest}, 1, 8))::BIGINT % 5 AS fold,
        ('0x' || substr({digest}, 9, 8))::BIGINT % 10000 < 2000 AS masked FROM {view} WHERE {c} IS NOT NULL"""
        for c in [*doubles, *wholes]
    ]

    def fitted(value: str) -> str:
        return f"CASE WHEN any_value(whole) THEN round_even({value}, 0)::DOUBLE ELSE {value} END"

    return f"""{cte(view)}, long AS ({union_all(parts)}),
    train AS (SELECT f.fold AS f, l.* FROM long l JOIN (SELECT unnest(range(5)) AS fold) f ON l.fold <> f.fold),
    g AS (SELECT variable, f, grp, {fitted('avg(v)')} AS gm, {fitted('quantile_cont(v, 0.5)')} AS gd
      FROM train WHERE grp IS NOT NULL GROUP BY variable, f, grp),
    o AS (SELECT variable, f, {fitted('avg(v)')} AS om, {fitted('quantile_cont(v, 0.5)')} AS od
      FROM train GROUP BY variable, f),
    per_fold AS (SELECT l.variable, l.fold, avg((v - om) ** 2) AS a, avg((v - coalesce(gm, om)) ** 2) AS b,
      avg((v - coalesce(gd, od)) ** 2) AS c
      FROM long l JOIN o ON l.variable = o.variable AND l.fold = o.f
      LEFT JOIN g ON l.variable = g.variable AND l.fold = g.f AND l.grp = g.grp WHERE masked
      GROUP BY l.variable, l.fold),
    ev_result AS (SELECT variable, avg(a) AS global_mean_mse, avg(b) AS group_mean_mse, avg(c) AS group_median_mse
      FROM per_fold GROUP BY variable)"""


EVALUATION = evaluation_cte("ev", "event_id", ["value", "score"], ["user_no"])


def evaluation(spark, sf_dir):
    return impute.evaluate_imputation(planted(spark, sf_dir, "ev"), "event_id", "grp", EV)


@query(
    "imputation_eval",
    f"WITH {EVALUATION} SELECT variable, {rd('global_mean_mse', 4)} AS global_mean_mse, "
    f"{rd('group_mean_mse', 4)} AS group_mean_mse, {rd('group_median_mse', 4)} AS group_median_mse FROM ev_result",
)
def imputation_eval(spark, sf_dir):
    return rounded(evaluation(spark, sf_dir), 4)


@query(
    "imputation_best",
    f"""WITH {EVALUATION} SELECT variable, CASE least(global_mean_mse, group_mean_mse, group_median_mse)
    WHEN global_mean_mse THEN 'global_mean_mse' WHEN group_mean_mse THEN 'group_mean_mse' ELSE 'group_median_mse' END
    AS best_method, {rd('least(global_mean_mse, group_mean_mse, group_median_mse)', 4)} AS mse FROM ev_result""",
)
def imputation_best(spark, sf_dir):
    return rounded(impute.best_strategy(evaluation(spark, sf_dir)), 4)


@query(
    "imputation_eval_long",
    f"WITH {EVALUATION} "
    + union_all(
        [
            f"SELECT variable, '{label}' AS method, {rd(name, 4)} AS mse FROM ev_result"
            for name, label in impute.STRATEGY_LABELS.items()
        ]
    ),
)
def imputation_eval_long(spark, sf_dir):
    return rounded(impute.evaluation_long(evaluation(spark, sf_dir)), 4)


@query(
    "imputation_mse",
    f"""WITH {cte('ev')}, m AS (SELECT avg(value) AS mv FROM ev)
    SELECT {rd('avg((coalesce(p.value, mv) - e.value) ** 2)', 4)} AS mse
    FROM ev p JOIN events e USING (event_id), m""",
)
def imputation_mse(spark, sf_dir):
    filled = impute.FillMissing("global_mean").fit_transform(planted(spark, sf_dir, "ev").select("event_id", "value"))
    truth = table(spark, sf_dir, "events").selectExpr("event_id", "value AS truth")
    return rounded(impute.mean_squared_error(filled.join(truth, "event_id"), "truth", "value"), 4)
