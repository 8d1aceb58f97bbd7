"""Encoding, scaling, power transform and profile queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from profilekit.catalog.registry import cte, planted, query, rd, rounded, table, union_all
from profilekit.operators import encode, power, profile, scale, schema
from profilekit.plans.analysis import compare_distributions, engineer_features

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]

# The categories of the generated tables, in text order.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


# --- scaling ------------------------------------------------------------------


def scaled_sql(center: str, divisor: str, columns, source: str, keys) -> str:
    stats = ", ".join(f"{center.format(c=c)} AS m_{c}, coalesce(nullif({divisor.format(c=c)}, 0), 1) AS d_{c}" for c in columns)
    return (
        f"SELECT {', '.join(keys)}, {', '.join(f'{rd(f'({c} - m_{c}) / d_{c}')} AS {c}' for c in columns)} "
        f"FROM {source}, (SELECT {stats} FROM {source})"
    )


@query("scale_standard", scaled_sql("avg({c})", "stddev_pop({c})", LINE, "lineitem", KEYS))
def scale_standard(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*KEYS, *LINE)
    return rounded(scale.Scale("standard", LINE).fit_transform(lines))


@query("scale_minmax", scaled_sql("min({c})", "(max({c}) - min({c}))", LINE, "lineitem", KEYS))
def scale_minmax(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*KEYS, *LINE)
    return rounded(scale.Scale("minmax", LINE).fit_transform(lines))


@query(
    "scale_robust",
    scaled_sql(
        "quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))", LINE, "lineitem", KEYS
    ),
)
def scale_robust(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*KEYS, *LINE)
    return rounded(scale.Scale("robust", LINE).fit_transform(lines))


@query(
    "scale_with_nulls",
    f"WITH {cte('ev')} " + scaled_sql("avg({c})", "stddev_pop({c})", ["value", "user_no"], "ev", ["event_id"]),
)
def scale_with_nulls(spark, sf_dir):
    events = planted(spark, sf_dir, "ev").select("event_id", "value", "user_no")
    return rounded(scale.Scale("standard", ["value", "user_no"]).fit_transform(events))


# --- one-hot and target encoding ----------------------------------------------


def dummies(column: str, values, name: str | None = None) -> str:
    return ", ".join(
        f"(CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END)::FLOAT AS \"{name or column}_{v}\"" for v in values
    )


@query("one_hot", f"SELECT p_partkey, {dummies('p_type', PART_TYPES[1:])} FROM part")
def one_hot(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return encode.OneHot(["p_type"]).fit_transform(parts)


@query(
    "one_hot_all_values",
    f"SELECT o_orderkey, {dummies('o_orderstatus', STATUSES)}, {dummies('o_orderpriority', PRIORITIES)} FROM orders",
)
def one_hot_all_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return encode.OneHot(drop_first=False).fit_transform(orders)


@query(
    "one_hot_null",
    f"WITH {cte('ev')} SELECT event_id, {dummies('grp', ['error', 'purchase', 'signup', 'view'])} FROM ev",
)
def one_hot_null(spark, sf_dir):
    return encode.OneHot(["grp"]).fit_transform(planted(spark, sf_dir, "ev").select("event_id", "grp"))


CODES = 73
CODE = f"concat('k', p_partkey * 31 % {CODES})"


def coded_parts(spark, sf_dir):
    """A string column with more values than a small category has."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{CODE} AS code")


@query(
    "one_hot_wide",
    f"SELECT p_partkey, {dummies('code', sorted(f'k{i}' for i in range(CODES))[1:])} FROM (SELECT p_partkey, {CODE} AS code FROM part)",
)
def one_hot_wide(spark, sf_dir):
    return encode.OneHot(["code"]).fit_transform(coded_parts(spark, sf_dir))


@query(
    "one_hot_wide_vector",
    f"""WITH p AS (SELECT p_partkey, {CODE} AS code FROM part), d AS (SELECT code, row_number() OVER (ORDER BY code) - 2 AS slot FROM p GROUP BY code)
    SELECT p_partkey, slot::INTEGER AS slot, 1.0::DOUBLE AS value, {CODES - 1}::INTEGER AS width FROM p JOIN d USING (code) WHERE slot >= 0""",
)
def one_hot_wide_vector(spark, sf_dir):
    vectors = encode.OneHot(["code"], output="vector").fit_transform(coded_parts(spark, sf_dir))
    slots = vector_to_array("code_vector")
    return vectors.select("p_partkey", F.size(slots).alias("width"), F.posexplode(slots).alias("slot", "value")).where("value <> 0")


@query(
    "one_hot_every_order",
    """WITH d AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey::VARCHAR) - 2 AS slot, count(*) OVER () - 1 AS features FROM orders)
    SELECT o_orderkey::VARCHAR AS value, slot, features::BIGINT AS features FROM d WHERE slot >= 0""",
)
def one_hot_every_order(spark, sf_dir):
    """A category for each row: the slots of the vectors, which no driver or task has seen as a whole."""
    orders = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS string) AS o_orderkey")
    model = encode.OneHot(["o_orderkey"], output="vector").fit(orders)
    return model.slots().select("value", "slot", F.lit(model.widths["o_orderkey"]).cast("long").alias("features"))


EXPANSION_SQL = union_all(
    [
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS categories, count(DISTINCT {c}) - 1 AS features FROM {t}"
        for t, c in [("orders", "o_orderstatus"), ("orders", "o_orderpriority")]
    ]
)


@query(
    "expansion_table",
    f"""WITH e AS ({EXPANSION_SQL}), t AS (SELECT * FROM e UNION ALL
    SELECT 'TOTAL', sum(categories)::BIGINT, sum(features)::BIGINT FROM e)
    SELECT "column", categories, features, {rd('features / categories')} AS expansion_ratio FROM t""",
)
def expansion_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    return rounded(encode.expansion_table(orders, encode.OneHot().fit(orders).widths))


def target_sql(kind: str) -> str:
    columns = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    per_column, picked, joins = [], [], []
    for c in columns:
        value = (
            "(count(*) * avg(o_totalprice) + 5 * (SELECT avg(o_totalprice) FROM orders)) / (count(*) + 5)"
            if kind == "mean"
            else "quantile_cont(o_totalprice, 0.5)"
        )
        per_column.append(f"e_{c} AS (SELECT {c} AS k_{c}, {value} AS x_{c} FROM orders GROUP BY {c})")
        joins.append(f"LEFT JOIN e_{c} ON {c} = k_{c}")
        picked.append(f"{rd(f'x_{c}', 4)} AS {c}_target_encoded")
    return f"WITH {', '.join(per_column)} SELECT o_orderkey, {', '.join(picked)} FROM orders {' '.join(joins)}"


def target_encoded(spark, sf_dir, method):
    columns = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", *columns)
    out = encode.TargetEncode(columns, "o_totalprice", method=method).fit_transform(orders)
    return rounded(out.select("o_orderkey", *[f"{c}_target_encoded" for c in columns]), 4)


@query("target_encode_mean", target_sql("mean"))
def target_encode_mean(spark, sf_dir):
    return target_encoded(spark, sf_dir, "mean")


@query("target_encode_median", target_sql("median"))
def target_encode_median(spark, sf_dir):
    return target_encoded(spark, sf_dir, "median")


@query(
    "target_group_stats",
    union_all(
        [
            f"SELECT '{c}' AS variable, {c} AS category, {rd('avg(o_totalprice)', 4)} AS mean, count(*) AS count "
            f"FROM orders GROUP BY {c}"
            for c in ("o_orderstatus", "o_orderpriority")
        ]
    ),
)
def target_group_stats(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return rounded(encode.category_statistics(orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice"), 4)


# --- interactions and polynomials ----------------------------------------------

PAIRS = [("l_quantity", "l_discount"), ("l_extendedprice", "l_tax"), ("l_quantity", "absent")]


def interact_sql(sign: str, word: str) -> str:
    def value(a, b):
        return f"{a} / nullif({b}, 0)" if word == "div" else f"{a} {sign} {b}"

    picked = ", ".join(f"{rd(value(a, b), 4)} AS {a}_{word}_{b}" for a, b in PAIRS[:2])
    return f"SELECT l_orderkey, l_linenumber, {picked} FROM lineitem"


def interacted(spark, sf_dir, kind):
    lines = table(spark, sf_dir, "lineitem").select(*KEYS, *LINE)
    return rounded(encode.interact(lines, PAIRS, kind).drop(*LINE), 4)


@query("interact_multiply", interact_sql("*", "x"))
def interact_multiply(spark, sf_dir):
    return interacted(spark, sf_dir, "multiply")


@query("interact_add", interact_sql("+", "plus"))
def interact_add(spark, sf_dir):
    return interacted(spark, sf_dir, "add")


@query("interact_subtract", interact_sql("-", "minus"))
def interact_subtract(spark, sf_dir):
    return interacted(spark, sf_dir, "subtract")


@query("interact_divide", interact_sql("/", "div"))
def interact_divide(spark, sf_dir):
    return interacted(spark, sf_dir, "divide")


@query(
    "poly_degree2",
    f"""SELECT l_orderkey, l_linenumber, {rd('l_quantity * l_quantity', 4)} AS l_quantity_pow_2,
    {rd('l_quantity * l_discount', 4)} AS l_quantity_l_discount, {rd('l_discount * l_discount')} AS l_discount_pow_2
    FROM lineitem""",
)
def poly_degree2(spark, sf_dir):
    columns = ["l_quantity", "l_discount"]
    lines = table(spark, sf_dir, "lineitem").select(*KEYS, *columns)
    return rounded(encode.polynomial(lines, columns, 2).drop(*columns), 4, l_discount_pow_2=6)


@query(
    "poly_degree3",
    f"""SELECT p_partkey, {rd('p_size::DOUBLE ** 2', 4)} AS p_size_pow_2, {rd('p_size * p_retailprice', 4)} AS p_size_p_retailprice,
    {rd('p_retailprice * p_retailprice', 4)} AS p_retailprice_pow_2, {rd('p_size::DOUBLE ** 3', 4)} AS p_size_pow_3,
    {rd('p_size::DOUBLE * p_size * p_retailprice', 4)} AS p_size_pow_2_p_retailprice,
    {rd('p_size * p_retailprice * p_retailprice', 4)} AS p_size_p_retailprice_pow_2,
    {rd('p_retailprice * p_retailprice * p_retailprice', 4)} AS p_retailprice_pow_3 FROM part""",
)
def poly_degree3(spark, sf_dir):
    columns = ["p_size", "p_retailprice"]
    parts = table(spark, sf_dir, "part").select("p_partkey", *columns)
    return rounded(encode.polynomial(parts, columns, 3).drop(*columns), 4)


# One-hot columns are scaled too, and the later steps see scaled values.
ENGINEERED = [f"p_type_{v}" for v in PART_TYPES[1:]] + ["p_size", "p_retailprice"]


@query(
    "feature_engineering",
    f"""WITH hot AS (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice,
      {', '.join(f"(CASE WHEN p_type = '{v}' THEN 1 ELSE 0 END)::DOUBLE AS p_type_{v}" for v in PART_TYPES[1:])} FROM part),
    scaled AS (SELECT p_partkey, {', '.join(f'({c} - m_{c}) / d_{c} AS {c}' for c in ENGINEERED)} FROM hot,
      (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}' for c in ENGINEERED)} FROM hot))
    SELECT p_partkey, {', '.join(f'{rd(c)} AS {c}' for c in ENGINEERED)},
    {rd('p_size * p_retailprice')} AS p_size_x_p_retailprice, {rd('p_size * p_size')} AS p_size_pow_2 FROM scaled""",
)
def feature_engineering(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    out, _ = engineer_features(
        parts, exclude=["p_partkey"], scaling="standard", interactions=[("p_size", "p_retailprice")], polynomials=["p_size"]
    )
    return rounded(out)


# --- Yeo-Johnson -----------------------------------------------------------------


def yj_sql(x: str, lam: str) -> str:
    return (
        f"CASE WHEN {x} >= 0 THEN CASE WHEN {lam} = 0 THEN ln(1 + {x}) ELSE ((1 + {x}) ** {lam} - 1) / {lam} END "
        f"ELSE CASE WHEN {lam} = 2 THEN -ln(1 - {x}) ELSE -((1 - {x}) ** (2 - {lam}) - 1) / (2 - {lam}) END END"
    )


def llf_sql(source: str, column: str, steps: str = "range(-20, 21)", per_unit: int = 10) -> str:
    """``(lam, llf)`` over a grid, the fixed one unless others are given."""
    return f"""SELECT lam, -0.5 * count(*) * ln(var_pop({yj_sql('x', 'lam')}))
      + (lam - 1) * sum(sign(x) * ln(1 + abs(x))) AS llf
    FROM (SELECT {column} AS x FROM {source} WHERE {column} IS NOT NULL),
      (SELECT (unnest({steps}) / {per_unit}.0)::DOUBLE AS lam) GROUP BY lam"""


@query(
    "yj_loglik_grid",
    union_all(
        [
            f"SELECT '{c}' AS variable, lam AS lambda, {rd('llf', 3)} AS llf FROM ({llf_sql('customer', c)})"
            for c in ("c_acctbal",)
        ]
        + [f"SELECT 'value' AS variable, lam AS lambda, {rd('llf', 3)} AS llf FROM ({llf_sql('events', 'value')})"]
    ),
)
def yj_loglik_grid(spark, sf_dir):
    customers = power.lambda_grid(table(spark, sf_dir, "customer"), ["c_acctbal"])
    events = power.lambda_grid(table(spark, sf_dir, "events"), ["value"])
    return rounded(customers.unionByName(events), 3, **{"lambda": 1})


@query(
    "yj_transform_fixed_lambda",
    f"""WITH {cte('cu')}, f AS (SELECT c_custkey, coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM cu)) AS x FROM cu)
    SELECT c_custkey, {rd(yj_sql('x', '0.5'))} AS yeo_joh_c_acctbal FROM f""",
)
def yj_transform_fixed_lambda(spark, sf_dir):
    customers = planted(spark, sf_dir, "cu").select("c_custkey", "c_acctbal")
    fixed = power.YeoJohnson(["c_acctbal"], lambdas={"c_acctbal": 0.5}, standardize=False)
    return rounded(fixed.fit_transform(customers).drop("c_acctbal"))


@query(
    "yj_fit_transform_grid",
    f"""WITH {cte('ev')}, f AS (SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ev)) AS x FROM ev),
    b AS (SELECT arg_max(lam, llf) AS lam FROM ({llf_sql('f', 'x')})),
    y AS (SELECT event_id, {yj_sql('x', 'lam')} AS y FROM f, b)
    SELECT event_id, {rd('(y - mu) / sd')} AS yeo_joh_value FROM y, (SELECT avg(y) AS mu, stddev_pop(y) AS sd FROM y)""",
)
def yj_fit_transform_grid(spark, sf_dir):
    events = planted(spark, sf_dir, "ev").select("event_id", "value")
    return rounded(power.YeoJohnson(["value"], grid=power.GRID).fit_transform(events).drop("value"))


def yj_fitted_sql(column: str) -> str:
    """The best of all lambdas with two decimals, and the moments of the transformed column."""
    return f"""SELECT '{column}' AS variable, {rd('any_value(lam)', 4)} AS lambda, {rd('any_value(median)', 4)} AS median, {rd('avg(y)', 4)} AS mean,
      {rd('stddev_pop(y)', 4)} AS std FROM (SELECT lam, median, {yj_sql('x', 'lam')} AS y
        FROM (SELECT *, coalesce({column}, median) AS x FROM ev, (SELECT quantile_cont({column}, 0.5) AS median FROM ev)),
        (SELECT arg_max(lam, llf) AS lam FROM ({llf_sql('f_' + column, 'x', 'range(-200, 401)', 100)})))"""


@query(
    "yj_fit_parameters",
    f"""WITH {cte('ev')}, {', '.join(f"f_{c} AS (SELECT coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM ev)) AS x FROM ev)" for c in ('value', 'score'))}
    {yj_fitted_sql('value')} UNION ALL {yj_fitted_sql('score')}""",
)
def yj_fit_parameters(spark, sf_dir):
    events = planted(spark, sf_dir, "ev").select("value", "score")
    return rounded(power.YeoJohnson(["value", "score"], digits=2).fit(events).table(spark), 4)


# --- profiles ----------------------------------------------------------------------


@query(
    "coerce_numeric_keep",
    """WITH c AS (SELECT TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS event_type,
      TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS text FROM events)
    """
    + union_all(
        [
            f"SELECT '{c}' AS variable, {rd(f'count({c}) / count(*)')} AS share, count({c}) / count(*) > 0.5 AS kept FROM c"
            for c in ("k", "event_type", "text")
        ]
    ),
)
def coerce_numeric_keep(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.regexp_extract("props", "[0-9]+", 0).alias("k"),
        "event_type",
        F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("text"),
    )
    _, report, _ = schema.coerce_numeric(events, events.columns)
    return rounded(report)


@query(
    "type_normalisation",
    """SELECT l_orderkey, l_linenumber::BIGINT AS line, l_quantity::BIGINT AS l_quantity, round(l_extendedprice, 2) AS l_extendedprice
    FROM lineitem""",
)
def type_normalisation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("double").alias("line"), "l_quantity", "l_extendedprice"
    )
    return rounded(schema.normalise_types(lines), 2)


def histogram_sql(source: str, column: str, bins: int = 30, prefix: str = "") -> str:
    return f"""{prefix} SELECT '{column}' AS variable, bin, {rd('lo + bin * w')} AS bin_start, {rd('lo + (bin + 0.5) * w')} AS bin_center,
    count, {rd('count / (n * w)', 8)} AS density FROM (
      SELECT least(floor(({column} - lo) / w), {bins - 1})::INTEGER AS bin, lo, w, n, count(*) AS count
      FROM {source}, (SELECT min({column}) AS lo, (max({column}) - min({column})) / {bins} AS w, count({column}) AS n FROM {source})
      WHERE {column} IS NOT NULL GROUP BY ALL)"""


@query("histogram30", histogram_sql("ev", "value", prefix=f"WITH {cte('ev')}"))
def histogram30(spark, sf_dir):
    return rounded(profile.histogram(planted(spark, sf_dir, "ev"), ["value"]), 6, density=8)


@query(
    "dist_summary",
    f"WITH {cte('ev')} "
    + union_all(
        [
            f"""SELECT '{c}' AS variable, {rd(f'avg({c})')} AS mean, {rd(f'stddev_pop({c})')} AS std,
            {rd(f'quantile_cont({c}, 0.5)')} AS median, {rd(f'avg({c}) - stddev_pop({c})')} AS minus_std,
            {rd(f'avg({c}) + stddev_pop({c})')} AS plus_std FROM ev"""
            for c in ("value", "score")
        ]
    ),
)
def dist_summary(spark, sf_dir):
    return rounded(profile.distribution_summary(planted(spark, sf_dir, "ev"), ["value", "score"]))


@query(
    "before_after_summary",
    "WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS d, avg(p_size) AS ms, stddev_pop(p_size) AS ds FROM part) "
    + union_all(
        [
            f"""SELECT '{c}' AS variable, {rd(f'avg({c})')} AS original_mean, {rd(f'stddev_samp({c})')} AS original_std,
            {rd(f'avg(({c} - {m}) / {d})')} AS transformed_mean, {rd(f'stddev_samp(({c} - {m}) / {d})')} AS transformed_std
            FROM part, s"""
            for c, m, d in [("p_retailprice", "m", "d"), ("p_size", "ms", "ds")]
        ]
    ),
)
def before_after_summary(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    columns = ["p_retailprice", "p_size"]
    scaled = scale.Scale("standard", columns).fit_transform(parts)
    return rounded(compare_distributions(parts, scaled, columns))


@query(
    "gaussian_overlay",
    f"""WITH {cte('ev')}, m AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM ev)
    SELECT variable, bin, bin_center, density,
    {rd('exp(-0.5 * ((bin_center - mu) / sd) ** 2) / (sd * sqrt(2 * pi()))', 8)} AS gaussian
    FROM ({histogram_sql('ev', 'value')}), m""",
)
def gaussian_overlay(spark, sf_dir):
    return rounded(
        profile.gaussian_overlay(planted(spark, sf_dir, "ev"), "value"), 6, density=8, gaussian=8
    )


@query(
    "variance_top",
    "SELECT variable, variance FROM ("
    + union_all([f"SELECT '{c}' AS variable, {rd(f'var_samp({c})', 4)} AS variance FROM lineitem" for c in LINE])
    + ") ORDER BY variance DESC LIMIT 3",
)
def variance_top(spark, sf_dir):
    return rounded(profile.top_variance(table(spark, sf_dir, "lineitem"), LINE, 3), 4)


@query(
    "category_counts",
    union_all(
        [f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS categories FROM part" for c in ("p_brand", "p_type", "p_name")]
    ),
)
def category_counts(spark, sf_dir):
    return profile.category_counts(table(spark, sf_dir, "part"))


@query(
    "dtype_counts",
    """SELECT CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS dtype,
    count(*) AS columns FROM (DESCRIBE SELECT * FROM part) GROUP BY dtype""",
)
def dtype_counts(spark, sf_dir):
    return profile.dtype_counts(table(spark, sf_dir, "part"))


@query(
    "size_profile",
    "SELECT variable, bytes FROM ("
    + union_all(
        [f"SELECT '{c}' AS variable, sum(strlen({c}))::BIGINT AS bytes FROM part" for c in ("p_name", "p_brand", "p_type")]
        + [
            f"SELECT '{c}' AS variable, count({c}) * {w} AS bytes FROM part"
            for c, w in [("p_partkey", 8), ("p_size", 4), ("p_retailprice", 8)]
        ]
    )
    + ") ORDER BY bytes DESC, variable LIMIT 10",
)
def size_profile(spark, sf_dir):
    return profile.size_profile(table(spark, sf_dir, "part"))


TYPED = {
    "whole": "concat(' ', event_id)",
    "real": "concat(event_id % 100, '.25')",
    "flag": "CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'true' ELSE 'FALSE' END",
    "code": "CASE WHEN event_id % 9 = 0 THEN '007' ELSE concat(event_id % 9) END",
    "mixed": "CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE concat(event_id) END",
}


@query(
    "typed_strings",
    f"""WITH t AS (SELECT {', '.join(f'{e} AS {c}' for c, e in TYPED.items())} FROM events)
    SELECT whole::BIGINT AS whole, real::DOUBLE AS real, coalesce(nullif(flag, '')::BOOLEAN::INTEGER, -1) AS flag, code, mixed FROM t""",
)
def typed_strings(spark, sf_dir):
    typed = schema.type_strings(table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in TYPED.items()]))
    return typed.withColumn("flag", F.when(~F.col("flag"), 0).when(F.col("flag"), 1).otherwise(-1))
