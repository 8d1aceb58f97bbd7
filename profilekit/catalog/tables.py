"""Target and feature-table queries."""

from __future__ import annotations

from profilekit.catalog.features import PRIORITIES, STATUSES, dummies, llf_sql, yj_sql
from profilekit.catalog.registry import cte, planted, query, rd, rounded, table
from profilekit.config import Config
from profilekit.operators import assemble, profile, scale, schema
from profilekit.operators.encode import OneHot
from profilekit.operators.power import GRID, YeoJohnson
from profilekit.plans.prepare import prepare
from profilekit.sources.sinks import split_by_type

KEY, TARGET = "o_orderkey", "o_totalprice"


@query("target_extract", "SELECT o_orderkey, o_totalprice FROM orders")
def target_extract(spark, sf_dir):
    return assemble.target_extract(table(spark, sf_dir, "orders"), KEY, TARGET)


@query(
    "target_summary",
    f"""SELECT min(o_totalprice) AS minimum, max(o_totalprice) AS maximum, {rd('avg(o_totalprice)', 4)} AS mean,
    {rd('stddev_samp(o_totalprice)', 4)} AS std, count(o_totalprice) AS count FROM orders""",
)
def target_summary(spark, sf_dir):
    return rounded(profile.target_summary(table(spark, sf_dir, "orders"), TARGET), 4)


@query(
    "target_zscore",
    f"""SELECT o_orderkey, {rd('(o_totalprice - mu) / sd')} AS o_totalprice_zscore
    FROM orders, (SELECT avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd FROM orders)""",
)
def target_zscore(spark, sf_dir):
    return rounded(scale.target_zscore(table(spark, sf_dir, "orders"), KEY, TARGET))


@query(
    "target_range_violations",
    """SELECT count(*) FILTER (WHERE value < 0 OR value > 100) AS violations, min(value) AS minimum, max(value) AS maximum
    FROM events""",
)
def target_range_violations(spark, sf_dir):
    return schema.range_violations(table(spark, sf_dir, "events"), "value", 0.0, 100.0)


@query("split_categorical", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def split_categorical(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").drop("o_orderdate")
    return split_by_type(orders, *schema.split_columns(orders, [KEY]), KEY)["categorical"]


@query("split_numerical", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def split_numerical(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").drop("o_orderdate")
    return split_by_type(orders, *schema.split_columns(orders, [KEY]), KEY)["numerical"]


# Feature tables of the orders. Each part is its own projection with the key,
# as it would be read back from the stores written by the earlier steps.
NUMERICAL = """num AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS o_year, month(o_orderdate) AS o_month FROM orders)"""
TRANSFORMED = f"""y AS (SELECT o_orderkey, {yj_sql('o_custkey', '0.5')} AS yc, {yj_sql('o_month', '1.5')} AS ym FROM num),
tr AS (SELECT o_orderkey, (yc - avg_c) / sd_c AS yeo_joh_o_custkey, (ym - avg_m) / sd_m AS yeo_joh_o_month FROM y,
  (SELECT avg(yc) AS avg_c, stddev_pop(yc) AS sd_c, avg(ym) AS avg_m, stddev_pop(ym) AS sd_m FROM y))"""
ENCODED = f"""en AS (SELECT o_orderkey, {dummies('o_orderstatus', STATUSES[1:])}, {dummies('o_orderpriority', PRIORITIES[1:])}
FROM orders)"""
TR = f"{rd('yeo_joh_o_custkey')} AS yeo_joh_o_custkey, {rd('yeo_joh_o_month')} AS yeo_joh_o_month"


def parts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "year(o_orderdate) AS o_year", "month(o_orderdate) AS o_month",
        "o_orderstatus", "o_orderpriority", "o_totalprice",
    )
    numerical = orders.select(KEY, "o_custkey", "o_year", "o_month", TARGET)
    transformed = YeoJohnson(["o_custkey", "o_month"], lambdas={"o_custkey": 0.5, "o_month": 1.5}).fit_transform(numerical)
    categorical = orders.select(KEY, "o_orderstatus", "o_orderpriority")
    return numerical, transformed, categorical


@query("ml_table", f"WITH {NUMERICAL}, {TRANSFORMED}, {ENCODED} SELECT {TR}, en.* FROM tr JOIN en USING (o_orderkey)")
def ml_table(spark, sf_dir):
    _, transformed, categorical = parts(spark, sf_dir)
    return rounded(assemble.ml_table(transformed, OneHot().fit_transform(categorical), KEY, TARGET))


@query(
    "linear_table",
    f"""WITH {NUMERICAL}, {TRANSFORMED}, {ENCODED} SELECT o_custkey, o_year::INTEGER AS o_year, o_month::INTEGER AS o_month,
    {TR}, en.* FROM num JOIN tr USING (o_orderkey) JOIN en USING (o_orderkey)""",
)
def linear_table(spark, sf_dir):
    numerical, transformed, categorical = parts(spark, sf_dir)
    return rounded(assemble.linear_table(numerical, transformed, OneHot().fit_transform(categorical), KEY, TARGET))


@query(
    "tree_table",
    f"""WITH {NUMERICAL}, {TRANSFORMED} SELECT o_orderkey, o_custkey, o_year::INTEGER AS o_year, o_month::INTEGER AS o_month,
    {TR}, o_orderpriority FROM num JOIN tr USING (o_orderkey) JOIN orders o USING (o_orderkey, o_custkey)""",
)
def tree_table(spark, sf_dir):
    numerical, transformed, categorical = parts(spark, sf_dir)
    return rounded(
        assemble.tree_table(numerical, transformed, categorical, KEY, TARGET, dropped=["o_orderstatus", "esg_rating"])
    )


@query(
    "encoded_table",
    f"SELECT o_orderkey, o_custkey, {dummies('o_orderpriority', PRIORITIES[1:])} FROM orders",
)
def encoded_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(KEY, "o_custkey", "o_orderstatus", "o_orderpriority")
    return assemble.encoded_table(orders, KEY, ["o_orderstatus", "isin"])


@query(
    "attach_columns",
    f"""WITH {cte('cu')} SELECT c.c_custkey, c.c_name, k.c_acctbal FROM customer c
    LEFT JOIN (SELECT c_custkey, c_acctbal FROM cu WHERE c_acctbal IS NOT NULL) k ON c.c_custkey = k.c_custkey""",
)
def attach_columns(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    known = schema.complete_cases(planted(spark, sf_dir, "cu"), "c_acctbal")
    return assemble.attach_columns(base, known, "c_custkey", ["c_acctbal"])


PREPARED = {
    "p_size": "CASE WHEN (p_partkey * 31) % 10 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END",
    "p_retailprice": "CASE WHEN (p_partkey * 17) % 10 < 2 THEN NULL ELSE p_retailprice END",
}
# A string with a value of its own in each row is an identifier, not a feature.
IDENTIFIER = "concat('part ', p_partkey)"


def prepared_sql() -> str:
    fills = {
        "p_size": "coalesce(p_size, round_even(coalesce(gs, (SELECT avg(p_size) FROM src)), 0)::BIGINT)",
        "p_retailprice": "coalesce(p_retailprice, gp, (SELECT avg(p_retailprice) FROM src))",
    }
    parts = [
        f"""{c}_y AS (SELECT p_partkey, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS z FROM (SELECT p_partkey, {yj_sql(f'{c}::DOUBLE', 'lam')} AS y
        FROM filled, (SELECT arg_max(lam, llf) AS lam FROM ({llf_sql('filled', f'{c}::DOUBLE')}))))"""
        for c in PREPARED
    ]
    return f"""WITH src AS (SELECT p_partkey, p_brand, p_type, {', '.join(f'{e} AS {c}' for c, e in PREPARED.items())} FROM part),
    g AS (SELECT p_brand, avg(p_size) AS gs, avg(p_retailprice) AS gp FROM src GROUP BY p_brand),
    filled AS (SELECT p_partkey, p_brand, p_type, {', '.join(f'{e} AS {c}' for c, e in fills.items())} FROM src JOIN g USING (p_brand)),
    {', '.join(parts)}
    SELECT p_partkey, p_size, {rd('p_retailprice')} AS p_retailprice, {rd('s.z')} AS yeo_joh_p_size, {rd('r.z')} AS yeo_joh_p_retailprice,
      p_brand, p_type FROM filled JOIN p_size_y s USING (p_partkey) JOIN p_retailprice_y r USING (p_partkey)"""


@query("prepared_tree_table", prepared_sql())
def prepared_tree_table(spark, sf_dir):
    """The whole chain over the parts table: fill, flags, forest, power transform, identifiers out, native categories."""
    columns = ["p_partkey", "p_brand", "p_type", f"{IDENTIFIER} AS label", *[f"{e} AS {c}" for c, e in PREPARED.items()]]
    source = table(spark, sf_dir, "part").selectExpr(*columns)
    return rounded(prepare(source, Config(key="p_partkey", group_col="p_brand", lambda_grid=GRID, forest_contamination=0.05)).tree)
