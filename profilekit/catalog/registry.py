"""Named queries over the benchmark tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.runtime import col

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round double columns, so that a different order of summation does not show; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(col(f.name), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else col(f.name)
            for f in df.schema
        ]
    )


def rd(expression: str, digits: int = 6) -> str:
    """SQL counterpart of :func:`rounded`."""
    return f"round({expression}, {digits}) + 0.0"


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# Views with planted missing values. The expressions are plain SQL that both
# engines evaluate in the same way.
EVENTS = {
    "event_id": "event_id",
    "grp": "CASE WHEN event_id % 53 = 7 THEN NULL ELSE event_type END",
    "value": "CASE WHEN (event_id * 7919) % 100 < CASE event_type WHEN 'error' THEN 30 WHEN 'click' THEN 5 ELSE 15 END "
    "THEN NULL ELSE value END",
    "user_no": "CASE WHEN (event_id * 31) % 100 < CASE event_type WHEN 'view' THEN 25 ELSE 10 END "
    "THEN NULL ELSE user_id END",
    "score": "CASE WHEN (event_id * 17) % 100 < 8 THEN NULL ELSE value / 10.0 + (event_id % 7) END",
}
PARTS = {
    "p_partkey": "p_partkey",
    "grp": "CASE WHEN p_partkey % 97 = 5 THEN NULL ELSE p_brand END",
    "p_type": "p_type",
    "p_size": "CASE WHEN (p_partkey * 31) % 10 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END",
    "p_retailprice": "CASE WHEN (p_partkey * 17) % 10 < 2 THEN NULL ELSE p_retailprice END",
}
CUSTOMERS = {
    "c_custkey": "c_custkey",
    "grp": "c_mktsegment",
    "c_acctbal": "CASE WHEN (c_custkey * 13) % 100 < CASE c_mktsegment WHEN 'BUILDING' THEN 40 ELSE 10 END "
    "THEN NULL ELSE c_acctbal END",
}
SPIKED_PARTS = {
    "p_partkey": "p_partkey",
    "p_size": "CASE WHEN p_partkey % 200 = 3 THEN CAST(500 AS BIGINT) ELSE CAST(p_size AS BIGINT) END",
    "p_retailprice": "CASE WHEN p_partkey % 250 = 9 THEN p_retailprice * 40.0 ELSE p_retailprice END",
}
def lines(group: str) -> dict[str, str]:
    """Line items by some group; what is missing depends weakly on the line status."""
    weak = "CASE l_linestatus WHEN 'F' THEN 312 ELSE 300 END"
    return {
        "grp": group,
        "l_quantity": f"CASE WHEN (l_orderkey * 37 + l_partkey * 101) % 1000 < {weak} THEN NULL ELSE l_quantity END",
        "l_discount": "CASE WHEN (l_orderkey * 13 + l_linenumber * 7) % 10 < 3 THEN NULL ELSE l_discount END",
        "l_tax": "l_tax",
    }


PLANTED: Mapping[str, tuple[str, Mapping[str, str]]] = {
    "ev": ("events", EVENTS),
    "pt": ("part", PARTS),
    "cu": ("customer", CUSTOMERS),
    "sp": ("part", SPIKED_PARTS),
    "li": ("lineitem", lines("l_orderkey")),
    "ls": ("lineitem", lines("l_linestatus")),
    "lq": ("lineitem", lines("CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat(l_linestatus, l_partkey % 2) END")),
}


def planted(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    source, columns = PLANTED[view]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def cte(view: str) -> str:
    """The same view as a common table expression."""
    source, columns = PLANTED[view]
    return f"{view} AS (SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source})"
