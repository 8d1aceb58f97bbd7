"""Deterministic company tables for tests: every cell is derived from the row number by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Neutral categories: only their number and the gaps planted in the first of them matter.
SECTORS = tuple(f"group {i}" for i in range(1, 12))
RATINGS = tuple(f"grade {i}" for i in range(1, 8))
COUNTRIES = ("north", "south", "east", "west", "centre")
PANEL_SECTORS = SECTORS[:6]
QUALITY = ("sure", "likely", "unsure")


def uniform(name: str, seed: int = 42) -> Column:
    """Uniform in (0, 1) from the row id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}:{name}"), F.col("company_id")), 11)
    return (bits + 0.5) / F.lit(float(1 << 53))


def normal(name: str, seed: int = 42) -> Column:
    """Standard normal by the Box-Muller formula."""
    radius = F.sqrt(-2.0 * F.ln(uniform(name + "/r", seed)))
    return radius * F.cos(2.0 * F.pi() * uniform(name + "/a", seed))


def choice(name: str, values, seed: int = 42) -> Column:
    slot = F.floor(uniform(name, seed) * len(values)).cast("int")
    return F.array(*[F.lit(v) for v in values])[slot]


def company_table(spark: SparkSession, rows: int = 1000, seed: int = 42) -> DataFrame:
    """Wide table with 10% missing scores, a further 30% of one score missing in one sector, and 5% inflated emissions."""
    df = spark.range(rows).withColumnRenamed("id", "company_id").withColumn("gics_sector", choice("sector", SECTORS, seed))

    def score(name: str, extra: Column | None = None) -> Column:
        share = F.lit(0.1) if extra is None else extra
        return F.when(uniform(name + "/gap", seed) >= share, 100 * uniform(name, seed))

    emissions = -2000.0 * F.ln(uniform("e1", seed) * uniform("e2", seed))
    return df.select(
        "company_id",
        "gics_sector",
        F.exp(20 + 2 * normal("cap", seed)).alias("market_cap"),
        F.exp(18 + 2 * normal("revenue", seed)).alias("revenue"),
        F.exp(8 + 1.5 * normal("employees", seed)).cast("bigint").alias("employees"),
        score("environmental", F.when(F.col("gics_sector") == SECTORS[0], 0.37).otherwise(0.1)).alias("environmental_score"),
        score("social").alias("social_score"),
        score("governance").alias("governance_score"),
        F.when(uniform("spike", seed) < 0.05, emissions * 10).otherwise(emissions).alias("carbon_emissions"),
        choice("rating", RATINGS, seed).alias("rating"),
        choice("country", COUNTRIES, seed).alias("country"),
    )


def panel_table(spark: SparkSession, rows: int = 200, seed: int = 42) -> DataFrame:
    """Panel-like table whose missing shares depend on the sector."""
    df = spark.range(1, rows + 1).withColumnRenamed("id", "company_id").withColumn(
        "gics_sector", choice("panel/sector", PANEL_SECTORS, seed)
    )
    sector = F.col("gics_sector")
    scale = 0.8 + 0.4 * F.array_position(F.array(*[F.lit(s) for s in PANEL_SECTORS]), sector) / len(PANEL_SECTORS)

    def gaps(name: str, share: Column, value: Column) -> Column:
        return F.when(uniform(name + "/gap", seed) >= share, value).alias(name)

    score_share = F.when(sector == PANEL_SECTORS[1], 0.30).when(sector == PANEL_SECTORS[0], 0.05).otherwise(0.15)
    return df.select(
        "company_id",
        (F.floor(uniform("year", seed) * 5) + 2018).alias("year"),
        "gics_sector",
        gaps("esg_score", score_share, (5 + normal("esg", seed)) * scale),
        gaps("carbon_emissions", F.when(sector == PANEL_SECTORS[4], 0.35).otherwise(0.10), (50 + 20 * normal("co2", seed)) * scale),
        *[gaps(c, F.lit(0.15), normal(c, seed) * scale) for c in ("revenue_growth", "profit_margin", "employee_turnover")],
        F.when(uniform("quality/gap", seed) >= 0.1, choice("quality", QUALITY, seed)).alias("data_quality"),
    )
