"""Positions and running sums along a global order, without a task that sees all of it.

Rows are range-partitioned by the order and written to the checkpoint folder, so each keeps its partition. What lies in the
partitions before is a small table, one row for each partition, or for each partition and group; the rest is done within
partitions, whose size follows the number of partitions and not the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilekit.runtime import col, cut_lineage, hint_if_small

PART, PLACE = "__part", "__place"


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """``df`` with the position of each row in the order, from 0; equal rows are numbered in any order."""
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id())
    )
    # The upper bits of the number hold the partition, the lower 33 the place in it.
    part = F.shiftright(PLACE, 33)
    sizes = {r[PART]: r["n"] for r in placed.groupBy(part.alias(PART)).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    # One row for each partition.
    offset = F.broadcast(df.sparkSession.createDataFrame(offsets, f"{PART} long, __before long"))
    numbered = placed.withColumn(PART, part).join(offset, PART)
    place = F.col(PLACE).bitwiseAND((1 << 33) - 1)
    return numbered.select(*[col(c) for c in df.columns], (F.col("__before") + place).alias(name))


def rank_within(df: DataFrame, group: str, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with the rank of each row among the rows of its group, from 1; groups must not be null."""
    numbered = cut_lineage(number_rows(df, [col(group), *order], PLACE))
    first = numbered.groupBy(col(group).alias("__group")).agg(F.min(PLACE).alias("__first"))
    joined = numbered.join(hint_if_small(first), col(group) == F.col("__group"))
    return joined.select(*[col(c) for c in df.columns], (F.col(PLACE) - F.col("__first") + 1).alias(name))


def running_sums(df: DataFrame, groups: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``upto_{c}``, the sum of ``c`` up to and with the row within its group, and ``total_{c}`` of the group.

    ``groups`` and ``order`` together identify a row; nulls are values like others.
    """
    ranged = cut_lineage(df.repartitionByRange(*groups, order).withColumn(PART, F.spark_partition_id()))
    parts = ranged.groupBy(PART, *groups).agg(*[F.sum(c).alias(c) for c in columns])
    # At most one row for each partition in a group.
    in_group = Window.partitionBy(*groups)
    earlier = in_group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_lineage(parts.select(
        F.col(PART).alias("__p"), *[col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in columns],
        *[F.sum(c).over(in_group).alias(f"total_{c}") for c in columns],
    ))
    inside = Window.partitionBy(PART, *groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.select("*", *[F.sum(c).over(inside).alias(f"in_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)], F.col(PART) == F.col("__p"))
    return summed.join(hint_if_small(parts), same).select(
        *[col(c) for c in df.columns], *[(F.col(f"in_{c}") + F.col(f"before_{c}")).alias(f"upto_{c}") for c in columns],
        *[F.col(f"total_{c}") for c in columns],
    )
