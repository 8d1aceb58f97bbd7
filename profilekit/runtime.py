"""Helpers that decide where a small result lives: on the driver, in a broadcast or in a checkpoint."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup table within these bounds is kept as a local relation and broadcast.
# Anything larger stays distributed and is joined by shuffle.
LOOKUP_ROWS = 200_000
LOOKUP_BYTES = 32 << 20


def quoted(name: str) -> str:
    """Column name usable in ``F.col`` even when it holds dots, spaces or backticks."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    It comes from ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder; a cluster must name one, because a lost
    executor could not be replaced from a machine-local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="profilekit-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, limit: int = LOOKUP_ROWS):
    """All rows of ``df`` as an Arrow table when they keep to the row and byte bounds, else None."""
    rows = df.limit(limit + 1).toArrow()
    return rows if rows.num_rows <= limit and rows.nbytes <= LOOKUP_BYTES else None


def settle(table: DataFrame, limit: int = LOOKUP_ROWS) -> tuple[DataFrame, bool]:
    """Compute ``table`` once: a local relation when it has at most ``limit`` rows, else a checkpoint."""
    rows = bounded_rows(table, limit)
    if rows is not None:
        return table.sparkSession.createDataFrame(rows, schema=table.schema), True
    return cut_lineage(table), False


class Lookup:
    """A fitted lookup table: local and broadcast when small, checkpointed when not."""

    def __init__(self, table: DataFrame, limit: int = LOOKUP_ROWS):
        self.table, self.small = settle(table, limit)

    def left_join(self, df: DataFrame, column: str, lookup_key: str) -> DataFrame:
        """Attach the lookup columns; rows with a null or unknown key get nulls.

        The hint is given only when the table was proven small. Otherwise the
        join is a sort-merge join, whose hot keys AQE splits on the left side.
        """
        side = F.broadcast(self.table) if self.small else self.table
        return df.join(side, df[quoted(column)] == side[quoted(lookup_key)], "left").drop(side[quoted(lookup_key)])


def row_bytes(schema: T.StructType) -> Column:
    """About the size of a row: the bytes of its strings, binaries and collections, and eight for any other value."""

    def size(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)) + 8
        if isinstance(kind, T.StructType):
            return sum((size(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            return F.greatest(F.size(value), F.lit(0)) * 8 + 8
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)) + 8
        return F.lit(8)

    return sum((size(col(f.name), f.dataType) for f in schema.fields), F.lit(0)).cast("long")


def hint_if_small(table: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """Broadcast hint for an already materialised table, only when its rows and bytes keep to the bounds."""
    sizes = table.select(row_bytes(table.schema).alias("b")).limit(limit + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(table) if sizes["n"] <= limit and (sizes["b"] or 0) <= LOOKUP_BYTES else table
