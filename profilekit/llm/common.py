"""Shared pieces of the text operators.

Helpers that run in Python workers are pickled by value, so executors need no installed package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from profilekit.runtime import quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lower and upper ASCII letters, for lower-casing A-Z alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Compute = Callable[[list[str]], Sequence[Iterable]]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of the id written as text; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns of these names, whatever their case: a result column replaces an input column."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in taken])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__`` ... that no column of ``df`` has: for a column that only the work needs."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text_columns(docs: DataFrame, text: str, fields: Sequence[T.StructField], start: Callable[[], Compute]) -> DataFrame:
    """``docs`` with columns computed from each whole text in Arrow batches.

    ``start()`` runs once in each task and returns a function from the texts of
    a batch (null: empty) to one sequence of values for each field. Input columns
    named like a field are replaced.
    """
    kept = without(docs, [f.name for f in fields])
    if text not in kept.columns:
        kept = kept.withColumn(text, docs[quoted(text)])
    schema = T.StructType([*kept.schema.fields, *fields])
    at, arrow = kept.columns.index(text), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            added = compute(texts)
            columns = [*batch.columns, *(pa.array(v, type=arrow.field(len(batch.columns) + i).type) for i, v in enumerate(added))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return kept.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def hash_share(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, the same ones in every run and partitioning."""
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def bounded_labels(labels: DataFrame, doc_id: str, label: str, trained: Column, most: int) -> DataFrame:
    """Ids and labels of about ``most`` training rows at most, drawn by hash of the id; rows without a label go."""
    rows = labels.where(F.col(quoted(label)).isNotNull() & F.col(quoted(doc_id)).isNotNull() & trained).select(
        F.col(quoted(doc_id)).alias("train_id"), F.col(quoted(label)).cast("int").alias("train_label")
    )
    n = rows.count()
    return rows if n <= most else rows.where(hash_share(F.col("train_id"), most / n))
