"""Whitening of embeddings by a covariance weighted with multiplicities.

Entries become whole numbers ``x = floor(scale * c) + shift``, so equal vectors are equal exactly. Identical x vectors are
grouped, and everything after that works on distinct vectors with a weight, their count or one:

* the weight's sum ``n`` and the exact sums ``S`` of every dimension;
* the covariance, as products ``C' W C`` of blocks of centred vectors, added up by Spark (d x d numbers leave the tasks);
* its eigenvectors, on the driver;
* each distinct vector's whitened coordinates and exact deviation, joined back to the rows on the vector itself. AQE splits
  the rows of a vector that fills much of the table.

Rows whose vector is null, or holds a null, a non-finite entry or one whose x needs more than 62 bits, are left out. So are
vectors that have not the most frequent length (of equally frequent ones the largest), and empty vectors. Repeated rows and
null ids stay rows. Components whose eigenvalue is at most ``LEAST_SHARE`` of the largest are rounding error and not
returned; a table without variance gives no rows, like an empty one. A deviation beyond 63 bits is null. Other columns of
the input are not read.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.runtime import quoted, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Share of the largest eigenvalue below which one is rounding error.
LEAST_SHARE = 1e-10
RESULT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def packed(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, x)`` of the valid rows; x is binary, little-endian whole numbers of 64 bits."""
    rows = vectors.select(F.col(quoted(vec_id)).alias("vec_id"), F.col(quoted(vector)).cast("array<double>").alias("c"))
    scale, shift = SCALE, SHIFT

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets)
            entries = lists.values.to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(entries.astype("float64") * scale)
                bad = ~(np.abs(scaled) < 2.0**62)  # true for nulls, which are NaN here
            bad_before = np.concatenate([[0], np.cumsum(bad)])
            valid = np.asarray(lists.is_valid()) & (bad_before[offsets[1:]] == bad_before[offsets[:-1]]) & (offsets[1:] > offsets[:-1])
            x = np.where(bad, 0, scaled).astype("<i8") + shift
            rows = np.flatnonzero(valid)
            keys = [x[offsets[i]:offsets[i + 1]].tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(keys, pa.binary())], names=["vec_id", "x"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"vec_id {id_type}, x binary")


def unpacked(keys: pa.Array, d: int) -> np.ndarray:
    """Rows of x vectors."""
    return np.frombuffer(b"".join(keys.to_pylist()), dtype="<i8").reshape(len(keys), d)


def _sums(d: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, w = unpacked(batch.column(0), d), batch.column(1).to_numpy()
            if int(np.abs(x).max()) * int(w.sum()) < 2**62:
                part = (x * w[:, None]).sum(axis=0).tolist()
            else:
                part = (x.astype(object) * w.astype(object)[:, None]).sum(axis=0).tolist()
            total = [a + b for a, b in zip(total, part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([str(t) for t in total], pa.string())], names=["i", "total"]
        )

    return add


@dataclass
class Centre:
    """Exact mean of the x vectors: ``S / n = whole + rest / n`` in every dimension."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        parts = [divmod(s, n) for s in sums]
        return cls(n, np.array([p[0] for p in parts], dtype="i8"), np.array([p[1] for p in parts], dtype="i8"))


def centred(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - whole).astype("float64") - rest / n


def deviations(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> list[int | None]:
    """Exact sums of ``(n * x - S) ** 2`` over the dimensions; None where one needs more than 63 bits."""
    if (n * (int(np.abs(x - whole).max()) + 1)) ** 2 * x.shape[1] < 2**63:
        return (((x - whole) * n - rest) ** 2).sum(axis=1).tolist()
    exact = (((x - whole).astype(object) * n - rest.astype(object)) ** 2).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in exact]


def _products(d: int, centre: Centre):
    n, whole, rest = centre.n, centre.whole, centre.rest

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                c = centred(unpacked(batch.column(0), d), n, whole, rest)
                total += c.T @ (c * batch.column(1).to_numpy()[:, None])
        rows = [total[i, i:].tolist() for i in range(d)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["i", "row"])

    return multiply


def _whiten(d: int, centre: Centre, axes: np.ndarray):
    n, whole, rest = centre.n, centre.whole, centre.rest

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = unpacked(batch.column(0), d)
            y = centred(x, n, whole, rest) @ axes
            columns = [batch.column(0), batch.column(1), pa.array(deviations(x, n, whole, rest), pa.int64()), pa.array(y.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "weight", "deviation", "y"])

    return project


def covariance(distinct: DataFrame, d: int, centre: Centre) -> np.ndarray:
    """Weighted covariance of the distinct vectors, divisor n."""
    parts = distinct.select("x", "weight").mapInArrow(_products(d, centre), "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    v = np.zeros((d, d))
    for cell in cells.collect():  # d * (d + 1) / 2 numbers
        v[cell["i"], cell["i"] + cell["j"]] = v[cell["i"] + cell["j"], cell["i"]] = cell["value"] / centre.n
    return v


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the weighted covariance of the whitened vectors minus the identity."""
    y = [F.col("y")[i] for i in range(k)]
    n = F.sum("weight").alias("n")
    means = whitened.agg(n, *[F.sum(F.col("weight") * v).alias(f"s{i}") for i, v in enumerate(y)]).first()
    c = [v - F.lit(means[f"s{i}"] / means["n"]) for i, v in enumerate(y)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = whitened.agg(*[F.sum(F.col("weight") * c[i] * c[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(products[f"p{i}_{j}"] / means["n"] - (i == j)) for i, j in pairs)


def whiten(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weights: str = "count"
) -> DataFrame:
    """One row for each valid row and component.

    ``weights="count"`` fits to all rows, ``"one"`` to each distinct vector once.
    """
    if weights not in ("count", "one"):
        raise ValueError(f"unknown weights: {weights}")
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/whitening-{uuid.uuid4()}"
    rows = packed(vectors, vec_id, vector)
    schema = RESULT.format(id=rows.schema["vec_id"].dataType.simpleString())
    rows.groupBy("x").agg(F.count("*").alias("rows")).write.parquet(f"{folder}/distinct")
    distinct = spark.read.parquet(f"{folder}/distinct")
    distinct = distinct.withColumn("weight", F.col("rows") if weights == "count" else F.lit(1).cast("long"))
    lengths = distinct.groupBy(F.length("x").alias("bytes")).agg(F.sum("rows").alias("rows"), F.sum("weight").alias("n"))
    most = lengths.orderBy(F.desc("rows"), F.desc("bytes")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    d, n = most["bytes"] // 8, most["n"]
    distinct = distinct.where(F.length("x") == most["bytes"]).select("x", "weight")
    sums = distinct.mapInArrow(_sums(d), "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["i"]: int(r["total"]) for r in sums.collect()}  # d numbers
    centre = Centre.of(n, [found[i] for i in range(d)])

    v = covariance(distinct, d, centre)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = [i for i in order if values[i] > 0 and values[i] > LEAST_SHARE * values.max()]
    if not order:
        return spark.createDataFrame([], schema)
    project = _whiten(d, centre, axes[:, order] / np.sqrt(values[order]))
    distinct.mapInArrow(project, "x binary, weight long, deviation long, y array<double>").write.parquet(f"{folder}/whitened")
    whitened = spark.read.parquet(f"{folder}/whitened")
    error = identity_error(whitened, len(order))
    explained = F.array(*[F.lit(float(values[i] / np.trace(v))) for i in order])
    joined = rows.join(whitened.drop("weight"), "x").select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    return joined.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
