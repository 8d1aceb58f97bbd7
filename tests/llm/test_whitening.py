"""Whitening against numpy on the rows themselves."""

import math

import numpy as np
import pytest
from conftest import SF

from profilekit.llm import whitening as w
from profilekit.llm.queries import QUERIES


def table(spark, vectors, extra=""):
    rows = [(i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.selectExpr("*", extra) if extra else df


def plain(vectors, components=8, weights="count"):
    """{row: (deviation, whitened)}, explained and n, by numpy over all rows."""
    x = {i: [math.floor(1024 * c) + 100_000 for c in v] for i, v in vectors.items()}
    fit = list(x.values()) if weights == "count" else [list(v) for v in {tuple(v) for v in x.values()}]
    n, s = len(fit), [sum(col) for col in zip(*fit)]
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = [i for i in np.argsort(-values)[:components] if values[i] > 1e-10 * values.max()]
    out = {}
    for i, v in x.items():
        c = np.array([(n * a - b) / n for a, b in zip(v, s)])
        out[i] = sum((n * a - b) ** 2 for a, b in zip(v, s)), c @ axes[:, order] / np.sqrt(values[order])
    return out, values[order] / values.sum(), n


def check(rows, vectors, weights="count"):
    want, explained, n = plain(vectors, weights=weights)
    assert len(rows) == len(vectors) * len(explained)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    for k in range(len(explained)):
        mine = np.array([by[i, k + 1]["whitened"] for i in want])
        theirs = np.array([want[i][1][k] for i in want])
        sign = 1 if mine @ theirs >= 0 else -1
        assert np.allclose(mine, sign * theirs, atol=1e-6)
    for r in rows:
        assert (r["n"], r["deviation"]) == (n, want[r["vec_id"]][0])
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-6


@pytest.mark.parametrize("weights", ["count", "one"])
def test_against_numpy_with_repeated_vectors(spark, weights):
    rng = np.random.default_rng(3)
    distinct = rng.normal(size=(60, 12)) * np.linspace(1, 4, 12)
    vectors = [distinct[i].tolist() for i in [0] * 80 + [1] * 9 + list(range(60))]
    rows = w.whiten(table(spark, vectors).repartition(5), weights=weights).collect()
    check(rows, dict(enumerate(vectors)), weights)


def test_rows_without_a_valid_vector(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [0.0, -1.0, 2.5], [4.0, 0.25, 1.0], [1.0, 2.0, 0.5]]
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, inf, 1.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    rows = w.whiten(table(spark, good + bad)).collect()
    check(rows, dict(enumerate(good)))


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, [1.0, 0.0]), (7, [0.0, 2.0]), (7, [0.0, 2.0]), (8, [3.0, 3.0])]
    got = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(["7"] * 4 + ["8"] * 2 + ["None"] * 2)


def test_large_entries_are_exact_or_null(spark):
    vectors = [[2.0**19, 1.0], [-(2.0**19), 2.0], [5.0, 3.0]]
    rows = w.whiten(table(spark, vectors)).collect()
    want, _, _ = plain(dict(enumerate(vectors)))
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: v[0] for i, v in want.items()}
    huge = w.whiten(table(spark, [[2.0**45, 1.0], [0.0, 2.0], [5.0, 3.0]])).collect()
    assert {r["vec_id"]: r["deviation"] for r in huge}[0] is None


def test_nothing_to_whiten(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        df = w.whiten(table(spark, vectors))
        assert df.collect() == [] and df.columns[:2] == ["vec_id", "component"]


def test_rank_below_the_components(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(a), float(b), float(a), 0.0] for a, b in rng.integers(-50, 50, size=(40, 2))]
    rows = w.whiten(table(spark, vectors)).collect()
    assert {r["component"] for r in rows} == {1, 2}
    check(rows, dict(enumerate(vectors)))


def test_clashing_columns(spark):
    vectors = [[1.0, 5.0], [2.0, 3.0], [0.0, 1.0]]
    df = table(spark, vectors).selectExpr("*", "1 AS x", "2 AS weight", "3 AS component", "4 AS n", "5 AS y", "6 AS deviation")
    check(w.whiten(df).collect(), dict(enumerate(vectors)))


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: [float(c) for c in r["embedding"]] for r in rows if r["embedding"] and all(c is not None and math.isfinite(c) for c in r["embedding"])}
    check(QUERIES["op12_weighted_whitening"](spark, SF).collect(), vectors)
