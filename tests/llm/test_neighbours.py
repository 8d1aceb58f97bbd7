import numpy as np
import pytest
from pyspark.sql import functions as F

from profilekit.llm import queries
from profilekit.llm.neighbours import nearest

SF = "/root/testdata/sf0.01"


def brute(ids, x, asked, k):
    out = {}
    for i in asked:
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, answer in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(answer)
        assert [m[1:] for m in mine] == [m[1:] for m in sorted(mine, key=lambda m: (-m[2], m[1]))]
        hits += len({v for v, _ in answer} & {m[1] for m in mine})
        total += len(answer)
    return hits / total


@pytest.mark.parametrize("block", [8192, 120])
def test_recall_on_the_table(spark, block):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids = np.array([r.vec_id for r in table.select("vec_id").collect()])
    x = np.array([r.embedding for r in table.select("embedding").collect()], float)
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    rows = nearest(table, F.col("vec_id") % 20 == 0, block=block).collect()
    assert recall(rows, want) >= 0.9
    exact = {(q, v): s for q, answer in want.items() for v, s in answer}
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], abs=1e-12) for r in rows if (r.query_id, r.vec_id) in exact)
    if block == 8192:
        assert sorted(map(tuple, queries.QUERIES["op6_collision_neighbours"](spark, SF).collect())) == sorted(map(tuple, rows))


def test_copies_ties_and_norms(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)) * rng.uniform(0.2, 3, (300, 1))
    x[100:260] = x[5]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = brute(np.arange(300), x, range(0, 300, 20), 20)
    got = nearest(table, F.col("vec_id") % 20 == 0, block=97).collect()
    assert recall(got, want) >= 0.95
    mine = [r.vec_id for r in sorted((r for r in got if r.query_id == 120), key=lambda r: r["rank"])]
    if mine[0] == want[120][0][0]:
        assert mine == [v for v, _ in want[120]]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0, 0.0], [nan, 1.0], [1.0, inf], [None, 1.0]]
    rows = [(20 * i, v) for i, v in enumerate(bad)] + [(None, [1.0, 0.0]), (1000, [1.0, 0.0]), (1001, [0.5, 0.5]), (1000, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = nearest(table, F.col("vec_id") % 20 == 0).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(1000, 1001)}
    assert nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
