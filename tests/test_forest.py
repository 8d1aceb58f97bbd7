import json

import numpy as np
import pytest
from conftest import by_key
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from profilekit.operators import forest
from profilekit.operators.trees import NodeArrays, average_path, grow_tree
from profilekit.plans.analysis import analyse_outliers
from profilekit.plans.forest_job import forest_features, run_forest_job
from profilekit.sources.readers import read_params


@pytest.fixture(scope="module")
def points(spark):
    """A dense cloud with ten planted outliers, some cells missing."""
    rng = np.random.default_rng(11)
    rows = [(i, float(a), float(b) if i % 17 else None) for i, (a, b) in enumerate(rng.normal(size=(1500, 2)))]
    rows += [(5000 + i, 9.0 + i, -9.0 - i) for i in range(10)]
    return spark.createDataFrame(rows, "k long, x double, y double").repartition(3).cache()


def small_forest(**options):
    return forest.IsolationForest("k", ["x", "y"], n_trees=40, contamination=0.02, **options)


def test_average_path():
    assert list(average_path([0, 1, 2])) == [0, 0, 1]
    assert average_path(256) == pytest.approx(10.244, abs=1e-3)


def walk_one(nodes, row):
    """Path of one row, step by step."""
    node, depth = 0, 0
    while nodes["feature"][node] >= 0:
        go = row[nodes["feature"][node]] <= nodes["threshold"][node]
        node, depth = nodes["left"][node] + (0 if go else 1), depth + 1
    return depth + float(average_path(nodes["size"][node]))


def test_batched_paths_match_single_steps():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    nodes = grow_tree(x[:200], rng, 8, np.arange(3))
    arrays = NodeArrays(
        roots=np.array([0]), feature=np.maximum(nodes["feature"], 0), threshold=np.array(nodes["threshold"]),
        left=np.array(nodes["left"]), expected=nodes["expected"], depth_limit=8,
        normaliser=float(average_path(200)),
    )
    got = arrays.path_lengths(x, [1])[:, 0]
    assert got == pytest.approx([walk_one(nodes, r) for r in x])
    assert arrays.attributions(x).sum(axis=1) == pytest.approx(got - arrays.expected_path())
    assert nodes["expected"][0] == pytest.approx(np.mean([walk_one(nodes, r) for r in x[:200]]))


def test_planted_outliers_rank_first_and_share_holds(points):
    out = small_forest().fit_transform(points)
    top = [r.k for r in forest.ordered_outliers(out, "k").limit(10).collect()]
    assert all(k >= 5000 for k in top)
    assert out.agg(F.sum("forest_outlier")).first()[0] == pytest.approx(0.02 * 1510, abs=2)
    assert out.where("(forest_outlier = 1) != (anomaly_score > 0)").count() == 0


def test_result_does_not_depend_on_partitioning(points):
    first = by_key(small_forest().fit_transform(points), "k")
    second = by_key(small_forest().fit_transform(points.repartition(7, "y")), "k")
    assert {k: r.forest_outlier for k, r in first.items()} == {k: r.forest_outlier for k, r in second.items()}
    assert all(r.anomaly_score == pytest.approx(second[k].anomaly_score, abs=1e-9) for k, r in first.items())
    other = by_key(small_forest(seed=7).fit_transform(points), "k")
    assert any(abs(r.anomaly_score - other[k].anomaly_score) > 1e-6 for k, r in first.items())


@pytest.mark.parametrize("n", [60_000, 3_000, 64])
def test_draw_gives_full_trees(spark, n):
    """One rule fills every tree with distinct rows, of a table of any size."""
    features = spark.range(n).select(F.xxhash64("id").alias("row_hash"), F.col("id").cast("double").alias("f0"))
    drawn = forest._draw(features, 20, 64, n, 42, True)
    rows = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("f0").alias("d"), F.avg("f0").alias("m")).collect()
    assert len(rows) == 20 and all(r.n == 64 and r.d == 64 for r in rows)
    assert np.mean([r.m for r in rows]) == pytest.approx(n / 2, rel=0.1)


def test_a_repeated_key_still_gives_a_fair_sample(spark):
    """A third of the rows share one key; they must be drawn at their share, not all or none."""
    n = 60_000
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
    features = spark.range(n).select(F.xxhash64(key).alias("row_hash"), (F.col("id") % 3 == 0).cast("double").alias("f0"))
    drawn = forest._draw(features, 20, 256, n, 42, False)
    row = drawn.agg(F.count("*").alias("n"), F.avg("f0").alias("hot")).first()
    assert row.n == 20 * 256 and row.hot == pytest.approx(1 / 3, abs=0.05)


def test_copies_are_noticed(spark):
    """A third of the table is one repeated row; the trees see it at that share."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.col("id") % 1000 + 1.0).alias("x"),
    )
    model = forest.IsolationForest("k", ["x"], n_trees=30, contamination="auto").grow(df)
    repeated = model.node_size[(model.node_feature < 0) & (model.node_size > 60)]
    assert len(repeated) == 30 and repeated.mean() / 256 == pytest.approx(1 / 3, abs=0.04)


def test_sign_convention(points):
    flag = by_key(small_forest().fit_transform(points), "k")
    sign = by_key(small_forest(label="sign").fit_transform(points), "k")
    for k, r in flag.items():
        assert sign[k].forest_outlier == sign[k].predicted_outlier == (-1 if r.forest_outlier else 1)
        assert sign[k].anomaly_score == pytest.approx(-r.anomaly_score)


def test_options(points):
    model = small_forest(max_features=0.5, bootstrap=True, fill=False, scale=False).fit(points)
    assert model.transform(points).where("forest_outlier = 1").count() > 0
    auto = forest.IsolationForest("k", ["x", "y"], n_trees=40, contamination="auto").fit(points)
    assert auto.threshold == 0.5
    with pytest.raises(ValueError, match="contamination"):
        forest.IsolationForest("k", contamination=0.7)
    with pytest.raises(ValueError, match="lower max_samples"):
        forest.IsolationForest("k", ["x"], n_trees=1000, max_samples=5000)
    with pytest.raises(ValueError, match="number of rows"):
        forest.IsolationForest("k", ["x"], max_samples=0.9)


def test_one_feature_and_no_shuffle(points):
    model = forest.IsolationForest("k", ["x"], n_trees=20, contamination=0.02).fit(points)
    out = model.transform(points)
    assert out.where("forest_outlier = 1").count() > 0
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_attributions_sum_to_the_path_length(points, spark):
    model = small_forest().grow(points)
    total = forest.attribution(points, model, "k").groupBy("k").agg(F.sum("value").alias("total"))
    paths = points.select("k", model.path_length(spark).alias("path"))
    worst = total.join(paths, "k").agg(F.max(F.abs(F.col("total") - (F.col("path") - model.arrays.expected_path())))).first()[0]
    assert worst < 1e-9
    importance = forest.global_importance(points, model)
    assert {r.feature for r in importance.collect()} == {"x", "y"}
    splits = forest.split_importance(model, spark).collect()
    assert sum(r.importance for r in splits) == pytest.approx(1.0)


def test_silhouette_matches_the_evaluator(points):
    model = small_forest().fit(points)
    out = model.transform(points)
    value = forest.silhouette(out, model, "forest_outlier").first().silhouette
    frame = out.select(*[e.alias(f"f{i}") for i, e in enumerate(model.features.exprs())], "forest_outlier")
    ours = forest.split_silhouettes(frame, ["f0", "f1"], [F.col("forest_outlier") == 1, F.lit(False)])
    assert ours[0] == pytest.approx(value, abs=1e-9) and ours[1] is None
    vectors = VectorAssembler(inputCols=["f0", "f1"], outputCol="features").transform(
        frame.withColumn("prediction", F.col("forest_outlier").cast("double"))
    )
    assert value == pytest.approx(ClusteringEvaluator().evaluate(vectors))


def test_grid_reuses_tree_prefixes(points):
    grid = forest.search_grid(points, "k", ["x", "y"], (10, 20), (0.01, 0.05), ("auto", 600))
    rows = grid.orderBy("grid_order").collect()
    assert len(rows) == 8
    for r in rows:
        assert r.flagged_share == pytest.approx(r.contamination, abs=0.002)
        assert r.penalised_score == pytest.approx(r.mean_score - 10 * abs(r.flagged_share - r.contamination))
    assert rows[0].mean_score == rows[1].mean_score
    single = forest.IsolationForest("k", ["x", "y"], 10, 0.05).fit(points)
    assert single.threshold == pytest.approx(rows[1].threshold)
    best = forest.best_params(grid)
    assert best["contamination"] == 0.01 and best["n_trees"] in (10, 20)


def test_tuned_parameters_from_file(points, tmp_path):
    path = tmp_path / "params.json"
    path.write_text(json.dumps({"n_trees": 12, "contamination": 0.1, "max_samples": 64, "seed": 1}))
    model, params = forest.tuned_forest(points, "k", ["x", "y"], params_file=str(path))
    assert model.trees == 12 and model.per_tree == 64 and params["contamination"] == 0.1
    written = tmp_path / "new.json"
    forest.tuned_forest(points, "k", ["x", "y"], str(written), grid={"n_trees": (5,), "contamination": (0.05,)})
    assert read_params(points.sparkSession, str(written))["n_trees"] == 5
    again, _ = forest.tuned_forest(points, "k", ["x", "y"], str(written), tune=False)
    assert again.trees == 5
    _, defaults = forest.tuned_forest(points, "k", ["x", "y"], tune=False, n_trees=5)
    assert defaults == forest.DEFAULT_PARAMS


def test_job(points):
    df = points.withColumn("iqr_out_x", F.lit(0)).withColumn("esg_score", F.lit(1.0))
    assert forest_features(df, "k", "esg_score") == ["x", "y"]
    job = run_forest_job(df, "k", "esg_score", tune=False)
    exported = job.outliers("k").collect()
    assert [r.anomaly_score for r in exported] == sorted(r.anomaly_score for r in exported)
    assert all(r.forest_outlier_tuned == -1 for r in exported) and exported[0].k >= 5000
    compared = job.comparison("k").collect()
    assert [r.k for r in compared] == sorted(r.k for r in compared)
    assert any(r.exclusive for r in compared) and all(r.in_first or r.in_second for r in compared)
    imputed = job.imputed(["x", "y"])
    flagged = imputed.where("forest_outlier_tuned = -1").select("forest_mod_x").distinct().collect()
    assert len(flagged) == 1
    histogram = forest.score_histogram(job.scored, "forest_outlier_tuned", "anomaly_score", -1)
    totals = {r["class"]: r.total for r in histogram.groupBy("class").agg(F.sum("count").alias("total")).collect()}
    assert totals["outlier"] == len(exported) and sum(totals.values()) == 1510


def test_whole_outlier_analysis_with_tuning(points, monkeypatch):
    monkeypatch.setattr(forest, "SMALL_GRID_TREES", (5, 10))
    result = analyse_outliers(points, "k", tune=True)
    assert {"forest_outlier", "anomaly_score", "forest_out_tuned_", "anomaly_score_tuned"} <= set(result.flagged.columns)
    counts = by_key(result.forest_counts, "variable")
    assert counts["x"]["outliers"] >= counts["y"]["outliers"] > 0
    assert result.tuned_params["n_trees"] in (50, 100, 200)


def test_decision_paths_add_up(points):
    model = small_forest().fit(points)
    rows = points.where("k % 50 = 1 or k > 5003")
    paths = forest.decision_paths(rows, model, "k").collect()
    assert paths[0].asDict().keys() == {"k", "tree", "step", "feature", "threshold", "value", "side", "rest"}
    lengths = {r.k: r.length for r in rows.select("k", model.path_length(points.sparkSession).alias("length")).collect()}
    leaves, splits = {}, {}
    for p in paths:
        if p.side == "leaf":
            assert p.feature is None and p.threshold is None and p.value is None
            leaves.setdefault(p.k, {})[p.tree] = p.step + p.rest
            splits.setdefault((p.k, p.tree), []).append((p.step, None))
        else:
            assert p.feature in ("x", "y") and p.rest is None and p.side == ("left" if p.value <= p.threshold else "right")
            splits.setdefault((p.k, p.tree), []).append((p.step, p.feature))
    assert set(leaves) == set(lengths)
    for k, trees in leaves.items():
        assert len(trees) == 40 and np.mean(list(trees.values())) == pytest.approx(lengths[k], rel=1e-12)
    # The splits of a row in a tree are numbered without gaps, the leaf last.
    for steps in splits.values():
        assert sorted(s for s, _ in steps) == list(range(len(steps)))


def test_forests_together_equal_each_by_itself(points):
    first = small_forest(flag_column="a", score_column="sa").fit(points)
    second = forest.IsolationForest("k", ["y"], n_trees=15, contamination=0.05, scale=False, fill=False, label="sign", flag_column="b", score_column="sb", seed=5).fit(points)
    together = forest.transform_together(points, [first, second])
    apart = second.transform(first.transform(points))
    assert together.columns == apart.columns
    a, b = by_key(together, "k"), by_key(apart, "k")
    for k, r in a.items():
        assert (r.a, r.b) == (b[k].a, b[k].b) and (r.sa, r.sb) == pytest.approx((b[k].sa, b[k].sb), abs=1e-9)
    plan = together.select("k", "a", "b", "sa", "sb")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_paths_are_handed_on_tree_by_tree_as_arrays():
    import numpy as np

    from profilekit.operators.trees import NodeArrays, average_path, grow_tree

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    nodes = {k: np.array(v) for k, v in grow_tree(x, rng, 8, np.arange(2)).items()}
    forest_of_one = NodeArrays(
        np.array([0]), np.maximum(nodes["feature"], 0), nodes["threshold"], nodes["left"], nodes["expected"], 8, float(average_path(200))
    )
    (found,) = forest_of_one.paths(x)
    leaf = found["side"] == 2
    assert leaf.sum() == 200 and all(isinstance(v, np.ndarray) for v in found.values())
    whole = forest_of_one.path_lengths(x, [1])[:, 0]
    assert np.allclose((found["step"] + found["rest"])[leaf][np.argsort(found["row"][leaf])], whole)
    assert ((found["value"] > found["threshold"])[~leaf] == (found["side"][~leaf] == 1)).all()
