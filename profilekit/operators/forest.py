"""Isolation Forest as Spark jobs: draw rows, grow trees in parallel, score with the broadcast nodes.

Row-scale steps are DataFrame work. The drawn sample and the grown nodes are
bounded by ``MAX_SAMPLED_ROWS``, whatever the size of the table, so nothing
that grows with the data reaches one task, the driver or a broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from profilekit.functions.expressions import hash_share, literal
from profilekit.operators.base import Fitted, Learner
from profilekit.operators.moments import column_moments
from profilekit.operators.profile import histogram
from profilekit.operators.quantiles import column_quantiles
from profilekit.operators.schema import null_if_nan, numeric_columns
from profilekit.operators.trees import NodeArrays, average_path, grow_tree
from profilekit.runtime import col
from profilekit.sources.readers import read_params
from profilekit.sources.sinks import write_manifest

# Trees x rows per tree. Keeps the node arrays at a few tens of megabytes.
MAX_SAMPLED_ROWS = 1_000_000
# Share of distinct rows from which rows are drawn by their hash alone.
DISTINCT_SHARE = 0.95

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, size int, depth int, expected double"
)

PATH_SCHEMA = "tree int, step int, feature int, threshold double, value double, side string, rest double"
# Rows whose paths through one tree are handed on at once.
PATH_ROWS = 1024

# The search grids and the parameters used when nothing is tuned.
GRID_TREES = (50, 100, 200, 300)
GRID_CONTAMINATION = (0.01, 0.025, 0.05, 0.075, 0.1)
SMALL_GRID_TREES = (50, 100, 200)
SMALL_GRID_CONTAMINATION = (0.01, 0.05, 0.1)
DEFAULT_PARAMS = {"contamination": 0.01, "n_trees": 100, "max_samples": "auto", "seed": 42}


# Rows per tree in the grid. A share of the table is no choice here: a tree is grown in one task, so its rows must not grow
# with the table.
GRID_MAX_SAMPLES = ("auto", 128, 512, 1024)


def check_samples(max_samples: int | str, n_trees: int) -> int:
    """Rows per tree (``auto`` is 256); refuses a share of the table and forests too large for one driver, at any table size."""
    if isinstance(max_samples, float):
        raise ValueError("max_samples is a number of rows or 'auto': a tree is grown in one task")
    rows = 256 if max_samples == "auto" else int(max_samples)
    if rows * n_trees > MAX_SAMPLED_ROWS:
        raise ValueError(f"{n_trees} trees of {rows} rows exceed {MAX_SAMPLED_ROWS} sampled rows; lower max_samples")
    return rows


def sample_rows(max_samples: int | str, n: int) -> int:
    """Rows per tree, never more than the table."""
    return min(256 if max_samples == "auto" else int(max_samples), n)


def _slack(expected: float) -> float:
    return expected + 8 * math.sqrt(expected) + 16


class _Features:
    """Feature expressions: optional mean fill and optional standard scaling."""

    def __init__(self, df: DataFrame, columns: Sequence[str], fill: bool, scale: bool):
        self.columns = list(columns)
        self.rows = None
        self.means: dict[str, float | None] = {}
        self.divisors: dict[str, float] = {}
        moments = column_moments(df, {c: col(c) for c in columns}) if fill or scale else {}
        for c in columns:
            m = moments.get(c)
            self.means[c] = m.mean if m else None
            # Filling with the mean keeps the mean and shrinks the spread; the
            # forest itself does not depend on the unit of a feature.
            self.divisors[c] = 1.0 if m is None or m.constant else m.std_pop
        self.fill, self.scale = fill, scale

    def exprs(self) -> list[Column]:
        out = []
        for c in self.columns:
            e = col(c).cast("double")
            if self.fill:
                e = F.coalesce(e, literal(self.means[c]))
            if self.scale:
                e = (e - literal(self.means[c])) / literal(self.divisors[c])
            out.append(e)
        return out


def _draw(rows: DataFrame, trees: int, per_tree: int, n: int, seed: int, distinct: bool) -> DataFrame:
    """``(tree, share, rank, f0..)``: ``per_tree`` rows for each tree, chosen by hash of ``row_hash``.

    With mostly distinct hashes the choice depends on the rows alone, not on
    the partitioning. Copies share a hash and would be drawn all or none, so
    where they are many the row number is mixed in.
    """
    names = [c for c in rows.columns if c != "row_hash"]
    if not distinct:
        rows = rows.withColumn("row_hash", F.xxhash64("row_hash", F.monotonically_increasing_id()))
    # A row first passes for the forest, then draws for each tree: at any size only about trees x per_tree rows meet the
    # trees, and each tree has each row with the same chance.
    chance = min(1.0, _slack(per_tree) / n)
    passing = min(1.0, trees * chance)
    rows = rows.where(hash_share(seed, F.lit("forest"), F.col("row_hash")) < passing)
    pairs = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = pairs.withColumn("share", hash_share(seed, F.col("row_hash"), F.col("tree"))).where(F.col("share") < chance / passing)
    # A fixed partition count: adaptive coalescing goes by bytes and would put all trees in one task.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    drawn = drawn.repartition(min(trees, max(cores, 8)), "tree")
    order = Window.partitionBy("tree").orderBy("share", *names)
    return drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree).drop("row_hash")


def _grow(sample: DataFrame, n_features: int, depth_limit: int, seed: int, max_features: float, bootstrap: bool) -> DataFrame:
    names = [f"f{i}" for i in range(n_features)]
    columns = NODE_SCHEMA.replace(" int", "").replace(" double", "").split(", ")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = pdf.sort_values("rank")[names].to_numpy(dtype=float)
        used = max(1, int(max_features * n_features))
        chosen = np.sort(rng.choice(n_features, used, replace=False)) if used < n_features else np.arange(n_features)
        if bootstrap:
            x = x[rng.integers(len(x), size=len(x))]
        nodes = grow_tree(x, rng, depth_limit, chosen)
        out = pd.DataFrame(nodes)
        out["tree"], out["node"] = tree, np.arange(len(out))
        return out[columns]

    return sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


class ForestModel(Fitted):
    """Grown trees plus the score threshold.

    ``label="flag"``: 1 marks an outlier and a high ``anomaly_score`` is
    anomalous. ``label="sign"``: -1 marks an outlier, 1 an inlier, and a low
    score is anomalous.
    """

    def __init__(self, features: _Features, nodes, trees: int, per_tree: int, depth_limit: int, n: int):
        super().__init__()
        self.features, self.trees, self.per_tree, self.rows = features, trees, per_tree, n
        self.threshold = 0.5
        self.flag_column, self.score_column, self.label = "forest_outlier", "anomaly_score", "flag"
        order = np.lexsort((nodes["node"], nodes["tree"]))
        tree, node = nodes["tree"][order], nodes["node"][order]
        starts = np.flatnonzero(node == 0)
        offset = np.repeat(starts, np.diff(np.append(starts, len(node))))
        self.node_tree, self.node_feature, self.node_size = tree, nodes["feature"][order], nodes["size"][order]
        self.arrays = NodeArrays(
            roots=starts, feature=np.maximum(self.node_feature, 0).astype(np.int64), threshold=nodes["threshold"][order],
            left=nodes["left"][order] + offset, expected=nodes["expected"][order], depth_limit=depth_limit,
            normaliser=float(average_path(per_tree)) or 1.0,
        )
        self._broadcast = None

    def _shipped(self, spark):
        if self._broadcast is None:
            # Plain arrays: unlike the UDF, a broadcast value cannot bring its class along.
            self._broadcast = spark.sparkContext.broadcast(dict(vars(self.arrays)))
        return self._broadcast

    def _per_batch(self, spark, returns: str, compute) -> Column:
        """A pandas UDF over the feature columns only; other columns never leave the JVM."""
        shipped = self._shipped(spark)

        @F.pandas_udf(returns)
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            arrays = NodeArrays(**shipped.value)
            for batch in batches:
                # A single argument comes as it is, not in a tuple.
                columns = [batch] if isinstance(batch, pd.Series) else batch
                x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
                yield pd.Series(compute(arrays, x))

        # One array argument would be a list per row; separate columns arrive as arrays.
        return run(*self.features.exprs())

    def score(self, spark) -> Column:
        trees = self.trees
        return self._per_batch(spark, "double", lambda forest, x: forest.scores(x, [trees])[:, 0])

    def prefix_scores(self, spark, prefixes: Sequence[int]) -> Column:
        """Scores of the forests made of the first k trees, as one array per row."""
        wanted = list(prefixes)
        return self._per_batch(spark, "array<double>", lambda forest, x: list(forest.scores(x, wanted)))

    def path_length(self, spark) -> Column:
        trees = self.trees
        return self._per_batch(spark, "double", lambda forest, x: forest.path_lengths(x, [trees])[:, 0])

    def attribution(self, spark) -> Column:
        return self._per_batch(spark, "array<double>", lambda forest, x: list(forest.attributions(x)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = dataset.withColumn("__score", self.score(dataset.sparkSession))
        return self.flagged(scored, F.col("__score")).drop("__score")

    def flagged(self, scored: DataFrame, score: Column) -> DataFrame:
        """``scored`` with the model's columns, from its scores."""
        distance = score - F.lit(float(self.threshold))
        outlier = distance > 0
        if self.label == "sign":
            flag, anomaly = F.when(outlier, -1).otherwise(1), -distance
        else:
            flag, anomaly = outlier.cast("int"), distance
        added = {self.flag_column: flag}
        if self.score_column:
            added[self.score_column] = anomaly
        if self.label == "sign" and self.score_column:
            added["predicted_outlier"] = flag
        return scored.withColumns(added)

    def nodes_table(self, spark) -> DataFrame:
        """``(tree, feature, size)`` of all splitting nodes."""
        split = self.node_feature >= 0
        names = np.array(self.features.columns, dtype=object)
        pdf = pd.DataFrame(
            {"tree": self.node_tree[split], "feature": names[self.node_feature[split]], "size": self.node_size[split]}
        )
        return spark.createDataFrame(pdf, "tree int, feature string, size int")


def transform_together(df: DataFrame, models: Sequence[ForestModel]) -> DataFrame:
    """``df`` with the columns of several forests, all scored by one function over the union of their features.

    Only raw feature columns go to the Python workers, each once; filling and scaling are done there.
    """
    df = null_if_nan(df)
    spark = df.sparkSession
    columns = list(dict.fromkeys(c for m in models for c in m.features.columns))
    shipped = [m._shipped(spark) for m in models]
    trees = [m.trees for m in models]
    picks = [[columns.index(c) for c in m.features.columns] for m in models]
    nan = float("nan")
    fills, shifts, divisors = [], [], []
    for m in models:
        means = np.array([nan if m.features.means[c] is None else m.features.means[c] for c in m.features.columns])
        fills.append(means if m.features.fill else np.full(len(means), nan))
        shifts.append(means if m.features.scale else np.zeros(len(means)))
        divisors.append(np.array([m.features.divisors[c] if m.features.scale else 1.0 for c in m.features.columns]))

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forests = [NodeArrays(**s.value) for s in shipped]
        for batch in batches:
            parts = [batch] if isinstance(batch, pd.Series) else batch
            raw = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in parts])
            out = np.empty((len(raw), len(forests)))
            for i, forest in enumerate(forests):
                x = raw[:, picks[i]]
                x = (np.where(np.isnan(x), fills[i], x) - shifts[i]) / divisors[i]
                out[:, i] = forest.scores(x, [trees[i]])[:, 0]
            yield pd.Series(list(out))

    scored = df.withColumn("__scores", scores(*[col(c).cast("double") for c in columns]))
    for i, m in enumerate(models):
        scored = m.flagged(scored, F.col("__scores")[i])
    return scored.drop("__scores")


def decision_paths(df: DataFrame, model: ForestModel, key: str) -> DataFrame:
    """``(key, tree, step, feature, threshold, value, side, rest)``: how the rows of ``df`` come to their scores.

    A row for each split that a row passes, with the value it is asked for, and one for the leaf of each tree (``side`` is
    ``leaf``), where ``step`` is the number of splits before and ``rest`` the mean path that the rows of the leaf would still
    take. Over the trees, the mean of ``step + rest`` at the leaves is the path length of the row. Thresholds and values are
    in the unit of the model's features, after filling and scaling.
    """
    df = null_if_nan(df)
    features = [f"__f{i}" for i in range(len(model.features.columns))]
    rows = df.select(col(key).alias("__key"), *[e.alias(f) for f, e in zip(features, model.features.exprs())])
    schema = T.StructType([T.StructField("__key", rows.schema["__key"].dataType), *T.StructType.fromDDL(PATH_SCHEMA).fields])
    arrow, shipped = to_arrow_schema(schema), model._shipped(df.sparkSession)
    types, most = {f.name: f.type for f in arrow}, PATH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = NodeArrays(**shipped.value)
        sides = pa.array(["left", "right", "leaf"])
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                x = np.column_stack([part.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
                for found in arrays.paths(x):
                    leaf = found["side"] == 2
                    masks = {"threshold": leaf, "value": leaf, "rest": ~leaf}
                    columns = [part.column("__key").take(pa.array(found["row"]))]
                    for name in arrow.names[1:]:
                        values = sides.take(pa.array(found["side"])) if name == "side" else pa.array(found[name], mask=masks.get(name))
                        columns.append(values.cast(types[name]))
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    nodes = rows.mapInArrow(run, schema)
    names = F.array(*[F.lit(c) for c in model.features.columns])
    named = F.when(F.col("feature") >= 0, F.get(names, F.col("feature"))).alias("feature")
    return nodes.select(F.col("__key").alias(key), "tree", "step", named, "threshold", "value", "side", "rest")


class IsolationForest(Learner):
    """Fit trees and, for a numeric ``contamination``, the score threshold.

    The hash of the ``key`` columns and the features decides which rows are drawn.
    ``max_samples`` is a number of rows or ``auto`` (256); over all trees it must
    stay within ``MAX_SAMPLED_ROWS``.
    """

    def __init__(
        self,
        key: str | Sequence[str],
        features: Sequence[str] | None = None,
        n_trees: int = 100,
        contamination: float | str = 0.05,
        max_samples: int | str = "auto",
        max_features: float = 1.0,
        bootstrap: bool = False,
        seed: int = 42,
        fill: bool = True,
        scale: bool = True,
        flag_column: str = "forest_outlier",
        score_column: str | None = "anomaly_score",
        label: str = "flag",
    ):
        super().__init__()
        if label not in ("flag", "sign"):
            raise ValueError("label must be 'flag' or 'sign'")
        if contamination != "auto" and not 0 < contamination <= 0.5:
            raise ValueError("contamination must be in (0, 0.5]")
        check_samples(max_samples, n_trees)
        self.key = [key] if isinstance(key, str) else list(key)
        self.feature_columns, self.n_trees, self.contamination = features, n_trees, contamination
        self.max_samples, self.max_features, self.bootstrap, self.seed = max_samples, max_features, bootstrap, seed
        self.fill, self.scale = fill, scale
        self.flag_column, self.score_column, self.label = flag_column, score_column, label

    def grow(self, dataset: DataFrame) -> ForestModel:
        """Trees without a fitted threshold."""
        columns = (
            list(self.feature_columns) if self.feature_columns is not None else numeric_columns(dataset, self.key)
        )
        if not columns:
            raise ValueError("no feature columns")
        row_hash = F.xxhash64(*[col(c) for c in [*self.key, *columns]])
        hashes = F.hll_sketch_estimate(F.hll_sketch_agg(row_hash, F.lit(12)))
        seen = dataset.agg(F.count("*").alias("n"), hashes.alias("hashes")).first()
        n = seen["n"]
        if n == 0:
            raise ValueError("table is empty")
        per_tree = sample_rows(self.max_samples, n)
        features = _Features(dataset, columns, self.fill, self.scale)
        frame = dataset.select(
            row_hash.alias("row_hash"),
            *[e.alias(f"f{i}") for i, e in enumerate(features.exprs())],
        )
        sample = _draw(frame, self.n_trees, per_tree, n, self.seed, seen["hashes"] >= DISTINCT_SHARE * n)
        depth_limit = max(1, math.ceil(math.log2(max(per_tree, 2))))
        nodes = _grow(sample, len(columns), depth_limit, self.seed, self.max_features, self.bootstrap).toArrow()
        arrays = {name: nodes.column(name).to_numpy() for name in nodes.column_names}
        model = ForestModel(features, arrays, self.n_trees, per_tree, depth_limit, n)
        model.flag_column, model.score_column, model.label = self.flag_column, self.score_column, self.label
        return model

    def _fit(self, dataset: DataFrame) -> ForestModel:
        model = self.grow(dataset)
        if self.contamination != "auto":
            model.threshold = _thresholds(
                dataset.select(
                    model.score(dataset.sparkSession).alias("s0")
                ),
                ["s0"], [self.contamination],
            )["s0"][0]
        return model


def _thresholds(scores: DataFrame, names: Sequence[str], contamination: Sequence[float]) -> dict[str, list[float]]:
    """Score quantiles that leave the wanted shares above them.

    The scores cost a pass over the trees, so they are kept on disk while the
    quantile passes read them; a lost block is recomputed.
    """
    scores = scores.persist(StorageLevel.DISK_ONLY)
    try:
        return column_quantiles(scores, {s: F.col(s) for s in names}, [1 - c for c in contamination])
    finally:
        scores.unpersist()


def search_grid(
    df: DataFrame,
    key: str | Sequence[str],
    features: Sequence[str] | None = None,
    n_trees: Sequence[int] = SMALL_GRID_TREES,
    contamination: Sequence[float] = SMALL_GRID_CONTAMINATION,
    max_samples: Sequence[int | str] = ("auto",),
    seed: int = 42,
    silhouette: bool = True,
) -> DataFrame:
    """One row per parameter combination with its objectives.

    The largest forest of each sample size is grown once; its first k trees are
    the smaller forests, and every contamination is a quantile of the same
    scores. ``penalised_score`` is the mean score minus ten times the
    distance of the flagged share from the contamination.
    """
    spark = df.sparkSession
    sizes = sorted(n_trees)
    columns = list(features) if features is not None else numeric_columns(df, [key] if isinstance(key, str) else key)
    # A small file is one task, and scoring with every tree costs more than the exchange.
    df = df.repartition(spark.sparkContext.defaultParallelism)
    n = df.count()
    rows = []
    grown: dict[int, list] = {}
    for wanted in max_samples:
        check_samples(wanted, sizes[-1])
    for wanted in max_samples:
        per_tree = sample_rows(wanted, n)
        if per_tree not in grown:
            model = IsolationForest(key, columns, sizes[-1], "auto", per_tree, seed=seed).grow(df)
            grown[per_tree] = _grid_block(df, model, sizes, contamination, silhouette)
        found = {(k, c): values for k, c, *values in grown[per_tree]}
        for k in sizes:
            for c in contamination:
                rows.append((str(wanted), per_tree, k, float(c), *found[k, c], len(rows)))
    return spark.createDataFrame(
        rows,
        "max_samples string, sample_rows int, n_trees int, contamination double, threshold double, "
        "mean_score double, flagged_share double, penalised_score double, silhouette double, grid_order int",
    )


def _grid_block(df, model: ForestModel, sizes: Sequence[int], contamination: Sequence[float], silhouette: bool) -> list:
    spark = df.sparkSession
    names = [f"s{i}" for i in range(len(sizes))]
    d = len(model.features.columns)
    scored = df.select(
        *[e.alias(f"f{i}") for i, e in enumerate(model.features.exprs())],
        model.prefix_scores(spark, sizes).alias("scores"),
    ).select(*[f"f{i}" for i in range(d)], *[F.col("scores")[i].alias(s) for i, s in enumerate(names)])
    scored = scored.persist(StorageLevel.DISK_ONLY)
    try:
        thresholds = column_quantiles(scored, {s: F.col(s) for s in names}, [1 - c for c in contamination])
        flags = {
            (k, c): F.col(s) > F.lit(thresholds[s][j])
            for k, s in zip(sizes, names)
            for j, c in enumerate(contamination)
        }
        row = scored.agg(
            F.count("*").alias("n"),
            *[F.avg(s).alias(f"m_{s}") for s in names],
            *[F.count_if(f).alias(f"c{i}") for i, f in enumerate(flags.values())],
        ).first()
        widths = split_silhouettes(scored, [f"f{i}" for i in range(d)], list(flags.values())) if silhouette else None
    finally:
        scored.unpersist()
    out = []
    for i, (k, c) in enumerate(flags):
        s = names[list(sizes).index(k)]
        mean, share = row[f"m_{s}"], row[f"c{i}"] / row["n"]
        threshold = thresholds[s][list(contamination).index(c)]
        out.append((k, c, threshold, mean, share, mean - 10 * abs(share - c), widths[i] if widths else None))
    return out


def split_silhouettes(df: DataFrame, features: Sequence[str], flags: Sequence[Column]) -> list[float | None]:
    """Squared-distance silhouette of several flagged/unflagged splits, in two aggregations for all of them.

    The mean squared distance from a point to a cluster follows from the
    cluster's count, sum vector and sum of squared norms, so no pairs are
    formed. None where one side of a split is empty.
    """
    x = [F.coalesce(F.col(f), F.lit(0.0)) for f in features]
    norm = sum((v * v for v in x), F.lit(0.0))

    def sums(tag: str, keep: Column | None) -> list[Column]:
        def pick(v):
            return v if keep is None else F.when(keep, v)

        return [
            F.count(pick(F.lit(1))).alias(f"{tag}_n"), F.sum(pick(norm)).alias(f"{tag}_q"),
            *[F.sum(pick(v)).alias(f"{tag}_{j}") for j, v in enumerate(x)],
        ]

    row = df.agg(*sums("all", None), *[a for i, f in enumerate(flags) for a in sums(f"g{i}", f)]).first()

    def side(tag: str):
        return row[f"{tag}_n"], row[f"{tag}_q"] or 0.0, [row[f"{tag}_{j}"] or 0.0 for j in range(len(x))]

    total_n, total_q, total_s = side("all")
    widths, index = [], []
    for i, flag in enumerate(flags):
        n1, q1, s1 = side(f"g{i}")
        n0, q0, s0 = total_n - n1, total_q - q1, [a - b for a, b in zip(total_s, s1)]
        if n1 == 0 or n0 == 0:
            continue

        def distance(n, q, s):
            dot = sum((v * F.lit(2.0 * float(c) / n) for v, c in zip(x, s)), F.lit(0.0))
            return norm + F.lit(float(q) / n) - dot

        def width(own, other):
            n, q, s = own
            a = distance(n, q, s) * F.lit(n / (n - 1)) if n > 1 else None
            if a is None:
                return F.lit(0.0)
            b = distance(*other)
            return F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))

        ones, zeros = (n1, q1, s1), (n0, q0, s0)
        widths.append(F.avg(F.when(flag, width(ones, zeros)).otherwise(width(zeros, ones))).alias(f"w{i}"))
        index.append(i)
    out: list[float | None] = [None] * len(flags)
    if widths:
        found = df.agg(*widths).first()
        for i in index:
            out[i] = found[f"w{i}"]
    return out


def silhouette(df: DataFrame, model: ForestModel, flag: str) -> DataFrame:
    """One row: squared-distance silhouette of the flagged/unflagged split on the model's features."""
    exprs = model.features.exprs()
    assembled = VectorAssembler(inputCols=[f"f{i}" for i in range(len(exprs))], outputCol="features").transform(
        df.select(col(flag).cast("double").alias("prediction"), *[e.alias(f"f{i}") for i, e in enumerate(exprs)])
    )
    value = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(assembled)
    return df.sparkSession.createDataFrame([(float(value),)], "silhouette double")


def best_params(grid: DataFrame, objective: str = "mean_score", seed: int = 42) -> dict:
    """Parameters with the largest objective; the earliest grid point wins a tie."""
    row = grid.where(F.col(objective).isNotNull()).orderBy(F.desc(objective), "grid_order").first()
    if row is None:
        return dict(DEFAULT_PARAMS)
    return {
        "n_trees": row["n_trees"], "contamination": row["contamination"], "max_samples": row["sample_rows"], "seed": seed,
    }


def tuned_forest(
    df: DataFrame,
    key: str | Sequence[str],
    features: Sequence[str] | None = None,
    params_file: str | None = None,
    tune: bool = True,
    objective: str = "mean_score",
    grid: Mapping | None = None,
    **options,
) -> tuple[ForestModel, dict]:
    """Forest with parameters from a file, else from a grid search, else the defaults. Returns model and parameters."""
    spark = df.sparkSession
    params = read_params(spark, params_file, {}) if params_file is not None else {}
    if not params and tune:
        table = search_grid(df, key, features, silhouette=objective == "silhouette", **(grid or {}))
        params = best_params(table, objective)
        if params_file is not None:
            write_manifest(spark, params, params_file)
    params = params or dict(DEFAULT_PARAMS)
    return IsolationForest(key, features, **{**params, **options}).fit(df), params


def compare_flags(df: DataFrame, key: str, first: str, second: str, value: int = 1) -> DataFrame:
    """``(key, in_first, in_second, exclusive)`` for every key flagged by either model, sorted by key."""
    a, b = col(first) == value, col(second) == value
    return (
        df.where(a | b)
        .select(col(key), a.cast("int").alias("in_first"), b.cast("int").alias("in_second"))
        .withColumn("exclusive", F.when((F.col("in_first") == 1) & (F.col("in_second") == 0), 1).otherwise(0))
        .orderBy(col(key))
    )


def ordered_outliers(df: DataFrame, key: str, flag: str = "forest_outlier", score: str = "anomaly_score", value: int = 1) -> DataFrame:
    """Flagged rows, most anomalous first."""
    direction = F.asc(score) if value == -1 else F.desc(score)
    return df.where(col(flag) == value).orderBy(direction, col(key))


def score_histogram(df: DataFrame, flag: str, score: str, outlier_value: int = 1, bins: int = 30) -> DataFrame:
    """Score histogram of outliers and inliers, with the mean score of each class."""
    outlier = col(flag) == outlier_value
    return class_histogram(
        df, {"outlier": F.when(outlier, col(score)), "inlier": F.when(~outlier, col(score))}, bins
    )


def class_histogram(df: DataFrame, classes: Mapping[str, Column], bins: int = 30) -> DataFrame:
    """Histogram of each class's own values, with the mean of the class."""
    means = {n: m.mean for n, m in column_moments(df, classes).items()}
    lookup = F.create_map(*[x for n, m in means.items() for x in (F.lit(n), literal(m))])
    return histogram(df, classes, bins).select(
        F.col("variable").alias("class"), "bin", "bin_center", "count", lookup[F.col("variable")].alias("class_mean")
    )


def attribution(df: DataFrame, model: ForestModel, key: str) -> DataFrame:
    """``(key, feature, value)``: how each feature moves a row's mean path length from the forest's expectation."""
    spark = df.sparkSession
    names = F.array(*[F.lit(c) for c in model.features.columns])
    pairs = F.arrays_zip(names.alias("feature"), F.col("parts").alias("value"))
    return df.select(col(key), model.attribution(spark).alias("parts")).select(col(key), F.inline(pairs))


def global_importance(df: DataFrame, model: ForestModel, k: int = 30) -> DataFrame:
    """``(feature, importance)``: mean absolute attribution, the ``k`` largest; one aggregation without exploding."""
    parts = df.select(model.attribution(df.sparkSession).alias("parts"))
    row = parts.agg(*[F.avg(F.abs(F.col("parts")[i])).alias(f"a{i}") for i in range(len(model.features.columns))])
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("importance")) for i, c in enumerate(model.features.columns)]
    )
    return row.select(F.inline(rows)).orderBy(F.desc("importance"), "feature").limit(k)


def split_importance(model: ForestModel, spark, k: int = 20) -> DataFrame:
    """``(feature, splits, importance)``: share of sampled rows that each feature's splits separate."""
    nodes = model.nodes_table(spark).groupBy("feature").agg(F.count("*").alias("splits"), F.sum("size").alias("rows"))
    total = F.lit(float(max(int(model.node_size[model.node_feature >= 0].sum()), 1)))
    return nodes.select("feature", "splits", (F.col("rows") / total).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    ).limit(k)
