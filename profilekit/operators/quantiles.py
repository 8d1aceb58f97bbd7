"""Exact quantiles with linear interpolation, at any size.

Of whole columns (:func:`column_quantiles`): one aggregation of the table counts and sketches all columns. The sketch's
pivots enclose the wanted ranks; as literals of the plan they bracket them in a second aggregation, which counts below, at and
between the pivots of every column in generated code. A third scan returns the few values between; where they are too many,
the bracket is sketched anew. Nothing is unpivoted, joined or shuffled but one row for each task.

Of groups (:func:`grouped_quantiles`): while the input has at most ``DIRECT_ROWS`` rows, the values of a group are
sorted in one array, which is several times faster than ``percentile`` and its
map of boxed values. Larger inputs are solved by selection: a quantile sketch gives pivots that enclose each wanted order
statistic, one aggregation counts what lies below and between the pivots, and
the bracket shrinks about two hundred times per scan until it is small enough
to sort. Every step is a partial/final aggregation, so a group holding a third
of the table is never gathered in one task, and the answer stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilekit.runtime import col, cut_lineage, hint_if_small

DIRECT_ROWS = 4_000_000
PIVOTS = 512
SKETCH_ACCURACY = 10_000
#: Values of a column's bracket that the driver sorts.
SORT_ROWS = 20_000
#: Size of a column's sketch, and the distance of a pivot from the wanted rank, three times the sketch's usual error. A pivot
#: that misses costs another scan and nothing else.
SKETCH_SIZE, MARGIN = 8000, 0.0015
#: Rows of a bracket up to which the scan that counts also returns the values between the pivots, which saves the third scan.
TOGETHER = 200_000
#: Brackets in one aggregation.
BRACKETS_PER_SCAN = 150


def to_long(df: DataFrame, exprs: Mapping[str, Column], ids: Sequence[Column] = ()) -> DataFrame:
    """Unpivot named double expressions to ``(ids..., variable, value)``."""
    names = list(exprs)
    wide = df.select(*ids, *[exprs[n].cast("double").alias(n) for n in names])
    id_names = [c for c in wide.columns[: len(ids)]]
    return wide.unpivot([col(i) for i in id_names], [col(n) for n in names], "variable", "value")


def column_quantiles(
    df: DataFrame,
    exprs: Mapping[str, Column],
    probs: Sequence[float],
    *,
    accuracy: int | None = None,
    direct_rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles of each named expression over the whole table; nulls are skipped.

    With ``accuracy`` they are approximate, from one scan: the rank error is at
    most the row count divided by the accuracy. ``direct_rows`` is the number of values of a bracket that the driver sorts.
    """
    if not exprs:
        return {}
    if accuracy is not None:
        sketches = [F.percentile_approx(e.cast("double"), list(probs), accuracy).alias(f"q{i}") for i, e in enumerate(exprs.values())]
        row = df.agg(*sketches).first()
        return {n: list(row[f"q{i}"] or [None] * len(probs)) for i, n in enumerate(exprs)}
    sort_rows = SORT_ROWS if direct_rows is None else direct_rows
    sizes: dict[str, int] = {}
    found: dict[tuple[str, int], float] = {}
    names = list(exprs)
    brackets: list[_Bracket] = []
    for at in range(0, len(names), BRACKETS_PER_SCAN):
        part = names[at:at + BRACKETS_PER_SCAN]
        grid = [share for p in probs for share in _around(float(p), float(p))]
        first = [F.struct(F.count(exprs[n]).alias("n"), _sketched(exprs[n].cast("double"), grid)).alias(f"c{i}") for i, n in enumerate(part)]
        row = df.agg(*first).first()
        for i, n in enumerate(part):
            sizes[n], pivots = row[f"c{i}"]["n"], row[f"c{i}"]["pivots"]
            if sizes[n]:
                brackets += [
                    _Bracket(n, _ranks(sizes[n], p), 0, sizes[n], pivots=(pivots[2 * k], pivots[2 * k + 1])) for k, p in enumerate(probs)
                ]
    while brackets:
        # Brackets whose values are returned have a scan of their own, of the rows that lie in one.
        brackets.sort(key=lambda b: b.returned(sort_rows))
        returned = brackets[0].returned(sort_rows)
        part = [b for b in brackets[:BRACKETS_PER_SCAN] if b.returned(sort_rows) == returned]
        values = [exprs[b.name].cast("double") for b in part]
        rows = df.where(reduce(or_, [b.inside(v) for b, v in zip(part, values)])) if returned else df
        row = rows.agg(*[F.struct(*b.aggregates(v, sort_rows)).alias(f"b{i}") for i, (b, v) in enumerate(zip(part, values))]).first()
        brackets = brackets[len(part):] + [after for i, b in enumerate(part) for after in b.narrowed(row[f"b{i}"], found)]

    def quantile(name: str, prob: float) -> float | None:
        if not sizes[name]:
            return None
        position = (sizes[name] - 1) * float(prob)
        below, above = (found[name, r] for r in (math.floor(position), math.ceil(position)))
        return below + (above - below) * (position - math.floor(position))

    return {n: [quantile(n, p) for p in probs] for n in names}


def _ranks(n: int, prob: float) -> list[int]:
    """Zero-based ranks, one or two, that the quantile of n values lies at."""
    position = (n - 1) * float(prob)
    return sorted({math.floor(position), math.ceil(position)})


def _around(low: float, high: float) -> list[float]:
    """Shares for a pivot below and one above."""
    return [max(0.0, low - MARGIN), min(1.0, high + MARGIN)]


def _sketched(value: Column, shares: Sequence[float]) -> Column:
    sketch = F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE))
    found = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(s) for s in shares]))
    return F.when(F.count(value) > 0, found).alias("pivots")


@dataclass
class _Bracket:
    """The ``rows`` values of a column between two bounds (left out; None: no bound), in which ``ranks`` are wanted.

    ``below`` values lie before it. With pivots the next scan counts around them; a bracket without is small enough to be
    returned, or is sketched.
    """

    name: str
    ranks: list[int]
    below: int
    rows: int
    lo: float | None = None
    hi: float | None = None
    pivots: tuple[float, float] | None = None

    def returned(self, sort_rows: int) -> bool:
        """Whether the next scan returns the values themselves."""
        return self.pivots is None and self.rows <= sort_rows

    def inside(self, value: Column) -> Column:
        keep = value.isNotNull()
        if self.lo is not None:
            keep = keep & (value > F.lit(self.lo))
        return keep if self.hi is None else keep & (value < F.lit(self.hi))

    def aggregates(self, value: Column, sort_rows: int) -> list[Column]:
        inside = self.inside(value)
        if self.returned(sort_rows):
            return [F.collect_list(F.when(inside, value)).alias("values")]
        if self.pivots is None:
            low, high = ((r - self.below + 0.5) / self.rows for r in (self.ranks[0], self.ranks[-1]))
            return [_sketched(F.when(inside, value), _around(low, high))]
        low, high = F.lit(self.pivots[0]), F.lit(self.pivots[1])
        middle = inside & (value > low) & (value < high)
        counts = [
            F.count_if(inside & (value < low)).alias("lt"), F.count_if(inside & (value == low)).alias("at_low"),
            F.count_if(middle).alias("mid"), F.count_if(inside & (value == high)).alias("at_high"),
        ]
        return [*counts, F.collect_list(F.when(middle, value)).alias("values")] if self.rows <= TOGETHER else counts

    def narrowed(self, seen, found: dict[tuple[str, int], float]) -> list[_Bracket]:
        """What is left of the bracket after a scan; ranks that the scan answers go to ``found``."""
        if self.pivots is None:
            if "values" not in seen:
                pivots = seen["pivots"]
                return [_Bracket(self.name, self.ranks, self.below, self.rows, self.lo, self.hi, (pivots[0], pivots[1]))]
            values = sorted(seen["values"])
            found.update({(self.name, r): values[r - self.below] for r in self.ranks})
            return []
        low, high = self.pivots
        # Values in rising order: below the pivots, at the lower, between, at the upper, above.
        sizes = [seen["lt"], seen["at_low"], seen["mid"], seen["at_high"] if high > low else 0]
        starts = [sum(sizes[:k]) + self.below for k in range(5)]
        bounds = {0: (self.lo, low), 2: (low, high), 4: (high, self.hi)}
        values = sorted(seen["values"]) if "values" in seen else None
        parts: dict[int, list[int]] = {}
        for r in self.ranks:
            k = max(k for k in range(5) if starts[k] <= r)
            if k in (1, 3):
                found[self.name, r] = low if k == 1 else high
            elif k == 2 and values is not None:
                found[self.name, r] = values[r - starts[2]]
            else:
                parts.setdefault(k, []).append(r)
        rows = [*sizes, self.rows - sum(sizes)]
        return [_Bracket(self.name, ranks, starts[k], rows[k], *bounds[k]) for k, ranks in parts.items()]


def grouped_quantiles(
    long: DataFrame,
    keys: Sequence[str],
    probs: Sequence[float],
    *,
    rows: int | None = None,
    direct_rows: int | None = None,
) -> DataFrame:
    """``(keys..., quantiles array<double>)`` of the column ``value``; keys must not be null.

    ``rows`` saves a count when the caller knows how many rows there are.
    """
    direct_rows = DIRECT_ROWS if direct_rows is None else direct_rows
    if (long.count() if rows is None else rows) <= direct_rows:
        return _direct(long, keys, probs)
    return _select(long, keys, probs, direct_rows)


def _interpolated(at, n: Column, prob: float) -> Column:
    """Quantile from ``at(rank)``, the value at a zero-based rank among ``n``."""
    position = (n - 1) * F.lit(float(prob))
    low = F.floor(position)
    below, above = at(low), at(F.ceil(position))
    return below + (above - below) * (position - low)


def _direct(long: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Sort each group's values in an array; only called for inputs of bounded size."""
    ordered = long.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("v"))
    n = F.size("v")
    found = F.array(*[_interpolated(lambda rank: F.get("v", rank.cast("int")), n, p) for p in probs])
    return ordered.select(*keys, F.when(n > 0, found).alias("quantiles"))


def _select(
    long: DataFrame, keys: Sequence[str], probs: Sequence[float], direct_rows: int
) -> DataFrame:
    """Sort the small groups, narrow the large ones."""
    keys = list(keys)
    long = long.where(F.col("value").isNotNull())
    sizes = cut_lineage(long.groupBy(*keys).agg(F.count("*").alias("n")))
    big = sizes.where(F.col("n") > direct_rows)
    if big.isEmpty():
        return _direct(long, keys, probs)
    big_keys = hint_if_small(big.select(*keys))
    pivots = long.join(big_keys, keys, "left_semi").groupBy(*keys).agg(_pivots(F.col("value")))
    big = cut_lineage(big.join(pivots, keys))
    narrowed = _refine(long, big, keys, probs, direct_rows)
    if big_keys.count() == sizes.count():
        return narrowed
    return _direct(long.join(big_keys, keys, "left_anti"), keys, probs).unionByName(narrowed)


def _pivots(value: Column) -> Column:
    return F.percentile_approx(value, [i / PIVOTS for i in range(PIVOTS + 1)], SKETCH_ACCURACY).alias("pivots")


def _refine(long: DataFrame, sizes: DataFrame, keys: list[str], probs: Sequence[float], direct_rows: int) -> DataFrame:
    """Quantiles of the groups in ``sizes (keys, n, pivots)``, one bracket per wanted rank."""
    position = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array_distinct(F.array(*[r.cast("long") for h in position for r in (F.floor(h), F.ceil(h))]))
    state = sizes.select(*keys, F.explode(wanted).alias("rank"), F.col("n").alias("m"), "pivots").withColumns(
        {"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "below": F.lit(0).cast("long")}
    )
    solved = None
    while True:
        state = _bracket(state, keys)
        # A bracket holds about 3 of PIVOTS steps; more pivots are only needed
        # where that is still too much to sort.
        deeper = not state.where(F.col("m") * 4 / PIVOTS > direct_rows).isEmpty()
        counted = cut_lineage(_count_bracket(long, state, keys, deeper))
        if not counted.where(F.col("r") < 0).isEmpty():
            raise RuntimeError("quantile sketch returned pivots outside its error bound")
        hits = counted.where(F.col("answer").isNotNull()).select(*keys, "rank", F.col("answer").alias("value"))
        solved = hits if solved is None else solved.unionByName(hits)
        open_ranks = counted.where(F.col("answer").isNull())
        ready = open_ranks.where(F.col("m") <= direct_rows) if deeper else open_ranks
        if not ready.isEmpty():
            solved = solved.unionByName(_sort_bracket(long, ready, keys))
        if not deeper:
            break
        state = open_ranks.where(F.col("m") > direct_rows)
        if state.isEmpty():
            break

    ranked = solved.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    quantiles = [_interpolated(lambda rank: F.col("at")[rank.cast("long")], F.col("n"), p) for p in probs]
    return sizes.join(ranked, keys).select(*keys, F.array(*quantiles).alias("quantiles"))


def _bracket(state: DataFrame, keys: list[str]) -> DataFrame:
    """Pick the two pivots that enclose the wanted rank, one spare step on each side."""
    step = F.floor((F.col("rank") - F.col("below")) / F.col("m") * PIVOTS).cast("int")
    left = F.greatest(step - 1, F.lit(0))
    right = F.least(step + 2, F.lit(PIVOTS))
    return state.select(
        *keys, "rank", "lo", "hi", "below", "m",
        F.col("pivots")[left].alias("a"), F.col("pivots")[right].alias("b"),
    )


def _inside(long: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    value = F.col("value")
    above = F.col("lo").isNull() | (value > F.col("lo"))
    under = F.col("hi").isNull() | (value < F.col("hi"))
    return long.join(hint_if_small(state), keys).where(above & under)


def _count_bracket(long: DataFrame, state: DataFrame, keys: list[str], with_pivots: bool) -> DataFrame:
    """Count below, at and between the pivots of each bracket, and say which ranks that answers.

    Neighbouring ranks mostly share a bracket, which is then counted once.
    """
    value, a, b = F.col("value"), F.col("a"), F.col("b")
    middle = (value > a) & (value < b)
    # Neighbouring ranks may share pivots although they lie in different outer brackets; each is counted by itself.
    state = state.withColumn("outer", F.struct("lo", "hi"))
    brackets = state.select(*keys, "lo", "hi", "outer", "a", "b").distinct()
    aggregates = [
        F.count_if(value < a).alias("lt"), F.count_if(value == a).alias("at_a"), F.count_if(middle).alias("m")
    ]
    if with_pivots:
        aggregates.append(_pivots(F.when(middle, value)))
    counts = _inside(long, brackets, keys).groupBy(*keys, "outer", "a", "b").agg(*aggregates)
    counted = state.drop("m", "lo", "hi").join(counts, [*keys, "outer", "a", "b"])
    r = F.col("rank") - F.col("below") - F.col("lt")
    answer = F.when(F.col("r") < F.col("at_a"), a).when(F.col("r") >= F.col("at_a") + F.col("m"), b)
    return (
        counted.withColumn("r", r)
        .withColumn("answer", answer)
        .select(
            *keys, "rank", "r", "answer", "m", *(["pivots"] if with_pivots else []), a.alias("lo"), b.alias("hi"),
            (F.col("below") + F.col("lt") + F.col("at_a")).alias("below"),
        )
    )


def _sort_bracket(long: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Order the few values left in each bracket and read off the wanted rank."""
    counts = _inside(long, state.select(*keys, "rank", "lo", "hi", "below"), keys).groupBy(
        *keys, "rank", "below", "value"
    ).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(
        Window.partitionBy(*keys, "rank").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    r = F.col("rank") - F.col("below")
    return (
        counts.withColumn("upto", upto)
        .where((r < F.col("upto")) & (r >= F.col("upto") - F.col("c")))
        .select(*keys, "rank", "value")
    )
