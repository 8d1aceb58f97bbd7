"""Places of regular expression matches as DataFrame expressions, in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, pattern: Column | str) -> Column:
    """Start, end (exclusive) and text of each match, leftmost and not overlapping. The pattern must not match nothing.

    Matches and the gaps between them come from two passes of the same pattern;
    their lengths add up to the places.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)

    def add(state: Column, x: Column) -> Column:
        start = state["pos"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.when(x["value"].isNull(), state).otherwise(F.struct(end.alias("pos"), F.concat(state["out"], F.array(one)).alias("out")))

    first = F.struct(F.lit(0).alias("pos"), none().alias("out"))
    return F.aggregate(F.arrays_zip(gaps.alias("gap"), found.alias("value")), first, add, lambda state: state["out"])


def matches_if(gate: Column, text: Column, pattern: Column | str) -> Column:
    return F.when(gate, matches(text, pattern)).otherwise(none())
