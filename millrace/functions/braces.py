"""What stands between braces, by their running depth, in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(value), with the value worked out once however often the rule names it."""
    return F.element_at(F.transform(F.array(value), rule), 1)


def braced(tail: Column) -> Column:
    """What stands between the first open brace and the first closing one at which the depth is back at none; null without."""

    def step(s, x):
        at = s["at"] + x["n"] + 1
        up = x["mark"] == "{"
        depth = s["depth"] + F.when(up, 1).otherwise(-1)
        left = F.coalesce(s["left"], F.when(up, at))
        return F.struct(depth.alias("depth"), at.alias("at"), left.alias("left"), F.coalesce(s["end"], F.when(~up & (depth == 0), at)).alias("end"))

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), none.alias("left"), none.alias("end"))
    marks = F.regexp_extract_all(tail, F.lit("[{}]"), F.lit(0))
    sizes = F.transform(F.slice(F.split(tail, "[{}]", -1), F.lit(1), F.size(marks)), lambda p: F.length(p))
    found = F.aggregate(F.arrays_zip(marks.alias("mark"), sizes.alias("n")), start, step)
    return bound(found, lambda s: F.when(s["left"] < s["end"], F.substring(tail, s["left"] + 1, s["end"] - s["left"] - 1)))
