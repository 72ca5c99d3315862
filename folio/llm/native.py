"""Expressions over long arrays in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items whose places are summed up at once.
RUN = 512


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def placed(items: Column, size, kind: str) -> Column:
    """The items of an array as structs (at, x), at being the sum of the sizes before x; `kind` is the items' type.

    Appending to an array copies it, so items are summed up in runs of RUN, and the runs' sums apart: the time grows with
    the number of items and not with its square.
    """
    rows = f"array<struct<at:int,x:{kind}>>"

    def starts(sums: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(sums, none, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])

    def within(run: Column) -> Column:
        none = F.struct(run["at"].alias("at"), F.array().cast(rows).alias("all"))
        add = lambda s, x: F.struct((s["at"] + size(x)).alias("at"), F.concat(s["all"], F.array(F.struct(s["at"].alias("at"), x.alias("x")))).alias("all"))
        return F.aggregate(run["run"], none, add, lambda s: s["all"])

    def by_run(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda k: F.slice(all_, k * RUN + 1, F.lit(RUN)))

        def joined(runs: Column) -> Column:
            sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda s, x: s + size(x)))
            return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), starts(sums).alias("at")), within))

        return F.when(F.size(all_) > 0, let(cut, joined)).otherwise(F.array().cast(rows))

    return let(items, by_run)
