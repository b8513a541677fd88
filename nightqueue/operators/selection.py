"""Order statistics by counting instead of sorting: rounds of histograms that keep the bin with the wanted rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import saved

#: Bins of a group in a round, and how many rows of a group are sorted instead of counted again.
BINS, FEW = 1024, 4096


def select_ranks(rows: DataFrame, ranks: DataFrame | Column, keys: list[str], value: str = "p", rank: str = "k", few: int = FEW) -> DataFrame:
    """keys and `value` for each distinct row of `ranks` (keys, rank from 1): the value of that rank from below among the group's rows.

    `ranks` may also be a column over n, the number of the group's values; where it is null nothing is asked.

    A round counts the rows of each group in equal bins between the bounds that are left, summed before
    they are shuffled, and takes the least and largest value of the bin that holds the rank as the next
    bounds; a group is done when these meet, or when at most `few` rows lie between them, which are sorted.
    Each round leaves out values, and narrows bounds by the number of bins where values are spread evenly.
    Values that are null or not a number have no rank; ranks beyond the group give no row. Null keys are
    groups; without keys all rows are one. Values that are counted must be finite."""
    names = [f"__g{i}" for i in range(len(keys))]
    named = lambda df, *more: df.select(*[F.col(c).alias(g) for c, g in zip(keys, names)], *more)
    known = named(rows.where(F.col(value).isNotNull() & ~F.isnan(value)), F.col(value).cast("double").alias("__v"))
    sizes = known.groupBy(*names).agg(F.count("*").alias("n"), *_ends())
    if isinstance(ranks, Column):
        asking = sizes.withColumn("__k", ranks.cast("long"))
    else:
        asking = _join(sizes, named(ranks, F.col(rank).cast("long").alias("__k")).distinct(), names)
    bounds = saved(asking.where("__k BETWEEN 1 AND n").select(*names, "__k", F.col("n").alias("__n"), "__lo", "__hi"), "bounds")
    done, sort = [], []
    # rank and bounds tell the wanted ranks of one group apart
    asked = [*names, "__k", "__a", "__z"]
    while True:
        done.append(bounds.where("__lo = __hi"))
        sort.append(bounds.where((F.col("__lo") < F.col("__hi")) & (F.col("__n") <= few)))
        left = bounds.where((F.col("__lo") < F.col("__hi")) & (F.col("__n") > few)).drop("__n")
        widest = left.agg(F.max(F.col("__hi") - F.col("__lo"))).first()[0]
        if widest is None:
            break
        if widest == float("inf"):
            raise ValueError(f"{value} must be finite")
        share = F.try_divide(F.col("__v") - F.col("__a"), F.col("__z") - F.col("__a"))
        held = _join(known, left.withColumnsRenamed({"__lo": "__a", "__hi": "__z"}), names).where("__v BETWEEN __a AND __z").select(*asked, "__v", F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int").alias("__b"))
        bins = held.groupBy(*asked, "__b").agg(F.count("*").alias("__n"), *_ends())
        upto = F.sum("__n").over(Window.partitionBy(*asked).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
        bins = bins.withColumn("__u", upto).where("__u >= __k AND __u - __n < __k")
        bounds = saved(bins.select(*names, (F.col("__k") - F.col("__u") + F.col("__n")).alias("__k"), "__n", "__lo", "__hi"), "bounds")
    place = F.row_number().over(Window.partitionBy(*names, "__k", "__lo", "__hi").orderBy("__v"))
    short = _join(known, reduce(DataFrame.unionByName, sort), names).where("__v BETWEEN __lo AND __hi").withColumn("__i", place).where("__i = __k")
    found = reduce(DataFrame.unionByName, done).select(*names, F.col("__lo").alias("__v")).unionByName(short.select(*names, "__v"))
    return found.select(*[F.col(g).alias(c) for c, g in zip(keys, names)], F.col("__v").alias(value))


def _ends() -> list:
    return [F.min("__v").alias("__lo"), F.max("__v").alias("__hi")]


def _join(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """Rows that meet on keys, nulls being equal; without keys b is one row for each wanted rank."""
    if not names:
        return a.crossJoin(F.broadcast(b))
    b = b.withColumnsRenamed({g: f"{g}b" for g in names})
    return a.join(b, reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"{g}b")) for g in names])).drop(*[f"{g}b" for g in names])
