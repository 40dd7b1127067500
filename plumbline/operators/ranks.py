"""Running totals over groups of any size, and what follows from them: ranks, order statistics and areas.

A group is cut into ranges of its order, each of which one task sums up on its own; what the ranges before it hold comes from a
table with one row for each range and group. So no group is sorted by one task, and ties are counted before they are placed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.staging import checkpointed

#: A table of at most so many rows is sent to every task.
SMALL = 10_000


def same(left: str, right: str, names: list[str], renamed: str = "_{}") -> Column:
    """Equality of the named columns of two tables, null equal to null."""
    each = [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{renamed.format(n)}")) for n in names]
    return reduce(lambda a, b: a & b, each, F.lit(True))


def join_small(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "left", limit: int = SMALL) -> DataFrame:
    """rows joined with a table of one row for each key, which is broadcast only if it is counted to be small."""
    right = small.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    if right.limit(limit + 1).count() <= limit:
        right = F.broadcast(right)
    return rows.alias("_a").join(right.alias("_b"), same("_a", "_b", keys), how).drop(*[f"_{k}" for k in keys])


def running(rows: DataFrame, by: list[str], order: list[str], **carried: tuple[str, str | Column]) -> DataFrame:
    """rows with a column for each name = (kind, column): the sum (0 at first) or the max (null at first) of the column over the group's earlier rows.

    The order must tell the rows of a group apart: count ties first. Nulls make groups and places of their own, before all others. The
    rows are written once, as ranges are only good for one layout.
    """
    for name, (kind, _) in carried.items():
        if kind not in ("sum", "max"):
            raise ValueError(f"{name}: {kind} can't be carried on")
    values = {f"_v_{n}": F.col(c) if isinstance(c, str) else c for n, (_, c) in carried.items()}
    laid = rows.repartitionByRange(*by, *order).withColumns({**values, "_part": F.spark_partition_id()})
    laid = checkpointed(laid)

    def total(name: str, kind: str) -> Column:
        return F.sum(f"_v_{name}") if kind == "sum" else F.max(f"_v_{name}")

    ranges = laid.groupBy(*by, "_part").agg(*[total(n, k).alias(f"_v_{n}") for n, (k, _) in carried.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = ranges.select(*by, "_part", *[total(n, k).over(earlier).alias(f"_o_{n}") for n, (k, _) in carried.items()])
    inner = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumns({f"_i_{n}": total(n, k).over(inner) for n, (k, _) in carried.items()})
    both = join_small(placed, offsets, [*by, "_part"])

    def whole(name: str, kind: str) -> Column:
        if kind == "sum":
            return F.coalesce(f"_o_{name}", F.lit(0)) + F.coalesce(f"_i_{name}", F.lit(0))
        return F.greatest(f"_o_{name}", f"_i_{name}")

    return both.select(*rows.columns, *[whole(n, k).alias(n) for n, (k, _) in carried.items()])


def counted(rows: DataFrame, by: list[str], value: str | Column, **sums: Column) -> DataFrame:
    """Per group and value x: n rows, further sums, and ``before``, the number of the group's rows with a smaller value. Rows without a value don't count."""
    x = F.col(value) if isinstance(value, str) else value
    values = rows.groupBy(*by, x.alias("x")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    values = values.where(F.when(F.col("x").isNotNull(), F.col("n")) > 0)  # on the counts: for a condition on rows alone Spark would make a computed value twice
    return running(values, by, ["x"], before=("sum", "n"))


def order_statistics(counts: DataFrame, by: list[str], **places: Callable[[Column], Column]) -> DataFrame:
    """Per group of ``counted`` rows: n, the group's size, and for each name the value at a place from 1, which is a function of that size."""
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("_size"))
    both = join_small(counts, sizes, by, "inner")

    def at(place: Column) -> Column:
        return (F.col("before") < place) & (place <= F.col("before") + F.col("n"))

    return both.groupBy(*by).agg(F.max("_size").alias("n"), *[F.max(F.when(at(f(F.col("_size"))), F.col("x"))).alias(k) for k, f in places.items()])
