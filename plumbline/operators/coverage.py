"""Joins that compare tables: coverage, drift, resume and look-ups with nothing lost in silence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_columns(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], carried: list[str] | None = None) -> DataFrame:
    """Every left row, with its carried columns, whether it has a partner, and the columns that differ (null equals null)."""
    other = right.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    both = left.join(other, keys, "left")
    bad = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]))
    found = F.coalesce("_there", F.lit(False))
    return both.select(*keys, *(carried or ()), found.alias("found"), F.when(found, bad).alias("differ"))


def coverage(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys in both, missing and extra ones."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    o = observed.select(*keys).distinct().withColumn("_o", F.lit(1))
    both = e.join(o, keys, "full_outer")
    return both.agg(F.count_if(F.col("_e").isNotNull() & F.col("_o").isNotNull()).alias("both"), F.count_if(F.col("_o").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("extra"))


def drift(old: DataFrame, new: DataFrame, key: str, columns: list[str], allowed: Column) -> DataFrame:
    """Rows that were removed, added, or changed, with the changed columns and whether those are allowed.

    allowed is an array of column names, an expression over the old row's columns.
    """
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in columns], allowed.alias("_allowed"), F.lit(True).alias("_o"))
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("_n"))
    both = o.join(n, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.lit(c)) for c in columns]))
    kind = F.when(F.col("_n").isNull(), "removed").when(F.col("_o").isNull(), "added").when(F.size(changed) > 0, "changed")
    rows = both.select(key, kind.alias("kind"), F.when(kind == "changed", changed).alias("changed"), "_allowed").where("kind is not null")
    fine = F.when(F.col("kind") == "changed", F.size(F.array_except("changed", "_allowed")) == 0).otherwise(False)
    return rows.select(key, "kind", "changed", fine.alias("allowed"))


def pending(selected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is selected and not done."""
    return selected.join(done.select(*keys), keys, "left_anti")


def settled(ledger: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Ledger rows that have since been done and may go."""
    return ledger.join(done.select(*keys), keys, "left_semi")


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def lookup(rows: DataFrame, dimension: DataFrame, key: str, needs: Column) -> DataFrame:
    """Rows with the dimension's columns, and a problem: a needed entry that is missing, or one that isn't needed."""
    both = rows.join(dimension.withColumn("_there", F.lit(True)), key, "left")
    there = F.coalesce("_there", F.lit(False))
    return both.withColumn("problem", F.when(needs & ~there, "missing").when(~needs & there, "unexpected")).drop("_there")


def unused(dimension: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return dimension.join(rows.select(key), key, "left_anti")


def missing_grid(rows: DataFrame, seen: DataFrame, keys: list[str], grid: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """Keys that lack any cell of a constant grid, and how many. One aggregate over both tables, in which each cell is a bit: no cell is joined. A null key has no cells."""
    parts = [grid[at : at + 62] for at in range(0, len(grid), 62)]
    masks = [f"_m{i}" for i in range(len(parts))]

    def bit(cell: tuple, at: int) -> Column:
        met = [F.col(n) == F.lit(v) for n, v in zip(names, cell, strict=True)]
        return F.when(reduce(lambda a, b: a & b, met), F.lit(1 << at).cast("long")).otherwise(F.lit(0).cast("long"))

    bits = [reduce(lambda a, b: a.bitwiseOR(b), [bit(c, i) for i, c in enumerate(part)]).alias(m) for m, part in zip(masks, parts, strict=True)]
    wanted = rows.select(*keys, F.lit(True).alias("_row"), *[F.lit(0).cast("long").alias(m) for m in masks])
    held = seen.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).select(*keys, F.lit(False).alias("_row"), *bits)
    both = wanted.unionByName(held).groupBy(*keys).agg(F.bool_or("_row").alias("_row"), *[F.bit_or(m).alias(m) for m in masks]).where("_row")
    missing = F.lit(len(grid)).cast("long") - reduce(lambda a, b: a + b, [F.bit_count(m).cast("long") for m in masks], F.lit(0).cast("long"))
    return both.select(*keys, missing.alias("missing")).where("missing > 0")


def union_all(*tables: DataFrame) -> DataFrame:
    """By name; a column that a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def group_overlap(rows: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Groups that lie in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def split_stats(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows and groups of every split, 0 for an empty one."""
    have = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups"))
    wanted = rows.sparkSession.createDataFrame([(n,) for n in names], "split string")
    return wanted.join(have, "split", "left").fillna(0, ["n", "groups"])


def only_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of left that right has not; null equals null."""
    return left.select(*keys).subtract(right.select(*keys))
