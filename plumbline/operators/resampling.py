"""Paired bootstrap over groups of instances, and Holm's correction.

Every group has a Poisson(1) weight in every replicate, made from a hash of the group and the replicate's number. So no sample is drawn
and no row is repeated: tasks add up one array of sums for each comparison, and only these arrays meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPLICATES = 1000
#: Comparisons are declared beforehand, and few.
MOST_COMPARISONS = 1000
MASK, STEP, MIX = 0xFFFFFFFF, 2654435769, 73244475


def poisson_limits() -> list[int]:
    """Where a 32-bit number's weight grows by one: the distribution function of Poisson(1), to the last limit below 2^32."""
    out, term, total = [], exp(-1), 0.0
    for k in range(1, 20):
        total += term
        term /= k
        if int(total * 2**32) > MASK:
            break
        out.append(int(total * 2**32))
    return out


LIMITS = poisson_limits()


def weights(seeds: np.ndarray, replicates: int) -> np.ndarray:
    """Weights of (group, replicate) from 32-bit seeds of groups."""
    x = (seeds.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(STEP)) & np.uint64(MASK)
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(MIX) & np.uint64(MASK)
    x = (x >> np.uint64(16)) ^ x
    return np.searchsorted(np.array(LIMITS, np.uint64), x.ravel(), side="right").reshape(x.shape).astype(np.int64)


def paired_sums(rows: DataFrame, comparison: str, group: str, a: str, b: str, seed: int = 42) -> DataFrame:
    """comparison, group, seed, diff (sum of a - b) and n of each group's pairs; rows that lack either value are no pairs."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    sums = pairs.groupBy(F.col(comparison).alias("comparison"), F.col(group).alias("grp")).agg(F.sum(F.col(a) - F.col(b)).cast("double").alias("diff"), F.count(F.lit(1)).alias("n"))
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("grp").cast("string"), F.lit("")))
    return sums.withColumn("seed", F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"))


def replicated(sums: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """comparison, replicate (0 is the data as it is) and the mean difference of its pairs; null for a replicate without pairs."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            seeds, diff, n = (np.asarray(batch.column(i)) for i in (1, 2, 3))
            for name in dict.fromkeys(names):
                own = np.fromiter((x == name for x in names), bool, len(names))
                total = held.setdefault(name, np.zeros((2, replicates + 1)))
                if len(held) > MOST_COMPARISONS:
                    raise ValueError(f"more than {MOST_COMPARISONS} comparisons")
                for at in range(0, int(own.sum()), 4096):
                    s, d, k = (x[own][at : at + 4096] for x in (seeds, diff, n))
                    w = weights(s, replicates)
                    total[0, 1:] += d @ w
                    total[1, 1:] += k @ w
                    total[:, 0] += d.sum(), k.sum()
        if held:
            size = replicates + 1
            names = pa.array([x for x in held for _ in range(size)], pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(size, dtype=np.int32), len(held))), pa.array(np.concatenate([x[0] for x in held.values()])), pa.array(np.concatenate([x[1] for x in held.values()]))], names=["comparison", "replicate", "diff", "n"])

    parts = sums.select(F.col("comparison").cast("string"), "seed", "diff", "n").mapInArrow(added, "comparison string, replicate int, diff double, n double")
    return parts.groupBy("comparison", "replicate").agg(F.try_divide(F.sum("diff"), F.sum("n")).alias("mean"))


def intervals(replicates: DataFrame, level: int = 950) -> DataFrame:
    """Per comparison: mean, the interval between the replicates' order statistics at the given level (thousandths), and a two-sided p value.

    With B replicates the ends are those at the places 1 + floor((B - 1) t) for both tails t; p is twice the smaller share of means at or
    beyond 0, the data counted as one of them, and 1 at most. A comparison has a thousand or so replicates, sorted in its row.
    """
    own = replicates.groupBy("comparison").agg(F.max(F.when(F.col("replicate") == 0, F.col("mean"))).alias("mean"), F.array_sort(F.collect_list(F.when(F.col("replicate") > 0, F.col("mean")))).alias("m"))
    size = F.size("m")
    tail = (1000 - level) / 2000

    def end(t: float):
        return F.get("m", F.floor((size - 1) * F.lit(t)).cast("int"))

    low, high = F.size(F.filter("m", lambda x: x <= 0)), F.size(F.filter("m", lambda x: x >= 0))
    p = F.least(F.lit(1.0), 2 * (F.least(low, high) + 1) / (size + 1))
    return own.select("comparison", "mean", end(tail).alias("low"), end(1 - tail).alias("high"), p.alias("p"))


def holm(tests: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """tests with their adjusted p: the largest, over the tests of the family up to this one by p, of p times the tests not yet passed; 1 at most.

    Equal p values share one adjusted value. A family is a declared handful of tests.
    """
    order = Window.partitionBy(*family).orderBy(p)
    rows = tests.withColumns({"_m": F.count(F.lit(1)).over(Window.partitionBy(*family)), "_i": F.row_number().over(order)})
    return rows.withColumn("adjusted", F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_i") + 1) * F.col(p)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_m", "_i")
