"""Joins whose keys may be frequent on the left side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in HOT rows (and more than FEW) is frequent, so there are fewer than HOT of them. Their rows go to SALTS places.
HOT, FEW, SALTS = 1000, 8, 32


def large_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) for two sides that grow with the records, of which neither is broadcast.

    Spark takes exploded and assembled rows for as small as the rows that they came from, and would send millions of them to the driver.
    """
    return left.join(right.hint("merge"), keys, how)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """left.join(right, keys, how) for an inner or left join, with a right side of one row for each key.

    Rows of frequent keys, and rows with a null in a key, which match nothing, are dealt over places by a hash of their plain
    columns; right's row of a frequent key goes to each place. The frequent keys are fewer than HOT rows, so they can be broadcast.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no {how} join")
    whole = left.select(*keys)
    n = whole.count()
    counts = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(counts.where((F.col("_n") * HOT > n) & (F.col("_n") > FEW)).select(*keys, F.lit(True).alias("_hot")))
    lacking = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    plain = [c for c, kind in left.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]
    spread = F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot") | lacking, spread).otherwise(0)).drop("_hot")
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    sent = right.join(hot, keys, "left").withColumn("_salt", F.explode(places)).drop("_hot")
    return large_join(dealt, sent, [*keys, "_salt"], how).drop("_salt")
