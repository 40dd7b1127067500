"""Reproducible limits and samples, ordered by keyed hashes instead of random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import rank_key
from plumbline.operators.ranks import running
from plumbline.sources.staging import checkpointed


def hash_limit(rows: DataFrame, n: int | None, seed: int, *keys: str) -> DataFrame:
    """The n rows with the smallest keyed hash; all if n is None. A top-k per task and one merge."""
    if n is None:
        return rows
    if n <= 0:
        raise ValueError("the limit must be positive")
    return rows.orderBy(rank_key(seed, *[F.col(k) for k in keys])).limit(n)


def even_sample(rows: DataFrame, order: list[str], count: int) -> DataFrame:
    """count rows at even distances in this order: the places rint(i (n - 1) / (count - 1)), the middle one for a count of 1.

    Places come from range partitions and their sizes, so no task sorts the whole table.
    """
    ranked = with_rank(rows, order)
    n = ranked.count()
    if n <= count:
        return ranked.drop("rank")
    places = [n // 2] if count == 1 else sorted({_half_even(i * (n - 1), count - 1) for i in range(count)})
    wanted = rows.sparkSession.createDataFrame([(x,) for x in places], "rank long")
    return ranked.join(wanted, "rank", "left_semi").drop("rank")


def _half_even(a: int, b: int) -> int:
    whole, rest = divmod(a, b)
    return whole + (2 * rest > b or (2 * rest == b and whole % 2 == 1))


def with_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """rank from 0 in a total order, by sorted range partitions and one offset for each of them."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = checkpointed(parts.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id() % (1 << 33)}))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return parts.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


def ordinals(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with their place, from 0, in their group's order, which must tell them apart; a group of any size is numbered by ranges."""
    return running(rows, by, order, ordinal=("sum", F.lit(1)))


def ordinal_shard(rows: DataFrame, order: list[str], shard: int, shards: int) -> DataFrame:
    """The rows whose place in this order is the shard's number modulo the number of shards, with that place as rank."""
    if not 0 <= shard < shards:
        raise ValueError("the shard must be below the number of shards")
    return with_rank(rows, order).where(F.col("rank") % shards == shard)


def borderline(v: Column, language: Column, a: Column, tv: float = 0.15, tl: float = 0.80, ta: float = 0.15) -> Column:
    """The smallest distance of a signature to its thresholds."""
    return F.least(F.abs(v - tv), F.abs(language - tl), F.abs(a - ta))


def stratified(rows: DataFrame, strata: list[str], limit: int, seed: int, *keys: str) -> DataFrame:
    """Exactly min(limit, n) rows, dealt over the strata in turn by keyed rank: the r-th rows of all strata come before any (r + 1)-th.

    Only the first ``limit`` rows of a stratum can matter. Spark limits a row_number window before its shuffle, so each task sends
    at most that many rows of a stratum.
    """
    key = rank_key(seed, *[F.col(k) for k in keys])
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_key"))
    ranked = rows.withColumn("_key", key).withColumn("_turn", place).where(F.col("_turn") <= limit)
    return ranked.orderBy("_turn", *strata, "_key").limit(limit).drop("_key", "_turn")


def audit_keys(labels: DataFrame, total: int, natural: int, per_label: int, seed: int, order: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(model, instance, provenance) of an audit packet: a natural part by hash, then one row at a time for the label that lacks most.

    The greedy choice is sequential by nature, but it can only pick from each (label, slice)'s ``total`` best rows, and
    those are found by Spark. So the driver holds at most total x labels x slices rows, whatever the table's size.
    """
    model, instance = F.col("model_id"), F.col("instance_id")
    rows = labels.where(F.col("label6").isin(*order)).withColumns({
        "natural_key": rank_key(seed, F.lit("natural"), model, instance), "target_key": rank_key(seed, F.lit("targeted"), model, instance), "near": borderline(F.col("sig_v"), F.col("sig_l"), F.col("sig_a")),
    })
    first = rows.orderBy("natural_key").limit(natural).collect()
    taken = {(r.model_id, r.instance_id) for r in first}
    chosen = [(r.model_id, r.instance_id, "natural") for r in first]
    counts, slices = dict.fromkeys(order, 0), {}
    for r in first:
        counts[r.label6] += 1
        slices[(r.dataset, r.model_id)] = slices.get((r.dataset, r.model_id), 0) + 1
    place = F.row_number().over(Window.partitionBy("label6", "dataset", "model_id").orderBy("near", "target_key"))
    pool = rows.withColumn("place", place).where(F.col("place") <= total).drop("place").collect()
    left = {name: [r for r in pool if r.label6 == name and (r.model_id, r.instance_id) not in taken] for name in order}
    while len(chosen) < total:
        names = [n for n in order if left[n]]
        if not names:
            raise ValueError("too few rows for the audit")
        lack = {n: max(0, per_label - counts[n]) for n in names}
        name = min([n for n in names if lack[n]] or names, key=lambda n: (-lack[n], order.index(n)))
        best = min(left[name], key=lambda r: (slices.get((r.dataset, r.model_id), 0), r.near, r.target_key))
        left[name].remove(best)
        chosen.append((best.model_id, best.instance_id, "targeted"))
        counts[name] += 1
        slices[(best.dataset, best.model_id)] = slices.get((best.dataset, best.model_id), 0) + 1
    return chosen
