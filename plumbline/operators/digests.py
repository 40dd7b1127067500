"""Digests of rows and of whole ordered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sampling import with_rank

CHUNK = 4096


def row_text(*columns: str) -> Column:
    """name=value of each column between line feeds; a null is told from an empty text."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\\N"))) for c in columns])


def record_digest(*columns: str) -> Column:
    return F.sha2(row_text(*columns), 256)


def table_digest(rows: DataFrame, order: list[str], columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """One row: n and a digest that depends on every row and on their order.

    The digest is that of the digests of chunks of rows by place, so each task hashes its own chunks and only their digests
    meet.
    """
    placed = with_rank(rows.select(*dict.fromkeys([*order, *columns])), order)
    own = placed.select(F.floor(F.col("rank") / chunk).alias("chunk"), F.struct("rank", record_digest(*columns).alias("d")).alias("r"))
    chunks = own.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("r"))["d"], ""), 256).alias("d"))
    both = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("chunk", "d")))["d"], ""), 256).alias("digest"))
    return both
