"""Keyed hashes as column expressions: group ids, splits, shards, ranks and canonical JSON digests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shares of the splits, in order; their sums are taken in double precision.
SPLITS = (("train", 0.7), ("val", 0.1), ("cal", 0.1), ("test", 0.1))


def joined(*parts: Column | str) -> Column:
    """Parts between bars."""
    return F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the text's sha256."""
    return F.conv(F.substring(sha256_hex(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def group_id(dataset: Column, image: Column, question: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(sha256_hex(joined(dataset, image, question)), 1, 16))


def assign_split(group: Column, seed: int = 42) -> Column:
    """The split of a group; it depends on the group and the seed alone."""
    at = unit(joined(F.lit(str(seed)), group))
    total, out = 0.0, F
    for name, share in SPLITS[:-1]:
        total += share
        out = out.when(at < total, F.lit(name))
    return out.otherwise(F.lit(SPLITS[-1][0]))


def shard_of(instance: Column, model: Column, shards: int) -> Column:
    """A shard number from the first 64 bits, unsigned, of the key's sha256."""
    if shards <= 0:
        raise ValueError("the number of shards must be positive")
    first = F.conv(F.substring(sha256_hex(joined(model, instance)), 1, 16), 16, 10).cast("decimal(20,0)")
    return (first % F.lit(shards)).cast("int")


def rank_key(seed: int, *parts: Column) -> Column:
    """Hex text to sort by for a reproducible order."""
    return sha256_hex(joined(F.lit(str(seed)), *parts))


def derived_seed(seed: int, *parts: Column) -> Column:
    """A 32-bit number for a transform."""
    return F.conv(F.substring(rank_key(seed, *parts), 1, 8), 16, 10).cast("long")


@F.pandas_udf(T.StringType())
def canonical_json_sha256(rows: pd.Series) -> pd.Series:
    """The sha256 of JSON text written anew with sorted keys. Number formats are those of Python, so this needs Python."""
    return rows.map(lambda x: None if x is None else hashlib.sha256(json.dumps(json.loads(x), sort_keys=True).encode()).hexdigest())


def stable_json_sha256(*columns: Column | str) -> Column:
    """The sha256 of a record's stable JSON: the columns by name, keys sorted at every depth, nulls kept, numbers as Python writes them."""
    return canonical_json_sha256(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
