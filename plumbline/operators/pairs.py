"""Scores of text pairs by a function that Python has to run: once for each distinct pair, in Arrow batches, with what it needs made once in each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import skew_join

_made: dict[str, object] = {}


def _once(name: str, make: Callable[[], object]) -> object:
    """What make gives, kept under a name for the life of a Python worker."""
    if name not in _made:
        _made.clear()
        _made[name] = make()
    return _made[name]


def scored(rows: DataFrame, left: str, right: str, make: Callable[[], Callable[[str, str], float]], name: str, out: str = "similarity") -> DataFrame:
    """rows with the score of two of its columns; make gives the scoring function, for instance one that loads a model.

    Equal pairs are scored once and joined back, so a costly function runs as often as there are distinct pairs; frequent pairs, and
    rows without a pair, are dealt over many tasks. Nulls have a null score; a score that isn't finite is null.
    """
    pair = ["_a", "_b"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = _once(name, make)
        for batch in batches:
            values = [f(a, b) for a, b in zip(batch["_a"], batch["_b"], strict=True)]
            yield batch.assign(**{out: pd.array(values, dtype="float64")})

    own = rows.withColumns({"_a": F.col(left), "_b": F.col(right)}).drop(out)
    distinct = own.select(*pair).where("_a is not null and _b is not null").distinct()
    found = distinct.mapInPandas(score, f"_a string, _b string, {out} double")
    fine = F.when(~F.isnan(out) & (F.abs(F.col(out)) < float("inf")), F.col(out))
    return skew_join(own, found.withColumn(out, fine), pair, "left").drop(*pair)
