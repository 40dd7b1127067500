"""Comparison of a Spark result with a DuckDB result, whatever their order."""

import math

import pandas as pd


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return repr(float(v)) if isinstance(v, float) and not v.is_integer() else str(int(v) if isinstance(v, float) else v)

    return sorted(tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


def assert_same(got: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(wanted.columns)
    a, b = canonical(got), canonical(wanted)
    assert len(a) == len(b)
    assert a == b, [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3]
