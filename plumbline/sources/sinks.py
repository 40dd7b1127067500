"""Writers: committed tables, single reports, and keyed ledgers that are replaced as a whole."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile

from pyspark.sql import DataFrame

from plumbline.operators.digests import table_digest


def write_records(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON record a line; an existing path is an error unless it may be replaced. Spark's commit makes it whole or nothing."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_ordered(df: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """Records in this order over the files in their names' order: range partitions, each sorted, so no task sorts all of them."""
    write_records(df.orderBy(*order), path, overwrite)


def write_manifest(df: DataFrame, path: str, order: list[str], overwrite: bool = False) -> str:
    """Writes the rows in this order and returns a digest that depends on it."""
    write_ordered(df, path, order, overwrite)
    return table_digest(df, order, df.columns).first()["digest"]


def write_csv(df: DataFrame, path: str, overwrite: bool = False, single: bool = False) -> None:
    """With a header. single is for small reports: one task writes one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def write_csv_file(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small report as one file of that name with a header, put in place by a rename; more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write a table")
    text = io.StringIO()
    out = csv.writer(text, lineterminator="\n")
    out.writerows([df.columns, *rows])
    write_text(text.getvalue(), path)


def write_text(text: str, path: str) -> None:
    """A small report of the driver, put in place by a rename."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)


def write_report(value: dict, path: str) -> None:
    write_text(json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n", path)


def write_config(value: dict, path: str) -> None:
    import yaml

    write_text(yaml.safe_dump(value, sort_keys=True), path)
