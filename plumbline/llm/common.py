"""Shared helpers: table access, shared staging folders and document preparation."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_local: list[str] = []
_scopes: ContextVar[tuple[list[Staging], ...]] = ContextVar("scopes", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, whose driver is its executor, may go without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _local[0]


@contextmanager
def arrow_rows(spark: SparkSession, n: int = 2000, size: int = 1 << 23) -> Iterator[None]:
    """Jobs that run inside hand at most n rows, and about size bytes of them, at once to Python, which bounds what long texts take on either side."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(n), "spark.sql.execution.arrow.maxBytesPerBatch": f"{size}b"}
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work for mapInArrow, after which a Python worker gives the memory that it no longer uses back to the system: it lives on, often idle, beside other stages."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


class Staging:
    """Tables of one operator run, written to the shared folder so that lost executors cost no recomputation.

    They stay, as the operator's result reads them, until ``drop`` or the end of a surrounding ``temporary_tables``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        for held in _scopes.get():
            held.append(self)

    def write(self, df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
        """df, written and to be read again. Long rows need smaller row groups than Spark's, as a task reads a whole one."""
        path = f"{self.root}/{name}"
        with arrow_rows(self.spark):
            (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bytes(self, data: bytes, name: str) -> str:
        """A small file of its own in the shared folder; its full path."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        with_scheme = system.makeQualified(path).toString()
        out = system.create(path)
        out.write(bytearray(data))
        out.close()
        return with_scheme

    def release(self) -> None:
        """Asks for a collection of garbage, so that the shuffle files of steps that are written and done with leave the disks."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Deletes these tables, or all of them."""
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary_tables() -> Iterator[None]:
    """The tables that operators stage inside are deleted at the end: results must be written, or used up, by then."""
    held: list[Staging] = []
    token = _scopes.set((*_scopes.get(), held))
    try:
        yield
    finally:
        _scopes.reset(token)
        for staging in held:
            staging.drop()


def id_crc(column: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


def whole_text(column: str = "text") -> Column:
    """The text as it stands; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def schema_of(df: DataFrame, added: str) -> T.StructType:
    """The schema of df with further columns, these as DDL."""
    return T.StructType(df.schema.fields + T.StructType.fromDDL(added).fields)


#: A key with more than one in HOT rows (and more than FEW) is frequent, so there are fewer than HOT such keys. Their rows go to SALTS places.
HOT, FEW, SALTS = 1000, 8, 32


def frequent(counts: DataFrame, key: str, n: str = "count", total: int | None = None) -> list:
    """The frequent keys of a table, from its keys' row counts; fewer than HOT of them."""
    total = counts.agg(F.sum(n)).first()[0] or 0 if total is None else total
    return [r[0] for r in counts.where((F.col(n) * HOT > total) & (F.col(n) > FEW)).select(key).collect()]


def frequent_of(rows: DataFrame, key: str) -> list:
    """The same, of a staged table."""
    return frequent(rows.where(F.col(key).isNotNull()).groupBy(key).count(), key, total=rows.count())


def _literal(value) -> str:
    if isinstance(value, bytes | bytearray):
        return f"X'{bytes(value).hex()}'"
    return f"{value}L" if isinstance(value, int) else "X'" + str(value).encode("utf-8", "surrogatepass").hex() + "'"


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """left.join(right, key) for a left side in which the hot keys hold many rows, and a right side with one row for each key.

    Rows of a hot key are dealt over SALTS places by a hash of their plain columns, and right's row is sent to each of them.
    """
    if not hot:
        return left.join(right, key, how)
    text = "cast({} as binary)" if isinstance(hot[0], str) else "{}"
    is_hot = F.expr(f"{text.format(f'`{key}`')} in ({', '.join(map(_literal, hot))})")
    plain = [c for c, kind in left.dtypes if not kind.startswith(("array", "map", "struct"))]
    dealt = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*plain), F.lit(SALTS))).otherwise(0).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, [key, "_salt"], how).drop("_salt")


def kept(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """The rows of docs for which the operator's added columns meet a condition, whatever else docs' columns are called."""
    safe = [n if n == "text" else f"_own{i}" for i, n in enumerate(docs.columns)]
    return operator(docs.toDF(*safe)).where(condition).select(*safe).toDF(*docs.columns)
