"""Training-order materialisation: token sequences in a keyed pseudo-random order, as binary shards of fixed stride.

The tokens of all documents, each ended by a separator, form one stream that is cut into sequences of ``length`` tokens; only
the last is shorter and padded. A keyed Feistel network over the next even number of bits, walked until it falls below the
number of sequences, maps every sequence to a global slot and back, so no order is ever stored or sorted. Shard k holds
slots k * per_shard onwards, each of them ``stride`` bytes: a reader finds any slot by multiplication and can resume at any.

Shards are dealt in ranges over ``TASKS`` tasks at most, so their number doesn't set the number of tasks. Pieces of documents
go to the task of their shard; a task sorts its own pieces and writes one shard after the other under a temporary name, then
puts it in its place, so a task that is run again writes the same shards again.

Each run has a folder of its own, and ``current.json``, written when all is there, names it with its sizes: readers see the run before
until then, and nothing of it afterwards. Older runs and what lost tasks left are deleted at the end.

Tokens are bytes of UTF-8, or the ids in an array column. ``documents`` must be a table that reads the same rows in
the same order and partitions each time, such as files; numbers and sizes of rows by place are checked.

Defined results: null and empty texts or arrays give a separator only; null ids and clashing names do no harm, as no other column is used; repeated rows are
each written; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import shared_dir, table
from plumbline.llm.shingles import mix

LENGTH, PER_SHARD, ROUNDS, TASKS = 2048, 4096, 6, 20_000
#: UTF-8 has no byte 255.
SEPARATOR, PADDING = 255, 0
#: Of the check of row sizes by place, and the folder of unfinished shards.
_MOD, _OPEN, CURRENT = 32_749, "_unfinished", "current.json"


class Permutation:
    """A keyed bijection of 0 .. n - 1."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mix(np.uint64(key) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half = np.uint64(self.half)
        a, b = x >> half, x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                a, b = b ^ (mix(a ^ k) & self.mask), a
            else:
                a, b = b, a ^ (mix(b ^ k) & self.mask)
        return a << half | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while (far := np.flatnonzero(out >= self.n)).size:
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(documents: DataFrame, folder: str, key: int = 1, column: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, dtype: str = "uint8", separator: int = SEPARATOR, tasks: int = TASKS) -> DataFrame:
    """Writes the shards to folder and returns, once they are written, slot, sequence, shard, at (bytes into the shard), n_tokens and tokens_sha256."""
    spark = documents.sparkSession
    value = documents.select(F.col(column).alias("v"))
    is_text = dict(documents.dtypes)[column] == "string"
    size = F.coalesce((F.octet_length if is_text else F.size)(F.col("v")), F.lit(0)).cast("long") + 1
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # within the partition
    counts = value.select(F.spark_partition_id().alias("part"), size.alias("n"), (place % _MOD * (size % _MOD)).alias("check"))
    starts, total = {}, 0
    for r in sorted(counts.groupBy("part").agg(F.sum("n").alias("n"), F.sum("check").alias("check")).collect()):  # one row for each partition
        starts[r["part"]] = (total, r["n"], r["check"])
        total += r["n"]
    out = "slot bigint, sequence bigint, shard bigint, at bigint, n_tokens int, tokens_sha256 string"
    run = f"run-{uuid.uuid4().hex}"
    sequences = -(-total // length)
    if not total:
        _publish(folder, {"run": run, "sequences": 0, "length": length, "per_shard": per_shard, "dtype": dtype})
        return spark.createDataFrame([], out)
    order, wide = Permutation(sequences, key), np.dtype(dtype).itemsize
    shared = spark.sparkContext.broadcast((starts, order))

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        begins, perm = shared.value
        part = TaskContext.get().partitionId()
        at, expected, check = begins.get(part, (0, 0, 0))
        stop, rows, seen = at + expected, 0, 0
        end = np.array([separator], dtype).tobytes()
        for batch in it:
            values = batch.column(0)
            if is_text:
                own = [b"" if not v.is_valid else v.as_buffer().to_pybytes() for v in values]
            else:
                own = [b"" if v is None else np.array(v, dtype).tobytes() for v in values.to_pylist()]
            sizes = np.fromiter((len(v) // wide + 1 for v in own), np.int64, len(own))
            seen += int((np.arange(rows, rows + len(own)) % _MOD * (sizes % _MOD)).sum())
            rows += len(own)
            data = end.join(own) + (end if own else b"")
            n = len(data) // wide
            if not n:
                continue
            cuts = np.arange(-(-(at + 1) // length) * length, at + n, length)
            cuts = np.unique(np.concatenate([[at], cuts, [at + n]]))
            first, last = cuts[:-1], cuts[1:]
            slots = perm.slot(first // length)
            cols = [pa.array(slots // per_shard), pa.array(slots), pa.array((first % length).astype(np.int32)), pa.array([data[(a - at) * wide : (b - at) * wide] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "slot", "place", "piece"])
            at += n
        if (at, seen) != (stop, check):
            raise ValueError(f"partition {part} holds other rows than when it was counted, or in another order")

    def shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, perm = shared.value
        system, root = _file_system(f"{folder.rstrip('/')}/{run}")
        system.create_dir(f"{root}/{_OPEN}", recursive=True)
        state: dict = {"shard": None}

        def finish() -> Iterator[pa.RecordBatch]:
            if state["shard"] is None:
                return
            state["file"].close()
            final = f"{root}/{shard_name(state['shard'])}"
            if system.get_file_info(final).type.name != "NotFound":  # of a task that did the same work
                system.delete_file(final)
            system.move(state["path"], final)
            slots, held, sums = state["rows"]
            slots = np.array(slots)
            cols = [pa.array(slots), pa.array(perm.sequence(slots)), pa.array(np.full(len(slots), state["shard"], np.int64)), pa.array((slots % per_shard) * length * wide), pa.array(held, pa.int32()), pa.array(sums, pa.string())]
            state["shard"] = None
            yield pa.RecordBatch.from_arrays(cols, names=["slot", "sequence", "shard", "at", "n_tokens", "tokens_sha256"])

        def put(slot: int, parts: list[bytes]) -> None:
            data = b"".join(parts)
            state["file"].write(data + np.full(length - len(data) // wide, PADDING, dtype).tobytes())
            for column, x in zip(state["rows"], (slot, len(data) // wide, hashlib.sha256(data).hexdigest()), strict=True):
                column.append(x)

        slot, parts = None, []
        for batch in it:
            for shard, s, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if s != slot and slot is not None:
                    put(slot, parts)
                    parts = []
                if shard != state["shard"]:
                    yield from finish()
                    path = f"{root}/{_OPEN}/{shard_name(shard)}.{uuid.uuid4().hex}"
                    state.update(shard=shard, path=path, file=system.open_output_stream(path), rows=([], [], []))
                slot = s
                parts.append(piece)
        if slot is not None:
            put(slot, parts)
        yield from finish()

    n_shards = -(-sequences // per_shard)
    n_tasks = min(n_shards, tasks)
    cut = value.mapInArrow(pieces, "shard bigint, slot bigint, place int, piece binary")
    task = F.floor(F.col("shard") * n_tasks / n_shards).cast("int")  # ranges of whole shards
    dealt = cut.repartitionById(n_tasks, task).sortWithinPartitions("slot", "place")
    manifest = f"{folder.rstrip('/')}/{run}/manifest.parquet"
    dealt.mapInArrow(shards, out).write.parquet(manifest)
    _publish(folder, {"run": run, "sequences": sequences, "length": length, "per_shard": per_shard, "dtype": dtype})
    return spark.read.schema(out).parquet(manifest)


def _publish(folder: str, about: dict) -> None:
    """Makes a run the current one, then deletes what isn't of it."""
    from pyarrow import fs

    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    new = f"{root}/{about['run']}.json"
    with system.open_output_stream(new) as f:
        f.write(json.dumps(about).encode())
    system.move(new, f"{root}/{CURRENT}")
    for found in system.get_file_info(fs.FileSelector(root)):
        if found.base_name.startswith("run-") and found.base_name != about["run"]:
            system.delete_dir(found.path) if found.type == fs.FileType.Directory else system.delete_file(found.path)
    if system.get_file_info(left := f"{root}/{about['run']}/{_OPEN}").type != fs.FileType.NotFound:
        system.delete_dir(left)


def current(folder: str) -> dict:
    """The run that readers see: its folder's name, number of sequences, their length, sequences a shard and type."""
    system, root = _file_system(folder)
    with system.open_input_stream(f"{root}/{CURRENT}") as f:
        return json.loads(f.read())


def read_slots(folder: str, first: int, count: int) -> np.ndarray:
    """Up to count sequences from slot first on, padding included: (rows, length). Slots end with the run's sequences."""
    about = current(folder)
    length, per_shard, kind = about["length"], about["per_shard"], np.dtype(about["dtype"])
    system, root = _file_system(f"{folder.rstrip('/')}/{about['run']}")
    stride, out, stop = length * kind.itemsize, [], min(first + count, about["sequences"])
    while first < stop:
        shard, at = divmod(first, per_shard)
        n = min(stop - first, per_shard - at)
        with system.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(at * stride)
            got = f.read(n * stride)
        if len(got) < n * stride:
            raise ValueError(f"shard {shard} is cut off")
        out.append(np.frombuffer(got, kind).reshape(-1, length))
        first += n
    return np.concatenate(out) if out else np.zeros((0, length), kind)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    return write_shards(table(spark, sf_dir, "documents"), folder)
