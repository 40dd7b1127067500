"""Exact top-k search by inner product: a Voronoi kNN join over integer vectors.

Inner products become distances: with M the largest norm, every candidate x gets one more coordinate, sqrt(M^2 - |x|^2), and
every query 0, so that |q - x|^2 = |q|^2 + M^2 - 2 q.x, and a query's best scores are its nearest candidates.

1. Pivots are a sample of candidates by hash, ``PIVOTS`` at most or little more. Candidates and queries go to the cell of
   their nearest pivot.
2. Cell summaries (largest and smallest distance to the pivot, and the k + 1 smallest ones) bound, for each cell of
   queries, the distance of the k-th neighbour: theta. Triangle inequalities then tell which candidates of a cell
   can matter: those whose distance to their pivot is within U + theta of the distance between the pivots.
3. Cells of candidates are packed into blocks of about ``BLOCK`` vectors, and cells of queries into groups of ``QUERIES`` at
   least and about ``GROUP_BYTES`` at most. A block is stored once, beside the list of the groups that need any of it, and
   read again for them: neither a task nor a disk holds a copy for each group. Within a group each query checks a block's
   bound against its own k-th score before it multiplies.
4. A task keeps k candidates for each query of the groups it meets, and a window with a limit before its shuffle merges them.

A hot cell is many blocks and many groups, so no task holds a whole cell. Scores are exact integers: in floating point or 64
bits where the norms prove that enough, and in Python's integers for wide vectors (norm of 2^31 or more), which take no
part in the geometry: as candidates they go to every group, as queries they get every block.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; of
two lengths the shorter vector counts as filled up with zeros, and an empty one is all zeros; ties go to the smaller
vec_id; each row is a query or candidate of its own, so a repeated query row is answered each time and other rows with a
query's id are candidates; a score beyond 64 bits is ranked by its true value and given as the nearest 64-bit integer; no
candidates give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Staging, table

K = 5
BLOCK, QUERIES = 2048, 512
#: There are about GROUPS groups as long as their vectors stay within GROUP_BYTES. A task's groups hold HELD bytes before their lists are handed on.
GROUPS, GROUP_BYTES, HELD = 64, 1 << 22, 1 << 26
#: Groups of queries that a task meets, and their bytes in all up to which every task meets all of them.
TOGETHER, SENT = 8, 1 << 23
#: Row groups of the staged blocks, which are read as a whole.
ROW_GROUP = 1 << 23
#: Wide vectors, whose products are made one by one, have smaller blocks and groups.
WIDE_BLOCK, WIDE_QUERIES = 256, 64
#: Pivots: about the square root of the number of candidates, within these.
PIVOTS = (8, 1024)
#: Relative slack of the bounds, which are computed in floating point.
SLACK = 1e-9
#: Where a list is not full yet.
_WORST, _NONE = -(2**63 - 1), np.iinfo(np.int64).max
_MOST = 2**63 - 1


def usable(vector: Column) -> Column:
    """The components as doubles (an empty vector as one zero); null if the vector takes no part."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.when(F.size(vector) == 0, F.array(F.lit(0.0))).otherwise(as_double))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.int64).reshape(-1, dim)


def _compact(x: np.ndarray) -> bytes:
    """Whole vectors in the smallest integers that hold them and their negatives."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)).tobytes()


def _whole(data: pa.Buffer, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"i{data.size // (n * dim)}").reshape(n, dim)


def _by_length(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each length of vectors in a batch, and the rows that have it."""
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


class Geometry:
    """Pivots (all of one length) lifted to norm M, and distances to them."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots.astype(np.float64), most
        self.lift = self._lifts(self.pivots)
        #: Rounding of a squared distance is relative to M^2, so this is what a small distance can be off by.
        self.off = 4 * most * math.sqrt((pivots.shape[1] + 4) * np.finfo(np.float64).eps)

    def _lifts(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most**2 - (x * x).sum(axis=1), 0))

    def distances(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        x = x.astype(np.float64)
        c = min(x.shape[1], self.pivots.shape[1])
        cross = x[:, :c] @ self.pivots[:, :c].T
        if lifted:
            square = 2 * self.most**2 - 2 * (cross + self._lifts(x)[:, None] * self.lift)
        else:
            square = (x * x).sum(axis=1)[:, None] + self.most**2 - 2 * cross
        return np.sqrt(np.maximum(square, 0))


def _packed(vectors: DataFrame) -> DataFrame:
    """rid, id, query, dim, wide, norm, and items: floor(256 x) as 64-bit integers, or x as it is for wide vectors."""

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            column = batch.column(2)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(values * 256)
                square = np.add.reduceat(whole * whole, ends - sizes)
            wide = ~(square < 2.0**62)
            small = np.where(np.repeat(wide, sizes), 0, whole).astype(np.int64)
            items = [(values if w else small)[b - n : b].tobytes() for w, b, n in zip(wide.tolist(), ends.tolist(), sizes.tolist(), strict=True)]
            cols = [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int32()), pa.array(wide), pa.array(np.sqrt(np.where(wide, 0, square))), pa.array(items, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "id", "query", "dim", "wide", "norm", "items"])

    return vectors.mapInArrow(packed, "rid bigint, id bigint, query boolean, dim int, wide boolean, norm double, items binary")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query among vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    staging = Staging(spark, "knn")
    out = "query_id bigint, rank int, vec_id bigint, score bigint"
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("id"), usable(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = staging.write(_packed(rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())), "vectors")
    wide, narrow = rows.where("wide"), rows.where("not wide")
    n_wide, n_wide_queries = wide.agg(F.count(F.lit(1)), F.count_if("query")).first()
    common = narrow.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    n, most = narrow.agg(F.count(F.lit(1)), F.max("norm")).first()

    pivots = np.zeros((1, 1), np.int64)
    if common:  # rows with the smallest hashes, of the commonest length
        wanted = min(max(PIVOTS[0], round(n**0.5)), PIVOTS[1])
        share = F.pmod(F.xxhash64("rid"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, wanted / common["count"]))
        own = narrow.where(F.col("dim") == common["dim"])
        picked = own.where(share).select("items").collect() or own.select("items").limit(1).collect()
        pivots = np.stack([np.frombuffer(r["items"], np.int64) for r in picked])
    shared = spark.sparkContext.broadcast(Geometry(pivots, most or 0.0))

    def celled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        geometry = shared.value
        for batch in it:
            cell, far, qcell, qfar = (np.zeros(batch.num_rows, t) for t in (np.int32, np.float64, np.int32, np.float64))
            for dim, own in _by_length(batch.column(3).to_numpy()):
                x, at = _matrix(batch.column(4).take(pa.array(own)), dim), np.arange(len(own))
                for where, what, lifted in ((cell, far, True), (qcell, qfar, False)):
                    d = geometry.distances(x, lifted)
                    where[own] = d.argmin(axis=1)
                    what[own] = d[at, where[own]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (cell, far, qcell, qfar))], names=["rid", "id", "query", "dim", "items", "cell", "far", "qcell", "qfar"])

    kinds = "rid bigint, id bigint, query boolean, dim int, items binary"
    rows = staging.write(narrow.select("rid", "id", "query", "dim", "items").mapInArrow(celled, kinds + ", cell int, far double, qcell int, qfar double"), "cells")

    # summaries, a few numbers for each pivot
    closest = rows.select("cell", "far").mapInArrow(_closest(k + 1), "cell int, far double")
    by_far = Window.partitionBy("cell").orderBy("far")
    near: dict[int, list[float]] = {}
    for r in closest.withColumn("at", F.row_number().over(by_far)).where(F.col("at") <= k + 1).collect():
        near.setdefault(r["cell"], []).append(r["far"])
    sizes = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    reach = {r["qcell"]: (r["u"], r["n"]) for r in rows.where("query").groupBy("qcell").agg(F.max("qfar").alias("u"), F.count(F.lit(1)).alias("n")).collect()}
    if not reach and not n_wide_queries:
        return spark.createDataFrame([], out)
    geometry = shared.value
    between, off = geometry.distances(geometry.pivots, True), geometry.off
    theta = {}
    for i, (u, _) in reach.items():
        upper = np.sort(np.concatenate([u + between[i, j] + np.array(d) for j, d in near.items()]))
        theta[i] = float(upper[k]) * (1 + SLACK) + 3 * off if len(upper) > k else float("inf")
    parts = np.ones(len(pivots), np.int64)
    for c, m in sizes.items():
        parts[c] = -(-m // block)
    n_queries = sum(m for _, m in reach.values())
    queries = max(queries, min(-(-n_queries // GROUPS), GROUP_BYTES // (8 * pivots.shape[1])))
    groups, taken = {}, (0, 0)  # small cells of queries share a group, large ones are dealt over several
    for i, (_, m) in sorted(reach.items(), key=lambda x: -x[1][1]):
        if m > queries:
            groups[i] = (taken[0] + 1, -(-m // queries))
            taken = (taken[0] + groups[i][1], queries)
        else:
            taken = (taken[0] + 1, m) if not taken[0] or taken[1] + m > queries else (taken[0], taken[1] + m)
            groups[i] = (taken[0], 1)
    n_groups, n_wide_groups = taken[0], -(-n_wide_queries // WIDE_QUERIES)  # wide queries' groups have the numbers behind
    plan = spark.sparkContext.broadcast((between, off, reach, theta, parts, groups))

    def dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = plan.value[4]
        for batch in it:
            part = _salt(batch.column(0), 0x9E3779B97F4A7C15) % many[batch.column(4).to_numpy()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["rid", "id", "dim", "items", "cell", "far", "part"])

    def block_of(rows: pa.Table) -> pa.Table:
        """One row for a block, with the groups of queries that may need some of it and the distances between which they do."""
        dist, off, far_of, limit, _, where = plan.value
        j = rows.column("cell")[0].as_py()
        far = rows.column("far").to_numpy()
        need: dict[int, list] = {}
        for i, (u, _) in far_of.items():
            slack = (u + limit[i] + dist[i, j]) * SLACK + 3 * off
            low, high = dist[i, j] - u - limit[i] - slack, dist[i, j] + u + limit[i] + slack
            if far.max() >= low and far.min() <= high:
                for g in range(where[i][0], where[i][0] + where[i][1]):
                    span = need.setdefault(g, [low, high])
                    span[0], span[1] = min(span[0], low), max(span[1], high)
        dim = rows.column("dim")[0].as_py()
        if not need and not n_wide_groups:
            return _BLOCKS.empty_table()
        rids, ids = (rows.column(c).to_numpy().tobytes() for c in ("rid", "id"))
        x = _compact(_matrix(rows.column("items").combine_chunks(), dim))
        spans = {"grps": list(need), "lows": [low for low, _ in need.values()], "highs": [high for _, high in need.values()]}
        return pa.table({"dim": [dim], "wide": [False], "rids": [rids], "ids": [ids], "far": [far.tobytes()], "block": [x]} | {c: [v] for c, v in spans.items()}, schema=_BLOCKS)

    parted = rows.select("rid", "id", "dim", "items", "cell", "far").mapInArrow(dealt, "rid bigint, id bigint, dim int, items binary, cell int, far double, part int")
    packed = parted.groupBy("cell", "dim", "part").applyInArrow(block_of, _BLOCK_DDL)
    if n_wide:
        parted = wide.select("rid", "id", "dim", "items", F.pmod(F.xxhash64("rid"), F.lit(-(-n_wide // WIDE_BLOCK))).alias("part"))
        packed = packed.unionByName(parted.groupBy("dim", "part").applyInArrow(_wide_block, _BLOCK_DDL))
    packed = staging.write(packed, "blocks", ROW_GROUP)

    def grouped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = plan.value[5]
        for batch in it:
            salt = _salt(batch.column(0), 0xC2B2AE3D27D4EB4F).tolist()
            grp = [where[c][0] + s % where[c][1] for s, c in zip(salt, batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(grp, pa.int32())], names=["rid", "id", "dim", "items", "grp"])

    def group_of(rows: pa.Table) -> pa.Table:
        one = {"grp": rows.column("grp")[:1], "qdim": rows.column("dim")[:1]}
        if rows.column("grp")[0].as_py() > n_groups:
            items = b"".join(x.as_py() for x in rows.column("items"))
        else:
            items = _compact(_matrix(rows.column("items").combine_chunks(), rows.column("dim")[0].as_py()))
        return pa.table(one | {"qrids": pa.array([rows.column("rid").to_numpy().tobytes()]), "qids": pa.array([rows.column("id").to_numpy().tobytes()]), "qs": pa.array([items], pa.binary())})

    asked = rows.where("query").select("rid", "id", "dim", "items", "qcell").mapInArrow(grouped, "rid bigint, id bigint, dim int, items binary, grp int")
    if n_wide_queries:
        number = (F.pmod(F.xxhash64("rid"), F.lit(n_wide_groups)) + n_groups + 1).cast("int")
        asked = asked.unionByName(wide.where("query").select("rid", "id", "dim", "items", number.alias("grp")))
    asked = staging.write(asked.groupBy("grp", "dim").applyInArrow(group_of, "grp int, qdim int, qrids binary, qids binary, qs binary"), "groups", ROW_GROUP)

    def solved(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list] = {}  # by group and length, in stretches: query rows, ids, vectors, and scores and ids so far
        held = 0
        names = ["qrid", "query_id", "score", "more", "vec_id"]

        def lists() -> Iterator[pa.RecordBatch]:
            for stretches in best.values():
                for qrids, qids, _, score, ids in stretches:
                    qn, at = np.nonzero((ids != _NONE) & (score != _WORST))
                    yield pa.RecordBatch.from_arrays([pa.array(qrids[qn]), pa.array(qids[qn]), pa.array(score[qn, at]), pa.nulls(len(qn), pa.binary()), pa.array(ids[qn, at])], names=names)
            best.clear()

        for batch in it:
            for g, dim, is_wide, rids, ids, far, x, grps, lows, highs, qdim, qrids, qids, q in zip(*batch.columns, strict=True):
                g, dim, qdim, is_wide = g.as_py(), dim.as_py(), qdim.as_py(), is_wide.as_py()
                rids, ids = (np.frombuffer(v.as_buffer(), np.int64) for v in (rids, ids))
                if is_wide or g > n_groups:
                    qrids, qids = (np.frombuffer(v.as_buffer(), np.int64) for v in (qrids, qids))
                    many = _wide_integers(q.as_py(), qdim) if g > n_groups else _whole(q.as_buffer(), len(qids), qdim).astype(object)
                    some = _wide_integers(x.as_py(), dim) if is_wide else _whole(x.as_buffer(), len(ids), dim).astype(object)
                    yield pa.RecordBatch.from_arrays(_exact(qrids, qids, many, rids, ids, some, k), names=names)
                    continue
                if (g, qdim) not in best:
                    if held > HELD:
                        yield from lists()
                        held = 0
                    qrids, qids = (np.frombuffer(v.as_py(), np.int64) for v in (qrids, qids))
                    own = _whole(pa.py_buffer(q.as_py()), len(qids), qdim)
                    cuts = [slice(at, at + QUERIES) for at in range(0, len(qids), QUERIES)]
                    best[g, qdim] = [[qrids[c], qids[c], own[c], np.full((len(qids[c]), k), _WORST), np.full((len(qids[c]), k), _NONE)] for c in cuts]
                    held += own.nbytes + 16 * (k + 1) * len(qids)
                x, at = _whole(x.as_buffer(), len(ids), dim), grps.as_py().index(g)
                far = np.frombuffer(far.as_buffer(), np.float64)
                needed = (far >= lows[at].as_py()) & (far <= highs[at].as_py())
                if not needed.all():
                    rids, ids, x = rids[needed], ids[needed], x[needed]
                for stretch in best[g, qdim]:
                    _merge(stretch, rids, ids, x, k)
        yield from lists()

    # each block beside each group that needs it: a product of the staged tables, of which no copy is shuffled or stored
    asked_bytes = 8 * (n_queries + n_wide_queries) * pivots.shape[1]
    if asked_bytes <= SENT and not n_wide_queries:
        asked = F.broadcast(asked)
    else:
        asked = asked.repartitionByRange(-(-(n_groups + n_wide_groups) // TOGETHER), "grp").hint("shuffle_replicate_nl")
    due = F.col("wide") | (F.col("grp") > n_groups) | F.array_contains("grps", F.col("grp"))
    both = packed.join(asked, due).select("grp", "dim", "wide", "rids", "ids", "far", "block", "grps", "lows", "highs", "qdim", "qrids", "qids", "qs")
    lists = staging.write(both.mapInArrow(solved, "qrid bigint, query_id bigint, score bigint, more binary, vec_id bigint"), "lists")
    order = Window.partitionBy("qrid").orderBy(F.desc("score"), F.desc("more"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_BLOCKS = pa.schema([
    ("dim", pa.int32()), ("wide", pa.bool_()), ("rids", pa.binary()), ("ids", pa.binary()), ("far", pa.binary()), ("block", pa.binary()),
    ("grps", pa.list_(pa.int32())), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64())),
])
_BLOCK_DDL = "dim int, wide boolean, rids binary, ids binary, far binary, block binary, grps array<int>, lows array<double>, highs array<double>"


def _wide_block(rows: pa.Table) -> pa.Table:
    """The wide vectors of one block in a row; every group needs them."""
    rids, ids = (rows.column(c).to_numpy().tobytes() for c in ("rid", "id"))
    made = {"dim": rows.column("dim")[:1].to_pylist(), "wide": [True], "rids": [rids], "ids": [ids], "far": [None], "block": [b"".join(x.as_py() for x in rows.column("items"))], "grps": [None], "lows": [None], "highs": [None]}
    return pa.table(made, schema=_BLOCKS)


def _salt(rids: pa.Array, by: int) -> np.ndarray:
    return (rids.to_numpy().astype(np.uint64) * np.uint64(by) >> np.uint64(32)).astype(np.int64)


def _wide_integers(data: bytes, dim: int) -> np.ndarray:
    """Wide vectors as Python's integers."""
    whole = [int(x) * 256 if abs(x) >= 2**53 else math.floor(x * 256) for x in np.frombuffer(data, np.float64).tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(-1, dim)


def _ordered(score: int) -> bytes | None:
    """For scores at the ends of 64 bits or beyond, bytes in the order of the scores."""
    if abs(score) < _MOST:
        return None
    raw = abs(score).to_bytes((score.bit_length() + 7) // 8, "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return b"\x01" + raw if score > 0 else b"\x00" + bytes(255 - b for b in raw)


def _exact(qrids: np.ndarray, qids: np.ndarray, q: np.ndarray, rids: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[pa.Array]:
    """The k best candidates of a block for each query by exact products: rows of qrid, query_id, score, more, vec_id."""
    c = min(q.shape[1], x.shape[1])
    made = q[:, :c].dot(x[:, :c].T)
    found: list[list] = [[], [], [], [], []]
    for a in range(len(q)):
        order = sorted((b for b in range(len(x)) if rids[b] != qrids[a]), key=lambda b: (-made[a, b], ids[b]))[:k]  # noqa: B023
        for b in order:
            score = made[a, b]
            row = (qrids[a], qids[a], max(-_MOST - 1, min(_MOST, score)), _ordered(score), ids[b])
            for column, value in zip(found, row, strict=True):
                column.append(value)
    return [pa.array(v, t) for v, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)]


def _closest(k: int):
    """The k smallest distances of each cell, by task."""

    def closest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in it:
            cell, far = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(cell):
                best[c] = np.sort(np.concatenate([best.get(c, far[:0]), far[cell == c]]))[:k]
        for c, d in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(d), pa.int32()), pa.array(d)], names=["cell", "far"])

    return closest


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of vectors that aren't wide; in floating point where that is exact."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if size < 2**52 else q.astype(np.int64) @ x.T.astype(np.int64)


def _merge(state: list, rids: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> None:
    """Puts a block's candidates into the state; queries whose k-th score the block can't reach are left alone."""
    qrids, _, q, score, best = state
    if not len(x):
        return
    c = min(q.shape[1], x.shape[1])
    q, x = q[:, :c], x[:, :c]
    centre = x.mean(axis=0)
    radius = np.sqrt(((x - centre) ** 2).sum(axis=1).max())
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    bound = q @ centre + norm * radius
    bound += 1e-9 * norm * (np.sqrt((centre**2).sum()) + radius) + 1
    open_ = np.flatnonzero(bound >= score[:, -1])
    if not len(open_):
        return
    made = _products(q[open_], x)
    _, own, at = np.intersect1d(qrids[open_], rids, return_indices=True)
    made[own, at] = _WORST  # a query isn't its own neighbour
    if len(x) > 4 * k:  # ties at the k-th place stay, as ids decide among them
        floor = np.maximum(-np.partition(-made, k - 1, axis=1)[:, k - 1], score[open_, -1])
        rows, cols = np.nonzero(made >= floor[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(made, np.bool_))
    every = np.concatenate([rows, np.repeat(np.arange(len(open_)), k)])
    scores = np.concatenate([made[rows, cols], score[open_].ravel()])
    names = np.concatenate([ids[cols], best[open_].ravel()])
    order = np.lexsort((names, -scores, every))
    starts = np.searchsorted(every[order], np.arange(len(open_)))
    take = order[starts[:, None] + np.arange(k)]
    score[open_], best[open_] = scores[take], names[take]


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)
), s AS (
  SELECT q.rid AS qrid, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""
