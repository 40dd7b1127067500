"""Near-duplicate documents by an exact Jaccard join of word-shingle sets (grouped prefix join) and their components.

Two documents link when their sets of five-word shingles have a Jaccard similarity of at least 0.8.

1. A fixed-size count sketch over all documents orders shingles from rare to common. Any order is right; this one makes
   prefixes rare.
2. Equal sets are one entity. Entities of equal size and equal prefix (the first n - ceil(0.8 n) + 1 shingles in that order)
   are one group, and only groups are sent to the shuffle by prefix shingle.
3. A shingle with few groups gives all pairs of them. They are counted by pair and filtered by size, by place and by the
   number of prefix shingles that a link needs. A shingle with many groups pairs each of them with one hub, the group
   in which the shingle stands first.
4. Surviving group pairs are expanded to members and verified on whole sets; the links give components.
5. What is still open, pairs of candidates whose components differ, is expanded in full and verified. Pairs within one
   component need no check, so no group of copies is ever expanded into all its pairs, and no link between components is
   lost.

Every step between shuffles is a table in the shared folder. Broadcast are only the sketch (``MAX_CELLS`` bytes at most) and
a Bloom filter (``MAX_BLOOM`` bits at most) that thins the sets that are fetched. Both grow with the data up to these sizes;
beyond them the results stay the same and the work linear, but the sets of more documents are shuffled (at worst each
different set once). Joins in which a shingle, group, text or label may hold many rows are salted for the frequent keys.

Defined results: null and empty texts have empty sets and link with nothing; a null id takes part in nothing and has no
component; each row is a document by its own text, so rows that repeat an id with different texts have a component each,
and those with equal texts share one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Staging, arrow_rows, frequent, frequent_of, salted_join, table, tidy
from plumbline.llm.shingles import sets_of

#: Similarity in percent.
PERCENT = 80
#: A prefix shingle with more groups than this goes by hub.
FEW = 24
MIN_CELLS, MAX_CELLS, MAX_BLOOM = 1 << 12, 1 << 23, 1 << 26
#: Cells of the sketch in one row, and rows that are summed by one task at once.
ROW, FAN_IN = 1 << 14, 64


def _least(n: int, percent: int) -> int:
    """The fewest shingles that a set of n shares with any set that links with it."""
    return (percent * n + 99) // 100


def _class(count: np.ndarray) -> np.ndarray:
    return np.minimum(10 * np.log2(count + 1.0), 255).astype(np.uint8)


def _summed(parts: DataFrame, n_parts: int) -> DataFrame:
    """Sums of (part, row, counts) over parts, in rounds, so that no task holds more than FAN_IN rows of one place."""

    def add(rows):
        total = np.sum([np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("counts")], axis=0, dtype=np.int64)
        total = np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()
        return pa.table({"part": rows.column("part")[:1], "row": rows.column("row")[:1], "counts": pa.array([total], pa.binary())})

    while True:
        n_parts = -(-n_parts // FAN_IN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("part", "row").applyInArrow(add, "part bigint, row int, counts binary")
        if n_parts <= 1:
            return parts


def sketch(docs: DataFrame) -> np.ndarray:
    """For each cell, a rarity class of the shingles that fall into it: never below the class of any one's true count."""
    size = docs.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0.0
    cells = MIN_CELLS
    while cells < MAX_CELLS and cells < size / 48:
        cells *= 2

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(cells, np.int32)
        held: list[np.ndarray] = []

        def add() -> None:
            if held:
                np.add.at(total, (np.concatenate(held) & np.uint64(cells - 1)).astype(np.int64), 1)
                held.clear()

        for batch in it:
            for own in sets_of(batch.column(0)):
                held.append(own)
                if len(held) >= 500:
                    add()
        add()
        part = TaskContext.get().partitionId()
        for row in range(-(-cells // ROW)):
            own = total[row * ROW : (row + 1) * ROW]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([row], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "row", "counts"])

    parts = docs.select("text").mapInArrow(tidy(counted), "part bigint, row int, counts binary")
    n_parts = docs.rdd.getNumPartitions()
    out = np.zeros(cells, np.uint8)
    for r in _summed(parts, n_parts).collect():  # at most MAX_CELLS counts
        own = np.frombuffer(r.counts, np.int32)
        out[r.row * ROW : r.row * ROW + len(own)] = _class(own)
    return out


def _key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def entities(docs: DataFrame, classes: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n, key of its set, gid of its group, heavy (prefix shingles that may be in many groups), and the prefix where this task meets the group for the first time in a row with an id."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    limit = int(_class(np.array([FEW]))[0])

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        mask = np.uint64(len(table) - 1)
        for batch in it:
            ns, keys, gids, heavies, prefixes = [], [], [], [], []
            for own, has_id in zip(sets_of(batch.column(1)), batch.column(0).is_valid().to_pylist(), strict=True):
                n = len(own)
                p = n - _least(n, percent) + 1 if n else 0
                rank = table[(own & mask).astype(np.int64)]
                order = np.argsort(rank, kind="stable")[:p]
                prefix = own[order]
                gid = int.from_bytes(_key(np.append(prefix, np.uint64(n)))[:8], "little", signed=True)
                ns.append(n)
                keys.append(_key(own))
                gids.append(gid)
                heavies.append(int((rank[order] >= limit).sum()))
                new = n and has_id and gid not in seen
                prefixes.append(prefix.view(np.int64) if new else None)
                if new:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(gid)
            cols = [batch.column(0), pa.array(ns, pa.int32()), pa.array(keys, pa.binary()), pa.array(gids, pa.int64()), pa.array(heavies, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "key", "gid", "heavy", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(tidy(made), "doc_id bigint, n int, key binary, gid bigint, heavy int, prefix array<bigint>")


def _need(n1: str, n2: str, percent: int) -> Column:
    """The fewest shingles that sets of these sizes share if they link."""
    return F.ceil((F.col(n1) + F.col(n2)) * percent / (100 + percent) - 1e-9)


def _sizes_fit(percent: int) -> Column:
    return (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent)


def _may_link(percent: int) -> Column:
    """Of two groups (n, pos) and (n2, pos2) with a common shingle at these places: whether sizes and places allow a link."""
    after = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    return _sizes_fit(percent) & (F.least("pos", "pos2") + after >= _need("n", "n2", percent))


def _may_link_first(percent: int) -> Column:
    """The same if the shingle is the first that the two have in common. Each link has such a shingle in both prefixes."""
    after = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    return _sizes_fit(percent) & (after >= _need("n", "n2", percent))


def _second(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *[F.col(c).alias(c + "2") for c in names])


def _bloom(keys: DataFrame, n: int) -> np.ndarray:
    """A bit for the first bytes of each key."""
    bits = 1 << 12
    while bits < MAX_BLOOM and bits < 16 * n:
        bits *= 2

    def marked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, np.uint64)
        for batch in it:
            for key in batch.column(0).to_pylist():
                at = int.from_bytes(key[:8], "little") & (bits - 1)
                own[at >> 6] |= np.uint64(1 << (at & 63))
        where = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(own[where].view(np.int64), pa.int64())], names=["at", "bits"])

    out = np.zeros(bits // 64, np.uint64)
    got = keys.mapInArrow(tidy(marked), "at int, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out[got["at"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, items) of at least the entities in keys."""
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(keys, keys.count()))

    def picked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, seen = shared.value, set()
        mask = len(bloom) * 64 - 1
        for batch in it:
            names, items = [], []
            for own in sets_of(batch.column(0)):
                key = _key(own)
                at = int.from_bytes(key[:8], "little") & mask
                if len(own) and int(bloom[at >> 6]) >> (at & 63) & 1 and key not in seen:
                    names.append(key)
                    items.append(own.view(np.int64))
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(items, pa.list_(pa.int64()))], names=["key", "items"])

    return docs.select("text").mapInArrow(tidy(picked), "key binary, items array<bigint>").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of keys those that link. Sets are compared row by row in the JVM, so no batch of long ones is ever held."""
    first = sets.select(F.col("key").alias("a"), F.col("items").alias("x"))
    second = sets.select(F.col("key").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return salted_join(salted_join(pairs, first, "a", frequent_of(pairs, "a")), second, "b", frequent_of(pairs, "b")).where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def components(links: DataFrame, staging: Staging, name: str) -> DataFrame:
    """(key, label) of all ends of links (a, b): equal labels within a component. Contracts the graph until no link is left."""
    labels, edges, step = None, links, 0
    while step == 0 or not edges.isEmpty():
        ends = edges.select(F.col("a").alias("key"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("key"), F.col("a").alias("to")))
        found = staging.write(ends.groupBy("key").agg(F.least("key", F.min("to")).alias("to"), F.count(F.lit(1)).alias("n")), f"{name}-parent{step}")
        hot, parent = frequent(found, "key", "n"), found.drop("n")
        if labels is None:
            labels = parent.withColumnRenamed("to", "label")
        else:
            moved = salted_join(labels, parent.select(F.col("key").alias("label"), "to"), "label", frequent_of(labels, "label"), "left")
            labels = moved.select("key", F.coalesce("to", "label").alias("label"))
        labels = staging.write(labels, f"{name}-labels{step}")
        up = edges
        for end in ("a", "b"):
            up = salted_join(up, parent.select(F.col("key").alias(end), F.col("to").alias(end + "2")), end, hot)
        edges = staging.write(up.where(F.col("a2") != F.col("b2")).select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{name}-edges{step}")
        step += 1
    return labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    staging = Staging(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(docs.sparkSession):
        classes = sketch(docs)
    staging.release()
    own = staging.write(entities(docs, classes, percent), "entities")
    usable = own.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    members = staging.write(usable.groupBy("key", "gid", "n").count(), "members")
    copies, members = frequent(members, "key"), members.drop("count")

    # groups by prefix shingle, where at least two groups have it
    posts = usable.where(F.col("prefix").isNotNull()).select("gid", "n", "heavy", F.posexplode("prefix").alias("pos", "token"))
    shared = posts.groupBy("token").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi")
    shared = staging.write(shared.select("token", "m"), "tokens")
    posts = staging.write(salted_join(posts, shared.select("token"), "token", frequent(shared, "token", "m")).dropDuplicates(["token", "gid"]), "posts")
    staging.release()
    hub_key = F.least("pos", F.lit((1 << 19) - 1)).cast("long") * (1 << 43) + F.col("gid").bitwiseAND((1 << 43) - 1)
    counts = staging.write(posts.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(hub_key).alias("hub")), "counts")
    hot = frequent(counts, "token", "m")
    many = staging.write(salted_join(posts, counts.where(F.col("m") > FEW), "token", hot), "many")
    few = posts.join(counts.where(F.col("m") <= FEW), "token").select("token", "gid", "n", "pos", "heavy")
    few = staging.write(few, "few")

    pair = few.join(_second(few, "gid", "n", "pos", "heavy"), "token").where((F.col("gid") < F.col("gid2")) & _may_link(percent))
    rest = F.greatest(F.ceil(F.col("n") * percent / 100 - 1e-9), F.ceil(F.col("n2") * percent / 100 - 1e-9)) - 1
    enough = F.col("common") + F.least("heavy", "heavy2") + rest >= _need("n", "n2", percent)
    by_few = pair.groupBy("gid", "gid2", "n", "n2", "heavy", "heavy2").agg(F.count(F.lit(1)).alias("common")).where(enough).select("gid", "gid2")
    hubs = _second(many.where(hub_key == F.col("hub")).select("token", "gid", "n", "pos"), "gid", "n", "pos")
    by_hub = salted_join(many, hubs, "token", hot).where((F.col("gid") != F.col("gid2")) & _may_link_first(percent))
    by_hub = by_hub.select(F.least("gid", "gid2").alias("gid"), F.greatest("gid", "gid2").alias("gid2"))
    pairs = staging.write(by_few.unionByName(by_hub).distinct(), "group-pairs")

    # one member of each group stands for it in pairs with other groups, and is paired with its own group's members
    heads = members.groupBy("gid").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("size"))
    heads = staging.write(heads, "heads")
    hot1, hot2 = frequent_of(pairs, "gid"), frequent_of(pairs, "gid2")  # hubs
    across = salted_join(pairs, heads.select("gid", F.col("key").alias("a")), "gid", hot1)
    across = salted_join(across, heads.select(F.col("gid").alias("gid2"), F.col("key").alias("b")), "gid2", hot2).select("a", "b")
    within = salted_join(members, heads.where("size > 1").select("gid", F.col("key").alias("a")), "gid", frequent(heads, "gid", "size")).where(F.col("key") != F.col("a")).select("a", F.col("key").alias("b"))
    first = staging.write(across.unionByName(within), "pairs1")
    links = staging.write(_verified(first, _sets(docs, _ends(first)), percent), "links1")
    staging.release()
    labels = components(links, staging, "first")

    # candidates in different components
    label = members.join(labels, "key", "left").select("gid", "key", F.coalesce("label", "key").alias("label"))
    label = staging.write(label, "member-labels")
    state = label.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
    state = staging.write(state, "group-labels")
    second = _second(state, "gid", "lo", "hi", "size")
    both = salted_join(salted_join(pairs, state, "gid", hot1), second, "gid2", hot2)
    open_few = both.where(((F.col("size") > 1) | (F.col("size2") > 1)) & ~_same()).select("gid", "gid2")
    open_self = state.where(F.col("lo") != F.col("hi")).select("gid", F.col("gid").alias("gid2"))
    open_many = _open_pairs(many.select("token", "gid", "n", "pos").join(state.select("gid", "lo", "hi"), "gid"), hot, staging, percent)
    left = staging.write(open_few.unionByName(open_self).unionByName(open_many).distinct(), "open-pairs")
    if not left.isEmpty():
        one = label.select("gid", F.col("key").alias("a"), F.col("label").alias("la"))
        two = label.select(F.col("gid").alias("gid2"), F.col("key").alias("b"), F.col("label").alias("lb"))
        wide = frequent(state, "gid", "size")  # groups of many members: these are dealt, their pairs sent to each place
        rest_pairs = salted_join(two, salted_join(one, left, "gid", wide), "gid2", wide).where(F.col("la") != F.col("lb"))
        rest_pairs = staging.write(rest_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs2")
        more = _verified(rest_pairs, _sets(docs, _ends(rest_pairs)), percent)
        links = staging.write(links.unionByName(more), "links2")
        staging.release()
        labels = components(links, staging, "second")

    # the smallest id of each component
    first_ids = usable.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    with_label = first_ids.join(labels, "key", "left").select("doc_id", "key", F.coalesce("label", "key").alias("label"))
    lowest = with_label.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = staging.write(members.join(labels, "key", "left").select("key", F.coalesce("label", "key").alias("label")), "last-labels")
    named = salted_join(named, lowest, "label", frequent_of(named, "label")).select("key", "component_id")
    done = salted_join(own.select("doc_id", "n", "key"), named, "key", copies, "left")
    has_id = F.col("doc_id").isNotNull()
    return done.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(has_id & (F.col("n") > 0), F.col("component_id")).when(has_id, F.col("doc_id")).alias("component_id"))


def _open_pairs(rows: DataFrame, hot: DataFrame, staging: Staging, percent: int) -> DataFrame:
    """Group pairs (gid, gid2) that may link at a common shingle and aren't whole in one component, of rows (token, gid, n, pos, lo, hi).

    At the first common shingle the smaller of two linked groups has at least need(n, n) of its own shingles left, and the
    larger one need(n, least size of a smaller one). Rows without a possible partner go first; what stays is paired with
    the rows outside the shingle's largest component only.
    """
    left = F.col("n") - F.col("pos")
    small = left >= F.ceil(F.col("n") * 2 * percent / (100 + percent) - 1e-9)
    least = rows.where(small).groupBy("token").agg(F.min("n").alias("least"))
    floor = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100 - 1e-9))
    rows = salted_join(rows, least, "token", hot).withColumn("small", small).where(F.col("small") | (left >= F.ceil((F.col("n") + floor) * percent / (100 + percent) - 1e-9)))
    rows = staging.write(rows.drop("least"), "possible")
    mixed = rows.groupBy("token").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where(F.col("a") != F.col("b")).select("token")
    main = rows.where("lo = hi").groupBy("token", "lo").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(F.max_by("lo", "m").alias("main"))
    rows = staging.write(salted_join(rows, mixed.join(main, "token", "left"), "token", hot), "mixed")
    minor = F.col("main").isNull() | (F.col("lo") != F.col("main")) | (F.col("hi") != F.col("main"))
    own = ("gid", "n", "pos", "lo", "hi")
    rows = rows.withColumn("minor", F.coalesce(minor, F.lit(True))).drop("main")
    few = rows.where("minor").drop("small", "minor")
    # of each pair one side is outside the largest component: there are few of these rows, and they are sent to every place of a frequent shingle
    some = salted_join(_second(rows.where("small").drop("small", "minor"), *own), few, "token", hot)
    rest = salted_join(rows.where(~F.col("minor")).drop("small", "minor"), _second(rows.where("small and minor").drop("small", "minor"), *own), "token", hot)
    open_ = (F.col("n") >= F.col("n2")) & (F.col("gid") != F.col("gid2")) & ~_same() & _may_link_first(percent)
    pairs = some.where(open_).select("gid", "gid2").unionByName(rest.where(open_).select("gid", "gid2"))
    return pairs.select(F.least("gid", "gid2").alias("gid"), F.greatest("gid", "gid2").alias("gid2")).distinct()


def _same() -> Column:
    """Both groups lie whole in one component."""
    return (F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, the one with the smallest id; null ids and texts without words all stay."""
    staging = Staging(spark, "neardup-stage")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        found = near_duplicates(docs.select("doc_id", "text"))
        gone = staging.write(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")), "gone")
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    # repeated ids: rows are told apart by numbers of their own
    safe = [f"_own{i}" for i in range(len(docs.columns))]
    rows = staging.write(docs.toDF(*safe).withColumn("_row", F.monotonically_increasing_id()), "rows")
    id_, text = (F.col(safe[docs.columns.index(c)]) for c in ("doc_id", "text"))
    ids = rows.where(id_.isNotNull()).select(F.col("_row"), id_.cast("long").alias("_id"))
    found = near_duplicates(rows.where(id_.isNotNull()).select(F.col("_row").alias("doc_id"), text.alias("text")))
    found = found.select(F.col("doc_id").alias("_row"), "component_id").join(ids, "_row")
    best = found.groupBy("component_id").agg(F.min(F.struct("_id", "_row")).alias("best")).select(F.col("best._row").alias("_row"))
    best = staging.write(best, "best")
    stay = rows.join(best, "_row", "left_semi").unionByName(rows.where(id_.isNull()))
    return stay.select(*safe).toDF(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
d AS (SELECT n.doc_id, n.n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s JOIN n USING (doc_id) GROUP BY n.doc_id, n.n),
r AS (SELECT k, n, min(doc_id) AS rep FROM d GROUP BY k, n),
f AS (SELECT g FROM s JOIN r ON s.doc_id = r.rep GROUP BY g HAVING count(*) >= 2),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM (SELECT s.* FROM s JOIN r ON s.doc_id = r.rep SEMI JOIN f USING (g)) a JOIN (SELECT s.* FROM s JOIN r ON s.doc_id = r.rep) b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS (SELECT r.k, r.n, least(r.rep, coalesce(min(reach.y), r.rep)) AS component_id FROM r LEFT JOIN reach ON reach.x = r.rep GROUP BY r.k, r.n, r.rep)
SELECT w.doc_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN d ON d.doc_id = w.doc_id LEFT JOIN c ON c.k = d.k AND c.n = d.n
"""
