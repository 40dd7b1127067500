"""Repair of conversation structure as the composition of three weighted automata, searched lazily for its best path.

The input acceptor reads a conversation's rows in order; the edit transducer keeps, re-roles or deletes a row or inserts an empty
one, at a cost, and writes the role of what stays; the grammar acceptor has four states for ``(s?(ua)+)?``. Only composed states
that some path reaches are made, row by row, which is their topological order: after each row its insertions (two at most, as more would close a
loop that costs more and leads nowhere else) are followed. Weights are pairs (cost, label string) under the lexicographic order, so equal costs go to
the least string. No string is built for that: of the at most four open paths the order of each two is kept, with what one has more
than the other if it begins it. Two equally cheap ways to one state never begin one another, as labels decide the path.

Rows stream through Python in Arrow batches, sorted by Spark, a conversation in one task because its digest is one sequential
hash. What a task holds is four bytes a row for the way back and four hash states, whatever the length of texts; earlier rows with the same role and text are found by
aggregates and a salted join, not by a set.

Defined results: a null role or text is one space and a null id or turn is one space in the key of the damage; rows of a null id are one conversation; rows
of equal turns are ordered by role, then text; repeated rows are duplicates; rows of any length are read whole; a conversation without rows after damage
has zeros, an empty audit and the digest of the empty text; columns other than the four named ones are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import frequent, salted_join, table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What an undeleted truncated row costs besides.
TRUNCATED = 3
#: The grammar: states 0 (nothing yet), 1 (after the system turn), 2 (after a user turn) and 3 (after an assistant turn).
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: An insertion's target from each state: there is one turn that may be inserted.
NEXT = tuple(own.get("u", own.get("a")) for own in GRAMMAR)
SPACE = " \t\n\v\f\r"
OUT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Repair:
    """The search over one conversation, given row by row."""

    def __init__(self):
        first = hashlib.sha256()
        self.cost: list[int | None] = [0, None, None, None]
        self.hash = [first, None, None, None]
        self.empty = [True, True, True, True]
        #: rest[a][b]: -1 or 1 if path a's string is less or greater than path b's, or the string that a has more (if b begins a).
        self.rest: dict[tuple[int, int], int | str] = {(0, 0): ""}
        self._steps = bytearray()
        self._labels: list[str] = []
        self._number: dict[str, int] = {}
        self._take(self._insertions({0: (0, 0, "")}), None)

    def _less(self, a: int, x: str, b: int, y: str) -> int | tuple[int, str]:
        """How path a + x stands to path b + y: -1, 1, or (0, what the first has more), (2, what the second has more)."""
        known = self.rest[a, b]
        if isinstance(known, int):
            return known
        if a != b and known == "":  # a begins b
            y = self.rest[b, a] + y
        else:
            x = known + x
        if x.startswith(y):
            return 0, x[len(y) :]
        if y.startswith(x):
            return 2, y[len(x) :]
        return -1 if x < y else 1

    def _better(self, one: tuple, two: tuple | None) -> bool:
        """(cost, path, labels): is the first less?"""
        if two is None or one[0] != two[0]:
            return two is None or one[0] < two[0]
        return self._less(one[1], one[2], two[1], two[2]) == -1

    def _insertions(self, rows: dict[int, tuple]) -> dict[int, tuple]:
        """The ways that a row's edits lead, and those with one or two insertions after them."""
        best = dict(rows)
        for state, (cost, path, label) in rows.items():
            self._offer(best, NEXT[state], (cost + COSTS[INSERT], path, label + INSERT))
            if state < 2:  # a user turn, then an assistant turn
                self._offer(best, NEXT[NEXT[state]], (cost + 2 * COSTS[INSERT], path, label + 2 * INSERT))
        return best

    def _offer(self, best: dict[int, tuple], target: int, way: tuple) -> None:
        if self._better(way, best.get(target)):
            best[target] = way

    def row(self, initial: str, head: bytes, text: bytes, gone: bool, truncated: bool) -> None:
        """A row's role initial, ``role:`` and text in UTF-8, whether it has to be deleted, and whether it is truncated."""
        best: dict[int, tuple] = {}
        extra = TRUNCATED if truncated else 0
        for state, cost in enumerate(self.cost):
            if cost is None:
                continue
            self._offer(best, state, (cost + COSTS[DELETE], state, DELETE))
            if gone:
                continue
            if initial in GRAMMAR[state]:
                self._offer(best, GRAMMAR[state][initial], (cost + COSTS[KEEP] + extra, state, KEEP))
            self._offer(best, NEXT[state], (cost + COSTS[REROLE] + extra, state, REROLE))
        self._take(self._insertions(best), (head, text))

    def _take(self, best: dict[int, tuple], row: tuple[bytes, bytes] | None) -> None:
        """The chosen ways become the open paths."""
        rest: dict[tuple[int, int], int | str] = {}
        for a, (_, p, x) in best.items():
            for b, (_, q, y) in best.items():
                found = self._less(p, x, q, y) if a != b else (0, "")
                rest[a, b] = found if isinstance(found, int) else found[1] if found[0] == 0 else ""
        hashes, empty, step = [None] * 4, [True] * 4, bytearray(4)
        for state, (_, path, labels) in best.items():
            digest, blank, at = self.hash[path].copy(), self.empty[path], path
            for label in labels:
                if label == DELETE:
                    continue
                if label == KEEP:
                    parts = row
                    at = GRAMMAR[at][row[0][:1].decode()]
                else:
                    at = NEXT[at]
                    parts = ((b"user:", b"assistant:")[at == 3], row[1] if label == REROLE else b"")
                if not blank:
                    digest.update(b"\n")
                digest.update(parts[0])
                digest.update(parts[1])
                blank = False
            hashes[state], empty[state] = digest, blank
            if labels not in self._number:
                self._number[labels] = len(self._labels)
                self._labels.append(labels)
            step[state] = path << 6 | self._number[labels]
        self.cost = [best[s][0] if s in best else None for s in range(4)]
        self.hash, self.empty, self.rest = hashes, empty, rest
        self._steps += step

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and the repaired text's digest."""
        best = None
        for state in FINAL:
            if self.cost[state] is not None:
                new = (self.cost[state], state, "")
                if self._better(new, best):
                    best = new
        state, parts = best[1], []
        end = state
        for i in range(len(self._steps) - 4, -1, -4):
            code = self._steps[i + state]
            parts.append(self._labels[code & 63])
            state = code >> 6
        return best[0], "".join(reversed(parts)), self.hash[end].hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows after damage; a dropped row stays as a mark of its conversation."""
    blank = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    rows = rows.withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("_copy")).drop("_copy")


def _faults() -> tuple[Column, Column]:
    """Blank, and cut off: the last character that is no white space ends no sentence."""
    bare = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    return bare == "", ~bare.isin(".", "!", "?")


def flagged(rows: DataFrame) -> DataFrame:
    """rows with blank, cut (truncated) and later: an earlier turn of the conversation has the same role and text."""
    blank, cut = _faults()
    rows = rows.withColumns({"blank": blank, "cut": cut})
    live = ~F.col("dropped") & ~F.col("blank")
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text"), 256)
    place, out = F.struct("turn"), ["conv_id", "turn", "role", "text", "dropped", "blank", "cut", "later"]
    texts = rows.where(live).withColumn("key", key)
    seen = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    found = salted_join(texts, seen, "key", frequent(seen, "key", "n"), "left").withColumn("later", F.coalesce(F.col("first") < place, F.lit(False)))
    return found.select(out).unionByName(rows.where(~live).withColumn("later", F.lit(False)).select(out))


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``damaged`` rows, with the columns of ``OUT``."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in OUT.split(", ")]
        types = [*[pa.int64()] * 7, pa.string(), pa.string()]
        state: dict | None = None
        done: list[tuple] = []
        held = 0

        def begin(conv) -> dict:
            return {"conv": conv, "turns": [0, None, None], "faults": [0, 0, 0], "illegal": 0, "last": None, "initial": None, "search": Repair()}

        def end(s: dict) -> tuple:
            n, low, high = s["turns"]
            cost, audit, digest = s["search"].result()
            return (s["conv"], high - low + 1 - n if n else 0, *s["faults"], s["illegal"], cost, audit, digest)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        for batch in batches:
            size = max(1, min(batch.num_rows, (1 << 24) * batch.num_rows // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, size):  # texts of a bounded number of bytes as Python objects
                piece = batch.slice(start, size)
                texts = pc.cast(piece.column(3), pa.binary())
                for conv, turn, role, text, dropped, blank, cut, later in zip(*[c.to_pylist() for c in [*piece.columns[:3], texts, *piece.columns[4:]]], strict=True):
                    if state is None or state["conv"] != conv:
                        if state is not None:
                            done.append(end(state))
                            held += 200 + len(done[-1][7])
                            if held >= 1 << 22:
                                yield packed()
                                done, held = [], 0
                        state = begin(conv)
                    if dropped:
                        continue
                    turns, initial, own = state["turns"], role[:1], (turn, role, text)
                    if turn is not None and turn != turns[2]:
                        turns[:] = [turns[0] + 1, turn if turns[1] is None else turns[1], turn]
                    again = not blank and (later or state["last"] == own)
                    cut = cut and not blank and not again
                    state["faults"] = [a + b for a, b in zip(state["faults"], (blank, again, cut), strict=True)]
                    if state["initial"] is not None and state["initial"] + initial not in ("su", "ua", "au"):
                        state["illegal"] += 1
                    state["initial"], state["last"] = initial, own
                    state["search"].row(initial, role.encode("utf-8", "surrogatepass") + b":", text, blank or again, cut)
        if state is not None:
            done.append(end(state))
        if done:
            yield packed()

    order = ["conv_id", "turn", "role", "text"]
    return flagged(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", F.desc("dropped")).select(*order, "dropped", "blank", "cut", "later").mapInArrow(stream, OUT)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: crc32 by its bits; the best path as a recursive query that keeps (cost, audit, text) of each grammar state.
ORACLE = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
k AS (SELECT *, xor(list_reduce(list_transform(string_split(id, ''), lambda x: ord(x)::BIGINT), lambda s, b: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(s, b)), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, right(regexp_replace(text, '[\x20\x09-\x0D]+\z', ''), 1) AS final FROM d),
f AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ids AS (SELECT *, row_number() OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT ids.n, f.* FROM f JOIN ids ON f.conv_id IS NOT DISTINCT FROM ids.conv_id),
edits(a, label, initial, b, price, written) AS (VALUES (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, ''), (3, 'K', 'u', 2, 0, ''),
  (0, 'R', '', 2, 3, 'user'), (1, 'R', '', 2, 3, 'user'), (2, 'R', '', 3, 3, 'assistant'), (3, 'R', '', 2, 3, 'user'), (0, 'D', '', 0, 4, ''), (1, 'D', '', 1, 4, ''), (2, 'D', '', 2, 4, ''), (3, 'D', '', 3, 4, '')),
inserts(a, label, b, price, written) AS (VALUES (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''), (0, 'I', 2, 3, chr(10) || 'user:'), (1, 'I', 2, 3, chr(10) || 'user:'), (3, 'I', 2, 3, chr(10) || 'user:'),
  (2, 'I', 3, 3, chr(10) || 'assistant:'), (0, 'II', 3, 6, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 'II', 3, 6, chr(10) || 'user:' || chr(10) || 'assistant:')),
walk(n, i, state, cost, audit, written) AS (
  SELECT n, 0::BIGINT, b, price::BIGINT, label, written FROM ids, inserts WHERE a = 0
  UNION ALL
  SELECT n, i, state, min(cost), arg_min(audit, {'c': cost, 'a': audit}), arg_min(written, {'c': cost, 'a': audit}) FROM (
    SELECT w.n, r.i, s.b AS state, w.cost + e.price + s.price + CASE WHEN e.label <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END AS cost, w.audit || e.label || s.label AS audit,
      w.written || CASE e.label WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || e.written || ':' || r.text END || s.written AS written
    FROM walk w JOIN r ON r.n = w.n AND r.i = w.i + 1 JOIN edits e ON e.a = w.state AND (e.label <> 'K' OR e.initial = r.initial) AND (e.label = 'D' OR r.fault NOT IN ('blank', 'duplicate')) JOIN inserts s ON s.a = e.b)
  GROUP BY n, i, state),
ends AS (SELECT n, count(*) AS rows FROM r GROUP BY n),
best AS (SELECT w.n, min(cost) AS cost, arg_min(audit, {'c': cost, 'a': audit}) AS audit, arg_min(written, {'c': cost, 'a': audit}) AS written FROM walk w LEFT JOIN ends ON ends.n = w.n WHERE w.i = coalesce(ends.rows, 0) AND state IN (0, 3) GROUP BY w.n)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(substr(written, 2)) AS repaired_sha256
FROM ids JOIN best ON best.n = ids.n LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
