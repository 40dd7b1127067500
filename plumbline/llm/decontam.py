"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised by lower-casing A-Z and keeping words of digits, letters and non-ASCII characters. Every benchmark item
gives windows of ``width`` consecutive words (an item with fewer words, but not none, is one window). The windows, each
between single spaces, form one automaton; a document's words, joined likewise, are scanned once. An occurrence is mapped
back to word numbers and, for documents with hits, to code points of the original text.

One automaton holds windows of about ``SHARD_BYTES`` of text. A larger benchmark is dealt by a hash of the item id over as many
automata as that takes; the texts are scanned for each of them and the hits put together by document, with the same result.
The driver holds one automaton's items at a time, and each Python worker builds the automaton once.

Defined results: null and empty texts have no words and no hits; null or empty items have no windows; an item without an id hits like
others and is reported as null, at the end; equal items are reported with all their ids; repeated document rows each get their own result; an empty benchmark leaves all rows clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Staging, kept, schema_of, table, tidy

WIDTH = 10
SHARD_BYTES = 64 << 20
#: A-Z to a-z; other ASCII that is no word character to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SPANS = "array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], width: int = WIDTH) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def _padded(words) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def build_automaton(items: list[tuple[int, str]], width: int = WIDTH):
    """Of (item_id, text) pairs; a pattern's value is (number of words, item ids). None without any window."""
    import ahocorasick

    found: dict[tuple[bytes, ...], set[int]] = {}
    for item_id, text in items:
        for w in windows_of(words_of(text), width):
            found.setdefault(w, set()).add(item_id)
    if not found:
        return None
    auto = ahocorasick.Automaton()
    for w, ids in found.items():
        auto.add_word(_padded(w), (len(w), tuple(ids)))
    auto.make_automaton()
    return auto


def scan(auto, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
    """The numbers of the hit words and the ids of the items that occur."""
    if auto is None or not words:
        return np.zeros(0, np.int64), set()
    ids: set[int] = set()
    ends, counts = [], []
    for end, (n, items) in auto.iter(_padded(words)):
        ends.append(end)
        counts.append(n)
        ids.update(items)
    if not ends:
        return np.zeros(0, np.int64), ids
    last = np.searchsorted(np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1), np.array(ends))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, last - np.array(counts) + 1, 1)
    np.add.at(cover, last + 1, -1)
    return np.flatnonzero(np.cumsum(cover[:-1])), ids


def char_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code points of the original text, from the first word's start to the last word's end."""
    if not len(hit):
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [{"start": places[r[0]][0], "end": places[r[-1]][1]} for r in runs]


def _nulls_last(item_id: int | None) -> tuple[bool, int]:
    return item_id is None, item_id or 0


_kept: dict[str, object] = {}


def _automaton(shared):
    """Built once in each Python worker."""
    key, items, width = shared.value
    if key not in _kept:
        _kept.clear()
        _kept[key] = build_automaton(items, width)
    return _kept[key]


def _n_shards(benchmark: DataFrame, width: int, limit: int) -> int:
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return int((benchmark.agg(F.sum(size.cast("double"))).first()[0] or 0) * width // limit) + 1


def _items(benchmark: DataFrame, n_shards: int, k: int) -> list[tuple[int, str]]:
    """The items of one shard."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    return [(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n_shards)) == k).collect()]


def _key(items: list[tuple[int, str]], width: int) -> str:
    return hashlib.sha256(repr((sorted(items, key=lambda x: (_nulls_last(x[0]), x[1])), width)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns of docs, and n_words, n_hit, item_ids, hit_spans (code points of the text); columns so named are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "item_ids", "hit_spans")
    n_shards = _n_shards(benchmark, width, shard_bytes)
    added = "n_words bigint, n_hit bigint, item_ids array<bigint>, hit_spans " + SPANS

    def scanned(df: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((_key(items, width), items, width))

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = _automaton(shared)
            for batch in it:
                n_words, n_hit, ids, spans = [], [], [], []
                for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                    words = words_of(text)
                    hit, found = scan(auto, words)
                    n_words.append(len(words))
                    n_hit.append(len(hit))
                    ids.append(sorted(found, key=_nulls_last))
                    spans.append(char_spans(text or "", hit))
                cols = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "n_words", "n_hit", "item_ids", "hit_spans"])

        return df.mapInArrow(tidy(batches), schema_of(df, added))

    if n_shards == 1:
        return scanned(docs, _items(benchmark, 1, 0))
    return _merged(docs, (_items(benchmark, n_shards, k) for k in range(n_shards)), scanned)


def _merged(docs: DataFrame, shards, scanned) -> DataFrame:
    """Hits of several automata: the runs of every shard are joined to runs of the document."""
    staging = Staging(docs.sparkSession, "decontam")
    staged = staging.write(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")
    parts = None
    for k, items in enumerate(shards):
        part = staging.write(scanned(staged, items).where(F.size("hit_spans") > 0).select("_row", "item_ids", "hit_spans"), f"hits{k}")
        parts = part if parts is None else parts.unionByName(part)
    hits = parts.groupBy("_row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.flatten(F.collect_list("hit_spans")).alias("hit_spans"),
    )

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n_words, n_hit, spans = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("hit_spans").to_pylist(), strict=True):
                places = [m.span() for m in _WORD.finditer(text or "")]
                hit = np.zeros(len(places) + 1, np.int64)
                starts = [p[0] for p in places]
                for s in own or []:
                    hit[np.searchsorted(starts, s["start"])] += 1
                    hit[np.searchsorted(starts, s["end"])] -= 1
                where = np.flatnonzero(np.cumsum(hit[:-1]))
                n_words.append(len(places))
                n_hit.append(len(where))
                spans.append(char_spans(text or "", where))
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("hit_spans", "item_ids")]
            ids = pa.array([x or [] for x in batch.column("item_ids").to_pylist()], pa.list_(pa.int64()))
            cols = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), ids, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*[batch.columns[i] for i in keep], *cols], names=[*[batch.schema.names[i] for i in keep], "n_words", "n_hit", "item_ids", "hit_spans"])

    both = staged.join(hits, "_row", "left").select(*staged.columns, "item_ids", "hit_spans")
    out = schema_of(staged, "n_words bigint, n_hit bigint, item_ids array<bigint>, hit_spans " + SPANS)
    return both.mapInArrow(tidy(joined), out).drop("_row")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    spans = F.array_join(F.transform("hit_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), spans.alias("hit_spans"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: only documents without a hit stay."""
    benchmark = table(spark, sf_dir, "benchmark")
    return kept(docs, lambda d: decontaminate(d, benchmark), "n_hit = 0")


ORACLE = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, low
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, lens WHERE len(w) >= n)),
m AS (SELECT DISTINCT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM m),
h AS (SELECT rid, count(*) AS n_hit FROM p GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY rid),
c AS (SELECT rid, unnest(w) AS word, unnest(regexp_split_to_array(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')[: len(w)]) AS gap, unnest(range(1, len(w) + 1)) AS p FROM t SEMI JOIN h USING (rid)),
e AS (SELECT rid, p, length(word) AS n, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY rid ORDER BY p) AS BIGINT) AS stop FROM c),
r AS (SELECT rid, min(stop - n) AS a, max(stop) AS z FROM (SELECT *, p - row_number() OVER (PARTITION BY rid ORDER BY p) AS run FROM e SEMI JOIN p USING (rid, p)) GROUP BY rid, run),
sp AS (SELECT rid, string_agg(a || ':' || z, ',' ORDER BY a) AS spans FROM r GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS hit_spans
FROM t LEFT JOIN h USING (rid) LEFT JOIN it USING (rid) LEFT JOIN sp USING (rid)
"""
