"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text are computed in Arrow batches. Trees are grown on quantised statistics with per-node gradient
histograms, then flattened into arrays (feature, threshold, left, right, value) that numpy walks for a whole batch at once.

The trees are fitted on about ``FIT_ROWS`` labelled ids at most, chosen by a hash of the id, one row for each; every document
is scored on its whole text.

Defined results: a null text counts as empty and has a score like any other text; null labels are not learnt from; a
document labelled more than once counts once, with its smallest label; of rows that repeat an id the one whose text has the
smallest digest is learnt from; with no labelled row, or one class only, the score is that class's share (0.5
without any); ids that are null are scored and not held out; repeated rows each get a result; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import id_crc, kept, schema_of, table, tidy

FIT_ROWS = 12_000
THRESHOLD = 0.3
BINS, TREES, DEPTH, RATE, L2, MIN_CHILD = 64, 60, 4, 0.15, 1.0, 5
#: Flagging terms learnt from labelled rows are no part of the statistics: only form, repetition and composition are.
STATS = (
    "log_chars", "log_words", "mean_word", "max_word", "distinct_words", "repeated_next", "distinct_pairs", "lines", "distinct_lines", "line_ends",
    "upper", "digits", "spaces", "non_ascii", "comma", "stop", "bang", "pipe", "currency", "hash", "percent", "ampersand", "star", "other_punct", "upper_words", "symbol_words", "byte_entropy", "top_word",
)


def stats(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(1, len(words))
    lines = raw.split(b"\n")
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    p = c[c > 0] / n
    punct = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    named = [int(c[ord(x)]) for x in ",.!|$#%&*"]
    seen = Counter(words)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(size.mean()), float(size.max()), len(seen) / m,
        sum(map(eq, words, words[1:])) / m, len(set(zip(words, words[1:], strict=False))) / m, len(lines) / m, len(set(lines)) / len(lines),
        sum(1 for x in lines if x.endswith((b".", b"!", b"?"))) / len(lines),
        c[65:91].sum() / n, c[48:58].sum() / n, (c[32] + c[9:14].sum()) / n, c[128:].sum() / n, *[x / n for x in named], (punct - sum(named)) / n,
        sum(map(bytes.isupper, words)) / m, sum(1 for w in seen if not w.isalnum()) / max(1, len(seen)), float(-(p * np.log(p)).sum()), (max(seen.values()) if seen else 0) / m,
    ]


def grow(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray | float]:
    """Flattened boosted trees for a 0/1 target; children and values are by (tree, node), a leaf's children are itself."""
    n, f = x.shape
    share = float(y.mean()) if n else 0.5
    base = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1)))
    out = {k: np.zeros((0, 1), t) for k, t in (("feature", np.int32), ("threshold", np.float64), ("left", np.int32), ("right", np.int32), ("value", np.float64))}
    if n == 0 or share in (0.0, 1.0):
        return out | {"base": base, "depth": 0}
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)], axis=1)  # bin b: x <= cuts[b]
    flat = binned + np.arange(f) * BINS
    raw = np.full(n, base)
    size = 2 ** (DEPTH + 1) - 1
    trees = {k: np.zeros((TREES, size), v.dtype) for k, v in out.items()}
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        trees["left"][t] = trees["right"][t] = np.arange(size)
        for at in range(size):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            trees["value"][t, at] = -RATE * gs / (hs + L2)
            if 2 * at + 2 >= size or len(rows) < 2 * MIN_CHILD:
                continue
            where = flat[rows].ravel()
            sums = [np.bincount(where, w, f * BINS).reshape(f, BINS).cumsum(axis=1)[:, :-1] for w in (np.repeat(g[rows], f), np.repeat(h[rows], f), np.ones(len(where)))]
            gain = sums[0] ** 2 / (sums[1] + L2) + (gs - sums[0]) ** 2 / (hs - sums[1] + L2) - gs**2 / (hs + L2)
            gain[(sums[2] < MIN_CHILD) | (len(rows) - sums[2] < MIN_CHILD)] = -1
            j, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                continue
            trees["feature"][t, at], trees["threshold"][t, at] = j, cuts[j][b]
            trees["left"][t, at], trees["right"][t, at] = 2 * at + 1, 2 * at + 2
            node[rows] = np.where(binned[rows, j] <= b, 2 * at + 1, 2 * at + 2)
        raw += trees["value"][t, node]
    return trees | {"base": base, "depth": DEPTH}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    raw, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for feature, threshold, left, right, value in zip(*[model[k] for k in ("feature", "threshold", "left", "right", "value")], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            node = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
        raw += value[node]
    return 1 / (1 + np.exp(-raw))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Trees from (doc_id, text) and (doc_id, quality) rows."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, rows / max(1, usable.count()))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))  # about rows ids at most, so it can be broadcast

    def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}  # one row for each id of the sample
        for batch in it:
            for doc_id, text, quality in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "quality")], strict=True):
                digest = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if doc_id not in best or digest < best[doc_id][0]:
                    best[doc_id] = (digest, quality, stats(text or ""))
        cols = list(zip(*best.values(), strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), *(pa.array(list(c), t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.list_(pa.float64())), strict=True))], names=["doc_id", "digest", "quality", "x"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("quality").cast("int"))
    one = picked.mapInArrow(tidy(measured), "doc_id bigint, digest binary, quality int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("digest", "quality", "x")).alias("r"))
    got = one.select("doc_id", "r.quality", "r.x").toPandas().sort_values("doc_id")  # about rows of them at most
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(STATS))
    return grow(x, got["quality"].to_numpy(np.float64))


def classify(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, and score and predicted; columns so named are replaced."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            got = score(shared.value, np.array([stats(t or "") for t in texts], np.float64).reshape(len(texts), len(STATS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(tidy(scored), schema_of(docs, "score double, predicted int"))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    """Trees learnt from the labelled rows whose id's crc32 modulo 5 is not 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int"))
    return fit(docs, labels.where(id_crc("doc_id", 5) != 0))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(id_crc("doc_id", 5) == 0, F.lit(False))
    return classify(docs.select("doc_id", held.alias("held_out"), "text"), fitted(spark, docs, sf_dir)).drop("text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    model = fitted(spark, docs, sf_dir)
    return kept(docs, lambda d: classify(d, model), "predicted = 1")
