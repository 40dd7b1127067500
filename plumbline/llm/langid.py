"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of non-letters become one space, and all n-grams of 1 to 3 characters are hashed into a fixed
number of buckets. The log-probability matrix (buckets x languages) is broadcast; its size is fixed by the number of buckets
and the closed set of languages. Scoring gathers matrix rows for a whole batch and sums them by document in numpy.

The classifier is fitted on a sample of labelled rows: at most about ``FIT_ROWS`` documents of each language, chosen by a
hash of the id, so rare languages keep all their rows. All languages are equally likely before a text is read (a uniform
prior), as a corpus's shares say little of the next text. Everything else covers every row and every character.

Defined results: a null text or one without letters is ``und`` with score 0; without any labelled row every text is ``und``;
ties go to the first language in sort order; null ids are scored like others and count as not held out; repeated rows each
get a result; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import id_crc, schema_of, table

BUCKETS = 1 << 15
FIT_ROWS = 2000
#: Characters whose n-grams numpy handles at once; a text's letters are held whole, at some 15 bytes a character.
CHUNK = 1 << 20
_GAP = np.uint32(1)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point, whether it is a letter; made once in each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters with single spaces between runs; empty without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a run of letters stands for all that is between
    out = np.where(letter, code, np.uint32(32))[keep]
    return out if letter.any() else out[:0]


def hashed(codes: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that begin at each character: n = 1, 2 and 3, one row each."""
    a = codes.astype(np.uint64)
    b = np.append(a[1:], np.uint64(0))
    c = np.append(b[1:], np.uint64(0))
    mix = np.stack([a * np.uint64(0x9E3779B97F4A7C15), a * np.uint64(0xC2B2AE3D27D4EB4F) + b * np.uint64(0x165667B19E3779F9), a * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xA0761D6478BD642F) + c * np.uint64(0xE7037ED1A0B428DB)])
    mix ^= mix >> np.uint64(29)
    mix *= np.uint64(0xBF58476D1CE4E5B9)
    return (mix >> np.uint64(64 - 15)).astype(np.int64) & (BUCKETS - 1)


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Documents in groups of about CHUNK characters: their places, all codes, and where each document begins."""
    at, parts, starts, n = [], [], [], 0
    for i, text in enumerate(texts):
        codes = _codes(text) if text else np.zeros(0, np.uint32)
        if not len(codes):
            continue
        at.append(i)
        parts.append(np.concatenate([codes, np.repeat(_GAP, 3)]))  # n-grams don't reach into the next document
        starts.append(n)
        n += len(parts[-1])
        if n >= CHUNK:
            yield at, np.concatenate(parts), np.array(starts)
            at, parts, starts, n = [], [], [], 0
    if at:
        yield at, np.concatenate(parts), np.array(starts)


def stretches(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The buckets of codes, about CHUNK characters at once: number of the first document in a stretch, where documents begin in it, buckets."""
    for at in range(0, len(codes), CHUNK):
        end = min(at + CHUNK, len(codes))
        first = int(np.searchsorted(starts, at, side="right")) - 1
        last = int(np.searchsorted(starts, end, side="left"))
        yield first, np.maximum(starts[first:last] - at, 0), hashed(codes[at : end + 2])[:, : end - at]


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities, of (text, lang, doc_id) rows."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, rows / counts[k]))])
    picked = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(BUCKETS, np.int64) for k in langs}
        for batch in it:
            lang = batch.column("lang").to_pylist()
            for at, codes, starts in _groups(batch.column("text").to_pylist()):
                for first, begins, h in stretches(codes, starts):
                    for i, own in zip(at[first:], np.split(h, begins[1:], axis=1), strict=False):
                        total[lang[i]] += np.bincount(own.ravel(), minlength=BUCKETS)
        for k, v in total.items():
            where = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(where), pa.string()), pa.array(where, pa.int32()), pa.array(v[where], pa.int64())], names=["lang", "bucket", "n"])

    sums = picked.select("text", "lang").mapInArrow(counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.full((BUCKETS, len(langs)), 0.5)
    seen[sums["bucket"].to_numpy(), sums["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()] += sums["n"].to_numpy()
    return langs, np.log(seen / seen.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """All columns of docs, and lang_pred and score; columns so named are replaced."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(matrix.T)))

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, by_lang = shared.value
        for batch in it:
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if names:
                for at, codes, starts in _groups(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                    sums = np.zeros((len(names), len(at)))
                    for first, begins, h in stretches(codes, starts):
                        sums[:, first : first + len(begins)] += [sum(np.add.reduceat(row[h[k]], begins, dtype=np.float64) for k in range(3)) for row in by_lang]
                    best = sums.argmax(axis=0)
                    top = 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
                    for i, b in zip(at, best, strict=True):
                        pred[i] = names[b]
                    score[at] = top
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(scored, schema_of(docs, "lang_pred string, score double"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(id_crc("doc_id", 3) == 1, F.lit(False))
    langs, matrix = fit(docs.where(~held).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), langs, matrix).drop("text")
