"""Sets of hashed word shingles, computed in numpy over whole Arrow batches.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A document's set holds a 64-bit hash of every
five consecutive words, or of all its words if it has fewer. A word's hash sums a 64-bit number for each of its bytes, which
depends on the byte and its place in the word and follows no rule between places (no powers), so words that differ in any
way share a hash with a chance of about 2^-64, and two sets of n shingles one of about n^2 / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text handled by numpy at once; a longer text is handled alone.
CHUNK = 1 << 19
#: Places in a word that have numbers of their own; later ones reuse them times an odd number for each such stretch.
PLACES = 64
_WORD = np.ones(256, np.bool_)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_FOLD = np.arange(256)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: By place and byte.
_CELL = mix((np.arange(PLACES, dtype=np.uint64)[:, None] * np.uint64(256) + _FOLD.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).ravel()
_PLACE = mix(np.arange(1, WORDS + 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts that lie one after another in data, and where each text's hashes begin."""
    n, docs = len(data), len(bounds) - 1
    is_word = _WORD[data]
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] |= is_word[inner]
    ends[inner - 1] |= is_word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = np.arange(n, dtype=np.int32)
    at -= np.maximum.accumulate(np.where(begins, at, 0))  # places in words
    values = _CELL[(at & np.int32(PLACES - 1)) << 8 | data]
    if len(start) and (end - start).max() > PLACES:
        late = np.flatnonzero(is_word & (at >= PLACES))
        values[late] *= mix((at[late] // PLACES).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    word = mix(sums[end] - sums[start])
    first = np.searchsorted(start, bounds)  # each text's first word
    count = np.diff(first)
    made = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    place = np.repeat(first[:-1] - at[:-1], made) + np.arange(at[-1])
    length = np.repeat(np.minimum(count, WORDS), made)
    total = np.zeros(at[-1], np.uint64)
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        total += np.where(k < length, padded[place + k], np.uint64(0)) * _PLACE[k]
    return mix(total + length.astype(np.uint64) * _PLACE[WORDS]), at


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text (null: empty), its distinct shingle hashes in ascending order."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, body = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        j = min(j, n)
        found, at = _hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(j - i):
            own = np.sort(found[at[k] : at[k + 1]])
            yield own if len(own) < 2 else own[np.concatenate([[True], own[1:] != own[:-1]])]
        i = j
