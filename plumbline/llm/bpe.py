"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The lexicon: the corpus's most frequent words (counted over all documents, ``LEXICON_WORDS`` at most) are merged once and
compiled into a minimal acyclic automaton that shares prefixes and suffixes. Its arcs carry numbers that add up to a word's
place in sort order, and that place points to the word's ids. The automaton is one file of 32-bit integers, shipped to the
executors with addFile and memory-mapped by every Python worker; many words walk it in step. Words that it lacks are merged
exactly by rank. Each worker remembers a bounded number of words that it has met, and encodes a bounded stretch of text at once.

The tokenizer is read from a ``tokenizers`` JSON file whose model is BPE with word ends over a byte alphabet, with the NFC,
white-space and lower-case normalisers and the pattern for contractions, letters, single digits and the rest.

Defined results: null and empty texts have no ids and decode to the empty text; strings of special tokens inside a text become
those tokens; repeated rows each get a result; columns of the input named like an added one are replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Staging, schema_of, table, tidy

LEXICON_WORDS = 20_000
#: Words and pieces that a worker remembers before it starts anew, and characters of text that are encoded at once.
REMEMBERED, BATCH_CHARS = 150_000, 1 << 20
#: Words of more bytes are merged by heap.
SHORT = 48
_SPACE = "\t-\r \x85\xa0  -     　"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ranges(kind: str) -> str:
    """The code points whose general category begins with kind, as the inside of a character class."""
    own = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == kind]
    runs = [[own[0], own[0]]]
    for i in own[1:]:
        if i == runs[-1][1] + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """Exact encoding of words and texts by ranked merges."""

    def __init__(self, config: str):
        model = (whole := json.loads(config))["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.pieces = {i: s for s, i in self.vocab.items()}
        end = model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + end] for c in alphabet]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.pieces |= {i: s for s, i in self.special.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letter, number = _ranges("L"), _ranges("N")
        self.find = re.compile(f"[{letter}]+|[{number}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}{letter}{number}]+").findall
        self._odd = re.compile("[\x1c-\x1f]").search  # split() takes these for white space, the pattern doesn't
        self._run = re.compile(r"[,.](?=\s)(?<=(?:[^\w\s]|_)[,.])").search
        ranked = sorted((a << 20 | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self._pairs, self._rank = np.array([x[0] for x in ranked]), np.array([x[1] for x in ranked])
        self._made = np.zeros(len(ranked) + 1, np.int64)
        self._made[self._rank] = [x[2] for x in ranked]
        self._inner, self._last = np.array(self.inner), np.array(self.last)

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """Parts of a text, and whether each is a special token."""
        for part in self._cut.split(text) if self._cut else [text]:
            if part:
                yield part in self.special, part

    def chunks(self, text: str) -> list[str]:
        """Normalised pieces of a text without special tokens. White space only parts words, so each piece is cut by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if self._odd(text):
            return self.find(text)
        if not self._run(text):  # a single mark after a word is a word of its own: fewer different pieces
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
        return text.split()

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        return [w for c in self.chunks(text) for w in self.find(c)]

    def merge(self, word: str) -> list[int]:
        """Ids of a word: the pair of lowest rank, leftmost first, is merged until none is left."""
        return np.frombuffer(self.merge_many([word.encode("utf-8", "surrogatepass")])[0], np.int32).tolist()

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges where there is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where((self._pairs[at] == key) & (a >= 0) & (b >= 0), self._rank[at], len(self._pairs))

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words, each word's as 32-bit integers. Words of like length are merged in step, one merge of each at a time."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(order):
            size = len(words[order[start]])
            if size > SHORT:
                for i in order[start:]:
                    out[i] = np.array(self._merge_long([self.inner[b] for b in words[i][:-1]] + [self.last[words[i][-1]]]), np.int32).tobytes()
                break
            stop = start
            while stop < len(order) and stop - start < 1 << 14 and len(words[order[stop]]) <= size + 2:
                stop += 1
            self._in_step([words[i] for i in order[start:stop]], np.array(order[start:stop]), out)
            start = stop
        return out

    def _in_step(self, words: list[bytes], where: np.ndarray, out: list) -> None:
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], self._inner[raw], -1)
        rows = np.arange(len(words))
        ids[rows, sizes - 1] = self._last[raw[rows, sizes - 1]]
        none = len(self._pairs)
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            best = rank[np.arange(len(ids)), at] if rank.shape[1] else np.full(len(ids), none)
            done = best == none
            if done.any():
                left = ids[done].astype(np.int32)
                raw, wide = left.tobytes(), 4 * left.shape[1]
                for k, (i, n) in enumerate(zip(where[done].tolist(), (left >= 0).sum(axis=1).tolist(), strict=True)):
                    out[i] = raw[k * wide : k * wide + 4 * n]
                go = ~done
                ids, rank, at, best, where = ids[go], rank[go], at[go], best[go], where[go]
            if not len(ids):
                return
            rows = np.arange(len(ids))
            ids[rows, at] = self._made[best]
            wide = ids.shape[1]
            cols = np.arange(wide - 1) + (np.arange(wide - 1) > at[:, None])
            ids = np.take_along_axis(ids, cols, axis=1)
            cols = np.arange(wide - 2) + (np.arange(wide - 2) >= at[:, None])
            rank = np.take_along_axis(rank, cols, axis=1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < wide - 2)
            rank[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
            rank[right, at[right]] = self._ranks(ids[right, at[right]], ids[right, at[right] + 1])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """Keeps all pairs in a heap."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.merges[p], i, *p) for i, p in enumerate(pairwise(ids)) if p in self.merges]
        heapq.heapify(heap := [(rank, i, new, a, b) for rank, new, i, a, b in heap])
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, found[1], ids[x], ids[y]))
        return [x for x in ids if x >= 0]


def compile_lexicon(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The minimal acyclic transducer of words with ids (both as bytes, ids of 32 bits), as a block of 32-bit integers."""
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def frozen(final: bool, arcs: list[tuple[int, int]]) -> int:
        """The registered state with these arcs; suffixes that are equal become one."""
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # of the last word: final, finished arcs
    last = b""
    for word, _ in entries:
        shared = len(os.path.commonprefix([last, word]))
        for k in range(len(last), shared, -1):
            done = frozen(*path.pop())
            path[-1][1].append((last[k - 1], done))
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        done = frozen(*path.pop())
        path[-1][1].append((last[k - 1], done))
    root = frozen(*path.pop())
    below = []  # words that end at or below a state; children are registered before their parents
    finals, keys, targets, numbers = [], [], [], []
    for state, (final, arcs) in enumerate(states):
        n = int(final)
        for label, target in arcs:
            keys.append(state << 8 | label)
            targets.append(target)
            numbers.append(n)
            n += below[target]
        below.append(n)
        finals.append(int(final))
    places = np.cumsum([0, *(len(ids) // 4 for _, ids in entries)]).tolist()
    body = [root, len(finals), len(keys), len(entries), *finals, *keys, *targets, *numbers, *places]
    return np.array(body, "<i4").tobytes() + b"".join(ids for _, ids in entries)


class Lexicon:
    """Lookups in a compiled lexicon, from bytes or a mapped file. Arcs are in order of state and label."""

    def __init__(self, block):
        v = np.frombuffer(block, "<i4")
        self.root, n_states, n_arcs, self.size = v[:4].tolist()
        ends = 4 + np.cumsum([n_states, n_arcs, n_arcs, n_arcs, self.size + 1])
        self.finals, self.keys, self.targets, self.numbers, self.places, self.ids = np.split(v[4:], ends - 4)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get_many(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word, or None; all words walk the automaton in step."""
        out: list[bytes | None] = [None] * len(words)
        if not self.size or not words:
            return out
        data, size = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        state, number, at = np.full(len(words), self.root), np.zeros(len(words), np.int64), 0
        alive, ended = np.arange(len(words)), []
        while len(alive):
            more = size[alive] > at
            ended.append(alive[~more])
            alive = alive[more]
            key = state[alive] << 8 | data[begin[alive] + at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            alive, arc = alive[hit], arc[hit]
            number[alive] += self.numbers[arc]
            state[alive] = self.targets[arc]
            at += 1
        done = np.concatenate(ended)
        done = done[self.finals[state[done]] == 1]
        first, stop = self.places[number[done]].tolist(), self.places[number[done] + 1].tolist()
        for i, a, b in zip(done.tolist(), first, stop, strict=True):
            out[i] = self.ids[a:b].tobytes()
        return out


_workers: dict[str, Worker] = {}
_tables: dict[int, Bpe] = {}


def _bpe(config: str) -> Bpe:
    """The merges of a configuration, read once by each Python worker."""
    key = hash(config)
    if key not in _tables:
        _tables.clear()
        _tables[key] = Bpe(config)
    return _tables[key]


class Worker:
    """Encoder of one Python worker: mapped lexicon, exact merges, and the words met so far."""

    def __init__(self, config: str, lexicon: Lexicon):
        self.bpe, self.lexicon = _bpe(config), lexicon
        self.coded: dict[str, bytes] = {}
        top = max(self.bpe.pieces) + 1
        self.names = {"ids_text": pa.array([str(i) for i in range(top)]), "decoded": pa.array([self.bpe.pieces.get(i, "") for i in range(top)])}

    @classmethod
    def of(cls, shared) -> Worker:
        config, name = shared.value
        if name not in _workers:
            _workers.clear()
            _workers[name] = cls(config, Lexicon.mapped(SparkFiles.get(name)))
        return _workers[name]

    def learn(self, wanted: set[str]) -> None:
        """See to it that the ids of all these pieces are remembered."""
        new = wanted.difference(self.coded)
        if len(new) + len(self.coded) > REMEMBERED:
            self.coded, new = {}, wanted
        find, coded = self.bpe.find, self.coded
        cut = {c: w for c in new if not c.isalpha() and (w := find(c)) != [c]}
        words = list(new.difference(cut).union(*cut.values()).difference(coded)) if cut else list(new)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found = self.lexicon.get_many(raw)
        unseen = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unseen, self.bpe.merge_many([raw[i] for i in unseen]), strict=True):
            found[i] = ids
        coded.update(zip(words, found, strict=True))
        for c, own in cut.items():
            coded[c] = b"".join([coded[w] for w in own])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin."""
        parts = [[(special, part if special else self.bpe.chunks(part)) for special, part in self.bpe.segments(t)] for t in texts]
        self.learn(set().union(*[chunks for p in parts for special, chunks in p if not special]))
        get, special_id = self.coded.__getitem__, self.bpe.special
        raw = [b"".join([x for special, part in p for x in ([np.int32(special_id[part]).tobytes()] if special else map(get, part))]) for p in parts]
        return np.frombuffer(b"".join(raw), np.int32), np.cumsum([0, *(len(r) // 4 for r in raw)])

    def joined(self, kind: str, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """For each text, the decimal ids or the pieces that they stand for, between spaces."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), self.names[kind].take(pa.array(ids))), " ")


def word_counts(docs: DataFrame, config: str) -> DataFrame:
    """(word, n) over all texts, summed within tasks before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(config)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = _bpe(shared.value), Counter()

        def out() -> pa.RecordBatch:
            words = Counter()
            for chunk, n in seen.items():
                for w in bpe.find(chunk):
                    words[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in it:
            for text in batch.column(0):  # one text at a time is a string
                for special, part in bpe.segments(text.as_py() or ""):
                    if not special:
                        seen.update(bpe.chunks(part))
                if len(seen) > REMEMBERED:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(tidy(counted), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, staging: Staging, most: int) -> list[str]:
    """At most so many words: all that are counted as often as a limit, the lowest of 16 an octave that admits no more.

    Words that occur once are never among them. The limit comes from sums by count, so no task or driver sorts all words.
    """
    counts = staging.write(counts.where("n > 1"), "counts")
    level = F.floor(F.log2("n") * 16 + 1e-9).cast("int")
    by_level = {r.level: r.words for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()}  # 1,024 rows at most
    least, room = None, most
    for at in sorted(by_level, reverse=True):
        room -= by_level[at]
        if room < 0:
            break
        least = at
    return [] if least is None else [r.word for r in counts.where(level >= least).select("word").collect()]


class Tokenizer:
    """Encoding and decoding of a DataFrame's texts with a lexicon of the corpus's frequent words."""

    def __init__(self, docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS):
        sc = docs.sparkSession.sparkContext
        with open(path or default_path(), encoding="utf-8") as f:
            config = f.read()
        bpe, staging, name = Bpe(config), Staging(docs.sparkSession, "bpe"), f"lexicon-{uuid.uuid4().hex}.bin"
        raw = [w.encode("utf-8", "surrogatepass") for w in frequent_words(word_counts(docs, config), staging, words)]
        sc.addFile(staging.write_bytes(compile_lexicon(zip(raw, bpe.merge_many(raw), strict=True)), name))
        self.shared = sc.broadcast((config, name))

    def encode(self, docs: DataFrame, outputs: tuple[str, ...] = ("n_tokens", "token_ids")) -> DataFrame:
        """Docs' columns and, as asked for, n_tokens, token_ids, ids_text (decimal ids between spaces) and decoded."""
        kinds = {"n_tokens": "bigint", "token_ids": "array<int>", "ids_text": "string", "decoded": "string"}
        docs, shared = docs.drop(*outputs), self.shared

        def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker = Worker.of(shared)
            make = {
                "n_tokens": lambda ids, starts: pa.array(np.diff(starts), pa.int64()),
                "token_ids": lambda ids, starts: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)),
                "ids_text": lambda ids, starts: worker.joined("ids_text", ids, starts),
                "decoded": lambda ids, starts: worker.joined("decoded", ids, starts),
            }
            for batch in it:
                column = batch.column(batch.schema.get_field_index("text"))
                size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
                start = 0
                while start < len(column):
                    before = size[start - 1] if start else 0
                    stop = max(start + 1, int(np.searchsorted(size, before + BATCH_CHARS, side="right")))
                    got = worker.encode([t or "" for t in column.slice(start, stop - start).to_pylist()])
                    part = batch.slice(start, stop - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, *[make[k](*got) for k in outputs]], names=[*part.schema.names, *outputs])
                    start = stop
            worker.coded = {}  # the worker lives on, perhaps for tasks of other operators

        return docs.mapInArrow(tidy(encoded), schema_of(docs, ", ".join(f"{k} {kinds[k]}" for k in outputs)))

    def decode(self, encoded: DataFrame, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
        """Docs' columns and the text that an array of ids stands for (null: empty)."""
        shared = self.shared

        def decoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker = Worker.of(shared)
            for batch in it:
                column = batch.column(batch.schema.get_field_index(ids))
                starts = np.cumsum([0, *pc.fill_null(column.value_lengths(), 0).to_pylist()])
                got = worker.joined("decoded", column.flatten().to_numpy(zero_copy_only=False), starts)
                yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, out])

        encoded = encoded.drop(out)
        return encoded.mapInArrow(tidy(decoded), schema_of(encoded, f"{out} string"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = Tokenizer(docs).encode(docs, ("n_tokens", "ids_text", "decoded"))
    return done.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the ids of every text."""
    return Tokenizer(docs).encode(docs.select("doc_id", "lang", "source", "text"), ("n_tokens", "token_ids")).drop("text")
