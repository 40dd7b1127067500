"""The encoder against the tokenizers library, whole texts and odd ones."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from plumbline.llm import bpe
from tests.conftest import DATA

ODD = [
    None, "", " ", "a\x1cb c\x1f", "ΣΑΣ ΟΔΟΣ", "x" * 500 + " y's don't I'LL <|endoftext|>foo <|startoftext|>", "é é", "İstanbul ǅ ẞ", "１２ ½ ²", "a b　c᠎e​f", "tab\tnl\n\x85", "foo, bar. baz.,  q_, r. s.\nend.",
    "%, ., _. a", "<|endoftext|>", "x", "a , b", "1234 99", "'s 's's", "\U0001f600 ok\U0001f600", "word " * 3000, "é" * 3000,
]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(bpe.default_path())
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_query_equals_the_library(spark, library):
    got = {r.doc_id: r for r in bpe.op2_bpe(spark, DATA).collect()}
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_odd_texts_repeats_and_clashing_columns(spark, library):
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(ODD)] + [(0, "x", "again")], "doc_id long, text string, n_tokens string")
    tok = bpe.Tokenizer(docs, words=5)
    rows = tok.decode(tok.encode(docs)).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    empty = docs.where("false")
    assert bpe.Tokenizer(empty).encode(empty).count() == 0


def test_automaton_is_minimal_and_exact():
    rng = random.Random(3)
    words = {bytes(rng.choices(b"abc", k=rng.randint(1, 7))): np.array([rng.randint(0, 99) for _ in range(rng.randint(0, 3))], np.int32).tobytes() for _ in range(400)}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words.items()))
    assert lexicon.size == len(words)
    others = [*words, *(bytes(rng.choices(b"abcd", k=rng.randint(0, 8))) for _ in range(500)), b"a" * 5000]
    assert lexicon.get_many(others) == [words.get(w) for w in others]
    one = np.int32(1).tobytes()
    shared = bpe.Lexicon(bpe.compile_lexicon([(a + b"xyz", one) for a in (b"p", b"q", b"r")]))
    assert len(shared.finals) == 5  # the three words share all states behind their first bytes
    assert bpe.Lexicon(bpe.compile_lexicon([])).get_many([b"a", b""]) == [None, None]


def test_frequent_words_are_bounded_and_fully_counted(spark):
    docs = spark.createDataFrame([(" ".join(w for k, w in enumerate(("aa", "bb", "cc", "dd")) for _ in range(40 - 10 * k)) + " once",)], "text string")
    with open(bpe.default_path(), encoding="utf-8") as f:
        counts = bpe.word_counts(docs, f.read())
    assert {r.word: r.n for r in counts.collect()} == {"aa": 40, "bb": 30, "cc": 20, "dd": 10, "once": 1}
    staging = bpe.Staging(spark, "test")
    assert [sorted(bpe.frequent_words(counts, bpe.Staging(spark, "test"), k)) for k in (0, 2, 9)] == [[], ["aa", "bb"], ["aa", "bb", "cc", "dd"]]
    assert bpe.frequent_words(counts.where("false"), staging, 5) == []


def test_long_and_short_words_merge_alike():
    with open(bpe.default_path(), encoding="utf-8") as f:
        own = bpe.Bpe(f.read())
    rng = random.Random(5)
    for _ in range(200):
        w = "".join(rng.choices("thean", k=rng.randint(1, bpe.SHORT)))
        raw = w.encode()
        assert own.merge(w) == own._merge_long([own.inner[b] for b in raw[:-1]] + [own.last[raw[-1]]])
