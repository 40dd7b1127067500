"""Near-duplicate components against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import neardup
from tests.compare import assert_same
from tests.conftest import DATA


def shingles(text):
    words = "".join(c.lower() if c < "\x80" else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """component by id: the least id reachable over links of 0.8 and more."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in sets}


def noisy(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=30)
    rows = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(20, 120))
        rows += [noisy(rng, base, rng.randint(0, 3)) for _ in range(rng.randint(1, 12))]
        rows += [" ".join(base)] * rng.randint(0, 4)
    chain = rng.choices(vocabulary, k=80)
    for _ in range(12):  # each is near the one before, the ends are not near each other
        rows.append(" ".join(chain))
        chain[rng.randrange(80)] = f"c{rng.randrange(10**6)}"
    rows += [" ".join([*rng.choices(vocabulary, k=rng.randint(5, 60)), *passage]) for _ in range(40)]
    rows += ["a b c d", "A  b\tc d", "a b c", "", "   ", None, "a a a a a a a", "a a a a a", "x"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 3 if seed == 1 else 24)  # hubs and open pairs are used as well
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    wanted = brute(rows)
    assert got == {i: (len(shingles(t)), wanted[i]) for i, t in rows}


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 5)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    rows = list(enumerate([noisy(rng, base, rng.randint(1, 5)) for _ in range(150)]))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_repeats_null_ids_and_empty_tables(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect())
    assert got == [(-1, 2, None), (3, 2, 3), (3, 2, 3), (5, 2, 3), (7, 0, 7)]
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_a_null_id_first_hides_no_group(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, base), (2, base), (None, base + " more"), (1, base + " more"), (7, base + " and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {None: None, 2: 1, 1: 1, 7: 1}


def test_stage_keeps_one_document_of_each_group(spark):
    rows = [(4, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (2, "a b c d e f", "y", 2), (9, "other words are in this one", "z", 3), (None, "a b c d e f", "n", 4), (11, "", "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, component_id int")
    got = neardup.keep_first(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["11", "2", "9", "None"]


def test_query_equals_its_sql(spark, duck):
    assert_same(neardup.op10_near_duplicates(spark, DATA).toPandas(), duck.execute(neardup.ORACLE).fetchdf())


def test_words_made_to_collide_are_told_apart(spark):
    """Thue-Morse words collide under every polynomial hash modulo a power of two; long words use places beyond the table."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, a + "x"), (4, a), (5, "q" * 500), (6, "q" * 501), (7, ("u" * 64 + "v" * 64) * 3), (8, ("v" * 64 + "u" * 64) * 3)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8}


def test_rows_of_one_id_with_different_texts_are_documents_of_their_own(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, one), (2, two), (3, one + " x"), (3, two + " y"), (4, "a text of its own here"), (3, "and another one that is unlike"), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).where("doc_id is not null").collect())
    assert got == [(1, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 4)]
    stay = sorted((r.doc_id or -1, r.text) for r in neardup.keep_first(spark, docs.toDF("doc_id", "text"), "").collect())
    assert stay == [(-1, one), (1, one), (2, two), (3, "and another one that is unlike"), (4, "a text of its own here")]
    assert neardup.keep_first(spark, docs.where("false"), "").count() == 0


def test_salted_join_equals_a_join(spark):
    from plumbline.llm.common import frequent_of, salted_join

    left = spark.createDataFrame([(1, k) for k in range(3000)] + [(k, -k) for k in range(2, 2500)] + [(None, 0)], "key long, v long")
    right = spark.createDataFrame([(k, k * 2) for k in range(1, 2400)], "key long, w long")
    hot = frequent_of(left, "key")
    assert hot == [1] and frequent_of(right, "key") == []
    named = [t.withColumn("key", F.concat(F.lit("é'"), F.col("key").cast("string"))) for t in (left, right)]
    assert frequent_of(named[0], "key") == ["é'1"] and salted_join(*named, "key", ["é'1"]).count() == 5398
    for how in ("inner", "left"):
        assert sorted(map(str, salted_join(left, right, "key", hot, how).collect())) == sorted(map(str, left.join(right, "key", how).collect()))
