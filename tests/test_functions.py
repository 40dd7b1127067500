"""Golden pairs of the scalar functions."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import features, hashing, scores
from plumbline.functions import text as tx


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "f,pairs",
    [
        (tx.yes_no, {"Yes": "yes", "YES": "yes", "Yes.": "yes", "Yeah": "yes", "yep": "yes", "Yes, the object is there.": "yes", "No": "no", "nope": "no", "No, I don't see it.": "no", "maybe": "unknown", "I'm not sure": "unknown", "north": "no", "": "unknown"}),
        (tx.true_false, {"True": "true", "TRUE": "true", "True.": "true", "Correct": "true", "False.": "false", "Incorrect": "false", "uncertain": "unknown", "True,": "unknown"}),
        (tx.freeform, {"  A Cat  ": "cat", "it's a dog!": "it s dog", "the red car": "red car", "red    car": "red car", "unanswerable": "unanswerable", "I don't know": "unanswerable", "no answer": "unanswerable", "the": "unanswerable", "\tA  Café\n": "café"}),
        (tx.numeric_binary, {"1": "yes", "0": "no", "2": "uncertain", "Niger": "unknown", "cannot determine": "uncertain"}),
        (tx.answer_type, {"which country has": "open_ended", "According to the table, which x": "open_ended", "According to the image which is about Euler's Number, does it": "binary", "Is it?": "binary"}),
        (tx.strip_markup, {'**"x"**': "x", "`a`": "a", "**": "", "plain": "plain", "__a": "__a"}),
    ],
)
def test_normalisers(spark, f, pairs):
    assert column(spark, list(pairs), f) == list(pairs.values())


def test_dispatch_by_dataset_and_unknown_names(spark):
    rows = spark.createDataFrame([("1", "HallusionBench", None), ("A red car", "vizwiz", None), ("A red car", "pope", "freeform")], "x string, d string, k string")
    assert [r[0] for r in rows.select(tx.normalise(F.col("x"), F.col("d"), F.col("k"))).collect()] == ["yes", "red car", "red car"]
    with pytest.raises(Exception, match="no normaliser"):
        spark.createDataFrame([("x", "nowhere")], "x string, d string").select(tx.normalise(F.col("x"), F.col("d"))).collect()


GROUNDED = [
    ("A dog.\nFINAL_ANSWER: yes", "pope", (True, "yes", "ok")),
    ("A dog.\nFINAL_ANSWER: zebra", "pope", (False, "unknown", "malformed")),
    ("I look.\nYes", "pope", (True, "yes", "regex_fallback")),
    ("", "pope", (False, "", "empty")),
    (None, "pope", (False, "", "empty")),
    ("I look.\nThe answer is yes.", "pope", (True, "yes", "terminal_answer_fallback")),
    ("Seen.\nThe answer is **aspirin**", "vizwiz", (True, "aspirin", "terminal_answer_fallback")),
    ("a bottle\naspirin", "vizwiz", (False, "", "malformed")),
    ("Seen.\nThe answer is yes or no", "pope", (False, "", "malformed")),
    ("x\nFINAL_ANSWER:", "pope", (False, "", "malformed")),
    ("x\nFINAL_ANSWER: Unknown", "vizwiz", (True, "unanswerable", "ok")),
    ("A logo.\n\nMVG", "vizwiz", (True, "mvg", "terminal_answer_fallback")),
    ("so the answer is no - it cannot", "pope", (True, "no", "terminal_answer_fallback")),
    ("FINAL_ANSWER: 1", "hallusionbench", (True, "yes", "ok")),
]


def test_grounded_answers(spark):
    rows = spark.createDataFrame([(i, t, d) for i, (t, d, _) in enumerate(GROUNDED)], "i int, t string, d string")
    got = rows.orderBy("i").select(tx.parse_grounded(F.col("t"), F.col("d"), F.lit(None).cast("string")).alias("p")).collect()
    assert [(r.p.valid, r.p.norm, r.p.status) for r in got] == [x for *_, x in GROUNDED]
    open_ended = spark.createDataFrame([("FINAL_ANSWER: Niger",)], "t string").select(tx.parse_grounded(F.col("t"), F.lit("hallusionbench"), F.lit("open_ended")).alias("p")).first()
    assert (open_ended.p.valid, open_ended.p.norm) == (True, "niger")


SWAPS = [
    ("What color is this object?", None, "no_reversible_relation_found"),
    ("The cat is above the table and left of the chair", None, "multiple_relations_found"),
    ("The cat is not not above the table", None, "ambiguous_negation"),
    ("The cat is not above the table", None, None),
    ("The cat is above the table", "below", "annotated_relation_mismatch: 'below' vs detected 'above'"),
    ("The cat is above the table", "touching", "annotated_relation_not_reversible: 'touching'"),
    ("The man left the room.", None, "non_spatial_usage_detected"),
    ("Is the answer right?", None, "non_spatial_usage_detected"),
    ("IN FRONT OF the car", None, "round_trip_failed"),
]


def test_relation_swap_reasons_and_round_trips(spark):
    rows = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(SWAPS)], "i int, t string, a string")
    got = rows.orderBy("i").select(tx.swap_relation(F.col("t"), F.col("a"), F.lit(None).cast("string")).alias("s")).collect()
    assert [r.s.reason for r in got] == [x for *_, x in SWAPS]
    for a, b in tx.OPPOSITES.items():
        s = spark.createDataFrame([(f"The cup is {a} it.", f"{a.capitalize()} some cup.")], "t string, u string").select(tx.swap_relation(F.col("t"), F.lit(None).cast("string"), F.lit("true")).alias("s"), tx.swap_relation(F.col("u"), F.lit(None).cast("string"), F.lit("false")).alias("z")).first()
        assert s.s.applicable and s.s.swapped_text == f"The cup is {b} it." and s.s.swapped_gold == "false"
        assert s.z.swapped_text == f"{b.capitalize()} some cup."


def test_swap_outcome(spark):
    rows = spark.createDataFrame([(0, True, "true", "false", "true", "false"), (1, True, "true", "true", "true", "false"), (2, False, "true", "true", "true", "false"), (3, True, "true", "unknown", "true", "false")], "i int, ok boolean, o string, s string, g string, sg string")
    got = rows.orderBy("i").select(tx.swap_status(F.col("ok"), F.col("o"), F.col("s"), F.col("g"), F.col("sg")).alias("r")).withColumn("v", tx.swap_invariance(F.col("r"))).collect()
    assert [(r.r, r.v) for r in got] == [("changed_correctly", False), ("invariant", True), ("invalid", None), ("invalid", None)]


def test_hashes_are_those_of_hashlib(spark):
    rows = [(f"i{k}", f"m{k % 2}", f"g{k}") for k in range(300)]
    got = spark.createDataFrame(rows, "i string, m string, g string").select("i", "m", "g", hashing.shard_of(F.col("i"), F.col("m"), 4).alias("s"), hashing.assign_split(F.col("g")).alias("p"), hashing.group_id(F.col("i"), F.col("m"), F.col("g")).alias("d"), hashing.canonical_json_sha256(F.lit('{"b": 1e-05, "a": [1, 2.5]}')).alias("j")).collect()
    for r in got:
        assert r.s == int(hashlib.sha256(f"{r.m}|{r.i}".encode()).hexdigest()[:16], 16) % 4
        u = int(hashlib.sha256(f"42|{r.g}".encode()).hexdigest()[:8], 16) / 2**32
        assert r.p == ("train" if u < 0.7 else "val" if u < 0.7999999999999999 else "cal" if u < 0.8999999999999999 else "test")
        assert r.d == "sha256:" + hashlib.sha256(f"{r.i}|{r.m}|{r.g}".encode()).hexdigest()[:16]
        assert r.j == hashlib.sha256(b'{"a": [1, 2.5], "b": 1e-05}').hexdigest()
    assert {r.s for r in got} == {0, 1, 2, 3} and {r.p for r in got} == {"train", "val", "cal", "test"}
    with pytest.raises(ValueError, match="positive"):
        hashing.shard_of(F.col("i"), F.col("m"), 0)


def test_token_scores(spark):
    rows = [(0, [-0.1, -0.2, -0.3], [{"a": 0.7, "b": 0.3}, {"a": 1.0}]), (1, [], []), (2, [float("-inf")], [{"a": 0.5, "b": 0.0}])]
    got = spark.createDataFrame(rows, "i int, l array<double>, d array<map<string,double>>").orderBy("i").select(scores.confidence(F.col("l")).alias("c"), scores.entropy(F.col("d")).alias("e"), scores.margin(F.col("d")).alias("m"), scores.last(F.col("l"), F.lit(2)).alias("t")).collect()
    assert got[0].c == pytest.approx(math.exp(-0.2)) and got[1].c is None and got[2].c is None
    assert got[0].e == pytest.approx(-(0.7 * math.log(0.7) + 0.3 * math.log(0.3)) / 2) and got[0].m == pytest.approx((0.4 + 1.0) / 2) and got[2].m == 0.5
    assert got[0].t == [-0.2, -0.3] and got[1].t == []


def test_percentiles_take_the_floor(spark):
    row = spark.createDataFrame([([float(x) for x in range(10)],)], "v array<double>").select(*[scores.percentile(F.col("v"), p).alias(f"p{i}") for i, p in enumerate((0.25, 0.5, 0.95))]).first()
    assert tuple(row) == (2.0, 4.0, 8.0)


def test_relations_end_at_other_than_ascii_letters(spark):
    """As in RE2, an edge lies between an ASCII letter and any other one."""
    rows = [("das ß\u00fcunder der", ["under"]), ("l\u00e9ft left\u00e9 x", ["left"]), ("\u0130n front of it", ["in front of"]), ("aleft left_ left1", []), ("on top of\u0301 it", ["on top of"])]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").orderBy("i").select(tx.relations(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [x for _, x in rows]


def test_swaps_keep_places_in_other_than_ascii_texts(spark):
    rows = [("\u0130\u0130 ist \u00fcunder dem", "\u0130\u0130 ist \u00fcon top of dem", None), ("the cup is left\u00e9 it", "the cup is right\u00e9 it", None), ("left\x0bthe cup", "right\x0bthe cup", None), ("\u00e9left the cup", None, "non_spatial_usage_detected")]
    none = F.lit(None).cast("string")
    got = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "i int, t string").orderBy("i").select(tx.swap_relation(F.col("t"), none, none).alias("s")).collect()
    assert [(r.s.swapped_text, r.s.reason) for r in got] == [(a, b) for _, a, b in rows]


def test_negations_end_at_other_than_ascii_letters(spark):
    rows = [("nicht \u00fcno und nor\u00df", 2), ("not nott _no no1", 1), ("N\u00d6NO \u00e9not", 2)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").orderBy("i").select(tx.negations(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [x for _, x in rows]


def test_lenient_scores_are_computed_once(spark):
    rows = spark.createDataFrame([([-0.1, -0.2], [{"a": 0.7, "b": 0.3}]), ([], []), ([float("inf")], [{"a": 1.0}])], "l array<double>, d array<map<string,double>>")
    done = rows.select(features.lenient(F.col("l"), F.col("d")).alias("f"))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 1
    assert [(r.f.confidence, r.f.margin, r.f.issues) for r in done.collect()] == [(pytest.approx(math.exp(-0.15)), pytest.approx(0.4), []), (0.0, 0.0, []), (float("inf"), 1.0, ["confidence"])]
