"""Operators on small tables with known answers."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import audits, coverage, digests, labels, ledger, quality, sampling, states

CARRIED = ["relation_applicable", "clean_correct", "answer_prob", "swap_invariance"]


def observed(spark, probes, relation=False, correct=True, prob=0.8, invariance=None):
    rows = [("i", "m", p, f, s, sem, ok, True, relation, correct, prob, invariance) for p, f, s, sem, ok in probes]
    return spark.createDataFrame(rows, "instance_id string, model_id string, probe string, flip boolean, conf_shift double, semantic_match int, valid boolean, applicable boolean, relation_applicable boolean, clean_correct boolean, answer_prob double, swap_invariance boolean")


def label(spark, *args, **kwargs):
    return labels.label_rows(observed(spark, *args, **kwargs), ["instance_id", "model_id"], CARRIED).first()


def visual(flips, shifts):
    return [(p, f, s, 1, True) for p, f, s in zip(labels.VISUAL_PROBES, flips, shifts, strict=True)]


def test_visual_bit_at_its_thresholds(spark):
    assert not label(spark, [("blank", False, -0.5, 0, True)]).bit_v
    assert not label(spark, visual([False] * 4, [0.05] * 4)).bit_v
    assert label(spark, visual([True, False, False, False], [0.0] * 4)).bit_v
    assert label(spark, visual([False] * 4, [0.2, -0.2, 0.1, 0.1])).bit_v


def test_language_and_alignment_bits(spark):
    assert label(spark, [("blank", False, -0.05, 1, True)]).bit_l
    assert not label(spark, [("blank", False, -0.5, 1, True)]).bit_l
    assert not label(spark, [("blank", False, -0.05, 0, True)]).bit_l
    assert label(spark, [("grounding", True, 0.0, 1, True)]).bit_a
    assert not label(spark, [("grounding", True, 0.9, 1, False)]).bit_a
    assert label(spark, [("grounding", False, 0.0, 1, True)], relation=True, invariance=True).bit_a
    assert not label(spark, [("grounding", False, 0.0, 1, True)], relation=True, invariance=None).bit_a


def test_six_way(spark):
    quiet = [("grounding", False, 0.0, 1, True)]
    assert label(spark, quiet).label6 == "no-failure" and label(spark, quiet, correct=False).label6 == "unclear"
    assert label(spark, [("grounding", True, 0.0, 1, True)]).label6 == "alignment"
    assert label(spark, [("grounding", True, 0.0, 1, True), ("blank", False, 0.0, 1, True)]).label6 == "mixed"


def test_signature(spark):
    r = label(spark, [*visual([False] * 4, [0.1, -0.3, 0.1, 0.1]), ("blank", False, 0.0, 1, True), ("grounding", True, 0.2, 1, True)], relation=True, invariance=True)
    assert (round(r.sig_v, 12), round(r.sig_l, 6), r.sig_a) == (0.15, 1.0, 1.0)


def test_thresholds_want_every_name():
    with pytest.raises(ValueError, match="missing"):
        labels.Thresholds.of({"eps": 1e-8})
    assert labels.Thresholds.of(labels.Thresholds().__dict__) == labels.Thresholds()
    assert labels.Thresholds.of({k: v for k, v in labels.Thresholds().__dict__.items() if k != "eps"}) == labels.Thresholds()
    with pytest.raises(ValueError, match="unknown"):
        labels.Thresholds.of(labels.Thresholds().__dict__ | {"other": 1.0})


def test_states_have_all_their_tags(spark):
    rows = spark.createDataFrame([("m", f"i{k}", k % 2 == 0) for k in range(20)], "model_id string, instance_id string, relation_applicable boolean")
    tags = states.subset_tags(rows).collect()
    by = {}
    for r in tags:
        by.setdefault(r.instance_id, []).append(r)
    for key, own in by.items():
        seven = int(key[1:]) % 2 == 0
        assert len(own) == (52 if seven else 47)
        assert sorted(r.tag for r in own if r.tag.startswith("random:")) == sorted(f"random:{d:02d}:size{1 + d % 4}" for d in range(16))
        assert all(len(r.subset) == int(r.tag[-1]) and r.subset == sorted(r.subset) for r in own if r.tag.startswith("random:"))
        assert len({tuple(r.subset) for r in own if not r.tag.startswith("random:")}) == (23 if seven else 16)
    assert sorted(map(str, tags)) == sorted(map(str, states.subset_tags(rows).collect()))


def test_majority_takes_the_earliest_of_equals(spark):
    rows = spark.createDataFrame([("a", "cat", 0), ("a", "cat", 1), ("a", "dog", 2), ("b", "loading", 0), ("b", "none", 1)], "g string, v string, at int")
    assert {r.g: (r.winner, r.n, r.tied) for r in audits.majority(rows, "g", "v", "at").collect()} == {"a": ("cat", 2, 1), "b": ("loading", 1, 2)}


def test_calibration_and_gap(spark):
    pairs = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True), (0.5, False)], "similarity double, match boolean")
    best = audits.calibrate(pairs, 0.9).first()
    assert (best.tau, best.tp, best.fp, best.fn) == (0.52, 3, 1, 0)
    fires = spark.range(1).select(audits.gap_fires(F.lit(75.0), F.lit(73.5)), audits.gap_fires(F.lit(75.0), F.lit(70.0))).first()
    assert tuple(fires) == (True, False)


def test_severity_choice_falls_back(spark):
    stats = spark.createDataFrame([("blur", 4.0, 0.2, 0.0, 0.0), ("blur", 8.0, 0.3, 0.0, 0.0), ("crop", 0.5, 0.9, 0.0, 0.0), ("noise", 9.0, 0.2, 0.5, 0.0)], "probe string, severity double, flip_rate double, saturation double, invalid_rate double")
    fallback = spark.createDataFrame([("blur", 1.0), ("crop", 1.0), ("noise", 1.0)], "probe string, severity double")
    assert {r.probe: (r.severity, r.by_default) for r in audits.choose_severity(stats, fallback).collect()} == {"blur": (4.0, False), "crop": (0.5, False), "noise": (1.0, True)}


def test_even_samples(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    assert sorted(r.x for r in sampling.even_sample(rows, ["x"], 5).collect()) == [0.0, 2.0, 5.0, 8.0, 10.0]
    assert [r.x for r in sampling.even_sample(rows, ["x"], 1).collect()] == [5.0]
    assert sampling.even_sample(rows, ["x"], 20).count() == 11


def test_stratified_sample_is_exact_and_even(spark):
    rows = spark.createDataFrame([(f"id_{i}", "train" if i % 3 else "val", f"c{i % 7}") for i in range(137)], "instance_id string, split string, category string")
    got = sampling.stratified(rows, ["split", "category"], 100, 42, "instance_id").toPandas()
    assert len(got) == 100 and got.instance_id.is_unique
    sizes = got.groupby(["split", "category"]).size()
    assert sizes.min() >= 6 and len(sizes) == 14
    assert sampling.stratified(rows, ["split"], 500, 42, "instance_id").count() == 137
    with pytest.raises(ValueError, match="positive"):
        sampling.hash_limit(rows, 0, 42, "instance_id")


def test_rules_fail_closed(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("c", None)], "k string, n int")
    rules = [("k is missing", F.col("k").isNotNull()), ("n is small", F.col("n") > 0)]
    assert {r.k: r.errors for r in quality.with_errors(rows, rules).collect()} == {"a": [], None: ["k is missing"], "c": ["n is small"]}
    assert {r.rule: r.violations for r in quality.rule_counts(rows, rules).collect()} == {"k is missing": 1, "n is small": 1}
    with pytest.raises(Exception, match="n is small"):  # one row breaks a rule, so one message is possible
        quality.require(rows.where("k is not null"), rules).collect()
    with pytest.raises(Exception, match="k is missing"):
        quality.require(rows.where("n is not null"), rules).collect()
    assert quality.require(rows.where("n = 1"), rules).count() == 1
    assert quality.expect_count(rows, F.col("n") > 1, 1).first().n == 1
    with pytest.raises(Exception, match="expected 3"):
        quality.expect_count(rows, F.col("n") > 1, 3).collect()


def test_forbidden_fields_are_found_in_the_schema():
    schema = T.StructType.fromDDL("a struct<gold:string,b:array<struct<gold:int,c:int>>>, m map<string,struct<gold:int>>, x int")
    assert quality.forbidden_fields(schema, {"gold"}) == ["a.gold", "a.b.gold", "m.gold"]


def test_drift_and_coverage(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x")], "k int, c string, d string")
    new = spark.createDataFrame([(1, "z", "x"), (3, None, "y"), (4, "d", "x")], "k int, c string, d string")
    got = {r.k: (r.kind, r.changed, r.allowed) for r in coverage.drift(old, new, "k", ["c", "d"], F.array(F.lit("c"))).collect()}
    assert got == {1: ("changed", ["c"], True), 2: ("removed", None, False), 3: ("changed", ["d"], False), 4: ("added", None, False)}
    assert tuple(coverage.coverage(old, new, ["k"]).first()) == (2, 1, 1)


def test_ledger_counts_attempts_and_forgets_successes(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 4)], "k string, error string, attempts int")
    fail = spark.createDataFrame([("a", "y"), ("c", "z")], "k string, error string")
    ok = spark.createDataFrame([("b",)], "k string")
    got = {r.k: (r.error, r.attempts) for r in ledger.upsert_failures(old, fail, ok, ["k"]).collect()}
    assert got == {"a": ("y", 2), "c": ("z", 1)}


def test_migration_inside_maps(spark):
    rows = spark.createDataFrame([(1, {"p": ("Yes", "x", True, 0, True), "q": ("No", "x", True, 0, False)})], "k int, probes map<string,struct<raw:string,norm:string,flip:boolean,exact:int,valid:boolean>>")
    from plumbline.functions.text import yes_no

    got = rows.select(ledger.renormalise(F.col("probes"), F.lit("yes"), yes_no).alias("p")).first().p
    assert (got["p"].norm, got["p"].flip, got["p"].exact) == ("yes", False, 1) and got["q"].norm == "x"
    new = rows.select(ledger.replace_entry(F.transform_values("probes", lambda k, v: v["norm"]), "p", F.lit("new")).alias("p")).first().p
    assert new == {"p": "new", "q": "x"}


def test_recovered_rows_are_disjoint(spark):
    valid = spark.createDataFrame([("a", 1)], "k string, v int")
    failed = spark.createDataFrame([("e", ("b", 2)), ("e", None)], "error string, row struct<k:string,v:int>")
    assert {(r.k, r.source_kind) for r in ledger.recovered(valid, failed, ["k"], "row").collect()} == {("a", "valid"), ("b", "ledger")}
    both = spark.createDataFrame([("e", ("a", 2))], "error string, row struct<k:string,v:int>")
    with pytest.raises(Exception, match="both valid and failed"):
        ledger.recovered(valid, both, ["k"], "row").collect()


def test_digests_depend_on_order_and_nulls(spark):
    rows = spark.createDataFrame([(k, "x" if k % 3 else None) for k in range(50)], "k int, t string")

    def digest(df, order=("k",)):
        return tuple(digests.table_digest(df, list(order), ["k", "t"], 7).first())

    assert digest(rows) == digest(rows.repartition(5)) and digest(rows)[0] == 50
    assert digest(rows) != digest(rows.withColumn("o", -F.col("k")), ("o",))
    assert digest(rows) != digest(rows.fillna("")) and digest(rows.where("false"))[0] == 0


def test_unique_keys_are_required(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    assert quality.require_unique(rows, ["k"]).count() == 2
    for extra, message in (((2, "c"), "there twice"), ((None, "c"), "is null")):
        with pytest.raises(Exception, match=message):
            quality.require_unique(rows.unionByName(spark.createDataFrame([extra], rows.schema)), ["k"]).collect()


def test_frozen_config(spark):
    stats = spark.createDataFrame([("blur", 4.0, 9, 0.2, 0.0, 0.0)], "probe string, severity double, n_valid long, flip_rate double, saturation double, invalid_rate double")
    fallback = spark.createDataFrame([("blur", 1.0), ("crop", 1.0)], "probe string, severity double")
    got = audits.frozen_config(audits.choose_severity(stats, fallback), stats, {"tau": 0.5})
    assert got["severities"]["blur"] == {"severity": 4.0, "by_default": False, "n_valid": 9, "flip_rate": 0.2, "saturation": 0.0, "invalid_rate": 0.0}
    assert got["severities"]["crop"]["by_default"] and got["thresholds"] == {"tau": 0.5}


def test_missing_grid_joins_no_cells(spark):
    """Estimates of exploded rows are far too small, so a join would send them to the driver for a broadcast."""
    grid = [("p", float(i)) for i in range(100)]
    rows = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "b"), ("m", "c"), (None, "a")], "model_id string, instance_id string")
    seen = [("m", "a", *c) for c in grid] + [("m", "b", *c) for c in grid if c[1] not in (3.0, 77.0, 99.0)] + [("m", "b", "q", 3.0), ("m", "b", "p", 0.0), ("m", "z", "p", 0.0), (None, "a", "p", 0.0)]
    got = coverage.missing_grid(rows, spark.createDataFrame(seen, "model_id string, instance_id string, probe string, severity double"), ["model_id", "instance_id"], grid, ("probe", "severity"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("m", "b", 3), ("m", "c", 100), (None, "a", 100)], key=str)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_draws_of_states_are_looked_up_in_one_map(spark):
    """A map of the draws for each of the fixed subsets is some fifty maps a row."""
    rows = spark.createDataFrame([("i", "m", False)], "instance_id string, model_id string, relation_applicable boolean").withColumn("s", states.states_of())
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("map_from_entries") == 2 and "format_string" not in plan  # with and without relation
    drawn = [t for s in rows.first().s for t in s.tags if t.startswith("random:")]
    assert sorted(drawn) == [f"random:{d:02d}:size{d % 4 + 1}" for d in range(16)]
