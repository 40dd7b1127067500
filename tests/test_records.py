"""Nested records: what learners may see, what is refused, and packets."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import features
from plumbline.functions import text as tx
from plumbline.operators import packets, pairs, provenance, quality, records
from plumbline.plans import nested


def one(spark, **changes):
    rows = nested.nested(spark, "/root/testdata/sf0.001").limit(1)
    for name, value in changes.items():
        rows = rows.withColumn(name, value)
    return rows


def test_learners_see_no_private_field(spark):
    states = records.state_rows(one(spark))
    assert not set(quality.forbidden_fields(states.schema["learner_input"].dataType, set(records.FORBIDDEN)))
    r = states.where(F.size("learner_input.acquired_probe_names") == 2).first()
    seen = r.learner_input.acquired_observations
    assert [o.probe_id for o in seen] == r.learner_input.acquired_probe_names == sorted(r.learner_input.acquired_probe_names)
    assert tuple(seen[0].asDict()) == ("probe_id", *records.PROBE_FEATURES) and {type(seen[0].flip), type(seen[0].applicable)} == {int}
    assert all(r.learner_input.action_mask[o.probe_id] == 0 for o in seen) and r.learner_input.remaining_budget == 5


@pytest.mark.parametrize("change,message", [
    (("clean", lambda: F.col("clean").withField("valid", F.lit(False))), "valid pass"), (("clean", lambda: F.col("clean").withField("token_entropy_mean", F.lit(float("nan")))), "token_entropy_mean"),
    (("probes", lambda: F.transform_values("probes", lambda k, v: v.withField("valid", F.lit(False)))), "may not see"), (("probes", lambda: F.transform_values("probes", lambda k, v: v.withField("conf_shift", F.lit(float("inf"))))), "conf_shift"),
])
def test_states_of_bad_records_are_refused(spark, change, message):
    with pytest.raises(Exception, match=message):
        records.state_rows(one(spark, **{change[0]: change[1]()})).collect()


def test_rules_of_records(spark):
    def broken(**changes):
        return {r.rule for r in records.errors_of(one(spark, **changes), records.record_rules()).collect()}

    assert broken() == set()
    probes = F.col("probes")
    assert broken(probes=F.map_filter(probes, lambda k, v: k != "blur")) == {"the probes are not the legal ones"}
    assert broken(probes=F.transform_values(probes, lambda k, v: v.withField("norm_answer", F.lit("")))) == {"an answer is missing"}
    assert broken(probes=F.transform_values(probes, lambda k, v: v.withField("flip", F.lit(None).cast("boolean")))) == {"a flag is missing"}
    assert broken(probes=F.transform_values(probes, lambda k, v: v.withField("margin_shift", F.lit(float("nan"))))) == {"margin_shift is not finite"}
    assert broken(teacher_bits=F.col("teacher_bits").withField("visual", F.lit(2)), model_id=F.lit("")) == {"a bit is not 0 or 1", "the key is incomplete"}


def test_scores_are_closed_to_failure(spark):
    def run(lp, tops, ok="true"):
        rows = spark.createDataFrame([(lp, tops)], "lp array<double>, tops array<map<string,double>>")
        return rows.select(features.clean_features(F.col("lp"), F.col("tops"), F.expr(ok), F.lit("given")).alias("f")).first().f

    good = run([-0.1, -0.3], [{"a": 0.9, "b": 0.1}, {"a": 1.0}])
    assert good.valid and good.invalid_reason is None and good.answer_len_tokens == 2 and abs(good.answer_prob - 2.718281828459045**-0.2) < 1e-12
    for bad, reason in ((run([], []), features.MISSING), (run(None, None), features.MISSING), (run([-0.1], []), features.MISSING), (run([1.0], [{"a": 1.0}]), features.FAILED), (run([-0.1], [{"a": -1.0}]), features.FAILED), (run([-0.1], [{"a": 1.0}], "false"), "given"), (run([-0.1], [{"a": 1.0}], "null"), "given")):
        assert (bad.valid, bad.answer_prob, bad.answer_len_tokens, bad.answer_logprob, bad.invalid_reason) == (False, 0.0, 0, float("-inf"), reason)


def test_digests_of_transforms_are_those_of_sorted_json(spark):
    for probe, severity, spec in (("blur", 4.0, {"sigma": 4.0}), ("crop", 0.65, {"retain_fraction": 0.65}), ("noise", 25.0, {"sigma": 25.0, "seed": 7}), ("blank", 1.0, {"fill_color": [128, 128, 128]})):
        got = spark.range(1).select(features.transform_digest(F.lit(probe), F.lit(severity), F.lit(7))).first()[0]
        assert got == hashlib.sha256(json.dumps({"transform": probe, **spec}, sort_keys=True).encode()).hexdigest()
    with pytest.raises(Exception, match="notation"):
        spark.range(1).select(features.python_float(F.lit(1e-9))).collect()


def test_explicit_kinds_go_by_both_names(spark):
    got = spark.range(1).select(*[tx.normalise(F.lit("2"), F.lit("pope"), F.lit(k)) for k in ("hallusion_binary", "numeric_binary")]).first()
    assert tuple(got) == ("uncertain", "uncertain")


def test_human_labels_that_do_not_fit_are_errors(spark):
    schema = "audit_id string, human_match string, cosine_similarity string, split string"
    ok = quality.human_labels(spark.createDataFrame([("a", " Yes", "0.5", "train"), ("b", "0", "-1", "val")], schema)).collect()
    assert [(r.match, r.similarity) for r in ok] == [(True, 0.5), (False, -1.0)]
    for row in (("a", "maybe", "0.5", "train"), ("a", "1", "1.5", "train"), ("a", "1", "nan", "train"), ("a", "1", "x", "val"), ("a", "1", "0.5", "test"), ("a", None, "0.5", "val")):
        with pytest.raises(Exception, match="doesn't fit"):
            quality.human_labels(spark.createDataFrame([row], schema)).collect()


def test_pairs_are_scored_once(spark, tmp_path):
    rows = spark.createDataFrame([(k, "ab", "abc") for k in range(50)] + [(50, None, "x"), (51, "nan", "")], "k int, a string, b string")
    log = str(tmp_path / "calls")

    def make():
        def score(a, b):
            with open(log, "a") as f:
                f.write(a + "\n")
            return float("nan") if a == "nan" else len(set(a) & set(b)) / len(set(a) | set(b))

        return score

    got = {r.k: r.similarity for r in pairs.scored(rows, "a", "b", make, log).collect()}
    assert got == {k: 2 / 3 for k in range(50)} | {50: None, 51: None}
    assert sorted(open(log).read().split()) == ["ab", "nan"]


def test_checksums_of_a_packet(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "a.png").write_bytes(b"a")
    (tmp_path / "b.csv").write_bytes(b"b")
    listed = spark.createDataFrame([("images/a.png", hashlib.sha256(b"a").hexdigest()), ("b.csv", "0" * 64), ("c.csv", "0" * 64)], "file string, sha256 string")
    assert {(r.file, r.problem) for r in packets.checksum_problems(spark, str(tmp_path), listed).collect()} == {("b.csv", "changed"), ("c.csv", "missing")}


def test_a_selection_of_nothing_is_an_error(spark):
    with pytest.raises(ValueError, match="no rows: the split"):
        quality.require_rows(spark.range(3).where("false"), "the split")
    assert quality.require_rows(spark.range(3), "x").count() == 3


def test_keys_with_nulls_are_errors(spark):
    rows = spark.createDataFrame([(None, "m", "d", "i", None, None), (None, "m", "d", "i", "blur", 4.0)], "record_type string, model_id string, dataset string, instance_id string, pilot_severity_probe string, pilot_severity_value double")
    assert quality.identity(rows).select("key").distinct().count() == 2
    with pytest.raises(Exception, match="incomplete"):
        quality.identity(rows.withColumn("instance_id", F.lit(None).cast("string"))).collect()


def test_states_of_records_are_joined_without_broadcasts(spark):
    """Estimates of exploded rows are far too small, so a broadcast would send all records to the driver."""
    rows = one(spark).withColumn("teacher_file_sha256", F.lit("t"))
    states = records.state_rows(rows).withColumns({"source_teacher_file_sha256": F.lit("t"), "source_label_file_sha256": F.lit(None).cast("string")})
    found = provenance.state_file_errors(states, rows, rows.select(*records.KEYS).withColumn("label_file_sha256", F.lit("l")))
    assert {r.rule for r in found.select("rule").collect()} == {"the state is of another label file"} and found.count() == states.count()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
