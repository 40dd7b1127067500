"""Migration of shards: what changes, what is said of it, and what forbids it."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.hashing import stable_json_sha256
from plumbline.operators import migration
from plumbline.plans import migrations
from plumbline.sources.staging import checkpointed
from tests.conftest import DATA


@pytest.fixture(scope="module")
def shard(spark):
    return tuple(checkpointed(x) for x in migrations.shard(spark, DATA))


def move(parts, **options):
    return migration.migrate_shard(*parts, migrations.SOURCE, tx.normalise, **options)


def errors(parts, **options):
    return {r.error for r in move(parts, **options).errors.collect()}


def test_a_sound_shard_moves_with_its_provenance(spark, shard):
    done = move(shard).checked()
    assert done.errors.count() == 0
    row = done.valid.where("dataset = 'vizwiz'").first()
    about = row.answer_contract_migration
    assert (about.policy, about.source_path, row.source_manifest_sha256) == (migration.POLICY, "teacher.jsonl", "new")
    old = shard[0].where((F.col("model_id") == row.model_id) & (F.col("instance_id") == row.instance_id))
    plain = json.loads(old.toJSON().first())
    whole = {c: plain.get(c) for c in old.columns}  # nulls are kept, at every depth
    whole["clean"] = {k: plain["clean"].get(k) for k in old.schema["clean"].dataType.names}
    names = old.schema["probes"].dataType.valueType.names
    whole["probes"] = {p: {k: v.get(k) for k in names} for p, v in plain["probes"].items()}
    assert about.source_record_sha256 == hashlib.sha256(json.dumps(whole, sort_keys=True).encode()).hexdigest()
    failed = done.failures.first()
    assert failed.invalid_teacher_record.source_manifest_sha256 == failed.source_manifest_sha256 == "new"
    assert failed.answer_contract_migration.source_record_sha256 != failed.invalid_teacher_record.answer_contract_migration.source_record_sha256
    open_ids = {r.instance_id for r in shard[2].where("answer_type = 'open_ended'").collect()}
    assert open_ids and not open_ids & {r.instance_id for r in done.valid.select("instance_id").collect()}
    assert open_ids <= {r.instance_id for r in done.pending.collect()}


def test_what_forbids_a_migration(spark, shard):
    valid, ledger, manifest, selected = shard
    one = valid.first()
    this = (F.col("model_id") == one.model_id) & (F.col("instance_id") == one.instance_id)
    assert errors((valid.withColumn("source_manifest_sha256", F.when(this, "x").otherwise("old")), ledger, manifest, selected)) == {"the row is of another manifest"}
    assert errors((valid.unionByName(valid.where(this)), ledger, manifest, selected)) == {"the key is there twice"}
    assert errors((valid, ledger, manifest, selected.where(~this))) == {"the key is outside of the selection"}
    assert errors((valid.where(~this), ledger, manifest, selected)) == {"the selection has no such row"}
    bare = ledger.withColumn("invalid_teacher_record", F.when(F.lit(False), F.col("invalid_teacher_record")))
    assert errors((valid, bare, manifest, selected)) == {"a failure embeds no record"}
    drifted = manifest.withColumn("split", F.when(F.col("instance_id") == one.instance_id, "dev").otherwise(F.col("split")))
    assert errors((valid, ledger, drifted, selected)) == {"split has drifted"}
    assert errors((valid, ledger, manifest.where(F.col("instance_id") != one.instance_id), selected)) == {"the manifest has no such row"}
    with pytest.raises(ValueError, match="can't be migrated"):
        move((valid.where(~this), ledger, manifest, selected)).checked()


def test_grounded_answers_must_parse_as_stored(spark, shard):
    valid, ledger, manifest, selected = shard
    n = F.col("ordinal")
    raw = F.when(n % 3 == 0, "FINAL_ANSWER: yes").when(n % 3 == 1, "it depends").otherwise("FINAL_ANSWER: no")
    probes = F.transform_values("probes", lambda k, v: F.when(k == "grounding", v.withField("raw_answer", raw).withField("valid", F.lit(True))).otherwise(v))
    rows = checkpointed(valid.where("dataset = 'hallusionbench'").withColumn("probes", probes))
    keys = rows.select("model_id", "instance_id")
    done = move((rows, ledger.where("false"), manifest, keys), grounded=lambda x, d: tx.parse_grounded(x, d, F.lit("binary")))
    found = {(r.error, r.instance_id) for r in done.errors.collect()}
    assert found == {("the grounding no longer parses", r.instance_id) for r in done.valid.where("ordinal % 3 = 1").collect()}
    for r in done.valid.where("ordinal % 3 <> 1").collect():
        assert r.probes["grounding"].norm_answer == ("yes" if r.ordinal % 3 == 0 else "no")
        assert r.probes["grounding"].flip == (r.probes["grounding"].norm_answer != r.clean.norm_answer)


def test_stable_json_is_that_of_python(spark):
    rows = spark.createDataFrame([(2, "é\n", 1e-05, {"b": 1, "a": None}, [1.0, 0.1], None)], "z int, a string, d double, m map<string,int>, l array<double>, n string")
    wanted = {"z": 2, "a": "é\n", "d": 1e-05, "m": {"b": 1, "a": None}, "l": [1.0, 0.1], "n": None}
    assert rows.select(stable_json_sha256(*rows.columns)).first()[0] == hashlib.sha256(json.dumps(wanted, sort_keys=True).encode()).hexdigest()
