"""Artifacts held against each other: every rule on states against a plain version, and what the query leaves on disk."""

import os
from collections import Counter

from pyspark.sql import functions as F

from plumbline.operators import records
from plumbline.operators.labels import CORE_PROBES, PROBES
from plumbline.operators.states import BUDGET, fixed_tags
from plumbline.plans import nested, synth
from tests.conftest import DATA

TOLD = ("group_id", "dataset", "split", "model_revision")


def spoiled(rows: list[dict]) -> list[dict]:
    """States of ten records with faults of every kind; the n-th record has the n-th kinds."""
    keys = sorted({(r["metadata"]["model_id"], r["metadata"]["instance_id"]) for r in rows})
    out = []
    for n, key in enumerate(keys):
        own = [r for r in rows if (r["metadata"]["model_id"], r["metadata"]["instance_id"]) == key]
        own.sort(key=lambda r: r["state_id"])
        learner = [r["learner_input"] for r in own]
        if n == 0:  # ids: one three times, one twice, one odd id twice, no id twice, an empty one, digits in capitals
            for to, of in ((1, 0), (2, 0), (4, 3)):
                own[to]["state_id"] = own[of]["state_id"]
            for i, x in enumerate(("odd", "odd", None, None, "", "STATE:1", own[3]["state_id"].upper())):
                own[5 + i]["state_id"] = x
        if n == 1:  # what is told differs in some states, and is null in others
            for i, (f, x) in enumerate((("split", "x"), ("split", None), ("group_id", "x"), ("dataset", "y"), ("model_revision", "z"), ("model_revision", "z"))):
                own[i]["metadata"][f] = x
            own[3]["targets"]["teacher_label6"], own[9]["targets"]["teacher_label6"] = "stale", None
        if n == 2:  # names: twice, unknown, illegal without a relation, null; observations of others
            two = next(x for x in learner if len(x["acquired_probe_names"]) == 2)
            two["acquired_probe_names"] = [two["acquired_probe_names"][0]] * 2
            for x, name in zip([x for x in learner if len(x["acquired_probe_names"]) == 1], ("relation", "guess", None), strict=False):
                x["acquired_probe_names"] = [name]
            next(x for x in learner if len(x["acquired_probe_names"]) == 4)["acquired_observations"].pop()
        if n == 3:  # masks: lacking, one too many, turned, null, of two
            for i, change in enumerate(({"blur": None}, {"more": 1}, {"stop": 0}, {"crop": 2}, {"relation": 1})):
                learner[i]["action_mask"] = {**learner[i]["action_mask"], **change}
            learner[6]["action_mask"].pop("noise")
            learner[7]["action_mask"] = None
        if n == 4:  # budgets and phases
            learner[0]["remaining_budget"], learner[1]["remaining_budget"] = 9, None
            own[2]["sampling"]["phase"], own[3]["sampling"]["phase"] = "other", None
            own[4]["sampling"]["deferred_sources"], own[5]["sampling"]["deferred_sources"] = ["policy_rollout"], ["oracle_next_action", "policy_rollout"]
        if n == 5:  # tags: a draw more, one by another name, unknown ones, null, none
            own[0]["sampling"]["sources"] = [*own[0]["sampling"]["sources"], "random:77:size9", "random:77:size9", "hand", None]
            own[1]["sampling"]["sources"] = [*own[1]["sampling"]["sources"], "random:77:size9", "random:78:size9"]
        if n == 6:
            own = [r for r in own if "empty" not in r["sampling"]["sources"]]
        if n == 7:
            next(r for r in own if any(t.startswith("random:") and len(r["sampling"]["sources"]) == 1 for t in r["sampling"]["sources"]))["sampling"]["sources"] = None
        if n == 8:
            own = []
        if n == 9:  # half of them of a record that isn't there, one of no record
            for r in own[::2]:
                r["metadata"]["instance_id"] = "nowhere"
            own[1]["metadata"]["model_id"] = None
        out += own
    return out


def plain(own: list, states: list[dict]) -> Counter:
    """How often each rule on states is broken, by record."""
    found, of = Counter(), {}
    for s in states:
        of.setdefault((s["metadata"]["model_id"], s["metadata"]["instance_id"]), []).append(s)
    for key, some in of.items():
        ids = Counter(s["state_id"] for s in some)
        found["a state is there twice", *key] = sum(n > 1 for n in ids.values())
        its = [r for r in own if (r.model_id, r.instance_id) == key]
        for s in some:
            x, sampling = s["learner_input"], s["sampling"]
            names = x["acquired_probe_names"]
            found["a state has no id", *key] += not s["state_id"]
            found["a state's observations are not those of its names", *key] += [o["probe_id"] for o in x["acquired_observations"]] != names or None in names or len(set(names)) < len(names)
            found["a state's budget is wrong", *key] += x["remaining_budget"] != BUDGET - len(names)
            found["a state's phase is wrong", *key] += sampling["phase"] != records.PHASE or sorted(sampling["deferred_sources"]) != sorted(records.DEFERRED)
            found["a state has no record", *key] += not its
            for r in its:
                legal = PROBES if r.relation_applicable else CORE_PROBES
                for f in TOLD:
                    found[f"a state's {f} differs", *key] += s["metadata"][f] != r[f]
                found["a state's target is stale", *key] += s["targets"]["teacher_label6"] != r.teacher_label6
                found["a state holds an illegal probe", *key] += not set(names) <= set(legal)
                found["a state's mask is wrong", *key] += x["action_mask"] != {**{p: int(p in legal and p not in names) for p in PROBES}, "stop": 1}
    for r in own:
        key = (r.model_id, r.instance_id)
        if key not in of:
            found["a record has no states", *key] += 1
            continue
        tags = {t for s in of[key] for t in s["sampling"]["sources"] or () if t}
        found["a record's states lack a tag", *key] += not set(fixed_tags(PROBES if r.relation_applicable else CORE_PROBES)) <= tags
        found["a record hasn't 16 random draws", *key] += sum(t.startswith("random:") for t in tags) != 16
    return +found


def faulty_artifacts(spark):
    """Ten records, two of which have probes of a relation and one of which is there twice, with their spoiled states."""
    rows = nested.nested(spark, DATA)
    some = rows.where("relation_applicable").orderBy(*nested.KEYS).limit(2).unionByName(rows.where("not relation_applicable").orderBy(*nested.KEYS).limit(8))
    some = spark.createDataFrame(some.collect(), rows.schema)
    made = records.state_rows(some)
    states = spoiled([r.asDict(recursive=True) for r in made.collect()])
    own = some.unionByName(some.orderBy(*nested.KEYS).limit(2))
    return own, states, spark.createDataFrame(states, _nullable(made.schema))


def _nullable(kind):
    from pyspark.sql import types as t

    if isinstance(kind, t.StructType):
        return t.StructType([t.StructField(f.name, _nullable(f.dataType)) for f in kind])
    if isinstance(kind, t.ArrayType):
        return t.ArrayType(_nullable(kind.elementType))
    if isinstance(kind, t.MapType):
        return t.MapType(kind.keyType, _nullable(kind.valueType))
    return kind


def test_every_rule_on_states_against_a_plain_version(spark):
    own, states, table = faulty_artifacts(spark)
    expected = plain(own.collect(), states)
    manifest = synth.manifest(spark, DATA)
    found = records.artifact_errors(manifest, own, own.select(*records.KEYS, F.col("teacher_label6").alias("label6")), table.repartition(3), synth.MODELS)
    assert found.columns == ["rule", *records.KEYS, "n"]
    sums = found.groupBy("rule", *records.KEYS).agg(F.sum("n").alias("n")).where("rule like '%state%' or rule like '%draws%'").collect()
    got = Counter({(r.rule, r.model_id, r.instance_id): r.n for r in sums})
    assert got == expected and len({k[0] for k in expected}) == 16


def test_states_are_not_left_on_disk(spark):
    """They are some thirty to a record, and are larger than all else together."""
    folder = spark._jvm.java.net.URI(spark.sparkContext.getCheckpointDir()).getPath() if spark.sparkContext.getCheckpointDir() else None
    before = _bytes(folder) if folder else 0
    data = DATA.replace("sf0.001", "sf0.01")
    assert nested.artifact_errors(spark, data).count() > 0
    folder = spark._jvm.java.net.URI(spark.sparkContext.getCheckpointDir()).getPath()
    n = 2 * spark.read.parquet(f"{data}/customer.parquet").count()
    assert (_bytes(folder) - before) / n < 1500


def _bytes(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)
