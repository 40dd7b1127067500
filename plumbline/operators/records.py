"""Nested teacher records: assembly from flat observations, projections for learners and reviewers, and checks that fail closed.

A record is a row of one model and instance with a clean struct and a map of probes. Everything here works within a row, so
records of any number are assembled by one aggregate and checked without a shuffle; only uniqueness and joins need one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import shard_of
from plumbline.functions.scores import finite
from plumbline.operators.joins import large_join
from plumbline.operators.labels import CORE_PROBES, LABELS, PROBES
from plumbline.operators.quality import Rule
from plumbline.operators.states import BUDGET, RANDOM_TAGS, action_mask, bound, fixed_tags, legal_probes, states_of

KEYS = ["model_id", "instance_id"]
# fixed values
OBSERVED = (
    "probe_id", "raw_answer", "norm_answer", "flip", "conf_shift", "entropy_shift", "margin_shift", "exact_match", "semantic_match", "applicable", "severity", "latency_ms",
    "prompt_hash", "image_transform_hash", "generation_config_hash", "valid", "invalid_reason", "parse_status", "score_method",
)
CLEAN_FEATURES = ("answer_prob", "token_entropy_mean", "token_margin_mean", "answer_len_tokens")
PROBE_FEATURES = ("flip", "conf_shift", "entropy_shift", "margin_shift", "exact_match", "semantic_match", "applicable")
FORBIDDEN = frozenset((
    "dataset", "dataset_id", "model", "model_id", "model_revision", "instance_id", "group_id", "split", "gold_answer", "correct", "clean_correct",
    "teacher_bits", "teacher_signature", "teacher_label6", "raw_answer", "norm_answer", "image_path", "prompt_text",
))
RECORD_TYPE, STATE_TYPE, PHASE = "teacher_cache", "partial_state_v1", "pre_policy_week4"
DEFERRED = ("policy_rollout", "oracle_next_action")
VIZWIZ_CONTRACT = ("gold_answer", "answer_contract_version", "answer_match_mode", "reference_answers", "vizwiz_gold_policy", "vizwiz_answer_counts", "vizwiz_tied_top_answer_count")
HALLUSION_CONTRACT = ("answer_type", "answer_contract_version", "answer_match_mode", "gold_answer", "benchmark_gold_answer", "gt_answer_details", "reference_answers")
# end of fixed values
_SHIFTS = ("conf_shift", "entropy_shift", "margin_shift", "exact_match", "semantic_match")


def observation(columns: list[str]) -> Column:
    """The struct of an observation: its serialised fields in order, null where a table lacks one. Raw scores aren't among them."""
    return F.struct(*[(F.col(c) if c in columns else F.lit(None)).alias(c) for c in OBSERVED])


def teacher_rows(clean: DataFrame, observations: DataFrame, labels: DataFrame | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """One record for each clean row: the clean struct, the map of its probes, and signature, bits and label (defaults without any)."""
    probes = observations.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("probe", observation(observations.columns).alias("o"))))).alias("probes"))
    own = [c for c in clean.columns if c not in (*KEYS, *carried)]
    rows = large_join(clean.select(*KEYS, *carried, F.struct(*own).alias("clean")), probes, KEYS, "left")
    rows = rows.withColumn("record_type", F.lit(RECORD_TYPE))
    if labels is None:
        rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in (("sig_v", "double"), ("sig_l", "double"), ("sig_a", "double"), ("bit_v", "boolean"), ("bit_l", "boolean"), ("bit_a", "boolean"), ("label6", "string"))})
    else:
        rows = large_join(rows, labels.select(*KEYS, "sig_v", "sig_l", "sig_a", "bit_v", "bit_l", "bit_a", "label6"), KEYS, "left")
    signature = F.struct(*[F.coalesce(f"sig_{x.lower()}", F.lit(0.0)).alias(x) for x in "VLA"])
    bits = F.struct(*[F.coalesce(F.col(f"bit_{n[0]}").cast("int"), F.lit(0)).alias(n) for n in ("visual", "language", "alignment")])
    out = rows.withColumns({"teacher_signature": signature, "teacher_bits": bits, "teacher_label6": F.coalesce("label6", F.lit("unclear"))})
    return out.drop("sig_v", "sig_l", "sig_a", "bit_v", "bit_l", "bit_a", "label6")


def failure_rows(records: DataFrame, error_type: Column, message: Column, attempts: Column) -> DataFrame:
    """Ledger rows of failed records; each embeds the record that was refused."""
    whole = F.struct(*records.columns)
    return records.select(*KEYS, F.lit("teacher_failure").alias("record_type"), error_type.alias("error_type"), message.alias("error"), attempts.cast("int").alias("attempts"), whole.alias("invalid_teacher_record"))


# what learners and reviewers may see


def feature_map(clean: Column, relation: Column | None = None, answerability: Column | None = None) -> Column:
    """map<name, double> of the clean features, with the relation flag on request and answerability where there is any."""
    entries = [F.struct(F.lit(n).alias("k"), clean[n].cast("double").alias("v")) for n in CLEAN_FEATURES]
    if relation is not None:
        entries.append(F.struct(F.lit("relation_available").alias("k"), F.coalesce(relation, F.lit(False)).cast("int").cast("double").alias("v")))
    if answerability is not None:
        entries.append(F.struct(F.lit("answerability").alias("k"), answerability.cast("double").alias("v")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull() | e["k"].isin(*CLEAN_FEATURES)))


def _required(ok: Column, message: Column, value: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(message))


def learner_clean(clean: Column) -> Column:
    """Four finite features of a valid clean pass; anything else is an error."""
    return F.struct(*[_required(clean["valid"] & finite(clean[n].cast("double")), F.lit(f"clean.{n} must be finite and of a valid pass"), clean[n].cast("double")).alias(n) for n in CLEAN_FEATURES])


def learner_probe(name: Column, payload: Column) -> Column:
    """The eight fields of an acquired probe, flags as 0 or 1; an invalid probe or a number that isn't finite is an error."""
    fields = [name.alias("probe_id")]
    for f in PROBE_FEATURES:
        flag = f in ("flip", "applicable")
        ok = payload["valid"] & (payload[f].isNotNull() if flag else finite(payload[f].cast("double")))
        fields.append(_required(ok, F.concat(F.lit("the learner may not see "), F.coalesce(name, F.lit("")), F.lit(f".{f}")), payload[f].cast("int" if flag else "double")).alias(f))
    return F.struct(*fields)


def probe_table(probes: Column) -> Column:
    """Compact JSON of a record's probes by name: probe, answer, applicable, valid."""
    names = F.array_sort(F.map_keys(probes))
    return F.to_json(F.transform(names, lambda n: F.struct(n.alias("probe"), probes[n]["norm_answer"].alias("answer"), probes[n]["applicable"].alias("applicable"), probes[n]["valid"].alias("valid"))))


def state_rows(records: DataFrame, seed: int = 42, count: int = 16) -> DataFrame:
    """One row for each partial state of each record: id, metadata, what the learner may see, targets and sampling.

    Observations are taken from the record's own map in the subset's order, so states need no join and no shuffle. What a learner
    may see of the clean pass and of each legal probe is made once for the record; its states pick from it.
    """
    legal, probes = F.col("relation_applicable"), F.col("probes")
    payloads = F.transform(legal_probes(legal), lambda p: F.struct(p.alias("name"), probes[p].alias("payload")))
    seen = F.map_from_entries(F.transform(payloads, lambda e: F.struct(e["name"].alias("name"), learner_probe(e["name"], e["payload"]).alias("seen"))))
    each = records.withColumns({"_clean": learner_clean(F.col("clean")), "_seen": seen}).withColumn("s", F.explode(states_of(seed, count)))
    subset = F.when(F.col("s.key") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("s.key", r"\|"))
    each = each.withColumn("subset", subset)
    return each.select(
        F.lit(STATE_TYPE).alias("record_type"),
        F.concat(F.lit("state:"), F.substring(F.sha2(F.concat_ws("|", "model_id", "instance_id", F.col("s.key"), F.lit(str(seed))), 256), 1, 24)).alias("state_id"),
        F.struct("instance_id", "group_id", "dataset", "split", "model_id", "model_revision").alias("metadata"),
        F.struct(
            F.col("_clean").alias("clean_features"), F.col("subset").alias("acquired_probe_names"),
            F.transform("subset", lambda p: F.col("_seen")[p]).alias("acquired_observations"),
            (BUDGET - F.size("subset")).alias("remaining_budget"), action_mask(F.col("subset"), legal).alias("action_mask"),
        ).alias("learner_input"),
        F.struct(F.col("clean.correct").alias("clean_correct"), "teacher_signature", "teacher_bits", "teacher_label6").alias("targets"),
        F.struct(F.lit(seed).alias("seed"), F.col("s.tags").alias("sources"), F.lit(PHASE).alias("phase"), F.array(*map(F.lit, DEFERRED)).alias("deferred_sources")).alias("sampling"),
    )


# checks


def probe_rules(prefix: str = "") -> list[Rule]:
    """What every record's probes must meet: exactly the legal ones, with answers, flags and finite numbers, all valid and applicable."""
    probes, legal = F.col("probes"), legal_probes(F.col("relation_applicable"))
    values = F.map_values(probes)

    def every(ok) -> Column:
        return F.forall(values, lambda v: F.coalesce(ok(v), F.lit(False)))

    return [
        (f"{prefix}the probes are not the legal ones", F.array_sort(F.map_keys(probes)) == F.array_sort(legal)),
        (f"{prefix}an answer is missing", every(lambda v: v["raw_answer"].isNotNull() & (F.length(v["norm_answer"]) > 0))),
        (f"{prefix}a flag is missing", every(lambda v: v["flip"].isNotNull() & v["applicable"].isNotNull() & v["valid"].isNotNull())),
        *[(f"{prefix}{n} is not finite", every(lambda v, n=n: finite(v[n].cast("double")))) for n in _SHIFTS],
        (f"{prefix}a legal probe is invalid or inapplicable", every(lambda v: v["valid"] & v["applicable"])),
    ]


def record_rules(splits: tuple[str, ...] = ("train", "val", "cal", "test")) -> list[Rule]:
    """What a whole record must meet by itself."""
    clean, bits, signature = F.col("clean"), F.col("teacher_bits"), F.col("teacher_signature")
    return [
        ("the key is incomplete", (F.length("model_id") > 0) & (F.length("instance_id") > 0)),
        ("the record type is wrong", F.col("record_type") == RECORD_TYPE),
        ("the split is not allowed", F.col("split").isin(*splits)),
        ("the model's revision is not pinned", F.col("model_revision").rlike("^[0-9a-fA-F]{40}$")),
        ("the clean pass is invalid", clean["valid"]),
        ("a clean feature is not finite", _all([finite(clean[n].cast("double")) for n in CLEAN_FEATURES])),
        ("answer_prob is out of range", clean["answer_prob"].between(0, 1)),
        ("clean.correct is not 0 or 1", clean["correct"].isin(0, 1)),
        *probe_rules(),
        ("a bit is not 0 or 1", _all([bits[n].isin(0, 1) for n in ("visual", "language", "alignment")])),
        ("a signature is out of range", signature["V"].between(0, 1) & signature["A"].between(0, 1) & finite(signature["L"])),
        ("the label is unknown", F.col("teacher_label6").isin(*LABELS)),
    ]


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def resume_rules(model: str, manifest_sha: str, config_sha: str, shard: int, shards: int) -> list[Rule]:
    """What rows of an existing shard must meet before anything is appended to it; scope and repeats are seen by ``resume_errors``."""
    return [
        ("the record type is wrong", F.col("record_type") == RECORD_TYPE),
        ("the model is another one", F.col("model_id") == model),
        ("the manifest has changed", F.col("source_manifest_sha256") == manifest_sha),
        ("the probe settings have changed", F.col("frozen_probe_config_sha256") == config_sha),
        ("the shard's numbers have changed", (F.col("shard_id") == shard) & (F.col("num_shards") == shards)),
        ("the row is in the wrong shard", shard_of(F.col("instance_id"), F.col("model_id"), shards) == shard),
        ("an invalid row can't be resumed", F.col("valid")),
        *probe_rules(),
    ]


def errors_of(rows: DataFrame, rules: list[Rule], keys: list[str] = KEYS) -> DataFrame:
    """(rule, keys) of every rule that a row breaks."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for m, ok in rules]))
    return rows.select(*keys, F.explode(found).alias("rule")).select("rule", *keys)


def _counted_errors(rows: DataFrame, counts: list[tuple[str, Column]], keys: list[str] = KEYS) -> DataFrame:
    """(rule, keys, n) of every rule that something of a row breaks, with how often."""
    found = F.filter(F.array(*[F.struct(F.lit(m).alias("rule"), n.cast("long").alias("n")) for m, n in counts]), lambda e: e["n"] > 0)
    return rows.select(*keys, F.explode(found).alias("e")).select("e.rule", *keys, "e.n")


def _repeats(rows: DataFrame, message: str, keys: list[str] = KEYS) -> DataFrame:
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.select(F.lit(message).alias("rule"), *keys)


def resume_errors(rows: DataFrame, selected: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, model_id, instance_id) of everything that forbids going on with a shard."""
    outside = large_join(rows, selected.select("instance_id").distinct(), ["instance_id"], "left_anti").select(F.lit("the row is outside of the selection").alias("rule"), *KEYS)
    return errors_of(rows, rules).unionByName(_repeats(rows, "the key is there twice")).unionByName(outside)


def contract_errors(records: DataFrame, manifest: DataFrame, normalise) -> DataFrame:
    """(rule, model_id, instance_id) where a record's answer fields differ from its manifest row's, or its stored correctness is stale.

    normalise makes a normalised answer of a raw one and a dataset. Null equals null. Fields that a table lacks are null.
    """
    fields = list(dict.fromkeys((*VIZWIZ_CONTRACT, *HALLUSION_CONTRACT)))
    own = [(F.col(c) if c in records.columns else F.lit(None)).alias(f"t_{c}") for c in fields]
    its = [(F.col(c) if c in manifest.columns else F.lit(None)).alias(f"m_{c}") for c in fields]
    both = records.select(*KEYS, F.col("clean.raw_answer").alias("raw"), F.col("clean.correct").alias("correct"), *own)
    both = large_join(both, manifest.select("instance_id", "dataset", *its), ["instance_id"])
    vizwiz, hallusion = F.col("dataset") == "vizwiz", F.col("dataset") == "hallusionbench"
    checked = vizwiz | (hallusion & (F.col("m_answer_type") == "binary"))
    rules: list[Rule] = [(f"{c} differs from the manifest", F.col(f"t_{c}").eqNullSafe(F.col(f"m_{c}")) | ~((vizwiz & F.lit(c in VIZWIZ_CONTRACT)) | (hallusion & F.lit(c in HALLUSION_CONTRACT)))) for c in fields]
    right = (normalise(F.coalesce("raw", F.lit("")), F.col("dataset")) == F.col("m_gold_answer")).cast("int")
    rules.append(("the stored correctness is stale", ~F.coalesce(checked, F.lit(False)) | F.col("correct").eqNullSafe(F.coalesce(right, F.lit(0)))))
    return errors_of(both, rules)


def artifact_errors(manifest: DataFrame, records: DataFrame, labels: DataFrame, states: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """(rule, model_id, instance_id, n) of everything that is wrong between a manifest, its records, labels and states; n is how often.

    Keys are null where a rule is about a whole table. States, by far the most rows, are read once and are added up by record
    before they are shuffled, so they needn't be stored; the other tables are read once for their own rules and once for each join.
    """
    keys, none = ["model_id", "instance_id"], F.lit(None).cast("string")
    leaks = manifest.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    found = [
        manifest.groupBy("instance_id").count().where("count > 1 or instance_id is null").select(F.lit("a manifest id is missing or there twice").alias("rule"), none.alias("model_id"), "instance_id"),
        leaks.select(F.lit("a group leaks across splits").alias("rule"), none.alias("model_id"), F.col("group_id").alias("instance_id")),
        errors_of(records, record_rules()), _repeats(records, "a record is there twice"), _repeats(labels, "a label is there twice"),
    ]
    source = manifest.select("instance_id", *[F.col(c).alias(f"m_{c}") for c in ("group_id", "dataset", "split")], F.lit(True).alias("_there"))
    both = large_join(records.select(*keys, "group_id", "dataset", "split"), source, ["instance_id"], "left")
    there = F.coalesce("_there", F.lit(False))
    found.append(errors_of(both, [("the record's instance is not in the manifest", there), *[(f"{c} differs from the manifest", ~there | F.col(c).eqNullSafe(F.col(f"m_{c}"))) for c in ("group_id", "dataset", "split")]]))
    l = labels.select(*keys, F.col("label6").alias("l_label"), F.lit(True).alias("_label"))  # noqa: E741
    both = large_join(records.select(*keys, "teacher_label6", F.lit(True).alias("_record")), l, keys, "full_outer")
    has_record, has_label = F.coalesce("_record", F.lit(False)), F.coalesce("_label", F.lit(False))
    found.append(errors_of(both, [("a record has no label", has_label), ("a label has no record", has_record), ("the label is stale", ~(has_record & has_label) | F.col("l_label").eqNullSafe(F.col("teacher_label6")))]))
    expected = manifest.select("instance_id").distinct()
    wanted = expected.select(F.explode(F.array(*map(F.lit, models))).alias("model_id"), "instance_id")
    found.append(large_join(wanted, records.select(*keys), keys, "left_anti").select(F.lit("a record is lacking").alias("rule"), *keys))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumn("n", F.lit(1).cast("long")).unionByName(_state_errors(records, states))


def _state_errors(records: DataFrame, states: DataFrame) -> DataFrame:
    """(rule, model_id, instance_id, n) of states alone, and of states held against their records."""
    keys = ["model_id", "instance_id"]
    own = records.select(*keys, "relation_applicable", *[F.col(c).alias(f"t_{c}") for c in _TOLD], F.lit(True).alias("_there"))
    own = own.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) == 1)  # shuffled as for the join
    held = large_join(own, _states_by_record(states), keys, "full_outer")
    once = F.coalesce("_first", F.lit(True))  # what states break alone isn't counted for each record of their key
    there, relation, n = F.coalesce("_there", F.lit(False)), F.coalesce("relation_applicable", F.lit(False)), F.col("n_states")

    def differing(c: str) -> Column:
        return F.aggregate("told", F.lit(0).cast("long"), lambda a, m: a + F.when(m[c].eqNullSafe(F.col(f"t_{c}")), 0).otherwise(m["n"]))

    def lacking(tags: tuple[str, ...]) -> Column:
        due = sum(1 << _BIT[t] for t in tags)
        return F.col("tags").bitwiseAND(due) != due

    drawn = F.bit_count(F.col("tags").bitwiseAND(sum(1 << _BIT[t] for t in RANDOM_TAGS))) + F.size(F.array_distinct(F.filter(F.flatten("odd_tags"), lambda t: t.startswith("random:"))))
    states_there = n.isNotNull()
    return _counted_errors(held, [
        ("a state has no id", F.when(once, F.col("no_id"))), ("a state's observations are not those of its names", F.when(once, F.col("other_names"))), ("a state's budget is wrong", F.when(once, F.col("other_budget"))),
        ("a state's phase is wrong", F.when(once, F.col("other_phase"))), ("a state is there twice", F.when(once, F.col("n_twice"))), ("a state has no record", F.when(~there, n)),
        *[(f"a state's {c} differs", F.when(there, differing(c))) for c in _TOLD if c != "teacher_label6"], ("a state's target is stale", F.when(there, differing("teacher_label6"))),
        ("a state holds an illegal probe", F.when(there, F.when(relation, F.col("illegal_any")).otherwise(F.col("illegal_core")))), ("a state's mask is wrong", F.when(there, F.when(relation, F.col("mask_any")).otherwise(F.col("mask_core")))),
        ("a record has no states", (there & ~states_there).cast("int")), ("a record's states lack a tag", (there & states_there & F.when(relation, lacking(fixed_tags(PROBES))).otherwise(lacking(fixed_tags(CORE_PROBES)))).cast("int")),
        ("a record hasn't 16 random draws", (there & states_there & (drawn != 16)).cast("int")),
    ])


_TOLD = ("group_id", "dataset", "split", "model_revision", "teacher_label6")  # what a state says of its record
_BIT = {t: i for i, t in enumerate(dict.fromkeys((*fixed_tags(PROBES), *fixed_tags(CORE_PROBES), *RANDOM_TAGS)))}
_ODD = 1 << 62  # a tag that no state should have


def _state_facts(states: DataFrame) -> DataFrame:
    """For each state its record, what it tells of it with a hash, its id, the rules that it breaks as 0 or 1, and its tags as bits of one number."""
    learner, sampling = F.col("learner_input"), F.col("sampling")
    rows = states.select(
        F.col("metadata.model_id").alias("model_id"), F.col("metadata.instance_id").alias("instance_id"), *[F.col(f"metadata.{c}").alias(c) for c in _TOLD if c != "teacher_label6"], F.col("targets.teacher_label6").alias("teacher_label6"), "state_id",
        learner["acquired_probe_names"].alias("names"), learner["acquired_observations"]["probe_id"].alias("observed"), learner["remaining_budget"].alias("budget"), learner["action_mask"].alias("mask"),
        sampling["phase"].alias("phase"), sampling["deferred_sources"].alias("deferred"), sampling["sources"].alias("sources"),
    )
    names, mask, size = F.col("names"), F.col("mask"), F.size("names")
    actions = (*PROBES, "stop")
    held = [F.when(F.array_contains(names, p), 1 << i).otherwise(0) for i, p in enumerate(PROBES)]
    open_ = [F.when(mask[a] == 1, 1 << i).when(mask[a] == 0, 0) for i, a in enumerate(actions)]  # null for anything else
    bit = F.create_map(*[F.lit(x) for t, i in _BIT.items() for x in (t, 1 << i)])
    tags = F.aggregate("sources", F.lit(0).cast("long"), lambda a, t: a.bitwiseOR(F.coalesce(bit[t].cast("long"), F.lit(_ODD))))
    rows = rows.withColumns({"held": _sum(held), "open": F.when(F.size(mask) == len(actions), _sum(open_)), "tags": tags, "usual": F.coalesce(F.col("state_id").rlike("^state:[0-9a-f]{24}$"), F.lit(False))})
    all_, relation = (1 << len(actions)) - 1, 1 << PROBES.index("relation")
    known, usual = F.bit_count("held") == size, F.col("usual")  # known: all are probes, and no two are the same

    def broken(ok: Column) -> Column:
        return (~F.coalesce(ok, F.lit(False))).cast("int")

    def legal(probes: tuple[str, ...]) -> Column:
        return F.size(F.array_except(names, F.array(*map(F.lit, probes)))) == 0

    return rows.select(
        *KEYS, F.struct(F.xxhash64(*_TOLD).alias("hash"), *_TOLD).alias("told"),
        F.when(usual, F.conv(F.substring("state_id", 7, 16), 16, -10).cast("long")).alias("id_high"), F.when(usual, (F.conv(F.substring("state_id", 23, 8), 16, 10).cast("long") - (1 << 31)).cast("int")).alias("id_low"),
        F.when(~usual, F.coalesce(F.concat(F.lit("="), "state_id"), F.lit(""))).alias("odd_id"), broken(F.length("state_id") > 0).alias("no_id"),
        broken((F.col("observed") == names) & (known | (F.size(F.array_distinct(names)) == size))).alias("other_names"), broken(F.col("budget") == BUDGET - size).alias("other_budget"),
        broken((F.col("phase") == PHASE) & (F.sort_array("deferred") == F.array(*map(F.lit, sorted(DEFERRED))))).alias("other_phase"),
        broken(known | legal(PROBES)).alias("illegal_any"), broken(F.when(known, F.col("held") < relation).otherwise(legal(CORE_PROBES))).alias("illegal_core"),
        broken(F.col("open") == all_ - F.col("held")).alias("mask_any"), broken(F.col("open") == (all_ - F.col("held")).bitwiseAND(all_ - relation)).alias("mask_core"),
        "tags", F.when(F.col("tags").bitwiseAND(_ODD) != 0, F.filter("sources", lambda t: ~F.map_contains_key(bit, t))).alias("odd_tags"),
    )


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for c in parts[1:]:
        out = out + c
    return out


def _states_by_record(states: DataFrame) -> DataFrame:
    """One row for each record that states name: how many break each rule, their tags as bits, and what they say of it, told array<struct<..., n>>.

    A state leaves its task as twelve bytes of its id and a hash of what it tells; the rest is added up before. Some thirty are of one record.
    """
    keys = ["model_id", "instance_id"]
    sums = ("no_id", "other_names", "other_budget", "other_phase", "illegal_any", "illegal_core", "mask_any", "mask_core")
    by = _state_facts(states).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_states"), *[F.sum(c).alias(c) for c in sums], F.coalesce(F.bit_or("tags"), F.lit(0)).alias("tags"), F.collect_list("odd_tags").alias("odd_tags"),
        F.collect_set("told").alias("told"), F.collect_list("told.hash").alias("hashes"), *[F.collect_list(c).alias(f"{c}s") for c in ("id_high", "id_low", "odd_id")],
    )
    said, alike = F.array_distinct("told"), F.size(F.array_distinct("hashes"))
    hashed = F.when(F.size(said) == alike, said).otherwise(F.raise_error(F.lit("two of what a record's states tell have one hash")))
    counted = F.transform(hashed, lambda m: m.withField("n", F.when(alike == 1, F.col("n_states")).otherwise(F.size(F.filter("hashes", lambda h: h == m["hash"])).cast("long"))))
    whole = F.concat(F.transform(F.arrays_zip("id_highs", "id_lows"), lambda x: F.concat_ws(":", x["id_highs"].cast("string"), x["id_lows"].cast("string"))), "odd_ids")
    once = (F.size(F.array_distinct("id_highs")) == F.size("id_highs")) & (F.size("odd_ids") == 0)
    return by.select(*keys, "n_states", *sums, "tags", "odd_tags", counted.alias("told"), F.when(once, 0).otherwise(_n_twice(whole)).alias("n_twice"))


def _n_twice(values: Column) -> Column:
    """How many values an array holds more than once."""

    def second(s: Column):
        def is_second(x: Column, i: Column) -> Column:
            return (F.get(s, i - 1) == x) & ~F.coalesce(F.get(s, i - 2) == x, F.lit(False))

        return is_second

    return bound(F.sort_array(values), lambda s: F.size(F.filter(s, second(s))))


def totals(rows: DataFrame, rules: list[Rule], keys: list[str], listed: tuple[str, ...]) -> DataFrame:
    """One row: all, valid, invalid, unique and duplicate rows, and the sorted distinct values of the listed columns."""
    ok = F.lit(True)
    for _, rule in rules:
        ok = ok & F.coalesce(rule, F.lit(False))
    n, unique = F.count(F.lit(1)), F.count_distinct(F.struct(*keys))
    names = [F.array_sort(F.collect_set(c)).alias(c) for c in listed]  # of closed sets, such as datasets and splits
    return rows.agg(n.alias("n"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"), unique.alias("n_unique"), (n - unique).alias("n_duplicate"), *names)


def state_sources(states: DataFrame, records: DataFrame, labels: DataFrame) -> DataFrame:
    """States with their record and their label; a state that lacks either is an error."""
    keys = ["model_id", "instance_id"]
    rows = large_join(large_join(states, records.withColumn("_record", F.lit(True)), keys, "left"), labels.withColumn("_label", F.lit(True)), keys, "left")
    ok = F.col("_record").isNotNull() & F.col("_label").isNotNull()
    return rows.where(F.assert_true(ok, F.lit("a state has no record or no label")).isNull()).drop("_record", "_label")
