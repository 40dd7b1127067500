"""Queries on nested records, their states and packets, and on the rules between artifacts. Faults are planted by keyed remainders."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import features, hashing
from plumbline.functions import text as tx
from plumbline.operators import ledger, packets, pairs, provenance, quality, records
from plumbline.plans import synth
from plumbline.plans.evidence import _C, _L, _O, _TAGS, KEYS, labelled
from plumbline.plans.registry import query
from plumbline.plans.reports import dev
from plumbline.plans.scalars import _DS, _SYES, _T, _Q, _distributions, _listed, _pick, _questions, texts
from plumbline.sources.staging import checkpointed

REVISION = "0123456789abcdef0123456789abcdef01234567"
CARRIED = ("group_id", "dataset", "split", "relation_applicable", "ordinal", "model_revision", "question", "gold_answer")


def _passes(spark, sf, healthy: bool):
    """Clean rows and observations with answers; in healthy ones every pass is valid."""
    n = F.col("ordinal")
    c = synth.clean(spark, sf).select(*KEYS, *CARRIED[:5], "answer_prob", "clean_correct", "clean_valid")
    c = c.withColumns({
        "model_revision": F.lit(REVISION), "question": F.concat(F.lit("question "), n.cast("string")), "gold_answer": F.when(n % 2 == 0, "yes").otherwise("no"), "token_entropy_mean": F.col("answer_prob") / 2,
        "token_margin_mean": 1 - F.col("answer_prob"), "answer_len_tokens": (n % 7 + 1).cast("int"), "raw_answer": F.when(n % 2 == 0, "Yes.").otherwise("No"), "norm_answer": F.when(n % 2 == 0, "yes").otherwise("no"),
        "correct": F.col("clean_correct").cast("int"), "valid": F.lit(True) if healthy else F.col("clean_valid"),
    }).drop("clean_correct", "clean_valid")
    o = synth.observations(spark, sf)
    o = o.select(*KEYS, "probe", F.col("probe").alias("probe_id"), F.when(F.col("flip"), "No").otherwise("Yes").alias("raw_answer"), F.when(F.col("flip"), "no").otherwise("yes").alias("norm_answer"), "flip", "conf_shift", "entropy_shift", "margin_shift",
        (1 - F.col("flip").cast("int")).cast("double").alias("exact_match"), F.col("semantic_match").cast("double").alias("semantic_match"), (F.lit(True) if healthy else F.col("applicable")).alias("applicable"), (F.lit(True) if healthy else F.col("valid")).alias("valid"))
    return c, o


def nested(spark, sf, healthy: bool = True, labels=None):
    c, o = _passes(spark, sf, healthy)
    return records.teacher_rows(c, o, labelled(spark, sf) if labels is None else labels, CARRIED)


def _faulty(rows):
    at = F.col("ordinal") % 97
    return rows.withColumns({
        "probes": F.when(at == 5, F.map_filter("probes", lambda k, v: k != "noise")).otherwise(F.col("probes")), "record_type": F.when(at == 11, "other").otherwise(F.col("record_type")),
        "model_revision": F.when(at == 17, "main").otherwise(F.col("model_revision")), "clean": F.col("clean").withField("answer_prob", F.when(at == 23, 1.5).otherwise(F.col("clean.answer_prob"))),
        "split": F.when(at == 29, "dev").otherwise(F.col("split")), "teacher_label6": F.when(at == 31, "?").otherwise(F.col("teacher_label6")),
    })


def _ordinal(instance):
    """The number at the end of an instance's id, so that nothing is joined for it."""
    return F.substring_index(instance, "_", -1).cast("long")


def _counted(errors):
    return errors.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _rules(*pairs_: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{rule.replace(chr(39), chr(39) * 2)}' AS rule, ({sql}) AS n" for rule, sql in pairs_)


_SIX = f"{_L}, n AS (SELECT l.*, c.ordinal, c.group_id, c.clean_valid FROM labelled l JOIN clean c ON c.instance_id = l.instance_id AND c.model_id = l.model_id)"


@query("record_errors", f"""{_O}, f AS (SELECT instance_id, model_id, bool_and(valid AND applicable) FILTER (NOT (ordinal % 97 = 5 AND probe = 'noise')) AS fine FROM obs GROUP BY ALL), e AS ({_rules(
    ("the record type is wrong", "SELECT count(*) FROM clean WHERE ordinal % 97 = 11"), ("the split is not allowed", "SELECT count(*) FROM clean WHERE ordinal % 97 = 29"), ("the model's revision is not pinned", "SELECT count(*) FROM clean WHERE ordinal % 97 = 17"),
    ("the clean pass is invalid", "SELECT count(*) FROM clean WHERE NOT clean_valid"), ("answer_prob is out of range", "SELECT count(*) FROM clean WHERE ordinal % 97 = 23"), ("the probes are not the legal ones", "SELECT count(*) FROM clean WHERE ordinal % 97 = 5"),
    ("a legal probe is invalid or inapplicable", "SELECT count(*) FROM f WHERE NOT fine"), ("the label is unknown", "SELECT count(*) FROM clean WHERE ordinal % 97 = 31"))}) SELECT rule, n FROM e WHERE n > 0""")  # fmt: skip
def record_errors(spark, sf):
    rows = _faulty(nested(spark, sf, healthy=False))
    return _counted(records.errors_of(rows, records.record_rules()))


@query("teacher_assembly", f"""{_SIX}, p AS (SELECT instance_id, model_id, count(*) AS n_probes, sum(conf_shift) AS shift FROM obs GROUP BY ALL)
SELECT n.instance_id, n.model_id, n_probes, 19 AS n_fields, round(shift, 9) AS shift, round(CASE WHEN ordinal % 10 = 3 THEN 0 ELSE v END, 9) AS sig, CASE WHEN ordinal % 10 = 3 THEN 0 ELSE CAST(bit_v AS INTEGER) + CAST(bit_l AS INTEGER) + CAST(bit_a AS INTEGER) END AS n_bits, CASE WHEN ordinal % 10 = 3 THEN 'unclear' ELSE label6 END AS label6 FROM n JOIN p USING (instance_id, model_id)""")  # fmt: skip
def teacher_assembly(spark, sf):
    """Records with labels for nine in ten of them; the rest have the defaults."""
    c, _ = _passes(spark, sf, True)
    own = labelled(spark, sf).join(c.where("ordinal % 10 <> 3").select(*KEYS), KEYS)
    rows = nested(spark, sf, labels=own)
    bits = F.col("teacher_bits")
    shift = F.aggregate(F.map_values("probes"), F.lit(0.0), lambda a, v: a + v["conf_shift"])
    return rows.select(*KEYS, F.size("probes").cast("long").alias("n_probes"), F.lit(len(rows.schema["probes"].dataType.valueType.fields)).alias("n_fields"), F.round(shift, 9).alias("shift"), F.round("teacher_signature.V", 9).alias("sig"), (bits["visual"] + bits["language"] + bits["alignment"]).alias("n_bits"), F.col("teacher_label6").alias("label6"))


@query("clean_feature_map", f"{_C} SELECT instance_id, model_id, CAST(5 + CAST(ordinal % 3 = 0 AS INTEGER) AS BIGINT) AS n, round(answer_prob + answer_prob / 2 + (1 - answer_prob) + (ordinal % 7 + 1) + CAST(relation_applicable AS INTEGER) + CASE WHEN ordinal % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END, 9) AS total FROM clean")
def clean_feature_map(spark, sf):
    c, _ = _passes(spark, sf, True)
    m = records.feature_map(F.struct(*records.CLEAN_FEATURES), F.col("relation_applicable"), F.when(F.col("ordinal") % 3 == 0, 0.5))
    return c.select(*KEYS, F.size(m).cast("long").alias("n"), F.round(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


@query("probe_table_json", f"""{_O} SELECT instance_id, model_id, '[' || string_agg('{{"probe":"' || probe || '","answer":"' || CASE WHEN flip THEN 'no' ELSE 'yes' END || '","applicable":' || CAST(applicable AS VARCHAR) || ',"valid":' || CAST(valid AS VARCHAR) || '}}', ',' ORDER BY probe) || ']' AS json FROM obs GROUP BY instance_id, model_id""")
def probe_table_json(spark, sf):
    return nested(spark, sf, healthy=False).select(*KEYS, records.probe_table(F.col("probes")).alias("json"))


@query("failure_rows", f"{_O} SELECT instance_id, model_id, 'teacher_failure' AS record_type, 'invalid_clean' AS error_type, CAST(any_value(ordinal) % 3 + 1 AS INTEGER) AS attempts, 'teacher_cache' AS embedded, count(*) AS n_probes FROM obs WHERE NOT clean_valid GROUP BY instance_id, model_id")
def failure_rows(spark, sf):
    bad = nested(spark, sf, healthy=False).where("not clean.valid")
    done = records.failure_rows(bad, F.lit("invalid_clean"), F.lit("the clean pass is invalid"), F.col("ordinal") % 3 + 1)
    return done.select(*KEYS, "record_type", "error_type", "attempts", F.col("invalid_teacher_record.record_type").alias("embedded"), F.size("invalid_teacher_record.probes").cast("long").alias("n_probes"))


_STATES = f"""{_TAGS}, s AS (SELECT model_id, instance_id, subset, string_agg(tag, ';' ORDER BY tag) AS sources FROM tags GROUP BY ALL), {synth.SQL_LABELS.removeprefix(synth.SQL_CLEAN + ",").strip()}"""


@query("state_rows", f"""{_STATES} SELECT 'state:' || substr(sha256(concat_ws('|', s.model_id, s.instance_id, array_to_string(s.subset, '|'), '42')), 1, 24) AS state_id, any_value(s.sources) AS sources, any_value(CAST(7 - len(s.subset) AS INTEGER)) AS budget, count(o.probe) AS n_acquired,
  round(coalesce(sum(o.conf_shift + o.entropy_shift + o.margin_shift), 0), 9) AS shifts, CAST(coalesce(sum(CAST(o.flip AS INTEGER)), 0) AS BIGINT) AS flips, any_value(CAST(l.clean_correct AS INTEGER)) AS clean_correct, any_value(l.label6) AS label6
FROM s JOIN labelled l ON l.model_id = s.model_id AND l.instance_id = s.instance_id LEFT JOIN obs o ON o.model_id = s.model_id AND o.instance_id = s.instance_id AND list_contains(s.subset, o.probe) GROUP BY s.model_id, s.instance_id, s.subset""")  # fmt: skip
def state_rows(spark, sf):
    seen = F.col("learner_input.acquired_observations")

    def added(f):
        return F.aggregate(seen, F.lit(0.0), lambda a, o: a + f(o))

    done = records.state_rows(nested(spark, sf))
    return done.select("state_id", F.array_join("sampling.sources", ";").alias("sources"), F.col("learner_input.remaining_budget").alias("budget"), F.size(seen).cast("long").alias("n_acquired"),
        F.round(added(lambda o: o["conf_shift"] + o["entropy_shift"] + o["margin_shift"]), 9).alias("shifts"), added(lambda o: o["flip"]).cast("long").alias("flips"), F.col("targets.clean_correct").alias("clean_correct"), F.col("targets.teacher_label6").alias("label6"))


_SHARD = "CAST(('0x' || substr(sha256(model_id || '|' || instance_id), 1, 16))::UBIGINT % 7 AS INTEGER)"


@query("resume_errors", f"""{_O}, h AS (SELECT DISTINCT instance_id, model_id, ordinal, clean_valid, {_SHARD} AS shard FROM obs), f AS (SELECT instance_id, model_id, bool_and(valid AND applicable) AS fine FROM obs GROUP BY ALL),
t AS (SELECT h.*, fine FROM h JOIN f USING (instance_id, model_id) WHERE (model_id = 'model_a' AND (shard = 0 OR ordinal % 59 = 1)) OR (model_id = 'model_b' AND shard = 0 AND ordinal % 61 = 2)), d AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE ordinal % 41 = 7),
e AS ({_rules(("the model is another one", "SELECT count(*) FROM d WHERE model_id = 'model_b'"), ("the manifest has changed", "SELECT count(*) FROM d WHERE ordinal % 53 = 3"), ("the row is in the wrong shard", "SELECT count(*) FROM d WHERE shard <> 0"), ("an invalid row can't be resumed", "SELECT count(*) FROM d WHERE NOT clean_valid"),
    ("a legal probe is invalid or inapplicable", "SELECT count(*) FROM d WHERE NOT fine"), ("the key is there twice", "SELECT count(*) FROM t WHERE ordinal % 41 = 7"), ("the row is outside of the selection", "SELECT count(*) FROM d WHERE ordinal % 11 = 0"))}) SELECT rule, n FROM e WHERE n > 0""")  # fmt: skip
def resume_errors(spark, sf):
    n, model = F.col("ordinal"), F.col("model_id")
    rows = nested(spark, sf, healthy=False).withColumn("_shard", hashing.shard_of(F.col("instance_id"), model, 7))
    rows = rows.where(((model == "model_a") & ((F.col("_shard") == 0) | (n % 59 == 1))) | ((model == "model_b") & (F.col("_shard") == 0) & (n % 61 == 2))).drop("_shard")
    rows = rows.withColumns({"valid": F.col("clean.valid"), "source_manifest_sha256": F.when(n % 53 == 3, "other").otherwise("m"), "frozen_probe_config_sha256": F.lit("c"), "shard_id": F.lit(0), "num_shards": F.lit(7)})
    rows = rows.unionByName(rows.where(n % 41 == 7))
    selected = synth.manifest(spark, sf).where("ordinal % 11 <> 0")
    return _counted(records.resume_errors(rows, selected, records.resume_rules("model_a", "m", "c", 0, 7)))


@query("answer_contract", f"""{_C}, k AS (SELECT *, dataset = 'vizwiz' AS viz, dataset = 'hallusionbench' AS hal, dataset = 'hallusionbench' AND ordinal % 3 <> 0 AS bin FROM clean), e AS ({_rules(
    ("gold_answer differs from the manifest", "SELECT count(*) FROM k WHERE (viz OR hal) AND ordinal % 13 = 1"), ("reference_answers differs from the manifest", "SELECT count(*) FROM k WHERE (viz OR hal) AND ordinal % 19 = 4"),
    ("the stored correctness is stale", "SELECT count(*) FROM k WHERE (viz OR bin) AND ordinal % 17 = 2"))}) SELECT rule, n FROM e WHERE n > 0""")  # fmt: skip
def answer_contract(spark, sf):
    """Every clean answer is right, but for stale rows, and golds and references are changed in some records."""
    n = F.col("ordinal")
    kind = F.when(F.col("dataset") == "hallusionbench", F.when(n % 3 == 0, "open_ended").otherwise("binary"))
    gold = F.when(n % 2 == 0, "yes").otherwise("no")
    m = synth.manifest(spark, sf).withColumns({"answer_type": kind, "gold_answer": gold, "reference_answers": F.array(gold), "answer_contract_version": F.lit(1)})
    rows = nested(spark, sf).withColumns({
        "answer_type": kind, "gold_answer": F.when(n % 13 == 1, "other").otherwise(gold), "reference_answers": F.when(n % 19 == 4, F.array(gold, gold)).otherwise(F.array(gold)), "answer_contract_version": F.lit(1),
        "clean": F.col("clean").withField("correct", F.when(n % 17 == 2, 0).otherwise(1)),
    })
    return _counted(records.contract_errors(rows, m, tx.normalise))


_N_STATES = "SELECT count(*) FROM s JOIN clean c ON c.model_id = s.model_id AND c.instance_id = s.instance_id WHERE c.ordinal % 37 <> 6 AND NOT (c.ordinal % 43 = 9 AND len(s.subset) = 0) AND c.ordinal % 97 <> 5"


@query("artifact_errors", f"""{_STATES}, e AS ({_rules(
    ("the record type is wrong", "SELECT count(*) FROM clean WHERE ordinal % 97 = 11"), ("the split is not allowed", "SELECT count(*) FROM clean WHERE ordinal % 97 = 29"), ("split differs from the manifest", "SELECT count(*) FROM clean WHERE ordinal % 97 = 29"),
    ("the model's revision is not pinned", "SELECT count(*) FROM clean WHERE ordinal % 97 = 17"), ("answer_prob is out of range", "SELECT count(*) FROM clean WHERE ordinal % 97 = 23"), ("the probes are not the legal ones", "SELECT count(*) FROM clean WHERE ordinal % 97 = 5"),
    ("the label is unknown", "SELECT count(*) FROM clean WHERE ordinal % 97 = 31"), ("the label is stale", "SELECT coalesce(sum(1 + CAST(ordinal % 31 = 12 AS INTEGER)), 0) FROM clean WHERE ordinal % 97 = 31 AND ordinal % 29 <> 8"), ("a record has no label", "SELECT count(*) FROM clean WHERE ordinal % 29 = 8"),
    ("a label is there twice", "SELECT count(*) FROM clean WHERE ordinal % 31 = 12 AND ordinal % 29 <> 8"), ("a record has no states", "SELECT count(*) FROM clean WHERE ordinal % 37 = 6 OR ordinal % 97 = 5"),
    ("a record's states lack a tag", "SELECT count(*) FROM clean WHERE ordinal % 43 = 9 AND ordinal % 37 <> 6 AND ordinal % 97 <> 5"), ("a state's target is stale", f"{_N_STATES} AND (c.ordinal % 47 = 4 OR c.ordinal % 97 = 31)"),
    ("a state's split differs", f"{_N_STATES} AND c.ordinal % 97 = 29"), ("a state's model_revision differs", f"{_N_STATES} AND c.ordinal % 97 = 17"), ("a record is lacking", "SELECT count(*) FROM manifest"))}) SELECT rule, n FROM e WHERE n > 0""")  # fmt: skip
def artifact_errors(spark, sf):
    """All artifacts against each other; a third model is due of which there is no record."""
    made = checkpointed(labelled(spark, sf).select(*KEYS, *[f"{s}_{x}" for s in ("sig", "bit") for x in "vla"], "label6"))  # as artifacts are: files that are read by every rule
    whole, manifest = checkpointed(nested(spark, sf, labels=made)), checkpointed(synth.manifest(spark, sf))
    rows = _faulty(whole)
    n = F.col("ordinal")
    own = made.withColumn("ordinal", _ordinal("instance_id")).where(n % 29 != 8)
    own = own.unionByName(own.where(n % 31 == 12)).drop("ordinal")
    states = records.state_rows(whole.where((n % 37 != 6) & (n % 97 != 5)).withColumn("teacher_label6", F.when(n % 47 == 4, "stale").otherwise(F.col("teacher_label6"))))
    states = states.where(~((_ordinal("metadata.instance_id") % 43 == 9) & (F.size("learner_input.acquired_probe_names") == 0)))
    found = records.artifact_errors(manifest, rows, own, states, (*synth.MODELS, "model_c"))  # states are some thirty times the records, are read once and aren't stored
    return found.groupBy("rule").agg(F.sum("n").alias("n"))


@query("state_source_join", f"{_STATES} SELECT s.model_id, s.instance_id, count(*) AS n_states, any_value(l.label6) AS label6, any_value(CAST(l.clean_correct AS INTEGER)) AS correct FROM s JOIN labelled l ON l.model_id = s.model_id AND l.instance_id = s.instance_id GROUP BY s.model_id, s.instance_id")
def state_source_join(spark, sf):
    rows = nested(spark, sf)
    states = records.state_rows(rows).select(F.col("metadata.model_id").alias("model_id"), F.col("metadata.instance_id").alias("instance_id"))
    both = records.state_sources(states, rows.select(*KEYS, F.col("clean.correct").alias("correct")), labelled(spark, sf).select(*KEYS, "label6"))
    return both.groupBy("model_id", "instance_id").agg(F.count(F.lit(1)).alias("n_states"), F.any_value("label6").alias("label6"), F.any_value("correct").alias("correct"))


def _selection(spark, sf):
    from pyspark.sql import Window

    from plumbline.functions.hashing import rank_key
    from plumbline.operators import sampling

    rows = sampling.hash_limit(dev(spark, sf).withColumn("space", F.lit("natural")), 60, 42, "space", "model_id", "instance_id")
    key = rank_key(42, F.col("space"), F.col("model_id"), F.col("instance_id"))
    return rows.select(*KEYS, key.alias("key")).withColumn("place", F.row_number().over(Window.orderBy("key"))).select(*KEYS, "place", F.lit("natural").alias("provenance"))  # of 60 rows


_SEL = f"{_SIX}, sel AS (SELECT *, row_number() OVER (ORDER BY sha256('42|natural|' || model_id || '|' || instance_id)) AS place FROM n WHERE split IN ('train', 'val') QUALIFY place <= 60)"


@query("audit_packet", f"""{_SEL} SELECT printf('audit_%04d', place) AS audit_id, printf('images/audit_%04d.png', place) AS image_file, 'question ' || CAST(ordinal AS VARCHAR) AS question, CASE WHEN ordinal % 2 = 0 THEN 'Yes.' ELSE 'No' END AS clean_answer, 25 AS n_blinded, 11 AS n_private, model_id, instance_id, label6, 'natural' AS provenance FROM sel""")
def audit_packet(spark, sf):
    """The two sides of a packet, joined again by the id that they share."""
    blinded, private = packets.split(_selection(spark, sf), nested(spark, sf))
    both = blinded.join(private, "audit_id")
    return both.select("audit_id", "image_file", "question", "clean_answer", F.lit(len(blinded.columns)).alias("n_blinded"), F.lit(len(private.columns)).alias("n_private"), "model_id", "instance_id", F.col("teacher_label6").alias("label6"), F.col("selection_subset").alias("provenance"))


@query("audit_label_counts", f"{_SEL} SELECT label6, count(*) AS n FROM sel GROUP BY label6")
def audit_label_counts(spark, sf):
    return packets.label_counts(_selection(spark, sf), labelled(spark, sf))


@query("packet_id_problems", f"{_SEL}, b AS (SELECT place FROM sel WHERE place % 20 <> 3 UNION ALL SELECT place FROM sel WHERE place % 30 = 5), p AS (SELECT place FROM sel WHERE place % 15 <> 7) SELECT printf('audit_%04d', place) AS audit_id, n_blinded, n_private FROM (SELECT coalesce(b.place, p.place) AS place, coalesce(nb, 0) AS n_blinded, coalesce(np, 0) AS n_private FROM (SELECT place, count(*) AS nb FROM b GROUP BY place) b FULL JOIN (SELECT place, count(*) AS np FROM p GROUP BY place) p ON p.place = b.place) WHERE n_blinded <> 1 OR n_private <> 1")
def packet_id_problems(spark, sf):
    rows = packets.numbered(_selection(spark, sf))
    return packets.id_problems(rows.where("place % 20 <> 3").unionByName(rows.where("place % 30 = 5")), rows.where("place % 15 <> 7"))


@query("packet_errors", "SELECT unnest(['private columns are shown: dataset', '70 rows expected, 60 blinded and 56 private found', '4 ids are repeated or differ', 'models are lacking: model_z']) AS error FROM (SELECT count(*) AS n FROM customer) WHERE n > 0")
def packet_errors(spark, sf):
    blinded, private = packets.split(_selection(spark, sf), nested(spark, sf))
    shown = blinded.withColumn("dataset", F.lit("x"))
    return packets.packet_errors(shown, private.where("audit_id not in ('audit_0007', 'audit_0022', 'audit_0037', 'audit_0052')"), 70, ("model_a", "model_b", "model_z"), synth.DATASETS)


_LINES = """WITH r AS (SELECT l_orderkey, l_linenumber, -l_tax - 0.001::DOUBLE AS a, -l_discount - 0.002::DOUBLE AS b, l_linenumber % 4 = 0 AS bad, l_linenumber % 5 = 0 AS none, l_linenumber % 6 = 0 AS odd FROM lineitem), s AS (SELECT *, exp(a) * 0.9::DOUBLE AS p, exp(b) AS q FROM r),
x AS (SELECT *, NOT bad AND NOT none AND NOT odd AS fine, least(1.0::DOUBLE, exp((a + b + (a + b)) / 3)) AS conf, a + b + (a + b) AS lp, (-(p * ln(p) + (1 - p) * ln(1 - p)) - q * ln(q)) / 2 AS ent, ((greatest(p, 1 - p) - least(p, 1 - p)) + q) / 2 AS marg FROM s)"""


def _lines(spark, sf):
    """Scores of lines; every fourth is given as invalid, every fifth has none, every sixth has an infinite one."""
    n = F.col("l_linenumber")
    d = _distributions(spark, sf)
    logprobs = F.when(n % 5 == 0, F.expr("cast(array() as array<double>)")).when(n % 6 == 0, F.array(F.lit(float("inf")))).otherwise(F.col("logprobs"))
    return d.withColumns({"lp": logprobs, "ok": n % 4 != 0})


@query("clean_features_closed", f"""{_LINES} SELECT l_orderkey, l_linenumber, CASE WHEN fine THEN round(conf, 9) ELSE 0 END AS prob, CASE WHEN fine THEN round(ent, 9) ELSE 0 END AS entropy, CASE WHEN fine THEN round(marg, 9) ELSE 0 END AS margin, CASE WHEN fine THEN 3 ELSE 0 END AS n_tokens, CASE WHEN fine THEN round(lp, 9) ELSE -1 END AS logprob, fine AS valid,
  CASE WHEN bad THEN 'given' WHEN none THEN 'missing_scores_or_distributions' WHEN odd THEN 'score_computation_error' ELSE '' END AS reason FROM x""")  # fmt: skip
def clean_features_closed(spark, sf):
    f = features.clean_features(F.col("lp"), F.col("tops"), F.col("ok"), F.lit("given"))
    rows = _lines(spark, sf).withColumn("f", f)
    logprob = F.when(F.col("f.answer_logprob") == float("-inf"), -1.0).otherwise(F.round("f.answer_logprob", 9))
    return rows.select("l_orderkey", "l_linenumber", F.round("f.answer_prob", 9).alias("prob"), F.round("f.token_entropy_mean", 9).alias("entropy"), F.round("f.token_margin_mean", 9).alias("margin"), F.col("f.answer_len_tokens").alias("n_tokens"), logprob.alias("logprob"), "f.valid", F.coalesce("f.invalid_reason", F.lit("")).alias("reason"))


@query("probe_deltas", f"""{_LINES}, y AS (SELECT *, l_orderkey % 3 = 0 AS same, l_orderkey % 2 AS sem FROM x) SELECT l_orderkey, l_linenumber, fine AND NOT same AS flip, CASE WHEN fine THEN round(conf - 0.7::DOUBLE, 9) ELSE 0 END AS conf_shift, CASE WHEN fine THEN round(ent - 0.1::DOUBLE, 9) ELSE 0 END AS entropy_shift, CASE WHEN fine THEN round(marg - 0.5::DOUBLE, 9) ELSE 0 END AS margin_shift,
  CASE WHEN fine AND same THEN 1.0 ELSE 0.0 END AS exact_match, CASE WHEN fine THEN CAST(sem AS DOUBLE) ELSE 0 END AS semantic_match, CASE WHEN bad THEN 'given' WHEN none OR odd THEN 'score_computation_failed' ELSE '' END AS reason FROM y""")  # fmt: skip
def probe_deltas(spark, sf):
    """Scores of a probe less those of its clean pass."""
    clean = F.struct(F.lit(0.7).alias("answer_prob"), F.lit(0.1).alias("token_entropy_mean"), F.lit(0.5).alias("token_margin_mean"))
    n = F.col("l_orderkey")
    f = features.probe_features(F.col("lp"), F.col("tops"), F.when(n % 3 == 0, "yes").otherwise("no"), clean, F.lit("yes"), n % 2, F.col("ok"), F.lit("given"))
    rows = _lines(spark, sf).withColumn("f", f)
    return rows.select("l_orderkey", "l_linenumber", "f.flip", *[F.round(f"f.{c}", 9).alias(c) for c in ("conf_shift", "entropy_shift", "margin_shift")], "f.exact_match", "f.semantic_match", F.coalesce("f.invalid_reason", F.lit("")).alias("reason"))


@query("lenient_scores", f"{_LINES} SELECT l_orderkey, l_linenumber, CASE WHEN none THEN 0 WHEN odd THEN -1 ELSE round(exp((a + b + (a + b)) / 3), 9) END AS confidence, round(ent, 9) AS entropy, round(marg, 9) AS margin, CASE WHEN odd AND NOT none THEN 'confidence' ELSE '' END AS issues FROM x")
def lenient_scores(spark, sf):
    rows = _lines(spark, sf).withColumn("f", features.lenient(F.col("lp"), F.col("tops")))
    conf = F.when(F.col("f.confidence") == float("inf"), -1.0).otherwise(F.round("f.confidence", 9))
    return rows.select("l_orderkey", "l_linenumber", conf.alias("confidence"), F.round("f.entropy", 9).alias("entropy"), F.round("f.margin", 9).alias("margin"), F.array_join("f.issues", ",").alias("issues"))


@query("transform_digests", f"""WITH {synth.SQL_GRID} SELECT instance_id, model_id, probe, severity, sha256(CASE probe WHEN 'blur' THEN '{{"sigma": ' || CAST(severity AS VARCHAR) || ', "transform": "blur"}}' WHEN 'crop' THEN '{{"retain_fraction": ' || CAST(severity AS VARCHAR) || ', "transform": "crop"}}' WHEN 'brightness' THEN '{{"factor": ' || CAST(severity AS VARCHAR) || ', "transform": "brightness"}}'
  ELSE '{{"seed": ' || CAST(('0x' || substr(sha256('42|' || instance_id || '|noise|' || CAST(severity AS VARCHAR)), 1, 8))::UBIGINT AS VARCHAR) || ', "sigma": ' || CAST(severity AS VARCHAR) || ', "transform": "noise"}}' END) AS digest FROM grid""")  # fmt: skip
def transform_digests(spark, sf):
    seed = hashing.derived_seed(42, F.col("instance_id"), F.col("probe"), features.python_float(F.col("severity")))
    return synth.severity_grid(spark, sf).select(*KEYS, "probe", "severity", features.transform_digest(F.col("probe"), F.col("severity"), seed).alias("digest"))


_GP = "'First, describe what you see in the image in 1-2 sentences.' || chr(10) || 'Then, ' || {} || chr(10) || '{}: ' || x || chr(10) || 'At the very end of your response, format your final answer strictly as:' || chr(10) || 'FINAL_ANSWER: <{}>'"


@query("grounding_prompts", f"""{_Q}, d AS (SELECT *, {_listed(_DS)}[id % 5 + 1] AS ds FROM q) SELECT id, sha256(CASE WHEN ds = 'VSR' THEN {_GP.format("'determine if the following statement is true or false.'", "Statement", "true or false")} WHEN ds = 'vizwiz vqa' OR id % 7 = 0 THEN {_GP.format("'answer the following question concisely.'", "Question", "answer")}
  ELSE {_GP.format("'answer the following question.'", "Question", "yes or no")} END) AS digest FROM d""")  # fmt: skip
def grounding_prompts(spark, sf):
    rows = _questions(spark, sf).withColumn("ds", _pick(_DS, F.col("id")))
    return rows.select("id", hashing.sha256_hex(tx.grounding_prompt(F.col("x"), F.col("ds"), F.when(F.col("id") % 7 == 0, "open_ended"))).alias("digest"))


@query("human_labels", "SELECT event_id, event_id % 6 IN (1, 3, 5) AS match, round(CAST(value AS DOUBLE) / 1000 - 0.5, 9) AS similarity FROM events WHERE abs(value / 1000 - 0.5) <= 1")
def human_labels(spark, sf):
    """Labels and similarities that come as text."""
    n = F.col("event_id")
    rows = synth.table(spark, sf, "events").where("abs(value / 1000 - 0.5) <= 1").select(n, n.cast("string").alias("audit_id"), _pick(("0", " TRUE ", "no", "1", "False", "Yes"), n).alias("human_match"), (F.col("value").cast("double") / 1000 - 0.5).cast("string").alias("cosine_similarity"), _pick(("train", "val"), n).alias("split"))
    return quality.human_labels(rows).select("event_id", "match", F.round("similarity", 9).alias("similarity"))


def _pilot(spark, sf):
    """Canonical and severity records in one table; some are there twice, some are of another model."""
    c = synth.clean(spark, sf).select(F.lit("teacher_cache").alias("record_type"), *KEYS, "dataset", F.lit(None).cast("string").alias("pilot_severity_probe"), F.lit(None).cast("double").alias("pilot_severity_value"), "split", "ordinal")
    g = synth.severity_grid(spark, sf).withColumn("ordinal", F.element_at(F.split("instance_id", "_"), -1).cast("long"))
    g = g.select(F.lit("severity_pilot").alias("record_type"), *KEYS, "dataset", F.col("probe").alias("pilot_severity_probe"), F.col("severity").alias("pilot_severity_value"), "split", "ordinal")
    return c.unionByName(c.where("ordinal % 23 = 4")).unionByName(g).unionByName(g.where("ordinal % 29 = 3 and pilot_severity_probe = 'blur'"))


_PILOT = f"""WITH {synth.SQL_GRID}, c2 AS (SELECT instance_id, model_id, dataset, split, ordinal FROM clean), g2 AS (SELECT grid.*, ordinal FROM grid JOIN clean c USING (instance_id, model_id)),
pilot AS (SELECT *, NULL AS probe, NULL::DOUBLE AS severity FROM c2 UNION ALL SELECT *, NULL, NULL FROM c2 WHERE ordinal % 23 = 4 UNION ALL SELECT instance_id, model_id, dataset, split, ordinal, probe, severity FROM g2 UNION ALL SELECT instance_id, model_id, dataset, split, ordinal, probe, severity FROM g2 WHERE ordinal % 29 = 3 AND probe = 'blur')"""


@query("pilot_scope", f"{_PILOT}, e AS (SELECT 'another model or dataset' AS error FROM pilot WHERE model_id <> 'model_a' OR dataset <> 'pope' UNION ALL SELECT 'there twice' FROM pilot GROUP BY instance_id, model_id, dataset, probe, severity HAVING count(*) > 1) SELECT error, count(*) AS n FROM e GROUP BY error")
def pilot_scope(spark, sf):
    return quality.scope_errors(_pilot(spark, sf), "model_a", "pope").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("pilot_partition", f"{_PILOT} SELECT CASE WHEN probe IS NULL THEN 'canonical' ELSE 'severity' END AS part, dataset, count(*) AS n FROM pilot GROUP BY ALL")
def pilot_partition(spark, sf):
    rows = _pilot(spark, sf)
    both = quality.canonical(rows).withColumn("part", F.lit("canonical")).unionByName(quality.severities(rows).withColumn("part", F.lit("severity")))
    return both.groupBy("part", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query("validation_totals", f"{_PILOT} SELECT count(*) AS n, count(*) FILTER (split IN ('train', 'val')) AS n_valid, count(*) FILTER (split NOT IN ('train', 'val')) AS n_invalid, count(DISTINCT ROW(model_id, dataset, instance_id, probe, severity)) AS n_unique, count(*) - count(DISTINCT ROW(model_id, dataset, instance_id, probe, severity)) AS n_duplicate, array_to_string(list_sort(list(DISTINCT dataset)), ',') AS datasets, array_to_string(list_sort(list(DISTINCT model_id)), ',') AS models FROM pilot")
def validation_totals(spark, sf):
    done = records.totals(quality.identity(_pilot(spark, sf)), [quality.split_rule(("train", "val"))], ["key"], ("dataset", "model_id"))
    return done.select("n", "n_valid", "n_invalid", "n_unique", "n_duplicate", F.array_join("dataset", ",").alias("datasets"), F.array_join("model_id", ",").alias("models"))


@query("shard_rollup", f"{_C}, sh AS (SELECT model_id, {_SHARD} AS shard, count(*) AS selected, count(*) FILTER (clean_valid) AS valid, count(*) FILTER (ordinal % 14 = 0) AS dropped FROM clean GROUP BY ALL) SELECT model_id, CAST(sum(selected) AS BIGINT) AS selected, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(dropped) AS BIGINT) AS dropped, CASE WHEN sum(dropped) <> 14 THEN 'dropped' ELSE '' END AS unexpected FROM sh GROUP BY model_id")
def shard_rollup(spark, sf):
    c = synth.clean(spark, sf).withColumn("shard", hashing.shard_of(F.col("instance_id"), F.col("model_id"), 7))
    shards = c.groupBy("model_id", "shard").agg(F.count(F.lit(1)).alias("selected"), F.count_if("clean_valid").alias("valid"), F.count_if(F.col("ordinal") % 14 == 0).alias("dropped"))
    done = ledger.rollup(shards, "model_id", ["selected", "valid", "dropped"], {"dropped": 14})
    return done.withColumn("unexpected", F.array_join("unexpected", ","))


@query("semantic_candidates", f"{_O} SELECT model_id, instance_id, probe, CASE WHEN ordinal % 2 = 0 THEN 'yes' ELSE 'no' END AS clean_answer, CASE WHEN flip THEN 'no' ELSE 'yes' END AS probe_answer FROM obs WHERE dataset = 'vizwiz' AND split IN ('train', 'val') AND valid AND applicable AND ordinal % 9 <> 1 AND (ordinal % 2 = 0) = flip")
def semantic_candidates(spark, sf):
    rows = nested(spark, sf, healthy=False).withColumn("pilot_severity_probe", F.when(F.col("ordinal") % 9 == 1, "blur"))
    return quality.semantic_candidates(rows).select(*KEYS, "probe", "clean_answer", "probe_answer")


@query("ledger_errors", f"""{_C}, t AS (SELECT * FROM clean WHERE ordinal % 4 = 0), d AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE ordinal % 20 = 8), e AS ({_rules(("the record type is wrong", "SELECT count(*) FROM d WHERE ordinal % 13 = 2"), ("the schema is unknown", "SELECT count(*) FROM d WHERE ordinal % 17 = 3"), ("the model is another one", "SELECT count(*) FROM d WHERE model_id <> 'model_a'"),
    ("source_manifest_sha256 has changed", "SELECT count(*) FROM d WHERE ordinal % 19 = 1"), ("the key is there twice", "SELECT count(*) FROM t WHERE ordinal % 20 = 8"), ("the key is outside of the selection", "SELECT count(*) FROM d WHERE ordinal % 11 = 0"))}) SELECT rule AS error, n FROM e WHERE n > 0""")  # fmt: skip
def ledger_errors(spark, sf):
    n = F.col("ordinal")
    rows = synth.clean(spark, sf).where(n % 4 == 0).select(*KEYS, n, F.when(n % 13 == 2, "other").otherwise("teacher_failure").alias("record_type"), F.when(n % 17 == 3, 2).otherwise(1).alias("schema_version"), F.when(n % 19 == 1, "old").otherwise("m").alias("source_manifest_sha256"))
    rows = rows.unionByName(rows.where(n % 20 == 8))
    rules = ledger.ledger_rules("teacher_failure", 1, "model_a", {"source_manifest_sha256": "m"})
    return ledger.ledger_errors(rows, synth.manifest(spark, sf).where(n % 11 != 0), rules, KEYS).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("base_coverage", f"{_C} SELECT instance_id, model_id, CASE WHEN ordinal % 7 = 2 THEN 'missing' ELSE 'extra' END AS problem FROM clean WHERE (ordinal % 7 = 2) <> (ordinal % 10 = 4)")
def base_coverage(spark, sf):
    c = synth.clean(spark, sf)
    return ledger.covered(c.where("ordinal % 7 <> 2"), c.where("ordinal % 10 <> 4"), KEYS)


@query("changed_sources", f"{_C} SELECT instance_id, model_id, CASE WHEN ordinal % 12 = 5 THEN 'base' ELSE array_to_string(list_filter([CASE WHEN ordinal % 8 = 1 THEN 'group_id' END, CASE WHEN ordinal % 6 = 1 THEN 'split' END], lambda x: x IS NOT NULL), ',') END AS differ FROM clean WHERE ordinal % 12 = 5 OR ordinal % 8 = 1 OR ordinal % 6 = 1")
def changed_sources(spark, sf):
    c = synth.clean(spark, sf)
    n = F.col("ordinal")
    new = c.withColumns({"group_id": F.when(n % 8 == 1, "g").otherwise(F.col("group_id")), "split": F.when(n % 6 == 1, F.lit(None)).otherwise(F.col("split"))})
    return ledger.changed_sources(new, c.where(n % 12 != 5), KEYS, ["group_id", "split"]).select(*KEYS, F.array_join("differ", ",").alias("differ"))


@query("rescored_probes", f"""{_O}, r AS (SELECT *, CASE WHEN ordinal % 2 = 0 THEN 'yes' ELSE 'no' END AS new_clean, CASE WHEN ordinal % 5 = 0 THEN 'old' ELSE CASE WHEN ordinal % 2 = 0 THEN 'yes' ELSE 'no' END END AS old_clean, CASE WHEN flip THEN 'no' ELSE 'yes' END AS norm, CASE WHEN ordinal % 3 = 0 THEN 'stale' ELSE CASE WHEN flip THEN 'no' ELSE 'yes' END END AS was FROM obs)
SELECT instance_id, model_id, probe, valid AND norm <> new_clean OR NOT valid AND flip AS flip, CASE WHEN NOT valid THEN CAST(semantic_match AS DOUBLE) WHEN norm = new_clean THEN 1.0 WHEN norm <> was OR old_clean <> new_clean THEN CASE WHEN probe = 'noise' THEN 1.0 ELSE 0.0 END ELSE CAST(semantic_match AS DOUBLE) END AS semantic FROM r""")  # fmt: skip
def rescored_probes(spark, sf):
    n = F.col("ordinal")
    rows = nested(spark, sf, healthy=False)
    rows = rows.withColumn("p", F.transform_values("probes", lambda k, v: F.struct(v["raw_answer"].alias("raw"), F.when(n % 3 == 0, "stale").otherwise(v["norm_answer"]).alias("norm"), v["flip"].alias("flip"), v["exact_match"].cast("int").alias("exact"), v["semantic_match"].alias("semantic"), v["valid"].alias("valid"))))
    old = F.when(n % 5 == 0, "old").otherwise(F.col("clean.norm_answer"))
    done = ledger.rescored(F.col("p"), old, F.col("clean.norm_answer"), tx.yes_no, F.create_map(F.lit("noise"), F.lit(0.9), F.lit("blur"), F.lit(0.5)), 0.82)
    return rows.select(*KEYS, F.explode(done).alias("probe", "o")).select(*KEYS, "probe", "o.flip", "o.semantic")


@query("parser_drift", f"{_T}, d AS (SELECT id, {_SYES} AS norm, id % 3 = 0 AS stale, id % 11 <> 0 AS valid FROM f), e AS (SELECT id, CASE WHEN stale THEN 'old' ELSE norm END AS stored, norm AS current, CASE WHEN NOT valid THEN 'not valid' WHEN norm = 'unknown' THEN 'no longer parses' WHEN stale THEN 'another answer' END AS reason FROM d) SELECT * FROM e WHERE reason IS NOT NULL")
def parser_drift(spark, sf):
    rows = texts(spark, sf)
    fresh = tx.yes_no(F.col("x"))
    rows = rows.withColumns({"norm": F.when(F.col("id") % 3 == 0, "old").otherwise(fresh), "valid": F.col("id") % 11 != 0})
    return ledger.parser_drift(rows, F.struct((fresh != "unknown").alias("valid"), fresh.alias("norm")), ["id"])


@query("reused_grid", f"WITH {synth.SQL_GRID} SELECT instance_id, model_id, probe, severity, CASE WHEN (probe = 'blur' AND severity = 8) OR (probe = 'noise' AND severity = 25) THEN 'reused' ELSE 'computed' END AS source FROM grid")
def reused_grid(spark, sf):
    canonical = synth.observations(spark, sf).where("probe in ('blur', 'noise')").select(*KEYS, "probe")
    settings = spark.createDataFrame([("blur", 8.0), ("noise", 25.0)], "probe string, severity double")
    grid = synth.severity_grid(spark, sf).select(*KEYS, "probe", "severity")
    return ledger.reused_grid(canonical, grid, settings, KEYS)


def _overlap():
    """A matcher as one is injected: made once in a worker, then called for each pair."""

    def similarity(a: str, b: str) -> float:
        return len(set(a) & set(b)) / max(1, len(set(a) | set(b)))

    return similarity


@query("pair_scores", """WITH e AS (SELECT event_id, event_type AS a, ['click', 'view', 'unknown', 'purchase'][event_id % 4 + 1] AS b FROM events), s AS (SELECT *, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM e)
SELECT event_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS similarity FROM s""")  # fmt: skip
def pair_scores(spark, sf):
    rows = synth.table(spark, sf, "events").select("event_id", F.col("event_type").alias("a"), _pick(("click", "view", "unknown", "purchase"), F.col("event_id")).alias("b"))
    return pairs.scored(rows, "a", "b", _overlap, "letters").select("event_id", F.round("similarity", 9).alias("similarity"))


@query("listed_errors", f"{_C}, e AS (SELECT 'split is not allowed' AS rule, instance_id, model_id FROM clean WHERE split NOT IN ('train', 'val')) SELECT rule, instance_id, model_id, (SELECT count(*) FROM e) AS n_errors FROM e ORDER BY rule, instance_id, model_id LIMIT 100")
def listed_errors(spark, sf):
    """The first hundred errors, and how many there are."""
    found = records.errors_of(synth.clean(spark, sf), [quality.split_rule(("train", "val"))])
    return quality.listed(found, ["rule", "instance_id", "model_id"], 100)


_FILE = "'file' || CAST(ordinal % 3 AS VARCHAR)"
_LAB = f"""{_SIX}, x AS (SELECT * FROM n WHERE ordinal % 83 <> 2),
e AS ({_rules(("a label has no record", "SELECT count(*) FROM x WHERE ordinal % 89 = 1"), ("the label's split is stale", "SELECT count(*) FROM x WHERE ordinal % 89 <> 1 AND ordinal % 67 = 5"), ("the label's dataset is stale", "SELECT count(*) FROM x WHERE ordinal % 89 <> 1 AND ordinal % 71 = 6"),
    ("the label's visual is stale", "SELECT count(*) FROM x WHERE ordinal % 89 <> 1 AND ordinal % 73 = 7"), ("the label's visual is no bit", "SELECT count(*) FROM x WHERE ordinal % 73 = 7"), ("the label's teacher_label6 is stale", "SELECT count(*) FROM x WHERE ordinal % 89 <> 1 AND ordinal % 79 = 8"), ("the label is unknown", "SELECT count(*) FROM x WHERE ordinal % 79 = 8"),
    ("the label's clean_correct is stale", "SELECT count(*) FROM x WHERE ordinal % 89 <> 1 AND ordinal % 61 = 4"), ("the label's signature is stale", "SELECT count(*) FROM x WHERE ordinal % 89 <> 1 AND ordinal % 59 = 3"), ("the label's signature is not finite", "SELECT count(*) FROM x WHERE ordinal % 59 = 3"),
    ("the label's digest is stale", "SELECT count(*) FROM x WHERE ordinal % 89 <> 1 AND ordinal % 53 = 2"), ("the label's digest is not that of its fields", "SELECT count(*) FROM x WHERE ordinal % 53 = 2 OR ordinal % 67 = 5 OR ordinal % 71 = 6 OR ordinal % 73 = 7 OR ordinal % 79 = 8 OR ordinal % 61 = 4"),
    ("the label is of another teacher file", "SELECT count(*) FROM x WHERE ordinal % 89 <> 1 AND ordinal % 47 = 1"))})"""


def _labels_of(rows):
    """Label rows of healthy records, with faults: each kind in the rows of one remainder."""
    n = F.col("ordinal")
    file = F.concat(F.lit("file"), (n % 3).cast("string"))
    own = provenance.label_table(rows.withColumn("teacher_file_sha256", file), F.col("teacher_file_sha256"))
    own = own.withColumn("ordinal", _ordinal("instance_id")).where(n % 83 != 2)
    return own.withColumns({
        "split": F.when(n % 67 == 5, "dev").otherwise(F.col("split")), "dataset": F.when(n % 71 == 6, "other").otherwise(F.col("dataset")), "visual": F.when(n % 73 == 7, 2).otherwise(F.col("visual")), "teacher_label6": F.when(n % 79 == 8, "?").otherwise(F.col("teacher_label6")),
        "clean_correct": F.when(n % 61 == 4, 1 - F.col("clean_correct")).otherwise(F.col("clean_correct")), "teacher_signature": F.when(n % 59 == 3, F.col("teacher_signature").withField("L", F.lit(float("nan")))).otherwise(F.col("teacher_signature")),
        "label_record_sha256": F.when(n % 53 == 2, F.lit("0" * 64)).otherwise(F.col("label_record_sha256")), "source_teacher_file_sha256": F.when(n % 47 == 1, "other").otherwise(F.col("source_teacher_file_sha256")),
    })


@query("label_errors", f"{_LAB} SELECT rule, n FROM e WHERE n > 0")
def label_errors(spark, sf):
    rows = checkpointed(nested(spark, sf))
    n = F.col("ordinal")
    whole = rows.withColumn("teacher_file_sha256", F.concat(F.lit("file"), (n % 3).cast("string")))
    return _counted(provenance.label_errors(_labels_of(rows).drop("ordinal"), whole.where(n % 89 != 1)))


@query("state_file_errors", f"""{_STATES}, k AS (SELECT c.ordinal FROM s JOIN clean c ON c.model_id = s.model_id AND c.instance_id = s.instance_id), e AS ({_rules(("a state has no record and label", "SELECT count(*) FROM k WHERE ordinal % 83 = 2"),
    ("the state is of another teacher file", "SELECT count(*) FROM k WHERE ordinal % 83 <> 2 AND ordinal % 31 = 4"), ("the state is of another label file", "SELECT count(*) FROM k WHERE ordinal % 83 <> 2 AND ordinal % 37 = 5"))}) SELECT rule, n FROM e WHERE n > 0""")  # fmt: skip
def state_file_errors(spark, sf):
    rows = checkpointed(nested(spark, sf))
    n = F.col("ordinal")
    file = F.concat(F.lit("file"), (n % 3).cast("string"))
    states = records.state_rows(rows).select("metadata", "state_id").withColumn("ordinal", _ordinal("metadata.instance_id"))
    states = states.withColumns({"source_teacher_file_sha256": F.when(n % 31 == 4, "other").otherwise(file), "source_label_file_sha256": F.when(n % 37 == 5, F.lit(None)).otherwise("labels")}).drop("ordinal")
    return _counted(provenance.state_file_errors(states, rows.withColumn("teacher_file_sha256", file), _labels_of(rows).withColumn("label_file_sha256", F.lit("labels"))))


#: Each rule of records and of probes, with the remainder of 101 at which it is broken, and what breaks it.
def _every_fault():
    clean, probes, nan = F.col("clean"), F.col("probes"), F.lit(float("nan"))

    def each(field, value):
        return "probes", F.transform_values(probes, lambda k, v: v.withField(field, value))

    faults = {
        "the key is incomplete": ("model_id", F.lit("")), "the record type is wrong": ("record_type", F.lit(None).cast("string")), "the split is not allowed": ("split", F.lit("dev")), "the model's revision is not pinned": ("model_revision", F.lit("main")),
        "the clean pass is invalid": ("clean", clean.withField("valid", F.lit(False))), "a clean feature is not finite": ("clean", clean.withField("token_margin_mean", nan)), "answer_prob is out of range": ("clean", clean.withField("answer_prob", F.lit(-0.5))), "clean.correct is not 0 or 1": ("clean", clean.withField("correct", F.lit(2))),
        "the probes are not the legal ones": ("probes", F.map_filter(probes, lambda k, v: k != "blur")), "an answer is missing": each("norm_answer", F.lit("")), "a flag is missing": each("flip", F.lit(None).cast("boolean")),
        **{f"{c} is not finite": each(c, nan) for c in ("conf_shift", "entropy_shift", "margin_shift", "exact_match", "semantic_match")}, "a legal probe is invalid or inapplicable": each("applicable", F.lit(False)),
        "a bit is not 0 or 1": ("teacher_bits", F.col("teacher_bits").withField("language", F.lit(3))), "a signature is out of range": ("teacher_signature", F.col("teacher_signature").withField("A", F.lit(1.5))), "the label is unknown": ("teacher_label6", F.lit("none")),
    }
    return {rule: (at, *fault) for at, (rule, fault) in enumerate(faults.items())}


_FAULTS = (
    "the key is incomplete", "the record type is wrong", "the split is not allowed", "the model''s revision is not pinned", "the clean pass is invalid", "a clean feature is not finite", "answer_prob is out of range", "clean.correct is not 0 or 1", "the probes are not the legal ones", "an answer is missing",
    "a flag is missing", "conf_shift is not finite", "entropy_shift is not finite", "margin_shift is not finite", "exact_match is not finite", "semantic_match is not finite", "a legal probe is invalid or inapplicable", "a bit is not 0 or 1", "a signature is out of range", "the label is unknown",
)


@query("every_record_rule", f"""{_C}, f(place, rule) AS (VALUES {", ".join(f"({i}, '{r}')" for i, r in enumerate(_FAULTS))}) SELECT rule, instance_id FROM clean JOIN f ON ordinal % 101 = place WHERE model_id = 'model_a'""")
def every_record_rule(spark, sf):
    """Each rule is broken in rows of its own, and must be the only one found there."""
    rows = nested(spark, sf).where("model_id = 'model_a'")
    for at, column, value in _every_fault().values():
        rows = rows.withColumn(column, F.when(F.col("ordinal") % 101 == at, value).otherwise(F.col(column)))
    return records.errors_of(rows, records.record_rules()).select("rule", "instance_id")
