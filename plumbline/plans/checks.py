"""Queries on joins, set operations, quality rules and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import audits, coverage, labels, ledger, quality, sampling
from plumbline.plans import synth
from plumbline.plans.evidence import _C, _L, _M, _O, KEYS, labelled
from plumbline.plans.registry import query


@query("teacher_manifest_join", f"""{_C}, m2 AS (SELECT instance_id, group_id, dataset, CASE WHEN ordinal % 50 = 0 THEN 'other' ELSE split END AS split FROM manifest WHERE ordinal % 17 <> 0)
SELECT c.instance_id, c.model_id, m2.instance_id IS NOT NULL AS found, CASE WHEN m2.instance_id IS NOT NULL THEN CASE WHEN c.split IS DISTINCT FROM m2.split THEN 'split' ELSE '' END END AS differ FROM clean c LEFT JOIN m2 ON m2.instance_id = c.instance_id""")  # fmt: skip
def teacher_manifest_join(spark, sf):
    m = synth.manifest(spark, sf).where("ordinal % 17 <> 0").withColumn("split", F.when(F.col("ordinal") % 50 == 0, "other").otherwise(F.col("split")))
    c = synth.clean(spark, sf).select(*KEYS, "group_id", "dataset", "split")
    other = m.select("instance_id", "group_id", "dataset", "split")
    done = coverage.compare_columns(c, other, ["instance_id"], ["group_id", "dataset", "split"], ["model_id"])
    return done.select(*KEYS, "found", F.array_join("differ", ",").alias("differ"))


@query("teacher_label_join", f"{_L} SELECT c.instance_id, c.model_id, c.clean_correct, l.label6 FROM clean c JOIN labelled l ON l.instance_id = c.instance_id AND l.model_id = c.model_id")
def teacher_label_join(spark, sf):
    return labels.with_labels(synth.clean(spark, sf).select(*KEYS, "clean_correct"), labelled(spark, sf), KEYS)


@query("resume_anti", f"{_C} SELECT instance_id, model_id FROM clean WHERE NOT clean_valid")
def resume_anti(spark, sf):
    c = synth.clean(spark, sf)
    return coverage.pending(c.select(*KEYS), c.where("clean_valid"), KEYS)


@query("stale_semi", f"{_C} SELECT instance_id, model_id FROM clean WHERE ordinal % 3 = 0 AND clean_valid")
def stale_semi(spark, sf):
    c = synth.clean(spark, sf)
    return coverage.settled(c.where("ordinal % 3 = 0").select(*KEYS), c.where("clean_valid"), KEYS)


@query("coverage_full_outer", "SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS both, count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (d.doc_id IS NULL) AS extra FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def coverage_full_outer(spark, sf):
    return coverage.coverage(synth.table(spark, sf, "documents"), synth.table(spark, sf, "labels"), ["doc_id"])


_OLD = "o AS (SELECT * FROM manifest WHERE ordinal % 31 <> 0), n AS (SELECT instance_id, CASE WHEN ordinal % 10 = 0 THEN 'changed' ELSE category END AS category, CASE WHEN ordinal % 20 = 0 THEN 'q9' ELSE question_id END AS question_id, dataset FROM manifest WHERE ordinal % 29 <> 0)"


@query("manifest_drift", f"""{_M}, {_OLD}, j AS (SELECT coalesce(o.instance_id, n.instance_id) AS instance_id, n.instance_id IS NULL AS gone, o.instance_id IS NULL AS new, o.category IS DISTINCT FROM n.category AS c1, o.question_id IS DISTINCT FROM n.question_id AS c2, o.dataset AS ds FROM o FULL JOIN n ON n.instance_id = o.instance_id)
SELECT instance_id, CASE WHEN gone THEN 'removed' WHEN new THEN 'added' ELSE 'changed' END AS kind, CASE WHEN NOT gone AND NOT new THEN array_to_string(list_filter([CASE WHEN c1 THEN 'category' END, CASE WHEN c2 THEN 'question_id' END], lambda x: x IS NOT NULL), ',') END AS changed, NOT gone AND NOT new AND NOT c2 AS allowed FROM j WHERE gone OR new OR c1 OR c2""")  # fmt: skip
def manifest_drift(spark, sf):
    m = synth.manifest(spark, sf)
    old = m.where("ordinal % 31 <> 0")
    new = m.where("ordinal % 29 <> 0").withColumns({"category": F.when(F.col("ordinal") % 10 == 0, "changed").otherwise(F.col("category")), "question_id": F.when(F.col("ordinal") % 20 == 0, "q9").otherwise(F.col("question_id"))})
    done = coverage.drift(old, new, "instance_id", ["category", "question_id"], F.array(F.lit("category")))
    return done.select("instance_id", "kind", F.array_join("changed", ",").alias("changed"), "allowed")


@query("overlay_lookup", f"{_M}, d AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0) SELECT m.instance_id, d.n_name, CASE WHEN m.dataset = 'vsr' AND d.n_name IS NULL THEN 'missing' WHEN m.dataset <> 'vsr' AND d.n_name IS NOT NULL THEN 'unexpected' END AS problem FROM manifest m LEFT JOIN d ON d.n_nationkey = m.ordinal % 25")
def overlay_lookup(spark, sf):
    nation = synth.table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("nation"), "n_name")
    rows = synth.manifest(spark, sf).withColumn("nation", F.col("ordinal") % 25)
    return coverage.lookup(rows, nation, "nation", F.col("dataset") == "vsr").select("instance_id", "n_name", "problem")


@query("overlay_unused", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0)")
def overlay_unused(spark, sf):
    orders = synth.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"))
    return coverage.unused(synth.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), orders, "k")


@query("severity_grid_missing", f"WITH {synth.SQL_GRID} SELECT instance_id, model_id, count(*) FILTER (NOT valid) AS missing FROM grid GROUP BY ALL HAVING count(*) FILTER (NOT valid) > 0")
def severity_grid_missing(spark, sf):
    g = synth.severity_grid(spark, sf)
    cells = [(p, s) for p, own in synth.SEVERITIES.items() for s in own]
    return coverage.missing_grid(synth.clean(spark, sf), g.where("valid"), KEYS, cells, ("probe", "severity"))


@query("duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return quality.duplicates(synth.table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("cross_file_dups", "SELECT c_nationkey, min(c_mktsegment) AS first, count(DISTINCT c_mktsegment) AS sources FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1")
def cross_file_dups(spark, sf):
    return quality.duplicate_sources(synth.table(spark, sf, "customer"), "c_mktsegment", "c_nationkey")


@query("later_duplicates", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn > 1")
def later_duplicates(spark, sf):
    return quality.later_duplicates(synth.table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id").select("event_id")


_R = f"""{_O} SELECT rule, violations FROM (SELECT count(*) FILTER (WHERE NOT coalesce(split IN ('train', 'val'), false)) AS a, count(*) FILTER (WHERE NOT coalesce(probe IN ('blank', 'blur', 'crop', 'brightness', 'noise', 'grounding', 'relation'), false)) AS b, count(*) FILTER (WHERE NOT coalesce(probe <> 'relation' OR relation_applicable, false)) AS c,
  count(*) FILTER (WHERE NOT coalesce(isfinite(conf_shift), false)) AS d, count(*) FILTER (WHERE NOT coalesce(isfinite(entropy_shift), false)) AS e, count(*) FILTER (WHERE NOT coalesce(isfinite(margin_shift), false)) AS f, count(*) FILTER (WHERE NOT coalesce(semantic_match IN (0, 1), false)) AS g, count(*) FILTER (WHERE NOT coalesce(valid, false)) AS h FROM obs) AS s,
LATERAL (VALUES ('split is not allowed', s.a), ('unknown probe', s.b), ('relation probe without relation', s.c), ('conf_shift is not finite', s.d), ('entropy_shift is not finite', s.e), ('margin_shift is not finite', s.f), ('semantic_match is not 0 or 1', s.g), ('invalid observation', s.h)) AS v(rule, violations)"""


@query("schema_rule_counts", _R)
def schema_rule_counts(spark, sf):
    return quality.rule_counts(synth.observations(spark, sf), quality.observation_rules())


@query("row_errors", f"""{_M}, e AS (SELECT instance_id, list_filter([CASE WHEN split NOT IN ('train', 'val', 'cal', 'test') THEN 'unknown split' END, CASE WHEN NOT regexp_matches(group_id, '^sha256:[0-9a-f]{{16}}$') THEN 'group_id has no digest' END], lambda x: x IS NOT NULL) AS errors
  FROM (SELECT instance_id, CASE WHEN ordinal % 13 = 0 THEN 'dev' ELSE split END AS split, CASE WHEN ordinal % 7 = 0 THEN substr(group_id, 1, 12) ELSE group_id END AS group_id FROM manifest)) SELECT instance_id, array_to_string(errors, '; ') AS errors FROM e WHERE len(errors) > 0""")  # fmt: skip
def row_errors(spark, sf):
    m = synth.manifest(spark, sf)
    bad = m.withColumns({"split": F.when(F.col("ordinal") % 13 == 0, "dev").otherwise(F.col("split")), "group_id": F.when(F.col("ordinal") % 7 == 0, F.substring("group_id", 1, 12)).otherwise(F.col("group_id"))})
    found = quality.with_errors(bad, quality.manifest_rules())
    return found.where(F.size("errors") > 0).select("instance_id", F.array_join("errors", "; ").alias("errors"))


@query("label_recompute", f"{_L} SELECT instance_id, model_id, CASE WHEN label6 <> 'mixed' AND hash_bad THEN 'label6' END AS differ FROM (SELECT *, ('0x' || substr(sha256(instance_id || '|' || model_id), 1, 8))::UBIGINT % 20 = 0 AS hash_bad FROM labelled) WHERE label6 <> 'mixed' AND hash_bad")
def label_recompute(spark, sf):
    from plumbline.functions import hashing as h

    fresh = labelled(spark, sf)
    bad = F.conv(F.substring(h.sha256_hex(h.joined("instance_id", "model_id")), 1, 8), 16, 10).cast("long") % 20 == 0
    stored = fresh.withColumn("label6", F.when(bad, "mixed").otherwise(F.col("label6")))
    done = quality.recomputed(stored, fresh, KEYS, ["bit_v", "bit_l", "bit_a", "label6"], ["sig_v", "sig_l", "sig_a"])
    return done.select(*KEYS, F.array_join("differ", ",").alias("differ"))


@query("split_safety", f"{_C} SELECT instance_id, model_id, split IN ('train', 'val') AS readable, CASE WHEN split NOT IN ('train', 'val') THEN 'split is not allowed' ELSE '' END AS error FROM clean")
def split_safety(spark, sf):
    rows = quality.with_errors(synth.clean(spark, sf), [quality.split_rule(("train", "val"))])
    return rows.select(*KEYS, (F.size("errors") == 0).alias("readable"), F.array_join("errors", "; ").alias("error"))


@query("ledger_upsert", f"""{_C}, old AS (SELECT instance_id, model_id, 'old' AS error, 2 AS attempts FROM clean WHERE ordinal % 4 = 0), fail AS (SELECT instance_id, model_id, 'new' AS error FROM clean WHERE ordinal % 6 = 0), ok AS (SELECT instance_id, model_id FROM clean WHERE ordinal % 5 = 0)
SELECT coalesce(o.instance_id, f.instance_id) AS instance_id, coalesce(o.model_id, f.model_id) AS model_id, coalesce(f.error, o.error) AS error, CAST(coalesce(o.attempts, 0) + CASE WHEN f.error IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS attempts
FROM old o FULL JOIN fail f ON f.instance_id = o.instance_id AND f.model_id = o.model_id WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.instance_id = coalesce(o.instance_id, f.instance_id) AND ok.model_id = coalesce(o.model_id, f.model_id))""")  # fmt: skip
def ledger_upsert(spark, sf):
    c = synth.clean(spark, sf)
    old = c.where("ordinal % 4 = 0").select(*KEYS, F.lit("old").alias("error"), F.lit(2).alias("attempts"))
    return ledger.upsert_failures(old, c.where("ordinal % 6 = 0").select(*KEYS, F.lit("new").alias("error")), c.where("ordinal % 5 = 0"), KEYS)


@query("migration_changes", f"{_O} SELECT count(*) AS n, count(*) FILTER (WHERE valid AND semantic_match = 0 AND flip) AS flip_changed, count(*) FILTER (WHERE ordinal % 9 = 0 AND split <> 'test') AS split_changed FROM obs")
def migration_changes(spark, sf):
    o = synth.observations(spark, sf)
    new = o.withColumns({"flip": F.when(F.col("valid") & (F.col("semantic_match") == 0), F.lit(False)).otherwise(F.col("flip")), "split": F.when(F.col("ordinal") % 9 == 0, "test").otherwise(F.col("split"))})
    return ledger.changes(o, new, [*KEYS, "probe"], ["flip", "split"])


@query("migrate_rows", f"{_C} SELECT instance_id, model_id, 'kept' AS state FROM clean WHERE ordinal % 14 <> 0 UNION ALL SELECT instance_id, model_id, 'pending' FROM clean WHERE ordinal % 14 = 0")
def migrate_rows(spark, sf):
    c = synth.clean(spark, sf)
    kept, todo = ledger.migrate(c.select(*KEYS), c.where("ordinal % 14 = 0"), KEYS, "v1")
    return kept.select(*KEYS, F.lit("kept").alias("state")).unionByName(todo.withColumn("state", F.lit("pending")))


@query("replace_probe_entry", f"{_O} SELECT instance_id, model_id, round(sum(CASE WHEN probe = 'grounding' THEN 1.0::DOUBLE ELSE conf_shift END), 9) AS total, count(*) AS n FROM obs GROUP BY instance_id, model_id")
def replace_probe_entry(spark, sf):
    o = synth.observations(spark, sf).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("probe", "conf_shift"))).alias("m"))
    new = o.withColumn("m", ledger.replace_entry(F.col("m"), "grounding", F.lit(1.0)))
    total = F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x)
    return new.select(*KEYS, F.round(total, 9).alias("total"), F.size("m").cast("long").alias("n"))


@query("union_sources", "SELECT 'c' AS kind, c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT 's', s_suppkey, NULL, s_acctbal FROM supplier")
def union_sources(spark, sf):
    c = synth.table(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    s = synth.table(spark, sf, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return coverage.union_all(c, s)


@query("keys_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def keys_except(spark, sf):
    return coverage.only_left(synth.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), synth.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("keys_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def keys_intersect(spark, sf):
    return coverage.overlap(synth.table(spark, sf, "documents"), synth.table(spark, sf, "labels"), ["doc_id"])


@query("distinct_values", "SELECT array_to_string(list_sort(list(DISTINCT dataset)), ',') AS datasets, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(DISTINCT instance_id) AS instances, count(*) AS n FROM (" + f"{_C} SELECT dataset, split, instance_id FROM clean)")
def distinct_values(spark, sf):
    done = audits.inventory(synth.clean(spark, sf), {"datasets": "dataset", "splits": "split"}, "instance_id", "instances")
    return done.withColumns({c: F.array_join(c, ",") for c in ("datasets", "splits")})


@query("source_ordinals", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS ordinal, turn, role FROM conversations")
def source_ordinals(spark, sf):
    return sampling.ordinals(synth.table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"])
