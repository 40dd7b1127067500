"""Queries on moving a shard to a new answer contract: a fifth of the rows hold stale answers, some golds change, some questions turn out to be open."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import migration, records
from plumbline.plans import synth
from plumbline.plans.evidence import KEYS
from plumbline.plans.nested import nested
from plumbline.plans.registry import query
from plumbline.sources.staging import checkpointed

SOURCE = migration.Source("teacher.jsonl", "f" * 64, "old", "new")


def shard(spark, sf):
    """Valid records, ledger, new manifest and selection."""
    n = F.col("ordinal")
    rows = nested(spark, sf, healthy=False)
    stale = n % 5 == 0
    probes = F.transform_values("probes", lambda k, v: v.withField("norm_answer", F.when(stale, "old").otherwise(v["norm_answer"])))
    clean = F.col("clean").withField("norm_answer", F.when(stale, "old").otherwise(F.col("clean.norm_answer"))).withField("correct", F.when(stale, 0).otherwise(F.col("clean.correct")))
    rows = rows.withColumns({"probes": probes, "clean": clean, "swap_invariance": F.lit(None).cast("boolean"), "source_manifest_sha256": F.lit("old")})
    rows = checkpointed(rows)  # as a shard is: a file
    failed = records.failure_rows(rows.where("not clean.valid"), F.lit("invalid_clean"), F.lit("the clean pass is invalid"), F.lit(1)).withColumn("source_manifest_sha256", F.lit("old"))
    gold = F.when((n % 2 == 0) == (n % 7 != 3), "yes").otherwise("no")
    m = synth.manifest(spark, sf).withColumns({"gold_answer": gold, "answer_type": F.when((F.col("dataset") == "hallusionbench") & (n % 12 == 0), "open_ended").when(F.col("dataset") == "hallusionbench", "binary")})
    return rows.where("clean.valid"), failed, m, rows.select("model_id", "instance_id")


def moved(spark, sf):
    return migration.migrate_shard(*shard(spark, sf), SOURCE, tx.normalise).checked()


_MOVED = f"""WITH {synth.SQL_OBS}, k AS (SELECT *, dataset = 'vizwiz' AS viz, dataset IN ('vizwiz', 'hallusionbench') AS touched, dataset = 'hallusionbench' AND ordinal % 12 = 0 AS is_open, ordinal % 5 = 0 AS stale, CAST(ordinal % 7 <> 3 AS INTEGER) AS new_correct FROM clean),
o2 AS (SELECT o.* EXCLUDE (flip, semantic_match, clean_correct), o.flip AS was_flip, o.semantic_match AS was_sem, k.touched, k.viz, k.stale, k.new_correct = 1 AS clean_correct, (CASE WHEN o.flip THEN 'no' ELSE 'yes' END) <> (CASE WHEN o.ordinal % 2 = 0 THEN 'yes' ELSE 'no' END) AS flip FROM obs o JOIN k USING (instance_id, model_id)),
obs2 AS (SELECT *, CASE WHEN NOT flip THEN 1 WHEN viz THEN CASE WHEN stale THEN 0 ELSE was_sem END ELSE 0 END AS semantic_match FROM o2)"""


@query("migration_report", f"""{_MOVED}, p AS (SELECT instance_id, model_id, bool_or(valid AND (stale OR flip <> was_flip OR semantic_match <> was_sem)) AS changed FROM obs2 GROUP BY ALL),
r AS (SELECT k.*, CASE WHEN stale THEN 0 ELSE CAST(clean_correct AS INTEGER) END <> new_correct AND touched AS correct_changed, p.changed AND touched AS probes_changed FROM k JOIN p USING (instance_id, model_id))
SELECT count(*) FILTER (clean_valid AND NOT is_open) AS valid, count(*) FILTER (clean_valid AND NOT is_open AND correct_changed AND NOT viz) AS binary_correctness_changes, count(*) FILTER (clean_valid AND NOT is_open AND probes_changed AND NOT viz) AS binary_probe_changes,
  count(*) FILTER (clean_valid AND correct_changed AND viz) AS vizwiz_correctness_changes, count(*) FILTER (clean_valid AND probes_changed AND viz) AS vizwiz_probe_changes, count(*) AS selected, count(*) FILTER (NOT clean_valid AND NOT is_open) AS failures, count(*) FILTER (is_open) AS dropped, count(*) FILTER (NOT clean_valid OR is_open) AS pending FROM r""")  # fmt: skip
def migration_report(spark, sf):
    return moved(spark, sf).report


@query("migration_pending", f"{_MOVED} SELECT model_id, instance_id FROM k WHERE NOT clean_valid OR is_open")
def migration_pending(spark, sf):
    return moved(spark, sf).pending


@query("migrated_labels", f"""{_MOVED}{synth.SQL_LABELS.removeprefix(synth.SQL_OBS).replace("FROM obs GROUP BY", "FROM obs2 GROUP BY")}, f AS (SELECT instance_id, model_id, count(*) FILTER (valid AND flip) AS n_flips FROM obs2 GROUP BY ALL)
SELECT l.model_id, l.instance_id, k.new_correct AS correct, CASE WHEN k.ordinal % 2 = 0 THEN 'yes' ELSE 'no' END AS norm_answer, l.label6, round(l.v, 9) AS sig_v, round(l.l, 9) AS sig_l, round(l.a, 9) AS sig_a, f.n_flips, 'new' AS manifest, 'teacher.jsonl' AS source_path
FROM labelled l JOIN k USING (instance_id, model_id) JOIN f USING (instance_id, model_id) WHERE k.touched AND NOT is_open AND clean_valid""")  # fmt: skip
def migrated_labels(spark, sf):
    flips = F.size(F.filter(F.map_values("probes"), lambda v: v["valid"] & v["flip"])).cast("long")
    sig = [F.round(f"teacher_signature.{x}", 9).alias(f"sig_{x.lower()}") for x in "VLA"]
    done = moved(spark, sf).valid.where(F.col("dataset").isin("vizwiz", "hallusionbench"))
    return done.select(*KEYS, F.col("clean.correct").alias("correct"), F.col("clean.norm_answer").alias("norm_answer"), F.col("teacher_label6").alias("label6"), *sig, flips.alias("n_flips"), F.col("source_manifest_sha256").alias("manifest"), "answer_contract_migration.source_path")
