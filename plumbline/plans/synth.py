"""A manifest and probe observations made from the customer table by keyed hashes, in Spark and as SQL text.

One customer is one instance. Every number comes from a sha256 of its key, so both engines agree bit by bit and the
tables grow with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import assign_split, group_id, joined, unit
from plumbline.operators.labels import CORE_PROBES, PROBES

DATASETS = ("hallusionbench", "pope", "vizwiz", "vsr")
MODELS = ("model_a", "model_b")
SEVERITIES = {"blur": (4.0, 8.0, 16.0), "crop": (0.85, 0.65, 0.45), "brightness": (0.6, 0.35, 0.15), "noise": (10.0, 25.0, 50.0)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    dataset = F.element_at(F.array(*map(F.lit, DATASETS)), (n % 4 + 1).cast("int"))
    image, question = F.concat(F.lit("img"), F.floor(n / 3).cast("string")), F.concat(F.lit("q"), (n % 2).cast("string"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    customers = customers.repartition(spark.sparkContext.defaultParallelism, "c_custkey")  # a row group is one task, and each row becomes many
    rows = customers.select(
        F.concat_ws("_", dataset, n.cast("string")).alias("instance_id"), group_id(dataset, image, question).alias("group_id"), dataset.alias("dataset"),
        image.alias("image_id"), question.alias("question_id"), ((dataset == "vsr") & (n % 3 == 0)).alias("relation_applicable"), F.col("c_mktsegment").alias("category"), n.alias("ordinal"),
    )
    return rows.withColumn("split", assign_split(F.col("group_id")))


def _u(*parts: str) -> Column:
    return unit(joined(*[F.lit(p[1:]) if p[0] == "=" else F.col(p) for p in parts]))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each instance and model: the answer without a probe."""
    rows = manifest(spark, sf_dir).withColumn("model_id", F.explode(F.array(*map(F.lit, MODELS))))
    key = ("instance_id", "model_id")
    return rows.withColumns({
        "answer_prob": 0.5 + 0.5 * _u(*key, "=prob"), "clean_correct": _u(*key, "=correct") < 0.6, "clean_valid": _u(*key, "=valid") < 0.98, "latency_ms": 400 + 300 * _u(*key, "=ms"),
        "swap_invariance": F.when(F.col("relation_applicable"), F.when(_u(*key, "=swap") < 0.4, True).when(_u(*key, "=swap") < 0.8, False)),
    })


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each instance, model and legal probe."""
    probes = F.when(F.col("relation_applicable"), F.array(*map(F.lit, PROBES))).otherwise(F.array(*map(F.lit, CORE_PROBES)))
    rows = clean(spark, sf_dir).withColumn("probe", F.explode(probes))
    key = ("instance_id", "model_id", "probe")
    return rows.withColumns({
        "flip": _u(*key, "=flip") < 0.3, "conf_shift": _u(*key, "=conf") - 0.5, "entropy_shift": _u(*key, "=ent") - 0.5, "margin_shift": _u(*key, "=marg") - 0.5,
        "semantic_match": (_u(*key, "=sem") < 0.7).cast("int"), "valid": _u(*key, "=ok") < 0.98, "applicable": _u(*key, "=app") < 0.99, "probe_ms": 200 + 600 * _u(*key, "=pms"),
    })


def severity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each instance, model, image probe and severity; latency is null for some."""
    grid = F.array(*[F.struct(F.lit(p).alias("probe"), F.lit(s).alias("severity")) for p, own in SEVERITIES.items() for s in own])
    rows = clean(spark, sf_dir).withColumn("g", F.explode(grid)).select("instance_id", "model_id", "dataset", "split", "g.probe", "g.severity")
    key = ("instance_id", "model_id", "probe", "severity_key")
    rows = rows.withColumn("severity_key", (F.col("severity") * 100).cast("long").cast("string"))
    return rows.withColumns({
        "flip": _u(*key, "=flip") < 0.05 + F.col("severity") / 100, "conf_shift": 1.9 * (_u(*key, "=conf") - 0.5), "valid": _u(*key, "=ok") < 0.97,
        "probe_ms": F.when(_u(*key, "=has") < 0.95, 200 + 600 * _u(*key, "=pms")),
    }).drop("severity_key")


def _su(*parts: str) -> str:
    key = ", ".join(f"'{p[1:]}'" if p[0] == "=" else p for p in parts)
    return f"(('0x' || substr(sha256(concat_ws('|', {key})), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


_K1, _K2, _K3 = ("instance_id", "model_id"), ("instance_id", "model_id", "probe"), ("instance_id", "model_id", "probe", "CAST(CAST(severity * 100 AS BIGINT) AS VARCHAR)")
_AT = "(('0x' || substr(sha256('42|' || group_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"
SQL_MANIFEST = f"""m0 AS (SELECT c_custkey AS ordinal, c_mktsegment AS category, CASE c_custkey % 4 WHEN 0 THEN 'hallusionbench' WHEN 1 THEN 'pope' WHEN 2 THEN 'vizwiz' ELSE 'vsr' END AS dataset,
  'img' || CAST(c_custkey // 3 AS VARCHAR) AS image_id, 'q' || CAST(c_custkey % 2 AS VARCHAR) AS question_id FROM customer),
m1 AS (SELECT *, dataset || '_' || CAST(ordinal AS VARCHAR) AS instance_id, 'sha256:' || substr(sha256(concat_ws('|', dataset, image_id, question_id)), 1, 16) AS group_id, (dataset = 'vsr' AND ordinal % 3 = 0) AS relation_applicable FROM m0),
manifest AS (SELECT *, CASE WHEN {_AT} < 0.7::DOUBLE THEN 'train' WHEN {_AT} < 0.7999999999999999::DOUBLE THEN 'val' WHEN {_AT} < 0.8999999999999999::DOUBLE THEN 'cal' ELSE 'test' END AS split FROM m1)"""
SQL_CLEAN = f"""{SQL_MANIFEST},
c0 AS (SELECT manifest.*, model_id FROM manifest, (VALUES ('model_a'), ('model_b')) AS v(model_id)),
clean AS (SELECT *, 0.5::DOUBLE + 0.5::DOUBLE * {_su(*_K1, "=prob")} AS answer_prob, {_su(*_K1, "=correct")} < 0.6::DOUBLE AS clean_correct, {_su(*_K1, "=valid")} < 0.98::DOUBLE AS clean_valid, 400 + 300 * {_su(*_K1, "=ms")} AS latency_ms,
  CASE WHEN relation_applicable THEN CASE WHEN {_su(*_K1, "=swap")} < 0.4::DOUBLE THEN true WHEN {_su(*_K1, "=swap")} < 0.8::DOUBLE THEN false END END AS swap_invariance FROM c0)"""
SQL_OBS = f"""{SQL_CLEAN},
o0 AS (SELECT clean.*, probe FROM clean, (VALUES ('blank'), ('blur'), ('crop'), ('brightness'), ('noise'), ('grounding'), ('relation')) AS v(probe) WHERE relation_applicable OR probe <> 'relation'),
obs AS (SELECT *, {_su(*_K2, "=flip")} < 0.3::DOUBLE AS flip, {_su(*_K2, "=conf")} - 0.5::DOUBLE AS conf_shift, {_su(*_K2, "=ent")} - 0.5::DOUBLE AS entropy_shift, {_su(*_K2, "=marg")} - 0.5::DOUBLE AS margin_shift,
  CAST({_su(*_K2, "=sem")} < 0.7::DOUBLE AS INTEGER) AS semantic_match, {_su(*_K2, "=ok")} < 0.98::DOUBLE AS valid, {_su(*_K2, "=app")} < 0.99::DOUBLE AS applicable, 200 + 600 * {_su(*_K2, "=pms")} AS probe_ms FROM o0)"""
SQL_GRID = f"""{SQL_CLEAN},
g0 AS (SELECT instance_id, model_id, dataset, split, probe, severity FROM clean, (VALUES {", ".join(f"('{p}', {s}::DOUBLE)" for p, own in SEVERITIES.items() for s in own)}) AS v(probe, severity)),
grid AS (SELECT *, {_su(*_K3, "=flip")} < 0.05::DOUBLE + severity / 100 AS flip, 1.9::DOUBLE * ({_su(*_K3, "=conf")} - 0.5::DOUBLE) AS conf_shift, {_su(*_K3, "=ok")} < 0.97::DOUBLE AS valid,
  CASE WHEN {_su(*_K3, "=has")} < 0.95::DOUBLE THEN 200 + 600 * {_su(*_K3, "=pms")} END AS probe_ms FROM g0)"""
_VIS = [f"max(CASE WHEN probe = '{p}' AND valid AND applicable THEN {{}} END)" for p in ("blur", "crop", "brightness", "noise")]


def _vis(x: str) -> str:
    return " + ".join(f"coalesce({v.format(x)}, 0)" for v in _VIS)


SQL_LABELS = f"""{SQL_OBS},
l0 AS (SELECT instance_id, model_id, any_value(dataset) AS dataset, any_value(split) AS split, any_value(relation_applicable) AS relation_applicable, any_value(clean_correct) AS clean_correct, any_value(answer_prob) AS c, any_value(swap_invariance) AS inv,
  {_vis("1")} AS nv, {_vis("CAST(flip AS INTEGER)")} AS fv, {_vis("abs(conf_shift)")} AS sv,
  max(CASE WHEN probe = 'blank' AND valid THEN semantic_match END) AS bm, max(CASE WHEN probe = 'blank' AND valid THEN conf_shift END) AS bc,
  max(CASE WHEN probe = 'grounding' AND valid THEN CAST(flip AS INTEGER) END) AS gf, max(CASE WHEN probe = 'grounding' AND valid THEN abs(conf_shift) END) AS gc
  FROM obs GROUP BY instance_id, model_id),
l1 AS (SELECT *, CASE WHEN nv > 0 THEN sv / nv ELSE 0 END AS v, coalesce((c + bc) / (c + 1e-8::DOUBLE) * bm, 0) AS l,
  greatest(coalesce(gc, 0), CASE WHEN gf = 1 THEN 0.5::DOUBLE ELSE 0 END, CASE WHEN relation_applicable AND inv THEN 1.0::DOUBLE ELSE 0 END) AS a,
  nv > 0 AND (fv / greatest(nv, 1) >= 0.25::DOUBLE OR sv / greatest(nv, 1) >= 0.15::DOUBLE) AS bit_v, coalesce(bm = 1 AND (c + bc) / (c + 1e-8::DOUBLE) >= 0.8::DOUBLE, false) AS bit_l,
  coalesce(gf = 1 OR gc >= 0.15::DOUBLE, false) OR (relation_applicable AND coalesce(inv, false)) AS bit_a FROM l0),
labelled AS (SELECT *, CASE WHEN n = 0 AND clean_correct THEN 'no-failure' WHEN n >= 2 THEN 'mixed' WHEN bit_v THEN 'visual' WHEN bit_l THEN 'language-prior' WHEN bit_a THEN 'alignment' ELSE 'unclear' END AS label6
  FROM (SELECT *, CAST(bit_v AS INTEGER) + CAST(bit_l AS INTEGER) + CAST(bit_a AS INTEGER) AS n FROM l1))"""
