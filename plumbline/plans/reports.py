"""Queries for reports: distributions, confounds, severities, calibration, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scores
from plumbline.operators import audits, sampling
from plumbline.operators.labels import LABELS
from plumbline.plans import synth
from plumbline.plans.evidence import _C, _L, _M, _O, KEYS, labelled
from plumbline.plans.registry import query

SLICES = ["dataset", "model_id"]
_G = f"WITH {synth.SQL_GRID}"
_LABELS = "(VALUES " + ", ".join(f"('{x}')" for x in LABELS) + ") AS v(label6)"
_DENSE = f"""{_L}, tot AS (SELECT dataset, model_id, count(*) AS total FROM labelled WHERE split IN ('train', 'val') GROUP BY ALL), cnt AS (SELECT dataset, model_id, label6, count(*) AS n FROM labelled WHERE split IN ('train', 'val') GROUP BY ALL),
dense AS (SELECT tot.dataset, tot.model_id, v.label6, coalesce(n, 0) AS count, coalesce(n, 0)::DOUBLE / total AS fraction FROM tot CROSS JOIN {_LABELS} LEFT JOIN cnt ON cnt.dataset = tot.dataset AND cnt.model_id = tot.model_id AND cnt.label6 = v.label6)"""
_BITS = f"""{_L}, bits AS (SELECT dataset, model_id, bit, count(*) FILTER (WHERE x) AS positive, count(*) - count(*) FILTER (WHERE x) AS negative, count(*) FILTER (WHERE x)::DOUBLE / count(*) AS fraction FROM (
  SELECT dataset, model_id, 'visual' AS bit, bit_v AS x FROM labelled WHERE split IN ('train', 'val') UNION ALL SELECT dataset, model_id, 'language', bit_l FROM labelled WHERE split IN ('train', 'val') UNION ALL SELECT dataset, model_id, 'alignment', bit_a FROM labelled WHERE split IN ('train', 'val')) GROUP BY ALL)"""
_STATS = f"""{_G}, stats AS (SELECT probe, severity, count(*) AS n, count(*) FILTER (WHERE valid) AS n_valid, coalesce(avg(CAST(flip AS INTEGER)) FILTER (valid), 0) AS flip_rate, coalesce(avg(abs(conf_shift)) FILTER (valid), 0) AS mean_shift,
  count(*) FILTER (WHERE valid AND abs(conf_shift) > 0.9::DOUBLE)::DOUBLE / greatest(count(*) FILTER (WHERE valid), 1) AS saturation, count(*) FILTER (WHERE NOT valid)::DOUBLE / greatest(count(*), 1) AS invalid_rate, avg(probe_ms) FILTER (valid) AS mean_ms FROM grid GROUP BY probe, severity)"""


def dev(spark, sf):
    return labelled(spark, sf).where(F.col("split").isin("train", "val"))


@query("label_distribution_dense", f"{_DENSE} SELECT dataset, model_id, label6, count, round(fraction, 9) AS fraction FROM dense")
def label_distribution_dense(spark, sf):
    return audits.dense_labels(dev(spark, sf), SLICES).withColumn("fraction", F.round("fraction", 9))


@query("bit_distribution_dense", f"{_BITS} SELECT dataset, model_id, bit, positive, negative, round(fraction, 9) AS fraction FROM bits")
def bit_distribution_dense(spark, sf):
    return audits.dense_bits(dev(spark, sf), SLICES).withColumn("fraction", F.round("fraction", 9))


@query("dominant_class", f"{_DENSE} SELECT dataset, model_id, arg_min(label6, ROW(-fraction, label6)) AS label6, round(max(fraction), 9) AS fraction, max(fraction) > 0.5::DOUBLE AS too_common FROM dense GROUP BY dataset, model_id")
def dominant_class(spark, sf):
    return audits.dominant_class(dev(spark, sf), SLICES, 0.5).withColumn("fraction", F.round("fraction", 9))


@query("min_support", f"{_BITS} SELECT dataset, model_id, bit, least(positive, negative) AS support, least(positive, negative) < 5 AS too_few FROM bits")
def min_support(spark, sf):
    return audits.low_support(dev(spark, sf), SLICES)


_RATES = "count(*) AS n, round(avg(CAST(relation_applicable AS INTEGER)), 9) AS relation_rate, round(avg(CAST(bit_v AS INTEGER)), 9) AS visual_rate, round(avg(CAST(bit_l AS INTEGER)), 9) AS language_rate, round(avg(CAST(bit_a AS INTEGER)), 9) AS alignment_rate"


@query("confound_grouping_sets", f"{_L} SELECT dataset, model_id, CAST(grouping(dataset, model_id) AS BIGINT) AS grain, {_RATES} FROM labelled GROUP BY GROUPING SETS ((dataset), (model_id), ())")
def confound_grouping_sets(spark, sf):
    done = audits.confounds(labelled(spark, sf))
    return done.select("dataset", "model_id", "grain", "n", *[F.round(c, 9).alias(c) for c in done.columns if c.endswith("_rate")])


for _by in ("dataset", "model_id"):

    @query(f"label_share_by_{_by}", f"{_L} SELECT {_by}, label6, count(*) AS count, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY {_by}), 9) AS share FROM labelled GROUP BY {_by}, label6")
    def label_share(spark, sf, by=_by):
        return audits.label_shares(labelled(spark, sf), by).withColumn("share", F.round("share", 9))


_ROUNDED = "round(flip_rate, 9) AS flip_rate, round(mean_shift, 9) AS mean_shift"


@query("severity_stats", f"{_STATS} SELECT probe, severity, n, n_valid, {_ROUNDED}, round(saturation, 9) AS saturation, round(invalid_rate, 9) AS invalid_rate, round(mean_ms, 6) AS mean_ms FROM stats")
def severity_stats(spark, sf):
    s = audits.severity_stats(synth.severity_grid(spark, sf))
    return s.select("probe", "severity", "n", "n_valid", *[F.round(c, 9).alias(c) for c in ("flip_rate", "mean_shift", "saturation", "invalid_rate")], F.round("mean_ms", 6).alias("mean_ms"))


@query("severity_counts_by_slice", f"{_G} SELECT dataset, model_id, probe, severity, count(*) AS n, count(*) FILTER (valid) AS n_valid, count(DISTINCT instance_id) AS instances, count(*) = count(DISTINCT instance_id) AS each_once FROM grid GROUP BY dataset, model_id, probe, severity")
def severity_counts_by_slice(spark, sf):
    return audits.grid_counts(synth.severity_grid(spark, sf), ["dataset", "model_id"])


@query("severity_percentiles", f"""{_G}, r AS (SELECT probe, severity, probe_ms AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY probe, severity) AS n FROM grid WHERE valid AND probe_ms IS NOT NULL WINDOW w AS (PARTITION BY probe, severity ORDER BY probe_ms))
SELECT probe, severity, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS least, max(x) AS most, max(x) FILTER (i = floor(0.25::DOUBLE * (n - 1)) + 1) AS p25, max(x) FILTER (i = floor(0.5::DOUBLE * (n - 1)) + 1) AS p50, max(x) FILTER (i = floor(0.75::DOUBLE * (n - 1)) + 1) AS p75, max(x) FILTER (i = floor(0.95::DOUBLE * (n - 1)) + 1) AS p95 FROM r GROUP BY probe, severity""")  # fmt: skip
def severity_percentiles(spark, sf):
    done = audits.order_statistics(synth.severity_grid(spark, sf).where("valid"), "probe_ms", ["probe", "severity"])
    return done.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("probe_first_severity", f"{_STATS} SELECT probe, arg_min(severity, severity) AS severity, round(arg_min(flip_rate, severity), 9) AS flip_rate, round(abs(arg_min(mean_shift, severity)), 9) AS mean_abs_shift FROM stats GROUP BY probe")
def probe_first_severity(spark, sf):
    done = audits.first_severity(audits.severity_stats(synth.severity_grid(spark, sf)))
    return done.withColumns({c: F.round(c, 9) for c in ("flip_rate", "mean_abs_shift")})


_FALL = [("blur", 8.0), ("crop", 0.65), ("brightness", 0.35), ("noise", 25.0), ("fog", 1.0)]


@query("severity_select", f"""{_STATS}, ok AS (SELECT * FROM stats WHERE invalid_rate <= 0.05::DOUBLE AND saturation <= 0.15::DOUBLE),
best AS (SELECT probe, severity AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY NOT (flip_rate BETWEEN 0.15::DOUBLE AND 0.4::DOUBLE), abs(flip_rate - 0.25::DOUBLE), severity) AS rn FROM ok) WHERE rn = 1)
SELECT f.probe, coalesce(chosen, f.severity) AS severity, chosen IS NULL AS by_default FROM (VALUES {", ".join(f"('{p}', {s}::DOUBLE)" for p, s in _FALL)}) AS f(probe, severity) LEFT JOIN best ON best.probe = f.probe""")  # fmt: skip
def severity_select(spark, sf):
    fallback = spark.createDataFrame(_FALL, "probe string, severity double")
    return audits.choose_severity(audits.severity_stats(synth.severity_grid(spark, sf)), fallback)


@query("run_estimates", f"""{_O}, ms AS (SELECT probe_ms AS x FROM obs WHERE applicable UNION ALL SELECT latency_ms FROM clean), p AS (SELECT avg(x) / 1000 AS s FROM ms),
c AS (SELECT CAST(count(*) * 7 + count(*) FILTER (WHERE relation_applicable) AS BIGINT) AS passes, count(*) AS n, count(DISTINCT model_id) AS k FROM clean)
SELECT round(s, 9) AS pass_s, round(passes::DOUBLE / n, 9) AS passes_per_row, round(passes::DOUBLE / k * 3, 6) AS planned_passes, round(passes::DOUBLE / k * 3 * s / 3600, 6) AS hours FROM p, c""")  # fmt: skip
def run_estimates(spark, sf):
    done = audits.run_estimates(synth.observations(spark, sf), synth.clean(spark, sf), 3)
    return done.select(F.round("pass_s", 9).alias("pass_s"), F.round("passes_per_row", 9).alias("passes_per_row"), F.round("planned_passes", 6).alias("planned_passes"), F.round("hours", 6).alias("hours"))


@query("majority_vote", """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS pos FROM events GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, pos) AS rn, max(n) OVER (PARTITION BY user_id) AS top FROM c)
SELECT user_id, max(event_type) FILTER (rn = 1) AS winner, max(top) AS n, count(*) FILTER (WHERE n = top) AS tied FROM b GROUP BY user_id""")  # fmt: skip
def majority_vote(spark, sf):
    return audits.majority(synth.table(spark, sf, "events"), "user_id", "event_type", "event_id")


#: Vectors are compared with the next ones by id, so pairs grow with the vectors.
NEIGHBOURS = 8


def scored_pairs(spark, sf):
    """Norms are taken once for each vector, not for each pair."""
    table = synth.table(spark, sf, "embeddings")
    dims = scores.common_length(table.where("embedding is not null"), "embedding")
    v = table.select("vec_id", F.col("embedding").alias("e"), "label")
    v = v.withColumn("size", F.sqrt(scores.dot(F.col("e"), F.col("e"), dims)))
    near = v.withColumn("other", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + NEIGHBOURS)))
    pairs = near.join(v.select(F.col("vec_id").alias("other"), F.col("e").alias("e2"), F.col("size").alias("s2"), F.col("label").alias("l2")), "other")
    return pairs.select("vec_id", "other", scores.cosine(F.col("e"), F.col("e2"), F.col("size") * F.col("s2"), dims).alias("similarity"), (F.col("label") == F.col("l2")).alias("match"))


_PAIRS = f"""WITH pairs AS (SELECT a.vec_id, b.vec_id AS other, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS similarity, a.label = b.label AS match
  FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + {NEIGHBOURS})"""
_TAUS = tuple(i / 100 for i in range(-20, 60, 4))
_CAL = f"""{_PAIRS}, t AS (SELECT * FROM (VALUES {", ".join(f"({t}::DOUBLE)" for t in _TAUS)}) AS v(tau)),
s AS (SELECT tau, count(*) FILTER (WHERE similarity >= tau AND match) AS tp, count(*) FILTER (WHERE similarity >= tau AND NOT match) AS fp, count(*) FILTER (WHERE similarity < tau AND match) AS fn FROM pairs, t GROUP BY tau),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall FROM s),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM q)"""
_CALCOLS = "tau, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"


def _calibration(df):
    return df.select("tau", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("threshold_table", f"{_CAL} SELECT {_CALCOLS} FROM f")
def threshold_table(spark, sf):
    return _calibration(audits.threshold_table(scored_pairs(spark, sf), _TAUS))


@query("calibrate_threshold", f"{_CAL} SELECT {_CALCOLS} FROM f WHERE recall >= 0.6::DOUBLE ORDER BY f.f1 DESC, tau LIMIT 1")
def calibrate_threshold(spark, sf):
    return _calibration(audits.calibrate(scored_pairs(spark, sf), 0.6, _TAUS))


@query("cosine_match", f"{_PAIRS} SELECT vec_id, other, round(similarity, 9) AS similarity, CAST(similarity >= 0.3::DOUBLE AS INTEGER) AS matched FROM pairs")
def cosine_match(spark, sf):
    return scored_pairs(spark, sf).select("vec_id", "other", F.round("similarity", 9).alias("similarity"), (F.col("similarity") >= 0.3).cast("int").alias("matched"))


@query("progress_by_model", f"{_C}, w AS (SELECT * FROM (VALUES ('model_a'), ('model_b'), ('model_c')) AS v(model_id)) SELECT w.model_id, count(DISTINCT c.instance_id) AS done, round(count(DISTINCT c.instance_id)::DOUBLE / 1000, 9) AS share FROM w LEFT JOIN clean c ON c.model_id = w.model_id AND c.clean_valid GROUP BY w.model_id")
def progress_by_model(spark, sf):
    return audits.progress(synth.clean(spark, sf), 1000, ("model_a", "model_b", "model_c")).withColumn("share", F.round("share", 9))


@query("progress_by_split", f"{_C}, w AS (SELECT * FROM (VALUES ('model_a'), ('model_b'), ('model_c')) AS v(model_id)) SELECT w.model_id, c.split, count(DISTINCT c.instance_id) AS done FROM w LEFT JOIN clean c ON c.model_id = w.model_id AND c.clean_valid GROUP BY w.model_id, c.split")
def progress_by_split(spark, sf):
    return audits.progress(synth.clean(spark, sf), 1000, ("model_a", "model_b", "model_c"), ("split",)).drop("share")


@query("readiness_counts", f"{_M} SELECT dataset, count(*) AS n, count(*) FILTER (WHERE relation_applicable) AS relation_rows, CAST(2 * (7 * count(*) + count(*) FILTER (WHERE relation_applicable)) AS BIGINT) AS passes FROM manifest GROUP BY dataset")
def readiness_counts(spark, sf):
    return audits.readiness(synth.manifest(spark, sf), ["dataset"], len(synth.MODELS))


@query("completeness", f"{_C} SELECT model_id, dataset, count(DISTINCT instance_id) FILTER (clean_valid) AS done, count(DISTINCT instance_id) FILTER (clean_valid) >= 100 AS complete FROM clean GROUP BY ALL")
def completeness(spark, sf):
    return audits.completeness(synth.clean(spark, sf), ["model_id", "dataset"], 100)


_PC = f"""{_G}, a AS (SELECT model_id, dataset, count(DISTINCT instance_id) AS n FROM clean WHERE clean_valid GROUP BY ALL), b AS (SELECT model_id, dataset, count(DISTINCT ROW(instance_id, probe, severity)) AS k FROM grid WHERE valid GROUP BY ALL),
pc AS (SELECT a.model_id, count(*) FILTER (n >= 100 AND k >= 1200 AND (a.model_id = 'model_a' OR a.dataset <> 'vsr')) AS n_complete FROM a JOIN b ON a.model_id = b.model_id AND a.dataset = b.dataset GROUP BY a.model_id)"""


def _pilot_completeness(spark, sf):
    c, g = synth.clean(spark, sf).where("clean_valid"), synth.severity_grid(spark, sf).where("valid")
    return audits.pilot_completeness(c, g.where("model_id = 'model_a' or dataset <> 'vsr'"), synth.DATASETS)


@query("pilot_completeness", f"{_PC} SELECT model_id, n_complete, n_complete = 4 AS complete FROM pc")
def pilot_completeness(spark, sf):
    """The second model has no severities of one dataset."""
    return _pilot_completeness(spark, sf)


@query("enough_models", f"{_PC} SELECT count(*) FILTER (n_complete = 4) AS n_models, count(*) FILTER (n_complete = 4) >= 2 AS enough FROM pc")
def enough_models(spark, sf):
    return audits.enough_models(_pilot_completeness(spark, sf))


@query("required_coverage", f"{_C} SELECT model_id, array_to_string(list_sort(list_filter(['pope', 'vqa', 'vsr'], lambda x: NOT list_contains(list(DISTINCT dataset), x))), ',') AS lacking FROM clean GROUP BY model_id")
def required_coverage(spark, sf):
    wanted = F.array(*map(F.lit, ("pope", "vqa", "vsr")))
    return synth.clean(spark, sf).groupBy("model_id").agg(F.array_join(F.array_sort(F.array_except(wanted, F.collect_set("dataset"))), ",").alias("lacking"))


@query("control_gap", "SELECT l_returnflag, round(avg(l_quantity), 6) AS full_score, round(avg(l_quantity) - avg(l_tax) * 10, 6) AS gap, avg(l_tax) * 10 <= 2.0::DOUBLE AS fires FROM lineitem GROUP BY l_returnflag")
def control_gap(spark, sf):
    rows = synth.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("full"), F.avg("l_tax").alias("tax"))
    return rows.select("l_returnflag", F.round("full", 6).alias("full_score"), F.round(F.col("full") - F.col("tax") * 10, 6).alias("gap"), audits.gap_fires(F.col("full"), F.col("full") - F.col("tax") * 10).alias("fires"))


@query("deterministic_limit", f"{_M} SELECT instance_id FROM manifest ORDER BY sha256('42|' || instance_id) LIMIT 100")
def deterministic_limit(spark, sf):
    return sampling.hash_limit(synth.manifest(spark, sf), 100, 42, "instance_id").select("instance_id")


@query("natural_sample", f"{_L} SELECT model_id, instance_id, label6 FROM labelled WHERE split IN ('train', 'val') ORDER BY sha256('42|natural|' || model_id || '|' || instance_id) LIMIT 60")
def natural_sample(spark, sf):
    rows = dev(spark, sf).withColumn("space", F.lit("natural"))
    return sampling.hash_limit(rows, 60, 42, "space", "model_id", "instance_id").select("model_id", "instance_id", "label6")


@query("even_score_sample", f"{_PAIRS}, r AS (SELECT *, row_number() OVER (ORDER BY round(similarity, 9), vec_id, other) - 1 AS i, count(*) OVER () AS n FROM pairs) SELECT vec_id, other, round(similarity, 9) AS similarity FROM r WHERE i IN (SELECT round_even(k * (n - 1)::DOUBLE / 24, 0) FROM range(0, 25) AS t(k))")
def even_score_sample(spark, sf):
    rows = scored_pairs(spark, sf).select("vec_id", "other", F.round("similarity", 9).alias("similarity"))
    return sampling.even_sample(rows, ["similarity", "vec_id", "other"], 25)


@query("borderline_score", f"{_L} SELECT instance_id, model_id, round(least(abs(v - 0.15::DOUBLE), abs(l - 0.8::DOUBLE), abs(a - 0.15::DOUBLE)), 9) AS near FROM labelled")
def borderline_score(spark, sf):
    return labelled(spark, sf).select(*KEYS, F.round(sampling.borderline(F.col("sig_v"), F.col("sig_l"), F.col("sig_a")), 9).alias("near"))


@query("stratified_sample", f"""{_M}, r AS (SELECT instance_id, split, category, sha256('42|' || instance_id) AS k, row_number() OVER (PARTITION BY split, category ORDER BY sha256('42|' || instance_id)) AS turn FROM manifest)
SELECT instance_id, split, category FROM r ORDER BY turn, split, category, k LIMIT 100""")  # fmt: skip
def stratified_sample(spark, sf):
    return sampling.stratified(synth.manifest(spark, sf), ["split", "category"], 100, 42, "instance_id").select("instance_id", "split", "category")


@query("audit_greedy")
def audit_greedy(spark, sf):
    chosen = sampling.audit_keys(dev(spark, sf), 60, 20, 10, 42, LABELS)
    return spark.createDataFrame([(f"audit_{i:04d}", *row) for i, row in enumerate(chosen, 1)], "audit_id string, model_id string, instance_id string, provenance string")
