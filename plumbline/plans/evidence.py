"""Queries on manifests, splits, shards, labels and partial states."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import hashing as h
from plumbline.operators import coverage, digests, labels, sampling, states
from plumbline.plans import synth
from plumbline.plans.registry import query

KEYS, CARRIED = ["instance_id", "model_id"], ["dataset", "split", "relation_applicable", "clean_correct", "answer_prob", "swap_invariance"]
_L = f"WITH {synth.SQL_LABELS}"
_M, _C, _O = f"WITH {synth.SQL_MANIFEST}", f"WITH {synth.SQL_CLEAN}", f"WITH {synth.SQL_OBS}"


def labelled(spark, sf):
    return labels.label_rows(synth.observations(spark, sf), KEYS, CARRIED)


@query("split_assign", f"{_M} SELECT instance_id, group_id, split FROM manifest")
def split_assign(spark, sf):
    return synth.manifest(spark, sf).select("instance_id", "group_id", "split")


@query("split_stats", f"{_M} SELECT s.split, count(m.instance_id) AS n, count(DISTINCT m.group_id) AS groups FROM (VALUES ('train'), ('val'), ('cal'), ('test'), ('none')) AS s(split) LEFT JOIN manifest m ON m.split = s.split GROUP BY s.split")
def split_stats(spark, sf):
    return coverage.split_stats(synth.manifest(spark, sf), ("train", "val", "cal", "test", "none"))


@query("group_overlap", f"{_M}, bad AS (SELECT image_id, CASE WHEN ordinal % 5 = 0 THEN 'test' ELSE split END AS split FROM manifest) SELECT image_id, count(DISTINCT split) AS splits FROM bad GROUP BY image_id HAVING count(DISTINCT split) > 1")
def group_overlap(spark, sf):
    """Images with questions in several splits: every fifth row is put into the test split."""
    rows = synth.manifest(spark, sf).withColumn("split", F.when(F.col("ordinal") % 5 == 0, "test").otherwise(F.col("split")))
    return coverage.group_overlap(rows, "image_id")


@query("shard_assign", f"{_C} SELECT instance_id, model_id, CAST(('0x' || substr(sha256(model_id || '|' || instance_id), 1, 16))::UBIGINT % 7 AS INTEGER) AS shard FROM clean")
def shard_assign(spark, sf):
    return synth.clean(spark, sf).select(*KEYS, h.shard_of(F.col("instance_id"), F.col("model_id"), 7).alias("shard"))


@query("ordinal_shard", f"{_M}, r AS (SELECT instance_id, row_number() OVER (ORDER BY instance_id) - 1 AS i FROM manifest) SELECT i AS rank, instance_id FROM r WHERE i % 4 = 1")
def ordinal_shard(spark, sf):
    """Every fourth row in the order of the ids, from the second on."""
    return sampling.ordinal_shard(synth.manifest(spark, sf).select("instance_id"), ["instance_id"], 1, 4)


@query("derived_seeds", f"{_O} SELECT instance_id, model_id, probe, CAST(('0x' || substr(sha256('42|' || instance_id || '|' || probe || '|25.0'), 1, 8))::UBIGINT AS BIGINT) AS seed FROM obs")
def derived_seeds(spark, sf):
    return synth.observations(spark, sf).select(*KEYS, "probe", h.derived_seed(42, F.col("instance_id"), F.col("probe"), F.lit(25.0).cast("string")).alias("seed"))


@query("legal_probes", f"{_M} SELECT instance_id, CASE WHEN relation_applicable THEN 'blank,blur,crop,brightness,noise,grounding,relation' ELSE 'blank,blur,crop,brightness,noise,grounding' END AS probes FROM manifest")
def legal_probes(spark, sf):
    return synth.manifest(spark, sf).select("instance_id", F.array_join(states.legal_probes(F.col("relation_applicable")), ",").alias("probes"))


@query("forward_pass_count", f"{_C} SELECT model_id, CAST(sum(CASE WHEN relation_applicable THEN 8 ELSE 7 END) AS BIGINT) AS passes FROM clean GROUP BY model_id")
def forward_pass_count(spark, sf):
    return synth.clean(spark, sf).groupBy("model_id").agg(F.sum(1 + F.size(states.legal_probes(F.col("relation_applicable")))).alias("passes"))


@query("label_bits", f"{_L} SELECT instance_id, model_id, bit_v, bit_l, bit_a FROM labelled")
def label_bits(spark, sf):
    return labelled(spark, sf).select(*KEYS, "bit_v", "bit_l", "bit_a")


@query("signature", f"{_L} SELECT instance_id, model_id, round(v, 9) AS sig_v, round(l, 9) AS sig_l, round(a, 9) AS sig_a FROM labelled")
def signature(spark, sf):
    return labelled(spark, sf).select(*KEYS, *[F.round(c, 9).alias(c) for c in ("sig_v", "sig_l", "sig_a")])


@query("six_way", f"{_L} SELECT instance_id, model_id, label6 FROM labelled")
def six_way(spark, sf):
    return labelled(spark, sf).select(*KEYS, "label6")


@query("label_digests", f"{_L} SELECT instance_id, model_id, sha256('instance_id=' || instance_id || chr(10) || 'model_id=' || model_id || chr(10) || 'bit_v=' || CAST(bit_v AS VARCHAR) || chr(10) || 'bit_l=' || CAST(bit_l AS VARCHAR) || chr(10) || 'bit_a=' || CAST(bit_a AS VARCHAR) || chr(10) || 'label6=' || label6) AS digest FROM labelled")
def label_digests(spark, sf):
    return labelled(spark, sf).select(*KEYS, digests.record_digest(*KEYS, "bit_v", "bit_l", "bit_a", "label6").alias("digest"))


@query("manifest_digest", f"""{_M}, r AS (SELECT (row_number() OVER (ORDER BY instance_id) - 1) AS i, sha256('instance_id=' || instance_id || chr(10) || 'split=' || split || chr(10) || 'ordinal=' || CAST(ordinal AS VARCHAR)) AS d FROM manifest), c AS (SELECT i // 256 AS chunk, count(*) AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM r GROUP BY chunk)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY chunk)) AS digest FROM c""")  # fmt: skip
def manifest_digest(spark, sf):
    return digests.table_digest(synth.manifest(spark, sf), ["instance_id"], ["instance_id", "split", "ordinal"], 256)


@query("mandatory_probe_violations", f"""{_O}, g AS (SELECT instance_id, model_id, any_value(relation_applicable) AS rel, list(DISTINCT probe) FILTER (valid) AS ok FROM obs GROUP BY ALL),
w AS (SELECT instance_id, model_id, list_sort(list_filter(CASE WHEN rel THEN ['blank','blur','crop','brightness','noise','grounding','relation'] ELSE ['blank','blur','crop','brightness','noise','grounding'] END, lambda p: NOT list_contains(coalesce(ok, []), p))) AS missing FROM g)
SELECT instance_id, model_id, array_to_string(missing, ',') AS missing FROM w WHERE len(missing) > 0""")  # fmt: skip
def mandatory_probe_violations(spark, sf):
    return labels.missing_probes(synth.observations(spark, sf), KEYS).select(*KEYS, F.array_join("missing", ",").alias("missing"))


_TAGS = f"""{_C}, pr AS (SELECT * FROM (VALUES (0, 'blank'), (1, 'blur'), (2, 'brightness'), (3, 'crop'), (4, 'grounding'), (5, 'noise'), (6, 'relation')) AS v(bit, p)),
ord AS (SELECT * FROM (VALUES ('blank_first', ['blank','grounding','blur','crop','brightness','noise','relation']), ('visual_first', ['blur','crop','brightness','noise','blank','grounding','relation']), ('grounding_first', ['grounding','blank','blur','crop','brightness','noise','relation']), ('relation_first', ['relation','grounding','blank','blur','crop','brightness','noise'])) AS v(name, o)),
fixed AS (
  SELECT false AS rel, [] AS subset, 'empty' AS tag UNION ALL SELECT true, [], 'empty'
  UNION ALL SELECT r, [p], 'singleton:' || p FROM pr, (VALUES (true), (false)) AS v(r) WHERE r OR p <> 'relation'
  UNION ALL SELECT r, list_sort(oo[1:n]), 'prefix:' || name || ':' || CAST(n AS VARCHAR) FROM (SELECT r, name, CASE WHEN r THEN o ELSE list_filter(o, lambda x: x <> 'relation') END AS oo FROM ord, (VALUES (true), (false)) AS v(r)), range(1, 8) AS t(n) WHERE n <= len(oo)),
sub AS (SELECT mask, bit_count(mask) AS size, list_sort(list(p)) AS subset, bool_or(p = 'relation') AS has_rel FROM range(1, 128) AS t(mask), pr WHERE (mask >> bit) & 1 = 1 GROUP BY mask HAVING bit_count(mask) <= 4),
ranked AS (SELECT model_id, instance_id, subset, size, row_number() OVER (PARTITION BY model_id, instance_id, size ORDER BY sha256('42|' || model_id || '|' || instance_id || '|' || array_to_string(subset, '|'))) AS rn FROM clean, sub WHERE relation_applicable OR NOT has_rel),
tags AS (SELECT model_id, instance_id, subset, tag FROM clean JOIN fixed ON fixed.rel = clean.relation_applicable
  UNION ALL SELECT model_id, instance_id, subset, printf('random:%02d:size%d', CAST((rn - 1) * 4 + size - 1 AS INTEGER), CAST(size AS INTEGER)) FROM ranked WHERE rn <= 4)"""


@query("subset_tags", f"{_TAGS} SELECT model_id, instance_id, array_to_string(subset, ',') AS subset, tag FROM tags")
def subset_tags(spark, sf):
    rows = synth.clean(spark, sf).select("model_id", "instance_id", "relation_applicable")
    return states.subset_tags(rows).select("model_id", "instance_id", F.array_join("subset", ",").alias("subset"), "tag")


@query("partial_states", f"{_TAGS} SELECT model_id, instance_id, array_to_string(subset, ',') AS subset, string_agg(tag, ';' ORDER BY tag) AS tags, CAST(7 - len(subset) AS INTEGER) AS remaining_budget FROM tags GROUP BY model_id, instance_id, subset")
def partial_states(spark, sf):
    rows = synth.clean(spark, sf).select("model_id", "instance_id", "relation_applicable")
    return states.partial_states(rows).select("model_id", "instance_id", F.array_join("subset", ",").alias("subset"), F.array_join("tags", ";").alias("tags"), "remaining_budget")


@query("state_tag_coverage", f"{_TAGS} SELECT model_id, instance_id, count(*) AS n_tags, count(*) FILTER (WHERE tag LIKE 'random:%') AS n_random, count(*) FILTER (WHERE tag LIKE 'singleton:%') AS n_single, count(*) FILTER (WHERE tag LIKE 'prefix:%') AS n_prefix, count(DISTINCT subset) AS n_states FROM tags GROUP BY model_id, instance_id")
def state_tag_coverage(spark, sf):
    rows = synth.clean(spark, sf).select("model_id", "instance_id", "relation_applicable")
    return states.tag_coverage(rows)


@query("action_mask", f"""{_TAGS}, s AS (SELECT DISTINCT model_id, instance_id, subset FROM tags) SELECT s.model_id, s.instance_id, array_to_string(s.subset, ',') AS subset,
  array_to_string(list_transform(['blank','blur','crop','brightness','noise','grounding','relation'], lambda p: p || '=' || CASE WHEN list_contains(s.subset, p) OR (p = 'relation' AND NOT c.relation_applicable) THEN '0' ELSE '1' END), ';') || ';stop=1' AS mask FROM s JOIN clean c ON c.model_id = s.model_id AND c.instance_id = s.instance_id""")  # fmt: skip
def action_mask(spark, sf):
    rows = states.partial_states(synth.clean(spark, sf).select("model_id", "instance_id", "relation_applicable"))
    mask = F.array_join(F.transform(F.map_entries("mask"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return rows.select("model_id", "instance_id", F.array_join("subset", ",").alias("subset"), mask.alias("mask"))


@query("affordable_actions", f"""{_M} SELECT instance_id, CASE WHEN ordinal % 3 = 0 THEN 'stop' WHEN relation_applicable THEN 'blur,crop,brightness,noise,grounding,relation,stop' ELSE 'blur,crop,brightness,noise,grounding,stop' END AS actions FROM manifest""")
def affordable_actions(spark, sf):
    legal = states.affordable(F.array(F.lit("blank")), F.col("relation_applicable"), F.col("ordinal") % 3)
    return synth.manifest(spark, sf).select("instance_id", F.array_join(legal, ",").alias("actions"))


@query("acquired_observations", f"{_TAGS}, s AS (SELECT DISTINCT model_id, instance_id, subset FROM tags), {synth.SQL_OBS.split('clean AS', 1)[1].split('swap_invariance FROM c0),', 1)[1].strip()} SELECT s.model_id, s.instance_id, array_to_string(s.subset, ',') AS subset, count(o.probe) AS n_acquired, round(coalesce(sum(o.conf_shift), 0), 9) AS shift FROM s LEFT JOIN obs o ON o.model_id = s.model_id AND o.instance_id = s.instance_id AND list_contains(s.subset, o.probe) GROUP BY s.model_id, s.instance_id, s.subset")
def acquired_observations(spark, sf):
    rows = synth.clean(spark, sf).select("model_id", "instance_id", "relation_applicable")
    done = states.acquired_observations(rows, synth.observations(spark, sf))
    shift = F.aggregate("acquired", F.lit(0.0), lambda a, x: a + x["observed"]["conf_shift"])
    return done.select("model_id", "instance_id", F.array_join("subset", ",").alias("subset"), F.size("acquired").cast("long").alias("n_acquired"), F.round(shift, 9).alias("shift"))
