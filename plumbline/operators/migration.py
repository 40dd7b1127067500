"""Moving cached records to a new answer contract: one call for the valid rows and the failure ledger of a shard.

Raw answers stay; what depends on the gold answer, on the normaliser or on the parser of grounded answers is made again inside the
row, labels included, and each row says what it was made from. Rows of open questions must be generated again and are dropped.
Nothing is raised half-way: everything that forbids the move is in ``errors``, and ``checked`` raises on the first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import stable_json_sha256
from plumbline.operators.joins import skew_join
from plumbline.operators.labels import Thresholds, alignment_bit, language_bit, row_pivot, signature, six_way, visual_bit
from plumbline.operators.quality import duplicates

KEYS = ["model_id", "instance_id"]
# fixed values
SCHEMA_VERSION, POLICY = 1, "reuse_safe_recompute_gold_and_parser_dependent_drop_open_ended"
BINARY, OPEN = "binary", "open_ended"
INVARIANT = ("group_id", "dataset", "split", "question")
# end of fixed values


@dataclass(frozen=True)
class Source:
    """Where a shard's rows come from, and which manifests they are of."""

    path: str
    sha256: str
    old_manifest: str
    new_manifest: str


@dataclass(frozen=True)
class Migration:
    valid: DataFrame
    failures: DataFrame
    #: model_id, instance_id of all that must be generated: failures and dropped rows.
    pending: DataFrame
    errors: DataFrame
    report: DataFrame

    def checked(self) -> Migration:
        if found := self.errors.limit(5).collect():
            raise ValueError(f"the shard can't be migrated: {[tuple(r) for r in found]}")
        return self


def relabelled(rows: DataFrame, condition: Column, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """rows with signature, bits and label made again from their probes where the condition holds, without a shuffle."""
    own = row_pivot(rows)
    v, language, a = visual_bit(t), language_bit(t), alignment_bit(t)
    correct = F.col("clean.correct") == 1
    sig = {c: x for c, x in zip("VLA", signature(t), strict=True)}
    bits = F.struct(v.cast("int").alias("visual"), language.cast("int").alias("language"), a.cast("int").alias("alignment"))
    new = {"teacher_signature": F.struct(*[x.alias(c) for c, x in sig.items()]), "teacher_bits": bits, "teacher_label6": six_way(v, language, a, F.coalesce(correct, F.lit(False)))}
    return own.withColumns({c: F.when(condition, x).otherwise(F.col(c)) for c, x in new.items()}).select(rows.columns)


def contracted(rows: DataFrame, normalise: Callable[[Column, Column], Column], grounded: Callable[[Column, Column], Column] | None, similarity: Column, tau: float) -> DataFrame:
    """rows (records with m_ columns of their manifest rows) with answers, correctness and probes by the new contract.

    Binary answers match exactly or not at all; free ones by meaning, decided anew only where an answer changed. Invalid probes stay as they
    are. ``grounded`` gives struct<valid, norm> of a grounded answer; without it the normaliser is used.
    """
    vizwiz, touched = F.col("dataset") == "vizwiz", F.col("dataset").isin("vizwiz", "hallusionbench")
    norm = F.when(touched, normalise(F.coalesce("clean.raw_answer", F.lit("")), F.col("dataset"))).otherwise(F.col("clean.norm_answer"))
    rows = rows.withColumns({"_old": F.col("clean.norm_answer"), "_new": norm})
    right = F.when(touched, F.coalesce((F.col("_new") == F.col("m_gold_answer")).cast("int"), F.lit(0))).otherwise(F.col("clean.correct"))

    def change(k: Column, v: Column) -> Column:
        raw = F.coalesce(v["raw_answer"], F.lit(""))
        own = normalise(raw, F.col("dataset"))
        if grounded is not None:
            own = F.when(k == "grounding", grounded(raw, F.col("dataset"))["norm"]).otherwise(own)
        same = own == F.col("_new")
        moved = ~own.eqNullSafe(v["norm_answer"]) | ~F.col("_new").eqNullSafe(F.col("_old"))
        free = F.when(moved, F.coalesce((similarity[k] >= tau).cast("double"), F.lit(0.0))).otherwise(v["semantic_match"])
        semantic = F.when(same, 1.0).when(vizwiz, free).otherwise(0.0)
        new = v.withField("norm_answer", own).withField("flip", ~same).withField("exact_match", same.cast("double")).withField("semantic_match", semantic)
        return F.when(F.coalesce(v["valid"], F.lit(False)), new).otherwise(v)

    probes = F.when(touched, F.transform_values("probes", change)).otherwise(F.col("probes"))
    gold = F.when(touched, F.col("m_gold_answer")).otherwise(F.col("gold_answer"))
    clean = F.col("clean").withField("norm_answer", F.col("_new")).withField("correct", right)
    return rows.withColumns({"probes": probes, "gold_answer": gold, "clean": clean}).drop("_old", "_new")


def migrated(rows: DataFrame, manifest: DataFrame, source: Source, normalise: Callable[[Column, Column], Column], grounded: Callable[[Column, Column], Column] | None = None, similarity: Column | None = None, tau: float = 0.82, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """Records by the new contract, with labels made again where the clean pass is valid, the new manifest's digest, and a struct that says what they were made from."""
    whole = stable_json_sha256(*rows.columns)
    m = manifest.select("instance_id", F.col("gold_answer").alias("m_gold_answer"))
    both = skew_join(rows.withColumn("_sha", whole), m, ["instance_id"], "left")
    none = F.create_map().cast("map<string,double>")
    new = contracted(both, normalise, grounded, none if similarity is None else similarity, tau).drop("m_gold_answer")
    new = relabelled(new, F.coalesce("clean.valid", F.lit(False)) & F.col("dataset").isin("vizwiz", "hallusionbench"), t)
    made = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(POLICY).alias("policy"), F.lit(source.path).alias("source_path"), F.lit(source.sha256).alias("source_file_sha256"), F.col("_sha").alias("source_record_sha256"))
    return new.withColumns({"source_manifest_sha256": F.lit(source.new_manifest), "answer_contract_migration": made}).drop("_sha")


def migrate_shard(valid: DataFrame, ledger: DataFrame, manifest: DataFrame, selected: DataFrame, source: Source, normalise: Callable[[Column, Column], Column], grounded: Callable[[Column, Column], Column] | None = None, similarity: Column | None = None, tau: float = 0.82, t: Thresholds = Thresholds()) -> Migration:  # noqa: B008
    """A shard's valid records and its ledger (whose rows embed a refused record) by the new contract.

    manifest is the new one, with answer_type and gold_answer; selected has the shard's keys. valid and ledger are read several times,
    so they should be tables.
    """
    open_rows = manifest.where((F.col("dataset") == "hallusionbench") & (F.col("answer_type") == OPEN)).select("instance_id")
    embedded = ledger.where("invalid_teacher_record is not null").select("invalid_teacher_record.*").select(valid.columns)
    keep, keep_failed = valid.join(open_rows, "instance_id", "left_anti").select(valid.columns), embedded.join(open_rows, "instance_id", "left_anti").select(valid.columns)
    args = (manifest, source, normalise, grounded, similarity, tau, t)
    new, new_failed = migrated(keep, *args), migrated(keep_failed, *args)
    whole = stable_json_sha256(*[c for c in ledger.columns if c != "invalid_teacher_record"], "invalid_teacher_record")
    about = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(POLICY).alias("policy"), F.lit(source.path).alias("source_path"), F.lit(source.sha256).alias("source_file_sha256"), whole.alias("source_record_sha256"))
    rest = ledger.join(open_rows, "instance_id", "left_anti").withColumns({"answer_contract_migration": about, "source_manifest_sha256": F.lit(source.new_manifest)}).drop("invalid_teacher_record")
    failures = rest.join(new_failed.select(*KEYS, F.struct(*new_failed.columns).alias("invalid_teacher_record")), KEYS, "left")
    identity = valid.select(*KEYS, "source_manifest_sha256").unionByName(ledger.select(*KEYS, "source_manifest_sha256"))
    dropped = identity.select(*KEYS).join(open_rows, "instance_id", "left_semi")
    pending = failures.select(*KEYS).unionByName(dropped.select(*KEYS)).distinct()
    errors = [
        identity.where(~F.col("source_manifest_sha256").eqNullSafe(F.lit(source.old_manifest))).select(F.lit("the row is of another manifest").alias("error"), *KEYS),
        duplicates(identity, *KEYS).select(F.lit("the key is there twice").alias("error"), *KEYS),
        identity.select(*KEYS).join(selected.select(*KEYS), KEYS, "left_anti").select(F.lit("the key is outside of the selection").alias("error"), *KEYS),
        selected.select(*KEYS).join(identity.select(*KEYS), KEYS, "left_anti").select(F.lit("the selection has no such row").alias("error"), *KEYS),
        ledger.where("invalid_teacher_record is null").select(F.lit("a failure embeds no record").alias("error"), *KEYS),
        _drift(keep.unionByName(keep_failed), manifest),
    ]
    if grounded is not None:
        errors.append(_unparsed(new, grounded))
    out = errors[0]
    for e in errors[1:]:
        out = out.unionByName(e)
    return Migration(new, failures, pending, out, _report(valid, keep, new, failures, dropped, pending, selected))


def _drift(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Fields that must be the same in a record and its manifest row, and records without one."""
    own = [c for c in INVARIANT if c in rows.columns and c in manifest.columns]
    m = manifest.select("instance_id", *[F.col(c).alias(f"m_{c}") for c in own], F.lit(True).alias("_there"))
    both = rows.select(*KEYS, *own).join(m, "instance_id", "left")
    bad = F.array_compact(F.array(*[F.when(F.col("_there") & ~F.col(c).eqNullSafe(F.col(f"m_{c}")), F.lit(f"{c} has drifted")) for c in own], F.when(F.col("_there").isNull(), F.lit("the manifest has no such row"))))
    return both.select(F.explode(bad).alias("error"), *KEYS)


def _unparsed(rows: DataFrame, grounded: Callable[[Column, Column], Column]) -> DataFrame:
    """Migrated rows whose grounded answer the parser refuses, or reads in another way than is stored."""
    g = F.try_element_at("probes", F.lit("grounding"))
    now = rows.withColumns({"_g": g, "_p": grounded(F.coalesce(g["raw_answer"], F.lit("")), F.col("dataset"))})
    bad = F.when(~F.coalesce("_g.valid", F.lit(False)), "no valid grounding").when(~F.col("_p.valid"), "the grounding no longer parses").when(~F.col("_p.norm").eqNullSafe(F.col("_g.norm_answer")), "the grounding reads otherwise")
    return now.where(F.col("dataset").isin("vizwiz", "hallusionbench")).select(bad.alias("error"), *KEYS).where("error is not null")


def _report(valid: DataFrame, keep: DataFrame, new: DataFrame, failures: DataFrame, dropped: DataFrame, pending: DataFrame, selected: DataFrame) -> DataFrame:
    """One row of counters: what was selected, kept, failed, dropped and is pending, and how many rows changed in correctness and in probes, by kind of contract."""
    was = keep.select(*KEYS, "dataset", F.col("clean.correct").alias("_c"), F.to_json("probes").alias("_p"))
    both = was.join(new.select(*KEYS, F.col("clean.correct").alias("c"), F.to_json("probes").alias("p")), KEYS)
    changed, probes = ~F.col("_c").eqNullSafe(F.col("c")), ~F.col("_p").eqNullSafe(F.col("p"))
    viz = F.col("dataset") == "vizwiz"
    counts = both.agg(
        F.count(F.lit(1)).alias("valid"), F.count_if(changed & ~viz).alias("binary_correctness_changes"), F.count_if(probes & ~viz).alias("binary_probe_changes"),
        F.count_if(changed & viz).alias("vizwiz_correctness_changes"), F.count_if(probes & viz).alias("vizwiz_probe_changes"),
    )
    for name, rows in (("selected", selected), ("failures", failures), ("dropped", dropped), ("pending", pending)):
        counts = counts.crossJoin(rows.agg(F.count(F.lit(1)).alias(name)))  # one row by one row
    return counts
