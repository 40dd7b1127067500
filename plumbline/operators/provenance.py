"""Whether labels and states are of the files and records that they name, and whether labels are those that their records give today."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scores import finite
from plumbline.operators.digests import record_digest
from plumbline.operators.joins import large_join
from plumbline.operators.labels import LABELS
from plumbline.operators.quality import Rule
from plumbline.operators.records import KEYS, errors_of

# fixed values
COPIED = ("group_id", "dataset", "split", "model_revision")
BITS = ("visual", "language", "alignment")
# end of fixed values
DIGESTED = (*KEYS, *COPIED, "clean_correct", *BITS, "teacher_label6")


def label_digest() -> Column:
    """The digest that a label row carries of its own fields."""
    return record_digest(*DIGESTED)


def label_table(records: DataFrame, teacher_sha: str | Column) -> DataFrame:
    """The label rows that records give: copied fields, correctness, bits, label, signature, the teacher file's digest and the row's own."""
    sha = F.lit(teacher_sha) if isinstance(teacher_sha, str) else teacher_sha
    bits = [F.col(f"teacher_bits.{b}").alias(b) for b in BITS]
    rows = records.select(*KEYS, *COPIED, F.col("clean.correct").alias("clean_correct"), *bits, "teacher_label6", "teacher_signature", sha.alias("source_teacher_file_sha256"))
    return rows.withColumn("label_record_sha256", label_digest())


def label_errors(labels: DataFrame, records: DataFrame) -> DataFrame:
    """(rule, keys) of labels that aren't what their records give. records has a column teacher_file_sha256."""
    due = label_table(records, F.col("teacher_file_sha256"))
    fields = [*COPIED, "clean_correct", *BITS, "teacher_label6", "label_record_sha256", "source_teacher_file_sha256"]
    own = due.select(*KEYS, *[F.col(c).alias(f"r_{c}") for c in fields], F.col("teacher_signature").alias("r_signature"), F.lit(True).alias("_there"))
    both = large_join(labels, own, KEYS, "left")
    there, sig = F.coalesce("_there", F.lit(False)), F.col("teacher_signature")
    rules: list[Rule] = [
        ("a label has no record", there),
        *[(f"the label's {c} is stale", ~there | F.col(c).eqNullSafe(F.col(f"r_{c}"))) for c in fields[:-2]],
        ("the label's signature is stale", ~there | sig.eqNullSafe(F.col("r_signature"))),
        ("the label's digest is stale", ~there | F.col("label_record_sha256").eqNullSafe(F.col("r_label_record_sha256"))),
        ("the label's digest is not that of its fields", F.col("label_record_sha256") == label_digest()),
        ("the label is of another teacher file", ~there | F.col("source_teacher_file_sha256").eqNullSafe(F.col("r_source_teacher_file_sha256"))),
        ("the label is unknown", F.col("teacher_label6").isin(*LABELS)),
        *[(f"the label's {b} is no bit", F.col(b).isin(0, 1)) for b in BITS],
        ("the label's signature is not finite", finite(sig["V"]) & finite(sig["L"]) & finite(sig["A"])),
    ]
    return errors_of(both, rules)


def state_file_errors(states: DataFrame, records: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule, keys) of states that name another teacher or label file than their record and label are of.

    records has teacher_file_sha256 and labels label_file_sha256; a record has some fifty states, so no key is frequent.
    """
    sources = large_join(records.select(*KEYS, "teacher_file_sha256"), labels.select(*KEYS, "label_file_sha256"), KEYS)
    rows = states.select(F.col("metadata.model_id").alias("model_id"), F.col("metadata.instance_id").alias("instance_id"), "state_id", "source_teacher_file_sha256", "source_label_file_sha256")
    both = large_join(rows, sources.withColumn("_there", F.lit(True)), KEYS, "left")
    there = F.coalesce("_there", F.lit(False))
    return errors_of(both, [
        ("a state has no record and label", there),
        ("the state is of another teacher file", ~there | F.col("source_teacher_file_sha256").eqNullSafe(F.col("teacher_file_sha256"))),
        ("the state is of another label file", ~there | F.col("source_label_file_sha256").eqNullSafe(F.col("label_file_sha256"))),
    ])
