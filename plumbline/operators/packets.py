"""Audit packets: what annotators see, the private key to it, and the checks that the two fit and give nothing away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.records import KEYS, probe_table

# fixed values
ANNOTATORS = ("ann1", "ann2", "ann3")
FIELDS = ("clean_correct", "visual_fragile", "language_persistence", "alignment_instability", "label6", "insufficient_or_contradictory")
PRIVATE = frozenset(("instance_id", "dataset", "model_id", "model_revision", "teacher_signature", "teacher_bits", "teacher_label6", "source_image_path"))
# end of fixed values


def numbered(selection: DataFrame) -> DataFrame:
    """audit_id by place in the selection; place is a column from 1 on."""
    return selection.withColumn("audit_id", F.format_string("audit_%04d", "place"))


def split(selection: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blinded, private) rows of a selection (model_id, instance_id, place, provenance): two projections that share the id only."""
    rows = numbered(selection).join(records, KEYS)
    empty = [F.lit("").alias(f"{a}_{f}") for a in ANNOTATORS for f in FIELDS]
    blinded = rows.select("audit_id", F.concat(F.lit("images/"), "audit_id", F.lit(".png")).alias("image_file"), "question", "gold_answer", F.col("clean.raw_answer").alias("clean_answer"), probe_table(F.col("probes")).alias("probe_results_json"), *empty, F.lit("").alias("adjudicated_label6"))
    private = rows.select("audit_id", "instance_id", "group_id", "dataset", "split", "model_id", "model_revision", "teacher_signature", "teacher_bits", "teacher_label6", F.col("provenance").alias("selection_subset"))
    return blinded, private


def label_counts(selection: DataFrame, labels: DataFrame) -> DataFrame:
    """Selected rows by label."""
    return selection.select(*KEYS).join(labels.select(*KEYS, "label6"), KEYS).groupBy("label6").agg(F.count(F.lit(1)).alias("n"))


def id_problems(blinded: DataFrame, private: DataFrame) -> DataFrame:
    """Ids that one side lacks or has more than once."""
    b = blinded.groupBy("audit_id").agg(F.count(F.lit(1)).alias("n_blinded"))
    p = private.groupBy("audit_id").agg(F.count(F.lit(1)).alias("n_private"))
    both = b.join(p, "audit_id", "full_outer").fillna(0, ["n_blinded", "n_private"])
    return both.where("n_blinded <> 1 or n_private <> 1")


def checksum_problems(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """Of (file, sha256) rows, those whose file under folder is lacking or has another content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = F.length(F.lit(spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")))
    path = F.regexp_replace("path", "^[a-zA-Z0-9]+:(//[^/]*)?(?=/)", "")
    found = files.select(F.substring(path, root + 2, 1 << 20).alias("file"), F.sha2("content", 256).alias("_sha"))
    both = listed.join(found, "file", "left")
    return both.where(~F.col("sha256").eqNullSafe(F.col("_sha"))).select("file", F.when(F.col("_sha").isNull(), "missing").otherwise("changed").alias("problem"))


def packet_errors(blinded: DataFrame, private: DataFrame, expected: int, models: tuple[str, ...] = (), datasets: tuple[str, ...] = ()) -> DataFrame:
    """One row for each thing that is wrong with a packet. Columns that give private things away are seen without reading a row."""
    seen = sorted(PRIVATE & set(blinded.columns))
    problems = id_problems(blinded, private).agg(F.count(F.lit(1)).alias("n_problems"))
    b = blinded.agg(F.count(F.lit(1)).alias("n_blinded"))
    p = private.agg(F.count(F.lit(1)).alias("n_private"), F.collect_set("model_id").alias("models"), F.collect_set("dataset").alias("datasets"))
    one = b.crossJoin(p).crossJoin(problems)  # of one row each

    def lacking(names: tuple[str, ...], column: str):
        return F.array_except(F.expr("cast(array() as array<string>)") if not names else F.array(*map(F.lit, names)), column)

    messages = [
        F.when(F.lit(bool(seen)), F.lit(f"private columns are shown: {', '.join(seen)}")),
        F.when((F.col("n_blinded") != expected) | (F.col("n_private") != expected), F.format_string(f"{expected} rows expected, %d blinded and %d private found", "n_blinded", "n_private")),
        F.when(F.col("n_problems") > 0, F.format_string("%d ids are repeated or differ", "n_problems")),
        F.when(F.size(lacking(models, "models")) > 0, F.concat(F.lit("models are lacking: "), F.array_join(lacking(models, "models"), ", "))),
        F.when(F.size(lacking(datasets, "datasets")) > 0, F.concat(F.lit("datasets are lacking: "), F.array_join(lacking(datasets, "datasets"), ", "))),
    ]
    return one.select(F.explode(F.array_compact(F.array(*messages))).alias("error"))
