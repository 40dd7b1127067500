"""Readers of records, documents, tables and file listings, with declared schemas, and the registry of benchmark loaders."""

from __future__ import annotations

import os
from collections.abc import Callable

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as tx
from plumbline.functions.hashing import group_id
from plumbline.operators import coverage, quality
from plumbline.sources.staging import checkpointed

# fixed values
VIZWIZ_POLICY = "normalized_majority_source_order_tiebreak_v1"
# end of fixed values
MANIFEST = "instance_id string, group_id string, dataset string, image_id string, question_id string, image_path string, question string, gold_answer string, relation_applicable boolean"


def read_records(spark: SparkSession, path: str | list[str], schema: str | T.StructType, glob: str | None = None) -> DataFrame:
    """One JSON record a line; blank lines are skipped, a malformed one is an error. Infinities and NaN are numbers."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array; ordinal is the place in it, the file is whole by its format. A malformed one is an error."""
    found = F.from_json("value", f"array<struct<{_struct(schema)}>>", {"mode": "FAILFAST"})
    whole = spark.read.text(path, wholetext=True).where(F.col("value").rlike(r"\S"))
    whole = whole.where(F.assert_true(F.col("value").rlike(r"^\s*\["), F.lit("the file is no JSON array")).isNull()).select(found.alias("a"))
    return whole.select(F.posexplode("a").alias("ordinal", "r")).select("ordinal", "r.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON record a line of one file, with ordinal, its place among the lines that aren't blank; a malformed line is an error.

    The file is read in splits. A split's first ordinal comes from the numbers of lines of those before it, so no task holds the file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id")).where(F.col("value").rlike(r"\S"))
    lines = checkpointed(lines)
    sizes = lines.groupBy("_at").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("least"))
    first, total = [], 0
    for r in sorted(sizes.collect()):  # a row for each split
        first += [F.lit(r["_at"]), F.lit(total)]
        total += r["n"]
    place = F.row_number().over(Window.partitionBy("_at").orderBy("_id")) - 1
    at = (F.create_map(*first)[F.col("_at")] if first else F.lit(0)) + place
    record = F.from_json("value", f"struct<{_struct(schema)}>", {"mode": "FAILFAST"})
    return lines.select(at.cast("long").alias("ordinal"), record.alias("r")).select("ordinal", "r.*")


def read_unique(spark: SparkSession, path: str, schema: str, keys: list[str], glob: str | None = None) -> DataFrame:
    """Records of all files; a key that is there twice is an error when the rows are read."""
    return quality.require_unique(read_records(spark, path, schema, glob), keys)


def first_rows(spark: SparkSession, folder: str, schema: str, limit: int | None, glob: str) -> DataFrame:
    """The first rows of all files together, in the order of the files' names and their lines; all without a limit.

    Only the first ``limit`` rows of a file can be among them. Spark limits a row_number window before its shuffle.
    """
    rows = read_records(spark, folder, schema, glob).withColumns({"file": F.col("_metadata.file_name"), "_at": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    if not limit:
        return rows.drop("_at", "_id")
    own = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("_at", "_id"))).where(F.col("_n") <= limit)
    return own.orderBy("file", "_n").limit(limit).drop("_at", "_id", "_n")


def _struct(schema: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def read_array_or_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With ordinal; by the first character that isn't white space: an array, or one record a line."""
    first = spark.read.text(path).where(F.col("value").rlike(r"\S")).limit(1).collect()
    if first and first[0].value.lstrip().startswith("["):
        return read_array(spark, path, schema)
    return read_lines(spark, path, schema)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text; types are cast by those who know them."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """No rows where there is no such path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return read_records(spark, path, schema) if there else spark.createDataFrame([], schema)


def read_artifacts(spark: SparkSession, folder: str, prefix: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all files named prefix*.jsonl but failure ledgers, each with its file; and per file its sha256 and row count."""
    rows = read_records(spark, folder, schema, f"{prefix}*.jsonl").withColumn("file", F.col("_metadata.file_name")).where(~F.col("file").endswith(".failures.jsonl"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.jsonl").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256")).where(~F.col("file").endswith(".failures.jsonl"))
    return rows, files.join(rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows")), "file", "left").fillna(0, ["n_rows"])


def shard_of_file(name: Column) -> Column:
    """struct<model, shard, shards> from a name such as x_model_shard00-of-04.jsonl; empty names where it doesn't fit."""
    pattern = r"^[a-z]+_(.+)_shard(\d+)-of-(\d+)\.jsonl$"
    return F.struct(F.regexp_extract(name, pattern, 1).alias("model"), F.try_to_number(F.regexp_extract(name, pattern, 2), F.lit("99999")).cast("int").alias("shard"), F.try_to_number(F.regexp_extract(name, pattern, 3), F.lit("99999")).cast("int").alias("shards"))


def read_reference_overlay(spark: SparkSession, path: str) -> DataFrame:
    """key and references of a curated overlay: {schema_version: 1, matching_mode: exact_alias, records: {key: {canonical_answers}}}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "schema_version int, matching_mode string, records map<string,struct<canonical_answers:array<string>>>").alias("o")).select("o.*")
    fine = F.assert_true((F.col("schema_version") == 1) & (F.col("matching_mode") == "exact_alias"), F.lit("unknown overlay format"))
    rows = whole.where(fine.isNull()).select(F.explode("records").alias("key", "r"))
    names = F.array_distinct(F.filter(F.transform("r.canonical_answers", tx.strip), lambda x: x != ""))
    rows = rows.select("key", names.alias("references"))
    return rows.where(F.assert_true(F.size("references") > 0, F.concat(F.lit("no references for "), F.col("key"))).isNull())


def completed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Distinct ids of the records at a path; none where there is no such path."""
    return read_or_empty(spark, path, f"`{key}` string").select(key).where(F.col(key).isNotNull()).distinct()


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: the top level must be a mapping")
    return found


def resolve_path(*candidates: str | None, variables: tuple[str, ...] = (), default: str | None = None) -> str:
    """The first that exists on the driver's file system: the candidates, then the default, then the default under the folders that environment variables name."""
    under = [os.path.join(os.environ[v], default) for v in variables if default and os.environ.get(v)]
    tried = [c for c in (*candidates, default, *under) if c]
    for c in tried:
        if os.path.exists(c):
            return c
    raise FileNotFoundError(f"none of {tried} exists")


_loaders: dict[str, Callable[..., DataFrame]] = {}


def register_loader(name: str):
    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _loaders[name] = f
        return f

    return keep


def get_loader(name: str) -> Callable[..., DataFrame]:
    if name not in _loaders:
        raise KeyError(f"no loader {name}; known: {sorted(_loaders)}")
    return _loaders[name]


def manifest_rows(rows: DataFrame, dataset: str) -> DataFrame:
    """Ids of a manifest from image_id and question_id; other columns stay."""
    name, image, question = F.lit(dataset), F.col("image_id"), F.col("question_id")
    return rows.withColumns({"dataset": name, "instance_id": F.concat_ws("_", name, image, question), "group_id": group_id(name, image, question)})


def _head(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows in source order."""
    return rows.where(F.col("ordinal") < limit) if limit else rows


@register_loader("hallusionbench")
def load_hallusionbench(spark: SparkSession, path: str, overlay: DataFrame | None = None, limit: int | None = None, expected_open: int | None = None) -> DataFrame:
    """Rows with an image only, and the limit counts those. Open questions take their gold answer from the overlay and must have one.

    Of a whole file, the number of open questions must be the expected one, and the overlay must have no entry to spare.
    """
    schema = "category string, subcategory string, set_id string, figure_id string, question_id string, filename string, question string, gt_answer string, gt_answer_details string"
    rows = read_array(spark, path, schema).where(F.coalesce(F.trim("filename"), F.lit("")) != "")
    if limit:
        rows = rows.orderBy("ordinal").limit(limit)
    key = tx.source_key(*[F.col(c) for c in ("category", "subcategory", "set_id", "figure_id", "question_id")])
    rows = rows.withColumns({"key": key, "answer_type": tx.answer_type(F.col("question"))})
    if not limit and expected_open is not None:  # counts only mean something for the whole file
        quality.expect_count(rows, F.col("answer_type") == "open_ended", expected_open).collect()
        if overlay is not None and (spare := [r.key for r in coverage.unused(overlay, rows, "key").limit(10).collect()]):
            raise ValueError(f"the overlay has entries that no row uses: {spare}")
    overlay = overlay if overlay is not None else spark.createDataFrame([], "key string, references array<string>")
    both = rows.join(overlay, "key", "left")
    fine = (F.col("answer_type") == "open_ended") == F.col("references").isNotNull()
    both = both.where(F.assert_true(fine, F.concat(F.lit("the overlay doesn't fit "), F.col("key"))).isNull())
    gold = F.when(F.col("answer_type") == "open_ended", F.get("references", F.lit(0))).otherwise(tx.required_gold(F.col("gt_answer")))
    out = both.select(F.concat_ws("_", "set_id", "figure_id").alias("image_id"), F.col("ordinal").cast("string").alias("question_id"), F.col("filename").alias("image_path"), "question", gold.alias("gold_answer"), "answer_type", "category", "subcategory", F.col("references").alias("reference_answers"), F.lit(False).alias("relation_applicable"))
    return manifest_rows(out, "hallusionbench")


@register_loader("pope")
def load_pope(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """The random, popular and adversarial files, in that order, each an array or one record a line; alternative key names are taken as they come, and gold answers as they stand."""
    schema, parts, seen = "image string, text string, question string, label string, answer string, image_id string", [], 0
    for name in ("random", "popular", "adversarial"):
        rows = read_array_or_records(spark, f"{folder}/{name}.json", schema).withColumn("pope_split", F.lit(name))
        parts.append(_head(rows, limit - seen) if limit else rows)
        if limit:
            seen += min(limit - seen, rows.count())
            if seen >= limit:
                break
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    place = F.concat_ws("_", "pope_split", F.col("ordinal").cast("string"))
    out = rows.select(F.coalesce("image_id", place).alias("image_id"), place.alias("question_id"), F.col("image").alias("image_path"), F.coalesce("text", "question").alias("question"), F.coalesce("label", "answer", F.lit("")).alias("gold_answer"), "pope_split", F.lit(False).alias("relation_applicable"))
    return manifest_rows(out, "pope")


@register_loader("vizwiz")
def load_vizwiz(spark: SparkSession, path: str, limit: int | None = None, gold_policy: str = VIZWIZ_POLICY) -> DataFrame:
    """The gold answer is the annotators' commonest normalised one, the earliest among equals; another policy is refused."""
    if gold_policy != VIZWIZ_POLICY:
        raise ValueError(f"the gold policy must be {VIZWIZ_POLICY}, not {gold_policy}")
    rows = _head(read_array(spark, path, "image string, question string, answers array<struct<answer:string>>, answerable int"), limit)
    said = F.transform("answers", lambda a: tx.freeform(a["answer"]))
    counted = F.transform(F.array_distinct(said), lambda w: F.struct(F.size(F.filter(said, lambda x: x == w)).alias("n"), (-F.array_position(said, w)).alias("at"), w.alias("answer")))
    best = F.element_at(F.array_sort(counted), -1)
    empty = F.size("answers") <= 0
    rows = rows.withColumns({"best": F.when(~empty, best), "counts": F.when(~empty, F.map_from_entries(F.transform(counted, lambda c: F.struct(c["answer"], c["n"])))), "tied": F.when(~empty, F.size(F.filter(counted, lambda c: c["n"] == best["n"]))).otherwise(1)})
    gold = F.coalesce("best.answer", F.lit("unanswerable"))
    out = rows.select(F.col("image").alias("image_id"), F.col("ordinal").cast("string").alias("question_id"), F.col("image").alias("image_path"), "question", gold.alias("gold_answer"), F.coalesce("counts", F.create_map(F.lit("unanswerable"), F.lit(1))).alias("answer_counts"), F.col("tied").alias("tied_top_answers"), F.lit(False).alias("relation_applicable"))
    return manifest_rows(out, "vizwiz")


@register_loader("vsr")
def load_vsr(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Statements about spatial relations, with the swapped statement where there is one."""
    schema = "image string, image_link string, caption string, label string, relation string, subrelation string, image_id string"
    rows = _head(read_lines(spark, path, schema), limit)
    rows = rows.withColumn("gold_answer", tx.truth_label(F.col("label")))
    rows = rows.withColumn("s", tx.swap_relation(F.col("caption"), F.col("relation"), F.col("gold_answer")))
    out = rows.select(F.coalesce("image_id", "image", "image_link").alias("image_id"), F.col("ordinal").cast("string").alias("question_id"), F.coalesce("image", "image_link").alias("image_path"), F.col("caption").alias("question"), "gold_answer", "relation", "subrelation", F.col("s.applicable").alias("relation_applicable"), F.col("s.swapped_text").alias("swapped_question"), F.col("s.swapped_gold").alias("swapped_gold_answer"), F.col("s.relation").alias("relation_found"))
    return manifest_rows(out, "vsr")


@register_loader("gqa_relation")
def load_gqa_relation(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A prepared slice that already has the columns of a manifest."""
    return _head(read_lines(spark, path, MANIFEST), limit).drop("ordinal")


def load_dataset(spark: SparkSession, config: dict, **options) -> DataFrame:
    return get_loader(config["name"])(spark, config["path"], **options)
