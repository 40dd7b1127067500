"""Fail-closed rules: every rule is a condition that must hold; rows carry the messages of those that don't."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scores import finite
from plumbline.operators.joins import skew_join
from plumbline.operators.labels import CORE_PROBES

Rule = tuple[str, Column]
SPLITS = ("train", "val", "cal", "test")


def with_errors(rows: DataFrame, rules: Sequence[Rule], name: str = "errors") -> DataFrame:
    """An array of the messages of all rules whose condition is false or null."""
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in rules])
    return rows.withColumn(name, F.array_compact(found))


def rule_counts(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, violations), every rule once, in one aggregate."""
    sums = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"r{i}") for i, (_, ok) in enumerate(rules)]
    each = F.array(*[F.struct(F.lit(m).alias("rule"), F.col(f"r{i}").alias("violations")) for i, (m, _) in enumerate(rules)])
    return rows.agg(*sums).select(F.explode(each).alias("e")).select("e.*")


def require(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows, or an error when a row that breaks a rule is read."""
    checked = with_errors(rows, rules, "_errors")
    return checked.where(F.assert_true(F.size("_errors") == 0, F.array_join("_errors", "; ")).isNull()).drop("_errors")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, and how many: aggregated, not windowed, so that a hot key costs one row."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def later_duplicates(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows that come after the first of their key; a null key is a key of its own. Orders differ within a key."""
    own = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{i}") for i, k in enumerate(keys)] + [F.col(k).isNull().alias(f"_n{i}") for i, k in enumerate(keys)]
    names = [f"_{i}" for i in range(len(keys))] + [f"_n{i}" for i in range(len(keys))]
    plain = rows.select("*", *own)
    first = plain.groupBy(*names).agg(F.min(F.struct(order)).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return skew_join(plain, first, names).where(F.struct(order) > F.col("_first")).select(*rows.columns)


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, or an error when one is read whose key is there twice or null."""
    twice = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    same, null = F.lit(True), F.lit(False)
    for k in keys:  # null-safe, or null keys would be dropped before they are seen
        same, null = same & F.col(k).eqNullSafe(F.col(f"_{k}")), null | F.col(f"_{k}").isNull()
    message = F.when(null, "a key is null").when(F.col("_n") > 1, "a key is there twice")
    return rows.join(twice, same).where(F.assert_true(message.isNull(), message).isNull()).select(*rows.columns)


def duplicate_sources(rows: DataFrame, source: str, *keys: str) -> DataFrame:
    """Keys in more than one source, with the first source and their number."""
    return rows.groupBy(*keys).agg(F.min(source).alias("first"), F.count_distinct(source).alias("sources")).where("sources > 1")


def listed(errors: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first errors in this order, each with the number of all of them in n_errors."""
    n = errors.agg(F.count(F.lit(1)).alias("n_errors"))
    return errors.orderBy(*order).limit(limit).crossJoin(n)  # with one row


def manifest_rules() -> list[Rule]:
    filled = [(f"{c} is missing", F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0) for c in ("instance_id", "group_id", "dataset", "image_id", "question_id")]
    return [*filled, ("relation_applicable is null", F.col("relation_applicable").isNotNull()), ("unknown split", F.col("split").isin(*SPLITS)), ("group_id has no digest", F.col("group_id").rlike("^sha256:[0-9a-f]{16}$"))]


def split_rule(splits: Sequence[str]) -> Rule:
    return ("split is not allowed", F.col("split").isin(*splits))


def observation_rules(splits: Sequence[str] = ("train", "val")) -> list[Rule]:
    """Which splits are legal is the caller's choice: a pilot takes two of them, a full run all."""
    shifts = [(f"{c} is not finite", finite(F.col(c))) for c in ("conf_shift", "entropy_shift", "margin_shift")]
    return [split_rule(splits), ("unknown probe", F.col("probe").isin(*CORE_PROBES, "relation")), ("relation probe without relation", (F.col("probe") != "relation") | F.col("relation_applicable")), *shifts, ("semantic_match is not 0 or 1", F.col("semantic_match").isin(0, 1)), ("invalid observation", F.col("valid"))]


def recomputed(stored: DataFrame, fresh: DataFrame, keys: list[str], exact: list[str], close: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Keys where stored and fresh columns differ, by name; null equals null."""
    both = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*exact, *close)]).join(fresh.select(*keys, *exact, *close), keys)
    bad = [F.when(~F.col(f"_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in exact] + [F.when(~F.coalesce(F.abs(F.col(f"_{c}") - F.col(c)) <= tolerance, F.col(f"_{c}").isNull() & F.col(c).isNull()), F.lit(c)) for c in close]
    return both.select(*keys, F.array_compact(F.array(*bad)).alias("differ")).where(F.size("differ") > 0)


def forbidden_fields(schema: T.StructType, names: set[str], at: str = "") -> list[str]:
    """Paths of fields with these names anywhere in a schema: a leak is found without reading a row."""
    found = []
    for f in schema.fields:
        path = f"{at}.{f.name}" if at else f.name
        if f.name in names:
            found.append(path)
        kind = f.dataType
        while isinstance(kind, T.ArrayType | T.MapType):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if isinstance(kind, T.StructType):
            found += forbidden_fields(kind, names, path)
    return found


def expect_count(rows: DataFrame, condition: Column, n: int) -> DataFrame:
    """One row with the count, or an error if it drifted."""
    got = rows.agg(F.count_if(condition).alias("n"))
    return got.where(F.assert_true(F.col("n") == n, F.format_string(f"expected {n} rows, found %d", F.col("n"))).isNull())


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """The rows, or an error if there are none: a selection that selects nothing is a mistake."""
    if rows.isEmpty():
        raise ValueError(f"no rows: {what}")
    return rows


def human_labels(rows: DataFrame) -> DataFrame:
    """Typed columns of an annotated table of text: human_match as boolean and similarity as double; a row that doesn't fit is an error."""
    said = F.lower(F.trim("human_match"))
    similarity = F.col("cosine_similarity").try_cast("double")
    ok = said.isin("0", "1", "false", "true", "no", "yes") & finite(similarity) & similarity.between(-1, 1) & F.col("split").isin("train", "val")
    checked = rows.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.concat(F.lit("the label doesn't fit: "), F.coalesce("audit_id", F.lit("")))).isNull())
    return checked.withColumns({"match": said.isin("1", "true", "yes"), "similarity": similarity})


def semantic_candidates(records: DataFrame) -> DataFrame:
    """Pairs of clean and probe answers that people may judge: of canonical VizWiz records for development, valid, not empty and not equal.

    records need clean and probes structs with norm_answer, and pilot_severity_probe, which is null in canonical ones.
    """
    rows = canonical(records).where((F.lower("dataset") == "vizwiz") & F.col("split").isin("train", "val"))
    each = rows.select("model_id", "instance_id", "split", F.col("clean.norm_answer").alias("clean_answer"), F.explode("probes").alias("probe", "o"))
    each = each.where(F.coalesce(F.col("o.applicable"), F.lit(True)) & F.coalesce(F.col("o.valid"), F.lit(True)))
    each = each.select("model_id", "instance_id", "split", "probe", "clean_answer", F.col("o.norm_answer").alias("probe_answer"))
    return each.where((F.length("clean_answer") > 0) & (F.length("probe_answer") > 0) & (F.col("clean_answer") != F.col("probe_answer")))


def canonical(records: DataFrame) -> DataFrame:
    return records.where(F.col("pilot_severity_probe").isNull())


def severities(records: DataFrame) -> DataFrame:
    return records.where(F.col("pilot_severity_probe").isNotNull())


def identity(records: DataFrame) -> DataFrame:
    """records with key, the struct by which two of them are the same: severity records differ by probe and severity too. A null in it is an error."""
    varied = F.col("pilot_severity_probe").isNotNull()
    base = [F.coalesce("record_type", F.lit("teacher_cache")).alias("record_type"), "model_id", "dataset", "instance_id"]
    ok = F.col("model_id").isNotNull() & F.col("dataset").isNotNull() & F.col("instance_id").isNotNull() & (~varied | F.col("pilot_severity_value").isNotNull())
    rows = records.where(F.assert_true(ok, F.lit("a record's key is incomplete")).isNull())
    return rows.withColumn("key", F.struct(*base, "pilot_severity_probe", "pilot_severity_value"))


def scope_errors(records: DataFrame, model: str, dataset: str) -> DataFrame:
    """(key, error) of records that can't be gone on with: of another model or dataset, or there twice."""
    rows = identity(records)
    outside = rows.where((F.col("model_id") != model) | (F.col("dataset") != dataset)).select("key", F.lit("another model or dataset").alias("error"))
    return outside.unionByName(duplicates(rows, "key").select("key", F.lit("there twice").alias("error")))
