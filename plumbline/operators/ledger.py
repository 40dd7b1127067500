"""Failure ledgers and rewrites of cached rows: upserts by key, and updates inside maps of probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.quality import Rule, duplicates, with_errors


def upsert_failures(ledger: DataFrame, failures: DataFrame, successes: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger after a run: a success deletes its key, a failure counts one attempt more and its message replaces the old one."""
    old = ledger.select(*keys, F.col("error").alias("_old"), F.col("attempts").alias("_attempts"))
    new = failures.select(*keys, "error").withColumn("_new", F.lit(True))
    both = old.join(new, keys, "full_outer")
    attempts = F.coalesce("_attempts", F.lit(0)) + F.when(F.col("_new"), 1).otherwise(0)
    rows = both.select(*keys, F.when(F.col("_new"), F.col("error")).otherwise(F.col("_old")).alias("error"), attempts.cast("int").alias("attempts"))
    return rows.join(successes.select(*keys), keys, "left_anti")


def replace_entry(entries: Column, key: str, value: Column) -> Column:
    """A map with one entry set anew."""
    return F.map_concat(F.map_filter(entries, lambda k, v: k != key), F.create_map(F.lit(key), value))


def update_entries(entries: Column, change) -> Column:
    """A map whose valid values are changed; invalid ones stay."""
    return F.transform_values(entries, lambda k, v: F.when(F.coalesce(v["valid"], F.lit(False)), change(k, v)).otherwise(v))


def renormalise(probes: Column, clean_norm: Column, normalise) -> Column:
    """Probes (map of struct<raw, norm, flip, exact, valid>) with norm, flip and exact computed anew from the raw answers."""

    def change(_: Column, v: Column) -> Column:
        norm = normalise(v["raw"])
        return F.struct(v["raw"].alias("raw"), norm.alias("norm"), (norm != clean_norm).alias("flip"), (norm == clean_norm).cast("int").alias("exact"), v["valid"].alias("valid"))

    return update_entries(probes, change)


def migrate(rows: DataFrame, dropped: DataFrame, keys: list[str], source: str) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, with where they come from, and keys that must be made again."""
    kept = rows.join(dropped.select(*keys), keys, "left_anti").withColumn("migrated_from", F.lit(source))
    return kept, rows.select(*keys).join(dropped.select(*keys), keys, "left_semi")


def changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """How many rows changed in each column; null equals null."""
    both = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns]).join(new.select(*keys, *columns), keys)
    return both.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"{c}_changed") for c in columns])


def recovered(valid: DataFrame, ledger: DataFrame, keys: list[str], embedded: str) -> DataFrame:
    """Valid rows and those that a ledger embeds, with their kind; a key in both is an error."""
    from_ledger = ledger.where(F.col(embedded).isNotNull()).select(f"{embedded}.*").withColumn("source_kind", F.lit("ledger"))
    both = valid.withColumn("source_kind", F.lit("valid")).unionByName(from_ledger, allowMissingColumns=True)
    twice = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return both.join(twice, keys).where(F.assert_true(F.col("_n") == 1, F.lit("a key is both valid and failed")).isNull()).drop("_n")


def ledger_rules(record_type: str, version: int, model: str, provenance: dict[str, str | int]) -> list[Rule]:
    """What every row of a failure ledger must meet: its kind, its schema, its model, and where it comes from."""
    same: list[Rule] = [(f"{name} has changed", F.col(name) == value) for name, value in provenance.items()]
    return [("the record type is wrong", F.col("record_type") == record_type), ("the schema is unknown", F.col("schema_version") == version), ("the model is another one", F.col("model_id") == model), *same]


def ledger_errors(ledger: DataFrame, selected: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """(error, keys) of everything that forbids the use of a ledger: broken rules, keys that are there twice or not selected."""
    broken = with_errors(ledger, rules).select(F.explode("errors").alias("error"), *keys)
    twice = duplicates(ledger, *keys).select(F.lit("the key is there twice").alias("error"), *keys)
    outside = ledger.join(selected.select("instance_id").distinct(), "instance_id", "left_anti").select(F.lit("the key is outside of the selection").alias("error"), *keys)
    return broken.unionByName(twice).unionByName(outside)


def covered(base: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Selected keys that no base row has, and base rows that aren't selected, with which of the two they are."""
    lacking = selected.select(*keys).join(base.select(*keys), keys, "left_anti").withColumn("problem", F.lit("missing"))
    return lacking.unionByName(base.select(*keys).join(selected.select(*keys), keys, "left_anti").withColumn("problem", F.lit("extra")))


def changed_sources(rows: DataFrame, base: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows whose provenance isn't that of the base row they were made from, with the fields that differ; without a base row, 'base'."""
    its = base.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_there"))
    both = rows.join(its, keys, "left")
    bad = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in fields]))
    found = F.when(F.col("_there").isNull(), F.array(F.lit("base"))).otherwise(bad)
    return both.select(*keys, found.alias("differ")).where(F.size("differ") > 0)


def rescored(probes: Column, old_clean: Column, new_clean: Column, normalise, similarity: Column, tau: float) -> Column:
    """Probes (map of struct<raw, norm, flip, exact, semantic, valid>) by newly normalised answers.

    An equal answer matches by meaning; other matches are decided anew, from similarity (a map by probe), only where either
    answer changed. Invalid probes stay as they are.
    """

    def change(k: Column, v: Column) -> Column:
        norm = normalise(v["raw"])
        same, moved = norm == new_clean, (norm != v["norm"]) | (old_clean != new_clean)
        semantic = F.when(same, 1.0).when(moved, F.coalesce((similarity[k] >= tau).cast("double"), F.lit(0.0))).otherwise(v["semantic"])
        return F.struct(v["raw"].alias("raw"), norm.alias("norm"), (~same).alias("flip"), same.cast("int").alias("exact"), semantic.alias("semantic"), v["valid"].alias("valid"))

    return update_entries(probes, change)


def parser_drift(rows: DataFrame, parse, keys: list[str]) -> DataFrame:
    """Valid rows whose stored answer isn't what the parser gives now: keys, stored, current and the reason. parse gives struct<valid, norm>."""
    both = rows.withColumn("_p", parse)
    reason = F.when(~F.coalesce("valid", F.lit(False)), "not valid").when(~F.col("_p.valid"), "no longer parses").when(~F.col("_p.norm").eqNullSafe(F.col("norm")), "another answer")
    return both.select(*keys, F.col("norm").alias("stored"), F.col("_p.norm").alias("current"), reason.alias("reason")).where("reason is not null")


def rollup(shards: DataFrame, by: str, counters: list[str], expected: dict[str, int]) -> DataFrame:
    """The shards' counters by model, and the counters that aren't what is expected of every model."""
    sums = shards.groupBy(by).agg(*[F.sum(c).alias(c) for c in counters])
    bad = F.array_compact(F.array(*[F.when(F.col(c) != n, F.lit(c)) for c, n in expected.items()])) if expected else F.expr("cast(array() as array<string>)")
    return sums.withColumn("unexpected", bad)


def reused_grid(canonical: DataFrame, grid: DataFrame, settings: DataFrame, keys: list[str]) -> DataFrame:
    """The severity grid with the canonical row, where there is one of that probe and severity, in place of a computed one, and which of the two it is."""
    own = canonical.join(settings, ["probe"]).withColumn("source", F.lit("reused"))
    computed = grid.join(own.select(*keys, "probe", "severity"), [*keys, "probe", "severity"], "left_anti").withColumn("source", F.lit("computed"))
    return own.select(*computed.columns).unionByName(computed)
