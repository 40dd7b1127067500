"""Source bits, signatures and six-way labels from probe observations: one partial aggregate by instance and model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
CORE_PROBES = ("blank", "blur", "crop", "brightness", "noise", "grounding")
PROBES = (*CORE_PROBES, "relation")
VISUAL_PROBES = ("blur", "crop", "brightness", "noise")
LABELS = ("no-failure", "visual", "language-prior", "alignment", "mixed", "unclear")
BITS = ("visual", "language", "alignment")


@dataclass(frozen=True)
class Thresholds:
    visual_flip: float = 0.25
    visual_shift: float = 0.15
    blank_ratio: float = 0.80
    grounding_shift: float = 0.15
    eps: float = 1e-8
    # end of fixed values

    @classmethod
    def of(cls, mapping: dict[str, float]) -> Thresholds:
        """From a mapping that names all of them and no others; eps, which only keeps a ratio stable, may be left out."""
        names = set(cls.__dataclass_fields__)
        if names - {"eps"} - set(mapping) or set(mapping) - names:
            raise ValueError(f"thresholds: unknown {sorted(set(mapping) - names)}, missing {sorted(names - {'eps'} - set(mapping))}")
        return cls(**mapping)


def _only(value: Column, *conditions: Column) -> Column:
    """The largest value of the rows that meet all conditions."""
    both = conditions[0]
    for c in conditions[1:]:
        both = both & c
    return F.max(F.when(both, value))


def pivot_probes(observations: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """One row by keys with what the labels need. The visual shifts are added in a fixed order, so sums don't depend on the plan."""
    shift = F.abs("conf_shift")
    usable = F.col("valid") & F.col("applicable")
    flips = {p: F.coalesce(_only(F.col("flip").cast("int"), F.col("probe") == p, usable), F.lit(0)) for p in VISUAL_PROBES}
    shifts = {p: F.coalesce(_only(shift, F.col("probe") == p, usable), F.lit(0.0)) for p in VISUAL_PROBES}
    seen = {p: F.coalesce(_only(F.lit(1), F.col("probe") == p, usable), F.lit(0)) for p in VISUAL_PROBES}

    def added(parts: dict[str, Column]) -> Column:
        total = None
        for p in VISUAL_PROBES:
            total = parts[p] if total is None else total + parts[p]
        return total

    blank, grounding = F.col("probe") == "blank", F.col("probe") == "grounding"
    return observations.groupBy(*keys).agg(
        *[F.any_value(c).alias(c) for c in carried], added(seen).alias("n_visual"), added(flips).alias("visual_flips"), added(shifts).alias("visual_shift"),
        _only(F.col("semantic_match"), blank, F.col("valid")).alias("blank_match"), _only(F.col("conf_shift"), blank, F.col("valid")).alias("blank_shift"),
        _only(F.col("flip").cast("int"), grounding, F.col("valid")).alias("grounding_flip"), _only(shift, grounding, F.col("valid")).alias("grounding_shift"),
    )


def row_pivot(records: DataFrame) -> DataFrame:
    """records (clean struct, map of probes) with the columns of ``pivot_probes``, taken from their own map."""

    def of(name: str, value: Column | None, *flags: str) -> Column:
        probe = F.try_element_at("probes", F.lit(name))
        ok = probe["valid"] if "applicable" not in flags else probe["valid"] & probe["applicable"]
        return F.when(F.coalesce(ok, F.lit(False)), F.lit(1) if value is None else value)

    def at(name: str, field: str) -> Column:
        return F.try_element_at("probes", F.lit(name))[field]

    def added(parts: list[Column], none: Column) -> Column:
        total = None
        for p in parts:
            one = F.coalesce(p, none)
            total = one if total is None else total + one
        return total

    return records.withColumns({
        "answer_prob": F.col("clean.answer_prob"),
        "n_visual": added([of(p, None, "applicable") for p in VISUAL_PROBES], F.lit(0)),
        "visual_flips": added([of(p, at(p, "flip").cast("int"), "applicable") for p in VISUAL_PROBES], F.lit(0)),
        "visual_shift": added([of(p, F.abs(at(p, "conf_shift")), "applicable") for p in VISUAL_PROBES], F.lit(0.0)),
        "blank_match": of("blank", at("blank", "semantic_match").cast("int")), "blank_shift": of("blank", at("blank", "conf_shift")),
        "grounding_flip": of("grounding", at("grounding", "flip").cast("int")), "grounding_shift": of("grounding", F.abs(at("grounding", "conf_shift"))),
    })


def visual_bit(t: Thresholds) -> Column:
    n = F.greatest("n_visual", F.lit(1))
    return (F.col("n_visual") > 0) & ((F.col("visual_flips") / n >= t.visual_flip) | (F.col("visual_shift") / n >= t.visual_shift))


def blank_ratio(t: Thresholds) -> Column:
    return (F.col("answer_prob") + F.col("blank_shift")) / (F.col("answer_prob") + t.eps)


def language_bit(t: Thresholds) -> Column:
    return F.coalesce((F.col("blank_match") == 1) & (blank_ratio(t) >= t.blank_ratio), F.lit(False))


def invariant() -> Column:
    """A swap that should have changed the answer did not; null counts as no."""
    return F.col("relation_applicable") & F.coalesce("swap_invariance", F.lit(False))


def alignment_bit(t: Thresholds) -> Column:
    return F.coalesce((F.col("grounding_flip") == 1) | (F.col("grounding_shift") >= t.grounding_shift), F.lit(False)) | invariant()


def signature(t: Thresholds) -> list[Column]:
    """Continuous scores beside the bits; no threshold but eps applies."""
    v = F.when(F.col("n_visual") > 0, F.col("visual_shift") / F.col("n_visual")).otherwise(0.0)
    language = F.coalesce(blank_ratio(t) * F.col("blank_match"), F.lit(0.0))
    a = F.greatest(F.coalesce("grounding_shift", F.lit(0.0)), F.when(F.col("grounding_flip") == 1, 0.5).otherwise(0.0), F.when(invariant(), 1.0).otherwise(0.0))
    return [v.alias("sig_v"), language.alias("sig_l"), a.alias("sig_a")]


def six_way(v: Column, language: Column, a: Column, correct: Column) -> Column:
    """A correct row with one bit has that bit's label; only one without any is free of failure."""
    n = v.cast("int") + language.cast("int") + a.cast("int")
    return F.when((n == 0) & correct, "no-failure").when(n >= 2, "mixed").when(v, "visual").when(language, "language-prior").when(a, "alignment").otherwise("unclear")


def label_rows(observations: DataFrame, keys: list[str], carried: list[str], t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """Keys, carried columns, bits, signature and label6. carried needs answer_prob, clean_correct, relation_applicable, swap_invariance."""
    wide = pivot_probes(observations, keys, carried)
    rows = wide.select(*keys, *carried, visual_bit(t).alias("bit_v"), language_bit(t).alias("bit_l"), alignment_bit(t).alias("bit_a"), *signature(t))
    return rows.withColumn("label6", six_way(F.col("bit_v"), F.col("bit_l"), F.col("bit_a"), F.col("clean_correct")))


def missing_probes(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose valid probes lack one that is due, with the lacking names: the core ones, and relation where it applies."""
    due = F.when(F.any_value("relation_applicable"), F.array(*map(F.lit, PROBES))).otherwise(F.array(*map(F.lit, CORE_PROBES)))
    rows = observations.groupBy(*keys).agg(F.array_sort(F.array_except(due, F.collect_set(F.when(F.col("valid"), F.col("probe"))))).alias("missing"))
    return rows.where(F.size("missing") > 0)


def with_labels(rows: DataFrame, labels: DataFrame, keys: list[str], columns: tuple[str, ...] = ("label6",)) -> DataFrame:
    """rows that have a label, with columns of it."""
    return rows.join(labels.select(*keys, *columns), keys)
