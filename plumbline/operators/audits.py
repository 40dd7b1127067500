"""Reports over labels and observations: distributions, confounds, severities, calibration and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.labels import LABELS
from plumbline.operators.ranks import counted, join_small
from plumbline.operators.ranks import order_statistics as order_statistics_of


def dense_labels(labels: DataFrame, slices: list[str]) -> DataFrame:
    """count and fraction for every observed slice and every label, 0 where there is none."""
    per_slice = labels.groupBy(*slices).agg(*[F.count_if(F.col("label6") == name).alias(name) for name in LABELS], F.count(F.lit(1)).alias("total"))
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("label6"), F.col(f"`{n}`").alias("count")) for n in LABELS]))
    return per_slice.select(*slices, "total", entries.alias("e")).select(*slices, "e.label6", "e.count", (F.col("e.count") / F.col("total")).alias("fraction"))


def dense_bits(labels: DataFrame, slices: list[str]) -> DataFrame:
    bits = {"visual": "bit_v", "language": "bit_l", "alignment": "bit_a"}
    per_slice = labels.groupBy(*slices).agg(*[F.count_if(F.col(c)).alias(n) for n, c in bits.items()], F.count(F.lit(1)).alias("total"))
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("bit"), F.col(n).alias("positive")) for n in bits]))
    rows = per_slice.select(*slices, "total", entries.alias("e")).select(*slices, "e.bit", "e.positive", "total")
    return rows.select(*slices, "bit", "positive", (F.col("total") - F.col("positive")).alias("negative"), (F.col("positive") / F.col("total")).alias("fraction"))


def dominant_class(labels: DataFrame, slices: list[str], limit: float = 0.8) -> DataFrame:
    """The commonest label of each slice (the first by name among equals) and whether its share is above the limit."""
    best = dense_labels(labels, slices).groupBy(*slices).agg(F.max_by("label6", F.struct("fraction", -F.array_position(F.lit(sorted(LABELS)), F.col("label6")))).alias("label6"), F.max("fraction").alias("fraction"))
    return best.withColumn("too_common", F.col("fraction") > limit)


def low_support(labels: DataFrame, slices: list[str], least: int = 5) -> DataFrame:
    rows = dense_bits(labels, slices)
    return rows.select(*slices, "bit", F.least("positive", "negative").alias("support"), (F.least("positive", "negative") < least).alias("too_few"))


def confounds(labels: DataFrame) -> DataFrame:
    """By dataset, by model and in all: rows and the rates of the relation flag and the bits, in one pass."""
    sets = labels.groupingSets([["dataset"], ["model_id"], []], "dataset", "model_id")
    rates = [F.avg(F.col(c).cast("int")).alias(n) for n, c in (("relation_rate", "relation_applicable"), ("visual_rate", "bit_v"), ("language_rate", "bit_l"), ("alignment_rate", "bit_a"))]
    return sets.agg(F.grouping_id().cast("long").alias("grain"), F.count(F.lit(1)).alias("n"), *rates)


def label_shares(labels: DataFrame, by: str) -> DataFrame:
    """Shares of the labels that occur; a missing slice or label is 'unknown'."""
    rows = labels.select(F.coalesce(by, F.lit("unknown")).alias(by), F.coalesce("label6", F.lit("unknown")).alias("label6"))
    counts = rows.groupBy(by, "label6").count()
    totals = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, by).select(by, "label6", "count", (F.col("count") / F.col("total")).alias("share"))


def severity_stats(grid: DataFrame, saturated: float = 0.9) -> DataFrame:
    """Per probe and severity: rates over valid rows, and the rates of saturated and invalid rows."""
    ok = F.col("valid")
    n_valid = F.count_if(ok)
    return grid.groupBy("probe", "severity").agg(
        F.count(F.lit(1)).alias("n"), n_valid.alias("n_valid"), F.coalesce(F.avg(F.when(ok, F.col("flip").cast("int"))), F.lit(0.0)).alias("flip_rate"),
        F.coalesce(F.avg(F.when(ok, F.abs("conf_shift"))), F.lit(0.0)).alias("mean_shift"),
        (F.count_if(ok & (F.abs("conf_shift") > saturated)) / F.greatest(n_valid, F.lit(1))).alias("saturation"),
        (F.count_if(~ok) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("invalid_rate"), F.avg(F.when(ok, F.col("probe_ms"))).alias("mean_ms"),
    )


def grid_counts(grid: DataFrame, slices: list[str]) -> DataFrame:
    """Per slice, probe and severity: rows, valid ones, instances, and whether each instance is there once."""
    n, own = F.count(F.lit(1)), F.count_distinct("instance_id")
    return grid.groupBy(*slices, "probe", "severity").agg(n.alias("n"), F.count_if("valid").alias("n_valid"), own.alias("instances"), (n == own).alias("each_once"))


def order_statistics(rows: DataFrame, value: str, by: list[str], ps: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Mean, population deviation and the entries at floor(p (n - 1)) of every group, exact.

    Equal values are counted before they are placed, and places come from ranges of a group's values, so neither a group that holds most
    rows nor a value that most rows share is one task's work. Mean and deviation are weighted sums over the counted values, the
    deviation around the mean.
    """
    counts = counted(rows, by, value)
    places = {f"p{round(p * 100)}": (lambda n, p=p: F.floor(F.lit(p) * (n - 1)) + 1) for p in ps}
    found = order_statistics_of(counts, by, **places)
    sums = counts.groupBy(*by).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"))
    apart = join_small(counts, sums.select(*by, "mean"), by, "inner").groupBy(*by).agg(F.sqrt(F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean"), 2)) / F.sum("n")).alias("std"))
    both = join_small(join_small(found, sums, by), apart, by)
    return both.select(*by, "n", "mean", "std", "least", "most", *places)


def first_severity(stats: DataFrame) -> DataFrame:
    """Each probe's numbers at its least severity."""
    own = F.min_by(F.struct("severity", "flip_rate", "mean_shift"), F.coalesce("severity", F.lit(0.0)))
    return stats.groupBy("probe").agg(own.alias("s")).select("probe", "s.severity", "s.flip_rate", F.abs("s.mean_shift").alias("mean_abs_shift"))


def choose_severity(stats: DataFrame, fallback: DataFrame, invalid: float = 0.05, saturation: float = 0.15, band: tuple[float, float] = (0.15, 0.40), aim: float = 0.25) -> DataFrame:
    """Per probe of fallback (probe, severity): the passing severity with a flip rate in the band, or else any passing one, nearest to the aim; the fallback if none passes."""
    passing = stats.where((F.col("invalid_rate") <= invalid) & (F.col("saturation") <= saturation))
    rank = F.struct((~F.col("flip_rate").between(*band)).alias("outside"), F.abs(F.col("flip_rate") - aim).alias("miss"), F.col("severity").alias("s"))
    best = passing.groupBy("probe").agg(F.min_by("severity", rank).alias("chosen"))
    return fallback.join(best, "probe", "left").select("probe", F.coalesce("chosen", "severity").alias("severity"), F.col("chosen").isNull().alias("by_default"))


def run_estimates(observations: DataFrame, clean: DataFrame, models: int) -> DataFrame:
    """Mean seconds of a pass, mean passes of an instance and model, and both multiplied out for a number of models."""
    ms = observations.where(F.col("applicable") & (F.col("probe_ms") > 0)).select("probe_ms").unionByName(clean.where("latency_ms > 0").select(F.col("latency_ms").alias("probe_ms")))
    speed = ms.agg((F.avg("probe_ms") / 1000).alias("pass_s"))
    passes = clean.agg((F.count(F.lit(1)) * 7 + F.count_if("relation_applicable")).alias("passes"), F.count(F.lit(1)).alias("rows"), F.count_distinct("model_id").alias("seen"))
    both = speed.crossJoin(passes)  # one row by one row
    whole = F.col("passes") / F.col("seen") * models
    return both.select("pass_s", (F.col("passes") / F.col("rows")).alias("passes_per_row"), whole.alias("planned_passes"), (whole * F.col("pass_s") / 3600).alias("hours"))


def majority(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The commonest value of each group, the earliest among equals, its count, and how many values share that count.

    Three aggregates with partial sums and no join: by value, by count, by group.
    """
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    level = counts.groupBy(group, "n").agg(F.min_by(value, "at").alias("winner"), F.count(F.lit(1)).alias("tied"))
    return level.groupBy(group).agg(F.max(F.struct("n", "winner", "tied")).alias("b")).select(group, "b.winner", "b.n", "b.tied")


TAUS = tuple(i / 100 for i in range(50, 95, 2))


def threshold_table(pairs: DataFrame, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """Precision, recall and F1 of (similarity, match) at every one of the ascending thresholds.

    A pair counts once, under the number of thresholds that it reaches; the few sums are then added up from the top.
    """
    level = F.lit(0)
    for t in taus:
        level = level + (F.col("similarity") >= t).cast("int")
    sums = pairs.where("similarity is not null").groupBy(level.alias("level")).agg(F.count_if("match").alias("pos"), F.count_if(~F.col("match")).alias("neg"))
    one = sums.agg(F.collect_list(F.struct("level", "pos", "neg")).alias("s"))  # a row for each threshold at most

    def added(name: str, above) -> Column:
        return F.aggregate(F.filter("s", lambda x: above(x["level"])), F.lit(0).cast("long"), lambda acc, x: acc + x[name])

    each = F.array(*[F.struct(F.lit(t).alias("tau"), added("pos", lambda x, k=k: x > k).alias("tp"), added("neg", lambda x, k=k: x > k).alias("fp"), added("pos", lambda x, k=k: x <= k).alias("fn")) for k, t in enumerate(taus)])
    rows = one.select(F.explode(each).alias("e")).select("e.*")
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return rows.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def calibrate(pairs: DataFrame, target_recall: float = 0.9, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """The threshold with the best F1 among those with enough recall, the lowest of equals."""
    ok = threshold_table(pairs, taus).where(F.col("recall") >= target_recall)
    return ok.orderBy(F.desc("f1"), "tau").limit(1)


def progress(clean: DataFrame, expected: int, models: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of every required model, none included, and the share of those expected; by further columns where rows have them."""
    seen = clean.where("clean_valid").groupBy("model_id", *by).agg(F.count_distinct("instance_id").alias("done"))
    wanted = clean.sparkSession.createDataFrame([(m,) for m in models], "model_id string")
    return wanted.join(seen, "model_id", "left").select("model_id", *by, F.coalesce("done", F.lit(0)).alias("done"), (F.coalesce("done", F.lit(0)) / F.lit(expected)).alias("share"))


def frozen_config(chosen: DataFrame, stats: DataFrame, thresholds: dict[str, float]) -> dict:
    """A configuration to freeze: the chosen severity of each probe with its numbers, and thresholds. chosen has a row for each probe."""
    own = chosen.join(stats.select("probe", "severity", "n_valid", "flip_rate", "saturation", "invalid_rate"), ["probe", "severity"], "left").orderBy("probe")
    severities = {r["probe"]: {k: r[k] for k in ("severity", "by_default", "n_valid", "flip_rate", "saturation", "invalid_rate")} for r in own.collect()}
    return {"severities": severities, "thresholds": dict(thresholds)}


def pilot_completeness(canonical: DataFrame, grid: DataFrame, datasets: tuple[str, ...], instances: int = 100, cells: int = 1200) -> DataFrame:
    """Per model: the datasets with enough canonical instances and severity cells, and whether those are all that are due."""
    c = canonical.groupBy("model_id", "dataset").agg(F.count_distinct("instance_id").alias("n_instances"))
    g = grid.groupBy("model_id", "dataset").agg(F.count_distinct("instance_id", "probe", "severity").alias("n_cells"))
    both = c.join(g, ["model_id", "dataset"], "full_outer").fillna(0, ["n_instances", "n_cells"])
    enough = (F.col("n_instances") >= instances) & (F.col("n_cells") >= cells) & F.col("dataset").isin(*datasets)
    return both.groupBy("model_id").agg(F.count_if(enough).alias("n_complete"), (F.count_if(enough) == len(datasets)).alias("complete"))


def enough_models(completeness: DataFrame, least: int = 2) -> DataFrame:
    """One row: how many models are complete, and whether they are enough."""
    n = F.count_if("complete")
    return completeness.agg(n.alias("n_models"), (n >= least).alias("enough"))


def gap_fires(full: Column, control: Column, threshold: float = 2.0) -> Column:
    """A control that comes within the threshold of the full model."""
    return (full - control) <= threshold


def completeness(clean: DataFrame, by: list[str], least: int) -> DataFrame:
    """Per group: the instances with a valid pass, and whether they are enough."""
    done = clean.groupBy(*by).agg(F.count_distinct(F.when(F.col("clean_valid"), F.col("instance_id"))).alias("done"))
    return done.withColumn("complete", F.col("done") >= least)


def readiness(manifest: DataFrame, by: list[str], models: int, probes: int = 7) -> DataFrame:
    """Per group: rows, rows with a relation, and the passes that so many models will take."""
    n, r = F.count(F.lit(1)), F.count_if("relation_applicable")
    return manifest.groupBy(*by).agg(n.alias("n"), r.alias("relation_rows"), (models * (probes * n + r)).alias("passes"))


def inventory(rows: DataFrame, listed: dict[str, str], counted: str, name: str) -> DataFrame:
    """One row: the sorted distinct values of columns with few of them (name: column), the distinct values of another one, and all rows."""
    sets = [F.array_sort(F.collect_set(c)).alias(n) for n, c in listed.items()]
    return rows.agg(*sets, F.count_distinct(counted).alias(name), F.count(F.lit(1)).alias("n"))
