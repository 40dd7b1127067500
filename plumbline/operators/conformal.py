"""Conformal sets of labels: scores, thresholds for each budget and error rate, sets, and how well they cover.

A row has an array of label probabilities in the order of the labels. Sets are made inside the row; a threshold is one order
statistic of its group, found by counted values and range ranks, however large the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.labels import LABELS
from plumbline.operators.ranks import counted, join_small, order_statistics

#: Error rates in thousandths, so that ranks are whole numbers.
ALPHAS = (100, 50)


def ranked(probs: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The labels from likely to unlikely, the first by name order among equals, each with the sum of probabilities up to it: array<struct<p, label, cum>>."""
    names = F.array(*map(F.lit, labels))
    ordered = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("low"), i.alias("i"), p.alias("p"))))
    first = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<p:double,label:string,cum:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        total = a["sum"] + x["p"]
        entry = F.struct(x["p"].alias("p"), F.get(names, x["i"]).alias("label"), total.alias("cum"))
        return F.struct(total.alias("sum"), F.concat(a["out"], F.array(entry)).alias("out"))

    return F.aggregate(ordered, first, step)["out"]  # probs stands in it once, so it is computed once


def likeliest(probs: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The first label of ``ranked``, without ranking the others."""
    return F.get(F.array(*map(F.lit, labels)), F.array_position(probs, F.array_max(probs)).cast("int") - 1)


def true_score(probs: Column, label: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The sum of probabilities down to the true label; null for a label that isn't one."""
    return F.get(F.filter(ranked(probs, labels), lambda x: x["label"] == label), F.lit(0))["cum"]


def thresholds(calibration: DataFrame, by: list[str], alphas: tuple[int, ...] = ALPHAS, probs: str = "probs", label: str = "label6") -> DataFrame:
    """by, n, alpha (a fraction) and q: the score at place ceil((n + 1)(1 - alpha)), or the largest. Rows without a known label don't count."""
    scored = calibration.select(*by, true_score(F.col(probs), F.col(label)).alias("score"))

    def place(a: int):
        return lambda n: F.least(n, F.floor(((n + 1) * (1000 - a) + 999) / 1000))

    found = order_statistics(counted(scored, by, "score"), by, **{f"q{a}": place(a) for a in alphas})
    each = F.explode(F.array(*[F.struct(F.lit(a / 1000).alias("alpha"), F.col(f"q{a}").alias("q")) for a in alphas]))
    return found.select(*by, "n", each.alias("e")).select(*by, "n", "e.alpha", "e.q")


def sets(rows: DataFrame, limits: DataFrame, by: list[str], alphas: tuple[int, ...] = ALPHAS, probs: str = "probs") -> DataFrame:
    """rows for each error rate, with alpha and the set of labels whose sum of probabilities is at most the group's threshold, likely ones first.

    A group without a threshold has all labels: nothing there says that one can be left out.
    """
    each = rows.withColumn("alpha", F.explode(F.array(*[F.lit(a / 1000) for a in alphas])))
    both = join_small(each, limits.select(*by, "alpha", "q"), [*by, "alpha"])
    inside = F.filter(ranked(F.col(probs)), lambda x: F.col("q").isNull() | (x["cum"] <= F.col("q")))
    return both.withColumn("set", F.transform(inside, lambda x: x["label"])).drop("q")


def set_quality(found: DataFrame, by: list[str], label: str = "label6") -> DataFrame:
    """Per group: rows, coverage and its gap to 1 - alpha, mean size, shares of singletons and of empty sets. by must hold alpha."""
    n, size, hit = F.count(F.lit(1)), F.size("set"), F.array_contains("set", F.col(label))
    coverage = F.count_if(hit) / n
    return found.groupBy(*by).agg(
        n.alias("n"), coverage.alias("coverage"), (coverage - (1 - F.any_value("alpha"))).alias("gap"), (F.sum(size) / n).alias("mean_size"),
        (F.count_if(size == 1) / n).alias("singletons"), (F.count_if(size == 0) / n).alias("empty"),
    )


def class_coverage(found: DataFrame, by: list[str], label: str = "label6") -> DataFrame:
    """Per group and true label: rows and coverage."""
    n = F.count(F.lit(1))
    return found.groupBy(*by, label).agg(n.alias("n"), (F.count_if(F.array_contains("set", F.col(label))) / n).alias("coverage"))


def set_sizes(found: DataFrame, by: list[str], labels: int = len(LABELS)) -> DataFrame:
    """Per group and every size from none to all: rows, 0 where there are none."""
    own = found.groupBy(*by).agg(*[F.count_if(F.size("set") == k).alias(f"_{k}") for k in range(labels + 1)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("size"), F.col(f"_{k}").alias("n")) for k in range(labels + 1)]))
    return own.select(*by, each.alias("e")).select(*by, "e.size", "e.n")
