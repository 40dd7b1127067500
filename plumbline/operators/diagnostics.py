"""Quality of predicted source bits and labels: areas, F scores, losses, confusion, and areas under frontiers.

All are partial aggregates over rows; areas under curves come from counted values in ranges, so ties are exact and no group is
sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.labels import LABELS
from plumbline.operators.ranks import counted, running


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for b = 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def auroc(rows: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Per group: positives, negatives and the share of (positive, negative) pairs in the right order, ties as halves; null without either kind.

    The rank sum needs, for each distinct score, how many negatives are below it: one running sum over counted scores.
    """
    values = counted(rows, by, score, pos=positive.cast("long"))
    neg = F.col("n") - F.col("pos")
    below = running(values.select(*by, "x", "pos", neg.alias("neg")), by, ["x"], negatives=("sum", "neg"))
    won = below.groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (2 * F.col("negatives") + F.col("neg"))).alias("_twice"))
    return won.select(*by, "pos", "neg", F.try_divide(F.col("_twice").cast("double"), 2.0 * F.col("pos") * F.col("neg")).alias("auroc"))


def bit_quality(rows: DataFrame, by: list[str], bits: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per group: micro F1, macro F1 and Hamming loss over bits = {name: (true, predicted)}, in one aggregate."""
    counts = {}
    for name, (true, said) in bits.items():
        counts |= {f"tp_{name}": F.count_if(true & said), f"fp_{name}": F.count_if(~true & said), f"fn_{name}": F.count_if(true & ~said)}
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()])

    def over(kind: str) -> Column:
        return sum((F.col(f"{kind}_{b}") for b in bits), F.lit(0))

    macro = sum((f1(F.col(f"tp_{b}"), F.col(f"fp_{b}"), F.col(f"fn_{b}")) for b in bits), F.lit(0.0)) / len(bits)
    return sums.select(*by, "n", f1(over("tp"), over("fp"), over("fn")).alias("micro_f1"), macro.alias("macro_f1"), ratio(over("fp") + over("fn"), F.col("n") * len(bits)).alias("hamming"))


def confusion(rows: DataFrame, by: list[str], true: str, said: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Per group: a row for each pair of labels, true and said, with their count, 0 included. Rows with another label don't count."""
    known = rows.where(F.col(true).isin(*labels))
    counts = known.groupBy(*by, F.col(true).alias("true")).agg(*[F.count_if(F.col(said) == s).alias(f"_{i}") for i, s in enumerate(labels)])
    counts = counts.where(sum((F.col(f"_{i}") for i in range(len(labels))), F.lit(0)) > 0)  # on counts, as Spark makes said anew for a condition on rows
    wide = counts.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("true") == t, F.col(f"_{i}"))), F.lit(0)).alias(f"_{k}_{i}") for k, t in enumerate(labels) for i in range(len(labels))])
    cells = F.array(*[F.struct(F.lit(t).alias("true"), F.lit(s).alias("said"), F.col(f"_{k}_{i}").alias("n")) for k, t in enumerate(labels) for i, s in enumerate(labels)])
    return wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.true", "c.said", "c.n")


def label_quality(cells: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``confusion`` cells: accuracy, macro F1 over the labels that occur (true or said), and balanced accuracy over the true ones."""
    sides = cells.select(*by, F.explode(F.array(
        F.struct(F.col("true").alias("label"), F.when(F.col("true") == F.col("said"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("said"), F.col("n").alias("true")),
        F.struct(F.col("said").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("said"), F.lit(0).cast("long").alias("true")),
    )).alias("s")).select(*by, "s.*")
    each = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "said", "true")])
    own_f1 = F.when(F.col("true") + F.col("said") > 0, f1(F.col("tp"), F.col("said") - F.col("tp"), F.col("true") - F.col("tp")))
    recall = F.when(F.col("true") > 0, ratio(F.col("tp"), F.col("true")))
    return each.groupBy(*by).agg(F.sum("true").alias("n"), ratio(F.sum("tp"), F.sum("true")).alias("accuracy"), F.avg(own_f1).alias("macro_f1"), F.avg(recall).alias("balanced_accuracy"))


def frontier(points: DataFrame, by: list[str], cost: str, quality: str) -> DataFrame:
    """The points that no cheaper or equally cheap one reaches: of each cost the best quality, above that of all lower costs."""
    best = points.where(F.col(cost).isNotNull() & F.col(quality).isNotNull()).groupBy(*by, F.col(cost).alias("cost")).agg(F.max(quality).alias("quality"))
    seen = running(best, by, ["cost"], reached=("max", "quality"))
    return seen.where(F.col("reached").isNull() | (F.col("quality") > F.col("reached"))).drop("reached")


def area(points: DataFrame, by: list[str]) -> DataFrame:
    """Per group of (cost, quality) points with different costs: how many they are, and the area of the trapezoids between neighbours by cost.

    The point before is the largest of all earlier ones by cost, carried over the borders of ranges as such.
    """
    seen = running(points, by, ["cost"], last=("max", F.struct("cost", "quality")))
    part = (F.col("quality") + F.col("last.quality")) / 2 * (F.col("cost") - F.col("last.cost"))
    return seen.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum(part), F.lit(0.0)).alias("area"), F.min("cost").alias("least_cost"), F.max("cost").alias("most_cost"))
