"""Acquiring probes one after the other: which events of a record are accepted, and what budget they leave.

The rules, in their order: stop is no probe, a probe that isn't known can't be had, a probe is acquired once, and its price must not exceed the
budget left. The budget never grows, so only a probe's first event can be accepted, and a later one is refused for the same
reason as before, or as a repetition. So each record has a handful of first events, folded inside its row, whatever the number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import skew_join

# fixed values
STOP = "stop"
PRICES = {"blank": 1, "blur": 1, "crop": 1, "brightness": 1, "noise": 1, "grounding": 1, "relation": 1}
# end of fixed values
ACCEPTED, IS_STOP, UNKNOWN, REPEATED, TOO_DEAR = "accepted", "stop is no probe", "the probe is unknown", "the probe is acquired already", "the budget is too small"


def decide(probe: str | None, acquired: dict[str, int], budget: int, prices: dict[str, int] = PRICES) -> tuple[str, int]:
    """The outcome of one event and the budget after it; acquired is left as it is."""
    if probe == STOP:
        return IS_STOP, budget
    if probe not in prices:
        return UNKNOWN, budget
    if probe in acquired:
        return REPEATED, budget
    if prices[probe] > budget:
        return TOO_DEAR, budget
    return ACCEPTED, budget - prices[probe]


def acquisitions(events: DataFrame, keys: list[str], order: str, budget: int | Column, prices: dict[str, int] = PRICES) -> DataFrame:
    """events (keys, order, probe) with outcome, and the budget left and the probes acquired after it, in their order.

    budget is a number or a column that is the same for all events of a record. Orders are not null and differ within a record.
    """
    money = F.lit(budget) if isinstance(budget, int) else budget
    own = events.select(*keys, F.col(order).alias("_at"), F.col("probe").alias("_p"), money.cast("long").alias("_m"))
    known = own.where(F.col("_p").isin(*prices))
    firsts = known.groupBy(*keys, "_p").agg(F.min("_at").alias("_at"), F.max("_m").alias("_m"))
    price = F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])
    rows = firsts.groupBy(*keys).agg(F.max("_m").alias("_m"), F.array_sort(F.collect_list(F.struct("_at", "_p"))).alias("_e"))  # one for each probe
    kind = dict(rows.dtypes)["_e"].removeprefix("array<").removesuffix(">")
    start = F.struct(F.col("_m").alias("left"), F.array().cast("array<string>").alias("had"), F.array().cast(f"array<struct<event:{kind},ok:boolean,left:bigint,had:array<string>>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        cost = F.element_at(price, e["_p"]).cast("long")
        ok = cost <= a["left"]
        left = F.when(ok, a["left"] - cost).otherwise(a["left"])
        had = F.when(ok, F.concat(a["had"], F.array(e["_p"]))).otherwise(a["had"])
        return F.struct(left.alias("left"), had.alias("had"), F.concat(a["out"], F.array(F.struct(e.alias("event"), ok.alias("ok"), left.alias("left"), had.alias("had")))).alias("out"))

    folded = rows.select(*keys, F.aggregate("_e", start, step)["out"].alias("_steps"))
    both = skew_join(events.withColumn("_m", money.cast("long")), folded, keys, "left")
    own_step = F.get(F.filter("_steps", lambda s: s["event"]["_p"] == F.col("probe")), F.lit(0))
    passed = F.filter("_steps", lambda s: s["event"]["_at"] <= F.col(order))
    last = F.try_element_at(passed, F.lit(-1))
    outcome = (
        F.when(F.col("probe") == STOP, IS_STOP)
        .when(own_step.isNull(), UNKNOWN)
        .when(own_step["ok"] & (own_step["event"]["_at"] < F.col(order)), REPEATED)
        .when(own_step["ok"], ACCEPTED)
        .otherwise(TOO_DEAR)
    )
    done = both.withColumns({"outcome": outcome, "budget_left": F.coalesce(last["left"], "_m"), "acquired": F.coalesce(last["had"], F.array().cast("array<string>"))})
    return done.drop("_m", "_steps")
