"""Values of further probes on the lattice of acquired subsets, drift between permutations of a record, and distributions of costs.

Subsets and permutations of a record are few by definition, so they become arrays of its row: one aggregate by record, and all
pairs, neighbours and means are taken inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.labels import PROBES

LOSS_WEIGHT = 0.25
#: Permutations of one record; more are an error.
MOST_PERMUTATIONS = 64


def _limited(rows: Column, most: int, what: str) -> Column:
    return F.when(F.size(rows) > most, F.raise_error(F.lit(f"more than {most} {what}"))).otherwise(rows)


#: What a state has, beside its record's keys.
_STATE = ("mask", "set_size", "loss", "budget", "relation_applicable")


def _field(name: str):
    return lambda x: x[name]


def probe_values(states: DataFrame, keys: list[str], price: dict[str, float], rate: float, probes: tuple[str, ...] = PROBES, loss_weight: float = LOSS_WEIGHT) -> DataFrame:
    """``record_values`` of states that are rows: keys, mask (bit i for the i-th probe), set_size, loss, budget and ``relation_applicable``."""
    own = states.groupBy(*keys).agg(F.collect_list(F.struct(*_STATE)).alias("states"))
    return record_values(own.select(*keys, *[F.transform("states", _field(f)).alias(f) for f in _STATE]), keys, price, rate, probes, loss_weight)


def record_values(records: DataFrame, keys: list[str], price: dict[str, float], rate: float, probes: tuple[str, ...] = PROBES, loss_weight: float = LOSS_WEIGHT) -> DataFrame:
    """For each state S of a record: the value of every probe a that it lacks and can pay, how many they are, and what to do.

    records has a row for each record, with its states' columns (see ``probe_values``) as arrays in one order. The value of a is the fall in set size plus ``loss_weight``
    times the fall in loss from S to S with a, less ``rate`` times a's price. Only states that the record has can be reached. The best
    probe (the first of equals) is taken unless its value is 0 or less, or there is none: then the action is stop. A row's work is its own: nothing is shuffled.
    """
    masks = _limited(F.col("mask"), 1 << len(probes), "states of a record")
    masks = F.when(F.size(F.array_distinct(F.array_compact("mask"))) < F.size("mask"), F.raise_error(F.lit("a record's masks must differ"))).otherwise(masks)
    own = records.select(*keys, masks.alias("_masks"), *[F.col(f).alias(f"_{f}") for f in _STATE[1:]])
    rows = own.select("*", F.posexplode("_masks").alias("_at", "mask"))
    rows = rows.select(*keys, "_masks", "_set_size", "_loss", "mask", *[F.get(f"_{f}", F.col("_at")).alias(f) for f in _STATE[1:]])

    def place(i: int, name: str) -> Column:
        """Where the state after the i-th probe is, from 1; 0 or null where the probe can't be taken."""
        bit = F.lit(1 << i).cast("long")
        legal = (F.col("mask").bitwiseAND(bit) == 0) & (F.lit(price[name]) <= F.col("budget"))
        if name == "relation":
            legal = legal & F.col("relation_applicable")
        return F.when(legal, F.array_position("_masks", F.col("mask").bitwiseOR(bit)).cast("int"))

    def value(i: int, name: str) -> Column:
        after = F.col(f"_at{i}") - 1
        gain = (F.col("set_size") - F.get("_set_size", after)) + loss_weight * (F.col("loss") - F.get("_loss", after)) - rate * price[name]
        return F.when(F.col(f"_at{i}") > 0, F.struct(gain.cast("double").alias("value"), F.lit(-i).alias("order")))

    rows = rows.withColumns({f"_at{i}": place(i, n) for i, n in enumerate(probes)}).withColumns({f"_v{i}": value(i, n) for i, n in enumerate(probes)})
    found = {n: F.col(f"_v{i}") for i, n in enumerate(probes)}
    values = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("probe"), v["value"].alias("value"))) for n, v in found.items()]))
    n_legal = sum((v.isNotNull().cast("long") for v in found.values()), F.lit(0).cast("long"))
    done = rows.withColumns({"values": values, "n_legal": n_legal, "_best": F.array_max(F.array(*found.values()))})
    action = F.when(F.col("_best.value") > 0, F.get(F.array(*map(F.lit, probes)), -F.col("_best.order"))).otherwise("stop")
    return done.select(*keys, "mask", "values", "n_legal", action.alias("action"), F.col("_best.value").alias("best_value"))


def _mean(vectors: Column, i: Column) -> Column:
    return F.aggregate(vectors, F.lit(0.0), lambda a, v: a + F.get(v, i)) / F.size(vectors)


def jensen_shannon(p: Column, q: Column) -> Column:
    """The divergence of two arrays of probabilities, in nats."""

    def half(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log(x / m)).otherwise(0.0)

    parts = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) / 2 + half(b, (a + b) / 2) / 2)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def l1(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def l2_drift(vectors: Column, mean: Column, eps: float = 1e-8) -> Column:
    """The mean distance of vectors to their mean, relative to its length."""

    def size(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    apart = F.transform(vectors, lambda v: size(F.zip_with(v, mean, lambda a, b: a - b)) / (size(mean) + eps))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) / F.size(vectors)


def permutation_drift(rows: DataFrame, keys: list[str], number: str = "permutation", probs: str = "probs", bits: str = "bits", found: str = "set", action: str = "action", hidden: str = "hidden") -> DataFrame:
    """Per record: its permutations and how far their probabilities (Jensen-Shannon), bits (L1), sets (1 - Jaccard of pairs), actions and hidden states differ.

    The measures are means over permutations, or over their pairs r < s; the share of the commonest action is agreement. One
    permutation alone has no pair and disagrees with nothing.
    """
    each = F.struct(F.col(number).alias("r"), F.col(probs).alias("probs"), F.col(bits).alias("bits"), F.col(found).alias("set"), F.col(action).alias("action"), F.col(hidden).alias("hidden"))
    own = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(each)).alias("p"))
    own = own.withColumn("p", _limited(F.col("p"), MOST_PERMUTATIONS, "permutations of a record"))
    n = F.size("p")

    def mean_of(field: str) -> Column:
        vectors = F.transform("p", lambda x: x[field])
        return F.transform(F.get(vectors, F.lit(0)), lambda _, i: _mean(vectors, i))

    own = own.withColumns({f"_{f}": mean_of(f) for f in ("probs", "bits", "hidden")})
    js = F.aggregate("p", F.lit(0.0), lambda s, x: s + jensen_shannon(x["probs"], F.col("_probs"))) / n
    bit = F.aggregate("p", F.lit(0.0), lambda s, x: s + l1(x["bits"], F.col("_bits"))) / n
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: jaccard(x["set"], y["set"]))))
    alike = F.when(F.size(pairs) == 0, 1.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs))
    actions = F.transform("p", lambda x: x["action"])
    common = F.array_max(F.transform(F.array_distinct(actions), lambda a: F.size(F.filter(actions, lambda b: a.eqNullSafe(b)))))
    hid = l2_drift(F.transform("p", lambda x: x["hidden"]), F.col("_hidden"))
    return own.select(*keys, n.alias("permutations"), js.alias("js_drift"), bit.alias("bit_drift"), (1 - alike).alias("set_disagreement"), (common / n).alias("action_agreement"), hid.alias("hidden_drift"))


def calibration_drift(rows: DataFrame, by: list[str], number: str = "permutation", found: str = "set", label: str = "label6") -> DataFrame:
    """Per group: the range, over permutation numbers, of the sets' coverage and of their mean size."""
    n = F.count(F.lit(1))
    each = rows.groupBy(*by, number).agg((F.count_if(F.array_contains(found, F.col(label))) / n).alias("coverage"), (F.sum(F.size(found)) / n).alias("size"))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("permutations"), (F.max("coverage") - F.min("coverage")).alias("coverage_range"), (F.max("size") - F.min("size")).alias("size_range"))


#: Each power of two is cut into so many bins (as a power), so a bin's edges differ by 1/16 of its value at most.
CUTS = 4


def log_bin(value: Column, cuts: int = CUTS) -> Column:
    """The number of a value's bin: whole numbers below 2^cuts have their own, higher ones share one of 2^cuts bins between powers of two.

    value must be a whole number of at least 0. The number comes from the highest bit and the cuts bits below it, so bins are exact.
    """
    high = F.length(F.bin(value)) - 1
    return F.when(value < (1 << cuts), value).otherwise((high - cuts) * (1 << cuts) + F.call_function("shiftright", value, high - cuts)).cast("long")


def bin_edges(number: Column, cuts: int = CUTS) -> tuple[Column, Column]:
    """The least and the largest whole number of a bin."""
    one, level = F.lit(1).cast("long"), F.greatest(F.floor(number / (1 << cuts)) - 1, F.lit(0)).cast("int")
    base = F.when(number < (1 << cuts), number).otherwise(number % (1 << cuts) + (1 << cuts)).cast("long")
    low = F.call_function("shiftleft", base, level)
    return low, low + F.call_function("shiftleft", one, level) - 1


def sketch(rows: DataFrame, by: list[str], value: Column, cuts: int = CUTS) -> DataFrame:
    """Per group and bin of whole numbers: n. Sketches of parts are merged by adding n, whatever the parts; negative and null values are left out."""
    whole = value.cast("long")
    return rows.where(whole >= 0).groupBy(*by, log_bin(whole, cuts).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merged(*sketches: DataFrame, by: list[str]) -> DataFrame:
    both = sketches[0]
    for s in sketches[1:]:
        both = both.unionByName(s)
    return both.groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def sketch_quantiles(counts: DataFrame, by: list[str], ps: tuple[float, ...], cuts: int = CUTS) -> DataFrame:
    """Per group and share p: n and the edges between which the value at place floor(p (n - 1)) from 0 lies, exactly.

    A group has some 60 * 2^cuts bins at most, so they are an array of its row. Either edge is off by at most 1 / 2^cuts of the value.
    """
    own = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("b"), F.sum("n").alias("n"))

    def at(p: float) -> Column:
        place = F.floor(F.lit(p) * (F.col("n") - 1))
        first = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))
        return F.aggregate("b", first, lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["bin"].isNull() & (a["seen"] + x["n"] > place), x["bin"]).otherwise(a["bin"]).alias("bin")))["bin"]

    each = own.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), at(p).alias("bin")) for p in ps])).alias("e")).select(*by, "n", "e.p", "e.bin")
    low, high = bin_edges(F.col("bin"), cuts)
    return each.select(*by, "n", "p", low.alias("low"), high.alias("high"))


def edge_counts(rows: DataFrame, by: list[str], value: str, edges: tuple[float, ...]) -> DataFrame:
    """Per group: rows in each range between neighbouring edges (the lower one inside), and below and above all of them, 0 included."""
    v = F.col(value)
    bounds = [None, *edges, None]
    tests = [((v >= a) if a is not None else F.lit(True)) & ((v < b) if b is not None else F.lit(True)) for a, b in zip(bounds, bounds[1:], strict=False)]
    own = rows.where(v.isNotNull()).groupBy(*by).agg(*[F.count_if(t).alias(f"_{i}") for i, t in enumerate(tests)])
    each = F.array(*[F.struct(F.lit(a).cast("double").alias("low"), F.lit(b).cast("double").alias("high"), F.col(f"_{i}").alias("n")) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))])
    return own.select(*by, F.explode(each).alias("e")).select(*by, "e.low", "e.high", "e.n")


def policy_cost(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per group of runs (probes taken, stopped, policy_ms, clean_ms): mean number of probes, share that stopped, and latency over that of clean passes."""
    n = F.count(F.lit(1))
    return runs.groupBy(*by).agg(n.alias("n"), (F.sum(F.size("probes")) / n).alias("mean_passes"), (F.count_if("stopped") / n).alias("stop_share"), F.try_divide(F.sum("policy_ms"), F.sum("clean_ms")).alias("latency_ratio"))


def action_counts(runs: DataFrame, by: list[str], probes: tuple[str, ...] = PROBES) -> DataFrame:
    """Per group and action, stop included: how many runs took it, 0 where none did."""
    own = runs.groupBy(*by).agg(*[F.count_if(F.array_contains("probes", p)).alias(p) for p in probes], F.count_if("stopped").alias("stop"))
    each = F.array(*[F.struct(F.lit(p).alias("action"), F.col(p).alias("n")) for p in (*probes, "stop")])
    return own.select(*by, F.explode(each).alias("e")).select(*by, "e.action", "e.n")


def fix_and_break(rows: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """Per group: accuracy before and after, the share of wrong rows that became right, and of right rows that became wrong; null without any."""
    b, a, n = F.col(before), F.col(after), F.count(F.lit(1))
    return rows.where(b.isNotNull() & a.isNotNull()).groupBy(*by).agg(
        n.alias("n"), (F.count_if(b) / n).alias("accuracy_before"), (F.count_if(a) / n).alias("accuracy_after"),
        F.try_divide(F.count_if(~b & a), F.count_if(~b)).alias("fix_rate"), F.try_divide(F.count_if(b & ~a), F.count_if(b)).alias("break_rate"),
    )
