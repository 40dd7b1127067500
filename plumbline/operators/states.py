"""Partial-evidence states: subsets of legal probes, made and grouped row by row with array functions.

A row's tags never leave it: the fixed subsets and their tags are constants of the plan, the random ones are looked up in
them, so neither a shuffle nor a window is needed until the states are written.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import sha256_hex
from plumbline.operators.labels import CORE_PROBES, PROBES

# fixed values
ORDERS = {
    "blank_first": ("blank", "grounding", "blur", "crop", "brightness", "noise", "relation"),
    "visual_first": ("blur", "crop", "brightness", "noise", "blank", "grounding", "relation"),
    "grounding_first": ("grounding", "blank", "blur", "crop", "brightness", "noise", "relation"),
    "relation_first": ("relation", "grounding", "blank", "blur", "crop", "brightness", "noise"),
}
# end of fixed values
BUDGET, RANDOM, LARGEST = 7, 16, 4
_HEX = 64  # digits of a hash


def _names(names) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.expr("cast(array() as array<string>)")


def legal_probes(relation: Column) -> Column:
    return F.when(F.coalesce(relation, F.lit(False)), _names(PROBES)).otherwise(_names(CORE_PROBES))


def action_mask(acquired: Column, relation: Column) -> Column:
    """map<probe, 0/1>: whether a probe may still be asked for. Stopping is always possible."""
    open_ = [F.when(F.array_contains(acquired, p) | (F.lit(p == "relation") & ~F.coalesce(relation, F.lit(False))), 0).otherwise(1) for p in PROBES]
    return F.map_from_arrays(_names([*PROBES, "stop"]), F.array(*open_, F.lit(1)))


def affordable(acquired: Column, relation: Column, budget: Column) -> Column:
    """Probes that are legal, not acquired, and within the budget at a cost of 1 each; stop costs nothing."""
    left = F.filter(legal_probes(relation), lambda p: ~F.array_contains(acquired, p) & (budget >= 1))
    return F.concat(left, _names(["stop"]))


def _fixed(legal: tuple[str, ...]) -> list[tuple[str, str]]:
    """(subset, tag) of the empty set, the single probes and the prefixes of the four orders; a subset is its sorted names between bars."""
    tags = [((), "empty"), *(((p,), f"singleton:{p}") for p in legal)]
    for name, order in ORDERS.items():
        own = [p for p in order if p in legal]
        tags += [(tuple(own[:n]), f"prefix:{name}:{n}") for n in range(1, len(own) + 1)]
    return [("|".join(sorted(s)), t) for s, t in tags]


def fixed_tags(legal: tuple[str, ...]) -> tuple[str, ...]:
    """The tags of the fixed subsets of a record with these legal probes."""
    return tuple(t for _, t in _fixed(legal))


def random_tags(sizes: int = LARGEST, count: int = RANDOM) -> tuple[str, ...]:
    """The tags of the draws, whose sizes take turns."""
    return tuple(f"random:{d:02d}:size{d % sizes + 1}" for d in range(count))


RANDOM_TAGS = random_tags()


def _random(legal: tuple[str, ...], seed: int, count: int, model: Column, instance: Column) -> Column:
    """The draws of a row, array<struct<key,tag>>: sizes 1 to 4 in turn, within a size by the rank of a keyed hash."""
    sizes = range(1, min(LARGEST, len(legal)) + 1)
    own_key = F.concat_ws("|", F.lit(str(seed)), model, instance, F.lit(""))  # what a row's hashes have in common

    def drawn(prefix: Column) -> Column:
        parts = []
        for size in sizes:
            subsets = _names(["|".join(c) for c in combinations(sorted(legal), size)])
            ranked = F.sort_array(F.transform(subsets, lambda s: F.concat(sha256_hex(F.concat(prefix, s)), s)))
            tags = [t for d, t in enumerate(random_tags(len(sizes), count)) if d % len(sizes) == size - 1]
            named = _names(tags)
            parts.append(F.transform(F.slice(ranked, 1, len(tags)), _two(lambda x, i, named=named: F.struct(F.substr(x, F.lit(_HEX + 1)).alias("key"), F.get(named, i).alias("tag")))))
        return F.concat(*parts)

    return bound(own_key, drawn)


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def _two(f):
    """A lambda of exactly two parameters."""
    return lambda x, i: f(x, i)


def _is(name: str):
    return lambda x: x == name


def _subset(key: Column) -> Column:
    return F.when(key == "", _names(())).otherwise(F.split(key, r"\|"))


def _by_relation(f) -> Column:
    """f of the probes that are legal in a row."""
    return F.when(F.coalesce("relation_applicable", F.lit(False)), f(PROBES)).otherwise(f(CORE_PROBES))


def tags_of(seed: int = 42, count: int = RANDOM) -> Column:
    """All tags of a row, array<struct<key,tag>>; needs model_id, instance_id and relation_applicable."""

    def whole(legal: tuple[str, ...]) -> Column:
        fixed = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("tag")) for k, t in _fixed(legal)])
        return F.concat(fixed, _random(legal, seed, count, F.col("model_id"), F.col("instance_id")))

    return _by_relation(whole)


def states_of(seed: int = 42, count: int = RANDOM) -> Column:
    """The distinct subsets of a row with their sorted tags, array<struct<key,tags>>. A random draw is never drawn twice."""

    def whole(legal: tuple[str, ...]) -> Column:
        tags: dict[str, list[str]] = {}
        for key, tag in _fixed(legal):
            tags.setdefault(key, []).append(tag)
        fixed = F.array(*[F.struct(F.lit(k).alias("key"), _names(sorted(t)).alias("tags")) for k, t in tags.items()])
        draws = _random(legal, seed, count, F.col("model_id"), F.col("instance_id"))

        def merged(drawn: Column, own: Column) -> Column:
            """Fixed subsets with the draw that hit them, and the draws that hit none."""
            both = F.transform(fixed, lambda f: F.struct(f["key"].alias("key"), F.when(F.map_contains_key(own, f["key"]), F.sort_array(F.array_append(f["tags"], F.element_at(own, f["key"])))).otherwise(f["tags"]).alias("tags")))
            new = F.filter(drawn, lambda d: ~d["key"].isin(*tags))
            return F.concat(both, F.transform(new, lambda d: F.struct(d["key"].alias("key"), F.array(d["tag"]).alias("tags"))))

        return bound(draws, lambda drawn: bound(F.map_from_entries(drawn), lambda own: merged(drawn, own)))

    return _by_relation(whole)


def subset_tags(rows: DataFrame, seed: int = 42, count: int = RANDOM) -> DataFrame:
    """Every row once for each (subset, tag). rows needs model_id, instance_id and relation_applicable."""
    return rows.withColumn("t", F.explode(tags_of(seed, count))).select(*rows.columns, _subset(F.col("t.key")).alias("subset"), "t.tag")


def partial_states(rows: DataFrame, seed: int = 42, count: int = RANDOM) -> DataFrame:
    """One row for each distinct subset: its tags, the mask, and what is left of the budget."""
    each = rows.withColumn("t", F.explode(states_of(seed, count))).select(*rows.columns, _subset(F.col("t.key")).alias("subset"), "t.tags")
    return each.withColumns({"mask": action_mask(F.col("subset"), F.col("relation_applicable")), "remaining_budget": BUDGET - F.size("subset")})


def tag_coverage(rows: DataFrame, seed: int = 42, count: int = RANDOM) -> DataFrame:
    """Per row: how many tags there are, of each kind, and how many states."""
    both = rows.select("model_id", "instance_id", states_of(seed, count).alias("states"))
    both = both.select("model_id", "instance_id", F.size("states").cast("long").alias("n_states"), F.transform(F.flatten("states.tags"), lambda t: F.substring_index(t, ":", 1)).alias("kinds"))
    counts = [F.size(F.filter("kinds", _is(kind))).cast("long").alias(n) for n, kind in (("n_random", "random"), ("n_single", "singleton"), ("n_prefix", "prefix"))]
    return both.select("model_id", "instance_id", F.size("kinds").cast("long").alias("n_tags"), *counts, "n_states")


def acquired_observations(rows: DataFrame, observations: DataFrame, seed: int = 42, count: int = RANDOM) -> DataFrame:
    """The states of rows with the observations of their subsets, in the subsets' order. Rows meet their observations before they become states."""
    keys = ["model_id", "instance_id"]
    own = observations.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("probe", F.struct("flip", "conf_shift", "entropy_shift", "margin_shift", "semantic_match")))).alias("seen"))
    states = partial_states(rows.join(own, keys), seed, count)
    return states.withColumn("acquired", F.transform("subset", lambda p: F.struct(p.alias("probe"), F.col("seen")[p].alias("observed")))).drop("seen")
