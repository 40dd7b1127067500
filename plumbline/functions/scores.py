"""Scores over arrays of token log-probabilities and distributions, and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    """Null for an empty array."""
    return total(values) / F.when(F.size(values) > 0, F.size(values))


def _mean_of(values: Column, f) -> Column:
    """The mean of f over an array; its length is that of the array, so f's values are made once."""
    return total(F.transform(values, f)) / F.when(F.size(values) > 0, F.size(values))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def confidence(logprobs: Column) -> Column:
    """exp(mean), at most 1; null where it isn't defined: no values, a non-finite one, or a result above 1.0001."""
    raw = F.exp(mean(logprobs))
    fine = (F.size(logprobs) > 0) & F.forall(logprobs, finite) & (raw <= 1.0001)
    return F.when(fine, F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def answer_logprob(logprobs: Column) -> Column:
    return total(logprobs)


def entropy(distributions: Column) -> Column:
    """Mean over positions of -sum p ln p, over an array of maps from token to probability; 0 terms where p is not positive."""

    def one(d: Column) -> Column:
        return -F.aggregate(F.map_values(d), F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(p)).otherwise(0.0))

    return _mean_of(distributions, one)


def margin(distributions: Column) -> Column:
    """Mean over positions of the best probability less the second one, which is 0 if there is none."""

    def one(d: Column) -> Column:
        first_two = F.transform(F.array(F.sort_array(F.map_values(d), asc=False)), lambda best: F.coalesce(F.get(best, F.lit(0)), F.lit(0.0)) - F.coalesce(F.get(best, F.lit(1)), F.lit(0.0)))
        return F.get(first_two, F.lit(0))  # sorted once

    return _mean_of(distributions, one)


#: Longer vectors are multiplied by an array function rather than by an expression with a term for each component.
UNROLLED = 256


def dot(a: Column, b: Column, dims: int | None = None) -> Column:
    """The inner product, summed up from the first component on. With dims, the length of all vectors, it is plain arithmetic that Spark compiles."""
    if dims is None or dims > UNROLLED:
        return total(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")))
    sum_ = F.lit(0.0)
    for i in range(dims):
        sum_ = sum_ + F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double")
    return sum_


def cosine(a: Column, b: Column, sizes: Column | None = None, dims: int | None = None) -> Column:
    """Within [-1, 1]; null if a vector is null or has no length. sizes is the product of the norms where it is known, dims the length of all vectors."""
    if sizes is None:
        sizes = F.sqrt(dot(a, a, dims)) * F.sqrt(dot(b, b, dims))
    return F.least(F.greatest(dot(a, b, dims) / F.when(sizes > 0, sizes), F.lit(-1.0)), F.lit(1.0))


def common_length(vectors: DataFrame, column: str) -> int | None:
    """The length of a table's vectors if all have the same, by one aggregate."""
    low, high = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    return low if low == high else None


def last(values: Column, k: Column) -> Column:
    """The last k entries, or all if there are fewer."""
    n = F.least(k, F.size(values))
    return F.when(n > 0, F.slice(values, F.size(values) - n + 1, n)).otherwise(F.slice(values, 1, 0))


def percentile(values: Column, p: float) -> Column:
    """Of a sorted array, the entry at floor(p (n - 1)); 0 if it is empty."""
    at = F.floor(F.lit(p) * (F.size(values) - 1)).cast("int")
    return F.when(F.size(values) > 0, F.get(values, at)).otherwise(0.0)


def semantic_match(prediction: Column, reference: Column, binary: Column, similarity: Column, tau: float = 0.82) -> Column:
    """1 or 0: equal normalised answers match; else binary answers don't; else the similarity decides. Null without one."""
    void = prediction.isin("", "unknown", "invalid") | reference.isin("", "unknown", "invalid")
    return F.when((prediction == reference) & ~void, 1).when(binary | void, 0).when(similarity.isNotNull(), (similarity >= tau).cast("int"))


def reference_match(prediction: Column, references: Column, similarities: Column, fallback: Column, tau: float = 0.82) -> Column:
    """1 if the answer equals any reference, or, where a fallback is allowed, is as similar to one."""
    return F.when(F.exists(references, lambda r: r == prediction), 1).when(fallback, F.exists(similarities, lambda s: s >= tau).cast("int")).otherwise(0)
