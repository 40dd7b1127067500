"""Features of a pass from its token scores, closed to failure: what can't be computed is invalid with a reason, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.scores import answer_logprob, confidence, entropy, finite, margin

# fixed values
MISSING, FAILED, PROBE_FAILED = "missing_scores_or_distributions", "score_computation_error", "score_computation_failed"
# end of fixed values


def _scores(logprobs: Column, distributions: Column) -> tuple[dict[str, Column], Column]:
    """The three scores, and whether all of them are defined and finite."""
    found = {"prob": confidence(logprobs), "entropy": entropy(distributions), "margin": margin(distributions)}
    probabilities = F.forall(distributions, lambda d: (F.size(d) > 0) & F.forall(F.map_values(d), lambda p: finite(p) & (p >= 0)))
    ok = F.coalesce(finite(found["prob"]) & finite(found["entropy"]) & finite(found["margin"]) & probabilities, F.lit(False))
    return found, ok


def clean_features(logprobs: Column, distributions: Column, valid: Column, reason: Column, length: Column | None = None) -> Column:
    """struct<answer_prob, token_entropy_mean, token_margin_mean, answer_len_tokens, answer_logprob, valid, invalid_reason> of a clean pass.

    A pass that is given as invalid keeps its reason; one without scores or with scores that aren't probabilities is invalid.
    An invalid pass has zeros, and negative infinity as its log-probability.
    """
    found, ok = _scores(logprobs, distributions)
    given = F.coalesce(valid, F.lit(False))
    there = (F.coalesce(F.size(logprobs), F.lit(0)) > 0) & (F.coalesce(F.size(distributions), F.lit(0)) > 0)
    fine = given & there & ok
    n = F.size(logprobs) if length is None else F.coalesce(length, F.size(logprobs))

    def value(x: Column, void: float | int) -> Column:
        return F.when(fine, x).otherwise(F.lit(void))

    return F.struct(
        value(found["prob"], 0.0).alias("answer_prob"), value(found["entropy"], 0.0).alias("token_entropy_mean"), value(found["margin"], 0.0).alias("token_margin_mean"), value(n, 0).alias("answer_len_tokens"),
        value(answer_logprob(logprobs), float("-inf")).alias("answer_logprob"), fine.alias("valid"), F.when(~given, reason).when(~there, MISSING).when(~ok, FAILED).alias("invalid_reason"),
    )


def probe_features(logprobs: Column, distributions: Column, norm: Column, clean: Column, clean_norm: Column, semantic: Column, valid: Column, reason: Column) -> Column:
    """What a probe changed: its scores less the clean ones, whether the answer flipped, and whether it matches exactly or by meaning.

    clean is a struct of ``clean_features``. A probe that is invalid, or whose scores can't be computed, has no flip and zeros.
    """
    found, ok = _scores(logprobs, distributions)
    given = F.coalesce(valid, F.lit(False))
    fine = given & ok
    same = norm == clean_norm

    def less(name: str, base: str) -> Column:
        return F.when(fine, found[name] - clean[base]).otherwise(0.0)

    return F.struct(
        F.when(fine, ~same).otherwise(False).alias("flip"), less("prob", "answer_prob").alias("conf_shift"), less("entropy", "token_entropy_mean").alias("entropy_shift"), less("margin", "token_margin_mean").alias("margin_shift"),
        F.when(fine & same, 1.0).otherwise(0.0).alias("exact_match"), F.when(fine, semantic.cast("double")).otherwise(0.0).alias("semantic_match"), fine.alias("valid"), F.when(~given, reason).when(~ok, PROBE_FAILED).alias("invalid_reason"),
    )


def lenient(logprobs: Column, distributions: Column) -> Column:
    """Confidence, entropy and margin that are 0 where there is nothing, without any check; and what a check would say of them."""
    mean = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(logprobs) > 0, F.size(logprobs))
    once = F.struct(F.coalesce(F.exp(mean), F.lit(0.0)).alias("p"), F.coalesce(entropy(distributions), F.lit(0.0)).alias("e"), F.coalesce(margin(distributions), F.lit(0.0)).alias("m"))

    def judged(v: Column) -> Column:
        p, e, m = v["p"], v["e"], v["m"]
        issues = [
            F.when(~finite(p) | ~p.between(0, 1.0001), "confidence"), F.when(~finite(e) | (e < 0), "entropy"), F.when(~finite(m) | ~m.between(0, 1.0001), "margin"),
        ]
        return F.struct(p.alias("confidence"), e.alias("entropy"), m.alias("margin"), F.array_compact(F.array(*issues)).alias("issues"))

    return F.get(F.transform(F.array(once), judged), F.lit(0))  # each score is computed once, though checks and values use it many times


def python_float(x: Column) -> Column:
    """A double as Python writes it; outside of 0.001 to 10,000,000, where the two notations part, it is an error."""
    size = F.abs(x)
    return F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), x.cast("double").cast("string")).otherwise(F.raise_error(F.lit("the number's notation isn't defined")))


def spec_digest(**fields: Column) -> Column:
    """sha256 of a flat JSON object with sorted names. Fields are JSON text already: ``python_float``, a cast integer, or ``quoted``."""
    entries = [F.concat(F.lit(f'"{name}": '), value) for name, value in sorted(fields.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *entries), F.lit("}")), 256)


def quoted(x: Column) -> Column:
    """Plain ASCII text as a JSON string."""
    return F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))


def transform_digest(probe: Column, severity: Column, seed: Column) -> Column:
    """Digest of an image transform: its name and its parameters. Null for probes that transform nothing."""
    number, name = python_float(severity), quoted(probe)
    return (
        F.when(probe == "blank", spec_digest(transform=name, fill_color=F.lit("[128, 128, 128]"))).when(probe == "blur", spec_digest(transform=name, sigma=number))
        .when(probe == "crop", spec_digest(transform=name, retain_fraction=number)).when(probe == "brightness", spec_digest(transform=name, factor=number))
        .when(probe == "noise", spec_digest(transform=name, sigma=number, seed=seed.cast("string")))
    )
