"""Operators on predictions against plain computations on small fixtures, with ties, nulls, hot groups and empty tables."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import acquisition, conformal, diagnostics, joins, policy, quality, ranks, resampling, sampling
from plumbline.operators.labels import LABELS, PROBES
from plumbline.plans import metrics
from plumbline.plans.metrics import PRICES
from plumbline.sources import sinks
from tests.conftest import DATA


def test_running_totals_of_a_group_that_holds_most_rows(spark):
    random.seed(5)
    rows = [("hot", i, random.randint(-5, 5)) for i in range(4000)] + [(None, i, 1) for i in range(3)] + [("b", None, 7), ("b", 2, 8)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(7)
    got = ranks.running(df, ["g"], ["k"], before=("sum", "v"), most=("max", "v"), last=("max", F.struct("k", "v"))).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0)):
        by[r[0]].append(r)
    at = {(r.g, r.k): r for r in got}
    for own in by.values():
        for i, (g, k, _) in enumerate(own):
            earlier, r = own[:i], at[g, k]
            assert r.before == sum(x[2] for x in earlier)
            assert r.most == (max(x[2] for x in earlier) if earlier else None)
            assert (r["last"] and tuple(r["last"])) == (earlier[-1][1:] if earlier else None)
    with pytest.raises(ValueError):
        ranks.running(df, ["g"], ["k"], x=("mean", "v"))


def test_order_statistics_with_ties_and_nulls(spark):
    random.seed(6)
    rows = [(i % 3, random.choice([0.0, 0.0, 0.0, 1.5, None, float(i)])) for i in range(900)]
    counts = ranks.counted(spark.createDataFrame(rows, "g int, v double"), ["g"], "v")
    got = ranks.order_statistics(counts, ["g"], first=lambda n: F.lit(1), mid=lambda n: F.floor((n + 1) / 2), last=lambda n: n).collect()
    for r in got:
        own = sorted(v for g, v in rows if g == r.g and v is not None)
        assert (r.n, r["first"], r.mid, r["last"]) == (len(own), own[0], own[(len(own) + 1) // 2 - 1], own[-1])
    assert ranks.counted(spark.createDataFrame([], "g int, v double"), ["g"], "v").count() == 0


def _aps(rows, q):
    order = sorted(range(6), key=lambda i: (-rows[i], i))
    total, out = 0.0, []
    for i in order:
        total += rows[i]
        if total <= q:
            out.append(LABELS[i])
    return out


def test_conformal_sets(spark):
    random.seed(7)

    def probs():
        w = [random.choice([1, 1, 2, 8]) for _ in range(6)]
        return [x / 64 for x in w[:-1]] + [1 - sum(w[:-1]) / 64]

    cal = [("a", probs(), random.choice([*LABELS, "other"])) for _ in range(101)] + [("few", probs(), LABELS[0])]
    test = [(k, g, probs(), LABELS[k % 6]) for k, g in enumerate(["a"] * 30 + ["few"] * 5 + ["none"] * 5)]
    limits = conformal.thresholds(spark.createDataFrame(cal, "g string, probs array<double>, label6 string"), ["g"], (100, 500))
    q = {(r.g, r.alpha): r.q for r in limits.collect()}
    scores = defaultdict(list)
    for g, p, label in cal:
        if label in LABELS:
            order = sorted(range(6), key=lambda i: (-p[i], i))
            scores[g].append(sum(p[i] for i in order[: order.index(LABELS.index(label)) + 1]))
    for (g, alpha), value in q.items():
        own, n = sorted(scores[g]), len(scores[g])
        assert value == own[min(n, -((n + 1) * (1000 - round(alpha * 1000)) // -1000)) - 1]
    found = conformal.sets(spark.createDataFrame(test, "k int, g string, probs array<double>, label6 string"), limits, ["g"], (100, 500))
    rows = found.collect()
    assert len(rows) == 2 * len(test)
    for r in rows:
        assert r["set"] == _aps(r.probs, q.get((r.g, r.alpha), math.inf))
    quality = {(r.g, r.alpha): r for r in conformal.set_quality(found, ["g", "alpha"]).collect()}
    assert quality["none", 0.1].coverage == 1 and quality["none", 0.1].mean_size == 6
    for key, r in quality.items():
        own = [x for x in rows if (x.g, x.alpha) == key]
        assert r.coverage == pytest.approx(sum(x.label6 in x["set"] for x in own) / len(own))
        assert r.gap == pytest.approx(r.coverage - 1 + key[1])
    sizes = conformal.set_sizes(found, ["g", "alpha"]).collect()
    assert Counter({(r.g, r.alpha, r.size): r.n for r in sizes if r.n}) == Counter((x.g, x.alpha, len(x["set"])) for x in rows)
    assert len(sizes) == 7 * len(quality)


def test_auroc_counts_ties_as_halves(spark):
    random.seed(8)
    rows = [("a", random.choice([0.1, 0.1, 0.5, 0.9]), random.random() < 0.4) for _ in range(300)] + [("one", 0.2, True), ("one", None, False)]
    got = {r.g: r for r in diagnostics.auroc(spark.createDataFrame(rows, "g string, s double, y boolean"), ["g"], "s", F.col("y")).collect()}
    pos, neg = ([s for g, s, y in rows if g == "a" and y == want] for want in (True, False))
    won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert got["a"].auroc == pytest.approx(won / len(pos) / len(neg)) and (got["a"].pos, got["a"].neg) == (len(pos), len(neg))
    assert got["one"].auroc is None and got["one"].neg == 0


def test_bits_and_labels(spark):
    rows = [("g", True, True, False, True), ("g", False, True, False, False), ("g", True, False, True, True)]
    df = spark.createDataFrame(rows, "g string, t1 boolean, s1 boolean, t2 boolean, s2 boolean")
    r = diagnostics.bit_quality(df, ["g"], {"x": (F.col("t1"), F.col("s1")), "y": (F.col("t2"), F.col("s2"))}).first()
    assert (r.n, r.micro_f1, r.macro_f1, r.hamming) == (3, pytest.approx(4 / 7), pytest.approx((0.5 + 2 / 3) / 2), pytest.approx(0.5))
    said = [("visual", "visual"), ("visual", "mixed"), ("mixed", "mixed"), ("unclear", "visual"), ("zzz", "visual"), (None, "mixed")]
    cells = diagnostics.confusion(spark.createDataFrame(said, "a string, b string").withColumn("g", F.lit(1)), ["g"], "a", "b")
    assert cells.count() == 36 and cells.agg(F.sum("n")).first()[0] == 4
    q = diagnostics.label_quality(cells, ["g"]).first()
    assert (q.n, q.accuracy) == (4, 0.5)
    assert q.macro_f1 == pytest.approx((0.5 + 2 / 3 + 0) / 3) and q.balanced_accuracy == pytest.approx((0.5 + 1 + 0) / 3)


def test_frontier_and_area(spark):
    random.seed(9)
    points = [(g, float(random.randint(0, 400)), random.randint(0, 64) / 64) for g in "ab" for _ in range(700)] + [("c", 5.0, 0.5), ("d", None, 0.5)]
    df = spark.createDataFrame(points, "g string, c double, q double").repartition(5)
    front = diagnostics.frontier(df, ["g"], "c", "q")
    got = {r.g: r for r in diagnostics.area(front, ["g"]).collect()}
    for g in "abc":
        best, kept = {}, []
        for h, c, q in points:
            if h == g:
                best[c] = max(best.get(c, -1), q)
        for c in sorted(best):
            if not kept or best[c] > kept[-1][1]:
                kept.append((c, best[c]))
        assert sorted((r.cost, r.quality) for r in front.collect() if r.g == g) == kept
        assert got[g].area == pytest.approx(sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(kept, kept[1:], strict=False)))
    assert set(got) == {"a", "b", "c"}


def test_bootstrap_and_holm(spark):
    random.seed(10)
    rows = [(c, f"g{random.randint(0, 40)}", float(random.randint(0, 3)), float(random.randint(0, 3)) - (c == "x")) for c in ("x", "y") for _ in range(400)] + [("x", "g0", None, 1.0)]
    df = spark.createDataFrame(rows, "c string, g string, a double, b double")
    sums = resampling.paired_sums(df, "c", "g", "a", "b")
    reps = {(r.comparison, r.replicate): r.mean for r in resampling.replicated(sums, 200).collect()}
    own = sums.collect()
    weights = resampling.weights(np.array([r.seed for r in own]), 200)
    assert 0.9 < weights.mean() < 1.1 and 0.85 < weights.var() < 1.15
    for c in ("x", "y"):
        mine = [i for i, r in enumerate(own) if r.comparison == c]
        assert reps[c, 0] == pytest.approx(sum(own[i]["diff"] for i in mine) / sum(own[i].n for i in mine))
        for k in (1, 77, 200):
            w = weights[:, k - 1]
            assert reps[c, k] == pytest.approx(sum(own[i]["diff"] * w[i] for i in mine) / sum(own[i].n * w[i] for i in mine))
    done = {r.comparison: r for r in resampling.intervals(resampling.replicated(sums, 200)).collect()}
    assert done["x"].low > 0.5 and done["x"].p == pytest.approx(2 / 201) and done["y"].low < done["y"].mean < done["y"].high
    tests = [("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", 0.04), ("g", 0.5)]
    got = sorted(tuple(r) for r in resampling.holm(spark.createDataFrame(tests, "family string, p double"), ["family"]).collect())
    assert [round(r[2], 9) for r in got] == [0.04, 0.09, 0.09, 0.09, 0.5]


def test_probe_values_stop_and_choose(spark):
    states = [("i", 0, 4, 1.0, 2.0, True), ("i", 1, 2, 0.5, 1.0, True), ("i", 2, 4, 1.0, 1.0, True), ("i", 64, 1, 1.0, 1.0, True), ("j", 0, 3, 0.0, 9.0, False), ("j", 64, 1, 0.0, 9.0, False), ("k", 0, 1, 0.0, 0.0, True), ("k", 1, 0, 0.0, 0.0, True)]
    df = spark.createDataFrame(states, "id string, mask long, set_size int, loss double, budget double, relation_applicable boolean")
    got = {(r.id, r.mask): r for r in policy.probe_values(df, ["id"], PRICES, 0.25).collect()}
    assert got["i", 0].action == "relation" and got["i", 0].best_value == 3 - 0.25 and [v.probe for v in got["i", 0]["values"]] == ["blank", "blur", "relation"]
    assert got["j", 0].action == "stop" and got["j", 0].best_value is None  # relation doesn't apply
    assert got["k", 0].action == "stop"  # no budget
    assert got["i", 1].action == "stop"


def _exchanges(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Repartition"), df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ")


def test_probe_values_shuffles_no_states(spark):
    """Records are dealt over tasks once, before they have states; a state's work stays in its record's row."""
    df = metrics.probe_values(spark, DATA)
    assert _exchanges(df) == (1, 0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "element_at(lattice" not in plan


def test_probe_values_match_plain_loops(spark):
    """Random parts of the lattice in any order, equal values, nulls in the loss; a mask that is there twice is an error."""
    random.seed(13)
    states = {}
    for i in range(40):
        own = random.sample(range(128), random.randint(1, 128))
        states[i] = {m: (random.randint(1, 3), random.choice([0.0, 0.5, 1.0, None]) if i % 4 == 0 else random.randint(0, 2) / 2, random.randint(0, 2) * 1.0, bool(i % 3)) for m in own}
    df = spark.createDataFrame([(i, m, *s) for i, own in states.items() for m, s in own.items()], "id int, mask long, set_size long, loss double, budget double, relation_applicable boolean")
    got = {(r.id, r.mask): r for r in policy.probe_values(df, ["id"], PRICES, 0.25).collect()}
    assert len(got) == sum(map(len, states.values()))
    for i, own in states.items():
        for m, (size, loss, budget, relation) in own.items():
            values = []
            for k, name in enumerate(PROBES):
                after = own.get(m | 1 << k)
                if m >> k & 1 == 0 and budget >= PRICES[name] and after and (relation or name != "relation"):
                    values.append((name, None if loss is None or after[1] is None else size - after[0] + 0.25 * (loss - after[1]) - 0.25 * PRICES[name]))
            r = got[i, m]
            assert [tuple(v) for v in r["values"]] == values and r.n_legal == len(values)
            known = [v for v in values if v[1] is not None]
            best = max(known, key=lambda v: v[1]) if known else (None, None)  # the first of equals
            assert r.best_value == best[1] and r.action == (best[0] if best[1] is not None and best[1] > 0 else "stop")
    with pytest.raises(Exception, match="masks must differ"):
        policy.probe_values(df.union(df.where("id = 3").limit(1)), ["id"], PRICES, 0.25).collect()


def test_label_confusion_makes_each_prediction_once(spark):
    """No condition on the predicted label, for which Spark would make every digest anew, and again for each of its uses."""
    plan = metrics.label_confusion(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum(line.count("sha2(") for line in plan) <= 3  # truths and their condition, one a record each, and the budgets' weights
    assert not any("Filter" in line and "budget" in line for line in plan)


def test_counted_values_are_made_once(spark, monkeypatch):
    """Rows without a value leave after they are counted, so the scores' digests aren't made a second time for a condition."""
    plans = []
    real = ranks.running
    monkeypatch.setattr(ranks, "running", lambda rows, *a, **k: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or real(rows, *a, **k))
    metrics.aps_thresholds(spark, DATA)
    assert plans and not any("Filter" in line and "budget" in line and "sha2(" in line for line in plans[0].splitlines())
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "g string, v double")
    assert [tuple(r) for r in ranks.counted(df, ["g"], "v").select("g", "x", "n", "before").collect()] == [("a", 1.0, 1, 0)]


def test_likeliest_is_the_first_of_ranked(spark):
    random.seed(14)
    rows = [([random.choice([0.0, 0.25, 0.25, 0.5]) for _ in range(6)],) for _ in range(300)] + [([1.0],), ([0.0] * 6,), ([],), (None,)]
    df = spark.createDataFrame(rows, "p array<double>")
    both = df.select(conformal.likeliest(F.col("p")).alias("a"), F.get(conformal.ranked(F.col("p")), F.lit(0))["label"].alias("b")).collect()
    assert all(r.a == r.b for r in both) and both[-1].a is None and both[-2].a is None


def test_confusion_has_no_group_of_unknown_labels_only(spark):
    a, b = LABELS[:2]
    rows = [("g", a, b), ("g", a, "other"), ("g", b, None), ("h", a, "other"), ("h", "other", a), ("i", None, None)]
    cells = diagnostics.confusion(spark.createDataFrame(rows, "g string, t string, s string"), ["g"], "t", "s").collect()
    assert len(cells) == len(LABELS) ** 2 and {(r.g, r.true, r.said): r.n for r in cells if r.n} == {("g", a, b): 1}


def test_permutation_drift(spark):
    random.seed(11)

    def row(i, r):
        p = np.random.default_rng(i * 10 + r).dirichlet(np.ones(6)).tolist()
        return (i, r, p, [random.random() for _ in range(3)], random.sample(LABELS, random.randint(0, 3)), random.choice(["a", "b", None]), [random.random() for _ in range(4)])

    rows = [row(i, r) for i in range(6) for r in range(1 + i)]
    df = spark.createDataFrame(rows, "i int, permutation int, probs array<double>, bits array<double>, set array<string>, action string, hidden array<double>")
    for r in policy.permutation_drift(df, ["i"]).collect():
        own = [x for x in rows if x[0] == r.i]
        p, b, h = (np.array([x[k] for x in own]) for k in (2, 3, 6))
        m = p.mean(0)
        js = np.mean([0.5 * np.sum(x * np.log(x / ((x + m) / 2))) + 0.5 * np.sum(m * np.log(m / ((x + m) / 2))) for x in p])
        pairs = [1.0 if not set(x[4]) | set(y[4]) else len(set(x[4]) & set(y[4])) / len(set(x[4]) | set(y[4])) for x, y in combinations(own, 2)]
        assert r.permutations == len(own) and r.js_drift == pytest.approx(js, abs=1e-12)
        assert r.bit_drift == pytest.approx(np.abs(b - b.mean(0)).sum(1).mean(), abs=1e-12)
        assert r.set_disagreement == pytest.approx(1 - (np.mean(pairs) if pairs else 1))
        assert r.action_agreement == pytest.approx(max(Counter(x[5] for x in own).values()) / len(own))
        assert r.hidden_drift == pytest.approx((np.linalg.norm(h - h.mean(0), axis=1) / (np.linalg.norm(h.mean(0)) + 1e-8)).mean(), abs=1e-12)
    with pytest.raises(Exception, match="permutations of a record"):
        policy.permutation_drift(spark.range(100).select(F.lit(1).alias("i"), F.col("id").alias("permutation"), *[F.array(F.lit(1.0)).alias(c) for c in ("probs", "bits", "hidden")], F.array(F.lit("a")).alias("set"), F.lit("a").alias("action")), ["i"]).collect()


def test_sketch_bounds_hold_and_parts_merge(spark):
    random.seed(12)
    values = [random.choice([0, 3, 15, 16, 17, 31, 32, int(random.lognormvariate(8, 3)), 2**40 + random.randint(0, 9)]) for _ in range(3000)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("a", -1)], "g string, v long")
    whole = policy.sketch(df, ["g"], F.col("v"))
    parts = policy.merged(policy.sketch(df.where("v % 2 = 0"), ["g"], F.col("v")), policy.sketch(df.where("v % 2 <> 0"), ["g"], F.col("v")), by=["g"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    for r in policy.sketch_quantiles(whole, ["g"], (0.0, 0.1, 0.5, 0.9, 1.0)).collect():
        true = sorted(values)[math.floor(r.p * (len(values) - 1))]
        assert r.low <= true <= r.high and r.high - r.low <= true / 16 and r.n == len(values)


def test_skewed_join_keeps_every_row(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(None, i) for i in range(300)] + [("a", 1), ("b", 2)], "k string, v int")
    right = spark.createDataFrame([("hot", 1.0), ("a", 2.0)], "k string, w double")
    assert Counter((r.k, r.w) for r in joins.skew_join(left, right, ["k"], "left").collect()) == {("hot", 1.0): 500, (None, None): 300, ("a", 2.0): 1, ("b", None): 1}
    assert joins.skew_join(left, right, ["k"]).count() == 501


def test_acquisitions_follow_the_rules_in_order(spark):
    random.seed(13)
    prices = {"blank": 1, "blur": 2, "crop": 3, "noise": 0}
    events = [(f"r{i}", s, random.choice([*prices, "stop", "zoom", None])) for i in range(30) for s in range(9)]
    got = {(r.id, r.seq): r for r in acquisition.acquisitions(spark.createDataFrame(events, "id string, seq int, probe string"), ["id"], "seq", 4, prices).collect()}
    state = {}
    for i, s, p in events:
        left, had = state.get(i, (4, []))
        outcome, left = acquisition.decide(p, dict.fromkeys(had, 1), left, prices)
        had = [*had, p] if outcome == acquisition.ACCEPTED else had
        state[i] = left, had
        r = got[i, s]
        assert (r.outcome, r.budget_left, r.acquired) == (outcome, left, had), (i, s)
    assert acquisition.acquisitions(spark.createDataFrame([], "id string, seq int, probe string"), ["id"], "seq", 4).count() == 0


def test_ordinals_and_later_duplicates_of_hot_groups(spark):
    rows = [("hot", k, "x" if k % 3 else None) for k in range(900)] + [(None, 1, "x"), (None, 2, "x"), ("b", 5, "y")]
    df = spark.createDataFrame(rows, "g string, k int, v string").repartition(5)
    got = {(r.g, r.k): r.ordinal for r in sampling.ordinals(df, ["g"], ["k"]).collect()}
    assert got == {("hot", k): k for k in range(900)} | {(None, 1): 0, (None, 2): 1, ("b", 5): 0}
    later = sorted((r.g or "", r.k) for r in quality.later_duplicates(df, ["g", "v"], "k").collect())
    assert later == sorted([("hot", k) for k in range(2, 900) if k != 0 and k != 1] + [("", 2)])


def test_small_reports_are_one_file(spark, tmp_path):
    path = str(tmp_path / "a" / "report.csv")
    sinks.write_csv_file(spark.createDataFrame([(1, 'a "b", c'), (2, None)], "k int, v string"), path)
    assert open(path).read() == 'k,v\n1,"a ""b"", c"\n2,\n'
    with pytest.raises(ValueError, match="write a table"):
        sinks.write_csv_file(spark.range(5), path, most=4)
