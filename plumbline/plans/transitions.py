"""Queries on sequences of events of a record: acquiring probes within a budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import acquisition
from plumbline.operators.acquisition import ACCEPTED, IS_STOP, PRICES, REPEATED, TOO_DEAR, UNKNOWN
from plumbline.plans import synth
from plumbline.plans.metrics import KEYS, _digest, _word
from plumbline.plans.registry import query

EVENTS, BUDGET = 12, 4
NAMES = (*PRICES, "stop", "zoom")


def events(spark, sf):
    """Probes that a policy asks for, one after the other, some of them not allowed."""
    rows = synth.clean(spark, sf).select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(EVENTS - 1))).alias("seq"))
    return rows.withColumn("probe", F.element_at(F.array(*map(F.lit, NAMES)), (_word(_digest(*KEYS, "=event", "seq"), 0) % len(NAMES) + 1).cast("int")))


_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_EVENTS = f"""WITH RECURSIVE {synth.SQL_CLEAN}, events AS (SELECT instance_id, model_id, seq, {_NAMES}[('0x' || substr(sha256(concat_ws('|', instance_id, model_id, 'event', seq)), 1, 8))::BIGINT % {len(NAMES)} + 1] AS probe FROM clean, range({EVENTS}) AS t(seq)),
walk AS (SELECT instance_id, model_id, -1::BIGINT AS seq, NULL::VARCHAR AS probe, '' AS outcome, {BUDGET}::BIGINT AS budget_left, []::VARCHAR[] AS acquired FROM clean
  UNION ALL SELECT instance_id, model_id, seq, probe, outcome, CASE WHEN outcome = '{ACCEPTED}' THEN budget_left - 1 ELSE budget_left END, CASE WHEN outcome = '{ACCEPTED}' THEN list_append(acquired, probe) ELSE acquired END FROM (
    SELECT e.*, w.budget_left, w.acquired, CASE WHEN e.probe = 'stop' THEN '{IS_STOP}' WHEN e.probe = 'zoom' THEN '{UNKNOWN}' WHEN list_contains(w.acquired, e.probe) THEN '{REPEATED}' WHEN w.budget_left < 1 THEN '{TOO_DEAR}' ELSE '{ACCEPTED}' END AS outcome
    FROM walk w JOIN events e ON e.instance_id = w.instance_id AND e.model_id = w.model_id AND e.seq = w.seq + 1))"""


@query("acquire_probes", f"{_EVENTS} SELECT instance_id, model_id, seq, probe, outcome, budget_left, array_to_string(acquired, ',') AS acquired FROM walk WHERE seq >= 0")
def acquire_probes(spark, sf):
    done = acquisition.acquisitions(events(spark, sf), KEYS, "seq", BUDGET)
    return done.withColumn("acquired", F.array_join("acquired", ","))


@query("acquisition_outcomes", f"{_EVENTS} SELECT model_id, outcome, count(*) AS n FROM walk WHERE seq >= 0 GROUP BY ALL")
def acquisition_outcomes(spark, sf):
    return acquisition.acquisitions(events(spark, sf), KEYS, "seq", BUDGET).groupBy("model_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
