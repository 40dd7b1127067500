"""Keyed streams that stop and go on, and record files as a source in batch and as a stream."""

import io
import json
import random

import pytest

from plumbline.operators import acquisition
from plumbline.sources.records import Records, lines
from plumbline.streaming import keyed, ledgers

EVENTS = "model_id string, instance_id string, at timestamp, failed boolean, error string"


def _put(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


def test_ledger_resumes_resolves_expires_and_forgets(spark, tmp_path):
    keyed.state_store(spark)
    (src := tmp_path / "in").mkdir()
    hour = 3_600_000

    def run(name, *events):
        _put(src, name, [dict(zip(("model_id", "instance_id", "at", "failed", "error"), ("m", i, f"2024-01-01T{t}", e is not None, e), strict=True)) for i, t, e in events])
        keyed.write_changes(keyed.failure_ledger(ledgers.read_stream(spark, str(src), EVENTS), hour, 3 * hour), str(tmp_path / "out"), str(tmp_path / "check"))
        return {r.instance_id: (r.status, r.attempts, r.error) for r in keyed.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}

    assert run("a", ("1", "00:00:00", "e1"), ("1", "00:01:00", "e2"), ("2", "00:00:00", "z"), ("3", "00:00:00", None)) == {"1": ("open", 2, "e2"), "2": ("open", 1, "z")}
    got = run("b", ("1", "00:02:00", "e3"), ("2", "00:02:00", None), ("3", "00:02:00", "of work that is done"))
    assert got == {"1": ("open", 3, "e3"), "2": ("resolved", 1, None)}
    assert run("c", ("9", "09:00:00", "q"))["1"] == ("expired", 3, "e3")
    got = run("d", ("1", "09:00:00", "new"), ("3", "09:01:00", "forgotten"))
    assert got["1"] == ("open", 1, "new") and got["3"] == ("open", 1, "forgotten") and got["2"] == ("resolved", 1, None)


def test_acquisition_stream_equals_batch_over_a_restart(spark, tmp_path):
    keyed.state_store(spark)
    (src := tmp_path / "in").mkdir()
    random.seed(1)
    schema = "model_id string, instance_id string, seq bigint, probe string"
    events = [{"model_id": "m", "instance_id": f"i{i}", "seq": s, "probe": random.choice([*acquisition.PRICES, "stop", "zoom"])} for i in range(9) for s in range(12)]
    for name, own in (("a", [e for e in events if e["seq"] < 5]), ("b", [e for e in events if e["seq"] >= 5])):
        _put(src, name, own)
        ledgers.run_once(keyed.acquired_probes(ledgers.read_stream(spark, str(src), schema), 4), str(tmp_path / "out"), str(tmp_path / "check"))
    columns = ["instance_id", "seq", "probe", "outcome", "budget_left", "acquired"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect()))
    batch = acquisition.acquisitions(spark.createDataFrame(events, schema), ["model_id", "instance_id"], "seq", 4)
    assert got == sorted(map(tuple, batch.selectExpr(*columns[:-1], "array_join(acquired, ',')").collect()))


def test_byte_ranges_have_each_line_once():
    data = b'{"a":1}\n\n{"a":22}\r\n{"a":333}\n{"a":4444}'
    for k in range(1, len(data) + 2):
        got = [x for s in range(0, len(data), k) for x in lines(io.BytesIO(data), s, min(s + k, len(data)))]
        assert [x for _, x in got] == data.split(b"\n")
        assert all(data[at : at + len(x)] == x for at, x in got)


def test_records_in_batch(spark, tmp_path):
    spark.dataSource.register(Records)
    rows = [{"id": i, "name": None if i % 50 == 0 else f"n{i % 7}", "v": {"x": i / 2, "y": [i, i + 1]}} for i in range(3000)]
    for k in range(3):
        (tmp_path / f"s{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows[k::3]))
    (tmp_path / "_hidden.jsonl").write_text("{")
    reader = spark.read.format("records").schema("id long, name string, v struct<x:double,y:array<long>>, lacking int").option("splitBytes", 20000)
    df = reader.load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 6
    assert sorted((r.id, r.name, r.v.x, r.v.y, r.lacking) for r in df.collect()) == [(r["id"], r["name"], r["v"]["x"], r["v"]["y"], None) for r in rows]
    assert reader.option("keep", json.dumps({"name": ["n3", None]})).load(str(tmp_path)).count() == sum(r["name"] in ("n3", None) for r in rows)
    (tmp_path / "s9.jsonl").write_text('{"id": 1}\n{"id": "q"}\n')
    with pytest.raises(Exception, match=r"s9\.jsonl"):
        spark.read.format("records").schema("id long").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="give a schema"):
        spark.read.format("records").load(str(tmp_path)).collect()


def test_records_as_a_stream(spark, tmp_path):
    spark.dataSource.register(Records)
    (src := tmp_path / "in").mkdir()

    def run():
        ledgers.run_once(spark.readStream.format("records").schema("id long").option("splitBytes", 100).load(str(src)), str(tmp_path / "out"), str(tmp_path / "check"))
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (src / "a.jsonl").write_text("".join(f'{{"id": {i}}}\n' for i in range(100)))
    assert run() == list(range(100))
    with (src / "a.jsonl").open("a") as f:
        f.write('{"id": 100}\n{"id": 1')
    assert run() == list(range(101))
    with (src / "a.jsonl").open("a") as f:
        f.write("01}\n")
    (src / "b.jsonl").write_text('{"id": 102}\n')
    assert run() == list(range(103))
