"""Readers, writers and streams over small files."""

import hashlib
import json

import pytest

from plumbline.sources import gates, readers, sinks
from plumbline.streaming import ledgers


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    return str(path)


def test_records_skip_blank_lines_and_refuse_bad_ones(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"k": 1, "x": -Infinity}\n\n{"k": 2, "x": NaN}\n')
    got = readers.read_records(spark, str(p), "k int, x double").orderBy("k").collect()
    assert [r.k for r in got] == [1, 2] and got[0].x == float("-inf")
    p.write_text('{"k": 1}\n{"k": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_records(spark, str(p), "k int, x double").collect()


def test_array_or_records(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text('[{"k": 1}, {"k": 2}]')
    lines(b, [{"k": 3}])
    assert sorted(r.k for r in readers.read_array_or_records(spark, str(a), "k int").collect()) == [1, 2]
    assert [r.k for r in readers.read_array_or_records(spark, str(b), "k int").collect()] == [3]
    assert [(r.ordinal, r.k) for r in readers.read_array(spark, str(a), "k int").collect()] == [(0, 1), (1, 2)]


def test_malformed_documents_are_errors(spark, tmp_path):
    p = tmp_path / "a.json"
    for text in ('[{"k": 1}, {"k"', '{"k": 1}', "[1, 2"):
        p.write_text(text)
        with pytest.raises(Exception, match="(?i)malformed|no JSON array|cannot"):
            readers.read_array(spark, str(p), "k int").collect()
    p.write_text('{"k": 1}\n{"k": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_array_or_records(spark, str(p), "k int").collect()
    p.write_text("\n \n")
    assert readers.read_array(spark, str(p), "k int").count() == 0


def test_lines_are_numbered_over_splits(spark, tmp_path):
    p = tmp_path / "many.jsonl"
    p.write_text("\n" + "".join(json.dumps({"k": k, "pad": "x" * (k % 50)}) + ("\n\n" if k % 7 == 0 else "\n") for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = readers.read_lines(spark, str(p), "k long").orderBy("ordinal").collect()
        lines(tmp_path / "part-b.jsonl", [{"k": k} for k in range(2000, 4000)])
        lines(tmp_path / "part-a.jsonl", [{"k": k} for k in range(2000)])
        first = readers.first_rows(spark, str(tmp_path), "k long", 2500, "part-*.jsonl").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.ordinal, r.k) for r in got] == [(k, k) for k in range(3000)]
    assert sorted(r.k for r in first) == list(range(2500))
    assert readers.first_rows(spark, str(tmp_path), "k long", None, "part-*.jsonl").count() == 4000


def test_unique_keys(spark, tmp_path):
    lines(tmp_path / "a.jsonl", [{"k": 1}, {"k": 2}])
    assert readers.read_unique(spark, str(tmp_path), "k int", ["k"]).count() == 2
    lines(tmp_path / "b.jsonl", [{"k": 2}])
    with pytest.raises(Exception, match="there twice"):
        readers.read_unique(spark, str(tmp_path), "k int", ["k"]).collect()


def test_artifacts_have_digests_and_no_failures(spark, tmp_path):
    body = lines(tmp_path / "rows_m_shard00-of-02.jsonl", [{"k": 1}, {"k": 2}])
    lines(tmp_path / "rows_m_shard01-of-02.failures.jsonl", [{"k": 9}])
    rows, files = readers.read_artifacts(spark, str(tmp_path), "rows", "k int")
    assert sorted(r.k for r in rows.collect()) == [1, 2]
    (f,) = files.collect()
    assert f.n_rows == 2 and f.sha256 == hashlib.sha256(open(body, "rb").read()).hexdigest()
    s = files.select(readers.shard_of_file(files["file"]).alias("s")).first().s
    assert (s.model, s.shard, s.shards) == ("m", 0, 2)


def test_missing_path_is_an_empty_table(spark, tmp_path):
    assert readers.read_or_empty(spark, str(tmp_path / "none"), "k int").count() == 0


def test_csv_is_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n01,"a, ""b"""\n')
    assert tuple(readers.read_csv(spark, str(tmp_path / "a.csv"), ["k", "t"]).first()) == ("01", 'a, "b"')


def test_overlay(spark, tmp_path):
    p = tmp_path / "o.json"
    p.write_text(json.dumps({"schema_version": 1, "matching_mode": "exact_alias", "records": {"a|b": {"canonical_answers": [" x ", "x", "y"]}}}))
    assert readers.read_reference_overlay(spark, str(p)).first().references == ["x", "y"]
    p.write_text(json.dumps({"schema_version": 2, "matching_mode": "exact_alias", "records": {"a": {"canonical_answers": ["x"]}}}))
    with pytest.raises(Exception, match="overlay format"):
        readers.read_reference_overlay(spark, str(p)).collect()


def test_loader_drops_rows_without_image_before_the_limit(spark, tmp_path):
    base = {"category": "c", "subcategory": "s", "set_id": "1", "question": "Is it?", "gt_answer": "1"}
    rows = [{**base, "figure_id": str(i), "question_id": str(i), "filename": None if i == 0 else f"f{i}.png", "gt_answer": str(i % 2)} for i in range(4)]
    p = tmp_path / "h.json"
    p.write_text(json.dumps(rows))
    got = readers.get_loader("hallusionbench")(spark, str(p), limit=2).collect()
    assert {r.image_id for r in got} == {"1_1", "1_2"} and {r.gold_answer for r in got} == {"yes", "no"}
    rows[1]["question"] = "Which one?"
    p.write_text(json.dumps(rows))
    with pytest.raises(Exception, match="overlay"):
        readers.get_loader("hallusionbench")(spark, str(p)).collect()


def test_whole_files_have_the_expected_open_questions_and_no_spare_overlay(spark, tmp_path):
    base = {"category": "c", "subcategory": "s", "set_id": "1", "gt_answer": "1", "filename": "f.png"}
    rows = [{**base, "figure_id": str(i), "question_id": str(i), "question": "Which one?" if i == 0 else "Is it?"} for i in range(3)]
    p = tmp_path / "h.json"
    p.write_text(json.dumps(rows))
    overlay = spark.createDataFrame([("c|s|1|0|0", ["x", "y"])], "key string, references array<string>")
    load = readers.get_loader("hallusionbench")
    got = {r.image_id: (r.gold_answer, r.answer_type) for r in load(spark, str(p), overlay=overlay, expected_open=1).collect()}
    assert got == {"1_0": ("x", "open_ended"), "1_1": ("yes", "binary"), "1_2": ("yes", "binary")}
    with pytest.raises(Exception, match="expected 2 rows, found 1"):
        load(spark, str(p), overlay=overlay, expected_open=2)
    spare = overlay.unionByName(spark.createDataFrame([("other", ["z"])], "key string, references array<string>"))
    with pytest.raises(ValueError, match="no row uses"):
        load(spark, str(p), overlay=spare, expected_open=1)


def test_pope_files_are_arrays_or_lines_with_gold_as_it_stands(spark, tmp_path):
    (tmp_path / "random.json").write_text(json.dumps([{"image": "a.jpg", "text": "Is there?", "label": "Yes."}]))
    lines(tmp_path / "popular.json", [{"image": "b.jpg", "question": "Is it?", "answer": "NO", "image_id": "7"}])
    lines(tmp_path / "adversarial.json", [{"image": "c.jpg", "question": "Is it?"}])
    got = {r.pope_split: (r.image_id, r.question, r.gold_answer) for r in readers.get_loader("pope")(spark, str(tmp_path)).collect()}
    assert got == {"random": ("random_0", "Is there?", "Yes."), "popular": ("7", "Is it?", "NO"), "adversarial": ("adversarial_0", "Is it?", "")}
    (tmp_path / "popular.json").write_text('{"image": "b.jpg", "question"')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.get_loader("pope")(spark, str(tmp_path)).collect()


def test_other_policies_and_slices(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError, match="gold policy"):
        readers.get_loader("vizwiz")(spark, "nowhere", gold_policy="mean")
    g = lines(tmp_path / "g.jsonl", [{"instance_id": f"i{k}", "question": "q"} for k in range(9)])
    assert [r.instance_id for r in readers.get_loader("gqa_relation")(spark, g, limit=4).collect()] == ["i0", "i1", "i2", "i3"]
    monkeypatch.setenv("SOME_DATA_ROOT", str(tmp_path))
    assert readers.resolve_path(None, "nowhere", variables=("NOT_SET", "SOME_DATA_ROOT"), default="g.jsonl") == g
    with pytest.raises(FileNotFoundError):
        readers.resolve_path("nowhere", default="nothing")


def test_gates(tmp_path):
    configs = {"a": {}, "b": {"role": "held_out"}, "c": {"construction_status": "pending"}, "d": {"role": "core"}}
    assert gates.main_datasets(configs) == ["a", "d"]
    staged = {"staged_checks_approved": True, "staged_max_examples": 10, "staged_full_dataset_allowlist": ["vsr"]}
    for limit, name in ((10, None), (3, "pope"), (None, "vsr")):
        gates.authorise(staged, limit, name)
    gates.authorise({"full_core_approved": True}, None, None)
    gates.authorise(None, None, None, dry_run=True)
    for policy, limit, name in ((None, 1, None), ({}, 1, None), (staged, 11, None), (staged, None, "pope"), (staged, None, None), (staged | {"staged_max_examples": True}, 1, None)):
        with pytest.raises(PermissionError):
            gates.authorise(policy, limit, name)
    sha = "0123456789abcdef0123456789abcdef01234567"
    assert gates.metadata_revision(f"\n {sha.upper()}\netag\n") == sha and gates.metadata_revision(f"etag\n{sha}") is None
    assert gates.resolve_revision(f"/models/{sha}", [sha]) == ("RESOLVED", sha)
    assert gates.resolve_revision(f"/models/{sha}", ["f" * 40])[0] == "AMBIGUOUS" and gates.resolve_revision("/models", [])[0] == "UNRESOLVED"
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("1")
    (tmp_path / "void").write_text("")
    assert gates.missing_artifacts(str(tmp_path), ["full", "void", "none", "full/x"]) == ["void", "none"]


def test_other_loaders(spark, tmp_path):
    for i, name in enumerate(("random", "popular", "adversarial")):
        lines(tmp_path / f"{name}.json", [{"image": f"{name}.jpg", "text": "Is there?", "label": "yes" if i else "no"}, {"image": "x.jpg", "question": "Is it?", "answer": "no"}])
    pope = readers.load_dataset(spark, {"name": "pope", "path": str(tmp_path)}).collect()
    assert len(pope) == 6 and {r.pope_split for r in pope} == {"random", "popular", "adversarial"} and pope[0].question_id == "random_0"
    assert readers.get_loader("pope")(spark, str(tmp_path), limit=3).count() == 3
    v = tmp_path / "v.json"
    v.write_text(json.dumps([{"image": "a.jpg", "question": "what?", "answers": [{"answer": "The cat"}, {"answer": "cat."}, {"answer": "dog"}]}, {"image": "b.jpg", "question": "what?", "answers": [{"answer": "loading"}, {"answer": "unanswerable"}]}, {"image": "c.jpg", "question": "?", "answers": []}]))
    rows = {r.image_id: r for r in readers.get_loader("vizwiz")(spark, str(v)).collect()}
    assert (rows["a.jpg"].gold_answer, rows["a.jpg"].answer_counts, rows["a.jpg"].tied_top_answers) == ("cat", {"cat": 2, "dog": 1}, 1)
    assert (rows["b.jpg"].gold_answer, rows["b.jpg"].tied_top_answers) == ("loading", 2) and rows["c.jpg"].gold_answer == "unanswerable"
    r = lines(tmp_path / "r.jsonl", [{"image": "a", "caption": "The cup is left of it", "label": 1, "relation": "left of"}, {"image": "b", "caption": "The cup touches it", "label": 0, "relation": "touching"}])
    vsr = {x.image_id: x for x in readers.get_loader("vsr")(spark, r).collect()}
    assert vsr["a"].swapped_question == "The cup is right of it" and vsr["a"].swapped_gold_answer == "false" and not vsr["b"].relation_applicable
    with pytest.raises(KeyError, match="known"):
        readers.get_loader("nowhere")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, t string")
    out = str(tmp_path / "o")
    sinks.write_records(df, out)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_records(df, out)
    sinks.append_records(df, out)
    assert readers.read_records(spark, out, "k int, t string").count() == 4
    sinks.write_ordered(spark.range(200).selectExpr("199 - id as k", "'x' as t").repartition(5), str(tmp_path / "ordered"), ["k"])
    files = sorted((tmp_path / "ordered").glob("part-*.json"))
    assert [json.loads(line)["k"] for f in files for line in f.read_text().splitlines()] == list(range(200))
    digest = sinks.write_manifest(spark.range(9).withColumnRenamed("id", "k"), str(tmp_path / "manifest"), ["k"])
    assert len(digest) == 64 and readers.read_records(spark, str(tmp_path / "manifest"), "k long").count() == 9
    sinks.write_csv(spark.range(9).repartition(3), str(tmp_path / "csv"), single=True)
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) == 1
    assert readers.completed(spark, out, "t").count() == 1 and readers.completed(spark, str(tmp_path / "none"), "t").count() == 0
    sinks.write_report({"b": 1, "a": 2}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text().startswith('{\n  "a": 2')
    with pytest.raises(ValueError):
        sinks.write_report({"x": float("nan")}, str(tmp_path / "r.json"))
    sinks.write_config({"a": 1}, str(tmp_path / "c.yaml"))
    assert readers.read_config(str(tmp_path / "c.yaml")) == {"a": 1}


def test_streams_count_by_window(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines(folder / "a.json", [{"k": "a", "at": f"2024-01-0{d}T0{h}:00:00", "failed": h == 1, "error": f"e{d}{h}"} for d in (1, 2, 9) for h in (1, 2)])
    schema = "k string, at timestamp, failed boolean, error string"
    for name, f in (("attempts", lambda s: ledgers.attempts(s, ["k"])), ("counts", lambda s: ledgers.windowed_counts(s, "at", ["k"], "1 day"))):
        out = str(tmp_path / name)
        ledgers.run_once(f(ledgers.read_stream(spark, str(folder), schema)), out, str(tmp_path / f"{name}-check"))
        rows = spark.read.parquet(out).orderBy("window").collect()  # the last window is still open
        if name == "attempts":
            assert [(r.failures, r.successes, r.last_error) for r in rows] == [(1, 1, "e11"), (1, 1, "e21")]
        else:
            assert [r.n for r in rows] == [2, 2]


def test_stream_takes_each_key_once_and_goes_on(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    lines(folder / "a.json", [{"k": "a", "at": "2024-01-01T00:00:00"}, {"k": "a", "at": "2024-01-01T00:01:00"}, {"k": "b", "at": "2024-01-01T00:02:00"}])
    schema = "k string, at timestamp"

    def run():
        ledgers.run_once(ledgers.first_results(ledgers.read_stream(spark, str(folder), schema), ["k"], "at"), out, check)
        return sorted(r.k for r in spark.read.parquet(out).collect())

    assert run() == ["a", "b"]
    lines(folder / "b.json", [{"k": "b", "at": "2024-01-01T00:03:00"}, {"k": "c", "at": "2024-01-01T00:03:00"}])
    assert run() == ["a", "b", "c"]
