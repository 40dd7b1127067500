"""The pipeline against its stages one by one and plain checks of each stage's decisions."""

import re

import pytest

import corpus_pipeline
from plumbline.llm import bpe, decontam, pii, quality
from plumbline.llm.common import table
from tests.conftest import DATA
from tests.llm.test_neardup import brute, shingles
from tests.llm.test_others import base_spans

tokenizers = pytest.importorskip("tokenizers")


def test_stages_decide_and_keep_columns(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns, after = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        docs.write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
        after[name] = docs
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    whole = table(spark, DATA, "documents")
    scores = quality.classify(whole, quality.fitted(spark, whole, DATA))
    assert {r.doc_id for r in after[names[0]].collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    first = [(r.doc_id, r.text) for r in after[names[0]].collect()]
    groups = brute(first)
    assert sorted(r.doc_id for r in after[names[1]].collect()) == sorted(set(groups.values()))
    left = {r.doc_id for r in decontam.decontaminate(after[names[1]], table(spark, DATA, "benchmark")).where("n_hit = 0").collect()}
    assert {r.doc_id for r in after[names[2]].collect()} == left == {r.doc_id for r in after[names[3]].collect()} == {r.doc_id for r in after[names[4]].collect()}
    ran = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.n_tokens) for r in ran.collect()) == sorted((r.doc_id, r.n_tokens) for r in after[names[4]].collect())


def _windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()


def _plain(spark, rows, good, benchmark):
    """The pipeline by hand after the classifier: rows are (row, doc_id, text); good are the rows that it keeps."""
    rows = [r for r in rows if r[0] in good]
    groups = brute([(r, t) for r, i, t in rows if i is not None])
    best = {}
    for r, i, _ in rows:
        if i is not None:
            best[groups[r]] = min(best.get(groups[r], (i, r)), (i, r))
    stay = {r for _, r in best.values()}
    rows = [x for x in rows if x[1] is None or x[0] in stay or not shingles(x[2])]
    wanted = {}
    for t in benchmark:
        for w in _windows(t)[1]:
            wanted.setdefault(len(w), set()).add(w)
    clean = []
    for r, i, t in rows:
        words, _ = _windows(t)
        if not any(tuple(words[k : k + n]) in own for n, own in wanted.items() for k in range(len(words) - n + 1)):
            clean.append((r, i, t))
    found = {x.doc_id: x.spans for x in pii.find_pii(spark.createDataFrame([(r, t) for r, _, t in clean], "doc_id long, text string")).collect()}
    out = []
    tok = tokenizers.Tokenizer.from_file(bpe.default_path())
    tok.no_truncation()
    tok.no_padding()
    for r, i, t in clean:
        text, at = "", 0
        for s in sorted(found[r], key=lambda s: (s.start, -s.end)):
            text += (t[at : s.start] + f"[{s.kind}]") if s.start >= at else ""
            at = max(at, s.end)
        text += (t or "")[at:]
        for kind, start, end in (x.split(":") for x in base_spans(t or "")):
            assert any(s.kind == kind and (s.start, s.end) == (int(start), int(end)) for s in found[r])
        out.append((i, tok.encode(text, add_special_tokens=False).ids))
    return sorted(out, key=str)


@pytest.mark.parametrize("odd", [False, True])
def test_the_whole_equals_a_plain_version(spark, tmp_path, odd):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, DATA, "documents").collect()]
    if odd:
        good = [t for _, t, _, _ in docs if t and 30 < len(t.split()) < 400][:6]
        docs += [(None, good[0], "en", "s"), (None, None, None, None), (9001, None, None, "s"), (9002, "", "en", None), (9003, "   ", "en", "s"), (9004, good[1], "en", "s"), (9004, good[1], "en", "s"), (9004, good[2] + " and more of it", "de", "s"), (9005, (good[3] + " ") * 3000, "en", "s"), (9006, good[4] + " call +1 (017) 555-7713 or me@x.org", "en", "s")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, key string, n_hit long, spans string, predicted int, _row long"
    rows = [(i, t, la, s, len(t or ""), "clash", k, "x", 5, k) for k, (i, t, la, s) in enumerate(docs)]
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("benchmark", "labels"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{DATA}/{name}.parquet")
    whole = table(spark, str(tmp_path), "documents")
    model = quality.fitted(spark, whole, str(tmp_path))
    good = {r.n_hit for r in quality.classify(whole.drop("predicted"), model).where("predicted = 1").collect()}
    benchmark = [r.text for r in table(spark, DATA, "benchmark").collect()]
    wanted = _plain(spark, [(k, i, t) for k, (i, t, _, _) in enumerate(docs)], good, benchmark)
    got = sorted(((r.doc_id, list(r.token_ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert len(got) == len(wanted) and got == wanted


def test_no_documents_at_all(spark, tmp_path):
    table(spark, DATA, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("benchmark", "labels"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{DATA}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
