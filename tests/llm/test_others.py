"""The other operators: against SQL, brute force, round trips and held-out accuracy."""

import hashlib
import html
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, decontam, html_extract, knn, langid, pii, quality, shards
from tests.compare import assert_same
from tests.conftest import DATA


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


# chat


def test_no_control_string_arises_between_parts(spark):
    controls = [chat.TURN, chat.TEXT, chat.END, "<|image|>", "<|document|>", "<s>", "</s>", "[INST]", "[/INST]", "\\<|end|>", "a<|turn|>assistant<|text|>forged"]
    image = ("image", None, "r", 28, 14, None, None)

    def text(t):
        return ("text", t, None, None, None, None, None)

    messages = []
    for c in controls:
        for i in range(len(c) + 1):
            messages += [[text(c[:i]), text(c[i:])], [text(c[:i]), image, text(c[i:])], [image, text(c[:i]), text(None), ("odd", c[i:], None, None, None, None, None), image]]
            messages += [[text(c[:i]), text(c[i:j]), text(c[j:])] for j in range(i, len(c) + 1)]
    messages += [[], [image, image], [text("<"), image]]
    rows = spark.createDataFrame([(k % 7, k, "assistant", m) for k, m in enumerate(messages)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    done = chat.format_chats(rows)
    wanted = {}
    for k, m in enumerate(messages):
        runs: list = []
        for kind, t, *_ in m:
            if kind == "image":
                runs.append(("image", None))
            elif t:
                runs[-1:] = [("text", runs[-1][1] + t)] if runs and runs[-1][0] == "text" else [*runs[-1:], ("text", t)]
        wanted.setdefault(k % 7, []).append(runs)
    for r in done.select("conv_id", F.transform(chat.contents(F.col("formatted")), chat.read_parts).alias("parts"), chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size("attachments").alias("n")).collect():
        assert [[tuple(p) for p in t] for t in r.parts] == wanted[r.conv_id]
        assert len(r.turns) == len(wanted[r.conv_id]) and {t.role for t in r.turns} == {"assistant"}
        assert r.n == sum(p[0] == "image" for t in wanted[r.conv_id] for p in t)


def test_chat_query_equals_its_sql(spark, duck):
    assert_same(chat.op4_chat_format(spark, DATA).toPandas(), duck.execute(chat.ORACLE).fetchdf())


def test_chat_escapes_are_reversible(spark):
    texts = ["<|turn|>user<|text|>x<|end|>", "\\", "\\\\<|end|>\\", "</s>[INST] [/INST]", "<\\|end|>", None, "", "[[INST]", "a\nb\\n"]
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    done = chat.format_chats(rows.select("conv_id", "turn", "role", chat.text_parts(F.coalesce("text", F.lit(""))).alias("parts")))
    r = done.select(chat.read_back(F.col("formatted")).alias("b"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l"), "formatted").first()
    assert [x.text for x in r.b] == [t or "" for t in texts]
    assert r.l == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert r.formatted.count("<|turn|>") == len(texts) and "</s>" not in r.formatted and "[INST]" not in r.formatted


def test_chat_parts_become_placeholders(spark):
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    parts = [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "a.png", 30, 14, None, None), ("audio", None, "b.wav", None, None, 2.5, None), (None, "ok", None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 3)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{part}>")
    r = chat.format_chats(rows).first()
    assert "see <\\|image|> <|image|><|audio|>ok<|document|>" in r.formatted
    assert [(a.kind, a.ref, a.place, a.n_tokens) for a in r.attachments] == [("image", "a.png", 0, 3), ("audio", "b.wav", 1, 63), ("document", "c.pdf", 2, 768)]
    assert chat.format_chats(rows.where("false")).count() == 0
    content = chat.contents(F.col("formatted"))[0]
    back = chat.format_chats(rows).select(chat.read_parts(content).alias("p")).first().p
    assert [(p.kind, p.text) for p in back] == [("text", "see <|image|> "), ("image", None), ("audio", None), ("text", "ok"), ("document", None)]


def test_chat_kinds_forge_no_control_strings(spark):
    parts = [("text", "a", None, None, None, None, None), ("end", None, "r", None, None, None, None), ("turn", "<|turn|>", None, None, None, None, None), ("text|>", "b", None, None, None, None, None)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 0, "user", parts), (None, 0, "<|end|>", parts[:1]), (2, 1, None, None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {r.conv_id: ([(t.role, t.text) for t in r.b], r.attachments) for r in chat.format_chats(rows).select("conv_id", chat.read_back(F.col("formatted")).alias("b"), "attachments").collect()}
    assert got == {1: ([("user", "a<|turn|>b")] * 2, []), None: ([("<|end|>", "a")], []), 2: ([("", "")], [])}


# decontamination


def test_decontamination_query_equals_its_sql(spark, duck):
    assert_same(decontam.op6_decontaminate(spark, DATA).toPandas(), duck.execute(decontam.ORACLE).fetchdf())


def test_decontamination_edge_cases(spark):
    ten = " ".join(f"t{k}" for k in range(12))
    bench = spark.createDataFrame([(1, ten), (2, "Short one"), (3, None), (4, ""), (5, "short ONE!"), (None, "x y")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before, {ten.upper()} after", "a"), (2, "a short\none. shortone", "b"), (2, "a short\none. shortone", "b"), (3, None, "c"), (None, "", "d"), (5, "t0 " * 5000, "e")], "doc_id long, text string, n_hit string")
    whole = decontam.decontaminate(docs, bench).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, tuple(r.item_ids)) for r in whole)
    assert got == [(-1, 0, 0, ()), (1, 14, 12, (1,)), (2, 4, 2, (2, 5)), (2, 4, 2, (2, 5)), (3, 0, 0, ()), (5, 5000, 0, ())]
    sharded = decontam.decontaminate(docs, bench, shard_bytes=40).collect()
    key = lambda r: (r.doc_id or -1, r.n_words, r.n_hit, sorted(r.item_ids), [tuple(s) for s in r.hit_spans])
    assert sorted(map(key, whole)) == sorted(map(key, sharded))
    assert decontam.decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(docs.where("false"), bench).count() == 0


# personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [
    "a@b.c_d@e.f.g a@b @x.y a..b%+-@x-y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 12.3.4", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111112", "+1 (555) 123-4567 +12 +1-2 +99 999 999 999 999 999 9", "é@x.y \U0001f600 me@x.org +49 30 1234567",
    "1 " * 20000, "1" * 30000, "x" * 30000 + "@", "a." * 10000, None, "", "4111111111111111 1", "+1 (826) 555-4081 190.137.2.1",
]


def test_base_spans_equal_brute_force(spark, documents):
    got = {r.doc_id: r for r in pii.op3_pii(spark, DATA).collect()}
    for d in documents:
        own = base_spans(d["text"] or "")
        assert got[d["doc_id"]].base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert set(own) <= set(got[d["doc_id"]].spans.split(","))


def test_base_spans_of_tricky_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)) + [(None, "me@x.org")], "doc_id long, text string")
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.base] for r in pii.find_pii(docs).collect()}
    assert got == {i: base_spans(t or "") for i, t in enumerate(TRICKY)} | {None: ["email:0:8"]}
    assert pii.find_pii(docs.where("false")).count() == 0


def test_context_discovers_what_the_patterns_miss(spark):
    rows = [f"please call hotline +1 (555) 01{k}-{1000 + k} today" for k in range(10, 30)] + ["please call hotline 555-867-5309 today", "please count item 555-867-5301 today"]
    rows += [f"reach us by mail: user{k}@example.org for news" for k in range(20)] + ["reach us by mail: admin@localhost for news"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, spans int")
    found = {r.doc_id: [(s.kind, rows[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.find_pii(docs).collect()}
    assert found[42] == [("email", "admin@localhost")]
    assert found[20] == [("phone", "555-867-5309")] and found[21] == []


def test_context_discovers_numbers_with_spaces_and_brackets(spark):
    rows = [f"please call hotline +1 (555) 01{k}-{1000 + k} today" for k in range(10, 30)] + [f"paid by card 49927398{k}" for k in range(3)]
    rows += [f"paid by visa {x} now" for x in ("4992739871600000", "4111111111111111", "5500005555555559", "4012888888881881", "4222222222222220", "5105105105105100", "6011111111111117", "3566002020360505", "4000056655665556", "5200828282828210")]
    extra = ["please call hotline (017) 555-7713 today", "please call hotline 017 555 7713 today", "please call hotline 555 867.5309 4th floor", "please count item (018) 555-7714 today", "paid by visa 4111 1111 1111 1112 now", "please call hotline (017)555-7713 today"]
    docs = spark.createDataFrame(list(enumerate(rows + extra)), "doc_id long, text string")
    texts = rows + extra
    found = {r.doc_id - len(rows): [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.find_pii(docs).collect()}
    assert [found[k] for k in range(6)] == [[("phone", "(017) 555-7713")], [("phone", "017 555 7713")], [("phone", "555 867.5309")], [], [("card", "4111 1111 1111 1112")], [("phone", "(017)555-7713")]]


def test_context_words_are_whole_however_long(spark):
    long, gap = "w" * 3000, " " * 70000
    rows = [f"{x} {word}{g}+1 (555) 01{k}-{1000 + k} today" for x, word, g in (("at", long, " "), ("by", "hotline", gap)) for k in range(10, 30)]
    rows += [f"at {long} 555-867-5309 today", f"at x{long} 555-867-5301 today", f"by hotline{gap}555-867-5302 today", "555-867-5303"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id - 40: [s.kind for s in r.spans] for r in pii.find_pii(docs).where("doc_id >= 40").collect()}
    assert found == {0: ["phone"], 1: [], 2: ["phone"], 3: []}


def test_context_goes_on_while_it_finds(spark):
    """Each place's numbers are only known by those of the place before it, so three rounds find something."""
    seeds = [f"+1 (555) 010-{k}" for k in range(1000, 1096)]
    chain = [[f"555-{step}-{k}" for k in range(1000, 1000 + n)] for step, n in ((1, 24), (2, 6), (3, 1))]
    rows = [f"so {place} is {x} then{place}" for place, known, new in (("p0", seeds, chain[0]), ("p1", chain[0], chain[1]), ("p2", chain[1], chain[2])) for x in known + new]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)
    assert all(len(r.spans) == 1 for r in pii.find_pii(docs).collect())
    twice = pii.find_pii(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(rows) and all(len(r.spans) == 1 for r in twice)


def test_masking_replaces_spans(spark):
    docs = spark.createDataFrame([(1, "mail me@x.org or 10.0.0.1 now", "a"), (2, None, "b"), (3, "é clean", "c")], "doc_id long, text string, base string")
    got = {r.doc_id: (r.text, r.base) for r in pii.mask_pii(spark, docs, "").collect()}
    assert got == {1: ("mail [email] or [ip] now", "a"), 2: (None, "b"), 3: ("é clean", "c")}


# search


def brute_top(rows, k=5):
    """By Python's integers; a shorter vector counts as filled up with zeros."""
    own = [(i, [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(own):
        if i % 50 == 0:
            best = sorted((-sum(s * t for s, t in zip(q, x, strict=False)), j) for b, (j, x) in enumerate(own) if b != a)[:k]
            out += [(i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,queries", [(2048, 512), (16, 2)])
def test_search_equals_brute_force_with_ties_and_voids(spark, block, queries):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(260)]
    rows += [(260 + i, rows[0][1]) for i in range(20)] + [(300, None), (350, [1.0, None] + [0.0] * 6), (400, [float("nan")] * 8), (450, [1.0]), (500, [0.0] * 8), (550, [float("inf")] * 8)]
    rows += [(600, []), (601, [-0.5, 0.25, 3.0]), (650, [0.5] * 11), (0, rows[0][1]), (0, rows[0][1]), (0, rows[1][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = knn.nearest(df, F.col("vec_id") % 50 == 0, block=block, queries=queries)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
    assert knn.nearest(df.where("false"), F.lit(True)).count() == 0
    assert knn.nearest(df.where("vec_id = 50"), F.lit(True)).count() == 0
    few = df.where("vec_id in (50, 51, 52)")
    assert knn.nearest(few, F.col("vec_id") % 50 == 0).count() == 2


@pytest.mark.parametrize("sent", [0, 1 << 23])
def test_search_stores_no_block_twice(spark, monkeypatch, sent):
    """However many groups of queries need a block, with the groups broadcast or not."""
    rng = np.random.default_rng(6)
    rows = [(10 * i, [float(x) for x in np.round(rng.normal(size=8), 2)]) for i in range(600)]
    staged = {}
    write = knn.Staging.write
    monkeypatch.setattr(knn, "SENT", sent)
    monkeypatch.setattr(knn.Staging, "write", lambda self, df, name, *own: staged.setdefault(name, write(self, df, name, *own)))
    got = knn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0, block=64, queries=2)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
    assert staged["groups"].count() > 20
    assert staged["blocks"].agg(F.sum(F.length("ids"))).first()[0] == 8 * len(rows)


def test_search_is_exact_beyond_64_bits(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(150, [2.0**41, 1.0, 0.0, 0.0, -3.0, 0.5]), (200, [2.0**39] * 6), (201, [2.0**39] * 5 + [2.0**39 + 1]), (202, [-(2.0**45)] * 6), (250, [1e300, -1e300, 1e308, 0.0, 0.0, 1.0]), (251, [1e300, 1e300, 0.0, 0.0, 0.0, 1.0]), (300, [2.0**22 + 0.5] * 6), (301, [30000.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = knn.nearest(df, F.col("vec_id") % 50 == 0, block=32, queries=2)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
    assert sorted(map(tuple, knn.nearest(df.where("vec_id >= 200"), F.col("vec_id") % 50 == 0).collect())) == brute_top([r for r in rows if r[0] >= 200])


def test_search_query_equals_its_sql(spark, duck):
    assert_same(knn.op5_top_k(spark, DATA).toPandas(), duck.execute(knn.ORACLE).fetchdf())


# shards


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 17, 1000, 4096, 65537):
        p = shards.Permutation(n, 7)
        slots = p.slot(np.arange(n))
        assert sorted(slots) == list(range(n)) and (p.sequence(slots) == np.arange(n)).all()
    assert (shards.Permutation(1000, 1).slot(np.arange(1000)) != shards.Permutation(1000, 2).slot(np.arange(1000))).any()


def test_shards_give_the_stream_back(spark, tmp_path):
    texts = ["héllo wörld " * 9, None, "", "x" * 333, "tail"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    folder = str(tmp_path / "shards")
    rows = shards.write_shards(docs, folder, key=5, length=16, per_shard=4).orderBy("sequence").collect()
    stream = b"".join((r.text or "").encode() + b"\xff" for r in docs.collect())
    assert len(rows) == -(-len(stream) // 16) and [r.sequence for r in rows] == list(range(len(rows)))
    held = shards.read_slots(folder, 0, 10**6)
    order = shards.Permutation(len(rows), 5).slot(np.arange(len(rows)))
    assert held[order].tobytes()[: len(stream)] == stream
    assert [r.tokens_sha256 for r in rows] == [hashlib.sha256(stream[i * 16 : i * 16 + 16]).hexdigest() for i in range(len(rows))]
    assert (shards.read_slots(folder, 5, 3) == held[5:8]).all()  # resumes anywhere
    assert shards.write_shards(docs.where("false"), str(tmp_path / "none")).count() == 0


def test_shards_of_many_partitions_and_a_second_run(spark, tmp_path):
    rows = [(None if k % 7 == 0 else k, None if k % 11 == 0 else f"text {k} " * (k % 13), k) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(7).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    folder = str(tmp_path / "shards")
    first = shards.write_shards(docs, folder, key=3, length=16, per_shard=4, tasks=3).orderBy("sequence").collect()
    held = shards.read_slots(folder, 0, 10**6)
    again = shards.write_shards(docs, folder, key=3, length=16, per_shard=4, tasks=5).orderBy("sequence").collect()
    assert first == again and (held == shards.read_slots(folder, 0, 10**6)).all()
    order = shards.Permutation(len(first), 3).slot(np.arange(len(first)))
    own = held[order].tobytes().split(b"\xff")[:-1]
    assert sorted(own) == sorted((r.text or "").encode() for r in docs.collect()) and len(own) == 400
    run = shards.current(folder)["run"]
    assert {p.name for p in (tmp_path / "shards").iterdir() if p.name[0] != "."} == {run, shards.CURRENT}
    names = {p.name for p in (tmp_path / "shards" / run).iterdir()} - {"manifest.parquet"}
    assert names == {shards.shard_name(k) for k in range(-(-len(first) // 4))}
    fewer = docs.where("slot < 20")
    fewer.coalesce(1).write.parquet(str(tmp_path / "fewer"))
    small = shards.write_shards(spark.read.parquet(str(tmp_path / "fewer")), folder, key=3, length=16, per_shard=4).collect()
    assert len(shards.read_slots(folder, 0, 10**6)) == len(small) < len(first)  # nothing of the larger run is read
    assert shards.write_shards(docs.where("false"), folder).count() == 0 and len(shards.read_slots(folder, 0, 10)) == 0


def test_shards_of_token_ids(spark, tmp_path):
    spark.createDataFrame([([1, 2, 70000],), (None,), ([],)], "ids array<int>").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    folder = str(tmp_path / "s")
    shards.write_shards(docs, folder, column="ids", length=4, per_shard=2, dtype="uint32", separator=9).collect()
    held = shards.read_slots(folder, 0, 9)
    stream = held[shards.Permutation(2, 1).slot(np.arange(2))].ravel().tolist()
    assert stream[:6] == [*[x for r in docs.collect() for x in [*(r.ids or []), 9]]][:6] and stream[6:] == [0, 0]


# pages


def test_extraction_of_the_pages(spark):
    pages = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    got = {r.page_id: r for r in html_extract.op8_html(spark, DATA).collect()}
    for p in pages:
        inner = p["html"].split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inner)]
        wanted = "\n\n".join(b for b in blocks if b)
        assert got[p["page_id"]].text == wanted and got[p["page_id"]].n_chars == len(wanted)


def test_held_out_blocks_are_labelled_well():
    model = html_extract.trained()
    wrong = total = 0
    for page in html_extract.labelled_pages(150, seed=77):
        blocks = html_extract.parse(page, labelled=True)
        gold = [b.keep for b in blocks]
        wrong += sum(a != b for a, b in zip(gold, model.decode(blocks), strict=True))
        total += len(gold)
    assert wrong / total < 0.03


def test_parser_and_odd_pages(spark):
    odd = [None, "", "   ", "<", "<p", "plain", "<script>var a='<p>x</p>'</script>", "<!-- <p>no</p> -->", "<p>a<p>b<br>c &amp; d<li>e", "<div " + "x" * 20000, "<p>" * 3000 + "deep"]
    rows = [(i, "u", h) for i, h in enumerate(odd)] + [(9, "u", odd[8])] * 2 + [(None, None, "<article><p>" + "very long " * 200000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, text string, html string")
    done = html_extract.extract(df).collect()
    assert len(done) == len(rows) and len({r.text for r in done[len(odd) : -1]}) == 1 and len(done[-1].text) == 1999999
    assert [b.text for b in html_extract.parse(odd[8])] == ["a", "b c & d", "e"]
    assert html_extract.parse(odd[6]) == [] and html_extract.parse(odd[7]) == []
    assert html_extract.extract(df.where("false")).count() == 0
    article = "<body><div class=cookie-notice><p>We use cookies</p></div><article><h1>T</h1><p>Body text of it.</p><aside class=ad><p>Buy</p></aside><p>More  text\nhere.</p></article><section id=comments><p>First!</p></section></body>"
    assert html_extract.main_text(article, html_extract.trained()) == "T\n\nBody text of it.\n\nMore text here."


def test_pages_without_an_article_element():
    model = html_extract.trained()
    page = "<body><div class=topnav><ul><li><a href=#>Home</a></li><li><a href=#>About</a></li></ul></div><div class=content><h1>The title of it</h1><p>A first paragraph that says something at length.</p><p>And a second one, with <a href=#>a link</a> in it.</p></div><div class=sidebar><h3>Related</h3><ul><li><a href=#>Other</a></li></ul></div><div id=footer>&copy; Someone</div></body>"
    assert html_extract.main_text(page, model) == "The title of it\n\nA first paragraph that says something at length.\n\nAnd a second one, with a link in it."
    assert [b.text for b in html_extract.parse("<table><tr><td>a<td>b<tr><td><p>c</table>d</div></b>e")] == ["a", "b", "c", "de"]


def test_parsing_takes_time_in_proportion_to_the_page():
    import time

    model = html_extract.trained()
    for piece in ("<span><p>x</p>", "<div class='a b'><p>x", "<b><article></b>", "<x{0} class='n{0}'>y<p>", "<li><b>"):
        page = "".join(piece.format(k) for k in range(20000))
        began = time.perf_counter()
        html_extract.main_text(page, model)
        assert time.perf_counter() - began < 8, piece  # quadratic time took minutes


# classifiers


def test_quality_is_learnt(spark):
    got = quality.op1_quality(spark, DATA).toPandas()
    labels = pq.read_table(f"{DATA}/labels.parquet").to_pandas()
    both = got.merge(labels, on="doc_id")
    assert len(got) == pq.read_metadata(f"{DATA}/documents.parquet").num_rows
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    held = both[both.held_out]  # rows that nothing is learnt from
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert len(good) and len(bad) and np.mean([g > b for g in good for b in bad]) > 0.9


def test_trees_split_and_walk_alike():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.grow(x[:400], y[:400])
    assert ((quality.score(model, x[400:]) > 0.5) == (y[400:] > 0.5)).mean() > 0.9
    assert (quality.score(quality.grow(x[:0], y[:0]), x) == 0.5).all()
    assert quality.score(quality.grow(x, np.ones(len(x))), x[:1])[0] > 0.99


def test_scores_equal_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).round(1)  # with ties at the thresholds
    model = quality.grow(x, (x[:, 0] + x[:, 2] > 0.2).astype(float))

    def walk(row):
        raw = model["base"]
        for tree in range(len(model["feature"])):
            node = 0
            while model["left"][tree, node] != node:
                node = model["left" if row[model["feature"][tree, node]] <= model["threshold"][tree, node] else "right"][tree, node]
            raw += model["value"][tree, node]
        return 1 / (1 + math.exp(-raw))

    assert np.allclose(quality.score(model, x), [walk(r) for r in x], atol=1e-12)


def test_a_repeated_id_is_learnt_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "grow", lambda x, y: seen.append((x.tolist(), y.tolist())) or {})
    docs = spark.createDataFrame([(1, t, k) for k, t in enumerate(["one text", "another text here", None, "one text"] * 50)] + [(2, "x", 0)], "doc_id long, text string, quality int").repartition(5)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    quality.fit(docs, labels)
    quality.fit(docs.orderBy("text"), labels)
    assert seen[0] == seen[1] and seen[0][1] == [1.0, 0.0]


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b c", 0.5), (1, "a b c", 0.5), (None, None, 0.1), (3, "", 0.2), (4, "word " * 20000, 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.classify(docs, model).count() == 5 and quality.classify(docs.where("false"), model).count() == 0


def test_language_is_learnt(spark, documents):
    got = {r.doc_id: r for r in langid.op9_language_id(spark, DATA).collect()}
    held = [d for d in documents if got[d["doc_id"]].held_out and d["lang"] and any(map(str.isalpha, d["text"] or ""))]
    assert np.mean([got[d["doc_id"]].lang_pred == d["lang"] for d in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_scores_equal_plain_sums(spark):
    rows = [(1, "the cat and the dog", "en", "a"), (2, "der hund und die katze", "de", "b"), (3, "el perro y el gato", "es", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    langs, matrix = langid.fit(docs)
    counts = {}
    for _, text, lang, _ in rows:
        for g in langid.hashed(np.array([ord(c) for c in text] + [1, 1, 1], np.uint32)).ravel():
            counts[lang, g] = counts.get((lang, g), 0) + 1
    total = {k: sum(n for (lang, _), n in counts.items() if lang == k) + 0.5 * langid.BUCKETS for k in langs}
    for r in langid.predict(docs, langs, matrix).collect():
        own = [sum(math.log((counts.get((k, g), 0) + 0.5) / total[k]) for g in langid.hashed(np.array([ord(c) for c in r.text] + [1, 1, 1], np.uint32)).ravel()) for k in langs]
        assert r.lang_pred == langs[int(np.argmax(own))] and abs(r.score - 1 / sum(math.exp(s - max(own)) for s in own)) < 1e-4


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 ... !", None), (None, "und der", None), (6, "das " * 100000, None), (6, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = langid.fit(docs)
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(docs, langs, matrix).collect()]
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "de"), (6, "de"), (6, "und")]
    langs, matrix = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, langs, matrix).collect()} == {"und"}


def test_every_number_has_one_query():
    from plumbline.llm import registry

    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
    assert pa  # pyarrow is what the batches are made of


# personal data at scale


def test_pii_takes_time_in_proportion_to_a_text(spark):
    import time

    numbers = " ".join(str(1_000_000 + i) for i in range(100_000))
    mails = " ".join(f"u{i}@x.org" for i in range(20_000))
    rows = spark.createDataFrame([(1, numbers), (2, mails)], "doc_id int, text string")
    began = time.monotonic()
    done = {r.doc_id: r for r in pii.scanned(rows).select("doc_id", F.size("base").alias("base"), F.size("cands").alias("cands"), F.element_at("cands", -1).alias("last")).collect()}
    assert time.monotonic() - began < 60  # a quadratic scan takes hours
    assert (done[1].base, done[1].cands) == (0, 100_000) and done[1]["last"].token == "1099999" and done[1]["last"].end == len(numbers)
    assert (done[2].base, done[2].cands) == (20_000, 20_000) and done[2]["last"].patterns == [f"2|{' '.join(mails.split()[-3:-1])} ", f"1|{mails.split()[-2]} |"]


def test_pii_contexts_of_long_words_and_masking_of_many_spans(spark):
    wide = "w" * 300 + " " + "v" * 70_000 + " 1234567 " + "z" * 70_000 + " end"
    c = pii.scanned(spark.createDataFrame([(1, wide)], "doc_id int, text string")).selectExpr("cands[0] c").first().c
    assert c.patterns == [f"2|{'w' * 300} {'v' * 70_000} ", f"1|{'v' * 70_000} | {'z' * 70_000}"]
    text = "".join(f"é{i} a{i}@b.cd, " for i in range(500)) + "tail"
    spans = [("email", m.start(), m.end()) for m in re.finditer(r"a\d+@b\.cd", text)] + [("ip", 0, 3), ("ip", 1, 2), ("card", 2, 9)]
    df = spark.createDataFrame([(text, spans), ("none", []), ("", [])], f"text string, spans {pii.SPANS}")
    got = [r[0] for r in df.select(pii.redacted(F.col("text"), F.col("spans"))).collect()]
    out, at = "", 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        out += (text[at:a] + f"[{kind}]") if a >= at else ""
        at = max(at, b)
    assert got == [out + text[at:], "none", ""]


def test_pii_recall_on_identifiers_planted_in_documents(spark, documents):
    texts = [(d["doc_id"], d["text"] or "") for d in documents]
    planted = {}
    for k, (i, t) in enumerate(texts[:150]):
        number = f"{2000 + k} {3000 + k} {4000 + k}"
        planted[i] = (f"+{number}" if k % 6 else number, len(t))
    rows = [(i, f"{t} reachable under {planted[i][0]} today" if i in planted else t) for i, t in texts]
    done = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    unseen = {i: v for i, (v, _) in planted.items() if v[0] != "+"}
    found = sum(any(s.kind == "phone" and s.start == planted[i][1] + len(" reachable under ") for s in done[i].spans) for i in unseen)
    assert len(unseen) == 25 and found / len(unseen) >= 0.95, found


def test_language_of_texts_longer_than_a_stretch(spark, monkeypatch):
    random_letters = np.random.default_rng(3)
    texts = ["".join(random_letters.choice(list(alphabet), n)) for alphabet, n in (("abcde ", 900), ("vwxyz ", 700), ("abxyz ", 5), ("é ", 1))]
    codes = np.concatenate([np.concatenate([langid._codes(t), np.repeat(langid._GAP, 3)]) for t in texts])
    starts = np.cumsum([0, *[len(langid._codes(t)) + 3 for t in texts[:-1]]])
    whole = langid.hashed(codes)
    for chunk in (1, 2, 7, 64, 10_000):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        parts = list(langid.stretches(codes, starts))
        assert (np.concatenate([h for _, _, h in parts], axis=1) == whole).all()
        sums = np.zeros(len(texts), np.int64)
        for first, begins, h in parts:
            sums[first : first + len(begins)] += np.add.reduceat(h[0], begins)
        assert (sums == np.add.reduceat(whole[0], starts)).all()


def test_items_without_an_id_hit_like_others(spark):
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, "a " + " ".join(words) + " b"), (2, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, " ".join(words[:10])), (7, " ".join(words[2:]))], "item_id long, text string")
    for size in (decontam.SHARD_BYTES, 40):
        got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontam.decontaminate(docs, items, shard_bytes=size).collect()}
        assert got == {1: (12, [7, None]), 2: (0, [])}
