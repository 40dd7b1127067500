"""Fill-in-the-middle, archives and conversation repair: SQL over whole tables, brute force and round trips on small fixtures."""

import hashlib
import io
import random
import re
import zlib
from collections import defaultdict

import pandas as pd
import pytest
import zstandard as zstd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import fim, registry, repair, warc
from tests.compare import assert_same
from tests.conftest import DATA


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_warc", "op13_conversation_repair"])
def test_query_against_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    assert_same(got, duck.execute(registry.oracle_sql()[name]).fetchdf())


# fill-in-the-middle


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é\n\t\x0b <PSM>😀")), max_size=60), st.integers(0, 10**6))
def test_units_cuts_and_round_trip(text, key):
    ends = fim.unit_ends(text)
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(units) == text and [sum(map(len, units[: i + 1])) for i in range(len(units))] == list(ends)
    n, form, prefix, middle, output = fim.arrange(str(key), text, 42, 100, 50)
    assert n == len(units) and fim.restore(output, form) == text
    if form != "plain":
        assert sorted(output) == sorted(text + "<P><S><M>")
        assert output.endswith("<M>" + text[prefix : prefix + middle])


def test_fim_rows(spark):
    long = "word " * 400_000 + " " * 100_000
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c", "x"), (3, "has <S> in it " * 9, "x"), (4, long, "x"), (5, "a b c d", "x"), (5, "a b c d", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Form string")
    got = fim.fill_in_middle(df, rate=100)
    assert [c.lower() for c in got.columns].count("form") == 1
    done = got.collect()
    assert len(done) == len(rows)
    for r in done:
        text = r.text or ""
        assert fim.restore(r.output, r.form) == text and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert (r.form == "plain") == (not text or "<S>" in text)
    assert {r.n for r in done if r.doc_id in (1, 2)} == {0}
    assert len({r.output for r in done if r.doc_id == 5}) == 1
    assert fim.fill_in_middle(df.limit(0)).count() == 0


# archives


def pages(spark):
    rows = [(1, "u1", "a" * 1200), (2, "u2", "a" * 1200), (3, "u3", "b" * 999), (4, "u4", "b" * 999), (5, None, None), (None, "x y\n", "a" * 1200), (7, "u7", "c" * 2000), (7, "u7", "c" * 2000), (7, "u7", "c" * 2000), (7, "u6", "c" * 2000)]
    rows += [(8, "u8", "é" * 500), (9, "u9", "é" * 500), (None, "n", "d" * 1000), (None, "n", "d" * 1000), (10, "big", "<p>text</p>" * 300_000)] + [(100 + i, f"h{i}", "hot" * 500) for i in range(200)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark, tmp_path):
    import duckdb

    rows, df = pages(spark)
    folder = str(tmp_path / "w")
    warc.write_archives(df.withColumn("key", F.lit("clash")), folder)
    index = warc.write_archives(df, folder, archive_bytes=4000)  # again, into the same folder
    assert index.agg(F.sum("records")).first()[0] == len(rows) and {p.name for p in (tmp_path / "w").glob("*.zst")} == {r.archive for r in index.collect()}
    records = warc.read_archives(index, folder)
    frame = pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    con = duckdb.connect()
    con.register("pages", frame)
    assert_same(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").toPandas(), con.execute(warc.ORACLE).fetchdf())
    whole = sorted((r.page_id or 0, r.url or "", bytes(r.payload).decode()) for r in warc.resolved(records).collect())
    assert whole == sorted((p or 0, (u or "").replace(" ", "%20").replace("\n", "%0A"), h or "") for p, u, h in rows)
    assert warc.read_archives(warc.write_archives(df.limit(0), folder), folder).count() == 0


def archive(records: list[bytes], dictionary: bytes = b"") -> bytes:
    packer = zstd.ZstdCompressor(**({"dict_data": zstd.ZstdCompressionDict(dictionary)} if dictionary else {}))
    head = warc.SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else b""
    return head + b"".join(packer.compress(r) for r in records)


def one(payload: str = "x" * 50, **changes) -> bytes:
    kind = changes.get("kind", "response")
    sha1 = hashlib.sha1(payload.encode()).hexdigest()
    return warc.record(1, "u", payload, len(payload.encode()), sha1, kind, 2 if kind == "revisit" else None, "v" if kind == "revisit" else None)


def read(data: bytes) -> list:
    return [warc.parsed(x) for _, x in warc.frames(io.BytesIO(data), "a")]


def test_reader_takes_what_is_sound():
    random.seed(1)
    samples = [" ".join(random.choices(["alpha", "beta", "<p>", "</p>", "gamma"], k=200)).encode() for _ in range(200)]
    dictionary = warc.trained_dictionary(samples, 4096)
    assert dictionary and warc.trained_dictionary([b"a"]) == b""
    for own in (b"", dictionary):
        got = read(archive([one(), one(kind="revisit")], own))
        assert [(h["warc-type"], n) for h, _, n, _ in got] == [("response", 50), ("revisit", 50)]
        assert got[0][3] == got[1][3] == hashlib.sha1(b"x" * 50).hexdigest()
    packed = zstd.ZstdCompressor().compress(dictionary)  # a dictionary may be compressed itself
    data = archive([one()], dictionary)[8 + len(dictionary) :]
    assert len(read(warc.SKIPPABLE.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + data)) == 1
    assert read(b"") == []
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert read(archive([info]))[0][0]["warc-type"] == "warcinfo"


def test_reader_refuses_what_is_damaged():
    random.seed(2)
    samples = [" ".join(random.choices(["alpha", "beta", "<p>", "</p>"], k=200)).encode() for _ in range(200)]
    dictionary, other = warc.trained_dictionary(samples, 4096), warc.trained_dictionary([s[::-1] for s in samples], 4096)
    good = archive([one()], dictionary)
    swapped = other and warc.SKIPPABLE.to_bytes(4, "little") + len(other).to_bytes(4, "little") + other + good[8 + len(dictionary) :]
    cases = {
        "cut off": good[:-3], "the dictionary is cut": good[:100], "no frame begins": good + b"tail of another kind", "another dictionary": swapped,
        "holds no dictionary": warc.SKIPPABLE.to_bytes(4, "little") + (4).to_bytes(4, "little") + b"junk" + archive([one()]),
        "Content-Length": archive([one().replace(b"Content-Length: 50", b"Content-Length: 49", 1)]), "two records": archive([one() + one()]), "no WARC": archive([b"hello\r\n\r\n"]),
        "lacks": archive([one().replace(b"WARC-Date", b"X-Date")]), "payload digest": archive([one().replace(b"x" * 50, b"y" * 50)]), "bad header": archive([one().replace(b"WARC-Date:", b"WARC-Date")]),
        "twice": archive([one().replace(b"WARC-Date", b"WARC-Type", 1)]), "number": archive([re.sub(rb"\r\nContent-Length: \d+", rb"\r\nContent-Length: x", one())]), "profile": archive([one(kind="revisit").replace(b"WARC-Profile", b"X-Profile")]),
    }
    for data in cases.values():
        with pytest.raises(ValueError):
            read(data)


# conversation repair


def brute(rows):
    """(cost, audit, text) by trying all edits of short conversations: each row is (role, text, gone, truncated)."""
    best = None

    def walk(i, state, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and state in (0, 3):
            best = min(best, (cost, audit, tuple(out))) if best else (cost, audit, tuple(out))
        if len(audit) - i < 2 * len(rows) + 2:
            role = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
            walk(i, {0: 2, 1: 2, 2: 3, 3: 2}[state], cost + 3, audit + "I", [*out, f"{role}:"])
        if i < len(rows):
            role, text, gone, cut = rows[i]
            walk(i + 1, state, cost + 4, audit + "D", out)
            if not gone:
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
                if to is not None:
                    walk(i + 1, to, cost + 3 * cut, audit + "K", [*out, f"{role}:{text}"])
                new = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
                walk(i + 1, {0: 2, 1: 2, 2: 3, 3: 2}[state], cost + 3 + 3 * cut, audit + "R", [*out, f"{new}:{text}"])

    walk(0, 0, 0, "", [])
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "ux", "é"]), st.sampled_from(["a", "", "b\nc"]), st.booleans(), st.booleans()), max_size=4))
def test_search_finds_the_least_weight(rows):
    search = repair.Repair()
    for role, text, gone, cut in rows:
        search.row(role[:1], role.encode() + b":", text.encode(), gone, cut)
    assert search.result() == brute(rows)


def plain(rows):
    """The whole contract of a table in Python, with the search by brute force replaced by full strings in a forward pass."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, faults, prepared = {r[0] for r in own if r[0] is not None}, set(), [0, 0, 0], []
        for _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                faults[kind] += 1
            prepared.append((role, text, kind in (0, 1), kind == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        search = repair.Repair()
        for role, text, gone, cut in prepared:
            search.row(role[:1], role.encode() + b":", text.encode(), gone, cut)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, *search.result())
    return out


def test_repair_rows(spark, duck):
    random.seed(3)
    rows = [(None, 0, "user", "hi."), (None, None, "system", "x"), (None, 1, None, None), (7, 1, "assistant", "　"), (7, 9, "assistant", "é…"), (8, 1, "system", "s."), (8, 1, "system", "s."), (8, 3, "user", "x\v"), (9, 1, "user", "long. " * 200_000)]
    rows += [(100 + i, random.choice([None, 1, 2, 3, 4, 5, 6]), random.choice(["user", "assistant", "system", "", None, "ux"]), random.choice(["a.", "b!", "c", "", " ", "d?\n", None])) for i in range(60) for _ in range(random.randint(1, 9))]
    hot = [(1, i, ("user", "assistant")[i % 2], "same." if i % 5 == 0 else f"t{i}.") for i in range(3000)]
    df = spark.createDataFrame(rows + hot, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(df)).collect()}
    wanted = plain(rows + hot)
    assert set(got) == {r[0] for r in rows + hot}
    for conv, values in wanted.items():
        assert got[conv] == values, conv
    empty = repair.repair(repair.damaged(df.limit(0)))
    assert empty.count() == 0 and empty.columns[0] == "conv_id"


def test_a_conversation_that_is_dropped_whole_has_zeros(spark):
    gone = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    r = repair.repair(repair.damaged(spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string"))).first()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
