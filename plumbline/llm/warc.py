"""WARC archives in Zstandard: written with a dictionary in a leading skippable frame, read one frame for each record.

Which records revisit others is found by aggregates: payloads of at least ``LEAST`` bytes are counted by their SHA-256, by page
and as a whole, and only keys with several rows are joined back, salted for frequent keys. A revisit holds no payload, so it
crosses the join without one. Tasks write one archive after the other, of about ``ARCHIVE_BYTES`` at most, under names of their own,
and the index, a table that Spark commits, has those of the tasks that counted: whatever a lost or repeated task wrote is not in
it and is deleted at the end, as is what earlier runs left in the folder.

Reading gives one task an archive at a time, streams it from the file system, and holds one record at once. It checks
the dictionary's frame, that each frame holds one record and names the dictionary, the record's version, required headers, their
lengths, the block's digest, the HTTP head and the payload's digest. Anything else is a ``ValueError`` with file and offset.

Defined results: a null html is empty, and empty payloads are responses; a null page id is below all others; of repeated rows of the largest
page id one is the response and the others revisit it; control characters and white space in a url are written as %XX, a null url is left out;
columns other than the three named ones are not looked at; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Staging, frequent, salted_join, shared_dir, table, whole_text

#: Equal payloads of fewer bytes are written again.
LEAST = 1000
#: Compressed bytes after which a task begins another archive, records handed on at once, and bytes read at once.
ARCHIVE_BYTES, BATCH_BYTES, READ_BYTES = 1 << 28, 1 << 23, 1 << 20
#: The dictionary is trained on about so many pages drawn at random, without those of more bytes.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 16, 1 << 16
LEVEL, DATE = 3, "2024-01-01T00:00:00Z"
# fixed values of the formats
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
# end of fixed values
INDEX = "archive string, records bigint, bytes bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, archive string, offset bigint"


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def trained_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary, or none if the samples are too few or too small to train one."""
    try:
        return zstd.train_dictionary(size, samples, k=1024, d=8).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b""


def safe_url(url: Column) -> Column:
    """Control characters and white space as %XX."""
    return F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")


def planned(pages: DataFrame, staging: Staging, least: int = LEAST) -> DataFrame:
    """page_id, url, html, bytes, sha1, record_type, refers_to, refers_url: what to write; html is null in revisits.

    The keys with several rows are staged, so that Spark knows their size: it sends few of them to every task, and pages don't move.
    """
    html = whole_text("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), safe_url(F.col("url"))).otherwise(F.col("url")).alias("url"), html.alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long"))
    none = {"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")}
    out = ["page_id", "url", "html", "bytes", "sha1", "record_type", "refers_to", "refers_url"]
    small = rows.where(F.col("bytes") < least).withColumns({"sha1": F.sha1("html"), **none}).select(out)
    large = rows.where(F.col("bytes") >= least).withColumn("key", F.sha2("html", 256))
    same = large.groupBy("key", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    groups = same.groupBy("key").agg(F.max(F.struct("page_id", "url", "n")).alias("top"), F.sum("n").alias("count"))
    copied = staging.write(groups.where("count > 1"), "copied")
    joined = salted_join(large, copied, "key", frequent(copied, "key", "count"), "left")
    is_top = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))
    alone = F.col("top").isNull() | is_top
    # rows that are all the same as the response are counted, not told apart: one is written and n - 1 revisit it
    decided = joined.where(~F.coalesce(is_top & (F.col("top.n") > 1), F.lit(False))).select(
        "page_id", "url", F.when(alone, F.col("html")).alias("html"), "bytes", F.sha1("html").alias("sha1"), F.when(alone, "response").otherwise("revisit").alias("record_type"),
        F.when(~alone, F.col("top.page_id")).alias("refers_to"), F.when(~alone, F.col("top.url")).alias("refers_url"),
    )
    repeated = copied.where("top.n > 1")
    parts = small.unionByName(decided.select(out))
    if repeated.isEmpty():
        return parts
    texts = large.join(repeated.select("key"), "key", "left_semi").groupBy("key").agg(F.any_value("html").alias("html"), F.any_value("bytes").alias("bytes"))
    copies = repeated.join(texts, "key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top.n"))))
    first = F.col("copy") == 1
    again = copies.select(
        "top.page_id", "top.url", F.when(first, F.col("html")).alias("html"), "bytes", F.sha1("html").alias("sha1"), F.when(first, "response").otherwise("revisit").alias("record_type"),
        F.when(~first, F.col("top.page_id")).alias("refers_to"), F.when(~first, F.col("top.url")).alias("refers_url"),
    )
    return parts.unionByName(again.select(out))


def _id(page: int | None, url: str | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page}|{url}|{sha1}'.encode()).hexdigest()[:32])}>"


def record(page: int | None, url: str | None, html: str | None, size: int, sha1: str, kind: str, refers_to: int | None, refers_url: str | None, copy: str = "") -> bytes:
    """One WARC record with its ending; a revisit's block is the HTTP head alone. copy tells revisits of the same page apart."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + html.encode("utf-8", "surrogatepass")
    own = _id(page, url, sha1)
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {own if kind == 'response' else _id(page, f'{url}|{copy}', sha1)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {url}"] if url is not None else []
    lines += [f"Page-ID: {page}"] if page is not None else []
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to, refers_url, sha1)}"]
        lines += [f"WARC-Refers-To-Target-URI: {refers_url}"] if refers_url is not None else []
        lines += [f"Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return b"\r\n".join([VERSION, *(x.encode("utf-8", "surrogatepass") for x in lines), b"", block, b"", b""])


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages' archives into folder and returns, once they are written, one row for each of them."""
    from pyarrow import fs

    spark = pages.sparkSession
    fit = pages.select("html").where(F.rand(SAMPLE) < SAMPLE / max(1, pages.count())).where(F.octet_length("html").between(1, SAMPLE_BYTES))
    samples = [r["html"].encode("utf-8", "surrogatepass") for r in fit.collect()]
    shared = spark.sparkContext.broadcast(trained_dictionary(samples))
    system, root = file_system(folder)
    if system.get_file_info(root).type.name != "NotFound":
        system.delete_dir(root)  # archives of an earlier run

    def archives(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, raw = TaskContext.get().partitionId(), shared.value
        files, top = file_system(folder)
        packer = zstd.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **({"dict_data": zstd.ZstdCompressionDict(raw)} if raw else {}))
        state: dict = {"out": None, "k": 0}
        made: list[tuple[str, int, int]] = []

        def begin() -> None:
            files.create_dir(top, recursive=True)
            state["name"] = f"part-{part:06d}-{state['k']:04d}-{uuid.uuid4().hex}.warc.zst"
            state["out"], state["n"] = files.open_output_stream(f"{top}/{state['name']}", compression=None), 0
            first = SKIPPABLE.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw if raw else b""
            state["out"].write(first)
            state["bytes"] = len(first)

        def finish() -> None:
            state["out"].close()
            made.append((state["name"], state["n"], state["bytes"]))
            state["out"], state["k"] = None, state["k"] + 1

        for batch in it:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                if state["out"] is None:
                    begin()
                data = packer.compress(record(*row, copy=f"{part}|{state['k']}|{state['n']}"))
                state["out"].write(data)
                state["n"] += 1
                state["bytes"] += len(data)
                if state["bytes"] >= archive_bytes:
                    finish()
        if state["out"] is not None:
            finish()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["archive", "records", "bytes"])

    index = f"{folder.rstrip('/')}/index.parquet"
    staging = Staging(spark, "warc-keys")
    planned(pages, staging, least).mapInArrow(archives, INDEX).write.mode("overwrite").parquet(index)
    staging.drop()
    done = spark.read.schema(INDEX).parquet(index)
    kept = {r["archive"] for r in done.select("archive").toLocalIterator()}  # a name for each archive
    for found in system.get_file_info(fs.FileSelector(root)):
        if found.base_name.endswith(".warc.zst") and found.base_name not in kept:
            system.delete_file(found.path)
    return done


def frames(stream, name: str = "archive") -> Iterator[tuple[int, bytes]]:
    """Offset and content of each frame of a Zstandard archive after its dictionary."""

    def fail(what: str) -> ValueError:
        return ValueError(f"{name} at {at}: {what}")

    at, held, options = 0, stream.read(8), {}
    if len(held) == 8 and int.from_bytes(held[:4], "little") == SKIPPABLE:
        size = int.from_bytes(held[4:], "little")
        raw = stream.read(size)
        if len(raw) < size:
            raise fail("the dictionary is cut off")
        if int.from_bytes(raw[:4], "little") == FRAME:
            try:
                raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
            except zstd.ZstdError as e:
                raise fail(f"no dictionary: {e}") from e
        if int.from_bytes(raw[:4], "little") != DICTIONARY:
            raise fail("the leading skippable frame holds no dictionary")
        options, at, held = {"dict_data": zstd.ZstdCompressionDict(raw)}, 8 + size, b""
    wanted = options["dict_data"].dict_id() if options else 0
    unpacker = zstd.ZstdDecompressor(**options)
    while True:
        held = held or stream.read(READ_BYTES)
        if not held:
            return
        while len(held) < 18 and (more := stream.read(READ_BYTES)):  # a frame's longest head
            held += more
        if int.from_bytes(held[:4], "little") != FRAME:
            raise fail("no frame begins here")
        try:
            if zstd.get_frame_parameters(held).dict_id not in (0, wanted):
                raise fail("the frame needs another dictionary")
            frame, parts, size = unpacker.decompressobj(), [], 0
            while True:
                parts.append(frame.decompress(held))
                size += len(held)
                if frame.eof:
                    break
                held = stream.read(READ_BYTES)
                if not held:
                    raise fail("the frame is cut off")
        except zstd.ZstdError as e:
            raise fail(str(e)) from e
        held = frame.unused_data
        yield at, b"".join(parts)
        at += size - len(held)


def _headers(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        key = name.decode("utf-8", "replace").lower()
        if not colon or not key or key.strip() != key or key in found:
            raise ValueError(f"bad header {line[:60]!r}")
        found[key] = value.decode("utf-8", "surrogatepass").strip(" \t")
    return found


def _number(headers: dict[str, str], name: str) -> int | None:
    value = headers.get(name)
    if value is None:
        return None
    if not value.lstrip("-").isascii() or not value.removeprefix("-").isdigit():
        raise ValueError(f"{name} is no number: {value[:40]!r}")
    return int(value)


def parsed(data: bytes) -> tuple[dict[str, str], bytes | None, int, str]:
    """Headers, payload (none in a revisit), its size and its SHA-1 of the one record that data has to be."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (VERSION, b"WARC/1.0"):
        raise ValueError("no WARC record")
    headers = _headers(lines)
    if lacking := [x for x in REQUIRED if x not in headers]:
        raise ValueError(f"lacks {', '.join(lacking)}")
    size = _number(headers, "content-length")
    if size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"holds {len(rest) - 4} bytes where Content-Length says {size}")
    block = rest[:size]
    _digest_check(headers, "warc-block-digest", block)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return headers, None, 0, ""
    top, gap, payload = block.partition(b"\r\n\r\n")
    status, *own = top.split(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError("the block is no HTTP message")
    told = _number(_headers(own), "content-length")
    if kind == "revisit":
        if payload or told is None or "warc-refers-to" not in headers or headers.get("warc-profile") != PROFILE:
            raise ValueError("the revisit lacks its profile or what it refers to, or holds a payload")
        name, _, digest = headers.get("warc-payload-digest", "").partition(":")
        if name != "sha1" or len(digest) != 40 or set(digest) - set("0123456789abcdef"):
            raise ValueError("the revisit has no digest of its payload")
        return headers, None, told, digest
    if told is not None and told != len(payload):
        raise ValueError(f"the payload has {len(payload)} bytes where its Content-Length says {told}")
    return headers, payload, len(payload), _digest_check(headers, "warc-payload-digest", payload)


def _digest_check(headers: dict[str, str], name: str, data: bytes) -> str:
    digest = hashlib.sha1(data).hexdigest()
    if name in headers and headers[name] != f"sha1:{digest}":
        raise ValueError(f"{name} is not that of the data")
    return digest


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records of folder's archives (a column archive with their names), with payloads unless told otherwise."""
    n = max(1, min(archives.count(), 20_000))

    def records(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = file_system(folder)
        names = [c.split()[0] for c in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in it:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for offset, data in frames(stream, name):
                        try:
                            headers, payload, size, sha1 = parsed(data)
                            page, refers_to = _number(headers, "page-id"), _number(headers, "refers-to-page-id")
                        except ValueError as e:
                            raise ValueError(f"{name} at {offset}: {e}") from e
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        rows.append((page, headers.get("warc-target-uri"), headers["warc-type"], refers_to, size, sha1, payload if payloads else None, name, offset))
                        held += 300 + (len(payload) if payloads and payload else 0)
                        if held >= BATCH_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return archives.select("archive").repartition(n).mapInArrow(records, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """records with the payload of every revisit taken from the response of equal digest, size and page that it refers to."""
    full = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", F.col("payload").alias("_payload")).dropDuplicates(["refers_to", "payload_digest", "payload_bytes"])
    revisits = records.where("record_type = 'revisit'").withColumns({"_key": F.xxhash64("refers_to", "payload_digest", "payload_bytes")})
    full = full.withColumn("_key", F.xxhash64("refers_to", "payload_digest", "payload_bytes")).drop("refers_to", "payload_digest", "payload_bytes")
    hot = frequent(revisits.groupBy("_key").count(), "_key")
    found = salted_join(revisits, full, "_key", hot, "left").withColumn("payload", F.col("_payload")).select(records.columns)
    return records.where("record_type <> 'revisit'").unionByName(found)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
r AS (SELECT *, payload_bytes >= 1000 AS large, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN large AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN large AND place > 1 THEN top END AS refers_to FROM r
"""
