"""WARC archives: a writer with revisit records, and a salvage reader.

Archives are sequences of gzip members, one per record, in files of bounded size written by tasks to the shared folder through
pyarrow's file systems.  The reader takes an archive's bytes, compressed or not, and checks each record: length fields, the
closing blank lines, and the payload digest.  After a failed check it searches for the next place at which a member or a version
line begins and reads on from there; the bytes between are one quarantined gap.  The same search runs inside a member, over
what could be decompressed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written

# Fixed values of the format.
VERSION, MEMBER, END = b"WARC/1.1\r\n", b"\x1f\x8b\x08", b"\r\n\r\n"
#: Smallest payload that is worth a revisit record, uncompressed bytes after which a file is closed, compression level.
LEAST_REVISIT, FILE_BYTES, LEVEL = 100, 32 << 20, 1
PREFIX = "urn:page:"
#: A version line, one that begins a line, and bytes that are decompressed at a time.
LINE, NEXT, PIECE = re.compile(rb"WARC/\d\.\d\r\n"), re.compile(rb"\nWARC/\d\.\d\r\n"), 1 << 16

RECORDS = "path string, at long, size long, kind string, reason string, record_id string, target string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def decide(pages: DataFrame) -> DataFrame:
    """Add payload (binary), payload_digest, payload_bytes and refers_to to pages (page_id, url, html).

    Of equal payloads of at least LEAST_REVISIT bytes the smallest page_id is the response.  Only digests are grouped; the
    first is found with partial sums before the shuffle, so a payload shared by a third of all pages is no hot group.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(body, "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.encode(body, "UTF-8").alias("p")).where(f"octet_length(p) >= {LEAST_REVISIT}")
    first = keys.select("page_id", F.sha2("p", 256).alias("payload_digest")).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select("payload_digest", "first"), "firsts")
    out = rows.join(F.broadcast(first) if first.limit(200_001).count() <= 200_000 else first.hint("merge"), "payload_digest", "left")
    return out.withColumn("refers_to", F.expr("if(first is null or page_id = first or page_id is null, null, first)")).drop("first")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    head = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <{PREFIX}{'' if page_id is None else page_id}>".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\r\n]", b" ", url.encode()))
    head += [f"WARC-Payload-Digest: sha256:{digest}".encode(), f"X-Payload-Length: {len(payload)}".encode()]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{PREFIX}{refers_to}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += [b"Content-Type: text/html", f"Content-Length: {len(payload)}".encode()]
    return VERSION + b"\r\n".join(head) + END + payload + END


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Write the records into files of ``folder``; returns the written manifest (path, records, bytes).

    A file is written under a name of its task attempt and then moved to the name of its partition, so a rerun replaces it by
    the same records.
    """

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, part, state = TaskContext.get(), 0, None

        def close():
            out, temp, name, n, size = state
            out.close()
            store.move(temp, name)
            return pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None:
                    name = f"{base}/part-{task.partitionId():06d}-{part:04d}.warc.gz"
                    temp = f"{base}/.{task.taskAttemptId()}-{part}"
                    state = [store.open_output_stream(temp), temp, name, 0, 0]
                data = record(*row)
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                state[0].write(pack.compress(data) + pack.flush())
                state[3] += 1
                state[4] += len(data)
                if state[4] >= FILE_BYTES:
                    yield close()
                    state, part = None, part + 1
        if state is not None:
            yield close()

    rows = decided.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def _parse(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at`` of uncompressed ``data``: fields, its end, and what failed."""
    stop = data.find(END, at, at + (1 << 16))
    if stop < 0 and data[at : at + 5] == b"WARC/":  # a long header: up to the next record's version line
        later = NEXT.search(data, at)
        stop = data.find(END, at, later.start() + 1 if later else len(data))
    if data[at : at + 5] != b"WARC/" or stop < 0:
        return None, at, "no version line or header end"
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return None, at, "a header line without a colon"
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit():
        return None, at, "no content length"
    body = stop + 4
    end = body + int(length)
    if data[end : end + 4] != END:
        return None, at, "content length doesn't lead to a record's end"
    payload, digest = data[body:end], fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "response" and digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest[7:]:
        return None, at, "payload digest differs"
    return fields | {"payload": payload}, end + 4, ""


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at ``at`` holds, its end, and what failed; a damaged or cut-off member gives the bytes before that."""
    view, unpack, out, pos = memoryview(data), zlib.decompressobj(31), [], at
    try:
        while pos < len(data) and not unpack.eof:
            out.append(unpack.decompress(view[pos : pos + PIECE]))
            pos = min(pos + PIECE, len(data))
    except zlib.error as e:
        unpack = zlib.decompressobj(31)
        out = [unpack.decompress(view[at:pos])]
        try:
            for i in range(pos, len(data)):  # fails within a piece
                out.append(unpack.decompress(view[i : i + 1]))
        except zlib.error:
            pass
        return b"".join(out), at, f"member: {e}"
    return b"".join(out), pos - len(unpack.unused_data), "" if unpack.eof else "member is cut off"


def _inside(whole: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(offset, size, fields, reason) over uncompressed data: records, and the gaps up to the next version line of one."""
    at, gap, why = 0, None, ""
    while at < len(whole):
        fields, end, reason = _parse(whole, at)
        if fields is None:
            if gap is None:
                gap, why = at, reason
            later = LINE.search(whole, at + 1)
            at = later.start() if later else len(whole)
            continue
        if gap is not None:
            yield gap, at - gap, None, why
            gap = None
        yield at, end - at, fields, ""
        at = end
    if gap is not None:
        yield gap, len(whole) - gap, None, why


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(offset, size, fields, reason) over an archive's bytes: records have fields, quarantined gaps have None and a reason.

    Every byte lies in exactly one record or gap.  Of a member with several parts the first has the member's size and the others
    0; a gap inside says where in the decompressed data it lies.  A damaged or cut-off member is a gap, skipped up to the next
    candidate place; the records found in what could be decompressed come before it, with size 0 (of a damaged one only
    responses whose digest is right, as a wrong byte can come out before the damage shows).
    """
    start = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
    at, gap, why = 0, None, ""
    while at < len(data):
        found, end, reason = [], at, ""
        if data.startswith(MEMBER, at):
            whole, end, reason = _inflate(data, at)
            found = [(f, "" if f else f"inside the member at {i}, {n} bytes: {x}") for i, n, f, x in _inside(whole)]
            if reason.startswith("member: "):
                found = [(f, x) for f, x in found if not f or (f.get("warc-type") == "response" and f.get("warc-payload-digest", "").startswith("sha256:"))]
            if not any(f for f, _ in found):
                reason, found = reason or (found[0][1] if found else ""), []
        elif data.startswith(b"WARC/", at):
            fields, end, reason = _parse(data, at)
            found = [] if fields is None else [(fields, "")]
        else:
            reason = "neither a member nor a version line"
        if found and not reason:
            if gap is not None:
                yield gap, at - gap, None, why
                gap = None
            for i, (fields, inner) in enumerate(found):
                yield at, end - at if not i else 0, fields, inner
            at = end
        else:
            for fields, inner in found:
                yield at, 0, fields, inner
            if gap is None:
                gap, why = at, reason or "empty member"
            later = start.search(data, at + 1)
            at = later.start() if later else len(data)
    if gap is not None:
        yield gap, len(data) - gap, None, why


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records and gaps (kind: record or gap) of all archives in ``folder``, with payloads; see RECORDS."""

    def run(batches):
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held = [], 0
                for at, size, f, why in salvage(data.as_buffer().to_pybytes() if hasattr(data, "as_buffer") else data.as_py()):
                    if f is None:
                        rows.append((path, at, size, "gap", why, None, None, None, None, None, None, None))
                    else:
                        length = f.get("x-payload-length", "")
                        rows.append((path, at, size, "record", None, f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-type"), f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha256:"), int(length) if length.isdigit() else len(f["payload"]), f["payload"]))
                        held += len(f["payload"])
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def log_gaps(found: DataFrame, path: str) -> None:
    """Append the quarantined byte gaps of ``found`` (rows of ``read_archives``) to the log table at ``path``."""
    found.where("kind = 'gap'").select(F.current_timestamp().alias("logged"), "path", "at", "size", "reason").write.mode("append").parquet(path)


ARROW = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as WARC archives and read them back, a row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to.

    A response's digest and size are those of the payload that was read; the reader has checked them against the header.  A
    null html is an empty payload, a null url has no target field, a null page_id is always a response.  Repeated page_ids stay
    repeated; a repeated smallest page_id is a response each time.  No pages give no rows.  Raises if the records read aren't as
    many as were written.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    manifest = write_archives(decide(pages), folder)
    sent = manifest.agg(F.sum("records")).first()[0]
    if not sent:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    number = lambda c: F.regexp_extract(c, rf"^<{PREFIX}(-?[0-9]+)>$", 1).try_cast("long")
    found = read_archives(spark, folder)
    own = F.col("record_type") == "response"
    back = found.select(
        "path",
        "at",
        "size",
        "kind",
        "reason",
        number("record_id").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
    back = written(back, "readback")
    log_gaps(back, f"{folder}-gaps")
    got = back.where("kind = 'record'").count()
    if got != sent:
        reasons = [r["reason"] for r in back.where("kind = 'gap'").select("reason").limit(3).collect()]
        raise RuntimeError(f"{sent} records were written and {got} read back; gaps are logged in {folder}-gaps: {reasons}")
    return back.where("kind = 'record'").drop("path", "at", "size", "kind", "reason")
