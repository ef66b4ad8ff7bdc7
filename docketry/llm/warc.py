"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: each page becomes a record, gzip-compressed as a member of its own, in archive files of the
shared folder. A task writes under a name of its own and reports it; only reported files count, so
that retried tasks do no harm. Of records with equal payloads the one with the largest page_id is a
response, and the others are revisits that refer to it.

Reading: an archive is cut into byte ranges. A task scans its range for the gzip magic number, takes
each place as a candidate, and validates it by decoding the member's first bytes up to a WARC header.
It owns the records that start inside its range and reads past the range's end to finish the last.
Bytes inside a member that look like the magic fail the validation or lie inside an owned member; a record that a
payload holds, and that a range which starts inside the payload takes for one, is dropped by its place: a record
starts where none before it in the file still lasts.

Plain archives (.warc) are read by the same ranges; there a record starts at the file's begin or after an empty line. A member may hold several records, one
after another. Archives of others are read too: a record without our fields has no page_id, the digest of its header or of its block,
and the bytes of its block; the digest of a payload is checked where the header counts its bytes as ours do.

Defined cases: null html is an empty payload. Rows with equal page_id and payload are all responses if
that id is the group's largest. A null page_id gets a record without id; it is never referred to, and
revisits another if one has an id. Payloads under min_bytes are all responses. Empty table: no records. A very long payload is decoded whole by one
task, whose memory it must fit; payloads are read into rows only if asked for. Only page_id, url and html are read, whatever the other columns are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.common import by_bytes, cut, shared_dir, table

MIN_BYTES, SPLIT_BYTES, CHUNK, LEVEL, MOST_TASKS = 0, 8 << 20, 1 << 20, 4, 100_000
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
HEAD = b"WARC/1."
LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", re.IGNORECASE)
ID, REFERS, PAYLOAD_BYTES = "WARC-Record-ID", "WARC-Refers-To", "X-Payload-Bytes"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    lines = {
        "WARC-Type": "revisit" if revisit else "response",
        ID: f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": "".join(c for c in url or "" if c.isprintable()),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        PAYLOAD_BYTES: str(len(payload)),
        "Content-Type": "text/html",
    }
    if revisit:
        lines |= {REFERS: f"<urn:page:{refers_to}>", "WARC-Profile": REVISIT_PROFILE}
    lines["Content-Length"] = str(len(block))
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the response of a revisit, else null.

    Payloads meet by digest, maxima are pre-aggregated, and only the revisits' ids go to the pages.
    """
    keyed = cut(pages.select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"), F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)).alias("key")))
    heads = keyed.where(F.col("bytes") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null").drop("n")
    revisits = keyed.where(F.col("bytes") >= min_bytes).join(heads, "key").where("not page_id <=> head")
    links = revisits.select(F.col("page_id").alias("__id"), F.col("head").alias("refers_to"), F.col("key").alias("__key")).distinct()
    own = pages.select("page_id", "url", "html")
    return own.join(links, own.page_id.eqNullSafe(F.col("__id")) & (F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)) == F.col("__key")), "left").drop("__id", "__key")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes pages as archives under folder; returns the committed files (path, bytes, records)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        name, out, size, n = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in by_bytes(batches, "html"):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                member = record(page_id, url, (html or "").encode(), refers_to)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

    return cut(with_revisits(pages, min_bytes).mapInArrow(run, "path string, bytes long, records long"))


def members(store: arrow_fs.FileSystem, path: str, start: int, stop: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, content): the decoded gzip members that start within [start, stop) of a file and begin with a WARC header."""
    with store.open_input_file(path) as f:
        size = f.size()
        stop, base, data = min(stop, size), start, bytearray()
        at = start  # the next place to look at

        def more() -> bool:
            got = f.read_at(min(CHUNK, size - base - len(data)), base + len(data)) if base + len(data) < size else b""
            data.extend(got)
            return bool(got)

        while at < stop:
            if at - base > CHUNK:
                del data[: at - base]
                base = at
            if at - base + len(MAGIC) > len(data) and not more():
                return
            found = data.find(MAGIC, at - base)
            if found < 0:
                at = max(at, base + len(data) - len(MAGIC) + 1)
                if not more():
                    return
                continue
            at = base + found
            if at >= stop:
                return
            unpack, out, taken, ok = zlib.decompressobj(31), bytearray(), found, True
            try:
                while ok and not unpack.eof:
                    if taken >= len(data) and not more():
                        ok = False
                        break
                    piece = bytes(data[taken : taken + (1 << 16)])
                    out += unpack.decompress(piece)
                    taken += len(piece) - len(unpack.unused_data)
                    ok = out[: len(HEAD)] == HEAD[: len(out)]
            except zlib.error:
                ok = False
            if ok and len(out) >= len(HEAD):
                yield at, base + taken, bytes(out)
                at = base + taken
            else:
                at += 1


def plain_records(store: arrow_fs.FileSystem, path: str, start: int, stop: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, content): the records of a file without compression that start within [start, stop), at its begin or after an empty line."""
    with store.open_input_file(path) as f:
        size = f.size()
        at, mark = start, b"\r\n\r\n" + HEAD
        while at < min(stop, size):
            low = max(at - 4, 0)
            window = f.read_at(min(CHUNK, size - low), low)
            found = 0 if at == 0 and window.startswith(HEAD) else window.find(mark) + 4
            if found == 3:
                at = low + len(window) - len(mark) + 5 if low + len(window) < size else size
                continue
            at = low + found
            if at >= stop:
                return
            head, step = b"", CHUNK
            while (cut_at := head.find(b"\r\n\r\n")) < 0 and at + len(head) < size:
                head += f.read_at(min(step, size - at - len(head)), at + len(head))
            length = LENGTH.search(head, 0, cut_at + 4) if cut_at >= 0 else None
            end = min(cut_at + 4 + int(length[1]), size - at) if length else len(head)
            yield at, at + end, f.read_at(end, at)
            at += max(end, 1)


def sha1(block: bytes) -> str:
    return base64.b32encode(hashlib.sha1(block).digest()).decode()


def records_of(content: bytes) -> Iterator[bytes]:
    """The records that follow one another in a decoded member, by their Content-Length; a record without one takes the rest."""
    at = 0
    while content.startswith(HEAD, at):
        body = content.find(b"\r\n\r\n", at) + 4
        length = LENGTH.search(content, at, body) if body > 3 else None
        end = min(body + int(length[1]), len(content)) if length else len(content)
        yield content[at:end]
        at = end + 4 if content.startswith(b"\r\n\r\n", end) else end
    if content[at:].strip():
        raise ValueError(f"{len(content) - at} bytes of a member follow its last record")


def parsed(member: bytes) -> dict:
    """Fields of one decoded record; the payload of our responses is digested anew and must match its header."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    length, counted = fields.get("content-length", ""), fields.get(PAYLOAD_BYTES.lower(), "")
    block = rest[: int(length)] if length.isdigit() else rest.removesuffix(b"\r\n\r\n")
    kind, digest = fields.get("warc-type", "").lower(), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and counted.isdigit() and sha1(block) != digest:
        raise ValueError(f"payload of {fields.get(ID.lower())} does not match its digest")

    def page(name: str) -> int | None:
        x = fields.get(name.lower(), "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x.removeprefix("-").isdigit() else None

    return {
        "page_id": page(ID), "url": fields.get("warc-target-uri"), "payload_bytes": int(counted) if counted.isdigit() else len(block), "payload_digest": digest or sha1(block), "record_type": kind, "refers_to": page(REFERS),
        "payload": None if kind == "revisit" else block,
    }


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Records of files (path, bytes), read by byte ranges of split_bytes."""
    schema = "path string, start long, end long, " + (RECORD if payload else RECORD.removesuffix(", payload binary"))
    names = [x.split()[0] for x in schema.split(", ")]
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, inner = open_fs(path)
                rows, size = [], 0
                find = members if path.endswith(".gz") else plain_records
                for first, end, member in find(store, inner, start, start + split_bytes):
                    rows += [parsed(r) | {"path": path, "start": first, "end": end} for r in records_of(member)]
                    size += len(member)
                    if size > (4 << 20):
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[t]) for n, t in (x.split() for x in schema.split(", "))], names=names)

    ranges = cut(ranges)
    found = ranges.repartition(max(1, min(ranges.count(), MOST_TASKS))).mapInArrow(run, schema)
    before = Window.partitionBy("path").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    if not payload:
        return found.withColumn("until", F.max("end").over(before)).where("until is null or start >= until").drop("path", "start", "end", "until")
    # places alone are compared, and few are dropped: payloads don't meet in a task
    inner = found.select("path", "start", "end").withColumn("until", F.max("end").over(before)).where("start < until").select("path", "start").distinct()
    return found.join(cut(inner), ["path", "start"], "left_anti").drop("path", "start", "end")


def list_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives in a folder, compressed or plain, from the listing alone."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc.gz,warc}").load(folder).select("path", F.col("length").alias("bytes"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_warc(files, payload=False).drop("url")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
h AS (SELECT html, max(page_id) AS head FROM p GROUP BY html),
x AS (SELECT p.page_id, p.digest, octet_length(encode(p.html)) AS payload_bytes, h.head FROM p JOIN h ON p.html = h.html),
bits AS (SELECT page_id, payload_bytes, head, array_to_string(list_transform(range(40), lambda i:
    substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(digest, CAST(i AS INTEGER) + 1, 1)) - 1) + 1, 4)), '') AS b FROM x)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(5), lambda j:
    CAST(substr(b, CAST(5 * i + j AS INTEGER) + 1, 1) AS INTEGER) * (16 // CAST(pow(2, j) AS INTEGER))))::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM bits
"""
