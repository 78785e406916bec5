"""WARC archives: written by tasks into a shared folder, read back by splits of any size.

A file is a row of gzip members, one per record. A reading task gets a byte range, looks in it for the magic of a
gzip member, takes a candidate as a member only if it decompresses to a WARC version line, and from there follows
the members. It owns the records that start inside its range and reads on past the end to finish the last.
A file that holds other WARC files uncompressed inside its members is not handled by this search.

Folders are addresses of ``pyarrow.fs`` (``file://``, ``hdfs://``, ``s3://`` and so on).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrain.llm.shared import bit_set, bounded_batches, shared_folder, stored, with_maybe
from voicegrain.operators.skew import skew_join

MAGIC = b"\x1f\x8b\x08"
GZIP = 31  # zlib's window bits for a gzip member
CHUNK = 1 << 16
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# writing

def plan_records(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads of ``min_bytes`` at least, the smallest id answers.

    ``refers_to`` is null for responses. A null html is an empty payload. Rows with a null id, and repeats of the
    answering id, are responses too. Other columns are left out.
    """
    rows = pages.select(
        F.col(f"`{key}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("_digest", F.concat_ws(":", F.sha1("payload"), F.octet_length("payload")))
    large = F.octet_length("payload") >= min_bytes
    repeated = stored(
        rows.where(large).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").select("_digest", "_first")
    )
    flagged = with_maybe(rows, "_digest", bit_set(repeated, "_digest"), "_maybe")
    alone = flagged.where(~F.col("_maybe")).withColumn("refers_to", F.lit(None).cast("bigint"))
    others = skew_join(flagged.where("_maybe"), repeated, "_digest", ["page_id"], "left").withColumn(
        "refers_to", F.when(large & (F.col("_first") != F.col("page_id")), F.col("_first"))
    )
    columns = ["page_id", "url", "payload", "refers_to"]
    return alone.select(columns).unionByName(others.select(columns))


def _name(number: int | None) -> str:
    return f"<urn:page:{'' if number is None else number}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit that only names the response and the digest."""
    revisit = refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, file_bytes: int = 1 << 28, level: int = 3) -> DataFrame:
    """Write records and return ``path, bytes, records`` of each file of the tasks that succeeded.

    Every attempt of a task writes files of its own, so a repeated task leaves at most files that nobody lists.
    """
    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for i in range(batch.num_rows):
                if out is None:
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                member = packer.compress(record(*[c[i].as_py() for c in columns])) + packer.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), *[pa.array([d[i] for d in done], pa.int64()) for i in (1, 2)]],
            ["path", "bytes", "records"],
        )

    bounded_batches(records.sparkSession)
    return stored(records.mapInArrow(write, "path string, bytes bigint, records bigint"))


# reading

def starts_record(file, at: int) -> bool:
    """Whether a gzip member at ``at`` begins with a WARC version line."""
    file.seek(at)
    unpacker = zlib.decompressobj(GZIP)
    seen = b""
    try:
        while len(seen) < len(VERSION) and not unpacker.eof and (chunk := file.read(512)):
            seen += unpacker.decompress(chunk, 64)
    except zlib.error:
        return False
    return seen.startswith(VERSION)


def next_record(file, at: int, end: int) -> int | None:
    """The first place of a record's member in ``at <= place < end``."""
    while at < end:
        file.seek(at)
        chunk = file.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        place = chunk.find(MAGIC)
        while place >= 0:
            if at + place < end and starts_record(file, at + place):
                return at + place
            place = chunk.find(MAGIC, place + 1)
        at += CHUNK
    return None


def whole_member(file, at: int) -> tuple[bytes, int]:
    """The member's content and the place after it."""
    file.seek(at)
    unpacker, parts = zlib.decompressobj(GZIP), []
    while not unpacker.eof:
        if not (chunk := file.read(CHUNK)):
            raise EOFError(f"the member at {at} is cut off")
        at += len(chunk)
        parts.append(unpacker.decompress(chunk))
    return b"".join(parts), at - len(unpacker.unused_data)


def records_in(file, start: int, end: int):
    """``(place, content)`` of the records that start in ``start <= place < end``."""
    at = next_record(file, start, end)
    while at is not None and at < end:
        content, after = whole_member(file, at)
        yield at, content
        at = after if after < end and starts_record(file, after) else next_record(file, after, end)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    headers = {name.strip().lower(): value.strip() for name, _, value in pairs}
    return headers, rest[: int(headers.get("content-length", len(rest)))]


SCHEMA = pa.schema([
    ("path", pa.string()), ("place", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("url", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload", pa.binary()),
])


def read_archives(spark: SparkSession, files: DataFrame, folder: str, split_bytes: int = 1 << 25) -> DataFrame:
    """The records of ``files`` (``path, bytes``): place, type, ids, url, digest and payload; no files, no rows.

    ``digest`` is the header's, without the name of its algorithm; a response whose payload does not match it ends the
    job. The payload of a revisit is empty.
    """
    ranges = files.where("bytes > 0").select("path", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint")
    )).alias("start"))
    ranges = ranges.repartition(max(1, ranges.count()))  # a task for each range; adaptive plans would join them

    def row(path, place, content):
        headers, block = parse(content)
        http = headers.get("content-type", "").startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        url, digest = headers.get("warc-target-uri"), headers.get("warc-payload-digest", "").rpartition(":")[2] or None
        if headers.get("warc-type") == "response" and digest not in (None, payload_digest(payload)):
            raise ValueError(f"{path}, {place}: the payload does not match its digest")
        return (
            path, place, headers.get("warc-type"), headers.get("warc-record-id"),
            url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"), headers.get("warc-refers-to"),
            digest, payload,
        )

    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA
        )

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for part in batches:
            for path, start in zip(part.column("path").to_pylist(), part.column("start").to_pylist(), strict=True):
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for place, content in records_in(file, start, min(start + split_bytes, file.size())):
                        rows.append(row(path, place, content))
                        held += len(content)
                        if held > 1 << 24:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    return ranges.mapInArrow(read, "path string, place bigint, record_type string, record_id string, url string, "
                                   "refers_to string, digest string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Adds ``page_id``, ``refers_to`` as numbers, and ``payload_bytes`` and ``payload_digest`` of the full payload:
    a revisit's length is that of the response it names."""
    def as_id(column):
        digits = F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1)
        return F.when(digits != "", digits.cast("bigint"))

    def named(column):
        return F.concat_ws(":", column, "digest")

    slim = stored(records.select(
        as_id("record_id").alias("page_id"), "record_type", as_id("refers_to").alias("refers_to"), "digest",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
    ))
    lengths = slim.where("record_type = 'response'").groupBy(named("page_id").alias("_named")).agg(
        F.max("payload_bytes").alias("_bytes")
    )
    revisits = slim.where("record_type = 'revisit'").withColumn("_named", named("refers_to")).drop("payload_bytes")
    columns = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    found = skew_join(revisits, lengths, "_named", ["page_id"], "left").withColumnRenamed("_bytes", "payload_bytes")
    return slim.where("record_type = 'response'").select(*columns).unionByName(found.select(*columns))


def round_trip(pages: DataFrame, min_bytes: int = 0, split_bytes: int = 1 << 25, **names) -> DataFrame:
    """Write every page as a record, read the archives back and return what they say of each page."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    folder = folder if "://" in folder else f"file://{folder}"
    files = write_archives(plan_records(pages, min_bytes, **names), folder)
    return resolved(read_archives(spark, files, folder, split_bytes))
