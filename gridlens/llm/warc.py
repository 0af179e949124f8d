"""WARC archives: writer and splittable reader (operator 8).

Writing: one gzip member per record, several archives below a shared folder.  Records with equal
payloads share one ``response`` (the largest id); the others are ``revisit`` records that refer to
it and carry no payload, only its digest and, in the HTTP header, its length.

Reading: archives are cut into byte ranges, one task each.  A task scans its range for the gzip
magic, takes a candidate for a member only if decoding it gives a WARC header, a block of the
stated length and the right checksum, and owns the records that start inside its range (the last
one may end beyond it).  After a member the next one starts, so a task scans bytes only up to its
first member; that one must also be followed by another member or the file's end, so that an
archive stored inside a payload isn't taken for the outer one.

Cases: a null payload counts as empty; a null id is written as an empty id, read back as null, and
is never a revisit; rows repeated with the same id and payload are all responses; a null url writes
no target; an empty table writes no archive and reads back as an empty table; other columns are
not looked at.  A task that runs twice writes the same bytes under the same name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("path string, offset long, record_type string, record_id string, target_uri string, "
          "payload_bytes long, payload_digest string, refers_to string, payload binary")
NAMES = [f.split()[0] for f in RECORD.split(", ")]
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES, READ_BYTES, FILE_BYTES, LEVEL = 32 << 20, 1 << 20, 1 << 30, 6
#: A record header longer than this isn't one.
HEADER_BYTES = 1 << 20
_REASON = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style uri (``file:/x`` has one slash there)."""
    if uri.startswith("/"):
        uri = "file://" + uri
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ------------------------------------------------------------------ writing
def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    name = "urn:page:" + ("" if page_id is None else str(page_id))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [] if url is None else [("WARC-Target-URI", re.sub(r"[\r\n\t ]", lambda m: f"%{ord(m[0]):02X}", url))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + digest(payload))]
    if refers_to is None:
        return record("response", name, fields, http + payload)
    return record("revisit", name, [*fields, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _REASON)], http)


def member(raw: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): equal payloads of at least ``least_bytes`` refer to the largest id's."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256)))
    # only payloads found twice come back: rows are partly aggregated before the shuffle, and a payload
    # that a third of all pages share meets one owner row, whose join side Spark splits
    owners = (rows.groupBy(F.col("same").alias("owned")).agg(F.count("*").alias("n"), F.max("page_id").alias("owner"))
              .filter("n > 1 and owned is not null").drop("n"))
    joined = rows.join(owners, rows.same == owners.owned, "left")
    return joined.select("page_id", "url", "payload",
                         F.when(F.col("page_id") != F.col("owner"), F.col("owner")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, refers_to) rows below ``folder``; returns (path, records, bytes) per archive."""
    def run(batches):
        fs, base = filesystem(folder)
        part, at, out, n, size, temp, made = TaskContext.get().partitionId(), 0, None, 0, 0, "", []

        def close():
            out.close()
            name = f"{base}/part-{part:06d}-{at:04d}.warc.gz"
            fs.move(temp, name)  # a second attempt of this task replaces it by the same bytes
            made.append((name, n, size))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is not None and size >= file_bytes:
                    close()
                    out, at = None, at + 1
                if out is None:
                    fs.create_dir(base, recursive=True)
                    temp, n, size = f"{base}/.{uuid.uuid4().hex}.writing", 0, 0
                    out = fs.open_output_stream(temp)
                    first = member(record("warcinfo", f"urn:archive:{part}-{at}", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), level)
                    out.write(first)
                    size += len(first)
                data = member(page_record(page_id, url, payload, refers_to), level)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["path", "records", "bytes"])

    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)  # an empty table has an archive folder, too
    ordered = rows.select("page_id", "url", "payload", "refers_to").sortWithinPartitions("page_id", F.sha2("payload", 256), "url")
    return ordered.mapInArrow(run, "path string, records long, bytes long")


# ------------------------------------------------------------------ reading
class Window:
    """Bytes of a file from any offset on, read in blocks; only what lies ahead is kept."""

    def __init__(self, file, size: int, block: int = READ_BYTES):
        self.file, self.size, self.block, self.at, self.data = file, size, block, 0, b""

    def get(self, offset: int, n: int) -> bytes:
        """Up to ``n`` bytes at ``offset`` (fewer at the file's end)."""
        stop = min(offset + n, self.size)
        if offset < self.at or offset > self.at + len(self.data):
            self.at, self.data = offset, b""
        if stop > self.at + len(self.data):
            have = self.at + len(self.data)
            self.file.seek(have)
            more = self.file.read(min(max(stop - have, self.block), self.size - have))
            self.data = self.data[offset - self.at:] + more
            self.at = offset
        return self.data[offset - self.at:stop - self.at]


def decode_member(window: Window, offset: int, header_only: bool = False):
    """(header fields, block, end of the member) at ``offset``; None if no sound record starts there."""
    if window.get(offset, 3) != MAGIC:
        return None
    z, parts, total, at, fields, start = zlib.decompressobj(31), [], 0, offset, None, 0
    try:
        while not z.eof:
            raw = window.get(at, 4096 if at == offset else 1 << 16)
            if not raw:
                return None
            out = z.decompress(raw)
            at += len(raw)
            parts.append(out)
            total += len(out)
            if fields is None:
                head = b"".join(parts)
                parts = [head]
                if not b"WARC/".startswith(head[:5]):
                    return None
                if (start := head.find(b"\r\n\r\n") + 4) > 3:
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[:start - 4].decode("utf-8", "replace").split("\r\n")[1:])}
                    if not (fields.get("content-length", "").isdigit() and "warc-type" in fields and "warc-record-id" in fields):
                        return None
                    if header_only:
                        return fields, b"", at
                elif total > HEADER_BYTES:
                    return None
    except zlib.error:
        return None
    size = int(fields["content-length"]) if fields else -1
    if fields is None or total != start + size + 4:
        return None
    return fields, b"".join(parts)[start:start + size], at - len(z.unused_data)


def records_of(window: Window, start: int, end: int):
    """(offset, fields, block) of the records that start in [start, end)."""
    at, sure = start, start == 0
    while at < min(end, window.size):
        found = decode_member(window, at)
        if found and not sure:  # the first one here: what follows must be a member as well
            if found[2] < window.size and decode_member(window, found[2], header_only=True) is None:
                found = None
        if found:
            yield at, found[0], found[1]
            at, sure = found[2], True
            continue
        sure = False  # not at a member: scan
        at += 1
        while at < end:
            raw = window.get(at, READ_BYTES)
            hit = raw.find(MAGIC)
            if hit >= 0:
                at += hit
                break
            if len(raw) < 3 or at + len(raw) >= window.size:
                return
            at += len(raw) - 2


def parse(path: str, offset: int, fields: dict, block: bytes) -> tuple:
    kind, payload, size = fields["warc-type"], None, 0
    said = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    if fields.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "revisit":
            m = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            size = int(m[1]) if m else None
        else:
            payload, size = body, len(body)
            own = digest(body)
            if said not in (None, own):
                raise ValueError(f"payload digest differs in {path} at {offset}")
            said = own
    else:
        payload, size = block, len(block)
    strip = lambda k: fields[k].strip("<>") if k in fields else None
    return path, offset, kind, strip("warc-record-id"), fields.get("warc-target-uri"), size, said, strip("warc-refers-to"), payload


def read_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of all ``*.warc.gz`` files below ``folder``, read in byte ranges of ``split_bytes``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    ranges = (files.select("path", "length").filter("length > 0")
              .select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start")))
    # ranges are few and small: deal them out evenly so that a large archive's ranges run apart
    n = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = ranges.repartition(n, "path", "start")

    def run(batches):
        schema = pa.schema([(n, t) for n, t in zip(NAMES, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()))])
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for offset, fields, block in records_of(Window(f, length), start, min(start + split_bytes, length)):
                        rows.append(parse(path, offset, fields, block))
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return ranges.mapInArrow(run, RECORD)
