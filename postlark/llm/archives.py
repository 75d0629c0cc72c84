"""Convert legacy ARC archives to WARC.

``write_arc`` makes ARC files of both versions from a table of pages; ``convert_arc``
reads such files (of whatever origin) by their version's header lines and declared
lengths and writes the equivalent WARC files; ``read_warc`` reads WARC files.

What a WARC record gets that an ARC record lacks: an identifier made from the file's
name and the record's place, an ISO timestamp, a type (``filedesc:`` becomes warcinfo,
an HTTP message a response, anything else a resource), block and payload digests. A
payload that occurs several times is kept once: the record with the largest key stays a
response and the others become revisits of it. A revisit keeps its HTTP headers; the
extension fields ``X-Payload-Length`` and ``X-Refers-To-Key`` tell the payload's length
and whose it is.

Scale: files are rolled by size, so each is one task's work, read as a stream. To find
equal payloads only digests are shuffled, first summed per file, so a payload that a
third of all records share travels as one row per file.

Defined cases: a NULL html is an empty payload (equal to every other empty one). A NULL
url is written as ``urn:unknown``; white space in a url is percent-encoded. Among equal
keys the record written last in file order is the response; a NULL key is the smallest.
An empty table gives no rows. A truncated or malformed archive raises ``ValueError``.
"""

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.llm.common import stored
from postlark.llm.files import create, each_row, open_stream, unique_name

# The formats' field lists, names and types.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
    "Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
KEY_FIELD = "X-Page-Id"

ROLL_BYTES = 64 << 20
GZIP_LEVEL = 1
FIRST_DATE = datetime(2001, 1, 1, tzinfo=timezone.utc)

_MANIFEST = "path string, records long, bytes long"
_MANIFEST_ARROW = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_INDEX = (
    "path string, position long, key long, digest string, payload_bytes long, "
    "record_id string, url string, date string"
)
_INDEX_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("position", pa.int64()),
        ("key", pa.int64()),
        ("digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("record_id", pa.string()),
        ("url", pa.string()),
        ("date", pa.string()),
    ]
)
_RECORDS = (
    "path string, record_type string, record_id string, url string, date string, key long, "
    "payload_bytes long, payload_digest string, refers_to long, refers_to_id string"
)
_RECORDS_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("url", pa.string()),
        ("date", pa.string()),
        ("key", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("refers_to_id", pa.string()),
    ]
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Rolling:
    """Writes records as gzip members to files of about ``roll`` bytes."""

    def __init__(self, folder: str, prefix: str, suffix: str, roll: int, level: int):
        self.folder, self.prefix, self.suffix = folder, prefix, suffix
        self.roll, self.level = roll, level
        self.file = None

    def start(self) -> str:
        name = unique_name(self.prefix, self.suffix)
        self.file = create(self.folder, name)
        self.path, self.records, self.bytes = f"{self.folder}/{name}", 0, 0
        return name

    def add(self, data: bytes) -> None:
        data = _member(data, self.level)
        self.file.write(data)
        self.records += 1
        self.bytes += len(data)

    @property
    def full(self) -> bool:
        return self.bytes >= self.roll

    def finish(self) -> tuple:
        self.file.close()
        self.file = None
        return self.path, self.records, self.bytes


# --- ARC ------------------------------------------------------------------------------


def _safe_url(url: str | None) -> str:
    if not url:
        return "urn:unknown"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def arc_record(version: int, url: str, date: str, mime: str, body: bytes, name: str, offset: int) -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    head = f"{url} 0.0.0.0 {date} {mime}{more} {len(body)}\n"
    return head.encode() + body + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 postlark\n{ARC_FIELDS[version]}\n".encode()
    return arc_record(version, f"filedesc://{name}", date, "text/plain", body, name, 0)


def http_message(key: int | None, payload: bytes) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8"]
    lines.append(f"Content-Length: {len(payload)}")
    if key is not None:
        lines.append(f"{KEY_FIELD}: {key}")
    return "\r\n".join([*lines, "", ""]).encode() + payload


def write_arc(pages: DataFrame, folder: str, versions=(1, 2), roll: int = ROLL_BYTES) -> DataFrame:
    """Write ``page_id, url, html`` as ARC files, tasks taking turns at the versions.

    Returns the manifest ``path, records, bytes``.
    """

    def run(rows):
        part = TaskContext.get().partitionId()
        version = versions[part % len(versions)]
        out = _Rolling(folder, f"arc-{part:06d}", ".arc.gz", roll, GZIP_LEVEL)
        name = ""
        for key, url, html in rows:
            date = (FIRST_DATE + timedelta(seconds=(key or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
            if out.file is None:
                name = out.start()
                out.add(arc_head(version, name, date))
            body = http_message(key, (html or "").encode("utf-8", "surrogatepass"))
            out.add(arc_record(version, _safe_url(url), date, "text/html", body, name, out.bytes))
            if out.full:
                yield out.finish()
        if out.file is not None:
            yield out.finish()

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return stored(rows.mapInArrow(each_row(run, _MANIFEST_ARROW), _MANIFEST), "arc-manifest")


def _plain(stream) -> io.BufferedReader:
    """The stream, unpacked if it holds gzip members."""
    reader = io.BufferedReader(stream, 1 << 20)
    if reader.peek(2)[:2] == b"\x1f\x8b":
        return io.BufferedReader(gzip.GzipFile(fileobj=reader), 1 << 20)
    return reader


def _exactly(stream, length: int, what: str) -> bytes:
    data = stream.read(length)
    if len(data) != length:
        raise ValueError(f"{what} ends after {len(data)} of {length} bytes")
    return data


def arc_records(stream) -> Iterator[tuple[int, str, str, str, str, bytes]]:
    """``position, url, ip, date, type, body`` of each record of an ARC stream.

    The version block of the first record says how many fields a header line has. They
    are counted from the right, because old crawlers left blanks in URLs.
    """
    position, fields = 0, 0
    for line in iter(stream.readline, b""):
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        known = fields or 5
        if len(parts) < known or not parts[-1].isdigit():
            raise ValueError(f"record {position} has no ARC header line: {line[:80]!r}")
        if not fields and len(parts) >= 10 and parts[4].isdigit():
            known = 10  # the first line of a version 2 file
        url = " ".join(parts[: len(parts) - known + 1])
        ip, date, mime = parts[len(parts) - known + 1 :][:3]
        body = _exactly(stream, int(parts[-1]), f"ARC record {position}")
        if not fields:
            version = body.split(b" ", 1)[0]
            if not url.startswith("filedesc:") or version not in (b"1", b"2"):
                raise ValueError("the first ARC record has no version block")
            fields = len(ARC_FIELDS[int(version)].split(" "))
        yield position, url, ip, date, mime, body
        position += 1


# --- ARC -> WARC ----------------------------------------------------------------------


def warc_date(arc_date: str) -> str:
    """14 digits, or the 8 to 12 of older files, as an ISO timestamp."""
    digits = "".join(c for c in arc_date if c.isdigit())[:14]
    digits += "19700101000000"[len(digits) :]
    year, rest = digits[:4], [digits[i : i + 2] for i in range(4, 14, 2)]
    return f"{year}-{rest[0]}-{rest[1]}T{rest[2]}:{rest[3]}:{rest[4]}Z"


def warc_id(path: str, position: int) -> str:
    name = path.rsplit("/", 1)[-1]
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{position}')}>"


_BLANK_LINE = re.compile(rb"\r?\n\r?\n")


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Head and payload, cut after the first blank line; old servers end lines with LF alone."""
    blank = _BLANK_LINE.search(body)
    return (body[: blank.end()], body[blank.end() :]) if blank else (body, b"")


def http_key(head: bytes) -> int | None:
    found = re.search(rb"(?im)^" + KEY_FIELD.encode() + rb":[ \t]*(-?\d+)[ \t]*\r?$", head)
    return int(found.group(1)) if found else None


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{name}: {value}" for name, value in fields)]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def _converted(path, record, winner) -> bytes:
    """The WARC record for an ARC record; ``winner`` is the one it repeats, if any."""
    position, url, ip, date, mime, body = record
    fields = [("WARC-Record-ID", warc_id(path, position)), ("WARC-Date", warc_date(date))]
    if url.startswith("filedesc:"):
        about = f"software: postlark\r\nformat: WARC File Format 1.0\r\nconverted-from: {url}\r\n"
        kind = [("WARC-Type", "warcinfo"), ("Content-Type", "application/warc-fields")]
        return warc_record(kind + fields, about.encode())
    fields.append(("WARC-Target-URI", url))
    if ip != "0.0.0.0":
        fields.append(("WARC-IP-Address", ip))
    if not body.startswith(b"HTTP/"):
        kind = [("WARC-Type", "resource"), ("Content-Type", mime)]
        fields.append(("WARC-Block-Digest", f"sha1:{sha1_base32(body)}"))
        return warc_record(kind + fields, body)
    head, payload = split_http(body)
    fields.append(("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"))
    message = ("Content-Type", "application/http; msgtype=response")
    if winner is None:
        kind = [("WARC-Type", "response"), message]
        fields.append(("WARC-Block-Digest", f"sha1:{sha1_base32(body)}"))
        return warc_record(kind + fields, body)
    kind = [("WARC-Type", "revisit"), message, ("WARC-Profile", REVISIT_PROFILE)]
    fields += [
        ("WARC-Refers-To", winner["record_id"]),
        ("WARC-Refers-To-Target-URI", winner["url"]),
        ("WARC-Refers-To-Date", winner["date"]),
        ("WARC-Truncated", "length"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if winner["key"] is not None:
        fields.append(("X-Refers-To-Key", str(winner["key"])))
    return warc_record(kind + fields, head)


def index_arc(manifest: DataFrame) -> DataFrame:
    """Place, key and payload digest of every HTTP record of the ARC files."""

    def run(rows):
        for (path,) in rows:
            with open_stream(path) as file:
                for position, url, _, date, _, body in arc_records(_plain(file)):
                    if body.startswith(b"HTTP/"):
                        head, payload = split_http(body)
                        yield (
                            path, position, http_key(head), sha1_base32(payload), len(payload),
                            warc_id(path, position), url, warc_date(date),
                        )

    return manifest.select("path").mapInArrow(each_row(run, _INDEX_ARROW), _INDEX)


def _repeats(index: DataFrame, least: int) -> DataFrame:
    """Per file, the payloads that occur more than once, and which record keeps each."""
    last = F.max(F.struct("key", "path", "position", "record_id", "url", "date"))
    per_file = (
        index.where(F.col("payload_bytes") >= least)
        .groupBy("path", "digest")
        .agg(last.alias("last"), F.count("*").alias("n"))
    )
    winners = (
        per_file.groupBy("digest")
        .agg(F.max("last").alias("winner"), F.sum("n").alias("total"))
        .where(F.col("total") > 1)
    )
    found = per_file.select("path", "digest").join(winners, "digest")
    return found.groupBy("path").agg(F.collect_list(F.struct("digest", "winner")).alias("repeats"))


def convert_arc(
    manifest: DataFrame, folder: str, min_revisit_bytes: int = 0, roll: int = ROLL_BYTES
) -> DataFrame:
    """Write the WARC files equivalent to the ARC files of a manifest; returns theirs."""
    # Fewer records fit a file than its rolled size has bytes, so a file's list is bounded.
    work = manifest.select("path").join(
        _repeats(stored(index_arc(_one_each(manifest)), "arc-index"), min_revisit_bytes), "path", "left"
    )

    def run(rows):
        part = TaskContext.get().partitionId()
        out = _Rolling(folder, f"warc-{part:06d}", ".warc.gz", roll, GZIP_LEVEL)
        for path, repeats in rows:
            winners = {r["digest"]: r["winner"] for r in repeats or ()}
            with open_stream(path) as file:
                for record in arc_records(_plain(file)):
                    if out.file is None:
                        out.start()
                    winner = None
                    if winners and record[5].startswith(b"HTTP/"):
                        winner = winners.get(sha1_base32(split_http(record[5])[1]))
                        if winner and (winner["path"], winner["position"]) == (path, record[0]):
                            winner = None
                    out.add(_converted(path, record, winner))
                    if out.full:
                        yield out.finish()
        if out.file is not None:
            yield out.finish()

    files = _one_each(work).mapInArrow(each_row(run, _MANIFEST_ARROW), _MANIFEST)
    return stored(files, "warc-manifest")


def _one_each(manifest: DataFrame) -> DataFrame:
    """Deal the files out: a manifest is small, but every row of it is much work."""
    spark = manifest.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.repartition(tasks, F.xxhash64("path"))


# --- WARC -----------------------------------------------------------------------------


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC stream."""
    for line in iter(stream.readline, b""):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields: dict[str, str] = {}
        for line in iter(stream.readline, b""):
            line = line.rstrip(b"\r\n")
            if not line:
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = _exactly(stream, int(fields["content-length"]), "WARC record")
        yield fields, block


def read_warc(manifest: DataFrame) -> DataFrame:
    """A row per response, revisit or resource; payload digests are checked."""

    def run(rows):
        for (path,) in rows:
            with open_stream(path) as file:
                for fields, block in warc_records(_plain(file)):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = (b"", block) if kind == "resource" else split_http(block)
                    length, refers = len(payload), fields.get("x-refers-to-key")
                    digest = sha1_base32(payload)
                    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "revisit":
                        length, digest = int(fields["x-payload-length"]), told
                    elif told and told != digest:
                        raise ValueError(f"wrong payload digest in {path}: {told}")
                    yield (
                        path, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"),
                        fields.get("warc-date"), http_key(head), length, digest,
                        None if refers is None else int(refers), fields.get("warc-refers-to"),
                    )

    rows = _one_each(manifest.select("path"))
    return rows.mapInArrow(each_row(run, _RECORDS_ARROW), _RECORDS)
