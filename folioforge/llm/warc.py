"""ARC to WARC conversion, and archives written and read back.

An ARC file starts with a version block that says how the header line of every record is laid out:

  version 1   URL IP-address Archive-date Content-type Archive-length
  version 2   URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

Each record is its header line, as many bytes as the line declares, and a line feed. The converter
reads the header by its version, takes the declared bytes, and makes the WARC record that says the
same: a UUID from address, date and content, the date in ISO form, a type, and SHA-1 digests.

ARC files are read, and archives written and read, by Spark's own readers and writers, so they can live in any store
Spark knows and a lost task leaves nothing half written. Files are cut by their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.plans.storage import cut, new_path

FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"),
}
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Bytes of records in one archive file, about: files stay small enough to be read whole by one task. A longer record has a file of its own.
FILE_BYTES = 32 << 20
_CAPTURED = "20240101000000"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAK = b"\r\n"


def arc_version_block(version: int, name: str = "archive", date: str = _CAPTURED) -> bytes:
    """The first record of an ARC file."""
    titles = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 folioforge\n{titles[version]}\n".encode()
    rest = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {rest}{len(body)}\n".encode() + body + b"\n"


def _address(url: str) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url)


def iso_date(date: str) -> str:
    date = date.ljust(14, "0")[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def arc_record(version: int, url: str, content: bytes, date: str = _CAPTURED, ip: str = "0.0.0.0", content_type: str = "text/html", status: int = 200, offset: int = 0, name: str = "archive") -> bytes:
    """An ARC record; white space of the address is escaped, for the header line is split at spaces."""
    address = _address(url)
    rest = "" if version == 1 else f"{status} {zlib.crc32(content):08x} - {offset} {name} "
    return f"{address} {ip} {date} {content_type} {rest}{len(content)}\n".encode() + content + b"\n"


def parse_arc(data: bytes, version: int | None = None) -> Iterator[dict]:
    """The records of an ARC file, or of a part of one whose ``version`` is known. Raises ValueError
    where a header line does not fit its version or declares more bytes than there are."""
    at = 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        parts = data[at:end].decode("utf-8", "replace").split(" ")
        described = parts[0].startswith("filedesc:")
        if described:
            version = 2 if len(parts) == len(FIELDS[2]) else 1
        if version not in FIELDS or len(parts) != len(FIELDS[version]) or not parts[-1].isdigit():
            raise ValueError(f"not a header line of version {version} at byte {at}")
        record = dict(zip(FIELDS[version], parts)) | {"length": int(parts[-1]), "version": version}
        body = data[end + 1 : end + 1 + record["length"]]
        if len(body) < record["length"]:
            raise ValueError(f"the record at byte {at} declares {record['length']} bytes; {len(body)} are left")
        at = end + 1 + record["length"]
        if described:
            version = int(body.split(b" ", 1)[0])
            continue
        yield record | {"content": body}


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Headers with the blank line that ends them, and payload. Content without headers is payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    head, gap, payload = content.partition(b"\r\n\r\n")
    return (head + gap, payload) if gap else (content, b"")


def warc_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(record: dict, refers_to: tuple[str, str] | None = None, extra: dict[str, str] | None = None) -> bytes:
    """The WARC record of a parsed ARC record; a revisit where ``refers_to`` has the identifier and
    date of the record that holds the payload. Without its end (two line breaks)."""
    head, payload = split_http(record["content"])
    block = head if refers_to else record["content"]
    fields = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": record_id(record),
        "WARC-Date": iso_date(record["date"]),
        "WARC-Target-URI": record["url"],
        "WARC-IP-Address": record["ip"],
        "WARC-Payload-Digest": warc_digest(payload),
        "WARC-Block-Digest": warc_digest(block),
        "Content-Type": "application/http; msgtype=response" if head else record["content_type"],
    }
    if refers_to:
        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": refers_to[0], "WARC-Refers-To-Date": refers_to[1]}
    fields |= (extra or {}) | {"Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + _BREAK + block


def record_id(record: dict) -> str:
    """The same ARC record has the same identifier at every conversion."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((record['url'], record['date'], hashlib.sha1(record['content']).hexdigest())))}>"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (in lower case) and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == _BREAK:
            at += 2
            continue
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} declares {size} bytes; {len(block)} are left")
        yield fields, block
        at = end + 4 + size


def _http(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def _records(found: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows (record, part): the number of the file that a record goes to among those of its task."""
    out, size, part, held = [], 0, 0, 0
    rows = lambda: pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.binary()), pa.array([p for _, p in out], pa.int32())], ["record", "part"])
    for record in found:
        if size and size + len(record) > FILE_BYTES:
            size, part = 0, part + 1
        size += len(record)
        held += len(record)
        out.append((record, part))
        if held > FILE_BYTES // 4:
            yield rows()
            out, held = [], 0
    if out:
        yield rows()


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns id, url, html, keeper, keeper's url: through an ARC record of either version to a WARC record."""
    return _records(record for batch in batches for record in _pages(batch))


def _pages(batch: pa.RecordBatch) -> Iterator[bytes]:
    for key, url, html, keeper, top_url in zip(*(batch.column(i) for i in range(5))):
        key, url, keeper = key.as_py(), url.as_py(), keeper.as_py()
        payload = html.as_buffer().to_pybytes() if html.is_valid else b""
        version = 1 + zlib.crc32(str(key).encode()) % 2
        content = _http(payload)
        record = next(parse_arc(arc_record(version, url or f"urn:page:{key}", content), version))
        extra = {} if key is None else {"X-Source-Key": str(key)}
        refers = None
        if keeper is not None:
            extra["X-Refers-To-Key"] = str(keeper)
            kept = record | {"url": _address(top_url.as_py() or f"urn:page:{keeper}")}
            refers = (record_id(kept), iso_date(kept["date"]))
        yield warc_record(record, refers, extra)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    """A WARC record for each row of ``pages``, in compressed archive files below ``path``.

    Of rows with equal payloads of ``revisit_bytes`` or more, those with the largest id are
    responses and all others revisits. A null payload is empty, and a null address becomes
    ``urn:page:<id>``. Rows that repeat an id are written as often as they occur; a row with a null
    id is a response unless another row with its payload has an id. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    rows = rows.withColumn("size", F.coalesce(F.octet_length("html"), F.lit(0)))
    rows = rows.withColumn("digest", F.when(F.col("size") >= revisit_bytes, F.sha2(F.col("html"), 256)))
    keepers = rows.where("digest is not null").groupBy("digest").agg(F.max("id").alias("top"), F.max_by("url", "id").alias("top_url"), F.count(F.lit(1)).alias("n")).where("n > 1 and top is not null").drop("n")
    keepers = cut(keepers, "warc-keepers")
    # payloads held by a third of all rows are split by adaptive skew handling: nothing above this join asks for its keys;
    # rows that are too small for a digest do not go through it
    again = rows.where("digest is not null").join(keepers, "digest", "left")
    again = again.select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("top")), F.col("top")).alias("keeper"), "top_url")
    small = rows.where("digest is null").select("id", "url", "html", F.lit(None).cast("long").alias("keeper"), F.lit(None).cast("string").alias("top_url"))
    _write(again.unionByName(small).mapInArrow(_convert, "record binary, part int"), path)


def _write(records: DataFrame, path: str) -> None:
    # the writer puts the bytes of a record and then the line breaks that end it
    rows = records.select("part", F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").partitionBy("part").text(path)


def _open_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column content, of whole ARC files, compressed or not: a row for each record."""
    schema = pa.schema([("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("status", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
    for batch in batches:
        for content in batch.column(0):
            data, rows, size = content.as_buffer().to_pybytes(), [], 0
            for record in parse_arc(_plain(data) if data[:2] == b"\x1f\x8b" else data):
                rows.append(record)
                size += record["length"]
                if size > FILE_BYTES // 4:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def _plain(data: bytes) -> bytes:
    """What one or more gzip members hold."""
    out = []
    while data:
        one = zlib.decompressobj(47)
        out += [one.decompress(data), one.flush()]
        data = one.unused_data
    return b"".join(out)


_ARC_ROW = "version int, url string, ip string, date string, content_type string, status string, length long, content binary"


def read_arc(spark, path: str, pattern: str = "*.arc*") -> DataFrame:
    """Rows of the ARC files below ``path``, compressed (as a whole or by record) or not: version, url, ip, date, content_type, status (null in
    version 1), length and content. A header line that does not fit its version, or declares more than there is, stops the read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_open_arc, _ARC_ROW)


def convert_archives(spark, source: str, path: str, pattern: str = "*.arc*") -> None:
    """WARC files below ``path`` with a response for each record of the ARC files below ``source``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _records(warc_record(record) for batch in batches for record in batch.to_pylist())

    _write(read_arc(spark, source, pattern).mapInArrow(run, "record binary, part int"), path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for content in batch.column(0):
            rows = []
            size = 0
            for fields, block in parse_warc(_plain(content.as_buffer().to_pybytes())):
                head, payload = split_http(block)
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                revisit = fields["warc-type"] == "revisit"
                declared = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
                length = int(declared[1]) if revisit and declared else len(payload)
                if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                key, to = fields.get("x-source-key"), fields.get("x-refers-to-key")
                rows.append((key and int(key), length, digest, fields["warc-type"], to and int(to), fields["warc-target-uri"], fields["warc-record-id"], None if revisit else payload))
                size += len(block)
                if size > FILE_BYTES // 4 or len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_archives(spark, path: str) -> DataFrame:
    """Rows of the archives below ``path``: id, payload_bytes, payload_digest, record_type, refers_to,
    url, record_id, payload (null for a revisit). A digest that does not hold stops the read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, **options)
    return read_archives(pages.sparkSession, path).withColumnRenamed("id", id_col)
