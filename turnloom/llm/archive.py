"""Web archives: writing and reading ARC and WARC files, and converting ARC to WARC with de-duplicated payloads."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm._spark import settle, shared_path

#: Bytes of payload to a file, about: a task reads one file at a time.
FILE_BYTES = 8 << 20

# Fixed values of the formats: ARC 1 and 2 header lines, and the first record of a file that tells the version.
ARC_FIELDS = {
    "1": ["url", "ip", "date", "type", "length"],
    "2": ["url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"],
}
ARC_LEGEND = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_FILE = "filedesc://"
EPOCH = "20240101000000"
#: What an ARC line says where no address is known.
NO_ADDRESS = "0.0.0.0"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_record(url: str, ip: str, date: str, kind: str, body: bytes, version: str = "1") -> bytes:
    """One ARC record without its closing line end. Spaces in a URL would part fields, so they are escaped."""
    url = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    middle = [] if version == "1" else ["200", "-", "-", "0", "-"]
    return " ".join([url, ip, date, kind, *middle, str(len(body))]).encode() + b"\n" + body


def arc_head(name: str, version: str = "1") -> bytes:
    """The version block that an ARC file begins with."""
    body = f"{version} 0 turnloom\n{ARC_LEGEND[version]}\n".encode()
    return arc_record(f"{ARC_FILE}{name}", NO_ADDRESS, EPOCH, "text/plain", body, version)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: header fields by the version that its first record names, and a body of the declared length.

    Line ends between records are skipped. A header line that does not fit, or a length beyond the file, ends it with an error.
    """
    at, fields = 0, ARC_FIELDS["1"]
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r").split(" ")
        first = line[0].startswith(ARC_FILE)
        if first:
            fields = ARC_FIELDS["1" if len(line) == len(ARC_FIELDS["1"]) else "2"]
        if end < 0 or len(line) != len(fields) or not line[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {line[:3]}")
        record = dict(zip(fields, line, strict=True))
        length = int(record["length"])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"the record at byte {at} declares {length} bytes and has {len(body)}")
        if first:
            version = body.split(b" ", 1)[0].decode("ascii", "replace")
            fields = ARC_FIELDS.get(version, fields)
        yield record | {"body": body}
        at = end + 1 + length


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the empty line, payload); no headers if the body does not begin like a response."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    found = [(i + len(e), i) for e in (b"\r\n\r\n", b"\n\n") if (i := body.find(e)) >= 0]
    return (body[: min(found)[0]], body[min(found)[0] :]) if found else (body, b"")


def record_id(*parts: str) -> str:
    """A URN made of what identifies the record, so that a task that runs again writes the same."""
    h = hashlib.sha1("\x00".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def warc_date(arc_date: str) -> str:
    d = (arc_date + EPOCH[len(arc_date) :])[:14] if arc_date.isdigit() else EPOCH
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(record: dict) -> str:
    if record["url"].startswith(ARC_FILE):
        return "warcinfo"
    return "response" if record["body"].startswith(b"HTTP/") else "resource"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records of a WARC file, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"the record at byte {at} declares {length} bytes and has {len(block)}")
        yield headers, block
        at = end + 4 + length


def _unzipped(data: bytes) -> bytes:
    """Contents of one or more gzip members; other data as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out) if out else data


_LINE = pa.schema([("line", pa.string())])


def _arc_lines(version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = True
        for b in batches:
            out = [arc_head("pages.arc", version).decode()] if head and b.num_rows else []
            head = head and not b.num_rows
            for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                body = (html or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'-' if page is None else page}\r\nContent-Length: {len(body)}\r\n\r\n"
                out.append(arc_record(url or "-", NO_ADDRESS, EPOCH, "text/html", http.encode() + body, version).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], schema=_LINE)

    return run


def write_arc(pages: DataFrame, path: str, version: str = "1") -> None:
    """pages (page_id, url, html) as gzipped ARC files of about FILE_BYTES of payload, through Spark's text writer: a record is a line."""
    size = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 300)).first()[0] or 0
    files = max(1, -(-size // FILE_BYTES))
    spread = pages.select("page_id", "url", "html").repartition(int(files), F.xxhash64("page_id", "url"))
    spread.mapInArrow(_arc_lines(version), "line string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column("content").to_pylist():
            rows = []
            for r in parse_arc(_unzipped(data)):
                http, payload = split_http(r["body"])
                page = re.search(rb"\r\nX-Page-Id: (-?[0-9]+)\r\n", http)
                rows.append({
                    "page_id": int(page[1]) if page else None, "url": r["url"], "date": warc_date(r["date"]), "type": warc_type(r), "ip": r["ip"],
                    "http": http, "payload": payload, "payload_bytes": len(payload), "payload_digest": sha1_base32(payload), "content_type": r["type"],
                })
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema=_RECORDS)


_RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("type", pa.string()), ("ip", pa.string()), ("http", pa.binary()),
    ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("content_type", pa.string()),
])
_RECORDS_DDL = "page_id long, url string, date string, type string, ip string, http binary, payload binary, payload_bytes long, payload_digest string, content_type string"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC files (gzipped or not), a row each, with what a WARC record needs."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_arc_records, _RECORDS_DDL)


def _record_id(r: dict) -> str:
    return record_id("record", r["url"], r["date"], "-" if r["page_id"] is None else str(r["page_id"]), r["payload_digest"])


def _warc_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            headers = {"WARC-Type": r["kind"], "WARC-Record-ID": _record_id(r), "WARC-Date": r["date"]}
            if r["kind"] == "warcinfo":
                # The ARC file's own record becomes the description of the WARC file.
                body = f"software: turnloom\r\nformat: WARC File Format 1.1\r\ndescription: converted from {r['url'].removeprefix(ARC_FILE)}\r\n".encode()
                out.append(warc_record(headers | {"Content-Type": "application/warc-fields", "WARC-Block-Digest": f"sha1:{sha1_base32(body)}"}, body).decode())
                continue
            headers["WARC-Target-URI"] = r["url"]
            if r["ip"] not in ("", "-", NO_ADDRESS):
                headers["WARC-IP-Address"] = r["ip"]
            headers["WARC-Payload-Digest"] = f"sha1:{r['payload_digest']}"
            block = r["http"] or b""
            if r["kind"] == "revisit":
                first = {"page_id": r["refers_to"], "url": r["refers_url"], "date": r["refers_date"], "payload_digest": r["payload_digest"]}
                headers |= {
                    "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _record_id(first),
                    "WARC-Refers-To-Target-URI": r["refers_url"], "WARC-Refers-To-Date": r["refers_date"], "X-Refers-To-Page": str(r["refers_to"]),
                }
            else:
                block += r["payload"] or b""
            headers["WARC-Block-Digest"] = f"sha1:{sha1_base32(block)}"
            headers["Content-Type"] = "application/http; msgtype=response" if r["http"] else r["content_type"]
            out.append(warc_record(headers, block).decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], schema=_LINE)


def convert(records: DataFrame, path: str, least_bytes: int = 0) -> None:
    """ARC records as gzipped WARC files. Of records with equal payloads of at least least_bytes bytes, that with the least page_id
    is stored and the others become revisit records, which name its record, address and date. Only digests, ids and addresses are grouped and
    joined, so a payload that a third of all records have costs no more than others; records without page_id are stored.
    """
    firsts = records.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull() & (F.col("type") != "warcinfo"))
    firsts = firsts.groupBy(F.col("payload_digest").alias("digest")).agg(F.min(F.struct("page_id", "url", "date")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = settle(firsts, "archive-firsts")
    told = records.join(firsts, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= least_bytes) & (F.col("type") != "warcinfo"), "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id") != F.col("first.page_id"))
    told = told.select(
        *records.columns, *[F.when(revisit, F.col(f"first.{c}")).alias(n) for c, n in (("page_id", "refers_to"), ("url", "refers_url"), ("date", "refers_date"))],
        F.when(revisit, F.lit("revisit")).otherwise(F.col("type")).alias("kind"),
    )
    told.mapInArrow(_warc_lines, "line string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column("content").to_pylist():
            rows = []
            for headers, block in parse_warc(_unzipped(data)):
                if headers["warc-type"] == "warcinfo":
                    continue
                http, payload = split_http(block)
                page = re.search(rb"\r\nX-Page-Id: (-?[0-9]+)\r\n", http)
                size = re.search(rb"\r\nContent-Length: ([0-9]+)\r\n", http)
                kind = headers["warc-type"]
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and sha1_base32(payload) != digest:
                    raise ValueError(f"{headers['warc-record-id']}: the payload's digest is not the declared one")
                refers = headers.get("x-refers-to-page")
                rows.append({
                    "page_id": int(page[1]) if page else None, "url": headers["warc-target-uri"], "payload_bytes": len(payload) if kind != "revisit" else int(size[1]),
                    "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)


_ROWS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response, resource or revisit record of WARC files; digests of stored payloads are checked."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_warc_rows, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, version: str = "1", least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) written as ARC files, converted to WARC files, and read back from these: a row for each page.

    Nulls: a null html is empty, a null url is "-", pages without page_id are responses. Repeated rows with one page_id are each other's
    equals: all of the least page_id are responses. An empty table gives no rows; further columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc, version)
    convert(read_arc(spark, arc), warc, least_bytes)
    return read_warc(spark, warc)
