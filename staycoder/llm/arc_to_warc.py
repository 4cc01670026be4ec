"""Legacy ARC archives converted to WARC, and both formats written and read as Spark tables.

ARC: every file opens with a `filedesc:` record whose body names the version and the fields of the
header lines that follow (version 1: five fields, version 2: ten). A record is its header line, as many
bytes as the last field declares, and a line feed. The converter parses the lines by the fields of
their version, takes bodies by their declared lengths, and synthesises what WARC asks for: a record
id from file and offset, an ISO timestamp from the 14 digits, the record type, SHA-1 digests in base 32.

Of records with equal payloads of at least `min_bytes` bytes the one with the smallest page id becomes a
`response`, the others become a `revisit` of it (ties: smaller record id). A null page id counts as
the largest and is left out of the headers. Null html is an empty payload, a null url is
`about:blank`; blanks and control characters of a url are percent-encoded. Other columns are ignored.

Files are gzipped and written by Spark's text writer, so they reach any store Spark can write to and a
lost task leaves nothing behind; they are read back whole, one file per row, and unpacked as a stream.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staycoder.sources.shared import write_once

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_DATE = 1262304000  # pages without a date: this Unix time plus the page id, in seconds
BODIES_AT_ONCE = 8 << 20


def _clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f\u0085\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")


def _arc_records(version: int):
    def run(batches):
        import datetime

        import pyarrow as pa
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId()}.arc"
        fields = f"{version} 0 staycoder\n{ARC_FIELDS[version]}\n"
        extra = " 200 - - 0 " + name if version == 2 else ""
        first = f"filedesc://{name} 0.0.0.0 20100101000000 text/plain{extra} {len(fields)}\n{fields}"
        yield pa.RecordBatch.from_arrays([pa.array([first])], names=["value"])
        epoch = datetime.datetime(1970, 1, 1)
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                seconds = FIRST_DATE + (page_id or 0) % 1_000_000_000
                date = (epoch + datetime.timedelta(seconds=seconds)).strftime("%Y%m%d%H%M%S")
                body = html or ""
                n = len(body.encode())
                own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {n}\r\n\r\n"
                line = f"{_clean_url(url)} 0.0.0.0 {date} text/html{extra} {len(head) + n}"
                out.append(f"{line}\n{head}{body}")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return run


def write_arc(pages: DataFrame, path: str, version: int = 1, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write pages as one ARC file per partition."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    lines = rows.mapInArrow(_arc_records(version), "value string")
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(path)


class _Stream:
    """Lines and stretches of declared length from a gzipped or plain file held as bytes."""

    def __init__(self, name: str, raw):
        self.name, self.raw, self.at = name, memoryview(raw), 0
        self.buffer, self.used = b"", 0  # unpacked bytes, and how many of them are taken
        self.place = 0
        self.unpack = zlib.decompressobj(47) if bytes(self.raw[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        data = bytes(self.raw[self.at : self.at + (1 << 18)])
        self.at += len(data)
        parts = [self.buffer[self.used :]]
        self.used = 0
        if self.unpack is None:
            parts.append(data)
            data = b""
        while data:
            parts.append(self.unpack.decompress(data))
            data = self.unpack.unused_data
            if data:
                self.unpack = zlib.decompressobj(47)
        self.buffer = b"".join(parts)
        return True

    def line(self) -> bytes | None:
        """The next line without its line feed; None at the end."""
        while (end := self.buffer.find(b"\n", self.used)) < 0:
            if not self._more():
                rest = len(self.buffer) - self.used
                return self.take(rest) if rest else None
        return self.take(end + 1 - self.used)[:-1]

    def take(self, n: int) -> bytes:
        parts, have = [], len(self.buffer) - self.used
        while have < n:  # a long body is gathered in pieces
            parts.append(self.buffer[self.used :])
            n, self.place = n - have, self.place + have
            self.buffer, self.used = b"", 0
            if not self._more():
                raise ValueError(f"{self.name}: {n} bytes more are declared at {self.place}")
            have = len(self.buffer)
        parts.append(self.buffer[self.used : self.used + n])
        self.used += n
        self.place += n
        return parts[0] if len(parts) == 1 else b"".join(parts)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with their empty line, payload); a block that is not HTTP is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def arc_records(name: str, raw):
    """Records of one ARC file as dictionaries; the fields of the header line by their names."""
    stream, fields = _Stream(name, raw), None
    while True:
        offset = stream.place
        line = stream.line()
        if line is None:
            return
        if not line.strip():
            continue
        if line.startswith(b"filedesc:"):
            try:
                body = stream.take(int(line.rsplit(b" ", 1)[1])).decode("latin-1").splitlines()
                fields = body[1].split()
            except (IndexError, ValueError) as error:
                raise ValueError(f"{name}: broken version block at {offset}") from error
            continue
        values = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1) if fields else []
        if not fields or len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"{name}: no header line of the file's version at {offset}")
        record = dict(zip(fields, values, strict=True))
        yield record | {"offset": offset, "block": stream.take(int(values[-1]))}


def _parse_arc(batches):
    import pyarrow as pa

    names = ["record_id", "page_id", "uri", "ip", "date", "http", "payload", "payload_digest", "payload_bytes"]
    kinds = [pa.string(), pa.int64()] + [pa.string()] * 3 + [pa.binary(), pa.binary(), pa.string(), pa.int64()]

    def table(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            name = path.as_py().rsplit("/", 1)[-1]
            rows, size = [], 0
            for record in arc_records(name, content.as_buffer()):
                http, payload = _split_http(record["block"])
                own = _header(http, "X-Page-Id")
                d = record["Archive-date"]
                date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{record["offset"]}')}>"
                rows.append(
                    (record_id, int(own) if own else None, record["URL"], record["IP-address"], date, http, payload, digest(payload), len(payload))
                )
                size += len(payload)
                if size > BODIES_AT_ONCE:
                    yield table(rows)
                    rows, size = [], 0
            yield table(rows)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the ARC files in `path` (version blocks are not records)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(
        _parse_arc,
        "record_id string, page_id long, uri string, ip string, date string, http binary, payload binary, payload_digest string, payload_bytes long",
    )


def _warc_records(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            revisit = row["refers_to"] is not None
            block = row["http"] + (b"" if revisit else row["payload"])
            head = [
                "WARC/1.1",
                f"WARC-Type: {'revisit' if revisit else 'response'}",
                f"WARC-Record-ID: {row['record_id']}",
                f"WARC-Date: {row['date']}",
                f"WARC-Target-URI: {row['uri']}",
                f"WARC-IP-Address: {row['ip']}",
                f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
                f"WARC-Block-Digest: sha1:{digest(block)}",
            ]
            if revisit:
                head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {row['refers_to']}"]
            kind = "application/http;msgtype=response" if row["http"] else "text/html"
            head += [f"X-Payload-Length: {row['payload_bytes']}", f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
            # the writer ends the value with the last line feed of the record
            out.append("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def convert(records: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the records of `read_arc` as WARC files."""
    order = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("page"), F.col("record_id").alias("id"))
    large = F.col("payload_bytes") >= min_bytes
    first = records.where(large).groupBy("payload_digest").agg(F.min(order)["id"].alias("first_id"))
    joined = records.join(first, "payload_digest", "left")
    revisit = large & (F.col("first_id") != F.col("record_id"))
    rows = joined.withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id", "page_id")
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    lines = rows.mapInArrow(_warc_records, "value binary")
    lines = lines.select(F.col("value").cast("string").alias("value"))  # bytes as they are
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def warc_records(name: str, raw):
    """Records of one WARC file: (header lines, block)."""
    stream = _Stream(name, raw)
    while True:
        line = stream.line()
        if line is None:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record at {stream.place}")
        head = [line]
        while (line := stream.line()) not in (b"\r", b"", None):
            head.append(line)
        head = b"\n".join(head)
        yield head, stream.take(int(_header(head, "Content-Length")))


def _parse_warc(batches):
    import pyarrow as pa

    names = ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_id", "uri", "payload"]
    kinds = [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 4 + [pa.binary()]

    def table(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            name = path.as_py().rsplit("/", 1)[-1]
            rows, size = [], 0
            for head, block in warc_records(name, content.as_buffer()):
                http, payload = _split_http(block)
                kind, own = _header(head, "WARC-Type"), _header(http, "X-Page-Id")
                stated = _header(head, "WARC-Payload-Digest").removeprefix("sha1:")
                if digest(block) != _header(head, "WARC-Block-Digest").removeprefix("sha1:"):
                    raise ValueError(f"{name}: damaged block of {_header(head, 'WARC-Record-ID')}")
                if kind == "response" and digest(payload) != stated:
                    raise ValueError(f"{name}: damaged payload of {_header(head, 'WARC-Record-ID')}")
                rows.append(
                    (
                        _header(head, "WARC-Record-ID"),
                        int(own) if own else None,
                        len(payload) if kind == "response" else int(_header(head, "X-Payload-Length")),
                        stated,
                        kind,
                        _header(head, "WARC-Refers-To"),
                        _header(head, "WARC-Target-URI"),
                        payload if kind == "response" else None,
                    )
                )
                size += len(payload)
                if size > BODIES_AT_ONCE:
                    yield table(rows)
                    rows, size = [], 0
            yield table(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; refers_to is the page id of the response that a revisit names."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(
        _parse_warc,
        "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_id string, uri string, payload binary",
    )


def warc_index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record."""
    records = write_once(read_warc(spark, path).drop("payload", "uri"), "warc-index")  # the files are read once
    responses = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")
    )
    return records.join(responses, "refers_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
