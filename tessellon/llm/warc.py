"""WARC archives as a PySpark Python data source.

Writing: each task writes one archive of single-record gzip members under a name of its own; the driver's commit adds
a manifest of its own that names the archives of successful tasks, so files of failed or repeated attempts are never read
and appends at the same time don't touch each other's. Members carry their compressed length in the gzip header (the
skip-length field "sl" of the WARC standard), and a manifest has an offset every SPLIT_BYTES.

Reading: partitions are planned from the manifests (without any: one per file that ends in .warc or .warc.gz); record-type and
header predicates are pushed down; a reader inflates a member only up to the end of its headers, tests the predicates, and
jumps to the next member without inflating a payload that nobody wants. Without ``payload`` in the schema and without the
``verify`` option no payload is decoded at all. Archives by others are read too: gzip members without that field, files
compressed as a whole and plain ones, where payloads that nobody wants are inflated or passed over but not kept; warcinfo,
request and other records come as rows of that record_type.

Defined results: a null payload counts as empty; payloads under MIN_REVISIT bytes are always responses; a null
page_id is written without a page number and reads back as null (it never is what others refer to); repeated rows
are written as often as they stand there; an empty table makes an archive set without records; line breaks in a URL
are percent-encoded; extra columns are ignored. page_id and refers_to are null where an archive's ids are no page numbers,
payload_bytes where it doesn't say; digests that aren't SHA-256 keep their algorithm's name and aren't verified. The payload of
an HTTP response is what follows its head, of another record its whole block. A record without an end of its headers, with
a wrong length, or cut off raises a ValueError with file and offset; with the option malformed=skip the rest of its
partition is left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from tessellon.llm.common import fresh_dir, materialise

MIN_REVISIT = 100
SPLIT_BYTES = 16 << 20
MANIFEST = "_manifest"
#: Bytes that a reader inflates or reads at once, and that headers can have where no member's length bounds them (archives by others).
CHUNK, MOST_HEADERS = 1 << 16, 1 << 20
READ_SCHEMA = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
HEADERS = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(path: str):
    """File system and path below it; local paths, file:// and whatever else pyarrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}")


def member(data: bytes) -> bytes:
    """One gzip member with its own compressed and plain length in the header."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8)
    total = len(head) + 8 + len(body) + 8
    return head + struct.pack("<II", total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """A WARC record: the headers, then an HTTP response head and, unless it is a revisit, the payload."""
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class _Written(WriterCommitMessage):
    def __init__(self, name: str, size: int, marks: list[int]):
        self.name, self.size, self.marks = name, size, marks


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        name, at, marks = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        out = None
        for batch in iterator:
            cols = {n.lower(): batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                page_id, url, payload, digest, size, refers = (cols[c][i].as_py() for c in ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to"))
                data = member(record(page_id, url, payload or b"", digest, size, refers))
                out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                if at - marks[-1] >= SPLIT_BYTES:
                    marks.append(at)
                out.write(data)
                at += len(data)
        if out:
            out.close()
        return _Written(name, at, marks)

    def commit(self, messages):
        """A manifest under a new name, moved into place when it is whole."""
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        name = f"{MANIFEST}-{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{base}/.{name}", compression=None) as f:
            f.write(json.dumps([[m.name, m.size, m.marks] for m in messages if m and m.size]).encode())
        store.move(f"{base}/.{name}", f"{base}/{name}")

    def abort(self, messages):
        store, base = _store(self.path)
        for m in messages:
            if m and m.size:
                try:
                    store.delete_file(f"{base}/{m.name}")
                except FileNotFoundError:
                    pass


class Span(InputPartition):
    """Bytes of one archive that begin and end with members."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


_TESTS = {
    EqualTo: lambda v, w: v == w,
    EqualNullSafe: lambda v, w: v == w,
    GreaterThan: lambda v, w: v is not None and v > w,
    GreaterThanOrEqual: lambda v, w: v is not None and v >= w,
    LessThan: lambda v, w: v is not None and v < w,
    LessThanOrEqual: lambda v, w: v is not None and v <= w,
    In: lambda v, w: v in w,
    StringStartsWith: lambda v, w: v is not None and v.startswith(w),
    StringEndsWith: lambda v, w: v is not None and v.endswith(w),
    StringContains: lambda v, w: v is not None and w in v,
    IsNotNull: lambda v, w: v is not None,
}


def parse_headers(raw: bytes) -> dict:
    """The header fields of a record as columns, and how long its block is and whether that is an HTTP response."""
    fields = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    page = lambda v: int(m[1]) if v and (m := re.fullmatch(r"<urn:page:(-?\d+)>", v)) else None
    size, length = fields.get("x-payload-length", ""), fields.get("content-length", "")
    if not raw.startswith(b"WARC/") or not length.isdecimal():
        raise ValueError("no WARC record")
    return {
        "page_id": page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"),
        "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
        "payload_bytes": int(size) if size.isdecimal() else None,
        "refers_to": page(fields.get("warc-refers-to")),
        "_length": int(length),
        "_http": fields.get("content-type", "").startswith("application/http"),
    }


def skip_length(head: bytes) -> int | None:
    """The compressed length of a gzip member, from the "sl" field of its header, or None."""
    if head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"sl" and n == 8:
            return int.from_bytes(head[at + 4 : at + 8], "little")
        at += 4 + n
    return None


class _Bytes:
    """Plain bytes of a span: of its gzip members one after another, or the file's own."""

    def __init__(self, f, end: int):
        self.f, self.end, self.held, self.z = f, end, b"", None
        self.gzip = f.read(2) == b"\x1f\x8b"
        f.seek(f.tell() - 2)

    def _more(self) -> bool:
        raw = self.f.read(min(CHUNK, self.end - self.f.tell()))
        if not self.gzip:
            self.held += raw
            return bool(raw)
        while raw:
            if self.z is None or self.z.eof:
                self.z = zlib.decompressobj(31)
            self.held += self.z.decompress(raw)
            raw = self.z.unused_data if self.z.eof else b""
            if raw and not raw.strip(b"\0"):  # padding
                raw = b""
        return self.f.tell() < self.end or bool(self.held)

    def upto(self, mark: bytes) -> bytes | None:
        """Bytes before the mark, which is passed over; None at the end."""
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > MOST_HEADERS:
                raise ValueError("headers without an end")
            before = len(self.held)
            if not self._more() or (len(self.held) == before and self.f.tell() >= self.end):
                if self.held.strip(b"\r\n"):
                    raise ValueError("headers without an end")
                if self.z is not None and not self.z.eof:
                    raise ValueError("cut off")
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        """The next n bytes, or nothing if they aren't kept."""
        parts, left = [], n
        while left:
            if not self.held:
                at = self.f.tell()
                if not self.gzip and not keep:
                    if at + left > self.end:
                        raise ValueError("cut off")
                    self.f.seek(at + left)
                    return b""
                if not self._more() or (not self.held and self.f.tell() >= self.end):
                    raise ValueError("cut off")
            now, self.held = self.held[:left], self.held[left:]
            left -= len(now)
            if keep:
                parts.append(now)
        return b"".join(parts)


def _payload(row: dict, block: bytes) -> bytes:
    if not row["_http"]:
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    return body


class WarcReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], verify: bool, skip: bool = False):
        self.path, self.names, self.verify, self.skip, self.tests = path, names, verify, skip, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] != "payload":
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, base = _store(self.path)
        files = [x for x in store.get_file_info(fs.FileSelector(base)) if x.is_file]
        named = [x.path for x in files if x.base_name.startswith(MANIFEST + "-")]
        parts = []
        for path in named:
            with store.open_input_stream(path, compression=None) as f:
                parts += json.loads(f.read())
        if not named:
            parts = [[x.base_name, x.size, [0]] for x in files if x.base_name.endswith((".warc", ".warc.gz"))]
        spans = [Span(f"{base}/{name}", lo, hi) for name, size, marks in parts for lo, hi in zip(marks, [*marks[1:], size])]
        return spans or [Span("", 0, 0)]

    def _wanted(self, row: dict) -> bool:
        return all(_TESTS[t](row[c], v) for c, t, v in self.tests)

    def _records(self, f, span, want: bool):
        """Row and block (empty unless wanted) of each record of a span that passes the tests."""
        f.seek(span.start)
        while f.tell() < span.end:
            at = f.tell()
            length = skip_length(f.read(64))
            f.seek(at)
            if not length:
                break
            if at + length > span.end:
                raise ValueError("cut off")
            head = f.read(12)
            f.seek(at + 12 + int.from_bytes(head[10:12], "little"))
            z = zlib.decompressobj(-15)
            text, raw, seen = bytearray(), f.read(min(1024, at + length - f.tell())), 0
            # the member's own length bounds its headers, however long a URL is
            while (end := text.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                if z.eof or not raw:
                    raise ValueError("headers without an end")
                seen = len(text)
                text += z.decompress(raw)
                raw = f.read(min(4096, at + length - f.tell()))
            row = parse_headers(bytes(text[:end]))
            if self._wanted(row):
                block = b""
                if want:
                    block = bytes(text[end + 4 :]) + z.decompress(raw + f.read(at + length - f.tell()))
                    if len(block) < row["_length"]:
                        raise ValueError("cut off")
                yield row, block[: row["_length"]]
            f.seek(at + length)
        if f.tell() < span.end:
            plain = _Bytes(f, span.end)
            while (raw := plain.upto(b"\r\n\r\n")) is not None:
                if not raw.strip(b"\r\n"):
                    continue
                row = parse_headers(raw.lstrip(b"\r\n"))
                ok = self._wanted(row)
                block = plain.take(row["_length"], ok and want)
                if ok:
                    yield row, block

    def read(self, span):
        import pyarrow as pa

        store, _ = _store(self.path)
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in self.names])
        batch = lambda rows: pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in self.names}, schema=schema)
        if span.start >= span.end:
            return
        rows, held = [], 0
        with store.open_input_file(span.path) as f:
            try:
                for row, block in self._records(f, span, self.verify or "payload" in self.names):
                    if (self.verify or "payload" in self.names) and row["record_type"] != "revisit":
                        row["payload"] = payload = _payload(row, block)
                        if self.verify:
                            row["payload_bytes"], digest = len(payload), row["payload_digest"]
                            if digest and ":" not in digest and digest != (found := hashlib.sha256(payload).hexdigest()):
                                raise AssertionError(f"digest of page {row['page_id']} in {span.path} is {found}, not {digest}")
                        held += len(payload) if "payload" in self.names else 0
                    rows.append(row if "payload" in self.names else {k: v for k, v in row.items() if k != "payload"})
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            except (ValueError, zlib.error) as e:
                if not self.skip:
                    raise ValueError(f"{span.path}, before byte {f.tell()}: {e}") from e
        if rows:
            yield batch(rows)


class WarcDataSource(DataSource):
    """format("warc"): options path, verify (payloads are decoded and held against their digests) and malformed (fail or skip)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema.names, str(self.options.get("verify", "false")).lower() == "true", self.options.get("malformed") == "skip")

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def deduplicated(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_digest, payload_bytes, refers_to. Only digests that occur twice are joined back."""
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("bigint")})
    twice = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    twice = materialise(twice, "warc-repeats")  # its size is known from here on, and decides how it is joined
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(twice, "payload_digest", "left").select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_digest", "payload_bytes", refers.alias("refers_to"))


def write(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    deduplicated(pages).write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, schema: str = READ_SCHEMA, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).option("verify", str(verify).lower()).load(path)


def query(spark, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    # the record type is pushed down: payloads of responses are decoded and held against their digests, of revisits only headers are inflated
    both = read(spark, path, HEADERS, verify=True).where("record_type = 'response'").unionByName(read(spark, path, HEADERS).where("record_type = 'revisit'"))
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id = p.page_id THEN NULL ELSE f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100"""
