"""WARC archives as a Spark data source, in Python, and pages kept in them once for each payload.

    spark.dataSource.register(WarcSource)
    rows.write.format("warc").mode("append").save(folder)
    read(spark, folder, "record_type string, target_uri string").where("record_type = 'response'")

Writing: a task writes one file of gzip members, a record each, with the length of the member in its header (subfield `sl`),
so that a reader can pass over it unread. Files count from the moment the manifest of their job lists them: what a lost or
repeated task left behind is never read. Folders are append-only; overwriting is refused.

Reading: each file of the manifests is cut at places noted while it was written, one partition a piece; a folder without
manifests gives a partition for each *.warc and *.warc.gz under it. A record's header is parsed first. Filters on the string
columns are pushed to it, and the payload of a record that they refuse, or any payload where the schema has no such
column, is passed over: by a seek where the length is known (plain files, members with `sl`), else inflated in pieces and
let go. Option `verify` recomputes the digest of each response's payload; one that differs fails the read, as does a record
cut short, with file and place.

Records: a response holds an HTTP message, its payload is the message's body; a revisit (identical payload digest) holds
the HTTP header alone, so its payload is null and payload_bytes is the length its header gives. Other types hold their block as it is.
Null columns are left out of a header; control characters in header fields are written as %XX. Empty payloads are records
like others. A record is held in memory whole, as it becomes one value of a row. Unknown columns of the rows are refused.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .common import sent_if_small, shared_dir, small_batches, stored

#: Header field of each string column that is one.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "refers_to_uri": "WARC-Refers-To-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
KINDS = dict.fromkeys(HEADERS, T.StringType()) | {"payload_bytes": T.LongType(), "fields": T.MapType(T.StringType(), T.StringType()), "payload": T.BinaryType()}
SCHEMA = T.StructType([T.StructField(n, kind) for n, kind in KINDS.items()])
_ARROW = dict.fromkeys(HEADERS, pa.string()) | {"payload_bytes": pa.int64(), "fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Date of records that bring none.
NO_DATE = "1970-01-01T00:00:00Z"
#: A file is cut into pieces of about so many bytes; a batch has so many rows and bytes of payload at most.
PIECE, ROWS, BYTES = 16 << 20, 256, 8 << 20
LEVEL = 4
_TYPED = ("response", "revisit")


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:/", uri) else (fs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict) -> bytes:
    """A record's bytes. Responses and revisits bring the whole payload; a revisit keeps its digest and length only."""
    kind, payload = row.get("record_type") or "resource", row.get("payload") or b""
    sha = digest(payload)
    head = {"WARC-Type": kind, "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("date") or NO_DATE}
    head |= {HEADERS[c]: row[c] for c in ("target_uri", "refers_to", "refers_to_uri") if row.get(c) is not None}
    content = row.get("content_type") or "text/html"
    block = payload
    if kind in _TYPED:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: {_safe(content)}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        block, content = http + (payload if kind == "response" else b""), f"application/http; msgtype={kind}"
    if kind == "revisit":
        head["WARC-Profile"] = IDENTICAL
    head |= {"WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": content, **dict(row.get("fields") or ()), "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {_safe(v)}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with its own length and that of the data in the subfield `sl`."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    cuts: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        files, base = at(self.folder)
        files.create_dir(base, recursive=True)
        name, size, cuts = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        out = None
        for batch in iterator:
            for k in range(batch.num_rows):
                out = out or files.open_output_stream(f"{base}/{name}", compression=None)  # members are compressed one by one
                data = member(record({c: v[k].as_py() for c, v in zip(batch.schema.names, batch.columns, strict=True)}))
                out.write(data)
                size += len(data)
                if size - cuts[-1] >= PIECE:
                    cuts.append(size)
        if out:
            out.close()
        return Written(name, size, cuts)

    def commit(self, messages):
        files, base = at(self.folder)
        listed = [[m.name, m.size, m.cuts] for m in messages if m is not None and m.size]
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages):
        files, base = at(self.folder)
        for m in messages:
            if m is not None and m.size:
                files.delete_file(f"{base}/{m.name}")


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int | None  # None: to the end of the file


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.folder, self.verify = options["path"], str(options.get("verify", "")).lower() == "true"
        self.names = schema.names
        if wrong := [f.name for f in schema if KINDS.get(f.name) != f.dataType]:
            raise ValueError(f"not columns of a WARC record, or of another type: {wrong}")
        self.tests = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo | In | IsNotNull | StringStartsWith | StringEndsWith | StringContains):
                self.tests.append((name, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        files, base = at(self.folder)
        found = [f for f in files.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file]
        manifests = [f.path for f in found if f.base_name.startswith("_manifest-")]
        if not manifests:
            return [Piece(f.path, 0, None) for f in found if f.base_name.endswith((".warc", ".warc.gz"))] or [Piece("", 0, 0)]
        pieces = []
        for m in manifests:
            with files.open_input_stream(m) as opened:
                for name, size, cuts in json.loads(opened.read()):
                    ends = [*cuts[1:], size]
                    pieces += [Piece(f"{m.rpartition('/')[0]}/{name}", a, b) for a, b in zip(cuts, ends, strict=True) if a < b]
        return pieces or [Piece("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        files, _ = at(self.folder)
        schema = pa.schema([(n, _ARROW[n]) for n in self.names])
        want = {"payload"} & set(self.names)
        kept, held = [], 0
        with files.open_input_file(partition.path) as opened:
            for row in rows_of(opened, partition, self.tests, bool(want), self.verify, "payload_bytes" in self.names):
                kept.append(tuple(row.get(n) for n in self.names))
                held += len(row.get("payload") or b"")
                if len(kept) >= ROWS or held >= BYTES:
                    yield _batch(kept, schema)
                    kept, held = [], 0
        if kept:
            yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Plain:
    """Records one after another in a file, not compressed."""

    def __init__(self, file):
        self.file = file

    def take(self, n: int) -> bytes:
        return self.file.read(n)

    def line(self) -> bytes:
        return self.file.readline()

    def skip(self, n: int) -> None:
        self.file.seek(n, io.SEEK_CUR)

    def end(self) -> None:
        """To the next record: over the two line ends after a block."""
        while (c := self.file.peek(1)[:1]) in (b"\r", b"\n") and c:
            self.file.read(1)


class Member:
    """The gzip member at the file's place. Its length is known from the subfield `sl`, or found by inflating it."""

    def __init__(self, file):
        self.file, self.start, self.length = file, file.tell(), None
        head = file.read(10)
        if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        if head[3] & 4:
            extra = file.read(struct.unpack("<H", file.read(2))[0])
            if extra[:2] == b"sl" and len(extra) >= 12:
                self.length = struct.unpack("<I", extra[4:8])[0]
        file.seek(self.start)
        self.inflate, self.ready, self.done = zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        data = self.inflate.unconsumed_tail or self.file.read(16384)
        if not data or self.inflate.eof:
            return False
        self.ready += self.inflate.decompress(data, 65536)
        return True

    def take(self, n: int) -> bytes:
        """All of a payload is inflated at once, what is behind it stays."""
        parts, have = [self.ready], len(self.ready)
        while have < n and not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.file.read(min(max(n - have, 16384), 1 << 20))
            if not data:
                break
            parts.append(self.inflate.decompress(data, n - have))
            have += len(parts[-1])
        data = b"".join(parts)
        self.ready = data[n:]
        return data[:n]

    def line(self) -> bytes:
        while (k := self.ready.find(b"\n")) < 0:
            if not self._more():
                k = len(self.ready) - 1
                break
        found, self.ready = self.ready[: k + 1], self.ready[k + 1 :]
        return found

    def skip(self, n: int) -> None:
        pass  # end() goes to the next member whatever was read of this one

    def end(self) -> None:
        if self.length:
            self.file.seek(self.start + self.length)
            return
        while not self.inflate.eof and self._more():
            self.ready = b""
        if not self.inflate.eof:
            raise ValueError("a member is cut short")
        self.file.seek(-len(self.inflate.unused_data), io.SEEK_CUR)


def fields_of(source) -> dict[str, str]:
    """Header fields up to the empty line; a line that begins with white space goes on with the one before."""
    found, last = {}, None
    while (line := source.line()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a header is cut short")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            found[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip()
        found[last] = value.strip()
    return found


def passes(row: dict, tests: list) -> bool:
    for name, kind, value in tests:
        have = row.get(name)
        if have is None:
            return False
        if kind == "EqualTo" and have != value or kind == "In" and have not in value:
            return False
        if kind == "StringStartsWith" and not have.startswith(value) or kind == "StringEndsWith" and not have.endswith(value) or kind == "StringContains" and value not in have:
            return False
    return True


def rows_of(opened, piece: Piece, tests: list, payload: bool, verify: bool, lengths: bool = True):
    """A dict for each record of a piece that passes the tests, its header parsed before anything else."""
    size = opened.size()
    opened.seek(piece.start)
    file = io.BufferedReader(opened, 1 << 18)
    end = size if piece.end is None else piece.end
    zipped = file.peek(2)[:2] == b"\x1f\x8b"
    place = piece.start
    try:
        while (place := file.tell()) < end:
            source = Member(file) if zipped else Plain(file)
            version = source.line()
            if not version.startswith(b"WARC/"):
                raise ValueError("no record begins here")
            row = _row(source, tests, payload, verify, lengths)
            source.end()
            if row:
                yield row
    except (ValueError, zlib.error, struct.error) as e:
        raise ValueError(f"{piece.path} at {place}: {e}") from e


def _row(source, tests, payload, verify, lengths) -> dict | None:
    head = fields_of(source)
    low = {k.lower(): v for k, v in head.items()}
    row = {c: low.get(h.lower()) for c, h in HEADERS.items()}
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    length = int(low["content-length"]) if low.get("content-length", "").isdigit() else -1
    if length < 0:
        raise ValueError("a record without a length")
    kind = row["record_type"]
    own = {HEADERS[c].lower() for c in HEADERS} | {"content-length", "warc-profile"}
    row["fields"] = [(k, v) for k, v in head.items() if k.lower() not in own]
    if not passes(row, tests):
        source.skip(length)
        return None
    verify = verify and kind == "response"
    if kind in _TYPED and (payload or verify or lengths):
        counted = _Counted(source)
        if not counted.line().startswith(b"HTTP/"):
            raise ValueError("no HTTP message in a record of HTTP")
        http = {k.lower(): v for k, v in fields_of(counted).items()}
        row["content_type"], rest = http.get("content-type"), length - counted.n
        row["payload_bytes"] = int(http.get("content-length", -1)) if kind == "revisit" else rest
    else:
        rest = row["payload_bytes"] = length
    if (payload or verify) and kind != "revisit":
        row["payload"] = source.take(rest)
        if len(row["payload"]) < rest:
            raise ValueError("a payload is cut short")
        if verify and digest(row["payload"]) != row["payload_digest"]:
            raise ValueError("a payload differs from its digest")
    else:
        source.skip(rest)
    return row


class _Counted:
    def __init__(self, source):
        self.source, self.n = source, 0

    def line(self) -> bytes:
        found = self.source.line()
        self.n += len(found)
        return found


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are append-only: write to a new folder")
        if wrong := [f.name for f in schema if f.name not in _ARROW]:
            raise ValueError(f"not columns of a WARC record: {wrong}")
        return WarcWriter(self.options["path"])


def read(spark: SparkSession, folder: str, schema: str | T.StructType = SCHEMA, verify: bool = False) -> DataFrame:
    """Records under a folder; only the columns of `schema` are made, and payloads only where it has them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(schema).option("verify", str(verify).lower()).load(folder)


def write(rows: DataFrame, folder: str) -> None:
    small_batches(rows.sparkSession)
    rows.sparkSession.dataSource.register(WarcSource)
    rows.write.format("warc").mode("append").save(folder)


def _urn(page_id, url, key):
    h = F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), key), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def deduplicated(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages (page_id, url, html; further columns are left out) as rows for write(). Of equal payloads of at least `least`
    bytes that of the largest page_id (null is smallest; then the largest url) is a response, the others revisit it, so
    also full repeats of a row. Only keys that several rows have meet the pages again, broadcast if counted small."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("key", F.sha2("payload", 256))
    same = pages.where(F.octet_length("payload") >= least).groupBy("key", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    top = same.groupBy("key").agg(F.max(F.struct("page_id", "url", "n")).alias("top"), F.sum("n").alias("rows")).where("rows > 1")
    top = sent_if_small(stored(top.select("key", F.col("top.page_id").alias("top_id"), F.col("top.url").alias("top_url"), F.col("top.n").alias("top_n")), "payloads"))
    rows = pages.join(top, "key", "left")
    first = F.col("page_id").eqNullSafe(F.col("top_id")) & F.col("url").eqNullSafe(F.col("top_url"))
    rows = rows.withColumn("place", F.when(F.col("top_n").isNull(), "only").when(~first, "later").when(F.col("top_n") == 1, "only").otherwise("one of repeats"))
    plain = rows.where("place <> 'one of repeats'").withColumn("revisit", F.col("place") == "later")
    # repeats of the whole row: any one of them is the response
    repeats = rows.where("place = 'one of repeats'").withColumn("revisit", F.row_number().over(Window.partitionBy("key").orderBy("page_id")) > 1)
    rows = plain.unionByName(repeats)
    fields = F.map_filter(
        F.create_map(F.lit("X-Page-ID"), F.col("page_id").cast("string"), F.lit("X-Refers-To-Page-ID"), F.when(F.col("revisit"), F.col("top_id").cast("string"))), lambda _, v: v.isNotNull()
    )
    return rows.select(
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        F.when(~F.col("revisit"), _urn(F.col("page_id"), F.col("url"), F.col("key"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(F.col("revisit"), _urn(F.col("top_id"), F.col("top_url"), F.col("key"))).alias("refers_to"),
        F.when(F.col("revisit"), F.col("top_url")).alias("refers_to_uri"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        fields.alias("fields"),
        "payload",
    )


def archived_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages into archives of their own and reads these back: responses with their payload, whose digest is taken
    again, revisits by their headers alone. An empty table gives no rows."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(deduplicated(pages, least), folder)
    small = "record_type string, payload_digest string, payload_bytes long, fields map<string,string>"
    responses = read(spark, folder, f"{small}, payload binary", verify=True).where("record_type = 'response'")
    revisits = read(spark, folder, small).where("record_type = 'revisit'")
    rows = responses.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload").unionByName(revisits)
    number = lambda name: F.element_at("fields", F.lit(name)).cast("long")
    return rows.select(number("X-Page-ID").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("X-Refers-To-Page-ID").alias("refers_to"))
