"""Web archives: one gzip member per record, written by Spark tasks and read back sequentially.

Writing: of records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the
largest id is a response with the payload and the others are revisits that refer to it; smaller
ones are responses all. A task cuts its records into archive parts of about ``PART_BYTES``; a part
is a whole archive of its own, a row with its name and bytes, so parts are written and read
anywhere without local files, and a lost task only writes its parts again.

Reading: the compressed bytes go into an incremental inflater block by block; where a member
ends, the next begins with the unused rest. In the inflated stream the header ends at an empty
line, Content-Length frames the block, and two line ends close the record. Digests of the block and of
the payload are computed and compared. What can't be read gives one row with ``problem`` and ends
that archive; records before it stand.

Null payloads are empty ones. Rows with equal id and payload are records each, all of the same
type. A null id is smaller than all others; of equal payloads with null ids alone, all are responses.
Extra columns aren't archived. An empty table gives no archive and no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm.sieve import mark
from farebox.session import materialize

REVISIT_BYTES = 1000
PART_BYTES = 1 << 20
INFLATE_BYTES = 1 << 16
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
# Header lines and names of the format (fixed values).
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-record:"


def sha1_text(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, not yet compressed. A revisit has the HTTP header of the full payload, but no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD}{'' if record_id is None else record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: {sha1_text(payload)}",
        f"WARC-Block-Digest: {sha1_text(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        lines.insert(2, "WARC-Target-URI: " + "".join(c for c in uri if c >= " "))
    if revisit:
        lines += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head = b"\r\n".join([VERSION, *(line.encode() for line in lines)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def plan_revisits(pages: DataFrame) -> DataFrame:
    """Add ``refers_to`` to pages (id, uri, payload): the id of the response for revisits, else null.

    Payloads are compared by SHA-256 and length, and (id, digest) alone is shuffled for that: the largest id
    of each digest is found before the shuffle, and only digests that occur more than once are joined
    back. A bitmap of the ids of revisits then spares all other pages a shuffle of their payloads.
    """
    digest = F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha2("payload", 256))
    keyed = pages.select("id", digest.alias("same")).where("same IS NOT NULL")
    groups = keyed.groupBy("same").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    groups = groups.where("n > 1 AND last IS NOT NULL").select("same", "last")
    later = keyed.join(groups, "same").where(~F.col("id").eqNullSafe(F.col("last"))).distinct()
    later = materialize(later)
    marked = mark(pages, later, "id", "may_revisit")
    plain = marked.where("NOT may_revisit").withColumn("refers_to", F.lit(None).cast("long"))
    likely = marked.where("may_revisit").withColumn("same", digest)
    match = later.withColumnsRenamed({"id": "id_", "same": "same_"})
    likely = likely.join(match, likely["id"].eqNullSafe(match["id_"]) & (likely["same"] == match["same_"]), "left")
    columns = ["id", "uri", "payload", "refers_to"]
    return plain.select(*columns).unionByName(likely.withColumnRenamed("last", "refers_to").select(*columns))


def write_parts(pages: DataFrame, record_id: str, uri: str, text: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(archive, content): the records of all rows in archive parts."""
    pages = pages.select(
        F.col(f"`{record_id}`").cast("long").alias("id"),
        F.col(f"`{uri}`").cast("string").alias("uri"),
        F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def part() -> pa.RecordBatch:
            names = pa.array([f"part-{task:06d}-{number:06d}.warc.gz"])
            return pa.RecordBatch.from_arrays([names, pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(4))):
                i, u, payload, refers = (x.as_py() for x in row)
                held.append(member(record_bytes(i, u, payload, refers)))
                size += len(held[-1])
                if size >= part_bytes:
                    yield part()
                    number, held, size = number + 1, [], 0
        if held:
            yield part()

    return plan_revisits(pages).mapInArrow(run, "archive string, content binary")


def write_archives(pages: DataFrame, path: str, record_id: str = "page_id", uri: str = "url", text: str = "html") -> None:
    """Write the archive parts as rows of a Parquet table; they are compressed already."""
    write_parts(pages, record_id, uri, text).write.option("compression", "uncompressed").parquet(path)


class Inflater:
    """The inflated stream of an archive, read as far as needed."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0
        self.held, self.done = bytearray(), 0
        self.member = None

    def more(self) -> bool:
        """Inflate one more block; False at the end of the archive."""
        if self.member is None:
            if self.at >= len(self.data):
                return False
            self.member = zlib.decompressobj(31)
        block = self.data[self.at : self.at + INFLATE_BYTES]
        if not len(block):
            raise ValueError("archive ends inside a member")
        self.held += self.member.decompress(block)
        self.at += len(block)
        if self.member.eof:
            self.at -= len(self.member.unused_data)
            self.member = None
        return True

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self.more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark; None if the stream ends where it began."""
        start = 0
        while (found := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if not self.held:
                    return None
                raise ValueError("archive ends inside a header")
        return self.take(found + len(mark))


def header_fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


def own_id(value: str | None) -> int | None:
    value = (value or "").strip("<>").removeprefix(RECORD)
    return int(value) if value.lstrip("-").isdigit() else None


def hex_digest(value: str | None) -> str | None:
    if not (value or "").startswith("sha1:"):
        return None
    return base64.b32decode(value[5:].upper()).hex()


def read_records(data: bytes) -> Iterator[dict]:
    """Records of one archive in order."""
    stream = Inflater(data)
    try:
        while (head := stream.until(b"\r\n\r\n")) is not None:
            if not head.startswith(b"WARC/"):
                raise ValueError("no record begins here")
            fields = header_fields(head)
            block = stream.take(int(fields["content-length"]))
            if stream.take(4) != b"\r\n\r\n":
                raise ValueError("record isn't closed")
            if "warc-block-digest" in fields and fields["warc-block-digest"] != sha1_text(block):
                raise ValueError("block has another digest")
            http, _, payload = block.partition(b"\r\n\r\n")
            kind, stated = fields.get("warc-type"), hex_digest(fields.get("warc-payload-digest"))
            if kind == "response":
                digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                if stated is not None and stated != digest:
                    raise ValueError("payload has another digest")
            else:
                digest = stated
                size = int(header_fields(http + b"\r\n").get("content-length", -1))
            yield {
                "record_id": own_id(fields.get("warc-record-id")),
                "uri": fields.get("warc-target-uri"),
                "record_type": kind,
                "refers_to": own_id(fields.get("warc-refers-to")),
                "payload_bytes": size if size >= 0 else None,
                "payload_digest": digest,
                "payload": payload if kind == "response" else None,
                "problem": None,
            }
    except (ValueError, KeyError, zlib.error) as error:
        yield {"problem": f"{type(error).__name__}: {error}"}


RECORD_SCHEMA = (
    "archive string, record_id long, uri string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary, problem string"
)
_ARROW = pa.schema(
    [("archive", pa.string()), ("record_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())]
)


def read_archives(parts: DataFrame, archive: str = "archive", content: str = "content", payload: bool = True) -> DataFrame:
    """Records of archives held as rows of name and bytes, such as ``binaryFile`` gives for files.

    Without ``payload`` the payloads are checked but not returned.
    """
    parts = parts.select(F.col(f"`{archive}`").alias("archive"), F.col(f"`{content}`").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for row in read_records(data.as_py() or b""):
                    size += len(row.get("payload") or b"")
                    if not payload:
                        row["payload"] = None
                    rows.append(row | {"archive": name.as_py()})
                    if size >= 4 * PART_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return parts.mapInArrow(run, RECORD_SCHEMA)
