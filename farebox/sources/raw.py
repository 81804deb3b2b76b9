"""Raw inputs: CSV files, ZIP archives and the HTML index that lists them."""

from __future__ import annotations

import csv
import io
import struct
import zipfile
import zlib
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.functions.text import zip_links
from farebox.schemas import RAW_COLUMNS, RAW_SCHEMA


def require_columns(df: DataFrame, columns: list[str], where: str = "entrada") -> DataFrame:
    """The frame itself if it has all ``columns``; otherwise an error that names what is absent."""
    absent = sorted(set(columns).difference(df.columns))
    if absent:
        raise ValueError(f"Columnas faltantes ({where}): {', '.join(absent)}; hay {', '.join(df.columns)}")
    return df


# Beyond any file: a scan with these sizes gives every file one task of its own.
WHOLE_FILES = 1 << 60


def header_names(line: str) -> list[str]:
    return [name.strip() for name in next(csv.reader([line.lstrip("\ufeff")]), [])]


def header_census(spark: SparkSession, path) -> DataFrame:
    """(header, files): the column names in the first line of every file, and the files that have them.

    A task for each file reads its first lines and leaves the rest; compressed files are opened as
    such. Nothing is opened on the driver, which gets the paths that a scan needs anyway.
    """
    own = spark.newSession()  # the sizes are this scan's alone
    for size in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{size}", str(WHOLE_FILES))
    lines = own.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")

    def first_line(batches):
        for batch in batches:
            if batch.num_rows:
                header = pa.array([header_names(batch.column(1)[0].as_py())], pa.list_(pa.string()))
                file = pa.array([unquote(batch.column(0)[0].as_py())])
                yield pa.RecordBatch.from_arrays([header, file], names=["header", "file"])
                return

    census = lines.mapInArrow(first_line, "header array<string>, file string")
    return census.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))


def read_raw_csv(spark: SparkSession, path, uniform: bool = False) -> DataFrame:
    """Boarding counts as text; the six known columns of every file, found by name.

    Files may have further columns and any order of them; those with the same header are one scan.
    No file is read to infer anything; empty files have no rows.

    ``uniform`` takes the header of one file for that of all and spares the census; the scan compares
    each file's header and fails where one differs (see :func:`headers_differ`).
    """
    if uniform:
        first = spark.read.text(path).select("value").first()
        scans = [(header_names(first.value), path)] if first else []
    else:
        scans = sorted((r.header, r.files) for r in header_census(spark, path).collect())
    parts = []
    for header, files in scans:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
        require_columns(spark.createDataFrame([], schema), RAW_COLUMNS, files if uniform else files[0])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", not uniform)
        parts.append(reader.csv(files).select(*RAW_COLUMNS))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RAW_SCHEMA)


def headers_differ(error: Exception) -> bool:
    """Whether a scan that was read as ``uniform`` failed at another header."""
    return "CSV header does not conform to the schema" in str(error)


EXTRACT_SCHEMA = "archive string, member string, error string, " + ", ".join(f"{c} string" for c in RAW_COLUMNS)
UNREADABLE = (
    zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, pa.ArrowInvalid, UnicodeDecodeError, csv.Error,
)


MEMBER_SCHEMA = "archive string, member string, error string, method int, crc long, size long, content binary"
STORED, DEFLATED, ENCRYPTED = 0, 8, 1  # fixed values of the archive format
LOCAL_HEADER = struct.Struct("<4s22xHH")


def _members_of_archives(batches):
    """By the central directory: a row for each ``.csv`` member, with its bytes as they are stored."""
    schema = pa.schema([
        ("archive", pa.string()), ("member", pa.string()), ("error", pa.string()), ("method", pa.int32()), ("crc", pa.int64()),
        ("size", pa.int64()), ("content", pa.binary()),
    ])

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    for batch in batches:
        for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = memoryview(content.as_buffer())
            try:
                # Of members with one name the last counts, as for any reader of the format.
                listed = {m.filename: m for m in zipfile.ZipFile(pa.BufferReader(data)).infolist()}
            except zipfile.BadZipFile as exc:
                yield row(archive, None, f"archivo ilegible: {exc}", None, None, None, None)
                continue
            for name, member in listed.items():
                if not name.lower().endswith(".csv"):
                    continue
                begin = member.header_offset
                mark, *lengths = LOCAL_HEADER.unpack(data[begin:begin + LOCAL_HEADER.size].tobytes().ljust(LOCAL_HEADER.size, b"\0"))
                begin += LOCAL_HEADER.size + sum(lengths)
                stored = data[begin:begin + member.compress_size]
                problem = None
                if mark != b"PK\3\4" or len(stored) < member.compress_size:
                    problem = "miembro fuera del archivo"
                elif member.flag_bits & ENCRYPTED or member.compress_type not in (STORED, DEFLATED):
                    problem = "miembro cifrado o con otra compresión"
                part = [None] * 4 if problem else [member.compress_type, member.CRC, member.file_size, stored.tobytes()]
                yield row(archive, name, problem, *part)


class _Member(io.RawIOBase):
    """The content of one member as a stream; its checksum and size are compared at the end."""

    def __init__(self, method: int, crc: int, size: int, stored: bytes):
        self.rest, self.expected, self.crc, self.size = stored, (crc, size), 0, 0
        self.inflate = zlib.decompressobj(-15) if method == DEFLATED else None

    def readable(self):
        return True

    def readinto(self, target):
        room = len(target)
        if self.inflate is None:
            out, self.rest = self.rest[:room], self.rest[room:]
        else:
            out = self.inflate.decompress(self.rest, room)
            self.rest = self.inflate.unconsumed_tail
            if not out and not self.inflate.eof:
                raise EOFError("miembro incompleto")
        if not out and (self.crc, self.size) != self.expected:
            raise zipfile.BadZipFile("suma de verificación incorrecta")
        self.crc, self.size = zlib.crc32(out, self.crc), self.size + len(out)
        target[:len(out)] = out
        return len(out)


def _rows_of_members(batches):
    names = ["archive", "member", "error", *RAW_COLUMNS]

    def problem(archive, member, text):
        values = [archive, member, text] + [None] * len(RAW_COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in values], names)

    for batch in batches:
        for k in range(batch.num_rows):
            archive, member, error, method, crc, size = (batch.column(c)[k].as_py() for c in range(6))
            if error is not None:
                yield problem(archive, member, error)
                continue
            try:
                stream = io.BufferedReader(_Member(method, crc, size, batch.column(6)[k].as_py()), 1 << 18)
                header = next(csv.reader([stream.readline().decode("utf-8-sig")]), [])
                columns = [c.strip() for c in header]
                missing = [c for c in RAW_COLUMNS if c not in columns]
                if missing:
                    yield problem(archive, member, f"Columnas faltantes: {missing}")
                    continue
                if not stream.peek(1):
                    continue
                # Only an empty field is null; the text NA is text, as for the CSV reader.
                options = pacsv.ConvertOptions(
                    include_columns=RAW_COLUMNS,
                    column_types={c: pa.string() for c in RAW_COLUMNS},
                    strings_can_be_null=True,
                    null_values=[""],
                )
                for part in pacsv.open_csv(stream, read_options=pacsv.ReadOptions(column_names=columns), convert_options=options):
                    head = [pa.array([v] * part.num_rows, pa.string()) for v in (archive, member, None)]
                    yield pa.RecordBatch.from_arrays(head + list(part.columns), names)
            except UNREADABLE as exc:
                yield problem(archive, member, f"{type(exc).__name__}: {exc}")


def extract_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every ``.csv`` member of every ZIP, with the archive and member they came from.

    A corrupt archive or unreadable member gives one row with ``error`` set. Rows read before a
    member broke are still here; :func:`extracted_rows` leaves such members out as a whole.
    """
    return extract_from(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path))


def extract_from(files: DataFrame) -> DataFrame:
    """As :func:`extract_archives` for archives held as rows (path, content).

    A task reads the central directory of an archive, 2 GB at most, and hands on its members as they
    are stored. These are dealt over all tasks, which inflate and parse them as streams, so an archive
    with a year of files is no task of its own. Their number is stated, as stored bytes say little of the work.
    """
    members = files.select("path", "content").mapInArrow(_members_of_archives, MEMBER_SCHEMA)
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(tasks, "archive", "member").mapInArrow(_rows_of_members, EXTRACT_SCHEMA)


def extracted_rows(extracted: DataFrame) -> DataFrame:
    """Rows of the members that were read to their end; of members with one name, those of one archive.

    Archives may repeat a day. The copy in the first archive by name that could be read counts.
    """
    members = extracted.groupBy("member", "archive").agg(F.count("error").alias("errors"))
    chosen = members.where("errors = 0 AND member IS NOT NULL").groupBy("member").agg(F.min("archive").alias("archive"))
    return extracted.join(chosen, ["member", "archive"], "left_semi").select(*RAW_COLUMNS)


def bad_inputs(extracted: DataFrame) -> DataFrame:
    return extracted.where("error IS NOT NULL").select("archive", "member", "error")


def links_from_index(
    html: DataFrame, key: str = "page_id", text: str = "html", pattern: str = r"(salidas\d{8}\.zip)",
    prefix: str = "salidas2025",
) -> DataFrame:
    """File names found in index pages: each once, ordered by first appearance.

    ``prefix`` keeps one year of names.
    """
    found = html.select(F.col(key).alias("page"), F.posexplode(zip_links(text, pattern)).alias("pos", "name"))
    return (
        found.where(F.col("name").startswith(prefix))
        .groupBy("name")
        .agg(F.min(F.struct("page", "pos")).alias("first"), F.count("*").alias("mentions"))
        .select("name", F.col("first.page").alias("first_page"), F.col("first.pos").alias("first_pos"), "mentions")
    )
