"""WARC archives: writing, reading, and assembly of transactions.

A capture is written as three records by Spark's text writer, whose line
separator is the blank lines between records; only the payloads of first
occurrences are stored.  Gzipped archives are read as streams, whatever their
size, and parsed by their Content-Length.  Requests, responses and metadata are
joined through their concurrent-to identifiers into one nested row per capture.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lattica.llm.common import cut, drop, prepare, remove, shared_folder

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are stored each time.
LEAST_REVISIT = 100
#: Captures in a file at most, so that there are files for many tasks; memory doesn't depend on it.
CAPTURES_A_FILE = 4096
#: Spark's line reader cuts a gzipped archive here into rows; their bytes are joined again before records are parsed.
BETWEEN = "\r\n\r\nWARC/"
#: Bytes of blocks that the reader holds before it passes records on.
READ_BYTES = 4 << 20

RECORDS = (
    "record_type string, record_id string, concurrent_to string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, page_id long, block binary"
)


def _urn(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    at = [F.substring(digest, k, n) for k, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *at), F.lit(">"))


def _record(kind: str, block: Column, *headers: tuple[str, Column]) -> Column:
    """One record's text; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    head = F.concat_ws(END, F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(END + END), block)


def write_archives(captures: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> None:
    """captures (page_id, url, html, ...) as gzipped WARC files in a new folder.

    Of captures with equal payloads of at least ``least`` bytes, that with the
    smallest page_id is a response and the others are revisits of it; rows that
    share that page_id are responses too, as are all where no page_id is given.
    A null html is an empty payload, a null url has no target, a null page_id
    no identifier.  Line breaks in a url are percent-encoded.  Further columns
    are ignored.
    """
    rows = captures.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"bytes": F.octet_length("html"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    # An aggregate is cut before its join, so that both sides are exchanges and a crowded digest can be split.
    firsts = cut(
        rows.where(F.col("bytes") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select(F.col("digest").alias("same"), "first")
    )
    dealt = rows.join(firsts, F.col("digest") == F.col("same"), "left").withColumn(
        "again", F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    )
    dealt = dealt.withColumn("row", F.monotonically_increasing_id())
    request = _urn(F.lit("request"), F.col("page_id"), F.col("digest"), F.col("row"))
    response = _urn(F.lit("response"), F.col("page_id"), F.col("digest"))
    revisit = _urn(F.lit("revisit"), F.col("page_id"), F.col("digest"), F.col("row"))
    first = _urn(F.lit("response"), F.col("first"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    shared = [
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Concurrent-To", F.col("request_id")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    answer = F.when(
        F.col("again"),
        _record("revisit", http, ("WARC-Record-ID", revisit), ("WARC-Refers-To", first), ("WARC-Profile", F.lit(PROFILE)), *shared),
    ).otherwise(_record("response", F.concat(http, F.col("html")), ("WARC-Record-ID", response), *shared))
    asked = _record(
        "request",
        F.concat(F.lit(f"GET / HTTP/1.1{END}Host: "), F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("")), F.lit(END + END)),
        ("WARC-Record-ID", F.col("request_id")),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Date", F.lit(date)),
        ("Content-Type", F.lit("application/http; msgtype=request")),
    )
    about = _record(
        "metadata",
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(END)),
        ("WARC-Record-ID", _urn(F.lit("metadata"), F.col("page_id"), F.col("digest"), F.col("row"))),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Concurrent-To", F.col("request_id")),
        ("Content-Type", F.lit("application/warc-fields")),
    )
    between = END + END
    text = dealt.withColumn("request_id", request).select(F.concat_ws(between, answer, asked, about).alias("value"))
    text.write.option("lineSep", between).option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_A_FILE).text(folder)


def _lines(stream, where: str) -> dict[str, str]:
    headers = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError(f"{where}: headers without an end")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers


def parse(stream, where: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; header names in lower case.  A broken record raises ValueError."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{where}: no record at {line[:40]!r}")
        headers = _lines(stream, where)
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"{where}: a record ends early")
        yield headers, block


class _Inflated(io.RawIOBase):
    """The bytes of concatenated gzip members, inflated as they are read."""

    def __init__(self, packed: bytes):
        self.packed, self.engine = memoryview(packed), zlib.decompressobj(31)
        self.left = self.packed

    def readable(self):
        return True

    def readinto(self, buffer):
        while True:
            if self.engine.eof:
                rest = self.engine.unused_data
                if not rest and not len(self.left):
                    return 0
                self.left = memoryview(bytes(rest) + bytes(self.left))
                self.engine = zlib.decompressobj(31)
            piece = self.engine.unconsumed_tail or bytes(self.left[: 1 << 16])
            if not self.engine.unconsumed_tail:
                self.left = self.left[1 << 16 :]
            out = self.engine.decompress(piece, len(buffer))
            if out:
                buffer[: len(out)] = out
                return len(out)
            if not piece:
                return 0


def _payload(headers: dict[str, str], block: bytes) -> tuple[str | None, int | None]:
    """Digest and bytes of an HTTP payload: those of the block, or for a revisit those that it states."""
    stream = io.BytesIO(block)
    stream.readline()
    try:
        http = _lines(stream, "")
    except ValueError:
        http = {}
    stated = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if headers.get("warc-type") == "revisit":
        return stated, int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    payload = block[stream.tell() :]
    digest = hashlib.sha256(payload).hexdigest()
    if stated and len(stated) == 64 and headers["warc-payload-digest"].startswith("sha256:") and stated != digest:
        raise ValueError(f"{headers.get('warc-record-id')}: the payload has another digest")
    return digest, len(payload)


class _Joined(io.RawIOBase):
    """The bytes of an archive from the pieces that the line reader made of it."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left, self.begun = pieces, memoryview(b""), False

    def readable(self):
        return True

    def readinto(self, buffer):
        while not len(self.left):
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.left, self.begun = memoryview(BETWEEN.encode() + piece if self.begun else piece), True
        taken = min(len(buffer), len(self.left))
        buffer[:taken] = self.left[:taken]
        self.left = self.left[taken:]
        return taken


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, value in zip(batch.column(0), batch.column(1), strict=True):
            yield path.as_py(), value.as_py()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, io.BufferedIOBase]]:
    """Archives that are one value each."""
    for path, content in _values(batches):
        yield path, io.BufferedReader(_Inflated(content), 1 << 16) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, io.BufferedIOBase]]:
    """Archives whose pieces follow one another; one piece is held at a time."""
    for path, pieces in itertools.groupby(_values(batches), key=lambda row: row[0]):
        yield path, io.BufferedReader(_Joined(value for _, value in pieces), 1 << 16)


def _parsed(opened, keep_blocks: bool):
    schema = to_arrow_schema(T.StructType.fromDDL(RECORDS))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, stream in opened(batches):
            for headers, block in parse(stream, path):
                kind = headers.get("warc-type", "")
                digest = size = page = None
                if kind in ("response", "revisit") and "http" in headers.get("content-type", ""):
                    digest, size = _payload(headers, block)
                if kind == "metadata" and "warc-fields" in headers.get("content-type", ""):
                    value = _lines(io.BytesIO(block + b"\r\n"), path).get("page-id", "")
                    page = int(value) if value.lstrip("-").isdigit() else None
                names = ("warc-record-id", "warc-concurrent-to", "warc-target-uri", "warc-refers-to")
                rows.append((kind, *[headers.get(n) for n in names], digest, size, page, block if keep_blocks else None))
                held += len(block) if keep_blocks else 0
                if held >= READ_BYTES or len(rows) >= 2048:
                    yield batch_of(rows)
                    rows, held = [], 0
        yield batch_of(rows)

    return run


def read_records(spark: SparkSession, folder: str, keep_blocks: bool = True) -> DataFrame:
    """The records of a folder of WARC files, plain or gzipped (one member or one per record).

    Files named ``*.gz`` are streamed, one task each, a record held at a time,
    so their size is not bounded.  Others are read as one value, which Spark
    bounds by 2 GB; a file beyond that fails rather than being cut.
    """
    prepare(spark)
    packed = spark.read.option("lineSep", BETWEEN).option("pathGlobFilter", "*.gz").text(folder)
    pieces = packed.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("content"))
    plain = spark.read.format("binaryFile").load(folder).select("path", "content").where(~F.endswith("path", F.lit(".gz")))
    return pieces.mapInArrow(_parsed(_streamed, keep_blocks), RECORDS).union(plain.mapInArrow(_parsed(_whole, keep_blocks), RECORDS))


def assemble(records: DataFrame) -> DataFrame:
    """Records to one nested row per capture: (response, request, metadata).

    A response or revisit and a request belong together if either names the
    other in WARC-Concurrent-To; a metadata record belongs to the capture whose
    response or request it names.  ``metadata`` is an array, as a capture may
    have several; request is null and metadata empty where there are none.
    Requests and metadata of no response make no capture.  Record identifiers
    are unique in an archive, but for responses that name their request.
    """
    def of(*kinds: str) -> DataFrame:
        return records.where(F.col("record_type").isin(*kinds)).select(F.struct("*").alias("r"))

    answers = of("response", "revisit").select(F.col("r").alias("response"))
    asked = of("request").select(F.col("r").alias("request"))
    named = asked.select(F.col("request.record_id").alias("own"), F.col("request").alias("asked_1"))
    naming = asked.where("request.concurrent_to is not null").select(F.col("request.concurrent_to").alias("other"), F.col("request").alias("asked_2"))
    about = of("metadata").where("r.concurrent_to is not null").groupBy(F.col("r.concurrent_to").alias("about")).agg(F.collect_list("r").alias("notes"))
    pairs = (
        answers.join(named, F.col("response.concurrent_to") == F.col("own"), "left")
        .join(naming, (F.col("response.record_id") == F.col("other")) & F.col("own").isNull(), "left")
        .select("response", F.coalesce("asked_1", "asked_2").alias("request"))
    )
    first = about.select(F.col("about").alias("about_1"), F.col("notes").alias("notes_1"))
    second = about.select(F.col("about").alias("about_2"), F.col("notes").alias("notes_2"))
    none = F.array().cast(dict(about.dtypes)["notes"])
    return (
        pairs.join(first, F.col("request.record_id") == F.col("about_1"), "left")
        .join(second, F.col("response.record_id") == F.col("about_2"), "left")
        .select("response", "request", F.concat(F.coalesce("notes_1", none), F.coalesce("notes_2", none)).alias("metadata"))
    )


def archived(pages: DataFrame) -> DataFrame:
    """Writes a capture per row of pages (page_id, url, html, ...), reads the archives back and assembles them.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to), a
    row per row; refers_to is the page_id of the response that a revisit names.
    An empty table gives an empty result.  The archives are removed afterwards.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    try:
        write_archives(pages, folder)
        # Records without blocks are small, and assembly reads them several times; archives are parsed once.
        records = cut(read_records(spark, folder, keep_blocks=False))
    finally:
        remove(spark, folder)
    captures = cut(
        assemble(records).select(
            F.col("metadata")[0]["page_id"].alias("page_id"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_digest").alias("payload_digest"),
            F.col("response.record_type").alias("record_type"),
            F.col("response.record_id").alias("record_id"),
            F.col("response.refers_to").alias("named"),
        )
    )
    drop(records)
    firsts = cut(captures.where("record_type = 'response'").groupBy(F.col("record_id").alias("first")).agg(F.min("page_id").alias("refers_to")))
    return captures.join(firsts, F.col("named") == F.col("first"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


#: The registered query in DuckDB.
ORACLE_SQL = """
with payloads as (
  select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest,
         strlen(coalesce(html, '')) as payload_bytes from pages),
firsts as (select *, min(page_id) over (partition by payload_digest) as first from payloads)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first <> page_id then first end as refers_to
from firsts
"""
