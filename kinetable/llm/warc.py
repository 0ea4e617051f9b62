"""WARC archives through a chunked record table.

A payload travels as rows of (record, chunk number) with at most ``CHUNK`` bytes, and each row
carries the digest of all bytes so far, so no whole record is put together on either side. Spark
writes and reads the archives as gzip text: a row is what stands before a line feed. A payload of
several chunks is an HTTP body in chunked transfer coding, whose lines are those rows; archives of
others may have any lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from kinetable.llm.common import small_batches, store
from kinetable.operators.chunks import attach_by_key

#: Bytes of a chunk and of a batch of chunks; payloads below LEAST bytes are never revisits.
CHUNK, BATCH, LEAST = 1 << 16, 1 << 20, 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7F<>]")
_SUMS = pa.schema([("place", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string())])
_PIECES = pa.schema(
    [("place", pa.int64()), ("record_id", pa.string()), ("uri", pa.string()), ("row", pa.int64()), ("chunk", pa.int32())]
    + [("last", pa.bool_()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string())]
)
#: Chunks as read back. ``payload_bytes`` and ``digest`` cover the payload up to and including the chunk.
READ = pa.schema(
    [("file", pa.string()), ("record_no", pa.int64())]
    + [(name, pa.string()) for name in ("record_id", "record_type", "uri", "refers_to", "stated_digest")]
    + [("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string())]
)


class _Batches:
    """Rows gathered until they hold about BATCH bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size + 200
        if self.held >= BATCH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.rows, self.held = [], 0


def _slices(value: pa.Scalar) -> list[memoryview]:
    """A payload in chunks, without a copy; an empty or null one is one empty chunk."""
    raw = memoryview(value.as_buffer() if value.is_valid else b"")
    return [raw[at : at + CHUNK] for at in range(0, len(raw), CHUNK)] or [raw]


def _escaped(uri: str | None) -> str | None:
    """A name that fits into a header line: white space, controls and angles as percent codes."""
    return None if uri is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", uri)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Batches(_SUMS)
    for batch in batches:
        for place, payload in zip(*batch.columns, strict=True):
            digest, size = sha256(), 0
            for piece in _slices(payload):
                digest.update(piece)
                size += len(piece)
            yield from out.add((place.as_py(), size, digest.hexdigest()))
    yield from out.flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Batches(_PIECES)
    for batch in batches:
        for place, record_id, uri, row, payload in zip(*batch.columns, strict=True):
            parts, digest = _slices(payload), sha256()
            for piece in parts:
                digest.update(piece)
            size, name = sum(map(len, parts)), digest.hexdigest()
            head = (place.as_py(), _escaped(record_id.as_py()), _escaped(uri.as_py()), row.as_py())
            for i, piece in enumerate(parts):
                yield from out.add((*head, i, i == len(parts) - 1, piece.tobytes(), size, name), len(piece))
    yield from out.flush()


def copies(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(``place``, ``digest``, ``first``) of the payloads that repeat the one at ``first``.

    ``records`` has ``place`` and ``payload``. Of equal payloads of at least ``least`` bytes the
    one with the smallest place is the first; rows that share its place are firsts too, and a row
    without a place follows any that has one.
    """
    small_batches(records.sparkSession)
    sums = store(records.select("place", "payload").mapInArrow(_summed, from_arrow_schema(_SUMS)), "warc-digests")
    sums = sums.where(F.col("payload_bytes") >= least).select("place", "digest")
    firsts = sums.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("_n"))
    # A payload that most records share is met by its broadcast first, not in one task.
    met = attach_by_key(sums, firsts.where("_n > 1 and first is not null"), "digest", "_n", ["place"])
    return met.where("place is null or place > first").select("place", "digest", "first").distinct()


def _bytes(*parts: str | Column) -> Column:
    return F.concat(*[(F.lit(p) if isinstance(p, str) else p).cast("binary") for p in parts])


def _lines(pieces: DataFrame, date: Column) -> DataFrame:
    """What stands before each line feed of the archive, one row a chunk."""
    size, length = F.col("payload_bytes"), F.octet_length("data")
    revisit, several = F.col("refers_to").isNotNull(), size > CHUNK
    chunked = several & ~revisit
    coding = F.when(chunked, F.lit("Transfer-Encoding: chunked")).otherwise(F.concat(F.lit("Content-Length: "), size.cast("string")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), coding, F.lit("\r\n\r\n"))
    rest = size % CHUNK
    framed = F.expr(f"payload_bytes div {CHUNK}") * (len(f"{CHUNK:x}") + 4 + CHUNK) + F.when(rest > 0, F.length(F.hex(rest)) + 4 + rest).otherwise(0) + 5
    block = F.length(http) + F.when(revisit, F.lit(0)).when(several, framed).otherwise(size)

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def angled(value: Column) -> Column:
        return F.concat(F.lit("<"), value, F.lit(">"))

    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", angled(F.coalesce("record_id", F.lit("")))),
        field("WARC-Date", date),
        field("WARC-Target-URI", F.col("uri")),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        field("WARC-Refers-To", angled(F.col("refers_to"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    )
    start = F.when(F.col("chunk") == 0, head).otherwise(F.lit(""))
    opening = F.when(chunked, F.concat(F.lower(F.hex(length)), F.lit("\r\n"))).otherwise(F.lit(""))
    data = F.when(revisit, F.lit(b"")).otherwise(F.col("data"))
    # The line feed itself is added by the writer.
    closing = F.when(chunked & F.col("last"), F.lit("\r\n0\r\n\r\n\r\n\r")).when(chunked, F.lit("\r")).otherwise(F.lit("\r\n\r"))
    return pieces.select(_bytes(start, opening, data, closing).cast("string").alias("value"))


def write(records: DataFrame, path: str, prefix: str = "urn:page:", least: int = LEAST) -> None:
    """Archives of all ``records``: ``place``, ``record_id``, ``uri`` and ``payload`` (text or bytes).

    A record is a response, or a revisit of the first one with its payload (see :func:`copies`),
    whose id is ``prefix`` and that place. A null payload is empty, a null uri is left out, a null id
    is empty; repeated rows are records of their own, an empty table gives archives without a record.
    Payloads move at most once, and only if the revisits are too many to be sent to all tasks.
    """
    small_batches(records.sparkSession)
    revisits = store(copies(records, least), "warc-revisits")
    revisits = revisits.select(F.col("place").alias("_place"), F.col("digest").alias("_digest"), F.concat(F.lit(prefix), "first").alias("refers_to"))
    rows = records.select("place", "record_id", "uri", F.monotonically_increasing_id().alias("row"), "payload")
    pieces = rows.mapInArrow(_cut, from_arrow_schema(_PIECES))
    met = F.col("place").eqNullSafe(F.col("_place")) & (F.col("digest") == F.col("_digest"))
    pieces = pieces.join(revisits, met, "left").where("refers_to is null or chunk = 0").sortWithinPartitions("row", "chunk")
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # One file holds whole records only, whatever the session's limit of rows a file.
    writer = _lines(pieces, date).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", 0)
    writer.text(path)


class Parser:
    """Cuts a stream of bytes into records and their payloads into chunks of at most CHUNK bytes.

    Holds one header or one chunk, never a record. ``feed`` and ``end`` give rows of READ without
    the file; bytes that are no archive, or one that breaks off, raise an error.
    """

    def __init__(self, name: str, data: bool = True):
        self.name, self.data, self.record_no = name, data, -1
        self.buffer, self.state = bytearray(), self._header

    def feed(self, piece: bytes) -> Iterator[tuple]:
        self.buffer += piece
        while True:
            state, held = self.state, len(self.buffer)
            yield from state()
            if self.state == state and len(self.buffer) == held:
                return

    def end(self) -> Iterator[tuple]:
        yield from self.feed(b"")
        if self.buffer.strip(b"\r\n") or self.state != self._header:
            raise ValueError(f"{self.name}: the archive breaks off in record {self.record_no}")

    def _take(self, size: int) -> bytes:
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out

    def _fields(self) -> tuple[str, dict[str, str]] | None:
        """A block of header lines up to the empty one, if it has come whole."""
        end = self.buffer.find(b"\r\n\r\n")
        if end < 0:
            if len(self.buffer) > CHUNK:
                raise ValueError(f"{self.name}: no header ends in {CHUNK} bytes after record {self.record_no}")
            return None
        first, *lines = self._take(end + 4).decode("utf-8", "replace").strip("\r\n").split("\r\n")
        return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    def _header(self) -> Iterator[tuple]:
        while self.buffer[:2] == b"\r\n":
            del self.buffer[:2]
        if len(self.buffer) >= 5 and self.buffer[:5] != b"WARC/":
            raise ValueError(f"{self.name}: no record starts after record {self.record_no}")
        if (found := self._fields()) is None:
            return
        self.record_no += 1
        f = self.fields = found[1]
        self.left = int(f["content-length"])
        self.digest, self.size, self.chunk, self.full = sha256(), 0, 0, None
        self.state = self._http if "application/http" in f.get("content-type", "") else self._body
        yield from ()

    def _http(self) -> Iterator[tuple]:
        held = len(self.buffer)
        if held < self.left and b"\r\n\r\n" not in self.buffer:
            self._fields()
            return
        first, fields = self._fields()
        self.left -= held - len(self.buffer)
        self.full = int(fields["content-length"]) if "content-length" in fields else None
        self.state = self._sized if fields.get("transfer-encoding", "").lower() == "chunked" else self._body
        yield from ()

    def _row(self, piece: bytes, last: bool) -> tuple:
        f = self.fields
        self.digest.update(piece)
        self.size += len(piece)
        kind, stated = f.get("warc-type"), f.get("warc-payload-digest", "")
        stated = stated.removeprefix("sha256:") if stated.startswith("sha256:") else None
        size, digest = (self.full, stated) if kind == "revisit" else (self.size, self.digest.copy().hexdigest())
        names = [f.get(k, "").strip("<>") or None for k in ("warc-target-uri", "warc-refers-to")]
        row = (self.record_no, f.get("warc-record-id", "").strip("<>"), kind, *names, stated, self.chunk, last, piece if self.data else None, size, digest)
        self.chunk += 1
        return row

    def _body(self) -> Iterator[tuple]:
        """The rest of the block, or what fills a chunk."""
        while self.left > CHUNK and len(self.buffer) >= CHUNK:
            self.left -= CHUNK
            yield self._row(self._take(CHUNK), False)
        if self.left <= CHUNK and len(self.buffer) >= self.left:
            yield self._row(self._take(self.left), True)
            self.state = self._header

    def _sized(self) -> Iterator[tuple]:
        """The line with the size of the next piece of a chunked body."""
        end = self.buffer.find(b"\r\n")
        if end < 0:
            return
        self.piece = int(self._take(end + 2).split(b";")[0], 16)
        self.left -= end + 2
        self.state = self._piece if self.piece else self._trailer
        yield from ()

    def _piece(self) -> Iterator[tuple]:
        """A piece of any size, in chunks; a full one and the empty last piece may both end the body."""
        while self.piece > CHUNK and len(self.buffer) >= CHUNK:
            self.piece, self.left = self.piece - CHUNK, self.left - CHUNK
            yield self._row(self._take(CHUNK), False)
        if self.piece <= CHUNK and len(self.buffer) >= self.piece + 2:
            self.left -= self.piece + 2
            piece = self._take(self.piece)
            del self.buffer[:2]
            # What is left of the block says whether another piece follows the empty one's five bytes.
            yield self._row(piece, self.left == 5)
            self.state = self._sized

    def _trailer(self) -> Iterator[tuple]:
        if len(self.buffer) < self.left:
            return
        open_ = self.chunk == 0 or self.left != 2
        self._take(self.left)
        self.state = self._header
        if open_:  # an empty body, or one with trailing fields: no piece was marked as the last
            yield self._row(b"", True)


def read(spark: SparkSession, path: str, data: bool = True) -> DataFrame:
    """The chunks (READ) of all records below ``path``; without ``data`` only the last of each record.

    Archives are gzip files, of one member or one a record, and each is read by one task in
    order, a line at a time. An uncompressed archive has to fit into one input split.
    """
    small_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, parser = _Batches(READ), None

        def kept(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for row in rows:
                if data or row[7]:
                    yield from out.add((parser.name, *row), len(row[8] or b""))

        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if parser is None or parser.name != file:
                    if parser is not None:
                        yield from kept(parser.end())
                    parser = Parser(file, data)
                yield from kept(parser.feed(line.as_py() + b"\n"))
        if parser is not None:
            yield from kept(parser.end())
        yield from out.flush()

    return lines.mapInArrow(parsed, from_arrow_schema(READ))


def records(chunks: DataFrame) -> DataFrame:
    """One row a record, without its data: the last chunk carries the whole size and digest.

    A payload that differs from the digest its record states raises an error.
    """
    checked = F.when(F.col("stated_digest") != F.col("digest"), F.raise_error(F.concat(F.lit("damaged payload: "), "record_id")).cast("string"))
    return chunks.where("last").withColumn("digest", F.coalesce(checked, "digest")).drop("chunk", "last", "data", "stated_digest")
