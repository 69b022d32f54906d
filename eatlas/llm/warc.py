"""Web archives (WARC 1.1) written from pages and read back, a chunk of a payload at a time.

Payloads are tables of chunks: (record, part, data), where an ordinary page is
one row and an oversized one as many as it takes. Each row carries the length
and the digest of the payload up to its end, so the last row has those of the
whole payload and no task but the one that scans the page ever holds it.

An archive is written by Spark's own text sink with CRLF as its line end: the
payload of a response is sent in chunks (``Transfer-Encoding: chunked``), whose
framing ends every chunk with CRLF. Headers go in front of the first chunk,
with a length that follows from the payload's; records with the payload of
another one are revisits of it, without a payload. Archives are compressed as a
whole, so a reader gets every file from its start, line by line; it takes the
chunks out of their frames and computes the digests anew. Both sides use Spark's
file systems only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import materialize, stored_folder
from .common import RowBuffer, blocks_for, rows_of

CHUNK = 1 << 14
# Payloads with fewer bytes are always written out.
LEAST = 1000
# Bytes of payload in one archive, about.
FILE_BYTES = 32 << 20
# Bytes of chunks handed over at once.
_BATCH_BYTES = 8 << 20

_END = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CHUNKS = pa.schema(
    [("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("part", pa.int64()), ("data", pa.binary())]
    + [("bytes", pa.int64()), ("digest", pa.string()), ("second_digest", pa.string()), ("last", pa.bool_())]
)
_CHUNKS_DDL = "record bigint, page_id bigint, url string, part bigint, data binary, bytes bigint, digest string, second_digest string, last boolean"


def chunk_table(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of at most ``chunk`` bytes of the pages' html; an empty or null one is one empty chunk.

    ``bytes``, ``digest`` (SHA-1) and ``second_digest`` (XXH3) run up to the
    end of the row's chunk. Record numbers differ from run to run; store the
    table before it is used twice.
    """

    def run(batches):
        part_of_table = TaskContext.get().partitionId()
        record, size, first, second, held, out = (part_of_table << 40) - 1, 0, None, None, 0, RowBuffer(_CHUNKS)
        for page_id, url, part, last, data in rows_of(batches, "page_id", "url", "part", "last", "data"):
            if part == 0:
                record, size, first, second = record + 1, 0, hashlib.sha1(usedforsecurity=False), xxhash.xxh3_128()
            first.update(data)
            second.update(data)
            size, held = size + len(data), held + len(data)
            full = out.add(record, page_id, url, part, data, size, first.hexdigest(), second.hexdigest(), last)
            if full or held >= _BATCH_BYTES:
                yield from out.flush()
                held = 0
        yield from out.flush()

    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    whole = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    parts = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk)).cast("bigint")
    cut = whole.select("page_id", "url", "payload", parts.alias("parts"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    data = F.substring("payload", (F.col("part") * chunk + 1).cast("int"), F.lit(chunk))
    rows = cut.select("page_id", "url", "part", (F.col("part") == F.col("parts") - 1).alias("last"), data.alias("data"))
    return rows.mapInArrow(run, _CHUNKS_DDL)


def records(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """(record, page_id, url, bytes, digest, refers_to) of a stored chunk table.

    Of the records with one payload of ``least`` bytes or more, that with the
    largest page_id is written out and the others refer to it; of several rows
    of that page_id, the one with the largest record number.
    """
    same = ["digest", "second_digest", "bytes"]
    totals = chunks.where("last").select("record", "page_id", "url", *same)
    first = totals.where(F.col("bytes") >= least).groupBy(*same).agg(F.max(F.struct("page_id", "record")).alias("_kept"), F.count("*").alias("_n"))
    marked = totals.join(first.where("_n > 1").drop("_n"), same, "left")
    refers = F.when(F.col("_kept.record") != F.col("record"), F.col("_kept.record"))
    return marked.select("record", "page_id", "url", "bytes", "digest", refers.alias("refers_to"))


def _urn(record: Column, name: str) -> Column:
    """An URI for a record number of the archives ``name``."""
    hashed = F.md5(F.concat(F.lit(f"{name} "), record.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hashed, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5"), F.lit(">"))


def _header(name: str, date: str, chunk: int) -> Column:
    """The header of a record, with the line end behind each line and the empty line."""

    def line(key: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{key}: "), value if isinstance(value, Column) else F.lit(value), F.lit(_END))

    def framed(size: Column) -> Column:
        return F.length(F.hex(size)) + 2 * len(_END) + size

    revisit = F.col("refers_to").isNotNull()
    full, rest = F.floor(F.col("bytes") / chunk), F.col("bytes") % chunk
    body = full * framed(F.lit(chunk).cast("bigint")) + F.when(rest > 0, framed(rest)).otherwise(0)
    length = F.when(revisit, F.lit(0)).otherwise(body + len(_HTTP) + len("0\r\n\r\n")).cast("string")
    # White space and control characters cannot stand in a header.
    uri = F.col("url")
    for code in (*range(33), 127):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("record"), name)),
        line("WARC-Date", date),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(line("WARC-Refers-To", _urn(F.col("refers_to"), name)), F.lit("")),
        F.when(revisit, line("WARC-Profile", _PROFILE)).otherwise(F.lit("")),
        line("Content-Type", "application/http;msgtype=response"),
        line("Content-Length", length),
        F.lit(_END),
    )


def write_archives(
    pages: DataFrame, folder: str, chunk: int = CHUNK, least: int = LEAST, file_bytes: int = FILE_BYTES, date: str = "2020-01-01T00:00:00Z"
) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) into compressed archives in ``folder``.

    ``folder`` must not exist yet. A null html is an empty payload, a null
    page_id or url has no header; white space in addresses is escaped. Repeated
    rows are records of their own; other columns are ignored. Of a payload of
    any length, tasks hold single chunks; its record stands in one archive.
    """
    spark = pages.sparkSession
    stored = f"{stored_folder(spark)}/{uuid.uuid4().hex}"
    table = chunk_table(pages, chunk)
    table.write.option("compression", "zstd").parquet(stored)
    chunks = spark.read.schema(table.schema).parquet(stored)
    files = blocks_for(chunks.select("last", "bytes").where("last"), F.col("bytes") + 1, file_bytes)
    marked = records(chunks, least).select("record", "refers_to", F.col("bytes").alias("_size"), F.col("digest").alias("_digest"), "page_id", "url")
    placed = chunks.select("record", "part", "data", "last").repartition(files, "record").join(marked.repartition(files, "record"), "record")
    first, revisit = F.col("part") == 0, F.col("refers_to").isNotNull()
    renamed = placed.where(first | ~revisit).withColumnsRenamed({"_size": "bytes", "_digest": "digest"})
    empty = F.octet_length("data") == 0
    frame = F.when(~empty, F.concat(F.hex(F.octet_length("data")).cast("binary"), F.lit(_END).cast("binary"), F.col("data")))
    # The sink adds the line end that closes a chunk, or the last one of a record.
    behind = F.when(F.col("last"), F.when(empty, F.lit("0\r\n\r\n\r\n")).otherwise(F.lit("\r\n0\r\n\r\n\r\n"))).otherwise(F.lit(""))
    body = F.concat(F.lit(b""), F.coalesce(frame, F.lit(b"")), behind.cast("binary"))
    head = _header(uuid.uuid4().hex, date, chunk)
    value = F.concat(
        F.when(first, F.concat(head, F.when(revisit, F.lit(_END)).otherwise(F.lit(_HTTP)))).otherwise(F.lit("")).cast("binary"),
        F.when(revisit, F.lit(b"")).otherwise(body),
    )
    lines = renamed.sortWithinPartitions("record", "part").select(value.cast("string").alias("value"))
    lines.write.option("lineSep", _END).option("compression", "gzip").text(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class _Lines:
    """Lines of an archive, read as lines or as given numbers of bytes."""

    def __init__(self, lines: Iterator[bytes]):
        self.lines, self.rest, self.ended = lines, b"", True

    def line(self) -> bytes | None:
        """What is left of the current line, or the next one; None at the end."""
        if self.ended:
            return next(self.lines, None)
        self.ended = True
        return self.rest

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, line ends included."""
        while size:
            if self.ended:
                line = next(self.lines, None)
                if line is None:
                    raise ValueError("an archive ends inside a record")
                self.rest, self.ended = line, False
            piece, self.rest = self.rest[:size], self.rest[size:]
            size -= len(piece)
            if piece:
                yield piece
            if size:
                if size < 2:
                    raise ValueError("a block ends inside a line end")
                size -= 2
                self.ended = True
                yield b"\r\n"


def _headers(lines: _Lines) -> tuple[dict[str, str], int]:
    """Header lines up to the empty one, and how many bytes they take."""
    found, size = {}, 2
    while line := lines.line():
        name, _, value = line.partition(b":")
        found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        size += len(line) + 2
    return found, size


def _payload(lines: _Lines, headers: dict[str, str]) -> Iterator[bytes]:
    """The payload of a record in pieces: the body of an HTTP message, else the block."""
    left = int(headers.get("content-length", "0"))
    if left and headers.get("content-type", "").startswith("application/http"):
        http, size = _headers(lines)
        left -= size
        if "chunked" in http.get("transfer-encoding", "").lower():
            while True:
                line = lines.line()
                if line is None:
                    raise ValueError("an archive ends inside a record")
                size = int(line.partition(b";")[0], 16)
                left -= len(line) + size + 4
                yield from lines.pieces(size)
                lines.line()
                if not size:
                    break
            if left:
                raise ValueError("the chunks of a payload are not as long as its record says")
            return
    yield from lines.pieces(left)


def _rechunked(pieces: Iterator[bytes], chunk: int) -> Iterator[bytes]:
    """``pieces`` as chunks of ``chunk`` bytes; the last may be shorter, an empty payload is one empty chunk."""
    held, size, some = [], 0, False
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        while size >= chunk:
            joined = b"".join(held)
            yield joined[:chunk]
            held, size, some = [joined[chunk:]], size - chunk, True
    if size or not some:
        yield b"".join(held)


_READ = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.string())]
    + [("part", pa.int64()), ("data", pa.binary()), ("bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())]
)
_READ_DDL = (
    "record_id string, record_type string, page_id bigint, url string, refers_to string, part bigint, data binary, bytes bigint, digest string, last boolean"
)


def read_archives(spark: SparkSession, folder: str, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``folder`` as a chunk table.

    ``bytes`` and ``digest`` run up to the end of the row's chunk. A revisit is
    one row with the digest that its header gives and no data. Without
    ``payloads`` only the last row of each record comes, without data. A
    payload that does not have the digest of its header is an error. Archives
    are compressed files whose lines are not much longer than a chunk, or
    uncompressed ones that are read in one piece.
    """

    def run(batches):
        out, held = RowBuffer(_READ), 0
        lines = _Lines(line for (line,) in rows_of(batches, "value"))
        while (line := lines.line()) is not None:
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"a record begins with {line[:40]!r}")
            headers, _ = _headers(lines)
            kind, page = headers.get("warc-type"), headers.get("x-page-id")
            known = (headers.get("warc-record-id"), kind, None if page is None else int(page), headers.get("warc-target-uri"), headers.get("warc-refers-to"))
            said = headers.get("warc-payload-digest")
            if kind == "revisit":
                for _ in _payload(lines, headers):
                    pass
                if out.add(*known, 0, None, None, said.partition(":")[2] if said else None, True):
                    yield from out.flush()
                continue
            running, size, part, before = hashlib.sha1(usedforsecurity=False), 0, 0, None
            for data in _rechunked(_payload(lines, headers), chunk):
                if before is not None and payloads:
                    if out.add(*known, *before, False) or held >= _BATCH_BYTES:
                        yield from out.flush()
                        held = 0
                running.update(data)
                size, held = size + len(data), held + (len(data) if payloads else 0)
                before = (part, data if payloads else None, size, running.hexdigest())
                part += 1
            if said and said.startswith("sha1:") and said != f"sha1:{before[3]}":
                raise ValueError(f"the payload of {known[0]} does not have its digest")
            if out.add(*known, *before, True) or held >= _BATCH_BYTES:
                yield from out.flush()
                held = 0
        yield from out.flush()

    lines = spark.read.option("lineSep", _END).text(folder).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, _READ_DDL)


def archive_digest(pages: DataFrame, chunk: int = CHUNK, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives of ``pages``, as they are read back.

    Length and digest are those of the full payload, for a revisit those of the
    record that it refers to, whose page_id is ``refers_to``. Nulls, repeated
    rows and other columns as in :func:`write_archives`.
    """
    spark = pages.sparkSession
    folder = f"{stored_folder(spark)}/{uuid.uuid4().hex}"
    write_archives(pages, folder, chunk, least, file_bytes)
    found = materialize(read_archives(spark, folder, chunk, payloads=False).select("record_id", "record_type", "page_id", "refers_to", "bytes", "digest"))
    whole = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("bytes").alias("_bytes"))
    return found.join(whole, "refers_to", "left").select(
        "page_id",
        F.coalesce("bytes", "_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("_page").alias("refers_to"),
    )
