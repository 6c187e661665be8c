"""WARC archives written and read as a chunked record table.

A payload is a run of rows (record identifier, chunk number), each of bounded size and each carrying
the digest of the payload up to its own end. In the archive a chunk is one WARC segment: the first
is the ``response`` record, the others are its ``continuation`` records. Neither side joins the
chunks of a payload: the writer digests chunk after chunk, the reader too, and the reader keeps at
most one chunk.

Archives are written by Spark's text writer, one record per line with the record terminator as the
line separator, and gzip-compressed, which makes a file one unsplit stream of records. Its commit
protocol makes a lost task leave nothing behind. They are read by Spark's text reader, so they can
be in any store that Spark reaches.

Equal payloads: one aggregate over digests, combined before its shuffle, finds the largest key of each
repeated payload; no task ever holds the rows of a group.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.shared import cut, work_folder

CRLF, END = b"\r\n", b"\r\n\r\n"
CHUNK_BYTES = 1 << 16
MIN_REVISIT_BYTES = 1000
FILE_BYTES = 1 << 30
MAX_BROADCAST_GROUPS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEME = "urn:x-record:"


def decide(pages: DataFrame, key: str, url: str, body: str, least: int) -> DataFrame:
    """Each page's payload, digest and, for a repeated payload, the largest key that has it."""
    payload = F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("_key"), F.col(url).cast("string").alias("_url"),
                        payload.alias("_payload"), F.sha1(payload).alias("_digest"))
    size = F.octet_length("_payload")
    groups = cut(rows.where(size >= least).groupBy("_digest", size.alias("_size"))
                 .agg(F.max("_key").alias("_owner"), F.count("*").alias("_n"))
                 .where("_n > 1").drop("_n"))
    if groups.count() <= MAX_BROADCAST_GROUPS:  # 60 bytes each; more go through a shuffled join
        groups = F.broadcast(groups)
    owned = rows.withColumn("_size", size).join(groups, ["_digest", "_size"], "left")
    return owned.select("_key", "_url", "_payload", "_digest", F.when(
        (F.col("_owner") > F.col("_key")) | F.col("_key").isNull(), F.col("_owner")).alias("_refers"))


def spread(rows: DataFrame, pages: DataFrame, body: str, most: int) -> DataFrame:
    """``rows`` dealt anew where a partition of ``pages`` holds more than ``most`` bytes of payload.

    A task writes one file: a record is never divided over files. A page counts as a row of average
    size, and one beyond ``most`` still is in one file.
    """
    held = (pages.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length(body)).alias("_held"))
            .agg(F.max("_held"), F.sum("_held")).first())
    return rows.repartition(-(-held[1] // most)) if (held[0] or 0) > most else rows


def _name(key: int | None) -> bytes:
    return f"<{SCHEME}{'' if key is None else key}>".encode()


def _head(fields: list[tuple[bytes, bytes]]) -> bytes:
    return b"WARC/1.1" + b"".join(CRLF + k + b": " + v for k, v in fields) + END


def segments(key: int | None, url: str | None, payload: memoryview, digest: str,
             refers: int | None, chunk: int, date: bytes) -> Iterator[bytes]:
    """The records of one page, each without its terminator."""
    common = [(b"WARC-Date", date), (b"Content-Type", b"text/html")]
    if url:
        common.append((b"WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A").encode()))
    full = [(b"WARC-Payload-Digest", b"sha1:" + digest.encode()),
            (b"WARC-Payload-Length", str(len(payload)).encode())]
    if refers is not None:
        yield _head([(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", _name(key)),
                     (b"WARC-Refers-To", _name(refers)), (b"WARC-Profile", PROFILE.encode()),
                     *common, *full, (b"Content-Length", b"0")])
        return
    running = hashlib.sha1(usedforsecurity=False)
    count = max(1, -(-len(payload) // chunk))
    for k in range(count):
        part = payload[k * chunk:(k + 1) * chunk]
        running.update(part)
        own = [(b"WARC-Chunk-Digest", b"sha1:" + running.hexdigest().encode()),
               (b"WARC-Segment-Number", str(k + 1).encode()),
               (b"Content-Length", str(len(part)).encode())]
        if k == 0:
            kind = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", _name(key)), *full]
        else:
            kind = [(b"WARC-Type", b"continuation"), (b"WARC-Segment-Origin-ID", _name(key)),
                    (b"WARC-Record-ID", _name(key)[:-1] + f"/{k + 1}>".encode())]
        if k == count - 1:
            own.append((b"WARC-Segment-Total-Length", str(len(payload)).encode()))
        yield _head([*kind, *common, *own]) + part


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html",
          chunk: int = CHUNK_BYTES, least: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per page; a repeated payload of ``least`` bytes or more is stored once.

    The page with the largest key among equal payloads is the response, the others are revisits that
    refer to it. Rows repeated with that largest key are responses all. An absent key counts as the
    smallest; where no row of the group has a key, all are responses. An absent body is an empty
    payload. An empty table gives archives without records. Other columns are not carried. A file holds
    whole records, about ``file_bytes`` of payload at most.
    """
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ").encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for k, u, p, d, r in zip(*batch.columns, strict=True):
                payload = memoryview(p.as_buffer())
                for record in segments(k.as_py(), u.as_py(), payload, d.as_py(), r.as_py(),
                                       chunk, date):
                    out.append(record)
                    held += len(record)
                    if held > 64 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    decided = spread(decide(pages, key, url, body, least), pages, body, file_bytes)
    (decided.mapInArrow(run, "value binary")
     .select(F.col("value").cast("string")).write.mode("overwrite")
     .option("lineSep", END.decode()).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", 0).text(folder))


class Reader:
    """Takes an archive piece by piece and gives its chunk rows.

    A row: record id, chunk number, last, record type, refers to, bytes so far, digest so far, data.
    Raises ``ValueError`` when a stored digest or length differs from what was read.
    """

    def __init__(self, keep: bool = False):
        self.keep = keep
        self.buffer = bytearray()
        self.fields: dict[bytes, bytes] | None = None
        self.left = 0
        self.data: list[bytes] = []
        self.origin: dict[bytes, bytes] = {}
        self.digest = hashlib.sha1(usedforsecurity=False)
        self.size = 0

    def feed(self, piece: bytes) -> Iterator[tuple]:
        self.buffer += piece
        while True:
            if self.fields is None:
                start = 0
                while self.buffer[start:start + 2] == CRLF:
                    start += 2
                at = self.buffer.find(END, start)
                if at < 0:
                    return
                self._begin(bytes(self.buffer[start:at]))
                del self.buffer[:at + 4]
            taken = bytes(self.buffer[:self.left])
            del self.buffer[:len(taken)]
            self.left -= len(taken)
            self.size += len(taken)
            self.digest.update(taken)
            if self.keep and taken:
                self.data.append(taken)
            if self.left:
                return
            yield self._end()

    def _begin(self, head: bytes) -> None:
        first, *lines = head.split(CRLF)
        if first != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:60]!r}")
        self.fields = dict(line.split(b": ", 1) for line in lines)
        self.left = int(self.fields[b"Content-Length"])
        if self.fields[b"WARC-Type"] != b"continuation":
            self.origin = self.fields
            self.digest = hashlib.sha1(usedforsecurity=False)
            self.size = 0

    def _end(self) -> tuple:
        own, first = self.fields, self.origin
        self.fields = None
        name = lambda x: int(x) if (x := x[len(SCHEME) + 1:-1]) else None
        kind = first[b"WARC-Type"].decode()
        if kind == "revisit":
            return (name(first[b"WARC-Record-ID"]), 0, True, kind, name(first[b"WARC-Refers-To"]),
                    int(first[b"WARC-Payload-Length"]),
                    first[b"WARC-Payload-Digest"].partition(b":")[2].decode(), b"")
        so_far = self.digest.hexdigest()
        last = b"WARC-Segment-Total-Length" in own
        stored = [own[b"WARC-Chunk-Digest"]] + [first[b"WARC-Payload-Digest"]] * last
        if any(x != b"sha1:" + so_far.encode() for x in stored) or (
                last and int(first[b"WARC-Payload-Length"]) != self.size):
            raise ValueError(f"damaged record {first[b'WARC-Record-ID']!r}")
        data, self.data = b"".join(self.data), []
        return (name(first[b"WARC-Record-ID"]), int(own[b"WARC-Segment-Number"]) - 1, last, kind,
                None, self.size, so_far, data)

    def close(self) -> None:
        if self.fields is not None or self.buffer.strip(CRLF):
            raise ValueError("the archive ends within a record")


CHUNK_SCHEMA = ("record_id long, chunk int, is_last boolean, record_type string, refers_to long, "
                "bytes_so_far long, digest_so_far string, data binary")
CHUNK_TYPES = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(),
               pa.binary()]


def read(spark: SparkSession, folder: str, with_data: bool = False) -> DataFrame:
    """The chunk rows of every archive in ``folder``, each checked against its stored digest.

    Chunks of a record are numbered from 0; the last one's ``bytes_so_far`` and ``digest_so_far``
    are the payload's. A revisit is one row with the length and digest of the payload it refers to.
    """
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current = Reader(with_data), None
        for batch in batches:
            out = []
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file != current:
                    reader.close()
                    reader, current = Reader(with_data), file
                out.extend(reader.feed(piece.as_py() + END))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, CHUNK_TYPES, strict=True)], names)
        reader.close()

    stored = spark.read.option("lineSep", END.decode()).text(folder)
    return stored.select(F.col("_metadata.file_name").alias("file"),
                         F.col("value").cast("binary")).mapInArrow(run, CHUNK_SCHEMA)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html",
               chunk: int = CHUNK_BYTES, folder: str | None = None) -> DataFrame:
    """Write the archives, read them back, and give one row per page."""
    folder = folder or f"{work_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, key, url, body, chunk)
    return read(pages.sparkSession, folder).where("is_last").select(
        F.col("record_id").alias(key), F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
