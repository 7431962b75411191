"""Dictionary-compressed WARC archives, written and read by the executors.

An archive is a ``.warc.zst`` file: a Zstandard skippable frame that holds a
dictionary built from the archive's own records, then one frame per WARC record,
compressed with that dictionary.  Records whose payload an earlier page has
already become revisit records that carry no payload.

A task writes archives of bounded size into the shared folder under names of
its own attempt, and the table of archives is written only from attempts that
ended well.  A task that is run again leaves an orphan file that no table names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, scratch_path, stash, utf8_values

#: Fixed values of the formats.
SKIPPABLE_MAGIC = (0x184D2A5D).to_bytes(4, "little")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
#: The dictionary's size, and the bytes of evenly spread records it is built from.
DICTIONARY_BYTES = 112 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 6
_READ = 1 << 16
_ID = "urn:page:"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str
) -> bytes:
    """One record with its two closing line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    record_id = f"{_ID}{page_id}" if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{url}#{digest}").urn
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_of(value: str | None) -> int | None:
    text = (value or "").strip("<>")
    return int(text[len(_ID) :]) if text.startswith(_ID) else None


def parse_record(record: bytes) -> dict:
    """Fields of a record; the payload of a response is checked against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": _page_of(fields.get("WARC-Refers-To")),
    }


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from evenly spread records.

    At least 8 records are sampled, and all of them where these can't train one.
    Where all can't either, being too few or too short, the beginnings of the
    records are the dictionary as they are, an eighth of their bytes at most.
    """
    total = sum(map(len, records))
    step = max(1, min(-(-total // SAMPLE_BYTES), len(records) // 8))
    for stride in dict.fromkeys((step, 1)):
        samples = [r[:131_072] for r in records[::stride]]
        size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
        if len(samples) < 8 or size < 1024:
            continue
        try:
            return zstd.train_dictionary(size, samples).as_bytes()
        except zstd.ZstdError:
            continue
    each = DICTIONARY_BYTES // max(1, len(records)) + 1
    return b"".join(r[:each] for r in records)[: min(DICTIONARY_BYTES, total // 8)]


def write_archive(stream, records: list[bytes]) -> None:
    """The dictionary in a leading skippable frame, then a frame for each record."""
    dictionary = build_dictionary(records)
    stream.write(SKIPPABLE_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary)
    how = {"dict_data": zstd.ZstdCompressionDict(dictionary)} if dictionary else {}
    compressor = zstd.ZstdCompressor(level=LEVEL, write_checksum=True, **how)
    for record in records:
        stream.write(compressor.compress(record))


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    if stream.read(4) != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    size = int.from_bytes(stream.read(4), "little")
    dictionary = stream.read(size)
    how = {"dict_data": zstd.ZstdCompressionDict(dictionary)} if dictionary else {}
    decompressor = zstd.ZstdDecompressor(**how)
    rest = stream.read(_READ)
    while rest:
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(_READ)):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)
        rest = rest or stream.read(_READ)


def _open(uri: str, mode: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system.open_input_stream(path, buffer_size=_READ)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``pages`` rows with ``first``, the page that holds the same payload first.

    ``first`` is null for payloads that are alone or too small.  Copies are
    counted by digest, and the table of repeated digests is written before the
    join, so that its true size decides whether it is broadcast.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    copies = (
        rows.where(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return rows.join(stash(copies, "copies"), "digest", "left")


def write_archives(
    pages: DataFrame,
    min_revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
    folder: str | None = None,
) -> DataFrame:
    """Archive every row of ``pages``; returns ``(archive, records, raw_bytes)``.

    Null html is an empty payload.  Null urls are left out of the record.  Rows
    without a page_id, and rows repeated under the id that holds a payload
    first, are responses.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, done = uuid.uuid4().hex, []
        records: list[bytes] = []
        size = 0

        def close() -> None:
            nonlocal records, size
            if records:
                name = f"{folder}/{attempt}-{len(done):05d}.warc.zst"
                with _open(name, "w") as stream:
                    write_archive(stream, records)
                done.append((name, len(records), size))
            records, size = [], 0

        for batch in batches:
            for page, url, payload, first in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_values(batch.column(2)), batch.column(3).to_pylist()
            ):
                revisit = page is not None and first is not None and page != first
                record = warc_record(page, url, payload, sha1_base32(payload), first, revisit, date)
                records.append(record)
                size += len(record)
                if size >= archive_bytes:
                    close()
        close()
        cols = list(zip(*done)) if done else [[], [], []]
        yield pa.record_batch(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["archive", "records", "raw_bytes"]
        )

    planned = plan_records(pages, min_revisit_bytes)
    return stash(arrow_map(planned, ["page_id", "url", "html", "first"], run, "archive string, records long, raw_bytes long"), "archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives, payload included on request."""
    names = archives.select("archive")
    spread = names.repartition(max(1, names.count()))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    if payloads:
        schema, fields, types = schema + ", payload binary", [*fields, "payload"], [*types, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _open(name, "r") as stream:
                    rows: list[dict] = []
                    for record in read_archive(stream):
                        rows.append(parse_record(record))
                        if len(rows) == 512:
                            yield pa.record_batch([pa.array([r[f] for r in rows], t) for f, t in zip(fields, types)], fields)
                            rows = []
                    yield pa.record_batch([pa.array([r[f] for r in rows], t) for f, t in zip(fields, types)], fields)

    return spread.mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages`` and read them back, without payloads."""
    return read_archives(write_archives(pages, min_revisit_bytes))
