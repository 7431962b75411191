"""Packed blocks of integers, dealt by segment, and files of arrays.

Tasks that handle hundreds of millions of small keys pass them on as one
compressed block for each segment instead of one row for each key.  The task
that owns a segment merges its blocks and writes a file into the shared folder;
other tasks map such files into memory.  A repeated task overwrites a file with
the same bytes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spans_of_equal

U = np.uint64
BLOCK = "kind string, segment int, block binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x.astype(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Masks that leave the first 0 to 8 bytes of a little-endian word.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Longer pieces are hashed one by one.
_LONG_PIECE = 1024


def piece_hashes(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of a byte array that has eight bytes to spare at its end.

    A piece is taken eight bytes at a time, all pieces side by side; a hash
    depends on the bytes of its piece alone.
    """
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = mix(sizes.astype(U) + U(0x9E3779B97F4A7C15))
    live = np.arange(len(starts))
    if len(sizes) and int(sizes.max()) > _LONG_PIECE:
        long = sizes > _LONG_PIECE
        for k in np.flatnonzero(long).tolist():
            out[k] = xxhash.xxh64_intdigest(padded[starts[k] : starts[k] + sizes[k]].tobytes())
        live = np.flatnonzero(~long)
    at, rest = starts[live], sizes[live]
    while len(live):
        part = words[at] & _FIRST_BYTES[np.minimum(rest, 8)]
        out[live] = mix(out[live] ^ part)
        more = np.flatnonzero(rest > 8)
        live, at, rest = live[more], at[more] + 8, rest[more] - 8
    return out


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit integers as one block; best if the first is sorted.

    Each column keeps only the bytes that its largest value needs.
    """
    widths, parts = [], []
    for i, c in enumerate(columns):
        c = np.ascontiguousarray(c).astype(U)
        c = np.diff(c, prepend=U(0)) if i == 0 else c
        widths.append(max(1, -(-int(c.max()).bit_length() // 8)) if len(c) else 1)
        parts.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T[: widths[-1]]).tobytes())
    return zstd.ZstdCompressor(level=1).compress(bytes(widths) + b"".join(parts))


def unpack(block: bytes, columns: int) -> list[np.ndarray]:
    data = np.frombuffer(zstd.ZstdDecompressor().decompress(block), np.uint8)
    widths = data[:columns].tolist()
    n = (len(data) - columns) // sum(widths)
    out, at = [], columns
    for i, width in enumerate(widths):
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = data[at : at + width * n].reshape(width, n).T
        at += width * n
        c = c.view(U).reshape(-1)
        out.append(np.cumsum(c, dtype=U) if i == 0 else c)
    return out


def merged(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys in order with the sums of their values."""
    k = np.concatenate(keys) if keys else np.zeros(0, U)
    order = np.argsort(k, kind="stable")
    k = k[order]
    cuts = spans_of_equal(k)[:-1]
    sums = [np.add.reduceat(np.concatenate(v)[order], cuts) if len(cuts) else np.zeros(0, np.int64) for v in values]
    return k[cuts], *sums


def block_rows(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kind, segment, block = zip(*rows) if rows else ([], [], [])
    return pa.record_batch([pa.array(kind, pa.string()), pa.array(segment, pa.int32()), pa.array(block, pa.binary())], ["kind", "segment", "block"])


def owned(blocks: DataFrame, segments: int) -> DataFrame:
    """All blocks of a segment in a task of its own; segment -1 joins the last."""
    return blocks.select("kind", "segment", "block").repartitionById(segments, F.pmod("segment", F.lit(segments))).sortWithinPartitions("segment")


def by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
    now, held = None, []
    for batch in batches:
        for kind, segment, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if segment != now and held:
                yield now, held
                held = []
            now = segment
            held.append((kind, block))
    if held:
        yield now, held


def narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values


def write_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """A file of arrays behind a JSON header, put in place whole by a rename."""
    from pyarrow import fs

    head, at = [], 0
    for a in arrays:
        head.append([a.dtype.str, len(a), at])
        at += -(-a.nbytes // 8) * 8
    header = json.dumps(head).encode()
    header += b" " * (-len(header) % 8)
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(len(header).to_bytes(8, "little") + header)
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    system.move(part, path)


#: Bytes of files that a worker keeps where they can't be mapped into memory.
KEPT_BYTES = 256 << 20


class OpenFiles:
    """Files of arrays by address: mapped ones stay open, others as long as there is room."""

    def __init__(self) -> None:
        self.held: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def __getstate__(self):
        return {"held": {}, "size": 0}

    def get(self, uri: str) -> list[np.ndarray]:
        found = self.held.pop(uri, None)
        if found is None:
            found = read_arrays(uri)
            self.size += _bytes_in_memory(found)
        self.held[uri] = found  # the last used stands last
        while self.size > KEPT_BYTES and len(self.held) > 1:
            self.size -= _bytes_in_memory(self.held.pop(next(iter(self.held))))
        return found


def _bytes_in_memory(arrays: list[np.ndarray]) -> int:
    return sum(a.nbytes for a in arrays if not isinstance(a, np.memmap))


def read_arrays(uri: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory where the file system allows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with system.open_input_stream(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    body = raw[8 + size :]
    return [body[at : at + n * np.dtype(kind).itemsize].view(kind) for kind, n, at in json.loads(raw[8 : 8 + size].tobytes())]


def remove(uri: str) -> None:
    """Delete a folder of files that nothing reads any more."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def over_segments(spark: SparkSession, segments: int, fn: Callable[[int], list], schema: str, names: list[str]) -> DataFrame:
    """Rows that ``fn(k)`` gives, for each segment k in a task of its own."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows = fn(k)
                cols = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return spark.range(0, segments, 1, segments).mapInArrow(run, schema)
