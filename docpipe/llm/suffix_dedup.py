"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

1. Every text is cut into phrases at content-defined places: the minima of a
   4-byte hash over 48 neighbouring places.  Two occurrences of one string of
   ``LENGTH`` = 200 bytes are cut alike in their inner 102 bytes, which hold a
   whole phrase at least, so a phrase that the corpus has once lies in no
   repeated string.
2. Runs of repeated phrases are gathered, equal runs once.  The suffixes of
   their phrase sequences are sorted by the difference cover {1, 2} modulo 3:
   triples at sampled places are sorted and named, the names are sorted by
   recursion, and the remaining suffixes are merged in by (phrase, rank of the
   next suffix).  The recursion ends once names reach beyond any string of 248
   bytes.  Adjacent suffixes are compared, which gives each phrase the longest
   match that starts with it.
3. A match decides most strings of 200 bytes: within it they are repeated, and
   strings whose inner phrases no match covers are not.  What is left, strings
   that reach over the ends of a match, is decided by comparing their 128-bit
   fingerprints with those of all strings that can be repeated.

Phrases go by 64-bit names.  Two different phrases of one name matter only where
all that stands beside them for 200 bytes is equal too, so it takes a chance
of 2^-64 for each pair of neighbouring suffixes to remove a string wrongly.  Keys
of the sort are told apart for certain: a segment in which two of them would
hash alike is hashed anew.

Orders and counts are held in segments by key range in the shared folder.
Tasks pass on distinct keys with counts, so copies are summed before they move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import (
    BLOCK, OpenFiles, U, block_rows, by_segment, merged, mix, narrow, over_segments, owned, pack, piece_hashes, read_arrays, remove, unpack, write_arrays,
)
from .common import arrow_map, bounded_batches, scratch_path, spans_of_equal, utf8_values

LENGTH = 200
GRAM = 4
SPREAD = 48
#: Text bytes for each segment, and keys that a task holds before passing them on.
SEGMENT_BYTES = 16 << 20
RUN_SEGMENT_BYTES = 48 << 20
HELD = 2_000_000
#: Bytes of texts that a task looks at together; one text may be longer.
GROUP_BYTES = 2 << 20
_CHUNK = 1 << 20
_CUT = 60_000
_LATER = np.arange(0xFFFF, -1, -1, dtype=np.uint32)
_REACH = 2 * LENGTH + SPREAD
Fingerprints = tuple[np.ndarray, np.ndarray]
_B1, _B2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def _powers(base: U) -> tuple[np.ndarray, np.ndarray]:
    n = _CHUNK + _REACH + 1
    up = np.full(n, base, U)
    down = np.full(n, U(pow(int(base), -1, 1 << 64)), U)
    up[0] = down[0] = U(1)
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def substring_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the fingerprints of substrings, in order, none longer than ``_REACH``."""
    if not _tables:
        for base in (_B1, _B2):
            _tables[int(base)] = _powers(base)
    out = (np.empty(len(starts), U), np.empty(len(starts), U))
    done = 0
    while done < len(starts):
        lo = int(starts[done])
        upto = int(np.searchsorted(starts, lo + _CHUNK, side="left"))
        s, e = starts[done:upto] - lo, ends[done:upto] - lo
        part = text[lo : lo + int(e.max())].astype(U) + U(1)
        for half, base in zip(out, (_B1, _B2)):
            up, down = _tables[int(base)]
            sums = np.concatenate([np.zeros(1, U), np.cumsum(part * up[: len(part)], dtype=U)])
            half[done:upto] = mix((sums[e] - sums[s]) * down[s])
        done = upto
    return out


def cut_places(text: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
    """Content-defined places: the last minimum of each ``SPREAD`` gram hashes.

    ``text`` may be several texts in a row, each beginning at one of ``offsets``;
    no gram reaches from one into the next.
    """
    offsets = np.zeros(1, np.int64) if offsets is None else offsets
    window = SPREAD + GRAM - 1
    inside = np.ones(max(0, len(text) - window + 1), bool)  # windows that lie in one text
    for at in offsets[1:].tolist():
        inside[max(0, at - window + 1) : at] = False
    first = np.zeros(len(inside) + 1, bool)
    first[np.minimum(offsets, len(inside))] = True
    found = []
    for lo in range(0, len(inside), _CUT):
        g = text[lo : lo + _CUT + window - 1].astype(np.uint32)
        g = g[:-1] << np.uint32(8) | g[1:]
        g = g[:-2] << np.uint32(16) | g[2:]
        g *= np.uint32(0x9E3779B1)
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x85EBCA77)
        # Sixteen bits of hash, then the place, later ones being smaller.
        low = g & np.uint32(0xFFFF0000) | _LATER[: len(g)]
        for width in (1, 2, 4, 8, 16, 16):
            low = np.minimum(low[:-width], low[width:])
        change = np.append(True, low[1:] != low[:-1])
        change |= first[lo : lo + len(change)]
        change &= inside[lo : lo + len(change)]
        found.append((0xFFFF - (low[change] & np.uint32(0xFFFF))).astype(np.int64) + lo)
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    # Where two cuts meet the last place of one may stand again in the next.
    return places[np.append(True, places[1:] > places[:-1])] if len(places) else places


class Texts:
    """The phrases of some texts in a row, each of at least ``LENGTH`` bytes.

    Places, phrases and strings are counted through all of them, so that each
    step is taken for all at once; nothing that is found reaches over an end.
    """

    def __init__(self, raw: list[bytes]):
        sizes = np.array([len(t) for t in raw], np.int64)
        self.raw = raw
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.padded = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
        self.text = self.padded[: len(self.padded) - 8]
        self.places = cut_places(self.text, self.offsets[:-1])
        starts = np.sort(np.concatenate([self.places, self.offsets[:-1]]))
        starts = starts[np.append(True, starts[1:] > starts[:-1])] if len(starts) else starts
        self.edges = np.append(starts, len(self.text))
        self.sizes = np.diff(self.edges)
        # 0 stands between runs, so no name may be 0.
        self.names = piece_hashes(self.padded, starts, self.sizes) | U(1)
        self.heads = np.searchsorted(self.edges, self.offsets)  # the first phrase of each text, then the end
        self.of_place = np.searchsorted(starts, self.places)  # the phrase that begins at a place

    def hashes(self, which: np.ndarray) -> np.ndarray:
        return _text_hashes([self.raw[i] for i in which.tolist()])

    def runs(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, firsts and ends of the runs of repeated phrases that stand side by side.

        A run matters only if it can hold all inner places of some string: from
        the place before it to the place after it, more than the inner bytes of
        a string must fit.  Short phrases that are repeated by chance fall out.
        """
        head = np.zeros(len(repeated) + 1, bool)
        head[self.heads] = True
        goes_on = np.append(False, repeated[1:] & repeated[:-1]) & ~head[:-1]
        lo = np.flatnonzero(repeated & ~goes_on)
        hi = np.flatnonzero(repeated & ~np.append(goes_on[1:], False)) + 1
        text = np.searchsorted(self.heads, lo, side="right") - 1
        begin, end = self.heads[text], self.heads[text + 1]
        is_place = np.zeros(len(self.edges), bool)
        is_place[self.of_place] = True
        ahead = (lo > begin) & is_place[np.maximum(lo - 1, 0)]
        before = np.where(ahead, self.edges[np.maximum(lo - 1, 0)], self.edges[begin] - LENGTH)
        after = np.where(hi + 1 < end, self.edges[np.minimum(hi + 1, len(self.edges) - 1)], self.edges[end] + LENGTH)
        fits = after - before >= LENGTH - GRAM - SPREAD - (SPREAD - 1) + 2
        return text[fits], lo[fits], hi[fits]

    def verdicts(self, reach: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start of a string: surely repeated, and still undecided.

        ``reach``: for each phrase the end of its longest match, or its start.
        Texts that are not ``alive`` hold no repeated string.
        """
        n = len(self.text)
        yes, maybe = np.zeros(n, bool), np.zeros(n, bool)
        top = np.maximum.accumulate(reach)
        place_reach = reach[self.of_place]
        for lo in range(0, n, _CHUNK):
            hi = min(n, lo + _CHUNK)
            p, q = np.searchsorted(self.edges, [lo, hi - 1], side="right") - 1
            inner = np.minimum(self.edges[p + 1 : q + 2], hi) - np.maximum(self.edges[p : q + 1], lo)
            starts = np.arange(lo, hi)
            yes[lo:hi] = np.repeat(top[p : q + 1], inner) - LENGTH >= starts
            # Of the inner places of each string, the first and the last.
            first = self._places_before(lo + SPREAD - 1, hi - lo)
            last = self._places_before(lo + LENGTH - GRAM - SPREAD + 1, hi - lo) - 1
            some = np.flatnonzero((last >= first) & (first < len(self.places)))
            maybe[lo + some] = place_reach[first[some]] >= self.places[last[some]]
        for i in range(len(self.raw)):
            at, end = int(self.offsets[i]), int(self.offsets[i + 1])
            out = slice(end - LENGTH + 1, end) if alive[i] else slice(at, end)
            yes[out] = maybe[out] = False
        return yes, maybe & ~yes

    def _places_before(self, lo: int, n: int) -> np.ndarray:
        """How many places lie before each of n positions from ``lo``."""
        a, b = np.searchsorted(self.places, [lo, lo + n])
        step = np.zeros(n + 1, np.int32)
        step[self.places[a:b] + 1 - lo] = 1
        return np.cumsum(step[:n], dtype=np.int32) + np.int32(a)

    def fingerprints(self, chosen: np.ndarray) -> Fingerprints:
        starts = np.flatnonzero(chosen)
        return substring_hashes(self.text, starts, starts + LENGTH)


def _text_hashes(raw: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, raw), U, len(raw))


def run_hash(names: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(np.ascontiguousarray(names).tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")


def range_of(x: np.ndarray, segments: int) -> np.ndarray:
    """The segment of evenly spread 64-bit keys, in their order."""
    return ((x >> U(32)) * U(segments) >> U(32)).astype(np.int64)


def by_range(segment: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(segment, lo, hi)`` over sorted segment numbers."""
    cuts = spans_of_equal(segment)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(segment[lo]), int(lo), int(hi)


class Counter:
    """Distinct keys with counts, passed on in blocks by key range."""

    def __init__(self, kind: str, segments: int):
        self.kind, self.segments = kind, segments
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(np.ones(len(keys), np.int64) if counts is None else counts)
        self.held += len(keys)
        if self.held > HELD:
            yield self.release()

    def release(self) -> pa.RecordBatch:
        keys, counts = merged(self.keys, self.counts)
        self.keys, self.counts, self.held = [], [], 0
        return block_rows([(self.kind, k, pack(keys[lo:hi], counts[lo:hi])) for k, lo, hi in by_range(range_of(keys, self.segments))])


class FingerprintCounter:
    """Distinct 128-bit keys with counts, passed on in blocks by the range of their first half."""

    def __init__(self, kind: str, segments: int):
        self.kind, self.segments = kind, segments
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts.append(keys)
        self.held += len(keys[0])
        if self.held > HELD:
            yield self.release()

    def release(self) -> pa.RecordBatch:
        a, b, counts = summed(self.parts, [np.ones(len(p[0]), np.int64) for p in self.parts])
        self.parts, self.held = [], 0
        return block_rows([(self.kind, k, pack(a[lo:hi], b[lo:hi], counts[lo:hi])) for k, lo, hi in by_range(range_of(a, self.segments))])


def summed(keys: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 128-bit keys in the order of their first halves, with the sums of their counts."""
    if not keys:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
    a, b = (np.concatenate([k[i] for k in keys]) for i in (0, 1))
    order = np.argsort(a)
    ordered, other = a[order], b[order]
    if ((ordered[1:] == ordered[:-1]) & (other[1:] != other[:-1])).any():
        order = np.lexsort((b, a))
        ordered, other = a[order], b[order]
    cuts = spans_of_equal(ordered, other)[:-1]
    return ordered[cuts], other[cuts], np.add.reduceat(np.concatenate(counts)[order], cuts) if len(cuts) else np.zeros(0, np.int64)


class Keys:
    """Sorted keys in files by range; ``at`` looks many of them up."""

    def __init__(self, folder: str, kind: str, segments: int, key: int = 0, screen: int | None = None):
        self.folder, self.kind, self.segments, self.key, self.screen = folder, kind, segments, key, screen
        self.open = OpenFiles()

    def path(self, k: int) -> str:
        return f"{self.folder}/{self.kind}/{k:06d}"

    def file(self, k: int) -> list[np.ndarray]:
        return self.open.get(self.path(k))

    def at(self, keys: np.ndarray, *columns: int) -> list[np.ndarray]:
        """Whether each key is held, then the wanted columns of its entry, else 0."""
        segment = range_of(keys, self.segments)
        small = segment.astype(np.uint16) if self.segments < 1 << 16 else segment
        order = np.argsort(small, kind="stable")
        held = np.zeros(len(keys), bool)
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        for k, lo, hi in by_range(small[order]):
            arrays = self.file(k)
            known = arrays[self.key]
            if not len(known):
                continue
            rows = order[lo:hi]
            if self.screen is not None:
                rows = rows[screened(arrays[self.screen], keys[rows])]
            wanted = keys[rows]
            place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            same = known[place] == wanted
            rows = rows[same]
            held[rows] = True
            for values, c in zip(out, columns):
                values[rows] = arrays[c][place[same]]
        return [held, *out]

    def at_fingerprints(self, keys: tuple[np.ndarray, np.ndarray], *columns: int) -> list[np.ndarray]:
        """As ``at``, for 128-bit keys whose halves are the first two arrays."""
        segment = range_of(keys[0], self.segments)
        order = np.argsort(segment, kind="stable")
        held = np.zeros(len(segment), bool)
        out = [np.zeros(len(segment), np.int64) for _ in columns]
        for k, lo, hi in by_range(segment[order]):
            arrays = self.file(k)
            first, second = arrays[0], arrays[1]
            rows = order[lo:hi]
            if self.screen is not None and len(first):
                rows = rows[screened(arrays[self.screen], keys[0][rows])]
            place = np.searchsorted(first, keys[0][rows])
            while len(rows):
                inside = np.minimum(place, len(first) - 1)
                alike = (place < len(first)) & (first[inside] == keys[0][rows]) if len(first) else np.zeros(len(rows), bool)
                rows, place = rows[alike], place[alike]
                same = second[place] == keys[1][rows]
                held[rows[same]] = True
                for values, c in zip(out, columns):
                    values[rows[same]] = arrays[c][place[same]]
                rows, place = rows[~same], place[~same] + 1  # another key with this first half
        return [held, *out]


def screen_of(keys: np.ndarray) -> np.ndarray:
    """A bitmap of 16 bits for each key, set where a key falls."""
    size = 1 << max(6, int(16 * len(keys)).bit_length())
    bits = np.zeros(size, bool)
    bits[(mix(keys) & U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def screened(screen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = mix(keys) & U(8 * len(screen) - 1)
    return (screen[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def _write_owned(blocks: DataFrame, segments: int, keys: Keys, merge: Callable[[list[tuple[str, bytes]]], tuple[list[np.ndarray], list[int]]]) -> list[list[int]]:
    """Merge and write each segment's blocks; the totals of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for k, held in by_segment(batches):
            arrays, totals = merge(held)
            write_arrays(keys.path(k), arrays)
            out.append((k, totals))
        ks, totals = zip(*out) if out else ([], [])
        yield pa.record_batch([pa.array(ks, pa.int32()), pa.array(totals, pa.list_(pa.int64()))], ["segment", "totals"])

    # One short row for each segment.
    got = {r[0]: list(r[1]) for r in owned(blocks, segments).mapInArrow(run, "segment int, totals array<long>").collect()}
    empty, none = merge([])
    for k in set(range(segments)) - got.keys():
        write_arrays(keys.path(k), empty)
        got[k] = none
    return [got[k] for k in range(segments)]


def _grouped(batches: Iterator[pa.RecordBatch], column: int, touched: Keys | None = None) -> Iterator[Texts]:
    """Texts that are long enough to hold a string, some MB at a time; of these the touched ones."""
    for batch in batches:
        sizes = np.cumsum([len(t) for t in utf8_values(batch.column(column))])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + GROUP_BYTES, side="right")))
            raw = [t for t in utf8_values(batch.column(column).slice(lo, hi - lo)) if len(t) >= LENGTH]
            if touched is not None and raw:
                raw = [t for t, held in zip(raw, touched.at(_text_hashes(raw))[0]) if held]
            if raw:
                yield Texts(raw)
            lo = hi


def _merge_counts(held: list[tuple[str, bytes]]) -> tuple[list[np.ndarray], list[int]]:
    parts = [unpack(b, 2) for _, b in held]
    keys, counts = merged([p[0] for p in parts], [p[1].astype(np.int64) for p in parts])
    keys = keys[counts > 1]
    return [keys], [len(keys)]


class SuffixSort:
    """Ranks of all suffixes of the segments' sequences, by difference cover.

    Level d of segment k is a file of non-negative symbols, 0 between runs.
    Every step is a task for each segment; orders are settled by key range.
    """

    def __init__(self, spark: SparkSession, folder: str, segments: int, depth: int):
        self.spark, self.folder, self.segments, self.depth = spark, folder, segments, depth

    def __getstate__(self):
        return self.__dict__ | {"spark": None}  # tasks read files alone

    def symbols(self, level: int, k: int) -> np.ndarray:
        return (read_arrays(f"{self.folder}/level{level}/{k:06d}")[0] if level else read_arrays(f"{self.folder}/runs/{k:06d}")[5]).astype(U)

    def ranks(self, level: int, k: int) -> np.ndarray:
        return read_arrays(f"{self.folder}/rank{level}/{k:06d}")[0].astype(np.int64)

    def order(self, name: str, top: int, emit: Callable[[int], tuple[list[np.ndarray], np.ndarray]]) -> Callable:
        """Sort the distinct keys of all segments.

        ``emit(k)``: key columns, the first below ``top``, and which of two
        classes each row counts for.  Returns a lookup of key columns that gives
        for each the rows of either class with a smaller key, and the key's
        place among distinct keys.
        """
        segments, folder = self.segments, self.folder

        def segment_of(first: np.ndarray) -> np.ndarray:
            return range_of(first, segments) if top >= 1 << 63 else (first.astype(np.float64) * segments / top).astype(np.int64).clip(0, segments - 1)

        def send(k: int) -> list:
            cols, second = emit(k)
            cols = [np.ascontiguousarray(c).astype(U) for c in cols]
            order = np.lexsort(cols[::-1])
            cols, second = [c[order] for c in cols], second[order]
            cuts = spans_of_equal(*cols)
            first = cuts[:-1]
            ones = np.add.reduceat(second.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            cols = [c[first] for c in cols]
            sizes = np.diff(cuts)
            return [("keys", b, pack(*[c[lo:hi] for c in cols], sizes[lo:hi] - ones[lo:hi], ones[lo:hi])) for b, lo, hi in by_range(segment_of(cols[0]))]

        width = len(emit(-1)[0])

        def merge(held: list[tuple[str, bytes]]) -> tuple[list[np.ndarray], list[int]]:
            parts = [unpack(b, width + 2) for _, b in held]
            cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, U) for i in range(width + 2)]
            order = np.lexsort(cols[:width][::-1])
            cols = [c[order] for c in cols]
            cuts = spans_of_equal(*cols[:width])[:-1]
            counts = [np.add.reduceat(c.astype(np.int64), cuts) if len(cuts) else np.zeros(0, np.int64) for c in cols[width:]]
            below = [np.cumsum(c) - c for c in counts]
            own = [c[cuts] for c in cols[:width]]
            salt = 0
            while True:
                hashed = self.key_hash(own, salt)
                by = np.argsort(hashed)
                if not (hashed[by][1:] == hashed[by][:-1]).any():
                    break
                salt += 1
            return [hashed[by], *(narrow(c[by]) for c in below), narrow(by), np.array([salt])], [int(counts[0].sum()), int(counts[1].sum()), len(cuts)]

        keys = Keys(folder, name, segments)
        totals = _write_owned(over_segments(self.spark, segments, send, BLOCK, ["kind", "segment", "block"]), segments, keys, merge)
        base = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(np.array(totals, np.int64).reshape(-1, 3), axis=0)])

        def lookup(cols: list[np.ndarray]) -> list[np.ndarray]:
            cols = [np.ascontiguousarray(c).astype(U) for c in cols]
            segment = segment_of(cols[0])
            hashed = self.key_hash(cols)
            out = [np.zeros(len(hashed), np.int64) for _ in range(3)]
            order = np.lexsort((hashed, segment))
            for k, lo, hi in by_range(segment[order]):
                arrays, rows = keys.file(k), order[lo:hi]
                salt = int(arrays[4][0])
                place = np.searchsorted(arrays[0], self.key_hash([c[rows] for c in cols], salt) if salt else hashed[rows])
                for i in range(3):
                    out[i][rows] = arrays[i + 1][place].astype(np.int64) + base[k][i]
            return out

        lookup.total = int(base[-1][2])
        return lookup

    @staticmethod
    def key_hash(cols: list[np.ndarray], salt: int = 0) -> np.ndarray:
        h = np.full(len(cols[0]), salt, U)
        for c in cols:
            h = mix(h * U(0x9E3779B97F4A7C15) + c + U(0x632BE59BD9B4E019))
        return h

    @staticmethod
    def shifted(x: np.ndarray, by: int, missing: int = 0) -> np.ndarray:
        out = np.full(len(x), missing, x.dtype)
        if by < len(x):
            out[: len(x) - by] = x[by:]
        return out

    def run(self, level: int = 0, top: int = 1 << 64) -> None:
        """Write the ranks of the given level, its symbols below ``top``."""
        read = lambda k: self.symbols(level, k) if k >= 0 else np.zeros(3, U)

        def put(k: int, rank: np.ndarray) -> list:
            write_arrays(f"{self.folder}/rank{level}/{k:06d}", [narrow(rank)])
            return [(k,)]

        if level == self.depth:
            plain = self.order(f"base{level}", top, lambda k: ([read(k)], np.zeros(len(read(k)), bool)))
            self.each(lambda k: put(k, plain([read(k)])[0]))
            self.forget(f"base{level}")
            return

        def triples(k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
            x = read(k)
            at = np.concatenate([np.arange(1, len(x), 3), np.arange(2, len(x), 3)])
            return [self.shifted(x, j)[at] for j in range(3)], np.zeros(len(at), bool), at

        named = self.order(f"names{level}", top, lambda k: triples(k)[:2])

        def name(k: int) -> list:
            cols, _, at = triples(k)
            names = named(cols)[2].astype(U) + U(1)
            ones = len(range(1, len(read(k)), 3))
            write_arrays(f"{self.folder}/level{level + 1}/{k:06d}", [narrow(np.concatenate([names[:ones], [U(0)], names[ones:]]))])
            return [(k,)]

        self.each(name)
        self.forget(f"names{level}")
        self.run(level + 1, named.total + 2)
        self.forget(f"level{level + 1}")
        segments = self.segments

        def sampled(k: int) -> tuple[np.ndarray, np.ndarray]:
            """Symbols, and for sampled places the sampled suffixes below; else -1."""
            x = read(k)
            rank = np.full(len(x), -1, np.int64)
            if k < 0:
                return x, rank
            below = self.ranks(level + 1, k)
            ones = len(range(1, len(x), 3))
            # Each segment's separator stands below all names.
            rank[1::3] = below[:ones] - segments
            rank[2::3] = below[ones + 1 :] - segments
            return x, rank

        def near(k: int, cls: int, by: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
            x, rank = sampled(k)
            at = np.sort(np.concatenate([np.arange(0, len(x), 3), np.arange(cls, len(x), 3)]))
            cols = [self.shifted(x, j)[at] for j in range(by)] + [self.shifted(rank, by, -1)[at] + 1]
            return cols, at % 3 == cls, at

        with_one = self.order(f"one{level}", top, lambda k: near(k, 1, 1)[:2])
        with_two = self.order(f"two{level}", top, lambda k: near(k, 2, 2)[:2])

        def settle(k: int) -> list:
            _, rank = sampled(k)
            cols, one, at = near(k, 1, 1)
            zeros_below, ones_below, _ = with_one(cols)
            rank[at[one]] += zeros_below[one]
            total = np.zeros(len(rank), np.int64)
            total[at[~one]] = zeros_below[~one] + ones_below[~one]
            cols, two, at = near(k, 2, 2)
            zeros_below, twos_below, _ = with_two(cols)
            rank[at[two]] += zeros_below[two]
            total[at[~two]] += twos_below[~two]
            rank[0::3] = total[0::3]
            return put(k, rank)

        self.each(settle)
        self.forget(f"rank{level + 1}", f"one{level}", f"two{level}")

    def forget(self, *kinds: str) -> None:
        """Delete what later steps do not read; their inputs are files too."""
        for kind in kinds:
            remove(f"{self.folder}/{kind}")

    def each(self, fn: Callable[[int], list]) -> None:
        over_segments(self.spark, self.segments, fn, "id long", ["id"]).count()


class RepeatedSpans:
    """The passes over ``docs`` and what they leave in the shared folder."""

    def __init__(self, docs: DataFrame, text_col: str):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(text_col).alias("text"))
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        self.segments = max(1, -(-size // SEGMENT_BYTES))
        self.folder = scratch_path(self.spark, "suffixes")
        self.run_segments = max(1, -(-size // RUN_SEGMENT_BYTES))
        self.names = Keys(self.folder, "names", self.segments)
        self.starts = Keys(self.folder, "runs", self.run_segments)
        self.touched = Keys(self.folder, "runs", self.run_segments, key=7)
        self.open = Keys(self.folder, "open", self.segments)
        self.hits = Keys(self.folder, "hits", self.segments)
        self._count_phrases()
        depth = self._gather_runs()
        SuffixSort(self.spark, self.folder, self.run_segments, depth).run()
        self._compare_adjacent()
        remove(f"{self.folder}/rank0")
        self._settle_open()

    def __getstate__(self):
        return self.__dict__ | {"spark": None, "docs": None}

    def _count_phrases(self) -> None:
        segments = self.segments

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = Counter("names", segments)
            for texts in _grouped(batches, 0):
                yield from counter.add(texts.names)
            yield counter.release()

        _write_owned(arrow_map(self.docs, ["text"], run, BLOCK), self.segments, self.names, _merge_counts)

    def _gather_runs(self) -> int:
        """Equal runs once, in files by run hash; returns the depth of the recursion."""
        segments, names = self.run_segments, self.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], list] = {}
            held = 0

            def release() -> pa.RecordBatch:
                rows: dict[int, list] = {}
                for (h1, h2), (n, run_names, sizes) in found.items():
                    rows.setdefault(int(range_of(np.array([h1], U), segments)[0]), []).append((h1, h2, n, run_names, sizes))
                out = []
                for k, group in rows.items():
                    head = [np.array([g[i] for g in group], U) for i in range(3)] + [np.array([len(g[3]) for g in group], U)]
                    body = [np.concatenate([g[i] for g in group]).astype(U) for i in (3, 4)]
                    out.append(("head", k, pack(np.zeros(len(group), U), *head)))
                    out.append(("body", k, pack(np.zeros(len(body[0]), U), *body)))
                return block_rows(out)

            touched = Counter("text", segments)
            for texts in _grouped(batches, 0):
                which, los, his = texts.runs(names.at(texts.names)[0])
                if len(which):
                    yield from touched.add(texts.hashes(which[np.append(True, which[1:] != which[:-1])]))
                for lo, hi in zip(los.tolist(), his.tolist()):
                    key = run_hash(texts.names[lo:hi])
                    if key in found:
                        found[key][0] += 1
                    else:
                        found[key] = [1, texts.names[lo:hi].copy(), texts.sizes[lo:hi].copy()]
                        held += hi - lo + 8
                if held > HELD:
                    yield release()
                    found, held = {}, 0
            yield release()
            yield touched.release()

        folder = self.folder

        def merge(held: list[tuple[str, bytes]]) -> tuple[list[np.ndarray], list[int]]:
            heads = [unpack(b, 5)[1:] for kind, b in held if kind == "head"]
            bodies = [unpack(b, 3)[1:] for kind, b in held if kind == "body"]
            h1, h2, times, sizes = (np.concatenate([h[i] for h in heads]) if heads else np.zeros(0, U) for i in range(4))
            body = [np.concatenate([b[i] for b in bodies]) if bodies else np.zeros(0, U) for i in range(2)]
            start = np.cumsum(sizes.astype(np.int64)) - sizes.astype(np.int64)
            order = np.lexsort((h2, h1))
            cuts = spans_of_equal(h1[order], h2[order])[:-1]
            keep = order[cuts]
            times = np.add.reduceat(times[order].astype(np.int64), cuts) if len(cuts) else np.zeros(0, np.int64)
            length = sizes[keep].astype(np.int64)
            # Each run, then a 0.
            place = np.cumsum(length + 1) - (length + 1)
            symbols, widths = np.zeros(int((length + 1).sum()), U), np.zeros(int((length + 1).sum()), np.int64)
            inside = np.repeat(start[keep] - place, length) + (to := np.repeat(place - (np.cumsum(length) - length), length) + np.arange(int(length.sum())))
            symbols[to], widths[to] = body[0][inside], body[1][inside]
            ends = np.concatenate([[0], np.cumsum(widths)])
            # The most phrases that LENGTH + SPREAD bytes can take part in.
            most = int((np.searchsorted(ends, ends[:-1] + LENGTH + SPREAD) - np.arange(len(widths))).max(initial=1)) + 2
            texts = merged([unpack(b, 2)[0] for kind, b in held if kind == "text"])[0]
            return [h1[keep], h2[keep], times, place, length, symbols, narrow(widths), texts], [most, int(length.sum())]

        blocks = arrow_map(self.docs, ["text"], run, BLOCK)
        totals = _write_owned(blocks, segments, self.starts, merge)
        depth, covered = 0, 1
        while covered < max(t[0] for t in totals):
            depth, covered = depth + 1, covered * 3
        return depth

    def _compare_adjacent(self) -> None:
        """For each phrase of each run, the bytes of the longest match from it."""
        folder, segments, starts = self.folder, self.run_segments, self.starts

        def send(k: int) -> list:
            arrays = starts.file(k)
            x = arrays[5]
            rank = read_arrays(f"{folder}/rank0/{k:06d}")[0]
            at = np.flatnonzero(x)
            at = at[np.argsort(x[at], kind="stable")]
            return [
                ("ranks", b, pack(rank[at[lo:hi]], np.full(hi - lo, k), at[lo:hi]))
                for b, lo, hi in by_range(range_of(x[at], segments))
            ]

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = Keys(folder, "runs", segments)
            for _, held in by_segment(batches):
                parts = [unpack(b, 3) for _, b in held]
                rank, seg, at = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3))
                order = np.argsort(rank, kind="stable")
                seg, at = seg[order], at[order]
                match = _common_bytes(files, seg, at)
                best = np.maximum(np.append(match, 0), np.append(0, match))
                by = np.argsort(seg, kind="stable")
                yield block_rows([("match", b, pack(at[by[lo:hi]], best[by[lo:hi]])) for b, lo, hi in by_range(seg[by])])

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, done = Keys(folder, "runs", segments), []
            for k, held in by_segment(batches):
                _, _, times, place, length, symbols, widths, _ = files.file(k)
                match = np.zeros(len(symbols), np.int64)
                for _, b in held:
                    at, best = unpack(b, 2)
                    match[at.astype(np.int64)] = best.astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
                # A run found twice as a whole matches to its end.
                twice = np.repeat(times > 1, length + 1)
                whole = np.repeat(ends[place + length], length + 1) - ends[:-1]
                write_arrays(f"{folder}/match/{k:06d}", [narrow(np.where(twice, whole, match))])
                done.append(k)
            yield pa.record_batch([pa.array(done, pa.int32())], ["segment"])

        ranks = owned(over_segments(self.spark, segments, send, BLOCK, ["kind", "segment", "block"]), segments)
        blocks = ranks.mapInArrow(compare, BLOCK)
        done = {r[0] for r in owned(blocks, segments).mapInArrow(collect, "segment int").collect()}
        for k in set(range(segments)) - done:
            write_arrays(f"{folder}/match/{k:06d}", [np.zeros(0, np.int64)])

    def reader(self) -> Callable[[Texts], tuple[np.ndarray, np.ndarray]]:
        """For texts: the end of the longest match of each phrase, and which of them have any."""
        names, starts, matches = self.names, self.starts, Keys(self.folder, "match", self.run_segments)

        def read(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
            which, los, his = texts.runs(names.at(texts.names)[0])
            reach, alive = texts.edges[:-1].copy(), np.zeros(len(texts.raw), bool)
            alive[which] = True
            hashes = [run_hash(texts.names[lo:hi]) for lo, hi in zip(los.tolist(), his.tolist())]
            segment = range_of(np.array([h[0] for h in hashes], U), starts.segments).tolist()
            for lo, hi, key, k in zip(los.tolist(), his.tolist(), hashes, segment):
                arrays = starts.file(k)
                j = int(np.searchsorted(arrays[0], U(key[0])))
                while int(arrays[1][j]) != key[1]:
                    j += 1
                first = int(arrays[3][j])
                reach[lo:hi] += matches.file(k)[0][first : first + hi - lo]
            return reach, alive

        return read

    def _settle_open(self) -> None:
        """Compare undecided strings with each other, then with the decided ones."""
        read, segments, touched = self.reader(), self.segments, self.touched

        def blocks_of(kind: str, which: int, choose: Callable[[Fingerprints], Fingerprints]) -> DataFrame:
            """Keys of the strings with the verdict ``which``, as ``choose`` leaves them."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                counter = FingerprintCounter(kind, segments)
                for texts in _grouped(batches, 0, touched):
                    keys = choose(texts.fingerprints(texts.verdicts(*read(texts))[which]))
                    if len(keys[0]):
                        yield from counter.add(keys)
                yield counter.release()

            return arrow_map(self.docs, ["text"], run, BLOCK)

        def sums(held: list[tuple[str, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            parts = [unpack(b, 3) for _, b in held]
            return summed([(p[0], p[1]) for p in parts], [p[2].astype(np.int64) for p in parts])

        def merge(held: list[tuple[str, bytes]]) -> tuple[list[np.ndarray], list[int]]:
            a, b, counts = sums(held)
            return [a, b, np.minimum(counts, 2).astype(np.uint8), screen_of(a[counts == 1])], [int((counts == 1).sum())]

        single = sum(t[0] for t in _write_owned(blocks_of("open", 1, lambda keys: keys), segments, self.open, merge))
        once = Keys(self.folder, "open", segments, screen=3)

        def seen_once(keys: Fingerprints) -> Fingerprints:
            held, times = once.at_fingerprints(keys, 2)
            chosen = held & (times == 1)
            return keys[0][chosen], keys[1][chosen]

        def merge_hits(held: list[tuple[str, bytes]]) -> tuple[list[np.ndarray], list[int]]:
            return list(sums(held)[:2]), [0]

        blocks = blocks_of("hits", 0, seen_once) if single else self.spark.createDataFrame([], BLOCK)
        _write_owned(blocks, segments, self.hits, merge_hits)

    def covered(self) -> Callable[[Texts], np.ndarray]:
        """For texts: which bytes a repeated string covers."""
        read, once, hits = self.reader(), self.open, self.hits

        def marks(texts: Texts) -> np.ndarray:
            yes, maybe = texts.verdicts(*read(texts))
            keys = texts.fingerprints(maybe)
            found = (once.at_fingerprints(keys, 2)[1] > 1) | hits.at_fingerprints(keys)[0]
            yes[np.flatnonzero(maybe)[found]] = True
            change = yes.astype(np.int16)
            change[LENGTH:] -= yes[:-LENGTH]
            return np.cumsum(change, dtype=np.int16) > 0

        return marks


def _common_bytes(files: Keys, seg: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of the equal phrases with which neighbours in the order begin."""
    n = len(at) - 1
    total = np.zeros(max(n, 0), np.int64)
    live = np.arange(max(n, 0))
    step = 0
    while len(live):
        left, width = _phrases_at(files, seg[live], at[live] + step)
        right, _ = _phrases_at(files, seg[live + 1], at[live + 1] + step)
        same = (left == right) & (left != 0)
        live = live[same]
        total[live] += width[same]
        live = live[total[live] < LENGTH + SPREAD]
        step += 1
    return total


def _phrases_at(files: Keys, seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, widths = np.zeros(len(at), U), np.zeros(len(at), np.int64)
    order = np.argsort(seg, kind="stable")
    for k, lo, hi in by_range(seg[order]):
        rows = order[lo:hi]
        arrays = files.file(k)
        names[rows], widths[rows] = arrays[5][at[rows]], arrays[6][at[rows]]
    return names, widths


def _digest_row(raw: bytes, mark: np.ndarray | None) -> tuple[int, int, int, str, bytes]:
    if mark is None:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw
    text = np.frombuffer(raw, np.uint8)
    spans = int(mark[0]) + int((mark[1:] & ~mark[:-1]).sum())
    kept = text[~mark].tobytes()
    return len(raw), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest(), kept


def _marked(raw: list[bytes], touched: Keys, marks: Callable[[Texts], np.ndarray]) -> list[np.ndarray | None]:
    """For each text which of its bytes go, None if none does; some MB of texts at a time."""
    found: list[np.ndarray | None] = [None] * len(raw)
    long = [i for i, t in enumerate(raw) if len(t) >= LENGTH]
    group: list[int] = []
    size = 0
    for i, held in zip([*long, -1], [*touched.at(_text_hashes([raw[i] for i in long]))[0], False]):
        if held:
            group.append(i)
            size += len(raw[i])
        if group and (size > GROUP_BYTES or i < 0):
            texts = Texts([raw[j] for j in group])
            mark = marks(texts)
            for j, lo, hi in zip(group, texts.offsets[:-1].tolist(), texts.offsets[1:].tolist()):
                found[j] = mark[lo:hi] if mark[lo:hi].any() else None
            group, size = [], 0
    return found


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row.

    Every byte goes that lies in a string of ``LENGTH`` bytes that also starts
    elsewhere, in the same text or another.  A null text is empty; texts shorter
    than ``LENGTH`` keep all.  Null ids pass through; repeated rows lose, in
    every copy, what they share.
    """
    spans = RepeatedSpans(docs, text_col)
    marks, touched = spans.covered(), spans.touched
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64()] * 4 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = utf8_values(part.column(1))
                cols = list(zip(*(_digest_row(t, m)[:4] for t, m in zip(raw, _marked(raw, touched, marks)))))
                yield pa.record_batch([part.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(cols, types[1:])]], names)

    return arrow_map(docs, [id_col, text_col], run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all columns and rows, with repeated bytes cut out of the texts.

    A character of which a byte goes is cut whole.  Null texts stay null.
    """
    bounded_batches(docs.sparkSession)
    spans = RepeatedSpans(docs, text_col)
    marks, touched = spans.covered(), spans.touched
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                null = part.column(place).is_null().to_pylist()
                raw = utf8_values(part.column(place))
                kept = [None if n else _digest_row(t, m)[4].decode("utf-8", "ignore") for n, t, m in zip(null, raw, _marked(raw, touched, marks))]
                columns = list(part.columns)
                columns[place] = pa.array(kept, pa.string())
                yield pa.record_batch(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
