"""Byte-level BPE encoding and decoding by merge replay over a corpus slice.

The distinct pre-tokens of a slice of texts that the worker has not met before are laid
out as one long sequence of byte tokens.  An inverted index maps the rank of
each adjacent pair (the rank of the joined bytes) to the positions where it
stands.  Ranks are taken in increasing order; every merge rewrites only the two
touched neighbours, which enter the index under their own new ranks.  Words are
independent, so replaying all of them in one rank order gives each the merges,
in the order, that encoding it alone would.  No row leaves its partition: there
is no shuffle, and a lost task is simply run again.

Texts are first cut into runs without white space, each with the space before
it.  For a pattern that never matches across the start of such a run, which
``splits_at_spaces`` knows of, the ids of a text are the ids of its runs in a row,
so a run met before costs one look-up.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, spans_of_equal, str_values

#: Bytes of memory for the runs and pre-tokens whose ids a worker keeps, in two halves: those met
#: since the newer half was begun, and the half before it, which goes when the newer is full.
CACHE_BYTES = 96 << 20
#: What an entry takes beside its characters and ids.
_ENTRY_BYTES = 200
#: Longer runs and pre-tokens are encoded but not kept.
CACHE_WORD_CHARS = 256
#: Texts are replayed together up to about so many characters.
SLICE_CHARS = 1_000_000
#: A run without white space, with the space before it, or the white space between runs.
_RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that only one of the two regular expression modules takes for white space.
_DISPUTED = re.compile("[\x1c-\x1f]")
#: How a pattern ends whose other matches are a space at most, then no white space.
_SPACES_LAST = r"|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 bytes and a rank on each line."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


_BYTES = [bytes([b]) for b in range(256)]


def byte_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """The rank of each pair of bytes, -1 where it is no token."""
    table = np.full((256, 256), -1, np.int64)
    for token, rank in ranks.items():
        if len(token) == 2:
            table[token[0], token[1]] = rank
    return table


def replay_merges(words: list[bytes], ranks: dict[bytes, int]) -> list[tuple[int, ...]]:
    """Token ids of each word.  A word that is itself a token is that token."""
    tokens = {rank: token for token, rank in ranks.items()}
    return [tuple(np.frombuffer(x, np.int32).tolist()) for x in replay_packed(words, ranks, tokens, byte_pairs(ranks))]


def replay_packed(words: list[bytes], ranks: dict[bytes, int], tokens: dict[int, bytes], pairs: np.ndarray) -> list[bytes]:
    """The same as 32-bit integers in a row, given the tokens by rank and ``byte_pairs``."""
    out = [b""] * len(words)
    long: list[int] = []
    for w, word in enumerate(words):
        own = ranks.get(word)
        if own is not None:
            out[w] = own.to_bytes(4, sys.byteorder)
        elif word:
            long.append(w)
    if not long:
        return out
    data = b"".join([words[w] for w in long])
    n = len(data)
    ends = np.cumsum([len(words[w]) for w in long])
    starts = np.append(0, ends[:-1])
    places = list(range(n + 1))  # the lists share these numbers
    before, after = [-1, *places[: n - 1]], places[1:]
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        before[lo] = after[hi - 1] = -1
    piece: list[bytes | None] = [_BYTES[b] for b in data]
    raw = np.frombuffer(data, np.uint8)
    first = np.full(n, -1, np.int64)
    first[:-1] = pairs[raw[:-1], raw[1:]]
    first[ends - 1] = -1
    now = first.tolist()  # the rank of the pair that begins at each place, -1 for none
    at = np.argsort(first, kind="stable")[int((first < 0).sum()) :]
    cuts = spans_of_equal(first[at]).tolist()
    heap = first[at[cuts[:-1]]].tolist()  # in order, so a heap
    index = {rank: [places[i] for i in at[lo:hi].tolist()] for rank, lo, hi in zip(heap, cuts, cuts[1:])}
    del at, first, places
    pop, push, get = heapq.heappop, heapq.heappush, ranks.get
    while heap:
        rank = pop(heap)
        positions = index.pop(rank, None)
        if positions is None:
            continue
        positions.sort()
        joined = tokens[rank]
        waiting = iter(positions)
        for i in waiting:
            if now[i] != rank:
                continue
            j = after[i]
            piece[i], piece[j] = joined, None
            now[i] = now[j] = -1
            nxt = after[i] = after[j]
            prev = before[i]
            lower = False
            if nxt >= 0:
                before[nxt] = i
                new = get(joined + piece[nxt])
                if new is not None:
                    now[i] = new
                    found = index.get(new)
                    if found is None:
                        index[new] = [i]
                        push(heap, new)
                    else:
                        found.append(i)
                    lower = new < rank
            if prev >= 0:
                new = get(piece[prev] + joined)
                if new is None:
                    now[prev] = -1
                else:
                    now[prev] = new
                    found = index.get(new)
                    if found is None:
                        index[new] = [prev]
                        push(heap, new)
                    else:
                        found.append(prev)
                    lower |= new < rank
            if lower:
                # A lower rank has come up: it goes first, the rest of this one waits.
                rest = list(waiting)
                if rest:
                    index.setdefault(rank, []).extend(rest)
                    push(heap, rank)
    left = np.append(0, np.cumsum(np.fromiter((x is not None for x in piece), bool, n))) * 4
    ids = np.array([ranks[x] for x in piece if x is not None], np.int32).tobytes()
    for w, lo, hi in zip(long, left[starts].tolist(), left[ends].tolist()):
        out[w] = ids[lo:hi]
    return out


def splits_at_spaces(pattern: str) -> bool:
    """Whether every match lies within one of ``_RUNS``.

    That is so for alternatives of an optional space and characters that are no
    white space, followed by the two alternatives for white space.
    """
    if not pattern.endswith(_SPACES_LAST):
        return False
    parts = pattern.removesuffix(_SPACES_LAST).split("|")
    return all(re.fullmatch(r"'[a-z]+| \?(\\p\{[LN]\}|\[\^\\s\\p\{L\}\\p\{N\}\])\+", x) for x in parts)


class MergeReplayCodec:
    """Encoder and decoder of one vocabulary, with a bounded store of runs and pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs = byte_pairs(ranks)
        self.order = np.array(sorted(self.tokens), np.int32)
        self.spellings = pa.array([self.tokens[k] for k in self.order.tolist()], pa.large_binary())
        self.decimals = pa.array([b"%d," % k for k in self.order.tolist()], pa.large_binary())
        self.split = regex.compile(pattern)
        self.by_runs = splits_at_spaces(pattern)
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers in a row
        self.older: dict[str, bytes] = {}
        self.held = 0

    def encode_batch(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        for packed in self.encode_packed(texts):
            yield np.frombuffer(packed, np.int32).tolist()

    def encode_packed(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as 32-bit integers.  One replay serves all texts of a slice."""
        pieces: list[list[str]] = []
        size = 0
        for text in texts:
            pieces.append(self._runs(text))
            size += len(text)
            if size > SLICE_CHARS:
                yield from self._encode_slice(pieces)
                pieces, size = [], 0
        yield from self._encode_slice(pieces)

    def _runs(self, text: str) -> list[str]:
        return _RUNS.findall(text) if self.by_runs and not _DISPUTED.search(text) else self.split.findall(text)

    def _encode_slice(self, texts: list[list[str]]) -> Iterator[bytes]:
        if self.held > CACHE_BYTES // 2:
            self.known, self.older, self.held = {}, self.known, 0
        known = self.known
        new = {p for pieces in texts for p in pieces} - known.keys()
        inner = self._pre_tokens(new - self._met_before(new))
        needed = {p for pieces in inner.values() for p in pieces} - known.keys()
        new |= needed
        fresh = list(needed - self._met_before(needed))
        known.update(zip(fresh, replay_packed([p.encode("utf-8", "replace") for p in fresh], self.ranks, self.tokens, self.pairs)))
        for run, pieces in inner.items():
            if run not in known:
                known[run] = b"".join(map(known.__getitem__, pieces))
        for pieces in texts:
            yield b"".join(map(known.__getitem__, pieces))
        for p in new:
            if len(p) > CACHE_WORD_CHARS:
                del known[p]
            else:
                self.held += _ENTRY_BYTES + len(p) + len(known[p])

    def _pre_tokens(self, runs: set[str]) -> dict[str, list[str]]:
        """The matches of the pattern in each run."""
        if not self.by_runs:
            return {run: self.split.findall(run) for run in runs}
        found = {run: self.split.findall(run) for run in runs if run[-1:].isspace()}
        # The others in one search: a line feed after a run is a match of its own, even before a space.
        others = [run for run in runs if run not in found]
        pieces = self.split.findall("\n".join([*others, ""]))
        lo = 0
        for run in others:
            hi = lo + 1 if pieces[lo] == run else pieces.index("\n", lo)
            found[run] = pieces[lo:hi]
            lo = hi + 1
        return found

    def _met_before(self, pieces: set[str]) -> set[str]:
        """Those of the pieces that the older half has; they go over to the newer."""
        found = pieces & self.older.keys()
        self.known.update((p, self.older[p]) for p in found)
        return found

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_packed(self, packed: bytes) -> memoryview:
        """What the ids of a text, as 32-bit integers, decode to."""
        return self._spelt(self.spellings, packed)

    def decimal(self, packed: bytes) -> memoryview:
        """The ids in decimal, joined by commas."""
        return self._spelt(self.decimals, packed)[:-1]

    def _spelt(self, spellings: pa.LargeBinaryArray, packed: bytes) -> memoryview:
        if not packed:
            return memoryview(b"")
        ids = np.frombuffer(packed, np.int32)
        # Ranks without gaps are their own places.
        at = ids if self.order[-1] == len(self.order) - 1 else np.searchsorted(self.order, ids)
        _, offsets, data = spellings.take(pa.array(at)).buffers()
        return memoryview(data)[: int(np.frombuffer(offsets, np.int64)[len(ids)])]


_codecs: dict[tuple[str, str], MergeReplayCodec] = {}


def codec(path: str, pattern: str) -> MergeReplayCodec:
    """The worker's codec for a rank file, read once in each process."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = MergeReplayCodec(read_ranks(path), pattern)
    return _codecs[key]


def _id_lists(packed: list[bytes]) -> pa.ListArray:
    sizes = np.array([0, *map(len, packed)], np.int64) // 4
    values = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), values)


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, ids array<int>, decoded binary)`` for every row.

    A null text is an empty one: no ids, no bytes.  Null ids pass through,
    repeated rows give repeated rows, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            packed = list(c.encode_packed(str_values(batch.column(1))))
            decoded = [bytes(c.decode_packed(x)) for x in packed]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), _id_lists(packed), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return arrow_map(docs, [id_col, text_col], run, "doc_id long, ids array<int>, decoded binary")


def encode_digests(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encode, decode again, and return counts and SHA-256 digests of both.

    The digests are taken where the ids are, so that ids, unless asked for, and
    bytes need not travel back to the JVM.  Edge cases are those of :func:`encode`.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            count, ids_sha, text_sha, all_ids = [], [], [], []
            for packed in c.encode_packed(str_values(batch.column(1))):
                count.append(len(packed) // 4)
                ids_sha.append(sha(c.decimal(packed)).hexdigest())
                text_sha.append(sha(c.decode_packed(packed)).hexdigest())
                if with_ids:
                    all_ids.append(packed)
            columns = [batch.column(0).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.record_batch(columns + [_id_lists(all_ids)] * with_ids, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return arrow_map(docs, [id_col, text_col], run, schema)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text binary)`` from arrays of ids; a null array gives no bytes.

    An id outside the vocabulary raises ``KeyError``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            texts = [c.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return arrow_map(tokens, [id_col, ids_col], run, "doc_id long, text binary")
