"""Language-model scores from an Elias-Fano n-gram trie.

Level one is the vocabulary: words by their 64-bit hashes, in segments by hash
range, an Elias-Fano sequence each.  A word's id grows as its count falls within
its segment, so frequent words have small ids.  Beside it lie counts and
quantised probabilities.  Level two holds the words seen after each word: for
each context a monotone pointer to its children, and the children as one
Elias-Fano sequence made monotone by adding the last value of the previous
context, so that a child is found by a successor search relative to its context.
Level three hangs the words seen after each pair below the pair's node in the
same way, in the same segment.

The orders are interpolated: words by their distinct predecessors (Kneser-Ney),
pairs and triples by absolute discounting.  Counts and back-off weights are
quantised to 16 bits; a codebook for each level holds the discounted counts.

Building takes two passes over the texts.  Tasks count what they read and pass
on one packed block for each segment; segments are merged and written to the
shared folder by the tasks that own them, under names that a repeated task
overwrites with the same bytes.  A frequent context is dealt over as many
segments as its count asks for, so no segment follows one word's share of the
corpus.  Scoring maps the segments into memory and looks up each distinct pair
and triple of a slice once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, OpenFiles, block_rows, by_segment, merged, mix, owned, pack, piece_hashes, unpack, write_arrays
from .common import arrow_map, scratch_path, spans_of_equal, stash, utf8_values
from .elias_fano import PIECE, EliasFano

BOS, END, FIRST = 0, 1, 2
#: Stands for the token after a pair whose second token is the end; no token has BOS after it.
NONE = BOS
#: Levels that the trie can have.
ORDERS = (2, 3)
#: Tokens that a segment of either level is meant for.
SEGMENT_TOKENS = 4_000_000
#: Tokens of a context for each segment that it is dealt over.
CONTEXT_TOKENS = 250_000
#: Bytes of text that a task looks at together.
SLICE_BYTES = 4 << 20
#: Distinct entries that a task holds before it passes them on.
HELD = 2_000_000
_STEP = 4000.0  # quantisation steps of a decimal order of magnitude
_SHIFT = 12.0  # log10 of the largest count that has a code
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
# Arrays of a segment of pairs: contexts, pointers and children of level two, pointers and children of level three.
_CONTEXTS, _POINTERS, _CHILDREN, _POINTERS3, _CHILDREN3 = 0, 4, 8, 12, 16
_COUNT2, _COUNT3, _KINDS3 = 20, 21, 22


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * _STEP), 0, 65_535).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / -_STEP


def count_codes(counts: np.ndarray) -> np.ndarray:
    out = np.empty(len(counts), np.uint16)
    for lo in range(0, len(counts), PIECE):
        out[lo : lo + PIECE] = quantised(np.log10(np.maximum(counts[lo : lo + PIECE], 1)) - _SHIFT)
    return out


def _counts_by_code() -> np.ndarray:
    """The count that each code stands for; exact below 1,000."""
    counts = 10.0 ** (restored(np.arange(65_536)) + _SHIFT)
    return np.where(counts < 1000, np.rint(counts), counts)


_COUNTS = _counts_by_code()


def _mix(x: np.ndarray) -> np.ndarray:
    return mix(x) >> _U(20)


def trains(id_col: str = "doc_id", folds: int = 10, fold: int = 0) -> Column:
    """Whether the model may learn from the row; rows without an id never."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != fold, F.lit(False))


@dataclass
class Trie:
    """Where the segments lie, and the few numbers that all of them share."""

    folder: str
    word_segments: int
    pair_segments: int
    order: int = 2
    tokens: int = 0  # N
    types: int = 0  # V, the end counted if it occurs
    ends: int = 0
    discounts: tuple[float, float, float] = (0.75, 0.5, 0.5)  # of words, pairs, triples
    pair_types: int = 0
    open: OpenFiles = field(default_factory=OpenFiles)

    def file(self, kind: str, k: int) -> list[np.ndarray]:
        return self.open.get(f"{self.folder}/{kind}-{k:06d}")

    def segment_of_hash(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> _U(32)) * _U(self.word_segments) >> _U(32)).astype(np.int64)

    def segment_of_id(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < FIRST, -1, (ids - FIRST) % self.word_segments)

    def place_of_id(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < FIRST, ids, (ids - FIRST) // self.word_segments)

    def segment_of_pair(self, u: np.ndarray, v: np.ndarray, count_u: np.ndarray) -> np.ndarray:
        share = (1 + count_u // CONTEXT_TOKENS).astype(_U)
        return ((_mix(u) + _mix(v) % share) % _U(self.pair_segments)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and training counts of distinct word hashes in order; -1 and 0 where unknown."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        segment = self.segment_of_hash(hashes)
        cuts = spans_of_equal(segment)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            k = int(segment[lo])
            arrays = self.file("words", k)
            at = EliasFano.of(arrays).find(hashes[lo:hi])
            known = np.flatnonzero(at >= 0)
            ids[lo + known] = arrays[5][at[known]].astype(np.int64) * self.word_segments + k + FIRST
            counts[lo + known] = arrays[4][at[known]]
        return ids, counts

    def levels(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of a type's probability and of its back-off weight, and its total as a context."""
        p, back, total = (np.zeros(len(ids)) for _ in range(3))
        segment, place = self.segment_of_id(ids), self.place_of_id(ids)
        order = np.argsort(segment, kind="stable")
        cuts = spans_of_equal(segment[order])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = order[lo:hi]
            arrays = self.file("types", int(segment[rows[0]]))
            at = place[rows]
            p[rows], back[rows], total[rows] = restored(arrays[0][at]), restored(arrays[1][at]), _COUNTS[arrays[2][at]]
        return p, back, total

    @property
    def unknown(self) -> float:
        """log10 probability of a type that training has not met."""
        if not self.pair_types:
            return -float(np.log10(self.types + 1))
        return float(np.log10(self.discounts[0] * self.types / self.pair_types / (self.types + 1)))

    def codebook(self, level: int) -> np.ndarray:
        """The discounted count of each code."""
        return np.maximum(_COUNTS - self.discounts[level - 1], 1e-3)

    def pairs(self, u: np.ndarray, v: np.ndarray, count_u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments and nodes of pairs of ids sorted by u, then v; -1 for pairs not met."""
        segment, node = np.full(len(u), -1, np.int64), np.full(len(u), -1, np.int64)
        ready = np.flatnonzero((u >= 0) & (v >= 0))
        own = self.segment_of_pair(u[ready], v[ready], count_u[ready])
        segment[ready] = own
        order = np.argsort(own, kind="stable")
        cuts = spans_of_equal(own[order])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = ready[order[lo:hi]]
            node[rows] = self._pair_nodes(int(own[order[lo]]), u[rows], v[rows])
        return segment, node

    def _pair_nodes(self, k: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        arrays = self.file("pairs", k)
        contexts = EliasFano.of(arrays[_CONTEXTS:])
        heads = spans_of_equal(u)
        context = contexts.find(u[heads[:-1]])
        return _children(EliasFano.of(arrays[_POINTERS:]), EliasFano.of(arrays[_CHILDREN:]), context, np.diff(heads), v)

    def read(self, segment: np.ndarray, node: np.ndarray, *columns: int) -> list[np.ndarray]:
        """Columns of the nodes of pairs; 0 for nodes that are not there."""
        out = [np.zeros(len(node), np.int64) for _ in columns]
        rows = np.flatnonzero(node >= 0)
        order = rows[np.argsort(segment[rows], kind="stable")]
        cuts = spans_of_equal(segment[order])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            arrays = self.file("pairs", int(segment[order[lo]]))
            for values, c in zip(out, columns):
                values[order[lo:hi]] = arrays[c][node[order[lo:hi]]]
        return out

    def triples(self, segment: np.ndarray, node: np.ndarray, sizes: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Codes of words below nodes of pairs, -1 for triples not met.

        ``sizes``: how many of the words, which are in order, belong to each node.
        """
        out = np.full(len(w), -1, np.int64)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(segment, kind="stable")
        cuts = spans_of_equal(segment[order])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            mine = order[lo:hi]
            k = int(segment[mine[0]])
            if k < 0:
                continue
            count = sizes[mine]
            rows = np.repeat(starts[mine] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            arrays = self.file("pairs", k)
            at = _children(EliasFano.of(arrays[_POINTERS3:]), EliasFano.of(arrays[_CHILDREN3:]), node[mine], count, w[rows])
            found = np.flatnonzero(at >= 0)
            out[rows[found]] = arrays[_COUNT3][at[found]]
        return out


def _children(pointers: EliasFano, children: EliasFano, parent: np.ndarray, sizes: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of values among the children of their parents, -1 where there is none.

    ``sizes``: how many of the values, which are in order, belong to each parent.
    """
    none = np.full(len(value), -1, np.int64)
    if not children.n:
        return none
    parent = parent.astype(np.int64)
    asked = np.where(value < 0, 0, value).astype(_U)
    first = pointers.access(np.maximum(parent, 0)).astype(np.int64)
    last = pointers.access(np.maximum(parent, 0) + 1).astype(np.int64)
    last[parent < 0] = 0
    base = np.zeros(len(first), _U)
    inner = np.flatnonzero((first > 0) & (last > first))
    base[inner] = children.access(first[inner] - 1) + _U(1)
    some = np.flatnonzero(np.repeat(last > first, sizes) & (value >= 0))
    at = children.find((np.repeat(base, sizes) + asked)[some])
    inside = (at >= np.repeat(first, sizes)[some]) & (at < np.repeat(last, sizes)[some])
    none[some[inside]] = at[inside]
    return none


def _relative(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Children relative to their parents: each parent's begin one past the last value before them."""
    ends = np.cumsum(sizes)
    step = np.zeros(len(sizes), _U)
    some = np.flatnonzero(sizes > 0)
    step[some] = value[ends[some] - 1].astype(_U) + _U(1)
    out = value.astype(_U)
    out += np.repeat(np.cumsum(step, dtype=_U) - step, sizes)
    return out


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each come to about SLICE_BYTES."""
    for batch in batches:
        sizes = np.cumsum([len(t) for t in utf8_values(batch.column(text))])
        lo = 0
        while lo < batch.num_rows:
            done = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Local word numbers of all texts in a row, each text's length, word hashes in order, their counts."""
    data = b"\n".join(texts).lower()
    raw = np.frombuffer(data + b"\n" + bytes(8), np.uint8)
    space = _SPACE[raw[: len(data) + 1]]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.append(0, edges)
    starts, ends = edges[0::2], edges[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    sizes = np.diff(np.searchsorted(starts, begins))
    hashes = piece_hashes(raw, starts, ends - starts)
    order = np.argsort(hashes)
    hashes = hashes[order]
    cuts = spans_of_equal(hashes)
    counts = np.diff(cuts)
    words = np.empty(len(order), np.int64)
    words[order] = np.repeat(np.arange(len(counts)), counts)
    return words, sizes, hashes[cuts[:-1]], counts


def pairs_of(words: np.ndarray, sizes: np.ndarray, bos: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before and the token, for every token of every text."""
    ends = np.cumsum(sizes + 1) - 1
    after = np.full(len(words) + len(sizes), end, np.int64)
    inside = np.ones(len(after), bool)
    inside[ends] = False
    after[inside] = words
    before = np.empty(len(after), np.int64)
    before[1:] = after[:-1]
    before[ends - sizes] = bos
    return before, after


@dataclass
class Slice:
    """The tokens of some texts as ranks among the ids that occur; unknown words share a rank."""

    before: np.ndarray
    after: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray  # of each rank
    counts: np.ndarray
    bits: int  # that a rank takes

    @classmethod
    def of(cls, texts: list[bytes], trie: Trie) -> Slice:
        words, sizes, hashes, _ = numbered(texts)
        ids, counts = trie.ids(hashes)
        ids, counts = np.append(ids, [BOS, END]), np.append(counts, [trie.ends, trie.ends])
        order = np.argsort(ids, kind="stable")
        cuts = spans_of_equal(ids[order])
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        before, after = pairs_of(rank[:-2][words], sizes, int(rank[-2]), int(rank[-1]))
        heads = order[cuts[:-1]]
        return cls(before, after, sizes, ids[heads], counts[heads], max(1, int(len(heads)).bit_length()))

    def rank_of(self, token: int) -> int:
        return int(np.searchsorted(self.ids, token))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and for each key its place among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    cuts = spans_of_equal(ordered)
    places = np.empty(len(keys), np.int64)
    places[order] = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    return ordered[cuts[:-1]], places


def _count_words(docs: DataFrame, text_col: str, segments: int) -> DataFrame:
    """Blocks of (hash, count) for each vocabulary segment, and of text counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = texts = 0

        def release() -> pa.RecordBatch:
            k, c = merged(keys, counts)
            segment = ((k >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64)
            cuts = spans_of_equal(segment)
            return block_rows([("words", int(segment[lo]), pack(k[lo:hi], c[lo:hi])) for lo, hi in zip(cuts[:-1], cuts[1:])])

        for batch in slices(batches, 0):
            _, sizes, hashes, times = numbered(utf8_values(batch.column(0)))
            texts += len(sizes)
            keys.append(hashes)
            counts.append(times)
            held += len(hashes)
            if held > HELD:
                yield release()
                keys, counts, held = [], [], 0
        yield release()
        yield block_rows([("texts", 0, pack(np.array([texts])))])

    return arrow_map(docs, [text_col], run, BLOCK)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS, order: int = 2) -> Trie:
    """Learn from all rows of ``docs``; the trie lies in the shared folder.

    A null text is an empty one, which is an end without words; repeated rows
    count as often as they stand; of an empty table nothing is learnt.
    """
    if order not in ORDERS:
        raise ValueError(f"the order is one of {ORDERS}")
    spark = docs.sparkSession
    folder = scratch_path(spark, "trie")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    guess = max(1, -(-size // (6 * segment_tokens)))

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for k, blocks in by_segment(batches):
            texts = sum(int(unpack(b, 1)[0][0]) for kind, b in blocks if kind == "texts")
            parts = [unpack(b, 2) for kind, b in blocks if kind == "words"]
            hashes, counts = merged([p[0] for p in parts], [p[1].astype(np.int64) for p in parts])
            # The rank of a word in its segment by count, the most frequent first.
            rank = np.empty(len(counts), np.int32)
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
            write_arrays(f"{folder}/words-{k:06d}", [*EliasFano.build(hashes).arrays(), counts.astype(np.int64), rank])
            out.append((k, len(hashes), int(counts.sum()), texts))
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["segment", "types", "tokens", "texts"])

    counted = owned(_count_words(docs, text_col, guess), guess)
    sizes = stash(counted.mapInArrow(write_words, "segment long, types long, tokens long, texts long"), "sizes")
    written = {r[0] for r in sizes.select("segment").collect()}  # one number for each segment
    for k in set(range(guess)) - written:
        write_arrays(f"{folder}/words-{k:06d}", [*EliasFano.build(np.zeros(0, _U)).arrays(), np.zeros(0, np.int64), np.zeros(0, np.int32)])
    types, largest, words, ends = (x or 0 for x in sizes.agg(F.sum("types"), F.max("types"), F.sum("tokens"), F.sum("texts")).first())
    if (largest + 1) * guess >= 1 << 31:
        raise ValueError("more than 2^31 distinct words")
    tokens = words + ends
    trie = Trie(folder, guess, max(1, -(-tokens // segment_tokens)), order, tokens, types + bool(ends), ends)
    widths = {r[0]: r[1] for r in sizes.select("segment", "types").collect()}
    _build_pairs(docs, trie, text_col, widths)
    return trie


def _triples(s: Slice, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (u, v, the token after) as ids with their times, in order; NONE after the end."""
    bits, end = s.bits, s.rank_of(END)
    after = np.zeros(len(s.after), np.int64)
    if order > 2:
        after[:-1] = np.where(s.after[:-1] == end, 0, s.after[1:] + 1)
    wide = bits + 1  # the token after, one up, so that 0 is none
    if 2 * bits + wide <= 63:
        key = np.sort((s.before << bits | s.after) << wide | after)
        cuts = spans_of_equal(key)
        key, times = key[cuts[:-1]], np.diff(cuts)
        pair, x = key >> wide, key & ((1 << wide) - 1)
    else:
        pairs, places = distinct(s.before << bits | s.after)
        key = np.sort(places << wide | after)
        cuts = spans_of_equal(key)
        key, times = key[cuts[:-1]], np.diff(cuts)
        pair, x = pairs[key >> wide], key & ((1 << wide) - 1)
    with_none = np.append(NONE, s.ids)
    return pair >> bits, pair & ((1 << bits) - 1), with_none[x], times


def _build_pairs(docs: DataFrame, trie: Trie, text_col: str, widths: dict[int, int]) -> None:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        size = 0

        def release() -> pa.RecordBatch:
            rows = []
            for k, parts in held.items():
                u, v, x, times = (np.concatenate(c) for c in zip(*parts))
                pair, x, times = _sum_triples(_joined(u, v), x, times)
                rows.append(("pairs", k, pack(*_parted(pair), x, times)))
            return block_rows(rows)

        for batch in slices(batches, 0):
            s = Slice.of(utf8_values(batch.column(0)), trie)
            u, v, x, times = _triples(s, trie.order)
            segment = trie.segment_of_pair(s.ids[u], s.ids[v], s.counts[u])
            order = np.argsort(segment, kind="stable")
            cuts = spans_of_equal(segment[order])
            u, v = s.ids[u], s.ids[v]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                rows = order[lo:hi]
                held.setdefault(int(segment[rows[0]]), []).append([c[rows].astype(np.int32) for c in (u, v, x)] + [times[rows]])
            size += len(u)
            if size > HELD:
                yield release()
                held, size = {}, 0
        yield release()

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, blocks in by_segment(batches):
            arrays, u, v, times2, times3 = _segment_arrays((unpack(b, 4) for _, b in blocks), trie.order)
            write_arrays(f"{trie.folder}/pairs-{k:06d}", arrays)
            del arrays
            few = [int((t == c).sum()) for t in (times2, times3) for c in (1, 2)]
            rows = [("stats", k, pack(np.array([0]), *(np.array([x]) for x in [*few, len(times2)])))]
            by = np.argsort(v, kind="stable")
            cuts = spans_of_equal(v[by])
            rows += _dealt("after", trie, v[by][cuts[:-1]], [np.diff(cuts)])
            cuts = spans_of_equal(u)
            rows += _dealt("context", trie, u[cuts[:-1]], [np.add.reduceat(times2, cuts[:-1]), np.diff(cuts)])
            yield block_rows(rows)

    counted = owned(arrow_map(docs, [text_col], count, BLOCK), trie.pair_segments)
    sums = stash(counted.mapInArrow(write_pairs, BLOCK), "sums")
    # One short block for each segment of pairs.
    stats = sums.where("kind = 'stats'").select("segment", "block").collect()
    one2, two2, one3, two3, trie.pair_types = np.sum([[int(c[0]) for c in unpack(r[1], 6)[1:]] for r in stats] or [[0] * 5], axis=0).tolist()
    discount = lambda n1, n2: min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
    trie.discounts = (0.75, discount(one2, two2), discount(one3, two3))
    empty = _segment_arrays([], trie.order)[0]
    for k in set(range(trie.pair_segments)) - {r[0] for r in stats}:
        write_arrays(f"{trie.folder}/pairs-{k:06d}", empty)

    def write_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for k, blocks in by_segment(batches):
            seen, total, kinds = (np.zeros(FIRST if k < 0 else widths[k], np.int64) for _ in range(3))
            for kind, block in blocks:
                cols = [c.astype(np.int64) for c in unpack(block, 2 if kind == "after" else 3)]
                at = trie.place_of_id(cols[0])
                if kind == "after":
                    np.add.at(seen, at, cols[1])
                else:
                    np.add.at(total, at, cols[1])
                    np.add.at(kinds, at, cols[2])
            write_arrays(f"{trie.folder}/types-{k:06d}", _type_arrays(trie, seen, total, kinds))
            done.append(k)
        yield pa.record_batch([pa.array(done, pa.int32())], ["segment"])

    parts = owned(sums.where("kind <> 'stats'"), trie.word_segments)
    done = {r[0] for r in stash(parts.mapInArrow(write_types, "segment int"), "types").collect()}
    for k in set(range(-1, trie.word_segments)) - done:
        zero = np.zeros(FIRST if k < 0 else widths.get(k, 0), np.int64)
        write_arrays(f"{trie.folder}/types-{k:06d}", _type_arrays(trie, zero, zero, zero))


def _joined(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u.astype(np.int64) << 32 | v.astype(np.int64)


def _parted(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pair >> 32, pair & 0xFFFFFFFF


def _sum_triples(pair: np.ndarray, x: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (pair, x) in order with the sums of their times."""
    order = np.lexsort((x, pair))
    pair, x = pair[order], x[order]
    cuts = spans_of_equal(pair, x)[:-1]
    sums = np.add.reduceat(times[order], cuts, dtype=np.int64) if len(cuts) else np.zeros(0, np.int64)
    return pair[cuts], x[cuts], sums


def _short(times: np.ndarray) -> np.ndarray:
    return times.astype(np.int32 if int(times.max(initial=0)) < 1 << 31 else np.int64)


def _merged_triples(parts: Iterable[list[np.ndarray]]) -> list[np.ndarray]:
    """Distinct (u, v, x) of blocks that are in order, with the sums of their times.

    Blocks are kept in 16 bytes a row and merged a range of pairs at a time: about
    PIECE rows, or those of one pair, are sorted together.
    """
    held = [(_joined(u, v), x.astype(np.int32), _short(times)) for u, v, x, times in parts if len(u)]
    if not held:
        return [np.zeros(0, np.int64)] * 4
    step = 64
    marks = np.sort(np.concatenate([pair[::step] for pair, _, _ in held]))
    bounds = np.unique(marks[PIECE // step :: PIECE // step])
    cuts = np.array([[0, *np.searchsorted(pair, bounds), len(pair)] for pair, _, _ in held])
    found: list[list[np.ndarray]] = [[], [], [], []]
    for lo, hi in zip(cuts.T[:-1], cuts.T[1:]):
        rows = [[c[i:j] for c in columns] for columns, i, j in zip(held, lo.tolist(), hi.tolist()) if i < j]
        if rows:
            pair, x, times = _sum_triples(*(np.concatenate(c) for c in zip(*rows)))
            for column, values in zip(found, (*(c.astype(np.int32) for c in _parted(pair)), x, _short(times))):
                column.append(values)
    del held
    return [np.concatenate(found.pop(0)) for _ in range(4)]


def _segment_arrays(parts: Iterable[list[np.ndarray]], order: int) -> tuple[list[np.ndarray], ...]:
    """The arrays of a segment of the trie, its pairs, and the times of pairs and triples."""
    u, v, x, times = _merged_triples(parts)
    pairs = spans_of_equal(u, v)
    first = pairs[:-1]
    times2 = np.add.reduceat(times, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    kinds3 = np.diff(pairs) - (x[first] == NONE)
    below = x != NONE
    u, v, x, times3 = u[first], v[first], x[below], times[below]
    del times, below, pairs, first
    contexts = spans_of_equal(u)
    ef = lambda values: EliasFano.build(values).arrays()
    arrays = [*ef(u[contexts[:-1]]), *ef(contexts), *ef(_relative(v, np.diff(contexts)))]
    third = [np.zeros(1, np.int64), np.zeros(0, np.int64)] if order == 2 else [np.append(0, np.cumsum(kinds3)), _relative(x, kinds3)]
    del x
    arrays += [*ef(third[0]), *ef(third[1]), count_codes(times2), count_codes(times3), count_codes(kinds3)]
    return arrays, u, v, times2, times3


def _dealt(kind: str, trie: Trie, ids: np.ndarray, values: list[np.ndarray]) -> list[tuple[str, int, bytes]]:
    """Blocks of ids, in order, with values, for the vocabulary segments they lie in."""
    segment = trie.segment_of_id(ids)
    order = np.argsort(segment, kind="stable")
    cuts = spans_of_equal(segment[order])
    return [(kind, int(segment[order[lo]]), pack(ids[order[lo:hi]], *(v[order[lo:hi]] for v in values))) for lo, hi in zip(cuts[:-1], cuts[1:])]


def _type_arrays(trie: Trie, seen: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> list[np.ndarray]:
    d1, d2, _ = trie.discounts
    pairs = max(1, trie.pair_types)
    p = np.maximum(seen - d1, 0) / pairs + d1 * trie.types / pairs / (trie.types + 1)
    back = d2 * kinds / np.maximum(total, 1)
    with np.errstate(divide="ignore"):
        # The largest code stands for 0: a type that never is a context.
        return [
            quantised(np.log10(p)),
            quantised(np.where(total > 0, np.log10(np.maximum(back, 1e-16)), 0.0)),
            np.where(total > 0, count_codes(total), 65_535).astype(np.uint16),
        ]


def log_probabilities(s: Slice, trie: Trie) -> np.ndarray:
    """log10 probability of every token of a slice after those before it."""
    ids, bits = s.ids, s.bits
    known = np.flatnonzero(ids >= 0)
    p, back, total = np.full(len(ids), trie.unknown), np.zeros(len(ids)), np.zeros(len(ids))
    if trie.pair_types:
        p[known], back[known], total[known] = trie.levels(ids[known])
    pair, of_token = distinct(s.before << bits | s.after)
    u, v = pair >> bits, pair & ((1 << bits) - 1)
    segment, node = trie.pairs(ids[u], ids[v], s.counts[u])
    code2, kinds3 = trie.read(segment, node, _COUNT2, _KINDS3)
    met = node >= 0
    held = np.where(met, trie.codebook(2)[code2], 0.0) / np.maximum(total[u], 1.0)
    second = np.where(total[u] > 0, held + 10.0 ** (back[u] + p[v]), 10.0 ** p[v])
    if trie.order == 2:
        return np.log10(second)[of_token]
    # Tokens behind a pair: all but the first of each text.
    behind = np.flatnonzero(s.before != s.rank_of(BOS))
    context = of_token[behind - 1]
    triple, of_behind = distinct(context << bits | s.after[behind])
    context, w = triple >> bits, triple & ((1 << bits) - 1)
    cuts = spans_of_equal(context)
    heads = context[cuts[:-1]]
    code3 = trie.triples(np.where(met, segment, -1)[heads], node[heads], np.diff(cuts), ids[w])
    whole = np.where(met, _COUNTS[code2], 0.0)[context]
    lower = second[_place_of(pair, v[context] << bits | w)]
    third = (np.where(code3 >= 0, trie.codebook(3)[np.maximum(code3, 0)], 0.0) + trie.discounts[2] * _COUNTS[kinds3][context] * lower) / np.maximum(whole, 1.0)
    out = np.log10(second)[of_token]
    out[behind] = np.log10(np.where(whole > 0, third, lower))[of_behind]
    return out


def _place_of(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(ordered, keys)


def score(docs: DataFrame, trie: Trie, smoothing: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    A null or empty text is the end alone.  Null ids pass through; repeated
    rows give repeated rows.
    """
    floor = trie.tokens + smoothing * (trie.types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            s = Slice.of(utf8_values(batch.column(1)), trie)
            starts = np.cumsum(s.sizes + 1) - (s.sizes + 1)
            base = np.log10((s.counts + smoothing) / floor)
            add = lambda x: np.add.reduceat(x, starts)
            yield pa.record_batch(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(s.sizes + 1),
                    pa.array(add((s.counts[s.after] > 0).astype(np.int64))),
                    pa.array(np.full(len(s.sizes), trie.tokens, np.int64)),
                    pa.array(add(base[s.after])),
                    pa.array(add(log_probabilities(s, trie))),
                ],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return arrow_map(docs, [id_col, text_col], run, schema)


def held_out_scores(docs: DataFrame, folds: int = 10, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by a trie of the rows outside the held-out fold."""
    trie = build(docs.where(trains(id_col, folds)), id_col, text_col, order=order)
    found = score(docs, trie, id_col=id_col, text_col=text_col)
    return found.select("doc_id", (~trains("doc_id", folds)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
