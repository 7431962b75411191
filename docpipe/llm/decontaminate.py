"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared only where they share a seed, a
run of ``min_match`` equal words.  Seeds are rolling Karp-Rabin hashes.  For a
candidate pair, running Karp-Rabin matching finds the longest common runs of
unmarked words, marks them as tiles, and goes on with shorter runs until none
of ``min_match`` words is left.  The item counts as leaked if tiles cover at
least ``coverage`` of its words, in whatever order they stand in the document.

The benchmark is cut into blocks of at most ``BLOCK_BYTES``; each block is
broadcast and meets all documents where they lie.  Documents are not shuffled.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_batches, utf8_values

MIN_MATCH = 5
COVERAGE = 0.5
#: Text of the benchmark that one broadcast carries.
BLOCK_BYTES = 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "doc_id long, item_id long, n_words long, n_covered long, n_tiles long, coverage double"


def folded(text: bytes) -> list[bytes]:
    """The words of a text with the case of all scripts folded; bytes that are no UTF-8 stay as they are."""
    if not text.isascii():
        text = text.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
    return text.lower().split()


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all runs of ``width`` ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * _BASE + ids[j : j + n].astype(np.uint64)
    return h


def _free_runs(marked: np.ndarray, width: int) -> np.ndarray:
    """Starts of the runs of ``width`` unmarked positions."""
    if len(marked) < width:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[width:] == total[:-width])


def common_runs(item: np.ndarray, doc: np.ndarray, free: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """``(length, item start, doc start)`` of all longest common runs of ``width`` words or more.

    Rolling hashes find where a run of the item stands in the document; runs that
    go on from one place of the item to the next are one.  Time follows the pairs of places
    in the worst case, texts of one repeated word, memory the document alone.
    """
    there = _free_runs(~free, width)
    hashes = rolling(doc, width)[there]
    order = np.lexsort((there, hashes))
    hashes, there = hashes[order], there[order]
    found: list[tuple[int, int, int]] = []
    running = np.zeros(0, np.int64)  # document places of the runs that are still going on
    begun = np.zeros(0, np.int64)  # item places where they began
    for i, h in enumerate(rolling(item, width).tolist()):
        lo, hi = np.searchsorted(hashes, np.uint64(h), "left"), np.searchsorted(hashes, np.uint64(h), "right")
        now = there[lo:hi]
        now = now[(doc[now[:, None] + np.arange(width)] == item[i : i + width]).all(axis=1)] if len(now) else now
        on = np.isin(running + 1, now, assume_unique=True)
        found += [(i - int(b) + width - 1, int(b), int(d) - (i - 1 - int(b))) for d, b in zip(running[~on], begun[~on])]
        starts = np.full(len(now), i, np.int64)
        starts[np.searchsorted(now, running[on] + 1)] = begun[on]
        running, begun = now, starts
    last = len(item) - width
    found += [(last - int(b) + width, int(b), int(d) - (last - int(b))) for d, b in zip(running, begun)]
    return found


def greedy_tiles(item: np.ndarray, doc: np.ndarray, free: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles ``(item start, doc start, length)``, longest first, then by item and document.

    ``free`` tells which words of the document may be matched at all.  What marked
    tiles leave of a run goes back among the runs, so that at each step the
    longest one that is wholly free is marked.
    """
    if len(item) < min_match:
        return []
    queue = [(-k, i, d) for k, i, d in common_runs(item, doc, free, min_match)]
    heapq.heapify(queue)
    item_marked, doc_marked = np.zeros(len(item), bool), ~free
    tiles: list[tuple[int, int, int]] = []
    while queue:
        k, i, d = heapq.heappop(queue)
        taken = item_marked[i : i - k] | doc_marked[d : d - k]
        if taken.any():
            step = np.diff(np.concatenate([[1], taken.astype(np.int8), [1]]))
            for lo, hi in zip(np.flatnonzero(step == -1).tolist(), np.flatnonzero(step == 1).tolist()):
                if hi - lo >= min_match:
                    heapq.heappush(queue, (lo - hi, i + lo, d + lo))
            continue
        item_marked[i : i - k] = True
        doc_marked[d : d - k] = True
        tiles.append((i, d, -k))
        if not len(_free_runs(item_marked, min_match)):
            break
    return tiles


class Block:
    """Words, seeds and items of one block of the benchmark.

    Items shorter than ``min_match`` are one seed each, of their whole length.
    """

    def __init__(self, items: list[tuple[int, bytes]], min_match: int):
        self.min_match = min_match
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = folded(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
            number = len(self.items)
            self.items.append((item_id, ids))
            width = min(min_match, len(ids))
            for i, h in enumerate(rolling(ids, width).tolist()):
                seeds[width][h].append((number, i))
        self.seeds = {width: (np.array(sorted(own), np.uint64), [own[h] for h in sorted(own)]) for width, own in seeds.items()}

    def compare(self, text: bytes, coverage: float) -> Iterator[tuple[int, int, int, int]]:
        """``(item, words, covered words, tiles)`` of each item that leaked."""
        if not self.seeds:
            return
        get = self.vocabulary.get
        doc = np.array([get(w, 0) for w in folded(text)], np.int64)
        for width, (known, places_of) in self.seeds.items():
            runs = _free_runs(doc == 0, width)
            if not len(runs):
                continue
            hashes = rolling(doc, width)[runs]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            by_item: dict[int, tuple[set[int], list[int]]] = {}
            for s, d in zip(at[hit].tolist(), runs[hit].tolist()):
                for number, i in places_of[s]:
                    places = by_item.setdefault(number, (set(), []))
                    places[0].add(i)
                    places[1].append(d)
            for number, (here, there) in by_item.items():
                item_id, item = self.items[number]
                reach = np.zeros(len(item), bool)
                for i in here:
                    reach[i : i + width] = True
                # Tiles lie within shared seeds, so this bounds what they can cover.
                if reach.sum() < coverage * len(item):
                    continue
                free = np.zeros(len(doc), bool)
                for d in set(there):
                    free[d : d + width] = True
                tiles = greedy_tiles(item, doc, free, width)
                covered = sum(k for _, _, k in tiles)
                if covered >= coverage * len(item):
                    yield item_id, len(item), covered, len(tiles)


_blocks: dict[str, Block] = {}  # the worker's last block


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, n_words, n_covered, n_tiles, coverage)`` of each leak.

    One row for each document row and item that leaked into it; documents
    without a leak give none.  An item of fewer than ``min_match`` words leaks
    where it stands whole; items without a word, null texts among them, leak
    nowhere.  Null ids pass through; repeated rows give repeated rows.
    """
    parts = []
    for block in _benchmark_blocks(benchmark, min_match, block_bytes):
        parts.append(arrow_map(docs, [id_col, text_col], _comparer(block, coverage), _SCHEMA))
    return reduce(DataFrame.unionByName, parts)


class SharedBlock:
    """A block of the benchmark, sent to the workers as ids and texts and indexed there once."""

    def __init__(self, rows, min_match: int):
        self.rows, self.min_match, self.key = rows, min_match, uuid.uuid4().hex

    def here(self) -> Block:
        if self.key not in _blocks:
            _blocks.clear()
            _blocks[self.key] = Block(self.rows.value, self.min_match)
        return _blocks[self.key]


def _benchmark_blocks(benchmark: DataFrame, min_match: int, block_bytes: int) -> Iterator[SharedBlock]:
    """Blocks of the items, dealt by a hash, of about half ``block_bytes`` each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text"), F.octet_length("text").alias("size"))
    total = items.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r[0], (r[1] or "").encode()) for r in own.select("item_id", "text").collect()]
        yield SharedBlock(spark.sparkContext.broadcast(rows), min_match)


def _comparer(shared: SharedBlock, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.here()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1))):
                for item_id, words, covered, tiles in block.compare(text, coverage):
                    out.append((doc_id, item_id, words, covered, tiles, covered / words))
            cols = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64()] * 5 + [pa.float64()]
            names = ["doc_id", "item_id", "n_words", "n_covered", "n_tiles", "coverage"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def drop_leaked(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
    text_col: str = "text",
) -> DataFrame:
    """The rows into whose text no item leaked, all their columns.

    Each row is judged by its own text where it lies, whatever its id: of rows
    that share an id one may go and another stay.  A null text holds nothing and
    stays; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def clean(shared: SharedBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.here()
            for batch in batches:
                keep = [next(block.compare(t, coverage), None) is None for t in utf8_values(batch.column(place))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    kept = docs
    for shared in _benchmark_blocks(benchmark, min_match, block_bytes):
        kept = kept.mapInArrow(clean(shared), docs.schema)
    return kept
