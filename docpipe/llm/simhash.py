"""SimHash near-duplicates by covering locality-sensitive hashing.

Every fingerprint bit is given a nonzero vector of GF(2)^(r+1), r the radius.
For each nonzero v there is one table whose mask holds the bits with odd
product with v.  The vectors of r differing bits span at most r dimensions, so
some v is orthogonal to all of them, and in its table the two fingerprints
agree on every masked bit: no pair within the radius is missed.

Work is on distinct fingerprints, so copies cost nothing further.  A bucket of
more than ``BUCKET`` fingerprints is dealt out again by the same scheme over
the bits its mask leaves free.  What is left free then is few bits, which bounds
every inner bucket by 2 to their number.  Inside a bucket a breadth-first search
yields a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, content_key, sorted_groups, stash, utf8_values, with_content_key, without_content
from .components import connected_components

#: Fingerprints of a bucket that one search takes.
BUCKET = 8_192
_CHUNK = 1 << 16


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, joined by single spaces."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[width:]]
    ends.append(len(joined))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], seed) for s, e in zip(starts, ends)), np.uint64, len(ends))


def simhash(hashes: np.ndarray) -> int:
    """Bit j is set if it is set in over half the hashes; 0 of none."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        part = hashes[lo : lo + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", with_keys: bool = False
) -> DataFrame:
    """``(doc_id, fp long)`` for every row; a text without words has 0.

    With keys, also ``k1`` and ``k2``, which stand for the row's whole content.
    """
    names = ["doc_id", "fp"] + ["k1", "k2"] * with_keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(shingle_hashes(t, width, seed)) for t in utf8_values(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), *batch.columns[2:]], names)

    own = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")]
    rows = docs.select(*own, *(content_key(docs, *docs.columns) if with_keys else []))
    return arrow_map(rows, rows.columns, run, ", ".join(f"{n} long" for n in names))


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """Masks over the given bits, one per nonzero vector of GF(2)^(radius+1)."""
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        mask = 0
        for k, bit in enumerate(bits):
            if bin((1 + k % vectors) & v).count("1") % 2:
                mask |= 1 << bit
        masks.append(mask)
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the distinct fingerprints within the radius."""
    left, a, b = fps, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), x, np.uint64))
                b.append(hit)
                queue.extend(hit)
                left = left[~near]
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


def _bucket_links(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in sorted_groups(batches, keys):
            fps = table["fp"].to_numpy().view(np.uint64)
            sizes = np.diff(cuts)
            a, b = [], []
            two = cuts[:-1][sizes == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
            a.append(fps[two][near])
            b.append(fps[two + 1][near])
            for k in np.flatnonzero(sizes > 2):
                x, y = forest(fps[cuts[k] : cuts[k + 1]], radius)
                a.append(x)
                b.append(y)
            yield pa.record_batch(
                [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"]
            )

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "fp").mapInArrow(run, "a long, b long")


def fingerprint_links(distinct: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` that connect every pair of ``distinct(fp)`` in the radius."""
    spark = distinct.sparkSession
    masks = covering_masks(radius, list(range(64)))
    keyed = distinct.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
        ).alias("k"),
    ).select("fp", "k.t", "k.key")
    # Lone keys, nearly all, go at the partial counts; the join can be split where a key is hot.
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stash(keyed.join(sizes, ["t", "key"]), "buckets")
    links = _bucket_links(shared.where(F.col("n") <= bucket), ["t", "key"], radius)
    hot = shared.where(F.col("n") > bucket)
    if hot.limit(1).count():
        inner = []
        for t, mask in enumerate(masks):
            free = [i for i in range(64) if not mask >> i & 1]
            inner += [(t, t2, _signed(m)) for t2, m in enumerate(covering_masks(radius, free))]
        # (2^(radius+1) - 1)^2 rows, whatever the input.
        table = spark.createDataFrame(inner, "t int, t2 int, mask long")
        again = hot.join(F.broadcast(table), "t").select(
            (F.col("t") * 1024 + F.col("t2")).alias("t"), "key", F.col("fp").bitwiseAND(F.col("mask")).alias("key2"), "fp"
        )
        links = links.unionByName(_bucket_links(again, ["t", "key", "key2"], radius))
    return links.distinct()


def near_duplicates(
    docs: DataFrame,
    radius: int = 3,
    width: int = 3,
    seed: int = 42,
    bucket: int = BUCKET,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, fp long, component_id)``, one row for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of fingerprints
    that differ in at most ``radius`` bits.  A text without words, null texts
    among them, has fingerprint 0 and is linked like any other.  Null ids keep
    their row and never name a component unless no other id is in it, when it
    is null.  Repeated rows give repeated rows.
    """
    prints = stash(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    by_print = _of_components(classes, F.min("low").alias("component_id"), radius, bucket)
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def _of_components(classes: DataFrame, summary: F.Column, radius: int, bucket: int) -> DataFrame:
    """For each fingerprint of ``classes(fp, ...)`` the summary of its component."""
    roots = connected_components(fingerprint_links(classes.select("fp"), radius, bucket))
    labelled = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = labelled.groupBy("root").agg(summary)
    return labelled.select("fp", "root").join(named, "root").drop("root")


def fingerprint_hex(fp) -> F.Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(
    docs: DataFrame,
    radius: int = 3,
    width: int = 3,
    seed: int = 42,
    bucket: int = BUCKET,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of each component, all its columns.

    It is the row with the smallest id; rows without an id come last, and rows
    of one id are told apart by a 128-bit hash of their content.  Of rows equal in
    all columns one stays.  Components are those of :func:`near_duplicates`, so a
    null text is an empty one; an empty table gives an empty one.  Columns of any
    name may stand beside the id and the text.
    """
    prints = stash(fingerprints(docs, width, seed, id_col, text_col, with_keys=True), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    classes = prints.groupBy("fp").agg(F.min(row).alias("low"))
    kept_row = _of_components(classes, F.min("low").alias("low"), radius, bucket)
    lost = ~((F.col("k1") == F.col("low.k1")) & (F.col("k2") == F.col("low.k2")))
    rows = prints.join(kept_row, "fp").groupBy("k1", "k2").agg(F.max(lost).alias("lost"), F.count(F.lit(1)).alias("n"))
    marked = stash(rows.where("lost or n > 1"), "copies")
    kept = without_content(docs, marked.where("lost"), *docs.columns)
    again = marked.where("not lost")
    if not again.limit(1).count():
        return kept
    twins = with_content_key(kept, *kept.columns).join(again, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
    return without_content(kept, again, *kept.columns).unionByName(twins)
