"""Token counts by a two-tier lookup of whole words, without a word shuffle.

A word here is a run without ASCII white space.  The tokenizer's normaliser and
splitter never join characters across such white space, so the count of a text
is the sum over its words.  Tier one is a table of frequent words and their
token counts, broadcast as two compact blobs; tier two is a bounded store in
each worker, filled by the tokenizer itself.

The frequent words come from the whole corpus: each task counts all its words
and passes on only its most frequent ones, at most ``TASK_WORDS`` rows, so what
is shuffled does not depend on the number of words.  The table decides speed
only; counts are the same whatever it holds.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, str_values

#: Rows that a task passes on, words in the broadcast table, longest word in it.
TASK_WORDS = 4_096
TABLE_WORDS = 32_768
TABLE_WORD_CHARS = 64
#: Distinct words that a task counts at once; the rarer half goes beyond it.
TASK_COUNTER_WORDS = 400_000
#: Distinct words that a worker keeps, and the longest of them.
CACHE_WORDS = 500_000
CACHE_WORD_CHARS = 256
#: Exactly the ASCII white space at which words part.
_OTHER_BREAKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def words_of(text: str) -> list[str]:
    """Runs without space and U+0009 to U+000D; other white space stays inside."""
    return [w for w in text.translate(_OTHER_BREAKS).split(" ") if w]


def frequent_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` of at most ``TABLE_WORDS`` frequent words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in str_values(batch.column(0)):
                seen.update(words_of(text))
                if len(seen) > TASK_COUNTER_WORDS:
                    seen = Counter(dict(seen.most_common(TASK_COUNTER_WORDS // 2)))
        top = [(w, n) for w, n in seen.most_common(TASK_WORDS) if len(w) <= TABLE_WORD_CHARS]
        yield pa.record_batch(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"]
        )

    parts = arrow_map(docs, [text_col], run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TABLE_WORDS)


class _Counts(dict):
    """Token counts by word; a word that is missing is encoded and kept."""

    def __init__(self, table: tuple[bytes, bytes], tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        words = table[0].decode().split("\n") if table[0] else []
        super().__init__(zip(words, np.frombuffer(table[1], np.uint16).tolist()))
        self.frequent = len(self)
        self.frequent_items = dict(self)
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    def count(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def __missing__(self, word: str) -> int:
        n = self.count([word])[0]
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) > self.frequent + CACHE_WORDS:
                self.clear()
                self.update(self.frequent_items)
            self[word] = n
        return n


_counts: dict[str, _Counts] = {}


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row.

    Null texts count as empty: 0 bytes, 0 tokens.  Null ids pass through and
    repeated rows give repeated rows.  An empty table gives an empty one.
    Strings of special tokens inside a text are handled as the library does.
    """
    spark = docs.sparkSession
    # At most TABLE_WORDS rows of TABLE_WORD_CHARS characters: a few MB.
    frequent = [r["word"] for r in frequent_words(docs, text_col).select("word").collect()]
    own = _Counts((b"", b""), tokenizer_path)
    lengths = np.minimum(own.count(frequent), 65_535).astype(np.uint16) if frequent else np.zeros(0, np.uint16)
    table = spark.sparkContext.broadcast(("\n".join(frequent).encode(), lengths.tobytes()))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counts:
            _counts.clear()
            _counts[key] = _Counts(table.value, tokenizer_path)
        counts = _counts[key]
        for batch in batches:
            tokens, sizes = [], []
            for text in str_values(batch.column(1)):
                sizes.append(len(text.encode("utf-8", "replace")))
                tokens.append(sum(map(counts.__getitem__, words_of(text))))
            n = np.array(tokens, np.int64)
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return arrow_map(docs, [id_col, text_col], run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
