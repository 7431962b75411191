"""BPE and token counts against the libraries themselves."""

import hashlib

import public_tokenizers as P
import pytest

from docpipe.llm import bpe, token_counts


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_library(encoding):
    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    import random

    r = random.Random(1)
    odd = ["", " ", "aaaaaaaaaaaaaaaa", "<|endoftext|>", "don't'll", "\n\n\t  x", "日本語テキスト", "👩‍👩‍👧", "0123456789" * 50, "ab" * 3000]
    odd += ["".join(r.choice("abcde éß\n'1.") for _ in range(r.randrange(200))) for _ in range(300)]
    for text, ids in zip(odd, codec.encode_batch(odd)):
        assert ids == encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_runs_met_before_are_not_replayed_again(encoding, monkeypatch):
    """Words of every slice outlive the filling of the store, which its limit still bounds."""
    codec = bpe.MergeReplayCodec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 2_000)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 300_000)
    common = " ".join(f"qz{k}xkcommonj" for k in "abcdefgh")
    encoded = []

    class Ranks(dict):
        def get(self, word, default=None):
            if b"xkcommonj" in word:
                encoded.append(word)
            return super().get(word, default)

    codec.ranks = Ranks(codec.ranks)
    texts = [f"{common} " + " ".join(f"v{i}w{j}" for j in range(300)) for i in range(40)]
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids == encoding.encode_ordinary(text)
    times = encoded.count(b" qzbxkcommonj")
    assert times == 1
    assert codec.older and codec.held < 300_000 and len(codec.known) + len(codec.older) < 300_000 // 200


def test_runs_are_split_as_alone(encoding):
    """All runs of a slice are searched at once, white space and what regular expressions dispute among them."""
    codec = bpe.MergeReplayCodec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    runs = {" a1b!", "don't", "'", "'s", " 's", "\n", "\n\n ", " ", "  ", "\u3000", "a\x1cb", "\x1c", " \x1f", "x\x85", "é́", " ½", "\u200b", "12ab'll", "\ufeff"}
    assert codec._pre_tokens(runs) == {run: codec.split.findall(run) for run in runs}
    for text in ("".join(sorted(runs)), "\n".join(sorted(runs)), "a\x1c b \x1c\n c"):
        assert next(codec.encode_batch([text])) == encoding.encode_ordinary(text)


def test_digests_of_a_vocabulary_with_gaps(spark, tmp_path):
    """Ranks need not follow one another; empty texts have no ids."""
    import base64

    ranks = {bytes([b]): 3 * b + 5 for b in range(256)} | {b"ab": 2000, b"abc": 900}
    path = tmp_path / "gaps.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for t, k in ranks.items()))
    texts = ["abcab", "", None, "cab é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_digests(df, str(path), P.PATTERN, with_ids=True).collect():
        text = (texts[r.doc_id] or "").encode()
        assert r.decoded_sha256 == hashlib.sha256(text).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    assert bpe.replay_merges([b"abcab", b""], ranks) == [(900, 2000), ()]


def test_a_lower_rank_that_comes_up_goes_first():
    # Merging (b, c) makes "abc" possible, whose rank is below that of "bc" itself.
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"bc": 9, b"abc": 3, b"abcbc": 2}
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for word in ("abcbc", "bcabcbcbc", "xabcbcabc", "bcbcbcabcabc"):
        assert list(bpe.replay_merges([word.encode()], ranks)[0]) == library.encode_ordinary(word)


def test_documents(make, encoding):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = make()
    rows = bpe.encode_digests(df, path, P.PATTERN, with_ids=True).collect()
    wanted = sorted((encoding.encode_ordinary(r.text or ""), r.doc_id or -1) for r in df.collect())
    assert sorted((list(r.ids), r.doc_id or -1) for r in rows) == wanted
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    full = bpe.encode(df, path, P.PATTERN)
    back = bpe.decode(full, path, P.PATTERN)
    assert sorted(bytes(r.text) for r in back.collect()) == sorted((r.text or "").encode() for r in df.collect())


def test_counts(make):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    df = make()
    got = token_counts.token_counts(df, P.path("word_bpe_49k.json"), limit=300).collect()
    want = sorted((len(t.encode(r.text or "", add_special_tokens=False)), len((r.text or "").encode())) for r in df.collect())
    assert sorted((r.n_tokens, r.n_bytes) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 300) for r in got)


def test_counts_of_odd_texts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = ["a<|endoftext|>b", "<|startoftext|> x", "ΑΣ ΣΑΣ", "a b c", "é ́x", "x\x1cy", "İstanbul", "don't 'll", "ﬁ ½", "​ ﻿"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, P.path("word_bpe_49k.json")).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False)) for i, x in enumerate(odd)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none, P.path("word_bpe_49k.json")).count() == 0
    assert bpe.encode_digests(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
