"""SimHash, components, suffix removal and decontamination against brute force."""

import collections
import itertools
import random

import numpy as np
import pytest
import xxhash

from docpipe.llm import components, decontaminate, simhash, suffix_dedup


def plain_simhash(text: str) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_covering_masks():
    masks = simhash.covering_masks(3, list(range(64)))
    r = random.Random(2)
    for _ in range(2000):
        bits = sum(1 << b for b in r.sample(range(64), r.randrange(4)))
        assert any(not m & bits for m in masks)
    assert all(bin(m).count("1") >= 30 for m in masks)


@pytest.mark.parametrize("bucket", [8192, 2])
def test_near_duplicates(make, bucket):
    df = make()
    rows = [(r.doc_id, plain_simhash(r.text)) for r in df.collect()]
    fps = sorted({f for _, f in rows})
    root = groups(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    low = collections.defaultdict(list)
    for i, f in rows:
        low[root[f]].append(i)
    want = sorted((i if i is not None else -1, f"{f:016x}", min((x for x in low[root[f]] if x is not None), default=None)) for i, f in rows)
    found = simhash.near_duplicates(df, bucket=bucket).withColumn("hex", simhash.fingerprint_hex("fp"))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.hex, r.component_id) for r in found.collect()) == want


def test_dense_bucket(spark):
    """Many fingerprints around one: buckets beyond the limit are dealt again."""
    r = random.Random(3)
    fps = {0x0123456789ABCDEF ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for _ in range(400)}
    df = spark.createDataFrame([(np.int64(np.uint64(f)).item(),) for f in fps], "fp long")
    want = groups(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    for bucket in (8, 8192):
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.fingerprint_links(df, bucket=bucket).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        assert groups(fps, links) == want


def test_drop_near_duplicates(make):
    df = make()
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, c in comp.items() if i is not None and c == i})
    assert ids.count(None) == 1


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame(links, "a long, b long")
    nodes = {x for l in links if l[0] != l[1] for x in l}
    assert {x.node: x.root for x in components.connected_components(df).collect()} == groups(nodes, [l for l in links if l[0] != l[1]])
    assert components.connected_components(df.limit(0)).count() == 0


def covered(texts):
    count = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                mark[i : i + 200] = True
        out.append(mark)
    return out


@pytest.mark.parametrize("segment_bytes", [6_000, 1 << 30])
def test_suffix_dedup(make, monkeypatch, segment_bytes):
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", segment_bytes)
    monkeypatch.setattr(suffix_dedup, "RUN_SEGMENT_BYTES", 2 * segment_bytes)
    df = make()
    raw = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    marks = covered([t for _, t in raw])
    want = sorted((i if i is not None else -1, *suffix_dedup._digest_row(t, m if m.any() else None)[:4]) for (i, t), m in zip(raw, marks))
    got = suffix_dedup.without_repeats(df)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert sum(m.sum() for m in marks) > 1000


def test_places_and_fingerprints_across_seams(monkeypatch):
    """Where a long text is cut for the work has no part in its places and fingerprints."""
    r = random.Random(7)
    text = np.frombuffer(bytes(r.choice(b"abcdefgh  ") for _ in range(70_000)) + b"a" * 60_000 + bytes(r.choice(b"xy") for _ in range(5_000)), np.uint8)
    places = suffix_dedup.cut_places(text)
    monkeypatch.setattr(suffix_dedup, "_CUT", 1 << 15)
    assert (suffix_dedup.cut_places(text) == places).all()
    big = np.concatenate([text] * 9)
    starts = np.array([0, 5, len(text), len(text) + 5, 8 * len(text) + 5])
    a, b = suffix_dedup.substring_hashes(big, starts, starts + 200)
    assert a[0] == a[2] and b[0] == b[2] and a[1] == a[3] == a[4] and b[1] == b[3] == b[4] and a[0] != a[1] and b[0] != b[1]


def test_suffix_dedup_of_long_texts(spark):
    """Repeats that cross the cuts of a long text, and stretches of one character."""
    r = random.Random(17)
    noise = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    shared, other = noise(900), noise(350)
    texts = [noise(59_700) + shared + noise(3_000), noise(10) + shared[200:700] + noise(10), noise(119_800) + other + "z" * 1_500, other[:199], other[100:330] + "z" * 260]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [t.encode() for t in texts]
    want = [(i, *suffix_dedup._digest_row(t, m if m.any() else None)[:4]) for i, (t, m) in enumerate(zip(raw, covered(raw)))]
    assert sorted(map(tuple, suffix_dedup.without_repeats(df).collect())) == want


def test_stripped_texts(make):
    """What is left of each text against brute force on bytes; characters cut in two go whole."""
    df = make()
    rows = df.collect()
    marks = covered([(r.text or "").encode() for r in rows])
    want = [None if r.text is None else bytes(np.frombuffer(r.text.encode(), np.uint8)[~m]).decode("utf-8", "ignore") for r, m in zip(rows, marks)]
    assert sorted(map(str, want)) == sorted(str(r.text) for r in suffix_dedup.strip_repeats(df).collect())


def test_suffix_sort_orders_suffixes(spark):
    """Ranks of the difference cover against sorting the suffixes themselves."""
    from docpipe.llm.blocks import read_arrays, write_arrays
    from docpipe.llm.common import scratch_path

    r = np.random.default_rng(1)
    folder = scratch_path(spark, "sort-test")
    parts = [np.append(r.integers(1, 4, n).astype(np.uint64) << np.uint64(40), np.uint64(0)) for n in (50, 1, 37)]
    for k, x in enumerate(parts):
        write_arrays(f"{folder}/runs/{k:06d}", [x] * 6)
    suffix_dedup.SuffixSort(spark, folder, 3, 4).run()
    suffixes = []
    for k, x in enumerate(parts):
        ranks = read_arrays(f"{folder}/rank0/{k:06d}")[0]
        suffixes += [(int(ranks[i]), tuple(x[i:].tolist())) for i in range(len(x)) if x[i]]
    by_rank = [s for _, s in sorted(suffixes, key=lambda p: p[0])]
    assert [s[:25] for s in by_rank] == sorted(s[:25] for s in by_rank)


def test_strip_repeats(make):
    df = make()
    out = suffix_dedup.strip_repeats(df)
    assert out.schema == df.schema and out.count() == df.count()
    assert out.where("text is null").count() == df.where("text is null").count()


@pytest.fixture
def bench(spark, texts):
    items = [(1, texts[0]), (2, texts[5] + " and some more words of its own"), (3, "too short"), (4, None), (5, texts[41])]
    return spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")


def plain_tiles(item, doc, m):
    """Greedy string tiling by comparing every pair of places."""
    a, b, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = []
        top = m
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > top:
                    best, top = [(i, j)], k
                elif k == top:
                    best.append((i, j))
        if not best:
            return total
        for i, j in best:
            if not any(a[i : i + top]) and not any(b[j : j + top]):
                a[i : i + top] = [True] * top
                b[j : j + top] = [True] * top
                total += top


def test_tiling_against_all_pairs():
    r = random.Random(8)
    for _ in range(150):
        item = [r.randrange(1, 4) for _ in range(r.randrange(4, 25))]
        doc = [r.randrange(1, 4) for _ in range(r.randrange(60))]
        tiles = decontaminate.greedy_tiles(np.array(item), np.array(doc), np.ones(len(doc), bool), 4)
        for i, d, k in tiles:
            assert item[i : i + k] == doc[d : d + k] and k >= 4
        places = [x for i, _, k in tiles for x in range(i, i + k)]
        assert len(places) == len(set(places))
        assert abs(len(places) - plain_tiles(item, doc, 4)) <= 4


def test_tiling_equals_all_pairs():
    """The very words that plain greedy tiling covers, in number, over small alphabets and repeated words."""
    r = random.Random(18)
    for n in range(400):
        letters = r.choice([1, 2, 3, 5])
        item = [r.randrange(1, letters + 1) for _ in range(r.randrange(1, 25))]
        doc = [r.randrange(0, letters + 1) for _ in range(r.randrange(60))]
        width = r.choice([2, 4, 5])
        tiles = decontaminate.greedy_tiles(np.array(item), np.array(doc, np.int64), np.array([x > 0 for x in doc], bool), width)
        assert sum(k for _, _, k in tiles) == plain_tiles(item, [x if x else -j for j, x in enumerate(doc, 1)], width)


def test_tiling_of_one_repeated_word():
    tiles = decontaminate.greedy_tiles(np.ones(3_000, np.int64), np.ones(40_000, np.int64), np.ones(40_000, bool), 5)
    assert tiles == [(0, 0, 3_000)]


def test_short_items_leak_whole(spark, make):
    items = spark.createDataFrame([(1, "zebra crossing"), (2, "Quagga"), (3, ""), (4, None)], "item_id long, text string")
    docs = make([(1, "at the ZEBRA crossing we met", "en", "s", 1), (2, "crossing zebra", "en", "s", 1), (3, "a quagga stood", "en", "s", 1)])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(1, 1), (3, 2)}


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_leaks(spark, make, bench, texts, block_bytes):
    halves = texts[0].split()
    mixed = " ".join(halves[len(halves) // 2 :] + ["between"] + halves[: len(halves) // 2])
    rows = [(0, texts[0], "en", "s", 1), (7, mixed, "en", "s", 1), (8, texts[30], "en", "s", 1), (9, "a b " + texts[41].upper(), "en", "s", 1)]
    found = decontaminate.leaks(make(rows), bench, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 1), (7, 1), (9, 5)}
    assert all(r.coverage >= 0.5 for r in found)
    kept = decontaminate.drop_leaked(make(rows), bench)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 8, 900]
    assert decontaminate.leaks(make([]), bench).count() == 0


def test_leaks_in_capitals_of_any_script(spark, make):
    """Passages in capitals, with accents, a sharp s and a final sigma among them."""
    passages = ["Où était passé l'été où nous avions mangé", "Größe und Straße müßten süß für Ärzte klingen", "Где живёт ёжик который любит яблоки", "ο δρόμος προς τον ουρανό είναι μακρύς τους"]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    docs = make([(i, "before it " + p.upper(), "xx", "s", 1) for i, p in enumerate(passages)])
    found = decontaminate.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.coverage) for r in found} == {(i, i, 1.0) for i in range(len(passages))}


def test_folding_keeps_bytes_that_are_no_text():
    assert decontaminate.folded(b"\xff\xed\xa0\x80A \xc3\x89\xc2\xa0B") == [b"\xff\xed\xa0\x80a", b"\xc3\xa9\xc2\xa0b"]
