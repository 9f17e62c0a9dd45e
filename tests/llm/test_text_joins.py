"""Jaccard join and removal of repeats against brute force, with nulls, empty and long texts, copies and hot groups."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tidelog.llm import jaccard, repeats
from tidelog.llm.components import components


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < k else zip(*[w[i:] for i in range(k)]))


def brute_components(texts, k, percent):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i, s in sets.items() if s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_texts(seed=1):
    rng = random.Random(seed)
    texts = {}
    base = [words(rng, rng.randrange(3, 120)) for _ in range(25)]
    passage = words(rng, 30)
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        texts[i] = " ".join(w) + (" " + passage if i % 3 == 0 else "")
    hot = words(rng, 80)
    for i in range(200, 320):
        w = hot.split()
        w[rng.randrange(80)] = f"y{i}"
        texts[i] = " ".join(w) if i % 4 else hot
    texts |= {900: None, 901: "", 902: " \n ", 903: "one two", 904: "ONE  two", 905: "É x", 906: "é x", 907: words(rng, 5000), 908: "a a a a a a a a"}
    return texts


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 256), (5, 80, 16)])
def test_jaccard_is_exact(spark, k, percent, block):
    texts = near_texts(k)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, component_id string")
    got = jaccard.jaccard_components(docs, k, percent, bucket_tokens=2000, block=block)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(texts, k, percent)


def test_jaccard_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert jaccard.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    got = jaccard.jaccard_components(spark.createDataFrame([(3, "a b c d e f g"), (3, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "q"), (5, "z"), (5, "a b c d e f g")], schema))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(3, 3, 1), (3, 3, 1), (1, 3, 1), (None, 3, 1), (None, 1, None), (5, 1, 5), (5, 3, 1)], key=str)


def test_signature_tree_loses_no_candidate():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, size=rng.integers(1, 90), dtype=np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) < 0.95], rng.integers(0, 2**63, size=2, dtype=np.uint64)])) for s in sets]
    tree = jaccard.SignatureTree.of(sets, np.arange(len(sets)))
    found = set(zip(*(x.tolist() for x in tree.candidates(85)), strict=True))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in found


def test_large_parts_meet_by_blocks(spark):
    """Chains and clusters of near copies, all in one part, over many blocks: exact, and copies of one cluster cost no pairs of blocks."""
    rng = random.Random(12)
    texts, base = {}, [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(150):  # a chain, whose ends share little
        if i:
            base[rng.randrange(120)] = f"c{i}"
        texts[i] = " ".join(base)
    for c in range(4):
        other = base[:20] + [f"k{c}-{rng.randrange(10**6)}" for _ in range(100)]
        for j in range(60):
            w = list(other)
            w[rng.randrange(20, 120)] = f"e{c}-{j}"
            texts[1000 + 100 * c + j] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts, 4, 85)
    for block in (16, 40):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, 4, 85, bucket_tokens=3000, block=block).collect()} == want


def test_counts_of_hot_shingles(spark):
    """Whatever a run holds, no set's count of met shingles is below the true one, and sets that meet nothing are left out."""
    rng = random.Random(3)
    hot = words(rng, 12, 10**6)
    texts = [hot + " " + words(rng, 10, 10**6) for _ in range(300)] + [words(rng, 20, 10**6) for _ in range(50)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    keys = {jaccard._key8(jaccard.shingles(t, 4)): k for k, t in enumerate(texts)}
    for flush in (200, 10**6):
        got = {keys[r["key"]]: r["r"] for r in jaccard._repeated_counts(docs, 4, 5, 3, flush).collect()}
        assert set(got) == set(range(300)) and all(r == 9 for r in got.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (500, 499)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "crowd"), [(128, 50_000), (400, 50_000), (400, 3)])
def test_repeats_are_exact(spark, length, crowd):
    rng = random.Random(length)
    passage, edge = words(rng, 200), words(rng, 60)
    texts = [None, "", "short", "a" * 1500, "ab" * 900, "é" * 700]
    for i in range(60):
        t = words(rng, rng.randrange(20, 300), 5000)
        if i % 3 == 0:
            at = rng.randrange(len(passage) - length)
            t = t[: rng.randrange(len(t))] + passage[at : at + length + rng.randrange(-3, 250)] + t[rng.randrange(len(t)) :]
        if i % 7 == 0:
            t += edge + t[:200]
        texts.append(t)
    base = words(rng, 400, 5000)
    for i in range(25):
        w = base.split()
        w[rng.randrange(400)] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [texts[10], texts[10], base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.strip_repeats(docs, length, crowd=crowd).collect()}
    assert got == dict(enumerate(brute_repeats(texts, length)))


def test_repeats_of_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, n int"
    assert repeats.strip_repeats(spark.createDataFrame([], schema)).count() == 0
    t = words(random.Random(9), 200)
    got = repeats.strip_repeats(spark.createDataFrame([(1, t, 0), (1, t, 0), (None, t, 0), (2, "x", 0)], schema)).collect()
    assert sorted(r["n_removed"] for r in got) == [0] + [len(t)] * 3


def test_segments_overlap_by_what_a_string_needs(monkeypatch):
    raw = bytes(range(256)) * 20
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    starts = [off + s for off, x in repeats._segments(raw, 400) for s in range(len(x) - 399)]
    assert starts == list(range(len(raw) - 399))


def test_merged_transforms_equal_a_sort():
    rng = np.random.default_rng(5)
    shards = [rng.integers(1, 4, size=(n, 9)).astype(np.uint16) for n in (5, 3, 4)]
    made = [repeats.suffix_order(s) for s in shards]
    z, block = repeats.merge_transforms([b for _, b in made], 4)
    texts = [[(*row.tolist(), 0) for row in s] for s in shards]
    at, merged = [0] * 3, []
    for s in z:
        row, place = divmod(int(made[s][0][at[s]]), 10)
        at[s] += 1
        merged.append(texts[s][row][place : place + 4])
    assert merged == sorted(merged)
    assert [a == b for a, b in zip(merged, merged[1:])] == [a == b for a, b in zip(block.tolist(), block.tolist()[1:])] or all((x == y) == (p == q) or 0 in x for (x, y), (p, q) in zip(zip(merged, merged[1:]), zip(block.tolist(), block.tolist()[1:])))
