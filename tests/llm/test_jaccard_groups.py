"""Large groups of the Jaccard join: indexed again instead of paired, no link lost."""

import random

import numpy as np
import pytest

from veriloom.llm import jaccard_join


def brute_force(docs, words, threshold):
    sets = {}
    for i, t in docs:
        w = t.split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1)))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("words, threshold", [(3, 90), (5, 80)])
def test_templates_with_swapped_blocks(spark, monkeypatch, words, threshold):
    """Copies of a template, in which one of a few blocks is swapped for each and each has edits of its own, so that all share entries and few link."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(threshold)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs = []
    for _ in range(2):
        base = rng.choices(vocabulary, k=120)
        blocks = [rng.choices(vocabulary, k=10) for _ in range(4)]
        for k in range(100):
            text = list(base)
            text[50:60] = blocks[k % 4]
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(text)))
    docs += [(len(docs) + k, " ".join(rng.choices(vocabulary, k=60) + docs[0][1].split()[:40])) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(df, words, threshold).collect()}
    assert got == brute_force(docs, words, threshold) and len(set(got.values())) > 60


@pytest.mark.parametrize("threshold", [80, 90])
@pytest.mark.parametrize("sets", [10, 10**6, 10**10])
def test_linked_sets_share_an_entry(threshold, sets):
    """Also where the cost puts one-deletion neighbourhoods in."""
    rng = np.random.default_rng(3)
    bands = jaccard_join.Bands(2000, sets, threshold)
    assert sets < 10**8 or any(p for p, _, _ in bands.layout)
    for n in (1, 2, 4, 5, 9, 10, 19, 40, 200, 1000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            away = bands.most_different(len(x))
            gone = rng.integers(0, away + 1)
            y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**63, away - gone, dtype=np.uint64) * np.uint64(2)]))
            common = len(np.intersect1d(x, y))
            if len(y) and 100 * common >= threshold * (len(x) + len(y) - common):
                assert len(np.intersect1d(bands.entries(x), bands.entries(y)))
                size = min(len(jaccard_join.parities(x)), len(jaccard_join.parities(y)))
                apart = np.bitwise_count(jaccard_join.folded(jaccard_join.parities(x), size) ^ jaccard_join.folded(jaccard_join.parities(y), size)).sum()
                assert apart <= len(x) + len(y) - 2 * common <= jaccard_join.most_different(len(x), len(y), threshold)


def test_runs_of_entries():
    """Batches that cut an entry mark its rows; others keep entries that several documents have."""
    import pyarrow as pa

    rows = [(1, 5), (2, 5), (2, 5), (2, 9), (3, 1), (4, 1), (4, 2), (4, 3), (4, 7), (5, 5)]
    batches = [pa.record_batch({"entry": [e for e, _ in rows[a:b]], "doc_id": [d for _, d in rows[a:b]]}) for a, b in ((0, 0), (0, 7), (7, 10))]
    got = [tuple(r.values()) for b in jaccard_join._runs(iter(batches)) for r in b.to_pylist()]
    assert got == [(1, 5, 5, True), (2, 5, 5, False), (2, 5, 9, False), (4, 1, 1, True), (4, 1, 2, True), (4, 3, 3, True), (4, 3, 7, True), (5, 5, 5, True)]


def test_clashing_names_and_repeated_ids(spark):
    rows = [(1, "a b c d", "k"), (1, "a b c d", "k"), (1, "x y z", "k"), (2, "a b c d", "k"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string")
    got = sorted(map(tuple, jaccard_join.keep_first(df).collect()), key=str)
    assert got == [(1, "a b c d", "k"), (None, None, None)]
