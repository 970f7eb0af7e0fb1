"""The source audit against plain dictionaries, on odd rows, long terms, small tries and blocks of sources."""

import random
import re
from collections import Counter

import pytest

from veriloom.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
KIND = "doc_id long, text string, lang string, source string, value long"


def plain(rows, least, top=10):
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted((t for t in seen if seen[t] >= least), key=str.encode)
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if seen[t] >= least) for s in {d[1] for d in docs if d[0] == lang}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in p if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, held in (("pair", pairs), ("term", sorted(terms)[:top])) for k, (v, i) in enumerate(sorted(held))]
    return sorted(out)


def rows_of(rng, n):
    words = ["The", "the", "don't", "naïve", "ÄÖ", "äö", "x1y", "日本", "日本語", "é", "e", "z" * 64, "z" * 65, "z" * 64 + "yy", "ab" * 40, "a", "aa", "aaaaaaaa", "aaaaaaaab", "rare%d"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30))).replace("%d", str(k)), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S1", "é", None]), 1) for k in range(n)]
    return [*rows, rows[0], (None, None, "fr", "s1", None), (7, "", "fr", "s2", 2), (8, "q" * 300_000 + " " + "a " * 50_000, "en", "s1", 3)]


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_equals_plain_counts(spark):
    rows = rows_of(random.Random(4), 150)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    assert got(source_audit.audit(df, least_docs=5)) == plain(rows, 5)
    assert got(source_audit.audit(df, least_docs=10**6)) == plain(rows, 10**6)
    assert got(source_audit.audit(df.where("false"))) == []


def test_small_tries_slices_and_blocks(spark, monkeypatch):
    """Tries that are sent on early, slices of three terms, two sources a block, and totals that aren't broadcast."""
    for name, value in (("ENTRIES", 20), ("SLICE", 3), ("BLOCK", 2), ("CELLS", 4)):
        monkeypatch.setattr(source_audit, name, value)
    monkeypatch.setattr("veriloom.llm.common.BROADCAST_BYTES", 0)
    rows = rows_of(random.Random(5), 120)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert got(source_audit.audit(df, least_docs=4, top=3)) == plain(rows, 4, 3)


@pytest.mark.parametrize("seed", range(3))
def test_leaves_are_in_order(seed):
    """Many terms that share prefixes around the levels' eight bytes."""
    import numpy as np

    rng = random.Random(seed)
    terms = [rng.choice("ab") * rng.choice([0, 1, 7, 8, 9, 15, 16, 63, 64, 65, 80]) + rng.choice(["", "a", "é", "zz"]) or "a" for _ in range(500)]
    texts = [t.encode() for t in terms]
    trie = source_audit.Trie.of(texts, np.zeros(len(texts), np.int64))
    want = Counter(terms)
    assert trie.terms().to_pylist() == sorted(want, key=str.encode) and trie.count.tolist() == [want[t] for t in trie.terms().to_pylist()]
    both = source_audit.Trie.merged([trie, source_audit.Trie.of([b"new zz", b"a"], np.array([1, 0]))])
    assert both.terms().to_pylist() == sorted({*want, "new", "zz", "a"}, key=str.encode) and both.count.sum() == len(terms) + 3


def test_shares_are_exact():
    import numpy as np

    rng = random.Random(1)
    for _ in range(2000):
        total = rng.randint(2, 9 * 10**15 - 1)
        count = rng.randint(0, total - 2)
        assert source_audit.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 2) // total
