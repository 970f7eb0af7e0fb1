"""Stages of the corpus pipeline at their own settings."""

import random

import corpus_pipeline
import pyarrow as pa

from veriloom.llm.common import BATCH_BYTES, written


def kept_by_brute_force(docs, words, share):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_first_of_class_links_five_words_at_80(spark):
    """Edits in one place cost five-word shingles little, edits in many places much; some families just link, some just don't."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    docs = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, "one two three four")]
    for _ in range(8):
        base = rng.choices(vocabulary, k=rng.choice([12, 40, 90, 150, 300]))
        for _ in range(30):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8])):
                at = rng.randrange(len(text))
                text[at : at + rng.choice([0, 1, 1, 3])] = rng.choices(vocabulary, k=rng.choice([0, 1, 1, 4]))
            docs.append((len(docs), " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"] for r in corpus_pipeline.first_of_class(spark, df, "").collect()}
    want = kept_by_brute_force(docs, 5, 80)
    assert got == want and want != kept_by_brute_force(docs, 3, 90)


def test_written_bounds_batches_and_restores_the_session(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    texts = spark.createDataFrame([(k, "x" * 100_000) for k in range(100)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    got = [r["bytes"] for r in written(texts.mapInArrow(sizes, "bytes long"), "sizes").collect()]
    assert len(got) > 3 and max(got) <= BATCH_BYTES + 100_100 and sum(got) >= 10_000_000
    assert spark.conf.get(key) == own
