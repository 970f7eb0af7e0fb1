"""Short benchmark texts with edits, against a budget of a tenth of their bytes that is counted here."""

import random

from veriloom.llm import decontamination


def fewest_edits(want, text):
    row = [0] * (len(text) + 1)
    for a in want:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edited_short_items(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    sizes = [*range(3, 24), *range(24, 82, 3), 79]
    items = [(k, "".join(rng.choices(letters, k=n))) for k, n in enumerate(sizes)]
    docs = []
    for _, item in items:
        for edits in {0, 1, len(item) // 10, len(item) // 10 + 1}:
            text = list(item)
            # Spread as evenly as they go, so that the pieces left are as short as can be.
            for at in sorted((round((k + 1) * (len(text) + 1) / (edits + 1)) - 1 for k in range(edits)), reverse=True):
                text[at : at + rng.choice([0, 1])] = rng.choice(["_", "_", "-"])
            docs.append((len(docs), "".join(rng.choices(letters, k=12)) + "".join(text).upper() + "".join(rng.choices(letters, k=9))))
    want = {}
    for i, text in docs:
        for j, item in items:
            n = fewest_edits(item, text.lower())
            if 10 * n <= len(item):
                want[i, j] = n
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.contaminated(d, b).collect()}
    assert got == want and {len(items[j][1]) for (_, j), n in want.items() if n} >= {n for n in sizes if n >= 10}
    assert {r["doc_id"] for r in decontamination.keep_clean(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}
