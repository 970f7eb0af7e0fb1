"""The trees are whole for each language, however many contexts the others have."""

import math
import random

import numpy as np

from veriloom.llm.language_id import ORDER, build_trees


def reference_bits(counts, text):
    """Code length under one language's counts of (context, byte), by the definition and no arrays."""

    def prob(context, byte):
        low = prob(context[1:], byte) if context else 1 / 256
        own = counts.get(context, {})
        if not own:
            return low
        size, kinds = sum(own.values()), len(own)
        if byte in own:
            return own[byte] / (size + kinds)
        rest = 1 - sum(prob(context[1:], b) if context else 1 / 256 for b in own)
        return kinds / (size + kinds) * low / rest

    data = b"\n" * ORDER + text
    return sum(-math.log2(prob(data[i - ORDER : i], data[i])) for i in range(ORDER, len(data)))


def test_a_rare_language_keeps_its_contexts():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = {"big": "".join(rng.choices(letters, k=30_000)) * 5, "rare": "the cat sat on the mat and the dog sat on the log; " * 2, "other": "le chat est sur le tapis, le chien aussi. " * 2}
    rows, counts = {}, {lang: {} for lang in texts}
    for lang, text in texts.items():
        data = b"\n" * ORDER + text.encode()
        for i in range(ORDER, len(data)):
            key = (lang, int.from_bytes(data[i - ORDER : i + 1], "big"))
            rows[key] = rows.get(key, 0) + 1
            for k in range(ORDER + 1):
                own = counts[lang].setdefault(data[i - k : i], {})
                own[data[i]] = own.get(data[i], 0) + 1
    keys = sorted(rows)
    trees = build_trees(np.array([k[0] for k in keys]), np.array([k[1] for k in keys], np.int64), np.array([rows[k] for k in keys], np.float64))
    unseen = [b"the dog sat on the mat", b"", "naïve 日本".encode(), b"le chien", b"qzx"]
    got = trees.code_lengths(unseen)
    for j, lang in enumerate(trees.langs):
        for k, text in enumerate(unseen):
            assert abs(got[k, j] - reference_bits(counts[lang], text)) <= 1e-4 * (1 + got[k, j])
