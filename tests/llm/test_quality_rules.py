"""Quality rules against plain counts, on odd rows, repeated lines and windows, and hashes that collide."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veriloom.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "line_chars": sum(map(len, lines))}
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    out |= {"n_dup_lines": len(again), "dup_line_chars": sum(map(len, again))}
    for n in (rules.WINDOW, *rules.MOST_NGRAM_CHARS):
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        times, seen, held, later = Counter(grams), set(), set(), set()
        for k, g in enumerate(grams):
            if times[g] > 1:
                held |= set(range(k, k + n))
            if g in seen:
                later |= set(range(k, k + n))
            seen.add(g)
        if n == rules.WINDOW:
            out["n_repeat_words"] = len(held)
        else:
            out[f"dup_{n}"] = sum(len(words[k]) for k in later)
    return out


def texts_of(rng, n):
    bits = ["a", "b", "a\0", "\0", "é", "日本", "#", "x|y", "word", "\n", "\n", " \n", "\r\n", "\t", "a b c d e f g", "q" * 70, "q" * 69 + "r", "\x85", " "]
    return [" ".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(n)]


def test_counts_equal_plain_ones():
    texts = ["", " ", "\n\n", "a\na\n a\na", *texts_of(random.Random(2), 300)]
    got = rules.measure([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert {c: int(v[k]) for c, v in got.items()} == plain(t), t


def test_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all words the words themselves decide."""
    monkeypatch.setattr(rules, "_mixed", lambda x: np.zeros(len(x), np.uint64))
    texts = texts_of(random.Random(3), 60)
    got = rules.measure([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert {c: int(v[k]) for c, v in got.items()} == plain(t)


def test_odd_rows_and_verdicts(spark):
    fine = " ".join(f"w{k}" for k in range(60))
    heading = "one heading of eight words stands here again"
    rows = [
        (1, None, 5), (1, None, 5), (2, "", None), (None, fine, 1), (3, fine, 1), (4, "a b c " * 30, 1), (5, " ".join(f"w{k}" for k in range(49)), 1), (6, f"{heading}\n{fine}\n{heading}", 1),
        (7, "\n".join([f"{fine} x{k}\n{' '.join(fine.split()[:25])}" for k in range(2)]), 1), (8, " ".join(f"w{k}" for k in range(200_000)), 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = rules.judge(rules.measure_repetition(df))
    assert sorted((r["doc_id"] or 0, r["base_failed"], r["kept"]) for r in got.collect()) == [
        (0, False, True), (1, True, False), (1, True, False), (2, True, False), (3, False, True), (4, True, False), (5, True, False), (6, False, True), (7, True, False), (8, False, True),
    ]
    assert got.where("doc_id = 8").head()["n_words"] == 200_000 and rules.judge(rules.measure_repetition(df.where("false"))).count() == 0
    assert sorted(r["doc_id"] for r in rules.keep_good(df.where("doc_id > 2")).collect()) == [3, 6, 8]


def test_clean_documents_stay(spark):
    """Documents that are labelled good and have words enough."""
    from tests.oracle import DATA

    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = rules.judge(rules.measure_repetition(docs)).join(labels, "doc_id").where("quality = 1 AND n_words >= 50").agg(F.count("*"), F.count_if("kept")).head()
    assert got[0] > 50 and got[0] == got[1]
