"""Quality rules: repetition coverage, by rolling hashes of several n-gram lengths over a batch's words at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tries import leaf_places
from .common import emit, in_batches, joined, range_sums, text_batches, texts_of

#: Base rules: words at least, words of a window, and the percentage of words in repeated windows at most.
LEAST_WORDS, WINDOW, MOST_REPEATED = 50, 3, 50
#: Percentages of the characters of words that may lie in n-grams which the text had before, by n. Twice the usual ones: in a
#: short text a heading that comes again takes a tenth.
MOST_NGRAM_CHARS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
#: Percentage of the characters of lines that may lie in lines which the text had before.
MOST_LINE_CHARS = 30
SYMBOLS = "#*$%&|<>"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers scattered over 64 bits, one to one."""
    x = (x.astype(np.uint64) + np.uint64(1)) * _STEP
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def repeats(words: np.ndarray, at: np.ndarray, text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of n words that begin at `at`, those that their text holds twice or more, and of these the ones that aren't the first.

    Windows of one hash are neighbours after a stable sort, and each is compared with the one before it; should two
    windows share a hash, the words themselves are sorted.
    """
    key = hashes[at] + text[at].astype(np.uint64) * _STEP
    order = at[np.argsort(key, kind="stable")]
    key = hashes[order] + text[order].astype(np.uint64) * _STEP

    def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = text[a] == text[b]
        for k in range(n):
            out &= words[a + k] == words[b + k]
        return out

    next_to = np.flatnonzero(key[1:] == key[:-1])
    if not equal(order[next_to + 1], order[next_to]).all():
        order = at[np.lexsort((at, *[words[at + k] for k in range(n)], text[at]))]
        next_to = np.flatnonzero(equal(order[1:], order[:-1]))
    later = order[next_to + 1]
    return np.union1d(later, order[next_to]), np.sort(later)


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of all words lie in a window of n that begins at one of these places."""
    edge = np.bincount(at, minlength=total + 1)[: total + 1] - np.bincount(at + n, minlength=total + 1)[: total + 1]
    return np.cumsum(edge[:total]) > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts for each text: n_words, word_chars, n_symbols, n_dup_lines, line_chars, dup_line_chars, n_repeat_words, and dup_<n> for each n-gram length."""
    n = len(texts)
    data, text_starts, text_ends = joined(texts, b"\n")
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    gap = _SPACE[data]
    edges = np.flatnonzero(np.diff(gap.astype(np.int8)))
    starts, ends = edges[0::2] + 1, edges[1::2] + 1
    text = np.searchsorted(text_starts, starts, side="right") - 1
    size = chars[ends] - chars[starts]
    sums = lambda which, values: np.bincount(which, values, minlength=n).astype(np.int64)
    out = {"n_words": np.bincount(text, minlength=n), "word_chars": sums(text, size), "n_symbols": range_sums(_SYMBOL[data].astype(np.int64), text_starts, text_ends).astype(np.int64)}

    breaks = np.flatnonzero(data == 10)
    a, b = breaks[:-1] + 1, breaks[1:]
    said = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b = a[said], b[said]
    of = np.searchsorted(text_starts, a, side="right") - 1
    line, _ = leaf_places(data, a, b)
    order = np.lexsort((a, line, of))
    again = order[1:][(line[order[1:]] == line[order[:-1]]) & (of[order[1:]] == of[order[:-1]])]
    out |= {"n_dup_lines": np.bincount(of[again], minlength=n), "line_chars": sums(of, chars[b] - chars[a]), "dup_line_chars": sums(of[again], (chars[b] - chars[a])[again])}

    words, _ = leaf_places(data, starts, ends)
    mixed, total = _mixed(words), len(words)
    hashes, at = mixed.copy(), np.arange(total)
    for k in range(2, max(MOST_NGRAM_CHARS) + 1):
        hashes = hashes[: total - k + 1] * _STEP + mixed[k - 1 :] if total >= k else hashes[:0]
        at = at[at + k <= total]
        at = at[text[at] == text[at + k - 1]]
        if k != WINDOW and k not in MOST_NGRAM_CHARS:
            continue
        # A longer window comes again only where its beginning does, so only those go on.
        at, later = repeats(words, at, text, hashes, k)
        if k == WINDOW:
            out["n_repeat_words"] = np.bincount(text[_covered(at, k, total)], minlength=n)
        if k in MOST_NGRAM_CHARS:
            held = _covered(later, k, total)
            out[f"dup_{k}"] = sums(text[held], size[held])
    return {c: v.astype(np.int64) for c, v in out.items()}


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "dup_line_chars", *[f"dup_{k}" for k in MOST_NGRAM_CHARS]]


def measure_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document doc_id and counts over the whole text (long): a map, no shuffle.

    n_words; word_chars (code points in words); n_symbols; n_dup_lines, lines with a word that the text had before;
    n_repeat_words, words in 3-word windows that it holds twice or more; line_chars, code points of lines with a word, and
    dup_line_chars of those that it had before; dup_5 to dup_10, code points of words inside n-grams that it had before.
    Words are runs of characters other than ASCII white space.

    A null or empty text counts 0 everywhere; a null id stays null; repeated rows each have a row; an empty table gives
    no rows; a very long text is a batch of its own; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            schema = pa.schema([batch.schema.field(0), *[(c, pa.int64()) for c in _COUNTS]])
            yield emit(schema, doc_id=batch.column(0), **measure([t.encode() for t in texts_of(batch, "text")]))

    return in_batches(src, run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS))


def judge(counts: DataFrame) -> DataFrame:
    """counts with base_failed (too few words, or too many of them in repeated windows) and kept: neither that nor too many characters in n-grams or lines that the text had before."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    worn = 100 * F.col("dup_line_chars") > MOST_LINE_CHARS * F.col("line_chars")
    for k, most in MOST_NGRAM_CHARS.items():
        worn = worn | (100 * F.col(f"dup_{k}") > most * F.col("word_chars"))
    return counts.withColumns({"base_failed": failed, "kept": ~(failed | worn)})


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that judge rejects, all columns kept; documents are matched by id, so ids must be set and differ."""
    good = judge(measure_repetition(docs, id_col, text_col)).where("kept").select(F.col("doc_id").alias(id_col))
    return docs.join(good, id_col, "left_semi")
