"""Token counts of a SentencePiece BPE model by rank-synchronous array merging."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, in_batches, range_sums, text_batches, texts_of

MARK = "▁"
#: Counts of distinct pre-tokens that a worker keeps at most.
CACHE_WORDS = 400_000
#: A batch of pre-tokens to merge has about so many symbols at most.
MERGE_SYMBOLS = 400_000
#: Longer pre-tokens are merged one by one: in each step of the arrays they may merge one pair only.
LONG = 256


def letters() -> str:
    """A character class of what str.isalpha takes for letters."""
    parts, start = [], 0
    for alpha, run in groupby(range(0x110001), lambda k: k < 0x110000 and chr(k).isalpha()):
        n = sum(1 for _ in run)
        parts += [f"\\U{start:08x}-\\U{start + n - 1:08x}"] if alpha else []
        start += n
    return f"[{''.join(parts)}]"


class MergeTable:
    """The model's pieces as arrays: symbols of single characters and the merge of each adjacent pair.

    A pair's merged piece has a rank; a lower one merges first. ``eager`` marks pieces that may at once
    merge further with a rank not above their own; after one of them only the leftmost pair may merge, while
    for all others every occurrence in a sequence can merge in the same step.
    """

    def __init__(self, pieces: list[str], scores: list[float]):
        ids = {p: i for i, p in enumerate(pieces) if p}
        self.n = len(pieces)
        # Symbols by code point; a character without a piece has n plus the length of its UTF-8 form.
        points = np.arange(0x110000)
        self.symbol = (self.n + 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        # Equal scores share a rank: of such pairs the leftmost merges first.
        rank_of_score = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        rank = np.array([rank_of_score[s] for s in scores], np.int64)
        keys, to = [], []
        eager = np.zeros(self.n, bool)
        for p, i in ids.items():
            if len(p) < 2:
                continue
            for k in range(1, len(p)):
                left, right = ids.get(p[:k]), ids.get(p[k:])
                if left is not None and right is not None:
                    keys.append(left * self.n + right)
                    to.append(i)
                    for part, text in ((left, p[:k]), (right, p[k:])):
                        if len(text) > 1 and rank[i] <= rank[part]:
                            eager[part] = True
        self._hash(np.array(keys, np.int64), np.array(to, np.int64))
        self.rank, self.eager = rank, eager
        self._pairs = dict(zip(keys, to, strict=True))
        # Pre-tokens: no piece has the mark after another character, a letter next to another character, or a
        # character that is in no piece of two; where the model has such pieces, longer stretches stay whole.
        inside = {p.lstrip(MARK) for p in ids}
        if any(MARK in p for p in inside):
            self.split = re.compile(".+", re.S)
        elif any(a.isalpha() != b.isalpha() for p in inside for a, b in zip(p, p[1:], strict=False)) or any("\n" in p for p in ids):
            self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        else:
            letter = letters()
            self.split = re.compile(f"{MARK}*{letter}+|{MARK}*(?:(?!{letter})[^{MARK}\n])+|{MARK}+|\n", re.S)

    def _hash(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Pairs in an open hash table with linear probing."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slot_key, self.slot_to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slot_key[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slot_key[at[put]], self.slot_to[at[put]] = keys[put], to[put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, keys: np.ndarray) -> np.ndarray:
        """The piece that each pair makes; -1 if none."""
        out, open_ = np.full(len(keys), -1, np.int64), np.flatnonzero(keys >= 0)
        at = self._slots(keys[open_])
        while len(open_):
            there = self.slot_key[at]
            same = there == keys[open_]
            out[open_[same]] = self.slot_to[at[same]]
            go = ~same & (there >= 0)
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def count(self, words: list[str]) -> np.ndarray:
        """How many symbols each word has once no pair can merge; a character without a piece counts its UTF-8 bytes."""
        if not words:
            return np.zeros(0, np.int64)
        lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
        n = self.n
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].astype(np.int64)
        seq = np.repeat(np.arange(len(words)), lengths)
        out = np.bincount(seq, np.where(sym >= n, sym - n, 1), minlength=len(words)).astype(np.int64)
        live = lengths[seq] > 1
        sym, seq = sym[live], seq[live]
        none = np.iinfo(np.int64).max
        while len(sym):
            key = np.where((seq[:-1] == seq[1:]) & (sym[:-1] < n) & (sym[1:] < n), sym[:-1] * n + sym[1:], -1)
            to = self.merged(key)
            rank = np.append(np.where(to >= 0, self.rank[to], none), none)
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(seq)))
            best = np.repeat(least, sizes)
            hit = np.flatnonzero((rank == best) & (rank != none))
            if not len(hit):
                break
            # The leftmost pair of a sequence, and where that is safe the further occurrences of the same pair that don't overlap.
            lead = np.append(True, seq[hit[1:]] != seq[hit[:-1]])
            lead_of = np.repeat(np.flatnonzero(lead), np.diff(np.append(np.flatnonzero(lead), len(hit))))
            goal = to[hit]
            run = np.append(True, hit[1:] != hit[:-1] + 1) | lead
            place = hit - np.repeat(hit[run], np.diff(np.append(np.flatnonzero(run), len(hit))))
            same = (sym[hit] == sym[hit[lead_of]]) & (sym[hit + 1] == sym[hit[lead_of] + 1])
            take = lead | (same & ~self.eager[goal] & (place % 2 == 0))
            hit, goal = hit[take], goal[take]
            out -= np.bincount(seq[hit], minlength=len(out))
            sym[hit] = goal
            keep = np.repeat(least != none, sizes)
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out

    def count_long(self, word: str) -> int:
        """As count, for one word: its pairs wait in a heap by rank, then place, so the time is in proportion to its length but for a logarithm."""
        n, pairs, rank = self.n, self._pairs, self.rank
        sym = self.symbol[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        out, end = sum(1 if s < n else s - n for s in sym), len(sym)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))

        def made(i: int) -> int | None:
            j = after[i]
            return pairs.get(sym[i] * n + sym[j]) if j < end and 0 <= sym[i] < n and sym[j] < n else None

        heap = [(int(rank[p]), i, p) for i in range(end - 1) if (p := made(i)) is not None]
        heapify(heap)
        while heap:
            _, i, p = heappop(heap)
            if made(i) != p:
                continue
            j = after[i]
            sym[i], sym[j], after[i] = p, -1, after[j]
            if after[i] < end:
                before[after[i]] = i
            out -= 1
            for k in (before[i], i):
                if k >= 0 and (p := made(k)) is not None:
                    heappush(heap, (int(rank[p]), k, p))
        return out


def load(model_file: str) -> MergeTable:
    """The merge table of a SentencePiece BPE model with byte fallback and no text normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(model.get_piece_size())]
    return MergeTable([model.id_to_piece(i) if ok else "" for i, ok in enumerate(plain)], [model.get_score(i) for i in range(len(plain))])


def _counter(model_file: str):
    table = load(model_file)
    known: dict[str, int] = {}

    def count(texts: list[str]) -> np.ndarray:
        split, words, sizes = table.split.findall, [], []
        for t in texts:
            found = split(MARK + t.replace(" ", MARK)) if t else []
            words += found
            sizes.append(len(found))
        n = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(n < 0).tolist()
        new = sorted(dict.fromkeys(words[i] for i in missing), key=len)
        own, start = {}, 0
        while new and len(new[-1]) > LONG:
            word = new.pop()
            own[word] = table.count_long(word)
        while start < len(new):
            stop, size = start, 0
            while stop < len(new) and (stop == start or size + len(new[stop]) <= MERGE_SYMBOLS):
                size += len(new[stop])
                stop += 1
            own.update(zip(new[start:stop], table.count(new[start:stop]).tolist(), strict=True))
            start = stop
        n[missing] = [own[words[i]] for i in missing]
        if len(known) + len(own) > CACHE_WORDS:
            known.clear()
        known.update(islice(((w, k) for w, k in own.items() if len(w) <= LONG), CACHE_WORDS))
        ends = np.cumsum(sizes)
        return range_sums(n, ends - sizes, ends)

    return count


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text under a SentencePiece BPE model.

    Texts are cut at word marks into pre-tokens; the distinct ones of a batch are merged together as ragged
    arrays, in each step the lowest-ranked pair of every sequence. A map over the rows: no shuffle.

    Columns: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). A null or empty text has 0 tokens;
    a null id stays null; repeated rows each have a row; an empty table gives no rows; a very long text is counted
    whole, its pre-tokens of over LONG characters one by one; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in text_batches(batches, "text"):
            count = count or _counter(model_file)
            texts = texts_of(batch, "text")
            n = count(texts).astype(np.int64)
            yield emit(schema, doc_id=batch.column(0), n_bytes=[len(t.encode()) for t in texts], n_tokens=n, over_limit=n > limit)

    return in_batches(src, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
