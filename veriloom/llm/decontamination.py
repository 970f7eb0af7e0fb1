"""Benchmark decontamination: the q-gram lemma in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, in_batches, joined, text_batches, texts_of

#: Bytes in a q-gram at most: it fills a 64-bit word.
Q = 8
#: Edits allowed in a benchmark text, as a share of its bytes.
EDITS = 0.1
#: The benchmark goes to the tasks in blocks of at most so many bytes of text.
BLOCK_BYTES = 4 << 20
#: A q-gram with more runs in a block's items is left out where an item has enough others.
HOT = 256
#: Pairs of runs that are counted at once; bytes of a run in the data, and diagonals of a region, at most.
PRODUCT, RUN, REGION = 1 << 19, 1 << 12, 1 << 17
_BITS = 22
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_FOLD[0] = 32


def folded(text: str) -> bytes:
    """Lower case in A-Z, each white-space byte as a blank."""
    return _FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes()


def edits_allowed(n: int) -> int:
    """Edits allowed in a text of n bytes; only texts of fewer than 10 must occur as they are."""
    return int(EDITS * n)


def gram_size(n: int) -> int:
    """The longest q-gram, Q at most, of which a text of n bytes keeps one under all edits allowed; Q from 40 bytes on."""
    return min(Q, n // (edits_allowed(n) + 1)) if n >= Q else Q


class Passages:
    """A block of benchmark texts, by the size of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]]):
        items = [(i, t) for i, t in items if t.strip()]
        sizes = sorted({gram_size(len(t)) for _, t in items})
        self.parts = [_Part([(i, t) for i, t in items if gram_size(len(t)) == q], q) for q in sizes]

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits): the best region of each benchmark text in each text, bytes of the folded text."""
        return sorted(x for part in self.parts for x in part.find(texts))


class _Part:
    """Benchmark texts with the postings of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]], q: int):
        self.q = q
        self.ids = np.array([i for i, _ in items], np.int64)
        self.texts = [t for _, t in items]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([edits_allowed(len(t)) for t in self.texts], np.int64)
        # The lemma: a region within k edits of n bytes shares at least n - q + 1 - k q grams with the text.
        self.need = np.maximum(1, self.size - q + 1 - self.edits * q)
        self.short = [k for k, t in enumerate(self.texts) if len(t) < Q]
        gram, place, length, item = _runs_of([_grams(np.frombuffer(t, np.uint8), q) for t in self.texts])
        # Grams that very many places have are left out where enough of an item's others remain to tell.
        _, at, times = np.unique(gram, return_inverse=True, return_counts=True)
        hot = times[at] > HOT
        less = np.bincount(item, length * hot, minlength=len(self.texts)).astype(np.int64)
        spared = self.need - less >= np.maximum(1, self.need // 2)
        self.need = np.where(spared, self.need - less, self.need)
        keep = ~(hot & spared[item])
        gram, place, length, item = gram[keep], place[keep], length[keep], item[keep]
        order = np.argsort(gram, kind="stable")
        self.item, self.place, self.length = item[order], place[order], length[order]
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[_slot(self.gram)] = True

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        data, starts, ends = joined(texts, b"\0" * Q)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def keep(doc: int, item: int, at: tuple[int, int, int]) -> None:
            if (doc, item) not in best or at < best[doc, item]:
                best[doc, item] = at

        for k in self.short:
            for doc, text in enumerate(texts):
                if (at := text.find(self.texts[k])) >= 0:
                    keep(doc, k, (0, at, at + len(self.texts[k])))
        for doc, item, low, high in self.regions(data, starts):
            text, want = texts[doc], self.texts[item]
            low, high = max(0, low - int(starts[doc])), min(len(text), high - int(starts[doc]))
            if (doc, item) in best and best[doc, item][0] == 0:
                continue
            if (at := text.find(want, low, high)) >= 0:
                keep(doc, item, (0, at, at + len(want)))
            elif self.edits[item] and (got := banded_alignment(want, text[low:high], int(self.edits[item]))) is not None:
                keep(doc, item, (got[0], low + got[1], low + got[2]))
        return [(doc, int(self.ids[item]), a, b, e) for (doc, item), (e, a, b) in sorted(best.items())]

    def regions(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, low, high) of the diagonal bands with enough shared q-grams; neighbouring ones are one.

        An alignment within k edits stays on k + 1 neighbouring diagonals; bands of 2k + 2 diagonals, each k + 1 after
        the last, so hold it whole. Runs of one gram count as a range, in the data as in the items. The bands of a
        piece of the data are settled and dropped before the next one. A place may count twice, which only lets more in.
        """
        gram = _grams(data, self.q)
        at = np.flatnonzero(self.maybe[_slot(gram)])
        if not len(at):
            return
        found = np.minimum(np.searchsorted(self.gram, gram[at]), len(self.gram) - 1)
        same = self.gram[found] == gram[at]
        at, found = at[same], found[same]
        if not len(at):
            return
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (found[1:] != found[:-1]) | (at[1:] // RUN != at[:-1] // RUN)))
        run, found, lasts = at[new], found[new], at[np.append(new[1:], len(at)) - 1]
        lead, widest = int(self.size.max()), 2 * int(self.edits.max()) + 2
        ends = np.cumsum(self.count[found])
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = 0
        while begin < len(run):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PRODUCT)))
            key, count = self._shared(run[begin:stop], lasts[begin:stop], found[begin:stop], lead)
            keys, where = np.unique(np.concatenate([keys, key]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, count]), minlength=len(keys)).astype(np.int64)
            begin = stop
            # A band whose last diagonal ends before the next run is whole.
            item, band = keys >> 40, keys & ((1 << 40) - 1)
            low = band * (self.edits[item] + 1) - lead
            over = low + widest + self.size[item] < (run[stop] if stop < len(run) else np.iinfo(np.int64).max)
            yield from self._merged(item[over], band[over], counts[over], starts, lead)
            keys, counts = keys[~over], counts[~over]

    def _shared(self, first: np.ndarray, last: np.ndarray, found: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
        """item << 40 | band, and how many places of the item have their gram on the band's diagonals, for each pair of a run in the data and one in an item."""
        n = self.count[found]
        post = np.repeat(self.first[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        first, last, item, p1 = np.repeat(first, n), np.repeat(last, n), self.item[post], self.place[post]
        p2, step = p1 + self.length[post] - 1, self.edits[item] + 1
        low, high = np.maximum((first - p2 + lead) // step - 1, 0), (last - p1 + lead) // step
        n = high - low + 1
        pair = np.repeat(np.arange(len(n)), n)
        band = low[pair] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        d0 = band * step[pair] - lead
        count = np.minimum(p2[pair], last[pair] - d0) - np.maximum(p1[pair], first[pair] - d0 - 2 * step[pair] + 1) + 1
        return item[pair] << 40 | band, np.maximum(count, 0)

    def _merged(self, item: np.ndarray, band: np.ndarray, count: np.ndarray, starts: np.ndarray, lead: int) -> Iterator[tuple[int, int, int, int]]:
        ok = count >= self.need[item]
        item, band = item[ok], band[ok]
        if not len(item):
            return
        most = np.maximum(REGION // (self.edits[item] + 1), 1)
        cut = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (band[1:] != band[:-1] + 1) | (band[1:] // most[1:] != band[:-1] // most[1:])))
        for i, b0, b1 in zip(item[cut].tolist(), band[cut].tolist(), band[np.append(cut[1:], len(band)) - 1].tolist(), strict=True):
            k = int(self.edits[i])
            low, high = b0 * (k + 1) - lead, b1 * (k + 1) - lead + 2 * (k + 1) + int(self.size[i]) + k
            # A band's grams may lie in several texts.
            first = max(0, int(np.searchsorted(starts, low, side="right")) - 1)
            last = max(0, int(np.searchsorted(starts, high, side="right")) - 1)
            for doc in range(first, last + 1):
                yield doc, i, low - k, high


def _runs_of(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one gram at neighbouring places of the texts: gram, first place, length, text."""
    gram = np.concatenate([*grams, np.zeros(0, np.uint64)])
    sizes = np.array([len(g) for g in grams], np.int64)
    text = np.repeat(np.arange(len(grams)), sizes)
    place = np.arange(len(gram)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if not len(gram):
        return gram, place, place, text
    new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])))
    return gram[new], place[new], np.diff(np.append(new, len(gram))), text[new]


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q-gram at each place as a 64-bit word."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if q < Q:
        data = np.concatenate([data, np.zeros(Q - q, np.uint8)])
    gram = np.ndarray((n,), "<u8", np.ascontiguousarray(data), 0, (1,)) & np.uint64((1 << 8 * q) - 1)
    return _unturned(gram) if q == Q else gram


def _unturned(gram: np.ndarray) -> np.ndarray:
    """The grams, but of those that repeat a shorter text the least of its turns: periodic text has one gram all along, so it counts as a run. Equal grams stay equal."""
    out, left = gram, np.arange(len(gram))
    for p in range(1, Q):
        g = gram[left]
        again = (g ^ (g >> np.uint64(8 * p))) & np.uint64((1 << 8 * (Q - p)) - 1) == 0
        if again.any():
            out = out.copy() if out is gram else out
            one, own = g[again] & np.uint64((1 << 8 * p) - 1), left[again]
            turns = [(one >> np.uint64(8 * r) | one << np.uint64(8 * (p - r))) & np.uint64((1 << 8 * p) - 1) for r in range(p)]
            least = np.minimum.reduce(turns)
            out[own] = np.bitwise_or.reduce([least << np.uint64(8 * k) for k in range(0, Q, p)])
            left = left[~again]
    return out


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


def banded_alignment(want: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of text nearest to want, if within most edits; the first such part.

    Rows are the bytes of want; of each row only the cells on the band's diagonals are kept, since text is a little
    longer than want. A cell's start travels in its low bits.
    """
    a, b = np.frombuffer(want, np.uint8), np.frombuffer(text, np.uint8)
    width = len(b) - len(a) + 2 * most + 1
    if width <= 0:
        return None
    shift = 32
    one, far = 1 << shift, np.int64(1) << 60
    columns = np.arange(width, dtype=np.int64)
    padded = np.concatenate([np.zeros(most, np.uint8), b, np.zeros(len(a) + width, np.uint8)])
    inside = np.concatenate([np.zeros(most, bool), np.ones(len(b) + 1, bool), np.zeros(len(a) + width, bool)])
    # Cell c of row i stands before byte i + c - most of text.
    row = np.where(inside[columns], np.maximum(columns - most, 0), far)
    slope = columns * one
    for i in range(len(a)):
        match = row + np.where(padded[i : i + width] == a[i], 0, one)
        match[~inside[i + 1 : i + 1 + width]] = far
        gone = np.append(row[1:], far) + one
        row = np.minimum(match, gone)
        row[~inside[i + 1 : i + 1 + width]] = far
        row = np.minimum.accumulate(row - slope) + slope
        row[~inside[i + 1 : i + 1 + width]] = far
        if row.min() >= (most + 1) * one:
            return None
    at = int(row.argmin())
    edits, start = int(row[at]) >> shift, int(row[at]) & (one - 1)
    return (edits, start, len(a) + at - most) if edits <= most else None


_OUT = "doc_id long, item_id long, start long, end long, edits long"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's texts in blocks of a bounded size, each read by a query of its own beyond the first."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = -(-2 * total // BLOCK_BYTES)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted((r["item_id"], folded(r["text"])) for r in part.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Benchmark texts found in documents: doc_id, item_id, start, end (bytes of the text's UTF-8), edits.

    A row for each document and benchmark text with a region of the document within EDITS of the text's bytes
    (case of A-Z and kind of white space aside); the region with the fewest edits, the first of equals. A map over the documents for each block of the benchmark, which holds a bounded
    number of bytes; no shuffle.

    Null and empty texts and benchmark texts give no rows; documents with a null id are left out; repeated rows each
    give theirs; either table empty gives no rows; a very long text is searched whole, in pieces; other columns are
    ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    out = None
    for items in _blocks(benchmark):
        found = _scan(src, items)
        out = found if out is None else out.union(found)
    return src.select("doc_id").where("false").selectExpr("doc_id", "0L item_id", "0L start", "0L end", "0L edits") if out is None else out


def _scan(src: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
    schema = pa.schema([(x.split()[0], pa.int64()) for x in _OUT.split(", ")])
    shared = src.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(shared.value)
        for batch in text_batches(batches, "text"):
            ids = batch.column(0).to_pylist()
            got = passages.find([folded(t) for t in texts_of(batch, "text")])
            yield emit(schema, doc_id=[ids[d] for d, *_ in got], item_id=[x[1] for x in got], start=[x[2] for x in got], end=[x[3] for x in got], edits=[x[4] for x in got])

    return in_batches(src, run, _OUT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark text; all columns stay, whatever their names.

    Null and empty texts and null ids stay; repeated rows stay or go together; an empty table of either kind changes
    nothing; a very long text is searched whole, in pieces.
    """
    out = docs
    for items in _blocks(benchmark):
        out = _without(out, items, text_col)
    return out


def _without(docs: DataFrame, items: list[tuple[int, bytes]], text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(shared.value)
        for batch in text_batches(batches, text_col):
            keep = np.ones(batch.num_rows, bool)
            keep[[d for d, *_ in passages.find([folded(t) for t in texts_of(batch, text_col)])]] = False
            yield batch.filter(pa.array(keep))

    return in_batches(docs, run, docs.schema)
