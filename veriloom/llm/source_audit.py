"""Source divergence audit: tasks count terms in radix tries with counters per source, which are merged by prefix range and walked in UTF-8 order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_tries import leaf_places, packed, summed
from .common import emit, in_batches, joined, measured_few, scratch, text_batches, texts_of, written

#: A term is kept for a language that has it in so many documents; its share counts SMOOTH more occurrences, in parts of SCALE; TOP terms are listed.
LEAST_DOCS, SMOOTH, SCALE, TOP = 10, 2, 1_000_000_000, 10
#: Counters of a task's trie; a trie of more is sent on and a new one begun.
ENTRIES = 1 << 18
#: Kept terms that are walked together, cells of a table of counts at once, sources that are compared with as many others at once.
SLICE, CELLS, BLOCK = 1 << 14, 1 << 19, 256

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


@dataclass
class Trie:
    """A radix trie as its leaves in UTF-8 order: their bytes one after another, and counters (leaf, group, occurrences, documents) in that order."""

    data: np.ndarray
    bounds: np.ndarray
    leaf: np.ndarray
    group: np.ndarray
    count: np.ndarray
    docs: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], groups: np.ndarray) -> Trie:
        """The terms of texts, counted for the group of each."""
        data, text_starts, _ = joined(texts, b" ")
        data = _FOLD[data]
        edges = np.flatnonzero(np.diff(_IN_TERM[data].astype(np.int8)))  # pads stand before and after each text
        starts, ends = edges[0::2] + 1, edges[1::2] + 1
        text = np.searchsorted(text_starts, starts, side="right") - 1
        leaf, one = leaf_places(data, starts, ends)
        pairs, n = summed(leaf * len(texts) + text, np.ones(len(leaf), np.int64))
        leaf, group = pairs // len(texts), groups[pairs % len(texts)]
        return cls._with(*packed(data, starts[one], ends[one]), leaf, group, n, np.ones(len(n), np.int64))

    @classmethod
    def _with(cls, data, bounds, leaf, group, count, docs) -> Trie:
        span = int(group.max(initial=0)) + 1
        keys, count, docs = summed(leaf * span + group, count, docs)
        return cls(data, bounds, keys // span, keys % span, count, docs)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """One trie with the leaves of all, counters added."""
        if len(tries) == 1:
            return tries[0]
        base = np.cumsum([0] + [len(t.data) for t in tries])
        data = np.concatenate([t.data for t in tries])
        starts = np.concatenate([t.bounds[:-1] + b for t, b in zip(tries, base, strict=False)])
        ends = np.concatenate([t.bounds[1:] + b for t, b in zip(tries, base, strict=False)])
        leaf, one = leaf_places(data, starts, ends)
        first = np.cumsum([0] + [len(t.bounds) - 1 for t in tries])
        own = np.concatenate([leaf[t.leaf + f] for t, f in zip(tries, first, strict=False)])
        return cls._with(*packed(data, starts[one], ends[one]), own, *[np.concatenate([getattr(t, k) for t in tries]) for k in ("group", "count", "docs")])

    def terms(self) -> pa.Array:
        return pa.LargeStringArray.from_buffers(len(self.bounds) - 1, pa.py_buffer(self.bounds.tobytes()), pa.py_buffer(self.data.tobytes()))


_LEAVES = pa.schema([("term", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])


def count_leaves(docs: DataFrame) -> DataFrame:
    """term, lang, source, count (occurrences), docs (documents that hold it): the leaves of the tasks' tries, so a term comes once for each trie.

    docs: text, lang, source, without nulls. A task adds its batches to one trie of bounded size and sends it on when full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[tuple[str, str], int] = {}
        held: list[Trie] = []

        def sent(trie: Trie) -> Iterator[pa.RecordBatch]:
            terms, langs, sources = trie.terms(), *[pa.array([g[k] for g in places], pa.string()) for k in (0, 1)]
            for a in range(0, len(trie.leaf), 1 << 15):
                part = slice(a, a + (1 << 15))
                of = pa.array(trie.group[part])
                yield emit(_LEAVES, term=terms.take(pa.array(trie.leaf[part])).cast(pa.string()), lang=langs.take(of), source=sources.take(of), count=trie.count[part], docs=trie.docs[part])

        for batch in text_batches(batches, "text"):
            texts = [t.encode() for t in texts_of(batch, "text")]
            groups = np.array([places.setdefault(g, len(places)) for g in zip(texts_of(batch, "lang"), texts_of(batch, "source"), strict=True)], np.int64)
            held.append(Trie.of(texts, groups))
            if sum(len(t.leaf) for t in held) > ENTRIES:
                held = [Trie.merged(held)]
                if len(held[0].leaf) > ENTRIES // 2:
                    yield from sent(held.pop())
        if held:
            yield from sent(Trie.merged(held))

    return in_batches(docs.select("text", "lang", "source"), run, "term string, lang string, source string, count long, docs long")


_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("total", pa.int64()), ("first", pa.int64()), ("place", pa.int64()), ("slice", pa.int64())])


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    out = np.ones(len(column), bool)
    out[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()
    return out


def merge_ranges(leaves: DataFrame, least_docs: int) -> DataFrame:
    """The leaves of all tries merged: a row for each language, kept term and source with a count, in UTF-8 order within a prefix range.

    Ranges are cut by Spark, from a sample of the leaves; a task's range comes sorted, through disk if it must, and is
    merged as it streams by: only the counters of one term are held. total is the term's count in the language, first is 1
    for one row of each language and term, place numbers a range's terms, slice is one for SLICE of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done, held = TaskContext.get().partitionId() << 32, 0, None
        for batch in chain(batches, [None]):
            rows = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if rows is None:
                continue
            rows = rows.combine_chunks()
            new_run = _changes(rows["term"]) | _changes(rows["lang"])
            first = np.flatnonzero(new_run | _changes(rows["source"]))
            count, docs = (np.add.reduceat(rows[c].to_numpy(), first) for c in ("count", "docs"))
            rows = rows.take(pa.array(first)).drop_columns(["count", "docs"]).append_column("count", pa.array(count)).append_column("docs", pa.array(docs))
            run_first = np.flatnonzero(new_run[first])
            if batch is not None:  # the last run may go on
                held = rows.slice(run_first[-1])
                rows, count, docs, run_first = rows.slice(0, run_first[-1]), count[: run_first[-1]], docs[: run_first[-1]], run_first[:-1]
            if not len(run_first):
                continue
            size = np.diff(run_first, append=len(count))
            kept = np.add.reduceat(docs, run_first) >= least_docs
            place = done + np.cumsum(kept) - 1
            done += int(kept.sum())
            at = np.flatnonzero(np.repeat(kept, size))
            each = lambda x: np.repeat(x, size)[at]  # noqa: E731, B023
            begun = np.zeros(len(count), np.int64)
            begun[run_first] = 1
            out = rows.take(pa.array(at))
            text = {c: out[c].combine_chunks() for c in ("lang", "term", "source")}
            place = each(place)
            yield emit(_KEPT, **text, count=count[at], total=each(np.add.reduceat(count, run_first)), first=begun[at], place=place, slice=base + place // SLICE)

    by_prefix = leaves.repartitionByRange("term").sortWithinPartitions("term", "lang", "source")
    return in_batches(by_prefix, run, "lang string, term string, source string, count long, total long, first long, place long, slice long")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / total), exact for totals below 9 * 10**15: a division in steps of a thousand."""
    out, rest = np.divmod(count + SMOOTH, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_FOUND = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _walk(key: tuple, leaves: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """A slice's terms in UTF-8 order: each pair's sum of divergences, and each source's first `top` candidates, the earlier of equal ones."""
    lang, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
    groups = groups.sort_by("idx")
    idx, total, names = groups["idx"].to_numpy(), groups["total"].to_numpy(), groups["source"].combine_chunks()
    of_block = idx // BLOCK
    _, term = np.unique(leaves["place"].to_numpy(), return_inverse=True)
    at, count = np.searchsorted(idx, leaves["idx"].to_numpy()), leaves["count"].to_numpy()
    order = np.argsort(term, kind="stable")
    sorted_term, n = term[order], int(term.max(initial=-1)) + 1
    sums, step = np.zeros((len(idx), len(idx)), np.int64), max(1, CELLS // max(1, len(idx)))
    compared = np.triu(np.ones(sums.shape, bool), 1) & ((of_block[:, None] == low) & (of_block[None, :] == high))
    for a in range(0, n, step):
        part = order[np.searchsorted(sorted_term, a) : np.searchsorted(sorted_term, a + step)]
        table = np.zeros((min(step, n - a), len(idx)), np.int64)
        table[term[part] - a, at[part]] = count[part]
        p = shares(table, total[None, :])
        for k in range(len(idx) - 1):
            sums[k, k + 1 :] += divergence(p[:, k : k + 1], p[:, k + 1 :]).sum(axis=0)
    a, b = np.nonzero(compared)
    parts = [("pair", a, names.take(pa.array(b)), sums[a, b])]
    if low == high and len(at):
        p, q = shares(count, total[at]), shares(leaves["all"].to_numpy(), groups["lang_total"].to_numpy()[at])
        over = np.flatnonzero(p > q)
        value = divergence(p[over], q[over])
        best = np.lexsort((term[over], -value, at[over]))
        over, value = over[best], value[best]
        begun = np.flatnonzero(np.diff(at[over], prepend=-1))
        rank = np.arange(len(over)) - np.repeat(begun, np.diff(begun, append=len(over)))
        over, value = over[rank < top], value[rank < top]
        parts.append(("term", at[over], leaves["term"].combine_chunks().take(pa.array(over)), value))
    made = [emit(_FOUND, lang=[lang] * len(v), part=[kind] * len(v), source=names.take(pa.array(s)), item=item, value=v) for kind, s, item, v in parts]
    return pa.Table.from_batches(made, _FOUND)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """How far the sources of each language lie apart, and the terms that set each of them off: lang, source, part, item, value, rank.

    Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII. Part pair: each other source of the
    language, its value the divergence summed over the kept terms, all ranks. Part term: the kept terms whose share in the
    source is above that in the language, the first `top`. Ranks go by value, descending, then item by UTF-8. All
    arithmetic is in whole numbers.

    Tasks build tries, so that a term crosses the network once a trie; ranges of prefixes are merged as they stream;
    slices of kept terms are walked side by side, against blocks of BLOCK sources, with all totals at hand. Null texts,
    languages and sources count as empty; a source without kept terms has pairs of value 0 where its language has no kept
    terms; repeated rows are documents of their own; an empty table gives no rows; very long texts and terms count whole;
    other columns are ignored. The result is a written table.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = docs.select(said(text_col).alias("text"), said(lang_col).alias("lang"), said(source_col).alias("source"))
    keys = ["lang", "slice", "low", "high"]
    with scratch(docs.sparkSession) as table:
        kept = table(merge_ranges(table(count_leaves(src), "leaves"), least_docs), "kept")
        by_source = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        by_lang = kept.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.sum("first").alias("v"))
        groups = src.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0)
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row a source
        groups = groups.select("lang", "source", place.alias("idx"), (F.col("n") + SMOOTH * F.col("v")).alias("total"), (F.col("lang_n") + SMOOTH * F.col("v")).alias("lang_total"))
        groups = table(groups, "groups")
        blocks = groups.groupBy("lang").agg(F.floor(F.max("idx") / BLOCK).alias("last"))
        own = F.floor(F.col("idx") / BLOCK)
        dealt = groups.select("lang", "source", "idx", own.alias("own")).join(blocks, "lang")
        leaves = kept.withColumnRenamed("total", "all").join(measured_few(dealt), ["lang", "source"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        leaves = leaves.select("lang", "slice", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "term", "place", "idx", "count", "all")
        sides = leaves.select(*[F.col(k).alias(k) for k in keys]).distinct().join(groups, "lang").where((own == F.col("low")) | (own == F.col("high"))).select(*keys, "source", "idx", "total", "lang_total")

        def walk(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
            return _walk(key, a, b, top)

        found = table(leaves.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(walk, "lang string, part string, source string, item string, value long"), "found")
        g = groups.select("lang", "source")
        none = g.join(g.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
        pairs = found.where("part = 'pair'").select("lang", "source", "item", "value")
        pairs = none.union(pairs).union(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
        pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
        shown = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
        terms = shown(found.where("part = 'term'"), "term").where(F.col("rank") <= top)
        return written(shown(pairs, "pair").union(terms), "source-audit")
