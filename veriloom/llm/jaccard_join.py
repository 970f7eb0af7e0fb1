"""N-gram Jaccard join: universe partitions and the pigeonhole principle, and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import emit, few, fresh, in_batches, scratch, text_batches, texts_of, written
from .components import components

#: Two documents link from this share of common shingles on, in hundredths.
THRESHOLD = 90
#: Words in a shingle.
WORDS = 3
#: Sizes of a band: up to this ratio.
BAND_RATIO = 1.5
#: Hashes of distinct words that a worker keeps at most.
CACHE_WORDS = 300_000
#: Segments of which a subset is indexed, over the size of that subset.
SPARE = 1.5
#: Estimated cost of a candidate that an index entry brings, in index entries.
CANDIDATE_COST = 20.0
#: Share of the tokens of an unrelated set that a set is assumed to have too.
COMMON = 0.05
#: Members of an entry's least member's component, and others, that are compared in one place.
BLOCK = 512
#: Rounds in which entries with more others than that are indexed again, before they are cut into blocks.
ROUNDS = 1
#: Bits of a bitmap at most: a larger set's tells less.
MOST_BITS = 1 << 17

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def tokens(self, text: str) -> np.ndarray:
        words = text.encode().translate(_LOWER).split()
        if not words:
            return np.zeros(0, _U)
        known = self.known
        hashes = [known.get(w) for w in words]
        if None in hashes:
            if len(known) > CACHE_WORDS:
                known.clear()
            for k, h in enumerate(hashes):
                if h is None:
                    h = known.get(words[k])
                    if h is None:
                        h = known[words[k]] = xxhash.xxh3_64_intdigest(words[k])
                    hashes[k] = h
        h = np.array(hashes, _U)
        n = min(self.words, len(h))
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = _mix(out) + h[k : len(h) - n + 1 + k] * _U(2 * k + 1)
        return np.unique(_mix(out + _U(n)))


def most_different(x, y, threshold: int):
    """Tokens in just one of two linked sets of these sizes, at most."""
    return (100 - threshold) * (x + y) // (100 + threshold)


class Bands:
    """Size bands with their segments.

    The tokens' universe is cut by hash into p near and q plain segments, settled by the band of the smaller of two
    sets. Linked sets differ in H tokens at most. Near segments are indexed with their one-deletion neighbourhoods: if
    two sets share no entry of one, they differ there in 2 tokens or more. If that holds for all p, at most H - 2p of
    the plain segments differ, so of any order of segments' contents the first H - 2p + 1 of either set share one:
    that subset is indexed. The order puts segments with more tokens first, as few unrelated sets share one, and
    empty ones last.

    p is allocated by cost: entries, and candidates that agree in a segment by chance, estimated for `sets` sets.
    """

    def __init__(self, most: int, sets: int, threshold: int = THRESHOLD):
        self.t = threshold
        edges = [1]
        while edges[-1] <= most:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_RATIO)))
        self.edges = np.array(edges)
        self.layout = [self._allocate(int(lo), int(hi) - 1, sets) for lo, hi in zip(edges, edges[1:], strict=False)]

    def most_different(self, s: int) -> int:
        """Of a set of s tokens and a linked one that isn't smaller."""
        return most_different(s * 100 // self.t, s, self.t)

    def _allocate(self, low: int, high: int, sets: int) -> tuple[int, int, int]:
        """Near segments, plain segments, and how many of the plain ones a set shows."""
        apart = self.most_different(high)
        p = np.arange((apart + 1) // 2 + 1)
        shown = np.maximum(apart + 1 - 2 * p, 0)
        plain = np.where(shown > 1, np.ceil(SPARE * shown), shown).astype(np.int64)
        tokens = (low + high) / 2 / (p + plain)
        both_empty = (1 - 1 / (p + plain)) ** (2 * (low - 1))
        chance = shown * COMMON ** (tokens * plain / np.maximum(shown, 1)) + p * (tokens + 1) ** 2 * (both_empty + COMMON ** np.maximum(tokens - 1, 1e-9))
        cost = shown + p * (1 + tokens) + CANDIDATE_COST * sets / len(self.edges) * chance
        k = int(cost.argmin())
        return int(p[k]), int(plain[k]), int(shown[k])

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def partners(self, size: int) -> list[int]:
        """The bands in which a set of this size meets sets of its size or less that it may link with."""
        least = -(-self.t * size // 100)
        return list(range(self.of(max(1, least)), self.of(size) + 1))

    def entries(self, tokens: np.ndarray) -> np.ndarray:
        """64-bit index entries of a sorted set in its own band and in those of smaller partners."""
        out = [np.zeros(0, _U)]
        one = _mix(tokens ^ _U(0xA5A5A5A5))
        total = np.concatenate([np.zeros(1, _U), np.cumsum(one, dtype=_U)])
        for band in self.partners(len(tokens)) if len(tokens) else []:
            p, plain, shown = self.layout[band]
            m = p + plain
            ends = np.searchsorted(((tokens >> _U(32)) * _U(m) >> _U(32)).astype(np.int64), np.arange(m + 1))
            # A segment's entry is the sum of its tokens' mixed hashes, so that a token can be taken off.
            content = total[ends[1:]] - total[ends[:-1]]
            salt = _mix(np.arange(m).astype(_U) + _U(band << 20) + _U(1))
            entry, sizes = _mix(content + salt), np.diff(ends)
            out.append(entry[p:][np.lexsort((entry[p:], -sizes[p:]))[:shown]])
            if p:
                near = np.repeat(np.arange(p), sizes[:p])
                out += [entry[:p], _mix(content[near] - one[: len(near)] + salt[near])]
        return np.unique(np.concatenate(out))


def parities(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of 2 to 4 bits a token, MOST_BITS at most: whether an odd number of tokens has each hash. Two bitmaps differ in no more bits than the sets in tokens."""
    bits = min(MOST_BITS, 1 << max(6, (2 * len(tokens) - 1).bit_length()))
    return np.packbits(np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.uint64)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap at a smaller size."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _sets(docs: DataFrame, bands: Bands | None, words: int) -> DataFrame:
    """doc_id, n_shingles, fingerprint (128 bits of the set), bits (parities), and hashes: the set's entries, or without bands its tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fingerprint", pa.binary()), ("bits", pa.binary()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in text_batches(batches, "text"):
            sets = [shingler.tokens(t) for t in texts_of(batch, "text")]
            hashes = [bands.entries(x) for x in sets] if bands else sets
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in hashes])]).astype(np.int32)
            flat = pa.array(np.concatenate(hashes).view(np.int64))
            yield emit(
                schema, doc_id=batch.column(0), n_shingles=[len(x) for x in sets], fingerprint=[xxhash.xxh3_128_digest(x.tobytes()) for x in sets],
                bits=[parities(x).tobytes() if bands else b"" for x in sets], hashes=pa.ListArray.from_arrays(pa.array(offsets), flat),
            )

    return in_batches(docs, run, "doc_id long, n_shingles long, fingerprint binary, bits binary, hashes array<long>")


_RUNS = pa.schema([("entry", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64()), ("edge", pa.bool_())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (entry, doc_id) in order: those of entries that several documents have, with the least of them. A batch's first and last entry stay in any case, marked: other batches may have more of them."""
    for batch in batches:
        if batch.num_rows:
            entry, doc = (batch.column(k).to_numpy() for k in (0, 1))
            new = np.append(True, (entry[1:] != entry[:-1]) | (doc[1:] != doc[:-1]))
            entry, doc = entry[new], doc[new]
            at = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
            size = np.diff(np.append(at, len(entry)))
            edge = (entry == entry[0]) | (entry == entry[-1])
            keep = edge | np.repeat(size > 1, size)
            yield emit(_RUNS, entry=entry[keep], low=np.repeat(doc[at], size)[keep], doc_id=doc[keep], edge=edge[keep])


def _members(entries: DataFrame, table) -> DataFrame:
    """entry, low, doc_id: entries (entry, doc_id) that several documents have, each with the least of them.

    The rows are dealt by ranges of entry and document, so that an entry with very many documents is cut.
    """
    runs = table(entries.repartitionByRange("entry", "doc_id").sortWithinPartitions("entry", "doc_id").mapInArrow(_runs, "entry long, low long, doc_id long, edge boolean"), "runs")
    cut = runs.where("edge").groupBy("entry").agg(F.min("low").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("entry", "low")
    return runs.where("not edge").drop("edge").union(runs.where("edge").drop("edge", "low").join(few(cut, 16), "entry").select("entry", "low", "doc_id"))


def _with_sets(pairs: DataFrame, docs: DataFrame, words: int, table) -> DataFrame:
    """pairs with the sets x of a and y of b, taken from the texts of the documents in pairs only."""
    wanted = table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    sets = table(_sets(docs.join(few(wanted, 8), "doc_id", "left_semi"), None, words).dropDuplicates(["doc_id", "fingerprint"]).select("doc_id", "hashes"), "sets")
    return pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b")


def _linked(pairs: DataFrame, docs: DataFrame, words: int, threshold: int, table) -> DataFrame:
    """The pairs (a, b) of sets that link: exact sizes of intersection and union."""
    pairs = table(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    both = _with_sets(pairs, docs, words, table)
    common = F.size(F.array_intersect("x", "y"))
    return table(both.where(100 * common >= threshold * (F.size("x") + F.size("y") - common)).select("a", "b").distinct(), "linked")


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _near(members: list[dict], threshold: int) -> Iterator[tuple[int, int]]:
    """The pairs of different roots that sizes and bitmaps don't rule out."""
    members = sorted(members, key=lambda m: m["n"])
    n, root, doc = (np.array([m[k] for m in members]) for k in ("n", "root", "doc_id"))
    bits = [np.frombuffer(m["bits"], np.uint64) for m in members]
    # Bitmaps of one size as a matrix: larger sets have equal or larger ones.
    start = {len(x): k for k, x in reversed(list(enumerate(bits)))}
    same = {size: np.stack([x for x in bits if len(x) == size]) for size in start}
    for k, y in enumerate(bits):
        low = int(np.searchsorted(100 * n, threshold * n[k]))
        for size, first in start.items():
            a, b = max(low, first), min(k, first + len(same[size]))
            if a < b:
                apart = np.bitwise_count(same[size][a - first : b - first] ^ folded(y, size)).sum(axis=1)
                for j in a + np.flatnonzero((apart <= most_different(n[a:b], n[k], threshold)) & (root[a:b] != root[k])):
                    yield int(min(doc[j], doc[k])), int(max(doc[j], doc[k]))


def _compared(groups: DataFrame, threshold: int) -> DataFrame:
    """a, b: the near pairs within groups, rows with one array of a bounded number of (doc_id, root, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = list(_near(batch.column(0)[k].as_py(), threshold))
                yield emit(_PAIR, a=[x for x, _ in got], b=[y for _, y in got])

    return groups.mapInArrow(run, "a long, b long").distinct()


def _apart(rest: DataFrame, docs: DataFrame, words: int, threshold: int, table) -> DataFrame:
    """New entries (entry, doc_id) for members (low, doc_id) of large groups with several components, by what sets each apart from the group's least member.

    With c the least member and D(x) the tokens in just one of x and c, two sets differ in the tokens that are in just
    one of D(x) and D(y). Linked sets x, y of which one doesn't link with c share a token of D(x) and D(y): else they
    differed in |D(x)| + |D(y)| tokens, and with k = (100-t)/(100+t) both |D(x)| + |D(y)| <= k (|x| + |y|) and
    |D(y)| > k (|y| + |c|), so |D(x)| < k (|x| - |c|) <= k |D(x)|. They share at least |D(x)| - H tokens if H is the
    most in which a set of x's size differs from a linked one; so each set shows the first H + 1 tokens of D(x), those
    that c lacks before those that x lacks, and linked sets meet in one. Edits of one text that many documents copy
    are mostly its own, so few of a large group of near copies meet.
    """
    both = _with_sets(table(rest.select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct(), "least"), docs, words, table)
    n = F.size("y")
    most = F.floor((100 - threshold) * (n + F.floor(n * 100 / threshold)) / (100 + threshold)).cast("int")
    d = F.concat(F.array_sort(F.array_except("y", "x")), F.array_sort(F.array_except("x", "y")))
    return both.select(F.col("b").alias("doc_id"), "a", F.explode(F.slice(d, F.lit(1), most + 1)).alias("token")).select(F.xxhash64("a", "token").alias("entry"), "doc_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose shingle sets link, directly or over others.

    Sets are collapsed to one representative (the least doc_id) first, by partial aggregates. Representatives that share
    an index entry are candidates: an entry's members are compared with its least member, by size and bitmap and then
    by the sets themselves. Members that still aren't in the least one's component ("others") must meet all members of
    other components: they are compared in place, by size and bitmap, with the entry's members in blocks. Entries with
    more than BLOCK others are first indexed again by what sets their members apart from the least one, so that only
    those with more of that in common meet. So members of a large group of copies aren't paired, and no link is lost.

    Columns: doc_id, n_shingles, component_id (the least doc_id reachable), representative (of equal sets). A text with
    fewer words than a shingle is one shingle; one without words, or null, has an empty set and links with nothing.
    Rows with a null id get null components; repeated rows each have a row, and different texts of one id are one node;
    of equal texts the least doc_id stands for all; an empty table gives no rows; a very long text is one row with its
    whole set; other columns are ignored. The result is a written table, intermediate ones are deleted.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.max(F.length("text")).alias("most"), F.count("*").alias("n")).head()
    bands = Bands(max(2, (size["most"] or 0) // 2 + 2), size["n"], threshold)
    with scratch(docs.sparkSession) as table:
        sets = table(_sets(docs, bands, words), "sets")
        full = sets.where("n_shingles > 0 and doc_id is not null")
        reps = table(full.groupBy("fingerprint", "n_shingles").agg(F.min("doc_id").alias("rep")), "reps")
        own = full.join(few(reps.select(F.col("rep").alias("doc_id"), "fingerprint"), 64), ["doc_id", "fingerprint"], "left_semi")
        facts = own.select("doc_id", F.col("n_shingles").alias("n"), "bits")
        entries = own.select(F.explode("hashes").alias("entry"), "doc_id")
        rooted, again = None, ROUNDS
        while entries is not None:
            members = table(_members(entries, table), "members")
            rooted, entries = _round(members, rooted, facts, docs, words, threshold, again > 0, table)
            again -= 1
        out = sets.select("doc_id", "n_shingles", "fingerprint").join(reps, ["fingerprint", "n_shingles"], "left")
        out = out.join(few(rooted, 16), out["rep"] == rooted["node"], "left")
        known = F.col("doc_id").isNotNull()
        classes = out.select("doc_id", "n_shingles", F.when(known, F.coalesce("root", "rep", "doc_id")).alias("component_id"), F.when(known, F.coalesce("rep", "doc_id")).alias("representative"))
        return written(classes, "classes")


def _round(members: DataFrame, rooted: DataFrame | None, facts: DataFrame, docs: DataFrame, words: int, threshold: int, again: bool, table) -> tuple[DataFrame, DataFrame | None]:
    """node, root of all links found so far, and if again the entries by which members of groups with many others must meet yet, if any."""

    def with_links(more: DataFrame) -> DataFrame:
        if rooted is not None and more.isEmpty():
            return rooted
        old = more if rooted is None else rooted.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more)
        return table(components(old, table), "rooted")

    fact = lambda k: facts.select(F.col("doc_id").alias(k), F.struct("doc_id", F.lit(0).alias("root"), "n", "bits").alias(f"{k}_"))
    star = table(members.where("doc_id > low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")
    both = star.join(fact("a"), "a").join(fact("b"), "b").where(f"100 * a_.n >= {threshold} * b_.n and 100 * b_.n >= {threshold} * a_.n")
    two = F.array("a_", F.col("b_").withField("root", F.lit(1)))
    rooted = with_links(_linked(_compared(both.select(two.alias("group")), threshold), docs, words, threshold, table))

    root_of = lambda k: few(rooted.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")), 16)
    placed = members.join(root_of("low"), "low", "left").join(root_of("doc_id"), "doc_id", "left")
    other = F.coalesce("doc_id_root", "doc_id") != F.coalesce("low_root", "low")
    placed = placed.select("entry", "low", "doc_id", F.coalesce("doc_id_root", "doc_id").alias("root"), other.alias("other"))
    split = placed.groupBy("entry").agg(F.count("*").alias("size"), F.sum(F.col("other").cast("int")).alias("others")).where("others > 0 and size > 2")
    rest = table(placed.join(few(table(split, "split"), 24), "entry"), "rest")
    small = F.lit(True) if not again else F.col("others") <= BLOCK
    pairs = _compared(_in_blocks(rest.where(small), facts, table), threshold)
    rooted = with_links(_linked(pairs, docs, words, threshold, table))
    large = rest.where(~small & (F.col("doc_id") > F.col("low")))
    return rooted, None if large.isEmpty() else _apart(large, docs, words, threshold, table)


def _in_blocks(rest: DataFrame, facts: DataFrame, table) -> DataFrame:
    """group: arrays of a bounded number of members (doc_id, root, n, bits), in which every other of an entry meets all its members.

    An entry's others are cut into blocks, as are the rest of its members; a block of others meets each block. Blocks
    with the same members are one.
    """
    n_main = F.greatest(F.ceil((F.col("size") - F.col("others")) / BLOCK), F.lit(1)).cast("int")
    n_other = F.ceil(F.col("others") / BLOCK).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("other"), n_other).otherwise(n_main)).cast("int")
    key = lambda i, j, of_others: F.struct(i.alias("i"), j.alias("j"), F.lit(of_others).alias("of_others"))
    with_main = F.transform(upto(n_main), lambda j: key(F.col("own"), j, False))
    with_others = F.transform(upto(n_other), lambda k: key(F.least("own", k), F.greatest("own", k), True))
    of_other = F.concat(with_main, F.when(n_other > 1, with_others).otherwise(F.slice(with_others, 1, 0)))
    of_main = F.transform(upto(n_other), lambda i: key(i, F.col("own"), False))
    dealt = rest.withColumn("own", own).select("entry", "doc_id", F.explode(F.when(F.col("other"), of_other).otherwise(of_main)).alias("block"))
    lists = dealt.groupBy("entry", "block").agg(F.sort_array(F.collect_set("doc_id")).alias("docs")).select("docs").distinct()
    lists = table(lists.withColumn("list", F.monotonically_increasing_id()), "lists")
    roots = rest.select("doc_id", "root").distinct()
    there = lists.select("list", F.explode("docs").alias("doc_id")).join(roots, "doc_id").join(facts, "doc_id")
    return there.groupBy("list").agg(F.collect_list(F.struct("doc_id", "root", "n", "bits")).alias("group")).select("group")


def keep_first(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """docs (doc_id, text and any other columns) with one document of each class at these settings, the one with the least doc_id.

    Rows with a null id stay, as do null and empty texts; of repeated rows or different texts of one id the first by
    text stays; an empty table gives no rows; columns of any name stay as they are.
    """
    classes = near_duplicates(docs, words, threshold)
    drop = written(classes.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    kept = docs.join(few(drop, 8), "doc_id", "left_anti").select(*docs.columns)
    twice = written(classes.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    once = kept.join(few(twice, 8), "doc_id", "left_anti").select(*docs.columns)
    place = fresh(docs, "place")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    return once.union(kept.join(few(twice, 8), "doc_id", "left_semi").select(*docs.columns).withColumn(place, order).where(F.col(place) == 1).drop(place))
