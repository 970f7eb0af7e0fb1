"""Vector code compression: equal integer parts become weighted distinct rows, weighted Lloyd runs over those, and codes and errors are joined back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, in_batches, measured_few, scratch, written
from .topk_search import quantized, usable

#: Parts of a vector, entries of a part's codebook (the first vectors), rounds of Lloyd.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A part's value that this share of all vectors have is joined apart, by a broadcast: there are at most PARTS * HOT such values.
HOT = 256
#: Largest long: errors stop there.
MOST = 2**63 - 1
#: Components below this make distances that doubles hold exactly, in parts of up to 2048 components; those below the second, longs.
_IN_DOUBLE, _IN_LONG = 2**20, 2**26


def packed_values(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes, one form for each row: two bytes a component where all fit, else eight."""
    small = (np.abs(x.astype(np.float64)) < 2**15).all(axis=1)
    short, long_ = iter(x[small].astype("<i2")), iter(x[~small].astype("<i8"))
    return [next(short if s else long_).tobytes() for s in small.tolist()]


def unpacked_values(values: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.int64)
    short = np.array([len(v) == 2 * width for v in values], bool)
    for mask, kind in ((short, "<i2"), (~short, "<i8")):
        at = np.flatnonzero(mask)
        if len(at) and width:
            out[at] = np.frombuffer(b"".join([values[k] for k in at]), kind).reshape(-1, width)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of equally near ones, and its squared distance (a long, or Python integers where longs can't hold it)."""
    largest = max(np.abs(a.astype(np.float64)).max(initial=0) for a in (x, book))
    if largest < _IN_DOUBLE and x.shape[1] <= 2048:
        a, b = x.astype(np.float64), book.astype(np.float64)
        away = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    else:
        kind = np.int64 if largest < _IN_LONG and x.shape[1] <= 256 else object
        a, b = x.astype(kind), book.astype(kind)
        away = np.stack([((a - e) ** 2).sum(axis=1) for e in b], axis=1)
    code = np.argmin(away, axis=1)
    error = away[np.arange(len(x)), code]
    return code, error if error.dtype == object else error.astype(np.int64)


_PART = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("value", pa.binary())])


def _split(held: DataFrame, parts: int, width: int) -> DataFrame:
    """row, part, value for each vector's equal consecutive parts; shorter vectors end in zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lists = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            x = np.zeros((len(lists), parts * width), np.int64)
            for k, v in enumerate(lists):
                x[k, : len(v)] = v
            yield emit(_PART, row=np.repeat(row, parts), part=np.tile(np.arange(parts, dtype=np.int32), len(row)), value=packed_values(x.reshape(-1, width)))

    return in_batches(held.select("row", "x"), run, "row long, part int, value binary")


def _by_part(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    part, x = batch.column(0).to_numpy(), unpacked_values(batch.column(1).to_pylist(), books.shape[2])
    for p in np.unique(part).tolist():
        at = np.flatnonzero(part == p)
        yield p, at, x[at], *nearest(x[at], books[p])


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38, 0)), ("weight", pa.int64())])


def lloyd(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floor of the weighted mean of the values nearest to it; entries without any stay.

    distinct: part, value, weight. A task sends one row for each entry's component; the sums reach the driver, as many
    numbers as the codebooks have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            weight = batch.column(2).to_numpy()
            for p, at, x, code, _ in _by_part(batch, books):
                w = weight[at]
                exact = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(w.sum()) < 2**62
                sums = np.zeros(books.shape[1:], np.int64 if exact else object)
                np.add.at(sums, code, x * w[:, None] if exact else x.astype(object) * w[:, None])
                total[p] += sums.astype(object)
                np.add.at(n[p], code, w)
        part, entry = np.nonzero(n)
        width = books.shape[2]
        place = np.tile(np.arange(width, dtype=np.int32), len(part))
        each = [np.repeat(v, width) for v in (part.astype(np.int32), entry.astype(np.int32), n[part, entry])]
        yield emit(_SUMS, part=each[0], entry=each[1], place=place, total=pa.array([Decimal(int(v)) for v in total[part, entry].ravel()], pa.decimal128(38, 0)), weight=each[2])

    sums = in_batches(distinct.select("part", "value", "weight"), run, "part int, entry int, place int, total decimal(38,0), weight long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).collect():  # as many rows as the codebooks have numbers
        out[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["weight"]
    return out


_CODED = pa.schema([("part", pa.int32()), ("value", pa.binary()), ("weight", pa.int64()), ("code", pa.int64()), ("error", pa.int64())])


def assign(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """distinct (part, value, weight) with code and error, the squared distance to that entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for _, at, _, c, e in _by_part(batch, books):
                code[at], error[at] = c, np.minimum(e, MOST).astype(np.int64)
            yield emit(_CODED, part=batch.column(0), value=batch.column(1), weight=batch.column(2), code=code, error=error)

    return in_batches(distinct.select("part", "value", "weight"), run, "part int, value binary, weight long, code long, error long")


def with_codes(each: DataFrame, coded: DataFrame, n: int) -> DataFrame:
    """each (row, part, value) with code and error from coded.

    Values that n / HOT vectors or more have are few, which their weights prove: they are broadcast, so that they don't
    meet in one task each; the others are joined by a shuffle.
    """
    often = F.col("weight") * HOT >= n
    hot = each.join(F.broadcast(coded.where(often).select("part", "value", "code", "error")), ["part", "value"], "left")
    rest = hot.where("code IS NULL").select("row", "part", "value").join(coded.where(~often).select("part", "value", "code", "error"), ["part", "value"])
    return hot.where("code IS NOT NULL").select("row", "part", "code", "error").union(rest.select("row", "part", "code", "error"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each vector without null or non-finite components.

    Components become floor(256 * x); a vector is cut into equal consecutive parts, each coded by the nearest entry of its
    position's codebook (two hex digits, so at most 256 entries). Codebooks begin as the vectors with the smallest ids and
    move by weighted Lloyd. error is the sum of squared distances, label_error their sum over equal labels, nulls together;
    both stop at 2**63 - 1. codebooks_sha256 is of all entries' components, comma-joined.

    Null ids come last in that order, equal ids in the order of their vectors; repeated rows each have a row; vectors that
    are shorter than the longest, or whose length isn't a multiple of the parts, count as ending in zeros; with fewer
    vectors than entries, codebooks are as short; an empty table gives no rows; other columns are ignored. The result is
    a written table.
    """
    x = F.col(vector_col)
    src = vectors.where(usable(x)).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), quantized(x).alias("x"))
    with scratch(vectors.sparkSession) as table:
        held = table(src.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")
        n, longest = held.agg(F.count("*"), F.max(F.size("x"))).head()
        if not n:
            none = held.select("vec_id", F.lit("").alias("code"), *[F.col("row").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
            return written(none, "vector-codes")
        width = -(-longest // parts)
        first = [r["x"] for r in held.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
        books = np.zeros((len(first), parts * width), np.int64)
        for k, v in enumerate(first):
            books[k, : len(v)] = v
        books = np.ascontiguousarray(books.reshape(len(first), parts, width).transpose(1, 0, 2))
        each = _split(held, parts, width)
        distinct = table(each.groupBy("part", "value").agg(F.count("*").alias("weight")), "distinct")
        for _ in range(rounds):
            books = lloyd(distinct, books)
        coded = with_codes(each, table(assign(distinct, books), "coded"), n)
        # Eight codes make a long, so that a vector's parts come together by an aggregate of fixed width.
        place = 8 * (7 - F.col("part") % 8)
        words = [F.bit_or(F.when(F.floor(F.col("part") / 8) == k, F.call_function("shiftleft", F.col("code"), place.cast("int"))).otherwise(0)) for k in range(-(-parts // 8))]
        digits = F.substring(F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in words]), 1, 2 * parts)
        stopped = lambda total: F.least(total, F.lit(MOST)).cast("long")
        by_row = coded.groupBy("row").agg(digits.alias("code"), stopped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("error"))
        rows = table(held.select("row", "vec_id", "label").join(by_row, "row"), "rows")
        labels = rows.groupBy(F.col("label").alias("own_label")).agg(stopped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        out = rows.join(measured_few(labels), F.col("label").eqNullSafe(F.col("own_label")))
        return written(out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), "vector-codes")
