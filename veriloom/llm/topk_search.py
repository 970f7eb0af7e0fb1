"""Exact top-k search by inner product over a forest of M-trees."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Entries in a page of a tree; vectors in a tree, about; queries searched together.
PAGE, TREE, BLOCK = 64, 4096, 4096
#: Pivots that deal the vectors to trees, and vectors that give each query a first bound; both are picked by hash.
PIVOTS, SAMPLE = 32, 1024
K = 5
#: Below every score; its square root of a distance is finite.
NO_FLOOR = -(2**62)


def quantized(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    """Neither null nor with null, NaN or infinite components."""
    return F.coalesce(embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in column]) if len(column) else np.zeros((0, 0), np.int64)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more component that brings all to the norm sqrt(most): nearer means a larger inner product with a query, whose own is 0."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((a - b) ** 2).sum(axis=-1), 0))


class Tree:
    """Pages of a bulk-loaded M-tree. A page has a pivot, the place of one of its vectors; each entry keeps its distance to it, and an inner page's entries (pages) their covering radii."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.pages: list[dict] = []
        self._build(np.arange(len(ids)), ids, points, 0)

    def _build(self, own: np.ndarray, ids: np.ndarray, points: np.ndarray, pivot: int) -> int:
        page, k = {"pivot": pivot}, len(self.pages)
        self.pages.append(page)
        if len(own) <= PAGE:
            own = own[np.argsort(ids[own], kind="stable")]
            page |= {"leaf": True, "entries": own, "away": distances(points[own], points[pivot]), "radius": np.zeros(len(own))}
            return k
        parts = self._parts(own, points)
        page |= {
            "leaf": False,
            "entries": np.array([self._build(part, ids, points, center) for part, center in parts]),
            "radius": np.array([distances(points[part], points[center]).max() for part, center in parts]),
            "away": np.array([distances(points[center], points[pivot]) for _, center in parts]),
        }
        return k

    @staticmethod
    def _parts(own: np.ndarray, points: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Up to PAGE parts around spread-out pivots; vectors that no pivot tells apart are cut evenly."""
        n = min(PAGE, -(-len(own) // (PAGE // 2)))
        x = points[own]
        pivots, far, near = [0], distances(x, x[0]), np.zeros(len(own), np.int64)
        while len(pivots) < n and far.max() > 0:
            pivots.append(int(far.argmax()))
            away = distances(x, x[pivots[-1]])
            near[away < far] = len(pivots) - 1
            far = np.minimum(far, away)
        groups = [(own[near == g], int(own[p])) for g, p in enumerate(pivots)]
        if max(len(g) for g, _ in groups) == len(own):
            return [(g, int(g[0])) for g in np.array_split(own, n)]
        return groups


def search(tree: Tree, ids: np.ndarray, raw: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, k: int, floors: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of the tree's vectors for each query of a block, as places in the block, vector ids and scores; scores below a query's floor may be left out.

    Best first: the page with the least lower bound of any query's distance comes next, for those queries that still need
    it. A page's or vector's distance to a query isn't computed where the stored distance to the parent's pivot and the
    query's distance to that pivot rule it out for all of them. Ties go to the smaller id; a query's own id is left out.
    """
    norm = (asked.astype(np.float64) ** 2).sum(axis=1)
    # A score and its distance: d^2 = norm + most - 2 score. The slack covers rounding.
    slack = 1e-6 * (np.sqrt(norm + most) + 1)
    away_of = lambda at, score: np.sqrt(np.maximum((norm[at] + most)[:, None] - 2.0 * score, 0))
    best_id = np.full((len(asked), k), np.iinfo(np.int64).max)
    best = np.full((len(asked), k), np.iinfo(np.int64).min)
    least = floors.copy()
    reach = away_of(np.arange(len(asked)), least[:, None].astype(np.float64))[:, 0] + slack
    every = np.arange(len(asked))
    root = tree.pages[0]
    heap = [(0.0, 0, every, np.zeros(len(asked)), away_of(every, asked @ raw[root["pivot"]][:, None])[:, 0])]
    while heap:
        _, at, live, bound, d_pivot = heapq.heappop(heap)
        page = tree.pages[at]
        needed = bound <= reach[live]
        live, bound, d_pivot = live[needed], bound[needed], d_pivot[needed]
        if not len(live):
            continue
        low = np.abs(d_pivot[:, None] - page["away"]) - page["radius"]
        open_ = low <= reach[live][:, None]
        some, entries = open_.any(axis=1), np.flatnonzero(open_.any(axis=0))
        if not len(entries):
            continue
        live, bound, low, open_ = live[some], bound[some], low[some][:, entries], open_[some][:, entries]
        own = page["entries"][entries] if page["leaf"] else np.array([tree.pages[e]["pivot"] for e in page["entries"][entries]])
        scores = asked[live] @ raw[own].T
        if not page["leaf"]:
            away = away_of(live, scores)
            low = np.maximum(np.maximum(low, away - page["radius"][entries]), bound[:, None])
            open_ &= low <= reach[live][:, None]
            for e, child in enumerate(page["entries"][entries].tolist()):
                go = np.flatnonzero(open_[:, e])
                if len(go):
                    heapq.heappush(heap, (float(low[go, e].min()), child, live[go], low[go, e], away[go, e]))
            continue
        scores, found = scores.astype(np.int64), ids[own]
        fits = (scores >= least[live][:, None]) & (found != asked_ids[live][:, None])
        better = np.flatnonzero(fits.any(axis=1))
        if not len(better):
            continue
        rows, fits = live[better], fits[better]
        both = np.concatenate([best[rows], np.where(fits, scores[better], np.iinfo(np.int64).min)], axis=1)
        both_id = np.concatenate([best_id[rows], np.where(fits, found, np.iinfo(np.int64).max)], axis=1)
        first = np.lexsort((both_id, -1 - both), axis=-1)[:, :k]  # -1 - x falls as x rises and can't overflow
        best[rows], best_id[rows] = np.take_along_axis(both, first, axis=1), np.take_along_axis(both_id, first, axis=1)
        least[rows] = np.maximum(least[rows], best[rows, -1])
        reach[rows] = away_of(rows, least[rows][:, None].astype(np.float64))[:, 0] + slack[rows]
    query, rank = np.nonzero(best > np.iinfo(np.int64).min)
    return query, best_id[query, rank], best[query, rank]


def tree_pairs(queries: DataFrame, trees: DataFrame) -> DataFrame:
    """id, block, dim, cell, part: the trees that may hold a vector within a query's reach.

    queries: id, x, block, reach, near (distances to the cells' pivots); trees: dim, cell, part, radius around the pivot.
    """
    narrow = queries.select("id", "block", F.size("x").alias("dim"), "reach", "near")
    within = F.coalesce(F.get("near", F.col("cell")) - F.col("radius") <= F.col("reach"), F.lit(True))
    return narrow.join(trees, "dim").where(within).select("id", "block", "dim", "cell", "part")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", component_col: str = "x") -> DataFrame:
    """The k best vectors of each query by integer inner product, the query's own id left out, ties to the smaller id.

    vectors and queries: an id and an array of integers. Vectors are dealt to trees by their nearest pivot and, within
    a pivot's cell, by hash into trees of about TREE vectors, so a hot cell has many trees. Each tree's pages are built
    and searched in one task for a block of queries; a block has about BLOCK queries. A bounded sample of the vectors
    gives each query a score that its k-th best can't fall below; a query skips the trees whose radius around their
    pivot keeps all vectors under it, and the others leave out what is under it.

    Columns: query_id, rank (from 1), vec_id, score. Vectors of another length than the query's take no part; null ids
    are left out; a repeated id counts once; fewer vectors than k give all; either table empty gives no rows; other
    columns are ignored.
    Components must keep the inner products within 64 bits.
    """
    tidy = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(component_col).cast("array<long>").alias("x")).where("id is not null and x is not null")
    vecs = written(tidy(vectors).groupBy("id").agg(F.min("x").alias("x")), "vectors")
    asked = written(tidy(queries).groupBy("id").agg(F.min("x").alias("x")), "queries")
    spark = vectors.sparkSession
    n_queries, n = asked.count(), vecs.count()
    hash_ = F.xxhash64("id", F.lit("pivot"))
    some = vecs.where(F.pmod(hash_, F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, 2 * SAMPLE / max(n, 1))) + 1)).orderBy(hash_, "id").limit(SAMPLE).toPandas()
    norm = F.aggregate("x", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))
    most = float(vecs.agg(F.max(norm)).head()[0] or 0.0)
    sample = spark.sparkContext.broadcast((some["id"].to_numpy(np.int64), [np.asarray(x, np.int64) for x in some["x"]]))
    blocks, trees = max(1, -(-n_queries // BLOCK)), "id long, x array<long>, dim int, cell int, away double"

    def deal(parts):
        _, xs = sample.value
        for pdf in parts:
            dims = np.array([len(x) for x in pdf["x"]], np.int64)
            cell, away = np.zeros(len(pdf), np.int64), np.full(len(pdf), np.inf)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                pivots = [x for x in xs[:PIVOTS] if len(x) == dim]
                if pivots and dim:
                    x, p = lifted(matrix(pdf["x"].iloc[at]), most), lifted(np.stack(pivots), most)
                    cell[at] = ((p * p).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)
                    away[at] = distances(x, p[cell[at]])
            yield pdf.assign(dim=dims.astype(np.int32), cell=cell.astype(np.int32), away=away)

    celled = written(vecs.mapInPandas(deal, trees), "cells")
    cells = celled.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    split = F.pmod(F.xxhash64("id", F.lit("tree")), F.ceil(F.col("n") / TREE)).cast("int")
    placed = celled.join(cells, ["dim", "cell"]).select("id", "x", "dim", "cell", split.alias("part"), "away")

    def first_bound(parts):
        ids, xs = sample.value
        for pdf in parts:
            floors = pd.Series(pd.NA, index=pdf.index, dtype="Int64")
            reach, near = pd.Series(np.inf, index=pdf.index), pd.Series([np.zeros(0)] * len(pdf), index=pdf.index)
            dims = pdf["x"].map(len)
            for dim in dims.unique():
                own = pdf[dims == dim]
                same = [i for i, y in enumerate(xs) if len(y) == dim]
                if dim and len(same) > k:  # one may be the query itself
                    scores = matrix(own["x"]) @ np.stack([xs[i] for i in same]).T
                    scores[own["id"].to_numpy(np.int64)[:, None] == ids[same]] = np.iinfo(np.int64).min
                    floors[own.index] = np.partition(scores, -k, axis=1)[:, -k]
                pivots = [x for x in xs[:PIVOTS] if len(x) == dim]
                if dim and pivots:
                    q = matrix(own["x"]).astype(np.float64)
                    to = ((q * q).sum(axis=1) + most)[:, None] - 2 * q @ np.stack(pivots).astype(np.float64).T
                    near[own.index] = list(np.sqrt(np.maximum(to, 0)))
                    far = (q * q).sum(axis=1) + most
                    bound = np.sqrt(np.maximum(far - 2 * floors[own.index].fillna(NO_FLOOR).to_numpy(np.float64), 0))
                    reach[own.index] = bound + 1e-6 * (np.sqrt(far) + 1)
            yield pdf.assign(floor=floors, reach=reach, near=near)

    bounded = written(asked.mapInPandas(first_bound, "id long, x array<long>, floor long, reach double, near array<double>").withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")), "bounded")
    each = written(placed.groupBy("dim", "cell", "part").agg(F.max("away").alias("radius")), "trees")
    pairs = written(tree_pairs(bounded, each), "pairs")
    # A tree meets each block that has queries for it once; its vectors go to those blocks only.
    sides = pairs.join(bounded.select("id", "x", "floor"), "id")
    left = placed.drop("away").join(written(pairs.select("dim", "cell", "part", "block").distinct(), "meetings"), ["dim", "cell", "part"])

    def run(vec: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(vec) or not len(ask) or not len(vec["x"].iloc[0]):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, raw = vec["id"].to_numpy(np.int64), matrix(vec["x"])
        points = lifted(raw, most)
        tree = Tree(ids, points)
        asked, floors = matrix(ask["x"]), ask["floor"].fillna(NO_FLOOR).to_numpy(np.int64)
        # Whole numbers below 2^53 multiply exactly as doubles.
        if float(np.abs(raw).max()) * float(np.abs(asked).max()) * raw.shape[1] < 2**52:
            raw, asked = raw.astype(np.float64), asked.astype(np.float64)
        asked_ids = ask["id"].to_numpy(np.int64)
        at, found, score = search(tree, ids, raw, asked, asked_ids, k, floors, most)
        return pd.DataFrame({"query_id": asked_ids[at], "vec_id": found, "score": score})

    keys = ["dim", "cell", "part", "block"]
    found = left.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
