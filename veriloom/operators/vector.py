"""Exact vector search joined to the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.scalars import cosine_similarity, dot

LISTED = ["original_hash", "file_extension", "title", "price_lamports", "owner_wallet"]


def similarities(vectors: DataFrame, media: DataFrame, query: list[float] | DataFrame) -> DataFrame:
    """Cosine similarity of the query to each vector of public media: media_id, similarity and the media's columns.

    query: the components, or a DataFrame of one row with a column query. A media record has a row for each of its
    vectors; records whose flag is null, null vectors and vectors of another length are left out.
    """
    public = media.where("is_public = true")
    rows = vectors.where("embedding is not null").join(public, "media_id")
    if isinstance(query, DataFrame):
        # One row, else an error when it runs.
        one = query.limit(2).agg(F.collect_list("query").alias("q")).select(F.when(F.size("q") == 1, F.col("q")[0]).otherwise(F.raise_error(F.lit("one query vector expected"))).alias("query"))
        rows = rows.crossJoin(F.broadcast(one.withColumn("norm", dot(F.col("query"), F.col("query")))))
        q: Column = F.col("query")
        squared: Column | None = F.col("norm")
    else:
        q, squared = F.array(*[F.lit(float(x)) for x in query]), F.lit(float(sum(x * x for x in query)))
    return rows.withColumn("similarity", cosine_similarity(F.col("embedding"), q, squared)).where("similarity is not null").drop("query", "norm", "embedding")


def search_similar(vectors: DataFrame, media: DataFrame, query: list[float] | DataFrame, k: int = 20) -> DataFrame:
    """The k nearest public records, nearest first, ties to the smaller id: a distributed top-k, no full sort.

    The top-k sees ids and flags only; the columns that are shown are read for its k rows.
    """
    best = similarities(vectors, media.select("media_id", "is_public"), query).orderBy(F.col("similarity").desc(), "media_id").limit(k).select("media_id", "similarity")
    shown = media.where("is_public = true").select("media_id", *LISTED)
    return shown.join(F.broadcast(best), "media_id").orderBy(F.col("similarity").desc(), "media_id").limit(k).select("media_id", "similarity", *LISTED)  # k rows


def insert_if_absent(vectors: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming vectors whose media has none yet; of several for one media the first by model stays."""
    fresh = incoming.join(vectors.select("media_id"), "media_id", "left_anti")
    return fresh.groupBy("media_id").agg(F.min_by(F.struct("*"), F.struct("model_name")).alias("r")).select("r.*")
