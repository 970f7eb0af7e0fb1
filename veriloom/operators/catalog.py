"""Catalogue pages, counts and access rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PER_PAGE = 100


def check_page(page: int, limit: int) -> None:
    """1 <= page, 1 <= limit <= 100; anything that isn't a whole number is rejected."""
    if type(page) is not int or type(limit) is not int or page < 1 or not 1 <= limit <= MOST_PER_PAGE:
        raise ValueError(f"page must be 1 or more and limit 1 to {MOST_PER_PAGE}")


def page_of(rows: DataFrame, order: list[Column], page: int = 1, limit: int = 20) -> DataFrame:
    """One page in this order, which must be total: a top-k over offset + limit rows, no full sort."""
    check_page(page, limit)
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit)


def envelope(rows: DataFrame, order: list[Column], page: int = 1, limit: int = 20) -> DataFrame:
    """One row: items (the page's rows as an array), total, page, limit, total_pages."""
    check_page(page, limit)
    held = page_of(rows, order, page, limit).agg(F.collect_list(F.struct("*")).alias("items"))
    return held.crossJoin(rows.agg(F.count("*").alias("total"))).select("items", "total", F.lit(page).alias("page"), F.lit(limit).alias("limit"), F.ceil(F.col("total") / limit).alias("total_pages"))


def owned(listing: DataFrame, owners: DataFrame, wallet: str) -> DataFrame:
    """The listed media that the wallet owns on the chain."""
    return listing.join(owners.where(F.col("chain_owner") == wallet).select("media_id"), "media_id", "left_semi")


def bought(purchases: DataFrame, listing: DataFrame) -> DataFrame:
    """Purchases with their media as a struct; purchases of unknown media are left out."""
    media = listing.select("media_id", F.struct("title", "price_lamports").alias("media"))
    return purchases.join(media, "media_id")


def with_thumbnails(listing: DataFrame, objects: DataFrame) -> DataFrame:
    """listing with thumbnail, null where there is none; objects: media_id, thumbnail, of which the first by name counts."""
    return listing.join(objects.groupBy("media_id").agg(F.min("thumbnail").alias("thumbnail")), "media_id", "left")


def exactly_one(rows: DataFrame, optional: bool = False):
    """The only row; an error for more than one, and for none unless optional."""
    got = rows.limit(2).collect()
    if len(got) > 1 or not got and not optional:
        raise ValueError(f"one row expected, {'more' if got else 'none'} found")
    return got[0] if got else None


def one_row(rows: DataFrame, optional: bool = False) -> DataFrame:
    """rows, of which there must be one, or none if optional; otherwise running it is an error. Two rows at most leave a task's partition."""
    names = rows.columns
    held = rows.select(F.struct(*[F.col(c) for c in names]).alias("r")).limit(2).agg(F.collect_list("r").alias("rs"))
    many = F.raise_error(F.lit("one row expected, more found")).cast("boolean")
    none = F.lit(False) if optional else F.raise_error(F.lit("one row expected, none found")).cast("boolean")
    fine = F.when(F.size("rs") > 1, many).when(F.size("rs") == 0, none).otherwise(True)
    return held.where(fine).select(F.col("rs")[0].alias("r")).select("r.*")


def page_request(page: Column, limit: Column) -> Column:
    """Whether texts ask for a page that there can be: 1 <= page and 1 <= limit <= 100. Null and empty texts count as the defaults, a number may be followed by anything, and a text without one is rejected."""

    def number(x: Column, unsaid: int) -> Column:
        return F.when(x.isNull() | (x == ""), unsaid).otherwise(F.regexp_extract(x, r"^\s*([+-]?[0-9]{1,18})", 1).try_cast("long"))

    n = number(limit, 20)
    return F.coalesce((number(page, 1) >= 1) & (n >= 1) & (n <= MOST_PER_PAGE), F.lit(False))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each key: an aggregate with partial results, so a hot key costs one row for each task."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("last")).select(*keys, "last.*")


def access(requests: DataFrame, media: DataFrame, purchases: DataFrame) -> DataFrame:
    """Whether a viewer may see a record: public, or the viewer owns it, or bought it.

    requests: media_id, viewer; media: media_id, is_public, owner_wallet; purchases: media_id, viewer. Requests for
    unknown media are left out; a null flag counts as not public.
    """
    known = requests.join(media.select("media_id", "is_public", "owner_wallet"), "media_id")
    got = known.join(purchases.select("media_id", "viewer").distinct().withColumn("bought", F.lit(True)), ["media_id", "viewer"], "left")
    reason = F.when(F.col("is_public"), "public").when(F.col("owner_wallet") == F.col("viewer"), "owner").when(F.col("bought"), "purchased").otherwise("denied")
    return got.select("media_id", "viewer", reason.alias("reason"), (reason != "denied").alias("allowed"))


def manifest_visible(is_public: Column, owner: Column, viewer: Column) -> Column:
    """Public (also without a row) or seen by its owner."""
    return F.coalesce(is_public, F.lit(True)) | owner.eqNullSafe(viewer)


def buyer_rows(purchases: DataFrame, wallet: str) -> DataFrame:
    """The row policy of purchases as it was meant: a buyer sees their own."""
    return purchases.where(F.col("buyer").cast("string") == wallet)
