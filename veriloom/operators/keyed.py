"""Tables in hash buckets of their key: a change rewrites the buckets that it touches, through one path that keeps created_at and updated_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 256


class KeyedTable:
    """Parquet files by bucket under a path; one row a key.

    A change reads the buckets of its own keys and writes those anew (dynamic partition overwrite); the other buckets'
    files aren't read or written. Every change goes through `_change`, which sets updated_at of the rows it hits, also
    when their values stay, and created_at of new ones, where the table has these columns. Rows with a null key can be
    neither inserted nor hit. One writer at a time; a change that fails before its commit leaves the table as it was, and
    one that is run again gives the same values.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> KeyedTable:
        """A new table of rows that have one row a key."""
        table = cls(rows.sparkSession, path, key, rows.schema, buckets)
        table._write(rows.where(F.col(key).isNotNull()).withColumn("bucket", table._bucket()))
        return table

    def read(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def upsert(self, source: DataFrame, order: list[str], now: Column, optional: tuple[str, ...] = ()) -> None:
        """Inserts or overwrites the source's columns; of several rows for a key the last in this order counts, and a null in an optional column leaves the value."""
        last = source.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in source.columns if c != self.key]), F.struct(*order)).alias("r")).select(self.key, "r.*")
        names = [c for c in source.columns if c in self.schema.names and c != self.key]
        self._change(last, {c: f"coalesce(s.{c}, t.{c})" if c in optional else f"s.{c}" for c in names}, now, insert=True)

    def insert_if_absent(self, source: DataFrame, order: list[str], now: Column) -> None:
        """Inserts the keys that the table doesn't have, the first row of each in this order."""
        first = source.groupBy(self.key).agg(F.min_by(F.struct(*[c for c in source.columns if c != self.key]), F.struct(*order)).alias("r")).select(self.key, "r.*")
        self._change(first, {c: f"s.{c}" for c in source.columns if c in self.schema.names and c != self.key}, now, insert=True, where="t IS NULL")

    def update(self, source: DataFrame, sets: dict[str, str], now: Column, where: str = "true") -> None:
        """Sets columns of the keys that source has (one row a key) where a condition holds. Expressions see the table's row as t and the source's as s."""
        self._change(source, sets, now, insert=False, where=where)

    def count(self, events: DataFrame, column: str, now: Column) -> None:
        """Adds the number of each key's events to a column; null counts as 0."""
        n = events.groupBy(self.key).agg(F.count("*").alias("more"))
        self._change(n, {column: f"cast(coalesce(t.{column}, 0) + s.more AS {self.schema[column].dataType.simpleString()})"}, now, insert=False)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _change(self, source: DataFrame, sets: dict[str, str], now: Column, insert: bool, where: str = "true") -> None:
        source = source.where(F.col(self.key).isNotNull()).withColumn("bucket", self._bucket())
        touched = [r["bucket"] for r in source.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return
        old = self._stored().where(F.col("bucket").isin(touched))
        old = old.select("bucket", F.col(self.key).alias("old_key"), F.struct(*self.schema.names).alias("t"))
        new = source.select("bucket", F.col(self.key).cast(self.schema[self.key].dataType).alias("new_key"), F.struct(*[c for c in source.columns if c != "bucket"]).alias("s"))
        both = old.join(new.withColumnRenamed("bucket", "new_bucket"), F.col("old_key") == F.col("new_key"), "full" if insert else "left")
        both = both.withColumn("hit", F.col("s").isNotNull() & F.coalesce(F.expr(where), F.lit(False)))

        def value(name: str) -> Column:
            was = F.col(f"t.{name}")
            if name == self.key:
                out = F.coalesce("old_key", "new_key")
            elif name == "created_at":
                out = F.when(F.col("t").isNull(), now).otherwise(was)
            elif name == "updated_at":
                out = F.when(F.col("hit"), now).otherwise(was)
            else:
                out = F.when(F.col("hit"), F.expr(sets[name])).otherwise(was) if name in sets else was
            return out.cast(self.schema[name].dataType).alias(name)

        rows = both.where("t IS NOT NULL OR hit").select(*map(value, self.schema.names), F.coalesce("bucket", "new_bucket").alias("bucket"))
        self._write(rows)
