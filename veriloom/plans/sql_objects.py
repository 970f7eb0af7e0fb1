"""The catalogue as SQL: views, a search function that is called like a table, and row policies over a session variable.

A purchase is seen by its buyer, whose wallet is in the variable. The policies as they were written down admit everyone
to everything, since those meant for the service name no role; here the rule is built as it was meant.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from veriloom.sources import views

WALLET = "claim_wallet"
_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"


def define(spark: SparkSession, sf_dir: str) -> None:
    """Makes media_proofs, feature_vectors, all_purchases, purchases, search_similar(query, k) and the variable claim_wallet in the session."""
    for name, view in (("media_proofs", views.media), ("feature_vectors", views.vectors), ("all_purchases", views.purchases)):
        view(spark, sf_dir).createOrReplaceTempView(name)
    dot, own, asked = (_DOT.format(a=a, b=b) for a, b in (("embedding", "query"), ("embedding", "embedding"), ("query", "query")))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION search_similar(query ARRAY<DOUBLE>, k INT DEFAULT 20)
 RETURNS TABLE(media_id BIGINT, similarity DOUBLE, original_hash STRING, file_extension STRING, title STRING, price_lamports BIGINT, owner_wallet STRING)
 RETURN SELECT media_id, similarity, original_hash, file_extension, title, price_lamports, owner_wallet FROM (
  SELECT *, row_number() OVER (ORDER BY similarity DESC, media_id) AS place FROM (
   SELECT m.*, {dot} / nullif(sqrt({own} * {asked}), 0) AS similarity FROM feature_vectors v JOIN media_proofs m ON m.media_id = v.media_id WHERE m.is_public AND size(v.embedding) = size(query))
  WHERE similarity IS NOT NULL) WHERE place <= k""")
    spark.sql(f"DECLARE OR REPLACE VARIABLE {WALLET} STRING DEFAULT NULL")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW purchases AS SELECT * FROM all_purchases WHERE CAST(buyer AS STRING) = session.{WALLET}")
