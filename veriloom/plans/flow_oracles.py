"""DuckDB SQL of the queries over queues, tokens and tables that change, written apart from the Spark code."""

from .oracles import _BOUGHT, _JOBS, _MEDIA, _SIM

# A step of the recursion is a check that finds the active job stalled, or else the queue's next event.
_SERIAL = """WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY t, event_id) AS n FROM (SELECT user_id % 16 AS q, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 600) AS BIGINT) AS t, event_id, user_id AS e_job,
 CASE event_type WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'add' WHEN 'view' THEN 'beat' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' END AS kind FROM events)),
s AS (SELECT DISTINCT q, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS job, CAST(NULL AS BIGINT) AS lock, 0 AS stalls, CAST([] AS BIGINT[]) AS line, CAST(0 AS BIGINT) AS seq,
  CAST([] AS STRUCT(seq BIGINT, t BIGINT, job BIGINT, what VARCHAR, stalls INTEGER)[]) AS said FROM ev
 UNION ALL
 SELECT q, n, CASE WHEN job IS NULL THEN line[1] ELSE job END, CASE WHEN job IS NULL AND len(line) > 0 THEN now + 30 ELSE lock END, CASE WHEN job IS NULL THEN 0 ELSE stalls END, CASE WHEN job IS NULL THEN line[2:] ELSE line END,
  seq + len(said) + CASE WHEN job IS NULL AND len(line) > 0 THEN 1 ELSE 0 END, said || CASE WHEN job IS NULL AND len(line) > 0 THEN [{'seq': seq + len(said) + 1, 't': now, 'job': line[1], 'what': 'active', 'stalls': 0}] ELSE [] END
 FROM (
  SELECT q, CASE WHEN stuck THEN n ELSE n + 1 END AS n, CASE WHEN stuck THEN CASE WHEN stalls = 0 THEN job END WHEN own AND kind IN ('completed', 'failed') THEN NULL ELSE job END AS job,
   CASE WHEN stuck THEN now + 30 WHEN own AND kind = 'beat' THEN t + 30 ELSE lock END AS lock, CASE WHEN stuck THEN 1 ELSE stalls END AS stalls, now, seq,
   CASE WHEN NOT stuck AND kind = 'add' AND NOT own AND NOT list_contains(line, e_job) THEN line || [e_job] ELSE line END AS line,
   CASE WHEN stuck AND stalls = 0 THEN [{'seq': seq + 1, 't': now, 'job': job, 'what': 'stalled', 'stalls': 1}, {'seq': seq + 2, 't': now, 'job': job, 'what': 'active', 'stalls': 1}]
    WHEN stuck THEN [{'seq': seq + 1, 't': now, 'job': job, 'what': 'failed', 'stalls': 2}] WHEN own AND kind IN ('completed', 'failed') THEN [{'seq': seq + 1, 't': now, 'job': job, 'what': kind, 'stalls': stalls}] ELSE [] END AS said
  FROM (
   SELECT s.*, t, e_job, kind, coalesce(job = e_job, false) AS own, job IS NOT NULL AND (lock + 29) // 30 * 30 <= coalesce(t, 7200) AS stuck, CASE WHEN job IS NOT NULL AND (lock + 29) // 30 * 30 <= coalesce(t, 7200) THEN (lock + 29) // 30 * 30 ELSE t END AS now
   FROM s LEFT JOIN ev ON ev.q = s.q AND ev.n = s.n + 1) WHERE stuck OR t IS NOT NULL))
SELECT q AS queue, x.seq AS seq, strftime(TIMESTAMP '2024-01-01' + to_seconds(x.t), '%H:%M:%S') AS at, x.job AS job_id, x.what AS what, x.stalls AS stalls FROM (SELECT q, unnest(said) AS x FROM s)"""

_BURSTS = """WITH t AS (SELECT event_id AS token, ts + INTERVAL 264 HOURS AS e, CAST(props->>'$.k' AS INTEGER) % 12 AS n FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS request_id, ts AS w, CASE WHEN event_id % 3 = 0 THEN 2 ELSE event_id % 97 END AS token FROM events),
x AS (SELECT r.*, t.token IS NOT NULL AS known, w > e AS late, n, sum(CASE WHEN w <= e THEN 1 ELSE 0 END) OVER (PARTITION BY r.token ORDER BY w, request_id) AS nth FROM r LEFT JOIN t ON t.token = r.token)"""

FLOW_ORACLES = {
    "serial_queue": _SERIAL,
    "download_bursts": f"""{_BURSTS} SELECT request_id, token, CASE WHEN NOT known THEN 'not_found' WHEN late THEN 'expired' WHEN n + nth > 10 THEN 'limit' ELSE 'granted' END AS reason,
 CAST(n + least(nth, greatest(10 - n, 0)) AS INTEGER) AS download_count FROM x""",
    "download_counts": f"""{_BURSTS} SELECT token, CAST(n + least(coalesce(nth, 0), greatest(10 - n, 0)) AS INTEGER) AS download_count FROM t LEFT JOIN (SELECT token, max(nth) AS nth FROM x GROUP BY 1) USING (token)""",
    "root_walk_all": """WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT a.event_id AS start, b.event_id AS root, CAST(a.k - b.k AS INTEGER) AS depth FROM e a JOIN e b ON b.user_id = a.user_id AND b.k = greatest(1, a.k - 11)""",
    "root_thumbnail_all": """WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN event_id % 11 = 0 THEN 'i' || event_id WHEN event_id % 13 = 0 THEN 't' || event_id END AS t FROM events)
SELECT a.event_id AS start, arg_min(b.t, b.k) FILTER (WHERE b.t IS NOT NULL) AS thumbnail FROM e a JOIN e b ON b.user_id = a.user_id AND b.k BETWEEN a.k - 10 AND a.k GROUP BY 1""",
    "keyed_media": f"""WITH {_MEDIA}, m AS (SELECT * FROM media QUALIFY row_number() OVER (PARTITION BY original_hash ORDER BY media_id) = 1), x AS (SELECT *, media_id % 3 = 0 AS up FROM m WHERE media_id % 2 = 0 OR media_id % 3 = 0)
SELECT original_hash, media_id, CASE WHEN media_id % 14 = 0 THEN upper(title) ELSE title END AS title, CASE WHEN up THEN price_lamports + 1 ELSE price_lamports END AS price_lamports, CASE WHEN up THEN 'new' ELSE owner_wallet END AS owner_wallet,
 CASE WHEN up THEN media_id % 5 <> 0 ELSE is_public END AS is_public, CAST(CASE WHEN media_id % 2 = 1 THEN NULL WHEN media_id % 4 = 0 THEN media_id % 3 ELSE 0 END AS INTEGER) AS downloads, CASE WHEN media_id % 2 = 0 THEN '2024-01-01' ELSE '2024-01-15' END AS created_at,
 CASE WHEN media_id % 4 = 0 AND NOT up THEN '2024-01-18' WHEN media_id % 7 = 0 THEN '2024-01-17' WHEN up AND media_id % 5 = 0 THEN '2024-01-16' WHEN up THEN '2024-01-15' ELSE '2024-01-01' END AS updated_at FROM x""",
    "manifest_bytes": """SELECT p_partkey, repeat('{"in": [', p_partkey % 12 + 1) || '{"hash": "0x' || lower(printf('%02x', p_size)) || '12c", "pad": "0x00' || lower(printf('%02x', p_partkey % 256)) || '", "text": "[1, 2]", "wide": [1, 256], "none": []}'
 || repeat(']}', p_partkey % 12 + 1) AS manifest FROM part""",
    "document_store": """WITH r AS (SELECT sha256(text) AS original_hash, min(doc_id) AS target_asset_id FROM documents WHERE doc_id % 10 = 0 GROUP BY 1)
SELECT original_hash, target_asset_id, CASE WHEN target_asset_id % 3 > 0 THEN 'Proof #' || original_hash[:8] END AS name, CASE WHEN target_asset_id % 3 > 0 THEN false END AS broken FROM r""",
    "tag_index": """WITH p AS (SELECT 'App' AS name, 'veriloom' AS value, doc_id FROM documents UNION ALL SELECT 'Uploader', source, doc_id FROM documents)
SELECT name, value, CAST(row_number() OVER (PARTITION BY name, value ORDER BY doc_id) AS INTEGER) AS place, doc_id AS timestamp, 'tx' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS tx_id FROM p QUALIFY place <= 100""",
    "sql_search": f"{_SIM} SELECT media_id, similarity, original_hash, file_extension, title, price_lamports, owner_wallet FROM s ORDER BY similarity DESC, media_id LIMIT 10",
    "sql_purchases": f"WITH {_BOUGHT} SELECT media_id, buyer, seller, amount, signature FROM bought WHERE buyer = 10",
    "many_matchers": """WITH s AS (SELECT 's' || p_partkey AS spec_id, p_partkey AS place, p_size % 10 = 0 AS is_regex, CASE WHEN p_size % 10 = 0 THEN '^by ' || p_brand || ' .*9 ltd$' ELSE p_brand || ' no ' || p_partkey % 300 END AS matcher FROM part),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 > 0 THEN 'by Brand#' || (o_custkey % 25 + 1) || ' no ' || o_orderkey % 400 || ' ltd' END AS issuer FROM orders),
f AS (SELECT issuer, arg_min(spec_id, place) AS spec_id FROM (SELECT DISTINCT issuer FROM o) JOIN s ON CASE WHEN is_regex THEN regexp_matches(issuer, matcher) ELSE contains(issuer, matcher) END GROUP BY 1) SELECT o_orderkey, spec_id FROM o LEFT JOIN f USING (issuer)""",
    "exif_summary": """SELECT p_partkey, p_size % 4 = 0 OR p_size % 6 = 0 AS gps, CASE WHEN p_size % 3 > 0 THEN trim(p_brand || ' ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END) WHEN p_size % 2 = 0 THEN p_type END AS camera,
 CASE WHEN p_size % 3 = 1 THEN '2024:' || p_size WHEN p_size % 5 > 0 THEN '2023:' || p_size END AS date FROM part""",
    "page_requests": """SELECT p_partkey, (p_size % 7 = 0 OR p_size > 3) AND (p_size % 5 <> 2 OR p_partkey % 150 BETWEEN 1 AND 100) AS valid FROM part""",
    "single_record": f"WITH {_MEDIA} SELECT media_id, original_hash, owner_wallet FROM media WHERE media_id = 0",
    "job_retention_producer": f"""WITH {_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY ts DESC, job_id DESC) AS k FROM last)
SELECT job_id, state, CASE state WHEN 'completed' THEN k <= 100 AND ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 3600 SECONDS WHEN 'failed' THEN ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 86400 SECONDS ELSE true END AS kept FROM r""",
    "leaf_index_spread": """WITH q AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 3 ELSE user_id % 8 END AS tree FROM events)
SELECT event_id, tree, CAST(CASE WHEN tree < 7 THEN tree * 100 ELSE 0 END + row_number() OVER (PARTITION BY tree ORDER BY ts, event_id) - 1 AS BIGINT) AS leaf_index FROM q""",
    "candidates_spread": "SELECT source AS uploader, 'tx' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS tx_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id % 50, doc_id) AS INTEGER) AS place FROM documents",
    "assertion_mix": """WITH c AS (SELECT conv_id AS manifest_id, role AS label, turn, turn % 3 = 0 AS arr, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id, role) AS m FROM conversations),
t AS (SELECT *, CASE WHEN arr AND k = 1 AND m > 1 THEN label || '|' || turn WHEN arr THEN '["' || label || '", ' || turn || ']' ELSE label || '-' || turn END AS said FROM c)
SELECT manifest_id, label, string_agg(said, '|' ORDER BY turn) AS values, CAST(count(*) + count(*) FILTER (WHERE arr AND k = 1 AND m > 1) AS INTEGER) AS n, count(*) > 1 AS multi FROM t GROUP BY 1, 2""",
}
