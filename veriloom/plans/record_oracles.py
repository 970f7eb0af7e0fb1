"""DuckDB SQL of the queries of single records, written apart from the Spark code."""

from .oracles import _BOUGHT, _JOBS, _LISTING, _MEDIA

RECORD_ORACLES = {
    "insert_or_get": f"WITH {_MEDIA} SELECT original_hash, coalesce(min(media_id) FILTER (WHERE media_id % 2 = 0), min(media_id)) AS id FROM media GROUP BY 1",
    "guarded_update": f"WITH {_LISTING} SELECT media_id, CASE WHEN media_id % 6 = 0 THEN upper(title) ELSE title END AS title, price_lamports, owner_wallet FROM listing",
    "count_grants": """WITH t AS (SELECT event_id AS token, CAST(props->>'$.k' AS INTEGER) % 12 AS n FROM events WHERE event_type = 'purchase'),
g AS (SELECT event_id % 997 AS token, count(*) AS more FROM events WHERE event_type = 'view' GROUP BY 1) SELECT token, CAST(n + coalesce(more, 0) AS INTEGER) AS download_count FROM t LEFT JOIN g USING (token)""",
    "new_purchases": """SELECT o_orderkey AS media_id, CAST(o_custkey AS VARCHAR) AS buyer, sha256('seed|' || o_orderkey || '|' || o_custkey) AS download_token,
 '2024-01-16 00:00:00' AS download_expires_at, 0 AS download_count, '2024-01-15 00:00:00' AS created_at FROM orders""",
    "purchase_status": f"""WITH {_BOUGHT}, l AS (SELECT media_id, buyer, arg_max(signature, (created_at, l_orderkey, l_linenumber)) AS token FROM bought GROUP BY 1, 2),
r AS (SELECT DISTINCT o_orderkey AS media_id, o_custkey AS buyer FROM orders) SELECT media_id, buyer, token, token IS NOT NULL AS purchased FROM r LEFT JOIN l USING (media_id, buyer)""",
    "manifest_visible": f"""WITH {_MEDIA}, r AS (SELECT o_orderkey AS media_id, 'src' || o_custkey % 20 AS viewer FROM orders)
SELECT media_id, viewer, coalesce(is_public, true) OR coalesce(owner_wallet = viewer, false) AS visible FROM r LEFT JOIN media USING (media_id)""",
    "candidates_any_uploader": "SELECT sha256(text) AS original_hash, 'tx' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS tx_id, doc_id AS target_asset_id FROM documents WHERE doc_id % 4 <> 0",
    "tagged_records": "SELECT 'tx' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS tx_id, doc_id AS timestamp FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 100",
    "root_thumbnail": """WITH RECURSIVE e AS (SELECT event_id AS node, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events),
s AS (SELECT arg_max(event_id, (ts, event_id)) AS start FROM events GROUP BY user_id),
w AS (SELECT start, start AS node, 0 AS depth FROM s UNION ALL SELECT start, parent, depth + 1 FROM w JOIN e USING (node) WHERE parent IS NOT NULL AND depth < 10),
t AS (SELECT start, depth, CASE WHEN node % 3 = 0 THEN 'i' || node WHEN node % 5 < 2 THEN 't' || node END AS thumbnail FROM w)
SELECT start, arg_max(thumbnail, depth) FILTER (WHERE thumbnail IS NOT NULL) AS thumbnail FROM t GROUP BY 1""",
    "proof_documents": "SELECT sha256(text) AS original_hash, 'Proof #' || sha256(text)[:8] AS name, doc_id AS asset, source AS signer, 'source_type' AS fourth, CAST(NULL AS VARCHAR) AS image FROM documents",
    "enqueue": f"""WITH {_JOBS} SELECT job_id, state, progress, CAST(NULL AS INTEGER) AS attempts, CAST(NULL AS INTEGER) AS backoff_ms FROM last
UNION ALL SELECT doc_id, 'waiting', 0, 3, 2000 FROM documents WHERE n_chars % 7 <> 0 AND doc_id NOT IN (SELECT job_id FROM last)""",
    "listing_thumbnails": "SELECT p_partkey AS media_id, p_name AS title, CASE WHEN p_size % 3 = 0 THEN 'media/' || p_partkey || '/thumbnail.jpg' END AS thumbnail FROM part",
    "search_routes": "SELECT event_id, CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'text' ELSE 'unsupported' END AS route FROM events",
    "generator_names": """WITH g AS (SELECT p_partkey, p_name, CASE WHEN p_size % 4 = 0 THEN p_name || ' 8.1' WHEN p_size % 3 > 0 THEN p_brand || CASE WHEN p_size % 5 > 0 THEN ' v' || p_size ELSE '' END ELSE 'Unknown' END AS generator FROM part)
SELECT p_partkey, generator, trim(split_part(generator, ' 8', 1)) AS clean FROM g""",
    "ai_actions": """SELECT event_id, event_type = 'view' OR event_id % 5 = 0 AS ai, event_type = 'click' OR event_id % 5 = 0 AS listed, event_type = 'click' AS composite FROM events""",
    "display_rules": """WITH p AS (SELECT *, p_size * 100 AS w, p_partkey % 3000 + 1 AS h, least(1.0, CAST(512 AS DOUBLE) / greatest(p_size * 100, p_partkey % 3000 + 1)) AS scale, CASE WHEN p_size % 4 > 0 THEN p_partkey * 1500 // 1000 ELSE 0 END AS s FROM part)
SELECT p_partkey, CAST(floor(w * scale + 0.5) AS INTEGER) AS width, CAST(floor(h * scale + 0.5) AS INTEGER) AS height, CASE WHEN p_size % 2 = 0 THEN p_name ELSE split_part(p_brand || '.tar.gz', '.', 1) END AS title,
 CASE WHEN p_size % 3 = 0 THEN 'https://devnet.x' ELSE 'https://gateway.example' END AS gateway, p_partkey || 'https://gw/' AS tx, s AS seconds,
 CASE WHEN p_size % 5 = 0 THEN 'given' ELSE strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') END AS created_at,
 '[binary: ' || p_size || ' bytes] (' || array_to_string(range(1, least(p_size, 8) + 1), ', ') || '...)' AS preview, '[' || array_to_string(range(1, least(p_size, 3) + 1), ',') || ']' AS vector,
 false AS json, CAST(floor(p_partkey % 100 / 7.0 + 0.5) AS BIGINT) AS progress FROM p""",
    "page_buttons": """WITH p AS (SELECT p_partkey, p_size AS pages, p_partkey % p_size + 1 AS page FROM part), w AS (SELECT *, greatest(1, least(page - 3, pages - 6)) AS a FROM p)
SELECT p_partkey, array_to_string(range(a, least(pages, a + 6) + 1), ',') AS buttons FROM w""",
    "validation_status": """SELECT p_partkey, p_partkey % 7 = 0 OR (p_size % 2 <> 0 AND p_size % 5 <> 0) AS valid,
 CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat_ws('|', CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'failure.sig' ELSE 'bad sig' END END, CASE WHEN p_size % 5 = 0 THEN 'failure.hash' END) END AS errors, 2 AS bindings FROM part""",
    "ingredient_list": "SELECT p_partkey, p_name AS title_0, CAST(NULL AS VARCHAR) AS title_1, 'image/jpeg' AS format_0, CASE WHEN p_size % 2 = 0 THEN p_type END AS format_1, 2 AS n FROM part",
    "first_action_type": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS source_type FROM part",
    "assertion_labels": """WITH c AS (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 'User turn' WHEN 'assistant' THEN 'Assistant turn' END AS said FROM conversations)
SELECT conv_id, turn, CASE WHEN said IS NULL THEN 'c2pa.chat_' || role || CASE WHEN turn > 0 THEN '__' || turn ELSE '' END WHEN turn > 0 THEN said || ' #' || (turn + 1) ELSE said END AS label FROM c""",
    "job_outcomes": f"""WITH {_JOBS} SELECT job_id, CASE job_id % 4 WHEN 0 THEN 2000 WHEN 1 THEN 4000 END AS delay_ms,
 CASE WHEN state = 'completed' AND job_id % 3 = 0 THEN 'success' WHEN state IN ('completed', 'failed') THEN 'failure' WHEN job_id % 200 >= 120 THEN 'timeout' ELSE 'pending' END AS outcome FROM last""",
}
