"""DuckDB SQL of the reference queries, written apart from the Spark code."""

_MEDIA = """media AS (SELECT d.doc_id AS media_id, sha256(text) AS original_hash, CASE lang WHEN 'en' THEN 'jpg' WHEN 'fr' THEN 'png' WHEN 'de' THEN 'mp4' WHEN 'es' THEN 'webp' END AS file_extension,
 CASE WHEN n_chars % 10 = 0 THEN 0 ELSE n_chars * 1000000 END AS price_lamports, CASE WHEN n_chars % 7 <> 0 THEN 'doc ' || d.doc_id END AS title, source AS owner_wallet, quality = 1 AND toxic = 0 AS is_public
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_SIM = f"""WITH {_MEDIA}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS query FROM embeddings WHERE vec_id = 0),
s AS (SELECT m.*, list_cosine_similarity(CAST(embedding AS DOUBLE[]), query) AS similarity FROM embeddings JOIN media m ON m.media_id = vec_id, q WHERE is_public)"""
_LISTING = "listing AS (SELECT p_partkey AS media_id, p_name AS title, CAST(round(p_retailprice * 100) AS BIGINT) * 10000000 AS price_lamports, CAST(p_partkey % 10 AS VARCHAR) AS owner_wallet FROM part)"
_OWNER = "owners AS (SELECT l_partkey AS media_id, CAST(min(l_suppkey) AS VARCHAR) AS chain_owner FROM lineitem GROUP BY 1)"
_BOUGHT = """bought AS (SELECT l_partkey AS media_id, o_custkey AS buyer, l_suppkey AS seller, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, o_orderdate AS created_at,
 l_orderkey || '-' || l_linenumber AS signature, l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
_TX = """tx AS (SELECT 'tx' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS tx_id, sha256(text) AS original_hash, source AS uploader, doc_id AS target_asset_id FROM documents),
cand AS (SELECT * FROM tx WHERE uploader <> 'src0'),
assets AS (SELECT vec_id AS asset_id, 'https://gw/tx' || lpad(CAST(CASE WHEN label = 0 THEN vec_id + 1 ELSE vec_id END AS VARCHAR), 8, '0') AS json_uri, label = 9 AS burnt, CAST(label AS VARCHAR) AS owner FROM embeddings),
dup AS (SELECT original_hash, count(*) AS copies, min(target_asset_id) AS oldest FROM tx GROUP BY 1)"""


def _resolved(condition: str) -> str:
    return f"""WITH {_TX}, best AS (SELECT *, contains(json_uri, tx_id) AS linked, row_number() OVER (PARTITION BY original_hash ORDER BY target_asset_id) AS k FROM cand JOIN assets ON asset_id = target_asset_id {condition}),
res AS (SELECT best.original_hash, tx_id, asset_id, CASE WHEN burnt THEN '' ELSE owner END AS owner, owner AS last_owner, burnt, linked AS cross_link, copies, copies = 1 AS no_duplicates, oldest = asset_id AS is_oldest, linked AND copies = 1 AS is_valid
 FROM best JOIN dup ON dup.original_hash = best.original_hash WHERE k = 1)"""


_JOBS = """jobs AS (SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'waiting' WHEN 'view' THEN 'active' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'delayed' END AS state,
 CAST(props->>'$.k' AS INTEGER) AS progress FROM events), last AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1)"""
_NOW = "TIMESTAMP '2024-01-15 00:00:00'"
_BASE = "http://cv.iptc.org/newscodes/digitalsourcetype/"

ORACLES = {
    "vector_topk": f"{_SIM} SELECT media_id, similarity, original_hash, file_extension, title, price_lamports, owner_wallet FROM s ORDER BY similarity DESC, media_id LIMIT 20",
    "vector_percent": f"{_SIM} SELECT media_id, CAST(floor(similarity * 100 + 0.5) AS BIGINT) AS percent FROM s",
    "vector_insert_if_absent": f"WITH {_MEDIA} SELECT media_id, original_hash, 'text' AS model_name FROM media WHERE media_id NOT IN (SELECT vec_id FROM embeddings)",
    "owner_page": f"WITH {_LISTING}, {_OWNER} SELECT listing.* FROM listing JOIN owners USING (media_id) WHERE chain_owner = '1' ORDER BY price_lamports DESC, media_id LIMIT 20",
    "buyer_page": f"""WITH {_LISTING}, {_BOUGHT} SELECT media_id, title, amount, seller, signature, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM bought JOIN listing USING (media_id) WHERE buyer = 10
 ORDER BY bought.created_at DESC, media_id, l_orderkey, l_linenumber, seller, amount LIMIT 20""",
    "page_envelope": """WITH p AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40)
SELECT n AS total, 3 AS page, 20 AS "limit", (n + 19) // 20 AS total_pages, (SELECT string_agg(o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey) FROM p) AS items FROM (SELECT count(*) AS n FROM orders)""",
    "latest_purchase": f"""WITH {_BOUGHT} SELECT media_id, buyer, signature, amount, seller FROM bought
QUALIFY row_number() OVER (PARTITION BY media_id, buyer ORDER BY created_at DESC, l_orderkey DESC, l_linenumber DESC, seller DESC, amount DESC) = 1""",
    "oldest_per_hash": f"WITH {_TX} SELECT original_hash, copies, oldest AS oldest_id, copies > 1 AS is_duplicated FROM dup",
    "candidates_verified": f"WITH {_TX} SELECT original_hash, tx_id, target_asset_id, uploader, CAST(row_number() OVER (PARTITION BY original_hash ORDER BY target_asset_id) AS INTEGER) AS place FROM cand",
    "duplicate_check": f"WITH {_TX} SELECT original_hash, bool_or(asset_id IS NOT NULL) AS rejected FROM cand LEFT JOIN assets ON asset_id = target_asset_id GROUP BY 1",
    "proof_resolution": _resolved("") + " SELECT * FROM res",
    "proof_resolution_documented": _resolved("WHERE contains(json_uri, tx_id)") + " SELECT * FROM res",
    "verification_steps": _resolved("")
    + """ SELECT original_hash, 'success' AS step_db, 'success' AS step_cnft, 'success' AS step_arweave, if(cross_link, 'success', 'error') AS step_crosslink,
 if(no_duplicates OR is_oldest, 'success', 'error') AS step_duplicate FROM res""",
    "access_rule": f"""WITH {_MEDIA}, {_BOUGHT}, r AS (SELECT o_orderkey AS media_id, 'src' || o_custkey % 20 AS viewer FROM orders), b AS (SELECT DISTINCT media_id, 'src' || buyer % 20 AS viewer FROM bought),
x AS (SELECT r.media_id, r.viewer, CASE WHEN is_public THEN 'public' WHEN owner_wallet = r.viewer THEN 'owner' WHEN b.viewer IS NOT NULL THEN 'purchased' ELSE 'denied' END AS reason
 FROM r JOIN media ON media.media_id = r.media_id LEFT JOIN b ON b.media_id = r.media_id AND b.viewer = r.viewer) SELECT *, reason <> 'denied' AS allowed FROM x""",
    "root_walk": """WITH RECURSIVE e AS (SELECT event_id AS node, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events),
s AS (SELECT arg_max(event_id, (ts, event_id)) AS start FROM events GROUP BY user_id),
w AS (SELECT start, start AS root, 0 AS depth FROM s UNION ALL SELECT start, parent, depth + 1 FROM w JOIN e ON e.node = w.root WHERE parent IS NOT NULL AND depth < 11)
SELECT start, arg_max(root, depth) AS root, max(depth) AS depth FROM w GROUP BY start""",
    "action_timeline": """SELECT conv_id AS manifest_id, CAST(turn + 1 AS BIGINT) AS seq, 'action' AS kind, upper(replace('chat_' || role, '_', ' ')) AS display FROM conversations
UNION ALL SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 'root', '' FROM conversations UNION ALL SELECT conv_id, CAST(max(turn) + 2 AS BIGINT), 'current', '' FROM conversations GROUP BY 1""",
    "first_attribute": "SELECT doc_id, sha256(text) AS original_hash, source AS root_signer, lang AS source_type, CAST(NULL AS VARCHAR) AS absent FROM documents",
    "assertion_group": "SELECT conv_id AS manifest_id, role AS label, string_agg(text, '|' ORDER BY turn, text) AS values, CAST(count(*) AS INTEGER) AS n, count(*) > 1 AS multi FROM conversations GROUP BY 1, 2",
    "source_type_label": f"""SELECT event_id, CASE event_type WHEN 'view' THEN 'digitalCapture' WHEN 'purchase' THEN 'trainedAlgorithmicMedia' WHEN 'click' THEN '{_BASE}compositeWithTrainedAlgorithmicMedia' WHEN 'signup' THEN '{_BASE}' END AS source_type,
 CASE event_type WHEN 'view' THEN 'Digital Capture' WHEN 'purchase' THEN 'AI Generated' WHEN 'click' THEN 'compositeWithTrainedAlgorithmicMedia' WHEN 'signup' THEN '{_BASE}' ELSE 'Unknown' END AS label, event_type = 'view' AS is_hardware FROM events""",
    "hash_spec_match": """SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'google-pixel' WHEN source = 'src3' THEN 'any' END AS spec_id,
 CASE WHEN source NOT IN ('src1', 'src2') THEN NULL WHEN n_chars % 3 = 0 THEN array_to_string(list_transform(range(4), lambda k: lower(printf('%02x', (doc_id + k * 7) % 256))), '') ELSE 'iid_u' || doc_id END AS content_hash FROM documents""",
    "byte_hex": "SELECT doc_id, lower(hex(encode(text))) AS hex FROM documents",
    "price_display": """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE CAST(floor(p_retailprice * 1000000000) AS BIGINT) END AS lamports FROM part)
SELECT p_partkey, lamports, CASE WHEN lamports = 0 THEN 'free' ELSE printf('%.2f', lamports / 1e9) || ' SOL' END AS display FROM p""",
    "address_truncate": "WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT doc_id, h[:4] || '...' || h[-4:] AS short, h[:8] || '...' || h[-6:] AS medium, h[:6] || '...' || h[-6:] AS even FROM h",
    "mime_extension": """WITH x AS (SELECT doc_id, sha256(text) AS h, CASE lang WHEN 'en' THEN 'jpg' WHEN 'fr' THEN 'heic' WHEN 'de' THEN 'mov' ELSE 'bin' END AS store, CASE lang WHEN 'en' THEN 'jpg' WHEN 'de' THEN 'mov' WHEN 'es' THEN 'json' ELSE 'bin' END AS upload,
 CASE lang WHEN 'en' THEN 'jpg' WHEN 'de' THEN 'mov' ELSE 'bin' END AS page FROM documents)
SELECT doc_id, store, upload, page, 'media/' || h || '/original.' || store AS original_key, 'media/' || h || '/manifest.json' AS manifest_key, store AS from_path FROM x""",
    "upload_gate": """WITH f AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY 1)
SELECT d.doc_id, CASE WHEN n_chars % 11 = 0 THEN 'no_store' WHEN toxic <> 0 THEN 'invalid_signature' WHEN n_chars % 13 = 0 THEN 'no_manifest' WHEN quality = 0 THEN 'ai_generated' WHEN source = 'src0' THEN 'untrusted_issuer'
 WHEN n_chars % 17 = 0 THEN 'no_hash' WHEN d.doc_id <> first_id THEN 'duplicate' ELSE 'ok' END AS reason FROM documents d JOIN f ON f.text = d.text LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "purchase_validation": """WITH o AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS buyer, CAST(o_orderkey % 10 AS VARCHAR) AS seller, CAST(round(o_totalprice * 100) AS BIGINT) AS total, o_orderstatus = 'F' AS err FROM orders),
r AS (SELECT *, CASE WHEN k % 19 = 0 THEN 0 WHEN k % 23 <> 0 THEN total END AS price, k % 19 = 0 AND k % 2 = 0 OR k % 29 = 0 AS free_sig, k % 31 = 0 AS blank FROM o)
SELECT k AS request_id, CASE WHEN blank AND NOT free_sig THEN 'missing_fields' WHEN k % 37 = 0 AND k <> 0 THEN 'media_not_found' WHEN price = 0 AND NOT free_sig THEN 'free_needs_free_signature' WHEN coalesce(price <> 0, true) AND free_sig THEN 'paid_with_free_signature'
 WHEN price > 0 AND k % 41 = 0 THEN 'tx_not_found' WHEN price > 0 AND err THEN 'tx_failed' WHEN price > 0 AND k % 43 = 0 AND buyer <> seller THEN 'wrong_signer'
 WHEN price > 0 AND k % 47 = 0 AND k % 43 <> 0 AND buyer <> seller THEN 'account_missing'
 WHEN price > 0 AND buyer = seller AND abs(CASE WHEN k % 43 = 0 THEN 0 WHEN k % 47 = 0 THEN -total - 5000 WHEN k % 7 = 0 THEN total - 1 ELSE total END) > 10000000 THEN 'fee_too_high'
 WHEN price > 0 AND buyer <> seller AND (CASE WHEN k % 7 = 0 THEN total - 1 ELSE total END) < price THEN 'short_payment'
 WHEN k % 53 = 0 AND NOT free_sig THEN 'already_recorded' ELSE 'ok' END AS reason FROM r""",
    "download_grant": f"""WITH t AS (SELECT event_id AS token, ts + INTERVAL 24 HOURS AS e, CAST(props->>'$.k' AS INTEGER) % 12 AS n FROM events WHERE event_type = 'purchase')
SELECT token, CASE WHEN {_NOW} > e THEN 'expired' WHEN n >= 10 THEN 'limit' ELSE 'granted' END AS reason, CAST(n + CASE WHEN {_NOW} <= e AND n < 10 THEN 1 ELSE 0 END AS INTEGER) AS download_count FROM t""",
    "upsert_media": f"""WITH {_MEDIA}, m AS (SELECT * FROM media QUALIFY row_number() OVER (PARTITION BY original_hash ORDER BY media_id) = 1)
SELECT original_hash, media_id, title, CASE WHEN media_id % 3 = 0 THEN price_lamports + 1 ELSE price_lamports END AS price_lamports, CASE WHEN media_id % 3 = 0 THEN 'new' ELSE owner_wallet END AS owner_wallet,
 CASE WHEN media_id % 3 = 0 THEN true ELSE is_public END AS is_public, CASE WHEN media_id % 2 = 0 THEN '2024-01-01 00:00:00' ELSE '2024-01-15 00:00:00' END AS created_at,
 CASE WHEN media_id % 3 = 0 THEN '2024-01-15 00:00:00' ELSE '2024-01-01 00:00:00' END AS updated_at FROM m WHERE media_id % 2 = 0 OR media_id % 3 = 0""",
    "owner_sync": f"WITH {_LISTING}, {_OWNER} SELECT media_id, coalesce(chain_owner, owner_wallet) AS owner_wallet, coalesce(chain_owner <> owner_wallet, false) AS stale FROM listing LEFT JOIN owners USING (media_id)",
    "partial_update": f"""WITH {_LISTING} SELECT media_id, CASE WHEN media_id % 4 <> 0 AND media_id % 2 = 0 THEN CASE WHEN media_id % 3 = 0 THEN upper(title) END ELSE title END AS title,
 CASE WHEN media_id % 4 <> 0 AND media_id % 5 = 0 THEN media_id * 1000 ELSE price_lamports END AS price_lamports, owner_wallet FROM listing""",
    "job_state_counts": f"WITH {_JOBS} SELECT state, count(job_id) AS n FROM (SELECT unnest(['waiting', 'active', 'completed', 'failed', 'delayed']) AS state) LEFT JOIN last USING (state) GROUP BY 1",
    "job_retention": f"""WITH {_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY ts DESC, job_id DESC) AS k FROM last)
SELECT job_id, state, CASE state WHEN 'completed' THEN k <= 1000 AND ts >= {_NOW} - INTERVAL 86400 SECONDS WHEN 'failed' THEN ts >= {_NOW} - INTERVAL 604800 SECONDS ELSE true END AS kept FROM r""",
    "leaf_index": "SELECT event_id, user_id % 8 AS tree, CAST(CASE WHEN user_id % 8 < 7 THEN user_id % 8 * 100 ELSE 0 END + row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS BIGINT) AS leaf_index FROM events",
    "mint_replay": """WITH d AS MATERIALIZED (SELECT doc_id, sha256(text) AS h FROM documents), n AS MATERIALIZED (SELECT count(*) AS n FROM documents),
a AS MATERIALIZED (SELECT event_id, ts, user_id % 8 AS tree, event_id * 7 % n AS doc_id FROM events, n), t AS MATERIALIZED (SELECT DISTINCT h, true AS taken FROM d WHERE doc_id % 5 = 0),
x AS MATERIALIZED (SELECT event_id, ts, tree, d.h, coalesce(taken, false) AS taken, row_number() OVER (PARTITION BY d.h ORDER BY ts, event_id) AS k FROM a JOIN d ON d.doc_id = a.doc_id LEFT JOIN t ON t.h = d.h),
m AS (SELECT event_id, CAST(CASE WHEN tree < 7 THEN tree * 100 ELSE 0 END + row_number() OVER (PARTITION BY tree ORDER BY ts, event_id) - 1 AS BIGINT) AS leaf_index FROM x WHERE NOT taken AND k = 1)
SELECT event_id, CASE WHEN taken THEN 'exists' WHEN k > 1 THEN 'earlier_job' ELSE 'minted' END AS reason, leaf_index IS NOT NULL AS success, CASE WHEN leaf_index IS NULL THEN 5 ELSE 100 END AS progress, leaf_index FROM x LEFT JOIN m USING (event_id)""",
    "json_progress": f"WITH {_JOBS} SELECT job_id, state, progress FROM last",
    "flatten_metadata": """WITH m AS (SELECT conv_id AS manifest_id, arg_min(text, turn) AS title, arg_max(role, turn) AS format, CAST(count(*) AS VARCHAR) AS vendor FROM conversations GROUP BY 1),
f AS (SELECT manifest_id, CAST(0 AS BIGINT) AS place, 'title' AS label, title AS value FROM m UNION ALL SELECT manifest_id, 1, 'format', format FROM m UNION ALL SELECT manifest_id, 2, 'vendor', vendor FROM m UNION ALL SELECT manifest_id, 2000, 'c2pa.hash.data - alg', 'sha256' FROM m)
SELECT * FROM f WHERE value <> ''""",
}
