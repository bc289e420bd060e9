"""The model views as plain SQL, for checking the Spark jobs on another engine."""

from __future__ import annotations

import re

_SUPPLIER_REGION = """CASE s_suppkey % 4 WHEN 0 THEN n_nationkey + 100 WHEN 1 THEN n_regionkey + 1
    WHEN 2 THEN 0 ELSE NULL END"""

VIEWS = {
    "m_region": """
SELECT 0 AS id, CAST(NULL AS INTEGER) AS parent_id, 'GLOBAL' AS type, 'GLOBAL' AS code, 'Global' AS name
UNION ALL SELECT r_regionkey + 1, NULL, 'ECONOMIC_ZONE', 'Z' || r_regionkey, r_name FROM region
UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, 'COUNTRY', 'N' || n_nationkey, n_name FROM nation""",
    "m_manufacturer": "SELECT DISTINCT p_brand AS slug, p_brand AS name FROM part",
    "m_provider": """
SELECT s_suppkey AS id, s_name AS name, s_nationkey + 100 AS country_id,
    'Brand#' || (s_suppkey % 40 + 1) AS manufacturer_slug,
    s_suppkey % 10 <> 0 AS is_active, s_acctbal > 0 AS accepts_leads FROM supplier""",
    "m_use_case": "SELECT DISTINCT c_mktsegment AS slug FROM customer",
    "m_product": """
SELECT p_partkey AS id, 'p-' || p_partkey AS slug, p_name AS name, substr(p_type, 1, 2) || '-' || p_size AS model_code, p_brand AS manufacturer_slug,
    CASE WHEN p_partkey % 11 = 0 THEN 'UNKNOWN' WHEN p_partkey % 13 = 0 THEN 'DISCONTINUED'
         WHEN p_type = 'ECONOMY' THEN 'COMMERCIAL' WHEN p_type = 'STANDARD' THEN 'LIMITED_COMMERCIAL'
         WHEN p_type = 'PROMO' THEN 'EARLY_ACCESS' WHEN p_type = 'LARGE' THEN 'PILOT'
         WHEN p_type = 'MEDIUM' THEN 'PROTOTYPE' ELSE 'RAAS_DEPLOYMENT' END AS commercial_status,
    CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DECIMAL(6,1)) END AS payload_kg,
    CASE WHEN p_partkey % 5 <> 0 THEN CAST(100 + 2 * p_size AS DECIMAL(6,1)) END AS height_cm,
    CASE WHEN p_partkey % 4 <> 1 THEN CAST(30 + p_size AS DECIMAL(6,1)) END AS weight_kg,
    CASE WHEN p_partkey % 5 <> 2 THEN CAST((p_partkey % 30) * CAST(0.1 AS DOUBLE) AS DECIMAL(5,2)) END AS walk_speed_ms,
    CASE WHEN p_partkey % 6 <> 0 THEN CAST(30 + 30 * (p_partkey % 10) AS INTEGER) END AS runtime_minutes,
    CASE WHEN p_partkey % 3 <> 2 THEN CAST(10 + p_partkey % 25 AS INTEGER) END AS degrees_of_freedom,
    (['BIPEDAL','WHEELED','HYBRID','QUADRUPED','STATIONARY','OTHER',NULL])[p_partkey % 7 + 1] AS mobility,
    (['TELEOPERATED','ASSISTED','SUPERVISED_AUTONOMY','TASK_AUTONOMOUS','HIGHLY_AUTONOMOUS',NULL])[p_partkey % 6 + 1] AS autonomy,
    CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_sdk,
    CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS has_manipulation,
    CASE p_partkey % 8 WHEN 0 THEN true WHEN 1 THEN false END AS ros_support,
    CASE p_partkey % 9 WHEN 0 THEN true WHEN 1 THEN false END AS developer_edition,
    (['gripper','five-finger',NULL])[p_partkey % 3 + 1] AS hand_type,
    CASE WHEN p_partkey % 3 <> 2 THEN CAST(p_partkey % 12 AS INTEGER) END AS hand_dof,
    CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS has_vision,
    CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false END AS has_language_ui,
    p_partkey % 10 <> 0 AS is_published,
    CASE WHEN p_partkey % 6 <> 0 THEN lower(p_type) || ' unit for the ' || lower(p_brand) END AS summary,
    CASE WHEN p_partkey % 4 <> 0 THEN CAST(2015 + p_partkey % 10 AS INTEGER) END AS announced_year,
    DATE '2020-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS created_on
FROM part""",
    "m_variant": """
SELECT DISTINCT 'v-' || l_partkey || '-' || l_linestatus AS id, l_partkey AS product_id, 'edition-' || lower(l_linestatus) AS slug,
    'Edition ' || l_linestatus AS name, l_linestatus = 'O' AS is_developer FROM lineitem""",
    "m_spec_definition": """
SELECT * FROM (VALUES ('list_price', 'List price', 'OTHER', 'USD', 3), ('outdoor_rated', 'Outdoor use', 'MOBILITY', NULL, 1),
    ('ingress_rating', 'Ingress rating', 'SAFETY', NULL, 2), ('noise', 'Noise', 'SAFETY', 'dB', 2),
    ('largest_load', 'Largest load', 'MANIPULATION', 'kg', 1)) t(key, label, category, unit, sort_order)""",
    "m_specification": """
SELECT concat_ws('-', CAST(product_id AS VARCHAR), key, variant_id) AS id, * FROM (
  SELECT p_partkey AS product_id, CAST(NULL AS VARCHAR) AS variant_id, 'list_price' AS key,
    CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_retailprice AS DECIMAL(18,4)) END AS value_number, CAST(NULL AS BOOLEAN) AS value_bool,
    CAST(NULL AS VARCHAR) AS value_text, CASE WHEN p_partkey % 6 = 1 THEN 'EUR' END AS unit FROM part
  UNION ALL SELECT p_partkey, NULL, 'outdoor_rated', NULL, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 2 = 0 END, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, NULL, 'ingress_rating', NULL, NULL, 'IP' || (60 + p_size % 10), NULL FROM part
  UNION ALL SELECT p_partkey, NULL, 'noise', CASE WHEN p_partkey % 3 = 1 THEN CAST(p_size + 0.5 AS DECIMAL(18,4)) END, NULL, CASE WHEN p_partkey % 3 <> 0 THEN 'quiet' END, NULL FROM part
  UNION ALL SELECT l_partkey, 'v-' || l_partkey || '-' || l_linestatus, 'largest_load', CAST(max(l_quantity) AS DECIMAL(18,4)), NULL, NULL, NULL
    FROM lineitem GROUP BY l_partkey, l_linestatus) s""",
    "m_capability": """
SELECT l_partkey AS product_id, CASE l_returnflag WHEN 'A' THEN 'navigation' WHEN 'N' THEN 'grasping' WHEN 'R' THEN 'speech' END AS capability,
    max(l_discount) > 0.05 AS supported, CASE WHEN max(l_quantity) < 40 THEN 'up to ' || CAST(max(l_quantity) AS INTEGER) END AS detail
FROM lineitem GROUP BY l_partkey, l_returnflag""",
    "m_compare_set": """
SELECT id // 4 AS set_id, slug, CAST(id % 4 + 1 AS INTEGER) AS position FROM m_product WHERE is_published""",
    "m_availability": f"""
SELECT l_partkey || '-' || l_suppkey || '-' || l_linenumber AS id, l_partkey AS product_id,
    CASE WHEN NOT starts_with(flags, 'R') THEN 'v-' || l_partkey || '-' || edition END AS variant_id, l_suppkey AS provider_id, {_SUPPLIER_REGION} AS region_id,
    CASE l_linenumber WHEN 1 THEN 'PURCHASE' WHEN 2 THEN 'RENTAL' WHEN 3 THEN 'RAAS' END AS transaction_type,
    CASE flags WHEN 'AF' THEN 'AVAILABLE' WHEN 'AO' THEN 'LIMITED' WHEN 'NF' THEN 'NOT_AVAILABLE'
        WHEN 'NO' THEN 'PREORDER' WHEN 'RF' THEN 'DISCONTINUED' WHEN 'RO' THEN 'ON_REQUEST' END AS availability_status,
    CASE WHEN l_partkey % 4 <> 0 THEN first_ship END AS available_from, tax < 0.07 AS is_current
FROM (SELECT l_partkey, l_suppkey, l_linenumber, min(l_returnflag) || min(l_linestatus) AS flags,
        min(l_linestatus) AS edition, CAST(min(l_shipdate) AS DATE) AS first_ship, min(l_tax) AS tax
      FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL) o
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "m_pricing": f"""
SELECT l_partkey || '-' || l_suppkey || '-' || l_linenumber AS id, l_partkey AS product_id,
    CASE WHEN flag <> 'N' THEN 'v-' || l_partkey || '-' || edition END AS variant_id,
    CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey END AS provider_id, {_SUPPLIER_REGION} AS region_id,
    CASE l_linenumber WHEN 5 THEN 'RENTAL' WHEN 6 THEN 'RAAS' ELSE 'PURCHASE' END AS transaction_type,
    (['PUBLIC','FROM','ESTIMATED','RANGE','QUOTE_ONLY'])[(l_partkey + l_suppkey) % 5 + 1] AS price_type,
    CASE WHEN l_suppkey % 3 = 1 THEN 'EUR' ELSE 'USD' END AS currency,
    CASE WHEN (l_partkey + l_suppkey) % 5 < 3 THEN low END AS price,
    CASE WHEN (l_partkey + l_suppkey) % 5 = 3 THEN low END AS price_min,
    CASE WHEN (l_partkey + l_suppkey) % 5 = 3 THEN CAST(low + 5000 AS DECIMAL(14,2)) END AS price_max,
    CASE WHEN l_linenumber IN (5, 6) THEN 'MONTHLY' ELSE 'ONE_TIME' END AS billing_period,
    tax < 0.07 AS is_current, last_ship AS updated_at
FROM (SELECT l_partkey, l_suppkey, l_linenumber, CAST(min(l_extendedprice) AS DECIMAL(14,2)) AS low,
        min(l_returnflag) AS flag, min(l_linestatus) AS edition, CAST(max(l_shipdate) AS DATE) AS last_ship, min(l_tax) AS tax
      FROM lineitem WHERE l_linenumber >= 4 GROUP BY ALL) o
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "m_deployment": """
SELECT l_partkey || '-' || l_suppkey AS id, l_partkey AS product_id, l_suppkey AS provider_id,
    CAST(max(l_extendedprice) AS DECIMAL(16,2)) AS contract_value
FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "m_fit": """
SELECT l_partkey AS product_id, c_mktsegment AS use_case,
    CASE WHEN l_partkey % 8 <> 0 THEN CAST(max(l_discount) * 10 AS DECIMAL(4,3)) END AS fit_score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY l_partkey, c_mktsegment""",
    "m_evidence": """
SELECT subject_type || '-' || subject_id || '-' || k AS id, subject_type, subject_id,
    CASE WHEN n % 3 <> k THEN last_seen + 10 END AS verified_at,
    CASE WHEN k = 1 THEN first_seen ELSE last_seen END AS observed_at,
    (['LOW','MEDIUM','HIGH','VERIFIED'])[n % 4 + 1] AS confidence,
    CASE WHEN k = 1 THEN 'MANUFACTURER_SITE' ELSE 'NEWS_ARTICLE' END AS source_type,
    'https://source.example/' || n AS source_url
FROM (SELECT subject_type, subject_id, n, max(seen) AS last_seen, min(seen) AS first_seen FROM (
        SELECT 'COMMERCIAL_STATUS' AS subject_type, CAST(l_partkey AS VARCHAR) AS subject_id, l_partkey AS n, CAST(l_shipdate AS DATE) AS seen
        FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 7
        UNION ALL SELECT CASE WHEN l_linenumber >= 4 THEN 'PRICING_OFFER' ELSE 'AVAILABILITY_OFFER' END,
          l_partkey || '-' || l_suppkey || '-' || l_linenumber, l_partkey + l_suppkey, CAST(l_shipdate AS DATE)
        FROM lineitem WHERE l_linestatus = 'F'
        UNION ALL SELECT 'DEPLOYMENT', l_partkey || '-' || l_suppkey, l_partkey + l_suppkey, CAST(l_shipdate AS DATE)
        FROM lineitem WHERE l_linestatus = 'F') s GROUP BY ALL) f,
     (VALUES (1), (2)) t(k)""",
    "m_image": """
SELECT page_id AS id, page_id // 4 AS product_id, url AS image_url,
    CASE WHEN page_id % 5 = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS identity_status,
    (['PERMITTED','ATTRIBUTION_REQUIRED','UNKNOWN','RESTRICTED'])[page_id % 4 + 1] AS rights_status,
    CASE WHEN page_id % 3 = 0 THEN 'OFFICIAL_MANUFACTURER_MEDIA' ELSE 'NONE' END AS usage_basis,
    CASE page_id % 6 WHEN 1 THEN NULL WHEN 5 THEN '  ' ELSE 'Photo desk' END AS attribution,
    page_id % 7 = 0 AS is_primary, page_id % 2 = 0 AS is_official,
    CASE WHEN page_id % 4 = 0 THEN 'FRONT' ELSE 'SIDE' END AS image_type,
    CASE WHEN page_id % 8 <> 3 THEN 'Press room' END AS source_name,
    CASE WHEN page_id % 9 <> 4 THEN url END AS source_url
FROM pages""",
    "m_hero": """
SELECT page_id // 4 AS product_id, max(CASE WHEN page_id % 3 <> 1 THEN url END) || ' ' AS hero_image_url
FROM pages GROUP BY page_id // 4""",
    "m_status_history": """
SELECT DISTINCT l_partkey AS product_id,
    CASE l_returnflag WHEN 'A' THEN 'ANNOUNCED' WHEN 'N' THEN 'PROTOTYPE' WHEN 'R' THEN 'COMMERCIAL' END AS status,
    CAST(l_shipdate AS DATE) AS effective_at
FROM lineitem""",
    "m_requirement": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey + 100 END AS country_id,
    CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS use_case,
    CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 40 AS INTEGER) END AS payload_min_kg,
    CASE WHEN c_custkey % 11 = 0 THEN 8 END AS operating_hours_day,
    CASE c_custkey % 9 WHEN 0 THEN true WHEN 1 THEN false END AS manipulation_required,
    CASE WHEN c_custkey % 13 = 0 THEN 'SUPERVISED_AUTONOMY' END AS autonomy_required,
    CASE WHEN c_custkey % 3 = 1 OR c_custkey % 12 = 5 THEN 'USD' END AS budget_currency,
    CASE WHEN c_custkey % 12 = 5 THEN CAST(1000 AS DOUBLE) END AS budget_min,
    CASE WHEN c_custkey % 3 = 1 THEN CAST(floor((c_acctbal + 1000) * 4) AS DOUBLE) END AS budget_max,
    CASE WHEN c_custkey % 17 = 0 THEN DATE '1996-01-01' + CAST(c_custkey % 1500 AS INTEGER) END AS required_by,
    (['BUY', 'RENT', 'RAAS', 'UNKNOWN', 'FLEXIBLE'])[c_custkey % 5 + 1] AS preferred_transaction
FROM customer""",
    "m_candidate": """
SELECT doc_id AS id, source, 'ref-' || (doc_id // 3) AS external_ref,
    CASE WHEN doc_id % 10 = 0 THEN 'Robot' ELSE upper(p_name) || ' Robot' END AS name,
    p_brand || ' Inc.' AS manufacturer,
    CASE WHEN doc_id % 97 = 5 THEN 'COMPONENT' ELSE 'ROBOT' END AS entity_type,
    'https://radar.example/' || doc_id AS discovery_url,
    CASE WHEN doc_id % 5 <> 2 THEN 'https://maker.example/' || doc_id END AS official_url,
    (['NOT_TRACED','TRACE_CONFIRMED','TRACE_PARTIAL','TRACE_FAILED','TRACE_CONFIRMED'])[doc_id % 5 + 1] AS trace_state,
    CASE WHEN doc_id % 5 IN (1, 4) THEN 'https://maker.example/' || doc_id END AS trace_url,
    CASE WHEN doc_id % 5 IN (1, 4) AND doc_id % 10 <> 9 THEN 'R. Viewer' END AS trace_verified_by,
    CASE WHEN doc_id % 50 = 7 THEN 'PROMOTED' WHEN doc_id % 50 = 8 THEN 'REJECTED' ELSE 'DISCOVERED' END AS status,
    DATE '2025-06-01' + CAST(doc_id % 90 AS INTEGER) AS updated_at
FROM documents JOIN part ON p_partkey = doc_id""",
    "m_source": """
SELECT key, 'Source ' || key AS name, k % 4 <> 0 AS is_enabled,
    CASE WHEN k % 3 = 0 THEN 'UNKNOWN' ELSE 'ALLOWED' END AS tos_status,
    CASE k % 5 WHEN 0 THEN 'DISALLOWED' WHEN 1 THEN 'NOT_APPLICABLE' ELSE 'ALLOWED' END AS robots_status,
    CASE WHEN k % 7 <> 0 THEN DATE '2026-01-01' END AS reviewed_at,
    CASE WHEN k % 11 <> 0 THEN 'R. Viewer' END AS reviewed_by
FROM (SELECT source AS key, min(doc_id) AS k FROM documents GROUP BY source) s""",
    "m_claim": """
SELECT doc_id AS id, doc_id // 5 AS candidate_id, source, lang AS field_key,
    CASE WHEN doc_id % 9 <> 0 THEN CAST(n_chars % 3 AS VARCHAR) END AS claimed_value,
    'https://radar.example/' || doc_id AS evidence_url
FROM documents""",
    "m_spec_claim": """
SELECT doc_id || '-' || k AS id, doc_id AS candidate_id, field_key,
    CASE WHEN (doc_id + k) % 7 = 0 THEN 'tall' ELSE CAST((n_chars + k) % 200 AS VARCHAR) END AS claimed_value,
    CASE WHEN (doc_id + k) % 11 = 0 THEN 'IN' WHEN (doc_id + k) % 3 = 0 THEN NULL
         ELSE upper(split_part(field_key, '_', 2)) END AS unit,
    CASE WHEN (doc_id + k) % 2 = 0 THEN 'VERIFIED' WHEN (doc_id + k) % 5 = 0 THEN 'CONFLICT' ELSE 'NOT_VERIFIED' END AS claim_status,
    'https://radar.example/' || doc_id AS evidence_url
FROM documents, (VALUES (0, 'height_cm'), (1, 'weight_kg'), (2, 'payload_kg')) t(k, field_key)""",
    "m_decision": """
SELECT doc_id AS candidate_id,
    CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'confirm' ELSE '' END AS decision FROM labels""",
    "m_event": "SELECT event_id AS id, event_type, ts, user_id AS client, props FROM events",
}


def _needed(sql: str, extra: dict[str, str]) -> list[str]:
    known, seen, found = {**VIEWS, **extra}, set(), []

    def visit(text: str) -> None:
        for name in known:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(known[name])
                found.append(name)

    visit(sql)
    return found


def with_model(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the model views it mentions."""
    extra = extra or {}
    names = _needed(sql, extra)
    if not names:
        return sql.strip()
    known = {**VIEWS, **extra}
    ctes = ",\n".join(f"{name} AS ({known[name].strip()})" for name in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        body = f"SELECT * FROM ({body}) q"
    return f"WITH RECURSIVE {ctes}\n{body}"
