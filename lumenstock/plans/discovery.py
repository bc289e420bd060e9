"""Queries of discovery, promotion and catalogue authoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import discovery as dc
from ..operators import promotion as pr
from ..sources.catalog import Catalog
from .catalogue import sql_brand, sql_model_key, sql_normalize, sql_slug
from .registry import query, shared_view

_ELIGIBLE = """is_enabled AND tos_status = 'ALLOWED' AND robots_status IN ('ALLOWED', 'NOT_APPLICABLE') AND reviewed_at IS NOT NULL AND reviewed_by IS NOT NULL"""

def identity_views(prefix: str, candidates: str) -> None:
    """Views of keyed candidates and of their identity, over the candidates of a view."""
    shared_view(f"{prefix}_keyed", f"SELECT *, {sql_model_key('name', 'maker_key')} AS model_key FROM (SELECT *, {sql_normalize('manufacturer')} AS maker_key FROM {candidates}) c")
    shared_view(f"{prefix}_identity", f"""
SELECT k.*, CASE WHEN e.n = 1 THEN 'MATCHED_EXISTING' WHEN e.n > 1 THEN 'AMBIGUOUS' WHEN k.model_key = '' AND s.n = 1 THEN 'POSSIBLE_DUPLICATE'
    WHEN k.model_key = '' THEN 'AMBIGUOUS' WHEN t.n > 1 THEN 'POSSIBLE_DUPLICATE' ELSE 'NEW_ENTITY' END AS identity_status,
  CASE WHEN e.n = 1 THEN e.id WHEN e.n IS NULL AND k.model_key = '' AND s.n = 1 THEN s.id END AS possible_product_id, m.slug AS possible_maker
FROM {prefix}_keyed k
LEFT JOIN (SELECT maker_key, model_key, count(*) AS n, min(id) AS id FROM m_shelf WHERE model_key <> '' GROUP BY 1, 2) e USING (maker_key, model_key)
LEFT JOIN (SELECT maker_key, count(*) AS n, min(id) AS id FROM m_shelf WHERE maker_key <> '' GROUP BY 1) s USING (maker_key)
LEFT JOIN (SELECT maker_key, model_key, count(*) AS n FROM {prefix}_keyed GROUP BY 1, 2) t USING (maker_key, model_key)
LEFT JOIN (SELECT min(maker_key) AS maker_key, manufacturer_slug AS slug FROM m_shelf GROUP BY 2) m ON m.maker_key = k.maker_key""")


def hash_view(name: str, identity: str) -> None:
    """The snapshot hash of every candidate of an identity view."""
    shared_view(name, f"""
SELECT id, sha256('[' || concat_ws(',', '["candidate_id","' || id || '"]', '["external_ref","' || external_ref || '"]', '["candidate_name","' || name || '"]',
  '["candidate_manufacturer","' || manufacturer || '"]', '["identity_status","' || identity_status || '"]', '["status","' || status || '"]',
  '["trace_state","' || trace_state || '"]', '["official_url_lead",' || coalesce('"' || official_url || '"', 'null') || ']',
  '["updated_at","' || strftime(updated_at, '%Y-%m-%dT00:00:00.000000+00:00') || '"]') || ']') AS h FROM {identity}""")


shared_view("m_shelf", f"""
SELECT *, {sql_model_key('name', 'maker_key')} AS model_key FROM (SELECT id, name, manufacturer_slug, {sql_normalize('manufacturer_slug')} AS maker_key FROM m_product) p""")
identity_views("m", "m_candidate")
hash_view("m_hash", "m_identity")
shared_view("m_conflict", """
SELECT DISTINCT candidate_id FROM (SELECT candidate_id, field_key FROM m_claim GROUP BY 1, 2 HAVING count(DISTINCT claimed_value) > 1) f""")
shared_view("m_state", """
SELECT i.* REPLACE (CASE WHEN status IN ('PROMOTED', 'REJECTED') THEN status WHEN id % 41 = 3 THEN 'RECHECK_REQUIRED'
    WHEN identity_status = 'POSSIBLE_DUPLICATE' THEN 'POSSIBLE_DUPLICATE' WHEN identity_status NOT IN ('MATCHED_EXISTING', 'NEW_ENTITY') THEN 'IDENTITY_REVIEW'
    WHEN trace_state = 'TRACE_FAILED' THEN 'INSUFFICIENT_EVIDENCE' WHEN trace_state <> 'TRACE_CONFIRMED' OR coalesce(trace_verified_by, '') = '' THEN 'SOURCE_TRACE'
    WHEN id IN (SELECT candidate_id FROM m_conflict) THEN 'CONFLICT' ELSE 'READY_FOR_PROMOTION' END AS status) FROM m_identity i""")


def identified(c: Catalog):
    return dc.resolve_identity(c.candidate, c.product, c.manufacturer)


def advanced(c: Catalog):
    """Candidates at the state their evidence allows."""
    conflicts = dc.claim_conflicts(c.claim).filter("claim_status = 'CONFLICT'").select("candidate_id")
    rechecks = c.candidate.filter(F.col("id") % 41 == 3).select(F.col("id").alias("candidate_id"))
    return dc.candidate_status(identified(c), conflicts, rechecks).withColumn("status", F.col("next_status")).drop("next_status")


@query("candidate_ingest", f"""
WITH st AS (SELECT source, external_ref, min(id) AS candidate_id, arg_min(name, id) AS name FROM m_candidate WHERE id % 3 = 0 GROUP BY 1, 2),
b AS (SELECT source, external_ref, min(id) AS candidate_id, arg_min(name, id) AS name, max(DATE '2026-03-01' + CAST(id % 5 AS INTEGER)) AS seen
  FROM m_candidate WHERE id % 3 <> 0 AND source IN (SELECT key FROM m_source WHERE {_ELIGIBLE}) GROUP BY 1, 2)
SELECT source, external_ref, coalesce(st.candidate_id, b.candidate_id) AS candidate_id, coalesce(st.name, b.name) AS name,
  coalesce(b.seen, DATE '2026-02-01') AS last_seen_at, CASE WHEN st.candidate_id IS NULL THEN 'INSERTED' WHEN b.seen IS NOT NULL THEN 'SEEN' ELSE 'KEPT' END AS action
FROM st FULL OUTER JOIN b USING (source, external_ref)""")
def _(c):
    rows = c.candidate.select("source", "external_ref", F.col("id").alias("candidate_id"), "name")
    old = F.col("candidate_id") % 3 == 0
    store = rows.filter(old).groupBy("source", "external_ref").agg(
        F.min("candidate_id").alias("candidate_id"), F.min_by("name", "candidate_id").alias("name")
    ).withColumn("last_seen_at", F.lit("2026-02-01").cast("date"))
    batch = rows.filter(~old).withColumn("seen_at", F.date_add(F.lit("2026-03-01").cast("date"), (F.col("candidate_id") % 5).cast("int")))
    merged, _ = dc.ingest(store, batch, c.source)
    return merged


def raw_batch(c: Catalog):
    key = F.col("id")
    link = F.coalesce(F.col("official_url"), F.lit(""))
    data = F.when(key % 13 == 0, F.concat(F.lit('{"official_url":"'), link, F.lit('","price":1,"height":2}'))).otherwise(
        F.concat(F.lit('{"official_url":"'), link, F.lit('"}'))
    )
    image = F.concat(F.when(key % 17 == 0, "data:image/png;base64,").otherwise(" HTTPS://img.example/"), key.cast("string"))
    return c.candidate.select(
        key, F.when(key % 19 == 0, F.lit(None)).otherwise(F.col("external_ref")).alias("external_ref"), "name",
        F.when(key % 29 == 0, " ").otherwise(F.col("manufacturer")).alias("manufacturer"), "source", data.alias("data"), F.array(image).alias("image_urls"),
    )


@query("reject_candidates", """
SELECT id, concat_ws('|', CASE WHEN id % 19 = 0 THEN 'missing_external_ref' END, CASE WHEN id % 13 = 0 THEN 'unknown_keys:height,price' END,
  CASE WHEN id % 17 = 0 THEN 'image_not_http' END) AS reasons FROM m_candidate WHERE id % 19 = 0 OR id % 13 = 0 OR id % 17 = 0""")
def _(c):
    _, rejected = dc.reject_candidates(raw_batch(c))
    return rejected.select("id", F.array_join("reasons", "|").alias("reasons"))


@query("validate_dataset", """
WITH b AS (SELECT id, CASE WHEN id % 19 <> 0 THEN external_ref END AS ref, id % 29 = 0 AS no_maker FROM m_candidate)
SELECT id, 'external_ref_required' AS problem FROM b WHERE ref IS NULL
UNION ALL SELECT id, 'manufacturer_required' FROM b WHERE no_maker
UNION ALL SELECT id, 'duplicate_external_ref' FROM (SELECT id, row_number() OVER (PARTITION BY ref ORDER BY id) AS rn FROM b WHERE ref IS NOT NULL) d WHERE rn > 1
UNION ALL SELECT DISTINCT candidate_id, 'claim_without_evidence' FROM m_claim WHERE id % 23 = 0 AND candidate_id IN (SELECT id FROM b)""")
def _(c):
    claims = c.claim.withColumn("evidence_url", F.when(F.col("id") % 23 == 0, " ").otherwise(F.col("evidence_url")))
    return dc.validate_dataset(raw_batch(c), claims)


@query("batch_stats", """
SELECT source, count(*) AS records, count(DISTINCT manufacturer) AS makers,
  coalesce((SELECT count(*) FROM m_claim x WHERE x.source = c.source), 0) AS claims FROM m_candidate c GROUP BY source""")
def _(c):
    return dc.batch_stats(c.candidate, c.claim)


@query("identity_resolution", "SELECT id, identity_status, possible_product_id, possible_maker FROM m_identity")
def _(c):
    return identified(c).select("id", "identity_status", "possible_product_id", "possible_maker")


@query("candidate_status", "SELECT id, identity_status, status FROM m_state")
def _(c):
    return advanced(c).select("id", "identity_status", "status")


@query("claim_conflicts", """
SELECT c.id, c.candidate_id, c.field_key, CASE WHEN n > 1 THEN 'CONFLICT' WHEN claimed_value IS NULL THEN 'UNKNOWN' ELSE 'NOT_VERIFIED' END AS claim_status
FROM m_claim c JOIN (SELECT candidate_id, field_key, count(DISTINCT claimed_value) AS n FROM m_claim GROUP BY 1, 2) f USING (candidate_id, field_key)""")
def _(c):
    return dc.claim_conflicts(c.claim).select("id", "candidate_id", "field_key", "claim_status")


@query("apply_traces", """
SELECT c.id, CASE WHEN t.trace_state = 'TRACE_CONFIRMED' AND claimed_value IS NOT NULL AND field_key IN ('en', CASE WHEN t.id % 2 = 0 THEN 'fr' ELSE 'de' END)
    THEN 'VERIFIED' ELSE 'NOT_VERIFIED' END AS claim_status
FROM m_claim c LEFT JOIN m_candidate t ON t.id = c.candidate_id""")
def _(c):
    traces = c.candidate.select(
        F.col("id").alias("candidate_id"), "trace_state", "trace_url",
        F.array(F.lit("en"), F.when(F.col("id") % 2 == 0, "fr").otherwise("de")).alias("confirmed_fields"),
    )
    return dc.apply_traces(c.claim.withColumn("claim_status", F.lit("NOT_VERIFIED")), traces).select("id", "claim_status")


@query("snapshot_hash", """
SELECT id, sha256('[' || concat_ws(',', '["candidate_id","' || id || '"]', '["external_ref","' || external_ref || '"]', '["candidate_name","' || name || '"]',
  '["candidate_manufacturer","' || manufacturer || '"]', '["identity_status","' || identity_status || '"]', '["status","' || status || '"]',
  '["trace_state","' || trace_state || '"]', '["official_url_lead",' || coalesce('"' || official_url || '"', 'null') || ']',
  '["updated_at","' || strftime(updated_at, '%Y-%m-%dT00:00:00.000000+00:00') || '"]') || ']') AS snapshot_hash FROM m_identity""")
def _(c):
    return dc.snapshot_hash(identified(c)).select("id", "snapshot_hash")


@query("review_worksheet", """
SELECT i.id AS candidate_id, h AS snapshot_hash, coalesce(official_url, '') AS trace_url, name, manufacturer, coalesce(n, 0) AS claims
FROM m_identity i JOIN m_hash USING (id) LEFT JOIN (SELECT candidate_id, count(*) AS n FROM m_claim GROUP BY 1) c ON c.candidate_id = i.id
WHERE status NOT IN ('PROMOTED', 'REJECTED')""")
def _(c):
    return dc.review_worksheet(identified(c), c.claim).select("candidate_id", "snapshot_hash", "trace_url", "name", "manufacturer", "claims")


@query("apply_decisions", """
SELECT CASE WHEN d.candidate_id % 31 = 0 THEN d.candidate_id + 10000000 ELSE d.candidate_id END AS candidate_id,
  CASE WHEN decision = '' THEN 'skipped' WHEN d.candidate_id % 31 = 0 THEN 'blocked' WHEN i.status IN ('PROMOTED', 'REJECTED') THEN 'skipped'
    WHEN d.candidate_id % 6 = 0 THEN 'blocked' WHEN decision = 'reject' THEN 'rejected' ELSE 'confirmed' END AS outcome,
  CASE WHEN decision = '' THEN 'unreviewed' WHEN d.candidate_id % 31 = 0 THEN 'NOT_FOUND' WHEN i.status IN ('PROMOTED', 'REJECTED') THEN 'ALREADY:' || i.status
    WHEN d.candidate_id % 6 = 0 THEN 'CHANGED' END AS why
FROM m_decision d LEFT JOIN m_identity i ON i.id = d.candidate_id""")
def _(c):
    people = identified(c)
    key = F.col("candidate_id")
    hashes = dc.snapshot_hash(people).select(F.col("id").alias("candidate_id"), "snapshot_hash")
    sheet = c.decision.join(hashes, "candidate_id", "left").withColumn(
        "snapshot_hash", F.when(key % 6 == 0, "stale").otherwise(F.col("snapshot_hash"))
    ).withColumn("candidate_id", F.when(key % 31 == 0, key + 10_000_000).otherwise(key))
    outcomes, _ = dc.apply_decisions(sheet, people)
    return outcomes


_PROMOTABLE = "identity_status IN ('MATCHED_EXISTING', 'NEW_ENTITY')"


@query("promotion_gates", f"""
SELECT s.id, concat_ws('|', CASE WHEN NOT {_PROMOTABLE} THEN 'P1:' || identity_status END,
  CASE WHEN trace_state <> 'TRACE_CONFIRMED' OR trace_url IS NULL OR trace_verified_by IS NULL THEN 'P2' END,
  CASE WHEN status = 'CONFLICT' OR coalesce(clash, false) THEN 'P4' END,
  CASE WHEN entity_type <> 'ROBOT' THEN 'P6:' || entity_type END,
  CASE WHEN status <> 'READY_FOR_PROMOTION' THEN 'NOT_READY:' || status END) AS gates_failed,
  coalesce(v, 0) AS verified_claims, coalesce(u, 0) AS unresolved_claims
FROM m_state s LEFT JOIN (SELECT candidate_id, count(*) FILTER (WHERE claim_status = 'VERIFIED') AS v, count(*) FILTER (WHERE claim_status <> 'VERIFIED') AS u,
  bool_or(claim_status = 'CONFLICT') AS clash FROM m_spec_claim GROUP BY 1) c ON c.candidate_id = s.id""")
def _(c):
    rows = pr.promotion_gates(advanced(c), c.spec_claim)
    return rows.select("id", F.array_join("gates_failed", "|").alias("gates_failed"), "verified_claims", "unresolved_claims")


@query("promotion_fields", """
WITH ready AS (SELECT s.* FROM m_state s WHERE status = 'READY_FOR_PROMOTION' AND entity_type = 'ROBOT'
    AND NOT EXISTS (SELECT 1 FROM m_spec_claim c WHERE c.candidate_id = s.id AND claim_status = 'CONFLICT')),
w AS (SELECT candidate_id, field_key AS field, CAST(claimed_value AS DECIMAL(14,4)) AS value FROM m_spec_claim
  WHERE claim_status = 'VERIFIED' AND claimed_value <> 'tall' AND lower(coalesce(unit, '')) IN ('', split_part(field_key, '_', 2))
    AND CAST(CASE WHEN claimed_value <> 'tall' THEN claimed_value END AS DECIMAL(14,4)) >= CASE WHEN field_key = 'payload_kg' THEN 0 ELSE 0.1 END)
SELECT r.id AS candidate_id, coalesce(p.slug, 'new') AS product_slug, w.field, w.value FROM ready r JOIN w ON w.candidate_id = r.id
LEFT JOIN m_product p ON p.id = r.possible_product_id
WHERE r.identity_status = 'NEW_ENTITY' OR CASE w.field WHEN 'height_cm' THEN p.height_cm WHEN 'weight_kg' THEN p.weight_kg ELSE p.payload_kg END IS NULL""")
def _(c):
    approvals = c.candidate.select(F.col("id").alias("candidate_id"), F.lit("R. Viewer").alias("approved_by"))
    written = pr.promote(advanced(c), c.spec_claim, c.product, c.manufacturer, approvals)["fields"]
    return written.select(
        "candidate_id", F.when(F.col("product_slug").rlike("^p-[0-9]+$"), F.col("product_slug")).otherwise("new").alias("product_slug"), "field", "value"
    )


_BASE = sql_slug("name")


@query("unique_slugs", f"""
WITH n AS (SELECT id, {_BASE} AS base, row_number() OVER (PARTITION BY {_BASE} ORDER BY id) AS k FROM m_candidate),
t AS (SELECT DISTINCT base || CASE WHEN id % 7 < 2 THEN '' ELSE '-' || (id % 7) END AS slug FROM n WHERE id % 4 = 0),
f AS (SELECT b.base, i, row_number() OVER (PARTITION BY b.base ORDER BY i) AS k
  FROM (SELECT base, count(*) + 8 AS top FROM n GROUP BY base) b, LATERAL (SELECT unnest(generate_series(1, top)) AS i) g
  WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.slug = CASE WHEN i = 1 THEN b.base ELSE b.base || '-' || i END))
SELECT n.id, n.base, CASE WHEN i = 1 THEN n.base ELSE n.base || '-' || i END AS slug FROM n JOIN f USING (base, k)""")
def _(c):
    new = c.candidate.select("id", text.slug_or_item(F.col("name")).alias("base"))
    suffix = F.when(F.col("id") % 7 < 2, "").otherwise(F.concat(F.lit("-"), (F.col("id") % 7).cast("string")))
    taken = new.filter(F.col("id") % 4 == 0).select(F.concat("base", suffix).alias("slug")).distinct()
    return pr.unique_slugs(new, taken)


_SLUG = f"""CASE WHEN slug_n = lead OR starts_with(slug_n, lead || '-') THEN slug_n ELSE brand || '-' || slug_n END"""


def _slugged(source: str, maker: str) -> str:
    return (f"(SELECT *, {_SLUG} AS made FROM (SELECT *, {sql_slug('name')} AS slug_n, {sql_brand(sql_slug(maker))} AS brand, "
            f"string_split({sql_brand(sql_slug(maker))}, '-')[1] AS lead FROM {source}) a)")


def _loose(expr: str) -> str:
    return f"regexp_replace(lower(coalesce({expr}, '')), '[^a-z0-9]+', '', 'g')"


@query("plan_stubs", f"""
WITH i AS (SELECT id, name, CASE WHEN id % 2 = 0 THEN replace(manufacturer, ' Inc.', '') ELSE manufacturer END AS maker FROM m_candidate),
p AS (SELECT made AS slug, manufacturer_slug, name FROM {_slugged('m_product', 'manufacturer_slug')} x WHERE id % 3 = 0),
r AS (SELECT id, name, made AS slug, coalesce(k1.slug, {sql_slug('maker')}) AS maker_slug, k1.slug IS NULL AS new_maker
  FROM {_slugged('i', 'maker')} x LEFT JOIN (SELECT {_loose('slug')} AS k, min(slug) AS slug FROM m_manufacturer GROUP BY 1) k1 ON k1.k = {_loose('maker')}),
h AS (SELECT r.*, EXISTS (SELECT 1 FROM p WHERE {_loose('p.manufacturer_slug')} = {_loose('r.maker_slug')} AND {_loose('p.name')} = {_loose('r.name')}) AS held,
    EXISTS (SELECT 1 FROM p WHERE p.slug = r.slug) AS taken FROM r)
SELECT id, maker_slug, new_maker, slug, CASE WHEN held THEN 'HELD'
  WHEN taken OR row_number() OVER (PARTITION BY held, slug ORDER BY id) > 1 THEN 'SLUG_TAKEN' ELSE 'STUB' END AS outcome FROM h""")
def _(c):
    maker = F.when(F.col("id") % 2 == 0, F.regexp_replace("manufacturer", " Inc\\.$", "")).otherwise(F.col("manufacturer"))
    incoming = c.candidate.select("id", maker.alias("manufacturer"), "name")
    shelf = c.product.filter(F.col("id") % 3 == 0).withColumn("slug", text.product_slug(F.col("manufacturer_slug"), F.col("name")))
    return pr.plan_stubs(incoming, shelf, c.manufacturer)


@query("spec_gaps", "SELECT slug, len(m) AS missing, array_to_string(m, '|') AS missing_fields FROM (SELECT slug, list_filter(["
       + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in pr.SPEC_FIELDS) + "], lambda x: x IS NOT NULL) AS m FROM m_product) g WHERE len(m) > 0")
def _(c):
    return pr.spec_gaps(c.product).select("slug", "missing", F.array_join("missing_fields", "|").alias("missing_fields"))


@query("image_decisions", """
SELECT id, CASE WHEN problem IS NOT NULL THEN 'refused' WHEN d = '' THEN 'skipped' WHEN d = 'reject' THEN 'rejected' ELSE 'applied' END AS outcome, problem,
  CASE WHEN problem IS NULL AND d = 'confirm' THEN CASE WHEN id % 3 = 2 THEN 'ATTRIBUTION_REQUIRED' ELSE 'UNKNOWN' END END AS rights_status,
  CASE WHEN problem IS NULL AND d = 'confirm' THEN CASE WHEN id % 3 = 2 THEN 'NONE' ELSE 'OFFICIAL_MANUFACTURER_MEDIA' END END AS usage_basis
FROM (SELECT id, d, CASE WHEN source_url IS NULL OR source_name IS NULL THEN 'required field missing'
    WHEN d = 'confirm' AND id % 5 = 0 THEN 'confirm needs a named person' WHEN d = 'reject' AND id % 7 = 0 THEN 'reject needs a reason' END AS problem
  FROM (SELECT *, (['confirm', 'reject', ''])[id % 4 % 3 + 1] AS d FROM m_image) a) b""")
def _(c):
    key = F.col("id")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at)
    rows = c.image.select(
        "id", F.concat(F.lit("p-"), F.col("product_id").cast("string")).alias("slug"), "image_url", "source_url", "source_name",
        pick(["MANUFACTURER", "PRESS_KIT", "EDITORIAL"], (key % 3).cast("int")).alias("source_type"), "image_type",
        pick([" Confirm", "reject", ""], (key % 4 % 3).cast("int")).alias("decision"),
        F.when(key % 5 != 0, "R. Viewer").alias("confirmed_by"), F.when(key % 7 != 0, "other model").alias("reject_reason"),
    )
    return pr.image_decisions(rows, c.product).select("id", "outcome", "problem", "rights_status", "usage_basis")
