"""Queries of the review: a worksheet over all candidates, applied, with everything it writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stage import materialize
from ..operators import discovery as dc
from ..operators import promotion as pr
from ..operators import review as rv
from ..sources.catalog import Catalog
from .catalogue import sql_normalize, sql_slug
from .discovery import identity_views
from .registry import query, shared_view

REVIEWER, REVIEWED_ON = "R. Viewer", "2026-03-01"

# Every third candidate comes from a maker the catalogue does not hold.
shared_view("m_arrival", "SELECT * REPLACE (CASE WHEN id % 3 = 1 THEN replace(manufacturer, ' Inc.', ' Labs') ELSE manufacturer END AS manufacturer) FROM m_candidate")
identity_views("m_arrival", "m_arrival")
shared_view("m_verdict", f"""
SELECT i.* EXCLUDE (updated_at), CASE WHEN i.id % 31 = 0 THEN i.id + 10000000 ELSE i.id END AS sheet_id, coalesce(decision, '') AS decision,
  CASE WHEN coalesce(decision, '') = '' THEN 'skipped' WHEN i.id % 31 = 0 THEN 'blocked' WHEN status IN ('PROMOTED', 'REJECTED') THEN 'skipped'
    WHEN i.id % 6 = 0 THEN 'blocked' WHEN decision = 'reject' THEN 'rejected' ELSE 'confirmed' END AS outcome,
  CASE WHEN coalesce(decision, '') = '' THEN 'unreviewed' WHEN i.id % 31 = 0 THEN 'NOT_FOUND' WHEN status IN ('PROMOTED', 'REJECTED') THEN 'ALREADY:' || status
    WHEN i.id % 6 = 0 THEN 'CHANGED' END AS why
FROM m_arrival_identity i LEFT JOIN m_decision d ON d.candidate_id = i.id""")
shared_view("m_gated", """
SELECT * EXCLUDE (next), concat_ws('|', CASE WHEN identity_status NOT IN ('MATCHED_EXISTING', 'NEW_ENTITY') THEN 'P1:' || identity_status END,
  CASE WHEN clash THEN 'P4' END, CASE WHEN entity_type <> 'ROBOT' THEN 'P6:' || entity_type END, CASE WHEN next <> 'READY_FOR_PROMOTION' THEN 'NOT_READY:' || next END) AS gates
FROM (SELECT v.* REPLACE (coalesce(official_url, 'https://traced.example/' || id) AS trace_url), coalesce(x.clash, false) AS clash, coalesce(x.v, 0) AS v, coalesce(x.u, 0) AS u,
    CASE WHEN id % 41 = 3 THEN 'RECHECK_REQUIRED' WHEN identity_status = 'POSSIBLE_DUPLICATE' THEN 'POSSIBLE_DUPLICATE'
      WHEN identity_status NOT IN ('MATCHED_EXISTING', 'NEW_ENTITY') THEN 'IDENTITY_REVIEW' WHEN x.clash THEN 'CONFLICT' ELSE 'READY_FOR_PROMOTION' END AS next
  FROM m_verdict v LEFT JOIN (SELECT candidate_id, bool_or(claim_status = 'CONFLICT') AS clash, count(*) FILTER (WHERE claim_status = 'VERIFIED') AS v,
    count(*) FILTER (WHERE claim_status <> 'VERIFIED') AS u FROM m_spec_claim GROUP BY 1) x ON x.candidate_id = v.id WHERE outcome = 'confirmed') g""")
shared_view("m_newcomer", f"""
WITH n AS (SELECT *, {sql_slug('name')} AS base, {sql_normalize('manufacturer')} AS mk, row_number() OVER (PARTITION BY {sql_slug('name')} ORDER BY id) AS k
  FROM m_gated WHERE gates = '' AND identity_status = 'NEW_ENTITY'),
f AS (SELECT b.base, i, row_number() OVER (PARTITION BY b.base ORDER BY i) AS k
  FROM (SELECT base, 2 * count(*) + 8 AS top FROM n GROUP BY base) b, LATERAL (SELECT unnest(generate_series(1, top)) AS i) g
  WHERE NOT EXISTS (SELECT 1 FROM m_product t WHERE t.slug = CASE WHEN i = 1 THEN b.base ELSE b.base || '-' || i END)
    AND NOT EXISTS (SELECT 1 FROM n t WHERE i > 1 AND t.base = b.base || '-' || i)),
known AS (SELECT {sql_normalize('name')} AS mk, min(slug) AS slug FROM m_manufacturer GROUP BY 1)
SELECT n.id, CASE WHEN i = 1 THEN n.base ELSE n.base || '-' || i END AS product_slug, sha256('product|' || n.id) AS product_key, n.name, n.manufacturer, n.mk,
  known.slug AS known_maker, coalesce(known.slug, {sql_slug("first_value(n.manufacturer) OVER (PARTITION BY n.mk ORDER BY n.id)")}) AS maker_slug,
  row_number() OVER (PARTITION BY n.mk ORDER BY n.id) AS of_maker
FROM n JOIN f USING (base, k) LEFT JOIN known ON known.mk = n.mk""")
shared_view("m_promoted", """
SELECT g.*, coalesce(w.product_slug, p.slug) AS product_slug, coalesce(w.product_key, CAST(p.id AS VARCHAR)) AS product_key,
  sha256('evidence|' || g.id || '|' || g.trace_url) AS evidence_key, p.id AS known_id, p.height_cm, p.weight_kg, p.payload_kg
FROM m_gated g LEFT JOIN m_newcomer w ON w.id = g.id LEFT JOIN m_product p ON p.id = g.possible_product_id AND g.identity_status = 'MATCHED_EXISTING' WHERE gates = ''""")
shared_view("m_filled", """
SELECT * FROM (SELECT r.id, r.product_slug, field, value, row_number() OVER (PARTITION BY r.product_slug, field ORDER BY r.id) AS rn
  FROM m_promoted r JOIN (SELECT candidate_id, field_key AS field, CAST(claimed_value AS DECIMAL(14,4)) AS value FROM m_spec_claim
    WHERE claim_status = 'VERIFIED' AND claimed_value <> 'tall' AND lower(coalesce(unit, '')) IN ('', split_part(field_key, '_', 2))
      AND CAST(CASE WHEN claimed_value <> 'tall' THEN claimed_value END AS DECIMAL(14,4)) >= CASE WHEN field_key = 'payload_kg' THEN 0 ELSE 0.1 END) w ON w.candidate_id = r.id
  WHERE known_id IS NULL OR CASE field WHEN 'height_cm' THEN height_cm WHEN 'weight_kg' THEN weight_kg ELSE payload_kg END IS NULL) q WHERE rn = 1""")


def arrivals(c: Catalog):
    maker = F.when(F.col("id") % 3 == 1, F.regexp_replace("manufacturer", " Inc\\.$", " Labs")).otherwise(F.col("manufacturer"))
    return dc.resolve_identity(c.candidate.withColumn("manufacturer", maker), c.product, c.manufacturer)


def reviewed_sheet(c: Catalog, people):
    """All candidates with what the reviewer wrote beside them; some rows are stale, some ids unknown."""
    key = F.col("candidate_id")
    rows = dc.snapshot_hash(people).select(F.col("id").alias("candidate_id"), "snapshot_hash", "official_url").join(c.decision, "candidate_id", "left")
    return rows.select(
        F.when(key % 31 == 0, key + 10_000_000).otherwise(key).alias("candidate_id"), F.coalesce("decision", F.lit("")).alias("decision"),
        F.when(key % 6 == 0, "stale").otherwise(F.col("snapshot_hash")).alias("snapshot_hash"),
        F.coalesce("official_url", F.concat(F.lit("https://traced.example/"), key.cast("string"))).alias("trace_url"),
        F.when(key % 4 == 0, "PRESS").otherwise(" ").alias("trace_source_type"), F.lit(" not a product ").alias("reject_reason"),
    )


def applied(c: Catalog) -> dict:
    people = materialize(arrivals(c), "arrivals")
    rechecks = c.candidate.filter(F.col("id") % 41 == 3).select(F.col("id").alias("candidate_id"))
    model = {"candidates": people, "claims": c.spec_claim, "products": c.product, "makers": c.manufacturer, "rechecks": rechecks}
    return rv.apply_worksheet(reviewed_sheet(c, people), model, REVIEWER, F.lit(REVIEWED_ON).cast("date"))


_OUTCOMES = """SELECT sheet_id AS candidate_id, outcome, why FROM m_verdict
UNION ALL SELECT id, 'promoted', product_slug FROM m_promoted UNION ALL SELECT id, 'blocked', 'PROMOTION:' || gates FROM m_gated WHERE gates <> ''"""


@query("review_outcomes", _OUTCOMES)
def _(c):
    return applied(c)["outcomes"]


@query("review_totals", "SELECT " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in rv.OUTCOMES) + f" FROM ({_OUTCOMES}) o")
def _(c):
    return applied(c)["totals"]


@query("review_promotion", f"""
SELECT 'product' AS output, product_key AS key, id AS candidate_id, product_slug AS subject, concat_ws('|', name, maker_slug, 'false') AS detail FROM m_newcomer
UNION ALL SELECT 'maker', maker_slug, id, maker_slug, manufacturer FROM m_newcomer WHERE known_maker IS NULL AND of_maker = 1
UNION ALL SELECT 'field', product_slug || '.' || field, id, product_slug, CAST(value AS VARCHAR) || '|https://radar.example/' || id FROM m_filled
UNION ALL SELECT 'evidence', evidence_key, id, product_key, concat_ws('|', product_slug, trace_url, CASE WHEN id % 4 = 0 THEN 'PRESS' ELSE 'MANUFACTURER_SITE' END,
  'VERIFIED', '{REVIEWED_ON}', 'Approved promotion, traced by {REVIEWER}') FROM m_promoted
UNION ALL SELECT 'audit', evidence_key, r.id, product_key, concat_ws('|', 'PROMOTED', product_slug, '{REVIEWER}', v, u, f.filled)
  FROM m_promoted r LEFT JOIN (SELECT id, string_agg(field || '=' || value, '|' ORDER BY field) AS filled FROM m_filled GROUP BY 1) f ON f.id = r.id
UNION ALL SELECT 'audit', NULL, id, NULL, 'REJECTED|{REVIEWER}|not a product' FROM m_verdict WHERE outcome = 'rejected'""")
def _(c):
    out = applied(c)
    row = lambda df, kind, key, subject, *detail: df.select(
        F.lit(kind).alias("output"), F.col(key).alias("key"), "candidate_id", F.col(subject).alias("subject"), F.concat_ws("|", *detail).alias("detail"))
    fields = out["fields"].withColumn("key", F.concat_ws(".", "product_slug", "field"))
    parts = [
        row(out["products"], "product", "key", "slug", "name", "manufacturer_slug", F.col("is_published").cast("string")),
        row(out["makers"], "maker", "slug", "slug", "name"),
        row(fields, "field", "key", "product_slug", F.col("value").cast("string"), "evidence_url"),
        row(out["evidence"], "evidence", "evidence_key", "subject_id", "subject_slug", "source_url", "source_type", "confidence", F.col("verified_at").cast("string"), "note"),
        row(out["audit"], "audit", "evidence_key", "product_key", "action", "product_slug", "approved_by", "reason", "verified_claims", "unresolved_claims", F.array_join("promoted_fields", "|")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("detail", F.regexp_replace("detail", "\\|$", ""))


@query("validate_worksheet", """
SELECT id AS candidate_id, unnest(list_filter([CASE WHEN id % 17 = 0 THEN 'unknown_decision' END, CASE WHEN id % 13 = 0 AND d <> '' THEN 'snapshot_hash_missing' END,
  CASE WHEN d = 'confirm' AND id % 5 = 2 THEN 'confirm_needs_trace_url' END, CASE WHEN d = 'reject' AND id % 7 < 3 THEN 'reject_needs_reason' END], lambda x: x IS NOT NULL)) AS problem
FROM (SELECT c.id, CASE WHEN c.id % 17 = 0 THEN 'maybe' ELSE coalesce(decision, '') END AS d FROM m_candidate c LEFT JOIN m_decision x ON x.candidate_id = c.id) s""")
def _(c):
    """The sheet as exported, spoiled by hand: odd decisions, hashes lost, links and reasons left out."""
    key = F.col("candidate_id")
    sheet = c.candidate.select(F.col("id").alias("candidate_id"), F.coalesce("official_url", F.lit("")).alias("trace_url")).join(c.decision, "candidate_id", "left")
    return dc.validate_worksheet(sheet.select(
        "candidate_id", F.when(key % 17 == 0, "maybe").otherwise(F.coalesce("decision", F.lit(""))).alias("decision"), "trace_url",
        F.when(key % 13 == 0, " ").otherwise("h").alias("snapshot_hash"), F.when(key % 7 < 3, " ").otherwise("not a product").alias("reject_reason")))


@query("register_source", """
SELECT key, name, is_enabled, tos_status, robots_status, reviewed_by FROM m_source
UNION ALL SELECT 'manual_bootstrap:spring', 'Manual bootstrap — spring', true, 'ALLOWED', 'NOT_APPLICABLE', 'R. Viewer'""")
def _(c):
    once = dc.register_source(c.source, "spring", REVIEWER)
    return dc.register_source(once, "spring", "Someone Else").drop("reviewed_at")


# ---- specifications entered by hand ----------------------------------------------------------------

shared_view("m_edit", """
SELECT p.*, p_size, unnest(['height_cm', 'payload_kg', 'mobility', 'has_sdk', 'hand_span']) AS field, id % 4 <> 0 AND id % 6 <> 0 AS sourced FROM m_product p JOIN part ON p_partkey = id""")


@query("apply_specs", """
SELECT slug, field, CASE WHEN reason IS NULL THEN now END AS current, CASE WHEN reason IS NULL THEN new END AS new, reason FROM (
  SELECT *, CASE WHEN field = 'hand_span' THEN 'no such product or field' WHEN field = 'payload_kg' AND p_size % 9 = 0 THEN 'not a plausible measurement'
      WHEN field = 'mobility' AND id % 10 = 0 THEN 'outside the vocabulary' WHEN field = 'has_sdk' AND id % 8 = 0 THEN 'expected true or false'
      WHEN new IS DISTINCT FROM now AND NOT sourced THEN 'changed values need source_url and retrieved_on' END AS reason
  FROM (SELECT id, slug, field, p_size, sourced,
      CASE field WHEN 'height_cm' THEN CAST(CAST(height_cm AS INTEGER) AS VARCHAR) WHEN 'payload_kg' THEN CAST(CAST(payload_kg AS INTEGER) AS VARCHAR)
        WHEN 'mobility' THEN mobility WHEN 'has_sdk' THEN CAST(has_sdk AS VARCHAR) END AS now,
      CASE field WHEN 'height_cm' THEN CAST(100 + 2 * p_size AS VARCHAR) WHEN 'payload_kg' THEN CAST(p_size AS VARCHAR) || '.5' WHEN 'mobility' THEN 'WHEELED'
        WHEN 'has_sdk' THEN CASE WHEN id % 3 = 0 THEN 'true' END END AS new FROM m_edit) e) j
WHERE reason IS NOT NULL OR new IS DISTINCT FROM now""")
def _(c):
    """Five entries a product: some state what is known, some are unreadable, some lack a source or a date."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    entry = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    entries = F.explode(F.array(
        entry("height_cm", F.concat((100 + 2 * F.col("p_size")).cast("string"), F.lit(".0"))),
        entry("payload_kg", F.when(F.col("p_size") % 9 == 0, "0").otherwise(F.concat(size, F.lit(".50")))),
        entry("mobility", F.when(key % 10 == 0, "flying").otherwise(" wheeled ")),
        entry("has_sdk", F.when(key % 8 == 0, "yes").when(key % 3 == 0, "TRUE").otherwise(" ")),
        entry("hand_span", F.lit("3")),
    )).alias("e")
    edits = c.table("part").select(
        F.concat(F.lit("p-"), key.cast("string")).alias("slug"), entries, F.when(key % 4 != 0, "https://maker.example/sheet").alias("source_url"),
        F.when(key % 6 != 0, "2026-01-05").otherwise("soon").alias("retrieved_on")).select("slug", "e.*", "source_url", "retrieved_on")
    changes, refused = pr.apply_specs(c.product, edits)
    return changes.select("slug", "field", "current", "new").unionByName(refused.select("slug", "field", "reason"), allowMissingColumns=True)
