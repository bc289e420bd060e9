"""Queries of buyer intake, lead capture and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leads as ld
from ..sources.catalog import Catalog
from .offers import applicable
from .registry import query, shared_view

# ---- wizard answers written from the order book ------------------------------------------------


def wizard(c: Catalog):
    key = F.col("o_orderkey")

    def state(n: int):
        pick = F.get(F.array(F.lit("ANSWERED"), F.lit("UNKNOWN"), F.lit("SKIPPED")), ((key + n) % 3).cast("int"))
        return F.when(key % 20 == 0, "SKIPPED").otherwise(pick)

    parts = [
        '{"wizard_version":1,"answers":{"task":{"state":"', state(0), '","use_case":"', F.col("o_orderpriority"), '"},"payload":{"state":"', state(1),
        '","value":" ', (key % 40).cast("string"), ' "},"hours":{"state":"', state(2), '","value":"', F.when(key % 5 == 0, "  ").otherwise("8.5"),
        '"},"manipulation":{"state":"', state(0), '","value":', F.when(key % 2 == 0, "true").otherwise("false"),
        '},"budget":{"state":"', state(1), '","currency":"USD","min":null,"max":', (key % 1000).cast("string"), '.5},"timeline":{"state":"', state(1),
        '","value":"2026-05-01"},"transaction":{"state":"', state(2), '","value":"RENT"}}}',
    ]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return c.table("orders").select(key.alias("id"), text.alias("raw_input"), F.lit("COMMERCIAL_BUYER").alias("buyer_type"))


def _st(n: int) -> str:
    return f"CASE WHEN id % 20 = 0 THEN 'SKIPPED' ELSE (['ANSWERED', 'UNKNOWN', 'SKIPPED'])[(id + {n}) % 3 + 1] END"


shared_view("m_wizard", f"""
SELECT id, s0, s1, s2, CASE WHEN s0 = 'ANSWERED' THEN o_orderpriority END AS use_case, CASE WHEN s1 = 'ANSWERED' THEN CAST(id % 40 AS DOUBLE) END AS payload_min_kg,
  CASE WHEN s2 = 'ANSWERED' AND id % 5 <> 0 THEN CAST(8.5 AS DOUBLE) END AS operating_hours_day, CASE WHEN s0 = 'ANSWERED' THEN id % 2 = 0 END AS manipulation_required,
  CASE WHEN s1 = 'ANSWERED' THEN 'USD' END AS budget_currency, CASE WHEN s1 = 'ANSWERED' THEN CAST(id % 1000 AS DOUBLE) + 0.5 END AS budget_max,
  CASE WHEN s1 = 'ANSWERED' THEN DATE '2026-05-01' END AS required_by, CASE WHEN s2 = 'ANSWERED' THEN 'RENT' ELSE 'UNKNOWN' END AS preferred_transaction
FROM (SELECT id, o_orderpriority, {_st(0)} AS s0, {_st(1)} AS s1, {_st(2)} AS s2 FROM (SELECT o_orderkey AS id, o_orderpriority FROM orders) o) w""")
_COLUMNS = ["id", "use_case", "payload_min_kg", "operating_hours_day", "manipulation_required", "budget_currency", "budget_max", "required_by", "preferred_transaction"]


@query("normalize_requirements", f"SELECT {', '.join(_COLUMNS)} FROM m_wizard")
def _(c):
    return ld.normalize_requirements(wizard(c)).select(*_COLUMNS)


@query("has_signal", """
SELECT id, preferred_transaction <> 'UNKNOWN' OR s0 IN ('ANSWERED', 'UNKNOWN') OR s1 IN ('ANSWERED', 'UNKNOWN') OR s2 IN ('ANSWERED', 'UNKNOWN') AS signal FROM m_wizard""")
def _(c):
    return ld.normalize_requirements(wizard(c)).select("id", ld.has_signal().alias("signal"))


@query("requirement_snapshot", """
SELECT id, CAST(to_json({'snapshot_version': 1, 'buyer_type': 'COMMERCIAL_BUYER', 'use_case': use_case, 'industry': CAST(NULL AS VARCHAR), 'task_description': CAST(NULL AS VARCHAR),
  'environment': CAST(NULL AS VARCHAR), 'country': CAST(NULL AS VARCHAR), 'payload_min_kg': payload_min_kg, 'operating_hours_day': operating_hours_day,
  'manipulation_required': manipulation_required, 'autonomy_required': CAST(NULL AS VARCHAR), 'budget_currency': budget_currency, 'budget_min': CAST(NULL AS DOUBLE),
  'budget_max': budget_max, 'required_by': required_by, 'preferred_transaction': preferred_transaction}) AS VARCHAR) AS snapshot FROM m_wizard""")
def _(c):
    return ld.normalize_requirements(wizard(c)).select("id", ld.requirement_snapshot().alias("snapshot"))


# ---- requests ------------------------------------------------------------------------------------

@query("resolve_requirements", """
WITH q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'SPACE' WHEN o_orderkey % 5 <> 0 THEN c_mktsegment END AS use_case,
    CASE WHEN o_orderkey % 13 = 0 THEN 'Z1' WHEN o_orderkey % 4 <> 0 THEN 'N' || c_nationkey END AS country, CASE WHEN o_orderkey % 3 = 0 THEN 'p-' || (o_orderkey % (SELECT count(*) + 10 FROM part)) END AS slug
  FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT q.id, r.id AS country_id, p.id AS product_id, concat_ws('|', CASE WHEN q.use_case = 'SPACE' THEN 'unknown_use_case' END, CASE WHEN q.country = 'Z1' THEN 'unknown_country' END,
  CASE WHEN q.slug IS NOT NULL AND p.id IS NULL THEN 'unknown_or_unpublished_product' END) AS reasons
FROM q LEFT JOIN m_region r ON r.code = q.country AND r.type = 'COUNTRY' LEFT JOIN m_product p ON p.slug = q.slug AND p.is_published""")
def _(c):
    key = F.col("o_orderkey")
    requests = c.table("orders").join(c.table("customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        key.alias("id"), F.when(key % 11 == 0, "SPACE").when(key % 5 != 0, F.col("c_mktsegment")).alias("use_case"),
        F.when(key % 13 == 0, "Z1").when(key % 4 != 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("country"),
        F.when(key % 3 == 0, F.concat(F.lit("p-"), (key % (product_count(c) + 10)).cast("string"))).alias("product_slug"),
    )
    ok, rejected = ld.resolve_requirements(requests, c.use_case, c.region, c.product)
    none = F.array().cast("array<string>")
    return ok.withColumn("reasons", none).unionByName(rejected).select("id", "country_id", "product_id", F.array_join("reasons", "|").alias("reasons"))


@query("validate_intake", """
SELECT c_custkey AS id, concat_ws('|', CASE WHEN c_custkey % 7 = 0 THEN 'contact_email' END, CASE WHEN c_custkey % 11 = 0 THEN 'contact_name' END,
  CASE WHEN c_custkey % 13 = 0 THEN 'organization' END, CASE WHEN c_custkey % 17 = 0 THEN 'contact_phone' END,
  CASE WHEN c_custkey % 19 = 0 THEN 'budget_currency_required' END, CASE WHEN c_custkey % 23 = 0 AND c_custkey % 19 <> 0 THEN 'budget_currency' END,
  CASE WHEN c_acctbal < 500 AND c_acctbal >= 0 THEN 'budget_order' END, CASE WHEN c_acctbal < 0 THEN 'budget_order|budget_negative' END,
  CASE WHEN c_custkey % 29 = 0 THEN 'autonomy_required' END, CASE WHEN c_custkey % 31 = 0 THEN 'required_by' END) AS reasons
FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0 OR c_custkey % 19 = 0 OR c_custkey % 23 = 0
  OR c_acctbal < 500 OR c_custkey % 29 = 0 OR c_custkey % 31 = 0""")
def _(c):
    k = F.col("c_custkey")
    requests = c.table("customer").select(
        k.alias("id"), F.when(k % 7 == 0, "not-an-address").otherwise(F.concat(F.lit(" buyer"), k.cast("string"), F.lit("@x.example "))).alias("contact_email"),
        F.when(k % 11 == 0, F.repeat(F.lit("n"), 201)).otherwise(F.col("c_name")).alias("contact_name"), F.when(k % 13 == 0, "  ").otherwise("Works").alias("organization"),
        F.when(k % 17 == 0, F.repeat(F.lit("9"), 41)).alias("contact_phone"), F.lit("hello").alias("message"),
        F.when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, "DOLLAR").otherwise("USD").alias("budget_currency"),
        F.lit(500.0).alias("budget_min"), F.col("c_acctbal").alias("budget_max"), F.lit(5.0).alias("payload_min_kg"), F.lit(8.0).alias("operating_hours_day"),
        F.when(k % 29 == 0, "SENTIENT").alias("autonomy_required"), F.lit("RENT").alias("preferred_transaction"),
        F.when(k % 31 == 0, "soon").otherwise("2026-05-01").alias("required_by"),
    )
    _, rejected = ld.validate_intake(requests)
    return rejected.select("id", F.array_join("reasons", "|").alias("reasons"))


# ---- capture and routing ---------------------------------------------------------------------------

def product_count(c: Catalog):
    return c.table("part").agg(F.count(F.lit(1))).scalar()


def stored_matches(c: Catalog):
    """A stored shortlist of four products per requirement."""
    i = F.col("rank")
    rows = c.requirement.select(F.col("id").alias("requirement_id"), F.explode(F.array(*[F.lit(n) for n in range(1, 5)])).alias("rank"))
    product = (F.col("requirement_id") * 7 + i * 13) % product_count(c)
    return rows.select("requirement_id", "rank", product.alias("product_id"), F.concat(F.lit("p-"), product.cast("string")).alias("slug"), (90 - i).cast("long").alias("score"))


shared_view("m_stored", """
SELECT id AS requirement_id, i AS rank, (id * 7 + i * 13) % n AS product_id, 'p-' || ((id * 7 + i * 13) % n) AS slug, 90 - i AS score
FROM m_requirement, (VALUES (1), (2), (3), (4)) t(i), (SELECT count(*) AS n FROM part) u""")


def submissions(c: Catalog):
    """Every order: most by a customer about their requirement, the rest direct."""
    key, n = F.col("o_orderkey"), product_count(c)
    need = F.when(key % 4 != 3, F.col("o_custkey"))
    pick = (need * 7 + (key % 4 + 1) * 13) % n
    slug = F.concat(F.lit("p-"), F.when(need.isNull(), key % (n + 10)).otherwise(pick).cast("string"))
    return c.table("orders").select(
        key.alias("id"), need.alias("requirement_id"),
        F.when(key % 400 == 4, "other@y.example").when(key % 300 == 3, "not-an-address").otherwise(
            F.concat(F.lit("Buyer"), F.coalesce(need, key).cast("string"), F.lit("@x.example"))).alias("contact_email"),
        F.when(key % 4 != 0, F.concat(F.lit("Name "), key.cast("string"))).alias("contact_name"),
        F.when(key % 3 != 0, F.concat(F.lit("Org "), key.cast("string"))).alias("organization"),
        F.when(key % 7 == 0, "+1 555").alias("contact_phone"),
        F.when(key % 350 == 2, "Z1").when(key % 3 != 1, F.concat(F.lit("N"), (key % 25).cast("string"))).alias("country"),
        F.when(key % 4 == 0, "RENT").alias("preferred_transaction"), F.when(key % 5 == 3, F.concat(F.lit("note "), key.cast("string"))).alias("message"),
        F.when(key % 250 == 3, F.array(slug, F.lit("zzz"))).otherwise(F.array(slug, slug)).alias("product_slugs"),
    )


shared_view("m_submission", """
SELECT id, need AS requirement_id, CASE WHEN id % 400 = 4 THEN 'other@y.example' WHEN id % 300 = 3 THEN 'not-an-address' ELSE 'Buyer' || coalesce(need, id) || '@x.example' END AS email,
  CASE WHEN id % 4 <> 0 THEN 'Name ' || id END AS contact_name, CASE WHEN id % 3 <> 0 THEN 'Org ' || id END AS organization, CASE WHEN id % 7 = 0 THEN '+1 555' END AS phone,
  CASE WHEN id % 350 = 2 THEN 'Z1' WHEN id % 3 <> 1 THEN 'N' || (id % 25) END AS country, CASE WHEN id % 4 = 0 THEN 'RENT' END AS pref,
  CASE WHEN id % 5 = 3 THEN 'note ' || id END AS message, 'p-' || CASE WHEN need IS NULL THEN id % (n + 10) ELSE (need * 7 + (id % 4 + 1) * 13) % n END AS slug, id % 250 = 3 AS stray
FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 3 THEN o_custkey END AS need FROM orders) o, (SELECT count(*) AS n FROM part) u""")
shared_view("m_judged", """
SELECT s.*, r.id AS country_id, q.country_id AS own_country, q.preferred_transaction AS own_pref, CASE WHEN email = 'not-an-address' THEN 'contact_email is not valid'
  WHEN s.country IS NOT NULL AND r.id IS NULL THEN 'unknown country' WHEN requirement_id IS NOT NULL AND q.id IS NULL THEN 'requirement not found'
  WHEN requirement_id IS NOT NULL AND stray THEN 'selection outside the stored shortlist' WHEN requirement_id IS NULL AND stray THEN 'a direct capture names exactly one product'
  WHEN requirement_id IS NULL AND p.id IS NULL THEN 'unknown or unpublished product' END AS reason
FROM m_submission s LEFT JOIN m_region r ON r.code = s.country AND r.type = 'COUNTRY' LEFT JOIN m_requirement q ON q.id = s.requirement_id
LEFT JOIN m_product p ON p.slug = s.slug AND p.is_published""")
shared_view("m_accepted", """
SELECT * FROM (SELECT *, requirement_id IS NULL OR lower(email) = first_value(lower(email)) OVER (PARTITION BY requirement_id ORDER BY id) AS own FROM m_judged WHERE reason IS NULL) a""")
shared_view("m_lead", """
SELECT min(id) AS lead_id, requirement_id, arg_min(email, id) AS contact_email, arg_min(contact_name, id) AS contact_name, arg_min(organization, id) AS organization,
  arg_min(phone, id) AS contact_phone, arg_min(message, id) AS message, coalesce(arg_max(country_id, id), any_value(own_country)) AS country_id,
  coalesce(arg_max(pref, id), any_value(own_pref), 'UNKNOWN') AS preferred_transaction, count(*) AS submissions
FROM m_accepted WHERE own GROUP BY requirement_id, CASE WHEN requirement_id IS NULL THEN id END""")
shared_view("m_lead_product", """
SELECT l.lead_id, m.slug, m.product_id, m.rank, m.score, EXISTS (SELECT 1 FROM m_accepted a WHERE a.own AND a.requirement_id = l.requirement_id AND a.slug = m.slug) AS is_selected
FROM m_lead l JOIN m_stored m ON m.requirement_id = l.requirement_id
UNION ALL SELECT a.id, a.slug, p.id, NULL, NULL, true FROM m_accepted a JOIN m_product p ON p.slug = a.slug WHERE requirement_id IS NULL""")


def captured(c: Catalog):
    return ld.capture_leads(submissions(c), c.requirement, stored_matches(c), c.product, c.region)


@query("lead_capture", """
SELECT lead_id, 'lead' AS row_kind, concat_ws('|', contact_email, coalesce(contact_name, '?'), coalesce(organization, '?'), coalesce(contact_phone, '?'), coalesce(message, '?'),
  coalesce(CAST(country_id AS VARCHAR), '?'), preferred_transaction, CAST(submissions AS VARCHAR)) AS content FROM m_lead
UNION ALL SELECT lead_id, 'product', concat_ws('|', slug, coalesce(CAST(rank AS VARCHAR), '?'), coalesce(CAST(score AS VARCHAR), '?'), CAST(is_selected AS VARCHAR)) FROM m_lead_product
UNION ALL SELECT id, 'rejected', reason FROM m_judged WHERE reason IS NOT NULL
UNION ALL SELECT id, 'rejected', 'requirement is bound to another contact' FROM m_accepted WHERE NOT own""")
def _(c):
    leads, products, rejected = captured(c)
    join = lambda *cols: F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("?")) for x in cols]).alias("content")
    return (
        leads.select("lead_id", F.lit("lead").alias("row_kind"), join("contact_email", "contact_name", "organization", "contact_phone", "message", "country_id", "preferred_transaction", "submissions"))
        .unionByName(products.select("lead_id", F.lit("product").alias("row_kind"), join("slug", "rank", "score", "is_selected")))
        .unionByName(rejected.select(F.col("id").alias("lead_id"), F.lit("rejected").alias("row_kind"), F.col("reason").alias("content")))
    )


shared_view("m_route", """
SELECT DISTINCT q.id AS lead_id, a.provider_id, a.product_id FROM m_requirement q JOIN m_stored m ON m.requirement_id = q.id AND m.rank <= 2
JOIN m_availability a ON a.product_id = m.product_id AND a.is_current AND a.availability_status NOT IN ('NOT_AVAILABLE', 'DISCONTINUED')
JOIN m_provider v ON v.id = a.provider_id AND v.is_active AND v.accepts_leads
WHERE (q.preferred_transaction IN ('FLEXIBLE', 'UNKNOWN') OR a.transaction_type = CASE q.preferred_transaction WHEN 'RENT' THEN 'RENTAL' WHEN 'BUY' THEN 'PURCHASE' ELSE q.preferred_transaction END)
  AND (q.country_id IS NULL OR a.region_id IS NULL OR a.region_id IN (SELECT applicable_id FROM m_applicable z WHERE z.region_id = q.country_id))""")


def routes(c: Catalog):
    leads = c.requirement.select(F.col("id").alias("lead_id"), "country_id", "preferred_transaction")
    picked = stored_matches(c).select(F.col("requirement_id").alias("lead_id"), "product_id", (F.col("rank") <= 2).alias("is_selected"))
    return ld.lead_routes(leads, picked, c.availability, c.provider, applicable(c))


@query("lead_routes", "SELECT lead_id, provider_id, product_id FROM m_route")
def _(c):
    return routes(c)


@query("reconcile_routes", """
WITH h AS (SELECT lead_id, CASE WHEN (lead_id + provider_id) % 4 = 0 THEN provider_id + 100000 ELSE provider_id END AS provider_id, product_id,
    (['PENDING', 'CONTACTED', 'DECLINED'])[provider_id % 3 + 1] AS status FROM m_route WHERE (lead_id + provider_id) % 2 = 0)
SELECT lead_id, provider_id, product_id, CASE WHEN h.status IS NULL THEN 'add' WHEN h.status = 'PENDING' AND d.w IS NULL THEN 'remove' ELSE 'keep' END AS action,
  coalesce(h.status, 'PENDING') AS status
FROM (SELECT *, 1 AS w FROM m_route) d FULL OUTER JOIN h USING (lead_id, provider_id, product_id)""")
def _(c):
    desired = routes(c)
    mark = F.col("lead_id") + F.col("provider_id")
    status = F.get(F.array(F.lit("PENDING"), F.lit("CONTACTED"), F.lit("DECLINED")), (F.col("provider_id") % 3).cast("int"))
    present = desired.filter(mark % 2 == 0).select(
        "lead_id", F.when(mark % 4 == 0, F.col("provider_id") + 100000).otherwise(F.col("provider_id")).alias("provider_id"), "product_id", status.alias("status")
    )
    return ld.reconcile_routes(desired, present)


@query("lead_digest", """
WITH t AS (SELECT x.*, coalesce(p.name, 'UNKNOWN') || ' (' || x.slug || ')' AS label FROM m_lead_product x LEFT JOIN m_product p ON p.slug = x.slug)
SELECT l.lead_id, CASE WHEN submissions > 1 THEN 'UPDATED' ELSE 'NEW' END AS event,
  coalesce(organization, split_part(contact_email, '@', 2), r.code, 'UNKNOWN') AS subject, coalesce(r.code, 'UNKNOWN') AS country, preferred_transaction,
  coalesce((SELECT string_agg(label, ' / ' ORDER BY label) FROM t WHERE t.lead_id = l.lead_id AND is_selected), '') AS interest,
  (SELECT string_agg(label || ' — rank: ' || coalesce(CAST(rank AS VARCHAR), 'UNKNOWN') || ', score: ' || coalesce(CAST(score AS VARCHAR), 'UNKNOWN') || ', selected: '
    || CASE WHEN is_selected THEN 'YES' ELSE 'NO' END, ' / ' ORDER BY rank, slug) FROM t WHERE t.lead_id = l.lead_id) AS shortlist
FROM m_lead l LEFT JOIN m_region r ON r.id = l.country_id""")
def _(c):
    leads, products, _ = captured(c)
    joined = lambda name: F.array_join(name, " / ").alias(name)
    return ld.lead_digest(leads, products, c.product, c.region).select(
        "lead_id", "event", "subject", "country", "preferred_transaction", joined("interest"), joined("shortlist")
    )
