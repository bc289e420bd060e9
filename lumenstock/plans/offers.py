"""Queries over regions, offers and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import comparable_amount
from ..operators import offers, regions, snapshot
from ..sources.catalog import Catalog
from .registry import query, shared_view

CEILING, CURRENCY = 20000, "USD"

shared_view("m_closure", """
SELECT id AS region_id, id AS ancestor_id, 0 AS depth FROM m_region
UNION ALL
SELECT c.region_id, r.parent_id, c.depth + 1 FROM m_closure c JOIN m_region r ON r.id = c.ancestor_id
WHERE r.parent_id IS NOT NULL""")
shared_view("m_applicable", """
SELECT c.region_id, r.code, c.ancestor_id AS applicable_id FROM m_closure c JOIN m_region r ON r.id = c.region_id
UNION
SELECT r.id, r.code, g.id FROM m_region r, m_region g WHERE g.code = 'GLOBAL'""")
shared_view("m_offer", """
SELECT id, product_id, variant_id, provider_id, region_id, transaction_type, availability_status, available_from, is_current,
    pricing_offer_id, price, price_min, price_max, currency, billing_period, price_type, price_provider_id, price_region_id
FROM (
  SELECT a.*, p.id AS pricing_offer_id, p.price, p.price_min, p.price_max, p.currency, p.billing_period, p.price_type,
    p.provider_id AS price_provider_id, p.region_id AS price_region_id,
    row_number() OVER (PARTITION BY a.id ORDER BY
      CASE WHEN p.provider_id IS NOT NULL THEN 0 ELSE 1 END,
      CASE WHEN p.region_id = a.region_id THEN 0 WHEN p.region_id = r.parent_id THEN 1
           WHEN p.region_id = 0 THEN 2 ELSE 3 END,
      CASE WHEN p.variant_id IS NOT NULL THEN 0 ELSE 1 END,
      p.updated_at DESC NULLS LAST, p.id) AS rn
  FROM m_availability a LEFT JOIN m_region r ON r.id = a.region_id
  LEFT JOIN m_pricing p ON p.product_id = a.product_id AND p.is_current AND p.transaction_type = a.transaction_type
    AND (p.variant_id = a.variant_id OR p.variant_id IS NULL)
    AND (p.provider_id = a.provider_id OR p.provider_id IS NULL)
    AND (p.region_id = a.region_id OR p.region_id = r.parent_id OR p.region_id = 0 OR p.region_id IS NULL)
) x WHERE rn = 1""")
shared_view("m_snapshot", """
SELECT p.id, p.slug, p.name, p.commercial_status AS maturity,
    a.modes IS NOT NULL AS is_obtainable, coalesce(d.n, 0) AS deployment_count, d.value AS contracted_value,
    coalesce(a.modes, []) AS modes
FROM m_product p
LEFT JOIN (SELECT product_id, list_sort(list(DISTINCT transaction_type)) AS modes FROM m_availability
           WHERE is_current AND availability_status NOT IN ('NOT_AVAILABLE', 'DISCONTINUED') GROUP BY product_id) a ON a.product_id = p.id
LEFT JOIN (SELECT product_id, count(*) AS n, sum(contract_value) AS value FROM m_deployment GROUP BY product_id) d ON d.product_id = p.id""")
shared_view("m_headline", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY
    CASE transaction_type WHEN 'PURCHASE' THEN 0 WHEN 'DEVELOPER' THEN 1 ELSE 9 END,
    CASE price_type WHEN 'PUBLIC' THEN 0 WHEN 'FROM' THEN 1 WHEN 'ESTIMATED' THEN 2 WHEN 'RANGE' THEN 3 WHEN 'QUOTE_ONLY' THEN 4 ELSE 9 END,
    updated_at DESC, id) AS rn FROM m_pricing WHERE is_current) h WHERE rn = 1""")


def applicable(c: Catalog):
    return regions.applicable_regions(regions.region_closure(c.region), c.region)


def commercial(c: Catalog):
    return offers.commercial_offer(c.availability, c.pricing, c.region)


def snapshot_of(c: Catalog):
    return snapshot.commercial_snapshot(c.product, c.availability, c.deployment)


@query("regions_by_type", "SELECT code, type, name FROM m_region WHERE type = 'COUNTRY'")
def _(c):
    return regions.regions_by_type(c.region, "COUNTRY")


@query("region_closure", "SELECT region_id, ancestor_id, depth FROM m_closure")
def _(c):
    return regions.region_closure(c.region)


@query("applicable_regions", "SELECT region_id, code, applicable_id FROM m_applicable")
def _(c):
    return applicable(c)


@query("commercial_offer", "SELECT * FROM m_offer")
def _(c):
    return commercial(c)


@query("vertical_offers", """
SELECT 'rental' AS vertical, id, pricing_offer_id FROM m_offer WHERE transaction_type IN ('RENTAL', 'SUBSCRIPTION')
UNION ALL SELECT 'purchase', id, pricing_offer_id FROM m_offer WHERE transaction_type IN ('PURCHASE', 'DEVELOPER')
UNION ALL SELECT 'lease', id, pricing_offer_id FROM m_offer WHERE transaction_type IN ('LEASE', 'RAAS')""")
def _(c):
    joined = commercial(c)
    vertical = None
    for name, kinds in offers.VERTICALS.items():
        cond = F.col("transaction_type").isin(kinds)
        vertical = F.when(cond, name) if vertical is None else vertical.when(cond, name)
    return joined.select(vertical.alias("vertical"), "id", "pricing_offer_id").filter("vertical IS NOT NULL")


@query("comparable_amount", """
SELECT id, CASE WHEN price_type IN ('PUBLIC', 'FROM', 'ESTIMATED') THEN price WHEN price_type = 'RANGE' THEN price_max END AS amount
FROM m_pricing""")
def _(c):
    return c.pricing.select("id", comparable_amount().alias("amount"))


_QUALIFYING = f"""m_pricing x WHERE x.is_current AND x.transaction_type = 'PURCHASE' AND x.currency = '{CURRENCY}'"""
_AMOUNT = "CASE WHEN x.price_type IN ('PUBLIC', 'FROM', 'ESTIMATED') THEN x.price WHEN x.price_type = 'RANGE' THEN x.price_max END"


@query("price_ceiling", f"""
SELECT p.id, p.slug FROM m_product p WHERE p.is_published AND EXISTS
    (SELECT 1 FROM {_QUALIFYING} AND x.product_id = p.id AND {_AMOUNT} <= {CEILING})""")
def _(c):
    return offers.under_ceiling(c.product.filter("is_published"), c.pricing, CEILING, CURRENCY).select("id", "slug")


_LOWEST = f"SELECT x.product_id, min({_AMOUNT}) AS amount FROM {_QUALIFYING} GROUP BY x.product_id"


@query("price_comparability", f"""
SELECT p.id, CASE WHEN amount IS NULL THEN 'unprovable' WHEN amount <= {CEILING} THEN 'qualifies' ELSE 'above_limit' END AS comparability, amount
FROM m_product p LEFT JOIN ({_LOWEST}) l ON l.product_id = p.id WHERE p.is_published""")
def _(c):
    rows = offers.price_comparability(c.product.filter("is_published"), c.pricing, CEILING, CURRENCY)
    return rows.select("id", "comparability", "amount")


@query("ceiling_flags", f"""
SELECT coalesce(bool_or(amount IS NOT NULL AND amount > {CEILING}), false) AS above_limit,
    coalesce(bool_or(amount IS NULL), false) AS unprovable
FROM m_product p LEFT JOIN ({_LOWEST}) l ON l.product_id = p.id WHERE p.is_published""")
def _(c):
    return offers.ceiling_flags(c.product.filter("is_published"), c.pricing, CEILING, CURRENCY)


@query("lowest_price_cache", """
SELECT product_id, price AS lowest_purchase_price, currency AS lowest_price_currency FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, currency) AS rn FROM m_pricing
  WHERE is_current AND transaction_type = 'PURCHASE' AND price_type IN ('PUBLIC', 'FROM')) x WHERE rn = 1""")
def _(c):
    return offers.lowest_price(c.pricing)


@query("headline_price", """
SELECT product_id, id AS pricing_id, transaction_type, price, price_min, price_max, currency, billing_period, price_type FROM m_headline""")
def _(c):
    return offers.headline_price(c.pricing)


_STATUS_ORDER = """CASE availability_status WHEN 'NOT_AVAILABLE' THEN 0 WHEN 'WAITLIST' THEN 1 WHEN 'PREORDER' THEN 2
    WHEN 'LIMITED' THEN 3 WHEN 'AVAILABLE' THEN 4 WHEN 'ON_REQUEST' THEN 5 WHEN 'DISCONTINUED' THEN 6 END"""


@query("representative_availability", f"""
SELECT product_id, transaction_type, availability_status FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, transaction_type ORDER BY
    CASE WHEN availability_status NOT IN ('NOT_AVAILABLE', 'DISCONTINUED') THEN 0 ELSE 1 END, {_STATUS_ORDER}, id) AS rn
  FROM m_availability WHERE is_current) x WHERE rn = 1
UNION ALL
SELECT product_id, 'ANY', availability_status FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY
    CASE WHEN availability_status NOT IN ('NOT_AVAILABLE', 'DISCONTINUED') THEN 0 ELSE 1 END, {_STATUS_ORDER}, id) AS rn
  FROM m_availability WHERE is_current) x WHERE rn = 1""")
def _(c):
    per_mode = offers.representative_availability(c.availability, by_mode=True)
    overall = offers.representative_availability(c.availability).withColumn("transaction_type", F.lit("ANY"))
    return per_mode.unionByName(overall)


@query("commercial_snapshot", """
SELECT id, slug, name, maturity, is_obtainable, deployment_count, contracted_value, array_to_string(modes, '|') AS available_modes FROM m_snapshot""")
def _(c):
    return snapshot_of(c).withColumn("available_modes", F.array_join("available_modes", "|"))


@query("market_snapshot", """
SELECT (SELECT count(*) FROM m_product) AS total_tracked,
  (SELECT count(*) FROM m_product WHERE is_published) AS total_published,
  (SELECT count(*) FROM m_snapshot s JOIN m_product p ON p.id = s.id AND p.is_published WHERE s.is_obtainable) AS commercially_accessible,
  (SELECT count(*) FROM m_product p WHERE is_published AND (commercial_status IN ('PILOT', 'RAAS_DEPLOYMENT')
      OR EXISTS (SELECT 1 FROM m_deployment d WHERE d.product_id = p.id))) AS in_deployment_or_pilot,
  (SELECT count(*) FROM m_manufacturer) AS manufacturers_tracked,
  (SELECT count(DISTINCT manufacturer_slug) FROM m_product WHERE is_published) AS manufacturers_published,
  EXISTS (SELECT 1 FROM m_availability a JOIN m_product p ON p.id = a.product_id WHERE p.is_published AND a.is_current
      AND a.transaction_type IN ('RENTAL', 'SUBSCRIPTION') AND a.availability_status NOT IN ('NOT_AVAILABLE', 'DISCONTINUED')) AS rental_offers_present,
  (SELECT max(observed_at) FROM m_evidence) AS latest_observed_at""")
def _(c):
    return snapshot.market_snapshot(c.product, c.availability, c.deployment, c.manufacturer, c.evidence)


@query("maker_coverage", """
SELECT m.slug, count(p.id) AS tracked, count(p.id) FILTER (WHERE p.is_published) AS published
FROM m_manufacturer m LEFT JOIN m_product p ON p.manufacturer_slug = m.slug GROUP BY m.slug""")
def _(c):
    return snapshot.maker_coverage(c.manufacturer, c.product)


@query("portfolio_status", """
WITH ranked AS (
  SELECT manufacturer_slug AS slug, commercial_status, coalesce(list_position(['ANNOUNCED','DEVELOPMENT','PROTOTYPE','PILOT','EARLY_ACCESS',
    'LIMITED_COMMERCIAL','COMMERCIAL','RAAS_DEPLOYMENT'], commercial_status), 0) AS o FROM m_product WHERE is_published)
SELECT m.slug, CASE WHEN count(r.slug) = 0 THEN NULL WHEN bool_and(r.commercial_status = 'DISCONTINUED') THEN 'DISCONTINUED'
  ELSE arg_max(r.commercial_status, r.o) FILTER (WHERE r.commercial_status <> 'DISCONTINUED') END AS portfolio_status
FROM m_manufacturer m LEFT JOIN ranked r ON r.slug = m.slug GROUP BY m.slug""")
def _(c):
    return snapshot.portfolio_status(c.manufacturer, c.product)


@query("use_case_counts", """
SELECT u.slug, count(DISTINCT p.id) AS product_count FROM m_use_case u LEFT JOIN m_fit f ON f.use_case = u.slug
LEFT JOIN m_product p ON p.id = f.product_id AND p.is_published GROUP BY u.slug""")
def _(c):
    return snapshot.use_case_counts(c.use_case, c.fit, c.product)


_ELIGIBLE = """(identity_status = 'VERIFIED' AND rights_status <> 'RESTRICTED'
    AND (rights_status IN ('PERMITTED', 'ATTRIBUTION_REQUIRED') OR usage_basis = 'OFFICIAL_MANUFACTURER_MEDIA')
    AND (rights_status <> 'ATTRIBUTION_REQUIRED' OR trim(coalesce(attribution, '')) <> ''))"""
shared_view("m_shown_image", f"SELECT * FROM m_image WHERE {_ELIGIBLE}")


@query("catalogue_summary", """
SELECT 'products' AS part, count(*) AS stored, count(*) FILTER (WHERE is_published) AS displayed FROM m_product
UNION ALL SELECT 'pricing_offers', count(*), count(*) FILTER (WHERE is_current) FROM m_pricing
UNION ALL SELECT 'availability_offers', count(*), count(*) FILTER (WHERE is_current) FROM m_availability
UNION ALL SELECT 'deployments', count(*), count(*) FROM m_deployment
UNION ALL SELECT 'evidence', count(*), count(*) FILTER (WHERE confidence = 'VERIFIED') FROM m_evidence
UNION ALL SELECT 'images', count(*), (SELECT count(*) FROM m_shown_image) FROM m_image""")
def _(c):
    return snapshot.catalogue_state(c.product, c.pricing, c.availability, c.deployment, c.evidence, c.image)
