"""Queries of the side-by-side comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as cmp
from .offers import snapshot_of
from .registry import query, shared_view

_FIELDS = [(g, f) for g, fs in cmp.COMPARE_FIELDS.items() for f in fs]
_NUMERIC = set(cmp.HIGHER_LEADS + cmp.NUMERIC_ONLY)
shared_view("m_valid_set", "SELECT * FROM m_compare_set WHERE set_id IN (SELECT set_id FROM m_compare_set GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4)")
shared_view("m_cell", "\nUNION ALL ".join(
    f"SELECT s.set_id, s.slug, s.position, '{g}' AS field_group, '{f}' AS key, CAST(p.{f} AS VARCHAR) AS value, "
    f"{f'CAST(p.{f} AS DOUBLE)' if f in _NUMERIC else 'CAST(NULL AS DOUBLE)'} AS number FROM m_valid_set s JOIN m_product p ON p.slug = s.slug"
    for g, f in _FIELDS))
shared_view("m_headline_web", """
SELECT s.set_id, s.slug, s.position, h.transaction_type, h.currency, h.billing_period, h.price_type,
  CASE WHEN h.price_type IN ('PUBLIC', 'FROM', 'ESTIMATED') THEN h.price END AS amount
FROM m_valid_set s JOIN m_product p ON p.slug = s.slug
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN transaction_type = 'PURCHASE' THEN 0 ELSE 1 END,
    list_position(['PUBLIC', 'FROM', 'ESTIMATED', 'RANGE', 'QUOTE_ONLY'], price_type), id) AS rn FROM m_pricing WHERE is_current) h
  ON h.product_id = p.id AND h.rn = 1""")


@query("compare_matrix", """
SELECT set_id, field_group, key, string_agg(slug || '=' || coalesce(value, '?'), '|' ORDER BY position) AS cells FROM m_cell GROUP BY 1, 2, 3""")
def _(c):
    text = F.transform("values", lambda v: F.concat(v["slug"], F.lit("="), F.coalesce(v["value"], F.lit("?"))))
    return cmp.compare_matrix(c.compare_set, c.product).select("set_id", "field_group", "key", F.array_join(text, "|").alias("cells"))


@query("best_in_row", f"""
SELECT set_id, key, slug FROM (SELECT *, max(number) OVER (PARTITION BY set_id, key) AS top, count(number) OVER (PARTITION BY set_id, key) AS n
  FROM m_cell WHERE key IN ({', '.join(f"'{f}'" for f in cmp.HIGHER_LEADS)})) x WHERE n >= 2 AND number = top""")
def _(c):
    return cmp.best_in_row(cmp.compare_cells(c.compare_set, c.product))


@query("metric_delta", f"""
SELECT a.set_id, a.key, a.slug, CASE WHEN a.slug = b.slug THEN 'self' WHEN a.key NOT IN ({', '.join(f"'{f}'" for f in sorted(_NUMERIC))}) THEN 'incomparable'
    WHEN a.number IS NULL OR b.number IS NULL THEN 'unknown' ELSE 'numeric' END AS kind,
  CASE WHEN a.slug <> b.slug THEN CAST(a.number - b.number AS DECIMAL(12,2)) END AS delta
FROM m_cell a JOIN m_cell b ON b.set_id = a.set_id AND b.key = a.key AND b.position = 2""")
def _(c):
    rows = cmp.metric_delta(cmp.compare_cells(c.compare_set, c.product), F.lit(2))
    return rows.select("set_id", "key", "slug", "kind", "delta")


@query("price_leader", """
WITH g AS (SELECT set_id, count(*) AS n, bool_or(price_type IS NULL) AS unknown, bool_or(amount IS NULL) AS opened,
    count(DISTINCT concat_ws('|', transaction_type, currency, billing_period, price_type)) AS kinds, min(amount) AS low FROM m_headline_web GROUP BY 1),
r AS (SELECT *, CASE WHEN n < 2 THEN 'NEED_AT_LEAST_TWO' WHEN unknown THEN 'UNKNOWN_PRICE_PRESENT' WHEN opened THEN 'NON_NUMERIC_OFFER_PRESENT'
    WHEN kinds > 1 THEN 'MIXED_OFFER_SEMANTICS' ELSE 'LOWEST_COMPARABLE_PRICE' END AS reason FROM g)
SELECT r.set_id, r.reason, coalesce(CASE WHEN reason = 'LOWEST_COMPARABLE_PRICE' THEN
    (SELECT string_agg(h.slug, '|' ORDER BY h.slug) FROM m_headline_web h WHERE h.set_id = r.set_id AND h.amount = r.low) END, '') AS winners FROM r""")
def _(c):
    rows = cmp.price_leader(cmp.valid_sets(c.compare_set), c.pricing, c.product)
    return rows.withColumn("winners", F.array_join("winners", "|"))


@query("price_delta", """
SELECT a.set_id, a.slug, CASE WHEN a.slug = b.slug THEN 'self' WHEN like_for_like THEN 'numeric' ELSE 'incomparable' END AS kind,
  CASE WHEN a.slug <> b.slug AND like_for_like THEN CAST(a.amount - b.amount AS DECIMAL(14,2)) END AS delta
FROM m_headline_web a JOIN m_headline_web b ON b.set_id = a.set_id AND b.position = 2,
LATERAL (SELECT coalesce(a.amount IS NOT NULL AND b.amount IS NOT NULL AND a.transaction_type = b.transaction_type AND a.currency = b.currency
    AND a.billing_period = b.billing_period AND a.price_type = b.price_type, false) AS like_for_like) l""")
def _(c):
    return cmp.price_delta(cmp.valid_sets(c.compare_set), c.pricing, c.product, F.lit(2))


@query("deployment_leader", """
WITH x AS (SELECT s.set_id, s.slug, n.deployment_count, max(n.deployment_count) OVER (PARTITION BY s.set_id) AS top FROM m_valid_set s JOIN m_snapshot n ON n.slug = s.slug)
SELECT set_id, min(slug) AS slug, max(top) AS deployment_count FROM x WHERE top > 0 AND deployment_count = top GROUP BY set_id HAVING count(*) = 1""")
def _(c):
    return cmp.deployment_leader(cmp.valid_sets(c.compare_set), snapshot_of(c))
