"""Queries over catalogue search, pages, evidence and imagery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text, vocab
from ..functions.rules import radar_eligible
from ..operators import evidence as ev
from ..operators import images as img
from ..operators import offers as money
from ..operators import fulltext, reads, search
from ..operators.search import Filters
from ..operators.specifications import typed_values
from ..sources.catalog import Catalog
from .offers import applicable, snapshot_of
from .registry import query, shared_view
from .text_sql import holds


def search_model(c: Catalog, with_text: bool = False) -> dict:
    return {
        "products": c.product, "fits": c.fit, "availability": c.availability, "pricing": c.pricing,
        "applicable": applicable(c), "text_index": text_index(c) if with_text else None,
    }


def text_index(c: Catalog) -> DataFrame:
    return fulltext.stored_index(fulltext.field_texts(c.product, c.description))


def _live(c):
    return c.product.filter("is_published")


# ---- filters ------------------------------------------------------------------------------

@query("filter_fulltext", f"SELECT id FROM m_product p WHERE is_published AND {holds('economi', 'bolt')}")
def _(c):
    return search.match_text(_live(c), "The economies of a BOLT", text_index(c)).select("id")


@query("text_index", "SELECT lexeme, product_id, weight FROM m_text_index")
def _(c):
    return text_index(c)


@query("filter_manufacturer", "SELECT id FROM m_product WHERE is_published AND manufacturer_slug = 'Brand#7'")
def _(c):
    return search.by_manufacturer(_live(c), "Brand#7").select("id")


@query("filter_status", "SELECT id FROM m_product WHERE is_published AND commercial_status IN ('PILOT', 'COMMERCIAL')")
def _(c):
    return search.by_status(_live(c), ["PILOT", "COMMERCIAL"]).select("id")


@query("filter_use_case", """
SELECT id FROM m_product p WHERE is_published AND EXISTS (SELECT 1 FROM m_fit f WHERE f.product_id = p.id AND f.use_case = 'MACHINERY')""")
def _(c):
    return search.by_use_case(_live(c), c.fit, "MACHINERY").select("id")


@query("filter_bounds", """
SELECT id FROM m_product WHERE is_published AND payload_kg >= 12 AND height_cm >= 120 AND height_cm <= 190 AND mobility = 'WHEELED'""")
def _(c):
    wanted = Filters(payload_min=12, height_min=120, height_max=190, mobility="WHEELED")
    return search.by_facts(_live(c), wanted).select("id")


@query("filter_autonomy_min", """
SELECT id FROM m_product WHERE is_published AND autonomy IN ('SUPERVISED_AUTONOMY', 'TASK_AUTONOMOUS', 'HIGHLY_AUTONOMOUS')""")
def _(c):
    return search.by_facts(_live(c), Filters(autonomy_min="SUPERVISED_AUTONOMY")).select("id")


@query("filter_flags", "SELECT id FROM m_product WHERE is_published AND has_sdk IS TRUE AND has_manipulation IS FALSE")
def _(c):
    return search.by_facts(_live(c), Filters(has_sdk=True, has_manipulation=False)).select("id")


_OPEN = "a.is_current AND a.availability_status NOT IN ('NOT_AVAILABLE', 'DISCONTINUED')"


@query("filter_availability", f"""
SELECT id FROM m_product p WHERE is_published AND EXISTS (
  SELECT 1 FROM m_availability a WHERE a.product_id = p.id AND {_OPEN} AND a.transaction_type IN ('RENTAL', 'RAAS')
    AND a.availability_status IN ('AVAILABLE', 'LIMITED')
    AND (a.region_id IS NULL OR a.region_id IN (SELECT applicable_id FROM m_applicable WHERE code = 'N7')))""")
def _(c):
    regions = applicable(c).filter(F.col("code") == "N7")
    return search.by_availability(_live(c), c.availability, ["RENTAL", "RAAS"], ["AVAILABLE", "LIMITED"], regions).select("id")


RELAXED = Filters(
    payload_min=20, autonomy_min="ASSISTED", has_sdk=True, commercial_status=["PILOT", "COMMERCIAL", "EARLY_ACCESS"],
    transaction_type=["PURCHASE", "RENTAL"],
)
_RELAXED_BASE = f"""m_product p WHERE is_published AND commercial_status IN ('PILOT', 'COMMERCIAL', 'EARLY_ACCESS')
  AND EXISTS (SELECT 1 FROM m_availability a WHERE a.product_id = p.id AND {_OPEN} AND a.transaction_type IN ('PURCHASE', 'RENTAL'))"""
_LEVELS = "('ASSISTED', 'SUPERVISED_AUTONOMY', 'TASK_AUTONOMOUS', 'HIGHLY_AUTONOMOUS')"


@query("unknown_excluded", f"""
SELECT id FROM {_RELAXED_BASE}
  AND (payload_kg >= 20 OR payload_kg IS NULL) AND (autonomy IN {_LEVELS} OR autonomy IS NULL) AND (has_sdk OR has_sdk IS NULL)
  AND (payload_kg IS NULL OR autonomy IS NULL OR has_sdk IS NULL)""")
def _(c):
    return search.unknown_excluded(search_model(c), RELAXED).select("id")


def _requests(c: Catalog) -> DataFrame:
    """Search requests read off the event log's numbers."""
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at % len(values))
    return c.event.select(
        F.col("id"),
        F.array(pick(vocab.COMMERCIAL_STATUS + ["SOLD_OUT"], k), pick(vocab.COMMERCIAL_STATUS, k + 1)).alias("commercial_status"),
        F.array(pick(vocab.TRANSACTION_TYPE + ["BARTER"], k + 3)).alias("transaction_type"),
        F.array(pick(vocab.AVAILABILITY_STATUS, k)).alias("availability_status"),
        pick(vocab.MOBILITY + ["FLYING"], k).alias("mobility"),
        F.when(k % 4 != 0, pick(vocab.AUTONOMY, k)).alias("autonomy_min"),
        pick(["name", "-price", "payload", "-newest", "rating"], k).alias("sort"),
        F.when(k % 6 == 0, F.lit(20000)).alias("price_max"),
        F.when((k % 6 == 0) & (k % 12 != 0) | (k % 7 == 1), "USD").alias("price_currency"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_REQUESTS_SQL = f"""
SELECT id, k,
  {_sql_list(vocab.COMMERCIAL_STATUS + ['SOLD_OUT'])}[k % 11 + 1] AS s1, {_sql_list(vocab.TRANSACTION_TYPE + ['BARTER'])}[(k + 3) % 9 + 1] AS t1,
  {_sql_list(vocab.MOBILITY + ['FLYING'])}[k % 7 + 1] AS mobility, ['name', '-price', 'payload', '-newest', 'rating'][k % 5 + 1] AS sort,
  k % 6 = 0 AS has_max, (k % 6 = 0 AND k % 12 <> 0) OR k % 7 = 1 AS has_currency
FROM (SELECT id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM m_event) e"""


@query("validate_requests", f"""
SELECT id, array_to_string(list_sort(list_filter([
    CASE WHEN s1 = 'SOLD_OUT' THEN 'invalid_commercial_status' END, CASE WHEN t1 = 'BARTER' THEN 'invalid_transaction_type' END,
    CASE WHEN mobility = 'FLYING' THEN 'invalid_mobility' END, CASE WHEN sort = 'rating' THEN 'invalid_sort' END,
    CASE WHEN has_max <> has_currency THEN 'unpaired_price' END], lambda r: r IS NOT NULL)), '|') AS reasons
FROM ({_REQUESTS_SQL}) r
WHERE s1 = 'SOLD_OUT' OR t1 = 'BARTER' OR mobility = 'FLYING' OR sort = 'rating' OR has_max <> has_currency""")
def _(c):
    _, rejected = search.validate_requests(_requests(c))
    return rejected.select("id", F.array_join("reasons", "|").alias("reasons"))


# ---- search -------------------------------------------------------------------------------

ENVELOPE = Filters(
    q="units for the brand", payload_min=10, has_sdk=True, region="N7", transaction_type=["PURCHASE", "RENTAL"], price_max=60000, price_currency="USD",
)
_ENVELOPE_BASE = f"""m_product p WHERE is_published AND {holds("unit", "brand")} AND EXISTS (
  SELECT 1 FROM m_availability a WHERE a.product_id = p.id AND {_OPEN} AND a.transaction_type IN ('PURCHASE', 'RENTAL')
    AND (a.region_id IS NULL OR a.region_id IN (SELECT applicable_id FROM m_applicable WHERE code = 'N7')))"""


@query("search_envelope", f"""
WITH low AS (SELECT product_id, min(CASE WHEN price_type = 'RANGE' THEN price_max ELSE price END) AS amount FROM m_pricing
    WHERE is_current AND transaction_type = 'PURCHASE' AND currency = 'USD' GROUP BY product_id),
base AS (SELECT p.*, l.amount FROM {_ENVELOPE_BASE.replace("m_product p WHERE", "m_product p LEFT JOIN low l ON l.product_id = p.id WHERE")}),
pool AS (SELECT * FROM base WHERE payload_kg >= 10 AND has_sdk),
found AS (SELECT * FROM pool WHERE amount <= 60000),
shown AS (SELECT slug, row_number() OVER (ORDER BY payload_kg DESC NULLS LAST, slug) AS rn FROM found)
SELECT (SELECT count(*) FROM found) AS total,
  (SELECT string_agg(slug, '|' ORDER BY rn) FROM shown WHERE rn > 2 AND rn <= 12) AS page,
  array_to_string(list_sort(list_filter([
    CASE WHEN EXISTS (SELECT 1 FROM base WHERE (payload_kg >= 10 OR payload_kg IS NULL) AND (has_sdk OR has_sdk IS NULL)
        AND (payload_kg IS NULL OR has_sdk IS NULL) AND amount <= 60000) THEN 'hard_constraint_excluded_unknown' END,
    CASE WHEN EXISTS (SELECT 1 FROM pool WHERE amount > 60000) THEN 'price_max_excluded_above_limit' END,
    CASE WHEN EXISTS (SELECT 1 FROM pool WHERE amount IS NULL) THEN 'price_max_excluded_unprovable' END],
    lambda w: w IS NOT NULL)), '|') AS warnings""")
def _(c):
    shown, totals = search.search(search_model(c, with_text=True), ENVELOPE, "-payload", limit=10, offset=2)
    # The page has at most 100 rows by contract; it is folded into one text for comparison.
    order = F.struct(-F.coalesce(F.col("payload_kg").cast("double"), F.lit(-1.0)), "slug")
    folded = shown.select(order.alias("o")).agg(F.array_sort(F.collect_list("o")).alias("rows"))
    listed = folded.select(F.array_join(F.transform("rows", lambda r: r["slug"]), "|").alias("page"))
    both = totals.unionByName(listed, allowMissingColumns=True)
    return both.agg(F.max("total").alias("total"), F.max("page").alias("page"), F.array_join(F.max("warnings"), "|").alias("warnings"))


_SORTED = {"name": "name", "price": "lowest_purchase_price", "payload": "payload_kg", "newest": "created_on"}
_ALL_KEYS = [(sign + name, f"{column} {'DESC' if sign else 'ASC'} NULLS LAST") for name, column in _SORTED.items() for sign in ("", "-")]


@query("sorted_catalogue", f"""
WITH low AS (SELECT product_id, min(price) AS lowest_purchase_price FROM m_pricing
    WHERE is_current AND transaction_type = 'PURCHASE' AND price_type IN ('PUBLIC', 'FROM') GROUP BY product_id),
live AS (SELECT p.*, lowest_purchase_price FROM m_product p LEFT JOIN low ON product_id = p.id WHERE is_published)
{" UNION ALL ".join(f"SELECT '{key}' AS sort, id, row_number() OVER (ORDER BY {order}, slug) AS rank FROM live" for key, order in _ALL_KEYS)}""")
def _(c):
    """Every sort key both ways."""
    lowest = money.lowest_price(c.pricing).select(F.col("product_id").alias("id"), "lowest_purchase_price")
    live = _live(c).join(lowest, "id", "left").select("id", "slug", "name", "payload_kg", "created_on", "lowest_purchase_price")
    ranked = [search.sort_catalogue(live, key).select(F.lit(key).alias("sort"), "id", "rank") for key, _ in _ALL_KEYS]
    return reduce(DataFrame.unionByName, ranked)


@query("page", """
SELECT id, slug FROM m_product WHERE is_published ORDER BY created_on DESC NULLS LAST, slug LIMIT 24 OFFSET 48""")
def _(c):
    return search.page(_live(c), search.order_by("-newest"), 24, 48).select("id", "slug")


@query("price_sorted", """
SELECT p.id, amount, row_number() OVER (ORDER BY amount, slug) AS rank FROM m_product p JOIN (
  SELECT product_id, min(CASE WHEN price_type = 'RANGE' THEN price_max ELSE price END) AS amount FROM m_pricing
  WHERE is_current AND transaction_type = 'PURCHASE' AND currency = 'EUR' AND price_type <> 'QUOTE_ONLY' GROUP BY product_id) l
ON l.product_id = p.id WHERE is_published""")
def _(c):
    return search.price_sorted(_live(c), c.pricing, "EUR").select("id", "amount", "rank")


@query("top_obtainable", """
SELECT p.id, p.slug FROM m_product p JOIN m_snapshot s ON s.id = p.id
WHERE p.is_published AND s.is_obtainable ORDER BY p.name, p.slug LIMIT 4""")
def _(c):
    return search.top_obtainable(c.product, snapshot_of(c)).select("id", "slug")


@query("dedupe_slugs", """
SELECT id, array_to_string(list_filter([a, CASE WHEN b <> a THEN b END], lambda x: x IS NOT NULL), '|') AS slugs
FROM (SELECT id, event_type AS a, CASE WHEN client % 2 = 0 THEN event_type ELSE 'p-' || client END AS b FROM m_event) e""")
def _(c):
    other = F.when(F.col("client") % 2 == 0, F.col("event_type")).otherwise(F.concat(F.lit("p-"), F.col("client").cast("string")))
    raw = F.concat(F.lit(" , "), "event_type", F.lit(","), other, F.lit(" ,"), "event_type", F.lit(",,"))
    return c.event.select("id", F.array_join(search.distinct_in_order(raw), "|").alias("slugs"))


# ---- imagery ------------------------------------------------------------------------------

@query("eligible_images", "SELECT id, product_id FROM m_shown_image")
def _(c):
    return img.eligible_images(c.image).select("id", "product_id")


@query("governed_hero", """
SELECT h.product_id, i.image_url AS hero_image_url FROM m_hero h LEFT JOIN (SELECT DISTINCT product_id, image_url FROM m_shown_image) i
ON i.product_id = h.product_id AND i.image_url = trim(h.hero_image_url)""")
def _(c):
    return img.governed_hero(c.hero, c.image)


_PICTURE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN is_primary THEN 0 ELSE 1 END,
    CASE WHEN image_type = 'FRONT' THEN 0 ELSE 1 END, CASE WHEN is_official THEN 0 ELSE 1 END, id) AS rn FROM m_shown_image) i WHERE rn = 1"""
shared_view("m_picture", _PICTURE)


@query("primary_image", "SELECT product_id, id AS image_id, image_url, source_name, is_official FROM m_picture")
def _(c):
    return img.primary_image(c.image)


@query("gallery", """
SELECT product_id, id AS image_id, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN is_primary THEN 0 ELSE 1 END,
    CASE WHEN is_official THEN 0 ELSE 1 END, id) AS position FROM m_shown_image""")
def _(c):
    return img.gallery(c.image).select("product_id", "image_id", "position")


@query("eligible_sources", """
SELECT key FROM m_source WHERE is_enabled AND tos_status = 'ALLOWED' AND robots_status IN ('ALLOWED', 'NOT_APPLICABLE')
  AND reviewed_at IS NOT NULL AND reviewed_by IS NOT NULL""")
def _(c):
    return c.source.filter(radar_eligible()).select("key")


# ---- evidence -----------------------------------------------------------------------------

shared_view("m_best_evidence", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_type, subject_id
    ORDER BY CASE WHEN verified_at IS NOT NULL THEN 0 ELSE 1 END, observed_at DESC, id DESC) AS rn FROM m_evidence) e WHERE rn = 1""")
shared_view("m_fact", """
SELECT 'PRICING_OFFER' AS subject_type, id AS subject_id, product_id, transaction_type, region_id, price_type AS detail FROM m_pricing WHERE is_current
UNION ALL SELECT 'AVAILABILITY_OFFER', id, product_id, transaction_type, region_id, availability_status FROM m_availability WHERE is_current
UNION ALL SELECT 'DEPLOYMENT', id, product_id, NULL, NULL, 'Undisclosed customer' FROM m_deployment""")
_EFFECTIVE = "CASE WHEN confidence = 'VERIFIED' AND verified_at IS NULL THEN 'HIGH' ELSE confidence END"


def _facts(c: Catalog) -> DataFrame:
    return ev.facts_with_evidence(ev.commercial_facts(c.pricing, c.availability, c.deployment), ev.best_evidence(c.evidence, ["evidence_id", "confidence", "verified_at"]))


@query("best_evidence", """
SELECT subject_type, subject_id, id AS evidence_id, source_type, confidence, observed_at, verified_at, source_url FROM m_best_evidence""")
def _(c):
    return ev.best_evidence(c.evidence)


@query("facts_with_evidence", """
SELECT f.subject_type, f.subject_id, f.product_id, b.id AS evidence_id, b.confidence, b.verified_at
FROM m_fact f LEFT JOIN m_best_evidence b USING (subject_type, subject_id)""")
def _(c):
    return _facts(c).select("subject_type", "subject_id", "product_id", "evidence_id", "confidence", "verified_at")


@query("strongest_confidence", f"""
SELECT product_id, ['LOW', 'MEDIUM', 'HIGH', 'VERIFIED'][max(list_position(['LOW', 'MEDIUM', 'HIGH', 'VERIFIED'], {_EFFECTIVE}))] AS strongest_confidence
FROM m_fact f LEFT JOIN m_best_evidence b USING (subject_type, subject_id) GROUP BY product_id""")
def _(c):
    return ev.strongest_confidence(_facts(c))


@query("evidence_ledger", f"""
SELECT f.product_id, f.subject_id, CASE f.subject_type WHEN 'PRICING_OFFER' THEN 'Price' WHEN 'AVAILABILITY_OFFER' THEN 'Availability' ELSE 'Deployment' END
    || ' — ' || concat_ws(' · ', CASE f.transaction_type WHEN 'PURCHASE' THEN 'Purchase' WHEN 'RENTAL' THEN 'Rental' WHEN 'RAAS' THEN 'RaaS' END, r.code, f.detail) AS subject,
  'SUBJECT: ' || f.subject_type AS subject_code, {_EFFECTIVE} AS confidence, b.id AS evidence_id
FROM m_fact f JOIN m_best_evidence b USING (subject_type, subject_id) LEFT JOIN m_region r ON r.id = f.region_id""")
def _(c):
    return ev.evidence_ledger(_facts(c), c.region, labels.MODE_LABELS)


shared_view("m_fresh", """
SELECT product_id, max(verified_at) AS freshest_verified_at FROM (
  SELECT id AS product_id, 'COMMERCIAL_STATUS' AS subject_type, CAST(id AS VARCHAR) AS subject_id FROM m_product
  UNION ALL SELECT product_id, 'PRICING_OFFER', id FROM m_pricing
  UNION ALL SELECT product_id, 'AVAILABILITY_OFFER', id FROM m_availability
  UNION ALL SELECT product_id, 'DEPLOYMENT', id FROM m_deployment) s JOIN m_evidence e USING (subject_type, subject_id)
WHERE verified_at IS NOT NULL GROUP BY product_id""")


@query("freshest_evidence", "SELECT product_id, freshest_verified_at FROM m_fresh")
def _(c):
    return ev.freshest_evidence(c.product, c.pricing, c.availability, c.deployment, c.evidence)


_BACKFILL = """
SELECT 'COMMERCIAL_STATUS' AS subject_type, CAST(p.id AS VARCHAR) AS subject_id, 'MANUFACTURER_SITE' AS source_type, 'MEDIUM' AS confidence
FROM m_product p WHERE is_published AND NOT EXISTS (SELECT 1 FROM m_evidence e WHERE e.subject_type = 'COMMERCIAL_STATUS' AND e.subject_id = CAST(p.id AS VARCHAR))
UNION ALL SELECT 'PRICING_OFFER', o.id, CASE WHEN price_type = 'ESTIMATED' THEN 'NEWS_ARTICLE' ELSE 'MANUFACTURER_SITE' END,
  CASE WHEN price_type = 'ESTIMATED' THEN 'LOW' ELSE 'MEDIUM' END
FROM m_pricing o JOIN m_product p ON p.id = o.product_id WHERE is_published
  AND NOT EXISTS (SELECT 1 FROM m_evidence e WHERE e.subject_type = 'PRICING_OFFER' AND e.subject_id = o.id)
UNION ALL SELECT 'AVAILABILITY_OFFER', o.id, 'MANUFACTURER_SITE', 'MEDIUM' FROM m_availability o JOIN m_product p ON p.id = o.product_id WHERE is_published
  AND NOT EXISTS (SELECT 1 FROM m_evidence e WHERE e.subject_type = 'AVAILABILITY_OFFER' AND e.subject_id = o.id)
UNION ALL SELECT 'DEPLOYMENT', o.id, 'NEWS_ARTICLE', 'MEDIUM' FROM m_deployment o JOIN m_product p ON p.id = o.product_id WHERE is_published
  AND NOT EXISTS (SELECT 1 FROM m_evidence e WHERE e.subject_type = 'DEPLOYMENT' AND e.subject_id = o.id)"""


@query("backfill_evidence", _BACKFILL)
def _(c):
    return ev.backfill_evidence(c.product, c.pricing, c.availability, c.deployment, c.evidence)


@query("resolve_evidence", """
WITH t AS (SELECT 'er1.k1.' || sha256('secret|' || id) AS token, * FROM m_evidence)
SELECT t.token, CASE WHEN ok THEN t.id END AS evidence_id, CASE WHEN ok THEN t.subject_type END AS subject_type,
  CASE WHEN ok THEN t.subject_id END AS subject_id, CASE WHEN ok THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS outcome
FROM (SELECT t.*, EXISTS (
    SELECT 1 FROM (SELECT 'COMMERCIAL_STATUS' AS subject_type, CAST(id AS VARCHAR) AS subject_id, id AS product_id FROM m_product
                   UNION ALL SELECT 'PRICING_OFFER', id, product_id FROM m_pricing WHERE is_current
                   UNION ALL SELECT 'AVAILABILITY_OFFER', id, product_id FROM m_availability WHERE is_current
                   UNION ALL SELECT 'DEPLOYMENT', id, product_id FROM m_deployment) s
    JOIN m_product p ON p.id = s.product_id AND p.is_published
    WHERE s.subject_type = t.subject_type AND s.subject_id = t.subject_id) AS ok FROM t) t
UNION ALL SELECT 'er1.k1.forged-' || slug, NULL, NULL, NULL, 'UNRESOLVED' FROM m_manufacturer""")
def _(c):
    issued = c.evidence.select(ev.issue_ref(F.col("id"), "secret", "k1").alias("token"))
    forged = c.manufacturer.select(F.concat(F.lit("er1.k1.forged-"), "slug").alias("token"))
    return ev.resolve_evidence(
        issued.unionByName(forged), c.evidence, c.product, c.pricing, c.availability, c.deployment, "secret", "k1"
    )


# ---- pages --------------------------------------------------------------------------------

def _money(expr: str) -> str:
    return f"(CASE currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' END || format('{{:,}}', CAST(round({expr}, 0) AS BIGINT)))"


@query("state_labels", f"""
SELECT p.slug, CASE WHEN h.price_type IS NULL THEN 'No confirmed pricing' WHEN h.price_type = 'PUBLIC' THEN {_money('h.price')}
    WHEN h.price_type = 'FROM' THEN 'From ' || {_money('h.price')} WHEN h.price_type = 'ESTIMATED' THEN '~' || {_money('h.price')}
    WHEN h.price_type = 'RANGE' THEN {_money('h.price_min')} || ' – ' || {_money('h.price_max')} ELSE 'Price on request' END AS price_label,
  CASE WHEN len(s.modes) > 0 THEN 'AVAILABLE' ELSE 'AVAILABILITY UNKNOWN' END AS availability_label,
  array_to_string(list_transform(s.modes, lambda m: CASE m WHEN 'PURCHASE' THEN 'Purchase' WHEN 'RENTAL' THEN 'Rental' WHEN 'RAAS' THEN 'RaaS' END), ', ') AS modes,
  CASE WHEN has_sdk THEN 'YES' WHEN NOT has_sdk THEN 'NO' ELSE 'UNKNOWN' END AS sdk_label,
  upper(strftime(created_on, '%d %b %Y')) AS created_label
FROM m_product p JOIN m_snapshot s ON s.id = p.id LEFT JOIN m_headline h ON h.product_id = p.id WHERE p.is_published""")
def _(c):
    return reads.state_labels(c.product, c.pricing, snapshot_of(c))


@query("product_list", """
SELECT p.slug, p.name, p.manufacturer_slug, p.commercial_status, p.payload_kg, p.height_cm, p.mobility, i.image_url,
  h.price_type, h.price, h.price_min, h.price_max, h.currency, h.billing_period, array_to_string(s.modes, '|') AS available_modes, s.deployment_count
FROM m_product p JOIN m_snapshot s ON s.id = p.id LEFT JOIN m_headline h ON h.product_id = p.id LEFT JOIN m_picture i ON i.product_id = p.id
WHERE p.is_published""")
def _(c):
    rows = reads.product_list(c.product, snapshot_of(c), c.pricing, c.image)
    return rows.withColumn("available_modes", F.array_join("available_modes", "|"))


def detail_model(c: Catalog) -> dict:
    return {
        "products": c.product, "pricing": c.pricing, "availability": c.availability, "deployments": c.deployment,
        "fits": c.fit, "images": c.image, "history": c.status_history, "variants": c.variant, "capabilities": c.capability,
        "specifications": c.specification, "spec_definitions": c.spec_definition,
    }


_MODE = f"list_position({_sql_list(vocab.TRANSACTION_TYPE)}, transaction_type)"
_SPECS = " UNION ALL ".join(f"SELECT id, 'spec', {i}, '{f}', '{f}|' || coalesce(CAST({f} AS VARCHAR), '') FROM m_product" for i, f in enumerate(reads.SPEC_FIELDS))


shared_view("m_typed_spec", """
SELECT s.id, product_id, variant_id, s.key, label, category, sort_order,
    CASE WHEN value_number IS NOT NULL THEN 'number' WHEN value_bool IS NOT NULL THEN 'boolean' WHEN value_text IS NOT NULL THEN 'text' END AS kind,
    value_number, CASE WHEN value_number IS NULL THEN value_bool END AS value_bool,
    CASE WHEN value_number IS NULL AND value_bool IS NULL THEN value_text END AS value_text,
    coalesce(regexp_replace(regexp_replace(CAST(value_number AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), CAST(value_bool AS VARCHAR), value_text) AS value,
    coalesce(s.unit, d.unit) AS unit
FROM m_specification s JOIN m_spec_definition d ON d.key = s.key""")


@query("product_detail", f"""
WITH e AS (
  SELECT product_id AS id, 'pricing' AS section, CAST({_MODE} * 10 + list_position({_sql_list(vocab.PRICE_TYPE)}, price_type) AS DOUBLE) AS o1, id AS o2,
    concat_ws('|', transaction_type, price_type, coalesce(CAST(price AS VARCHAR), ''),
    coalesce(CAST(price_min AS VARCHAR), ''), coalesce(CAST(price_max AS VARCHAR), ''), currency, billing_period,
    coalesce(CAST(region_id AS VARCHAR), ''), coalesce(CAST(provider_id AS VARCHAR), '')) AS entry FROM m_pricing WHERE is_current
  UNION ALL SELECT product_id, 'availability', {_MODE}, id, concat_ws('|', transaction_type, availability_status, coalesce(CAST(region_id AS VARCHAR), ''),
    CAST(provider_id AS VARCHAR), coalesce(CAST(available_from AS VARCHAR), '')) FROM m_availability WHERE is_current
  UNION ALL SELECT product_id, 'deployment', -contract_value, id, concat_ws('|', CAST(provider_id AS VARCHAR), CAST(contract_value AS VARCHAR)) FROM m_deployment
  UNION ALL SELECT product_id, 'fit', -coalesce(fit_score, -1), use_case, concat_ws('|', use_case, coalesce(CAST(fit_score AS VARCHAR), '')) FROM m_fit
  UNION ALL SELECT product_id, 'image', CASE WHEN is_primary THEN 0 ELSE 2 END + CASE WHEN is_official THEN 0 ELSE 1 END, lpad(CAST(id AS VARCHAR), 20, '0'),
    concat_ws('|', image_url, image_type, coalesce(attribution, '')) FROM m_shown_image
  UNION ALL SELECT product_id, 'history', effective_at - DATE '1970-01-01', status, concat_ws('|', status, CAST(effective_at AS VARCHAR)) FROM m_status_history
  UNION ALL SELECT product_id, 'variant', 0, slug, concat_ws('|', slug, name, CAST(is_developer AS VARCHAR)) FROM m_variant
  UNION ALL SELECT product_id, 'capability', 0, capability, concat_ws('|', capability, CAST(supported AS VARCHAR), coalesce(detail, '')) FROM m_capability
  UNION ALL SELECT product_id, 'extended_spec', sort_order, id, concat_ws('|', key, label, coalesce(kind, ''), coalesce(value, ''), coalesce(unit, ''), category, coalesce(variant_id, '')) FROM m_typed_spec
  UNION ALL {_SPECS})
SELECT p.slug, e.section, row_number() OVER (PARTITION BY p.id, e.section ORDER BY o1, o2) AS position, e.entry FROM e JOIN m_product p ON p.id = e.id WHERE p.is_published""")
def _(c):
    return reads.product_detail(detail_model(c)).select("slug", "section", "position", "entry")


@query("spec_values", "SELECT id, product_id, variant_id, key, label, category, kind, value_number, value_bool, value_text, value, unit FROM m_typed_spec")
def _(c):
    return typed_values(c.specification, c.spec_definition).drop("sort_order")


@query("absence_notices", """
SELECT slug, array_to_string(list_sort(list_filter([
    CASE WHEN NOT EXISTS (SELECT 1 FROM m_pricing o WHERE o.product_id = p.id AND is_current) THEN 'no_current_pricing_offer' END,
    CASE WHEN NOT EXISTS (SELECT 1 FROM m_availability o WHERE o.product_id = p.id AND is_current) THEN 'no_current_availability_offer' END,
    CASE WHEN NOT EXISTS (SELECT 1 FROM m_deployment o WHERE o.product_id = p.id) THEN 'no_recorded_deployment' END,
    CASE WHEN NOT EXISTS (SELECT 1 FROM m_shown_image o WHERE o.product_id = p.id) THEN 'no_display_eligible_image' END],
    lambda n: n IS NOT NULL)), '|') AS notices FROM m_product p WHERE is_published""")
def _(c):
    rows = reads.absence_notices(c.product, c.pricing, c.availability, c.deployment, c.image)
    return rows.withColumn("notices", F.array_join("notices", "|"))


@query("use_case_products", """
SELECT f.use_case, p.slug, f.fit_score, row_number() OVER (PARTITION BY f.use_case ORDER BY coalesce(f.fit_score, -1) DESC, p.slug) AS rank
FROM m_fit f JOIN m_product p ON p.id = f.product_id WHERE p.is_published""")
def _(c):
    return reads.use_case_products(c.use_case, c.fit, c.product)


@query("manufacturer_profile", """
WITH e AS (
  SELECT manufacturer_slug AS maker, 'product' AS section, slug AS entry FROM m_product WHERE is_published
  UNION ALL SELECT manufacturer_slug, 'provider', name FROM m_provider
  UNION ALL SELECT p.manufacturer_slug, 'deployment', p.slug || '|' || d.id FROM m_deployment d JOIN m_product p ON p.id = d.product_id WHERE p.is_published)
SELECT maker, section, entry FROM e WHERE maker IN (SELECT slug FROM m_manufacturer)""")
def _(c):
    return reads.manufacturer_profile(c.manufacturer, c.product, c.provider, c.deployment)


@query("status_timeline", """
SELECT product_id, status, effective_at, row_number() OVER w AS step, lag(status) OVER w AS previous_status
FROM m_status_history WINDOW w AS (PARTITION BY product_id ORDER BY effective_at, status)""")
def _(c):
    return reads.status_timeline(c.status_history)


@query("review_queue", """
SELECT c.id, c.manufacturer, c.name, c.external_ref, s.name AS source_name, c.official_url,
  row_number() OVER (ORDER BY c.manufacturer, c.name, c.external_ref, c.id) AS rank
FROM m_candidate c JOIN m_source s ON s.key = c.source""")
def _(c):
    return reads.review_queue(c.candidate, c.source).select("id", "manufacturer", "name", "external_ref", "source_name", "official_url", "rank")


@query("queue_by_maker", "SELECT coalesce(manufacturer, 'UNKNOWN MANUFACTURER') AS manufacturer, count(*) AS candidates FROM m_candidate GROUP BY 1")
def _(c):
    return reads.queue_by_maker(c.candidate)


# ---- scalar rules over whole tables ----------------------------------------------------------

_GENERIC = _sql_list(text.GENERIC_TOKENS)
_SUFFIX = _sql_list(text.SLUG_SUFFIXES)


def sql_words(expr: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower(coalesce({expr}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"


def sql_normalize(expr: str) -> str:
    return f"array_to_string(list_filter({sql_words(expr)}, lambda t: NOT list_contains({_GENERIC}, t)), ' ')"


def sql_model_key(name: str, key: str) -> str:
    return (f"array_to_string(list_filter({sql_words(name)}, lambda t: NOT list_contains({_GENERIC}, t) "
            f"AND NOT list_contains(string_split({key}, ' '), t)), ' ')")


def sql_slug(expr: str) -> str:
    return f"array_to_string({sql_words(expr)}, '-')"


def sql_brand(slug: str) -> str:
    return (f"coalesce(nullif(array_to_string(list_filter(string_split({slug}, '-'), lambda t: NOT list_contains({_SUFFIX}, t)), '-'), ''), {slug})")


@query("normalize_names", f"""
SELECT id, maker_key, {sql_model_key('name', 'maker_key')} AS model_key, slug, brand,
  CASE WHEN slug = lead OR starts_with(slug, lead || '-') THEN slug ELSE brand || '-' || slug END AS product_slug, loose, origin, domain, cleaned
FROM (SELECT id, name, {sql_normalize('manufacturer')} AS maker_key, {sql_slug('name')} AS slug, {sql_brand(sql_slug('manufacturer'))} AS brand,
    string_split({sql_brand(sql_slug('manufacturer'))}, '-')[1] AS lead, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS loose,
    nullif(regexp_extract(official_url, '^(https?://[^/]+)', 1), '') AS origin, lower(regexp_extract(mail, '@(.*)$', 1)) AS domain, nullif(trim(blank), '') AS cleaned
  FROM (SELECT *, external_ref || '@' || lower(source) || '.example' AS mail, CASE WHEN id % 2 = 0 THEN '  ' ELSE ' ' || source || ' ' END AS blank FROM m_candidate) c) x""")
def _(c):
    mail = F.concat("external_ref", F.lit("@"), F.lower("source"), F.lit(".example"))
    blank = F.when(F.col("id") % 2 == 0, "  ").otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))
    maker_key = text.normalize(F.col("manufacturer"))
    return c.candidate.select(
        "id", maker_key.alias("maker_key"), text.model_key(F.col("name"), maker_key).alias("model_key"),
        text.slugify(F.col("name")).alias("slug"), text.brand_token(text.slugify(F.col("manufacturer"))).alias("brand"),
        text.product_slug(F.col("manufacturer"), F.col("name")).alias("product_slug"), text.loose_key(F.col("name")).alias("loose"),
        text.url_origin(F.col("official_url")).alias("origin"), text.email_domain(mail).alias("domain"), text.clean(blank).alias("cleaned"),
    )


@query("imperial_units", f"""
SELECT id, CAST(inches // 12 AS VARCHAR) || ' ft ' || CAST(inches % 12 AS VARCHAR) || ' in' AS height,
  CAST(lb AS VARCHAR) || ' lb' AS weight,
  CASE WHEN tenths % 10 = 0 THEN CAST(tenths // 10 AS VARCHAR) ELSE CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR) END || ' mph' AS speed
FROM (SELECT id, CAST(floor(CAST(height_cm AS DOUBLE) / CAST(2.54 AS DOUBLE) + 0.5) AS BIGINT) AS inches,
    CAST(floor(CAST(weight_kg AS DOUBLE) * CAST({labels.LB_PER_KG} AS DOUBLE) + 0.5) AS BIGINT) AS lb,
    CAST(floor(CAST(walk_speed_ms AS DOUBLE) * CAST({labels.MPH_PER_MS} AS DOUBLE) * 10 + 0.5) AS BIGINT) AS tenths FROM m_product) x""")
def _(c):
    known = lambda col, label: F.when(F.col(col).isNotNull(), label(F.col(col)))
    return c.product.select(
        "id", known("height_cm", labels.feet_inches).alias("height"), known("weight_kg", labels.pounds).alias("weight"),
        known("walk_speed_ms", labels.miles_per_hour).alias("speed"),
    )



@query("ramps", """
SELECT id, CAST(CASE WHEN price <= 30000 THEN 1 WHEN price >= r.top THEN 0 ELSE (r.top - price) / (CAST(0.1 AS DOUBLE) * 30000) END AS DECIMAL(12,6)) AS ramp,
  CAST(least(1, greatest(0, price / (30000 * CAST(1.25 AS DOUBLE)))) AS DECIMAL(12,6)) AS headroom
FROM (SELECT id, CAST(price AS DOUBLE) AS price, CAST(1.1 AS DOUBLE) * 30000 AS top FROM m_pricing WHERE price IS NOT NULL) r""")
def _(c):
    from ..functions.rules import budget_ramp, payload_headroom

    price, budget = F.col("price").cast("double"), F.lit(30000.0)
    return c.pricing.filter("price IS NOT NULL").select(
        "id", budget_ramp(price, budget).cast("decimal(12,6)").alias("ramp"),
        payload_headroom(price, budget).cast("decimal(12,6)").alias("headroom"),
    )
