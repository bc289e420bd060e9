"""Queries of import, export and the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.stage import shared_folder
from ..sources import documents as docs
from ..sources import exports
from ..sources.catalog import Catalog
from ..streaming import candidates as stream
from ..streaming import events as ev
from ..streaming import limits
from ..streaming.replay import replay
from .registry import query, shared_view

ORIGIN = "https://catalogue.example"


def _scratch(c: Catalog, label: str) -> str:
    return f"{shared_folder(c.spark)}/{label}-{uuid.uuid4().hex}"


def product_documents(c: Catalog):
    """Nested documents, one per product and supplier, so each holds at most seven offers."""
    pair = lambda: (F.split("id", "-")[0].cast("long").alias("part"), F.split("id", "-")[1].cast("long").alias("supp"))
    n = F.col("part") + F.col("supp")
    k = lambda i: F.struct(
        F.concat(F.lit("https://source.example/"), n.cast("string")).alias("source_url"), F.lit("MANUFACTURER_SITE").alias("source_type"),
        F.when(n % 4 != 1, "HIGH").alias("confidence"), F.when(n % 3 != i, F.lit("2026-01-01").cast("date")).alias("verified_at"),
    )
    evidence = F.array(k(1), k(2))  # of stated prices and dated offers
    slug = lambda c_: F.when(F.col(c_).isNotNull(), F.concat(F.lit("s-"), F.col(c_).cast("string")))
    prices = c.pricing.select(*pair(), "*").groupBy("part", "supp").agg(F.array_sort(F.collect_list(F.struct(
        "id", "transaction_type", "price_type", F.when(F.col("currency") != "USD", F.col("currency")).alias("currency"), "price", "price_min", "price_max",
        F.when(F.col("billing_period") != "ONE_TIME", F.col("billing_period")).alias("billing_period"), slug("provider_id").alias("provider_slug"),
    ))).alias("_p"))
    offers = c.availability.select(*pair(), "*").groupBy("part", "supp").agg(F.array_sort(F.collect_list(F.struct(
        "id", "transaction_type", F.when(F.col("availability_status") != "ON_REQUEST", F.col("availability_status")).alias("availability_status"),
        slug("provider_id").alias("provider_slug"), "available_from",
    ))).alias("_o"))
    facts = c.product.select(F.col("id").alias("part"), "name", "manufacturer_slug", F.when(F.col("commercial_status") != "UNKNOWN", F.col("commercial_status")).alias("commercial_status"),
                             "is_published", F.struct("height_cm", "payload_kg", "has_sdk").alias("specs"))
    rows = prices.join(offers, ["part", "supp"], "full_outer").join(facts, "part")
    return rows.withColumn("_e", evidence).select(
        F.concat(F.lit("d-"), F.col("part").cast("string"), F.lit("-"), F.col("supp").cast("string")).alias("slug"), "name", "manufacturer_slug",
        "commercial_status", "is_published", "specs", F.transform("_p", lambda p: p.withField("evidence", F.when(p["price"].isNotNull() | p["price_min"].isNotNull(), F.col("_e")))).alias("pricing_offers"),
        F.transform("_o", lambda o: o.withField("evidence", F.when(o["available_from"].isNotNull(), F.col("_e")))).alias("availability_offers"),
    )


def stored_documents(c: Catalog):
    """The documents written as packed JSON lines and scanned back with the full document schema."""
    path = _scratch(c, "documents")
    product_documents(c).write.option("compression", "gzip").json(path)
    return docs.read_products(c.spark, path, multi_line=False)


shared_view("m_doc_price", """
SELECT 'd-' || product_id || '-' || split_part(id, '-', 2) AS doc, CAST(row_number() OVER (PARTITION BY product_id, split_part(id, '-', 2) ORDER BY id) - 1 AS INTEGER) AS position,
  product_id + CAST(split_part(id, '-', 2) AS BIGINT) AS n, * FROM m_pricing""")
shared_view("m_doc_offer", """
SELECT 'd-' || product_id || '-' || split_part(id, '-', 2) AS doc, CAST(row_number() OVER (PARTITION BY product_id, split_part(id, '-', 2) ORDER BY id) - 1 AS INTEGER) AS position, * FROM m_availability""")


@query("scan_product_docs", """
SELECT doc AS slug, max(np) AS prices, max(no) AS offers, max(h) AS height_cm FROM (
  SELECT doc, count(*) AS np, 0 AS no, any_value(p.height_cm) AS h FROM m_doc_price d JOIN m_product p ON p.id = d.product_id GROUP BY doc
  UNION ALL SELECT doc, 0, count(*), any_value(p.height_cm) FROM m_doc_offer d JOIN m_product p ON p.id = d.product_id GROUP BY doc) x GROUP BY doc""")
def _(c):
    rows = stored_documents(c)
    size = lambda name: F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.size(name)).cast("long")
    return rows.select("slug", size("pricing_offers").alias("prices"), size("availability_offers").alias("offers"), F.col("specs.height_cm").alias("height_cm"))


@query("scan_dimensions", "SELECT id AS provider_id, name, 'N' || (country_id - 100) AS country_region_code FROM m_provider")
def _(c):
    # One wrapper object per thousand providers, as a reference list file would hold them.
    path = _scratch(c, "dimension")
    entry = F.struct(F.col("id").cast("string").alias("slug"), "name", F.concat(F.lit("N"), (F.col("country_id") - 100).cast("string")).alias("country_region_code"))
    c.provider.groupBy(F.floor(F.col("id") / 1000).alias("file")).agg(F.collect_list(entry).alias("providers")).drop("file").write.json(path)
    return docs.read_dimension(c.spark, path, "providers", multi_line=False).select(F.col("slug").cast("long").alias("provider_id"), "name", "country_region_code")


@query("scan_candidates", "SELECT external_ref, name, manufacturer, official_url, 1 AS claims FROM m_candidate")
def _(c):
    path = _scratch(c, "candidates")
    key = F.col("id").cast("string")
    claim = F.struct(F.lit("height_cm").alias("field_key"), key.alias("claimed_value"), F.lit("cm").alias("unit"), F.col("discovery_url").alias("evidence_url"))
    c.candidate.select("external_ref", "entity_type", "name", "manufacturer", "discovery_url", F.struct("official_url").alias("data"), F.array(claim).alias("claims")).write.json(path)
    return docs.read_candidates(c.spark, path, multi_line=False).select(
        "external_ref", "name", "manufacturer", "data.official_url", F.size("claims").alias("claims")
    )


@query("flatten_offers", """
SELECT 'price' AS kind, doc AS product_slug, position, transaction_type, price_type AS detail, currency, billing_period FROM m_doc_price
UNION ALL SELECT 'offer', doc, position, transaction_type, availability_status, NULL, NULL FROM m_doc_offer""")
def _(c):
    none = F.lit(None).cast("string")
    shape = lambda detail, *names: lambda read: [
        read("transaction_type").alias("transaction_type"), read(detail).alias("detail"),
        *[(read(n) if n in names else none).alias(n) for n in ("currency", "billing_period")]]
    rows = docs.children(_full(c), {"pricing_offers": shape("price_type", "currency", "billing_period"), "availability_offers": shape("availability_status")})
    kind = F.when(F.col("kind") == "pricing_offers", "price").otherwise("offer")
    return rows.withColumn("kind", kind).select("kind", "product_slug", "position", "transaction_type", "detail", "currency", "billing_period")


def _full(c: Catalog):
    """The documents with the columns flattening reads, parsed from their JSON text."""
    text = product_documents(c).select(F.to_json(F.struct("*")).alias("j"))
    return text.select(F.from_json("j", docs.PRODUCT_SCHEMA).alias("d")).select("d.*")


@query("evidence_fanout", """
SELECT 'PRICING_OFFER' AS subject_type, sha256(doc || '|pricing_offers|' || position) AS subject_id, 'https://source.example/' || n AS source_url,
  CASE WHEN n % 4 <> 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, CASE WHEN n % 3 <> k THEN DATE '2026-01-01' END AS verified_at
FROM m_doc_price, (VALUES (1), (2)) t(k) WHERE price IS NOT NULL OR price_min IS NOT NULL
UNION ALL SELECT 'AVAILABILITY_OFFER', sha256(doc || '|availability_offers|' || position), 'https://source.example/' || n,
  CASE WHEN n % 4 <> 1 THEN 'HIGH' ELSE 'MEDIUM' END, CASE WHEN n % 3 <> k THEN DATE '2026-01-01' END
FROM (SELECT *, product_id + CAST(split_part(id, '-', 2) AS BIGINT) AS n FROM m_doc_offer) o, (VALUES (1), (2)) t(k) WHERE available_from IS NOT NULL""")
def _(c):
    return docs.document_evidence(_full(c)).select("subject_type", "subject_id", "source_url", "confidence", "verified_at")


@query("upsert_dimension", """
SELECT id, CASE WHEN id % 3 = 0 THEN 'Renamed ' || id ELSE name END AS name, country_id FROM m_provider
UNION ALL SELECT id + 1000000, 'New ' || id, NULL FROM m_provider WHERE id % 7 = 0""")
def _(c):
    key = F.col("id")
    changed = c.provider.filter(key % 3 == 0).select("id", F.concat(F.lit("Renamed "), key.cast("string")).alias("name"))
    added = c.provider.filter(key % 7 == 0).select((key + 1_000_000).alias("id"), F.concat(F.lit("New "), key.cast("string")).alias("name"))
    return docs.upsert(c.provider.select("id", "name", "country_id"), changed.unionByName(added), "id", ["name"])


@query("replace_children", """
SELECT id, product_id, price_type FROM m_pricing WHERE product_id % 5 <> 0 UNION ALL SELECT 'new-' || id, product_id, 'QUOTE_ONLY' FROM m_pricing WHERE product_id % 10 = 0 AND is_current""")
def _(c):
    stored = c.pricing.select("id", "product_id", "price_type")
    batch = c.pricing.filter((F.col("product_id") % 10 == 0) & F.col("is_current")).select(
        F.concat(F.lit("new-"), "id").alias("id"), "product_id", F.lit("QUOTE_ONLY").alias("price_type")
    )
    parents = c.product.filter(F.col("id") % 5 == 0).select(F.col("id").alias("product_id"))
    return docs.replace_children(stored, batch, parents, "product_id").select("id", "product_id", "price_type")


@query("preserve_publication", """
SELECT slug, CASE WHEN id % 4 <> 0 THEN is_published ELSE coalesce(CASE WHEN id % 3 <> 0 THEN id % 2 = 0 END, false) END AS is_published FROM m_product""")
def _(c):
    key = F.col("id")
    incoming = c.product.select("slug", F.when(key % 3 != 0, key % 2 == 0).alias("is_published"))
    return docs.merge_published(c.product.filter(key % 4 != 0), incoming).select("slug", "is_published")


@query("resolve_refs", """
SELECT c_custkey AS id, code AS region_code, CASE WHEN code IS NULL THEN 'absent' WHEN r.id IS NULL THEN 'rejected' ELSE 'resolved' END AS outcome, r.id AS region_id
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'N99' ELSE 'N' || c_nationkey END AS code FROM customer) c LEFT JOIN m_region r USING (code)""")
def _(c):
    key = F.col("c_custkey")
    code = F.when(key % 5 == 0, F.lit(None)).when(key % 7 == 0, "N99").otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    ok, rejected = docs.resolve_refs(c.table("customer").select(key.alias("id"), code.alias("region_code")), c.region, "region_code")
    outcome = F.when(F.col("region_code").isNull(), "absent").otherwise("resolved")
    columns = ["id", "region_code", "outcome", F.col("region_code_id").alias("region_id")]
    return ok.withColumn("outcome", outcome).select(*columns).unionByName(rejected.withColumn("outcome", F.lit("rejected")).select(*columns))


# ---- exports -------------------------------------------------------------------------------------

def _number(expr: str) -> str:
    return f"regexp_replace(regexp_replace(CAST(CAST({expr} AS DECIMAL(20,2)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


def _prop(name: str, value: str, unit: str | None = None) -> str:
    tail = f',"unitText":"{unit}"}}' if unit else "}"
    return f"""'{{"@type":"PropertyValue","name":"{name}","value":' || {value} || '{tail}'"""


_PROPS = ", ".join(
    [_prop("Commercial status", "'\"' || commercial_status || '\"'")]
    + [_prop(name, _number(f), unit) for f, (name, unit) in exports.NUMERIC_PROPERTIES.items()]
    + [_prop(name, f"'\"' || {f} || '\"'") for f, name in exports.TEXT_PROPERTIES.items()]
)


@query("export_jsonld", f"""
SELECT slug, '{{"@context":"https://schema.org","@graph":[{{"@type":"Product","@id":"' || page || '","url":"' || page || '","name":"' || name
  || '","category":"Humanoid robot","manufacturer":{{"@id":"' || maker || '"}},"additionalProperty":[' || concat_ws(',', {_PROPS}) || ']'
  || coalesce(',"description":"' || summary || '"', '') || coalesce(',"productionDate":"' || announced_year || '"', '')
  || '}},{{"@type":"Organization","@id":"' || maker || '","name":"' || manufacturer_slug || '","url":"' || maker || '"}}]}}' AS jsonld
FROM (SELECT *, '{ORIGIN}/products/' || slug AS page, '{ORIGIN}/makers/' || manufacturer_slug AS maker FROM m_product WHERE is_published) p""")
def _(c):
    return exports.jsonld(c.product, ORIGIN)


@query("export_sitemap", f"""
SELECT '{ORIGIN}/products/' || slug AS url, created_on AS last_modified, 'weekly' AS change_frequency, '0.8' AS priority FROM m_product WHERE is_published
UNION ALL SELECT '{ORIGIN}/makers/' || slug, NULL, 'weekly', '0.6' FROM m_manufacturer UNION ALL SELECT '{ORIGIN}/use-cases/' || slug, NULL, 'weekly', '0.6' FROM m_use_case""")
def _(c):
    return exports.sitemap(c.product, c.manufacturer, c.use_case, ORIGIN)


@query("export_llms_txt", f"""
SELECT 'products' AS section, '- ' || name || ' (' || manufacturer_slug || '): {ORIGIN}/products/' || slug AS line FROM m_product WHERE is_published
UNION ALL SELECT 'makers', '- ' || name || ': {ORIGIN}/makers/' || slug FROM m_manufacturer UNION ALL SELECT 'use cases', '- ' || slug || ': {ORIGIN}/use-cases/' || slug FROM m_use_case""")
def _(c):
    return exports.llms_txt(c.product, c.manufacturer, c.use_case, ORIGIN)


# ---- streams ---------------------------------------------------------------------------------------

TIERS = {"burst": (3600, 2), "sustained": (86400, 4)}


@query("rate_windows", """
SELECT 'burst' AS tier, date_trunc('hour', ts) AS window_start, client, count(*) AS hits FROM m_event GROUP BY 2, 3 HAVING count(*) > 2
UNION ALL SELECT 'sustained', date_trunc('day', ts), client, count(*) FROM m_event GROUP BY 2, 3 HAVING count(*) > 4""")
def _(c):
    return ev.rate_windows(c.event, "client", TIERS)


@query("event_rollup", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events FROM m_event GROUP BY 1, 2")
def _(c):
    """The event table replayed as a stream; one last row, far behind the others, closes their windows."""
    arriving, store, mark = _scratch(c, "arriving"), _scratch(c, "rollup"), _scratch(c, "progress")
    rows = c.event.select("id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    end = rows.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("string").alias("event_type"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"))
    late = replay(rows.unionByName(end), "ts", 5, arriving, lambda feed: ev.append_rollup(feed, store, mark))
    if ev.late_rows(late):
        raise RuntimeError("rows of a replay in order of time cannot be late")
    return c.spark.read.parquet(store)


# Requests come through shared addresses, a thousand times as fast as the events they are read from.
_REQUEST_SQL = """
SELECT id, CASE WHEN event_type IN ('click', 'view') THEN 'buyer_requirements' ELSE 'commercial_leads' END AS policy, CAST(client // 32 AS VARCHAR) AS client,
  epoch_us(ts) // 1000 AS us FROM m_event"""


def requests(c: Catalog):
    return c.event.select(
        "id", F.when(F.col("event_type").isin("click", "view"), "buyer_requirements").otherwise("commercial_leads").alias("policy"),
        F.floor(F.col("client") / 32).cast("string").alias("client"),
        F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")).alias("ts"))


shared_view("m_request", _REQUEST_SQL)
shared_view("m_policy", " UNION ALL ".join(
    f"SELECT '{name}' AS policy, {t['burst'][0]}000000 AS bw, {t['burst'][1]} AS bl, {t['sustained'][0]}000000 AS sw, {t['sustained'][1]} AS sl" for name, t in ev.POLICIES.items()))


@query("rate_limits", """
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY policy, client ORDER BY us, id) AS n FROM m_request JOIN m_policy USING (policy)),
s AS (
  SELECT policy, client, n, id, us, us AS bs, 1 AS bc, us AS ss, 1 AS sc FROM r WHERE n = 1
  UNION ALL
  SELECT policy, client, n, id, us, bs, bc, CASE WHEN bc > bl THEN ss WHEN us - ss >= sw THEN us ELSE ss END,
    CASE WHEN bc > bl THEN sc WHEN us - ss >= sw THEN 1 ELSE sc + 1 END
  FROM (SELECT r.policy, r.client, r.n, r.id, r.us, r.bl, r.sw, s.ss, s.sc, CASE WHEN r.us - s.bs >= r.bw THEN r.us ELSE s.bs END AS bs,
      CASE WHEN r.us - s.bs >= r.bw THEN 1 ELSE s.bc + 1 END AS bc FROM s JOIN r ON r.policy = s.policy AND r.client = s.client AND r.n = s.n + 1) q)
SELECT policy, client, id, CASE WHEN bc > bl THEN 'burst' WHEN sc > sl THEN 'sustained' ELSE 'accepted' END AS outcome,
  CAST(CASE WHEN bc > bl THEN bc ELSE sc END AS BIGINT) AS hits,
  CAST(CASE WHEN bc > bl THEN least(greatest(1, ceil((bw - (us - bs)) / 1000000.0)), bw // 1000000)
    WHEN sc > sl THEN least(greatest(1, ceil((sw - (us - ss)) / 1000000.0)), sw // 1000000) ELSE 0 END AS BIGINT) AS retry_after
FROM s JOIN m_policy USING (policy)""")
def _(c):
    """Every request of both policies, replayed as a stream."""
    arriving, store, mark = _scratch(c, "arriving"), _scratch(c, "decisions"), _scratch(c, "progress")

    def start(feed):
        return (limits.rate_decisions(feed).writeStream.format("parquet").option("path", store).option("checkpointLocation", mark)
                .outputMode("append").trigger(availableNow=True).start())

    replay(requests(c), "ts", 3, arriving, start)
    return c.spark.read.parquet(store).drop("ts")


_SIGHTINGS = """
SELECT c.source, external_ref, id AS candidate_id, c.name, TIMESTAMP '2026-03-01' + to_days(CAST(id % 5 AS INTEGER)) + to_microseconds(id) AS seen_at
FROM m_candidate c JOIN m_source s ON s.key = c.source
WHERE s.is_enabled AND tos_status = 'ALLOWED' AND robots_status IN ('ALLOWED', 'NOT_APPLICABLE') AND reviewed_at IS NOT NULL AND reviewed_by IS NOT NULL"""


@query("stream_ingest", f"""
SELECT source, external_ref, arg_min(candidate_id, (seen_at, candidate_id)) AS candidate_id, arg_min(name, (seen_at, candidate_id)) AS name,
  min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, count(*) AS sightings FROM ({_SIGHTINGS}) s GROUP BY source, external_ref""")
def _(c):
    """The candidate table replayed as a stream of files; every fourth record is delivered twice."""
    return ingested(c, 3)


def ingested(c: Catalog, slices: int):
    arriving, store, mark = _scratch(c, "arriving"), _scratch(c, "store"), _scratch(c, "progress")
    seen = F.timestamp_micros(F.unix_micros(F.lit("2026-03-01").cast("timestamp")) + (F.col("id") % 5) * 86_400_000_000 + F.col("id"))
    rows = c.candidate.select(F.col("id").alias("candidate_id"), "source", "external_ref", "name", seen.alias("seen_at"))
    replay(rows, "seen_at", slices, arriving, lambda feed: stream.stream_ingest(feed, store, c.source, mark), again=rows.where("candidate_id % 4 = 0"))
    return stream.current_candidates(c.spark, store)
