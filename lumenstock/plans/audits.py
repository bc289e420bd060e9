"""Queries of the integrity audits, over tables derived with planted faults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audits
from ..sources.catalog import Catalog
from .registry import query, shared_view


@query("evidence_gaps", """
WITH f AS (
  SELECT 'COMMERCIAL_STATUS' AS subject_type, CAST(id AS VARCHAR) AS subject_id, slug FROM m_product WHERE is_published AND commercial_status <> 'UNKNOWN'
  UNION ALL SELECT 'PRICING_OFFER', o.id, slug FROM m_pricing o JOIN m_product p ON p.id = product_id WHERE is_published
  UNION ALL SELECT 'AVAILABILITY_OFFER', o.id, slug FROM m_availability o JOIN m_product p ON p.id = product_id WHERE is_published
  UNION ALL SELECT 'DEPLOYMENT', o.id, slug FROM m_deployment o JOIN m_product p ON p.id = product_id WHERE is_published)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM m_evidence e WHERE e.subject_type = f.subject_type AND e.subject_id = f.subject_id)""")
def _(c):
    return audits.evidence_gaps(c.product, c.pricing, c.availability, c.deployment, c.evidence)


@query("image_gaps", """
SELECT id, concat_ws('|', CASE WHEN source_url IS NULL THEN 'no_source_url' END, CASE WHEN source_name IS NULL THEN 'no_source_name' END,
  CASE WHEN rights_status = 'ATTRIBUTION_REQUIRED' AND attribution IS NULL THEN 'no_attribution' END) AS gaps FROM m_image
WHERE identity_status = 'VERIFIED' AND rights_status <> 'RESTRICTED'
  AND (rights_status IN ('PERMITTED', 'ATTRIBUTION_REQUIRED') OR usage_basis = 'OFFICIAL_MANUFACTURER_MEDIA')
  AND (source_url IS NULL OR source_name IS NULL OR (rights_status = 'ATTRIBUTION_REQUIRED' AND attribution IS NULL))""")
def _(c):
    return audits.image_gaps(c.image).select("id", F.array_join("gaps", "|").alias("gaps"))


@query("append_only_audit", """
SELECT product_id, status, effective_at, CASE WHEN product_id % 11 = 0 THEN 'missing' ELSE 'changed' END AS violation
FROM m_status_history WHERE product_id % 11 = 0 OR product_id % 13 = 0""")
def _(c):
    before = c.status_history.withColumn("note", F.lit("seen"))
    edited = F.when(F.col("product_id") % 13 == 0, "edited").otherwise("seen")
    after = c.status_history.filter(F.col("product_id") % 11 != 0).withColumn("note", edited)
    return audits.append_only_violations(before, after, ["product_id", "status", "effective_at"])


def crawl_runs(c: Catalog):
    key = F.col("event_id")
    return c.table("events").select(
        key.alias("id"), F.concat(F.lit("src"), (key % 20).cast("string")).alias("source"),
        F.when(key % 3 == 0, "RUNNING").otherwise("FINISHED").alias("status"),
        F.when((key % 3 != 0) & (key % 10 != 1) | (key % 30 == 0), F.col("ts")).alias("finished_at"),
    )


def fetched_pages(c: Catalog):
    key = F.col("page_id")
    return c.table("pages").select(
        key.alias("id"), F.floor(key * 7 / 10).alias("run_id"),
        F.concat(F.lit("src"), (F.when(key % 9 == 0, key).otherwise(F.floor(key * 7 / 10)) % 20).cast("string")).alias("source"),
    )


def lineage_rows(c: Catalog):
    key = F.col("doc_id")
    page = F.floor(key / 4)
    run = F.when(key % 13 == 0, F.floor(key / 10)).otherwise(F.floor(page * 7 / 10))
    return c.table("documents").select(
        key.alias("id"), F.when(key % 6 != 0, page).alias("page_id"), F.when(key % 8 != 0, run).alias("run_id"), "source"
    )


shared_view("m_crawl_run", """
SELECT event_id AS id, 'src' || (event_id % 20) AS source, CASE WHEN event_id % 3 = 0 THEN 'RUNNING' ELSE 'FINISHED' END AS status,
  CASE WHEN (event_id % 3 <> 0 AND event_id % 10 <> 1) OR event_id % 30 = 0 THEN ts END AS finished_at FROM events""")
shared_view("m_fetched_page", """
SELECT page_id AS id, page_id * 7 // 10 AS run_id, 'src' || (CASE WHEN page_id % 9 = 0 THEN page_id ELSE page_id * 7 // 10 END % 20) AS source FROM pages""")
shared_view("m_lineage_row", """
SELECT doc_id AS id, CASE WHEN doc_id % 6 <> 0 THEN doc_id // 4 END AS page_id,
  CASE WHEN doc_id % 8 <> 0 THEN CASE WHEN doc_id % 13 = 0 THEN doc_id // 10 ELSE (doc_id // 4) * 7 // 10 END END AS run_id, source FROM documents""")


def signals(c: Catalog):
    """Commercial signals read off events, some with two axes mixed or a price without currency."""
    k = F.col("event_id")
    axis = F.when(k % 3 == 0, "MATURITY").when(k % 3 == 1, "OBTAINABILITY").otherwise("PRICE")
    return c.table("events").select(
        k.alias("id"), axis.alias("axis"),
        F.when((axis == "MATURITY") | (k % 17 == 0), "PILOT").alias("maturity_value"),
        F.when(axis == "OBTAINABILITY", "LIMITED").alias("availability_value"),
        F.when(axis == "PRICE", "PUBLIC").alias("price_type"),
        F.when(axis == "PRICE", F.col("value")).alias("price_amount"),
        F.when((axis == "PRICE") & (k % 19 != 0), "USD").alias("price_currency"),
    )


@query("check_audit", """
SELECT 'pricing' AS "table", id AS row, 'price_type_shape' AS "check" FROM m_pricing WHERE price_type = 'RANGE' AND price_min >= 90000
UNION ALL SELECT 'product', CAST(id AS VARCHAR), 'payload_not_negative' FROM m_product WHERE payload_kg < 5
UNION ALL SELECT 'product', CAST(id AS VARCHAR), 'runtime_not_negative' FROM m_product WHERE runtime_minutes < 60
UNION ALL SELECT 'source', key, 'source_eligible' FROM m_source WHERE is_enabled AND NOT (tos_status = 'ALLOWED' AND robots_status IN ('ALLOWED', 'NOT_APPLICABLE')
    AND reviewed_at IS NOT NULL AND reviewed_by IS NOT NULL)
UNION ALL SELECT 'run', CAST(id AS VARCHAR), 'run_finished' FROM m_crawl_run WHERE (status = 'RUNNING') <> (finished_at IS NULL)
UNION ALL SELECT 'excerpt', CAST(doc_id AS VARCHAR), 'excerpt_length' FROM documents WHERE length(text) > 1000
UNION ALL SELECT 'excerpt', CAST(doc_id AS VARCHAR), 'excerpt_not_blank' FROM documents WHERE trim(text) = ''
UNION ALL SELECT 'image', CAST(id AS VARCHAR), 'image_scheme' FROM m_image WHERE id % 7 = 2
UNION ALL SELECT 'signal', CAST(event_id AS VARCHAR), 'signal_axis_value' FROM events WHERE event_id % 17 = 0 AND event_id % 3 <> 0
UNION ALL SELECT 'signal', CAST(event_id AS VARCHAR), 'signal_price' FROM events WHERE event_id % 3 = 2 AND event_id % 19 = 0 AND value IS NOT NULL""")
def _(c):
    bent_price = F.when(F.col("price_min") >= 90000, F.col("price_min") - 1).otherwise(F.col("price_max"))
    tables = {
        "product": (c.product.withColumn("payload_kg", F.col("payload_kg") - 5).withColumn("runtime_minutes", F.col("runtime_minutes") - 60), audits.PRODUCT_CHECKS, "id"),
        "pricing": (c.pricing.withColumn("price_max", bent_price), audits.PRICING_CHECKS, "id"),
        "source": (c.source, audits.SOURCE_CHECKS, "key"),
        "run": (crawl_runs(c), audits.RUN_CHECKS, "id"),
        "excerpt": (c.table("documents").withColumn("excerpt_text", F.col("text")), audits.EXCERPT_CHECKS, "doc_id"),
        "image": (c.image.withColumn("image_url", F.when(F.col("id") % 7 == 2, F.concat(F.lit("data:"), "image_url")).otherwise(F.col("image_url"))), audits.IMAGE_CHECKS, "id"),
        "signal": (signals(c), audits.SIGNAL_CHECKS, "id"),
    }
    return audits.check_violations(tables)


# The columns that tell current offers apart; a missing variant, provider or region is a value of its own.
OFFER_KEY = ["product_id", "variant_id", "provider_id", "region_id", "transaction_type"]
SPEC_KEY = ["product_id", "variant_id", "key"]


def _key_sql(kind: str, table: str, key: list[str], where: str) -> str:
    detail = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in key[1:]) or "''"
    return f"SELECT '{kind}' AS key_of, product_id, concat_ws('|', {detail}) AS detail, count(*) AS n FROM {table} WHERE {where} GROUP BY {', '.join(key)} HAVING count(*) > 1"


@query("unique_audit", " UNION ALL ".join([
    _key_sql("availability", "m_availability", OFFER_KEY, "is_current"), _key_sql("pricing", "m_pricing", OFFER_KEY, "is_current"),
    _key_sql("specification", "(SELECT * REPLACE (NULL AS variant_id) FROM m_typed_spec)", SPEC_KEY, "true"), _key_sql("primary_image", "m_image", ["product_id"], "is_primary")]))
def _(c):
    """Specifications are given without their variant, a fault that makes the editions' entries collide.

    Their rows come several to a line of a narrow file and pack tightly, so they are dealt out by product before they fold, by a
    number that adaptive execution does not merge: tasks sized by packed bytes would hold millions of keys. One product has few.
    """
    def named(kind, rows, key):
        detail = [F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in key[1:]] or [F.lit("")]
        return rows.select(F.lit(kind).alias("key_of"), "product_id", F.concat_ws("|", *detail).alias("detail"), "n")

    flat = c.specification.select("product_id", F.lit(None).cast("string").alias("variant_id"), "key").repartition(int(c.spark.conf.get("spark.sql.shuffle.partitions")), "product_id")
    parts = [
        named("availability", audits.duplicate_keys(c.availability, OFFER_KEY, "is_current"), OFFER_KEY),
        named("pricing", audits.duplicate_keys(c.pricing, OFFER_KEY, "is_current"), OFFER_KEY),
        named("specification", audits.duplicate_keys(flat, SPEC_KEY), SPEC_KEY),
        named("primary_image", audits.duplicate_keys(c.image, ["product_id"], "is_primary"), ["product_id"]),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("lineage_audit", """
SELECT l.id, concat_ws('|', CASE WHEN g.run_id <> l.run_id THEN 'page_of_other_run' END, CASE WHEN g.source <> l.source THEN 'page_of_other_source' END,
  CASE WHEN r.source <> l.source THEN 'run_of_other_source' END) AS problems
FROM m_lineage_row l LEFT JOIN m_fetched_page g ON g.id = l.page_id LEFT JOIN m_crawl_run r ON r.id = l.run_id
WHERE g.run_id <> l.run_id OR g.source <> l.source OR r.source <> l.source""")
def _(c):
    return audits.lineage_violations(lineage_rows(c), crawl_runs(c), fetched_pages(c)).select("id", F.array_join("problems", "|").alias("problems"))


def excerpts(c: Catalog):
    k = F.col("doc_id")
    kind = F.when(k % 3 == 0, "CLAIM").when(k % 3 == 1, "COMMERCIAL_SIGNAL").otherwise("IMAGE_REF")
    return c.table("documents").select(
        k.alias("id"), kind.alias("subject_type"), F.when(k % 14 == 0, k + 10_000_000).otherwise(F.floor(k / 4)).cast("string").alias("subject_id"), "source"
    )


@query("excerpt_audit", """
WITH s AS (SELECT 'CLAIM' AS subject_type, CAST(id AS VARCHAR) AS subject_id, source FROM m_claim
  UNION ALL SELECT 'COMMERCIAL_SIGNAL', CAST(id AS VARCHAR), source FROM m_crawl_run
  UNION ALL SELECT 'IMAGE_REF', CAST(id AS VARCHAR), CASE WHEN id % 5 <> 0 THEN source END FROM m_fetched_page),
x AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'CLAIM' WHEN 1 THEN 'COMMERCIAL_SIGNAL' ELSE 'IMAGE_REF' END AS subject_type,
    CAST(CASE WHEN doc_id % 14 = 0 THEN doc_id + 10000000 ELSE doc_id // 4 END AS VARCHAR) AS subject_id, source FROM documents)
SELECT x.id, CASE WHEN s.subject_id IS NULL THEN 'no_such_subject' WHEN s.source IS NULL THEN 'subject_without_source' ELSE 'other_source' END AS problem
FROM x LEFT JOIN s USING (subject_type, subject_id) WHERE s.subject_id IS NULL OR s.source IS NULL OR s.source <> x.source""")
def _(c):
    pages = fetched_pages(c)
    subjects = {
        "CLAIM": c.claim, "COMMERCIAL_SIGNAL": crawl_runs(c),
        "IMAGE_REF": pages.withColumn("source", F.when(F.col("id") % 5 != 0, F.col("source"))),
    }
    return audits.excerpt_violations(excerpts(c), subjects)
