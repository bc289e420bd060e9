"""Nested product documents and reference lists as DataFrames, and what an import does with them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab

EVIDENCE = (
    "ARRAY<STRUCT<source_url STRING, source_type STRING, source_title STRING, excerpt STRING, published_at DATE, "
    "observed_at DATE, verified_at DATE, confidence STRING, note STRING>>"
)
SPECS = (
    "STRUCT<height_cm DECIMAL(6,1), weight_kg DECIMAL(6,1), arm_span_cm DECIMAL(6,1), reach_cm DECIMAL(6,1), payload_kg DECIMAL(6,1), "
    "walk_speed_ms DECIMAL(5,2), runtime_minutes INT, battery_wh DECIMAL(8,1), mobility STRING, degrees_of_freedom INT, hand_type STRING, "
    "hand_dof INT, autonomy STRING, has_manipulation BOOLEAN, has_teleoperation BOOLEAN, has_vision BOOLEAN, has_language_ui BOOLEAN, "
    "has_sdk BOOLEAN, has_api BOOLEAN, ros_support BOOLEAN, developer_edition BOOLEAN, simulation_support BOOLEAN>"
)
PRODUCT_SCHEMA = f"""
slug STRING, name STRING, manufacturer_slug STRING, model_code STRING, summary STRING, announced_year INT, commercial_status STRING,
is_published BOOLEAN, specs_note STRING, official_url STRING, specs {SPECS}, commercial_status_evidence {EVIDENCE},
variants ARRAY<STRUCT<slug STRING, name STRING, description STRING, is_developer BOOLEAN>>,
pricing_offers ARRAY<STRUCT<transaction_type STRING, price_type STRING, currency STRING, price DECIMAL(14,2), price_min DECIMAL(14,2),
  price_max DECIMAL(14,2), billing_period STRING, region_code STRING, provider_slug STRING, variant_slug STRING, note STRING, evidence {EVIDENCE}>>,
availability_offers ARRAY<STRUCT<transaction_type STRING, availability_status STRING, region_code STRING, provider_slug STRING, variant_slug STRING,
  available_from DATE, lead_time_days INT, min_order_qty INT, note STRING, evidence {EVIDENCE}>>,
deployments ARRAY<STRUCT<provider_slug STRING, customer_name STRING, region_code STRING, use_case_slug STRING, transaction_type STRING, unit_count INT,
  contract_value DECIMAL(16,2), contract_currency STRING, started_on DATE, status STRING, summary STRING, evidence {EVIDENCE}>>,
capabilities ARRAY<STRUCT<slug STRING, supported BOOLEAN, detail STRING>>,
use_case_fits ARRAY<STRUCT<use_case_slug STRING, fit_score DECIMAL(4,3), is_primary BOOLEAN, commercial_readiness STRING, notes STRING, limitations STRING>>,
images ARRAY<STRUCT<image_url STRING, source_url STRING, source_name STRING, source_type STRING, image_type STRING, identity_status STRING,
  rights_status STRING, usage_basis STRING, is_official BOOLEAN, is_primary BOOLEAN, attribution STRING, captured_at DATE, last_verified_at TIMESTAMP>>
"""
# Element fields of each reference list.
DIMENSION_SCHEMAS = {
    "regions": "code STRING, type STRING, name STRING, iso_country STRING, parent_code STRING",
    "manufacturers": "slug STRING, name STRING, legal_name STRING, country_region_code STRING, website_url STRING, founded_year INT, description STRING, "
                     f"target_markets ARRAY<STRING>, commercial_model STRING, deployment_status STRING, is_public_company BOOLEAN, ticker STRING, evidence {EVIDENCE}",
    "providers": "slug STRING, type STRING, name STRING, manufacturer_slug STRING, country_region_code STRING, website_url STRING, description STRING",
    "capabilities": "slug STRING, name STRING, category STRING, description STRING",
    "use_cases": "slug STRING, name STRING, category STRING, description STRING, typical_tasks ARRAY<STRING>",
}
CANDIDATE_SCHEMA = """
external_ref STRING, entity_type STRING, name STRING, manufacturer STRING, discovery_url STRING, data STRUCT<official_url STRING>,
claims ARRAY<STRUCT<field_key STRING, claimed_value STRING, unit STRING, evidence_url STRING>>, images ARRAY<STRUCT<image_url STRING, credited_to STRING>>
"""
# Child lists of a product document and the evidence subject each row is.
CHILDREN = {
    "variants": None, "pricing_offers": "PRICING_OFFER", "availability_offers": "AVAILABILITY_OFFER", "deployments": "DEPLOYMENT",
    "capabilities": None, "use_case_fits": None, "images": None,
}
# What an absent field of a child means.
CHILD_DEFAULTS = {
    "pricing_offers": {"currency": "USD", "billing_period": "ONE_TIME"}, "availability_offers": {"availability_status": "ON_REQUEST"},
}


def read_products(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Product documents, one JSON object per file (or per line); an absent key is NULL."""
    return spark.read.schema(PRODUCT_SCHEMA).option("multiLine", multi_line).json(path)


def read_dimension(spark: SparkSession, path: str, array_key: str, multi_line: bool = True) -> DataFrame:
    """Elements of a reference list stored as one wrapper object holding one array."""
    schema = f"{array_key} ARRAY<STRUCT<{DIMENSION_SCHEMAS[array_key]}>>"
    return spark.read.schema(schema).option("multiLine", multi_line).json(path).select(F.explode(array_key).alias("e")).select("e.*")


def read_candidates(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(CANDIDATE_SCHEMA).option("multiLine", multi_line).json(path)


def child_id(slug: Column, kind: str | Column, position: Column) -> Column:
    """Stable id of a child row: the same document always yields the same ids."""
    return F.sha2(F.concat_ws("|", slug, F.lit(kind), position.cast("string")), 256)


def flatten_products(docs: DataFrame) -> dict[str, DataFrame]:
    """Products and their child rows, each child with id, parent slug, position and filled defaults."""
    specs = docs.select("slug", "name", "manufacturer_slug", "model_code", "summary", "announced_year",
                        F.coalesce("commercial_status", F.lit("UNKNOWN")).alias("commercial_status"), "is_published", "specs_note",
                        "official_url", "specs.*", F.col("commercial_status_evidence").alias("evidence"))
    out = {"products": specs}
    for kind in CHILDREN:
        if kind not in docs.columns:
            continue
        rows = docs.select(F.col("slug").alias("product_slug"), F.posexplode(kind).alias("position", "c")).select("product_slug", "position", "c.*")
        for name, value in CHILD_DEFAULTS.get(kind, {}).items():
            rows = rows.withColumn(name, F.coalesce(name, F.lit(value)))
        out[kind] = rows.withColumn("id", child_id(F.col("product_slug"), kind, F.col("position")))
    return out


def explode_evidence(children: dict[str, DataFrame]) -> DataFrame:
    """Every fact's evidence list as rows of (subject_type, subject_id); confidence defaults to MEDIUM."""
    parts = []
    for kind, df in children.items():
        subject = "COMMERCIAL_STATUS" if kind == "products" else CHILDREN.get(kind)
        if subject is None:
            continue
        key = F.col("slug") if kind == "products" else F.col("id")
        parts.append(df.select(F.lit(subject).alias("subject_type"), key.alias("subject_id"), F.explode("evidence").alias("e")).select("subject_type", "subject_id", "e.*"))
    return reduce(DataFrame.unionByName, parts).withColumn("confidence", F.coalesce("confidence", F.lit("MEDIUM")))


def children(docs: DataFrame, shapes: dict[str, Callable[[Callable[[str], Column]], list[Column]]]) -> DataFrame:
    """(product_slug, kind, position, *fields) of several child lists in one pass over the documents.

    `shapes` gives the fields of each kind from a function that reads a child's field with its default filled; names
    and types agree over the kinds. The outer explode keeps Spark from testing the lists in a filter of its own below,
    which would parse each document once more for every test.
    """
    def listed(kind, shape):
        default = CHILD_DEFAULTS.get(kind, {})
        read = lambda c: lambda name: F.coalesce(c[name], F.lit(default[name])) if name in default else c[name]
        return F.transform(kind, lambda c, i: F.struct(F.lit(kind).alias("kind"), i.alias("position"), *shape(read(c))))

    lists = F.flatten(F.array_compact(F.array(*[listed(kind, shape) for kind, shape in shapes.items() if kind in docs.columns])))
    rows = docs.select(F.col("slug").alias("product_slug"), F.explode_outer(lists).alias("c")).where("c IS NOT NULL")
    return rows.select("product_slug", "c.*")


def document_evidence(docs: DataFrame) -> DataFrame:
    """The rows of `explode_evidence` over all parts of the documents, in one pass."""
    head = "commercial_status_evidence"
    if head in docs.columns:
        docs = docs.withColumn(head, F.array(F.struct(F.col(head).alias("evidence"))))
    subjects = {head: "COMMERCIAL_STATUS"} | {kind: subject for kind, subject in CHILDREN.items() if subject}
    rows = children(docs, {kind: lambda read: [read("evidence").alias("evidence")] for kind in subjects})
    subject_id = F.when(F.col("kind") == head, F.col("product_slug")).otherwise(child_id(F.col("product_slug"), F.col("kind"), F.col("position")))
    rows = rows.select("*", F.explode("evidence").alias("e"))
    return rows.select(vocab.lookup(F.col("kind"), subjects, None).alias("subject_type"), subject_id.alias("subject_id"), "e.*").withColumn(
        "confidence", F.coalesce("confidence", F.lit("MEDIUM")))


# ---- writing into stored tables ------------------------------------------------------------------

def upsert(target: DataFrame, source: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Target with the source's rows inserted, and `cols` updated where the key is already there."""
    mark = source.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = target.withColumn("_old", F.lit(True)).join(mark, F.col(key) == F.col("_k"), "full_outer")
    picked = [
        F.coalesce(key, "_k").alias(key) if c == key
        else F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
        for c in target.columns
    ]
    return joined.select(*picked)


def replace_children(target: DataFrame, source: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Target without any child of the parents in the batch, plus the batch's own children."""
    return target.join(parents.select(key).distinct(), key, "left_anti").unionByName(source)


def merge_published(existing: DataFrame, incoming: DataFrame, apply_state: bool = False) -> DataFrame:
    """Incoming products with the editorial state kept: publication is set on first insert only."""
    stored = existing.select("slug", F.col("is_published").alias("_stored"))
    kept = F.when(F.col("_stored").isNotNull() & F.lit(not apply_state), F.col("_stored")).otherwise(F.coalesce("is_published", F.lit(False)))
    return incoming.join(stored, "slug", "left").withColumn("is_published", kept).drop("_stored")


def resolve_refs(df: DataFrame, dim: DataFrame, code_col: str, dim_code: str = "code") -> tuple[DataFrame, DataFrame]:
    """(ok, rejected): adds `<code_col>_id`. An absent code stays NULL; an unknown code is set aside."""
    ids = dim.select(F.col(dim_code).alias(code_col), F.col("id").alias(f"{code_col}_id"))
    joined = df.join(ids, code_col, "left")
    lost = F.col(code_col).isNotNull() & F.col(f"{code_col}_id").isNull()
    return joined.filter(~lost), joined.filter(lost)
