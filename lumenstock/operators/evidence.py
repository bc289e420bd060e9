"""Provenance: which evidence stands for each commercial fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.ranking import first_per_key

EVIDENCE_COLUMNS = ["evidence_id", "source_type", "confidence", "observed_at", "verified_at", "source_url"]
# Subject classes whose evidence a reference may address.
RESOLVABLE_SUBJECTS = ["COMMERCIAL_STATUS", "PRICING_OFFER", "AVAILABILITY_OFFER", "DEPLOYMENT"]


def best_evidence(evidence: DataFrame, columns: list[str] = EVIDENCE_COLUMNS) -> DataFrame:
    """One row per subject: verified first, then newest observation, then greatest id.

    Only the given columns enter the fold: with texts among them it sorts its rows, so a task's memory follows their width.
    """
    rank = {"observed_at": F.col("observed_at"), "evidence_id": F.col("id")}
    rest = [c for c in columns if c not in rank]
    packed = F.struct(F.col("verified_at").isNotNull().alias("_v"), *[v.alias(c) for c, v in rank.items()], *rest)
    best = evidence.groupBy("subject_type", "subject_id").agg(F.max(packed).alias("_best"))
    return best.select("subject_type", "subject_id", *[F.col(f"_best.{c}").alias(c) for c in columns])


def commercial_facts(pricing: DataFrame, availability: DataFrame, deployments: DataFrame) -> DataFrame:
    """Current prices, current availability and deployments as one table of evidenced subjects."""
    parts = [
        pricing.filter("is_current").select(
            F.lit("PRICING_OFFER").alias("subject_type"), F.col("id").alias("subject_id"), "product_id",
            "transaction_type", "region_id", F.col("price_type").alias("detail"),
        ),
        availability.filter("is_current").select(
            F.lit("AVAILABILITY_OFFER").alias("subject_type"), F.col("id").alias("subject_id"), "product_id",
            "transaction_type", "region_id", F.col("availability_status").alias("detail"),
        ),
        deployments.select(
            F.lit("DEPLOYMENT").alias("subject_type"), F.col("id").alias("subject_id"), "product_id",
            F.lit(None).cast("string").alias("transaction_type"), F.lit(None).cast("int").alias("region_id"),
            F.lit("Undisclosed customer").alias("detail"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def facts_with_evidence(facts: DataFrame, best: DataFrame) -> DataFrame:
    """Each fact with its best evidence; a fact without any keeps NULLs, none is made up."""
    return facts.join(best, ["subject_type", "subject_id"], "left")


def effective_confidence() -> Column:
    """VERIFIED counts only with a verification date; otherwise it is HIGH."""
    stated = F.col("confidence")
    return F.when((stated == "VERIFIED") & F.col("verified_at").isNull(), "HIGH").otherwise(stated)


def strongest_confidence(facts: DataFrame) -> DataFrame:
    rated = facts.withColumn("_c", effective_confidence())
    return rated.groupBy("product_id").agg(
        F.max_by("_c", vocab.ordinal(F.col("_c"), vocab.CONFIDENCE)).alias("strongest_confidence")
    )


def evidence_ledger(facts: DataFrame, region: DataFrame, mode_labels: dict[str, str]) -> DataFrame:
    """One labelled row per evidenced fact."""
    codes = region.select(F.col("id").alias("region_id"), "code")
    head = vocab.lookup(
        F.col("subject_type"),
        {"PRICING_OFFER": "Price", "AVAILABILITY_OFFER": "Availability", "DEPLOYMENT": "Deployment"}, None,
    )
    mode = vocab.lookup(F.col("transaction_type"), mode_labels, None)
    tail = F.concat_ws(" · ", mode, "code", "detail")
    return (
        facts.filter("evidence_id IS NOT NULL").join(codes, "region_id", "left")
        .select("product_id", "subject_id", F.concat_ws(" — ", head, tail).alias("subject"),
                F.concat(F.lit("SUBJECT: "), "subject_type").alias("subject_code"),
                effective_confidence().alias("confidence"), "evidence_id")
    )


def _subjects(products, pricing, availability, deployments) -> DataFrame:
    def offers(kind, df):
        return df.select(F.lit(kind).alias("subject_type"), F.col("id").alias("subject_id"), "product_id")

    own = products.select(
        F.lit("COMMERCIAL_STATUS").alias("subject_type"), F.col("id").cast("string").alias("subject_id"),
        F.col("id").alias("product_id"),
    )
    parts = [own, offers("PRICING_OFFER", pricing), offers("AVAILABILITY_OFFER", availability), offers("DEPLOYMENT", deployments)]
    return reduce(DataFrame.unionByName, parts)


def freshest_evidence(products, pricing, availability, deployments, evidence) -> DataFrame:
    """Latest verification of each product over itself, all its offers and its deployments."""
    stamps = evidence.filter("verified_at IS NOT NULL").groupBy("subject_type", "subject_id").agg(
        F.max("verified_at").alias("verified_at")
    )
    subjects = _subjects(products, pricing, availability, deployments)
    return subjects.join(stamps, ["subject_type", "subject_id"]).groupBy("product_id").agg(
        F.max("verified_at").alias("freshest_verified_at")
    )


def backfill_evidence(products, pricing, availability, deployments, evidence) -> DataFrame:
    """Baseline rows for every published fact that has no evidence yet."""
    live = products.filter("is_published").select(F.col("id").alias("product_id"))
    kinds = pricing.select(F.lit("PRICING_OFFER").alias("subject_type"), F.col("id").alias("subject_id"), "price_type")
    facts = _subjects(products, pricing, availability, deployments).join(live, "product_id", "left_semi")
    missing = facts.join(evidence, ["subject_type", "subject_id"], "left_anti").join(kinds, ["subject_type", "subject_id"], "left")
    estimated = F.coalesce(F.col("price_type") == "ESTIMATED", F.lit(False))
    return missing.select(
        "subject_type", "subject_id",
        F.when(estimated | (F.col("subject_type") == "DEPLOYMENT"), "NEWS_ARTICLE").otherwise("MANUFACTURER_SITE").alias("source_type"),
        F.when(estimated, "LOW").otherwise("MEDIUM").alias("confidence"),
    )


def issue_ref(evidence_id: Column, secret: str, key_id: str) -> Column:
    """Opaque stable reference to one evidence row."""
    return F.concat(F.lit(_ref_head(key_id)), _ref_digest(evidence_id, secret))


def _ref_head(key_id: str) -> str:
    return f"er1.{key_id}."


def _ref_digest(evidence_id: Column, secret: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), evidence_id), 256)


def resolve_evidence(tokens, evidence, products, pricing, availability, deployments, secret: str, key_id: str) -> DataFrame:
    """Tokens that address evidence whose subject is served today; all others resolve to nothing.

    The owning product must be published now and an offer must still be current.
    """
    live = products.filter("is_published").select(F.col("id").alias("product_id"))
    reachable = _subjects(products, pricing.filter("is_current"), availability.filter("is_current"), deployments).join(
        live, "product_id", "left_semi"
    )
    issued = evidence.filter(F.col("subject_type").isin(RESOLVABLE_SUBJECTS))
    found = issued.join(reachable.select("subject_type", "subject_id"), ["subject_type", "subject_id"], "left_semi").select(
        F.col("id").alias("evidence_id"), "subject_type", "subject_id")
    # A token as this key issues it travels as its 32 bytes; any other is spread by its own digest and meets nothing.
    # Evidence travels without its digest, which is made from its id where it is compared.
    head, token = _ref_head(key_id), F.col("token")
    tail = token.substr(len(head) + 1, 2**30)
    ours = token.startswith(head) & tail.rlike("\\A[0-9a-f]{64}\\z")
    asked = tokens.select(F.unhex(F.when(ours, tail).otherwise(F.sha2(token, 256))).alias("_asked"), F.when(~ours, token).alias("_other"))
    met = asked.join(found, (F.col("_asked") == F.unhex(_ref_digest(F.col("evidence_id"), secret))) & F.col("_other").isNull(), "left")
    return met.select(
        F.coalesce("_other", F.concat(F.lit(head), F.lower(F.hex("_asked")))).alias("token"), "evidence_id", "subject_type", "subject_id",
        F.when(F.col("evidence_id").isNull(), "UNRESOLVED").otherwise("RESOLVED").alias("outcome"))
