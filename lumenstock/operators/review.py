"""A reviewed worksheet applied: traces, rejections, promotions, outcomes and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stage import materialize
from .discovery import apply_decisions, candidate_status, reject, validate_worksheet
from .promotion import promotion_gates, write_promotions

OUTCOMES = ["confirmed", "promoted", "rejected", "blocked", "skipped"]
DEFAULT_TRACE_TYPE = "MANUFACTURER_SITE"


def record_traces(candidates: DataFrame, confirmed: DataFrame, verified_by: str, verified_on: Column) -> DataFrame:
    """Candidates a reviewer confirmed, with that trace. `confirmed`: id, sheet_url, sheet_type."""
    kept = candidates.drop("trace_state", "trace_url", "trace_verified_by", "trace_source_type", "trace_verified_at", "updated_at")
    return kept.join(confirmed, "id").withColumns({
        "trace_state": F.lit("TRACE_CONFIRMED"), "trace_url": F.trim("sheet_url"),
        "trace_source_type": F.coalesce(text.clean(F.col("sheet_type")), F.lit(DEFAULT_TRACE_TYPE)),
        "trace_verified_by": F.lit(verified_by), "trace_verified_at": verified_on, "updated_at": verified_on,
    }).drop("sheet_url", "sheet_type")


def apply_worksheet(
    sheet: DataFrame, model: dict[str, DataFrame], reviewed_by: str, reviewed_on: Column, promote_confirmed: bool = True,
) -> dict[str, DataFrame]:
    """Everything one reviewed worksheet writes.

    `sheet`: candidate_id, decision, snapshot_hash, trace_url, trace_source_type, reject_reason.
    `model`: candidates (with identity), claims, products, makers, rechecks (candidate_id).
    Returns products, makers, fields, evidence and audit (promotions and rejections), `outcomes`
    (candidate_id, outcome, why), `totals` (one row) and `candidates` as they are afterwards.

    A worksheet with any row that could not be applied truthfully is refused as a whole, and so is
    one without a named reviewer. A trace stands even where a gate then refuses the promotion: such
    a row is confirmed and blocked. Applying the worksheet again to the returned candidates writes
    nothing: closed ones are skipped, and the others have changed since the export.
    """
    reviewer = (reviewed_by or "").strip()
    if not reviewer:
        raise ValueError("a review needs a named reviewer")
    sheet = materialize(sheet, "sheet")
    if not validate_worksheet(sheet).isEmpty():
        raise ValueError("the worksheet has rows that cannot be applied; see validate_worksheet")
    candidates, claims = materialize(model["candidates"], "people"), model["claims"]
    verdicts, _ = apply_decisions(sheet, candidates)
    notes = sheet.select("candidate_id", F.col("trace_url").alias("sheet_url"), F.col("trace_source_type").alias("sheet_type"), "reject_reason")
    judged = materialize(verdicts.join(notes, "candidate_id"), "judged")

    confirmed = judged.filter("outcome = 'confirmed'").select(F.col("candidate_id").alias("id"), "sheet_url", "sheet_type")
    clashes = claims.filter("claim_status = 'CONFLICT'").select("candidate_id")
    traced = candidate_status(record_traces(candidates, confirmed, reviewer, reviewed_on), clashes, model["rechecks"])
    traced = traced.withColumn("status", F.col("next_status")).drop("next_status")
    gated = materialize(promotion_gates(traced, claims).withColumn("approved_by", F.lit(reviewer)), "gated")
    passed = gated.filter((F.size("gates_failed") == 0) & F.lit(promote_confirmed))
    out = write_promotions(passed, claims, model["products"], model["makers"])

    done = materialize(out["audit"], "promotions")
    calls = judged.filter("outcome = 'rejected'").select("candidate_id", F.lit(reviewer).alias("approved_by"), F.col("reject_reason").alias("reason"))
    refusals = reject(candidates, calls)
    out["audit"] = done.withColumn("reason", F.lit(None).cast("string")).unionByName(refusals, allowMissingColumns=True)

    named = lambda df, kind, why: df.select("candidate_id", F.lit(kind).alias("outcome"), why.alias("why"))
    parts = [
        judged.select("candidate_id", "outcome", "why"),
        named(done, "promoted", F.col("product_slug")),
        named(gated.filter((F.size("gates_failed") > 0) & F.lit(promote_confirmed)).withColumnRenamed("id", "candidate_id"), "blocked",
              F.concat(F.lit("PROMOTION:"), F.array_join("gates_failed", "|"))),
    ]
    out["outcomes"] = reduce(DataFrame.unionByName, parts)
    out["totals"] = out["outcomes"].agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])

    closed = done.select(F.col("candidate_id").alias("id"), F.lit("PROMOTED").alias("_end"), F.col("product_key").alias("promoted_product")).unionByName(
        refusals.select(F.col("candidate_id").alias("id"), F.lit("REJECTED").alias("_end")), allowMissingColumns=True)
    touched = gated.select(*traced.columns)
    after = touched.unionByName(candidates.join(touched.select("id"), "id", "left_anti"), allowMissingColumns=True)
    out["candidates"] = after.drop("promoted_product").join(closed, "id", "left").withColumn("status", F.coalesce("_end", "status")).withColumn(
        "updated_at", F.when(F.col("_end").isNotNull(), reviewed_on).otherwise(F.col("updated_at"))).drop("_end")
    return out
