"""Integrity rules as queries: each returns the offending rows, and none on clean data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HTTP_PATTERN


def evidence_gaps(products, pricing, availability, deployments, evidence) -> DataFrame:
    """Published commercial facts without evidence. An UNKNOWN status asserts nothing and needs none."""
    live = products.filter("is_published").select(F.col("id").alias("product_id"), "slug", "commercial_status")
    status = live.filter(F.col("commercial_status") != "UNKNOWN").select(
        F.lit("COMMERCIAL_STATUS").alias("subject_type"), F.col("product_id").cast("string").alias("subject_id"), "slug"
    )

    def facts(kind, df):
        return df.join(live, "product_id").select(F.lit(kind).alias("subject_type"), F.col("id").alias("subject_id"), "slug")

    parts = [status, facts("PRICING_OFFER", pricing), facts("AVAILABILITY_OFFER", availability), facts("DEPLOYMENT", deployments)]
    return reduce(DataFrame.unionByName, parts).join(evidence, ["subject_type", "subject_id"], "left_anti")


def image_gaps(images: DataFrame) -> DataFrame:
    """Images that look displayable but lack a source, or the credit they owe.

    Deliberately the looser eligibility without the credit rule, so a missing credit shows up.
    """
    rights = F.col("rights_status")
    loose = (F.col("identity_status") == "VERIFIED") & (rights != "RESTRICTED") & (
        rights.isin("PERMITTED", "ATTRIBUTION_REQUIRED") | (F.col("usage_basis") == "OFFICIAL_MANUFACTURER_MEDIA")
    )
    gap = F.array_compact(F.array(
        F.when(F.col("source_url").isNull(), F.lit("no_source_url")), F.when(F.col("source_name").isNull(), F.lit("no_source_name")),
        F.when((rights == "ATTRIBUTION_REQUIRED") & F.col("attribution").isNull(), F.lit("no_attribution")),
    ))
    return images.filter(loose).withColumn("gaps", gap).filter(F.size("gaps") > 0)


def _lanes(row: Column) -> list[Column]:
    """Four numbers below 2**60 of a row's hash."""
    return [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]


def _compared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the rows of each side, and whether both hold the same ones in any order.

    Signed sums and XOR of parts of the row hashes are zero where the sides agree, so one pass folds both of them.
    """
    lanes = _lanes(F.col("_row"))
    signed = lambda lane: F.sum(F.when(F.col("_before"), lane).otherwise(-lane))
    folded = rows.groupBy(*keys).agg(
        F.count_if("_before").alias("_was"), F.count_if(~F.col("_before")).alias("_is"), signed(lanes[0]).alias("_s0"), signed(lanes[1]).alias("_s1"),
        F.bit_xor(lanes[2].cast("long")).alias("_x2"), F.bit_xor(lanes[3].cast("long")).alias("_x3"))
    same = (F.col("_was") == F.col("_is")) & (F.col("_s0") == 0) & (F.col("_s1") == 0) & (F.col("_x2") == 0) & (F.col("_x3") == 0)
    return folded.select(*keys, "_was", "_is", same.alias("_same"))


def append_only_violations(before: DataFrame, after: DataFrame, key: list[str], bucket: Column | None = None) -> DataFrame:
    """Keys of an append-only log whose rows a later snapshot lost or changed; a NULL in a key is a value of its own.

    Both snapshots fold by key in one pass; where both are dealt out by that key already, nothing moves. `bucket` is a
    NULL-free function of the key: then both fold to one digest per bucket first, and only rows of buckets of `before` whose
    digests differ are folded by key. For a log that grows at its end, name its day, so that new rows touch no old bucket.
    """
    content = lambda df: F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    mark = [] if bucket is None else [bucket.alias("_bucket")]
    hashed = lambda df, side: df.select(*key, *mark, content(df).alias("_row"), F.lit(side).alias("_before"))
    rows = hashed(before, True).unionByName(hashed(after, False))
    if bucket is not None:
        rows = rows.join(_compared(rows, ["_bucket"]).filter("_was > 0 AND NOT _same").select("_bucket"), "_bucket", "left_semi")
    verdict = F.when(F.col("_is") == 0, "missing").otherwise("changed")
    return _compared(rows, key).filter("_was > 0 AND NOT _same").select(*key, verdict.alias("violation"))


def _known(cond: Column) -> Column:
    """A CHECK passes on NULL, so only a known false is a violation."""
    return ~F.coalesce(cond, F.lit(True))


def price_shape() -> Column:
    kind, null = F.col("price_type"), lambda c: F.col(c).isNull()
    quote = (kind == "QUOTE_ONLY") & null("price") & null("price_min") & null("price_max")
    span = (kind == "RANGE") & null("price") & ~null("price_min") & ~null("price_max") & (F.col("price_max") >= F.col("price_min"))
    point = kind.isin("PUBLIC", "FROM", "ESTIMATED") & ~null("price") & null("price_min") & null("price_max")
    return quote | span | point


PRODUCT_CHECKS = {
    "height_positive": lambda: F.col("height_cm") > 0, "weight_positive": lambda: F.col("weight_kg") > 0,
    "payload_not_negative": lambda: F.col("payload_kg") >= 0, "speed_not_negative": lambda: F.col("walk_speed_ms") >= 0,
    "runtime_not_negative": lambda: F.col("runtime_minutes") >= 0, "dof_not_negative": lambda: F.col("degrees_of_freedom") >= 0,
}
PRICING_CHECKS = {"price_type_shape": price_shape}
SOURCE_CHECKS = {
    "source_eligible": lambda: ~F.col("is_enabled") | (
        (F.col("tos_status") == "ALLOWED") & F.col("robots_status").isin("ALLOWED", "NOT_APPLICABLE")
        & F.col("reviewed_at").isNotNull() & F.col("reviewed_by").isNotNull()),
}
RUN_CHECKS = {"run_finished": lambda: (F.col("status") == "RUNNING") == F.col("finished_at").isNull()}
EXCERPT_CHECKS = {
    "excerpt_length": lambda: F.char_length("excerpt_text") <= 1000, "excerpt_not_blank": lambda: F.trim("excerpt_text") != "",
}
IMAGE_CHECKS = {"image_scheme": lambda: F.lower("image_url").rlike(HTTP_PATTERN)}
SIGNAL_CHECKS = {
    "signal_axis_value": lambda: (
        ((F.col("axis") == "MATURITY") & F.col("availability_value").isNull() & F.col("price_type").isNull())
        | ((F.col("axis") == "OBTAINABILITY") & F.col("maturity_value").isNull() & F.col("price_type").isNull())
        | ((F.col("axis") == "PRICE") & F.col("maturity_value").isNull() & F.col("availability_value").isNull())),
    "signal_price": lambda: F.col("price_amount").isNull() | (F.col("price_currency").isNotNull() & F.col("price_type").isNotNull()),
}


def violations(table: str, df: DataFrame, checks: dict, key: str = "id") -> DataFrame:
    """(table, row, check) for every named predicate a row is known to fail. One scan for all checks."""
    failed = F.array_compact(F.array(*[F.when(_known(check()), F.lit(name)) for name, check in checks.items()]))
    return df.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("row"), F.explode(failed).alias("check"))


def check_violations(tables: dict[str, tuple[DataFrame, dict, str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [violations(name, *spec) for name, spec in tables.items()])


def duplicate_keys(df: DataFrame, keys: list[str], where: str | None = None) -> DataFrame:
    """Keys held by more than one row; NULLs count as equal, as the unique indexes have it."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def lineage_violations(rows: DataFrame, runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows whose run, page and source do not agree. `rows`: id, run_id, page_id, source."""
    page = pages.select(F.col("id").alias("page_id"), F.col("run_id").alias("_page_run"), F.col("source").alias("_page_source"))
    run = runs.select(F.col("id").alias("run_id"), F.col("source").alias("_run_source"))
    problems = F.array_compact(F.array(
        F.when(F.col("_page_run") != F.col("run_id"), F.lit("page_of_other_run")),
        F.when(F.col("_page_source") != F.col("source"), F.lit("page_of_other_source")),
        F.when(F.col("_run_source") != F.col("source"), F.lit("run_of_other_source")),
    ))
    return rows.join(page, "page_id", "left").join(run, "run_id", "left").withColumn("problems", problems).filter(
        F.size("problems") > 0
    ).select("id", "problems")


def excerpt_violations(excerpts: DataFrame, subjects: dict[str, DataFrame]) -> DataFrame:
    """Excerpts whose subject is absent, has no source, or has another source.

    `subjects`: subject type to a table with (id, source).
    """
    parts = [df.select(F.lit(kind).alias("subject_type"), F.col("id").cast("string").alias("subject_id"),
                       F.col("source").alias("_subject_source"), F.lit(True).alias("_found")) for kind, df in subjects.items()]
    problem = (
        F.when(F.col("_found").isNull(), "no_such_subject").when(F.col("_subject_source").isNull(), "subject_without_source")
        .when(F.col("_subject_source") != F.col("source"), "other_source")
    )
    joined = excerpts.join(reduce(DataFrame.unionByName, parts), ["subject_type", "subject_id"], "left")
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select("id", "problem")
