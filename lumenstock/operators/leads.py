"""Buyer intake and leads: normalising answers, capturing interest, routing it to providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..functions.rules import accessible
from .regions import applicable_sets, applies

ANSWER = "state STRING, value STRING, use_case STRING, task_description STRING, currency STRING, min DOUBLE, max DOUBLE"
WIZARD_SCHEMA = f"wizard_version INT, answers MAP<STRING, STRUCT<{ANSWER}>>"
# Schema version of a frozen requirement snapshot.
SNAPSHOT_VERSION = 1
SNAPSHOT_FIELDS = [
    "buyer_type", "use_case", "industry", "task_description", "environment", "country", "payload_min_kg", "operating_hours_day",
    "manipulation_required", "autonomy_required", "budget_currency", "budget_min", "budget_max", "required_by", "preferred_transaction",
]


# ---- requirements ------------------------------------------------------------------------------

def normalize_requirements(raw: DataFrame) -> DataFrame:
    """Wizard JSON (`raw_input`) to typed columns: only ANSWERED answers project, all else stays NULL.

    No currency and no zero is ever filled in; the transaction preference defaults to UNKNOWN.
    """
    parsed = raw.withColumn("_w", F.from_json("raw_input", WIZARD_SCHEMA))

    def answer(name: str, field: str = "value") -> Column:
        a = F.try_element_at(F.col("_w.answers"), F.lit(name))
        return F.when(a["state"] == "ANSWERED", a[field])

    words = lambda name, field="value": text.clean(answer(name, field))
    number = lambda name: words(name).try_cast("double")
    return parsed.select(
        *[c for c in raw.columns],
        words("task", "use_case").alias("use_case"), words("task", "task_description").alias("task_description"),
        words("industry").alias("industry"), words("country").alias("country"), words("environment").alias("environment"),
        number("payload").alias("payload_min_kg"), number("hours").alias("operating_hours_day"),
        words("manipulation").try_cast("boolean").alias("manipulation_required"), words("autonomy").alias("autonomy_required"),
        words("budget", "currency").alias("budget_currency"), answer("budget", "min").alias("budget_min"), answer("budget", "max").alias("budget_max"),
        words("timeline").try_cast("date").alias("required_by"),
        F.coalesce(words("transaction"), F.lit("UNKNOWN")).alias("preferred_transaction"),
    )


def has_signal() -> Column:
    """Some stated fact, a stated preference, or an answer given as ANSWERED or UNKNOWN. SKIPPED is none."""
    facts = [
        "use_case", "task_description", "industry", "country", "environment", "payload_min_kg", "operating_hours_day",
        "manipulation_required", "autonomy_required", "budget_min", "budget_max", "required_by",
    ]
    stated = F.coalesce(*[F.col(c).cast("string") for c in facts]).isNotNull()
    answers = F.map_values(F.from_json("raw_input", WIZARD_SCHEMA)["answers"])
    spoken = F.exists(answers, lambda a: a["state"].isin("ANSWERED", "UNKNOWN"))
    return stated | (F.col("preferred_transaction") != "UNKNOWN") | F.coalesce(spoken, F.lit(False))


def requirement_snapshot() -> Column:
    """Frozen decision context as JSON with every field present; contact identity is not part of it."""
    fields = [F.lit(SNAPSHOT_VERSION).alias("snapshot_version"), *[F.col(c) for c in SNAPSHOT_FIELDS]]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def resolve_requirements(requests: DataFrame, use_cases: DataFrame, region: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected): codes to ids. A stated code that resolves to nothing rejects, it never becomes NULL.

    `requests`: use_case, country (code), product_slug, each optional.
    """
    cases = use_cases.select(F.col("slug").alias("use_case"), F.lit(True).alias("_case"))
    countries = region.filter(F.col("type") == "COUNTRY").select(F.col("code").alias("country"), F.col("id").alias("country_id"))
    live = products.filter("is_published").select(F.col("slug").alias("product_slug"), F.col("id").alias("product_id"))
    rows = requests.join(cases, "use_case", "left").join(countries, "country", "left").join(live, "product_slug", "left")
    lost = lambda code, found: F.col(code).isNotNull() & F.col(found).isNull()
    reasons = F.array_compact(F.array(
        F.when(lost("use_case", "_case"), F.lit("unknown_use_case")), F.when(lost("country", "country_id"), F.lit("unknown_country")),
        F.when(lost("product_slug", "product_id"), F.lit("unknown_or_unpublished_product")),
    ))
    judged = rows.withColumn("reasons", reasons).drop("_case")
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def validate_intake(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected) by the shape of each field; shape only, never proof of delivery."""
    c = F.col
    long_ = lambda name, limit: F.char_length(text.clean(c(name))) > limit
    amounts = c("budget_min").isNotNull() | c("budget_max").isNotNull()
    currency = text.clean(c("budget_currency"))
    checks = {
        "contact_email": ~F.coalesce(F.trim("contact_email"), F.lit("")).rlike(text.EMAIL_PATTERN),
        "contact_name": text.clean(c("contact_name")).isNull() | long_("contact_name", 200),
        "organization": text.clean(c("organization")).isNull() | long_("organization", 300),
        "contact_phone": long_("contact_phone", 40), "message": long_("message", 4000),
        "budget_currency_required": amounts & currency.isNull(),
        "budget_currency": c("budget_currency").isNotNull() & (F.char_length("budget_currency") != 3),
        "budget_order": c("budget_max") < c("budget_min"),
        "budget_negative": (c("budget_min") < 0) | (c("budget_max") < 0),
        "payload_min_kg": c("payload_min_kg") < 0,
        "operating_hours_day": (c("operating_hours_day") < 0) | (c("operating_hours_day") > 24),
        "autonomy_required": ~c("autonomy_required").isin(vocab.AUTONOMY),
        "preferred_transaction": ~c("preferred_transaction").isin(vocab.TRANSACTION_PREFERENCE),
        "required_by": c("required_by").isNotNull() & c("required_by").try_cast("date").isNull(),
    }
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    judged = requests.withColumn("reasons", reasons)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


# ---- capture -----------------------------------------------------------------------------------

def capture_leads(submissions: DataFrame, requirements: DataFrame, matches: DataFrame, products: DataFrame, region: DataFrame):
    """(leads, lead_products, rejected) of a batch of submissions in submission order.

    The first valid submission of a requirement creates its one lead; later ones may restate
    country and preference, fill what is still missing and add selections, never remove one, and
    are refused for another e-mail. A submission without requirement names exactly one product.
    Everything folds by aggregates keyed on the requirement, so a requirement with any number of
    submissions is never gathered in one task.

    `submissions`: id, requirement_id, contact_email, contact_name, organization, contact_phone,
    country (code), preferred_transaction, message, product_slugs (array).
    """
    c = F.col
    countries = region.filter(c("type") == "COUNTRY").select(c("code").alias("country"), c("id").alias("country_id"))
    needs = requirements.select(
        c("id").alias("requirement_id"), c("country_id").alias("_own_country"), c("preferred_transaction").alias("_own_preference"), F.lit(True).alias("_known")
    )
    # A shortlist has at most four rows per requirement.
    shortlist = matches.groupBy("requirement_id").agg(F.collect_set("slug").alias("_shortlist"))
    none = F.array().cast("array<string>")
    chosen = F.coalesce("product_slugs", none)
    linked = c("requirement_id").isNotNull()
    published = products.filter("is_published").select(c("slug").alias("_single"), c("id").alias("_product_id"))
    rows = (
        submissions.withColumn("product_slugs", F.array_distinct(chosen))
        .withColumn("_single", F.when(c("requirement_id").isNull() & (F.size("product_slugs") == 1), F.get(c("product_slugs"), F.lit(0))))
        .join(countries, "country", "left").join(needs, "requirement_id", "left").join(shortlist, "requirement_id", "left")
        .join(published, "_single", "left")
    )
    outside = F.size(F.array_except("product_slugs", F.coalesce("_shortlist", none))) > 0
    reason = (
        F.when(~F.trim("contact_email").rlike(text.EMAIL_PATTERN), "contact_email is not valid")
        .when(c("country").isNotNull() & c("country_id").isNull(), "unknown country")
        .when(linked & c("_known").isNull(), "requirement not found")
        .when(linked & outside, "selection outside the stored shortlist")
        .when(~linked & (F.size("product_slugs") != 1), "a direct capture names exactly one product")
        .when(~linked & c("_product_id").isNull(), "unknown or unpublished product")
    )
    judged = rows.withColumn("reason", reason)
    ok = judged.filter("reason IS NULL")

    mail = F.lower(F.trim("contact_email"))
    owner = ok.filter(linked).groupBy("requirement_id").agg(F.min_by(mail, c("id")).alias("_owner"))
    bound = ok.filter(linked).join(owner, "requirement_id")
    mine = bound.filter(mail == c("_owner"))
    foreign = bound.filter(mail != c("_owner")).withColumn("reason", F.lit("requirement is bound to another contact"))

    first = lambda name: F.min_by(text.clean(c(name)), F.when(text.clean(c(name)).isNotNull(), c("id"))).alias(name)
    last = lambda name, own: F.coalesce(F.max_by(name, F.when(c(name).isNotNull(), c("id"))), F.first(own)).alias(name)
    linked_leads = mine.groupBy("requirement_id").agg(
        F.min("id").alias("lead_id"), F.min_by(F.trim("contact_email"), c("id")).alias("contact_email"),
        first("contact_name"), first("organization"), first("contact_phone"), first("message"),
        last("country_id", "_own_country"), last("preferred_transaction", "_own_preference"), F.count(F.lit(1)).alias("submissions"),
    )
    direct = ok.filter(~linked)
    direct_leads = direct.select(
        c("requirement_id"), c("id").alias("lead_id"), F.trim("contact_email").alias("contact_email"), text.clean(c("contact_name")).alias("contact_name"),
        text.clean(c("organization")).alias("organization"), text.clean(c("contact_phone")).alias("contact_phone"), text.clean(c("message")).alias("message"),
        "country_id", F.coalesce("preferred_transaction", F.lit("UNKNOWN")).alias("preferred_transaction"), F.lit(1).cast("long").alias("submissions"),
    )
    leads = linked_leads.unionByName(direct_leads)

    picked = mine.select("requirement_id", F.explode("product_slugs").alias("slug")).distinct().withColumn("is_selected", F.lit(True))
    listed = (
        linked_leads.select("requirement_id", "lead_id").join(matches.select("requirement_id", "slug", "rank", "score"), "requirement_id")
        .join(picked, ["requirement_id", "slug"], "left")
        .select("lead_id", "slug", "rank", c("score").cast("long").alias("score"), F.coalesce("is_selected", F.lit(False)).alias("is_selected"))
    )
    asked = direct.select(
        c("id").alias("lead_id"), c("_single").alias("slug"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("score"), F.lit(True).alias("is_selected")
    )
    rejected = judged.filter("reason IS NOT NULL").select("id", "reason").unionByName(foreign.select("id", "reason"))
    return leads, listed.unionByName(asked), rejected


# ---- routing -----------------------------------------------------------------------------------

def lead_routes(leads: DataFrame, lead_products: DataFrame, availability: DataFrame, providers: DataFrame, applicable: DataFrame) -> DataFrame:
    """(lead, provider, product) pairs a lead may be sent to.

    Selected products, current accessible offers of active providers that take leads, compatible
    transaction and place. Offers fold to distinct (product, provider, transaction, region) first.
    """
    open_ = (
        availability.filter(F.col("is_current") & accessible(F.col("availability_status")) & F.col("provider_id").isNotNull())
        .select("product_id", "provider_id", "transaction_type", "region_id").distinct()
    )
    able = providers.filter(F.col("is_active") & F.col("accepts_leads")).select(F.col("id").alias("provider_id"))
    sets = applicable_sets(applicable).withColumnRenamed("region_id", "country_id")
    wanted = (
        lead_products.filter("is_selected").select("lead_id", "product_id").distinct()
        .join(leads.select("lead_id", "country_id", "preferred_transaction"), "lead_id").join(sets, "country_id", "left")
    )
    asked = vocab.transaction_for(F.col("preferred_transaction"))
    fits = (asked.isNull() | (F.col("transaction_type") == asked)) & applies(F.col("country_id").isNotNull(), F.col("region_id"), F.col("applicable_ids"))
    return wanted.join(open_.join(able, "provider_id", "left_semi"), "product_id").filter(fits).select("lead_id", "provider_id", "product_id").distinct()


def reconcile_routes(desired: DataFrame, present: DataFrame) -> DataFrame:
    """What to do with each route: add as PENDING, keep, or remove when PENDING and no longer wanted.

    A route already acted on is history and is always kept.
    """
    keys = ["lead_id", "provider_id", "product_id"]
    both = desired.select(*keys).distinct().withColumn("_want", F.lit(True)).join(present.select(*keys, "status"), keys, "full_outer")
    action = (
        F.when(F.col("status").isNull(), "add").when((F.col("status") == "PENDING") & F.col("_want").isNull(), "remove").otherwise("keep")
    )
    return both.select(*keys, action.alias("action"), F.coalesce("status", F.lit("PENDING")).alias("status"))


def lead_digest(leads: DataFrame, lead_products: DataFrame, products: DataFrame, region: DataFrame) -> DataFrame:
    """One notification per lead: who, what they picked, and the stored shortlist in rank order.

    Only stored state is shown and an absent value reads UNKNOWN. A lead lists at most its shortlist.
    """
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))
    names = products.select("slug", "name")
    lines = lead_products.join(names, "slug", "left").withColumn("_label", F.concat(say("name"), F.lit(" ("), F.col("slug"), F.lit(")")))
    entry = F.struct(F.coalesce("rank", F.lit(2**31 - 1)).alias("r"), F.col("slug").alias("s"), F.concat(
        F.col("_label"), F.lit(" — rank: "), say("rank"), F.lit(", score: "), say("score"), F.lit(", selected: "), F.when(F.col("is_selected"), "YES").otherwise("NO"),
    ).alias("t"))
    texts = lambda rows: F.transform(F.array_sort(rows), lambda e: e["t"])
    shown = lines.groupBy("lead_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_selected"), F.col("_label")))).alias("interest"), texts(F.collect_list(entry)).alias("shortlist")
    )
    codes = region.select(F.col("id").alias("country_id"), F.col("code").alias("country"))
    who = F.coalesce("organization", text.email_domain(F.col("contact_email")), "country", F.lit("UNKNOWN"))
    return leads.join(codes, "country_id", "left").join(shown, "lead_id", "left").select(
        "lead_id", F.when(F.col("submissions") > 1, "UPDATED").otherwise("NEW").alias("event"), who.alias("subject"),
        say("country").alias("country"), say("preferred_transaction").alias("preferred_transaction"), "interest", "shortlist",
    )
