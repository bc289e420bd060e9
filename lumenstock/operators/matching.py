"""The matcher: every buyer requirement against every published product, explained.

Buyers who ask the same are one demand, and products are read in blocks, each by a task that scores only pairs
whose best possible score passes the demand's fourth match so far (`match_blocks`). The rows are those of scoring
all pairs.

With a list length, Spark alone reads lists instead: each product gets an upper bound of its score per
*demand segment* (what the buyer asks for, minus amounts and dates), the best
few hundred products of each segment are scored exactly, and a requirement is settled when its
fourth match beats the bound of the best product left out. Requirements that are not settled read
lists of finer segments, whose bounds know what the buyer's amounts leave attainable, and only then
go on to every product whose bound still reaches their fourth match, so the result is exactly the
one of scoring all pairs, whatever the list length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.ranking import first_per_key, spread_sum
from ..functions.rules import accessible, budget_ramp, clamp01, payload_headroom
from ..functions.stage import materialize
from ..functions.text import plain_number
from . import match_blocks
from .evidence import freshest_evidence
from .offers import newest

ANY = "ANY"
TOP = 4
FIRST_ROUND = 16
DEEPER = 16
BUDGET_STEP = 1.1
CRITERIA = list(vocab.WEIGHTS)
SUBS = {name: f"sub_{name}" for name in CRITERIA}
PARTS = {name: f"pts_{name}" for name in CRITERIA}
OFFERED = ["open", "plain", "earliest", "open_everywhere", "offered_everywhere", "open_regions", "offered_regions"]
REASON_CODES = ["payload", "manipulation", "autonomy", "discontinued"]
# What the dominant eliminating constraint says.
EXCLUSION_DETAIL = {
    "payload": "the stated minimum payload exceeded the known capacity",
    "manipulation": "candidates are known not to provide the required manipulation",
    "autonomy": "the required autonomy level was above the known level",
    "discontinued": "candidates are discontinued",
}


def preference_class(preference: Column) -> Column:
    return F.coalesce(vocab.transaction_for(preference), F.lit(ANY))


def _classes(transaction: Column) -> Column:
    """The preference classes an offer of this transaction type serves."""
    named = list(vocab.PREFERENCE_TO_TRANSACTION.values())
    return F.when(transaction.isin(named), F.array(transaction, F.lit(ANY))).otherwise(F.array(F.lit(ANY)))


# ---- hard exclusions --------------------------------------------------------------------------

def exclusions(pairs: DataFrame) -> DataFrame:
    """Adds `exclusions`: every rule a (requirement, product) pair violates. Unknown never excludes."""
    levels = pairs.withColumn("autonomy_level", _level("autonomy")).withColumn("required_level", _level("autonomy_required"))
    rules = {**_violations(), "discontinued": F.col("commercial_status") == "DISCONTINUED"}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return levels.withColumn("exclusions", found).drop("autonomy_level", "required_level")


def _level(name: str) -> Column:
    return vocab.ordinal(F.col(name), vocab.AUTONOMY)


def _violations() -> dict[str, Column]:
    """Rules between a requirement and a product; being discontinued is the product's own."""
    return {
        "payload": F.coalesce(F.col("payload_kg") < F.col("payload_min_kg"), F.lit(False)),
        "manipulation": F.coalesce(F.col("manipulation_required") & ~F.col("has_manipulation"), F.lit(False)),
        "autonomy": F.coalesce(F.col("autonomy_level") < F.col("required_level"), F.lit(False)),
    }


def exclusion_counts(requirements: DataFrame, products: DataFrame) -> DataFrame:
    """Per requirement: products in all, survivors, and violations of each rule.

    Counted from a histogram of product facts, never pair by pair: products fold into their
    (manipulation, autonomy, discontinued) class and payload value, requirements into distinct
    needs, and a running sum over payload values answers "how many carry less than this". The sum
    runs in two levels over ranges of values, so the few classes do not bound the tasks.
    """
    live = products.filter("is_published")
    none = F.lit(-1)
    category = [
        F.coalesce(F.col("has_manipulation").cast("int"), none).alias("hands"),
        F.coalesce(vocab.ordinal(F.col("autonomy"), vocab.AUTONOMY), none).alias("level"),
        (F.col("commercial_status") == "DISCONTINUED").alias("gone"),
    ]
    names = ["hands", "level", "gone"]
    stock = live.groupBy(*category, F.col("payload_kg").cast("double").alias("payload")).agg(F.count(F.lit(1)).alias("n"))
    totals = stock.groupBy(*names).agg(F.sum("n").alias("total"))

    need = requirements.select(
        F.col("id").alias("requirement_id"),
        F.coalesce(F.col("payload_min_kg").cast("double"), F.lit(-1.0)).alias("minimum"),
        F.coalesce("manipulation_required", F.lit(False)).alias("wants_hands"),
        F.coalesce(vocab.ordinal(F.col("autonomy_required"), vocab.AUTONOMY), none).alias("wants_level"),
    )
    minimums = need.select("minimum").distinct()
    grid = F.array(*[
        F.struct(F.lit(h).alias("hands"), F.lit(a).alias("level"), F.lit(g).alias("gone"))
        for h in (-1, 0, 1) for a in range(-1, len(vocab.AUTONOMY)) for g in (False, True)
    ])
    points = minimums.select(F.explode(grid).alias("c"), F.col("minimum").alias("value")).select(
        "c.*", "value", F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind")
    ).unionByName(
        stock.filter("payload IS NOT NULL").select(*names, F.col("payload").alias("value"), "n", F.lit(1).alias("kind"))
    )
    # At equal values the question (kind 0) comes first, so it counts strictly smaller payloads.
    running = spread_sum(points, "n", [F.col("value"), F.col("kind")], names, "below")
    below = running.filter("kind = 0").select(*names, F.col("value").alias("minimum"), "below")

    wants = need.drop("requirement_id").distinct()
    cells = wants.join(below, "minimum").join(totals, names)
    ok = ~F.col("gone") & ~(F.col("wants_hands") & (F.col("hands") == 0)) & ((F.col("level") == -1) | (F.col("level") >= F.col("wants_level")))
    amount = lambda cond, value: F.sum(F.when(cond, value).otherwise(0))
    counted = cells.groupBy("minimum", "wants_hands", "wants_level").agg(
        F.sum("total").alias("candidates"),
        amount(ok, F.col("total") - F.col("below")).alias("survivors"),
        F.sum("below").alias("n_payload"),
        amount(F.col("wants_hands") & (F.col("hands") == 0), F.col("total")).alias("n_manipulation"),
        amount((F.col("level") >= 0) & (F.col("level") < F.col("wants_level")), F.col("total")).alias("n_autonomy"),
        amount(F.col("gone"), F.col("total")).alias("n_discontinued"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ["candidates", "survivors", *[f"n_{r}" for r in REASON_CODES]]]
    return need.join(counted, ["minimum", "wants_hands", "wants_level"], "left").select("requirement_id", *zero)


def match_candidates(requirements: DataFrame, products: DataFrame) -> DataFrame:
    """How many published products stand before and after the hard exclusions."""
    return exclusion_counts(requirements, products).select("requirement_id", "candidates", "survivors")


def exclusions_by_reason(requirements: DataFrame, products: DataFrame) -> DataFrame:
    """(requirement, reason, n), every violated rule counted on its own."""
    counts = exclusion_counts(requirements, products)
    pairs = F.array(*[F.struct(F.lit(r).alias("reason"), F.col(f"n_{r}").alias("n")) for r in REASON_CODES])
    return counts.select("requirement_id", F.explode(pairs).alias("p")).select("requirement_id", "p.*").filter("n > 0")


# ---- supply: what each product offers, per preference class --------------------------------------

def offer_features(availability: DataFrame) -> DataFrame:
    """Per product and preference class: accessibility, earliest date and the regions served.

    Region sets are bounded by the region table; every other column is one value.
    """
    open_ = accessible(F.col("availability_status"))
    rows = availability.filter("is_current").select(
        "product_id", F.explode(_classes(F.col("transaction_type"))).alias("class"), "availability_status", "available_from", "region_id"
    )
    return rows.groupBy("product_id", "class").agg(
        F.bool_or(open_).alias("open"),
        F.bool_or(F.col("availability_status") == "AVAILABLE").alias("plain"),
        F.min(F.when(open_, F.col("available_from"))).alias("earliest"),
        F.bool_or(open_ & F.col("region_id").isNull()).alias("open_everywhere"),
        F.bool_or(F.col("region_id").isNull()).alias("offered_everywhere"),
        F.array_sort(F.collect_set(F.when(open_, F.col("region_id")))).alias("open_regions"),
        F.array_sort(F.collect_set("region_id")).alias("offered_regions"),
    )


def price_points(pricing: DataFrame) -> DataFrame:
    """Current prices per product, folded to what budget scoring can tell apart.

    Per (transaction, currency, region, billing period, kind) only the lowest price matters; a
    range also needs its distinct lower bounds. The array length is bounded by vocabularies.
    """
    shaped = pricing.filter("is_current").withColumn(
        "kind",
        F.when(F.col("price_type") == "QUOTE_ONLY", "QUOTE")
        .when(F.col("billing_period") != "ONE_TIME", "PERIOD")
        .when((F.col("price_type") == "RANGE") & F.col("price_min").isNotNull() & F.col("price_max").isNotNull(), "RANGE")
        .when(F.col("price_type").isin(vocab.POINT_PRICE_TYPES) & F.col("price").isNotNull(), F.col("price_type"))
        .otherwise("INDICATIVE"),
    )
    folded = shaped.groupBy(
        "product_id", "transaction_type", F.upper("currency").alias("currency"), "region_id", "billing_period", "price_type", "kind"
    ).agg(
        F.min(F.col("price").cast("double")).alias("low"),
        F.min(F.when(F.col("kind") == "RANGE", F.col("price_max").cast("double"))).alias("top"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "RANGE", F.col("price_min").cast("double")))).alias("floors"),
    )
    return folded.groupBy("product_id").agg(F.collect_list(F.struct(
        "transaction_type", "currency", "region_id", "billing_period", "price_type", "kind", "low", "top", "floors"
    )).alias("prices"))


def price_caps(pricing: DataFrame) -> DataFrame:
    """Per product and preference class: the best budget sub-score any price of a currency could reach,
    and the lowest price that could lift it above one half."""
    kind = F.col("price_type")
    lowest = F.when(kind == "RANGE", F.least("price_min", "price_max")).otherwise(F.col("price")).cast("double")
    firm = (F.col("billing_period") == "ONE_TIME") & kind.isin("PUBLIC", "ESTIMATED", "RANGE")
    start = (F.col("billing_period") == "ONE_TIME") & (kind == "FROM")
    rows = pricing.filter("is_current").select(
        "product_id", F.explode(_classes(F.col("transaction_type"))).alias("class"), F.upper("currency").alias("currency"),
        F.when(firm, 1.0).when(start, 0.75).otherwise(0.5).alias("cap"), F.when(firm | start, lowest).alias("low"),
    )
    best = rows.filter("currency IS NOT NULL").groupBy("product_id", "class", "currency").agg(F.max("cap").alias("cap"), F.min("low").alias("low"))
    return best.groupBy("product_id", "class").agg(
        F.map_from_entries(F.collect_list(F.struct("currency", F.struct("cap", "low").alias("c")))).alias("caps")
    )


def supply(m: dict) -> DataFrame:
    """One row per published product with everything scoring needs; `offers` holds what differs by preference class."""
    products = m["products"].filter("is_published")
    fielded = m["deployments"].groupBy("product_id").agg(F.count(F.lit(1)).alias("deployments"))
    fresh = freshest_evidence(m["products"], m["pricing"], m["availability"], m["deployments"], m["evidence"])
    fits = m["fits"].filter("use_case IS NOT NULL").groupBy("product_id").agg(
        F.map_from_entries(F.collect_list(F.struct("use_case", F.col("fit_score").cast("double").alias("fit")))).alias("fits")
    )
    offers = offer_features(m["availability"]).groupBy("product_id").agg(F.collect_list(F.struct("class", *OFFERED)).alias("offers"))
    return (
        products.select(
            F.col("id").alias("product_id"), "slug", "commercial_status", F.col("payload_kg").cast("double").alias("payload_kg"),
            "has_manipulation", "autonomy", _level("autonomy").alias("autonomy_level"), "runtime_minutes", "has_sdk", "ros_support", "developer_edition",
        )
        .join(fielded, "product_id", "left").join(fresh, "product_id", "left").join(fits, "product_id", "left")
        .join(price_points(m["pricing"]), "product_id", "left").join(offers, "product_id", "left")
        .withColumn("deployments", F.coalesce("deployments", F.lit(0).cast("long")))
        .withColumn("staleness", F.coalesce(newest("freshest_verified_at"), F.lit(2**62)))
        .withColumn(SUBS["deployment_readiness"], _deployment_sub())
    )


def _of_class(products: DataFrame) -> DataFrame:
    """Supply rows that carry a `class`, with what the product offers in it."""
    offer = F.get(F.filter("offers", lambda o: o["class"] == F.col("class")), F.lit(0))
    return products.withColumn("_offer", offer).select(*products.columns, *[F.col(f"_offer.{c}").alias(c) for c in OFFERED]).drop("offers")


def _by_class(products: DataFrame) -> DataFrame:
    classes = F.array(*[F.lit(c) for c in [*vocab.PREFERENCE_TO_TRANSACTION.values(), ANY]])
    return _of_class(products.withColumn("class", F.explode(classes)))


def _deployment_sub() -> Column:
    maturity = vocab.lookup(F.col("commercial_status"), vocab.MATURITY_SCORE, 0.0)
    fielded = F.when(F.col("deployments") >= 1, 1.0).otherwise(0.5)
    return F.lit(0.5) * maturity + F.lit(0.5) * fielded


# ---- scores as whole hundredths ------------------------------------------------------------------

def _half_even(df: DataFrame, columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds each `numerator / unit` as a whole number, ties to even.

    Quotient and rest are columns of their own steps, so that no generated method repeats their terms.
    """
    df = df.withColumns({f"_n_{c}": n for c, (n, _) in columns.items()})
    df = df.withColumns({f"_w_{c}": F.call_function("div", F.col(f"_n_{c}"), u) for c, (_, u) in columns.items()})
    df = df.withColumns({f"_r_{c}": (F.col(f"_n_{c}") - F.col(f"_w_{c}") * u) * 2 for c, (_, u) in columns.items()})
    up = lambda c, u: (F.col(f"_r_{c}") > u) | ((F.col(f"_r_{c}") == u) & (F.col(f"_w_{c}") % 2 == 1))
    df = df.withColumns({c: F.coalesce(F.col(f"_w_{c}") + F.when(up(c, u), 1).otherwise(0), F.lit(0).cast("long")) for c, (_, u) in columns.items()})
    return df.drop(*[f"_{k}_{c}" for k in "nwr" for c in columns])


def scored(df: DataFrame) -> DataFrame:
    """Adds each criterion's points and the 0-100 score from the sub-score columns (NULL = inactive).

    Points are weight x sub x 100 / active weight in hundredths, in whole numbers only.
    """
    weight = lambda name: F.when(F.col(SUBS[name]).isNotNull(), vocab.WEIGHTS[name]).otherwise(0)
    unit = reduce(lambda a, b: a + b, [weight(n) for n in CRITERIA]).cast("long") * F.lit(1_000_000_000)
    points = lambda name: F.floor(F.col(SUBS[name]) * F.lit(1e9) + F.lit(0.5)) * F.lit(vocab.WEIGHTS[name] * 10000)
    df = _half_even(df.withColumn("_unit", unit), {PARTS[n]: (points(n), F.col("_unit")) for n in CRITERIA}).drop("_unit")
    total = reduce(lambda a, b: a + b, [F.col(c) for c in PARTS.values()])
    return _half_even(df, {"score": (total, F.lit(100).cast("long"))})


def rank_key(score: str = "score") -> Column:
    """Ascending sort key of a match: score, commercial sub-score, deployments, freshness, slug."""
    return F.struct(
        (-F.col(score)).alias("k0"), (-F.col(SUBS["commercial_availability"])).alias("k1"),
        (-F.col("deployments")).alias("k2"), F.col("staleness").alias("k3"), F.col("slug").alias("k4"),
    )


# ---- demand segments and bounds -------------------------------------------------------------------

SEGMENT = ["class", "scope", "use_case", "technical", "budget", "money"]
ANYWHERE, STATED, ELSEWHERE = "*", "stated", "elsewhere"


def demand(requirements: DataFrame, applicable: DataFrame) -> DataFrame:
    """Requirements with their segment fields and the region ids that apply to the buyer."""
    regions = applicable.groupBy(F.col("region_id").alias("country_id"), F.col("code").alias("country")).agg(
        F.array_sort(F.collect_set("applicable_id")).alias("applicable_ids")
    )
    has = lambda c: F.col(c).isNotNull()
    budget = F.when(has("budget_max"), F.upper(F.coalesce("budget_currency", F.lit("")))).when(has("budget_min"), F.lit("minimum only"))
    return requirements.withColumnRenamed("id", "requirement_id").join(regions, "country_id", "left").select(
        "requirement_id", "country_id", "country", "applicable_ids", "use_case",
        F.col("payload_min_kg").cast("double").alias("payload_min_kg"),
        F.col("operating_hours_day").cast("double").alias("operating_hours_day"),
        "manipulation_required", "autonomy_required", _level("autonomy_required").alias("required_level"), "budget_currency", "budget_min", "budget_max", "required_by", "preferred_transaction",
        preference_class(F.col("preferred_transaction")).alias("class"),
        F.when(
            has("payload_min_kg") | has("operating_hours_day") | has("autonomy_required") | F.coalesce("manipulation_required", F.lit(False)), 1.0
        ).alias("technical"),
        F.coalesce(budget, F.lit("none")).alias("budget"), F.lit(None).cast("double").alias("money"),
    )


def _scopes(buyers: DataFrame) -> DataFrame:
    """Buyers once per list they read: without a country one list, else three."""
    country = F.col("country_id").cast("string")
    read = F.when(F.col("country_id").isNull(), F.array(F.lit(ANYWHERE))).otherwise(F.array(F.lit(STATED), F.lit(ELSEWHERE), country))
    return buyers.withColumn("scope", F.explode(read)).withColumn("segment", _segment_key())


def _segment_key() -> Column:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.concat_ws("|", "class", "scope", said("use_case"), said("technical"), "budget", said("money"))


def _finer(buyers: DataFrame, stock: DataFrame, money: bool) -> DataFrame:
    """Buyers with segments that also say what their amounts leave attainable.

    `technical` is the sub-score of a product as good as the catalogue has any in every part;
    `money`, on demand, the budget rounded up to the next step. Both only grow by the rounding.
    """
    facts = ["payload_kg", "runtime_minutes", "autonomy_level", "has_manipulation"]
    most = stock.agg(*[F.max(c).alias(c) for c in facts])
    # A product without a stated payload has half of that part, so the ideal one has no less.
    ideal = buyers.crossJoin(most).withColumn("payload_kg", F.greatest("payload_kg", F.col("payload_min_kg") * 0.625))
    finer = score_technical(ideal).withColumn("technical", F.ceil(F.col(SUBS["technical_fit"]) * 10000) / F.lit(10000.0))
    if money:
        step = F.floor(F.log(F.greatest("budget_max", F.lit(1.0))) / F.log(F.lit(BUDGET_STEP))) + 1
        above = F.greatest("budget_max", F.pow(F.lit(BUDGET_STEP), step))
        finer = finer.withColumn("money", F.when(F.col("budget_max").isNotNull(), above))
    return finer.withColumn("segment", _segment_key()).drop(*facts, SUBS["technical_fit"])


def _with_reach(stock: DataFrame, region: DataFrame, applicable: DataFrame) -> DataFrame:
    """Adds `reach`, the scopes of a supply row with the geographic sub-score seen from each.

    A product open everywhere scores 1 for any stated country, so it has one scope for all of them.
    Any other product has one default scope, and one for each country its regional offers touch
    (also listed in `local_scopes`).
    """
    top = region.filter(F.col("code") == "GLOBAL").select(F.col("id").alias("region_id")).withColumn("_global", F.lit(True))
    below = applicable.select(F.col("applicable_id").alias("region_id"), F.col("region_id").alias("country_id"), "code").join(
        region.filter(F.col("type") == "COUNTRY").select("code"), "code", "left_semi"
    ).drop("code").join(top.select("region_id"), "region_id", "left_anti")
    touched = (
        stock.select("product_id", "class", F.explode("offered_regions").alias("region_id"), "open_regions")
        .withColumn("_open", F.array_contains("open_regions", F.col("region_id")))
    )
    local = touched.join(below, "region_id").groupBy("product_id", "class", F.col("country_id").cast("string").alias("scope")).agg(
        F.bool_or("_open").alias("_open")
    )
    locals_ = local.groupBy("product_id", "class").agg(F.collect_list(
        F.struct("scope", F.when(F.col("_open"), 1.0).otherwise(0.0).alias("geo"))
    ).alias("_local"))
    world = touched.join(top, "region_id").groupBy("product_id", "class").agg(F.bool_or("_open").alias("_world_open"), F.lit(True).alias("_world"))

    empty = F.array().cast("array<struct<scope:string,geo:double>>")
    one = lambda scope, geo: F.array(F.struct(F.lit(scope).alias("scope"), geo.alias("geo")))
    open_all = F.coalesce("open_everywhere", F.lit(False)) | F.coalesce("_world_open", F.lit(False))
    offered_all = F.coalesce("offered_everywhere", F.lit(False)) | F.coalesce("_world", F.lit(False))
    default = one(ELSEWHERE, F.when(offered_all, 0.0).otherwise(0.5))
    local_rows = F.coalesce("_local", empty)
    rows = F.when(open_all, one(STATED, F.lit(1.0))).otherwise(F.concat(default, local_rows))
    return (
        stock.join(locals_, ["product_id", "class"], "left").join(world, ["product_id", "class"], "left")
        .withColumn("local_scopes", F.transform(local_rows, lambda r: r["scope"]))
        .withColumn("reach", F.concat(one(ANYWHERE, F.lit(None).cast("double")), rows))
        .drop("_local", "_world_open", "_world")
    )


def _use_case_sub() -> Column:
    fit = F.try_element_at(F.col("fits"), F.col("use_case"))
    return F.when(F.col("use_case").isNotNull(), F.coalesce(clamp01(fit), F.lit(0.5)))


def _cap(money: Column) -> Column:
    """The best budget sub-score any price of the buyer's currency could reach for `money`."""
    price = F.try_element_at(F.col("caps"), F.col("budget"))
    # From 110 % of the budget on, no price gives more than a half.
    return F.coalesce(F.when(price["low"] >= money * 1.1, 0.5).otherwise(price["cap"]), F.lit(0.5))


# What a bound depends on besides the segment's own amounts: who asks, and what the product has to say to that.
ASKED = ["class", "scope", "use", "budget", "stepped"]
FACTS = ["c_use", "c_com", "c_geo", "c_dep", "c_cap", "c_floor"]
UNASKED = -1.0


def _segments(buyers: DataFrame) -> DataFrame:
    """One row per segment, with the `worst` fourth match of its buyers (NULL where one has none)."""
    worst = F.when(F.bool_and(F.col("fourth").isNotNull()), F.max("fourth")) if "fourth" in buyers.columns else F.lit(None).cast(
        "struct<k0:bigint,k1:double,k2:bigint,k3:bigint,k4:string>")
    return buyers.groupBy(*SEGMENT, "segment").agg(worst.alias("worst")).withColumns({
        "use": F.coalesce(F.concat(F.lit("="), "use_case"), F.lit("-")), "stepped": F.col("money").isNotNull(),
    })


def _cells(stock: DataFrame, segments: DataFrame) -> DataFrame:
    """Products once per question asked of them (ASKED), with the cell (FACTS) their bound is the same in.

    A cell holds everything a bound reads: exact sub-scores, the best budget sub-score, and for segments with a
    budget the price it starts from, rounded down to a step. A product has one row per scope and question.
    """
    narrow = (
        stock.filter("commercial_status <> 'DISCONTINUED'")
        .select("product_id", "class", "slug", "deployments", "staleness", "open", "fits", "caps", F.col(SUBS["deployment_readiness"]).alias("c_dep"), F.explode("reach").alias("r"))
        .select("*", F.col("r.scope").alias("scope"), F.coalesce(F.col("r.geo"), F.lit(UNASKED)).alias("c_geo")).drop("r")
    )
    price = F.try_element_at(F.col("caps"), F.col("budget"))
    step = F.pow(F.lit(BUDGET_STEP), F.floor(F.log(price["low"]) / F.log(F.lit(BUDGET_STEP)))) * (1 - 1e-9)
    cap = F.coalesce(price["cap"], F.lit(0.5))
    return narrow.join(segments.select(*ASKED, "use_case").distinct(), ["class", "scope"]).withColumns({
        "c_use": F.coalesce(_use_case_sub(), F.lit(UNASKED)),
        "c_com": F.when(F.col("open"), 1.0).when(F.col("open").isNotNull(), 0.0).otherwise(0.5),
        "c_cap": F.when(F.col("budget") == "none", UNASKED).when(F.col("budget") == "minimum only", 0.5).otherwise(cap),
        "c_floor": F.when(F.col("stepped") & (cap > 0.5) & (price["low"] > 1), step).otherwise(0.0),
    }).select("product_id", "slug", "deployments", "staleness", *ASKED, *FACTS)


def _levels(cells: DataFrame, segments: DataFrame, length: int | None) -> DataFrame:
    """(segment, cell, k0, k1): the first keys of the rank key of a cell's products in each segment.

    Scores are computed once per cell and segment. Cells behind the worst fourth match of a segment are left out,
    and with `length` also cells behind the score at which so many products are ahead.
    """
    asks = lambda c: F.when(F.col(c) != UNASKED, F.col(c))
    cap = F.when(F.col("c_cap") != UNASKED, F.when(F.col("c_floor") >= F.col("money") * 1.1, 0.5).otherwise(F.col("c_cap")))
    counts = cells.groupBy(*ASKED, *FACTS).agg(F.count(F.lit(1)).alias("n"))
    subs = {
        SUBS["use_case_fit"]: asks("c_use"), SUBS["commercial_availability"]: F.col("c_com"), SUBS["technical_fit"]: F.col("technical"),
        SUBS["geographic_fit"]: asks("c_geo"), SUBS["budget_fit"]: cap, SUBS["deployment_readiness"]: F.col("c_dep"),
    }
    keyed = scored(counts.join(segments, ASKED).withColumns(subs)).select(
        "segment", *ASKED, *FACTS, "n", "worst", (-F.col("score")).alias("k0"), (-F.col(SUBS["commercial_availability"])).alias("k1")
    ).filter(F.col("worst").isNull() | (F.col("k0") <= F.col("worst.k0")))
    if length is not None:
        keyed = materialize(keyed, "cells")
        levels = keyed.groupBy("segment", "k0").agg(F.sum(F.least("n", F.lit(length))).alias("n"))
        upto = F.sum("n").over(W.partitionBy("segment").orderBy("k0"))
        cut = levels.withColumn("ahead", upto - F.col("n")).filter(F.col("ahead") < length).groupBy("segment").agg(F.max("k0").alias("cut"))
        keyed = keyed.join(cut, "segment").filter(F.col("k0") <= F.col("cut")).drop("cut")
    return keyed.drop("n")


def _bounds(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """(segment, product_id, class, bound): the best rank key a product could reach in a segment."""
    bound = F.struct("k0", "k1", (-F.col("deployments")).alias("k2"), F.col("staleness").alias("k3"), F.col("slug").alias("k4"))
    return cells.join(levels, [*ASKED, *FACTS]).select("segment", "product_id", "class", bound.alias("bound"), "worst").filter(
        F.col("worst").isNull() | (F.col("bound") < F.col("worst"))
    ).drop("worst")


def _lists(stock: DataFrame, segments: DataFrame, length: int) -> DataFrame:
    """The first `length` entries of each segment with their `place`.

    Products of one cell differ in a bound only by what breaks ties, so no list needs more than the first `length` of a cell.
    """
    cells = _cells(stock, segments)
    levels = materialize(_levels(cells, segments, length), "levels")
    inside = W.partitionBy(*ASKED, *FACTS).orderBy(F.desc("deployments"), "staleness", "slug")
    needed = cells.join(levels.select(*ASKED, *FACTS).distinct(), [*ASKED, *FACTS], "left_semi")
    heads = needed.withColumn("at", F.row_number().over(inside)).filter(F.col("at") <= length).drop("at")
    place = F.row_number().over(W.partitionBy("segment").orderBy("bound"))
    return _bounds(heads, levels).withColumn("place", place).filter(F.col("place") <= length)


# ---- exact sub-scores of a (requirement, product) pair ----------------------------------------------

def score_commercial(df: DataFrame) -> DataFrame:
    late = F.col("required_by").isNotNull() & F.coalesce(F.col("earliest") > F.col("required_by"), F.lit(False))
    sub = F.when(F.col("open"), F.when(late, 0.5).otherwise(1.0)).when(F.col("open").isNotNull(), 0.0).otherwise(0.5)
    return df.withColumn(SUBS["commercial_availability"], sub)


def _serves(scope_flag: str, regions: str) -> Column:
    return F.coalesce(F.col(scope_flag), F.lit(False)) | F.coalesce(F.arrays_overlap(F.col(regions), F.col("applicable_ids")), F.lit(False))


def score_geography(df: DataFrame) -> DataFrame:
    sub = F.when(_serves("open_everywhere", "open_regions"), 1.0).when(_serves("offered_everywhere", "offered_regions"), 0.0).otherwise(0.5)
    return df.withColumn(SUBS["geographic_fit"], F.when(F.col("country_id").isNotNull(), sub))


def _technical_parts() -> dict[str, Column]:
    """Part scores, NULL when the buyer did not ask."""
    ask = lambda cond, fact, known: F.when(cond, F.when(F.col(fact).isNull(), 0.5).otherwise(known))
    minutes = F.col("operating_hours_day") * F.lit(60.0)
    cover = F.when(minutes == 0, F.lit(1.0)).otherwise(F.col("runtime_minutes") / minutes)
    payload = F.when(F.col("payload_min_kg") == 0, F.lit(1.0)).otherwise(
        F.coalesce(payload_headroom(F.col("payload_kg"), F.col("payload_min_kg")), F.lit(0.5))
    )
    return {
        "payload": F.when(F.col("payload_min_kg").isNotNull(), F.when(F.col("payload_kg").isNull() & (F.col("payload_min_kg") != 0), 0.5).otherwise(payload)),
        "autonomy": ask(F.col("required_level").isNotNull(), "autonomy_level", F.lit(1.0)),
        "manipulation": ask(F.col("manipulation_required"), "has_manipulation", F.lit(1.0)),
        "runtime": ask(F.col("operating_hours_day").isNotNull(), "runtime_minutes", F.lit(0.5) + F.lit(0.5) * clamp01(cover)),
    }


def score_technical(df: DataFrame) -> DataFrame:
    parts = list(_technical_parts().values())
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    count = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), 1).otherwise(0) for p in parts])
    return df.withColumn(SUBS["technical_fit"], F.when(count > 0, total / count))


def comparable_prices() -> Column:
    """Price points a buyer can hold against the budget: currency, transaction and place agree."""
    here = lambda p: F.col("country_id").isNull() | p["region_id"].isNull() | F.coalesce(F.array_contains("applicable_ids", p["region_id"]), F.lit(False))
    wanted = F.upper(F.coalesce("budget_currency", F.lit("")))
    return F.filter(F.col("prices"), lambda p: (p["currency"] == wanted)
                    & ((F.col("class") == ANY) | (p["transaction_type"] == F.col("class"))) & here(p))


# Budget warnings.
W_START = "only a starting ('from') price is published"
W_OVER = "price exceeds the stated budget"
W_ESTIMATE = "price is an estimate, not confirmed"
W_QUOTE = "pricing is quote-only"
W_ABOVE = "price range starts above the stated budget"
W_CROSS = "price range crosses the budget ceiling"
W_LOOSE = "pricing is indicative"
W_TERMS = "no price in the requested currency/terms"
W_NONE = "no confirmed pricing"


def _judge(p: Column, budget: Column) -> Column:
    """(-fit, warnings, tie-break fields, warning texts) of one price point; the least is best."""
    texts = lambda *t: F.array(*[F.lit(x) if isinstance(x, str) else x for x in t])
    nothing = F.array().cast("array<string>")
    over = p["low"] > budget
    next_floor = F.array_min(F.filter(p["floors"], lambda f: f > budget))
    lowest_floor = F.array_min(p["floors"])
    above = budget_ramp(next_floor, budget)
    crossing = (lowest_floor <= budget) & (F.coalesce(above, F.lit(0.0)) <= 0.5)
    kind = p["kind"]
    fit = (
        F.when(kind.isin("QUOTE", "PERIOD", "INDICATIVE"), 0.5)
        .when(kind == "RANGE", F.when(p["top"] <= budget, 1.0).when(crossing, 0.5).otherwise(above))
        .when(kind == "FROM", F.least(budget_ramp(p["low"], budget), F.lit(0.75)))
        .otherwise(budget_ramp(p["low"], budget))
    )
    warns = (
        F.when(kind == "QUOTE", texts(W_QUOTE))
        .when(kind == "PERIOD", F.array(F.concat(F.lit("price is "), F.lower(p["billing_period"]), F.lit(" — not comparable to a one-off budget"))))
        .when(kind == "RANGE", F.when(p["top"] <= budget, nothing).when(crossing, texts(W_CROSS)).otherwise(texts(W_ABOVE)))
        .when(kind == "FROM", F.when(over, texts(W_START, W_OVER)).otherwise(texts(W_START)))
        .when(kind == "PUBLIC", F.when(over, texts(W_OVER)).otherwise(nothing))
        .when(kind == "ESTIMATED", F.when(over, texts(W_OVER, W_ESTIMATE)).otherwise(texts(W_ESTIMATE)))
        .otherwise(texts(W_LOOSE))
    )
    return F.struct(
        (-fit).alias("loss"), F.size(warns).alias("n"), p["transaction_type"].alias("t"), p["price_type"].alias("p"),
        p["billing_period"].alias("b"), warns.alias("warnings"),
    )


def score_budget(df: DataFrame) -> DataFrame:
    best = F.array_min(F.transform(comparable_prices(), lambda p: _judge(p, F.col("budget_max"))))
    best = F.when(F.col("budget_max").isNotNull(), best)
    sub = (
        F.when(F.col("budget_max").isNotNull(), F.coalesce(-F.col("best_price.loss"), F.lit(0.5)))
        .when(F.col("budget_min").isNotNull(), 0.5)
    )
    return df.withColumn("best_price", best).withColumn(SUBS["budget_fit"], sub)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """All six sub-scores, points and score of pairs that carry requirement and supply columns."""
    df = pairs.withColumn(SUBS["use_case_fit"], _use_case_sub())
    for step in (score_commercial, score_technical, score_geography, score_budget):
        df = step(df)
    return scored(df)


FLAT_BUYER = ["scope", "country_id", "payload_min_kg", "manipulation_required", "required_level"]
FLAT_STOCK = ["local_scopes", "payload_kg", "has_manipulation", "autonomy_level"]


def _survivors(asked: DataFrame, entries: DataFrame, on: list[str]) -> DataFrame:
    """Buyers joined to listed products, without excluded pairs.

    Listed products are never discontinued. A product that a country's own list holds is not read
    from the default list again. Columns the rules do not look at travel packed, which keeps the
    generated join code small.
    """
    def pack(df, flat, name):
        return df.select(*on, *flat, F.struct(*[c for c in df.columns if c not in (*on, *flat)]).alias(name))

    local = F.coalesce(F.array_contains("local_scopes", F.col("country_id").cast("string")), F.lit(False))
    keep = ~((F.col("scope") == ELSEWHERE) & local) & ~reduce(lambda a, b: a | b, _violations().values())
    pairs = pack(asked, FLAT_BUYER, "_r").join(pack(entries, FLAT_STOCK, "_s"), on).filter(keep)
    return pairs.select("*", "_r.*", "_s.*").drop("_r", "_s")


RANKED = ["requirement_id", "product_id", "class", "slug", "deployments", "staleness", *SUBS.values(), *PARTS.values(), "score"]


def _best(scored_pairs: DataFrame) -> DataFrame:
    """Best rows per requirement. Only scores and keys enter the sort; facts are joined back later."""
    by = W.partitionBy("requirement_id").orderBy("key")
    narrow = scored_pairs.select(*RANKED, rank_key().alias("key"))
    return narrow.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP)


# ---- ranking -------------------------------------------------------------------------------------

def prepare(m: dict) -> dict:
    """Inputs of a matching run. Stored: products and buyers. Lazy, for lists: products by class with the scopes
    they reach (`stock`), and buyers by the lists they read (`asked`).

    `m`: requirements, products, availability, pricing, fits, deployments, evidence, region, applicable.
    """
    products, buyers = materialize(supply(m), "supply"), materialize(demand(m["requirements"], m["applicable"]), "buyers")
    by_class = _by_class(products).join(price_caps(m["pricing"]), ["product_id", "class"], "left")
    return {"products": products, "buyers": buyers, "stock": _with_reach(by_class, m["region"], m["applicable"]), "asked": _scopes(buyers)}


def rank_prepared(run: dict, list_length: int | None = None) -> DataFrame:
    """The best four products of every requirement, with sub-scores and points.

    Products are read block by block; with a list length, in lists of each segment, in Spark alone. Both give the same rows.
    """
    return _in_blocks(run) if list_length is None else _in_lists(run, list_length)


def _in_lists(run: dict, list_length: int) -> DataFrame:
    """Lists are read in rounds, the head first. A list is settled for a requirement when its fourth
    match is no worse than the bound of the last entry read; only lists not settled are read on,
    in longer lists and then in those of finer segments.
    """
    stock, done = materialize(run["stock"], "stock"), []
    features = stock.drop("reach", "commercial_status", "autonomy", "plain", "has_sdk", "ros_support", "developer_edition")
    best, open_ = None, materialize(_finer(run["asked"], stock, False), "buyers")
    longer = DEEPER * list_length
    for money, ends in ((False, [min(FIRST_ROUND, list_length), list_length]), (False, [longer]), (True, [longer])):
        if money:
            open_ = materialize(_finer(open_, stock, True), "unsettled")
        lists = _lists(stock, _segments(open_), max(ends))
        settled, best, open_ = _read(open_.drop("tail"), best, lists, features, ends)
        done += settled
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done).drop("key")
    segments, cells = _segments(open_), _cells(stock, _segments(open_))
    bounds = _bounds(cells, _levels(cells, segments, None))
    left_out = (F.col("bound") > F.col("tail")) & (F.col("fourth").isNull() | (F.col("bound") < F.col("fourth")))
    more = open_.drop("class").join(bounds, "segment").filter(left_out).drop("bound", "tail", "segment")
    found = _best(score_pairs(_promising(_survivors(more, features, ["product_id", "class"]))))
    return reduce(DataFrame.unionByName, [*done, _merged(best, found)]).drop("key")


def _promising(pairs: DataFrame) -> DataFrame:
    """Pairs that could still come before the fourth match, with the budget sub-score at its best.

    Comparing prices one by one is by far the dearest part of a score; few pairs are left for it. A score is at most
    its unrounded value plus a half and 0.005 for each criterion. Stored, since a generated method holds no two scores.
    """
    budget = F.when(F.col("budget_max").isNotNull(), _cap(F.col("budget_max"))).when(F.col("budget_min").isNotNull(), 0.5)
    df = pairs.withColumn(SUBS["use_case_fit"], _use_case_sub())
    for step in (score_commercial, score_technical, score_geography):
        df = step(df)
    df = df.withColumn(SUBS["budget_fit"], budget)
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(SUBS[n]), F.lit(0.0)) * F.lit(float(vocab.WEIGHTS[n])) for n in CRITERIA])
    active = reduce(lambda a, b: a + b, [F.when(F.col(SUBS[n]).isNotNull(), vocab.WEIGHTS[n]).otherwise(0) for n in CRITERIA])
    most = F.floor(F.lit(100.0) * total / active + F.lit(0.54))
    ahead = df.withColumn("most", most).filter(F.col("fourth").isNull() | (rank_key("most") < F.col("fourth")))
    return materialize(ahead.select(*pairs.columns), "promising")


def _merged(best: DataFrame, found: DataFrame) -> DataFrame:
    """The best of two sets of best rows; a product that both hold counts once."""
    return _best(best.unionByName(found).dropDuplicates(["requirement_id", "product_id"]))


def _read(open_: DataFrame, best: DataFrame | None, lists: DataFrame, features: DataFrame, ends: list[int]) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Read `lists` to their end in rounds: best rows of the buyers settled, and of those not settled by then,
    and the latter themselves with `tail` and `fourth`."""
    lists, read, settled = materialize(lists, "lists"), 0, []
    for end in sorted(set(ends)):
        part = lists.filter((F.col("place") > read) & (F.col("place") <= end))
        entries = part.drop("place").join(features, ["product_id", "class"]).drop("class")
        pairs = _survivors(open_, entries, ["segment"])
        if best is not None:
            pairs = _promising(pairs.filter(F.col("fourth").isNull() | (F.col("bound") < F.col("fourth"))))
        found = _best(score_pairs(pairs))
        best = materialize(found if best is None else _merged(best, found), "best")
        tails = lists.filter(F.col("place") == end).select("segment", F.col("bound").alias("tail"))
        fourth = best.filter(F.col("rank") == TOP).select("requirement_id", F.col("key").alias("fourth"))
        reach = open_.drop("tail", "fourth").join(tails, "segment").join(fourth, "requirement_id", "left").filter(
            F.col("fourth").isNull() | (F.col("fourth") > F.col("tail"))
        )
        open_, read = materialize(reach, "unsettled"), end
        left = open_.select("requirement_id").distinct()
        settled.append(best.join(left, "requirement_id", "left_anti"))
        best = best.join(left, "requirement_id", "left_semi")
        if open_.isEmpty():
            break
    return settled, best, open_


# ---- ranking in blocks ---------------------------------------------------------------------------

DEMAND = ["class", "country_id", "use_case", "payload_min_kg", "operating_hours_day", "manipulation_required", "required_level", "currency",
          "budget_max", "has_minimum", "required_by"]
BLOCK = 1 << 17
SAMPLE = 1 << 15
READERS = 8_000
CROWD = 200_000
BUCKETS = 1 << 20
KERNEL_SUBS = dict(zip(match_blocks.SUB_COLUMNS, ("use_case_fit", "commercial_availability", "technical_fit", "geographic_fit", "budget_fit", "deployment_readiness")))


def _asked_alike(buyers: DataFrame) -> DataFrame:
    """Buyers with `demand`, a key of all that scoring reads of them."""
    shaped = buyers.withColumns({
        "currency": F.when(F.col("budget_max").isNotNull(), F.upper(F.coalesce("budget_currency", F.lit("")))),
        "has_minimum": F.col("budget_min").isNotNull(), "required_by": F.unix_date("required_by"),
    })
    return shaped.withColumn("demand", F.unhex(F.md5(F.to_json(F.struct(*DEMAND)))))


def _parted(demands: DataFrame, readers: int) -> tuple[DataFrame, dict[str, int]]:
    """Demands dealt into parts of about `readers` by class and country, and how many parts each class has."""
    sizes = demands.groupBy("class", "country_id").agg(F.count(F.lit(1)).alias("n"))
    parts = {r["class"]: -(-r["n"] // readers) for r in sizes.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # one row per class
    split = sizes.select("class", F.col("country_id").alias("_country"), F.ceil(F.col("n") / readers).alias("_pieces"))
    same = (demands["class"] == split["class"]) & demands["country_id"].eqNullSafe(split["_country"])
    dealt = demands.join(split, same).drop(split["class"])
    piece = F.pmod(F.xxhash64("demand"), "_pieces")
    of = vocab.lookup(F.col("class"), parts, 1) if parts else F.lit(1)
    return dealt.withColumn("part", F.pmod(F.xxhash64("class", "country_id", piece), of).cast("int")).drop("_country", "_pieces"), parts


def _shipped(products: DataFrame, parts: dict[str, int]) -> DataFrame:
    """Products once per class asked for and part of its demands, as a block's task reads them."""
    fitting = F.filter("prices", lambda p: (F.col("class") == ANY) | (p["transaction_type"] == F.col("class")))
    code = lambda k: F.when(k.isin("QUOTE", "PERIOD", "INDICATIVE"), match_blocks.HALF).when(k == "RANGE", match_blocks.RANGE).when(
        k == "FROM", match_blocks.START).otherwise(match_blocks.START + 1)
    regions = lambda c: F.col(c).cast("array<long>").alias(c)
    rows = _of_class(products.withColumn("class", F.explode(F.array(*[F.lit(c) for c in parts]) if parts else F.array().cast("array<string>"))))
    return rows.select(
        "class", "block", F.explode(F.sequence(F.lit(0), (vocab.lookup(F.col("class"), parts, 1) if parts else F.lit(1)) - 1)).alias("part"),
        "product_id", "slug", "deployments", "staleness", F.col(SUBS["deployment_readiness"]).alias("dep"), "payload_kg", "has_manipulation",
        "autonomy_level", "runtime_minutes", "open", F.unix_date("earliest").alias("earliest"), "open_everywhere", "offered_everywhere",
        regions("open_regions"), regions("offered_regions"), F.map_keys("fits").alias("use_cases"), F.map_values("fits").alias("fits"),
        F.transform(fitting, lambda p: F.named_struct(
            F.lit("currency"), p["currency"], F.lit("region_id"), p["region_id"].cast("long"), F.lit("kind"), code(p["kind"]),
            F.lit("low"), p["low"], F.lit("top"), p["top"], F.lit("floors"), p["floors"],
        )).alias("prices"),
    )


def _read_blocks(products: DataFrame, demands: DataFrame, readers: int, blocks: list[int]) -> DataFrame:
    """The best four products of each demand in each of the blocks, scored."""
    dealt, parts = _parted(demands, readers)
    everywhere = dealt.withColumn("block", F.explode(F.array(*[F.lit(b) for b in blocks])))
    keys = ["class", "block", "part"]
    found = _shipped(products, parts).groupBy(*keys).cogroup(everywhere.groupBy(*keys)).applyInArrow(match_blocks.best_in_block, match_blocks.FOUND)
    return materialize(scored(found.withColumnsRenamed({c: SUBS[n] for c, n in KERNEL_SUBS.items()})), "found")


def _fourth(found: DataFrame) -> DataFrame:
    """The fourth match of each demand that has four, as a block's task reads it."""
    last = found.groupBy("demand").agg(F.count(F.lit(1)).alias("n"), F.max(rank_key()).alias("k")).filter(F.col("n") == TOP)
    return last.select("demand", *[(-F.col(f"k.k{i}")).alias(c) for i, c in enumerate(["f_score", "f_com", "f_deployments"])],
                       F.col("k.k3").alias("f_staleness"), F.col("k.k4").alias("f_slug"))


def _in_blocks(run: dict) -> DataFrame:
    """Every demand meets every product of its class, block by block, at most `BLOCK` or so products at a time.

    Buyers who ask the same are one demand. With more than one block, a sample of the products comes first, so that
    the others are read knowing a fourth match already, which leaves nearly all of them out before they are scored.
    """
    buyers = _asked_alike(run["buyers"])
    demands = materialize(buyers.dropDuplicates(["demand"]).select("demand", *DEMAND, F.col("applicable_ids").cast("array<long>").alias("applicable_ids")), "demands")
    live = run["products"].filter("commercial_status <> 'DISCONTINUED' AND product_id IS NOT NULL")
    n = live.count()
    rest = -(-(n - SAMPLE) // BLOCK) if n > BLOCK else 0
    first = F.pmod(F.xxhash64("product_id"), F.lit(BUCKETS)) < (BUCKETS * SAMPLE // n if rest else BUCKETS)
    dealt = live.withColumn("block", F.when(first, 0).otherwise(1 + F.pmod(F.xxhash64("product_id", F.lit(1)), F.lit(max(rest, 1)))).cast("int"))
    unknown = {"f_score": "long", "f_com": "double", "f_deployments": "long", "f_staleness": "long", "f_slug": "string"}
    found = _read_blocks(dealt.filter("block = 0"), demands.withColumns({c: F.lit(None).cast(t) for c, t in unknown.items()}), READERS, [0])
    if rest:
        more = _read_blocks(dealt.filter("block > 0"), demands.join(_fourth(found), "demand", "left"), CROWD, list(range(1, rest + 1)))
        found = found.unionByName(more)
    return _best(found.join(buyers.select("requirement_id", "class", "demand"), "demand")).drop("key")


def rank_matches(m: dict, list_length: int | None = None) -> DataFrame:
    return rank_prepared(prepare(m), list_length)


def matched_facts(run: dict, ranked: DataFrame) -> DataFrame:
    """Ranked rows with the requirement and product facts their texts and labels need."""
    buyers = run["buyers"].drop("money").dropDuplicates(["requirement_id"])
    facts = run["products"].drop("slug", "deployments", "staleness", *SUBS.values())
    joined = ranked.join(buyers.drop("class"), "requirement_id").join(facts, "product_id")
    return score_budget(_of_class(joined))


# ---- explanations ----------------------------------------------------------------------------------

def _lines(*conditional: tuple[Column, Column | str]) -> Column:
    texts = [F.when(cond, F.lit(t) if isinstance(t, str) else t) for cond, t in conditional]
    return F.array_compact(F.array(*texts))


def criterion_texts() -> dict[str, tuple[Column, Column]]:
    """(reasons, warnings) of each criterion, in the columns of `matched_facts`."""
    c = F.col
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = F.array().cast("array<string>")
    stated = c("use_case").isNotNull()
    fit = F.try_element_at(c("fits"), c("use_case"))
    shown_fit = F.format_string("%.2f", c(SUBS["use_case_fit"]))
    late = c("open") & (c(SUBS["commercial_availability"]) == 0.5)
    part = _technical_parts()
    unknown = lambda name, fact: part[name].isNotNull() & c(fact).isNull()
    minutes = c("operating_hours_day") * F.lit(60.0)
    runs = c("operating_hours_day").isNotNull() & c("runtime_minutes").isNotNull()
    short = (minutes > 0) & (c("runtime_minutes") < minutes)
    geo, here = c(SUBS["geographic_fit"]), c("country")
    with_max = c("budget_max").isNotNull()
    unpriced = with_max & c("best_price").isNull()
    return {
        "use_case_fit": (
            _lines((stated & fit.isNotNull() & (c(SUBS["use_case_fit"]) >= 0.6), say("use-case fit ", shown_fit, " for ", c("use_case")))),
            _lines((stated & fit.isNull(), say("use-case fit for ", c("use_case"), " is unverified"))),
        ),
        "commercial_availability": (
            _lines(
                (c("open"), "commercially accessible for the requested transaction"),
                (~c("open"), "no accessible commercial offer for the requested transaction"),
                (c("open").isNull(), "commercial availability unconfirmed; neutral score applied"),
            ),
            _lines(
                (c("open") & ~c("plain"), "commercial availability is constrained (waitlist/preorder/on-request)"),
                (late, "earliest known availability is after the required-by date"),
                (~c("open"), "no accessible commercial offer for the requested transaction"),
                (c("open").isNull(), "no confirmed commercial availability"),
            ),
        ),
        "technical_fit": (
            _lines(
                ((c("payload_min_kg") != 0) & c("payload_kg").isNotNull() & (part["payload"] >= 0.8),
                 say("payload ", plain_number(c("payload_kg")), " kg meets the ", plain_number(c("payload_min_kg")), " kg requirement")),
                (c("autonomy_required").isNotNull() & c("autonomy").isNotNull(), say("autonomy ", c("autonomy"), " meets ", c("autonomy_required"))),
                (c("manipulation_required") & c("has_manipulation").isNotNull(), "supports required manipulation"),
                (runs & ~short, say("runtime covers the requested ", plain_number(c("operating_hours_day")), " h/day duty cycle")),
            ),
            _lines(
                ((c("payload_min_kg") != 0) & unknown("payload", "payload_kg"), "payload unverified"),
                (unknown("autonomy", "autonomy"), "autonomy level unverified"),
                (unknown("manipulation", "has_manipulation"), "manipulation capability unverified"),
                (unknown("runtime", "runtime_minutes"), "runtime unverified"),
                (runs & short, "runtime may require a charging strategy"),
            ),
        ),
        "geographic_fit": (
            _lines((geo == 1.0, say("available in ", here))),
            _lines((geo == 0.0, say("offers for ", here, " are not accessible")), (geo == 0.5, say("no regional availability evidence for ", here))),
        ),
        "budget_fit": (
            _lines((with_max & (c(SUBS["budget_fit"]) >= 0.99), "within the stated budget")),
            F.concat(
                F.coalesce(c("best_price.warnings"), none),
                _lines((unpriced & c("prices").isNotNull(), W_TERMS), (unpriced & c("prices").isNull(), W_NONE)),
            ),
        ),
        "deployment_readiness": (
            _lines(
                (F.lit(True), say("commercial maturity: ", c("commercial_status"))),
                (c("deployments") >= 1, say(c("deployments").cast("string"), " confirmed deployment(s)")),
            ),
            none,
        ),
    }


def explain(facts: DataFrame) -> DataFrame:
    """Adds `reasons` (best contribution first, distinct, four at most) and `warnings` (criterion order)."""
    texts = criterion_texts()

    def tag(name: str, reasons: Column) -> Column:
        return F.transform(reasons, lambda t: F.struct((-F.col(PARTS[name])).alias("o"), t.alias("t")))

    tagged = [tag(name, reasons) for name, (reasons, _) in texts.items()]
    ordered = F.array_sort(F.flatten(F.array(*tagged)))
    reasons = F.slice(F.array_distinct(F.transform(ordered, lambda r: r["t"])), 1, 4)
    warnings = F.flatten(F.array(*[w for _, w in texts.values()]))
    return facts.withColumn("reasons", reasons).withColumn("warnings", warnings)


# ---- labels ------------------------------------------------------------------------------------------

def _lower_cost() -> tuple[Column, Column]:
    """(lowest eligible price, its currencies): current one-off public or estimated prices that fit."""
    wanted = F.upper(F.nullif(F.col("budget_currency"), F.lit("")))
    here = lambda p: F.col("country_id").isNull() | p["region_id"].isNull() | F.coalesce(F.array_contains("applicable_ids", p["region_id"]), F.lit(False))
    eligible = F.filter(F.col("prices"), lambda p: p["kind"].isin("PUBLIC", "ESTIMATED")
                        & ((F.col("class") == ANY) | (p["transaction_type"] == F.col("class"))) & here(p)
                        & (wanted.isNull() | (p["currency"] == wanted)))
    return F.array_min(F.transform(eligible, lambda p: p["low"])), F.array_distinct(F.transform(eligible, lambda p: p["currency"]))


def label_matches(facts: DataFrame) -> DataFrame:
    """Adds `category`. Labels are claimed in order among ranks 2-4, each product at most once.

    The four rows of a requirement are few by construction, so windows over them stay small.
    """
    lowest, currencies = _lower_cost()
    group = W.partitionBy("requirement_id")
    pool = F.col("rank") > 1
    df = facts.withColumn("lowest_cost", lowest).withColumn("cost_currencies", currencies)

    def claim(df, name, eligible, *order):
        place = F.row_number().over(group.orderBy(F.when(eligible, 0).otherwise(1), *order))
        return df.withColumn(name, F.coalesce(eligible & (place == 1), F.lit(False)))

    known = lambda cond: F.coalesce(cond, F.lit(False))
    df = claim(df, "_commercial", pool & known(F.col("open")), F.desc(SUBS["commercial_availability"]), "slug")
    seen = F.array_distinct(F.flatten(F.collect_list(F.when(pool & F.col("lowest_cost").isNotNull(), F.col("cost_currencies"))).over(group)))
    mixed = F.nullif(F.col("budget_currency"), F.lit("")).isNull() & (F.size(seen) > 1)
    df = df.withColumn("_mixed", mixed)
    df = claim(df, "_cheap", pool & F.col("lowest_cost").isNotNull() & ~F.col("_mixed") & ~F.col("_commercial"), F.asc("lowest_cost"), "slug")
    maker = known(F.col("has_sdk")) | known(F.col("ros_support")) | known(F.col("developer_edition"))
    df = claim(df, "_developer", pool & maker & ~F.col("_commercial") & ~F.col("_cheap"), "rank")
    category = (
        F.when(F.col("rank") == 1, "BEST_OVERALL").when(F.col("_commercial"), "BEST_COMMERCIAL").when(F.col("_cheap"), "BEST_LOWER_COST")
        .when(F.col("_developer"), "BEST_DEVELOPER").otherwise("ALTERNATIVE")
    )
    return df.withColumn("category", category).drop("_commercial", "_mixed", "_cheap", "_developer")


# ---- outcomes ------------------------------------------------------------------------------------------

def no_match(requirements: DataFrame, products: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per requirement: matches, excluded count, and why nothing matched (NULL when something did).

    The dominant reason is the most frequent violation, ties in alphabetical order.
    """
    counts = exclusion_counts(requirements, products)
    matched = ranked.groupBy("requirement_id").agg(F.count(F.lit(1)).alias("matches"))
    reasons = F.array(*[F.struct((-F.col(f"n_{r}")).alias("n"), F.lit(r).alias("code")) for r in REASON_CODES])
    top = F.array_min(F.filter(reasons, lambda r: r["n"] < 0))
    text = F.when(
        F.col("top").isNotNull(),
        F.concat(
            F.lit("No platform matched. The dominant eliminating constraint was "), F.col("top.code"), F.lit(": "),
            vocab.lookup(F.col("top.code"), EXCLUSION_DETAIL, None), F.lit(" — "), (-F.col("top.n")).cast("string"),
            F.lit(" of "), F.col("candidates").cast("string"), F.lit(" candidates."),
        ),
    ).otherwise("No published platforms are available to match yet.")
    return (
        counts.join(matched, "requirement_id", "left").withColumn("top", top)
        .withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
        .select(
            "requirement_id", "matches", (F.col("candidates") - F.col("matches")).alias("excluded_count"),
            F.when(F.col("matches") == 0, text).alias("explanation"),
        )
    )


def match_incremental(stored: DataFrame, m: dict) -> DataFrame:
    """Stored matches win; only requirements without any stored row are ranked, then appended."""
    done = stored.select(F.col("requirement_id").alias("id")).distinct()
    fresh = {**m, "requirements": m["requirements"].join(done, "id", "left_anti")}
    columns = ["requirement_id", "slug", "rank", "score"]
    return stored.select(*columns, F.lit(True).alias("stored")).unionByName(
        rank_matches(fresh).select(*columns, F.lit(False).alias("stored"))
    )
