"""Catalogue search: hard filters, sorting, paging and the notices that explain absences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.ranking import spread_rank
from ..functions.rules import accessible
from ..functions.stage import materialize
from . import fulltext
from . import offers as money

MAX_LIMIT = 100
# Notice codes of a search result.
UNKNOWN_EXCLUDED = "hard_constraint_excluded_unknown"
ABOVE_LIMIT = "price_max_excluded_above_limit"
UNPROVABLE = "price_max_excluded_unprovable"


@dataclass(frozen=True)
class Filters:
    """Inputs of one search; None (or empty) means the filter is inactive."""

    q: str | None = None
    manufacturer: str | None = None
    commercial_status: list[str] | None = None
    transaction_type: list[str] | None = None
    availability_status: list[str] | None = None
    use_case: str | None = None
    region: str | None = None
    payload_min: float | None = None
    height_min: float | None = None
    height_max: float | None = None
    mobility: str | None = None
    autonomy_min: str | None = None
    has_sdk: bool | None = None
    ros_support: bool | None = None
    developer_edition: bool | None = None
    has_manipulation: bool | None = None
    price_max: float | None = None
    price_currency: str | None = None


# The inputs that constrain a nullable fact of the product itself.
FACT_INPUTS = [
    "payload_min", "height_min", "height_max", "mobility", "autonomy_min",
    "has_sdk", "ros_support", "developer_edition", "has_manipulation",
]


def match_text(products: DataFrame, q: str, index: DataFrame | None = None) -> DataFrame:
    """Products that hold every lexeme of the query, by the index of their texts, or of their own columns where none is given."""
    index = fulltext.postings(fulltext.field_texts(products)) if index is None else index
    return products.join(fulltext.matching_products(index, q), "id", "left_semi")


def by_manufacturer(products: DataFrame, slug: str) -> DataFrame:
    return products.filter(F.col("manufacturer_slug") == slug)


def by_status(products: DataFrame, statuses: list[str]) -> DataFrame:
    return products.filter(F.col("commercial_status").isin(statuses))


def by_use_case(products: DataFrame, fits: DataFrame, use_case: str) -> DataFrame:
    members = fits.filter(F.col("use_case") == use_case).select(F.col("product_id").alias("id"))
    return products.join(members, "id", "left_semi")


def fact_constraints(f: Filters) -> list[tuple[Column, Column]]:
    """(satisfied, unknown) of every active constraint on a nullable fact."""
    out: list[tuple[Column, Column]] = []

    def add(name: str, satisfied: Column) -> None:
        out.append((satisfied, F.col(name).isNull()))

    if f.payload_min is not None:
        add("payload_kg", F.col("payload_kg") >= f.payload_min)
    if f.height_min is not None:
        add("height_cm", F.col("height_cm") >= f.height_min)
    if f.height_max is not None:
        add("height_cm", F.col("height_cm") <= f.height_max)
    if f.mobility:
        add("mobility", F.col("mobility") == f.mobility)
    if f.autonomy_min:
        add("autonomy", F.col("autonomy").isin(vocab.AUTONOMY[vocab.AUTONOMY.index(f.autonomy_min):]))
    for flag in ("has_sdk", "ros_support", "developer_edition", "has_manipulation"):
        value = getattr(f, flag)
        if value is not None:
            add(flag, F.col(flag) == F.lit(value))
    return out


def by_facts(products: DataFrame, f: Filters) -> DataFrame:
    """Hard filter on product facts: a NULL fact satisfies nothing."""
    return reduce(lambda df, c: df.filter(c[0]), fact_constraints(f), products)


def by_availability(products, availability, txns=None, statuses=None, regions: DataFrame | None = None) -> DataFrame:
    """Products with ONE current, accessible offer meeting all given conditions at once.

    `regions`: rows (region_id, applicable_id) of the resolved region; no rows match nothing,
    otherwise an offer without a region applies too.
    """
    rows = availability.filter(F.col("is_current") & accessible(F.col("availability_status")))
    if txns:
        rows = rows.filter(F.col("transaction_type").isin(txns))
    if statuses:
        rows = rows.filter(F.col("availability_status").isin(statuses))
    if regions is not None:
        # At most a tree path of ids; NULL when the code resolved to nothing.
        ids = F.collect_set("applicable_id")
        served = regions.agg(F.when(F.size(ids) > 0, ids).alias("ids")).scalar()
        rows = rows.filter(served.isNotNull() & (F.col("region_id").isNull() | F.array_contains(served, F.col("region_id"))))
    return products.join(rows.select(F.col("product_id").alias("id")), "id", "left_semi")


def _other_filters(m: dict, f: Filters) -> DataFrame:
    """Published products under every filter except the nullable-fact ones and the price."""
    rows = m["products"].filter("is_published")
    if f.q:
        rows = match_text(rows, f.q, m.get("text_index"))
    if f.manufacturer:
        rows = by_manufacturer(rows, f.manufacturer)
    if f.commercial_status:
        rows = by_status(rows, f.commercial_status)
    if f.use_case:
        rows = by_use_case(rows, m["fits"], f.use_case)
    if f.transaction_type or f.availability_status or f.region:
        regions = m["applicable"].filter(F.col("code") == f.region) if f.region else None
        rows = by_availability(rows, m["availability"], f.transaction_type, f.availability_status, regions)
    return rows


def catalogue_search(m: dict, f: Filters) -> DataFrame:
    """Products satisfying every active filter; `m` maps table names to DataFrames."""
    rows = by_facts(_other_filters(m, f), f)
    if f.price_max is not None:
        rows = money.under_ceiling(rows, m["pricing"], f.price_max, f.price_currency)
    return rows


def unknown_excluded(m: dict, f: Filters) -> DataFrame:
    """Products absent only because a constrained fact is unknown; none if no fact is constrained."""
    constraints = fact_constraints(f)
    if not constraints:
        return m["products"].filter(F.lit(False))
    rows = _other_filters(m, f)
    for satisfied, unknown in constraints:
        rows = rows.filter(satisfied | unknown)
    rows = rows.filter(reduce(lambda a, b: a | b, [u for _, u in constraints]))
    if f.price_max is not None:
        rows = money.under_ceiling(rows, m["pricing"], f.price_max, f.price_currency)
    return rows


def sort_columns(key: str) -> list[Column | tuple[Column, bool]]:
    """NULL-free sort columns of a sort key, as `spread_rank` takes them: unknown values last both ways, slug breaks ties."""
    down, name = key.startswith("-"), key.lstrip("-")
    if name not in vocab.SORT_KEYS:
        raise ValueError(f"sort must be one of {vocab.SORT_KEYS}, got {key!r}")
    if name == "name":
        return [(F.col("name"), down), F.col("slug")]
    number = {
        "price": F.col("lowest_purchase_price"), "payload": F.col("payload_kg"), "newest": F.unix_micros(F.col("created_on").cast("timestamp")),
    }[name].cast("double")
    return [F.coalesce(-number if down else number, F.lit(float("inf"))), F.col("slug")]


def order_by(key: str) -> list[Column]:
    """Sort expressions for `orderBy`, any key, `-` for descending."""
    down, name = key.startswith("-"), key.lstrip("-")
    if name not in vocab.SORT_KEYS:
        raise ValueError(f"sort must be one of {vocab.SORT_KEYS}, got {key!r}")
    column = {"name": "name", "price": "lowest_purchase_price", "payload": "payload_kg", "newest": "created_on"}[name]
    first = F.desc_nulls_last(column) if down else F.asc_nulls_last(column)
    return [first, F.asc("slug")]


def sort_catalogue(products: DataFrame, key: str) -> DataFrame:
    """Products with their exact position under a sort key."""
    return spread_rank(products, sort_columns(key))


def price_sorted(products: DataFrame, pricing: DataFrame, currency: str) -> DataFrame:
    """Products with a comparable purchase price, ranked by the lowest one in the currency."""
    lowest = money.lowest_comparable(pricing, currency).withColumnRenamed("product_id", "id")
    return spread_rank(products.join(lowest, "id"), [F.col("amount"), F.col("slug")])


def check_page(limit: int, offset: int) -> None:
    """Out-of-range pages are refused, never clamped."""
    for name, value in (("limit", limit), ("offset", offset)):
        if isinstance(value, bool) or not isinstance(value, int):
            raise ValueError(f"{name} must be an integer")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}; got {limit}")
    if offset < 0:
        raise ValueError(f"offset must be >= 0; got {offset}")


def page(df: DataFrame, order: list[Column], limit: int = 24, offset: int = 0) -> DataFrame:
    """One page of the ordered rows: every task keeps only its best `offset + limit` rows."""
    check_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def top_obtainable(products: DataFrame, snapshot: DataFrame, n: int = 4) -> DataFrame:
    """First `n` published products by name that can be obtained in some mode."""
    open_now = snapshot.filter(F.size("available_modes") > 0).select("id")
    return products.filter("is_published").join(open_now, "id", "left_semi").orderBy("name", "slug").limit(n)


def merge_warnings(*codes: Column) -> Column:
    """Sorted distinct union of code arrays."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*codes))))


def distinct_in_order(csv: Column) -> Column:
    """Trimmed, non-blank items of a comma list in first-seen order."""
    items = F.transform(F.split(csv, ","), lambda t: F.trim(t))
    return F.array_distinct(F.filter(items, lambda t: t != F.lit("")))


def judged(m: dict, f: Filters) -> DataFrame:
    """Every product that some answer of the search may concern, with what decides it, from one pass over products and offers.

    `held`: bit i is set where constraint i on a fact is satisfied, `open`: where its fact is unknown; `price` is
    'qualifies', 'above_limit', 'unprovable', or NULL without a ceiling. Products with a constraint neither satisfied
    nor unknown concern nothing and are left out. The lowest price comes along for sorting.
    """
    constraints = fact_constraints(f)
    bits = lambda flags: reduce(lambda a, b: a + b, [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(flags)], F.lit(0))
    rows = _other_filters(m, f).select(
        "*", bits([c for c, _ in constraints]).alias("held"), bits([u for _, u in constraints]).alias("open"))
    rows = rows.where((F.col("held") + F.col("open")) == (1 << len(constraints)) - 1)
    if f.price_max is None:
        lowest = money.lowest_price(m["pricing"]).select(F.col("product_id").alias("id"), "lowest_purchase_price")
        return rows.join(lowest, "id", "left").withColumn("price", F.lit(None).cast("string"))
    priced = money.price_comparability(rows, m["pricing"], f.price_max, f.price_currency)
    return priced.withColumnsRenamed({"amount": "lowest_purchase_price", "comparability": "price"})


def search(m: dict, f: Filters, sort: str = "name", limit: int = 24, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, totals): the page rows, and one row with the total and the sorted notices.

    Notices describe the whole filtered query, never the visible page. The judged products are stored once; page,
    total and notices read only them.
    """
    validate_filters(f)
    rows = materialize(judged(m, f), "judged")
    known = F.col("open") == 0
    priced = F.lit(True) if f.price_max is None else F.col("price") == "qualifies"
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = rows.agg(
        F.count_if(known & priced).alias("total"), some(~known & priced).alias("unknown"),
        some(known & (F.col("price") == "above_limit")).alias("above_limit"), some(known & (F.col("price") == "unprovable")).alias("unprovable"))
    code = lambda flag, label: F.when(F.col(flag), F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
    totals = flags.select(
        "total", merge_warnings(code("unknown", UNKNOWN_EXCLUDED), code("above_limit", ABOVE_LIMIT), code("unprovable", UNPROVABLE)).alias("warnings")
    )
    shown = rows.where(known & priced).drop("held", "open", "price")
    return page(shown, order_by(sort), limit, offset), totals


# Which vocabulary governs which request field.
REQUEST_VOCABULARY = {
    "commercial_status": vocab.COMMERCIAL_STATUS, "transaction_type": vocab.TRANSACTION_TYPE,
    "availability_status": vocab.AVAILABILITY_STATUS, "mobility": vocab.MOBILITY, "autonomy_min": vocab.AUTONOMY,
}


def validate_filters(f: Filters) -> None:
    """Refuse a whole search when any input is outside its vocabulary."""
    for name, allowed in REQUEST_VOCABULARY.items():
        value = getattr(f, name)
        for member in ([value] if isinstance(value, str) else value or []):
            if member not in allowed:
                raise ValueError(f"{name}: {member!r} is not one of {allowed}")
    if (f.price_max is None) != (f.price_currency is None):
        raise ValueError("price_max and price_currency must be given together")
    if f.height_min is not None and f.height_max is not None and f.height_min > f.height_max:
        raise ValueError("height_min must not exceed height_max")


def validate_requests(requests: DataFrame, governed: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected) search requests; one member outside a vocabulary rejects the request.

    List fields are arrays, the others plain text. Rejected rows carry every reason, sorted.
    """
    governed = governed or REQUEST_VOCABULARY
    reasons = []
    for name, allowed in governed.items():
        kind = requests.schema[name].dataType.typeName()
        outside = F.exists(F.col(name), lambda v: ~v.isin(allowed)) if kind == "array" else ~F.col(name).isin(allowed)
        reasons.append(F.when(outside, F.lit(f"invalid_{name}")))
    sort_name = F.regexp_replace("sort", "^-", "")
    reasons.append(F.when(~sort_name.isin(vocab.SORT_KEYS), F.lit("invalid_sort")))
    reasons.append(F.when(F.col("price_max").isNull() != F.col("price_currency").isNull(), F.lit("unpaired_price")))
    judged = requests.withColumn("reasons", F.array_sort(F.array_compact(F.array(*reasons))))
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


