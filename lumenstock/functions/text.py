"""String keys and cleaners as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that carry no model identity.
GENERIC_TOKENS = [
    "robotics", "robot", "robots", "humanoid", "humanoids", "inc", "ltd", "llc", "corp",
    "corporation", "co", "company", "the", "ai", "technologies", "technology", "tech",
    "dynamics", "labs", "lab", "group",
]
# Corporate words dropped from a brand slug.
SLUG_SUFFIXES = [
    "robotics", "technologies", "technology", "robots", "ai", "inc", "ltd", "llc", "corp",
    "co", "company", "labs", "lab",
]
# The English stop words of the text filter (a query of only these matches nothing).
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being have "
    "has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don should now"
).split()
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
HTTP_PATTERN = r"^https?://"


def words(text: Column) -> Column:
    """Lower-cased alphanumeric tokens; empty array for blank or NULL text."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.filter(F.split(spaced, " "), lambda t: t != F.lit(""))


def normalize(text: Column) -> Column:
    return F.array_join(F.filter(words(text), lambda t: ~t.isin(GENERIC_TOKENS)), " ")


def model_key(name: Column, maker_key: Column) -> Column:
    """Tokens of a normalised name that are not tokens of its maker's key."""
    maker = F.split(maker_key, " ")
    kept = F.filter(words(name), lambda t: ~t.isin(GENERIC_TOKENS) & ~F.array_contains(maker, t))
    return F.array_join(kept, " ")


def slugify(text: Column) -> Column:
    return F.array_join(words(text), "-")


def slug_or_item(text: Column) -> Column:
    return F.coalesce(F.nullif(slugify(text), F.lit("")), F.lit("item"))


def brand_token(maker_slug: Column) -> Column:
    parts = F.filter(F.split(maker_slug, "-"), lambda t: ~t.isin(SLUG_SUFFIXES))
    return F.coalesce(F.nullif(F.array_join(parts, "-"), F.lit("")), maker_slug)


def product_slug(maker_name: Column, name: Column) -> Column:
    """`<brand>-<model>`, the brand's first word not repeated when the model starts with it."""
    brand, model = brand_token(slugify(maker_name)), slugify(name)
    lead = F.element_at(F.split(brand, "-"), 1)
    repeated = (model == lead) | model.startswith(F.concat(lead, F.lit("-")))
    return F.when(repeated, model).otherwise(F.concat_ws("-", brand, model))


def loose_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def url_origin(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "^(https?://[^/]+)", 1), F.lit(""))


def email_domain(email: Column) -> Column:
    domain = F.trim(F.substring_index(email, "@", -1))
    return F.when(F.instr(email, "@") > 0, F.nullif(domain, F.lit("")))


def clean(text: Column) -> Column:
    """Trimmed text; blank becomes NULL."""
    return F.nullif(F.trim(text), F.lit(""))


def plain_number(value: Column, scale: int = 6) -> Column:
    """Shortest decimal text: trailing zeros and a bare point removed."""
    text = value.cast(f"decimal(20,{scale})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
