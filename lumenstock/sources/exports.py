"""Machine-readable exports: published rows only; an unknown fact is left out, zero and false stay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, plain_number

# Exported properties with their unit.
NUMERIC_PROPERTIES = {
    "height_cm": ("Height", "cm"), "weight_kg": ("Weight", "kg"), "payload_kg": ("Payload", "kg"), "walk_speed_ms": ("Walk speed", "m/s"),
    "runtime_minutes": ("Runtime", "minutes"), "degrees_of_freedom": ("Degrees of freedom", None),
}
TEXT_PROPERTIES = {"mobility": "Mobility", "autonomy": "Autonomy"}


def _quoted(value: Column) -> Column:
    """JSON string literal of a text column; NULL stays NULL."""
    listed = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def _property(name: str, value: Column, unit: str | None = None) -> Column:
    tail = f',"unitText":"{unit}"}}' if unit else "}"
    return F.concat(F.lit(f'{{"@type":"PropertyValue","name":"{name}","value":'), value, F.lit(tail))


def jsonld(products: DataFrame, origin: str, category: str = "Humanoid robot") -> DataFrame:
    """(slug, jsonld): one linked-data graph of product and maker per published product."""
    c = F.col
    properties = [_property("Commercial status", _quoted(clean(c("commercial_status"))))]
    properties += [_property(name, plain_number(c(f), 2), unit) for f, (name, unit) in NUMERIC_PROPERTIES.items()]
    properties += [_property(name, _quoted(clean(c(f)))) for f, name in TEXT_PROPERTIES.items()]
    page = F.concat(F.lit(f"{origin}/products/"), "slug")
    maker = F.concat(F.lit(f"{origin}/makers/"), "manufacturer_slug")
    member = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    product = F.concat_ws(
        ",", F.lit('{"@type":"Product"'), member("@id", _quoted(page)), member("url", _quoted(page)), member("name", _quoted(c("name"))),
        F.lit(f'"category":"{category}"'), F.concat(F.lit('"manufacturer":{"@id":'), _quoted(maker), F.lit("}")),
        F.concat(F.lit('"additionalProperty":['), F.array_join(F.array_compact(F.array(*properties)), ","), F.lit("]")),
        member("description", _quoted(clean(c("summary")))), member("productionDate", _quoted(c("announced_year").cast("string"))),
    )
    firm = F.concat_ws(",", F.lit('{"@type":"Organization"'), member("@id", _quoted(maker)), member("name", _quoted(c("manufacturer_slug"))), member("url", _quoted(maker)))
    graph = F.concat(F.lit('{"@context":"https://schema.org","@graph":['), product, F.lit("},"), firm, F.lit("}]}"))
    return products.filter("is_published").select("slug", graph.alias("jsonld"))


def sitemap(products: DataFrame, makers: DataFrame, use_cases: DataFrame, origin: str) -> DataFrame:
    """Pages to crawl: (url, last_modified, change_frequency, priority). A missing date stays missing."""
    def part(df, folder, priority, modified=None):
        date = F.col(modified) if modified else F.lit(None).cast("date")
        return df.select(F.concat(F.lit(f"{origin}/{folder}/"), "slug").alias("url"), date.alias("last_modified"),
                         F.lit("weekly").alias("change_frequency"), F.lit(priority).alias("priority"))

    return reduce(DataFrame.unionByName, [
        part(products.filter("is_published"), "products", "0.8", "created_on"), part(makers, "makers", "0.6"), part(use_cases, "use-cases", "0.6"),
    ])


def llms_txt(products: DataFrame, makers: DataFrame, use_cases: DataFrame, origin: str) -> DataFrame:
    """(section, line) of the plain-text index of everything published."""
    item = lambda label, folder: F.concat(F.lit("- "), label, F.lit(f": {origin}/{folder}/"), "slug")
    label = F.concat("name", F.lit(" ("), "manufacturer_slug", F.lit(")"))
    return reduce(DataFrame.unionByName, [
        products.filter("is_published").select(F.lit("products").alias("section"), item(label, "products").alias("line")),
        makers.select(F.lit("makers").alias("section"), item(F.col("name"), "makers").alias("line")),
        use_cases.select(F.lit("use cases").alias("section"), item(F.col("slug"), "use-cases").alias("line")),
    ])


def export_jsonld(products: DataFrame, path: str, origin: str) -> None:
    jsonld(products, origin).select(F.col("jsonld").alias("value")).write.mode("overwrite").text(path)


def export_sitemap(products: DataFrame, makers: DataFrame, use_cases: DataFrame, path: str, origin: str) -> None:
    sitemap(products, makers, use_cases, origin).write.mode("overwrite").json(path)


def export_llms_txt(products: DataFrame, makers: DataFrame, use_cases: DataFrame, path: str, origin: str) -> None:
    """One text file per section, written in parallel."""
    rows = llms_txt(products, makers, use_cases, origin)
    rows.withColumnRenamed("line", "value").write.mode("overwrite").partitionBy("section").text(path)
