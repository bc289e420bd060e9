"""Region tree: ancestors and the regions that apply to a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stage import materialize

def regions_by_type(region: DataFrame, kind: str | None = None) -> DataFrame:
    rows = region if kind is None else region.filter(F.col("type") == kind)
    return rows.select("code", "type", "name").orderBy("name", "code")


def region_closure(region: DataFrame) -> DataFrame:
    """(region_id, ancestor_id, depth), each region being its own ancestor at depth 0.

    Every region carries the path of ancestors found so far; a round appends the path of the last
    one's parent, so paths double until all have reached a root, whatever the depth. In a cycle an
    ancestor already on the path is not repeated and the path ends.
    """
    paths = region.select(F.col("id").alias("region_id"), F.array("id").alias("path"), F.col("parent_id").alias("next"))
    while True:
        on = paths.select(F.col("region_id").alias("_id"), F.col("path").alias("_more"), F.col("next").alias("_next"))
        met = paths.join(on, F.col("next") == F.col("_id"), "left")
        # A parent that has no row of its own is still an ancestor, and the last one.
        more = F.coalesce("_more", F.when(F.col("next").isNotNull(), F.array("next")), F.array().cast("array<long>"))
        met = met.select("region_id", F.col("path").alias("_own"), "_next", more.alias("_more"))
        met = met.withColumn("_new", F.filter("_more", lambda x: ~F.array_contains("_own", x)))
        ended = F.size("_new") < F.size("_more")
        paths = materialize(met.select("region_id", F.concat("_own", "_new").alias("path"), F.when(~ended, F.col("_next")).alias("next")), "paths")
        if paths.filter("next IS NOT NULL").isEmpty():
            return paths.select("region_id", F.posexplode("path").alias("depth", "ancestor_id")).select("region_id", "ancestor_id", "depth")


def global_id(region: DataFrame) -> Column:
    """Id of the global region as a scalar, NULL when the table has none."""
    return region.filter(F.col("code") == "GLOBAL").agg(F.max("id")).scalar()


def applicable_regions(closure: DataFrame, region: DataFrame, require_type: str | None = None) -> DataFrame:
    """(region_id, code, applicable_id): the region, its ancestors and the global region.

    A code outside the table has no rows, so it applies to nothing.
    """
    places = region if require_type is None else region.filter(F.col("type") == require_type)
    places = places.select(F.col("id").alias("region_id"), "code")
    own = places.join(closure.select("region_id", F.col("ancestor_id").alias("applicable_id")), "region_id")
    everywhere = places.withColumn("applicable_id", global_id(region)).filter("applicable_id IS NOT NULL")
    return own.unionByName(everywhere).distinct()


def applicable_sets(applicable: DataFrame) -> DataFrame:
    """One row per region with its applicable ids as an array (at most one per tree level + 1)."""
    return applicable.groupBy("region_id").agg(F.array_sort(F.collect_set("applicable_id")).alias("applicable_ids"))


def applies(country_known: Column, region_id: Column, applicable_ids: Column) -> Column:
    """An offer's region serves a buyer: no country stated, no region stated, or region in the set."""
    return ~country_known | region_id.isNull() | F.coalesce(F.array_contains(applicable_ids, region_id), F.lit(False))


def geo_ok(offers: DataFrame, buyers: DataFrame, applicable: DataFrame) -> DataFrame:
    """Offers x buyers already paired on `buyer_id`: adds `geo_ok`.

    `buyers` has (buyer_id, country_id); `offers` has buyer_id and region_id.
    """
    sets = applicable_sets(applicable).withColumnRenamed("region_id", "country_id")
    placed = buyers.select("buyer_id", "country_id").join(sets, "country_id", "left")
    flag = applies(F.col("country_id").isNotNull(), F.col("region_id"), F.col("applicable_ids"))
    return offers.join(placed, "buyer_id").withColumn("geo_ok", flag).drop("country_id", "applicable_ids")
