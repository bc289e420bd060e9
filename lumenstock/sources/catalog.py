"""The catalogue model, derived lazily from the star-schema Parquet tables.

Each property is one DataFrame of the model. Nothing is read, cached or collected until a
query runs, and Catalyst prunes the columns and rows a query does not use.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab

GLOBAL_REGION_ID = 0
# Keys of the long tail: key, label, category, usual unit, place on a page.
SPEC_DEFINITIONS = [
    ("list_price", "List price", "OTHER", "USD", 3), ("outdoor_rated", "Outdoor use", "MOBILITY", None, 1), ("ingress_rating", "Ingress rating", "SAFETY", None, 2),
    ("noise", "Noise", "SAFETY", "dB", 2), ("largest_load", "Largest load", "MANIPULATION", "kg", 1),
]


def _cycle(key: Column, *values) -> Column:
    """Value number `key mod n`; NULL entries allowed."""
    out = None
    for i, value in enumerate(values):
        cond = key % len(values) == i
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out


def _null_if(cond: Column, value: Column) -> Column:
    return F.when(~cond, value)


class Catalog:
    """Model views over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    # ---- dimensions -------------------------------------------------------------------

    @cached_property
    def region(self) -> DataFrame:
        top = self.spark.range(0, 1, 1, 1).select(
            F.lit(GLOBAL_REGION_ID).alias("id"), F.lit(None).cast("int").alias("parent_id"),
            F.lit("GLOBAL").alias("type"), F.lit("GLOBAL").alias("code"), F.lit("Global").alias("name"),
        )
        zones = self.table("region").select(
            (F.col("r_regionkey") + 1).alias("id"), F.lit(None).cast("int").alias("parent_id"),
            F.lit("ECONOMIC_ZONE").alias("type"),
            F.concat(F.lit("Z"), "r_regionkey").alias("code"), F.col("r_name").alias("name"),
        )
        countries = self.table("nation").select(
            (F.col("n_nationkey") + 100).alias("id"), (F.col("n_regionkey") + 1).alias("parent_id"),
            F.lit("COUNTRY").alias("type"),
            F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"),
        )
        return top.unionByName(zones).unionByName(countries)

    @cached_property
    def manufacturer(self) -> DataFrame:
        return self.table("part").select(F.col("p_brand").alias("slug")).distinct().withColumn("name", F.col("slug"))

    @cached_property
    def provider(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("id"), F.col("s_name").alias("name"),
            (F.col("s_nationkey") + 100).alias("country_id"),
            F.concat(F.lit("Brand#"), (key % 40 + 1).cast("string")).alias("manufacturer_slug"),
            (key % 10 != 0).alias("is_active"), (F.col("s_acctbal") > 0).alias("accepts_leads"),
        )

    @cached_property
    def use_case(self) -> DataFrame:
        return self.table("customer").select(F.col("c_mktsegment").alias("slug")).distinct()

    # ---- products and their facts ------------------------------------------------------

    @cached_property
    def product(self) -> DataFrame:
        key, kind, size = F.col("p_partkey"), F.col("p_type"), F.col("p_size")
        status = (
            F.when(key % 11 == 0, "UNKNOWN").when(key % 13 == 0, "DISCONTINUED")
            .when(kind == "ECONOMY", "COMMERCIAL").when(kind == "STANDARD", "LIMITED_COMMERCIAL")
            .when(kind == "PROMO", "EARLY_ACCESS").when(kind == "LARGE", "PILOT")
            .when(kind == "MEDIUM", "PROTOTYPE").otherwise("RAAS_DEPLOYMENT")
        )
        return self.table("part").select(
            key.alias("id"),
            F.concat(F.lit("p-"), key.cast("string")).alias("slug"),
            F.col("p_name").alias("name"),
            F.concat(F.substring(kind, 1, 2), F.lit("-"), size.cast("string")).alias("model_code"),
            F.col("p_brand").alias("manufacturer_slug"),
            status.alias("commercial_status"),
            _null_if(key % 7 == 0, size.cast("decimal(6,1)")).alias("payload_kg"),
            _null_if(key % 5 == 0, (100 + 2 * size).cast("decimal(6,1)")).alias("height_cm"),
            _null_if(key % 4 == 1, (30 + size).cast("decimal(6,1)")).alias("weight_kg"),
            _null_if(key % 5 == 2, ((key % 30) * F.lit(0.1)).cast("decimal(5,2)")).alias("walk_speed_ms"),
            _null_if(key % 6 == 0, (30 + 30 * (key % 10)).cast("int")).alias("runtime_minutes"),
            _null_if(key % 3 == 2, (10 + key % 25).cast("int")).alias("degrees_of_freedom"),
            _cycle(key, *vocab.MOBILITY, None).alias("mobility"),
            _cycle(key, *vocab.AUTONOMY, None).alias("autonomy"),
            _cycle(key, True, False, None).alias("has_sdk"),
            _cycle(key, True, False, True, None).alias("has_manipulation"),
            _cycle(key, True, False, None, None, None, None, None, None).alias("ros_support"),
            _cycle(key, True, False, None, None, None, None, None, None, None).alias("developer_edition"),
            _cycle(key, "gripper", "five-finger", None).alias("hand_type"),
            _null_if(key % 3 == 2, (key % 12).cast("int")).alias("hand_dof"),
            _cycle(key, True, False, None, None, None).alias("has_vision"),
            _cycle(key, True, False, None, None, None, None).alias("has_language_ui"),
            (key % 10 != 0).alias("is_published"),
            _null_if(key % 6 == 0, F.concat(F.lower(kind), F.lit(" unit for the "), F.lower("p_brand"))).alias("summary"),
            _null_if(key % 4 == 0, (2015 + key % 10).cast("int")).alias("announced_year"),
            F.date_add(F.lit("2020-01-01").cast("date"), (key % 1500).cast("int")).alias("created_on"),
        )

    @cached_property
    def variant(self) -> DataFrame:
        """Editions of a product, one per state its orders are in."""
        rows = self.table("lineitem").select("l_partkey", "l_linestatus").distinct()
        slug = F.concat(F.lit("edition-"), F.lower("l_linestatus"))
        return rows.select(
            F.concat_ws("-", F.lit("v"), "l_partkey", "l_linestatus").alias("id"), F.col("l_partkey").alias("product_id"), slug.alias("slug"),
            F.concat(F.lit("Edition "), F.col("l_linestatus")).alias("name"), (F.col("l_linestatus") == "O").alias("is_developer"))

    @cached_property
    def spec_definition(self) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("key", "label", "category", "unit", "sort_order"), d)]) for d in SPEC_DEFINITIONS]))
        return self.spark.range(0, 1, 1, 1).select(rows.alias("d")).select("d.*")

    @cached_property
    def specification(self) -> DataFrame:
        """Attribute-value rows: some of products, some of a variant; some state two values, some none."""
        key = F.col("p_partkey")
        number, flag, words = F.lit(None).cast("decimal(18,4)"), F.lit(None).cast("boolean"), F.lit(None).cast("string")
        value = lambda name, n=number, b=flag, t=words, unit=words: F.struct(
            F.lit(name).alias("key"), n.alias("value_number"), b.alias("value_bool"), t.alias("value_text"), unit.alias("unit"))
        rows = self.table("part").select(key.alias("product_id"), F.explode(F.array(
            value("list_price", n=_null_if(key % 4 == 0, F.col("p_retailprice").cast("decimal(18,4)")), unit=F.when(key % 6 == 1, F.lit("EUR"))),
            value("outdoor_rated", b=_null_if(key % 5 == 0, key % 2 == 0)),
            value("ingress_rating", t=F.concat(F.lit("IP"), (60 + F.col("p_size") % 10).cast("string"))),
            value("noise", n=F.when(key % 3 == 1, (F.col("p_size") + 0.5).cast("decimal(18,4)")), t=F.when(key % 3 != 0, F.lit("quiet"))),
        )).alias("s")).select("product_id", F.lit(None).cast("string").alias("variant_id"), "s.*")
        loads = self.table("lineitem").groupBy("l_partkey", "l_linestatus").agg(F.max("l_quantity").cast("decimal(18,4)").alias("value_number")).select(
            F.col("l_partkey").alias("product_id"), F.concat_ws("-", F.lit("v"), "l_partkey", "l_linestatus").alias("variant_id"), F.lit("largest_load").alias("key"),
            "value_number", flag.alias("value_bool"), words.alias("value_text"), words.alias("unit"))
        return rows.unionByName(loads).select(F.concat_ws("-", "product_id", "key", "variant_id").alias("id"), "*")

    @cached_property
    def capability(self) -> DataFrame:
        """What a product can do, with a limit where one is known."""
        rows = self.table("lineitem").groupBy("l_partkey", "l_returnflag").agg(F.max("l_discount").alias("discount"), F.max("l_quantity").alias("most"))
        return rows.select(
            F.col("l_partkey").alias("product_id"), vocab.lookup(F.col("l_returnflag"), {"A": "navigation", "N": "grasping", "R": "speech"}, None).alias("capability"),
            (F.col("discount") > 0.05).alias("supported"), F.when(F.col("most") < 40, F.concat(F.lit("up to "), F.col("most").cast("int").cast("string"))).alias("detail"))

    @cached_property
    def description(self) -> DataFrame:
        """Long texts of products, kept apart from their facts: (product_id, text)."""
        known = self.table("part").select(F.col("p_partkey").alias("doc_id"))
        return self.table("documents").join(known, "doc_id", "left_semi").select(F.col("doc_id").alias("product_id"), "text")

    def _supplier_region(self) -> DataFrame:
        return self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey"),
            F.when(F.col("s_suppkey") % 4 == 0, F.col("n_nationkey") + 100)
            .when(F.col("s_suppkey") % 4 == 1, F.col("n_regionkey") + 1)
            .when(F.col("s_suppkey") % 4 == 2, F.lit(GLOBAL_REGION_ID)).alias("region_id"),
        )

    @cached_property
    def availability(self) -> DataFrame:
        line = F.col("l_linenumber")
        offers = self.table("lineitem").filter(line <= 3).groupBy("l_partkey", "l_suppkey", "l_linenumber").agg(
            F.concat(F.min("l_returnflag"), F.min("l_linestatus")).alias("flags"),
            F.min("l_linestatus").alias("edition"), F.min("l_shipdate").cast("date").alias("first_ship"), F.min("l_tax").alias("tax"),
        )
        return offers.join(self._supplier_region(), F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("id"),
            F.col("l_partkey").alias("product_id"), F.when(~F.col("flags").startswith("R"), F.concat_ws("-", F.lit("v"), "l_partkey", "edition")).alias("variant_id"),
            F.col("l_suppkey").alias("provider_id"), "region_id",
            vocab.lookup(line, {1: "PURCHASE", 2: "RENTAL", 3: "RAAS"}, None).alias("transaction_type"),
            vocab.lookup(
                F.col("flags"),
                {"AF": "AVAILABLE", "AO": "LIMITED", "NF": "NOT_AVAILABLE", "NO": "PREORDER",
                 "RF": "DISCONTINUED", "RO": "ON_REQUEST"}, None,
            ).alias("availability_status"),
            _null_if(F.col("l_partkey") % 4 == 0, F.col("first_ship")).alias("available_from"),
            (F.col("tax") < 0.07).alias("is_current"),
        )

    @cached_property
    def pricing(self) -> DataFrame:
        line, pair = F.col("l_linenumber"), (F.col("l_partkey") + F.col("l_suppkey")) % 5
        offers = self.table("lineitem").filter(line >= 4).groupBy("l_partkey", "l_suppkey", "l_linenumber").agg(
            F.min("l_extendedprice").cast("decimal(14,2)").alias("low"),
            F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("edition"),
            F.max("l_shipdate").cast("date").alias("last_ship"), F.min("l_tax").alias("tax"),
        )
        transaction = vocab.lookup(line, {4: "PURCHASE", 7: "PURCHASE", 5: "RENTAL", 6: "RAAS"}, None)
        return offers.join(self._supplier_region(), F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("id"),
            F.col("l_partkey").alias("product_id"), F.when(F.col("flag") != "N", F.concat_ws("-", F.lit("v"), "l_partkey", "edition")).alias("variant_id"),
            _null_if(F.col("l_suppkey") % 5 == 0, F.col("l_suppkey")).alias("provider_id"), "region_id",
            transaction.alias("transaction_type"),
            vocab.lookup(pair, dict(enumerate(vocab.PRICE_TYPE)), None).alias("price_type"),
            F.when(F.col("l_suppkey") % 3 == 1, "EUR").otherwise("USD").alias("currency"),
            F.when(pair < 3, F.col("low")).alias("price"),
            F.when(pair == 3, F.col("low")).alias("price_min"),
            F.when(pair == 3, (F.col("low") + 5000).cast("decimal(14,2)")).alias("price_max"),
            F.when(transaction == "PURCHASE", "ONE_TIME").otherwise("MONTHLY").alias("billing_period"),
            (F.col("tax") < 0.07).alias("is_current"), F.col("last_ship").alias("updated_at"),
        )

    @cached_property
    def deployment(self) -> DataFrame:
        rows = self.table("lineitem").groupBy("l_partkey", "l_suppkey").agg(
            F.max("l_extendedprice").cast("decimal(16,2)").alias("contract_value")
        )
        return rows.select(
            F.concat_ws("-", "l_partkey", "l_suppkey").alias("id"), F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("provider_id"), "contract_value",
        )

    @cached_property
    def fit(self) -> DataFrame:
        rows = (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("l_partkey", "c_mktsegment").agg(F.max("l_discount").alias("discount"))
        )
        return rows.select(
            F.col("l_partkey").alias("product_id"), F.col("c_mktsegment").alias("use_case"),
            _null_if(F.col("l_partkey") % 8 == 0, (F.col("discount") * 10).cast("decimal(4,3)")).alias("fit_score"),
        )

    @cached_property
    def evidence(self) -> DataFrame:
        """Two observations of every fact that a finished line attests; facts of open lines only have none.

        Facts fold by numbers; their names are written out after that, since nearly every line has facts of its own
        and a task keeps all their keys.
        """
        part, supp, line, none = F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"), F.col("l_linenumber").cast("long"), F.lit(None).cast("long")
        subjects = ["DEPLOYMENT", "PRICING_OFFER", "AVAILABILITY_OFFER", "COMMERCIAL_STATUS"]
        fact = lambda kind, *key: F.struct(kind.alias("kind"), *[v.alias(c) for v, c in zip(key, ("part", "supp", "line"))])
        facts = F.array(
            fact(F.lit(0), part, supp, none), fact(F.when(line >= 4, 1).otherwise(2), part, supp, line),
            F.when(line == 7, fact(F.lit(3), part, none, none)),
        )
        lines = self.table("lineitem").filter(F.col("l_linestatus") == "F").select(F.explode(facts).alias("f"), F.col("l_shipdate").cast("date").alias("seen"))
        folded = lines.filter(F.col("f").isNotNull()).select("f.*", "seen").groupBy("kind", "part", "supp", "line").agg(
            F.max("seen").alias("last"), F.min("seen").alias("first")
        )
        rows = folded.select(
            vocab.lookup(F.col("kind"), dict(enumerate(subjects)), None).alias("subject_type"), F.concat_ws("-", "part", "supp", "line").alias("subject_id"),
            F.when(F.col("kind") == 3, F.col("part")).otherwise(F.col("part") + F.col("supp")).alias("n"), "last", "first")
        k = F.col("k")
        return rows.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select(
            F.concat_ws("-", "subject_type", "subject_id", "k").alias("id"), "subject_type", "subject_id",
            F.when(F.col("n") % 3 != k, F.date_add("last", 10)).alias("verified_at"),
            F.when(k == 1, F.col("first")).otherwise(F.col("last")).alias("observed_at"),
            _cycle(F.col("n"), *vocab.CONFIDENCE).alias("confidence"),
            F.when(k == 1, "MANUFACTURER_SITE").otherwise("NEWS_ARTICLE").alias("source_type"),
            F.concat(F.lit("https://source.example/"), F.col("n").cast("string")).alias("source_url"),
        )

    @cached_property
    def image(self) -> DataFrame:
        key = F.col("page_id")
        return self.table("pages").select(
            key.alias("id"), F.floor(key / 4).alias("product_id"), F.col("url").alias("image_url"),
            F.when(key % 5 == 0, "UNVERIFIED").otherwise("VERIFIED").alias("identity_status"),
            _cycle(key, "PERMITTED", "ATTRIBUTION_REQUIRED", "UNKNOWN", "RESTRICTED").alias("rights_status"),
            F.when(key % 3 == 0, "OFFICIAL_MANUFACTURER_MEDIA").otherwise("NONE").alias("usage_basis"),
            F.when(key % 6 == 1, F.lit(None)).when(key % 6 == 5, F.lit("  ")).otherwise("Photo desk").alias("attribution"),
            (key % 7 == 0).alias("is_primary"), (key % 2 == 0).alias("is_official"),
            F.when(key % 4 == 0, "FRONT").otherwise("SIDE").alias("image_type"),
            _null_if(key % 8 == 3, F.lit("Press room")).alias("source_name"),
            _null_if(key % 9 == 4, F.col("url")).alias("source_url"),
        )

    @cached_property
    def hero(self) -> DataFrame:
        """Free-text hero image column of a product, kept apart because few products have one."""
        key = F.col("page_id")
        return self.table("pages").groupBy(F.floor(key / 4).alias("product_id")).agg(
            F.concat(F.max(F.when(key % 3 != 1, F.col("url"))), F.lit(" ")).alias("hero_image_url")
        )

    @cached_property
    def status_history(self) -> DataFrame:
        """One row per product, status and day. Distinct as named, so that readers grouping by these columns move nothing again."""
        return self.table("lineitem").select(
            F.col("l_partkey").alias("product_id"),
            vocab.lookup(F.col("l_returnflag"), {"A": "ANNOUNCED", "N": "PROTOTYPE", "R": "COMMERCIAL"}, None).alias("status"),
            F.col("l_shipdate").cast("date").alias("effective_at"),
        ).distinct()

    @cached_property
    def compare_set(self) -> DataFrame:
        """Products picked for side-by-side comparison, at most four per set."""
        return self.product.filter("is_published").select(
            F.floor(F.col("id") / 4).alias("set_id"), "slug", (F.col("id") % 4 + 1).cast("int").alias("position")
        )

    # ---- demand ------------------------------------------------------------------------

    @cached_property
    def requirement(self) -> DataFrame:
        """What each customer asks for; their orders are what they submit later."""
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("id"),
            _null_if(key % 3 == 0, F.col("c_nationkey") + 100).alias("country_id"),
            _null_if(key % 4 == 0, F.col("c_mktsegment")).alias("use_case"),
            _null_if(key % 7 == 0, (key % 40).cast("int")).alias("payload_min_kg"),
            F.when(key % 11 == 0, 8).alias("operating_hours_day"),
            F.when(key % 9 == 0, True).when(key % 9 == 1, False).alias("manipulation_required"),
            F.when(key % 13 == 0, "SUPERVISED_AUTONOMY").alias("autonomy_required"),
            F.when((key % 3 == 1) | (key % 12 == 5), "USD").alias("budget_currency"),
            F.when(key % 12 == 5, F.lit(1000.0)).alias("budget_min"),
            F.when(key % 3 == 1, F.floor((F.col("c_acctbal") + 1000) * 4).cast("double")).alias("budget_max"),
            F.when(key % 17 == 0, F.date_add(F.lit("1996-01-01").cast("date"), (key % 1500).cast("int"))).alias("required_by"),
            _cycle(key, "BUY", "RENT", "RAAS", "UNKNOWN", "FLEXIBLE").alias("preferred_transaction"),
        )

    # ---- discovery ---------------------------------------------------------------------

    @cached_property
    def candidate(self) -> DataFrame:
        key = F.col("doc_id")
        named = F.when(key % 10 == 0, F.lit("Robot")).otherwise(F.concat(F.upper("p_name"), F.lit(" Robot")))
        state = _cycle(key, "NOT_TRACED", "TRACE_CONFIRMED", "TRACE_PARTIAL", "TRACE_FAILED", "TRACE_CONFIRMED")
        return self.table("documents").join(self.table("part"), F.col("p_partkey") == key).select(
            key.alias("id"), "source", F.concat(F.lit("ref-"), F.floor(key / 3).cast("string")).alias("external_ref"),
            named.alias("name"), F.concat(F.col("p_brand"), F.lit(" Inc.")).alias("manufacturer"),
            F.when(key % 97 == 5, "COMPONENT").otherwise("ROBOT").alias("entity_type"),
            F.concat(F.lit("https://radar.example/"), key.cast("string")).alias("discovery_url"),
            _null_if(key % 5 == 2, F.concat(F.lit("https://maker.example/"), key.cast("string"))).alias("official_url"),
            state.alias("trace_state"),
            F.when(state == "TRACE_CONFIRMED", F.concat(F.lit("https://maker.example/"), key.cast("string"))).alias("trace_url"),
            F.when((state == "TRACE_CONFIRMED") & (key % 10 != 9), "R. Viewer").alias("trace_verified_by"),
            F.when(key % 50 == 7, "PROMOTED").when(key % 50 == 8, "REJECTED").otherwise("DISCOVERED").alias("status"),
            F.date_add(F.lit("2025-06-01").cast("date"), (key % 90).cast("int")).alias("updated_at"),
        )

    @cached_property
    def source(self) -> DataFrame:
        """Discovery sources with their eligibility review."""
        k = F.col("k")
        rows = self.table("documents").groupBy(F.col("source").alias("key")).agg(F.min("doc_id").alias("k"))
        return rows.select(
            "key", F.concat(F.lit("Source "), "key").alias("name"), (k % 4 != 0).alias("is_enabled"),
            F.when(k % 3 == 0, "UNKNOWN").otherwise("ALLOWED").alias("tos_status"),
            F.when(k % 5 == 0, "DISALLOWED").when(k % 5 == 1, "NOT_APPLICABLE").otherwise("ALLOWED").alias("robots_status"),
            _null_if(k % 7 == 0, F.lit("2026-01-01").cast("date")).alias("reviewed_at"),
            _null_if(k % 11 == 0, F.lit("R. Viewer")).alias("reviewed_by"),
        )

    @cached_property
    def claim(self) -> DataFrame:
        key = F.col("doc_id")
        return self.table("documents").select(
            key.alias("id"), F.floor(key / 5).alias("candidate_id"), "source", F.col("lang").alias("field_key"),
            _null_if(key % 9 == 0, (F.col("n_chars") % 3).cast("string")).alias("claimed_value"),
            F.concat(F.lit("https://radar.example/"), key.cast("string")).alias("evidence_url"),
        )

    @cached_property
    def spec_claim(self) -> DataFrame:
        """Claims about promotable measurements, three per traced document."""
        key = F.col("doc_id")
        fields = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(f).alias("field_key")) for i, f in
                                     enumerate(["height_cm", "weight_kg", "payload_kg"])])).alias("f")
        rows = self.table("documents").select("doc_id", "n_chars", fields).select("doc_id", "n_chars", "f.*")
        k = F.col("k")
        return rows.select(
            F.concat_ws("-", "doc_id", "k").alias("id"), key.alias("candidate_id"), "field_key",
            F.when((key + k) % 7 == 0, F.lit("tall")).otherwise(((F.col("n_chars") + k) % 200).cast("string")).alias("claimed_value"),
            F.when((key + k) % 11 == 0, "IN").when((key + k) % 3 == 0, F.lit(None)).otherwise(F.upper(F.split("field_key", "_")[1])).alias("unit"),
            F.when((key + k) % 2 == 0, "VERIFIED").when((key + k) % 5 == 0, "CONFLICT").otherwise("NOT_VERIFIED").alias("claim_status"),
            F.concat(F.lit("https://radar.example/"), key.cast("string")).alias("evidence_url"),
        )

    @cached_property
    def decision(self) -> DataFrame:
        return self.table("labels").select(
            F.col("doc_id").alias("candidate_id"),
            F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "confirm").otherwise("").alias("decision"),
        )

    @cached_property
    def event(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"), "event_type", "ts", F.col("user_id").alias("client"), "props"
        )
