"""Streams give the batch result; documents read with absent keys as NULL."""

import json

import pytest
from pyspark.sql import functions as F

from lumenstock.plans import QUERIES, ingest
from lumenstock.sources import documents as docs
from lumenstock.sources import exports
from lumenstock.sources.catalog import Catalog
from lumenstock.streaming import candidates, events

SF = "/root/testdata/sf0.001"


def drain(df, spark, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


def test_rollup_and_rate_stream_equal_batch(spark, tmp_path):
    batch = Catalog(spark, SF).event
    batch.write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    assert drain(events.event_rollup(feed), spark, "rollup") == {tuple(r) for r in events.event_rollup(batch).collect()}
    tier = lambda df: events.rate_tier(df, "client", "burst", 86400, 3)
    assert drain(tier(feed), spark, "rate") == {tuple(r) for r in tier(batch).collect()}


def test_candidate_stream_keeps_first_record_and_last_sighting(spark, tmp_path):
    sources = Catalog(spark, SF).source.limit(1).select(
        F.lit("s").alias("key"), F.lit(True).alias("is_enabled"), F.lit("ALLOWED").alias("tos_status"), F.lit("ALLOWED").alias("robots_status"),
        F.current_date().alias("reviewed_at"), F.lit("R").alias("reviewed_by"))
    schema = "candidate_id long, source string, external_ref string, name string, seen_at date"
    src, store, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))

    def arrive(rows):
        df = spark.createDataFrame(rows, "candidate_id long, source string, external_ref string, name string, day string")
        df.select("candidate_id", "source", "external_ref", "name", F.col("day").cast("date").alias("seen_at")).write.mode("append").parquet(src)
        feed = spark.readStream.schema(schema).parquet(src)
        candidates.stream_ingest(feed, store, sources, mark).awaitTermination()

    arrive([(5, "s", "r1", "first", "2026-01-01"), (6, "x", "r9", "refused", "2026-01-01")])
    arrive([(1, "s", "r1", "later", "2026-03-01"), (2, "s", "r2", "new", "2026-02-01")])
    got = {(r.external_ref, r.candidate_id, r.name, str(r.last_seen_at)) for r in candidates.current_candidates(spark, store).collect()}
    assert got == {("r1", 5, "first", "2026-03-01"), ("r2", 2, "new", "2026-02-01")}


def test_documents_and_dimensions(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps({"slug": "a", "name": "A", "pricing_offers": [{"transaction_type": "PURCHASE", "evidence": [{"source_url": "u"}]}]}, indent=1))
    (tmp_path / "d.json").write_text(json.dumps({"regions": [{"code": "DE", "type": "COUNTRY"}, {"code": "EU"}]}, indent=1))
    flat = docs.flatten_products(docs.read_products(spark, str(tmp_path / "p")))
    price = flat["pricing_offers"].collect()[0]
    assert (price.currency, price.billing_period, price.price, price.position) == ("USD", "ONE_TIME", None, 0)
    assert flat["products"].collect()[0].commercial_status == "UNKNOWN"
    evidence = docs.explode_evidence(flat).collect()
    assert [(e.subject_type, e.subject_id, e.confidence) for e in evidence] == [("PRICING_OFFER", price.id, "MEDIUM")]
    assert {r.code for r in docs.read_dimension(spark, str(tmp_path / "d.json"), "regions").collect()} == {"DE", "EU"}


def test_publication_is_kept_unless_opted_in(spark):
    old = spark.createDataFrame([("a", True), ("b", False)], "slug string, is_published boolean")
    new = spark.createDataFrame([("a", False), ("b", True), ("c", True)], "slug string, is_published boolean")
    state = lambda df: {r.slug: r.is_published for r in df.collect()}
    assert state(docs.merge_published(old, new)) == {"a": True, "b": False, "c": True}
    assert state(docs.merge_published(old, new, apply_state=True)) == {"a": False, "b": True, "c": True}


def test_jsonld_is_valid_and_omits_unknown(spark, tmp_path):
    c = Catalog(spark, SF)
    for r in exports.jsonld(c.product, "https://c.example").limit(50).collect():
        graph = json.loads(r.jsonld)["@graph"]
        assert all(p["value"] not in (None, "") for p in graph[0]["additionalProperty"])
    exports.export_jsonld(c.product, str(tmp_path / "ld"), "https://c.example")
    exports.export_sitemap(c.product, c.manufacturer, c.use_case, str(tmp_path / "sm"), "https://c.example")
    exports.export_llms_txt(c.product, c.manufacturer, c.use_case, str(tmp_path / "llms"), "https://c.example")
    assert spark.read.text(str(tmp_path / "ld")).count() == c.product.filter("is_published").count()


@pytest.mark.parametrize("name", ["evidence_fanout", "flatten_offers"])
def test_documents_are_parsed_once(spark, sf_dir, name):
    """All child lists of a document come from one parse of its text."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_evidence_in_one_pass_equals_each_kind(spark, tmp_path):
    part = {"evidence": [{"source_url": "u", "confidence": None}, {"source_url": "v", "confidence": "HIGH"}]}
    rows = [
        {"slug": "a", "commercial_status_evidence": [{"source_url": "s"}], "pricing_offers": [part, {"price": 1}, part], "deployments": [part], "variants": [{"slug": "x"}]},
        {"slug": "b", "availability_offers": [{}, part], "pricing_offers": []}, {"slug": "c"}, {"slug": None, "pricing_offers": [part]},
    ]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    read = docs.read_products(spark, str(tmp_path), multi_line=False)
    got, want = docs.document_evidence(read), docs.explode_evidence(docs.flatten_products(read))
    assert got.count() == 11 and got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stored_documents_are_packed(spark, sf_dir):
    stored = ingest.stored_documents(Catalog(spark, sf_dir))
    assert stored.inputFiles() and all(f.endswith(".json.gz") for f in stored.inputFiles())
    assert stored.count() == ingest.product_documents(Catalog(spark, sf_dir)).count()
