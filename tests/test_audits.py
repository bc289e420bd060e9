"""The append-only audit by buckets."""

from pyspark.sql import functions as F

from lumenstock.operators import audits
from lumenstock.operators import evidence as ev
from lumenstock.plans import QUERIES

LOG = "id long, day int, note string"


def test_lost_and_changed_rows(spark):
    before = spark.createDataFrame([(i, i // 10, "x") for i in range(100)] + [(500, None, None), (None, 1, "x")], LOG)
    after = spark.createDataFrame([(i, i // 10, "y" if i == 7 else "x") for i in range(130) if i != 42] + [(500, None, None), (None, 1, "x")], LOG)
    for bucket in (None, F.coalesce("day", F.lit(-1)), F.lit(0)):
        key = ["id"] if bucket is None else ["id", "day"]
        got = {(r.id, r.violation) for r in audits.append_only_violations(before, after, key, bucket).filter("id IS NOT NULL AND id < 500").collect()}
        assert got == {(42, "missing"), (7, "changed")}
    assert audits.append_only_violations(before, before, ["id"]).count() == 0
    assert audits.append_only_violations(before.limit(0), after, ["id"]).count() == 0


def test_swapped_contents_are_seen(spark):
    before = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], LOG)
    after = spark.createDataFrame([(1, 1, "b"), (2, 1, "a")], LOG)
    assert audits.append_only_violations(before, after, ["id"], F.lit(0)).count() == 2


def test_tokens_travel_as_bytes_and_any_text_comes_back(spark):
    """Only tokens as this key issues them resolve; others, alike or null, keep their text."""
    rows = [("e1", "DEPLOYMENT", "d1"), ("e2", "DEPLOYMENT", "gone"), ("e3", "OTHER", "d1")]
    evidence = spark.createDataFrame(rows, "id string, subject_type string, subject_id string")
    products = spark.createDataFrame([(1, True)], "id long, is_published boolean")
    deployments = spark.createDataFrame([("d1", 1)], "id string, product_id long")
    none = spark.createDataFrame([], "id string, product_id long, is_current boolean")
    issue = lambda i: ev.issue_ref(F.lit(i), "s", "k1")
    good = spark.range(1).select(issue("e1").alias("a"), issue("e2").alias("b"), issue("e3").alias("c")).first()
    odd = [good.a.upper(), good.a + "0", good.a + "\n", good.a.replace("k1", "k2"), good.a[:-1], "er1.k1.", "", None, "forged"]
    tokens = spark.createDataFrame([(t,) for t in [*good, good.a, *odd]], "token string")
    found = ev.resolve_evidence(tokens, evidence, products, none, none, deployments, "s", "k1")
    got = sorted(((r.token or "", r.token is None, r.evidence_id, r.outcome) for r in found.collect()), key=str)
    want = [(good.a, False, "e1", "RESOLVED")] * 2 + [(t or "", t is None, None, "UNRESOLVED") for t in [good.b, good.c, *odd]]
    assert got == sorted(want, key=str)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "LeftOuter" in line]
    assert joins and all("_asked" in line for line in joins)


def test_a_log_dealt_out_by_its_key_does_not_move_again(spark):
    """Null keys are values, and repeated rows compare as bags."""
    log = spark.createDataFrame([(i % 50, i % 7, "x") for i in range(400)] + [(None, 1, "x")], LOG)
    before = log.distinct()
    after = before.filter("id <> 11 OR id IS NULL")
    found = audits.append_only_violations(before.select("id", "day", "note"), after, ["id", "day", "note"])
    assert {(r.id, r.violation) for r in found.collect()} == {(11, "missing")}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 2
    twice = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 1, "a"), (2, 1, "a")], LOG)
    once = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (2, 1, "a")], LOG)
    assert [tuple(r) for r in audits.append_only_violations(twice, once, ["id"]).collect()] == [(2, "changed")]


def test_specifications_fold_only_where_they_are_dealt_to(spark, sf_dir):
    plan = QUERIES["unique_audit"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("REPARTITION_BY_NUM"):].split("- Generate explode")[0]
    assert "partial_count" not in below


def test_best_evidence_carries_only_what_is_asked(spark, sf_dir):
    rows = [("a", "P", "1", None, 5, "LOW", "u1"), ("b", "P", "1", 3, 1, "HIGH", "u2"), ("c", "P", "1", 3, 2, "LOW", "u3"), ("d", "P", "1", 9, 2, "HIGH", "u4"), ("e", "P", "2", None, None, None, None)]
    evidence = spark.createDataFrame(rows, "id string, subject_type string, subject_id string, verified_at int, observed_at int, confidence string, source_url string").withColumn("source_type", F.lit("x"))
    some = ev.best_evidence(evidence, ["evidence_id", "confidence", "verified_at"])
    assert sorted(tuple(r) for r in some.collect()) == [("P", "1", "d", "HIGH", 9), ("P", "2", "e", None, None)]
    assert [tuple(r) for r in ev.best_evidence(evidence).filter("subject_id = '1'").collect()] == [("P", "1", "d", "x", "HIGH", 2, 9, "u4")]
    assert "source.example" not in QUERIES["facts_with_evidence"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
