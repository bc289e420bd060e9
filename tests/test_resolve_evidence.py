"""References to evidence: which resolve, and what has to move to find that out."""

from pyspark.sql import functions as F

from lumenstock.operators import evidence as ev


def _resolved(spark):
    rows = [("e1", "DEPLOYMENT", "d1"), ("e2", "DEPLOYMENT", "gone"), ("e3", "COMMERCIAL_STATUS", "7"), ("e4", "COMMERCIAL_STATUS", "8"), ("e5", "OTHER", "7"), (None, "DEPLOYMENT", "d1")]
    evidence = spark.createDataFrame(rows, "id string, subject_type string, subject_id string")
    products = spark.createDataFrame([(7, True), (8, False)], "id long, is_published boolean")
    deployments = spark.createDataFrame([("d1", 7), ("d2", 8)], "id string, product_id long")
    none = spark.createDataFrame([], "id string, product_id long, is_current boolean")
    issued = evidence.filter("id IS NOT NULL").select(ev.issue_ref(F.col("id"), "secret", "k1").alias("token"))
    other = spark.createDataFrame([("er1.k1.forged",), (None,), ("er1.k1." + "0" * 64,)], "token string")
    tokens = issued.unionByName(other).unionByName(issued.limit(1)).unionByName(issued.limit(1).select(F.upper("token").alias("token")))
    return ev.resolve_evidence(tokens, evidence, products, none, none, deployments, "secret", "k1")


def test_only_served_subjects_resolve(spark):
    rows = _resolved(spark).collect()
    assert sorted((r.evidence_id, r.subject_type, r.subject_id) for r in rows if r.outcome == "RESOLVED") == [
        ("e1", "DEPLOYMENT", "d1"), ("e1", "DEPLOYMENT", "d1"), ("e3", "COMMERCIAL_STATUS", "7")]
    assert len(rows) == 10 and sorted(r.outcome for r in rows)[3:] == ["UNRESOLVED"] * 7
    assert [r.token for r in rows if r.token is None] == [None]


def test_evidence_moves_without_its_digest(spark):
    plan = _resolved(spark)._jdf.queryExecution().optimizedPlan()
    joins = [n for n in (plan.apply(i) for i in range(60)) if n is not None and n.nodeName() == "Join"]
    assert [f.name() for f in joins[0].right().schema().fields()] == ["evidence_id", "subject_type", "subject_id"]
