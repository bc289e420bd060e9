"""A worksheet applied: what is written, what is refused, and that a replay writes nothing twice."""

import datetime

import pytest
from pyspark.sql import functions as F

from lumenstock.operators import discovery as dc
from lumenstock.operators import promotion as pr
from lumenstock.operators import review as rv

DAY = datetime.date(2026, 1, 1)
SHEET = "candidate_id long, decision string, snapshot_hash string, trace_url string, trace_source_type string, reject_reason string"


@pytest.fixture
def model(spark):
    people = [(i, f"ref-{i}", n, m, s, p, "NOT_TRACED", None, None, None, "ROBOT", st, DAY) for i, n, m, s, p, st in [
        (1, "One", "Zed", "NEW_ENTITY", None, "DISCOVERED"), (2, "Known", "Acme", "MATCHED_EXISTING", 7, "DISCOVERED"),
        (3, "Known", "Acme", "MATCHED_EXISTING", 7, "DISCOVERED"), (4, "Four", "Zed", "AMBIGUOUS", None, "DISCOVERED"),
        (5, "Five", "Zed", "NEW_ENTITY", None, "DISCOVERED"), (6, "Six", "Zed", "NEW_ENTITY", None, "PROMOTED"), (8, "One", "Zed", "NEW_ENTITY", None, "DISCOVERED")]]
    claims = [(f"{c}-{f}", c, f, v, None, "VERIFIED", f"https://e/{c}") for c, f, v in [
        (1, "height_cm", "120"), (2, "height_cm", "130"), (3, "height_cm", "140"), (3, "weight_kg", "50"), (2, "payload_kg", "9")]]
    return {
        "candidates": spark.createDataFrame(people, "id long, external_ref string, name string, manufacturer string, identity_status string, possible_product_id long, "
                                                    "trace_state string, trace_url string, trace_verified_by string, official_url string, entity_type string, status string, updated_at date"),
        "claims": spark.createDataFrame(claims, "id string, candidate_id long, field_key string, claimed_value string, unit string, claim_status string, evidence_url string"),
        "products": spark.createDataFrame([(7, "known", "Known", None, None, 3.0), (9, "one", "One", None, None, None)],
                                          "id long, slug string, name string, height_cm double, weight_kg double, payload_kg double"),
        "makers": spark.createDataFrame([("acme", "Acme")], "slug string, name string"),
        "rechecks": spark.createDataFrame([], "candidate_id long"),
    }


def _sheet(spark, model, decisions):
    hashes = {r.id: r.snapshot_hash for r in dc.snapshot_hash(model["candidates"]).collect()}
    return spark.createDataFrame([(i, d, hashes.get(i, "h"), f"https://t/{i}", None, "no robot") for i, d in decisions.items()], SHEET)


def _apply(spark, model, sheet, **more):
    return rv.apply_worksheet(sheet, model, " R. Viewer ", F.lit(DAY + datetime.timedelta(1)), **more)


def test_linked_outputs_and_replay(spark, model):
    sheet = _sheet(spark, model, {1: "confirm", 2: "confirm", 3: "confirm", 4: " Confirm", 5: "reject", 6: "confirm", 8: "confirm", 99: "confirm"})
    out = _apply(spark, model, sheet)
    products = {r.candidate_id: r for r in out["products"].collect()}
    assert {i: r.slug for i, r in products.items()} == {1: "one-2", 8: "one-3"} and not any(r.is_published for r in products.values())
    assert [(r.slug, r.candidate_id) for r in out["makers"].collect()] == [("zed", 1)]
    # The first of two candidates of one product fills a field; what is known stays.
    assert {(r.candidate_id, r.product_slug, r.field, float(r.value)) for r in out["fields"].collect()} == {
        (1, "one-2", "height_cm", 120.0), (2, "known", "height_cm", 130.0), (3, "known", "weight_kg", 50.0)}
    evidence = {r.candidate_id: r for r in out["evidence"].collect()}
    assert evidence[2].subject_id == "7" and evidence[1].subject_id == products[1].key and evidence[1].source_type == rv.DEFAULT_TRACE_TYPE
    audit = {r.candidate_id: r for r in out["audit"].collect()}
    assert set(audit) == {1, 2, 3, 5, 8} and audit[5].action == "REJECTED" and audit[5].reason == "no robot"
    assert audit[1].evidence_key == evidence[1].evidence_key and audit[3].promoted_fields == ["weight_kg=50.0000"] and audit[8].promoted_fields == []
    why = {(r.candidate_id, r.outcome): r.why for r in out["outcomes"].collect()}
    assert why[(4, "blocked")] == "PROMOTION:P1:AMBIGUOUS|NOT_READY:IDENTITY_REVIEW" and (4, "confirmed") in why
    assert why[(6, "skipped")] == "ALREADY:PROMOTED" and why[(99, "blocked")] == "NOT_FOUND"
    assert out["totals"].collect()[0].asDict() == {"confirmed": 5, "promoted": 4, "rejected": 1, "blocked": 2, "skipped": 1}

    after = {r.id: r for r in out["candidates"].collect()}
    assert len(after) == 7 and after[1].status == "PROMOTED" and after[5].status == "REJECTED" and after[4].trace_url == "https://t/4"
    again = _apply(spark, {**model, "candidates": out["candidates"]}, sheet)
    assert all(again[name].count() == 0 for name in ("products", "makers", "fields", "evidence", "audit"))
    assert again["totals"].collect()[0].asDict() == {"confirmed": 0, "promoted": 0, "rejected": 0, "blocked": 2, "skipped": 6}


def test_keys_come_from_content(spark, model):
    sheet = _sheet(spark, model, {1: "confirm", 2: "confirm"})
    rows = lambda: {(r.evidence_key, r.product_key) for r in _apply(spark, model, sheet)["audit"].collect()}
    assert rows() == rows()


def test_traces_without_promotion(spark, model):
    out = _apply(spark, model, _sheet(spark, model, {1: "confirm"}), promote_confirmed=False)
    assert out["products"].count() == 0 and {r.id: r.status for r in out["candidates"].collect()}[1] == "READY_FOR_PROMOTION"


def test_refused_as_a_whole(spark, model):
    bad = spark.createDataFrame([(1, "confirm", "h", " ", None, None), (2, "skip", "h", "u", None, None)], SHEET)
    with pytest.raises(ValueError):
        _apply(spark, model, bad)
    with pytest.raises(ValueError):
        rv.apply_worksheet(bad, model, " ", F.current_date())


def test_empty_worksheet(spark, model):
    out = _apply(spark, model, spark.createDataFrame([], SHEET))
    assert all(out[name].count() == 0 for name in ("products", "makers", "fields", "evidence", "audit", "outcomes"))
    assert out["candidates"].count() == 7


def test_a_worksheet_is_read_once(spark, model, tmp_path):
    """What the sheet was made from is not computed again for its checks, its verdicts and its notes."""
    seen = spark.sparkContext.accumulator(0)
    sheet = _sheet(spark, model, {1: "confirm", 2: "skip", 5: "reject"})

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    out = _apply(spark, model, sheet.mapInArrow(counted, sheet.schema))
    assert out["outcomes"].count() >= 3 and out["totals"].count() == 1 and seen.value == 3
