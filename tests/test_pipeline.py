"""Discovery, promotion, authoring and leads on small literal tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from lumenstock.functions import text
from lumenstock.operators import discovery as dc
from lumenstock.operators import leads as ld
from lumenstock.operators import promotion as pr


def test_keys_keep_repeated_tokens(spark):
    df = spark.createDataFrame([("Acme Robotics, Inc.", "ACME  X-1 x Robot")], "m string, n string")
    row = df.select(text.normalize(F.col("m")).alias("m"), text.model_key(F.col("n"), text.normalize(F.col("m"))).alias("k"),
                    text.product_slug(F.lit("Figure AI"), F.lit("Figure 01")).alias("s"), text.product_slug(F.lit("Agility Robotics"), F.lit("Digit")).alias("t")).collect()[0]
    assert (row.m, row.k, row.s, row.t) == ("acme", "x 1 x", "figure-01", "agility-digit")


def test_unnamed_candidate_with_one_sibling(spark):
    makers = spark.createDataFrame([("acme", "Acme"), ("other", "Other")], "slug string, name string")
    products = spark.createDataFrame([(1, "A1", "acme"), (2, "B1", "other"), (3, "B2", "other")], "id long, name string, manufacturer_slug string")
    people = spark.createDataFrame([(1, "Acme Robot", "Acme"), (2, "Other", "Other"), (3, "A1", "Acme Inc"), (4, "Z9", "Acme"), (5, "N", "Nobody"), (6, "n", "nobody")],
                                   "id long, name string, manufacturer string")
    got = {r.id: (r.identity_status, r.possible_product_id) for r in dc.resolve_identity(people, products, makers).collect()}
    assert got == {1: ("POSSIBLE_DUPLICATE", 1), 2: ("AMBIGUOUS", None), 3: ("MATCHED_EXISTING", 1), 4: ("NEW_ENTITY", None),
                   5: ("POSSIBLE_DUPLICATE", None), 6: ("POSSIBLE_DUPLICATE", None)}


def test_slugs_fill_gaps_in_order(spark):
    new = spark.createDataFrame([(i, "x") for i in range(1, 5)] + [(9, "y"), (10, "x-2")], "id long, base string")
    taken = spark.createDataFrame([("x",), ("x-3",), ("y-2",)], "slug string")
    got = {r.id: r.slug for r in pr.unique_slugs(new, taken).collect()}
    # x-2 is itself a base, so rows of x pass over it.
    assert got == {1: "x-4", 2: "x-5", 3: "x-6", 4: "x-7", 9: "y", 10: "x-2"}


def test_new_makers_get_free_slugs_and_share_by_key(spark):
    people = [(i, n, m, "NEW_ENTITY", None, "TRACE_CONFIRMED", "https://x", "R", "ROBOT", "READY_FOR_PROMOTION") for i, n, m in
              [(1, "One", "Zed Robotics"), (2, "Two", "Acme Labs"), (3, "Three", "Acme Inc"), (4, "Four", "Known Inc")]]
    people = spark.createDataFrame(people, "id long, name string, manufacturer string, identity_status string, possible_product_id long, trace_state string, "
                                           "trace_url string, trace_verified_by string, entity_type string, status string")
    claims = spark.createDataFrame([], "id string, candidate_id long, field_key string, claimed_value string, unit string, claim_status string, evidence_url string")
    products = spark.createDataFrame([], "id long, slug string, name string, " + ", ".join(f"{f} double" for f in pr.APPROVED_FIELDS))
    makers = spark.createDataFrame([("zed-robotics", "Completely Different"), ("known", "Known")], "slug string, name string")
    signed = spark.createDataFrame([(i, "R") for i in range(1, 5)], "candidate_id long, approved_by string")
    written = pr.promote(people, claims, products, makers, signed)
    assert {(r.slug, r.name) for r in written["makers"].collect()} == {("zed-robotics-2", "Zed Robotics"), ("acme-labs", "Acme Labs")}
    assert {r.slug: r.manufacturer_slug for r in written["products"].collect()} == {"one": "zed-robotics-2", "two": "acme-labs", "three": "acme-labs", "four": "known"}


def test_source_registration_needs_a_person_and_is_idempotent(spark):
    none = spark.createDataFrame([], "key string, name string, is_enabled boolean, tos_status string, robots_status string, reviewed_at date, reviewed_by string")
    with pytest.raises(ValueError):
        dc.register_source(none, "d", " ")
    once = dc.register_source(none, "d", "R. Viewer")
    assert once.count() == 1 and dc.register_source(once, "d", "R. Viewer").count() == 1


def test_worksheet_problems(spark):
    rows = spark.createDataFrame(
        [(1, "confirm", "h", "", ""), (2, "reject", "h", "u", " "), (3, "maybe", "h", "u", "r"), (4, "confirm", "", "u", ""), (5, "", "", "", ""), (5, "", "", "", "")],
        "candidate_id long, decision string, snapshot_hash string, trace_url string, reject_reason string")
    got = {(r.candidate_id, r.problem) for r in dc.validate_worksheet(rows).collect()}
    assert got == {(1, "confirm_needs_trace_url"), (2, "reject_needs_reason"), (3, "unknown_decision"), (4, "snapshot_hash_missing"), (5, "duplicate_candidate_id")}


def test_rejection_needs_name_reason_and_open_candidate(spark):
    people = spark.createDataFrame([(1, "DISCOVERED"), (2, "PROMOTED"), (3, "DISCOVERED")], "id long, status string")
    calls = spark.createDataFrame([(1, "R. Viewer", "not a robot"), (2, "R. Viewer", "x"), (3, " ", "x")], "candidate_id long, approved_by string, reason string")
    assert [r.candidate_id for r in dc.reject(people, calls).collect()] == [1]


def test_spec_edits(spark):
    stated = spark.createDataFrame([("p", 100.0, None, None, None, None, None, None, "WHEELED", None, None, None, None, None, True, None, None)],
                                   ", ".join(f"{c} {t}" for c, t in [("slug", "string")] + [(f, "double" if f in pr.NUMERIC_SPECS else "boolean" if f in pr.BOOLEAN_SPECS else "string") for f in pr.SPEC_FIELDS]))
    edits = spark.createDataFrame([
        ("p", "height_cm", "100", None, None), ("p", "weight_kg", "12.50", "u", "2026-01-01"), ("p", "payload_kg", "0", "u", "2026-01-01"),
        ("p", "mobility", "bipedal", "u", "2026-01-01"), ("p", "autonomy", "SENTIENT", "u", "2026-01-01"), ("p", "has_api", "true", "u", "2026-01-01"),
        ("p", "hand_dof", "6", None, "2026-01-01"), ("q", "hand_dof", "6", "u", "2026-01-01"), ("p", "has_sdk", "", "u", "2026-01-01"),
    ], "slug string, field string, value string, source_url string, retrieved_on string")
    changes, rejected = pr.apply_specs(stated, edits)
    assert {(r.field, r.new) for r in changes.collect()} == {("weight_kg", "12.5"), ("mobility", "BIPEDAL"), ("has_sdk", None)}
    assert {(r.slug, r.field) for r in rejected.collect()} == {("p", "payload_kg"), ("p", "autonomy"), ("p", "has_api"), ("p", "hand_dof"), ("q", "hand_dof")}


def test_lead_is_created_once_then_extended(spark):
    region = spark.createDataFrame([(5, "COUNTRY", "DE"), (6, "COUNTRY", "FR")], "id int, type string, code string")
    needs = spark.createDataFrame([(1, 5, "BUY")], "id long, country_id int, preferred_transaction string")
    stored = spark.createDataFrame([(1, "a", 1, 90), (1, "b", 2, 80)], "requirement_id long, slug string, rank int, score int")
    products = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", False)], "id long, slug string, is_published boolean")
    fields = "id long, requirement_id long, contact_email string, contact_name string, organization string, contact_phone string, country string, preferred_transaction string, message string, product_slugs array<string>"
    rows = spark.createDataFrame([
        (1, 1, "B@x.io", None, "Org", None, None, None, None, ["a"]), (2, 1, "b@X.io ", "Ann", "Other", None, "FR", "RENT", "hi", ["b"]),
        (3, 1, "evil@x.io", "E", "E", None, None, None, None, ["a"]), (4, 1, "b@x.io", "Bob", "O", "1", None, None, None, ["c"]),
        (5, None, "c@x.io", "C", "C", None, None, None, None, ["a"]), (6, None, "c@x.io", "C", "C", None, None, None, None, ["c"]),
    ], fields)
    leads, lines, rejected = ld.capture_leads(rows, needs, stored, products, region)
    linked = leads.filter("lead_id = 1").collect()[0]
    assert (linked.contact_email, linked.contact_name, linked.organization, linked.country_id, linked.preferred_transaction, linked.submissions) == ("B@x.io", "Ann", "Org", 6, "RENT", 2)
    assert {(r.lead_id, r.slug, r.score, r.is_selected) for r in lines.collect()} == {(1, "a", 90, True), (1, "b", 80, True), (5, "a", None, True)}
    assert {r.id for r in rejected.collect()} == {3, 4, 6}


def test_wizard_states(spark):
    raw = ('{"wizard_version":1,"answers":{"payload":{"state":"ANSWERED","value":" 12 "},"hours":{"state":"UNKNOWN","value":"8"},'
           '"transaction":{"state":"ANSWERED","value":"UNKNOWN"},"budget":{"state":"SKIPPED","currency":"USD","max":5}}}')
    skipped = '{"wizard_version":1,"answers":{"payload":{"state":"SKIPPED"}}}'
    df = ld.normalize_requirements(spark.createDataFrame([(1, raw), (2, skipped)], "id int, raw_input string"))
    a, b = df.withColumn("signal", ld.has_signal()).orderBy("id").collect()
    assert (a.payload_min_kg, a.operating_hours_day, a.budget_max, a.preferred_transaction, a.signal) == (12.0, None, None, "UNKNOWN", True)
    assert b.signal is False


def test_ingest_refuses_ineligible_source(spark):
    day = datetime.date(2026, 1, 1)
    sources = spark.createDataFrame([("ok", True, "ALLOWED", "ALLOWED", day, "R"), ("no", True, "UNKNOWN", "ALLOWED", day, "R")],
                                    "key string, is_enabled boolean, tos_status string, robots_status string, reviewed_at date, reviewed_by string")
    store = spark.createDataFrame([("ok", "r1", 1, "one", day)], "source string, external_ref string, candidate_id long, name string, last_seen_at date")
    later = datetime.date(2026, 2, 1)
    batch = spark.createDataFrame([("ok", "r1", 7, "changed", later), ("ok", "r2", 8, "two", later), ("ok", "r2", 9, "again", later), ("no", "r3", 10, "x", later)],
                                  "source string, external_ref string, candidate_id long, name string, seen_at date")
    merged, refused = dc.ingest(store, batch, sources)
    assert {(r.external_ref, r.candidate_id, r.name, r.last_seen_at, r.action) for r in merged.collect()} == {
        ("r1", 1, "one", later, "SEEN"), ("r2", 8, "two", later, "INSERTED")}
    assert [r.external_ref for r in refused.collect()] == ["r3"]
