"""Queries of the matcher. Their SQL scores every pair, which the Spark jobs avoid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as mt
from ..sources.catalog import Catalog
from .offers import applicable
from .registry import query, shared_view

LEVELS = "['TELEOPERATED','ASSISTED','SUPERVISED_AUTONOMY','TASK_AUTONOMOUS','HIGHLY_AUTONOMOUS']"
_CLASS = """CASE preferred_transaction WHEN 'RENT' THEN 'RENTAL' WHEN 'BUY' THEN 'PURCHASE' WHEN 'LEASE' THEN 'LEASE'
    WHEN 'RAAS' THEN 'RAAS' ELSE 'ANY' END"""


def match_model(c: Catalog) -> dict:
    return {
        "requirements": c.requirement, "products": c.product, "availability": c.availability, "pricing": c.pricing,
        "fits": c.fit, "deployments": c.deployment, "evidence": c.evidence, "region": c.region, "applicable": applicable(c),
    }


shared_view("m_pair", f"""
SELECT r.id AS requirement_id, r.country_id, r.use_case, r.payload_min_kg, r.operating_hours_day, r.manipulation_required, r.autonomy_required,
  r.budget_currency, r.budget_min, r.budget_max, r.required_by, {_CLASS} AS class,
  p.id AS product_id, p.slug, p.commercial_status, CAST(p.payload_kg AS DOUBLE) AS payload_kg, p.has_manipulation, p.autonomy, p.runtime_minutes,
  p.has_sdk, p.ros_support, p.developer_edition,
  coalesce(p.payload_kg < r.payload_min_kg, false) AS x_payload,
  coalesce(r.manipulation_required AND NOT p.has_manipulation, false) AS x_manipulation,
  coalesce(list_position({LEVELS}, p.autonomy) < list_position({LEVELS}, r.autonomy_required), false) AS x_autonomy,
  p.commercial_status = 'DISCONTINUED' AS x_discontinued
FROM m_requirement r CROSS JOIN m_product p WHERE p.is_published""")
shared_view("m_class", """
SELECT o.*, c.class FROM m_availability o, (VALUES ('PURCHASE'), ('RENTAL'), ('LEASE'), ('RAAS'), ('ANY')) c(class)
WHERE o.is_current AND (c.class = 'ANY' OR c.class = o.transaction_type)""")
shared_view("m_offer_feature", """
SELECT product_id, class, bool_or(ok) AS open, bool_or(availability_status = 'AVAILABLE') AS plain, min(available_from) FILTER (WHERE ok) AS earliest,
  bool_or(ok AND region_id IS NULL) AS open_everywhere, bool_or(region_id IS NULL) AS offered_everywhere,
  coalesce(list_sort(list(DISTINCT region_id) FILTER (WHERE ok AND region_id IS NOT NULL)), []) AS open_regions,
  coalesce(list_sort(list(DISTINCT region_id) FILTER (WHERE region_id IS NOT NULL)), []) AS offered_regions
FROM (SELECT *, availability_status NOT IN ('NOT_AVAILABLE', 'DISCONTINUED') AS ok FROM m_class) c GROUP BY product_id, class""")
shared_view("m_country_set", """
SELECT region_id AS country_id, list(applicable_id) AS ids, any_value(code) AS country FROM m_applicable GROUP BY region_id""")
shared_view("m_priced", """
SELECT q.requirement_id, o.product_id, b.fit, b.n, o.transaction_type, o.price_type, o.billing_period, o.price, o.price_min, b.warnings
FROM (SELECT r.*, CASE preferred_transaction WHEN 'RENT' THEN 'RENTAL' WHEN 'BUY' THEN 'PURCHASE' WHEN 'LEASE' THEN 'LEASE'
        WHEN 'RAAS' THEN 'RAAS' ELSE 'ANY' END AS class, r.id AS requirement_id, s.ids FROM m_requirement r LEFT JOIN m_country_set s USING (country_id)
      WHERE budget_max IS NOT NULL) q
JOIN m_pricing o ON o.is_current AND upper(o.currency) = upper(q.budget_currency) AND (q.class = 'ANY' OR q.class = o.transaction_type)
  AND (q.country_id IS NULL OR o.region_id IS NULL OR list_contains(q.ids, o.region_id)),
LATERAL (SELECT CAST(o.price AS DOUBLE) AS p, CAST(o.price_min AS DOUBLE) AS lo, CAST(o.price_max AS DOUBLE) AS hi, q.budget_max AS m) v,
LATERAL (SELECT CASE WHEN v.p <= v.m THEN 1.0 WHEN v.p >= CAST(1.1 AS DOUBLE) * v.m THEN 0.0 ELSE (CAST(1.1 AS DOUBLE) * v.m - v.p) / (CAST(0.1 AS DOUBLE) * v.m) END::DOUBLE AS ramp_p,
  CASE WHEN v.lo <= v.m THEN 1.0 WHEN v.lo >= CAST(1.1 AS DOUBLE) * v.m THEN 0.0 ELSE (CAST(1.1 AS DOUBLE) * v.m - v.lo) / (CAST(0.1 AS DOUBLE) * v.m) END::DOUBLE AS ramp_lo) f,
LATERAL (SELECT
  CASE WHEN o.price_type = 'QUOTE_ONLY' OR o.billing_period <> 'ONE_TIME' THEN 0.5
    WHEN o.price_type = 'RANGE' THEN CASE WHEN v.hi <= v.m THEN 1.0 WHEN v.lo > v.m THEN f.ramp_lo ELSE 0.5 END
    WHEN o.price_type = 'FROM' THEN least(f.ramp_p, 0.75) ELSE f.ramp_p END::DOUBLE AS fit,
  CASE WHEN o.price_type = 'QUOTE_ONLY' THEN ['pricing is quote-only']
    WHEN o.billing_period <> 'ONE_TIME' THEN ['price is ' || lower(o.billing_period) || ' — not comparable to a one-off budget']
    WHEN o.price_type = 'RANGE' THEN CASE WHEN v.hi <= v.m THEN [] WHEN v.lo > v.m THEN ['price range starts above the stated budget'] ELSE ['price range crosses the budget ceiling'] END
    WHEN o.price_type = 'FROM' THEN CASE WHEN v.p > v.m THEN ['only a starting (''from'') price is published', 'price exceeds the stated budget'] ELSE ['only a starting (''from'') price is published'] END
    WHEN o.price_type = 'PUBLIC' THEN CASE WHEN v.p > v.m THEN ['price exceeds the stated budget'] ELSE [] END
    ELSE CASE WHEN v.p > v.m THEN ['price exceeds the stated budget', 'price is an estimate, not confirmed'] ELSE ['price is an estimate, not confirmed'] END END AS warnings,
  len(warnings) AS n) b""")
shared_view("m_best_price", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY requirement_id, product_id ORDER BY fit DESC, n, transaction_type, price_type, billing_period,
    coalesce(price, -1), coalesce(price_min, -1)) AS rn FROM m_priced) b WHERE rn = 1""")
_PARTS = """[CASE WHEN payload_min_kg IS NOT NULL THEN CASE WHEN payload_min_kg = 0 THEN 1.0 WHEN payload_kg IS NULL THEN 0.5
      ELSE greatest(0, least(1, payload_kg / (payload_min_kg * CAST(1.25 AS DOUBLE)))) END END::DOUBLE,
    CASE WHEN autonomy_required IS NOT NULL THEN CASE WHEN autonomy IS NULL THEN 0.5 ELSE 1.0 END END::DOUBLE,
    CASE WHEN manipulation_required THEN CASE WHEN has_manipulation IS NULL THEN 0.5 ELSE 1.0 END END::DOUBLE,
    CASE WHEN operating_hours_day IS NOT NULL THEN CASE WHEN runtime_minutes IS NULL THEN 0.5
      ELSE CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * greatest(0, least(1, CAST(runtime_minutes AS DOUBLE) / (operating_hours_day * 60))) END END::DOUBLE]"""
shared_view("m_sub", f"""
SELECT x.*, f.open, f.plain, f.earliest, s.country, b.warnings AS budget_warnings, coalesce(d.n, 0) AS deployments, v.freshest_verified_at,
  EXISTS (SELECT 1 FROM m_pricing z WHERE z.product_id = x.product_id AND z.is_current) AS has_price,
  b.requirement_id IS NOT NULL AS has_comparable,
  ft.fit_score,
  CASE WHEN x.use_case IS NOT NULL THEN coalesce(greatest(0, least(1, CAST(ft.fit_score AS DOUBLE))), 0.5) END::DOUBLE AS s_use,
  CASE WHEN f.open THEN CASE WHEN coalesce(f.earliest > x.required_by, false) THEN 0.5 ELSE 1.0 END WHEN f.product_id IS NOT NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS s_com,
  CASE WHEN len(list_filter({_PARTS}, lambda p: p IS NOT NULL)) > 0
    THEN list_sum(list_filter({_PARTS}, lambda p: p IS NOT NULL)) / len(list_filter({_PARTS}, lambda p: p IS NOT NULL)) END::DOUBLE AS s_tec,
  CASE WHEN x.country_id IS NOT NULL THEN CASE WHEN coalesce(f.open_everywhere, false) OR list_has_any(f.open_regions, s.ids) THEN 1.0
    WHEN coalesce(f.offered_everywhere, false) OR list_has_any(f.offered_regions, s.ids) THEN 0.0 ELSE 0.5 END END::DOUBLE AS s_geo,
  CASE WHEN x.budget_max IS NOT NULL THEN coalesce(b.fit, 0.5) WHEN x.budget_min IS NOT NULL THEN 0.5 END::DOUBLE AS s_bud,
  CAST(0.5 AS DOUBLE) * CASE x.commercial_status WHEN 'ANNOUNCED' THEN 0.0 WHEN 'DEVELOPMENT' THEN 0.15 WHEN 'PROTOTYPE' THEN 0.30 WHEN 'PILOT' THEN 0.50
    WHEN 'EARLY_ACCESS' THEN 0.65 WHEN 'LIMITED_COMMERCIAL' THEN 0.80 WHEN 'COMMERCIAL' THEN 1.0 WHEN 'RAAS_DEPLOYMENT' THEN 1.0 ELSE 0.0 END::DOUBLE
    + CAST(0.5 AS DOUBLE) * CASE WHEN coalesce(d.n, 0) >= 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS s_dep
FROM m_pair x
LEFT JOIN m_offer_feature f ON f.product_id = x.product_id AND f.class = x.class
LEFT JOIN m_country_set s ON s.country_id = x.country_id
LEFT JOIN m_fit ft ON ft.product_id = x.product_id AND ft.use_case = x.use_case
LEFT JOIN (SELECT product_id, count(*) AS n FROM m_deployment GROUP BY product_id) d ON d.product_id = x.product_id
LEFT JOIN m_fresh v ON v.product_id = x.product_id
LEFT JOIN m_best_price b ON b.requirement_id = x.requirement_id AND b.product_id = x.product_id
WHERE NOT (x_payload OR x_manipulation OR x_autonomy OR x_discontinued)""")


def _points(sub: str, weight: int) -> str:
    n = f"(CAST(floor({sub} * CAST(1e9 AS DOUBLE) + 0.5) AS BIGINT) * {weight * 10000})"
    d = "(active * 1000000000)"
    return f"coalesce({n} // {d} + CASE WHEN ({n} % {d}) * 2 > {d} OR (({n} % {d}) * 2 = {d} AND ({n} // {d}) % 2 = 1) THEN 1 ELSE 0 END, 0)"


shared_view("m_points", f"""
SELECT *, {_points('s_use', 25)} AS p_use, {_points('s_com', 20)} AS p_com, {_points('s_tec', 20)} AS p_tec, {_points('s_geo', 15)} AS p_geo,
  {_points('s_bud', 10)} AS p_bud, {_points('s_dep', 10)} AS p_dep
FROM (SELECT *, CAST(20 + 10 + CASE WHEN s_use IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN s_tec IS NOT NULL THEN 20 ELSE 0 END
  + CASE WHEN s_geo IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN s_bud IS NOT NULL THEN 10 ELSE 0 END AS BIGINT) AS active FROM m_sub) s""")
_T = "(p_use + p_com + p_tec + p_geo + p_bud + p_dep)"
shared_view("m_match", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY score DESC, s_com DESC, deployments DESC,
    freshest_verified_at DESC NULLS LAST, slug) AS rank
  FROM (SELECT *, {_T} // 100 + CASE WHEN {_T} % 100 > 50 OR ({_T} % 100 = 50 AND ({_T} // 100) % 2 = 1) THEN 1 ELSE 0 END AS score FROM m_points) s) r
WHERE rank <= 4""")


@query("match_candidates", """
SELECT requirement_id, count(*) AS candidates, count(*) FILTER (WHERE NOT (x_payload OR x_manipulation OR x_autonomy OR x_discontinued)) AS survivors
FROM m_pair GROUP BY requirement_id""")
def _(c):
    return mt.match_candidates(c.requirement, c.product)


@query("match_exclusions", """
SELECT requirement_id, reason, n FROM (
  SELECT requirement_id, 'payload' AS reason, count(*) FILTER (WHERE x_payload) AS n FROM m_pair GROUP BY 1
  UNION ALL SELECT requirement_id, 'manipulation', count(*) FILTER (WHERE x_manipulation) FROM m_pair GROUP BY 1
  UNION ALL SELECT requirement_id, 'autonomy', count(*) FILTER (WHERE x_autonomy) FROM m_pair GROUP BY 1
  UNION ALL SELECT requirement_id, 'discontinued', count(*) FILTER (WHERE x_discontinued) FROM m_pair GROUP BY 1) x WHERE n > 0""")
def _(c):
    return mt.exclusions_by_reason(c.requirement, c.product)


@query("match_offer_features", """
SELECT product_id, class, open, plain, earliest, open_everywhere, offered_everywhere,
  array_to_string(open_regions, '|') AS open_regions, array_to_string(offered_regions, '|') AS offered_regions FROM m_offer_feature""")
def _(c):
    joined = lambda name: F.array_join(F.col(name).cast("array<string>"), "|").alias(name)
    return mt.offer_features(c.availability).select(
        "product_id", "class", "open", "plain", "earliest", "open_everywhere", "offered_everywhere", joined("open_regions"), joined("offered_regions")
    )


def ranked(c: Catalog):
    return mt.rank_matches(match_model(c))


_AS = "requirement_id, slug"


def _sub(c: Catalog, name: str):
    return ranked(c).select("requirement_id", "slug", F.col(mt.SUBS[name]).cast("decimal(12,9)").alias("sub"))


@query("score_use_case", f"SELECT {_AS}, CAST(s_use AS DECIMAL(12,9)) AS sub FROM m_match")
def _(c):
    return _sub(c, "use_case_fit")


@query("score_commercial", f"SELECT {_AS}, CAST(s_com AS DECIMAL(12,9)) AS sub FROM m_match")
def _(c):
    return _sub(c, "commercial_availability")


@query("score_technical", f"SELECT {_AS}, CAST(s_tec AS DECIMAL(12,9)) AS sub FROM m_match")
def _(c):
    return _sub(c, "technical_fit")


@query("score_geography", f"SELECT {_AS}, CAST(s_geo AS DECIMAL(12,9)) AS sub FROM m_match")
def _(c):
    return _sub(c, "geographic_fit")


@query("score_budget", f"SELECT {_AS}, CAST(s_bud AS DECIMAL(12,9)) AS sub FROM m_match")
def _(c):
    return _sub(c, "budget_fit")


@query("score_deployment", f"SELECT {_AS}, CAST(s_dep AS DECIMAL(12,9)) AS sub FROM m_match")
def _(c):
    return _sub(c, "deployment_readiness")


@query("match_breakdown", f"""
SELECT {_AS}, score, p_use AS use_case_fit, p_com AS commercial_availability, p_tec AS technical_fit, p_geo AS geographic_fit,
  p_bud AS budget_fit, p_dep AS deployment_readiness FROM m_match""")
def _(c):
    return ranked(c).select("requirement_id", "slug", "score", *[F.col(col).alias(name) for name, col in mt.PARTS.items()])


def _g(expr: str) -> str:
    return f"regexp_replace(regexp_replace(CAST(CAST({expr} AS DECIMAL(20,6)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


_REASONS = f"""[
  {{'o': -p_use, 't': CASE WHEN fit_score IS NOT NULL AND s_use >= 0.6 THEN 'use-case fit ' || printf('%.2f', s_use) || ' for ' || use_case END}},
  {{'o': -p_com, 't': CASE WHEN open THEN 'commercially accessible for the requested transaction' WHEN NOT open THEN 'no accessible commercial offer for the requested transaction'
      ELSE 'commercial availability unconfirmed; neutral score applied' END}},
  {{'o': -p_tec, 't': CASE WHEN payload_min_kg <> 0 AND payload_kg / (payload_min_kg * CAST(1.25 AS DOUBLE)) >= 0.8
      THEN 'payload ' || {_g('payload_kg')} || ' kg meets the ' || {_g('payload_min_kg')} || ' kg requirement' END}},
  {{'o': -p_tec, 't': CASE WHEN autonomy_required IS NOT NULL AND autonomy IS NOT NULL THEN 'autonomy ' || autonomy || ' meets ' || autonomy_required END}},
  {{'o': -p_tec, 't': CASE WHEN manipulation_required AND has_manipulation IS NOT NULL THEN 'supports required manipulation' END}},
  {{'o': -p_tec, 't': CASE WHEN runtime_minutes >= operating_hours_day * 60 THEN 'runtime covers the requested ' || operating_hours_day || ' h/day duty cycle' END}},
  {{'o': -p_geo, 't': CASE WHEN s_geo = 1 THEN 'available in ' || country END}},
  {{'o': -p_bud, 't': CASE WHEN budget_max IS NOT NULL AND s_bud >= 0.99 THEN 'within the stated budget' END}},
  {{'o': -p_dep, 't': 'commercial maturity: ' || commercial_status}},
  {{'o': -p_dep, 't': CASE WHEN deployments >= 1 THEN deployments || ' confirmed deployment(s)' END}}]"""
_WARNINGS = """list_concat([
  CASE WHEN use_case IS NOT NULL AND fit_score IS NULL THEN 'use-case fit for ' || use_case || ' is unverified' END,
  CASE WHEN open AND NOT plain THEN 'commercial availability is constrained (waitlist/preorder/on-request)' END,
  CASE WHEN open AND s_com = 0.5 THEN 'earliest known availability is after the required-by date' END,
  CASE WHEN NOT open THEN 'no accessible commercial offer for the requested transaction' END,
  CASE WHEN open IS NULL THEN 'no confirmed commercial availability' END,
  CASE WHEN payload_min_kg <> 0 AND payload_kg IS NULL THEN 'payload unverified' END,
  CASE WHEN autonomy_required IS NOT NULL AND autonomy IS NULL THEN 'autonomy level unverified' END,
  CASE WHEN manipulation_required AND has_manipulation IS NULL THEN 'manipulation capability unverified' END,
  CASE WHEN operating_hours_day IS NOT NULL AND runtime_minutes IS NULL THEN 'runtime unverified' END,
  CASE WHEN runtime_minutes < operating_hours_day * 60 THEN 'runtime may require a charging strategy' END,
  CASE WHEN s_geo = 0 THEN 'offers for ' || country || ' are not accessible' END,
  CASE WHEN s_geo = 0.5 THEN 'no regional availability evidence for ' || country END],
  coalesce(budget_warnings, []),
  [CASE WHEN budget_max IS NOT NULL AND NOT has_comparable THEN CASE WHEN has_price THEN 'no price in the requested currency/terms' ELSE 'no confirmed pricing' END END])"""


@query("match_reasons", f"""
SELECT {_AS}, (SELECT string_agg(t, ' / ' ORDER BY o, t) FROM (SELECT o, t FROM (SELECT unnest({_REASONS}, recursive := true)) u WHERE t IS NOT NULL ORDER BY o, t LIMIT 4) l) AS reasons,
  array_to_string(list_filter({_WARNINGS}, lambda w: w IS NOT NULL), ' / ') AS warnings FROM m_match""")
def _(c):
    run = mt.prepare(match_model(c))
    texts = mt.explain(mt.matched_facts(run, mt.rank_prepared(run)))
    joined = lambda name: F.array_join(name, " / ").alias(name)
    return texts.select("requirement_id", "slug", joined("reasons"), joined("warnings"))


@query("match_top4", f"SELECT {_AS}, rank, score FROM m_match")
def _(c):
    return ranked(c).select("requirement_id", "slug", "rank", "score")


@query("match_categories", """
WITH refs AS (
  SELECT x.requirement_id, x.product_id, min(CAST(o.price AS DOUBLE)) AS low, list(DISTINCT upper(o.currency)) AS curs
  FROM m_match x LEFT JOIN m_country_set s ON s.country_id = x.country_id
  JOIN m_pricing o ON o.product_id = x.product_id AND o.is_current AND o.price IS NOT NULL AND o.billing_period = 'ONE_TIME' AND o.price_type IN ('PUBLIC', 'ESTIMATED')
    AND (x.class = 'ANY' OR x.class = o.transaction_type) AND (x.country_id IS NULL OR o.region_id IS NULL OR list_contains(s.ids, o.region_id))
    AND (x.budget_currency IS NULL OR upper(o.currency) = upper(x.budget_currency)) GROUP BY 1, 2),
a AS (SELECT x.requirement_id, x.slug, x.rank, x.s_com, x.open, x.budget_currency, r.low, r.curs,
    coalesce(x.has_sdk, false) OR coalesce(x.ros_support, false) OR coalesce(x.developer_edition, false) AS dev
  FROM m_match x LEFT JOIN refs r USING (requirement_id, product_id)),
b AS (SELECT *, rank > 1 AND coalesce(open, false) AND row_number() OVER (PARTITION BY requirement_id, rank > 1 AND coalesce(open, false) ORDER BY s_com DESC, slug) = 1 AS com,
    (SELECT count(DISTINCT u.c) FROM (SELECT unnest(z.curs) AS c FROM a z WHERE z.requirement_id = a.requirement_id AND z.rank > 1) u) AS ncur FROM a),
d AS (SELECT *, rank > 1 AND low IS NOT NULL AND NOT com AND (budget_currency IS NOT NULL OR ncur <= 1) AS can_cheap FROM b),
e AS (SELECT *, can_cheap AND row_number() OVER (PARTITION BY requirement_id, can_cheap ORDER BY low, slug) = 1 AS cheap FROM d),
f AS (SELECT *, rank > 1 AND dev AND NOT com AND NOT cheap AS can_dev FROM e),
g AS (SELECT *, can_dev AND row_number() OVER (PARTITION BY requirement_id, can_dev ORDER BY rank) = 1 AS is_dev FROM f)
SELECT requirement_id, slug, rank, CASE WHEN rank = 1 THEN 'BEST_OVERALL' WHEN com THEN 'BEST_COMMERCIAL' WHEN cheap THEN 'BEST_LOWER_COST'
  WHEN is_dev THEN 'BEST_DEVELOPER' ELSE 'ALTERNATIVE' END AS category FROM g""")
def _(c):
    run = mt.prepare(match_model(c))
    labelled = mt.label_matches(mt.matched_facts(run, mt.rank_prepared(run)))
    return labelled.select("requirement_id", "slug", "rank", "category")


@query("no_match_explanation", """
SELECT r.id AS requirement_id, coalesce(n, 0) AS matches, (SELECT count(*) FROM m_product WHERE is_published) - coalesce(n, 0) AS excluded_count,
  CAST(NULL AS VARCHAR) AS explanation
FROM m_requirement r LEFT JOIN (SELECT requirement_id, count(*) AS n FROM m_match GROUP BY 1) x ON x.requirement_id = r.id""")
def _(c):
    return mt.no_match(c.requirement, c.product, ranked(c))


@query("match_incremental", """
SELECT requirement_id, 'stored-' || requirement_id AS slug, CAST(1 AS INTEGER) AS rank, 77 AS score, true AS stored
FROM (SELECT DISTINCT id AS requirement_id FROM m_requirement WHERE id % 2 = 0) s
UNION ALL SELECT requirement_id, slug, rank, score, false FROM m_match WHERE requirement_id % 2 <> 0""")
def _(c):
    m = match_model(c)
    stored = c.requirement.filter(F.col("id") % 2 == 0).select(
        F.col("id").alias("requirement_id"), F.concat(F.lit("stored-"), F.col("id").cast("string")).alias("slug"),
        F.lit(1).alias("rank"), F.lit(77).cast("long").alias("score"),
    )
    return mt.match_incremental(stored, m)
