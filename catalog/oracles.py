"""SQL counterparts of the registered queries, built from shared fragments.

They compute the same things another way where that is possible: ranks by window
functions over raw rows instead of bucketed counts, quantiles by the built-in,
p-values by numerical integration instead of continued fractions.
"""

from __future__ import annotations

import re

from catalog import facts
from shiftlens.operators import isolation
from shiftlens.operators import report

STEPS = 2000
ORACLES: dict[str, str] = {}


def r(expression: str, digits: int = 4) -> str:
    return f"round({expression}, {digits}) + 0.0"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


def simpson(integrand: str, upper: str) -> str:
    """Integral of ``integrand`` (in terms of u) from 0 to ``upper``."""
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)::DOUBLE"
    body = integrand.replace("{u}", f"((i * ({upper})) / {STEPS}.0::DOUBLE)")
    total = f"list_sum(list_transform(range(0, {STEPS + 1}), lambda i: {weight} * ({body})))"
    return f"({total} * ({upper}) / {3 * STEPS}.0::DOUBLE)"


def p_t(t: str, df: str) -> str:
    top = f"atan(abs({t}) / sqrt({df}))"
    inside = simpson(f"pow(cos({{u}}), {df} - 1.0)", top)
    scale = f"exp(lgamma(({df} + 1.0) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())"
    return f"greatest(0.0::DOUBLE, 1.0 - 2.0 * {scale} * {inside})"


def p_normal(z: str) -> str:
    inside = simpson("exp(-0.5 * {u} * {u})", f"least(abs({z}), 40.0::DOUBLE)")
    return f"greatest(0.0::DOUBLE, 1.0 - sqrt(2.0 / pi()) * {inside})"


def p_chi(x: str, k: str) -> str:
    inside = simpson(f"pow({{u}}, {k} - 1.0) * exp(-0.5 * {{u}} * {{u}})", f"sqrt({x})")
    return f"greatest(0.0::DOUBLE, 1.0 - pow(2.0::DOUBLE, 1.0 - {k} / 2.0) / gamma({k} / 2.0::DOUBLE) * {inside})"


B, A = "(WHERE period = 'baseline')", "(WHERE period = 'anomaly')"


def long_cte(metric: str, dims: list[str], joint: bool = False) -> str:
    parts = [
        f"SELECT '{d}' AS dimension, {d}::VARCHAR AS segment_value, period, {metric}::DOUBLE AS x FROM fact WHERE period IS NOT NULL"
        for d in dims
    ]
    if joint:
        a, b = dims[:2]
        crossed = f"coalesce({a}::VARCHAR, 'nan') || ' × ' || coalesce({b}::VARCHAR, 'nan')"
        parts.append(
            f"SELECT '{a} × {b}' AS dimension, {crossed} AS segment_value, period, {metric}::DOUBLE AS x FROM fact WHERE period IS NOT NULL"
        )
    return "long AS (" + " UNION ALL ".join(parts) + ")"


def moments_cte(by: str = "dimension, segment_value", known: str = "segment_value IS NOT NULL") -> str:
    using = by
    centred = ", ".join(
        f"avg(pow(x - mean_{s}, 3)) FILTER {f} / nullif(pow(avg(pow(x - mean_{s}, 2)) FILTER {f}, 1.5), 0) AS skew_{s}"
        for s, f in (("base", B), ("anom", A))
    )
    return f"""
means AS (
  SELECT {by}, count(*) FILTER {B} AS volume_base, count(*) FILTER {A} AS volume_anom,
    count(x) FILTER {B} AS n_base, count(x) FILTER {A} AS n_anom,
    avg(x) FILTER {B} AS mean_base, avg(x) FILTER {A} AS mean_anom,
    var_samp(x) FILTER {B} AS var_base, var_samp(x) FILTER {A} AS var_anom
  FROM long WHERE {known} GROUP BY {by}),
skews AS (
  SELECT {by}, {centred} FROM long JOIN means USING ({using}) WHERE {known} GROUP BY {by}),
mom AS (SELECT * FROM means JOIN skews USING ({using}))"""


def welch_cte(by: str = "dimension, segment_value") -> str:
    pooled = "((n_base - 1) * var_base + (n_anom - 1) * var_anom) / nullif(n_base + n_anom - 2, 0)"
    return f"""
w0 AS (
  SELECT *, var_base / nullif(n_base, 0) AS a, var_anom / nullif(n_anom, 0) AS b, mean_anom - mean_base AS mean_diff,
    CASE WHEN n_base >= 2 AND n_anom >= 2 AND {pooled} > 0
      THEN (mean_anom - mean_base) / sqrt({pooled}) ELSE 0.0 END AS cohens_d
  FROM mom),
w1 AS (
  SELECT *, CASE WHEN a + b > 0 THEN mean_diff / sqrt(a + b) ELSE 0.0 END AS welch_t,
    CASE WHEN a + b > 0 THEN (a + b) * (a + b) / nullif(a * a / nullif(n_base - 1, 0) + b * b / nullif(n_anom - 1, 0), 0) END AS welch_df,
    1.96::DOUBLE * sqrt(coalesce(a + b, 0)) AS margin
  FROM w0),
welch AS (
  SELECT *, CASE WHEN a + b > 0 THEN {p_t('welch_t', 'welch_df')} ELSE 1.0 END AS welch_p,
    mean_diff - margin AS ci_low, mean_diff + margin AS ci_high
  FROM w1)"""


def ranks_cte(by: str = "dimension, segment_value", known: str = "segment_value IS NOT NULL") -> str:
    pairs = "na * nb"
    sigma = f"sqrt({pairs} / 12.0::DOUBLE * (na + nb + 1 - coalesce(tie / nullif((na + nb) * (na + nb - 1), 0), 0)))"
    return f"""
rk AS (
  SELECT {by}, period, x,
    rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0::DOUBLE AS rnk,
    (count(*) OVER (PARTITION BY {by}, x))::DOUBLE AS t
  FROM long WHERE x IS NOT NULL AND period IS NOT NULL AND {known}),
u0 AS (
  SELECT {by}, (count(*) FILTER {B})::DOUBLE AS nb, (count(*) FILTER {A})::DOUBLE AS na,
    sum(rnk) FILTER {A} AS ranksum, sum(t * t - 1.0) AS tie, count(DISTINCT x) AS distinct_values
  FROM rk GROUP BY {by}),
u1 AS (SELECT *, ranksum - na * (na + 1) / 2.0::DOUBLE AS u_stat, {sigma} AS sigma FROM u0),
u2 AS (SELECT *, (greatest(u_stat, {pairs} - u_stat) - {pairs} / 2.0::DOUBLE - 0.5) / nullif(sigma, 0) AS u_z FROM u1),
ranks AS (SELECT {by}, u_stat, u_z, CASE WHEN u_z > 0 THEN {p_normal('u_z')} ELSE 1.0 END AS u_p, distinct_values FROM u2)"""


def tests_cte(by: str = "dimension, segment_value") -> str:
    small = "(n_base < 5 OR n_anom < 5)"
    ranked = (
        "coalesce(n_base > 30 AND n_anom > 30 AND greatest(abs(skew_base), abs(skew_anom)) > 1.5"
        " AND distinct_values > 2, false)"
    )

    def pick(a: str, b: str, c: str) -> str:
        return f"CASE WHEN {small} THEN {a} WHEN {ranked} THEN {b} ELSE {c} END"

    return f"""
tests AS (
  SELECT welch.*, ranks.* EXCLUDE ({by}),
    {pick("'Insufficient Sample Size'", "'Mann-Whitney U Rank-Sum Test'", "'Welch''s Two-Sample t-test'")} AS test_name,
    {pick('0.0', 'u_stat', 'welch_t')} AS statistic,
    {pick('1.0', 'u_p', 'welch_p')} AS p_value,
    CASE WHEN {small} THEN 0.0 ELSE cohens_d END AS effect,
    CASE WHEN NOT {small} THEN n_base + n_anom - 2 END AS df,
    'Cohen''s d' AS effect_name
  FROM welch LEFT JOIN ranks USING ({by}))"""


def full_tests(by: str = "dimension, segment_value", known: str = "segment_value IS NOT NULL") -> list[str]:
    return [moments_cte(by, known), welch_cte(by), ranks_cte(by, known), tests_cte(by)]


def verdict_cte(source: str, name: str, sign: str = "NULL::DOUBLE") -> str:
    e = "abs(coalesce(effect, 0))"
    few = "(n_base < 10 OR (n_anom > 0 AND n_anom < 10))"
    contrary = f"coalesce(effect * ({sign}) < 0, false)"
    good = f"{e} >= (CASE WHEN effect_name = 'Cramer''s V' THEN 0.1 ELSE 0.2 END)"
    return f"""
{name} AS (
  SELECT *, CASE WHEN {few} THEN 'inconclusive' WHEN {contrary} THEN 'rejected'
      WHEN p_value < 0.05 AND {good} THEN 'supported' WHEN p_value < 0.10 THEN 'weak' ELSE 'rejected' END AS status,
    (CASE WHEN {few} THEN 15.0 WHEN {contrary} THEN 5.0
      WHEN p_value < 0.01 AND {good} THEN least(95.0, 70.0 + least({e}, 2.0) * 12.5)
      WHEN p_value < 0.05 AND {good} THEN least(85.0, 60.0 + least({e}, 2.0) * 10.0)
      WHEN p_value < 0.05 THEN 45.0 + {e} * 10.0
      WHEN p_value < 0.10 THEN 35.0
      ELSE greatest(5.0, 20.0 - (p_value - 0.10) * 20.0) END)::DOUBLE AS score
  FROM {source})"""


def contribs_cte(metric: str) -> str:
    """Needs fact and mom."""
    return f"""
tot AS (
  SELECT count(*) FILTER {B} AS total_base, count(*) FILTER {A} AS total_anom,
    avg({metric}) FILTER {B} AS overall_base, avg({metric}) FILTER {A} AS overall_anom FROM fact),
c0 AS (
  SELECT mom.*, tot.*, volume_base::DOUBLE / total_base AS share_base, volume_anom::DOUBLE / total_anom AS share_anom,
    CASE WHEN volume_base > 0 THEN mean_base ELSE overall_base END AS rate_base,
    CASE WHEN volume_anom > 0 THEN mean_anom ELSE overall_anom END AS rate_anom,
    overall_anom - overall_base AS total_delta
  FROM mom CROSS JOIN tot),
c1 AS (
  SELECT *, rate_anom - rate_base AS rate_change,
    (share_base + share_anom) / 2 * (rate_anom - rate_base) AS rate_effect,
    (rate_base + rate_anom) / 2 * (share_anom - share_base) AS mix_effect,
    share_anom * rate_anom - share_base * rate_base AS contribution
  FROM c0),
con AS (
  SELECT *, CASE WHEN abs(total_delta) > 1e-9 THEN contribution / total_delta * 100.0 ELSE 0.0 END AS pct_of_total,
    (abs(contribution / total_delta * 100.0) >= 25 AND contribution * total_delta > 0) AS is_primary,
    row_number() OVER (ORDER BY abs(contribution) DESC, dimension, segment_value) AS overall_rank,
    row_number() OVER (PARTITION BY dimension ORDER BY abs(contribution) DESC, segment_value) AS impact_rank
  FROM c1)"""


def scenarios_cte() -> str:
    base = "CASE WHEN n_base > 0 THEN mean_base ELSE rate_base END"
    anom = "CASE WHEN n_anom > 0 THEN mean_anom ELSE rate_anom END"
    gap = "(overall_base - overall_anom)"
    return f"""
s0 AS (
  SELECT *, share_anom * (({base}) - ({anom})) AS restoration_delta,
    1.96::DOUBLE * share_anom * sqrt(coalesce(var_base, 0.01) / greatest(n_base, 2) + coalesce(var_anom, 0.01) / greatest(n_anom, 2)) AS margin,
    (is_primary OR (total_delta < 0 AND rate_change < 0) OR (total_delta >= 0 AND rate_change > 0)) AS candidate
  FROM con),
scen AS (
  SELECT *, overall_anom AS observed_metric, overall_anom + restoration_delta AS projected_metric,
    CASE WHEN abs{gap} > 1e-9 THEN abs(restoration_delta) / abs{gap} * 100.0 ELSE 0.0 END AS recovery_pct,
    CASE WHEN abs{gap} > 1e-9 THEN restoration_delta / {gap} * 100.0 ELSE 0.0 END AS signed_recovery_pct,
    overall_anom + restoration_delta - margin AS ci_lower, overall_anom + restoration_delta + margin AS ci_upper,
    'Restore ' || dimension || '=' || segment_value AS scenario
  FROM s0),
cand AS (SELECT * FROM scen WHERE candidate OR NOT (SELECT bool_or(candidate) FROM scen)),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY overall_rank) AS scenario_rank FROM cand) WHERE scenario_rank <= 4)"""


def chi_cte() -> str:
    """Needs mom."""
    parts = []
    for side in ("base", "anom"):
        e = f"((volume_base + volume_anom) * total_{side}::DOUBLE / (total_base + total_anom))"
        o = f"volume_{side}"
        shrunk = f"greatest(abs({o} - {e}) - (CASE WHEN categories = 2 THEN 0.5 ELSE 0.0 END), 0.0)"
        parts.append(f"pow({shrunk}, 2) / {e}")
    return f"""
ct AS (
  SELECT dimension, sum(volume_base)::BIGINT AS total_base, sum(volume_anom)::BIGINT AS total_anom, count(*) AS categories,
    count(*) FILTER (WHERE volume_base > 0) AS categories_base
  FROM mom WHERE volume_base + volume_anom > 0 GROUP BY dimension),
cx AS (
  SELECT dimension, total_base, total_anom, categories, categories_base, sum({parts[0]} + {parts[1]}) AS chi2
  FROM mom JOIN ct USING (dimension) WHERE volume_base + volume_anom > 0 GROUP BY ALL),
chi AS (
  SELECT *, (categories - 1)::BIGINT AS df, sqrt(chi2 / (total_base + total_anom)) AS cramers_v,
    {p_chi('chi2', '(categories - 1)')} AS p_value
  FROM cx)"""


# --- sources and history ---------------------------------------------------------

ORDER_COLUMNS = (
    "o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) + 0.0 AS o_totalprice,"
    " strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority"
)
ORACLES["scan_csv"] = f"SELECT {ORDER_COLUMNS} FROM orders"
ORACLES["preview_rows"] = f"SELECT {ORDER_COLUMNS} FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 15)"

RUNS = """
b AS (
  SELECT p_brand, count(*) AS row_count,
    avg(p_retailprice) FILTER (WHERE p_size <= 25) AS small, avg(p_retailprice) FILTER (WHERE p_size > 25) AS large
  FROM part GROUP BY p_brand),
runs AS (
  SELECT p_brand AS id, 'Investigation of ' || p_brand AS title,
    '2024-01-' || lpad(regexp_extract(p_brand, '(\\d+)', 1), 2, '0') AS created_at, 'part' AS dataset_name, row_count,
    'p_retailprice' AS metric_col, (large - small) / (abs(small) + 1e-9) * 100.0 AS pct,
    regexp_extract(p_brand, '(\\d+)', 1)::INT AS day
  FROM b),
current AS (
  SELECT id, CASE WHEN day % 2 = 0 THEN title || ' (revised)' ELSE title END AS title, created_at, dataset_name, row_count,
    metric_col, round(pct, 4) + 0.0 AS pct_change, CASE WHEN pct < 0 THEN 'drop' ELSE 'spike' END AS direction,
    'user_specified' AS detection_method, day
  FROM runs)"""
ORACLES["history_upsert"] = f"{with_(RUNS)} SELECT * EXCLUDE (day) FROM current"
ORACLES["history_list"] = f"{with_(RUNS)} SELECT * EXCLUDE (day) FROM current ORDER BY created_at DESC, id"
ORACLES["history_load"] = f"{with_(RUNS)} SELECT * EXCLUDE (day) FROM current WHERE id = 'Brand#4'"
ORACLES["history_delete"] = f"""{with_(RUNS)}
SELECT id, title, (SELECT count(*) FROM current WHERE day % 5 = 0) AS n_deleted FROM current WHERE day % 5 <> 0"""

# --- cleaning -----------------------------------------------------------------------

ORACLES["clean_trim"] = r"""
SELECT conv_id, turn, regexp_replace(role, '^\s+|\s+$', '', 'g') AS role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text
FROM conversations"""
ORACLES["clean_dates"] = """
SELECT o_orderkey, strftime(try_cast(CASE WHEN o_orderkey % 13 = 0 THEN 'not a date' WHEN o_orderkey % 29 <> 0
  THEN strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP), '%Y-%m-%d') AS order_day FROM orders"""
_WRITTEN = """
w AS (
  SELECT o_orderkey, o_orderkey % 100 = 7 AS bad, o_orderdate AS d, strftime(o_orderdate, '%m/%d/%Y') AS us,
    strftime(o_orderdate, '%d.%m.%Y %H:%M') AS eu, strftime(o_orderdate, '%B %-d, %Y') AS long,
    CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%-d %b %Y')
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mixed
  FROM orders),
t AS (
  SELECT o_orderkey, CASE WHEN bad THEN 'unknown' ELSE us END AS us_date, CASE WHEN bad THEN 'unknown' ELSE eu END AS eu_date,
    CASE WHEN bad THEN 'unknown' ELSE long END AS long_date, CASE WHEN bad THEN 'unknown' ELSE mixed END AS mixed_date FROM w)"""
ORACLES["clean_date_formats"] = f"""WITH {_WRITTEN}
SELECT o_orderkey, strftime(try_strptime(us_date, '%m/%d/%Y'), '%Y-%m-%d %H:%M') AS us_date,
  strftime(try_strptime(eu_date, '%d.%m.%Y %H:%M'), '%Y-%m-%d %H:%M') AS eu_date,
  strftime(try_strptime(long_date, '%B %d, %Y'), '%Y-%m-%d %H:%M') AS long_date,
  strftime(try_strptime(mixed_date, ['%m/%d/%Y', '%d %b %Y', '%Y-%m-%d']), '%Y-%m-%d %H:%M') AS mixed_date FROM t"""
ORACLES["date_election"] = f"""WITH {_WRITTEN},
v AS (
  SELECT 'us_date' AS "column", us_date AS value FROM t UNION ALL SELECT 'eu_date', eu_date FROM t
  UNION ALL SELECT 'long_date', long_date FROM t UNION ALL SELECT 'mixed_date', mixed_date FROM t),
c AS (
  SELECT "column", count(value) AS filled, count(try_strptime(value, ['%B %d, %Y', '%d %b %Y', '%Y-%m-%d'])) AS plain,
    count(try_strptime(value, ['%m/%d/%Y', '%m.%d.%Y %H:%M'])) AS month_first,
    count(try_strptime(value, ['%d/%m/%Y', '%d.%m.%Y %H:%M'])) AS day_first FROM v GROUP BY 1)
SELECT "column", 'datetime' AS inferred_type, plain, month_first, day_first, day_first > month_first AS is_day_first,
  plain + greatest(month_first, day_first) AS parsed_count,
  round((plain + greatest(month_first, day_first)) / filled::DOUBLE, 4) + 0.0 AS parsed_share FROM c"""
ORACLES["coerce_numeric"] = """
SELECT event_id, try_cast(CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k
FROM events"""
ORACLES["metric_backfill"] = """
WITH f AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 17 > 2 THEN o_totalprice END AS amount FROM orders)
SELECT o_orderkey, round(coalesce(first_value(amount IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0), 2) + 0.0 AS amount FROM f"""

# --- profiling -------------------------------------------------------------------------

MIXED = facts.MIXED_SQL
_TEXT = {"o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"}
CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, {_TEXT.get(c, c + '::VARCHAR')} AS value FROM fact"
    for i, c in enumerate(facts.MIXED_COLUMNS)
) + ")"
COUNTS = """
counts AS (
  SELECT "column", ordinal, count(*) AS total_count, count(*) - count(value) AS missing_count,
    count(DISTINCT value) AS unique_count FROM cells GROUP BY ALL)"""
_ANY_ID = "(" + " OR ".join(f"contains(\"column\", '{w}')" for w in ("id", "uuid", "guid", "key", "token", "hash")) + ")"
TYPES = f"""
sample AS (SELECT bool_and(try_cast(created_text AS TIMESTAMP) IS NOT NULL) AS text_ok FROM (SELECT * FROM fact ORDER BY o_orderkey LIMIT 30)),
labels_ok AS (SELECT bool_and(try_cast(day_label AS TIMESTAMP) IS NOT NULL) AS label_ok FROM (SELECT * FROM fact ORDER BY o_orderkey LIMIT 30)),
boolean_like AS (
  SELECT "column", bool_and(value IN ('0', '1', 'true', 'false', 'True', 'False')) AS is_bool FROM cells WHERE value IS NOT NULL GROUP BY 1),
t0 AS (
  SELECT counts.*, total_count - missing_count AS filled,
    CASE WHEN total_count = missing_count THEN 0.0 ELSE unique_count::DOUBLE / (total_count - missing_count) END AS share,
    coalesce(is_bool, false) AS is_bool, {_ANY_ID} AS id_named,
    "column" IN ('o_orderkey', 'o_custkey', 'o_totalprice', 'urgent') AS numeric_type
  FROM counts LEFT JOIN boolean_like USING ("column")),
types AS (
  SELECT *, CASE WHEN filled = 0 THEN 'categorical'
      WHEN is_bool AND filled > 10 AND unique_count <= 2 THEN 'boolean'
      WHEN "column" = 'o_orderdate' OR ("column" = 'created_text' AND (SELECT text_ok FROM sample))
        OR ("column" = 'day_label' AND (SELECT label_ok FROM labels_ok)) THEN 'datetime'
      WHEN numeric_type AND id_named AND share > 0.9 THEN 'text_id'
      WHEN numeric_type THEN 'numerical'
      WHEN id_named OR (share > 0.85 AND filled > 50) THEN 'text_id'
      WHEN unique_count <= 100 OR share < 0.3 THEN 'categorical' ELSE 'text_id' END AS inferred_type
  FROM t0)"""
_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice", "urgent", "won"]
NUMBERS = "numbers AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS v FROM fact" for c in _NUMERIC
) + ")"
STATS = """
stats AS (
  SELECT "column", count(v) AS n, min(v) AS mn, max(v) AS mx, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std,
    quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM numbers GROUP BY 1)"""
OUTLIERS = """
outl AS (
  SELECT s."column", any_value(q1 - 1.5 * (q3 - q1)) AS lower, any_value(q3 + 1.5 * (q3 - q1)) AS upper, any_value(n) AS n_values,
    count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count
  FROM stats s JOIN numbers nn ON s."column" = nn."column" WHERE v IS NOT NULL GROUP BY 1)"""
TOP = """
top AS (
  SELECT * FROM (SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS rank
    FROM cells WHERE value IS NOT NULL GROUP BY 1, 2) WHERE rank <= 5)"""
ORACLES["dataset_shape"] = f"""{with_(MIXED, CELLS)}
SELECT (SELECT count(*) FROM fact) AS n_rows, {len(facts.MIXED_COLUMNS)}::BIGINT AS n_cols, count(*) - count(value) AS total_missing FROM cells"""
ORACLES["duplicate_rows"] = """
WITH f AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber <= 2),
t AS (SELECT (SELECT count(*) FROM f) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS kept)
SELECT n_rows, n_rows - kept AS duplicate_rows, round((n_rows - kept) * 100.0::DOUBLE / n_rows, 4) + 0.0 AS duplicate_pct FROM t"""
ORACLES["column_profile"] = f"""{with_(MIXED, CELLS, COUNTS)}
SELECT "column", total_count, missing_count, round(missing_count * 100.0::DOUBLE / total_count, 4) + 0.0 AS missing_pct,
  unique_count, unique_count <= 1 AS is_constant FROM counts"""
ORACLES["column_types"] = f"""{with_(MIXED, CELLS, COUNTS, TYPES)}
SELECT "column", inferred_type, inferred_type = 'text_id' OR id_named AS is_id_candidate FROM types"""
ORACLES["numeric_stats"] = f"""{with_(MIXED, CELLS, COUNTS, TYPES, NUMBERS, STATS)}
SELECT "column", n, {r('mn')} AS min, {r('mx')} AS max, {r('mean')} AS mean, {r('std')} AS std, {r('q1')} AS q1,
  {r('median')} AS median, {r('q3')} AS q3, {r('q3 - q1')} AS iqr
FROM stats JOIN types USING ("column") WHERE inferred_type IN ('numerical', 'boolean')"""
ORACLES["iqr_outliers"] = f"""{with_(MIXED, CELLS, COUNTS, TYPES, NUMBERS, STATS, OUTLIERS)}
SELECT "column", {r('lower')} AS lower, {r('upper')} AS upper, n_values, outlier_count,
  {r('outlier_count * 100.0::DOUBLE / n_values')} AS outlier_pct
FROM outl JOIN types USING ("column") WHERE inferred_type IN ('numerical', 'boolean')"""
ORACLES["top_categories"] = f"""{with_(MIXED, CELLS, COUNTS, TYPES, TOP)}
SELECT "column", value, n, rank FROM top JOIN types USING ("column") WHERE inferred_type IN ('categorical', 'boolean')"""
ORACLES["frequent_values"] = f"""WITH cells AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c + '::DATE' if c == 'l_shipdate' else c}::VARCHAR AS value FROM lineitem"
    for c in ("l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber", "l_partkey", "l_orderkey")
)}),
counted AS (SELECT "column", value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
FROM counted QUALIFY rank <= 7"""
ORACLES["merged_distincts"] = f"""{with_(MIXED, CELLS, COUNTS)}
SELECT "column", total_count, missing_count, unique_count, TRUE AS within_error FROM counts"""
_PRIORITY_1 = "(contains(\"column\", 'price'))"
_SEGMENT_1 = "(contains(\"column\", 'os'))"
ORACLES["candidate_columns"] = f"""{with_(MIXED, CELLS, COUNTS, TYPES)},
c AS (SELECT *, inferred_type = 'text_id' OR id_named AS is_id FROM types)
SELECT "column", 'date' AS role, 0::BIGINT AS priority, ordinal::BIGINT AS ordinal FROM c WHERE inferred_type = 'datetime'
UNION ALL
SELECT "column", 'metric', CASE WHEN {_PRIORITY_1} THEN 1 ELSE 2 END::BIGINT, ordinal::BIGINT FROM c
WHERE inferred_type IN ('numerical', 'boolean') AND unique_count > 1 AND NOT is_id
UNION ALL
SELECT "column", 'segment', CASE WHEN {_SEGMENT_1} THEN 0 ELSE 1 END::BIGINT, ordinal::BIGINT FROM c
WHERE inferred_type IN ('categorical', 'boolean') AND unique_count BETWEEN 2 AND 80 AND NOT is_id"""
ORACLES["schema_health"] = f"""{with_(MIXED, CELLS, COUNTS, TYPES, NUMBERS, STATS, OUTLIERS, TOP)},
lead_values AS (SELECT "column", string_agg(value, ', ' ORDER BY rank) AS shown FROM top WHERE rank <= 2 GROUP BY 1)
SELECT "column", upper(inferred_type) AS inferred_type,
  printf('%.2f%% (%d)', missing_count * 100.0::DOUBLE / total_count, missing_count) AS missing, unique_count AS uniques,
  CASE WHEN inferred_type IN ('numerical', 'boolean') AND outlier_count IS NOT NULL
    THEN printf('%d (%.2f%%)', outlier_count, outlier_count * 100.0::DOUBLE / n_values) ELSE '0 (0.00%)' END AS outliers,
  CASE WHEN inferred_type IN ('numerical', 'boolean') AND mean IS NOT NULL THEN printf('%.4f', mean)
    WHEN inferred_type IN ('categorical', 'boolean') AND shown IS NOT NULL THEN '[' || shown || ']' ELSE '[]' END AS mean_or_top
FROM types LEFT JOIN stats USING ("column") LEFT JOIN outl USING ("column") LEFT JOIN lead_values USING ("column")"""

# --- detection --------------------------------------------------------------------------


def daily_cte(metric: str, name: str = "fact", prefix: str = "") -> str:
    return f"""
{prefix}daily AS (
  SELECT ts::DATE AS day, avg({metric}) AS raw, count(*) AS n_rows FROM {name} WHERE ts IS NOT NULL GROUP BY 1),
{prefix}filled AS (
  SELECT day AS label, raw, coalesce(first_value(raw IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS x,
    row_number() OVER (ORDER BY day) AS rn FROM {prefix}daily)"""


def points_cte(size: int, prefix: str = "") -> str:
    """Scored points from ``filled`` (label, raw, x, rn) with a window of ``size``."""
    need = max(2, size // 2)
    frame = f"OVER (ORDER BY rn ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    return f"""
{prefix}r0 AS (
  SELECT *, CASE WHEN count(x) {frame} >= {need} THEN avg(x) {frame} END AS rm,
    CASE WHEN count(x) {frame} >= {need} THEN stddev_samp(x) {frame} END AS rs FROM {prefix}filled),
{prefix}all_x AS (SELECT avg(x) AS mean, stddev_samp(x) AS std FROM {prefix}filled),
{prefix}first_row AS (SELECT rm AS first_mean, rs AS first_std FROM {prefix}r0 WHERE rn = {need + 1}),
{prefix}r1 AS (
  SELECT r.*, coalesce(rm, first_mean, mean) AS expected, coalesce(rs, first_std, std) AS s0,
    CASE WHEN std > 0 THEN std ELSE 1e-6 END AS usual
  FROM {prefix}r0 r CROSS JOIN {prefix}all_x LEFT JOIN {prefix}first_row ON true),
{prefix}r2 AS (SELECT *, CASE WHEN s0 <= 1e-12 * greatest(1.0, abs(expected)) THEN usual ELSE s0 END AS spread FROM {prefix}r1),
{prefix}points AS (
  SELECT *, (x - expected) / spread AS z, abs((x - expected) / spread) >= 2.5 AS is_anomaly,
    round((x - expected) / spread, 2) + 0.0 AS deviation_z,
    CASE WHEN abs((x - expected) / spread) < 2.5 THEN 'normal' WHEN abs((x - expected) / spread) >= 4 THEN 'critical'
      WHEN abs((x - expected) / spread) >= 3 THEN 'high' ELSE 'medium' END AS severity,
    round(least(abs((x - expected) / spread) / 5.0, 1.0), 3) + 0.0 AS anomaly_score
  FROM {prefix}r2)"""


def changepoint_cte(prefix: str = "") -> str:
    return f"""
{prefix}peak AS (SELECT rn AS peak_row FROM {prefix}points ORDER BY abs(deviation_z) DESC, rn LIMIT 1),
{prefix}islands AS (
  SELECT rn, rn - row_number() OVER (ORDER BY rn) AS island FROM {prefix}points WHERE is_anomaly),
{prefix}cp AS (
  SELECT peak_row, coalesce((SELECT min(j.rn) FROM {prefix}islands i JOIN {prefix}islands j USING (island) WHERE i.rn = peak_row), peak_row)
    AS changepoint_row, (SELECT count(*) FROM {prefix}points) AS n_points
  FROM {prefix}peak WHERE (SELECT bool_or(is_anomaly) FROM {prefix}points)),
{prefix}split AS (
  SELECT p.*, CASE WHEN changepoint_row > 3 THEN CASE WHEN rn >= changepoint_row THEN 'anomaly' ELSE 'baseline' END
    WHEN is_anomaly THEN 'anomaly' ELSE 'baseline' END AS period FROM {prefix}points p CROSS JOIN {prefix}cp)"""


def window_select(source: str, value: str, metric: str, method: str, flagged: str, extra: str = "") -> str:
    return f"""
SELECT '{metric}' AS metric, baseline_count, anomaly_count, {r('bm')} AS baseline_mean, {r('am')} AS anomaly_mean,
  {r('am - bm')} AS absolute_delta, {r('(am - bm) / (abs(bm) + 1e-9) * 100.0')} AS relative_pct_change,
  CASE WHEN am - bm < 0 THEN 'drop' ELSE 'spike' END AS direction, '{method}' AS detection_method,
  ({flagged})::BIGINT AS flagged_points{extra}
FROM (SELECT count(*) FILTER {B} AS baseline_count, count(*) FILTER {A} AS anomaly_count,
  avg({value}) FILTER {B} AS bm, avg({value}) FILTER {A} AS am FROM {source})"""


ORDERS, EVENTS, SHIPMENTS, QUALITY, STEP = (
    facts.ORDERS_SQL, facts.EVENTS_SQL, facts.SHIPMENTS_SQL, facts.QUALITY_SQL, facts.STEP_SQL
)
ORDER_POINTS = [ORDERS, daily_cte("amount"), points_cte(5)]
STEP_POINTS = [STEP, daily_cte("level"), points_cte(5)]
POINTS = f"""strftime(label, '%Y-%m-%d') AS day, {r('x', 7)} AS metric_mean, {r('expected', 7)} AS expected, deviation_z, is_anomaly,
  anomaly_score, severity"""
ORACLES["daily_metric"] = f"""{with_(ORDERS, daily_cte('amount'))}
SELECT strftime(day, '%Y-%m-%d') AS day, {r('raw', 7)} AS metric_mean, n_rows FROM daily"""
ORACLES["rolling_baseline"] = f"""{with_(*ORDER_POINTS)}
SELECT strftime(label, '%Y-%m-%d') AS day, {r('x', 7)} AS metric_mean, {r('expected', 7)} AS expected, {r('spread')} AS spread FROM points"""
ORACLES["rolling_z_points"] = f"{with_(*ORDER_POINTS)} SELECT {POINTS} FROM points"
ORACLES["flagged_points"] = f"{with_(*ORDER_POINTS)} SELECT {POINTS} FROM points WHERE is_anomaly"
EVENT_ROWS = """
filled AS (
  SELECT row_id AS label, value AS raw,
    coalesce(first_value(value IGNORE NULLS) OVER (ORDER BY ts, row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS x,
    row_number() OVER (ORDER BY ts, row_id) AS rn FROM fact)"""
ORACLES["row_rolling_points"] = f"""{with_(EVENTS, EVENT_ROWS, points_cte(7))}
SELECT label AS row_id, {r('x')} AS value, {r('expected')} AS expected, {r('spread')} AS spread, is_anomaly, severity FROM points"""

STEP2 = [STEP.replace("fact AS", "step_fact AS"), daily_cte("level", "step_fact", "s_"), points_cte(5, "s_"), changepoint_cte("s_")]
ORACLES["changepoint"] = f"""{with_(*STEP2, *ORDER_POINTS, changepoint_cte())}
SELECT peak_row, changepoint_row, n_points, 'step' AS series FROM s_cp
UNION ALL SELECT peak_row, changepoint_row, n_points, 'orders' FROM cp"""
_EDGES = """,
  (SELECT strftime(min(label) FILTER (WHERE period = 'baseline'), '%Y-%m-%d') || ' to ' || strftime(max(label) FILTER (WHERE period = 'baseline'), '%Y-%m-%d') FROM {s}) AS baseline_label,
  (SELECT strftime(min(label) FILTER (WHERE period = 'anomaly'), '%Y-%m-%d') || ' to ' || strftime(max(label) FILTER (WHERE period = 'anomaly'), '%Y-%m-%d') FROM {s}) AS anomaly_label"""


def _flags(prefix: str) -> str:
    return f"SELECT count(*) FROM {prefix}points WHERE is_anomaly"


EVENT_POINTS = [EVENTS, daily_cte("value"), points_cte(5), changepoint_cte()]
ORACLES["series_window"] = f"""{with_(*STEP2, *EVENT_POINTS)}
{window_select('s_split', 'raw', 'level', 'rolling_zscore', _flags('s_'), _EDGES.format(s='s_split'))}
UNION ALL
{window_select('split', 'raw', 'value', 'rolling_zscore', _flags(''), _EDGES.format(s='split'))}"""


def temporal_sql(prefix: str, fact: str, metric: str, mode: str, first: bool) -> str:
    day = (
        f"(SELECT min(label) FROM {prefix}points WHERE is_anomaly)" if first
        else f"(SELECT min(label) FROM {prefix}points WHERE rn = (SELECT changepoint_row FROM {prefix}cp))"
    )
    source = f"(SELECT *, CASE WHEN ts >= {day} THEN 'anomaly' WHEN ts < {day} THEN 'baseline' END AS period FROM {fact})"
    extra = (
        f", 'Baseline (< ' || strftime({day}, '%Y-%m-%d') || ')' AS baseline_label,"
        f" 'Anomaly Window (>= ' || strftime({day}, '%Y-%m-%d') || ')' AS anomaly_label{mode}"
    )
    return window_select(source, metric, metric, "temporal_changepoint", _flags(prefix), extra) + (
        " WHERE baseline_count >= 5 AND anomaly_count >= 5"
    )


ORDERS_PLAIN = ORDERS.replace("END AS period", "END AS old_period")
ORACLES["temporal_changepoint"] = f"""{with_(*STEP2, ORDERS_PLAIN, daily_cte('amount'), points_cte(5), changepoint_cte())}
{temporal_sql('s_', 'step_fact', 'level', ", 'first_flag' AS mode", True)}
UNION ALL {temporal_sql('s_', 'step_fact', 'level', ", 'most_severe' AS mode", False)}
UNION ALL {temporal_sql('', 'fact', 'amount', ", 'orders' AS mode", True)}"""
ORACLES["window_summary"] = f"""{with_(ORDERS, EVENTS.replace('fact AS', 'ev AS'))}
{window_select('fact', 'amount', 'amount', 'user_specified', '0')}
UNION ALL {window_select('ev', 'value', 'value', 'user_specified', '0')}"""
HALF = """
halves AS (
  SELECT * EXCLUDE (period), CASE WHEN row_number() OVER (ORDER BY ts, row_id) > (SELECT count(*) // 2 FROM fact) THEN 'anomaly' ELSE 'baseline' END
    AS period FROM fact)"""
ORACLES["fallback_split"] = f"""{with_(EVENTS, HALF)}
{window_select('halves', 'value', 'value', 'fallback_split', '0', ", 'Baseline Cohort' AS baseline_label, 'Comparison Cohort' AS anomaly_label")}"""

# --- isolation forest, grown by the same hashes ---------------------------------------------

MEASURED = """
measured AS (
  SELECT f.row_id, f.ts, f.event_type, f.region, f.value, json_extract_string(e.props, '$.k')::DOUBLE AS k
  FROM fact f JOIN events e ON e.event_id = f.row_id)"""


def _hash(*parts: str) -> str:
    return f"('0x' || substr(md5({" || ':' || ".join(f'{p}::VARCHAR' for p in parts)}), 1, {isolation.HASH_DIGITS}))::BIGINT"


def forest_ctes(columns: list[str], levels: int = 8) -> list[str]:
    """The forest level by level; ``levels`` is the depth limit for at least 129 rows."""
    f = [f"f{i}" for i in range(len(columns))]
    listed = ", ".join(f)
    below = f"[{', '.join(map(str, isolation.leaf_paths()))}]"
    lows = "[" + ", ".join(f"{{'i': {i}, 'low': min({c}) OVER w, 'high': max({c}) OVER w}}" for i, c in enumerate(f)) + "]"
    trees, sample, seed, unit = isolation.TREES, isolation.SAMPLE, isolation.SEED, isolation.UNIT
    ctes = [
        f"""complete AS (SELECT *, {", ".join(f"{c}::DOUBLE AS {n}" for n, c in zip(f, columns))} FROM measured
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in columns)})""",
        f"""pool AS (SELECT {listed}, row_number() OVER (ORDER BY {_hash(str(seed), 'row_id')}, row_id) - 1 AS place,
  count(*) OVER () AS size FROM complete)""",
        f"""level0 AS MATERIALIZED (
  SELECT t.tree, {listed}, 1::BIGINT AS node, false AS done
  FROM (SELECT *, unnest(range(place, {trees} * least({sample}, size), size)) AS turn FROM pool) p,
    LATERAL (SELECT (turn // least({sample}, size))::INT AS tree) t)""",
    ]
    for d in range(levels + 1):
        leaf = "true" if d == levels else "n <= 1 OR len(usable) = 0"
        ctes.append(f"""seen{d} AS MATERIALIZED (
  SELECT *, CASE WHEN NOT leaf THEN usable[{_hash(str(seed), 'tree', 'node', '1')} % len(usable) + 1] END AS pick,
    {_hash(str(seed), 'tree', 'node', '2')} / {float(16 ** isolation.HASH_DIGITS)}::DOUBLE AS part
  FROM (SELECT *, {leaf} AS leaf FROM (SELECT *, count(*) OVER w AS n, list_filter({lows}, lambda c: c.high > c.low) AS usable
    FROM level{d} WHERE NOT done WINDOW w AS (PARTITION BY tree, node))))""")
        ctes.append(f"""made{d} AS (
  SELECT DISTINCT tree, node, pick.i AS feature, pick.low + part * (pick.high - pick.low) AS threshold,
    CASE WHEN leaf THEN {d * unit} + {below}[n + 1] END AS path FROM seen{d})""")
        if d < levels:
            ctes.append(f"""level{d + 1} AS MATERIALIZED (
  SELECT tree, {listed}, 2 * node + CASE WHEN [{listed}][pick.i + 1] > pick.low + part * (pick.high - pick.low) THEN 1 ELSE 0 END AS node,
    false AS done FROM seen{d} WHERE NOT leaf)""")
    ctes.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM made{d}" for d in range(levels + 1)) + ")")
    ctes.append(f"""walk0 AS (SELECT row_id, {listed}, tree, 1::BIGINT AS node, NULL::BIGINT AS path FROM complete, range({trees}) r(tree))""")
    for d in range(levels + 1):
        ctes.append(f"""walk{d + 1} AS MATERIALIZED (
  SELECT w.row_id, {", ".join("w." + c for c in f)}, w.tree,
    CASE WHEN m.feature IS NULL THEN w.node ELSE 2 * w.node + CASE WHEN [{", ".join("w." + c for c in f)}][m.feature + 1] > m.threshold THEN 1 ELSE 0 END END AS node,
    CASE WHEN w.path IS NOT NULL THEN w.path WHEN m.node IS NULL THEN {d * unit} ELSE m.path END AS path
  FROM walk{d} w LEFT JOIN nodes m ON m.tree = w.tree AND m.node = w.node)""")
    norm = "(SELECT least(256, count(*)) FROM complete)"
    averages = f"[{', '.join(repr(isolation.average_path(n)) for n in range(sample + 1))}]::DOUBLE[]"
    ctes += [
        f"""scores AS MATERIALIZED (SELECT row_id, pow(2.0, -sum(path) / (list_extract({averages}, {norm} + 1) * {trees} * {unit})) AS anomaly_score
  FROM walk{levels + 1} GROUP BY row_id)""",
        """marked AS (SELECT c.*, s.anomaly_score, s.anomaly_score > (SELECT quantile_cont(anomaly_score, 0.95) FROM scores) AS is_anomaly
  FROM complete c JOIN scores s USING (row_id))""",
        """inliers AS (SELECT avg(value) AS expected, coalesce(stddev_samp(value), 1.0) AS std FROM marked WHERE NOT is_anomaly)""",
        """forest AS (SELECT *, (value - expected) / (std + 1e-9) AS z, CASE WHEN is_anomaly THEN 'anomaly' ELSE 'baseline' END AS period
  FROM marked, inliers)""",
    ]
    return ctes


FOREST_WINDOW = window_select(
    "forest", "value", "value", "isolation_forest", "SELECT count(*) FROM forest WHERE is_anomaly",
    ", 'Inlier Cohort (N=' || baseline_count || ')' AS baseline_label, 'Isolation Forest Anomaly Cluster (N=' || anomaly_count || ')' AS anomaly_label",
)
ORACLES["iforest_points"] = f"""{with_(EVENTS, MEASURED, *forest_ctes(['value', 'k']))}
SELECT row_id, {r('value')} AS value, {r('expected')} AS expected, {r('z', 2)} AS deviation_z, is_anomaly,
  {r('anomaly_score')} AS anomaly_score,
  CASE WHEN NOT is_anomaly THEN 'normal' WHEN abs(z) > 3.0 THEN 'critical' ELSE 'high' END AS severity FROM forest"""
ORACLES["iforest_window"] = f"{with_(EVENTS, MEASURED, *forest_ctes(['value', 'k']))} {FOREST_WINDOW}"
ORACLES["auto_window"] = f"""{with_(*STEP2, EVENTS, MEASURED, *forest_ctes(['value', 'row_id', 'k']))}
{temporal_sql('s_', 'step_fact', 'level', '', True)} UNION ALL {FOREST_WINDOW}"""

# --- tests ---------------------------------------------------------------------------------

EVENT_LONG = [EVENTS, long_cte("value", facts.EVENTS_DIMS)]
SHIP_LONG = [SHIPMENTS, long_cte("revenue", facts.SHIPMENTS_DIMS, joint=True)]
SHIP_PLAIN = [SHIPMENTS, long_cte("revenue", facts.SHIPMENTS_DIMS)]
SEG = "dimension, segment_value"
ORACLES["two_sample_summary"] = f"""{with_(*EVENT_LONG, moments_cte())}
SELECT {SEG}, n_base, n_anom, """ + ", ".join(
    f"{r(f'{m}_{s}')} AS {m}_{s}" for m in ("mean", "var", "skew") for s in ("base", "anom")
) + " FROM mom"
ORACLES["cohens_d"] = f"{with_(*SHIP_LONG, moments_cte(), welch_cte())} SELECT {SEG}, {r('cohens_d', 6)} AS cohens_d FROM welch"
ORACLES["welch_t"] = f"""{with_(*SHIP_LONG, moments_cte(), welch_cte())}
SELECT {SEG}, {r('welch_t', 5)} AS welch_t, {r('welch_df', 3)} AS welch_df, {r('welch_p', 7)} AS welch_p FROM welch"""
ORACLES["mann_whitney"] = f"""{with_(*EVENT_LONG, ranks_cte())}
SELECT {SEG}, {r('u_stat', 1)} AS u_stat, {r('u_z', 6)} AS u_z, {r('u_p', 7)} AS u_p, distinct_values FROM ranks"""
_TESTED = f"""{SEG}, test_name, {r('statistic')} AS statistic, {r('p_value', 7)} AS p_value, {r('effect')} AS effect, n_base, n_anom, df"""
ORACLES["test_selection"] = f"""SELECT * FROM ({with_(*EVENT_LONG, *full_tests())} SELECT 'events' AS fact, {_TESTED} FROM tests)
UNION ALL SELECT * FROM ({with_(QUALITY, long_cte('toxic', ['lang', 'source']), *full_tests())} SELECT 'quality' AS fact, {_TESTED} FROM tests)"""
ORACLES["mean_diff_ci"] = f"""{with_(*SHIP_LONG, moments_cte(), welch_cte())}
SELECT {SEG}, {r('mean_diff')} AS mean_diff, {r('ci_low')} AS ci_low, {r('ci_high')} AS ci_high FROM welch"""
EFFECT_WORD = "CASE WHEN abs(effect) < 0.2 THEN 'negligible' WHEN abs(effect) < 0.5 THEN 'small' WHEN abs(effect) < 0.8 THEN 'moderate' ELSE 'large' END"
SIGNIFICANCE = "CASE WHEN p_value < 0.05 THEN 'statistically significant' ELSE 'not statistically significant' END"
SHIFT = "CASE WHEN mean_diff < 0 THEN 'decrease' ELSE 'increase' END"


def sentence(subject: str) -> str:
    return (
        f"printf('%s: %s %s of %s, mean difference %+.4f (95%% CI %+.4f to %+.4f), p = %.4f, d = %+.2f (%s)', test_name,"
        f" {SIGNIFICANCE}, {SHIFT}, {subject}, mean_diff, ci_low, ci_high, p_value, effect, {EFFECT_WORD})"
    )


ORACLES["evidence_text"] = f"""{with_(*SHIP_LONG, *full_tests())}
SELECT {SEG}, test_name, {EFFECT_WORD} AS effect_word, {SIGNIFICANCE} AS significance, {SHIFT} AS shift,
  {sentence("dimension || '=' || segment_value")} AS interpretation FROM tests"""
ORACLES["contingency"] = f"{with_(*EVENT_LONG, moments_cte())} SELECT {SEG}, volume_base, volume_anom FROM mom"
ORACLES["chi_square"] = f"""{with_(*SHIP_LONG, moments_cte(), chi_cte())}
SELECT dimension, categories, df, {r('chi2', 6)} AS chi2, {r('p_value', 7)} AS p_value FROM chi"""
ASSOCIATION = "CASE WHEN cramers_v < 0.1 THEN 'negligible' WHEN cramers_v < 0.3 THEN 'moderate' ELSE 'strong' END"
ORACLES["cramers_v"] = f"""{with_(QUALITY, long_cte('quality', ['lang', 'source']), moments_cte(), chi_cte())}
SELECT dimension, total_base, total_anom, {r('chi2', 6)} AS chi2, {r('cramers_v', 6)} AS cramers_v, {ASSOCIATION} AS association FROM chi"""

def covariates_cte(metric: str, names: list[str]) -> str:
    return "long AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS covariate, period, {c}::DOUBLE AS x, {metric}::DOUBLE AS y FROM fact" for c in names
    ) + ")"


COVARIATES = covariates_cte("revenue", facts.SHIPMENTS_COVARIATES)


def correlation_cte(name: str, x: str, y: str, source: str) -> str:
    return f"""
{name}0 AS (
  SELECT covariate, count(*) AS n_pairs, corr({x}, {y}) AS {name} FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1),
{name}1 AS (SELECT *, {name} * sqrt((n_pairs - 2) / (1 - {name} * {name})) AS {name}_t, (n_pairs - 2)::DOUBLE AS {name}_df FROM {name}0),
{name}_tab AS (SELECT covariate, n_pairs, {name}, {p_t(f'{name}_t', f'{name}_df')} AS {name}_p FROM {name}1)"""


PAIR_RANKS = """
pair_ranks AS (
  SELECT covariate, x, y,
    rank() OVER (PARTITION BY covariate ORDER BY x) + (count(*) OVER (PARTITION BY covariate, x) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY covariate ORDER BY y) + (count(*) OVER (PARTITION BY covariate, y) - 1) / 2.0::DOUBLE AS ry
  FROM long WHERE x IS NOT NULL AND y IS NOT NULL)"""
PEARSON = correlation_cte("r", "y", "x", "long")
SPEARMAN = correlation_cte("rho", "ry", "rx", "pair_ranks")
ORACLES["pearson"] = f"{with_(SHIPMENTS, COVARIATES, PEARSON)} SELECT covariate, n_pairs, {r('r', 6)} AS r, {r('r_p', 7)} AS r_p FROM r_tab"
ORACLES["spearman"] = f"{with_(SHIPMENTS, COVARIATES, PAIR_RANKS, SPEARMAN)} SELECT covariate, n_pairs, {r('rho', 6)} AS rho, {r('rho_p', 7)} AS rho_p FROM rho_tab"
COV_TESTS = full_tests("covariate", "true")
ORACLES["covariate_shift"] = f"""{with_(SHIPMENTS, COVARIATES, *COV_TESTS)}
SELECT covariate, 'Covariate Shift (' || test_name || ')' AS test_name, {r('statistic')} AS statistic, {r('p_value', 7)} AS p_value,
  {r('effect')} AS effect, df FROM tests"""
ORACLES["hypothesis_status"] = f"""{with_(*SHIP_LONG, *full_tests(), verdict_cte('tests', 'judged', '-1.0'))}
SELECT {SEG}, status, {r('score')} AS score FROM judged"""

# --- decomposition ---------------------------------------------------------------------------

ORDER_CONTRIBS = [ORDERS, long_cte("amount", ["status", "priority"]), moments_cte(), contribs_cte("amount")]
EVENT_CONTRIBS = [*EVENT_LONG, moments_cte(), contribs_cte("value")]
SHIP_CONTRIBS = [*SHIP_PLAIN, moments_cte(), contribs_cte("revenue")]


def rates(digits: int) -> str:
    return "volume_base, volume_anom, " + ", ".join(
        f"{r(c, digits)} AS {c}" for c in ("share_base", "share_anom", "rate_base", "rate_anom")
    )


ORACLES["segment_rates"] = f"{with_(*EVENT_CONTRIBS)} SELECT {SEG}, {rates(6)} FROM con"
ORACLES["rate_mix"] = f"{with_(*EVENT_CONTRIBS)} SELECT {SEG}, {r('rate_effect', 6)} AS rate_effect, {r('mix_effect', 6)} AS mix_effect FROM con"
_IMPACT = f"{r('contribution')} AS contribution, {r('pct_of_total')} AS pct_of_total, is_primary"
ORACLES["segment_contributions"] = f"""{with_(ORDERS, long_cte('amount', ['status']), moments_cte(), contribs_cte('amount'))}
SELECT {SEG}, {r('rate_change')} AS rate_change, {_IMPACT} FROM con"""
ORACLES["decompose_all"] = f"""{with_(*ORDER_CONTRIBS)}
SELECT {SEG}, {rates(4)}, {r('rate_effect')} AS rate_effect, {r('mix_effect')} AS mix_effect, {_IMPACT} FROM con"""
ORACLES["top_contributors"] = f"{with_(*EVENT_CONTRIBS)} SELECT {SEG}, impact_rank, {r('contribution')} AS contribution FROM con WHERE impact_rank <= 3"
ORACLES["contribution_bars"] = f"""{with_(*ORDER_CONTRIBS)}
SELECT overall_rank AS impact_rank, dimension || '=' || segment_value AS label, {r('pct_of_total')} AS pct_of_total,
  CASE WHEN (pct_of_total > 0 AND total_delta >= 0) OR (pct_of_total < 0 AND total_delta < 0) THEN 'red' ELSE 'blue' END AS color_class
FROM con WHERE overall_rank <= 8"""

# --- hypotheses ---------------------------------------------------------------------------------


def hyp_id(prefix: str, run: str, metric: str, value: str) -> str:
    text = f"concat_ws('|', '{run}', '{metric}', dimension, {value})"
    return f"'HYP-{prefix}-' || upper(substring(md5({text}), 1, 8))"


def segment_family(run: str, metric: str, source: str = "mom") -> str:
    """Needs tests and con; rows with listing columns o0..o3."""
    sign = "CASE WHEN total_delta < 0 THEN -1.0 ELSE 1.0 END"
    joined = (
        "sj AS (SELECT t.*, total_delta, pct_of_total, impact_rank, rate_base, rate_anom FROM tests t"
        " JOIN con USING (dimension, segment_value) WHERE impact_rank <= 5 AND con.volume_base >= 5 AND con.volume_anom >= 5)"
    )
    return f"""{joined},
{verdict_cte('sj', 'sv', sign)},
fam_seg AS (
  SELECT 'segment_performance' AS family, {hyp_id('SEG', run, metric, 'segment_value')} AS hypothesis_id, dimension,
    segment_value AS dimension_value, 'Segment ' || dimension || ' = ''' || segment_value || ''' drives the change' AS title, status,
    least(100.0, score * 0.7 + least(abs(pct_of_total), 100.0) * 0.3) AS score,
    printf('Mean %s in ''%s'' moved from %.4f to %.4f, which is %.1f%% of the total change.', '{metric}', segment_value,
      rate_base, rate_anom, pct_of_total) AS description,
    test_name, p_value, effect_name, effect, impact_rank
  FROM sv)"""


def mix_family(run: str, metric: str, dims: list[str]) -> str:
    listed = ", ".join(f"'{d}'" for d in dims)
    return f"""{chi_cte()},
mj AS (
  SELECT *, 'Cramer''s V' AS effect_name, cramers_v AS effect, total_base AS n_base, total_anom AS n_anom,
    'Chi-Square Test of Independence' AS test_name
  FROM chi WHERE dimension IN ({listed}) AND total_base >= 10 AND total_anom >= 10 AND categories_base >= 2 AND categories >= 2),
{verdict_cte('mj', 'mv')},
fam_mix AS (
  SELECT 'mix_shift' AS family, {hyp_id('MIX', run, metric, 'NULL')} AS hypothesis_id, dimension, NULL::VARCHAR AS dimension_value,
    'The mix of ''' || dimension || ''' shifted' AS title, status, score, chi2, test_name, p_value, effect_name, effect
  FROM mv)"""


HYP = "hypothesis_id, dimension, dimension_value, title, status"
ORACLES["hyp_segment"] = f"""{with_(*EVENT_LONG, *full_tests(), contribs_cte('value'), segment_family('events', 'value'))}
SELECT {HYP}, {r('score')} AS score, description, test_name, {r('p_value', 7)} AS p_value FROM fam_seg"""
ORACLES["hyp_mix"] = f"""{with_(*EVENT_LONG, moments_cte(), mix_family('events', 'value', facts.EVENTS_DIMS))}
SELECT {HYP}, {r('score')} AS score, {r('chi2')} AS chi2, {r('p_value', 7)} AS p_value FROM fam_mix"""


def _prefixed(cte: str, names: list[str], prefix: str) -> str:
    """The same fragment under other CTE names, so two long tables can live side by side."""
    for name in names:
        cte = re.sub(rf"\b{name}\b(?=( AS \(|\b(?!\.)))", f"{prefix}{name}", cte)
    return cte


_TEST_NAMES = ["long", "means", "skews", "mom", "w0", "w1", "welch", "rk", "u0", "u1", "u2", "ranks", "tests"]


def covariate_block(run: str, metric: str, names: list[str] = facts.SHIPMENTS_COVARIATES) -> str:
    tests = ",\n".join(full_tests("covariate", "true"))
    tests = tests.replace("welch.*", "cwelch.*").replace("ranks.*", "cranks.*")
    tests = _prefixed(tests, _TEST_NAMES, "c")
    tests = tests.replace("ccwelch", "cwelch").replace("ccranks", "cranks")
    longs = covariates_cte(metric, names).replace("long AS", "clong AS", 1)
    pearson_sql = PEARSON.replace("FROM long", "FROM clong")
    ranks_sql = PAIR_RANKS.replace("FROM long", "FROM clong")
    both = (
        "((abs(r) > 0.25 AND r_p < 0.05) OR (abs(rho) > 0.25 AND rho_p < 0.05)) AND n_pairs >= 10 AND p_value < 0.05"
    )
    return f"""{longs},
{tests},
{pearson_sql},
{ranks_sql},
{SPEARMAN},
cj AS (
  SELECT t.*, n_pairs, r, r_p, rho, rho_p FROM ctests t JOIN r_tab USING (covariate)
    JOIN (SELECT covariate, rho, rho_p FROM rho_tab) USING (covariate)),
{verdict_cte('cj', 'cv')},
fam_cov AS (
  SELECT 'covariate_drift' AS family, covariate AS dimension, NULL::VARCHAR AS dimension_value,
    'HYP-COV-' || upper(substring(md5(concat_ws('|', '{run}', '{metric}', covariate)), 1, 8)) AS hypothesis_id,
    'Covariate ''' || covariate || ''' drifted together with {metric}' AS title,
    CASE WHEN {both} THEN 'supported' ELSE status END AS status,
    CASE WHEN {both} THEN least(92.0, score + 20.0) ELSE score END AS score,
    CASE WHEN n_pairs >= 10 THEN 2 ELSE 0 END + 1 AS n_evidence, r, r_p
  FROM cv)"""


def joint_family(run: str, metric: str, dims: list[str]) -> str:
    joint = " × ".join(dims[:2])
    return f"""
jt AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY volume_anom DESC, segment_value) AS volume_rank
    FROM tests WHERE dimension = '{joint}' AND volume_anom > 0) WHERE volume_rank <= 3),
jb AS (SELECT * FROM jt WHERE volume_base >= 8 AND volume_anom >= 8),
{verdict_cte('jb', 'jv')},
fam_int AS (
  SELECT 'multivariate_anomaly' AS family, {hyp_id('INT', run, metric, 'segment_value')} AS hypothesis_id, dimension,
    segment_value AS dimension_value, 'Crossed cohort ''' || segment_value || ''' changed' AS title, status, score + 5.0 AS score,
    volume_rank, test_name, p_value, effect_name, effect
  FROM jv WHERE status IN ('supported', 'weak'))"""


ORACLES["hyp_covariate"] = f"""{with_(SHIPMENTS, covariate_block('shipments', 'revenue'))}
SELECT {HYP}, {r('score')} AS score, n_evidence::BIGINT AS n_evidence FROM fam_cov"""
ORACLES["hyp_interaction"] = f"""{with_(*SHIP_LONG, *full_tests(), joint_family('shipments', 'revenue', facts.SHIPMENTS_DIMS))}
SELECT {HYP}, {r('score')} AS score FROM fam_int"""


def _place(names: list[str], column: str = "dimension") -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{n}' THEN {i}" for i, n in enumerate(names)) + " END"


_DIMS, _COVS = facts.SHIPMENTS_DIMS, facts.SHIPMENTS_COVARIATES
_COMMON = "family, hypothesis_id, dimension, dimension_value, title, status, score"


def ranked(fact: str, run: str, metric: str, covariates: list[str]) -> str:
    """All families of one run over the dimensions of the shipments, ranked."""
    only = "FROM mom CROSS JOIN tot WHERE dimension IN ('flag', 'line_status')"
    families = f"""
fams AS (
  SELECT {_COMMON}, 0 AS o0, {_place(_DIMS)} AS o1, 0 AS o2, impact_rank AS o3, test_name, p_value, effect_name, effect FROM fam_seg
  UNION ALL SELECT {_COMMON}, 0, {_place(_DIMS)}, 1, 0, test_name, p_value, effect_name, effect FROM fam_mix
  UNION ALL SELECT {_COMMON}, 1, {_place(covariates)}, 0, 0, 'Pearson Correlation', r_p, 'Pearson r', r FROM fam_cov
  UNION ALL SELECT {_COMMON}, 2, 0, 0, volume_rank, test_name, p_value, effect_name, effect FROM fam_int),
hyps AS (
  SELECT *, row_number() OVER (ORDER BY CASE status WHEN 'supported' THEN 0 WHEN 'weak' THEN 1 WHEN 'inconclusive' THEN 2 ELSE 3 END,
    score DESC, o0, o1, o2, o3) AS rank FROM fams)"""
    return ",\n".join([
        fact, long_cte(metric, _DIMS, joint=True), *full_tests(),
        contribs_cte(metric).replace("FROM mom CROSS JOIN tot", only),
        segment_family(run, metric), mix_family(run, metric, _DIMS), covariate_block(run, metric, covariates),
        joint_family(run, metric, _DIMS), families,
    ])


RANKED = ranked(SHIPMENTS, "shipments", "revenue", _COVS)
ORACLES["hypotheses_ranked"] = f"{with_(RANKED)} SELECT rank, family, {HYP}, {r('score')} AS score FROM hyps"
ORACLES["hyp_by_status"] = f"{with_(RANKED)} SELECT rank, family, {HYP}, {r('score')} AS score FROM hyps WHERE status = 'supported'"

# --- scenarios ---------------------------------------------------------------------------------

_SCENARIO = ", ".join(
    f"{r(c)} AS {c}"
    for c in ("observed_metric", "projected_metric", "restoration_delta", "recovery_pct", "signed_recovery_pct", "ci_lower", "ci_upper")
)
ORACLES["scenario_candidates"] = f"""{with_(*EVENT_CONTRIBS, scenarios_cte())}
SELECT {SEG}, {r('contribution')} AS contribution, {r('rate_change')} AS rate_change, is_primary FROM cand"""
ORACLES["counterfactual"] = f"{with_(*EVENT_CONTRIBS, scenarios_cte())} SELECT {SEG}, {_SCENARIO} FROM scen"
ORACLES["top_scenarios"] = f"{with_(*SHIP_CONTRIBS, scenarios_cte())} SELECT scenario_rank, scenario, {_SCENARIO} FROM top"
ORACLES["remediation_curve"] = f"""{with_(*SHIP_CONTRIBS, scenarios_cte())}
SELECT scenario_rank, scenario, e::BIGINT AS effect_pct, {r('restoration_delta * e / 100.0')} AS scaled_delta,
  {r('observed_metric + restoration_delta * e / 100.0')} AS scaled_metric, {r('recovery_pct * e / 100.0')} AS scaled_recovery_pct,
  {r('margin * e / 100.0')} AS upper_margin, {r('margin * e / 100.0')} AS lower_margin
FROM top CROSS JOIN (SELECT unnest(range(10, 101, 10)) AS e)"""

# --- graph, report, charts ---------------------------------------------------------------------------

_CONTRIBUTION_TEXT = (
    "printf('%s = ''%s''%s: %+.1f%% of the change, rate %.4f to %.4f (%+.4f)', dimension, segment_value,"
    " CASE WHEN is_primary THEN ' [PRIMARY DRIVER]' ELSE '' END, pct_of_total, rate_base, rate_anom, rate_change)"
)
_SCENARIO_TEXT = (
    "printf('%s: projected %.4f against observed %.4f, recovers %.1f%%, 95%% CI %.4f to %.4f',"
    " scenario, projected_metric, observed_metric, recovery_pct, ci_lower, ci_upper)"
)
_CHANGE = "(overall_anom - overall_base) / (abs(overall_base) + 1e-9) * 100.0"
_DIRECTION = "CASE WHEN overall_anom < overall_base THEN 'drop' ELSE 'spike' END"
_PRIMARY = "coalesce((SELECT title FROM hyps WHERE status = 'supported' ORDER BY rank LIMIT 1), 'no single driver')"
GRAPH = """
g AS (SELECT *, CASE WHEN dimension_value IS NULL THEN dimension || '_drift' ELSE dimension || '=' || dimension_value END AS factor
  FROM hyps WHERE rank <= 10)"""
ORACLES["graph_nodes"] = f"""{with_(RANKED, GRAPH)},
n AS (
  SELECT 'revenue' AS node_id, 'metric' AS node_type, 35 AS size, 'blue' AS color FROM g
  UNION SELECT dimension, 'dimension', 25, 'purple' FROM g
  UNION SELECT factor, 'segment', 22, 'cyan' FROM g
  UNION SELECT hypothesis_id, 'hypothesis', 18, CASE status WHEN 'supported' THEN 'red' WHEN 'weak' THEN 'amber' ELSE 'gray' END FROM g
  UNION SELECT 'EV_' || hypothesis_id, 'evidence', 14, 'green' FROM g)
SELECT 'shipments' AS run_id, node_id, node_type, size::BIGINT AS size, color FROM n"""
ORACLES["graph_edges"] = f"""{with_(RANKED, GRAPH)},
e AS (
  SELECT 'revenue' AS source, dimension AS target, 'decomposed_by' AS relation, 1.0::DOUBLE AS weight FROM g
  UNION SELECT dimension, factor, 'contains', 1.5 FROM g
  UNION SELECT factor, hypothesis_id, 'tested_by', score / 20.0 FROM g
  UNION SELECT hypothesis_id, 'EV_' || hypothesis_id, 'verified_by', 2.0 FROM g)
SELECT 'shipments' AS run_id, source, target, relation, {r('weight')} AS weight FROM e"""
ORACLES["report_summary"] = f"""{with_(RANKED)}
SELECT 'shipments' AS run_id, 'revenue' AS metric, {r('overall_base')} AS baseline_mean, {r('overall_anom')} AS anomaly_mean,
  {r('abs((overall_anom - overall_base) / (abs(overall_base) + 1e-9) * 100.0)')} AS abs_pct_change,
  CASE WHEN overall_anom < overall_base THEN 'drop' ELSE 'spike' END AS direction, 'user_specified' AS detection_method,
  coalesce((SELECT title FROM hyps WHERE status = 'supported' ORDER BY rank LIMIT 1), 'no single driver') AS primary_hypothesis,
  {r("(SELECT score FROM hyps WHERE status = 'supported' ORDER BY rank LIMIT 1)")} AS primary_score
FROM tot"""
ORACLES["report_contributions"] = f"""{with_(*SHIP_CONTRIBS)}
SELECT overall_rank AS line_no, {_CONTRIBUTION_TEXT} AS text FROM con WHERE overall_rank <= 4"""
ORACLES["report_matrix"] = f"""{with_(RANKED)}
SELECT rank, upper(status) AS status, title, dimension, {r('score')} AS score, test_name,
  printf('%s=%+.2f', effect_name, coalesce(effect, 0.0)) AS effect FROM hyps WHERE rank <= 8"""
ORACLES["report_scenarios"] = f"""{with_(*SHIP_CONTRIBS, scenarios_cte())}
SELECT scenario_rank AS line_no, {_SCENARIO_TEXT} AS text FROM top"""


def report_sql(fact: str, run: str, metric: str, covariates: list[str]) -> str:
    return f"""{with_(ranked(fact, run, metric, covariates), scenarios_cte())},
lines AS (
  SELECT 1 AS section, 1 AS line_no, printf('%s moved from %.4f to %.4f, a %.2f%% %s, found by %s; primary explanation: %s', '{metric}',
    overall_base, overall_anom, abs({_CHANGE}), {_DIRECTION}, 'user_specified', {_PRIMARY}) AS text FROM tot
  UNION ALL SELECT 2, overall_rank, {_CONTRIBUTION_TEXT} FROM con WHERE overall_rank <= 4
  UNION ALL SELECT 3, rank, printf('#%d %s | %s | %s | %.1f%% | %s (%s)', rank, upper(status), title, dimension, score, test_name,
    printf('%s=%+.2f', effect_name, coalesce(effect, 0.0))) FROM hyps WHERE rank <= 8
  UNION ALL SELECT 4, scenario_rank, {_SCENARIO_TEXT} FROM top
  UNION ALL SELECT 5, * FROM (VALUES {", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(report.CAVEATS))}))
SELECT '{run}' AS run_id, section::BIGINT AS section, line_no::BIGINT AS line_no, text FROM lines"""


def batch_fact(cutoff: str) -> str:
    """The shipments with another window."""
    period = f"CASE WHEN ts >= TIMESTAMP '{cutoff}' THEN 'anomaly' WHEN ts < TIMESTAMP '{cutoff}' THEN 'baseline' END AS period"
    return f"{SHIPMENTS.replace('fact AS', 'planted AS', 1)},\nfact AS (SELECT * REPLACE ({period}) FROM planted)"


def batch_sql() -> str:
    runs = [(m, c) for m in facts.BATCH_METRICS for c in facts.BATCH_CUTOFFS]
    parts = [report_sql(batch_fact(c), f"{m}@{c}", m, [x for x in _COVS if x != m]) for m, c in runs]
    return " UNION ALL ".join(f"SELECT * FROM ({part})" for part in parts)


ORACLES["report_lines"] = report_sql(SHIPMENTS, "shipments", "revenue", _COVS)
ORACLES["report_export"] = f"SELECT run_id, text FROM ({ORACLES['report_lines']}) AS report"
ORACLES["report_lines_batch"] = batch_sql()
ORACLES["history_rebuild"] = ORACLES["report_lines"]
ORACLES["history_contributions"] = f"""{with_(*SHIP_CONTRIBS)}
SELECT id, {SEG}, {r('contribution')} AS contribution FROM con, (VALUES ('a'), ('c')) AS v(id)"""

ORACLES["audit_trail"] = f"""{with_(RANKED)}
SELECT 'shipments' AS run_id, '2024-01-01 00:00:00' AS at, 'Anomaly Detection' AS step, 'Scan Completed' AS action,
  printf('%s: %.4f to %.4f (%+.1f%%)', 'user_specified', overall_base, overall_anom, {_CHANGE}) AS details, 'COMPLETED' AS status FROM tot
UNION ALL SELECT 'shipments', '2024-01-01 00:00:01', 'Investigation Engine', 'Analysis Completed',
  printf('%d hypotheses tested', count(*)), 'COMPLETED' FROM hyps"""
ORACLES["chart_series"] = f"""{with_(*ORDER_POINTS)},
means AS (SELECT avg(amount) FILTER {B} AS bm, avg(amount) FILTER {A} AS am FROM fact)
SELECT strftime(label, '%Y-%m-%d') AS day, {r('raw', 7)} AS metric_mean, is_anomaly, CASE WHEN is_anomaly THEN severity END AS flag_severity,
  {r('bm')} AS baseline_mean, {r('am')} AS anomaly_mean FROM points CROSS JOIN means"""
ORACLES["chart_histogram"] = f"""{with_(EVENTS)},
e AS (SELECT min(value) AS low, (max(value) - min(value)) / 30.0::DOUBLE AS width FROM fact),
b AS (SELECT period, low, width, least(floor((value - low) / width), 29)::BIGINT AS bin FROM fact CROSS JOIN e WHERE value IS NOT NULL)
SELECT bin, {r('any_value(low + bin * width)')} AS bin_start, count(*) FILTER {B} AS baseline_count, count(*) FILTER {A} AS anomaly_count
FROM b GROUP BY bin"""
ORACLES["chart_box"] = f"""{with_(EVENTS)}
SELECT period, count(value) AS n_values, {r('min(value)')} AS low, {r('quantile_cont(value, 0.25)')} AS q1,
  {r('quantile_cont(value, 0.5)')} AS median, {r('quantile_cont(value, 0.75)')} AS q3, {r('max(value)')} AS high
FROM fact WHERE event_type = 'error' GROUP BY period"""
