"""SQL over the same tables, written independently of the Spark plans, that each query is checked against."""

from __future__ import annotations

import math

from outcome_engine.operators.clv import DEFAULT_SEGMENTS, RULE_SEGMENTS
from outcome_engine.operators.ml import CALIBRATION_EDGES

ORACLE: dict[str, str] = {}

IH = """
ih0 AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS InteractionID, CAST(o_custkey AS VARCHAR) AS SubjectID,
    l_linenumber AS "Rank", p_type AS Issue, 'G' || CAST(l_linenumber % 4 AS VARCHAR) AS "Group",
    p_type || '-offer' AS "Name",
    CASE WHEN l_returnflag = 'R' THEN 'Clicked' WHEN l_returnflag = 'A' THEN 'Impression'
         WHEN l_linestatus = 'F' THEN 'Pending' ELSE 'Conversion' END AS Outcome,
    o_orderpriority AS Channel, c_mktsegment AS CustomerType,
    CASE WHEN l_suppkey % 5 = 0 THEN 'Control' ELSE 'Test' END AS ModelControlGroup,
    p_brand AS ConversionEventID, l_discount * 10 AS Propensity, l_tax * 10 AS FinalPropensity,
    least(1.0::DOUBLE, l_discount * 5 + CASE WHEN l_returnflag = 'R' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) AS SkilledPropensity,
    l_quantity AS "Priority",
    CASE WHEN l_returnflag NOT IN ('R', 'A') AND l_linestatus <> 'F' THEN l_extendedprice * (1 - l_discount)
         ELSE 0.0::DOUBLE END AS Revenue,
    p_type AS ExperimentName, CASE WHEN l_suppkey % 2 = 0 THEN 'Control' ELSE 'Test' END AS ExperimentGroup,
    CASE l_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS ExperimentGroup3,
    o_orderdate AS DecisionTime, l_shipdate AS OutcomeTime
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey),
ih AS (
  SELECT *, Issue || '/' || "Group" || '/' || "Name" AS ActionID, CAST(OutcomeTime AS DATE) AS "Day",
    strftime(OutcomeTime, '%Y-%m') AS "Month", CAST(year(OutcomeTime) AS INTEGER) AS "Year",
    CAST(year(OutcomeTime) AS VARCHAR) || '_Q' || CAST(quarter(OutcomeTime) AS VARCHAR) AS Quarter,
    date_sub('second', DecisionTime, OutcomeTime) AS ResponseTime,
    date_sub('second', DecisionTime, OutcomeTime) / 31536000.0::DOUBLE AS ResponseYears
  FROM ih0)"""


def lab(positive: str, negative: str, name: str = "best", source: str = "ih") -> str:
    return f"""
{name}_all AS (SELECT *, CASE WHEN Outcome IN ({positive}) THEN 1 ELSE 0 END AS label FROM {source}
  WHERE Outcome IN ({positive}, {negative})),
{name} AS (SELECT * FROM {name}_all
  QUALIFY label = max(label) OVER (PARTITION BY InteractionID, ActionID, "Rank"))"""


CLICK = ("'Clicked'", "'Impression', 'Pending'")
BEST = lab(*CLICK)


def counts(keys: str, source: str = "best", where: str = "") -> str:
    return f"""SELECT {keys}, count(*) AS "Count", CAST(sum(label) AS BIGINT) AS Positives,
  CAST(count(*) - sum(label) AS BIGINT) AS Negatives FROM {source} {where} GROUP BY ALL"""


def sums(keys: str, source: str, where: str = "", names=("Count", "Positives", "Negatives")) -> str:
    listed = ", ".join(f'CAST(sum("{n}") AS BIGINT) AS "{n}"' for n in names)
    return f"SELECT {keys}, {listed} FROM {source} {where} GROUP BY ALL"


ENG_KEYS = '"Month", "Year", Quarter, Channel, CustomerType, Issue, ModelControlGroup'
ENG = f"{IH}, {BEST}, eng AS ({counts(ENG_KEYS)})"


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def add(name: str, ctes: str, body: str) -> None:
    ORACLE[name] = with_(ctes, body) if ctes else body


def erfc(x: str) -> str:
    """1 - erf(x) for x >= 0 by Simpson's rule; independent of the approximation under test."""
    n = 2000
    upper = f"least(abs({x}), 7.0::DOUBLE)"
    weights = f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    total = f"list_sum([{weights} * exp(-pow({upper} * i / {n}.0::DOUBLE, 2)) FOR i IN range(0, {n + 1})])"
    return f"(CASE WHEN {x} IS NOT NULL THEN 1 - {2 / math.sqrt(math.pi)!r}::DOUBLE * {upper} / ({n} * 3) * {total} END)"


# ---- sources and sinks ------------------------------------------------------------------------------

add("src_parquet", "", """SELECT o_custkey IS NULL AS no_customer, o_totalprice IS NULL AS no_price, count(*) AS n,
  CAST(sum(o_orderkey) AS BIGINT) AS keys, round(sum(o_totalprice), 2) AS price
FROM (SELECT o_orderkey, o_custkey, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders
  UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders) GROUP BY ALL""")
add("src_hive", "", """SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM events
WHERE event_type IN ('click', 'view') GROUP BY ALL""")
SEGMENTS = "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ALL"
for _name in ("src_ndjson", "src_gzip", "src_archive", "src_csv"):
    add(_name, "", SEGMENTS)
add("src_discover", "", SEGMENTS.replace(" FROM", ", 'json' AS kind FROM"))
add("src_group", "", """SELECT CAST(year(o_orderdate) AS VARCHAR) AS file_group, count(*) AS n,
  round(sum(o_totalprice), 2) AS price FROM orders GROUP BY ALL""")
EVENTS = "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL"
add("src_incremental", "", EVENTS)
add("union_diagonal", "", """SELECT nation, count(*) AS n, count(segment) AS with_segment, count(name) AS with_name,
  round(sum(balance), 2) AS balance FROM (
  SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, NULL AS name FROM customer
  UNION ALL SELECT s_nationkey, s_acctbal, NULL, s_name FROM supplier) GROUP BY ALL""")
add("snk_agg_table", ENG, 'SELECT Channel, CustomerType, CAST(2 * sum("Count") AS BIGINT) AS "Count", '
    "CAST(2 * sum(Positives) AS BIGINT) AS Positives, CAST(2 * sum(Negatives) AS BIGINT) AS Negatives FROM eng GROUP BY ALL")
add("snk_agg_json", ENG + f", a AS ({sums('Channel', 'eng')}), b AS (SELECT Channel, count(\"Priority\") AS sketched_values FROM ih GROUP BY ALL)",
    "SELECT a.*, sketched_values FROM a JOIN b USING (Channel)")

# ---- projections, filters, cleaning -------------------------------------------------------------------

add("prj_drop_technical", "", "SELECT event_id, event_type, value FROM events")
add("prj_canonical_names", "", """SELECT o_orderkey AS OrderKey, o_custkey AS Customer, o_orderstatus AS PyStatus,
  o_orderpriority AS Status, o_totalprice AS TotalPrice FROM orders""")
add("prj_defaults", "", """SELECT coalesce(nullif(event_type, 'error'), 'N/A') AS Kind, 1.5::DOUBLE AS Weight, 'none' AS Source,
  count(*) AS n, round(sum(coalesce(CASE WHEN event_type <> 'view' THEN value END, 0.5::DOUBLE)), 2) AS Value
FROM events GROUP BY ALL""")
add("flt_global", IH, """SELECT Channel, Outcome, count(*) AS n FROM ih
WHERE Outcome IN ('Clicked', 'Conversion') AND Channel IN ('1-URGENT', '2-HIGH') GROUP BY ALL""")
add("flt_metric", f"{IH}, few AS (SELECT * FROM ih WHERE NOT starts_with(ExperimentName, 'ECONOMY')), {lab(*CLICK, source='few')}",
    counts("Issue"))
add("flt_rules", "", """SELECT count(*) FILTER (o_orderstatus = 'F') AS eq, count(*) FILTER (o_orderstatus <> 'F') AS ne,
  count(*) FILTER (o_totalprice > 200000) AS gt, count(*) FILTER (o_totalprice >= 200000) AS ge,
  count(*) FILTER (o_totalprice < 100000.5) AS lt, count(*) FILTER (o_totalprice <= 100000.5) AS le,
  count(*) FILTER (regexp_matches(o_orderpriority, '[12]-')) AS contains,
  count(*) FILTER (starts_with(o_orderpriority, '3-')) AS starts,
  count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS inside,
  count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS outside,
  count(*) FILTER (o_orderstatus = 'P') AS missing, count(*) FILTER (o_orderstatus <> 'P') AS present,
  count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 200000 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS combined
FROM orders""")
add("flt_interactive", IH, """SELECT Channel, CustomerType, count(*) AS n FROM ih
WHERE Channel IN ('1-URGENT', '3-MEDIUM') AND "Priority" BETWEEN 10 AND 40
  AND OutcomeTime BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2000-12-31'
  AND regexp_matches(lower(CustomerType), '^(auto|build)') GROUP BY ALL""")
add("flt_dimension", ENG, sums('Channel, "Year"', "eng", "WHERE Channel IN ('1-URGENT', '5-LOW') AND \"Year\" IN (1997, 1998)"))
add("prj_calculated", IH, """SELECT ResponseTime > 86400 AS Late, count(*) AS n,
  round(sum(CASE WHEN Outcome = 'Conversion' THEN Revenue ELSE 0.0::DOUBLE END), 4) AS Value FROM ih GROUP BY ALL""")
add("prj_time_alias", "", """SELECT CAST(year(o_orderdate) AS INTEGER) AS outcome_year,
  CAST(year(o_orderdate) AS INTEGER) AS decision_year, count(*) AS n FROM orders GROUP BY ALL""")
add("prj_time_parse", "", """SELECT event_type, CAST(sum(epoch_us(ts) // 1000) AS BIGINT) AS strict_millis,
  count(*) FILTER (event_type <> 'error') AS lenient_known FROM events GROUP BY ALL""")
add("prj_action_id", IH, """SELECT nullif(Issue, 'PROMO') || '/' || "Group" || '/' || "Name" AS ActionID, count(*) AS n
FROM ih GROUP BY ALL""")
add("prj_calendar", "", """SELECT CAST(o_orderdate AS DATE) AS "Day", strftime(o_orderdate, '%Y-%m') AS "Month",
  CAST(year(o_orderdate) AS INTEGER) AS "Year",
  CAST(year(o_orderdate) AS VARCHAR) || '_Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS Quarter, count(*) AS n
FROM orders GROUP BY ALL""")
add("prj_response_time", IH, """SELECT Channel, Outcome, CAST(sum(ResponseTime) AS BIGINT) AS total_seconds,
  min(ResponseTime) AS shortest, max(ResponseTime) AS longest FROM ih GROUP BY ALL""")
add("dedup_event", IH + """, one AS (SELECT * FROM ih QUALIFY row_number() OVER (
  PARTITION BY InteractionID, ActionID, "Rank", Outcome ORDER BY SubjectID, Issue, "Group", "Name", Channel, CustomerType,
    ModelControlGroup, ConversionEventID, Propensity, FinalPropensity, SkilledPropensity, "Priority", Revenue,
    ExperimentName, ExperimentGroup, ExperimentGroup3, DecisionTime, OutcomeTime) = 1)""",
    """SELECT Channel, Outcome, ModelControlGroup, count(*) AS n, CAST(sum(CAST("Priority" AS BIGINT)) AS BIGINT) AS priority,
  round(sum(Propensity), 4) AS propensity, round(sum(Revenue), 4) AS revenue FROM one GROUP BY ALL""")

# ---- labels and first-level aggregates ------------------------------------------------------------------

add("lab_restrict", IH, "SELECT Outcome, count(*) AS n FROM ih WHERE Outcome IN ('Clicked', 'Impression', 'Pending') GROUP BY ALL")
add("lab_binary", IH, """SELECT Outcome, CAST(CASE WHEN Outcome IN ('Clicked', 'Conversion') THEN 1 ELSE 0 END AS INTEGER)
  AS Outcome_Binary, count(*) AS n FROM ih GROUP BY ALL""")
add("lab_best_outcome", f"{IH}, {BEST}", """SELECT Outcome, Channel, count(*) AS n,
  CAST(sum(CAST("Priority" AS BIGINT)) AS BIGINT) AS priority FROM best GROUP BY ALL""")
add("lab_group_keys", IH, 'SELECT "Year", Issue, Channel, CustomerType, ModelControlGroup, count(*) AS n FROM ih GROUP BY ALL')
add("eng_agg", f"{IH}, {BEST}", counts(ENG_KEYS))
add("eng_compact", f"{IH}, {BEST}", counts('Issue, Channel, "Year", CustomerType, ModelControlGroup'))

CONV_BEST = lab("'Conversion'", "'Impression'")
TOUCH = """
touch AS (SELECT SubjectID, ConversionEventID, count(*) AS Touchpoints FROM best_all WHERE label = 1 GROUP BY ALL)"""
CONV_KEYS = '"Month", "Year", Quarter, Channel, CustomerType, Issue'
CONV = f"""{IH}, {CONV_BEST}, {TOUCH},
conv AS (SELECT {CONV_KEYS}, count(*) AS "Count", sum(Revenue) AS Revenue,
  CAST(coalesce(sum(Touchpoints), 0) AS BIGINT) AS Touchpoints, CAST(sum(label) AS BIGINT) AS Positives,
  CAST(count(*) - sum(label) AS BIGINT) AS Negatives
  FROM best LEFT JOIN touch USING (SubjectID, ConversionEventID) GROUP BY ALL)"""
CONV_SUMS = """CAST(sum(Negatives) AS BIGINT) AS Negatives, CAST(sum(Positives) AS BIGINT) AS Positives,
  round(sum(Revenue), 4) AS Revenue, CAST(sum("Count") AS BIGINT) AS "Count" """
CONV_ALL = CONV_SUMS + ", CAST(sum(Touchpoints) AS BIGINT) AS Touchpoints"
add("conv_touchpoints", f"{IH}, {CONV_BEST}, {TOUCH}", "SELECT * FROM touch")
add("conv_agg", CONV, "SELECT * REPLACE (round(Revenue, 4) AS Revenue) FROM conv")
add("conv_compact", CONV, f'SELECT Issue, Channel, "Year", CustomerType, {CONV_ALL} FROM conv WHERE Negatives > 0 GROUP BY ALL')

EXP_KEYS = 'Channel, "Year", CustomerType, ExperimentName, ExperimentGroup'
EXP = f"{IH}, {BEST}, expt AS ({counts(EXP_KEYS)})"
EXP3 = f"{IH}, {BEST}, expt AS ({counts(EXP_KEYS + '3')})"
add("exp_agg", f"{IH}, {BEST}", counts(EXP_KEYS))
add("exp_compact", EXP, f"SELECT * FROM ({sums('Channel, ExperimentName, ExperimentGroup', 'expt')}) WHERE Positives > 0 AND Negatives > 0")
add("desc_numeric_select", "", """SELECT l_returnflag, round(avg(l_quantity), 9) AS "l_quantity_Mean",
  round(avg(l_tax), 9) AS "l_tax_Mean" FROM lineitem GROUP BY ALL""")

NUMBERS = ("Propensity", "FinalPropensity", "Priority", "ResponseYears")
SHARES = {"Median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def population_skew(c: str) -> str:
    """The sample-adjusted skewness scaled back to the population form; 0/0 stays NULL."""
    v = f'CAST("{c}" AS DOUBLE)'
    n = f"count({v})"
    return (f"CASE WHEN {n} = 0 OR min({v}) = max({v}) THEN NULL ELSE (sum(pow({v} - __m_{c}, 3)) / {n})"
            f" / nullif(pow(sum(pow({v} - __m_{c}, 2)) / {n}, 1.5), 0) END")


def describe(keys: str, columns=NUMBERS, source: str = "ih", digits: int | None = None, exact: bool = True) -> str:
    def shown(text: str) -> str:
        return text if digits is None else f"round({text}, {digits})"

    items = []
    for c in columns:
        v = f'CAST("{c}" AS DOUBLE)'
        items += [f'count("{c}") AS "{c}_Count"', f'{shown(f"sum({v})")} AS "{c}_Sum"',
                  f'{shown(f"avg({v})")} AS "{c}_Mean"', f'{shown(f"var_samp({v})")} AS "{c}_Var"',
                  f'{shown(f"min({v})")} AS "{c}_Min"', f'{shown(f"max({v})")} AS "{c}_Max"']
        if exact:
            items += [f'{shown(population_skew(c))} AS "{c}_Skew"']
            items += [f'{shown(f"quantile_cont({v}, {p})")} AS "{c}_{n}"' for n, p in SHARES.items()]
    means = ", ".join(f'avg(CAST("{c}" AS DOUBLE)) OVER (PARTITION BY {keys}) AS __m_{c}' for c in columns)
    return (f'SELECT {keys}, count(Outcome) AS "Outcome_Count", {", ".join(items)}\n'
            f"FROM (SELECT *, {means} FROM {source}) GROUP BY ALL")


DESC_KEYS = '"Year", Quarter, Channel, CustomerType, Issue, Outcome'
FINE = f"{IH}, fine AS ({describe(DESC_KEYS)})"


def averaged(c: str, s: str) -> str:
    pair = f'"{c}_{s}" IS NOT NULL'
    return (f'sum("{c}_{s}" * "{c}_Count") / nullif(sum(CASE WHEN {pair} THEN "{c}_Count" END), 0)')


add("desc_agg_exact", IH, describe('"Year", Channel, Outcome', digits=9))
_sketchless = describe(DESC_KEYS, digits=9, exact=False)
ORACLE["desc_agg_sketch"] = with_(f"{IH}, fine AS ({_sketchless})",
                                  'SELECT *, "Propensity_Count" AS "Propensity_n", "Priority_Count" AS "Priority_n" FROM fine')
add("desc_compact_moments", IH, describe("Outcome, Channel", digits=9, exact=False))
add("desc_compact_quantiles_exact", FINE, "SELECT Outcome, Channel, " + ", ".join(
    f'round({averaged(c, s)}, 9) AS "{c}_{s}"' for c in NUMBERS for s in ("Median", "Skew", "p25", "p75", "p90", "p95"))
    + " FROM fine GROUP BY ALL")

add("ml_any_positive", f"{IH}, {BEST}", """SELECT Issue, Outcome, count(*) AS n FROM (SELECT * FROM best_all
  QUALIFY max(label) OVER (PARTITION BY SubjectID, Issue) = 1) GROUP BY ALL""")

MODEL_KEYS = '"Month", "Year", Quarter, Channel, CustomerType'


def model_rows(source: str = "ih") -> str:
    return f"""
rows_all AS (SELECT *, CASE WHEN Outcome IN ({CLICK[0]}) THEN 1 ELSE 0 END AS label FROM {source}
  WHERE Outcome IN ({CLICK[0]}, {CLICK[1]})),
rows_pos AS (SELECT * FROM rows_all QUALIFY max(label) OVER (PARTITION BY {MODEL_KEYS}) = 1),
scored AS (SELECT * FROM rows_pos QUALIFY label = max(label) OVER (PARTITION BY InteractionID, ActionID, "Rank"))"""


SKILLED = 'skilled AS (SELECT * REPLACE (SkilledPropensity AS Propensity) FROM ih)'
MODEL = f"{IH}, {SKILLED}, {model_rows('skilled')}"


def personalization(keys: str, source: str) -> str:
    return f"""
pers_cells AS (SELECT {keys}, SubjectID, "Name", count(*) AS n FROM {source} GROUP BY ALL),
pers_norm AS (SELECT {keys}, SubjectID, sqrt(sum(n * n)) AS norm FROM pers_cells GROUP BY ALL),
pers_items AS (SELECT {keys}, "Name", sum(n / norm) AS s FROM pers_cells JOIN pers_norm USING ({keys}, SubjectID) GROUP BY ALL),
pers_users AS (SELECT {keys}, count(*) AS u FROM pers_norm GROUP BY ALL),
pers AS (SELECT {keys}, CASE WHEN u > 1 THEN 1 - (sum(s * s) - u) / (u * (u - 1.0::DOUBLE)) ELSE 0.0 END AS personalization
  FROM pers_items JOIN pers_users USING ({keys}) GROUP BY {keys}, u)"""


def novelty(keys: str, source: str) -> str:
    return f"""
nov_u AS (SELECT {keys}, count(DISTINCT SubjectID) AS u FROM {source} GROUP BY ALL),
nov_items AS (SELECT {keys}, "Name", count(*) AS n FROM {source} GROUP BY ALL),
nov_len AS (SELECT {keys}, max(n) AS longest FROM (SELECT {keys}, InteractionID, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY ALL),
nov AS (SELECT {keys}, sum(n * -(log2(n / u::DOUBLE) + 1e-10)) / (u * longest) AS novelty
  FROM nov_items JOIN nov_u USING ({keys}) JOIN nov_len USING ({keys}) GROUP BY {keys}, u, longest)"""


YC = '"Year", Channel'
add("ml_personalization", f"{MODEL.replace(SKILLED, SKILLED)}, {personalization(YC, 'scored')}",
    f"SELECT {YC}, round(personalization, 8) AS personalization FROM pers")
add("ml_personalization_full", IH + """,
cells AS (SELECT Channel, SubjectID, "Name", count(*) AS n FROM ih GROUP BY ALL),
norms AS (SELECT Channel, SubjectID, sqrt(sum(n * n)) AS norm FROM cells GROUP BY ALL),
unit AS (SELECT Channel, SubjectID, "Name", n / norm AS w FROM cells JOIN norms USING (Channel, SubjectID)),
pairs AS (SELECT Channel, sum(a.w * b.w) AS similarity FROM unit a JOIN unit b USING (Channel, "Name") GROUP BY ALL),
users AS (SELECT Channel, count(*) AS u FROM norms GROUP BY ALL)""",
    "SELECT Channel, round(1 - (similarity - u) / (u * (u - 1.0::DOUBLE)), 8) AS personalization FROM pairs JOIN users USING (Channel)")
add("ml_novelty", f"{MODEL}, {novelty(YC, 'scored')}", f"SELECT {YC}, round(novelty, 8) AS novelty FROM nov")

BELOW = "CAST(len([i FOR i IN range(0, 101) IF i / 100.0::DOUBLE < Propensity]) AS INTEGER)"
CAL_BELOW = ("CAST(len([e FOR e IN [" + ", ".join(f"{e!r}::DOUBLE" for e in CALIBRATION_EDGES)
             + "] IF e < Propensity]) AS INTEGER)")


def bins(keys: str) -> str:
    return f"""
binned AS (SELECT {keys}, {BELOW} AS bin, {CAL_BELOW} AS cal_bin, label, Propensity FROM scored),
bins AS (SELECT {keys}, bin, cal_bin, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg,
  sum(Propensity) AS score_sum FROM binned GROUP BY ALL)"""


def curves(keys: str, source: str = "scored") -> str:
    """From the rows themselves: rates above each threshold with both ends of the curve (points 0 and 102), area by rank sums."""
    return f"""
score_values AS (SELECT {keys}, Propensity AS s, sum(label) AS pos, sum(1 - label) AS neg FROM {source} WHERE Propensity IS NOT NULL GROUP BY ALL),
totals AS (SELECT {keys}, sum(pos) AS p, sum(neg) AS n FROM score_values GROUP BY ALL),
ranked AS (SELECT *, sum(neg) OVER (PARTITION BY {keys} ORDER BY s) - neg AS neg_below FROM score_values),
rank_sums AS (SELECT {keys}, sum(pos * (neg_below + neg / 2.0::DOUBLE)) AS won FROM ranked GROUP BY ALL),
rates AS (SELECT {keys}, CAST(t.point AS INTEGER) AS point, any_value(p) AS p, any_value(n) AS n,
  coalesce(sum(pos) FILTER (t.point = 102 OR t.point > 0 AND s > (101 - t.point) / 100.0::DOUBLE), 0) / any_value(p)::DOUBLE AS tpr,
  coalesce(sum(neg) FILTER (t.point = 102 OR t.point > 0 AND s > (101 - t.point) / 100.0::DOUBLE), 0) / any_value(n)::DOUBLE AS fpr
  FROM score_values JOIN totals USING ({keys}) CROSS JOIN range(0, 103) t(point) GROUP BY {keys}, t.point),
sharp AS (SELECT *, p * tpr / (p * tpr + n * fpr + 1e-10) AS raw FROM rates),
curve AS (SELECT *, max(raw) OVER (PARTITION BY {keys} ORDER BY point ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS prec,
  lag(tpr) OVER (PARTITION BY {keys} ORDER BY point) AS tpr0 FROM sharp),
area AS (SELECT {keys},
  CASE WHEN any_value(p) = 0 OR any_value(n) = 0 THEN 0.0 ELSE any_value(won) / (any_value(p) * any_value(n)::DOUBLE) END AS roc_auc,
  CASE WHEN any_value(p) = 0 OR any_value(n) = 0 THEN 0.0 ELSE sum((tpr - tpr0) * prec) END AS average_precision,
  CASE WHEN any_value(p) = 0 OR any_value(n) = 0 THEN 0.0 ELSE any_value(p) / (any_value(p) + any_value(n)::DOUBLE) END AS pos_fraction
  FROM curve JOIN rank_sums USING ({keys}) GROUP BY {keys})"""


add("ml_agg_sketch", f"{MODEL}, {bins('Channel, CustomerType')}", "SELECT * REPLACE (round(score_sum, 4) AS score_sum) FROM bins")
add("ml_agg_exact", f"""{MODEL},
vals AS (SELECT {YC}, Propensity, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY ALL),
cum AS (SELECT *, sum(neg) OVER (PARTITION BY {YC} ORDER BY Propensity) - neg AS neg_below,
  sum(pos) OVER (PARTITION BY {YC} ORDER BY Propensity DESC) AS pos_up,
  sum(pos + neg) OVER (PARTITION BY {YC} ORDER BY Propensity DESC) AS all_up FROM vals)""",
    f"""SELECT {YC}, round(sum(pos * (neg_below + neg / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg)::DOUBLE, 0), 8) AS roc_auc,
  round(sum(pos * pos_up / all_up::DOUBLE) / nullif(sum(pos), 0)::DOUBLE, 8) AS average_precision FROM cum GROUP BY ALL""")
FINE_MODEL = f"""{MODEL}, {personalization(MODEL_KEYS, 'scored')}, {novelty(MODEL_KEYS, 'scored')},
fine_counts AS (SELECT {MODEL_KEYS}, count(*) AS "Count" FROM scored GROUP BY ALL),
fine_model AS (SELECT * FROM fine_counts JOIN pers USING ({MODEL_KEYS}) JOIN nov USING ({MODEL_KEYS}))"""


def weighted_model(keys: str) -> str:
    return f"""SELECT {keys}, round(sum(personalization * "Count") / sum("Count"), 8) AS personalization,
  round(sum(novelty * "Count") / sum("Count"), 8) AS novelty, CAST(sum("Count") AS BIGINT) AS "Count"
  FROM fine_model GROUP BY ALL"""


add("ml_compact", FINE_MODEL, weighted_model('Channel, "Year"'))

HOLD = """
hold AS (SELECT CAST(o_custkey AS VARCHAR) AS CustomerID, CAST(o_orderkey AS VARCHAR) AS HoldingID,
  o_orderdate AS PurchasedDateTime, o_totalprice AS OneTimeCost, c_mktsegment AS ControlGroup,
  o_totalprice / 100 AS RecurringCost, 1 + o_orderkey % 12 AS RecurringPeriod
  FROM orders JOIN customer ON o_custkey = c_custkey),
recent AS (SELECT *, CAST(year(PurchasedDateTime) AS VARCHAR) AS "Year",
  CAST(year(PurchasedDateTime) AS VARCHAR) || '_Q' || CAST(quarter(PurchasedDateTime) AS VARCHAR) AS Quarter
  FROM hold WHERE PurchasedDateTime > TIMESTAMP '2002-01-01' - INTERVAL 9 YEAR)"""
CLV_BODY = """count(DISTINCT HoldingID) AS unique_holdings, round({value}, 4) AS lifetime_value,
  strftime(min(PurchasedDateTime), '%Y-%m-%d') AS MinPurchasedDate,
  strftime(max(PurchasedDateTime), '%Y-%m-%d') AS MaxPurchasedDate"""
add("clv_agg", HOLD, f"""SELECT ControlGroup, CustomerID, "Year", Quarter, {CLV_BODY.format(value='sum(OneTimeCost)')}
FROM recent GROUP BY ALL""")
add("clv_contractual", HOLD, f"""SELECT CustomerID, "Year", Quarter,
  {CLV_BODY.format(value='sum(OneTimeCost) + sum(RecurringCost * RecurringPeriod)')},
  round(sum(RecurringCost * RecurringPeriod), 4) AS recurring_costs FROM recent GROUP BY ALL""")
add("merge_loads", f"""{IH}, early AS (SELECT * FROM ih WHERE "Year" < 1998), late AS (SELECT * FROM ih WHERE "Year" >= 1998),
{lab(*CLICK, name='a', source='early')}, {lab(*CLICK, name='b', source='late')},
both_loads AS (SELECT Issue, Channel, ModelControlGroup, label FROM a UNION ALL SELECT Issue, Channel, ModelControlGroup, label FROM b)""",
    counts("Issue, Channel, ModelControlGroup", "both_loads"))
add("weighted_mean", "", """SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS mean_discount
FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL""")

# ---- report scores --------------------------------------------------------------------------------------------


def engagement(keys: str, source: str = "eng", digits: int = 7, prefix: str = "") -> str:
    """CTEs ending in {prefix}scored_eng."""
    select = f"{keys}, " if keys else ""
    group = "GROUP BY ALL" if keys else ""
    arm = "ModelControlGroup = 'Control'"
    return f"""
{prefix}arms AS (SELECT {select}sum(Negatives) AS n, sum(Positives) AS p, sum("Count") AS c,
  sum(Positives) FILTER ({arm}) AS p_c, sum(Negatives) FILTER ({arm}) AS n_c,
  sum(Positives) FILTER (NOT {arm}) AS p_t, sum(Negatives) FILTER (NOT {arm}) AS n_t
  FROM {source} WHERE Negatives > 0 {group}),
{prefix}both_arms AS (SELECT * REPLACE (coalesce(p_c, p_t)::DOUBLE AS p_c, coalesce(n_c, n_t)::DOUBLE AS n_c,
  coalesce(p_t, p_c)::DOUBLE AS p_t, coalesce(n_t, n_c)::DOUBLE AS n_t) FROM {prefix}arms),
{prefix}rated AS (SELECT *, p / (p + n)::DOUBLE AS ctr, p_t / (p_t + n_t) AS r_t, p_c / (p_c + n_c) AS r_c,
  (p_t + p_c) / nullif(n_t + n_c, 0) AS pooled, (p_t = 0 OR p_c = 0 OR n_t = 0 OR n_c = 0) AS none FROM {prefix}both_arms),
{prefix}tested AS (SELECT *, CASE WHEN none THEN 0.0 WHEN pooled * (1 - pooled) > 0 THEN (p_t / n_t - p_c / n_c)
  / sqrt(pooled * (1 - pooled) * (1 / n_t + 1 / n_c)) END AS z FROM {prefix}rated),
{prefix}scored_eng AS (SELECT {select}CAST(n AS BIGINT) AS Negatives, CAST(p AS BIGINT) AS Positives, CAST(c AS BIGINT) AS "Count",
  round(coalesce((r_t - r_c) / nullif(r_c, 0), 0), {digits}) AS Lift, round(ctr, {digits}) AS CTR,
  round(sqrt(ctr * (1 - ctr) / (p + n)), {digits}) AS StdErr, round(z, {digits}) AS Lift_Z_Score,
  round(CASE WHEN none THEN 0.0 ELSE {erfc('z / sqrt(2)')} END, {digits}) AS Lift_P_Val FROM {prefix}tested)"""


for _name, _keys in {"rpt_route": "CustomerType", "rpt_eng": 'Channel, "Month"', "tab_polar": "Issue, Channel",
                     "tab_line": '"Month", CustomerType, Channel'}.items():
    add(_name, f"{ENG}, {engagement(_keys)}", "SELECT * FROM scored_eng")
add("kpi_engagement", f"""{ENG}, {engagement('"Month"')}, {engagement('', prefix='o_')}""",
    """SELECT "Month", CTR, Lift, Lift_P_Val FROM scored_eng
UNION ALL SELECT 'ALL', CTR, Lift, Lift_P_Val FROM o_scored_eng""")


def conversion(keys: str) -> str:
    select = f"{keys}, " if keys else ""
    return f"""SELECT {select}{CONV_ALL}, round(sum(Positives) / (sum(Positives) + sum(Negatives))::DOUBLE, 8) AS ConversionRate,
  round(sum(Touchpoints) / nullif(sum(Positives), 0)::DOUBLE, 8) AS AvgTouchpoints,
  round(sqrt(sum(Positives)::DOUBLE * sum(Negatives) / pow((sum(Positives) + sum(Negatives))::DOUBLE, 3)), 8) AS StdErr
  FROM conv {'GROUP BY ALL' if keys else ''}"""


add("rpt_conv", CONV, conversion("Channel, Issue"))
add("tab_heatmap", f"{CONV}, c AS ({conversion('Channel, CustomerType')})", "SELECT Channel, " + ", ".join(
    f"coalesce(max(ConversionRate) FILTER (CustomerType = '{t}'), 0) AS {t}"
    for t in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM c GROUP BY ALL")
KPI_CONV = f"""{CONV}, months AS ({conversion('"Month"')}), whole AS ({conversion('')})"""
add("kpi_conversion", KPI_CONV, """SELECT "Month", ConversionRate, Revenue FROM months
UNION ALL SELECT 'ALL', ConversionRate, Revenue FROM whole""")
add("kpi_touchpoints", KPI_CONV, """SELECT "Month", Positives, AvgTouchpoints FROM months
UNION ALL SELECT 'ALL', Positives, AvgTouchpoints FROM whole""")


def experiment(keys: str, arm: str = "ExperimentGroup", digits: int = 7) -> str:
    """CTEs ending in tests: the contingency tables are k x 2, arms in descending order."""
    return f"""
armed AS (SELECT * FROM ({sums(f'{keys}, {arm} AS arm', 'expt')}) WHERE Positives > 0 AND Negatives > 0),
cells AS (SELECT *, sum(Positives) OVER w AS tp, sum(Negatives) OVER w AS tn,
  row_number() OVER (PARTITION BY {keys} ORDER BY arm DESC) AS pos FROM armed WINDOW w AS (PARTITION BY {keys})),
expected AS (SELECT *, (Positives + Negatives) * tp / (tp + tn)::DOUBLE AS ep, (Positives + Negatives) * tn / (tp + tn)::DOUBLE AS en FROM cells),
stat AS (SELECT {keys}, sum(pow(Positives - ep, 2) / ep + pow(Negatives - en, 2) / en) AS chi2,
  2 * sum(Positives * ln(Positives / ep) + Negatives * ln(Negatives / en)) AS g, count(*) - 1 AS dof,
  max(Positives) FILTER (pos = 1)::DOUBLE AS p1, max(Positives) FILTER (pos = 2)::DOUBLE AS p2,
  max(Negatives) FILTER (pos = 1)::DOUBLE AS n1, max(Negatives) FILTER (pos = 2)::DOUBLE AS n2,
  max("Count") FILTER (pos = 1)::DOUBLE AS c1, max("Count") FILTER (pos = 2)::DOUBLE AS c2,
  CAST(sum("Count") AS BIGINT) AS "Count", CAST(sum(Positives) AS BIGINT) AS Positives, CAST(sum(Negatives) AS BIGINT) AS Negatives
  FROM expected GROUP BY {keys}),
ready AS (SELECT *, dof = 1 AS two, (p1 * n2) / (p2 * n1) AS odds, sqrt(1 / p1 + 1 / p2 + 1 / n1 + 1 / n2) AS se,
  (p1 + p2) / (c1 + c2) AS pooled FROM stat),
ztested AS (SELECT *, CASE WHEN two THEN (p1 / c1 - p2 / c2) / sqrt(pooled * (1 - pooled) * (1 / c1 + 1 / c2)) ELSE 0.0 END AS z FROM ready),
tests AS (SELECT {keys}, round(chi2, {digits}) AS chi2_stat, CAST(dof AS INTEGER) AS chi2_dof, {survival('chi2', digits)} AS chi2_p_val,
  {odds('chi2', digits)}, round(g, {digits}) AS g_stat, CAST(dof AS INTEGER) AS g_dof, {survival('g', digits)} AS g_p_val, {odds('g', digits)},
  round(z, {digits}) AS z_score, round(CASE WHEN two THEN {erfc('z / sqrt(2)')} ELSE 0.0 END, {digits}) AS z_p_val,
  "Count", Positives, Negatives FROM ztested)"""


def survival(x: str, digits: int) -> str:
    """Up to three arms occur, so dof is 0, 1 or 2."""
    return (f"round(CASE dof WHEN 0 THEN 1.0 WHEN 1 THEN {erfc(f'sqrt(greatest({x}, 0) / 2)')} "
            f"ELSE exp(-{x} / 2) END, {digits})")


def odds(test: str, digits: int) -> str:
    z = "1.959963984540054::DOUBLE"
    return (f"round(CASE WHEN two THEN odds ELSE 0.0 END, {digits}) AS {test}_odds_ratio_stat, "
            f"round(CASE WHEN two THEN exp(ln(odds) - {z} * se) ELSE 0.0 END, {digits}) AS {test}_odds_ratio_ci_low, "
            f"round(CASE WHEN two THEN exp(ln(odds) + {z} * se) ELSE 0.0 END, {digits}) AS {test}_odds_ratio_ci_high")


EXP_TESTS = f"{EXP}, {experiment('ExperimentName, Channel')}"
add("rpt_exp", EXP_TESTS, "SELECT * FROM tests")
add("rpt_exp_arms", f"{EXP3}, {experiment('ExperimentName, Channel', 'ExperimentGroup3')}", "SELECT * FROM tests")
YEARLY3 = f"{EXP3}, {experiment('Channel, \"Year\"', 'ExperimentGroup3', 6)}"
add("stat_chi2", YEARLY3, 'SELECT Channel, "Year", chi2_stat, chi2_dof, chi2_p_val FROM tests')
add("stat_gtest", YEARLY3, 'SELECT Channel, "Year", g_stat, g_dof, g_p_val FROM tests')
add("stat_ztest_table", f"{EXP}, {experiment('Channel, \"Year\"')}", 'SELECT Channel, "Year", z_score, z_p_val FROM tests')
add("stat_odds_ratio", f"{EXP}, {experiment('ExperimentName')}",
    "SELECT ExperimentName, g_odds_ratio_stat, g_odds_ratio_ci_low, g_odds_ratio_ci_high FROM tests")
add("tab_exp_bars", EXP_TESTS, "SELECT ExperimentName, Channel, chi2_stat FROM tests")
add("tab_odds", EXP_TESTS.replace("tests AS (SELECT", "raw_tests AS (SELECT *, exp(ln(odds) - 1.959963984540054::DOUBLE * se) AS lo, "
                                  "exp(ln(odds) + 1.959963984540054::DOUBLE * se) AS hi FROM ztested WHERE two), tests AS (SELECT"),
    """SELECT ExperimentName, Channel, round(odds, 7) AS g_odds_ratio_stat, round(hi - odds, 7) AS x_plus, round(odds - lo, 7) AS x_minus,
  CASE WHEN hi < 1 AND lo < 1 THEN 'Control' WHEN hi > 1 AND lo > 1 THEN 'Test' ELSE 'N/A' END AS winner FROM raw_tests""")

RPT_ML_KEYS = 'Channel, "Year"'
add("rpt_ml", f"{FINE_MODEL}, {curves(RPT_ML_KEYS)}, w AS ({weighted_model(RPT_ML_KEYS)})",
    f"""SELECT w.*, round(roc_auc, 8) AS roc_auc, round(average_precision, 8) AS average_precision,
  round(pos_fraction, 8) AS pos_fraction FROM w JOIN area USING ({RPT_ML_KEYS})""")
add("grp_ml", FINE_MODEL, weighted_model('Quarter, Channel, "Year", CustomerType'))
add("rpt_desc_exact", FINE, "SELECT Channel, " + ", ".join(
    ['CAST(sum("Outcome_Count") AS BIGINT) AS "Outcome_Count"'] + [part for c in NUMBERS for part in (
        f'CAST(sum("{c}_Count") AS BIGINT) AS "{c}_Count"', f'round(sum("{c}_Sum"), 9) AS "{c}_Sum"',
        f'round(min("{c}_Min"), 9) AS "{c}_Min"', f'round(max("{c}_Max"), 9) AS "{c}_Max"',
        *[f'round({averaged(c, s)}, 9) AS "{c}_{s}"' for s in ("Median", "Skew", "p25", "p75", "p90", "p95")],
        f'round(any_value("v_{c}"."{c}_Mean"), 9) AS "{c}_Mean"', f'round(any_value("v_{c}"."{c}_Var"), 9) AS "{c}_Var"',
        f'round(sqrt(any_value("v_{c}"."{c}_Var")), 9) AS "{c}_Std"')])
    + " FROM fine " + " ".join(
        f'JOIN (SELECT Channel, avg(CAST("{c}" AS DOUBLE)) AS "{c}_Mean", var_samp(CAST("{c}" AS DOUBLE)) AS "{c}_Var" '
        f'FROM ih GROUP BY ALL) "v_{c}" USING (Channel)' for c in NUMBERS).replace('"c_', '"c_') + " GROUP BY Channel")
add("grp_eng", ENG, sums('Issue, Channel, "Year", CustomerType, ModelControlGroup', "eng"))
add("grp_conv", CONV, f'SELECT Issue, Channel, "Year", CustomerType, {CONV_SUMS} FROM conv WHERE Negatives > 0 GROUP BY ALL')
add("grp_exp", EXP, f"SELECT * FROM ({sums(EXP_KEYS, 'expt')}) WHERE Positives > 0 AND Negatives > 0")
add("grp_desc", IH, describe('"Year", Channel', ("Priority",), digits=7))

FEATURES = f"""{HOLD},
cust AS (SELECT ControlGroup, CustomerID, count(DISTINCT HoldingID) AS unique_holdings, round(sum(OneTimeCost), 2) AS lifetime_value,
  min(PurchasedDateTime) AS first_at, max(PurchasedDateTime) AS last_at FROM recent GROUP BY ALL),
features AS (SELECT ControlGroup, CustomerID, 1::BIGINT AS customers_count, CAST(unique_holdings AS BIGINT) AS unique_holdings,
  lifetime_value, CAST(unique_holdings - 1 AS BIGINT) AS frequency,
  CAST(date_sub('day', first_at, (SELECT max(last_at) FROM cust)) - date_sub('day', first_at, last_at) AS DOUBLE) AS recency,
  CAST(date_sub('day', first_at, (SELECT max(last_at) FROM cust)) AS DOUBLE) AS tenure,
  CASE WHEN unique_holdings = 1 THEN 0.0 ELSE lifetime_value / unique_holdings END AS monetary_value FROM cust)"""


def quartile(c: str, reverse: bool = False) -> str:
    steps = " + ".join(f"CASE WHEN {c} > (SELECT quantile_cont({c}::DOUBLE, {p}) FROM features) THEN 1 ELSE 0 END" for p in (0.25, 0.5, 0.75))
    return f"CAST({'4 - (' if reverse else '1 + ('}{steps}) AS VARCHAR)"


def segment(name: str | None) -> str:
    if name:
        champion, loyal, potential, risk, dormant = RULE_SEGMENTS[name]
        r, f, m = "r_quartile", "f_quartile", "m_quartile"
        return (f"CASE WHEN {r} <= '2' AND {f} >= '2' AND {m} >= '2' THEN '{risk}' WHEN {r} || {f} || {m} = '444' THEN '{champion}' "
                f"WHEN {r} >= '2' AND {f} >= '3' AND {m} >= '2' THEN '{loyal}' "
                f"WHEN {r} >= '3' AND {f} >= '2' AND {m} >= '2' THEN '{potential}' ELSE '{dormant}' END")
    branches = " ".join("WHEN r_quartile || f_quartile || m_quartile IN ({}) THEN '{}'".format(
        ", ".join(f"'{c}'" for c in codes), n) for n, codes in DEFAULT_SEGMENTS.items())
    return f"CASE {branches} ELSE 'Unknown' END"


RFM = f"""{FEATURES},
quart AS (SELECT *, {quartile('frequency')} AS f_quartile, {quartile('monetary_value')} AS m_quartile,
  {quartile('recency', True)} AS r_quartile FROM features),
rfm AS (SELECT *, {segment('retail_banking')} AS rfm_segment,
  round((r_quartile::INTEGER + f_quartile::INTEGER + m_quartile::INTEGER) / 3.0::DOUBLE, 2) AS rfm_score FROM quart)"""
MONEY = "REPLACE (round(lifetime_value, 6) AS lifetime_value, round(monetary_value, 6) AS monetary_value)"
add("rfm_features", FEATURES, f"SELECT * {MONEY} FROM features")
add("rfm_quartiles", RFM, f"SELECT * {MONEY} FROM quart")
for _name in ("rpt_clv", "snk_rfm_csv"):
    add(_name, RFM, f"SELECT * {MONEY} FROM rfm")
add("rfm_segment", RFM, f"""SELECT CustomerID, {segment(None)} AS "default", {segment('retail_banking')} AS retail_banking,
  {segment('telco')} AS telco, {segment('e-commerce')} AS ecommerce FROM quart""")
add("rfm_score", RFM, "SELECT rfm_score, count(*) AS n FROM rfm GROUP BY ALL")

# ---- statistics -------------------------------------------------------------------------------------------------

TWO_ARMS = f"""{ENG}, two_arms AS (SELECT "Month",
  coalesce(sum(Positives) FILTER (ModelControlGroup <> 'Control'), 0)::DOUBLE AS tp, coalesce(sum("Count") FILTER (ModelControlGroup <> 'Control'), 0)::DOUBLE AS tn,
  coalesce(sum(Positives) FILTER (ModelControlGroup = 'Control'), 0)::DOUBLE AS cp, coalesce(sum("Count") FILTER (ModelControlGroup = 'Control'), 0)::DOUBLE AS cn
  FROM eng GROUP BY ALL),
pooled_arms AS (SELECT *, (tp + cp) / nullif(tn + cn, 0) AS q, (tp = 0 OR cp = 0 OR tn = 0 OR cn = 0) AS none FROM two_arms),
z_arms AS (SELECT *, CASE WHEN none THEN 0.0 WHEN q * (1 - q) > 0 THEN (tp / tn - cp / cn) / sqrt(q * (1 - q) * (1 / tn + 1 / cn)) END AS z,
  CASE WHEN none THEN 0.0 ELSE 2 * (tp * ln(tp / (tn * q)) + cp * ln(cp / (cn * q))
    + CASE WHEN tn > tp THEN (tn - tp) * ln((tn - tp) / (tn * (1 - q))) ELSE 0 END
    + CASE WHEN cn > cp THEN (cn - cp) * ln((cn - cp) / (cn * (1 - q))) ELSE 0 END) END AS g FROM pooled_arms)"""
add("stat_ztest_prop", TWO_ARMS, f"""SELECT "Month", round(z, 7) AS z_score, round(CASE WHEN none THEN 0.0 ELSE {erfc('z / sqrt(2)')} END, 7) AS p_two,
  round(CASE WHEN none THEN 0.0 ELSE {erfc('z / sqrt(2)')} / 2 END, 7) AS p_one FROM z_arms""")
add("stat_gtest_prop", TWO_ARMS, f"""SELECT "Month", round(g, 6) AS g_stat,
  round(CASE WHEN none THEN 0.0 ELSE {erfc('sqrt(greatest(g, 0) / 2)')} END, 6) AS g_p_val FROM z_arms""")
for _name in ("sk_build", "sk_merge"):
    add(_name, IH, 'SELECT Channel, count("Priority") AS n FROM ih GROUP BY ALL')
add("rpt_desc_merge", IH, "SELECT Channel, " + ", ".join(f'count("{c}") AS "{c}_n"' for c in NUMBERS) + " FROM ih GROUP BY ALL")

BY_TYPE = f"{MODEL}, {curves('CustomerType')}"
add("ml_roc_pr", BY_TYPE, """SELECT CustomerType, round(roc_auc, 8) AS roc_auc, round(average_precision, 8) AS average_precision,
  round(pos_fraction, 8) AS pos_fraction FROM area""")


def calibration(keys: str) -> str:
    """From the rows themselves: the first bin is closed on the left, the last takes all above."""
    groups = f"SELECT DISTINCT {keys} FROM scored" if keys else "SELECT 1 AS one"
    on = " AND ".join([f"g.{k} = b.{k}" for k in ([keys] if keys else [])] + ["b.cal_bin = e.cal_bin"])
    edges = ", ".join(f"({i + 1}, {(a + b) / 2!r}::DOUBLE)" for i, (a, b) in enumerate(zip(CALIBRATION_EDGES, CALIBRATION_EDGES[1:])))
    case = "CASE " + " ".join(f"WHEN Propensity <= {e!r}::DOUBLE THEN {i + 1}" for i, e in enumerate(CALIBRATION_EDGES[1:-1])) + f" ELSE {len(CALIBRATION_EDGES) - 1} END"
    return f"""SELECT {f'g.{keys}, ' if keys else ''}CAST(e.cal_bin AS INTEGER) AS cal_bin, round(any_value(e.centre), 8) AS calibration_bin,
  round(coalesce(avg(Propensity), any_value(e.centre)), 8) AS calibration_proba,
  round(coalesce(avg(label::DOUBLE), 0), 8) AS calibration_rate, count(Propensity) AS n
  FROM ({groups}) g CROSS JOIN (VALUES {edges}) e(cal_bin, centre)
  LEFT JOIN (SELECT *, {case} AS cal_bin FROM scored WHERE Propensity IS NOT NULL) b ON {on} GROUP BY {f'g.{keys}, ' if keys else ''}e.cal_bin"""


add("ml_calibration", MODEL, calibration("CustomerType"))
add("tab_calibration", MODEL, calibration("").replace(
    "SELECT CAST(e.cal_bin", "SELECT 'ALL' AS \"ALL\", CAST(e.cal_bin"))

add("src_sample", "", "SELECT * FROM customer ORDER BY md5('42|' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 1000")

# ---- report tables ------------------------------------------------------------------------------------------------

add("tab_treemap", ENG, """SELECT concat_ws('/', 'ALL', CASE WHEN grouping(Channel) = 0 THEN Channel END,
    CASE WHEN grouping(CustomerType) = 0 THEN CustomerType END, CASE WHEN grouping(Issue) = 0 THEN Issue END) AS path,
  CAST(3 - grouping(Channel) - grouping(CustomerType) - grouping(Issue) AS INTEGER) AS level, Channel, CustomerType, Issue,
  CAST(sum("Count") AS BIGINT) AS "Count", CAST(sum(Positives) AS BIGINT) AS Positives, CAST(sum(Negatives) AS BIGINT) AS Negatives,
  round(sum(Positives) / (sum(Positives) + sum(Negatives))::DOUBLE, 8) AS CTR,
  round(sqrt(sum(Positives)::DOUBLE * sum(Negatives) / pow((sum(Positives) + sum(Negatives))::DOUBLE, 3)), 8) AS StdErr
FROM eng WHERE Negatives > 0 GROUP BY ROLLUP (Channel, CustomerType, Issue)""")
add("tab_scatter", f"""{ENG}, {engagement('"Month", Channel', digits=15)}""", """SELECT "Month", Channel, round(CTR, 7) AS CTR, round(Lift, 7) AS Lift, "Count",
  round(min(CTR) OVER (), 7) AS x_min, round(max(CTR) OVER (), 7) AS x_max, round(min(Lift) OVER (), 7) AS y_min, round(max(Lift) OVER (), 7) AS y_max
FROM scored_eng""")
_ref = ("CASE Channel || '_' || CustomerType WHEN '1-URGENT_AUTOMOBILE' THEN 0.4::DOUBLE WHEN '1-URGENT_BUILDING' THEN 0.6::DOUBLE "
        "WHEN '2-HIGH_FURNITURE' THEN 0.3::DOUBLE WHEN '5-LOW_HOUSEHOLD' THEN 0.42::DOUBLE END")
add("tab_gauge", f"{ENG}, {engagement('Channel, CustomerType', digits=15)}", f"""SELECT Channel, CustomerType, Channel || '_' || CustomerType AS key,
  round(CTR, 8) AS CTR, {_ref} AS reference, round(CTR - {_ref}, 8) AS delta,
  CASE WHEN {_ref} IS NULL THEN 'none' WHEN CTR < 0.75 * {_ref} THEN 'low' WHEN CTR < {_ref} THEN 'warn' ELSE 'ok' END AS status,
  round(1.1 * max(CTR) OVER (PARTITION BY Channel), 8) AS axis_max FROM scored_eng""")
add("tab_cards", ENG, """SELECT CustomerType, CAST(sum(Positives) AS BIGINT) AS Positives, CAST(sum(Negatives) AS BIGINT) AS Negatives,
  round(sum(Positives) / (sum(Positives) + sum(Negatives))::DOUBLE, 8) AS CTR,
  round(sum(Positives) / (sum(Positives) + sum(Negatives))::DOUBLE
    - (SELECT sum(Positives) / (sum(Positives) + sum(Negatives))::DOUBLE FROM eng), 8) AS delta FROM eng GROUP BY ALL""")
add("kpi_ml", f"""{FINE_MODEL},
scored_both AS (SELECT "Month", label, Propensity FROM scored UNION ALL SELECT 'ALL', label, Propensity FROM scored), {curves('"Month"', 'scored_both')},
w AS ({weighted_model('"Month"')} UNION ALL {weighted_model("'ALL'").replace("SELECT 'ALL',", "SELECT 'ALL' AS mm,")})""",
    """SELECT "Month", round(roc_auc, 8) AS roc_auc, round(average_precision, 8) AS average_precision, personalization, novelty
FROM area JOIN w USING ("Month")""")
add("kpi_clv", f"""{RFM}, yearly AS (SELECT "Year", sum(OneTimeCost) / count(DISTINCT CustomerID) AS average_value FROM recent GROUP BY ALL),
ordered AS (SELECT *, lag(average_value) OVER (ORDER BY "Year") AS earlier, row_number() OVER (ORDER BY "Year" DESC) AS back, count(*) OVER () AS years FROM yearly)""",
    """SELECT "Year", round(average_value, 6) AS average_value, round(CASE WHEN back < 3 THEN (average_value - earlier) / earlier END, 6) AS yoy,
  (SELECT count(DISTINCT CustomerID) FROM rfm) AS unique_customers, round((SELECT sum(lifetime_value) FROM rfm), 2) AS total_value
FROM ordered WHERE back <= 3 AND years >= 3""")
add("tab_boxplot", FINE + f""", box AS (SELECT Channel, {averaged('Priority', 'p25')} AS q1, {averaged('Priority', 'Median')} AS median,
  {averaged('Priority', 'p75')} AS q3, min("Priority_Min") AS lo, max("Priority_Max") AS hi, sum("Priority_Count") AS n FROM fine GROUP BY ALL),
raw AS (SELECT Channel, avg("Priority") AS mean, stddev_samp("Priority") AS sd FROM ih GROUP BY ALL)""",
    """SELECT Channel, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3, round(mean, 9) AS mean, round(sd, 9) AS sd,
  round(greatest(lo, q1 - 1.5 * (q3 - q1)), 9) AS lower_fence, round(least(hi, q3 + 1.5 * (q3 - q1)), 9) AS upper_fence,
  round(1.57 * (q3 - q1) / sqrt(n), 9) AS notch FROM box JOIN raw USING (Channel)""")
add("tab_funnel", IH, """SELECT Channel, CustomerType, Stage, count(*) FILTER (Outcome = Stage) AS "Count"
FROM ih CROSS JOIN (VALUES ('Pending'), ('Impression'), ('Clicked'), ('Conversion')) s(Stage) GROUP BY ALL""")
add("tab_curves", BY_TYPE, """SELECT CustomerType, point, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr, round(tpr, 8) AS recall,
  round(prec, 8) AS precision FROM curve""")
GAIN = "p / (p + n)::DOUBLE * tpr + (1 - p / (p + n)::DOUBLE) * fpr"
add("tab_gain", BY_TYPE, f"SELECT CustomerType, point, round({GAIN}, 8) AS sample_fraction, round(tpr, 8) AS gain FROM curve")
add("tab_lift", f"""{MODEL}, scored_all AS (SELECT 'ALL' AS every, * FROM scored), {curves('every', 'scored_all')}""", f"""SELECT every AS "ALL", point, round({GAIN}, 8) AS sample_fraction,
  round(CASE WHEN {GAIN} > 1e-6 THEN tpr / ({GAIN}) ELSE 0.0 END, 8) AS lift FROM curve""")

# ---- customer value -----------------------------------------------------------------------------------------------

add("clv_hist", f"""{RFM}, span AS (SELECT min(tenure) AS lo, max(tenure) AS hi FROM rfm),
placed AS (SELECT ControlGroup, CAST(least(floor((tenure - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, lo, hi FROM rfm CROSS JOIN span),
hist AS (SELECT ControlGroup, bin, lo, hi, count(*) AS n FROM placed GROUP BY ALL)""",
    """SELECT ControlGroup, bin, round(lo + bin * (hi - lo) / 20, 6) AS "left", round(lo + (bin + 1) * (hi - lo) / 20, 6) AS "right",
  round(sum(100.0::DOUBLE * n) OVER (PARTITION BY ControlGroup ORDER BY bin) / sum(n) OVER (PARTITION BY ControlGroup), 6) AS value FROM hist""")


def segments(keys: str, money: int, average: int) -> str:
    return f"""SELECT rfm_segment, {keys} CAST(sum(customers_count) AS BIGINT) AS customers_count, round(sum(lifetime_value), 2) AS lifetime_value,
  CAST(sum(unique_holdings) AS BIGINT) AS unique_holdings, round(avg(monetary_value), {money}) AS monetary_value,
  round(avg(frequency), {average}) AS avg_frequency, round(avg(rfm_score), {average}) AS avg_rfm_score FROM rfm GROUP BY ALL"""


add("clv_polar", RFM, segments("ControlGroup,", 6, 9))
add("clv_treemap", RFM, segments("", 2, 2))
add("clv_corr", RFM + """,
ranked AS (SELECT rfm_segment, frequency, monetary_value,
  rank() OVER (PARTITION BY rfm_segment ORDER BY frequency) + (count(*) OVER (PARTITION BY rfm_segment, frequency) - 1) / 2.0 AS rf,
  rank() OVER (PARTITION BY rfm_segment ORDER BY monetary_value) + (count(*) OVER (PARTITION BY rfm_segment, monetary_value) - 1) / 2.0 AS rm FROM rfm),
pt AS (SELECT rfm_segment, frequency AS x, recency AS y, count(*) AS n FROM rfm GROUP BY ALL),
signs AS (SELECT a.rfm_segment, sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) AS balance,
  sum(CASE WHEN a.x <> b.x THEN a.n * b.n ELSE 0 END) AS untied_x, sum(CASE WHEN a.y <> b.y THEN a.n * b.n ELSE 0 END) AS untied_y
  FROM pt a JOIN pt b ON a.rfm_segment = b.rfm_segment GROUP BY ALL)""",
    """SELECT rfm_segment, round(CASE WHEN stddev_pop(frequency) * stddev_pop(tenure) > 0 THEN corr(frequency, tenure) END, 7) AS correlation,
  'pearson' AS method FROM rfm GROUP BY ALL
UNION ALL SELECT rfm_segment, round(CASE WHEN stddev_pop(rf) * stddev_pop(rm) > 0 THEN corr(rf, rm) END, 7), 'spearman' FROM ranked GROUP BY ALL
UNION ALL SELECT rfm_segment, round(balance / nullif(sqrt(untied_x::DOUBLE * untied_y), 0), 7), 'kendall' FROM signs""")
add("clv_density", f"""{RFM}, span AS (SELECT min(recency) AS rl, max(recency) AS rh, min(frequency)::DOUBLE AS fl, max(frequency)::DOUBLE AS fh FROM rfm)""",
    """SELECT CAST(least(floor((recency - rl) / (rh - rl) * 60), 59) AS INTEGER) AS x_bin,
  CAST(least(floor((frequency - fl) / (fh - fl) * 60), 59) AS INTEGER) AS y_bin, round(sum(lifetime_value), 2) AS value, count(*) AS n
FROM rfm CROSS JOIN span GROUP BY ALL""")

add("clv_bgnbd_loglik", f"""{RFM}, p AS (SELECT *, 0.8::DOUBLE AS r, 120.0::DOUBLE AS alpha, 0.9::DOUBLE AS a, 2.4::DOUBLE AS b, frequency::DOUBLE AS x
  FROM rfm WHERE frequency > 0 AND recency > 0),
terms AS (SELECT *, lgamma(r + x) - lgamma(r) + r * ln(alpha) + lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x) AS base,
  -(r + x) * ln(alpha + tenure) AS alive, ln(a / (b + x - 1)) - (r + x) * ln(alpha + recency) AS dead FROM p)""",
    """SELECT rfm_segment, count(*) AS customers, round(sum(base + greatest(alive, dead) + ln(1 + exp(-abs(alive - dead)))), 5) AS loglik
FROM terms GROUP BY ALL""")
add("clv_gammagamma_loglik", f"""{RFM}, p AS (SELECT *, 2.5::DOUBLE AS p, 3.5::DOUBLE AS q, 900.0::DOUBLE AS v, frequency::DOUBLE AS x, monetary_value::DOUBLE AS m
  FROM rfm WHERE frequency > 0 AND monetary_value > 0)""",
    """SELECT rfm_segment, count(*) AS customers, round(sum(lgamma(p * x + q) - lgamma(p * x) - lgamma(q) + q * ln(v) + (p * x - 1) * ln(m)
  + p * x * ln(x) - (p * x + q) * ln(x * m + v)), 5) AS loglik FROM p GROUP BY ALL""")

# ---- profiling --------------------------------------------------------------------------------------------------------

_ITEMS = {"l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1, "l_extendedprice": 1, "l_discount": 1, "l_tax": 1,
          "l_returnflag": 0, "l_linestatus": 0, "l_shipdate": 2}
_parts = ["""SELECT 'order_id' AS "column", count(DISTINCT l_orderkey) AS unique_count, 'N/A' AS most_occurring,
  NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median FROM lineitem"""]
for _c, _kind in _ITEMS.items():
    _mode = "'N/A'" if _kind else f"(SELECT {_c} FROM lineitem GROUP BY {_c} ORDER BY count(*) DESC, {_c} LIMIT 1)"
    _v = f"CAST({_c} AS DOUBLE)"
    _numbers = (f"round(min({_v}), 8), round(max({_v}), 8), round(avg({_v}), 8), round(quantile_cont({_v}, 0.5), 8)" if _kind == 1
                else "NULL, NULL, NULL, NULL")
    _parts.append(f"SELECT '{_c}', count(DISTINCT {_c}), {_mode}, {_numbers} FROM lineitem")
add("prof_schema", "", "\nUNION ALL ".join(_parts))
add("prof_sketch", "profile AS (" + "\nUNION ALL ".join(_parts) + ")", """SELECT "column", most_occurring, min, max, mean,
  true AS unique_close, CASE WHEN median IS NOT NULL THEN true END AS median_close FROM profile""")
add("prof_classify", """counted AS (SELECT * FROM (VALUES
  ('order_id', 'Likely ID', 'o', 0), ('l_partkey', 'Likely ID', 'p', 0), ('l_suppkey', 'Likely ID', 's', 0),
  ('l_linenumber', 'Numeric measure', 'n', 0), ('l_quantity', 'Numeric measure', 'q', 0), ('l_extendedprice', 'Numeric measure', 'e', 0),
  ('l_discount', 'Numeric measure, High-cardinality?', 'd', 0), ('l_tax', 'Numeric measure', 't', 0),
  ('l_returnflag', 'Business dimension', 'r', 0), ('l_linestatus', 'Business dimension', 'l', 0),
  ('l_shipdate', 'Time', 'h', 0)) v("column", base, k, z)),
sizes AS (SELECT unnest(['o', 'p', 's', 'n', 'q', 'e', 'd', 't', 'r', 'l', 'h']) AS k,
  unnest([count(DISTINCT l_orderkey), count(DISTINCT l_partkey), count(DISTINCT l_suppkey), count(DISTINCT l_linenumber),
  count(DISTINCT l_quantity), count(DISTINCT l_extendedprice), count(DISTINCT l_discount), count(DISTINCT l_tax),
  count(DISTINCT l_returnflag), count(DISTINCT l_linestatus), count(DISTINCT l_shipdate)]) AS u FROM lineitem)""".replace(
      "Numeric measure, High-cardinality?", "Numeric measure"),
    """SELECT "column", base || CASE WHEN u >= 50 THEN ', High-cardinality' ELSE '' END AS field_tags FROM counted JOIN sizes USING (k)""")

# ---- incremental --------------------------------------------------------------------------------------------------------

add("inc_load", "", "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL")
add("inc_merge", """
shaped AS (SELECT CASE event_type WHEN 'view' THEN 'Impression' WHEN 'click' THEN 'Clicked' END AS Outcome, ts,
  CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d%H') AS k, event_type AS Kind FROM events WHERE event_type IN ('view', 'click')),
kept AS (SELECT *, CASE WHEN Outcome = 'Clicked' THEN 1 ELSE 0 END AS label FROM shaped
  QUALIFY label = max(label) OVER (PARTITION BY k))""", counts("strftime(ts, '%Y-%m-%d') AS \"Day\", Kind", "kept"))
ORACLE["inc_merge_files"] = ORACLE["inc_merge"]
add("ml_recommender_loads", FINE_MODEL, f"""SELECT {MODEL_KEYS}, "Count", round(personalization, 8) + 0.0::DOUBLE AS personalization,
  round(novelty, 8) AS novelty FROM fine_model""")
ORACLE["lab_best_outcome_loads"], ORACLE["conv_touchpoints_loads"] = ORACLE["eng_agg"], ORACLE["conv_agg"]
ORACLE["dedup_event_loads"] = ORACLE["dedup_event"]
add("inc_dedup", "", EVENTS)
add("inc_windowed_ctr", "", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, count(*) AS "Count",
  count(*) FILTER (event_type = 'click') AS Positives, count(*) FILTER (event_type = 'view') AS Negatives,
  round(count(*) FILTER (event_type = 'click') / count(*)::DOUBLE, 8) AS CTR
FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL""")
add("clv_exposure", RFM, "SELECT CustomerID, recency, tenure FROM rfm ORDER BY md5('42|' || CustomerID), CustomerID LIMIT 100")
