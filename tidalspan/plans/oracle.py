"""The registered queries as plain SQL, for cross-checking in another engine.

Each query is a final SELECT over named common table expressions; ``sql`` adds the
expressions it needs.  The SQL is written from the definitions, not from the Spark
code: row frames with per-row bounds instead of range frames, direct regressions per
candidate split instead of segment sums, and so on.
"""

from __future__ import annotations

import re

CTE: dict[str, str] = {}
ORACLE: dict[str, str] = {}


SETTLED = 5  # as in ``scalars``: digits after the last that both engines agree on


def _rounding(text: str) -> str:
    """Spell out rounding: half to even on the decimal text, for ``round`` after the digits that sums may differ in."""
    out, i = "", 0
    while True:
        m = re.compile(r"\b(round|round_even)\(").search(text, i)
        if not m:
            return out + text[i:]
        depth, j, comma = 1, m.end(), 0
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(text[j], 0)
            comma = j if text[j] == "," and depth == 1 else comma
            j += 1
        inner, digits = _rounding(text[m.end():comma]), int(text[comma + 1:j - 1])
        out += text[i:m.start()]
        if m.group(1) == "round":
            text_of = f"CAST(round(CAST({inner} AS DOUBLE), {digits + SETTLED}) AS VARCHAR)"
            out += f"CAST(round_even(CAST({text_of} AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"
        elif digits == 0:
            out += f"round_even({inner}, 0)"
        else:
            out += f"CAST(round_even(CAST(CAST(CAST({inner} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"
        i = j


def sql(final: str) -> str:
    """``final`` with the common table expressions it reaches, in definition order."""
    needed: set[str] = set()
    stack = [final]
    while stack:
        text = stack.pop()
        for name in CTE:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s*{name}\b", text):
                needed.add(name)
                stack.append(CTE[name])
    parts = [f"{name} AS ({CTE[name]})" for name in CTE if name in needed]
    return _rounding(("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final)


def odd(final: str) -> str:
    """``sql`` over the odd tests in place of the usual ones."""
    usual = CTE["b"]
    CTE["b"] = f"""
SELECT * REPLACE (CASE WHEN test_id % 5 = 0 AND rn % 25 = 13 THEN vo2_ml * 3 ELSE vo2_ml END AS vo2_ml, CASE WHEN test_id % 5 = 1 AND phase = 'REST' THEN rer + time_s * 0.004 ELSE rer END AS rer,
  CASE WHEN test_id % 3 = 0 AND test_id % 5 <> 0 THEN vo2_ml * (1.2 - vo2_ml / 30000) ELSE vco2_ml END AS vco2_ml, CASE WHEN test_id % 3 = 0 AND test_id % 5 <> 0 THEN vo2_ml * 0.025 ELSE ve_l END AS ve_l,
  CASE WHEN test_id % 3 = 0 AND test_id % 5 <> 0 THEN 100.0 ELSE peto2_mmhg END AS peto2_mmhg, CASE WHEN test_id % 3 = 0 AND test_id % 5 <> 0 THEN 40.0 ELSE petco2_mmhg END AS petco2_mmhg)
FROM ({usual})"""
    try:
        return sql(final)
    finally:
        CTE["b"] = usual


def frame(k: str, align: str = "center") -> str:
    if align == "center":
        return f"(PARTITION BY test_id ORDER BY rn ROWS BETWEEN ({k} - 1) // 2 PRECEDING AND {k} // 2 FOLLOWING)"
    return f"(PARTITION BY test_id ORDER BY rn ROWS BETWEEN {k} - 1 PRECEDING AND CURRENT ROW)"


def roll(c: str, k: str = "k", align: str = "center", fn: str = "avg") -> str:
    w = frame(k, align)
    return f"CASE WHEN count({c}) OVER {w} = {k} THEN {fn}({c}) OVER {w} END"


def rnd(*columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def t_p(t: str, n: str) -> str:
    """Two-sided p value by the finite sums for whole degrees of freedom."""
    c, theta, sine = f"({n} / ({n} + ({t})^2))", f"atan(({t}) / sqrt({n}))", f"(({t}) / sqrt({n} + ({t})^2))"
    odd = f"list_sum(list_transform(range(0, ({n} - 1) // 2), lambda i: exp(lgamma(i + 1) + lgamma(1.5) - lgamma(i + 1.5)) * {c}^i))"
    even = f"list_sum(list_transform(range(0, {n} // 2), lambda i: exp(lgamma(i + 0.5) - lgamma(0.5) - lgamma(i + 1)) * {c}^i))"
    return f"(1 - CASE WHEN {n} % 2 = 1 THEN 2 / pi() * ({theta} + {sine} * sqrt({c}) * coalesce({odd}, 0)) ELSE {sine} * {even} END)"


def codes(*pairs: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for c, name in pairs) + ")"


def steps(c: str, *limits: tuple[int, int]) -> str:
    return "CASE " + " ".join(f"WHEN {c} > {a} THEN {b}" for a, b in limits) + " ELSE 0 END"


SIGNALS = ["vo2_ml", "vco2_ml", "ve_l", "rer", "hr_bpm", "power_w", "speed_kmh", "peto2_mmhg", "petco2_mmhg"]
SIG = ", ".join(SIGNALS)
AVG = ", ".join(f"avg({c}) AS {c}" for c in SIGNALS)

# ------------------------------------------------------------------ base tables


def _breath_sql(rows: str) -> str:
    return f"""
SELECT test_id, rn, n, time_s, vo2_ml, vo2_ml * rer AS vco2_ml,
  (25.0 + (u - 0.7) * (u - 0.7) * 60.0) * (vo2_ml * rer) / 1000.0 AS ve_l, rer,
  CASE WHEN NOT (tag % 17 = 0 OR test_id % 10 = 0) THEN 70.0 + u * 120.0 + e * 2.0 END AS hr_bpm,
  CASE WHEN test_id % 3 <> 0 THEN floor(u * 12.0) * 25.0 END AS power_w,
  CASE WHEN test_id % 3 = 0 THEN 6.0 + floor(u * 16.0) * 0.5 END AS speed_kmh,
  100.0 + (u - 0.5) * (u - 0.5) * 60.0 AS peto2_mmhg,
  40.0 - (u - 0.6) * (u - 0.6) * 30.0 AS petco2_mmhg,
  CASE WHEN test_id % 4 <> 0 THEN CASE WHEN u < 0.3 THEN 'REST' WHEN u <= 0.9 THEN 'EXERCISE' ELSE 'RECOVERY' END END AS phase
FROM (
  SELECT *, CAST((rn - 1) * (test_id % 7 + 6) AS DOUBLE) AS time_s,
    300.0 + u * 2700.0 + (e - 0.5) * 40.0 AS vo2_ml,
    0.8 + (0.2 + CAST(test_id % 8 AS DOUBLE) * 0.01) * u + (CASE WHEN u > 0.55 THEN u - 0.55 ELSE 0.0 END) * 0.15
      + (e - 0.5) * 0.02 AS rer
  FROM (SELECT *, CAST(rn - 1 AS DOUBLE) / CAST(n - 1 AS DOUBLE) AS u FROM ({rows}))
)"""


CTE["b"] = _breath_sql("""
SELECT user_id AS test_id, event_id AS tag, value - floor(value) AS e,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n
FROM events""")
CTE["lb"] = _breath_sql("""
SELECT l_suppkey AS test_id, l_orderkey AS tag, l_discount * 10.0 AS e,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn,
  count(*) OVER (PARTITION BY l_suppkey) AS n
FROM lineitem""")
for prepared, source in (("p", "b"), ("lp", "lb")):
    CTE[prepared] = f"""
SELECT *, (t_last - t_first) / nullif(n - 1, 0) AS interval_s FROM (
  SELECT *, min(time_s) OVER w AS t_first, max(time_s) OVER w AS t_last, count(hr_bpm) OVER w AS n_hr,
    count(power_w) OVER w AS n_power, count(speed_kmh) OVER w AS n_speed, count(phase) OVER w AS n_phase
  FROM {source} WINDOW w AS (PARTITION BY test_id))"""
CTE["part"] = """
SELECT c_custkey AS test_id, 'P' || c_custkey AS participant_id, c_name AS name, CAST(c_custkey % 60 + 18 AS DOUBLE) AS age,
  CASE WHEN c_custkey % 11 = 7 THEN 'O' WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
  CAST(c_custkey % 45 + 150 AS DOUBLE) AS height_cm, CAST(c_custkey % 50 + 50 AS DOUBLE) AS weight_kg,
  CASE c_custkey % 5 WHEN 0 THEN 'cycling' WHEN 1 THEN 'running' WHEN 2 THEN 'triathlon' WHEN 3 THEN 'general' END AS sport,
  CASE WHEN c_custkey % 7 <> 6 THEN CASE c_custkey % 4 WHEN 0 THEN 'elite' WHEN 1 THEN 'competitive' WHEN 2 THEN 'recreational'
    ELSE 'sedentary' END END AS level
FROM customer"""
CTE["tst"] = """
SELECT c_custkey AS test_id, strftime(DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d') AS test_date,
  'Cart ' || (c_custkey % 3) AS device,
  CASE WHEN c_custkey % 3 = 0 THEN '__Treadmill Bruce' WHEN c_custkey % 3 = 1 THEN 'Cycle ramp 25 W'
    WHEN c_custkey % 2 = 0 THEN 'Standard' ELSE 'Ergometer step' END AS protocol,
  CAST(18 + c_custkey % 30 AS DOUBLE) AS temperature_c, CAST(580 + c_custkey % 100 * 2 AS DOUBLE) AS pressure_mmhg,
  CAST(c_custkey % 101 AS DOUBLE) AS humidity_pct,
  CASE WHEN c_custkey % 2 = 0 THEN 'T' || (c_custkey % 9) END AS technician
FROM customer"""
CTE["rep"] = """
SELECT c_custkey AS test_id, CASE WHEN c_custkey % 3 <> 2 THEN CAST(c_custkey % 8 + 12 AS DOUBLE) END AS rpe,
  CASE WHEN c_custkey % 4 <> 3 THEN CAST(c_custkey % 10 + 2 AS DOUBLE) END AS lactate FROM customer"""
CTE["pre"] = """
SELECT c_custkey AS test_id, CASE c_custkey % 3 WHEN 0 THEN 'fed' WHEN 1 THEN 'fasted' END AS nutritional_state,
  CASE WHEN c_custkey % 2 = 0 THEN 'rested' ELSE 'fatigued' END AS fatigue_state,
  CAST(c_custkey % 60 AS DOUBLE) AS last_meal_hours, CAST(c_custkey % 120 * 10 AS DOUBLE) AS caffeine_mg FROM customer"""
CTE["edi"] = """
SELECT c_custkey AS test_id, CASE WHEN c_custkey % 4 = 1 THEN CAST(c_custkey % 40 + 55 AS DOUBLE) END AS weight_kg,
  CASE WHEN c_custkey % 6 = 1 THEN CAST(c_custkey % 50 + 20 AS DOUBLE) END AS age FROM customer"""
CTE["pred"] = """
SELECT *, pred_vo2 / 1000 * 25 AS pred_ve, pred_vo2 / pred_hr AS pred_o2_pulse FROM (
  SELECT *, pred_vo2_kg * weight_kg AS pred_vo2 FROM (
    SELECT *, 208 - age * 0.7 AS pred_hr,
      CASE WHEN sex = 'M' THEN 60 - age * 0.55 ELSE 48 - age * 0.37 END AS pred_vo2_kg,
      greatest((height_cm - 60) * CASE WHEN sex = 'M' THEN 20 ELSE 14 END - age * 2, 50) AS pred_power
    FROM part))"""
CTE["grp"] = """
SELECT *, CASE age_group WHEN 'junior' THEN 18 WHEN '70+' THEN 75 WHEN '20-29' THEN 25 WHEN '30-39' THEN 35 WHEN '40-49' THEN 45
  WHEN '50-59' THEN 55 ELSE 65 END AS age_midpoint FROM (
  SELECT *, CASE WHEN age < 20 THEN 'junior' WHEN age < 30 THEN '20-29' WHEN age < 40 THEN '30-39' WHEN age < 50 THEN '40-49'
    WHEN age < 60 THEN '50-59' WHEN age < 70 THEN '60-69' ELSE '70+' END AS age_group FROM part)"""


def _values(rows) -> str:
    show = lambda v: "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)")
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


from ..operators.labels import LABELS  # noqa: E402
from ..operators.norms import POPULATION_NORMS, POPULATION_SOURCE, PREDICTION_SOURCE, SPORT_NORMS  # noqa: E402

CTE["sn"] = f"""SELECT * FROM (VALUES {_values(SPORT_NORMS)}) v(sport, level, sex, lo, typ, hi, mlo, mtyp, mhi, hrmax, source, msource)"""
CTE["pn"] = f"SELECT * FROM (VALUES {_values(POPULATION_NORMS)}) v(sex, age_group, p25, p50, p75)"
CTE["lab"] = f"SELECT * FROM (VALUES {_values(LABELS)}) v(key, en, fr)"
CTE["nrm"] = f"""
SELECT g.test_id, g.age_group, CASE WHEN gen THEN p25 ELSE lo END AS norm_low, CASE WHEN gen THEN p50 ELSE typ END AS norm_typical,
  CASE WHEN gen THEN p75 ELSE hi END AS norm_high,
  CASE WHEN gen THEN CASE WHEN p50 IS NOT NULL THEN round_even(208 - 0.7 * age_midpoint, 0) END ELSE hrmax END AS norm_hr_max,
  CASE WHEN NOT gen AND sp = 'cycling' THEN mtyp END AS norm_efficiency,
  CASE WHEN NOT gen AND sp = 'running' THEN mtyp END AS norm_economy,
  CASE WHEN gen THEN CASE WHEN p50 IS NOT NULL THEN '{POPULATION_SOURCE}' END ELSE source END AS norm_source,
  CASE WHEN NOT gen THEN msource END AS metric_source
FROM (SELECT *, coalesce(sport, 'general') AS sp, coalesce(level, 'recreational') AS lv,
    coalesce(sport, 'general') = 'general' OR coalesce(level, 'recreational') = 'sedentary' AS gen FROM grp) g
LEFT JOIN sn ON sn.sport = sp AND sn.level = lv AND sn.sex = g.sex
LEFT JOIN pn ON pn.sex = g.sex AND pn.age_group = g.age_group"""

GE = "CASE WHEN {w} > 0 AND {v} > 0 THEN round_even({w} / ({v} / 1000 * (4.69 + (CASE WHEN {r} IS NOT NULL THEN least(greatest({r}, 0.7), 1.1) END - 0.7) * (5.05 - 4.69) / 0.3) * 69.78) * 100, 1) END"
RE = "CASE WHEN {s} > 0 AND {v} >= 0 THEN round_even({v} / {s} * 60, 1) END"
DURATION = "printf('%d:%02d', CAST(floor({t} / 60) AS BIGINT), CAST(round_even({t} - floor({t} / 60) * 60, 0) AS BIGINT))"
MODALITY = """CASE WHEN regexp_matches(lower(protocol), 'cycle|bike|ergometer|watt') THEN 'cycling'
  WHEN regexp_matches(lower(protocol), 'treadmill|bruce|balke|walk|run') THEN 'treadmill'
  WHEN np > 10 AND top > 20 THEN 'cycling' ELSE 'unknown' END"""

# -------------------------------------------------------------- sources and sinks

ORACLE["s1_read_grids"] = sql("""
SELECT test_id, CAST(r AS BIGINT) AS row, CAST(
  CASE WHEN r = 1 THEN 8 WHEN r = 2 THEN 8 WHEN r = 3 THEN 0 ELSE 5 + CASE WHEN hr_bpm IS NULL THEN 0 ELSE 1 END
    + CASE WHEN power_w IS NULL THEN 0 ELSE 1 END + CASE WHEN phase IS NULL THEN 0 ELSE 1 END END
  + CASE WHEN r <= 8 AND r NOT IN (3, 8) THEN 1 ELSE 0 END + CASE WHEN r IN (1, 7, 8) THEN 1 ELSE 0 END
  + CASE WHEN r IN (1, 2, 3) THEN 1 ELSE 0 END AS BIGINT) AS filled
FROM (SELECT test_id, rn + 3 AS r, hr_bpm, power_w, phase FROM b
  UNION ALL SELECT DISTINCT test_id, i, NULL, NULL, NULL FROM b, range(1, 4) t(i))""")
ORACLE["s2_participants_from_grid"] = sql("""
SELECT test_id, participant_id, name, sex, age, height_cm, weight_kg FROM part WHERE test_id IN (SELECT test_id FROM b)""")
ORACLE["s3_tests_from_grid"] = sql("""
SELECT test_id, test_date, 'COSMED Quark CPET - ' || device AS device, protocol, CAST(NULL AS DOUBLE) AS temperature_c,
  pressure_mmhg, humidity_pct FROM tst WHERE test_id IN (SELECT test_id FROM b)""")
ORACLE["s4_breaths_from_grid"] = sql(f"SELECT test_id, rn, {rnd('time_s', 'vo2_ml', 'vco2_ml', 've_l', 'rer', 'hr_bpm', 'power_w')}, phase FROM b")
ORACLE["s5_day_fraction_time"] = sql(f"SELECT test_id, rn, {rnd('time_s')} FROM b")
ORACLE["s6_format_routing"] = sql("SELECT DISTINCT test_id, CASE WHEN test_id % 9 = 0 THEN 'unknown' ELSE 'cosmed' END AS format, test_id % 9 <> 0 AS supported FROM b")
ORACLE["s7_data_type"] = sql("""
SELECT test_id, round(mid, 4) AS median_gap, round(cv, 4) AS gap_cv, coalesce(ok, false) AS is_averaged,
  CASE WHEN ok THEN CAST(w AS DOUBLE) END AS averaging_window
FROM (SELECT *, n >= 10 AND gaps >= 5 AND cv < 0.05 AND abs(mid - w) < 1 AS ok FROM (
  SELECT *, (SELECT w FROM (VALUES (5), (10), (15), (20), (30)) v(w) ORDER BY abs(w - mid), w LIMIT 1) AS w FROM (
    SELECT test_id, count(*) AS n, count(g) AS gaps, median(g) AS mid, stddev_samp(g) / avg(g) AS cv FROM (
      SELECT test_id, CASE WHEN d > 0 AND d < 60 THEN d END AS g FROM (
        SELECT test_id, time_s - lag(time_s) OVER (PARTITION BY test_id ORDER BY rn) AS d FROM b))
    GROUP BY test_id)))""")
ORACLE["s8_export_breaths"] = sql(f"SELECT test_id, rn, {rnd('time_s', 'vo2_ml')}, phase FROM b")
ORACLE["s1_incremental_ingest"] = sql(f"""
SELECT test_id, CASE WHEN test_id % 2 = 1 OR test_id % 10 = 0 THEN 2 ELSE 1 END AS batch, rn, {rnd('time_s', 'vo2_ml', 'rer')}, phase FROM b""")
ORACLE["s8_replaced_tests"] = sql(f"""
SELECT test_id, rn, {rnd('time_s')}, round(vo2_ml + CASE WHEN test_id % 20 = 0 THEN 1 ELSE 0 END, 4) AS vo2_ml, phase FROM b WHERE test_id % 20 <> 0 OR rn > 1""")
ORACLE["s8_point_lookup"] = sql(f"SELECT test_id, rn, {rnd('time_s', 'vo2_ml')}, phase FROM b WHERE test_id IN (1, 8, 13, 40)")
ORACLE["s8_stored_join"] = sql("""
SELECT test_id, count(*) AS n_common, count(*) FILTER (rn % 3 <> 0 AND ve_l IS NOT NULL) AS n_changed, round(CAST(sum(CASE WHEN ve_l IS NOT NULL THEN rn % 3 END) AS DOUBLE), 4) AS change
FROM b WHERE rn % 7 <> 0 GROUP BY test_id""")
ORACLE["s9_order_audit"] = sql("""
SELECT test_id, '' AS missing_columns, count(*) FILTER (t < prev) AS steps_back, count(*) FILTER (t < prev) = 0 AS is_ordered
FROM (SELECT test_id, t, lag(t) OVER (PARTITION BY test_id ORDER BY rn) AS prev
  FROM (SELECT test_id, rn, CASE WHEN rn % 13 = 0 THEN time_s - 60 ELSE time_s END AS t FROM b))
GROUP BY test_id""")
ORACLE["s10_range_audit"] = sql(f"""
SELECT test_id, source, property, round(v, 4) AS value, CAST(NULL AS VARCHAR) AS code FROM (
  SELECT test_id, 'tests' AS source, 'temperature_c' AS property, temperature_c AS v FROM tst WHERE temperature_c NOT BETWEEN 10 AND 40
  UNION ALL SELECT test_id, 'tests', 'pressure_mmhg', pressure_mmhg FROM tst WHERE pressure_mmhg NOT BETWEEN 600 AND 900
  UNION ALL SELECT test_id, 'tests', 'humidity_pct', humidity_pct FROM tst WHERE humidity_pct NOT BETWEEN 0 AND 100
  UNION ALL SELECT test_id, 'pretest', 'last_meal_hours', last_meal_hours FROM pre WHERE last_meal_hours NOT BETWEEN 0 AND 48
  UNION ALL SELECT test_id, 'pretest', 'caffeine_mg', caffeine_mg FROM pre WHERE caffeine_mg NOT BETWEEN 0 AND 1000
  UNION ALL SELECT test_id, 'participants', 'age', age FROM part WHERE age NOT BETWEEN 0 AND 120
  UNION ALL SELECT test_id, 'economy', 'gross_efficiency', ge FROM (
    SELECT test_id, {GE.format(v='height_cm * 20', w='age * 4', r='0.9')} AS ge FROM part) WHERE ge NOT BETWEEN 10 AND 35
  UNION ALL SELECT test_id, 'peaks', 'vo2_peak', height_cm * 50 FROM part WHERE height_cm * 50 NOT BETWEEN 0 AND 8000
  UNION ALL SELECT test_id, 'peaks', 'vo2_kg_peak', height_cm / 2 FROM part WHERE height_cm / 2 NOT BETWEEN 0 AND 100
  UNION ALL SELECT test_id, 'peaks', 've_peak', height_cm * 1.5 FROM part WHERE height_cm * 1.5 NOT BETWEEN 0 AND 250
  UNION ALL SELECT test_id, 'peaks', 'rer_peak', test_id % 30 / 10 FROM part WHERE test_id % 30 / 10 NOT BETWEEN 0.5 AND 2
  UNION ALL SELECT test_id, 'peaks', 'hr_peak', (test_id % 280)::DOUBLE FROM part WHERE (test_id % 280)::DOUBLE NOT BETWEEN 30 AND 250
  UNION ALL SELECT test_id, 'peaks', 'power_peak', height_cm * 4 - 50 FROM part WHERE height_cm * 4 - 50 NOT BETWEEN 0 AND 600
  UNION ALL SELECT test_id, 'peaks', 'speed_peak', (test_id % 45)::DOUBLE FROM part WHERE (test_id % 45)::DOUBLE NOT BETWEEN 0 AND 40
  UNION ALL SELECT test_id, 'quality', 'peak_rer', test_id % 30 / 10 FROM rep WHERE test_id % 30 / 10 NOT BETWEEN 0.5 AND 2
  UNION ALL SELECT test_id, 'quality', 'rpe', rpe + test_id % 3 * 4 FROM rep WHERE rpe + test_id % 3 * 4 NOT BETWEEN 6 AND 20
  UNION ALL SELECT test_id, 'quality', 'lactate', lactate * 3 FROM rep WHERE lactate * 3 NOT BETWEEN 0 AND 30
  UNION ALL SELECT test_id, 'quality', 'overall_score', (test_id % 110)::DOUBLE FROM rep WHERE (test_id % 110)::DOUBLE NOT BETWEEN 0 AND 100
  UNION ALL SELECT test_id, 'quality', 'r_squared', test_id % 13 / 10 FROM rep WHERE test_id % 13 / 10 NOT BETWEEN 0 AND 1
  UNION ALL SELECT test_id, 'protocol', 'stage_duration_s', (test_id % 80 * 10)::DOUBLE FROM tst WHERE (test_id % 80 * 10)::DOUBLE NOT BETWEEN 30 AND 600)
UNION ALL SELECT test_id, 'quality', 'grade', NULL, 'E' FROM rep WHERE test_id % 6 = 5
UNION ALL SELECT test_id, 'quality', 'protocol_rating', NULL, 'fair' FROM rep WHERE test_id % 6 = 5
UNION ALL SELECT test_id, 'quality', 'data_rating', NULL, CASE test_id % 6 WHEN 4 THEN 'unable_to_assess' ELSE 'fair' END FROM rep WHERE test_id % 6 >= 4
UNION ALL SELECT test_id, 'protocol', 'modality', NULL, 'rowing' FROM tst WHERE test_id % 4 = 3""")

# ------------------------------------------------------------------ projections

ORACLE["p1_ventilatory_equivalents"] = sql("SELECT test_id, rn, round(ve_l * 1000 / vo2_ml, 4) AS ve_vo2, round(ve_l * 1000 / vco2_ml, 4) AS ve_vco2 FROM b")
ORACLE["p2_o2_pulse"] = sql("SELECT test_id, rn, round(vo2_ml / hr_bpm, 4) AS o2_pulse FROM b")
ORACLE["p3_time_axis"] = sql("""
SELECT test_id, rn, CASE WHEN t_last > 300 THEN 'min' ELSE 's' END AS time_unit,
  round(CASE WHEN t_last > 300 THEN time_s / 60 ELSE time_s END, 4) AS time_plot FROM p""")
ORACLE["p4_weight_normalised_vo2"] = sql("SELECT b.test_id, rn, round(vo2_ml / weight_kg, 4) AS vo2_per_kg FROM b LEFT JOIN part USING (test_id)")
ORACLE["p5_bmi"] = sql("SELECT test_id, round_even(weight_kg / ((height_cm / 100) * (height_cm / 100)), 1) AS bmi FROM part")
ORACLE["p6_running_economy"] = sql(f"SELECT b.test_id, rn, {RE.format(v='(vo2_ml / weight_kg)', s='speed_kmh')} AS running_economy FROM b JOIN part USING (test_id)")
ORACLE["p7_gross_efficiency"] = sql(f"SELECT test_id, rn, {GE.format(v='vo2_ml', w='power_w', r='rer')} AS gross_efficiency FROM b")
ORACLE["p8_predicted_values"] = sql(f"SELECT test_id, {rnd('pred_hr', 'pred_vo2_kg', 'pred_vo2', 'pred_ve', 'pred_power', 'pred_o2_pulse')} FROM pred")
ORACLE["p9_age_group"] = sql("SELECT test_id, age_group, CAST(age_midpoint AS INTEGER) AS age_midpoint FROM grp")
ORACLE["p10_rating"] = sql("""
SELECT test_id, CASE WHEN humidity_pct >= 90 THEN 'excellent' WHEN humidity_pct >= 75 THEN 'good' WHEN humidity_pct >= 60 THEN 'acceptable'
  ELSE 'poor' END AS rating FROM tst""")
CTE["md"] = f"SELECT test_id, {MODALITY} AS modality FROM (SELECT test_id, count(power_w) AS np, max(power_w) AS top FROM b GROUP BY test_id) JOIN tst USING (test_id)"
ORACLE["p12_modality"] = sql("SELECT test_id, modality FROM md")
ORACLE["p13_economy_modality"] = sql("""
SELECT test_id, CASE WHEN test_id % 9 = 0 THEN 'other' WHEN regexp_matches(lower(protocol), 'treadmill|running|walk|bruce') THEN 'treadmill'
  ELSE 'cycling' END AS modality FROM tst""")
ORACLE["p14_duration_text"] = sql(f"SELECT test_id, {DURATION.format(t='s')} AS duration FROM (SELECT test_id, max(time_s) + 0.5 AS s FROM b GROUP BY test_id)")
CTE["zone"] = """
SELECT test_id, greatest(220 - age, peak) AS hr_reference, z AS zone_pct, greatest(220 - age, peak) * z / 100 AS zone_bpm
FROM (SELECT test_id, max(hr_bpm) AS peak FROM b GROUP BY test_id) JOIN part USING (test_id), (VALUES (50), (60), (70), (80), (90), (100)) v(z)
WHERE peak IS NOT NULL"""
ORACLE["p15_heart_rate_zones"] = sql(f"SELECT test_id, {rnd('hr_reference')}, zone_pct, {rnd('zone_bpm')} FROM zone")
ORACLE["p15_sql_zones"] = ORACLE["p15_heart_rate_zones"]
ORACLE["p_sql_scalars"] = sql(f"""
SELECT b.test_id, rn, {RE.format(v='(vo2_ml / weight_kg)', s='speed_kmh')} AS running_economy, {GE.format(v='vo2_ml', w='power_w', r='rer')} AS gross_efficiency, age_group,
  CASE WHEN hr_bpm / 2 >= 90 THEN 'excellent' WHEN hr_bpm / 2 >= 75 THEN 'good' WHEN hr_bpm / 2 >= 60 THEN 'acceptable' ELSE 'poor' END AS hr_rating,
  {DURATION.format(t='(time_s + 0.5)')} AS at
FROM b JOIN part ON part.test_id = b.test_id JOIN (SELECT test_id, age_group FROM grp) g ON g.test_id = b.test_id""")
CTE["axes"] = """
SELECT *, p0 - v0 * scale AS "offset" FROM (SELECT *, (p1 - p0) / nullif(v1 - v0, 0) AS scale FROM (
  SELECT *, min(power_w) OVER w AS p0, max(power_w) OVER w AS p1, min(vo2_ml) OVER w AS v0, max(vo2_ml) OVER w AS v1
  FROM b WINDOW w AS (PARTITION BY test_id)))"""
ORACLE["p16_two_axis_scale"] = sql("""SELECT test_id, rn, round(scale, 4) AS scale, round("offset", 4) AS "offset" FROM axes""")
ORACLE["p17_long_signals"] = sql("""
SELECT test_id, rn, 'vo2_ml' AS variable, round(vo2_ml, 4) AS value FROM b
UNION ALL SELECT test_id, rn, 'vco2_ml', round(vco2_ml, 4) FROM b UNION ALL SELECT test_id, rn, 'hr_bpm', round(hr_bpm, 4) FROM b""")
ORACLE["p18_state_labels"] = sql("""
SELECT test_id, coalesce(a.fr, nutritional_state, '-') AS nutritional_state_label, coalesce(c.fr, fatigue_state, '-') AS fatigue_state_label
FROM pre LEFT JOIN lab a ON a.key = nutritional_state LEFT JOIN lab c ON c.key = fatigue_state""")
ORACLE["p19_rounded_columns"] = sql("SELECT test_id, rn, round_even(vo2_ml, 1) AS vo2_ml, round_even(ve_l, 1) AS ve_l, round_even(hr_bpm, 1) AS hr_bpm, phase FROM b")

# ---------------------------------------------------------------------- filters

CTE["ex"] = """
SELECT *, coalesce(CASE WHEN bool_or(nm) OVER (PARTITION BY test_id) THEN nm ELSE ot END, false) AS ex FROM (
  SELECT *, regexp_matches(lower(phase), 'exercise|warmup|work|exer') AS nm, NOT regexp_matches(lower(phase), 'rest|recovery|cool') AS ot FROM p)"""
ORACLE["f1_complete_rows"] = sql(f"SELECT test_id, rn, {rnd('vo2_ml')} FROM b WHERE hr_bpm IS NOT NULL")
ORACLE["f2_exercise_rows"] = sql(f"SELECT test_id, rn, {rnd('time_s')}, phase FROM ex WHERE ex")
ORACLE["f3_loaded_rows"] = sql(f"SELECT test_id, rn, {rnd('power_w', 'vo2_ml')} FROM b WHERE power_w > 20")
ORACLE["f4_rest_rows"] = sql(f"SELECT test_id, rn, {rnd('vo2_ml')} FROM b WHERE lower(phase) IN ('rest', 'baseline', 'warmup')")
ORACLE["f5_first_seconds"] = sql(f"SELECT test_id, rn, {rnd('time_s')} FROM p WHERE time_s <= t_first + 120")
CTE["st180"] = "SELECT *, CAST(greatest(ceil((time_s - t_first) / 180), 1) AS INTEGER) AS stage FROM p"
ORACLE["f6_last_seconds"] = sql(f"SELECT test_id, rn, stage, {rnd('time_s')} FROM (SELECT *, max(time_s) OVER (PARTITION BY test_id, stage) AS e FROM st180) WHERE time_s >= e - 30")

# -------------------------------------------------------------- power and stages

CTE["inc"] = """
SELECT test_id, CASE WHEN median(d) IS NULL THEN 25.0 ELSE greatest(round_even(median(d) / 5, 0) * 5, 10) END AS inc FROM (
  SELECT test_id, CASE WHEN d > 5 THEN d END AS d FROM (
    SELECT test_id, power_w - lag(power_w) OVER (PARTITION BY test_id ORDER BY power_w) AS d
    FROM (SELECT DISTINCT test_id, power_w FROM b WHERE power_w > 0)))
GROUP BY test_id"""
CTE["lvl"] = "SELECT p.*, round_even(power_w / inc, 0) * inc AS level FROM p LEFT JOIN inc USING (test_id)"
CTE["step"] = """
SELECT a.*, coalesce(r, 0) AS pstage FROM lvl a LEFT JOIN (
  SELECT test_id, level, row_number() OVER (PARTITION BY test_id ORDER BY level) AS r FROM (SELECT DISTINCT test_id, level FROM lvl WHERE level > 0)) q
  ON q.test_id = a.test_id AND q.level = a.level"""
CTE["rmp0"] = """
SELECT test_id, rn, power_w, row_number() OVER (PARTITION BY test_id ORDER BY rn) AS pn, CAST(least(greatest(5, round_even(30 / gap, 0)), m) AS BIGINT) AS k
FROM (SELECT *, CASE WHEN g > 0 THEN g ELSE 1 END AS gap FROM (
  SELECT *, count(*) OVER w AS m, (max(time_s) OVER w - min(time_s) OVER w) / nullif(count(*) OVER w - 1, 0) AS g
  FROM p WHERE power_w IS NOT NULL WINDOW w AS (PARTITION BY test_id)))"""
CTE["rmp"] = """
SELECT test_id, rn, CASE WHEN k >= 5 THEN coalesce(CASE WHEN count(power_w) OVER w = k THEN avg(power_w) OVER w END, power_w) ELSE power_w END AS used
FROM rmp0 WINDOW w AS (PARTITION BY test_id ORDER BY pn ROWS BETWEEN (k - 1) // 2 PRECEDING AND k // 2 FOLLOWING)"""
CTE["rinc"] = """
SELECT test_id, CASE WHEN median(d) IS NULL THEN 25.0 ELSE greatest(round_even(median(d) / 5, 0) * 5, 10) END AS inc FROM (
  SELECT test_id, CASE WHEN d > 5 THEN d END AS d FROM (
    SELECT test_id, used - lag(used) OVER (PARTITION BY test_id ORDER BY used) AS d
    FROM (SELECT DISTINCT test_id, used FROM rmp WHERE used > 0)))
GROUP BY test_id"""
CTE["rlvl"] = """
SELECT p.*, round_even(used / inc, 0) * inc AS level FROM p LEFT JOIN rmp ON rmp.test_id = p.test_id AND rmp.rn = p.rn
LEFT JOIN rinc ON rinc.test_id = p.test_id"""
CTE["rstep"] = """
SELECT a.*, coalesce(r, 0) AS pstage FROM rlvl a LEFT JOIN (
  SELECT test_id, level, row_number() OVER (PARTITION BY test_id ORDER BY level) AS r FROM (SELECT DISTINCT test_id, level FROM rlvl WHERE level > 0)) q
  ON q.test_id = a.test_id AND q.level = a.level"""
CTE["phs"] = """
SELECT *, CASE WHEN time_s < s0 THEN 0 WHEN time_s > s1 THEN ns + 1 ELSE ceil((time_s - s0) / 180) END AS hstage FROM (
  SELECT *, ceil((s1 - s0) / 180) AS ns FROM (
    SELECT *, min(CASE WHEN ex THEN time_s END) OVER (PARTITION BY test_id) AS s0, max(CASE WHEN ex THEN time_s END) OVER (PARTITION BY test_id) AS s1 FROM ex))"""
NAME = "CASE WHEN stage = 0 THEN 'Rest' ELSE 'Stage ' || stage END"


def _staged(power: str, by_phase: str, by_power: str) -> str:
    return f"""
SELECT *, CASE WHEN {by_phase} AND stage > ns THEN 'Recovery' ELSE {NAME} END AS stage_name FROM (
  SELECT *, CAST(CASE WHEN {by_phase} THEN hstage WHEN {by_power} THEN pstage ELSE greatest(ceil((time_s - t_first) / 180), 1) END AS INTEGER) AS stage
  FROM phs JOIN (SELECT test_id, rn, level, pstage FROM {power}) q USING (test_id, rn))"""


CTE["stg"] = _staged("step", "(n_phase > 0 AND ns IS NOT NULL)", "(n_phase = 0 AND n_power > 0)")
CTE["rstg"] = _staged("rstep", "(1 = 0)", "(n_power > 0 AND (n_phase = 0 OR ns IS NOT NULL))")
CTE["hstg"] = f"""
SELECT *, CASE WHEN ns IS NOT NULL AND stage > ns THEN 'Recovery' ELSE {NAME} END AS stage_name FROM (
  SELECT *, CAST(CASE WHEN ns IS NOT NULL THEN hstage ELSE greatest(ceil((time_s - t_first) / 180), 1) END AS INTEGER) AS stage FROM phs)"""
CTE["tstg"] = f"SELECT *, {NAME} AS stage_name FROM st180"


def summary(source: str, last: int | None = None, peak: bool = False) -> str:
    fn = "max" if peak else "avg"
    cut = "" if last is None else f" WHERE time_s >= e - {last}"
    vals = ", ".join(f"{fn}({c}) AS {c}" for c in ("vo2_ml", "vco2_ml", "ve_l", "rer", "hr_bpm", "power_w", "speed_kmh"))
    return f"""SELECT test_id, stage, min(stage_name) AS stage_name, avg(time_s) AS time_s, max(time_s) - min(time_s) AS duration_s,
  {vals}, count(*) AS n_breaths FROM (SELECT *, max(time_s) OVER (PARTITION BY test_id, stage) AS e FROM {source} WHERE stage > 0){cut} GROUP BY test_id, stage"""


CTE["smean"] = summary("stg")
CTE["s30"] = summary("stg", 30)
CTE["s60"] = summary("stg", 60)
CTE["speak"] = summary("stg", peak=True)
CTE["hmean"] = summary("hstg")
CTE["tmean"] = summary("tstg")
CTE["t30"] = summary("tstg", 30)
SUM = "test_id, stage, stage_name, " + rnd("time_s", "duration_s", "vo2_ml", "vco2_ml", "ve_l", "rer", "hr_bpm", "power_w") + ", n_breaths"

# ------------------------------------------------------------------------ joins

ORACLE["j1_join_stages"] = sql("SELECT test_id, rn, stage, stage_name FROM tstg")
ORACLE["j2_smoothed_power"] = sql("SELECT p.test_id, p.rn, round(coalesce(used, power_w), 4) AS power_used FROM p LEFT JOIN rmp ON rmp.test_id = p.test_id AND rmp.rn = p.rn")
ORACLE["j3_stage_names"] = sql("SELECT test_id, stage, round(vo2_ml, 4) AS vo2_ml, stage_name FROM hmean")
ORACLE["j4_asof_stage"] = sql("""
SELECT p.test_id, p.rn, coalesce(max(s.stage) FILTER (s.t <= p.time_s), min(s.stage)) AS stage
FROM p LEFT JOIN (SELECT test_id, stage, min(time_s) AS t FROM st180 WHERE stage > 1 GROUP BY test_id, stage) s ON s.test_id = p.test_id
GROUP BY p.test_id, p.rn""")
ORACLE["j5_nearest_value"] = sql(f"""
SELECT test_id, {rnd('hr_bpm', 'power_w', 'time_s', 'vco2_ml')} FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY abs(vo2_ml - m), rn) AS i FROM (SELECT *, avg(vo2_ml) OVER (PARTITION BY test_id) AS m FROM b))
WHERE i = 1""")
ORACLE["j6_normative_lookup"] = sql("SELECT test_id, age_group, norm_low, norm_typical, norm_high, norm_hr_max, norm_efficiency, norm_economy FROM nrm")
ORACLE["j7_translate"] = sql("""
SELECT test_id, state, coalesce(en, state) AS text_en, coalesce(fr, state) AS text_fr
FROM (SELECT test_id, coalesce(nutritional_state, 'unknown_state') AS state FROM pre) LEFT JOIN lab ON key = state""")
ORACLE["j9_participant_override"] = sql("""
SELECT part.test_id, name, coalesce(edi.age, part.age) AS age, coalesce(edi.weight_kg, part.weight_kg) AS weight_kg
FROM part LEFT JOIN edi ON edi.test_id = part.test_id""")
ORACLE["j10_category_members"] = sql("""
SELECT c.sport, c.level, c.sex, typ AS vo2max_typical, count(part.test_id) AS members
FROM (SELECT sport, level, sex, typ FROM sn UNION ALL SELECT 'general', 'sedentary', 'M', 38 UNION ALL SELECT 'general', 'sedentary', 'F', 30) c
LEFT JOIN part ON part.sport = c.sport AND part.level = c.level AND part.sex = c.sex GROUP BY ALL""")

# ----------------------------------------------------------------- aggregations


def binned(source: str, group: str) -> str:
    return f"""SELECT test_id, {rnd('time_s', *SIGNALS)}, phase, n_breaths FROM (
  SELECT test_id, {group} AS g, avg(time_s) AS time_s, {AVG}, arg_min(phase, rn) FILTER (phase IS NOT NULL) AS phase, count(*) AS n_breaths
  FROM {source} GROUP BY test_id, g)"""


ORACLE["a1_average_by_time"] = sql(binned("b", "floor(time_s / 30)"))
ORACLE["a2_average_by_breath"] = sql(binned("b", "(rn - 1) // 7"))
ORACLE["a3_stage_summary_mean"] = sql(f"SELECT {SUM} FROM smean")
ORACLE["a4_stage_summary_last"] = sql(f"SELECT 'last30s' AS method, {SUM} FROM s30 UNION ALL SELECT 'last60s', {SUM} FROM s60")
ORACLE["a5_stage_summary_peak"] = sql(f"SELECT {SUM} FROM speak")
CTE["disp"] = f"""
SELECT test_id, kind AS group_kind, g AS stage_group, avg(time_s) AS time_s, {AVG}, count(*) AS n_breaths FROM (
  SELECT *, max(time_s) OVER (PARTITION BY test_id, g) AS e FROM (
    SELECT *, CASE WHEN few THEN 'power' ELSE 'time' END AS kind, CASE WHEN few THEN level ELSE floor(time_s / 30) END AS g FROM (
      SELECT lvl.*, coalesce(n_power > 0 AND (nl <= 20 OR n / nl >= 5), false) AS few FROM lvl LEFT JOIN (
        SELECT test_id, count(DISTINCT level) AS nl FROM lvl WHERE level IS NOT NULL GROUP BY test_id) q ON q.test_id = lvl.test_id)))
WHERE time_s >= e - 30 GROUP BY test_id, kind, g"""
ORACLE["a6_display_stages"] = sql(f"SELECT test_id, group_kind, {rnd('stage_group', 'time_s', *SIGNALS)}, n_breaths FROM disp")


def peak_ctes(name: str, source: str) -> None:
    CTE[name + "0"] = f"SELECT *, CAST(least(greatest(3, round_even(30 / interval_s, 0)), n) AS BIGINT) AS k FROM {source} WHERE n >= 3"
    rolled = ", ".join(f"{roll(c)} AS {c}" for c in ("vo2_ml", "ve_l", "rer", "hr_bpm", "power_w", "speed_kmh"))
    CTE[name + "1"] = f"SELECT test_id, rn, time_s, {rolled} FROM {name}0"
    CTE[name] = f"""SELECT test_id, max(vo2_ml) AS vo2_peak, max(ve_l) AS ve_peak, max(rer) AS rer_peak, max(hr_bpm) AS hr_peak,
  max(power_w) AS power_peak, max(speed_kmh) AS speed_peak FROM {name}1 GROUP BY test_id"""


peak_ctes("pk", "p")
peak_ctes("lpk", "lp")
PEAKS = ["vo2_peak", "ve_peak", "rer_peak", "hr_peak", "power_peak", "speed_peak"]
CTE["pkw"] = "SELECT pk.*, vo2_peak / weight_kg AS vo2_kg_peak FROM pk LEFT JOIN part USING (test_id)"
ORACLE["a7_find_peaks"] = sql(f"SELECT test_id, {rnd(*PEAKS, 'vo2_kg_peak')}, CAST(30 AS DOUBLE) AS averaging_s FROM pkw")
ORACLE["a8_power_increment"] = sql("SELECT test_id, CAST(inc AS DOUBLE) AS power_increment FROM inc")
CTE["reg"] = """
SELECT test_id, count(*) AS n_loaded, regr_slope(vo2_ml, power_w) AS slope, regr_r2(vo2_ml, power_w) AS r_squared,
  (regr_slope(vo2_ml, power_w) - 10) * 100 / 10 AS slope_deviation_pct
FROM b WHERE power_w > 20 GROUP BY test_id HAVING count(*) >= 30"""
ORACLE["a9_workload_regression"] = sql(f"SELECT test_id, n_loaded, {rnd('slope', 'r_squared', 'slope_deviation_pct')}, abs(slope_deviation_pct) <= 15 AS slope_acceptable FROM reg")
ORACLE["a10_expected_vo2"] = sql("""
SELECT test_id, level AS power_level_w, round(a, 4) AS actual_vo2, c AS n_breaths, 250 + level * 10 AS expected_vo2,
  round((a - (250 + level * 10)) * 100 / (250 + level * 10), 4) AS deviation_pct
FROM (SELECT test_id, level, avg(vo2_ml) AS a, count(*) AS c FROM lvl WHERE level > 0 GROUP BY test_id, level) WHERE c >= 5""")
CTE["cons"] = """
SELECT test_id, count(*) AS n_stages, avg(cv) AS stage_cv FROM (
  SELECT test_id, stddev_samp(vo2_ml) * 100 / avg(vo2_ml) AS cv FROM lvl WHERE level > 0 GROUP BY test_id, level HAVING count(*) >= 5)
GROUP BY test_id"""
ORACLE["a11_stage_consistency"] = sql(f"SELECT test_id, n_stages, {rnd('stage_cv')} FROM cons")
CTE["dur"] = """
SELECT test_id, CASE WHEN np > 0 THEN x1 - x0 WHEN nl > 10 THEN l1 - l0 ELSE t1 - t0 - 120 END AS exercise_s,
  CASE WHEN np > 0 THEN w1 - w0 WHEN nl > 10 THEN l0 - t0 ELSE 120 END AS warmup_s, t1 - t0 AS test_s FROM (
  SELECT test_id, count(phase) AS np, count(*) FILTER (power_w > 20) AS nl, min(time_s) AS t0, max(time_s) AS t1,
    min(time_s) FILTER (power_w > 20) AS l0, max(time_s) FILTER (power_w > 20) AS l1,
    min(time_s) FILTER (lower(phase) IN ('exercise', 'ex', 'work', 'load')) AS x0,
    max(time_s) FILTER (lower(phase) IN ('exercise', 'ex', 'work', 'load')) AS x1,
    min(time_s) FILTER (lower(phase) IN ('rest', 'warmup', 'warm-up', 'baseline')) AS w0,
    max(time_s) FILTER (lower(phase) IN ('rest', 'warmup', 'warm-up', 'baseline')) AS w1
  FROM b GROUP BY test_id)"""
ORACLE["a12_exercise_duration"] = sql(f"SELECT test_id, {rnd('exercise_s', 'warmup_s', 'test_s')} FROM dur")
CTE["base"] = """
SELECT test_id, CASE WHEN n1 >= 10 THEN c1 WHEN n2 >= 10 THEN c2 END AS baseline_cv FROM (
  SELECT test_id, count(*) FILTER (r) AS n1, stddev_samp(vo2_ml) FILTER (r) * 100 / avg(vo2_ml) FILTER (r) AS c1,
    count(*) FILTER (f) AS n2, stddev_samp(vo2_ml) FILTER (f) * 100 / avg(vo2_ml) FILTER (f) AS c2
  FROM (SELECT *, coalesce(lower(phase) IN ('rest', 'baseline', 'warmup'), false) AS r, time_s <= t_first + 120 AS f FROM p) GROUP BY test_id)"""
ORACLE["a13_baseline_stability"] = sql(f"SELECT test_id, {rnd('baseline_cv')} FROM base")
CTE["rest"] = """
SELECT test_id, count(r) AS n_rest, regr_slope(r, t) AS slope, count(r) - 2 AS df,
  sqrt(greatest((1 - regr_r2(r, t)) * regr_syy(r, t), 0) / nullif(count(r) - 2, 0) / nullif(regr_sxx(r, t), 0)) AS se
FROM (SELECT test_id, CASE WHEN lower(phase) IN ('rest', 'baseline') THEN rer END AS r, CASE WHEN lower(phase) IN ('rest', 'baseline') THEN time_s END AS t FROM b)
GROUP BY test_id"""
CTE["drift"] = f"""
SELECT test_id, n_rest, CASE WHEN n_rest >= 20 THEN slope END AS rest_slope, p AS p_value, coalesce(p < 0.05 AND abs(slope) > 0.001, false) AS drift_detected FROM (
  SELECT *, CASE WHEN n_rest < 20 OR slope IS NULL THEN NULL WHEN slope = 0 THEN 1.0 WHEN se = 0 THEN 0.0 ELSE {t_p('abs(slope) / se', 'df')} END AS p FROM rest)"""
ORACLE["a14_calibration_drift"] = sql(f"SELECT test_id, n_rest, {rnd('rest_slope', 'p_value', digits=6)}, drift_detected FROM drift")
CTE["miss"] = """
SELECT *, nm_hr * 100 / n_breaths AS pct_missing_hr, nm_pw * 100 / n_breaths AS pct_missing_power FROM (
  SELECT test_id, count(*) AS n_breaths, count(hr_bpm) AS nh, count(power_w) AS nw,
    CASE WHEN count(hr_bpm) > 0 THEN count(*) - count(hr_bpm) END AS nm_hr, CASE WHEN count(power_w) > 0 THEN count(*) - count(power_w) END AS nm_pw
  FROM b GROUP BY test_id)"""
ORACLE["a15_completeness"] = sql(f"""
SELECT test_id, n_breaths, nm_hr AS n_missing_hr, {rnd('pct_missing_hr')}, nm_pw AS n_missing_power, {rnd('pct_missing_power')}, CAST(0 AS DOUBLE) AS missing_ve_l,
  {codes(('pct_missing_hr > 10', 'hr_missing'))} AS missing_warnings, {codes(('nh = 0', 'no_hr'), ('pct_missing_power > 10', 'power_missing'))} AS missing_info
FROM miss""")
RANGE_ERRORS = [("vo2_min < 0", "negative_vo2")]
RANGE_WARNINGS = [("vo2_max > 7000", "very_high_vo2"), ("rer_min < 0.5 OR rer_max > 1.5", "rer_out_of_range"), ("hr_min < 30", "very_low_hr"),
                  ("hr_max > 220", "very_high_hr"), ("ve_max > 200", "very_high_ve")]
RANGE_INFO = [("hr_max > 220 - age + 20", "hr_above_predicted"), ("true", "vo2_range"), ("true", "rer_range")]
CTE["phy"] = """
SELECT q.*, age, weight_kg FROM (SELECT test_id, min(vo2_ml) AS vo2_min, max(vo2_ml) AS vo2_max, min(rer) AS rer_min, max(rer) AS rer_max, min(hr_bpm) AS hr_min,
  max(hr_bpm) AS hr_max, max(ve_l) AS ve_max FROM b GROUP BY test_id) q LEFT JOIN part USING (test_id)"""
ORACLE["a16_physiological_ranges"] = sql(f"""
SELECT test_id, {rnd('vo2_min', 'vo2_max', 'rer_min', 'rer_max', 'hr_min', 'hr_max', 've_max')}, {codes(*RANGE_ERRORS)} AS range_errors,
  {codes(*RANGE_WARNINGS)} AS range_warnings, {codes(*RANGE_INFO)} AS range_info FROM phy""")
CTE["rst"] = """
SELECT q.*, weight_kg FROM (
  SELECT test_id, count(phase) AS np, count(*) FILTER (lower(phase) = 'rest') AS rest_rows,
    (max(time_s) FILTER (lower(phase) = 'rest') - min(time_s) FILTER (lower(phase) = 'rest')) / 60 AS rest_min,
    avg(vo2_ml) FILTER (lower(phase) = 'rest') AS rest_vo2, avg(rer) FILTER (lower(phase) = 'rest') AS rest_rer,
    CASE WHEN count(phase) = 0 THEN avg(rer) FILTER (time_s < t_first + 120) END AS early_rer
  FROM p GROUP BY test_id) q LEFT JOIN part USING (test_id)"""
REST_WARNINGS = [("np > 0 AND rest_rows = 0", "no_rest_phase"), ("np > 0 AND rest_min < 2", "rest_too_short"), ("np > 0 AND rest_vo2 < weight_kg * 3.5 * 0.5", "rest_vo2_low"),
                 ("np > 0 AND rest_vo2 > weight_kg * 3.5 * 1.5", "rest_vo2_high"), ("np > 0 AND (rest_rer < 0.7 OR rest_rer > 0.9)", "rest_rer_unusual")]
REST_INFO = [("np > 0 AND rest_rows > 0", "rest_phase"), ("np = 0", "early_rer_only")]
ORACLE["a17_rest_phase"] = sql(f"""
SELECT test_id, rest_rows, {rnd('rest_min', 'rest_vo2', 'rest_rer', 'early_rer')}, {codes(*REST_WARNINGS)} AS rest_warnings, {codes(*REST_INFO)} AS rest_info FROM rst""")
CTE["eff"] = """
SELECT test_id, rer_max AS peak_rer, hr_max AS peak_hr, hr_max * 100 / (220 - age) AS hr_pct,
  CASE WHEN rer_max >= 1.15 THEN 'strong' WHEN rer_max >= 1.1 THEN 'good' WHEN rer_max >= 1.05 THEN 'moderate' ELSE 'submaximal' END AS rer_effort,
  CASE WHEN hr_max * 100 / (220 - age) >= 95 THEN 'maximal' WHEN hr_max * 100 / (220 - age) >= 85 THEN 'near_maximal' WHEN hr_max IS NOT NULL THEN 'submaximal' END AS hr_effort
FROM phy"""
ORACLE["a18_effort_level"] = sql(f"SELECT test_id, {rnd('peak_rer', 'peak_hr', 'hr_pct')}, rer_effort, hr_effort FROM eff")
CTE["pts"] = """
SELECT test_id, 'vo2_power' AS panel, power_w AS x, vo2_ml AS y FROM disp WHERE power_w > 0
UNION ALL SELECT test_id, 'hr_power', power_w, hr_bpm FROM disp WHERE power_w > 0 AND hr_bpm IS NOT NULL
UNION ALL SELECT test_id, 've_vco2', vco2_ml, ve_l FROM disp UNION ALL SELECT test_id, 'vco2_vo2', vo2_ml, vco2_ml FROM disp"""


CTE["fit0"] = """
SELECT test_id, panel, count(*) AS n_points, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, avg(x) AS mean_x, regr_sxx(y, x) AS sxx,
  CASE WHEN count(*) > 2 THEN sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / (count(*) - 2)) END AS residual_se
FROM pts GROUP BY test_id, panel"""
# The quantile by halving an interval sixty times.
CTE["tq"] = f"""
SELECT d, 0.0::DOUBLE AS lo, 1000.0::DOUBLE AS hi, 0 AS i FROM (SELECT DISTINCT n_points - 2 AS d FROM fit0) WHERE d >= 1
UNION ALL
SELECT d, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END, i + 1
FROM (SELECT d, lo, hi, i, (lo + hi) / 2 AS mid, {t_p('(lo + hi) / 2', 'd')} AS p FROM tq WHERE i < 60)"""
CTE["fits"] = "SELECT fit0.*, tq.lo AS t_95 FROM fit0 LEFT JOIN tq ON tq.d = n_points - 2 AND tq.i = 60"
ORACLE["a19_panel_fits"] = sql(f"SELECT test_id, panel, n_points, {rnd('slope', 'intercept', 'residual_se', 'mean_x', 't_95')} FROM fits")
ORACLE["a19_fit_bands"] = sql("""
SELECT test_id, panel, round(x, 3) AS x, round(f, 3) AS fit, round(f - h, 3) AS low, round(f + h, 3) AS high FROM (
  SELECT pts.test_id, pts.panel, x, intercept + slope * x AS f, t_95 * residual_se * sqrt(1.0 / n_points + (x - mean_x) * (x - mean_x) / sxx) AS h
  FROM pts JOIN fits ON fits.test_id = pts.test_id AND fits.panel = pts.panel)""")
CTE["len"] = "SELECT test_id, count(*) AS n_breaths, (max(time_s) - min(time_s)) / 60 AS duration_min FROM b GROUP BY test_id"
ORACLE["a20_duration_check"] = sql(f"""
SELECT test_id, n_breaths, {rnd('duration_min')}, {codes(('n_breaths < 10', 'too_few_breaths'))} AS length_errors, {codes(('duration_min < 5', 'short_test'))} AS length_warnings FROM len""")

# ---------------------------------------------------------------------- windows


def rolled(source: str) -> str:
    cols = ", ".join(f"{roll(c)} AS {c}" for c in SIGNALS)
    return f"""SELECT * FROM (SELECT test_id, time_s, {cols} FROM (
  SELECT *, CAST(coalesce(greatest(1, round_even(30 / interval_s, 0)), 1) AS BIGINT) AS k FROM {source})) WHERE vo2_ml IS NOT NULL"""


CTE["avr"] = rolled("p")
ORACLE["w1_average_rolling"] = sql(f"SELECT test_id, {rnd('time_s', *SIGNALS)} FROM avr")
CTE["half"] = "SELECT *, CAST(greatest(1, n // 2) AS BIGINT) AS k FROM p"
ORACLE["w1_wide_rolling"] = sql(f"SELECT test_id, rn, k, {', '.join(f'round({roll(c)}, 4) AS {c}_roll' for c in SIGNALS)} FROM half")
CTE["k9"] = """SELECT *, CAST(least(greatest(5, round_even(30 / CASE WHEN interval_s > 0 THEN interval_s ELSE 1 END, 0)), n // 2) AS BIGINT) AS k FROM p"""
ORACLE["w2_right_rolling"] = sql(f"SELECT test_id, rn, k, round({roll('vo2_ml', 'k', 'right')}, 4) AS vo2_ml_roll, round({roll('power_w', 'k', 'right')}, 4) AS power_w_roll FROM k9")


def zscore(rule: str, k: str) -> str:
    return f"""SELECT test_id, rn, time_s, vo2_ml, '{rule}' AS rule, n, CASE WHEN n >= 10 THEN abs(vo2_ml - m) / nullif(s, 0) END AS z FROM (
  SELECT *, {roll('vo2_ml')} AS m, {roll('vo2_ml', fn='stddev_samp')} AS s FROM (SELECT *, CAST({k} AS BIGINT) AS k FROM p))"""


CTE["zq"] = zscore("quality", "greatest(5, least(11, n // 4))")
CTE["zv"] = zscore("validate", "least(11, n)")
ORACLE["w3_outlier_scores"] = sql("SELECT test_id, rn, rule, round(z, 4) AS z FROM zq UNION ALL SELECT test_id, rn, rule, round(z, 4) FROM zv")
ORACLE["w3_aberrant_breaths"] = sql(f"SELECT test_id, rn, {rnd('time_s', 'vo2_ml')} FROM zq WHERE z > 0.13")
CTE["runs"] = """
SELECT test_id, modality, sum(ch) OVER (PARTITION BY test_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run, level, time_s, ct FROM (
  SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY test_id ORDER BY rn) THEN 0 ELSE 1 END AS ch, count(*) OVER (PARTITION BY test_id) AS ct FROM (
    SELECT *, CASE WHEN n_speed > 0 THEN 'treadmill' ELSE 'cycling' END AS modality,
      CASE WHEN n_speed > 0 THEN round_even(speed_kmh / 0.5, 0) * 0.5 ELSE round_even(power_w / 5, 0) * 5 END AS level FROM p) WHERE level > 0)"""
CTE["runz"] = """
SELECT test_id, modality, CAST(run AS BIGINT) AS run, min(level) AS level, min(time_s) AS start_s, max(time_s) - min(time_s) AS duration_s, count(*) AS "rows", min(ct) AS ct
FROM runs GROUP BY test_id, modality, run"""
ORACLE["w4_intensity_runs"] = sql(f"""SELECT test_id, modality, run, {rnd('level', 'start_s', 'duration_s')}, "rows" FROM runz""")


def threshold_ctes(x: str, source: str) -> None:
    s = {"vo2_s": "vo2_ml", "vco2_s": "vco2_ml", "ve_s": "ve_l", "peto2_s": "peto2_mmhg", "petco2_s": "petco2_mmhg"}
    gap = "CASE WHEN interval_s > 0 THEN interval_s ELSE 1 END"
    CTE[x + "s0"] = f"SELECT *, CAST(least(greatest(5, round_even(30 / {gap}, 0)), n // 2) AS BIGINT) AS k FROM {source} WHERE n >= 20"
    cols = ", ".join(f"CASE WHEN k >= 5 THEN {roll(c)} ELSE {c} END AS {a}" for a, c in s.items())
    CTE[x + "s1"] = f"SELECT test_id, rn, n, {cols} FROM {x}s0"
    CTE[x + "s"] = f"SELECT *, ve_s * 1000 / nullif(vo2_s, 0) AS ve_vo2_s, ve_s * 1000 / nullif(vco2_s, 0) AS ve_vco2_s FROM {x}s1"
    for c, up in (("ve_vo2_s", True), ("ve_vco2_s", True), ("peto2_s", True), ("petco2_s", False)):
        turn, worst = ("min", "min") if up else ("max", "max")
        test = f"wc >= tv * 1.05" if up else f"wc <= tv * 0.95"
        CTE[x + "r_" + c] = f"""
SELECT t.test_id, min(rn) FILTER (hit) AS row, min(vo2_s) FILTER (hit AND rn = first) AS vo2 FROM (
  SELECT *, min(rn) FILTER (hit) OVER (PARTITION BY test_id) AS first FROM (
    SELECT a.test_id, a.rn, a.vo2_s, n >= 10 AND a.rn > trow AND ct = 5 AND {test} AS hit FROM (
      SELECT *, {worst}({c}) OVER f AS wc, count({c}) OVER f AS ct FROM {x}s WINDOW f AS (PARTITION BY test_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) a
    LEFT JOIN (SELECT test_id, min(tv) AS tv, min(rn) AS trow FROM (SELECT test_id, rn, {c} AS v, {turn}({c}) OVER (PARTITION BY test_id) AS tv FROM {x}s) WHERE v = tv GROUP BY test_id) b
      ON b.test_id = a.test_id)) t
GROUP BY t.test_id"""
    CTE[x + "v"] = f"""
SELECT test_id, vo2_s AS x, vco2_s AS y, row_number() OVER (PARTITION BY test_id ORDER BY vo2_s, rn) AS r, count(*) OVER (PARTITION BY test_id) AS m
FROM {x}s WHERE vo2_s IS NOT NULL AND vco2_s IS NOT NULL"""
    CTE[x + "cand"] = f"""
SELECT DISTINCT test_id, m, CAST(round_even(floor(m * CAST(0.2 AS DOUBLE)) + z * (floor(m * CAST(0.8 AS DOUBLE)) - floor(m * CAST(0.2 AS DOUBLE))) / 29, 0) AS BIGINT) AS c
FROM (SELECT DISTINCT test_id, m FROM {x}v WHERE m >= 20), range(30) t(z)"""
    side = lambda f: f"regr_syy(y, x) FILTER ({f}) - regr_sxy(y, x) FILTER ({f}) * regr_sxy(y, x) FILTER ({f}) / regr_sxx(y, x) FILTER ({f})"
    CTE[x + "sse"] = f"""
SELECT c.test_id, c.c, {side('r <= c.c')} + {side('r > c.c')} AS sse
FROM {x}cand c JOIN {x}v v ON v.test_id = c.test_id WHERE c.c >= 5 AND c.c <= c.m - 5 GROUP BY c.test_id, c.c"""
    CTE[x + "vs"] = f"""
SELECT q.test_id, q.c AS split_row, v.x AS v_slope_vo2, sse FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY sse, c) AS i FROM {x}sse) q
JOIN {x}v v ON v.test_id = q.test_id AND v.r = q.c WHERE i = 1"""
    for name, first, second in (("thr", ["vs", "r_ve_vo2_s"], ["r_ve_vco2_s"]), ("thr5", ["vs", "r_ve_vo2_s", "r_peto2_s"], ["r_ve_vco2_s", "r_petco2_s"]),
                                ("thr4", ["r_ve_vo2_s", "r_peto2_s"], ["r_ve_vco2_s", "r_petco2_s"])):
        label = {"vs": "v_slope", "r_ve_vo2_s": "ve_vo2", "r_peto2_s": "peto2", "r_ve_vco2_s": "ve_vco2", "r_petco2_s": "petco2"}
        value = {k: (f"{k}.v_slope_vo2" if k == "vs" else f"{k}.vo2") for k in label}
        joins = " ".join(f"LEFT JOIN {x}{k} {k} ON {k}.test_id = t.test_id" for k in first + second)
        med = lambda ks: f"list_aggregate([v FOR v IN [{', '.join(value[k] for k in ks)}] IF v IS NOT NULL], 'median')"
        named = lambda ks: "nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {value[k]} IS NOT NULL THEN '{label[k]}' END" for k in ks) + "), '')"
        cnt = lambda ks: " + ".join(f"CASE WHEN {value[k]} IS NOT NULL THEN 1 ELSE 0 END" for k in ks)
        CTE[x + name + "0"] = f"""
SELECT *, coalesce(v2 <= vt1_vo2, false) AS dropped FROM (
  SELECT t.test_id, {med(first)} AS vt1_vo2, {med(second)} AS v2, {named(first)} AS vt1_method, {named(second)} AS m2, {cnt(first)} AS c1, {cnt(second)} AS c2
  FROM (SELECT DISTINCT test_id FROM {source}) t {joins})"""
        CTE[x + name + "1"] = f"""
SELECT test_id, vt1_vo2, vt1_method, CASE WHEN NOT dropped THEN v2 END AS vt2_vo2, CASE WHEN NOT dropped THEN m2 END AS vt2_method,
  CASE c1 + CASE WHEN dropped THEN 0 ELSE c2 END WHEN 0 THEN 'unable' WHEN 1 THEN 'low' WHEN 2 THEN 'moderate' ELSE 'high' END AS confidence FROM {x}{name}0"""
        near = lambda t: f"""(SELECT test_id, hr_bpm, power_w FROM (SELECT s.test_id, hr_bpm, power_w, row_number() OVER (PARTITION BY s.test_id ORDER BY abs(vo2_ml - {t}), rn) AS i
    FROM {source} s JOIN {x}{name}1 q ON q.test_id = s.test_id WHERE {t} IS NOT NULL) WHERE i = 1)"""  # noqa: E731
        CTE[x + name] = f"""
SELECT t.test_id, vt1_vo2, a.hr_bpm AS vt1_hr, a.power_w AS vt1_power, vt1_method, vt2_vo2, c.hr_bpm AS vt2_hr, c.power_w AS vt2_power, vt2_method, confidence
FROM {x}{name}1 t LEFT JOIN {near('vt1_vo2')} a ON a.test_id = t.test_id LEFT JOIN {near('vt2_vo2')} c ON c.test_id = t.test_id"""


threshold_ctes("q", "p")
threshold_ctes("l", "lp")
CTE["ap"] = """
SELECT *, (t_last - t_first) / nullif(n - 1, 0) AS interval_s FROM (
  SELECT *, min(time_s) OVER w AS t_first, max(time_s) OVER w AS t_last, count(*) OVER w AS n, row_number() OVER (PARTITION BY test_id ORDER BY time_s) AS rn
  FROM avr WINDOW w AS (PARTITION BY test_id))"""
threshold_ctes("m", "ap")
THR = "test_id, " + rnd("vt1_vo2", "vt1_hr", "vt1_power") + ", vt1_method, " + rnd("vt2_vo2", "vt2_hr", "vt2_power") + ", vt2_method, confidence"
ORACLE["w5_sustained_rise"] = sql("""
SELECT a.test_id, a.row AS ve_vo2_s_row, round(a.vo2, 4) AS ve_vo2_s_vo2, c.row AS ve_vco2_s_row, round(c.vo2, 4) AS ve_vco2_s_vo2,
  e.row AS peto2_s_row, round(e.vo2, 4) AS peto2_s_vo2
FROM qr_ve_vo2_s a JOIN qr_ve_vco2_s c ON c.test_id = a.test_id JOIN qr_peto2_s e ON e.test_id = a.test_id""")
ORACLE["w6_sustained_drop"] = sql("SELECT test_id, row AS petco2_s_row, round(vo2, 4) AS petco2_s_vo2 FROM qr_petco2_s")
ORACLE["w7_v_slope"] = sql(f"SELECT test_id, split_row, {rnd('v_slope_vo2', 'sse', digits=2)} FROM qvs")
ORACLE["w8_time_to_peak"] = sql("""
SELECT test_id, round(time_s, 4) AS time_to_peak_s FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY vo2_ml DESC NULLS LAST, rn) AS i FROM pk1) WHERE i = 1""")
CTE["tail"] = f"""
SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY v IS NULL, rn) AS i, count(v) OVER (PARTITION BY test_id) AS m FROM (
  SELECT test_id, rn, n, {roll('vo2_ml', 'k', 'right')} AS v, {roll('power_w', 'k', 'right')} AS w FROM k9 WHERE n >= 60 AND k >= 5)
WHERE rn >= floor(n * CAST(0.8 AS DOUBLE))"""
CTE["plat"] = """
SELECT t.test_id, coalesce(flat, false) AS plateau_detected, delta AS plateau_delta FROM (SELECT DISTINCT test_id FROM b) t LEFT JOIN (
  SELECT test_id, CASE WHEN np >= 10 THEN pr > 10 AND vr < 150 ELSE rise < 150 AND rise >= 0 END AS flat, CASE WHEN np >= 10 THEN vr ELSE rise END AS delta FROM (
    SELECT test_id, count(v) AS nv, count(w) AS np, max(w) - min(w) AS pr, max(v) - min(v) AS vr, avg(v) FILTER (i > m // 2) - avg(v) FILTER (i <= m // 2) AS rise
    FROM tail GROUP BY test_id) WHERE nv >= 10) q ON q.test_id = t.test_id"""
ORACLE["w9_end_plateau"] = sql(f"SELECT test_id, plateau_detected, {rnd('plateau_delta')} FROM plat")
ORACLE["j8_compose_record"] = sql("""
SELECT tst.test_id, protocol, name, round(vo2_peak, 4) AS vo2_peak, round(plateau_delta, 4) AS plateau_delta, n_stages
FROM tst LEFT JOIN part ON part.test_id = tst.test_id LEFT JOIN pk ON pk.test_id = tst.test_id LEFT JOIN plat ON plat.test_id = tst.test_id
LEFT JOIN (SELECT test_id, count(*) AS n_stages FROM t30 GROUP BY test_id) s ON s.test_id = tst.test_id""")
ORACLE["w10_stage_plateau"] = sql("""
SELECT test_id, round(vi, 4) AS vo2_increase, round(pi, 4) AS power_increase, vi < 150 AND pi > 0 AS plateau FROM (
  SELECT test_id, v - lag(v) OVER w AS vi, pw - lag(pw) OVER w AS pi, row_number() OVER (PARTITION BY test_id ORDER BY pstage DESC) AS i, count(*) OVER (PARTITION BY test_id) AS c
  FROM (SELECT test_id, pstage, avg(vo2_ml) AS v, avg(power_w) AS pw FROM step GROUP BY test_id, pstage) WINDOW w AS (PARTITION BY test_id ORDER BY pstage)) WHERE i = 1 AND c >= 2""")
for name, source in (("w11_stages_step", "step"), ("w12_stages_ramp", "rstep")):
    ORACLE[name] = sql(f"""SELECT test_id, rn, round(level, 4) AS power_rounded, stage, {NAME} AS stage_name FROM (SELECT *, CAST(pstage AS INTEGER) AS stage FROM {source})""")
ORACLE["w13_stages_phase"] = sql("SELECT test_id, rn, stage, stage_name FROM hstg")
ORACLE["w14_stages_time"] = sql(f"SELECT test_id, rn, stage, {NAME} AS stage_name FROM (SELECT *, CAST(greatest(ceil((time_s - t_first) / 60), 1) AS INTEGER) AS stage FROM p)")
ORACLE["w15_breath_interval"] = sql("""
SELECT test_id, round(avg(d), 4) AS interval_s FROM (SELECT test_id, time_s - lag(time_s) OVER (PARTITION BY test_id ORDER BY rn) AS d FROM b) GROUP BY test_id""")

# --------------------------------------------------------------- sorts, sets

ORACLE["t1_time_order"] = sql(f"SELECT test_id, rn, n + 1 - rn AS from_end, {rnd('time_s')} FROM b")
ORACLE["t2_vo2_order"] = sql(f"SELECT test_id, rn, row_number() OVER (PARTITION BY test_id ORDER BY vo2_ml, rn) AS vo2_rank, {rnd('vo2_ml')} FROM b")
ORACLE["t3_last_two_stages"] = sql("""
SELECT test_id, stage, round(vo2_ml, 4) AS vo2_ml, back FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY stage DESC) AS back FROM tmean) WHERE back <= 2""")
ORACLE["t4_extreme_rows"] = sql("""
SELECT test_id, round(max(time_s) FILTER (i = 1), 4) AS t_low, round(max(time_s) FILTER (j = 1), 4) AS t_high FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY ve_l, rn) AS i, row_number() OVER (PARTITION BY test_id ORDER BY ve_l DESC, rn) AS j FROM b) GROUP BY test_id""")
ORACLE["t5_reference_row"] = sql("""
SELECT test_id, stage, round(vo2_ml, 4) AS vo2_ml, round(rer, 4) AS rer FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY stage) AS i FROM hmean) WHERE i = 2""")
ORACLE["u1_append_rows"] = sql("""
SELECT test_id, max(power_w) AS max_power, CAST(NULL AS DOUBLE) AS max_speed FROM b WHERE power_w IS NOT NULL GROUP BY test_id
UNION ALL SELECT test_id, NULL, max(speed_kmh) FROM b WHERE speed_kmh IS NOT NULL GROUP BY test_id""")

# -------------------------------------------------------------------- composites

CTE["valid"] = f"""
SELECT len.test_id, concat_ws(',', nullif({codes(('n_breaths < 10', 'too_few_breaths'))}, ''), nullif({codes(*RANGE_ERRORS)}, '')) AS errors,
  concat_ws(',', nullif({codes(('duration_min < 5', 'short_test'))}, ''), nullif({codes(*REST_WARNINGS).replace('weight_kg', 'rst.weight_kg')}, ''), nullif({codes(*RANGE_WARNINGS)}, ''),
    CASE WHEN na * 100 / n_breaths > 5 THEN 'many_aberrant' END, CASE WHEN pct_missing_hr > 10 THEN 'hr_missing' END) AS warnings,
  concat_ws(',', 'test_duration', nullif({codes(*REST_INFO)}, ''), nullif({codes(*RANGE_INFO)}, ''),
    CASE WHEN na > 0 AND na * 100 / n_breaths <= 5 THEN 'some_aberrant' END, CASE WHEN nh = 0 THEN 'no_hr' END, CASE WHEN pct_missing_power > 10 THEN 'power_missing' END,
    'rer_effort_' || rer_effort, 'hr_effort_' || hr_effort) AS info,
  duration_min, na AS n_aberrant, na * 100 / n_breaths AS pct_aberrant
FROM len JOIN rst ON rst.test_id = len.test_id JOIN phy ON phy.test_id = len.test_id JOIN eff ON eff.test_id = len.test_id
JOIN (SELECT test_id, nh, pct_missing_hr, pct_missing_power FROM miss) mi ON mi.test_id = len.test_id
JOIN (SELECT test_id, count(*) FILTER (z > 3) AS na FROM zv GROUP BY test_id) za ON za.test_id = len.test_id"""
ORACLE["c1_validate"] = sql(f"SELECT test_id, errors = '' AS is_valid, errors, warnings, info, {rnd('duration_min')}, n_aberrant, {rnd('pct_aberrant')} FROM valid")
ORACLE["c2_average"] = sql("""
SELECT test_id, round(avg(time_s), 4) AS time_s, round(avg(vo2_ml), 4) AS vo2_ml, count(*) AS n_breaths, true AS is_averaged,
  CAST(60 AS DOUBLE) AS averaging_window, 'time' AS averaging_method, true AS reaveraged
FROM (SELECT test_id, avg(time_s) AS time_s, avg(vo2_ml) AS vo2_ml FROM b GROUP BY test_id, floor(time_s / 20)) GROUP BY test_id, floor(time_s / 60)""")
ORACLE["c3_detect_thresholds"] = sql(f"SELECT {THR} FROM qthr5")
ORACLE["c3_default_thresholds"] = sql(f"SELECT {THR} FROM qthr")
ORACLE["c4_extract_stages"] = sql("SELECT test_id, rn, stage, stage_name FROM stg")
ORACLE["c4_extract_stages_ramp"] = sql("SELECT test_id, rn, stage, stage_name FROM rstg")
CTE["conf"] = """
SELECT t.test_id, t.modality, CASE WHEN c >= 2 THEN f END AS starting_intensity,
  CASE WHEN c >= 2 THEN greatest(coalesce(round_even(ri / unit, 0) * unit, unit), unit) END AS increment_size,
  CASE WHEN c >= 2 THEN greatest(round_even(du / 30, 0) * 30, 60) END AS stage_duration_s
FROM (SELECT test_id, CASE WHEN max(speed_kmh) > 0 THEN 'treadmill' WHEN max(power_w) > 0 THEN 'cycling' ELSE 'other' END AS modality,
    CASE WHEN max(speed_kmh) > 0 THEN 0.5 ELSE 5.0 END AS unit FROM b GROUP BY test_id) t
LEFT JOIN (SELECT test_id, count(*) AS c, arg_min(level, run) AS f, median(duration_s) AS du, median(CASE WHEN d > 0 THEN d END) AS ri FROM (
    SELECT *, level - lag(level) OVER (PARTITION BY test_id ORDER BY run) AS d FROM runz WHERE duration_s > 30 AND ct >= 10) GROUP BY test_id) q ON q.test_id = t.test_id"""
ORACLE["c5_protocol_config"] = sql(f"SELECT test_id, modality, {rnd('starting_intensity', 'increment_size', 'stage_duration_s')} FROM conf")
CTE["crit"] = """
SELECT *, met AS criteria_met, met >= 3 OR (met >= 2 AND rer_met) AS is_maximal,
  CASE WHEN met >= 3 THEN 'maximal' WHEN met = 2 AND rer_met THEN 'likely_maximal' WHEN met >= 1 THEN 'submaximal' ELSE 'indeterminate' END AS determination FROM (
  SELECT *, list_sum([CAST(coalesce(f, false) AS INTEGER) FOR f IN [rer_met, hr_met, plateau_met, rpe_met, lactate_met]]) AS met,
    len([f FOR f IN [rer_met, hr_met, plateau_met, rpe_met, lactate_met] IF f IS NOT NULL]) AS criteria_available FROM (
    SELECT phy.test_id, rer_max AS peak_rer, hr_max AS peak_hr, plateau_detected, plateau_delta, rpe, lactate, CASE WHEN hr_max IS NOT NULL THEN 220 - age END AS predicted_hr_max,
      hr_max * 100 / (220 - age) AS hr_pct_predicted, rer_max >= 1.1 AS rer_met, hr_max * 100 / (220 - age) >= 85 AS hr_met, plateau_detected AS plateau_met,
      rpe >= 17 AS rpe_met, lactate >= 8 AS lactate_met
    FROM phy JOIN plat ON plat.test_id = phy.test_id LEFT JOIN rep ON rep.test_id = phy.test_id))"""
ORACLE["c6_maximal_criteria"] = sql(f"""
SELECT test_id, {rnd('peak_rer', 'peak_hr')}, plateau_detected, {rnd('plateau_delta')}, rpe, lactate, {rnd('predicted_hr_max', 'hr_pct_predicted')}, rer_met, hr_met, plateau_met,
  rpe_met, lactate_met, CAST(criteria_met AS INTEGER) AS criteria_met, CAST(criteria_available AS INTEGER) AS criteria_available, is_maximal, determination FROM crit""")
CTE["prot"] = """
SELECT *, CASE WHEN slope_acceptable THEN 25 WHEN slope_acceptable IS NOT NULL THEN 10 ELSE 15 END + CASE WHEN r_squared_acceptable THEN 25 WHEN r_squared IS NOT NULL THEN 10 ELSE 15 END
  + CASE WHEN stage_cv_acceptable THEN 15 WHEN stage_cv IS NOT NULL THEN 5 ELSE 10 END + CASE WHEN duration_optimal THEN 20 ELSE 10 END + CASE WHEN warmup_adequate THEN 15 ELSE 5 END AS protocol_score
FROM (
  SELECT md.test_id, modality, CASE WHEN cyc THEN 10.0 END AS expected_slope, CASE WHEN cyc THEN slope END AS slope, CASE WHEN cyc THEN r_squared END AS r_squared,
    CASE WHEN cyc THEN slope_deviation_pct END AS slope_deviation_pct, CASE WHEN cyc THEN abs(slope_deviation_pct) <= 15 END AS slope_acceptable, n_stages, stage_cv, exercise_s, warmup_s, test_s,
    coalesce(CASE WHEN cyc THEN r_squared END >= 0.9, false) AS r_squared_acceptable, coalesce(stage_cv <= 10, false) AS stage_cv_acceptable,
    coalesce(exercise_s BETWEEN 480 AND 720, false) AS duration_optimal, coalesce(warmup_s >= 120, false) AS warmup_adequate
  FROM (SELECT *, modality = 'cycling' AS cyc FROM md) md LEFT JOIN reg ON reg.test_id = md.test_id LEFT JOIN cons ON cons.test_id = md.test_id LEFT JOIN dur ON dur.test_id = md.test_id)"""
RATE = "CASE WHEN {s} >= 90 THEN 'excellent' WHEN {s} >= 75 THEN 'good' WHEN {s} >= 60 THEN 'acceptable' ELSE 'poor' END"
ORACLE["c7_protocol_quality"] = sql(f"""
SELECT test_id, modality, CAST(expected_slope AS DOUBLE) AS expected_slope, {rnd('slope', 'r_squared', 'slope_deviation_pct')}, slope_acceptable, n_stages, {rnd('stage_cv', 'exercise_s', 'warmup_s', 'test_s')},
  r_squared_acceptable, stage_cv_acceptable, duration_optimal, warmup_adequate, protocol_score, {RATE.format(s='protocol_score')} AS protocol_rating FROM prot""")


def data_scores(ab: str, hr: str, power: str, cv: str, drift: str) -> tuple[str, str, str]:
    signal = f"greatest(100 - {steps(ab, (10, 40), (5, 20), (2, 10))} - {steps(hr, (20, 30), (10, 15), (5, 5))} - {steps(cv, (20, 30), (15, 20), (10, 10))}, 0)"
    overall = (f"greatest(100 - {steps(ab, (10, 30), (5, 15), (2, 5))} - {steps(hr, (20, 25), (10, 15), (5, 5))} - {steps(power, (20, 15), (10, 10), (5, 5))}"
               f" - {steps(cv, (20, 20), (15, 15), (10, 10))} - CASE WHEN {drift} THEN 10 ELSE 0 END, 0)")
    advice = "coalesce(nullif(" + codes((f"{ab} > 5", "filter_aberrant_breaths"), (f"{hr} > 10", "check_hr_monitor"), (f"{power} > 10", "check_ergometer"),
                                        (f"{cv} > 15", "stabilise_baseline"), (drift, "recalibrate")) + ", ''), 'acceptable')"
    return signal, overall, advice


_sig, _all, _adv = data_scores("pct_aberrant", "pct_missing_hr", "pct_missing_power", "baseline_cv", "drift_detected")
CTE["dat"] = f"""
SELECT *, {_sig} AS signal_score, {_all} AS data_score, {_adv} AS recommendations FROM (
  SELECT miss.test_id, n_breaths, na AS n_aberrant, na * 100 / n_breaths AS pct_aberrant, pct_missing_hr, pct_missing_power, baseline_cv, coalesce(baseline_cv <= 10, false) AS baseline_stable, drift_detected
  FROM miss JOIN base ON base.test_id = miss.test_id JOIN drift ON drift.test_id = miss.test_id
  JOIN (SELECT test_id, count(*) FILTER (z > 3) AS na FROM zq GROUP BY test_id) za ON za.test_id = miss.test_id)"""
ORACLE["c8_data_quality"] = sql(f"""
SELECT test_id, n_breaths, n_aberrant, {rnd('pct_aberrant', 'pct_missing_hr', 'pct_missing_power', 'baseline_cv')}, baseline_stable, drift_detected, signal_score,
  {RATE.format(s='signal_score')} AS signal_rating, data_score, {RATE.format(s='data_score')} AS data_rating, recommendations FROM dat""")
ORACLE["odd_data_quality"] = odd(f"""
SELECT test_id, n_breaths, n_aberrant, {rnd('pct_aberrant', 'pct_missing_hr', 'pct_missing_power', 'baseline_cv')}, baseline_stable, drift_detected, signal_score,
  {RATE.format(s='signal_score')} AS signal_rating, data_score, {RATE.format(s='data_score')} AS data_rating, recommendations FROM dat""")
ORACLE["odd_thresholds"] = odd(f"SELECT {THR} FROM qthr4")
ORACLE["odd_calibration_drift"] = odd(f"SELECT test_id, n_rest, {rnd('rest_slope', 'p_value', digits=6)}, drift_detected FROM drift")
ORACLE["odd_aberrant_breaths"] = odd(f"SELECT test_id, rn, {rnd('time_s', 'vo2_ml')} FROM zq WHERE z > 3")
CTE["inp"] = """
SELECT c_custkey AS test_id, c_custkey % 12 AS ab, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 25 END AS hr, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 23 END AS power,
  c_custkey % 26 AS cv, c_custkey % 3 = 0 AS drift FROM customer"""
_sig, _all, _adv = data_scores("ab", "hr", "power", "cv", "drift")
ORACLE["c9_signal_score"] = sql(f"SELECT test_id, {_sig} AS score FROM inp")
ORACLE["c10_overall_data_score"] = sql(f"SELECT test_id, {_all} AS score FROM inp")
ORACLE["c11_recommendations"] = sql(f"SELECT test_id, {_adv} AS recommendations FROM inp")
CTE["xs"] = """
SELECT *, least(100, CASE determination WHEN 'maximal' THEN 100 WHEN 'likely_maximal' THEN 85 WHEN 'submaximal' THEN 60 ELSE 40 END
  + CASE WHEN peak_rer >= 1.15 THEN 5 ELSE 0 END + CASE WHEN hr_pct_predicted >= 95 THEN 5 ELSE 0 END) AS exercise_score FROM crit"""
CTE["grade"] = f"""
SELECT *, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (
  SELECT xs.test_id, determination, criteria_met, criteria_available, exercise_score, protocol_score, data_score,
    CAST(exercise_score AS DOUBLE) * CAST(0.4 AS DOUBLE) + CAST(protocol_score AS DOUBLE) * CAST(0.3 AS DOUBLE) + CAST(data_score AS DOUBLE) * CAST(0.3 AS DOUBLE) AS overall_score,
    {RATE.format(s='protocol_score')} AS protocol_rating, {RATE.format(s='data_score')} AS data_rating
  FROM xs JOIN prot ON prot.test_id = xs.test_id JOIN dat ON dat.test_id = xs.test_id)"""
ORACLE["c12_assess_quality"] = sql(f"SELECT test_id, exercise_score, protocol_score, data_score, {rnd('overall_score')}, grade, overall_score >= 60 AND data_rating <> 'poor' AS interpretable FROM grade")
ORACLE["c13_exercise_score"] = sql("SELECT test_id, determination, exercise_score FROM xs")
ORACLE["c14_quality_summary"] = sql("""
SELECT test_id, 'Grade ' || grade || ', ' || CASE WHEN grade IN ('A', 'B', 'C') THEN 'usable' WHEN grade = 'D' THEN 'use with care' ELSE 'do not rely on it' END
  || ': effort ' || determination || ' by ' || criteria_met || ' of ' || criteria_available || ' signs, recording ' || data_rating || ', course ' || protocol_rating AS summary FROM grade""")
CTE["eco"] = f"""
SELECT test_id, modality, 2 AS reference_stage, {GE.format(v='vo2_ml', w='pw', r='rer')} AS gross_efficiency, {RE.format(v='(vo2_ml / weight_kg)', s='sp')} AS running_economy, pw AS reference_power, sp AS reference_speed FROM (
  SELECT s.*, c.modality, weight_kg, CASE WHEN c.modality = 'cycling' AND power_w > 0 THEN power_w END AS pw,
    CASE WHEN c.modality = 'treadmill' AND coalesce(speed_kmh, starting_intensity + increment_size) > 0 THEN coalesce(speed_kmh, starting_intensity + increment_size) END AS sp
  FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY stage) AS i FROM s30) s JOIN conf c ON c.test_id = s.test_id JOIN part ON part.test_id = s.test_id WHERE i = 2)"""
ORACLE["c15_economy_metrics"] = sql(f"SELECT test_id, modality, reference_stage, {rnd('gross_efficiency', 'running_economy', 'reference_power', 'reference_speed')} FROM eco")
CTE["cmp"] = f"""
SELECT pkw.*, pred_hr, pred_vo2, pred_vo2_kg, pred_ve, pred_power, pred_o2_pulse, weight_kg, norm_typical, norm_efficiency, sport,
  CASE WHEN sport = 'cycling' AND norm_efficiency IS NOT NULL THEN {GE.format(v='vo2_peak', w='power_peak', r='rer_peak')} END AS ge
FROM pkw JOIN pred ON pred.test_id = pkw.test_id JOIN nrm ON nrm.test_id = pkw.test_id"""
CTE["every"] = """
SELECT pred.test_id, weight_kg, vo2_peak, vo2_kg_peak, ve_peak, hr_peak, rer_peak, power_peak, pred_hr, pred_vo2, pred_ve, pred_power
FROM pred LEFT JOIN pkw ON pkw.test_id = pred.test_id"""
ORACLE["c16_compare_with_norms"] = sql("""
SELECT test_id, parameter, pct_predicted, series, round(value, 4) AS value FROM (
  SELECT test_id, 'vo2max_kg' AS parameter, round_even(vo2_kg_peak * 100 / pred_vo2_kg, 0) AS pct_predicted, 'measured' AS series, vo2_kg_peak AS value FROM cmp
  UNION ALL SELECT test_id, 'vo2max_kg', round_even(vo2_kg_peak * 100 / pred_vo2_kg, 0), 'predicted', pred_vo2_kg FROM cmp
  UNION ALL SELECT test_id, 'vo2max_kg', round_even(vo2_kg_peak * 100 / pred_vo2_kg, 0), 'norm', norm_typical FROM cmp WHERE sport IS NOT NULL
  UNION ALL SELECT test_id, 'gross_efficiency', NULL, 'measured', ge FROM cmp
  UNION ALL SELECT test_id, 'gross_efficiency', NULL, 'norm', norm_efficiency FROM cmp WHERE ge IS NOT NULL) WHERE value IS NOT NULL""")
ORACLE["c17_summary_table"] = sql("""
SELECT test_id, parameter, value, predicted, round_even(value * 100 / predicted, 0) AS pct_predicted FROM (
  SELECT test_id, 'vo2_peak' AS parameter, round_even(vo2_peak, 0) AS value, round_even(pred_vo2, 0) AS predicted FROM every
  UNION ALL SELECT test_id, 'vo2_kg_peak', round_even(vo2_kg_peak, 1), round_even(pred_vo2 / weight_kg, 1) FROM every
  UNION ALL SELECT test_id, 've_peak', round_even(ve_peak, 1), round_even(pred_ve, 0) FROM every
  UNION ALL SELECT test_id, 'hr_peak', round_even(hr_peak, 0), round_even(pred_hr, 0) FROM every
  UNION ALL SELECT test_id, 'rer_peak', round_even(rer_peak, 2), NULL FROM every
  UNION ALL SELECT test_id, 'power_peak', round_even(power_peak, 0), round_even(pred_power, 0) FROM every)""")
COLOUR = "CASE WHEN {v} >= 100 THEN 'green' WHEN {v} >= 85 THEN 'blue' WHEN {v} >= 70 THEN 'amber' WHEN {v} >= 50 THEN 'orange' ELSE 'red' END"
CTE["gau"] = """
SELECT *, v IS NOT NULL AS known FROM (SELECT test_id, hr_peak, rer_peak AS r, round_even(vo2_peak * 100 / pred_vo2, 0) AS v,
  CASE WHEN vo2_peak IS NOT NULL THEN coalesce(round_even(hr_peak * 100 / pred_hr, 0), 0) END AS h FROM every)"""
CTE["gauges"] = f"""
SELECT test_id, CASE WHEN NOT known THEN 'insufficient_data' WHEN v >= 100 THEN 'aerobic_excellent' WHEN v >= 85 THEN 'aerobic_normal' WHEN v >= 70 THEN 'aerobic_mildly_reduced' WHEN v >= 50 THEN 'aerobic_moderately_reduced' ELSE 'aerobic_severely_reduced' END AS aerobic_rating,
  CASE WHEN NOT known THEN 'gray' ELSE {COLOUR.format(v='v')} END AS aerobic_color, CASE WHEN known THEN least(v, 100) ELSE 0 END AS aerobic_percent,
  CASE WHEN NOT known THEN 'insufficient_data' WHEN hr_peak IS NULL THEN 'hr_not_available' WHEN h >= 95 THEN 'hr_maximal' WHEN h >= 85 THEN 'hr_adequate' ELSE 'hr_submaximal' END AS cardiovascular_rating,
  CASE WHEN NOT known OR hr_peak IS NULL THEN 'gray' ELSE {COLOUR.format(v='h')} END AS cardiovascular_color, CASE WHEN known THEN least(h, 100) ELSE 0 END AS cardiovascular_percent,
  CASE WHEN NOT known THEN 'insufficient_data' WHEN r >= 1.15 THEN 'rer_maximal' WHEN r >= 1.1 THEN 'rer_near_maximal' WHEN r >= 1 THEN 'rer_submaximal' ELSE 'rer_inconclusive' END AS ventilatory_rating,
  CASE WHEN NOT known THEN 'gray' WHEN r >= 1.15 THEN 'green' WHEN r >= 1.1 THEN 'amber' WHEN r >= 1 THEN 'red' ELSE 'gray' END AS ventilatory_color,
  CASE WHEN known AND r IS NOT NULL THEN least(100, greatest(0, round_even((r - 0.7) / 0.6 * 100, 0))) ELSE 0 END AS ventilatory_percent, v AS vo2_pct, h AS hr_pct,
  CASE WHEN known THEN coalesce(r >= 1.1, false) END AS rer_reached,
  CASE WHEN NOT known THEN 'There are no peak values to judge.' ELSE concat_ws(' ', 'Oxygen uptake peaked at ' || CAST(v AS INTEGER) || ' % of what was predicted.',
    CASE WHEN h > 0 THEN 'The heart rate rose to ' || CAST(h AS INTEGER) || ' % of its predicted limit.' END,
    CASE WHEN r >= 1.1 THEN printf('With an RER of %.2f at the peak, the person went to the limit.', r) WHEN r IS NOT NULL THEN printf('The RER went up to %.2f only.', r) END) END AS sentence
FROM gau"""
ORACLE["c18_interpretation_gauges"] = sql("SELECT * FROM gauges")
ORACLE["c19_interpretation_codes"] = sql("""
SELECT i.*, coalesce(a.fr, '') AS aerobic_text, coalesce(c.fr, '') AS cardiovascular_text, coalesce(e.fr, '') AS ventilatory_text FROM (
SELECT test_id, CASE WHEN v IS NULL THEN 'insufficient_data' WHEN v >= 100 THEN 'capacity_normal_to_elevated' WHEN v >= 85 THEN 'capacity_within_normal_limits'
    WHEN v >= 70 THEN 'capacity_mildly_reduced' WHEN v >= 50 THEN 'capacity_moderately_reduced' ELSE 'capacity_severely_reduced' END AS aerobic,
  CASE WHEN v IS NULL THEN NULL WHEN h >= 95 THEN 'heart_maximal' WHEN h >= 85 THEN 'heart_adequate' WHEN h IS NOT NULL THEN 'heart_submaximal' END AS cardiovascular,
  CASE WHEN v IS NULL THEN NULL WHEN rer_peak >= 1.15 THEN 'effort_maximal' WHEN rer_peak >= 1.1 THEN 'effort_near_maximal' WHEN rer_peak IS NOT NULL THEN 'effort_possibly_submaximal' END AS ventilatory
FROM (SELECT *, vo2_peak * 100 / pred_vo2 AS v, hr_peak * 100 / pred_hr AS h FROM every)) i
LEFT JOIN lab a ON a.key = aerobic LEFT JOIN lab c ON c.key = cardiovascular LEFT JOIN lab e ON e.key = ventilatory""")
CTE["dtype"] = """
SELECT test_id, n >= 10 AND gaps >= 5 AND cv < 0.05 AND abs(mid - w) < 1 AS ok, w FROM (
  SELECT *, (SELECT w FROM (VALUES (5), (10), (15), (20), (30)) v(w) ORDER BY abs(w - mid), w LIMIT 1) AS w FROM (
    SELECT test_id, count(*) AS n, count(g) AS gaps, median(g) AS mid, stddev_samp(g) / avg(g) AS cv FROM (
      SELECT test_id, CASE WHEN d > 0 AND d < 60 THEN d END AS g FROM (
        SELECT test_id, time_s - lag(time_s) OVER (PARTITION BY test_id ORDER BY rn) AS d FROM b)) GROUP BY test_id))"""
ORACLE["c20_report_record"] = sql(f"""
SELECT tst.test_id, part.participant_id, part.name, CAST(NULL AS VARCHAR) AS date_of_birth, test_date, regexp_replace(protocol, '^_+', '') AS protocol, device, coalesce(technician, '-') AS technician, part.age,
  CASE part.sex WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' ELSE 'other' END AS sex_label, part.height_cm, part.weight_kg,
  round(round_even(part.weight_kg / ((part.height_cm / 100) * (part.height_cm / 100)), 1), 4) AS bmi, coalesce(part.sport, conf.modality, '-') AS sport_shown,
  CASE WHEN tl IS NOT NULL THEN {DURATION.format(t='tl')} END AS test_duration,
  round_even(vo2_peak, 0) AS vo2_abs, round_even(vo2_kg_peak, 1) AS vo2_rel, round_even(pred_vo2, 0) AS vo2_predicted, round_even(pred_vo2 / part.weight_kg, 1) AS vo2_rel_predicted,
  round_even(vo2_peak * 100 / pred_vo2, 0) AS vo2_percent, round_even(ve_peak, 1) AS ve, round_even(pred_ve, 0) AS ve_predicted, round_even(ve_peak * 100 / pred_ve, 0) AS ve_percent,
  round_even(hr_peak, 0) AS hr, round_even(pred_hr, 0) AS hr_predicted, round_even(hr_peak * 100 / pred_hr, 0) AS hr_percent, round_even(rer_peak, 2) AS rer,
  CASE WHEN tm AND speed_peak IS NOT NULL THEN round_even(speed_peak, 1) ELSE round_even(power_peak, 0) END AS power_or_speed,
  CASE WHEN NOT (tm AND speed_peak IS NOT NULL) THEN round_even(power_peak / part.weight_kg, 1) END AS power_per_kg,
  CASE WHEN NOT tm THEN round_even(pred_power, 0) END AS power_predicted, CASE WHEN NOT tm THEN round_even(power_peak * 100 / pred_power, 0) END AS power_percent,
  CASE WHEN hr_peak > 0 THEN round_even(vo2_peak / hr_peak, 1) END AS o2_pulse, round_even(pred_o2_pulse, 1) AS o2_pulse_predicted,
  CASE WHEN hr_peak > 0 THEN round_even(vo2_peak / hr_peak * 100 / pred_o2_pulse, 0) END AS o2_pulse_percent,
  vt1_vo2 IS NOT NULL AS thresholds_detected, round_even(vt1_vo2, 0) AS vt1_vo2, round_even(vt1_vo2 * 100 / vo2_peak, 0) AS vt1_percent, round_even(vt1_hr, 0) AS vt1_hr,
  round_even(vt1_power, 0) AS vt1_power, round_even(vt2_vo2, 0) AS vt2_vo2, round_even(vt2_vo2 * 100 / vo2_peak, 0) AS vt2_percent, round_even(vt2_hr, 0) AS vt2_hr, round_even(vt2_power, 0) AS vt2_power,
  vt1_method AS threshold_method, CASE WHEN vt1_vo2 IS NOT NULL THEN confidence END AS threshold_confidence,
  true AS has_pretest, nutritional_state, fatigue_state, last_meal_hours, CAST(NULL AS VARCHAR) AS medications, caffeine_mg, caffeine_mg > 0 AS had_caffeine, CAST(NULL AS VARCHAR) AS clinical_notes,
  CAST(NULL AS VARCHAR) AS equipment, CAST(NULL AS VARCHAR) AS analyzer, CAST(NULL AS DOUBLE) AS starting_grade, CAST(NULL AS DOUBLE) AS grade_increment, conf.test_id IS NOT NULL AS has_protocol_details, conf.modality,
  CASE WHEN conf.test_id IS NOT NULL THEN CASE WHEN tm THEN 'km/h' ELSE 'W' END END AS intensity_unit, starting_intensity, CAST(increment_size AS DOUBLE) AS increment_size, CAST(stage_duration_s AS DOUBLE) AS stage_duration_s,
  coalesce(n_stages > 0, false) AS has_stage_table, eco.test_id IS NOT NULL AS has_economy, reference_stage AS economy_stage, {rnd('reference_power', 'reference_speed').replace('AS reference_', 'AS economy_')}, gross_efficiency, running_economy,
  aerobic_rating, aerobic_color, aerobic_percent, cardiovascular_rating, cardiovascular_color, cardiovascular_percent, ventilatory_rating, ventilatory_color, ventilatory_percent,
  CASE WHEN ok THEN 'time_averaged' ELSE 'breath_by_breath' END AS data_type, CASE WHEN ok THEN CAST(w AS DOUBLE) END AS data_window_s,
  concat_ws('; ', '{PREDICTION_SOURCE}', CASE WHEN part.sport IS NOT NULL THEN norm_source END, CASE WHEN part.sport IS NOT NULL THEN metric_source END) AS bibliography
FROM tst JOIN part ON part.test_id = tst.test_id JOIN pred ON pred.test_id = tst.test_id JOIN nrm ON nrm.test_id = tst.test_id JOIN pre ON pre.test_id = tst.test_id
LEFT JOIN (SELECT test_id, max(time_s) AS tl FROM b GROUP BY test_id) du ON du.test_id = tst.test_id LEFT JOIN pkw ON pkw.test_id = tst.test_id
LEFT JOIN qthr ON qthr.test_id = tst.test_id LEFT JOIN (SELECT *, modality = 'treadmill' AS tm0 FROM conf) conf ON conf.test_id = tst.test_id
LEFT JOIN (SELECT test_id, count(*) AS n_stages FROM s30 GROUP BY test_id) sc ON sc.test_id = tst.test_id LEFT JOIN eco ON eco.test_id = tst.test_id LEFT JOIN dtype ON dtype.test_id = tst.test_id
LEFT JOIN gauges ON gauges.test_id = tst.test_id
JOIN (SELECT t.test_id, coalesce(c.modality = 'treadmill', false) AS tm FROM tst t LEFT JOIN conf c ON c.test_id = t.test_id) tmm ON tmm.test_id = tst.test_id""")
ORACLE["c21_stage_table"] = sql(f"""
SELECT test_id, stage, {DURATION.format(t='duration_s')} AS duration, CASE WHEN power_w > 0 THEN round(power_w, 0) ELSE round(speed_kmh, 1) END AS intensity,
  CASE WHEN power_w > 0 THEN 'W' WHEN speed_kmh IS NOT NULL THEN 'km/h' END AS unit, round(hr_bpm, 0) AS hr, round(ve_l, 1) AS ve, round(vo2_ml, 0) AS vo2, round(rer, 2) AS rer FROM smean""")
ORACLE["c22_analysis"] = sql("""
SELECT tst.test_id, round(vo2_peak, 4) AS vo2_peak, round(vo2_kg_peak, 4) AS vo2_kg_peak, round(rer_peak, 4) AS rer_peak, round(vt1_vo2, 4) AS vt1_vo2, round(vt2_vo2, 4) AS vt2_vo2, confidence, n_stages,
  errors = '' AS is_valid
FROM tst LEFT JOIN pkw ON pkw.test_id = tst.test_id LEFT JOIN mthr ON mthr.test_id = tst.test_id LEFT JOIN valid ON valid.test_id = tst.test_id
LEFT JOIN (SELECT test_id, count(*) AS n_stages FROM s30 GROUP BY test_id) s ON s.test_id = tst.test_id""")

CTE["whole"] = """
SELECT tst.test_id, vo2_peak, vt1_vo2, errors, n_aberrant
FROM tst LEFT JOIN pkw ON pkw.test_id = tst.test_id LEFT JOIN mthr ON mthr.test_id = tst.test_id LEFT JOIN valid ON valid.test_id = tst.test_id"""
ORACLE["c22_batch_counters"] = sql("""
SELECT 'tests' AS counter, count(*) AS n FROM whole UNION ALL SELECT 'invalid', count(*) FROM whole WHERE errors <> ''
UNION ALL SELECT 'not_validated', count(*) FROM whole WHERE errors IS NULL UNION ALL SELECT 'without_peak', count(*) FROM whole WHERE vo2_peak IS NULL
UNION ALL SELECT 'without_threshold', count(*) FROM whole WHERE vt1_vo2 IS NULL UNION ALL SELECT 'aberrant', CAST(coalesce(sum(n_aberrant), 0) AS BIGINT) FROM whole
UNION ALL SELECT 'stages', count(*) FROM s30""")

# ------------------------------------------------------------------------- series

CTE["pan"] = """
SELECT d.*, coalesce(max(power_w) OVER w > 0, false) AS powered, count(hr_bpm) OVER w > 0 AS has_hr, CASE WHEN tl > 300 THEN time_s / 60 ELSE time_s END AS tp,
  CASE WHEN coalesce(max(power_w) OVER w > 0, false) THEN CASE WHEN power_w > 0 THEN power_w END ELSE CASE WHEN tl > 300 THEN time_s / 60 ELSE time_s END END AS xl
FROM disp d JOIN (SELECT test_id, max(time_s) AS tl FROM b GROUP BY test_id) q ON q.test_id = d.test_id WINDOW w AS (PARTITION BY d.test_id)"""
ORACLE["d1_panel_series"] = sql("""
SELECT test_id, CAST(panel AS INTEGER) AS panel, series, round(x, 4) AS x, round(y, 4) AS y FROM (
  SELECT test_id, 1 AS panel, 'o2_pulse' AS series, xl AS x, vo2_ml / hr_bpm AS y FROM pan UNION ALL SELECT test_id, 2, 'vo2', xl, vo2_ml FROM pan
  UNION ALL SELECT test_id, 3, 've', vco2_ml, ve_l FROM pan UNION ALL SELECT test_id, 4, 'vco2', vo2_ml, vco2_ml FROM pan
  UNION ALL SELECT test_id, 5, 've_vo2', vo2_ml, ve_l * 1000 / vo2_ml FROM pan UNION ALL SELECT test_id, 5, 've_vco2', vo2_ml, ve_l * 1000 / vco2_ml FROM pan
  UNION ALL SELECT test_id, 6, 'rer', vo2_ml, rer FROM pan UNION ALL SELECT test_id, 7, 'peto2', vo2_ml, peto2_mmhg FROM pan
  UNION ALL SELECT test_id, 7, 'petco2', vo2_ml, petco2_mmhg FROM pan UNION ALL SELECT test_id, 8, 'hr', xl, hr_bpm FROM pan UNION ALL SELECT test_id, 9, 've', tp, ve_l FROM pan)
WHERE x IS NOT NULL AND y IS NOT NULL""")
ORACLE["d1_peak_markers"] = sql(f"""
SELECT test_id, {rnd('time_s', 'power_w', 'vo2_peak', 'hr_peak')} FROM (
  SELECT b.test_id, time_s, power_w, vo2_peak, hr_peak, row_number() OVER (PARTITION BY b.test_id ORDER BY abs(vo2_ml - vo2_peak), rn) AS i FROM b JOIN pk ON pk.test_id = b.test_id) WHERE i = 1""")
ORACLE["d2_v_slope_series"] = sql("""
SELECT test_id, series, round(x, 4) AS x, round(y, 4) AS y FROM (
  SELECT test_id, 'breath' AS series, vo2_ml AS x, vco2_ml AS y FROM b
  UNION ALL SELECT test_id, 'vt1', vt1_vo2, vco2_ml FROM (SELECT b.test_id, vt1_vo2, vco2_ml, row_number() OVER (PARTITION BY b.test_id ORDER BY abs(vo2_ml - vt1_vo2), rn) AS i
    FROM b JOIN qthr ON qthr.test_id = b.test_id WHERE vt1_vo2 IS NOT NULL) WHERE i = 1
  UNION ALL SELECT qthr.test_id, 'vt2', vt2_vo2, y FROM qthr JOIN (SELECT test_id, max(vco2_ml) AS y FROM b GROUP BY test_id) m ON m.test_id = qthr.test_id WHERE vt2_vo2 IS NOT NULL)""")
ORACLE["d3_ventilatory_series"] = sql("""
SELECT test_id, rn, round(time_s / 60, 4) AS x, 've_vo2' AS variable, round(ve_l * 1000 / vo2_ml, 4) AS value FROM b
UNION ALL SELECT test_id, rn, round(time_s / 60, 4), 've_vco2', round(ve_l * 1000 / vco2_ml, 4) FROM b""")
ORACLE["d4_gas_exchange_series"] = sql("""
SELECT b.test_id, rn, round(time_s / 60, 4) AS time_min, 'vo2' AS variable, round(vo2_ml / weight_kg, 4) AS value FROM b JOIN part ON part.test_id = b.test_id
UNION ALL SELECT test_id, rn, round(time_s / 60, 4), 'vco2', round(vco2_ml, 4) FROM b UNION ALL SELECT test_id, rn, round(time_s / 60, 4), 've', round(ve_l, 4) FROM b""")
CTE["gas"] = """
SELECT test_id, 'vo2' AS variable, time_s / 60 AS x, vo2_ml AS y FROM b WHERE vo2_ml IS NOT NULL UNION ALL SELECT test_id, 'vco2', time_s / 60, vco2_ml FROM b WHERE vco2_ml IS NOT NULL
UNION ALL SELECT test_id, 'rer', time_s / 60, rer FROM b WHERE rer IS NOT NULL"""
CTE["spots"] = """
SELECT * FROM (SELECT test_id, variable, CAST(floor(count(*) * 0.75 + 0.00001) AS BIGINT) AS q, min(x) AS lo, max(x) AS hi FROM gas GROUP BY test_id, variable), range(80) g(place) WHERE q >= 3"""
CTE["reached"] = """
SELECT gas.test_id, gas.variable, place, lo + (hi - lo) * place / 79 AS spot, x, y, q, abs(x - (lo + (hi - lo) * place / 79)) AS d
FROM gas JOIN spots ON spots.test_id = gas.test_id AND spots.variable = gas.variable"""
CTE["reach"] = "SELECT *, max(d) FILTER (k <= q) OVER (PARTITION BY test_id, variable, place) AS r FROM (SELECT *, row_number() OVER (PARTITION BY test_id, variable, place ORDER BY d) AS k FROM reached)"
CTE["sums"] = f"""
SELECT test_id, variable, place, spot, {', '.join(f'sum(w * u^{i}) AS s{i}' for i in range(5))}, {', '.join(f'sum(w * u^{i} * y) AS t{i}' for i in range(3))}
FROM (SELECT *, (1 - abs(u)^3)^3 AS w FROM (SELECT *, CASE WHEN r > 0 THEN (x - spot) / r WHEN x = spot THEN 0 END AS u FROM reach) WHERE abs(u) < 1) GROUP BY ALL"""
ORACLE["d4_smooth_curve"] = sql("""
SELECT test_id, variable, place::INTEGER AS place, round(spot, 4) AS x, round(CASE WHEN d3 > 1e-10 * s0^3 THEN (t0 * (s2 * s4 - s3^2) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / d3
  WHEN d2 > 1e-10 * s0^2 THEN (t0 * s2 - s1 * t1) / d2 ELSE t0 / s0 END, 4) AS y
FROM (SELECT *, s0 * (s2 * s4 - s3^2) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2^2) AS d3, s0 * s2 - s1^2 AS d2 FROM sums)""")
ORACLE["d5_heart_rate_series"] = sql("""
SELECT test_id, 'hr' AS series, round(time_s / 60, 4) AS x, round(hr_bpm, 4) AS y FROM b WHERE hr_bpm IS NOT NULL
UNION ALL SELECT test_id, 'zone_' || zone_pct, NULL, round(zone_bpm, 4) FROM zone""")
ORACLE["d6_power_series"] = sql("""
SELECT test_id, rn, round(time_s / 60, 4) AS time_min, round(power_w, 4) AS power_w, round(vo2_ml * scale + "offset", 4) AS vo2_scaled FROM axes WHERE scale IS NOT NULL""")

# --------------------------------------------------------------------- long tests

ORACLE["long_find_peaks"] = sql(f"SELECT test_id, {rnd(*PEAKS)} FROM lpk")
ORACLE["long_thresholds"] = sql(f"SELECT {THR} FROM lthr")
ORACLE["long_average_by_time"] = sql(binned("lb", "floor(time_s / 30)"))
