"""The scalar rules and heart rate zones as functions of SQL text.

``register`` creates them in a session from SQL, so that a query written as text can use them; they are inlined into the
plan like any expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, arguments, result, body.
SCALARS = [
    # P6
    ("running_economy", "vo2_kg DOUBLE, speed_kmh DOUBLE", "DOUBLE", "CASE WHEN speed_kmh > 0 AND vo2_kg >= 0 THEN bround(try_divide(vo2_kg, speed_kmh) * 60, 1) END"),
    # P7; fixed values as in ``scalars.gross_efficiency``
    ("gross_efficiency", "vo2_ml DOUBLE, power_w DOUBLE, rer DOUBLE", "DOUBLE",
     "CASE WHEN power_w > 0 AND vo2_ml > 0 AND rer IS NOT NULL THEN bround(try_divide(power_w, "
     "vo2_ml / 1000D * (4.69D + (least(greatest(rer, 0.70D), 1.10D) - 0.70D) * (5.05D - 4.69D) / 0.30D) * 69.78D) * 100, 1) END"),
    # P9
    ("age_group", "age DOUBLE", "STRING",
     "CASE WHEN age < 20 THEN 'junior' WHEN age >= 70 THEN '70+' WHEN age IS NOT NULL THEN concat(int(floor(age / 10)) * 10, '-', int(floor(age / 10)) * 10 + 9) END"),
    # P10
    ("score_rating", "score DOUBLE", "STRING", "CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'acceptable' ELSE 'poor' END"),
    # P14
    ("duration_text", "seconds DOUBLE", "STRING",
     "CASE WHEN seconds IS NOT NULL THEN format_string('%d:%02d', bigint(floor(seconds / 60)), bigint(rint(seconds - floor(seconds / 60) * 60))) END"),
]
TABLES = [
    # P15; fixed values: zone limits in percent
    ("heart_rate_zones", "age DOUBLE, peak_hr DOUBLE", "hr_reference DOUBLE, zone_pct INT, zone_bpm DOUBLE",
     "SELECT greatest(220D - age, peak_hr), z.pct, greatest(220D - age, peak_hr) * z.pct / 100 FROM (VALUES (50), (60), (70), (80), (90), (100)) AS z(pct) WHERE peak_hr IS NOT NULL"),
]


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session, in the place of earlier ones of these names; the names."""
    for name, given, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {body}")
    for name, given, result, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE ({result}) RETURN {body}")
    return [f[0] for f in SCALARS + TABLES]
