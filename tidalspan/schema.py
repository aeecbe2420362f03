"""Fixed schemas, column groups and range rules of the exercise-test data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

KEY = "test_id"

# Standard breath columns in their standard order.
REQUIRED = ["time_s", "vo2_ml", "vco2_ml", "ve_l", "rer"]
OPTIONAL_NUMERIC = [
    "hr_bpm", "power_w", "speed_kmh", "bf", "vt_l", "ve_vo2", "ve_vco2", "vo2_kg",
    "peto2_mmhg", "petco2_mmhg", "spo2_pct", "mets", "vo2_hr", "rpm",
]
TEXT = ["phase", "marker"]
NUMERIC = REQUIRED + OPTIONAL_NUMERIC

# Columns that the row layout adds; they are bookkeeping, never signals.
LAYOUT = ["rn", "n", "split", "chunk"]
PREPARED = ["t_first", "t_last", "interval", "n_hr", "n_power", "n_speed", "n_phase"]

PARTICIPANTS = T.StructType([
    T.StructField("test_id", T.LongType()),
    T.StructField("participant_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("sex", T.StringType()),
    T.StructField("height_cm", T.DoubleType()),
    T.StructField("weight_kg", T.DoubleType()),
    T.StructField("sport", T.StringType()),
    T.StructField("date_of_birth", T.DateType()),
])

TESTS = T.StructType([
    T.StructField("test_id", T.LongType()),
    T.StructField("test_date", T.DateType()),
    T.StructField("device", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("calibration_date", T.DateType()),
    T.StructField("temperature_c", T.DoubleType()),
    T.StructField("pressure_mmhg", T.DoubleType()),
    T.StructField("humidity_pct", T.DoubleType()),
    T.StructField("technician", T.StringType()),
])

BREATHS = T.StructType(
    [T.StructField("test_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in NUMERIC]
    + [T.StructField(c, T.StringType()) for c in TEXT]
)


def signals(df: DataFrame) -> list[str]:
    """Numeric signal columns (time excluded) present in ``df``, in standard order."""
    return [c for c in NUMERIC[1:] if c in df.columns]


def texts(df: DataFrame) -> list[str]:
    """Text columns present in ``df``, in standard order."""
    return [c for c in TEXT if c in df.columns]


def named(columns: dict[str, Column]) -> list[Column]:
    """Columns aliased to their keys."""
    return [c.alias(name) for name, c in columns.items()]
