"""Small hand-made tests in the breath schema."""

from __future__ import annotations

from tidalspan.schema import BREATHS

NUMBERS = {f.name for f in BREATHS.fields if f.name not in ("test_id", "phase", "marker")}


def breaths(spark, rows, test_id=1):
    """Breaths from dicts; required signals default to plausible constants."""
    filled = []
    for r in rows:
        r = {"test_id": test_id, "vo2_ml": 300.0, "vco2_ml": 250.0, "ve_l": 10.0, "rer": 0.83, **r}
        filled.append(tuple(
            float(r[f.name]) if f.name in NUMBERS and r.get(f.name) is not None else r.get(f.name) for f in BREATHS.fields
        ))
    return spark.createDataFrame(filled, BREATHS)


def people(spark, *rows):
    """Participants from (test_id, age, sex, height, weight)."""
    return spark.createDataFrame(
        [(i, f"P{i}", f"Name {i}", float(a), s, float(h), float(w), None, None) for i, a, s, h, w in rows],
        "test_id bigint, participant_id string, name string, age double, sex string, height_cm double, "
        "weight_kg double, sport string, level string",
    )


def column(df, name, order="rn"):
    return [r[name] for r in df.orderBy(order).collect()]


def near(values, digits=6):
    return [None if v is None else round(v, digits) for v in values]
