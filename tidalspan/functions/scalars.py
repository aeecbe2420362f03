"""Column expressions: derived values, formulas and rating bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null for a zero denominator."""
    return F.try_divide(top, bottom)


SETTLED = 5  # digits kept beyond the wanted ones before a tie is decided


def settled(value: Column, digits: int) -> Column:
    """Half to even on the decimal text, once the digits that hang on the order of a sum are rounded away.

    Null if the value is not finite or has more than 18 digits before the point.
    """
    return F.bround(F.round(value, digits + SETTLED).try_cast("decimal(38,20)"), digits).cast("double")


def ve_vo2() -> Column:
    """Ventilatory equivalent for oxygen."""
    return ratio(F.col("ve_l") * 1000, F.col("vo2_ml"))


def ve_vco2() -> Column:
    """Ventilatory equivalent for carbon dioxide."""
    return ratio(F.col("ve_l") * 1000, F.col("vco2_ml"))


def o2_pulse(vo2: Column, hr: Column) -> Column:
    """Oxygen uptake per heart beat."""
    return ratio(vo2, hr)


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    """P5: body mass index."""
    metres = height_cm / 100
    return ratio(weight_kg, metres * metres)


def running_economy(vo2_kg: Column, speed_kmh: Column) -> Column:
    """mL/kg/km to 1 decimal; null for speed <= 0 or VO2 < 0."""
    return F.when((speed_kmh > 0) & (vo2_kg >= 0), F.bround(ratio(vo2_kg, speed_kmh) * 60, 1))


def gross_efficiency(vo2_ml: Column, power_w: Column, rer: Column) -> Column:
    """Mechanical power as % of metabolic power, to 1 decimal.

    The caloric equivalent of oxygen is linear in RER, clamped to [0.70, 1.10].
    Null for power <= 0 or VO2 <= 0.
    """
    clamped = F.when(rer.isNotNull(), F.least(F.greatest(rer, F.lit(0.70)), F.lit(1.10)))
    # Kcal per litre at RER 0.70, its rise up to RER 1.00, watts per kcal/min.
    kcal_per_litre = F.lit(4.69) + (clamped - 0.70) * (5.05 - 4.69) / 0.30
    watts = vo2_ml / 1000 * kcal_per_litre * 69.78
    return F.when((power_w > 0) & (vo2_ml > 0), F.bround(ratio(power_w, watts) * 100, 1))


def predicted_values(
    age: Column, sex: Column, height_cm: Column, weight_kg: Column
) -> dict[str, Column]:
    """Predicted maxima.  Sex other than M uses the female branch.

    The power formula is implausibly high for most adults; it is kept as published.
    """
    male = sex == "M"
    hr = F.lit(208.0) - age * 0.7
    relative = F.when(male, F.lit(60.0) - age * 0.55).otherwise(F.lit(48.0) - age * 0.37)
    vo2 = relative * weight_kg
    factor = F.when(male, F.lit(20.0)).otherwise(F.lit(14.0))
    power = F.greatest((height_cm - 60) * factor - age * 2, F.lit(50.0))
    return {
        "pred_hr": hr,
        "pred_vo2_kg": relative,
        "pred_vo2": vo2,
        "pred_ve": vo2 / 1000 * 25,
        "pred_power": power,
        "pred_o2_pulse": ratio(vo2, hr),
    }


def age_group(age: Column) -> Column:
    """Age group of the reference tables."""
    decade = F.floor(age / 10).cast("int") * 10
    return (
        F.when(age < 20, "junior")
        .when(age >= 70, "70+")
        .when(age.isNotNull(), F.concat(decade.cast("string"), F.lit("-"), (decade + 9).cast("string")))
    )


def age_midpoint(group: Column) -> Column:
    """Representative age of an age group."""
    low = F.substring(group, 1, 2)
    return (
        F.when(group == "junior", 18)
        .when(group == "70+", 75)
        .when(group.isNotNull(), low.try_cast("int") + 5)
        .cast("int")
    )


def rating(score: Column, poor: str = "poor") -> Column:
    """P10: rating bin of a 0-100 score."""
    return (
        F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "acceptable").otherwise(poor)
    )


def test_modality(protocol: Column, n_power: Column, max_power: Column) -> Column:
    """Modality from the protocol name, else from recorded power."""
    name = F.lower(F.coalesce(protocol, F.lit("")))
    return (
        F.when(name.rlike("cycle|bike|ergometer|watt"), "cycling")
        .when(name.rlike("treadmill|bruce|balke|walk|run"), "treadmill")
        .when((n_power > 10) & (max_power > 20), "cycling")
        .otherwise("unknown")
    )


def economy_modality(protocol: Column, configured: Column) -> Column:
    """Modality for economy; a protocol configuration wins, default cycling."""
    name = F.lower(F.coalesce(protocol, F.lit("")))
    by_name = (
        F.when(name.rlike("treadmill|running|walk|bruce"), "treadmill")
        .when(name.rlike("cycle|bike|ergo|watt"), "cycling")
        .otherwise("cycling")
    )
    return F.coalesce(configured, by_name)


def duration_text(seconds: Column) -> Column:
    """``m:ss`` with floored minutes and rounded seconds."""
    minutes = F.floor(seconds / 60).cast("bigint")
    rest = F.rint(seconds - F.floor(seconds / 60) * 60).cast("bigint")
    return F.when(seconds.isNotNull(), F.format_string("%d:%02d", minutes, rest))


def tally(*penalties: Column) -> Column:
    """100 minus the penalties, not below 0."""
    score = F.lit(100)
    for p in penalties:
        score = score - p
    return F.greatest(score, F.lit(0))


def steps(value: Column, *limits: tuple[float, int]) -> Column:
    """Penalty of the first limit exceeded; 0 for null."""
    out = None
    for limit, penalty in limits:
        out = F.when(value > limit, penalty) if out is None else out.when(value > limit, penalty)
    return out.otherwise(0)
