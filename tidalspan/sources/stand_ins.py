"""Exercise tests derived from general tables.

No exercise-test table is at hand where these jobs are checked, so breaths,
participants and tests are derived from ``events`` / ``customer`` (one test per user)
and ``lineitem`` (one long test per supplier).  All constants are doubles and all
formulas use only + - * / and floor, so that another engine gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import index_rows
from ..schema import KEY


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _floor(c: Column) -> Column:
    return F.floor(c).cast("double")


def _signals(df: DataFrame, e: Column, tag: Column) -> DataFrame:
    """Breath signals from the position in the test, a noise value and a row tag."""
    layout = [c for c in ("rn", "n", "split", "chunk") if c in df.columns]
    test = F.col(KEY)
    u = F.try_divide((F.col("rn") - 1).cast("double"), (F.col("n") - 1).cast("double"))
    df = df.select(KEY, *layout, e.alias("e"), tag.alias("tag"), u.alias("u"))
    u, e = F.col("u"), F.col("e")
    treadmill = test % 3 == 0
    late = F.when(u > 0.55, u - 0.55).otherwise(F.lit(0.0))
    gain = F.lit(0.2) + (test % 8).cast("double") * 0.01
    df = df.withColumns({
        "time_s": ((F.col("rn") - 1) * (test % 7 + 6)).cast("double"),
        "vo2_ml": F.lit(300.0) + u * 2700.0 + (e - 0.5) * 40.0,
        "rer": F.lit(0.8) + gain * u + late * 0.15 + (e - 0.5) * 0.02,
    })
    df = df.withColumn("vco2_ml", F.col("vo2_ml") * F.col("rer"))
    df = df.withColumns({
        "ve_l": (F.lit(25.0) + (u - 0.7) * (u - 0.7) * 60.0) * F.col("vco2_ml") / 1000.0,
        "hr_bpm": F.when(~((F.col("tag") % 17 == 0) | (test % 10 == 0)), F.lit(70.0) + u * 120.0 + e * 2.0),
        "power_w": F.when(~treadmill, _floor(u * 12.0) * 25.0),
        "speed_kmh": F.when(treadmill, F.lit(6.0) + _floor(u * 16.0) * 0.5),
        "peto2_mmhg": F.lit(100.0) + (u - 0.5) * (u - 0.5) * 60.0,
        "petco2_mmhg": F.lit(40.0) - (u - 0.6) * (u - 0.6) * 30.0,
        "phase": F.when(
            test % 4 != 0, F.when(u < 0.3, "REST").when(u <= 0.9, "EXERCISE").otherwise("RECOVERY")
        ),
    })
    return df.select(
        KEY, *layout, "time_s", "vo2_ml", "vco2_ml", "ve_l", "rer", "hr_bpm", "power_w", "speed_kmh",
        "peto2_mmhg", "petco2_mmhg", "phase",
    )


def breaths(spark: SparkSession, folder: str) -> DataFrame:
    """One test per user of ``events``, rows in event order."""
    events = table(spark, folder, "events").select(F.col("user_id").alias(KEY), "event_id", "value")
    rows = index_rows(events, ["event_id"])
    return _signals(rows, F.col("value") - F.floor("value"), F.col("event_id"))


def odd_breaths(spark: SparkSession, folder: str) -> DataFrame:
    """The tests of ``breaths`` with three families of oddities among those divisible by three or five.

    Divisible by five: a spike in every 25th VO2.  By three and not five: no ventilatory thresholds, because ventilation
    follows VO2 in proportion and VCO2 rises ever less.  One more than a multiple of five: RER that drifts at rest.
    """
    df = breaths(spark, folder)
    key = F.col(KEY)
    spiked = F.when((key % 5 == 0) & (F.col("rn") % 25 == 13), F.col("vo2_ml") * 3).otherwise(F.col("vo2_ml"))
    flat = (key % 3 == 0) & (key % 5 != 0)
    drifting = (key % 5 == 1) & (F.col("phase") == "REST")
    odd = df.withColumns({
        "rer": F.when(drifting, F.col("rer") + F.col("time_s") * 0.004).otherwise(F.col("rer")),
        "vco2_ml": F.when(flat, F.col("vo2_ml") * (1.2 - F.col("vo2_ml") / 30000)).otherwise(F.col("vco2_ml")),
        "ve_l": F.when(flat, F.col("vo2_ml") * 0.025).otherwise(F.col("ve_l")),
        "peto2_mmhg": F.when(flat, 100.0).otherwise(F.col("peto2_mmhg")),
        "petco2_mmhg": F.when(flat, 40.0).otherwise(F.col("petco2_mmhg")),
    })
    return odd.withColumn("vo2_ml", spiked)


def long_breaths(spark: SparkSession, folder: str) -> DataFrame:
    """One test per supplier of ``lineitem``, rows ordered by every column."""
    items = table(spark, folder, "lineitem")
    order = [c for c in items.columns if c != "l_suppkey"]
    rows = index_rows(items.withColumnRenamed("l_suppkey", KEY), order)
    return _signals(rows, F.col("l_discount") * 10.0, F.col("l_orderkey"))


def participants(spark: SparkSession, folder: str) -> DataFrame:
    """One participant per customer; ``test_id`` is the customer key."""
    c = table(spark, folder, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    sports = ["cycling", "running", "triathlon", "general"]
    levels = ["elite", "competitive", "recreational", "sedentary"]
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    return c.select(
        key.alias(KEY),
        F.concat(F.lit("P"), key.cast("string")).alias("participant_id"),
        F.col("c_name").alias("name"),
        (key % 60 + 18).cast("double").alias("age"),
        F.when(key % 11 == 7, "O").when(nation % 2 == 0, "M").otherwise("F").alias("sex"),
        (key % 45 + 150).cast("double").alias("height_cm"),
        (key % 50 + 50).cast("double").alias("weight_kg"),
        F.when(key % 5 != 4, pick(sports, key % 5)).alias("sport"),
        F.when(key % 7 != 6, pick(levels, key % 4)).alias("level"),
    )


def tests(spark: SparkSession, folder: str) -> DataFrame:
    """Test records, one per customer."""
    c = table(spark, folder, "customer")
    key = F.col("c_custkey")
    names = F.array(*[F.lit(n) for n in ("__Treadmill Bruce", "Cycle ramp 25 W", "Standard", "Ergometer step")])
    return c.select(
        key.alias(KEY),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 365).cast("int")).alias("test_date"),
        F.concat(F.lit("Cart "), (key % 3).cast("string")).alias("device"),
        F.get(names, F.when(key % 3 == 0, 0).when(key % 3 == 1, 1).otherwise(key % 2 + 2).cast("int")).alias("protocol"),
        (F.lit(18.0) + (key % 30).cast("double")).alias("temperature_c"),
        (F.lit(580.0) + (key % 100).cast("double") * 2.0).alias("pressure_mmhg"),
        (key % 101).cast("double").alias("humidity_pct"),
        F.when(key % 2 == 0, F.concat(F.lit("T"), (key % 9).cast("string"))).alias("technician"),
    )


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reported exertion and lactate, each missing for some tests."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias(KEY),
        F.when(key % 3 != 2, (key % 8 + 12).cast("double")).alias("rpe"),
        F.when(key % 4 != 3, (key % 10).cast("double") + 2.0).alias("lactate"),
    )


def pretest(spark: SparkSession, folder: str) -> DataFrame:
    """Conditions before the test, missing for some tests."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias(KEY),
        F.when(key % 3 == 0, "fed").when(key % 3 == 1, "fasted").alias("nutritional_state"),
        F.when(key % 2 == 0, "rested").otherwise("fatigued").alias("fatigue_state"),
        (key % 60).cast("double").alias("last_meal_hours"),
        ((key % 120) * 10).cast("double").alias("caffeine_mg"),
    )


def edits(spark: SparkSession, folder: str) -> DataFrame:
    """Participant corrections: new weight for some, new age for others."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias(KEY),
        F.when(key % 4 == 1, (key % 40 + 55).cast("double")).alias("weight_kg"),
        F.when(key % 6 == 1, (key % 50 + 20).cast("double")).alias("age"),
    ).where(F.coalesce("weight_kg", "age").isNotNull())


def grids(spark: SparkSession, folder: str) -> DataFrame:
    """Measurement grids written from the breaths, participants and tests above."""
    from . import grid as g

    rows = breaths(spark, folder)
    names = ["time_s", "vo2_ml", "vco2_ml", "ve_l", "rer", "hr_bpm", "power_w", "phase"]
    back = {v: k for k, v in g.NAMES.items()}
    blank = [F.lit("") for _ in range(g.FIRST_COLUMN - 1)]
    gap = [F.lit("") for _ in range(60)]  # the last signal stands far to the right
    body = rows.select(
        KEY, (F.col("rn") + g.FIRST_ROW - 1).alias("row"),
        F.array(*blank, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names[:-1]], *gap,
                F.coalesce(F.col(names[-1]).cast("string"), F.lit(""))).alias("cells"),
    )
    top = [(1, [back[c] for c in names[:-1]] + [""] * 60 + [back[names[-1]]]), (2, ["s"] + ["-"] * 7), (3, [""] * 8)]
    lines = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("row"), F.array(*blank, *[F.lit(x) for x in tail]).alias("cells"))
        for i, tail in top
    ])
    heads = rows.select(KEY).distinct().select(KEY, F.inline(lines))
    people, meta = participants(spark, folder), tests(spark, folder)
    left = people.join(meta, KEY).select(KEY, F.array(
        F.col("participant_id"), F.col("name"), F.lit(""), F.col("sex"), F.col("age").cast("string"),
        F.col("height_cm").cast("string"), F.col("weight_kg").cast("string"), F.lit(""),
    ).alias("who"), F.array(
        F.col("test_date").cast("string"), *[F.lit("") for _ in range(5)], F.col("device"), F.col("protocol"),
    ).alias("what"), F.array(
        F.col("pressure_mmhg").cast("string"), F.lit("-"), F.col("humidity_pct").cast("string"),
    ).alias("air"))
    # Only the first eight lines of a sheet carry these cells.
    front = left.select(KEY, F.posexplode(F.sequence(F.lit(1), F.lit(8))).alias("_p", "r"), "who", "what", "air")
    front = front.select(
        KEY, F.col("r").cast("bigint").alias("row"), F.get("who", F.col("r") - 1).alias("who"),
        F.get("what", F.col("r") - 1).alias("what"), F.coalesce(F.get("air", F.col("r") - 1), F.lit("")).alias("air"),
    )
    sheet = body.unionByName(heads).join(front, [KEY, "row"], "left")
    cell = lambda i: F.get("cells", F.lit(i))
    fill = lambda c: F.coalesce(F.col(c), F.lit(""))
    merged = F.concat(
        F.array(F.lit(""), fill("who"), F.lit(""), F.lit(""), fill("what"), F.lit(""), F.lit(""), fill("air"), F.lit("")),
        F.slice("cells", F.lit(g.FIRST_COLUMN), F.size("cells")),
    )
    return index_rows(sheet.select(KEY, "row", merged.alias("cells")), ["row"]).drop("rn")
