"""Normative values and predicted maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import age_group, age_midpoint, predicted_values

# VO2max (mL/kg/min) low, typical, high per sport, level and sex, then
# gross efficiency (%, cycling) or running economy (mL/kg/km, running) low, typical,
# high, then the typical maximal heart rate (triathlon), then the sources of the two.
SPORT_NORMS = [
    ("cycling", "elite", "M", 70.0, 77.0, 85.0, 22.0, 23.5, 25.5, None, "Lucia et al., 2001", "Coyle, 2005"),
    ("cycling", "elite", "F", 60.0, 65.0, 70.0, 21.0, 22.5, 24.5, None, "Impellizzeri & Marcora, 2007", "Hopker et al., 2009"),
    ("cycling", "competitive", "M", 55.0, 62.0, 70.0, 20.0, 21.5, 23.5, None, "Mujika & Padilla, 2001", "Hopker et al., 2009"),
    ("cycling", "competitive", "F", 48.0, 54.0, 60.0, 19.5, 21.0, 23.0, None, "Mujika & Padilla, 2001", "Hopker et al., 2009"),
    ("cycling", "recreational", "M", 40.0, 47.0, 55.0, 18.0, 20.0, 22.0, None, "Jeukendrup et al., 2000", "Moseley & Jeukendrup, 2001"),
    ("cycling", "recreational", "F", 35.0, 41.0, 48.0, 17.5, 19.5, 21.5, None, "Jeukendrup et al., 2000", "Moseley & Jeukendrup, 2001"),
    ("running", "elite", "M", 70.0, 76.0, 85.0, 180.0, 190.0, 200.0, None, "Morgan et al., 1995", "Saunders et al., 2004"),
    ("running", "elite", "F", 60.0, 67.0, 75.0, 185.0, 195.0, 210.0, None, "Pate et al., 1987", "Saunders et al., 2004"),
    ("running", "competitive", "M", 55.0, 62.0, 70.0, 195.0, 205.0, 220.0, None, "Noakes et al., 1990", "Barnes & Kilding, 2015"),
    ("running", "competitive", "F", 48.0, 55.0, 62.0, 200.0, 215.0, 230.0, None, "Noakes et al., 1990", "Barnes & Kilding, 2015"),
    ("running", "recreational", "M", 40.0, 47.0, 55.0, 210.0, 230.0, 250.0, None, "Bassett & Howley, 2000", "Barnes & Kilding, 2015"),
    ("running", "recreational", "F", 35.0, 41.0, 48.0, 220.0, 240.0, 260.0, None, "Bassett & Howley, 2000", "Barnes & Kilding, 2015"),
    ("triathlon", "elite", "M", 70.0, 75.0, 85.0, None, None, None, 185.0, "Sleivert & Rowlands, 1996", None),
    ("triathlon", "elite", "F", 60.0, 66.0, 72.0, None, None, None, 185.0, "Laursen & Rhodes, 2001", None),
    ("triathlon", "competitive", "M", 55.0, 62.0, 70.0, None, None, None, 180.0, "Knechtle et al., 2010", None),
    ("triathlon", "competitive", "F", 48.0, 55.0, 62.0, None, None, None, 180.0, "Knechtle et al., 2010", None),
    ("triathlon", "recreational", "M", 45.0, 52.0, 58.0, None, None, None, 175.0, "Lepers et al., 2013", None),
    ("triathlon", "recreational", "F", 38.0, 45.0, 52.0, None, None, None, 175.0, "Lepers et al., 2013", None),
]

# Population percentiles 25, 50, 75 of VO2max (mL/kg/min) by sex and age group.
POPULATION_NORMS = [
    ("M", "junior", 42.0, 48.0, 55.0),
    ("M", "20-29", 38.0, 44.0, 51.0),
    ("M", "30-39", 35.0, 41.0, 48.0),
    ("M", "40-49", 32.0, 38.0, 44.0),
    ("M", "50-59", 28.0, 34.0, 40.0),
    ("M", "60-69", 24.0, 30.0, 36.0),
    ("M", "70+", 20.0, 26.0, 32.0),
    ("F", "junior", 36.0, 42.0, 48.0),
    ("F", "20-29", 30.0, 36.0, 42.0),
    ("F", "30-39", 27.0, 33.0, 39.0),
    ("F", "40-49", 24.0, 30.0, 36.0),
    ("F", "50-59", 22.0, 27.0, 33.0),
    ("F", "60-69", 19.0, 24.0, 30.0),
    ("F", "70+", 16.0, 21.0, 26.0),
]

# Sources of the population norms and of the predicted values.
POPULATION_SOURCE = "Kaminsky et al., 2015 (FRIEND)"
PREDICTION_SOURCE = "Jones et al., 1997; Tanaka et al., 2001"

SPORTS = ["cycling", "running", "triathlon", "general"]
LEVELS = ["elite", "competitive", "recreational", "sedentary"]


def sport_norms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SPORT_NORMS,
        "sport string, level string, sex string, vo2max_low double, vo2max_typical double, vo2max_high double, "
        "metric_low double, metric_typical double, metric_high double, hr_max double, "
        "source string, metric_source string",
    )


def population_norms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        POPULATION_NORMS, "sex string, age_group string, p25 double, p50 double, p75 double"
    )


def with_predicted(participants: DataFrame) -> DataFrame:
    """P8 over a table: predicted maxima, one column each."""
    return participants.withColumns(
        predicted_values(F.col("age"), F.col("sex"), F.col("height_cm"), F.col("weight_kg"))
    )


def with_age_group(participants: DataFrame) -> DataFrame:
    """P9 over a table: age group and its midpoint."""
    grouped = participants.withColumn("age_group", age_group(F.col("age")))
    return grouped.withColumn("age_midpoint", age_midpoint(F.col("age_group")))


def normative_lookup(people: DataFrame) -> DataFrame:
    """Norms by sport, level, sex and age group.

    General sport or sedentary level uses the population percentiles by age group;
    other rows ignore age.  A missing sport or level counts as general / recreational;
    an unknown one, and sex other than M or F, yields nulls.  Both dimension tables are
    fixed (18 and 14 rows), so they are broadcast.
    """
    spark = people.sparkSession
    df = with_age_group(people)
    df = df.withColumns({
        "_sport": F.coalesce(F.lower("sport"), F.lit("general")),
        "_level": F.coalesce(F.lower("level"), F.lit("recreational")),
        "_sex": F.upper("sex"),
    })
    known = F.col("_sport").isin(SPORTS) & F.col("_level").isin(LEVELS)
    general = known & ((F.col("_sport") == "general") | (F.col("_level") == "sedentary"))
    df = df.withColumn("_general", general)
    by_sport = F.broadcast(
        sport_norms(spark).withColumnsRenamed({"sport": "_sport", "level": "_level", "sex": "_sex"})
    )
    by_age = F.broadcast(population_norms(spark).withColumnsRenamed({"sex": "_sex"}))
    df = df.join(by_sport, ["_sport", "_level", "_sex"], "left").join(by_age, ["_sex", "age_group"], "left")
    general = F.col("_general")
    pick = lambda age, sport: F.when(general, F.col(age)).otherwise(F.col(sport))
    hr = F.when(F.col("p50").isNotNull(), F.rint(F.lit(208.0) - F.col("age_midpoint") * 0.7))
    metric = lambda sport, c: F.when(~general & (F.col("_sport") == sport), F.col(c))
    return df.select(
        *people.columns,
        "age_group",
        pick("p25", "vo2max_low").alias("norm_low"),
        pick("p50", "vo2max_typical").alias("norm_typical"),
        pick("p75", "vo2max_high").alias("norm_high"),
        F.when(general, hr).otherwise(F.col("hr_max")).alias("norm_hr_max"),
        metric("cycling", "metric_typical").alias("norm_efficiency"),
        metric("running", "metric_typical").alias("norm_economy"),
        F.when(general & F.col("p50").isNotNull(), POPULATION_SOURCE).otherwise(F.when(~general, F.col("source"))).alias("norm_source"),
        F.when(~general, F.col("metric_source")).alias("metric_source"),
    )


def normative_categories(spark: SparkSession) -> DataFrame:
    """The 20 sport, level, sex categories with their typical VO2max."""
    sports = sport_norms(spark).select("sport", "level", "sex", "vo2max_typical")
    # The general category quotes one population percentile per sex.
    general = spark.createDataFrame(
        [("general", "sedentary", "M", 38.0), ("general", "sedentary", "F", 30.0)], sports.schema
    )
    return sports.unionByName(general)


def category_members(people: DataFrame) -> DataFrame:
    """J10 over people: members per category, categories without members included."""
    categories = F.broadcast(normative_categories(people.sparkSession))
    counts = people.groupBy("sport", "level", "sex").agg(F.count(F.lit(1)).alias("members"))
    joined = categories.join(counts, ["sport", "level", "sex"], "left")
    return joined.withColumn("members", F.coalesce("members", F.lit(0)))
