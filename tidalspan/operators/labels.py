"""Label translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Key, English text, French text.
LABELS = [
    ("fed", "Fed", "Nourri"),
    ("fasted", "Fasted", "À jeun"),
    ("rested", "Rested", "Reposé"),
    ("fatigued", "Fatigued", "Fatigué"),
    ("cycling", "Cycle Ergometer", "Ergocycle"),
    ("treadmill", "Treadmill", "Tapis roulant"),
    ("other", "Other", "Autre"),
    ("male", "Male", "Homme"),
    ("female", "Female", "Femme"),
    ("starting_power", "Starting power", "Puissance initiale"),
    ("starting_speed", "Starting speed", "Vitesse initiale"),
    ("power_increment", "Power increment", "Incrément de puissance"),
    ("speed_increment", "Speed increment", "Incrément de vitesse"),
    ("breath_by_breath", "Breath by breath", "Cycle par cycle"),
    ("time_averaged", "Time averaged", "Moyenné dans le temps"),
    ("aerobic_excellent", "Excellent", "Excellente"),
    ("aerobic_normal", "Normal", "Normale"),
    ("aerobic_mildly_reduced", "Mildly reduced", "Légèrement réduite"),
    ("aerobic_moderately_reduced", "Moderately reduced", "Modérément réduite"),
    ("aerobic_severely_reduced", "Severely reduced", "Sévèrement réduite"),
    ("hr_maximal", "Maximal", "Maximale"),
    ("hr_adequate", "Adequate", "Adéquate"),
    ("hr_submaximal", "Submaximal", "Sous-maximale"),
    ("hr_not_available", "Not available", "Non disponible"),
    ("rer_maximal", "Maximal effort", "Effort maximal"),
    ("rer_near_maximal", "Near-maximal", "Quasi-maximal"),
    ("rer_submaximal", "Submaximal", "Sous-maximal"),
    ("rer_inconclusive", "Inconclusive", "Non concluant"),
    ("insufficient_data", "Too little data to judge", "Trop peu de données pour juger"),
    # interpretation
    ("capacity_normal_to_elevated", "Aerobic fitness is at or above what was predicted", "L'aptitude aérobie atteint ou dépasse la valeur attendue"),
    ("capacity_within_normal_limits", "Aerobic fitness is as it should be", "L'aptitude aérobie est telle qu'attendue"),
    ("capacity_mildly_reduced", "Aerobic fitness is a little low", "L'aptitude aérobie est un peu basse"),
    ("capacity_moderately_reduced", "Aerobic fitness is clearly low", "L'aptitude aérobie est nettement basse"),
    ("capacity_severely_reduced", "Aerobic fitness is very low", "L'aptitude aérobie est très basse"),
    ("heart_maximal", "The heart rate came to its limit", "La fréquence cardiaque est arrivée à sa limite"),
    ("heart_adequate", "The heart rate rose enough", "La fréquence cardiaque est montée suffisamment"),
    ("heart_submaximal", "The heart rate stayed below its limit", "La fréquence cardiaque est restée sous sa limite"),
    ("effort_maximal", "The RER shows full effort", "Le RER montre un effort complet"),
    ("effort_near_maximal", "The RER shows almost full effort", "Le RER montre un effort presque complet"),
    ("effort_possibly_submaximal", "The RER leaves full effort in doubt", "Le RER laisse douter d'un effort complet"),
    # recommendations
    ("acceptable", "The recording needs no change", "L'enregistrement ne demande aucun changement"),
    ("filter_aberrant_breaths", "Remove outlying breaths before analysis", "Retirer les cycles aberrants avant l'analyse"),
    ("check_hr_monitor", "See whether the heart rate belt works", "Voir si la ceinture cardiaque fonctionne"),
    ("check_ergometer", "See whether the ergometer is connected", "Voir si l'ergomètre est connecté"),
    ("stabilise_baseline", "Wait longer at rest before the start", "Attendre plus longtemps au repos avant le départ"),
    ("recalibrate", "Calibrate the gas analyser again", "Étalonner de nouveau l'analyseur de gaz"),
    # report fields
    ("name", "Name", "Nom"), ("sex", "Sex", "Sexe"), ("age", "Age", "Âge"), ("height", "Height", "Taille"), ("weight", "Weight", "Poids"),
    ("bmi", "BMI", "IMC"), ("sport", "Sport", "Sport"), ("test_date", "Date of test", "Date du test"), ("protocol", "Protocol", "Protocole"),
    ("device", "Device", "Appareil"), ("technician", "Technician", "Technicien"), ("duration", "Duration", "Durée"), ("stage", "Stage", "Palier"),
    ("vo2_peak", "Peak VO2", "VO2 de pic"), ("vo2_kg_peak", "Peak VO2 per kg", "VO2 de pic par kg"), ("ve_peak", "Peak ventilation", "Ventilation de pic"),
    ("hr_peak", "Peak heart rate", "Fréquence cardiaque de pic"), ("rer_peak", "Peak RER", "RER de pic"), ("power_peak", "Peak power", "Puissance de pic"),
    ("speed_peak", "Peak speed", "Vitesse de pic"), ("o2_pulse", "O2 pulse", "Pouls d'O2"), ("measured", "Measured", "Mesuré"),
    ("predicted", "Predicted", "Prédit"), ("norm", "Norm", "Norme"), ("vt1", "First threshold", "Premier seuil"), ("vt2", "Second threshold", "Second seuil"),
    ("gross_efficiency", "Gross efficiency", "Rendement brut"), ("running_economy", "Running economy", "Économie de course"),
    ("stage_duration", "Length of a stage", "Durée d'un palier"), ("last_meal", "Last meal", "Dernier repas"), ("caffeine", "Caffeine", "Caféine"),
    ("medication", "Medication", "Médicaments"), ("notes", "Notes", "Remarques"),
]
LANGUAGES = ["en", "fr"]


def label_table(spark: SparkSession) -> DataFrame:
    """One row per key and language."""
    rows = [(key, lang, text) for key, en, fr in LABELS for lang, text in (("en", en), ("fr", fr))]
    return spark.createDataFrame(rows, "label_key string, language string, label string")


def translate(df: DataFrame, key: str, into: str, language: str = "en") -> DataFrame:
    """Text of ``key`` in ``language``; unknown keys stay, unknown languages read as English.

    The label table is fixed, so it is broadcast.
    """
    chosen = language if language in LANGUAGES else "en"
    labels = label_table(df.sparkSession).where(F.col("language") == chosen)
    labels = F.broadcast(labels.select(F.col("label_key").alias("_key"), F.col("label").alias("_label")))
    joined = df.join(labels, F.col(key) == F.col("_key"), "left")
    return joined.select(*df.columns, F.coalesce("_label", F.col(key)).alias(into))


def state_labels(states: DataFrame, columns: list[str], language: str = "en") -> DataFrame:
    """Labels of state columns; ``-`` for a missing state."""
    for c in columns:
        states = translate(states, c, f"{c}_label", language)
        states = states.withColumn(f"{c}_label", F.coalesce(f"{c}_label", F.lit("-")))
    return states
