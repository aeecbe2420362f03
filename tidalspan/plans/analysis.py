"""End-to-end batch analysis of many tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.averaging import average
from ..operators.layout import index_rows, is_split, prepare, total_order
from ..operators.peaks import find_peaks
from ..operators.stages import extract_stages, summarize_stages
from ..operators.thresholds import DEFAULT_METHODS, detect_thresholds
from ..operators.validation import validate
from ..schema import KEY
from ..shared import keep
from .report import compose


@dataclass
class Analysis:
    """Results of a batch: one record per test and its stage rows."""

    records: DataFrame
    stages: DataFrame
    peaks: DataFrame
    thresholds: DataFrame


def analyse(
    breaths: DataFrame,
    participants: DataFrame,
    tests: DataFrame,
    averaging_method: str = "rolling",
    window: float = 30.0,
    methods: tuple[str, ...] = tuple(DEFAULT_METHODS),
    protocol: str = "step",
    stage_duration: float = 180.0,
    summary: str = "last30s",
    peaks_on: str = "raw",
    with_validation: bool = True,
) -> Analysis:
    """Peaks on raw, thresholds on averaged, stages on raw data.

    A part that cannot be computed for a test is null there; the test keeps its record.
    ``peaks_on = averaged`` takes peaks from the averaged data instead.

    Each part is written to the shared folder by a job of its own: in one plan the sorts of all parts would share a task,
    and whoever writes records and stages would compute the stages twice.
    """
    if peaks_on not in ("raw", "averaged"):
        raise ValueError(f"unknown peaks_on: {peaks_on}")
    raw = prepare(breaths)
    averaged = average(raw, averaging_method, window).drop("n_breaths")
    # Averaging never adds rows, so only a split source can have an oversized average.
    averaged = prepare(index_rows(averaged, total_order(averaged), check=is_split(raw)))
    peaks = keep(find_peaks(raw if peaks_on == "raw" else averaged, participants, window), "peaks")
    thresholds = keep(detect_thresholds(averaged, methods), "thresholds")
    stages = keep(summarize_stages(extract_stages(raw, protocol, stage_duration), summary), "stages")
    counts = stages.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_stages"))
    report = keep(validate(raw, participants), "validation") if with_validation else None
    return Analysis(compose(participants, tests, peaks, thresholds, counts, report), stages, peaks, thresholds)
