"""Writing a batch of analyses and counting it in the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .analysis import Analysis


def write_batch(done: Analysis, path: str, rejects: DataFrame | None = None) -> dict[str, int]:
    """Write records, stages (and rejects) as Parquet below ``path``; what the written tables hold.

    tests, invalid (validation failed), not_validated, without_peak, without_threshold, aberrant (breaths), stages and
    rejected.  The numbers are observed while the rows are written: no job but the writes.
    """
    found: dict[str, int] = {}
    valid = F.col("validation.is_valid")
    parts = [
        ("records", done.records, {
            "tests": F.count(F.lit(1)),
            "invalid": F.count_if(valid.isNotNull() & ~valid),
            "not_validated": F.count_if(valid.isNull()),
            "without_peak": F.count_if(F.col("peaks.vo2_peak").isNull()),
            "without_threshold": F.count_if(F.col("thresholds.vt1_vo2").isNull()),
            "aberrant": F.coalesce(F.sum("validation.n_aberrant"), F.lit(0)).cast("bigint"),
        }),
        ("stages", done.stages, {"stages": F.count(F.lit(1))}),
    ]
    if rejects is not None:
        parts.append(("rejects", rejects, {"rejected": F.count(F.lit(1))}))
    for name, frame, numbers in parts:
        seen = Observation(f"{name} of a batch")
        frame.observe(seen, *[c.alias(n) for n, c in numbers.items()]).write.parquet(f"{path}/{name}")
        found |= seen.get
    return found
