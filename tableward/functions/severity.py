"""Score bands, severity levels and penalty roll-ups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableward.model import CRITICAL, INFO, WARNING

# Fixed values: (lower bound in percent, score) from the top, then the score below every bound.
NULL_REQUIRED = (((50, 85.0), (10, 70.0), (1, 55.0)), 45.0)
NULL_OPTIONAL = (((50, 60.0), (20, 45.0)), 30.0)
TYPE = (((20, 85.0), (5, 75.0), (1, 55.0)), 45.0)
RANGE = (((20, 70.0), (5, 55.0), (1, 45.0)), 35.0)
FORMAT = (((50, 55.0), (20, 45.0), (5, 35.0)), 25.0)
DUPLICATE = (((20, 70.0), (10, 55.0), (5, 45.0)), 35.0)
ENCODING = (((10, 85.0), (5, 75.0), (1, 55.0)), 45.0)
OUTLIER = (((5, 65.0), (2, 55.0), (1, 45.0)), 35.0)
COUNT = (((50, 75.0), (20, 55.0)), 30.0)
IMPACT = (((50, 100.0), (20, 80.0), (10, 60.0), (5, 40.0), (1, 20.0)), 10.0)
FREQUENCY = (((100, 100.0), (50, 80.0), (20, 60.0), (10, 40.0), (5, 20.0)), 10.0)
# Upper bounds in hours, from the bottom.
RECENCY = (((1, 100.0), (6, 80.0), (24, 60.0), (72, 40.0), (168, 20.0)), 10.0)
STATUS = (((90, "Excellent"), (70, "Good"), (50, "Fair"), (30, "Poor")), "Critical")


def banded(value: Column, table, below: bool = False) -> Column:
    """First matching band of ``table``; ``below`` reads the bounds as upper limits."""
    bands, rest = table
    chain = None
    for bound, score in bands:
        hit = value <= bound if below else value >= bound
        chain = F.when(hit, F.lit(score)) if chain is None else chain.when(hit, F.lit(score))
    return chain.otherwise(F.lit(rest))


def level(score: Column) -> Column:
    return F.when(score >= 70, CRITICAL).when(score >= 40, WARNING).otherwise(INFO)


def outlier_level(score: Column) -> Column:
    """Outliers never reach CRITICAL; the warning bound is higher than elsewhere."""
    return F.when(score >= 65, WARNING).otherwise(INFO)


def range_score(pct: Column, relative_deviation: Column) -> Column:
    base = banded(pct, RANGE)
    extreme = F.coalesce(relative_deviation > 1.0, F.lit(False))
    return F.when(extreme, F.least(F.lit(100.0), base + 15.0)).otherwise(base)


def duplicate_score(pct: Column, groups: Column) -> Column:
    base = banded(pct, DUPLICATE)
    bonus = F.when(groups >= 50, 10.0).when(groups >= 20, 5.0).otherwise(0.0)
    return F.least(F.lit(100.0), base + bonus)


def outlier_score(pct: Column, count: Column) -> Column:
    base = banded(pct, OUTLIER)
    return (
        F.when(count >= 100, F.least(F.lit(85.0), base + 15.0))
        .when(count >= 50, F.least(F.lit(75.0), base + 10.0))
        .otherwise(base)
    )


# Points a layer loses per CRITICAL / WARNING / INFO finding.
PENALTIES = {
    "schema": (30.0, 10.0, 2.0),
    "business": (25.0, 10.0, 2.0),
    "model": (25.0, 10.0, 2.0),
    "ethics": (30.0, 12.0, 3.0),
    "upload_ethics": (30.0, 15.0, 0.0),
    "watcher": (30.0, 15.0, 0.0),
}


def layer_score(severity: Column, layer: str) -> Column:
    """Aggregate expression: 100 minus the summed penalties, never below 0."""
    critical, warning, info = PENALTIES[layer]
    lost = (
        F.when(severity == CRITICAL, critical)
        .when(severity == WARNING, warning)
        .when(severity == INFO, info)
        .otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(F.sum(lost), F.lit(0.0)))


def weighted_severity(affected_pct: Column, occurrences: Column, hours: Column,
                      weights=(0.4, 0.3, 0.3)) -> Column:
    """Impact, frequency and recency combined; an unknown share counts as impact 50."""
    impact = F.when(affected_pct.isNull(), 50.0).otherwise(banded(affected_pct, IMPACT))
    score = (
        impact * weights[0]
        + banded(occurrences, FREQUENCY) * weights[1]
        + banded(hours, RECENCY, below=True) * weights[2]
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
