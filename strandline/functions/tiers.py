"""Threshold words used by reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def depth_tier(depth: Column) -> Column:
    return F.when(depth >= 30, "high").when(depth >= 20, "medium").otherwise("low")


def methylation_tier(percent: Column) -> Column:
    return F.when(percent > 10, "high").when(percent > 5, "medium").otherwise("low")


def mgmt_status(prediction: Column) -> Column:
    return F.when(prediction > 0.1, "Methylated").otherwise("Unmethylated")


def coordinates_similar(s1: Column, e1: Column, s2: Column, e2: Column, distance: int = 50) -> Column:
    return (F.abs(s1 - s2) <= distance) & (F.abs(e1 - e2) <= distance)


def positions_close(s1: Column, e1: Column, s2: Column, e2: Column, distance: int) -> Column:
    return F.least(F.abs(s1 - s2), F.abs(e1 - e2), F.abs(s1 - e2), F.abs(e1 - s2)) <= distance


def overlap_fraction(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Share of the shorter span that both have."""
    both = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    return F.when(F.least(e1 - s1, e2 - s2) > 0, both / F.least(e1 - s1, e2 - s2)).otherwise(0.0)
