"""Grouped counts and minima, and the family-key collision report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mountwait.functions.family import family_key


def library_counts(files: DataFrame, by: str = "original_library") -> DataFrame:
    """Number of files per library (null is a group)."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("n_files"))


def family_min_id(volume: DataFrame) -> DataFrame:
    """Smallest volume id per file family (null is a group)."""
    return volume.groupBy("file_family").agg(F.min("id").alias("min_id"))


def family_keys(volume: DataFrame) -> DataFrame:
    """Distinct families with their label-table key."""
    return (volume.filter(F.col("file_family").isNotNull()).select("file_family").distinct()
            .withColumn("family_key", family_key("file_family")))


def family_key_collisions(volume: DataFrame) -> DataFrame:
    """Keys shared by more than one family, with the number of families."""
    return (family_keys(volume).groupBy("family_key")
            .agg(F.count(F.lit(1)).alias("n_families"))
            .filter(F.col("n_families") > 1))
