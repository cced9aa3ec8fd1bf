"""Checks of extracted fields against the closed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fichero.functions.text import nonblank


def vocabulary_violations(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (vocabulary, value) whose non-blank value is not in its list. Lists are small and fixed in
    production; the size is left to the engine's own broadcast threshold."""
    allowed = vocabulary.select("vocabulary", "value")
    return values.filter(nonblank(F.col("value")).isNotNull()).join(allowed, ["vocabulary", "value"], "left_anti")


def misplaced_towns(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (municipality, subregion) whose municipality belongs to another subregion or to none."""
    towns = vocabulary.filter("vocabulary = 'MUNICIPIO'").select(F.col("value").alias("municipality"), "parent").distinct()
    own = towns.withColumnRenamed("parent", "subregion")
    right = rows.join(own, ["municipality", "subregion"], "left_anti")
    expected = towns.groupBy("municipality").agg(F.array_join(F.array_sort(F.collect_set("parent")), ", ").alias("expected"))
    return right.join(expected, "municipality", "left")
