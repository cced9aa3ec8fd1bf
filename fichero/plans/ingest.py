"""Which documents a run has to handle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fichero.functions.text import filing_number_from_name, filing_number_from_text, id_of_cache_key, nonblank
from fichero.operators.blocks import Layout, numbers_with_value


def resolved_numbers(documents: DataFrame, cache: DataFrame) -> DataFrame:
    """Filing number per document: from the cache, else the name, else the text.

    ``documents`` has file_id, name and text. Only documents that cache and name leave open read their text.
    """
    known = cache.groupBy(id_of_cache_key(F.col("cache_key")).alias("_cached_id")).agg(F.min(nonblank(F.col("licence")["RADICADO"])).alias("_cached"))
    joined = documents.join(known, F.col("file_id") == F.col("_cached_id"), "left")
    number = F.coalesce("_cached", filing_number_from_name(F.col("name")))
    return joined.withColumn(
        "radicado", F.when(number.isNotNull(), number).otherwise(filing_number_from_text(F.col("text")))
    ).drop("_cached_id", "_cached")


def pending_documents(documents: DataFrame, cache: DataFrame, master: DataFrame, layout: Layout) -> DataFrame:
    """Documents whose number has no audit text in the registry yet; those without a number stay in."""
    numbers = resolved_numbers(documents, cache)
    return numbers.join(numbers_with_value(master, layout, layout.audit), "radicado", "left_anti")
