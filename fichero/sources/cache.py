"""Extractions kept in storage between runs, one entry per (filing number, file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fichero.functions.text import cache_key
from fichero.plans.extraction import Extractor, cached_or_extracted, rule_extractor
from fichero.sources.store import KeyedStore

ENTRY = "cache_key string, licence map<string,string>, stored_at string"
#: 64-bit words of the key sketch of a bucket and commit.
SKETCH_WORDS = 4096


def extraction_cache(spark: SparkSession, folder: str, buckets: int = 64) -> KeyedStore:
    return KeyedStore(spark, folder, key="cache_key", ids=("cache_key",), buckets=buckets, sketch_words=SKETCH_WORDS)


def start_cache(store: KeyedStore, entries: DataFrame | None = None) -> KeyedStore:
    entries = store.spark.createDataFrame([], ENTRY) if entries is None else entries
    return store.create(_one_per_key(entries))


def _one_per_key(entries: DataFrame) -> DataFrame:
    newest = entries.groupBy("cache_key").agg(F.max_by("licence", "stored_at").alias("licence"), F.max("stored_at").alias("stored_at"))
    return newest.select("cache_key", "licence", "stored_at")


def store_entries(store: KeyedStore, entries: DataFrame, batch: int) -> bool:
    """Keep the entries of a batch: only they are written, and entries of a later batch replace those of an earlier one."""
    return store.append(_one_per_key(entries), batch)


def cached_or_extracted_from(store: KeyedStore, documents: DataFrame, extractor: Extractor = rule_extractor) -> DataFrame:
    """``cached_or_extracted`` against the stored cache: opens only the buckets that can hold a key of the documents."""
    keys = documents.select(cache_key(F.col("radicado"), F.col("file_id"), F.col("name")).alias("cache_key"))
    return cached_or_extracted(documents, store.read(keys), extractor)
