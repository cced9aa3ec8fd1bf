"""Inputs that failed, kept beside a stream's results until they are mended and replayed.

The results of a micro-batch and its failures are two outputs under the batch's id: a batch that is given again replaces
its results and leaves its failures as they are, so both hold every document once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fichero.session import staged
from fichero.sources.store import KeyedStore

#: What a failed input keeps: its id, what came in, why it failed, how often, and whether it still waits.
LETTER = "file_id string, raw string, reason string, attempts int, waiting boolean"
Parse = Callable[[DataFrame], DataFrame]


def dead_letters(spark: SparkSession, folder: str, buckets: int = 16) -> KeyedStore:
    return KeyedStore(spark, folder, key="file_id", ids=("file_id",), buckets=buckets).create(spark.createDataFrame([], LETTER))


def _split(parsed: DataFrame, letters: KeyedStore, results: str, batch_id: int, attempts) -> None:
    parsed = staged(parsed, "parsed")
    parsed.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{results}/batch={batch_id}")
    failed = F.col("reason").isNotNull()
    kept = parsed.where(failed | (attempts > 1)).select("file_id", "raw", "reason", attempts.cast("int").alias("attempts"), failed.alias("waiting"))
    letters.append(kept, batch_id)


def isolated(parse: Parse, letters: KeyedStore, results: str) -> Callable[[DataFrame, int], None]:
    """Handler of micro-batches (file_id, raw, ...): ``parse`` adds ``reason``, null where it succeeded."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        _split(parse(batch), letters, results, batch_id, F.lit(1))

    return handle


def replay(letters: KeyedStore, parse: Parse, results: str, batch_id: int, mend: Parse = lambda waiting: waiting, most: int = 3) -> bool:
    """Give the waiting letters to ``parse`` again, after ``mend``; those tried ``most`` times stay as they are.

    ``batch_id`` is the replay's own; a replay that was done is not done again (False). Whatever still fails waits on
    with one attempt more.
    """
    if letters.committed(batch_id):
        return False
    waiting = letters.read().where(F.col("waiting") & (F.col("attempts") < most)).select("file_id", "raw", "attempts")
    _split(parse(mend(waiting)), letters, results, batch_id, F.col("attempts") + 1)
    return True
