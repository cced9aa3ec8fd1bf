"""Toxicity by logistic regression over hashed word n-grams and skip-grams, fitted with FTRL-proximal.

Features are the distinct words, word pairs and pairs with one word between, hashed to ``BUCKETS``. FTRL keeps a rate
per coordinate and drives weights that are not needed to zero, so what is broadcast is a short list of weights of
proven size. Shards of the training rows are fitted side by side and their weights averaged.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fichero.llm.common import prepared, private

BUCKETS = 1 << 20
#: The bounded sample of labelled rows that is fitted, in the order of a hash of their id; shards; passes over them.
SAMPLE, SHARDS, PASSES = 16_384, 2, 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 0.1
THRESHOLD = 0.7
#: The index under which every shard that was fitted counts itself.
FITTED = -1
#: Lower case for A-Z, a space for every other ASCII character that is no letter.
_CLEAN = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def features(text: bytes) -> np.ndarray:
    """Distinct hashed features of UTF-8 bytes; bucket 0 is the bias that every text has."""
    words = text.translate(_CLEAN).split()
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    mix = np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] * np.uint64(3) + one[1:] * np.uint64(5) + np.uint64(1)) * mix
    skip = (one[:-2] * np.uint64(7) + one[2:] * np.uint64(11) + np.uint64(2)) * mix
    slots = (np.concatenate((one * mix, two, skip)) >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return np.concatenate((np.zeros(1, np.int64), np.unique(slots).astype(np.int64)))


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """FTRL-proximal over one shard, in the order of the hash; its weights, those not zero, and one row that counts the shard."""
    rows = rows.sort_values("order")
    examples = [(features(t), float(y)) for t, y in zip(rows["text"], rows["y"])]
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(i):
        zi = z[i]
        l1 = np.where(i == 0, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES):
        for i, y in examples:
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    i = np.flatnonzero(n)
    w = weights(i)
    return pd.DataFrame({"i": np.append(i[w != 0], FITTED), "w": np.append(w[w != 0], 1.0)})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> np.ndarray:
    """Weights by bucket (at most BUCKETS numbers). Rows without an id, text or label teach nothing.

    The sample is drawn from the labelled ids that ``docs`` holds. An id labelled twice counts with its largest label.
    Where no row is labelled, or ``docs`` is empty, all weights are zero; a shard without rows has no say.
    """
    prepared(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y is not null").groupBy("_id").agg(F.max("y").alias("y"))
    taught = docs.select(F.col(id_col).alias("_id")).where("_id is not null")
    # a sample of at most `sample` rows of two numbers: safe to send to every task, so that unlabelled texts stay where they are
    chosen = known.join(taught, "_id", "left_semi").withColumn("order", F.xxhash64("_id")).orderBy("order", "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text")).where("text is not null").join(F.broadcast(chosen), "_id")
    shard = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(SHARDS)).alias("shard")
    fitted = rows.select(shard, "order", "text", "y").groupBy("shard").applyInPandas(_fit, "i int, w double")
    weights = np.zeros(BUCKETS, np.float32)
    sums = dict(fitted.groupBy("i").agg(F.sum("w")).collect())  # at most BUCKETS rows and one
    shards = sums.pop(FITTED, 1.0)
    for i, w in sums.items():
        weights[i] = w / shards
    return weights


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` without its text, with the column ``name``: the probability that it is toxic. Null and empty texts get the bias alone."""
    prepared(docs.sparkSession)
    used = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used]))
    kept = [c for c in docs.columns if c not in (text_col, name)]
    own = private(docs, "_text")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{name}` double"])

    def run(batches):
        at, values = sent.value
        table = np.zeros(BUCKETS, np.float32)
        table[at] = values
        for batch in batches:
            logits = np.array([table[features(t or b"")].sum(dtype=np.float64) for t in batch.column(own).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))))], names=[*kept, name])

    return docs.select(*kept, F.col(text_col).cast("binary").alias(own)).mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold; all columns stay."""
    weights = fit(docs, labels, id_col, text_col)
    again, toxicity = private(docs, "_text_again"), private(docs, "_toxicity")
    rows = docs.withColumn(again, F.col(text_col))
    return score(rows, weights, again, toxicity).where(F.col(toxicity) < threshold).select(*docs.columns)
