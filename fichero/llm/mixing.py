"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is wanted the same number of times, its target over its size: whole copies are certain,
the fraction is an inclusion probability. The flight moves the probabilities of three documents at a time along the
direction that changes neither the document nor the token total (the null space of the two constraints), until one
of them is 0 or 1. Sources are dealt out in blocks of bounded size that fly side by side; the one or two documents a
block leaves open meet in the next round, and what is left of a source at last, two documents at most, lands on the
rounding nearest to its token total.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fichero.llm.common import numbered, prepared, private, staged

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents of a block; blocks whose rest meets in the next round.
BLOCK, JOINED = 4096, 2048
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"
_OPEN = 1e-9


def words(text_col: str):
    """Number of words of a text, 0 where it is null."""
    return F.coalesce(F.expr(f"regexp_count(`{text_col}`, '{WORD}')").cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, documents, target) for ``sizes(source, size)``, one row per source.

    Sources in code-point order, null last, take the weights in turn. They share ``share`` of all words; a target
    stops at ``most`` times its source and the rest is shared again by weight. In order of ``most`` times size over
    weight, the first source that need not stop fixes the level for all that follow, so one pass suffices. The only
    single-task step sees one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1))
    per = per.withColumn("full", F.col("source_size") * most).withColumn("ratio", F.col("full") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    return per.select("source", "source_size", "documents", F.coalesce(F.least("full", F.col("weight") * F.col("level")), F.col("full")).alias("target"))


def flight(f: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight; at most two of them are still open. Sums of ``f`` and ``f * size`` stay."""
    f = f.copy()
    held: list[int] = []
    for i in np.flatnonzero((f > _OPEN) & (f < 1 - _OPEN)).tolist():
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        ahead = min((1 - f[k]) / x if x > 0 else f[k] / -x for k, x in zip(held, u) if x)
        back = min(f[k] / x if x > 0 else (1 - f[k]) / -x for k, x in zip(held, u) if x)
        step = ahead if rng.random() * (ahead + back) < back else -back
        for k, x in zip(held, u):
            f[k] += step * x
        for k in held:
            if f[k] <= _OPEN or f[k] >= 1 - _OPEN:
                f[k] = round(f[k])
        held = [k for k in held if 0 < f[k] < 1]
    return f


def landing(f: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the few open probabilities so that the token total, then the document total, moves least."""
    f = f.copy()
    rest = np.flatnonzero((f > 0) & (f < 1))
    best = min(itertools.product((0.0, 1.0), repeat=len(rest)), key=lambda r: (abs(((np.array(r) - f[rest]) * size[rest]).sum()), abs((np.array(r) - f[rest]).sum())))
    f[rest] = best
    return f


def _round(last: bool):
    def run(key, rows):
        rows = rows.sort_values(["order", "row"], kind="stable")
        f, size = rows["f"].to_numpy(np.float64), rows["size"].to_numpy(np.float64)
        f = flight(f, size, np.random.default_rng(zlib.crc32(repr((str(key[0]), int(key[1]))).encode())))
        return rows.assign(f=landing(f, size) if last else f)

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, row_col: str | None = None) -> DataFrame:
    """One row per document: ``row`` (its position), id, size, source_size, target, copies and taken = size x copies.

    Null texts have size 0; a null source is a source of its own. A source without a word takes nothing. Documents
    are told apart by row, so repeated ids are documents of their own; the draw depends on ids, sizes and sources
    alone and is the same in every run. Further columns are ignored; an empty table gives an empty table. ``row``
    is the number in ``row_col``; without one it numbers the rows of this scan alone and must not be met with another scan.
    """
    prepared(docs.sparkSession)
    sizes = staged(docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size")), "sizes")
    per = staged(targets(sizes, weights, share, most), "targets").withColumnRenamed("source", "of")
    rows = sizes.join(per, sizes["source"].eqNullSafe(per["of"]), "left").drop("of")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(wanted + _OPEN)).withColumn("f", F.when(wanted - F.col("whole") > _OPEN, wanted - F.col("whole")).otherwise(0.0))
    rows = rows.withColumn("order", F.xxhash64("id", "size")).withColumn("block", F.pmod(F.xxhash64("order"), F.ceil(F.col("documents") / BLOCK)))
    blocks = per.agg(F.max(F.ceil(F.col("documents") / BLOCK))).first()[0] or 0
    open_, settled = rows, None
    while blocks:
        flown = open_.groupBy("source", "block").applyInPandas(_round(blocks == 1), rows.schema)
        if blocks == 1:
            settled = flown if settled is None else settled.unionByName(flown)
            break
        flown = staged(flown, "flown")
        done = flown.where("f = 0 or f = 1")
        settled = done if settled is None else settled.unionByName(done)
        open_ = flown.where("f > 0 and f < 1").withColumn("block", F.floor(F.col("block") / JOINED))
        blocks = -(-blocks // JOINED)
    copies = (F.col("whole") + F.round("f")).cast("long")
    return (rows if settled is None else settled).select("row", F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: every document as often as it has copies, none where it has no copy."""
    row, times, copy = private(docs, "_row"), private(docs, "_copies"), private(docs, "_copy")
    rows = numbered(docs, row)
    copies = staged(mix(rows, id_col, text_col, source_col, row_col=row).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(times)), "copies")
    # dealt out by row at every size: the rows taken grow with the input and are never sent to every task
    rows = rows.join(copies.hint("merge"), row)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
