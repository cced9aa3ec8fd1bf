"""Hard negatives for every anchor and positive, by slot-decomposed selection.

The positives of an anchor are its best rows of the same label. A negative fits a positive when its score lies in a
window below the positive's score. The windows of one anchor overlap; their upper limits, though, split the scores
into disjoint slots, and a window is a run of slots from its own downwards. So one pass over the rows keeps the best of
every (anchor, slot), in combiners per block and then per task, and a merge of each anchor's slots from the lowest up
gives, at every slot, the best of all slots from there down, which answers every window.

Rows are packed into blocks of bounded bytes. Anchors are broadcast in chunks of a fixed number of blocks, so rows are
scanned where they lie, once per chunk and pass; nothing but the best rows of an anchor is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fichero.llm.common import prepared, staged

#: Bytes of a packed block's components, and most rows of one; anchors of a packed block, and blocks broadcast at a time.
BLOCK_BYTES, BLOCK_ROWS, ANCHORS, CHUNK = 2 << 20, 4096, 512, 16
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1
_PACKED = "width int, row array<long>, id array<long>, label array<long>, uppers array<array<long>>, floor array<long>, v binary"
_PACKED_ARROW = pa.schema(
    [("width", pa.int32())] + [(c, pa.list_(pa.int64())) for c in ("row", "id", "label")]
    + [("uppers", pa.list_(pa.list_(pa.int64()))), ("floor", pa.list_(pa.int64())), ("v", pa.large_binary())]
)
_FOUND = "row long, slot int, id long, score long"
_FOUND_ARROW = pa.schema([("row", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the rows with an id, a label and a vector of finite components."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).where(fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))


def _pack(scale: float, rows_of_block: int):
    """Rows (row, id, label, uppers, floor, v) of a task as blocks of one vector width each."""

    def block(width: int, parts: list[tuple]) -> pa.RecordBatch:
        *columns, v = zip(*parts)
        whole = [pa.chunked_array(c).combine_chunks() for c in columns]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in whole]
        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), *lists, pa.array([np.concatenate(v).tobytes()], pa.large_binary())], schema=_PACKED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("v")
            offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            widths = np.diff(offsets)
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                v = np.floor(scale * values[offsets[at][:, None] + np.arange(width)])
                size = max(1, min(rows_of_block, BLOCK_BYTES // max(1, 8 * width)))
                parts = held.setdefault(width, [])
                for cut in range(0, len(at), size):
                    rows = pa.array(at[cut : cut + size])
                    parts.append((*[batch.column(c).take(rows) for c in ("row", "id", "label", "uppers", "floor")], v[cut : cut + size]))
                    if sum(len(p[0]) for p in parts) >= size:
                        yield block(width, parts)
                        parts.clear()
        for width, parts in held.items():
            if parts:
                yield block(width, parts)

    return run


def _unpacked(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array(block["id"], np.int64)
    return np.array(block["row"], np.int64), ids, np.array(block["label"], np.int64), np.frombuffer(block["v"], np.float64).reshape(len(ids), -1)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs; those too large for doubles in whole numbers of any size, held within a long."""
    if not a.shape[1] or np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    left, right = [[int(x) for x in r] for r in a], [[int(x) for x in r] for r in b]
    return np.array([[max(_FIRST, min(_LAST, sum(x * y for x, y in zip(p, q)))) for q in right] for p in left], np.int64).reshape(len(a), len(b))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: higher scores first, then smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _best_of_label(k: int):
    """Combiner of the first pass: of a block, each anchor's k best rows of its label."""

    def each(anchor: dict, rows: dict) -> Iterator[tuple]:
        row, own, own_label, a = _unpacked(anchor)
        _, ids, label, b = _unpacked(rows)
        for value in np.unique(own_label):
            asked, there = np.flatnonzero(own_label == value), np.flatnonzero(label == value)
            scores = _scores(a[asked], b[there])
            for i, line in zip(asked, scores):
                at = np.flatnonzero(ids[there] != own[i])
                at = at[_top(line[at], ids[there][at], k)]
                yield row[i], 0, ids[there][at], line[at]

    return each


def _best_of_slots(k: int):
    """Combiner of the second pass: of a block, the k best rows of another label in each of an anchor's slots.

    ``uppers`` are the upper limits of the anchor's windows, the highest first; slot i holds scores from there down
    to the next limit. Scores below ``floor`` are in no window.
    """

    def each(anchor: dict, rows: dict) -> Iterator[tuple]:
        row, own, own_label, a = _unpacked(anchor)
        _, ids, label, b = _unpacked(rows)
        scores = _scores(a, b)
        for i, line in enumerate(scores):
            uppers = np.array(anchor["uppers"][i], np.int64)
            at = np.flatnonzero((line <= uppers[0]) & (line >= anchor["floor"][i]) & (label != own_label[i]) & (ids != own[i]))
            if not len(at):
                continue
            slots = len(uppers) - 1 - np.searchsorted(uppers[::-1], line[at], "left")
            slots = np.where(line[at] <= uppers[-1], len(uppers) - 1, slots)
            for slot in np.unique(slots):
                inside = at[slots == slot]
                best = inside[_top(line[inside], ids[inside], k)]
                yield row[i], slot, ids[best], line[best]

    return each


def _combine(each):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [found for pair in batch.to_pylist() for found in each(pair["anchor"], pair["rows"])]
            if out:
                sizes = [len(f[2]) for f in out]
                columns = [np.repeat(np.array([f[0] for f in out], np.int64), sizes), np.repeat(np.array([f[1] for f in out], np.int32), sizes)]
                columns += [np.concatenate([f[c] for f in out]) for c in (2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_FOUND_ARROW)

    return run


def _anchor_blocks(anchors: DataFrame, scale: float) -> tuple[DataFrame, int]:
    """Anchors as packed blocks, dealt to chunks of CHUNK blocks' bytes at most, and the number of chunks."""
    n, components = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    parts = max(1, math.ceil(n / ANCHORS), math.ceil(8 * components / BLOCK_BYTES))
    blocks = anchors.repartition(parts).mapInArrow(_pack(scale, ANCHORS), _PACKED)
    return staged(blocks.withColumn("chunk", F.floor(F.spark_partition_id() / CHUNK)), "blocks"), math.ceil(parts / CHUNK)


def _in_chunks(anchors: DataFrame, chunks: int, pool: DataFrame, each, k: int) -> DataFrame:
    """Every block of anchors against every block of rows of their width; at most ``k`` rows per anchor and slot."""
    rows = pool.select("width", F.struct("row", "id", "label", "v").alias("rows"))
    found = None
    for chunk in range(chunks):
        # about CHUNK x BLOCK_BYTES at most
        asked = F.broadcast(anchors.where(F.col("chunk") == chunk).select("width", F.struct(*[c for c in anchors.columns if c not in ("width", "chunk")]).alias("anchor")))
        part = rows.join(asked, "width").select("anchor", "rows").mapInArrow(_combine(each), _FOUND)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def suffix_merges(slots: Column, k: int) -> Column:
    """For each slot the k best of it and all lower ones; ``slots`` holds sorted arrays of (down, id), the highest slot first."""
    start = F.array(F.slice(F.element_at(slots, 1), 1, 0))
    merged = F.aggregate(
        F.reverse(slots), start, lambda below, own: F.concat(F.array(F.slice(F.array_sort(F.concat(own, F.element_at(below, 1))), 1, k)), below)
    )
    return merged


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, lowest: int = 80, highest: int = 100, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows of ``vectors``.

    Components x become floor(scale x) and scores are integer inner products with the anchor; higher ones come first,
    ties by smaller id. Anchors are the rows for which ``anchors`` holds; their positives the first ``positives`` other
    rows of the same label (all, if fewer). For each of them come the first ``negatives`` rows of another label (all,
    if fewer) with ``lowest * positive score <= 100 * score <= highest * positive score``; ``highest`` may be 100 at most.

    Rows without id or label, and vectors that are null or hold null or non-finite components, take no part. Rows with
    the anchor's own id are not other rows. Rows whose vector has another length score nothing with the anchor. A row
    that occurs twice counts twice, as anchor too. Scores beyond 64 bits are held at the ends of the long range. Other
    columns, whatever their names, are not read unless ``anchors`` does. Empty tables give an empty table.
    """
    if highest > 100:
        raise ValueError("windows end at the positive's score or below")
    prepared(vectors.sparkSession)
    pool = usable(vectors, id_col, vec_col, label_col)
    asked = staged(usable(vectors.where(anchors), id_col, vec_col, label_col).withColumn("row", F.monotonically_increasing_id()), "anchors")
    unlimited = [F.expr("CAST(null AS array<bigint>)").alias("uppers"), F.lit(None).cast("long").alias("floor")]
    packed = staged(pool.select(F.lit(0).cast("long").alias("row"), "id", "label", *unlimited, "v").mapInArrow(_pack(scale, BLOCK_ROWS), _PACKED), "rows")
    blocks, chunks = _anchor_blocks(asked.select("row", "id", "label", *unlimited, "v"), scale)
    same = _in_chunks(blocks, chunks, packed, _best_of_label(positives), positives)
    found = same.select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    # limits are decimals, as a score times 100 may pass 64 bits
    score = F.col("positive_score").cast("decimal(20,0)")
    upper, lower = F.floor(score * highest / F.lit(100).cast("decimal(3,0)")), F.ceil(score * lowest / F.lit(100).cast("decimal(3,0)"))
    windows = staged(found.withColumn("upper", upper.cast("long")).withColumn("lower", lower.cast("long")).where("lower <= upper"), "windows")
    limits = windows.groupBy("row").agg(F.reverse(F.array_sort(F.collect_set("upper"))).alias("uppers"), F.min("lower").alias("floor"))
    blocks, chunks = _anchor_blocks(asked.join(limits, "row").select("row", "id", "label", "uppers", "floor", "v"), scale)
    others = _in_chunks(blocks, chunks, packed, _best_of_slots(negatives), negatives)

    # with the sign turned (minus one minus the score, which stays within 64 bits) the best sort first
    best = F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("down"), "id"))).alias("best")
    slots = others.groupBy("row", "slot").agg(best).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("held"))
    nothing = F.expr("CAST(array() AS array<struct<down: bigint, id: bigint>>)")
    lists = F.transform("uppers", lambda _, i: F.coalesce(F.try_element_at("held", i), nothing))
    merged = slots.join(limits, "row").select("row", "uppers", suffix_merges(lists, negatives).alias("best"))
    inside = F.filter(F.element_at("best", F.array_position("uppers", F.col("upper")).cast("int")), lambda x: F.bitwise_not(x["down"]) >= F.col("lower"))
    answers = windows.join(merged, "row").join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    rows = answers.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "one"))
    return rows.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.id").alias("negative_id"), "positive_score", F.bitwise_not("one.down").alias("negative_score")
    )
