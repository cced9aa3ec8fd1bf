"""SimHash near-duplicates through a Gray-ordered hierarchical index.

A fingerprint has one bit per position, set where more than half of the hashes of its word shingles set it. Two
fingerprints with at most three differing bits agree in at least one of four 16-bit blocks, so the index is a
forest: the top node of a tree fixes one block (a shared masked bit pattern), below it fingerprints are sorted by
Gray rank and every group of neighbours is a node that keeps the bits all its members share. Two nodes are only
opened further while the differences collected on bits both share stay within the limit, so whole groups fall away.

Only distinct fingerprints enter the index, and each tree gives the spanning stars of what it links, never pairs.
A top node with very many fingerprints is divided once more by one of four 12-bit blocks of its other 48 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fichero.llm.common import numbered, prepared, private, staged
from fichero.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Top nodes with more fingerprints are divided; fingerprints indexed together in memory; children of a node.
HOT, FLUSH, FANOUT = 65_536, 262_144, 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes; zero where there is no word."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    counts, n, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    for start in range(0, len(hashes), 200_000):
        part = hashes[start : start + 200_000]
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, with ``fp`` (the fingerprint as a signed long). Null texts count as empty."""
    kept = [c for c in docs.columns if c != text_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", fp long"

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t or b"", shingle) for t in batch.column("_text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found.view(np.int64))], names=[*kept, "fp"])

    return docs.select(*kept, F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def _root(parent: np.ndarray) -> None:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return
        parent[:] = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        _root(parent)


def _levels(key: np.ndarray, code: np.ndarray) -> list[tuple]:
    """From the fingerprints up to one node per key: (shared bits, their values, first child, end of children)."""
    n = len(code)
    levels = [(np.full(n, ~np.uint64(0)), code, np.arange(n), np.arange(n) + 1)]
    low = high = code
    while True:
        new = np.r_[True, key[1:] != key[:-1]]
        if new.all():
            return levels
        first = np.flatnonzero(new)
        within = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        start = np.flatnonzero(within % FANOUT == 0)
        low, high, key = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start), key[start]
        mask = ~(low ^ high)
        levels.append((mask, low & mask, start, np.r_[start[1:], len(within)]))


def _linked(key: np.ndarray, code: np.ndarray, limit: int):
    """Pairs of positions under one key whose codes differ in at most ``limit`` bits, block after block."""
    levels = _levels(key, code)
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    work = [(top, roots[i : i + 4096], roots[i : i + 4096]) for i in range(0, len(roots), 4096)]
    while work:
        level, a, b = work.pop()
        if level == 0:
            apart = a != b
            yield a[apart], b[apart]
            continue
        _, _, first, end = levels[level]
        rows, ka, kb = np.arange(len(a)), end[a] - first[a], end[b] - first[b]
        pairs = ka * kb
        rows = np.repeat(rows, pairs)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        x, y = first[a][rows] + at // kb[rows], first[b][rows] + at % kb[rows]
        mask, bits, _, _ = levels[level - 1]
        near = (x <= y) & (np.bitwise_count((bits[x] ^ bits[y]) & mask[x] & mask[y]) <= limit)
        x, y = x[near], y[near]
        for i in range(0, len(x), 32_768):
            work.append((level - 1, x[i : i + 32_768], y[i : i + 32_768]))


def _stars(key: np.ndarray, code: np.ndarray, node: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((gray_rank(code), key))
    key, code, node = key[order], code[order], node[order]
    parent = np.arange(len(code))
    for a, b in _linked(key, code, limit):
        _unite(parent, a, b)
    member = np.flatnonzero(parent != np.arange(len(parent)))
    return node[member], node[parent[member]]


def _index(limit: int):
    def run(batches):
        held: list[tuple] = []

        def flush(rows):
            a, b = _stars(*(np.concatenate(x) for x in zip(*rows)), limit)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        size = 0
        for batch in batches:
            key, fp, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "node"))
            fp, size = fp.view(np.uint64), size + len(key)
            if size >= FLUSH and len(key) and held:
                cut = np.searchsorted(key, key[-1], "left")  # rows come sorted by key; the last key may go on
                if cut or held[-1][0][-1] != key[-1]:
                    yield flush([*held, (key[:cut], fp[:cut], node[:cut])])
                    held, key, fp, node = [], key[cut:], fp[cut:], node[cut:]
                    size = len(key)
            if len(key):
                held.append((key, fp, node))
        if held:
            yield flush(held)

    return run


def hamming_components(codes: DataFrame, limit: int = BITS) -> DataFrame:
    """(node, component) for nodes of ``codes(node long, fp long)`` linked by at most ``limit`` (0 to 3) differing bits."""
    codes = codes.where("node is not null")
    blocks = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF).alias("v")) for i in range(4)))
    keyed = codes.select("node", "fp", F.explode(blocks).alias("k")).select("node", "fp", "k.i", (F.col("k.i") * 65_536 + F.col("k.v")).cast("long").alias("key"))
    # four times 65,536 keys at most, whatever the input: safe to send to every task
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot"))
    keyed = keyed.join(F.broadcast(hot), "key", "left")
    rest = F.expr("case i when 0 then shiftrightunsigned(fp, 16) when 3 then fp & 281474976710655 when 1 then (shiftleft(shiftrightunsigned(fp, 32), 16) | (fp & 65535)) else (shiftleft(shiftrightunsigned(fp, 48), 32) | (fp & 4294967295)) end")
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: (F.col("key") * 4 + j) * 4096 + F.call_function("shiftrightunsigned", F.col("rest"), j * 12).bitwiseAND(4095) + (1 << 40))
    keyed = keyed.withColumn("rest", rest).select("node", "fp", F.explode(F.when(F.col("hot"), parts).otherwise(F.array("key"))).alias("key"))
    edges = keyed.repartition("key").sortWithinPartitions("key").select("key", "fp", "node").mapInArrow(_index(limit), "a long, b long")
    return components(edges)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BITS, shingle: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """One row per document: ``row`` (its position), id, ``fp``, ``component_id`` and ``kept``.

    Texts that are null, empty or without a word have fingerprint zero and link like any other. ``component_id`` is
    the smallest id reachable by links. Rows without an id take the component of their fingerprint (null if none
    there has an id) and are never kept unless no row of their component has an id. Of several rows with the
    component's id, the first is kept. Further columns are ignored; an empty table gives an empty table.
    ``row`` is the number in ``row_col``; without one it numbers the rows of this scan alone and must not be met with another scan.
    """
    prepared(docs.sparkSession)
    own = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"))
    prints = staged(fingerprints(own, "_t", shingle), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("node"), F.min(F.struct(F.col("id").isNull().alias("x"), "id", "row")).alias("first")), "classes")
    components_of = hamming_components(classes.select("node", "fp"), limit)
    whole = classes.join(components_of, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    heads = whole.select("fp", "component_id", F.when(F.col("node").isNull() | (F.col("node") == F.col("component_id")), F.col("first.row")).alias("head"))
    joined = prints.join(heads, "fp", "left")
    return joined.select("row", F.col("id").alias(id_col), "fp", "component_id", F.coalesce(F.col("row") == F.col("head"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id."""
    row = private(docs, "_row")
    rows = numbered(docs, row)
    kept = staged(near_duplicates(rows, id_col, text_col, row_col=row).where("kept").select(F.col("row").alias(row)), "kept")
    # dealt out by row at every size: the rows kept grow with the input and are never sent to every task
    return rows.join(kept.hint("merge"), row, "left_semi").drop(row)
