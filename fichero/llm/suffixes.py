"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Every window of ``length`` bytes picks the smallest hash of its grams (the leftmost of equal ones) as its anchor, so
equal windows pick the same anchor at the same place. Windows that share an anchor stand side by side; the suffix at
the anchor, with the bytes before it, holds them all. Only anchors whose gram occurs twice or more can hold repeated
windows, and a count of gram hashes finds these.

Their suffixes are sorted in runs where the texts lie. A run is front-coded: each suffix gives the length of its
common prefix with the one before and only the rest of its bytes, and equal suffixes are one entry. Runs are
exchanged by gram and combined with loser trees that remember how far two suffixes are known to agree and compare
bytes only beyond that. Neighbours in the merged order that share a gram form a group; the common prefixes to the
right and the common bytes to the left of the anchor decide which windows of the group are repeated.

A gram that very many windows share is not gathered in one group: its windows are sorted as suffixes of their own,
where equal windows are one entry of a run, so that no group grows with the number of copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fichero.llm.common import numbered, partitions, prepared, staged

LENGTH, GRAM = 200, 48
#: Occurrences above which a gram's windows are sorted one by one; entries of a run; bytes hashed at once; marked anchors of a part.
HOT, RUN, BLOCK, PART = 4096, 32_768, 1 << 19, 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers:
        n = 1 << 20
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    up, down = _power_tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, ~np.uint64(0))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int = LENGTH):
    """Blocks of (text, anchor, first window, last window, gram hash), places counted from the start of each text."""
    width = length - GRAM + 1
    held, size = [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(0, len(text) - length + 1), BLOCK):
            piece = text[start : start + BLOCK + length - 1]
            if held and size + len(piece) > BLOCK + length:
                yield _anchored(held, width, length)
                held, size = [], 0
            held.append((i, start, piece))
            size += len(piece)
    if held:
        yield _anchored(held, width, length)


def _anchored(held, width: int, length: int):
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    hashes = _gram_hashes(data)
    keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    least = (_sliding_minimum(keys, width) & _PLACE).astype(np.int64)
    sizes = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(sizes)
    windows = np.concatenate([np.arange(e - s, e - length + 1) for s, e in zip(sizes, ends)])
    owner = np.repeat(np.arange(len(held)), sizes - length + 1)
    at = least[windows]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    owner = owner[first]
    shift = np.array([s for _, s, _ in held])[owner] - (ends - sizes)[owner]
    text = np.array([i for i, _, _ in held])[owner]
    return text, at[first] + shift, windows[first] + shift, windows[last] + shift, hashes[at[first]].view(np.int64)


def _gram_rows(length: int):
    def run(batches):
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            for text, _, _, _, h in anchors(batch.column("_text").to_pylist(), length):
                yield pa.RecordBatch.from_arrays([pa.array(rows[text]), pa.array(h)], names=["row", "h"])

    return run


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree in their first ``known`` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def pack(entries: list[tuple]) -> bytes:
    """A front-coded run of sorted entries (suffix, bytes before it, members)."""
    shared, before = [], b""
    for suffix, _, _ in entries:
        shared.append(common_prefix(before, suffix))
        before = suffix
    tails = [e[0][k:] for e, k in zip(entries, shared)]
    counts = np.array([shared, [len(t) for t in tails], [len(e[1]) for e in entries], [len(e[2]) for e in entries]], np.int32)
    members = np.array([m for e in entries for m in e[2]], np.int64)
    return b"".join((len(entries).to_bytes(4, "little"), counts.tobytes(), members.tobytes(), *tails, *(e[1] for e in entries)))


def unpack(run: bytes):
    """The entries of a run, each with the length of its common prefix with the one before."""
    n = int.from_bytes(run[:4], "little")
    counts = np.frombuffer(run, np.int32, 4 * n, 4).reshape(4, n)
    total = int(counts[3].sum())
    members = np.frombuffer(run, np.int64, 2 * total, 4 + 16 * n).reshape(total, 2)
    tail = 4 + 16 * n + 16 * total
    left, at, suffix = tail + int(counts[1].sum()), 0, b""
    for shared, rest, before, size in zip(*counts.tolist()):
        suffix = suffix[:shared] + run[tail : tail + rest]
        yield suffix, shared, run[left : left + before], members[at : at + size]
        tail, left, at = tail + rest, left + before, at + size


def _compressed(run: bytes) -> bytes:
    return len(run).to_bytes(4, "little") + pa.Codec("zstd").compress(run, asbytes=True)


def _decompressed(run: bytes) -> bytes:
    return pa.Codec("zstd").decompress(run[4:], int.from_bytes(run[:4], "little"), asbytes=True)


def merged(runs: list[bytes]):
    """All entries of all runs in order, each with its common prefix with the entry before, by a loser tree.

    A waiting suffix keeps the length of its common prefix with the last one given out. Of two, the one that shares
    more is smaller; only where both share as much are bytes compared, from there on.
    """
    sources = [unpack(r) for r in runs]
    heads = [next(s, None) for s in sources]
    known = [0] * len(runs)
    size = 1
    while size < len(runs):
        size *= 2
    heads += [None] * (size - len(runs))
    known += [0] * (size - len(runs))

    def loses(a: int, b: int) -> bool:
        """Whether a comes after b; the loser then knows its common prefix with the winner."""
        if heads[a] is None or heads[b] is None:
            return heads[a] is None
        if known[a] != known[b]:
            return known[a] < known[b]
        x, y = heads[a][0], heads[b][0]
        k = common_prefix(x, y, known[a])
        after = x[k : k + 1] > y[k : k + 1] or (k == len(x) == len(y) and a > b)
        known[a if after else b] = k
        return after

    tree = [0] * size
    level = list(range(size))
    while len(level) > 1:
        winners = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            lost = loses(a, b)
            winners.append(b if lost else a)
            tree[(len(level) + i) // 2] = a if lost else b
        level = winners
    winner = level[0]
    while heads[winner] is not None:
        suffix, _, before, members = heads[winner]
        yield suffix, known[winner], before, members
        heads[winner] = next(sources[winner], None)
        known[winner] = heads[winner][1] if heads[winner] else 0
        node = (winner + size) // 2
        while node:
            if loses(winner, tree[node]):
                winner, tree[node] = tree[node], winner
            node //= 2


def _common_suffix(a: bytes, b: bytes) -> int:
    return common_prefix(a[::-1], b[::-1])


def repeated(group: list[tuple], length: int) -> list[list[tuple[int, int]]]:
    """For each entry of a group the ranges (from, to) of bytes before the anchor where repeated windows start."""
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    for i, (suffix, _, before, members) in enumerate(group):
        if len(members) > 1:
            out[i].append((length - len(suffix), len(before)))
    if len(group) == 1:
        return out
    if len(group) <= 6:
        for i in range(len(group)):
            right = length
            for j in range(i + 1, len(group)):
                right = min(right, group[j][1])
                left = _common_suffix(group[i][2], group[j][2])
                if length - right <= left:
                    out[i].append((length - right, left))
                    out[j].append((length - right, left))
        return out
    n = len(group)
    right = np.array([0, *(g[1] for g in group[1:])])
    longest, back = np.array([len(g[0]) for g in group]), np.array([len(g[2]) for g in group])
    lefts = [g[2][::-1] for g in group]
    order = sorted(range(n), key=lefts.__getitem__)
    left = np.array([0, *(common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:]))])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    found = np.zeros((n, length + 1), bool)
    for before in range(int((length - longest).min()), int(back.max()) + 1):
        own = np.flatnonzero((back >= before) & (length - longest <= before))
        key = np.cumsum(right < length - before)[own] * (n + 1) + np.cumsum(left < before)[place[own]]
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        found[own, before] = times[where] > 1
    for i in range(n):
        edges = np.flatnonzero(np.diff(np.r_[0, found[i].view(np.int8), 0]))
        out[i] += [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]
    return out


def _runs(length: int, parts: int):
    def run(batches):
        held: dict[tuple, dict] = {}
        size = 0

        def out():
            keys = list(held)
            blobs = [_compressed(pack([(s, b, m) for (s, b), m in sorted(held[k].items())])) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.bool_()), pa.array(blobs, pa.binary())], names=["part", "hot", "run"])

        for batch in batches:
            rows, texts = batch.column("_row").to_pylist(), batch.column("_text").to_pylist()
            twice, hot = batch.column("twice").to_pylist(), batch.column("hot").to_pylist()
            wanted = [set(t) for t in twice]
            many = [set(t) for t in hot]
            for text, at, first, last, h in anchors(texts, length):
                for i, a, lo, hi, g in zip(text.tolist(), at.tolist(), first.tolist(), last.tolist(), h.tolist()):
                    if g not in wanted[i]:
                        continue
                    data = texts[i]
                    if g in many[i]:
                        for p in range(lo, hi + 1):
                            window = data[p : p + length]
                            group = held.setdefault((int.from_bytes(hashlib.blake2b(window, digest_size=4).digest(), "big") % parts, True), {})
                            members = group.setdefault((window, b""), [])
                            size += not members
                            members.append((rows[i], p))
                    else:
                        members = held.setdefault((g % parts, False), {}).setdefault((data[a : hi + length], data[lo:a]), [])
                        size += not members
                        members.append((rows[i], a))
                    if size >= RUN:
                        yield out()
                        held.clear()
                        size = 0
        if held:
            yield out()

    return run


def _ranges(length: int):
    def run(key, table):
        hot = key[1].as_py()
        together = length if hot else GRAM
        rows, starts, ends = [], [], []

        def close(group):
            for (_, _, _, members), ranges in zip(group, repeated(group, length)):
                for low, high in ranges:
                    rows.append(members[:, 0])
                    starts.append(members[:, 1] - high)
                    ends.append(members[:, 1] - low + length)

        group: list[tuple] = []
        for entry in merged([_decompressed(run.as_py()) for run in table.column("run")]):
            if group and entry[1] < together:
                close(group)
                group = []
            group.append(entry)
        if group:
            close(group)
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"row": join(rows), "start": join(starts), "end": join(ends)})

    return run


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, start, end): the bytes of ``docs(_row long, _text binary, ...)`` under windows that occur twice or more; ranges may overlap.

    The runs are made from whole rows of ``docs``, further columns and all, so that a caller who joins the ranges to
    ``docs`` by ``_row`` moves the texts once: Spark uses the same exchange for both joins.
    """
    spark = prepared(docs.sparkSession)
    grams = staged(docs.where(F.octet_length("_text") >= length).select("_row", "_text").mapInArrow(_gram_rows(length), "row long, h long"), "grams")
    # written, so that the join below deals both sides out by itself and Spark can split a gram that very many windows share
    twice = staged(grams.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    hashes = grams.join(twice, "h").groupBy(F.col("row").alias("_row"))
    marked = hashes.agg(F.collect_set("h").alias("twice"), F.collect_set(F.when(F.col("n") > HOT, F.col("h"))).alias("hot"))
    # a part holds a bounded number of anchors; a task merges one part after the other
    parts = max(partitions(spark), -(-(twice.agg(F.sum("n")).first()[0] or 0) // PART))
    runs = docs.join(marked.hint("merge"), "_row").mapInArrow(_runs(length, parts), "part int, hot boolean, run binary")
    return runs.groupBy("part", "hot").applyInArrow(_ranges(length), "row long, start long, end long")


def _cut(carried: list[str]):
    def run(batches):
        for batch in batches:
            out = []
            for data, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()):
                edges = np.zeros(len(data) + 1, np.int64)
                for span in spans or ():
                    edges[span["start"]] += 1
                    edges[span["end"]] -= 1
                gone = np.cumsum(edges)[:-1] > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[0, gone.view(np.int8)]) == 1)), kept))
            columns = list(zip(*out)) or [[]] * 4
            added = [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *added], names=[*carried, *ADDED])

    return run


#: The columns that deduplicated() adds.
ADDED = ["_n_bytes", "_n_removed", "_n_spans", "_kept"]


def _deduplicated(docs: DataFrame, text_col: str, length: int, carried: list[str]) -> DataFrame:
    """The ``carried`` columns by place (c0, c1, ...), so that no name of theirs meets one of ours, and ``ADDED``."""
    if length < 2 * GRAM or length > 255 * 8:
        raise ValueError(f"length must lie between {2 * GRAM} and {255 * 8}")
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    places = [f"c{i}" for i in range(len(carried))]
    kept = numbered(docs.select(text.alias("_text"), *(F.col(f"`{c}`").alias(p) for c, p in zip(carried, places)))).where("_row is not null")
    spans = repeats(kept, length).groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    # the exchange of the texts is that of the runs' join, with all that is carried: texts move once
    whole = kept.join(spans.hint("merge"), "_row", "left").drop("_row")
    schema = ", ".join([*(f"{p} {docs.schema[c].dataType.simpleString()}" for c, p in zip(carried, places)), *(f"{c} {t}" for c, t in zip(ADDED, ("long", "long", "long", "binary")))])
    return whole.mapInArrow(_cut(places), schema)


def deduplicated(docs: DataFrame, text_col: str = "text", length: int = LENGTH, carried: list[str] | None = None) -> DataFrame:
    """The ``carried`` columns of every row (all but the text, unless named) with ``ADDED``: bytes, bytes removed, maximal
    removed runs, and what is left of the text once strings of ``length`` bytes that also start elsewhere are cut out.

    Null texts count as empty; texts shorter than ``length`` stay whole; all copies of a repeated string go, in
    repeated rows too. ``_kept`` is binary, for a cut may fall inside a character. An empty table gives an empty table.
    Rows are numbered once and written with the columns needed; every later step reads them there. Carried columns
    that are named like one of ``ADDED`` give way to it.
    """
    carried = [c for c in (docs.columns if carried is None else carried) if c != text_col and c not in ADDED]
    rows = _deduplicated(docs, text_col, length, carried)
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carried)), *ADDED)


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut out of its texts (and ``n_chars``, if there is one, counted again).

    Where a cut falls inside a character, what is left of it becomes U+FFFD; a null text becomes the empty one.
    """
    carried = [c for c in docs.columns if c not in (text_col, "n_chars")]
    rows = _deduplicated(docs, text_col, LENGTH, carried)
    made = {c: F.col(f"c{i}") for i, c in enumerate(carried)}
    made[text_col] = F.make_valid_utf8(F.col("_kept").cast("string"))
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length(made[text_col]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(made[c].alias(c) for c in docs.columns))
