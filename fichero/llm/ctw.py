"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased UTF-8 bytes and one end byte. Each byte is eight binary decisions; a decision's context is
the last bytes before it, at all depths from none to ``DEPTH``. Every context holds Krichevsky-Trofimov estimates of
its decisions, and weighting mixes the estimates of all depths of a path: half for the context itself, half for the
product of the contexts that extend it. Nothing is pruned: every context of the training texts is in the tree, however
rare, so the tree grows with the corpus. It is never held in one place:

* A chunk of texts gives each of its distinct codes (a context of ``DEPTH`` bytes and the byte after it) once, with its
  training count; codes without one are only asked for. Sums over chunks give one table of codes.
* Tasks take the codes part by part; a part is the subtree below a context of ``SPLIT`` bytes, at most 2^24 codes. On the
  way up a part passes counts and weighted products of its root on; levels above are sums over at most 256 children.
* On the way down each level is joined with the one above, and a part turns what its root inherits into the length of
  each of its codes. Chunks look their codes up by a join and meet their texts again.

The base score needs the count of every word. Words with more than one in ``WORDS`` of the training tokens, of which
there can be no more than ``WORDS``, go to every task; the others meet their counts in a join.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fichero.llm.common import numbered, partitions, prepared, staged

DEPTH, SPLIT, WORDS = 5, 3, 1 << 19
#: Bytes of texts of a chunk, on average; bytes coded at once; codes worked on at once, if parts are no larger.
CHUNK, BLOCK, CODES = 32 << 20, 2 << 20, 200_000
#: Distinct codes or words a task holds before it passes them on; rows of a batch given out.
HELD, GIVEN = 1 << 20, 100_000
END_BYTE, END = b"\xff", "\n"
_LN2, _LN10 = np.log(2.0), np.log(10.0)


def _lower(text) -> bytes:
    return (text or b"").lower()


def _buffers(texts):
    """Blocks of texts as (number of the first, bytes with DEPTH zeros before and the end byte after each text)."""
    held, size, first = [], 0, 0
    for text in texts:
        held.append(b"\0" * DEPTH + _lower(text) + END_BYTE)
        size += len(held[-1])
        if size >= BLOCK:
            yield first, held
            held, size, first = [], 0, first + len(held)
    if held:
        yield first, held


def _coded(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code of every byte to score, oldest byte first, and the text it is in."""
    data = np.frombuffer(b"".join(held), np.uint8)
    lengths = np.array([len(h) for h in held])
    owner = np.repeat(np.arange(len(held)), lengths)
    within = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(within >= DEPTH)
    code = np.zeros(len(at), np.int64)
    for back in range(DEPTH, -1, -1):
        code = (code << 8) | data[at - back]
    return code, owner[at]


def _chunk_codes(batches):
    """The distinct codes of each chunk with their training counts. Rows of a chunk follow one another."""
    chunk, codes, counts = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out():
        for i in range(0, len(codes), GIVEN):
            part = codes[i : i + GIVEN]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk, np.int64)), pa.array(part), pa.array(counts[i : i + GIVEN])], names=["chunk", "code", "n"])

    for batch in batches:
        chunks, train, texts = batch.column("chunk").to_numpy(), np.array(batch.column("train").to_pylist(), bool), batch.column("_text").to_pylist()
        bounds = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
        for a, b in zip(bounds, bounds[1:]):
            if a < b and chunks[a] != chunk:
                yield from out()
                chunk, codes, counts = int(chunks[a]), codes[:0], counts[:0]
            for first, held in _buffers(texts[a:b]):
                code, owner = _coded(held)
                # the lowest bit tells training bytes, so one sort counts both kinds
                marked, times = np.unique((code << 1) | train[a + first + owner], return_counts=True)
                new, n = marked >> 1, times * (marked & 1)
                codes, where = np.unique(np.concatenate((codes, new)), return_inverse=True)
                counts = np.bincount(where, np.concatenate((counts, n)), len(codes)).astype(np.int64)
                if len(codes) > HELD:
                    yield from out()
                    codes, counts = codes[:0], counts[:0]
    yield from out()


def _word_counts(batches):
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column("_text").to_pylist():
            held.update(_lower(text).split())
            held[END.encode()] += 1
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving the argument up by eight."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability."""
    return _ln_gamma(zeros + 0.5) + _ln_gamma(ones + 0.5) - np.log(np.pi) - _ln_gamma(zeros + ones + 1)


def _parts(batches):
    """Rows sorted by ``part`` as tables of whole parts, with at least ``CODES`` rows where there are as many."""
    held, size, due = [], 0, CODES
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= due:
            table = pa.Table.from_batches(held)
            part = table.column("part").to_numpy()
            whole = int(np.searchsorted(part, part[-1]))
            if whole:
                yield table.slice(0, whole)
            held, size = table.slice(whole).to_batches(), size - whole
            due = max(CODES, 2 * size)
    if size:
        yield pa.Table.from_batches(held)


def _subtrees(code: np.ndarray, n: np.ndarray):
    """The bit each code takes at each of its 8 decisions, and the levels of contexts from depth DEPTH to SPLIT.

    A level: its keys (context and decision as one number), the place there of each row of the level below (for the
    deepest: of each code's decisions), zeros, ones, the log of the product below, log of its weighted probability.
    """
    byte = code & 255
    key = np.concatenate([((code >> 8) << 8) | ((1 << level) - 1 + (byte >> (8 - level))) for level in range(8)])
    bit = np.concatenate([(byte >> (7 - level)) & 1 for level in range(8)])
    times = np.tile(n, 8)
    keys, where = np.unique(key, return_inverse=True)
    zeros, ones = np.bincount(where, times * (1 - bit), len(keys)), np.bincount(where, times * bit, len(keys))
    weighted = _estimate(zeros, ones)
    levels = [(keys, where, zeros, ones, weighted, weighted)]
    for depth in range(DEPTH - 1, SPLIT - 1, -1):
        above = (((keys >> 8) & ((1 << (8 * depth)) - 1)) << 8) | (keys & 255)
        keys, where = np.unique(above, return_inverse=True)
        zeros, ones, product = (np.bincount(where, x, len(keys)) for x in (zeros, ones, weighted))
        weighted = np.logaddexp(_estimate(zeros, ones), product) - _LN2
        levels.append((keys, where, zeros, ones, product, weighted))
    return bit, levels


def _own(zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of a context's own estimate in its mixture, and that estimate of a one."""
    return np.exp(np.minimum(_estimate(zeros, ones) - _LN2 - weighted, 0.0)), (ones + 0.5) / (zeros + ones + 1)


def _roots(batches):
    """Counts and products of the contexts of SPLIT bytes."""
    for table in _parts(batches):
        keys, _, zeros, ones, product, _ = _subtrees(table.column("code").to_numpy(), table.column("n").to_numpy())[1][-1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, zeros, ones, product)], names=["key", "zeros", "ones", "product"])


def _weighed(batches):
    for batch in batches:
        zeros, ones, product = (batch.column(c).to_numpy() for c in ("zeros", "ones", "product"))
        weighted = np.logaddexp(_estimate(zeros, ones), product) - _LN2
        share, p = _own(zeros, ones, weighted)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "zeros", "ones")), *(pa.array(x) for x in (weighted, share, p))], names=["key", "zeros", "ones", "weighted", "share", "p"])


def _lengths(batches):
    """log10 probability of each code, from what the root of its part inherits."""
    for table in _parts(batches):
        is_code = table.column("is_code").to_numpy()
        key = table.column("key").to_numpy()
        roots, code = key[~is_code], key[is_code]
        bit, levels = _subtrees(code, table.column("n").to_numpy()[is_code])
        at = np.searchsorted(roots, levels[-1][0])
        mixed, weight = (table.column(c).to_numpy()[~is_code][at] for c in ("mixed", "weight"))
        for depth in range(len(levels) - 1, 0, -1):
            up = levels[depth][1]
            _, _, zeros, ones, _, weighted = levels[depth - 1]
            share, p = _own(zeros, ones, weighted)
            if depth == 1:  # the deepest contexts have nothing below them
                mixed = mixed[up] + weight[up] * p
            else:
                mixed, weight = mixed[up] + weight[up] * share * p, weight[up] * (1 - share)
        q = mixed[levels[0][1]]
        length = np.log10(np.where(bit == 1, q, 1 - q)).reshape(8, -1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(length.astype(np.float32))], names=["code", "length"])


def _above(depth: int) -> Column:
    """The key one byte up of a key whose context has ``depth`` bytes."""
    return F.shiftleft(F.shiftright("key", 8).bitwiseAND((1 << (8 * (depth - 1))) - 1), 8).bitwiseOR(F.col("key").bitwiseAND(255))


def code_lengths(codes: DataFrame) -> DataFrame:
    """``code``, ``length`` (log10 probability of its byte after its context) for a table of distinct ``code``, ``n``.

    ``n`` is the training count; with 0 the code is only asked for. Without any training count each byte has
    probability 1/256.
    """
    part = F.shiftright("code", 8).bitwiseAND((1 << (8 * SPLIT)) - 1).alias("part")
    parted = codes.select(part, "code", "n").repartition("part").sortWithinPartitions("part")
    level = parted.mapInArrow(_roots, "key long, zeros double, ones double, product double")
    levels = {}
    for depth in range(SPLIT, -1, -1):
        levels[depth] = staged(level.mapInArrow(_weighed, "key long, zeros double, ones double, weighted double, share double, p double"), f"level{depth}", "zstd")
        if depth:
            level = levels[depth].groupBy(_above(depth).alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("product"))
    down = levels[0].select("key", (F.col("share") * F.col("p")).alias("mixed"), (1 - F.col("share")).alias("weight"))
    for depth in range(1, SPLIT + 1):
        up = down.select(F.col("key").alias("up"), "mixed", "weight")
        own = F.col("weight") * F.col("share")
        down = levels[depth].withColumn("up", _above(depth)).join(up, "up").select("key", (F.col("mixed") + own * F.col("p")).alias("mixed"), (F.col("weight") - own).alias("weight"))
    inherited = down.select(F.shiftright("key", 8).alias("part"), F.lit(False).alias("is_code"), "key", F.lit(0).cast("long").alias("n"), "mixed", "weight")
    asked = codes.select(part, F.lit(True).alias("is_code"), F.col("code").alias("key"), "n", F.lit(0.0).alias("mixed"), F.lit(0.0).alias("weight"))
    ordered = inherited.unionByName(asked).repartition("part").sortWithinPartitions("part", "is_code", "key")
    return ordered.mapInArrow(_lengths, "code long, length float")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    Learns from the rows where ``train`` holds (null: it does). Null and empty texts have the end token alone.
    Repeated rows are scored each; further columns are ignored; an empty table gives an empty table.
    """
    spark = prepared(docs.sparkSession)
    rows = numbered(docs.select(F.col(id_col), F.coalesce(train, F.lit(True)).alias("train"), F.col(text_col).cast("binary").alias("_text")), "row")
    taught = rows.where("train").select("_text")
    size, texts = rows.agg(F.sum(F.length("_text")), F.count("*")).first()
    # rows of a scan task are numbered one by one from a multiple of 2^33; a chunk is called by its first row
    within = F.col("row").bitwiseAND((1 << 33) - 1) % max(1, CHUNK * texts // (size or CHUNK))
    rows = rows.withColumn("chunk", F.col("row") - within)
    asked = staged(rows.select("chunk", "train", "_text").mapInArrow(_chunk_codes, "chunk long, code long, n long"), "asked", "zstd")
    lengths = code_lengths(staged(asked.groupBy("code").agg(F.sum("n").alias("n")), "codes", "zstd"))
    found = asked.select("chunk", "code").join(lengths, "code").select("chunk", "code", "length")
    counts = staged(taught.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    base = np.log10(total + distinct + 1)
    common = {r["word"].encode(): float(np.log10(r["n"] + 1)) for r in counts.where(F.col("n") * WORDS > total).toLocalIterator()}  # at most WORDS rows
    sent = spark.sparkContext.broadcast(common)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", id_col, "held_out", "n_tokens", "n_known", "known", "score", "rare", "times"]

    def run(texts_: pa.Table, codes: pa.Table) -> pa.Table:
        """Scores of one chunk, whose codes are all in ``codes``."""
        known = sent.value
        code, first = np.unique(codes.column("code").to_numpy(), return_index=True)
        length, places = codes.column("length").to_numpy()[first].astype(np.float64), pd.Index(code)
        texts = texts_.column("_text").to_pylist()
        scores = [np.zeros(0)]
        for _, held in _buffers(texts):
            coded, owner = _coded(held)
            scores.append(np.bincount(owner, length[places.get_indexer(coded)], len(held)))
        tokens, n_known, sums, rare, times = [], [], [], [], []
        for text in texts:
            words = Counter(_lower(text).split())
            words[END.encode()] += 1
            scored, seen, others, often = 0.0, 0, [], []
            for word, n in words.items():
                value = known.get(word)
                if value is None:
                    others.append(word.decode("utf-8", "replace"))
                    often.append(n)
                else:
                    scored += n * value
                    seen += n
            tokens.append(sum(words.values()))
            n_known.append(seen)
            sums.append(scored)
            rare.append(others)
            times.append(often)
        held_out = pa.array([not t for t in texts_.column("train").to_pylist()], pa.bool_())
        return pa.Table.from_arrays([texts_.column("row"), texts_.column(id_col), held_out, pa.array(tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(np.concatenate(scores)), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], names=names)

    parts = max(partitions(spark), (size or 0) // CHUNK)  # a task gets about one chunk, however many there are
    scored = staged(rows.repartition(parts, "chunk").groupBy("chunk").cogroup(found.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(run, f"row long, `{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, known double, score double, rare array<string>, times array<long>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("value"))
    out = scored.drop("rare", "times").join(met, "row", "left")
    base_score = F.col("known") + F.coalesce("value", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(base))
    return out.select(F.col(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score")
