"""Phrases whose words keep together, mined level by level over sorted occurrence relations (SETM).

A relation holds the occurrences of phrases of k words, sorted by piece and position: one row per document, so that no
piece is ever cut, with a gap in the positions between pieces. A level merge-joins the relation with itself at adjacent
positions of a piece, which gives the occurrences of k + 1 words, counts their groups, and writes those that pass the
semi-join with the frequent groups, to be extended next. The first relation is the text itself, read in order.

Words are 64-bit ids, hashed with their language; the counted words prove that no two share an id, or the hash gets
another seed. A phrase is the list of its ids, so counts are exact. The semi-join sends a Bloom filter of the frequent
groups of at most MAX_BITS bits to the tasks, and groups are counted one by one only where one of COUNTERS shared
counters says that they may be frequent. What either lets through in excess is counted and dropped again, so their
sizes never show in the result, and the occurrences stay where they lie; only groups and counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fichero.llm.common import prepared, staged

#: Bounds of a Bloom filter, in bits (2 to the power), and its bits per group where they fit. Three slices of an id are probed.
MIN_BITS, MAX_BITS, BITS_PER_GROUP = 16, 26, 16
_SLICES = (0, 19, 38)
#: Seeds of the word hash, tried in turn until no two words share an id.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_U = np.uint64
#: What a byte does: 0 belongs to a word, 1 parts words, 2 parts pieces.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_WORDS = "lang string, word string, id long, n long"
_WORDS_ARROW = pa.schema([("lang", pa.string()), ("word", pa.string()), ("id", pa.int64()), ("n", pa.int64())])
_PAIRS = "first long, second long, n long"
_PAIRS_ARROW = pa.schema([("first", pa.int64()), ("second", pa.int64()), ("n", pa.int64())])
_RELATION = "at array<int>, words array<long>"
_RELATION_ARROW = pa.schema([("at", pa.list_(pa.int32())), ("words", pa.list_(pa.int64()))])
_GROUPS = "words array<long>, n long"
_GROUPS_ARROW = pa.schema([("words", pa.list_(pa.int64())), ("n", pa.int64())])
_COUNTER_ROWS = "at array<long>, n array<long>"
_COUNTERS_ARROW = pa.schema([("at", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
_KEYED = "key long, words array<long>, n long"
#: Groups a task gathers before it gives them out.
_HELD = 1 << 20
#: Counters that groups of three and more words share before they are counted one by one, and sets of them added up by one task.
COUNTERS, _FAN_IN = 1 << 21, 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def phrase_keys(words: np.ndarray) -> np.ndarray:
    """One 64-bit key per row of word ids."""
    key = np.zeros(len(words), np.uint64)
    for column in words.T:
        key = _mixed(key * _U(0x9E3779B97F4A7C15) + column.view(np.uint64))
    return key.view(np.int64)


class Words:
    """Words of a batch of (text ending in a line feed, lang): bytes, bounds, piece, document and id of each."""

    def __init__(self, batch: pa.RecordBatch, seed: int, other: int | None = None):
        texts = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.data = (data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b"").translate(_LOWER)
        raw = np.frombuffer(self.data, np.uint8)
        kinds = _KINDS[raw]
        inside = np.concatenate(([False], kinds == 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(kinds == 2, dtype=np.int64)[self.starts] if len(raw) else self.starts
        self.of_document = np.searchsorted(self.starts, offsets - offsets[0])  # words before each document
        self.document = np.repeat(np.arange(len(texts)), np.diff(self.of_document))
        lang = batch.column("lang_id").to_numpy().view(np.uint64)[self.document]
        self.id = self._ids(raw, lang, seed)
        self.other = None if other is None else self._ids(raw, lang, other)  # tells apart, within a batch, words that share an id

    def _ids(self, raw: np.ndarray, lang: np.ndarray, seed: int) -> np.ndarray:
        sizes = self.ends - self.starts
        padded = np.concatenate((raw, np.zeros(8, np.uint8)))
        eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
        ids = _mixed(lang ^ (sizes.astype(np.uint64) * _U(seed)))
        left = np.arange(len(sizes))
        step = 0
        while len(left):
            part = np.ascontiguousarray(eights[self.starts[left] + step]).view(np.uint64)[:, 0]
            over = np.maximum(0, 8 - (sizes[left] - step)).astype(np.uint64) * _U(8)
            part = (part << over) >> over  # little-endian: the bytes behind the word are the upper ones
            ids[left] = _mixed(ids[left] * _U(0x9E3779B97F4A7C15) + part)
            step += 8
            left = left[sizes[left] > step]
        return ids.view(np.int64)

    def next_in_piece(self) -> np.ndarray:
        """Whether the next word follows in the same piece, per word but the last."""
        return self.piece[1:] == self.piece[:-1]


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and sizes of the groups of equal rows, sorted by the first column; it may collide, the rest decide too."""
    order = np.argsort(columns[0], kind="stable")
    if not len(order):
        return order, order
    differs = reduce(np.logical_or, [c[order][1:] != c[order][:-1] for c in columns])
    firsts = np.concatenate(([0], np.flatnonzero(differs) + 1))
    return order[firsts], np.diff(np.concatenate((firsts, [len(order)])))


class Bloom:
    """Which ids may be among those of a table: bits set by a job, sent to the tasks as one array of bounded size."""

    def __init__(self, ids: DataFrame, column: str):
        spark = ids.sparkSession
        n = ids.count()
        self.bits = min(MAX_BITS, max(MIN_BITS, (n * BITS_PER_GROUP).bit_length()))
        mask = (1 << self.bits) - 1
        places = ids.select(F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(mask).cast("long")) for s in _SLICES])).alias("place"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63).cast("long")).cast("int"))
        found = places.groupBy(F.shiftright("place", 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("set")).toArrow()  # 2^(MAX_BITS - 6) rows at most
        array = np.zeros(1 << (self.bits - 6), np.uint64)
        array[found.column("at").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
        self.sent = spark.sparkContext.broadcast(array)

    def has(self, ids: np.ndarray) -> np.ndarray:
        array, mask, found = self.sent.value, _U((1 << self.bits) - 1), None
        for shift in _SLICES:
            place = (ids.view(np.uint64) >> _U(shift)) & mask
            hit = (array[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1
            found = hit if found is None else found & hit
        return found


def _count_words(seed: int, other: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch, seed, other)
            at, n = _groups(words.id, words.other)
            texts = pa.array([words.data[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist())], pa.binary()).cast(pa.string())
            langs = batch.column("lang").take(pa.array(words.document[at])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs, texts, pa.array(words.id[at]), pa.array(n, pa.int64())], schema=_WORDS_ARROW)

    return run


def _count_pairs(seed: int, frequent: Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = _pairs(batch, seed, frequent)[2]
            first, n = _groups(phrase_keys(pairs), *pairs.T)
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in pairs[first].T], pa.array(n, pa.int64())], schema=_PAIRS_ARROW)

    return run


def _pairs(batch: pa.RecordBatch, seed: int, frequent: Bloom) -> tuple[Words, np.ndarray, np.ndarray]:
    """First words, and both ids, of the adjacent pairs of frequent words of a piece: the relation merged with itself."""
    words = Words(batch, seed)
    fine = frequent.has(words.id)
    at = np.flatnonzero(fine[1:] & fine[:-1] & words.next_in_piece())
    return words, at, np.stack((words.id[at], words.id[at + 1]), axis=1)


def _relation(at: np.ndarray, words: np.ndarray, documents: np.ndarray) -> pa.RecordBatch:
    """One row per document that has occurrences; ``documents`` holds the number of the document of each, in order."""
    firsts = np.flatnonzero(np.concatenate(([True], documents[1:] != documents[:-1]))) if len(documents) else np.zeros(0, np.int64)
    cuts = np.concatenate((firsts, [len(documents)])).astype(np.int32)
    columns = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cuts * words.shape[1]), pa.array(words.reshape(-1)))]
    return pa.RecordBatch.from_arrays(columns, schema=_RELATION_ARROW)


def _write_pairs(seed: int, frequent: Bloom, pairs: Bloom):
    """Occurrences of likely frequent pairs. Positions count words and leave a gap between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at, two = _pairs(batch, seed, frequent)
            kept = pairs.has(phrase_keys(two))
            at, two = at[kept], two[kept]
            yield _relation(at + words.piece[at], two, words.document[at])

    return run


def _occurrences(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, ids and document numbers of a batch of a relation of k words."""
    at, words = batch.column("at"), batch.column("words")
    counts = np.diff(at.offsets.to_numpy())
    return at.flatten().to_numpy(), words.flatten().to_numpy().reshape(-1, k), np.repeat(np.arange(batch.num_rows), counts)


def _lists(words: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.reshape(-1)))


def _extended(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The relation merge-joined with itself at adjacent positions: occurrences of k + 1 words."""
    at, words, documents = _occurrences(batch, k)
    left = np.flatnonzero((at[1:] == at[:-1] + 1) & (documents[1:] == documents[:-1]))
    return at[left], np.concatenate((words[left], words[left + 1, -1:]), axis=1), documents[left]


def _counters(k: int, size: int):
    """How many occurrences of k + 1 words fall on each of ``size`` counters: one row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(phrase_keys(_extended(batch, k)[1]) & (size - 1), minlength=size)
        yield from _counter_rows(counts, 1)

    return run


def _counter_rows(counts: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(counts >= least)
    for cut in range(0, len(at), 1 << 16):
        part = at[cut : cut + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.list_(pa.int64())) for c in (part, counts[part])], schema=_COUNTERS_ARROW)


def _summed(size: int, least: int):
    """Counters of several tasks added up, which leaves one set per task of this step; lower ones than ``least`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for at, n in zip(batch.column("at"), batch.column("n")):
                np.add.at(counts, at.values.to_numpy(), n.values.to_numpy())
        yield from _counter_rows(counts, least)

    return run


class Likely:
    """Which groups of k + 1 words may occur ``least`` times, by COUNTERS counters that many groups share.

    A counter is never below the count of one of its groups, so no frequent group is missed; groups it lets through in
    excess are counted exactly like the others. Tasks' counters are added up by a few tasks, ``_FAN_IN`` to one, until one
    set of bounded size is left to be sent out.
    """

    def __init__(self, relation: DataFrame, k: int, least: int):
        self.size = COUNTERS
        sets = staged(relation.mapInArrow(_counters(k, COUNTERS), _COUNTER_ROWS), "counters")
        tasks = 0
        while tasks != 1:
            tasks = -(-sets.rdd.getNumPartitions() // _FAN_IN)
            sets = staged(sets.coalesce(tasks).mapInArrow(_summed(COUNTERS, least if tasks == 1 else 1), _COUNTER_ROWS), "counters")
        bits = np.zeros(COUNTERS, bool)
        for row in sets.select("at").collect():  # one set of COUNTERS at most
            bits[row["at"]] = True
        self.sent = relation.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & (self.size - 1)
        return (self.sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _count_extended(k: int, likely: Likely):
    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        words, n = (np.concatenate(c) for c in zip(*parts))
        keys = phrase_keys(words)
        order = np.lexsort((*words.T[::-1], keys))
        first, sizes = _groups(keys[order], *words[order].T)
        return words[order][first], np.add.reduceat(n[order], np.cumsum(sizes) - sizes) if len(n) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            words = _extended(batch, k)[1]
            words = words[likely.has(phrase_keys(words))]
            first, n = _groups(phrase_keys(words), *words.T)
            held.append((words[first], n))
            if sum(len(n) for _, n in held) > _HELD:
                held = [merged(held)]
                if len(held[0][1]) > _HELD // 2:
                    yield pa.RecordBatch.from_arrays([_lists(held[0][0]), pa.array(held[0][1], pa.int64())], schema=_GROUPS_ARROW)
                    held = []
        if held:
            words, n = merged(held)
            yield pa.RecordBatch.from_arrays([_lists(words), pa.array(n, pa.int64())], schema=_GROUPS_ARROW)

    return run


def _extend(k: int, frequent: Bloom):
    """The merge-join, then the semi-join with the frequent groups of k + 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words, documents = _extended(batch, k)
            kept = frequent.has(phrase_keys(words))
            yield _relation(at[kept], words[kept], documents[kept])

    return run


def _keyed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words").flatten().to_numpy().reshape(-1, k)
            yield pa.RecordBatch.from_arrays([pa.array(phrase_keys(words)), batch.column("words"), batch.column("n")], names=["key", "words", "n"])

    return run


def _counted_words(texts: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, id, n) of every word, and the seed under which every word has an id of its own."""
    for i, seed in enumerate(SEEDS):
        words = texts.mapInArrow(_count_words(seed, SEEDS[i - 1]), _WORDS).groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))
        words = staged(words, "words")
        if words.groupBy("id").count().where("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("two words share an id under every seed")


def frequent_phrases(docs: DataFrame, longest: int, least: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, id, n) of all documents, and phrases (words, n) of 1 to ``longest`` words that occur ``least`` times or more."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = docs.select(F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")).alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("lang_id"))
    words, seed = _counted_words(texts)
    levels = [words.where(F.col("n") >= least).select(F.array("id").alias("words"), "n")]
    frequent = Bloom(words.where(F.col("n") >= least).select("id"), "id")
    pairs = texts.mapInArrow(_count_pairs(seed, frequent), _PAIRS).groupBy("first", "second").agg(F.sum("n").alias("n"))
    groups, relation = pairs.select(F.array("first", "second").alias("words"), "n"), None
    for k in range(2, longest + 1):
        if k > 2:
            groups = relation.mapInArrow(_count_extended(k - 1, Likely(relation, k - 1, least)), _GROUPS).groupBy("words").agg(F.sum("n").alias("n"))
        groups = staged(groups.where(F.col("n") >= least).mapInArrow(_keyed(k), _KEYED), "groups")
        levels.append(groups.select("words", "n"))
        if k < longest:
            known = Bloom(groups, "key")
            relation = texts.mapInArrow(_write_pairs(seed, frequent, known), _RELATION) if k == 2 else relation.mapInArrow(_extend(k - 1, known), _RELATION)
            relation = staged(relation, "relation")
    return words, staged(reduce(DataFrame.unionByName, levels), "phrases")


def _parts(words: Column) -> Column:
    """All runs of two or more of the ids, but the whole."""
    size = F.size(words)
    return F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda s: F.slice(words, s, n))))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, best: int = 2000, share: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of 2 to ``longest`` words.

    A to Z count as a to z. Texts part into pieces at .,;:!? and line breaks, pieces into words at blanks and tabs. n is
    the number of words of a language, a how often a phrase occurs in its pieces (overlaps included), at least ``least``
    times. Cut after k words, a phrase scores floor(1000 a n / (l r)) with the counts l and r of its halves; its lowest
    cut counts, the first one at ties. A phrase that lies in a longer one is dropped where ``100 a(longer) >= share a``.
    Order: score and a descending, then the phrase by its bytes.

    A null language is ``und``, a null text is empty. Repeated rows count as often as they occur. A text is taken whole,
    in one task, whatever its length. Only the two named columns are read. Empty tables, and languages without frequent
    phrases, give no rows. Counts may pass 64 bits in products, not by themselves.
    """
    prepared(docs.sparkSession)
    words, phrases = frequent_phrases(docs, longest, least, text_col, lang_col)
    whole = words.groupBy("lang").agg(F.sum("n").alias("total"))
    candidates = phrases.where(F.size("words") > 1).select("words", F.col("n").alias("a"))
    covers = candidates.where(F.size("words") > 2).select(F.explode(_parts(F.col("words"))).alias("words"), F.col("a").alias("longer"))
    covers = covers.groupBy("words").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = candidates.join(covers, "words", "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * share)).drop("longer")

    cuts = kept.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn("right", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select(F.col("words").alias(side), F.col("n").alias(name)), side)
    named = words.where(F.col("n") >= least).join(whole, "lang").select("id", "lang", "word", "total")
    texts = kept.select("words", F.posexplode("words").alias("at", "id")).join(named, "id").groupBy("words").agg(
        F.first("lang").alias("lang"), F.first("total").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
    )
    scored = cuts.join(texts, "words").withColumn("score", F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))").cast("long"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("low")
    found = scored.groupBy("words", "lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
