"""Which words of documents lie in passages of benchmark items, found by winnowing.

A window is ``length`` consecutive words of an item (a shorter item is one window). Of each window's k-grams the one
with the smallest hash is its fingerprint. Documents keep, for every run of ``length`` words, the same smallest k-gram:
so a document that holds an item's window shares its fingerprint for certain, though only about two of seven k-grams
are kept. Fingerprints of both sides are joined, and every hit is extended to the item's window around it and
compared word by word.

Column functions only. A fingerprint is one long: 33 bits of the k-gram's hash above 30 bits of its place, so that
one minimum gives both, the leftmost k-gram at ties. Equal texts are compared once: a text's hash of 128 bits is its key.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fichero.functions.plan import evaluated_once
from fichero.llm.common import prepared, staged

#: Words of a k-gram.
K = 5
#: Every run of ASCII characters other than letters and digits parts words.
PARTING = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLACE_BITS, _HASH_SHIFT = 30, 31
#: Tasks that share the copies of one text.
_SALTS = 16


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARTING), lambda w: w != "")


def lowered(text: Column) -> Column:
    """A to Z in lower case; other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _with_hashes(df: DataFrame) -> DataFrame:
    """Adds ``words`` of ``text`` and ``hashes``, one per word. The hash lowers all letters, which at most adds hits to compare."""
    df = evaluated_once(df, "words", words_of(F.col("text")))
    return evaluated_once(df, "hashes", F.transform("words", lambda w: F.xxhash64(F.lower(w))))


def _with_grams(df: DataFrame, k: int) -> DataFrame:
    """Adds ``grams``: hash and place of the k-gram at every word; the last k - 1 are never asked for."""
    gram = F.transform(
        "hashes", lambda h, p: F.shiftleft(F.shiftrightunsigned(F.xxhash64(h, *[F.get("hashes", p + i) for i in range(1, k)]), _HASH_SHIFT), _PLACE_BITS).bitwiseOR(p.cast("long"))
    )
    return evaluated_once(df, "grams", gram)


def _least(start: Column, length: int, k: int) -> Column:
    """Fingerprint of the window of ``length`` words from ``start`` (0-based)."""
    return F.array_min(F.slice("grams", start + 1, length - k + 1))


def _hash(fingerprint: Column) -> Column:
    return F.shiftright(fingerprint, _PLACE_BITS)


def _place(fingerprint: Column) -> Column:
    return fingerprint.bitwiseAND((1 << _PLACE_BITS) - 1).cast("int")


def item_windows(items: DataFrame, length: int, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(length, hash, back, window, item): windows of all items, their fingerprint and how far it lies behind the window's start."""
    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    rows = _with_hashes(named).where(F.size("words") > 0)
    short = [rows.where(F.size("words") == n) for n in range(1, length)]
    parts = []
    for n, own in [*zip(range(1, length), short), (length, rows.where(F.size("words") >= length))]:
        own = _with_grams(own, min(k, n)).select("item", "words", "grams", F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("start"))
        least = _least(F.col("start"), n, min(k, n))
        window = lowered(F.array_join(F.slice("words", F.col("start") + 1, n), " "))
        parts.append(own.select(F.lit(n).alias("length"), _hash(least).alias("hash"), (_place(least) - F.col("start")).alias("back"), window.alias("window"), "item"))
    return reduce(DataFrame.unionByName, parts)


def _fingerprints(docs: DataFrame, lengths: list[int], k: int) -> DataFrame:
    """Adds ``kept``, the (length, fingerprint) of every window of the lengths the items ask for, each once."""
    for gram in sorted({min(k, n) for n in lengths}):
        docs = _with_grams(docs, gram).withColumnRenamed("grams", f"grams{gram}")
    lists = []
    for n in lengths:
        gram = min(k, n)
        least = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda s: F.array_min(F.slice(f"grams{gram}", s + 1, n - gram + 1)))
        kept = F.when(F.size("words") >= n, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))
        lists.append(F.transform(kept, lambda f: F.struct(F.lit(n).alias("length"), f.alias("at"))))
    return docs.withColumn("kept", F.concat(*lists) if lists else F.expr("CAST(array() AS array<struct<length: int, at: bigint>>)"))


def _covered(spans: Column) -> Column:
    """How many places the sorted (start, length) spans cover together."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))
    return F.aggregate(
        spans, start,
        lambda a, s: F.struct(F.greatest(a["reach"], s["start"] + s["length"]).alias("reach"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["reach"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )


def contaminated(docs: DataFrame, items: DataFrame, length: int = 10, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items) per document: its words, those inside an occurrence of a window, and the items of these windows.

    ``items`` are the ids as text, sorted. Null and empty texts have no words, and items of that kind no window; a null
    item id counts as an empty one. Rows of one item id are one item; repeated documents are answered one by one. Texts
    of any length are taken whole. Only the named columns are read, so others may have any name. Without documents the
    result is empty, without items nothing is hit.
    """
    spark = prepared(docs.sparkSession)
    windows = staged(item_windows(items, length, k, item_col, item_text_col).distinct(), "windows")
    lengths = [r[0] for r in windows.select("length").distinct().sort("length").collect()]  # as many as ``length`` at most
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = _fingerprints(_with_hashes(texts), lengths, k).select("doc", "key", F.size("words").cast("long").alias("n_words"), "kept")
    rows = staged(rows, "fingerprints")

    kept = rows.select("key", F.explode("kept").alias("one")).select("key", F.col("one.length").alias("length"), _hash(F.col("one.at")).alias("hash"), _place(F.col("one.at")).alias("place"))
    hits = kept.join(windows.select("length", "hash", "back").distinct(), ["length", "hash"])
    starts = hits.select("key", "length", (F.col("place") - F.col("back")).alias("start")).where("start >= 0").distinct()
    starts = staged(starts.groupBy("key").agg(F.collect_list(F.struct("start", "length")).alias("starts")), "starts")

    # one text per key that has hits; the copies of a text are dealt to several tasks before one of them is kept
    asked = starts.select("key", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    copies = texts.select("key", "text", (F.monotonically_increasing_id() % _SALTS).cast("int").alias("salt"))
    # always by a merge, so that the plan is the same at every size of the corpus
    whole = copies.join(asked.hint("merge"), ["key", "salt"], "left_semi").dropDuplicates(["key", "salt"]).dropDuplicates(["key"]).drop("salt").join(starts, "key")
    cut = evaluated_once(whole, "words", words_of(F.col("text"))).select("key", "words", F.explode("starts").alias("one"))
    found = cut.select("key", "one.start", "one.length", lowered(F.array_join(F.slice("words", F.col("one.start") + 1, F.col("one.length")), " ")).alias("window"))
    found = staged(found.join(windows.select("length", "window").distinct(), ["length", "window"], "left_semi"), "found")

    hit = found.groupBy("key").agg(_covered(F.array_sort(F.collect_list(F.struct("start", "length")))).cast("long").alias("n_hit"))
    named = found.select("key", "length", "window").distinct().join(windows.select("length", "window", "item"), ["length", "window"]).select("key", "item").distinct()
    answers = hit.join(named.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items")), "key")
    return rows.select("doc", "key", "n_words").join(answers, "key", "left").select(
        F.col("doc").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
