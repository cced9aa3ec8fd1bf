"""Hard negatives, decontamination and phrases against plain computations, with nulls, ties, repeats, long texts and clashing columns."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fichero.llm import decontaminate, negatives, phrases


def mined(rows, is_anchor, wanted=5):
    """(anchor, positive, rank, negative, positive score, score) by scoring all pairs."""
    fine = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, c, v in fine:
        if not is_anchor(i):
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, d) for j, d, w in fine if j != i and len(w) == len(v))
        for minus, j, _ in [o for o in others if o[2] == c][:wanted]:
            fits = [o for o in others if o[2] != c and 80 * -minus <= 100 * -o[0] <= 100 * -minus][:wanted]
            out += [(i, j, rank, o[1], -minus, -o[0]) for rank, o in enumerate(fits, 1)]
    return sorted(out)


def embedded():
    draw = random.Random(3)
    rows = [(i, draw.randint(0, 2), [round(draw.uniform(-0.2, 1), 2) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, i % 3, [0.5] * 6) for i in range(40)]  # ties
    rows += [(400, 1, None), (401, None, [1.0] * 6), (402, 2, [1.0, None] * 3), (403, 2, [float("inf")] * 6), (404, 0, [float("nan")] * 6)]
    rows += [(500, 0, [-1.0] * 6), (520, 1, [0.0] * 6), (540, 1, [0.4] * 4), (541, 2, [0.4] * 4), (542, 1, [0.5] * 4), (560, 1, []), (561, 1, []), (None, 1, [0.5] * 6)]
    return rows + [rows[20], rows[21]]  # an anchor and another row twice


@pytest.mark.parametrize("blocks", [(1 << 20, 4096, 512, 16), (400, 7, 3, 2)])
def test_hard_negatives(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_BYTES", "BLOCK_ROWS", "ANCHORS", "CHUNK"), blocks):
        monkeypatch.setattr(negatives, name, value)
    rows = embedded()
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("row", F.lit("r")).withColumn("score", F.lit(1)).withColumn("slot", F.lit(2))
    got = sorted(tuple(r) for r in negatives.mine(table.repartition(3), F.col("vec_id") % 20 == 0).collect())
    assert got == mined(rows, lambda i: i % 20 == 0)
    assert negatives.mine(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert negatives.mine(table, F.col("vec_id") < 0).collect() == []


def test_hard_negatives_of_huge_components(spark):
    rows = [(0, 1, [1e6, 1e6]), (1, 1, [2e6, 1e6]), (2, 2, [1.9e6, 1e6]), (3, 2, [1.9e6, 1.1e6]), (4, 2, [1e6, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(r) for r in negatives.mine(table, F.col("vec_id") == 0).collect()) == mined(rows, lambda i: i == 0)


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def hits(docs, items, length):
    windows = collections.defaultdict(set)
    for name, text in items:
        w = words_of(text)
        for s in range(max(0, len(w) - length) + 1 if w else 0):
            windows[tuple(w[s : s + length])].add("" if name is None else str(name))
    out = []
    for name, text in docs:
        w, covered, found = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    covered.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((name, len(w), len(covered), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("few,length", [(3, 10), (400, 10), (2, 4)])
def test_decontamination(spark, few, length):
    draw = random.Random(few)
    vocabulary = ["".join(draw.choices("abcdeßé1", k=draw.randint(1, 5))) for _ in range(few)]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = [(i, text(draw.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(15)] + [(3, text(12)), (90, None), (91, ""), (None, text(14)), (5, "Ä Ö")]
    shared = [t for _, t in items if t]
    docs = [(i, f"{text(draw.randint(0, 30))}. {draw.choice(shared).upper()}, {text(draw.randint(0, 40))}") for i in range(30)]
    docs += [(100, None), (101, ""), (102, "--- !"), (103, "ä ö"), (104, "Ä ö Ä Ö"), (105, " ".join(shared)), (105, " ".join(shared)), (None, shared[0]), (106, text(20000) + shared[1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("words", F.lit("w")).withColumn("grams", F.lit("g"))
    marks = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(1)).withColumn("item", F.lit(1))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.contaminated(table.repartition(3), marks, length).collect()), key=str)
    assert got == hits(docs, items, length)


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contaminated(docs.limit(0), items).collect() == []
    assert sorted(tuple(r) for r in decontaminate.contaminated(docs, items.limit(0)).collect()) == [(1, 2, 0, []), (2, 0, 0, [])]


def collocated(docs, longest, least, best, share):
    counts, total = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(w[s : s + k])) for s in range(len(w) - k + 1))
    frequent = {(c, p): n for (c, p), n in counts.items() if n >= least and len(p) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in frequent.items():
        inside = lambda q: any(q[s : s + len(p)] == p for s in range(len(q) - len(p) + 1))
        if any(c == lang and len(q) > len(p) and 100 * n >= share * a and inside(q) for (c, q), n in frequent.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * total[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    rows = []
    for lang, found in out.items():
        rows += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:best], 1)]
    return sorted(rows)


@pytest.mark.parametrize("least,best,share", [(3, 2000, 100), (2, 7, 60)])
def test_collocations(spark, least, best, share):
    draw = random.Random(least)
    vocabulary = ["".join(draw.choices("abcÀéß", k=draw.randint(1, 12))) for _ in range(25)] + ["x" * 40, "x" * 41, "Ab", "aB"]
    docs = []
    for i in range(60):
        pieces = [" \t".join(draw.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=draw.randint(0, 12))) for _ in range(draw.randint(0, 6))]
        docs.append((draw.choice([". ", ",", "\n", "\r\n", "?", " "]).join(pieces), draw.choice(["en", "de", None])))
    docs += [(None, "en"), ("", None), (" \t ", "fr"), ("solo", "fr"), ("one two three four five six. " * 5, "fr"), (docs[0][0], docs[0][1]), ("tail one", "es"), ("two tail", "es")]
    docs += [(" ".join(draw.choices(vocabulary, k=20000)), "long")]
    table = spark.createDataFrame(docs, "text string, lang string").withColumn("words", F.lit(1)).withColumn("id", F.lit(2)).withColumn("n", F.lit(3)).withColumn("lang_id", F.lit(4))
    got = sorted(tuple(r) for r in phrases.collocations(table.repartition(3), least=least, best=best, share=share).collect())
    assert got == collocated(docs, 5, least, best, share)
    assert phrases.collocations(table.limit(0)).collect() == []


def test_words_that_share_an_id_get_another_seed(spark, monkeypatch):
    """Under the first seed all words of one length are one: the counted words show it."""
    ids = phrases.Words._ids

    def colliding(self, raw, lang, seed):
        return (self.ends - self.starts).astype("int64") if seed == phrases.SEEDS[0] else ids(self, raw, lang, seed)

    monkeypatch.setattr(phrases.Words, "_ids", colliding)
    batch = phrases.pa.RecordBatch.from_pydict({"text": ["ab cd ab.\n"], "lang": ["en"], "lang_id": [1]})
    first = next(phrases._count_words(phrases.SEEDS[0], phrases.SEEDS[-1])(iter([batch])))
    told = collections.Counter()
    for word, n in zip(first.column("word").to_pylist(), first.column("n").to_pylist()):
        told[word] += n
    assert told == {"ab": 2, "cd": 1}
    assert len(set(first.column("id").to_pylist())) == 1


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MAX_BITS", 6)
    monkeypatch.setattr(phrases, "MIN_BITS", 6)
    monkeypatch.setattr(phrases, "COUNTERS", 4)
    monkeypatch.setattr(phrases, "_FAN_IN", 2)
    draw = random.Random(9)
    docs = [(" ".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=60)), "en") for _ in range(20)]
    table = spark.createDataFrame(docs, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(table.repartition(7), least=3).collect()) == collocated(docs, 5, 3, 2000, 100)
