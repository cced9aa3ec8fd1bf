"""Each operator against a plain computation on small tables with nulls, empty and long texts, ties and repeats."""

import functools
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from fichero.llm import bpe, ctw, language, mixing, neighbours, simhash, suffixes, topk, toxicity, warc
from fichero.llm.components import components

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source) with every awkward case."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(draw.choices(words, k=n))
    passage, long = text(90), text(5000)
    out = [text(draw.randint(1, 120)) for _ in range(60)] + [None, "", " \t\n", "x", "Two Words", "ÄÖ ß Σ", long, long, "a" * 900]
    out += [f"{text(20)} {passage} {text(20)}" for _ in range(9)] + [passage + " " + text(3), long[:4000] + " changed " + long[4000:]]
    return [(i, t, None if i % 7 == 0 else f"s{i % 3}") for i, t in enumerate(out)] + [(1, out[1], "s1"), (None, out[2], "s0")]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit(1)).withColumn("row", F.lit("r")).withColumn("h", F.lit(2))
    frame.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def smallest(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    draw = random.Random(1)
    pairs = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(50)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    want = smallest([(a, b) for a, b in pairs if a != b], nodes)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_suffixes(docs, rows):
    got = sorted(map(tuple, suffixes.deduplicated(docs, carried=["doc_id"]).collect()), key=str)
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    want = []
    for (i, _, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        runs = sum(1 for a, b in zip(b"\0" + bytes(gone), gone) if b and not a)
        want.append((i, len(t), sum(gone), runs, bytearray(c for c, g in zip(t, gone) if not g)))
    assert got == sorted(want, key=str)
    assert sum(w[2] for w in want) > 40_000
    assert suffixes.deduplicated(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("query", ["suffixes", "simhash", "mixing"])
def test_rows_keep_their_numbers_when_scans_are_split_otherwise(spark, docs, monkeypatch, query):
    module, run = {
        "suffixes": (suffixes, lambda: suffixes.deduplicated(docs, carried=["doc_id"])),
        "simhash": (simhash, lambda: simhash.one_of_each(docs)),
        "mixing": (mixing, lambda: mixing.mixed(docs)),
    }[query]
    plain = sorted(map(str, run().collect()))
    staged, splits = module.staged, "spark.sql.files.minPartitionNum"

    def fewer_splits_after(df, name):
        out = staged(df, name)
        spark.conf.set(splits, "1")
        return out

    monkeypatch.setattr(module, "staged", fewer_splits_after)
    try:
        assert sorted(map(str, run().collect())) == plain
    finally:
        spark.conf.unset(splits)


def test_suffixes_of_hot_grams(docs, monkeypatch):
    plain = sorted(map(str, suffixes.deduplicated(docs, carried=["doc_id"]).collect()))
    monkeypatch.setattr(suffixes, "HOT", 2)
    assert sorted(map(str, suffixes.deduplicated(docs, carried=["doc_id"]).collect())) == plain


def test_merge_of_runs():
    draw = random.Random(3)
    runs, every = [], []
    for r in range(5):
        entries = sorted({bytes(draw.choices(b"ab", k=draw.randint(0, 9))): None for _ in range(40)})
        runs.append(suffixes.pack([(e, b"L", [(r, i)]) for i, e in enumerate(entries)]))
        every += entries
    got = list(suffixes.merged(runs))
    assert [g[0] for g in got] == sorted(every)
    assert [g[1] for g in got][1:] == [suffixes.common_prefix(a[0], b[0]) for a, b in zip(got, got[1:])]


def test_simhash(docs, rows):
    def fingerprint(text):
        words = [w for w in (text or "").encode().lower().split()]
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(i, fingerprint(t)) for i, t, _ in rows]
    known = [(i, p) for i, p in prints if i is not None]
    want = smallest([(a, b) for a, p in known for b, q in known if (p ^ q).bit_count() <= 3], {i for i, _ in known})
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(g.doc_id, g.fp & (1 << 64) - 1) for g in got} == set(prints)
    assert all(g.component_id == want[g.doc_id] for g in got if g.doc_id is not None)
    kept = simhash.one_of_each(docs).collect()
    assert sorted(k.doc_id for k in kept) == sorted(set(want.values()))
    assert simhash.one_of_each(docs.where("doc_id < 0")).count() == 0


def test_hamming_index_with_divided_nodes(spark, monkeypatch):
    draw = random.Random(9)
    codes = [draw.getrandbits(64) for _ in range(60)]
    codes += [c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5))) for c in codes for _ in range(4)]
    frame = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)], "node long, fp long")
    want = smallest([(i, j) for i, a in enumerate(codes) for j, b in enumerate(codes) if (a ^ b).bit_count() <= 3], range(len(codes)))
    for hot in (simhash.HOT, 1):
        monkeypatch.setattr(simhash, "HOT", hot)
        got = dict(map(tuple, simhash.hamming_components(frame).collect()))
        assert {i: got.get(i, i) for i in range(len(codes))} == want


def test_top_k(spark):
    draw = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in draw.normal(0, 1, 6)]) for i in range(200)] + [(500 + i, [1.0] * 6) for i in range(30)]
    vectors += [(300, None), (301, [float("nan")] * 6), (302, [None] * 6), (303, [1.0]), (304, [0.0] * 6), (None, [1.0] * 6), (320, [1e12] * 6)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), 5).collect()
    fine = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors if i is not None and v and None not in v and not np.isnan(v).any()}
    want = []
    for q in (i for i in fine if i % 20 == 0):
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(fine[q], v)))), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_neighbours(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(40, 16))
    vectors = [b + 0.1 * draw.normal(size=16) for b in base for _ in range(6)] + [base[0]] * 4 + [base[1] + 0.02 * draw.normal(size=16) for _ in range(60)]
    table = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 16), (902, [float("inf")] * 16), (903, [1.0])]
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = smallest(list(zip(*map(lambda x: x.tolist(), np.nonzero(near)))), range(len(vectors)))
    found = sum(min(got[i].n_links, n) for i, n in enumerate(near.sum(axis=1)))
    assert found >= 0.9 * near.sum() and all(got[i].n_links <= n for i, n in enumerate(near.sum(axis=1)))
    assert np.mean([got[i].component_id == c for i, c in want.items()]) > 0.9
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903))


def clumps(spark):
    """Links and components of clumps larger than a list, some near each other, against all pairs."""
    draw = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v)
    vectors = []
    for _ in range(5):
        one = unit(draw.normal(size=24))
        two = unit(one + 0.42 * unit(draw.normal(size=24)))
        three = unit(two + 0.42 * unit(draw.normal(size=24)))
        vectors += [c + 0.004 * draw.normal(size=24) for c in (one, two, three) for _ in range(3 * neighbours.LIST)]
    table = [(int(i), [float(x) for x in v]) for i, v in zip(draw.permutation(len(vectors)), vectors)]
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()}
    own = np.array([v for _, v in sorted(table)])
    own = own / np.linalg.norm(own, axis=1, keepdims=True)
    near = own @ own.T >= 0.9
    np.fill_diagonal(near, False)
    want = smallest(list(zip(*map(lambda x: x.tolist(), np.nonzero(near)))), range(len(own)))
    assert len(set(want.values())) < 15
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (int(near[i].sum()), c) for i, c in want.items()}


def test_neighbours_of_clumps_larger_than_a_list(spark):
    clumps(spark)


def test_neighbours_compared_whole_where_the_audit_stays_short(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RECALL", 2.0)
    monkeypatch.setattr(neighbours, "ROUNDS", 1)
    monkeypatch.setattr(neighbours, "_descended", lambda lists, nodes, home, kind: lists.select("a", "b", "sim").where("false"))
    monkeypatch.setattr(neighbours, "_first_lists", lambda nodes, *_: nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("sim")).where("false"))
    monkeypatch.setattr(neighbours, "SENT", 20_000)
    clumps(spark)


def test_bpe(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(VOCABULARY)
    odd = ["Hello, World's 99 naïve café́ ΣΑΣ <|endoftext|>x \x1c\x1dab\x00c", "", "a" * 3000, "<|startoftext|>", "it's we'll　x\u0085y", "日本語 テスト 👍🏽!!"]
    got = bpe.encode(docs.sparkSession.createDataFrame([(t,) for t in odd], "text string").withColumn("again", F.col("text")), VOCABULARY).collect()
    c = bpe.codec(VOCABULARY)
    for r in got:
        ids = plain.encode(r.again, add_special_tokens=False).ids
        assert r.ids == ids and c.decode(ids) == plain.decode(ids, skip_special_tokens=False)
    for r in bpe.digests(docs.withColumn("again", F.col("text")), VOCABULARY).collect():
        ids = plain.encode(r.again or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_a_full_memory_keeps_what_is_asked_for_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    made = []
    memory = bpe._Remembered(lambda k: made.append(k) or k.upper())
    assert [memory[k] for k in "abcdaebafa"] == list("ABCDAEBAFA")
    assert made.count("a") == 1 and len(memory) <= 3 and len(memory.old) <= 3


def test_warc(spark, tmp_path):
    html = ["<p>" + "x" * n + "</p>" for n in (5, 2000, 2000, 3000, 2000, 5)] + [None, ""]
    pages = [(i, None if i == 2 else f"http://h/{i}%\n", h) for i, h in enumerate(html)] + [(4, "again", html[4]), (None, "none", html[3])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    index = warc.write_archives(spark.read.parquet(str(tmp_path / "p")))
    got = warc.read_records(index).collect()
    assert len(got) == len(pages) == index.count()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
        assert r.payload is None or hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    assert [by[i][0].record_type for i in range(8)] == ["response", "revisit", "revisit", "response", by[4][0].record_type, "response", "response", "response"]
    assert sorted(r.record_type for r in by[4]) == ["response", "revisit"] and by[1][0].refers_to == by[2][0].refers_to == 4
    assert by[None][0].refers_to == 3 and by[0][0].url == "http://h/0%\n" and by[2][0].url is None
    some = warc.read_records(index.where("page_id in (3, 6)")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in some) == [(3, 3007), (6, 0)]


def test_warc_of_tables_that_are_not_stored(spark):
    """Rows that are dealt anew at every reading: every revisit refers to a response that was written."""
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.concat((F.col("id") % 20).cast("string"), F.lit("-")), 700).alias("html"))
    for given in (pages.repartition(4), pages.distinct(), pages.where("page_id < 300").union(pages.where("page_id >= 300")).repartition(3, "html")):
        index = warc.write_archives(given)
        read = warc.read_records(index).collect()
        stored = {r.page_id for r in read if r.record_type == "response"}
        assert len(read) == 600 and stored == set(range(580, 600))
        assert {r.refers_to for r in read if r.record_type == "revisit"} <= stored


def test_mixing(docs, spark, tmp_path):
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert len(got) == docs.count() and all(r.taken == r.size * r.copies and 0 <= r.copies <= 2 for r in got)
    draw = random.Random(8)
    sized = [(i, " ".join(["w"] * draw.randint(0, 60)), draw.choice(["a", "b", None, "c", "é"])) for i in range(9000)]
    spark.createDataFrame(sized, "doc_id long, text string, source string").write.parquet(str(tmp_path / "m"))
    frame = spark.read.parquet(str(tmp_path / "m"))
    taken, target, size = {}, {}, {}
    source = {i: s for i, _, s in sized}
    for r in mixing.mix(frame).collect():
        s = source[r.doc_id]
        taken[s], target[s], size[s] = taken.get(s, 0) + r.taken, r.target, r.source_size
    weight, left, want = dict(zip(["a", "b", "c", "é", None], [3, 1, 2, 3, 1])), 1.5 * sum(size.values()), {}
    open_ = set(size)
    while over := [s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > 2 * size[s]]:
        for s in over:
            want[s] = 2.0 * size[s]
        open_ -= set(over)
        left = 1.5 * sum(size.values()) - sum(want.values())
    want |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 60 for s in size)
    assert mixing.mixed(frame).count() == sum(r.copies for r in mixing.mix(frame).collect())


def test_language(docs, spark):
    draw = random.Random(2)
    make = lambda letters: " ".join("".join(draw.choices(letters, k=5)) for _ in range(40))
    table = [(i, make("abcde") if i % 2 else make("défgh"), "xx" if i % 2 else "yy") for i in range(200)] + [(900, None, "xx"), (901, "12 ?", "yy"), (902, "", None)]
    frame = spark.createDataFrame(table, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(frame, F.col("doc_id") < 100).collect()}
    assert all(got[i].lang_pred == ("xx" if i % 2 else "yy") and 0 < got[i].score <= 1 for i in range(200))
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert {r.lang_pred for r in language.identify(frame, F.lit(False)).collect()} == {"und"}


def test_toxicity(spark):
    draw = random.Random(6)
    table = [(i, " ".join(draw.choices("one two three four five six seven".split(), k=60)) + (" awful" if i % 3 == 0 else "")) for i in range(900)] + [(None, "x"), (5000, None), (5001, "")]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(7, None), (3, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(frame, toxicity.fit(frame, labels)).toPandas()
    late = got[(got.doc_id >= 600) & (got.doc_id < 900)]
    assert ((late.score >= 0.7) == (late.doc_id % 3 == 0)).all() and got.score.between(0, 1).all() and len(got) == 903
    kept = toxicity.accepted(frame.withColumn("score", F.lit("own")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.where("text like '%awful%'").count() == 0 and kept.count() == 603


def test_context_trees(docs, rows):
    got = ctw.score(docs, F.col("doc_id") % 3 != 0).collect()
    train = [t for i, t, _ in rows if i is None or i % 3]
    counts = {}
    for t in train:
        for w in [*(t or "").encode().lower().split(), b"\n"]:
            counts[w] = counts.get(w, 0) + 1
    n, v, texts = sum(counts.values()), len(counts), {i: t for i, t, _ in rows}
    for r in got:
        words = [*(texts[r.doc_id] or "").encode().lower().split(), b"\n"]
        base = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and r.score < 0
        assert r.held_out == (r.doc_id is not None and r.doc_id % 3 == 0)


def plain_context_tree(train, texts):
    """log10 probability of each text, by recursion over the tree of every decision."""
    coded = lambda t: b"\0" * ctw.DEPTH + (t or "").encode().lower() + b"\xff"
    counts, children = {}, {}

    def decisions(data, i):
        for level in range(8):
            node = (1 << level) + (data[i] >> (8 - level))
            yield node, (data[i] >> (7 - level)) & 1

    for data in map(coded, train):
        for i in range(ctw.DEPTH, len(data)):
            for node, bit in decisions(data, i):
                for depth in range(ctw.DEPTH + 1):
                    context = (data[i - depth : i], node)
                    counts.setdefault(context, [0, 0])[bit] += 1
                    if depth:
                        children.setdefault((data[i - depth + 1 : i], node), set()).add(context)

    def own(context):
        zeros, ones = counts.get(context, (0, 0))
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.log(math.pi) - math.lgamma(zeros + ones + 1)

    @functools.cache
    def weighted(context):
        if len(context[0]) == ctw.DEPTH:
            return own(context)
        return np.logaddexp(own(context), sum(weighted(c) for c in children.get(context, ()))) - math.log(2)

    def one(data, i, node, depth=0):
        context = (data[i - depth : i], node)
        zeros, ones = counts.get(context, (0, 0))
        p = (ones + 0.5) / (zeros + ones + 1)
        if depth == ctw.DEPTH:
            return p
        share = math.exp(own(context) - math.log(2) - weighted(context))
        return share * p + (1 - share) * one(data, i, node, depth + 1)

    def scored(data):
        return sum(math.log10(one(data, i, node) if bit else 1 - one(data, i, node)) for i in range(ctw.DEPTH, len(data)) for node, bit in decisions(data, i))

    return [scored(coded(t)) for t in texts]


@pytest.mark.parametrize("tiny", [False, True])
def test_context_tree_scores(docs, rows, monkeypatch, tiny):
    if tiny:  # many chunks
        monkeypatch.setattr(ctw, "CHUNK", 500)
    few = docs.where("doc_id is null or doc_id % 4 = 0 or doc_id > 58").where("coalesce(length(text), 0) < 3000")
    chosen = {r.doc_id for r in few.select("doc_id").collect()}
    texts = [(i, t) for i, t, _ in rows if i in chosen]
    want = plain_context_tree([t for i, t in texts if i is None or i % 3], [t for _, t in texts])
    got = ctw.score(few, F.col("doc_id") % 3 != 0).collect()
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    for (i, score), (j, expected) in zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(((i, w) for (i, _), w in zip(texts, want)), key=key), strict=True):
        assert i == j and abs(score - expected) < 1e-5 * -expected


def test_context_tree_is_a_distribution(spark):
    data = b"\0" * ctw.DEPTH + b"abracadabra" * 30
    counts = {}
    for i in range(ctw.DEPTH, len(data)):
        code = int.from_bytes(data[i - ctw.DEPTH : i + 1], "big")
        counts[code] = counts.get(code, 0) + 1
    contexts = [b"abrac", b"zbrac", b"zzzac", b"zzzzz"]
    for context in contexts:
        for byte in range(256):
            counts.setdefault(int.from_bytes(context + bytes([byte]), "big"), 0)
    got = dict(map(tuple, ctw.code_lengths(spark.createDataFrame(list(counts.items()), "code long, n long")).collect()))
    assert set(got) == set(counts)
    for context in contexts:
        assert abs(sum(10 ** got[int.from_bytes(context + bytes([b]), "big")] for b in range(256)) - 1) < 1e-5
    assert sum(n * got[c] for c, n in counts.items()) > -400 * np.log10(4)


def test_context_trees_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score(docs, F.lit(False)).collect()}
    assert abs(got[1].score + 4 * np.log10(256)) < 1e-4 and abs(got[2].score + np.log10(256)) < 1e-4
    assert got[1].train_tokens == 0 and got[1].held_out
    assert ctw.score(docs.limit(0), F.lit(True)).collect() == []


def test_context_codes_and_parts_in_small_pieces(monkeypatch):
    for name, value in {"BLOCK": 20, "CODES": 4, "HELD": 9, "GIVEN": 2}.items():
        monkeypatch.setattr(ctw, name, value)
    texts = [(0, True, b"ABAB" * 9), (0, False, b"abc"), (0, True, None), (5, False, b""), (5, True, b"abab" * 3)]
    want = {}
    for chunk, train, text in texts:
        data = b"\0" * ctw.DEPTH + (text or b"").lower() + b"\xff"
        for i in range(ctw.DEPTH, len(data)):
            key = chunk, int.from_bytes(data[i - ctw.DEPTH : i + 1], "big")
            want[key] = want.get(key, 0) + train
    got = {}
    names = ["chunk", "train", "_text"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=names) for part in (texts[:2], texts[2:])]
    for batch in ctw._chunk_codes(iter(batches)):
        assert len(batch) <= 2
        for c, k, n in zip(*(batch.column(x).to_pylist() for x in ("chunk", "code", "n"))):
            got[c, k] = got.get((c, k), 0) + n
    assert got == want
    part = [1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 4, 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(part[i : i + 2])], names=["part"]) for i in range(0, len(part), 2)]
    tables = [t.column("part").to_pylist() for t in ctw._parts(iter(batches))]
    assert sum(tables, []) == part and len(tables) > 1
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))
