"""The pipeline, stage by stage, against plain computations; operators on tables that use names of their own columns."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from fichero.llm import bpe, language, mixing, simhash, suffixes, toxicity
from fichero.llm.common import staged

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
OWN = ["_text", "_text_", "_row", "_kept", "_spans", "_copies", "_copy", "_toxicity", "_text_again", "_carried", "c0", "n_bytes"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(11)
    words = ["".join(draw.choices("abcdefghijkl", k=draw.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(draw.choices(words, k=n))
    passage = text(60)
    texts = [text(draw.randint(5, 90)) + (" awful horrid" if i % 4 == 0 else "") for i in range(300)]
    texts += [texts[1], texts[1], texts[2] + " tail", None, "", "Ä ß ǅ 12 awful horrid"]
    texts += [f"{text(30)} {passage} {text(30)}" for _ in range(6)]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(250)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def one_of_each(rows):
    """Ids kept, by comparing all fingerprints."""
    prints = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in rows}
    home = {i: i for i in prints}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                home[y] = x
    return {i for i in prints if find(i) == i}


def cut(texts, length=200):
    """Texts without the bytes of windows that start at two places or more."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    places = {}
    for i, d in data.items():
        for p in range(len(d) - length + 1):
            places.setdefault(d[p : p + length], []).append((i, p))
    gone = {i: np.zeros(len(d), bool) for i, d in data.items()}
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                gone[i][p : p + length] = True
    return {i: np.frombuffer(d, np.uint8)[~gone[i]].tobytes() for i, d in data.items()}


def test_pipeline(spark, folder):
    """Every stage on what the one before kept; all five decisions take effect."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "suffixes", "mixing", "bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = staged(stages["toxicity"](spark, docs, folder), "a")
    rows = kept.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect() if "awful" not in (r.text or "")}
    single = staged(stages["simhash"](spark, kept, folder), "b")
    assert {r.doc_id for r in single.collect()} == one_of_each(rows) and single.count() < kept.count()
    short = staged(stages["suffixes"](spark, single, folder), "c")
    want = cut({r.doc_id: r.text for r in single.collect()})
    assert {r.doc_id: r.text.encode() for r in short.collect()} == want and short.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in short.collect())
    assert sum(map(len, want.values())) < sum(len((r.text or "").encode()) for r in single.collect())
    mixture = staged(stages["mixing"](spark, short, folder), "d")
    copies = {r.doc_id: r.copies for r in mixing.mix(short).collect()}
    times = {r.doc_id: r["count"] for r in mixture.groupBy("doc_id").count().collect()}
    assert times == {i: n for i, n in copies.items() if n} and max(times.values()) <= 2
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    texts = {r.doc_id: r.text for r in short.collect()}
    got = stages["bpe"](spark, mixture, folder).collect()
    assert len(got) == sum(times.values())
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, got))


def test_columns_with_our_names(spark, folder):
    """Columns named like those the operators use inside come out as they went in."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.select("*", *(F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in OWN))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    weights = toxicity.fit(more, labels)
    prototypes = language.learn(more)
    for run in (
        suffixes.without_repeats, simhash.one_of_each, mixing.mixed, lambda d: toxicity.accepted(d, labels),
        lambda d: toxicity.score(d, weights), lambda d: bpe.digests(d, VOCABULARY), lambda d: language.predict(d, prototypes),
    ):
        plain, out = run(docs), run(more)
        assert set(out.columns) == {*plain.columns, *OWN}
        assert out.where(" or ".join(f"`{c}` <> concat('{c} ', doc_id)" for c in OWN)).count() == 0
        assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_sample_holds_rows_that_teach(spark):
    """The sample is drawn from ids that the table holds; a shard that got no row does not thin the weights."""
    texts = [(i, "awful words" if i % 2 else "kind words") for i in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, toxic int")
    assert np.array_equal(toxicity.fit(docs, labels, sample=50), toxicity.fit(docs, labels))
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    alone = toxicity._fit(pd.DataFrame({"order": [0], "text": [b"awful words"], "y": [1]}))
    want = np.zeros(toxicity.BUCKETS, np.float32)
    for i, w in zip(alone["i"], alone["w"]):
        if i != toxicity.FITTED:
            want[int(i)] = w
    assert np.array_equal(toxicity.fit(docs, one), want)
    assert not toxicity.fit(docs.where("false"), labels).any()
