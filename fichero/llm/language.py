"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound from the vectors of its letters, each
permuted by its place; a text bundles (adds) its trigrams, a language bundles its training texts. A text gets the
language whose prototype has the largest cosine with it. A partition of training texts is bundled where it lies, so
only one vector per language and partition moves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fichero.llm.common import prepared, private

DIMENSIONS, SEED = 1024, 20_011
#: Letters as symbols: 0 is the space between words, a to z are 1 to 26, all others share 27 to 63 by code point.
SYMBOLS = 64
#: Letters bundled at once.
BLOCK = 400_000
#: Most languages learned; a column with more distinct values is no language column.
LANGUAGES = 4096
UNKNOWN = "und"

_state: dict = {}


def _symbols() -> np.ndarray:
    if "symbols" not in _state:
        table = np.zeros(0x110000, np.uint8)
        for code in range(0x110000):
            if chr(code).isalpha():
                low = ord(chr(code).lower()[0])
                table[code] = low - 96 if 97 <= low <= 122 else 27 + low % 37
        _state["symbols"] = table
    return _state["symbols"]


def _letters() -> list[np.ndarray]:
    """Three matrices of letter vectors: permuted twice, once and not at all."""
    if "letters" not in _state:
        base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
        _state["letters"] = [np.roll(base, k, axis=1) for k in (2, 1, 0)]
    return _state["letters"]


def _bundles(codes: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """One bundle per owner of the trigram codes."""
    first, second, third = _letters()
    seen = np.flatnonzero(np.bincount(codes, minlength=SYMBOLS**3))
    place = np.zeros(SYMBOLS**3, np.int64)
    place[seen] = np.arange(len(seen))
    out = np.zeros((owners, DIMENSIONS), np.float32)
    counts = np.bincount(owner * len(seen) + place[codes], minlength=owners * len(seen)).reshape(owners, -1).astype(np.float32)
    for at in range(0, len(seen), 4096):
        part = seen[at : at + 4096]
        vectors = first[part // SYMBOLS**2] * second[part // SYMBOLS % SYMBOLS] * third[part % SYMBOLS]
        out += counts[:, at : at + 4096] @ vectors.astype(np.float32)
    return out


def _trigrams(text: str) -> np.ndarray:
    """Trigram codes of a text's words, with one space around each; empty where there is no letter."""
    marks = _symbols()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not marks.any():
        return np.zeros(0, np.int64)
    marks = np.concatenate((np.zeros(1, np.uint8), marks, np.zeros(1, np.uint8)))
    marks = marks[np.r_[True, (marks[1:] > 0) | (marks[:-1] > 0)]].astype(np.int64)
    codes = (marks[:-2] * SYMBOLS + marks[1:-1]) * SYMBOLS + marks[2:]
    return codes[marks[1:-1] > 0]


def _vectors(texts: list):
    """Blocks of (first row, bundles of the rows); a very long text is bundled piece by piece."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        codes = _trigrams(text) if text else np.zeros(0, np.int64)
        if held and (size + len(codes) > BLOCK or len(held) >= 128):
            yield start, _block(held)
            start, held, size = i, [], 0
        held.append(codes)
        size += len(codes)
    if held:
        yield start, _block(held)


def _block(held: list[np.ndarray]) -> np.ndarray:
    if len(held) == 1:
        return sum((_bundles(held[0][i : i + BLOCK], np.zeros(len(held[0][i : i + BLOCK]), np.int64), 1) for i in range(0, len(held[0]), BLOCK)), np.zeros((1, DIMENSIONS), np.float32))
    return _bundles(np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held]), len(held))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A unit prototype per language of the rows whose text and language are not null; none where no text has a letter."""
    prepared(docs.sparkSession)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()
            for start, vectors in _vectors(texts):
                for row, vector in enumerate(vectors, start):
                    sums[langs[row]] = sums.get(langs[row], 0.0) + vector.astype(np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], names=["lang", "i", "v"])

    rows = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where("_text is not null and _lang is not null")
    summed = rows.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    # one vector per language reaches the driver, and there are at most LANGUAGES of them
    found: dict[str, np.ndarray] = {}
    for lang, i, v in summed.limit(LANGUAGES * DIMENSIONS + 1).toLocalIterator():
        found.setdefault(lang, np.zeros(DIMENSIONS))[i] = v
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in {lang_col}")
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(found.items()) if np.any(v)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score`` (the cosine, at least 0).

    A text that is null, empty or without a letter, and any text where nothing was learned, gets ``und`` and 0. Equal
    cosines go to the smaller language name.
    """
    prepared(docs.sparkSession)
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names]).T.astype(np.float32) if names else None
    kept = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    own = private(docs, "_text")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string", "score double"])

    def run(batches):
        for batch in batches:
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if matrix is not None:
                for start, vectors in _vectors(batch.column(own).to_pylist()):
                    norms = np.linalg.norm(vectors, axis=1)
                    cosines = (vectors @ matrix) / np.maximum(norms, 1e-9)[:, None]
                    best = cosines.argmax(axis=1)
                    for row in np.flatnonzero(norms > 0):
                        langs[start + row] = names[best[row]]
                        scores[start + row] = min(1.0, max(0.0, float(cosines[row, best[row]])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(langs, pa.string()), pa.array(scores)], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept, F.col(text_col).alias(own)).mapInArrow(run, schema)


def identify(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows where ``train`` holds, predict all rows."""
    return predict(docs.drop(lang_col), learn(docs.where(train), text_col, lang_col), text_col)
