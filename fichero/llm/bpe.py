"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer (BPE with word ends).

The file's steps: texts are cut at special tokens, composed (NFC), split at white space and lower-cased; words are
cut by pattern, their bytes written as printable characters, and merged. The merge holds a word's part boundaries
and, next to each, the rank of merging the part with its right neighbour; it scans for the smallest rank, deletes
that boundary and refreshes the two ranks beside it. Long words keep their ranks in a heap instead: same result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from fichero.llm.common import prepared, private

#: Words with more characters than this merge through the heap; words and chunks a task remembers.
SHORT, REMEMBERED = 128, 200_000
NEVER = 1 << 60
# Fixed values of the tokenizer: white space, and the pattern of its words.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
_SPACE = regex.compile(SPACE)


def _byte_characters() -> list[str]:
    """Printable bytes stand for themselves, the others take the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class _Remembered(dict):
    """A bounded memory of computed values in two generations: when the young one is full it becomes the old one, and
    what is asked for again comes back from there, so frequent words are never computed anew."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


class Codec:
    """Encodes and decodes whole texts as the vocabulary file says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.token = {i: t for t, i in (*self.ids.items(), *self.special.items())}
        self.decimal = {i: str(i) for i in self.token}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.characters = _byte_characters()
        self.words, self.chunks = _Remembered(self._word), _Remembered(self._chunk)

    def _word(self, word: str) -> tuple[int, ...]:
        spelled = "".join([self.characters[b] for b in word.encode("utf-8", "replace")])
        text = spelled + self.end
        bounds = [*range(len(spelled)), len(text)]
        bounds = self._scan(text, bounds) if len(spelled) <= SHORT else self._heap(text, bounds)
        ids = self.ids
        return tuple(ids[text[a:b]] for a, b in zip(bounds, bounds[1:]) if text[a:b] in ids)

    def _scan(self, text: str, bounds: list[int]) -> list[int]:
        rank = self.rank
        ranks = [rank.get((text[a:b], text[b:c]), NEVER) for a, b, c in zip(bounds, bounds[1:], bounds[2:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((text[bounds[i] : bounds[i + 1]], text[bounds[i + 1] : bounds[i + 2]]), NEVER)
            if i:
                ranks[i - 1] = rank.get((text[bounds[i - 1] : bounds[i]], text[bounds[i] : bounds[i + 1]]), NEVER)
        return bounds

    def _heap(self, text: str, bounds: list[int]) -> list[int]:
        rank, last = self.rank, len(bounds) - 1
        after, before, alive = list(range(1, last + 2)), list(range(-1, last)), [True] * last

        def due(i: int) -> int:
            j = after[i]
            return rank.get((text[bounds[i] : bounds[j]], text[bounds[j] : bounds[after[j]]]), NEVER) if j < last else NEVER

        heap = [(r, i) for i in range(last) if (r := due(i)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or due(i) != r:
                continue
            gone = after[i]
            alive[gone] = False
            after[i] = after[gone]
            if after[i] < last:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (r := due(k)) != NEVER:
                    heapq.heappush(heap, (r, k))
        return [bounds[i] for i in range(last) if alive[i]] + [bounds[last]]

    def _piece(self, ids: tuple[int, ...]) -> tuple[tuple[int, ...], str, str]:
        """Ids, how they are written, and what they decode to."""
        return ids, " ".join(map(self.decimal.__getitem__, ids)), self.decode(ids)

    def _chunk(self, chunk: str) -> tuple[tuple[int, ...], str, str]:
        words = self.words
        return self._piece(tuple(chain.from_iterable(words[w] for w in WORD.findall(chunk))))

    def _plain(self, text: str) -> list[tuple]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a final sigma is lowered like any other
        # str.split() also splits at the four separators below, which are no white space here
        parts = _SPACE.split(text.lower()) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.lower().split()
        return list(map(self.chunks.__getitem__, filter(None, parts)))

    def pieces(self, text: str) -> list[tuple[tuple[int, ...], str, str]]:
        """The text's chunks in order, each with its ids, their digits and their decoded text; none without ids."""
        if "<|" not in text:
            out = self._plain(text)
        else:
            out = []
            for part in self.cut.split(text):
                if part in self.special:
                    out.append(self._piece((self.special[part],)))
                elif part:
                    out += self._plain(part)
        return [piece for piece in out if piece[0]]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([piece[0] for piece in self.pieces(text)]))

    def decode(self, ids) -> str:
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and vocabulary file."""
    return Codec(path)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>``. A null text is encoded as the empty one; every row comes out, repeats too."""
    return _mapped(docs, path, text_col, "ids array<int>", lambda c, text: [c.encode(text)], [pa.list_(pa.int32())])


def digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; each text is encoded and its ids decoded."""

    def row(c: Codec, text: str):
        pieces = c.pieces(text)
        spelled, decoded = " ".join([p[1] for p in pieces]), " ".join([p[2] for p in pieces])
        return [sum([len(p[0]) for p in pieces]), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]

    return _mapped(docs, path, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, [pa.int64(), pa.string(), pa.string()])


def _mapped(docs: DataFrame, path: str, text_col: str, added: str, row, types) -> DataFrame:
    prepared(docs.sparkSession)
    names = [a.split()[0] for a in added.split(", ")]
    kept = [c for c in docs.columns if c not in (text_col, *names)]
    own = private(docs, "_text")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), added])

    def run(batches):
        c = codec(path)
        for batch in batches:
            found = [row(c, t or "") for t in batch.column(own).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *columns], names=[*kept, *names])

    return docs.select(*kept, F.col(text_col).alias(own)).mapInArrow(run, schema)
