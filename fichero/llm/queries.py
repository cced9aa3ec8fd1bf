"""The registered queries of this subpackage: name -> (query, equivalent SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fichero.llm import bpe, ctw, decontaminate, language, mixing, negatives, neighbours, phrases, simhash, suffixes, topk, toxicity, warc
from fichero.llm.common import bucket_of

#: The tokenizer's vocabulary file.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by hyperdimensional profiles."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (bucket_of("doc_id", 4) == 2).alias("held_out"))
    return language.identify(docs, ~F.col("held_out"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without strings of 200 bytes that also start elsewhere."""
    found = suffixes.deduplicated(_table(spark, sf_dir, "documents"), carried=["doc_id"])
    return found.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with cosine 0.9 or more."""
    return neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and the components of fingerprints at three or fewer differing bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every embedding whose id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through their index."""
    read = warc.read_records(warc.write_archives(_table(spark, sf_dir, "pages")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out third."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (bucket_of("doc_id", 3) == 1).alias("held_out"))
    weights = toxicity.fit(docs.where(~F.col("held_out")), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights).withColumn("predicted", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0))


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every document under the context tree, and its base score."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ctw.score(docs, bucket_of("doc_id", 7) != 2)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives below each of the five positives of every embedding whose id is divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside passages of the benchmark, and whose passages they are."""
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language whose words keep together."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_suffix_dedup": (op2_suffix_dedup, None),
    "op3_embedding_dedup": (op3_embedding_dedup, None),
    "op4_simhash": (op4_simhash, None),
    "op5_topk": (op5_topk, """
WITH v AS (SELECT vec_id, list_transform(embedding, x -> CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""),
    "op6_bpe": (op6_bpe, None),
    "op7_warc": (op7_warc, """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM r"""),
    "op8_mixing": (op8_mixing, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_ctw": (op10_ctw, None),
    "op11_hard_negatives": (op11_hard_negatives, """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
w AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score WHERE n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 5"""),
    "op12_decontamination": (op12_decontamination, r"""
WITH d AS (SELECT doc_id, [w for w in string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if w <> ''] AS w FROM documents),
b AS (SELECT item_id, [w for w in string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if w <> ''] AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS t, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, t, array_to_string(w[s:s + t - 1], ' ') AS x FROM bs),
ds AS (SELECT doc_id, w, t, unnest(range(1, len(w) - t + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT t FROM bw) WHERE len(w) >= t),
dw AS (SELECT doc_id, t, s, array_to_string(w[s:s + t - 1], ' ') AS x FROM ds),
hits AS (SELECT doc_id, dw.t, s, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.x = bw.x),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + t)) AS p FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id"""),
    "op13_collocations": (op13_collocations, r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x for x in string_split_regex(piece, '[ \t]+') if x <> ''] AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM w),
o AS (SELECT lang, k, w[s:s + k - 1] AS words FROM g CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE s + k - 1 <= len(w)),
f AS (SELECT lang, k, words, count(*) AS n FROM o GROUP BY ALL),
t AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, words, n AS a FROM f WHERE k > 1 AND n >= 100),
covered AS (SELECT DISTINCT s.lang, s.words FROM c s JOIN c b ON s.lang = b.lang AND s.size < b.size AND 100 * b.a >= 100 * s.a
  AND len([i for i in range(1, b.size - s.size + 2) if b.words[i:i + s.size - 1] = s.words]) > 0),
cut AS (SELECT lang, words, a, size, unnest(range(1, size)) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM covered x WHERE x.lang = c.lang AND x.words = c.words)),
scored AS (SELECT cut.lang, cut.words, a, cut.k, l.n AS l, r.n AS r, CAST(t.n AS BIGINT) AS n,
    CAST((CAST(1000 AS HUGEINT) * a * t.n) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.words = cut.words[1:cut.k] JOIN f r ON r.lang = cut.lang AND r.words = cut.words[cut.k + 1:] JOIN t ON t.lang = cut.lang),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS best FROM scored) WHERE best = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM low)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""),
}
