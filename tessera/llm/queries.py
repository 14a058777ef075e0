"""The queries of the document operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, imatch, jaccard, language, mixing, negatives, quality, rules, search, shards, suffixes, tokens, toxicity
from tessera.llm.shared import documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(documents(spark, sf_dir)).drop("uid")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab
    return tokens.count_tokens(documents(spark, sf_dir), vocab.path("piece_bpe_32k.model"), keep=["doc_id"])


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab
    return bpe.encode_documents(documents(spark, sf_dir), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN,
                                keep=["doc_id"], with_ids=False)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard_documents(documents(spark, sf_dir).select("doc_id", "text"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir), keep=["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_next(documents(spark, sf_dir))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.mine(vectors, F.col("id") % 100 == 0, positives=5, negatives=5, low=80, high=100)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.5)


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_quality_classifier, op3_token_counts, op4_byte_bpe, op5_sharding, op6_mixing, op7_quality_rules,
    op8_language_id, op9_imatch, op10_ngram_jaccard, op11_ranked_search, op12_hard_negatives, op13_toxicity)}

WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {"op6_mixing": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
             md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR))) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS w FROM d GROUP BY source),
-- clamp what is above three times its size, share the rest by weight again, until nothing is above
fill AS (SELECT 0 AS step, (SELECT sum(n) FROM s) / (SELECT sum(w) FROM s) AS level
         UNION ALL
         SELECT step + 1, ((SELECT sum(n) FROM s) - (SELECT coalesce(sum(3 * n), 0) FROM s WHERE level * w > 3 * n))
                / (SELECT sum(w) FROM s WHERE level * w <= 3 * n)
         FROM fill WHERE step < (SELECT count(*) FROM s)),
level AS (SELECT arg_max(level, step) AS level FROM fill),
t AS (SELECT source, n, CASE WHEN level * w > 3 * n THEN CAST(3 * n AS DOUBLE) ELSE level * w END AS target FROM s, level),
r AS (SELECT *, CASE WHEN n > 0 THEN least(target / n, 3.0) ELSE 0.0 END AS rate FROM t),
g AS (SELECT source, turn, sum(size) AS size FROM d GROUP BY ALL),
c AS (SELECT g.source, g.turn, coalesce(sum(g.size) OVER (PARTITION BY g.source ORDER BY g.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + g.size / 2.0
             < (r.rate - floor(r.rate)) * r.n AS more, floor(r.rate) AS whole, r.n, r.target
      FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(c.n AS BIGINT) AS source_size, c.target,
       CAST(d.size * (c.whole + CAST(c.more AS INT)) AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.turn = c.turn
""", "op7_quality_rules": rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
d AS (SELECT *, len(w) AS n, row_number() OVER () AS row FROM w),
lines AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
-- words by position, and the positions of the three-word windows that occur at least twice
p AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT row, i, [word, lead(word) OVER o, lead(word, 2) OVER o] AS t, lead(i, 2) OVER o AS last FROM p WINDOW o AS (PARTITION BY row ORDER BY i)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, t) AS c FROM win WHERE last IS NOT NULL) WHERE c > 1),
rep AS (SELECT row, count(*) AS n FROM (SELECT DISTINCT row, i + k AS j FROM twice, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY row),
f AS (SELECT doc_id, source, CAST(d.n AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[ 	-
]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN lines USING (row) LEFT JOIN rep USING (row)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
rules AS (SELECT source, rule, count(*) AS docs, CAST(sum(CAST(bad AS INT)) AS DOUBLE) AS bad FROM (
            SELECT source, unnest(['short', 'repetitive', 'symbols', 'repeated_lines']) AS rule,
                   unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > word_chars, 4 * n_dup_lines > n_words]) AS bad
            FROM b WHERE source IS NOT NULL) GROUP BY ALL),
m AS (SELECT rule, sum(bad) / sum(docs) AS mean, greatest(sum(bad * bad / docs) / sum(docs) - (sum(bad) / sum(docs)) ** 2, 1e-12) AS spread FROM rules GROUP BY rule),
prior AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / spread - 1, 2), 1000) AS strength FROM m),
bad_hosts AS (SELECT DISTINCT source FROM rules JOIN prior USING (rule) WHERE round((bad + mean * strength) / (docs + strength), 9) >= 0.8)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(source NOT IN (SELECT source FROM bad_hosts), true) AS kept
FROM b
""", "op1_suffix_dedup": rf"""
WITH d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(text, '{WORD}') AS w FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, text, i - 1 AS s, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT doc_id, text, s, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, text, s) > 1 AS repeated, count(*) OVER (PARTITION BY g) AS c FROM win),
-- windows of one role that overlap or touch are one span
n AS (SELECT *, coalesce(s > lag(s) OVER o + 50, true) AS fresh FROM f WHERE c > 1 WINDOW o AS (PARTITION BY doc_id, text, repeated ORDER BY s)),
p AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, text, repeated ORDER BY s) AS part FROM n)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start_word, CAST(max(s) + 50 AS BIGINT) AS end_word, repeated FROM p GROUP BY doc_id, text, repeated, part
""", "op10_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams, len(w) AS n_words FROM d),
s AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram, least(n_words, 5) AS k FROM g),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.gram = b.gram AND a.k = b.k AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT g.doc_id, CAST(len(g.grams) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM g JOIN reach r ON r.a = g.doc_id GROUP BY g.doc_id, g.grams
""", "op11_ranked_search": r"""
WITH t AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
           FROM (SELECT *, row_number() OVER () AS row FROM documents)),
size AS (SELECT row, doc_id, count(*) AS n FROM t GROUP BY ALL),
total AS (SELECT count(*) AS d, CAST(sum(n) AS BIGINT) AS l FROM size),
tf AS (SELECT row, term, count(*) AS tf FROM t GROUP BY ALL),
q AS (SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM (SELECT *, row_number() OVER () AS item FROM (SELECT DISTINCT item_id, text FROM benchmark))),
w AS (SELECT term, CAST(floor(1000 * ln((2 * d + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total WHERE term IN (SELECT term FROM q) GROUP BY term, d),
s AS (SELECT item, item_id, row, size.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * d) // l)))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size USING (row), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
""", "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""}
