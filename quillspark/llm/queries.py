"""The registered queries of this subpackage: ``opN_<name>(spark, sf_dir)``, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm._spark import bounded


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.sentencepiece_sampling import sampled_digests

    return sampled_digests(documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.suffix_dedup import repeated_spans

    return repeated_spans(documents(spark, sf_dir))


SQL_OP2 = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS place FROM words WHERE len(w) >= 50),
runs AS (SELECT doc_id, place, sha256(array_to_string(w[place + 1:place + 50], ' ')) AS run FROM places),
firsts AS (SELECT run, min((doc_id, place)) AS f FROM runs GROUP BY run HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, place, f[1] AS first_doc_id, (doc_id = f[1] AND place = f[2]) AS is_first FROM runs JOIN firsts USING (run)),
marks AS (SELECT *, CASE WHEN place - lag(place, 1, -51) OVER (PARTITION BY doc_id, is_first ORDER BY place) > 50 THEN 1 ELSE 0 END AS new FROM hits),
spans AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, is_first ORDER BY place ROWS UNBOUNDED PRECEDING) AS span FROM marks)
SELECT doc_id, min(place) AS start_word, max(place) - min(place) + 50 AS n_words, is_first, min(first_doc_id) AS first_doc_id
FROM spans GROUP BY doc_id, is_first, span
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.language_id import identified

    return identified(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.substring_dedup import shared_passages

    return shared_passages(documents(spark, sf_dir))


SQL_OP5 = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i + 1:i + 5], ' ')) AS g FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(min(r.other), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.id = d.doc_id GROUP BY d.doc_id, s.n
"""


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.packing import packed_documents

    return packed_documents(documents(spark, sf_dir))


def op7_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.simhash import edited_fingerprints

    return edited_fingerprints(documents(spark, sf_dir))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.media import text_media

    return text_media(documents(spark, sf_dir))


def op9_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.token_files import token_digests

    return token_digests(documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.quality import classified

    return classified(documents(spark, sf_dir))


def op11_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.fertility import fertility_rules

    return fertility_rules(documents(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.hard_negatives import hard_negatives

    return hard_negatives(embeddings(spark, sf_dir))


SQL_OP12 = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 256)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) <= 3
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.whitening import whitened_components

    return whitened_components(embeddings(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece_sampling, op2_suffix_array_dedup, op3_language_id, op4_substring_dedup, op5_ngram_jaccard_join, op6_best_fit_packing, op7_simhash_fingerprints,
        op8_media_columns, op9_arrow_token_files, op10_quality_classifier, op11_tokeniser_fertility, op12_hard_negatives, op13_embedding_whitening,
    )
}
ORACLES: dict[str, str] = {"op2_suffix_array_dedup": SQL_OP2, "op5_ngram_jaccard_join": SQL_OP5, "op12_hard_negatives": SQL_OP12}
