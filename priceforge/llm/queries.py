"""One query for each operator, over its whole table."""

from __future__ import annotations

import corpus_pipeline
from priceforge.llm import (
    exact_dedup,
    fingerprints,
    hard_negatives,
    license_scan,
    packing,
    phrase_dedup,
    prefix_trie,
    quality,
    sentencepiece_codec,
    sharding,
    simhash,
    suffix_dedup,
    token_counts,
)
from priceforge.llm.corpus import documents
from priceforge.llm.registry import CHECKS, QUERIES, query  # noqa: F401


@query(
    "op1_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents
    ), g AS (
        SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


@query("op10_sharding")
def op10_sharding(spark, sf_dir):
    return sharding.differenced_shards(documents(spark, sf_dir))


@query("op6_document_fingerprints")
def op6_document_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


@query("op9_quality_classifier")
def op9_quality_classifier(spark, sf_dir):
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.coded(documents(spark, sf_dir))


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    return packing.packed(documents(spark, sf_dir))


@query("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.removed(documents(spark, sf_dir)).drop("kept")


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    return phrase_dedup.removed(documents(spark, sf_dir)).drop("kept")


@query("op11_license_scan")
def op11_license_scan(spark, sf_dir):
    return license_scan.license_scan(documents(spark, sf_dir))


@query(
    "op12_conversation_prefix_trie",
    r"""
    WITH t AS (
        SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn, turn AS nr
        FROM conversations WHERE conv_id IS NOT NULL
    ), l AS (
        SELECT conv_id, list(turn ORDER BY nr NULLS FIRST, turn.role, turn.text) AS turns FROM t GROUP BY conv_id
    ), h AS (
        SELECT conv_id, turns, xor(list_reduce(
            list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
            lambda crc, c: list_reduce(
                range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, c)
            ),
            4294967295
        ), 4294967295) % 4 AS h FROM l
    ), r AS (
        SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
        FROM h LEFT JOIN l AS b ON b.conv_id = h.conv_id - h.conv_id % 20
    ), p AS (
        SELECT conv_id, len(turns) AS length, d AS depth, turns[1:d] AS key FROM r, unnest(range(len(turns) + 1)) AS u(d)
    ), n AS (
        SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256,
            CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(key[depth].text, '[^\x20\x09-\x0D]+')) END AS own
        FROM p GROUP BY key, depth
    ), c AS (
        SELECT key[1:depth - 1] AS key, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
    ), m AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.key = n.key AND c.depth = n.depth
    ), a AS (
        SELECT key[1:d] AS key, d AS depth, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
        FROM m, unnest(range(depth + 1)) AS u(d) GROUP BY ALL
    )
    SELECT m.conv_id, m.depth, b.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves,
        CAST(a.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
    FROM m JOIN a ON a.key = m.key AND a.depth = m.depth
    LEFT JOIN n AS b ON m.depth > 0 AND b.key = m.key[1:m.depth - 1] AND b.depth = m.depth - 1
    """,
)
def op12_conversation_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query(
    "op13_hard_negatives",
    """
    WITH r AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
            CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
        FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 50 = 0
    ), p AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    )
    SELECT p.anchor_id, p.positive_id,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
        s.other_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
    QUALIFY rank <= 3
    """,
)
def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
