"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import os

from pathglass.llm import bpe_codec, chosen_path, decontaminate, lang_profiles, mtree, ngram_join, ranked_search, ring_shards, suffix_dedup, token_alignment, token_counts, token_store, warc
from pathglass.llm.common import table

#: Where the public vocabulary files lie; a parameter, the files are never copied.
TOKENIZERS = os.environ.get("PATHGLASS_TOKENIZERS", "/opt/tokenizers")


def op1_mtree(spark, sf_dir):
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op2_ring_shards(spark, sf_dir):
    return ring_shards.assign_shards(table(spark, sf_dir, "documents"), shards=24)


def op3_token_files(spark, sf_dir):
    return token_store.token_files_digest(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op4_bpe_codec(spark, sf_dir):
    return bpe_codec.round_trip_digests(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", scale=1.6)


def op5_suffix_lpf(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op6_spaced_seeds(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lang_profiles(spark, sf_dir):
    return lang_profiles.identify(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", scale=2.5)


def op9_warc(spark, sf_dir):
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op10_chosen_path(spark, sf_dir):
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark, sf_dir):
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark, sf_dir):
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def op13_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mtree,
        op2_ring_shards,
        op3_token_files,
        op4_bpe_codec,
        op5_suffix_lpf,
        op6_spaced_seeds,
        op7_lang_profiles,
        op8_token_counts,
        op9_warc,
        op10_chosen_path,
        op11_ranked_search,
        op12_token_alignment,
        op13_ngram_join,
    )
}

OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5"""

ORACLE_SQL = {"op1_mtree": OP1_SQL, "op6_spaced_seeds": decontaminate.contamination_sql(), "op11_ranked_search": ranked_search.search_sql(), "op13_ngram_join": ngram_join.components_sql()}
