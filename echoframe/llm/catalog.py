"""Queries over the training-data tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, bpe, common, exact_dedup, filter_audit, followups, language_id, lm_score, mixing, ngram_join, packing, secrets, substring_dedup, token_counts


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_lattice_likelihood(spark, sf_dir):
    return lm_score.score(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_bpe_codec(spark, sf_dir):
    return bpe.encode(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_secret_scan(spark, sf_dir):
    return secrets.scan_documents(common.read(spark, sf_dir, "documents"), words=public_tokenizers.path("word_bpe_49k.json"))


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.passages(common.read(spark, sf_dir, "documents"))


def op6_source_mixing(spark, sf_dir):
    return mixing.mix(common.read(spark, sf_dir, "documents"))


def op7_multi_index_search(spark, sf_dir):
    return ann.search(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(common.read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicates(common.read(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    return language_id.identify(common.read(spark, sf_dir, "documents"))


def op11_exact_complement_packing(spark, sf_dir):
    return packing.pack(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_follow_up_alerts(spark, sf_dir):
    return followups.alerts(common.read(spark, sf_dir, "clicks"), common.read(spark, sf_dir, "sales"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def queries():
    return {f.__name__: f for f in (op1_token_counts, op2_lattice_likelihood, op3_bpe_codec, op4_secret_scan, op5_substring_dedup, op6_source_mixing, op7_multi_index_search, op8_ngram_join, op9_exact_dedup, op10_language_id, op11_exact_complement_packing, op12_follow_up_alerts, op13_filter_audit)}


def oracle_sql():
    return {"op8_ngram_join": ngram_join.SQL, "op9_exact_dedup": exact_dedup.SQL, "op13_filter_audit": filter_audit.SQL}
