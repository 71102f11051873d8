"""Registered queries of the corpus operators: each derives its digest columns from its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import common_lines, decontaminate, language, lines, manifest, minhash, mixing, pii, quality, repeats, tokens, urls, vector_codes
from .names import table
from .sql import SQL

#: Vocabulary of op7; any byte-level BPE file of the same form will do.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Documents of more tokens are over the limit.
TOKEN_LIMIT = 1024


def op1_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark, sf_dir):
    return repeats.digest(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark, sf_dir):
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_quality_rules(spark, sf_dir):
    scored = quality.score_quality(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op5_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).distinct()
    cascade = urls.build_cascade(hosts.where(F.col("host").rlike(urls.LISTED_LABELS)), hosts)
    return urls.judge_urls(pages, cascade, urls.RULES).drop("url")


def op6_line_dedup(spark, sf_dir):
    return lines.digest(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, tokens.read_vocabulary(VOCABULARY), carry=["doc_id"])
    return counted.select("doc_id", "tokens.*", (F.col("tokens.n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = language.identify(docs, language.train(docs), carry=["doc_id"])
    return judged.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"),
                         F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op9_source_mix(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.*")


def op10_decontamination(spark, sf_dir):
    found = decontaminate.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.words_hit(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op11_line_dedup(spark, sf_dir):
    return common_lines.digest(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark, sf_dir):
    return manifest.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_suffix_array_dedup, op3_near_duplicates, op4_quality_rules, op5_url_filters, op6_line_dedup, op7_token_counts, op8_language_id, op9_source_mix,
    op10_decontamination, op11_line_dedup, op12_vector_codes, op13_merkle_manifest)}


def load():
    return QUERIES, SQL
