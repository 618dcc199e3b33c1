"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from sievemark.llm.chat import digest, format_conversations
from sievemark.llm import fill_in_middle, language_id, merge_automaton, pii_crf, spelling_trie, toxicity
from sievemark.llm.mixing import mix
from sievemark.llm.ngram_join import ngram_components, ngram_link_counts
from sievemark.llm.packing import pack
from sievemark.llm.piece_ids import public_path
from sievemark.llm.tiff import digest_media, encode_texts
from sievemark.llm.token_shards import read_shards, write_shards
from sievemark.llm.topk_search import top_k
from sievemark.session import materialize, shared_dir, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op1_ngram_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_link_counts(table(spark, sf_dir, "documents"))


def op2_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digest(materialize(format_conversations(turns.unionByName(extra)), "chat-examples"))


def op3_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(encode_texts(table(spark, sf_dir, "documents")))


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.crc_mod("doc_id", 3) != 1))
    return toxicity.score(docs, model).select("doc_id", (toxicity.crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), path, public_path("word_bpe_49k.json"), end_id=2)
    return read_shards(spark, path)


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii_crf.find_pii(docs, pii_crf.fit(docs))
    count = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in pii_crf.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_marginal_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(toxicity.crc_mod("doc_id", 4) != 2), public_path("piece_bpe_32k.model"))
    return language_id.identify(docs, model).select("doc_id", (toxicity.crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op10_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op11_merge_automaton_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_path("byte_bpe_50k.json")
    return merge_automaton.digest_tokens(merge_automaton.decode(merge_automaton.encode(table(spark, sf_dir, "documents"), path), path))


def op12_checkpoint_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest_examples(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_spelling_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_trie.spelling_variants(spelling_trie.vocabulary(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op1_ngram_link_counts": op1_ngram_link_counts,
    "op2_prefix_target_chat": op2_prefix_target_chat,
    "op3_weighted_fair_mix": op3_weighted_fair_mix,
    "op4_tiff_media": op4_tiff_media,
    "op5_counterfactual_toxicity": op5_counterfactual_toxicity,
    "op6_token_shards": op6_token_shards,
    "op7_skip_chain_pii": op7_skip_chain_pii,
    "op8_marginal_language_id": op8_marginal_language_id,
    "op9_uniform_threshold_topk": op9_uniform_threshold_topk,
    "op10_bin_completion_packing": op10_bin_completion_packing,
    "op11_merge_automaton_bpe": op11_merge_automaton_bpe,
    "op12_checkpoint_fim": op12_checkpoint_fim,
    "op13_spelling_trie_join": op13_spelling_trie_join,
}
