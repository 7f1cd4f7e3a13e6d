"""The registered query of each operator: its intended table in, its contract's columns out."""

from __future__ import annotations

from .common import held_out, read_table


def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers
    from pyspark.sql import functions as F

    from . import byte_bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(ids, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_classifier(spark, sf_dir):
    from . import quality_classifier

    train = ~held_out(3, 1)
    return quality_classifier.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), train)


def op3_html_text(spark, sf_dir):
    from . import html_text

    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark, sf_dir):
    from . import exact_dedup

    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op5_simhash(spark, sf_dir):
    from pyspark.sql import functions as F

    from . import simhash

    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from . import suffix_dedup

    found = suffix_dedup.cut_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_chat_format(spark, sf_dir):
    from . import chat_format

    return chat_format.format_chats(read_table(spark, sf_dir, "conversations"))


def op8_quality_rules(spark, sf_dir):
    from . import quality_rules

    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    import public_tokenizers

    from . import packing

    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_brown_lm(spark, sf_dir):
    from . import brown_lm

    return brown_lm.score(read_table(spark, sf_dir, "documents"), modulus=10, remainder=0)


def op11_prefix_trie(spark, sf_dir):
    from . import prefix_trie

    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"), share=True)


def op12_embedding_dedup(spark, sf_dir):
    from . import embedding_dedup

    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op13_embedding_whitening(spark, sf_dir):
    from . import whitening

    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql():
    from .oracles import ORACLES

    return dict(ORACLES)
