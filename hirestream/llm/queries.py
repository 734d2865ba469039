"""Registered queries of the training-data operators, on the given tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, spread
from . import (bpe, bwt_dedup, chat, exact_dedup, jaccard_join, lexical_search, mixing, packing, prefix_trie, quality, sharding,
               substring_dedup, toxicity)
from .common import table, text_bytes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
N_SHARDS = 24


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return fn


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_bpe(spark, sf_dir):
    """Ids and decoded texts of all documents (digests)."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op2_packing(spark, sf_dir):
    """Token ids of all documents in packed rows: id matrix lines, positions and segments."""
    path, docs = tokenizer_path(), table(spark, sf_dir, "documents")
    if text_bytes(docs, "text") > packing.BLOCK_BYTES:  # else one block holds all
        docs = spread(docs)
    encoded = bpe.encode(docs, path, shuffle=False)
    return packing.pack_ids(encoded, bpe.end_id(path))


@query
def op3_substring_dedup(spark, sf_dir):
    """All documents without the passages that an earlier document has."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op4_chat(spark, sf_dir):
    """All conversations, and one that says the control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(probe)))


@query
def op5_toxicity(spark, sf_dir):
    """Probabilities and flags of all documents, from a chain over the given labels."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                    {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")})


@query
def op6_jaccard_join(spark, sf_dir):
    """Components of similar documents over all documents."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark, sf_dir):
    """Verdict and base statistics of every document."""
    judged = quality.quality(table(spark, sf_dir, "documents"), stats=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_sharding(spark, sf_dir):
    """All documents in contiguous shards of near equal bytes."""
    s = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), N_SHARDS)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_exact_dedup(spark, sf_dir):
    """Groups of equal normalised texts over all documents."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query
def op10_mixing(spark, sf_dir):
    """All documents mixed to source weights 5, 2, 1."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op11_prefix_trie(spark, sf_dir):
    """Prefix trie of all conversations, with openings shared in families of twenty."""
    seqs = prefix_trie.share_openings(prefix_trie.sequences(table(spark, sf_dir, "conversations")))
    return prefix_trie.build_trie(seqs).drop("turn_id")


@query
def op12_suffix_dedup(spark, sf_dir):
    """All documents without the 50-byte strings that an earlier document has."""
    out = bwt_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_lexical_search(spark, sf_dir):
    """The fifty best of all documents for every benchmark item."""
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
