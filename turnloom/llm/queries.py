"""The queries opN_<name>: each applies its operator to its whole table, and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table


def vocabulary(name: str) -> str:
    """The default place of a public tokenizer's file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of near equal bytes by 8192 virtual slots; `slot` is the place in the shard.

    The map of the slots is stored: version 0 as dealt, version 1 as edited for these documents.
    """
    from .sharding import assign, create_map

    create_map(spark, maps := new_path(spark, "slot-maps"), 24)
    rows = assign(table(spark, sf_dir, "documents"), maps, 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op2_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by context-tree weighting over bytes, and by word counts."""
    from .tree_weighting import score

    return score(table(spark, sf_dir, "documents"))


def op3_addressable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as token files of directly addressable codes, read back."""
    from .token_files import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)).drop("path", "place")


def op4_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among documents: fingerprints of three-word shingles at three differing bits or fewer."""
    from .simhash import near_duplicates

    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every page, in files with a dictionary, read back."""
    from .warc import read_warcs, write_warcs

    return read_warcs(write_warcs(table(spark, sf_dir, "pages")))


def op7_family_then_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: family, then one-versus-one SVMs."""
    from .language import identify, learn

    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


def op8_local_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies, and edited copies of the images whose id is divisible by 20 among all images: a row per image.

    No table holds images, so each row of `embeddings` is drawn.
    """
    from .image_copies import searched

    return searched(table(spark, sf_dir, "embeddings"))


def op9_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of 2048 tokens by dominance reduction and best fit."""
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0)


def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, at a word edit similarity of 0.8."""
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_time_forward_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of rebuilt conversations, with the totals of its subtree."""
    from .prefix_trie import prefix_trie, rebuilt

    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


def op12_fragment_monoid_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies aligned by the byte offsets at which both end, and their links' counts over all documents."""
    from .token_alignment import align, link_statistics, pair_counts

    aligned = align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return link_statistics(aligned, pair_counts(aligned))


def op13_clause_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by clauses that a grammar of transducers matches."""
    from .toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Bare base32 of a SHA-1: each five hex digits are four of its digits.
BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + (CAST('0x' || substr(sha1({0}), CAST(5 * (i // 4) + 1 AS int), 5) AS bigint) >> CAST(15 - 5 * (i % 4) AS int)) % 32 AS int), 1)), '')"""


def oracle_sql() -> dict[str, str]:
    """SQL of the same rows, for the one query that SQL can express."""
    last = "max(page_id) OVER (PARTITION BY coalesce(html, ''))"
    return {
        "op6_dictionary_warc": f"""SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS bigint) AS payload_bytes, {BASE32.format("coalesce(html, '')")} AS payload_digest,
            CASE WHEN page_id = {last} THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < {last} THEN {last} END AS refers_to FROM pages"""
    }
