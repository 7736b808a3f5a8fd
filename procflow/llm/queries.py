"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.llm.byte_bpe import ByteVocabulary, encode_documents
from procflow.llm.collocations import mine_phrases
from procflow.llm.common import new_folder, table
from procflow.llm.decontaminate import find_benchmark
from procflow.llm.jaccard_join import jaccard_components
from procflow.llm.lattice import lattice_scores, piece_path
from procflow.llm.line_dedup import dedup_lines
from procflow.llm.packing import pack_documents
from procflow.llm.quality import THRESHOLD, fit, held_out, score_texts
from procflow.llm.sharding import write_shards
from procflow.llm.simhash import fingerprints_with_neighbours, near_classes
from procflow.llm.substring_dedup import remove_repeats
from procflow.llm.token_files import read_tokens, token_checksums, write_tokens
from procflow.llm.tokens import encoder_path
from procflow.llm.vector_codes import compress_vectors

Query = Callable[[SparkSession, str], DataFrame]

SHARD_BYTES = 1 << 20
#: The radius of the fingerprint search in bits, and the blocks of its tables. At sf0.1 all 293 pairs
#: with different shingle sets and a 5-word Jaccard similarity of 0.8 or more lie within 21 bits.
NEAR_BITS, NEAR_BLOCKS = 23, 6
#: Ids that end a document.
FILE_END, PACK_END = 1, 2


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(documents(spark, folder)).select(
        "row.doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit(docs, table(spark, folder, "labels"))
    scored = score_texts(docs, model, ["doc_id"])
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    return scored.select("row.doc_id", held_out(4, "row.doc_id").alias("held_out"), "score", predicted)


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's size and shard, as found in the written shards."""
    rows = write_shards(documents(spark, folder), SHARD_BYTES).sharding().rows
    return rows.select(F.col("key").alias("doc_id"), "n_bytes", "shard", "depth")


def op4_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_scores(documents(spark, folder), piece_path())


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(documents(spark, folder))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """For every row whose id is divisible by 20: the fingerprints, rows and classes in the radius.

    ``partners`` names classes of equal fingerprints, its own included; their rows are those of the
    result with these fingerprints (``simhash.partner_ids``).
    """
    out = fingerprints_with_neighbours(documents(spark, folder))
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    found = near_classes(out, asked, NEAR_BITS, NEAR_BLOCKS).withColumnRenamed("query", "fingerprint")
    searched = out.where(asked).join(found, "fingerprint", "left")
    return searched.unionByName(out.where(~asked), allowMissingColumns=True)


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = find_benchmark(documents(spark, folder), table(spark, folder, "benchmark"), carry=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = new_folder(spark, "token-files")
    write_tokens(documents(spark, folder), target, encoder_path(), FILE_END)
    return token_checksums(read_tokens(spark, target))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeats(documents(spark, folder), with_text=False)
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder), encoder_path(), PACK_END, with_ids=False)


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return mine_phrases(table(spark, folder, "documents").select("text", "lang"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes = compress_vectors(table(spark, folder, "embeddings"))
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return codes.label_errors().select(
        F.col("id").alias("vec_id"),
        F.array_join(digits, "").alias("code"),
        "error",
        "label_error",
        F.lit(codes.digest()).alias("codebooks_sha256"),
    )


def byte_vocabulary() -> ByteVocabulary:
    """The public vocabulary of many languages and its pattern."""
    import public_tokenizers

    return ByteVocabulary.of_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = byte_vocabulary()
    return encode_documents(documents(spark, folder), vocabulary).select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(vocabulary.id_bytes(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2(vocabulary.token_bytes(F.col("ids")), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_files": op8_token_files,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_vector_codes": op12_vector_codes,
    "op13_byte_bpe": op13_byte_bpe,
}
