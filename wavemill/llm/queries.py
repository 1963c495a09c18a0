"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cover_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    found = substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), 8)


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers; the same path holds on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import encode_documents

    return encode_documents(spread(_table(spark, sf_dir, "documents")), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op5_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(spread(_table(spark, sf_dir, "documents")))


def op6_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(spread(_table(spark, sf_dir, "documents")), tokenizer_path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    return read_warc(write_warc(_table(spark, sf_dir, "pages")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents"))


def op11_buffer_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, restored

    done = restored(fill_in_middle(_table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import language_model

    return language_model(_table(spark, sf_dir, "documents"))


def op13_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
