"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept. All but the last return the columns of their input, extra ones and such
with dots in their names too; the last returns the packed pieces. An empty table gives empty tables all the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from wavemill.llm._shared import column, dealt_join, fresh
from wavemill.llm.queries import tokenizer_path


def _columns(docs: DataFrame) -> list:
    return [column(c).alias(c) for c in docs.columns]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the factorization machine, fitted on the labelled rows of docs, scores at its threshold or above.

    Null and empty texts and null ids are scored like any row; a null or empty text has the score of no terms, about the share of toxic
    labels. Repeated rows share one score and so one fate; a text of any length is scored whole.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels), name="__wm_score")
    return scored.where(F.col("__wm_score") < toxicity.THRESHOLD).drop("__wm_score")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null is empty, and empty texts are equal) the row with the largest doc_id stays.

    Of rows that repeat both id and text one stays. A null id is smaller than any: such a row stays only where no row with an id has
    its text. Texts of any length are compared by their whole SHA-256.
    """
    digest = F.unhex(F.sha2(exact_dedup.normalised(F.col("text")), 256)).alias("__wm_digest")
    own = [F.coalesce("doc_id", F.lit(0)).alias("__wm_id"), F.col("doc_id").isNull().alias("__wm_null"), digest]
    key = ["__wm_id", "__wm_null", "__wm_digest"]
    groups = exact_dedup.shared_digests(docs).select(F.col("digest").alias("__wm_digest"), "keep_id")
    copies = dealt_join(docs.select("doc_id", *own), groups, ["__wm_digest"])
    dropped = copies.where("keep_id IS NOT NULL AND NOT doc_id <=> keep_id").select(*key).distinct()
    # Both steps want the rows by this key: the texts are shuffled once.
    return docs.select(*_columns(docs), *own).join(dropped, key, "left_anti").dropDuplicates(key).select(*_columns(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays, the one with the smallest doc_id.

    Null ids and texts without a word, null and empty ones too, are similar to nothing and stay. Rows that repeat an id share its fate.
    """
    dropped = near_dedup.near_dedup(docs).where("NOT kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*_columns(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose tiles cover half of a benchmark item or more; a narrow filter, no text is shuffled.

    Null and empty texts stay, and so does everything under an empty benchmark; each repeated row is judged alike.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in windows of 4096 ids.

    Null and empty texts are one id, the end id; a null doc_id stays null; repeated rows are packed as often as they occur; a longer
    text than a window is cut into several.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Trained scores, signatures and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
