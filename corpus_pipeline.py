"""From documents to training tokens: toxic documents go, one of each group of near duplicates stays, repeated passages and
documents with benchmark items go, the rest is encoded.

Each stage is a function of (spark, docs, sf_dir) over all that the stage before kept; its result is written as Parquet and read again. All but the last return the columns of
documents. A null text is an empty one; rows of an empty table give an empty result of the same columns; extra columns of documents pass through the first four stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import decontaminate, jaccard_join, nearest_toxic, piece_codec, repeats
from tillroll.llm.common import crc_remainder, read, ready
from tillroll.session import shared_folder

#: Place of the vocabulary; None: the installed one.
PIECE_MODEL: str | None = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the examples come from labelled documents whose crc32 of the id leaves a remainder by 5."""
    ready(spark)
    index = nearest_toxic.fit(docs, read(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) != 0)
    return nearest_toxic.without_toxic(docs, index)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles the one with the smallest id."""
    ready(spark)
    return jaccard_join.one_per_component(docs, n=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words and more that a document with a smaller id holds; n_chars follows."""
    ready(spark)
    out = repeats.without_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint"))) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item (0.8 of its five-word shingles)."""
    ready(spark)
    return decontaminate.without_items(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and round_trip (decoding gives the text again) of every document."""
    ready(spark)
    path = PIECE_MODEL
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.token_rows(docs, path, [c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [("toxicity", toxicity), ("jaccard_join", near_duplicates), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("pieces", tokens)]

#: The last stage is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
