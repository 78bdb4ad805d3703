"""The registered queries of this folder: each reads whole tables, applies one operator and keeps the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm import chat_events, curriculum, decontaminate, gam_quality, hard_negatives, jaccard_join, line_rules, nearest_toxic, page_text, piece_codec, ranked_search, repeats, sql, url_rules
from tillroll.llm.common import crc_remainder, read, ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ready(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if text:
            SQL[name] = text
        return fn
    return keep


def piece_model() -> str:
    """Place of the vocabulary that op8 and the pipeline use."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _judged(found: DataFrame, by: int, held: int, least: float) -> DataFrame:
    return found.withColumns({"held_out": crc_remainder("doc_id", by) == held, "predicted": (F.col("score") >= least).cast("int")})


@query("op1_gam_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = gam_quality.fit(docs, read(spark, sf_dir, "labels"), crc_remainder("doc_id", 4) != 2)
    return _judged(gam_quality.scored(docs, model), 4, 2, 0.7).select("doc_id", "held_out", "score", "predicted")


@query("op2_jaccard_join", sql.JACCARD)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(read(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query("op3_chat_events", sql.CHAT)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    events = rows.unionByName(own).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("turn").alias("target"), "role", "text")
    return chat_events.digests(chat_events.formatted(chat_events.fold(events)))


@query("op4_page_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_text.extracted(pages, page_text.fit(pages)).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op5_nearest_toxic")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    index = nearest_toxic.fit(docs, read(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) != 0)
    return _judged(nearest_toxic.scored(docs, index), 5, 0, 0.5).select("doc_id", "held_out", "score", "predicted", F.slice("neighbours", 1, 3).alias("evidence"))


@query("op6_repeats", sql.REPEATS)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op7_url_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op8_pieces")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(read(spark, sf_dir, "documents"), piece_model())


@query("op9_line_quality", sql.LINE_QUALITY)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.line_quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_decontaminate", sql.DECONTAMINATE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row").distinct()


@query("op11_hard_negatives", sql.HARD_NEGATIVES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    whole = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives.mined(rows.where(whole).select("vec_id", label.alias("label"), vec.alias("vec")), F.col("vec_id") % 50 == 0)


@query("op12_curriculum_mix", sql.MIX)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.digests(read(spark, sf_dir, "documents"))


@query("op13_ranked_search", sql.SEARCH)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
