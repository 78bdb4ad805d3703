"""The whole pipeline on the smallest tables against plain Python over all rows and all pairs."""

import re

import sentencepiece

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_repeats
from tillroll.llm import nearest_toxic
from tillroll.llm.common import crc_remainder, ready, words_of
from tillroll.llm.queries import piece_model

DATA = "/root/testdata/sf0.001"


def windows(text):
    w = [x for x in re.split(r"[^\w]|_", (text or "").lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline_equals_plain_python(spark):
    ready(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    index = nearest_toxic.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), crc_remainder("doc_id", 5) != 0)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if index.score(t or "")[0] < 0.5]
    keep = {d for d, n, c in brute_components(rows, 5, 80) if not n or d == c}
    rows = [(i, t) for i, t in rows if i in keep]
    kept = {d: k for d, _, _, k in brute_repeats(rows)}
    items = [w for w in (windows(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()) if w]
    kept = {d: t for d, t in kept.items() if not any(100 * len(i & windows(t)) >= 80 * len(i) for i in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == set(kept) and all(r["round_trip"] for r in got.values())
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for d, r in got.items():
        text = library.decode(r["ids"])
        assert words_of(text) == kept[d].split() and library.encode(text) == r["ids"]
