"""Queries of this folder against DuckDB and brute-force versions on the small tables."""

import hashlib
import json
import re

import duckdb
import pytest
import sentencepiece

from tillroll.llm import chat_events, page_text, piece_codec, url_rules
from tillroll.llm.queries import QUERIES, SQL, URL_RULES, piece_model

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, DATA).collect()]


@pytest.mark.parametrize("name", sorted(n for n, s in SQL.items() if s))
def test_query_matches_sql(spark, duck, name):
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(json.dumps(dict(sorted(zip(names, r)))) for r in cur.fetchall())
    assert sorted(json.dumps(dict(sorted(r.items()))) for r in rows(spark, name)) == want


def test_pieces_match_the_library(spark, duck):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = {}
    for i, t in duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        ids = library.encode(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op8_pieces")} == want


def test_page_text_is_the_article(spark, duck):
    def article(page):
        inside = re.search("<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(page_text.html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        return "\n".join(p for p in parts if p)
    want = {i: article(h) for i, h in duck.execute("SELECT page_id, html FROM pages").fetchall()}
    got = rows(spark, "op4_page_text")
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_url_rules_against_plain_python(spark, duck):
    def judged(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host):])[0]
            host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None
    urls = dict(duck.execute("SELECT page_id, url FROM pages").fetchall())
    for r in rows(spark, "op7_url_rules"):
        host, path, rule, verdict = judged(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])


@pytest.mark.parametrize("name,label,least", [("op1_gam_quality", "quality", 0.9), ("op5_nearest_toxic", "toxic", 0.9)])
def test_classifiers_on_labels_they_did_not_see(spark, duck, name, label, least):
    data = "/root/testdata/sf0.1"
    known = dict(duck.execute(f"SELECT doc_id, {label} FROM '{data}/labels.parquet'").fetchall())
    got = [r.asDict() for r in QUERIES[name](spark, data).collect()]
    assert len(got) == 10_000 and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["predicted"], known[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in known]
    hit = sum(p == y == 1 for p, y in held)
    assert 2 * hit / (sum(p for p, _ in held) + sum(y for _, y in held)) > least


def test_pipeline_stages_keep_clean_documents(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    folder = corpus_pipeline.shared_folder(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            out.write.mode("overwrite").parquet(f"{folder}/stage-{k}")
            kept = spark.read.parquet(f"{folder}/stage-{k}")
            assert kept.count() >= 0.8 * docs.count()
            docs = kept
        else:
            assert out.where("NOT round_trip OR n_tokens <> size(ids)").count() == 0 and out.count() == docs.count()
