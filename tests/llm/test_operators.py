"""Operators on small made cases: nulls, empty and very long texts, ties and repeated rows, empty tables, clashing names."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tillroll.llm import chat_events, common, decontaminate, gam_quality, jaccard_join, line_rules, nearest_toxic, page_text, piece_codec, repeats, url_rules
from tillroll.llm.queries import piece_model

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(autouse=True)
def prepared(spark):
    common.ready(spark)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "word " * 30_000), (6, "a"), (7, "x y"), (8, "x y")]


def clash(df):
    """Names that the operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("row", "key", "comp", "label", "score", "digest", "h", "part", "item", "_n", "ids", "cleaned", "words")})


# --- components -------------------------------------------------------------------------------------------------------------

def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(500, 500)]
    parent = {}
    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent if x != 500}


# --- n-gram Jaccard join ----------------------------------------------------------------------------------------------------

def brute_components(rows, n, percent):
    import string
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    def grams(t):
        w = common.words_of((t or "").translate(low))
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(rng, how_many, size, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(how_many):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n,percent,block", [(3, 90, 192), (5, 80, 192), (3, 90, 8)])
def test_join_finds_the_links_of_all_pairs(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # small blocks: groups are larger than one
    rng = random.Random(n + block)
    texts = [t for size, edits in [(12, 1), (40, 3), (90, 5), (200, 9), (400, 10), (30, 6)] for t in near_copies(rng, 14, size, edits)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {' '.join(f'q{rng.randrange(10**6)}' for _ in range(rng.randint(5, 30)))}" for _ in range(15)]
    rows = list(enumerate(texts)) + [(i + 1000, t) for i, t in ODD if i is not None] + [(None, texts[0]), (None, "alone here now"), (5000, texts[3].upper())]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(clash(docs_of(spark, rows)), n, percent).collect()), key=repr)
    assert got == brute_components(rows, n, percent)


def test_tree_join_equals_all_pairs_and_prunes(monkeypatch):
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**63, 120).astype(np.uint64)) for _ in range(40)]
    sets = base + [np.unique(np.concatenate([b[:-3], rng.integers(0, 2**63, 2).astype(np.uint64)])) for b in base]
    links = jaccard_join.block_links(sets, list(range(80)), [2] * 80, 90)
    assert sorted(tuple(sorted(x)) for x in links) == [(i, i + 40) for i in range(40)]
    assert jaccard_join.block_links(sets, [0] * 80, [2] * 80, 90) == []
    assert jaccard_join.block_links(sets, list(range(80)), [0] * 80, 90) == []


def test_every_linked_pair_shares_a_name():
    rng = np.random.default_rng(9)
    for percent in (80, 90):
        classes = jaccard_join.Classes(percent)
        for _ in range(400):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 300))).astype(np.uint64))
            b = a[rng.random(len(a)) > (100 - percent) / 220]
            b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, len(a) // 16 + 1))).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            if 100 * same >= percent * (len(a) + len(b) - same) and len(a) + len(b) > 2 * same:
                assert set(jaccard_join.part_names(a, classes)[0].tolist()) & set(jaccard_join.part_names(b, classes)[0].tolist())


def test_one_per_component_keeps_one_and_all_empty(spark):
    rows = [*ODD, (9, "one two three four five six"), (9, "something else entirely is written here")]
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.one_per_component(docs_of(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (5, "word " * 30_000), (6, "a"), (7, "x y"), (9, "something else entirely is written here")], key=repr)


# --- substring dedup --------------------------------------------------------------------------------------------------------

def brute_repeats(rows):
    first = {}
    texts = [(d, common.words_of(t or "")) for d, t in rows]
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - 12):
                k = tuple(w[i:i + 13])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - 12):
                if first[tuple(w[i:i + 13])] < d:
                    gone[i:i + 13] = [True] * 13
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_those_of_every_window(spark, seed):
    import hashlib
    rng = random.Random(seed)
    passages = [[str(rng.randrange(50)) for _ in range(rng.choice([12, 13, 14, 20, 60]))] for _ in range(12)] + [["run"] * 40]
    rows = []
    for d in range(120):
        w = [str(rng.randrange(10**5)) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w[k:k] = rng.choice(passages)
        rows.append((rng.randrange(100), " ".join(w)))
    rows += ODD + [(50_000 + i, t) for i, t in rows[:6]] + [(60_000, "word " * 100)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.digests(clash(docs_of(spark, rows))).collect()), key=repr)
    assert got == sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_repeats(rows)), key=repr)
    kept = [(r["doc_id"], " ".join(common.words_of(r["text"] or ""))) for r in repeats.without_repeats(docs_of(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted(((d, t) for d, _, _, t in brute_repeats(rows)), key=repr)


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 40])
def test_equal_windows_have_equal_keys(vocabulary):
    rng = random.Random(vocabulary)
    docs = [[str(rng.randrange(vocabulary)) for _ in range(rng.randint(0, 60))] for _ in range(60)]
    names = repeats.word_names([w for d in docs for w in d])
    seen, windows = {}, 0
    for k, d, lo, n in zip(*(x.tolist() for x in repeats.window_keys(names, np.array([len(d) for d in docs])))):
        for at in range(lo, lo + n):
            windows += 1
            assert len(docs[d][at:at + 13]) == 13 and seen.setdefault(tuple(docs[d][at:at + 13]), k) == k
    assert windows == sum(max(0, len(d) - 12) for d in docs)


def test_cut_keeps_the_gaps_of_kept_neighbours():
    assert repeats.cut("a b\nc  d e", [False] * 5) == "a b\nc  d e"
    assert repeats.cut("a b\nc  d e", [False, True, True, False, False]) == "a\nd e"
    assert repeats.cut("a b c", [True] * 3) == ""


# --- decontamination --------------------------------------------------------------------------------------------------------

def test_items_are_found_at_their_share_of_shingles(spark):
    words = [f"t{i}" for i in range(24)]  # 20 shingles
    item = " ".join(words)
    broken = lambda k: " ".join([*words[: 24 - k], "other", "words", "here"])  # noqa: E731  loses k shingles
    filler = " ".join(f"f{i}" for i in range(3000))
    rows = [(1, f"{filler} {item.upper()}! {filler}"), (2, f"{filler} {broken(4)}"), (3, f"{filler} {broken(5)}"), (4, filler), (5, None), (6, ""), (7, "two words"), (9, f"{filler} two words {filler}"), (10, "words two"), (None, item), (1, filler), (8, " ".join(words[3:9]))]
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "Two, words"), (5, " ".join(f"z{i}" for i in range(30)))], "item_id bigint, text string")
    found = decontaminate.find_items(clash(docs_of(spark, rows)), items)
    got = sorted(((r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_found"]) for r in found.collect()), key=repr)
    assert got == sorted([(1, 1, 20, 20), (2, 1, 20, 16), (7, 4, 1, 1), (9, 4, 1, 1), (None, 1, 20, 20)], key=repr)
    whole = decontaminate.find_items(docs_of(spark, rows), items, short_inside=False)
    assert sorted((r["doc_id"] for r in whole.where("item_id = 4").collect())) == [7]
    kept = decontaminate.without_items(docs_of(spark, rows), items)
    assert kept.columns == docs_of(spark, rows).columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 10, 3, 4, 5, 6, 8, 9]
    assert decontaminate.find_items(docs_of(spark, rows), items.limit(0)).count() == 0


# --- quality rules ----------------------------------------------------------------------------------------------------------

def test_line_rules(spark):
    good = "This is a line of an ordinary text that ends as it should. " * 3
    rows = [(1, "\n".join([good, good + "x.", "Home | About | News | Contact", "We use cookies here, accept them please."])), (2, "\n".join(["Menu | Home | News | More"] * 1 + [f"A{i} | B{i} | C{i}" for i in range(30)])), (3, good * 10), (4, None), (5, "a b c " * 40)]
    got = {r["doc_id"]: r for r in line_rules.line_quality(clash(docs_of(spark, rows))).collect()}
    assert got[1]["cleaned"] == "\n".join([good, good + "x."]) and got[1]["base_failed"] and not got[1]["kept"]  # every window repeats
    assert not got[2]["kept"] and got[2]["cleaned"] == ""
    assert got[4]["n_words"] == 0 and got[4]["base_failed"] and got[5]["n_repeat_words"] == 120
    long = line_rules.line_quality(docs_of(spark, [(1, " ".join(f"w{i}" for i in range(30_000)) + ".")])).first()
    assert long["kept"] and long["n_words"] == 30_000 and long["n_repeat_words"] == 0


# --- SentencePiece ----------------------------------------------------------------------------------------------------------

def test_codec_equals_the_library_on_odd_texts():
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=piece_model()), piece_codec.PieceModel(piece_model()), random.Random(1)
    bits = ["\n\n", "\0a", "\n▁", " \n", "a", "b", " ", "  ", "\n", "\t", "é", "ß", "<s>", "1", "12", "▁", "漢字", "🙂", "the", "ing", "er", "###", "   ", "．", "​", "<0x0A>", "====", "�"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        ids = library.encode(text)
        assert model.encode(text) == ids and model.decode_joined(model.coded(text)) == library.decode(ids) == model.decode(ids)
    for text in ("a" * 30_000, "=-" * 9_000 + " " * 5_000):
        assert model.encode(text) == library.encode(text) and model.decode_joined(model.coded(text)) == text


def test_decoding_reads_nothing_but_the_ids():
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=piece_model()), piece_codec.PieceModel(piece_model()), random.Random(3)
    plain = [i for i, k in enumerate(model.kinds) if k == piece_codec.NORMAL]
    for _ in range(500):
        ids = rng.choices(plain, k=rng.randint(0, 20))
        assert model.decode(ids) == library.decode(ids)
    assert not model.words and model.decode_joined("") == ""


def test_backtracking_equals_merging():
    model, rng = piece_codec.PieceModel(piece_model()), random.Random(2)
    for _ in range(1500):
        word = "▁" + "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 14)))
        assert [model._piece(i) for i in model.split(word)] == model.merged(word)


def test_codec_columns(spark):
    rows = clash(docs_of(spark, ODD))
    out = piece_codec.decoded(piece_codec.encoded(rows, piece_model()), piece_model())
    assert all(r["decoded"] == (r["text"] or "") for r in out.collect()) and out.count() == len(ODD)
    assert piece_codec.encoded(rows.limit(0), piece_model()).count() == 0


# --- chat -------------------------------------------------------------------------------------------------------------------

def test_events_fold_into_final_messages(spark):
    log = [(1, 0, "message", 0, "user", "hel"), (1, 1, "delta", 0, None, "lo"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "first "), (1, 4, "delta", 2, None, "try"), (1, 5, "regenerate", 2, None, None),
           (1, 6, "delta", 2, None, "second"), (1, 7, "edit", 0, None, "hello!"), (1, 8, "message", 8, "user", "gone"), (1, 9, "delete", 8, None, None), (1, 10, "unknown", 0, None, "zzz"),
           (2, 0, None, None, None, None), (2, 1, "delta", 7, "assistant", "no opening"), (None, 0, "message", None, "user", "x"), (None, 0, "message", None, "user", "x")]
    folded = chat_events.fold(spark.createDataFrame(random.Random(1).sample(log, len(log)), "conv_id bigint, seq bigint, kind string, target bigint, role string, text string"))
    got = sorted((tuple(r) for r in folded.collect()), key=repr)
    assert got == sorted([(1, 0, 0, "user", "hello!"), (1, 2, 0, "assistant", "second"), (2, 0, 0, "", ""), (2, 7, 0, "assistant", "no opening"), (None, 0, 0, "user", "x"), (None, 0, 1, "user", "x")], key=repr)
    digest = {r["conv_id"]: r for r in chat_events.digests(chat_events.formatted(folded)).collect()}
    assert digest[1]["n_turns"] == 2 and digest[1]["loss_chars"] == 6 and digest[1]["formatted_chars"] == len("<s>[INST] hello! [/INST] second </s>") and digest[None]["n_turns"] == 2


def test_template_reads_back():
    rng, bits = random.Random(2), ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "a", " ", "\n", "<", "[", "/", "é"]
    turns = [(rng.choice(["user", "assistant", "system", "", "x\ny", "to\\ol<<SYS>>"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for _ in range(3000)]
    assert chat_events.read_conversation(chat_events.START + "".join(chat_events.render(*t)[0] for t in turns)) == turns
    for role, text in turns:
        piece, a, z = chat_events.render(role, text)
        assert chat_events.unescape(piece[a:z]) == (text if role == "assistant" else "")


def test_reader_finds_the_ends_of_turns_in_parts_of_any_size():
    turns = [("user", "a [/INST"), ("assistant", ""), ("x\ny", "<</SYS>>"), ("", " </s>"), ("assistant", "[INST] b")]
    whole = chat_events.START + "".join(chat_events.render(*t)[0] for t in turns)
    for size in (1, 2, 3, 7, 1000):
        reader, got = chat_events.Reader(), []
        for i in range(0, len(whole), size):
            got += reader.feed(whole[i:i + size])
        reader.close()
        assert got == turns
    for broken in ("", "<s>[INST] a", "<s>[INST] a [/INST]b", "[INST] a [/INST]"):
        with pytest.raises(ValueError):
            chat_events.read_conversation(broken)


def test_texts_without_escapes_do_not_read_back(monkeypatch):
    said = "</s>[INST] ok [/INST]"
    turns = [("user", said), ("assistant", said)]
    monkeypatch.setattr(chat_events, "escape", lambda text: text)
    with pytest.raises(ValueError):
        chat_events.read_conversation(chat_events.START + "".join(chat_events.render(*t)[0] for t in turns))


def test_chat_of_odd_logs(spark):
    schema = "conv_id bigint, seq bigint, kind string, target bigint, role string, text string, piece string, message int"
    long = "word [INST] " * 200_000
    log = spark.createDataFrame([(1, 0, "message", 0, "assistant", long, "x", 1), (1, 1, "message", 1, "user", None, None, None)], schema)
    row, = chat_events.digests(chat_events.formatted(chat_events.fold(log))).collect()
    assert row["n_turns"] == 2 and row["loss_chars"] == len(long) and row["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert chat_events.digests(chat_events.formatted(chat_events.fold(log.limit(0)))).count() == 0


# --- page text --------------------------------------------------------------------------------------------------------------

def test_pages_in_other_clothes(spark):
    article = "<h1>A title</h1><p>First paragraph with some words, and more.<p>Second &amp; last &eacute;.<aside class=related><a>Other</a></aside><div class='ad'>Buy now</div>"
    pages = [f"<nav><a>Home {i}</a></nav><div class=ad>Some advert text {i}.</div><article><h1>T{i}</h1><p>Words of the page number {i}, which go on.</p></article><footer>&copy; {i}</footer>" for i in range(60)]
    field = page_text.train(pages)
    want = "A title\nFirst paragraph with some words, and more.\nSecond & last é."
    for tag, name in (("article", ""), ("main", ""), ("div", " class='post-content'")):
        page = f"<html><head><title>x</title><script>var a='<p>no</p>'</script></head><body><div class='topbar menu'><a>Home</a></div><div class=cookie-notice>We use cookies</div><{tag}{name}>{article}</{tag}><section class=comments><p>Nice one, thanks!</p></section><form>Subscribe</form><footer>&copy; x"
        assert field.extract(page) == want
    assert field.extract("") == "" and page_text.blocks("<p>a<b>b<!-- x -->c</b> <br>d<li>e<td") != []
    frame = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, pages[0], "t"), (3, pages[0], "t")], "page_id bigint, html string, text string")
    assert sorted(r["text"] for r in page_text.extracted(frame, field).collect()) == ["", "", "T0\nWords of the page number 0, which go on.", "T0\nWords of the page number 0, which go on."]
    assert page_text.extracted(frame.limit(0), page_text.fit(frame.limit(0))).count() == 0


@pytest.mark.parametrize("tag", ["select", "object", "noscript", "canvas", "audio", "video", "svg", "math", "template"])
def test_unclosed_quiet_elements_lose_nothing(tag):
    texts = lambda page: [b for _, b, _ in page_text.blocks(page)]
    assert texts(f"<article><p>One.</p><{tag}>in <p>Two.</p></article><p>Three.") == ["One.", "in", "Two.", "Three."]
    inner = f"<p>a <{tag}>in</{tag}> b</p>"
    assert " ".join(texts(inner)).split() == (["a", "in", "b"] if tag == "math" else ["a", "b"])


def test_quiet_elements_end_with_what_is_around_them():
    texts = lambda page: [b for _, b, _ in page_text.blocks(page)]
    assert texts("<div><p>a</p><object><b>no</div><p>b</p></object><p>c") == ["a", "b", "c"]
    assert texts("<select><option>x<option>y<p>b</p><select><option>z</select>c") == ["b", "c"]
    assert texts("<noscript><div><p>no<div>no</noscript>yes<iframe><p>no</iframe>, too") == ["yes, too"]
    assert texts("a<script>if (a<b) '</div>'</script>b<style>x") == ["ab"]
    assert texts("Let <math><mi>x</mi><annotation>\\x</annotation></math> be.") == ["Let x be."]
    long = "<select>" * 20_000 + "<p>" + "word " * 100_000
    assert texts(long) == [" ".join(["word"] * 100_000)]


# --- URL rules --------------------------------------------------------------------------------------------------------------

def test_rules_learned_from_decided_urls(spark):
    urls = [f"https://s{i % 7}.bad.net/casino/{i}?ref=x" for i in range(40)] + [f"https://s{i % 7}.good.org/fr/news/{i}" for i in range(40)] + ["http://new.com/casino/7?ref=x", "http://new.com/news/9", "nothing", None, "HTTP://A.B.NET", "http://u.NET/x", "http://u.NET/x"]
    rules = [("block", "net", "/"), ("allow", "org", "/fr/")]
    out = url_rules.filter_urls(clash(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")), rules, min_support=0.1)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert len(got) == len(urls) and got[80] == ("new.com", "/casino/7", None, "block") and got[81] == ("new.com", "/news/9", None, "allow")
    assert got[82] == got[83] == ("", "", None, "allow") and got[84] == ("a.b.net", "", None, "block") or got[84][2] is None
    assert got[85] == got[86] == ("u.net", "/x", "net/", "block")
    assert url_rules.filter_urls(out.limit(0), rules).count() == 0


def test_long_templates_are_one_item(spark):
    parts = "/".join(f"part{k}" for k in range(30))
    urls = [f"http://s{i % 5}.bad.net/{parts}/{i}" for i in range(200)] + [f"http://g{i}.org/fr/{parts if i < 2 else 'news'}" for i in range(60)] + [f"http://new.com/part{k}/x" for k in range(30)] + ["http://new.com/" + "a" * 100_000]
    rules = [("block", "net", "/"), ("allow", "org", "/fr/")]
    out = url_rules.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string"), rules)
    got = {r["page_id"]: r["verdict"] for r in out.collect()}
    assert len(got) == len(urls) and all(got[260 + k] == "block" for k in range(30)) and got[290] == "allow"


def test_rules_equal_those_of_all_token_sets(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(120):
        tokens = {t for t in "abcdef" if rng.random() < 0.4}
        tokens |= {"a2", "a3"} if "a" in tokens else set()
        rows.append((sorted(tokens), "block" if len(tokens & {"a", "b"}) == 2 or "c" in tokens and rng.random() < 0.8 else "allow"))
    sets = [(i, sorted(t for t in ("a", "a2", "a3", *"bcdef") if rng.random() < 0.4)) for i in range(60)]
    rules, known = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8)
    found = url_rules.inside(url_rules.in_classes(spark.createDataFrame(sets, "key bigint, tokens array<string>"), known), rules)
    got = {r["key"]: (round(r["confidence"], 9), round(r["support"], 9), r["verdict"]) for r in found.groupBy("key").agg(F.max(F.struct("confidence", "support", "verdict")).alias("m")).select("key", "m.*").collect()}
    want = {}
    for key, tokens in sets:
        for mask in range(1, 1 << len(tokens)):
            part = {t for k, t in enumerate(tokens) if mask >> k & 1}
            verdicts = [v for t, v in rows if part <= set(t)]
            for v in ("allow", "block"):
                n = verdicts.count(v)
                if n >= 0.05 * len(rows) and n >= 0.8 * len(verdicts):
                    want[key] = max(want.get(key, (0, 0, "")), (round(n / len(verdicts), 9), round(n / len(rows), 9), v))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] for k in want)


# --- classifiers ------------------------------------------------------------------------------------------------------------

def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(500):
        terms = np.sort(rng.choice(60, int(rng.integers(1, 9)), replace=False))
        rows.append(nearest_toxic.unit(terms, rng.integers(1, 4, len(terms)).astype(float), np.ones(60)))
    index = nearest_toxic.ToxicIndex([f"w{i}" for i in range(60)], np.ones(60), list(range(500)), rows, rng.integers(0, 2, 500).astype(float), 15, 0.1)
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for i in range(0, 500, 7):
        at, cos = index.nearest(*rows[i])
        every = dense @ dense[i]
        want = [j for j in np.lexsort((np.arange(500), -np.round(every, 12))) if every[j] > 0][:15]
        assert at.tolist() == want and np.allclose(cos, np.minimum(1, every[want]))


def test_block_max_search_is_exact_with_more_terms_than_tables(monkeypatch):
    """Uneven terms, several parts, terms in tables and in lists, texts that go either way, and remembered words that overflow."""
    for name, value in (("HEADS", 50), ("COMMON", 40), ("REMEMBERED", 300)):
        monkeypatch.setattr(nearest_toxic, name, value)
    rng = np.random.default_rng(4)
    n_terms, n = 3000, 900
    idf = np.where(rng.random(n_terms) < 0.02, 40.0, 0.05 + rng.random(n_terms))
    words, rows = [f"w{i}" for i in range(n_terms)], []
    for i in range(n):
        own = (rng.pareto(0.7, 40) * 8).astype(int) % 1000 + 1000 * (i % 3)
        rows.append(np.unique(np.concatenate([own, rng.integers(0, n_terms, 3)])))
    counts = [rng.integers(1, 5, len(t)).astype(float) for t in rows]
    index = nearest_toxic.ToxicIndex(words, idf, list(range(n)), [(t, (1 + np.log(c)).astype(np.float32)) for t, c in zip(rows, counts)], rng.integers(0, 2, n).astype(float), 15, 0.1)
    dense = np.zeros((n, n_terms))
    for i, (t, c) in enumerate(zip(rows, counts)):
        dense[i, t] = nearest_toxic.unit(t, c, idf)[1]
    texts = [" ".join(words[x] for x, k in zip(rows[i], counts[i]) for _ in range(int(k))) for i in range(0, n, 5)]
    alone = nearest_toxic.ToxicIndex(["a", "b"], np.ones(2), [7], [(np.array([0]), np.ones(1, np.float32))], np.ones(1), 15, 0.1)
    assert [a.tolist() for a in alone.nearest(*alone.vector("a a b"))] == [[0], [pytest.approx((1 + np.log(2)) / np.hypot(1 + np.log(2), 1))]]  # nothing is listed
    vectors = index.vectors(texts) + [index.vector(t) for t in texts[::9]]
    for j, (terms, weights) in enumerate(vectors):
        i = 5 * j if j < len(texts) else 45 * (j - len(texts))
        assert np.array_equal(terms, rows[i]) and np.allclose(weights, dense[i, terms])
        at, cos = index.nearest(terms, weights, leave=i if j % 2 else -1)
        every = dense @ dense[i]
        want = np.sort([every[e] for e in range(n) if every[e] > 0 and (e != i or j % 2 == 0)])[::-1][:15]
        assert len(set(at.tolist())) == len(want) and np.allclose(cos, np.minimum(1, want), atol=1e-6) and (j % 2 == 0 or i not in at)


def test_toxic_words_are_found_and_empty_labels_do_no_harm(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(60)) + (" vile scum" if i % 5 == 0 else "")) for i in range(400)] + [(1000, None), (1001, ""), (1002, "you scum"), (None, "scum vile")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(0, 1, 1), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    index = nearest_toxic.fit(clash(docs).drop("label").join(labels.select("doc_id").limit(0), "doc_id", "left"), labels, F.lit(True))
    got = [(r["doc_id"], r["score"] >= 0.5) for r in nearest_toxic.scored(clash(docs), index).collect()]
    assert len(got) == len(rows) and all(toxic == (i is None or i == 1002 or i < 400 and i % 5 == 0) for i, toxic in got)
    assert nearest_toxic.without_toxic(clash(docs), index).count() == len(rows) - 82
    none = nearest_toxic.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in nearest_toxic.scored(docs, none).collect()} == {0.0}


def _rejects_planted(spark, labelled):
    """Documents with one toxic word each are rejected, others stay, with examples made by ``labelled``."""
    rng = random.Random(8)
    bad = [f"{c}slur" for c in "abcdefgh"]
    text = lambda extra: " ".join([f"w{rng.randrange(300)}" for _ in range(40)] + extra)
    rows = labelled(bad, text)
    new = [(1000 + i, text([w, w])) for i, w in enumerate(bad)] + [(2000 + i, text([])) for i in range(40)]
    docs = docs_of(spark, [(i, t) for i, t, _ in rows] + new)
    index = nearest_toxic.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"), F.lit(True))
    left = {r["doc_id"] for r in nearest_toxic.without_toxic(docs, index).collect()}
    assert not left & set(range(1000, 1008)) and len(left & set(range(2000, 2040))) >= 36
    assert np.isin(nearest_toxic.names_of(["w1", *bad]), index.names).all()


def test_toxic_words_of_three_examples_count(spark):
    _rejects_planted(spark, lambda bad, text: [(i, text([bad[i % 8]]), 1) for i in range(24)] + [(i, text([]), 0) for i in range(24, 200)])


def test_toxic_words_quoted_in_clean_texts_count_where_most_are_toxic(spark):
    _rejects_planted(spark, lambda bad, text: [(i, text([bad[i % 8], bad[(i + 1) % 8]]), 1) for i in range(160)] + [(i, text([bad[i % 8]] if i < 168 else []), 0) for i in range(160, 300)])


def test_gam_learns_a_step_and_an_interaction(spark):
    rng = np.random.default_rng(5)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((gam_quality.boost(x, y).score(x) > 0.5) == y).mean() > 0.95
    assert np.allclose(gam_quality.boost(x, np.ones(4000)).score(x), 0.999) and np.allclose(gam_quality.boost(x[:0], y[:0]).score(x), 0.5)
    docs = docs_of(spark, ODD)
    got = gam_quality.scored(clash(docs), gam_quality.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int"), F.lit(True))).collect()
    assert len(got) == len(ODD) and {r["score"] for r in got} == {0.5}


def test_empty_documents(spark):
    none = docs_of(spark, ODD).limit(0)
    assert jaccard_join.joined(none).count() == repeats.digests(none).count() == jaccard_join.one_per_component(none).count() == repeats.without_repeats(none).count() == 0
    assert decontaminate.without_items(none, spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")).count() == line_rules.line_quality(none).count() == 0


def test_sets_with_many_empty_parts_still_share_a_name(monkeypatch):
    monkeypatch.setattr(jaccard_join.Classes, "spare", lambda self, c: 0)  # nearly every set has empty parts, so all cuts are needed
    rng = np.random.default_rng(2)
    classes = jaccard_join.Classes(80)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 40))).astype(np.uint64))
        b = np.unique(np.concatenate([a[1:], rng.integers(0, 2**63, int(rng.integers(0, 2))).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if 100 * same >= 80 * (len(a) + len(b) - same):
            assert set(jaccard_join.part_names(a, classes)[0].tolist()) & set(jaccard_join.part_names(b, classes)[0].tolist())


def test_blocks_are_joined_in_waves(spark, monkeypatch):
    """Sets that lie in many blocks don't travel all at once; the components stay."""
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(6)]
    rows = [(i, base[i % 6] + f" x{i // 24}") for i in range(96)]
    want = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.joined(docs_of(spark, rows), 3, 80).collect())
    waves, pin = [], jaccard_join.pin
    monkeypatch.setattr(jaccard_join, "pin", lambda df: waves.append(df.columns) or pin(df))
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "WAVE", 0.3)
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.joined(docs_of(spark, rows), 3, 80).collect()) == want
    assert waves.count(["a", "b"]) > 3


def test_words_of_long_texts_are_not_held_together(monkeypatch):
    """The words of a batch are named a few texts at a time; the sets stay."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000)) for _ in range(40)] + [None, "", "a b", " " * 2_000_000, "x y z x"]
    calls, names = [], jaccard_join.word_names
    monkeypatch.setattr(jaccard_join, "word_names", lambda words: calls.append(len(words)) or names(words))
    got = jaccard_join._sets(texts, 3)
    assert sum(calls) == 40 * 20_000 + 6 and max(calls) <= 200_000
    assert len(got) == len(texts) and all(np.array_equal(x, jaccard_join._sets([t], 3)[0]) for x, t in zip(got, texts))


def test_batches_of_long_texts_are_small(spark):
    """A batch that goes to a Python worker is bounded in bytes too."""
    import pyarrow as pa
    long_ = spark.range(0, 60, 1, 1).select("id", F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), 50_000).alias("text"))
    sizes = [r["n"] for r in long_.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"]) for b in bs), "n bigint").collect()]
    assert sum(sizes) == 60 and max(sizes) <= 20


@pytest.mark.parametrize("first", [True, False])
def test_blocks_are_bounded_by_shingles(spark, monkeypatch, first):
    """A family of few but long sets is several blocks; in the second round every two sets of different components still share one."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 20_000)
    rows = [(i, 0 if i < 30 else i, 1000, [7], [7]) for i in range(60)]
    sets = spark.createDataFrame(rows, "row bigint, comp bigint, size bigint, first_names array<bigint>, all_names array<bigint>")
    blocks = {}
    for r in jaccard_join._meetings(sets, first).collect():
        blocks.setdefault(r["block"], {})[r["row"]] = r["side"]
    assert max(map(len, blocks.values())) < 60 and {i for b in blocks.values() for i in b} == set(range(60))
    if not first:
        met = {(i, j) for b in blocks.values() for i, x in b.items() for j, y in b.items() if i < j and (x + y >= 2 or x != y)}
        assert {(i, j) for i in range(60) for j in range(max(i + 1, 30), 60)} <= met


def test_texts_that_only_share_passages_are_not_held_against_each_other(spark, monkeypatch):
    """Sets of passages that many texts hold make no large family; the rows of blocks stay in proportion to the texts."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(11)
    passages = [" ".join(f"p{k}x{i}" for i in range(40)) for k in range(4)]
    texts = [" ".join([*rng.sample(passages, 2), *(f"o{rng.randrange(10**6)}" for _ in range(45))]) for _ in range(240)]
    texts += near_copies(rng, 4, 80, 1)
    rows, sent, meetings = list(enumerate(texts)), [], jaccard_join._meetings
    monkeypatch.setattr(jaccard_join, "_meetings", lambda sets, first: (m := meetings(sets, first)) is not None and sent.append(m.count()) or m)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(docs_of(spark, rows), 5, 80).collect()), key=repr)
    assert got == brute_components(rows, 5, 80)
    assert sum(sent) <= 3 * len(rows)


def test_linked_sets_share_one_of_their_first_shingles(spark):
    """Whatever the components so far, two sets of different ones that link are both kept and meet under a name."""
    rng = np.random.default_rng(6)
    common = rng.integers(0, 2**62, 12)  # in most sets, so they come last
    sets, percent = [], 80
    for i in range(40):
        base = np.unique(np.concatenate([rng.integers(0, 2**62, int(rng.integers(1, 60))), common]))
        sets += [base, *(np.unique(np.concatenate([base[rng.random(len(base)) > 0.08], rng.integers(0, 2**62, int(rng.integers(0, 4)))])) for _ in range(3))]
    sets = [s for s in sets if len(s)]
    comps = [i - i % 2 if i % 3 else i for i in range(len(sets))]
    lists = [(i, c, len(s), s.tolist(), jaccard_join.thinned(s.astype(np.uint64), percent).astype(np.int64).tolist()) for i, (s, c) in enumerate(zip(sets, comps))]
    df = spark.createDataFrame(lists, "row bigint, comp bigint, size bigint, shingles array<bigint>, thinned array<bigint>").selectExpr("*", "row AS key", "row AS text_hash", "CAST('' AS binary) AS digest")
    undone = {r["row"] for r in jaccard_join._undone(df, percent).collect()}
    first = {r["row"]: set(r["all_names"]) for r in jaccard_join._first_open(df, percent).collect()}
    linked = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            same = len(np.intersect1d(a, b))
            if 100 * same >= percent * (len(a) + len(b) - same):
                assert {i, j} <= undone
                if comps[i] != comps[j]:
                    linked += 1
                    assert first[i] & first[j]
    assert linked > 20 and all(len(x) <= len(sets[i]) * (100 - percent) // 100 + 1 for i, x in first.items())


def test_large_families_meet_by_names(spark, monkeypatch):
    """A chain of names that joins many sets makes no blocks of all its sets; sets of one name still meet."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rows = [(i, i, 10, [i, i + 1]) for i in range(100)]
    blocks = {}
    for r in jaccard_join._meetings(spark.createDataFrame(rows, "row bigint, comp bigint, size bigint, all_names array<bigint>"), False).collect():
        blocks.setdefault(r["block"], set()).add(r["row"])
    assert sum(map(len, blocks.values())) <= 200
    assert all(any({i, i + 1} <= b for b in blocks.values()) for i in range(99))


def test_memory_of_arrow_is_given_back():
    """What Arrow's pool keeps of freed batches goes back too."""
    import subprocess
    import sys
    code = """if True:
        import re, pyarrow as pa
        from tillroll.llm import common
        def held():
            return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
        x = [pa.array([f"w{i} " * 300 for i in range(j, j + 1000)]) for j in range(0, 100_000, 1000)]
        full = held()
        del x
        common.give_back()
        print(full, held())
    """
    full, after = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert full > 150 and after < full / 2


def test_memory_of_earlier_stages_is_given_back():
    """A worker that served another stage starts and ends a pass over rows without what that one freed."""
    import re
    from pathlib import Path

    import pyarrow as pa

    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024

    class Local:
        def mapInArrow(self, run, schema):
            return run(iter([pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["x"])]))

    before = held()
    used = [bytearray(3000) for _ in range(80_000)]
    kept = used[::1000]  # else the end of the heap falls back by itself
    del used
    at_start = []
    out = list(common.arrow_rows(Local(), lambda b: at_start.append(held()) or {"x": b.column("x")}, "x bigint"))
    assert out[0].column("x").to_pylist() == [1, 2] and len(kept) == 80
    assert at_start[0] < before + 100
