"""op3, op4, op5, op7."""

import itertools
import math
import random

import numpy as np
import pytest
from llm_helpers import SF, documents, query, table_dir, words
from pyspark.sql import functions as F

from residuum.llm import html_extract, sentencepiece, topk_search, url_filter
from residuum.llm.queries import URL_RULES, tokenizer_path


# ------------------------------------------------------------- sentencepiece


TEXTS = [None, "", " ", "a", "  a", "a  b   c", " lead", "trail ", "x\u2581y", "中文 日本語", "emoji 😀 z", "tab\tnew\nline\r\n",
         "a" * 300, "ab" * 200 + " é" * 90, "%%% 12345 a1b2", "\x00nul", "　wide", "<s> </s> <0x0A>", "   ", "b" * 61]


@pytest.mark.parametrize("block", [1 << 25, 2000])
def test_encoding_equals_the_library(spark, monkeypatch, block):
    import sentencepiece as library
    monkeypatch.setattr(sentencepiece, "BLOCK_BYTES", block)
    rng = random.Random(1)
    texts = TEXTS + [words(rng, 300, "abcdefghijklmnopqrstuvwxyzéü.,", 12) for _ in range(6)]
    path = tokenizer_path("piece_bpe_32k.model")
    sp, vocab = library.SentencePieceProcessor(model_file=path), sentencepiece.Vocabulary.read(path)
    docs = documents(spark, list(enumerate(texts)) + [(None, "no id"), (3, "a")]).withColumn("ids", F.lit("clash"))
    got = sentencepiece.encode(docs.drop("ids"), vocab, round_trip=True) \
        .withColumn("back", sentencepiece.decode(F.col("ids"), vocab, spark)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = "no id" if r.doc_id is None else texts[r.doc_id]
        assert r.ids == (None if t is None else sp.encode(t)), repr(t and t[:40])
        assert r.round_trip and r.back == (None if t is None else t.replace("\u2581", " "))


def test_round_trip_of_the_query_is_decoding_to_the_text(spark, tmp_path):
    vocab = sentencepiece.Vocabulary.read(tokenizer_path("piece_bpe_32k.model"))
    docs = documents(spark, TEXTS + ["\u2581", "a \u2581 b", "plain"])
    out = query("op3")(spark, table_dir(tmp_path, documents=docs))
    got = {r.doc_id: r for r in out.withColumn("back", sentencepiece.decode(F.col("ids"), vocab, spark)).collect()}
    assert len(got) == len(TEXTS) + 3
    for r in docs.collect():
        assert got[r.doc_id].round_trip == (got[r.doc_id].back == r.text), repr(r.text)


def test_long_units_fold_like_short_ones(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    vocab = sentencepiece.Vocabulary.read(path)
    rng = random.Random(2)
    units = list({words(rng, 1, "abcdeinorst", 40) for _ in range(50)} | {"\u2581" * 9, "\u2581\u2581é中"})
    got = sentencepiece.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), vocab).collect()
    assert {r.unit: r.ids for r in got} == {u: vocab.fold(u) for u in units}


def test_viterbi_fold_is_the_best_path(spark):
    """A small hand-made unigram model against all segmentations."""
    pieces = {"a": -1.0, "b": -1.5, "c": -2.1, "ab": -1.2, "bc": -1.9, "abc": -3.05, "ca": -0.7, "bca": -1.1}
    table = [(f"<0x{i:02X}>", 0.0, sentencepiece.BYTE) for i in range(256)]
    table += [(p, s, sentencepiece.NORMAL) for p, s in pieces.items()]
    vocab = sentencepiece.Vocabulary(table, sentencepiece.UNIGRAM)
    units = ["".join(u) for n in range(1, 6) for u in itertools.product("abcx", repeat=n)]
    got = {r.unit: r.ids for r in sentencepiece.encode_units(
        spark.createDataFrame([(u,) for u in units], "unit string"), vocab).collect()}

    def score(cut, unit):
        total = 0.0
        for a, z in zip(cut, cut[1:]):
            total += pieces.get(unit[a:z], vocab.worst if z == a + 1 else -math.inf)
        return total
    ids = {p: i for i, (p, _, _) in enumerate(table)}
    for u in units:
        cuts = [(0, *c, len(u)) for n in range(len(u)) for c in itertools.combinations(range(1, len(u)), n)]
        best = max(score(c, u) for c in cuts)
        found = "".join(table[i][0] if table[i][2] == sentencepiece.NORMAL else "x" for i in got[u])
        assert found == u
        lengths = [len(table[i][0]) if table[i][2] == sentencepiece.NORMAL else 1 for i in got[u]]
        assert score(tuple(np.cumsum([0] + lengths)), u) == pytest.approx(best)
        assert vocab.fold(u) == got[u] or score(tuple(np.cumsum([0] + [1 if i < 256 else len(table[i][0]) for i in vocab.fold(u)])), u) == pytest.approx(best)
    assert ids["ab"] in got["ab"]


# --------------------------------------------------------------- url filters


def brute_verdict(host, path):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


def test_url_rules(spark, tmp_path):
    urls = [None, "", "no scheme", "http://a.example.com/en/1", "http://WWW.Example.COM/en/x?q#f", "http://www.example.com/en",
            "https://example.net/es/1", "http://net/fr/", "http://notnet/fr/", "http://a.com", "http://a.com/", "http://a.com?x=/en/",
            "x://y://z.com/", "http://example.com:80/en/", "http://com/", "http:///en/", "http://É.com/é", "a\nb://c.com/\n/d"]
    pages = spark.createDataFrame([(i, u, "x", "clash") for i, u in enumerate(urls)] + [(3, urls[3], None, None)],
                                  "page_id long, url string, html string, host string")
    got = query("op4")(spark, table_dir(tmp_path, pages=pages)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        rest = (urls[r.page_id] or "").split("://", 1)
        rest = rest[1] if len(rest) == 2 else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host):]
        for c in "?#":
            path = path.split(c)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == brute_verdict(host, path), urls[r.page_id]


def test_trie_precedence():
    t = url_filter.Trie([("allow", "a.b", "/x"), ("block", "b", "/xyz/"), ("block", "a.b", "/x"), ("allow", "b", "")])
    assert t.match("q.a.b", "/x/1") == ("a.b/x", "block")
    assert t.match("a.b", "/xyz/1") == ("b/xyz/", "block")
    assert t.match("b", "/") == ("b", "allow") and t.match("c", "/") == (None, None) and t.match("", "/") == (None, None)


# --------------------------------------------------------------- exact top-k


def test_segments_hold_every_posting_once():
    rng = np.random.default_rng(1)
    index = topk_search.ImpactIndex(rng.integers(-50, 50, (300, 5)))
    seen = sorted((int(r), int(index.dim[s])) for s in index.used for r in index.rows[index.start[s]:index.start[s] + index.size[s]])
    assert seen == [(r, d) for r in range(300) for d in range(5)]


@pytest.mark.parametrize("scale", [1, 1 << 40])
def test_skewed_blocks_are_answered_from_few_postings(scale):
    """A few dimensions carry most of a score: reading stops on proof, and nothing is lost."""
    rng = np.random.default_rng(5)
    weight = np.concatenate([np.full(3, 100.0), np.full(61, 0.5)])
    x = np.floor(1024 * rng.normal(size=(4096, 64)) * weight) * scale
    index, shares = topk_search.ImpactIndex(x), []
    for _ in range(20):
        q = np.floor(1024 * rng.normal(size=64) * weight)
        rows, read = index.possible(q, 10, -np.inf, np.arange(4096))
        exact = [sum(int(a) * int(b) for a, b in zip(q, v)) for v in x]
        best = sorted(range(4096), key=lambda r: (-exact[r], r))[:10]
        assert set(best) <= set(rows.tolist())
        shares.append(read / x.size)
    assert np.mean(shares) < 0.5 and max(shares) < 0.8


def test_floor_and_small_blocks_need_no_postings():
    x = np.arange(40.0).reshape(20, 2)
    index = topk_search.ImpactIndex(x)
    assert index.possible(np.ones(2), 10, -np.inf, np.arange(20))[1] == 0
    wide = topk_search.ImpactIndex(np.arange(2000.0).reshape(1000, 2))
    rows, read = wide.possible(np.ones(2), 10, 3900.0, np.arange(1000))
    assert set(range(990, 1000)) <= set(rows.tolist()) and read < 2000


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 60 * 64)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK_BYTES", 2 * 64)
    rng = np.random.default_rng(3)
    vecs = [rng.normal(size=8).round(1).tolist() for _ in range(320)]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(5, vecs[5]), (7, vecs[8]), (400, None), (401, [1.0, None] * 4),
                                                  (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (None, vecs[0]),
                                                  (500, [0.5, 0.25]), (501, [1.0, 1.0]), (600, [1e6] * 8), (601, [1e6] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.topk(df, F.col("vec_id") % 100 == 0).collect())
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    exp = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        qv = min(v for i, v in ok if i == q)
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))[:10]
        exp += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(exp)


def test_topk_proof_keeps_every_member():
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, size=(2000, 12))
    index = topk_search.ImpactIndex(x)
    for q in rng.integers(-500, 500, size=(20, 12)).astype(float):
        rows, _ = index.possible(q, 10, -np.inf, np.arange(2000))
        best = np.argsort(-(x @ q), kind="stable")[:10]
        assert set(best.tolist()) <= set(rows.tolist()) and len(rows) < 1000


# ----------------------------------------------------------------- HTML


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><header><a href="/">Home</a> Site name</header><nav><ul><li><a href="#">One</a></li></ul></nav>
<div class="cookie-notice">We use cookies and other things to make this site work for everyone.</div>
<article><h1>Title &mdash; here</h1><p><b>First   paragraph of
 the text</b> goes on,&nbsp;long enough to be told from the rest of the page.<br>Same block.<p>Short.</p>
<p>Another a &lt; b paragraph with <a href="x">a link</a> inside.</p><div class="ad">Buy now, a long advert text, really.</div>
<!-- hidden --><form><p>Your mail</p><input></form></article>
<aside><p>Side bar text that is fairly long, too, as these go.</p></aside>
<section id="comments"><article class="comment"><p>A reader's comment that is long enough to look like text.</p></article></section>
<footer>&copy; all rights</footer></body></html>"""


def test_main_text():
    tree = html_extract.trained()
    got = [b.text for b in html_extract.main_blocks(PAGE, tree)]
    assert got == ["Title — here", "First paragraph of the text goes on, long enough to be told from the rest of the page. Same block.",
                   "Short.", "Another a < b paragraph with a link inside."]


ARTICLE = "<h1>A title</h1><p>" + "first " * 40 + "</p><p>Short.</p><p>" + "second " * 30 + "</p>"
ARTICLE_TEXTS = ["A title", ("first " * 40).strip(), "Short.", ("second " * 30).strip()]


def main_texts(page):
    return [b.text for b in html_extract.main_blocks(page, html_extract.trained())]


@pytest.mark.parametrize("names", ["overflow-hidden", "content-sidebar-wrap", "has-sidebar", "has-left-sidebar", "page-with-toc",
                                   "no-comments", "md:overflow-x-hidden flex"])
def test_plain_names_that_mention_furniture(names):
    for inner in (ARTICLE, f"<div>{ARTICLE}</div>", f"<article>{ARTICLE}</article>", f"<div role=main>{ARTICLE}</div>"):
        page = f"<body><header>Site name</header><div class='{names}'>{inner}<div class=ad>Buy {'now ' * 30}</div></div>" \
               "<footer>Rights</footer></body>"
        assert main_texts(page) == ARTICLE_TEXTS


@pytest.mark.parametrize("names", ["sidebar-right", "menu-open", "nav", "widget"])
def test_articles_in_wrappers_with_furniture_names(names):
    teaser = f"<div class='sidebar'><article><p>{'teaser ' * 25}</p></article></div>"
    comments = f"<div id='comments'><article><p>{'comment ' * 99}</p></article></div>"
    for inner in (f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>", f"<div role='main'>{ARTICLE}</div>"):
        page = f"<body><div class='{names}'><p>{'aside ' * 20}</p>{inner}{comments}</div></body>"
        assert main_texts(page) == ARTICLE_TEXTS
    assert main_texts(f"<body><article class='post tag-social'>{ARTICLE}</article></body>") == ARTICLE_TEXTS
    assert main_texts(f"<body><article>{ARTICLE}</article>{teaser}{comments}</body>") == ARTICLE_TEXTS


def test_head_without_an_end_tag():
    head = "<html><head><meta charset=utf-8>\n<title>T</title><noscript><img src=x><p>No script</p></noscript><style>p{}</style>"
    for rest in (f"<article>{ARTICLE}</article>", f"</head><article>{ARTICLE}</article>", f"<body><article>{ARTICLE}</article>",
                 f"<img src=y><article>{ARTICLE}</article>"):
        assert main_texts(head + rest) == ARTICLE_TEXTS
    assert main_texts("<head><title>T</title>" + ARTICLE) == ARTICLE_TEXTS
    assert main_texts("<head><title>T</title>" + "plain " * 40) == [("plain " * 40).strip()]
    assert main_texts(head) == []


SEVENTY = " ".join(f"w{i}" for i in range(70))


@pytest.mark.parametrize("page", [
    f"<body><nav><a href=/>Home</a></nav><div style='overflow: hidden'><p>{SEVENTY}</p></div></body>",
    f"<body><article data-title='Hidden gems'><p>{SEVENTY}</p></article><footer>f</footer></body>",
    f"<body><article data-id='comment-7'><p>{SEVENTY}</p></article></body>",
    f"<body><article title='class = related'><p>{SEVENTY}</p></article></body>",
    f"<body><p title='the hidden truth'>{SEVENTY}</p></body>",
    f"<body><p data-x=it's>{SEVENTY}</p></body>",
    f"<body><form id='aspnetForm'><div><a href=/>Home</a></div><article><p>{SEVENTY}</p></article></form><footer>f</footer></body>",
    f"<body><form id=aspnetForm><div id=menu><a href=/>Home</a></div><div><p>{SEVENTY}</p></div></form><footer>f</footer></body>",
    f"<body><article class=a class=hidden><p>{SEVENTY}</p></article></body>",
    f"<body><article><p>{SEVENTY}</p></article><form><p>Your name please</p><input value='a>b'></form></body>",
    f"<body><article><p>{SEVENTY}</p></article><script>if (a<b) x='</div>';</script></body>",
    f"<title>a <p> b</title><body><article><p>{SEVENTY}</p></article><p open 'tag",
    f"<body><main><!-- > --><!--><p>{SEVENTY}</p></main></body>",
    f"<body><article><P\nCLASS = 'x'\n>{SEVENTY}</P ></article><div HIDDEN>{SEVENTY}</div><div aria-hidden='true'>x</div></body>",
])
def test_attributes_do_not_hide_articles(page):
    from residuum.llm import html_extract
    assert "\n\n".join(b.text for b in html_extract.main_blocks(page, html_extract.trained())) == SEVENTY


@pytest.mark.parametrize("piece", ["<a b ", "<p x='", '<p x="', "<script>", "<!--", "<!", "</", "<a" + " " * 50, "<title>", "<a =", "<<", "&", "<div class='a'>"])
def test_pages_of_unclosed_pieces_take_linear_time(piece):
    import time
    from residuum.llm import html_extract
    tree = html_extract.trained()
    t = time.time()
    html_extract.main_blocks(piece * (1_000_000 // len(piece)), tree)
    assert time.time() - t < 4


def test_tree_splits_on_neighbours():
    from residuum.llm import html_blocks, html_extract
    used = {html_blocks.FEATURES[n[0]] for n in html_extract.trained().nodes if n[0] is not None}
    assert used >= {"words", "link_density", "furniture"} and used & {"words_before", "words_after"}


def test_html_query(spark, tmp_path):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<script>x"), (1, "u", PAGE),
             (6, "u", "<article>" + "<p>" + "word " * 200_000 + "</p></article>"), (None, None, "<!-- open")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = query("op7")(spark, table_dir(tmp_path, pages=df)).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[2] == by_id[3] == by_id[5] == by_id[None] == "" and by_id[6] == ("word " * 200_000).strip()


def test_articles_of_the_test_pages(spark):
    import html
    import re
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in query("op7")(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p)
