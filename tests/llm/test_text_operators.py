"""SentencePiece, personal data, URL filter, HTML text, secrets: brute force and defined cases."""

import hashlib
import random
import re

import pytest

from trialframe.llm import op1_sentencepiece as sp
from trialframe.llm import op2_pii as pii
from trialframe.llm import op5_url_filter as url
from trialframe.llm import op6_html_text as page
from trialframe.llm import op10_secrets as sec

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
TEXTS = [None, "", " ", "  two  spaces ", "a", "line\nbreak\n\n", "▁mark▁ x", "é漢😀\x80", "<s></s><unk><0x41>",
         "the " * 5000, "x" * 30_000, "The same row", "The same row"]


@pytest.fixture(scope="module")
def model():
    return sp.Pieces(sp.default_model())


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")


# --- SentencePiece

def test_agenda_equals_library(model):
    rng = random.Random(4)
    alphabet = ["a", "b", "e", " ", "▁", "\n", "\t", "<s>", "é", "漢", "😀", "\x00", "the", "ing", "1", "2.", ",", "'s", "\\"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice("theinganedr") for _ in range(rng.randrange(50, 2000))) for _ in range(40)]
    for t in texts:
        ids = model.encode(t)
        assert ids == model.lib.encode(t, add_eos=True)
        assert model.decode(ids) == model.lib.decode(ids)
    model.check_fresh()


def test_short_and_long_agenda_agree(model):
    rng = random.Random(5)
    for _ in range(500):
        s = "▁" + "".join(rng.choice("theinganedré▁") for _ in range(rng.randrange(1, 40)))
        assert model.merge_short(s) == model.merge_long(s)


def test_check_finds_a_wrong_segment(model):
    model.fresh.append(("▁the", [5]))
    with pytest.raises(ValueError):
        model.check_fresh()
    model.fresh.clear()


@pytest.mark.parametrize("check", ["segments", "texts"])
def test_encode_texts_cases(spark, model, check):
    df = docs(spark, TEXTS).withColumnRenamed("source", "n_tokens")
    got = {r["doc_id"]: r for r in sp.encode_texts(df, "doc_id", "text", sp.default_model(), with_ids=True, check=check).collect()}
    for i, t in enumerate(TEXTS):
        ids = model.lib.encode(t or "", add_eos=True)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == SHA(" ".join(map(str, ids)))
        assert got[i]["decoded_sha256"] == SHA(model.lib.decode(ids)) and got[i]["decoded"] == model.lib.decode(ids)


def test_encode_empty_table(spark):
    assert sp.encode_texts(docs(spark, []), "doc_id", "text", sp.default_model()).count() == 0


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute_pii(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base_equals_brute_force():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1.2@+- ()3.4%05.@9é") for _ in range(70)) for _ in range(8000)]
    texts += ["4263 9826 4026 9299 and 0000000000000", "999.1.1.1.1", "a@b.c@d.e", "+1 (068) 555-7713", "1.2.3.4.5.6.7.8"]
    for t in texts:
        assert sorted(pii.find_base(t)) == brute_pii(t)


def test_pii_long_runs_are_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "@" * 200_000, "(" * 200_000):
        pii.proposals(t, pii.find_base(t))


def test_pii_query_shape(spark):
    t = "Mail ab@mail.com or x (at) mail (dot) com, call (212) 555-1234. 10.0.0.1 Mr. John Smith 4263982640269299"
    rows = [(0, t), (1, None), (2, ""), (3, t), (3, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kind", "2 AS found")
    got = sorted(pii.digest(pii.find_personal(df, "doc_id", "text"), "doc_id").collect())
    assert [r["doc_id"] for r in got] == [0, 1, 2, 3, 3]
    want = sorted(brute_pii(t), key=lambda x: (x[1], pii.KINDS.index(x[0])))
    assert got[0]["base_sha256"] == SHA(",".join(f"{k}:{s}:{e}" for k, s, e in want))
    spans = got[0]["spans"].split(",")
    assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(spans) and got[0]["n_email"] == 1 and got[0]["n_card"] == 1
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == SHA("") and got[3]["spans"] == got[0]["spans"]
    empty = pii.digest(pii.find_personal(df.limit(0), "doc_id", "text"), "doc_id")
    assert empty.count() == 0


def test_em_finds_reliable_labelers():
    import numpy as np
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    vote = lambda right: np.where(rng.random(4000) < right, np.where(truth, 1, -1), np.where(truth, -1, 1))
    votes = np.stack([vote(0.95), vote(0.9), vote(0.55)], 1)
    post, prior, rel = pii.em(votes, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.9 and abs(prior - 0.4) < 0.06
    assert rel[0, 1, 2] > 0.85 > 0.7 > rel[2, 1, 2]


# --- URL filter

def test_url_cases(spark):
    urls = ["https://www.Example.COM/en/1?x=/de/#a", "http://a.example.com/en/9", "http://x.net/es/4", "http://net/fr/",
            "http://casino-win.org/p", "http://a.org/free-bets", "http://a.org/free", "http://freebets.org/", None, "",
            "no scheme/en", "ftp://", "http://xcasinox.org", "http://com", "HTTP://A.com/", "http://h/%41://b", "x" * 50_000,
            "https://a.org/betting", "https://news.org/gambling-law", "https://a.org/lottery/lottery", "https://a.org/lottery-win"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url.judge_urls(df, "page_id", "url").collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/9", "example.com/en/", "block")
    assert got[2][2:] == ("net/es/", "block") and got[3][2:] == ("net/fr/", "block")
    assert got[4][2:] == (None, "block") and got[5][2:] == (None, "block")
    assert got[6][2:] == (None, "allow") and got[7][2:] == (None, "allow") and got[12][2:] == (None, "allow")
    assert {got[i][3] for i in (17, 18, 19)} == {"allow"} and got[20][3] == "block"      # one soft term, two of them
    assert got[8] == got[9] == got[10] == ("", "", None, "allow") and got[13] == ("com", "", None, "allow")
    assert got[14] == ("a.com", "/", "com/", "allow")
    assert len(got) == len(urls) and url.judge_urls(df.limit(0), "page_id", "url").count() == 0


def test_terms_equal_plain_search():
    rng = random.Random(3)
    terms = url.Terms(url.STRICT, url.SOFT)
    for _ in range(3000):
        t = "".join(rng.choice(["free", "bets", "casino", "-", ".", "/", "x", "é", "AD", "ads"]) for _ in range(8))
        low = t.translate(url.LOWER)
        want = {w for w in {*url.STRICT, *url.SOFT} if re.search(f"(^|[^a-z0-9]){w}([^a-z0-9]|$)", low)}
        assert terms.found(t) == want


# --- HTML

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="cookie-notice">We use cookies on this site.</div><div class="ad">Buy now cheap.</div>
<article><h1>Title &amp; more</h1><p>First  paragraph <b>bold</b> and<br>more.<p>Short.</p>
<form><input value="x">Search here</form><div class="comments"><p>A reader wrote a very long comment on this article.</p></div>
<ul><li>one</li><li>two</li></ul><p>Last &#233;.</p></article><aside>Related things</aside><footer>&copy; site</footer></body></html>"""


def test_html_main_text():
    want = "Title & more\nFirst paragraph bold and more.\nShort.\none\ntwo\nLast é."
    assert page.extract(ARTICLE, {}) == want
    assert page.extract(ARTICLE.replace("article>", "div>"), {"a": 2.0, "p": 0.05, "/p": 0.05}) == want


def test_names_do_not_hide_the_article():
    text = "<div class='layout with-sidebar'><article class='post'><div class='article-header'><h1>A title</h1></div>" \
           "<p>Body of the text.</p><div class='post-comments'><article class='comment'><p>Mine.</p></article></div></article>" \
           "<div class='page-header'>Top</div><div style='display: none'>gone</div><div id=cookie-bar>Cookies</div></div>"
    assert page.extract(text, {}) == "A title\nBody of the text."


def test_html_long_broken_pages():
    """End tags without an element, deep nesting and many open elements take linear time."""
    import time
    n = 1 << 20
    for broken in ("<div>" * (n // 10) + "x</q>" * (n // 10), "<div>word " * (n // 10), "<header>x " * (n // 10),
                   "<b>" * (n // 6) + "</i>" * (n // 8)):
        t0 = time.process_time()
        page.label(broken)
        page.extract(broken, {})
        assert time.process_time() - t0 < 10          # a walk of the stack for each tag took over an hour
    deep = "<div>" * 1000 + "<article><p>one two</q></p></article>" + "</div>" * 1000
    assert page.extract(deep, {}) == "one two"


def test_html_cases(spark):
    pages = [None, "", "plain words only", "<p>unclosed <b>bold<p>next", "<div>cut off <a href='", "<script>only", "< 3 > 2",
             "<p>" + "word " * 40_000 + "</p>", ARTICLE, ARTICLE]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    df = df.selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in page.extract_pages(df, "page_id", "url", "html").collect()}
    assert got[0] == got[1] == got[5] == ("", 0) and got[2][0] == "plain words only"
    assert got[3][0] == "unclosed bold\nnext" and got[4][0] == "cut off" and got[6][0] == "< 3 > 2"
    assert got[7][0] == ("word " * 40_000).strip() and got[8] == got[9]
    assert all(n == len(t) for t, n in got.values())
    assert page.extract_pages(df.limit(0), "page_id", "url", "html").count() == 0


def test_best_run_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        words, seq, cost = [], [], {"x": 2.5, "y": 0.5}
        for _ in range(rng.randrange(1, 14)):
            if rng.random() < 0.5:
                seq.append(("", len(words)))
                words.append(rng.randrange(0, 4))
            else:
                seq.append((rng.choice("xy"), 0))
        value = [-cost[n] if n else words[i] for n, i in seq]
        best = max([sum(value[a:b]) for a in range(len(seq)) for b in range(a + 1, len(seq) + 1)], default=0)
        top = page.best_run(seq, words, cost)
        if not any(words):
            assert top is None
        else:
            at = {i: k for k, (n, i) in enumerate(seq) if not n}
            assert sum(value[at[top[0]]:at[top[1]] + 1]) == pytest.approx(best)


# --- secrets

def brute_secrets(t):
    a = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [("assign", *m.span()) for m in a.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_base_equals_brute_force():
    rng = random.Random(6)
    parts = ["token", "Api_KEY", "PASSWORD", "=", " ", ":", '"', "ab12", "AKIA", "Q7QQQQ", "deadbeef01", "é", "x", ".", "ſecret"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(25))
        assert sorted(x[:3] for x in sec.find_base(t)) == brute_secrets(t)


def test_secret_ownership(spark):
    live, shared = "9f86d081884c7d659a2feaa0c55ad015", "5e884898da28047151d0e56f8dc62927"
    rows = [(0, f"token = '{live}'", "a"), (1, f"token: {shared}", "a"), (2, f"see {shared}", "b"), (3, f"x {shared}", "c"),
            (4, None, "a"), (5, "", None), (6, "password = hunter22", None), (7, f"token = '{live}'", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS row_id", "2 AS hash", "3 AS owner")
    got = {r["doc_id"]: r for r in sec.digest(sec.find_secrets(df, "doc_id", "text", "source", "doc_id"), "doc_id").collect()}
    assert len(got) == 8 and "live:" in got[0]["spans"] and got[7]["n_live"] == 1
    assert all(got[i]["n_live"] == 0 and got[i]["n_example"] == 1 for i in (1, 2, 3))
    for i, t, _ in rows:
        base = sorted(brute_secrets(t or ""), key=lambda x: (x[1], sec.KINDS.index(x[0])))
        assert got[i]["base_sha256"] == SHA(",".join(f"{k}:{s}:{e}" for k, s, e in base))
    assert sec.digest(sec.find_secrets(df.limit(0), "doc_id", "text", "source", "doc_id"), "doc_id").count() == 0
    clean = {r["doc_id"]: r["text"] for r in sec.masked(df, "text", "source", "doc_id").collect()}
    assert clean[0] == "[SECRET]'" and shared in clean[1] and clean[4] is None and clean[6] == "[SECRET]" and len(clean) == 8


def test_many_repositories_of_one_owner_are_no_example(spark):
    copied, own = "5e884898da28047151d0e56f8dc62927", "9f86d081884c7d659a2feaa0c55ad015"
    rows = [(i, f"token: {copied}", "ab"[i % 2]) for i in range(sec.EXAMPLE_REPOS)]              # two owners
    rows += [(100 + i, f"x {own}", "a") for i in range(3 * sec.EXAMPLE_REPOS)] + [(100, f"x {own}", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sec.find_secrets(df, "doc_id", "text", "source", "doc_id").collect()
    assert all((len(r["live"]), len(r["example"])) == ((1, 0) if r["doc_id"] >= 100 else (0, 1)) for r in got)
    clean = sec.masked(df, "text", "source", "doc_id").collect()
    assert all((copied in r["text"]) == (r["doc_id"] < 100) and own not in r["text"] for r in clean) and len(clean) == len(rows)


def test_query_checks_whole_texts(monkeypatch):
    asked = {}
    monkeypatch.setattr(sp, "encode_texts", lambda *a, **kw: asked.update(kw))
    monkeypatch.setattr(sp, "table", lambda *a: None)
    sp.op1_sentencepiece(None, "")
    assert asked["check"] == "texts"
