"""Main text and secrets against plain readings of the same texts."""

import hashlib
import html
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskflow.llm.html_extraction import cluster_threshold, extract_main_text, main_text, smoothed
from riskflow.llm.queries import QUERIES
from riskflow.llm.secret_scan import BASE62, base62_checksum, find_secrets, joined, scan_secrets, secret_digests


def plain_article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", block)).split()) for block in blocks]
    return "\n".join(text for text in texts if text)


def test_all_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op2_html_extraction"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for row in rows:
        assert row["text"] == plain_article(pages[row["page_id"]])
        assert row["n_chars"] == len(row["text"])


ARTICLE = "A long sentence about a subject that goes on for a while, so that it is text. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a></nav>", ""),
        (f"<div class='sidebar'><p>Side story</p></div><article><p>{ARTICLE}</p></article>", ARTICLE.strip()),
        (f"<article><h1>T</h1><p>{ARTICLE}</p><p>Be.</p><aside>no</aside><form>n<input></form></article>", f"T\n{ARTICLE.strip()}\nBe."),
        (f"<main><p>{ARTICLE}</p></main><div class='comments'><article><p>{ARTICLE}</p></article></div>", ARTICLE.strip()),
        (f"<nav><ul><li>open<article><p>{ARTICLE}</p></article>", ARTICLE.strip()),
        (f"<article><div class='cookie-notice'>c</div><p>a &lt;b&gt;&#33; &copy;\n\t x</p><script>var t='</p>'</script><p>{ARTICLE}", f"a <b>! © x\n{ARTICLE.strip()}"),
        (f"<ul class=menu><li><a>x</a><li><a>y</a></ul><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><div><a>q</a><a>r</a></div>", f"{ARTICLE.strip()}\n{ARTICLE.strip()}"),
    ],
)
def test_page_shapes(page, text):
    assert main_text(page) == text


LONG = "Plain words of a paragraph that has something to say and takes its time to say it. " * 2
P = f"<p>{LONG}</p>"
TEXT = LONG.strip()
LINKS = "<a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # Menus and adverts without a name of their own.
        (f"<div>{LINKS}</div><div>{P}{P}</div>", f"{TEXT}\n{TEXT}"),
        (f"<div>{P}</div><ul><li><a>One</a></li><li><a>Two</a></li></ul>", TEXT),
        (f"<article>{P}<div>{LINKS}</div>{P}</article>", f"{TEXT}\n{TEXT}"),
        (f"<article>{P}<ul><li><a>One</a><li><a>Two</a></ul></article>", TEXT),
        (f"<div>{LINKS} {LINKS}</div><div>{P}</div><div><a>Terms</a><a>Privacy</a></div>", TEXT),
        (f"<table><tr><td><a>One</a><td><a>Two</a></table><div>{P}</div>", TEXT),
        (f"<div>{P}{P}</div><div>Sale <b>now</b> <i>on</i> <b>!</b> <a>buy</a></div>", f"{TEXT}\n{TEXT}"),
        # Links in a text are text.
        (f"<article><p>See <a>this</a> and <a>that</a>.</p>{P}</article>", f"See this and that.\n{TEXT}"),
        (f"<article><h2><a>Title</a></h2>{P}</article>", f"Title\n{TEXT}"),
        (f"<article>{P}<ul><li><a>One</a> is a start</li><li><a>Two</a></li></ul></article>", f"{TEXT}\nOne is a start\nTwo"),
        ("<article><p><a>only</a> <a>links</a></p></article>", "only links"),
        # Names are hints: they do not make a page empty, and mean less on a paragraph.
        ("<article><p class='social'>Text</p></article>", "Text"),
        (f"<article><div class='social science'>{P}</div></article>", TEXT),
        (f"<div id='main-menu-wrapper'>{P}</div>", TEXT),
        (f"<article><p class='menu side'>Soup</p>{P}</article>", f"Soup\n{TEXT}"),
        (f"<article><p class='ad'>Buy</p>{P}</article>", TEXT),
        (f"<article><h2 class='search'>Looking for it</h2>{P}</article>", f"Looking for it\n{TEXT}"),
        (f"<article><div class='related'>{P}</div><p>Short.</p></article>", "Short."),
        (f"<div class='sidebar'>{P}{P}</div><div><p>Mine.</p></div>", "Mine."),
        (f"<article><div class=comments>{P}</div></article>", ""),
        (f"<div class='headline shared'>{P}</div>", TEXT),
        # What stands inside a block does not end it.
        ("<p>Hello <script>x()</script>world</p>", "Hello world"),
        ("<article><p>Hello <button>Buy</button> world</p></article>", "Hello world"),
        ("<article><p>a<style>p{}</style>b <svg><text>c</text></svg>d</p></article>", "ab d"),
        ("<article><p>one<br>two</p><p>three<hr>four</p></article>", "one\ntwo\nthree\nfour"),
        ("<article><p>x <select><option>1<option>2</select> y</p></article>", "x y"),
        # Tags and roles say what a part is.
        (f"<div role=navigation>{P}</div><div role=main>{P}<footer>f</footer></div>", TEXT),
        (f"<header>{P}</header><div>{P}</div><footer>{P}{P}</footer>", TEXT),
        (f"<article><header><h1>T</h1></header>{P}</article>", f"T\n{TEXT}"),
        (f"<div hidden>{P}</div><div aria-hidden=true>{P}</div><div>{P}</div>", TEXT),
        (f"<div class=menu><article>{P}</article></div>", TEXT),
        (f"<p>{LONG}", TEXT),
        ("no markup at all", "no markup at all"),
    ],
)
def test_hand_made_pages(page, text):
    assert main_text(page) == text


def test_very_long_page_and_tie_of_ratios():
    body = "".join(f"<p>word{i} and more words in this line</p>" for i in range(20_000))
    assert main_text(f"<article>{body}</article>").count("\n") == 19_999
    assert cluster_threshold([3.0, 3.0, 3.0]) == 3.0
    assert smoothed([2.0] * 5) == pytest.approx([2.0] * 5)


def test_page_columns_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "other", 7)], "page_id long, url string, html string, text string, n_chars long")
    assert extract_main_text(pages).collect() == [(1, "u", "x", 1)]
    assert extract_main_text(pages.limit(0)).count() == 0


ASSIGN = re.compile(r"""(?:(?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


PARTS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcdef12", "AKIA", "ABCDEFGH23", "0123456789abcdef", "K", "ſ", "İ", "é", "x\n", "token=token:abcdef"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_base_spans(text):
    base = [span for span in find_secrets(text) if span[0] in ("assign", "access", "hex")]
    assert base == plain_secrets(text)


def test_checksummed_tokens():
    body = "".join(random.Random(3).choices(BASE62, k=30))
    good = f"ghp_{body}{base62_checksum(body)}"
    bad = good[:-1] + ("a" if good[-1] != "a" else "b")
    assert ("github", 2, 42) in find_secrets(f"x {good} y")
    assert not [s for s in find_secrets(f"x {bad} y") if s[0] == "github"]
    assert ("npm", 0, 40) in find_secrets(f"npm_{body}{base62_checksum(body)}")


def test_secret_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op5_secret_scan"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        base = plain_secrets(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [row[f"n_{kind}"] for kind in ("assign", "access", "hex")] == [
            sum(span[0] == kind for span in base) for kind in ("assign", "access", "hex")
        ]


def test_secret_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (None, "token: abcdef", "b"), (2, "", "c"), (2, "x" * 300_000 + "0" * 30, "d"), (2, "", "c")],
        "doc_id long, text string, spans string",
    )
    found = {(r["doc_id"], r["spans"]) for r in secret_digests(scan_secrets(docs)).collect()}
    assert found == {(1, ""), (None, "assign:0:13"), (2, ""), (2, "hex:300000:300030")}
    assert scan_secrets(docs).count() == 5
    assert scan_secrets(docs.limit(0)).count() == 0
