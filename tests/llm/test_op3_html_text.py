"""HTML extraction: known pages, the cut against brute force, the query."""

import itertools
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quoteflow.llm.html_text import extract, main_text, op3_html_text, source_side

SF = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="menu-open">
<header><a href=/>Home</a></header><nav><ul><li><a href=x>N</a></li></ul></nav><div class="cookie-notice">We use cookies and more words</div>
<div class=ad>Buy now</div><article><h1>A &amp; B</h1><p>One<b> two</b>  three<br>four<p><b>Five.<br><p>S&eacute;x.</p>
<div class="comments"><p>Nice article, I really liked it.</p></div></article><aside>side</aside><form>f <input> g</form>
<!-- x --><footer>&copy; me</footer>"""


def test_page():
    assert main_text(PAGE) == "A & B\n\nOne two three four\n\nFive.\n\nSéx."
    assert main_text(None) == main_text("") == main_text("<nav><p>x</p></nav>") == ""
    long = "word " * 40
    assert main_text(f"<body><p>{long}</p><p>short one.</p><p>{long}</p><div id=footer>x</div>").count("\n\n") == 2


def test_wrappers_named_like_boilerplate():
    """A word of an enclosing element does not empty the page; parts so named still go."""
    one, two = "first " * 30, "second " * 30
    text = f"Title\n\n{one.strip()}\n\n{two.strip()}"
    inner = f'<h1>Title</h1><p>{one}</p><p>{two}</p><div class="comments"><p>{"nice " * 30}</p></div>'
    ad = f'<div class="ad">{"buy " * 30}</div>'
    for a, z in [('<div class="layout has-sidebar">', "</div>"), ('<section id="no-comments">', "</section>"), ("<form>", "</form>"),
                 ('<form id="login-form"><div role="banner">', "</div></form>"), ('<span class="promo"><div>', "</div></span>")]:
        assert main_text(f"<body>{a}{ad}<article>{inner}</article>{ad}{z}{ad}") == text
        assert main_text(f"<body>{a}<article class=post><div class='entry-header'><h1>Title</h1></div><p>{one}</p><p>{two}</p></article>{z}") == text
        assert main_text(f"<body>{a}<p>{one}</p><p>{two}</p>{z}{ad}") == text[7:]
        assert main_text(f"<article>{a}<p>{one}</p><p>{two}</p>{z}</article>{ad}") == text[7:]
    replies = "".join(f'<li class="comment"><article class="comment-body"><p>{"reply " * 40}</p></article></li>' for _ in range(9))
    assert main_text(f"<body><article>{inner}</article><div id=comments><ol>{replies}</ol></div>") == text
    assert main_text(f"<main><article>{inner}<form><p>{'sign up ' * 9}</p></form></article><div id=comments><ol>{replies}</ol></div></main>") == text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 5)), max_size=14))
def test_cut_is_minimal(raw):
    edges = [(u, v, float(c), 0.0) for u, v, c in raw if u != v]
    side = source_side(7, edges, 0, 6)
    cost = lambda s: sum(c for u, v, c, _ in edges if s[u] and not s[v])
    assert side[0] and not side[6]
    assert cost(side) == min(cost((True, *m, False)) for m in itertools.product([True, False], repeat=5))


def test_query_and_odd_rows(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op3_html_text(spark, SF).collect()
    assert len(rows) == len(html)
    for r in rows:
        import html as h
        inner = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert "".join(r["text"].split()) == "".join("".join(parts).split()) and r["n_chars"] == len(r["text"])
    df = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>" + "x y. " * 300_000)], "page_id long, url string, html string")
    got = extract(df.withColumn("text", F.lit(1))).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 1_499_999]
    assert extract(df.where("false")).count() == 0
    assert main_text("<div>" * 3000 + "deep words " * 30) != ""


def test_broken_markup():
    """Unclosed and malformed markup is no text; what stands before it stays."""
    for tail in ["<!-- open <p>secret", "tail <a href=\"x", "<p class='x", "</p", "<!doctype", "<?php echo 1", "<![foo]>", "<![CDATA[x",
                 "<script>var a = 1 < 2; <p>secret"]:
        text = main_text(f"<article><p>{'words ' * 30}</p>{tail}")
        assert text.startswith("words words") and not any(x in text for x in ("<", "secret", "href", "CDATA", "php"))
    assert main_text(f"<article><p>{'a ' * 30}</p><![if IE]><p>{'b ' * 30}</p></article>").count("\n\n") == 1
    sub = f"<article><p>{'a ' * 30}</p><div class='subscription-box'><p>Get it by mail</p></div></article>"
    assert main_text(sub) == ("a " * 30).strip()


def test_linear_time():
    """Shapes that a scan of the stack, or a second look at open comments, makes quadratic."""
    began = time.process_time()
    main_text("<article><p>x</p>" + "<!--" * 50_000)
    main_text("<div>" * 12_000 + "</section>" * 12_000 + "words")
    main_text("<i><div>" + "<b>" * 12_000 + "</i>" * 12_000 + "words" + "x<hr>" * 12_000)
    assert time.process_time() - began < 10


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + "one two. " * 20)] * 3, "page_id long, url string, html string")
    got = extract(df).collect()
    assert len(got) == 3 and len(set(got)) == 1
