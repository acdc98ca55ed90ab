from glenfare.llm import html_text as H
from helpers import SF, as_rows

PROSE = "The main point of this text is that it has the words that the people of the town use."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a<b) x="</p>";</script></head><body class="home">
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use the cookies of this site and the other sites that you visit for the ads.</div>
<div role="search"><form><input name=q><label>The search of the site</label></form></div>
<main><article><header><h1>Head &amp; line</h1></header><p>{PROSE}<br>More &eacute;&#233;&#x41;.</p><p>Short.</p>
<ul><li>Item one</li><li>Item two</li></ul><blockquote>QUOTE!! NOT PROSE!!</blockquote>
<p><a href="x">read the next of the stories that we have</a></p><!-- <p>gone</p> --><pre>code   here</pre>
<div class="share-buttons">Share the article</div><p>Last &lt;b&gt; line</p></article>
<section id="comments"><p>I think that this is the best of the texts that I have read in the last year.</p></section></main>
<aside><p>The sidebar has the list of the things that you may want to read in the next days.</p></aside>
<div class="ad">Buy the best of the things that the shop has for you and the family of you.</div>
<footer>&copy; 2020 the owner of the site</footer></body></html>"""


def test_article_alone():
    assert H.main_text(PAGE).split("\n") == [
        "Head & line", PROSE + " More ééA.", "Short.", "Item one", "Item two", "QUOTE!! NOT PROSE!!", "code here",
        "Last <b> line"]


def test_pages_without_article():
    body = f"<body><div>Menu</div><p>{PROSE}</p><h2>Between</h2><p>{PROSE}</p><div>Tail</div></body>"
    assert H.main_text(body).split("\n") == [PROSE, "Between", PROSE]
    assert H.main_text("<div>Menu</div><div>Other</div>") == ""


def test_second_pass():
    assert H.decided([None, True, None, None, None, False, None], [0] * 7) == [False, True, True, False, False, False, False]
    assert H.decided([None, None], [1, 1]) == [True, True]
    assert H.decided([None, True, None], [0, 0, 0]) == [False, True, False]
    assert H.decided([None, None, False, None, None], [0, 3, 3, 3, 0]) == [False, True, False, True, False]


def test_broken_markup():
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text("<") == ""
    assert H.main_text("<article><p>one<p>two<b>x</article") == "one\ntwox"
    assert H.main_text('<article><p>one</p><p>two <a href="/x') == "one\ntwo"
    assert H.main_text("<article><p>a &am") == "a &am"
    assert H.main_text("<article></div></p><p>a < b &amp;amp; c</p><script>never closed <p>x</p>") == "a < b &amp; c"
    assert H.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 2999) == "deep"
    assert len(H.main_text("<article><p>" + "word " * 200_000)) == 5 * 200_000 - 1


def test_query_and_edges(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    exp = sorted([(r["page_id"], r["url"], H.main_text(r["html"]), len(H.main_text(r["html"]))) for r in pages.collect()])
    assert sorted(tuple(r) for r in H.op7_html_text(spark, SF).collect()) == exp
    assert all(r[2] and "Menu" not in r[2] for r in exp)
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", PAGE, "x"), (2, "u", PAGE, "x")]
    odd = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = as_rows(H.extracted(odd), "page_id", "n_chars")
    n = len(H.main_text(PAGE))
    assert got == sorted([(1, 0), (None, 0), (2, n), (2, n)], key=repr)
    assert H.extracted(odd.limit(0)).count() == 0


def test_skipped_elements_swallow_nothing():
    article = f"<article><p>{PROSE}</p></article>"
    for code in ("for(i=0;i<n;i++){f(i)}", "if(a<b){x()}", "x='<p>'; y=\"</p>\"; a<b", "<!-- a<b", "s = '<script'"):
        for tag in ("script", "SCRIPT", "style", "textarea", "title"):
            end = tag.lower()
            assert H.main_text(f"<body><{tag}>{code}</{end}>{article}</body>") == PROSE, (tag, code)
            assert H.main_text(f"<body>{article}<svg><{tag}>{code}</{end}></svg>{article}") == PROSE + "\n" + PROSE
    assert H.main_text(f"<html><head><title>T</title><meta charset=x><script>a<b</script><body>{article}") == PROSE
    assert H.main_text(f"<head><title>T</title><link rel=x>{article}") == PROSE
    assert H.main_text(f"<head><meta name=x>\n<noscript><style>p<b</style><img src=x></noscript>{article}") == PROSE
    assert H.main_text(f"<head><title>T</title></head><body>{article}") == PROSE
    assert H.main_text(f"<button>Go{article}").endswith(PROSE)  # no end tag: nothing is skipped
    assert H.main_text(f"<datalist><option>a<option>b</datalist>{article}<select><option>c</option></select>") == PROSE


def test_many_unclosed_elements_stay_linear():
    assert H.main_text("<article><p>a" + "<button>" * 100_000 + "<svg>" * 100_000).startswith("a")


def test_stray_end_tags_stay_linear():
    import time
    took = []
    for n in (20_000, 80_000):
        t0 = time.process_time()
        assert H.main_text("<article>" + "<div>" * n + "</b>" * n + "the words of it and of that are in this for you to see") != ""
        took.append(time.process_time() - t0)
    assert took[1] < 12 * took[0] + 0.5


def test_a_layout_word_never_hides_the_article():
    prose = "It was the best of times and it was the worst of times for all of them."
    page = '<body><div class="content has-sidebar"><nav><p>Home</p></nav><article><p>%s</p></article></div></body>' % prose
    assert H.main_text(page) == prose
    assert H.main_text(page.replace("article>", "main>")) == prose
    # a comment in an article element stays out, and so do teasers beside an article that can be seen
    assert H.main_text('<div class="comments"><article><p>%s</p></article></div>' % prose) == ""
    both = '<article><p>%s</p></article><div class="widget-area"><article><p>It is the teaser of the day and of you.</p></article></div>' % prose
    assert H.main_text(both) == prose


def test_pages_in_other_languages():
    ru = "Это длинный абзац на русском языке в котором больше десяти слов и нет ссылок вовсе."
    ja = "これは日本語の長い段落であり空白を含まないが十分な数の文字を持っているので記事として扱われるべきものである。" * 2
    for prose in (ru, ja):
        assert H.main_text('<body><div class="menu"><p>%s</p></div><div><a href="#">Меню</a></div><div><p>%s</p></div></body>' % (prose, prose)) == prose
