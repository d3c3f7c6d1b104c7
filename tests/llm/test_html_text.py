"""Page texts: what goes and stays inside and outside articles, recurring blocks, hostile and odd pages."""

import time

from orbitlake.llm import html_text


def test_classes_inside_articles():
    page = (
        '<div class="site-header">Top</div><article class="post-header"><header><h1>Name</h1></header><h2 class="section-header">Heading</h2>'
        '<p class="notice">Said once.</p><p class="ad">Buy</p><div class="related-posts">More</div><div class="entry-header">By A</div><p>Body &lt;1&gt;'
        '<div id="comments"><p>First!</p></div></article><p>Outside'
    )
    assert html_text.text_of(html_text.parse(page)) == "Name\n\nHeading\n\nSaid once.\n\nBy A\n\nBody <1>"


def test_hostile_pages_take_little_time():
    began = time.time()
    for page in ['<a "' * 3000, "<a " + '"' * 3001, "<a " + "'\"" * 5000, "<script " * 3000, "<!-- " * 3000, "<a b='" * 3000 + ">", "<div>" * 5000, "x" * 3_000_000, '<p class="' + "a " * 100_000 + '">t', "<" * 100_000]:
        html_text.text_of(html_text.parse(page))
    assert time.time() - began < 20
    assert html_text.text_of(html_text.parse('<p>one <a "x>two</a> three')) == "one two three"
    assert html_text.text_of(html_text.parse("a < b <unfinished tag")) == "a < b"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, key int")


def test_recurring_blocks(spark):
    def body(i, block, marked):
        return f"<html><body><article><h1>Title {i}</h1><p>Text {i}</p>{block}{marked}<p>Same words everywhere.</p></article></body></html>"

    block, marked = "<div><span>Our shop</span> sells things</div>", '<p class="promo-box">Subscribe now</p>'
    rows = [(i, f"http://big.example/{'news' if i < 12 else 's' + str(i % 9)}/{i}", body(i, block if i < 12 else "", marked if i < 12 else ""), "clash", 1) for i in range(120)]
    rows += [(200, "http://small.example/a/1", body(200, block, marked), None, None)]
    found = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows)).collect()}
    assert found[3] == "Title 3\n\nText 3\n\nSame words everywhere."  # a tenth of its host, all of its section
    assert found[50] == "Title 50\n\nText 50\n\nSame words everywhere."
    assert found[200] == "Title 200\n\nText 200\n\nOur shop sells things\n\nSubscribe now\n\nSame words everywhere."


def test_odd_tables_through_the_query(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "x", "plain", None, None), (2, "http://h/", "", None, None), (3, "http://h/", " <p>a\n b<br>c</p>&amp;", None, None), (3, "http://h/", " <p>a\n b<br>c</p>&amp;", None, None)]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    out = html_text.op8_html_text(spark, str(tmp_path))
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in out.collect()) == [("1", "", 0), ("2", "", 0), ("3", "a b c\n\n&", 8), ("3", "a b c\n\n&", 8), ("None", "plain", 5)]
    assert html_text.main_text(pages(spark, rows).limit(0)).count() == 0


def said(page):
    return html_text.text_of(html_text.parse(page))


def test_wrappers_keep_the_page_they_hold():
    body = "<h1>Name</h1><p>" + "Some words of the text. " * 5 + "</p>"
    text = "Name\n\n" + ("Some words of the text. " * 5).strip()
    for inner in (body, f"<article>{body}</article>", f"<main>{body}</main>"):
        small = "" if inner == body else '<div class="related"><article>Teaser</article></div>'
        for begin, end in (('<form id="aspnetForm">', "</form>"), ('<div class="layout with-sidebar">', "</div>"), ('<div class="no-banner">', "</div>"), ('<div class="widget page-widget">', "</div>")):
            assert said(f'<nav>Menu</nav>{begin}{inner}<input value="x"><select><option>One</select><button>Send</button>{end}{small}<footer>Foot</footer>') == text, (begin, inner)
        assert said(f'{inner}<form>Your name <input></form><div class="sidebar">Left</div>') == text
    assert said(f"<aside><article>Teaser</article></aside><div>{body}</div>") == text  # an article that goes is not all that is read
    assert said(f'<article>{body}<form>Write to us</form><div id="comments"><article>{"I agree. " * 90}</article></div></article>') == text


def test_words_amid_sentences_stay():
    assert said('<article><div class="share-price">Price rose 3.</div><div class="share-buttons">Tell</div></article>') == "Price rose 3."
    assert said("<article><p>Press <button>OK</button> now</p><p><button>Subscribe</button></p></article>") == "Press OK now"
    assert said("<article><p>Area <math><mi>x</mi><annotation>x!</annotation></math> holds</p></article>") == "Area x holds"


def test_attributes_of_any_length():
    for n in (10, 80_000, 1_000_000):
        assert said(f'<p title="{"a>" * n}">t</p>') == "t"
        assert said(f"<p title = '{'a>' * n}' class=\"x\">t</p>") == "t"
    assert said("<p title=it's>one</p><p>two's</p>") == "one\n\ntwo's"
    assert said('<p>a<svg/>b</p><svg a=">">c</svg ><SCRIPT>"</p>"</Script>d') == "ab\n\nd"
    began = time.time()
    for page in ("<a b=\"'" * 100_000, "<a b='\">" * 100_000 + '"', '<a b="x" c=' * 100_000, "<a b=" + " =" * 300_000, ("<i a='>" + '<b c=">') * 50_000 + "<i a='"):
        said(page)
    assert time.time() - began < 20


def test_subtrees_counted_by_hand(spark):
    """Template blocks by counts of pages against a count over all pages of a small site, by host and section."""
    rows = []
    for i in range(60):
        blocks = "".join(f"<div>Block {k}</div>" for k in range(1, 13) if i % k == 0)
        rows.append((i, f"http://h{i % 2}.example/s{i % 3}/{i}", f"<body><section>{blocks}<p>Text {i}</p></section></body>", None, None))
    held = {i: [k for k in range(1, 13) if i % k == 0] for i in range(60)}

    def template(i, k):
        for same in (lambda j: j % 2 == i % 2, lambda j: j % 6 == i % 6):
            group = [j for j in range(60) if same(j)]
            n = sum(k in held[j] for j in group)
            if n >= html_text.PAGES and n >= html_text.SHARE * len(group):
                return True
        return False

    for r in html_text.main_text(pages(spark, rows)).collect():
        i = r["page_id"]
        assert r["text"] == "\n\n".join([f"Block {k}" for k in held[i] if not template(i, k)] + [f"Text {i}"]), i
