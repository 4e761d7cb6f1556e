import pytest

from minekit.llm import site_tree

SCHEMA = "page_id long, url string, html string, text string, host string"


@pytest.fixture(scope="module")
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA)

    return make


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def core(source):
    return "\n".join(b[3] for b in site_tree.Page(source).blocks)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>One  two<br>three</p>tail &amp; more", "One two three\ntail & more"),
        ("<p><b>open<p>next</b> still<li>item<li>item2", "open\nnext still\nitem\nitem2"),
        ("a<script>var x='</p><p>no</p>'</script>b<style>p{}</style><!-- c <p>d</p> -->e", "abe"),
        ("<title>t</title><h1>T &lt;i&gt;&nbsp;x&#233;</h1><div>x<span>y</span>z</div>", "T <i> xé\nxyz"),
        ('<div class="Ad-Box">no</div><div class="adder">yes</div><div id="siteFooter">no</div><form>no<p>no</form>yes', "yes\nyes"),
        ('<nav>no</nav><header>no</header><aside>no</aside><footer>no</footer><div role="navigation">no</div><div hidden>no</div>end', "end"),
        ('<a title="a>b" href=\'x>y\'>link</a> 3 < 4 and 5 > 4', "link 3 < 4 and 5 > 4"),
        ("<p>cut &am", "cut &am"),
        ("<p>whole</p><p cla", "whole"),
        ("<div><p>a</div></p></span><p>b", "a\nb"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ('<ul class="comments"><li>no</ul><p>yes', "yes"),
        ("", ""),
        ("no tags", "no tags"),
    ],
)
def test_blocks_of_a_page(source, want):
    assert core(source) == want


def test_article_alone_is_read_and_marked_branches_go(pages):
    page = (
        "<html><head><title>no</title></head><body><div>outside</div><main><article><header><h1>Head</h1></header><p>One.</p>"
        '<div class="ad">no</div><p>Two.<aside>no</aside></article><section class="comments"><p>reader says</p></section></main><footer>&copy;</footer>'
    )
    assert texts(site_tree.main_texts(pages([(1, "http://a.example/x", page)]))) == {1: "Head\nOne.\nTwo."}


def site(n, host, template, article):
    return [(k, f"https://{host}/{k}", f"<body><div class=x1>{template}</div><div class=x2>{article(k)}</div><div>{template}</div></body>") for k in range(n)]


def test_template_branches_of_a_site_go(pages):
    rows = site(12, "t.example", "Call us now", lambda k: f"<p>Story {k} is new</p><p>Common line</p><p>End {k}</p>")
    got = texts(site_tree.main_texts(pages(rows)))
    assert got == {k: f"Story {k} is new\nCommon line\nEnd {k}" for k in range(12)}


def test_small_sites_and_copies_of_one_page_keep_their_text(pages):
    few = site(4, "few.example", "Call us now", lambda k: f"<p>Story {k}</p>")
    same = [(100 + k, "http://same.example/a", "<body><p>Equal text</p></body>") for k in range(30)]
    got = texts(site_tree.main_texts(pages(few + same)))
    assert got[0] == "Call us now\nStory 0\nCall us now"
    assert {got[100 + k] for k in range(30)} == {"Equal text"}


def test_marked_branches_inside_articles(pages):
    rows = [
        (k, f"http://m.example/{k}", f"<article><h1>Same head</h1><p>Body {k} a</p><p>Body {k} b</p><div class=promo-x9>Try it</div><div class=q7>Try this</div><p>Common</p></article>")
        for k in range(20)
    ]
    got = texts(site_tree.main_texts(pages(rows)))
    assert got == {k: f"Same head\nBody {k} a\nBody {k} b\nCommon" for k in range(20)}


def test_unmarked_template_branches_inside_articles_go(pages):
    rows = [(k, f"http://u.example/{k}", f"<article><h1>Same head</h1><p>Body {k} a</p><p>Body {k} b</p><div>Write to us for more</div></article>") for k in range(20)]
    assert texts(site_tree.main_texts(pages(rows))) == {k: f"Same head\nBody {k} a\nBody {k} b" for k in range(20)}


def test_text_beside_a_teaser_article_stays(pages):
    rows = [
        (k, f"http://b.example/{k}", f"<body><section><p>Call us now</p></section><article><p>Teaser {k}</p></article><div><p>Long story {k}</p><p>Its end {k}</p></div></body>")
        for k in range(20)
    ]
    assert texts(site_tree.main_texts(pages(rows))) == {k: f"Teaser {k}\nLong story {k}\nIts end {k}" for k in range(20)}


def test_template_of_a_small_part_of_a_site_goes(pages):
    plain = [(k, f"http://p.example/{k}", f"<body><div><p>Story {k}</p></div></body>") for k in range(60)]
    shop = [(100 + k, f"http://p.example/s/{k}", f"<body><div><p>Offer {k}</p></div><section>Call us now</section></body>") for k in range(10)]
    got = texts(site_tree.main_texts(pages(plain + shop)))
    assert got == {**{k: f"Story {k}" for k in range(60)}, **{100 + k: f"Offer {k}" for k in range(10)}}


def test_edges(pages):
    rows = [(1, None, None), (1, None, None), (2, "not a url", ""), (None, None, "<p>x</p>"), (3, "http://h.example", "<p>" + "long text " * 200_000)]
    out = site_tree.main_texts(pages(rows))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id, r.url, r.n_chars) for r in out.collect()), key=repr)
    assert got == sorted([(1, None, 0), (1, None, 0), (2, "not a url", 0), (None, None, 1), (3, "http://h.example", 1_999_999)], key=repr)
    assert site_tree.main_texts(pages([])).count() == 0


def test_given_pages_give_their_articles(spark):
    """The given pages hold one article each; here it is taken out by plain string work."""
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = texts(site_tree.main_texts(table))
    for r in table.collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("<p>|</p>|<h1>|</h1>", article))
        assert got[r.page_id] == "\n".join(x for x in parts if x)


LONG = "This is the story that the page tells, and it goes on for some time."


@pytest.mark.parametrize(
    "source",
    [
        f'<div id="page" class="site no-sidebar"><p>{LONG}</p></div>',
        f'<div class="content comments-closed"><p>{LONG}</p></div>',
        f'<div class="l-main has-sidebar"><p>{LONG}</p></div>',
        f'<article><div class="entry-content share-enabled"><p>{LONG}</p></div></article>',
        f'<article><div class="copyright-law"><p>{LONG}</p></div></article>',
        f"<article><form><p>{LONG}</p></form></article>",
        '<article><p>This is the story that the page tells,</p><section id="related-work"><p>and it goes on for some time.</p></section></article>',
        f'<div class="newsletter-edition"><p>{LONG}</p></div><p>short</p>',
        f'<div class="widget-area"><article><p>{LONG}</p></article></div>',
        f'<form action=x><input type=hidden name=state><input name=q><article><p>{LONG}</p></article></form>',
    ],
)
def test_names_of_states_and_of_subjects_do_not_empty_a_page(source):
    assert core(source).replace("\nshort", "").replace("\n", " ") == LONG


@pytest.mark.parametrize(
    "source",
    [
        f'<article><p>{LONG}</p></article><div class="newsletter-edition"><p>short</p></div>',
        f'<article><p>{LONG}</p></article><section class="comments"><article class="comment"><p>{LONG * 9}</p></article></section>',
        f'<p>{LONG}</p><div class="comment-list"><p>{LONG * 9}</p></div>',
        f"<p>{LONG}</p><form><label>Your name</label><input name=n><textarea></textarea><button>Send</button></form>",
        f'<p>{LONG}</p><div class="related-posts">{LONG * 2}</div><div class="share-buttons">{LONG * 2}</div>',
        f'<p>{LONG}</p><p class="cookieNotice">{LONG * 2}</p><form><p>{LONG[:20]}</p></form>',
        f'<p>{LONG}<span class="ad-slot">buy</span></p>',
    ],
)
def test_plain_noise_goes_whatever_its_length(source):
    assert core(source) == LONG


def test_a_form_of_controls_alone_has_no_text():
    assert core("<form><p>Log in</p><input name=user><input name=word><button>Go</button></form>") == ""
