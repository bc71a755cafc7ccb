"""Main text of pages."""
import html as H
import re

import pyarrow.parquet as pq
import pytest

from quillmark.llm.html_text import extract, main_text

BODY = "<p>A long first paragraph of the article with plenty of words in it.<p>Short.<p>Another paragraph, with <a href=x>a link</a> &amp; more.</p>"
TEXT = "A long first paragraph of the article with plenty of words in it.\nShort.\nAnother paragraph, with a link & more."


@pytest.mark.parametrize("page", [
    f"<body><header><a>Site</a></header><nav><ul><li><a>one</a><li><a>two</a></ul></nav><article>{BODY}</article><footer>c</footer>",
    f"<div class='cookie-notice'>We use cookies here</div><main>{BODY}<aside>More to read and see</aside></main>",
    f"<div id=content>{BODY}</div><div class='side sidebar'>Popular and other things</div><section id=comments><p>I disagree with all of this</section>",
    f"<article>{BODY}<form><label>Name</label><button>Send</button></form><script>var a='<p>x</p>'</script><style>p{{}}</style><div class=ad>Buy</div></article>",
    f"<article>{BODY}<section class='comments'><article class='comment'><p>Reader says a lot of things in this comment</p></article></section></article>",
    f"<ul class=menu><li><a href=1>Home</a><li><a href=2>News of the day</a></ul><div>{BODY}</div><!-- <p>no</p> -->",
])
def test_boilerplate_goes(page):
    assert main_text(page) == TEXT


STORY = "".join(f"<p>Paragraph {i} of the story tells in some detail what happened on that day, where it happened and to whom."
                f" It goes on for a second sentence of about the same length.</p>" for i in range(6))
CARDS = "".join(f"<article class=card><h3><a href=/{i}>Story {i}</a></h3><p>In short.</p><a href=/{i}>More</a></article>" for i in range(5))


@pytest.mark.parametrize("page", [
    f"<body><div>{STORY}</div><div>{CARDS}</div></body>",
    f"<body><div>{CARDS}</div><div>{STORY}</div></body>",
    f"<body>{CARDS}<div><div>{STORY}</div></div><footer>c</footer></body>",
])
def test_story_outside_the_articles(page):
    assert main_text(page) == "\n".join(re.findall("<p>(.*?)</p>", STORY))


@pytest.mark.parametrize("page", [
    f"<article class='post has-sidebar comments-open'>{STORY}</article>",
    f"<div id=page class='no-sidebar'><nav><a>Home</a></nav><div>{STORY}</div><div class=sidebar>Popular</div></div>",
    f"<div class='layout with-nav'><main>{STORY}</main><div class=related><a>Other</a></div></div><footer>c</footer>",
    f"<div class='page has-header'><div class=header>Site</div><article>{STORY}</article></div>",
    f"<form action=x><input type=hidden name=__VIEWSTATE><ul class=menu><li>Home</ul><div>{STORY}</div><div class=ad>Buy</div></form>",
    f"<form><div class=widget><article>{STORY}</article></div></form>",
    f"<div class='no-sidebar'><article>{STORY}</article><div id=comments class=comments-area>{'<p>A reader says so.</p>' * 200}</div></div>",
    f"<article>{STORY}<form><p>Your mail</p></form></article><div class=sidebar><article><p>{'Other ' * 50}</p></article></div>",
    f"<body><div>{STORY}</div><form class=newsletter><p>Get our mail each morning, before the others do.</p></form></body>",
])
def test_marks_around_the_story(page):
    assert main_text(page) == "\n".join(re.findall("<p>(.*?)</p>", STORY))


def test_many_marks():
    assert main_text("<div class=ad>" * 3000 + "deep text") == "deep text"


def test_article_and_plain_story():
    text = main_text(f"<body><article><h1>Title</h1>{STORY}<p>End.</p></article><div>{STORY.replace('story', 'report')}</div></body>")
    paragraphs = re.findall("<p>(.*?)</p>", STORY)
    assert text == "\n".join(["Title", *paragraphs, "End.", *(p.replace("story", "report") for p in paragraphs)])


def test_small_cases():
    assert main_text(None) == main_text("") == main_text("<p> </p>") == main_text("<script>x</script>") == ""
    assert main_text("plain  words\nhere") == "plain words here"
    assert main_text("<p>a&nbsp;&lt;b&gt;<br>c &#233;") == "a <b>\nc é"
    assert main_text("<div>" * 3000 + "deep text") == "deep text"
    assert main_text("<p>" + "word " * 200_000) == " ".join(["word"] * 200_000)


def test_given_pages(spark):
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|<br>|</?h1>", article)]
        assert main_text(r["html"]) == "\n".join(b for b in blocks if b)


def test_extract_rows(spark):
    t = spark.createDataFrame([(1, "u", "<p>a b", "clash"), (None, None, None, None), (1, "u", "<p>a b", "clash")],
                              "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in extract(t).collect())
    assert got == [("1", "a b", 3), ("1", "a b", 3), ("None", "", 0)]
    assert extract(t.limit(0)).count() == 0
