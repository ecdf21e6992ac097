import math
import random
import time
from html.parser import HTMLParser

import pytest

from larkspur.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header class="site-header">Site</header><nav><ul><li><a href="/x">x</a></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><header><h1>Head &amp; &lt;line&gt;</h1></header><p><b>One
 two<br>three<p>Four&nbsp;five <a href="a>b">link</a>.</p><aside>side</aside>
<form><input value="q">ask</form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
<div class="share-buttons">tweet</div><section id="comments"><p>reader</p></section></article>
<div class="cookie-notice">ok?</div><footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert h.main_text(PAGE) == "Head & <line>\n\nOne two three\n\nFour five link.\n\na\n\nb\n\nc\n\nd"


def test_odd_sources():
    assert h.main_text(None) == h.main_text("") == h.main_text("<p></p>") == ""
    assert h.main_text("just text &#65;&eacute;") == "just text Aé"
    assert h.main_text("<article><p>a<article class=comment>no</article></article>") == "a"
    assert h.main_text("<body><div id=nav>n</div><main><p>m</p></main>") == "m"
    assert h.main_text("<article>a < b <3 <p>c") == "a < b <3\n\nc"
    assert h.main_text("<article><script>x</article>") == ""
    assert h.main_text("<!-- <article>x</article> --><article>y</article>") == "y"


def page(i, host):
    return (i, f"https://{host}/p{i}", f"<body><article><p>text number {i} of {host}</p><div class=stamp>All about {host}</div></article></body>")


def test_style_tree_takes_out_what_a_site_repeats(spark):
    rows = [page(i, "a.example") for i in range(30)] + [page(100 + i, "b.example") for i in range(5)] + [page(200 + i, "c.example") for i in range(2)]
    rows += [page(0, "a.example"), (None, None, None), (7, "nohost", "<p>x</p>"), (8, None, "")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in h.extract(pages).collect())
    want = [(str(i), f"text number {i} of a.example") for i in [*range(30), 0]] + [(str(100 + i), f"text number {100 + i} of b.example") for i in range(5)]
    want += [(str(200 + i), f"text number {200 + i} of c.example\n\nAll about c.example") for i in range(2)] + [("None", ""), ("7", "x"), ("8", "")]
    assert got == sorted((a, t, len(t)) for a, t in want)


def test_a_plain_paragraph_of_the_whole_site_goes_and_articles_stay(spark):
    """The paragraph has the path of the article's own, so only its content gives it away."""
    rows = [(i, f"https://s.example/{i}", f"<body><article><p>story {i} begins here</p><p>Read our terms of use.</p><p>and story {i} ends</p></article></body>") for i in range(12)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i} begins here\n\nand story {i} ends" for i in range(12)}


@pytest.mark.parametrize("name", ["post with-sidebar", "ad-hoc-query", "related-work", "comment-on-law", "alert-box", "login-tutorial", "social-share-price"])
def test_names_alone_take_out_no_article(name):
    for tag in ("div", "article", "section"):
        assert h.main_text(f"<body><{tag} class='{name}'><p>Whole article</p></{tag}></body>") == "Whole article"
    assert h.main_text(f"<body><article><h1>T</h1><div class='{name}'><p>{'Whole article. ' * 30}</p></div></article></body>").startswith("T\n\nWhole article.")


def test_large_comments_go():
    story, talk = "A story of some length, told with care. " * 6, "<p>I like it a lot!</p>" * 200
    assert h.main_text(f"<article><p>{story}</p><div id=comments>{talk}</div></article>") == story.strip()


def test_order_and_main():
    assert h.main_text("<div><div><article>FIRST</article></div></div><article>SECOND</article>") == "FIRST\n\nSECOND"
    assert h.main_text("<main><h1>Title</h1><p>Main story text</p><article>related card</article></main>") == "Title\n\nMain story text\n\nrelated card"
    assert h.main_text("<article><p>x</p><section id='related'>Related work</section></article>") == "x\n\nRelated work"


@pytest.mark.parametrize("source", ["<div>" * 60_000 + "</b>" * 60_000, "<b><article>" + "<i>" * 60_000 + "</b>" * 60_000, "<span>" * 50_000 + "<div></div>" * 50_000, "<div>" * 60_000 + "</body>" * 60_000, "<article>" * 50_000 + "</body>" * 50_000, "<p>a<b>" * 80_000, "<a b='" * 100_000, "<div class=ad>x" * 40_000, "<li><span>" * 60_000])
def test_pages_of_stray_tags_are_linear(source):
    def took(s: str) -> float:
        began = time.process_time()
        h.main_text(s)
        h.tree_rows(s)
        return time.process_time() - began

    assert took(source) < 6


def test_a_path_is_hashed_once_a_page(monkeypatch):
    """Before, every element's was; what a start tag closes is looked up by its tag."""
    made, plain = [], h.short_hash
    monkeypatch.setattr(h, "short_hash", lambda text: made.append(text) or plain(text))
    root = h.parse("<ul>" + "<li>x<b>y</b>" * 1000 + "<li class=a>z</ul>")
    assert len(root.kids[0].kids) == 1001 and len(made) == 4
    for tag in sorted(h.BLOCKS | h.VOID | h.NOISE_TAGS | {"span"}):
        assert h.CLOSES.get(tag, []) == [(bit, tags) for bit, (by, tags, _) in enumerate(h.IMPLIED) if tag in by]
        for above in range(32):
            sets, leaves = h.LEAVES.get(tag, (0, -1))
            assert sets | above & leaves == sum(1 << bit for bit, (_, tags, walls) in enumerate(h.IMPLIED) if tag in tags or above >> bit & 1 and tag not in walls)


class Plain(HTMLParser):
    """A second extractor, for well-formed pages: the text of blocks outside what tags or names give away."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.line, self.skip, self.main = [], "", [], 0

    def end(self) -> None:
        if self.line.split():
            self.out.append(" ".join(self.line.split()))
        self.line = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div", "article", "h1", "ul", "li", "section", "nav", "footer", "form", "blockquote"):
            self.end()
        if tag == "br":
            self.line += " "
            return
        if self.skip or tag in ("nav", "footer", "form", "script", "style", "aside") or dict(attrs).get("class") in ("ad", "cookie-notice", "comments"):
            self.skip.append(tag)
        self.main += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("p", "div", "article", "h1", "ul", "li", "section", "nav", "footer", "form", "blockquote"):
            self.end()
        if self.skip:
            self.skip.pop()
        self.main -= tag == "article"

    def handle_data(self, data):
        if self.main and not self.skip:
            self.line += data


def random_page(rng: random.Random, repeated: str) -> str:
    words = lambda k: " ".join("".join(rng.choice("abcdeé&<") for _ in range(rng.randrange(1, 7))) for _ in range(k)).replace("&", "&amp;").replace("<", "&lt;")
    noise = lambda: rng.choice([f"<nav><ul><li>{words(3)}</li></ul></nav>", f'<div class="ad">{words(5)}</div>', f"<form>{words(2)}</form>", f"<script>var x = '{words(2)}';</script>", f'<div class="comments"><p>{words(9)}</p></div>', f"<aside><p>{words(4)}</p></aside>"])
    part = lambda: rng.choice([f"<p>{words(12)} <b>{words(3)}</b>{words(2)}<br>{words(4)}</p>", f"<ul><li>{words(4)}</li><li>{words(3)}\n {words(2)}</li></ul>", f"<blockquote><p>{words(8)}</p></blockquote>", f"<div><p>{words(9)}</p></div>"])
    inner = "".join(x for _ in range(rng.randrange(3, 9)) for x in (part(), noise() if rng.random() < 0.4 else ""))
    return f"<html><head><title>{words(3)}</title></head><body>{noise()}<article><h1>{words(6)}</h1>{inner}<p>{words(40)}</p>{repeated}</article>{noise()}<footer>{words(4)}</footer></body></html>"


def test_agrees_with_a_plain_extractor_and_a_plain_tree(spark):
    rng, rows, want = random.Random(5), [], {}
    for host, n in (("one.example", 40), ("two.example", 9), ("three.example", 3), ("four.example", 1)):
        for _ in range(n):
            source, i = random_page(rng, f"<p>Copyright of {host} since 1999</p>"), len(rows)
            rows.append((i, f"https://{host}/{i}", source))
            plain = Plain()
            plain.feed(source)
            plain.end()
            if n + 2 > 1 and 1 - math.log(n) / math.log(n + 2) < 0.2:  # the repeated paragraph is on all n pages
                plain.out.remove(f"Copyright of {host} since 1999")
            want[i] = "\n\n".join(plain.out)
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_copies_of_one_page_stay_whole(spark):
    pages = spark.createDataFrame([page(1, "a.example")] * 50, "page_id long, url string, html string")
    assert {r.text for r in h.extract(pages).collect()} == {"text number 1 of a.example\n\nAll about a.example"}


def test_no_pages(spark):
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


COMMENTS = "".join(f"<p>Reader {k} says something rather long about this.</p>" for k in range(8))


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<div><p>Short item 0 is all that we wrote.</p></div><div class='comments'>{COMMENTS}</div>", "Short item 0 is all that we wrote."),
        (f"<main><p>Brief note.</p><div id='comments'>{COMMENTS}</div></main>", "Brief note."),
        (f"<article><p>Brief note.</p><section class='post-replies'>{COMMENTS}</section></article>", "Brief note."),
        ("<div class='comments'><p>Nothing else is here.</p></div>", "Nothing else is here."),
        ("<article><p>Text of the page.</p><div class='ad-slot-300x250'>Buy now</div></article>", "Text of the page."),
        ("<article><p>Text.</p><script>a</scripty>b</script ><p>More.</p></article>", "Text.\n\nMore."),
    ],
)
def test_comments_and_adverts_go_however_short_the_rest(body, want):
    assert h.main_text(f"<html><body>{body}</body></html>") == want


@pytest.mark.parametrize("part", ["</style x", "</style" + " " * 30, "</style", "<!-- ", "</style>", "<style>"])
def test_raw_elements_are_linear(part):
    source = "<p>Text.</p><style>" + part * (1_000_000 // len(part))
    began = time.process_time()
    assert h.main_text(source).startswith("Text.")
    assert time.process_time() - began < 5  # under one on an idle machine
