"""Main text against another reader of the given pages, hand-made pages, and broken markup of a megabyte."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from millrace.llm import html_extract
from millrace.llm.html_extract import main_text

P = "This is a paragraph of the text that is long enough, and it has the words of a sentence. "
Q = "Here is another one of the paragraphs that are to be found, for it is long enough as well. "
RU = "Длинный абзац русского текста состоит из предложений. Служебных слов шести языков здесь нет, но точки есть. "
JA = "これは長い日本語の段落です。空白はありません。文はいくつもあります。これは長い日本語の段落です。空白はありません。文はいくつもあります。とても長い段落です。"
PL = "Długi akapit polskiego tekstu składa się ze zdań. Słów sześciu języków prawie nie ma, ale kropki są. "
WORDS = "red green blue yellow orange purple black white grey pink brown cyan magenta lime navy teal olive maroon"
MENU = '<ul><li><a href="/">Home page</a></li><li><a href="/a">About the company</a></li><li><a href="/c">Contact and address of us</a></li></ul>'


class Reader(HTMLParser):
    """The text of the article of a given page, by the standard library's parser: blocks end at p and h1."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.found, self.parts = 0, [], []
        self.feed(page)
        self.close()

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.found.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1"):
            self.flush()
        self.inside += tag == "article"
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1"):
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    given = pages.collect()
    assert len(found) == len(given) >= 50
    for r in given:
        assert found[r.page_id] == "\n\n".join(Reader(r.html).found), r.page_id


def joined(*blocks):
    return "\n\n".join(" ".join(b.split()) for b in blocks)


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (f"<body><div>{MENU}</div><h1>A title</h1><p>{P}<p>{Q}<div>{MENU}</div></body>", ["A title", P, Q]),
        (f"<div>{P}</div><p>Short one.</p><p>{Q}</p><div><a href=x>{P}</a></div><p>Another short one</p>", [P, "Short one.", Q]),
        (f"<p>{P}</p><p>{RU}</p><p>{JA}</p><p>{PL}</p>", [P, RU, JA, PL]),
        (f"<p>{RU}</p>{MENU}<p>{RU}</p>", [RU, RU]),
        (f"<p>{P}</p><p>{Q}</p><ul><li>{WORDS}</li></ul><p>tags</p>", [P, Q]),
        (f"<table><tr><td>{MENU}<td><h2>Of tables</h2><p>{P}<tr><td>x<td>{Q}</table>", ["Of tables", P, "x", Q]),
        (f"<div class=post><h2>One</h2><p>{P}<h2>Two</h2><p>{Q}</div><div class=comments><p>{P}</div>", ["One", P, "Two", Q]),
        (f"<datalist><option>A<option>B</datalist><p>{P}</p>", [P]),
        (f"<select><option>A<option>B</select><p>{P}</p><option>C<p>{Q}", [P, Q]),
        (f"<header><h1>Site</h1></header><pre>{P}</pre><blockquote>{Q}</blockquote><footer>{P}</footer>", [P, Q]),
        (f"<p>{P}</p><h3>More to read</h3><ul><li><a href=x>{Q}</a></li></ul>", [P]),
        (f"<p>{P}</p><p title=it's>{Q}</p><p>{P} don't</p>", [P, Q, P + " don't"]),
    ],
)
def test_pages_without_article(page, blocks):
    assert main_text(page) == joined(*blocks)


def test_header_of_an_article_keeps_its_title():
    for header in ("<header><h1>Title</h1><p>by me, today</p></header>", '<div class="article-header"><h1>Title</h1><p>by me</p></div>'):
        assert main_text(f"<header><h1>Site</h1></header><article>{header}<p>{P}</p></article>") == joined("Title", P)


def test_links_inside_an_article_and_what_stands_by_them():
    page = f"<article><h1>Title</h1><p>{P}</p><p>Short.</p><p>{WORDS}</p><h2>See also</h2><ul><li><a href=x>{Q}</a></li><li><a href=y>{Q}</a></li></ul></article>"
    assert main_text(page) == joined("Title", P, "Short.", WORDS)


@pytest.mark.parametrize(
    "part",
    ["<a ", '<a b="', "<a b='\"> ", "<div><b>", "<option>", "<svg>", "<b class=ad>", "</option", "<script>", "<", "<!", "<!--", "<![CDATA[", "<p x=", "</i>", "<select><option>", "&", "<p a=\"'>", "<datalist>", "<a href=x>y", "<header><h1>"],
)
def test_a_megabyte_of_broken_markup(part):
    began = time.time()
    main_text(part * (1_000_000 // len(part)))
    main_text("<article>" + part * (500_000 // len(part)) + "></article>" + "</b></i>" * 20_000)
    assert time.time() - began < 20
