"""What counts as a page's article: forms around it, reader comments, broken and deep markup."""

import time

import pytest

from tidemark.llm.html_text import main_text, parse, split_name

PARAGRAPHS = "".join(f"<p>Paragraph {w} of the article says something about it, and goes on for a while.</p>" for w in ("one", "two", "three"))
TEXT = "\n".join(f"Paragraph {w} of the article says something about it, and goes on for a while." for w in ("one", "two", "three"))


def text(html):
    return main_text(parse(html), set())


@pytest.mark.parametrize(
    "frame",
    [
        '<body><form id="aspnetForm" method="post"><input name="state"><nav><ul><li>Home</li></ul></nav><div>{}</div><button>Send</button><footer>foot</footer></form></body>',
        '<body><form><article>{}</article><form class="inner"><label>Mail</label></form></form></body>',
        '<body><div role="dialog"><main>{}</main></div><form><label>Search here</label><p>short</p></form></body>',
        "<body><header><h2>Site</h2></header><div role='search'><p>Find it</p></div><div>{}</div></body>",
    ],
)
def test_a_form_around_the_article_stays(frame):
    assert text(frame.format(PARAGRAPHS)) == TEXT


@pytest.mark.parametrize("name", ["user-comments", "commentlist", "mainmenu", "topbar", "ad-slot", "copyright", "page-numbers", "readerComments", "adbox", "loginForm", "comment-body", "socialbar"])
def test_names_drop_their_element(name):
    said = f'<div class="{name}"><p>not the article</p></div>'
    assert text(f"<article>{PARAGRAPHS}{said}</article>") == TEXT
    assert text(f'<article>{PARAGRAPHS}<div id="{name}">not the article</div></article>') == TEXT


@pytest.mark.parametrize("name", ["shareholders", "advice", "share-price", "linked-data", "content", "post-body", "noticeboard-story", "addon"])
def test_other_names_do_not(name):
    assert text(f'<article>{PARAGRAPHS}<div class="{name}"><p>more</p></div></article>') == TEXT + "\nmore"


def test_joined_names_are_split_into_known_words_only():
    assert split_name("mainmenu") == ("main", "menu") and split_name("shareholders") == ("shareholders",) and split_name("menu") == ("menu",)


COMMENT = '<{tag} class="c"><b>{name}</b> <span>{when}</span><{inner}>I think that {name} is right about this.</{inner}></{tag}>'


@pytest.mark.parametrize("when", ["12.03.2021", "2021-03-12 10:44", "3 hours ago", "yesterday"])
@pytest.mark.parametrize("tag,inner", [("li", "p"), ("div", "div"), ("section", "p")])
def test_reader_comments_are_known_by_their_structure(tag, inner, when):
    entries = "".join(COMMENT.format(tag=tag, inner=inner, name=n, when=when) for n in ("Ann", "Bert", "Cleo"))
    frame = "ul" if tag == "li" else "div"
    assert text(f"<article>{PARAGRAPHS}<{frame}>{entries}</{frame}></article>") == TEXT
    assert text(f"<body><article>{PARAGRAPHS}</article><{frame}>{entries}</{frame}></body>") == TEXT


def test_lists_of_the_article_stay():
    plain = "<ul><li>2020-01-02: first release of it</li><li>2021-03-04: second release of it</li></ul>"
    assert text(f"<article>{PARAGRAPHS}{plain}</article>").endswith("2020-01-02: first release of it\n2021-03-04: second release of it")
    one = COMMENT.format(tag="div", inner="p", name="Ann", when="12.03.2021")
    assert "I think that Ann" in text(f"<article>{PARAGRAPHS}<div>{one}</div></article>")
    index = "".join(COMMENT.format(tag="li", inner="p", name=n, when="12.03.2021") for n in ("Ann", "Bert"))
    assert "I think that Bert" in text(f"<body><ul>{index}</ul></body>")  # nothing stands before it


def test_blocks_end_where_browsers_end_them():
    assert text("<p>a<p>b<div>c</p>d</div>") == "a\nb\nc\nd"
    assert text("<div>a</i>b</em></div>c") == "ab\nc"


@pytest.mark.parametrize("piece", ["<div>t", "<b></i>", "<b>", "<ul></ul><p>", "<li><b>", "<p><div><b>", "</p>", '<div class="mainmenu ad-slot">', "<a href=x>y<table>", "<form>", "<article>x"])
def test_a_megabyte_of_open_tags_takes_seconds(piece):
    html = "<main>start</main><p><div>" + piece * (1_000_000 // len(piece))
    began = time.time()
    text(html)
    assert time.time() - began < 20
