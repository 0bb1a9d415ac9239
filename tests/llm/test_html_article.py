"""Article text survives loose marks in attributes."""

from govspark.llm.html_text import main_text

LONG = "A paragraph of the article, with some words, and a stop. " * 6


def _page(body):
    return f"<html><body>{body}</body></html>"


def test_names_and_values_of_other_attributes_mark_nothing():
    for attributes in ('href="/hidden-gems"', 'title="a hidden cost"', 'data-id="comment-5"', 'href="/p?id=search"', "href=/p?id=search",
                       'data-class="ad"', "title='class=ad hidden'"):
        assert main_text(_page(f"<article><p>{LONG}</p><p>See <a {attributes}>the link</a>, <span {attributes}>too</span>.</p></article>")).endswith(
            "See the link, too."), attributes
    for attributes in ('hidden', 'HIDDEN=""', "class=ad", "id='comment-5'", 'style="color:red; display: none"', 'aria-hidden="true"', 'title="x" role="search"'):
        assert main_text(_page(f"<article><p>{LONG}</p><div {attributes}><p>Not this.</p></div></article>")) == LONG.strip(), attributes


def test_marked_wrappers_of_the_article_are_kept():
    article = f'<h2 class="section-header">A heading</h2><p>{LONG}</p><p>{LONG}</p>'
    want = f"A heading\n\n{LONG.strip()}\n\n{LONG.strip()}"
    side = '<div class="sidebar"><p>Other things, here.</p></div><div id="comments"><article class="comment"><p>No, never.</p></article></div>'
    for mark in ("layout with-sidebar", "has-sidebar", "sidebar-right", "page-header", "widget"):
        assert main_text(_page(f'<div class="{mark}"><article>{article}</article>{side}</div>')) == want, mark
        assert main_text(_page(f'<article><div class="{mark}">{article}</div></article>{side}')) == want, mark
        assert main_text(_page(f'<main><div class="{mark}"><article>{article}</article></div></main>')) == want, mark
        assert LONG.strip() in main_text(_page(f'<div class="{mark}">{article}</div>')), mark
    assert main_text(_page(f"<article class='post tag-share'>{article}</article>{side}")) == want


def test_short_blocks_of_an_article_are_kept():
    paragraphs = [("A long paragraph, well punctuated, of the article; it goes on. " * 8)[:450].strip() for _ in range(6)]
    for name in ("article", "main"):
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        rest = ("<ul><li>An item of the list</li><li>Another item</li></ul><table><tr><td>A cell</td><td>42</td></tr></table>"
                "<figure><img src=x><figcaption>A caption</figcaption></figure><blockquote>A short quotation</blockquote>")
        want = paragraphs + ["An item of the list", "Another item", "A cell", "42", "A caption", "A short quotation"]
        assert main_text(_page(f"<nav>Home</nav><{name}>{body}{rest}</{name}><div>Beside it</div>")) == "\n\n".join(want)
