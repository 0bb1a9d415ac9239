"""Ratios of tag paths decide every page: against a plain reading of the formulas, without article or main elements, at any depth."""

import random
import time
from html.parser import HTMLParser
from math import sqrt

from govspark.llm import html_text
from govspark.runtime import local_frame

SENTENCE = "Some words of the article, well put, and then a stop. "


class Plain(HTMLParser):
    """(path as text, text) of the text nodes of a page whose elements are all blocks and all closed."""

    def __init__(self):
        super().__init__()
        self.path, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.path.append(tag + "".join("." + v for k, v in attrs if k == "class"))

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        if data.strip():
            self.found.append(("/".join(self.path), " ".join(data.split())))


def plain_ratios(page):
    reader = Plain()
    reader.feed(page)
    paths = {p for p, _ in reader.found}
    texts = {p: [t for q, t in reader.found if q == p] for p in paths}
    ratio = {p: sum(map(len, texts[p])) / len(texts[p]) * (1 + sum(t.count(c) for t in texts[p] for c in ".,;:!?") / len(texts[p])) for p in paths}
    up = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    smooth = {p: (ratio[p] + sum(ratio[q] for q in paths if up(q) == up(p)) / sum(up(q) == up(p) for q in paths)) / 2 for p in paths}
    total = sum(len(t) for _, t in reader.found)
    return {p: sqrt(smooth[p] * (smooth[p] * sum(map(len, texts[p])) / total + ratio[p]) / 2) for p in paths}


def random_page(rnd):
    def part(depth):
        out = ""
        for _ in range(rnd.randint(1, 4)):
            if depth < 4 and rnd.random() < 0.5:
                name = rnd.choice(["div", "section", "ul"])
                out += f"<{name} class={rnd.choice('xyz')}>{part(depth + 1)}</{name}>"
            else:
                name = rnd.choice(["p", "h2", "blockquote"])
                out += f"<{name}>{rnd.choice([SENTENCE, 'Link', 'A: b; c!']) * rnd.randint(1, 3)}</{name}>"
        return out
    return f"<html><body>{part(0)}</body></html>"


def test_ratios_are_those_of_the_formulas():
    rnd = random.Random(2)
    for _ in range(60):
        page = random_page(rnd)
        found, trie = html_text.blocks(page)
        want = plain_ratios(page)
        got = html_text.path_ratios(found, trie)
        assert len(got) == len(want)
        assert sorted(round(v, 9) for v in got.values()) == sorted(round(v, 9) for v in want.values())


def test_the_container_needs_no_element_names():
    """The same text from an article element, a div of some class and nested sections; menus without marks fall by their ratio."""
    body = (f"<h1>A heading</h1><p>{SENTENCE * 5}</p><ul><li>An item</li><li>Another</li></ul><p>{SENTENCE * 4}</p><blockquote>Short.</blockquote>"
            f"<section><h2>Part two</h2><p>{SENTENCE * 6}</p></section>")
    want = ["A heading", (SENTENCE * 5).strip(), "An item", "Another", (SENTENCE * 4).strip(), "Short.", "Part two", (SENTENCE * 6).strip()]
    links = "<div class=c1>" + "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(12)) + "</div>"
    for a, b in (("<article>", "</article>"), ("<div class=body>", "</div>"), ("<div class=x1><div class=y2>", "</div></div>"), ("<main><div>", "</div></main>")):
        text = html_text.main_text(f"<html><body>{links}{a}{body}{b}<div class=c2><div>Read on</div></div></body></html>")
        assert text.split("\n\n") == want, a


def test_deep_pages_take_time_in_proportion():
    took = []
    for depth in (4_000, 16_000):
        start = time.process_time()
        assert html_text.main_text("<div>" * depth + f"<p>{SENTENCE}</p>" * 20 + "</div>" * depth).startswith("Some words")
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_empty_tables_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", f"<p>{SENTENCE}</p>", "other", 7), (1, "u", f"<p>{SENTENCE}</p>", "other", 7), (None, None, None, None, None), (2, "v", "", "x", 1)]
    got = html_text.extract(local_frame(spark, rows, schema)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", SENTENCE.strip(), 53), ("1", SENTENCE.strip(), 53), ("2", "", 0), ("None", "", 0)]
    assert html_text.extract(local_frame(spark, [], schema)).count() == 0
