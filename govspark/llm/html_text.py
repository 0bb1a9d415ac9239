"""Main text of web pages by tag-path ratios.

A page is read as text nodes, each with the path of open elements from the root (names, and classes where given). Per path
the text length, the number of nodes and the punctuation are added up; the ratio of a path is its length per node, weighed
by its punctuation per node. Ratios are smoothed over paths with the same parent elements, fused with the path's share of the
page's text, and paths that reach a threshold are content. The container of the article is the deepest path that holds most of
the content's ratio. Below it lists, tables, captions and quotations are kept whatever their own ratio, and so are other parts that
hold content; outside it, and where no path below the body holds most, content paths and their headings are kept alone.
Paths are nodes of a trie, so a page takes work in proportion to its length however deep it is. Elements that are never article text (scripts, navigation, forms,
headers and footers of the page, comments, adverts and the like, by element, class or id) do not count at all, unless the
page's article or most of its text lies in an element that only its class, id or role marks or that is hidden.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from govspark.llm.common import over_batches, slices, table

#: Elements of HTML by their part in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NOT_TEXT = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "menu", "dialog",
                  "object", "canvas", "audio", "video", "map"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1",
          "h2", "h3", "h4", "h5", "h6", "header", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody",
          "td", "tfoot", "th", "thead", "tr", "ul", "hgroup", "center"} | NOT_TEXT
#: An opening tag of the first ends open elements of the second up to the nearest of the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_HOLDS_P = ("td", "th", "li", "object", "button")
#: Words in a class, id or role that mark what is not the article.
MARKS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments",
         "complementary", "contentinfo", "cookie", "cookies", "disqus", "footer", "form", "header", "masthead", "menu", "menubar", "modal",
         "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "promoted", "promotion",
         "related", "replies", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe",
         "subscription", "tags", "toolbar", "widget", "widgets", "alert", "consent", "gdpr", "teaser"}
CONTENT = {"article", "main"}
#: Marks of what is no article however long it is; the others may as well describe what an element holds or stands beside.
APART = {"ad", "ads", "advert", "advertisement", "adverts", "comment", "comments", "consent", "cookie", "cookies", "disqus", "gdpr", "modal",
         "popup", "promo", "promoted", "promotion", "related", "replies", "respond", "sponsor", "sponsored"}
#: Marks of the page's head; headings and parts of an article have them too.
HEADS = {"banner", "header", "masthead"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Elements that divide a page without being text; below a container they are kept only if they hold content.
DIVISIONS = {"address", "article", "body", "center", "details", "div", "header", "html", "main", "section", "summary", "hgroup"}

#: A path is content if its fused ratio reaches this part of the page's length-weighted mean, and a container holds this part of all
#: content.
THRESHOLD, MOST = 0.1, 0.75

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: One attribute after the other, each with its value, so that nothing inside a value or a longer name is taken for one.
_attribute = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_words = re.compile(r"[A-Za-z]+")
_blank = re.compile(r"\s+")
_punctuation = re.compile(r"[.,;:!?、。，！？]")


def _marked(attributes: str, head: bool) -> tuple[str, str]:
    """How attributes mark an element as no article text ("hidden", "apart", "mark" or ""), and its class for the path.

    With ``head`` the marks of a page's head do not count."""
    mark, classes, seen = "", "", set()
    for name, a, b, c in _attribute.findall(attributes):
        value, name = a or b or c, name.lower()
        if name in seen:
            continue
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            mark = "hidden"
        if name in ("class", "id", "role"):
            # "site-header", "adBox" and "comment_list" count by their parts; "has-sidebar" names what the element is not.
            parts = {w.lower() for token in value.split() if not re.match(r"(?:has|with|without|no)[-_]", token, re.I)
                     for w in _words.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token))}
            found = parts & (MARKS - HEADS if head else MARKS)
            if found and not parts & CONTENT and mark != "hidden":
                mark = "apart" if mark == "apart" or found & APART else "mark"
            if name == "class" and value.strip():
                classes = "." + ".".join(value.split())
    return mark, classes


class _Tree:
    """Elements of one kind, each with its parent among them, the text below it, and what else it lies in."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.kind: list[str] = []
        self.inside: list[int] = []
        self.length: list[int] = []

    def add(self, parent: int, kind: str, inside: int) -> int:
        for column, value in ((self.parent, parent), (self.kind, kind), (self.inside, inside), (self.length, 0)):
            column.append(value)
        return len(self.parent) - 1

    def add_up(self) -> None:
        for i in range(len(self.parent) - 1, -1, -1):
            if self.parent[i] >= 0:
                self.length[self.parent[i]] += self.length[i]

    def chain(self, i: int) -> list[int]:
        out = []
        while i >= 0:
            out.append(i)
            i = self.parent[i]
        return out


def _gone(marked: _Tree, homes: _Tree, total: int, free: int) -> list[bool]:
    """Which marked elements are dropped: those below a dropped one, and those that hold neither the page's article nor most text.

    ``free`` is the text of articles and main elements below no mark; ``total`` that of the page."""
    saved, best = set(), {}
    for name in CONTENT:
        for i in range(len(homes.kind)):
            if homes.kind[i] == name and homes.length[i] > (homes.length[best[name]] if name in best else 0):
                best[name] = i
        if name in best and homes.length[best[name]] > free:
            over = marked.chain(homes.inside[best[name]])
            if not free or all(marked.kind[m] == "mark" for m in over):
                saved.update(over)
    home = best.get("article", best.get("main", -1))
    within: list[bool] = []
    for i in range(len(homes.parent)):
        within.append(i == home or homes.parent[i] >= 0 and within[homes.parent[i]])
    out: list[bool] = []
    for m, up in enumerate(marked.parent):
        of = total if home < 0 else homes.length[home] if marked.inside[m] >= 0 and within[marked.inside[m]] else None
        most = of is not None and marked.kind[m] != "apart" and 2 * marked.length[m] > of
        out.append(up >= 0 and out[up] or not (m in saved or most))
    return out


class Paths:
    """Paths of block elements from the root as nodes of a trie; node 0 is the root."""

    def __init__(self) -> None:
        self.parent, self.name, self._child = [-1], [""], {}

    def below(self, node: int, name: str, classes: str) -> int:
        key = (node, name + classes)
        if key not in self._child:
            self._child[key] = len(self.parent)
            self.parent.append(node)
            self.name.append(name)
        return self._child[key]


def blocks(page: str) -> tuple[list[tuple[int, str]], Paths]:
    """The page's blocks in order, with the path of each, and the paths; text that never counts is left out.

    Unclosed elements end with their parent; a closing tag without an opening one is ignored."""
    found: list[list[tuple[str, int, int]]] = []
    names: list[str] = []
    places: dict[str, list[int]] = defaultdict(list)  # where the open elements of each name are
    trie = Paths()
    paths: list[int] = [0]
    dropped: list[bool] = [False]
    content: list[int] = [-1]  # the nearest article or main element
    under: list[int] = [-1]  # the nearest marked element
    text: list[tuple[str, int, int]] = []  # with its path and marked element
    marked, homes, total, free = _Tree(), _Tree(), 0, 0

    def flush() -> None:
        nonlocal text
        if text:
            found.append(text)
        text = []

    def close(to: int) -> None:
        if any(names[i] in BLOCKS for i in range(to, len(names))):
            flush()
        for i in range(to, len(names)):
            places[names[i]].pop()
        del names[to:], paths[to + 1:], dropped[to + 1:], content[to + 1:], under[to + 1:]

    def nearest(some) -> int:
        return max((places[n][-1] for n in some if places[n]), default=-1)

    at, end = 0, len(page)
    while at < end:
        match = _token.search(page, at)
        stop = match.start() if match else end
        if stop > at and not dropped[-1]:
            text.append((page[at:stop], paths[-1], under[-1]))
            n = len(_blank.sub(" ", text[-1][0]).strip())
            total += n
            if under[-1] >= 0:
                marked.length[under[-1]] += n
            if content[-1] >= 0:
                homes.length[content[-1]] += n
                free += n if under[-1] < 0 else 0
        if not match:
            break
        at = match.end()
        if not match[2]:
            continue
        name = match[2].lower()
        if match[1]:
            if places[name]:
                close(places[name][-1])
            elif name == "br" or name == "p":
                text.append((" ", 0, under[-1]))
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif not dropped[-1]:
                text.append((" " if name == "br" else "", 0, under[-1]))
            continue
        if name in BLOCKS and places["p"] and name not in ("option",) and nearest(_HOLDS_P) < places["p"][-1]:
            close(places["p"][-1])
        if name in IMPLIED:
            ends, stops = IMPLIED[name]
            last = nearest(ends)
            if last > nearest(stops):
                close(last)
        if name in BLOCKS:
            flush()
        inside = content[-1] >= 0
        mark, classes = _marked(match[3], inside or name in HEADINGS) if match[3] else ("", "")
        places[name].append(len(names))
        names.append(name)
        paths.append(trie.below(paths[-1], name, classes) if name in BLOCKS else paths[-1])
        dropped.append(dropped[-1] or name in NOT_TEXT or name == "header" and not inside)
        keeps = not mark or name in ("html", "body", "main") or dropped[-1]
        under.append(under[-1] if keeps else marked.add(under[-1], mark, content[-1]))
        content.append(homes.add(content[-1], name, under[-1]) if name in CONTENT and not dropped[-1] else content[-1])
        if name in RAW and not match[0].endswith("/>"):
            raw = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = raw.end() if raw else end
            close(len(names) - 1)
    flush()
    marked.add_up()
    homes.add_up()
    gone = _gone(marked, homes, total, free)
    out: list[tuple[int, str]] = []
    for pieces in found:
        pieces = [p for p in pieces if p[2] < 0 or not gone[p[2]]]
        joined = _blank.sub(" ", unescape("".join(p[0] for p in pieces))).strip()
        if joined:
            out.append((next((p[1] for p in pieces if p[0] and not p[0].isspace()), 0), joined))
    return out, trie


def path_ratios(found: list[tuple[int, str]], trie: Paths) -> dict[int, float]:
    """The fused ratio of every path that has text."""
    length, nodes, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text in found:
        length[path] += len(text)
        nodes[path] += 1
        marks[path] += len(_punctuation.findall(text))
    ratio = {p: length[p] / nodes[p] * (1 + marks[p] / nodes[p]) for p in length}
    family = defaultdict(list)
    for p in ratio:
        family[trie.parent[p]].append(ratio[p])
    mean = {f: sum(r) / len(r) for f, r in family.items()}
    smooth = {p: (ratio[p] + mean[trie.parent[p]]) / 2 for p in ratio}
    total = sum(length.values())
    return {p: sqrt(smooth[p] * (smooth[p] * length[p] / total + ratio[p]) / 2) for p in ratio}


def main_text(page: str | None) -> str:
    """Blocks of the page's article by the ratios of their paths, in page order, joined by an empty line; null and empty pages
    have none."""
    found, trie = blocks(page or "")
    if not found:
        return ""
    fused = path_ratios(found, trie)
    length = defaultdict(int)
    for path, text in found:
        length[path] += len(text)
    limit = THRESHOLD * sum(fused[p] * length[p] for p in fused) / sum(length.values())
    content = {p for p in fused if fused[p] >= limit}
    # Ratio of the content at and below every path; parents have smaller numbers than what is below them.
    weight = [0.0] * len(trie.parent)
    for p in content:
        weight[p] = fused[p] * length[p]
    for p in range(len(weight) - 1, 0, -1):
        weight[trie.parent[p]] += weight[p]
    heads = {trie.parent[p] for p in content}
    container, over = 0, {0}
    for p in range(1, len(weight)):
        if trie.parent[p] == container and trie.name[p] in DIVISIONS and weight[p] >= MOST * weight[0]:
            container = p
            over.add(p)
    if trie.name[container] in ("", "html", "body"):
        container = -1
    else:  # headings that stand over the container, but not at the top of the page
        heads |= {p for p in over if trie.name[p] not in ("", "html", "body")}
    kept = [False] * len(weight)
    for p in range(1, len(weight)):
        up = trie.parent[p]
        if up == container or up >= 0 and kept[up]:
            kept[p] = trie.name[p] not in DIVISIONS or weight[p] > 0
    keeps = lambda p: p in content or p == container or kept[p] or trie.name[p] in HEADINGS and trie.parent[p] in heads
    # What reads like content but lies outside the container of most of it is not the article.
    inside = lambda p: container < 0 or p == container or kept[p] or trie.name[p] in HEADINGS and trie.parent[p] in heads
    return "\n\n".join(t for p, t in found if keeps(p) and inside(p))


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html), from the whole html; text is empty where a page has
    none. Repeated rows and null ids are handled row by row; other columns are not read."""

    def run(batch: pa.RecordBatch):
        ids, urls, pages = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
        for a, b in slices(pages):
            texts = [main_text(p) for p in pages[a:b]]
            yield {"page_id": ids[a:b], "url": urls[a:b], "text": texts, "n_chars": [len(t) for t in texts]}

    return over_batches(df.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
