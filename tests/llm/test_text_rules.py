import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from govspark.llm import html_text, language_id, queries, repetition, toxicity
from govspark.runtime import local_frame
from tests.conftest import SMALL


def longest(words):
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=4))
def test_longest_repeats(docs):
    words = np.array([w for d in docs for w in d], dtype=np.int64)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    assert repetition.longest_repeats(words, owner).tolist() == [x for d in docs for x in longest(d)]


def plain_rules(text):
    """The base columns as their definition reads."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_op8_against_the_definition(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text) < 20_000}
    rows = {r.doc_id: r for r in queries.QUERIES["op8_repetition_rules"](spark, SMALL).collect()}
    for i, text in texts.items():
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(text)
        assert not (r.base_failed and r.kept)


def test_repetition_of_any_rows(awkward, nothing):
    rows = repetition.profile(awkward("kept")).collect()
    assert len(rows) == 10
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.base_failed, r.kept) == (0, True, False)
        if r.doc_id == 7:
            assert r.longest_repeat == 8_999 and r.covered_share == 1 and not r.kept
    kept = repetition.keep(awkward("kept"))
    assert kept.columns == awkward("kept").columns and kept.count() == 0
    assert repetition.profile(nothing).count() == 0 and repetition.keep(nothing).count() == 0


def _insults(n=160):
    rng = np.random.default_rng(0)
    clean = ["".join(rng.choice(list("abcdeimnorst"), rng.integers(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(clean, rng.integers(20, 120)))
        if i % 3 == 0:
            words.insert(rng.integers(0, len(words)), ["vilewort", "zuckel" + str(rng.choice(clean))][i % 2])
        texts.append(" ".join(words).encode())
        labels.append(int(i % 3 == 0))
    return texts, np.array(labels)


def test_the_network_learns_words_and_stems():
    texts, labels = _insults(600)
    net = toxicity.train(texts[:450], labels[:450])
    scores = net.scores(texts[450:])
    assert ((scores >= 0.3) == labels[450:]).mean() > 0.95
    # One window of many decides, and texts do not depend on what is scored with them.
    long = b" ".join(t for t, y in zip(texts[450:], labels[450:]) if not y) + b" vilewort"
    assert net.scores([long])[0] >= 0.3 and np.allclose(net.scores([long, texts[451]])[1], net.scores([texts[451]])[0], atol=1e-5)
    assert (net.scores([b"", None]) < 0.3).all()


def test_gradients_match_differences():
    texts, labels = _insults(30)
    net = toxicity.train(texts, labels, rounds=1, epochs=1, steps=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    places = np.array([[0, 1, 2, -1], [3, 4, 5, 6]])
    x, y = np.random.default_rng(1).normal(size=(8, toxicity._INPUT)), np.array([1.0, 0.0])
    x[-1] = 0
    loss = lambda: float(np.mean([np.logaddexp(0, z) - t * z for z, t in zip(net.forward(places, x), y)]))
    grads, dx = net.gradient(places, x, y)
    for name in ("xf", "ub", "nf", "a", "v", "o", "cb"):
        flat, at = net.p[name].reshape(-1), 3 % net.p[name].size
        old = flat[at]
        flat[at] = old + 1e-3
        up = loss()
        flat[at] = old - 1e-3
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-3 - grads[name].reshape(-1)[at]) < 2e-4, name


def test_toxicity_of_any_rows(spark, awkward, nothing):
    labels = local_frame(spark, [(4, 1), (9, 0), (9, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    for docs, n in ((awkward("score"), 10), (nothing, 0)):
        net = toxicity.trained(docs, labels)
        assert toxicity.score(docs, net).count() == n
        assert toxicity.keep(docs, net).columns == docs.columns
    net = toxicity.trained(awkward(), labels.where("toxic = 0"))  # nothing toxic to learn from
    assert {r.predicted for r in toxicity.score(awkward(), net).collect()} == {0} and toxicity.keep(awkward(), net).count() == 10


def test_languages(spark, nothing):
    import zlib
    rows = {r.doc_id: r for r in queries.QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in held} == {i for i, r in rows.items() if r.held_out}
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.93
    model = language_id.fit(["the cat and the dog", "der Hund und die Katze"], ["en", "de"])
    got = model.predict([None, "", "123 !?", "the dog", "die Katze", "字字"])
    assert got["lang_pred"][:3] == ["und"] * 3 and got["lang_pred"][3:5] == ["en", "de"] and got["rejected"][5]
    assert all(0 <= s <= 1 for s in got["score"])
    empty = language_id.fit([], [])
    assert empty.predict(["text"])["lang_pred"] == ["und"] and language_id.identify(nothing, empty).count() == 0
    assert language_id.sample(nothing) == ([], [])


PAGE = """<html><head><title>t</title><script>var x = "</p>";</script><style>p{}</style></head><body class="page"><header id="site-header">Site name</header>
<nav><a href="/">Home page, of the site.</a></nav><div class="cookie-notice">We use cookies, as ever.</div><div class="ad">Buy, buy, buy. Now.</div>
<article><h1>A  title &amp; more</h1><p>First paragraph,<br>with <b>bold</b> words &lt;here&gt;.</p><p>Second one &#8212; unclosed<p>Third, short.</article>
<aside><p>Aside text, long enough to count as text.</p></aside><section class="comments"><p>I disagree, strongly. Really.</p></section>
<form><label>Your mail, please.</label></form><footer>&copy; someone</footer></body></html>"""


def test_pages(spark):
    assert html_text.main_text(PAGE) == "A title & more\n\nFirst paragraph, with bold words <here>.\n\nSecond one — unclosed\n\nThird, short."
    for empty in (None, "", "   ", "<html></html>", "<script>x", "<!-- only"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text("<div><p>Cut off, in the mid") == "Cut off, in the mid"
    html_text.main_text("<p" * 5000 + "<div>" * 3000 + "x")  # no recursion, no crash
    rows = local_frame(spark, [(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string")
    got = html_text.extract(rows).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)


def test_op9_against_the_template(spark):
    """The tables' pages hold one article each, of a headline and paragraphs."""
    from html import unescape
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").join(queries.QUERIES["op9_html_text"](spark, SMALL).drop("url"), "page_id").collect():
        body = re.sub(r"<br>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in parts if x)
