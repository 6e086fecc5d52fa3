import itertools
import math
import random

from vitrine.llm import html_crf as H
from vitrine.llm import html_pages as P


def field():
    if not hasattr(field, "it"):
        field.it = H.default_field()
    return field.it


def text(page):
    return H.main_text(page, field(), frozenset(field().w))


def test_unseen_labelled_pages():
    wrong = blocks = 0
    for page in P.labelled_pages(150, 77):
        labels = [int(b[4]) for b in H.leaf_blocks(page)]
        scores = [field().emission([*b[1], *H.text_features(b[0], b[2], b[3])]) for b in H.leaf_blocks(page)]
        wrong += sum(x != y for x, y in zip(labels, field().viterbi(scores)))
        blocks += len(labels)
    assert wrong <= 0.02 * blocks


def test_viterbi_and_gradient_match_enumeration():
    r = random.Random(2)
    f = H.Field()
    f.start = [0.3, -0.2]
    f.move = [[0.5, -0.4], [-0.1, 0.7]]
    for n in (1, 2, 5):
        page = [[f"f{r.randint(0, 3)}", f"g{r.randint(0, 2)}"] for _ in range(n)]
        f.w = {k: r.uniform(-1, 1) for k in ("f0", "f1", "f2", "f3", "g0", "g1", "g2")}
        scores = [f.emission(x) for x in page]

        def value(y, f=f, scores=scores):
            return (f.start[y[0]] + sum(s * k for s, k in zip(scores, y))
                    + sum(f.move[a][b] for a, b in zip(y, y[1:])))
        every = list(itertools.product((0, 1), repeat=n))
        assert value(tuple(f.viterbi(scores))) == max(map(value, every))
        total = sum(math.exp(value(y)) for y in every)
        chance = [sum(math.exp(value(y)) for y in every if y[i]) / total for i in range(n)]
        gold = [r.randint(0, 1) for _ in range(n)]
        before = f.start[1]
        f.learn(page, gold, 1e-3)
        assert abs((f.start[1] - before) / 1e-3 - (gold[0] - chance[0])) < 1e-6


def test_article_alone():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{a:b}</style><script>var t="</p><p>no</p>";</script>
    </head><body><nav><ul><li><a href=/a>Home</a></li><li><a href="/b">About</a></li></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy this now, and be glad.</div><div id="cookie-notice"><p>We use cookies.</p></div>
    <article><h1>A  title</h1><p><b>First&nbsp;line &lt;b&gt; &#233;&eacute;<br>second line.<p>An unclosed one, and more
    \t words. <a href="x">Linked</a> text.</p><div class="ad">Buy more now, and be glad.</div><p>Last one | with signs</p>
    <aside><h3>See also</h3><p>Other things here.</p></aside></article>
    <form><label>Your name</label><button>Send</button></form>
    <section class="comments"><div class="comment"><p>I like this very much.</p></div></section>
    <div class="sidebar"><p>Some side text, of a kind.</p></div><footer>&copy; site &middot; All rights.</footer></body></html>"""
    assert text(page) == ("A title First line <b> éé second line. An unclosed one, and more words. Linked text. "
                          "Last one | with signs")


def test_broken_pages_end_quietly():
    start = "<html><body><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>One sentence, and a cut "
    assert text(start + "&am") == "Title here One sentence, and a cut &am"
    for tail in ("<p", "<a href='x", "<!-- never closed", "<script>var x = 1;", "</artic", "<", "<p class=\"a>b"):
        assert text(start + tail).startswith("Title here One sentence, and a cut")
    assert text(None) == text("") == text("<html><body></body></html>") == text("<!-- -->") == ""
    assert text("<article>" + "<div>" * 3000 + "<p>Deep text, very deep.</p>") == "Deep text, very deep."
    long = "Word, and word. " * 60_000
    assert text(f"<article><p>{long}</p></article>") == long.strip()


def test_foreign_elements_hide_no_text():
    page = "<article><p>One sentence, and more.</p>%s<p>Two sentences, and more.</p></article>"
    for inside in ("<svg width='3'/>", "<math/>", "<object data='x'>", "<canvas>", "<svg>", "<svg><text>no</text></svg>"):
        assert text(page % inside) == "One sentence, and more. Two sentences, and more.", inside
    assert "Seen instead" in text(page % "<p><object data=x>Seen instead, and more.</object></p>")


def test_extract(spark):
    rows = [(1, "u", "<article><p>Ein Satz, und 中 noch einer.</p></article>"), (2, None, None), (2, None, None),
            (None, "v", ""), (4, "w", "<nav><a href=/>x</a></nav>")]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = H.extract(pages).collect()
    assert sorted((g["page_id"] or 0, g["url"] or "", g["text"], g["n_chars"]) for g in got) == [
        (0, "v", "", 0), (1, "u", "Ein Satz, und 中 noch einer.", 27), (2, "", "", 0), (2, "", "", 0), (4, "w", "", 0)]
    assert H.extract(pages.limit(0)).count() == 0


def test_custom_elements_hide_no_text():
    page = "<article><p>One sentence, and more.</p><%s><p>Two sentences, and more.</p></%s><p>Three sentences, and more.</p></article>"
    for tag in ("template-part", "script-loader", "iframe-wrap", "style-guide", "svg-icon", "noscript-x"):
        assert text(page % (tag, tag)) == "One sentence, and more. Two sentences, and more. Three sentences, and more.", tag
    for tag in ("template", "script", "style", "noscript", "iframe"):
        assert text(page % (tag, tag + " x")) == "One sentence, and more. Three sentences, and more.", tag


def test_layouts_that_name_nothing():
    one, two = "A first sentence of some length, with a comma. And one more.", "A second paragraph, of the same kind. It ends here."
    menu = '<ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul>'
    assert text(f"<html><body><div><p>{one}</p><p>{two}</p></div></body></html>") == f"{one} {two}"
    assert text(f"<p>{one}</p>") == one
    assert text(f"<body>{menu}<p>{one}</p><p>{two}</p><div class=footer>&copy; site</div></body>") == f"{one} {two}"
    assert text(f"<table><tr><td>{menu}</td><td><p>{one}</p><p>{two}</p></td></tr></table>") == f"{one} {two}"
