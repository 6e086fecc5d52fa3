"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is read by a tolerant tokenizer into leaf blocks: runs of text that no block
element interrupts. Scripts, styles, comments and markup give no block; character
references are decoded, and white space inside a block becomes one space. Each block
has features of its ancestors (element, words of class and id, role) and of its text
(length, punctuation, links, signs). A two-label field, article or other, with
start and transition weights is trained on labelled pages (``html_pages``) by
stochastic gradient descent on the conditional likelihood, and each page is decoded
by Viterbi. The article's blocks are joined in page order by one space. The field
holds a few hundred weights, sent to each task; pages are independent, nothing is
shuffled.

Defined cases: null and empty pages, and pages without an article block, give the
empty text; unclosed elements, comments, scripts and a cut last tag end with the
page; very long pages and deep nesting are read whole; repeated rows count each; an
empty table gives no rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import html_pages
from vitrine.llm.common import ship_by_value, shipped

ship_by_value(__name__)

TRAIN_PAGES = 1200
EPOCHS = 6
RATE = 0.3
DECAY = 1e-4
SEED = 3

#: Elements whose start or end ends a block.
BLOCK_ELEMENTS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split())
#: Elements without content.
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the same kind closes, up to the element that holds them.
CLOSED_BY_NEXT = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "option": "select", "tr": "table", "td": "tr", "th": "tr"}
#: Elements whose content is never text.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<svg(?=[\s/>])[^>]*(?<!/)>(?:(?!<svg[\s/>]).)*?</svg\s*>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|%s)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))" % html_pages.LABEL, re.I)
NAME_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class _Open:
    """An open element: the features it and its ancestors give, and the label it carries."""
    __slots__ = ("tag", "names", "label")

    def __init__(self, tag: str, names: frozenset[str], label: str | None):
        self.tag, self.names, self.label = tag, names, label


def _own_features(tag: str, attributes: str) -> tuple[list[str], str | None]:
    names, label = ["in " + tag], None
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")
        if key == html_pages.LABEL:
            label = value
        elif key == "role":
            names.append("role " + value.lower())
        else:
            names += ["named " + w.lower() for w in NAME_WORD.findall(value)]
    return names, label


def leaf_blocks(page: str | None, known: frozenset[str] | None = None
                ) -> Iterator[tuple[str, frozenset[str], str, float, str | None]]:
    """(text, ancestor features, element, share of linked characters, label) of each block in page order.

    With ``known``, features outside it are left out, so deep nesting stays cheap.
    """
    page = page or ""
    stack = [_Open("", frozenset(), None)]
    parts: list[str] = []
    linked = chars = links = 0

    def flush() -> list[tuple]:
        nonlocal parts, linked, chars
        text = " ".join(entities.unescape("".join(parts)).split())
        holder = next((e for e in reversed(stack) if e.tag in BLOCK_ELEMENTS), stack[0])
        out = [(text, stack[-1].names, holder.tag, linked / max(1, chars), stack[-1].label)] if text else []
        parts, linked, chars = [], 0, 0
        return out

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            parts.append(page[at:end])
            chars += end - at
            linked += (end - at) * (links > 0)
        if not m:
            break
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing = m[2] if m[3] else m[5]
        if tag in BLOCK_ELEMENTS:
            yield from flush()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID_ELEMENTS:
            continue
        if closing:
            k = len(stack) - 1
            while k and stack[k].tag != tag:
                k -= 1
            if k:
                links -= sum(e.tag == "a" for e in stack[k:])
                del stack[k:]
            continue
        if tag in BLOCK_ELEMENTS:  # an open paragraph, or an open sibling, ends here
            stop = frozenset(CLOSED_BY_NEXT[tag].split()) if tag in CLOSED_BY_NEXT else None
            k = len(stack) - 1
            while k and stack[k].tag not in BLOCK_ELEMENTS:
                k -= 1
            if k and stack[k].tag == "p":
                links -= sum(e.tag == "a" for e in stack[k:])
                del stack[k:]
            if stop:
                k = len(stack) - 1
                while k and stack[k].tag not in stop and stack[k].tag != tag:
                    k -= 1
                if k and stack[k].tag == tag:
                    links -= sum(e.tag == "a" for e in stack[k:])
                    del stack[k:]
        if tag in ("svg", "math") and (m[4] if m[3] else m[7]).endswith("/"):
            continue
        own, label = _own_features(tag, (m[4] if m[3] else m[7]) or "")
        above = stack[-1]
        new = [f for f in own if f not in above.names and (known is None or f in known)]
        stack.append(_Open(tag, above.names.union(new) if new else above.names, label if label is not None else above.label))
        links += tag == "a"
    yield from flush()


def text_features(text: str, element: str, link_share: float) -> list[str]:
    n = text.count(" ") + 1
    out = ["element " + element, f"words {min(6, n.bit_length())}", f"links {round(4 * link_share)}",
           "ends sentence" if text[-1] in ".!?…\"”" else "ends open"]
    if "," in text:
        out.append("comma")
    if "©" in text:
        out.append("copyright")
    if "http" in text or "@" in text:
        out.append("address")
    return out


class Field:
    """Weights of a two-label chain: label 1 against 0 for features, start and transitions for labels."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.start = [0.0, 0.0]
        self.move = [[0.0, 0.0], [0.0, 0.0]]

    def emission(self, features) -> float:
        return sum(self.w.get(f, 0.0) for f in features)

    def viterbi(self, scores: list[float]) -> list[int]:
        """The best labels; ties go to the article."""
        if not scores:
            return []
        best, back = [self.start[0], self.start[1] + scores[0]], []
        for s in scores[1:]:
            came = [int(best[1] + self.move[1][y] >= best[0] + self.move[0][y]) for y in (0, 1)]
            best = [best[came[y]] + self.move[came[y]][y] + s * y for y in (0, 1)]
            back.append(came)
        labels = [int(best[1] >= best[0])]
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return labels[::-1]

    def learn(self, page: list[list[str]], gold: list[int], rate: float) -> None:
        """One step up the gradient of the log likelihood of the page's labels."""
        def logsum(a: float, b: float) -> float:
            return max(a, b) + math.log1p(math.exp(-abs(a - b)))

        scores = [self.emission(f) for f in page]
        n, move = len(page), self.move
        ahead = [[self.start[0], self.start[1] + scores[0]]]
        for s in scores[1:]:
            a = ahead[-1]
            ahead.append([logsum(a[0] + move[0][y], a[1] + move[1][y]) + s * y for y in (0, 1)])
        after = [[0.0, 0.0]]
        for s in reversed(scores[1:]):
            b = after[-1]
            after.append([logsum(move[y][0] + b[0], move[y][1] + s + b[1]) for y in (0, 1)])
        after.reverse()
        total = logsum(*ahead[-1])
        for i, features in enumerate(page):
            error = gold[i] - math.exp(ahead[i][1] + after[i][1] - total)
            for f in features:
                self.w[f] = self.w.get(f, 0.0) * (1 - rate * DECAY) + rate * error
            if not i:
                self.start = [self.start[0] - rate * error, self.start[1] + rate * error]
        step = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(1, n):
            for x in (0, 1):
                for y in (0, 1):
                    p = math.exp(ahead[i - 1][x] + move[x][y] + scores[i] * y + after[i][y] - total)
                    step[x][y] += (gold[i - 1] == x and gold[i] == y) - p
        self.move = [[move[x][y] + rate * step[x][y] / n for y in (0, 1)] for x in (0, 1)]


def train(pages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """Fit on pages whose blocks carry labels."""
    examples = []
    for page in pages:
        blocks = [b for b in leaf_blocks(page) if b[4] is not None]
        if blocks:
            examples.append(([[*names, *text_features(t, e, s)] for t, names, e, s, _ in blocks],
                             [int(b[4]) for b in blocks]))
    field, order = Field(), random.Random(seed)
    for epoch in range(epochs):
        order.shuffle(examples)
        for page, gold in examples:
            field.learn(page, gold, RATE / (1 + epoch))
    return field


def main_text(page: str | None, field: Field, known: frozenset[str]) -> str:
    blocks = list(leaf_blocks(page, known))
    ancestors: dict[frozenset[str], float] = {}
    scores = []
    for text, names, element, share, _ in blocks:
        if names not in ancestors:
            ancestors[names] = field.emission(names)
        scores.append(ancestors[names] + field.emission(text_features(text, element, share)))
    return " ".join(b[0] for b, label in zip(blocks, field.viterbi(scores)) if label)


def default_field() -> Field:
    return train(html_pages.labelled_pages(TRAIN_PAGES, SEED))


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    shared = shipped(pages.sparkSession, field or default_field())

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = shared()
        known = frozenset(field.w)
        for batch in batches:
            yield pd.Series([main_text(p, field, known) for p in batch], dtype="object")

    got = pages.select("page_id", "url", texts(F.coalesce(F.col("html"), F.lit(""))).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
