"""Main-text extraction with a tree-structured graphical model over DOM blocks.

Each block-level element is a binary variable (content or not) with a potential from its features; each parent-child
pair has a potential. Sum-product messages pass up to the root and down again and give every block's marginal
probability of being content. Weights maximise the likelihood of labelled pages by gradient steps.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import arrow_map
from cairnflow.llm.html_samples import labelled_pages

#: Fixed values of HTML: elements that are blocks, that have no end tag, and whose text is no text of the page where it is
#: read: scripts and styles, what stands in for a script, picture or frame that is shown, and the parts of forms.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html ins legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style template noscript title textarea select option button iframe object svg datalist".split())
#: Elements whose start ends an open element of the same row, up to the nearest of the elements after the colon.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr td th", ("table",))}
#: Words in class, id and role attributes that mark parts of a page.
MARKS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topnav pagination pager toc",
    "edge": "header masthead banner footer copyright legal contentinfo colophon",
    "side": "sidebar side aside complementary related recommended widget tags tag share sharing social author byline more",
    "notice": "notice cookie cookies consent gdpr newsletter popup modal alert subscribe subscription signup overlay message",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsbygoogle adsense outbrain taboola",
    "talk": "comment comments commentlist responses response replies reply discussion disqus respond",
    "form": "form search login register poll survey",
    "main": "article content post entry story main body text page",
    "hidden": "hidden invisible none",
}
_MARK = {w: k for k, names in MARKS.items() for w in names.split()}
TAGS = sorted(BLOCKS)
FEATURES = ["bias", *(f"tag {t}" for t in TAGS), *(f"mark {m}" for m in MARKS), "no text", "links", "all links", "short", "long", "sentence", "deep"]
_AT = {f: i for i, f in enumerate(FEATURES)}
#: Labelled pages that the default weights are fitted to, and gradient steps.
PAGES, STEPS = 500, 800
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
#: Start tags with attributes (2), whose values may hold ">"; the same up to the next ">"; end tags.
_START = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)>")
_END = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
RAW = ("script", "style", "title", "textarea", "iframe", "noscript", "template")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


class Page:
    """The blocks of a page in order of their start, and its text segments in page order with their blocks."""

    def __init__(self, html: str):
        self.parent, self.tag, self.marks, self.depth = [-1], ["html"], [frozenset()], [0]
        self.chars, self.linked = [0], [0]
        self.segments: list[tuple[int, str]] = []
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.open: dict[str, list[int]] = {"html": [0]}  # where in the stack each tag is
        self.run: list[str] = []
        self.hidden = self.links = 0
        self.read(html)
        self.flush()

    def read(self, html: str) -> None:
        """One pass: what is scanned in vain, for a ">" or a quote that never comes, is scanned once."""
        at, last, quoted = 0, html.rfind(">"), True
        while (start := html.find("<", at)) >= 0:
            after = html[start + 1 : start + 2]
            if html.startswith("<!--", start):
                stop = html.find("-->", start + 4)
                found, end = True, stop + 3 if stop >= 0 else len(html)
            elif start > last:
                break
            elif after in ("!", "?"):
                found, end = True, html.index(">", start) + 1
            elif after == "/":
                found = _END.match(html, start)
                end = found.end() if found else start + 1
            elif after.isascii() and after.isalpha():
                found = _START.match(html, start) if quoted else None
                if not found:  # a quote is open to the end: from here on quotes mean nothing
                    quoted, found = False, _PLAIN.match(html, start)
                end = found.end()
            else:
                found, end = None, start + 1
            if not found:  # it is text
                self.text(html[at:end])
                at = end
                continue
            if start > at:
                self.text(html[at:start])
            at = end
            if after == "/":
                self.end(found[1].lower())
            elif after not in ("!", "?"):
                tag = found[1].lower()
                if tag in RAW:  # its content is no markup, up to its end tag
                    stop = _RAW_END[tag].search(html, at)
                    at = stop.end() if stop else len(html)
                else:
                    self.start(tag, found[2])
        if at < len(html):
            self.text(html[at:])

    def push(self, tag: str, block: int) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, block))

    def flush(self) -> None:
        """Ends the segment of the innermost block."""
        if self.run:
            text = _SPACE.sub(" ", "".join(self.run)).strip()
            self.run = []
            if text:
                self.segments.append((self.stack[-1][1], text))
                self.chars[self.stack[-1][1]] += len(text)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.run.append(" ")
        if tag in ("html", "body") and self.open.get(tag) or tag in VOID and tag != "hr":
            return
        if tag in HIDDEN:
            self.hidden += 1
            self.push(tag, self.stack[-1][1])
            return
        if tag in BLOCKS:
            self.flush()
            if self.hidden:  # what a block ends without an end tag
                self.pop("head", () if tag == "body" else ("template", "noscript", "object", "iframe"))
                self.pop("svg", ("foreignobject", "desc", "template"))
            self.pop("p", BLOCKS - {"p"}) if tag != "p" else self.pop("p", ("td", "th", "table", "button"))
            if tag in ENDS:
                for name in ENDS[tag][0].split():
                    self.pop(name, ENDS[tag][1])
            if tag == "hr":
                return
            marks = set()
            for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
                if key.lower() in ("class", "id", "role"):
                    marks |= {_MARK[w] for w in map(str.lower, _WORD.findall(value)) if w in _MARK}
                elif key.lower() == "hidden" or (key.lower() == "style" and "display:none" in value.replace(" ", "").lower()):
                    marks.add("hidden")
            if len(marks) > 1:  # a comment's body is no body of the page
                marks.discard("main")
            up = self.stack[-1][1]
            self.parent.append(up)
            self.tag.append(tag)
            self.marks.append(frozenset(marks))
            self.depth.append(self.depth[up] + 1)
            self.chars.append(0)
            self.linked.append(0)
            self.push(tag, len(self.tag) - 1)
            return
        self.links += tag == "a"
        self.push(tag, self.stack[-1][1])

    def pop(self, tag: str, stop) -> None:
        """Ends the innermost open `tag`, if there is one within the innermost of `stop`."""
        if not (own := self.open.get(tag)) or any(at[-1] > own[-1] for x in stop if (at := self.open.get(x))):
            return
        self.flush()
        while len(self.stack) > max(1, own[-1] + 1):
            self.drop()
        if len(self.stack) > 1:
            self.drop()

    def drop(self) -> None:
        name = self.stack.pop()[0]
        self.open[name].pop()
        self.hidden -= name in HIDDEN
        self.links -= name == "a"

    def end(self, tag: str) -> None:
        if tag not in ("html", "body", "br"):
            self.pop(tag, () if tag in BLOCKS else BLOCKS)

    def text(self, data: str) -> None:
        if not self.hidden:
            data = unescape(data) if "&" in data else data
            self.run.append(data)
            if self.links:
                self.linked[self.stack[-1][1]] += len(data)


def features(page: Page) -> list[list[int]]:
    """The numbers of the features that each block has."""
    out, ends = [], [""] * len(page.tag)
    for block, text in page.segments:
        ends[block] = text
    for i, tag in enumerate(page.tag):
        own = [0, _AT[f"tag {tag}"], *(_AT[f"mark {m}"] for m in page.marks[i])]
        n = page.chars[i]
        if not n:
            own.append(_AT["no text"])
        else:
            if page.linked[i]:
                own.append(_AT["all links" if page.linked[i] >= 0.8 * n else "links"])
            own.append(_AT["long" if n > 120 else "short"])
            if ends[i][-1] in ".!?":
                own.append(_AT["sentence"])
        if page.depth[i] > 5:
            own.append(_AT["deep"])
        out.append(own)
    return out


class Forest:
    """The blocks of many pages, level by level, for messages in whole arrays."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + a) for p, a in zip(pages, self.first, strict=False)])
        depth = np.concatenate([np.array(p.depth) for p in pages])
        self.levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
        listed = [f for p in pages for f in features(p)]
        self.at = np.repeat(np.arange(len(listed)), [len(f) for f in listed])
        self.on = np.fromiter((x for f in listed for x in f), np.int64)

    def marginals(self, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(P(content) of each block, the summed 2 x 2 pair marginals over all parent-child pairs, log Z)."""
        n = len(self.parent)
        unary = np.zeros((n, 2))
        unary[:, 1] = np.bincount(self.at, weights[self.on], n)
        below, up = unary.copy(), np.zeros((n, 2))
        for level in self.levels[:0:-1]:  # upward: messages of children are in their parents' sums before those send
            m = below[level][:, None, :] + edge[None]
            up[level] = np.logaddexp(m[..., 0], m[..., 1])
            np.add.at(below, self.parent[level], up[level])
        top = below[self.levels[0]]
        log_z = float(np.logaddexp(top[:, 0], top[:, 1]).sum())
        above, pairs = np.zeros((n, 2)), np.zeros((2, 2))
        for level in self.levels[1:]:  # downward
            parent = self.parent[level]
            rest = above[parent] + below[parent] - up[level]
            m = rest[:, :, None] + edge[None]
            above[level] = np.logaddexp(m[:, 0], m[:, 1])
            joint = m + below[level][:, None, :]
            joint -= joint.max((1, 2), keepdims=True)
            joint = np.exp(joint)
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        both = above + below
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), pairs, log_z


def block_labels(page: Page, text: str) -> np.ndarray:
    """1 for blocks of lines of `text`, and for blocks that hold some within the smallest block that holds them all."""
    lines = {_SPACE.sub(" ", x).strip() for x in text.split("\n")}
    good, bad = np.zeros(len(page.tag), np.int64), np.zeros(len(page.tag), np.int64)
    for block, segment in page.segments:
        (good if segment in lines else bad)[block] += 1
    own, every = good + bad, good.sum()
    mostly = good >= bad
    for i in range(len(page.tag) - 1, 0, -1):
        good[page.parent[i]] += good[i]
    main = max(np.flatnonzero(good == every).tolist(), key=lambda i: page.depth[i]) if every else -1
    inside = np.zeros(len(page.tag), bool)
    for i in range(len(page.tag)):
        inside[i] = i == main or (i > 0 and inside[page.parent[i]])
    return (inside & np.where(own > 0, mostly, good > 0)).astype(np.int64)


def train(labelled: list[tuple[str, str]], steps: int = STEPS, rate: float = 0.5, decay: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """(weights, edge potentials) fitted to (html, main text) pairs: a bounded list, which the driver holds."""
    pages = [Page(html) for html, _ in labelled]
    forest = Forest(pages)
    y = np.concatenate([block_labels(p, text) for p, (_, text) in zip(pages, labelled, strict=True)])
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[inner]], y[inner]), 1)
    weights, edge = np.zeros(len(FEATURES)), np.zeros((2, 2))
    sums = [np.full(len(FEATURES), 1e-8), np.full((2, 2), 1e-8)]
    for _ in range(steps):  # observed less expected feature counts, with a step size for each weight
        p, pairs, _ = forest.marginals(weights, edge)
        for k, (value, slope) in enumerate(((weights, np.bincount(forest.on, (y - p)[forest.at], len(FEATURES)) / len(y)), (edge, (seen - pairs) / len(y)))):
            slope = slope - decay * value / 10
            sums[k] += slope * slope
            value += rate * slope / np.sqrt(sums[k])
    return weights, edge


_DEFAULT: list[tuple[np.ndarray, np.ndarray]] = []


def default_model() -> tuple[np.ndarray, np.ndarray]:
    if not _DEFAULT:
        _DEFAULT.append(train(labelled_pages(PAGES)))
    return _DEFAULT[0]


def main_texts(htmls: list[str], model: tuple[np.ndarray, np.ndarray], least: float = 0.5) -> list[str]:
    """The segments of each page whose blocks are content with probability `least` or more, in page order."""
    if not htmls:
        return []
    pages = [Page(h) for h in htmls]
    forest = Forest(pages)
    p, _, _ = forest.marginals(*model)
    return ["\n".join(text for block, text in page.segments if p[first + block] >= least) for page, first in zip(pages, forest.first.tolist(), strict=False)]


def extract_text(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages`; `model` as train gives it, some hundred numbers.

    Null and empty html give an empty text, as do pages without content. Character references are decoded, white space
    inside a block becomes one space, blocks are joined by \\n. Repeated rows and null ids or urls give a row each; other
    columns are not read; an empty table gives no rows. Without `model`, weights are fitted to made labelled pages.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            html = [h or "" for h in batch.column(2).to_pylist()]
            texts = [t for k in range(0, len(html), 256) for t in main_texts(html[k : k + 256], model)]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return arrow_map(rows, make, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
