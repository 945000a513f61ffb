"""Labelled pages for the extractor: pages of many layouts made from a seed, each with its main text."""

from __future__ import annotations

import random

#: Element names and class or id words that pages use for what is not the article, and for what is.
CHROME = {
    "menu": [("nav", ""), ("nav", "menu"), ("div", "nav"), ("div", "navbar"), ("ul", "menu"), ("div", "breadcrumbs"), ("div", "topnav")],
    "header": [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "banner")],
    "footer": [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "legal")],
    "side": [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "related"), ("section", "related-posts"), ("div", "widget"), ("div", "tags"), ("div", "share"), ("div", "social")],
    "notice": [("div", "notice"), ("div", "cookie-notice"), ("div", "cookies"), ("div", "consent"), ("section", "newsletter"), ("div", "popup"), ("div", "alert"), ("div", "subscribe"), ("dialog", "")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("section", "sponsored"), ("div", "promo"), ("aside", "ad"), ("div", "banner-ad"), ("ins", "adsbygoogle")],
    "comments": [("div", "comments"), ("section", "comments"), ("div", "comment-list"), ("ol", "comments"), ("div", "responses"), ("section", "discussion"), ("div", "replies")],
    "form": [("form", ""), ("form", "search"), ("form", "login"), ("div", "form")],
}
MAIN = [("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article"), ("div", "post"), ("div", "entry-content"), ("section", "story"), ("div", "main"), ("div", "body"), ("div", "text"), ("div", "article-body")]
CONSONANTS, VOWELS = "bcdfghklmnprstvwz", "aeiouy"
#: One name in so many of each kind, the last ones, makes the layouts that `unseen` pages have and `seen` ones lack.
HELD = 3


def _held(names: list, unseen: bool | None) -> list:
    """All `names`; or those of unseen layouts, or those of seen ones."""
    cut = len(names) - max(1, len(names) // HELD)
    return names if unseen is None else names[cut:] if unseen else names[:cut]


def _open(rng: random.Random, tag: str, name: str) -> str:
    if not name:
        return f"<{tag}>"
    return f'<{tag} {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", " x" + str(rng.randrange(90))])}">'


class _Page:
    def __init__(self, rng: random.Random, unseen: bool | None):
        self.rng, self.unseen, self.lines = rng, unseen, []

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        made = ["".join(rng.choice(CONSONANTS) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in made).capitalize() + rng.choice([".", ".", ".", ""])

    def chrome(self, kind: str) -> str:
        rng = self.rng
        tag, name = rng.choice(_held(CHROME[kind], self.unseen))
        if kind == "menu" or (kind in ("header", "footer", "side") and rng.random() < 0.5):
            inner = "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(rng.randint(2, 8)))
            inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>"
        elif kind == "comments":
            inner = "".join(f'<{t} class="comment">{rng.choice(["<p>", "<div class=\'comment-body\'>", "<div class=text>"])}{self.words(3, 60)}</{t}>' for t in rng.choices(["div", "li"], k=rng.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>"
        else:
            text = self.words(2, 50)
            inner = rng.choice([text, f"<p>{text}</p>", f"<p>{text}</p><p>{self.words(3, 30)}</p>", f"<div>{text}</div>", f"<h3>{self.words(1, 4)}</h3>{text}"])
        if rng.random() < 0.3:  # names that an article has are found in other parts too
            inner = f'<div class="{rng.choice(["content", "text", "body", "inner", "wrap", "main", "post"])}">{inner}</div>'
        return _open(rng, tag, name) + inner + f"</{tag}>"

    def block(self) -> str:
        rng = self.rng
        kind = rng.choices(["p", "h2", "li", "blockquote", "td", "div", "pre"], [20, 3, 2, 1, 1, 2, 0.5])[0]
        n = rng.randint(1, 4) if kind in ("li", "td") else 1
        texts = [self.words(2, 9) if kind in ("h2", "td") else self.words(1, rng.choice([6, 30, 120])) for _ in range(n)]
        self.lines += texts
        marked = [rng.choice([t, t, t, f"<b>{t}</b>", f"<b>{t}", f'<a href="#">{t}</a>' if rng.random() < 0.3 else t]) for t in texts]
        if kind == "li":
            return "<ul>" + "".join(f"<li>{t}</li>" for t in marked) + "</ul>"
        if kind == "td":
            return "<table><tr>" + "".join(f"<td>{t}</td>" for t in marked) + "</tr></table>"
        return f"<{kind}>{marked[0]}" + (f"</{kind}>" if kind != "p" or rng.random() < 0.9 else "")

    def article(self) -> str:
        rng = self.rng
        tag, name = rng.choice(_held(MAIN, self.unseen))
        parts = []
        if rng.random() < 0.8:
            title = self.words(2, 12)
            self.lines.append(title)
            parts.append(rng.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>"]))
        for _ in range(rng.randint(1, 12)):
            parts.append(self.block())
            if rng.random() < 0.06:
                parts.append(self.chrome(rng.choice(["advert", "side", "notice", "form"])))
        if rng.random() < 0.1:
            parts.append(self.chrome("comments"))
        made = _open(rng, tag, name) + "".join(parts) + f"</{tag}>"
        return rng.choice([made, made, f"<main>{made}</main>", f'<div class="wrap"><div>{made}</div></div>'])


def labelled_page(seed: int, unseen: bool | None = None) -> tuple[str, str]:
    """(html, main text) of one made page, of any layout, or of an unseen or seen one."""
    rng = random.Random(seed)
    page = _Page(rng, unseen)
    before = [page.chrome(k) for k in rng.sample(["menu", "header", "notice", "advert", "side", "form"], rng.randint(0, 4))]
    main = page.article()
    after = [page.chrome(k) for k in rng.sample(["footer", "side", "comments", "advert", "notice", "menu", "form"], rng.randint(0, 5))]
    head = f'<head><meta charset="utf-8"><title>{page.words(2, 8)}</title><meta name="viewport" content="width=device-width"><link rel="stylesheet" href="/s.css"></head>'
    body = f"<body>{''.join(before)}<!-- {page.words(1, 4)} -->{main}{''.join(after)}</body>"
    return f"<!DOCTYPE html><html>{head}{body}</html>", "\n".join(page.lines)


def labelled_pages(n: int, first_seed: int = 0, unseen: bool | None = None) -> list[tuple[str, str]]:
    return [labelled_page(first_seed + i, unseen) for i in range(n)]
