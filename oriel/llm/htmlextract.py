"""Main text of web pages: boosted trees over DOM-node features, decoded on the tree.

Each block element gets a score for holding main text, from the density of its
subtree, its attribute tokens, its depth and its siblings.  The labels that a
page ends up with are the most likely ones in which nothing under a discarded
element is kept: a sum over the tree from its leaves, so no two choices contradict.

The trees are trained here, on pages that a seeded generator lays out and labels.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .gbt import Boosted
from .htmltree import SILENT, Node, blocks, parse, walk

TAGS = ("p", "h1", "h2", "h3", "li", "ul", "ol", "div", "section", "article", "main", "body", "blockquote", "pre", "table", "td", "figure", "nav", "header", "footer", "aside", "form", "html")
BOILER = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget related recommended share sharing social cookie consent notice alert popup modal overlay login signup subscribe newsletter comment comments disqus reply replies respondent pagination pager copyright legal tags toolbar search complementary contentinfo dialog".split()
)
COMMENT = frozenset("comment comments reply replies disqus discussion respond".split())
CONTENT = frozenset("article content post entry main story body text page blog news articlebody maincontent".split())


def features(nodes: list[Node]) -> np.ndarray:
    """One row a node, parents before children."""
    rows = np.zeros((len(nodes), len(TAGS) + 28))
    index = {id(n): i for i, n in enumerate(nodes)}
    total = max(nodes[0].chars, 1)
    for i, n in enumerate(nodes):
        r, p = rows[i], n.parent
        if n.tag in TAGS:
            r[TAGS.index(n.tag)] = 1
        k = len(TAGS)
        bad, good = len(n.tokens & BOILER), len(n.tokens & CONTENT)
        up = rows[index[id(p)]] if p is not None else np.zeros(rows.shape[1])
        own_bad = bad > 0 or n.tag in ("nav", "header", "footer", "aside", "form")
        own_good = (good > 0 and not bad) or n.tag in ("article", "main")
        r[k : k + 4] = bad, good, len(n.tokens & COMMENT), len(n.tokens)
        r[k + 4] = up[k + 4] + own_bad
        r[k + 5] = up[k + 5] + own_good
        r[k + 6] = n.depth
        r[k + 7] = np.log1p(n.chars)
        r[k + 8] = n.link_chars / max(n.chars, 1)
        r[k + 9] = n.chars / max(n.nodes, 1)
        r[k + 10] = n.chars / total
        r[k + 11] = n.marks / max(n.words, 1)
        r[k + 12] = np.log1p(n.words)
        r[k + 13] = n.links
        r[k + 14] = np.log1p(n.nodes)
        r[k + 15] = n.own / max(n.chars, 1)
        if p is not None:
            many = len(p.children)
            r[k + 16] = n.place / max(many - 1, 1)
            r[k + 17] = many
            r[k + 18] = sum(c.tag == n.tag for c in p.children[max(0, n.place - 20) : n.place + 21])
            near = [c.chars for c in p.children[max(0, n.place - 3) : n.place + 4] if c is not n]
            r[k + 19] = np.log1p(sum(near) / max(len(near), 1))
            r[k + 20] = n.chars / max(p.chars, 1)
            r[k + 21] = p.link_chars / max(p.chars, 1)
            r[k + 22] = len(p.tokens & BOILER) + (p.tag in ("nav", "header", "footer", "aside", "form"))
            before = p.children[n.place - 1] if n.place else None
            r[k + 23] = before.link_chars / max(before.chars, 1) if before is not None else -1
        r[k + 24] = sum(c.tag == "p" for c in n.children)
        r[k + 25] = n.chars / max(n.words, 1)
        r[k + 26] = n.inline
        r[k + 27] = "-" in n.tag
    return rows


def decode(nodes: list[Node], logit: np.ndarray) -> set[int]:
    """ids of the nodes kept by the most likely labels without a kept node under a discarded one."""
    index = {id(n): i for i, n in enumerate(nodes)}
    yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    keep, drop = yes.copy(), no.copy()
    for i in range(len(nodes) - 1, 0, -1):  # children come after parents
        p = index[id(nodes[i].parent)]
        silent = nodes[i].tag in SILENT
        keep[p] += drop[i] if silent else max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = {id(nodes[0])}
    for i, n in enumerate(nodes[1:], 1):
        if id(n.parent) in kept and n.tag not in SILENT and (n.tag == "body" or keep[i] >= drop[i]):
            kept.add(id(n))
    return kept


# training pages


class Pages:
    """Seeded pages; elements of the main text carry a mark that the labels are read from."""

    MARK = "⁣"

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.r.integers(len(options)))]

    def words(self, low: int, high: int, stop: bool = True) -> str:
        letters = "etaoinshrdlucmfwypvbg"
        n = int(self.r.integers(low, high + 1))
        ends = np.cumsum(self.r.integers(1, 11, n)).tolist()
        run = "".join(letters[i] for i in self.r.integers(len(letters), size=ends[-1] if ends else 0).tolist())
        out = [run[a:z] for a, z in zip([0, *ends], ends)]
        for i in np.flatnonzero(self.r.random(n) < 0.1).tolist():
            out[i] += ","
        for i in np.flatnonzero(self.r.random(n) < 0.1).tolist():
            out[i] += ".%&#*!?"[int(self.r.integers(7))] * int(self.r.integers(1, 4))
        text = " ".join(out).capitalize()
        return text.replace("&", "&amp;") + ("." if stop else "")

    def links(self, low: int, high: int, tag: str = "li") -> str:
        items = [f'<a href="/{i}">{self.words(1, 3, False)}</a>' for i in range(int(self.r.integers(low, high + 1)))]
        return "".join(f"<{tag}>{x}</{tag}>" for x in items) if tag else self.pick(" ", " | ").join(items)

    def main(self) -> str:
        m, out = self.MARK, []
        if self.r.random() < 0.8:
            out.append(f"<h1>{m}{self.words(2, 12, False)}</h1>")
        for _ in range(int(self.r.choice([1, 1, 2, 3, 5, 8, 13]))):
            kind = self.r.random()
            size = (1, 3) if self.r.random() < 0.2 else (8, 40) if self.r.random() < 0.4 else (30, 150)
            text = self.words(*size)
            if self.r.random() < 0.2:
                text += f" {self.inline()} {self.words(2, 12)}"
            if self.r.random() < 0.25:
                text += f' <a href="/x">{self.words(1, 4, False)}</a> {self.words(3, 12)}'
            if kind < 0.78:
                out.append(self.pick(f"<p>{m}{text}</p>", f"<p><b>{m}{text}<br>", f"<p>{m}{text}"))
            elif kind < 0.84:
                out.append(f"<h2>{m}{self.words(1, 8, False)}</h2>")
            elif kind < 0.90:
                tag = self.pick("ul", "ol")
                out.append(f"<{tag}>" + "".join(f"<li>{m}{self.words(3, 25)}</li>" for _ in range(int(self.r.integers(2, 7)))) + f"</{tag}>")
            elif kind < 0.94:
                out.append(f"<blockquote>{m}{text}</blockquote>")
            elif kind < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{m}{self.words(1, 4, False)}</td><td>{m}{self.words(1, 4, False)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<div>{m}{text}</div>")
            if self.r.random() < 0.06:
                out.append(self.advert())
            if self.r.random() < 0.04:
                out.append(self.form())
        return "".join(out)

    def inline(self) -> str:
        """Inline elements with attributes: most belong to the text, adverts do not."""
        m, text = self.MARK, self.words(1, 8, False)
        if self.r.random() < 0.35:
            cls = self.pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "inline-ad", "advertisement", "banner")
            return self.pick(f'<span class="{cls}">{text}</span>', f'<a class="{cls}" href="/b">{text}</a>', f'<em id="{cls}">{text}</em>', f'<ins class="{cls}">{text}</ins>')
        cls = self.pick("highlight", "term", "name", "quote", "caps", "lead", "note-ref", "author", "date", "link", "external", "keyword", "small")
        return self.pick(f'<span class="{cls}">{m}{text}</span>', f'<a class="{cls}" href="/x">{m}{text}</a>', f'<em class="{cls}">{m}{text}</em>', f'<strong id="{cls}">{m}{text}</strong>')

    def advert(self) -> str:
        if self.r.random() < 0.15:
            tag = self.pick("custom-ad", "ad-banner", "x-promo", "amp-ad", "sponsored-box")
            return f"<{tag}>{self.pick('<p>', '<div>', '')}{self.words(2, 25)}</{tag}>"
        cls = self.pick("ad", "ads", "advert", "advertisement", "ad-slot", "banner", "sponsored", "promo", "ad-banner top")
        return self.pick(f'<div class="{cls}">{self.words(3, 25)}</div>', f'<div id="{cls}"><p>{self.words(3, 25)}</p></div>', f'<aside class="{cls}"><a href="/b">{self.words(2, 9)}</a></aside>', f'<section class="{cls}"><h3>{self.words(1, 4, False)}</h3><p>{self.words(4, 30)}</p></section>')

    def form(self) -> str:
        cls = self.pick("", ' class="newsletter"', ' id="search"', ' class="login-form"', ' class="subscribe"')
        return f'<form{cls}><p>{self.words(2, 14)}</p><label>{self.words(1, 3, False)}</label><input name="q"><button>{self.words(1, 2, False)}</button></form>'

    def menu(self) -> str:
        body = self.pick(f"<ul>{self.links(3, 9)}</ul>", self.links(3, 9, ""), f"<div>{self.links(3, 9, 'span')}</div>")
        cls = self.pick("menu", "nav", "navbar", "main-nav", "breadcrumb", "navigation")
        return self.pick(f"<nav>{body}</nav>", f'<div class="{cls}">{body}</div>', f'<nav class="{cls}">{body}</nav>', f'<ul class="{cls}">{self.links(3, 9)}</ul>', f'<div role="navigation">{body}</div>')

    def head(self) -> str:
        body = f"{self.pick('', f'<h1>{self.words(1, 4, False)}</h1>')}<p>{self.words(2, 14)}</p>"
        return self.pick(f"<header>{body}{self.menu()}</header>", f'<div class="header">{body}</div>', f'<div id="masthead">{body}</div>', f"<header>{body}</header>")

    def foot(self) -> str:
        body = self.pick(f"<p>&copy; {self.words(2, 10)}</p>", f"&copy; {self.words(1, 3, False)} &middot; {self.words(3, 18)}", f"<ul>{self.links(2, 6)}</ul><p>{self.words(4, 30)}</p>")
        return self.pick(f"<footer>{body}</footer>", f'<div class="footer">{body}</div>', f'<div id="footer"><div>{body}</div></div>')

    def side(self) -> str:
        body = f"<h3>{self.words(1, 3, False)}</h3>" + self.pick(f"<ul>{self.links(3, 8)}</ul>", f"<p>{self.words(5, 40)}</p>", f"<p>{self.words(5, 40)}</p><p>{self.words(5, 30)}</p>")
        cls = self.pick("sidebar", "widget", "related", "recommended-stories", "side-bar")
        return self.pick(f"<aside>{body}</aside>", f'<div class="{cls}">{body}</div>', f'<section class="{cls}">{body}</section>', f'<aside class="{cls}">{body}</aside>')

    def notice(self) -> str:
        cls = self.pick("cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "cookie-banner")
        return self.pick(f'<div class="{cls}"><p>{self.words(5, 40)}</p><button>{self.words(1, 2, False)}</button></div>', f'<div id="{cls}">{self.words(5, 40)}</div>', f'<div role="dialog" class="{cls}"><p>{self.words(5, 30)}</p></div>')

    def comments(self) -> str:
        cls = self.pick("comments", "comment-list", "comment-section", "replies", "disqus")
        one = lambda: self.pick(
            f'<div class="comment"><p>{self.words(3, 80)}</p></div>', f'<li class="comment"><p>{self.words(3, 60)}</p></li>', f"<div><b>{self.words(1, 2, False)}</b><p>{self.words(3, 60)}</p></div>", f'<article class="comment"><p>{self.words(3, 60)}</p></article>'
        )
        body = "".join(one() for _ in range(int(self.r.integers(1, 6))))
        return self.pick(f'<section id="{cls}"><h2>{self.words(1, 2, False)}</h2>{body}</section>', f'<div class="{cls}">{body}</div>', f'<section class="{cls}">{body}</section>')

    def page(self) -> str:
        some = lambda f, chance: f() if self.r.random() < chance else ""
        text = self.main()
        inner = some(self.comments, 0.12) + some(self.side, 0.06) + some(lambda: f'<div class="share social">{self.links(2, 4, "")}</div>', 0.1)
        cls = self.pick("content", "post", "entry-content", "article-body", "main-content", "story", "text")
        text = self.pick(f"<article>{text}{inner}</article>", f"<article>{text}</article>{inner}", f"<article>{text}</article>{inner}", f"<main>{text}{inner}</main>", f"<main><article>{text}</article>{inner}</main>", f'<div class="{cls}">{text}{inner}</div>', f'<div id="{cls}"><div>{text}</div>{inner}</div>', f'<article class="{cls}">{text}{inner}</article>', f"<section>{text}{inner}</section>", f"<div><div>{text}</div></div>{inner}")
        out = some(self.notice, 0.25) + some(self.head, 0.5) + some(self.menu, 0.7) + some(self.advert, 0.5) + some(self.side, 0.15)
        out += text + some(self.advert, 0.2) + some(self.side, 0.25) + some(self.comments, 0.3) + some(self.form, 0.2) + some(self.notice, 0.1) + some(self.foot, 0.85)
        if self.r.random() < 0.15:
            out = f'<div class="{self.pick("wrapper", "container", "page", "site")}">{out}</div>'
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{out}</body></html>"


def labelled(seed: int, n: int) -> Iterator[tuple[list[Node], np.ndarray]]:
    """Nodes of generated pages, and whether each holds main text."""
    gen = Pages(seed)
    for _ in range(n):
        nodes = walk(parse(gen.page()))
        own = {id(x) for x in nodes if any(isinstance(t, str) and Pages.MARK in t for t in x.parts)}
        good = dict.fromkeys(own, True)
        for x in nodes:
            if id(x) in own:
                while x.parent is not None:
                    x = x.parent
                    good[id(x)] = True
        yield nodes, np.array([float(good.get(id(x), False)) for x in nodes])


@dataclass(frozen=True)
class Extractor:
    """Pages that the trees are trained on, and the seed of their generator."""

    pages: int = 700
    seed: int = 11


@functools.lru_cache(maxsize=2)
def trained(rule: Extractor) -> Boosted:
    x, y = zip(*((features(nodes), good) for nodes, good in labelled(rule.seed, rule.pages)))
    return Boosted(trees=50, depth=4).fit(np.concatenate(x), np.concatenate(y))


def texts(pages: list[str], model: Boosted) -> list[str]:
    trees = [walk(parse(p)) for p in pages]
    if not trees:
        return []
    logits = model.logit(np.concatenate([features(t) for t in trees]))
    out, at = [], 0
    for nodes in trees:
        out.append("\n".join(blocks(nodes[0], decode(nodes, logits[at : at + len(nodes)]))))
        at += len(nodes)
    return out


def extract(pages: DataFrame, rule: Extractor = Extractor(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars.

    Character references are decoded, white space within a block is one space, and blocks
    follow each other by one line break; nothing else is dropped or cut.  A null
    or empty html, or one without main text, gives an empty text.  Ids and urls
    pass through, null or repeated as they are.
    """
    Workspace(pages.sparkSession, "html")
    model = trained(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                found = texts([h or "" for h in part.column("html").to_pylist()], model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
