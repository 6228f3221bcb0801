"""Main text of web pages by text-to-tag ratios.

The events of the standard library's parser are cut into lines, one per block. A
line's ratio of text to tags, smoothed along the page by a Gaussian, tells content from
boilerplate. Where most content lies in containers (articles, main parts, parts called
content), these bound the text; elsewhere it is a stretch of lines.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA, RADIUS = 1.5, 4
# Containers take the place of what is around them if at most 1/OWN of its content is lost.
OWN = 4

# Element names of HTML, and words that name boilerplate in class and id.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = set(
    "head script style noscript template nav footer aside form button select textarea label iframe object svg canvas math dialog menu audio video".split()
)
# What ends an open element of the given name without an end tag.
ENDED_BY = {
    "p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"},
}
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer foot copyright sidebar side aside rail widget widgets cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup login paywall share sharing social related recommended trending teaser comment comments commentlist respond reply "
    "replies discussion disqus pagination pager toolbar skip toc tags".split()
)
ROLES = set("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
CONTENT = set("content article post entry story main".split())


class Lines(HTMLParser):
    """Lines of a page as ``[text, tags, characters in links, container]``."""

    def __init__(self, trim: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.trim = trim  # whether containers may be boilerplate
        self.lines: list[list] = []
        self.open: list[tuple[str, bool, int]] = []  # name, skipped, container
        self.containers: list[int] = [0]  # rank of each; 0 is the page
        self.parents: list[int] = [-1]
        self.text: list[str] = []
        self.tags = 0
        self.linked = 0

    def state(self) -> tuple[bool, int]:
        return self.open[-1][1:] if self.open else (False, 0)

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append([text, self.tags, self.linked, self.state()[1]])
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, name: str, attrs: list) -> None:
        if name in BLOCKS:
            self.end_line()
        self.tags += 1
        if name in VOID:
            return
        given = {k: (v or "").lower() for k, v in attrs}
        while self.open and name in ENDED_BY.get(self.open[-1][0], ()):
            self.open.pop()
        if name == "body":
            self.open = [x for x in self.open if x[0] == "html"]
        skipped, container = self.state()
        if name in ("article", "main") and skipped and next(x[0] for x in self.open if x[1]) in ("nav", "header"):
            # Nobody puts an article into a menu: an end tag is missing.
            self.open = [x for x in self.open if not x[1]]
            skipped, container = self.state()
        rank = self.rank(name, given)
        # A part of an article is no container of its own, however it is called.
        skipped = skipped or ((self.trim or not rank) and name not in ("html", "body") and self.boilerplate(name, given))
        if rank > self.containers[container] and not skipped:
            self.containers.append(rank)
            self.parents.append(container)
            container = len(self.containers) - 1
        self.open.append((name, skipped, container))

    def rank(self, name: str, given: dict) -> int:
        """3 for an article, 2 for the main part, 1 for what is called content, else 0."""
        if name == "article":
            return 3
        if name == "main" or given.get("role") == "main":
            return 2
        named = re.split(r"\s+", f"{given.get('class', '')} {given.get('id', '')}")
        return int(name in ("div", "section", "td") and any(n in CONTENT or re.fullmatch(r"(article|post|entry|story|main|page)[-_]?(body|content|text)", n) for n in named))

    def boilerplate(self, name: str, given: dict) -> bool:
        if name in SKIPPED or given.get("role") in ROLES or "hidden" in given:
            return True
        if name == "header":
            return self.state()[1] == 0
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
            return True
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return False
        named = re.split(r"\s+", f"{given.get('class', '')} {given.get('id', '')}")
        # The last part of a name says what it is: "site-menu", not "has-menu" or "menu-open".
        parts = [re.split(r"[-_]+", n) for n in named]
        return any(p[-1] in BOILERPLATE and p[0] not in ("has", "no", "with", "article", "post", "entry", "format") or p[0] in ("ad", "ads", "advert", "cookie", "comment", "comments") for p in parts)

    def handle_startendtag(self, name: str, attrs: list) -> None:
        if name in VOID:
            self.handle_starttag(name, attrs)
        else:
            self.handle_starttag(name, attrs)
            if name not in ("div", "p", "section", "article", "main", "span", "a", "b", "i"):
                self.handle_endtag(name)

    def handle_endtag(self, name: str) -> None:
        self.tags += 1
        if name in BLOCKS:
            self.end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                if name not in BLOCKS and any(x[0] in BLOCKS for x in self.open[i + 1 :]):
                    break  # an inline end tag never closes a block
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if not self.state()[0]:
            self.text.append(data)
            if any(name == "a" for name, _, _ in self.open):
                self.linked += len(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean of each value's neighbourhood; borders are weighted by what is there."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, kernel, "full")[RADIUS : RADIUS + len(ratios)] / weight


def parsed(html: str, trim: bool) -> Lines:
    parser = Lines(trim)
    parser.feed(html)
    parser.close()
    parser.end_line()
    return parser


def main_text(html: str | None) -> str:
    """The lines selected, joined by one space; "" for NULL, empty and textless pages.

    Lines count as content where their smoothed ratio exceeds the standard deviation of
    all. While at least three quarters of the content of the page, or of a container, lie
    in containers within it, those with content take its place. A container that is left
    is taken whole, but for containers in it without content. Where the page is left, it
    gives its lines from the first to the last content line, without those that are mostly
    links.
    """
    if not html:
        return ""
    parser = parsed(html, True)
    if not parser.lines:
        # A page whose only container has a boilerplate name.
        parser = parsed(html, False)
    lines, parents = parser.lines, parser.parents
    if not lines:
        return ""
    ratios = smoothed(np.array([len(text) / max(tags, 1) for text, tags, _, _ in lines]))
    content = ratios >= min(float(ratios.std()), float(ratios.max()))
    own = [0] * len(parents)  # characters of content lines
    for (text, _, linked, container), good in zip(lines, content):
        own[container] += len(text) if good and linked * 2 < len(text) else 0
    held = list(own)
    for c in range(len(parents) - 1, 0, -1):
        held[parents[c]] += held[c]
    # Parents come before their parts.
    open_, taken = [True] + [False] * (len(parents) - 1), [False] * len(parents)
    for c in range(1, len(parents)):
        up = parents[c]
        entered = open_[up] and held[c] and own[up] * OWN <= held[up]
        open_[c] = bool(entered)
        taken[c] = bool(held[c] and (taken[up] or entered and not (own[c] * OWN <= held[c])))
    if any(taken):
        return " ".join(line[0] for line in lines if taken[line[3]])
    first, last = np.flatnonzero(content)[[0, -1]]
    return " ".join(text for text, _, linked, _ in lines[first : last + 1] if linked * 2 < len(text))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; repeated rows give equal rows."""

    def read(batches):
        for batch in batches:
            texts = [main_text(html) for html in batch["html"].to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars bigint")
