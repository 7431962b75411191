"""Main text of web pages by boosted trees over DOM nodes.

A page is parsed leniently into its block elements.  Each gets features: the
density of text and links in its subtree, tokens of its attributes, its depth,
and how it stands among its siblings.  Boosted trees give the log-odds that it
belongs to the article.  Decoding over the tree then chooses for each node
whether all of it stays, none of it, or its children are judged one by one, so
that a choice made for a node holds for everything below it.

The trees are trained on pages that :mod:`page_samples` writes with labels,
``TRAINING_PAGES`` of them, in the driver; the model is a few kilobytes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting
from .common import arrow_map, str_values

TRAINING_PAGES = 500
#: What judging children one by one costs, in log-odds.
MIXED_COST = 1.0
#: How much the log-odds of an element without text of its own count.
CONTAINER_WEIGHT = 0.25
#: Elements that form blocks, that hold no prose (of these, whose content is no markup), and that have no content.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template textarea select button svg iframe head title datalist".split())
RAW = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag closes, and what they are not looked for beyond.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
#: Fixed word groups of attribute tokens.
TOKEN_GROUPS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead branding topbar logo tagline banner hero",
    "footer": "footer copyright legal colophon bottom imprint",
    "side": "sidebar side aside widget widgets rail related recommended popular trending tags teaser",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted affiliate dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner-cookie privacy warning message",
    "comment": "comment comments reply replies discussion disqus respond commentlist",
    "form": "form login signup subscribe subscription newsletter search searchbox contact register",
    "share": "share sharing social follow twitter facebook author byline meta print",
    "content": "content article post entry story main body text prose page single maincontent",
}
_GROUP_OF = {word: i for i, words in enumerate(TOKEN_GROUPS.values()) for word in words.split()}
_TAGS = "article main section div p h1 h2 h3 ul ol li nav header footer aside form table td blockquote pre figure figcaption dl address".split()
_TAG_OF = {tag: i for i, tag in enumerate(_TAGS)}
_ABOVE = ("article", "main", "nav", "header", "footer", "aside", "form", "table", "ul")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>?|[^<]++|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)
_STOPS = re.compile(r"[.!?…。]")


class Node:
    __slots__ = ("tag", "parent", "groups", "mark", "depth", "chars", "links", "tags", "runs", "stops", "words", "controls", "children", "at")

    def __init__(self, tag: str, parent: int, depth: int):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.groups, self.mark = 0, ""
        self.chars = self.links = self.tags = self.runs = self.stops = self.words = self.controls = self.at = 0
        self.children: list[int] = []


class Page:
    """Block elements in page order, and runs of text with the block they lie in."""

    def __init__(self, source: str):
        self.nodes: list[Node] = [Node("#page", -1, 0)]
        self.runs: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        nodes, stack = self.nodes, [0]
        buffer: list[str] = []
        links = linked = controls = tags = 0
        place = 0

        def flush() -> None:
            nonlocal links, controls, tags, place
            node = nodes[stack[-1]]
            if buffer:
                text = " ".join(html.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    self.runs.append((stack[-1], text))
                    node.chars += len(text)
                    node.links += min(links, len(text))
                    node.runs += 1
                    node.stops += len(_STOPS.findall(text))
                    node.words += text.count(" ") + 1
                    place += len(text)
            node.controls += controls
            node.tags += tags
            links = controls = tags = 0

        def close(wanted: tuple[str, ...], beyond: tuple[str, ...]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[k]].tag
                if tag in wanted:
                    flush()
                    del stack[k:]
                    return
                if tag in beyond:
                    return

        closings: dict[str, re.Match | None] = {}

        def silent_end(tag: str, at: int) -> int:
            """Where an element without prose ends: by its own end tag, else with the block it is in.

            An end tag behind another start of the element is not its own.  A
            head left open holds nothing.
            """
            if tag not in closings or closings[tag] and closings[tag].start() < at:
                closings[tag] = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            stop = closings[tag]
            if stop and (tag in RAW or tag == "head" or not re.compile(rf"<{tag}(?=[\s/>])", re.I).search(source, at, stop.start())):
                return stop.end()
            if tag == "head":
                return at
            block = _BLOCK_TAG.search(source, at)
            if stop and (not block or stop.start() < block.start()):
                return stop.end()
            return block.start() if block else end

        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.match(source, at)
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                text = m[0]
                if text[0] != "<" or text == "<":
                    buffer.append(text)
                    if linked:
                        links += len(text)
                continue
            tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if tag == "a":
                    linked = max(0, linked - 1)
                elif tag in BLOCKS:
                    close((tag,), () if tag != "p" else ("td", "th", "table"))
                continue
            tags += 1
            if tag in SILENT:
                controls += tag in ("textarea", "select", "button")
                if not attributes.endswith("/") or tag != "svg":
                    at = silent_end(tag, at)
            elif tag in ("br", "hr", "wbr"):
                if tag == "hr":
                    flush()
                elif tag == "br":
                    buffer.append(" ")
            elif tag in VOID:
                controls += tag == "input"
            elif tag == "a":
                linked += 1
            elif tag in BLOCKS:
                close(("p",), ("td", "th", "table", "button"))
                if tag in CLOSES:
                    close(*CLOSES[tag])
                flush()
                node = Node(tag, stack[-1], len(stack))
                node.at = place
                for name, a, b, c in _ATTRIBUTE.findall(attributes):
                    value = (a or b or c).lower()
                    if name.lower() == "data-y":
                        node.mark = value
                        continue
                    for word in _WORDS.findall(value):
                        group = _GROUP_OF.get(word)
                        if group is not None:
                            node.groups |= 1 << group
                nodes[stack[-1]].children.append(len(nodes))
                stack.append(len(nodes))
                nodes.append(node)
        flush()

    def features(self) -> np.ndarray:
        """One row for each node; see the names beside the values."""
        nodes = self.nodes
        n = len(nodes)
        own = [(x.chars, x.links, x.tags + 1, x.runs, x.stops, x.words, x.controls) for x in nodes]
        total = np.array(own, np.float64)
        for i in range(n - 1, 0, -1):  # children stand after their parents
            total[nodes[i].parent] += total[i]
        above = np.zeros(n, np.int64)
        groups = np.zeros(n, np.int64)
        for i in range(1, n):
            x = nodes[i]
            above[i] = above[x.parent] | (1 << _ABOVE.index(x.tag) if x.tag in _ABOVE else 0)
            groups[i] = groups[x.parent] | x.groups
        own_groups = np.array([x.groups for x in nodes])
        page = max(1.0, total[0, 0])
        chars = np.maximum(total[:, 0], 1)
        parent = np.array([max(x.parent, 0) for x in nodes])
        place, siblings, alike, mean = np.zeros(n), np.ones(n), np.ones(n), np.zeros(n)
        for x in nodes:
            if not x.children:
                continue
            kids = np.array(x.children)
            size = len(kids)
            siblings[kids] = size
            place[kids] = np.arange(size) / max(1, size - 1)
            mean[kids] = total[kids, 0].mean()
            tags = [nodes[k].tag for k in x.children]
            counts = {t: tags.count(t) for t in set(tags)}
            alike[kids] = [counts[t] / size for t in tags]
        tag = np.zeros((n, len(_TAGS)))
        for i, x in enumerate(nodes):
            if x.tag in _TAG_OF:
                tag[i, _TAG_OF[x.tag]] = 1
        bits = lambda v, k: np.stack([v >> j & 1 for j in range(k)], axis=1)
        numeric = [
            np.log1p(total[:, 0]),  # text of the subtree
            total[:, 0] / page,  # its share of the page
            total[:, 0] / total[:, 2],  # text for each tag: density
            total[:, 1] / chars,  # share of linked text
            total[:, 5] / np.maximum(total[:, 3], 1),  # words in a run
            total[:, 4] / np.maximum(total[:, 5], 1),  # sentence ends for each word
            total[:, 6] / total[:, 2],  # share of form controls
            np.array([x.depth for x in nodes]),
            np.array([len(x.children) for x in nodes]),
            place, siblings, alike,
            np.log1p(mean),  # text of a sibling
            total[:, 0] / np.maximum(mean, 1),
            np.array([x.at for x in nodes]) / page,  # where in the page's text it begins
            total[:, 0] / np.maximum(total[parent, 0], 1),  # share of the parent's text
        ]
        return np.concatenate([np.stack(numeric, axis=1), tag, bits(above, len(_ABOVE)), bits(own_groups, len(TOKEN_GROUPS)), bits(groups, len(TOKEN_GROUPS))], axis=1)

    def decode(self, z: np.ndarray) -> list[bool]:
        """Whether each run stays, given the log-odds of every node."""
        nodes = self.nodes
        z = np.clip(z, -6, 6)
        held = np.array([x.runs > 0 for x in nodes])
        own = np.where(held, z, CONTAINER_WEIGHT * z)
        all_in, all_out, mixed = own.copy(), -own, np.full(len(nodes), -MIXED_COST)
        mixed[held] += np.abs(z[held])
        for i in range(len(nodes) - 1, 0, -1):
            p = nodes[i].parent
            all_in[p] += all_in[i]
            all_out[p] += all_out[i]
            mixed[p] += max(all_in[i], all_out[i], mixed[i])
        state = [0] * len(nodes)  # 1 all stays, -1 all goes, 0 by its children
        for i, x in enumerate(nodes):
            above = state[x.parent] if i else 0
            if above:
                state[i] = above
            else:
                best = max(all_in[i], all_out[i], mixed[i])
                state[i] = 0 if mixed[i] == best or i == 0 else 1 if all_in[i] == best else -1
        return [state[k] == 1 or state[k] == 0 and z[k] > 0 for k, _ in self.runs]

    def labels(self) -> np.ndarray:
        """1 and 0 for nodes all of whose text is marked so, -1 for all others."""
        nodes = self.nodes
        mark = [""] * len(nodes)
        for i, x in enumerate(nodes):
            mark[i] = x.mark or (mark[x.parent] if i else "0")
        count = np.zeros((len(nodes), 2), np.int64)
        for k, _ in self.runs:
            count[k, int(mark[k] == "1")] += 1
        for i in range(len(nodes) - 1, 0, -1):
            count[nodes[i].parent] += count[i]
        return np.where(count.all(axis=1) | ~count.any(axis=1), -1, (count[:, 1] > 0).astype(np.int64))


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = 7) -> boosting.Trees:
    """The model, trained once in a process on ``pages`` written pages."""
    from .page_samples import sample_pages

    xs, ys = [], []
    for source in sample_pages(pages, seed):
        page = Page(source)
        y = page.labels()
        xs.append(page.features()[y >= 0])
        ys.append(y[y >= 0])
    x, y = np.concatenate(xs), np.concatenate(ys)
    return boosting.fit(x, y.astype(np.float64), np.ones(len(y)))


def main_texts(sources: list[str], model: boosting.Trees) -> list[str]:
    """The kept blocks of each page, one to a line."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    z = model.logits(np.concatenate([p.features() for p in pages]))
    out, at = [], 0
    for p in pages:
        n = len(p.nodes)
        stay = p.decode(z[at : at + n])
        out.append("\n".join(text for (_, text), keep in zip(p.runs, stay) if keep))
        at += n
    return out


def extract(pages: DataFrame, model: boosting.Trees | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    Null html is an empty page, whose text is empty.  Null ids and urls pass
    through; repeated rows give repeated rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = main_texts(str_values(part.column(2)), shared.value)
                yield pa.record_batch(
                    [part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return arrow_map(pages, ["page_id", "url", "html"], run, "page_id long, url string, text string, n_chars long")
