"""Main text of HTML pages by a graphical model over the tree of blocks.

Every block element is content or not. Its features (element, words of class and id, links,
length) give it a potential, and each parent and child share one, so a short paragraph
leans on the article around it and an advert inside the article on its own name. Messages
of the sum-product algorithm go up the tree and down again, for all pages of a batch
at once, level by level, and give the exact marginal of each block. The text of blocks
whose marginal is at least one half is the page's main text.

The weights are learnt from the labelled pages in labelled_pages.py by gradient steps on
the exact log-likelihood, whose gradient needs the same marginals. Learning takes about a
second on the driver; pages are scored whole, in batches, without any shuffle.

Nulls and odd pages: a null or empty page has no text; markup that is broken is read as
browsers do in the common cases; text outside all elements belongs to the body; repeated
rows and null ids are extracted like any. Input columns named like the result's give way."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from outvote.functions.arrow import map_in_arrow
from outvote.llm.columns import others
from outvote.llm.dom import HEADINGS, Node, Page, parse
from outvote.llm.labelled_pages import MARK, PAGES
from outvote.llm.text_arrays import chunked

#: Least marginal of content.
CONTENT = 0.5
STEPS, RATE, PENALTY = 300, 0.1, 0.02

# Elements and words of class, id and role that a feature stands for.
TAGS = {
    **dict.fromkeys(("article", "main"), 1),
    **dict.fromkeys(("body", "div", "section", "center", "search", "hgroup"), 2),
    "p": 3,
    **dict.fromkeys(HEADINGS, 4),
    **dict.fromkeys(("ul", "ol", "dl", "dir"), 5),
    **dict.fromkeys(("li", "dt", "dd"), 6),
    **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), 7),
    **dict.fromkeys(("nav", "menu"), 8),
    "header": 9,
    "footer": 10,
    "aside": 11,
    **dict.fromkeys(("form", "fieldset", "legend", "option", "optgroup"), 12),
    **dict.fromkeys(("blockquote", "pre", "figure", "figcaption", "details", "summary"), 13),
    **dict.fromkeys(("dialog", "address"), 14),
}
N_TAGS = 15
NAMES = [
    frozenset("article content post entry story main body text page prose".split()),
    frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs toolbar skip".split()),
    frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense outbrain taboola".split()),
    frozenset("comment comments respond reply replies discussion disqus responses reviews".split()),
    frozenset(
        "cookie cookies consent gdpr notice notification alert alertdialog popup modal overlay newsletter subscribe subscription signup paywall "
        "toast warning disclaimer dialog".split()
    ),
    frozenset("sidebar side aside widget widgets rail complementary related recommended recommendations trending popular more".split()),
    frozenset("share sharing social meta tags byline login search searchbox form contact author rating tools".split()),
    frozenset("footer foot header head masthead copyright contentinfo topbar bottom legal branding logo".split()),
]
FEATURES = N_TAGS + len(NAMES) + 7
EDGE_FEATURES = 5


def features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Of each node, and of its edge to its parent."""
    x, e = np.zeros((len(nodes), FEATURES)), np.zeros((len(nodes), EDGE_FEATURES))
    chars = np.array([n.chars for n in nodes], float)
    linked = np.array([min(n.linked, n.chars) for n in nodes], float)
    words = np.array([n.words for n in nodes], float)
    parent = np.array([n.parent for n in nodes])
    # children come after their parents
    all_chars, all_linked = chars.copy(), linked.copy()
    for i in range(len(nodes) - 1, 0, -1):
        all_chars[parent[i]] += all_chars[i]
        all_linked[parent[i]] += all_linked[i]
    for i, n in enumerate(nodes):
        x[i, TAGS.get(n.tag, 0)] = 1
        e[i, 1] = n.tag in ("p", "li", "pre", "td", "th", "tr") or n.tag in HEADINGS
        if n.names:
            for k, group in enumerate(NAMES):
                if not group.isdisjoint(n.names):
                    x[i, N_TAGS + k] = 1
            e[i, 2] = x[i, N_TAGS + 1 : N_TAGS + len(NAMES)].any()
        e[i, 4] = e[i, 1] and n.parent == 0  # running text right in the body
        e[i, 3] = n.tag in ("nav", "header", "footer", "aside", "form", "menu", "dialog")
        x[i, -1] = n.hidden
    e[:, 0] = 1
    x[:, -7] = 1
    x[:, -6] = all_linked / np.maximum(all_chars, 1)
    x[:, -5] = linked / np.maximum(chars, 1)
    x[:, -4] = np.log1p(words) / 5
    x[:, -3] = np.log1p(all_chars) / 10
    x[:, -2] = words >= 12
    return x, e


@dataclass
class Weights:
    node: np.ndarray  # FEATURES: for content
    edge: np.ndarray  # EDGE_FEATURES x 2 x 2: parent's state, child's state


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def sum_product(node: np.ndarray, edge: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of nodes (n x 2) and of edges to the parent (n x 2 x 2) for log potentials
    of a forest whose roots have depth 0."""
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
    up, sent = node.copy(), np.zeros_like(node)
    for level in reversed(levels[1:]):
        sent[level] = _log_sum(edge[level] + up[level][:, None, :], 2)
        np.add.at(up, parent[level], sent[level])
    down, around = np.zeros_like(node), np.zeros_like(node)
    for level in levels[1:]:
        around[level] = up[parent[level]] + down[parent[level]] - sent[level]
        down[level] = _log_sum(edge[level] + around[level][:, :, None], 1)
    belief = up + down
    belief -= _log_sum(belief, 1)[:, None]
    both = edge + around[:, :, None] + up[:, None, :]
    both -= _log_sum(both.reshape(len(both), 4), 1)[:, None, None]
    both = np.exp(both)
    both[depth == 0] = 0
    return np.exp(belief), both


@dataclass
class Forest:
    x: np.ndarray
    e: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    first: np.ndarray  # each page's first node


def forest(pages: list[Page]) -> Forest:
    made = [features(p.nodes) for p in pages]
    first = np.cumsum([0, *(len(p.nodes) for p in pages)])
    parent = [n.parent + a if n.parent >= 0 else -1 for p, a in zip(pages, first) for n in p.nodes]
    depth = [n.depth for p in pages for n in p.nodes]
    return Forest(np.concatenate([x for x, _ in made]), np.concatenate([e for _, e in made]), np.array(parent), np.array(depth), first)


def marginals(w: Weights, f: Forest) -> tuple[np.ndarray, np.ndarray]:
    node = np.zeros((len(f.x), 2))
    node[:, 1] = f.x @ w.node
    return sum_product(node, np.einsum("nk,kpc->npc", f.e, w.edge), f.parent, f.depth)


def _labels(page: Page) -> list[int]:
    """A node's own mark, or its parent's."""
    found: list[int] = []
    for n in page.nodes:
        found.append(int(n.mark) if n.mark else found[n.parent] if n.parent >= 0 else 0)
    return found


@lru_cache
def train() -> Weights:
    """Adam steps on the penalised log-likelihood of the labelled pages."""
    pages = [parse(html, MARK) for html in PAGES]
    f = forest(pages)
    y = np.array([label for p in pages for label in _labels(p)])
    child = f.depth > 0
    wanted = np.zeros((len(y), 2, 2))
    wanted[np.flatnonzero(child), y[f.parent[child]], y[child]] = 1
    weights = np.zeros(FEATURES + EDGE_FEATURES * 4)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        w = Weights(weights[:FEATURES], weights[FEATURES:].reshape(EDGE_FEATURES, 2, 2))
        node, edge = marginals(w, f)
        slope = np.concatenate((f.x.T @ (y - node[:, 1]), np.einsum("nk,npc->kpc", f.e, wanted - edge).ravel())) - PENALTY * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights = weights + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Weights(weights[:FEATURES], weights[FEATURES:].reshape(EDGE_FEATURES, 2, 2))


def main_texts(w: Weights, pages: list[Page]) -> list[str]:
    if not pages:
        return []
    f = forest(pages)
    content = marginals(w, f)[0][:, 1] >= CONTENT
    return ["\n".join(text for node, text in p.segments if content[a + node]) for p, a in zip(pages, f.first)]


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text (the main text) and n_chars (its code points)."""
    weights = train()
    rows = pages.select(*others(pages, ["text", "n_chars"]))
    kept = [f for f in rows.schema.fields if f.name != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, html_col):
            texts = main_texts(weights, [parse(h) for h in batch.column(html_col).to_pylist()])
            columns = [batch.column(f.name) for f in kept]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *made], [*(f.name for f in kept), "text", "n_chars"])

    return map_in_arrow(rows, run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
