"""Operator 5: main text of pages by a tree-structured graphical model.

The block elements of a page form a tree. Each node is around both (0), article (1) or other (2). The words in
its class, id and role, the size and link share of its own text and of all text below it, the paragraphs and
headings in it and phrases that menus, notices and the like are apt to say give its potential; each pair of
parent and child has another, which depends on the child's tag. Sum-product messages pass up and then down the
tree, for all trees of a batch at once by depth, and give every node its content marginal; text of nodes above
one half is the article (where there is none, of the nodes nearest to it, unless all are very unlikely).
Potentials are smoothed counts over labelled pages of several made layouts (`html_pages`), fitted anew on the
driver in each run.

Blocks are text between boundaries of block elements; inline elements and <br> do not end a block. Character
references are decoded; runs of white space in a block become one space; blocks are joined by one space.

Cases: null and empty pages give an empty text; very long pages and deep nesting have no limit; unclosed,
crossed and unknown elements are read as browsers mostly do; equal pages have equal texts; an empty table
gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import CONTENT, PHRASES, WRAP, labelled_pages
from .html_tree import TOKEN, Tree, parse
from .shared import small_batches

STATES = 3
#: Where no marginal is above one half, texts above half the largest one are taken, if that one is above this.
FAINT = 0.02
#: Characters of a text in which phrases are looked for.
PHRASED = 160
_SAID = re.compile("|".join(rf"(?<!\w){re.escape(w)}(?!\w)" for w in PHRASES))
_LABEL = re.compile(r'data-label="(\d)"')


def words_of(marks: str, said: str) -> list[str]:
    """The distinct words of class, id and role, and those said."""
    words = {w for part in marks.split() for w in TOKEN.findall(part.partition("=")[2] or part) if len(w) > 1}
    return [*sorted("." + w for w in words), *([said] if said else [])]


def text_mark(chars: int, linked: int) -> str:
    if not chars:
        return "none"
    share = linked / max(chars, 1)
    size = 0 if chars < 25 else 1 if chars < 100 else 2 if chars < 400 else 3
    return f"{size}{'a' if share < 0.2 else 'b' if share < 0.7 else 'c'}"


def tree_marks(tree: Tree) -> list[tuple[str, ...]]:
    """(tag, class words, size of own text, of all below, paragraphs and headings in it, phrase) of each node."""
    below, linked, said = list(tree.chars), list(tree.linked), [""] * len(tree.tag)
    for i in range(len(tree.tag) - 1, 0, -1):
        below[tree.parent[i]] += below[i]
        linked[tree.parent[i]] += linked[i]
    inside = [[0, 0] for _ in tree.tag]
    for tag, up in zip(tree.tag, tree.parent):
        if tag == "p" or (len(tag) == 2 and tag[0] == "h" and tag != "hr"):
            inside[up][tag != "p"] += 1
    for node, text in tree.texts:
        # a phrase tells something about a short text only
        if len(text) <= PHRASED and _SAID.search(text.lower()):
            said[node] = "phrase"
    return [(t, m, f"t{text_mark(c, a)}", f"s{text_mark(b, l)}", f"p{min(n[0], 3)}h{min(n[1], 1)}", k) for t, m, c, a, b, l, n, k in zip(tree.tag, tree.marks, tree.chars, tree.linked, below, linked, inside, said)]


class TreeModel:
    """Log potentials: of a pair (parent's state, own state) with the node's tag, of sizes by tag and state, and of words by state."""

    def __init__(self, pages: int = 1500, seed: int = 7, layouts: list[str] | None = None):
        nodes, tags, sizes, words = [], {}, Counter(), Counter()
        for html in labelled_pages(pages, seed, layouts):
            tree, labels = parse(html), self._labels(html)
            nodes += [(labels[tree.parent[i]], labels[i], *own) for i, own in enumerate(tree_marks(tree)) if i]
        pair, total = np.full((STATES, STATES), 0.5), np.zeros(STATES)
        for up, y, tag, marks, own, below, inside, said in nodes:
            pair[up, y] += 1
            total[y] += 1
            tags.setdefault(tag, np.zeros((STATES, STATES)))[up, y] += 1
            for m in (own, below, inside):
                sizes[tag, m, y] += 1
                sizes["", m, y] += 1
            words.update((w, y) for w in words_of(marks, said))
        all_ = sum(tags.values(), np.zeros((STATES, STATES)))
        general = {t: (c.sum(0) + 0.2) / (all_.sum(0) + 0.2 * len(tags)) for t, c in tags.items()}
        self.pair = np.log(pair / pair.sum(1, keepdims=True))
        #: log P(state, tag | parent's state); what is rare for a parent's state falls back on all of them.
        self.tags = {t: self.pair + np.log((c + 3 * general[t]) / (all_ + 3)) for t, c in tags.items()}
        self.sizes = {}
        for tag, m, _ in sizes:
            base = np.array([(sizes["", m, y] + 0.3) / (total[y] + 3) for y in range(STATES)])
            n = tags[tag].sum(0) if tag else total
            self.sizes[tag, m] = np.log([(sizes[tag, m, y] + 4 * base[y]) / (n[y] + 4) for y in range(STATES)])
        self.words = {w: np.log([(words[w, y] + 0.3) / (total[y] + 0.6) for y in range(STATES)]) for w, _ in words}
        self.cache: dict = {}

    @staticmethod
    def _labels(html: str) -> list[int]:
        """The labels of the nodes that parse() makes, in its order (titles are read as raw text)."""
        return [WRAP, *map(int, _LABEL.findall(html))]

    def potential(self, tag: str, marks: str, own: str, below: str, inside: str, said: str) -> np.ndarray:
        """The log potential of a node with the marks that tree_marks gives."""
        key = (tag, marks, own, below, inside, said)
        out = self.cache.get(key)
        if out is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            zero = np.zeros(STATES)
            out = sum((self.words.get(w, zero) for w in words_of(marks, said)), zero)
            for m in (own, below, inside):
                out = out + self.sizes.get((tag, m), self.sizes.get(("", m), zero))
            self.cache[key] = out
        return out

    def edge(self, tag: str) -> np.ndarray:
        """The log potential of (parent's state, own state) for a node with that tag."""
        return self.tags.get(tag, self.pair)

    def content(self, trees: list[Tree]) -> list[np.ndarray]:
        """The content marginal of each node of each tree."""
        sizes = [len(t.tag) for t in trees]
        starts = np.cumsum([0, *sizes])[:-1]
        parent = np.concatenate([np.array(t.parent) + s for t, s in zip(trees, starts)])
        depth = np.concatenate([np.array(t.depth) for t in trees])
        marks = [m for t in trees for m in tree_marks(t)]
        own, pair = np.array([self.potential(*m) for m in marks]), np.array([self.edge(m[0]) for m in marks])
        own[starts] = [0.0, -50.0, -50.0]
        own[starts, WRAP] = 0.0
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1)))
        inside, message = own.copy(), np.zeros_like(own)
        total = lambda x: np.logaddexp.reduce(x, axis=-1)
        for level in levels[:0:-1]:  # upward
            message[level] = total(pair[level] + inside[level][:, None, :])
            np.add.at(inside, parent[level], message[level])
        outside = np.zeros_like(own)
        for level in levels[1:]:  # downward
            up = parent[level]
            rest = inside[up] - message[level] + outside[up]
            outside[level] = total((pair[level] + rest[:, :, None]).transpose(0, 2, 1))
        joint = inside + outside
        p = np.exp(joint[:, CONTENT] - total(joint))
        return [p[s : s + n] for s, n in zip(starts, sizes)]

    def main_texts(self, pages: list[str | None]) -> list[str]:
        trees = [parse(h) for h in pages]
        if not trees:
            return []
        out = []
        for t, p in zip(trees, self.content(trees)):
            # a page has an article, so where no text passes, those nearest to it do
            most = max((p[node] for node, _ in t.texts), default=0.0)
            least = 0.5 if most > 0.5 else most / 2 if most > FAINT else 1.0
            out.append(" ".join(text for node, text in t.texts if p[node] > least))
        return out


def extract(pages: DataFrame, column: str = "html", model: TreeModel | None = None) -> DataFrame:
    """pages with `text`, the main text of the page in `column`."""
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or TreeModel())  # as large as the marks of the labelled pages

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for html in batches:
            out: list[str] = []
            for i in range(0, len(html), 256):
                out += own.main_texts(list(html.iloc[i : i + 256]))
            yield pd.Series(out, dtype=object)

    return pages.withColumn("text", run(column))


def extraction_report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
