"""Trees of the block elements of HTML pages, with the text that stands in each."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKEN = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
#: Elements whose boundaries do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input meta link source".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "p": (set(), set())}
SCOPE = frozenset("html table td th button caption".split())


@dataclass
class Tree:
    """Node 0 is the page. texts are (node, text) in page order; a block's white space is one space each."""

    tag: list[str] = field(default_factory=lambda: ["page"])
    marks: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    texts: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str | None) -> Tree:
    tree = Tree()
    html = html or ""
    stack: list[tuple[str, int]] = [("page", 0)]
    run: list[str] = []
    links = 0
    at, n = 0, len(html)

    def flush() -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                tree.texts.append((stack_node, text))
                tree.chars[stack_node] += len(text)

    stack_node = 0
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            piece = html[at:lt]
            run.append(piece)
            if links:
                tree.linked[stack_node] += len(piece)
        if lt >= n:
            break
        at = lt
        follow = html[at + 1 : at + 2]
        if follow == "!" or follow == "?":
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", at)
                at = n if end < 0 else end + 1
            continue
        m = TAG.match(html, at) or LOOSE.match(html, at)
        if not m:
            run.append("<")
            at += 1
            continue
        at = m.end()
        closing, name = m[1], m[2].lower()
        if closing:
            if name == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if any(t not in INLINE for t, _ in stack[i:]):
                        flush()
                    del stack[i:]
                    stack_node = stack[-1][1]
                    break
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                links += 1
            if name not in VOID:
                stack.append((name, stack_node))
            continue
        # a block begins
        flush()
        if name in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    links = 0
                    break
                if stack[i][0] in SCOPE:
                    break
        if name in SIBLINGS:
            own, stop = SIBLINGS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in own:
                    del stack[i:]
                    links = 0
                    break
                if stack[i][0] in stop:
                    break
        stack_node = stack[-1][1]
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name in VOID:
            continue
        marks = " ".join(f"{a.lower()}={(d or s or u or '').lower()}" for a, d, s, u in ATTRIBUTE.findall(m[3])) if m[3] else ""
        node = len(tree.tag)
        tree.tag.append(name)
        tree.marks.append(marks)
        tree.parent.append(stack_node)
        tree.depth.append(tree.depth[stack_node] + 1)
        tree.chars.append(0)
        tree.linked.append(0)
        if not m[3].endswith("/") or name in ENDS_P:
            stack.append((name, node))
            stack_node = node
    flush()
    return tree
