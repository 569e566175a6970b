"""A tolerant block tree of a web page: elements that make blocks, and runs of text between them."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: Elements whose content is raw text, elements without content, elements that make blocks.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript object ol option p pre section select summary svg table tbody template tfoot thead tr ul video audio canvas button".split())
#: An opening tag of the key ends an open element of the value.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}
#: Elements inside which the rule above does not look further up.
SCOPES = frozenset("ul ol dl table select body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</?([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class Node:
    """A block: name of the element, its class and id words, children; or a run of text (name "")."""

    __slots__ = ("name", "words", "children", "parts", "linked", "shape")

    def __init__(self, name: str, words: str = ""):
        self.name, self.words, self.children, self.parts, self.linked, self.shape = name, words, [], [], 0, -1

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def parse(html: str, marked=lambda words: False) -> Node:
    """The tree under a root node. marked(words): whether an inline element with these class words makes a block as well."""
    root = Node("#root")
    stack, run, link, at, n = [root], None, 0, 0, len(html)
    opened: Counter[str] = Counter()  # names on the stack: an end without its beginning costs no look through it

    def close(i: int) -> None:
        opened.subtract(x.name for x in stack[i:])
        del stack[i:]

    def text(piece: str) -> None:
        nonlocal run
        if run is None:
            if not piece or piece.isspace():
                return
            run = Node("")
            stack[-1].children.append(run)
        run.parts.append(piece)
        if link and piece:
            run.linked += len(piece)

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(unescape(html[at:]))
            break
        if m.start() > at:
            text(unescape(html[at : m.start()]))
        at = m.end()
        name = (m[1] or "").lower()
        if not name:
            continue
        if html[m.start() + 1] == "/":
            if name == "a":
                link = max(0, link - 1)
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
                run = None
            elif name == "p":
                run = None
            continue
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else n
            continue
        words = " ".join(a or b or c for a, b, c in _NAMED.findall(m[2])).lower() if m[2] else ""
        if name == "br" or name in ("td", "th"):
            text(" ")
            continue
        if name == "a":
            link += 1
        if name not in BLOCKS and not (words and name not in VOID and marked(words)):
            continue
        run = None
        if stack[-1].name == "p" and name in BLOCKS:
            close(len(stack) - 1)
        if any(opened[x] for x in ENDS.get(name, ())):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ENDS[name]:
                    close(i)
                    break
                if stack[i].name in SCOPES:
                    break
        if name in VOID or m[2].endswith("/"):
            continue
        node = Node(name, words)
        stack[-1].children.append(node)
        stack.append(node)
        opened[name] += 1
    return root
