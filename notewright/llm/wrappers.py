"""Main text of web pages by wrapper induction.

Pages are dealt into chunks of CHUNK pages of one host, about, by a hash of the page; a host of any size is spread
over as many chunks as it needs, and which pages meet does not depend on partitions. The block trees of a chunk are
grouped by layout and aligned with a seed page of theirs by simple tree matching (treematch). A slot of the seed whose
text is the same in nearly all aligned pages is template; a slot whose text varies is content. Pages with equal
texts count once, so copies of an article do not turn it into template. The region is the smallest block of the seed
that has nearly all varying text of all pages; its place in each page holds the main text. The names of elements and
classes (article, menus, adverts, comments ...) are a prior: they say what varies and is no main text all the same,
and they decide alone for layouts that fewer than LEAST different pages of a chunk have.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.dom import Node, parse
from notewright.llm.shared import arrow, cut, parts
from notewright.llm.treematch import Shapes, matched, nodes

CHUNK, CHUNK_BYTES = 96, 4 << 20  #: pages of one host, and their characters, that are induced together, about
MOST = 4  #: times that, and a chunk goes in several turns
LEAST, CONSTANT = 6, 0.8  #: of template slots: different pages aligned there, share of the most frequent text
ALIKE, REGION = 0.5, 0.8  #: of the nodes of two pages of one layout; of the varying text that the region has

#: Elements, and words of class, id and role, that are not main text.
DROPPED = frozenset("nav header footer aside form script style noscript template button select option dialog menu svg object video audio canvas head fieldset".split())
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar aside rail widget menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar comment comments commentlist reply replies disqus respond share sharing social related recommended recommendations toolbar login search contentinfo complementary".split())
COMMENTS = frozenset("comment comments commentlist reply replies disqus respond".split())
_WORD = re.compile(r"[a-z0-9]+")
PARAGRAPHS = frozenset("p li dt dd pre blockquote h1 h2 h3 h4 h5 h6 address figcaption legend option summary".split())  #: fixed value: blocks that hold text, not other blocks
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def dropped_words(words: str) -> bool:
    """Whether class, id and role words name something that isn't main text; a header only if it is no article's."""
    found = set(_WORD.findall(words))
    return not found.isdisjoint(DROPPED_WORDS) or "header" in words.split() or not found.isdisjoint({"header"}) and not found.isdisjoint({"site", "page", "main", "top"})


def _runs(tree: Node) -> list[Node]:
    return [n for n in nodes(tree) if n.name == ""]


def _clusters(trees: list[Node], shapes: Shapes) -> list[list[int]]:
    """Numbers of pages of one layout, the seed first: a page joins the first seed that has ALIKE of the smaller one's nodes."""
    counts = [len(_runs(t)) for t in trees]
    middle = sorted(counts)[len(counts) // 2]
    out: list[list[int]] = []
    for i in sorted(range(len(trees)), key=lambda i: (abs(counts[i] - middle), i)):
        own = trees[i].shape
        for cluster in out:
            seed = trees[cluster[0]].shape
            if shapes.weight(seed, own) >= ALIKE * min(shapes.size[seed], shapes.size[own]):
                cluster.append(i)
                break
        else:
            out.append([i])
    return out


def induce(trees: list[Node]) -> tuple[set[int], list[Node | None]]:
    """(ids of the runs of text in template slots, the region of varying text of each page) of pages of one host.

    A page whose layout fewer than LEAST different pages have has no template and no region."""
    shapes = Shapes()
    for t in trees:
        shapes.number_of(t)
    texts = [tuple(r.text for r in _runs(t)) for t in trees]
    template: set[int] = set()
    regions: list[Node | None] = [None] * len(trees)
    for cluster in _clusters(trees, shapes):
        different = {texts[i]: i for i in reversed(cluster)}
        if len(different) < LEAST:
            continue
        seed, counted = trees[cluster[0]], set(different.values())
        aligned = [dict((id(a), b) for a, b in matched(shapes, seed, trees[i])) for i in cluster]
        for run in _runs(seed):
            members = [(i, of[id(run)]) for i, of in zip(cluster, aligned) if id(run) in of]
            seen = Counter(r.text for i, r in members if i in counted)
            text, most = seen.most_common(1)[0] if seen else ("", 0)
            if seen.total() >= LEAST and most >= CONSTANT * seen.total():
                template.update(id(r) for _, r in members if r.text == text)
        region = _region(seed, [_varying(trees[i], template) for i in cluster], aligned)
        for i, of in zip(cluster, aligned):
            regions[i] = of.get(id(region))
    return template, regions


def _varying(tree: Node, template: set[int]) -> dict[int, int]:
    """Code points of text below each block that is no template, no link and in no block that is dropped by name."""
    out: dict[int, int] = {}
    stack: list[tuple[Node, bool, bool]] = [(tree, False, False)]
    while stack:
        n, gone, done = stack.pop()
        if n.name == "":
            out[id(n)] = 0 if gone or id(n) in template else max(0, sum(map(len, n.parts)) - n.linked)
        elif done:
            out[id(n)] = sum(out[id(c)] for c in n.children)
        else:
            gone = gone or _is_dropped(n)
            stack.append((n, gone, True))
            stack.extend((c, gone, False) for c in n.children)
    return out


def _region(seed: Node, varying: list[dict[int, int]], aligned: list[dict[int, Node]]) -> Node:
    """The smallest block that holds REGION of the varying text of all pages; a block beside a varying heading is too small."""

    def weight(n: Node) -> int:
        return sum(v[id(of[id(n)])] for v, of in zip(varying, aligned) if id(n) in of)

    region = seed
    while True:
        total = weight(region)
        blocks = [c for c in region.children if c.name]
        best = max(blocks, key=weight, default=None)
        if best is None or best.name in PARAGRAPHS or weight(best) < REGION * total or not total:
            return region
        if any(c is not best and weight(c) and any(n.name in _HEADINGS for n in nodes(c)) for c in blocks):
            return region
        region = best


def _size(node: Node) -> int:
    return sum(len(r.text) for r in _runs(node))


def _holds_article(node: Node) -> bool:
    """Whether a block has the article or its title below it: then its class words tell of its layout ("has-sidebar")."""
    stack = list(node.children)
    while stack:
        n = stack.pop()
        if n.name in ("article", "main", "h1"):
            return True
        stack.extend(n.children)
    return False


def _is_dropped(node: Node) -> bool:
    if node.name in DROPPED:
        return True
    if not node.words or node.name in ("body", "main") or not dropped_words(node.words):
        return False
    return not COMMENTS.isdisjoint(_WORD.findall(node.words)) or not _holds_article(node)


def _root(tree: Node) -> Node:
    """The element that holds the article: the largest article, else main, else all."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    stack = [tree]
    while stack:
        n = stack.pop()
        if n.name != "form" and _is_dropped(n):
            continue
        if n.name in found or "main" in n.words.split():
            found[n.name if n.name in found else "main"].append(n)
        stack.extend(n.children)
    for name in ("article", "main"):
        if found[name]:
            return max(reversed(found[name]), key=_size)
    return tree


def _place(tree: Node, region: Node | None, template: set[int]) -> tuple[Node, bool]:
    """(the block that holds the main text, whether it is an element that says so).

    The region decides. An article or main element stands for it if it has half of the region's varying text or more,
    and it decides alone where the layout was seen too seldom to have a region."""
    named = _root(tree)
    if region is None:
        return named, named is not tree
    if named is not tree:
        varying = _varying(tree, template)
        inside = {id(n) for n in nodes(named)}
        common = varying[id(region)] if id(region) in inside else sum(varying[id(n)] for n in nodes(region) if n.name == "" and id(n) in inside)
        if 2 * common >= varying[id(region)]:
            return named, True
    return region, False


def main_blocks(tree: Node, template: set[int], region: Node | None = None) -> list[str]:
    """Texts of the blocks of main text in page order."""
    (root, named), out = _place(tree, region, template), []
    stack = [(root, False)]
    while stack:
        n, heading_only = stack.pop()
        if n.name == "":
            text = n.text
            listed = not named and n.linked >= 0.8 * sum(map(len, n.parts))  # a menu without a name
            if text and not heading_only and id(n) not in template and not listed:
                out.append(text)
            continue
        if n is not root:
            if n.name == "header" and root is not tree:
                heading_only = True
            elif _is_dropped(n):
                continue
            elif n.name in _HEADINGS:
                heading_only = False
        stack.extend((c, heading_only) for c in reversed(n.children))
    return out


def extract_chunk(pages: list[str]) -> list[str]:
    """Main texts of pages of one host."""
    trees = [parse(html, dropped_words) for html in pages]
    template, regions = induce(trees)
    return ["\n\n".join(main_blocks(t, template, r)) for t, r in zip(trees, regions)]


_NAMES = ["page_id", "url", "text", "n_chars"]


def _extract(batches):
    """Rows sorted by host, chunk and hash: a chunk at a time, or MOST pages or bytes of it; equal pages are taken once."""
    held: list[tuple] = []
    pages: dict[str, int] = {}  # different pages that are held, with their numbers
    size = 0

    def out():
        texts = extract_chunk(list(pages))
        found = [texts[r[4]] for r in held]
        return pa.RecordBatch.from_arrays([pa.array([r[2] for r in held], pa.int64()), pa.array([r[3] for r in held], pa.string()), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], _NAMES)

    for batch in parts(batches, 50):
        for host, chunk, page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("host", "chunk", "page_id", "url", "html"))):
            if held and ((host, chunk) != held[0][:2] or len(held) >= MOST * CHUNK or size >= MOST * CHUNK_BYTES):
                yield out()
                held, pages, size = [], {}, 0
            if html not in pages:
                pages[html] = len(pages)
                size += len(html)
            held.append((host, chunk, page_id, url, pages[html]))
    if held:
        yield out()


def main_texts(pages: DataFrame) -> DataFrame:
    """One row for each of pages (page_id, url, html): page_id, url, text, n_chars in code points.

    A null or empty html has an empty text; a null or odd url is a host of its own name ("" or the url);
    repeated rows each give a row; other columns are ignored; an empty table gives no rows. What comes out does not
    depend on the number of partitions or the order of rows."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit("")), url)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.lower(host).alias("host"))
    sizes = rows.groupBy("host").agg(F.ceil(F.greatest(F.count("*") / F.lit(CHUNK), F.sum(F.length("html")) / F.lit(CHUNK_BYTES))).cast("int").alias("chunks"))
    # Hosts of more than one chunk: Spark broadcasts the written table if it is small, and can split a host's rows otherwise.
    large = cut(sizes.where("chunks > 1"), "large-hosts")
    order = F.xxhash64("html", "url", "page_id")
    dealt = rows.join(large, "host", "left").withColumn("hash", order).withColumn("chunk", F.pmod("hash", F.coalesce("chunks", F.lit(1))).cast("int"))
    ordered = dealt.repartition("host", "chunk").sortWithinPartitions("host", "chunk", "hash", "html", "url", "page_id")
    return arrow(ordered.select("host", "chunk", "page_id", "url", "html"), _extract, "page_id long, url string, text string, n_chars long")
