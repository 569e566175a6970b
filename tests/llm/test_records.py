"""Tool calls, decontamination and pages."""

import hashlib
import json
import os
import random
import re

import pytest

from notewright.llm import decontaminate as D
from notewright.llm.decontaminate import contained_items
from notewright.llm.dom import parse
from notewright.llm.queries import ORACLE_SQL, QUERIES
from notewright.llm.toolcalls import link_tool_calls
from notewright.llm.treematch import Shapes, matched, nodes
from notewright.llm.wrappers import extract_chunk, induce, main_texts

SF = "/root/testdata/sf0.001"

# Tool calls

SCHEMAS = [("add", "a", "BIGINT", True), ("add", "b", "BIGINT", True), ("add", "note", "STRING", False), ("list", "items", "ARRAY", True)]


def link(spark, calls, results):
    c = spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, depends_on array<string>, level long, output string")
    r = spark.createDataFrame(results, "conv_id long, call_id string, output string, name string")
    s = spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")
    return {(x.conv_id, x.call_id): x for x in link_tool_calls(c, r, s).collect()}


def call(conv, i, name="add", arguments='{"b": 1, "a": 2}', needs=None):
    return (conv, i, name, arguments, needs, 0, "x")


def test_links_and_validation(spark):
    got = link(
        spark,
        [call(1, "a"), call(1, "b", arguments='{"a": "x", "c": 1}', needs=["a", "gone"]), call(1, "c", "list", '{"items": [3, {"z": 1, "y": null}]}', ["b"]), call(1, "d", "none"), call(1, "e", arguments="oops"), call(1, "f", arguments=None), call(None, "g"), call(1, "a"), call(2, "a", needs=["a"])],
        [(1, "a", 'say "é"\n', "n"), (1, "a", "zzz", "n"), (1, "zz", "lost", "n"), (None, "a", "q", "n"), (2, "a", None, "n")],
    )
    assert set(got) == {(1, x) for x in ("a", "b", "c", "d", "e", "f", "zz")} | {(2, "a")}
    assert [got[1, x].status for x in ("a", "b", "zz")] == ["linked", "pending", "orphan"]
    assert got[1, "a"].output == 'say "é"\n' and got[1, "a"].valid
    assert json.loads(got[1, "a"].canonical) == {"arguments": {"a": 2, "b": 1}, "name": ["add"], "output": ['say "é"\n']}
    assert got[1, "a"].canonical.startswith('{"arguments":{"a":2,"b":1}')
    assert got[1, "b"].problems == "missing b,type a,unknown c" and got[1, "b"].n_missing == 1
    assert got[1, "c"].valid and '{"items":[3,{"y":null,"z":1}]}' in got[1, "c"].canonical
    assert got[1, "d"].problems == "unknown tool" and got[1, "e"].problems == got[1, "f"].problems == "not an object"
    assert [got[1, x].level for x in "abc"] == [0, 1, 2]
    assert got[2, "a"].level is None  # depends on itself


@pytest.mark.parametrize("most", [1, 3])
def test_levels(spark, most):
    """Longest chains, with one dependence each (doubling) and with several (release by level); cycles have none."""
    r = random.Random(most)
    needs = {i: sorted({str(r.randrange(i)) for _ in range(r.randint(0, most))}) if i else [] for i in range(40)}
    needs |= {40: ["42"], 41: ["40"], 42: ["41"], 43: ["42"]}
    got = link(spark, [call(9, str(i), needs=n) for i, n in needs.items()], [])

    def level(i):
        return 1 + max(level(int(n)) for n in needs[i]) if needs[i] else 0

    assert {i: got[9, str(i)].level for i in needs} == {i: level(i) for i in range(40)} | dict.fromkeys(range(40, 44))


def test_one_conversation_with_long_chains_and_many_that_need_one(spark):
    """Hot keys: chains of 300 calls, 200 calls on one call; very long and repeated arguments."""
    long = json.dumps({"a": 1, "b": 2, "note": "x" * 200_000})
    calls = [call(1, str(i), needs=[str(i - 1)] if i else []) for i in range(300)] + [call(1, f"f{i}", needs=["7"]) for i in range(200)] + [call(1, "long", arguments=long)] * 3
    got = link(spark, calls, [(1, "long", "y" * 100_000, "n")] * 2)
    assert len(got) == 501 and all(got[1, str(i)].level == i for i in range(300)) and all(got[1, f"f{i}"].level == 8 for i in range(200))
    assert got[1, "long"].valid and json.loads(got[1, "long"].canonical)["arguments"]["note"] == "x" * 200_000


def test_no_calls(spark):
    assert link(spark, [], []) == {}


# Decontamination


def brute(docs, items, width=5, num=8, den=10):
    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]

    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = set()
    for item, text in items:
        w = words(text)
        k = min(len(w), width)
        if not k or item is None:
            continue
        g = grams(w, k)
        for doc, t in docs:
            n = len(g & grams(words(t), k))
            if doc is not None and n * den >= len(g) * num:
                out.add((doc, item, n, len(g)))
    return out


def test_containment(spark, make):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 8, 10, 14, 20, 31, 35, 60, 120, 200])]
    items += [(50, "same words same words same words same words same"), (51, None), (52, " ,. "), (None, "v1 v2 v3 v4 v5"), (1, items[1][1])]
    texts = [None, "", "v1"]
    for _ in range(120):
        w = items[r.randrange(14)][1].split()
        for _ in range(r.randint(0, 1 + len(w) // 30)):
            k = r.randrange(len(w))
            w[k : k + r.choice([0, 1, 1, 2])] = [r.choice(vocabulary)] * r.choice([0, 1])
        w = w[r.randint(0, 1 + len(w) // 10) :] or ["x"]
        front = [r.choice(vocabulary) for _ in range(r.randint(0, 400))]
        texts.append(" ".join(front) + ", " + " ".join(w).upper() + ". " + " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 400))))
    texts += [items[9][1] + " " + "filler " * 30_000, "same words " * 40]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, minimum int")
    expected = brute(list(enumerate(texts)), items)
    got = contained_items(make(texts), table).collect()
    assert {(x.doc_id, x.item_id, x.n_shared, x.n_item) for x in got} == expected and len(got) == len(expected) > 60


def test_containment_by_shuffle(spark, make, monkeypatch):
    """The same rows, when signatures are too large for a broadcast."""
    monkeypatch.setattr(D, "BROADCAST", 0)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate((12, 3, 1, 40, 7, 5))]
    texts = [f"before {t} after" for _, t in items] + ["before w3x0 w3x1 w3x2 w3x3 w3x4", items[0][1] + " x " + items[3][1]]
    frame = contained_items(make(texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id, x.n_shared, x.n_item) for x in frame.collect()} == brute(list(enumerate(texts)), items)
    assert "BroadcastExchange" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_items_in_fragments_are_found(spark, make):
    """Recall is 1: shingles in fragments of one to three, in any order, with edits between them."""
    r = random.Random(12)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(n))) for i, n in enumerate((10, 25, 60, 200))]
    texts = []
    for _, t in items:
        w = t.split()
        for step in (1, 2, 3):
            fragments = [w[k : k + 4 + step] for k in range(0, len(w) - 4, step)]
            for lost in (0, 0.1, 0.15, 0.2, 0.3):
                kept = [f for f in fragments if r.random() >= lost]
                r.shuffle(kept)
                texts.append(" zz ".join(" ".join(f) for f in kept))
    expected = brute(list(enumerate(texts)), items)
    got = contained_items(make(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id, x.n_shared, x.n_item) for x in got} == expected and 30 < len(expected) < len(texts)


def test_containment_of_nothing(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contained_items(make(["a b c d e"]), none).count() == 0
    assert contained_items(make([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_native_plans_have_no_python(spark, make):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    calls = spark.createDataFrame([call(1, "a"), call(1, "b", needs=["a"])], "conv_id long, call_id string, name string, arguments string, depends_on array<string>, level long, output string")
    results = spark.createDataFrame([(1, "a", "x")], "conv_id long, call_id string, output string")
    schemas = spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")
    for frame in (contained_items(make(["a"]), items), link_tool_calls(calls, results, schemas)):
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().executedPlan().toString())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    from tests.test_queries import TABLES, same

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(QUERIES[name](spark, SF).toPandas(), connection.execute(ORACLE_SQL[name]).df())


# Pages


def page(i, body, extra=""):
    return f'<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var x="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu {i}</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- ad -->{extra}<article><h1>Title {i}</h1>{body}<div class="ad">Buy {i}</div><form>name <input></form><section id="comments"><p>nice {i}</p></section></article><aside>side</aside><footer>&copy; {i}</footer></body></html>'


def test_article():
    got = extract_chunk([page(1, "<p><b>A &amp; b&nbsp;\n c<br>d<p>Two <i>wo</i>rds</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table>")])
    assert got == ["Title 1\n\nA & b c d\n\nTwo words\n\nx\n\ny\n\n1 2"]


def test_constant_slots_are_template():
    pages = [page(i, f"<p>Text of {i} and {i * i}</p><p>Share this with your friends</p><p>More {i}</p>") for i in range(12)]
    assert extract_chunk(pages) == [f"Title {i}\n\nText of {i} and {i * i}\n\nMore {i}" for i in range(12)]
    copies = [page(1, "<p>Same article</p>")] * 12
    assert extract_chunk(copies) == ["Title 1\n\nSame article"] * 12


def test_pages_without_an_article():
    html = "<body><div class=menu><a href=x>Home</a></div><div><p>Main words</p><ul><li><a href=1>only a link</a></li></ul></div><div id=footer>f</div>"
    assert extract_chunk([html, "", "plain", "<p>open <b>never closed", "<main><p>in main</p></main><p>out</p>"]) == ["Main words", "", "plain", "open never closed", "in main"]


def test_layout_words_of_what_holds_the_article():
    body = "<div class='site has-sidebar'><main class=with-comments><article class='post menu-open'><h1>T</h1><p>x</p></article><div id=comments><article class=comment><h1>Re</h1><p>much longer than the article itself</p></article></div></main><div class=sidebar>s</div></div>"
    assert extract_chunk([f"<body class='no-sidebar'>{body}</body>", f"<body>{body.replace('article', 'div')}"]) == ["T\n\nx"] * 2


def test_odd_markup():
    (outer,) = parse("<div><p>a<div>b</p>c</div><a href='>'>d</a><script>x</").children
    assert [c.name for c in outer.children] == ["p", "div", ""] and outer.children[2].text == "d"
    for html in ("<" * 50_000, "<p>" * 30_000, "<a href=\"" * 20_000, "&#x110000;&#0;&bogus;", "</p></div>" * 1000, "<!-- " * 10_000):
        assert isinstance(extract_chunk([html])[0], str)


def test_pages_frame(spark):
    hosts = ["https://a.org/x", "http://b.org:80/y", None, "no url"]
    rows = [(i if i else None, hosts[i % 4], page(i, f"<p>Words {i}</p>") if i % 5 else [None, ""][i % 2], i, "x") for i in range(700)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, host string")
    got = {x.page_id: x for x in main_texts(frame).collect()}
    assert len(got) == 700
    for i in range(1, 700):
        text = f"Title {i}\n\nWords {i}" if i % 5 else ""
        assert (got[i].url, got[i].text, got[i].n_chars) == (hosts[i % 4], text, len(text))
    assert main_texts(frame.limit(0)).count() == 0


def plain_matching(a, b):
    """Simple tree matching as it is defined: the number of matching nodes of two trees."""
    if (a.name, a.words) != (b.name, b.words):
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + plain_matching(x, y))
    return 1 + m[-1][-1]


def random_html(r, depth=0):
    out = []
    for _ in range(r.randint(0, 4 if depth else 5)):
        kind = r.random()
        if kind < 0.4 or depth > 3:
            out.append(r.choice(["<p>a</p>", "<p></p>", "<ul><li>x</ul>", "text<br>", "<div></div>"]))
        else:
            name = r.choice(["div", "div", "section"])
            out.append(f"<{name} class='{r.choice(['', '', 'k'])}'>{random_html(r, depth + 1)}</{name}>")
    return "".join(out)


def test_matching_is_simple_tree_matching():
    r, shapes, seen = random.Random(5), Shapes(), set()
    trees = [parse(random_html(r)) for _ in range(45)]
    for t in trees:
        shapes.number_of(t)
    for a in trees:
        for b in trees:
            best = plain_matching(a, b)
            pairs = matched(shapes, a, b)
            assert shapes.weight(a.shape, b.shape) == len(pairs) == best
            assert all((x.name, x.words) == (y.name, y.words) for x, y in pairs)
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == best
            seen.add(best)
    assert len(seen) > 15


def test_deep_and_wide_pages():
    """Seven pages of one host, so they are aligned: nested 20,000 deep, 20,000 paragraphs, and 20,000 blocks of many shapes."""
    r = random.Random(3)
    deep = [f"<div>" * 20_000 + f"<p>words of page {i}</p>" for i in range(7)]
    assert extract_chunk(deep) == [f"words of page {i}" for i in range(7)]
    wide = ["<article>" + "".join(f"<p>t{i} {j}</p>" for j in range(20_000 - i)) + "</article>" for i in range(7)]
    assert [t.count("\n\n") for t in extract_chunk(wide)] == [19_999 - i for i in range(7)]
    mixed = ["<article>" + "".join(r.choice([f"<p>{i} {j}</p>", f"<ul><li>{i}a{j}<li>b{j}</ul>", f"<div><p>{i}x{j}</p></div>", f"<div><ul><li>{i}y{j}</ul></div>"]) for j in range(5000)) + "</article>" for i in range(7)]
    assert all(len(t) > 20_000 for t in extract_chunk(mixed))


def without_names(html):
    """The page with plain blocks for all elements that tell, and without classes."""
    html = re.sub(r"<(/?)(?:article|nav|footer|header|aside|section|main)\b[^>]*>", r"<\1div>", html)
    return re.sub(r" (?:class|id|role)=(?:\"[^\"]*\"|[^\s>]+)", "", html)


def test_induction_finds_the_text_without_names():
    """Sample pages without telling names: what varies in the region is the article; without induction all of the page is left."""
    import duckdb

    hosts = {}
    for url, html in duckdb.sql(f"SELECT url, html FROM '{SF.replace('0.001', '0.01')}/pages.parquet' ORDER BY page_id").fetchall():
        hosts.setdefault(url.split("/")[2], []).append(html)
    right = alone = total = 0
    for pages in (p for p in hosts.values() if len(p) >= 6):
        named = extract_chunk(pages)
        plain = [without_names(h) for h in pages]
        right += sum(a == b for a, b in zip(named, extract_chunk(plain)))
        alone += sum(a == b for a, b in zip(named, (extract_chunk([h])[0] for h in plain)))
        total += len(pages)
    assert total > 100 and right > 0.95 * total and alone == 0


def test_layouts_of_a_host_are_told_apart():
    """Two layouts with constant blocks of their own and no names."""
    a = [f"<div><p>Home page of this site</p><ul><li>one<li>two</ul></div><div><h1>A {i}</h1><p>first {i * 7}</p><p>second {i}</p></div><div><p>Write to us</p></div>" for i in range(8)]
    b = [f"<table><tr><td><div><dl><dt>Shop</dt><dd>Cart</dd></dl></div><tr><td><section><h2>B {i}</h2><blockquote>price {i}</blockquote></section><tr><td><form>x</form><dl><dt>Terms</dt></dl></table>" for i in range(8)]
    pages = [x for pair in zip(a, b) for x in pair]
    assert extract_chunk(pages) == [x for i in range(8) for x in (f"A {i}\n\nfirst {i * 7}\n\nsecond {i}", f"B {i}\n\nprice {i}")]
    template, regions = induce([parse(h) for h in pages])
    assert template and all(regions)


def test_pages_do_not_depend_on_partitions(spark):
    rows = [(i, f"https://h{i % 3}.org/{i}", page(i, f"<p>Words {i}</p><p>{'Read more below' if i % 3 == 0 else 'x' * (i % 9)}</p>")) for i in range(400)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    results = []
    for k, n in enumerate((1, 3, 11)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, main_texts(frame.repartition(n + k)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1] == results[2] and len(results[0]) == 400
    assert sum("Read more" in r[2] for r in results[0]) == 0


def test_repeated_pages(spark):
    frame = spark.createDataFrame([(1, "https://a.org/", page(1, "<p>x</p>"))] * 300, "page_id long, url string, html string")
    assert {(r.text, n) for r, n in main_texts(frame).groupBy("text").count().rdd.map(lambda r: (r, r["count"])).collect()} == {("Title 1\n\nx", 300)}


def test_hash_of_canonical_is_stable(spark):
    a = link(spark, [call(1, "a", arguments='{"b":1,  "a":2}')], [])[1, "a"].canonical
    b = link(spark, [call(1, "a", arguments='{"a":2,"b":1}')], [])[1, "a"].canonical
    assert hashlib.sha256(a.encode()).digest() == hashlib.sha256(b.encode()).digest()
