"""Components, URL decisions, near-duplicate texts and vectors, and HTML text."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import numpy as np
import pytest

from flowloom.llm import html_text as H
from flowloom.llm import near_dedup as N
from flowloom.llm.common import components
from flowloom.llm.url_filter import judge_pages, page_links
from flowloom.llm.vector_neighbours import linked_pairs, near_vectors
from tests.conftest import SMALL

PAGES = "page_id long, url string, html string, host int, rule int"


def classes(edges, nodes=()):
    parent = {n: n for e in edges for n in e} | {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("kind", ["path", "star", "random", "empty"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(7, i) for i in range(40) if i != 7],
        "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)],
        "empty": [],
    }[kind]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame([*edges, (5, 5), (None, 3)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == classes(edges)



BODY = "<article><h1>Head line</h1><p>Text body of the page</p></article>"


@pytest.mark.parametrize("wrapper", ['form id="aspnetForm"', 'div class="has-sidebar"', 'div class="page no-sidebar"', 'div class="overflow-hidden"', 'div class="search-results"', 'div id="site-navigation"'])
def test_html_article_in_a_furniture_wrapper(wrapper):
    page = f"<body><{wrapper}><nav><a href=x>Home</a></nav>{BODY}<div class='related'><article><p>other news to read</p></article></div></{wrapper.split()[0]}></body>"
    assert H.main_text(page, {}) == "Head line Text body of the page"
    bare = f"<body><{wrapper}><p>Text body of the page</p></{wrapper.split()[0]}></body>"
    assert H.main_text(bare, {}) == ("" if wrapper.startswith("form") or "search" in wrapper or "navigation" in wrapper else "Text body of the page")


TOWN = "<p>The bridge over the river will be built next year, the council says.</p>"
SAID = "The bridge over the river will be built next year, the council says."


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<nav><a>Home</a></nav><article><h1><a href=x>Bridge plan</a></h1>{TOWN}</article>", f"Bridge plan {SAID}"),
        (f"<article>{TOWN}<p><a href=x>Read the plan</a></p></article><footer>Imprint</footer>", f"{SAID} Read the plan"),
        (f"<article>{TOWN}<p>Sources: <a href=x>the town paper</a></p></article>", f"{SAID} Sources: the town paper"),
        (f"<article>{TOWN}<ul><li>one</li><li>two</li><li>six</li></ul></article>", f"{SAID} one two six"),
        (f"<article>{TOWN}<table><tr><td>1</td><td>2</td></tr><tr><td>30</td></tr></table></article>", f"{SAID} 1 2 30"),
        (f"<div><p>Weather today is fine and warm in all parts of the land</p></div><article>{TOWN}</article>", SAID),
        (f"<article>{TOWN}</article><div class=voices><p>Anna writes that this is far too dear and far too late for all of us here</p></div>", SAID),
        (f"<main>{TOWN}<aside>Other news of the day</aside>{TOWN}</main>", f"{SAID} {SAID}"),
        (f"<div class=related><article>Teaser words</article></div>{TOWN * 3}", f"{SAID} {SAID} {SAID}"),
    ],
)
def test_html_edges_of_a_marked_article(page, text):
    assert H.main_text(f"<html><body>{page}</body></html>", {}) == text


def test_html_broken_markup_costs_what_it_is_long():
    size = 4000
    pages = {
        "<a " + "\"x'y" * size: None, "<a b " * size: None, "<svg " * size: None, "<svg>" * size: "", "<!--" * size: "",
        "<p title='" * size: None, '<p title="x>' * (size + 1): None, "<script>" * size: "", "<" * size: "<" * size,
        "<div>" * size + "</section>" * size + "word": "word", "<p class=" + " a" * size + ">word</p>": "word",
    }
    began = time.perf_counter()
    for page, text in pages.items():
        got = H.main_text(page, {})
        assert text is None or got == text
    assert time.perf_counter() - began < 5


def test_html_scanner_and_quotes():
    assert H.main_text("<p title='a > b'>one</p><p data-x = \"c>d\">two</p><p it's>three</p><p x=\"open>four</p>", {}) == "one two three four"
    assert H.main_text("1 < 2 and 3 <4 but <b>5</b> > 4 <unclosed", {}) == "1 < 2 and 3 <4 but 5 > 4 <unclosed"


def best_stretch(sequence, values):
    """Largest sum over all contiguous stretches, by trying them all."""
    return max((sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=0.0)


def test_html_region_is_a_best_scoring_one():
    rng = random.Random(11)
    pieces = ["<p>plain words of a text</p>", "<nav><a>Home</a></nav>", "<div>", "</div>", "<ul><li>x</li></ul>", "<h2>Head</h2>", "<a>link to it</a>", "<aside>advert words here</aside>", "<b>bold</b>"]
    for _ in range(40):
        page = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        sequence = H.elements(page)
        values = [H.weight(f) * (n if f[0] == "w" else 1) for f, _, n, _ in sequence]
        best = best_stretch(sequence, values)
        got = H.main_text(page, {})
        stretches = {
            " ".join("".join(t for f, t, _, _ in sequence[i:j] if f != "w:furniture").split())
            for i in range(len(values)) for j in range(i + 1, len(values) + 1) if abs(sum(values[i:j]) - best) < 1e-9
        }
        assert got in stretches if best > 0 else got == ""


def test_html_repeated_rows_and_no_rows(spark):
    page = f"<article>{TOWN}</article>"
    rows = H.extract_text(spark.createDataFrame([(1, "u", page, 1, 2)] * 2 + [(None, None, None, 1, 2)], PAGES)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(1, "u", SAID, len(SAID))] * 2 + [(None, None, "", 0)], key=repr)
    assert H.extract_text(spark.createDataFrame([], PAGES)).collect() == []


def test_html_counted_odds_overrule_the_names(spark):
    words = " ".join(["some words here"] * 30)
    labelled = [f"<form id=aspnetForm><nav>menu words</nav><article><p>{words}</p></article></form>"] * 5
    plain = "<form id=aspnetForm><nav>menu words</nav><div><p>text without a label</p></div></form>"
    pages = spark.createDataFrame([(i, "u", h, 1, 2) for i, h in enumerate([*labelled, plain])], PAGES)
    got = {r["page_id"]: r["text"] for r in H.extract_text(pages).collect()}
    assert got == {**{i: words for i in range(5)}, 5: "text without a label"}


def test_html_head_and_drawings_end_where_they_end():
    cases = {
        f"<html><head><title>t</title><meta charset=utf-8><body>{BODY}</body></html>": "Head line Text body of the page",
        f"<html><head><title>t</title><link rel=x href=y><script>var a = '<p>';</script>{BODY}": "Head line Text body of the page",
        '<p>a<svg class="i"/>b</p>': "ab",
        "<article><p>before <svg viewBox='0 0 1 1' /> after</p><svg><text>no</text></svg><p>last</p></article>": "before after last",
        "<article><p>before <svg><path d='m0'><text>no</text></p><p>last words of it</p></article>": "before last words of it",
        "<article><p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='tex'>x=1</annotation></semantics></math> holds<math/> always</p></article>": "so x=1 holds always",
        "<article><p>see <object data='a.pdf'>the printed page</object> for more</p></article>": "see the printed page for more",
    }
    assert [H.main_text(page, {}) for page in cases] == list(cases.values())


# --- URLs -----------------------------------------------------------------------


def test_url_rules_and_aliases(spark):
    def link(url):
        return f'<html><head><link href="{url}" rel="canonical"></head>'

    rows = [
        (1, "http://a.NET/x", None),
        (2, "http://a.net", ""),
        (3, "https://www.example.net/en/5?q=1#f", "<p>"),
        (4, "http://mynet/x", "x"),
        (5, "http://b.com/1", link("http://spam.net/9")),
        (6, "http://c.com/2", link("http://b.com/1")),
        (7, "http://d.com/3", '<meta http-equiv="refresh" content="0; url=/4">'),
        (8, "http://d.com/4", link("http://example.net/en/ok") + '<meta http-equiv=refresh content="0;url=http://e.net/1">'),
        (9, "no scheme", link("http://spam.net/9")),
        (10, None, link("http://spam.net/9")),
        (11, "http://example.com/de/", None),
        (12, "http://x.org/fr/1", link("http://spam.net/9")),
        (1, "http://a.NET/x", None),
        (13, "http://f.com/1", link("//b.com/1")),
    ]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], PAGES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_pages(pages).collect()}
    assert judge_pages(pages).count() == len(rows)
    assert got == {
        1: ("a.net", "/x", "net/", "block"),
        2: ("a.net", "", None, "allow"),
        3: ("www.example.net", "/en/5", "example.net/en/", "allow"),
        4: ("mynet", "/x", None, "allow"),
        # spam.net/9 is blocked, but its component holds an explicit allow (page 12)
        5: ("b.com", "/1", None, "allow"),
        6: ("c.com", "/2", None, "allow"),
        7: ("d.com", "/3", None, "allow"),
        8: ("d.com", "/4", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("", "", None, "allow"),
        11: ("example.com", "/de/", "example.com/de/", "block"),
        12: ("x.org", "/fr/1", "org/fr/", "allow"),
        13: ("f.com", "/1", None, "allow"),
    }
    blocked = judge_pages(pages.where("page_id <> 12"))
    assert {r["page_id"] for r in blocked.where("verdict = 'block'").collect()} == {1, 5, 6, 11, 13}
    assert judge_pages(pages.limit(0)).count() == 0


def test_url_targets_are_decoded_whole_and_resolved(spark):
    def refresh(content):
        return f'<head><meta http-equiv="refresh" content="{content}"></head>'

    cases = [
        (refresh("0; url=http://a.com/x?p=1&amp;q=2"), ["a.com/x?p=1&q=2"]),
        (refresh("0;URL='http://a.com/x;jsessionid=5?p=1'"), ["a.com/x;jsessionid=5?p=1"]),
        (refresh("0; url=http://a.com/?x=1&#38;y=&#x32;&copy=3&ampx=4"), ["a.com/?x=1&y=2&copy=3&ampx=4"]),
        ("<meta http-equiv=refresh content=0;url='/m;n'>", ["h.com/m;n"]),
        (refresh("5"), []),
        (refresh("0; url=page2.html"), ["h.com/d/page2.html"]),
        (refresh("0; url=../x"), ["h.com/x"]),
        (refresh("0; url=?id=1"), ["h.com/d/p?id=1"]),
        ("<link rel=canonical href=./a/../../../b/./c/..>", ["h.com/b/"]),
        ('<link rel="canonical" href="page 2?u=/x/../y#f">', ["h.com/d/page 2?u=/x/../y"]),
        ('<link rel="canonical" href="mailto:me@h.com">', []),
        ('<!-- <link rel="canonical" href="http://x.net/"> --><link rel="canonical" href="/real">', ["h.com/real"]),
        ("<script>var t = '<link rel=canonical href=http://x.net/>';</SCRIPT ><p>no link</p>", []),
        ("<template><link rel=canonical href=http://x.net/></template><style>" + refresh("0; url=/a") + "</style>", []),
        ("<!-- never closed <link rel=canonical href=http://x.net/>", []),
        ('<link rel="canonical" href="/k&#233;">' + refresh("0; url=//I.com/"), ["h.com/k\u00e9", "i.com/"]),
    ]
    pages = spark.createDataFrame([(i, "http://H.com/d/p?q=1", h, 1, 2) for i, (h, _) in enumerate(cases)], PAGES)
    got = {r["page_id"]: r["targets"] for r in page_links(pages).collect()}
    assert got == {i: targets for i, (_, targets) in enumerate(cases)}
    rows = [(1, "http://a.com/d/1", refresh("0; url=../x?p=1&amp;q=2")), (2, "http://a.com/x?p=1&q=2", '<link rel="canonical" href="http://spam.net/;s=1">')]
    judged = judge_pages(spark.createDataFrame([(*r, 1, 2) for r in rows], PAGES))
    assert {r["page_id"]: r["verdict"] for r in judged.collect()} == {1: "block", 2: "block"}


def test_url_plan_has_no_python(spark):
    plan = judge_pages(spark.read.parquet(f"{SMALL}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- near-duplicate texts -------------------------------------------------------


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_documents(rows):
    sets = [shingle_set(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    edges = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                edges.add((rows[i][0], rows[j][0]))
    group = classes([e for e in edges if e[0] != e[1]], [d for d, _ in rows])
    return {d: (len(s), group[d], group[d] == d) for (d, _), s in zip(rows, sets, strict=True)}


def check_documents(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, n int, node int, kept int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs).collect()}
    assert got == brute_documents(rows)


def test_near_duplicates_of_a_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_documents(spark, rows)


def test_near_duplicates_in_a_hot_group(spark, monkeypatch):
    """Copies that differ in few to many words, in blocks and tiles of a few rows."""
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "TILE", 4)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for d in range(70):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((d + 100, " ".join(words)))
    rows += [(1, ""), (2, None), (3, "  \n"), (4, "A b"), (5, "a  B"), (6, "a b c d e"), (7, "A B c d E"), (8, "long " * 20000), (9, "Long " * 20000)]
    check_documents(spark, rows)


def test_near_duplicates_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "A B C D E F"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in N.near_duplicates(docs).collect())
    assert got == [(-1, 0, -1, True), (-1, 2, -1, True), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False)]
    assert N.near_duplicates(docs.limit(0)).count() == 0


# --- near-duplicate vectors -----------------------------------------------------


def brute_vectors(rows, threshold=0.93):
    good = []
    for k, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((k, np.asarray(v, float), label))
    links = defaultdict(int)
    edges = []
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[rows[i][0]] += 1
                links[rows[j][0]] += 1
                edges.append((rows[i][0], rows[j][0]))
    group = classes(edges, [r[0] for r in rows])
    return {r[0]: (links[r[0]], group[r[0]], group[r[0]] == r[0]) for r in rows}


@pytest.mark.parametrize("block", [7, 4096])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1):
        centres = rng.normal(size=(6, 24))
        for k in range(60):
            v = centres[k % 6] + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.25, 0.4])
            rows.append((len(rows) + 10, [float(np.float32(x)) for x in v], label))
    rows += [(1, rows[0][1], None), (2, None, 0), (3, [0.0] * 24, 0), (4, [float("nan"), *rows[0][1][1:]], 0), (5, [None, *rows[0][1][1:]], 0)]
    rows += [(6, rows[0][1][:5], 0), (7, [], 0), (8, [2 * x for x in rows[0][1]], 0), (9, [float("inf")] * 24, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rep int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df, block=block).collect()}
    assert got == brute_vectors(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_early_stop_loses_no_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 64)) * np.linspace(2, 0.1, 64)
    x[40:] = x[:40] + 0.1 * rng.normal(size=(40, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = linked_pairs(x, x, 0.93)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.93)), strict=True))


# --- HTML -----------------------------------------------------------------------

CASES = {
    None: "",
    "": "",
    "just words &amp; more": "just words & more",
    "<html><head><title>t</title></head><body><nav><a href=x>Home</a> <a>About us all</a></nav><article><h1>Head&nbsp;line</h1>\n<p>One <b>tw</b>o&lt;3</p><p>three<br>four</p>"
    "</article><footer>&copy; me and you</footer></body>": "Head line One two<3 three four",
    "<article><p>Start of it all</p><aside>related things to read</aside><div class='ad-box'>buy this now</div><p>end of it all</p></article>": "Start of it all end of it all",
    "<body><div id='cookie-notice'>We use cookies here</div><header><h2>Site name</h2></header><main><header><h1>Title here</h1></header><p>Text body of the page</p></main>"
    "<section class='comments'><p>First reader says hello</p></section><form><label>Name</label><button>Send</button></form></body>": "Title here Text body of the page",
    "<article><p>before the script <script>var a = '</p><p>';</script>after it<!-- no > --> done</p><style>p{}</style></article>": "before the script after it done",
    "<article><p>unclosed comment follows here <!-- lost": "unclosed comment follows here",
    "<p>a < b and c > d &unknown; &am": "a < b and c > d &unknown; &am",
    "<nav>only menu words here</nav>": "",
}


def test_html_cases(spark):
    pages = spark.createDataFrame([(i, "u", h, 1, 2) for i, h in enumerate(CASES)], PAGES)
    rows = H.extract_text(pages).orderBy("page_id").collect()
    assert [r["text"] for r in rows] == list(CASES.values())
    assert [r["n_chars"] for r in rows] == [len(t) for t in CASES.values()]
    assert [H.main_text(h, {}) for h in CASES] == list(CASES.values())
    assert H.extract_text(pages.limit(0)).count() == 0


def test_html_long_page():
    page = "<article>" + "<p>some words here</p>" * 30000 + "</article><footer>end</footer>"
    assert H.main_text(page, {}) == " ".join(["some words here"] * 30000)


def test_html_of_a_table(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract_text(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S).group(1)
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", "\n", inner))
        assert got[row["page_id"]] == " ".join(html.unescape(blocks).split())
