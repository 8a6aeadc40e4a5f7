import math
import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from nearfield.llm.html_main import blocks, extract, main_text

CASES = {
    "<body><nav>menu</nav><article><h1>T&amp;t</h1><p>a <b>b</b>c<br>d<p>e</article><footer>f</footer>": "T&t a bc d e",
    "<main><p>x</p><div class='comments'><p>no</p></div><form>f</form><aside>s</aside></main>": "x",
    "<div id=content><p>one</p></div><div class=sidebar>two</div><div class='cookie-notice'>three</div>": "one",
    "<p>x<script>var t='<p>no</p>';</script>y<style>p{}</style>z": "x y z",
    "<title>no</title><p>&lt;i&gt; &#65;&#x42;&eacute;&nbsp;q &unknown; &am": "<i> ABé q &unknown; &am",
    "a < b <!-- no <p>x</p> --> c": "a < b c",
    "<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>": "1 2 3 4",
    "<p>cut <b": "cut",
    "<p title=don't>Hello world it's</p><p>more</p>": "Hello world it's more",
    "<p title='a>b' class=\"x\">q</p><a href=x/y?a=\"b>r</a>": "q r",
    "<article><p>text</p><section><article class=comment><p>nice</p></article><article class='comment-item'>one</article></section></article>": "text",
    "<article><p>text</p><div class='search-results-guide'><p>guide</p></div><div class='alert-level-story'>story</div><div class='related-posts'>no</div></article>": "text guide story",
    "<article><p>teaser</p></article><div class=body><p>the text itself</p></div>": "teaser the text itself",
    "<p>a<!b>c</p><?php x ?><p>d</p></><!-- open <p>e": "ac d",
    "": "",
}


@pytest.mark.parametrize("page", CASES)
def test_pages(spark, page):
    df = spark.createDataFrame([(1, "http://h.net/1", page, "z")], "page_id long, url string, html string, text string")
    (r,) = extract(df).collect()
    assert (r.text, r.n_chars) == (CASES[page], len(CASES[page]))


def test_style_tree(spark):
    """Branches that show the same on a host's pages go, whatever their names."""
    rows = [(i, f"http://h.net/{i}", f"<div class=k><p>Welcome to h</p></div><div class=m><p>story number {i}</p></div>") for i in range(20)]
    rows += [(100, "http://other.net/", "<div class=k><p>Welcome to h</p></div>"), (101, None, None), (101, None, None), (None, "x", "<p>y</p>")]
    got = {}
    for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert all(got[i] == [f"story number {i}"] for i in range(20))
    assert got[100] == ["Welcome to h"] and got[101] == ["", ""] and got[None] == ["y"]


def test_article_is_kept_though_pages_repeat_it(spark):
    rows = [(i, f"http://h.net/{i}", "<nav>n</nav><article><p>same text</p></article>") for i in range(20)]
    assert {r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"same text"}


def test_empty_and_long(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    long = "<article>" + "<p>word <i>x</i></p>" * 50_000 + "</article>"
    (r,) = extract(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")).collect()
    assert r.text == " ".join(["word x"] * 50_000)
    assert blocks("<div>" * 3000 + "deep")[-1][1] == "deep"


class Dom(HTMLParser):
    """A plain tree of well-formed pages: [name, children], a child being a tree or a text."""

    def __init__(self, page):
        super().__init__()
        self.root = ["", []]
        self.open = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.open[-1][1].append([f"{tag}.{dict(attrs).get('class', '')}", []])
        self.open.append(self.open[-1][1][-1])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def walk(tree, path=()):
    yield path, tree
    for child in tree[1]:
        if not isinstance(child, str):
            yield from walk(child, (*path, child[0]))


def entropy(values):
    n = Counter(values)
    m = sum(n.values())
    return 1.0 if m == 1 else -sum(c / m * math.log(c / m) for c in n.values()) / math.log(m)


def brute(pages, least, least_pages):
    """(host, page) rows -> texts by merging the trees of each host."""
    doms = [(host, Dom(page).root) for host, page in pages]
    whole = lambda t: tuple((path, c) for path, e in walk(t) for c in e[1] if isinstance(c, str))
    shown, seen = {}, set()
    for host, tree in doms:
        if (host, whole(tree)) in seen:
            continue
        seen.add((host, whole(tree)))
        here = {}
        for path, (_, children) in walk(tree):
            here.setdefault((host, path, "shape"), set()).add(tuple(c[0] if not isinstance(c, str) else "" for c in children))
            for c in children:
                if isinstance(c, str):
                    here.setdefault((host, path, "text"), set()).add(c)
        for key, values in here.items():
            shown.setdefault(key, []).append(values)
    weight = {key: entropy([v for values in pages_ for v in values]) for key, pages_ in shown.items() if len(pages_) >= least_pages}

    def keep(host, path, tree):
        parts, total = [], []
        for c in tree[1]:
            if isinstance(c, str):
                w = weight.get((host, path, "text"), 1.0)
                parts.append([c] if w >= least else [])
            else:
                w, inner = keep(host, (*path, c[0]), c)
                parts.append(inner)
            total.append(w)
        w = 0.1 * weight.get((host, path, "shape"), 1.0) + 0.9 * sum(total) / len(total)
        return w, [t for p in parts for t in p] if w >= least or not path else []

    return [" ".join(keep(host, (), tree)[1]) for host, tree in doms]


def page_of(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["k", "m", "x"])
        if depth < 2 and rng.random() < 0.5:
            out += f"<div class={kind}>{page_of(rng, depth + 1)}</div>"
        else:
            out += f"<p class={kind}>{rng.choice(['same', 'same', 'one', 'two', str(rng.random())])}</p>"
    return out


def test_against_a_plain_style_tree(spark):
    rng = random.Random(8)
    pages = [(rng.choice(["a.net", "b.net", "c.net"]), page_of(rng)) for _ in range(90)]
    pages += [("d.net", f"<div class=k><p>Welcome</p><p>to {i % 2}</p></div><div class=m><p>story {i}</p>{'<p>more</p>' * (i % 3)}</div>") for i in range(12)] + pages[:5]
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    for least in (0.4, 0.7):
        got = {r.page_id: r.text for r in extract(df, least=least).collect()}
        expected = brute(pages, least, 4)
        assert [got[i] for i in range(len(pages))] == expected
    # The tree decides: without it, texts are others.
    assert sum(main_text(p, {}) != got[i] for i, (_, p) in enumerate(pages)) > 30


BROKEN = ['<a b="x>t', "<a b='>", "<!a", "<a ", "<b><div></div>", "<div></x>", "<div>", "</", '<a b=">"', "<p>x<b>", "<!--", "<title>", "<p title=don't \">"]


@pytest.mark.parametrize("part", BROKEN)
def test_broken_pages_take_linear_time(part):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        main_text(part * n, {})
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1


def test_copies_of_a_page_count_once(spark):
    """Copies don't make a page's own text look like boilerplate, nor that of others by the same path."""
    body = "".join(f"<p>paragraph {i} of the copied page</p>" for i in range(5))
    rows = [(i, f"http://h.net/{i}", f"<script>track({i})</script><nav>menu {i}</nav><div>{body}</div>") for i in range(20)] + [(50, "http://h.net/50", "<div><p>a page of its own</p></div>")]
    rows += [(100 + i, f"http://one.net/{i}", "<p>one block</p>") for i in range(4)]
    # Three pages that share two blocks are fewer than LEAST_PAGES.
    rows += [(200 + i, f"http://few.net/{i}", f"<p>both</p><p>shared</p><h2>head {i}</h2>") for i in range(3)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(20)} == {" ".join(f"paragraph {i} of the copied page" for i in range(5))}
    assert got[50] == "a page of its own" and {got[100 + i] for i in range(4)} == {"one block"}
    assert [got[200 + i] for i in range(3)] == [f"both shared head {i}" for i in range(3)]


def test_importance_judges_inside_and_outside_an_article(spark):
    """Teaser cards don't hide the body beside them; a notice that an article repeats goes, the text around it stays."""
    rows = [(i, f"http://h.net/{i}", f"<article><p>teaser {i}</p></article><div class=b><p>body {i}</p></div><div class=k><p>Welcome to h</p></div>") for i in range(20)]
    rows += [(100 + i, f"http://n.net/{i}", f"<article><h1>head {i}</h1><p>story {i}</p><div class=k><p>This site is made by n</p></div></article>") for i in range(20)]
    # Pages that share most paragraphs of their articles keep them.
    shared = "".join(f"<p>shared paragraph {j}</p>" for j in range(5))
    rows += [(200 + i, f"http://s.net/{i}", f"<article><p>paragraph of {i}</p>{shared}</article>") for i in range(20)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert got[i] == f"teaser {i} body {i}" and got[100 + i] == f"head {i} story {i}"
        assert got[200 + i] == " ".join([f"paragraph of {i}", *(f"shared paragraph {j}" for j in range(5))])


@pytest.mark.parametrize("wrapper", ["div class='content-sidebar-wrap'", "div class='layout has-sidebar'", "div class=no-sidebar", "div id=with-header", "div class='search-page'", "form action=/", "div class='page-with-comments x'", "div class=widget", "span class=main-banner"])
def test_wrappers_that_name_noise_keep_the_page(wrapper):
    inner = "<div class=sidebar>side</div><{0}><p>a <b>b</b>c</p><p>long text of the page</p></{0}><div class='main-nav'>links</div><form>f</form><div class=comment-list>comments that are longer than the text of the page itself</div>"
    for tag in ("article", "main", *(("div",) if "widget" not in wrapper else ())):
        page = f"<body><div class=site-header>name</div><{wrapper}>{inner.format(tag)}</{wrapper.split()[0]}></body>"
        assert [b[1] for b in blocks(page) if not b[2]] == ["a bc", "long text of the page"], tag


def test_cards_in_a_named_part_are_noise():
    page = "<div><p>the body of this page is here</p></div><div class=related-posts><article>card 1</article><article>card 2</article></div><aside><article>card</article></aside><div class=ads>x</div>"
    assert [b[1] for b in blocks(page) if not b[2]] == ["the body of this page is here"]
    page = "<main><p>the body of this page is here</p></main><div class=related><article>card 1</article><article>card 2</article></div><aside><article>card</article></aside>"
    assert [b[1] for b in blocks(page) if not b[2]] == ["the body of this page is here"]
