"""Main text of web pages by site style trees.

Pages are parsed into a tree of block elements, each named by its path (tag and
class of all open blocks), and blocks of text. The pages of a host are merged,
copies of a page (the same blocks in the same order, noise aside) counted once.
For every node of the merged tree two entropies over the pages that have it are
taken, each divided by the logarithm of what it ranges over: that of its
presentation (the sequence of its children) and that of its contents (the texts
right in it): 1 if every page shows its own, 0 if all show the same. The
composite importance of an element of a page goes up from its leaves:
    (1 - SHARE) * presentation + SHARE * mean over children,
where a text counts with its node's content importance. A branch below
LEAST_IMPORTANCE goes if at least LEAST_PAGES different pages show its nodes. An
article or main element is evidence for what is in it: there a branch goes only
below LEAST_IN_ARTICLE.

Branches whose presentation says that they are no content (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, comments, hidden parts) go
before the merge, unless a name that only partly says so, or a form, holds most
of the page.

Defined cases: null or empty html gives the empty text; a null url, or one
without a host, is a host of its own name (the empty one); repeated pages each
get a row; an empty table gives an empty result; extra columns are ignored.
Quotes count around attribute values only, and one that is never closed is part
of a value without quotes; a tag or comment that is never closed ends the page.
Parsing is one pass over a page, in time and memory in proportion to it.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import materialize

LEAST_IMPORTANCE, LEAST_IN_ARTICLE, LEAST_PAGES, SHARE = 0.4, 0.1, 4, 0.9
BROADCAST_ROWS = 200_000  # (host, node, importance) rows that are sent to every executor; beyond it a join shuffles

#: Elements that never hold a page's main text.
NOISE_TAGS = frozenset("head title nav header footer aside form script style noscript template iframe object embed svg canvas button select option datalist textarea input dialog menu audio video map math".split())
#: Words of class, id or role that mark other parts.
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert notification popup modal overlay newsletter subscribe subscription signup login paywall nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead topbar footer bottombar sidebar aside widget widgets related recommended recommendations trending share sharing social comment comments commentlist disqus reply replies respond discussion complementary contentinfo search searchbox toolbar legal copyright disclaimer skip".split())
#: Of them, those of parts that are often longer than the text; and words of names that tell what a page has ("no-sidebar").
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
STATE_WORDS = frozenset("has no not with without open closed".split())
#: Words of names that tell the place or shape of a part, not what it is.
SHAPE_WORDS = frozenset("wrap wrapper container inner outer list lists item items box block blocks area section group row col column left right top bottom upper lower main site page global primary secondary bar panel slot unit zone holder content contents body links link posts post articles article stories view module component region fixed sticky desktop mobile small large thread count form field input button".split())
#: How an element is marked: by a form or a name that is partly of noise words, by one that is so as a whole or names comments, by its tag or hidden.
PARTLY, NAMED, COMMENTS, ALWAYS = 1, 2, 3, 4
#: Elements without content, elements read as raw text, inline elements, elements that end an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table td th tr ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}

NAME, VALUE = r"[^\s/>][^\s/>=]*+", r"\"[^\"]*+\"|'[^']*+'|[^\s>]*+"
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{NAME}(?:\s*+=\s*+(?:{VALUE}))?+)*+)>")
ATTRIBUTE = re.compile(rf"[\s/]*+({NAME})(?:\s*+=\s*+({VALUE}))?+")
END = {}
WORD = re.compile(r"[a-z]+")


def _named(attrs: dict[str, str]) -> int:
    """What class, id and role say. Words of shape aside, a name's last word
    tells what it names: main-nav is noise, search-results-guide isn't."""
    mark = 0
    for name in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower().split():
        words = WORD.findall(name)
        if STATE_WORDS.isdisjoint(words):
            head = next((w for w in reversed(words) if w not in SHAPE_WORDS), "")
            if head in NOISE_WORDS:
                mark = max(mark, COMMENTS if head in COMMENT_WORDS else NAMED if all(w in NOISE_WORDS for w in words) else PARTLY)
    return mark


def _mark(tag: str, attrs: dict[str, str]) -> int:
    if tag in NOISE_TAGS and tag != "form" or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return ALWAYS
    if tag in ("article", "main", "body", "html"):
        return COMMENTS if tag == "article" and _named(attrs) == COMMENTS else 0
    return max(_named(attrs), PARTLY if tag == "form" else 0)


class Block(NamedTuple):
    element: int
    text: str
    marked: int
    article: bool


class Page(NamedTuple):
    parent: list[int]  # of each block element; the first is the page itself
    node: list[int]  # a hash of its path
    article: list[bool]
    shape: list[list[int]]  # hashes of its children's names, 0 for text
    blocks: list[Block]
    noise: list[bool]  # of each block


def _hash(*parts: int | str) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _noise(marked: list[list[int]], found: list[Block]) -> list[bool]:
    """Whether each marked element (the marked one around it or -1, mark, articles
    in it, has a main) is noise. One marked PARTLY isn't if it holds more than half
    of the page's text; or, with a main or a single article (several may be cards),
    of the text in article and main elements. One marked NAMED counts so if it has
    a main or a single article, one marked COMMENTS if it has a main."""
    for up, _, article, main in reversed(marked):  # what is inside comes later
        if up >= 0:
            marked[up][2] += article
            marked[up][3] |= main
    always: list[bool] = []
    for up, mark, article, main in marked:
        always.append(up >= 0 and always[up] or mark == ALWAYS or mark == NAMED and article != 1 and not main or mark == COMMENTS and not main)
    held, total = [[0, 0] for _ in marked], [0, 0]
    for text, at, article in ((b.text, b.marked, b.article) for b in found):
        if at < 0 or not always[at]:
            for h in (total, held[at]) if at >= 0 else (total,):
                h[0] += len(text)
                h[1] += len(text) if article else 0
    for i in range(len(marked) - 1, -1, -1):
        if marked[i][0] >= 0:
            held[marked[i][0]][0] += held[i][0]
            held[marked[i][0]][1] += held[i][1]
    noise: list[bool] = []
    for i, m in enumerate(marked):
        noise.append(always[i] or m[0] >= 0 and noise[m[0]] or not (2 * held[i][0] > total[0] or (m[2] == 1 or m[3]) and 2 * held[i][1] > total[1]))
    return noise


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] or ""
        value = value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0] else value
        found.setdefault(m[1].lower(), entities.unescape(value) if "&" in value else value)
    return found


def _skip(page: str, at: int) -> int:
    """Where the comment or declaration at `at` ends."""
    n = len(page)
    if page.startswith("<!--", at):
        ends = [e + k for sign, k in (("-->", 3), ("--!>", 4)) if (e := page.find(sign, at + 2)) >= 0]
        return min(ends, default=n)
    sign = "]]>" if page.startswith("<![CDATA[", at) else ">"
    end = page.find(sign, at)
    return end + len(sign) if end >= 0 else n


def parse(page: str) -> Page:
    """The page's tree of block elements and its blocks of text, in page order."""
    out = Page([-1], [0], [False], [[]], [], [])
    # Open elements: tag, block element, the marked element it is in, article.
    stack: list[tuple[str, int, int, bool]] = [("", 0, -1, False)]
    opened: dict[str, int] = {}
    marked: list[list[int]] = []
    parts: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            _, element, at_mark, article = stack[-1]
            out.shape[element].append(0)
            out.blocks.append(Block(element, text, at_mark, article))

    def close(to: int):
        for tag, *_ in stack[to:]:
            opened[tag] -= 1
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 == n:
            parts.append(page[at:])
            break
        parts.append(page[at:lt])
        kind = page[lt + 1]
        if kind in "!?" or kind == "/" and not page[lt + 2 : lt + 3].isalpha():
            at = _skip(page, lt)
            continue
        if kind != "/" and not (kind.isascii() and kind.isalpha()):
            parts.append("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt)
        if not m:
            break
        at = m.end()
        tag = m[2].lower()
        inline = tag in INLINE
        if m[1]:
            if not inline:
                flush()
            if opened.get(tag):
                i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                if inline and stack[-1][2] != stack[i - 1][2]:  # a marked one ends
                    flush()
                close(i)
            continue
        attrs = _attributes(m[3]) if m[3] else {}
        own = _mark(tag, attrs)
        if not inline or own:
            flush()
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path", "use"):
            continue
        ends = ({"p"} if tag in ENDS_P else set()) | SIBLINGS.get(tag, set())
        if any(opened.get(t) for t in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] not in INLINE and stack[i][0] not in ("p", "td", "th", "tr", "dt", "dd"):
                    break
        _, element, at_mark, article = stack[-1]
        if own:
            marked.append([at_mark, own, 0, 0])
            at_mark = len(marked) - 1
        main = tag == "main" or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        if main or tag == "article" and _named(attrs) < NAMED:
            article = True
            if at_mark >= 0:
                marked[at_mark][2] += not main
                marked[at_mark][3] |= main
        if not inline:
            name = _hash(tag, *sorted(attrs.get("class", "").split()))
            out.shape[element].append(name)
            out.parent.append(element)
            out.node.append(_hash(out.node[element], name))
            out.article.append(article)
            out.shape.append([])
            element = len(out.parent) - 1
        stack.append((tag, element, at_mark, article))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in RAW:
            if tag not in END:
                END[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I)
            end = END[tag].search(page, at)
            if tag in ("title", "textarea"):
                parts.append(page[at : end.start() if end else n])
            flush()
            close(len(stack) - 1)
            at = end.end() if end else n
    flush()
    hidden = _noise(marked, out.blocks)
    out.noise.extend(b.marked >= 0 and hidden[b.marked] for b in out.blocks)
    return out


def blocks(page: str) -> list[tuple[int, str, bool, bool]]:
    """(node, text, noise, in article) of every block with text, in page order."""
    p = parse(page)
    return [(p.node[b.element], b.text, noise, b.article) for b, noise in zip(p.blocks, p.noise, strict=True)]


def _live(p: Page) -> list[bool]:
    """Which elements hold a block that is no noise."""
    live = [False] * len(p.parent)
    for b, noise in zip(p.blocks, p.noise, strict=True):
        live[b.element] |= not noise
    for i in range(len(live) - 1, 0, -1):  # children come later
        live[p.parent[i]] |= live[i]
    return live


def shows(page: str) -> tuple[int, dict[int, set[int]]]:
    """The page's hash, by which copies are known, and what its nodes show: at
    the node's hash its contents, at _hash(hash) its sequences of children."""
    p, whole, shown = parse(page), xxhash.xxh3_64(), {}
    for b, noise in zip(p.blocks, p.noise, strict=True):
        if not noise:
            whole.update(f"{p.node[b.element]}\0{b.text}\0".encode("utf-8", "surrogatepass"))
            shown.setdefault(p.node[b.element], set()).add(_hash(b.text))
    for i, live in enumerate(_live(p)):
        if live:
            shown.setdefault(_hash(p.node[i]), set()).add(_hash(*p.shape[i]))
    return whole.intdigest() - (1 << 63), shown


def _shown(batches):
    """Rows (host, html) -> (host, page, node, contents) of each node of a page."""
    for pdf in batches:
        rows = []
        for host, page in zip(pdf["host"], pdf["html"], strict=True):
            name, shown = shows(page or "")
            rows += [(host, name, node, sorted(contents)) for node, contents in shown.items()]
        yield pd.DataFrame(rows, columns=["host", "page", "node", "contents"]).astype({"page": "int64", "node": "int64"})


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, pages, importance: the merged pages (host, html) of every
    host, copies of a page counted once. Only hashes of the contents are
    shuffled, counted before and after."""
    shown = pages.select("host", "html").mapInPandas(_shown, "host string, page long, node long, contents array<long>").distinct()
    each = shown.select("host", "node", F.posexplode("contents").alias("_at", "content"))
    counts = each.groupBy("host", "node", "content").agg(F.count("*").alias("n"), F.count_if(F.col("_at") == 0).alias("_first"))
    tree = counts.groupBy("host", "node").agg(F.sum("_first").alias("pages"), F.sum("n").alias("_m"), F.sum(F.col("n") * F.log("n")).alias("_s"))
    # Entropy of n_i / m over log m = 1 - sum(n_i log n_i) / (m log m).
    return tree.select("host", "node", "pages", F.when(F.col("_m") > 1, 1 - F.col("_s") / (F.col("_m") * F.log("_m"))).otherwise(1.0).alias("importance"))


def main_text(page: str | None, tree: dict[int, float], least: float = LEAST_IMPORTANCE, least_in_article: float = LEAST_IN_ARTICLE, share: float = SHARE) -> str:
    """The page's main text. tree: the importance of its host's nodes that
    enough pages show; a node that isn't in it counts as 1."""
    p = parse(page or "")
    text = [noise or tree.get(p.node[b.element], 1.0) < (least_in_article if b.article else least) for b, noise in zip(p.blocks, p.noise, strict=True)]
    if tree:
        live, total, count = _live(p), [0.0] * len(p.parent), [0] * len(p.parent)
        for b, noise in zip(p.blocks, p.noise, strict=True):
            if not noise:
                total[b.element] += tree.get(p.node[b.element], 1.0)
                count[b.element] += 1
        low = [False] * len(p.parent)
        for i in range(len(p.parent) - 1, 0, -1):
            if live[i]:
                composite = (1 - share) * tree.get(_hash(p.node[i]), 1.0) + share * total[i] / count[i]
                low[i] = composite < (least_in_article if p.article[i] else least)
                total[p.parent[i]] += composite
                count[p.parent[i]] += 1
        for i in range(1, len(low)):
            low[i] |= low[p.parent[i]]
        text = [gone or low[b.element] for b, gone in zip(p.blocks, text, strict=True)]
    return " ".join(b.text for b, gone in zip(p.blocks, text, strict=True) if not gone)


def _texts(least: float, least_in_article: float, trees=None):
    """Rows (page_id, url, html, host, or nodes and values of its tree) -> texts.
    trees: a broadcast of all hosts' trees."""

    def texts(batches):
        known = trees.value if trees is not None else {}
        for pdf in batches:
            each = (known.get(h, {}) for h in pdf["host"]) if trees is not None else (dict(zip(n, v, strict=True)) if n is not None else {} for n, v in zip(pdf["_nodes"], pdf["_values"], strict=True))
            text = [main_text(page, tree, least, least_in_article) for page, tree in zip(pdf["html"], each, strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text})

    return texts


def extract(pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES, least_in_article: float = LEAST_IN_ARTICLE) -> DataFrame:
    """page_id, url, text, n_chars per page. Pages are parsed twice, for the
    tree and for the texts; their texts are never shuffled while the nodes that
    show anything again are few enough to be sent to every executor."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))
    page = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", host.alias("host"))
    known, _ = materialize(style_tree(page).where((F.col("pages") >= least_pages) & (F.col("importance") < 1)).select("host", "node", "importance"), "tree")
    spec = "page_id string, url string, text string"
    if known.count() <= BROADCAST_ROWS:
        trees: dict[str, dict[int, float]] = {}
        for r in known.collect():
            trees.setdefault(r.host, {})[r.node] = r.importance
        out = page.select("page_id", "url", "html", "host").mapInPandas(_texts(least, least_in_article, pages.sparkSession.sparkContext.broadcast(trees)), spec)
    else:
        by_host = known.groupBy("host").agg(F.collect_list(F.struct("node", "importance")).alias("_t")).select("host", F.col("_t.node").alias("_nodes"), F.col("_t.importance").alias("_values"))
        by_host, _ = materialize(by_host, "trees")  # a table: the pages of a hot host can then be split in the join
        out = page.join(by_host, "host", "left").select("page_id", "url", "html", "_nodes", "_values").mapInPandas(_texts(least, least_in_article), spec)
    return out.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
