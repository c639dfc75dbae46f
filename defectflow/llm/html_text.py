"""Main text of web pages with site style trees.

The pages of a host are merged into a style tree: a node is a path of elements (tag and class), counted by the ways its children are arranged (presentation) and by the texts
that stand in it (content). A node's importance is the entropy of these counts over the host's distinct pages, with their number as base: 0 if all pages agree, 1 if
all differ. Pages are distinct if their texts without named boilerplate are, so copies of a page count once. In branches of low importance (content below ``LOW``, presentation not above it, on ``MIN_PAGES``
distinct pages or more) the texts that stand on two distinct pages or more are boilerplate and are removed from each page; a text found on one page stays. Of the prose inside ``article`` and ``main``
(headings, paragraphs, items, cells) repetition alone says little, as of recipes' headings or closing formulas: there such a text goes only if it also stands outside of them on the host.
Where this would leave nothing of a page's ``article`` or ``main``, these stay (copies of one article with different surroundings).

Entropy alone can't give right results: menus and adverts may differ on every page, and hosts may have one page. So elements whose tag, role or whole class or id says what they are go first (a wrapper named so never
takes an article or main inside with it; a form with the page's ``h1`` inside is a wrapper of the page), and the tree judges what is left. Hosts with fewer than ``MIN_PAGES`` distinct pages give no evidence: there, only names decide.

Pages are scanned by the rules of HTML in one pass, in time linear in their length: raw elements end at their own closing tag, quotes count only in an attribute's value, what is unfinished at the end is dropped.

Distinct pages are counted by node, value and page, so a host with a third of all pages is spread over tasks, and summed by Spark before the next shuffle. The removed texts are hashes; they go to
every task if they are at most ``BROADCAST_TEXTS``, else each distinct page is joined with its own ones.

Defined results: a null or empty page has the empty text; a null url is a host of its own; repeated rows each get their row;
an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectflow.llm.common import materialize, pieces

LOW = 0.3
MIN_PAGES = 5
BROADCAST_TEXTS = 50_000

#: Element names of HTML by what they do.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
MAIN = {"article", "main"}
#: Whole names of a class or an id; a compound one counts only if it is listed here, as `no-sidebar` or `entry-header` says nothing of the kind.
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "footer", "gdpr", "header",
    "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
    "ad-banner", "ad-container", "ad-slot", "ad-unit", "ad-wrapper", "comment-form", "comment-list", "comments-area", "cookie-banner", "cookie-bar", "cookie-consent", "cookie-notice", "footer-menu",
    "footer-nav", "footer-widgets", "global-nav", "left-sidebar", "login-form", "main-menu", "main-nav", "main-navigation", "nav-bar", "nav-menu", "nav-links", "newsletter-signup", "page-footer", "post-navigation",
    "related-articles", "related-posts", "right-sidebar", "search-box", "search-form", "share-buttons", "sidebar-left", "sidebar-right", "side-bar", "side-nav", "site-footer", "site-header", "site-nav",
    "site-navigation", "skip-link", "social-links", "social-share", "top-bar", "top-nav", "widget-area",
}
ROLES = {"alertdialog", "banner", "complementary", "contentinfo", "dialog", "menu", "menubar", "navigation", "search", "toolbar"}
#: What stands in such an element isn't the page's main text even if it is an article (a teaser card, a comment).
ASIDE = {"nav", "aside", "footer", "dialog", "menu", "head", "select", "button"}
UNITS = {"ad", "ads", "advert", "adverts", "advertisement", "comment", "comments", "comment-list", "comments-area", "promo", "promotion", "related", "related-articles", "related-posts", "replies", "respond", "sponsor", "sponsored"}
#: How an element is dropped: a layout's name is not passed on to an article or main inside; an ASIDE one only to articles, which then are SPARE: kept if the page has no other main text.
#: From FORM on each form has a number of its own: it is kept if it turns out to wrap the page.
KEPT, NAMED, BESIDE, SPARE, FORM = range(5)
#: Ids of these are anchors; of a section they are inside article or main.
#: What the words of an article stand in.
TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "td", "th", "caption", "figcaption", "blockquote", "pre", "address", "summary", "article", "main"}
#: Where a piece of text stands: outside of article and main, in their prose, or in another element there.
OUTSIDE, PROSE, OTHER = range(3)
ANCHORS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "a", "span", "dt", "dd", "td", "th", "figure"}

#: Elements whose start ends an open paragraph.
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
}
#: What an element's start ends if it is open, and what it doesn't look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
} | {tag: ({"p"}, {"table", "td", "th", "caption", "button", "object"}) for tag in ENDS_P}

#: A tag in plain form; all others are read attribute by attribute.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s"'<>/=]++(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'<>=]++))?+)*+)\s*+(/?)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_GAP = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|(?=>)|([^\s>"'][^\s>]*+)))?""")
_COMMENT_END = re.compile("--!?>")
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def host(url: str | None) -> str:
    found = re.match(r"\s*[a-zA-Z][\w+.-]*://([^/?#\s]*)", url or "")
    return found[1].lower() if found else ""


class Element:
    __slots__ = ("tag", "path", "dropped", "main", "children")

    def __init__(self, tag: str, path: int, dropped: int, main: int):
        self.tag, self.path, self.dropped, self.main, self.children = tag, path, dropped, main, []


def _tag(page: str, at: int) -> tuple[bool, str, dict[str, str], bool, int] | None:
    """Closing, name, attributes (the first of each name), self-closing and end of the tag at ``at``; None if it has no end."""
    plain = _PLAIN.match(page, at)
    names: dict[str, str] = {}
    if plain:
        if plain[3]:
            for name, x, y, z in _ATTRIBUTE.findall(plain[3]):
                names.setdefault(name.lower(), x or y or z)
        return bool(plain[1]), plain[2].lower(), names, bool(plain[4]), plain.end()
    head = _NAME.match(page, at)
    here = head.end()
    while True:
        here = _GAP.match(page, here).end()
        if here >= len(page):
            return None
        if page[here] == ">":
            return bool(head[1]), head[2].lower(), names, page[here - 1] == "/", here + 1
        one = _ATTRIBUTE.match(page, here)
        names.setdefault(one[1].lower(), one[2] or one[3] or one[4] or "")
        here = one.end()


def _dropped(tag: str, names: dict[str, str], top: Element, start: bool) -> int:
    """The state of an element; ``start``: it is an article or main itself."""
    roles = set(names.get("role", "").lower().split())
    whole = tag in ("html", "body", "main") or "main" in roles
    words = set() if whole else set(names.get("class", "").lower().split())
    if not whole and tag not in ANCHORS and not (tag == "section" and top.main):
        words.add(names.get("id", "").strip().lower())
    if top.main:  # a headline's own header
        words.discard("header")
    if tag in ASIDE or "hidden" in names or names.get("aria-hidden", "").strip().lower() == "true" or words & UNITS:
        return BESIDE
    if tag in BOILERPLATE or (tag == "header" and not top.main) or words & WORDS or (not whole and roles & ROLES):
        return NAMED if top.dropped in (KEPT, NAMED) or top.dropped >= FORM else BESIDE
    if not start or top.dropped == KEPT:
        return top.dropped
    return KEPT if whole or top.dropped == NAMED or top.dropped >= FORM else SPARE


def _named(names: dict[str, str]) -> bool:
    """Whether class, id or role say that an element is boilerplate."""
    return bool((set(names.get("class", "").lower().split()) | {names.get("id", "").strip().lower()}) & WORDS or set(names.get("role", "").lower().split()) & ROLES)


def _end(stack: list[Element], count: dict[str, int], tags: set[str], stops: set[str] | None = None) -> None:
    """Ends the nearest open element of ``tags`` with all inside it."""
    if not any(count.get(t) for t in tags):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            for e in stack[i:]:
                count[e.tag] -= 1
            del stack[i:]
            return
        if stops and stack[i].tag in stops:
            return


def parse(page: str) -> tuple[list[tuple[str, int, int, int]], list[Element]]:
    """Pieces of text in order (text, path, dropped, where), a blank where a block begins or ends, and the elements."""
    root = Element("", 0, KEPT, OUTSIDE)
    out, stack, elements, count, forms = [], [root], [root], {}, FORM
    at, size = 0, len(page)
    while at < size:
        top = stack[-1]
        less = page.find("<", at)
        if less < 0:
            less = size
        mark = page[less + 1 : less + 2]
        if less < size and (not mark or not (mark.isascii() and mark.isalpha()) and mark not in "/!?"):  # a plain sign
            less += 1
        if less > at:
            text = page[at:less]
            out.append((html.unescape(text) if "&" in text else text, top.path, top.dropped, top.main))
            at = less
            continue
        if mark in "!?" or mark == "/" and not _NAME.match(page, at):
            if page.startswith("<!--", at):
                end = _COMMENT_END.search(page, at + 2)
                at = end.end() if end else size
            else:
                at = page.find(">", at + 2) + 1 or size
            continue
        found = _tag(page, at)
        if found is None:
            break
        closing, tag, names, alone, at = found
        if tag not in INLINE:
            out.append((" ", top.path, top.dropped, top.main))
        if closing:
            _end(stack, count, {tag})
            continue
        if tag in ENDS:
            _end(stack, count, *ENDS[tag])
            top = stack[-1]
        top.children.append(tag)
        if tag in RAW:
            if not (alone and tag in ("svg", "math")):
                closed = _CLOSING[tag].search(page, at)
                if not closed:
                    break
                at = closed.start()
            continue
        if tag in VOID:
            continue
        start = tag in MAIN or "main" in names.get("role", "").lower().split()
        path = top.path if tag in INLINE else path_hash((tag, names.get("class", "")), top.path)
        dropped = _dropped(tag, names, top, start)
        if tag == "form" and top.dropped == KEPT and not top.main and dropped == NAMED and not _named(names):
            dropped, forms = forms, forms + 1
        main = OUTSIDE if not top.main and not start else top.main if tag in INLINE and top.main else PROSE if tag in TEXT else OTHER
        stack.append(Element(tag, path, dropped, main))
        count[tag] = count.get(tag, 0) + 1
        elements.append(stack[-1])
    return out, elements


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def path_hash(element: tuple[str, str], above: int = 0) -> int:
    """Hash of a path from its last element (tag, class) and the path above it: deep pages need no long strings."""
    return xxhash.xxh3_64_intdigest(f"{element[0]}.{element[1]}".encode("utf-8", "replace"), above)


def _branches(found: list[tuple[str, int, int, int]], kept: set[int]) -> dict[int, str]:
    """The text of each path, without named boilerplate."""
    texts = {}
    for text, path, dropped, _ in found:
        if dropped in kept:
            texts.setdefault(path, []).append(text)
    return {path: t for path, parts in texts.items() if (t := _squeeze(parts))}


def _states(found: list[tuple[str, int, int, int]], elements: list[Element]) -> set[int]:
    """How an element may be dropped so that its text is kept."""
    kept = {KEPT} | {e.dropped for e in elements if e.tag == "h1" and e.dropped >= FORM}
    return kept if any(main and dropped == KEPT and not text.isspace() for text, _, dropped, main in found) else kept | {SPARE}


Marks = set[tuple[int, int]]


def main_text(page: str | None, low: Marks, outside: Marks = frozenset()) -> str:
    """``low``: (path, text) hashes that are removed, from the article's own prose only if they are in ``outside`` too."""
    if not page:
        return ""
    found, elements = parse(page)
    kept = _states(found, elements)
    marks = {path: key in outside for path, text in _branches(found, kept).items() if (key := (_signed(path), _hash(text))) in low} if low else {}
    poor = lambda path, main: path in marks and (main != PROSE or marks[path])
    in_main = [(path, main) for text, path, dropped, main in found if main and dropped in kept and not text.isspace()] if marks else []
    spare = bool(in_main) and all(poor(path, main) for path, main in in_main)
    return _squeeze([text if dropped in kept and (not poor(path, main) or main and spare) else " " for text, path, dropped, main in found])


def _signed(value: int) -> int:
    return value - (1 << 63)


def _nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Style-tree nodes: (host, path, kind, value, page, key, key2); ``page``: hash of the page's text, ``key, key2``: of its url and HTML. Kind 2 has the texts outside article and main, without path."""
    for frame in pieces(frames, "html"):
        rows = []
        for url, page, *key in zip(frame["url"], frame["html"], frame["key"], frame["key2"], strict=True):
            name = host(url)
            found, elements = parse(page or "")
            kept = _states(found, elements)
            whole = _hash(_squeeze([text if dropped in kept else " " for text, _, dropped, _ in found]))
            branches, inside = _branches(found, kept), {path for _, path, _, main in found if main}
            rows += [(name, _signed(p), 0, _hash(t), whole, *key) for p, t in branches.items()]
            rows += [(name, 0, 2, _hash(t), whole, *key) for p, t in branches.items() if p not in inside]
            rows += [(name, _signed(e.path), 1, _hash(" ".join(dict.fromkeys(e.children))), whole, *key) for e in elements if e.dropped in kept and e.tag not in INLINE]
        yield pd.DataFrame(rows, columns=["host", "path", "kind", "value", "page", "key", "key2"])


#: Names a page in both plans; the host comes from ``host`` alone.
PAGE_KEYS = {"key": F.xxhash64, "key2": F.hash}


def nodes(pages: DataFrame) -> DataFrame:
    asked = pages.select(F.col("url").alias("url"), F.col("html").alias("html"), *(f("url", "html").alias(k) for k, f in PAGE_KEYS.items()))
    return asked.mapInPandas(_nodes, "host string, path long, kind int, value long, page long, key long, key2 int")


def value_counts(pages: DataFrame) -> DataFrame:
    """``host, path, kind, value, n``: the distinct pages of each value."""
    return nodes(pages).select("host", "path", "kind", "value", "page").distinct().groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def importances(counts: DataFrame) -> DataFrame:
    c = F.col("n").cast("double")
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("n"), F.sum(c * F.log(c)).alias("clogc"))
    entropy = (F.log(F.col("n").cast("double")) - F.col("clogc") / F.col("n")) / F.log(F.col("n").cast("double"))
    return sums.select("host", "path", "kind", "n", F.when(F.col("n") > 1, entropy).otherwise(1.0).alias("importance"))


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, path, kind`` (0 content, 1 presentation), ``n``, ``importance`` of each node of each host."""
    return importances(value_counts(pages))


def extract_text(pages: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES, broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages`` (``page_id``, ``url``, ``html``)."""
    counts = materialize(value_counts(pages), "values")
    tree = importances(counts)
    content = tree.where((F.col("kind") == 0) & (F.col("importance") < low) & (F.col("n") >= min_pages)).select("host", "path")
    poor = content.join(tree.where((F.col("kind") == 1) & (F.col("importance") >= low)).select("host", "path").hint("merge"), ["host", "path"], "left_anti")
    repeated = counts.where((F.col("kind") == 0) & (F.col("n") > 1)).select("host", "path", "value")
    outside = counts.where("kind = 2").select("host", "value", F.lit(True).alias("outside"))
    removed = repeated.join(poor.hint("merge"), ["host", "path"]).join(outside.hint("merge"), ["host", "value"], "left").withColumn("outside", F.coalesce("outside", F.lit(False)))
    removed = materialize(removed, "removed")
    mine = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").alias("html"))
    schema = "page_id long, url string, text string, n_chars long"

    def result(frame: pd.DataFrame, lows: Iterator[tuple[Marks, Marks]]) -> pd.DataFrame:
        texts = [main_text(page, *some) for page, some in zip(frame["html"], lows, strict=True)]
        return pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    listed = removed.limit(broadcast_texts + 1).collect()
    if len(listed) <= broadcast_texts:
        by_host: dict[str, tuple[Marks, Marks]] = {}
        for r in listed:
            for marked in by_host.setdefault(r["host"], (set(), set()))[: 2 if r["outside"] else 1]:
                marked.add((r["path"], r["value"]))
        known = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield result(frame, (known.value.get(host(url), (set(), set())) for url in frame["url"]))

        return mine.mapInPandas(run, schema)

    hits = nodes(pages).where(F.col("kind") == 0).join(removed, ["host", "path", "value"]).groupBy(*(F.col(k).alias(f"__{k}") for k in PAGE_KEYS))
    marks = hits.agg(F.collect_set(F.struct("path", "value", "outside")).alias("low"))
    same = [f("url", "html") == F.col(f"__{k}") for k, f in PAGE_KEYS.items()]
    joined = mine.join(marks, same, "left").select("page_id", "url", "html", "low")

    def run_own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield result(frame, (tuple({(x["path"], x["value"]) for x in some if every or x["outside"]} if some is not None else set() for every in (True, False)) for some in frame["low"]))

    return joined.mapInPandas(run_own, schema)


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
