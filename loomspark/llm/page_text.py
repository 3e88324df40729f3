"""Main text of pages by removal of what a site repeats.

Every element's subtree is hashed (tag, words, children) as a page is read. Spark counts, for each host,
how many different pages hold a subtree, and a subtree that recurs on many of them is template: pages
are read again and lose it. Pages that share their article (copies, near copies) count once: a page is
known by the least hash among its text blocks, the subtree's own aside, so what copies share is
not template. Outside of a page's article a subtree on LEAST_OUTSIDE different pages is template;
inside, or where a page marks no article, it takes SHARE of the host's pages, at least LEAST_INSIDE: a
passage that articles quote stays. What is left loses the elements that HTML itself names as no
content (nav, header, footer, aside, form, script, ...) or whose class, id or role says so, adverts,
notices and reader comments among them, unless they hold the article or its heading. The text is that of the
articles, else of main, else of the body: a block for each run of text between block elements, white
space as one space, blocks joined by an empty line.

A null or empty page, or one without text, gives an empty text. A page without a host is judged among
those without one. Repeated rows give repeated rows; a site's copies of one page count once.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.sides import small
from loomspark.storage import bounded_batches, written

LEAST_OUTSIDE, LEAST_INSIDE, SHARE = 3, 5, 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that run on in a line of text; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
#: An open element of the first kind ends where one of the second starts.
CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
CLOSERS = frozenset().union(*CLOSES.values())
#: What a head may hold; anything else ends it.
HEAD = frozenset("title meta link base style script noscript template".split())
#: A start tag, or the end tag of a line or an item, ends nothing outside of these.
SCOPES = frozenset("table ul ol dl article main body html section div button".split())
#: Elements that are no content, and the words of a class, id or role that say the same.
NO_CONTENT = frozenset("nav header footer aside form script style noscript template iframe svg math object canvas button select input textarea dialog menu head title audio video map".split())
NO_CONTENT_WORDS = frozenset("nav navbar navigation navigationbar menu menubar breadcrumb breadcrumbs pagination pager toolbar footer sidebar complementary contentinfo banner ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup login share sharing sharebar social related recommended recommendations widget comment comments commentlist disqus replies respond reviews search skip".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond".split())
HOLDS = frozenset(("article", "main", "h1"))


class Element:
    __slots__ = ("attrs", "children", "hash", "holds", "tag")

    def __init__(self, tag: str, attrs: str) -> None:
        self.tag, self.attrs, self.children, self.hash, self.holds = tag, attrs, [], 0, tag in HOLDS


def parse(page: str) -> Element:
    """The element tree: end tags that HTML lets out are implied, stray ones ignored."""
    root = Element("", "")
    stack, at, n = [root], 0, len(page)

    def text(lo: int, hi: int) -> None:
        if hi > lo:
            t = page[lo:hi]
            stack[-1].children.append(entities.unescape(t) if "&" in t else t)

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            break
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if i == 1 or stack[i].tag in SCOPES and (tag in CLOSES or tag in INLINE):
                    stack[-1].children += [Element("p", "")] if tag == "p" else []  # a stray end of a paragraph ends a block
                    break
            continue
        for i in range(len(stack) - 1, 0, -1) if tag in CLOSERS or stack[-1].tag == "head" else ():
            if tag in CLOSES.get(stack[i].tag, ()) or stack[i].tag == "head" and tag not in HEAD:
                del stack[i:]
                break
            if stack[i].tag in SCOPES:
                break
        new = Element(tag, m[3])
        stack[-1].children.append(new)
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(new)
    text(at, n)
    return root


def _words(e: Element) -> set[str]:
    """The words of an element's class, id and role."""
    return {w for name, *v in ATTRIBUTE.findall(e.attrs) if name.lower() in ("class", "id", "role") for w in re.split(r"[^a-z0-9]+", "".join(v).lower())} if "=" in e.attrs else set()


def _hidden(e: Element) -> bool:
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", QUOTED.sub("", e.attrs), re.I) or re.search(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", e.attrs, re.I))


def no_content(e: Element) -> bool:
    if e.tag in ("html", "body"):
        return False
    if e.tag in HOLDS:
        return e.tag != "h1" and bool(_words(e) & COMMENT_WORDS) and not any(c.holds for c in e.children if isinstance(c, Element))
    if e.holds and e.tag != "header":
        return False
    return e.tag in NO_CONTENT or bool(e.attrs) and (bool(_words(e) & NO_CONTENT_WORDS) or _hidden(e))


def elements(root: Element) -> list[Element]:
    """All elements, children first, each with whether it holds article, main or h1."""
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [c for c in e.children if c.__class__ is Element]
    order.reverse()
    for e in order:
        e.holds = e.holds or any(c.holds for c in e.children if c.__class__ is Element)
    return order


def hashed(root: Element) -> list[Element]:
    """elements() with the hash of each subtree; 0 if it has no text."""
    order = elements(root)
    for e in order:
        parts, words = [e.tag], False
        for c in e.children:
            if c.__class__ is Element:
                if c.hash:
                    parts.append(f"<{c.hash}")
                    words = True
            elif c := " ".join(c.split()):
                parts.append(c)
                words = True
        if words and e.tag not in RAW:
            e.hash = int.from_bytes(blake2b("\n".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) or 1
    return order


def articles(root: Element) -> list[Element]:
    """The outermost articles in page order that are content, else main elements, else the body or the whole."""
    for tag in ("article", "main", "body"):
        found, stack = [], [root]
        while stack:
            e = stack.pop()
            if e.tag == tag:
                found.append(e)
            else:
                stack.extend(c for c in reversed(e.children) if isinstance(c, Element) and not no_content(c))
        found = [e for e in found if not no_content(e)]
        if found:
            return found
    return [root]


def _ends_block(e: Element) -> bool:
    return e.tag not in INLINE and e.tag not in ("script", "style", "template")


def blocks(root: Element, templates: frozenset[int] | set[int]) -> list[str]:
    """Text blocks of the articles without templates and what is no content."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if t := " ".join("".join(line).split()):
            out.append(t)
        line.clear()

    for top in articles(root):
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.tag == "br":
                line.append(" ")
            elif x.hash in templates or no_content(x):
                if _ends_block(x):
                    flush()
            else:
                if _ends_block(x):
                    flush()
                    stack.append(None)
                stack.extend(reversed(x.children))
        flush()
    return out


def extract(page: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page, without the subtrees whose hashes are templates."""
    if not page:
        return ""
    root = parse(page)
    (hashed if templates else elements)(root)
    return "\n\n".join(blocks(root, templates))


def subtrees(page: str | None) -> tuple[list[int], list[int], list[int]]:
    """(hashes of subtrees outside of the article, of those inside, the two least hashes of the article's blocks); lines within a block are no subtrees of their own."""
    if not page:
        return [], [], []
    root = parse(page)
    order = hashed(root)
    tops = articles(root)
    inside, stack = set(), [c for t in tops for c in t.children if isinstance(c, Element)]
    while stack:
        e = stack.pop()
        inside.add(e.hash)
        stack.extend(c for c in e.children if isinstance(c, Element))
    marked = tops[0].tag in ("article", "main")
    blocks_of = sorted({e.hash for e in order if e.hash in inside and e.tag not in INLINE and not any(isinstance(c, Element) and c.hash and c.tag not in INLINE for c in e.children)} - {0})[:2]
    all_of = {e.hash for e in order if not e.holds and e.tag not in INLINE and e.tag not in ("", "html", "body", "head")} - {0}
    outside = all_of - inside if marked else set()
    return sorted(outside), sorted(all_of - outside), blocks_of


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


_FOUND = "struct<outside:array<long>,inside:array<long>,least:array<long>>"


def _subtrees(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        yield pd.DataFrame([subtrees(p) for p in batch], columns=["outside", "inside", "least"])


def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, known in batches:
        yield pd.Series([extract(p, frozenset(() if t is None else t)) for p, t in zip(pages, known, strict=True)], dtype=object)


def read_pages(pages: DataFrame) -> DataFrame:
    """(host, page, outside, inside, least) of each page with text: hashes of its subtrees and of its first blocks; page is a digest."""
    read = pages.filter("html is not null").select(host(F.col("url")).alias("host"), F.md5(F.col("html").cast("binary")).alias("page"), F.pandas_udf(_subtrees, _FOUND)("html").alias("s"))
    return read.select("host", "page", "s.*")


def held_subtrees(read: DataFrame) -> DataFrame:
    """(host, page, subtree, inside, page_as): each subtree of each page, with the page's signature without it."""
    pairs = lambda name, flag: F.transform(name, lambda h: F.struct(h.alias("subtree"), F.lit(flag).alias("inside")))
    each = read.select("host", "page", "least", F.explode(F.concat(pairs("outside", False), pairs("inside", True))).alias("x")).select("host", "page", "least", "x.*")
    first, second = F.try_element_at("least", F.lit(1)), F.try_element_at("least", F.lit(2))
    return each.select("host", "page", "subtree", "inside", F.coalesce(F.when(first == F.col("subtree"), second).otherwise(first), F.lit(0)).alias("page_as"))


def templates(read: DataFrame, share: float = SHARE, least_inside: int = LEAST_INSIDE, least_outside: int = LEAST_OUTSIDE) -> DataFrame:
    """(host, subtree, inside) of subtrees that many different pages of the host hold."""
    counts = held_subtrees(read).select("host", "subtree", "inside", "page_as").distinct().groupBy("host", "subtree", "inside").agg(F.count("*").alias("n")).filter(F.col("n") >= min(least_inside, least_outside))
    hosts = read.select("host", F.coalesce(F.try_element_at("least", F.lit(1)), F.lit(0)).alias("page_as")).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    enough = F.when(F.col("inside"), (F.col("n") >= least_inside) & (F.col("n") >= share * F.col("pages"))).otherwise(F.col("n") >= least_outside)
    return counts.join(hosts, "host").filter(enough).select("host", "subtree", "inside")


def main_text(pages: DataFrame, share: float = SHARE, least_inside: int = LEAST_INSIDE, least_outside: int = LEAST_OUTSIDE) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_templates: every page's main text and how many of its subtrees were template."""
    bounded_batches(pages.sparkSession)
    read = written(read_pages(pages), "subtrees")
    known = written(templates(read, share, least_inside, least_outside), "templates")
    # a page's rows lie in one task, so that the sets are whole before they are shuffled
    hit = held_subtrees(read).join(small(known, 40), ["host", "subtree", "inside"]).groupBy("host", "page").agg(F.collect_set("subtree").alias("template"))
    hit = written(hit, "hits")
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), F.md5(F.col("html").cast("binary")).alias("page"))
    found = keyed.join(small(hit, 400), ["host", "page"], "left")
    return found.select("page_id", "url", F.pandas_udf(_extract, "string")("html", "template").alias("text"), F.when(F.col("template").isNull(), 0).otherwise(F.size("template")).alias("n_templates"))
