"""Structured text of HTML pages, on the standard parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby, takewhile
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomspark.storage import bounded_batches

PAGE = "struct<title:string,chunks:array<string>,faqs:array<struct<question:string,answer:string>>,links:array<string>,documents:array<string>,markdown:string,full_markdown:string>"
#: Elements and classes that are dropped with all they hold, from pages and from their two Markdown forms.
DROPPED = frozenset(("script", "style", "nav", "footer", "header", "aside", "iframe", "noscript", "svg", "form"))
DROPPED_CLASS = re.compile("cookie|modal|popup|banner|advertisement|sidebar|menu|nav", re.I)
DROPPED_FLAT = frozenset(("script", "style", "nav", "footer", "header", "aside"))
DROPPED_FULL = frozenset(("script", "style", "nav", "header", "footer", "iframe", "noscript"))
#: How questions start, classes of question containers and their parts, links that lead to no page, endings of documents.
QUESTION_WORDS = ("how", "what", "when", "where", "why", "who", "can", "do", "is", "are")
FAQ_CLASS = re.compile("faq|accordion|collapse|qa", re.I)
QUESTION_CLASS = re.compile("question|header|title|toggle", re.I)
ANSWER_CLASS = re.compile("answer|content|body|panel", re.I)
NO_PAGE = ("#", "javascript:", "mailto:", "tel:")
DOCUMENTS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx")
VOID = frozenset(("area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"))
HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Least characters of a block, an item and an answer, most rows of a table and characters of an answer, least characters of a full Markdown page.
MIN_BLOCK, MIN_ITEM, MIN_ANSWER, MAX_ROWS, MAX_ANSWER, MIN_PAGE = 15, 5, 20, 20, 1000, 500


class Node:
    """An element: tag, attributes, children (nodes and strings)."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self, sep: str = "") -> str:
        """The texts inside, each stripped, joined by sep; inner white space stays."""
        parts, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    parts.append(x.strip())
            else:
                stack.extend(reversed(x.children))
        return sep.join(parts)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))

    def all(self, *tags: str) -> list[Node]:
        return [x for x in self.walk() if x.tag in tags]


class _Builder(HTMLParser):
    """Elements as they are opened and closed: one that is left open holds what follows, as in a plain parser."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def cleaned(root: Node, dropped: frozenset[str] = DROPPED, classes: re.Pattern | None = DROPPED_CLASS) -> Node:
    """A copy of the tree without what is dropped, so that one parse serves several forms."""
    top = Node(root.tag, root.attrs)
    stack = [(root, top)]
    while stack:
        x, copy = stack.pop()
        for c in x.children:
            if isinstance(c, str):
                copy.children.append(c)
            elif not (c.tag in dropped or (classes and classes.search(c.attrs.get("class", "")))):
                copy.children.append(Node(c.tag, c.attrs))
                stack.append((c, copy.children[-1]))
    return top


def main_part(root: Node) -> Node:
    for test in (lambda x: x.tag == "main", lambda x: x.tag == "article", lambda x: re.search("content|main", x.attrs.get("id", ""), re.I), lambda x: re.search("content|main|article", x.attrs.get("class", ""), re.I), lambda x: x.tag == "body"):
        if found := next((x for x in root.walk() if test(x)), None):
            return found
    return root


def below(part: Node, *tags: str) -> Iterator[Node]:
    """Elements inside part, not part itself, in document order."""
    walk = part.walk()
    next(walk)
    return (x for x in walk if not tags or x.tag in tags)


def table_text(table: Node, sep: str = "") -> str:
    """``Table data: Table columns: a, b; a: v | b: w; ...``: the first row names the columns, at most MAX_ROWS rows follow."""
    rows = [[c.text(sep) for c in below(r, "td", "th")] for r in below(table, "tr")]
    if not rows:
        return ""
    head, rest = rows[0], [r for r in rows[1:] if any(r)][:MAX_ROWS]
    lines = ["Table columns: " + ", ".join(filter(None, head))] if head else []
    for r in rest:
        cells = [f"{h}: {v}" for h, v in zip(head, r, strict=True) if h and v] if len(r) == len(head) else [v for v in r if v]
        if cells:
            lines.append(" | ".join(cells))
    return "Table data: " + "; ".join(lines) if lines else ""


def _block(x: Node, sep: str) -> str:
    """The text of a block with its label, or nothing; the text itself has to be long enough."""
    text = x.text(sep)
    if len(text) < MIN_BLOCK:
        return ""
    if x.tag in ("ul", "ol"):
        items = [t for c in x.children if isinstance(c, Node) and c.tag == "li" and len(t := c.text(sep)) > MIN_ITEM]
        return "Items: " + "; ".join(items) if items else ""
    if x.tag == "dl":
        pairs = [f"{t}: {v}" for t, v in _definitions(x, sep)]
        return "Definitions: " + "; ".join(pairs) if pairs else ""
    if x.tag == "table":
        return table_text(x, sep)
    return {"p": "", "blockquote": "Note: "}.get(x.tag, "Section: ") + text


def _definitions(dl: Node, sep: str) -> list[tuple[str, str]]:
    pairs = zip(below(dl, "dt"), below(dl, "dd"), strict=False)
    return [(t, v) for x, y in pairs if (t := x.text(sep)) and (v := y.text(sep))]


def blocks(part: Node, sep: str = "") -> list[str]:
    """Text blocks in document order, blocks inside blocks too; equal neighbours once."""
    found = (_block(x, sep) for x in below(part, *HEADINGS, "p", "ul", "ol", "table", "blockquote", "dl"))
    return [text for text, _ in groupby(filter(None, found))]


def is_question(text: str) -> bool:
    return "?" in text or text.lower().startswith(QUESTION_WORDS)


def faqs(root: Node, sep: str = "") -> list[dict]:
    """Question and answer pairs of marked containers, definition lists and question headings; the first of each question stays."""
    pairs: list[tuple[str, str]] = []
    for box in below(root):
        if FAQ_CLASS.search(box.attrs.get("class", "")):
            parts = [[x.text(sep) for x in below(box) if p.search(x.attrs.get("class", ""))] for p in (QUESTION_CLASS, ANSWER_CLASS)]
            pairs += [(q, a) for q, a in zip(*parts, strict=False) if q and len(a) > MIN_ANSWER]
    for dl in below(root, "dl"):
        pairs += [(q, a) for q, a in _definitions(dl, sep) if is_question(q)]
    for x in root.walk():
        kids = [c for c in x.children if isinstance(c, Node)]
        for i, h in enumerate(kids):
            if h.tag in ("h2", "h3", "h4") and "?" in h.text(sep):
                after = takewhile(lambda s: s.tag not in ("h1", "h2", "h3", "h4"), kids[i + 1 :])
                answer = [s.text(sep) for s in after if s.tag in ("p", "ul", "ol")]
                if answer:
                    pairs.append((h.text(sep), " ".join(answer)[:MAX_ANSWER]))
    seen: dict[str, dict] = {}
    for q, a in pairs:
        seen.setdefault(q.lower()[:50], {"question": q, "answer": a})
    return list(seen.values())


def links(root: Node, base: str) -> tuple[list[str], list[str]]:
    """(pages of the same site, linked documents), each once, in order. Documents of the site are among its pages too."""
    site = urlsplit(base).netloc
    pages, documents = {}, {}
    for x in root.all("a"):
        if "href" not in x.attrs:
            continue
        href = x.attrs["href"]
        try:
            full = urljoin(base, href)
            parts = urlsplit(full)
        except ValueError:
            continue
        if parts.path.lower().endswith(DOCUMENTS):
            documents[full] = None
        if href and not href.startswith(NO_PAGE) and (site in parts.netloc or parts.netloc in site):
            pages[f"{parts.scheme}://{parts.netloc}{parts.path}".rstrip("/")] = None
    return list(pages), list(documents)


def tidy(text: str) -> str:
    """Blank lines and spaces collapsed, common page boilerplate dropped (see functions.text.clean_text)."""
    text = re.sub(r"\n\s*\n\s*\n+", "\n\n", text)
    text = re.sub(r"[ \t]+", " ", text)
    return re.sub("(?i)skip to main content|back to top", "", text).strip()


def markdown(html: str | Node, url: str) -> str:
    """The flat Markdown form: title, source, then headings, paragraphs, items and cells line by line."""
    root = cleaned(parse(html) if isinstance(html, str) else html, DROPPED_FLAT, None)
    tests = (lambda x: x.tag == "main", lambda x: x.tag == "article", lambda x: re.search("content|main|article", x.attrs.get("class", ""), re.I), lambda x: x.tag == "body")
    part = next((x for t in tests for x in root.walk() if t(x)), root)
    title = next(iter(root.all("title")), None)
    out = ["# " + ("Untitled" if title is None else "".join(c for c in title.children if isinstance(c, str)) or "None"), f"\nSource: {url}\n"]
    for x in below(part, "h1", "h2", "h3", "h4", "p", "li", "td", "th"):
        if text := x.text():
            out.append(f"\n{'#' * HEADINGS[x.tag]} {text}\n" if x.tag in HEADINGS else f"- {text}" if x.tag == "li" else f"| {text} " if x.tag in ("td", "th") else text)
    return tidy("\n".join(out))


def full_markdown(html: str | Node, url: str) -> str | None:
    """The full Markdown form with its source; null if it has no more than MIN_PAGE characters."""
    root = cleaned(parse(html) if isinstance(html, str) else html, DROPPED_FULL, None)
    classes = lambda x: x.attrs.get("class", "").split()
    tests = (lambda x: x.tag == "main", lambda x: x.tag == "article", lambda x: x.tag == "div" and "content" in classes(x), lambda x: x.tag == "div" and x.attrs.get("id") == "content", lambda x: x.tag == "div" and "main-content" in classes(x), lambda x: x.tag == "body")
    part = next((x for t in tests for x in root.walk() if t(x)), root)
    lines = [line.rstrip() for line in _converted(part, 0).split("\n")]
    out = f"Source: {url}\n\n" + "\n".join(filter(str.strip, lines))
    return out if len(out) > MIN_PAGE else None


def _converted(x: Node, depth: int) -> str:
    inner = "".join(re.sub(r"\s+", " ", c) if isinstance(c, str) else _converted(c, depth + (c.tag in ("ul", "ol"))) for c in x.children)
    text = inner.strip()
    if x.tag in HEADINGS:
        return f"\n\n{'#' * HEADINGS[x.tag]} {text}\n\n" if text else ""
    if x.tag in ("p", "div", "section", "article", "main", "ul", "ol", "table", "dl", "dd", "dt"):
        return f"\n\n{inner.strip(' ')}\n\n"
    if x.tag == "li":
        return "\n" + "  " * max(depth - 1, 0) + "- " + text
    if x.tag == "tr":
        cells = [_converted(c, depth).strip().replace("\n", " ") for c in below(x, "td", "th")]
        rule = "\n| " + " | ".join("---" for _ in cells) + " |" if any(True for _ in below(x, "th")) else ""
        return "\n| " + " | ".join(cells) + " |" + rule
    if x.tag == "br":
        return "\n"
    if x.tag == "hr":
        return "\n\n---\n\n"
    if x.tag == "blockquote":
        return "\n\n> " + text.replace("\n", "\n> ") + "\n\n"
    if x.tag == "img":
        return f"![{x.attrs.get('alt', '')}]({x.attrs.get('src', '')})"
    if x.tag == "a" and text and x.attrs.get("href"):
        return f"[{text}]({x.attrs['href']})"
    mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}.get(x.tag, "")
    return f"{mark}{text}{mark}" if mark and text else inner


FIELDS = ("title", "chunks", "faqs", "links", "documents", "markdown", "full_markdown")


def page_data(html: str | None, url: str | None, sep: str = "", fields: tuple[str, ...] = FIELDS) -> dict:
    """Parts of a page, from one parse. sep stands between pieces of inline markup: none, or a space for prose that reads better."""
    tree, url, out = parse(html or ""), url or "", {}
    if {"title", "chunks", "faqs", "links", "documents"} & {*fields}:
        root = cleaned(tree)
        if "title" in fields:
            out["title"] = next((x.text() for x in root.all("title")), "") or next((x.text() for x in root.all("h1")), "")
        if "chunks" in fields:
            out["chunks"] = blocks(main_part(root), sep)
        if "faqs" in fields:
            out["faqs"] = faqs(root, sep)
        if {"links", "documents"} & {*fields}:
            out |= dict(zip(("links", "documents"), links(root, url), strict=True))
    if "markdown" in fields:
        out["markdown"] = markdown(tree, url)
    if "full_markdown" in fields:
        out["full_markdown"] = full_markdown(tree, url)
    return out


def page(html_col: Column | str, url: Column | str, sep: str = "", fields: tuple[str, ...] = FIELDS) -> Column:
    """(html, url) -> structured page with these of its FIELDS; what is not asked for is not made. A task holds one small batch of pages."""
    if spark := SparkSession.getActiveSession():
        bounded_batches(spark)
    kinds = dict(x.split(":", 1) for x in re.sub(r"^struct<|>$", "", PAGE).replace(",answer", ";answer").split(","))
    kind = "struct<" + ",".join(f"{f}:{kinds[f].replace(';', ',')}" for f in fields) + ">"

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for html, url in batches:
            yield pd.DataFrame([page_data(h, u, sep, fields) for h, u in zip(html, url, strict=True)], columns=list(fields))

    return run(html_col, url)
