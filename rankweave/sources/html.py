"""HTML to Markdown and outlinks, after pruning what is not content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

TEXTS = ArrayType(StringType())

# Pruned elements and classes.
PRUNED_TAGS = frozenset(("script", "style", "nav", "footer", "aside", "iframe"))
PRUNED_CLASSES = frozenset(("ad-banner", "tracker"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset("p div section article ul ol table blockquote pre main header form figure tr dl dd dt".split())


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[str] = []
        self.hrefs: list[str | None] = []
        self.depth = 0  # inside a pruned element
        self.pruned: list[str] = []
        self.head = False

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if self.depth:
            if tag not in _VOID:
                self.pruned.append(tag)
                self.depth += 1
            return
        if tag in PRUNED_TAGS or PRUNED_CLASSES & set((values.get("class") or "").split()):
            if tag not in _VOID:
                self.pruned, self.depth = [tag], 1
            return
        if tag in ("head", "title"):
            self.head = True
        elif tag == "body":
            self.head = False
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "a":
            self.hrefs.append(values.get("href"))
            if values.get("href"):
                self.links.append(values["href"])
                self.parts.append("[")
        elif tag in ("b", "strong"):
            self.parts.append("**")
        elif tag in ("i", "em"):
            self.parts.append("_")
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "code":
            self.parts.append("`")
        elif tag in _BREAKS:
            self.parts.append("\n\n")

    def handle_endtag(self, tag):
        if self.depth:
            if tag in self.pruned:
                while self.pruned:
                    self.depth -= 1
                    if self.pruned.pop() == tag:
                        break
            return
        if tag == "head":
            self.head = False
        elif tag == "a" and self.hrefs:
            href = self.hrefs.pop()
            if href:
                self.parts.append(f"]({href})")
        elif tag in ("b", "strong"):
            self.parts.append("**")
        elif tag in ("i", "em"):
            self.parts.append("_")
        elif tag == "code":
            self.parts.append("`")
        elif tag in _BREAKS or re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n")

    def handle_data(self, data):
        if not self.depth and not self.head:
            self.parts.append(re.sub(r"\s+", " ", data))


def convert(page: str | None) -> tuple[str, list[str]]:
    """(Markdown of the body, hrefs in order)."""
    parser = _Markdown()
    parser.feed(page or "")
    parser.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.parts))
    return re.sub(r"\n{3,}", "\n\n", text).strip(), parser.links


def resolve(hrefs: list[str], base: str | None = None) -> list[str]:
    """Absolute links as they are, relative ones only with a base; order kept, repeats too."""
    out = []
    for h in hrefs:
        h = h.strip()
        if not h or h.startswith(("javascript:", "mailto:", "#")):
            continue
        if h.startswith("http"):
            out.append(h)
        elif base:
            try:
                out.append(urljoin(base, h))
            except ValueError:
                continue
    return out


@F.pandas_udf(StringType())
def markdown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(lambda p: convert(p)[0])


@F.pandas_udf(TEXTS)
def outlinks(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve(convert(p)[1], b) for p, b in zip(page, base, strict=True)])


def route_by_mime(mime: Column, content: Column) -> Column:
    """Text of a record by its type: HTML becomes Markdown, other text stays; PDF needs a reader and gives null."""
    kind = F.lower(F.coalesce(mime, F.lit("")))
    return F.when(kind.contains("html"), markdown(content)).when(kind.contains("pdf"), F.lit(None).cast("string")).otherwise(content)


def pdf_text(content: bytes) -> tuple[str, int]:
    """Pages joined by a blank line, and their number; needs the optional package pypdf."""
    import io

    from pypdf import PdfReader

    pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(content)).pages]
    return "\n\n".join(filter(None, pages)), len(pages)
