"""Flat extraction from HTML with expressions, and nested structure with a table function over the standard parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

REMOVED = ("script", "style", "nav", "header", "footer")


def cleaned(html: Column) -> Column:
    """The page without scripts, styles, navigation, header, footer and comments, and with its blanks joined."""
    out = html
    for tag in REMOVED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    return F.btrim(F.regexp_replace(out, r"\s+", " "))


def visible_text(html: Column) -> Column:
    """Text between the tags of a page, blanks joined; character references stay."""
    return F.btrim(F.regexp_replace(F.regexp_replace(cleaned(html), r"(?s)<[^>]*>", " "), r"\s+", " "))


def tag_texts(html: Column, tag: str) -> Column:
    """The inner text of each such element, tags removed, in order; elements of one kind do not nest."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    return F.transform(found, lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " ")))


def headings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, position, level, title."""
    both = F.regexp_extract_all(html, F.lit(r"(?is)<(h[1-6]\b[^>]*>.*?)</h[1-6]\s*>"), F.lit(1))
    each = pages.select(key, F.posexplode(both).alias("position", "h"))
    title = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace("h", r"(?s)^h[1-6]\b[^>]*>", ""), r"(?s)<[^>]*>", " "), r"\s+", " "))
    return each.select(key, "position", F.substring("h", 2, 1).cast("int").alias("level"), title.alias("title"))


def paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = 10) -> DataFrame:
    """key, position, text, word_count of paragraphs of ``least`` characters or more."""
    each = pages.select(key, F.posexplode(tag_texts(F.col(html), "p")).alias("position", "text"))
    return each.where(F.length("text") >= least).withColumn("word_count", F.size(F.split("text", " ")).cast("long"))


def validity(html: Column) -> Column:
    """Whether at least two of five signs of an article are there, and 1000 characters of text."""
    signs = [html.rlike(r'(?i)<meta[^>]*name="citation_'), html.rlike(r'(?i)<div[^>]*class="[^"]*page-main'), html.rlike(r"(?i)<article\b"), html.contains("arxiv.org"), html.rlike(r"(?is)<title\b[^>]*>\s*[^<\s]")]
    total = F.lit(0)
    for sign in signs:
        total += sign.cast("int")
    return (total >= 2) & (F.length(visible_text(html)) >= 1000)


def url_parts(url: Column) -> list[Column]:
    return [F.regexp_extract(url, r"^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path")]


class _Structure(HTMLParser):
    """Sections, figures, tables and formulas of one page, in order."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[str, int, str, str]] = []
        self.open: list[tuple[str, dict, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "figure", "table", "caption", "figcaption", "math"):
            self.open.append((tag, dict(attrs), []))

    def handle_data(self, data: str) -> None:
        for _, _, parts in self.open:
            parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is None:
            return
        _, attrs, parts = self.open[at]
        del self.open[at:]
        text = " ".join("".join(parts).split())
        if tag[0] == "h" and tag[1:].isdigit():
            self.rows.append(("section", int(tag[1]), text, attrs.get("id") or ""))
        elif tag in ("caption", "figcaption"):
            if self.open:
                self.open[-1][1]["caption"] = text
        elif tag == "math":
            self.rows.append(("math", 0, attrs.get("alttext") or attrs.get("title") or text, attrs.get("id") or ""))
        else:
            self.rows.append((tag, 0, attrs.get("caption") or "", attrs.get("id") or ""))


@udtf(returnType="position int, kind string, level int, text string, label string")
class PageStructure:
    """Rows of a page's structure; a lateral join gives them for every page."""

    def eval(self, html: str) -> Iterator[tuple]:
        if html:
            parser = _Structure()
            parser.feed(html)
            parser.close()
            for k, row in enumerate(parser.rows):
                yield (k, *row)


def structure(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, position, kind (section, figure, table, math), level, text, label."""
    return pages.select(key, html).lateralJoin(PageStructure(F.col(html).outer())).select(key, "position", "kind", "level", "text", "label")


def section_bodies(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, position, level, title, body: what stands between a heading and the next of the same or a higher level.

    The page is cut at headings in its own row; for each one the first later cut of no deeper level ends the body.
    """
    marked = F.regexp_replace(cleaned(F.col(html)), r"(?i)<(?=h[1-6]\b)", "\u0001<")
    cut = pages.select(key, F.slice(F.split(marked, "\u0001"), 2, 1_000_000_000).alias("cuts"))
    parts = cut.select(key, F.transform("cuts", lambda c: F.struct(F.substring(c, 3, 1).cast("int").alias("level"), c.alias("html"))).alias("parts"))
    plain = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))
    each = parts.select(key, "parts", F.posexplode("parts").alias("position", "p"))
    later = F.filter(F.transform("parts", lambda x, i: F.struct(i.alias("i"), x.level.alias("level"))), lambda x: (x.i > F.col("position")) & (x.level <= F.col("p.level")))
    end = F.coalesce(F.get(later, F.lit(0))["i"], F.size("parts"))
    inside = F.array_join(F.transform(F.slice("parts", F.col("position") + 1, end - F.col("position")), lambda x: x.html), " ")
    title = F.regexp_extract("p.html", r"(?is)^<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>", 1)
    return each.select(key, "position", F.col("p.level").alias("level"), plain(title).alias("title"), plain(F.regexp_replace(inside, r"(?is)^<h[1-6]\b[^>]*>.*?</h[1-6]\s*>", "")).alias("body"))


def section_or_start(pages: DataFrame, sought: str, key: str = "page_id", html: str = "html", chars: int = 2000) -> DataFrame:
    """key, found, body: the body of the first section whose title holds ``sought`` in any case, else the first ``chars`` characters of the page.

    A page stays in its row. Null pages give a null body.
    """
    plain = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))
    heading = r"(?is)^<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>"
    page = pages.select(key, cleaned(F.col(html)).alias("page"))
    cut = page.select("*", F.slice(F.split(F.regexp_replace("page", r"(?i)<(?=h[1-6]\b)", "\u0001<"), "\u0001"), 2, 1_000_000_000).alias("cuts"))
    named = lambda c: F.contains(F.lower(plain(F.regexp_extract(c, heading, 1))), F.lit(sought.lower()))
    at = cut.select("*", F.array_position(F.transform("cuts", named), True).cast("int").alias("k"))
    rest = at.select("*", F.slice("cuts", F.col("k") + 1, 1_000_000_000).alias("later"), F.substring(F.get("cuts", F.col("k") - 1), 3, 1).alias("level"))
    ended = rest.select("*", F.array_position(F.transform("later", lambda c: F.substring(c, 3, 1) <= F.col("level")), True).cast("int").alias("end"))
    inside = F.array_join(F.slice("cuts", F.greatest("k", F.lit(1)), F.when(F.col("end") > 0, F.col("end")).otherwise(F.size("cuts"))), " ")
    start = F.substring(plain(F.regexp_replace("page", r"(?is)<head\b.*?</head\s*>", "")), 1, chars)
    body = F.when(F.col("k") > 0, plain(F.regexp_replace(inside, heading, ""))).otherwise(start)
    return ended.select(key, (F.col("k") > 0).alias("found"), body.alias("body"))


#: What marks a formula on a page: the element, and what its class holds (fixed values).
FORMULA_NODES = {"math": None, "span": "math", "div": "equation"}


def equations(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, kind (math, span, div), position among its kind, latex, number: formulas and the number "(n)" that next follows each.

    The latex is the alttext, else the title, else the text of the element up to its end or to the number inside it. A
    number is a text of its own between two tags. The page is cut at its numbers, so a piece's formulas have the number
    that ends it, those of the last piece none; all of it happens in the page's row. Null pages have no formulas.
    """
    number = r">(\(\d+\))\n?(?=<(?!/math))"
    shown = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", ""), r"(?s)<!--.*?-->", "")
    page = pages.select(key, F.split(shown, number).alias("pieces"), F.regexp_extract_all(shown, F.lit(number), F.lit(1)).alias("numbers"))
    plain = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*(?:>|\z)", " "), r"\s+", " "))  # noqa: E731  (the number may have cut a tag)

    def nodes(kind: str, marked: str | None) -> Column:
        said = rf"""[^>]*\bclass\s*=\s*["'][^"']*{marked}""" if marked else ""
        pattern = rf"(?is)<{kind}\b{said}[^>]*>.*?(?:</{kind}\s*>|\z)"
        return F.flatten(F.transform("pieces", lambda p, i: F.transform(F.regexp_extract_all(p, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("m"), F.get("numbers", i).alias("number")))))

    lists = F.array(*[F.struct(F.lit(kind).alias("kind"), nodes(kind, marked).alias("found")) for kind, marked in FORMULA_NODES.items()])
    each = page.select(key, F.inline(lists)).select(key, "kind", F.posexplode("found").alias("position", "f"))
    attribute = lambda name: F.nullif(F.regexp_extract("f.m", rf"""(?is)^<[^>]*?\s{name}\s*=\s*(["'])(.*?)\1""", 2), F.lit(""))
    latex = F.coalesce(attribute("alttext"), attribute("title"), plain(F.regexp_replace("f.m", r"(?s)^<[^>]*>", "")))
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        latex = F.replace(latex, F.lit(reference), F.lit(char))
    return each.select(key, "kind", "position", latex.alias("latex"), F.col("f.number").alias("number"))


def markdown(html: Column) -> Column:
    """A page as Markdown: headings, list items, bold, links, paragraphs; other tags dropped, empty lines removed."""
    out = F.regexp_replace(cleaned(html), r"(?is)<head\b.*?</head\s*>", "")
    for n in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", "\n" + "#" * n + " $1\n")
    for pattern, put in ((r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a\s*>', "[$2]($1)"), (r"(?is)<(?:b|strong)>(.*?)</(?:b|strong)>", "**$1**"), (r"(?i)<li\b[^>]*>", "\n* "), (r"(?i)</?(?:p|div|br|ul|ol|article|section|tr)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", "")):
        out = F.regexp_replace(out, pattern, put)
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), lambda x: F.btrim(x)), lambda x: x != ""), "\n")
