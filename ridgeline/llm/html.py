"""Main-text extraction by consensus of a host's pages.

Each page's containers are scored by the text of the blocks in them, less link text; from the best one it goes up to the
container around it that has most such text. That one's generalised
tag-class path (tags and classes from the root, digits made alike) is the page's vote; votes are added up by host and
path in Spark. Then every page is read again, and the blocks under its host's winning path are its text: the first of
the host's ranked paths (all that at least two pages vote for) that the page has, or the page's own best container if it
has none of them.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are known by tag, role
and class and never count or come out. A class that only says what an element has ("with-sidebar") is none of these, nor
is an element that holds the page's main, or its only article and there most of its text. Nulls: a null html gives an empty text; pages without a host (null or odd urls)
vote together. Repeated rows each give a row and a vote. An empty table gives an empty table, very long pages are read
whole in one pass, other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import settle

#: HTML's elements without content, those whose content is no markup, and those that stand as blocks.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "object", "title"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINER = {"article", "body", "div", "main", "section", "td"}
NOT_TEXT = {"aside", "button", "dialog", "footer", "form", "head", "header", "menu", "nav", "select"}
NOT_TEXT_ROLE = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
NOT_TEXT_CLASS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|comments?|commentlist|disqus|repl(?:y|ies)"
    r"|share|sharing|social|related|newsletter|subscribe|popup|modal|widget|toolbar|pagination|pager|login|signup|search)(?:$|[\s_-])", re.I)  # fmt: skip
#: What in a class says something of an element's make-up ("with-sidebar", "comments-open") and doesn't name it.
MODIFIER = re.compile(r"(?<![^\s_-])(?:with|without|no|has|have)[_-]\S*|(?<!\S)\S*[_-](?:open|opened|closed|enabled|disabled|on|off)(?!\S)", re.I)
#: What an opening tag closes, if it is open inside the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|$)")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Page:
    """blocks: (text, link characters, places of the containers it lies in, from the root); paths: by container."""

    def __init__(self, html: str):
        self._read(html, set())
        if whole := self._wrappers():
            self._read(html, whole)

    def _wrappers(self) -> set[int]:
        """Elements that a class or id calls no text, but that hold the page's main, or its only article and in that more
        text than there is elsewhere."""
        spoken = sum(len(text) for text, _, _ in self.blocks)
        return self.mains | (self.around if self.articles == 1 and self.muted > spoken else set())

    def _read(self, html: str, whole: set[int]) -> None:
        """whole: places of elements that are text whatever their class."""
        self.blocks: list[tuple[str, int, tuple[int, ...]]] = []
        self.paths: list[str] = []
        # places of elements silent by class alone around a main, around an article; articles; characters in that article
        self.mains: set[int] = set()
        self.around: set[int] = set()
        self.articles = self.muted = 0
        # open elements: tag, whether it is no text (its place or its parent's if a class alone says so), path, containers, whether it is a link
        stack: list[tuple[str, bool | int, str, tuple[int, ...], bool]] = [("", False, "", (), False)]
        article, depth = stack[0], -1
        words: list[str] = []
        linked, at, size = 0, 0, len(html)

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(words).split())
            if text:
                self.blocks.append((text, linked, stack[-1][3]))
            words.clear()
            linked = 0

        def say(text: str) -> None:
            nonlocal linked
            if stack[-1][1] and stack[-1][1] is not True and 0 <= depth < len(stack) and stack[depth] is article:
                self.muted += len(text)
            if text and not stack[-1][1]:
                text = entities.unescape(text)
                words.append(text)
                linked += len(text) if stack[-1][4] else 0

        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                say(html[at:])
                break
            if lt > at:
                say(html[at:lt])
            nxt = html[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                close = "-->" if html.startswith("<!--", lt) else ">"
                end = html.find(close, lt + 2)
                at = size if end < 0 else end + len(close)
                continue
            m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
            if not m:
                say("<")
                at = lt + 1
                continue
            at, closing, tag, attrs = m.end(), m[1], m[2].lower(), m[3]
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        if any(x[0] in BLOCK for x in stack[k:]):
                            flush()
                        del stack[k:]
                        break
                continue
            if tag in RAW:
                if not attrs.rstrip().endswith("/"):
                    end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    at = end.end() if end else size
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    words.append(" ")  # the others leave the text around them as it stands
                continue
            if tag in BLOCK:
                flush()
                self._imply(tag, stack)
            _, silent, path, inside, link = stack[-1]
            classes, named, role = "", False, ""
            if attrs:
                found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
                classes, role = found.get("class", ""), found.get("role", "").lower()
                hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in NOT_TEXT_ROLE
                hidden = hidden or "display:none" in found.get("style", "").replace(" ", "").lower()
                named = tag not in ("html", "body", "main") and role != "main" and at not in whole and (self._names_no_text(classes) or self._names_no_text(found.get("id", "")))
                silent = True if hidden or silent is True else at if named else silent
            silent = True if tag in NOT_TEXT else silent
            if tag in BLOCK:
                name = ".".join([tag, *sorted({re.sub(r"\d+", "0", c.lower()) for c in classes.split()})])
                path = f"{path}>{name}"
            if tag in CONTAINER and not silent:
                inside = (*inside, len(self.paths))
                self.paths.append(path)
            stack.append((tag, silent, path, inside, link or tag == "a"))
            self.articles += tag == "article"
            if silent and silent is not True and not named and (tag in ("main", "article") or role == "main"):
                around = {x[1] for x in stack if x[1]}
                if tag == "article":
                    self.around, article, depth = around, stack[-1], len(stack) - 1
                else:
                    self.mains |= around
        flush()

    @staticmethod
    def _names_no_text(names: str) -> bool:
        return bool(NOT_TEXT_CLASS.search(names)) and bool(NOT_TEXT_CLASS.search(MODIFIER.sub("", names)))

    @staticmethod
    def _imply(tag: str, stack: list) -> None:
        """Closes what the opening block tag closes without saying so."""
        closes, within = IMPLIED.get(tag, ({"p", "h1", "h2", "h3", "h4", "h5", "h6"} if tag[0] == "h" and tag[1:].isdigit() else {"p"}, CONTAINER | {"li", "table", "blockquote", "td", "th"}))
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in closes:
                del stack[k:]
                return
            if stack[k][0] in within:
                return

    def scores(self) -> dict[str, float]:
        """By path: characters that are no links in the blocks right in its containers, and half of those one deeper."""
        out: dict[str, float] = {}
        for text, linked, inside in self.blocks:
            worth = len(text) - 2 * linked
            for share, k in zip((1.0, 0.5), reversed(inside), strict=False):
                out[self.paths[k]] = out.get(self.paths[k], 0.0) + share * worth
        return out

    def best(self) -> tuple[str, float] | None:
        """The path of the best score, or of the container around it, however far, under which most text lies that is no
        links: title, lead and sister sections belong to the text. With it, that text's characters."""
        scored = self.scores()
        if not scored:
            return None
        path = max(scored.items(), key=lambda x: (x[1], x[0]))[0]
        under: dict[str, float] = {}
        for text, linked, inside in self.blocks:
            for k in inside:
                under[self.paths[k]] = under.get(self.paths[k], 0.0) + len(text) - 2 * linked
        around = next(inside for _, _, inside in self.blocks if any(self.paths[k] == path for k in inside))
        chain = [self.paths[k] for k in around]
        return max(((p, under[p]) for p in reversed(chain[: chain.index(path) + 1])), key=lambda x: x[1])  # the innermost of equals

    def text(self, ranked: list[str]) -> str:
        """The blocks under the first of the paths that the page has text in; under its own best container else."""
        have = {self.paths[k] for _, _, inside in self.blocks for k in inside}
        own = self.best()
        path = next((p for p in ranked if p in have), own[0] if own else None)
        return "\n\n".join(text for text, _, inside in self.blocks if path is None or any(self.paths[k] == path for k in inside))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes (pages whose best container has it), score: over all pages, added up where they are read first."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(host, *best) for host, html in zip(pdf.host, pdf.html, strict=True) if (best := Page(html).best())]
            yield pd.DataFrame(rows, columns=["host", "path", "score"]).astype({"host": "object", "path": "object", "score": "float64"})

    slim = pages.select(host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    cast = slim.mapInPandas(vote, "host string, path string, score double")
    return cast.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))


def consensus(pages: DataFrame, least: int = 2) -> DataFrame:
    """host, ranked: all paths that at least `least` of its pages vote for, those with the most votes first (ties: more text,
    then by name), written to the shared folder. A path that one page alone votes for is no consensus; that page has it as
    its own best container."""
    voted = votes(pages).where(F.col("votes") >= least)
    order = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")))
    ranked = voted.groupBy("host").agg(order.alias("r")).select("host", F.col("r.path").alias("ranked"))
    return settle(ranked, "paths")  # of known size: Spark sends it or joins it


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host for each row of pages."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [Page(html).text([] if ranked is None else list(ranked)) for html, ranked in zip(pdf.html, pdf.ranked, strict=True)]
            yield pd.DataFrame({"page_id": pdf.page_id.astype("Int64"), "url": pdf.url, "text": text, "n_chars": [len(t) for t in text], "host": pdf.host})

    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    joined = slim.join(consensus(pages), "host", "left").select("page_id", "url", "html", "host", "ranked")
    return joined.mapInPandas(read, "page_id bigint, url string, text string, n_chars bigint, host string")
