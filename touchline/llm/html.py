"""Main text of web pages: marked-up boilerplate goes by rule, the rest of a site's template by recurrence.

Each page is read into element subtrees. Subtrees are hashed and counted per host in Spark; a subtree that recurs on
many pages of a host belongs to one of its templates and is deleted from all of them.
"""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from touchline.llm.work import cut, map_rows

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
NEVER_TEXT = frozenset(
    "script style noscript template head nav footer aside form button select textarea input iframe svg math canvas object audio video dialog menu map".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An opening tag ends an open element of these names, up to the given boundary.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
#: Words of class, id and role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsored sponsor promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing "
    "social related recommended recommendations comment comments commentlist disqus respond replies pagination pager toolbar widget widgets skip copyright "
    "disclaimer contentinfo complementary".split()
)
KEEP = frozenset(("html", "body", "main", "article"))
#: Words that mark what readers write, often more than the article has.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: After these words of a class name, an element tells what it has or lacks, not what it is.
NEGATED = frozenset("no not non without with has have".split())
#: Elements that never hold the article, but are read if a page has no other text.
AROUND = frozenset("nav header footer aside form".split())
#: Words that mark other pages' texts and adverts; the rest of BOILERPLATE often only tells of a layout.
OTHERS = frozenset("ad ads adv advert adverts advertisement advertising sponsored sponsor promo promotion related recommended recommendations".split())
#: Why an element is dropped, the firmer the larger.
BY_TOKEN, AS_OTHERS, AS_COMMENTS, BY_TAG, FOR_GOOD = 1, 2, 3, 4, 5
#: Characters of a form from which on it can be the page's text, and of text that stays from which on no box of others'
#: texts is read, however long it is.
ENOUGH = 80

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Element:
    __slots__ = ("tag", "parent", "number", "own", "dropped", "cause", "article", "main", "parts", "hash")

    def __init__(self, tag: str, parent: "Element | None", number: int, own: int):
        self.tag, self.parent, self.number, self.own = tag, parent, number, own
        self.dropped = max(own, parent.dropped if parent else 0)
        self.cause: Element | None = self if own else parent and parent.cause  # the innermost element dropped for itself
        self.article = tag == "article" or bool(parent and parent.article)
        self.main = tag == "main" or bool(parent and parent.main)
        self.parts: list[str] = []
        self.hash: int | None = None

    def close(self) -> None:
        """Hash of the subtree: the tag, its texts and the hashes of its children, in order. Subtrees without text have none."""
        if self.parts and self.hash is None:
            digest = blake2b(f"{self.tag}({'|'.join(self.parts)})".encode("utf-8", "replace"), digest_size=8).digest()
            self.hash = int.from_bytes(digest, "little", signed=True)
            if self.parent is not None:
                self.parent.parts.append(f"#{self.hash}")


def _names(value: str) -> set[str]:
    """Words of class names, without those that a word like "no" or "has" stands before."""
    out: set[str] = set()
    for name in value.split():
        words = _WORD.findall(name)
        out.update(words[: next((i for i, w in enumerate(words) if w in NEGATED), len(words))])
    return out


def _unwanted(tag: str, attrs: str, parent: Element) -> int:
    """Why the element is dropped, 0 if it is not."""
    if tag in NEVER_TEXT and tag not in AROUND:
        return FOR_GOOD
    inside = parent.article or parent.main
    why = BY_TAG if tag in AROUND and not (tag == "header" and inside) else 0
    if tag in KEEP and tag != "article" or not attrs:
        return why
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return FOR_GOOD
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return FOR_GOOD
        elif name in ("class", "id", "role"):
            words = _names(value)
            if words & COMMENTS:
                why = max(why, AS_COMMENTS)
            elif tag == "article":
                continue
            elif words & OTHERS:
                why = max(why, AS_OTHERS)
            elif words & BOILERPLATE or not inside and words & {"header", "top", "bottom"}:
                why = max(why, BY_TOKEN)
    return why


def _causes(nodes: Iterable[Element]) -> list[Element]:
    """The elements dropped for themselves that hold any of ``nodes``, as they open."""
    out: set[Element] = set()
    for node in nodes:
        at = node.cause
        while at is not None and at not in out:
            out.add(at)
            at = at.parent.cause
    return sorted(out, key=lambda e: e.number)


def _loose(node: Element) -> bool:
    """Is it dropped by words alone, by a form around it, or as an article that a word calls a comment?"""
    at = node.cause
    while at is not None:
        if at.own > AS_OTHERS and not (at.own == BY_TAG and at.tag == "form" or at.own == AS_COMMENTS and at.tag == "article"):
            return False
        at = at.parent.cause
    return True


def _linked(node: Element) -> bool:
    while node.parent is not None and node is not node.cause:
        if node.tag == "a":
            return True
        node = node.parent
    return False


def _released(blocks: list[tuple[str, Element]], aside: dict[Element, int]) -> set[int]:
    """Numbers of the elements dropped by a word, or as a form, that hold the page's article, its main element or most of
    its text.

    ``aside`` has the characters of text by the innermost dropped element around and the element they stand in. By its
    length alone nothing is released that consists of links; nor a box of adverts or related texts beside text enough;
    nor a comment, unless it is a single article longer than all else.
    """
    seen = sum(len(t) for t, _ in blocks)
    scoped = any(n.article or n.main for _, n in blocks)
    loose = {node: size for node, size in aside.items() if _loose(node)}
    causes = _causes(loose)
    held = {e: [0, 0, 0, 0] for e in causes}  # characters: all, in an article, in a main element, in links
    for node, size in loose.items():
        for i, part in enumerate((size, size * node.article, size * node.main, size * _linked(node))):
            held[node.cause][i] += part
    for e in reversed(causes):
        if e.parent.cause is not None:
            for i, part in enumerate(held[e]):
                held[e.parent.cause][i] += part
    whole = seen + sum(loose.values())
    out: set[int] = set()
    for e in causes:
        if e.parent.cause is None or e.parent.cause.number in out:
            size, article, main, links = held[e]
            inside = e.parent.article or e.parent.main
            holds = e.own != AS_COMMENTS and not scoped and not inside and (main or article and 2 * article >= seen)
            long = 2 * size > whole and 2 * links < size and not (e.own == AS_OTHERS and seen >= ENOUGH) and not (e.own == BY_TAG and size < ENOUGH)
            if holds or long and (inside or not scoped):  # beside an article that stays, nothing is read again
                out.add(e.number)
    return out


def _scope(blocks: list[tuple[str, Element]]) -> list[tuple[str, Element]]:
    """The blocks of the article, else of the main element, else all; without articles where several small ones stand
    beside a longer text, as teasers do."""
    inside = [b for b in blocks if b[1].article]
    around = [b for b in blocks if b[1].main] or blocks
    if not inside:
        return around
    sizes: dict[Element, int] = {}
    for text, node in inside:
        top = node
        while not (top.tag == "article" and not top.parent.article):
            top = top.parent
        sizes[top] = sizes.get(top, 0) + len(text)
    others = [b for b in around if not b[1].article]
    return others if len(sizes) > 1 and sum(len(t) for t, _ in others) > max(sizes.values()) else inside


def read_blocks(page: str) -> list[tuple[str, list[int]]]:
    """Text blocks of the page's article (else its main part, else its body) in order, without what rules drop; with
    each block the hashes of the subtrees that hold it, the innermost first.

    An element dropped by a word of its class, id or role, and a form, is read again if it holds the page's article or most
    of its text. If a page would have no text, it keeps first what words dropped, then adverts and related texts, then
    comments, then navigation and forms.
    """
    blocks, aside = _read(page, set())
    if aside:
        released = _released(blocks, aside)
        if released:
            blocks, _ = _read(page, released)
        for firmest in (BY_TOKEN, AS_OTHERS, AS_COMMENTS, BY_TAG):
            if blocks:
                break
            released = {e.number for e in _causes(aside) if e.own <= firmest}
            blocks, _ = _read(page, released)
    out = []
    for whole, node in _scope(blocks):
        path = []
        while node.parent is not None:
            if node.hash is not None and node.tag not in KEEP:
                path.append(node.hash)
            node = node.parent
        out.append((whole, path))
    return out


def _read(page: str, released: set[int]) -> tuple[list[tuple[str, Element]], dict[Element, int]]:
    """The blocks of a page with their elements, and the characters of text in elements that are dropped, but not for
    good. Elements are numbered as they open; those of ``released`` are not dropped for themselves."""
    root = Element("#page", None, 0, 0)
    stack, blocks, text, opened = [root], [], [], 0
    aside: dict[Element, int] = {}

    def flush() -> None:
        if text:
            whole = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if whole:
                node = stack[-1]
                while node.tag in INLINE and node.parent is not None:
                    node = node.parent
                node.parts.append(whole)
                blocks.append((whole, node))

    def pop_to(index: int) -> None:
        while len(stack) > index:
            if stack[-1].tag not in INLINE:
                flush()
            stack.pop().close()

    def end(names: tuple[str, ...], until: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in until:
                return
            if stack[i].tag in names:
                pop_to(i)
                return

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            here = stack[-1]
            if not here.dropped:
                text.append(page[at:stop])
            elif here.dropped < FOR_GOOD and (size := len(" ".join(page[at:stop].split()))):
                aside[here] = aside.get(here, 0) + size
        if not m:
            break
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        tag, attrs = name.lower(), m["attrs"] or m["attrs2"] or ""
        if m["close"] or m["close2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
            continue
        if tag in VOID:
            if tag == "br" or tag == "hr":
                text.append(" ")
                if tag == "hr":
                    flush()
            continue
        if tag in CLOSES_P:
            end(("p",), ("table", "td", "th", "button", "object"))
        if tag in ENDS:
            end(*ENDS[tag])
        if tag not in INLINE:
            flush()
        opened += 1
        parent = stack[-1]
        stack.append(Element(tag, parent, opened, 0 if opened in released or parent.dropped == FOR_GOOD else _unwanted(tag, attrs, parent)))
        if tag in RAW:
            last = _RAW_END[tag].search(page, at)
            at = last.start() if last else len(page)
    pop_to(1)
    flush()
    return blocks, aside


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the url's host, null without one."""
    host = F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    return pages.select("page_id", "url", host.alias("host"), "html")


def parse(hosted: DataFrame) -> DataFrame:
    """page_id, url, host and the blocks of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["page_id", "url", "host"]].copy()
            out["blocks"] = [[{"text": t, "path": p} for t, p in read_blocks(h)] if isinstance(h, str) else [] for h in batch["html"]]
            yield out

    blocks = StructType.fromDDL("blocks array<struct<text:string,path:array<bigint>>>")
    schema = StructType(hosted.select("page_id", "url", "host").schema.fields + blocks.fields)
    return map_rows(hosted, run, schema, ["page_id", "url", "host"])


def templates(hosted: DataFrame, min_pages: int, share: float) -> DataFrame:
    """The subtrees of each host's templates: on at least ``min_pages`` pages and on more than ``share`` of the host's.

    A host's list has at most 1/share times the mean number of subtrees of its pages.
    """
    hosted = hosted.where(F.col("host").isNotNull())
    hosts = hosted.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    subtree = F.explode(F.array_distinct(F.flatten(F.col("blocks.path")))).alias("subtree")
    counts = parse(hosted).select("host", subtree).groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(hosts, "host").where(F.col("n") > share * F.col("pages")).groupBy("host").agg(F.collect_list("subtree").alias("template"))


def extract(pages: DataFrame, min_pages: int = 6, share: float = 0.01) -> DataFrame:
    """page_id, url, host, text and n_chars of every page.

    Dropped by rule: scripts, styles, navigation, headers and footers of the page, sidebars, forms, hidden parts, and
    elements whose class, id or role names an advert, notice, comment section or the like. If the page has articles,
    only they count, else its main part, else its body. Then template subtrees of the host go: those on at least
    ``min_pages`` of its pages and on more than ``share`` of them, so that sections and layouts have templates of their
    own. If nothing would remain after the rules or
    after the templates, the page keeps its text. White space within a block is one blank, blocks are joined by a newline. A null or empty page gives the empty text; a null or odd url belongs to no host. Repeated rows come back
    as often, and count as pages. Broken markup (open tags, quotes, comments) is read to the end of the page. Other
    columns are ignored.
    """
    hosted = with_host(pages)
    template = cut(templates(hosted, min_pages, share), "templates")  # a table of its own: hot hosts can be split in the join
    known = parse(hosted).join(template, "host", "left")
    found = F.array_intersect(F.flatten(F.col("blocks.path")), F.col("template"))  # once a page, however long the host's list
    kept = F.get(F.transform(F.array(found), lambda t: F.filter("blocks", lambda b: ~F.arrays_overlap(b["path"], t))), 0)
    known = known.select("page_id", "url", "host", "blocks", F.when(F.col("template").isNotNull(), kept).alias("kept"))
    blocks = F.when(F.col("kept").isNull() | (F.size("kept") == 0), F.col("blocks")).otherwise(F.col("kept"))
    text = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")
    return known.select("page_id", "url", "host", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
