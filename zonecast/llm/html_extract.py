"""Main text of web pages, by deducing each host's template from equivalence classes of tokens."""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.shared import Scratch, join_by_key
from zonecast.llm.url_filter import split_url

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<", re.S)
#: A comment or a tag that the page ends in.
CUT_OFF = re.compile(r"<(?:!--.*|/?[A-Za-z][^<>]*\Z)|(?!)(.)(.)(.)", re.S)
#: Elements whose content is not markup: it runs to the element's own end tag.
RAW = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")}
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Elements that may hold blocks; the path of a token names these.
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol li table tbody tr td th dl dt dd figure blockquote details menu dialog fieldset address".split())
#: Elements that begin and end a block of text.
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr caption figcaption thead tfoot summary legend option title".split())
#: Elements that pages leave open: one of the first kind ends at the next of the second, within the third.
ENDED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
}
#: Elements that are no part of an article.
DROPPED_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
#: Elements within a block whose content is no part of it.
CONTROLS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("button", "select")}
#: Names in class, id or role that mark an element as no part of the article.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo promotion banner cookie cookies consent notice notices alert popup modal newsletter subscribe "
    "sidebar side nav navigation navbar menu breadcrumb breadcrumbs pagination footer comment comments reply replies respond share sharing social related recommended".split()
)
#: Words that such a name may have beside it and still be the element's own name.
PLACES = frozenset("left right top bottom box block section list area widget bar site page".split())
NAME = re.compile(r"[a-z]+")
MAIN_TAGS = ("article", "main")
#: Elements whose names say nothing against them.
NEVER_NAMED = frozenset(("html", "body", *MAIN_TAGS))
#: Elements without content, which end where they begin.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Pages of a host, at least, that hold a class for its text to count as template, and the share of pages that counts as nearly all.
SUPPORT, NEARLY_ALL = 10, 0.9


def _named_off(tag: str, names: str) -> bool:
    """Whether some whole name in class, id or role is one of the listed, alone or with others of them or with places."""
    if tag in NEVER_NAMED:
        return False
    parts = [set(NAME.findall(name)) for name in names.lower().split()]
    return any(own & DROPPED_NAMES and own <= DROPPED_NAMES | PLACES for own in parts)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def container_token(parent: int, tag: str, names: str) -> int:
    """The token of a container: what it and all it is in are called."""
    return _hash(f"{parent}/{tag}[{names}]")


def text_token(parent: int, text: str) -> int:
    return _hash(f"{parent}\n{text}")


class Node(NamedTuple):
    """A container path of a page. All elements of one path are one node."""

    parent: int
    tag: str
    depth: int
    token: int
    #: In an element dropped by its tag.
    gone: bool
    #: The innermost node, this one included, that is dropped by its names; -1 if there is none.
    off: int
    #: In an article or main element, or one.
    inside: bool


class Page:
    """A page as text blocks, each under the path of its open containers; parents come before their children."""

    def __init__(self, source: str):
        self.nodes = [Node(-1, "", 0, 0, False, -1, False)]
        #: Times each node is opened.
        self.opened = [1]
        #: (node, text, the block itself is dropped by its names) in page order.
        self.blocks: list[tuple[int, str, bool]] = []
        #: Place of the first occurrence of every token.
        self.places: dict[int, int] = {}
        self._parse(source)

    def _parse(self, source: str) -> None:
        # (tag, node) of the open containers, and how many of each tag are open.
        stack, held = [("", 0)], Counter()
        children: dict[tuple[int, str, str], int] = {}
        parts: list[str] = []
        block_off = False
        # The inline element that is dropped by its names, and how deep it is in others of its tag.
        hidden, nested = None, 0
        unended: set[str] = set()

        def close_block() -> None:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                node = stack[-1][1]
                self.blocks.append((node, text, block_off))
                self.places.setdefault(text_token(self.nodes[node].token, text), len(self.places))

        def close(depth: int) -> None:
            for tag, _ in stack[depth:]:
                held[tag] -= 1
            del stack[depth:]

        def innermost(tags: tuple[str, ...], within: tuple[str, ...] = ()) -> int | None:
            if not any(held[t] for t in tags):
                return None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    return k
                if stack[k][0] in within:
                    return None
            return None

        at, size, last = 0, len(source), source.rfind(">")
        while at < size:
            # Behind the last > there is no whole tag; a comment cut off is no text.
            found = TOKEN.search(source, at) if at <= last else CUT_OFF.search(source, at)
            if hidden is None and (not found or found.start() > at):
                parts.append(html.unescape(source[at : found.start() if found else size]))
            if not found:
                break
            at = found.end()
            if found.group(2) is None:
                if found.group() == "<" and hidden is None:
                    parts.append("<")
                continue
            tag, ends = found.group(2).lower(), found.group(1) == "/"
            if tag in RAW and not ends:
                stop = RAW[tag].search(source, at)
                at = stop.end() if stop else size
                continue
            if tag in CONTROLS and not ends and tag not in unended:
                if stop := CONTROLS[tag].search(source, at):
                    at = stop.end()
                else:
                    unended.add(tag)
                continue
            if tag == "br":
                parts.append(" ")
            if tag not in BLOCKS:
                if hidden is not None:
                    nested += (tag == hidden) * (-1 if ends else 1)
                    hidden = hidden if nested else None
                elif not ends and found.group(3) and tag not in VOID and not found.group(3).endswith("/") and _named_off(tag, _values(found.group(3))):
                    hidden, nested = tag, 1
                continue
            close_block()
            block_off, hidden, nested = False, None, 0
            if tag not in CONTAINERS:
                block_off = not ends and bool(found.group(3)) and _named_off(tag, _values(found.group(3)))
                continue
            if ends:
                if (depth := innermost((tag,))) is not None:
                    close(depth)
                continue
            if tag in ENDED and (depth := innermost(*ENDED[tag])) is not None:
                close(depth)
            names = " ".join(f"{m[0].lower()}={m[1] or m[2] or m[3]}" for m in NAMED.findall(found.group(3)))
            key = (stack[-1][1], tag, names)
            node = children.get(key)
            if node is None:
                node = children[key] = len(self.nodes)
                up = self.nodes[key[0]]
                gone = up.gone or tag in DROPPED_TAGS or (tag == "header" and not up.inside)
                off = node if _named_off(tag, _values(found.group(3))) else up.off
                token = container_token(up.token, tag, names)
                self.nodes.append(Node(key[0], tag, up.depth + 1, token, gone, off, up.inside or tag in MAIN_TAGS))
                self.opened.append(0)
                self.places.setdefault(token, len(self.places))
            self.opened[node] += 1
            stack.append((tag, node))
            held[tag] += 1
        close_block()

    def within(self, top: int) -> list[bool]:
        """Whether each node is the given one or in it."""
        found = [False] * len(self.nodes)
        for k, node in enumerate(self.nodes):
            found[k] = k == top or (k > top and found[node.parent])
        return found

    def held(self) -> list[int]:
        """The characters of text in each node that nothing drops."""
        found = [0] * len(self.nodes)
        for node, text, off in self.blocks:
            if not off and not self.nodes[node].gone and self.nodes[node].off < 0:
                found[node] += len(text)
        for k in range(len(self.nodes) - 1, 0, -1):
            found[self.nodes[k].parent] += found[k]
        return found


def _values(attributes: str) -> str:
    return " ".join(m[1] or m[2] or m[3] for m in NAMED.findall(attributes))


TOKEN_SCHEMA = "host long, page long, token long, tag string, depth int, count long, place long, chars long, whole long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, html) to a row for each distinct token of the page: containers with tag and depth, text blocks with neither.

    chars is the text inside a container, and whole that of its page. Token 0 is the page itself; its whole says if it holds anything.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [field.split()[0] for field in TOKEN_SCHEMA.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for host, key, source in zip(*(batch.column(c) for c in ("host", "page", "html")), strict=True):
            page = Page(source.as_py() or "")
            chars, ends = page.held(), (host.as_py(), key.as_py())
            counts = Counter(text_token(page.nodes[node].token, text) for node, text, _ in page.blocks)
            rows.append((*ends, 0, "", 0, 1, 0, chars[0], int(bool(page.places))))
            rows += [(*ends, token, None, None, count, page.places[token], 0, 0) for token, count in counts.items()]
            rows += [(*ends, n.token, n.tag, n.depth, page.opened[k], page.places[n.token], chars[k], chars[0]) for k, n in enumerate(page.nodes) if k]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def host_templates(tokens: DataFrame, scratch: Scratch, support: int = SUPPORT) -> DataFrame:
    """(own_host, pages, mains, classes): the containers that may be the main slot, best first, and the classes of template tokens, one row per host.

    A token's occurrence vector is its count on every page of the host, kept as a sum of hashes of (page, count),
    so that equal vectors have equal sums and partial sums merge on the map side. Tokens of one vector are a class. Its text is
    template if ``support`` pages hold it and it is a layout, that is, holds a container too, or is on nearly all pages that
    are not empty. So pages that lack a class, empty, cut off or of another layout, leave the host its other classes; order and
    nesting of a class are judged on each page, see template_tokens. A main slot is a container that is opened once on each
    of its pages: an article or main element, else one with half of its pages' text. Slots of nearly all pages come
    first, then those of a layout, then the page's own elements; the deepest wins.
    """
    vector = F.sum(F.xxhash64("page", "count").cast("decimal(20,0)"))
    sums = [F.sum(c).alias(c) for c in ("count", "place", "chars", "whole")]
    seen = tokens.groupBy("host", "token", "tag", "depth").agg(F.count(F.lit(1)).alias("pages"), *sums, vector.alias("vector"))
    # Text of fewer pages is never template, and is nearly all there is: it is not kept. The rest is written, so that pages are read once.
    able = scratch.table(seen.where(F.col("tag").isNotNull() | (F.col("pages") >= support)))
    per_host = able.where("token = 0").select(F.col("host").alias("own_host"), F.col("whole").alias("filled"), F.col("pages").alias("all_pages"))
    known = able.where("token != 0").join(per_host, F.col("host") == F.col("own_host"))
    most, named = F.col("pages") >= NEARLY_ALL * F.col("filled"), F.col("tag").isin(*MAIN_TAGS)
    holds = named | ((F.col("chars") > 0) & (F.col("chars") * 2 >= F.col("whole")))
    fits = F.col("tag").isNotNull() & (F.col("count") == F.col("pages")) & holds & (most | (F.col("pages") >= support))
    tier = F.when(F.col("tag").isin("html", "body"), 0).when(most, 2).otherwise(1)
    rank = F.struct(tier.alias("tier"), named.alias("named"), F.col("depth"), F.col("chars").alias("held"), F.col("token").alias("own"))
    member = F.struct((F.col("place") / F.col("pages")).alias("place"), F.col("token"), F.col("tag").isNull().alias("text"))
    classes = known.groupBy("host", "vector").agg(
        F.max("pages").alias("pages"),
        F.max("filled").alias("filled"),
        F.max("all_pages").alias("all_pages"),
        F.collect_list(F.when(fits, rank)).alias("slots"),
        F.collect_list(F.when((F.col("pages") >= support), member)).alias("members"),
    )
    texts, layout = F.exists("members", lambda m: m.text), F.exists("members", lambda m: ~m.text)
    most = F.col("pages") >= NEARLY_ALL * F.col("filled")
    template = F.when(texts & (layout | most), F.struct("pages", F.array_sort("members").alias("members")))
    per = classes.groupBy(F.col("host").alias("own_host")).agg(F.max("all_pages").alias("pages"), F.flatten(F.collect_list("slots")).alias("slots"), F.collect_list(template).alias("found"))
    return per.select(
        "own_host",
        "pages",
        F.transform(F.sort_array("slots", asc=False), lambda r: r.own).alias("mains"),
        F.transform(F.sort_array("found", asc=False), lambda c: F.transform(c.members, lambda m: F.struct(m.token.alias("token"), m.text.alias("text")))).alias("classes"),
    )


def _crossing(one: list[int], two: list[int]) -> bool:
    """Whether neither list of places lies whole in one gap of the other."""
    return len({bisect(one, x) for x in two}) > 1 and len({bisect(two, x) for x in one}) > 1


def template_tokens(page: Page, classes: Iterable[list[dict]]) -> set[int]:
    """The text tokens of the classes that are whole on the page, in their own order, and nested with the classes before them."""
    taken: list[list[int]] = []
    found: set[int] = set()
    for members in classes:
        places = [page.places.get(m["token"], -1) for m in members]
        if places[0] < 0 or any(a >= b for a, b in zip(places, places[1:], strict=False)) or any(_crossing(places, other) for other in taken):
            continue
        taken.append(places)
        found.update(m["token"] for m in members if m["text"])
    return found


def main_text(source: str, mains: Iterable[int] | None, classes: Iterable[list[dict]]) -> str:
    """The blocks of the main slot, without template text; of any article, or of the page, if the page has no such slot.

    Elements dropped by their names are left out, but for the slot itself and what it is in, and unless nothing else is left.
    """
    page = Page(source)
    known = {node.token: k for k, node in enumerate(page.nodes) if k}
    slot = next((known[token] for token in mains or () if token in known), None)
    if slot is None or page.nodes[slot].tag in ("html", "body"):
        found = [k for k, node in enumerate(page.nodes) if node.tag in MAIN_TAGS]
        slot = min(found, key=lambda k: page.nodes[k].depth) if found else slot or 0
    inside = page.within(slot)
    held = [block for block in page.blocks if inside[block[0]] and not page.nodes[block[0]].gone]

    def stays(node: int, off: bool) -> bool:
        dropped = page.nodes[node].off
        return not off and (dropped < 0 or dropped == slot or not inside[dropped])

    own = [(page.nodes[node].token, text) for node, text, off in held if stays(node, off)] or [(page.nodes[node].token, text) for node, text, _ in held]
    boilerplate = template_tokens(page, classes)
    kept = [text for token, text in own if text_token(token, text) not in boilerplate] if boilerplate else []
    return "\n\n".join(kept or [text for _, text in own])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: int = SUPPORT) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Templates are deduced per host (the url's host; pages without one share the empty host) from all its pages; see
    host_templates. Text that all pages of a layout, or nearly all of the host, ``support`` at least, hold at one place is template,
    unless a page would lose all its text. With fewer pages two copies of an article could not be told from a template.
    Menus, page headers, footers, asides, forms, buttons, raw elements and elements named as adverts,
    notices, comments or the like are left out of the main slot. Blocks have their white space folded and are joined
    by two newlines. A null or empty html gives an empty text. Repeated rows repeat and count as one page in the vectors if
    equal; null ids pass through; other columns are not read; an empty table gives an empty result.

    A page is parsed twice, once for its host's template and once for its text, and is not shuffled: templates are few and are broadcast,
    and where they are not, see join_by_key.
    """
    host = F.xxhash64(split_url(F.col(url_col))[0])
    source = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host")
    )
    keyed = source.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")
    scratch = Scratch(pages.sparkSession)
    templates = scratch.table(host_templates(keyed.mapInArrow(_tokens, TOKEN_SCHEMA), scratch, support))
    joined = join_by_key(source, templates, {"host": "own_host"}, "pages").select("page_id", "url", "html", "mains", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(source.as_py() or "", mains.as_py(), classes.as_py() or ())
                for source, mains, classes in zip(*(batch.column(c) for c in ("html", "mains", "classes")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    id_type = source.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
