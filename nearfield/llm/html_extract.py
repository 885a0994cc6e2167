"""Main text of web pages by wrapper induction over pages of one host.

A page's DOM tree is folded: like siblings that stand side by side (same tag
and classes, digits aside) are one slot, and so are their children; further
runs of the same kind have slots of their own, from the third on one together.
So the slots below a slot all differ, and a page's slots are few. Each host
has a pivot page, the one with the smallest page_id. A page's folded
tree is aligned with the pivot's by simple tree matching: the largest top-down
match that keeps the order of siblings. As siblings differ, this is the
heaviest increasing sequence at each node, which takes n log n.

Over all different pages of a host it is counted how the text of each slot
varies. A page's body is the deepest slot with children that holds
``BODY_SHARE`` of its text outside links. Template is

* a text that stands in the same slot of ``CONSTANT`` of the pages;
* a slot whose text is mostly links (``LINKED``), but no heading of the body;
* a slot mostly outside the body in which most texts (``RECURRING``) come again on pages with
  other bodies, as rotating adverts and menus do, or which begins with the same words on ``CONSTANT`` of the pages.

A slot mostly inside the body with a share of its text (``CORE_SHARE``), or a heading
there, is content. Copies of a page count once, and pages with equal bodies count once for
what recurs, so a host full of copies doesn't make its articles a template.

Where a slot is neither (seen on too few pages, or varying outside the body), and on hosts with under
``LEAST_PAGES`` different pages, elements and names decide: navigation,
headers and footers of the page, asides, forms, and elements whose role, class or id is the name of
a menu, an advert, a notice and so on. Scripts, styles and forms always go, and so does what is
named as readers' comments, which vary as articles do. On a host without a wrapper, text outside
``article`` and ``main`` elements goes where a page has such with content, but for headings that stand
directly before one and paragraphs between the two.

Markup is read as the HTML tokenizer does: quotes count after ``=`` only, a tag that isn't ended by the end of the
page is none of its text. Time is linear in a page's length but for the sorting of siblings; nothing recurses.

All counts cover all pages: they are sums over (slot, text, page) rows,
which no host can make large for one task. A host's wrapper has its pivot's slots, at most the
texts of one page, and slots that stand on ``LEAST_SHARE`` of its pages. Wrappers reach the pages by a join
on the host, broadcast only if their bytes are few, else salted.

Defined results: null html is an empty page with an empty text; a null url is
a host of its own; null or repeated page_ids give a row each; pages of any depth and length are read whole; an empty table
gives an empty table; extra columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from html import unescape

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, pass_id

CONSTANT, LEAST_PAGES, LEAST_SHARE = 0.8, 4, 0.05
BODY_SHARE, CORE_SHARE, LINKED, RECURRING = 0.6, 0.1, 0.6, 0.5
#: Runs of one kind of sibling that have slots of their own.
OWN_RUNS = 3
#: Bytes of wrappers up to which they are broadcast, and the salts that pages of a host are dealt by beyond.
BROADCAST_BYTES, SALTS = 64 << 20, 64

#: Fixed values of HTML: elements without content, with raw text, that stand as blocks, and that end an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
BLOCK = ENDS_P | frozenset("html head body li dt dd tr td th thead tbody tfoot caption legend optgroup option center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Open elements that a start tag ends, by tag, and those beyond which it ends none.
CLOSES = {
    **dict.fromkeys(ENDS_P, (("p",), ("td", "th", "button", "article", "section", "div", "li", "blockquote", "body"))),
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot"), ("table",))),
}
#: Elements that hold no text of a page, and those that are never its main text.
NO_TEXT = frozenset("head script style noscript template form button select textarea input iframe object svg canvas dialog title".split())
DROPPED = NO_TEXT | frozenset("nav aside footer menu".split())
SLOTTED = BLOCK | DROPPED
#: Names (of a class, id or role) that say what isn't main text; a compound says so if all its words are such or say where and how something stands.
SAYS_SO = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promos promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar complementary footer contentinfo masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets toolbar pagination pager skip copyright disclaimer search searchbox".split()
)
COMMENTS = frozenset("comment comments disqus respond replies discussion".split())
PLACES = frozenset("a an the of top bottom left right main inner outer upper lower first last big small list item items box boxes bar area wrap wrapper container holder row col column block section panel inline sticky fixed site page global primary secondary header footer form field button buttons link links icon icons media posts post articles article thread body title text js thing this".split())
HEADER_NAMES = frozenset(("header", "topbar", "masthead", "banner", "nav", "navbar"))
_TAG = re.compile(r"<([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
_END = re.compile(r"</([A-Za-z][^\s/>]*+)[^>]*+>")
_ATTR = re.compile(r"([^\s/=\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_NAMES = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_SMALL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.IGNORECASE) for tag in RAW}


@lru_cache(maxsize=16384)
def attributes(source: str) -> tuple[str, tuple[str, ...], bool]:
    """What a slot is called after the class (or id), the names of class, id and role, and whether the element is hidden."""
    if not _NAMES.search(source):
        return "", (), False
    classes, names, hidden = (), (), False
    for name, a, b, c in _ATTR.findall(source):
        name, value = name.lower(), a or b or c
        if name == "class":
            classes = tuple(value.split())
        elif name in ("id", "role"):
            names += tuple(value.split())
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            hidden = True
    kind = ".".join(re.sub(r"[0-9]+", "", x).lower() for x in (classes or names)[:2])
    return ("." + kind if kind else ""), classes + names, hidden


@lru_cache(maxsize=16384)
def meaning(name: str) -> int:
    """0: says nothing; 1: isn't main text; 2: readers' comments; 3: a page's header; 4: a page's header, and no main text anywhere."""
    words = [w.lower() for w in _SMALL.findall(name)]
    if not words or len(words) > 6:
        return 0
    found = 0
    for word in words:
        if word in COMMENTS:
            found = 2
        elif word in SAYS_SO:
            found = found or 1
        elif word not in PLACES:
            # words run together: commentlist, sidebarleft
            head = next((n for n in range(len(word) - 1, 2, -1) if word[n:] in PLACES and (word[:n] in COMMENTS or word[:n] in SAYS_SO)), 0)
            if not head:
                return 0
            found = 2 if word[:head] in COMMENTS else found or 1
    if found < 2 and not HEADER_NAMES.isdisjoint(words):
        return 3 + found
    return found


def says(tag: str, names: tuple[str, ...], hidden: bool, in_main: bool, held: bool, headed: bool) -> int:
    """What an element and its names say of its text: 0 nothing, 1 that it isn't main text, 2 that it never is."""
    if hidden or tag in NO_TEXT:
        return 2
    if tag in ("html", "body", "main", "article"):
        return 0
    if tag in DROPPED or tag == "header" and not in_main:
        return 1
    found = {meaning(x) for x in names}
    if 2 in found and not (held or headed):
        return 2
    if not in_main and not held and (3 in found or 4 in found):
        return 1
    return int((1 in found or 4 in found) and not (held or headed))


class Tree:
    """A page: elements in the order of their start tags, and events: a start tag's number, ~number at its end, or a text."""

    __slots__ = ("tags", "parents", "sources", "events")

    def __init__(self):
        self.tags, self.parents, self.sources, self.events = ["#root"], [-1], [""], []


def parse(html: str) -> Tree:
    out = Tree()
    tags, parents, sources, events = out.tags, out.parents, out.sources, out.events
    stack, blocks = [0], []  # open elements; places in the stack of open blocks
    places: dict[str, list[int]] = {}  # places in the stack of open elements, by tag
    top = lambda tag: p[-1] if (p := places.get(tag)) else -1

    def close(to: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            events.append(~node)
            places[tags[node]].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        to = html.find("<", at)
        while 0 <= to < n - 1 and not (html[to + 1] in "!/?" or html[to + 1].isascii() and html[to + 1].isalpha()):
            to = html.find("<", to + 1)
        if to < 0 or to == n - 1:
            events.append(html[at:])
            break
        if to > at:
            events.append(html[at:to])
        if to > last:  # not ended
            break
        sign = html[to + 1]
        if sign == "!" or sign == "?":
            if html.startswith("<!--", to):
                end = html.find("-->", to + 2 if html.startswith("<!-->", to) else to + 4)
                at = end + 3 if end >= 0 else n
            else:
                at = html.find(">", to) + 1
            continue
        if sign == "/":
            m = _END.match(html, to)
            if not m:
                at = html.find(">", to) + 1
                continue
            at, tag = m.end(), m[1].lower()
            place = top(tag)
            if place > 0 and (tag in BLOCK or not blocks or place > blocks[-1]):
                close(place)
            continue
        m = _TAG.match(html, to)
        if not m:  # not ended
            break
        at, tag, source = m.end(), m[1].lower(), m[2]
        if tag in CLOSES:
            names, stops = CLOSES[tag]
            place = max(map(top, names))
            if place > 0 and place > max(map(top, stops)):
                close(place)
        node = len(tags)
        tags.append(tag)
        parents.append(stack[-1])
        sources.append(source)
        events.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else n
            events.append(~node)
        elif tag in VOID or source.endswith("/") and tag not in BLOCK:
            events.append(~node)
        else:
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
    close(1)
    return out


class Block:
    __slots__ = ("parts", "slot", "main", "named", "lead", "links", "heading")

    def __init__(self, slot, main, named, heading):
        self.parts, self.slot, self.main, self.named, self.heading, self.lead, self.links = [], slot, main, named, heading, False, 0


class Folded:
    """The folded tree: per slot its path's hash, its parent and whether it has children, in order of first sight."""

    __slots__ = ("hashes", "parents", "inner")

    def __init__(self):
        self.hashes, self.parents, self.inner = [0], [-1], [False]


def signed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def fold(tree: Tree) -> tuple[Folded, list[int]]:
    """The folded tree, and each element's slot."""
    out, slots = Folded(), [0] * len(tree.tags)
    hashes, parents, inner = out.hashes, out.parents, out.inner
    known: dict[tuple[int, str, int], int] = {}
    last: list[str | None] = [None] * len(tree.tags)  # the last child's sign, of block elements
    runs: dict[tuple[int, str], int] = {}
    frame = [0] * len(tree.tags)  # the block element that an element's children stand in
    for i in range(1, len(tree.tags)):
        tag, up = tree.tags[i], frame[tree.parents[i]]
        if tag not in SLOTTED:
            slots[i], frame[i] = slots[up], up
            continue
        sign = tag + attributes(tree.sources[i])[0]
        if last[up] != sign:
            last[up] = sign
            runs[up, sign] = runs.get((up, sign), -1) + 1
        key = slots[up], sign, min(runs[up, sign], OWN_RUNS - 1)
        place = known.get(key)
        if place is None:
            place = known[key] = len(hashes)
            hashes.append(signed(f"{hashes[key[0]]}>{sign}~{key[2]}"))
            parents.append(key[0])
            inner[key[0]] = True
            inner.append(False)
        slots[i], frame[i] = place, i
    return out, slots


def heaviest_increasing(places: list[int], weights: list[int]) -> list[int]:
    """The numbers of an increasing sequence of places with the largest sum of weights; places all differ."""
    if all(a < b for a, b in zip(places, places[1:])):
        return list(range(len(places)))
    rank = {p: i + 1 for i, p in enumerate(sorted(places))}
    best: list[tuple[int, int]] = [(0, -1)] * (len(places) + 1)  # a Fenwick tree of (sum, last)
    before, total = [-1] * len(places), [0] * len(places)
    for i, p in enumerate(places):
        at, got = rank[p] - 1, (0, -1)
        while at:
            got = max(got, best[at])
            at &= at - 1
        total[i], before[i] = got[0] + weights[i], got[1]
        at = rank[p]
        while at < len(best):
            best[at] = max(best[at], (total[i], i))
            at += at & -at
    i, out = max(range(len(places)), key=lambda j: (total[j], j)), []
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(tree: Folded, pivot: dict[int, int]) -> list[bool]:
    """Which slots simple tree matching pairs with the pivot's. pivot: the number of each slot of the pivot's tree in order, by its path's hash."""
    children: list[list[int]] = [[] for _ in tree.hashes]
    weights, chosen = [0] * len(tree.hashes), [[] for _ in tree.hashes]
    for i in range(len(tree.hashes) - 1, -1, -1):
        if tree.hashes[i] not in pivot:
            continue
        own = children[i][::-1]
        taken = [own[j] for j in heaviest_increasing([pivot[tree.hashes[c]] for c in own], [weights[c] for c in own])] if own else []
        chosen[i], weights[i] = taken, 1 + sum(weights[c] for c in taken)
        if i:
            children[tree.parents[i]].append(i)
    out = [False] * len(tree.hashes)
    todo = [0] if weights[0] else []
    while todo:
        i = todo.pop()
        out[i] = True
        todo += chosen[i]
    return out


def blocks(tree: Tree, slots: list[int]) -> list[Block]:
    """The page's blocks of text in order.

    main: the number of the article or main element around it or directly behind it, negative if its name speaks against it, or 0.
    named: 0, 1 where an element or a name says that it isn't main text, or 2 where it always goes.
    """
    tags, parents = tree.tags, tree.parents
    held = [False] * len(tags)  # elements that hold an article, a main element
    headed = [False] * len(tags)  # or a first heading
    for i in range(len(tags) - 1, 0, -1):
        up = parents[i]
        held[up] = held[up] or held[i] or tags[i] in ("article", "main")
        headed[up] = headed[up] or headed[i] or tags[i] == "h1"
    out: list[Block] = []
    main, named, linked = [0] * len(tags), [0] * len(tags), [False] * len(tags)
    lead: list[int | None] = [None] * len(tags)  # where the headings begin that only paragraphs part from what follows
    count, now = 0, 0
    for event in tree.events:
        if isinstance(event, str):
            if not event.strip():
                if out:
                    out[-1].parts.append(event)
                continue
            lead[now] = None
            if not out or out[-1].slot is None:
                if not out:
                    out.append(Block(None, 0, 0, False))
                b = out[-1]
                b.slot, b.main, b.named = slots[now], main[now], named[now]
            out[-1].parts.append(event)
            if linked[now]:
                out[-1].links += len(event.strip())
            continue
        if event < 0:
            node = ~event
            now = parents[node]
            if tags[node] in SLOTTED or named[node] != named[now]:
                out.append(Block(None, main[now], named[now], tags[now] in HEADINGS))
            continue
        node, up = event, parents[event]
        tag, now = tags[node], event
        if tag == "br":
            if out:
                out[-1].parts.append(" ")
            main[node], named[node] = main[up], named[up]
            continue
        names, hidden = attributes(tree.sources[node])[1:]
        main[node], named[node], linked[node] = main[up], max(named[up], says(tag, names, hidden, main[up] != 0, held[node], headed[node])), linked[up] or tag == "a"
        if tag in ("article", "main") and not main[up] and not named[node]:
            count += 1
            main[node] = -count if any(meaning(x) in (1, 2, 4) for x in names) and not (held[node] or headed[node]) else count
            for b in out[lead[up] :] if lead[up] is not None else ():
                b.main, b.lead = main[node], True
        if tag in HEADINGS:
            lead[up] = len(out) if lead[up] is None else lead[up]
        elif tag != "p":
            lead[up] = None
        if tag in SLOTTED or named[node] != named[up]:
            out.append(Block(None, main[node], named[node], tag in HEADINGS))
    return [b for b in out if b.slot is not None]


class Found:
    """A block as it is counted and decided on."""

    __slots__ = ("slot", "key", "text", "main", "named", "lead", "inside", "links", "heading", "first")


def page_blocks(html: str | None, pivot: dict[int, int] | None) -> tuple[list[Found], int, int]:
    """The page's blocks with text; a number that stands for all its texts, and one for those of its body."""
    tree = parse(html or "")
    folded, slots = fold(tree)
    pairs = aligned(folded, pivot) if pivot else [False] * len(folded.hashes)
    out = []
    weight = [0] * len(folded.hashes)
    places = []
    for b in blocks(tree, slots):
        text = " ".join(unescape("".join(b.parts)).split())
        if not text:
            continue
        f = Found()
        name = folded.hashes[b.slot]
        f.slot = name if pairs[b.slot] else signed(f"apart {name}")
        f.key = signed(f"{f.slot} {text}")
        f.text, f.main, f.named, f.lead, f.heading = text, b.main, b.named, b.lead, b.heading
        f.links = min(b.links, len(text))
        f.first = signed(f"{f.slot} begins " + " ".join(text.split(" ", 2)[:2]))
        out.append(f)
        places.append(b.slot)
        if b.named < 2:
            weight[b.slot] += len(text) - f.links
    total = sum(weight)
    for i in range(len(weight) - 1, 0, -1):
        weight[folded.parents[i]] += weight[i]
    body = 0
    for i in range(1, len(weight)):  # a slot stands behind its parent
        if folded.parents[i] == body and folded.inner[i] and weight[i] >= BODY_SHARE * total and total:
            body = i
    within = [i == body for i in range(len(weight))]
    for i in range(body + 1, len(weight)):
        within[i] = within[i] or within[folded.parents[i]]
    for f, place in zip(out, places):
        f.inside = within[place]
    whole = signed("\0".join(sorted({f.text for f in out})))
    return out, whole, signed("\0".join(sorted({f.text for f in out if f.inside and f.named < 2})))


@lru_cache(maxsize=256)
def numbered(pivot: bytes) -> dict[int, int]:
    return {h: i for i, h in enumerate(np.frombuffer(pivot, "<i8").tolist())}


def skeleton(html: str | None) -> bytes:
    """The path hashes of a page's folded tree, in order."""
    return np.array(fold(parse(html or ""))[0].hashes, "<i8").tobytes()


class Wrapper:
    """What is known of a host: texts (as keys) and slots of its template, and slots of its content."""

    def __init__(self, keys=(), template=(), content=()):
        self.keys, self.template, self.content = frozenset(keys or ()), frozenset(template or ()), frozenset(content or ())

    def drops(self, f: Found) -> bool:
        if f.named == 2 or f.key in self.keys or f.slot in self.template:
            return True
        return f.slot not in self.content and f.named == 1


def main_text(found: list[Found], wrapper: Wrapper | None) -> str:
    """The content blocks; without a wrapper those of article or main elements if there are any with content, those that are named otherwise only where there are no others."""
    if wrapper is not None:
        return "\n\n".join(f.text for f in found if not wrapper.drops(f))
    content = [f for f in found if not f.named]
    inside = {f.main for f in content if f.main and not f.lead}
    taken = {main for main in inside if main > 0} or inside
    return "\n\n".join(f.text for f in content if not taken or f.main in taken)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def with_hosts(rows: DataFrame, wrappers: DataFrame, size) -> DataFrame:
    """Rows with their host's line of a table, which is broadcast if it is small; else both sides are salted, so a host with very many pages is many keys."""
    total = wrappers.agg(F.coalesce(F.sum(size + F.length("host") + 64), F.lit(0))).first()[0]
    if total <= BROADCAST_BYTES:
        return rows.join(F.broadcast(wrappers), "host", "left")
    dealt = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"], "left").drop("salt")


def induce(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One wrapper per host, written: host, pivot, n_pages (different ones), texts, template and content (keys and slots; null where pages are too few)."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    first = cut(rows.groupBy("host").agg(F.min("id").alias("first")))
    chosen = with_hosts(rows, first, F.lit(8)).where("id <=> first")

    def trees(values):
        for host, html in values:
            yield host, skeleton(html)

    pivots = cut(arrow_map(chosen, ["host", "html"], trees, ["host string", "pivot binary"]).groupBy("host").agg(F.min("pivot").alias("pivot")))

    def lines(values):
        for host, html, pivot in values:
            found, whole, body = page_blocks(html, numbered(pivot) if pivot is not None else None)
            if not found:
                continue
            yield host, None, None, whole, body, 0, 0, False, False
            met = {}
            for f in found:
                if f.named < 2:
                    old = met.get(f.key, (0, 0))
                    met[f.key] = f.slot, old[1] + len(f.text), f
            for key, (slot, size, f) in met.items():
                yield host, slot, key, whole, body, size, size * f.links // len(f.text), f.inside, f.heading
                if not f.inside:
                    yield host, slot, f.first, whole, body, -1, 0, False, False

    fields = ["host string", "slot bigint", "key bigint", "whole bigint", "body bigint", "size bigint", "links bigint", "inside boolean", "heading boolean"]
    lined = arrow_map(with_hosts(rows, pivots, F.length("pivot")), ["host", "html", "pivot"], lines, fields)
    seen = lined.groupBy("host", "slot", "key", "body", "whole").agg(F.max("size").alias("size"), F.max("links").alias("links"), F.max("inside").alias("inside"), F.max("heading").alias("heading"))
    bodies = seen.groupBy("host", "slot", "key", "body").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("links").alias("links"), F.sum(F.col("inside").cast("int")).alias("inside"), F.max("heading").alias("heading"))
    keys = cut(bodies.groupBy("host", "slot", "key").agg(
        F.sum("n").alias("n"), F.count("*").alias("bodies"), F.sum("size").alias("size"), F.sum("links").alias("links"), F.sum("inside").alias("inside"), F.max("heading").alias("heading")))
    hosts = cut(keys.where("key IS NULL").select("host", F.col("n").alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES))
    few = F.broadcast if hosts.count() * 128 <= BROADCAST_BYTES else (lambda x: x)
    known = keys.where("key IS NOT NULL").join(few(hosts), "host")
    enough = F.col("n") >= CONSTANT * F.col("n_pages")
    texts = known.where(enough & (F.col("size") >= 0)).groupBy("host").agg(F.collect_list("key").alias("texts"))
    again = F.sum(F.when((F.col("size") >= 0) & (F.col("bodies") > 1), F.col("bodies")).otherwise(0))
    text = lambda c: F.sum(F.when(F.col("size") >= 0, F.col(c)).otherwise(0))
    slots = known.groupBy("host", "slot").agg(
        F.max("n_pages").alias("n_pages"), text("n").alias("n"), text("bodies").alias("bodies"), again.alias("again"), text("size").alias("size"), text("links").alias("links"), text("inside").alias("inside"),
        F.max("heading").alias("heading"), F.max(enough & (F.col("size") < 0)).alias("alike"))
    slots = cut(slots.where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= LEAST_SHARE * F.col("n_pages"))))
    of_host = slots.groupBy("host").agg(F.sum(F.when(F.col("inside") * 2 > F.col("n"), F.col("size"))).alias("host_size"))
    within = F.col("inside") * 2 > F.col("n")
    outside = ~within & (F.col("alike") | (F.col("again") >= RECURRING * F.col("bodies")) & (F.col("bodies") >= LEAST_PAGES))
    linked = (F.col("links") >= LINKED * F.col("size")) & ~(within & F.col("heading"))
    verdict = F.when(linked | outside, "template").when(within & (F.col("heading") | (F.col("size") >= CORE_SHARE * F.col("host_size"))), "content")
    slots = slots.join(few(of_host), "host").select("host", "slot", verdict.alias("verdict")).where("verdict IS NOT NULL")
    decided = slots.groupBy("host").agg(*[F.collect_list(F.when(F.col("verdict") == v, F.col("slot"))).alias(v) for v in ("template", "content")])
    return cut(pivots.join(hosts, "host", "left").join(texts, "host", "left").join(decided, "host", "left"))


def extract(pages: DataFrame, wrappers: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    if wrappers is None:
        wrappers = induce(pages, id_col, url_col, html_col)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host_of(F.col(f"`{url_col}`")).alias("host"))
    entries = sum((F.greatest(F.size(c), F.lit(0)) for c in ("texts", "template", "content")), F.lit(0))

    def run(values):
        made: dict[str, Wrapper | None] = {}
        for key, url, html, host, pivot, n_pages, texts, template, content in values:
            if host not in made:
                if len(made) >= 1024:
                    made.clear()
                made[host] = Wrapper(texts, template, content) if n_pages else None
            text = main_text(page_blocks(html, numbered(pivot) if pivot is not None else None)[0], made[host])
            yield key, url, text, len(text)

    fields = [pass_id(pages, id_col), pass_id(pages, url_col), "text string", "n_chars bigint"]
    cols = ["id", "url", "html", "host", "pivot", "n_pages", "texts", "template", "content"]
    return arrow_map(with_hosts(rows, wrappers, F.length("pivot") + 8 * entries), cols, run, fields, out_rows=512)
