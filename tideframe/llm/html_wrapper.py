"""Main text of web pages by wrapper induction.

The DOM trees of one host's pages are aligned by simple tree matching (the largest order-preserving matching of children,
level by level) and merged into the host's template. Every page is aligned with it, and for each template node the texts at
this place are counted over the host's distinct pages:

- A place most of whose texts come again is constant. The share of repeats is smoothed towards that of the same place over
  all hosts, so a host with few pages leans on the others and one with many speaks for itself. Template are the texts that
  come again at a constant place, in a share of its pages; a text that stands there once is content. A text that half of
  a host's pages show at one place is template at this place too, though the place varies otherwise.
- The other places are slots. The host's region is found from the root by descending into the container that holds most
  of the slots' characters. A container that comes several times in a row with blocks of its own, beside the region, is a
  list of records: reader comments, teasers. A container of many short blocks beside the region is a side column.

Inside main and article texts are the article's own, repeated headings, table cells, quotations and sentences too; template
texts go there only if they are links for the most part, such as share rows. Elsewhere a template text stays if it is a
heading of the region with content right below, or a cell of a table in the region that differs from page to page.

Main text is that of all slots in a page's main element, else in its only article, without record lists after the last
text of the region. Of a page with neither, or with several articles, it is that of all slots but record lists and side
columns, and of all slots if the page has no text in the region, for then its layout is another one. Never content are
elements and roles that the standard reserves for menus, footers, asides, forms and the like, headers and lists of links
outside main and article, and places whose class says advert, if they hold a minor part of the host's slots.

Jobs: (1) a map parses the pages; distinct skeletons are counted by host; (2) skeletons are merged in rounds of MERGED a
group, so no task holds more; (3) a map aligns all pages and gives text hashes by place, counted with pre-aggregation;
pages of one longest block are copies and count once; (4) a map over the hosts marks the template's places; a place has
at most 1 / SHARE texts that are template, so a wrapper is bounded by its template; (5) a map extracts. Pages meet their host's wrapper in a join that is broadcast only if the wrappers are measured to be small, and
that Spark can split otherwise.

Bounds: elements nested deeper than DEPTH become siblings there, as in browsers; children that are not equal at either end
are aligned exactly up to CELLS pairs and within a band beyond; a template takes no more skeletons, the rarest last, once
it has NODES nodes. Blocks without a place in the template are content, so these bounds can leave boilerplate in, but
lose no text.

Defined results: null or empty html gives an empty text; a page without any content block too; pages without a host
share the wrapper of the empty host; repeated rows get equal results; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.language_id import host_of
from tideframe.llm.shared import BROADCAST_BYTES, prepare, stored

#: A place is constant if this share of its texts are repeats, after PRIOR pseudo-pages of the same place on all hosts.
REPEATS, PRIOR = 0.7, 5
#: A text is template at its place if this share of the host's pages show it there, or at a constant place this share of its texts.
OFTEN, SHARE = 0.5, 0.05
#: A container is a record if it comes several times in a row on this share of the pages that have it.
RECORDS = 0.3
#: A container is a record list too if its records hold this share of its slots' characters.
LIST = 0.9
#: A side column has so many blocks a page, of this share of the region's mean length.
SIDE_BLOCKS, SIDE_LENGTH = 3, 0.5
#: Places named as adverts go if they hold at most this share of the host's slots.
MINOR = 0.2
#: A block outside main and article with this share of its characters in links is a menu.
LINKS = 0.6
#: Skeletons merged in one group, nodes of a template, nesting, pairs of children aligned exactly, half width of the band.
MERGED, NODES, DEPTH, CELLS, BAND = 64, 4096, 200, 1 << 16, 64

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "fieldset", "datalist", "input", "audio", "video", "map"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist"}
_ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "nav", "aside", "main", "footer", "header"}
#: Elements whose repetition is an article's own structure.
_OWN = {"article", "figure", "blockquote", "table", "thead", "tbody", "tr", "td", "th", "dl", "dd", "dt"}
_AD = re.compile(r"(?:^|[_-])(?:ads?|advert[a-z]*|adsense|sponsor[a-z]*|promo[a-z]*)(?:$|[_-])")
#: Marks of a template's places: slot, slot of the region, constant, advert, off-region record list, side column, constant cell of a
#: table that varies, constant heading within the region.
SLOT, REGION, CONSTANT, ADVERT, RECORD, SIDE, CELL, HEADING = range(8)


class Node:
    __slots__ = ("tag", "label", "bad", "children", "shape")

    def __init__(self, tag: str, names: str, role: str):
        self.tag = tag
        plain = re.sub(r"[^a-z0-9_:-]", "", tag)
        first = re.sub(r"[^a-z_-]", "", names.split()[0].lower()) if names else ""
        self.label = f"{plain}.{first}" if first else plain
        self.bad = tag in _NEVER or role in _ROLES
        self.children: list = []  # nodes and (text, inside a link) pairs
        self.shape: tuple | None = None


def parse(page: str) -> Node:
    """The tree of block elements; inline elements leave their text alone."""
    root = Node("html", "", "")
    stack, links, at = [root], 0, 0
    open_, below = Counter(["html"]), []  # open elements by name; those nested too deep, with how many of each name
    deep: Counter[str] = Counter()

    def leave(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        stop = m.start() if m else n
        if stop > at:
            stack[-1].children.append((page[at:stop], links > 0))
        if not m:
            break
        at = pos = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag == "a":
                links = 0
            elif tag not in _INLINE:
                if deep[tag]:
                    while (x := below.pop()) != tag:
                        deep[x] -= 1
                    deep[tag] -= 1
                    stack[-1].children.append(Node("div", "", ""))  # the block ends here
                elif open_[tag] and tag != "html":
                    k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                    leave(k)
                    below.clear()
                    deep.clear()
                links = 0
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, pos)
            at = pos = end.end() if end else n
            continue
        if tag == "a":
            links = 1
        if tag == "br":
            stack[-1].children.append((" ", False))
        if tag in _INLINE:
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in _ENDS.get(tag, ()) or (stack[k].tag == "p" and tag in _ENDS_P):
                leave(k)
                links = 0
                break
            if stack[k].tag in _SCOPE:
                break
        if tag == "html":
            continue
        names, role = "", ""
        if "=" in attributes:
            found = [(x[1].lower(), x[2].strip("\"'")) for x in _NAMES.finditer(attributes)]
            names = " ".join(v for k, v in found if k != "role")
            role = next((v.lower() for k, v in found if k == "role"), "")
        node = Node(tag, names, role)
        stack[-1].children.append(node)
        if tag not in _VOID and not attributes.endswith("/"):
            if len(stack) < DEPTH:
                stack.append(node)
                open_[tag] += 1
            else:
                below.append(tag)
                deep[tag] += 1
    return root


# A skeleton is (label, (children, ...)); runs of children of one label are one child, merged.


def skeleton(node: Node) -> tuple:
    kids: list[tuple] = []
    for child in node.children:
        if isinstance(child, Node):
            s = skeleton(child)
            if kids and kids[-1][0] == s[0]:
                kids[-1] = kids[-1] if kids[-1] == s else merge(kids[-1], s)
            else:
                kids.append(s)
    node.shape = (node.label, tuple(kids))
    return node.shape


class Matching:
    """Simple tree matching of nodes of one label; what was found for a pair of subtrees is kept."""

    def __init__(self):
        self.found: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        self.sizes: dict[int, int] = {}
        self.alive: list[tuple] = []  # so that ids stay unique

    def size(self, s: tuple) -> int:
        n = self.sizes.get(id(s))
        if n is None:
            n = 1
            for x in s[1]:
                n += self.size(x)
            self.sizes[id(s)] = n
            self.alive.append(s)
        return n

    def __call__(self, a: tuple, b: tuple) -> tuple[int, list[tuple[int, int]]]:
        """Size of the largest matching, and the pairs of the roots' children in it."""
        key = (id(a), id(b))
        out = self.found.get(key)
        if out is None:
            self.found[key] = out = self._align(a[1], b[1])
            self.alive += (a, b)
        return out

    def _align(self, x: tuple, y: tuple) -> tuple[int, list[tuple[int, int]]]:
        head, most = 0, min(len(x), len(y))
        total = 1
        while head < most and (x[head] is y[head] or x[head] == y[head]):
            total += self.size(x[head])
            head += 1
        tail = 0
        while tail < most - head and x[-1 - tail] == y[-1 - tail]:
            total += self.size(x[-1 - tail])
            tail += 1
        pairs = [(k, k) for k in range(head)]
        m, n = len(x) - head - tail, len(y) - head - tail
        if m and n:
            score, inner = self._middle(x[head : head + m], y[head : head + n])
            total += score
            pairs += [(head + i, head + j) for i, j in inner]
        return total, pairs + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]

    def _middle(self, x: tuple, y: tuple) -> tuple[int, list[tuple[int, int]]]:
        m, n = len(x), len(y)
        half = n if m * n <= CELLS else BAND + n // m + 1
        low = [max(0, i * n // m - half) for i in range(m + 1)]
        best = [[0] * (min(n, half) + 1)]

        def at(i: int, j: int) -> int:
            j -= low[i]
            return 0 if j < 0 else best[i][j] if j < len(best[i]) else best[i][-1]

        for i in range(1, m + 1):
            row: list[int] = []
            best.append(row)
            p = x[i - 1]
            for j in range(low[i], min(n, i * n // m + half) + 1):
                top = max(at(i - 1, j), row[-1] if row else 0)
                if j and p[0] == y[j - 1][0]:
                    top = max(top, at(i - 1, j - 1) + self(p, y[j - 1])[0])
                row.append(top)
        pairs, i, j = [], m, n
        while i and j:
            if x[i - 1][0] == y[j - 1][0] and at(i, j) == at(i - 1, j - 1) + self(x[i - 1], y[j - 1])[0]:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif at(i, j) == at(i - 1, j):
                i -= 1
            else:
                j -= 1
        return at(m, n), pairs[::-1]


def match(a: tuple, b: tuple) -> tuple[int, list[tuple[int, int]]]:
    return Matching()(a, b)


def merge(a: tuple, b: tuple, matching: Matching | None = None) -> tuple:
    """The template of two trees of one label: matched children are merged, the others stand in order."""
    if a == b:
        return a
    matching = matching or Matching()
    kids, i, j = [], 0, 0
    for p, q in [*matching(a, b)[1], (len(a[1]), len(b[1]))]:
        kids += [*a[1][i:p], *b[1][j:q]]
        if p < len(a[1]):
            kids.append(merge(a[1][p], b[1][q], matching))
        i, j = p + 1, q + 1
    return (a[0], tuple(kids))


def cut(s: tuple, most: int = NODES) -> tuple:
    """The first ``most`` nodes of a tree."""
    left = most

    def copy(s: tuple) -> tuple:
        nonlocal left
        left -= 1
        kids = []
        for k in s[1]:
            if left <= 0:
                break
            kids.append(copy(k))
        return (s[0], tuple(kids))

    return copy(s)


def dumps(s: tuple) -> str:
    out: list[str] = []

    def put(s: tuple) -> None:
        out.append(s[0])
        for k, kid in enumerate(s[1]):
            out.append("," if k else "(")
            put(kid)
        if s[1]:
            out.append(")")

    put(s)
    return "".join(out)


def loads(text: str) -> tuple:
    stack: list[list] = [["", []]]
    for m in re.finditer(r"[^(),]+|[(),]", text):
        x = m[0]
        if x == "(":
            stack.append(stack[-1][1][-1])
        elif x == ")":
            stack.pop()
        elif x != ",":
            stack[-1][1].append([x, []])
    freeze = lambda t: (t[0], tuple(map(freeze, t[1])))
    return freeze(stack[0][1][0])


def _paths(kids: tuple, path: str) -> list[str]:
    """Place names of a template node's children: label and turn among equal labels."""
    seen: dict[str, int] = {}
    out = []
    for k in kids:
        seen[k[0]] = seen.get(k[0], -1) + 1
        out.append(f"{path}/{k[0]}:{seen[k[0]]}")
    return out


class Aligned:
    """A page's blocks beside its host's template: (place, text, never content, number of the outermost main or article, mostly links)."""

    def __init__(self, page: str, template: tuple):
        self.blocks: list[tuple[str, str, bool, int, bool]] = []
        self.roots = [""]  # the elements that the numbers stand for
        self.containers: dict[str, bool] = {}  # place of a container with blocks: does it come several times in a row
        self._text: list[tuple[str, bool]] = []
        self._match = Matching()
        root = parse(page)
        skeleton(root)
        self._walk(root, template, "html", False, 0)

    def _flush(self, path: str, bad: bool, root: int) -> None:
        text = self._text
        words = " ".join(entities.unescape("".join(t for t, _ in text)).split()) if text else ""
        if words:
            linked = sum(len(t) for t, in_link in text if in_link)
            links = linked > LINKS * sum(len(t) for t, _ in text)
            self.blocks.append((path, words, bad or (not root and links), root, links))
        text.clear()

    def _walk(self, node: Node, where: tuple | None, path: str, bad: bool, root: int) -> int:
        if not root and node.tag in ("article", "main"):
            self.roots.append(node.tag)
            root = len(self.roots) - 1
        bad = bad or (not root if node.tag == "header" else node.bad)
        pairs = dict(self._match(node.shape, where)[1]) if where and where[1] and node.shape[1] else {}
        paths = _paths(where[1], path) if pairs else []
        k, before, run = -1, None, 0
        for child in node.children:
            if not isinstance(child, Node):
                self._text.append(child)
                continue
            self._flush(path, bad, root)
            if child.label != before:
                k, before, run = k + 1, child.label, 0
            run += 1
            q = pairs.get(k)
            own = paths[q] if q is not None else ""
            if own and child.shape[1] and child.tag not in _OWN:
                self.containers[own] = self.containers.get(own, False) or run > 1
            inner = self._walk(child, where[1][q] if q is not None else None, own, bad, root)
            self._flush(own, bad or (child.bad and not (root and child.tag == "header")), inner)
        if node.tag == "html":
            self._flush(path, bad, root)
        return root

    def slots(self) -> list[tuple[str, str, int]]:
        """(place, text, main or article) of the blocks that can be content."""
        return [(place, text, root) for place, text, bad, root, _ in self.blocks if not bad]

    def signature(self) -> int:
        """A hash of the longest block, within main or article if there is one: copies of a page agree in it."""
        slots = self.slots()
        return text_hash(max((t for _, t, root in slots if root), key=lambda t: (len(t), t), default="") or max((t for _, t, _ in slots), key=lambda t: (len(t), t), default=""))


def text_hash(text: str, place: str = "") -> int:
    return int.from_bytes(hashlib.blake2b(f"{place}\0{text}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def blocks(page: str, template: tuple) -> list[tuple[str, str, bool]]:
    """(place in the template, text, never content) of a page's blocks in order; nodes outside the template have no place."""
    return [x[:3] for x in Aligned(page, template).blocks]


def _ancestors(place: str) -> list[str]:
    parts = place.split("/")
    return ["/".join(parts[:k]) for k in range(1, len(parts) + 1)]


def _tag(place: str) -> str:
    return re.split(r"[.:]", place.rsplit("/", 1)[-1], maxsplit=1)[0]


def _within_region(constant: dict[str, int], slots: list[str], region: str) -> dict[str, int]:
    """Marks of constant places (with their numbers of distinct texts) that are the region's own: cells of tables that vary, and headings."""
    inside = {place: distinct for place, distinct in constant.items() if place.startswith(f"{region}/")}
    table = lambda place: next((x for x in reversed(_ancestors(place)) if _tag(x) in ("table", "dl")), "")
    live = {table(place) for place in slots} | {table(place) for place, distinct in inside.items() if distinct > 1}
    marks = {}
    for place in inside:
        if _tag(place) in ("h2", "h3", "h4", "h5", "h6"):
            marks[place] = HEADING
        elif (own := table(place)).startswith(f"{region}/") and own in live:
            marks[place] = CELL
    return marks


def choose(stats: list[tuple[str, int, int, int, int, int, int, int]], pages: int) -> dict[str, int]:
    """Marks of places from (place, texts, distinct, characters, texts and distinct over all hosts, pages where it repeats in a row, where not)."""
    marks: dict[str, int] = {}
    mass: Counter[str] = Counter()  # characters and blocks of the slots at and below a place
    count: Counter[str] = Counter()
    again = {place for place, *_, several, single in stats if several and several >= RECORDS * (several + single)}
    slots, constant = [], {}
    for place, n, distinct, chars, n_all, distinct_all, _, _ in stats:
        if not n:
            continue
        everywhere = (n_all - distinct_all) / n_all
        if n - distinct + PRIOR * everywhere >= REPEATS * (n + PRIOR):
            marks[place] = CONSTANT
            constant[place] = distinct
            continue
        slots.append(place)
        for x in _ancestors(place):
            mass[x] += chars
            count[x] += n
    below: dict[str, set[str]] = defaultdict(set)
    holds = set()  # containers of slots
    for place in slots:
        parts = _ancestors(place)
        holds.update(parts[:-1])
        for up, down in zip(parts, parts[1:], strict=False):
            below[up].add(down)
    for x in sorted(holds, key=lambda x: -x.count("/")):  # what holds hardly anything but records is a record list itself
        if sum(mass[y] for y in below[x] if y in again) >= LIST * mass[x]:
            again.add(x)
    region = "html"
    while below[region]:
        inner = sorted((x for x in below[region] if x in holds), key=lambda x: (-mass[x], x))
        records = [x for x in inner if x in again]
        rest = mass[region] - sum(mass[x] for x in records)
        others = [x for x in inner if x not in again]
        if records and rest < 0.25 * mass[region]:
            region = records[0]
        elif others and mass[others[0]] >= 0.5 * rest:
            region = others[0]
        else:
            break
    path = set(_ancestors(region))
    usual = mass[region] / max(1, count[region])
    total = mass["html"]
    heads = {x for place in slots if re.search(r"/h[12][.:]", place) for x in _ancestors(place)}
    for place in slots:
        ups = _ancestors(place)
        named = next((x for x in ups if x not in path and _AD.search(x.rsplit("/", 1)[-1].rsplit(":", 1)[0].partition(".")[2])), None)
        off = next((x for x in ups[:-1] if x not in path), None)  # the container beside the region
        if named and mass[named] <= MINOR * total:
            marks[place] = ADVERT
        elif any(x in again and x not in path for x in ups):
            marks[place] = RECORD
        elif region in ups:
            marks[place] = REGION
        elif off and off not in heads and count[off] >= SIDE_BLOCKS * pages and mass[off] < SIDE_LENGTH * usual * count[off]:
            marks[place] = SIDE
    return marks | _within_region(constant, slots, region)


def marked(template: tuple, marks: dict[str, int]) -> str:
    """The template as text, each label followed by its place's mark if that isn't a plain slot."""

    def copy(node: tuple, path: str) -> tuple:
        kids = tuple(copy(k, p) for k, p in zip(node[1], _paths(node[1], path), strict=True))
        mark = marks.get(path, SLOT)
        return (f"{node[0]}={mark}" if mark else node[0], kids)

    return dumps(copy(template, "html"))


def unmarked(text: str) -> tuple[tuple, dict[str, int]]:
    """The inverse of ``marked``."""
    marks: dict[str, int] = {}

    def copy(node: tuple) -> tuple:
        return (node[0].partition("=")[0], tuple(map(copy, node[1])))

    raw = loads(text)
    template = copy(raw)

    def read(node: tuple, plain: tuple, path: str) -> None:
        mark = node[0].partition("=")[2]
        if mark:
            marks[path] = int(mark)
        for a, b, p in zip(node[1], plain[1], _paths(plain[1], path), strict=True):
            read(a, b, p)

    read(raw, template, "html")
    return template, marks


def content(page: str, template: tuple, marks: dict[str, int], often: set[int], repeated: set[int]) -> list[str]:
    """The texts of a page's content in its main elements, else in its only article, else in the whole page.

    ``often`` and ``repeated`` hold the hashes, by place, of texts that are template anywhere, and at constant places.
    """
    aligned = Aligned(page, template)
    kept: list[tuple[int, str, int]] = []
    below: tuple[bool, str] = (False, "")  # whether the block below stays, and its place
    for place, text, bad, root, links in reversed(aligned.blocks):
        mark = marks.get(place, SLOT)
        key = text_hash(text, place) if place and (often or repeated) else None
        again = key is not None and (key in often or (mark in (CONSTANT, CELL, HEADING) and key in repeated))
        if bad or mark == ADVERT:
            stays = False
        elif root or not again:
            stays = not (again and links)
        else:
            stays = mark == CELL or (mark == HEADING and below[0] and below[1].startswith(place.rsplit("/", 1)[0] + "/"))
        if stays:
            kept.append((REGION if mark in (CELL, HEADING) else mark, text, root))
        below = (stays and mark not in (RECORD, SIDE), place)
    slots = kept[::-1]
    used = {root for _, _, root in slots if root}
    inside = {root for root in used if aligned.roots[root] == "main"} or (used if len(used) == 1 else set())
    if inside:
        slots = [x for x in slots if x[2] in inside]
        last = max((k for k, x in enumerate(slots) if x[0] == REGION), default=len(slots))
        return [text for k, (mark, text, _) in enumerate(slots) if mark != RECORD or k < last]
    if any(mark == REGION for mark, _, _ in slots):
        slots = [x for x in slots if x[0] not in (RECORD, SIDE)]
    return [text for _, text, _ in slots]


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [dumps(cut(skeleton(parse(x.as_py() or "")))) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["host", "skeleton"])


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["n", "skeleton"], ascending=[False, True])
    out, matching = None, Matching()
    for x in rows["skeleton"]:
        out = loads(x) if out is None else merge(out, loads(x))
        if matching.size(out) >= NODES:
            break
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "skeleton": [dumps(out)], "n": [int(rows["n"].sum())]})


def _templates(pages: DataFrame) -> DataFrame:
    """(host, template): distinct skeletons of a host, MERGED at a time, until one is left."""
    counted = pages.select("host", "html").mapInArrow(_skeletons, "host string, skeleton string").groupBy("host", "skeleton").agg(F.count("*").alias("n"))
    counted = stored(counted, "skeletons")
    while (most := counted.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        part = F.pmod(F.xxhash64("skeleton", F.lit(most)), F.col("parts"))
        parts = counted.groupBy("host").agg(F.ceil(F.count("*") / MERGED).alias("parts"))
        groups = counted.join(parts, "host").groupBy("host", part.alias("part"))
        counted = stored(groups.applyInPandas(_merged, "host string, skeleton string, n long"), "skeletons")
    return counted.select("host", F.col("skeleton").alias("template"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the kinds "text" (a page's text at a place), "page", "several" and "single" (containers in a row, counted for this batch)."""
    from pyspark import TaskContext

    known: dict[str, tuple] = {}
    turn = TaskContext.get().partitionId() << 32
    for batch in batches:
        rows: list[tuple] = []
        runs: Counter[tuple] = Counter()
        turn += 1
        for host, page, template in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
            if len(known) > 256:
                known.clear()
            aligned = Aligned(page or "", known.get(template) or known.setdefault(template, loads(template)))
            copy_of = aligned.signature()
            rows.append((host, "", "page", 0, copy_of, 1, 0))
            rows += [(host, p, "text", text_hash(t, p), copy_of, 1, len(t)) for p, t in dict.fromkeys(x[:2] for x in aligned.slots()) if p]
            runs.update((host, p, "several" if several else "single") for p, several in aligned.containers.items())
        rows += [(*key, 0, turn, n, 0) for key, n in runs.items()]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "place", "kind", "hash", "copy_of", "n", "chars"])


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for template, pages, stats in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            made.append(marked(loads(template), choose(sorted(tuple(x.values()) for x in stats.as_py() or []), pages or 0)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string()), batch.column(4), batch.column(5)], ["host", "wrapper", "often", "repeated"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple] = {}
    for batch in batches:
        texts = []
        for page, host, wrapper, often, repeated in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), batch.column(5), batch.column(6), strict=True):
            if len(known) > 256:
                known.clear()
            if host not in known:
                known[host] = (*unmarked(wrapper), set(often.as_py() or ()), set(repeated.as_py() or ()))
            texts.append("\n\n".join(content(page or "", *known[host])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _beside(pages: DataFrame, wrappers: DataFrame, size: str) -> DataFrame:
    total = wrappers.select(F.sum(F.expr(size))).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if total <= BROADCAST_BYTES else wrappers, "host")


def _repeated(texts: DataFrame, slots: DataFrame, everywhere: DataFrame) -> DataFrame:
    """(host, hash) of the texts that are template at constant places: those that come again there in a share of the host's
    pages, or, where the host has few, of all hosts'."""
    places = slots.select("host", "place", F.col("n").alias("here"), "distinct").join(everywhere, "place")
    share = (F.col("n_all") - F.col("distinct_all")) / F.col("n_all")
    places = places.where((F.col("here") > 0) & (F.col("here") - F.col("distinct") + PRIOR * share >= REPEATS * (F.col("here") + PRIOR)))
    mine = texts.where("kind = 'text'").select("host", "place", "hash", "n")
    rows = mine.join(places, ["host", "place"])
    own = (F.col("n") > 1) & (F.col("n") >= SHARE * F.col("here"))
    few = rows.where(F.col("here") < PRIOR).where(~own)
    whole = mine.groupBy("place", "hash").agg(F.sum("n").alias("total")).where("total > 1")
    few = few.join(whole, ["place", "hash"]).where(F.col("total") >= SHARE * F.col("n_all"))
    return rows.where(own).select("host", "hash").unionByName(few.select("host", "hash"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``, which has ``page_id``, ``url`` and ``html``."""
    prepare(pages.sparkSession)
    pages = pages.select("page_id", "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    templates = _templates(pages)
    found = _beside(pages.where("html is not null"), templates, "length(template) + 60").select("host", "html", "template")
    found = found.mapInArrow(_texts, "host string, place string, kind string, hash long, copy_of long, n long, chars long")
    once = found.groupBy("host", "place", "kind", "hash", "copy_of").agg(F.max("n").alias("n"), F.max("chars").alias("chars"))
    texts = stored(once.groupBy("host", "place", "kind", "hash").agg(F.sum("n").alias("n"), F.max("chars").alias("chars")), "texts")

    number = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0)).alias
    slots = texts.where("kind <> 'page'").groupBy("host", "place").agg(
        number("text", F.col("n"))("n"), number("text", F.lit(1))("distinct"), number("text", F.col("n") * F.col("chars"))("chars"), number("several", F.col("n"))("several"), number("single", F.col("n"))("single")
    )
    everywhere = texts.where("kind = 'text'").groupBy("place", "hash").agg(F.sum("n").alias("n")).groupBy("place").agg(F.sum("n").alias("n_all"), F.count("*").alias("distinct_all"))
    whole = F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce("distinct_all", F.lit(0)).alias("distinct_all")
    stats = slots.join(everywhere, "place", "left").groupBy("host").agg(F.collect_list(F.struct("place", "n", "distinct", "chars", *whole, "several", "single")).alias("stats"))
    seen = texts.where("kind = 'page'").select("host", F.col("n").alias("pages"))
    often = texts.where("kind = 'text' and n > 2").join(seen, "host").where(F.col("n") - 1 >= OFTEN * (F.col("pages") + PRIOR))
    often = often.groupBy("host").agg(F.collect_set("hash").alias("often"))
    repeated = _repeated(texts, slots, everywhere).groupBy("host").agg(F.collect_set("hash").alias("repeated"))
    wrappers = templates.join(seen, "host", "left").join(stats, "host", "left").join(often, "host", "left").join(repeated, "host", "left")
    wrappers = wrappers.select("host", "template", "pages", "stats", "often", "repeated")
    wrappers = stored(wrappers.mapInArrow(_wrappers, "host string, wrapper string, often array<long>, repeated array<long>"), "wrappers")
    rows = _beside(pages, wrappers, "length(wrapper) + 8 * coalesce(size(often), 0) + 8 * coalesce(size(repeated), 0) + 60")
    rows = rows.select("page_id", "url", "html", "host", "wrapper", "often", "repeated")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
