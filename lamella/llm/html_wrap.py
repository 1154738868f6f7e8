"""Main text of web pages by union-free regular-expression inference over pages of the same host.

A page becomes a tree of block elements and text slots. The wrapper of a host starts as one of its pages and takes
in the others one after another. Where the sequences of two pages match, they are merged place by place: texts that
differ make a slot, texts that are the same stay as template. Where they do not, runs of a repeated piece become a
repeated group first; what still has no partner becomes optional. A sequence that stays longer than MOST items
becomes a repeated group of optional items. There is no choice between alternatives anywhere: the result is a
union-free regular expression, and every page of the host is a word of it.

The expression is judged once as a whole. Its region is the article: the elements that say so, or where a host has
none the innermost element that holds nearly all of the varying text that is no link. In the region a slot is main
text unless it is template (the same on every page, outside of repeated groups) or stands in an element that is a
menu, form, notice, advert or the like by its kind or marks; marks are overruled where the element holds most of the
varying text. Paragraphs, headings, lists and tables of an article that says so are never template. Pages are matched with the expression of their host, and the text of its main slots is their text. A
page that has nothing in the region is its own host.

Wrappers are learned from all different pages of a host, and every page is extracted whole. The wrappers are broadcast
if they are small, by their measured size, and joined by host otherwise.

Null or empty html gives empty text. A null or odd url makes the host empty. Every row gives a row, repeated rows
and null ids too; extra columns are ignored. Elements nested deeper than DEPTH count as part of the one at that depth.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import slices

#: Bytes of wrappers that are broadcast at most.
BROADCAST_BYTES = 8 << 20
#: Shares that a host's pages are dealt in.
SALTS = 64
#: Items of a sequence, of a repeated group, and levels of a tree.
MOST, PERIOD, DEPTH = 64, 8, 100
#: Pages on which a text has to be the same to be template, and the share of the text that makes a region.
SAME, NEARLY = 4, 0.8

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|([^<]+|<)",
    re.S | re.I,
)
#: Kinds of elements (fixed values).
BLOCKS = frozenset(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption header footer nav aside form fieldset address hr title details summary menu dialog legend center".split()
)
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
OUT = frozenset("head title nav header footer aside form menu dialog button fieldset".split())
LISTED = frozenset("ul ol li dl dt dd table tbody tr td th".split())
WHOLE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|banner|nav\w*|menu|side-?bar|footer|header|masthead|cookies?|consent|notice|popup|modal|promo\w*|share|sharing"
    r"|social|comments?|disqus|replies|related|recommended|newsletter|subscribe|breadcrumbs?|pagination|toolbar|widget|skip|login|signup|search)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search".split())
#: An opened element that ends an open element of these kinds (fixed values).
ENDS = {t: frozenset(["p"]) for t in BLOCKS} | {
    "li": frozenset(["p", "li"]),
    "dt": frozenset(["p", "dt", "dd"]),
    "dd": frozenset(["p", "dt", "dd"]),
    "tr": frozenset(["p", "tr", "td", "th"]),
    "td": frozenset(["p", "td", "th"]),
    "th": frozenset(["p", "td", "th"]),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "thead", "tbody", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}


def label_of(tag: str, attributes: str) -> str:
    """The element's kind, then ! if it is one that is never main text, ~ if its marks say so, * if it is an article."""
    if not attributes:
        return tag + ("!" if tag in OUT else "") + ("*" if tag in ("article", "main") else "")
    marks = {a.lower(): b or c or d for a, b, c, d in reversed(ATTRIBUTE.findall(attributes))}
    role = marks.get("role", "").lower()
    out = "!" if tag in OUT or role in ROLES else "~" if any(BOILERPLATE.search(v) for v in marks.values()) else ""
    return tag + out + ("*" if tag in ("article", "main") or role == "main" else "")


def tree(page: str) -> list:
    """The page as nested lists: an element is [label, children], a text is (text, characters of links in it)."""
    root: list = []
    stack: list[tuple[str, list]] = []  # block elements: tag, children
    parts: list[str] = []
    linked, in_link = 0, False

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                (stack[-1][1] if stack else root).append((text, min(linked, len(text))))
            linked = 0

    for m in TOKEN.finditer(page):
        text = m[8]
        if text is not None:
            parts.append(text)
            linked += len(text) if in_link else 0
            continue
        name = m[3] or m[6]
        if not name:
            continue
        tag, closes = name.lower(), m[2] or m[5]
        if tag not in BLOCKS:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = not closes
            continue
        flush()
        if closes:
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == tag:
                    del stack[place:]
                    break
            continue
        ends, scope = ENDS[tag], SCOPES.get(tag, ())
        for place in range(len(stack) - 1, -1, -1):
            if stack[place][0] in scope:
                break
            if stack[place][0] in ends:
                del stack[place:]
                if not scope:
                    break
            elif not scope:
                break
        if tag in VOID:
            continue
        children = stack[-1][1] if stack else root
        if len(stack) < DEPTH:
            own: list = []
            children.append([label_of(tag, m[4] or m[7] or ""), own])
            children = own
        stack.append((tag, children))
    flush()
    return root


# An expression is a list of items: ["#", q, times, characters, link characters, text or None],
# ["<", q, times, label, items] or ["(", q, times, items]. q is "", "?", "+" or "*".


def brief(text: str) -> str:
    """A text as the wrapper keeps it to tell template: long ones by their SHA-256."""
    return text if len(text) <= 100 else "\0" + hashlib.sha256(text.encode()).hexdigest()


def concrete(nodes: list) -> list:
    """The expression of one page; long sequences folded at once."""
    out = [["#", "", 1, len(x[0]), x[1], brief(x[0])] if isinstance(x, tuple) else ["<", "", 1, x[0], concrete(x[1])] for x in nodes]
    return bounded(fold(out)) if len(out) > MOST else out


def key(item: list):
    return "#" if item[0] == "#" else item[3] if item[0] == "<" else tuple(map(key, item[3]))


def _either(p: str, q: str) -> str:
    many, least = p in ("+", "*") or q in ("+", "*"), not (p in ("?", "*") or q in ("?", "*"))
    return ("+" if least else "*") if many else ("" if least else "?")


def optional(item: list) -> list:
    return [item[0], _either(item[1], "?"), *item[2:]]


def merge(a: list, b: list) -> list:
    """One item for two with the same key."""
    q, times = _either(a[1], b[1]), a[2] + b[2]
    if a[0] == "#":
        return ["#", q, times, a[3] + b[3], a[4] + b[4], a[5] if a[5] == b[5] else None]
    if a[0] == "<":
        return ["<", q, times, a[3], align(a[4], b[4])]
    return ["(", q, times, [merge(x, y) for x, y in zip(a[3], b[3], strict=True)]]


def repeated(run: list[list]) -> list:
    """A run of items with the same key as one repeated item."""
    out = run[0]
    for item in run[1:]:
        out = merge(out, item)
    least = any(item[1] in ("", "+") for item in run)
    return [out[0], "+" if least else "*", *out[2:]]


def fold(items: list[list], longest: int = PERIOD) -> list[list]:
    """Runs of a repeated piece become a repeated item or group, shortest pieces first."""
    items = [run[0] if len(run) == 1 else repeated(run) for run in (list(g) for _, g in groupby(items, key))]
    for n in range(2, longest + 1):
        keys, out, i = [key(x) for x in items], [], 0
        while i < len(items):
            if keys[i : i + n] == keys[i + n : i + 2 * n] and i + 2 * n <= len(items):
                pieces = []
                while keys[i : i + n] == [key(x) for x in (pieces[0][3] if pieces else items[i : i + n])] and i + n <= len(items):
                    pieces.append(["(", "", 1, items[i : i + n]])
                    i += n
                out.append(repeated(pieces))
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def grouped(items: list[list], groups: list[tuple]) -> list[list]:
    """Items with each occurrence of one of the groups' sequences as a group."""
    for g in groups:
        keys, out, i = [key(x) for x in items], [], 0
        while i < len(items):
            if tuple(keys[i : i + len(g)]) == g:
                out.append(["(", "", 1, items[i : i + len(g)]])
                i += len(g)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def is_bag(items: list[list]) -> bool:
    return len(items) == 1 and items[0][0] == "(" and items[0][1] == "*" and all(x[1] in ("?", "*") for x in items[0][3])


def bag(items: list[list]) -> list[list]:
    """The items as a repeated group of optional items, one for each key."""
    found: dict = {}

    def add(x):
        if x[0] == "(":
            for y in x[3]:
                add(y)
        else:
            k = key(x)
            found[k] = merge(found[k], x) if k in found else x

    for x in items:
        add(x)
    return [["(", "*", 1, [optional(x) for x in found.values()]]]


def bounded(items: list[list]) -> list[list]:
    return bag(items) if len(items) > MOST else items


def align(p: list[list], q: list[list]) -> list[list]:
    """The expression that covers both: place by place if the sequences match, else by repeated and optional items."""
    if [key(x) for x in p] == [key(x) for x in q]:
        return [merge(a, b) for a, b in zip(p, q, strict=True)]
    if is_bag(p) or is_bag(q):
        return bag(p + q)
    p, q = fold(p), fold(q)
    p = fold(grouped(p, [key(x) for x in q if x[0] == "("]), 1)
    q = fold(grouped(q, [key(x) for x in p if x[0] == "("]), 1)
    kp, kq = [key(x) for x in p], [key(x) for x in q]
    if len(p) > MOST or len(q) > MOST:
        return bag(p + q)
    # Longest common subsequence, from the ends.
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) - 1, -1, -1):
        for j in range(len(q) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if kp[i] == kq[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(p) or j < len(q):
        if i < len(p) and j < len(q) and kp[i] == kq[j]:
            out.append(merge(p[i], q[j]))
            i, j = i + 1, j + 1
        elif j == len(q) or i < len(p) and best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(p[i]))
            i += 1
        else:
            out.append(optional(q[j]))
            j += 1
    return bounded(out)


def infer(samples: list[list]) -> list:
    """The union-free expression of pages that are given as expressions of their own."""
    out: list = []
    for k, sample in enumerate(samples):
        out = align(out, sample) if k else sample
    return out


def expression(items: list[list]) -> str:
    """The expression as text, with # for each text."""
    shown = []
    for x in items:
        inner = "#" if x[0] == "#" else f"<{x[3]}>{expression(x[4])}</{x[3]}>" if x[0] == "<" else expression(x[3])
        shown.append(f"({inner}){x[1]}" if x[1] or x[0] == "(" else inner)
    return "".join(shown)


class Wrapper:
    """An expression with its region and the verdict of each slot, by the identity of its items."""

    def __init__(self, items: list, samples: int):
        self.items, self.samples = items, samples
        self.region: set[int] = set()  # elements of the region, and those in it that are not left out
        self.main: dict[int, str | None] = {}  # main slots, and their text if it is template
        self._mass: dict[int, float] = {}
        total = sum(self._weigh(x, True) for x in items)
        self._most = total / 2
        marked = self._articles(items)
        for k, x in enumerate(marked):  # a narrower article with most of the text, if there is one
            while inner := [y for y in self._articles(x[4]) if self._mass[id(y)] >= NEARLY * self._mass[id(x)] > 0]:
                x = inner[0]
            marked[k] = x
        said = any(self._mass[id(x)] > 0 for x in marked) or bool(marked) and total == 0
        if said:
            for x in marked:
                self._take([x], said, True)
        else:
            inside = items
            while True:
                mass = sum(self._mass[id(x)] for x in inside)
                next_ = [x for x in inside if x[0] == "<" and x[1] in ("", "?") and x[3].rstrip("~*") not in WHOLE and not self._out(x) and self._mass[id(x)] >= NEARLY * mass > 0]
                if not next_:
                    break
                inside = next_[0][4]
                self.region.add(id(next_[0]))
            if inside is items:
                self.region.add(id(items))
            else:
                self.region = {id(next(x for x in self._every(items) if x[0] == "<" and x[4] is inside))}
                for x in self._every(items):
                    if x[0] == "<" and x[3] == "h1" and not self._below_out(items, x):
                        self._take([x], False, x[1] in ("", "?"))
            self._take(inside, said, True)

    def _every(self, items: list):
        for x in items:
            yield x
            if x[0] != "#":
                yield from self._every(x[-1])

    def _below_out(self, items: list, wanted: list) -> bool:
        return any(x[0] == "<" and self._out(x) and any(y is wanted for y in self._every(x[4])) for x in self._every(items))

    def _weigh(self, x: list, single: bool) -> float:
        """Characters of varying text that is no link, less those that are links."""
        single = single and x[1] == ""
        if x[0] == "#":
            mass = 0.0 if self._template(x, single) else max(0.0, x[3] - 2 * x[4])
        else:
            mass = sum(self._weigh(y, single) for y in x[-1])
            if x[0] == "<" and "!" in x[3]:
                mass = 0.0
        self._mass[id(x)] = mass
        return mass

    def _template(self, x: list, single: bool) -> bool:
        return single and x[5] is not None and self.samples >= SAME and x[2] >= self.samples

    def _out(self, x: list) -> bool:
        return "!" in x[3] or "~" in x[3] and (self._mass[id(x)] < self._most or not self._most)

    def _articles(self, items: list) -> list:
        out = []
        for x in items:
            if x[0] == "<" and "*" in x[3] and not self._out(x):
                out.append(x)
            elif x[0] != "#" and not (x[0] == "<" and self._out(x)):
                out += self._articles(x[-1])
        return out

    def _take(self, items: list, said: bool, single: bool, listed: bool = False) -> None:
        for x in items:
            alone = single and x[1] == ""
            if x[0] == "#":
                if said or not (listed and 5 * x[4] > 3 * x[3]):
                    self.main[id(x)] = x[5] if self._template(x, alone) else None
            elif x[0] == "(":
                self._take(x[3], said, alone, listed)
            elif not self._out(x):
                tag = x[3].rstrip("~*")
                self.region.add(id(x))
                self._take(x[4], said, alone and not (said and tag in WHOLE), listed or tag in LISTED)

    def text(self, nodes: list) -> list[str]:
        """The texts of the main slots that a page's nodes match, in order."""
        out: list[str] = []

        def whole(nodes):
            """What the expression has no place for, in the region."""
            for x in nodes:
                if isinstance(x, tuple):
                    out.append(x[0])
                elif "!" not in x[0] and "~" not in x[0]:
                    whole(x[1])

        def walk(nodes, items, inside):
            for x, item in matched(nodes, items):
                if item is None:
                    if inside:
                        whole([x])
                elif isinstance(x, tuple):
                    if id(item) in self.main and self.main[id(item)] != brief(x[0]):
                        out.append(x[0])
                else:
                    walk(x[1], item[4], id(item) in self.region)

        walk(nodes, self.items, id(self.items) in self.region)
        return out


def _flat(items: list, out: list, again: dict[int, int]) -> list:
    """(key, item) of the places of a sequence; again: for the end of a repeated group, where it starts."""
    for x in items:
        if x[0] == "(":
            start = len(out)
            _flat(x[3], out, again)
            if x[1] in ("+", "*"):
                for place in range(start, len(out)):
                    again.setdefault(place, start)
                    again[place] = min(again[place], start)
        else:
            out.append((key(x), x))
    return out


def matched(nodes: list, items: list):
    """Each node with the item of the expression that it matches, or None.

    A node takes the next item of its key: the same one if that is repeated, one of the group around it, or one
    further on. It passes no item that has to come and that the rest of the nodes still have; it then has no place.
    """
    again: dict[int, int] = {}
    flat = _flat(items, [], again)
    places: dict = {}
    for k, (name, _) in enumerate(flat):
        places.setdefault(name, []).append(k)
    names = ["#" if isinstance(x, tuple) else x[0] for x in nodes]
    left: dict = {}
    for name in names:
        left[name] = left.get(name, 0) + 1
    at = -1
    for x, name in zip(nodes, names, strict=True):
        left[name] -= 1
        own = places.get(name, ())
        found = None
        if at >= 0 and flat[at][0] == name and flat[at][1][1] in ("+", "*"):
            found = at
        else:
            ahead = next((k for k in own if k > at), None)
            if at in again:
                start, end = again[at], max(k for k in again if again[k] == again[at])
                if ahead is None or ahead > end:
                    back = next((k for k in own if start <= k <= at), None)
                    ahead = back if back is not None else ahead
            if ahead is not None and ahead > at + 1 and any(q[1] in ("", "+") and left.get(n, 0) and n != name and k not in again for k, (n, q) in enumerate(flat[at + 1 : ahead], at + 1)):
                ahead = None
            found = ahead
        if found is None:
            yield x, None
        else:
            at = found
            yield x, flat[found][1]


def extract(page: str, wrapper: Wrapper | None) -> str:
    """The main text, joined by an empty line: that of the wrapper's main slots, or of the page as a host of its own."""
    nodes = tree(page)
    found = wrapper.text(nodes) if wrapper else []
    if not found and nodes:
        found = Wrapper(concrete(nodes), 1).text(nodes)
    return "\n\n".join(found)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, samples, wrapper) learned from all different pages of each host.

    Pages are dealt by host and salt (of the page's own checksum) and sorted by checksum: copies meet and count once, and a
    task holds one expression, whatever a host's size. The expressions of a host's salts are merged in their order. So the
    result depends on the pages alone, not on their partitioning.
    """

    def pages_of(batches):
        for batch in slices(batches, "html"):
            rows = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if page:
                    data = page.encode()
                    place = zlib.crc32(data) << 31 | zlib.adler32(data) >> 1
                    rows.append((host or "", zlib.crc32(b"%d" % place) % SALTS, place, json.dumps(concrete(tree(page)), separators=(",", ":"))))
            if rows:
                h, salts, k, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(salts, pa.int32()), pa.array(k, pa.int64()), pa.array(s, pa.string())], names=["host", "salt", "place", "page"])

    def learn(batches):
        """Each run of a host and salt as one expression and the number of its different pages."""
        of, last, items, n = None, None, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([of[0]], pa.string()), pa.array([of[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([json.dumps(items, separators=(",", ":"))], pa.string())], names=["host", "salt", "n", "wrapper"])

        for batch in slices(batches, "page"):
            for host, salt, place, page in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "place", "page")), strict=True):
                if (host, salt) != of:
                    if of:
                        yield row()
                    of, last, items, n = (host, salt), None, [], 0
                if (place, page) != last:  # a copy comes right after its like
                    items, last, n = align(items, json.loads(page)) if n else json.loads(page), (place, page), n + 1
        if of:
            yield row()

    def merged(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["salt"])  # SALTS of them at most
        wrapper = json.dumps(infer([json.loads(r["wrapper"]) for r in rows]), separators=(",", ":"))
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([sum(r["n"] for r in rows)], pa.int64()), pa.array([wrapper], pa.string())], names=["host", "samples", "wrapper"])

    shown = pages.select("host", "html").mapInArrow(pages_of, "host string, salt int, place long, page string")
    dealt = shown.repartition("host", "salt").sortWithinPartitions("host", "salt", "place", "page")
    parts = dealt.mapInArrow(learn, "host string, salt int, n long, wrapper string")
    return parts.groupBy("host").applyInArrow(merged, "host string, samples long, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    from lamella.session import cut

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))
    learned = cut(wrappers(pages))
    size = learned.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    joined = pages.join(F.broadcast(learned) if size <= BROADCAST_BYTES else learned, "host", "left")

    def run(batches):
        known: dict[str, Wrapper] = {}
        for batch in slices(batches, "html"):
            texts = []
            for text, wrapper, samples in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "samples")), strict=True):
                if wrapper is not None and wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = Wrapper(json.loads(wrapper), samples)
                texts.append(extract(text, known[wrapper] if wrapper is not None else None) if text else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "wrapper", "samples").mapInArrow(run, "page_id long, url string, text string, n_chars long")
