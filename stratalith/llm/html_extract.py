"""Main text of web pages by template deduction over the pages of a host.

Learning. A page's tokens are its start and end tags and the words of its short text nodes (a
longer node is one token), each told apart by its path of open elements and its repetition in
the node, carried as a fingerprint. The occurrence vector of a token over the pages of a host is carried as sums of
count(page) * weight(page) under two random weights, which add up across tasks, so a host of
any size needs no task of its own. Tokens of a host with equal vectors and enough support form
an equivalence class.

Validity. The tokens of a class must occur in the same order on every page, round by round: a
second pass over the pages counts, for every token of a class, the pages on which one of its
occurrences does not lie between those of the token before it and the next round; such tokens
are no template. A class is valid if the elements it opens are closed by its own tokens, and
nests in the template if the elements around them are of valid classes too. The class that
stands once a page is the template's root: what lies between its tokens are the slots.

Deduction. A word is of the template if its vector is a multiple of that of its own element, or
if all words of its path stand equally often on every page that has the element (a constant
line stays if its path holds content too, as a ``p`` among an article's). A host whose
main element holds nothing else (copies of a page) has no such words. Main is the innermost
valid element that holds most of the words of the remaining slots. Names are a fallback: slots
inside elements whose tag or whole class name says menu, header, footer, sidebar, notice,
advert, form, script or reader comment are dropped, and an article element, or one with such a
class name, is main before others.

Extraction. Each page is parsed where it lies with the template of its host; all blocks of
the main element are joined in page order, without the text nodes that consist of template
words alone. Pages without the template's main element (and hosts with fewer than
``MIN_PAGES`` pages, on which nothing can be told apart) fall back to the page's own article,
then to its whole body.

Null and empty html give an empty text. A null url is a host of its own. Unclosed elements,
comments and raw-text elements end with the page; a quote that never closes is part of its
value. Depth costs a fixed amount of memory an element. Repeated rows are extracted alike; extra
columns, whatever they are called, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import skew, storage, textkit as tk

#: Least pages of a host with a template, and the share of them in which a class stands.
MIN_PAGES, SUPPORT = 4, 0.6
#: Words of text nodes that are tokens of the template each; a longer node is a token as a whole.
SHORT_NODE = 16
#: Tokens a task holds before it passes them on.
HELD_TOKENS = 100_000
#: Elements and text nodes whose parsing a task remembers.
REMEMBERED = 50_000
#: Most templates that are sent to all tasks; beyond that they are joined to the pages.
MOST_SENT = 20_000
#: Most tokens of templates that are sent to all tasks.
MOST_SENT_TOKENS = 400_000

# Element and attribute names of the markup language and of common page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select option textarea svg menu dialog head title object canvas audio video xmp noembed noframes math input".split())
MAIN = frozenset("article main".split())
DROPPED_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation
    breadcrumb breadcrumbs header footer cookie cookies notice consent alert popup modal comment comments reply replies respond discussion disqus share
    sharing social related newsletter subscribe subscription widget search login signup toolbar pagination pager complementary contentinfo""".split())
#: Words that say nothing of what a part is; beside them, a dropped word names the part.
NEUTRAL_WORDS = frozenset("""area bar bars block body bottom box button buttons center col column container content end group head holder inner item items left line link links
    list main outer panel page part primary right row secondary section shell side site slot space start top unit wrap wrapper""".split())
MAIN_WORDS = frozenset("article content main post entry story".split())
#: Start tags that end an open paragraph, and pairs (start tag, elements it ends).
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header
    hgroup hr main menu nav ol p pre section summary table ul""".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table", "option": "select"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[^>=]++)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def fingerprint(*parts: str) -> int:
    """63 bits of a digest of strings."""
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def _names(word: str) -> bool:
    """Whether a class name or id as a whole names a part that is dropped."""
    words = {w.lower() for w in _WORDS.findall(word)}
    return bool(words & DROPPED_WORDS) and words <= DROPPED_WORDS | NEUTRAL_WORDS


class Element:
    """An element by its path: alike elements at the same place share one."""

    __slots__ = ("children", "depth", "dropped", "label", "main", "name", "parent", "path", "texts")

    def __init__(self, name: str, said: dict[str, str], parent: Element | None):
        classes = sorted(said.get("class", "").split())
        self.name, self.parent, self.children, self.texts = name, parent, {}, {}
        self.label = name + "".join("." + c for c in classes) + ("#" + said["id"] if "id" in said else "")
        self.path = fingerprint(str(parent.path) if parent else "", self.label)
        self.depth = parent.depth + 1 if parent else 0
        inside = parent is not None and parent.main
        marks = [w for w in [*classes, *said.get("id", "").split(), *said.get("role", "").split()] if _names(w)]
        own = name in DROPPED or bool(marks) or name == "header"
        if inside and name not in DROPPED and all({w.lower() for w in _WORDS.findall(m)} & DROPPED_WORDS <= {"header"} for m in marks):
            own = False  # an article's own heading
        if name in ("html", "body", "article", "main"):
            own = False
        self.dropped = own or (parent is not None and parent.dropped)
        self.main = inside or name in MAIN or said.get("role") in MAIN


class Parser:
    """Parses the pages of a task; remembers elements by path and the tokens of their texts."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.top: dict = {}
        self.size = 0

    def element(self, name: str, attributes: str, parent: Element | None) -> Element:
        said: dict[str, str] = {}
        if attributes and ("class" in (low := attributes.lower()) or "id" in low or "role" in low):
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                if (key := key.lower()) in ("class", "id", "role"):
                    said.setdefault(key, a or b or c)
        known = self.top if parent is None else parent.children
        key = (name, *said.items())
        found = known.get(key)
        if found is None:
            found = known[key] = Element(name, said, parent)
            self.size += 1
        return found

    def units(self, element: Element, text: str) -> tuple[int, list[int]]:
        """The words of a text node and its tokens."""
        found = element.texts.get(text)
        if found is None:
            words = text.split()
            own = words if len(words) <= SHORT_NODE else [" ".join(words)]
            before = Counter()  # a repeated word has a role of its own each time
            found = len(words), []
            for w in own:
                found[1].append(fingerprint(str(element.path), w, str(before[w])))
                before[w] += 1
            if len(words) <= SHORT_NODE:
                element.texts[text] = found
                self.size += 1
        return found

    def events(self, page: str) -> Iterator[tuple]:
        """Events in order: ("open", element), ("close", element), ("text", element or None, string), ("break",)."""
        if self.size > REMEMBERED:
            self._forget()
        stack: list[Element] = []
        opened = Counter()
        at, n = 0, len(page)

        def close(k: int):
            while len(stack) > k:
                element = stack.pop()
                opened[element.name] -= 1
                yield "close", element

        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                yield "text", stack[-1] if stack else None, page[at:lt]
            if lt == n:
                break
            m = _TOKEN.match(page, lt)
            if not m:
                yield "text", stack[-1] if stack else None, "<"
                at = lt + 1
                continue
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if opened[name]:
                    k = len(stack) - 1
                    while stack[k].name != name:
                        k -= 1
                    yield from close(k)
                elif name in ("p", "br"):
                    yield ("break",)
                continue
            if name in CLOSES_P and opened["p"]:
                k = len(stack) - 1
                while k >= 0 and stack[k].name != "p" and stack[k].name in INLINE:
                    k -= 1
                if k >= 0 and stack[k].name == "p":
                    yield from close(k)
            if name in CLOSES and any(opened[x] for x in CLOSES[name].split()):
                ends, scope = CLOSES[name].split(), SCOPES[name].split()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name in scope:
                        break
                    if stack[k].name in ends:
                        yield from close(k)
                        if name != "tr":
                            break
            element = self.element(name, m[3], stack[-1] if stack else None)
            stack.append(element)
            opened[name] += 1
            yield "open", element
            if name in VOID or m[3].endswith("/") and name in ("path", "circle", "rect", "line", "use", "g"):
                yield from close(len(stack) - 1)
            elif name in RAW:
                end = _END[name].search(page, at)
                stop = end.start() if end else n
                if stop > at:
                    yield "text", element, page[at:stop]
                at = stop
        yield from close(0)


def blocks(parser: Parser, page: str, main: int | None, template: frozenset[int]) -> list[str]:
    """Text blocks under the element with path ``main``, else under the page's own article, else of the whole body, without text nodes of template tokens."""
    wanted, own, body = [], [], []
    text: list[str] = []
    reached = [False, False]  # template words in the main element, in an article
    inside = []  # whether the open block lies in the main element, in an article
    within = 0  # open main elements

    def flush():
        if text:
            block = " ".join("".join(text).split())
            if block:
                body.append(block)
                if inside[0]:
                    wanted.append(block)
                if inside[1]:
                    own.append(block)
            text.clear()

    for event in parser.events(page):
        kind = event[0]
        if kind == "text":
            element = event[1]
            if element is None:
                here = [False, False]
            elif element.dropped:
                continue
            else:
                here = [within > 0, element.main]
                if template and not event[2].isspace() and template.issuperset(parser.units(element, event[2])[1]):
                    reached = [a or b for a, b in zip(reached, here, strict=True)]
                    if text:
                        text.append(" ")
                    continue
            if not text:
                inside[:] = here
            elif inside != here:
                flush()
                inside[:] = here
            text.append(entities.unescape(event[2]))
        elif kind == "break":
            flush()
        else:
            element = event[1]
            if element.name not in INLINE:
                if element.name in ("br", "td", "th", "img"):
                    if text:
                        text.append(" ")
                else:
                    flush()
            elif element.dropped and kind == "open" and text:
                text.append(" ")
            if element.path == main:
                within += 1 if kind == "open" else -1
    flush()
    if wanted or reached[0]:
        return wanted
    return own if own or reached[1] else body


def _weights(pages: list) -> tuple[list[int], list[int]]:
    """Two random odd weights of 30 bits for every page id."""
    x = np.array([-1 if p is None else p for p in pages], np.int64).view(np.uint64)
    return tuple((tk.mix(tk.absorb(x, np.uint64(salt))) >> np.uint64(34) | np.uint64(1)).astype(np.int64).tolist() for salt in (1, 2))


_CLOSE = 1 << 62  # what tells the token of an end tag from that of its start tag


def occurrences(parser: Parser, page: str) -> tuple[dict[int, list[int]], dict[int, list], dict[int, list]]:
    """Places of every token of a page; of its elements the label, parent, depth and words in and right within; of its text tokens the element."""
    places: dict[int, list[int]] = {}
    elements: dict[int, list] = {}
    texts: dict[int, int] = {}
    open_: list[int] = []  # words in the open elements
    at = 0
    for event in parser.events(page):
        kind = event[0]
        if kind == "open":
            e = event[1]
            at += 1
            places.setdefault(e.path, []).append(at)
            if e.path not in elements:
                elements[e.path] = [e.label, e.parent.path if e.parent else None, e.depth, 0, 0, 0]
            open_.append(0)
        elif kind == "close":
            e = event[1]
            at += 1
            places.setdefault(e.path ^ _CLOSE, []).append(at)
            words = open_.pop()
            elements[e.path][3] += words
            if open_:
                open_[-1] += words
        elif kind == "text" and event[1] is not None:
            e = event[1]
            if not e.dropped and e.name not in RAW and not event[2].isspace():
                words, own = parser.units(e, event[2])
                for t in own:
                    at += 1
                    places.setdefault(t, []).append(at)
                    texts[t] = e.path
                open_[-1] += words
                elements[e.path][4] += words
                elements[e.path][5] += len(own)
    return places, elements, texts


def _host():
    return F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1), F.lit("")))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _host().alias("host"), F.col("html").cast("string").alias("html"))


#: What is summed for a token: pages, occurrences, two vector sums, places, squared counts, and for start tags the words in, words and tokens right within.
_SUMS = ["pages", "n", "a", "b", "place", "squares", "inner", "words", "units"]
_KINDS = {"open": 0, "close": 1, "text": 2}


def deduce(n: int, rows: list[dict]) -> tuple[int | None, list[list[int]]]:
    """The path of the main element of a host with n pages, and the classes of its template's text tokens, each in the order of places.

    rows: token, kind, path (of the element, or that a text stands in), parent, label, depth and _SUMS, of tokens with support.
    """
    elements = {r["path"]: r for r in rows if r["kind"] == 0}
    ends = {r["path"]: r for r in rows if r["kind"] == 1}
    vector = lambda r: (r["pages"], r["n"], r["a"], r["b"])
    # elements of classes that hold their own end tags, within elements of such classes
    valid: dict[int, bool] = {}
    for path, r in sorted(elements.items(), key=lambda x: x[1]["depth"]):
        valid[path] = path in ends and vector(r) == vector(ends[path]) and (r["parent"] is None or valid.get(r["parent"], False))
    texts: dict[int, list[dict]] = {}
    for r in rows:
        if r["kind"] == 2:
            texts.setdefault(r["path"], []).append(r)
    template, slots = [], {p: r["inner"] for p, r in elements.items()}
    for path, own in texts.items():
        if not valid.get(path):
            continue
        e = elements[path]
        steady = [w for w in own if w["pages"] == e["pages"] and w["pages"] * w["squares"] == w["n"] ** 2]  # equally often on every page with the element
        if sum(w["n"] for w in steady) != e["units"]:
            multiple = lambda w: w["pages"] == e["pages"] and w["n"] % e["n"] == 0 and (w["a"], w["b"]) == (w["n"] // e["n"] * e["a"], w["n"] // e["n"] * e["b"])  # noqa: B023, E731
            steady = [w for w in own if multiple(w)]
        template += steady
        covered = e["words"] * sum(w["n"] for w in steady) / e["units"] if e["units"] else 0
        up = path
        while up is not None and up in elements:
            slots[up] -= covered
            up = elements[up]["parent"]
    main = _main({p: r for p, r in elements.items() if valid[p] and r["pages"] == r["n"]}, elements, slots)
    top = [slots[main]] if main is not None else [slots[p] for p, r in elements.items() if r["parent"] not in elements]
    if sum(top) < 0.5:
        return main, []  # copies of one page: nothing tells slots from template
    classes: dict[tuple, list[dict]] = {}
    for w in template:
        classes.setdefault(vector(w), []).append(w)
    return main, [[w["token"] for w in sorted(own, key=lambda w: (w["place"] / w["n"], w["token"]))] for own in classes.values()]


def _main(once: dict[int, dict], elements: dict[int, dict], slots: dict[int, float]) -> int | None:
    """The main element among those that stand once a page."""
    by_depth = lambda p: (elements[p]["depth"], elements[p]["place"] / elements[p]["n"], p)
    name = lambda p: re.split(r"[.#]", elements[p]["label"])[0]
    named = [p for p in once if name(p) in MAIN]
    if named:  # an article before what holds it
        return min(named, key=lambda p: (name(p) != "article", by_depth(p)))
    total = sum(slots[p] for p, r in elements.items() if r["parent"] not in elements)
    marked = [p for p in once if set(_WORDS.findall(elements[p]["label"])) & MAIN_WORDS and slots[p] >= 0.3 * total]
    if marked:
        return min(marked, key=by_depth)
    holding = [p for p in once if total > 0 and slots[p] >= 0.6 * total and name(p) != "html"]
    return max(holding, key=lambda p: (elements[p]["depth"], slots[p], p), default=None)


def templates(pages: DataFrame) -> DataFrame:
    """host, main, classes: the path of the main element and the classes of text tokens of every host with a template, before the order is checked."""
    names = ["host", "token", "kind", "path", "parent", "label", "depth", *_SUMS]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * len(_SUMS)]

    def count(batches):
        parser = Parser()
        held: dict[str, list] = {}  # host -> [pages, {token: [kind, path, parent, label, depth, *sums]}]
        size = 0

        def out():
            rows = [(h, t, *v) for h, (_, own) in held.items() for t, v in own.items()]
            rows += [(h, -1, None, None, None, None, None, n, *[0] * (len(_SUMS) - 1)) for h, (n, _) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            a, b = _weights(batch.column(0).to_pylist())
            for i, host in enumerate(batch.column(1).to_pylist()):
                entry = held.setdefault(host, [0, {}])
                entry[0] += 1
                own = entry[1]
                size -= len(own)
                places, elements, texts = occurrences(parser, batch.column(2)[i].as_py() or "")
                for t, at in places.items():
                    v = own.get(t)
                    if v is None:
                        if t in elements:
                            label, parent, depth = elements[t][:3]
                            v = [0, t, parent, label, depth]
                        else:
                            v = [2, texts[t], None, None, None] if t in texts else [1, t ^ _CLOSE, None, None, None]
                        own[t] = v = v + [0] * len(_SUMS)
                    k = len(at)
                    v[5] += 1
                    v[6] += k
                    v[7] += a[i] * k
                    v[8] += b[i] * k
                    v[9] += sum(at)
                    v[10] += k * k
                for t, e in elements.items():
                    v = own[t]
                    v[11] += e[3]
                    v[12] += e[4]
                    v[13] += e[5]
                size += len(own)
                if size > HELD_TOKENS:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()
        del parser
        tk.release()

    schema = "host string, token long, kind int, path long, parent long, label string, depth int, " + ", ".join(f"{c} long" for c in _SUMS)
    total = pages.select("page_id", "host", "html").mapInArrow(count, schema).groupBy("host", "token").agg(*(F.first(c, ignorenulls=True).alias(c) for c in names[2:7]), *(F.sum(c).alias(c) for c in _SUMS))
    stored = storage.store(total, "tokens")
    sizes = stored.where("token = -1").where(F.col("pages") >= MIN_PAGES).select(F.col("host").alias("_h"), F.col("pages").alias("total"))
    # tokens with support are at most as many as a page has, over SUPPORT
    kept = skew.join(stored.where("token <> -1"), sizes, {"host": "_h"}).where(F.col("pages") >= SUPPORT * F.col("total"))
    grouped = kept.groupBy("host", "total").agg(F.collect_list(F.struct("token", *names[2:])).alias("rows"))

    def build(batches):
        for b in batches:
            found = [deduce(n, rows) for n, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m for m, _ in found], pa.int64()), pa.array([c for _, c in found], pa.list_(pa.list_(pa.int64())))], ["host", "main", "classes"])

    return grouped.mapInArrow(build, "host string, main long, classes array<array<long>>").where("main is not null or size(classes) > 0")


def out_of_order(places: dict[int, list[int]], order: list[int]) -> list[int]:
    """The tokens of a class, given in order, that break the order on a page: rounds of all tokens, one after the other."""
    on = [t for t in order if t in places]
    bad = []
    for before, t in zip(on, on[1:], strict=False):
        first, own = places[before], places[t]
        rounds = len(first) == len(own) and all(a < b for a, b in zip(first, own, strict=True)) and all(b < c for b, c in zip(own, places[on[0]][1:], strict=False))
        if not rounds:
            bad.append(t)
    return bad


class Sent:
    """Templates by host: all of them, if they are few, or those that come with the rows."""

    def __init__(self, learned: DataFrame):
        size = learned.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c))), F.lit(0))).first()
        self.known = None
        if size[0] <= MOST_SENT and size[1] <= MOST_SENT_TOKENS:
            self.known = {r["host"]: (r["main"], r["classes"]) for r in learned.collect()}

    def told(self, rows: DataFrame, learned: DataFrame) -> DataFrame:
        """page_id, url, host, main, classes, html."""
        if self.known is not None:
            return rows.select("page_id", "url", "host", F.lit(None).cast("long").alias("main"), F.lit(None).cast("array<array<long>>").alias("classes"), "html")
        return skew.join(rows, learned.withColumnRenamed("host", "_h"), {"host": "_h"}, "left").select("page_id", "url", "host", "main", "classes", "html")


def checked(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """The templates without the text tokens that break the order of their class on some page."""
    if not learned.where(F.exists("classes", lambda c: F.size(c) > 1)).limit(1).count():
        return learned
    sent = Sent(learned)
    known = sent.known

    def run(batches):
        parser = Parser()
        bad: dict[str, set[int]] = {}
        for batch in batches:
            for i, (host, classes) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                classes = known.get(host, (None, []))[1] if known is not None else classes or []
                classes = [c for c in classes if len(c) > 1]
                if classes:
                    places = occurrences(parser, batch.column(5)[i].as_py() or "")[0]
                    for c in classes:
                        if broken := out_of_order(places, c):
                            bad.setdefault(host, set()).update(broken)
        found = [(h, t) for h, own in bad.items() for t in own]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found]), pa.array([t for _, t in found])], ["host", "token"])

    broken = sent.told(rows, learned).mapInArrow(run, "host string, token long").groupBy(F.col("host").alias("_h")).agg(F.collect_set("token").alias("bad"))
    kept = F.filter(F.transform("classes", lambda c: F.array_except(c, F.col("bad"))), lambda c: F.size(c) > 0)
    return learned.join(broken, F.col("host") == F.col("_h"), "left").select("host", "main", F.when(F.col("bad").isNull(), F.col("classes")).otherwise(kept).alias("classes"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page."""
    rows = _pages(pages)
    with storage.scratch() as keep:
        learned = storage.store(templates(rows), "templates")
        learned = storage.store(checked(rows, learned), "checked")
        sent = Sent(learned)
        keep.append(learned)
    known = None if sent.known is None else {h: (m, frozenset(t for c in classes for t in c)) for h, (m, classes) in sent.known.items()}

    def run(batch, parser):
        texts = []
        for i, (host, main, classes) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
            main, template = known.get(host, (None, frozenset())) if known is not None else (main, frozenset(t for c in classes or [] for t in c))
            texts.append("\n\n".join(blocks(parser, batch.column(5)[i].as_py() or "", main, template)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return tk.map_texts(sent.told(rows, learned), "page_id long, url string, text string, n_chars long", run, ["page_id", "url", "host", "main", "classes", "html"], Parser)
