"""Main text of web pages by wrappers: union-free regular expressions inferred for each host from all its pages.

Pages of a host are aligned one after another, element by element. Where two streams differ, an element that only one has
becomes optional, neighbours alike become a repeated group, and texts that differ become a slot. Slots show where the
content element is; all its text that is not in dropped or marked parts is the article, whether it varies or not.
"""

from __future__ import annotations

import html as html_
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, root_scale, slices
from .url_filter import host_path

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"""[>"']""")
_COMMENT_END = re.compile(r"--\s*>|\Z")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
#: Elements that stand inside a line and never are article text, and those of formulas that only repeat them as source.
UNSEEN_INLINE = set("svg button canvas input embed annotation annotation-xml".split())
FOREIGN = {"svg", "annotation", "annotation-xml"}  # <svg/> is closed, <button/> is not
FORMULA = set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
INLINE = UNSEEN_INLINE | FORMULA | set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that a new block closes, with what is open inside them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that open a context of their own: what is open outside is not closed by what opens inside.
BARRIERS = {"table", "ul", "ol", "article", "section", "div", "body"}
#: Elements that never are article text.
DROPPED = set("head nav footer aside form script style noscript template select option textarea iframe object audio video dialog menu title fieldset datalist map xmp noembed noframes".split())
#: Words of a class, id or role that mark an element, and beginnings of such words, as in commentlist or advertisement2: wherever
#: they stand in it, but in an article only where what follows names a place or shape, as in share-buttons and not in cookie-recipe.
MARKS = set(
    "ad ads adv sponsored promo nav navbar navigation menu menubar sidebar masthead cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing social comment comments disqus toolbar".split()
)
MARK_STARTS = ("advert", "breadcrumb", "comment", "cookie", "navbar", "newsletter", "popup", "promo", "sidebar", "sponsor", "subscri")
#: Words that mark only as a whole name or beside words of place and shape: related-posts is marked, related-work is not.
WEAK_MARKS = set(
    "banner aside footer header notice alert popup modal overlay dialog related recommended recommendations reply replies discussion widget search form pagination pager copyright contentinfo complementary skip hidden tagcloud respond posts links".split()
)
PLACES = set("box block bar list item items container wrapper wrap area section inner outer left right top bottom main row col column panel group site page global primary secondary content site fixed sticky".split())
#: Words that follow a marking one and leave it what the name is about.
SHAPES = set("icons icon buttons button link thread form feed count toggle tools tool prompt cta unit slot inline strip ribbon tray text author meta date avatar title label law info policy".split())
#: A name with one of these tells what an element has or lacks, as in has-sidebar, and not what it is.
ASIDE_WORDS = {"has", "with", "without", "no"}
#: Elements that are blocks of text or groups of such, never all of an article.
TEXTS = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address summary center".split())
CONTENT = set("article content main post entry story body text".split())


def is_marked(names: tuple[str, ...], in_article: bool) -> bool:
    """Whether the names in class, id and role mark an element as no article text. An article's own header holds its heading."""
    return any(_name_marks(n, in_article) for n in names)


@lru_cache(maxsize=65_536)
def _name_marks(name: str, in_article: bool) -> bool:
    words = _WORDS.findall(name)
    if ASIDE_WORDS.intersection(words):
        return False
    marking = [w in MARKS or w.startswith(MARK_STARTS) for w in words]
    if any(marking):
        about = max(k for k, m in enumerate(marking) if m)
        return not in_article or all(w in PLACES or w in SHAPES or w in WEAK_MARKS for w in words[about + 1 :])
    weak = {w for w in words if w in WEAK_MARKS} - ({"header"} if in_article else set())
    return bool(weak - {"posts", "links"}) and all(w in WEAK_MARKS or w in PLACES for w in words)


_WORDS = re.compile(r"[a-z]+")


@dataclass
class Node:
    """An element of a wrapper. text: None, a constant, or True for a slot; least: 0 if optional; many: whether it repeats.

    parts holds sequences of children: one, or several that are still to be aligned (see settle).
    """

    key: str
    least: int = 1
    many: bool = False
    text: str | bool | None = None
    chars: int = 0
    parts: list[list[Node]] = field(default_factory=lambda: [[]])

    @property
    def inner(self) -> list[Node]:
        return self.parts[0]


def to_json(wrapper: Node) -> str:
    """A wrapper as one flat list in document order, so that depth costs nothing; each element says how many children it has."""
    flat, todo = [], [wrapper]
    while todo:
        n = todo.pop()
        flat.append([n.key, n.least, int(n.many), n.text, n.chars, len(n.inner)])
        todo.extend(reversed(n.inner))
    return json.dumps(flat)


def from_json(plain: str) -> Node:
    root = Node("")
    todo: list[list] = [[root, 1]]
    for key, least, many, text, chars, inner in json.loads(plain):
        while todo[-1][1] == 0:
            todo.pop()
        todo[-1][1] -= 1
        node = Node(key, least, bool(many), text, chars)
        todo[-1][0].inner.append(node)
        todo.append([node, inner])
    return root.inner[0]


def merged(a: Node, b: Node, repeat: bool = False) -> Node:
    """The wrapper of what either wrapper matches; of a sibling of the same kind, if repeat."""
    return settle(_joined(a, b, repeat))


def _joined(a: Node, b: Node, repeat: bool = False) -> Node:
    return Node(a.key, min(a.least, b.least), a.many or b.many or repeat, a.text if a.text == b.text else True, a.chars + b.chars, a.parts + b.parts)


def settle(top: Node) -> Node:
    """Aligns all sequences of children that are still apart, from the top down, by a list of elements to do."""
    todo = [top]
    while todo:
        node = todo.pop()
        inner = node.parts[0]
        for more in node.parts[1:]:
            inner = aligned(inner, more)
        node.parts = [inner]
        todo.extend(n for n in inner if len(n.parts) > 1)
    return top


#: Cells of the table by which two sequences of children are aligned as well as possible; larger ones match the first that fits.
CELLS = 250_000


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A common subsequence as pairs of positions: the longest, within CELLS; else each of b with the next one alike in a."""
    n, m = len(a), len(b)
    start = next((i for i in range(min(n, m)) if a[i] != b[i]), min(n, m))
    end = next((i for i in range(min(n, m) - start) if a[n - 1 - i] != b[m - 1 - i]), min(n, m) - start)
    out = [(i, i) for i in range(start)]
    rows, cols = n - start - end, m - start - end
    if rows * cols > CELLS:
        places: dict[str, list[int]] = {}
        for i in range(start, n - end):
            places.setdefault(a[i], []).append(i)
        at = start
        for j in range(start, m - end):
            here = places.get(b[j], [])
            if (k := bisect_left(here, at)) < len(here):
                out.append((here[k], j))
                at = here[k] + 1
    else:
        best = [[0] * (cols + 1) for _ in range(rows + 1)]
        for i in range(rows - 1, -1, -1):
            for j in range(cols - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[start + i] == b[start + j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < rows and j < cols:
            if a[start + i] == b[start + j]:
                out.append((start + i, start + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(n - k, m - k) for k in range(end, 0, -1)]


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """Two child sequences as one: those that match in order are joined, the rest is optional, neighbours alike become a repeated group."""
    out: list[Node] = []

    def put(node: Node, optional: bool) -> None:
        if optional:
            node.least = 0
        if optional and out and out[-1].key == node.key:
            out[-1] = _joined(out[-1], node, repeat=True)
        else:
            out.append(node)

    i = j = 0
    for x, y in [*_matches([n.key for n in a], [n.key for n in b]), (len(a), len(b))]:
        for node in (*a[i:x], *b[j:y]):
            put(node, True)
        if x < len(a):
            put(_joined(a[x], b[y]), False)
        i, j = x + 1, y + 1
    return out


@dataclass
class Open:
    """An open element: where it is in the page's list of elements, and the nearest open p, li and the like up to a barrier."""

    name: str
    node: Node
    element: int
    dropped: bool
    marked: bool
    closable: dict[str, int]


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html_.unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t") else {}


def tags(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """What a page consists of, in one pass: (text, False, "", "") and ("", whether it closes, element name, attributes).

    A tag ends at the first > outside quotes; one that never ends is dropped with what follows. Comments, declarations
    and contents of raw elements (RAW) are left out. Each character is looked at a bounded number of times: where quotes
    are found to leave a tag open to the end of the page, tags from there on end at the first >.
    """
    at, n, last, quoted = 0, len(page), page.rfind(">"), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield page[at:lt], False, "", ""
        if lt == n:
            return
        if page.startswith("<!--", lt):
            at = _COMMENT_END.search(page, lt + 4).end()
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            yield page[lt + 9 : n if end < 0 else end].replace("&", "&amp;"), False, "", ""
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), lt):
            at = page.find(">", lt) + 1 or n
        elif (name := _NAME.match(page, lt)) is None:
            yield "<", False, "", ""
            at = lt + 1
        elif lt > last:
            return
        else:
            if plain := _TAG.match(page, lt):
                end = plain.end() - 1
            else:
                end = name.end()
                while quoted and end >= 0 and (m := _QUOTE_OR_END.search(page, end)) and m[0] != ">":
                    end = page.find(m[0], m.end()) + 1 or -1
                end = m.start() if quoted and end >= 0 and m else -1
                if end < 0:
                    quoted, end = False, page.find(">", name.end())
            at, element = end + 1, name[2].lower()
            if not name[1] and element in RAW:
                close = _raw_end(element).search(page, at)
                at = close.end() if close else n
            else:
                yield "", bool(name[1]), element, page[name.end() : end]


@lru_cache(maxsize=64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I)


@dataclass
class Page:
    """A page's own wrapper; its elements as parent and key; its blocks: element, text, whether inside a dropped element, inside a marked one."""

    wrapper: Node
    parents: list[int]
    keys: list[str]
    blocks: list[tuple[int, str, bool, bool]]


def read(page: str) -> Page:
    root = Node("")
    parents, keys, blocks, words = [-1], [""], [], []
    stack = [Open("", root, 0, False, False, {})]
    opened: Counter = Counter()
    muted: list[str] = []  # open elements from a marked inline one on, which ends at the latest where what holds it ends
    inside: Counter = Counter()

    def flush() -> None:
        if text := " ".join("".join(words).split()):
            top = stack[-1]
            node = top.node
            node.text = text if node.text is None or node.text == text else True
            node.chars += len(text)
            blocks.append((top.element, text, top.dropped, top.marked))
        words.clear()

    def close(k: int) -> None:
        flush()
        while len(stack) > k:
            done = stack.pop()
            opened[done.name] -= 1
            inner = stack[-1].node.inner
            if inner and inner[-1].key == done.node.key:
                inner[-1] = merged(inner[-1], done.node, repeat=True)
            else:
                inner.append(done.node)

    for text, closing, name, raw in tags(page):
        if not name:
            if not muted:
                words.append(html_.unescape(text))
            continue
        if muted:
            if not closing:
                ends_outer = name not in INLINE and muted[-1] in INLINE and muted[0] not in UNSEEN_INLINE and any(n in stack[-1].closable for n in ("p", *CLOSES.get(name, ())))
                if not ends_outer:
                    if name not in VOID:
                        muted.append(name)
                        inside[name] += 1
                    continue
            elif inside[name]:
                while (done := muted.pop()) != name:
                    inside[done] -= 1
                inside[name] -= 1
                continue
            elif not opened[name]:
                continue
            muted.clear()
            inside.clear()
        if name == "br":
            flush()
            continue
        if closing:
            if name in INLINE:
                continue
            flush()
            if opened[name]:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
            continue
        own = _attributes(raw)
        names = tuple(n for k in ("class", "id", "role") if k in own for n in own[k].lower().split())
        unseen = name in UNSEEN_INLINE or "hidden" in own or own.get("aria-hidden") == "true" or "style" in own and _UNSEEN.search(own["style"]) is not None
        in_article = opened["article"] + opened["main"] > 0
        if name in INLINE:
            if name not in VOID and not (name in FOREIGN and raw.endswith("/")) and (unseen or is_marked(names, in_article)):
                muted.append(name)
                inside[name] += 1
            continue
        flush()
        if name in VOID:
            continue
        k = max((stack[-1].closable.get(n, 0) for n in ("p", *CLOSES.get(name, ()))), default=0)
        if k:
            close(k)
        top = stack[-1]
        key = name + "".join("." + _DIGITS.sub("0", w) for w in sorted(own.get("class", "").lower().split()))
        whole = name in ("html", "body", "main", "article")
        dropped = name in DROPPED or unseen or name == "header" and not in_article
        closable = {} if name in BARRIERS else {**top.closable, name: len(stack)} if name in CLOSABLE else top.closable
        stack.append(Open(name, Node(key), len(keys), top.dropped or dropped, top.marked or is_marked(names, in_article) and not whole, closable))
        opened[name] += 1
        parents.append(top.element)
        keys.append(key)
    close(1)
    return Page(root, parents, keys, blocks)


_DIGITS = re.compile(r"\d+")
CLOSABLE = {"p", *(n for names in CLOSES.values() for n in names)}


def profile(wrapper: Node, pages: int) -> list[list[str]]:
    """What a wrapper says of its pages: the paths of the content elements, as lists of keys.

    Those are all outermost articles, else all outermost mains, else the deepest element that holds all slot text which
    is not in dropped or marked parts: no single block of text, and no part of an element whose class is a word for
    content. Of a single page nothing is known to be constant, so all its text counts as slots.
    """
    ids: dict[tuple[int, str], int] = {(-1, ""): 0}
    paths, amounts, depth = [(-1, "")], [0], [0]
    found: dict[str, dict[int, None]] = {"article": {}, "main": {}}
    todo = [(wrapper, -1, frozenset())]
    while todo:
        node, parent, within = todo.pop()
        name, *classes = node.key.split(".")
        in_article = bool(within)
        if name in DROPPED or name == "header" and not in_article or name not in ("html", "body", "main", "article") and is_marked(tuple(classes), in_article):
            continue
        at = ids.setdefault((parent, node.key), len(paths))
        if at == len(paths):
            paths.append((parent, node.key))
            amounts.append(0)
            depth.append(depth[parent] + 1)
        if name in found:
            if name not in within:
                found[name].setdefault(at)
            within |= {name}
        amounts[at] += node.chars if node.text is True or pages == 1 else 0
        todo.extend((n, at, within) for n in reversed(node.inner))
    for at in range(len(paths) - 1, 0, -1):
        amounts[paths[at][0]] += amounts[at]

    def path(at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(at)
            at = paths[at][0]
        return out[::-1]

    def name_of(at: int) -> str:
        return paths[at][1].split(".")[0]

    if roots := found["article"] or found["main"]:
        return [[paths[k][1] for k in path(at)] for at in roots]
    root = max((at for at, n in enumerate(amounts) if n == amounts[0]), key=depth.__getitem__) if amounts[0] else 0
    while root and name_of(root) in TEXTS:
        root = paths[root][0]
    above = path(root)
    for k, at in enumerate(above[1:], 1):
        if name_of(above[k - 1]) not in ("html", "body") and CONTENT & {w for c in paths[above[k - 1]][1].split(".")[1:] for w in _WORDS.findall(c)}:
            above = above[:k]
            break
    return [[paths[k][1] for k in above]]


def main_text(page: str, roots: list[list[str]]) -> str:
    """The page's blocks below the content elements that are neither in dropped nor in marked elements; joined by newlines.

    A page without such blocks is judged by its own wrapper, so one that differs from its host keeps its text; one that has
    nothing but dropped and marked elements has none.
    """
    own = read(page)

    def below(paths: list[list[str]]) -> list[str]:
        tree: dict = {}
        for keys in paths:
            at = tree
            for key in keys:
                at = at.setdefault(key, {})
            at[None] = True
        state: list = [tree]
        for parent, key in zip(own.parents[1:], own.keys[1:]):
            here = state[parent]
            state.append(here if here is None or None in here else here.get(key, _NOWHERE))
        return [t for e, t, dropped, marked in own.blocks if None in state[e] and not dropped and not marked]

    return "\n".join(below(roots) or below(profile(own.wrapper, 1)))


_NOWHERE: dict = {}


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON, see to_json), pages: the wrapper of each host from all its pages (host, html).

    Pages fold into one wrapper per host and batch where they are read; these, a few for each partition, fold by (host,
    salt) and then by host, so a host with most pages is no more work for one task than others. Repeated pages count
    as pages, an empty page has an empty wrapper, a null host is a host, and no pages give no rows.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, tuple[Node, int]] = {}
            for part in slices(batch, 256):
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    one, (all_, n) = read(page or "").wrapper, known.get(host, (None, 0))
                    known[host] = (one if all_ is None else merged(all_, one), n + 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([to_json(w) for w, _ in known.values()], pa.string()), pa.array([n for _, n in known.values()], pa.int64())], ["host", "wrapper", "pages"])

    def combine(rows: pa.Table) -> pa.Table:
        wrapper, pages_ = None, 0
        for plain, n in sorted(zip(rows["wrapper"].to_pylist(), rows["pages"].to_pylist())):
            one = from_json(plain)
            wrapper, pages_ = (one if wrapper is None else merged(wrapper, one)), pages_ + n
        return pa.table({"host": pa.array([rows["host"][0].as_py()], pa.string()), "wrapper": pa.array([to_json(wrapper)], pa.string()), "pages": pa.array([pages_], pa.int64())})

    schema, salts = "host string, wrapper string, pages long", root_scale(pages.count(), 16, 4096, by=64)
    some = pages.select("host", "html").mapInArrow(fold, schema).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    return some.groupBy("host", "salt").applyInArrow(combine, schema).groupBy("host").applyInArrow(combine, schema)


def profiles(wrappers: DataFrame) -> DataFrame:
    """host, roots (JSON, see profile), pages for each row of infer_wrappers: a path or a few, however many pages the host has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [json.dumps(profile(from_json(w), n)) for w, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(roots, pa.string()), batch.column(2)], ["host", "roots", "pages"])

    return wrappers.select("host", "wrapper", "pages").mapInArrow(run, "host string, roots string, pages long")


def extract(pages: DataFrame, most_hosts: int = 5_000) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, url, text, n_chars.

    The text is the article's blocks, character references decoded, white space inside a block one space, joined by \\n.
    Null html counts as empty and gives an empty text, as does a page without article; a null url is a host of its own.
    Repeated rows have a row each, an empty table gives an empty result, other columns are not looked at. Up to most_hosts
    hosts' profiles, of a few hundred bytes each, go to the tasks with the function; more are joined to the pages.
    """
    host, _ = host_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.coalesce(host, F.lit("")).alias("host"))
    known = cut(profiles(infer_wrappers(rows)))
    n = known.count()
    names, schema = ["page_id", "url", "text", "n_chars"], "page_id long, url string, text string, n_chars long"

    def texts(part: pa.RecordBatch, of: list[list[list[str]]]) -> pa.RecordBatch:
        out = [main_text(page, roots) for page, roots in zip(part.column(2).to_pylist(), of)]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names)

    if n <= most_hosts:
        roots = {r["host"]: json.loads(r["roots"]) for r in known.collect()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 128):
                    yield texts(part, [roots[h] for h in part.column(3).to_pylist()])

        return rows.select("page_id", "url", "html", "host").mapInArrow(run, schema)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(maxsize=1024)(json.loads)
        for batch in batches:
            for part in slices(batch, 128):
                yield texts(part, [of(r) for r in part.column(3).to_pylist()])

    return join_hot(rows, known, "host", "pages", rows.count()).select("page_id", "url", "html", "roots").mapInArrow(run_joined, schema)
