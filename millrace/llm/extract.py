"""Main text of web pages by deducing the template that the pages of a host share.

After ExAlg (Arasu and Garcia-Molina, 2003). A page's tags are tokens, told apart by
the elements around them. Tokens with the same occurrence vector, as often as each
other on every page of a host, form an equivalence class. Classes that most pages of
the host have are valid; ordered by what encloses what they make the host's template.
The template's element that occurs once a page and holds the article is the main
container; the text slots in it, less its boilerplate parts, are the main text. Runs of
text are tokens too: a run that nearly all pages of the host have in the same place is
template, not a slot.

Vectors are never collected: a token's vector is the exclusive-or of a hash of (page,
count) over the pages, which Spark sums map-side, so a host of any size is no group.
Texts are parsed twice, once for the vectors and once to extract, and not shuffled
where the templates are small enough for Spark to broadcast them. An element knows its
parent and a path of bounded length, so a page costs its length however deep it nests.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

# Elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas math".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd tr td th".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
# Elements, and words of a class, id or role, that are not part of an article.
BOILERPLATE = frozenset("head nav header footer aside form button select textarea menu dialog".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar "
    "menu sidebar aside footer header masthead breadcrumb breadcrumbs cookie cookies consent notice notices alert "
    "popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login "
    "search widget toolbar pagination pager comment comments respond replies disqus complementary contentinfo".split())
# Of these words, those that name a place on a page rather than what stands in it: on a
# paragraph or heading they are a doubt only.
PLACE_WORDS = frozenset(
    "nav navigation navbar menu sidebar aside footer header masthead toolbar widget search login signup overlay".split())
PLAIN_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
# A mark of an advert's or comments' word and these words only is that word's mark.
OPENING_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments".split())
PART_WORDS = frozenset(
    "slot unit box banner block container wrapper area list section thread space zone frame top bottom left right".split())
MAIN = frozenset("article main".split())
MAIN_WORDS = frozenset("article main content post entry story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)   # a quote that nothing closes ends with its tag
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

_DIGITS = re.compile(r"[0-9]+")

MOST = 0.5   # share of a host's pages that a valid class occurs on
NEARLY_ALL, RUN_PAGES = 0.9, 10   # share and number of pages of a run of text that is template
REOPENED = 16   # open blocks that outlive the marked inline element around them
LONGEST_PATH = 200   # characters; what is longer is named by its hash


class Element:
    """A block element. ``doubt``: the nearest element from here upwards whose marks are
    doubtful; ``block``: the nearest that is no inline element. ``counted``: it stands in the page, and is not the rest of a cut one."""

    __slots__ = ("name", "marks", "parent", "depth", "path", "boilerplate", "doubt", "block", "main", "counted")

    def __init__(self, name, marks, parent, counted=True):
        # a whole mark decides; a word of a longer one is a doubt, left to the host's template
        whole = {m.lower() for m in marks}
        words = {w for m in whole for w in _WORD.findall(m)}
        judged = name not in MAIN and name not in ("html", "body")
        decided = any(_decides(name, m) for m in whole & BOILERPLATE_WORDS) or any(_opens(m) for m in whole - BOILERPLATE_WORDS)
        self.name, self.marks, self.parent, self.counted = name, marks, parent, counted
        self.depth = parent.depth + 1 if parent else 1
        self.block = self if name not in INLINE else parent.block if parent else None
        # doubtful marks that differ in their numbers only are one token
        self.path = (parent.path if parent else "") + "/" + name + "".join(sorted(
            "." + (_DIGITS.sub("0", m) if BOILERPLATE_WORDS.intersection(_WORD.findall(m)) else m) for m in whole))
        if len(self.path) > LONGEST_PATH:
            self.path = "#" + hashlib.blake2b(self.path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        self.boilerplate = bool(parent and parent.boilerplate) or name in BOILERPLATE or judged and decided
        own = judged and bool(words & BOILERPLATE_WORDS) and not self.boilerplate
        self.doubt = None if name in MAIN else self if own else parent.doubt if parent else None
        self.main = name in MAIN or judged and not self.doubt and bool(words & MAIN_WORDS)


def _decides(name: str, mark: str) -> bool:
    return name not in PLAIN_BLOCKS or mark not in PLACE_WORDS


def _opens(mark: str) -> bool:
    first, *rest = _WORD.findall(mark) or [""]
    return first in OPENING_WORDS and PART_WORDS.issuperset(rest)


class Stack:
    """Open block elements, with the places of each name."""

    def __init__(self):
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}

    def top(self) -> Element | None:
        return self.open[-1] if self.open else None

    def push(self, element: Element):
        self.places.setdefault(element.name, []).append(len(self.open))
        self.open.append(element)

    def cut(self, length: int) -> list[Element]:
        gone = self.open[length:]
        for e in reversed(gone):
            self.places[e.name].pop()
        del self.open[length:]
        return gone

    def last(self, name: str) -> int | None:
        places = self.places.get(name)
        return places[-1] if places else None


def parse(page: str) -> tuple[list[Element], list[tuple[Element | None, str]]]:
    """The block elements of a page in order, parents first, and its blocks of text: the
    element it stands in, and the text with references decoded and white space runs as
    one space. Scripts, styles and comments are left out."""
    elements: list[Element] = []
    stack = Stack()
    blocks: list[tuple[Element | None, str]] = []
    held: list[str] = []
    # open inline elements: name, how long the stack is with them, and whether they are on it
    inline: list[tuple[str, int, bool]] = []
    names: dict[str, int] = {}   # how many of a name are open

    def cut(length):
        stack.cut(length)
        while inline and inline[-1][1] > length:
            names[inline.pop()[0]] -= 1

    def end_inline(name):
        if not names.get(name):
            return
        k = next(k for k in range(len(inline) - 1, -1, -1) if inline[k][0] == name)
        _, length, pushed = inline.pop(k)
        names[name] -= 1
        if pushed:
            flush()
            # blocks that are still open in it go on without it; very deep ones end with it
            within = stack.cut(length - 1)[1:]
            if len(within) > REOPENED:
                cut(length - 1)
                return
            for e in within:
                elements.append(Element(e.name, e.marks, stack.top(), counted=False))
                stack.push(elements[-1])
            inline[k:] = [(n, m - 1, on) for n, m, on in inline[k:]]

    def flush():
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((stack.top(), text))

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            held.append(page[at:])
            break
        if token.start() > at:
            held.append(page[at:token.start()])
        at = token.end()
        slash, name, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
        if name is None:
            continue
        name, closing = name.lower(), bool(slash)
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                held.append(" ")
            if closing or name == "a":   # a link ends the link before it
                end_inline(name)
            if closing or name in VOID:
                continue
            marks = _marks(attributes)
            alone = Element(name, marks, None) if marks else None
            if not alone or not (alone.boilerplate or alone.doubt):
                inline.append((name, len(stack.open), False))
                names[name] = names.get(name, 0) + 1
                continue
            # an inline element marked as boilerplate counts as a block
            inline.append((name, len(stack.open) + 1, True))
            names[name] = names.get(name, 0) + 1
        if closing:
            k = stack.last(name)
            if k is not None:
                flush()
                cut(k)
            continue
        flush()
        if name in VOID:
            continue
        if name in CLOSES_P and (k := stack.last("p")) is not None:
            cut(k)
        if name in SAME:
            around = stack.top()
            if around and around.block and around.block.name in SAME[name]:
                cut(around.block.depth - 1)
        elements.append(Element(name, _marks(attributes), stack.top()))
        stack.push(elements[-1])
    flush()
    return elements, blocks


def _marks(attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return ()
    return tuple(m for found in _MARKS.findall(attributes) for m in "".join(found).split())


def _run_hash(element: Element, text: str) -> int:
    """63 bits of a run of text and the place it stands in."""
    name = f"{element.path}\n{text}".encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little") >> 1


def _tokens(batches):
    """Per page and token: how often, whether it can hold an article, and how many
    characters of text that is not boilerplate stand in it. A run of text is a token
    without a name, with its hash."""
    for batch in batches:
        out = {c: [] for c in ("host", "token", "run", "vector", "once", "main", "doubt", "depth", "chars")}

        def add(*values):
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)

        for page, host, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            elements, blocks = parse(source or "")
            times, first, chars, own, runs = {}, {}, {}, {}, {}
            for e in elements:
                if e.counted and not e.boilerplate:
                    times[e.path] = times.get(e.path, 0) + 1
                    first.setdefault(e.path, e)
            for e, text in blocks:
                if e is not None and not e.boilerplate:
                    own[e] = own.get(e, 0) + len(text)
                    run = _run_hash(e, text)
                    runs[run] = runs.get(run, 0) + 1
            for e in reversed(elements):   # children come after their parents
                n = own.pop(e, 0)
                if n:
                    chars[e.path] = chars.get(e.path, 0) + n
                    if e.parent:
                        own[e.parent] = own.get(e.parent, 0) + n

            def vector(n):
                # 63 bits from two checksums: of the page's number and of the page itself
                seed = f"{page} {n}".encode()
                return (zlib.crc32(seed) << 31) ^ zlib.adler32(seed[::-1] + b"\x01") ^ zlib.crc32(seed, 0x5bd1e995)

            for path, n in times.items():
                e = first[path]
                doubtful = e.doubt is not None and e.doubt is e
                add(host, path, None, vector(n), n == 1, e.main, doubtful, e.depth, chars.get(path, 0))
            for run, n in runs.items():
                add(host, None, run, vector(n), n == 1, False, False, 0, 0)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def templates(pages: DataFrame) -> DataFrame:
    """``(host, container, dropped, runs)``: of each host's template the token of the main
    container, the tokens that a word of a longer class, id or role makes doubtful and
    that most pages of the host have, and the runs of text that nearly all of at least
    ``RUN_PAGES`` pages have once. Doubtful text counts like any other here.

    ``pages`` has page_id, host and html. A class is valid if it occurs on at least
    half of the host's pages. Of the tokens of valid classes that occur once on each
    of their pages, the container is the outermost that is an article by its name or
    marks; if there is none, the innermost that holds 90 % of the text on the host
    that is not boilerplate. Ties go to the larger class, then by name. A host has as
    few runs as fit its pages: at most the runs of an average page, and a ninth more."""
    tokens = pages.mapInArrow(
        _tokens, "host string, token string, run long, vector long, once boolean, main boolean, doubt boolean, depth int, "
                 "chars long")
    counted = tokens.groupBy("host", "token", "run").agg(
        F.bit_xor("vector").alias("vector"), F.count("*").alias("support"), F.min("once").alias("once"),
        F.max("main").alias("main"), F.max("doubt").alias("doubt"), F.min("depth").alias("depth"), F.sum("chars").alias("chars"))
    counted = settle(counted.where(F.col("token").isNotNull() | (F.col("support") >= RUN_PAGES * NEARLY_ALL)), "tokens")
    seen = counted.where("token is not null").drop("run")
    host = seen.groupBy("host").agg(F.max("support").alias("pages"), F.max("chars").alias("text"))
    classes = seen.groupBy("host", "vector").agg(F.count("*").alias("members"))
    valid = (seen.join(classes, ["host", "vector"]).join(host, "host")
             .where((F.col("support") >= MOST * F.col("pages")) & F.col("once") & (F.col("chars") > 0)))
    named = F.struct(F.col("depth").alias("depth"), (-F.col("members")).alias("members"), F.col("token").alias("token"))
    deepest = F.struct((-F.col("depth")).alias("depth"), (-F.col("members")).alias("members"),
                       F.col("token").alias("token"))
    chosen = valid.groupBy("host").agg(
        F.min(F.when(F.col("main"), named)).alias("named"),
        F.min(F.when(F.col("chars") >= 0.9 * F.col("text"), deepest)).alias("deepest"))
    dropped = (seen.where("doubt").join(host.select("host", "pages"), "host")
               .where(F.col("support") >= MOST * F.col("pages"))
               .groupBy("host").agg(F.collect_set("token").alias("dropped")))
    runs = (counted.where("run is not null and once").join(host.select("host", "pages"), "host")
            .where((F.col("pages") >= RUN_PAGES) & (F.col("support") >= NEARLY_ALL * F.col("pages")))
            .groupBy("host").agg(F.collect_set("run").alias("runs")))
    return settle(chosen.select("host", F.coalesce("named.token", "deepest.token").alias("container"))
                  .where("container is not null").join(dropped, "host", "left").join(runs, "host", "left"), "templates")


def main_text(source: str, container: str | None, dropped: list[str] | None = None, runs: list[int] | None = None) -> str:
    """The text slots of a page in the container, or, on a page that does not have it,
    in the page's own outermost article, else in all that is not boilerplate. Elements in
    ``dropped`` are left out unless they are the container or hold it. Runs in ``runs`` are
    left out where they are the smaller part of the page's text: a host of copies of one
    page has its texts in the template, and keeps them."""
    elements, blocks = parse(source)
    blocks = [(e, text) for e, text in blocks if e is None or not e.boilerplate]
    at = next((e for e in elements if e.path == container), None) if container is not None else None
    inside = _below(elements, lambda e: e.path == container)
    if at is None or not any(e in inside for e, _ in blocks):
        at = min((e for e in elements if e.counted and e.main and not e.boilerplate), key=lambda e: e.depth, default=None)
        inside = _below(elements, lambda e: e.path == at.path) if at else None
    unsafe = set(dropped or ())
    while at is not None:
        unsafe.discard(at.path)
        at = at.parent
    out = _below(elements, lambda e: e.doubt is e and e.path in unsafe) if unsafe else set()
    slots = [(e, text) for e, text in blocks if (inside is None or e in inside) and e not in out]
    if runs:
        shared = set(runs)
        left = [(e, text) for e, text in slots if e is None or _run_hash(e, text) not in shared]
        if 2 * sum(len(text) for _, text in left) > sum(len(text) for _, text in slots):
            slots = left
    return "\n\n".join(text for _, text in slots)


def _below(elements: list[Element], chosen) -> set[Element]:
    """The chosen elements and all in them."""
    found: set[Element] = set()
    for e in elements:
        if e.parent in found or chosen(e):
            found.add(e)
    return found


def _extract(batches):
    for batch in batches:
        text = [main_text(source or "", container, dropped, runs) for source, container, dropped, runs in
                zip(*(batch.column(c).to_pylist() for c in ("_html", "container", "dropped", "runs")), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()),
             pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per input row.

    A null or empty html gives an empty text. Pages whose url is null or names no host
    share one template, as pages of one host. Repeated rows count once in a vector's
    exclusive-or or not at all, alike for all tokens of the page. Texts of any length
    are taken whole. Other columns are not read. An empty table gives no rows.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                       F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST, 1)).alias("host"),
                       F.col(html).cast("string").alias("_html"))
    container = templates(own.select("page_id", "host", "_html"))
    schema = (f"page_id {own.schema['page_id'].dataType.simpleString()}, "
              f"url {own.schema['url'].dataType.simpleString()}, text string, n_chars long")
    return own.join(container, "host", "left").mapInArrow(_extract, schema)
