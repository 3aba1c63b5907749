"""Main text of web pages, with site templates found by counting element subtrees per host.

A first pass over all pages hashes every block element's subtree in two ways: exactly (its tag, text and children),
and by its shape (tags, classes and ids, with texts, addresses and the length of lists masked), as menus, adverts and
footers recur with other words in them. Spark counts, per host, on how many different pages (different main texts,
so copies of a page count once) each hash stands. A subtree on many of a host's pages is template, and ``extract``
deletes it. What is left of a page is then cleaned by what its tag, role or class names: scripts, forms, menus,
headers, footers, sidebars, notices, adverts, reader comments; this second step matters for hosts of few pages and
for parts that few pages have. ``extract(..., by_names=False)`` gives the text by the first step alone. What class or
id alone name so is kept if it holds the article, and so is, within the article, what is named by a word that articles are
about (legal, search); classes of layout or state (has-sidebar, comments-open) name nothing.

An exact subtree outside the article is template from ``few`` pages and a share of ``share`` of the host's pages on,
inside it from ``many`` and ``inside``. A shape counts only where it stands outside the page's article or, on a page
without one, if most of its text is links. What holds the article or most of a page's text is never deleted.

Defined results: null or empty html gives an empty text; pages without a host form one host of their own; a host
with few pages has no template; unclosed and misnested tags are closed as browsers do; pages of any size are read
whole, in time that grows with their length; repeated rows get equal texts; an empty table gives no rows; other
columns are kept, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.llm.common import discard, fresh, keep, slices, spread_join

# Fixed values of HTML: kinds of elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg math".split())
_DROP = frozenset("nav aside form script style noscript iframe template svg math button select option textarea input object embed canvas audio video menu dialog title head".split())
_CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li"} | {"li", "dd", "dt", "table"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tr", "td", "th"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}, "option": {"select"}}
#: Words of class and id, and roles, that name what isn't main text.
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices popup popups modal overlay sidebar sidebars aside menu menus nav navbar navigation navi breadcrumb breadcrumbs footer foot masthead topbar toolbar share sharing social comment comments commentlist disqus respond replies related recommended recommendations subscribe subscription newsletter signup login search searchbox pagination pager skip widget widgets copyright legal disclaimer".split())
#: Of these, the ones that name reader comments and links to other articles, which may be articles themselves.
_OTHERS = frozenset("comment comments commentlist disqus respond replies related recommended recommendations sidebar sidebars aside promo promos promotion sponsor sponsored sponsors ad ads advert adverts".split())
#: Of these, the ones that an article may be about: inside an article they name nothing.
_TOPICS = frozenset("legal disclaimer copyright search login signup".split())
#: A class that tells how a page is laid out or what state it is in (has-sidebar, comments-open) names no element.
_BEFORE = frozenset("has no with without is not hide hides show shows".split())
_AFTER = frozenset("open opened closed enabled disabled off on allowed hidden visible active count".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAMED = re.compile(r"\b(?:class|id|role|hidden|aria-hidden|aria-modal)\b", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "parent", "children", "drop", "named", "block", "digest", "shape", "size", "links", "hidden", "inner")

    def __init__(self, tag: str, parent: Element | None, drop: int, named: str = "") -> None:
        self.tag, self.parent, self.drop, self.named = tag, parent, drop, named
        self.children: list = []
        self.digest = self.shape = self.size = self.links = 0
        self.hidden = self.inner = False
        self.block: Element = self if parent is None or tag in BLOCKS else parent.block


def _named(value: str) -> set[str]:
    """The words of class or id that name an element, without classes of layout and state."""
    out: set[str] = set()
    for token in value.split():
        parts = [x for x in _SPLIT.split(token) if x]
        if parts and (len(parts) == 1 or not (parts[0] in _BEFORE or parts[-1] in _AFTER)):
            out.update(parts)
    return out


def _unwanted(tag: str, attrs: str) -> int:
    """0: wanted; 1: unwanted by tag, role or as hidden; 2: by its name; 3: by a name of comments or other articles; 4: by a topic's name."""
    if tag in _DROP:
        return 1
    if not attrs or not _NAMED.search(attrs) or tag in ("html", "body", "main"):
        return 0
    if tag == "article":
        values = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _ATTR.finditer(attrs)]
        return int(any((n in ("class", "id") and not _named(v).isdisjoint(("comment", "comments"))) or (n == "role" and v == "comment") for n, v in values))
    names: set[str] = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            names |= _named(value) & _NAMES
        if (name == "role" and value in _ROLES) or (name == "aria-hidden" and value == "true"):
            return 1
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs, re.I):
        return 1
    return 0 if not names else 4 if names <= _TOPICS else 2 if names.isdisjoint(_OTHERS) else 3


class _Open:
    """The open elements, innermost last, and the depths at which each tag is open. Every step is amortised constant."""

    def __init__(self, root: Element) -> None:
        self.stack = [root]
        self.depths: dict[str, list[int]] = {}

    def push(self, e: Element) -> None:
        self.depths.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)

    def close(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()

    def nearest(self, tags: Iterable[str]) -> int:
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def outermost(self, tags: Iterable[str], below: int) -> int:
        """The least depth beyond ``below`` of an element of these tags, or 0; what is passed is about to be closed."""
        found = 0
        for t in tags:
            for d in reversed(self.depths.get(t, ())):
                if d <= below:
                    break
                found = min(found or d, d)
        return found


def parse(source: str) -> Element:
    """A tree of elements and strings."""
    root = Element("#root", None, 0)
    open_, at = _Open(root), 0
    find = _TAG.search
    while True:
        m = find(source, at)
        top = open_.stack[-1]
        if m is None:
            if at < len(source):
                top.children.append(source[at:])
            return root
        if m.start() > at:
            top.children.append(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                top.children.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1]:  # an end tag closes the nearest open element of its name and all within
            depth = open_.nearest((tag,))
            if depth:
                open_.close(depth)
            elif tag in ("p", "br"):
                top.children.append(Element("br", top, 0))
            continue
        if tag in _CLOSES_P and top.block.tag == "p":
            open_.close(open_.nearest("p"))
        if tag in _SIBLINGS:
            depth = open_.outermost(_SIBLINGS[tag], open_.nearest(_FENCE[tag]))
            if depth:
                open_.close(depth)
        top = open_.stack[-1]
        new = Element(tag, top, _unwanted(tag, m[3]), _label(m[3]))
        top.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not (m[3].rstrip().endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "span", "em", "strong")):
            open_.push(new)


def _label(attrs: str) -> str:
    """Classes and id of an element, numbers masked."""
    if not attrs or not _NAMED.search(attrs):
        return ""
    values = [m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs) if m[1].lower() in ("class", "id")]
    return " ".join(sorted(re.sub(r"[0-9]+", "0", " ".join(values)).lower().split()))


def _walk(root: Element) -> list[Element]:
    """All elements, parents before children."""
    out = [root]
    for e in out:
        out.extend(c for c in e.children if type(c) is Element)
    return out


def _hash(order: list[Element]) -> None:
    """Digest, shape, text length and length of link texts of each subtree, from the leaves up."""
    for e in reversed(order):
        h, shape, n, links, last = xxhash.xxh64(e.tag), xxhash.xxh64(f"{e.tag} {e.named}", seed=1), 0, 0, None
        for c in e.children:
            if type(c) is str:
                t = _SPACE.sub(" ", c).strip()
                if t:
                    h.update("\x01" + t)
                    n += len(t)
                    kind = 1
                else:
                    continue
            else:
                h.update(c.digest.to_bytes(8, "little"))
                n += c.size
                links += c.links
                kind = c.shape
            if kind != last:  # lists of any length have one shape
                shape.update(kind.to_bytes(8, "little"))
                last = kind
        e.digest, e.shape, e.size, e.links = h.intdigest(), shape.intdigest(), n, n if e.tag == "a" else links


def _rescue(order: list[Element]) -> None:
    """Keep what its name alone marks as unwanted where it holds the article or, without any, the main element.

    Where the page has an article elsewhere, or the name is one of comments or other articles, only what holds most
    of the page's text is kept. Sizes must have been taken.
    """
    size = order[0].size
    for tag in ("article", "main"):
        # of each element: the nearest dropped one above, and whether one of this tag is above
        wrap: dict[int, Element | None] = {id(order[0]): None}
        within = {id(order[0]): False}
        apart, inside = False, []
        for e in order[1:]:
            p = e.parent
            wrap[id(e)] = p if p.drop else wrap[id(p)]
            within[id(e)] = within[id(p)] or p.tag == tag
            if e.tag == tag and not e.drop:
                if wrap[id(e)] is None:
                    apart = True
                elif not within[id(e)]:
                    inside.append(wrap[id(e)])
        known: dict[int, bool] = {}
        kept: list[Element] = []
        for w in inside:
            chain, x = [], w
            while x is not None and id(x) not in known:
                chain.append(x)
                x = wrap[id(x)]
            good = x is None or known[id(x)]
            for x in reversed(chain):
                good = good and x.drop > 1 and (2 * x.size > size or (not apart and x.drop in (2, 4)))
                known[id(x)] = good
        for w in inside:
            while w is not None and known[id(w)] and w.drop:
                kept.append(w)
                w.drop, w = 0, wrap[id(w)]
        if apart or kept:
            return


def _articles(order: list[Element]) -> list[Element]:
    """The topmost articles that aren't comments; without any, the topmost main elements. Marks what is in and above them."""
    _rescue(order)
    tops: list[Element] = []
    for tag in ("article", "main"):
        barred = {id(order[0]): False}
        for e in order[1:]:
            p = e.parent
            barred[id(e)] = barred[id(p)] or bool(p.drop) or (p.tag == tag and p is not order[0])
            if e.tag == tag and not e.drop and not barred[id(e)]:
                tops.append(e)
        if tops:
            break
    order[0].hidden = True
    for a in tops:
        a.inner = True
        while a is not None and not a.hidden:
            a.hidden, a = True, a.parent
    for e in order[1:]:
        e.inner = e.inner or e.parent.inner
    return tops


_LEAVES = frozenset("li td th tr dt dd p h1 h2 h3 h4 h5 h6 hr legend".split())


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _counts(e: Element, page: int) -> bool:
    """Whether a subtree may be template at all: it neither is above the article nor holds most of the page's text."""
    return e.tag in BLOCKS and not e.hidden and e.size > 0 and 2 * e.size <= page


def _shaped(e: Element, article: bool) -> bool:
    """Whether the shape of a subtree may tell: it stands outside the article, or is mostly links where there is none."""
    return not e.inner and (article or 2 * e.links >= e.size)


def subtrees(source: str | None) -> tuple[int, list[tuple[int, bool]]]:
    """(digest of the main text's subtree, (hash, whether inside the article) of each block element's subtree)."""
    if not source:
        return 0, []
    order = _walk(parse(source))
    root = order[0]
    _hash(order)
    articles = _articles(order)
    seen: dict[int, bool] = {}
    for e in order:
        if not _counts(e, root.size):
            continue
        d = _signed(e.digest)
        seen[d] = seen.get(d, True) and e.inner
        if _shaped(e, bool(articles)) and not (e.tag in _LEAVES and _counts(e.parent, root.size) and _shaped(e.parent, bool(articles))):
            seen[_signed(e.shape)] = False
    main = xxhash.xxh64(b"".join(a.digest.to_bytes(8, "little") for a in articles or [root])).intdigest()
    return _signed(main), list(seen.items())


def main_text(source: str | None, template: frozenset[int] = frozenset(), by_names: bool = True) -> str:
    """Blocks of the main text, joined by empty lines; without ``by_names`` all that isn't template, script or style."""
    if not source:
        return ""
    order = _walk(parse(source))
    root = order[0]
    _hash(order)
    articles = _articles(order)
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        if now:
            text = _SPACE.sub(" ", entities.unescape("".join(now)).replace("\xa0", " ")).strip()
            if text:
                blocks.append(text)
            now.clear()

    def is_template(e: Element) -> bool:
        if not template or not _counts(e, root.size):
            return False
        return _signed(e.digest) in template or (_signed(e.shape) in template and _shaped(e, bool(articles)))

    def unwanted(e: Element) -> bool:
        if not by_names:
            return e.tag in RAW or e.tag == "head"
        return (bool(e.drop) and not (e.drop == 4 and e.inner)) or e.tag == "footer" or (e.tag == "header" and not articles)

    # walk without recursion: pages nest as deep as they like
    stack: list = [("in", a) for a in reversed(articles if by_names else [])] or [("in", root)]
    while stack:
        what, e = stack.pop()
        if what == "out":
            close()
        elif type(e) is str:
            now.append(e)
        elif e.tag == "br":
            now.append(" ")
        elif is_template(e) or unwanted(e):
            close()
        else:
            if e.tag in BLOCKS:
                close()
                stack.append(("out", e))
            stack.extend(("in", c) for c in reversed(e.children))
    close()
    return "\n\n".join(blocks)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def hashed(pages: DataFrame) -> DataFrame:
    """(host, main, found) in place of the html of pages (host, html): digest of the main text, and (hash, whether inside) of subtrees."""
    kept = [c for c in pages.columns if c != "html"]
    found_type = T.ArrayType(T.StructType([T.StructField("digest", T.LongType()), T.StructField("inner", T.BooleanType())]))
    arrow = pa.list_(pa.struct([("digest", pa.int64()), ("inner", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            both = [subtrees(source) for source in batch.column("html").to_pylist()]
            found = pa.array([[{"digest": d, "inner": i} for d, i in f] for _, f in both], arrow)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([m for m, _ in both], pa.int64()), found], [*kept, "main", "found"])

    return pages.mapInArrow(run, T.StructType([*[pages.schema[c] for c in kept], T.StructField("main", T.LongType()), T.StructField("found", found_type)]))


def templates(read: DataFrame, few: int = 5, share: float = 0.2, many: int = 10, inside: float = 0.5) -> DataFrame:
    """(host, digest): the hashes of each host's template subtrees. read: host, main, found (digest, inner)."""
    each = read.select("host", "main", F.inline("found")).groupBy("host", "digest", "main").agg(F.min("inner").alias("inner"))
    counted = each.groupBy("host", "digest").agg(F.count("*").alias("n"), F.min("inner").alias("inner")).filter(F.col("n") >= few)
    total = read.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("pages"), F.count("*").alias("n_rows"))
    part = F.col("n") / F.col("pages")
    is_template = F.when(F.col("inner"), (F.col("n") >= many) & (part >= inside)).otherwise(part >= share)
    # hosts of fewer pages than ``few`` have none: the others' totals are all that the join needs
    return spread_join(counted, total.filter(F.col("pages") >= few), "host").filter(is_template).select("host", "digest")


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", by_names: bool = True, small: int = 200_000, **options) -> DataFrame:
    """pages with the column ``out``, the main text, in place of ``html``.

    Up to ``small`` template subtrees in all are sent to every task, by host; more are joined to the pages that hold
    them, by subtree, hot ones spread. Both ways give the same texts.
    """
    kept = [c for c in pages.columns if c not in (html, out)]
    rows = pages.drop(out) if out != html else pages
    number, site, mine = (fresh(pages, c) for c in ("number", "host", "template"))
    found = keep(hashed(pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html"))), "subtrees")
    known = keep(templates(found, **options), "templates")
    discard(found)
    if known.count() <= small:
        lists = known.groupBy(F.col("host").alias(site)).agg(F.collect_set("digest").alias(mine))
        joined = rows.withColumn(site, host(F.col(url))).join(F.broadcast(lists), site, "left")
    else:
        # written, so that the numbers of pages stand
        numbered = keep(rows.withColumn(number, F.monotonically_increasing_id()), "pages")
        held = hashed(numbered.select(F.col(number).alias("number"), host(F.col(url)).alias("host"), F.col(html).alias("html")))
        held = keep(held.select("number", "host", F.inline("found")).select("number", F.struct("host", "digest").alias("key"), "digest"), "held")
        key = known.select(F.struct("host", "digest").alias("key"), F.lit(True).alias("is"))
        met = spread_join(held, key.join(held.groupBy("key").agg(F.count("*").alias("n_rows")), "key"), "key").filter("is")
        lists = met.groupBy("number").agg(F.collect_set("digest").alias(mine)).withColumnRenamed("number", number)
        joined = numbered.join(lists, number, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            texts = [main_text(source, frozenset(t or ()), by_names) for source, t in zip(batch.column(html).to_pylist(), batch.column(mine).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, out])

    return joined.select(*kept, html, mine).mapInArrow(run, T.StructType([*[pages.schema[c] for c in kept], T.StructField(out, T.StringType())]))
