"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree of styles: a node is a path of block elements (tag, classes, role), and of each
node the tree knows how often it has which sequence of children (presentation) and which text (content). The importance of a
node is the normalised entropy of these: what looks and reads alike on every page of a site is worth nothing. A branch's
importance is the mean over its nodes, weighted down with depth.

What the tree has measured meets what tags, classes and roles suggest: the log odds of a prior (a menu, a paragraph, an element
beside the page's article) and the importance, which weighs more the more pages it was measured on. Branches with negative log odds are removed
from each page, within its article and without. With one page of a site there is little but the prior; with many, a repeated
list in an article goes and a section with an unlucky class name stays.

The tree is never in one place: pages give counted (host, path, feature) rows, entropies are sums over them, and a branch's mean
is an aggregate over the prefixes of paths.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkgrid.llm.common import all_salts, bounded_batches, materialize, released, salt_of

#: The importance 0.5 tells nothing, 0 and 1 change the log odds by half of STRENGTH, once there are many more than KAPPA pages.
STRENGTH, KAPPA, GAMMA = 5.0, 4.0, 0.9
#: Nodes deeper than DEPTH are counted as part of the node there; no text is lost by it.
DEPTH = 24
#: An article or main element with more than TAKEN of the text is the page's. Without one, a branch with more than MOST of the text isn't removed.
MOST, TAKEN = 0.75, 0.2
#: Prior probabilities to be main text: elements of menus and forms, elements that classes or roles call boilerplate, what stands beside
#: the page's article, others, headings and what holds the article.
MENU, CALLED, BESIDE_MAIN, OTHER, HEADING = 0.05, 0.1, 0.1, 0.8, 0.9

# Element names and class words by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noframes iframe noembed".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr output q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr button select".split())
#: What no reader sees as text.
UNSEEN = set("head script style noscript template iframe object embed svg canvas audio video textarea input noframes xmp noembed title select".split())
MENUS = set("nav aside footer dialog menu form button".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 html body article main".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CLASS_WORDS = set("ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner nav navbar navigation navi menu menubar breadcrumb breadcrumbs sidebar sidenav aside footer masthead cookie cookies consent gdpr notice notices notification disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus replies respond pagination pager toolbar skiplink".split())
HEADER_WORDS = {"header", "topbar"}
#: Words that may stand beside them in a name without changing what it names.
BESIDE = set("left right top bottom main primary secondary inner outer container wrapper wrap area list box block section item items link links post posts page site blog article widget widgets slot bar button buttons unit row col mobile desktop global local text title form".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([A-Za-z][^\s/>]*)[^>]*>|<([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in RAW}


def log_odds(p: float) -> float:
    return log(p / (1 - p))


class Element:
    """A node of a page, linked to the one that it stands in. unseen, main and free (in no menu or the like) hold for what is below too."""

    __slots__ = ("tag", "up", "path", "depth", "prior", "unseen", "main", "free", "holds_main", "children", "size")

    def __init__(self, tag: str, up: Element | None, path: str, depth: int, prior: float, unseen: bool, main: int):
        self.tag, self.up, self.path, self.depth, self.prior, self.unseen, self.main = tag, up, path, depth, prior, unseen, main
        self.free = prior >= 0 and (up is None or up.free)
        self.holds_main, self.children, self.size = False, [], 0


def names_boilerplate(name: str, in_main: bool) -> bool:
    """Whether a class or id names boilerplate: it has a word of the list, and no word that makes it another thing."""
    words = [w.lower() for w in _WORDS.findall(name)]
    bad = [w in CLASS_WORDS or (not in_main and w in HEADER_WORDS) for w in words]
    return any(bad) and all(b or w in BESIDE for b, w in zip(bad, words))


def style_of(tag: str, attributes: dict[str, str], in_main: bool) -> tuple[str, float]:
    """The name of an element in paths, and its prior log odds to be main text."""
    classes = re.sub(r"\d+", "", attributes.get("class", "")).replace("/", "").split()
    called = [c for c in classes if names_boilerplate(c, in_main)]
    style = tag + "".join("." + c.lower() for c in [*called, *(c for c in classes if c not in called)][:2])
    ident = attributes.get("id", "").replace("/", "")
    if ident and names_boilerplate(ident, in_main):
        style, called = f"{style}#{ident.lower()}", [*called, ident]
    role = attributes.get("role", "").lower()
    if role in ROLES:
        style, called = f"{style}@{role}", [*called, role]
    if tag in MENUS:
        return style, log_odds(MENU)
    if called and tag not in ("html", "body"):
        return style, log_odds(CALLED)
    if tag == "header" and not in_main:
        return style, log_odds(CALLED)
    return style, log_odds(HEADING if tag in HEADINGS else OTHER)


def parse(page: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """Blocks of text in page order, each with the element that it stands in, and all block elements, outer ones first. Linear in the page."""
    root = Element("", None, "", 0, log_odds(HEADING), False, 0)
    stack, made, blocks, held = [root], [root], [], []
    is_open: dict[str, int] = {}

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                blocks.append((stack[-1], text))

    def pop_to(at: int) -> None:
        if any(e.tag not in INLINE for e in stack[at:]):
            flush()
        for e in stack[at:]:
            is_open[e.tag] -= 1
        del stack[at:]

    def closes(tag: str) -> int:
        """Where the element stands that an end tag closes, or 0."""
        if not is_open.get(tag):
            return 0
        i = len(stack) - 1
        while i > 0 and stack[i].tag != tag:
            if tag in INLINE and stack[i].tag not in INLINE or tag == "p" and stack[i].tag in ("table", "td", "th", "article", "button"):
                return 0
            i -= 1
        return i

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            held.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            held.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        closing, opening, raw = m[1], m[2] or m[4], m[3] if m[2] else m[5]
        if closing:
            tag = closing.lower()
            i = closes(tag)
            if i > 0:
                pop_to(i)
            elif tag not in INLINE:
                flush()
            continue
        if not opening:
            continue
        tag = opening.lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag in CLOSES_P and is_open.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in ("table", "td", "th", "button"):
                    break
        if tag in SIBLINGS and any(is_open.get(t) for t in SIBLINGS[tag]):
            lowest = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    lowest = i
                elif stack[i].tag in BOUNDS[tag]:
                    break
            if lowest:
                pop_to(lowest)
        attributes = {a.lower(): entities.unescape(b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}
        top = stack[-1]
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        style, prior = style_of(tag, attributes, top.main > 0)
        unseen = top.unseen or tag in UNSEEN or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
        main = 2 if tag == "article" else max(top.main, 1) if tag == "main" or attributes.get("role") == "main" else top.main
        if tag in INLINE and prior > 0:
            e = Element(tag, top, top.path, top.depth, prior, unseen, main)
        else:
            if tag not in INLINE:
                flush()
            if top.depth < DEPTH:
                top.children.append(style)
                e = Element(tag, top, f"{top.path}/{style}", top.depth + 1, prior, unseen, main)
                made.append(e)
            else:
                e = Element(tag, top, top.path, top.depth, prior, unseen, main)
        if tag in RAW:
            at = _RAW_END[tag].search(page, at).end()
            continue
        if (tag == "article" or main > top.main) and not unseen:
            x = top
            while x is not None and not x.holds_main:
                x.holds_main, x = True, x.up
        stack.append(e)
        is_open[tag] = is_open.get(tag, 0) + 1
    flush()
    return blocks, made


def main_level(blocks: list[tuple[Element, str]]) -> int:
    """What the page's text is in: 2 in an article, 1 in a main element, 0 in neither. Those in menus count if there are no others."""
    free = [(e, text) for e, text in blocks if e.free]
    if any(e.main for e, _ in free):
        blocks = free
    size = sum(len(text) for _, text in blocks)
    return next((k for k in (2, 1) if sum(len(text) for e, text in blocks if e.main >= k) > TAKEN * size), 0)


def own_text(path: str) -> str:
    """The path of the text that stands directly in an element around the article."""
    return path + "/#"


def path_hash(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def main_text(page: str, noise: set[int] = frozenset()) -> str:
    """The text of a page without the branches in noise (see path_hash), which the tree of its site names.

    An element around the article is never removed as a whole (a menu or form only if all articles stand in such), nor, where the
    page's text is in no article or main, one with most of the text. A page whose text would all go keeps its article, or all:
    where all of a page repeats, nothing of it is boilerplate.
    """
    blocks, _ = parse(page)
    seen = [(e, text) for e, text in blocks if not e.unseen]
    if not noise:
        return " ".join(text for _, text in seen)
    level, total = main_level(seen), sum(len(text) for _, text in seen)
    free_main = any(e.main and e.free for e, _ in seen)
    state: dict[int, bool] = {}

    def removed(e: Element) -> bool:
        """Whether e is in a removed branch. Remembered for all elements on the way, so that deep pages stay linear."""
        way = []
        x: Element | None = e
        while x is not None and id(x) not in state:
            way.append(x)
            x = x.up
        gone = state[id(x)] if x is not None else False
        for y in reversed(way):
            if not gone and y.path and path_hash(y.path) in noise:
                around = y.holds_main and not (free_main and y.prior < 0)
                gone = not around and (level > 0 or y.size <= MOST * total)
            state[id(y)] = gone
        return gone

    if not level:
        for e, text in seen:
            e.size += len(text)
        for e in reversed(_elements(seen)):
            if e.up is not None:
                e.up.size += e.size
    kept = [text for e, text in seen if not removed(e) and not (beside(e, level) and e.holds_main and path_hash(own_text(e.path)) in noise)]
    kept = kept or [text for e, text in seen if e.main >= level]
    return " ".join(kept)


def beside(e: Element, level: int) -> bool:
    return e.main < level


def _elements(blocks: list[tuple[Element, str]]) -> list[Element]:
    """The elements that blocks stand in and those around them, outer ones first."""
    known: set[int] = set()
    out: list[Element] = []
    for e, _ in blocks:
        way = []
        x: Element | None = e
        while x is not None and id(x) not in known:
            known.add(id(x))
            way.append(x)
            x = x.up
        out.extend(reversed(way))
    return out


def page_features(page: str) -> list[tuple[str, float, int, int]]:
    """(path, prior, kind, hash) of each path of a page: kind 0 is the children's styles, runs of one style counting once, 1 the text."""
    blocks, made = parse(page)
    level = main_level([b for b in blocks if not b[0].unseen])
    styles: dict[str, list[str]] = {}
    prior: dict[str, float] = {}
    for e in made[1:]:
        runs = [c for i, c in enumerate(e.children) if not i or c != e.children[i - 1]]
        styles.setdefault(e.path, []).append(" ".join(runs))
        p = min(e.prior, log_odds(BESIDE_MAIN)) if beside(e, level) and not e.holds_main else e.prior
        prior[e.path] = min(p, prior.get(e.path, p))
    texts: dict[str, list[str]] = {}
    for e, text in blocks:
        path = e.path
        if beside(e, level) and e.holds_main:
            path = own_text(path)
            prior[path] = log_odds(BESIDE_MAIN)
        if path:
            texts.setdefault(path, []).append(text)
    out = [(p, prior[p], 0, path_hash("|".join(dict.fromkeys(v)))) for p, v in styles.items() if p not in texts]
    return out + [(p, prior[p], 1, path_hash("|".join(v))) for p, v in texts.items()]


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def noise_branches(pages: DataFrame, strength: float = STRENGTH, kappa: float = KAPPA, gamma: float = GAMMA) -> DataFrame:
    """(host, paths): hashes of the paths of the style tree's branches to remove, for each host. Equal pages of a host count once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = page.as_py()
                digest = path_hash(text)
                rows.extend((host, digest, *f) for f in page_features(text))
                if len(rows) > 50_000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["host", "page", "path", "prior", "kind", "value"])

    features = pages.where("html is not null").select(host_of().alias("host"), "html").mapInArrow(released(emit), "host string, page long, path string, prior double, kind int, value long").distinct()
    counts = features.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).cast("double").alias("c"), F.min("prior").alias("prior"))
    nodes = counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"), F.min("prior").alias("prior"))
    own = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    parts = F.split("path", "/")
    at = F.explode(F.sequence(F.lit(2), F.size("parts"))).alias("k")
    spread = nodes.select("host", "m", "prior", own.alias("own"), parts.alias("parts")).select("*", at)
    spread = spread.withColumn("self", F.col("k") == F.size("parts")).withColumn("path", F.concat_ws("/", F.slice("parts", 1, F.col("k"))))
    weight = F.pow(F.lit(gamma), F.size("parts") - F.col("k")) * F.col("m")
    branches = spread.groupBy("host", "path").agg((F.sum(weight * F.col("own")) / F.sum(weight)).alias("importance"), F.sum(F.when(F.col("self"), F.col("m"))).alias("m"), F.min(F.when(F.col("self"), F.col("prior"))).alias("prior"))
    odds = F.col("prior") + F.lit(strength) * (F.col("importance") - 0.5) * F.col("m") / (F.col("m") + kappa)
    low = branches.where(odds < 0).select("host", "path")

    @F.pandas_udf("long")
    def hashed(paths):
        return paths.map(path_hash)

    return low.select("host", hashed("path").alias("path")).groupBy("host").agg(F.collect_list("path").alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """pages (url, html and others) with `text`, the main text, as a further column.

    Null and empty html give empty text. A null url has the empty host; its pages share a tree. White space within a block is
    one space, blocks are joined by one in page order. Equal rows stay; an empty table gives an empty table; an existing column
    text is replaced. Long and deep pages are worked on whole, in time and memory linear in the page.
    """
    bounded_batches(pages.sparkSession)
    noise = materialize(noise_branches(pages), "noise")
    rest = [c for c in pages.columns if c.lower() != "text"]
    bytes_ = (noise.agg(F.sum(F.size("paths"))).first()[0] or 0) * 8
    salted = noise.select(F.col("host").alias("__host"), F.col("paths").alias("__paths"), all_salts("__s"))
    if bytes_ < 2_000_000:
        salted = F.broadcast(salted)
    joined = pages.select(*rest, host_of().alias("__h"), salt_of(*rest).alias("__salt")).join(salted, (F.col("__h") == F.col("__host")) & (F.col("__salt") == F.col("__s")), "left")
    at = next(i for i, c in enumerate(rest) if c.lower() == "html")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", set(p.as_py() or ())) for h, p in zip(batch.column(at), batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(rest))], pa.array(texts, pa.string())], [*rest, "text"])

    return joined.select(*rest, "__paths").mapInArrow(released(emit), pages.select(*rest).schema.add("text", "string"))
