"""Main text of web pages by site style trees.

All distinct pages of a host (copies tell nothing of its layout and count once) are merged into one tree: elements with the
same path of tags, classes and ids are one node. A node that m pages have gets two entropies, to the base m: that of its presentations (the row of its child elements) over the pages, and
that of its contents, where a content that n pages share counts log n. A node in which all pages look and read alike scores 0,
one that always differs scores 1; the composite is (1 - g^l) * presentation + g^l * content, l being its depth below. Branches
below THRESHOLD are removed from each page. With fewer than MIN_PAGES distinct pages a host tells nothing about a node.

What no statistics of a site can tell (navigation, adverts and comments that differ on every page look as important as the
article) is decided by what elements are: scripts, styles, forms, navigation, asides, comments, adverts and the like, by tag,
role, class or id (fixed lists below; lists=False leaves all but scripts, styles and the like to the statistics). A class or
id counts if all its parts are names of noise or of mere containers: share-box does, social-science doesn't. If a page has an
article or main element, its text is what that holds; inside it only branches marked by a class, id or role are open to the
statistics, as the repeated paragraphs of an article are text.

Defined cases: a null html is empty and gives the empty text; a null url belongs to the host ""; unclosed and stray tags are
tolerated, and what begins like a tag but never ends is text; br is white space; table cells are blocks; repeated rows are
each returned; pages are read in time linear in their length, however long or deep; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Container, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import accumulate
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm._shared import cut

GAMMA, THRESHOLD, MIN_PAGES = 0.9, 0.3, 5
#: A table of noise nodes of up to so many entries (8 bytes each) is broadcast; a larger one is joined by host.
BROADCAST_NODES = 100_000

# HTML element names by their role, and names that mark what isn't main text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption".split())
NOISE_TAGS = set("nav footer aside form button select option datalist dialog menu svg canvas object audio video map head".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NOISE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "header masthead topbar footer footnav sidebar aside widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies disqus discussion form search searchbox pagination pager paging "
    "toolbar copyright colophon outbrain taboola".split()
)
#: Parts of a class or id that say nothing beside a name of noise.
CONTAINER_NAMES = set("box bar wrap wrapper container section block area list links link item items site main page top bottom left right inner outer primary secondary global post posts articles buttons button icons slot unit row column col panel module region group".split())
#: On an article element only these names mean noise: teasers and comments are often marked up as articles.
NOISE_ARTICLES = {"comment", "comments", "reply", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "related", "teaser"}
#: Tags that an opening tag closes, if they are the innermost.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "p"}}

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]+)*+)>")
#: For what follows a quote that never ends: a tag goes up to the next >.
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_TAG_BEGINS = re.compile(r"</?[A-Za-z]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z]+|[0-9]+")


def node_key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), signed=True)


@lru_cache(1 << 16)
def _path(parent: int, label: str) -> int:
    return node_key(f"{parent}>{label}")


@lru_cache(1 << 14)
def _names_noise(label: str, article: bool) -> bool:
    """Whether one of the classes and ids is a name of noise, alone or with names of containers and numbers."""
    known = NOISE_ARTICLES if article else NOISE_NAMES
    for token in label.split():
        parts = _NAMES.findall(token)
        if any(p in known for p in parts) and all(p in known or p in CONTAINER_NAMES or p.isdigit() for p in parts):
            return True
    return False


class Element:
    """path names the chain of tags, classes and ids from the root; low and high are the first and the next text that it holds."""

    __slots__ = ("tag", "marked", "noise", "main", "article", "parent", "path", "children", "depth", "low", "high", "holds")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.parent, self.children, self.depth, self.low, self.high, self.holds = tag, parent, [], 0, 1 << 60, 0, False
        label, role = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower(), attributes.get("role")
        self.marked = bool(label.strip() or role)
        self.path = _path(parent.path if parent else 0, tag + "." + ".".join(sorted(label.split())) if self.marked else tag)
        inside = parent is not None and parent.article
        self.main = tag in ("article", "main") or role in ("main", "article")
        self.article = inside or self.main
        if tag in ("html", "body", "main"):
            self.noise = False
        else:
            self.noise = _names_noise(label, tag == "article") or tag != "article" and (tag in NOISE_TAGS or (tag == "header" and not inside) or role in NOISE_ROLES)
        self.noise |= "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")


def _tokens(html: str) -> Iterator[str | tuple[str, str, str]]:
    """Texts, and tags as (slash or nothing, name, attributes). What is inside raw elements is left out. Every character is looked at a fixed number of times."""
    at, strict = 0, True
    while at < len(html):
        if html[at] != "<":
            stop = html.find("<", at)
            stop = len(html) if stop < 0 else stop
            yield html[at:stop]
            at = stop
        elif html.startswith("<!--", at):
            stop = html.find("-->", at)
            at = len(html) if stop < 0 else stop + 3
        elif html.startswith(("<!", "<?"), at):
            stop = html.find(">", at)
            at = len(html) if stop < 0 else stop + 1
        elif not _TAG_BEGINS.match(html, at):
            yield "<"
            at += 1
        else:
            m = _TAG.match(html, at) if strict else None
            if m is None:
                strict, m = False, _LOOSE_TAG.match(html, at)
            if m is None:
                yield html[at:]
                return
            at, tag = m.end(), m[2].lower()
            if tag in RAW and not m[1]:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                stop = html.find(">", end.end()) if end else -1
                at = len(html) if stop < 0 else stop + 1
            else:
                yield m[1], tag, m[3]


def parse(html: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """The block elements in page order, and the texts in page order: element, text, number of the block."""
    root = Element("", {}, None)
    top, elements, texts, block = root, [], [], 0
    unclosed: Counter = Counter()
    for token in _tokens(html):
        if isinstance(token, str):
            texts.append((top, token, block))
            continue
        slash, tag, rest = token
        if slash:
            if tag in INLINE or tag in VOID:
                if tag == "br":
                    texts.append((top, " ", block))
                elif top.tag == tag:
                    unclosed[tag] -= 1
                    top = top.parent
                continue
            if unclosed[tag]:
                while top.tag != tag:
                    unclosed[top.tag] -= 1
                    top = top.parent
                unclosed[tag] -= 1
                top = top.parent
            block += 1
            continue
        if tag in VOID:
            texts.append((top, " ", block))
            block += tag == "hr"
            continue
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest.strip() else {}
        if tag in INLINE:
            # An inline element is a branch only where it is marked as noise, or lies in one of its kind.
            if rest.rstrip().endswith("/") or not (top.tag == tag or (attributes and Element(tag, attributes, top).noise)):
                continue
        else:
            block += 1
            closes = CLOSES.get(tag, {"p"})
            while top.tag in closes:
                unclosed[top.tag] -= 1
                top = top.parent
        node = Element(tag, attributes, top)
        top.children.append(node)
        elements.append(node)
        if tag in INLINE or not rest.rstrip().endswith("/"):
            unclosed[tag] += 1
            top = node
    for k, (e, text, _) in enumerate(texts):
        e.low, e.high = min(e.low, k), k + 1
    said = sum(len(text) for _, text, _ in texts)
    upto = [0, *accumulate(len(text) for _, text, _ in texts)]
    for e in reversed(elements):
        up = e.parent
        up.depth, up.low, up.high = max(up.depth, e.depth + 1), min(up.low, e.low), max(up.high, e.high)
        up.holds |= e.holds or (e.main and not e.noise)
    for e in elements:
        # What holds the article is no noise, whatever it is called, nor a form that is wrapped around most of the page.
        if e.holds and (e.tag not in NOISE_TAGS or e.tag == "form") or e.tag == "form" and e.high and 2 * (upto[e.high] - upto[e.low]) > said:
            e.noise = False
    return elements, texts


def _contents(texts: list[tuple[Element, str, int]], of: list[Element]) -> Callable[[Element], int]:
    """For one of these elements a number that is equal where the words that it holds are. Only texts inside them are read."""
    prime, base = (1 << 61) - 1, 1_000_003
    sums, counts, change = [0], [0], [0] * (len(texts) + 1)
    for e in of:
        if e.high:
            change[e.low] += 1
            change[e.high] -= 1
    for (_, text, _), inside in zip(texts, accumulate(change)):
        value, words = sums[-1], text.split() if inside else ()
        for word in words:
            value = (value * base + (crc32(word.encode("utf-8", "replace")) << 8) + len(word)) % prime
        sums.append(value)
        counts.append(counts[-1] + len(words))
    return lambda e: (sums[e.high] - sums[e.low] * pow(base, counts[e.high] - counts[e.low], prime)) % prime if e.high else 0


def branches(elements: list[Element]) -> Iterator[Element]:
    """The elements that statistics may remove."""
    for e in elements:
        if e.tag in ("html", "body", "head") or e.holds or (e.article and not (e.parent.article and e.marked and e.tag not in TEXT_BLOCKS)):
            continue
        yield e


def main_text(html: str, noise: Container[int], lists: bool = True) -> str:
    """The page's text without the branches in noise and (with lists) those that are noise by what they are."""
    elements, texts = parse(html)
    open_to = {id(e) for e in branches(elements)}
    dropped: dict[int, bool] = {}
    for e in elements:  # parents come first
        dropped[id(e)] = dropped.get(id(e.parent), False) or (lists and e.noise) or e.tag == "head" or (id(e) in open_to and e.path in noise)
    only = lists and any(e.article and not dropped[id(e)] for e in elements)
    out: list[list[str]] = []
    last = -1
    for e, text, block in texts:
        if dropped.get(id(e), False) or (only and not e.article):
            continue
        if block != last:
            out.append([])
            last = block
        out[-1].append(text)
    lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in out)
    return "\n".join(x for x in lines if x)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and each distinct (node, look, says) in it one row, the same for every copy of the page."""
    names = ["host", "digest", "node", "look", "says", "depth", "first", "n"]
    types = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        pages = dict(zip(zip(batch.column("host").to_pylist(), batch.column("digest").to_pylist(), strict=True), batch.column("html").to_pylist(), strict=True))
        for (host, digest), html in pages.items():
            elements, texts = parse(html)
            own = list(branches(elements))
            says_of = _contents(texts, own)
            seen = set()
            found: dict[tuple, list[int]] = {}
            for e in own:
                look = node_key(">".join(map(str, dict.fromkeys(c.path for c in e.children))))
                row = found.setdefault((e.path, look, says_of(e)), [0, 0, 0])
                row[0], row[1], row[2] = max(row[0], e.depth), row[1] + (e.path not in seen), row[2] + 1
                seen.add(e.path)
            for key, row in found.items():
                for column, value in zip(columns, (host, digest, *key, *row), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def node_importance(pages: DataFrame) -> DataFrame:
    """host, node, pages (distinct ones that have it) and importance of every branch that a host's pages have.

    Copies are told by host and SHA-256 of the html, a null one being empty; they make equal rows, of which one is kept.
    Presentations and contents are counted over the distinct pages with partial sums, so a host with a third of all pages sends a row
    for each distinct value and task.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha2("html", 256)))
    seen = rows.mapInArrow(_observed, "host string, digest binary, node long, look long, says long, depth int, first long, n long").distinct()
    both = seen.select("host", "node", "depth", "first", "n", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("look").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("says").alias("value")))).alias("v"))
    counts = both.groupBy("host", "node", "v.kind", "v.value").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), F.max("depth").alias("depth"))
    part = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    n, log_n = F.col("n"), F.log(F.col("n"))
    sums = counts.groupBy("host", "node").agg(
        part(0, n).alias("total"), part(0, F.col("first")).alias("pages"), part(0, n * log_n).alias("looks"), part(1, n * log_n).alias("contents"), F.max("depth").alias("depth"),
    )
    base = F.log(F.col("total"))
    presentation = 1 - F.col("looks") / F.col("total") / base  # the entropy of shares n / total, to the base total
    content = 1 - F.col("contents") / F.col("total") / base
    weight = F.pow(F.lit(GAMMA), F.col("depth"))
    importance = F.when(F.col("pages") < MIN_PAGES, 1.0).otherwise((1 - weight) * presentation + weight * content)
    return sums.select("host", "node", "pages", importance.alias("importance"))


def extract(pages: DataFrame, lists: bool = True) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages (page_id, url, html)."""
    noise = cut(node_importance(pages).where(F.col("importance") < THRESHOLD).groupBy("host").agg(F.collect_list("node").alias("noise")))
    size = noise.agg(F.coalesce(F.sum(F.size("noise")), F.lit(0)).alias("n")).first().n
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_of"))
    shared = None
    if size <= BROADCAST_NODES:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.noise) for r in noise.collect()})
        rows = rows.withColumn("noise", F.lit(None).cast("array<long>"))
    else:
        rows = rows.join(noise.withColumnRenamed("host", "_host"), F.col("_of") == F.col("_host"), "left")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, frozenset())
        for batch in batches:
            texts = []
            for k, (host, html) in enumerate(zip(batch.column("_of").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                if host != last[0]:
                    last = (host, shared.value.get(host, frozenset()) if shared else frozenset(batch.column("noise")[k].as_py() or ()))
                texts.append(main_text(html or "", last[1], lists))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "_of", "noise").mapInArrow(take, "page_id long, url string, text string, n_chars long")
