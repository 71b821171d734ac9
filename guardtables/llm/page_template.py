"""Main text of pages by deducing each host's template from equivalence classes of its tokens.

Tokens are opening tags, told apart by the path of tags above them, so that equal tags in different places
are different tokens. Over the pages of one host:

1. A token's occurrence vector says how often each page holds it. Tokens with equal vectors form an equivalence
   class; vectors are compared by a commutative hash over (page, count), so no vector is ever collected.
2. A class is valid when at least a share ``SUPPORT`` of the host's pages hold it; its tokens are then part of the
   template. Classes nest as the paths of their tokens do: a class lies in the slot of the closest token above it. A
   class bounds text only on pages that hold all of it.
3. What pages hold between template tokens is the content of slots: a slot has all text down to the next template
   tokens, also that in tokens of no valid class. Slots in template tokens that stand for menus,
   headers, footers, sidebars, notices, adverts, forms or comments are not main text, by the tag's name or the words
   of its class, id or role. Of the rest the article's slots are taken: on a page that holds an article or main token of
   the host's template, those below it and below other article or main elements of the page; on any other page, those
   below an article or main token of its own and those whose text is not mostly links.

Tokens of single pages that are in no valid class are read as part of the slot they stand in, so nothing that only one
page has is lost.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import tidy

SUPPORT = 0.5
# Share of a slot's characters inside links from which it counts as a menu.
LINKS = 0.5
# Templates are sent to every task up to so many bytes in all; beyond that they meet the pages by a join.
TEMPLATE_BYTES = 16 << 20

# Elements without an end; elements whose content is no text; elements that are part of a line of text; fixed by HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template svg iframe object math textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
# Elements that end an open element of the same kind, or a paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main"
    " menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("table ul ol dl div article section main aside nav header footer form body html td th select".split())
# Elements and words of class, id or role that stand for something other than the main text.
ASIDE = frozenset("nav header footer aside form button select dialog menu head figure-menu".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion popup modal overlay cookie cookies"
    " consent notice notices alert gdpr nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail widget"
    " header masthead topbar footer copyright comment comments respond reply replies discussion disqus share sharing social"
    " related recommended newsletter subscribe signup login search pagination pager toolbar complementary contentinfo".split()
)
MAIN = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article main content post entry story".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")


def label(name: str, attrs: str) -> str:
    """A tag for a path: its name and, after a dot, the words of its class, id and role."""
    if "=" not in attrs:
        return name
    found = " ".join("".join(m) for m in ATTRIBUTE.findall(attrs)).lower()
    words = sorted(set(WORDS.findall(found)))
    return f"{name}.{'.'.join(words)}" if words else name


def pieces(page: str) -> Iterator[tuple[str, str, bool]]:
    """Opening tags and texts of a page in order: the path of open elements, the text ("" for a tag), and whether in a link.

    Elements are closed as HTML closes them where an end tag is missing: paragraphs by blocks, list items and table
    cells by the next one. Tags inside a line of text are no part of the path. End tags without a start are passed over.
    """
    stack: list[tuple[str, str]] = []  # name and path
    links, at, end = 0, 0, len(page)

    def path() -> str:
        return stack[-1][1] if stack else ""

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            yield path(), page[at : m.start()], links > 0
        at = m.end()
        if not m["name"]:
            if m[0].startswith("<![CDATA["):
                yield path(), m[0][9:].removesuffix("]]>"), links > 0
            continue
        name = m["name"].lower()
        if m["close"]:
            if name == "a":
                links = max(0, links - 1)
            elif name not in INLINE and any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in INLINE:
            links += name == "a" and not m["attrs"].endswith("/")
            if name == "br":
                yield path(), " ", links > 0
            continue
        closing = {"p"} if name in ENDS_PARAGRAPH else set()
        closing |= SIBLINGS.get(name, set())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in closing:
                del stack[i:]
                break
            if stack[i][0] in SCOPE:
                break
        here = f"{path()}>{label(name, m['attrs'])}"
        yield here, "", False
        if name in OPAQUE:
            close = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else (end if name in ("script", "style") else at)
        elif name not in VOID and not m["attrs"].endswith("/"):
            stack.append((name, here))
    if at < end:
        yield path(), page[at:], links > 0


def host_of(url: str | None) -> str:
    """The host of an address in lower case; everything without one is one host of its own, ""."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


# --- occurrence vectors -------------------------------------------------------------------------------------------

COUNTS = "host string, token string, pages long, total long, vector long, chars long, linked long, place double"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token what the batch's pages add to its vector; the empty token stands for the page itself."""
    for batch in batches:
        total: dict[tuple[str, str], list] = {}
        columns = [batch.column(n).to_pylist() for n in ("key", "url", "html")]
        for key, url, page in zip(*columns, strict=True):
            host = host_of(url)
            own: dict[str, list] = {"": [1, 0, 0, 0]}
            for place, (path, text, linked) in enumerate(pieces(page or "")):
                held = own.setdefault(path, [0, 0, 0, place])
                if text:
                    chars = len(text) - text.count(" ")
                    held[1] += chars
                    held[2] += chars if linked else 0
                else:
                    held[0] += 1
            for path, (n, chars, linked, place) in own.items():
                held = total.setdefault((host, path), [0, 0, 0, 0, 0, 0.0])
                held[0] += 1
                held[1] += n
                held[2] ^= xxhash.xxh3_64_intdigest(b"%d %d" % (key, n)) - (1 << 63)
                held[3] += chars
                held[4] += linked
                held[5] += place
        keys, rows = list(total), list(total.values())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5)), pa.array([r[5] for r in rows], pa.float64()),
            ],
            ["host", "token", "pages", "total", "vector", "chars", "linked", "place"],
        )


def _vectors(pages: DataFrame) -> DataFrame:
    """Occurrence vectors of all tokens of each host; written once, as classes and slots read them."""
    return cut(pages.mapInArrow(tidy(_counts), COUNTS).groupBy("host", "token").agg(
        *[F.sum(c).alias(c) for c in ("pages", "total", "chars", "linked", "place")], F.bit_xor("vector").alias("vector")
    ))


def _valid(counted: DataFrame, support: float) -> DataFrame:
    hosts = counted.where("token = ''").select("host", F.col("pages").alias("all_pages"))
    valid = counted.where("token <> ''").join(hosts, "host").where(F.col("pages") >= support * F.col("all_pages"))
    # Equal vectors have equal hashes and equal numbers of pages and tokens.
    return valid.select(
        "host", "token", F.xxhash64("vector", "pages", "total").alias("class"), "pages", "total", "chars", "linked",
        (F.col("place") / F.col("pages")).alias("place"),
    )


def classes(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Tokens of valid equivalence classes: ``host``, ``token``, ``class`` (the vector's hash), ``pages``, ``total``,
    ``chars``, ``linked`` and ``place`` (mean position).

    ``pages`` has ``key`` (a number for each row), ``url`` and ``html``. Counts are added up in the tasks
    before the shuffle, so a host with a third of all pages is no larger group than others.
    """
    return _valid(_vectors(pages), support)


def _slots(counted: DataFrame, valid: DataFrame) -> DataFrame:
    """Text below each template token that stands in tokens of no valid class: ``host``, ``token``, ``chars_below``, ``linked_below``."""
    rest = counted.where("token <> '' and chars > 0").join(valid.select("host", "token"), ["host", "token"], "left_anti")
    tags = F.split("token", ">")
    above = rest.select("host", F.col("token").alias("own"), "chars", "linked", tags.alias("tags")).select(
        "host", "own", "chars", "linked", "tags", F.explode(F.sequence(F.lit(1), F.size("tags") - 1)).alias("depth")
    ).withColumn("token", F.array_join(F.slice("tags", 1, F.col("depth")), ">"))
    closest = above.join(valid.select("host", "token"), ["host", "token"]).groupBy("host", "own").agg(
        F.max_by("token", "depth").alias("token"), F.first("chars").alias("chars"), F.first("linked").alias("linked")
    )
    return closest.groupBy("host", "token").agg(F.sum("chars").alias("chars_below"), F.sum("linked").alias("linked_below"))


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The template of each host: ``host`` and ``tokens`` in order, each with its class, and the text and links of its slot.

    A template holds at most (tokens of a page) / support tokens, however many pages the host has.
    """
    counted = _vectors(pages)
    valid = _valid(counted, support)
    whole = valid.join(_slots(counted, valid), ["host", "token"], "left").withColumns(
        {c: F.col(c) + F.coalesce(f"{c}_below", F.lit(0)) for c in ("chars", "linked")}
    )
    return whole.groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("place", "token", "class", "total", "chars", "linked"))).alias("tokens")
    )


# --- slots --------------------------------------------------------------------------------------------------------


def _aside(tag: str) -> bool:
    name, *words = tag.split(".")
    return name in ASIDE or not ASIDE_WORDS.isdisjoint(words)


def _main(tag: str) -> bool:
    name, *words = tag.split(".")
    return name in MAIN or not MAIN_WORDS.isdisjoint(words)


class Slots:
    """Which paths hold main text, by the template of a host."""

    def __init__(self, tokens: list[dict]):
        self.template = {t["token"]: t for t in tokens}
        self.members: dict[int, set[str]] = {}
        for t in tokens:
            self.members.setdefault(t["class"], set()).add(t["token"])
        self.roots = [t for t in self.template if self._open(t) and _main(t.rpartition(">")[2])]
        # The classes nest by their paths: of the article's tokens the outermost ones bound the main text.
        self.roots = [t for t in self.roots if not any(t.startswith(r + ">") for r in self.roots)]
        self.known: dict[tuple[str, tuple[str, ...]], bool] = {}

    @staticmethod
    def _open(path: str) -> bool:
        """No element of the path stands for something other than the main text."""
        # Inside an article a header is the article's own.
        inside = False
        for tag in path.split(">")[1:]:
            if _aside(tag) and not (inside and not _aside(tag.replace("header", "own"))):
                return False
            inside |= tag.split(".")[0] in MAIN
        return True

    def roots_on(self, paths: set[str]) -> tuple[str, ...]:
        """The tokens that bound the main text of a page with these tokens; none where it holds no root's class of the host."""
        found = {r for r in self.roots if r in paths and self.members[self.template[r]["class"]] <= paths}
        if found:  # articles beside it are main text too, under whatever names their class has
            found |= {p for p in paths if p.rpartition(">")[2].split(".")[0] in MAIN and self._open(p)}
        return tuple(sorted(found))

    def holds(self, path: str, roots: tuple[str, ...]) -> bool:
        if (path, roots) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[path, roots] = self._open(path) and self._inside(path, roots)
        return self.known[path, roots]

    def _inside(self, path: str, roots: tuple[str, ...]) -> bool:
        if roots:
            return any(path == r or path.startswith(r + ">") for r in roots)
        tags = path.split(">")
        if any(_main(tag) for tag in tags):  # an article that few of the host's pages have
            return True
        # Beside an article, or without one: the closest template token above the text is its slot.
        while path and path not in self.template:
            path = path.rpartition(">")[0]
        slot = self.template.get(path)
        return slot is None or not slot["chars"] or slot["linked"] < LINKS * slot["chars"]


def main_text(page: str, slots: Slots) -> str:
    """Blocks of the page's main slots: references decoded, white space one blank, two line ends between blocks."""
    blocks, part, above = [], [], None
    read = list(pieces(page))
    roots = slots.roots_on({path for path, text, _ in read if not text})
    for path, text, _ in read:
        if not text and path.rpartition(">")[2].partition(".")[0] in OPAQUE:
            continue  # no text, and no end of the block around it
        if path != above or not text:  # another slot, or a new element
            blocks.append("".join(part))
            part, above = [], path
        if text and slots.holds(path, roots):
            part.append(text)
    blocks.append("".join(part))
    lines = (" ".join(html.unescape(b).split()) for b in blocks if b)
    return "\n\n".join(x for x in lines if x)


def _extract(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Slots] = {}
        for batch in batches:
            urls, pages = batch.column("url").to_pylist(), batch.column("html").to_pylist()
            given = batch.column("tokens").to_pylist() if sent is None else None
            found = []
            for i, (url, page) in enumerate(zip(urls, pages, strict=True)):
                host = host_of(url)
                if host not in kept:
                    if len(kept) > 10_000:
                        kept.clear()
                    kept[host] = Slots((given[i] if sent is None else sent.value.get(host)) or [])
                found.append(main_text(page or "", kept[host]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], ["row", "main_text"])

    return run


def extract(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Main text of each page: ``row`` (all columns of ``pages`` but the html) and ``main_text``.

    ``pages`` has ``page_id``, ``url`` and ``html``. A null or empty html, and a page without main text, give
    the empty text. Pages without a host in their address share one template. Rows that repeat a
    ``page_id`` are pages of their own; of equal rows an even number leaves no trace in the occurrence vectors
    of the host, which can only split classes, never the text. Templates are bounded for each host; they are
    sent to the tasks while all of them fit ``TEMPLATE_BYTES``, and joined by host beyond that.
    """
    rows = pages.select(
        F.struct(*[c for c in pages.columns if c != "html"]).alias("row"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), F.xxhash64("page_id", "url").alias("key"),
    )
    found = cut(templates(rows.select("key", "url", "html"), support))
    schema = T.StructType([rows.schema["row"], T.StructField("main_text", T.StringType())])
    size = found.select(F.sum(F.aggregate("tokens", F.lit(0), lambda n, t: n + F.length(t["token"]) + 60))).first()[0]
    if (size or 0) <= TEMPLATE_BYTES:
        held = {r.host: [t.asDict() for t in r.tokens] for r in found.collect()}
        sent = pages.sparkSession.sparkContext.broadcast(held)
        return rows.select("row", "url", "html").mapInArrow(tidy(_extract(sent)), schema)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = rows.withColumn("host", host).join(found, "host", "left")
    return joined.select("row", "url", "html", "tokens").mapInArrow(tidy(_extract(None)), schema)
