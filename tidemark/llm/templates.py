"""Main text of web pages: what a site repeats on its pages goes, and so does what its markup names as something other than the article.

1. Every page is read into elements by one scanner, linear in the page. An element's digest is made of its name, its text (digits count as one another) and its
   children's digests, so equal subtrees have equal digests; attributes don't enter, since a menu marks the page it stands on.
2. Spark counts, per host, on how many different pages a subtree stands. Pages of one title and first heading count once, so copies of an article make no template.
   A subtree is a template of its host from `least` pages and a share of `share` of the host's pages on.
3. Every page loses its templates, and elements that are no part of an article by name, role or class (menus, footers, sidebars, notices, adverts, forms, reader
   comments). The rest of its article (or of its main element, or else of its body without link lists) is the text, a block a line.

Plain prose in an article (paragraphs, headings, lists, tables, quotes) is never taken for a template: passages that many articles share stay. Where a page marks no
article, prose can be a template too.

Templates of up to `BROADCAST` digests in all are sent to every task as one sorted array; beyond, they are joined by host, with hosts of over a thousandth of all
pages salted. Both ways give the same rows.

Defined results: a null or empty page has an empty text; a page without a host has no templates, only its markup is looked at; a very long page is held whole by its task, with
some hundred bytes for each element; equally long articles: the first one counts; repeated rows are answered each, and count once as pages; an empty table gives no rows; columns besides page_id, url and html are not read.
"""

import functools
import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, release, sliced, table
from .warc import _Page

LEAST, SHARE = 5, 0.005
#: Template digests that are sent to all tasks: 8 MB.
BROADCAST = 1_000_000
#: Parts of a host with over a thousandth of all pages.
SALTS = 64

_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr figure figcaption address hgroup".split())
_BLOCKS = _PROSE | frozenset("html body article aside center details dialog dir div fieldset footer form header hr legend main menu nav search section summary".split())
_CELLS = frozenset(("td", "th"))
#: Everything up to the closing tag is no text of the page, even if that is never found.
_RAW = frozenset("script style noscript template title textarea iframe noembed noframes xmp".split())
#: Likewise, if there is a closing tag.
_ASIDE = frozenset("svg math select button object video audio canvas datalist map".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends the nearest of these, up to one of those.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "article": ({"nav", "header", "footer"}, {"article"}),
    "main": ({"nav", "header", "footer"}, {"article"}),
}
#: How far up that is looked for.
_DEEP = 16

_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'<>]++))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_TAGS = frozenset("nav footer aside form menu dialog search".split())
_ROLES = frozenset("navigation contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adslot sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies respond related recommended widget toolbar pagination "
    "pager hidden copyright disclaimer skip search".split()
)
_HEADS = frozenset(("header", "masthead", "banner"))
#: A class that begins with one of these tells what its element has, not what it is.
_TELLS = frozenset("has no not with without is js".split())

KEEP, HEAD, DROP = 0, 1, 2


@functools.lru_cache(1 << 14)
def _kind(name: str, rest: str) -> tuple[int, bool]:
    """What an element is by its name and attributes, and whether it says that it holds the article."""
    kind, main = DROP if name in _TAGS else HEAD if name == "header" else KEEP, name in ("article", "main")
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "role":
            kind = DROP if value.lower() in _ROLES else max(kind, HEAD) if value.lower() == "banner" else kind
            main = main or value.lower() in ("main", "article")
        elif key == "itemprop":
            main = main or value == "articleBody"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in re.sub(r"\s", "", value.lower()):
            kind = DROP
        elif key in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                if words and words[0] not in _TELLS:
                    kind = DROP if not _NAMES.isdisjoint(words) else max(kind, HEAD) if not _HEADS.isdisjoint(words) else kind
    return (KEEP if name in ("html", "body", "head") else kind), main


class _Element:
    __slots__ = ("name", "kind", "main", "under", "inside", "first", "last", "parts", "digest")

    def __init__(self, name: str, kind: int, main: bool, above: "_Element | None", first: int):
        self.name, self.kind, self.main, self.first, self.parts = name, kind, main, first, []
        self.under = above is not None and (above.under or above.kind != KEEP)  # something that is no article
        self.inside = above is not None and (above.inside or above.main)  # an article


class Tree:
    """The elements of a page in the order of their ends, and its blocks of text with the characters of links among them; an element holds blocks first to last, the latter excluded."""

    def __init__(self, page: str):
        self.elements: list[_Element] = []
        self.blocks: list[str] = []
        self.links: list[int] = []
        self.title = self.heading = ""
        self._stack = [_Element("", KEEP, False, None, 0)]
        self._open: dict[str, int] = {}
        self._pieces: list[str] = []
        self._linked, self._link, self._mute, self._depth = 0, False, "", 0
        self._read(page)

    def _text(self, piece: str) -> None:
        if piece and not self._mute:
            if "&" in piece:
                piece = html.unescape(piece)
            self._pieces.append(piece)
            if self._link:
                self._linked += len(piece)

    def _flush(self) -> None:
        """A block ends here."""
        self._mute = ""
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                top = self._stack[-1]
                self.blocks.append(text)
                self.links.append(self._linked)
                top.parts.append(_DIGITS.sub("0", text).encode("utf-8", "surrogatepass"))
                if top.name == "h1" and not self.heading:
                    self.heading = text
            self._pieces.clear()
            self._linked = 0

    def _pop(self) -> None:
        self._flush()
        node = self._stack.pop()
        self._open[node.name] -= 1
        node.last = len(self.blocks)
        if node.last > node.first:
            node.digest = xxhash.xxh3_64_intdigest(b"\x01".join([node.name.encode("utf-8", "surrogatepass"), *node.parts]))
            self._stack[-1].parts.append(b"\x02" + node.digest.to_bytes(8, "little"))
            self.elements.append(node)
        node.parts = ()

    def _ends(self, name: str) -> None:
        while self._open.get(name):
            last = self._stack[-1].name == name
            self._pop()
            if last:
                break

    def _begin(self, name: str, rest: str) -> None:
        self._flush()
        self._link = False
        self._ends("p")
        if name in _ENDS:
            ends, stop = _ENDS[name]
            for k in range(1, min(len(self._stack), _DEEP + 1)):
                if self._stack[-k].name in ends:
                    for _ in range(k):
                        self._pop()
                    break
                if self._stack[-k].name in stop:
                    break
        if name not in _VOID:
            kind, main = _kind(name, rest)
            self._stack.append(_Element(name, kind, main, self._stack[-1], len(self.blocks)))
            self._open[name] = self._open.get(name, 0) + 1

    def _tag(self, ends: bool, name: str, rest: str) -> None:
        if name == "br":
            self._text(" ")
        elif name in _CELLS:
            self._text(" ")
        elif name in _BLOCKS:
            if not ends:
                self._begin(name, rest)
            elif name not in ("html", "body"):  # what comes after these belongs to the body
                self._flush()
                self._ends(name)
        elif self._mute:
            if name == self._mute:
                self._depth += -1 if ends else 1
                if not self._depth:
                    self._mute = ""
        elif name == "a":
            self._link = not ends
        if not ends and name not in _BLOCKS and name not in _VOID and not self._mute and rest and _kind(name, rest)[0] == DROP:
            self._mute, self._depth = name, 1

    def _read(self, page: str) -> None:
        cursor, at = _Page(page), 0
        while (begin := page.find("<", at)) >= 0:
            self._text(page[at:begin])
            if page.startswith("<!--", begin):
                end = cursor.find("-->", begin + 4)
                at = len(page) if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), begin):
                end = cursor.find(">", begin)
                if end < 0:
                    self._text("<")
                at = begin + 1 if end < 0 else end + 1
                continue
            tag = cursor.tag(begin)
            if tag is None:
                self._text("<")
                at = begin + 1
                continue
            ends, name, rest, at = tag
            if ends or name not in _RAW and name not in _ASIDE:
                self._tag(ends, name, rest)
                continue
            stop, after = cursor.closing(name, at)
            if name == "title" and not self.title:
                self.title = " ".join(html.unescape(page[at:stop]).split())
            if name in _RAW or after > stop:
                at = after
        self._text(page[at:])
        while len(self._stack) > 1:
            self._pop()
        self._flush()

    def candidates(self) -> list[_Element]:
        """Elements that may be templates: all but those that are never removed as such, and those that their markup removes anyway."""
        return [e for e in self.elements if e.name not in ("html", "body") and not e.main and not (e.inside and e.name in _PROSE)]

    def article(self) -> _Element | None:
        """The marked article with the most text; a main element if it has more than twice as much."""
        marked = [e for e in self.elements if e.main]
        marked = [e for e in marked if e.kind == KEEP and not e.under] or [e for e in marked if e.kind != DROP]
        sizes = np.cumsum([0, *map(len, self.blocks)])
        best = None
        for article in (True, False):
            for e in sorted((e for e in marked if (e.name == "article") == article), key=lambda e: e.first):
                size = sizes[e.last] - sizes[e.first]
                if best is None or size > best[0] * (1 if article or best[1].name != "article" else 2):
                    best = size, e
        return best and best[1]

    def text(self, templates: set[int]) -> str:
        """The main text. templates: digests of its host's templates."""
        root = self.article()
        first, last = (root.first, root.last) if root else (0, len(self.blocks))
        gone, around = [False] * len(self.blocks), False
        for e in self.elements:
            around = around or e is root  # an element that ends later and holds its blocks is around it
            if around and e.first <= first and e.last >= last or e.name in ("html", "body") or e.first >= last or e.last <= first:
                continue
            if e.kind == DROP or e.kind == HEAD and root is None or e.digest in templates and not (e.main or root and e.name in _PROSE):
                gone[e.first : e.last] = [True] * (e.last - e.first)
        if root is None:
            gone = [g or 2 * n > len(b) for g, n, b in zip(gone, self.links, self.blocks, strict=True)]
        return "\n".join(b for b, g in zip(self.blocks[first:last], gone[first:last], strict=True) if not g)


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


_MIX = 0x9E3779B97F4A7C15


def _keys(host: int, digests) -> np.ndarray:
    """One number for each of a host's digests."""
    with np.errstate(over="ignore"):
        x = (np.array(digests, np.uint64) ^ np.uint64(host & (1 << 64) - 1)) * np.uint64(_MIX)
        x ^= x >> np.uint64(29)
        return (x * np.uint64(_MIX)).view(np.int64)


def _shapes(hosts: pa.Array, pages: pa.Array) -> pa.Array:
    """Of each page a number for its title and heading, and keys of its different subtrees. Of a page without a host none."""
    contexts, lists, at = [], [], 0
    for part in sliced([pages]):
        for page in part:
            host = hosts[at].as_py()
            at += 1
            tree = Tree(page.as_py() or "") if host is not None else None
            told = tree and (f"{tree.title}\n{tree.heading}" if tree.title or tree.heading else "\n".join(tree.blocks))
            contexts.append(xxhash.xxh3_64_intdigest((told or "").encode("utf-8", "surrogatepass")))
            found = sorted({e.digest for e in tree.candidates()}) if tree else ()
            lists.append(_keys(host, found) if len(found) else np.empty(0, np.int64))
    release()
    offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    keys = pa.ListArray.from_arrays(offsets, np.concatenate(lists) if lists else np.empty(0, np.int64))
    return pa.StructArray.from_arrays([pa.array(_signed(contexts)), keys], names=["context", "keys"])


_SHAPE = "context long, keys array<long>"


def _with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html, and a 64-bit hash of the host; null without one."""
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.when(host != "", F.xxhash64(host)).alias("host"))


def site_templates(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """host, pages (how many different ones it has), key (of a subtree that `least` of them and a `share` of them have at least)."""
    shapes = _with_host(pages).where("host is not null").select("host", F.arrow_udf(_shapes, _SHAPE)("host", "html").alias("shape")).select("host", "shape.*")
    # each page counts with its keys, and once by itself under key null
    rows = shapes.select("host", "context", F.explode(F.concat(F.array(F.lit(None).cast("long")), "keys")).alias("key"))
    counts = materialise(rows.distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("key").isNull() | (F.col("n") >= least)))
    hosts = counts.where("key is null").select("host", F.col("n").alias("pages"))
    return counts.where("key is not null").join(hosts, "host").where(F.col("n") >= share * F.col("pages")).select("host", "pages", "key")


def _answer(hosts: pa.Array, pages: pa.Array, known) -> pa.Array:
    """The texts. known: of a row's number and the keys of its elements, which are templates."""
    out, at = [], 0
    for part in sliced([pages]):
        for page in part:
            tree, host = Tree(page.as_py() or ""), hosts[at].as_py()
            found = [e.digest for e in tree.candidates()] if host is not None else []
            templates = {d for d, k in zip(found, known(at, _keys(host, found)), strict=True) if k} if found else set()
            out.append(tree.text(templates).encode("utf-8", "replace").decode())
            at += 1
    release()
    return pa.array(out, pa.string())


def main_text(pages: DataFrame, least: int = LEAST, share: float = SHARE, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url and text for every row of pages. broadcast: digests of templates up to which they are sent to all tasks."""
    templates = materialise(site_templates(pages, least, share))
    rows = _with_host(pages)
    if templates.count() <= broadcast:
        keys = np.sort(np.array([r.key for r in templates.select("key").collect()], np.int64))
        sent = pages.sparkSession.sparkContext.broadcast(keys)

        def run(hosts: pa.Array, texts: pa.Array) -> pa.Array:
            keys = sent.value

            def known(_, found):
                at = np.searchsorted(keys, found)
                return keys[np.minimum(at, len(keys) - 1)] == found if len(keys) else np.zeros(len(found), bool)

            return _answer(hosts, texts, known)

        return rows.select("page_id", "url", F.arrow_udf(run, "string")("host", "html").alias("text"))

    def joined(hosts: pa.Array, texts: pa.Array, keys: pa.Array) -> pa.Array:
        return _answer(hosts, texts, lambda at, found: np.isin(found, keys[at].values.to_numpy(zero_copy_only=False) if keys[at].is_valid else ()))

    total = templates.select("host", "pages").distinct()
    least_pages = (total.agg(F.sum("pages")).first()[0] or 0) / 1000
    hot = F.broadcast(total.where(F.col("pages") > least_pages).select("host", F.lit(SALTS).alias("salts")))  # a thousand rows at most
    lists = templates.groupBy("host").agg(F.collect_list("key").alias("keys")).join(hot, "host", "left")
    lists = lists.select("host", "keys", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    salted = rows.withColumn("place", F.monotonically_increasing_id()).join(hot, "host", "left")
    salted = salted.withColumn("salt", F.pmod(F.col("place"), F.coalesce("salts", F.lit(1))).cast("int")).drop("place", "salts")
    return salted.join(lists, ["host", "salt"], "left").select("page_id", "url", F.arrow_udf(joined, "string")("host", "html", "keys").alias("text"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
