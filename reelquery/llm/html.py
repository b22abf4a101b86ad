"""Main text of web pages by site template removal.

Every page is parsed once into blocks of text and block elements, and each element's subtree gets a hash of
its tag, class, text and children. Spark counts, per host, on how many different pages a subtree stands
(copies of one page count once); what recurs on many of them is the site's template, and it is deleted on
each page of that host. The pages that a subtree stands on must differ in what they tell, by their longest
blocks: the paragraphs of an article that was copied with small changes recur with the rest of it, a menu doesn't.

Marks only refine this: elements that are named as something else than content, by tag, role or class, go as
well. A page whose marked article holds the larger part of what is left is read there only; in an
article a subtree must recur on half of the host's pages to go, and only containers go by name, if the
whole name says so.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import hinted, staged, table

#: A subtree recurs if it stands on so many different pages of its host; on a host of fewer than ``MANY / SHARE`` pages,
#: on that share of them; but on no fewer than ``LEAST``, since one or two pages tell no template from a story.
MANY, SHARE, LEAST = 10, 0.05, 4
#: In an article: on that share of the host's pages; articles share passages with many others, and keep them.
SHARE_IN_ARTICLE = 0.5
#: Of the pages that a subtree stands on, the share that must differ in one of their so many longest blocks.
DIFFER, LONGEST = 0.5, 5
BROADCAST_ROWS = 500_000

# Possessive, so that no cut or hostile tag is tried in more than one way.
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
# The following are fixed values: element names and what they mean in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"})}
SCOPE = frozenset("html table td th caption template object".split())
NOT_CONTENT = frozenset("head script style title textarea xmp iframe noembed noframes noscript template nav aside footer form button select input fieldset dialog svg math canvas object embed applet audio video menu datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset("ad ads adsense advert advertisement adverts advertising sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav footer comment comments disqus replies respond cookie cookies consent gdpr notice banner popup modal overlay newsletter subscribe signup login share sharing social related recommended widget pagination pager skip masthead toolbar".split())
#: Names of layout that may stand beside one of the names above without changing what it says.
LAYOUT = frozenset("site page main primary secondary global left right top bottom upper lower inner outer header foot bar box block list item items area section unit slot text form links link posts post group zone col column nav".split())
#: A class that ends so tells how a page is laid out around such a part, not that it is one.
FRAMES = frozenset("wrap wrapper container layout page body content main".split())
ARTICLES = frozenset(("main", "article"))
#: What an element marked as an article may be instead.
NO_ARTICLE = frozenset("comment comments reply replies related recommended".split())
#: What may go by its name inside an article; headings, paragraphs and cells are the text's own.
CONTAINERS = frozenset("div section ul ol dl table details figure".split())
WORDS = re.compile(r"[a-z]+")


def host() -> Column:
    """Host of the column url, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Node:
    __slots__ = ("tag", "drop", "inside", "kind", "parts", "first", "any")

    def __init__(self, tag: str, drop: bool, inside: bool, kind: str, first: int):
        self.tag, self.drop, self.inside, self.kind, self.first = tag, drop, inside, kind, first
        self.parts: list[bytes] = []  # of the hash: own text and children's hashes
        self.any = False  # whether there is text


def _named_off(tag: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether tag or attributes say that this isn't content; and the class, for the hash."""
    if tag in NOT_CONTENT or tag == "header" and not inside:
        return True, ""
    if "=" not in attributes and "hidden" not in attributes:
        return False, ""
    found = {a.lower(): entities.unescape(b or c or d) for a, b, c, d in ATTRIBUTE.findall(attributes)}
    kind = found.get("class", "")
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*+:\s*+none", found.get("style", "")):
        return True, kind
    if found.get("role", "").lower() in ROLES:
        return True, kind
    names = f"{kind} {found.get('id', '')}".lower().split()
    if tag in ("html", "body", "main"):
        return False, kind
    if tag == "article":
        return found.get("itemprop") == "comment" or not NO_ARTICLE.isdisjoint(names), kind
    for name in names:
        if inside:
            if tag in CONTAINERS and name in NAMES:
                return True, kind
            continue
        parts = WORDS.findall(name)
        if parts and parts[-1] not in FRAMES and NAMES.union(LAYOUT).issuperset(parts) and (not NAMES.isdisjoint(parts) or "header" in parts):
            return True, kind
    return False, kind


class Page:
    """The blocks of a page, (text, in an article), and its block elements with text: the hash of each one's
    subtree, whether it lies in an article, and from which block to which it reaches. Each step is
    linear in the page's length. Without ``marks`` only scripts and the like are known as no content."""

    def __init__(self, html: str, digest: Callable[[bytes], int], marks: bool = True):
        self.digest, self.marks = digest, marks
        self.subtrees: list[tuple[int, bool, int, int]] = []
        self.blocks: list[tuple[str, bool]] = []
        self.run: list[str] = []
        self.stack = [Node("", False, False, "", 0)]
        self.open: dict[str, list[int]] = {}  # where in the stack each tag's elements are
        self.solid = [0]  # where its elements are that aren't inline
        self._parse(html)
        while len(self.stack) > 1:
            self._close()
        self._flush()
        self.identity = digest(b"".join(self.stack[0].parts))

    def longest(self) -> list[int]:
        """Hashes of the longest different blocks. Lengths count by powers of two, and among equals the start of
        the text decides, so that a small change in a block doesn't make another one the longest."""
        raw = ((-len(t).bit_length(), self.digest(t[:16].encode("utf-8", "surrogatepass")), t) for t in {t for t, _ in self.blocks})
        found = [self.digest(t.encode("utf-8", "surrogatepass")) for *_, t in sorted(raw)[:LONGEST]]
        return found + [0] * (LONGEST - len(found))

    def _parse(self, html: str) -> None:
        at, end, last, strict = 0, len(html), html.rfind(">"), True
        while at < end:
            tag = html.find("<", at)
            if tag < 0:
                tag = end
            if tag > at:
                self._text(html[at:tag])
            if tag == end:
                return
            if html.startswith("<!--", tag):
                at = html.find("-->", tag + 2)
                at = at + 3 if at >= 0 else end
                continue
            if html.startswith(("<!", "<?"), tag):
                at = html.find(">", tag) + 1 if last > tag else end
                continue
            found = NAME.match(html, tag + 1)
            if not found:
                self._text("<")
                at = tag + 1
                continue
            if last <= tag:  # the page is cut within a tag
                return
            rest = REST.match(html, found.end()) if strict else None
            if rest:
                at = rest.end()
            else:  # quotes hide all ends of tags; from here on the first one counts
                strict, at = False, html.find(">", tag) + 1
            name = found[2].lower()
            if found[1]:
                self._end(name)
                continue
            self._start(name, html[found.end() : at - 1])
            if name in RAW:
                shut = re.compile(rf"</{re.escape(name)}\b", re.I).search(html, at)
                at = html.find(">", shut.end()) + 1 or end if shut else end
                self._end(name)

    def _text(self, raw: str) -> None:
        node = self.stack[-1]
        text = entities.unescape(raw) if "&" in raw else raw
        words = text.split()
        if words:
            node.any = True
            node.parts.append(" ".join(words).encode("utf-8", "surrogatepass"))
        if not node.drop:
            self.run.append(text)

    def _flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            self.run = []
            if text:
                self.blocks.append((text, self.stack[-1].inside))

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text(" ")
            return
        if name in CLOSES_P:
            self._pop_to({"p"}, SCOPE)
        if name in IMPLIED:
            closed, border = IMPLIED[name]
            self._pop_to(closed, border)
        above = self.stack[-1]
        inside = above.inside or self.marks and name in ARTICLES
        off, kind = _named_off(name, attributes, above.inside) if self.marks else (name in RAW or name == "head", "")
        if name not in INLINE:
            self._flush()
        if name in VOID:
            return
        self.open.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append(Node(name, above.drop or off, inside, kind, len(self.blocks)))

    def _end(self, name: str) -> None:
        if name == "p" and not self._pop_to({"p"}, SCOPE):
            self._flush()
        elif name == "br":
            self._text(" ")
        elif name in INLINE:
            at = self._at({name})
            if at > self.solid[-1]:
                self._close_to(at)
        elif name != "p":
            self._pop_to({name}, SCOPE - {name})

    def _at(self, names: set[str] | frozenset) -> int:
        """Where the innermost open element of these names is, 0 if there is none."""
        return max((x[-1] for x in map(self.open.get, names) if x), default=0)

    def _pop_to(self, names: set[str], border: frozenset | set) -> bool:
        """Closes the innermost open element of these names unless a border stands before it."""
        at = self._at(names)
        if not at or at < self._at(border):
            return False
        self._close_to(at)
        return True

    def _close_to(self, at: int) -> None:
        while len(self.stack) > at:
            self._close()

    def _close(self) -> None:
        node = self.stack[-1]
        block = node.tag not in INLINE
        if block:
            self._flush()
            self.solid.pop()
        self.stack.pop()
        self.open[node.tag].pop()
        above = self.stack[-1]
        if not node.any or node.tag in RAW or node.tag == "head":
            return
        above.any = True
        hashed = self.digest(b"\0".join((node.tag.encode(), node.kind.encode("utf-8", "surrogatepass"), *node.parts)))
        above.parts.append(hashed.to_bytes(8, "big"))
        if block and node.tag not in ARTICLES and node.tag not in ("html", "body") and node.first < len(self.blocks):
            self.subtrees.append((hashed, node.inside, node.first, len(self.blocks)))


def without(blocks: list[tuple[str, bool]], spans: list[tuple[int, int]]) -> str:
    """The text of the blocks outside all spans."""
    depth = np.zeros(len(blocks) + 1, "i8")
    if spans:
        a, b = np.array(spans, "i8").T
        np.add.at(depth, a, 1)
        np.add.at(depth, b, -1)
    gone = np.cumsum(depth)[:-1] > 0
    left = [block for block, off in zip(blocks, gone, strict=True) if not off]
    article, rest = ("\n".join(t for t, within in left if within == x) for x in (True, False))
    return article if article and len(article) >= len(rest) else "\n".join(t for t, _ in left)


def _digest() -> Callable[[bytes], int]:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest


PARSED = pa.schema([
    ("host", pa.string()), ("page", pa.int64()), ("longest", pa.list_(pa.int64())),
    ("subtrees", pa.list_(pa.struct([("subtree", pa.int64()), ("inside", pa.bool_()), ("a", pa.int32()), ("b", pa.int32())]))),
    ("blocks", pa.list_(pa.struct([("text", pa.string()), ("inside", pa.bool_())]))),
])
PARSED_DDL = "host string, page long, longest array<long>, subtrees array<struct<subtree:long,inside:boolean,a:int,b:int>>, blocks array<struct<text:string,inside:boolean>>"


def parsed(pages: DataFrame, marks: bool = True) -> DataFrame:
    """page_id, url, host, page (hash of what the page shows), longest, subtrees and blocks of each row of ``pages``."""

    def signed(h: int) -> int:
        return h - 2**64 if h >> 63 else h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _digest()
        for part in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            columns: tuple[list, ...] = ([], [], [], [])
            for cell in part.column("html"):
                page = Page(cell.as_py() or "", digest, marks)
                columns[0].append(signed(page.identity))
                columns[1].append([*map(signed, page.longest())])
                columns[2].append([{"subtree": signed(h), "inside": i, "a": a, "b": b} for h, i, a, b in page.subtrees])
                columns[3].append([{"text": t, "inside": i} for t, i in page.blocks])
            rest = [pa.array(c, f.type) for c, f in zip(columns, list(PARSED)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), *rest], ["page_id", "url", *PARSED.names])

    schema = pages.select("page_id", "url").schema
    for field in spark_schema(PARSED_DDL):
        schema = schema.add(field)
    return pages.select("page_id", "url", host().alias("host"), "html").mapInArrow(run, schema)


def spark_schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def templates(found: DataFrame, many: int = MANY, share: float = SHARE, least: int = LEAST, in_article: float = SHARE_IN_ARTICLE, differ: float = DIFFER) -> DataFrame:
    """host, subtree, inside: the subtrees that recur on that host. ``found``: rows of ``parsed``."""
    pages = staged(found.groupBy("host", "page").agg(F.first("longest").alias("longest"), F.first("subtrees").alias("s")), "html-pages")
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    # what stands twice on a page counts once
    each = pages.select("host", "longest", F.explode(F.array_distinct(F.transform("s", lambda x: F.struct(x["subtree"], x["inside"])))).alias("x")).select("host", "longest", "x.*")
    counts = each.groupBy("host", "subtree", "inside").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    outside = F.least(F.lit(float(many)), F.col("pages") * share)
    often = counts.join(total, "host").filter(F.col("n") >= F.when(F.col("inside"), F.col("pages") * in_article).otherwise(outside))
    often = hinted(staged(often.select("host", "subtree", "inside", "n"), "html-often"), BROADCAST_ROWS)
    told = each.join(often, ["host", "subtree", "inside"]).groupBy("host", "subtree", "inside", "n").agg(*(F.count_distinct(F.col("longest")[i]).alias(f"d{i}") for i in range(LONGEST)))
    return told.filter(F.greatest(*(f"d{i}" for i in range(LONGEST))) >= F.greatest(F.col("n") * differ, F.lit(least))).select("host", "subtree", "inside")


def extract(pages: DataFrame, marks: bool = True, **bars) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html); ``bars``: those of ``templates``.

    A null or empty page has empty text; pages without a host share the empty host; repeated rows are
    extracted each; text outside of any element counts as content; a page that is cut within a tag ends
    there; other columns are ignored; an empty table gives an empty result.
    """
    rows = staged(parsed(pages, marks).withColumn("_row", F.monotonically_increasing_id()), "html-parsed", "zstd")
    recurring = hinted(staged(templates(rows, **bars), "html-templates"), BROADCAST_ROWS)
    each = rows.select("_row", "host", F.explode("subtrees").alias("x")).select("_row", "host", "x.*")
    spans = each.join(recurring, ["host", "subtree", "inside"], "left_semi").groupBy("_row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = rows.select("page_id", "url", "_row", "blocks").join(hinted(staged(spans, "html-spans"), BROADCAST_ROWS), "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            texts = [without([(x["text"], x["inside"]) for x in blocks or ()], [(x["a"], x["b"]) for x in spans or ()]) for blocks, spans in zip(part.column("blocks").to_pylist(), part.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "blocks", "spans").mapInArrow(run, pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))


def op4_template_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
