"""HTML extraction: the main text of pages, with a suffix array over each host's token streams.

A page is cut into blocks, each with a zone: `inside` the article, or else the main element, or else an element named as content; `aside`
for menus, headers, footers, adverts, forms, comments and the like; and `open` where a page marks no content. Of each host, pages are taken in
chunks of up to CHUNK; the tokens of the blocks outside articles are concatenated page by page, their suffixes sorted to a depth of
`least` tokens, and runs that begin suffixes of two or more distinct pages are boilerplate. For a host of several chunks, 64-bit hashes of all its windows of
`least` tokens are counted by page as well, and each chunk gets those of its own that pages of other chunks hold, so the result is that of the whole host. Blocks aside go; open
blocks go where runs cover MOSTLY of them, and of others the covered runs of LONG or more tokens go, so that their unique runs stay; where nothing would be left, the
open blocks stay. Articles stay whole, since pages quote each other's articles. Pages of a host with the same open blocks count as one page.

Null html counts as empty and gives an empty text; a null url is a host of its own; unclosed and cut-off markup is read as browsers
do, up to the end. Repeated rows give equal rows; pages of any length are read whole; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenry.llm.common import meet, settle, with_workers

INSIDE, OPEN, ASIDE = 0, 3, 4
#: Beside these, while a page is read: inside main, and inside an element named as content.
MAIN, NAMED = 1, 2
#: Most pages of a host whose suffixes are sorted together, and tokens that make a run long.
CHUNK, LEAST = 256, 8
#: The share of an open block's tokens that makes it boilerplate, and the tokens of a run that goes from within a block.
MOSTLY, LONG = 0.8, 24
#: Hosts above CHUNK pages that may be broadcast; with more, they are joined by shuffle.
MANY_HOSTS = 100_000

_MARK = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_ASIDE_TAG = frozenset("nav footer aside form menu dialog head button select option datalist search fieldset object audio video canvas".split())
_ASIDE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_ASIDE_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner banners sponsor sponsored promo promos promotion sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices popup modal overlay "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar widget widgets skip".split()
)
_NAME = re.compile(r"[^a-z0-9]+")


_CONTENT_NAME = frozenset("content article post entry story main".split())
#: Names that put an element aside even where it holds an article.
_NEVER = frozenset("comment comments commentlist disqus reply replies respond related".split())
_HEADS = frozenset(("header", "masthead"))


def _zone(tag: str, attributes: str, zone: int, firm: bool) -> tuple[int, bool]:
    """The zone within an element, and whether it is firm: firmly aside holds whatever comes within.

    Tag, role, class and id tell menus, headers, footers, sidebars, notices, adverts, forms and comments. An article or main element within an
    element that is aside by its name only (as a page "with-sidebar") is inside all the same.
    """
    if zone == ASIDE and firm:
        return ASIDE, True
    named: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.strip() in _ASIDE_ROLE) or (name == "style" and "display:none" in value.replace(" ", "")):
            return ASIDE, True
        if name in ("class", "id"):
            named.update(_NAME.split(value))
    if tag in ("article", "main"):
        if tag == "article" and not named.isdisjoint(("comment", "ad", "advert", "sponsored")):
            return ASIDE, True
        return (INSIDE if tag == "article" else min(zone, MAIN)), False
    if zone == ASIDE:
        return ASIDE, tag in _ASIDE_TAG or not named.isdisjoint(_NEVER)
    if tag in _ASIDE_TAG or (tag == "header" and zone == OPEN):
        return ASIDE, True
    if tag in ("html", "body"):
        return zone, False
    bad = named & (_ASIDE_NAME - _HEADS if zone < OPEN else _ASIDE_NAME)
    if bad:
        return ASIDE, not bad.isdisjoint(_NEVER)
    return (min(zone, NAMED) if not named.isdisjoint(_CONTENT_NAME) and tag in ("div", "section") else zone), False


def blocks(html: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order; texts are decoded, their white space is single spaces, none is empty."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int, bool, int]] = []  # open elements: tag, zone, whether it is firm, the place of the innermost block
    is_open: Counter[str] = Counter()
    zone, firm, at, size = OPEN, False, 0, len(html)
    side: list[str] = []  # text of inline elements that are aside, within a block that isn't
    of_block = zone

    def ended(k: int) -> tuple[int, bool]:
        """Ends the elements from place k on; the zone and firmness outside them."""
        is_open.subtract(x[0] for x in stack[k:])
        del stack[k:]
        return stack[-1][1:3] if stack else (OPEN, False)

    def end_block() -> None:
        for parts, z in ((held, of_block), (side, ASIDE)):
            text = " ".join("".join(parts).split())
            if text:
                out.append((z, text))
            parts.clear()

    while at < size:
        m = _MARK.search(html, at)
        (side if zone == ASIDE != of_block else held).append(unescape(html[at : m.start() if m else size]))
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[6]
        if tag is None:
            continue
        tag, closes, attributes = tag.lower(), m[1] or m[5], m[3] or m[7] or ""
        if tag == "br":
            held.append(" ")
            continue
        if tag in _BLOCK:
            end_block()
        if closes:
            if is_open[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                zone, firm = ended(k)
        elif tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(html, at)
            at = close.end() if close else size
        elif tag not in _VOID and not attributes.endswith("/"):
            inner = stack[-1][3] if stack else -1
            if tag == "p" and inner >= 0 and stack[inner][0] == "p":  # a paragraph ends the one before it
                zone, firm = ended(inner)
                inner = stack[-1][3] if stack else -1
            zone, firm = _zone(tag, attributes, zone, firm)
            is_open[tag] += 1
            stack.append((tag, zone, firm, len(stack) if tag in _BLOCK else inner))
        if tag in _BLOCK:
            of_block = zone
    end_block()
    best = min((z for z, _ in out), default=OPEN)
    return [(INSIDE if z == best else ASIDE, t) for z, t in out] if best < OPEN else out  # beside marked content nothing is open


def repeated(streams: list[list[str]], least: int = LEAST, owners: np.ndarray | None = None) -> list[np.ndarray]:
    """For each stream, which of its tokens lie in a run of `least` or more tokens that another stream (of another owner, where given) has too.

    The streams' suffix array is built by doubling, to a depth that tells runs of `least` tokens apart; suffixes that agree so far stand together.
    """
    sizes = np.array([len(s) for s in streams])
    ids: dict[str, int] = {}
    flat = np.fromiter((ids.setdefault(t, len(ids)) for s in streams for t in s), np.int64, int(sizes.sum()))
    n = len(flat)
    if not n:
        return [np.zeros(0, bool) for _ in streams]
    ends = np.cumsum(sizes)
    page = np.repeat(np.arange(len(streams)), sizes)
    left = ends[page] - np.arange(n)  # tokens to the end of the page
    rank, depth = flat, 1
    while depth < least:  # ranks by the first `depth` tokens become ranks by twice as many, at most `least`
        step = min(depth, least - depth)
        later = np.full(n, -1, np.int64)
        ok = left > step
        later[ok] = rank[np.flatnonzero(ok) + step]
        order = np.lexsort((later, rank))
        new = np.r_[True, (rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        depth += step
    owner = page if owners is None else np.asarray(owners)[page]
    array = np.lexsort((owner, rank))  # the suffix array, equal beginnings by owner
    array = array[left[array] >= least]
    mark = np.zeros(n + 1, np.int64)
    if len(array):
        starts = np.flatnonzero(np.r_[True, rank[array][1:] != rank[array][:-1]])
        shared = owner[array][np.r_[starts[1:], len(array)] - 1] != owner[array][starts]
        hits = array[np.repeat(shared, np.diff(np.r_[starts, len(array)]))]
        np.add.at(mark, hits, 1)
        np.add.at(mark, hits + least, -1)
    return np.split(np.cumsum(mark[:-1]) > 0, ends[:-1])


def unique_runs(text: str, covered: np.ndarray) -> str:
    """A block without its covered runs of LONG or more tokens."""
    edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
    keep = np.ones(len(covered), bool)
    for a, z in edges.reshape(-1, 2):
        keep[a:z] = z - a < LONG
    return text if keep.all() else " ".join(t for t, k in zip(text.split(" "), keep.tolist(), strict=True) if k)


def stream(page: list[tuple[int, str]]) -> list[str]:
    """The tokens of a page's blocks outside articles."""
    return [t for z, text in page if z != INSIDE for t in text.split(" ")]


def likeness(page: list[tuple[int, str]]) -> int | None:
    """What copies of a page share: a signed hash of its open blocks; none where a page marks its content."""
    own = "\n".join(text for z, text in page if z == OPEN)
    return xxhash.xxh64_intdigest(own.encode("utf-8", "replace")) - (1 << 63) if own else None


def windows(tokens: list[str], least: int = LEAST) -> np.ndarray:
    """Hashes of every run of `least` tokens, as signed numbers."""
    n = max(0, len(tokens) - least + 1)
    digest, raw = xxhash.xxh64_intdigest, [t.encode("utf-8", "replace") for t in tokens]
    return np.fromiter((digest(b" ".join(raw[k : k + least])) for k in range(n)), np.uint64, n).view(np.int64)


def main_texts(pages: list[list[tuple[int, str]]], least: int = LEAST, elsewhere: np.ndarray | None = None) -> list[tuple[str, int]]:
    """(main text, number of boilerplate tokens) of the pages of one host; `elsewhere` has windows that its other pages hold too."""
    streams = [stream(p) for p in pages]
    classes: dict = {}
    alike = ((k,) if (own := likeness(p)) is None else own for k, p in enumerate(pages))
    covers = repeated(streams, least, np.fromiter((classes.setdefault(x, len(classes)) for x in alike), np.int64, len(pages)))
    if elsewhere is not None and len(elsewhere):
        for tokens, covered in zip(streams, covers, strict=True):
            for k in np.flatnonzero(np.isin(windows(tokens, least), elsewhere)):
                covered[k : k + least] = True
    out = []
    for p, covered in zip(pages, covers, strict=True):
        kept, spare, at = [], [], 0
        for z, text in p:
            if z == INSIDE:
                kept.append(text)
                continue
            n = text.count(" ") + 1
            part = covered[at : at + n].mean()
            at += n
            if z == OPEN:
                spare.append(text)
                if part < MOSTLY:
                    kept.append(unique_runs(text, covered[at - n : at]))
        out.append(("\n\n".join(kept or spare), int(covered.sum())))
    return out


def extract(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """(page_id, url, text, n_chars, n_boilerplate) of every page (page_id, url, html)."""
    with_workers(pages.sparkSession)
    kind = pages.schema["page_id"].dataType
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    sizes = pages.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("host", F.ceil(F.col("n") / chunk).alias("parts"))
    split = sizes.count()
    sizes = F.broadcast(sizes) if split <= MANY_HOSTS else sizes
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"), F.monotonically_increasing_id().alias("row"))
    rows = rows.join(sizes, "host", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")).select("page_id", "url", "host", "part", "html", "parts")
    head = [T.StructField("page_id", kind), T.StructField("url", T.StringType())]
    cut = T.StructType([*head, T.StructField("host", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("zones", T.BinaryType()), T.StructField("texts", T.ArrayType(T.StringType()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(x.as_py()) for x in b.column(4)]
            zones = pa.array([bytes(z for z, _ in f) for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], zones, pa.array([[t for _, t in f] for f in found], pa.list_(pa.string()))], cut.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, parts, held = b.column(2).to_pylist(), b.column(3).to_pylist(), []
            for host_, part, x in zip(hosts, parts, b.column(4), strict=True):
                page = blocks(x.as_py())
                own = likeness(page)
                held.append((host_, part, np.unique(windows(stream(page), least)), part if own is None else own))
                if sum(len(h[2]) for h in held) > 1 << 16:
                    yield counted(held)
                    held = []
            if held:
                yield counted(held)

    def counted(held: list[tuple]) -> pa.RecordBatch:
        sizes = [len(h[2]) for h in held]
        own, part = np.concatenate([h[2] for h in held]), np.repeat(np.array([h[1] for h in held], np.int32), sizes)
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), sizes))), pa.array(part), pa.array(own), pa.array(np.repeat(np.array([h[3] for h in held], np.int64), sizes))], ["host", "part", "window", "page"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = [(h, p) for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            own, by = b.column(2).to_numpy(zero_copy_only=False), {}
            for k, key in enumerate(of):
                by.setdefault(key, []).append(k)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in by], pa.string()), pa.array([p for _, p in by], pa.int32()), pa.array([own[k].tobytes() for k in by.values()], pa.binary())], ["host", "part", "elsewhere"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for k in range(b.num_rows):
                    yield tuple(c[k].as_py() for c in b.columns)

        for _, group in groupby(rows(), key=lambda r: (r[2], r[3])):
            own, shared = [], []
            for r in group:
                if r[6] is None:
                    own.append(r)
                else:
                    shared.append(np.frombuffer(r[6], np.int64))
            texts = main_texts([list(zip(r[4], r[5], strict=True)) for r in own], least, np.concatenate(shared) if shared else None)
            for lo in range(0, len(own), 128):
                some, t = own[lo : lo + 128], texts[lo : lo + 128]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in some], id_type), pa.array([r[1] for r in some], pa.string()), pa.array([x for x, _ in t], pa.string()), pa.array([len(x) for x, _ in t], pa.int64()), pa.array([n for _, n in t], pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_boilerplate"],
                )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    out = T.StructType([*head, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_boilerplate", T.LongType())])
    dealt = rows.mapInArrow(parse, cut).withColumn("elsewhere", F.lit(None).cast("binary"))
    if split:
        held = rows.where(F.col("parts") > 1).select("page_id", "url", "host", "part", "html").mapInArrow(count, "host string, part int, window long, page long")
        # Pages that mark content stand under their chunk's number: what they share within it, its suffix array finds.
        held = settle(held.groupBy("host", "part", "window").agg(F.min("page").alias("lo"), F.max("page").alias("hi")))
        shared = held.groupBy("host", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 1")
        own = meet(held.withColumn("key", F.struct("host", "window")), shared.select(F.struct("host", "window").alias("key"), "n"), "key", held.count()).select("host", "part", "window")
        own = own.repartition("host", "part").mapInArrow(pack, "host string, part int, elsewhere binary")
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in cut.fields]
        dealt = dealt.unionByName(own.select(*none[:2], "host", "part", *none[4:], "elsewhere"))
    dealt = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "page_id", "url")
    return dealt.mapInArrow(choose, out)
