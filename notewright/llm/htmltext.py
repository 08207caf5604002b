"""Main text of web pages, by a suffix array of each host.

1. Every page is parsed into blocks of text: all but scripts, styles and the like. The blocks of its
   candidate stream are those inside its article's mark (an article element, a main element or role=main), or,
   on a page that the parser finds no mark on, those outside certain zones; all others are its frame.
2. The token streams of a host's pages are laid out one after the other, their suffixes sorted and
   neighbours compared: runs of RUN tokens or more that SHARE of all the host's pages hold, and three at
   least, are boilerplate, and the blocks that such runs cover are shared. The unique runs of blocks that stay
   are whole: a shared run that reaches into one doesn't cut it.
3. The marks check that. Adverts and menus that differ from page to page don't repeat and articles that are copied do, so
   repetition alone would keep the one and drop the other: a frame goes though it is unique, and a block inside a mark
   stays though it is shared (n_shared counts these). A class, id or role names a zone for certain only if
   nothing but zone words and words of layout stand in it (ad-slot, related-posts). One that holds
   other words too (market-share, lunch-menu) is in doubt: its element goes if most of its text is links, or if the
   host repeats it as above, far more often than the rest of the article. On pages without a mark the
   shared blocks go, and so does what over half of the host's pages show in their frames.

A host has any size: its pages are range-sorted, each task builds arrays over at most about two ARRAY bytes of one host's pages,
and proposes what SHARE of these pages hold. What SHARE of all pages hold, SHARE of the pages of some array
hold, so no shared run is missed. A second scan counts the proposed runs on all the host's pages, by their
64-bit hashes, so the result doesn't depend on how pages are dealt. What comes back to a page are its host's common
runs: at most 1 / SHARE times the tokens of a mean page of the host.

Pages without a mark, and those with blocks in doubt, are open: their own share of SHARE counts, so that marked pages don't hide a
template of their own. Copies of an article are no boilerplate: where shared blocks that stand on at most half of the host's
open pages (or on FEW) make up most of what the wider shared blocks leave of a page, they stay. Copies on
more than half of the open pages of a host can't be told from its frame.

A null or empty html has an empty text. White space is that of Unicode, br and table cells are
white space, and any other block-level element ends a block.
"""

from __future__ import annotations

import html as html_
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import bound_batches, materialize
from notewright.llm.textvec import inside, slices, utf8, windows, words

RUN = 8
SHARE = 0.10
#: Copies on so many pages can be an article's on a host of any size.
FEW = 5
#: Bytes of text in one suffix array, from which it is built; at most twice as many and a page are held.
ARRAY = 1 << 22
#: Bytes of text whose runs are hashed at once.
CHUNK = 1 << 20
#: Runs proposed for one host that its pages get as a list; more are joined by a shuffle.
LISTED = 1 << 15
#: What stands in over half of a host's frames counts as on so many pages.
FRAME = 1 << 40
#: Blocks hold no white space but single spaces.
NO_SPACE = np.ones(256, bool)
NO_SPACE[0x20] = False
#: Share of its tokens from which a block counts as covered.
COVERED = 0.80

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^'\">]|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements by what they are to the text around them.
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
ZONES = frozenset(["nav", "footer", "aside", "form", "button", "select", "template", "svg", "canvas", "object", "dialog", "menu", "head", "audio", "video", "datalist"])
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset(["br", "td", "th"])
#: Start tags that end an open p; those that end an open element of their own family; and what shuts such ends in.
ENDS_P = BLOCKS - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
FAMILY = {"p": "p", "li": "li", "dt": "dd", "dd": "dd", "td": "td", "th": "td", "tr": "tr", "option": "option"}
SCOPES = frozenset(["table", "ul", "ol", "dl", "select", "button", "object"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
# Words of classes, ids and roles that name a zone.
ZONE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "sidebars footer comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations pagination "
    "pager toolbar login searchform skip complementary contentinfo search".split()
)
# Words that say where or how an element stands, beside a zone's own.
STRUCTURE_WORDS = frozenset(
    "box block blocks wrapper wrap container section area region list lists item items widget widgets inner outer content body slot unit bar link links text group panel "
    "module top bottom left right main site page pages global primary secondary sticky fixed inline mobile desktop article articles post posts story stories entry form "
    "button buttons icon icons row col column columns grid card cards label title header head footer foot message thread media image img".split()
)
LAYOUT_WORDS = frozenset(["has", "with", "without", "no", "layout", "free", "enabled", "disabled"])
HEADER_WORDS = frozenset(["header", "masthead", "topbar"])
HEADER_PLACES = frozenset(["site", "page", "top", "main", "global", "wrapper", "wrap", "container", "inner", "outer", "bar", "sticky", "fixed", "mobile", "desktop", "primary"])
#: An element in doubt goes if links hold this share of its characters.
LINKED = 0.5
#: Elements that no class turns into a zone: they hold the page.
HOLDERS = frozenset(["html", "body", "main", "article"])
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def _words(token: str) -> set[str]:
    """The words of a class, id or role; none if it only says how the rest is laid out (has-sidebar, ad-free)."""
    words = {w.lower() for w in WORD.findall(token)}
    return set() if words & LAYOUT_WORDS else words


def _kind(name: str, raw: str) -> str:
    """"zone", "doubt" (its name may be a zone's), "header", "root" or "" for an element."""
    if name in ZONES:
        return "zone"
    kind = "root" if name in ("article", "main") else "header" if name == "header" else ""
    if "=" in raw or "hidden" in raw:
        own = attributes(raw)
        named = " ".join(own.get(k, "") for k in ("class", "id", "role"))
        tokens = [w for token in named.split() if (w := _words(token))]
        if own.get("role", "").lower() == "main":
            kind = "root"
        if "hidden" in own or re.search(r"display\s*:\s*none", own.get("style", "")):
            return "zone"
        if name == "article" and any(w & {"comment", "comments", "reply", "related", "recommended", "ad", "sponsored"} for w in tokens):
            return "zone"
        if name not in HOLDERS:
            named_zones = [w for w in tokens if w & ZONE_WORDS]
            if any(w <= ZONE_WORDS | STRUCTURE_WORDS for w in named_zones):
                return "zone"
            if any(w & HEADER_WORDS and w <= HEADER_WORDS | HEADER_PLACES for w in tokens):
                return "header"
            if named_zones and not kind:
                return "doubt"
    return kind


@dataclass
class Block:
    """A block's text, and whether the name of an element around it leaves in doubt that it is the article's."""

    text: str
    doubt: bool


class Page:
    """A page's blocks in order: those inside an article's mark if there is one (marked), else all outside zones; frame: all others."""

    def __init__(self, page: str):
        self.found: list[tuple[str, Block]] = []  # where each block stands: "inside" a mark, "outside" or in a "zone"
        self.marked = False
        self.parts: list[str] = []
        self.sizes = [0, 0]  # characters of the current block, and those in links
        self.stack: list[tuple[str, str]] = []
        self.open: dict[str, int] = {}
        self.last: dict[str, list[int]] = {}  # where in the stack elements of a family stand
        self.scopes: list[int] = []
        self.count = {"zone": 0, "doubt": 0, "header": 0, "root": 0, "heading": 0, "link": 0}
        self._parse(page)

    @property
    def blocks(self) -> list[Block]:
        return [b for place, b in self.found if place == ("inside" if self.marked else "outside")]

    @property
    def frame(self) -> list[Block]:
        return [b for place, b in self.found if place != ("inside" if self.marked else "outside")]

    def _end_block(self) -> None:
        if self.parts:
            if text := " ".join(html_.unescape("".join(self.parts)).split()):
                n = self.count
                doubt = n["doubt"] > 0
                zone = n["zone"] or n["header"] and not (n["root"] and n["heading"]) or doubt and self.sizes[1] >= LINKED * self.sizes[0]
                self.found.append(("zone" if zone else "inside" if n["root"] else "outside", Block(text, doubt)))
            self.parts.clear()
            self.sizes = [0, 0]

    def _keep(self, text: str) -> None:
        if text:
            self.parts.append(text)
            size = len(text) - text.count(" ")
            self.sizes[0] += size
            self.sizes[1] += size if self.count["link"] else 0

    def _pop(self) -> None:
        name, kind = self.stack.pop()
        self.open[name] -= 1
        if kind or name in BLOCKS:
            self._end_block()
        if kind:
            self.count[kind] -= 1
        if name in HEADINGS:
            self.count["heading"] -= 1
        if name == "a":
            self.count["link"] -= 1
        if name in FAMILY:
            self.last[FAMILY[name]].pop()
        if name in SCOPES:
            self.scopes.pop()

    def _end_family(self, family: str) -> None:
        """Close the innermost open element of a family, unless a scope stands between."""
        own = self.last.get(family)
        if own and (not self.scopes or own[-1] > self.scopes[-1]):
            for _ in range(len(self.stack) - own[-1]):
                self._pop()

    def _start(self, name: str, raw: str) -> None:
        if name in ENDS_P:
            self._end_family("p")
        if name in FAMILY:
            self._end_family(FAMILY[name])
        if name in BLOCKS:
            self._end_block()
        elif name in SPACES:
            self._keep(" ")
        if name in VOID:
            return
        kind = _kind(name, raw)
        if kind == "root" and self.count["zone"]:
            kind = ""
        if kind:
            self._end_block()
            self.count[kind] += 1
            self.marked |= kind == "root"
        if name in HEADINGS:
            self.count["heading"] += 1
        if name == "a":
            self.count["link"] += 1
        if name in FAMILY:
            self.last.setdefault(FAMILY[name], []).append(len(self.stack))
        if name in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((name, kind))
        self.open[name] = self.open.get(name, 0) + 1

    def _parse(self, page: str) -> None:
        at = 0
        while m := TOKEN.search(page, at):
            self._keep(page[at : m.start()])
            at = m.end()
            name = m["name"] or m["name2"]
            if not name:
                continue
            name = name.lower()
            if m["close"] or m["close2"]:
                if self.open.get(name):
                    while self.stack[-1][0] != name:
                        self._pop()
                    self._pop()
                elif name in BLOCKS:
                    self._end_block()
                continue
            if name in RAW:
                close = re.compile(rf"</{name}[\s>/]", re.I).search(page, at)
                at = close.start() if close else len(page)
                if close and (end := page.find(">", at)) >= 0:
                    at = end + 1
                elif close:
                    at = len(page)
                continue
            self._start(name, m["attrs"] or m["attrs2"] or "")
        self._keep(page[at:])
        self._end_block()


def sorted_suffixes(streams: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, stream): the suffix array of token streams laid out one after the other, to a depth of `run` tokens.

    order: the places of the suffixes, sorted by their first `run` tokens and then by place; rank: the same for suffixes that
    agree in these; stream: the stream of each place. After each stream stands a separator of its own.
    """
    sizes = np.array([len(s) for s in streams])
    stream = np.repeat(np.arange(len(streams)), sizes + 1)
    text = np.concatenate([np.append(s + 1, -i) for i, s in enumerate(streams, 1)])
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < run:  # prefix doubling, as far as suffixes have to be told apart
        step = min(depth, run - depth)
        key = rank * np.int64(n + 2)
        if step < n:
            key[: n - step] += rank[step:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        depth += step
    return np.argsort(rank, kind="stable"), rank, stream


def repeated(streams: list[np.ndarray], run: int, share: float) -> list[np.ndarray]:
    """For each page's token ids, which tokens lie in runs of `run` tokens or more that enough distinct pages share."""
    if not streams:
        return []
    order, rank, page = sorted_suffixes(streams, run)
    sizes = np.array([len(s) for s in streams])
    n = len(rank)
    pairs = np.unique(np.stack([rank[order], page[order]], axis=1), axis=0)
    pages = np.bincount(pairs[:, 0])
    common = pages[rank] >= max(3, int(np.ceil(share * len(streams))))
    edge = np.zeros(n + run + 1, np.int64)
    hits = np.flatnonzero(common)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + run, -1)
    covered = np.cumsum(edge)[:n] > 0
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    return [covered[a : a + k] for a, k in zip(starts, sizes, strict=True)]


def page_streams(pages: list[Parsed]) -> list[str]:
    """The candidate stream and the frame of each page, in turn."""
    return [s for p in pages for s in (" ".join(p.own), " ".join(p.frame))]


def proposed(pages: list[Parsed], whole: bool, run: int = RUN, share: float = SHARE) -> np.ndarray:
    """Hashes of the runs that a suffix array over pages of one host proposes: all that the host can share. whole: it has no other pages."""
    opened = np.array([p.open for p in pages])
    least = lambda n: max(3 if whole else 1, int(np.ceil(share * n - 1e-9)))
    if whole and len(pages) < 3:
        return np.zeros(0, np.int64)
    if least(len(pages)) == 1:  # few pages, or one very long one, of a host that has others
        return np.unique(stream_runs(page_streams(pages))[0])
    buf, off = utf8(pa.array(page_streams(pages), pa.string()))
    w = words(buf, off, table=NO_SPACE)
    token = np.unique(w.hash, return_inverse=True)[1].astype(np.int64)
    sizes = np.diff(w.off)
    order, rank, stream = sorted_suffixes([token[a:b] for a, b in zip(w.off[:-1], w.off[1:], strict=True)], run)
    ahead = (np.cumsum(sizes + 1) - 1)[stream] - np.arange(len(stream))  # tokens from each place to its stream's end
    order = order[ahead[order] >= run]
    if not len(order):
        return np.zeros(0, np.int64)
    rank, page, frame = rank[order], stream[order] >> 1, stream[order] & 1 == 1
    other = np.append(True, rank[1:] != rank[:-1])  # neighbours compared: another run, another page with it
    first = other | np.append(True, page[1:] != page[:-1])
    run_of = np.cumsum(other) - 1
    held = np.bincount(run_of[first])
    held_open = np.bincount(run_of[first & ~frame & opened[page]], minlength=len(held))
    wanted = (held >= least(len(pages))) | (held_open >= least(opened.sum()))
    at = order[other][wanted]
    return windows(w.hash, run)[at - stream[at]].view(np.int64)


def stream_runs(streams: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(hash, stream): a hash of each run of tokens of each stream, in order; runs pass over the ends of blocks."""
    buf, off = utf8(pa.array(streams, pa.string()))
    found = words(buf, off, table=NO_SPACE)
    at = inside(found.off, run)
    return windows(found.hash, run)[at].view(np.int64), found.doc()[at]


def run_hashes(page: list[str], run: int = RUN) -> np.ndarray:
    """A hash of each run of tokens of a page's blocks, by its first token."""
    return stream_runs([" ".join(page)], run)[0]


def block_pages(page: list[str], hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, run: int = RUN) -> list[int]:
    """For each block, on how many pages the runs stand that cover COVERED of it; 0 if common ones don't.

    hashes: of the page's runs. common, counts: the runs that enough pages of the host hold, sorted, and on how many they stand.
    """
    if not len(common) or not page:
        return [0] * len(page)
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    held = np.where(common[at] == hashes, counts[at], 0)
    if not held.any():
        return [0] * len(page)
    sizes = [b.count(" ") + 1 for b in page]
    spread = np.zeros(sum(sizes), np.int64)  # the pages of the widest run around each token
    for k in range(run):
        np.maximum(spread[k : k + len(held)], held, out=spread[k : k + len(held)])
    out, start = [], 0
    for n in sizes:
        out.append(int(np.sort(spread[start : start + n])[n - int(np.ceil(COVERED * n - 1e-9))]))
        start += n
    return out


def unshared(page: list[str], block: list[int], pages: int, least: int) -> list[int]:
    """Which blocks of a page without marks stay on a host of so many open pages. block: block_pages(); least: on how many pages common runs stand."""
    sizes = [b.count(" ") + 1 for b in page]
    wide = max(FEW, pages / 2)
    own = sum(n for n, v in zip(sizes, block, strict=True) if v < least)
    copied = sum(n for n, v in zip(sizes, block, strict=True) if least <= v <= wide)
    most = wide if copied > own else least - 1
    return [i for i, v in enumerate(block) if v < least or v <= most]


def undoubted(doubt: list[bool], block: list[int]) -> list[int]:
    """Which blocks of a marked page stay: those in doubt go if common runs cover them that stand on over twice as many pages as the article's own blocks do. block: block_pages()."""
    sure = sorted(v for v, d in zip(block, doubt, strict=True) if not d)
    usual = max(1, sure[len(sure) // 2]) if sure else 1
    return [i for i, (v, d) in enumerate(zip(block, doubt, strict=True)) if not d or v <= 2 * usual]


def host(url: Column) -> Column:
    """The host of a url in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


@dataclass
class Parsed:
    """A parsed page: the blocks of its candidate stream, which of them are in doubt, its frame, and whether its host has to judge it."""

    own: list[str]
    doubt: list[bool]
    frame: list[str]
    open: bool

    @property
    def size(self) -> int:
        return sum(map(len, self.own)) + sum(map(len, self.frame))


def packed(page: Page) -> bytes:
    """A page's blocks as deflated lines; the first line tells what each of the others is."""
    own, frame = page.blocks, page.frame
    kinds = "".join("?" if b.doubt else "+" for b in own) + "-" * len(frame)
    return zlib.compress("\n".join([kinds, *(b.text for b in own), *(b.text for b in frame)]).encode(), 6)


def unpacked(blob: bytes, opened: bool) -> Parsed:
    kinds, *lines = zlib.decompress(blob).decode().split("\n")
    n = len(kinds.rstrip("-"))
    return Parsed(lines[:n], [k == "?" for k in kinds[:n]], lines[n:], opened)


def unpacked_chunks(rows: Iterable[int], blobs: pa.Array, opened: list[bool]) -> Iterator[tuple[list[int], list[Parsed]]]:
    """(rows, their pages), of about CHUNK bytes of text at a time: blobs may be deflated much."""
    own, held, total = [], [], 0
    for i in rows:
        page = unpacked(blobs[i].as_py(), opened[i])
        own.append(i)
        held.append(page)
        total += page.size
        if total >= CHUNK:
            yield own, held
            own, held, total = [], [], 0
    if held:
        yield own, held


PARSED = "host string, marked boolean, open boolean, blob binary"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and PARSED: a row per page."""
    kinds = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string"
    own = bound_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [Page(html.as_py()) for html in batch.column("html")]
            opened = [not p.marked or any(b.doubt for b in p.blocks) for p in found]
            columns = [pa.array([p.marked for p in found], pa.bool_()), pa.array(opened, pa.bool_()), pa.array([packed(p) for p in found], pa.binary())]
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "url", "host")), *columns], ["page_id", "url", "host", "marked", "open", "blob"])

    return own.mapInArrow(run, f"{kinds}, {PARSED}")


def host_arrays(parsed: DataFrame, size: int = ARRAY) -> DataFrame:
    """host, pages, open_pages, runs: a row per suffix array, with the runs that it proposes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, sizes, total, cut = None, [], [], 0, True  # cut: other tasks may have pages of the host, or another array of this task

        def array(n: int, whole: bool) -> pa.RecordBatch:
            own = held[:n]
            del held[:n], sizes[:n]
            row = [pa.array([name]), pa.array([n], pa.int64()), pa.array([sum(p.open for p in own)], pa.int64()), pa.array([proposed(own, whole)], pa.list_(pa.int64()))]
            return pa.record_batch(row, ["host", "pages", "open_pages", "runs"])

        for batch in batches:
            for of, opened, blob in zip(*(batch.column(c).to_pylist() for c in ("host", "open", "blob")), strict=True):
                if of != name:
                    if held:
                        yield array(len(held), not cut)
                        cut = False
                    name, total = of, 0
                page = unpacked(blob, opened)
                held.append(page)
                sizes.append(page.size)
                total += sizes[-1]
                if total >= 2 * size and len(held) > 1:
                    n = int(np.searchsorted(np.cumsum(sizes), total - size, "right"))  # what is left is an array's worth
                    cut = True
                    yield array(max(1, min(n, len(held) - 1)), False)
                    total = sum(sizes)
        if held:
            yield array(len(held), False)

    salt = F.xxhash64("page_id", "url", "blob").alias("salt")
    parts = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parsed.select("host", "open", "blob", salt).repartitionByRange(parts, "host", "salt").sortWithinPartitions("host")
    return dealt.select("host", "open", "blob").mapInArrow(run, "host string, pages long, open_pages long, runs array<bigint>")


def page_runs(pages: list[Parsed], wanted: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(run, pages, opened, frames): on how many of the pages runs stand at all, in the candidate stream of open ones, and in frames. wanted: sorted, the runs to count; None for all."""
    found, stream = stream_runs(page_streams(pages))
    if wanted is None:
        wanted = np.unique(found)
    if not len(wanted):
        return (wanted,) * 4
    at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
    hit = wanted[at] == found
    at, stream = at[hit], stream[hit]
    order = np.lexsort((stream, at))
    r, page, frame = at[order], stream[order] >> 1, stream[order] & 1 == 1
    other = np.append(True, (r[1:] != r[:-1]) | (page[1:] != page[:-1]))[: len(r)]
    first_frame = frame & (other | np.append(True, ~frame[:-1]))[: len(r)]
    opened = np.array([p.open for p in pages])[page]
    counts = [np.bincount(r[flag], minlength=len(wanted)) for flag in (other, other & ~frame & opened, first_frame)]
    some = np.flatnonzero(counts[0])
    return (wanted[some], *(c[some] for c in counts))


def counted(parsed: DataFrame, proposed_: DataFrame, listed: int = LISTED) -> DataFrame:
    """host, run, pages, opened, frames: page_runs() of the proposed runs (host, run) over all pages of a host.

    The pages of a host with up to `listed` proposed runs get them as a list. Of others (their pages are very long) all runs are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts: dict[str, list[int]] = {}
            for i, of in enumerate(batch.column("host").to_pylist()):
                hosts.setdefault(of, []).append(i)
            opened, blobs = batch.column("open").to_pylist(), batch.column("blob")
            for of, rows in hosts.items():
                wanted = np.sort(batch.column("runs")[rows[0]].values.to_numpy()) if "runs" in batch.schema.names else None
                for _, held in unpacked_chunks(rows, blobs, opened):
                    found = page_runs(held, wanted)
                    yield pa.record_batch([pa.array([of] * len(found[0]), pa.string()), *map(pa.array, found)], ["host", "run", "pages", "opened", "frames"])

    schema = "host string, run long, pages long, opened long, frames long"
    sizes = proposed_.groupBy("host").agg(F.count("*").alias("n"))
    lists = proposed_.join(sizes.where(F.col("n") <= listed), "host").groupBy("host").agg(F.collect_list("run").alias("runs"))
    few = parsed.join(materialize(lists, "html-listed"), "host").select("host", "open", "blob", "runs").mapInArrow(run, schema)
    many = parsed.join(sizes.where(F.col("n") > listed), "host", "left_semi").select("host", "open", "blob").mapInArrow(run, schema)
    many = many.join(proposed_, ["host", "run"], "left_semi")
    return few.unionByName(many).groupBy("host", "run").agg(*[F.sum(c).alias(c) for c in ("pages", "opened", "frames")])


def least_pages(pages: Column) -> Column:
    """On how many pages of so many a run has to stand to be shared."""
    return F.greatest(F.lit(3), F.ceil(F.round(pages * SHARE, 6))).cast("long")


def common_runs(parsed: DataFrame, size: int = ARRAY, listed: int = LISTED) -> DataFrame:
    """host, open_pages, least, common (run, n, pages): the shared runs of each host that has any, sorted.

    n: the open pages that hold a run, FRAME if it stands in over half of the host's frames, 0 if it is shared by neither; pages: all
    pages that hold it, 0 if these are too few.
    """
    arrays = materialize(host_arrays(parsed, size), "html-arrays")
    sizes = arrays.groupBy("host").agg(F.sum("pages").alias("all_pages"), F.sum("open_pages").alias("open_pages"))
    runs = materialize(arrays.select("host", F.explode("runs").alias("run")).distinct(), "html-proposed")
    counts = counted(parsed, runs, listed).join(sizes, "host").withColumn("least", least_pages(F.col("open_pages")))
    wide = (F.col("frames") >= 3) & (F.col("frames") * 2 > F.col("all_pages"))
    n = F.when(wide, F.lit(FRAME)).when(F.col("opened") >= F.col("least"), F.col("opened")).otherwise(F.lit(0)).cast("long")
    shared = F.when(F.col("pages") >= least_pages(F.col("all_pages")), F.col("pages")).otherwise(F.lit(0)).cast("long")
    held = counts.select("host", "open_pages", "least", "run", n.alias("n"), shared.alias("pages")).where("n > 0 or pages > 0")
    return materialize(held.groupBy("host", "open_pages", "least").agg(F.array_sort(F.collect_list(F.struct("run", "n", "pages"))).alias("common")), "html-common")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_shared: one row per page. n_shared: blocks of the text that the host's array calls shared."""
    kinds = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked, opened, least, open_pages = (batch.column(c).to_pylist() for c in ("marked", "open", "least", "open_pages"))
            runs, texts, overruled = batch.column("common"), [], []
            for rows, held in unpacked_chunks(range(batch.num_rows), batch.column("blob"), opened):
                found, stream = stream_runs([" ".join(p.own) for p in held])
                cuts = np.searchsorted(stream, np.arange(len(held) + 1))
                for k, (i, page) in enumerate(zip(rows, held, strict=True)):
                    stay, n = range(len(page.own)), 0
                    if runs[i].is_valid:
                        hashes = found[cuts[k] : cuts[k + 1]]
                        common, counts, all_ = (runs[i].values.field(c).to_numpy(zero_copy_only=False) for c in ("run", "n", "pages"))
                        if page.open:
                            block = block_pages(page.own, hashes, common, counts)
                            stay = undoubted(page.doubt, block) if marked[i] else unshared(page.own, block, open_pages[i], least[i])
                        shared = block_pages(page.own, hashes, common, all_)
                        n = sum(shared[b] > 0 for b in stay)
                    texts.append("\n\n".join(page.own[b] for b in stay))
                    overruled.append(n)
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(overruled, pa.int64())], ["page_id", "url", "text", "n_shared"])

    # Written first: pages are parsed once, and their blocks are read for the arrays, for the counts and to be judged.
    parsed = materialize(parsed_pages(pages), "html-parsed")
    judged = parsed.join(common_runs(parsed), "host", "left").select("page_id", "url", "marked", "open", "blob", "open_pages", "least", "common")
    return judged.mapInArrow(judge, f"{kinds}, text string, n_shared long")


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared: one row per page."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
