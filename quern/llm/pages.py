"""Main text of web pages by host suffix arrays over page token streams.

Each page becomes visible blocks with markup evidence: inside an article or main element, inside an element that
holds menus, adverts and the like (element names and class, id or role words), or neither. The pages of a host are
concatenated as token streams (unique separators between pages) and sorted by prefix doubling into a suffix array to the depth of
``LEAST`` tokens: suffixes of one rank share that many tokens, so ranks on two or more distinct pages are long repeated
substrings. Their union covers the boilerplate of the host. Covered blocks outside the article go, and of
partly covered ones every unique run stays. Inside an article element repetition takes only a frame: blocks of ``LEAST`` tokens or more, no headings, that begin or end
the article and stand as whole blocks on ``SHARE`` of the host's pages (and on ``OFTEN`` at least), such as notices; anything behind
the first other block, or before the last, is article text however often it is repeated, and so is a block whose frame is most of the article on most of its pages (copies of an article). What
markup names as menu, advert, comment and so on goes as well, as a page can be the only one of its host. Attributes name it by whole
words, never on html, body, main, article and headings, and where they leave nothing of a page, repetition alone decides on what they took.

Scale: pages are parsed where they are read, what markup alone settles stays behind, and the other blocks are shuffled once,
compressed. The pages of a host make one shard up to ``SHARD_CHARS`` characters, and larger hosts are split into shards of that size by
a hash of the page, whatever the partitioning, so memory is bounded and a hot host is spread. What such a host repeats across its
shards is counted over all of them, so results don't depend on the shards: by hashes of whole blocks of ``LEAST`` tokens or more and, on hosts with
blocks outside articles, where repetition decides, of every window of ``LEAST`` tokens. Counts are summed in the tasks first, and each shard gets the
repeated ones that it holds. Whether a frame is most of the article is voted on by all pages of the host too. Sizes of large hosts,
and the blocks on many of their pages, are broadcast if there are at most ``BROADCAST_HOSTS``.

Edge cases: null html counts as empty and gives an empty text; null urls share one empty host; rows of one page_id
(without one: of one url) count as one page when repeats are sought within a shard; an unclosed quote or tag ends at the next >, and text after the last > is
text; repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_slices, texts

#: Tokens of the shortest substring that counts as repeated (a power of two).
LEAST = 8
SHARD_CHARS = 4_000_000
SPREAD = 16
#: Rows of two numbers each.
BROADCAST_HOSTS = 100_000
#: A tag whose end isn't found within so many characters ends at its first >.
TAG_CHARS = 1 << 16
#: Distinct pages, and the share of the host's distinct pages, on which a block that begins or ends an article must stand to go.
OFTEN, SHARE = 5, 0.5

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements whose raw content is no markup and no text.
_RAW = {"script", "style", "noscript", "template", "svg", "math", "textarea", "title", "iframe", "object", "select", "canvas", "video", "audio"}
#: Elements that hold no article text.
_SIDE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head"}
_BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "section", "article", "main", "header", "footer", "nav", "aside", "form", "fieldset", "figure", "figcaption", "blockquote", "pre", "hr", "address", "body", "html", "details", "summary", "dialog", "menu"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements whose class, id and role say nothing against their text.
_OPEN = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id and role attributes that name what is not article text, alone or joined with each other.
_HINTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "sidebar", "comment", "comments", "disqus", "promo", "sponsor", "sponsored", "share", "sharing", "social", "related", "recommended", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "newsletter", "subscribe", "signup", "popup", "modal", "footer", "complementary", "contentinfo", "search", "pagination", "pager", "toolbar", "widget"}
_WHOLE_HINTS = {"header", "site-header", "page-header", "masthead", "topbar"}


@dataclass
class Block:
    text: str
    article: bool
    side: bool
    hinted: bool  # aside by words of attributes only
    heading: bool


@dataclass
class _State:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    article: int = 0
    heading: bool = False
    side: list[list] = field(default_factory=list)  # [tag, depth, by words only]

    def flush(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                self.blocks.append(Block(text, self.article > 0, bool(self.side), bool(self.side) and all(x[2] for x in self.side), self.heading))
            self.parts = []


def _hint(token: str) -> bool:
    return token in _WHOLE_HINTS or _HINTS.issuperset(re.split(r"[_-]+", token))


def _sidelong(name: str, attrs: str, in_article: bool) -> str:
    """Why an element holds no article text: "element" (its name or being hidden), "hint" (words of its attributes) or ""."""
    if name in _SIDE or name == "header" and not in_article:
        return "element"
    found, hints = "", name not in _OPEN and not _main(name, attrs)
    for key, a, b, c in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" and not value.strip("hidden") or key == "aria-hidden" and value == "true":
            return "element"
        if hints and key in ("class", "id", "role") and any(map(_hint, value.split())):
            found = "hint"
    return found


def _main(name: str, attrs: str) -> bool:
    return name in ("article", "main") or any((a or b or c).lower() in ("main", "articlebody") for k, a, b, c in (_ATTR.findall(attrs) if attrs else ()) if k.lower() in ("role", "itemprop"))


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Place of the > that ends a tag whose attributes begin at ``at``, quotes skipped; -1 if there is none."""
    if at > last[">"]:
        return -1
    k, far = at, at + TAG_CHARS
    while m := _STOP.search(html, k, far):
        sign = m.group()
        if sign == ">":
            return m.start()
        k = m.end()
        if k <= last[sign]:  # a quote that closes
            k = html.find(sign, k) + 1
    return html.find(">", at)


def tags_of(html: str) -> Iterator[tuple[int, int, str, bool, str, str]]:
    """(start, end, name, closing, attributes, literal text) of each tag, comment and section, in one pass; the caller may send
    the place to go on from."""
    last = {c: html.rfind(c) for c in ">\"'"}
    at = 0
    while (at := html.find("<", at)) >= 0:
        name, closing, attrs, literal = "", False, "", ""
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
        elif html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            literal = html[at + 9 : end if end >= 0 else len(html)]
            end = len(html) if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at) + 1
        elif m := _NAME.match(html, at + 1):
            end = _tag_end(html, m.end(), last) + 1
            name, closing, attrs = m.group(2).lower(), m.group(1) == "/", html[m.end() : max(m.end(), end - 1)]
        else:
            at += 1
            continue
        if end <= 0:
            return
        at = (yield at, end, name, closing, attrs, literal) or end


def blocks_of(html: str | None) -> list[Block]:
    """Visible blocks of a page in order; raw elements and comments leave nothing."""
    html = html or ""
    s, at, raw = _State(), 0, ""
    mains: list[str] = []
    tags, go_on = tags_of(html), None
    while True:
        try:
            begin, end, name, closing, attrs, literal = tags.send(go_on)
        except StopIteration:
            break
        go_on = None
        if begin > at:
            s.parts.append(html[at:begin])
        at = end
        if not name:
            if literal:
                s.parts.append(literal.replace("&", "&amp;"))
            continue
        if name in _RAW and not closing:
            if not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                go_on = at = close.end() if close else len(html)
            s.parts.append(" ")
            continue
        block = name in _BLOCK
        if block:
            s.flush()
            s.heading = name in _HEADINGS and not closing
        elif name == "br":
            s.parts.append(" ")
        if closing:
            if s.side:
                top = s.side[-1]
                if top[0] == name:
                    top[1] -= 1
                    if not top[1]:
                        s.flush()
                        s.side.pop()
            if mains and mains[-1] == name:
                mains.pop()
                s.article = max(0, s.article - 1)
            continue
        if name in _VOID or attrs.rstrip().endswith("/"):
            continue
        if s.side and s.side[-1][0] == "p" and block:  # an open paragraph ends where a block begins
            s.side.pop()
        if s.side and s.side[-1][0] == name:
            s.side[-1][1] += 1
        elif why := _sidelong(name, attrs, bool(mains)):
            s.flush()
            s.side.append([name, 1, why == "hint"])
        elif _main(name, attrs):
            mains.append(name)
            s.article += 1
        elif mains and mains[-1] == name:
            mains.append(name)
            s.article += 1
    if at < len(html):
        s.parts.append(html[at:])
    s.flush()
    return s.blocks


def holders(streams: list[np.ndarray], pages: np.ndarray) -> np.ndarray:
    """Suffix-array pass over the concatenated token streams (one unique separator after each): on how many distinct pages
    the LEAST tokens from each place on stand."""
    if not streams:
        return np.zeros(0, np.int64)
    lengths = np.array([len(x) + 1 for x in streams])
    text = np.empty(int(lengths.sum()), np.int64)
    owner = np.repeat(pages, lengths)
    top = max((int(x.max()) for x in streams if len(x)), default=0) + 1
    at = 0
    for k, x in enumerate(streams):
        text[at : at + len(x)] = x
        text[at + len(x)] = top + k
        at += len(x) + 1
    n = len(text)
    rank, step = np.unique(text, return_inverse=True)[1], 1
    while step < LEAST:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * np.int64(n + 2) + after, return_inverse=True)[1]
        step *= 2
    key = rank * np.int64(owner.max() + 1) + owner
    order = np.argsort(key, kind="stable")  # the suffix array to this depth, equal suffixes by page
    ranks, keys = rank[order], key[order]
    head = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
    distinct = np.add.reduceat(np.append(True, keys[1:] != keys[:-1]).astype(np.int64), head)
    out = np.empty(n, np.int64)
    out[order] = np.repeat(distinct, np.diff(np.append(head, n)))
    return out


def covered(held: np.ndarray, least: int) -> np.ndarray:
    """Which tokens lie in a substring of LEAST tokens or more that is on so many distinct pages."""
    n = len(held)
    begins = np.zeros(n + 1, np.int32)
    hit = np.flatnonzero(held >= least)
    hit = hit[hit + LEAST <= n]
    begins[hit] += 1
    begins[hit + LEAST] -= 1
    return np.cumsum(begins[:-1]) > 0


def repeated(streams: list[np.ndarray], pages: np.ndarray) -> np.ndarray:
    """Which tokens lie in a substring of LEAST tokens or more that is on two or more distinct pages."""
    return covered(holders(streams, pages), 2)


#: An odd number and its inverse modulo 2^64.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Numbers(dict):
    """Word to number, in order of appearance."""

    def __missing__(self, word: str) -> int:
        got = self[word] = len(self)
        return got


class _Hashes(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: str) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 5)
        return got


def marks(hashes: np.ndarray, pages: np.ndarray, sizes: np.ndarray, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pages in a row, from the hashes of their tokens, the number of tokens of each page and of each block: places and keys of the
    windows that are the smallest of ``spread`` neighbours (1: of every window, 0: of none), and numbers and keys of the blocks of LEAST tokens or more."""
    n = len(hashes)
    back = np.cumprod(np.full(n + 1, _BACK, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(np.full(n, _STEP, np.uint64)))])
    ends = np.cumsum(sizes)
    numbers = np.flatnonzero(sizes >= LEAST)
    a, z = (ends - sizes)[numbers], ends[numbers]
    blocks = (sums[z] - sums[a]) * back[a] ^ sizes[numbers].astype(np.uint64)
    at = np.zeros(0, np.int64)
    if spread and n >= LEAST:
        window = (sums[LEAST:] - sums[:-LEAST]) * back[: n - LEAST + 1]
        window ^= window >> np.uint64(31)
        left = np.repeat(np.cumsum(pages), pages) - np.arange(n) - LEAST + 1  # windows of the page from each place on
        found = []
        if spread == 1:
            found.append(np.flatnonzero(left[: len(window)] > 0))
        elif len(window) >= spread:
            whole = np.flatnonzero(left[: len(window) - spread + 1] >= spread)
            near = np.lib.stride_tricks.sliding_window_view(window, spread)
            for lo in range(0, len(whole), 1 << 16):
                own = whole[lo : lo + (1 << 16)]
                found.append(own + near[own].argmin(axis=1))
        starts = np.cumsum(pages) - pages
        for x in starts[(pages >= LEAST) & (pages < LEAST + spread - 1)].tolist():  # pages of one span or less
            found.append(np.array([x + int(window[x : x + int(left[x])].argmin())]))
        at = np.unique(np.concatenate(found)) if found else at
        return at, window[at].view(np.int64), numbers, blocks.view(np.int64)
    return at, at, numbers, blocks.view(np.int64)


def kept_blocks(html: str | None) -> list[tuple[str, int]]:
    """(text, kind) of the blocks that markup alone doesn't drop: 1 for a block of the article, 3 for its headings, 2 for one that attributes name aside, else 0."""
    blocks = blocks_of(html)
    own = any(b.article and not b.side for b in blocks)
    return [(b.text, 2 if b.side else 3 if b.article and b.heading else int(b.article)) for b in blocks if (b.hinted or not b.side) and (b.article or not own)]


def _frame(kinds: list[int], often: list[bool]) -> set[int]:
    """Places of the often repeated blocks that begin or end an article; headings neither go nor end the frame."""
    out: set[int] = set()
    for places in (range(len(kinds)), range(len(kinds) - 1, -1, -1)):
        for i in places:
            if kinds[i] == 1:
                if not often[i]:
                    break
                out.add(i)
    return out


def _minority(sizes: list[int], kinds: list[int], frame: set[int]) -> int:
    """1 if the frame is at most half of the article's tokens, else -1."""
    own = [n if kind == 1 else 0 for n, kind in zip(sizes, kinds)]
    return 1 if 2 * sum(own[i] for i in frame) <= sum(own) else -1


def _shard(rows: list[tuple], far: dict[int, int] | None = None, of_host: int = 0, votes: dict[int, int] | None = None) -> list[tuple[str, int]]:
    """(text, covered tokens outside articles) of each (page key, kept_blocks) of one shard of a host; far: on how many pages of the whole host the
    keys stand that other shards have too; of_host: the host's distinct pages, if this shard isn't all of it; votes: then by block key, on how
    many of its pages the block is in a frame that is a minority of the article, less the others."""
    pages = [blocks for _, blocks in rows]
    vocab = _Numbers()
    lengths = [np.array([t.count(" ") + 1 for t, _ in p], np.int64) for p in pages]
    streams = [np.fromiter(map(vocab.__getitem__, " ".join([t for t, _ in p]).split(" ")), np.int64, int(n.sum())) if p else np.zeros(0, np.int64) for p, n in zip(pages, lengths)]
    ids = {k: i for i, k in enumerate(dict.fromkeys(page for page, _ in rows))}
    held = holders(streams, np.array([ids[page] for page, _ in rows], np.int64))
    on: dict[str, set[int]] = {}  # pages of this shard on which a block stands as a whole
    for (page, blocks), sizes in zip(rows, lengths):
        for (text, _), size in zip(blocks, sizes.tolist()):
            if size >= LEAST:
                on.setdefault(text, set()).add(ids[page])
    whole_n = np.zeros(sum(map(len, lengths)), np.int64)  # of each block: on how many pages of the host it stands, if other shards have it
    named = np.zeros(len(whole_n), np.int64)  # keys of the blocks
    if far or votes:
        far = far or {0: 0}
        keys = np.array(sorted(far), np.int64)
        counts = np.array([far[k] for k in keys.tolist()], np.int64)

        def known(own: np.ndarray) -> np.ndarray:
            i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            return np.where(keys[i] == own, counts[i], 0)

        hashes = np.fromiter(map(_Hashes().__getitem__, vocab), np.uint64, len(vocab))
        n = np.array([len(x) for x in streams], np.int64)
        places, windows, numbers, whole = marks(hashes[np.concatenate(streams)], n, np.concatenate(lengths), 1)
        named[numbers] = whole
        places = places + np.searchsorted(np.cumsum(n), places, side="right")  # separators in front
        held[places] = np.maximum(held[places], known(windows))
        whole_n[numbers] = known(whole)
    cover = covered(held, 2)
    least = max(OFTEN, SHARE * max(of_host, len(ids)))
    out, at, k, frames = [], 0, 0, []
    small: dict[str, int] = {}  # of a frame's block: pages on which the frame is a minority of the article, less the others
    for blocks, sizes in zip(pages, lengths):
        often = [max(whole_n[k + i], len(on.get(text, ()))) >= least for i, (text, _) in enumerate(blocks)]
        frames.append(_frame([kind for _, kind in blocks], often))
        vote = _minority(sizes.tolist(), [kind for _, kind in blocks], frames[-1]) if frames[-1] else 0
        for i in frames[-1]:
            small[blocks[i][0]] = votes.get(int(named[k + i]), 0) if votes else small.get(blocks[i][0], 0) + vote
        k += len(blocks)
    k = 0
    for blocks, sizes, frame in zip(pages, lengths, frames):
        kept, hinted, total = [], [], 0
        for i, ((text, kind), size) in enumerate(zip(blocks, sizes.tolist())):
            c = cover[at : at + size]
            if whole_n[k] > 1:
                c = np.ones(size, bool)
            at, k = at + size, k + 1
            if kind in (1, 3):
                if i not in frame or small[text] <= 0:
                    kept.append(text)
                continue
            n = int(c.sum())
            total += n
            to = hinted if kind == 2 else kept
            if not n:
                to.append(text)
            elif n < size:  # the unique runs of a partly covered block
                to.append(" ".join(x for x, skip in zip(text.split(" "), c.tolist()) if not skip))
        at += 1
        out.append(("\n\n".join(kept or hinted), total))  # where words of attributes leave nothing, repetition decides
    return out


def host_of(url: str | Column) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1))


#: Stands among the keys for: the page has blocks outside articles.
_ASKS = 0


def _hashed(html: pa.Array, hashes: _Hashes, spread: int) -> tuple:
    """kept_blocks and block sizes of pages, and their marks."""
    if len(hashes) > 300_000:
        hashes.clear()
    blocks = [kept_blocks(x) for x in texts(html)]
    lengths = [[t.count(" ") + 1 for t, _ in p] for p in blocks]
    words = " ".join([t for p in blocks for t, _ in p]).split(" ") if any(blocks) else []
    flat = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return blocks, lengths, marks(flat, np.array([sum(p) for p in lengths], np.int64), np.array([n for p in lengths for n in p], np.int64), spread)


def _far_counts(src: DataFrame, every: bool) -> DataFrame:
    """(_host, _shard, _key, _n): on how many distinct pages of each shard of a large host a key stands: of the whole blocks (and _ASKS), or of every window.

    Tasks count the pages that have one row (null _twice) and name the others, whose rows count once together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for lo, hi in text_slices(b.column("_html")):
                host, shard = (b.column(c).slice(lo, hi - lo).to_numpy() for c in ("_host", "_shard"))
                many = b.column("_twice").slice(lo, hi - lo)
                named, page = many.is_valid().to_numpy(zero_copy_only=False), many.fill_null(0).to_numpy()
                blocks, lengths, (places, windows, numbers, whole) = _hashed(b.column("_html").slice(lo, hi - lo), hashes, int(every))
                if every:
                    of, own = np.searchsorted(np.cumsum([sum(p) for p in lengths]), places, side="right"), windows
                else:
                    asks = [i for i, p in enumerate(blocks) if any(kind in (0, 2) for _, kind in p)]
                    of = np.concatenate([np.array(asks, np.int64), np.repeat(np.arange(len(blocks)), [len(p) for p in blocks])[numbers]])
                    own = np.concatenate([np.full(len(asks), _ASKS, np.int64), whole])
                rows = np.unique(np.stack([of, own], axis=1), axis=0)  # a page counts once
                own = rows[:, 0]
                keys, n = np.unique(np.stack([host[own], shard[own].astype(np.int64), rows[:, 1], named[own].astype(np.int64), page[own]], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1].astype(np.int32)), pa.array(keys[:, 2]), pa.array(keys[:, 4], mask=keys[:, 3] == 0), pa.array(n.astype(np.int32))], ["_host", "_shard", "_key", "_twice", "_n"])

    found = src.select("_host", "_shard", "_twice", "_html").mapInArrow(run, "_host long, _shard int, _key long, _twice long, _n int").repartition("_host", "_key")
    return found.groupBy("_host", "_key", "_shard").agg((F.coalesce(F.sum(F.when(F.col("_twice").isNull(), F.col("_n"))), F.lit(0)) + F.size(F.collect_set("_twice"))).alias("_n"))


def _frame_votes(src: DataFrame) -> DataFrame:
    """(_host, _key, _votes): on how many pages a block is in a frame that is a minority of the article, less the others; _often: keys of the blocks on many of the host's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for lo, hi in text_slices(b.column("_html")):
                part = b.slice(lo, hi - lo)
                blocks, lengths, (_, _, numbers, whole) = _hashed(part.column("_html"), hashes, 0)
                named, k, votes = dict(zip(numbers.tolist(), whole.tolist())), 0, {}
                for host, often, page, sizes in zip(part.column("_host").to_pylist(), map(set, part.column("_often").to_pylist()), blocks, lengths):
                    kinds = [kind for _, kind in page]
                    frame = _frame(kinds, [named.get(k + i) in often for i in range(len(page))])
                    vote = _minority(sizes, kinds, frame) if frame else 0
                    for i in frame:
                        votes[host, named[k + i]] = votes.get((host, named[k + i]), 0) + vote
                    k += len(page)
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.int64()), pa.array([x for _, x in votes], pa.int64()), pa.array(list(votes.values()), pa.int64())], ["_host", "_key", "_votes"])

    return src.select("_host", "_often", "_html").mapInArrow(run, "_host long, _key long, _votes long").groupBy("_host", "_key").agg(F.sum("_votes").cast("int").alias("_votes"))


def _far(src: DataFrame, hosts: DataFrame, small) -> DataFrame:
    """(_host, _shard, _key, _n, _votes): keys that several shards of a large host hold, with the distinct pages of the host that have them, for each of those shards; and the
    frame votes for every shard. hosts: (_host, _shards, _pages)."""
    blocks = checkpointed(_far_counts(src, False))
    asking = blocks.filter(F.col("_key") == _ASKS).select("_host").distinct()
    held = blocks.filter(F.col("_key") != _ASKS).union(_far_counts(src.join(small(asking), "_host", "left_semi"), True))
    every = Window.partitionBy("_host", "_key")  # a row a shard
    held = held.withColumn("_all", F.sum("_n").over(every)).withColumn("_held_by", F.count(F.lit(1)).over(every))
    counts = held.filter("_held_by > 1").select("_host", "_shard", "_key", F.col("_all").cast("int").alias("_n"), F.lit(None).cast("int").alias("_votes"))
    whole = blocks.filter(F.col("_key") != _ASKS).groupBy("_host", "_key").agg(F.sum("_n").alias("_all"))
    often = whole.join(hosts, "_host").filter(F.col("_all") >= F.greatest(F.lit(OFTEN), SHARE * F.col("_pages"))).groupBy("_host").agg(F.collect_list("_key").alias("_often"))
    votes = _frame_votes(src.select("_host", "_html").join(small(checkpointed(often)), "_host")).join(hosts, "_host")
    shards = F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)).alias("_shard")
    return counts.union(votes.select("_host", shards, "_key", F.lit(None).cast("int").alias("_n"), "_votes"))


def _parsed(src: DataFrame) -> DataFrame:
    """(_host, _shard, _page, _id, _url, _blocks): kept_blocks of every page, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_slices(b.column("_html")):
                part = b.slice(lo, hi - lo)
                packed = [zlib.compress(json.dumps(kept_blocks(x), ensure_ascii=False).encode("utf-8", "replace"), 1) for x in texts(part.column("_html"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(packed, pa.binary())], [*names, "_blocks"])

    names = ["_host", "_shard", "_pages", "_page", "_id", "_url"]
    return src.select(*names, "_html").mapInArrow(run, "_host long, _shard int, _pages long, _page long, _id long, _url string, _blocks binary")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, repeated_tokens) of every page."""
    src = pages.select(F.col("page_id").cast("long").alias("_id"), F.col("url").cast("string").alias("_url"), F.col("html").cast("string").alias("_html"))
    src = src.withColumn("_host", F.xxhash64(host_of("_url"))).withColumn("_page", F.when(F.col("_id").isNull(), F.xxhash64("_url")).otherwise(F.xxhash64("_id")))
    chars = F.sum(F.coalesce(F.length("_html"), F.lit(0)))
    large = src.groupBy("_host").agg(F.ceil(chars / SHARD_CHARS).cast("int").alias("_shards")).filter("_shards > 1")
    large = checkpointed(large)
    n = large.count()
    small = lambda df: F.broadcast(df) if n <= BROADCAST_HOSTS else df
    # rows and distinct pages of large hosts; pages of several rows are few
    rows_of = src.join(small(large.select("_host")), "_host").groupBy("_host", "_page").agg(F.count(F.lit(1)).alias("_rows"))
    rows_of = checkpointed(rows_of) if n else rows_of
    sizes = rows_of.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    hosts = small(large.join(sizes, "_host"))
    src = src.join(hosts, "_host", "left")
    src = src.withColumn("_shard", F.coalesce(F.pmod("_page", "_shards"), F.lit(0)).cast("int"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("_key", "long"), ("_n", "int"), ("_votes", "int"))]
    rows = _parsed(src).select("_host", "_shard", *none, "_pages", "_page", "_id", "_url", "_blocks")
    if n:
        absent = [F.lit(None).cast(kind).alias(c) for c, kind in (("_pages", "long"), ("_page", "long"), ("_id", "long"), ("_url", "string"), ("_blocks", "binary"))]
        twice = rows_of.filter("_rows > 1").select("_host", "_page", F.col("_page").alias("_twice"))
        far = _far(src.filter("_shards is not null").drop("_pages", "_shards").join(twice, ["_host", "_page"], "left"), hosts, small)
        rows = rows.union(far.select("_host", "_shard", "_key", "_n", "_votes", *absent))
    # a shard's keys come before its pages
    rows = rows.repartition("_host", "_shard").sortWithinPartitions("_host", "_shard", F.col("_key").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        far: dict[int, int] = {}
        votes: dict[int, int] = {}
        shard = None

        def out() -> Iterator[pa.RecordBatch]:
            done = _shard([(r[1], json.loads(zlib.decompress(r[4]))) for r in held], far, max(r[0] or 0 for r in held), votes)
            for lo in range(0, len(held), 2000):
                part, own = held[lo : lo + 2000], done[lo : lo + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[2] for r in part], pa.int64()), pa.array([r[3] for r in part], pa.string()), pa.array([t for t, _ in own], pa.string()), pa.array([len(t) for t, _ in own], pa.int64()), pa.array([n for _, n in own], pa.int32())],
                    ["page_id", "url", "text", "n_chars", "repeated_tokens"],
                )

        for b in batches:
            for host, number, key, n, vote, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (host, number) != shard:
                    if held:
                        yield from out()
                    held, far, votes, shard = [], {}, {}, (host, number)
                if key is None:
                    held.append(tuple(row))
                elif n is None:
                    votes[key] = vote
                else:
                    far[key] = n
        if held:
            yield from out()

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, repeated_tokens int")
