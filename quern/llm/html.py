"""Main text of web pages, with a host's repeated boilerplate found by suffix arrays.

Each page becomes blocks of text, and the blocks of all pages are token streams.  A suffix array over the streams of a host
finds runs of ``LEAST_RUN`` tokens and more that distinct pages share.  A block repeats as often as the runs that cover most of it; the array
holds it for boilerplate if that is on more than twice as many pages as the page's own text, which is the least repeated fifth of its words.
So the text of a page that has copies, or shares its article with other pages, stays, however many they are, and lines that all the host
repeats go from the copies too.

Markup checks what the array says.  Blocks of navigation, headers, footers, side bars, notices, adverts, forms
and comments go even where no other page has them.  Blocks inside an article landmark stay even where the array holds them for boilerplate, as
copies and shared passages are part of an article; how much of the text that is comes with it.  All other blocks are for the array to
decide.  Unique ones stay if no landmark decides: on pages without one, on pages where they outweigh what is in the landmark (a
teaser), and inside a landmark where only a name such as ``related-work`` hints at boilerplate.

Over a table, pages lie in shards of bounded size with a suffix array for each host; their runs, with their numbers of pages, are summed by hash over
all shards (``quern.llm.shards``), so a host may have any number of pages and the result doesn't depend on how pages are dealt.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import shards
from quern.llm.common import small_batches, table

LEAST_RUN = 6
COVERED = 0.5
OWN_SHARE = 0.2
#: characters of a shard, with 200 a page and 20 a block
SHARD_CHARS = 4 << 20
#: parts of all runs that are exchanged one after the other, so that only one is on disk at a time
PASSES = 2
#: rows are blobs of a shard, so the writer looks at each and ends row groups early; that bounds what writing and reading hold
FEW_BLOBS = shards.FEW_BLOBS

# Element and name lists of HTML.
BOILERPLATE_TAGS = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "button", "select", "option", "textarea", "input", "menu", "dialog", "iframe", "object", "svg", "canvas", "audio", "video", "map", "datalist", "label", "fieldset", "title"}
BLOCK_TAGS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "template", "tfoot", "th", "thead", "title", "tr", "ul"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW_TAGS = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
TEXT_INSIDE = {"header", "label", "fieldset"}  # may be main text inside a landmark
ARTICLE_NAMES = {"ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promoted", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "newsletter", "subscribe", "subscription", "signup", "sidebar", "sidebars", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "commentlist", "disqus", "share", "sharing", "social"}
OTHER_NAMES = {"alert", "respond", "replies", "reply", "related", "recommended", "recommendations", "popup", "modal", "overlay", "widget", "widgets", "toolbar", "pagination", "pager", "login", "search"}
STATE_NAMES = {"has", "is", "no", "not", "with", "without"}
COMMENT_NAMES = {"comment", "comments", "reply", "replies"}
PLAIN_NAMES = {"area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "entry", "form", "global", "group", "header", "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "local", "main", "outer", "page", "panel", "post", "posts", "primary", "reader", "right", "row", "secondary", "section", "site", "slot", "text", "top", "unit", "user", "wrap", "wrapper"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

ARTICLE, OPEN, HINTED, RULED_OUT = 1, 2, 3, 4


def _named(tokens: list[str], inside: int, landmark: bool) -> tuple[bool, bool]:
    """(class names or ids say that an element is boilerplate, they only hint at it).

    They say it if a name has no part but boilerplate names and plain ones, as in ``share-buttons``; outside of landmarks
    also if it begins or ends with one, as in ``advert-300x250``, but not in ``has-sidebar``.  Inside a landmark, names
    that article text may have too, such as ``search``, only hint.
    """
    says = hints = False
    known = COMMENT_NAMES if landmark else ARTICLE_NAMES | OTHER_NAMES | (set() if inside else {"header"})
    for token in tokens:
        in_order = [p.lower() for p in _NAME.findall(token)]
        parts = set(in_order)
        if parts & known:
            pure = all(p in known or p in PLAIN_NAMES or p.isdigit() for p in parts)
            at_ends = not inside and not landmark and {in_order[0], in_order[-1]} & ARTICLE_NAMES and in_order[0] not in STATE_NAMES
            if at_ends or pure and (not inside or landmark or parts & ARTICLE_NAMES):
                says = True
            else:
                hints = True
    return says, hints


def _kind(tag: str, raw_attributes: str, inside: int) -> tuple[bool, bool, bool]:
    """(is boilerplate, is an article landmark, has a name that hints at boilerplate) of an element; ``inside``: how many landmarks it is in."""
    landmark, hinted = tag in ("article", "main"), False
    boilerplate = tag in BOILERPLATE_TAGS and not (inside and tag in TEXT_INSIDE)
    if raw_attributes and not raw_attributes.isspace():
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw_attributes)}
        role = attributes.get("role", "").lower()
        landmark = landmark or role in ("main", "article") or attributes.get("itemprop") == "articleBody"
        boilerplate = boilerplate or role in BOILERPLATE_ROLES
        if tag not in ("html", "body"):
            says, hinted = _named(f"{attributes.get('class', '')} {attributes.get('id', '')}".split(), inside, landmark)
            boilerplate = boilerplate or says
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
            boilerplate = True
    return boilerplate, landmark and not boilerplate, hinted


def page_blocks(html: str | None) -> list[tuple[str, str, int]]:
    """The ``all_blocks`` that markup doesn't rule out."""
    return [b for b in all_blocks(html) if b[2] != RULED_OUT]


def all_blocks(html: str | None) -> list[tuple[str, str, int]]:
    """(tag, text, zone) of each block but scripts and styles, in page order; zone: ARTICLE, OPEN (outside), HINTED (inside), or RULED_OUT by markup."""
    html = html or ""
    blocks: list[tuple[str, str, int]] = []
    stack: list[tuple[str, int, int, int]] = []
    opened: Counter[str] = Counter()
    ruled_out = inside = hinted = at = 0
    parts: list[str] = []
    block_tag = "body"

    def end_block():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((block_tag, text, RULED_OUT if ruled_out else (HINTED if hinted else ARTICLE) if inside else OPEN))
            parts.clear()

    def leave(depth: int):
        nonlocal ruled_out, inside, hinted
        while len(stack) > depth:
            if stack[-1][1]:
                end_block()
            tag, *marks = stack.pop()
            opened[tag] -= 1
            ruled_out, inside, hinted = (x - y for x, y in zip((ruled_out, inside, hinted), marks))

    while at < len(html):
        m = _TAG.search(html, at)
        stop = m.start() if m else len(html)
        if stop > at:
            parts.append(unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if tag in BLOCK_TAGS:
            end_block()
            block_tag = tag
        if m[1] or m[4]:
            for depth in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[depth][0] == tag:
                    if tag in BOILERPLATE_TAGS or any(stack[depth][1:]):
                        end_block()
                    leave(depth)
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        if tag == "p" and opened["p"]:  # a paragraph ends the one before it
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    leave(depth)
                    break
                if stack[depth][0] in BLOCK_TAGS:
                    break
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS and tag not in RAW_TAGS:
            continue
        boilerplate, landmark, hint = _kind(tag, attributes, inside)
        if boilerplate or landmark or hint:
            end_block()
        if tag in RAW_TAGS:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        hint = hint and inside > 0
        stack.append((tag, int(boilerplate), int(landmark), int(hint)))
        opened[tag] += 1
        ruled_out += boilerplate
        inside += landmark
        hinted += hint
    end_block()
    return blocks


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of an integer sequence, and the length of what each suffix shares with the one before it.

    Prefix doubling; only suffixes that still share their rank are sorted again.
    """
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    names = tokens - tokens.min() if np.ptp(tokens) < 4 * n else np.unique(tokens, return_inverse=True)[1]
    sizes = np.bincount(names)
    levels = [(np.cumsum(sizes) - sizes)[names]]  # a rank is the place where its group begins
    tied, step = np.flatnonzero(sizes[names] > 1), 1
    while len(tied):
        rank = levels[-1]
        later = np.zeros(len(tied), np.int64)
        within = tied + step < n
        later[within] = rank[tied[within] + step] + 1
        by = rank[tied] * (n + 1) + later
        order = np.argsort(by)
        tied, by = tied[order], by[order]
        old = rank[tied]
        place = np.arange(len(tied))
        new_group = np.concatenate(([True], by[1:] != by[:-1]))
        old_group = np.concatenate(([True], old[1:] != old[:-1]))
        begins = np.maximum.accumulate(np.where(new_group, place, 0))
        rank = rank.copy()
        rank[tied] = old + begins - np.maximum.accumulate(np.where(old_group, place, 0))
        levels.append(rank)
        alone = new_group & np.concatenate((new_group[1:], [True]))
        tied, step = tied[~alone], step * 2
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    a, b = order[1:].copy(), order[:-1].copy()
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # equal ranks at the ends may stand for shorter suffixes; no two suffixes are equal
        inside = np.flatnonzero(np.maximum(a, b) + (1 << k) <= n)
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        shared[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, np.concatenate(([0], shared))


def _begins(ordered: np.ndarray) -> np.ndarray:
    """Where each group of equal values begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def shared_runs(streams: list[np.ndarray], least_run: int = LEAST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, begin, pages) for one place of each run of ``least_run`` tokens: how many streams have it, from a suffix array."""
    sizes = np.array([len(s) for s in streams], np.int64)
    names = np.unique(np.concatenate(streams), return_inverse=True)[1] if len(streams) else np.empty(0, np.int64)
    ends = np.cumsum(sizes + 1)
    whole = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    inner = np.ones(len(whole), bool)
    inner[ends - 1] = False
    whole[inner] = names
    whole[~inner] = len(names) + np.arange(len(streams))  # a token of its own ends each stream
    page = np.repeat(np.arange(len(streams)), sizes + 1)
    order, shared = suffix_array(whole)
    group = np.cumsum(shared < least_run) - 1
    full = (order + least_run <= ends[page[order]] - 1) if len(whole) else np.empty(0, bool)  # the run lies within its stream
    pairs = np.sort(group[full] * (len(streams) + 1) + page[order][full])
    runs = pairs[_begins(pairs)] // (len(streams) + 1)
    own = _begins(runs)
    kept, pages = runs[own], np.diff(own, append=len(runs))
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
    place = order[first[kept]]
    return page[place], place - (ends - sizes - 1)[page[place]], pages


def _hashed(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, eight bytes of all of them at a time."""
    data, starts, ends = shards.text_bytes(strings)
    out = (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    rest = np.arange(len(starts))
    while len(rest := rest[starts[rest] < ends[rest]]):
        lane = np.ascontiguousarray(eight[starts[rest]]).view("<u8").ravel()
        beyond = 8 * np.maximum(0, starts[rest] + 8 - ends[rest]).astype(np.uint64)
        mixed = (out[rest] ^ (lane << beyond)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        out[rest] = mixed ^ (mixed >> np.uint64(29))
        starts[rest] += 8
    return out


class _Stream:
    """The tokens of some blocks of a shard, page after page, and the hash of host and run at each place where ``least_run`` tokens of a page begin."""

    def __init__(self, blocks: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, page: np.ndarray, salts: np.ndarray, least_run: int):
        self.blocks, self.tokens, self.page, self.least_run = blocks, tokens, page, least_run
        self.begins = np.cumsum(sizes) - sizes
        n = max(0, len(tokens) - least_run + 1)
        self.places = np.flatnonzero(page[:n] == page[len(page) - n :])
        keys = salts[page[:n]]
        for k in range(least_run if n else 0):
            keys = (keys ^ tokens[k : k + n]) * np.uint64(0x9E3779B185EBCA87)
            keys ^= keys >> np.uint64(29)
        self.at_place, self.keys = keys, keys[self.places]

    def runs(self, host: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(hashes, numbers of pages) of all runs, with a suffix array for each host; ``host`` is that of each page, in order."""
        keys, pages = [], []
        own = host[self.page]
        for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(own)) + 1) if len(own) else ():
            begins = np.concatenate(([0], np.flatnonzero(np.diff(self.page[part])) + 1))
            page, begin, n = shared_runs(np.split(self.tokens[part], begins[1:]), self.least_run)
            keys.append(self.at_place[part[0] + begins[page] + begin])
            pages.append(n)
        return keys, pages

    def repeats(self, counts: np.ndarray) -> np.ndarray:
        """On how many pages each block is: the greatest number that ``COVERED`` of its tokens reach; ``counts`` are those of the runs, in order."""
        level = np.ones(len(self.tokens), np.int64)
        for k in range(self.least_run):
            level[self.places + k] = np.maximum(level[self.places + k], counts)
        if not len(self.begins):
            return np.empty(0, np.int64)
        out = np.ones(len(self.begins), np.int64)
        ends = np.append(self.begins[1:], len(level))
        for i in np.flatnonzero(np.maximum.reduceat(level, self.begins) > 1):
            a, b = self.begins[i], ends[i]
            out[i] = np.sort(level[a:b])[::-1][max(0, int(np.ceil(COVERED * (b - a))) - 1)]
        return out


PAGES = pa.schema([("host", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("tags", pa.list_(pa.string())), ("parts", pa.list_(pa.string())), ("zones", pa.list_(pa.int8()))])


class Shard:
    """Some pages, ordered by host, with two kinds of streams.

    One has the blocks that markup leaves open (with a token for each whole block of an article between them), the other the
    blocks on which markup has a say: articles, and what it rules out.  Runs of the two are counted apart, as a text that other pages have
    as their article is no boilerplate where it is open.
    """

    def __init__(self, pages: pa.Table, least_run: int = LEAST_RUN):
        import xxhash

        self.pages = pages.combine_chunks()
        column = lambda name: pa.concat_arrays(self.pages[name].chunks) if len(self.pages) else pa.array([], PAGES.field(name).type)
        parts, hosts = column("parts"), column("host").to_pylist()
        counts = parts.value_lengths().to_numpy()
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.texts, self.zones = parts.flatten(), column("zones").flatten().to_numpy()
        self.host = np.cumsum([0, *(a != b for a, b in zip(hosts, hosts[1:]))])
        page = np.repeat(np.arange(len(counts)), counts)
        split = pc.split_pattern(self.texts, " ")
        self.lengths = split.value_lengths().to_numpy()
        words, tags = _hashed(split.flatten()), _hashed(pc.binary_join_element_wise("<", column("tags").flatten(), ">", ""))
        article, ruled_out = self.zones == ARTICLE, self.zones == RULED_OUT
        left_open = np.zeros(len(counts), bool)
        left_open[page[~article & ~ruled_out]] = True
        self.streams = []
        for kind, chosen, whole in (("open", left_open[page] & ~ruled_out, article), ("marked", article | ruled_out, np.zeros(len(article), bool))):
            salts = np.array([xxhash.xxh64_intdigest(f"{kind} {h}".encode("utf-8", "surrogatepass")) for h in hosts], np.uint64)
            blocks = np.flatnonzero(chosen)
            sizes = np.where(whole, 1, self.lengths)[blocks] + 1
            tokens = np.empty(int(sizes.sum()), np.uint64)
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(sizes) - sizes] = False
            as_one = np.repeat(whole[blocks], sizes - 1)
            text = np.empty(len(as_one), np.uint64)
            text[~as_one] = words[np.repeat(chosen & ~whole, self.lengths)]
            text[as_one] = _hashed(self.texts.filter(pa.array(chosen & whole)))
            tokens[~inner], tokens[inner] = tags[blocks], text
            self.streams.append(_Stream(blocks, sizes, tokens, np.repeat(page[blocks], sizes), salts, least_run))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes of all runs of the shard, the number of its pages with each)."""
        keys, pages = (np.concatenate([np.empty(0, kind), *sum(found, [])]) for kind, found in zip((np.uint64, np.int64), zip(*(s.runs(self.host) for s in self.streams))))
        order = np.argsort(keys)
        begins = _begins(keys[order])
        return keys[order][begins], np.add.reduceat(pages[order], begins) if len(begins) else pages

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(the hashes of ``runs``, the place among them of each run of the streams)."""
        keys = np.concatenate([s.keys for s in self.streams])
        order = np.argsort(keys)
        begins = _begins(keys[order])
        place = np.empty(len(keys), np.int64)
        place[order] = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(keys)))
        return keys[order][begins], place

    def main_texts(self, pages: np.ndarray) -> list[tuple[str, int, int]]:
        """``_main_text`` of each page; ``pages`` is the number of pages of the whole host with each run of the streams."""
        repeats = np.ones(len(self.zones), np.int64)
        for stream, counts in zip(self.streams, np.split(pages, [len(self.streams[0].keys)])):
            found = stream.repeats(counts)
            own = (self.zones[stream.blocks] != ARTICLE) | (stream is self.streams[1])
            repeats[stream.blocks[own]] = found[own]
        blocks = list(zip(self.texts.to_pylist(), self.zones.tolist(), (self.lengths + 1).tolist(), repeats.tolist()))
        return [_main_text(blocks[a:b]) for a, b in zip(self.first.tolist(), self.first[1:].tolist())]


def _own_level(blocks: list[tuple[int, int]]) -> int:
    """The number of pages that the least repeated ``OWN_SHARE`` of a page has; ``blocks``: (pages, size)."""
    seen, level, least = 0, 1, OWN_SHARE * sum(size for _, size in blocks)
    for level, size in sorted(blocks):
        seen += size
        if seen >= least:
            break
    return level


def _main_text(blocks: list[tuple[str, int, int, int]]) -> tuple[str, int, int]:
    """(main text of a page, how many of its characters the array holds for boilerplate, how many of the blocks that markup rules out it does); ``blocks``: (text, zone, size, pages)."""
    most = _own_level([(1 if zone == ARTICLE else n, size) for _, zone, size, n in blocks if zone != RULED_OUT])
    left = [b for b in blocks if b[1] == ARTICLE or b[1] != RULED_OUT and b[3] <= 2 * most]
    outside = sum(size for _, zone, size, _ in left if zone == OPEN) > sum(size for _, zone, size, _ in left if zone != OPEN)
    kept = [b for b in left if outside or b[1] != OPEN]
    level = _own_level([(n, size) for _, zone, size, n in blocks if zone != RULED_OUT])
    repeated = sum(len(text) for text, zone, _, n in kept if zone == ARTICLE and n > 2 * level)
    return "\n".join(b[0] for b in kept), repeated, sum(zone == RULED_OUT and n > 2 * level for _, zone, _, n in blocks)


def _pages(rows: list[tuple]) -> pa.Table:
    """A table of (host, page_id, url, blocks), ordered by host."""
    rows = sorted(rows, key=lambda r: r[0])
    columns = [pa.array([r[i] for r in rows], PAGES.field(i).type) for i in range(3)]
    ends = pa.array(np.cumsum([0, *(len(r[3]) for r in rows)]), pa.int32())
    blocks = [b for r in rows for b in r[3]]
    columns += [pa.ListArray.from_arrays(ends, pa.array([b[i] for b in blocks], PAGES.field(3 + i).type.value_type)) for i in range(3)]
    return pa.table(columns, schema=PAGES)


def main_texts(pages: list[str | None], *, least_run: int = LEAST_RUN) -> list[str]:
    """Main text of each page of one host: blocks joined by line ends."""
    shard = Shard(_pages([("", i, None, all_blocks(h)) for i, h in enumerate(pages)]), least_run)
    return [text for text, _, _ in shard.main_texts(shard.runs()[1][shard.places()[1]])]


def _packed(pages: pa.Table) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pages.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_table(pages)
    return sink.getvalue()


def _unpacked(blob: pa.Scalar) -> Shard:
    with pa.ipc.open_stream(blob.as_buffer()) as held:
        return Shard(held.read_all())


def _host_pages(group: pa.Table) -> pa.Table:
    """For each shard of a bucket, which of its runs are on several pages of all shards together, and on how many."""
    keys = [shards.unplaned(b.as_buffer(), "<u8") for b in group.column("c0")]
    own = np.concatenate([shards.unplaned(b.as_buffer(), "<u4") for b in group.column("c1")])
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    pages = np.bincount(place, own, len(found)).astype(np.uint32)[place]
    at, n = [], []
    for part in np.split(pages, np.cumsum([len(k) for k in keys])[:-1]):
        several = np.flatnonzero(part > 1)
        at.append(shards.planes(several.astype(np.uint32)))
        n.append(shards.planes(part[several]))
    return pa.table({"shard": group.column("shard"), "bucket": group.column("bucket"), "at": pa.array(at, pa.binary()), "n": pa.array(n, pa.binary())})


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_repeated, n_template) of every row of ``pages``.

    ``n_repeated`` is how many code points of the text lie in blocks that the host's suffix array holds for boilerplate and that stay since
    the page marks them as its article; ``n_template`` is how many of the blocks that markup rules out the array holds for boilerplate too.

    Cases: null and empty html have an empty text; pages with a null or odd url are one host; equal
    rows have equal texts, those of the page alone if the host has only copies of it; a page of any length is taken whole; other columns are ignored; an empty input gives no rows.
    """
    rows = pages.select(
        F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
    )

    def parse(batches):
        from pyspark import TaskContext

        shard, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row():
            tokens = sum(text.count(" ") + 2 for *_, blocks in held for _, text, _ in blocks)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([tokens], pa.int64()), shards.one_blob(_packed(_pages(held)))], names=["shard", "tokens", "pages"])

        for b in batches:
            for *page, html in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3)):
                blocks = all_blocks(html.as_py())
                held.append((*page, blocks))
                size += 200 + sum(len(text) + 20 for _, text, _ in blocks)
                if size >= SHARD_CHARS:
                    yield row()
                    shard, held, size = shard + 1, [], 0
        if held:
            yield row()

    whole = shards.settled(shards.byte_batches(small_batches(rows)).mapInArrow(parse, "shard long, tokens long, pages binary"), "page-shards", **FEW_BLOBS)
    buckets = shards.bucket_count(8 * (whole.agg(F.sum("tokens")).first()[0] or 0))
    cuts = [buckets * i // PASSES for i in range(PASSES + 1)]

    def send(low: int, high: int):
        def run(batches):
            for b, i in shards.shard_rows(batches):
                keys, n = _unpacked(b.column(1)[i]).runs()
                edges = shards.bucket_edges(keys, buckets)[low : high + 1]
                own = slice(edges[0], edges[-1])
                yield shards.sent(b.column(0)[i].as_py(), edges - edges[0], [keys[own], n[own].astype(np.uint32)], low)

        return run

    def finish(batches):
        for b, i in shards.shard_rows(batches):
            shard = _unpacked(b.column(1)[i])
            keys, place = shard.places()
            edges, counts = shards.bucket_edges(keys, buckets), np.ones(len(keys), np.int64)
            for item in b.column(2)[i].as_py() or []:
                counts[edges[item["bucket"]] + shards.unplaned(item["at"], "<u4").astype(np.int64)] = shards.unplaned(item["n"], "<u4")
            texts = [pa.array(c, k) for c, k in zip(zip(*shard.main_texts(counts[place])), (pa.string(), pa.int64(), pa.int64()))]
            ids, urls = (pa.concat_arrays(shard.pages[name].chunks) for name in ("page_id", "url"))
            yield pa.RecordBatch.from_arrays([ids, urls, *texts], names=["page_id", "url", "text", "n_repeated", "n_template"])

    blobs = shards.byte_batches(whole.select("shard", "pages"))
    found = None
    for low, high in zip(cuts, cuts[1:]):
        sent = blobs.mapInArrow(send(low, high), shards.sent_schema(2))
        part = shards.settled(sent.groupBy("bucket").applyInArrow(_host_pages, "shard long, bucket long, at binary, n binary"), "page-runs")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("shard").agg(F.collect_list(F.struct("bucket", "at", "n")).alias("found"))
    joined = blobs.join(found.hint("shuffle_hash"), "shard", "left").select("shard", "pages", "found")
    return joined.mapInArrow(finish, "page_id long, url string, text string, n_repeated long, n_template long")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_main_text(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated", "n_template")
