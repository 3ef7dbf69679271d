"""HTML extraction: a suffix array over each host's page token streams finds runs that distinct articles repeat.

A page is read once into blocks. The blocks' tokens of all pages of a host form one stream, with block ends between.
Its suffixes are named by prefix doubling: the name of a suffix's first 2k tokens is made of those of its first k and
of the k after them, so three doublings name the first RUN tokens, and equal names are the intervals of the suffix array
whose common prefix is at least RUN. Names are 128-bit hashes in place of ranks, so no doubling needs a join; an
order within an interval would decide nothing, as the union of all maximal repeats of RUN tokens or more is the union
of these windows.

A run is boilerplate if pages of at least DISTINCT different articles hold it: copies of one article count once, told
by the smallest window hash of a page's longest block. Covered tokens go, unique runs stay. Structure is the guard:
blocks of a marked article stay, though other pages may copy them, unless they are mostly links; what is marked as a
menu, footer, advert, form and the like goes, also where no other page repeats it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, saved, text_of

#: Tokens of the shortest run that counts as repeated. A shorter block counts as one run by itself. A power of two.
RUN = 8
#: Articles that must hold a run before it is boilerplate.
DISTINCT = 3
#: Into so many parts the pages that hold one run are dealt.
PARTS = 16
#: Up to so many places of covered runs are broadcast, 8 bytes each.
PLACES = 1_000_000

#: Elements whose text is never shown or never part of an article.
RAW = "script style noscript template iframe svg math object canvas audio video textarea select button".split()
CHROME = "nav footer aside form dialog menu search".split()
MAIN = ("article", "main")
#: Elements that begin and end a block.
BLOCK = set(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose nesting is followed.
NESTED = set("article main header nav footer aside form dialog menu search div section ul ol dl table head title details figure li a p span".split())
#: Words of class, id and role values that mark what is no article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead toolbar pagination pager comment comments disqus reply replies respond widget copyright legal disclaimer login footer complementary contentinfo dialog form".split()
)
#: These mark the page's head only outside an article.
HEAD_MARKS = set("header banner".split())
#: Elements that HTML closes by itself where the next one begins.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())


NAME = re.compile(r"[a-z][^\s/>]*", re.I)
TAG_END = re.compile(r"[\"'>]")
RAW_END = {name: re.compile(rf"</{name}(?![a-z0-9])", re.I) for name in RAW}


class Tags:
    """Reads the tags of a page from left to right, in time linear in the page whatever it holds."""

    def __init__(self, page: str):
        self.page = page
        self.failed: set[int] = set()  # quotes from which no end of a tag can be reached
        self.last = {c: page.rfind(c) for c in "\"'<>"}

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin here; > in quotes does not count; -1 if none does."""
        page, seen, i = self.page, [], at
        while i <= self.last[">"] and (m := TAG_END.search(page, i)):
            i = m.start()
            if page[i] == ">":
                return i
            if i in self.failed or i >= self.last[page[i]]:
                break
            seen.append(i)
            i = page.find(page[i], i + 1) + 1
        self.failed.update(seen)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, is it an end tag, attributes) of each tag; comments and the like have an empty name.

        A raw element, such as a script, is one tag with all its content. A tag without an end stops at the next < or
        at the page's end; one whose quotes do not match, at its first >.
        """
        page, size, at = self.page, len(self.page), 0
        while 0 <= (at := page.find("<", at)) < size - 1:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = size if end < 0 else end + 3
                yield at, end, "", False, ""
                at = end
                continue
            closing = page[at + 1] == "/"
            name = NAME.match(page, at + 1 + closing)
            if not name:
                if page[at + 1] in "!?/":
                    end = page.find(">", at) if at < self.last[">"] else -1
                    end = self.stop(at) if end < 0 else end + 1
                    yield at, end, "", False, ""
                    at = end
                else:
                    at += 1
                continue
            end = self.end(name.end())
            if end < 0:
                end = page.find(">", at) if at < self.last[">"] else -1
            attributes = page[name.end() : end if end >= 0 else self.stop(at)]
            stop = self.stop(at) if end < 0 else end + 1
            word = name[0].lower()
            if word in RAW_END and not closing and not attributes.endswith("/"):
                close = RAW_END[word].search(page, stop) if end >= 0 else None
                stop = size if close is None and end >= 0 else stop if close is None else page.find(">", close.end()) + 1 or size
                yield at, stop, "", False, " "
            else:
                yield at, stop, word, closing, attributes
            at = stop

    def stop(self, at: int) -> int:
        return self.page.find("<", at + 1) if at < self.last["<"] else len(self.page)


def marks(attributes: str) -> set[str]:
    found = re.findall(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", attributes, re.I)
    return set(re.split(r"[^a-z]+", " ".join(a or b or c for a, b, c in found).lower())) - {""} if found else set()


class Nesting:
    """Open elements and what they make of their content: main, chrome, link or nothing."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str]] = []
        self.open: Counter[str] = Counter()
        self.levels: list[Counter[str]] = [Counter()]  # what is open since each article began, itself included
        self.roles: Counter[str] = Counter()

    def push(self, name: str, role: str) -> None:
        if role == "main":
            self.levels.append(Counter())
        self.stack.append((name, role))
        self.open[name] += 1
        self.levels[-1][name] += 1
        self.roles[role] += 1

    def close(self, name: str) -> None:
        """Ends the innermost element of that name and all in it; within an article only its own end tag ends it."""
        if not (self.open[name] if name in MAIN else self.levels[-1][name]):
            return
        while True:
            last, role = self.stack.pop()
            self.open[last] -= 1
            self.levels[-1][last] -= 1
            self.roles[role] -= 1
            if role == "main":
                self.levels.pop()
            if last == name:
                return


def scan(page: str) -> tuple[list[tuple[str, str, bool]], bool]:
    """([(zone, text, mostly links)...] in page order, does the page mark an article).

    The zone is `main` in an article or main element, `chrome` where structure says it is no article, else `open`.
    """
    out: list[tuple[str, str, bool]] = []
    nest = Nesting()
    roles = nest.roles
    parts: list[str] = []
    linked = at = 0
    has_main = False

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                zone = "chrome" if roles["chrome"] else "main" if roles["main"] else "open"
                out.append((zone, text, 2 * linked > len(raw.strip())))
            parts.clear()
        linked = 0

    for start, end, name, closing, attributes in Tags(page):
        if start > at:
            parts.append(page[at:start])
            linked += start - at if roles["link"] else 0
        at = end
        if not name:
            if attributes:  # a raw element parts words, a comment does not
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name not in NESTED or name in VOID:
            continue
        if closing:
            nest.close(name)
            continue
        if name in ("p", "li", "span"):
            continue
        role = ""
        words = marks(attributes) if attributes else set()
        if name in CHROME or name in ("head", "title") or name == "header" and not roles["main"]:
            role = "chrome"
        elif name != "a" and (words & MARKS - HEAD_MARKS or words & HEAD_MARKS and not roles["main"]):
            role = "chrome"
        elif name in MAIN or "main" in words and name == "div":
            role = "main"
            has_main = has_main or not roles["chrome"]
        elif name == "a":
            role = "link"
        if not attributes.endswith("/"):
            nest.push(name, role)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out, has_main


def settled(page: str) -> tuple[list[tuple[str, str, bool]], list[bool | None]]:
    """The blocks and, for each, whether structure lets it stay; None where the host's suffix array decides."""
    blocks, has_main = scan(page)
    if has_main:
        return blocks, [False if z != "main" else None if much else True for z, _, much in blocks]
    return blocks, [False if z == "chrome" else None for z, _, _ in blocks]


def plain(text: str) -> list[str]:
    """Tokens as runs are compared: in lower case, any digit as 0."""
    return re.sub(r"\d", "0", text.lower()).split(" ")


def names(tokens: list[str]):
    """Two 64-bit lanes that name the first RUN tokens of every suffix that has so many; a shorter block is one suffix."""
    import numpy as np
    import xxhash

    whole = len(tokens) < RUN
    if whole:
        tokens = [" ".join(tokens) + "\n"]
    digests = [xxhash.xxh3_128_intdigest(t) for t in tokens]
    lanes = []
    for lane, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        name = np.array([d >> 64 * lane & (1 << 64) - 1 for d in digests], dtype=np.uint64)
        k = 1
        while k < RUN and not whole:
            first, second = name[:-k], name[k:]
            name = (first * np.uint64(odd) ^ (first >> np.uint64(32))) + second * np.uint64(k + k + 1)
            name ^= name >> np.uint64(29)
            k *= 2
        lanes.append(name.view(np.int64))
    return lanes


def stream_rows(batch: list[tuple]) -> Iterator[tuple]:
    """(u, v, host, html) -> (u, v, host, article, asks, [block, place, name a, name b of the page's suffixes]).

    Only blocks that structure does not keep have suffixes here; article tells the pages of different articles.
    """
    import numpy as np

    none = np.zeros(0, dtype=np.int64)
    for u, v, host, page in batch:
        blocks, stays = settled(page)
        lanes = {k: names(plain(t)) for k, ((_, t, _), stay) in enumerate(zip(blocks, stays)) if not stay}
        body = [k for k, stay in enumerate(stays) if stay is not False]
        longest = max(body, key=lambda k: len(blocks[k][1]), default=None)
        article = 0 if longest is None else int((lanes.get(longest) or names(plain(blocks[longest][1])))[0].min())
        sizes = [len(a) for a, _ in lanes.values()]
        places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if sizes else none
        a, b = (np.concatenate([x[i] for x in lanes.values()]) if sizes else none for i in (0, 1))
        yield u, v, host, article, None in stays, np.repeat(np.array(list(lanes), dtype=np.int32), sizes), places, a, b


def without(text: str, places: list[int]) -> str:
    """The text without the tokens that runs at these places cover; its other tokens are its unique runs."""
    tokens = text.split(" ")
    if len(tokens) < RUN:
        return ""
    gone = set()
    for i in places:
        gone.update(range(i, i + RUN))
    return " ".join(t for i, t in enumerate(tokens) if i not in gone)


def text_rows(batch: list[tuple]) -> Iterator[tuple]:
    """(page_id, url, html, covered places as block << 32 | place) -> (page_id, url, text)."""
    for key, url, page, covered in batch:
        blocks, stays = settled(page)
        hit: dict[int, list[int]] = {}
        for x in covered or ():
            hit.setdefault(x >> 32, []).append(x & 0xFFFFFFFF)
        kept = [without(t, hit[k]) if k in hit else t for k, ((_, t, _), stay) in enumerate(zip(blocks, stays)) if stay is not False]
        yield key, url, "\n".join(filter(None, kept))


def host_of(url: str) -> Column:
    """The host of a url in lower case, without a user or a port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def covered(rows: DataFrame) -> DataFrame:
    """(u, v, places): for each of rows(u, v, host, html) that asks, the places of runs that enough articles hold."""
    streams = saved(map_rows(rows, "u long, v long, host string, article long, asks boolean, block array<int>, place array<int>, a array<long>, b array<long>", stream_rows), "streams")
    suffix = streams.select("u", "v", "host", "article", "asks", F.explode(F.arrays_zip("block", "place", "a", "b")).alias("x")).select("u", "v", "host", "article", "asks", "x.*")
    name = ["host", "a", "b"]
    # an interval of the array; it matters only if a block that asks has a suffix in it. Copies of an article are summed
    # up on the map side, and distinct articles before they meet, so no host and no run is a hot key
    interval = suffix.join(streams.where("asks").select("host").distinct(), "host", "left_semi")
    interval = interval.groupBy(*name).agg(F.countDistinct("article").alias("n"), F.max("asks").alias("asked")).where((F.col("n") >= DISTINCT) & F.col("asked"))
    repeated = saved(interval.select(*name, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")), "repeated")
    asking = suffix.where("asks").withColumn("part", F.pmod(F.col("u"), F.lit(PARTS)).cast("int"))
    hits = asking.join(repeated, [*name, "part"]).select("u", "v", (F.shiftleft(F.col("block").cast("long"), 32) + F.col("place")).alias("x"))
    return hits.groupBy("u", "v").agg(F.collect_list("x").alias("places"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every row of pages; the text is empty if the page has none, or its html is null.

    Pages without a host (null or odd urls) are one host. Rows that share id, url and html are one page. A run counts
    the articles that hold it, so neither repeated rows nor copies of a page make their own text boilerplate. A null
    id is carried. Blocks are judged whole texts at a time, ties do not arise. Only the three columns are read; an empty
    table gives an empty table.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"), host_of(url_col).alias("host"))
    rows = rows.withColumns({"u": F.xxhash64("page_id", "url", "html"), "v": F.xxhash64(F.lit(1), "page_id", "url", "html")})
    gone = saved(covered(rows.select("u", "v", "host", "html")), "covered")
    if (gone.agg(F.sum(F.size("places") + 2)).first()[0] or 0) <= PLACES:
        gone = F.broadcast(gone)
    return map_rows(rows.join(gone, ["u", "v"], "left").select("page_id", "url", "html", "places"), "page_id long, url string, text string", text_rows)
