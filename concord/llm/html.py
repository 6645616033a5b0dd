"""Main text of web pages by wrappers: union-free expressions inferred per host.

A page becomes a token stream: its text blocks in page order, each named by the
path of its elements and their classes. What elements and names mark as no main
text (`DROPPED`, `DROPPED_NAMES`) takes no part, be it a block or within a line. A
name alone doesn't take away the text that a page is about (`_released`): where all
main elements of a page are within elements of such names, or, of names of layouts,
all articles, or most of the text of a page with neither, these names count for
nothing. Then, for each host:

1. A text that nearly all pages with its path have there is a literal, all other
   texts of a path are slots. Pages that differ are counted, copies once.
2. Streams of literals and slots are folded (tokens or groups that follow
   themselves become repeated groups, of up to 48 tokens or groups) and aligned one
   after another; a group that one repeats is a group in the other too. Where they
   differ, the mismatch becomes an optional group, or a repeated one if the tokens
   before it occur again; the text of a slot is never part of it. What results is a
   wrapper, such as

       "Best site" div/a+ h1 p+ "***"? p+ (h2 p+)+ "All rights"?

3. The wrapper tells template from main text. A literal with one place of its own,
   that no group repeats, is template; one found at several places, or within a
   repeated group, is part of the text, as are headings in article and main. A repeated group of blocks that are all
   links, outside of article and main, is a menu; a single block of links isn't.

A page gives the texts of its blocks that are neither: those inside article or main
elements if it has any, else the others. If nothing but template is there, it stays.

Only hashes are shuffled for 1 and 2. Streams of a host are aligned in parts of
bounded size, whose wrappers are aligned in turn, so no task holds all streams of a
host. What a wrapper says is broadcast to the pages of hosts with more than 1/2000
of all pages, which then aren't moved; others are joined by host.

Defined cases: null or empty html gives the empty text; pages without a host are
taken together as one; white space is that of str.split, no-break spaces included;
unclosed tags and stray ones are tolerated, and where over `_BAD_QUOTES` tags of a
page have unclosed quotes, quotes count no more; repeated rows give a row each;
extra columns are ignored; no rows give no rows. Time is linear in a page's length.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import join_split, stored
from concord.llm.wordhash import slices

_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
_REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">]+)*+>")
_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I | re.S)

#: The kinds of elements, and names that tell what is no main text.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul caption template".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe head title select button textarea input dialog menu object svg canvas audio video".split())
DROPPED_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus replies reply respond reviews pagination pager skip toolbar widget widgets hidden".split())
#: Those of DROPPED_NAMES that may also tell how a whole page is laid out.
LAYOUT_NAMES = frozenset("nav navbar navigation menu sidebar aside banner widget widgets toolbar".split())
MAIN = frozenset(("article", "main"))
_PARAGRAPH_ENDS = BLOCKS - {"option", "optgroup"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ITEMS = frozenset("li tr td th dt dd option".split())
_LISTS = frozenset("ul ol table dl select menu".split())
#: Words that, beside one of DROPPED_NAMES, leave a compound name what it is; with any other word it names something else.
NEUTRAL_NAMES = frozenset("site page top bottom left right main box boxes list lists bar area section block wrapper wrap container inner outer item items link links button buttons form posts articles stories post article content text body user users reader readers global primary secondary header head title sticky inline".split())
_BAD_QUOTES = 100


def _marks(words: list[str]) -> set[str]:
    """Those of DROPPED_NAMES by which words of class, id and role mark no main text."""
    out: set[str] = set()
    for word in words:
        parts = [x for x in re.split(r"[-_]+", word) if not x.isdigit()]
        if all(x in DROPPED_NAMES or x in NEUTRAL_NAMES for x in parts):
            out.update(x for x in parts if x in DROPPED_NAMES)
    return out


def _names(attributes: str) -> tuple[list[str], bool]:
    """Words in class, id and role, and whether the element is hidden."""
    words, hidden = [], False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
        elif name in ("class", "id", "role"):
            words += value.split()
    return words, hidden


class Block(NamedTuple):
    path: int  # a hash of the path, whose lowest bits tell blocks of links, blocks inside article or main, and headings
    text: str

    def key(self) -> int:
        """A hash of path and text, with the path's lowest bits."""
        return _hash(f"{self.path}={self.text}") & ~7 | self.path & 7


class _Open(NamedTuple):
    name: str
    path: int
    kept: bool
    inside: bool
    mark: int  # number of the nearest element that a name marks, or -1


class _Marked:
    """An element that a name marks, and what it holds."""

    def __init__(self, parent: int, layout: bool):
        self.parent, self.layout = parent, layout
        self.holds: set[str] = set()  # article, main
        self.chars = self.linked = 0


def _released(marked: list[_Marked], outside: set[str], chars: int) -> list[bool]:
    """Of each marked element: whether neither its name nor those around it drop its text.

    outside: which of article and main the page has outside of all marked elements;
    chars: of text there. Parents have smaller numbers than what they hold.
    """
    for m in reversed(marked):
        if m.parent >= 0:
            above = marked[m.parent]
            above.holds |= m.holds
            above.chars += m.chars
            above.linked += m.linked
        else:
            chars += m.chars
    anywhere = outside.union(*(m.holds for m in marked))
    out: list[bool] = []
    for m in marked:
        if "main" in m.holds and "main" not in outside:
            free = True
        elif anywhere:
            free = m.layout and "article" in m.holds and not outside
        else:
            free = m.layout and 2 * m.chars > chars and 2 * m.linked < m.chars
        out.append(free and (m.parent < 0 or out[m.parent]))
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def blocks(page: str) -> list[Block]:
    """The blocks with text that elements and names don't drop, in page order."""
    top = _Open("", 0, True, False, -1)
    stack = [top]
    places: dict[str, list[int]] = {}  # of open elements, by name
    lists: list[int] = []  # of open lists
    paths: dict[tuple[int, str], int] = {}
    closing: dict[str, re.Pattern] = {}
    marked: list[_Marked] = []
    outside: set[str] = set()
    out: list[tuple[Block, int]] = []
    text: list[str] = []
    links = bad = anchors = chars = 0  # links: characters in links; chars: of text outside of marked elements

    def flush() -> None:
        nonlocal links, chars
        if text:
            last = stack[-1]
            if joined := " ".join("".join(text).split()):
                linked = 2 * links >= sum(len(t) - t.count(" ") for t in text)
                out.append((Block(last.path & ~7 | (last.name in HEADINGS) << 2 | last.inside << 1 | linked, joined), last.mark))
                if last.mark < 0:
                    chars += len(joined)
                else:
                    marked[last.mark].chars += len(joined)
                    marked[last.mark].linked += linked * len(joined)
            text.clear()
            links = 0

    def add(plain: str) -> None:
        nonlocal links
        if not stack[-1].kept:
            return
        found = _html.unescape(plain)
        text.append(found)
        if anchors:
            links += len(found)

    def close(to: int) -> None:
        nonlocal anchors
        while len(stack) > to:
            name = stack.pop().name
            places[name].pop()
            if name in _LISTS:
                lists.pop()
            if name == "a":
                anchors -= 1

    at, end = 0, len(page)
    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        if begin > at:
            add(page[at:begin])
        m = _TAG.match(page, begin)
        if not m:
            if page.startswith("<!--", begin):
                stop = page.find("-->", begin + 4)
                at = stop + 3 if stop >= 0 else end
            elif page.startswith("<![CDATA[", begin):
                stop = page.find("]]>", begin + 9)
                at = stop + 3 if stop >= 0 else end
            elif page.startswith(("<!", "<?", "</"), begin):
                stop = page.find(">", begin)
                at = stop + 1 if stop >= 0 else end
            else:
                add("<")
                at = begin + 1
            continue
        rest = _REST.match(page, m.end()) if bad < _BAD_QUOTES else None
        bad += rest is None
        at = rest.end() if rest else page.find(">", m.end()) + 1 or end
        attributes = page[m.end() : at - 1]
        name = m[1].lower()
        if page[begin + 1] == "/":
            if name in BLOCKS:
                flush()
            if places.get(name):
                close(places[name][-1])
            continue
        if name in RAW:
            if name not in closing:
                closing[name] = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I)
            stop = closing[name].search(page, at)
            at = stop.end() if stop else end
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if name in _PARAGRAPH_ENDS and places.get("p"):
                close(places["p"][-1])
            if name in _ITEMS and places.get(name) and (not lists or lists[-1] < places[name][-1]):
                close(places[name][-1])
        if name in VOID or name not in BLOCKS and _CLOSED.search(attributes):
            continue
        words, hidden = _names(attributes)
        last = stack[-1]
        names = _marks(words) if name not in MAIN and name not in ("html", "body") else set()
        kept = last.kept and not (hidden or names and name not in BLOCKS or name in DROPPED or name == "header" and not last.inside)
        if name in BLOCKS or name == "a" or not kept:
            path, mark = last.path, last.mark
            if kept and names:
                marked.append(_Marked(mark, names <= LAYOUT_NAMES))
                mark = len(marked) - 1
            elif kept and name in MAIN:
                (marked[mark].holds if mark >= 0 else outside).add(name)
            if name in BLOCKS:
                label = name + "." + re.sub(r"[0-9]+", "0", words[0]) if words and "class" in attributes.lower() else name
                if (path, label) not in paths:
                    paths[path, label] = _hash(f"{path}/{label}")
                path = paths[path, label]
            places.setdefault(name, []).append(len(stack))
            if name in _LISTS:
                lists.append(len(stack))
            anchors += name == "a"
            stack.append(_Open(name, path, kept, last.inside or name in MAIN, mark))
    flush()
    free = _released(marked, outside, chars)
    return [b for b, m in out if m < 0 or free[m]]


Item = tuple[tuple[str, ...], bool, bool]  # tokens of a group, repeated, optional


def fold(tokens: list[str], longest: int = 48) -> list[Item]:
    """The stream with repeated groups: tokens that follow themselves become one group, short groups first."""
    items: list[Item] = []
    for t in tokens:
        if items and items[-1][0] == (t,):
            items[-1] = ((t,), True, False)
        else:
            items.append(((t,), False, False))
    return _squares(items, longest)


def _squares(items: list[Item], longest: int) -> list[Item]:
    for size in range(2, min(longest, len(items) // 2) + 1):
        out: list[Item] = []
        k = 0
        keys = [i[0] for i in items]
        while k < len(items):
            n = 1
            while keys[k : k + size] == keys[k + n * size : k + (n + 1) * size] and len(keys[k : k + size]) == size:
                n += 1
            if n > 1:
                out.append((tuple(t for key in keys[k : k + size] for t in key), True, False))
                k += n * size
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def _rows(a: list, b: list) -> Iterator[int]:
    """For each start of a the bits of b: one is clear where a longest common sequence grows."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of longest common sequences of a and each start of b; a isn't empty."""
    for v in _rows(a, b):
        last = v
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: list, b: list, bits: int = 1 << 30) -> list[tuple[int, int]]:
    """Places of a longest common sequence, by rows of bits; where they would take more than `bits`, one half of a after the other."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner_a, inner_b = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(inner_a), len(inner_b)
    middle: list[tuple[int, int]] = []
    if n > 1 and n * m > bits:
        half = n // 2
        cut = int(np.argmax(_lengths(inner_a[:half], inner_b) + _lengths(inner_a[half:][::-1], inner_b[::-1])[::-1]))
        middle = _common(inner_a[:half], inner_b[:cut], bits) + [(half + i, cut + j) for i, j in _common(inner_a[half:], inner_b[cut:], bits)]
    elif n and m:
        rows = list(_rows(inner_a, inner_b))
        i, j = n, m
        while i and j:
            if rows[i - 1] >> j - 1 & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> j - 1 & 1:
                    j -= 1
                    middle.append((i, j))
        middle.reverse()
    return [(k, k) for k in range(head)] + [(head + i, head + j) for i, j in middle] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _grouped(items: list[Item], groups: set[tuple[str, ...]]) -> list[Item]:
    """The items, of which those that spell a group become that group, once, unless some may lack; longer groups first."""
    starts: dict[str, list[tuple[str, ...]]] = {}
    for g in sorted(groups, key=lambda g: (-len(g), g)):
        starts.setdefault(g[0], []).append(g)
    out: list[Item] = []
    k = 0
    while k < len(items):
        for g in starts.get(items[k][0][0], ()):
            part = items[k : k + len(g)]
            if [i[0] for i in part] == [(t,) for t in g] and not any(o for _, _, o in part):
                out.append((g, False, False))
                k += len(g)
                break
        else:
            out.append(items[k])
            k += 1
    return out


def align(wrapper: list[Item], other: list[Item]) -> list[Item]:
    """The wrapper that takes what either takes: longest common sequence of groups, the rest optional, then repeats folded."""
    groups = {g for g, r, _ in wrapper + other if r and len(g) > 1}
    if groups:
        wrapper, other = _grouped(wrapper, groups), _grouped(other, groups)
    a, b = [i[0] for i in wrapper], [i[0] for i in other]
    out: list[Item] = []
    i = j = 0
    for x, y in [*_common(a, b), (len(a), len(b))]:
        out += [(g, r, True) for g, r, _ in wrapper[i:x]] + [(g, r, True) for g, r, _ in other[j:y]]
        if x < len(a):
            out.append((a[x], wrapper[x][1] or other[y][1], wrapper[x][2] or other[y][2]))
        i, j = x + 1, y + 1
    merged: list[Item] = []
    for item in out:  # neighbours of one kind: a repeated group
        if merged and merged[-1][0] == item[0]:
            merged[-1] = (item[0], True, merged[-1][2] and item[2])
        else:
            merged.append(item)
    return merged


def infer(streams: list[list[Item]]) -> list[Item]:
    """The wrapper of folded streams, aligned from the longest to the shortest."""
    ordered = sorted(streams, key=lambda s: (-len(s), s))
    wrapper = ordered[0]
    for s in ordered[1:]:
        wrapper = align(wrapper, s)
    return wrapper


def template(wrapper: list[Item]) -> tuple[list[int], list[int]]:
    """What the wrapper tells from main text: hashes of literals and of paths that only menus have; and of paths of menus that other blocks have too."""
    places: dict[str, list[bool]] = {}  # of each literal: whether its items repeat; of each path: whether they are menus
    for group, repeated, _ in wrapper:
        menu = repeated and all(not t.startswith("=") and int(t, 16) & 3 == 1 for t in group)
        for t in group:
            places.setdefault(t, []).append(repeated if t.startswith("=") else menu)
    own = [int(t[1:], 16) for t, r in places.items() if t.startswith("=") and r == [False]]
    menus = {int(t, 16): all(r) for t, r in places.items() if not t.startswith("=") and any(r)}
    return [t for t in own if t & 6 != 6] + [t for t, only in menus.items() if only], [t for t, only in menus.items() if not only]


def main_text(found: list[Block], gone: frozenset[int], runs: frozenset[int]) -> str:
    """The text of a page; runs: paths whose blocks go where several follow each other."""
    inside = [b for b in found if b.path & 2] or found
    main = []
    for k, b in enumerate(inside):
        run = b.path in runs and b.path in [x.path for x in inside[max(k - 1, 0) : k] + inside[k + 1 : k + 2]]
        if not run and b.path not in gone and b.key() not in gone:
            main.append(b.text)
    return "\n\n".join(main or [b.text for b in inside])


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))


def streams(pages: DataFrame) -> DataFrame:
    """host, page (a hash) and stream (hashes of path and text of each block, in turn) of pages that differ."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                rows = []
                for name, page in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    stream = np.array([(b.path, b.key()) for b in blocks(page)], np.int64).tobytes()
                    rows.append((name, int.from_bytes(hashlib.blake2b(stream, digest_size=8).digest(), "big", signed=True), stream))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["host", "page", "stream"])

    found = pages.select("host", "html").mapInArrow(read, "host string, page bigint, stream binary")
    return stored(found.where("octet_length(stream) > 0").groupBy("host", "page").agg(F.first("stream").alias("stream")), "streams")


def literals(found: DataFrame, least: int, share: float) -> DataFrame:
    """host and text (a hash) of texts on `least` pages or more and in `share` of the host's pages with their path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, paths, texts = [], [], []
            for name, stream in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = set(map(tuple, np.frombuffer(stream, np.int64).reshape(-1, 2).tolist()))
                pairs |= {(p, None) for p, _ in pairs}
                names += [name] * len(pairs)
                paths += [p for p, _ in pairs]
                texts += [t for _, t in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.int64()), pa.array(texts, pa.int64())], names=["host", "path", "text"])

    counts = found.select("host", "stream").mapInArrow(read, "host string, path bigint, text bigint").groupBy("host", "path", "text").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.where(F.col("n") >= least), "texts")
    of_path = counts.where("text IS NULL").select("host", "path", F.col("n").alias("pages"))
    return counts.where("text IS NOT NULL").join(of_path, ["host", "path"]).where(F.col("n") >= share * F.col("pages")).select("host", "text")


def wrappers(pages: DataFrame, least: int = 5, share: float = 0.8, size: int = 4 << 20) -> DataFrame:
    """host and wrapper (JSON) of every host with text. pages: as from `_pages`. size: bytes of streams that one task aligns."""
    found = streams(pages)
    hosts = found.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    fixed = literals(found, least, share).groupBy("host").agg(F.collect_list("text").alias("fixed"))  # some times the blocks of a page
    known = stored(hosts.join(fixed, "host", "left"), "literals")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stream, fixed in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                constant = set(fixed or ())
                out.append(json.dumps(fold([f"={t:x}" if t in constant else f"{p:x}" for p, t in np.frombuffer(stream, np.int64).reshape(-1, 2).tolist()])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "wrapper"])

    def one(t: pa.Table) -> pa.Table:
        read = [[(tuple(g), r, o) for g, r, o in json.loads(s)] for s in t.column("wrapper").to_pylist()]
        return pa.table({"host": t.column("host")[:1], "wrapper": pa.array([json.dumps(infer(read))], pa.string())})

    both = join_split(found, known, ["host"], found.count()).select("host", "stream", "fixed")
    parts = stored(both.mapInArrow(folded, "host string, wrapper string").distinct(), "folded")
    while True:  # each round leaves a wrapper of each part
        weights = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("wrapper")).alias("bytes")).where("n > 1")
        weights = weights.select("host", "n", F.least(F.ceil(F.col("bytes") / size), F.ceil(F.col("n") / 2)).alias("parts"))
        most = weights.agg(F.max("parts")).head()[0]
        if most is None:
            return parts
        dealt = parts.join(weights.select("host", "parts"), "host", "left").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.coalesce("parts", F.lit(1))))
        parts = stored(dealt.select("host", "part", "wrapper").groupBy("host", "part").applyInArrow(one, "host string, wrapper string"), "wrappers")


EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (blocks of main text, joined by two line feeds) and n_chars."""
    own = _pages(pages)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [template([(tuple(g), r, o) for g, r, o in json.loads(w)]) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], pa.list_(pa.int64())) for k in (0, 1))], names=["host", "gone", "runs"])

    told = wrappers(own).select("host", "wrapper").mapInArrow(decide, "host string, gone array<bigint>, runs array<bigint>")
    hosts = own.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    told = stored(hosts.join(told, "host", "left"), "told")
    total = told.agg(F.sum("n")).head()[0] or 0
    both = join_split(own, told, ["host"], total).select("page_id", "html", "url", "gone", "runs")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                told_of = zip(*(some.column(k).to_pylist() for k in (1, 3, 4)), strict=True)
                texts = [main_text(blocks(page), frozenset(gone or ()), frozenset(runs or ())) for page, gone, runs in told_of]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(read, EXTRACTED)
