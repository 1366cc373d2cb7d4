"""Main text of web pages: host suffix arrays over page token streams.

The pages of a host are parsed into blocks of text inside containers. Their
token streams are put one after another and sorted as suffixes, to the depth of
a "long" substring; equal neighbours are long substrings that several pages
share. Containers that such substrings cover are boilerplate (menus, notices,
footers, advert slots), the runs that are left are the page's own.

Repetition alone cannot tell a page's article from its copies, or a sentence
that many articles hold from a notice. So the markup has a say: elements that
name their role (``nav``, ``footer``, ``class="ad"``, ...) are left out at
once, the blocks of an ``article`` or ``main`` are judged container by
container below it and never sentence by sentence, and a page that would lose
most of its text to repetition is taken for a copy and keeps it.

Pages are parsed where they are read; what travels is the text of their blocks,
compressed, the pages of a task that belong together in one record.

A host too large for one suffix array has several. Each lists its long
substrings with their pages, the lists of a host are summed, and every array is
told which of its substrings the host's pages hold often enough. This takes two
rounds: the first lists so many leading bits of the hashes as the host's size
asks for and names what may be frequent (equal leading bits add up, so nothing
frequent is missed), the second lists and sums whole hashes of these alone.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtab.llm.util import landed

#: Tokens (block marks included) of a long substring, distinct pages that must
#: hold it, and the covered share from which a container is boilerplate.
LONG, PAGES, COVERED = 6, 3, 0.9
#: Pages and characters of one suffix array; a larger host has several.
PART_PAGES, PART_CHARS = 512, 6_000_000
#: Hosts with several parts that are sent to every task (two short columns); more are joined.
LARGE_HOSTS = 50_000
#: Parts of a host whose substring lists are summed in one task's group (whole lists, or ranges of more of them).
LIST_PARTS = 8
#: Leading bits of a hash that a first list holds, besides those that number the host's parts.
LIST_BITS = 24

#: Elements whose text is not the page's, elements whose content is text up to their end tag, elements
#: that are not part of an article, containers, elements that end a block, elements that end an open paragraph, void
#: elements, elements of a head.
SILENT = frozenset("noscript template svg math object head select button option datalist canvas audio video".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
APART = frozenset("nav header footer aside form menu dialog".split())
CONTAINERS = frozenset("body div section article main nav header footer aside form table figure details".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd tr td th thead tbody tfoot caption blockquote "
                                "pre address figcaption summary fieldset legend hr hgroup dialog menu center".split())
ENDS_P = BLOCKS - frozenset("li dt dd tr td th thead tbody tfoot caption legend body summary".split())
SCOPES = CONTAINERS | SILENT
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
MAIN = frozenset(("article", "main"))
#: What an element's start ends (while one is open, up to an element of the second list).
IMPLIED = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"),
    "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot caption", "table"), "tbody": ("thead tbody tfoot caption", "table"),
    "tfoot": ("thead tbody tfoot caption", "table")}
IMPLIED = {k: (frozenset(x.split()), frozenset(y.split()) | SILENT) for k, (x, y) in IMPLIED.items()}
PLAIN_ENDS = BLOCKS | SILENT           # end tags that end an open element of their name
UNSCOPED = CONTAINERS | SILENT         # those that end it wherever it is
NOWHERE: frozenset[str] = frozenset()
MARKED = BLOCKS | SILENT | RAW | frozenset(("br",))
#: Words of a class, id or role that name something other than the article.
ROLES = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead topbar footer contentinfo complementary comment comments disqus respond replies share sharing social "
    "related recommended newsletter subscribe subscription signup popup modal overlay widget pagination pager login "
    "search toolbar copyright form dialog".split())

COMMENTS = frozenset("comment comments disqus respond replies".split())
#: Words that say how such a thing is laid out, not what it is: the word before them counts.
LAYOUT = frozenset("area bar block body bottom box button buttons container content group holder icons inner item items "
                   "large left link links list module outer panel posts right row section size slot small thread top "
                   "unit wrap wrapper x zone".split())
#: Open elements, and marked inline elements in one of them, that are told apart; what is nested deeper belongs to
#: the innermost of them (as in browsers), with its text.
NESTED = 512

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s/>=]?[^\s/>=]*)\s*(=\s*)?")
_GAP = re.compile(r"[\s/]*")
_UNQUOTED = re.compile(r"[^\s>]*")
_SPLIT = re.compile(r"[^a-z0-9]+")
_COMPOUND = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass
class Block:
    text: str
    apart: bool            # inside an element that names another role
    main: bool             # inside an article or main element
    container: int
    nested: bool           # the container is not the article, main or body itself


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)


def role_of(name: str) -> int:
    """2 if a class, id or role names reader comments, 1 if another role than the article's, else 0.

    In a compound the last word says what the thing is (``site-footer`` is a
    footer, ``share-price`` a price), words of layout and numbers aside.
    """
    parts = [w.lower() for w in _COMPOUND.findall(name)]
    while len(parts) > 1 and (parts[-1] in LAYOUT or parts[-1].isdigit()):
        parts.pop()
    last = parts[-1] if parts else ""
    return 2 if last in COMMENTS else int(last in ROLES)


def other_role(names: list[str]) -> int:
    """The strongest role that the values of class, id and role name."""
    return max((role_of(n) for value in names for n in value.split()), default=0)


class Source:
    """A page's markup, read once from start to end. Broken markup never fails and is never read twice."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.last_quote = {q: text.rfind(q) for q in "\"'"}
        self.tags: dict[str, tuple[list[int], list[int]]] = {}

    def tag(self, at: int) -> tuple[list[str], int]:
        """Values of class, id and role of the tag whose name ends at ``at``, and the place after it (-1: no end)."""
        text, names = self.text, []
        while True:
            at = _GAP.match(text, at).end()
            if at >= len(text):
                return names, -1
            if text[at] == ">":
                return names, at + 1
            m = _ATTRIBUTE.match(text, at)
            at, value = max(m.end(), at + 1), ""
            if m[2]:
                quote = text[at:at + 1]
                if quote in ("\"", "'"):
                    if at < self.last_quote[quote]:
                        end = text.index(quote, at + 1)
                        value, at = text[at + 1:end], end + 1
                    else:                            # a quote that nothing closes: the tag ends at its >
                        end = text.find(">", at)
                        return names, end + 1 if end >= 0 else -1
                else:
                    u = _UNQUOTED.match(text, at)
                    value, at = u[0], u.end()
            if value and m[1].lower() in ("class", "id", "role"):
                names.append(value)

    def _places(self, name: str) -> tuple[list[int], list[int]]:
        if name not in self.tags:
            starts, ends = [], []
            for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", self.text, re.I):
                (ends if m[1] else starts).append(m.start())
            self.tags[name] = starts, ends
        return self.tags[name]

    def end_of(self, name: str, at: int) -> int:
        """Where the next end tag of ``name`` begins, -1 if there is none."""
        if name not in self.tags:
            near = self.text.find(f"</{name}>", at, at + 2000)
            if near >= 0 and self.text.find("</", at, near) < 0:
                return near
        ends = self._places(name)[1]
        k = bisect_left(ends, at)
        return ends[k] if k < len(ends) else -1

    def is_closed(self, name: str, at: int) -> bool:
        """Whether an end tag of ``name`` comes before the next start of one."""
        starts, end = self._places(name)[0], self.end_of(name, at)
        k = bisect_left(starts, at)
        return end >= 0 and (k == len(starts) or end < starts[k])


@dataclass(slots=True)
class Frame:
    """An open element that bounds blocks, with the marked inline elements open inside it."""
    tag: str
    apart: int = 0         # 1: another role, 2: for good
    main: bool = False
    container: int = 0
    nested: bool = False
    silent: bool = False
    inline: list[tuple[str, int]] | None = None          # tag, and ``apart`` before it


def parse(source: str | None) -> Page:
    """Blocks of text of a page, in order, in time linear in its length.

    Elements nest as HTML says: a start may imply the end of an open paragraph,
    list item, cell or option; an end tag that fits no open element is passed
    over. An element without text of its own (a button, a list of options, an
    object) that is never closed counts as empty, so it hides nothing.
    """
    page, words = Page(), []
    stack, opened = [Frame("body")], Counter(["body"])
    containers, at = 1, 0
    source = source or ""
    read = Source(source)

    def flush() -> None:
        if words and not stack[-1].silent:           # a silent element does not end the block around it
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                top = stack[-1]
                page.blocks.append(Block(text, top.apart > 0, top.main, top.container, top.nested))

    def say(text: str) -> None:
        if stack[-1].tag == "head" and text.strip():
            close(len(stack) - 1)
        if text and not stack[-1].silent:
            words.append(html.unescape(text) if "&" in text else text)

    def close(depth: int) -> None:
        flush()
        for f in stack[depth:]:
            opened[f.tag] -= 1
        del stack[depth:]

    def close_open(tags: frozenset[str], bounds: frozenset[str]) -> None:
        """End the innermost open element of ``tags`` that no element of ``bounds`` separates."""
        for depth in range(len(stack) - 1, 0, -1):
            tag = stack[depth].tag
            if tag in tags:
                close(depth)
                return
            if tag in bounds:
                return

    size, find, name_at = len(source), source.find, _NAME.match
    while at < size:
        lt = find("<", at)
        if lt < 0:
            break
        if lt > at:
            say(source[at:lt])
        m = name_at(source, lt + 1)
        ending = m is None
        if ending:
            nxt = source[lt + 1:lt + 2]
            if nxt == "/":
                m = name_at(source, lt + 2)
            if m is None:
                if nxt in ("!", "?", "/"):           # a comment, or a remark up to the next >
                    mark = "-->" if source.startswith("<!--", lt) else ">"
                    end = find(mark, lt + 2)
                    at = end + len(mark) if end >= 0 else size
                else:
                    say("<")
                    at = lt + 1
                continue
        tag, at = m[0].lower(), m.end()
        names: list[str] = []
        if source.startswith(">", at):
            at += 1
        else:
            names, at = read.tag(at)
            if at < 0:
                at = size                            # the page ends inside a tag
                break
        top = stack[-1]
        if ending:
            if tag in PLAIN_ENDS:
                if opened[tag] and tag != "body":    # a stray end inside another container closes nothing
                    close_open(frozenset((tag,)), NOWHERE if tag in UNSCOPED else SCOPES)
                elif tag == "p":
                    flush()
            elif top.inline and any(t == tag for t, _ in top.inline):
                flush()
                while True:
                    t, before = top.inline.pop()
                    top.apart = before
                    if t == tag:
                        break
            continue
        if tag not in MARKED and not names:          # emphasis, links and the like say nothing about blocks
            if top.tag != "head":
                continue
        if top.tag == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag in RAW:
            end = read.end_of(tag, at)
            if end >= 0:
                at = read.tag(end + 2 + len(tag))[1]
                at = size if at < 0 else at
            elif tag in ("script", "style"):
                at = size                            # code up to the page's end
            continue
        if tag == "br":
            say(" ")
        if tag in ENDS_P and opened["p"]:
            close_open(frozenset(["p"]), SCOPES)
        if tag in IMPLIED and any(opened[t] for t in IMPLIED[tag][0]):
            close_open(*IMPLIED[tag])
        if tag in BLOCKS:
            flush()
        if tag in VOID or tag in ("html", "body"):
            continue
        if tag in SILENT:
            if tag == "option" and stack[-1].tag not in ("select", "datalist", "optgroup"):
                continue
            if (tag in ("head", "option") or read.is_closed(tag, at)) and len(stack) < NESTED:
                top = stack[-1]
                stack.append(Frame(tag, top.apart, top.main, top.container, top.nested, True))
                opened[tag] += 1
            continue
        top = stack[-1]
        role = other_role(names)
        if tag not in BLOCKS:
            if role and top.apart < role and len(top.inline or ()) < NESTED:   # only marked inline elements matter
                flush()
                top.inline = [*(top.inline or ()), (tag, top.apart)]
                top.apart = role
            continue
        if len(stack) >= NESTED:
            continue
        other = max(role, 1) if tag == "form" else 2 if tag in APART else role   # a form may wrap a whole page
        if tag in MAIN and not other and top.apart < 2 and not top.main:
            apart, main = 0, True                    # an article frees itself from a wrapper's class
        else:
            apart, main = max(top.apart, other), top.main or tag in MAIN
        frame = Frame(tag, apart, main, top.container, top.nested, top.silent)
        if tag in CONTAINERS:
            frame.container, frame.nested, containers = containers, tag not in MAIN, containers + 1
        stack.append(frame)
        opened[tag] += 1
    if at < size:
        say(source[at:])
    flush()
    return page


def ranks_to_depth(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` tokens (equal ranks: equal prefixes), by doubling."""
    rank, have = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while have < depth:
        step = min(have, depth - have)
        ahead = np.full(len(rank), -1, dtype=np.int64)
        ahead[:-step] = rank[step:]
        pair = rank * (len(rank) + 1) + ahead + 1
        rank, have = np.unique(pair, return_inverse=True)[1].astype(np.int64), have + step
    return rank


def repeated(tokens: np.ndarray, page: np.ndarray, long: int = LONG, pages: int = PAGES,
             known: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in a substring of ``long`` tokens that ``pages`` distinct pages hold.

    Suffixes sorted to the depth of ``long`` put equal substrings side by side.
    A substring that runs over the end of its page does not count. ``known``
    marks the tokens where substrings begin that count because of other pages.
    """
    n = len(tokens)
    if n < long:
        return np.zeros(n, dtype=bool)
    rank = ranks_to_depth(tokens, long)
    at = begins(page, long)
    order = at[np.lexsort((page[at], rank[at]))]
    new = np.ones(len(order), dtype=bool)            # first suffix of its page with this prefix
    new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (page[order[1:]] != page[order[:-1]])
    holders = np.bincount(rank[order], weights=new, minlength=int(rank.max()) + 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    often = holders[rank[order]] >= pages
    hits = order[often if known is None else often | known[order]]
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + long, -1)
    return np.cumsum(edge[:n]) > 0


def begins(page: np.ndarray, long: int = LONG) -> np.ndarray:
    """Tokens where a substring of ``long`` tokens begins that does not run over the end of its page."""
    n = len(page)
    return np.flatnonzero(page[long - 1:] == page[:n - long + 1]) if n >= long else np.zeros(0, dtype=np.int64)


def hashes(tokens: np.ndarray, words: list[str], at: np.ndarray, long: int = LONG) -> np.ndarray:
    """64-bit hash of the ``long`` tokens from each place in ``at``; the same in every part."""
    name = np.array([0] + [int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                                          "little") for w in words], dtype=np.uint64)[tokens]
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(long):
        out = (out ^ name[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as the byte planes of their steps, compressed (planes of zeros vanish)."""
    planes = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(cell: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def main_text(page: Page, covered: list[float], sizes: list[int]) -> tuple[str, int]:
    """Text of a page and the characters left out because they repeat.

    ``covered``: share of each block's tokens in long repeated substrings.
    """
    blocks = page.blocks
    has_main = any(b.main and not b.apart for b in blocks)
    own = [i for i, b in enumerate(blocks) if not b.apart and (b.main or not has_main)]
    total = sum(sizes[i] for i in own)
    groups: dict[tuple[int, int], list[int]] = {}
    for i in own:
        if blocks[i].nested:
            groups.setdefault((blocks[i].container, -1), []).append(i)
        elif not blocks[i].main:         # loose blocks of the body stand for themselves
            groups.setdefault((blocks[i].container, i), []).append(i)
    out: set[int] = set()
    for members in groups.values():
        size = sum(sizes[i] for i in members)
        if size * 2 < total and sum(covered[i] * sizes[i] for i in members) >= COVERED * size:
            out.update(members)
    if sum(sizes[i] for i in out) * 2 > total:
        out = set()                      # a copy of another page, not its frame
    kept = [i for i in own if i not in out]
    chosen = set(kept)
    left = sum(len(blocks[i].text) for i in range(len(blocks)) if i not in chosen and covered[i] >= COVERED)
    return "\n".join(blocks[i].text for i in kept), left


@dataclass
class Part:
    """Pages of one host and their token streams, one after another."""
    pages: list[Page]
    tokens: np.ndarray
    page: np.ndarray
    spans: list[list[tuple[int, int]]]
    words: list[str]


def read_part(pages: list[Page]) -> Part:
    known: dict[str, int] = {}
    stream: list[int] = []
    spans: list[list[tuple[int, int]]] = []
    owner: list[int] = []
    for p in pages:
        mine, begin = [], len(stream)
        for b in p.blocks:
            stream.append(0)             # the mark between blocks
            start = len(stream)
            stream += [known.setdefault(w, len(known) + 1) for w in b.text.split()]
            mine.append((start, len(stream)))
        stream.append(0)
        owner.append(len(stream) - begin)
        spans.append(mine)
    return Part(pages, np.array(stream, dtype=np.int64), np.repeat(np.arange(len(pages)), owner), spans, list(known))


def starts(part: Part) -> tuple[np.ndarray, np.ndarray]:
    """Where a part's long substrings begin, and their hashes."""
    at = begins(part.page)
    return at, hashes(part.tokens, part.words, at)


def held(h: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of ``h``, ascending, and how many pages hold each (``page`` ascends)."""
    order = np.argsort(h, kind="stable")
    h, page = h[order], page[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (page[1:] != page[:-1])
    h = h[first]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), dtype=bool), h[1:] != h[:-1])))
    return h[at], np.diff(np.append(at, len(h)))


def extract_part(sources: list[str | None], often: np.ndarray | None = None) -> list[tuple[str, int]]:
    """Main texts of pages of one host (one suffix array).

    ``often``: hashes of substrings that enough pages of the host's other parts hold.
    """
    return part_texts(read_part([parse(s) for s in sources]), often)


def part_texts(part: Part, often: np.ndarray | None = None) -> list[tuple[str, int]]:
    known = None
    if often is not None and len(often):
        at, h = starts(part)
        known = np.zeros(len(part.tokens), dtype=bool)
        known[at] = np.isin(h, often)
    hit = np.concatenate(([0], np.cumsum(repeated(part.tokens, part.page, known=known))))
    out = []
    for p, mine in zip(part.pages, part.spans, strict=True):
        sizes = [e - s for s, e in mine]
        out.append(main_text(p, [float(hit[e] - hit[s]) / max(1, e - s) for s, e in mine], sizes))
    return out


RECORDS = "host string, part long, parts long, page_id array<long>, url array<string>, texts binary, marks binary"
#: Between the pages of a record; neither it nor a line feed is ever inside the text of a block.
PAGE_END = "\x1e"


def parsed_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as the blocks of their text: those of a batch that share host and part in one record."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in ("host", "part", "parts")), strict=True)):
            groups.setdefault(key, []).append(i)
        source = batch.column("html")
        for (host, part, parts), at in groups.items():
            texts, marks = [], []
            for i in at:
                blocks = parse(source[i].as_py()).blocks
                texts.append("\n".join(b.text for b in blocks))
                marks += [b.container * 8 + b.apart + 2 * b.main + 4 * b.nested for b in blocks]
            chosen = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([host], pa.string()), pa.array([part], pa.int64()), pa.array([parts], pa.int64()),
                 pa.array([batch.column("page_id").take(chosen).to_pylist()], pa.list_(pa.int64())),
                 pa.array([batch.column("url").take(chosen).to_pylist()], pa.list_(pa.string())),
                 pa.array([squeeze.compress(PAGE_END.join(texts).encode("utf-8", "surrogatepass"))], pa.binary()),
                 pa.array([squeeze.compress(np.array(marks, dtype="<i4").tobytes())], pa.binary())],
                names=["host", "part", "parts", "page_id", "url", "texts", "marks"])


def recorded_part(table: pa.Table) -> Part:
    """The pages of one part from its records, in the records' order."""
    pages, expand = [], zstandard.ZstdDecompressor()
    for texts, marks in zip(table.column("texts"), table.column("marks"), strict=True):
        mark = iter(np.frombuffer(expand.decompress(marks.as_py()), "<i4").tolist())
        for text in expand.decompress(texts.as_py()).decode("utf-8", "surrogatepass").split(PAGE_END):
            pages.append(Page([Block(t, bool((m := next(mark)) & 1), bool(m & 2), m >> 3, bool(m & 4))
                               for t in (text.split("\n") if text else [])]))
    return read_part(pages)


def leading(h: np.ndarray, parts: int) -> np.ndarray:
    """``h`` without the bits that first lists of a host of so many parts do without."""
    return h & ~np.uint64((1 << max(0, 64 - LIST_BITS - (parts - 1).bit_length())) - 1)


LISTS = "host string, part long, range long, hashes binary, pages binary"


def list_part(table: pa.Table, often: pa.Table | None = None) -> pa.Table:
    """The substrings of a part in ranges of their hashes; nothing for a host of one part.

    First the leading bits of all hashes; with ``often``, the whole hashes whose leading bits it names.
    """
    parts = table.column("parts")[0].as_py()
    schema = pa.schema([("host", pa.string()), ("part", pa.int64()), ("range", pa.int64()),
                        ("hashes", pa.binary()), ("pages", pa.binary())])
    if parts is None or often is not None and not len(often):
        return schema.empty_table()
    part = recorded_part(table)
    at, h = starts(part)
    page = part.page[at]
    if often is None:
        h = leading(h, parts)
    else:
        hit = np.isin(leading(h, parts), np.concatenate([unpacked(c.as_py()) for c in often.column("hashes")]))
        h, page = h[hit], page[hit]
    h, n = held(h, page)
    ranges = -(-parts // LIST_PARTS)
    where = (h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    cut = np.searchsorted(where, np.arange(ranges + 1, dtype=np.uint64))
    few = np.minimum(n, PAGES).astype(np.uint8)      # a sum reaches PAGES with or without the rest
    host, name = table.column("host")[0].as_py(), table.column("part")[0].as_py()
    squeeze = zstandard.ZstdCompressor(level=1)
    rows = [{"host": host, "part": name, "range": k, "hashes": packed(h[a:b]),
             "pages": squeeze.compress(few[a:b].tobytes())} for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
    return pa.Table.from_pylist(rows, schema=schema)


TOLD = "host string, part long, hashes binary"


def sum_lists(table: pa.Table, first: bool = False) -> pa.Table:
    """Per part, the substrings of a range that PAGES pages of the host hold, but not that many of the part.

    ``first``: those that other parts hold, too, and PAGES pages in all.
    """
    lists, expand = [unpacked(c.as_py()) for c in table.column("hashes")], zstandard.ZstdDecompressor()
    h = np.concatenate(lists)
    n = np.concatenate([np.frombuffer(expand.decompress(c.as_py()), np.uint8) for c in table.column("pages")])
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(h, kind="stable")
    h, n, of = h[order], n[order].astype(np.int64), of[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.append(start, len(h)))
    total = np.repeat(np.add.reduceat(n, start), size)
    hit = (total >= PAGES) & (np.repeat(size, size) > 1 if first else n < PAGES)
    h, of = h[hit], of[hit]
    told = [(i, h[of == i]) for i in np.unique(of)]
    return pa.table({"host": pa.array([table.column("host")[0].as_py()] * len(told), pa.string()),
                     "part": pa.array([table.column("part")[int(i)].as_py() for i, _ in told], pa.int64()),
                     "hashes": pa.array([packed(x) for _, x in told], pa.binary())})


def host_of(url: Column) -> Column:
    """Host of a URL in lower case (empty where there is none)."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, repeated_chars`` of every page.

    Blocks are joined by a line feed, white space inside a block is one space,
    character references are decoded. ``repeated_chars`` counts the characters
    left out that long repeated substrings cover. A null or empty html, or a
    page without article, gives the empty text; pages without url form a host
    of their own; repeated rows are pages of their own; an empty table gives
    no row; other columns are ignored.

    A host's pages are dealt by hash to parts of bounded size, each with its
    own suffix array, so a host with any share of all pages splits. Pages that
    hold a substring are counted over all parts of the host: how a host is
    split changes nothing. Markup is not shuffled: pages travel as the text of
    their blocks. Texts go straight to the result.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.col(source).alias("html"), host_of(F.col(url)).alias("host"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / PART_PAGES), F.ceil(F.sum(F.length("html")) / PART_CHARS), F.lit(1))
    large = rows.groupBy("host").agg(parts.alias("parts")).where("parts > 1")
    large = landed(large, "html-hosts")              # hosts of more than one part: few against their pages
    n_large = large.count()
    few = n_large <= LARGE_HOSTS
    dealt = rows.join(F.broadcast(large) if few else large, "host", "left").withColumn(
        "part", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.coalesce("parts", F.lit(1))))
    if not few:
        dealt = dealt.repartition("host", "part")    # else a host's pages would be parsed in the join's partition

    def run(table: pa.Table, lists: pa.Table | None = None) -> pa.Table:
        often = None if lists is None else np.concatenate(
            [np.zeros(0, dtype=np.uint64), *(unpacked(c.as_py()) for c in lists.column("hashes"))])
        got = part_texts(recorded_part(table), often)
        return pa.table({"page_id": table.column("page_id").combine_chunks().flatten(),
                         "url": table.column("url").combine_chunks().flatten(),
                         "text": pa.array([t for t, _ in got], pa.string()),
                         "n_chars": pa.array([len(t) for t, _ in got], pa.int64()),
                         "repeated_chars": pa.array([n for _, n in got], pa.int64())})

    schema = "page_id long, url string, text string, n_chars long, repeated_chars long"
    records = dealt.select("host", "part", "parts", "page_id", "url", "html").mapInArrow(parsed_records, RECORDS)
    grouped = records.groupBy("host", "part")
    if not n_large:
        return grouped.applyInArrow(lambda table: run(table), schema)
    maybe = grouped.applyInArrow(lambda table: list_part(table), LISTS).groupBy("host", "range").applyInArrow(
        lambda table: sum_lists(table, True), TOLD)
    told = grouped.cogroup(maybe.groupBy("host", "part")).applyInArrow(lambda a, b: list_part(a, b), LISTS) \
        .groupBy("host", "range").applyInArrow(lambda table: sum_lists(table), TOLD)
    return grouped.cogroup(told.groupBy("host", "part")).applyInArrow(lambda a, b: run(a, b), schema)
